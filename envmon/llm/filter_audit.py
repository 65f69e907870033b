"""How the filters of a corpus interact, over every order in which they could be applied.

A document's failures are a mask with one bit per filter.  Which filter removes
it under an order of the filters depends on its mask alone, and the orders that
begin with a given prefix are neighbours in lexicographic order: a prefix of
``s`` of ``k`` letters covers ``(k - s)!`` ranks from the prefix's Lehmer rank on.  So a
mask's removal at step ``s`` is a set of rank intervals: one for every prefix whose
last letter is in the mask and whose earlier letters aren't.  Documents are
counted by part and mask, each mask adds its count where an interval begins
and takes it away where it ends, and a prefix sum over the ``k!`` ranks gives what
every order removes at every step.  Documents never meet orders.

Identical texts are found through a digest: the smallest id per digest is joined
back by (digest, id), which no frequent text makes heavy.

Defined results: a null text counts as empty, a null part as the empty string.  A
null id is neither smaller nor larger than another, so such a row never fails the
copies filter and makes no other row fail it; rows that repeat the smallest id
of their text don't fail it either.  Labels of one id are combined (1 if any row
says 1).  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

#: The filters' letters, and what separates words.
FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> list[Column]:
    """Failures that a text decides: few words, repeated words, capitals, symbols."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    long = lambda c: c.cast("long")  # noqa: E731  products of a very long text's counts
    n, distinct = long(F.size(words)), long(F.size(F.array_distinct(words)))
    return [n < 200,
            100 * distinct < 50 * n,
            100 * long(F.regexp_count(text, F.lit("[A-Z]"))) > 2 * long(F.length(text)),
            text.rlike(r"[#$%&*|]")]


def failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, mask, quality, toxic) of every row; bit i of ``mask`` is failure of the filter FILTERS[i]."""
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(bad, F.lit(1 << i)).otherwise(F.lit(0)) for i, bad in enumerate(text_failures(text))), F.lit(0))
    facts = written(docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits.alias("bits"),
                                F.unhex(F.sha2(text, 256)).alias("digest")), "filter-facts")
    known = facts.where(F.col("doc_id").isNotNull())
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("quality"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (facts.join(firsts, ["digest", "doc_id"], "left").join(marked, "doc_id", "left")
            .select("doc_id", "part", (F.col("bits") + F.when(copy, F.lit(1 << 4)).otherwise(F.lit(0))).cast("int").alias("mask"),
                    F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic")))


def mask_counts(flags: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): at most 2^k rows a part, combined before the shuffle."""
    return flags.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("good"),
                                             F.sum("toxic").cast("long").alias("toxic"))


def lehmer_rank(prefix: tuple[int, ...], k: int) -> int:
    """Rank of the first order of ``k`` filters that begins with ``prefix``."""
    return sum(sum(x < p for x in range(k) if x not in prefix[:i]) * math.factorial(k - 1 - i) for i, p in enumerate(prefix))


def removal_intervals(k: int) -> list[tuple[int, int, int, int, int]]:
    """(mask, step, filter, first rank, last rank + 1) of every mask's removals."""
    out = []
    for step in range(1, k + 1):
        for prefix in itertools.permutations(range(k), step):
            first, rest = lehmer_rank(prefix, k), [x for x in range(k) if x not in prefix]
            for take in range(1 << len(rest)):
                mask = 1 << prefix[-1] | sum(1 << x for i, x in enumerate(rest) if take >> i & 1)
                out.append((mask, step, prefix[-1], first, first + math.factorial(k - step)))
    return out


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``counts`` is :func:`mask_counts` as a table (it is read several times).
    ``filters`` are up to six letters in alphabetical order.
    """
    spark, k = counts.sparkSession, len(filters)
    if not 1 <= k <= 6 or list(filters) != sorted(set(filters)):
        raise ValueError("one to six different letters in alphabetical order")
    ranks = math.factorial(k)
    spans = spark.createDataFrame(removal_intervals(k), "mask int, step int, filter int, first int, last int")
    orders = spark.createDataFrame(
        [(r, "".join(filters[x] for x in p), s + 1, x) for r, p in enumerate(itertools.permutations(range(k))) for s, x in enumerate(p)],
        "rank int, filter_order string, step int, filter int")
    hits = counts.join(spans, "mask")

    ends = hits.select("part", "step", F.explode(F.array(
        F.struct(F.col("first").alias("rank"), "n", "good", "toxic"),
        F.struct(F.col("last").alias("rank"), (-F.col("n")).alias("n"), (-F.col("good")).alias("good"),
                 (-F.col("toxic")).alias("toxic")))).alias("e")).select("part", "step", "e.*").where(F.col("rank") < ranks)
    zero = F.lit(0).cast("long")
    total = counts.groupBy("part").agg(F.sum("n").alias("total"))
    grid = (total.select("part", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
            .select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank"),
                    zero.alias("n"), zero.alias("good"), zero.alias("toxic")))
    changes = ends.unionByName(grid).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removed = changes.select("part", "step", "rank", F.sum("n").over(along).alias("removed"),
                             F.sum("good").over(along).alias("good_lost"), F.sum("toxic").over(along).alias("toxic_lost"))

    share = hits.groupBy("part", "filter").agg(F.sum(F.col("n") * (F.col("last") - F.col("first"))).alias("shapley"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)
    fails = counts.select("part", "n", "mask", F.explode(bits).alias("filter")).groupBy("part", "filter").agg(
        F.sum("n").alias("fails"), F.sum(F.when(F.bit_count("mask") == 1, F.col("n")).otherwise(0)).alias("unique_fails"))

    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    out = (removed.join(orders, ["rank", "step"]).join(total, "part").join(fails, ["part", "filter"], "left")
           .join(share, ["part", "filter"], "left").withColumn("gone", F.sum("removed").over(so_far)))
    known = lambda c: F.coalesce(c, zero)  # noqa: E731  a filter that nothing fails
    return out.select("part", "filter_order", "step", (F.col("total") - F.col("gone")).alias("kept"), "removed",
                      (known("fails") - F.col("removed")).alias("redundant"), known("unique_fails").alias("unique_fails"),
                      "good_lost", "toxic_lost", known("shapley").alias("shapley"))


def report(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The audit of the five filters over all rows of ``docs``."""
    return audit(written(mask_counts(failures(docs, labels, part)), "filter-masks"))
