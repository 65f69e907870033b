"""URL filter: rules by host and path, gradient-boosted trees on lexical features for the rest.

A rule names a host and a path prefix and fits the host and its subdomains; the
longest fitting rule decides.  The trees learn from labelled URLs and judge what no rule
fits.  Features: lengths of URL, host and path, depth, shares of digits and
marks, character entropy, parameters, and what the sample says about the
host's suffix (its last label): how common it is and its smoothed share of
blocked URLs.

Everything on the way from the table to the verdict is DataFrame code.

Learning uses at most ``max_labelled`` URLs (those with the smallest hash), so
the suffix table, one row per suffix of the sample, is bounded and broadcast.

Defined results: host and path of a null URL or one without ``://`` are empty
and no rule fits; the trees judge it like any other.  With no labelled URL the
method allows; with labels of one kind it gives that kind.  Of equally long
rules the first fits.  Repeated rows are judged alike; further columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written

#: Fixed values: (verdict, rule), a rule being host/path prefix.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/"))

FEATURES = ["url_length", "host_length", "path_length", "host_labels", "depth", "digit_share", "mark_share", "entropy",
            "parameters", "longest_digits", "suffix_share", "suffix_blocked"]


def host(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z folded; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                  "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict (null where none fits) to host and path."""
    def fits(rule: str) -> Column:
        name, slash, prefix = rule.partition("/")
        own = (F.col("host") == name) | F.endswith(F.col("host"), F.lit("." + name))
        return own & F.startswith(F.col("path"), F.lit(slash + prefix))

    order = sorted(rules, key=lambda r: -len(r[1]))
    if not order:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    pick = lambda i: reduce(lambda c, r: c.when(fits(r[1]), F.lit(r[i])), order[1:], F.when(fits(order[0][1]), F.lit(order[0][i])))  # noqa: E731,E501
    return pages.withColumns({"rule": pick(1), "rule_verdict": pick(0)})


def _entropy(text: Column) -> Column:
    """Bits per character, from the counts of the distinct characters."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    count = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double")
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.log2(n) - F.aggregate(chars, F.lit(0.0), lambda a, c: a + count(c) * F.log2(F.greatest(count(c), F.lit(1.0)))) / n


def suffix(host_: Column) -> Column:
    """The host's last label."""
    return F.element_at(F.split(host_, r"\."), -1)


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the features that the URL itself gives; needs url, host, path."""
    u, h, p = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    left = lambda pattern: F.length(F.regexp_replace(u, pattern, "")).cast("double")
    return pages.withColumns({
        "url_length": F.length(u).cast("double"), "host_length": F.length(h).cast("double"),
        "path_length": F.length(p).cast("double"), "host_labels": F.size(F.split(h, r"\.")).cast("double"),
        "depth": F.regexp_count(p, F.lit("/[^/]")).cast("double"),
        "digit_share": (n - left("[0-9]")) / n, "mark_share": (n - left("[^A-Za-z0-9]")) / n, "entropy": _entropy(u),
        "parameters": F.regexp_count(u, F.lit("[?&][^&=#]*=")).cast("double"),
        "longest_digits": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(u, F.lit("([0-9]+)"), F.lit(1)),
                                                             lambda d: F.length(d))), F.lit(0)).cast("double"),
        "suffix": suffix(h)})


@dataclass
class Model:
    trees: PipelineModel | None   # None: one kind of label only
    suffixes: DataFrame           # suffix, suffix_share, suffix_blocked; at most as many rows as the sample
    blocked: float                # share of blocked URLs in the sample

    def score(self, pages: DataFrame) -> DataFrame:
        """Adds score, the model's probability of block."""
        if self.trees is None:
            return pages.withColumn("score", F.lit(self.blocked))
        known = pages.join(F.broadcast(self.suffixes), "suffix", "left").fillna(
            {"suffix_share": 0.0, "suffix_blocked": self.blocked})
        return self.trees.transform(known).withColumn("score", vector_to_array("probability")[1])


def learn(labelled: DataFrame, max_labelled: int = 10_000, trees: int = 20, depth: int = 4, seed: int = 7) -> Model:
    """Model from url and blocked (0 or 1), of which at most ``max_labelled`` distinct ones; a null label is left out."""
    rows = labelled.select("url", F.col("blocked").cast("double").alias("label")).where("label IS NOT NULL").distinct()
    sample = written(rows.orderBy(F.xxhash64("url"), "url", "label").limit(max_labelled), "labelled-urls")
    sample = lexical(sample.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})).persist()
    found = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked")).first()
    n, blocked = found["n"], float(found["blocked"] or 0)
    share = blocked / n if n else 0.0
    suffixes = (sample.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("b"))
                .select("suffix", (F.col("n") / max(1, n)).alias("suffix_share"),
                        ((F.col("b") + 20 * share) / (F.col("n") + 20)).alias("suffix_blocked"))).persist()
    fitted = None
    if 0 < blocked < n:
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed)
        # both labels weigh the same: their shares among labelled URLs say nothing about the others
        weight = F.when(F.col("label") > 0, 0.5 * n / blocked).otherwise(0.5 * n / (n - blocked))
        train = assembler.transform(sample.join(F.broadcast(suffixes), "suffix", "left").withColumn("weight", weight))
        fitted = PipelineModel([assembler, gbt.fit(train)])
    sample.unpersist()
    return Model(fitted, suffixes, share)


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, **settings) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every URL.

    ``labelled`` (url, blocked) teaches the trees; by default the URLs that a rule decides do.
    """
    url = F.col("url").cast("string")
    ruled = with_rule(pages.select("page_id", url.alias("url")).withColumns({"host": host(url), "path": path(url)}), rules)
    if labelled is None:
        labelled = ruled.where("rule IS NOT NULL").select("url", (F.col("rule_verdict") == "block").cast("int").alias("blocked"))
    model = learn(labelled, **settings)
    scored = model.score(lexical(ruled))
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "score")
