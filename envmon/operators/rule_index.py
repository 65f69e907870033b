"""Many rules against many rows of means: a band index on the rules' bounds.

Every rule is one or more boxes (``functions.rules``).  Per measurement the bounds of all boxes,
sorted, cut the number line into bands: one for each bound itself and one for each gap
between two.  An interval is then a run of bands, and any run is made of a few aligned
blocks of 1, 2, 4, ... bands (at most two of each size); a mean lies in one band, and so
in one block of each size.  Rows and boxes meet in an equality join on (measurement, size, block):
each box is looked up by the one of its intervals that covers the fewest bands, the
others are checked on the rows found.  A row never meets a rule that this interval excludes.

The band of a mean is found by sorting means among the bounds into ranges (``_ranges``), so neither
bounds nor rules are collected or broadcast, and a mean that many rows share fills several ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._ranges import in_ranges, ranges_before, table

#: The name that boxes without an interval are looked up by; every row has it.
ANY = "*"


def _bands(points: DataFrame) -> DataFrame:
    """Points (name, value, kind 0 for a bound and 1 for a mean, ...) with their ``band`` among the name's distinct bounds.

    Bound number r (from 0) is band 2r + 1; the gaps around it are 2r and 2r + 2.
    """
    bound = F.when(F.col("kind") == 0, F.col("value"))
    sums = points.groupBy("name", "part").agg(F.count(bound).alias("n"), F.max(bound).alias("last"))
    sums = sums.select("name", "part", F.coalesce(F.sum("n").over(ranges_before("name")), F.lit(0)).alias("n_before"),
                       F.max("last").over(ranges_before("name")).alias("last_before"))
    up = Window.partitionBy("name", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = points.withColumns({"n_here": F.count(bound).over(up), "last_here": F.max(bound).over(up)}).join(sums, ["name", "part"])
    n, last = F.col("n_before") + F.col("n_here"), F.coalesce("last_here", "last_before")
    on = F.coalesce(last == F.col("value"), F.lit(False))
    return rows.withColumn("band", 2 * n - F.when(on, 1).otherwise(0)).drop("n_here", "last_here", "n_before", "last_before", "part", "at")


def _blocks(first: Column, last: Column, sizes: int) -> Column:
    """(size, block) of the aligned blocks of 2^size bands that make up the run first..last."""
    none = F.array().cast("array<struct<size:int,block:bigint>>")

    def step(acc: Column, size: Column) -> Column:
        a, b = acc["a"], acc["b"]
        take = lambda wanted, at: F.when(wanted, F.array(F.struct(size.alias("size"), at.alias("block")))).otherwise(none)
        odd, even = (a <= b) & (a % 2 == 1), (a <= b) & (b % 2 == 0)
        got = F.concat(acc["got"], take(odd, a), take(even, b))
        a, b = a + F.when(odd, 1).otherwise(0), b - F.when(even, 1).otherwise(0)
        rest = a <= b  # else nothing is left, for good
        return F.struct(F.when(rest, F.floor(a / 2)).otherwise(0).alias("a"), F.when(rest, F.floor(b / 2)).otherwise(-1).alias("b"),
                        got.alias("got"))

    start = F.struct(first.cast("bigint").alias("a"), last.cast("bigint").alias("b"), none.alias("got"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(sizes - 1)), start, step, lambda acc: acc["got"])


def _holds(box: Column, means: Column) -> Column:
    """Whether a row's means are in all intervals of a box and its comparisons hold; a missing mean is in none."""
    at = lambda name: F.try_element_at(means, name)

    def inside(b: Column) -> Column:
        x = at(b["name"])
        return F.coalesce((b["low"].isNull() | (x > b["low"]) | b["low_in"] & (x == b["low"]))
                          & (b["high"].isNull() | (x < b["high"]) | b["high_in"] & (x == b["high"])) & x.isNotNull(), F.lit(False))

    def compared(c: Column) -> Column:
        x, y, op = at(c["left"]), at(c["right"]), c["op"]
        return F.coalesce(F.when(op == "<", x < y).when(op == "<=", x <= y).when(op == ">", x > y).when(op == ">=", x >= y)
                          .when(op == "=", x == y).otherwise(x != y), F.lit(False))

    return F.forall(box["bounds"], inside) & F.forall(box["compared"], compared)


def rows_with_rules(rows: DataFrame, keys: list[str], names: list[str], rules: DataFrame, carry: list[str]) -> DataFrame:
    """(keys, carry) for every row and rule that holds there, each once per row of ``rules``.

    ``rows``: ``keys`` and the means ``names`` (doubles, null where there is none).  ``rules``: the columns ``carry``
    and ``boxes``.
    """
    boxes = table(rules.withColumn("rule", F.monotonically_increasing_id()).select(
        "rule", *carry, (F.size("boxes") > 1).alias("several"), F.explode("boxes").alias("box"))
        .withColumn("id", F.monotonically_increasing_id()), "rule-boxes")
    bounds = boxes.select("id", F.explode("box.bounds").alias("b")).select("id", "b.*")
    ends = bounds.select("name", F.col("low").alias("value")).union(bounds.select("name", "high")).where("value IS NOT NULL").distinct()
    most = ends.groupBy("name").count().agg(F.max("count")).first()[0] or 0  # one number
    sizes = (2 * most + 1).bit_length()

    rows = table(rows.select(*keys, *names), "rule-rows")  # read by the sample of the sort, by the sort and by the boxes without an interval
    # the means that some box looks at, among the bounds
    means = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.col, names)))
    long_ = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("m")
    asked = rows.select(*keys, means.alias("means"), long_).select(*keys, "means", "m.*").where("value IS NOT NULL")
    asked = asked.withColumn("value", F.col("value") + 0.0).join(ends.select("name").distinct(), "name", "left_semi")
    points = in_ranges(ends.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
                       .select("name", "value", "kind", *keys, "means"), "rule-points", "name", "value", "kind", *keys)
    banded = table(_bands(points), "rule-bands")

    # each box by its narrowest interval
    at = banded.where("kind = 0").select("name", "value", "band")
    last = ends.groupBy("name").agg((2 * F.count(F.lit(1))).alias("top"))
    runs = (bounds.join(at.select("name", F.col("value").alias("low"), F.col("band").alias("low_band")), ["name", "low"], "left")
            .join(at.select("name", F.col("value").alias("high"), F.col("band").alias("high_band")), ["name", "high"], "left")
            .join(last, "name", "left"))
    first = F.when(F.col("low").isNull(), 0).otherwise(F.col("low_band") + F.when(F.col("low_in"), 0).otherwise(1))
    final = F.when(F.col("high").isNull(), F.col("top")).otherwise(F.col("high_band") - F.when(F.col("high_in"), 0).otherwise(1))
    runs = runs.select("id", F.struct((final - first).alias("width"), "name", first.alias("first"), final.alias("last")).alias("run"))
    runs = runs.groupBy("id").agg(F.min("run").alias("run")).select("id", "run.*")
    index = boxes.join(runs, "id", "left").withColumn("blocks", F.when(
        F.col("name").isNotNull(), _blocks(F.col("first"), F.col("last"), sizes)).otherwise(
        F.array(F.struct(F.lit(0).alias("size"), F.lit(0).cast("bigint").alias("block")))))
    index = table(index.select(F.coalesce("name", F.lit(ANY)).alias("name"), F.explode("blocks").alias("at"), "rule", "several", "box", *carry)
                  .select("name", "at.*", "rule", "several", "box", *carry), "rule-index")

    used = index.groupBy("name").agg(F.array_sort(F.collect_set("size")).alias("sizes"))  # one row per measurement
    every = rows.select(*keys, means.alias("means"), F.lit(ANY).alias("name"), F.lit(0).cast("bigint").alias("band"))
    looked = (banded.where("kind = 1").select(*keys, "means", "name", F.col("band").cast("bigint").alias("band")).unionByName(every)
              .join(used, "name").select(*keys, "means", "name", "band", F.explode("sizes").alias("size"))
              .withColumn("block", F.call_function("shiftright", F.col("band"), F.col("size"))).drop("band"))
    met = looked.join(index, ["name", "size", "block"]).where(_holds(F.col("box"), F.col("means"))).select(*keys, "rule", "several", *carry)
    once = met.where("NOT several").unionByName(met.where("several").dropDuplicates([*keys, "rule"]))
    return once.select(*keys, *carry)
