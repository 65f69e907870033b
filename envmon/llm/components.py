"""Connected components of a link table by repeated contraction, as joins and aggregates.

In each round every node moves to the neighbour (or itself) with the smallest
random priority; the links are mapped onto the chosen nodes, loops and repeats
go.  Priorities change per round, so the number of nodes that still have links
shrinks by a constant factor whatever the ids look like (a long chain in id
order would defeat plain minimum propagation).  Rounds are written to the
shared folder: lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node that has a link.

    ``links``: columns a, b (long), any order, repeats and loops allowed, nulls ignored.
    Returns node, root; equal root means the same component.  The root is some
    node of the component: take the minimum of whatever id you want over it.
    """
    edges = (links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    edges = written(edges, "cc-links")
    moves = []
    for r in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the best neighbour, then the node itself; summed up per task before the shuffle
        rank = lambda c: F.xxhash64(F.col(c), F.lit(r))
        chosen = (both.groupBy("a").agg(F.min(rank("b")).alias("p"), F.min_by("b", rank("b")).alias("b"))
                  .select(F.col("a").alias("node"),
                          F.when(F.col("p") < rank("a"), F.col("b")).otherwise(F.col("a")).alias("to")))
        chosen = written(chosen, f"cc-move{r}")
        moves.append(chosen)
        edges = (edges.join(chosen.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
                 .join(chosen.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
                 .where("ta <> tb")
                 .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        edges = written(edges, f"cc-links{r}")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not moves:
        return links.select(F.col("a").cast("long").alias("node"), F.col("a").cast("long").alias("root")).limit(0)

    def follow(later: DataFrame, earlier: DataFrame) -> DataFrame:
        step = later.select(F.col("node").alias("to"), "root")
        return (earlier.join(step, "to", "left")
                .select("node", F.coalesce("root", "to").alias("root")))

    last = moves[-1].select("node", F.col("to").alias("root"))
    return reduce(follow, reversed(moves[:-1]), last)
