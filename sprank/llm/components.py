"""Connected components of a table of links, by alternating star contraction.

Each round is two group-and-join steps; links stay in the cluster and every
round is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprank.llm.common import written


def _to_smallest(links: DataFrame, up: bool) -> DataFrame:
    """Attach neighbours of each node to the smallest of them and the node itself.

    up: only neighbours above the node are re-attached (large star); else the
    node itself and its neighbours below it (small star).
    """
    if up:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node reachable from each linked node.

    Nodes must be of one ordered type. Nulls and self-links are ignored; an
    empty table gives an empty result. Raises if ``max_rounds`` do not settle
    it (the number of rounds grows with the logarithm of the longest chain).
    """
    now = written(links.where("a is not null and b is not null and a <> b")
                  .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        now = written(_to_smallest(_to_smallest(now, True), False), "stars")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
