"""Connected components of an edge list by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: neighbours (larger ones only, or not larger ones too) are linked to the least of the neighbourhood.

    The least neighbour is a map-side combined minimum, so the neighbours of a hot node are never in one row.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of edges (u, v); component is the least node of each.

    Self links keep their node. Null ends are ignored. No edges give no rows. Rounds grow with the logarithm
    of the longest chain; each is cut by a checkpoint. Ends when a round changes nothing.
    """
    e = edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL")
    nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct()
    now = cut(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    last = mark(now)
    for _ in range(max_rounds):
        now = cut(_star(_star(now, True), False))
        got = mark(now)
        if got == last:
            break
        last = got
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(now, nodes["node"] == now["u"], "left").select("node", F.coalesce("v", "node").alias("component"))
