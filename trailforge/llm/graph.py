"""Connected components by alternating large-star and small-star joins (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailforge.llm.common import written


def _least_of(pairs: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """Pairs (u, v) with the m of their u. A node with more than ``most`` pairs would put them all in
    one task: there are few of these (a share of the pairs' number), and theirs are looked up where they are."""
    least = written(least, "least")
    hubs = least.where(F.col("n") > most).select("u", "m")
    if not hubs.take(1):
        return pairs.join(least.drop("n"), "u")
    hubs = F.broadcast(hubs) if hubs.count() <= 100_000 else hubs
    return pairs.join(hubs, "u").unionByName(pairs.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= most).drop("n"), "u"))


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _least_of(both, least, most).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    """Every node's smaller neighbours, and the node, are linked with the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = _least_of(down, least, most)
    linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def components(edges: DataFrame, most: int = 200_000) -> DataFrame:
    """(u, v) links between integer ids -> (node, component), component the smallest id reachable.

    Each round is a pair of aggregations and joins, written to the shared folder; rounds grow
    with the logarithm of the longest path. Nodes without a link are not returned. Rows with a
    null end and loops are ignored. No edge list or label ever reaches the driver: it sees one
    count and one checksum a round. Nodes with more than ``most`` neighbours are joined apart.
    """
    edges = written(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 28)))).first())
        if now == mark or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
        mark, edges = now, written(_small_star(_large_star(edges, most), most), "links")
