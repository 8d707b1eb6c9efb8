"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, a: str, b: str, rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node each linked node reaches, itself included.

    Each round hangs a node's larger neighbours on its smallest one, then its smaller ones
    on the smallest. A node with very many links only ever folds them into a minimum, which
    Spark combines before the shuffle; no neighbour list is gathered. Rounds are written to
    the shared folder, what they shuffled is given back, and they end when a round changes
    nothing: then each node hangs directly on its component's smallest node. As stars form,
    one node may hold most links: the few such nodes are broadcast, so their links aren't
    sent to one task. Self links count as none; nulls are left out.
    """
    x, y = F.col(a), F.col(b)
    edges = links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    edges = common.stored(edges, "links")
    state = _state(edges)
    for _ in range(rounds):
        if state[0] == 0:
            break
        small = _small_star(_large_star(edges, state[0]), state[0])
        last, edges = edges, common.stored(small, "links")
        common.drop_stored(last)
        common.reclaim(links.sparkSession)
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return found.unionByName(roots).distinct()


def _state(edges: DataFrame) -> tuple:
    """How many links there are and an order-free sum over them: equal only at rest."""
    h = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), h).first())


def _met(rows: DataFrame, least: DataFrame, total: int, shares: int = 1000) -> DataFrame:
    """Rows joined with their node's ``m`` in ``least`` (node, m, n), n being its number of links.

    Nodes with over 1/``shares`` of all links number under 2 x ``shares``, whatever the input.
    """
    limit = max(1000, total // shares)
    if total <= limit:  # then no node has so many
        return rows.join(least.select("node", "m"), "node")
    hot = F.broadcast(least.where(F.col("n") > limit).select("node", "m"))
    usual = rows.join(hot.select("node"), "node", "left_anti").join(least.where(F.col("n") <= limit).select("node", "m"), "node")
    return usual.unionByName(rows.join(hot, "node"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours, hung on the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    least = least.select(F.col("u").alias("node"), F.least("u", "m").alias("m"), "n")
    rows = edges.select(F.col("v").alias("node"), F.col("u").alias("w"))
    return _met(rows, least, total).select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node's smaller neighbours and the node itself, hung on the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumnRenamed("u", "node")
    hung = _met(edges.withColumnRenamed("u", "node"), least, total).where("v != m")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct()
