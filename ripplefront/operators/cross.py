"""Crossing services: endpoints, topics, tables and keys that two methods share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoint import stored
from . import facts as fx
from .facts import Facts

#: Edge type by the prefix of the resource's node id.
EDGE_TYPES = {"http": "HttpCall", "kafka": "KafkaProduceConsume", "db": "DatabaseReadWrite", "redis": "RedisReadWrite"}
#: Methods in a block of a resource's, about; targets in a run of a block; sources that a run meets at a time.
BLOCK, RUN, FEW = 8192, 256, 64
#: Tasks that list pairs, one for each block's worth of names, at most.
PLACES = 20_000


def resources(facts: Facts, extra_consumers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(active, passive): who feeds a resource and who is fed by it, as (resource, fqn, own).

    A consumer of an endpoint acts on its provider, a producer on the consumers, a writer on
    the readers. ``own`` is false where configuration, not the method, says so: such a
    method is reached but never crosses over itself.
    """
    active, passive = sides(facts, extra_consumers)
    return active.distinct(), passive.distinct()


def sides(facts: Facts, extra_consumers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``resources`` as they come, a row for each fact."""
    ep = F.concat_ws(":", F.lit("http"), "method", "path")
    name = lambda kind, c: F.concat_ws(":", F.lit(kind), c)
    own = F.lit(True).alias("own")
    consumers = fx.http_consumers(facts.http).select(ep.alias("resource"), "fqn", own)
    if extra_consumers is not None:
        consumers = consumers.unionByName(extra_consumers.select(ep.alias("resource"), "fqn", F.lit(False).alias("own")))
    active = [
        consumers,
        fx.kafka_producers(facts.kafka).select(name("kafka", "topic").alias("resource"), "fqn", own),
        fx.db_writers(facts.db).select(name("db", "table").alias("resource"), "fqn", own),
        fx.redis_writers(facts.redis).select(name("redis", "key_pattern").alias("resource"), "fqn", own),
    ]
    passive = [
        fx.http_providers(facts.http).select(ep.alias("resource"), "fqn", own),
        fx.kafka_consumers(facts.kafka).select(name("kafka", "topic").alias("resource"), "fqn", own),
        fx.db_readers(facts.db).select(name("db", "table").alias("resource"), "fqn", own),
        fx.redis_readers(facts.redis).select(name("redis", "key_pattern").alias("resource"), "fqn", own),
    ]
    union = lambda parts: parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return union(active), union(passive)


def all_providers(facts: Facts) -> DataFrame:
    """(resource, fqn) of every method that provides an endpoint, not just the one that counts."""
    ep = F.concat_ws(":", F.lit("http"), "method", "path")
    return facts.http.where("NOT is_feign_client").select(ep.alias("resource"), "fqn").distinct()


def members(active: DataFrame, passive: DataFrame) -> DataFrame:
    """(resource, side, fqn) of every resource that both sides share: all pairs, unexpanded.

    Each source of a resource meets each of its targets. The rows are as many as methods that
    touch such a resource, however many share it; ``pairs`` expands them.
    """
    both = active.select("resource", "fqn", F.lit("source").alias("side")).unionByName(passive.select("resource", "fqn", F.lit("target").alias("side")))
    shared = both.groupBy("resource").agg(F.count_distinct("side").alias("n")).where("n = 2").select("resource")
    return both.join(shared, "resource", "left_semi").select("resource", "side", "fqn").distinct()


def pairs(active: DataFrame, passive: DataFrame) -> DataFrame:
    """(resource, source, target): the methods that share a resource, each pair once, however often a side names them.

    Blocks of methods meet, each pair of blocks in a place of its own, so that no resource is one
    task's. The rows of a pair of blocks come by runs of targets, a run once for each source: a
    column is one value again and again, or the same few hundred over and over, which files by
    columns store in a small part of the bytes. There are as many places as the names need: a file
    that has too many of them has no dictionary for them any more, and writes names out.
    """
    a, p = active.select("resource", "fqn"), passive.select("resource", "fqn")
    n = lambda side, c: side.groupBy("resource").agg((F.approx_count_distinct("fqn") + 1).alias(c))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK)
    # written out, as its size is known then: else the sides might be shuffled once more to meet it
    sizes = stored(n(a, "sources").join(n(p, "targets"), "resource"))
    names = sizes.agg(F.sum(blocks("sources").cast("double") * F.col("targets") + blocks("targets") * F.col("sources"))).first()[0] or 0
    places = max(int(active.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(PLACES, int(names / BLOCK) + 1))
    sizes = sizes.select("resource", *(blocks(c).alias(c) for c in ("sources", "targets")))
    # dealt out by number: by their bytes, which aren't the work, partitions would be put together
    keys = ["resource", "in_sources", "in_targets"]
    met = _blocks(a, sizes, "sources", "targets", FEW).repartition(places, *keys).join(_blocks(p, sizes, "targets", "sources", RUN), keys)
    # generated code keeps all rows that come of one row; a higher-order function isn't generated, so a few rows' worth goes there at a time
    parts = F.flatten(F.transform("targets", lambda t: F.transform("sources", lambda s: F.struct(s.alias("sources"), t.alias("targets")))))
    met = met.select("resource", F.explode(parts).alias("part"))
    met = met.select("resource", F.explode("part.sources").alias("source"), F.col("part.targets").alias("targets"))
    return met.select("resource", "source", F.explode("targets").alias("target"))


def _blocks(side: DataFrame, sizes: DataFrame, own: str, other: str, run: int) -> DataFrame:
    """(resource, in_sources, in_targets, own): a side's distinct methods in blocks of runs, each once for each block of the other side; nulls stay."""
    block = F.pmod(F.xxhash64("fqn"), F.col(own)).alias(f"in_{own}")
    fqns = [F.collect_set("fqn").alias("fqns"), F.bool_or(F.col("fqn").isNull()).alias("null")]
    blocks = side.join(sizes, "resource").groupBy("resource", block, other).agg(*fqns)
    # sorted, names that stand together start alike, and short runs are laid out alike: fewer bytes when they are shuffled
    fqns = F.sort_array(F.when(F.col("null"), F.concat("fqns", F.array(F.lit(None).cast("string")))).otherwise(F.col("fqns"))).alias("fqns")
    runs = F.transform(F.sequence(F.lit(1), F.size("fqns"), F.lit(run)), lambda i: F.slice("fqns", i, run))
    blocks = blocks.select("resource", f"in_{own}", other, fqns).select("resource", f"in_{own}", other, runs.alias(own))
    return blocks.select("resource", f"in_{own}", F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"in_{other}"), own)


def edge_type(resource):
    out = F.lit(None).cast("string")
    for prefix, kind in EDGE_TYPES.items():
        out = F.when(resource.startswith(f"{prefix}:"), F.lit(kind)).otherwise(out)
    return out
