"""Configuration values associated with the methods they concern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from . import facts as fx
from .facts import Facts

SCHEMA = ["config_key", "fqn"]


#: At most so many characters of a path's longest segment look its targets up.
PROBE = 3


def _named(path):
    return F.filter(F.split(F.lower(path), "/"), lambda s: (s != "") & ~(s.startswith("{") & s.endswith("}")))


def _probed(endpoints: DataFrame) -> DataFrame:
    """Endpoints with ``probe``: the start of their longest named segment, null if they have none."""
    longest = F.array_max(F.transform(_named("path"), lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))
    return endpoints.withColumn("_l", longest).select("method", "path", F.substring(F.col("_l.s"), 1, PROBE).alias("probe"))


def _grams(targets: DataFrame) -> DataFrame:
    """(callee, probe): each target with every run of up to PROBE characters in it, in lower case."""
    low, size = F.lower("callee"), F.length("callee")

    def runs(n: int):
        starts = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1)))
        return F.coalesce(F.transform(starts, lambda i: F.substring(low, i, F.lit(n))), F.array().cast("array<string>"))

    every = F.concat(*[runs(n) for n in range(1, PROBE + 1)])
    return targets.select("callee", F.explode(F.array_distinct(every)).alias("probe"))


def http_consumers(config_items: DataFrame, calls: DataFrame) -> DataFrame:
    """(method, path, fqn): methods with a client call whose target holds every path segment.

    Distinct targets of client calls meet an endpoint on the first characters of its longest
    segment, which they must hold; the whole test follows. Every method with a client call
    meets an endpoint without any named segment, such as ``/`` or ``/{id}``.
    """
    endpoints = config_items.where("kind = 'http'").select(F.col("http_method").alias("method"), F.col("value").alias("path")).distinct()
    clients = calls.where(fn.is_http_client(F.col("callee")))
    targets = clients.select("callee").distinct()
    probed, holds = _probed(endpoints), fn.path_matches(F.col("path"), F.col("callee"))
    hit = _grams(targets).join(probed.where("probe IS NOT NULL"), "probe").where(holds).select("method", "path", "callee").distinct()
    found = clients.join(hit, "callee").select("method", "path", F.col("caller").alias("fqn"))
    # all client methods times the few forms of a path without a name: that is the result itself
    free = probed.where("probe IS NULL").agg(F.collect_set(F.struct("method", "path")).alias("e"))
    callers = clients.select(F.col("caller").alias("fqn")).distinct()
    bare = callers.join(F.broadcast(free)).select("fqn", F.explode("e").alias("e")).select("e.method", "e.path", "fqn")
    return found.unionByName(bare).distinct()


def http(config_items: DataFrame, calls: DataFrame) -> DataFrame:
    found = http_consumers(config_items, calls)
    return found.select(fn.config_key("http", F.col("method"), F.col("path")).alias("config_key"), "fqn")


def topics(config_items: DataFrame, kafka: DataFrame) -> DataFrame:
    """Producers and consumers of a configured topic; a method that is both comes twice."""
    items = config_items.where("kind = 'kafka'").select(F.col("value").alias("topic")).distinct()
    both = fx.kafka_producers(kafka).unionAll(fx.kafka_consumers(kafka))
    return items.join(both, "topic").select(fn.config_key("kafka", F.col("topic")).alias("config_key"), "fqn")


def tables(config_items: DataFrame, db: DataFrame) -> DataFrame:
    """Readers and writers of a configured table, a row for each operation."""
    items = config_items.where("kind = 'db'").select(F.col("value").alias("table")).distinct()
    both = fx.db_readers(db).unionAll(fx.db_writers(db))
    return items.join(both, "table").select(fn.config_key("db", F.col("table")).alias("config_key"), "fqn")


def keys(config_items: DataFrame, redis: DataFrame) -> DataFrame:
    """Methods that touch a configured key: equal, or one's star covers the other; each once.

    Distinct patterns are compared, not operations. Pairs meet on equality, or on the
    prefix that a star leaves: each key is listed under its own prefixes only for lengths
    at which a starred pattern exists, so no pair is tried that doesn't match.
    """
    items = config_items.where("kind = 'redis'").select(F.col("value").alias("pattern")).distinct()
    known = redis.select(F.col("key_pattern").alias("key")).distinct()
    equal = items.join(known, F.col("pattern") == F.col("key"))
    star = F.lit("*")
    covers = _covered(items.where(F.contains("pattern", star)), "pattern", known, "key")
    back = items.where(~F.contains("pattern", star))
    covered = _covered(known.where(F.contains("key", star)), "key", back, "pattern")
    hit = equal.select("pattern", "key").unionByName(covers).unionByName(covered).distinct()
    found = hit.join(redis.select(F.col("key_pattern").alias("key"), "fqn"), "key")
    return found.select(fn.config_key("redis", F.col("pattern")).alias("config_key"), "fqn").distinct()


def _covered(starred: DataFrame, a: str, plain: DataFrame, b: str) -> DataFrame:
    """Pairs in which ``a`` without its trailing stars is a prefix of ``b``."""
    p = starred.withColumn("_p", F.rtrim(F.col(a), F.lit("*"))).withColumn("_n", F.length("_p"))
    lengths = p.select("_n").distinct()
    cut = plain.join(F.broadcast(lengths), F.length(b) >= F.col("_n")).withColumn("_p", F.expr(f"substring({b}, 1, _n)"))
    return p.join(cut.drop("_n"), "_p").select(a, b)


def associations(facts: Facts) -> DataFrame:
    """(config_key, fqn) over all kinds."""
    c = facts.config_items
    parts = [http(c, facts.calls), topics(c, facts.kafka), tables(c, facts.db), keys(c, facts.redis)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
