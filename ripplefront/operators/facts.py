"""Fact tables of a workspace: one parsed table, and the views and lookups over it.

Where the same key may come twice and one row counts, the last in the order of
(file_path, line_start) does, whatever order the files were read in.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


@dataclass
class Facts:
    """The tables of FIXTURES: methods has a row for each name, calls a row for each call site."""

    methods: DataFrame
    calls: DataFrame
    http: DataFrame
    kafka: DataFrame
    db: DataFrame
    redis: DataFrame
    implements: DataFrame
    config_items: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}

    def persist(self) -> Facts:
        for df in self.tables().values():
            df.persist()
        return self


def empty(spark: SparkSession) -> Facts:
    make = lambda ddl: spark.createDataFrame([], ddl)
    names = "fqn string, name string, file_path string, line_start int, line_end int"
    return Facts(
        make(names), make(schemas.CALLS), make(schemas.HTTP_FACTS), make(schemas.KAFKA_FACTS), make(schemas.DB_FACTS),
        make(schemas.REDIS_FACTS), make(schemas.IMPLEMENTS), make(schemas.CONFIG_ITEMS),
    )


def last_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return kept.select(*keys, "r.*").select(*df.columns)


def exploded(parsed: DataFrame) -> DataFrame:
    """Every parsed method or function, equal names included."""
    return parsed.select("file_path", F.explode("methods").alias("m")).select(
        "m.fqn", "m.name", "file_path", "m.line_start", "m.line_end", "m.calls", "m.http", "m.kafka", "m.db", "m.redis"
    )


def from_parsed(parsed: DataFrame, config_items: DataFrame | None = None) -> Facts:
    """The tables of a parsed workspace (persist it: each table reads it)."""
    rows = exploded(parsed)
    order = [F.col("file_path"), F.col("line_start")]
    names = rows.select("fqn", "name", "file_path", "line_start", "line_end")
    each = lambda c: rows.select("fqn", F.explode(c).alias("x")).select("fqn", "x.*")
    calls = rows.select(F.col("fqn").alias("caller"), F.explode("calls").alias("c")).select(
        "caller", F.col("c.target").alias("callee"), "c.line"
    )
    classes = parsed.select(F.explode("classes").alias("c"))
    implements = classes.select(F.col("c.name").alias("class"), F.explode("c.implements").alias("iface"))
    http = last_by(rows.select("fqn", "file_path", "line_start", "http"), ["fqn"], order)
    http = http.where("http IS NOT NULL").select("fqn", "http.*")
    return Facts(last_by(names, ["fqn"], order), calls, http, each("kafka"), each("db"), each("redis"), implements, config_items)


# -- routing: who provides and consumes, produces and consumes, reads and writes


def http_consumers(http: DataFrame) -> DataFrame:
    """Feign methods, as (method, path, fqn)."""
    return http.where("is_feign_client").select("method", "path", "fqn")


def http_providers(http: DataFrame) -> DataFrame:
    """One method for each endpoint, the last by name, as (method, path, fqn)."""
    return http.where("NOT is_feign_client").groupBy("method", "path").agg(F.max("fqn").alias("fqn"))


def kafka_producers(kafka: DataFrame) -> DataFrame:
    return kafka.where("op = 'Produce'").select("topic", "fqn")


def kafka_consumers(kafka: DataFrame) -> DataFrame:
    return kafka.where("op = 'Consume'").select("topic", "fqn")


def db_readers(db: DataFrame) -> DataFrame:
    return db.where("op = 'Select'").select("table", "fqn")


def db_writers(db: DataFrame) -> DataFrame:
    return db.where("op IN ('Insert', 'Update', 'Delete')").select("table", "fqn")


def redis_readers(redis: DataFrame) -> DataFrame:
    return redis.where("op = 'Get'").select("key_pattern", "fqn")


def redis_writers(redis: DataFrame) -> DataFrame:
    return redis.where("op IN ('Set', 'Delete')").select("key_pattern", "fqn")


# -- lookups: a table of keys against a view, an equi-join each; duplicates are kept


def lookup(view: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return view.join(keys, on, "left_semi")


def find_method(methods: DataFrame, keys: DataFrame) -> DataFrame:
    return lookup(methods, keys, "fqn")


def find_callers(calls: DataFrame, keys: DataFrame) -> DataFrame:
    return lookup(calls, keys, "callee").select("callee", "caller")


def find_callees(calls: DataFrame, keys: DataFrame) -> DataFrame:
    return lookup(calls, keys, "caller").select("caller", "callee")


def find_interface_implementations(implements: DataFrame, keys: DataFrame) -> DataFrame:
    return lookup(implements, keys, "iface").select("iface", "class")


def find_class_interfaces(implements: DataFrame, keys: DataFrame) -> DataFrame:
    return lookup(implements, keys, "class").select("class", "iface")


def summary(facts: Facts) -> DataFrame:
    """How many different keys each view has, as (index_name, n)."""
    views = {
        "methods": (facts.methods, ["fqn"]), "method_calls": (facts.calls, ["caller"]), "reverse_calls": (facts.calls, ["callee"]),
        "http_providers": (http_providers(facts.http), ["method", "path"]), "http_consumers": (http_consumers(facts.http), ["method", "path"]),
        "kafka_producers": (kafka_producers(facts.kafka), ["topic"]), "kafka_consumers": (kafka_consumers(facts.kafka), ["topic"]),
        "db_writers": (db_writers(facts.db), ["table"]), "db_readers": (db_readers(facts.db), ["table"]),
        "redis_writers": (redis_writers(facts.redis), ["key_pattern"]), "redis_readers": (redis_readers(facts.redis), ["key_pattern"]),
        "interface_implementations": (facts.implements, ["iface"]), "class_interfaces": (facts.implements, ["class"]),
    }
    out = None
    for name, (df, keys) in views.items():
        part = df.select(F.struct(*keys).alias("k")).distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("index_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out
