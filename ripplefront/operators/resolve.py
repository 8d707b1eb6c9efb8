"""Interface resolution and the pruning of calls to what is in the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..checkpoint import reclaim, stored
from . import cross


def single_implementations(implements: DataFrame) -> DataFrame:
    """(iface, impl) of interfaces with exactly one implementing row; repeated rows count."""
    return implements.groupBy("iface").agg(F.count(F.lit(1)).alias("n"), F.first("class").alias("impl")).where("n = 1").drop("n")


def resolved(df: DataFrame, target: str, implements: DataFrame) -> DataFrame:
    """``target`` rewritten to the only implementation's method where its class is such an interface."""
    single = single_implementations(implements).withColumnRenamed("iface", "_iface")
    joined = df.withColumn("_class", fn.split_class(F.col(target))).join(single, F.col("_class") == F.col("_iface"), "left")
    new = F.when(F.col("impl").isNotNull(), F.concat_ws("::", "impl", fn.split_method(F.col(target)))).otherwise(F.col(target))
    return joined.withColumn(target, new).drop("_class", "_iface", "impl")


def known(df: DataFrame, column: str, methods: DataFrame) -> DataFrame:
    """Rows whose method is in the index; calls into libraries go."""
    names = methods.select(F.col("fqn").alias(column)).distinct()
    return df.join(names, column, "left_semi")


def known_names(implements: DataFrame, methods: DataFrame) -> DataFrame:
    """(name, fqn): each name that resolves to a method in the index, once, with that method.

    What ``resolved`` and ``known`` leave of a column is an equi-join with this on the name.
    """
    single = single_implementations(implements).where("iface IS NOT NULL AND impl IS NOT NULL")
    m = methods.select("fqn").distinct().withColumn("_class", fn.split_class(F.col("fqn")))
    own = m.join(single, F.col("_class") == F.col("iface"), "left_anti").select(F.col("fqn").alias("name"), "fqn")
    by_interface = m.join(single, F.col("_class") == F.col("impl"))
    return own.unionByName(by_interface.select(F.concat_ws("::", "iface", fn.split_method(F.col("fqn"))).alias("name"), "fqn"))


def through_interfaces(calls: DataFrame, implements: DataFrame) -> DataFrame:
    """(caller, callee): calls of an interface's method as calls of each implementation's.

    Any number of implementations counts here, each of an interface's names for itself.
    """
    typed = calls.select("caller", F.col("callee").alias("_target")).withColumn("iface", fn.split_class(F.col("_target")))
    found = typed.where("iface IS NOT NULL").join(implements, "iface")
    return found.select("caller", F.concat_ws("::", "class", fn.split_method(F.col("_target"))).alias("callee"))


def downstream_steps(calls: DataFrame, implements: DataFrame, methods: DataFrame) -> DataFrame:
    """(src, dst): caller to callee, the callee resolved and in the index."""
    found = known(resolved(calls.select("caller", "callee").distinct(), "callee", implements), "callee", methods)
    return found.select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()


def upstream_steps(calls: DataFrame, implements: DataFrame, methods: DataFrame) -> DataFrame:
    """(src, dst): callee to caller, direct or through interfaces, the caller resolved and known.

    Calls through interfaces may be many times the calls, so they are made of calls that are
    distinct already and are never shuffled: through a class's only interface they come once
    each, as callers and implementations of what is called, which meet by blocks. Only those of
    classes with several interfaces are made distinct, and only direct calls of implementing
    classes are compared with the calls of their interface. What made the calls distinct leaves
    the disks before the blocks come to them.
    """
    names = stored(known_names(implements, methods).withColumnRenamed("name", "caller"))
    # in partitions of the caller calls meet its name and become distinct, in one shuffle
    n = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    called_by = calls.select("caller", "callee").where("caller IS NOT NULL").repartition(n, "caller").distinct()
    pairs = called_by.join(names.hint("shuffle_hash"), "caller").select(F.col("fqn").alias("caller"), "callee")
    if not names.groupBy("fqn").count().where("count > 1").isEmpty():  # methods with a name under an interface too
        pairs = pairs.distinct()
    pairs = stored(pairs)
    callees = stored(pairs.select("callee").distinct())
    each = implements.where("iface IS NOT NULL").select("class", "iface").distinct()
    one = each.where("class IS NOT NULL").groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.first("iface").alias("iface")).where("n = 1").drop("n")
    many = each.join(one, ["class", "iface"], "left_anti")
    rest = pairs
    if not many.isEmpty():
        rest = rest.unionByName(through_interfaces(pairs, many)).distinct()
    called = callees.select(fn.split_class(F.col("callee")).alias("class")).distinct()
    if not called.join(one, "class", "left_semi").isEmpty():
        iface = rest.withColumn("class", fn.split_class(F.col("callee"))).join(one, "class", "left")
        twin = F.when(F.col("iface").isNotNull(), F.concat_ws("::", "iface", fn.split_method(F.col("callee"))))
        rest = iface.select("caller", "callee", twin.alias("twin")).join(pairs.withColumnRenamed("callee", "twin"), ["caller", "twin"], "left_anti")
    reclaim(calls.sparkSession)  # not sooner: Spark's listeners hold the plan of the last query until the next
    made = through_interfaces(callees.select(F.col("callee").alias("caller"), "callee"), one).select(F.col("caller").alias("resource"), F.col("callee").alias("fqn"))
    callers = pairs.select(F.col("callee").alias("resource"), F.col("caller").alias("fqn"))
    # the few implementations come over and over, each caller in one go: the other way round takes more bytes
    met = cross.pairs(callers, made).select(F.col("target").alias("src"), F.col("source").alias("dst"))
    return rest.select(F.col("callee").alias("src"), F.col("caller").alias("dst")).unionByName(met)
