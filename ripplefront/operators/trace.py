"""Impact tracing: a label-correcting breadth-first search over (method, direction).

The state of a method in a direction is its smallest depth. A call adds one; crossing a
service starts again at zero, which may improve a state that is already known, so a state
is expanded again whenever its depth gets smaller. A state at the limit is a leaf. The
result doesn't depend on any order. Each round is equi-joins of the frontier, which
alone moves: calls and resources stay cached in partitions of its keys. Going up, a method is
looked up under its interfaces' names as well, so calls through interfaces are never listed
for each implementation, and callers are resolved and pruned where they are found. What a round finds, states and
crossed resources alike, is written once, to the checkpoint folder, and added to what is
known; now and then that is folded into one table. So a round survives lost executors, its
writes are in proportion to its frontier, and the plan doesn't grow.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..checkpoint import cut, drop_stored, stored
from . import cross, resolve
from .facts import Facts


#: Rounds after which what is known is folded into one table.
FOLD = 8


@dataclass
class TraceConfig:
    max_depth: int = 10
    upstream: bool = True
    downstream: bool = True
    cross_service: bool = True


@dataclass
class Steps:
    """What a method leads to."""

    facts: Facts
    down: DataFrame
    #: (fqn, resource, acts): a method's own resources, and whether it feeds or is fed by them.
    touched: DataFrame | None
    #: (resource, acts, dst): who is met beyond a resource by those that feed it, or are fed by it.
    beyond: DataFrame | None

    @cached_property
    def up(self) -> DataFrame:
        """(src, dst), each call through an interface for every implementation: for edges, not for the search."""
        return resolve.upstream_steps(self.facts.calls, self.facts.implements, self.facts.methods)


def steps(facts: Facts, config: TraceConfig, extra_consumers: DataFrame | None = None) -> Steps:
    down = resolve.downstream_steps(facts.calls, facts.implements, facts.methods)
    if not config.cross_service:
        return Steps(facts, down, None, None)
    active, passive = cross.resources(facts, extra_consumers)
    known = facts.methods.select("fqn").distinct()
    providing = passive.select("resource", "fqn").unionByName(cross.all_providers(facts)).distinct()
    own = active.where("own").select("resource", "fqn", F.lit(True).alias("acts")).unionByName(providing.withColumn("acts", F.lit(False)))
    touched = own.join(known, "fqn", "left_semi")
    met = lambda df, acts: df.select("resource", F.lit(acts).alias("acts"), F.col("fqn").alias("dst"))
    return Steps(facts, down, touched, met(passive, True).unionByName(met(active, False)))


def reach(spark: SparkSession, seeds: DataFrame, s: Steps, config: TraceConfig, max_rounds: int = 10_000) -> DataFrame:
    """(fqn, dir, depth): the smallest depth at which each method is reached in each direction.

    Services are crossed by way of the resource, and each resource once from either side, as
    what lies beyond it is entered at depth 0 whoever comes: the work is in proportion to
    the methods that touch resources, not to the pairs that share one.
    """
    dirs = [d for d, on in (("Up", config.upstream), ("Down", config.downstream)) if on]
    start = seeds.select("fqn").distinct()
    if not dirs:
        return start.select("fqn", F.lit("Up").alias("dir"), F.lit(0).alias("depth")).limit(0)
    frontier = cut(start.select("fqn", F.explode(F.array(*map(F.lit, dirs))).alias("dir"), F.lit(0).alias("depth")))
    tables: list[DataFrame] = []
    cached: list[DataFrame] = []

    def kept(df: DataFrame, *keys: str, table: bool = True) -> DataFrame:
        """Cached in partitions of its keys; lost parts are read again from the table, or made again from what is cached."""
        if table:
            tables.append(df := stored(df))
        cached.append(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).persist())
        return cached[-1]

    names = kept(resolve.known_names(s.facts.implements, s.facts.methods), "name")
    calls = kept(s.facts.calls.select("caller", "callee"), "callee")
    if config.downstream:
        resolved = calls.join(names, F.col("callee") == F.col("name")).select(F.col("caller").alias("src"), F.col("fqn").alias("dst"))
        down = kept(resolved.distinct(), "src", table=False)
    if config.upstream:
        typed = s.facts.implements.where("class IS NOT NULL AND iface IS NOT NULL").select("class", "iface").distinct()
        typed = kept(typed, "class")
    crossing = s.touched is not None
    if crossing:
        touched, beyond = kept(s.touched, "fqn"), kept(s.beyond, "resource", "acts")
        crossed = frontier.select(F.col("fqn").alias("resource"), F.lit(True).alias("acts")).limit(0)
    known, rounds = frontier, 0
    while not frontier.isEmpty():
        if rounds == max_rounds:
            raise RuntimeError(f"the trace did not end in {max_rounds} rounds")
        rounds += 1
        open_ = frontier.where(F.col("depth") < config.max_depth).withColumnRenamed("fqn", "src")
        moves = []
        if config.downstream:
            moves.append(open_.where("dir = 'Down'").join(down, "src").select(F.col("dst").alias("fqn"), "dir", (F.col("depth") + 1).alias("depth")))
        if config.upstream:
            moves.append(_callers(open_.where("dir = 'Up'"), typed, calls, names))
        found = moves[0] if len(moves) == 1 else moves[0].unionByName(moves[1])
        if crossing:
            here = open_.select(F.col("src").alias("fqn")).distinct().join(touched, "fqn").select("resource", "acts").distinct()
            new = here.join(crossed, ["resource", "acts"], "left_anti")
            there = new.join(beyond, ["resource", "acts"]).select(F.col("dst").alias("fqn"), _way("acts", "Down", "Up").alias("dir"))
            found = found.unionByName(there.distinct().withColumn("depth", F.lit(0)))
        least = found.groupBy("fqn", "dir").agg(F.min("depth").alias("depth"))
        old = known.select(F.col("fqn").alias("f"), F.col("dir").alias("d"), F.col("depth").alias("old"))
        same = (F.col("fqn") == F.col("f")) & (F.col("dir") == F.col("d")) & (F.col("old") <= F.col("depth"))
        better = least.join(old, same, "left_anti")
        if crossing:  # resources crossed, beside the states
            better = better.unionByName(new.select(F.col("resource").alias("fqn"), _way("acts", "Down", "Up").alias("dir"), F.lit(-1).alias("depth")))
        step = cut(better)
        frontier = step.where("depth >= 0")
        known = known.unionByName(frontier)
        if crossing:
            crossed = crossed.unionByName(step.where("depth < 0").select(F.col("fqn").alias("resource"), (F.col("dir") == "Down").alias("acts")))
        if rounds % FOLD == 0:
            known = cut(_least(known))
            crossed = cut(crossed) if crossing else None
    out = cut(_least(known))
    for df in cached:
        df.unpersist()
    for df in tables:
        drop_stored(df)
    return out


def _callers(open_: DataFrame, typed: DataFrame, calls: DataFrame, names: DataFrame) -> DataFrame:
    """(fqn, dir, depth): who calls these methods (src, depth), by their own name or an interface's."""
    least = F.min("depth").alias("depth")
    halves = open_.withColumn("class", fn.split_class(F.col("src"))).join(typed, "class")
    through = halves.select(F.concat_ws("::", "iface", fn.split_method(F.col("src"))).alias("callee"), "depth")
    called = open_.select(F.col("src").alias("callee"), "depth").unionByName(through).groupBy("callee").agg(least)
    found = called.join(calls, "callee").groupBy(F.col("caller").alias("name")).agg(least).join(names, "name")
    return found.select("fqn", F.lit("Up").alias("dir"), (F.col("depth") + 1).alias("depth"))


def _least(states: DataFrame) -> DataFrame:
    return states.groupBy("fqn", "dir").agg(F.min("depth").alias("depth"))


def _way(acts: str, down: str, up: str):
    return F.when(F.col(acts), F.lit(down)).otherwise(F.lit(up))


def edges(states: DataFrame, s: Steps, config: TraceConfig) -> DataFrame:
    """(src, dst, edge_type, direction) as node ids, each once."""
    open_ = states.where(F.col("depth") < config.max_depth).select("fqn", "dir")
    node = lambda c: F.concat_ws(":", F.lit("method"), c)
    call = F.lit("MethodCall").alias("edge_type")
    down = open_.where("dir = 'Down'").join(s.down, F.col("fqn") == F.col("src"))
    up = open_.where("dir = 'Up'").join(s.up, F.col("fqn") == F.col("src"))
    out = down.select(node("src").alias("src"), node("dst").alias("dst"), call, F.lit("Downstream").alias("direction")).unionByName(
        up.select(node("dst").alias("src"), node("src").alias("dst"), call, F.lit("Upstream").alias("direction"))
    )
    if s.touched is not None:
        reached = open_.select("fqn").distinct()
        own = s.touched.join(reached, "fqn", "left_semi")
        peers = own.select("resource", "acts").distinct().join(s.beyond, ["resource", "acts"])
        kind = cross.edge_type(F.col("resource")).alias("edge_type")
        way = _way("acts", "Downstream", "Upstream").alias("direction")
        acts = F.col("acts")
        out = out.unionByName(
            own.select(F.when(acts, node("fqn")).otherwise(F.col("resource")).alias("src"),
                       F.when(acts, F.col("resource")).otherwise(node("fqn")).alias("dst"), kind, way)
        ).unionByName(
            peers.select(F.when(acts, F.col("resource")).otherwise(node("dst")).alias("src"),
                         F.when(acts, node("dst")).otherwise(F.col("resource")).alias("dst"), kind, way)
        )
    return out.distinct()


def trace(spark: SparkSession, facts: Facts, seeds: DataFrame, config: TraceConfig | None = None, extra_consumers: DataFrame | None = None):
    """(nodes, edges) of everything the seeds (fqn) impact or are impacted by."""
    from . import graph

    config = config or TraceConfig()
    s = steps(facts, config, extra_consumers)
    states = reach(spark, seeds, s, config)
    found = cut(edges(states, s, config))
    ends = found.select(F.col("src").alias("id")).unionByName(found.select(F.col("dst").alias("id")))
    ids = ends.unionByName(seeds.select(F.concat_ws(":", F.lit("method"), "fqn").alias("id"))).distinct()
    return graph.nodes_of(ids), found
