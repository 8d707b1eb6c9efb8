"""The analysis of a set of patches against a workspace."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import associate, graph, seeds
from ..operators import facts as fx
from ..operators.trace import TraceConfig, trace
from ..sources import files, store, tables


class AnalysisError(Exception):
    """Input that an analysis can't start from."""


@dataclass
class Result:
    nodes: DataFrame
    edges: DataFrame
    seeds: DataFrame
    statistics: DataFrame
    issues: DataFrame

    def output(self, form: str) -> str:
        makers = {"json": graph.to_json, "dot": graph.to_dot, "mermaid": graph.to_mermaid}
        if form not in makers:
            raise AnalysisError(f"unknown output {form}")
        return makers[form](self.nodes, self.edges)


def index(spark: SparkSession, workspace: str, rebuild: bool = False) -> tuple[fx.Facts, DataFrame]:
    """(facts, issues) of a workspace, from the stored index where that is up to date."""
    none = spark.createDataFrame([], schemas.ISSUES)
    if not rebuild and (found := store.load(spark, workspace)) is not None:
        return found, none
    sources = list(files.walk(workspace, files.SOURCES))
    configs = list(files.walk(workspace, files.CONFIGURATION))
    if not sources:
        return fx.empty(spark), none
    parsed = tables.parsed(files.listing(spark, sources), tables.app_config(workspace)).persist()
    items, issues = tables.configured(files.listing(spark, configs)) if configs else (spark.createDataFrame([], schemas.CONFIG_ITEMS), none)
    bad = parsed.where("error IS NOT NULL").select(F.lit("warning").alias("severity"), F.concat_ws(": ", "file_path", "error").alias("message"))
    store.save(fx.from_parsed(parsed, items), workspace, len(sources))
    issues = spark.createDataFrame(bad.unionByName(issues).collect(), schemas.ISSUES)
    parsed.unpersist()
    return store.load(spark, workspace), issues


def changes(spark: SparkSession, path: str, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(changed files, issues) of a patch file or a folder of patches."""
    texts, prefix = tables.patch_texts(spark, path)
    found = tables.patches(texts, prefix, compat)
    issues = found.where("error IS NOT NULL").select(F.lit("warning").alias("severity"), F.concat(F.lit("patch "), "error").alias("message"))
    nothing = texts.agg((F.count(F.lit(1)) == 0).alias("none")).where("none").select(
        F.lit("warning").alias("severity"), F.lit(f"no patch in {path}").alias("message")
    )
    return found.where("error IS NULL"), issues.unionByName(nothing)


def analyze(
    spark: SparkSession, workspace: str, diff: str, config: TraceConfig | None = None, rebuild: bool = False, compat: bool = False
) -> Result:
    """What the patches touch, and what that impacts."""
    began = time.time()
    if not os.path.isdir(workspace):
        raise AnalysisError(f"no workspace at {workspace}")
    if not os.path.exists(diff):
        raise AnalysisError(f"no patch at {diff}")
    workspace = os.path.abspath(workspace)
    changed, issues = changes(spark, diff, compat)
    changed = changed.persist()
    facts, more = index(spark, workspace, rebuild)
    below = f"{workspace}/"
    methods = facts.methods.withColumn("file_path", F.regexp_replace("file_path", f"^{_quoted(below)}", ""))
    found = seeds.changed_methods(methods, tables.hunks(changed)).persist()
    present = [(p,) for r in changed.select("file_path").distinct().toLocalIterator() if os.path.exists(os.path.join(workspace, p := r["file_path"]))]
    lost = seeds.missing_files(changed, spark.createDataFrame(present, "file_path string"))
    extra = associate.http_consumers(facts.config_items, facts.calls) if facts.config_items is not None else None
    nodes, edges = trace(spark, facts, found, config, extra)
    issues = issues.unionByName(more).unionByName(
        lost.select(F.lit("warning").alias("severity"), F.concat(F.lit("no such file: "), "file_path").alias("message"))
    )
    return Result(nodes, edges, found, statistics(changed, issues, found, edges, began), issues)


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def statistics(changed: DataFrame, issues: DataFrame, found: DataFrame, edges: DataFrame, began: float) -> DataFrame:
    """One row of counts; what was parsed is never below zero."""
    rows = graph.row_counts(
        {"total_files": changed, "errors": issues.where("severity = 'error'"), "methods_changed": found, "traced_chains": edges}
    )
    return rows.select(
        "total_files", F.greatest(F.col("total_files") - F.col("errors"), F.lit(0)).alias("parsed_files"), "methods_changed", "traced_chains",
        F.lit(int((time.time() - began) * 1000)).cast("long").alias("duration_ms"),
    )
