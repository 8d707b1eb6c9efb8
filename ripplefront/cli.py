"""Command line: ``python -m ripplefront.cli -w WORKSPACE -d PATCHES``."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from .operators.trace import TraceConfig
from .plans.analysis import AnalysisError, analyze
from .sources import store

LEVELS = {"trace": 5, "debug": 10, "info": 20, "warn": 30, "error": 40}


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="ripplefront", description="What do these patches impact?")
    p.add_argument("-w", "--workspace", required=True)
    p.add_argument("-d", "--diff", required=True, help="a patch file, or a folder of .patch files")
    p.add_argument("-o", "--output", default="dot", choices=["dot", "json", "mermaid"])
    p.add_argument("-m", "--max-depth", type=int, default=10)
    p.add_argument("-l", "--log-level", default="info", choices=list(LEVELS))
    for flag in ("--rebuild-index", "--clear-index", "--index-info", "--verify-index"):
        p.add_argument(flag, action="store_true")
    return p.parse_args(argv)


def about(workspace: str) -> str:
    m = store.info(workspace)
    if not m:
        return "no index"
    days, rest = divmod(m.updated_at, 86400)
    when = f"{days} days, {rest // 3600:02d}:{rest // 60 % 60:02d}:{rest % 60:02d}"
    return f"version {m.version}\nworkspace {m.workspace_path}\nfiles {m.file_count}\nmethods {m.method_count}\nupdated {when}\nchecksum {m.checksum}"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    logging.basicConfig(level=LEVELS[args.log_level], stream=sys.stderr)
    if args.clear_index:
        print("index removed" if store.clear(args.workspace) else "no index")
        return 0
    if args.index_info:
        print(about(args.workspace))
        return 0
    if args.verify_index:
        valid = store.is_valid(args.workspace)
        print("index is valid" if valid else "index is missing or out of date")
        return 0
    try:
        spark = spark or SparkSession.builder.appName("ripplefront").getOrCreate()
        result = analyze(spark, args.workspace, args.diff, TraceConfig(max_depth=args.max_depth), args.rebuild_index)
        for r in result.issues.toLocalIterator():
            logging.warning(r["message"])
        print(result.output(args.output))
    except (AnalysisError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
