"""Parsers as table functions over DataFrames: one text row in, one facts row out."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..parsers import CONFIGS, LANGUAGES, patch
from ..parsers.config import application
from ..parsers.java import App
from . import files


def app_config(workspace: str, root: str | None = None) -> dict[str, App]:
    """Service roots (folders that have a ``start`` folder) and their application settings.

    A missing name is the folder's name; a file that can't be read says nothing.
    """
    out = {}
    for folder, folders, _ in os.walk(workspace):
        if "start" in folders:
            path = os.path.join(folder, "start/src/main/resources/application.yml")
            try:
                with open(path, encoding="utf-8") as f:
                    name, context = application(f.read())
                out[folder] = App(name or os.path.basename(folder), context)
            except (OSError, ValueError):
                out[folder] = App()
        folders[:] = [d for d in folders if not d.startswith(".") and d not in files.SKIPPED]
    return out


def _app_of(path: str, apps: dict[str, App]) -> App:
    folder = os.path.dirname(path)
    while folder and folder != os.path.dirname(folder):
        if folder in apps:
            return apps[folder]
        folder = os.path.dirname(folder)
    return App()


def _arrays(rows: list[dict], schema):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))


def parsed(df: DataFrame, apps: dict[str, App] | None = None) -> DataFrame:
    """The facts of each (path, content) row; content null: the file is read where it is parsed.

    A file that can't be read or parsed has an error and no facts.
    """
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(schemas.PARSED)
    apps = apps or {}
    has_content = "content" in df.columns

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                row = {"file_path": r["path"], "language": files.language(r["path"]), "error": None, "classes": [], "methods": [], "imports": []}
                try:
                    text = r.get("content") if has_content else None
                    if text is None:
                        with open(r["path"], encoding="utf-8", newline="") as f:
                            text = f.read()
                    row |= LANGUAGES[files.extension(r["path"])][1](text, r["path"], _app_of(r["path"], apps))
                except (OSError, ValueError, KeyError) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield _arrays(rows, schema)

    return df.mapInArrow(run, schema)


def configured(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(config_items, issues) of (path, content) rows of XML and YAML files."""
    from pyspark.sql.types import StructType

    ddl = "file_path string, error string, items array<struct<kind:string,http_method:string,value:string>>"
    schema = StructType.fromDDL(ddl)
    has_content = "content" in df.columns

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                row = {"file_path": r["path"], "error": None, "items": []}
                try:
                    text = r.get("content") if has_content else None
                    if text is None:
                        with open(r["path"], encoding="utf-8") as f:
                            text = f.read()
                    found = CONFIGS[files.extension(r["path"])](text)
                    row["items"] = [dict(zip(("kind", "http_method", "value"), x, strict=True)) for x in found]
                except (OSError, ValueError, KeyError) as e:
                    row["error"] = str(e)
                rows.append(row)
            yield _arrays(rows, schema)

    out = df.mapInArrow(run, schema)
    items = out.select("file_path", F.explode("items").alias("i")).select("file_path", "i.kind", "i.http_method", "i.value")
    issues = out.where("error IS NOT NULL").select(
        F.lit("warning").alias("severity"), F.concat_ws(": ", F.lit("configuration"), "file_path", "error").alias("message")
    )
    return items.distinct(), issues


def patches(df: DataFrame, prefix: bool = True, compat: bool = False) -> DataFrame:
    """Changed files of (path, content) rows of patch files, one row for each file of a patch.

    Columns: project (the patch's stem), file_path (below the project's folder, if
    ``prefix``), change_type, hunks, error (set where a patch can't be read).
    """
    from pyspark.sql.types import StructType

    hunk = "array<struct<old_start:int,old_lines:int,new_start:int,new_lines:int,lines:array<struct<line_type:string,content:string>>>>"
    schema = StructType.fromDDL(f"project string, file_path string, change_type string, hunks {hunk}, error string")

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                project = os.path.splitext(os.path.basename(r["path"]))[0]
                try:
                    if r["content"] is None:
                        raise ValueError("not UTF-8")
                    for c in patch.parse(r["content"], compat):
                        path = f"{project}/{c['file_path']}" if prefix else c["file_path"]
                        rows.append({"project": project, "error": None} | c | {"file_path": path})
                except ValueError as e:
                    rows.append({"project": project, "file_path": None, "change_type": None, "hunks": [], "error": f"{r['path']}: {e}"})
            if rows:
                yield _arrays(rows, schema)

    return df.mapInArrow(run, schema)


def patch_texts(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """(path, content) of a patch file, or of a folder's ``.patch`` files, and whether to prefix.

    A folder isn't searched below; a single file keeps its paths as they are.
    """
    local = path.removeprefix("file://")
    if os.path.isfile(local):
        return files.scan(spark, path), False
    if os.path.isdir(local):
        names = sorted(n for n in os.listdir(local) if files.extension(n) == "patch" and os.path.isfile(os.path.join(local, n)))
        if not names:
            return spark.createDataFrame([], "path string, content string"), True
        df = spark.read.format("binaryFile").load([os.path.join(local, n) for n in names])
    else:
        df = spark.read.format("binaryFile").option("pathGlobFilter", "*.patch").load(path)
    text = F.when(F.is_valid_utf8(F.col("content")), F.col("content").cast("string"))
    return df.select("path", text.alias("content")), True


def hunks(changes: DataFrame) -> DataFrame:
    """One row for each hunk."""
    each = changes.where("error IS NULL").select("project", "file_path", "change_type", F.posexplode("hunks").alias("hunk_idx", "h"))
    return each.select("project", "file_path", "change_type", "hunk_idx", "h.old_start", "h.old_lines", "h.new_start", "h.new_lines")


def hunk_lines(changes: DataFrame) -> DataFrame:
    """One row for each line of each hunk."""
    each = changes.where("error IS NULL").select("file_path", F.posexplode("hunks").alias("hunk_idx", "h"))
    lines = each.select("file_path", "hunk_idx", F.posexplode("h.lines").alias("pos", "l"))
    return lines.select("file_path", "hunk_idx", "pos", "l.line_type", "l.content")
