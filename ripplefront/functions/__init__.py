"""Scalar functions as Spark columns, for facts that are computed in SQL rather than parsed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..parsers import patterns as p

U = "(?U)"  # Java's \w and \s are ASCII without it


def matches(text: Column, pattern: str) -> Column:
    """All first groups of a pattern in a text."""
    return F.regexp_extract_all(text, F.lit(U + pattern), F.lit(1))


def first_match(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, U + pattern, 1)
    return F.when(found != "", found)


def sql_operations(text: Column) -> Column:
    """An array of (op, table), in the order Select, Insert, Update, Delete."""
    kinds = (("Select", p.SELECT), ("Insert", p.INSERT), ("Update", p.UPDATE), ("Delete", p.DELETE))

    def named(op: str):
        return lambda t: F.struct(F.lit(op).alias("op"), t.alias("table"))

    return F.concat(*[F.transform(matches(text, x), named(op)) for op, x in kinds])


def split_class(target: Column) -> Column:
    """What stands before the last ``::``, or null."""
    return F.when(target.contains("::"), F.regexp_extract(target, r"(?s)^(.*)::", 1))


def split_method(target: Column) -> Column:
    """What stands after the last ``::``, or the whole."""
    return F.substring_index(target, "::", -1)


def endpoint_path(value: Column) -> Column:
    """A URL's path, or a text that starts with a slash, without its query; else null."""
    url = F.regexp_extract(value, r"^https?://[^/]*(/[^?]*)", 1)
    return F.when(url != "", url).when(value.startswith("/"), F.substring_index(value, "?", 1))


def path_matches(pattern: Column, target: Column) -> Column:
    """Whether every segment of a path that isn't a parameter occurs in a target, in any case."""
    named = F.filter(F.split(pattern, "/"), lambda s: (s != "") & ~(s.startswith("{") & s.endswith("}")))
    return F.forall(named, lambda s: F.contains(F.lower(target), F.lower(s)))


def redis_key_matches(pattern: Column, key: Column) -> Column:
    """Equal, or the one with a star is, up to its trailing stars, a prefix of the other."""
    star = F.lit("*")
    return (
        F.when(pattern == key, True)
        .when(pattern.contains("*"), F.startswith(key, F.rtrim(pattern, star)))
        .when(key.contains("*"), F.startswith(pattern, F.rtrim(key, star)))
        .otherwise(False)
    )


def is_http_client(target: Column) -> Column:
    return F.lower(target).rlike("|".join(p.HTTP_CLIENTS))


def request_method(args: Column) -> Column:
    """The first of the fixed methods that a mapping's arguments name, else GET."""
    out = F.lit("GET")
    for m in reversed(p.HTTP_METHODS):
        out = F.when(args.contains(f"RequestMethod.{m}"), F.lit(m)).otherwise(out)
    return out


def joined_path(*parts: Column) -> Column:
    """Parts joined by one slash each; see the parsers' function of this name."""
    out = F.lit("")
    for part in parts:
        bare = F.regexp_replace(F.coalesce(part, F.lit("")), "^/+", "")
        glue = F.when((out == "") | out.endswith("/"), F.lit("")).otherwise(F.lit("/"))
        out = F.when(bare == "", out).otherwise(F.concat(out, glue, bare))
    return out


def config_key(kind: str, *parts: Column) -> Column:
    """http:METHOD:path, kafka:topic:T, db:table:T or redis:key:K."""
    middle = {"http": [], "kafka": [F.lit("topic")], "db": [F.lit("table")], "redis": [F.lit("key")]}[kind]
    return F.concat_ws(":", F.lit(kind), *middle, *parts)


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether two ranges, ends included, meet."""
    return (start <= other_end) & (end >= other_start)


def strip_side(path: Column) -> Column:
    return F.regexp_replace(path, "^[ab]/", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def language(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext == "java", "java").when(ext == "rs", "rust")


def same_major(a: Column, b: Column) -> Column:
    return F.substring_index(a, ".", 1) == F.substring_index(b, ".", 1)


def since_epoch(seconds: Column) -> Column:
    """``N days, HH:MM:SS``."""
    s = seconds.cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(s / 3600) % 24), two(F.floor(s / 60) % 60), two(s % 60))
    return F.concat(F.floor(s / 86400).cast("string"), F.lit(" days, "), clock)
