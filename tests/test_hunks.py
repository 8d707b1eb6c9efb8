"""The hunks behind j01 are those of every lineitem row."""

import os

import pytest

from ripplefront.plans import queries as q
from ripplefront.plans.encodings import view

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def test_every_line_is_a_hunk(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").join(spark.read.parquet(f"{SF}/part.parquet").selectExpr("p_partkey AS l_partkey"), "l_partkey")
    assert view(spark, SF, "hunks").count() == lines.count()


def test_changed_methods_by_brute_force(spark):
    hunks = {(h.file_path, h.new_start, h.new_start + h.new_lines) for h in view(spark, SF, "hunks").collect()}
    methods = view(spark, SF, "methods").collect()
    want = {m.fqn for m in methods for f, a, b in hunks if m.file_path == f and m.line_start <= b and a <= m.line_end}
    got = [r["fqn"] for r in q.QUERIES["j01_changed_methods"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_no_method_meets_a_hunk_as_a_row(spark):
    from ripplefront.operators import seeds

    n = 30_000  # 9 x 10^8 pairs in one file; hunks in front of a method end before it, and one long one reaches a few
    methods = spark.range(n).selectExpr("concat('m', id) AS fqn", "'f' AS file_path", "int(id * 10) AS line_start", "int(id * 10 + 3) AS line_end")
    hunks = spark.range(n).selectExpr("'f' AS file_path", "int(id * 10 + 5) AS new_start", "int(if(id = 700, 20000, 2)) AS new_lines")
    found = seeds.changed_methods(methods, hunks)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["fqn"] for r in found.collect()} == {f"m{i}" for i in range(701, 2701)}


@pytest.mark.parametrize("seed", range(3))
def test_random_ranges_by_brute_force(spark, seed):
    import random

    from ripplefront.operators import seeds

    r = random.Random(seed)
    near = [r.choice((-5000, 0, 4090, 8190, 12_280, 2**31 - 9000)) for _ in range(80)]
    line = lambda c: None if r.random() < 0.05 else c + r.randrange(12)
    file = lambda: r.choice(("a", "b", None))
    methods = [(f"m{i % 70}", file(), line(x), line(x + r.choice((0, 5, 9000))) if x < 2**30 else line(x)) for i, x in enumerate(near)]
    hunks = [(file(), line(r.choice(near)), r.choice((0, 1, 3, 5000, -2, None))) for _ in range(12)]
    m = spark.createDataFrame(methods, "fqn string, file_path string, line_start int, line_end int")
    h = spark.createDataFrame(hunks, "file_path string, new_start int, new_lines int")
    want = {
        f for f, p, a, b in methods for q_, c, n in hunks
        if None not in (p, q_, a, b, c, n) and p == q_ and a <= c + n and b >= c
    }
    assert sorted(x["fqn"] for x in seeds.changed_methods(m, h).collect()) == sorted(want)
