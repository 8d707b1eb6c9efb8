"""From files on disk to a graph."""

import json
import os
import time

import pytest

from ripplefront import cli
from ripplefront.operators.trace import TraceConfig
from ripplefront.plans import analysis
from ripplefront.sources import files, store, tables

SERVICE = """package com.acme.a;
import com.acme.b.Repo;
public class Service {
  private Repo repo;
  public void act(String id) {
    repo.load(id);
    kafka.send("events", id);
  }
}
"""
REPO = """package com.acme.b;
public class RepoImpl implements Repo {
  public void load(String id) { q("SELECT a FROM users WHERE id = 1"); }
}
"""
IFACE = "package com.acme.b;\npublic interface Repo {\n  void load(String id);\n}\n"
LISTENER = """package com.acme.c;
public class Listener {
  @KafkaListener(topics = "events")
  public void on(String m) { web.RestTemplate(); }
}
"""
DIFF = "--- a/Service.java\n+++ b/Service.java\n@@ -5,2 +5,2 @@\n-  x\n+  public void act(String id) {\n     repo.load(id);\n"


@pytest.fixture
def workspace(tmp_path):
    w = tmp_path / "w"
    texts = {
        "svc/Service.java": SERVICE, "svc/b/RepoImpl.java": REPO, "svc/b/Repo.java": IFACE, "other/Listener.java": LISTENER,
        "svc/target/Skipped.java": SERVICE, "svc/.git/Hidden.java": SERVICE, "svc/bad.java": "class {{{", "svc/app.yml": "topic: events\n",
        "svc/broken.xml": "<a><b></a>", "svc/note.txt": "x", "tool/src/main.rs": 'fn main() { run(); }\nfn run() { redis.get("k"); }\n',
    }
    for name, text in texts.items():
        (w / name).parent.mkdir(parents=True, exist_ok=True)
        (w / name).write_text(text)
    (w / "svc/latin.java").write_bytes(b"class A { // \xff\n}")
    d = tmp_path / "patches"
    d.mkdir()
    (d / "svc.patch").write_text(DIFF)
    (d / "gone.patch").write_text(DIFF)
    (d / "noise.patch").write_text("no patch at all\n")
    (d / "readme.txt").write_text(DIFF)
    return str(w), str(d)


def test_walk_skips(workspace):
    names = [os.path.relpath(p, workspace[0]) for p in files.walk(workspace[0], files.SOURCES)]
    assert names == ["other/Listener.java", "svc/Service.java", "svc/b/Repo.java", "svc/b/RepoImpl.java", "svc/bad.java", "svc/latin.java", "tool/src/main.rs"] or sorted(names) == sorted(
        ["other/Listener.java", "svc/Service.java", "svc/b/Repo.java", "svc/b/RepoImpl.java", "svc/bad.java", "svc/latin.java", "tool/src/main.rs"]
    )


def test_spark_scan_reads_the_same(spark, workspace):
    got = files.scan(spark, f"file://{workspace[0]}", files.SOURCES).collect()
    assert sorted(os.path.basename(r["path"]) for r in got) == ["Listener.java", "Repo.java", "RepoImpl.java", "Service.java", "bad.java", "latin.java", "main.rs"]
    assert [r["content"] for r in got if r["path"].endswith("latin.java")] == [None]


def test_end_to_end(spark, workspace):
    w, d = workspace
    r = analysis.analyze(spark, w, d)
    assert [x["fqn"] for x in r.seeds.collect()] == ["com.acme.a.Service::act"]
    g = json.loads(r.output("json"))
    ids = {n["id"] for n in g["nodes"]}
    assert ids == {"method:com.acme.a.Service::act", "method:com.acme.b.RepoImpl::load", "kafka:events", "method:com.acme.c.Listener::on", "db:users"}
    messages = " ".join(x["message"] for x in r.issues.collect())
    assert "noise.patch" in messages and "gone/Service.java" in messages and "latin.java" in messages and "broken.xml" in messages
    s = r.statistics.first()
    assert (s["total_files"], s["methods_changed"], s["traced_chains"]) == (2, 1, g["edge_count"])
    assert r.output("dot").startswith("digraph") and r.output("mermaid").startswith("graph")
    # from the stored index the answer is the same, interfaces included
    assert store.is_valid(w)
    again = analysis.analyze(spark, w, d)
    assert json.loads(again.output("json")) == g


def test_depth_zero(spark, workspace):
    r = analysis.analyze(spark, *workspace, TraceConfig(max_depth=0))
    assert (r.nodes.count(), r.edges.count()) == (1, 0)


def test_index_life(spark, workspace):
    w, _ = workspace
    assert not store.exists(w) and store.load(spark, w) is None and store.info(w) is None
    analysis.index(spark, w)
    m = store.info(w)
    assert (m.file_count, m.method_count) == (7, 6)
    assert store.meta_frame(spark, m).first()["method_count"] == 6
    os.utime(os.path.join(w, "svc/app.yml"), (time.time() + 99, time.time() + 99))
    assert not store.is_valid(w)
    analysis.index(spark, w)
    assert store.is_valid(w) and store.info(w).created_at == m.created_at
    assert store.clear(w) and not store.exists(w) and not store.clear(w)


def test_empty_workspace(spark, workspace, tmp_path):
    (tmp_path / "none").mkdir()
    r = analysis.analyze(spark, str(tmp_path / "none"), workspace[1])
    assert r.nodes.count() == 0 and "{" in r.output("dot")


def test_missing_input(spark, workspace, tmp_path):
    with pytest.raises(analysis.AnalysisError):
        analysis.analyze(spark, str(tmp_path / "nowhere"), workspace[1])
    with pytest.raises(analysis.AnalysisError):
        analysis.analyze(spark, workspace[0], str(tmp_path / "nowhere"))


def test_patch_folders(spark, workspace, tmp_path):
    _, d = workspace
    got = tables.patches(*tables.patch_texts(spark, d)).where("error IS NULL").select("file_path").collect()
    assert sorted(r["file_path"] for r in got) == ["gone/Service.java", "svc/Service.java"]
    one = tables.patches(*tables.patch_texts(spark, f"{d}/svc.patch"))
    assert [r["file_path"] for r in one.collect()] == ["Service.java"]
    assert tables.hunk_lines(one).count() == 3 and tables.hunks(one).count() == 1
    (tmp_path / "empty").mkdir()
    changed, issues = analysis.changes(spark, str(tmp_path / "empty"))
    assert changed.count() == 0 and issues.count() == 1


def test_application_settings(spark, tmp_path):
    root = tmp_path / "shop"
    (root / "start/src/main/resources").mkdir(parents=True)
    (root / "start/src/main/resources/application.yml").write_text("server: {servlet: {context-path: /c}}\n")
    (root / "web").mkdir()
    (root / "web/A.java").write_text('package a.b; class A { @GetMapping("/x") void m() {} }')
    parsed = tables.parsed(files.listing(spark, [str(root / "web/A.java")]), tables.app_config(str(tmp_path)))
    assert parsed.selectExpr("explode(methods.http.path) AS p").first()["p"] == "shop/c/x"


def test_cli(spark, workspace, capsys):
    w, d = workspace
    base = ["-w", w, "-d", d]
    assert cli.main([*base, "-o", "json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["node_count"] == 5
    assert cli.main([*base, "--index-info"]) == 0 and "methods 6" in capsys.readouterr().out
    assert cli.main([*base, "--verify-index"]) == 0 and "valid" in capsys.readouterr().out
    assert cli.main([*base, "--clear-index"]) == 0 and cli.main([*base, "--index-info"]) == 0
    assert cli.main(["-w", "/nowhere", "-d", d], spark) == 1
