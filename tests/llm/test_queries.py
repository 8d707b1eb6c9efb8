"""Every query on a small set of odd tables, against brute force; every operator on none."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from ripplefront.llm import (  # noqa: E402
    common,
    components,
    decontaminate,
    fingerprint,
    language,
    lines,
    mixing,
    queries,
    simhash,
    token_counts,
    token_files,
    toxicity,
    warc,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, score int, row string, n_tokens int, fingerprint long"
WORDS = {"en": "the of and that with from this have been which", "de": "der die und das nicht mit eine auch sich auf", "fr": "le des les dans pour que une avec sur est"}
LEAK = "a question that asks how many windows of words a benchmark item may hold before it is found"


def prose(r, lang, n):
    w = WORDS[lang].split()
    return " ".join(r.choice(w) + (r.choice("aeiou") if r.random() < 0.4 else "") for _ in range(n))


def odd_documents():
    r = random.Random(0)
    rows = []
    shared = "This line stands in very many documents."
    for i in range(90):
        lang = ["en", "de", "fr"][i % 3]
        text = prose(r, lang, r.choice([3, 30, 120]))
        if i % 4 == 0:
            text = f"{shared}\n{text}\n  {shared.upper()} \n"
        if i % 3 == 1:
            text += " vileword " + prose(r, lang, 4) + " vileword"
        rows.append([i, text, lang, f"s{i % 5}"])
    rows[10][1:3] = rows[11][1:3] = rows[12][1:3]  # copies
    rows[20][1:3] = rows[21][1].replace(" ", "  ").upper(), rows[21][2]
    rows[30][1] = prose(r, "en", 40) + " " + LEAK.upper().replace(" ", ", ") + " " + prose(r, "en", 40)
    rows[40][1] = prose(r, "de", 30_000)
    rows[50][1] = None
    rows[51][1] = ""
    rows[52][1] = " \n\t\n"
    rows[53][1] = "1234 !!"
    rows[54][1] = "x" * 30_000
    rows[55][2] = None
    rows[56][3] = None
    rows[57][3] = ""
    rows.append(list(rows[60]))  # a repeated row
    rows.append([61, "another text under the same id, not at all like the first", "en", "s1"])
    rows.append([None, "no id here but some words all the same", "en", "s2"])
    rows.append([-5, rows[70][1], rows[70][2], "s3"])
    return [(*x, 7, "a", 1, "b", 2, 3) for x in rows]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = odd_documents()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    known = {x[0] for x in rows if x[0] is not None}
    labels = [(i, 1, int("vileword" in (next(x[1] for x in rows if x[0] == i) or ""))) for i in sorted(known)] + [(None, 0, 1), (3, 0, None), (9999, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    items = [(0, LEAK), (1, "another item that nobody has ever put into any document at all"), (2, None), (3, ""), (4, LEAK)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    big = "<html>" + "é" * 800 + "</html>"
    pages = [(1, "u1", big), (2, "u2", big), (3, None, big), (4, "u4", "small"), (5, "u5", "small"), (6, "u6", None), (7, "u\n7", ""), (None, "u8", big), (3, "u9", big), (9, "u", "y" * 70_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    for name, ddl in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], ddl).write.parquet(f"{d}/{name}.parquet")
    return d


def got(spark, name, d):
    return queries.queries()[name](spark, d).collect()


def documents(spark, d):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect()]


def in_order(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))


@pytest.mark.parametrize("name", list(queries.queries()))
def test_empty_tables(spark, empty, name):
    assert got(spark, name, empty) == []


def canonical(t):
    import unicodedata

    n = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"\s+", " ", n(n(t).casefold())).strip(" ")


def test_op1(spark, sf):
    rows = in_order(documents(spark, sf))
    want = {}
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        want.setdefault((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest()), []).append((canonical(text), canonical(changed), canonical(after)))
    fps = {}
    found = got(spark, "op1_fingerprints", sf)
    assert len(found) == len(rows)
    for r in found:
        a, b, c = want[r["doc_id"], r["n_chars"], r["edited_sha256"]][0]
        for text, fp in ((a, r["fingerprint"]), (b, r["edited_fingerprint"])):
            assert fps.setdefault(text, fp) == fp and re.fullmatch("[0-9a-f]{32}", fp)
        assert (r["near_edited"], r["near_next"]) == (float(a == b), float(a == c))
    assert len(set(fps.values())) == len(fps)


@pytest.mark.parametrize("chars", [1, 2])
def test_colliding_digests_are_told_apart(spark, sf, chars):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    found = fingerprint.fingerprints(df.select("doc_id", "text", "fingerprint"), "text", chars).collect()
    byfp = {}
    for r in found:
        byfp.setdefault(r["fingerprint"], set()).add(canonical(r["text"] or ""))
    assert all(len(v) == 1 for v in byfp.values()) and len(byfp) == len({canonical(r["text"] or "") for r in found})
    if chars == 1:
        report = fingerprint.edit_report(df, chars).collect()
        assert len({r["fingerprint"] for r in report}) == len(byfp) and any("-" in r["fingerprint"] for r in report)


def test_op2(spark, sf):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = sorted(((i, len(t.encode()), len(m.encode(t)), len(m.encode(t)) > 4096) for i, t in documents(spark, sf)), key=str)
    assert sorted((tuple(r) for r in got(spark, "op2_token_counts", sf)), key=str) == want


def test_token_counts_keeps_other_columns(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    out = token_counts.token_counts(df, "text", P.path("piece_bpe_32k.model"))
    assert out.columns == [c for c in df.columns if c not in ("text", "n_tokens")] + ["n_bytes", "n_tokens"]
    assert out.count() == df.count()


def test_op3(spark, sf):
    rows = documents(spark, sf)
    fps = [simhash.simhash(t.encode()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j, b in enumerate(fps[:i]):
            if (a ^ b).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)
    assert sorted((tuple(r) for r in got(spark, "op3_simhash", sf)), key=str) == want
    assert sum(f == 0 for f in fps) >= 3


def test_near_copies_link(spark):
    r = random.Random(1)
    base = [f"w{r.randrange(500)}" for _ in range(400)]
    rows = [(i, " ".join(base[:k] + ["new"] + base[k:])) for i, k in enumerate(range(0, 400, 10))] + [(1000 + i, prose(r, "en", 50)) for i in range(20)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    fps = {x["doc_id"]: x["fp"] % 2**64 for x in found}
    for x in found:
        for y in found:
            if (fps[x["doc_id"]] ^ fps[y["doc_id"]]).bit_count() <= 4:
                assert x["component_id"] == y["component_id"]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    chain = [(i, i + 1) for i in range(40)]
    pairs = chain + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(30)] + [(200, 200), (300, 301), (301, 300)] + [(400, 400 + i) for i in range(1, 30)]
    r.shuffle(pairs)
    got_ = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got_ == {x: find(x) for x in list(parent)}


def test_op4(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = [(i, [*t.encode(x, add_special_tokens=False).ids, 2]) for i, x in documents(spark, sf)]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes()))
    want, start = [], 0
    for i, x in ids:
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted((tuple(r) for r in got(spark, "op4_token_files", sf)), key=str) == sorted(want, key=str)


def test_leftover_files_are_not_read(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = f"file://{tmp_path}"
    args = (docs, "doc_id", "text", P.path("byte_bpe_50k.json"), 2, folder)
    token_files.write_token_files(*args)
    m = token_files.write_token_files(*args)
    out = token_files.read_token_files(m, folder, lambda ids: (len(ids),), "n long")
    assert out.count() == docs.count()


def test_op5(spark, sf):
    found = got(spark, "op5_toxicity", sf)
    text = dict(documents(spark, sf))
    assert len(found) == len(documents(spark, sf))
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    right = [r["predicted"] == int("vileword" in text[r["doc_id"]]) for r in found]
    assert np.mean(right) > 0.9


def test_scores_are_those_of_the_best_window(spark, sf):
    """A plain forward pass, one window and one word at a time, over every window of some texts."""
    from ripplefront.llm import gru, words

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = [t for i, t in documents(spark, sf) if i in (1, 2, 4, 7, 30, 52, 53, 54, 88)]
    p = {k: v.astype(np.float64) for k, v in m.net.items()}

    def step(h, x, d):
        k = len(h)
        gate, own = x @ p[f"W{d}"] + p[f"b{d}"], h @ p[f"U{d}"]
        z, r = gru.sigmoid(gate[:k] + own[:k]), gru.sigmoid(gate[k : 2 * k] + own[k : 2 * k])
        return z * h + (1 - z) * np.tanh(gate[2 * k :] + r * own[2 * k :])

    def logit(x):
        k = p["Uf"].shape[0]
        sides = []
        for d, rows in (("f", x), ("b", x[::-1])):
            h, out = np.zeros(k), []
            for row in rows:
                h = step(h, row, d)
                out.append(h)
            sides.append(out if d == "f" else out[::-1])
        h = np.concatenate((np.array(sides[0]), np.array(sides[1])), axis=1)
        e = np.tanh(h @ p["A"] + p["a"]) @ p["v"]
        a = np.exp(e - e.max())
        return float((a / a.sum()) @ h @ p["w"] + p["c"][0])

    for t, got_ in zip(texts, m.score(texts), strict=True):
        ids, distinct, ends = words.numbered([t])
        if not len(ids):
            assert got_ == min(m.base, 0.49)
            continue
        x = m.inputs(distinct).astype(np.float64)[ids]
        starts = sorted({min(i, max(0, len(x) - toxicity.WINDOW)) for i in range(0, max(1, len(x) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)})
        best = max(logit(x[i : i + toxicity.WINDOW]) for i in starts)
        want = gru.sigmoid(m.curve[0] + m.curve[1] * best + m.curve[2] * np.log(len(starts)))
        assert abs(want - got_) < 1e-3


def test_no_labels_no_model(spark, sf, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert toxicity.fit(docs, spark.read.parquet(f"{empty}/labels.parquet")) is None
    out = toxicity.scored(docs, "text", None).collect()
    assert {(r["score"], r["predicted"]) for r in out} == {(0.0, 0)} and len(out) == docs.count()


def test_op6(spark, sf):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = got(spark, "op6_language", sf)
    assert len(found) == len(documents(spark, sf))
    plain = [r for r in found if r["doc_id"] is not None and 0 <= r["doc_id"] < 90 and not 50 <= r["doc_id"] < 56 and len(rows[r["doc_id"]]["text"].split()) > 20]
    assert np.mean([r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in plain if rows[r["doc_id"]]["lang"]]) > 0.9
    assert {r["doc_id"]: r["lang_pred"] for r in found if r["doc_id"] in (50, 51, 52, 53)} == dict.fromkeys((50, 51, 52, 53), "und")
    assert all(0 <= r["score"] <= 1 for r in found)


def test_identify_replaces_its_columns_and_keeps_others(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = language.identify(docs.withColumnRenamed("score", "SCORE"), "text", language.fit(docs))
    assert out.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score", "langs"] and out.count() == docs.count()


def lines_wanted(rows, least=20, n=3):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, (d, t) in enumerate(rows):
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= least:
                held.setdefault(k, []).append(d)
    last = {k: max(x for x in v if x is not None) for k, v in held.items() if len(v) >= n and any(x is not None for x in v)}
    out = []
    for d, t in rows:
        all_ = t.split("\n")
        kept = [x for x in all_ if key(x) not in last or last[key(x)] == d]
        out.append((d, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def as_rows(found):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in found), key=str)


def test_op7(spark, sf):
    found = as_rows(got(spark, "op7_line_dedup", sf))
    assert found == lines_wanted(documents(spark, sf)) and sum(r[2] for r in found) > 20


def test_lines_come_and_go(spark, sf, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id BETWEEN 0 AND 48").select("doc_id", "text", "source")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    store = lines.LineStore(spark, f"file://{tmp_path}").add(docs.where("doc_id < 30")).add(docs.where("doc_id >= 30"))
    assert as_rows(store.rewrite(docs, True).collect()) == lines_wanted(rows)
    store.take_away(docs.where("doc_id >= 12"))
    some = docs.where("doc_id < 12")
    assert as_rows(store.rewrite(some, True).collect()) == lines_wanted([r for r in rows if r[0] < 12])
    store.take_away(docs.where("doc_id IN (8, 10, 11)"))  # of the shared line two holders are left
    assert sum(r["n_dropped"] for r in store.rewrite(some, True).collect()) == 0
    store.add(docs.where("doc_id >= 8 AND doc_id <> 9"))
    assert as_rows(store.rewrite(docs, True).collect()) == lines_wanted(rows)
    monkeypatch.setattr(lines, "SPREAD", 1)
    assert as_rows(store.rewrite(docs, True).collect()) == lines_wanted(rows)
    texts = {r["doc_id"]: r["text"] for r in store.rewrite(docs).collect()}
    assert store.rewrite(docs).columns == docs.columns
    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in texts.items()} == {r[0]: r[3] for r in lines_wanted(rows)}


def test_repeated_and_null_ids_are_rows_of_their_own(spark, empty, tmp_path_factory):
    import duckdb

    a, b, c = "a line that is long enough to count", "another line that is long enough", "and a third line that is long enough"
    rows = [(1, f"{a}\n{b}"), (1, a), (2, a), (2, f"{a}\n{c}"), (None, f"{b}\n{c}"), (None, b), (None, c), (None, c + " here"), (None, c + " here"), (None, c + " here")]
    d = str(tmp_path_factory.mktemp("shared-ids"))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{d}/documents.parquet")
    found = as_rows(got(spark, "op7_line_dedup", d))
    assert found == lines_wanted(rows) and [r[2] for r in found if r[0] == 2] == [0, 0] and sum(r[2] for r in found) == 6
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    cur = con.execute(queries.ORACLE["op7_line_dedup"])
    assert sorted(cur.fetchall(), key=str) == found


ODD_IDS = {
    "hashed": lambda i: (i * 0x9E3779B97F4A7C15 + 12345) % 2**64 - 2**63,
    "extreme": lambda i: [-(2**63), 2**63 - 1, 0, -1, None][i % 5],
    "constant": lambda i: 7,
    "null": lambda i: None,
    "a third null": lambda i: None if i % 3 == 0 else i,
}


@pytest.mark.parametrize("kind", list(ODD_IDS))
def test_odd_ids(spark, kind, tmp_path_factory):
    from tokenizers import Tokenizer

    r = random.Random(9)
    rows = [(ODD_IDS[kind](i), prose(r, "en", r.choice([0, 3, 9, 9, 40])), f"s{i % 2}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for n in (1, 16, 2000, 40_000):
        b, total = common.range_bucket(df, "doc_id", n, F.xxhash64("text"))
        at = sorted((x["doc_id"] is not None, x["doc_id"] or 0, x["b"]) for x in df.withColumn("b", b).collect())
        assert all(0 <= x[2] < total for x in at) and total <= 2 * n + 66
        assert [x[2] for x in at] == sorted(x[2] for x in at)  # monotone, nulls first
        if n == 2000:  # an id that many rows share, or none, is dealt to many buckets
            assert len({x[2] for x in at}) > 60 or kind == "extreme" and len({x[2] for x in at}) > 30
    d = str(tmp_path_factory.mktemp("ids"))
    df.write.parquet(f"{d}/documents.parquet")
    ids = [x[0] for x in rows]
    found = got(spark, "op1_fingerprints", d)
    assert sorted((x["doc_id"] for x in found), key=str) == sorted(ids, key=str)
    # following the rows' successors goes through all of them: every text's start is the edit of one other
    shas = sorted(x["edited_sha256"] for x in found)
    if kind == "hashed":
        order = sorted(rows)
        want = [t[: len(t) - len(t) // 2] + order[(i + 1) % len(order)][1][: len(t) // 2] for i, (_, t, _) in enumerate(order)]
        assert shas == sorted(hashlib.sha256(t.encode()).hexdigest() for t in want)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counts = sorted(((x[0], len(t.encode(x[1], add_special_tokens=False).ids) + 1) for x in rows), key=str)
    read = got(spark, "op4_token_files", d)
    assert sorted(((x["doc_id"], x["n_tokens"]) for x in read), key=str) == counts
    upto = 0
    in_file = sorted(read, key=lambda x: x["start"])
    for x in in_file:
        assert x["start"] == upto
        upto += x["n_tokens"]
    key = [(x["doc_id"] is not None, x["doc_id"] or 0) for x in in_file]
    assert key == sorted(key)
    mix = got(spark, "op8_mixing", d)
    assert len(mix) == 200 and all(0 <= x["taken"] <= 2 * x["size"] for x in mix)
    for size, target in {(x["source_size"], x["target"]) for x in mix}:
        assert abs(sum(x["taken"] for x in mix if x["source_size"] == size) / target - 1) < 0.1
    assert sorted(map(tuple, mix), key=str) == sorted(map(tuple, got(spark, "op8_mixing", d)), key=str)


def test_op8(spark, sf):
    found = got(spark, "op8_mixing", sf)
    rows = {(r["doc_id"], r["text"]): r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for (_, t), s in rows.items():
        sizes[s] = sizes.get(s, 0) + size(t)
    repeated = next(t for (d, t) in rows if d == 60)
    sizes["s0"] += size(repeated)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / w for s in order}
        over = {s for s in order if target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            break
        full |= over
    assert len(found) == 94
    got_target = {}
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        got_target.setdefault(r["source_size"], r["target"])
    for s in order:
        assert any(abs(t - target[s]) < 1e-6 * max(1, target[s]) and n == sizes[s] for n, t in got_target.items())
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, got(spark, "op8_mixing", sf)), key=str)


def test_taken_is_near_the_target(spark):
    r = random.Random(4)
    rows = [(i, f"s{min(4, i % 7)}", int(r.paretovariate(1.2) * 20) % 3000) for i in range(3000)]
    out = mixing.copies(spark.createDataFrame(rows, "doc_id long, source string, size long"), 7).collect()
    for s in {x["source"] for x in out}:
        own = [x for x in out if x["source"] == s]
        assert abs(sum(x["copies"] * x["size"] for x in own) / own[0]["target"] - 1) < 0.03


def test_mixed_rows_are_the_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in out.collect())
    assert words == sum(r["taken"] for r in got(spark, "op8_mixing", sf))


def test_op9(spark, sf):
    found = got(spark, "op9_decontamination", sf)
    assert sorted((r["doc_id"], r["item_id"], r["similarity"], r["start_word"], r["n_words"]) for r in found) == [(30, 0, 1.0, 40, 18), (30, 4, 1.0, 40, 18)]


def test_items_in_blocks(spark, sf, monkeypatch):
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (10,))
    docs, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    assert len(list(decontaminate.item_blocks(items))) == 3
    assert decontaminate.leaks(docs, items).count() == 2


def test_op10(spark, sf):
    found = {}
    for r in got(spark, "op10_warc", sf):
        found.setdefault(r["page_id"], []).append(r)
    pages = [(r["page_id"], r["html"] or "") for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sum(map(len, found.values())) == len(pages)
    for i, html in pages:
        for r in found[i]:
            b = html.encode()
            assert (r["payload_bytes"], r["payload_digest"]) == (len(b), hashlib.sha1(b).hexdigest())
            again = "é" in html and i != 3
            assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if again else ("response", None))


def test_selected_records(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    index = warc.write(pages, f"file://{tmp_path}")
    assert index.columns == [x.split()[0] for x in warc.INDEX.split(", ")]
    got_ = {r["page_id"]: r for r in warc.read(index.where("page_id IN (4, 7, 9, 1)"), f"file://{tmp_path}").collect()}
    assert bytes(got_[4]["payload"]) == b"small" and got_[1]["payload"] is None and len(got_[9]["payload"]) == 70_000 and got_[7]["url"] == "u%0A7"


def test_lookup_of_skewed_keys(spark):
    rows = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(900)], "i long, k long")
    found = spark.createDataFrame([(k, k * 2) for k in range(0, 900, 2)], "k long, v long")
    out = {r["i"]: r["v"] for r in common.lookup(common.stored(rows, "t"), found, "k").collect()}
    assert out == {i: (None if k % 2 else k * 2) for i in range(900) for k in [0 if i % 3 else i]}


def test_range_buckets_are_monotone(spark):
    df = spark.createDataFrame([(x,) for x in [None, -(10**12), -3, 0, 1, 2, 2, 2, 50, 51, 10**15, 10**15 + 7]], "k long")
    b, n = common.range_bucket(df, "k", 16)
    got_ = [(r["k"], r["b"]) for r in df.withColumn("b", b).collect()]
    inner = [b for k, b in sorted((x for x in got_ if x[0] is not None))]
    assert inner == sorted(inner) and all(0 <= b < n for _, b in got_) and dict(got_)[None] == 0
    assert common.range_bucket(df.limit(0), "k", 16)[1] == 1
