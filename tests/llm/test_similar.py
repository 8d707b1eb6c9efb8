"""Near-duplicates of the pipeline against brute force over all pairs."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

DOCS = "doc_id long, text string, lang string, source string"


def similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def near_copies():
    r = random.Random(1)
    boiler = " ".join(f"notice{i}" for i in range(12))
    texts = []
    for _ in range(30):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([40, 90, 300]))]
        texts.append(" ".join(words) + " " + boiler)
        for changes in (1, 2, 4):
            other = list(words)
            for at in r.sample(range(len(other)), changes):
                other[at] = f"z{r.randrange(10**9)}"
            texts.append(" ".join(other[: len(other) - r.randrange(6)]) + " " + boiler)
    return texts


def smallest(texts):
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [i for i in range(len(texts)) if root[i] == i]


def rows_wanted(rows):
    """Of each component of (doc_id, text) rows the one with the smallest id; ids may be null or shared."""
    texts = sorted({t for _, t in rows})
    root = {t: t for t in texts}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if similarity(a, b) >= 0.8:
                root[top(a)] = top(b)
    least = {}
    for d, t in rows:
        key = (d is None, d or 0)
        least[top(t)] = min(least.get(top(t), (key, d, t)), (key, d, t), key=lambda x: (x[0], xx(x[2])))
    return [(d, t) for _, d, t in least.values()]


def xx(text):
    """XXH64 as Spark has it: of equal ids in a component the text with the smallest one stays."""
    import xxhash

    v = xxhash.xxh64_intdigest(text.encode(), 42)
    return v - (1 << 64) if v >> 63 else v


def test_rows_with_shared_and_null_ids(spark):
    r = random.Random(5)
    texts = [" ".join(f"{c}{r.randrange(10**6)}" for _ in range(40)) for c in "abcdefgh"]
    more = [t + " and more" for t in texts]
    rows = [(61, texts[0]), (61, texts[1]), (None, texts[2]), (None, texts[3]), (None, more[3]), (7, texts[4]), (7, texts[4]), (3, more[4])]
    rows += [(None, texts[5]), (9, more[5]), (None, texts[6]), (None, texts[6]), (5, texts[7]), (5, more[7]), (5, ""), (6, None), (None, "")]
    want = rows_wanted([(d, t or "") for d, t in rows])
    docs = spark.createDataFrame([(d, t, "en", f"s{i}") for i, (d, t) in enumerate(rows)], DOCS).repartition(3)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert sorted(((x["doc_id"], x["text"] or "") for x in got), key=str) == sorted(want, key=str) and len(got) == 9
    assert sum(x["doc_id"] == 61 for x in got) == 2


def test_groups_beyond_the_index_and_long_lists(spark, monkeypatch):
    from ripplefront.llm import similar, simhash

    monkeypatch.setattr(similar, "LONG", 5)
    texts = near_copies()
    fps = [simhash.majority([s]) for s in similar.shingle_sets(texts)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(texts[i], texts[j]) >= 0.8]
    far = [p for p in pairs if (fps[p[0]] ^ fps[p[1]]).bit_count() > 4]
    assert far and len(far) < len(pairs)  # some links are the index's, some lie beyond it
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS).repartition(3)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == smallest(texts)


def test_groups_at_08_are_found(spark):
    texts = near_copies()
    want = smallest(texts)
    assert 30 < len(want) < len(texts)
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS).repartition(3)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == want


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_no_similar_pair_is_left_untried(spark, threshold):
    import numpy as np

    from ripplefront.llm import similar

    r = np.random.default_rng(8)
    hot = r.integers(1, 1 << 62, 30, dtype=np.uint64)  # shared by nearly all, and listed last
    sets = [r.integers(1, 1 << 62, n, dtype=np.uint64) for n in range(1, 41)]
    for own in list(sets):
        for part in (0.05, 0.12, 0.25):
            kept = own[r.random(len(own)) >= part]
            sets.append(np.concatenate((kept, r.integers(1, 1 << 62, r.integers(0, 3), dtype=np.uint64))))
    sets += [np.concatenate((own, hot)) for own in sets]
    sets = [np.unique(own) for own in sets if len(own)]
    frequent = np.sort(hot)
    rows = []
    for g, own in enumerate(sets):
        first = similar.listed(own, frequent, np.arange(len(frequent)), threshold).view(np.int64).tolist()
        rows += [(key, g, len(own), i, g) for i, key in enumerate(first)]
    whole = [set(own.tolist()) for own in sets]
    pairs = [(a, b) for b in range(len(whole)) for a in range(b)]
    want = {(a, b) for a, b in pairs if len(whole[a] & whole[b]) >= threshold * len(whole[a] | whole[b]) - 1e-9}
    lists = spark.createDataFrame(rows, "key long, g long, n int, i int, class long")
    got = {(p["a"], p["b"]) for p in similar._tried(lists, threshold).collect()}
    assert len(want) > 40 and want <= got
    assert len(got) < sum(bool(whole[a] & whole[b]) for a, b in pairs) / 2


def test_null_ids_of_unlike_texts_stay(spark):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"]
    rows = [(None, t, "en", "s") for t in [*texts, texts[0], texts[1] + " more"]] + [(7, texts[2] + " more", "en", "s")]
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()
    kept = [t for t in texts[3:]] + [texts[2] + " more"]
    assert len(got) == 6 and set(kept) <= {r["text"] for r in got} and texts[2] not in {r["text"] for r in got}


def test_only_leaking_rows_go(spark, tmp_path):
    item = "what is asked here is a question of rather many words that nobody else would ask"
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(i, f"clean text number {n} about other things than that", "en", "s") for n, i in enumerate([None, None, 3, 4])]
    rows = [*clean, (None, f"so then {item} it says", "en", "s"), (3, item.upper(), "en", "s"), (5, None, "en", "s")]
    got = corpus_pipeline.decontamination_stage(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in spark.createDataFrame([*clean, rows[-1]], DOCS).collect())


def test_several_languages_stay(spark):
    r = random.Random(2)
    parts = {lang: [f"{lang}{a}{b}" for a in "aeiouxyz" for b in "klmnprst"] for lang in ("dog", "fiv", "hum")}
    prose = lambda lang, n: " ".join(r.choice(parts[lang]) for _ in range(n))
    rows = [(i, prose(lang, 200), lang, "s") for i in range(60) for lang in parts]
    mixed = " ".join(prose(lang, 300) for lang in parts)
    docs = spark.createDataFrame([*rows, (1000, mixed, None, "s"), (1001, "12 !!", None, "s")], DOCS)
    got = {x["doc_id"] for x in corpus_pipeline.language_stage(spark, docs, "").collect()}
    assert 1000 in got and 1001 not in got


def test_no_language_to_learn_from(spark):
    rows = [(1, "words of some language", None, "s"), (2, "a", None, "s"), (3, "1234 !!", None, "s"), (4, None, None, "s")]
    got = corpus_pipeline.language_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(x["doc_id"] for x in got) == [1, 2]


def shuffle_bytes(spark):
    """What shuffles hold on this process's disks."""
    from pathlib import Path

    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.stat().st_size for d in folders for f in Path(str(d.getPath())).rglob("shuffle_*") if f.exists())


def test_verification_shuffles_the_texts_it_compares_only(spark):
    from pyspark.sql import functions as F
    from xxhash import xxh3_64_intdigest

    from ripplefront.llm import similar

    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghijklmnop ", k=8000)) for _ in range(300)]
    texts[1] = texts[0] + " one more"
    rows = spark.createDataFrame([(i if i != 1 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = rows.select("doc_id", F.xxhash64("text").alias("x"), "text")
    signed = lambda s: int(np.array([xxh3_64_intdigest(s.tobytes())], np.uint64).view(np.int64)[0])
    ids = [signed(s) for s in similar.shingle_sets(texts)]
    x = {r["doc_id"]: r["x"] for r in rows.select("doc_id", "x").collect()}
    known = [(g, (i == 1, i if i != 1 else None, x[i if i != 1 else None])) for i, g in enumerate(ids)]
    entries = spark.createDataFrame(known, "g long, least struct<none: boolean, doc_id: long, x: long>")
    pairs = spark.createDataFrame([(ids[0], ids[1]), (ids[0], ids[2])], "a long, b long")
    before = shuffle_bytes(spark)
    found = similar._verified(pairs, entries, rows, 0.8)
    assert [tuple(r) for r in found.collect()] == [(ids[0], ids[1])]
    assert shuffle_bytes(spark) - before < sum(map(len, texts)) // 10


def test_filter_passes_every_key(spark):
    from pyspark.sql import functions as F

    from ripplefront.llm import similar

    for n in (0, 1, 5000):
        keys = spark.range(n).select(F.when(F.col("id") == 0, F.lit(-(1 << 63))).otherwise(F.xxhash64("id")).alias("h"))
        bits = similar._filter_of(keys)
        h = np.array([r["h"] for r in keys.collect()], dtype=np.int64)
        assert similar._passed(bits, h).all()
        assert similar._passed(bits, np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, 20_000)).mean() < 0.13


def test_reclaimed_shuffles_leave_the_disk(spark):
    import time

    from ripplefront.llm import common

    def work():
        spark.range(300_000).selectExpr("xxhash64(id) x", "id").repartition(4, "x").groupBy("x").count().write.format("noop").mode("overwrite").save()

    common.reclaim(spark, 0)
    time.sleep(1)
    before = shuffle_bytes(spark)
    work()
    made = shuffle_bytes(spark) - before
    until = time.monotonic() + 20
    while shuffle_bytes(spark) - before > made // 10 and time.monotonic() < until:
        spark.range(1).count()  # what ran last is held until something else runs
        common.reclaim(spark, 0)
        time.sleep(0.2)
    assert made > 1 << 20
    assert shuffle_bytes(spark) - before <= made // 10
