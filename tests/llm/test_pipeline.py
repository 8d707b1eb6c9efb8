"""The pipeline's stages, each on its own input and all together."""

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_queries import DOCS, empty, sf  # noqa: E402, F401


@pytest.fixture(scope="module")
def stages(spark, sf):  # noqa: F811
    from ripplefront.llm import common

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [("start", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, sf), f"test-{name}")
        out.append((name, docs))
    return dict(out)


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)


def test_columns_stay(stages):
    first = stages["start"].columns
    assert all(stages[n].columns == first for n in ("language", "near_duplicates", "decontamination", "mixing"))
    assert stages["token_files"].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_language_rejects_what_has_none(stages):
    gone = set(ids(stages["start"])) - set(ids(stages["language"]))
    assert {50, 51, 52, 53} <= gone and len(gone) < 12


def same_row(df):
    return sorted(map(str, df.collect()))


def test_one_row_of_each_group_stays(stages):
    from test_similar import rows_wanted

    before = [(r["doc_id"], r["text"] or "") for r in stages["language"].collect()]
    after = [(r["doc_id"], r["text"] or "") for r in stages["near_duplicates"].collect()]
    assert sorted(after, key=str) == sorted(rows_wanted(before), key=str)
    assert 10 in ids(stages["near_duplicates"]) and not {11, 12} & set(ids(stages["near_duplicates"]))
    assert ids(stages["near_duplicates"]).count(61) == 2  # unlike texts under one id


def test_leaks_go(stages):
    assert set(ids(stages["near_duplicates"])) - set(ids(stages["decontamination"])) == {30}


def test_mix_repeats_rows(stages):
    a, b = stages["decontamination"], stages["mixing"]
    known, found = same_row(a), same_row(b)
    assert set(found) <= set(known) and all(found.count(x) <= 2 * known.count(x) for x in found)


def test_tokens_of_every_row(stages):
    assert ids(stages["token_files"]) == ids(stages["mixing"])
    rows = sorted(stages["token_files"].select("start", "n_tokens").collect())
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]


def test_run(spark, sf, stages):  # noqa: F811
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, got.collect())) == sorted(map(str, stages["token_files"].collect()))


def test_run_over_nothing(spark, empty):  # noqa: F811
    assert corpus_pipeline.run(spark, empty).collect() == []
