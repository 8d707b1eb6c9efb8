"""The parts without Spark, against plain versions of themselves."""

import io
import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from ripplefront.llm import (  # noqa: E402
    bpe,
    decontaminate,
    gru,
    language,
    lines,
    simhash,
    token_counts,
    token_files,
    toxicity,
    warc,
    words,
)
from ripplefront.llm.cuckoo import CuckooFilter, Full  # noqa: E402

ODD = ["", " ", "  a", "\n", "a\n\n b", "\x1f", "▁x ▁", "<s> </s>", "<|endoftext|>", "It's we'll 'tis", "日本 語", "😀 é", "a　b\xa0c", "x\x00y", "\t\r\n\v\f"]
pieces = st.lists(st.sampled_from([" ", "  ", "\n", "a", "The", "é", "▁", "\x1f", "\t", "<s>", "'s", "12", "\xa0", "😀", "<|endoftext|>", "!"]), max_size=14)
texts = pieces.map("".join)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PieceCounter(P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def encoder():
    return bpe.ByteBpe(P.path("byte_bpe_50k.json"))


def test_piece_counts_of_odd_texts(counter):
    many = [*ODD, "x" * 5000, " ".join(ODD) * 50]
    assert counter.count(pa.array(many)).tolist() == counter.whole(many)


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_piece_counts(counter, some):
    assert counter.count(pa.array(some)).tolist() == counter.whole(some)


def test_piece_counts_with_a_full_cache(counter, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 3)
    some = ["one two three four five", "one two six seven", "one"]
    assert counter.count(pa.array(some)).tolist() == counter.whole(some)


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_ids(encoder, some):
    want = [e.ids for e in encoder.library.encode_batch(some, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(pa.array(some))] == want


def test_ids_of_odd_texts(encoder, monkeypatch):
    want = [e.ids for e in encoder.library.encode_batch(ODD, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(pa.array(ODD))] == want
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 2)
    assert [x.tolist() for x in encoder.encode(pa.array(ODD).slice(3))] == want[3:]
    assert encoder.encode(pa.array([], pa.string())) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), max_size=6), st.sampled_from([1, 50, 90, 100]))
def test_token_file_round_trip(docs, percentile):
    f = io.BytesIO()
    w = token_files.Writer(f, percentile)
    for i, d in enumerate(docs):
        w.add(i - 2 if i != 1 else None, np.array(d, dtype=np.uint32))
    w.close()
    r = token_files.Reader(f, f.tell())
    assert [x.tolist() for x in r.documents(100)] == docs
    assert r.doc_ids == [i - 2 if i != 1 else None for i in range(len(docs))]


def test_token_file_in_groups(monkeypatch):
    monkeypatch.setattr(token_files, "GROUP", 2)
    ids = np.random.default_rng(0).integers(0, 60_000, 5000).astype(np.uint32)
    f = io.BytesIO()
    w = token_files.Writer(f)
    w.add(1, ids)
    w.add(2, ids[:10])
    w.close()
    r = token_files.Reader(f, f.tell())
    assert np.array_equal(r.ids(700, 3000), ids[700:3000])
    assert [len(x) for x in r.documents()] == [5000, 10]


def test_cut_token_file_is_an_error():
    f = io.BytesIO()
    w = token_files.Writer(f)
    w.add(1, np.arange(9, dtype=np.uint32))
    w.close()
    with pytest.raises(ValueError):
        token_files.Reader(f, f.tell() - 1)


def plain_simhash(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


@pytest.mark.parametrize("text", [*ODD, "A b", "a b c d", "Ä É a b c D e", "a " * 700, "one two three four five six seven " * 9])
def test_simhash(text, monkeypatch):
    assert simhash.simhash(text.encode()) == plain_simhash(text)
    monkeypatch.setattr(simhash, "CHUNK", 3)
    assert simhash.simhash(text.encode()) == plain_simhash(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**12 - 1), min_size=1, max_size=40, unique=True))
def test_tree_connects_as_all_links_do(values):
    def groups(pairs):
        parent = {v: v for v in values}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(a)] = find(b)
        return Counter(frozenset(v for v in values if find(v) == find(r)) for r in values)

    found = simhash.tree(np.array(values, dtype=np.uint64), 4, 4)
    assert len(found) < len(values) and all((a ^ b).bit_count() <= 4 for a, b in found)
    assert groups(found) == groups([(a, b) for a in values for b in values if (a ^ b).bit_count() <= 4])


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    inside, outside = (rng.integers(0, 2**63, 20_000).astype(np.uint64) * np.uint64(2) + np.uint64(k) for k in (0, 1))
    f = CuckooFilter.built(inside)
    assert f.contains(inside).all() and f.contains(outside).mean() < 0.002
    f = CuckooFilter.from_bytes(f.to_bytes())
    f.delete(inside[:15_000])
    assert f.contains(inside[15_000:]).all() and f.contains(inside[:15_000]).mean() < 0.01 and f.count == 5000
    with pytest.raises(KeyError):
        f.delete(outside[~f.contains(outside)][:1])


def test_full_cuckoo_filter_keeps_what_it_has():
    f = CuckooFilter(1)
    some = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    done = 0
    with pytest.raises(Full):
        for x in some:
            f.insert(np.array([x]))
            done += 1
    assert done and f.contains(some[:done]).all() and f.count == done


def test_line_keys():
    got, keys = lines.line_keys("  The Quick BROWN fox jumps \n\tthe quick brown fox jumps\r\nshort\nééééééééééééééééééé\nÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ".encode(), 20)
    assert len(got) == 5 and keys[0] == keys[1] and keys[2] is None and keys[3] is None and keys[4] is not None


def test_warc_records():
    for kind, payload in (("response", b"<html>\r\n\r\n</html>"), ("response", b""), ("revisit", b"x" * 2000)):
        data = warc.record(None if not payload else 7, "http://x/\r\ny", kind, 9, "ab", payload)
        fields, block = warc.parse(data)
        assert fields["WARC-Type"] == kind and int(fields["X-Payload-Length"]) == len(payload)
        assert block == (payload if kind == "response" else b"")
    with pytest.raises(ValueError):
        warc.parse(data[:-3])


def test_warc_ranges():
    rows = [{"offset": o, "length": n} for o, n in ((0, 10), (10, 5), (40, 5), (300, 50), (350, 60))]
    got = [(a, b, len(r)) for a, b, r in warc.ranges(rows, gap=30, span=100)]
    assert got == [(0, 45, 3), (300, 350, 1), (350, 410, 1)]
    assert list(warc.ranges([])) == []


def test_words():
    ids, distinct, ends = words.numbered(["Don't stop, DON'T!", "", "É é 12"])
    named = [w.decode("utf-32-le") for w in distinct.to_pylist()]
    assert [named[i] for i in ids] == ["don", "t", "stop", "don", "t", "é", "é", "12"] and ends.tolist() == [5, 5, 8]
    assert words.numbered([""])[2].tolist() == [0]


def test_trigrams_stay_within_their_text():
    alone = [language.trigrams([t])[0].tolist() for t in ("Abc d", "", "!!", "xyz")]
    together, ends = language.trigrams(["Abc d", "", "!!", "xyz"])
    assert np.split(together, ends[:-1])[0].tolist() == alone[0] and together[ends[-2] :].tolist() == alone[3]
    assert alone[1] == alone[2] == [] and len(alone[0]) == 4
    assert language.trigrams(["aBC, D!"])[0].tolist() == alone[0]


def test_mixture_finds_both_languages():
    rng = np.random.default_rng(0)
    one, two = (["".join(rng.choice(list(a), 5)) for _ in range(60)] for a in ("abcde", "fghij"))
    say = lambda w, n: " ".join(rng.choice(w, n))
    m = language.Model.fitted([(k, say(w, 300)) for k, w in (("x", one), ("y", two)) for _ in range(5)])
    (lang, share, langs), other = m.predict([say(one, 300) + " " + say(two, 100), say(two, 50)])
    assert lang == "x" and 0.7 < share < 0.8 and langs.count(":") == 2
    assert other[0] == "y" and other[2] == "y:1.0000"
    assert m.predict(["", "12 !", "日"]) [:2] == [("und", 0.0, "")] * 2
    assert language.Model([], np.zeros((language.BUCKETS, 1), np.float32)).predict(["abc"]) == [("und", 0.0, "")]


def test_marks_alone_are_no_letters():
    m = language.Model(["x", "y"], np.full((language.BUCKETS, 2), 0.5, np.float32))
    found = [p[0] for p in m.predict(["\u0301", "a\u0301", "\u0301\u0302 \u20dd !", "", "1\u0301", "\u0301 b"])]
    assert [f == "und" for f in found] == [True, False, True, True, True, False]


def test_chosen_languages_against_every_set():
    """The best penalised likelihood over all sets of languages, each fitted to the end."""
    from itertools import chain, combinations

    rng = np.random.default_rng(4)
    letters = ["abcdefg", "efghijk", "lmnopqr", "qrstuvw"]
    vocabulary = [["".join(rng.choice(list(a), 4)) for _ in range(50)] for a in letters]
    say = lambda k, n: " ".join(rng.choice(vocabulary[k], n))
    m = language.Model.fitted([(str(k), say(k, 400)) for k in range(4) for _ in range(4)])
    same = 0
    for trial in range(24):
        parts = rng.choice(4, rng.integers(1, 4), replace=False)
        text = " ".join(say(int(k), int(rng.integers(15, 120))) for k in parts)
        buckets = language.trigrams([text])[0]
        u, w = language.distinct(buckets)
        p = m.table[u].astype(float)
        price = language.PENALTY * np.log(w.sum() + 1)
        sets = chain.from_iterable(combinations(range(4), n) for n in range(1, 5))
        value = {s: language.mixture(p, w, list(s))[1] - price * (len(s) - 1) for s in sets}
        got = tuple(sorted(language.infer(m.table, buckets)))
        assert value[got] > max(value.values()) - 0.02 * w.sum(), trial
        same += value[got] >= max(value.values()) - 1e-6 or got == max(value, key=value.get)
    assert same >= 23


def test_simhash_radius_near_the_threshold():
    """The share of windows at a similarity of 0.8 to 0.9 whose SimHash lies beyond the radius."""
    rng = np.random.default_rng(6)
    lost = tried = 0
    for n in (10, 20, 40, 100):
        for _ in range(400):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = a.copy()
            change = rng.choice(n, max(1, n // 10), replace=False)
            b[change] = rng.integers(0, 2**63, len(change)).astype(np.uint64)
            if decontaminate.similarity(a, b) >= 0.8:
                tried += 1
                lost += int(decontaminate.simhash(a[None])[0] ^ decontaminate.simhash(b[None])[0]).bit_count() > decontaminate.RADIUS
    assert tried > 1000 and lost <= tried / 1000


def test_em_gains_likelihood():
    rng = np.random.default_rng(0)
    p, w = rng.dirichlet(np.ones(50), 3).T, rng.integers(1, 9, 50).astype(float)
    even = float(w @ np.log(p.mean(axis=1)))
    theta, value = language.mixture(p, w, [0, 1, 2])
    assert value >= even and abs(theta.sum() - 1) < 1e-9


def plain_leaks(text, items):
    out = {}
    for item_id, item in items:
        a, b = (decontaminate.word_codes([t])[0] for t in (text, item))
        if not len(a) or not len(b):
            continue
        width = min(len(a), len(b))
        want = decontaminate.shingles(b)
        best = max((decontaminate.similarity(decontaminate.shingles(a[i : i + width]), want), -i) for i in range(len(a) - width + 1))
        if best[0] >= 0.8:
            out[item_id] = (round(best[0], 9), -best[1])
    return out


def test_leaks_against_all_windows():
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 40)))) for i in range(25)] + [(90, ""), (91, "!!!"), (92, items_text := "w1 w2 w3")]
    assert items_text
    block = decontaminate.Items(items)
    for trial in range(120):
        parts = [" ".join(rng.choice(vocabulary, rng.integers(0, 30))) for _ in range(2)]
        inner = items[trial % 25][1].split()
        for _ in range(trial % 4):
            inner[rng.integers(len(inner))] = "other"
        text = parts[0] + " " + " ".join(inner).upper() + ", " + parts[1]
        codes, _ = decontaminate.word_codes([text])
        got = {i: (round(s, 9), at) for i, s, at, _ in block.matches(codes, 0.8)}
        assert got == plain_leaks(text, items), trial


def test_suspects_hold_all_matches():
    items = [(1, "a b c d e f g"), (2, "h i j k l m")]
    block = decontaminate.Items(items)
    docs = ["x a b c d e f g y", "a b c d", "e f g h i j k", "", "q h i j k l m"]
    codes, ends = decontaminate.word_codes(docs)
    assert block.suspects(codes, ends).tolist() == [0, 4]


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.new_params(rng, 5, 3, 2).items()}
    x, ids = rng.standard_normal((7, 5)), rng.integers(0, 7, (4, 6))
    mask = (np.arange(6) < np.array([6, 4, 1, 5])[:, None]).astype(np.float64)

    def loss():
        return float((gru.forward(p, gru.projected(p, x), ids, mask) * np.arange(1, 5)).sum())

    keep = {}
    gru.forward(p, gru.projected(p, x), ids, mask, keep)
    g, d_x = gru.backward(p, keep, ids, mask, x, np.arange(1, 5).astype(float))
    for name, values in [*p.items(), ("x", x)]:
        grad = d_x if name == "x" else g[name]
        for k in list(np.ndindex(values.shape))[:4]:
            old = values[k]
            values[k] = old + 1e-3
            up = loss()
            values[k] = old - 1e-3
            down = loss()
            values[k] = old
            assert abs((up - down) / 2e-3 - grad[k]) < 2e-3 + 2e-2 * abs(grad[k]), (name, k)


def test_windows_cover_every_word():
    sizes = np.array([0, 1, 24, 25, 36, 37, 100])
    ends = np.cumsum(sizes)
    w, mask, doc = toxicity.cut(ends)
    for i, n in enumerate(sizes):
        seen = set(w[(doc == i)][mask[doc == i] > 0].tolist())
        assert seen == set(range(ends[i] - n, ends[i]))
    assert (np.bincount(doc, minlength=7)[:3] == [0, 1, 1]).all() and np.bincount(doc)[3] == 2


def test_toxicity_learns_words_and_stems():
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]

    def doc(bad, stem=False):
        w = list(rng.choice(plain, rng.integers(10, 80)))
        if bad:
            for _ in range(2):
                w.insert(rng.integers(len(w)), "zzq" + "".join(rng.choice(list("abcdefgh"), 3)) if stem else "vileword")
        return " ".join(w)

    rows = [(int(b), doc(b, k % 8 == 0)) for k in range(400) for b in [k % 4 < 1 or k % 8 == 2]]
    m = toxicity.train(rows, 0.3)
    good, bad = m.score([doc(False) for _ in range(60)]), m.score([doc(True, k % 2 == 0) for k in range(60)])
    assert (good < 0.5).mean() > 0.95 and (bad >= 0.5).mean() > 0.95
    empty = m.score(["", "!!"])
    assert ((empty >= 0) & (empty < 0.5)).all()
    long = m.score([doc(False) + " " + " ".join([doc(False)] * 200) + " vileword vileword"])
    assert long[0] >= 0.5


def test_crc_is_unsigned():
    assert zlib.crc32(np.array([2], "<u4").tobytes()) > 0 and json.dumps(1)
