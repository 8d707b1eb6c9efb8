"""Toxicity scores from a bidirectional GRU over words and their characters.

A word is a run of letters and digits in lower case. Its input vector joins what is known
of the word (if it was seen often enough) with what is known of its character n-grams, so
that unseen forms of a stem are scored too: a smoothed log-odds of toxic against other
documents, and learned embeddings. A document is cut into overlapping windows of words, all
of which are scored; the largest logit is the document's. Training picks, for each
document, the window that scores highest so far, since a label says that some window is
toxic, not which. Last, a logistic curve of the largest logit and the number of windows is
fitted, weighted back to the rates in the whole table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, gru, words

#: Words a window, and words from one window's start to the next one's.
WINDOW, STRIDE = 24, 12
#: Learn from up to so many toxic and other documents, whole, none longer than this.
SAMPLE_TOXIC, SAMPLE_OTHER, SAMPLE_CHARS = 1000, 2000, 60_000
VOCABULARY, LEAST_DOCS = 20_000, 3
NGRAMS, BUCKETS, DIM, HIDDEN, ATTENTION = (3, 4, 5), 1 << 16, 6, 8, 8
EPOCHS, BATCH = 12, 256
#: Windows scored, distinct words described and training documents counted at once; bounds memory.
CHUNK, WORD_CHUNK, DOC_CHUNK = 8192, 1 << 15, 64


def word_hashes(distinct) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(w) for w in distinct.to_pylist()], dtype=np.uint64)


def ngram_table(distinct) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n the n-gram bucket at each character of each word (-1: none), and word starts."""
    n = len(distinct)
    cuts = np.frombuffer(distinct.buffers()[1], dtype=np.int64)[distinct.offset : distinct.offset + n + 1]
    chars = np.frombuffer(distinct.buffers()[2], dtype="<u4")[cuts[0] // 4 : cuts[-1] // 4] if n else np.zeros(0, np.uint32)
    sizes = np.diff(cuts) // 4
    starts = np.concatenate(([0], np.cumsum(sizes + 2)))
    c = np.zeros(starts[-1], dtype=np.uint64)
    inner = np.ones(len(c), dtype=bool)
    inner[starts[:-1]] = inner[starts[1:] - 1] = False
    c[inner] = chars
    c[starts[:-1]], c[starts[1:] - 1] = 1, 2
    left = np.repeat(starts[1:], sizes + 2) - np.arange(len(c))  # characters to the word's end
    out = []
    with np.errstate(over="ignore"):
        for k in NGRAMS:
            h = np.full(len(c), k, dtype=np.uint64)
            for i in range(k):
                shifted = np.zeros(len(c), np.uint64)
                shifted[: len(c) - i] = c[i:]
                h = (h ^ shifted) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            out.append(np.where(left >= k, (h & np.uint64(BUCKETS - 1)).astype(np.int64), -1))
    return out, starts[:-1]


class Model:
    """The vocabulary, the tables of words and n-grams, the network and the last curve."""

    def __init__(self, vocabulary: np.ndarray, tables: gru.Params, net: gru.Params, curve: np.ndarray, base: float):
        self.vocabulary, self.tables, self.net, self.curve, self.base = vocabulary, tables, net, curve, base

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each word in the word tables; row 0 stands for words not known."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, distinct) -> np.ndarray:
        """The input vector of each distinct word."""
        out = np.empty((len(distinct), inputs_size()), np.float32)
        for i in range(0, len(distinct), WORD_CHUNK):
            out[i : i + WORD_CHUNK] = self._inputs(distinct.slice(i, WORD_CHUNK))
        return out

    def _inputs(self, distinct) -> np.ndarray:
        t, row = self.tables, self.known(word_hashes(distinct))
        grams, starts = ngram_table(distinct)
        odds, vectors = np.append(t["char_odds"], 0).astype(np.float32), np.vstack((t["char"], np.zeros((1, DIM), np.float32)))
        count = sum(np.add.reduceat((g >= 0).astype(np.float32), starts) for g in grams)
        high = np.maximum.reduce([np.maximum.reduceat(odds[g], starts) for g in grams])
        mean = sum(np.add.reduceat(odds[g], starts) for g in grams) / count
        emb = sum(np.add.reduceat(vectors[g], starts, axis=0) for g in grams) / count[:, None]
        return np.concatenate(
            (t["word_odds"][row][:, None], (row > 0)[:, None], t["word"][row], mean[:, None], high[:, None], emb), axis=1
        ).astype(np.float32)

    def logits(self, ids: np.ndarray, distinct, windows: np.ndarray, mask: np.ndarray) -> np.ndarray:
        gates = gru.projected(self.net, self.inputs(distinct))
        gates = tuple(g.astype(np.float32) for g in gates)
        parts = []
        for i in range(0, len(windows), CHUNK):
            w, m = windows[i : i + CHUNK], mask[i : i + CHUNK]
            parts.append(gru.forward(self.net, gates, ids[w], m))
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores from 0 to 1; a text without words gets the rate of toxic documents, below 0.5."""
        ids, distinct, ends = words.numbered(texts)
        windows, mask, doc = cut(ends)
        out = np.full(len(texts), min(self.base, 0.49))
        if len(windows):
            best = np.full(len(texts), -np.inf)
            np.maximum.at(best, doc, self.logits(ids, distinct, windows, mask))
            n = np.bincount(doc, minlength=len(texts))
            has = n > 0
            out[has] = gru.sigmoid(self.curve[0] + self.curve[1] * best[has] + self.curve[2] * np.log(n[has]))
        return out


def inputs_size() -> int:
    return 2 + DIM + 2 + DIM


def cut(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows x WINDOW places of words, which of them are the text's, and the window's text."""
    starts = np.concatenate(([0], ends[:-1]))
    sizes = ends - starts
    n = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(ends)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = starts[doc] + np.minimum(k * STRIDE, np.maximum(0, sizes[doc] - WINDOW))
    places = first[:, None] + np.arange(WINDOW)
    mask = (places < ends[doc][:, None]).astype(np.float32)
    return np.minimum(places, ends[doc][:, None] - 1).astype(np.int32), mask, doc


def _odds(a: np.ndarray, b: np.ndarray, toxic: float, other: float) -> np.ndarray:
    """Shrunk log-odds of features found in ``a`` toxic and ``b`` other documents."""
    rate = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (other + 1))
    return (np.clip(rate, -4, 4) * (a + b) / (a + b + 6)).astype(np.float32)


def _documents(found: np.ndarray, doc: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many toxic and other documents each feature is found."""
    pairs = np.unique(doc.astype(np.int64) * size + found)
    feature, toxic = pairs % size, y[pairs // size] > 0
    return np.bincount(feature[toxic], minlength=size), np.bincount(feature[~toxic], minlength=size)


def _char_odds(texts: list[str], y: np.ndarray) -> np.ndarray:
    """The log-odds of each n-gram bucket, counted a few documents at a time."""
    counts = np.zeros((2, BUCKETS))
    for i in range(0, len(texts), DOC_CHUNK):
        ids, distinct, ends = words.numbered(texts[i : i + DOC_CHUNK])
        if not len(distinct):
            continue
        grams, starts = ngram_table(distinct)
        word_of = np.repeat(np.arange(len(distinct)), np.diff(np.append(starts, len(grams[0]))))
        flat, owner = (np.concatenate(x) for x in zip(*((g[g >= 0], word_of[g >= 0]) for g in grams), strict=True))
        order = np.argsort(owner, kind="stable")
        flat, upto = flat[order], np.searchsorted(owner[order], np.arange(len(distinct) + 1))
        pair = np.unique(np.searchsorted(ends, np.arange(len(ids)), side="right") * len(distinct) + ids)
        w, d = pair % len(distinct), pair // len(distinct)
        size = upto[w + 1] - upto[w]
        at = np.repeat(upto[w] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        counts += _documents(flat[at], np.repeat(d, size), y[i : i + DOC_CHUNK], BUCKETS)
    return _odds(*counts, y.sum(), (1 - y).sum())


def train(rows: list[tuple[int, str]], rate: float, seed: int = 5) -> Model:
    """Fit to (toxic, text) rows; ``rate`` is the share of toxic ones in the whole table."""
    rng = np.random.default_rng(seed)
    y = np.array([t for t, _ in rows], dtype=np.float32)
    ids, distinct, ends = words.numbered([t for _, t in rows])
    windows, mask, doc = cut(ends)
    word_doc = np.searchsorted(ends, np.arange(len(ids)), side="right")
    hashes = word_hashes(distinct)
    a, b = _documents(ids, word_doc, y, max(1, len(distinct)))
    odds, df = _odds(a, b, y.sum(), (1 - y).sum()), a + b
    usable = np.flatnonzero(df >= LEAST_DOCS)
    usable = usable[np.argsort(-df[usable], kind="stable")][:VOCABULARY]
    usable = usable[np.argsort(hashes[usable])]
    char_odds = _char_odds([t for _, t in rows], y)
    small = lambda *s: (0.1 * rng.standard_normal(s)).astype(np.float32)
    tables = {
        "word_odds": np.concatenate(([0], odds[usable])).astype(np.float32), "word": small(len(usable) + 1, DIM),
        "char_odds": char_odds, "char": small(BUCKETS, DIM),
    }
    tables["word"][0] = 0
    net = gru.new_params(rng, inputs_size(), HIDDEN, ATTENTION)
    model = Model(hashes[usable], tables, net, np.array([0.0, 1.0, 0.0]), rate)
    row = model.known(hashes)
    x = model.inputs(distinct)
    odds = x[:, 0] + x[:, 3 + DIM]
    scores = np.where(mask > 0, odds[ids][windows], 0).max(axis=1)
    del x
    adam = gru.Adam()
    weight = np.where(y > 0, 1.0, y.sum() / max(1.0, (1 - y).sum())).astype(np.float32)
    first = np.searchsorted(doc, np.unique(doc))
    for epoch in range(EPOCHS):
        if epoch in (3, 6, 9):
            scores = model.logits(ids, distinct, windows, mask)
        top = np.array([a + int(scores[a:b].argmax()) for a, b in zip(first, np.append(first[1:], len(doc)), strict=True)])
        chance = rng.integers(len(doc), size=len(top))
        use = np.concatenate((top, chance[y[doc[chance]] == 0]))
        rng.shuffle(use)
        for i in range(0, len(use), BATCH):
            b = use[i : i + BATCH]
            own, local = np.unique(ids[windows[b]], return_inverse=True)
            local = local.reshape(len(b), WINDOW)
            part = distinct.take(_arrow(own))
            xb = model.inputs(part)
            keep: dict = {}
            logit = gru.forward(net, gru.projected(net, xb), local, mask[b], keep)
            d = ((gru.sigmoid(logit) - y[doc[b]]) * weight[doc[b]] / len(b)).astype(np.float32)
            g, d_x = gru.backward(net, keep, local, mask[b], xb, d)
            adam.step(net, g)
            _embed_step(adam, tables, row[own], d_x, part)
    _fit_curve(model, ids, distinct, windows, mask, doc, y, rate)
    return model


def _arrow(values: np.ndarray):
    import pyarrow as pa

    return pa.array(values)


def _embed_step(adam: gru.Adam, tables: gru.Params, row: np.ndarray, d_x: np.ndarray, distinct) -> None:
    """A plain gradient step for the rows of the embeddings that a batch has used."""
    np.add.at(tables["word"], row, -adam.rate * 10 * d_x[:, 2 : 2 + DIM])
    tables["word"][0] = 0
    grams, starts = ngram_table(distinct)
    sizes = np.diff(np.append(starts, len(grams[0])))
    count = sum(np.add.reduceat((g >= 0).astype(np.float32), starts) for g in grams)
    each = np.repeat(d_x[:, 4 + DIM :] / count[:, None], sizes, axis=0)
    for g in grams:
        np.add.at(tables["char"], g[g >= 0], -adam.rate * 10 * each[g >= 0])


def _fit_curve(model: Model, ids, distinct, windows, mask, doc, y, rate: float) -> None:
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, doc, model.logits(ids, distinct, windows, mask))
    n = np.bincount(doc, minlength=len(y))
    has = n > 0
    f = np.stack((np.ones(has.sum()), best[has], np.log(n[has])), axis=1)
    t = y[has].astype(np.float64)
    w = np.where(t > 0, rate / max(1e-9, t.mean()), (1 - rate) / max(1e-9, 1 - t.mean()))
    curve = model.curve.copy()
    for _ in range(50):  # Newton's method, held back a little towards no effect of the size
        s = gru.sigmoid(f @ curve)
        h = (f * (w * s * (1 - s))[:, None]).T @ f + np.diag([0.1, 0.1, 1.0])
        step = np.linalg.solve(h, f.T @ (w * (t - s)) - np.array([0.0, 0.1, 1.0]) * (curve - [0, 1, 0]))
        curve += step
        if np.abs(step).max() < 1e-6:
            break
    model.curve = curve


def sample(documents: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, other: int = SAMPLE_OTHER) -> tuple[list, float]:
    """Bounded labelled rows (toxic, text), not held out, and the share of toxic labels.

    A hash of the id chooses the ids; only their texts are gathered. Where an id has
    several labels the largest counts.
    """
    known = labels.where(F.col("toxic").isNotNull() & ~common.held_out("doc_id") & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    lot = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    bound = F.when(F.col("toxic") > 0, toxic / max(1, counts.get(1, 0))).otherwise(other / max(1, counts.get(0, 0)))
    chosen = known.withColumn("lot", lot).where(F.col("lot") < bound)
    docs = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    rows = docs.join(F.broadcast(chosen), "doc_id").select("toxic", "text", "lot").collect()
    rows = sorted(((r["lot"], r["toxic"], r["text"]) for r in rows))
    total = sum(counts.values())
    return [(t, x) for _, t, x in rows], counts.get(1, 0) / total if total else 0.0


def fit(documents: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the labels that aren't held out; None where either class is missing."""
    rows, rate = sample(documents, labels)
    return train(rows, rate) if len({t for t, _ in rows}) == 2 else None


def scored(df: DataFrame, text: str, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 if at least 0.5).

    Every window of every whole text is scored. Null texts are empty ones. Without a model
    scores are 0. Every row stays; columns of these names are replaced; ``keep`` picks the
    columns to give back.
    """
    import pyarrow as pa

    shared = df.sparkSession.sparkContext.broadcast(model)

    def made(texts):
        m = shared.value
        s = m.score(texts.to_pylist()) if m else np.zeros(len(texts))
        return pa.array(s.astype(np.float64)), pa.array((s >= 0.5).astype(np.int32))

    return common.Carried(df, text, "score double, predicted int", keep).through(made, 2 << 20)
