"""Language ID as inference of a mixture of languages.

A document's letters, in lower case with everything else made one blank, give trigrams. Each
language has a smoothed trigram distribution, learned from a bounded sample. A document is a
mixture of languages: expectation-maximisation finds the proportions that make its trigrams
likeliest. The set of languages grows from the best single one, each time by the language
that helps most, while the log-likelihood gains more than a penalty for one language more.
As the log-likelihood is concave, a language whose slope at proportion zero isn't positive
cannot help and isn't tried.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Trigrams fall into so many buckets; a power of two that 16 bits hold.
BUCKETS = 1 << 16
#: At most so many documents of a language are learned from, none of them longer than this.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 100_000
#: At most so many languages are learned, the most frequent ones; each takes 256 KB in every worker.
MAX_LANGS = 256
#: A further language has to gain so many times the logarithm of the number of trigrams.
PENALTY = 4.0
ROUNDS = 25

_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Each code point's lower-case letter, or 32 where it is no letter."""
    if "letters" not in _tables:
        out = np.full(sys.maxunicode + 1, 32, dtype=np.uint32)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(chr(c))[0] in "LM":
                low = chr(c).lower()
                out[c] = ord(low) if len(low) == 1 else c
        _tables["letters"] = out
    return _tables["letters"]


def _lettered(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the texts have a letter; marks alone are none."""
    if "is" not in _tables:
        _tables["is"] = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)
    upto = np.concatenate(([0], np.cumsum(_tables["is"][raw])))
    return np.diff(upto[np.concatenate(([1], ends + 1))]) > 0


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigram buckets of all texts in a row, and where each text's end.

    A text without letters has none. Trigrams start and end with the blank around the text.
    """
    joined = "\n" + "".join(t + "\n\n" for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    c = _letters()[raw]
    sizes = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    c[1:][np.repeat(~_lettered(raw, ends), sizes)] = 32  # marks without any letter are no word
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    upto = np.cumsum(keep)
    c = c[keep].astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.uint16), np.zeros(len(texts), np.int64)
    with np.errstate(over="ignore"):
        h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    # texts are parted by one blank after folding; those around a blank alone aren't a text's
    own = (c[1:-1] != 32)
    cuts = np.concatenate(([0], np.cumsum(own)))
    at = np.clip(upto[ends] - 2, 0, len(own))
    return (h >> np.uint64(48)).astype(np.uint16)[own], cuts[at]


def distinct(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(buckets, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return s[first], np.diff(np.append(first, len(s))).astype(np.float64)


def mixture(p: np.ndarray, w: np.ndarray, langs: list[int], start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Proportions of some languages, by EM, and the log-likelihood; p: trigrams x languages."""
    q, n = p[:, langs], w.sum()
    theta = np.full(len(langs), 1.0 / len(langs)) if start is None else start
    before = -np.inf
    for _ in range(ROUNDS):
        mixed = q @ theta
        value = float(w @ np.log(mixed))
        if value - before < 1e-4 * n:
            break
        before = value
        theta = theta * (q.T @ (w / mixed)) / n
    return theta, float(w @ np.log(q @ theta))


def infer(table: np.ndarray, buckets: np.ndarray, penalty: float = PENALTY) -> dict[int, float]:
    """The selected languages and their proportions, which add up to 1."""
    u, w = distinct(buckets)
    p = table[u].astype(np.float64)
    n = w.sum()
    singles = w @ np.log(p)
    chosen, best = [int(singles.argmax())], float(singles.max())
    theta = np.ones(1)
    while len(chosen) < p.shape[1]:
        slope = p.T @ (w / (p[:, chosen] @ theta)) / n
        tried = [(mixture(p, w, [*chosen, x]), x) for x in range(p.shape[1]) if x not in chosen and slope[x] > 1]
        if not tried:
            break
        (found, value), x = max(tried, key=lambda t: t[0][1])
        if value - best <= penalty * np.log(n + 1):
            break
        chosen, theta, best = [*chosen, x], found, value
    return dict(zip(chosen, theta.tolist(), strict=True))


class Model:
    """Languages, in order, and the probability of each trigram bucket in each of them."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table

    @classmethod
    def fitted(cls, rows: list[tuple[str, str]]) -> Model:
        langs = sorted({lang for lang, _ in rows})
        counts = np.zeros((BUCKETS, max(1, len(langs))))
        for k, lang in enumerate(langs):
            counts[:, k] = np.bincount(trigrams([t for x, t in rows if x == lang])[0], minlength=BUCKETS)
        total = counts.sum(axis=1, keepdims=True)
        backing = (total + 0.5) / (total.sum() + 0.5 * BUCKETS)
        # a language's unseen trigrams get a share in proportion to the pooled distribution
        weight = 0.02
        own = counts / np.maximum(1, counts.sum(axis=0, keepdims=True))
        return cls(langs, ((1 - weight) * own + weight * backing).astype(np.float32))

    def predict(self, texts: list[str]) -> list[tuple[str, float, str]]:
        buckets, ends = trigrams(texts)
        out, start = [], 0
        for end in ends.tolist():
            if end == start or not self.langs:
                out.append(("und", 0.0, ""))
            else:
                found = sorted(((-v, self.langs[k]) for k, v in infer(self.table, buckets[start:end]).items()))
                share = min(1.0, -found[0][0])
                out.append((found[0][1], share, ",".join(f"{x}:{-v:.4f}" for v, x in found)))
            start = end
        return out


def fit(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, max_langs: int = MAX_LANGS) -> Model:
    """Learn from text and lang of rows with a language that aren't held out.

    The sample is a hash of the id's choice: up to about ``sample_docs`` documents of each
    language with at most ``sample_chars`` characters, whole. Where a language has no such
    document it isn't learned. Of more than ``max_langs`` languages, the most frequent count.
    """
    usable = documents.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out("doc_id") & (F.length("text") <= sample_chars)
    ).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    if not counts:
        return Model([], np.zeros((BUCKETS, 1), np.float32))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))])
    lot = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = usable.where(F.col("lang").isin(*counts) & (lot < share[F.col("lang")])).select("lang", "text", lot.alias("lot")).collect()
    # a lot may let in a few more than asked for: the smallest lots stay
    taken, kept = dict.fromkeys(counts, 0), []
    for r in sorted(rows, key=lambda r: (r["lot"], r["text"])):
        if taken[r["lang"]] < sample_docs:
            taken[r["lang"]] += 1
            kept.append((r["lang"], r["text"]))
    return Model.fitted(kept)


def identify(df: DataFrame, text: str, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``df`` with lang_pred, score (the language's proportion) and langs (all found).

    Null texts and texts without a letter: ``und``, score 0. Every row stays, whole texts
    are read, columns of these names are replaced; ``keep`` picks the columns to give back.
    """
    import pyarrow as pa

    shared = df.sparkSession.sparkContext.broadcast((model.langs, model.table))

    def made(texts):
        found = Model(*shared.value).predict(texts.to_pylist())
        return [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.string()))]

    return common.Carried(df, text, "lang_pred string, score double, langs string", keep).through(made)
