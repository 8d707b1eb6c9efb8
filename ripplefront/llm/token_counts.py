"""Token counts of documents under a SentencePiece BPE model, without token ids.

No piece of the model runs across the start of a run of blanks, or across a line feed, so a
text splits there into pre-tokens whose counts add up. Each task encodes a distinct
pre-token once, joins the counts to each document's pre-token frequencies, and sums. The
join is made where the text is read: a table of the frequencies of all documents would be
larger than the texts, and to shuffle it costs more than to count a pre-token once a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import common

#: Most distinct pre-tokens whose counts a Python worker keeps between batches.
CACHE_ENTRIES = 400_000
#: Longer pre-tokens are counted but not kept.
CACHE_CHARS = 64
#: Texts are split up with this character; those that hold it are counted whole.
MARK = "\x1f"
BLANK = "▁"

_models: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts the pieces of pre-tokens, remembering a bounded number of them."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.additive = not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces)
        self.known: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)] if texts else []

    def pretokens(self, found: list[str]) -> np.ndarray:
        """Counts of pre-tokens, each of which starts with a blank or a line feed.

        The model puts a blank before what it encodes: that is the pre-token's own first
        blank, or one piece too many before a line feed.
        """
        known = self.known
        out = [known.get(t, -1) for t in found]
        new = [i for i, n in enumerate(out) if n < 0]
        if new:
            if len(known) + len(new) > CACHE_ENTRIES:
                known.clear()
            texts = [found[i] for i in new]
            sizes = self.whole([t[1:] if t[0] == " " else t for t in texts])
            for i, t, n in zip(new, texts, sizes, strict=True):
                out[i] = n = max(n, 1) if t[0] == " " else n - 1
                if len(t) <= CACHE_CHARS:
                    known[t] = n
        return np.array(out, dtype=np.int64)

    def count(self, texts) -> np.ndarray:
        """Token counts of an Arrow array of texts without nulls."""
        import pyarrow as pa
        import pyarrow.compute as pc

        out = np.zeros(len(texts), dtype=np.int64)
        hard = np.asarray(pc.or_(pc.match_substring(texts, MARK), pc.match_substring(texts, BLANK)))
        if not self.additive:
            hard = np.ones(len(texts), dtype=bool)
        if hard.any():
            out[hard] = self.whole(texts.filter(pa.array(hard)).to_pylist())
        easy = np.flatnonzero(~hard & (np.asarray(pc.binary_length(texts)) > 0))
        if not len(easy):
            return out
        part = pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts.take(pa.array(easy)), pa.scalar("", texts.type))
        part = pc.replace_substring(part, "\n", MARK + "\n")
        part = pc.replace_substring_regex(part, f"([^ {MARK}])( )", rf"\1{MARK}\2")
        split = pc.split_pattern(part, MARK)
        flat = split.flatten().dictionary_encode()
        counts = self.pretokens(flat.dictionary.to_pylist())
        sums = np.concatenate(([0], np.cumsum(counts[flat.indices.to_numpy()])))
        ends = np.asarray(split.offsets, dtype=np.int64)
        ends = ends - ends[0]
        out[easy] = sums[ends[1:]] - sums[ends[:-1]]
        return out


def counter(model_path: str) -> PieceCounter:
    """The worker's counter of a model; it lives as long as the worker."""
    if model_path not in _models:
        _models[model_path] = PieceCounter(model_path)
    return _models[model_path]


def token_counts(df: DataFrame, text: str, model_path: str, keep: list[str] | None = None) -> DataFrame:
    """``df`` without the text, with n_bytes (UTF-8) and n_tokens.

    Null texts count as empty: no bytes, no tokens. Columns named n_bytes or n_tokens are
    replaced; ``keep`` picks the columns to give back. Rows are kept one for one, repeated
    ones too; an empty table stays empty.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = common.Carried(df, text, "n_bytes long, n_tokens long", keep or [c for c in df.columns if c != text])
    return rows.through(
        lambda texts: (pc.binary_length(texts).cast(pa.int64()), pa.array(counter(model_path).count(texts))), 4 << 20
    )
