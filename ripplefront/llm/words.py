"""Words of many texts at once: runs of letters, digits and marks, in lower case."""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

_tables: dict[str, np.ndarray] = {}


def folded() -> np.ndarray:
    """Each code point's lower case if it is part of a word, else a blank."""
    if "fold" not in _tables:
        out = np.full(sys.maxunicode + 1, 32, dtype=np.uint32)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(chr(c))[0] in "LMN":
                low = chr(c).lower()
                out[c] = ord(low) if len(low) == 1 else c
        _tables["fold"] = out
    return _tables["fold"]


def numbered(texts: list[str]):
    """The words of all texts in a row as numbers, the distinct words, where each text's end.

    Distinct words are an Arrow array of binary values, UTF-32 little-endian.
    """
    import pyarrow as pa

    raw = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "replace"), dtype=np.uint32)
    low = folded()[raw]
    word = low != 32
    start = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
    stop = np.flatnonzero(word & ~np.concatenate((word[1:], [False]))) + 1
    ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
    cuts = np.concatenate(([0], np.cumsum(stop - start))).astype(np.int64) * 4
    flat = low[word].astype("<u4").tobytes()
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cuts), pa.py_buffer(flat)])
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary, ends
