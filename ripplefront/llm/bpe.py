"""Byte-level BPE ids of many texts, each distinct pre-token encoded once by the library."""

from __future__ import annotations

import json
import sys
import unicodedata

import numpy as np

#: A Python worker keeps the ids of two generations of so many pre-tokens: when the younger is
#: full it becomes the older, of which only those found again are kept on.
CACHE_ENTRIES = 150_000
#: Longer pre-tokens are encoded but not kept.
CACHE_BYTES = 64

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: The code points of the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Fixed value: the contractions that the pre-tokenizer splits off.
CONTRACTIONS = r"'(?:s|t|re|ve|m|ll|d)"

_encoders: dict[str, ByteBpe] = {}


def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], dtype=np.uint8)
    out[WHITE_SPACE] = SPACE
    return out


class ByteBpe:
    """Encodes texts as ``tokenizers`` does with add_special_tokens=False, without padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        step = spec.get("pre_tokenizer") or {}
        self.plain = (
            step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space")
            and not spec.get("normalizer")
        )
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.vocabulary = self.library.get_vocab_size()
        self.classes = _classes()
        self.ascii = np.concatenate((self.classes[:128], np.zeros(128, np.uint8)))
        names = self.library.get_vocab()
        #: Ids whose piece starts with a blank, which this alphabet writes as U+0120.
        self.opens = np.zeros(max(names.values()) + 1, dtype=np.int64)
        self.opens[[i for t, i in names.items() if t[0] == chr(0x120)]] = 1
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.library.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    def kinds(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte's character."""
        kind = self.ascii[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            padded = np.concatenate((data, np.zeros(3, np.uint8)))
            b = [padded[lead + i].astype(np.uint32) for i in range(4)]
            low = [x & 0x3F for x in b]
            code = np.where(
                b[0] < 0xE0, (b[0] & 0x1F) << 6 | low[1],
                np.where(b[0] < 0xF0, (b[0] & 0x0F) << 12 | low[1] << 6 | low[2],
                         (b[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3]),
            )
            found = self.classes[code]
            size = 1 + (b[0] >= 0xC0) + (b[0] >= 0xE0) + (b[0] >= 0xF0)
            for i in range(4):
                kind[lead[size > i] + i] = found[size > i]
        return kind

    def starts(self, data: np.ndarray, kind: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Bytes at which pre-tokens start; ``firsts``: where documents do. White space is ASCII."""
        first = np.zeros(len(data) + 1, dtype=bool)
        first[firsts] = True
        start = first[:-1].copy()
        start[0] = True
        start[1:] |= kind[1:] != kind[:-1]
        blank = kind == SPACE
        # the last blank before a word starts a pre-token; the word does only after another white space
        last = blank[:-1] & ~blank[1:] & ~first[1:-1]
        start[:-1] |= last
        start[1:] &= ~(last & (data[:-1] == 32))
        return np.flatnonzero(start)

    def lookup(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pre-tokens in a row, and how many each has."""
        values = list(map(self.known.get, found))
        new = []
        for i in [i for i, v in enumerate(values) if v is None]:
            v = values[i] = self.older.get(found[i])
            if v is None:
                new.append(i)
            else:
                self.known[found[i]] = v
        # words after a blank are encoded as one text, which splits into them again
        plain = [i for i in new if (t := found[i])[0] == 32 and len(t) > 1 and t[1] not in b"' \t\n\r\x0b\x0c"]
        some = set(plain)
        other = [i for i in new if i not in some]
        if plain:
            texts = [b"".join([found[i] for i in plain[k : k + 256]]).decode() for k in range(0, len(plain), 256)]
            made = np.concatenate([e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])
            self._keep(found, values, plain, made, np.flatnonzero(self.opens[made]))
        if other:
            e = self.library.encode([found[i].decode() for i in other], is_pretokenized=True, add_special_tokens=False)
            self._keep(found, values, other, np.array(e.ids), np.searchsorted(e.word_ids, np.arange(len(other))))
        if len(self.known) > CACHE_ENTRIES:
            self.known, self.older = {}, self.known
        sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
        return np.frombuffer(b"".join(values), dtype=np.uint32), sizes

    def _keep(self, found: list[bytes], values: list, at: list[int], ids: np.ndarray, starts: np.ndarray) -> None:
        data, cuts = ids.astype(np.uint32).tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
        for k, i in enumerate(at):
            values[i] = data[cuts[k] : cuts[k + 1]]
            if len(found[i]) <= CACHE_BYTES:
                self.known[found[i]] = values[i]

    def encode(self, texts) -> list[np.ndarray]:
        """Ids of an Arrow array of texts without nulls."""
        import pyarrow as pa
        import pyarrow.compute as pc

        out: list = [np.zeros(0, dtype=np.uint32)] * len(texts)
        if not len(texts):
            return out
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets[1:] - offsets[0]
        if not len(data):
            return out
        hard = np.asarray(pc.match_substring(texts, "'")).copy()
        if hard.any():
            hard = np.asarray(pc.match_substring_regex(texts, CONTRACTIONS)).copy()
        for s in self.special:
            hard |= np.asarray(pc.match_substring(texts, s))
        kind = self.kinds(data)
        wide = np.flatnonzero((kind == SPACE) & (data >= 0x80))
        hard[np.searchsorted(ends, wide, side="right")] = True
        if not self.plain:
            hard[:] = True
        for i, x in zip(np.flatnonzero(hard), self.whole(texts.filter(pa.array(hard)).to_pylist()), strict=True):
            out[i] = x
        if hard.all():
            return out
        begin = self.starts(data, kind, np.concatenate(([0], ends[:-1])))
        cuts = np.append(begin, len(data)).astype(np.int32)
        flat = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        if hard.any():  # their pre-tokens aren't the library's: leave them out
            flat = flat.take(pa.array(np.flatnonzero(~hard[np.searchsorted(ends, begin, side="right")])))
            begin = begin[~hard[np.searchsorted(ends, begin, side="right")]]
        flat = flat.dictionary_encode()
        store, each = self.lookup(flat.dictionary.to_pylist())
        place = flat.indices.to_numpy()
        sizes = each[place]
        upto = np.cumsum(sizes)
        shift = ((np.cumsum(each) - each)[place] - upto + sizes).astype(np.int32)
        ids = store[np.repeat(shift, sizes) + np.arange(upto[-1] if len(upto) else 0, dtype=np.int32)]
        # pre-tokens of a document are those that start before its end
        stops = np.concatenate(([0], upto))[np.searchsorted(begin, ends)]
        starts = np.concatenate(([0], stops[:-1]))
        for i in np.flatnonzero(~hard).tolist():
            out[i] = ids[starts[i] : stops[i]]
        return out


def encoder(path: str) -> ByteBpe:
    """The worker's encoder of a tokenizer file; it lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]
