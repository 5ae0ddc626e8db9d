"""Token ids of whole texts, by the tokenizers library.

Encoding every occurrence of every word costs far more than encoding every distinct one.
Where the tokenizer's own rules say that no token spans two pieces of a text (white space
always; between letters, single digits and ASCII punctuation in a word of only those),
the text is cut into these pieces, and the library encodes each distinct piece once while
a bounded table remembers its ids.  Any other word goes to the whole tokenizer, and any text
with a special token's string in it goes there uncut.  A tokenizer with other rules is called on
whole texts.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from . import arrays as A

# The rules under which the cuts above are exact.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}

LETTER, DIGIT, MARK, OTHER = 1, 2, 3, 4
_KIND = np.full(256, OTHER, np.uint8)
_KIND[33:127] = MARK
_KIND[39] = OTHER  # an apostrophe may start a contraction
_KIND[48:58] = DIGIT
_KIND[65:91] = _KIND[97:123] = LETTER
_KIND[list(A.SPACES)] = 0

SLOTS = 1 << 22
ENTRIES = 2_000_000
IDS = 9_000_000


def _byte_chars() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + k for k, b in enumerate(rest) if b != 32}


class Encoder:
    def __init__(self, path: str):
        self.full = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        model, pre = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.cuts = (spec["normalizer"] or {}).get("normalizers") == _NORMALIZER and pre[:1] == [_SPLIT] and len(pre) == 2 and pre[1]["type"] == "ByteLevel" and not pre[1]["use_regex"] and not pre[1]["add_prefix_space"] and model.get("end_of_word_suffix") == "</w>" and spec["post_processor"] is None
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        del spec
        self.size = self.full.get_vocab_size()
        if self.cuts:
            if hasattr(self.full.model, "_resize_cache"):
                self.full.model._resize_cache(0)  # the table here takes its place
            self.bare = Tokenizer(self.full.model)
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.last = np.zeros(self.size, bool)
            for token, k in self.full.get_vocab().items():
                self.last[k] = token.endswith("</w>")
            self.chars = _byte_chars()
            self.clear()

    def clear(self) -> None:
        self.key, self.entry = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.start, self.count = np.zeros(ENTRIES, np.int32), np.zeros(ENTRIES, np.int32)
        self.ids = np.zeros(IDS, np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.entries = self.used = 0

    def encode(self, texts: pa.Array):
        """(first row, past the last, ids, offsets by row) of each slab of texts."""
        for i, j, buf, offs in A.slabs(texts):
            if not self.cuts:
                yield i, j, *self._whole([buf[s:e].tobytes() for s, e in zip(offs, offs[1:], strict=False)])
                continue
            raw = buf.tobytes()
            if any(s in raw for s in self.special):
                yield from ((i + k, i + k + 1, *self._one(buf[offs[k] : offs[k + 1]])) for k in range(j - i))
            else:
                yield i, j, *self._cut(buf, offs)

    def _one(self, buf: np.ndarray):
        raw = buf.tobytes()
        if any(s in raw for s in self.special):
            return self._whole([raw])
        return self._cut(buf, np.array([0, len(buf)]))

    def _whole(self, raws: list[bytes]):
        found = [x.ids for x in self.full.encode_batch_fast([r.decode("utf-8", "replace") for r in raws], add_special_tokens=False)]
        ends = np.cumsum([0, *map(len, found)])
        return np.array([x for ids in found for x in ids], np.uint32), ends

    def _cut(self, buf: np.ndarray, offs: np.ndarray):
        kind = _KIND[buf]
        lead = np.flatnonzero(buf[:-1] == 0xC3) if len(buf) else np.zeros(0, np.int64)  # Latin letters of two bytes
        second = buf[lead + 1]
        letter = (second != 0x97) & (second != 0xB7)
        lead, second = lead[letter], second[letter]
        kind[lead] = kind[lead + 1] = LETTER
        upper = lead[(second >= 0x80) & (second <= 0x9E)]
        mixed = kind == OTHER
        if mixed.any():
            ws, we = A.runs(kind != 0, offs)
            seen = np.concatenate(([0], np.cumsum(mixed)))
            odd = seen[we] > seen[ws]
            at = A.ragged(ws[odd], we[odd] - ws[odd])
            kind[at] = OTHER
            upper = upper[kind[upper] == LETTER]
        buf = np.where(kind == LETTER, A.lower_ascii(buf), buf)
        buf[upper + 1] += 0x20
        n = len(buf)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        turn = np.ones(n + 1, bool)
        turn[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        turn[offs] = True
        at = np.flatnonzero(turn)
        starts, ends = at[:-1], at[1:]
        real = kind[starts] != 0
        starts, ends = starts[real], ends[real]
        entry = self._look(buf, starts, ends, kind)
        count = self.count[entry]
        first = A.owners(starts, offs)
        ids = self.ids[A.ragged(self.start[entry], count)].astype(np.uint32)
        total = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        return ids, total[first]

    def _look(self, buf, starts, ends, kind) -> np.ndarray:
        h = A.hash_spans(buf, starts, ends) | np.uint64(1)
        one, two = (h >> np.uint64(8)) % np.uint64(SLOTS), (h >> np.uint64(40)) % np.uint64(SLOTS)
        entry = np.where(self.key[one] == h, self.entry[one], np.where(self.key[two] == h, self.entry[two], -1))
        missed = np.flatnonzero(entry < 0)
        if len(missed):
            new, at, back = np.unique(h[missed], return_index=True, return_inverse=True)
            at = missed[at]
            found, sizes = self._new(buf, starts[at], ends[at], kind[starts[at]])
            if self.entries + len(new) > len(self.start) or self.used + len(found) > len(self.ids):
                if self.entries:
                    self.clear()
                    return self._look(buf, starts, ends, kind)
                self.start, self.count = np.zeros(len(new), np.int32), np.zeros(len(new), np.int32)
                self.ids = np.zeros(max(IDS, len(found)), self.ids.dtype)
            e = np.arange(self.entries, self.entries + len(new))
            self.count[e], self.start[e] = sizes, self.used + np.cumsum(sizes) - sizes
            self.ids[self.used : self.used + len(found)] = found
            self.entries, self.used = self.entries + len(new), self.used + len(found)
            entry[missed] = e[back]
            slot = np.where(self.key[one[at]] == 0, one[at], two[at])
            self.key[slot], self.entry[slot] = new, e
            kept = self.key[slot] == new  # of two new pieces in one slot the last stays
            self.entry[slot[kept]] = e[kept]
        return entry

    def _new(self, buf, starts, ends, kind) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces, and how many each has."""
        raw = buf.tobytes()
        pieces = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        plain = np.flatnonzero(kind != OTHER)
        out: list = [None] * len(pieces)
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096].tolist()
            texts = [b" ".join(pieces[p] for p in part[a : a + 64]).decode("latin-1").translate(self.chars) for a in range(0, len(part), 64)]
            ids = np.array([x for t in self.bare.encode_batch_fast(texts, add_special_tokens=False) for x in t.ids], np.int64)
            cut = np.flatnonzero(self.last[ids]) + 1
            if len(cut) != len(part) or cut[-1] != len(ids):
                raise ValueError("the vocabulary doesn't end words as its rules say")
            for p, x in zip(part, np.split(ids, cut[:-1]), strict=True):
                out[p] = x
        odd = np.flatnonzero(kind == OTHER).tolist()
        for p, x in zip(odd, self.full.encode_batch_fast([pieces[p].decode("utf-8", "replace") for p in odd], add_special_tokens=False), strict=True):
            out[p] = np.array(x.ids, np.int64)
        return np.concatenate(out).astype(self.ids.dtype), np.array([len(x) for x in out], np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Frees the encoders of this worker."""
    _encoders.clear()


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file, on the driver and the executors alike."""
    import public_tokenizers

    return public_tokenizers.path(name)
