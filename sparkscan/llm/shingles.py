"""Sets of hashed word shingles, and partition signatures of such sets.

Two sets with 100 * |X & Y| >= 75 * |X | Y| differ in at most (|X| + |Y|) // 7 elements.  Sizes
fall into bands whose upper ends grow by 4/3, so linked sets are in one band or in two neighbouring
ones.  Scheme k serves pairs whose larger set is in band k: a set in band b takes part in
schemes b and b + 1.  Scheme k cuts the hash universe into ``segments(k)`` segments, more than the
largest difference, so linked sets agree on whole segments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from . import arrays as A

WORDS = 5
SLACK = 0.15  # segments beyond the largest difference plus one, which pay for empty and dear ones
DELETIONS = 0.06  # of the segments also carry one-deletion neighbourhoods

_U = np.uint64


def _ends() -> np.ndarray:
    """Upper ends of the bands: 1, 2, 3, 4, ... each the most that 3/4 of a set in the next can be below."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 4 // 3))
    return np.array(out, np.int64)


ENDS = _ends()


def sets(texts, words: int = WORDS):
    """Sorted distinct shingle hashes of all texts, and the first of each text with the total at the end."""
    out, sizes = [], []
    for _, _, buf, offs in A.slabs(texts):
        buf = A.lower_ascii(buf)
        starts, ends = A.runs(A.NOT_SPACE[buf], offs)
        first = A.owners(starts, offs)
        n = np.diff(first)
        h = A.hash_spans(buf, starts, ends)
        at = A.window_starts(first, words)
        key = A.roll(h, words)[at]
        doc = np.repeat(np.arange(len(n)), np.maximum(n - words + 1, 0))
        few = np.flatnonzero((n > 0) & (n < words))
        if len(few):  # the whole sequence as one shingle
            own = np.array([xxhash.xxh3_64_intdigest(h[first[d] : first[d + 1]].tobytes()) for d in few], np.uint64)
            key, doc = np.concatenate((key, own)), np.concatenate((doc, few))
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        out.append(key[new])
        sizes.append(np.bincount(doc[new], minlength=len(n)))
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(size)))


def digests(key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digest of each set, as two signed numbers."""
    raw = memoryview(np.ascontiguousarray(key)).cast("B") if len(key) else memoryview(b"")
    out = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)), np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def segments(scheme: np.ndarray) -> np.ndarray:
    most = 2 * ENDS[scheme] // 7
    return most + 1 + np.ceil(SLACK * most).astype(np.int64) + 2


FREQUENT, ALONE = 1, 2  # marks in the two lowest bits of a candidate's shingles


def marked(key: np.ndarray, frequent: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Shingles with marks: in more than a few sets (the same for all sets), or in no other set."""
    return (key & ~_U(3)) | frequent.astype(np.uint64) | alone.astype(np.uint64) << _U(1)


class Signatures:
    """Signatures of sets of marked shingles, and which of them a set must look up.

    Any partition of the universe into segments will do: sets that differ in fewer elements than one of them has
    non-empty segments agree on one of these.  Here each shingle that few sets hold is a segment of its own, and frequent ones are cut into
    4, 8, 16 ... and lastly ``segments(scheme)`` segments.  A set with many rare shingles needs only a few large segments of frequent
    ones, on which documents from one template seldom agree; it takes the coarsest level that covers its largest difference.

    Every set indexes its segments of all levels: ``set``, ``sig`` and ``kind``, which is 0 for a whole segment, 1 for a
    segment of the last level with one element deleted, 2 for an empty one (only of sets whose other segments can't cover their
    largest difference).  ``allocate`` picks those to look up.
    """

    def __init__(self, key: np.ndarray, first: np.ndarray):
        size = np.diff(first)
        band = np.searchsorted(ENDS, size)
        owner = np.repeat(np.arange(len(size)), size)
        self._cols: list[list[np.ndarray]] = [[], [], [], [], []]
        self._twins: list[tuple[np.ndarray, np.ndarray]] = []  # options of deletions, and of the same whole segments
        self.need = np.zeros(0, np.int64)  # of each (set, scheme), what rare shingles leave to be covered
        frequent, alone = (key & _U(FREQUENT)) > 0, (key & _U(ALONE)) > 0
        rare = np.bincount(owner, ~frequent, len(size)).astype(np.int64)
        mixed = A.finish((key | _U(3)) * _U(0x9E3779B97F4A7C15))
        single = np.flatnonzero(~frequent & ~alone)
        self._add(owner[single], A.finish(mixed[single]), 0, np.full(len(single), -1), np.arange(len(single)))
        self.options = len(single)
        key, mixed, owner = key[frequent] | _U(3), mixed[frequent], owner[frequent]
        for ahead in (0, 1):
            scheme = np.minimum(band + ahead, len(ENDS) - 1)
            # the largest difference from any set that this scheme compares it with
            need = np.where(size > 0, (size + np.minimum(size * 4 // 3, ENDS[scheme])) // 7 + 1 - rare, 0)
            last = segments(scheme)
            pair = np.full(len(size), -1)
            self.need = np.concatenate((self.need, np.maximum(need, 0)))
            pair = len(self.need) - len(size) + np.arange(len(size))
            open_ = need > 0  # not covered by a coarser level
            level = 4
            while True:
                m = np.where(last > level, level, np.where(last * 2 > level, last, 0)) * (size > 0)
                if not m.any():
                    break
                final = m == last
                open_ = self._level(key, mixed, owner, m, final, scheme, pair, need, open_)
                level *= 2
        self.set, self.sig, self.kind, self.pair, self.option = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in self._cols)
        self.sig = self.sig.astype(np.uint64)

    def _level(self, key, mixed, owner, m, final, scheme, pair, need, open_) -> np.ndarray:
        """One cut of the frequent shingles into m segments a set (0: none); returns the sets that are still not covered."""
        sets = len(m)
        base = np.concatenate(([0], np.cumsum(m)))
        pick = m[owner] > 0
        own, k, x = owner[pick], key[pick], mixed[pick]
        slot = base[own] + ((((k * _U(0xC2B2AE3D27D4EB4F)) >> _U(32)) * m[own].astype(np.uint64)) >> _U(32)).astype(np.int64)
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, slot, x)
        count = np.bincount(slot, minlength=base[-1])
        of = np.repeat(np.arange(sets), m)
        place = np.arange(base[-1]) - base[of]
        salt = A.finish(place.astype(np.uint64) + (scheme[of].astype(np.uint64) << _U(40)) + (m[of].astype(np.uint64) << _U(48)))
        some = np.flatnonzero(count)
        whole = np.bincount(of[some], minlength=sets)
        deleted = final[of] & (place < np.ceil(DELETIONS * m).astype(np.int64)[of]) & (count > 1)
        covered = whole + np.bincount(of[deleted], minlength=sets) >= need
        mine = np.where(open_ & (covered | final), pair, -2)  # -2: indexed, not looked up
        self._add(of[some], A.finish(total[some] + salt[some]), 0, mine[of[some]], self.options + some)
        both = np.flatnonzero(deleted)
        self._twins.append((self.options + base[-1] + both, self.options + both))
        drop = np.flatnonzero(deleted[slot])
        self._add(own[drop], A.finish(total[slot[drop]] - x[drop] + salt[slot[drop]]), 1, mine[own[drop]], self.options + base[-1] + slot[drop])
        none = np.flatnonzero((count == 0) & (final & open_ & ~covered)[of])
        self._add(of[none], A.finish(salt[none] ^ _U(0x5555)), 2, mine[of[none]], self.options + none)
        self.options += 2 * int(base[-1])
        return open_ & ~covered

    def _add(self, owner, sig, kind, pair, option) -> None:
        for c, x in zip(self._cols, (owner, sig, np.full(len(owner), kind, np.int8), pair, option), strict=True):
            c.append(x)

    def allocate(self, cost: np.ndarray) -> np.ndarray:
        """Which signatures each set looks up: its rare shingles, and of its level's segments the cheapest.

        An option is a whole segment, or the deletions of one (which add one to what the segment
        covers); cheapest options of a (set, scheme) are taken until they cover its largest difference plus one.
        Deletions count one more only beside their whole segment, so their price has the segment's in it and they come after it.
        """
        if not len(self.sig):
            return np.zeros(0, bool)
        price = np.bincount(self.option, cost, self.options)
        for deleted, whole in self._twins:
            price[deleted] += price[whole]
        at, where = np.unique(self.option, return_index=True)
        pair = self.pair[where]
        order = np.lexsort((price[at], pair))
        at, pair = at[order], pair[order]
        rank = np.arange(len(at)) - np.searchsorted(pair, pair)
        taken = np.zeros(self.options, bool)
        taken[at[(pair == -1) | (pair >= 0) & (rank < self.need[np.maximum(pair, 0)])]] = True
        return taken[self.option]
