"""Count-min sketches of items that blocks hold, merged by adding them up.

A sketch has ``depth`` rows of 2**bits counters. A block adds to one counter a row for each of its items; counters of all
blocks are added, and the least of an item's counters is never below its true count, as others may share a
counter but nobody takes away. The counters of a large input don't fit into one machine, so a block's sketch is sent sparse (counter
and count), cut into slices by row and counter; a slice adds up what the blocks send and answers each entry in bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A
from . import blocks as B
from .tables import input_bytes


@dataclass(frozen=True)
class Sketch:
    depth: int
    bits: int
    slices: int  # a row is cut into

    @classmethod
    def sized(cls, docs: DataFrame, depth: int, counters: int, slices: int) -> Sketch:
        """With ``counters`` a row or up to twice as many for each word, of which input bytes are 3 to 8."""
        bits = max(24, (counters * input_bytes(docs) // 4).bit_length())
        return cls(depth, min(bits, 31 + slices.bit_length() - 1, 60), slices)  # a step between counters of a slice stays under 2**32

    def cells(self, h: np.ndarray, g: np.ndarray, row: int) -> np.ndarray:
        """Counters of items in a row, from two hashes of each."""
        mixed = (h, g)[row] if row < 2 else A.finish(h + np.uint64(row) * g)
        return mixed >> np.uint64(64 - self.bits)

    def edges(self, cells: np.ndarray) -> np.ndarray:
        """First of the sorted cells of each slice of a row, and the number of all; slices are as B.slice_of has them."""
        first = [(-(-(s << 32) // self.slices) << 32) for s in range(self.slices)]
        step = 1 << (64 - self.bits)
        return np.append(np.searchsorted(cells, np.array([-(-x // step) for x in first], np.uint64)), len(cells))

    def messages(self, h: np.ndarray, g: np.ndarray, count: np.ndarray | None, block: int) -> pa.Table:
        """A block's sketch of items and their counts (none: 1 each): steps from counter to counter, and what is added to each."""
        parts = []
        for row in range(self.depth):
            cells = self.cells(h, g, row)
            if count is None:
                added, cells = None, np.sort(cells)
            else:
                order = np.argsort(cells)
                added, cells = count[order], cells[order]
                del order
            edges = self.edges(cells)
            for s in np.flatnonzero(np.diff(edges)).tolist():
                own = cells[edges[s] : edges[s + 1]]
                first = np.flatnonzero(starts(own))
                total = np.diff(first, append=len(own)) if added is None else np.add.reduceat(added[edges[s] : edges[s + 1]], first)
                own = own[first]
                parts.append((block, s + row * self.slices, B.pack(own[:1], np.diff(own, prepend=own[:1]).astype(np.uint32), total.astype(np.uint32))))
        return _rows(parts)

    def elsewhere(self, h: np.ndarray, g: np.ndarray, answers: pa.Table, kinds: int = 1) -> np.ndarray:
        """A block's answers at its items: the first kind (added to by another block) where every row says so, the others from the first row."""
        out = None
        for row in range(self.depth):
            cells = self.cells(h, g, row)
            order = np.argsort(cells)
            cells = cells[order]
            new = starts(cells)
            cells = cells[new]
            bits = B.bits_between(B.within(answers, row * self.slices, (row + 1) * self.slices), self.edges(cells), kinds)
            del cells
            got = np.empty((kinds, len(order)), bool)
            which = np.cumsum(new, dtype=np.uint32)
            which -= np.uint32(1)
            for k in range(kinds):
                got[k, order] = bits[k, which]
            del order, new, bits, which
            if out is None:
                out = got
            else:
                out[0] &= got[0]
        return out if kinds > 1 else out[0]


# Sorted runs in place of np.unique, whose inverse and counts hold several times the memory.


def starts(cells: np.ndarray) -> np.ndarray:
    """Of sorted cells, is each the first of its value?"""
    new = np.ones(len(cells), bool)
    np.not_equal(cells[1:], cells[:-1], out=new[1:])
    return new


def repeated(cells: np.ndarray) -> np.ndarray:
    """Is each cell there more than once?"""
    order = np.argsort(cells)
    same = ~starts(cells[order])
    out = np.zeros(len(cells), bool)
    out[order] = same
    out[order[:-1]] |= same[1:]
    return out


def merged(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(block, slice) and length of each message, and of each entry its counter, what the block added and the sum of all blocks."""
    heads, cells, own = [], [], []
    for b, s, (first, steps, count) in B.parts(table, np.uint64, np.uint32, np.uint32):
        heads.append((b, s, len(steps)))
        cells.append(np.cumsum(steps.astype(np.uint64)) + first[0])
        own.append(count)
    cells = np.concatenate([np.zeros(0, np.uint64), *cells])
    own = np.concatenate([np.zeros(0, np.uint32), *own])
    if not len(own):
        return heads, cells, own, np.zeros(0, np.int64)
    order = np.argsort(cells)
    new = starts(cells[order])
    sums = np.add.reduceat(own[order], np.flatnonzero(new), dtype=np.int64)
    total = np.empty(len(own), np.int64)
    total[order] = sums[np.cumsum(new, dtype=np.uint32) - np.uint32(1)]
    return heads, cells, own, total


def merge(few: int | None = None):
    """Answers of a slice: did another block add to the counter; with few, is its sum above that too?"""

    def answer(table: pa.Table) -> pa.Table:
        heads, own, total = (x for k, x in enumerate(merged(table)) if k != 1)
        ends = np.cumsum([0, *(n for _, _, n in heads)])
        out = []
        for (b, s, _), i, j in zip(heads, ends, ends[1:], strict=False):
            kinds = [total[i:j] > own[i:j]] + ([] if few is None else [total[i:j] > few])
            if any(x.any() for x in kinds):
                out.append((b, s, B.pack(*(np.packbits(x) for x in kinds))))
        return _rows(out)

    return answer


def _rows(parts: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"block": pa.array([x[0] for x in parts], pa.int64()), "slice": pa.array([x[1] for x in parts], pa.int64()), "data": pa.array([x[2] for x in parts], pa.binary())})
