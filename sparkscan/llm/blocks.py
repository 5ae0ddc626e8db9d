"""Blocks and slices: exact questions about items that many documents share.

Documents are dealt once into *blocks* of bounded size.  A block condenses what it knows of its
items (hashed windows, lines, signatures) to one entry per distinct item and sends the entries
to *slices*, each a range of the hash values.  A slice answers each block with one bit per
entry, and the block reads its answers beside its own texts.  Entries travel as packed arrays,
never texts or rows; since a block sends an item once, an item that a third of all
documents hold costs a slice at most one entry for each block.

Messages number blocks times slices, so both grow with the square root of the input, up to GROWTH times: 8 times
the memory at 64 GB, and from there on pieces of one size, only more of them.

The dealt blocks are used by several steps of one plan; Spark shuffles the texts once and
reuses that exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import by_number, input_bytes, pick, pieces_for

BLOCK_BYTES = 4 << 20  # of input for each block, up to GROW_FROM of input
SLICE_BYTES = 6 << 20  # of input for each slice
GROW_FROM, GROWTH = 1 << 30, 8
MESSAGE = "block long, slice long, data binary"


def deal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *more, finer: int = 1) -> DataFrame:
    """docs with the block of each row, by id and text: rows of one id need not meet, as all comparisons are by id. finer: so many times more blocks."""
    return by_number(block_of(pick(docs, doc_id, text, *more), docs, finer), blocks_for(docs, finer), "block")


def block_of(rows: DataFrame, docs: DataFrame, finer: int = 1) -> DataFrame:
    """rows with doc_id and text, and their blocks in deal(docs)."""
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks_for(docs, finer))))


def _growth(docs: DataFrame) -> float:
    return min(GROWTH, max(1.0, (input_bytes(docs) / GROW_FROM) ** 0.5))


def blocks_for(docs: DataFrame, finer: int = 1) -> int:
    return pieces_for(docs, int(BLOCK_BYTES * _growth(docs) / finer))


def slices_for(docs: DataFrame, finer: int = 1) -> int:
    return pieces_for(docs, int(SLICE_BYTES * _growth(docs) / finer))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each by planes of equal byte places, which the shuffle's codec then shortens."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], np.int64).tobytes()
    return head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays)


def unpack(data, *types) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for (size, length), kind in zip(head.tolist(), types, strict=True):
        planes = np.frombuffer(data, np.uint8, size * length, at).reshape(size, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size * length
    return out


def slice_of(h: np.ndarray, n: int) -> np.ndarray:
    """Slice of each 64-bit hash: equal ranges of its leading 32 bits, in order."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def messages(block: int, at: np.ndarray, n: int, *arrays: np.ndarray) -> pa.Table:
    """One row for each slice that has entries; at: the sorted slice of each entry."""
    cut = np.searchsorted(at, np.arange(n + 1))
    some = np.flatnonzero(np.diff(cut))
    data = [pack(*(a[cut[s] : cut[s + 1]] for a in arrays)) for s in some]
    return pa.table({"block": pa.array(np.full(len(some), block), pa.int64()), "slice": pa.array(some, pa.int64()), "data": pa.array(data, pa.binary())})


def parts(table: pa.Table, *types) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(block, slice, arrays) of each message, by block and slice."""
    order = np.lexsort((table["slice"].to_numpy(), table["block"].to_numpy()))
    blocks, slices, data = table["block"].to_pylist(), table["slice"].to_pylist(), table["data"]
    for k in order.tolist():
        yield blocks[k], slices[k], unpack(data[k].as_buffer(), *types)


def within(table: pa.Table, low: int, high: int) -> pa.Table:
    """Messages of slices low .. high, numbered from 0."""
    at = table["slice"].to_numpy()
    keep = (at >= low) & (at < high)
    return table.filter(pa.array(keep)).set_column(table.schema.get_field_index("slice"), "slice", pa.array(at[keep] - low, pa.int64()))


def bits(table: pa.Table, at: np.ndarray, n: int, kinds: int = 1):
    """Answers of one or more kinds, put back at the block's entries; no answer is all zeros."""
    out = bits_between(table, np.searchsorted(at, np.arange(n + 1)), kinds)
    return out[0] if kinds == 1 else out


def bits_between(table: pa.Table, cut: np.ndarray, kinds: int) -> np.ndarray:
    """The same, from the first entry of each slice and the number of all, by kind."""
    out = np.zeros((kinds, int(cut[-1])), bool)
    for _, s, data in parts(table, *[np.uint8] * kinds):
        for k, x in enumerate(data):
            out[k, cut[s] : cut[s + 1]] = np.unpackbits(x, count=cut[s + 1] - cut[s]).astype(bool)
    return out


def ask(blocked: DataFrame, emit: Callable[[pa.Table], pa.Table], answer: Callable[[pa.Table], pa.Table], n: int) -> DataFrame:
    """Answers of n slices to what emit makes of each block."""
    return answered(blocked.groupBy("block").applyInArrow(emit, MESSAGE), answer, n)


def answered(asked: DataFrame, answer: Callable[[pa.Table], pa.Table], n: int) -> DataFrame:
    """Answers of n slices to messages."""
    return by_number(asked, n, "slice").groupBy("slice").applyInArrow(answer, MESSAGE)


def with_answers(blocked: DataFrame, answers: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(texts, answers) of each block that has texts."""
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def reply(rows: list[tuple[int, int, np.ndarray]]) -> pa.Table:
    """(block, slice, bits) as messages; those without a set bit need no row."""
    rows = [(b, s, pack(np.packbits(x))) for b, s, x in rows if x.any()]
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "slice": pa.array([r[1] for r in rows], pa.int64()), "data": pa.array([r[2] for r in rows], pa.binary())})


def first_elsewhere(table: pa.Table) -> pa.Table:
    """Answers entries (hash, second hash, document): is the item in a document with a smaller id of another block?

    A slice sorts its range of hashes with document as secondary key and streams the
    first occurrence of each.
    """
    got = [(b, s, *x) for b, s, x in parts(table, np.uint64, np.uint64, np.int64)]
    if not got:
        return reply([])
    h, g, doc = (np.concatenate([x[k] for x in got]) for k in (2, 3, 4))
    order = np.lexsort((doc, g, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    first = doc[order][new][np.cumsum(new) - 1]
    later = np.zeros(len(h), bool)
    later[order] = doc[order] > first
    ends = np.cumsum([0, *(len(x[2]) for x in got)])
    return reply([(x[0], x[1], later[a:b]) for x, a, b in zip(got, ends, ends[1:], strict=False)])


def firsts(h: np.ndarray, g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of items with a document each: (order of one entry per distinct item, entry of each item, smallest document of each entry)."""
    order = np.lexsort((doc, g, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    entry = np.empty(len(h), np.int64)
    entry[order] = np.cumsum(new) - 1
    at = order[new]
    return at, entry, doc[at]
