"""Substring deduplication: windows of words that start in an earlier document.

First pass: every block counts its windows (documents that hold each) in a count-min sketch of DEPTH rows of counters, COUNTERS or more a
row for each word of the input. The blocks' sketches are merged by adding them, so a window's least counter never falls below
the number of documents that hold it.
Second pass: only windows whose estimate, less what the block itself added, leaves a document in another block go out, with 128-bit hashes and their
smallest document, and are grouped exactly; none is lost. Windows inside one block are compared there.

Defined results: a null or short text has no windows and keeps its words; a row with a null
id keeps all words and takes none from others; rows with one id don't take from each other; an
empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import blocks as B
from .sketches import Sketch, merge

WIDTH = 13  # words of a window
DEPTH = 2  # rows of the sketch
COUNTERS = 8  # a row for each word, at least


def _windows(table: pa.Table, width: int):
    """128-bit hash, document and first word of every window of the block; words by document."""
    ids = table["doc_id"].combine_chunks()
    known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    out, sizes, base = [], [], 0
    for i, j, buf, offs in A.slabs(table["text"]):
        starts, ends = A.runs(A.NOT_SPACE[buf], offs)
        first = A.owners(starts, offs)
        at = A.window_starts(first, width)
        owner = np.repeat(np.arange(i, j), np.maximum(np.diff(first) - width + 1, 0))
        at, owner = at[known[owner]], owner[known[owner]]
        out.append((*(A.roll(A.hash_spans(buf, starts, ends, k), width, k)[at] for k in (0, 1)), ids[owner], at + base))
        sizes.append(np.diff(first))
        base += len(starts)
    h, g, doc, at = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return h, g, doc, at, np.concatenate(sizes) if sizes else np.zeros(0, np.int64)


def _holders(h: np.ndarray, g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each distinct window of a block, and how many documents hold it."""
    order = np.lexsort((doc, g, h))
    h, g, doc = h[order], g[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    return h[first], g[first], np.add.reduceat(other, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, texts: bool = False, depth: int = DEPTH, counters: int = COUNTERS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (texts adds ``text``), by row of docs."""
    blocked, n = B.deal(docs, doc_id, text), B.slices_for(docs)
    sketch = Sketch.sized(docs, depth, counters, n)

    def count(table: pa.Table) -> pa.Table:
        h, g, doc, _, _ = _windows(table, width)
        return sketch.messages(*_holders(h, g, doc), table["block"][0].as_py())

    def exact(table: pa.Table, answers: pa.Table) -> pa.Table:
        h, g, doc, _, _ = _windows(table, width)
        seen = np.flatnonzero(sketch.elsewhere(h, g, answers))
        at, _, first = B.firsts(h[seen], g[seen], doc[seen])
        at = seen[at]
        return B.messages(table["block"][0].as_py(), B.slice_of(h[at], n), n, h[at], g[at], first)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        h, g, doc, place, sizes = _windows(table, width)
        at, entry, first = B.firsts(h, g, doc)
        sent = sketch.elsewhere(h[at], g[at], answers)  # a window's entries share its hashes, so all or none are sent
        later = np.zeros(len(at), bool)
        later[sent] = B.bits(B.within(answers, depth * n, (depth + 1) * n), B.slice_of(h[at[sent]], n), n)
        gone = later[entry] | (doc > first[entry])
        words = np.zeros(int(sizes.sum()) + width, bool)
        start = place[gone]
        for d in range(width):
            words[start + d] = True
        ends = np.cumsum(sizes)
        removed, digests, kept = [], [], []
        raws = table["text"].cast(pa.large_binary())
        for k, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
            mine = words[a:b]
            removed.append(int(mine.sum()))
            own = (raws[k].as_py() or b"").split()
            left = b" ".join(own if not removed[-1] else [w for w, x in zip(own, mine.tolist(), strict=True) if not x])
            digests.append(sha256(left).hexdigest())
            if texts:
                kept.append(left)
        out = {"doc_id": table["doc_id"], "n_words": pa.array(sizes), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"text": pa.array(kept, pa.binary()).cast(pa.string())} if texts else {}))

    estimates = B.ask(blocked, count, merge(), depth * n)
    answers = B.answered(B.with_answers(blocked, estimates, exact, B.MESSAGE), B.first_elsewhere, n)
    both = estimates.unionByName(answers.withColumn("slice", F.col("slice") + depth * n))
    return B.with_answers(blocked, both, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * texts)
