"""Line deduplication over range-partitioned line hashes.

A line's key is the line, stripped of ASCII white space and with A-Z lowered.  Each block sends every distinct key once as a
128-bit hash with its smallest document; a slice holds a range of hashes, sorted by hash, then
document, streams the first occurrence of each and answers in bits.  The operator returns a
compressed keep bitmap for each document, never text; ``apply`` can add what is left of the text.

Defined results: a null or empty text has one empty line, which stays; a row with a null id
keeps all its lines and takes none from others; rows with one id count as one document, whose
lines stay or go alike; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import blocks as B

LEAST = 10  # code points of a key

_OUT = {"doc_id": pa.int64(), "n_lines": pa.int64(), "n_dropped": pa.int64(), "keep": pa.binary()}


def _lines(buf: np.ndarray, offs: np.ndarray):
    """Starts and ends of all lines, first line of each document, and starts and ends of their keys."""
    feeds = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate((offs[:-1], feeds + 1)), kind="stable")
    owner_first = np.arange(len(offs)) + np.searchsorted(feeds, offs)
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[owner_first[1:] - 1] = offs[1:]
    solid = np.flatnonzero(A.NOT_SPACE[buf])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = b > a
    ks, ke = starts.copy(), starts.copy()
    ks[some], ke[some] = solid[a[some]], solid[b[some] - 1] + 1
    return starts, ends, owner_first, ks, ke


def _keys(table: pa.Table, least: int):
    """(hash, hash, document) of every line whose key counts, and its place among all lines of the block."""
    ids = table["doc_id"].combine_chunks()
    known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    out, sizes, base = [], [], 0
    for i, j, buf, offs in A.slabs(table["text"]):
        _, _, first, ks, ke = _lines(buf, offs)
        points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
        owner = np.repeat(np.arange(i, j), np.diff(first))
        at = np.flatnonzero((points[ke] - points[ks] >= least) & known[owner])
        low = A.lower_ascii(buf)
        out.append((A.hash_spans(low, ks[at], ke[at], 0, 512), A.hash_spans(low, ks[at], ke[at], 1, 512), ids[owner[at]], at + base))
        sizes.append(np.diff(first))
        base += len(ks)
    h, g, doc, at = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return h, g, doc, at, np.concatenate(sizes) if sizes else np.zeros(0, np.int64)


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, texts: bool = False, digest: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped and keep: a zlib-compressed bitmap with a set bit for each line that stays.

    texts adds ``text``, the lines that stay; digest adds ``kept_sha256`` of it; more names columns to carry along.
    """
    blocked, n = B.deal(docs, doc_id, text, *(F.col(c) for c in more)), B.slices_for(docs)

    def emit(table: pa.Table) -> pa.Table:
        h, g, doc, _, _ = _keys(table, least)
        at, _, first = B.firsts(h, g, doc)
        return B.messages(table["block"][0].as_py(), B.slice_of(h[at], n), n, h[at], g[at], first)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema if f.name in more}

    def keep(table: pa.Table, answers: pa.Table) -> pa.Table:
        h, g, doc, place, sizes = _keys(table, least)
        at, entry, first = B.firsts(h, g, doc)
        later = B.bits(answers, B.slice_of(h[at], n), n)
        stays = np.ones(int(sizes.sum()), bool)
        stays[place] = ~later[entry] & (doc == first[entry])
        ends = np.cumsum(sizes)
        maps, gone, kept = [], [], []
        raws = table["text"].cast(pa.large_binary())
        for k, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
            mine = stays[a:b]
            maps.append(zlib.compress(np.packbits(mine).tobytes(), 1))
            gone.append(b - a - int(mine.sum()))
            if texts or digest:
                raw = raws[k].as_py() or b""
                kept.append(raw if not gone[-1] else b"\n".join(x for x, y in zip(raw.split(b"\n"), mine.tolist(), strict=True) if y))
        out = {"doc_id": table["doc_id"], "n_lines": pa.array(sizes), "n_dropped": pa.array(gone, pa.int64()), "keep": pa.array(maps, pa.binary())}
        if texts:
            out["text"] = pa.array(kept, pa.binary()).cast(pa.string())
        if digest:
            out["kept_sha256"] = pa.array([sha256(x).hexdigest() for x in kept], pa.string())
        return pa.table(out | {c: table[c] for c in more})

    schema = "doc_id long, n_lines long, n_dropped long, keep binary" + ", text string" * texts + ", kept_sha256 string" * digest + "".join(f", `{c}` {kinds[c]}" for c in more)
    return B.with_answers(blocked, B.ask(blocked, emit, B.first_elsewhere, n), keep, schema)
