"""N-gram Jaccard join of documents: links, and the groups that they make.

1. Each document's set is hashed; documents with equal sets are one class, held by its least id.
2. A linked set has at least 3/4 of its shingles in another set.  A sparse counting sketch of shingles
   over blocks and slices never counts too low, so sets with fewer shared shingles are out; the rest are candidates.
3. Candidates' universe-partition signatures go to slices of the signature space.  A set looks up the cheapest
   signatures that cover its largest difference (a bounded sketch counts signatures over all candidates), and a signature that
   anybody looks up ties its holders, of sizes that may link, to the least of them: one row a holder, not one a pair.
4. Tied candidates are a cluster.  One shared shingle may tie two sets, so clusters of a large corpus run into each other.  Those of
   more than TILE sets are first cut by parity sketches, a bit or two for each shingle: two sets differ in no fewer shingles than
   their sketches in bits, so pairs of which these differ too much can't link, and only what the others tie stays together.
5. A cluster's sets are compared exactly by an inverted index of their shingles, which counts what
   a set shares with all others at once.  A cluster of more than TILE sets is cut into tiles of sets of one band of sizes, and each pair
   of tiles of one or two neighbouring bands is one task, so no task holds more than 2 * TILE sets.  Every link is counted for both of its sets; of the links themselves only
   those that tie something new are returned, as a dense cluster has as many as its pairs.

Defined results: a null, empty or wordless text has no shingles and links with nothing; fewer words than WORDS
make one shingle; rows with one id are one vertex that has the links of each of them; n_links counts the other sets (not
documents: copies are one set) that the row's set links with, also for copies; a row with a null id has no links counted, a null component and links with nothing; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import blocks as B
from . import shingles as S
from .components import components
from .sketches import Sketch, merge, repeated
from .tables import batch, by_number, cut, pick

FINER = 2  # times as many blocks and slices as other operators have: here a word takes several arrays of eight bytes
CELLS = 1 << 16  # of the cost sketch
COUNTERS = 32  # of the sketch of shingles, for each word
FEW = 6  # sets that hold a rare shingle, at most
FIRST = 16  # one of so many slices of signatures ties first
TILE = 4096  # sets of a cluster that one task compares with as many others
CANDIDATES = "doc_id long, n int, keys binary"
_BASE = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])
_CAND = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("keys", pa.binary())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _rows(b: pa.RecordBatch, most: int = 2000) -> Iterator[pa.RecordBatch]:
    for i in range(0, b.num_rows, most):
        yield b.slice(i, most)


def sets_of(docs: DataFrame, words: int = S.WORDS) -> DataFrame:
    """block, doc_id, n_shingles and a 128-bit digest of the set, by row of docs with their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _rows(b):
                key, first = S.sets(part.column(1), words)
                yield batch(_BASE, part.column(2), part.column(0), np.diff(first), *S.digests(key, first))

    return docs.select("doc_id", "text", "block").mapInArrow(run, "block long, doc_id long, n_shingles long, k1 long, k2 long")


def _unpack_sets(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array(pc.binary_length(keys), np.int64) // 8
    raw = b"".join(x.as_buffer().to_pybytes() for x in keys)
    return np.frombuffer(raw, np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def candidates(docs: DataFrame, base: DataFrame, words: int, percent: int) -> DataFrame:
    """Class holders of whose shingles enough are estimated to be in other sets, with their sets."""
    blocked, n = B.deal(docs, finer=FINER), B.slices_for(docs, FINER)
    counter = Sketch.sized(docs, 1, COUNTERS, n)
    holders = base.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "block")).alias("least"))
    dealt = holders.select("least.block", F.lit(-1).cast("long").alias("slice"), "least.doc_id", "k1")

    def listed(table: pa.Table) -> pa.Table:
        return pa.table({"block": table["block"].slice(0, 1), "slice": table["slice"].slice(0, 1), "data": pa.array([B.pack(table["doc_id"].to_numpy(), table["k1"].to_numpy())], pa.binary())})

    lists = dealt.groupBy("block").applyInArrow(listed, B.MESSAGE)

    def mine(table: pa.Table, answers: pa.Table):
        """Ids and sets of the block's class holders."""
        key, first = S.sets(table["text"], words)
        held = {}
        for _, _, (ids, k1) in B.parts(answers.filter(pc.equal(answers["slice"], -1)), np.int64, np.int64):
            held = set(zip(ids.tolist(), k1.tolist(), strict=True))
        ids, k1 = table["doc_id"].to_pylist(), S.digests(key, first)[0].tolist()
        take = []
        for k, x in enumerate(zip(ids, k1, strict=True)):
            if x in held:
                held.discard(x)
                take.append(k)
        sizes, some = np.diff(first), np.zeros(len(ids), bool)
        some[take] = True
        return np.array([ids[k] for k in take], np.int64), key[np.repeat(some, sizes)], np.concatenate(([0], np.cumsum(sizes[some])))

    def sketch(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return B.reply([])
        key = mine(table, answers)[1]
        return counter.messages(key, key, None, table["block"][0].as_py())

    def choose(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, key, first = mine(table, answers)
        elsewhere, frequent = counter.elsewhere(key, key, answers, 2)
        shared = elsewhere | repeated(counter.cells(key, key, 0))  # a set has a shingle once, so twice is in two sets
        key = S.marked(key, frequent, ~shared)
        total = np.concatenate(([0], np.cumsum(shared)))
        size = np.diff(first)
        take = np.flatnonzero(100 * (total[first[1:]] - total[first[:-1]]) >= percent * size)
        return pa.table([pa.array(ids[take]), pa.array(size[take].astype(np.int32)), pa.array([np.sort(key[first[k] : first[k + 1]]).tobytes() for k in take], pa.binary())], schema=_CAND)

    estimates = B.answered(B.with_answers(blocked, lists, sketch, B.MESSAGE), merge(FEW), n)
    return B.with_answers(blocked, lists.unionByName(estimates), choose, CANDIDATES)


def costs(cand: DataFrame) -> np.ndarray:
    """How many signatures of all candidates fall into each of CELLS cells: never too low, and of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(CELLS, np.int64)
        for b in batches:
            for part in _rows(b):
                sigs = S.Signatures(*_unpack_sets(part.column(2)))
                out += np.bincount((sigs.sig % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["cell", "n"])

    got = cand.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS, np.int64)
    out[got.cell.to_numpy(np.int64)] = got.n.to_numpy(np.int64)
    return out


def ties(cand: DataFrame, n: int, percent: int, cost: np.ndarray) -> DataFrame:
    """Distinct (a, b): candidates that a looked-up signature ties, b to the least holder a of sizes that may link.

    Near copies agree on many signatures, and each would tie them again in its slice.  So the first slices, a share of 1 / FIRST of all signatures,
    answer first; what they tie goes on under one name, and the other slices return only what ties something new.
    """
    few = -(-n // FIRST)
    first = cut(_tied(cand.select("doc_id", "n", "keys"), n, 0, few, percent, cost).distinct())
    if few == n:
        return first
    least = first.groupBy("b").agg(F.min("a").alias("a"))
    names = least.join(least.select(F.col("b").alias("a"), F.col("a").alias("next")), "a", "left").select(F.col("b").alias("doc_id"), F.coalesce("next", "a").alias("name"))
    named = cand.join(names, "doc_id", "left").select(F.coalesce("name", "doc_id").alias("doc_id"), "n", "keys")
    return first.unionByName(_tied(named, n, few, n, percent, cost).distinct())


def _tied(cand: DataFrame, n: int, low: int, high: int, percent: int, cost: np.ndarray) -> DataFrame:
    """What slices low .. high of n tie, once for each slice. Several sets may have one name in doc_id."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _rows(b):
                ids, size = part.column(0).to_numpy(), part.column(1).to_numpy()
                sigs = S.Signatures(*_unpack_sets(part.column(2)))
                if not len(sigs.sig):
                    continue
                look = sigs.allocate(cost[(sigs.sig % np.uint64(CELLS)).astype(np.int64)])
                order = np.argsort(sigs.sig)
                order = order[slice(*np.searchsorted(B.slice_of(sigs.sig[order], n), (low, high)))]
                own, sig = sigs.set[order], sigs.sig[order]
                packed = (size[own].astype(np.int64) * 2 + look[order]).astype(np.uint32)
                yield from B.messages(0, B.slice_of(sig, n), n, sig, ids[own], packed).select(["slice", "data"]).combine_chunks().to_batches()

    def meet(table: pa.Table) -> pa.Table:
        got = [B.unpack(x.as_buffer(), np.uint64, np.int64, np.uint32) for x in table["data"]]
        sig, doc, size = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((size, sig))
        sig, doc, look, size = sig[order], doc[order], (size[order] & 1).astype(bool), (size[order] >> 1).astype(np.int64)
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (100 * size[:-1] < percent * size[1:])  # a gap in sizes that no link spans
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        sought = np.logical_or.reduceat(look, start)[group]
        hub = np.minimum.reduceat(doc, start)[group]
        ok = sought & (hub != doc)
        pairs = np.unique(np.stack((hub[ok], doc[ok]), axis=1), axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_PAIR)

    return cand.mapInArrow(emit, "slice long, data binary").groupBy("slice").applyInArrow(meet, "a long, b long")


def links_of(ids: np.ndarray, key: np.ndarray, first: np.ndarray, percent: int, left: np.ndarray | None = None) -> tuple[list[int], list[int], np.ndarray]:
    """Links among sets, without those that tie nothing new, and the number of all links of each set; with left, only between sets that differ in it."""
    size = np.diff(first)
    owner = np.repeat(np.arange(len(ids)), size)
    shared = (key & np.uint64(S.ALONE)) == 0
    key, owner = key[shared], owner[shared]
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(key)))
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(new) - 1
    holders = owner[order]
    mine = np.searchsorted(owner, np.arange(len(ids) + 1))
    label, a, b, n = np.arange(len(ids)), [], [], np.zeros(len(ids), np.int64)
    for x in range(len(ids)):
        own = group[mine[x] : mine[x + 1]]
        own = own[count[own] > 1]
        if not len(own):
            continue
        both = np.bincount(holders[A.ragged(start[own], count[own])], minlength=len(ids))
        ok = 100 * both >= percent * (size + size[x] - both)
        ok[x] = False
        if left is not None:
            ok &= left != left[x]
        n[x] = np.count_nonzero(ok)
        ok &= label != label[x]
        for y in np.flatnonzero(ok).tolist():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                a.append(int(ids[x]))
                b.append(int(ids[y]))
    return a, b, n


def _tiled(rows: DataFrame, *more: str) -> DataFrame:
    """Rows (cluster, doc_id, n) once for each pair (i, j) of tiles that they are in; right: the row's tile is j and not i. A cluster of up to TILE sets is
    one tile; tiles of larger ones hold sets of one band, and meet those of their own and the neighbouring bands, as no others link."""
    band = F.size(F.filter(F.array(*(F.lit(int(x)) for x in S.ENDS)), lambda end: end < F.col("n")))
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("size"))
    rows = rows.join(sizes, "cluster").withColumn("band", F.when(F.col("size") > TILE, band).otherwise(0))
    own = rows.groupBy("cluster", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("own"))
    tiles = own
    for name, step in (("below", 1), ("above", -1)):
        tiles = tiles.join(own.select("cluster", (F.col("band") + step).alias("band"), F.col("own").alias(name)), ["cluster", "band"], "left")
    tiles = tiles.na.fill(0, ["below", "above"])
    rows = rows.join(tiles, ["cluster", "band"]).withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("own")).cast("int"))
    number = lambda step, tile: F.shiftleft((F.col("band") + step).cast("long"), 32) + tile
    mine = number(0, F.col("tile"))

    def pairs(step: int, count: str):
        other = F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(other, lambda x: number(step, x))

    spread = rows.withColumn("other", F.explode(F.concat(pairs(0, "own"), pairs(-1, "below"), pairs(1, "above"))))
    return spread.select("cluster", F.least(mine, "other").alias("i"), F.greatest(mine, "other").alias("j"), (mine > F.col("other")).alias("right"), "doc_id", "n", *more)


def parities(key: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """A sketch of each set: the parity of how many of its shingles fall on each of as many bits as its band may have shingles, or up to twice as many."""
    mixed = A.finish((key | np.uint64(3)) * np.uint64(0xA0761D6478BD642F))
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        bits = max(64, 1 << int(S.ENDS[np.searchsorted(S.ENDS, b - a)] - 1).bit_length())
        odd = np.bincount((mixed[a:b] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64))
    return out


def possible(ids: np.ndarray, size: np.ndarray, odd: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Pairs, enough of them to tie all sets that may link as far as their sketches tell; with left, only between sets that differ in it."""
    width = min(len(x) for x in odd)
    words = np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in odd], axis=1)  # a longer sketch is folded
    label, a, b = np.arange(len(ids)), [], []
    for x in range(len(ids) - 1):
        differ = np.bitwise_count(words[:, x + 1 :] ^ words[:, x, None]).sum(axis=0, dtype=np.int64)
        ok = (100 + percent) * np.maximum(differ, np.abs(size[x + 1 :] - size[x])) <= (100 - percent) * (size[x + 1 :] + size[x])
        if left is not None:
            ok &= left[x + 1 :] != left[x]
        ok &= label[x + 1 :] != label[x]
        for y in (np.flatnonzero(ok) + x + 1).tolist():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                a.append(int(ids[x]))
                b.append(int(ids[y]))
    return a, b


def refined(cand: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """found (vertex, component), with components of more than TILE sets cut where sketches tell that no link crosses; sets that link with none are left out."""
    large = found.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") > TILE).select("component")
    if large.isEmpty():
        return found

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _rows(b):
                odd = parities(*_unpack_sets(part.column(3)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([x.tobytes() for x in odd], pa.binary())], names=["cluster", "doc_id", "n", "odd"])

    def run(table: pa.Table) -> pa.Table:
        right = table["right"].to_numpy()
        across = table["i"][0].as_py() != table["j"][0].as_py()
        odd = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["odd"]]
        a, b = possible(table["doc_id"].to_numpy(), table["n"].to_numpy().astype(np.int64), odd, percent, right if across else None)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIR)

    tied = found.join(large, "component").select(F.col("component").alias("cluster"), F.col("vertex").alias("doc_id"))
    sketched = cut(cand.join(tied, "doc_id").select("cluster", "doc_id", "n", "keys").mapInArrow(emit, "cluster long, doc_id long, n int, odd binary"))
    again = components(cut(_tiled(sketched, "odd").groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")))
    return found.join(large, "component", "left_anti").select("vertex", "component").unionByName(again)


def verified(clusters: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside clusters, enough of them to tie all that link, and rows (a, a, n) with numbers of links of a's set, to be
    added up; clusters has doc_id, n (of shingles), keys and cluster."""

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        across = table["i"][0].as_py() != table["j"][0].as_py()
        key, first = _unpack_sets(table["keys"].combine_chunks())
        ids = table["doc_id"].to_numpy()
        a, b, n = links_of(ids, key, first, percent, table["right"].to_numpy() if across else None)
        some = np.flatnonzero(n)
        return pa.table({"a": pa.array([*a, *ids[some].tolist()], pa.int64()), "b": pa.array([*b, *ids[some].tolist()], pa.int64()), "n": pa.array([*[0] * len(a), *n[some].tolist()], pa.int64())})

    return _tiled(clusters, "keys").groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long, n long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = S.WORDS, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links by row of docs; two sets link when 100 * shared >= percent * union (75 or more)."""
    if percent < 75:
        raise ValueError("the segments' numbers hold for 75 percent and more")
    docs = pick(docs, doc_id, text)
    base = cut(sets_of(B.block_of(docs, docs, FINER), words))
    n = B.slices_for(docs, FINER)
    cand = cut(candidates(docs, base, words, percent))
    found = refined(cand, components(ties(cand, n, percent, costs(cand))), percent).select(F.col("vertex").alias("doc_id"), F.col("component").alias("cluster"))
    links = cut(verified(cand.join(found, "doc_id").select("doc_id", "n", "keys", "cluster"), percent))
    numbers = links.where("n > 0").groupBy(F.col("a").alias("holder")).agg(F.sum("n").alias("n_links"))
    holders = base.where("n_shingles > 0 and doc_id is not null")
    # A row's set may be held by another id; rows with one id tie their sets together.
    classes = holders.groupBy("k1", "k2").agg(F.min("doc_id").alias("holder"))
    held = holders.join(classes, ["k1", "k2"])
    other = held.where("doc_id <> holder").select(F.col("holder").alias("a"), F.col("doc_id").alias("b"))
    repeated = holders.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    tied = other.join(repeated.select(F.col("doc_id").alias("b")), "b").select("a", "b")
    links = components(links.where("a <> b").select("a", "b").unionByName(tied)).select(F.col("vertex").alias("holder"), "component")
    groups = classes.join(links, "holder", "left").join(numbers, "holder", "left").select("k1", "k2", F.coalesce("component", "holder").alias("component"), "n_links")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    number = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("n_links"))
    return base.join(groups, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, own).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce(number, F.lit(0)).alias("n_links"))
