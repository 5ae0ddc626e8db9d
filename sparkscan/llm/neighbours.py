"""Nearest neighbours by inner product with an inverted multi-index.

The two halves of a vector are quantised separately, so K centroids a half make K * K cells. A
query walks pairs of centroids by falling sum of its inner products with them, from a heap, until
the cells hold a share of all entries; those entries are reranked with the exact measure.  The share
is the least for which PROBES entries find RECALL of their true neighbours, which are sought by brute force among all
entries in every run, so it fits the table's size.  Centroids are fitted on a sample (SAMPLE rows); every row is indexed.

Equal vectors are one entry with their smallest ids, as many as a result needs, so a vector that a
third of all rows hold costs one entry.  Entries go to parts by their cell and queries go to the parts whose cells
they visit; a large cell is spread over several parts, and the queries of a part are cut into blocks that each get its entries. So
a task holds about PART_ROWS entries and BLOCK_QUERIES queries. A query carries the sum of the last pair that it visits, not its cells.

Defined results: vectors that are null, zero, of another length than the table's most common one, or hold a null or
non-finite number take no part; rows with a null id neither; rows with one id are separate entries and may both be
found; fewer candidates than k give fewer rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import by_number, cut

K = 20
EVERY = 20  # rows whose id this divides are the queries
SAMPLE = 4000
RECALL = 0.97  # to reach for the probes, for 0.9 on all
PROBES = 200  # entries whose true neighbours are sought among all
PART_ROWS = 20_000  # entries of a part
BLOCK_QUERIES = 20_000  # of a part, in one task
_FOUND = "query_id long, vec_id long, score double"


def _usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    v = F.col("v")
    rows = vectors.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    top = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).select("n")
    return rows.join(F.broadcast(top), F.size("v") == F.col("n"), "left_semi")


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centroids)
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=len(centroids))
        centroids[count > 0] = total[count > 0] / count[count > 0, None]
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * (x @ centroids.T)).argmin(axis=1) if len(x) else np.zeros(0, np.int64)


class Quantiser:
    def __init__(self, sample: np.ndarray, cells: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.cut = sample.shape[1] // 2
        self.k = max(1, cells)
        self.halves = [_kmeans(x, self.k, rng) for x in (sample[:, : self.cut], sample[:, self.cut :])]
        self.k = len(self.halves[0])

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x[:, : self.cut], self.halves[0]) * self.k + _nearest(x[:, self.cut :], self.halves[1])

    def products(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a query's halves with their centroids."""
        return self.halves[0] @ q[: self.cut], self.halves[1] @ q[self.cut :]

    def sums(self, q: np.ndarray, cells: np.ndarray) -> np.ndarray:
        one, two = self.products(q)
        return one[cells // self.k] + two[cells % self.k]

    def visit(self, q: np.ndarray, count: np.ndarray, least: int) -> list[int]:
        """Non-empty cells by falling sum of products until they hold ``least`` entries."""
        one, two = self.products(q)
        a, b = np.argsort(-one), np.argsort(-two)
        x, y, a, b, counts = (-one[a]).tolist(), (-two[b]).tolist(), a.tolist(), b.tolist(), count.tolist()
        heap, out, held = [(x[0] + y[0], 0, 0)], [], 0
        while heap and held < least:
            _, i, j = heap[0]
            cell = a[i] * self.k + b[j]
            if counts[cell]:
                out.append(cell)
                held += counts[cell]
            # A pair is followed by the next of its row, and the first of a row by the next row's first, so each pair is pushed once.
            if j + 1 < self.k:
                heapq.heapreplace(heap, (x[i] + y[j + 1], i, j + 1))
            else:
                heapq.heappop(heap)
            if not j and i + 1 < self.k:
                heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def true_cells(placed: DataFrame, probes: np.ndarray, owners: np.ndarray, k: int) -> DataFrame:
    """probe, cell: where the k nearest of each probe are, by brute force over all entries. owners: the probes' own least ids."""
    schema = "probe int, cell long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, cell = np.zeros((len(probes), 0)), np.zeros((len(probes), 0), np.int64)
        for b in batches:
            new = probes @ _matrix(b.column(0)).T
            least = pc.list_element(b.column(1), 0).to_numpy()
            new[owners[:, None] == least[None, :]] = -np.inf
            score = np.concatenate((score, new), axis=1)
            cell = np.concatenate((cell, np.broadcast_to(b.column(2).to_numpy(), new.shape)), axis=1)
            if score.shape[1] > k:
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                score, cell = np.take_along_axis(score, top, 1), np.take_along_axis(cell, top, 1)
        probe = np.broadcast_to(np.arange(len(probes), dtype=np.int32)[:, None], score.shape)
        ok = score > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(probe[ok]), pa.array(cell[ok]), pa.array(score[ok])], names=["probe", "cell", "score"])

    found = placed.mapInArrow(run, schema)
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "cell"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("probe", "cell")


def measured_share(probe: np.ndarray, cell: np.ndarray, probes: np.ndarray, quantiser: Quantiser, count: np.ndarray, recall: float) -> float:
    """The least share of entries to visit with which probes reach the recall; probe, cell: where their true neighbours are."""
    every, place = np.arange(quantiser.k**2), []  # share of entries visited when a true neighbour's cell has been
    for i in range(len(probes)):
        order = np.argsort(-quantiser.sums(probes[i], every), kind="stable")
        held = np.empty(len(every))
        held[order] = np.cumsum(count[order])
        place += (held[cell[probe == i]] / count.sum()).tolist()
    if not place:
        return 1.0
    place = np.sort(place)
    return float(place[min(len(place) - 1, int(np.ceil(recall * len(place))))])


def cells_for(n: int) -> int:
    """Centroids of a half: some ten entries a cell, as far as a heap over 256 * 256 pairs is cheap."""
    return int(np.clip(n**0.5 / 3, 2, 256))


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, id_: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score of each query's nearest, by falling score and rising id."""
    rows = cut(_usable(vectors, id_, vector))
    # Equal vectors, with enough of their smallest ids: k and the query's own.
    entries = cut(_collapsed(rows, k + 1))
    n = entries.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    some = entries.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v", F.col("ids")[0].alias("id")).toArrow()
    sample = _matrix(some["v"])
    probes, owners = sample[:PROBES], some["id"].to_numpy()[:PROBES]
    quantiser = Quantiser(sample, cells_for(n))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(quantiser.cells(_matrix(b.column(0))))], names=["v", "ids", "cell"])

    placed = cut(entries.mapInArrow(place, "v array<double>, ids array<long>, cell long"))
    # At most 256 * 256 counts.
    got = placed.groupBy("cell").agg(F.count("*").alias("n")).toPandas()
    count = np.zeros(quantiser.k**2, np.int64)
    count[got.cell.to_numpy(np.int64)] = got.n.to_numpy(np.int64)
    true = true_cells(placed, probes, owners, k).toPandas()  # at most PROBES * k rows
    share = measured_share(true.probe.to_numpy(), true.cell.to_numpy(np.int64), probes, quantiser, count, recall)
    least = int(np.ceil(share * n)) + k
    # Cells are laid end to end and cut into parts of PART_ROWS; a cell may lie in several.
    start = np.cumsum(count) - count
    parts = -(-n // PART_ROWS)
    low, high = start // PART_ROWS, (start + np.maximum(count, 1) - 1) // PART_ROWS

    def to_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column(2).to_numpy()
            spread = high[cell] - low[cell] + 1
            part = low[cell] + np.abs(b.column(3).to_numpy()) % spread
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(part)], names=["v", "ids", "cell", "part"])

    wanted = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-wanted.count() // BLOCK_QUERIES))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out_part, out_floor = [], [], []
            for k_, q in enumerate(_matrix(b.column(1))):
                cells = np.array(quantiser.visit(q, count, least))
                reached = np.zeros(parts + 1, np.int64)  # starts and ends of the cells' runs of parts
                np.add.at(reached, low[cells], 1)
                np.add.at(reached, high[cells] + 1, -1)
                to = np.flatnonzero(np.cumsum(reached)[:-1])
                at += [k_] * len(to)
                out_part += to.tolist()
                out_floor += [quantiser.sums(q, cells[-1:])[0]] * len(to)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(out_part, pa.int64()), pa.array(out_floor, pa.float64())], names=["query_id", "q", "block", "part", "floor"])

    def rerank(queries: pa.Table, part: pa.Table) -> pa.Table:
        ids, scores, found = [], [], []
        if queries.num_rows and part.num_rows:
            held, cell = np.unique(part["cell"].to_numpy(), return_inverse=True)
            x, owners = _matrix(part["v"]), part["ids"].to_pylist()
            for i, q, floor in zip(queries["query_id"].to_pylist(), _matrix(queries["q"]), queries["floor"].to_pylist(), strict=True):
                at = np.flatnonzero((quantiser.sums(q, held) >= floor)[cell])
                score = np.einsum("ij,j->i", x[at], q)  # one order of summing, whatever else is in the part
                if len(at) > 2 * k + 2:
                    edge = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                    at, score = at[score >= edge], score[score >= edge]
                best = sorted((-s, v) for s, a in zip(score.tolist(), at.tolist(), strict=True) for v in owners[a] if v != i)[:k]
                ids += [i] * len(best)
                found += [v for _, v in best]
                scores += [-s for s, _ in best]
        return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.float64())})

    dealt = placed.withColumn("h", F.xxhash64("v")).mapInArrow(to_parts, "v array<double>, ids array<long>, cell long, part long")
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    queries = wanted.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("long"))
    queries = queries.mapInArrow(route, "query_id long, q array<double>, block long, part long, floor double")
    keys = ["part", "block"]
    found = by_number(queries, parts * blocks, *keys).groupBy(*keys).cogroup(by_number(dealt, parts * blocks, *keys).groupBy(*keys)).applyInArrow(rerank, _FOUND)
    return found.groupBy("query_id").applyInArrow(_best(k), schema)


def _best(k: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("score", "descending"), ("vec_id", "ascending")]).slice(0, k)
        return pa.table({"query_id": table["query_id"], "rank": pa.array(np.arange(1, table.num_rows + 1), pa.int32()), "vec_id": table["vec_id"], "score": table["score"]})

    return run


def _collapsed(rows: DataFrame, most: int) -> DataFrame:
    """v and up to ``most`` smallest ids of each distinct vector; copies are thinned in salted groups first, so no group is gathered whole."""
    hot = rows.withColumn("h", F.xxhash64("v")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = hot.withColumn("k", F.row_number().over(Window.partitionBy("h", "v", "salt").orderBy("vec_id"))).where(F.col("k") <= most)
    return few.groupBy("h", "v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, most).alias("ids")).select("v", "ids")
