"""Packing by lexical retrieval: an unused neighbour of the seed document comes next.

A window's seed is the document that it starts in; all terms of the seed retrieve neighbours by
BM25 over the whole corpus, and unused ones fill the window, best first.  A document that
outruns its window is cut and seeds the next one.  Every window is full but for the end of the
last, which is cut into lengths that are powers of two, so no sequence has any padding.

A table of one shard is packed in one task.  A larger one is dealt into shards of bounded size;
document frequencies and the mean length are counted over all of them (``Shards``), and many
chains of windows grow in rounds (``chains``): a round asks all shards for the best unused neighbours of every
chain's seed.  A document that several seeds ask for goes to the one it scores higher with, and
a seed asks again until its window is full or no unused neighbour is left anywhere.  Then the next
unused document follows.  What a chain ends with behind its last full window is packed with
the other chains' ends.  Texts and terms stay in the shards; the driver holds some tens of bytes a document.
The work of exact retrieval grows with windows times documents.

Defined results: a null or empty text has its end id alone; rows with the same id are separate
documents; a null id is kept; an empty table gives no rows; only the id and text columns are
read.  ``sequence_id`` numbers the sequences from 0.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import tokens
from .blocks import MESSAGE, messages, pack as packed, parts, slice_of, unpack
from .tables import BATCH, freed, pick, pieces_for, remove, setting, settle, shared_dir, trim

WINDOW = 2048
END = 1
SHARD_BYTES = 3 << 20  # of input for each shard
K1, B = 1.2, 0.75
ROUNDS = 12  # that fill all windows, if every chain fills one a round
CHAINS = 1 << 13  # at most
ANSWERS = 16  # neighbours a seed gets in a round at least; it asks again for more
MOST = 1 << 19  # answers that the driver gets in a round beyond ANSWERS a seed, in all
ASKED = 1 << 24  # tokens of the seeds whose terms are asked for at once, or one seed
READS = 16  # parts at most in which the driver reads the seeds' terms
UNITS = 1e6  # of a score of 1: scores are compared as whole numbers
CELLS = 1 << 18  # of a piece of the score matrix
QUERIES = 512  # whose lists are merged at once

OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def postings(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(hash of the word, document, count) by hash and document, and the words of each document."""
    keys, docs, sizes = [], [], []
    for i, _, buf, offs in A.slabs(texts):
        starts, ends = A.runs(A.NOT_SPACE[buf], offs)
        n = np.diff(A.owners(starts, offs))
        keys.append(A.hash_spans(A.lower_ascii(buf), starts, ends))
        docs.append(np.repeat(np.arange(i, i + len(n), dtype=np.int32), n))
        sizes.append(n)
    key, doc, size = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (docs, np.int32), (sizes, np.int64)))
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return key[at], doc[at], np.diff(np.append(at, len(key))), size


def weights(idf: np.ndarray, tf: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / max(mean, 1)))


class Index:
    """BM25 over documents in memory."""

    def __init__(self, texts: pa.Array):
        key, doc, tf, size = postings(texts)
        self.n = len(size)
        term = np.cumsum(np.append(0, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        df = np.bincount(term)
        shared = df[term] > 1  # a term of one document retrieves nothing
        term, doc, tf = term[shared], doc[shared], tf[shared]
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        self.weight = weights(idf[term], tf, size[doc], size.mean()) if len(term) else np.zeros(0)
        self.doc = doc
        self.first = np.searchsorted(term, np.arange(len(df) + 1))
        by_doc = np.lexsort((term, doc))
        self.query = term[by_doc]
        self.query_of = np.searchsorted(doc[by_doc], np.arange(self.n + 1))

    def neighbours(self, seed: int, used: np.ndarray) -> list[int]:
        """All unused documents that share a term with the seed, best first, ties to the earlier."""
        terms = self.query[self.query_of[seed] : self.query_of[seed + 1]]
        if not len(terms):
            return []
        at = A.ragged(self.first[terms], self.first[terms + 1] - self.first[terms])
        score = np.bincount(self.doc[at], self.weight[at], self.n)
        score[used] = 0
        found = np.flatnonzero(score)
        return found[np.lexsort((found, -score[found]))].tolist()


def order(index: Index, sizes: np.ndarray) -> list[int]:
    """The order in which documents fill the windows."""
    used, out, queue, at, following = np.zeros(index.n, bool), [], iter(()), 0, 0
    while len(out) < index.n:
        doc = next((d for d in queue if not used[d]), -1)
        alone = doc < 0  # the seed has no unused neighbour left
        if alone:
            while used[following]:
                following += 1
            doc = following
        used[doc] = True
        out.append(doc)
        before, at = at // WINDOW, at + int(sizes[doc])
        if at // WINDOW != before or alone:  # it starts the next window, or it is a new seed
            queue = iter(index.neighbours(doc, used) if at % WINDOW else ())
    return out


def sequences(total: int) -> np.ndarray:
    """Starts of the sequences of a stream: full windows, then powers of two."""
    full, rest = divmod(total, WINDOW)
    starts, at = [k * WINDOW for k in range(full)], full * WINDOW
    for bit in range(WINDOW.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            starts.append(at)
            at += 1 << bit
    return np.array(starts, np.int64)


def _pack(vocabulary: str, end: int):
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        texts = shard.column("text").combine_chunks()
        ids, sizes = [], []
        for _, _, x, offs in tokens.encoder(vocabulary).encode(texts):
            ids.append(np.insert(x, offs[1:], end))
            sizes.append(np.diff(offs) + 1)
        ids, sizes = np.concatenate(ids).astype("<u4"), np.concatenate(sizes)
        placed = np.array(order(Index(texts), sizes), np.int64)
        ends = np.cumsum(sizes[placed])
        begins, source = ends - sizes[placed], (np.cumsum(sizes) - sizes)[placed]
        cuts = sequences(int(ends[-1]))
        at = np.union1d(begins, cuts)
        length = np.diff(np.append(at, ends[-1]))
        which = np.searchsorted(begins, at, "right") - 1
        seq = np.searchsorted(cuts, at, "right") - 1
        start = at - begins[which]
        lo = source[which] + start
        raw = memoryview(ids).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
        doc = placed[which]
        return pa.Table.from_arrays([shard.column("doc_id").combine_chunks().take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, sizes[doc], seq, at - cuts[seq]))], schema=OUT)

    return run


def _condense(vocabulary: str, end: int):
    """A shard as packed arrays: ids of its documents and their tokens, and its postings by term."""

    def run(shard: pa.Table) -> pa.Table:
        number = shard.column("shard")[0].as_py()
        shard = shard.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        texts, names = shard.column("text").combine_chunks(), shard.column("doc_id").combine_chunks()
        ids, sizes = [], []
        for _, _, x, offs in tokens.encoder(vocabulary).encode(texts):
            ids.append(np.insert(x, offs[1:], end))
            sizes.append(np.diff(offs) + 1)
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        kind = np.uint16 if ids.max() < 1 << 16 else np.uint32
        key, doc, tf, words = postings(texts)
        keys, count = np.unique(key, return_counts=True)
        data = packed(keys, count.astype(np.uint32), doc.astype(np.uint32), tf.astype(np.uint32), words)
        named = packed(names.fill_null(0).to_numpy(zero_copy_only=False), names.is_null().to_numpy(zero_copy_only=False).view(np.uint8))
        return pa.table({"shard": pa.array([number]), "n": pa.array([len(sizes)]), "words": pa.array([int(words.sum())]), "sizes": pa.array([packed(sizes.astype(np.uint32))]), "names": pa.array([named]), "ids": pa.array([ids.astype(kind).tobytes()]), "wide": pa.array([kind is np.uint32]), "postings": pa.array([data])})

    return run


CONDENSED = "shard long, n long, words long, sizes binary, names binary, ids binary, wide boolean, postings binary"
POSTINGS = (np.uint64, np.uint32, np.uint32, np.uint32, np.int64)


def _write(df: DataFrame, spread: bool = True) -> tuple[DataFrame, str]:
    """The same rows from a written table, with spread of small files, which Spark spreads over its cores; and its folder. What was shuffled for it is deleted."""
    path = shared_dir(df.sparkSession)
    settle(df.sparkSession)
    with freed(df.sparkSession):
        df.write.option("maxRecordsPerFile", 2 if spread else 0).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _frequencies(table: pa.Table) -> pa.Table:
    """Answers each shard's (term, documents) of a slice with the documents of all shards."""
    got = [(b, s, *x) for b, s, x in parts(table, np.uint64, np.uint32)]
    keys, which = np.unique(np.concatenate([x[2] for x in got]), return_inverse=True)
    total = np.bincount(which, np.concatenate([x[3] for x in got]), len(keys)).astype(np.uint32)[which]
    ends = np.cumsum([0, *(len(x[2]) for x in got)])
    return pa.table({"block": pa.array([x[0] for x in got], pa.int64()), "slice": pa.array([x[1] for x in got], pa.int64()), "data": pa.array([packed(total[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())})


def _with_frequencies(shard: pa.Table, answers: pa.Table) -> pa.Table:
    """A shard's postings of terms that two or more documents of the corpus hold, with their frequency."""
    keys, count, doc, tf, words = unpack(shard["postings"][0].as_buffer(), *POSTINGS)
    df = np.concatenate([np.zeros(0, np.uint32), *(x for _, _, (x,) in parts(answers, np.uint32))])
    some = df > 1
    keep = np.repeat(some, count)
    return pa.table({"shard": shard["shard"].combine_chunks(), "data": pa.array([packed(keys[some], count[some], doc[keep], tf[keep], words, df[some])], pa.binary())})


def _top(q, score, doc, k: int):
    """The k best of each query, best first, ties to the earlier document."""
    order = np.lexsort((doc, -score, q))
    q, score, doc = q[order], score[order], doc[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], score[keep], doc[keep]


def _merged(mine, more, queries: int, k: int):
    """The k best of each query of two lists by query; few queries at a time, as sorting takes several times their size."""
    out = []
    for a in range(0, queries, QUERIES):
        cuts = [slice(*np.searchsorted(x[0], (a, a + QUERIES))) for x in (mine, more)]
        out.append(_top(*(np.concatenate((x[cuts[0]], y[cuts[1]])) for x, y in zip(mine, more, strict=True)), k))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _scores(keys, count, doc, weight, n: int, terms, term_of, first, k: int, floor=None):
    """(query, score, document) by query of a shard's best documents for each query: the k best are among them, but for those below its floor, the
    score that it has k of already. A query is a run of term_of, places in terms."""
    floor = np.zeros(len(first) - 1, np.int64) if floor is None else floor
    at = np.searchsorted(keys, terms)
    at[at == len(keys)] = 0
    place = np.where(keys[at] == terms, at, -1).astype(np.int32)
    begin = np.cumsum(count) - count
    dense = np.flatnonzero(count * 32 > n)  # terms of so many documents go faster as a matrix product
    row = np.full(len(keys), -1, np.int32)
    row[dense] = np.arange(len(dense))
    matrix = np.zeros((len(dense), n))
    post = A.ragged(begin[dense], count[dense])
    matrix[np.repeat(np.arange(len(dense)), count[dense]), doc[post]] = weight[post]
    out, least = [], np.maximum(floor / UNITS - 1 / UNITS, 0)
    step = max(1, CELLS // n)
    for a in range(0, len(first) - 1, step):
        b = min(a + step, len(first) - 1)
        qs, ts = np.repeat(np.arange(b - a), np.diff(first[a : b + 1])), place[term_of[first[a] : first[b]]]
        qs, ts = qs[ts >= 0], ts[ts >= 0]
        wide = row[ts] >= 0
        asked = np.zeros((b - a, len(dense)))
        asked[qs[wide], row[ts[wide]]] = 1
        score = asked @ matrix
        qs, ts = qs[~wide], ts[~wide]
        size = count[ts]
        ends = np.cumsum(size)
        which = np.repeat(np.arange(len(ts), dtype=np.int32), size)
        post = np.arange(len(which)) + (begin[ts] - ends + size)[which]
        score += np.bincount((qs * n)[which] + doc[post], weight[post], (b - a) * n).reshape(b - a, n)
        good = score > least[a:b, None]
        many = np.flatnonzero(np.count_nonzero(good, axis=1) > k)
        if len(many):
            good[many] &= score[many] > (np.partition(score[many], n - k, axis=1)[:, n - k] - 1 / UNITS)[:, None]  # and all that may tie with the last
        of, col = np.divmod(np.flatnonzero(good), n)
        best = np.rint(score[of, col] * UNITS).astype(np.int64)
        some = (best > 0) & (best >= floor[of + a])
        out.append((of[some] + a, best[some], col[some]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


class Shards:
    """BM25 over all shards. A document's number is its place among all documents, by shard."""

    def __init__(self, dealt: DataFrame, slices: int, vocabulary: str, end: int):
        self.spark = dealt.sparkSession
        condensed, first = _write(dealt.groupBy("shard").applyInArrow(_condense(vocabulary, end), CONDENSED))

        def emit(batches):
            for batch in batches:
                for number, data in zip(batch["shard"].to_pylist(), batch["postings"], strict=True):
                    keys, count, *_ = unpack(data.as_buffer(), *POSTINGS)
                    yield from messages(number, slice_of(keys, slices), slices, keys, count).to_batches()

        # Each table is written by itself, and what it was made of goes: disk holds the postings three times at most, once of that shuffled.
        answers, second = _write(condensed.select("shard", "postings").mapInArrow(emit, MESSAGE).groupBy("slice").applyInArrow(_frequencies, MESSAGE), spread=False)
        self.index, _ = _write(condensed.select("shard", "postings").groupBy("shard").cogroup(answers.groupBy("block")).applyInArrow(_with_frequencies, "shard long, data binary"))
        remove(self.spark, second)
        self.base, _ = _write(condensed.drop("postings"))
        remove(self.spark, first)
        rows = sorted(self.base.select("shard", "n", "words", "sizes").collect())
        self.starts = dict(zip((r.shard for r in rows), np.cumsum([0, *(r.n for r in rows)]).tolist(), strict=False))
        self.sizes = np.concatenate([np.zeros(0, np.uint32), *(unpack(r.sizes, np.uint32)[0] for r in rows)])
        self.n, self.mean = len(self.sizes), sum(r.words for r in rows) / max(len(self.sizes), 1)

    def _terms(self, seeds: np.ndarray):
        """The seeds' terms (distinct hashes), each seed's places among them, and the runs of the seeds. The driver reads them from a written table, a part at a time."""
        starts, shared = self.starts, self.spark.sparkContext.broadcast(np.sort(seeds))

        def emit(batches):
            tokens.forget()  # a worker that has encoded holds its table
            for batch in batches:
                trim()
                for number, data in zip(batch["shard"].to_pylist(), batch["data"], strict=True):
                    keys, count, doc, _, words, _ = unpack(data.as_buffer(), *POSTINGS, np.uint32)
                    asked = np.zeros(len(words), bool)
                    lo = starts[number]
                    asked[shared.value[slice(*np.searchsorted(shared.value, (lo, lo + len(words))))] - lo] = True
                    mine = asked[doc]
                    of, key = doc[mine], np.repeat(keys, count)[mine]
                    yield pa.record_batch({"data": pa.array([packed(np.flatnonzero(asked) + lo, np.bincount(of, minlength=len(words))[asked].astype(np.uint32), key[np.argsort(of, kind="stable")])], pa.binary())})

        with setting(self.spark, BATCH, "1"):
            table, path = _write(self.index.mapInArrow(emit, "data binary"), spread=False)
        rank = np.argsort(seeds)
        ordered, count = seeds[rank], np.zeros(len(seeds), np.int64)
        terms, held = np.zeros(0, np.uint64), []
        for row in table.coalesce(READS).toLocalIterator():
            doc, n, key = unpack(row.data, np.int64, np.uint32, np.uint64)
            own = rank[np.searchsorted(ordered, doc)]
            count[own] = n
            held.append((own, key))
            more = np.unique(key)
            at = np.searchsorted(terms, more)
            new = np.append(terms, np.uint64(0))[at] != more
            new |= at == len(terms)
            terms = np.insert(terms, at[new], more[new])
        shared.destroy()
        remove(self.spark, path)
        first = np.cumsum(np.append(0, count))
        term_of = np.empty(first[-1], np.int32)
        while held:
            own, key = held.pop()
            term_of[A.ragged(first[own], count[own])] = np.searchsorted(terms, key)
        return terms, term_of, first

    def neighbours(self, seeds: np.ndarray, used: np.ndarray, k: int):
        """(seed's place in seeds, score, document) of each seed's k best unused documents in the corpus that share a term with it. Seeds of more than
        ASKED tokens are asked for in several goes over the index."""
        go = np.cumsum(self.sizes[seeds], dtype=np.int64) // ASKED
        edges = np.append(np.flatnonzero(np.diff(go, prepend=-1)), len(seeds)).tolist()
        got = [(q + a, score, doc) for a, b in zip(edges, edges[1:], strict=False) for q, score, doc in [self._best(seeds[a:b], used, k)]]
        return [np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*got, strict=True) if got else ((), (), ()))]

    def _best(self, seeds: np.ndarray, used: np.ndarray, k: int):
        """The same for seeds whose terms the driver and each task hold at once."""
        starts, total, mean = self.starts, self.n, self.mean
        shared = self.spark.sparkContext.broadcast((*self._terms(seeds), np.packbits(used)))
        per = 256

        def emit(batches):
            tokens.forget()  # a worker that has encoded holds its table
            terms, term_of, first, bits = shared.value
            used = np.unpackbits(bits, count=total).astype(bool)
            best, floor = [np.zeros(0, np.int64) for _ in range(3)], np.zeros(len(first) - 1, np.int64)
            for batch in batches:
                for number, data in zip(batch["shard"].to_pylist(), batch["data"], strict=True):
                    keys, count, doc, tf, words, df = unpack(data.as_buffer(), *POSTINGS, np.uint32)
                    lo = starts[number]
                    free = np.flatnonzero(~used[lo : lo + len(words)])
                    if not len(free) or not len(keys):
                        continue
                    place = np.full(len(words), -1, np.int32)
                    place[free] = np.arange(len(free))
                    term, doc = np.repeat(np.arange(len(keys), dtype=np.int32), count), place[doc]
                    term, tf, doc = term[doc >= 0], tf[doc >= 0], doc[doc >= 0]
                    idf = np.log1p((total - df + 0.5) / (df + 0.5))
                    weight = weights(idf[term], tf, words[free][doc], mean)
                    more = _scores(keys, np.bincount(term, minlength=len(keys)), doc, weight, len(free), terms, term_of, first, k, floor)
                    del term, tf, doc, weight
                    best = _merged(best, (more[0], more[1], free[more[2]] + lo), len(floor), k)
                    ends = np.cumsum(np.bincount(best[0], minlength=len(floor)))
                    enough = np.flatnonzero(np.diff(ends, prepend=0) == k)
                    floor[enough] = best[1][ends[enough] - 1]
                trim()  # before the next shard, as memory is short where two workers share an executor
            edges = np.searchsorted(best[0], np.arange(0, len(floor) + per, per))
            for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):  # a slice at a time
                if b > a:
                    yield from messages(0, np.full(b - a, i), -(-len(floor) // per), *(x[a:b] for x in best)).to_batches()

        def merge(table):
            got = [x for _, _, x in parts(table, np.int64, np.int64, np.int64)]
            return pa.table({"data": pa.array([packed(*_top(*(np.concatenate(x) for x in zip(*got, strict=True)), k))], pa.binary())})

        with freed(self.spark), setting(self.spark, BATCH, "1"):
            # Few tasks: each has a floor for a query from its second shard on, and sends k answers a query.
            rows = self.index.coalesce(2 * self.spark.sparkContext.defaultParallelism).mapInArrow(emit, MESSAGE).groupBy("slice").applyInArrow(merge, "data binary").collect()
        shared.destroy()
        got = [unpack(r.data, np.int64, np.int64, np.int64) for r in rows]
        return [np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*got, strict=True) if got else ((), (), ()))]


def chains(shards: Shards) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chain and place in it of each document, and the length of each chain."""
    sizes, n = shards.sizes.astype(np.int64), shards.n
    many = max(1, min(CHAINS, int(sizes.sum()) // (WINDOW * ROUNDS)))
    used, chain, place, length, seed = np.zeros(n, bool), np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(many, np.int64), np.full(many, -1)
    following, k = 0, max(ANSWERS, min(2 * ANSWERS, MOST // many))  # more at once take fewer rounds, as many seeds ask for the same documents

    def put(c: int, doc: int) -> bool:
        """Does it reach the window's end?"""
        used[doc], chain[doc], place[doc] = True, c, length[c]
        before, length[c] = length[c] // WINDOW, length[c] + sizes[doc]
        return length[c] // WINDOW != before

    def renew(c: int) -> None:
        """The next unused documents follow, up to one that leaves room in a window and is its seed."""
        nonlocal following
        seed[c] = -1
        while seed[c] < 0:
            while following < n and used[following]:
                following += 1
            if following == n:
                return
            put(c, following)
            seed[c] = following if length[c] % WINDOW else -1

    for c in range(many):
        renew(c)
    while not used.all():
        active = np.flatnonzero(seed >= 0)
        k = min(k, max(ANSWERS, MOST // len(active)))  # a seed whose window isn't full asks again, so this takes rounds and drops no neighbour
        q, score, doc = shards.neighbours(seed[active], used, k)
        full, best = np.zeros(len(active), bool), np.lexsort((doc, q, -score))
        for at in range(0, len(best), 1 << 16):  # numbers as Python objects take ten times the memory
            part = best[at : at + (1 << 16)]
            for i, d in zip(q[part].tolist(), doc[part].tolist(), strict=True):
                if not full[i] and not used[d] and put(active[i], d):
                    full[i], seed[active[i]] = True, d if length[active[i]] % WINDOW else -1
        last = ~full & (np.bincount(q, minlength=len(active)) < k)  # these have no unused neighbour left
        for c in active[last | (seed[active] < 0)].tolist():
            renew(c)
        if 2 * full.sum() < len(active):  # many seeds ask for the same documents
            k = min(2 * k, 64 * ANSWERS)
    return chain, place, length


def _pieces(length: np.ndarray):
    """Pieces of each shard's documents. Full windows of all chains lie on one line, and after them the chains' ends."""
    whole = length // WINDOW * WINDOW
    first, ends = np.cumsum(whole) - whole, np.cumsum(length - whole) - (length - whole) + whole.sum()
    total = int(length.sum())
    tail = total // WINDOW * WINDOW
    short = np.append(sequences(total)[tail // WINDOW :], total)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                size, (name, null), (chain, place) = unpack(row["sizes"], np.uint32)[0].astype(np.int64), unpack(row["names"], np.int64, np.uint8), unpack(row["placed"], np.int32, np.int64)
                ids = np.frombuffer(row["ids"], np.uint32 if row["wide"] else np.uint16).astype("<u4")
                inside = np.clip(whole[chain] - place, 0, size)  # tokens in full windows of the chain
                doc = np.tile(np.arange(len(size)), 2)
                start = np.concatenate([np.zeros(len(size), np.int64), inside])
                n = np.concatenate([inside, size - inside])
                at = np.concatenate([first[chain] + place, ends[chain] + np.maximum(place - whole[chain], 0)])
                doc, start, n, at = (x[n > 0] for x in (doc, start, n, at))
                windows = (at + n - 1) // WINDOW - at // WINDOW + 1
                which = np.repeat(np.arange(len(n)), windows)
                lo = np.maximum(A.ragged(at // WINDOW, windows) * WINDOW, at[which])
                extra = [(i, c) for c in short[1:-1].tolist() for i in np.flatnonzero((at < c) & (at + n > c)).tolist()]
                which, lo = np.append(which, [i for i, _ in extra]).astype(np.int64), np.append(lo, [c for _, c in extra]).astype(np.int64)
                order = np.lexsort((lo, which))
                which, lo = which[order], lo[order]
                hi = (at + n)[which]
                same = np.flatnonzero(which[1:] == which[:-1])
                hi[same] = lo[same + 1]
                start, doc = start[which] + lo - at[which], doc[which]
                part = np.searchsorted(short, lo, "right") - 1
                seq = np.where(lo < tail, lo // WINDOW, tail // WINDOW + part)
                offset = lo - np.where(lo < tail, seq * WINDOW, short[part])
                source = (np.cumsum(size) - size)[doc] + start
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(source.tolist(), (source + hi - lo).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(name[doc], mask=null[doc].astype(bool)), *(pa.array(x, pa.int64()) for x in (start, hi - lo, crc, size[doc], seq, offset))], schema=OUT)

    return run


def pack(docs: DataFrame, vocabulary: str, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most WINDOW ids."""
    n = pieces_for(docs, SHARD_BYTES)
    rows = pick(docs, doc_id, text)
    key = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    dealt = rows.withColumn("shard", F.pmod(key, F.lit(n)))
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    if n == 1:
        return dealt.groupBy("shard").applyInArrow(_pack(vocabulary, end), out)
    shards = Shards(dealt, -(-n // 8), vocabulary, end)
    chain, place, length = chains(shards)
    edges = [*shards.starts.values(), shards.n]
    placed = [(s, packed(chain[a:b], place[a:b])) for s, a, b in zip(shards.starts, edges, edges[1:], strict=False)]
    placed = docs.sparkSession.createDataFrame(placed, "shard long, placed binary")
    return shards.base.select("shard", "sizes", "names", "ids", "wide").join(placed, "shard").mapInArrow(_pieces(length), out)
