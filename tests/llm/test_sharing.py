"""Operators that compare documents, against brute force."""

import random
import re
import tracemalloc
import zlib
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from sparkscan.llm import lines, near, packing, shingles, substrings, tokens
from sparkscan.llm.components import components
from sparkscan.llm.sketches import Sketch, merge, merged


def corpus(seed=1, n=120):
    """Passages that many documents share, copies, near copies and common lines."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcDE") for _ in range(rng.randint(1, 4)))
    passages = [" ".join(word() for _ in range(20)) for _ in range(4)]
    common = ["A  common line here ", "\ta common Line here".replace("Line", "line"), "short", ""]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.35:
            words = rng.choice(out).split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = word()
            out.append(" ".join(words))
        else:
            out.append("\n".join(rng.choice([lambda: " ".join(word() for _ in range(rng.randint(1, 25))), lambda: rng.choice(passages), lambda: rng.choice(common)])() for _ in range(rng.randint(0, 8))))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k * 3, t) for k, t in enumerate(corpus())], "doc_id long, text string").repartition(3)


def test_substrings(docs, small_blocks):
    texts = {k * 3: t.split() for k, t in enumerate(corpus())}
    first = {}
    for k, w in texts.items():
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), k)
    got = {r.doc_id: r for r in substrings.substring_dedup(docs, texts=True).collect()}
    removed = 0
    for k, w in texts.items():
        gone = {i + d for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < k for d in range(13)}
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        removed += len(gone)
        assert (got[k].n_words, got[k].n_removed, got[k].text, got[k].kept_sha256) == (len(w), len(gone), left, sha256(left.encode()).hexdigest())
    assert removed > 100


def test_a_sketch_takes_few_bytes_an_item():
    """Two workers of an executor hold a block or a slice each beside the JVM."""
    h = np.random.default_rng(1).integers(0, 1 << 63, 300_000).astype(np.uint64) << np.uint64(1)
    h = np.concatenate((h, h[:50_000]))
    counter = Sketch(1, 36, 64)
    answers = counter.messages(h[:9], h[:9], np.ones(9, np.int64), 0)  # imports
    for run, most in ((lambda: counter.messages(h, h, None, 0), 40), (lambda: merge(6)(answers), 46), (lambda: counter.elsewhere(h, h, answers, 2), 36)):
        tracemalloc.start()
        answers = run()
        assert tracemalloc.get_traced_memory()[1] < most * len(h)
        tracemalloc.stop()


@pytest.mark.parametrize("depth,bits", [(1, 9), (2, 9), (3, 12), (2, 24)])
def test_merged_sketches_never_count_too_low(depth, bits):
    rng = np.random.default_rng(depth)
    h, g = (rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2) for _ in range(2))
    sketch, n, asked, true = Sketch(depth, bits, 5), 7, [], np.zeros(3000, int)
    held = [rng.choice(3000, 600, replace=False) for _ in range(n)]
    for block, own in enumerate(held):
        count = 1 + own % 3
        true[own] += count
        asked.append(sketch.messages(h[own], g[own], count, block))
    asked = pa.concat_tables(asked)
    estimate, over = np.full(3000, 1 << 40), 0
    for row in range(depth):
        counters = {}
        for s in range(5):
            _, cells, own, total = merged(asked.filter(pc.equal(asked["slice"], s + 5 * row)))
            counters |= dict(zip(cells.tolist(), total.tolist(), strict=True))
        cells = sketch.cells(h, g, row).tolist()
        assert sum(counters[c] for c in set(cells) if c in counters) <= n * 600 * 3
        estimate = np.minimum(estimate, [counters.get(c, 0) for c in cells])
    over = int((estimate > true).sum())
    assert (estimate >= true).all() and (over > 0 or bits == 24)
    by = [merge(4)(asked.filter(pc.equal(asked["slice"], s))) for s in range(5 * depth)]
    answers = pa.concat_tables(by)
    for block, own in enumerate(held):
        elsewhere, frequent = sketch.elsewhere(h[own], g[own], answers.filter(pc.equal(answers["block"], block)), 2)
        others = true[own] - (1 + own % 3)
        assert elsewhere[others > 0].all() and frequent[true[own] > 4].all()
        assert bits < 24 or (elsewhere == (others > 0)).all()


def test_lines(docs, small_blocks):
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    texts = {k * 3: t.split("\n") for k, t in enumerate(corpus())}
    holders = {}
    for k, ls in texts.items():
        for x in ls:
            holders.setdefault(key(x), set()).add(k)
    got = {r.doc_id: r for r in lines.line_dedup(docs, texts=True, digest=True).collect()}
    dropped = 0
    for k, ls in texts.items():
        keep = [len(key(x)) < 10 or min(holders[key(x)]) == k for x in ls]
        left = "\n".join(x for x, y in zip(ls, keep, strict=True) if y)
        dropped += keep.count(False)
        r = got[k]
        assert (r.n_lines, r.n_dropped, r.text, r.kept_sha256) == (len(ls), keep.count(False), left, sha256(left.encode()).hexdigest())
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8), count=len(ls))
        assert bits.tolist() == [int(x) for x in keep]
    assert dropped > 50


def brute_groups(texts):
    sets = {}
    for k, t in texts.items():
        w = re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "").split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    others = {k: set() for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
                if sets[a] != sets[b]:
                    others[a].add(frozenset(sets[b]))
                    others[b].add(frozenset(sets[a]))
    return {k: (len(s), find(k), len(others[k])) for k, s in sets.items()}


def groups_of(rows):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in rows.collect()}


def test_near_duplicates(spark, small_blocks):
    rows = {k * 3: t for k, t in enumerate(corpus(2))}
    want = brute_groups(rows)
    got = near.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3))
    assert groups_of(got) == want and sum(n for _, _, n in want.values()) > 40


def test_a_chain_of_near_copies_is_one_group(spark):
    rng = random.Random(3)
    words, rows = [f"w{k}" for k in range(300)], []
    for k in range(60):
        rows.append((k, " ".join(words)))
        for _ in range(4):
            words[rng.randrange(300)] = f"x{rng.random()}"
    want = brute_groups(dict(rows))
    assert groups_of(near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == want and len({c for _, c, _ in want.values()}) == 1


def test_every_linked_pair_shares_a_signature_that_is_looked_up():
    """At the greatest difference that still links, for all sizes, whatever the costs and marks are."""
    rng = np.random.default_rng(6)
    for n in [1, 2, 3, 7, 20, 31, 33, 40, 60, 100, 171, 300, 701]:
        for share in (0, 0.3, 0.8, 1):
            for m in sorted({n, max(1, n * 9 // 10), -(-3 * n // 4)}):
                both = -(-3 * (n + m) // 7)
                if both > m:
                    continue
                shared, x, y = rng.integers(0, 1 << 63, both), rng.integers(0, 1 << 63, n - both), rng.integers(0, 1 << 63, m - both)
                often = lambda z: (z >> 20) % 100 < 100 * share
                a, b = (np.sort(shingles.marked(np.concatenate((shared, z)).astype(np.uint64), often(np.concatenate((shared, z))), np.arange(both + len(z)) >= both)) for z in (x, y))
                sigs = shingles.Signatures(np.concatenate((a, b)), np.array([0, n, n + m]))
                for _ in range(4):
                    look = sigs.allocate(rng.random(len(sigs.sig)) * rng.choice([1, 1000], len(sigs.sig)))
                    all_ = [set(sigs.sig[sigs.set == k].tolist()) for k in (0, 1)]
                    sought = [set(sigs.sig[(sigs.set == k) & look].tolist()) for k in (0, 1)]
                    assert sought[0] & all_[1] or sought[1] & all_[0], (n, m, share)


def test_tiles_find_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(near, "TILE", 7)
    rows = {k: t for k, t in enumerate(corpus(4, 90))}
    assert groups_of(near.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))) == brute_groups(rows)


def test_large_clusters_are_cut_where_no_link_crosses(spark, monkeypatch):
    """A chain of documents, each with one passage of the next, ties all; exact comparison is asked for small clusters only."""
    rng = random.Random(8)
    rows = {}
    for k in range(80):
        own = [f"w{k}x{j}" for j in range(60)]
        rows[k] = " ".join([f"p{k}q{j}" for j in range(7)] + own + [f"p{k + 1}q{j}" for j in range(7)])
        for copy in range(rng.choice([1, 1, 2])):
            rows[100 * (copy + 1) + k] = rows[k].replace(f"w{k}x{rng.randrange(60)}", f"y{copy}")
    seen, verified = [], near.verified

    def spy(clusters, percent):
        seen.extend(r["count"] for r in clusters.groupBy("cluster").count().collect())
        return verified(clusters, percent)

    monkeypatch.setattr(near, "verified", spy)
    monkeypatch.setattr(near, "TILE", 16)
    got = groups_of(near.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string")))
    assert got == brute_groups(rows) and sum(n for *_, n in got.values()) > 150
    assert seen and max(seen) <= 16


@pytest.mark.parametrize("size", [1, 3, 9, 40, 700])
def test_sketches_never_tell_linked_sets_apart(size):
    rng = np.random.default_rng(size)
    for n in {size, size * 9 // 10, -(-3 * size // 4)} - {0}:
        both = -(-3 * (size + n) // 7)
        if both > n:
            continue
        shared, x, y = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (both, size - both, n - both))
        key, first = np.concatenate((shared, x, shared, y)), np.array([0, size, size + n])
        assert near.possible(np.array([5, 6]), np.diff(first), near.parities(key, first), 75) == ([5], [6])
    far = rng.integers(0, 1 << 63, 2 * size).astype(np.uint64)
    assert size < 9 or near.possible(np.array([5, 6]), np.array([size, size]), near.parities(far, np.array([0, size, 2 * size])), 75) == ([], [])


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(500, 560)] + [(900, x) for x in range(901, 960)]
    parent = list(range(1000))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {v: find(v) for a, b in pairs for v in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(docs, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_BYTES", 4_000)
    full = tokens.Encoder(tokens.vocabulary()).full
    rows = packing.pack(docs, tokens.vocabulary()).orderBy("doc_id", "start").collect()
    at = {}
    for r in rows:
        ids = np.array([*full.encode(corpus()[r.doc_id // 3], add_special_tokens=False).ids, 1], "<u4")
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        at[r.doc_id] = r.start + r.length
    assert sum(at.values()) == sum(r.length for r in rows) and len(at) == len(corpus())
    size = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == size.get(r.sequence_id, 0)
        size[r.sequence_id] = r.offset + r.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in size.values())


def test_retrieval_prefers_documents_on_the_same_matter():
    index = packing.Index(pa.array(["apple banana cherry", "river stone water", "apple banana grape", "stone water sand", "none of these"]))
    used = lambda seed: np.arange(5) == seed
    assert index.neighbours(0, used(0))[0] == 2 and index.neighbours(1, used(1))[0] == 3 and index.neighbours(4, used(4)) == []
    assert packing.order(index, np.array([10] * 5)) == [0, 2, 1, 3, 4]
    assert packing.sequences(4096 + 13).tolist() == [0, 2048, 4096, 4104, 4108]


def test_every_term_retrieves_and_every_neighbour_is_used():
    rare = [f"rare{k}" for k in range(30)]
    many = packing.Index(pa.array([" ".join([*rare, "last"]), *(f"{w} {w}x" for w in rare), "last y"]))
    assert set(many.neighbours(0, np.arange(32) == 0)) == set(range(1, 32))
    index = packing.Index(pa.array([f"common a{k}" if k % 2 == 0 else f"b{k} c{k}" for k in range(120)]))
    assert all(k % 2 == 0 for k in packing.order(index, np.array([10] * 120))[:60])


def test_retrieval_covers_all_shards(docs):
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(7)))
    shards = packing.Shards(dealt, 3, tokens.vocabulary(), 1)
    rows = sorted(((r.shard, r.doc_id, r.text) for r in dealt.collect()))
    assert shards.n == len(rows) and len(shards.starts) == 7
    whole = packing.Index(pa.array([r[2] for r in rows]))
    used = np.arange(len(rows)) % 5 == 0
    seeds = np.array([50, 0, 5, 100, 15, 35])
    q, score, doc = shards.neighbours(seeds, used, len(rows))
    found = 0
    for k, seed in enumerate(seeds.tolist()):
        want = whole.neighbours(seed, used)
        got = doc[q == k]
        assert set(got.tolist()) == set(want)
        terms = whole.query[whole.query_of[seed] : whole.query_of[seed + 1]]
        full = np.zeros(len(rows))
        for t in terms:
            full[whole.doc[whole.first[t] : whole.first[t + 1]]] += whole.weight[whole.first[t] : whole.first[t + 1]]
        assert np.abs(score[q == k] / packing.UNITS - full[got]).max(initial=0) < 1e-5
        few = shards.neighbours(seeds[k : k + 1], used, 3)
        assert few[2].tolist() == got[np.lexsort((got, -score[q == k]))][:3].tolist()
        found += len(got)
    assert found > 100


def test_packing_joins_documents_of_all_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_BYTES", 8_000)
    topics = [(k, " ".join(f"topic{k % 6}word{j}" for j in range(30))) for k in range(120)]
    rows = packing.pack(spark.createDataFrame(topics, "doc_id long, text string"), tokens.vocabulary()).collect()
    line = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert sorted(line) == list(range(120)) and sum(a % 6 != b % 6 for a, b in zip(line, line[1:], strict=False)) <= 12
    size = {}
    for r in rows:
        size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
    assert sum(n < 2048 for n in size.values()) <= 11


def test_postings_are_kept_once(docs, spark, tmp_path, monkeypatch):
    """What the index is made of goes when it has been written: the table with raw postings, frequencies and shuffles."""
    made = []
    monkeypatch.setattr(packing, "shared_dir", lambda spark: made.append(str(tmp_path / str(len(made)))) or made[-1])
    shards = packing.Shards(docs.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(7))), 3, tokens.vocabulary(), 1)
    left = {p for p in made if Path(p).exists()}
    assert left == {str(Path(f.removeprefix("file:")).parent) for t in (shards.base, shards.index) for f in t.inputFiles()}
    assert len(left) == 2 and "postings" not in shards.base.columns and shards.index.count() == 7


def test_answers_of_a_round_are_bounded(monkeypatch):
    """Many seeds that ask for the same documents get longer lists, and the driver no more than MOST answers."""
    monkeypatch.setattr(packing, "ROUNDS", 1)
    monkeypatch.setattr(packing, "MOST", 70_000, raising=False)
    asked = []

    class Same:
        n, sizes = 6_000, np.full(6_000, 700, np.uint32)

        def neighbours(self, seeds, used, k):
            asked.append((len(seeds), k))
            best = np.flatnonzero(~used)[:k]
            return np.repeat(np.arange(len(seeds)), len(best)), np.tile(np.arange(len(best), 0, -1), len(seeds)), np.tile(best, len(seeds))

    chain, place, length = packing.chains(Same())
    assert max(n for n, _ in asked) > 1000 and max(k for _, k in asked) > packing.ANSWERS
    assert all(n * k <= max(70_000, n * packing.ANSWERS) for n, k in asked)
    assert sorted(zip(chain.tolist(), place.tolist(), strict=True)) == [(c, 700 * i) for c in range(len(length)) for i in range(length[c] // 700)] and length.sum() == 6_000 * 700


@pytest.mark.parametrize("run", [substrings.substring_dedup, lines.line_dedup, near.near_duplicates, lambda d: packing.pack(d, tokens.vocabulary())])
def test_empty_tables(run, none):
    assert run(none).count() == 0


def test_odd_rows(odd):
    n = odd.count()
    sub = substrings.substring_dedup(odd).collect()
    assert len(sub) == n and all(r.n_removed == 0 for r in sub if r.doc_id in (None, 1, 3, 4, 6, 8)) and next(r.n_removed for r in sub if r.doc_id == 2) == 240
    line = lines.line_dedup(odd).collect()
    assert len(line) == n and all(r.n_dropped == 0 for r in line)
    groups = near.near_duplicates(odd).collect()
    assert len(groups) == n and {(r.doc_id, r.component_id, r.n_links) for r in groups} == {(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 0), (8, 8, 0), (None, None, 0)}
    assert packing.pack(odd, tokens.vocabulary()).where("start = 0").count() == n


def test_the_terms_of_seeds_take_few_bytes_on_the_driver(spark):
    """A round has up to CHAINS seeds, and 8,192 documents of 700 words have millions of terms."""
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(f"w{x}" for x in rng.choice(5_000, 2_000, replace=False))) for k in range(400)]
    dealt = spark.createDataFrame(rows, "doc_id long, text string").repartition(8).withColumn("shard", F.pmod("doc_id", F.lit(40)))
    shards = packing.Shards(dealt, 3, tokens.vocabulary(), 1)
    seeds = rng.permutation(shards.n)
    tracemalloc.start()
    terms, term_of, first = shards._terms(seeds)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(terms) == 5_000 and len(term_of) == first[-1] == 800_000 and (np.diff(first) == 2_000).all()
    names = [k for s in shards.starts for k in range(400) if k % 40 == s]  # by place
    for k in (0, 17, 399):
        text = pa.array([dict(rows)[names[seeds[k]]]])
        assert terms[term_of[first[k] : first[k + 1]]].tolist() == packing.postings(text)[0].tolist()
    assert peak < 20 * len(term_of)


def test_shards_after_the_first_return_only_what_may_be_among_the_best(monkeypatch):
    """A task has k answers of each seed after its first shards; worse documents of the next shards aren't listed, and none that counts is lost."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 60) % 400) for _ in range(400)]
    parts = []
    for a in range(0, 400, 100):
        key, doc, tf, words = packing.postings(pa.array(texts[a : a + 100]))
        keys, count = np.unique(key, return_counts=True)
        parts.append((keys, count, doc, packing.weights(np.repeat(np.log1p(400 / count), count), tf, words[doc], 60), 100))
    key, doc, _, _ = packing.postings(pa.array(texts[:50]))
    key = key[np.argsort(doc, kind="stable")]
    terms, term_of = np.unique(key, return_inverse=True)
    first = np.append(0, np.cumsum(np.bincount(doc)))
    monkeypatch.setattr(packing, "CELLS", 1_000)
    k, none = 5, [np.zeros(0, np.int64)] * 3
    whole = best = none
    for i, part in enumerate(parts):
        full = packing._scores(*part, terms, term_of, first, 100)
        whole = packing._merged(whole, (full[0], full[1], full[2] + 100 * i), 50, 400)
        floor = np.zeros(50, np.int64) if i == 0 else best[1][k - 1 :: k]
        some = packing._scores(*part, terms, term_of, first, k, floor)
        assert i == 0 or (some[1] >= floor[some[0]]).all() and len(some[0]) < 50 * k
        best = packing._merged(best, (some[0], some[1], some[2] + 100 * i), 50, k)
    assert [x.tolist() for x in best] == [x.tolist() for x in packing._top(*whole, k)]


def test_seeds_of_many_terms_are_asked_for_in_several_goes(docs, monkeypatch):
    shards = packing.Shards(docs.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(7))), 3, tokens.vocabulary(), 1)
    used, seeds = np.arange(shards.n) % 5 == 0, np.array([50, 0, 5, 100, 15, 35])
    by_query = lambda got: sorted(zip(*(x.tolist() for x in got), strict=True))
    whole = by_query(shards.neighbours(seeds, used, 9))
    goes, best = [], shards._best
    monkeypatch.setattr(shards, "_best", lambda seeds, *more: goes.append(seeds) or best(seeds, *more))
    monkeypatch.setattr(packing, "ASKED", int(shards.sizes[seeds].sum()) // 3)
    assert by_query(shards.neighbours(seeds, used, 9)) == whole and len(whole) > 20
    assert len(goes) > 2 and np.concatenate(goes).tolist() == seeds.tolist()


def test_near_copies_are_tied_once_and_not_in_every_slice(spark, monkeypatch):
    """Slices return few rows for each set, however many of them share its signatures."""
    rng = random.Random(5)
    rows = []
    for g in range(8):
        words = [f"g{g}w{k}" for k in range(200)]
        for _ in range(6):
            words[rng.randrange(200)] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    keys = pa.array([x for _, x in rows])
    key, first = shingles.sets(keys)
    cand = spark.createDataFrame([(k, int(first[k + 1] - first[k]), bytearray(shingles.marked(key, np.zeros(len(key), bool), np.zeros(len(key), bool))[first[k] : first[k + 1]].tobytes())) for k in range(len(rows))], near.CANDIDATES)
    made, distinct = [], type(cand).distinct
    monkeypatch.setattr(type(cand), "distinct", lambda self: made.append(self.count()) or distinct(self))
    found = near.ties(cand, 64, 75, np.ones(near.CELLS, np.int64))
    monkeypatch.undo()
    groups = {}
    for r in components(found).collect():
        groups.setdefault(r.component, set()).add(r.vertex)
    assert groups == {6 * g: set(range(6 * g, 6 * g + 6)) for g in range(8)}
    assert sum(made) < 6 * len(rows)
