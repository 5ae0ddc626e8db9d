"""Nearest neighbours, mixing and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkscan.llm import mixing, near, neighbours


def vectors(spark, x, extra=()):
    return spark.createDataFrame([*((k, row.tolist(), 0) for k, row in enumerate(x)), *extra], "vec_id long, embedding array<float>, score int")


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[200:700] = x[200]  # a vector that a third of all rows hold
    bad = [(-1, None, 0), (-2, [0.0] * 16, 0), (-3, [float("nan")] * 16, 0), (-20, [1.0] * 3, 0), (None, x[0].tolist(), 0), (-40, [None] * 16, 0)]
    rows = neighbours.nearest(vectors(spark, x, bad)).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(by) == list(range(0, 1500, 20))
    x, hit = x.astype(float), 0
    for q, found in by.items():
        score = x @ x[q]
        score[q] = -np.inf
        true = np.lexsort((np.arange(1500), -score))[:20]
        hit += len({v for v, _ in found} & set(true.tolist()))
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0])) and all(s == pytest.approx(x[v] @ x[q], abs=1e-12) for v, s in found)
    assert hit / (20 * len(by)) >= 0.9
    assert [v for v, _ in by[200]][:20] == [*range(201, 221)] or x[200] @ x[200] < max(x @ x[200])


@pytest.mark.parametrize("clusters", [0, 100])
def test_recall_outside_the_sample(spark, clusters):
    rng = np.random.default_rng(7)
    n = 5 * neighbours.SAMPLE
    x = rng.normal(size=(n, 16))
    if clusters:
        x = 3 * rng.normal(size=(clusters, 16))[rng.integers(0, clusters, n)] + 0.5 * x
    x = (x * rng.lognormal(0, 0.5, (n, 1))).astype(np.float32)  # unequal norms
    rows = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "vec_id long, embedding array<float>")
    by = {}
    for r in neighbours.nearest(rows).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    x, hit = x.astype(float), 0
    assert len(by) == n // 20
    for q, found in by.items():
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(found & set(np.argpartition(-score, 20)[:20].tolist()))
    recall = hit / (20 * len(by))
    print(f"recall of {n} vectors, {clusters} clusters: {recall:.4f}")
    assert recall >= 0.9


def test_blocks_of_queries_and_parts(spark, monkeypatch):
    """Small parts and blocks find the same; every row of the test table is a candidate, and recall is held against brute force."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    whole = {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.nearest(rows).collect()}
    monkeypatch.setattr(neighbours, "PART_ROWS", 70)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 9)
    assert whole == {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.nearest(rows).collect()}
    got = rows.select("vec_id", "embedding").where("embedding is not null").collect()
    x, ids = np.array([r.embedding for r in got], float), np.array([r.vec_id for r in got])
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        true = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        hit, total = hit + len(true & {whole[int(ids[q]), k][0] for k in range(1, 21)}), total + 20
    print(f"recall of embeddings at sf0.01: {hit / total:.4f}")
    assert hit / total >= 0.9


def test_repeated_ids(spark):
    """Rows with one id are entries of their own: a query's own id is never found, another's may be twice."""
    x = np.eye(4, dtype=np.float32)
    rows = vectors(spark, x[:2], [(0, x[2].tolist(), 0), (1, x[3].tolist(), 0)])
    found = neighbours.nearest(rows.where("vec_id = 1").unionByName(rows.where("vec_id = 0 and embedding[0] = 1"))).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(found, key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 1)]


def test_few_neighbours(spark):
    found = neighbours.nearest(vectors(spark, np.eye(4, dtype=np.float32)[:3])).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(found, key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.nearest(vectors(spark, np.zeros((2, 4), np.float32))).count() == 0


def test_cells_are_visited_by_falling_sum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    q = neighbours.Quantiser(x, 5)
    count = np.bincount(q.cells(x), minlength=q.k**2)
    order = q.visit(x[0], count, 400)
    sums = [q.halves[0][c // q.k] @ x[0][:4] + q.halves[1][c % q.k] @ x[0][4:] for c in order]
    assert sorted(order) == np.flatnonzero(count).tolist() and sums == sorted(sums, reverse=True)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("etaoinsh"), rng.integers(2, 7)))
    docs, labels = [], []
    for k in range(700):
        kind = rng.choice(3, p=[0.75, 0.15, 0.1])
        words = [word() for _ in range(rng.integers(40, 120))]
        if kind == 1:
            words = [w + " |" for w in words]
        if kind == 2:
            words = [w if rng.random() < 0.9 else "scoundrel" for w in words]
        docs.append((k, " ".join(words), 0.5))
        if k % 2:
            labels.append((k, int(kind != 1), int(kind == 2)))
    return spark.createDataFrame(docs, "doc_id long, text string, rate double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_mixing_meets_targets(mixed):
    docs, labels = mixed
    held = labels.where("doc_id % 4 = 1")
    rows = mixing.mixing_rates(docs, held).join(labels, "doc_id", "left").toPandas()
    p, n, r = rows[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy(), rows.tokens.to_numpy(), rows.rate.to_numpy()
    test = (rows.doc_id % 4 == 3).to_numpy()
    true = np.where(rows.toxic == 1, 2, np.where(rows.quality == 0, 1, 0))
    assert (p.argmax(axis=1) == true)[test].mean() > 0.95 and np.allclose(p.sum(axis=1), 1) and (r >= 0).all()
    got, want = (r * n) @ p, mixing.wanted(n @ p, mixing.TARGETS)
    assert np.abs(got / want - 1).max() < 1e-3 and np.abs(got / got.sum() / mixing.TARGETS - 1).max() < 1e-3


@pytest.mark.parametrize("seed,shares,sharp", [(1, (0.8, 0.1, 0.1), 6), (2, (0.95, 0.03, 0.02), 8), (3, (0.5, 0.3, 0.2), 2), (4, (0.99, 0.006, 0.004), 8), (5, (0.999, 0.0005, 0.0005), 4)])
def test_descent_against_plain_projected_gradient(seed, shares, sharp):
    """Both meet the targets, from the same start; the plain one, without weights of the domains, needs thousands of steps."""
    rng = np.random.default_rng(seed)
    n, kind = rng.integers(1, 2000, 3000).astype(float), rng.choice(3, 3000, p=shares)
    score = rng.normal(size=(3000, 3)) + sharp * np.eye(3)[kind]
    p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)

    passes = []

    def totals(pulls):
        passes.append(len(pulls))
        return np.array([mixing.state(n, p, x) for x in pulls])

    r, want = mixing.rates(p, mixing.descend(totals)), mixing.wanted(n @ p, mixing.TARGETS)
    assert (r >= 0).all() and np.abs((r * n) @ p / want - 1).max() <= mixing.CLOSE and len(passes) <= 30
    plain = np.ones(3000)
    for _ in range(20_000):
        plain = np.maximum(0, plain - p @ (((plain * n) @ p - want) / n.sum()))
    gap = lambda r: np.abs((r * n) @ p - want).sum() / want.sum()
    assert gap(r) <= gap(plain) + mixing.CLOSE and gap(plain) < 0.2
    if gap(plain) < 1e-6:  # no other rates that meet the targets change less
        assert (r - 1) ** 2 @ n <= (plain - 1) ** 2 @ n * (1 + 1e-3)


@pytest.mark.parametrize("shares", [(0.99, 0.006, 0.004), (1, 0, 0), (0.9, 0.09, 0.01)])
def test_taken_once_a_scarce_domain_drops_no_others(shares):
    rng = np.random.default_rng(8)
    n, kind = rng.integers(1, 2000, 3000).astype(float), rng.choice(3, 3000, p=shares)
    score = rng.normal(size=(3000, 3)) + 8 * np.eye(3)[kind]
    p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
    r = mixing.rates(p, mixing.descend(lambda pulls: np.array([mixing.state(n, p, x) for x in pulls]), once=True))
    assert r[kind == 0].min() > 0.8 and (shares[1] != 0.09 or r[kind == 1].mean() < 0.5)


def test_taken_once_targets_below_every_posterior_drop_few():
    rng = np.random.default_rng(9)
    n, soft = rng.integers(1, 2000, 3000).astype(float), rng.uniform(0.03, 0.15, 3000)
    p = np.stack((1 - 2 * soft, soft, soft), axis=1)
    r = mixing.rates(p, mixing.descend(lambda pulls: np.array([mixing.state(n, p, x) for x in pulls]), once=True))
    assert r.min() > 0.2 and r.mean() > 0.6


def test_mixing_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (7, 0, 0), (None, 1, 1), (5, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = mixing.mixing_rates(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.rate >= 0 for r in rows) and all(r.tokens == 0 for r in rows if r.doc_id in (3, 4, 6))
    once = mixing.labelled(odd.where("doc_id is not null").withColumn("text", F.concat("text", F.col("n_chars").cast("string"))).union(odd.where("doc_id = 1")), labels.unionByName(spark.createDataFrame([(7, 1, 0), (2, 1, 1), (2, 0, 0)], labels.schema)))
    assert {(r.doc_id, r.domain) for r in once.collect()} == {(1, 0), (7, 1), (2, 2)}
    assert mixing.mixing_rates(none, labels).count() == 0 and mixing.mixing_rates(odd, labels.limit(0)).count() == odd.count()


def test_mixing_and_quality_carry_columns(odd, spark):
    from sparkscan.llm import quality

    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    whole = sorted(odd.select("doc_id", "text", "source", "block").collect(), key=str)
    for rows in (mixing.mixing_rates(odd, labels, more=("text", "source", "block")), quality.quality_rules(odd, more=("source", "text", "block"))):
        assert sorted(rows.select("doc_id", "text", "source", "block").collect(), key=str) == whole
    plain, carried = (quality.quality_rules(odd, more=x).select("doc_id", "n_words", "kept").collect() for x in ((), ("text",)))
    assert sorted(plain, key=str) == sorted(carried, key=str)


def test_pipeline_odd_rows(odd, none, spark, tmp_path):
    """Each row stands by itself: ids may be null or repeated. Copies go in the join, which keeps one row of an id; null ids have no copies."""
    import corpus_pipeline as pipeline
    from sparkscan.llm import tables

    sf = "/root/testdata/sf0.001"
    poor = spark.createDataFrame([(1, "too short", "en", "a", 9, 0, 0)], odd.schema)
    stages = dict(pipeline.STAGES)
    rows = lambda x: sorted((r.doc_id or 0, (r.text or "")[:2], r.source or "") for r in x.collect())
    whole = odd.unionByName(poor)
    prose = F.when(F.col("text").startswith("w0"), " ".join(f"w{k}" for k in range(80))).otherwise(F.col("text"))
    assert rows(stages["quality rules"](spark, whole.withColumn("text", prose), sf)) == [(0, "w0", "b"), (1, "w0", "a"), (1, "w0", "a"), (2, "w0", "")]
    assert rows(stages["line dedup"](spark, whole, sf)) == [(0, "w0", "b"), (1, "to", "a"), (1, "w0", "a"), (1, "w0", "a"), (2, "w0", ""), (5, "wo", "c"), (7, "on", "c"), (8, "xx", "c")]
    assert rows(stages["n-gram Jaccard join"](spark, odd, sf)) == [(0, "", ""), (0, "w0", "b"), (1, "w0", "a"), (3, "", "b"), (4, "", "b"), (5, "wo", "c"), (6, " \t", "c"), (7, "on", "c"), (8, "xx", "c")]
    mixed = stages["mixing to target weights"](spark, whole, sf)
    assert {(r.doc_id, r.text) for r in mixed.collect()} <= {(r.doc_id, r.text) for r in whole.collect()}
    pieces = stages["packing"](spark, whole, sf)
    assert pieces.where("start = 0").count() == whole.count()
    for k, (name, stage) in enumerate(pipeline.STAGES):
        with tables.scratch(spark):
            stage(spark, none, sf).write.parquet(str(tmp_path / str(k)))
        assert spark.read.parquet(str(tmp_path / str(k))).count() == 0, name
        assert k == 4 or stage(spark, whole, sf).columns == list(pipeline.COLUMNS), name


def test_scratch_deletes_what_was_cut(odd, spark):
    from sparkscan.llm import tables

    with tables.scratch(spark):
        kept = tables.cut(odd)
        assert kept.count() == odd.count()
        path = kept.inputFiles()[0].rsplit("/", 1)[0]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_the_driver_gives_memory_back_between_queries(odd, spark, tmp_path, monkeypatch):
    from sparkscan.llm import tables

    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    total = lambda: jvm.Runtime.getRuntime().totalMemory() >> 20
    monkeypatch.setattr(tables, "_settled", [float("-inf")], raising=False)
    for _ in range(3):
        blocks = [gateway.new_array(jvm.long, 13 << 20) for _ in range(6)]
        for b in blocks:
            gateway.detach(b)
        del blocks
    grown = total()
    assert grown > 600
    tables.cut_at(odd, str(tmp_path / "cut"))
    assert total() < grown - 200
    last = tables._settled[0]
    tables.settle(spark)
    assert tables._settled[0] == last  # not again so soon


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs, before = spark.read.parquet(f"{sf}/documents.parquet"), None
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == list(pipeline.COLUMNS) and 0 < after.count() <= docs.count()
            assert after.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        if k == 0:
            labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0")
            long = docs.join(labels, "doc_id").where(F.size(F.split(F.trim("text"), r"\s+")) >= 50)
            assert long.join(after, "doc_id", "left_anti").count() == 0
        if k == 2:
            groups = near.near_duplicates(docs)
            assert {r.doc_id for r in after.collect()} == {r.component_id for r in groups.collect()}
        if k == 3:
            assert docs.join(labels, "doc_id").join(after, "doc_id", "left_anti").count() <= docs.count() // 20
        before, docs = docs, after
    assert {r.doc_id for r in before.collect()} == {r.doc_id for r in docs.collect()}
    assert pipeline.run(spark, sf).count() == docs.count()
