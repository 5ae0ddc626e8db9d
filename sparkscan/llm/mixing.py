"""Mixing documents to target weights of domains with soft membership.

A classifier, trained on the labelled table, gives each document's posterior of each domain.  The
domains here are those of the labels: good, poor and toxic text.  A document may then be taken with a rate,
0 or more, and projected gradient descent from rates of 1 fits the rates so that expected tokens of each domain match the targets::

    minimise  |e|^2   with  e_d = sum_i r_i n_i p_id - T_d  and  r_i = max(0, 1 - p_i . u)

n_i are tokens and p_id posteriors.  The gradient by a rate is p_i . e, which needs nothing of other documents but D totals. Steps are summed
in u and the sum is projected onto rates of 0 or more, so all rates follow from D numbers, and of all rates that meet the targets the
descent ends at those nearest to 1 (in squares weighed by tokens). The errors are weighed by the inverse of what a change of the free rates
does to them, so a small target counts as much as a great one. A step is one map over the written table of posteriors (some 40 bytes a
document) and one sum, which tries a few step lengths at once.  Steps end when every
domain is within CLOSE of its own target; where the targets can't be met, after STEPS.

The classifier is fitted on at most SAMPLE labelled rows (a documented bound, chosen by hash of the id); their texts stay on the executors and the
driver gets TELLING words and a few numbers a row. Token counts, posteriors and fitting cover all documents.

Defined results: a null or empty text has no tokens, the posteriors of an empty text, and the rate that its posteriors give;
repeated rows are separate documents, and the first of their texts by order is the labelled one; of conflicting labels of one id the
worse count (toxic before poor before good); a null id is kept; an empty documents table gives no rows; without labelled rows of
two domains every posterior is the labelled shares (all good without any) and all rates follow from those; extra columns are not read, but for
those to carry along (``more``, which must not be named as a result).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .quality import _CLASS, CLASSES
from .tables import batch, cut, pick

DOMAINS = ("good", "poor", "toxic")
TARGETS = (0.97, 0.02, 0.01)  # shares of the expected tokens
SAMPLE = 8_000
CELLS = 1 << 18  # of hashed words
TELLING, LEAST_CHI = 512, 12.0
DENSE = CLASSES + 3
_LETTER = A.table([*range(48, 58), *range(97, 123), *range(128, 256)])
HEADROOM = 1.03
L2 = 2e-4
STEPS = 60
CLOSE = 1e-4  # of a domain's own target
SOFT = 1.0  # for a corpus that takes a document once: how far a domain's relative gap may grow with its pull
LENGTHS = (1.0, 0.5, 0.25, 0.0625)  # of a step, all tried in one pass

_ROWS = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64()), *((f"p_{d}", pa.float64()) for d in DOMAINS)])


def _features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Of each slab: rows, words of each, and (row, cell) of each distinct hashed word with dense features beside:
    shares of byte classes, of distinct words and of words with a symbol, and the logarithm of the length."""
    for i, j, buf, offs in A.slabs(texts):
        starts, ends = A.runs(A.NOT_SPACE[buf], offs)
        first = A.owners(starts, offs)
        n, docs = np.diff(first), j - i
        doc = np.repeat(np.arange(docs), n)
        low = A.lower_ascii(buf)
        ws, we = A.runs(_LETTER[low], offs)
        owner = np.repeat(np.arange(docs), np.diff(A.owners(ws, offs)))
        at = np.unique(owner * CELLS + (A.hash_spans(low, ws, we) % np.uint64(CELLS)).astype(np.int64))
        classes = np.bincount(np.repeat(np.arange(docs), np.diff(offs)) * CLASSES + _CLASS[buf], minlength=docs * CLASSES).reshape(docs, CLASSES)
        odd = np.concatenate(([0], np.cumsum(_CLASS[buf] == 5)))
        dense = np.empty((docs, DENSE))
        dense[:, :CLASSES] = classes / np.maximum(classes.sum(axis=1, keepdims=True), 1)
        distinct = np.unique(A.finish(doc.astype(np.uint64)) ^ A.hash_spans(buf, starts, ends), return_index=True)[1]
        dense[:, CLASSES] = np.bincount(doc[distinct], minlength=docs) / np.maximum(n, 1)
        dense[:, CLASSES + 1] = np.bincount(doc, odd[ends] > odd[starts], docs) / np.maximum(n, 1)
        dense[:, CLASSES + 2] = np.log1p(n) / 10
        yield i, j, n, (at // CELLS, at % CELLS, dense)


class Classifier:
    """Multinomial logistic regression on the presence of telling words and on standardised dense features."""

    def __init__(self, cells: np.ndarray, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray, dense: np.ndarray, bias: np.ndarray):
        self.cells, self.weights, self.mean, self.scale, self.dense, self.bias = cells, weights, mean, scale, dense, bias

    def posteriors(self, docs: int, sparse) -> np.ndarray:
        row, cell, dense = sparse
        return self.of_words(docs, *self.words(row, cell), (dense - self.mean) / self.scale)

    def words(self, row: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, word) of the telling words."""
        if not len(self.cells):
            return row[:0], cell[:0]
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        known = self.cells[at] == cell
        return row[known], at[known]

    def of_words(self, docs: int, row: np.ndarray, word: np.ndarray, x: np.ndarray) -> np.ndarray:
        score = self.bias + x @ self.dense
        for d in range(len(DOMAINS) if len(row) else 0):
            score[:, d] += np.bincount(row, self.weights[word, d], docs)
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        return p / p.sum(axis=1, keepdims=True)


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text and domain of at most ``sample`` labelled documents, the first by hash of the id."""
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null and quality is not null and toxic is not null")
    label = label.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").where("doc_id is not null").join(F.broadcast(label), "doc_id")
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    return rows.groupBy("doc_id", domain.alias("domain")).agg(F.min("text").alias("text")).select("doc_id", "text", "domain")


def telling(sample: DataFrame, sizes: np.ndarray) -> np.ndarray:
    """Cells of words whose presence depends on the domain by a chi-squared statistic of LEAST_CHI, at most TELLING of them."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CELLS, len(DOMAINS)), np.int64)
        for b in batches:
            domain = b.column(2).to_numpy()
            for i, j, _, (row, cell, _) in _features(b.column(1)):
                for d in range(len(DOMAINS)):
                    total[:, d] += np.bincount(cell[domain[i:j][row] == d], minlength=CELLS)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, d]) for d in range(len(DOMAINS)))], names=["cell", *(f"n{d}" for d in range(len(DOMAINS)))])

    counts = sample.mapInArrow(seen, "cell long, " + ", ".join(f"n{d} long" for d in range(len(DOMAINS)))).groupBy("cell").agg(*(F.sum(f"n{d}").alias(f"n{d}") for d in range(len(DOMAINS))))
    total = sum((F.col(f"n{d}") for d in range(1, len(DOMAINS))), F.col("n0"))
    share = total / float(sizes.sum())
    chi = sum(((F.col(f"n{d}") - float(n) * share) ** 2 / (float(n) * share * (1 - share)) for d, n in enumerate(sizes.tolist()) if n), F.lit(0.0))
    best = counts.where((total >= 5) & (share < 1)).withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "cell").limit(TELLING)
    return np.sort(np.array([r.cell for r in best.select("cell").collect()], np.int64))


def train(sample: DataFrame, rounds: int = 300, rate: float = 0.03) -> Classifier:
    """By full-batch gradient with per-weight steps, over at most TELLING bits and DENSE numbers of each row of the sample."""
    k = len(DOMAINS)
    sizes = np.zeros(k)
    for r in sample.groupBy("domain").count().collect():
        sizes[r.domain] = r["count"]
    nothing = np.zeros((0, k)), np.zeros(DENSE), np.ones(DENSE), np.zeros((DENSE, k))
    if np.count_nonzero(sizes) < 2:
        return Classifier(np.zeros(0, np.int64), *nothing, np.log(np.maximum(sizes / max(sizes.sum(), 1) if sizes.sum() else [1, 0, 0], 1e-6)))
    cells = telling(sample, sizes)
    blank = Classifier(cells, *nothing, np.zeros(k))

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, _, (row, cell, dense) in _features(b.column(1)):
                told, word = blank.words(row, cell)
                first = np.searchsorted(told, np.arange(j - i + 1))
                words = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(word, pa.int32()))
                values = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * DENSE, pa.int32()), pa.array(dense.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(2)[i:j], words, values], names=["doc_id", "domain", "words", "dense"])

    got = sample.mapInArrow(design, "doc_id long, domain int, words array<int>, dense array<double>").toArrow().sort_by("doc_id")
    n, domain = got.num_rows, got["domain"].to_numpy()
    words = got["words"].combine_chunks()
    word = words.flatten().to_numpy().astype(np.int64)
    told = np.repeat(np.arange(n), np.diff(words.offsets.to_numpy()))
    dense = got["dense"].combine_chunks().flatten().to_numpy().reshape(n, DENSE)
    model = Classifier(cells, np.zeros((len(cells), k)), dense.mean(axis=0), dense.std(axis=0) + 1e-3, np.zeros((DENSE, k)), np.log(np.maximum(sizes / n, 1e-6)))
    x, want = (dense - model.mean) / model.scale, np.eye(k)[domain]
    speed = [np.full(w.shape, 1e-8) for w in (model.weights, model.dense, model.bias)]
    for _ in range(rounds):
        wrong = (model.of_words(n, told, word, x) - want) / n
        up = np.stack([np.bincount(word, wrong[told, d], len(cells)) for d in range(k)], axis=1) if len(cells) else model.weights
        grads = [up + L2 * model.weights, x.T @ wrong + L2 * model.dense, wrong.sum(axis=0)]
        for weight, grad, s in zip((model.weights, model.dense, model.bias), grads, speed, strict=True):
            s *= 0.98
            s += 0.02 * grad**2
            weight -= rate * grad / np.sqrt(s)
        rate *= 0.99
    return model


def memberships(docs: DataFrame, model: Classifier, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, tokens (words), the posterior of each domain and the columns named in more, by row of docs, which starts with id and text."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    at = [docs.columns.index(c) for c in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, n, sparse in _features(b.column(1)):
                row = batch(_ROWS, b.column(0)[i:j], n, *model.posteriors(j - i, sparse).T)
                yield pa.RecordBatch.from_arrays([*row.columns, *(b.column(k)[i:j] for k in at)], names=[*row.schema.names, *more])

    return docs.mapInArrow(run, "doc_id long, tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS) + "".join(f", `{c}` {kinds[c]}" for c in more))


def rates(p: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """Rates after steps that sum up to a pull on the domains."""
    return np.maximum(0, 1 - p @ pull)


def wanted(have: np.ndarray, targets, once: bool = False) -> np.ndarray:
    """Tokens to reach in each domain. The one with the greatest target is asked for a little more than there is, so that its documents are
    taken once at least. A corpus that takes each document once at most can't hold more of a domain than there is: with ``once``
    no domain is asked for more, as a scarce one could only grow in share by dropping documents of the others."""
    share = np.array(targets, float) / sum(targets)
    most = int(np.argmax(share))
    want = share * HEADROOM * float(have[most] / share[most])
    return np.minimum(want, have) if once else want


def state(n: np.ndarray, p: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """What documents add to the sums after a pull: tokens of each domain, half their rates' squares by tokens, and products of posteriors by
    tokens over free rates, those above 0."""
    r = rates(p, pull)
    return np.concatenate(((r * n) @ p, [(r * r) @ n / 2], ((p * (n * (r > 0))[:, None]).T @ p).reshape(-1)))


def descend(totals, targets=TARGETS, once: bool = False) -> np.ndarray:
    """The sum of the descent's steps; totals(pulls) gives the sums of state for each of several pulls.

    A step weighed by the free rates' products would meet the targets if no more rates ran into 0, but may be too long; one weighed by
    all rates' products never is. Of these and of shorter ones the best is taken. With ``once`` a domain's pull ends at its relative gap over
    SOFT: targets that no rates can meet, as every posterior is above them, would otherwise pull nearly all rates to 0.
    """
    k = len(targets)
    pull = np.zeros(k)
    now = totals([pull])[0]
    if not now[:k].sum():
        return pull
    whole = now[k + 1 :].reshape(k, k)
    ridge, want = 1e-9 * np.trace(whole) * np.eye(k), wanted(now[:k], targets, once)
    hold = want * SOFT * once
    ridge = ridge + np.diag(hold)
    for _ in range(STEPS):
        gap = now[:k] - want - hold * pull
        if (np.abs(gap) <= CLOSE * want).all():
            break
        step = np.linalg.solve(now[k + 1 :].reshape(k, k) + ridge, gap)
        tries = [*(pull + c * step for c in LENGTHS), pull + np.linalg.solve(whole + ridge, gap)]
        # The gaps are the gradient of this convex sum, which a good step lowers most.
        now, pull = min(zip(totals(tries), tries, strict=True), key=lambda x: x[0][k] + x[1] @ (want + hold * x[1] / 2))
    return pull


def fit(members: DataFrame, targets=TARGETS, once: bool = False) -> np.ndarray:
    """The pull from which every document's rate follows by its posteriors."""
    k = len(DOMAINS)
    size = k + 1 + k * k
    needed = members.select("doc_id", "tokens", *(f"p_{d}" for d in DOMAINS))

    def totals(pulls: list[np.ndarray]) -> np.ndarray:
        names = [f"x{i}" for i in range(size * len(pulls))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(pulls), size))
            for b in batches:
                n, p = b.column(1).to_numpy().astype(float), np.stack([b.column(2 + d).to_numpy() for d in range(k)], axis=1)
                out += [state(n, p, x) for x in pulls]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out.reshape(-1)], names=names)

        got = needed.mapInArrow(run, ", ".join(f"{x} double" for x in names)).agg(*(F.sum(x) for x in names)).first()
        return np.array([x or 0 for x in got], float).reshape(len(pulls), size)

    return descend(totals, targets, once)


def with_rates(members: DataFrame, pull: np.ndarray) -> DataFrame:
    """members with their ``rates``, by one expression."""
    pulled = sum((F.col(f"p_{d}") * float(u) for d, u in zip(DOMAINS, pull, strict=True)), F.lit(0.0))
    return members.withColumn("rate", F.greatest(F.lit(0.0), 1 - pulled))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets=TARGETS, doc_id: str = "doc_id", text: str = "text", more: tuple[str, ...] = (), once: bool = False) -> DataFrame:
    """doc_id, tokens, posteriors, the columns named in more and rate, by row of docs; once: for a corpus that takes a document at most once."""
    own = pick(docs, doc_id, text)
    carried = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string").alias(text), *(c for c in more if c != text))
    members = cut(memberships(carried, train(cut(labelled(own, labels))), more))
    return with_rates(members, fit(members, targets, once))
