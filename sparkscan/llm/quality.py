"""Quality rules with a distribution-divergence verdict.

``reference`` counts, over all documents of each language, character classes and
words (hashed into ``BUCKETS`` buckets), and keeps the ``COMMON`` heaviest buckets as the
language's common words.  ``assess`` computes rule counts and both Jensen-Shannon
distances of each document from its language's reference.

Defined results: a null text is an empty one; a null language is a language
of its own; a language of fewer than ``ENOUGH`` words, whatever its share, has distances from all languages
together, by which its documents are not judged; repeated rows each give a row; an empty table gives no rows; columns other than the three
and those to carry along (``more``, which must not be named as a result) are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .tables import batch, pick

BUCKETS = 1 << 14
COMMON = 128
ENOUGH = 32 * COMMON  # words of a language that make a reference
#: Verdict: distances up to these plus SLACK / sqrt(words) pass; texts under MIN_WORDS are not judged by distance.
MAX_CLASS, MAX_WORD, SLACK, MIN_WORDS = 0.18, 0.42, 1.2, 60
NO_LANG, ALL = "", "*"

# Fixed: byte classes are lower, upper, digit, space, plain punctuation, symbol, non-ASCII letter byte, control.
_CLASS = np.full(256, 7, np.uint8)
_CLASS[128:] = 6
_CLASS[33:127] = 5
_CLASS[list(b".,;:'\"!?()-")] = 4
_CLASS[list(A.SPACES)] = 3
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 2, 1, 0
CLASSES = 8
_SYMBOL = A.table(b"#*$%&|<>")

REF = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("class_distance", pa.float64()), ("word_distance", pa.float64()), ("judged", pa.bool_())])


def _words(buf: np.ndarray, offs: np.ndarray):
    inside = A.NOT_SPACE[buf]
    starts, ends = A.runs(inside, offs)
    return inside, starts, ends, A.owners(starts, offs)


def _classes(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bytes of each class by document."""
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    return np.bincount(doc * CLASSES + _CLASS[buf], minlength=(len(offs) - 1) * CLASSES).reshape(-1, CLASSES)


def _buckets(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (A.hash_spans(A.lower_ascii(buf), starts, ends) % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column(1).fill_null(NO_LANG).dictionary_encode()
        codes, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()
        for i, j, buf, offs in A.slabs(b.column(0)):
            _, starts, ends, first = _words(buf, offs)
            classes, code = _classes(buf, offs), codes[i:j]
            bucket, owner = _buckets(buf, starts, ends), np.repeat(code, np.diff(first))
            for k in np.unique(code):
                t = totals.setdefault(names[k], np.zeros(CLASSES + BUCKETS, np.int64))
                t[:CLASSES] += classes[code == k].sum(axis=0)
                t[CLASSES:] += np.bincount(bucket[owner == k], minlength=BUCKETS)
        while len(totals) > 64:  # a language column may hold anything
            lang, t = totals.popitem()
            yield _sparse(lang, t)
    for lang, t in totals.items():
        yield _sparse(lang, t)


def _sparse(lang: str, t: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(t)
    return batch(REF, pa.array([lang]).take(pa.array(np.zeros(len(at), np.int32))), at.astype(np.int32), t[at])


def reference(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple]:
    """Language -> (class shares, common buckets, shares of those and of all other words).

    Counted over every document.  Languages of ENOUGH words, each of COMMON + CLASSES
    numbers, reach the driver.
    """
    counts = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = counts.unionByName(counts.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(ALL)))
    word = F.col("bucket") >= CLASSES
    top = F.slice(F.sort_array(F.collect_list(F.when(word, F.struct("n", "bucket"))), asc=False), 1, COMMON).alias("common")
    per = counts.groupBy("lang").agg(F.sum(F.when(word, F.col("n"))).alias("words"), F.collect_list(F.when(~word, F.struct("bucket", "n"))).alias("classes"), top)
    out = {}
    for row in per.where((F.col("words") >= ENOUGH) | (F.col("lang") == ALL)).collect():
        if not row.words:
            continue
        classes = np.zeros(CLASSES)
        for x in row.classes:
            classes[x.bucket] = x.n
        ids = np.array([x.bucket - CLASSES for x in row.common], np.int64)
        n = np.array([x.n for x in row.common], float)
        out[row.lang] = (classes / max(classes.sum(), 1), ids, np.append(n, row.words - n.sum()) / row.words)
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of p from q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def _assess(refs: dict[str, tuple], carried: list[int]):
    """Rows for batches of id, text, language and others; carried are the places of the columns that come back beside."""
    names = sorted(refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_of = {name: k for k, name in enumerate(names)}
        for b in batches:
            langs = b.column(2).fill_null(NO_LANG).dictionary_encode()
            to = np.array([code_of.get(x, code_of.get(ALL, 0)) for x in langs.dictionary.to_pylist()] or [0])
            own = np.array([x in code_of for x in langs.dictionary.to_pylist()] or [False])
            indices = langs.indices.to_numpy(zero_copy_only=False)
            codes, judged = to[indices], own[indices]
            for i, j, buf, offs in A.slabs(b.column(1)):
                row = _rows(b.column(0)[i:j], buf, offs, codes[i:j], judged[i:j])
                yield pa.RecordBatch.from_arrays([*row.columns, *(b.column(k)[i:j] for k in carried)], names=[*row.schema.names, *(f"m{k}" for k in range(len(carried)))])

    def _rows(ids, buf, offs, code, judged):
        docs = len(offs) - 1
        inside, starts, ends, first = _words(buf, offs)
        n = np.diff(first)
        doc = np.repeat(np.arange(docs), n)
        chars = A.sums((inside & ((buf & 0xC0) != 0x80)).astype(np.int64), offs)
        symbols = A.sums(_SYMBOL[buf].astype(np.int64), offs)
        # lines with a word, equal to an earlier line of the same document
        ls, le = A.runs(buf != 10, offs)
        worded = np.searchsorted(starts, ls) < np.searchsorted(starts, le)
        ls, le = ls[worded], le[worded]
        owner = np.searchsorted(offs, ls, "right") - 1
        lines = np.unique(A.hash_spans(buf, ls, le, most=512) ^ A.finish(owner.astype(np.uint64)), return_index=True)[1]
        dup_lines = np.bincount(owner, minlength=docs) - np.bincount(owner[lines], minlength=docs)
        # words in 3-word windows that occur twice
        hashes = A.hash_spans(buf, starts, ends)
        at = A.window_starts(first, 3)
        found = np.zeros(len(starts) + 2, bool)
        if len(at):
            key = A.roll(hashes, 3)[at] ^ A.finish(doc[at].astype(np.uint64))
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            for d in range(3):
                found[at[twice] + d] = True
        repeat = A.sums(found[: len(starts)].astype(np.int64), first)
        class_d, word_d = np.zeros(docs), np.zeros(docs)
        if names:
            classes, bucket = _classes(buf, offs).astype(float), _buckets(buf, starts, ends)
            used, row = np.unique(code, return_inverse=True)
            slot = np.full((len(used), BUCKETS), COMMON, np.int64)
            for k, name in enumerate(used):
                slot[k, refs[names[name]][1]] = np.arange(len(refs[names[name]][1]))
            which = np.bincount(doc * (COMMON + 1) + slot[row[doc], bucket], minlength=docs * (COMMON + 1)).reshape(docs, -1).astype(float)
            classes /= np.maximum(classes.sum(axis=1, keepdims=True), 1)
            which /= np.maximum(n[:, None], 1)
            for k in used:
                mine = code == k
                ref, common, shares = refs[names[k]]
                full = np.zeros(COMMON + 1)
                full[: len(common)], full[COMMON] = shares[:-1], shares[-1]
                class_d[mine], word_d[mine] = distance(classes[mine], ref), distance(which[mine], full)
        return batch(OUT, ids, n, chars, symbols, dup_lines, repeat, class_d, word_d, pa.array(judged))

    return run


def assess(docs: DataFrame, refs: dict[str, tuple], doc_id: str = "doc_id", text: str = "text", lang: str = "lang", more: tuple[str, ...] = ()) -> DataFrame:
    """Rule counts and distances of each row of docs, whether these are from its own language, and the columns named in more."""
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, judged boolean"
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    others = [c for c in more if c != text or kinds[c] != "string"]  # the text is there already
    carried = [3 + others.index(c) if c in others else 1 for c in more]
    rows = pick(docs, doc_id, text, F.col(lang).cast("string").alias("lang"), *(F.col(c).alias(f"m{k}") for k, c in enumerate(others)))
    rows = rows.mapInArrow(_assess(refs, carried), schema + "".join(f", m{k} {kinds[c]}" for k, c in enumerate(more)))
    return rows.withColumnsRenamed({f"m{k}": c for k, c in enumerate(more)})


def judge(rows: DataFrame, max_class: float = MAX_CLASS, max_word: float = MAX_WORD) -> DataFrame:
    """With base_failed and kept."""
    n = F.col("n_words")
    slack = SLACK / F.sqrt(F.greatest(n, F.lit(1)).cast("double"))
    base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    near = (n < MIN_WORDS) | ~F.col("judged") | ((F.col("class_distance") <= max_class + slack) & (F.col("word_distance") <= max_word + slack))
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & near).drop("judged")


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", more: tuple[str, ...] = ()) -> DataFrame:
    return judge(assess(docs, reference(docs, text, lang), doc_id, text, lang, more))
