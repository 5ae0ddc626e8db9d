"""Personal data: fixed base patterns plus a semi-Markov conditional random field.

The field scores whole candidate segments of up to MAX_ATOMS atoms (runs of letters and digits, runs of white space, single signs) by features of the
span as a whole, and dynamic programming picks boundaries and types together.  Only a
segment with a digit or an at sign can be an entity, and none goes over a line's end, so atoms farther than
MAX_ATOMS from any of those are outside under every labelling, and the rest falls into
independent stretches; decoding each gives the whole text's best labelling, however long a stretch or an atom is.

Weights come from maximum likelihood on generated sentences (fixed seed).

Defined results: a null text is empty; repeated rows each give a row; an empty table
gives no rows; a method span that overlaps a base span gives way to it; only the id and
text columns are read.  Offsets are code points.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A
from .tables import batch, pick

KINDS = ("email", "ip", "card", "phone", "secret")
MAX_ATOMS = 16
BLOCK = 4096  # atoms whose segments are scored at once
OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64()), ("n_more", pa.int64())])

# The base patterns. Matches start where a run of digits starts in any case, so saying it only saves retries.
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = A.table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-").tolist()
_IP = re.compile(rb"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(rb"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_KIND = np.full(256, 2, np.uint8)  # signs, each an atom
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_KIND[list(A.SPACES)] = 1


def luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(span: bytes) -> bytes:
    return bytes(c for c in span if 48 <= c <= 57)


def _small(part: bytes) -> bool:
    part = part.lstrip(b"0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, sorted."""
    out, done, at = [], 0, text.find(b"@")
    while at >= 0:
        left = at
        while left > done and _LOCAL[text[left - 1]]:
            left -= 1
        if left < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((left, 0, m.end()))
            done = m.end()
        at = text.find(b"@", max(at + 1, done))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(b".")))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if b"+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# Whole-span features of a candidate; each entity type has a weight for each.
_SPAN = {
    "email": re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*"),
    "dotted": re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(rb"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "ip6": re.compile(rb"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"),
    "card": re.compile(rb"[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{2,7}"),
    "phone": re.compile(rb"(?:\+|00)?(?:[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,5}"),
    "hex": re.compile(rb"(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}|(?=[0-9]*[A-F])(?=[A-F]*[0-9])[0-9A-F]{32,}"),
}
FEATURES = ("bias", *_SPAN, "plus", "luhn", "digits 10-15", "digits 14-19", "digits under 7", "at sign", "glued left", "glued right", "goes on", "16 digits", "edge is space or punctuation", "long")


def _features(text: bytes, s: int, e: int, n: int) -> np.ndarray:
    span = text[s:e]
    digits = _digits(span)
    glue = lambda c: bool(re.match(rb"[A-Za-z0-9_\x80-\xff@]", c))
    return np.array([
        1, *(bool(p.fullmatch(span)) for p in _SPAN.values()), span[:1] == b"+", 13 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15, 14 <= len(digits) <= 19, len(digits) < 7, b"@" in span,
        glue(text[s - 1 : s]) if s else False, glue(text[e : e + 1]), bool(re.match(rb"[.:-][A-Za-z0-9]", text[e : e + 2])), len(digits) == 16, not (re.match(rb"[A-Za-z0-9+(]", span[:1]) and re.match(rb"[A-Za-z0-9]", span[-1:])), n > 12,
    ], float)


def _atoms(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges of the atoms of a text, and which are live (have a digit or an at sign), blank or end a line."""
    buf = np.frombuffer(text, np.uint8)
    kind = _KIND[buf]
    new = np.ones(len(buf), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    first = np.flatnonzero(new)
    some = lambda member: np.logical_or.reduceat(member, first) if len(first) else np.zeros(0, bool)
    return np.append(first, len(buf)), some((buf - np.uint8(48) < 10) | (buf == 64)), kind[first] == 1, some(buf == 10)


def _stretches(live: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Runs of atoms that segments may lie in."""
    n, at = len(live), np.flatnonzero(live)
    near = np.zeros(n + 1, np.int64)
    np.add.at(near, np.maximum(at - MAX_ATOMS + 1, 0), 1)
    np.add.at(near, np.minimum(at + MAX_ATOMS, n), -1)
    inside = np.concatenate(([False], (np.cumsum(near[:n]) > 0) & ~ends, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _segments(text: bytes, edges: list[int], live: list[bool], blank: list[bool], ends: list[bool], a: int = 0, b: int | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Candidate (first atom, atom past the last) that begin in atoms a .. b and hold a live atom, and their features."""
    out, n = [], len(live)
    for i in range(a, n if b is None else b):
        if blank[i]:
            continue
        seen = False
        for j in range(i, min(i + MAX_ATOMS, n)):
            if ends[j]:
                break
            seen = seen or live[j]
            if seen and not blank[j]:
                out.append((i, j + 1))
    rows = [_features(text, edges[i], edges[j], j - i) for i, j in out]
    return out, np.array(rows) if rows else np.zeros((0, len(FEATURES)))


def _sentences(rng: random.Random, n: int) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Generated sentences with their entities, and look-alikes that are none."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = rng.choice("345") + num(14)
        d = next(d for d in "0123456789" if luhn((body + d).encode()))
        sep = rng.choice(["", " ", "-"])
        return sep.join((body + d)[k : k + 4] for k in range(0, 16, 4))

    make = {
        0: lambda: rng.choice(["{}.{}@{}.com", "{}{}@{}.example.org", "{}-{}@{}"]).format(word(), word() if rng.random() < 0.5 else num(2), word()),
        1: lambda: rng.choice([".".join(str(rng.randint(0, 255)) for _ in range(4)), ":".join(f"{rng.randint(4096, 65535):x}" for _ in range(8))]),
        2: card,
        3: lambda: rng.choice([f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(4)}"]),
        4: lambda: rng.choice([str, str.upper])("".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64])))),
    }
    other = [lambda: num(rng.randint(1, 13)), lambda: f"{num(1)}.{num(1)}", lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: word() + num(2), lambda: f"{num(16)}9", lambda: f"{num(1)}.{num(1)}.{num(2)}", lambda: num(3) + " " + num(3), lambda: f"{word()}@ {num(2)}"]
    for _ in range(n):
        text, gold = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 3))) + rng.choice([" ", ", ", ' = "', ": "])
            kind = rng.randrange(len(make) + 3)
            item = make[kind]() if kind in make else rng.choice(other)()
            if kind in make:
                gold.append((len(text), len(text) + len(item), kind))
            text += item + rng.choice([" ", ". ", ", ", '" '])
        yield (text + word()).encode(), gold


@lru_cache(maxsize=1)
def weights(sentences: int = 120, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Features by type, by gradient ascent on the regularised likelihood (exact forward-backward sums)."""
    data = []
    for text, gold in _sentences(random.Random(seed), sentences):
        edges, *marks = (x.tolist() for x in _atoms(text))
        segments, rows = _segments(text, edges, *marks)
        at = {(edges[i], edges[j]): k for k, (i, j) in enumerate(segments)}
        data.append((len(edges) - 1, segments, rows, [(at[s, e], k) for s, e, k in gold if (s, e) in at]))
    w, speed = np.zeros((len(FEATURES), len(KINDS))), np.zeros((len(FEATURES), len(KINDS)))
    for _ in range(rounds):
        grad = -0.002 * w * len(data)
        for n, segments, rows, gold in data:
            p = _marginals(n, segments, rows @ w)
            grad -= rows.T @ p
            for k, kind in gold:
                grad[:, kind] += rows[k]
        speed += grad**2
        w += 0.9 * grad / np.sqrt(speed + 1e-9)
    return w


def _marginals(n: int, segments: list[tuple[int, int]], score: np.ndarray) -> np.ndarray:
    """Probability of each (segment, type)."""
    best = np.logaddexp.reduce(score, axis=1) if len(segments) else np.zeros(0)
    into, out = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for k, (i, j) in enumerate(segments):
        into[j].append(k)
        out[i].append(k)
    fore, back = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        fore[j] = np.logaddexp.reduce([fore[j - 1], *(fore[segments[k][0]] + best[k] for k in into[j])])
    for i in range(n - 1, -1, -1):
        back[i] = np.logaddexp.reduce([back[i + 1], *(back[segments[k][1]] + best[k] for k in out[i])])
    ij = np.array(segments).reshape(-1, 2)
    return np.exp(fore[ij[:, 0], None] + score + back[ij[:, 1], None] - fore[n])


def _best(text: bytes, edges: list[int], live: list[bool], blank: list[bool], ends: list[bool], w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the best labelling of a run of atoms. Segments are scored in blocks; the best labelling up to an atom goes on from one to the next."""
    n = len(live)
    into: dict[int, list[tuple[float, int, int]]] = {}
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        segments, rows = _segments(text, edges, live, blank, ends, a, b)
        score = rows @ w
        kind = score.argmax(axis=1)
        top = score.max(axis=1) if len(segments) else np.zeros(0)
        for k in np.flatnonzero(top > 0).tolist():  # else leaving it outside is no worse
            i, j = segments[k]
            into.setdefault(j, []).append((float(top[k]), i, int(kind[k])))
        for j in range(a + 1, b + 1):  # all segments that end here begin before b
            most, by = best[j - 1], None
            for v, i, c in into.pop(j, ()):
                if best[i] + v > most:
                    most, by = best[i] + v, (i, c)
            best[j], back[j] = most, by
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, c = back[j]
            out.append((edges[i], c, edges[j]))
            j = i
    return out[::-1]


def decode(text: bytes, w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the best labelling of a whole text."""
    return _best(text, *(x.tolist() for x in _atoms(text)), w)


def method_spans(text: bytes, w: np.ndarray) -> list[tuple[int, int, int]]:
    """The same, by stretches."""
    edges, live, blank, ends = _atoms(text)
    out = []
    for a, b in _stretches(live, ends):
        out += _best(text, edges[a : b + 1].tolist(), live[a:b].tolist(), blank[a:b].tolist(), ends[a:b].tolist(), w)
    return out


def find(text: bytes, w: np.ndarray) -> tuple[list, list]:
    """Base spans and all spans, in bytes."""
    base = base_spans(text)
    more, k = [], 0
    ordered = sorted((s, e) for s, _, e in base)
    reach = -1
    for s, kind, e in sorted(method_spans(text, w)):
        while k < len(ordered) and ordered[k][0] < e:
            reach = max(reach, ordered[k][1])
            k += 1
        if reach <= s:
            more.append((s, kind, e))
    return base, sorted(base + more)


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> str:
    if not text.isascii() and spans:
        before = np.zeros(len(text) + 1, np.int64)
        np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, out=before[1:])
        spans = [(before[s], k, before[e]) for s, k, e in spans]
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of base spans, all spans, their number and that of the method's own, by row of docs."""
    w = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = ([0] * 4, sha256(b"").hexdigest(), "", 0, 0)
        for b in batches:
            for i, j, buf, offs in A.slabs(b.column(1)):
                hot = A.sums(((buf - np.uint8(48) < 10) | (buf == 64)).astype(np.int64), offs)
                rows = [nothing] * (j - i)
                for d in np.flatnonzero(hot).tolist():
                    raw = buf[offs[d] : offs[d + 1]].tobytes()
                    base, spans = find(raw, w)
                    n = [0] * 4
                    for _, k, _ in base:
                        n[k] += 1
                    rows[d] = (n, sha256(_points(raw, base).encode()).hexdigest(), _points(raw, spans), len(spans), len(spans) - len(base))
                yield batch(OUT, b.column(0)[i:j], *([r[0][k] for r in rows] for k in range(4)), *([r[k] for r in rows] for k in range(1, 5)))

    return pick(docs, doc_id, text).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_more long")
