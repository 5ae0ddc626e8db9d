"""Licence scan with a generalised suffix automaton over licence tokens.

All templates go into one automaton.  A document's words stream through it and give
matching statistics: at each word, the longest suffix that occurs in some template.
Base phrases are suffixes of such matches; long maximal matches are chained in order
within each template and the template's covered share decides the method's labels.
``spans`` has each chain that covers enough: label, number of the template, first word and
the word past the last in the document, and share; chains of one template don't overlap.

Only word runs whose neighbouring words also neighbour in a template can hold a match
of two words or more, so the automaton is stepped on those runs alone: the statistics
of 2 and above are the same as from stepping it on every word.

Defined results: a null or wordless text has no places, null first and last word, empty
labels and score 0; repeated rows each give a row; an empty table gives no rows; only the
id and text columns are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A
from .tables import batch, pick

# The base phrases with their labels, public licence notices and short licences in full, in words.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICES = {
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "lgpl": ["gnu lesser general public license as published by the free software foundation"],
    "apache": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "cc-by-sa": ["licensed under cc by sa 4 0"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "agpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "epl": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
}
_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability
whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
{one}redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
{two}redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
{three}this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of
merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special
exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused
and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised
of the possibility of such damage"""
_ENDORSE = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
FULL = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _WARRANTY
    ],
    "bsd": [_BSD.format(one="1 ", two="2 ", three=""), _BSD.format(one="1 ", two="2 ", three="3 " + _ENDORSE)],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable "
        "for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
        "arising out of or in connection with the use or performance of this software"
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain "
        "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights "
        "to this software under copyright law " + _WARRANTY
    ],
    "boost": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute "
        "and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following "
        "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works "
        "of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"
    ],
}
TEMPLATES = {label: [*NOTICES.get(label, []), *FULL.get(label, [])] for label in dict.fromkeys([*NOTICES, *FULL])}
MIN_MATCH = 4  # words of a match that takes part in a chain
MIN_COVER = 0.6  # of a template's words
MAX_GAP = 8  # words skipped between two links of a chain, in document or template

SPANS = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("share", pa.float64())]))
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", SPANS), ("n_spans", pa.int64())])
WORD = A.table([*range(48, 58), *range(97, 123), *range(128, 256)])


@dataclass
class Automaton:
    """A generalised suffix automaton over integer tokens, with every end position of every state."""

    go: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, go: dict[int, int], link: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.go) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.go[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.go[p].get(c) == q:
            self.go[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.go[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.go[p]:
            self.go[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.go[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, tokens: list[int]) -> None:
        last = 0
        for c in tokens:
            last = self._extend(last, c)

    def mark(self, template: int, tokens: list[int]) -> None:
        """Once all templates are in: note (template, end) at every state that ends there."""
        state = 0
        for k, c in enumerate(tokens):
            s = state = self.go[state][c]
            while s > 0:
                self.ends[s].append((template, k + 1))
                s = self.link[s]

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        while state and c not in self.go[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.go[state].get(c)
        return (0, 0) if to is None else (to, matched + 1)


@dataclass
class Scanner:
    """Templates compiled for slabs of text."""

    base: dict[str, str]
    notices: dict[str, list[str]]

    def __post_init__(self) -> None:
        self.vocabulary: dict[str, int] = {}
        code = lambda text: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in text.split()]
        self.phrases = [(code(p), label) for p, label in self.base.items()]
        self.templates = [(code(t), label) for label, ts in self.notices.items() for t in ts]
        self.auto = Automaton()
        sequences = [t for t, _ in [*self.phrases, *self.templates]]
        for s in sequences:
            self.auto.add(s)
        for k, (s, _) in enumerate(self.templates):
            self.auto.mark(k, s)
        self.found: list[list[tuple[int, int]]] = [[] for _ in self.auto.go]  # phrases that end in a state: (words, phrase)
        for k, (s, _) in enumerate(self.phrases):
            at = 0
            for c in s:
                at = self.auto.go[at][c]
            self.found[at].append((len(s), k))
        self.inherited = []
        for s in range(len(self.auto.go)):
            out, at = [], s
            while at > 0:
                out += self.found[at]
                at = self.auto.link[at]
            self.inherited.append(out)
        words = [w.encode() for w in self.vocabulary]
        buf = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        hashes = A.hash_spans(buf, ends - [len(w) for w in words], ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        n = len(words)
        pairs = lambda seqs: np.unique([a * n + b for s in seqs for a, b in zip(s, s[1:], strict=False)])
        self.pairs, self.base_pairs = pairs(sequences), pairs([s for s, _ in self.phrases])

    def scan(self, ids: pa.Array, buf: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        buf = A.lower_ascii(buf)
        starts, ends = A.runs(WORD[buf], offs)
        first, docs = A.owners(starts, offs), len(offs) - 1
        h = A.hash_spans(buf, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        code = np.where(self.hashes[at] == h, self.order[at], -1) if len(h) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(docs), np.diff(first))
        out = [np.zeros(docs, np.int64), [None] * docs, [None] * docs, [set() for _ in range(docs)], [set() for _ in range(docs)], np.zeros(docs), [[] for _ in range(docs)]]
        if len(code) > 1:
            both = (code[:-1] >= 0) & (code[1:] >= 0) & (doc[:-1] == doc[1:])
            pair = code[:-1] * len(self.vocabulary) + code[1:]
            linked = both & np.isin(pair, self.pairs)
            rs, re = A.runs(linked, np.array([0, len(linked)]))
            seeds = np.concatenate(([0], np.cumsum(both & np.isin(pair, self.base_pairs))))
            keep = (re - rs + 1 >= MIN_MATCH) | (seeds[re] > seeds[rs])
            matches: dict[int, list] = {}
            for s, e in zip(rs[keep].tolist(), re[keep].tolist(), strict=True):
                d = int(doc[s])
                self._run(code[s : e + 1].tolist(), s - int(first[d]), d, out, matches)
            for d, found in matches.items():
                self._chain(found, d, out)
        join = lambda sets: [",".join(sorted(s)) for s in sets]
        for own, more in zip(out[4], out[3], strict=True):
            own |= more
        return batch(OUT, ids, np.diff(first), out[0], out[1], out[2], join(out[3]), join(out[4]), out[5], out[6], [len(x) for x in out[6]])

    def _run(self, codes: list[int], at: int, d: int, out: list, matches: dict[int, list]) -> None:
        count, firsts, lasts, labels = out[:4]
        state = matched = 0
        for k, c in enumerate(codes):
            before, length = state, matched
            state, matched = self.auto.step(state, matched, c)
            if matched <= length and length >= MIN_MATCH:  # the match could not grow: it is maximal
                matches.setdefault(d, []).append((at + k - length, length, before))
            for words, phrase in self.inherited[state]:
                if words <= matched:
                    start = at + k + 1 - words
                    count[d] += 1
                    firsts[d] = start if firsts[d] is None else min(firsts[d], start)
                    lasts[d] = start if lasts[d] is None else max(lasts[d], start)
                    labels[d].add(self.phrases[phrase][1])
        if matched >= MIN_MATCH:
            matches.setdefault(d, []).append((at + len(codes) - matched, matched, state))

    def _chain(self, found: list[tuple[int, int, int]], d: int, out: list) -> None:
        """Per template, the chain of matches in order in both texts that covers most words."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for start, length, state in found:
            for template, end in self.auto.ends[state]:
                by.setdefault(template, []).append((start, end - length, length))
        for template, links in by.items():
            links.sort()
            words, label = self.templates[template]
            best, first = _covers(links)
            out[5][d] = max(out[5][d], max(best) / len(words))
            while links:
                taken = _apart(links, best, first, MIN_COVER * len(words))
                for k in taken:
                    out[4][d].add(label)
                    out[6][d].append({"label": label, "template": template, "first_word": first[k], "end_word": links[k][0] + links[k][2], "share": best[k] / len(words)})
                spans = sorted((first[k], links[k][0] + links[k][2]) for k in taken)
                links = [x for x in links if not _meets(spans, x[0], x[0] + x[2])] if spans else []
                if links:  # what is left may hold chains that led through the taken ones
                    best, first = _covers(links)
        out[6][d].sort(key=lambda x: (x["first_word"], x["end_word"], x["template"]))


def _covers(links: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Of the best chain that ends in each link: words and the document's first word. Links end in the order in which they start."""
    best: list[int] = []
    first: list[int] = []
    for k, (s, t, n) in enumerate(links):
        most, start, j = 0, s, k - 1
        while j >= 0 and s - links[j][0] - links[j][2] <= MAX_GAP:
            s0, t0, n0 = links[j]
            if s >= s0 + n0 and 0 <= t - t0 - n0 <= MAX_GAP and best[j] > most:
                most, start = best[j], first[j]
            j -= 1
        best.append(most + n)
        first.append(start)
    return best, first


def _meets(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Does one of the sorted spans, which lie apart, meet start .. end?"""
    k = bisect_left(spans, (end,))
    return k > 0 and spans[k - 1][1] > start


def _apart(links: list[tuple[int, int, int]], best: list[int], first: list[int], least: float) -> list[int]:
    """Ends of chains of enough words, longest first, that don't meet one another."""
    spans: list[tuple[int, int]] = []
    taken = []
    for k in sorted((k for k, n in enumerate(best) if n >= least), key=lambda k: (-best[k], first[k])):
        end = links[k][0] + links[k][2]
        if not _meets(spans, first[k], end):
            insort(spans, (first[k], end))
            taken.append(k)
    return taken


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base: dict[str, str] = BASE, notices: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Base places, labels, the best covered share of a template and covered spans, by row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices)
        for b in batches:
            for i, j, buf, offs in A.slabs(b.column(1)):
                yield scanner.scan(b.column(0)[i:j], buf, offs)

    return pick(docs, doc_id, text).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,template:int,first_word:long,end_word:long,share:double>>, n_spans long")
