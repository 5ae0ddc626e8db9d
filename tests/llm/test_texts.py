"""Operators that look at one document at a time, against plain Python."""

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from sparkscan.llm import arrays as A
from sparkscan.llm import licences, pii, quality, token_files, tokens

SPACE = r"[^\x20\x09-\x0D]+"


def texts(seed=1, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "MIT", "License", "apache", "license", "cc", "by", "gnu", "general", "public", "ünï", "日本", "a@b.co.uk", "1.2.3.4", "4111", "1111", "+1 (234) 567-8901", "4111111111111111", "999.1.1.1", "#", "x,y", "don't"]
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", "\n", "  ", "-", "\t"]) for _ in range(rng.randint(0, 120))))
    return [*out, "", " ", "\n\n", "same line here\nsame line here\n same line here"]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts())], "doc_id long, text string, lang string")


def test_kernels():
    t = texts(3)
    for i, j, buf, offs in A.slabs(pa.array(t), 500):
        starts, ends = A.runs(A.NOT_SPACE[buf], offs)
        first = A.owners(starts, offs)
        raw = buf.tobytes()
        got = [[raw[s:e] for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first, first[1:], strict=False)]
        assert got == [x.encode().split() for x in t[i:j]]
        h = A.hash_spans(buf, starts, ends)
        words = [w for ws in got for w in ws]
        assert len(set(h.tolist())) == len(set(words)) and {w: x for w, x in zip(words, h.tolist(), strict=True)} == dict(zip(words, h.tolist(), strict=True))
    long = np.frombuffer(b"a" * 70 + b" " + b"a" * 70 + b" " + b"a" * 71, np.uint8)
    s, e = A.runs(A.NOT_SPACE[long], np.array([0, len(long)]))
    h = A.hash_spans(long, s, e)
    assert h[0] == h[1] != h[2]


def test_quality_counts(docs):
    got = by_id(quality.quality_rules(docs))
    for k, t in enumerate(texts()):
        words = re.findall(SPACE, t)
        lines = [x for x in t.split("\n") if re.search(SPACE, x)]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = {g for g in grams if grams.count(g) > 1}
        repeat = {i + d for i, g in enumerate(grams) if g in twice for d in range(3)}
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat))
        assert r.base_failed == (len(words) < 50 or 100 * len(repeat) > 50 * len(words)) and not (r.base_failed and r.kept)


def test_divergence_tells_junk_from_prose(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7)))
    prose = lambda: ". ".join(" ".join(rng.choice(["the", "of", "and", "to", word(), word()]) for _ in range(9)) for _ in range(15))
    rows = [(k, prose(), "en") for k in range(60)]
    rows += [(100, prose().upper() + "!!", "en"), (101, " | ".join(word() + "&&&" for _ in range(120)), "en")]
    got = by_id(quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(got[k].kept for k in range(60)) and not got[100].kept and not got[101].kept
    p = np.array([[0.5, 0.5, 0.0]])
    assert quality.distance(p, p[0])[0] == 0 and quality.distance(p, np.array([0.0, 0.0, 1.0]))[0] == 1


def test_a_language_is_judged_alike_whatever_its_share(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7)))
    prose = lambda: ". ".join(" ".join(rng.choice(["le", "la", "et", "un", word(), word()]) for _ in range(9)) for _ in range(15))
    rows = [(k, prose(), "fr") for k in range(60)] + [(100, prose().upper() + "!!", "fr"), (101, " | ".join(word() + "&&&" for _ in range(120)), "fr")]
    rows += [(200, prose(), "it"), (201, prose(), None)]
    rows += [(300 + k, "the of and to " * 300_000, "en") for k in range(8)]  # 9,600,000 words
    got = by_id(quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(got[k].kept for k in (*range(60), 200, 201)) and not got[100].kept and not got[101].kept


def test_licence_places(docs):
    got = by_id(licences.license_scan(docs))
    for k, t in enumerate(texts()):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower())
        hits = [(i, label) for p, label in licences.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.encode().split()]
        r = got[k]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_matching_statistics_and_chains():
    scanner = licences.Scanner({}, {"x": ["a b c d e f g h"], "y": ["c d q r s t"]})
    auto, codes = scanner.auto, scanner.vocabulary
    rng = random.Random(2)
    seqs = [t for t, _ in scanner.templates]
    subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(200):
        word = [rng.randrange(len(codes) + 1) for _ in range(12)]
        state = matched = 0
        for k, c in enumerate(word):
            state, matched = auto.step(state, matched, c)
            assert matched == max((n for n in range(k + 2) if n == 0 or tuple(word[k + 1 - n : k + 1]) in subs), default=0)
    out = scanner.scan(pa.array([1, 2]), *next(A.slabs(pa.array(["zz A b, c d zz e f g h", "a b c"])))[2:]).to_pylist()
    assert out[0]["labels"] == "x" and out[0]["score"] == 1.0 and out[1]["labels"] == ""


def test_licence_spans():
    scanner = licences.Scanner({}, {"x": ["a b c d e f g h"], "y": [" ".join(f"w{k}" for k in range(400))]})
    broken = " ".join(f"w{k}" if k % 5 < 4 else "zz" for k in range(400))  # 80 matches, each after a gap of one word
    got = scanner.scan(pa.array([1, 2, 3]), *next(A.slabs(pa.array(["zz a b c d zz e f g h zz zz a b c d e f g h a b c d e", broken, "a b c"])))[2:]).to_pylist()
    assert [tuple(x.values()) for x in got[0]["spans"]] == [("x", 0, 1, 10, 1.0), ("x", 0, 12, 20, 1.0), ("x", 0, 20, 25, 0.625)]
    assert [tuple(x.values()) for x in got[1]["spans"]] == [("y", 1, 0, 399, 0.8)] and got[2]["spans"] == []
    # 40 matches lie between the parts of x's chain, within the gap's width in words
    inner = [[0, 0, 4], *([4 + k // 10, 100, 4] for k in range(40)), [8, 4, 4]]
    assert licences._covers([tuple(x) for x in inner])[0][-1] == 8


def test_chains_against_all_earlier_links():
    rng = random.Random(9)
    for _ in range(300):
        links = sorted({(rng.randrange(60), rng.randrange(40), rng.randrange(4, 9)) for _ in range(rng.randint(1, 90))})
        reach = 0
        links = [x for x in links if (reach := max(reach, x[0] + x[2])) == x[0] + x[2]]  # maximal matches end in order
        best = []
        for s, t, n in links:
            best.append(n + max((b for (s0, t0, n0), b in zip(links, best, strict=False) if 0 <= s - s0 - n0 <= licences.MAX_GAP and 0 <= t - t0 - n0 <= licences.MAX_GAP), default=0))
        assert licences._covers(links)[0] == best
    words = " ".join(f"p{k}" for k in range(4))
    for k in (2, 31, 32, 80):  # a template that repeats a passage
        scanner = licences.Scanner({}, {"x": [" z ".join([words] * k)]})
        out = scanner.scan(pa.array([1]), *next(A.slabs(pa.array([f"{words} q {words}"])))[2:]).to_pylist()
        assert out[0]["score"] == pytest.approx(8 / (5 * k - 1))


def test_full_licences_are_told_apart(spark):
    rng, rows, want = random.Random(3), [], {}
    filler = lambda n: " ".join(rng.choice(["the", "of", "and", "river", "stone"]) for _ in range(n))
    for label, texts_ in licences.FULL.items():
        for t in texts_:
            words = t.split()
            for k in range(10, len(words), 40):
                words[k] = "changed"
            rows.append((len(rows), f"{filler(30)}. {' '.join(words)}, {filler(20)}"))
            want[rows[-1][0]] = label
    rows.append((len(rows), filler(400)))
    got = by_id(licences.license_scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[len(rows) - 1].labels == "" and got[len(rows) - 1].n_spans == 0
    for k, label in want.items():
        assert label in got[k].labels.split(",") and got[k].score > 0.9
        best = max(got[k].spans, key=lambda x: x.end_word - x.first_word)
        assert best.label == label and abs(best.first_word - 30) <= 5


PATTERNS = [(0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), (2, r"[0-9]([\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]")]


def base(t):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    good = {0: lambda s: True, 1: lambda s: all(int(x) <= 255 for x in s.split(".")), 2: lambda s: 14 <= len(digits(s)) <= 19 and pii.luhn(digits(s).encode()), 3: lambda s: 10 <= len(digits(s)) <= 15}
    return sorted((m.start(), k, m.end()) for k, p in PATTERNS for m in re.finditer(p, t) if good[k](m[0]))


def test_personal_data(docs):
    got = by_id(pii.personal_data(docs))
    for k, t in enumerate(texts()):
        want = base(t)
        joined = ",".join(f"{pii.KINDS[x]}:{s}:{e}" for s, x, e in want)
        r = got[k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x == i for _, x, _ in want) for i in range(4)]
        assert r.n_spans == len(r.spans.split(",")) * bool(r.spans) and r.n_more == r.n_spans - len(want)
        assert r.base_sha256 == sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= set(r.spans.split(",") + [""])


def test_base_patterns_on_random_strings():
    rng = random.Random(8)
    for _ in range(3000):
        t = "".join(rng.choice("0123456789.@+- ()a%") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t.encode()) == base(t), t


def test_segments_are_found_on_held_out_sentences():
    w, found, want, wrong = pii.weights(), 0, 0, 0
    for text, gold in pii._sentences(random.Random(99), 150):
        got = {(s, k, e) for s, k, e in pii.method_spans(text, w)}
        gold = {(s, k, e) for s, e, k in gold}
        found, want, wrong = found + len(got & gold), want + len(gold), wrong + len(got - gold)
    assert found > 0.9 * want and wrong < 0.1 * want
    long = b"1" * 50_000 + b" call 555-123-4567"
    assert (long.index(b"555"), 3, len(long)) in pii.method_spans(long, w)


def test_stretches_are_the_whole_text_s_labelling(monkeypatch):
    rng, w = random.Random(5), pii.weights()
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.choice([2, 5, 70, 300])))
    long = lambda: rng.choice([word() + "7", "9" * rng.randint(1, 90), "b" * 70 + "7", word() + "@" + word(), "+1 (234) 567-8901", "1.2.3.4", "\n", "--", "  \n ", "é" * 40 + "5", f"{rng.randrange(256):x}" * 20])
    for k in range(300):
        text = " ".join(rng.choice([word, word, long])() for _ in range(rng.randint(1, 60))).encode()
        monkeypatch.setattr(pii, "BLOCK", 4096)
        whole = pii.decode(text, w)
        if k % 2:
            monkeypatch.setattr(pii, "BLOCK", 17)
        assert pii.method_spans(text, w) == whole, text


def test_decoding_is_best_by_brute_force():
    w, text = pii.weights(), b"a 12 b@c.de 3"
    edges, *marks = (x.tolist() for x in pii._atoms(text))
    segments, rows = pii._segments(text, edges, *marks)
    atoms = list(zip(edges, edges[1:], strict=False))
    score = dict(zip(segments, (rows @ w).max(axis=1), strict=True))

    def best(i):
        return 0.0 if i >= len(atoms) else max([best(i + 1), *(v + best(j) for (a, j), v in score.items() if a == i)])

    place = {s: k for k, (s, _) in enumerate(atoms)}
    end = {e: k + 1 for k, (_, e) in enumerate(atoms)}
    assert sum(score[place[s], end[e]] for s, _, e in pii.decode(text, w)) == pytest.approx(best(0))


def test_tokens_are_the_library_s():
    e = tokens.Encoder(tokens.vocabulary())
    odd = ["don't we'll 'tis", "ÀÉ×÷ß İI K Å ½ ٣ 日本語 test123abc", "<|endoftext|> hi", "<|ENDOFTEXT|>'x <|startoftext|", "a\x1cb\x00c\x85d\xa0e", "", None, "x" * 5000, "Ça÷va... foo,bar;9-8 'S 'Re ''' a'b"]
    rows = odd + texts(5)
    want = [x.ids for x in e.full.encode_batch([x or "" for x in rows], add_special_tokens=False)]
    got = [ids[a:b].tolist() for _, _, ids, offs in e.encode(pa.array(rows)) for a, b in zip(offs, offs[1:], strict=False)]
    assert got == want
    e.start, e.count = np.zeros(40, np.int32), np.zeros(40, np.int32)  # a table too small for the pieces
    e.entries = e.used = 0
    e.key[:] = 0
    assert [ids[a:b].tolist() for _, _, ids, offs in e.encode(pa.array(rows)) for a, b in zip(offs, offs[1:], strict=False)] == want
    plain = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    assert not plain.cuts and [ids.tolist() for _, _, ids, _ in plain.encode(pa.array(["a b"]))] == [plain.full.encode("a b").ids]


def test_records(docs, spark, tmp_path):
    data = token_files.frame(-5, np.array([1, 10, 300]), 2) + token_files.frame(None, np.array([10]), 4)
    one = token_files.unframe(data)
    two = token_files.unframe(data, one[2])
    assert (one[0], one[1].tolist(), two[0], two[1].tolist(), two[2]) == (-5, [1, 10, 300], None, [10], len(data))
    for k in (0, 5, 9, 20, len(data) - 3):
        broken = bytearray(data)
        broken[k] ^= 1
        with pytest.raises(ValueError):
            token_files.unframe(bytes(broken), token_files.unframe(bytes(broken))[2])
    got = by_id(token_files.token_records(docs, tokens.vocabulary()))
    full, at = tokens.Encoder(tokens.vocabulary()).full, 0
    for k, t in enumerate(texts()):
        ids = np.array([*full.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_files_follow_each_other_by_number():
    names = ["part-99999-ab-c000.txt", "part-100000-ab-c000.txt", "part-00002-ab-c001.txt", "part-00002-ab-c000.txt", "part-00002-1c3-c010.txt.gz"]
    assert [token_files.file_order(x) for x in names] == [(99999, 0), (100000, 0), (2, 1), (2, 0), (2, 10)]


def test_records_of_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 2_000)
    monkeypatch.setattr(token_files, "RECORDS", 7)
    rng = random.Random(2)
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, None if k % 50 == 0 else " ".join(rng.choice(["river", "stone", "a", "the"]) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert token_files.has_hot_id(df, 40) and not token_files.has_hot_id(df.where("doc_id <> 5"), 40)
    got = sorted(token_files.token_records(df, tokens.vocabulary()).collect(), key=lambda r: r.start)
    full, at = tokens.Encoder(tokens.vocabulary()).full, 0
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for r, (k, t) in zip(got, want, strict=True):
        ids = np.array([*full.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len({r.file for r in got}) > 50


@pytest.mark.parametrize("run", [quality.quality_rules, licences.license_scan, pii.personal_data, lambda d: token_files.token_records(d, tokens.vocabulary())])
def test_odd_rows_and_empty_tables(run, odd, none):
    assert run(odd).count() == odd.count() and run(none).count() == 0
