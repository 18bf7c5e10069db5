"""Collocations against counting by loops, on one range and many, with words held by tasks and not."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from lineweave.llm import collocations as C


def slow(rows, min_count, share=100, top=2000):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    total, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, min(5, len(w) - i) + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    f = {k: v for k, v in f.items() if v >= min_count}
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        if any(l2 == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (l2, q), b in f.items()):
            continue
        cuts = [(int(Fraction(1000 * a * total[lang], f[lang, p[:k]] * f[lang, p[k:]])), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((" ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], total[lang], score))
    ranked = []
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        ranked += [(lang, i + 1, *x) for i, x in enumerate(found[:top])]
    return sorted(ranked)


def texts(n=250, seed=3):
    r = random.Random(seed)
    words = ["the", "The", "of", "ça", "ÉA", "xy", "zebra", "q r", "it's", "w1", "w2", "w3", "日本"]
    out = []
    for i in range(n):
        t = ""
        for _ in range(r.randrange(0, 40)):
            t += r.choice(words[: r.randrange(2, len(words))]) + r.choice([" ", "  ", "\t", ". ", "\n", " ", " ", " ", "\x0b", ",;"])
        if i % 3 == 0:
            t += " a common passage of six words"
        out.append((r.choice(["en", "fr", None, "und", "en"]), t))
    return out + [("en", None), ("en", ""), ("xx", " .,;\n"), (None, "one")] + [("de", "rep rep rep rep rep rep rep")] * 9


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, l, t, 1, "c") for i, (l, t) in enumerate(rows)], "doc_id long, lang string, text string, n long, word string")
    got = C.collocations(df.repartition(5), **kw).collect()
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got)


@pytest.mark.parametrize("known, span", [(C.KNOWN, C.RANGE), (C.KNOWN, 50), (6, 200), (0, 1000)])
def test_equals_loops(spark, monkeypatch, known, span):
    monkeypatch.setattr(C, "KNOWN", known)
    monkeypatch.setattr(C, "RANGE", span)
    rows = texts()
    assert run(spark, rows, min_count=10) == slow(rows, 10)


def test_top_and_share(spark):
    rows = texts(seed=5)
    assert run(spark, rows, min_count=8, share=60, top=7) == slow(rows, 8, 60, 7)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None)], min_count=1) == []


def test_products_beyond_63_bits(spark):
    a, l, r, n = 9_000_000_000_123, 9_500_000_000_001, 9_100_000_000_007, 99_999_999_999_977
    one, two = b"\0\0\0\1", b"\0\0\0\2"
    grams = spark.createDataFrame([("en", one, 1, l), ("en", two, 1, r), ("en", one + two, 2, a)], C.GRAMS)
    got = C.scored(grams, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert got["score"] == 1000 * a * n // (l * r)


def test_ties_of_cuts_and_phrases(spark):
    rows = [("en", "b a. d c. é z. z é")] * 4
    got = run(spark, rows, min_count=4)
    assert got == slow(rows, 4) and [g[2] for g in got][:2] == ["b a", "d c"]


def test_keys_and_ranges():
    r = np.random.default_rng(1)
    numbers = C.Numbers([("en", b"%d" % i, 1000 // (i + 1) + 1) for i in range(300)], [("en", 50), ("fr", 20)], 90, b"")
    words = [r.integers(1, 371, 5000)] + [r.integers(0, 371, 5000) for _ in range(4)]
    digits = C.pack(words, numbers.width)
    assert all((a == b).all() for a, b in zip(C.unpack(digits, numbers.width), words))
    d, c = C.merged(np.concatenate([digits, digits[:, ::3]], axis=1), np.ones(5000 + len(digits[0, ::3]), dtype=np.int64))
    rows = Counter(tuple(int(w[i]) for w in words) for i in list(range(5000)) + list(range(0, 5000, 3)))
    assert [(*map(int, x), int(k)) for *x, k in zip(*C.unpack(d, numbers.width), c)] == [(*k, rows[k]) for k in sorted(rows)]
    numbers.ranges = 97
    assert (np.diff(numbers.range_of(C.unpack(d, numbers.width))) >= 0).all()


def test_long_texts_and_slabs(monkeypatch):
    monkeypatch.setattr(C, "SLAB", 64)
    r = np.random.default_rng(2)
    numbers = C.Numbers([("en", b"%d" % i, 10) for i in range(9)], [], 0, None)
    seqs = [r.integers(0, 10, k) for k in (3, 500, 0, 64, 65, 128, 7, 1000)]
    got = Counter()
    for b in C._blocks(iter(seqs), numbers):
        for keys, counts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            d = np.frombuffer(keys, dtype=np.uint16).reshape(-(-5 * numbers.width // 16), -1)
            c = np.frombuffer(counts, dtype=np.uint32) if counts else np.ones(d.shape[1])
            for *x, k in zip(*C.unpack(d, numbers.width), c):
                got[tuple(map(int, x))] += int(k)
    want = Counter()
    for s in seqs:
        for i in np.flatnonzero(s):
            w = []
            for x in s[i : i + 5].tolist():
                if not x:
                    break
                w.append(x)
            want[tuple(w + [0] * (5 - len(w)))] += 1
    assert got == want
