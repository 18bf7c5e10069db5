"""Fingerprints, bit-sliced comparison and groups against brute force."""

import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lineweave.llm import simhash as S


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.lists(st.sampled_from(["A", "b", "É", "é", " ", "\n", "\xa0", "Zz", "\x0c", "ß"]), max_size=40).map("".join))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert S.fingerprint(text) == slow_fingerprint(text)


def test_hash_is_that_of_spark(spark):
    words = ["a", "héllo wörld x", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] & (2**64 - 1) for r in df.selectExpr("xxhash64(w)").collect()] == [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]


@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=40), st.integers(1, 3), st.integers(0, 2**32 - 1))
@settings(max_examples=150, deadline=None)
def test_comparison(fps, radius, seed):
    rng = random.Random(seed)
    fps = fps + [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps]
    planes = S.bit_planes(np.array(fps, dtype=np.uint64))
    n = len(fps)
    for shift in range(1, n):
        mask = S.within(planes, shift, (1 << (n - shift)) - 1, radius)
        assert [bool(mask >> i & 1) for i in range(n - shift)] == [(fps[i] ^ fps[i + shift]).bit_count() <= radius for i in range(n - shift)]


def slow_components(fps):
    label = list(range(len(fps)))
    change = True
    while change:
        change = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    change = True
    return label


def cluster(rng, n, spread):
    out, base = [], rng.getrandbits(64)
    for _ in range(n):
        f = base
        for _ in range(rng.randrange(spread + 1)):
            f ^= 1 << rng.randrange(64)
        out.append(f)
    return out


def test_links_lose_nothing(spark):
    rng = random.Random(2)
    fps = list({*(rng.getrandbits(64) for _ in range(60)), *cluster(rng, 60, 2), *cluster(rng, 60, 4), *cluster(rng, 40, 9), 0, 1, 3, 2**63, 2**64 - 1})
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    want = slow_components(fps)
    for direct in (4096, 3):  # the second keys nearly every bucket anew
        from lineweave.operators.network import star_components

        roots = {r.node: r.root for r in star_components(S.links(df, direct=direct)).collect()}
        root = [roots.get(signed(f), signed(f)) for f in fps]
        assert all((root[i] == root[j]) == (want[i] == want[j]) for i in range(len(fps)) for j in range(i))


def near(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = "changed"
    return " ".join(w)


def test_groups_and_edge_cases(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        words = ["%x" % rng.getrandbits(40) for _ in range(300)]
        texts += [" ".join(words), " ".join(words), near(rng, words, 1), near(rng, words, 2)]
    texts += [None, "", " \n ", "one", "ONE", "one two", "x " * 40_000]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(3, texts[3], 7), (None, texts[0], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = S.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    fps = [slow_fingerprint(t) for t in texts]
    want = slow_components(fps)
    for i in range(len(texts)):
        assert by[i][0].fp & (2**64 - 1) == fps[i] and by[i][0].component == want[i]
    assert by[None][0].component == want[0] and len(by[3]) == 2
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    same = spark.createDataFrame([(1, "a b c d"), (1, "q r s t"), (1, "a b c d")], "doc_id long, text string")
    assert sorted(r.text for r in S.keep_one(same).collect()) == ["a b c d", "q r s t"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0 and S.keep_one(empty).count() == 0
