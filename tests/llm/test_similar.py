"""Groups of near-duplicates against the Jaccard similarity of all pairs."""

import os
import random

import numpy as np
import pytest

from lineweave.llm import similar as J
from lineweave.llm import stages

SF = "/root/testdata/sf0.01"


def words_set(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([" ".join(w)] if w else [])


def slow_kept(rows):
    """Smallest id of each group of ``rows(id, text)``, over all pairs."""
    sets = [words_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (k, _) in enumerate(rows):
        low[top(i)] = min(k, low.get(top(i), k))
    return sorted(low.values())


def test_stage_links_all_pairs_at_four_fifths(spark):
    rng = random.Random(5)
    passage = ["p%d" % i for i in range(40)]
    texts = [None, "", " ", "one two", "ONE two", "one two three"]
    for _ in range(15):
        base = ["%x" % rng.getrandbits(30) for _ in range(rng.randrange(20, 150))]
        texts += [" ".join(base), " ".join(base + passage)]
        for n in (1, 1, 2, 3, 4):
            w = list(base)
            for _ in range(n):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    want = slow_kept(rows)
    assert sorted(r.doc_id for r in stages.simhash_near_dedup(spark, docs, "").collect()) == want and len(want) < len(rows) - 20


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert sorted(r.doc_id for r in stages.simhash_near_dedup(spark, docs, SF).collect()) == slow_kept(rows)


def test_simhash_proposes_pairs_and_links_are_checked(spark):
    rng = random.Random(8)
    base = ["%x" % rng.getrandbits(30) for _ in range(400)]
    near = [*base[:-1], "other"]
    texts = [" ".join(base), " ".join(near), " ".join(base * 2), "entirely different words of some other text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    m = J.marks(docs).cache()
    node = {r.id: r.node for r in m.collect()}
    pairs = {frozenset((r.a, r.b)) for r in J._simhash_candidates(m).collect()}
    assert frozenset((node[0], node[1])) in pairs and frozenset((node[0], node[3])) not in pairs
    given = spark.createDataFrame([(node[0], node[k]) for k in (1, 2, 3)], "a long, b long")
    linked = J._linked(given, m.where("n > 0"), J._source(docs, "doc_id", "text"), J.SIZE).collect()
    assert {r.b for r in linked} == {node[1], node[2]}  # of the same text twice over, only the joint's four shingles are new


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    long = " ".join("w%d" % i for i in range(60))
    rows = [(None, long, 1, "n", 2), (7, long, 1, "n", 2), (7, long, 1, "n", 2), (7, long + " end", 5, "x", 0), (None, "alone here", 3, "y", 1), (None, None, 0, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long, fp string, n long")
    out = stages.simhash_near_dedup(spark, docs, "")
    got = out.collect()
    assert out.columns == docs.columns and len(got) == 3 and {r.doc_id for r in got} == {7, None} and sum(r.doc_id == 7 for r in got) == 1


def test_cells_never_deny_a_link():
    rng = np.random.default_rng(4)
    denied = 0
    for n in (3, 100, 700, 3000, 40_000):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        for share in (1.0, 0.95, 0.89, 0.85, 0.5, 0.0):
            for grown in (0, n // 12, n // 5):
                b = np.unique(np.concatenate([a[: int(share * len(a))], rng.integers(-(1 << 62), 1 << 62, int((1 - share) * n) + grown)]))
                both = len(np.intersect1d(a, b))
                links = 9 * both >= 4 * (len(a) + len(b))
                may = J.may_link(len(a), len(b), J.cells_of(a), J.cells_of(b))
                assert may or not links
                denied += not may
    full = np.arange(0, 300 << 7, 1 << 7)  # 300 shingles in one cell
    assert J.may_link(len(full), len(full), J.cells_of(full), J.cells_of(full)) and denied > 20


def test_run_pairs():
    rng = np.random.default_rng(3)
    s, n, root = rng.integers(0, 9, 120), rng.integers(5, 20, 120), rng.integers(0, 6, 120)
    p, block = rng.integers(0, 4, 120), np.where(s < 5, rng.integers(0, 2, 120), 1)
    o = np.lexsort((n, s))
    s, n, root, p, block = (x[o] for x in (s, n, root, p, block))
    fits = lambda i, j: 5 * n[i] >= 4 * n[j] and 9 * min(n[i] - p[i], n[j] - p[j]) >= 4 * (n[i] + n[j])
    want = {(i, j) for j in range(120) for i in range(j) if s[i] == s[j] and root[i] != root[j] and fits(i, j) and (s[i] >= 5 or block[i] != block[j])}
    assert set(zip(*(x.tolist() for x in J.run_pairs(s, n, p, root, block)))) == want and want


def test_first_shared_shingle_stands_early_enough():
    rng = random.Random(12)
    order = {k: (rng.randrange(3), k) for k in range(300)}
    for _ in range(3000):
        base = rng.sample(range(300), rng.randrange(1, 60))
        a, b = (sorted(set(base) - set(rng.sample(base, rng.randrange(len(base) // 5 + 1))) | set(rng.sample(range(300), rng.randrange(3))), key=order.get) for _ in range(2))
        both = set(a) & set(b)
        if not a or not b or 9 * len(both) < 4 * (len(a) + len(b)):
            continue
        known = np.array(sorted(order), dtype=np.int64)
        times = np.array([order[k][0] for k in known], dtype=np.int64)
        x, y = (J.prefix_of(np.array(sorted(c), dtype=np.int64), known, times).tolist() for c in (a, b))
        s = min(set(x) & set(y), key=order.get)
        assert 9 * min(len(a) - x.index(s), len(b) - y.index(s)) >= 4 * (len(a) + len(b))


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    rng = random.Random(9)
    base = ["%x" % rng.getrandbits(30) for _ in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = "z%d" % rng.getrandbits(20)
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "_centre_candidates", lambda rows: rows.select(rows.node.alias("a"), rows.node.alias("b")).limit(0))  # all is left to the blocks
    assert sorted(r.doc_id for r in J.keep_one(docs).collect()) == slow_kept(rows)
