"""LM scores: the base against loops, the model against a slow version of itself, and held-out text."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lineweave.llm import maxent as M

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))] + [b""]


def base(rows):
    """{place: (held out, tokens, known, train tokens, base score)}"""
    out, c = {}, Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            c.update(tokens(t))
    n, v = c.total(), len(c)
    for k, (i, t) in enumerate(rows):
        w = tokens(t)
        out[k] = (zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    return out


def corpus(n=300, seed=1):
    """Two languages of pairs: a word tells much of the next."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.random() < 0.5
        words = []
        for _ in range(r.randrange(0, 60)):
            k = r.randrange(12)
            words += [f"{'A' if lang else 'b'}{k}", f"{'a' if lang else 'B'}x{k}"]
        rows.append((i, " ".join(words) + r.choice(["", "\n", f" é{i} rare{i % 7}"])))
    return rows + [(n, None), (n + 1, ""), (None, "Null id"), (5, "again"), (5, "again"), (n + 2, "unseen " * 30)]


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1.0, b"") for i, t in rows], "doc_id long, text string, score double, ids binary").repartition(3)
    return sorted(((r["id"] is not None, r["id"] or 0, r["n_tokens"], r["base_score"]), r) for r in M.lm_scores(df).collect())


@pytest.mark.parametrize("known", [M.KNOWN, 20, 0])
def test_base_equals_loops(spark, monkeypatch, known):
    monkeypatch.setattr(M, "KNOWN", known)
    rows = corpus()
    want = base(rows)
    got = run(spark, rows)
    expected = sorted(((i is not None, i or 0, want[k][1], want[k][4]), want[k]) for k, (i, _) in enumerate(rows))
    assert len(got) == len(expected)
    for (_, g), (_, w) in zip(got, expected):
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == w[:4]
        assert g["base_score"] == pytest.approx(w[4], rel=1e-9, abs=1e-9)
        assert math.isfinite(g["score"]) and g["score"] < 0


def test_context_helps_held_out_text(spark):
    got = [r for _, r in run(spark, corpus(3000, seed=4)) if r["held_out"] and r["n_tokens"] == 2 * (r["n_tokens"] // 2) + 1]
    per = lambda c: sum(r[c] for r in got) / sum(r["n_tokens"] for r in got)
    assert per("score") > per("base_score") + 0.3


def test_without_training_documents(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    got = [r for _, r in run(spark, [(i, "a b") for i in held])]
    assert [(r["train_tokens"], r["n_known"], round(r["base_score"], 9), round(r["score"], 6)) for r in got] == [(0, 0, 0.0, 0.0)] * 5


def test_empty_table(spark):
    assert run(spark, []) == []


def small():
    known = [(b"w%d" % i, 5000 - i) for i in range(2500)]
    return M.Vocabulary(known, sum(n for _, n in known) + 900, 2600)


def test_before_training_the_model_is_the_base():
    v = small()
    ids = np.array([0, 5, 1791, 1792, 2499, 2500], dtype=np.int32)
    logs = M.Step(M.Model(v), v, *M._contexts([ids], v.n + 1)).logs / math.log(10)
    assert logs[:5] == pytest.approx(v.base[ids[:5]], abs=1e-4)
    assert logs[5] == pytest.approx(math.log10(v.rare_whole / v.whole), abs=1e-4)


def test_probabilities_of_all_words_add_up():
    v = small()
    m = M.Model(v)
    r = np.random.default_rng(0)
    m.a[: M.ROWS] = r.normal(0, 0.5, (M.ROWS, M.CLASSES))
    m.b[: M.ROWS] = r.normal(0, 0.5, (M.ROWS, M.WIDTH))
    now = np.arange(v.n + 1, dtype=np.int32)
    p = np.exp(M.Step(m, v, now, np.full(v.n + 1, 7), np.full(v.n + 1, 3)).logs)
    assert p.sum() == pytest.approx(1, abs=1e-3)


def test_contexts_stop_at_texts():
    now, w1, w2 = M._contexts([np.array([1, 2, 3], dtype=np.int32), np.array([4], dtype=np.int32)], 9)
    assert (now.tolist(), w1.tolist(), w2.tolist()) == ([1, 2, 3, 4], [9, 1, 2, 9], [9, 9, 1, 9])


def test_gradients_equal_differences():
    v = small()
    m = M.Model(v)
    r = np.random.default_rng(1)
    m.a = (m.a + r.normal(0, 0.3, m.a.shape)).astype(np.float64)
    m.b = (m.b + r.normal(0, 0.3, m.b.shape)).astype(np.float64)
    now, w1, w2 = (r.integers(0, 2501, 40) for _ in range(3))
    loss = lambda: -M.Step(m, v, now, w1, w2).logs.sum()
    for w, (rows, g, n) in zip((m.a, m.b), M.Step(m, v, now, w1, w2).gradients()):
        assert (n > 0).all() and len(set(rows.tolist())) == len(rows)
        for i in [0, 1, 2, 3, len(rows) - 2, len(rows) - 1]:
            row, col = rows[i], int(np.abs(g[i]).argmax())
            keep = w[row, col]
            w[row, col] = keep + 1e-5
            high = loss()
            w[row, col] = keep - 1e-5
            low = loss()
            w[row, col] = keep
            assert (high - low) / 2e-5 == pytest.approx(g[i, col], rel=1e-3, abs=1e-4)


def test_moves_are_added_in_any_order():
    import pyarrow as pa

    v = small()
    r = np.random.default_rng(3)
    texts = [r.integers(0, 2501, 700).astype(np.int32).tobytes() for _ in range(40)]
    parts = [list(M._moves(M.Model(v), v, 0.1)(iter([pa.RecordBatch.from_arrays([pa.array(texts[k::4], pa.binary())], names=["ids"])]))) for k in range(4)]
    one = {r["block"]: r for b in M._added(b for p in parts for b in p) for r in b.to_pylist()}
    two = {r["block"]: r for b in M._added(b for p in reversed(parts) for b in p) for r in b.to_pylist()}
    assert one == two and len(one) > 300


def test_sums_of_runs():
    r = np.random.default_rng(5)
    n = np.array([1, 40, 2, 12, 13, 1, 5, 300])
    g = r.normal(size=(n.sum(), 3))
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    assert np.allclose(M._sums(g, at, n), np.add.reduceat(g, at, axis=0))
