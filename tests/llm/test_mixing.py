"""Targets, permutations and taken words against plain loops."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import pytest

from lineweave.llm import mixing as M
from lineweave.llm.queries import OP6_SQL


def slow_targets(sizes):
    """The contract's words: share by weight, cap, share the excess anew."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        w = sum(weight[s] for s in open_)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        source = rng.choice(["a"] * 6 + ["b", "c", "Z", None, "tiny"]) if i else "tiny"
        n = rng.choice([0, 1, 5, 60, 300]) if source != "tiny" else 1
        rows.append((i, " ".join(f"w{i}_{k}" for k in range(n)) if rng.random() > 0.02 else None, source, n, "x"))
    rows += [rows[5], rows[5]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, size string").repartition(6)


def test_sizes_and_targets(docs, spark):
    rows, df = docs
    got = M.mixed_sizes(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.id, r.size) for r in got) == sorted((i, len((t or "").split())) for i, t, *_ in rows)
    per = defaultdict(int)
    for i, t, s, *_ in rows:
        per[s] += len((t or "").split())
    want, source = slow_targets(per), {i: s for i, _, s, *_ in rows}
    taken = Counter()
    for r in got:
        assert r.source_size == per[source[r.id]] and r.target == pytest.approx(want[source[r.id]])
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.id]] += r.taken
    for s in per:
        assert abs(taken[s] - want[s]) <= 2 * M.BLOCK + 0.01 * want[s]
    key = lambda rs: sorted((r.id, r.size, r.taken) for r in rs)
    assert key(got) == key(M.mixed_sizes(df.repartition(2)).collect())


def test_equals_sql(docs, spark):
    rows, df = docs
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    cur = con.execute(OP6_SQL)
    names = [x[0] for x in cur.description]
    want = sorted((r[names.index("doc_id")], r[names.index("size")], r[names.index("taken")], round(r[names.index("target")], 6)) for r in cur.fetchall())
    assert sorted((r.id, r.size, r.taken, round(r.target, 6)) for r in M.mixed_sizes(df).collect()) == want


def test_slots_are_permutations_and_shards_hold_all(docs, spark):
    rows, df = docs
    sizes = df.select(M.key_of(df.source).alias("key"), "source", M.n_words(df.text).alias("size"))
    targets = M.source_targets(sizes).cache()
    s = M.slots(targets).collect()
    quota = {r.key: (r.quota, r.n_blocks) for r in targets.collect()}
    per = defaultdict(list)
    for r in s:
        per[r.key].append(r)
    for key, (n, blocks) in quota.items():
        assert sorted(r.slot for r in per[key]) == list(range(n))
        for e in {r.epoch for r in per[key]}:
            mine = [r.block for r in per[key] if r.epoch == e]
            assert len(set(mine)) == len(mine) and all(0 <= b < blocks for b in mine)
            if e < n // blocks:
                assert len(mine) == blocks
    counts = M.shard_counts(targets)
    assert counts.agg({"n": "sum"}).first()[0] == len(s)


def test_documents_of_the_mix(docs, spark):
    rows, df = docs
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    got = out.collect()
    words = Counter()
    for r in got:
        own = f"w{r.doc_id}_"
        w = r.text.split()
        assert w and all(x.startswith(own) for x in w) and r.n_chars == len(r.text)
        words[r.doc_id] += len(w)
    want = Counter()
    for r in M.mixed_sizes(df).collect():
        want[r.id] += r.taken
    assert {k: v for k, v in want.items() if v} == words


def test_no_rows_and_no_words(spark):
    schema = "doc_id long, text string, source string"
    assert M.mixed_sizes(spark.createDataFrame([], schema)).count() == 0
    assert M.mixed_documents(spark.createDataFrame([], schema)).count() == 0
    r = M.mixed_sizes(spark.createDataFrame([(1, None, None), (None, "", "a")], schema)).collect()
    assert [(x.size, x.target, x.taken) for x in r] == [(0, 0.0, 0)] * 2


def slow_permutation(n, rank, seed=M.SEED):
    """Swap-or-not by its definition, one index at a time."""
    number = lambda *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)
    out = []
    for x in range(n):
        for i in range(M.ROUNDS):
            other = (number(seed, "pivot", rank, i) - x) % n
            m = max(x, other) % M.PRIME
            if (m * (number(seed, "mult", i) % (M.PRIME - 1) + 1) + number(seed, "add", i) % M.PRIME) % M.PRIME // 4096 % 2:
                x = other
        out.append(x)
    return out


def some_targets(spark, blocks, quota):
    """Targets of sources a, b, ... of so many blocks, with quotas put in by hand."""
    rows = [(f"={chr(97 + i)}", chr(97 + i), n * M.BLOCK) for i, n in enumerate(blocks)]
    t = M.source_targets(spark.createDataFrame(rows, "key string, source string, size long"))
    given = spark.createDataFrame([(r[0], q) for r, q in zip(rows, quota)], "key string, q long")
    return t.join(given, "key").withColumn("quota", given.q).drop("q").cache()


def test_permutation_equals_its_definition_and_is_spread(spark):
    sizes = [1, 2, 3, 97, 1000, 999_983 // 997]
    s = M.slots(some_targets(spark, sizes, sizes)).collect()
    for rank, n in enumerate(sizes):
        got = [r.block for r in sorted((r for r in s if r.key == f"={chr(97 + rank)}"), key=lambda r: r.slot)]
        assert got == slow_permutation(n, rank) and sorted(got) == list(range(n))
    # a fifth of the blocks, as an unfinished round takes them, lies evenly over tenths of the source
    for rank, n in ((4, 1000), (5, sizes[5])):
        tenths = Counter(b * 10 // n for b in slow_permutation(n, rank)[: n // 5])
        assert all(abs(tenths[k] - n / 50) < 5 * (n / 50) ** 0.5 for k in range(10))
        steps = Counter((b - a) % n for a, b in zip(slow_permutation(n, rank), slow_permutation(n, rank)[1:]))
        assert max(steps.values()) < n / 10  # no fixed stride


def test_counts_per_shard_are_multinomial(spark):
    t = some_targets(spark, [30_000, 60_000], [40_000, 60_000])
    counts = M.shard_counts(t).collect()
    shards = math.ceil(100_000 / M.SHARD_SLOTS)
    for key, quota in (("=a", 40_000), ("=b", 60_000)):
        n = Counter({r.shard: r.n for r in counts if r.key == key})
        assert sum(n.values()) == quota and set(n) <= set(range(shards))
        chi = sum((n[s] - quota / shards) ** 2 / (quota / shards) for s in range(shards))
        assert shards - 1 - 5 * (2 * shards) ** 0.5 < chi < shards - 1 + 5 * (2 * shards) ** 0.5  # neither uneven nor dealt in turn


def test_seed_decides_what_is_taken(docs):
    rows, df = docs
    told = lambda seed: {(r.id, r.size, r.taken, r.n_shards, r.first_shard) for r in M.mixed_sizes(df, seed=seed).collect()}
    assert told(42) == told(42) and {x[:3] for x in told(42)} != {x[:3] for x in told(43)}
    for _, size, taken, n, first in told(42):
        assert (n == 0) == (taken == 0) == (first is None) and n <= taken


def test_ids_of_strings_and_extra_columns(spark):
    rows = [("x%d" % i, "a b c " * i, "s%d" % (i % 2), "key", 1, i) for i in range(40)] + [(None, "n n", None, "k", 2, 2)] * 2
    df = spark.createDataFrame(rows, "doc_id string, text string, source string, key string, start int, block int")
    got = M.mixed_sizes(df).collect()
    assert sorted(r.size for r in got) == sorted(len(r[1].split()) for r in rows)
    out = M.mixed_documents(df)
    assert out.columns == df.columns and {(r.doc_id, r.block) for r in out.collect()} <= {(r[0], r[5]) for r in rows}
