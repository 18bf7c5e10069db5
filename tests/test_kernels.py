"""Kernels against brute force and closed forms."""

import itertools
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lineweave.operators import kernels as K

edges = st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=16)


def arrays(e):
    return np.array([a for a, _ in e]), np.array([b for _, b in e])


def slow_components(n, e):
    label = list(range(n))
    for _ in range(n):
        for a, b in e:
            label[a] = label[b] = min(label[a], label[b])
    return label


@given(edges)
@settings(max_examples=150, deadline=None)
def test_components(e):
    assert K.components(9, *arrays(e)).tolist() == slow_components(9, e)


@given(edges)
@settings(max_examples=150, deadline=None)
def test_bridges(e):
    u, l = arrays(e)
    found = K.bridges(9, u, l)
    base = len(set(slow_components(9, e)))
    for k, (a, b) in enumerate(e):
        rest = [x for x in e if set(x) != {a, b}]
        assert found[k] == (a != b and len(set(slow_components(9, rest))) > base)


@given(edges, st.integers(0, 2**32 - 1))
@settings(max_examples=100, deadline=None)
def test_potentials_of_consistent_lines(e, seed):
    rng = np.random.default_rng(seed)
    u, l = arrays(e)
    p = rng.uniform(0, 1e4, 9)
    w = 10.0 ** rng.uniform(0, 12, len(e))
    x = K.potentials(9, u, l, p[u] - p[l], w)
    comp = K.components(9, u, l)
    for c in set(comp.tolist()):
        mine = comp == c
        assert np.allclose(x[mine], p[mine] - p[mine].min(), atol=1e-8)


@given(edges, st.integers(0, 2**32 - 1))
@settings(max_examples=100, deadline=None)
def test_potentials_satisfy_the_normal_equations(e, seed):
    rng = np.random.default_rng(seed)
    u, l = arrays(e)
    f, w = rng.normal(0, 10, len(e)), rng.uniform(0.1, 10, len(e))
    x = K.potentials(9, u, l, f, w)
    r = np.where(u != l, w * (f - (x[u] - x[l])), 0)
    off = np.bincount(u, weights=r, minlength=9) - np.bincount(l, weights=r, minlength=9)
    assert np.abs(off).max() < 1e-8


@given(edges, st.integers(0, 2**32 - 1))
@settings(max_examples=100, deadline=None)
def test_leverages(e, seed):
    u, l = arrays(e)
    w = np.random.default_rng(seed).uniform(0.5, 2, len(e))
    h = K.leverages(9, u, l, w)
    g = np.linalg.pinv(K.laplacian(9, u, l, w))
    want = w * (g[u, u] + g[l, l] - 2 * g[u, l])
    assert np.allclose(h, want, atol=1e-8)
    assert np.isclose(h.sum(), 9 - len(set(slow_components(9, e))))


@given(edges, st.integers(0, 2**32 - 1))
@settings(max_examples=60, deadline=None)
def test_cheapest(e, seed):
    rng = np.random.default_rng(seed)
    u, l = arrays(e)
    up, down = rng.uniform(0, 1, len(e)), rng.uniform(0, 1, len(e))
    d = np.full(9, np.inf)
    d[0] = 0
    for _ in range(9):
        for k in range(len(e)):
            d[u[k]] = min(d[u[k]], d[l[k]] + up[k])
            d[l[k]] = min(d[l[k]], d[u[k]] + down[k])
    assert np.allclose(K.cheapest(9, u, l, up, down, [0]), d)


def test_detach_keeps_ground_and_sizes():
    # a triangle with two chains of three
    u, l = arrays([(0, 1), (1, 2), (2, 0), (1, 3), (3, 4), (4, 5), (2, 6), (6, 7), (7, 8)])
    for order in itertools.permutations([(1, 3), (3, 4), (2, 6)]):
        picks, gone = K.detach(9, u, l, 0, list(order), 5, 3)
        assert 0 not in gone
        assert all(2 <= len(side) <= 3 for side, _, _ in picks)
        for side, root, anchor in picks:
            assert root in side and anchor not in side
    picks, _ = K.detach(9, u, l, 0, [(3, 4), (1, 3)], 5, 3)
    assert picks[0][0] == {4, 5} and len(picks) == 1  # the level between the cuts is alone


def spectral(rng, n, extra, span=0.0):
    """Lines between near levels: a tree and extra links."""
    u = np.arange(1, n)
    l = np.maximum(0, u - rng.integers(1, 4, n - 1))  # noqa: E741
    a = rng.integers(0, n, extra)
    b = np.clip(a + rng.integers(-40, 41, extra), 0, n - 1)
    ok = a != b
    u, l = np.concatenate([u, a[ok]]), np.concatenate([l, b[ok]])  # noqa: E741
    x = rng.normal(size=n) * 1e4
    return u, l, x[u] - x[l] + rng.normal(size=len(u)) * 1e-3, 10.0 ** rng.uniform(-span, span, len(u))


@pytest.mark.parametrize("span", [0.0, 5.0])
@pytest.mark.parametrize("dense", [1, 2, 30, 400])
def test_elimination_equals_a_dense_solve(span, dense):
    rng = np.random.default_rng(int(span) + dense)
    u, l, f, w = spectral(rng, 300, 500, span)  # noqa: E741
    e = K.Elimination(300, u, l, w, dense=dense)
    assert len(e.left) <= max(dense, 1)
    inverse = np.zeros((300, 300))
    inverse[1:, 1:] = np.linalg.inv(K.laplacian(300, u, l, w)[1:, 1:])
    rhs = np.bincount(u, weights=w * f, minlength=300) - np.bincount(l, weights=w * f, minlength=300)
    x, y = e.solve(rhs), inverse @ rhs
    assert np.allclose(x - x[0], y - y[0], rtol=1e-6, atol=1e-4)
    assert np.allclose(e.resistances(u, l), inverse[u, u] + inverse[l, l] - 2 * inverse[u, l], rtol=1e-6)
    x = K.potentials(300, u, l, f, w)  # the normal equations hold
    r = w * (f - (x[u] - x[l]))
    left = np.bincount(u, weights=r, minlength=300) - np.bincount(l, weights=r, minlength=300)
    assert np.abs(left).max() <= 1e-9 * np.abs(w * f).max()


def test_a_core_of_fifty_thousand_levels_takes_little_memory():
    code = """
import resource, numpy as np, sys
sys.path.insert(0, sys.argv[1])
from lineweave.operators import kernels as K
from tests.test_kernels import spectral
n = 50_000
u, l, f, w = spectral(np.random.default_rng(0), n, 60_000)
x = K.potentials(n, u, l, f, w)
r = w * (f - (x[u] - x[l]))
assert abs(np.bincount(u, weights=r, minlength=n) - np.bincount(l, weights=r, minlength=n)).max() < 1e-6
assert abs(K.leverages(n, u, l, w).sum() - (n - 1)) < 1e-4
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""
    root = Path(__file__).resolve().parent.parent
    out = subprocess.run([sys.executable, "-c", code, str(root)], cwd=root, check=True, timeout=300, capture_output=True, text=True)
    assert int(out.stdout) < 1 << 20  # KB


def filling(rng, n_low, n_lines):
    """Lines between levels drawn at random, as many upper ones as make elimination fill up; the largest component."""
    u, l = rng.integers(0, 20 * n_low, n_lines) + n_low, rng.integers(0, n_low, n_lines)
    label = K.components(21 * n_low, u, l)
    mine = label[u] == np.bincount(label).argmax()
    nodes, ends = np.unique(np.concatenate([u[mine], l[mine]]), return_inverse=True)
    return len(nodes), ends[: mine.sum()], ends[mine.sum() :]


@pytest.mark.parametrize("span", [0.0, 5.0])
@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_a_matrix_takes_what_fills_up(span, block, monkeypatch):
    rng = np.random.default_rng(block)
    n, u, l = filling(rng, 100, 800)  # noqa: E741
    monkeypatch.setattr(K, "DENSE", 5)
    monkeypatch.setattr(K, "BLOCK", block)
    w = 10.0 ** rng.uniform(-span, span, len(u))
    e = K.Elimination(n, u, l, w, dense=5)
    assert 5 < len(e.left) < n
    p = rng.uniform(0, 1e4, n)
    monkeypatch.setattr(K, "Elimination", lambda *a: e)
    x = K._refined(n, u, l, p[u] - p[l], w)
    assert np.allclose(x - x[0], p - p[0], atol=1e-7)
    h = w * e.resistances(u, l)
    assert np.isclose(h.sum(), n - 1) and ((h > -1e-6) & (h < 1 + 1e-6)).all()
    if not span:
        g = np.linalg.pinv(K.laplacian(n, u, l, w))
        assert np.allclose(h, w * (g[u, u] + g[l, l] - 2 * g[u, l]), rtol=1e-6)


def test_a_core_that_fills_up_takes_seconds():
    """Nets of large tables: 140,000 lines whose elimination leaves some two thousand levels, nearly all linked to each other."""
    code = """
import resource, numpy as np, sys
sys.path.insert(0, sys.argv[1])
from lineweave.operators import kernels as K
from tests.test_kernels import filling
n, u, l = filling(np.random.default_rng(0), 20_000, 144_600)
p = np.random.default_rng(1).uniform(0, 1e4, n)
x = K.potentials(n, u, l, p[u] - p[l], np.ones(len(u)))
assert abs(x - (p - p.min())).max() < 1e-7
assert abs(K.leverages(n, u, l, np.ones(len(u))).sum() - (n - 1)) < 1e-4
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""
    root = Path(__file__).resolve().parent.parent
    out = subprocess.run([sys.executable, "-c", code, str(root)], cwd=root, check=True, timeout=60, capture_output=True, text=True)
    assert int(out.stdout) < 400 << 10  # KB


def test_rooted_order_of_subtrees():
    r = np.random.default_rng(4)
    for n in (1, 2, 30, 200):
        parent = np.array([int(r.integers(0, max(1, i))) for i in range(n)])
        u, l = np.concatenate([np.arange(1, n), r.integers(0, n, n // 3)]), np.concatenate([parent[1:], r.integers(0, n, n // 3)])
        root = int(r.integers(0, n))
        tree = K.Rooted(n, u, l, root)
        assert sorted(tree.place.tolist()) == list(range(n)) and tree.size[root] == n
        kids = {v: {v} for v in range(n)}
        for v in tree.order[::-1].tolist():
            if v != root:
                kids[int(tree.parent[v])] |= kids[v]
        for v in range(n):
            assert set(tree.order[tree.below(v)].tolist()) == kids[v]


def test_detach_sides_equal_searches():
    """Each pick is what is reached from its root when all earlier picks and the cut link are taken away."""
    r = np.random.default_rng(9)
    for _ in range(40):
        n = 25
        u, l = np.arange(1, n), np.array([int(r.integers(max(0, i - 4), i)) for i in range(1, n)])
        u, l = np.concatenate([u, r.integers(0, n, 2)]), np.concatenate([l, r.integers(0, n, 2)])
        cut = np.flatnonzero(K.bridges(n, u, l))
        cuts = [(int(u[k]), int(l[k])) for k in r.permutation(cut)]
        ground = int(r.integers(0, n))
        picks, gone = K.detach(n, u, l, ground, cuts, 4, 6)
        away: set[int] = set()
        for side, root, anchor in picks:
            links = {frozenset((int(a), int(b))) for a, b in zip(u, l)} - {frozenset((root, anchor))}
            seen = {root}
            while True:
                more = {y for x in links for y in x if x & seen and not x & away} - seen
                if not more:
                    break
                seen |= more
            assert seen == side and 2 <= len(side) <= 6 and ground not in side
            away |= side
        assert away == gone
