"""NumPy kernels on one network, without Spark: levels are numbers 0..n-1, lines arrays of ends, frequencies and weights."""

from __future__ import annotations

import heapq

import numpy as np

#: Refinement passes of the solve.
REFINE = 3
#: Levels that are left for a dense matrix at most, and neighbours of a level that is eliminated before others are asked for.
DENSE, DEGREES = 400, (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
#: Of more levels, a matrix takes what is left once one pair in so many is linked, by blocks of so many levels.
FILL, BLOCK = 30, 128


def number_levels(upper, lower) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(levels, u, l): levels in order of first appearance, upper before lower in a line, and the lines' ends as numbers."""
    import pandas as pd

    both = np.empty(2 * len(upper), dtype=object)
    both[0::2], both[1::2] = upper, lower
    codes, levels = pd.factorize(both)
    return np.asarray(levels, dtype=object), codes[0::2].astype(np.int64), codes[1::2].astype(np.int64)


def components(n: int, u: np.ndarray, l: np.ndarray) -> np.ndarray:  # noqa: E741
    """Smallest number in the component of each level, by hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[l])
        nxt = label.copy()
        np.minimum.at(nxt, label[u], low)
        np.minimum.at(nxt, label[l], low)
        np.minimum.at(nxt, u, low)
        np.minimum.at(nxt, l, low)
        while True:
            jumped = nxt[nxt]
            if np.array_equal(jumped, nxt):
                break
            nxt = jumped
        if np.array_equal(nxt, label):
            return label
        label = nxt


def ranked_components(n: int, u: np.ndarray, l: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """(rank from 1 by size, largest first, ties by first appearance; number of levels) of each level's component."""
    label = components(n, u, l)
    roots, back, sizes = np.unique(label, return_inverse=True, return_counts=True)
    order = np.lexsort((roots, -sizes))
    rank = np.empty(len(roots), dtype=np.int64)
    rank[order] = np.arange(1, len(roots) + 1)
    return rank[back], sizes[back]


def merged(u, l, f, w):  # noqa: E741
    """Lines between the same two levels as one of summed weight and mean frequency; self-loops carry nothing and go."""
    ok = u != l
    u, l, f, w = u[ok], l[ok], f[ok], w[ok]  # noqa: E741
    flip = u > l
    a, b, f = np.where(flip, l, u), np.where(flip, u, l), np.where(flip, -f, f)
    n = int(b.max()) + 1 if len(b) else 1
    key, back = np.unique(a * n + b, return_inverse=True)
    total = np.bincount(back, weights=w, minlength=len(key))
    # deviations from one line of each pair keep digits that a plain weighted sum would lose
    first = np.zeros(len(key))
    first[back[::-1]] = f[::-1]
    mean = first + np.bincount(back, weights=w * (f - first[back]), minlength=len(key)) / total
    return key // n, key % n, mean, total


def potentials(n: int, u, l, f, w) -> np.ndarray:  # noqa: E741
    """Weighted least-squares energies of all components, the lowest level of each at 0.

    Levels with one neighbour are set aside until none is left; the rest is solved component by component by elimination and refined
    by residuals taken line by line, which keeps accuracy when weights span many powers of ten; then the others follow by addition.
    """
    whole = ranked_components(n, u, l)[0]
    u, l, f, w = merged(u, l, f, w)  # noqa: E741
    x = np.zeros(n)
    aside = []
    live = np.ones(len(u), dtype=bool)
    while True:
        e = np.flatnonzero(live)
        degree = np.bincount(u[e], minlength=n) + np.bincount(l[e], minlength=n)
        leaf_u, leaf_l = degree[u[e]] == 1, degree[l[e]] == 1
        off_u, off_l = leaf_u, leaf_l & ~leaf_u  # of a pair on its own, one end stays
        hit = off_u | off_l
        if not hit.any():
            break
        up, down = e[off_u], e[off_l]
        aside.append((np.concatenate([u[up], l[down]]), np.concatenate([l[up], u[down]]), np.concatenate([f[up], -f[down]])))
        live[e[hit]] = False
    u, l, f, w = u[live], l[live], f[live], w[live]  # noqa: E741
    if len(u):
        core = components(n, u, l)
        order = np.argsort(core[u], kind="stable")
        cuts = np.flatnonzero(np.diff(core[u][order])) + 1
        for part in np.split(order, cuts):
            nodes, ends = np.unique(np.concatenate([u[part], l[part]]), return_inverse=True)
            x[nodes] = _refined(len(nodes), ends[: len(part)], ends[len(part) :], f[part], w[part])
    for leaf, parent, step in reversed(aside):
        x[leaf] = x[parent] + step
    low = np.full(int(whole.max(initial=0)) + 1, np.inf)
    np.minimum.at(low, whole, x)
    return x - low[whole]


def laplacian(n: int, u, l, w) -> np.ndarray:  # noqa: E741
    a = np.zeros((n, n))
    np.add.at(a, (u, u), w)
    np.add.at(a, (l, l), w)
    np.add.at(a, (u, l), -w)
    np.add.at(a, (l, u), -w)
    return a


class Filled:
    """Elimination of a connected network of ``m`` levels as a matrix of weights, in place: blocks leave one behind the other, the last level stays at 0.

    What a block leaves behind is a product of matrices without negative entries, so here too weights are only multiplied and added.  Of the
    matrix there are the strips of the blocks' rows, from the block on: weights first, then the shares by which levels follow from later ones, and once
    ``invert`` has turned them, entries of the inverse.
    """

    def __init__(self, m: int, i: np.ndarray, j: np.ndarray, w: np.ndarray):
        self.m, self.own, self.turned = m, [], False
        starts = np.arange(0, m, BLOCK)
        heights = np.minimum(BLOCK, m - starts)
        self.at = np.cumsum(heights * (m - starts)) - heights * (m - starts)
        self.flat = np.zeros(int((heights * (m - starts)).sum()))
        self.strips = [(s, s + h, self.flat[a : a + h * (m - s)].reshape(h, m - s)) for s, h, a in zip(starts.tolist(), heights.tolist(), self.at.tolist())]
        self.flat[self._where(i, j)] = w
        for k, (s, e, strip) in enumerate(self.strips):
            h = e - s - (e == m)  # all but the last level leave
            square, rest = _mirrored(strip[:, : e - s])[:h, :h], strip[:h, h:].copy()
            self.own.append(_grounded_inverse(square, rest.sum(axis=1)))
            step = np.matmul(self.own[-1], rest, out=strip[:h, h:])
            for s2, e2, later in self.strips[k + 1 :]:
                later += rest[:, s2 - e : e2 - e].T @ step[:, s2 - e :]

    def _where(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Place of the entries (i, j)."""
        i, j = np.minimum(i, j), np.maximum(i, j)
        k = i // BLOCK
        return self.at[k] + (i - k * BLOCK) * (self.m - k * BLOCK) + (j - k * BLOCK)

    def solve(self, rhs: np.ndarray) -> np.ndarray:
        assert not self.turned, "the shares are gone"
        b, x = rhs.copy(), np.zeros(self.m)
        for (s, _, strip), own in zip(self.strips, self.own):
            h = len(own)
            b[s + h :] += b[s : s + h] @ strip[:h, h:]
        for (s, _, strip), own in zip(reversed(self.strips), reversed(self.own)):
            h = len(own)
            x[s : s + h] = own @ b[s : s + h] + strip[:h, h:] @ x[s + h :]
        return x

    def invert(self) -> None:
        """From shares to entries of the inverse, the last block first."""
        if self.turned:
            return
        self.turned = True
        for k in reversed(range(len(self.strips))):
            (s, e, strip), own = self.strips[k], self.own[k]
            h = len(own)
            if e == self.m:  # the last level's row and column are 0
                strip[:] = 0.0
                strip[:h, :h] = own
                continue
            step = strip[:, h:].copy()
            found = strip[:, h:]
            found[:] = 0.0
            for s2, e2, later in self.strips[k + 1 :]:
                found[:, s2 - e :] += step[:, s2 - e : e2 - e] @ later
                found[:, s2 - e : e2 - e] += step[:, e2 - e :] @ later[:, e2 - s2 :].T
            strip[:, :h] = own + found @ step.T

    def entries(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        self.invert()
        return self.flat[self._where(i, j)]


def _mirrored(a: np.ndarray) -> np.ndarray:
    """The square of what is written above its diagonal."""
    return np.triu(a, 1) + np.triu(a, 1).T


def _grounded_inverse(w: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Inverse of the normal equations of few levels with weights ``w`` among them (the diagonal is not read) and ``out`` to a ground, without a subtraction."""
    n, w, out = len(w), np.array(w), np.array(out)
    shares, totals = [], []
    for k in range(n):
        totals.append(w[k, k + 1 :].sum() + out[k])
        shares.append(w[k, k + 1 :] / totals[k])
        w[k + 1 :, k + 1 :] += np.outer(w[k, k + 1 :], shares[k])
        out[k + 1 :] += shares[k] * out[k]
    g = np.zeros((n, n))
    for k in reversed(range(n)):
        g[k, k + 1 :] = g[k + 1 :, k] = shares[k] @ g[k + 1 :, k + 1 :]
        g[k, k] = 1.0 / totals[k] + shares[k] @ g[k, k + 1 :]
    return g


class Elimination:
    """A connected network with few of its levels left, from which all others follow: star by star, in rounds.

    Taking a level out joins its neighbours pairwise with weights w_i w_j / sum(w) (star-mesh).  Weights are only multiplied and added,
    never subtracted, so they keep all their digits.  A round takes out levels of few neighbours, no two of them linked; when few
    levels are left, or those left are linked to many of the others, they are taken as a matrix (:class:`Filled`).  Memory is that of the lines
    and of those that elimination adds until then, and of the matrix.
    """

    def __init__(self, n: int, u: np.ndarray, l: np.ndarray, w: np.ndarray, dense: int = DENSE):  # noqa: E741
        self.n, self.rounds = n, []
        u, l, w = self._summed(u, l, w)  # noqa: E741
        alive = n
        while alive > dense and (alive <= DENSE or len(u) * 2 * FILL < alive * alive):
            v = self._free(u, l)
            inner = np.zeros(n, dtype=bool)
            inner[v] = True
            at_u, at_l = inner[u], inner[l]
            hit = at_u | at_l
            owner, other, weight = np.where(at_u, u, l)[hit], np.where(at_u, l, u)[hit], w[hit]
            order = np.argsort(owner, kind="stable")
            owner, other, weight = owner[order], other[order], weight[order]
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            degree = np.diff(np.concatenate([starts, [len(owner)]]))
            total = np.add.reduceat(weight, starts)
            u, l, w = [u[~hit]], [l[~hit]], [w[~hit]]  # noqa: E741
            for d in np.unique(degree).tolist():
                mine = starts[degree == d][:, None] + np.arange(d)
                i, j = np.triu_indices(d, 1)
                ends, part = other[mine], weight[mine]
                u.append(ends[:, i].ravel())
                l.append(ends[:, j].ravel())
                w.append((part[:, i] * part[:, j] / total[degree == d][:, None]).ravel())
                self.rounds.append((owner[mine[:, 0]], ends, part / total[degree == d][:, None], total[degree == d]))
            u, l, w = self._summed(np.concatenate(u), np.concatenate(l), np.concatenate(w))  # noqa: E741
            alive -= len(v)
        left = np.ones(n, dtype=bool)
        for v, *_ in self.rounds:
            left[v] = False
        self.left = np.flatnonzero(left)
        self.place = np.where(left, np.cumsum(left) - 1, -1)
        self.matrix = Filled(len(self.left), self.place[u], self.place[l], w)

    def _summed(self, u, l, w):  # noqa: E741
        """Parallel lines as one."""
        key, back = np.unique(np.minimum(u, l) * self.n + np.maximum(u, l), return_inverse=True)
        return key // self.n, key % self.n, np.bincount(back, weights=w, minlength=len(key))

    def _free(self, u, l) -> np.ndarray:  # noqa: E741
        """Levels of few neighbours, no two of them linked, which come before their neighbours by (degree, hash)."""
        degree = np.bincount(u, minlength=self.n) + np.bincount(l, minlength=self.n)
        present = degree > 0
        for most in (*DEGREES, self.n):
            few = present & (degree <= most)
            if few.sum() * 20 > present.sum() or most == self.n:
                break
        rank = np.where(few, degree, self.n) * (1 << 20) + (np.arange(self.n) * 2654435761 >> 7) % (1 << 20)
        rank = np.argsort(np.argsort(rank, kind="stable"), kind="stable")
        low = np.full(self.n, self.n)
        np.minimum.at(low, u, rank[l])
        np.minimum.at(low, l, rank[u])
        return np.flatnonzero(few & (rank < low))

    def solve(self, rhs: np.ndarray) -> np.ndarray:
        """Potentials for ``rhs``, which sums to 0; the last level left is at 0."""
        b, x = rhs.copy(), np.zeros(self.n)
        for v, ends, share, _ in self.rounds:
            np.add.at(b, ends.ravel(), (share * b[v][:, None]).ravel())
        x[self.left] = self.matrix.solve(b[self.left])
        for v, ends, share, total in reversed(self.rounds):
            x[v] = (share * x[ends]).sum(axis=1) + b[v] / total
        return x

    def resistances(self, u: np.ndarray, l: np.ndarray) -> np.ndarray:  # noqa: E741
        """Effective resistance between the ends of lines of the network.

        Entries of the inverse are found backwards for the links that elimination made or met, which are all that is asked for.
        """
        n, place = self.n, self.place
        own = np.zeros(n)
        own[self.left] = self.matrix.entries(place[self.left], place[self.left])
        keys, values = np.zeros(0, dtype=np.int64), np.zeros(0)
        wait: list = []  # entries not yet among the sorted ones; those of one round never ask for each other

        def entries(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Of levels that are left from the matrix, of others from the sorted ones."""
            i, j = place[a], place[b]
            both = (i >= 0) & (j >= 0)
            found = np.empty(a.shape)
            found[both] = self.matrix.entries(i[both], j[both])
            found[~both] = values[np.searchsorted(keys, (np.minimum(a, b) * n + np.maximum(a, b))[~both])]
            return found

        for v, ends, share, total in reversed(self.rounds):
            d = ends.shape[1]
            g = np.zeros((len(v), d, d))
            a, b = np.triu_indices(d, 1)
            if len(a):
                if wait:
                    keys, values = _merged_sorted([(keys, values), *wait])
                    wait = []
                g[:, a, b] = g[:, b, a] = entries(ends[:, a], ends[:, b])
            g[:, np.arange(d), np.arange(d)] = own[ends]
            row = np.einsum("vi,vij->vj", share, g)
            own[v] = 1.0 / total + np.einsum("vj,vj->v", share, row)
            wait.append(((np.minimum(v[:, None], ends) * n + np.maximum(v[:, None], ends)).ravel(), row.ravel()))
        keys, values = _merged_sorted([(keys, values), *wait])
        return own[u] + own[l] - 2 * entries(u, l)


def _merged_sorted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, values = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def _refined(n, u, l, f, w) -> np.ndarray:  # noqa: E741
    solved = Elimination(n, u, l, w)
    x = np.zeros(n)
    for _ in range(REFINE + 1):
        r = w * (f - (x[u] - x[l]))
        x += solved.solve(np.bincount(u, weights=r, minlength=n) - np.bincount(l, weights=r, minlength=n))
    return x


def neighbours(n: int, u, l) -> list[list[tuple[int, int]]]:  # noqa: E741
    """For each level, (other end, line) of its lines."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, (a, b) in enumerate(zip(u.tolist(), l.tolist())):
        out[a].append((b, k))
        out[b].append((a, k))
    return out


def cheapest(n: int, u, l, cost_up, cost_down, roots) -> np.ndarray:  # noqa: E741
    """Least cost from any of ``roots``; ``cost_up[k]`` is paid when line k is taken from its lower to its upper end."""
    near = neighbours(n, u, l)
    up, down, ends = cost_up.tolist(), cost_down.tolist(), u.tolist()
    dist = [np.inf] * n
    heap = []
    for r in roots:
        dist[r] = 0.0
        heap.append((0.0, int(r)))
    heapq.heapify(heap)
    while heap:
        d, a = heapq.heappop(heap)
        if d > dist[a]:
            continue
        for b, k in near[a]:
            c = d + (up[k] if ends[k] == b else down[k])
            if c < dist[b]:
                dist[b] = c
                heapq.heappush(heap, (c, b))
    return np.array(dist)


def bridges(n: int, u, l) -> np.ndarray:  # noqa: E741
    """Whether each line is a bridge of the simple graph, in which lines between the same two levels count as one."""
    key = np.minimum(u, l) * n + np.maximum(u, l)
    simple, back = np.unique(key, return_inverse=True)
    near = neighbours(n, simple // n, simple % n)
    found = np.zeros(len(simple), dtype=bool)
    entered, low = [-1] * n, [0] * n
    clock = 0
    for root in range(n):
        if entered[root] >= 0:
            continue
        entered[root] = low[root] = clock
        clock += 1
        stack = [(root, -1, iter(near[root]))]
        while stack:
            a, by, rest = stack[-1]
            for b, k in rest:
                if k == by:
                    continue
                if entered[b] >= 0:
                    low[a] = min(low[a], entered[b])
                    continue
                entered[b] = low[b] = clock
                clock += 1
                stack.append((b, k, iter(near[b])))
                break
            else:
                stack.pop()
                if stack:
                    parent = stack[-1][0]
                    low[parent] = min(low[parent], low[a])
                    if low[a] > entered[parent]:
                        found[by] = True
    return found[back] & (u != l)


def leverages(n: int, u, l, w) -> np.ndarray:  # noqa: E741
    """Leverage of each line: 1 for a lone bridge, w * effective resistance else; parallel lines share by weight."""
    total_key = np.minimum(u, l) * n + np.maximum(u, l)
    _, back = np.unique(total_key, return_inverse=True)
    group = np.bincount(back, weights=w)
    loop = u == l
    bridge = bridges(n, u, l)
    h = np.where(bridge, w / group[back], 0.0)
    core = np.flatnonzero(~bridge & ~loop)
    if len(core):
        label = components(n, u[core], l[core])
        order = np.argsort(label[u[core]], kind="stable")
        for part in np.split(core[order], np.flatnonzero(np.diff(label[u[core]][order])) + 1):
            nodes, ends = np.unique(np.concatenate([u[part], l[part]]), return_inverse=True)
            a, b = ends[: len(part)], ends[len(part) :]
            h[part] = w[part] * Elimination(len(nodes), a, b, w[part]).resistances(a, b)
    return np.clip(h, 0.0, 1.0)


class Rooted:
    """A connected network hung up at ``root``: parents in a breadth-first tree, and an order in which each subtree is one range.

    What a bridge separates from the root is the subtree of its lower end, so sides of cuts are ranges of that order.
    """

    def __init__(self, n: int, u: np.ndarray, l: np.ndarray, root: int):  # noqa: E741
        src, dst = np.concatenate([u, l]), np.concatenate([l, u])
        by = np.argsort(src, kind="stable")
        dst, first = dst[by], np.searchsorted(src[by], np.arange(n + 1))
        self.parent = np.full(n, -1)
        self.parent[root] = root
        layers = [np.array([root])]
        while len(layers[-1]):
            now = layers[-1]
            degree = first[now + 1] - first[now]
            at = np.repeat(first[now] - np.cumsum(degree) + degree, degree) + np.arange(degree.sum())
            new, where = np.unique(dst[at], return_index=True)
            fresh = self.parent[new] < 0
            self.parent[new[fresh]] = np.repeat(now, degree)[where[fresh]]
            layers.append(new[fresh])
        self.size = np.ones(n, dtype=np.int64)
        for layer in reversed(layers[1:]):
            np.add.at(self.size, self.parent[layer], self.size[layer])
        self.place = np.full(n, n)
        self.place[root] = 0
        for layer in layers[1:]:
            layer = layer[np.argsort(self.parent[layer], kind="stable")]
            up = self.parent[layer]
            # siblings lie one behind the other, the first right behind its parent
            run = np.cumsum(self.size[layer]) - self.size[layer]
            head = np.concatenate([[True], up[1:] != up[:-1]]) if len(up) else np.zeros(0, dtype=bool)
            self.place[layer] = self.place[up] + 1 + run - np.repeat(run[head], np.diff(np.flatnonzero(head), append=len(up)))
        self.order = np.argsort(self.place, kind="stable")

    def below(self, v: int) -> slice:
        """Places of the subtree of ``v``."""
        return slice(int(self.place[v]), int(self.place[v] + self.size[v]))


def detach(n: int, u, l, ground: int, cuts: list[tuple[int, int]], n_detach: int, max_size: int):  # noqa: E741
    """Cuts of bridges, in the given order, that take 2 to ``max_size`` levels off the ground's side; ``n_detach`` at most.

    Returns ([(levels, root, anchor)], all levels that left); with a cut, those levels of its lower subtree leave that are still there.
    """
    tree = Rooted(n, np.asarray(u), np.asarray(l), ground)
    there = np.ones(n, dtype=bool)  # by place
    picks: list[tuple[set[int], int, int]] = []
    lower = [(b, a) if tree.parent[b] == a else (a, b) for a, b in cuts]
    for v, anchor in lower:
        span = tree.below(v)
        left = int(np.count_nonzero(there[span])) if there[span.start] and len(picks) < n_detach else 0
        if 2 <= left <= max_size:
            picks.append((set(tree.order[span][there[span]].tolist()), v, anchor))
            there[span] = False
    return picks, set(tree.order[~there].tolist())
