"""Graph-attention model over networks: an encoder and four heads, their losses and a training loop.

Parameters are a few arrays; they travel to the kernels, which work on one network a call, and gradients come back summed.  Weights
are kept as a table (name, shape, values).
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import QN_SLOTS
from ..session import written
from .autograd import Value, below, beside, softmax_by
from .features import EDGE_DIM, NODE_DIM, as_arrays
from .frames import empty
from .network import sizes

#: Sizes of the model, slope of the attention's activation, weights of the losses.
HIDDEN, LAYERS, SLOPE, EXTRAS = 64, 3, 0.2, 3
#: Levels of a net that a task scores at once if they are not of one component, and levels or lines that a task has intermediate values of.
LEVELS, ROWS = 20_000, 10_000
LOSS_WEIGHTS = {"unc": 1.0, "outlier": 10.0, "link": 10.0, "fix": 10.0}

#: Samples of these kinds that an epoch draws; of other kinds it takes all.
PER_EPOCH = {"corrupted": 6, "linked": 4}

Params = dict[str, np.ndarray]


def initial(seed: int = 0, hidden: int = HIDDEN, layers: int = LAYERS) -> Params:
    rng = np.random.default_rng(seed)
    dense = lambda i, o: rng.uniform(-1, 1, (i, o)) * np.sqrt(6.0 / (i + o))
    p: Params = {}
    for k in range(layers):
        d = NODE_DIM if k == 0 else hidden
        p |= {f"conv{k}.src": dense(d, hidden), f"conv{k}.src_b": np.zeros(hidden), f"conv{k}.dst": dense(d, hidden), f"conv{k}.dst_b": np.zeros(hidden), f"conv{k}.edge": dense(EDGE_DIM, hidden)}
        p |= {f"conv{k}.att": dense(hidden, 1), f"conv{k}.bias": np.zeros(hidden), f"norm{k}.scale": np.ones(hidden), f"norm{k}.shift": np.zeros(hidden)}
    for name, d in (("unc", hidden), ("outlier", 2 * hidden + EDGE_DIM), ("link", 2 * hidden + QN_SLOTS), ("fix", 2 * hidden + EDGE_DIM + EXTRAS)):
        p |= {f"{name}.w1": dense(d, hidden), f"{name}.b1": np.zeros(hidden), f"{name}.w2": dense(hidden, 1), f"{name}.b2": np.zeros(1)}
    return p


def leaves(p: Params) -> dict[str, Value]:
    return {k: Value(v) for k, v in p.items()}


def encode(w: dict[str, Value], x: np.ndarray, ends: np.ndarray, attr: np.ndarray) -> Value:
    """Embeddings of the levels of one network: attention over lines with their features, each level its own neighbour too.

    A level's own line has the mean features of the lines that end there.
    """
    n = len(x)
    src, dst = np.concatenate([ends[0], np.arange(n)]), np.concatenate([ends[1], np.arange(n)])
    own = np.zeros((n, attr.shape[1]))
    np.add.at(own, ends[1], attr)
    own /= np.maximum(np.bincount(ends[1], minlength=n), 1)[:, None]
    e = Value(np.concatenate([attr, own]))
    h = Value(x)
    k = 0
    while f"conv{k}.src" in w:
        left = h @ w[f"conv{k}.src"] + w[f"conv{k}.src_b"]
        right = h @ w[f"conv{k}.dst"] + w[f"conv{k}.dst_b"]
        h = _attended(w, k, left.take(src), right.take(dst), e, dst, n)
        k += 1
    return h


def _attended(w: dict[str, Value], k: int, m: Value, right: Value, e: Value, dst: np.ndarray, n: int) -> Value:
    """What layer ``k`` makes of messages ``m`` to ``n`` levels."""
    logit = ((m + right + e @ w[f"conv{k}.edge"]).leaky(SLOPE) @ w[f"conv{k}.att"]).column()
    share = softmax_by(logit, dst, n)
    h = (m * share.as_column()).gather_sum(dst, n) + w[f"conv{k}.bias"]
    h = h - h.mean(axis=1, keepdims=True)
    h = h / ((h * h).mean(axis=1, keepdims=True) + 1e-5).sqrt() * w[f"norm{k}.scale"] + w[f"norm{k}.shift"]
    return h.leaky()


def embedded(w: dict[str, Value], x: np.ndarray, ends: np.ndarray, attr: np.ndarray) -> np.ndarray:
    """The rows of :func:`encode` without a way back for gradients: ``ROWS`` levels at a time, with the lines that end there."""
    n = len(x)
    order = np.argsort(ends[1], kind="stable")
    src, dst = ends[0][order], ends[1][order]
    first = np.searchsorted(dst, np.arange(n + 1))
    h, k = x, 0
    while f"conv{k}.src" in w:
        left, right = (h @ w[f"conv{k}.{end}"].data + w[f"conv{k}.{end}_b"].data for end in ("src", "dst"))
        h = np.empty_like(left)
        for a in range(0, n, ROWS):
            b = min(a + ROWS, n)
            mine, levels = slice(first[a], first[b]), np.arange(b - a)
            at, given = dst[mine] - a, attr[order[mine]]
            own = np.zeros((b - a, attr.shape[1]))
            np.add.at(own, at, given)
            own /= np.maximum(np.bincount(at, minlength=b - a), 1)[:, None]
            to = np.concatenate([at, levels])
            m = Value(left[np.concatenate([src[mine], levels + a])])
            h[a:b] = _attended(w, k, m, Value(right[a:b][to]), Value(np.concatenate([given, own])), to, b - a).data
        k += 1
    return h


def by_rows(f: Callable[[slice], Value], n: int) -> np.ndarray:
    """Values of ``f`` for ``n`` rows, ``ROWS`` at a time."""
    return np.concatenate([f(slice(a, a + ROWS)).data for a in range(0, n, ROWS)])


def head(w: dict[str, Value], name: str, z: Value) -> Value:
    return ((z @ w[f"{name}.w1"] + w[f"{name}.b1"]).leaky() @ w[f"{name}.w2"] + w[f"{name}.b2"]).column()


def log_sigma(w, h: Value) -> Value:
    """Logarithm of each level's width in 1e-6/cm."""
    return head(w, "unc", h)


def outlier_logits(w, h: Value, ends, attr) -> Value:
    """One logit a line; lines are the even edges, upper to lower."""
    return head(w, "outlier", beside([h.take(ends[0, 0::2]), h.take(ends[1, 0::2]), Value(attr[0::2])]))


def link_logits(w, h_a: Value, h_b: Value, qn_a: np.ndarray, qn_b: np.ndarray) -> Value:
    """Logit of a line between two levels; the same in either order."""
    return head(w, "link", beside([h_a + h_b, (h_a - h_b).abs(), Value(np.abs(qn_a - qn_b))]))


def fix_logits(w, h: Value, cand, lower, attr, extras) -> Value:
    """One logit for each candidate row (candidate, lower level, features of the line, three extras)."""
    return head(w, "fix", beside([h.take(cand), h.take(lower), Value(attr), Value(extras)]))


def nll(ls: Value, level: np.ndarray, err: np.ndarray) -> Value:
    """Gaussian negative log-likelihood of errors of levels, mean over rows; rows without an error are not passed."""
    s = ls.take(level)
    return (s + Value(err**2 / 2) * (s * -2.0).exp()).mean()


def bce(logits: Value, labels: np.ndarray, pos_weight: float) -> Value:
    return (Value(pos_weight * labels) * (logits * -1.0).softplus() + Value(1.0 - labels) * logits.softplus()).mean()


def cross_entropy(logits: Value, suspect: np.ndarray, target: np.ndarray) -> Value:
    n = int(suspect.max()) + 1
    top = np.full(n, -np.inf)
    np.maximum.at(top, suspect, logits.data)
    shifted = logits - Value(top[suspect])  # a window's greatest logit is 0, so no sum of exponentials is 0
    mass = shifted.exp().as_column().gather_sum(suspect, n).column().log()
    hit = np.flatnonzero(target)
    return (mass.take(suspect[hit]) - shifted.take(hit)).mean()


def loss_of(w: dict[str, Value], g: dict) -> Value:
    """Weighted sum of the losses for which a sample has data."""
    h = encode(w, g["x"], g["ends"], g["attr"])
    parts = []
    if "err" in g:
        parts.append(nll(log_sigma(w, h), g["err_level"], g["err"]) * LOSS_WEIGHTS["unc"])
    if "bad" in g:
        parts.append(bce(outlier_logits(w, h, g["ends"], g["attr"]), g["bad"], g.get("pos_weight", 1.0)) * LOSS_WEIGHTS["outlier"])
    if "cand" in g and len(g["cand"]):
        parts.append(cross_entropy(fix_logits(w, h, g["cand"], g["lower"], g["line_attr"], g["extras"]), g["suspect"], g["target"]) * LOSS_WEIGHTS["fix"])
    if "orphans" in g and g["orphans"]:
        logits, labels = [], []
        for o in g["orphans"]:
            ho = encode(w, o["x"], o["ends"], o["attr"])
            logits.append(link_logits(w, ho.take(o["pair_o"]), h.take(o["pair_m"]), o["x"][o["pair_o"], :QN_SLOTS], g["x"][o["pair_m"], :QN_SLOTS]))
            labels.append(o["label"])
        y = np.concatenate(labels)
        parts.append(bce(below(logits), y, float((1 - y).sum() / max(y.sum(), 1))) * LOSS_WEIGHTS["link"])
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def gradient(p: Params, g: dict) -> tuple[float, Params]:
    w = leaves(p)
    loss = loss_of(w, g)
    loss.backward()
    return float(loss.data), {k: (v.grad if v.grad is not None else np.zeros_like(v.data)) for k, v in w.items()}


class Adam:
    def __init__(self, rate: float = 1e-3, beta1: float = 0.9, beta2: float = 0.999):
        self.rate, self.b1, self.b2, self.t = rate, beta1, beta2, 0
        self.m: Params = {}
        self.v: Params = {}

    def step(self, p: Params, grads: Params) -> Params:
        self.t += 1
        out = {}
        for k, x in p.items():
            self.m[k] = self.b1 * self.m.get(k, 0.0) + (1 - self.b1) * grads[k]
            self.v[k] = self.b2 * self.v.get(k, 0.0) + (1 - self.b2) * grads[k] ** 2
            out[k] = x - self.rate * (self.m[k] / (1 - self.b1**self.t)) / (np.sqrt(self.v[k] / (1 - self.b2**self.t)) + 1e-8)
        return out


def packed(arrays: dict) -> bytes:
    """A sample as bytes; nested orphans by their place."""
    flat = {k: v for k, v in arrays.items() if k != "orphans"}
    for i, o in enumerate(arrays.get("orphans", ())):
        flat |= {f"orphan{i}/{k}": v for k, v in o.items()}
    out = io.BytesIO()
    np.savez_compressed(out, **flat)
    return out.getvalue()


def unpacked(raw: bytes) -> dict:
    with np.load(io.BytesIO(raw)) as z:
        flat = {k: z[k] for k in z.files}
    g = {k: (v.item() if v.ndim == 0 else v) for k, v in flat.items() if "/" not in k}
    numbers = sorted({int(k.split("/")[0].removeprefix("orphan")) for k in flat if "/" in k})
    if numbers:
        g["orphans"] = [{k.split("/")[1]: v for k, v in flat.items() if k.startswith(f"orphan{i}/")} for i in numbers]
    return g


def _to_vector(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _from_vector(v: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = v[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def mean_gradient(samples: DataFrame, p: Params) -> tuple[float, Params]:
    """Mean loss and gradient over ``samples(sample binary)``; every task sends one sum of the size of the parameters."""

    def run(batches):
        total, loss, n = None, 0.0, 0
        for b in batches:
            for raw in b["sample"]:
                one, g = gradient(p, unpacked(raw))
                v = _to_vector(g)
                total, loss, n = v if total is None else total + v, loss + one, n + 1
        if n:
            yield pd.DataFrame({"loss": [loss], "n": [n], "grad": [total.tobytes()]})

    sums = samples.select("sample").mapInPandas(run, "loss double, n long, grad binary").toPandas()  # one row a task
    n = int(sums["n"].sum())
    if not n:
        raise ValueError("no samples to learn from")
    total = sum(np.frombuffer(g, dtype=np.float64) for g in sums["grad"])
    return float(sums["loss"].sum() / n), _from_vector(total / n, p)


def epoch_samples(samples: DataFrame, counts: dict[str, int], per_epoch: dict[str, int], seed: int, epoch: int) -> DataFrame:
    """The samples that an epoch takes: of the kinds in ``per_epoch`` so many, drawn without replacement, of others all.

    ``samples(kind, nth, ...)`` are numbered within their kind, and ``counts`` says how many there are.
    """
    rng = np.random.default_rng([seed, epoch])
    taken = F.lit(False)
    for kind, n in sorted(counts.items()):
        few = per_epoch.get(kind, n)
        mine = F.col("kind") == kind
        if few < n:
            mine &= F.col("nth").isin([int(k) for k in rng.choice(n, few, replace=False)])
        taken |= mine
    return samples.where(taken)


def train(samples: DataFrame, validation: DataFrame | None = None, *, epochs: int = 1000, per_epoch: dict[str, int] | None = None, check_every: int = 50, rate: float = 1e-3, seed: int = 0, start: Params | None = None, log: Callable[[int, float, float], None] | None = None) -> Params:
    """Parameters of the least loss on ``validation`` (else on the samples), looked at each ``check_every`` epochs.

    An epoch is one step over what ``per_epoch`` draws by ``kind``, or over all samples.
    """
    p = start or initial(seed)
    adam, best, least = Adam(rate), None, np.inf
    counts: dict[str, int] = {}
    if per_epoch:
        nth = F.row_number().over(Window.partitionBy("kind").orderBy("net", F.xxhash64("sample"))) - 1
        samples = written(samples.withColumn("nth", nth), "numbered")
        counts = {r["kind"]: r["n"] for r in samples.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    for epoch in range(epochs):
        loss, g = mean_gradient(epoch_samples(samples, counts, per_epoch, seed, epoch) if per_epoch else samples, p)
        if epoch % check_every == 0 or epoch == epochs - 1:
            seen = loss if validation is None else mean_loss(validation, p)
            if log:
                log(epoch, loss, seen)
            if seen < least:
                best, least = p, seen
        p = adam.step(p, g)
    return best if best is not None else p


def mean_loss(samples: DataFrame, p: Params) -> float:
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"loss": [float(loss_of(leaves(p), unpacked(r)).data) for r in b["sample"]]})

    return samples.select("sample").mapInPandas(run, "loss double").agg({"loss": "avg"}).first()[0]


def _together(nodes: DataFrame, edges: DataFrame):
    """Both sides of each net; edges get columns of their own, as they were made from the nodes."""
    return nodes.groupBy("net").cogroup(edges.toDF(*edges.columns).groupBy("net"))


def _flat(rows: DataFrame, column: str, size: int) -> DataFrame:
    """An array as columns of numbers, which take no object a row in Python."""
    return rows.select(*[c for c in rows.columns if c != column], *[F.col(column)[i].cast("double").alias(f"{column}{i}") for i in range(size)])


def _scored(nodes: DataFrame, edges: DataFrame):
    """Both sides of each net, or of its parts if it has more than ``LEVELS`` levels, with arrays as columns (see :func:`_arrays`).

    A level hears of its component alone, so parts of whole components are scored as the net would be.  Components are ranked by size and dealt in
    turn; a larger one stays whole.
    """
    parts = sizes(nodes, LEVELS) if "comp" in nodes.columns and "comp" in edges.columns else None
    nodes, edges = _flat(nodes, "x", NODE_DIM), _flat(edges, "attr", EDGE_DIM)
    if parts is None:
        return _together(nodes, edges)
    dealt = lambda rows: rows.join(F.broadcast(parts), "net").withColumn("_part", F.pmod("comp", "parts")).drop("parts")
    edges = dealt(edges)
    return dealt(nodes).groupBy("net", "_part").cogroup(edges.toDF(*edges.columns).groupBy("net", "_part"))


def _arrays(n: pd.DataFrame, e: pd.DataFrame):
    """Orders of nodes and edges, and what :func:`.features.as_arrays` gives of them."""
    by, lines = np.argsort(n["idx"].to_numpy(), kind="stable"), np.lexsort((e["dir"].to_numpy(), e["seq"].to_numpy()))
    x, attr = np.empty((len(n), NODE_DIM)), np.empty((len(e), EDGE_DIM))
    for name, found, rows, order in (("x", x, n, by), ("attr", attr, e, lines)):
        for i in range(found.shape[1]):
            found[:, i] = rows[f"{name}{i}"].to_numpy(dtype=float)[order]
    idx = n["idx"].to_numpy()[by]
    return by, lines, x, np.stack([np.searchsorted(idx, e[c].to_numpy()[lines]) for c in ("src", "dst")]), attr


def graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(net, sample): each network's arrays as bytes."""

    def run(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n) or not len(e):
            return empty("net", "sample")
        x, ends, attr = as_arrays(n, e)
        return pd.DataFrame({"net": [key[0]], "sample": [packed({"x": x, "ends": ends, "attr": attr})]})

    return _together(nodes, edges).applyInPandas(run, "net string, sample binary")


def score_lines(nodes: DataFrame, edges: DataFrame, p: Params) -> DataFrame:
    """(net, seq, logit): outlier logit of each line."""

    def run(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n) or not len(e):
            return empty("net", "seq", "logit")
        _, lines, x, ends, attr = _arrays(n, e)
        w = leaves(p)
        h = Value(embedded(w, x, ends, attr))
        logit = by_rows(lambda at: outlier_logits(w, h, ends[:, 2 * at.start : 2 * at.stop], attr[2 * at.start : 2 * at.stop]), len(e) // 2)
        return pd.DataFrame({"net": key[0], "seq": e["seq"].to_numpy()[lines][0::2], "logit": logit})

    return _scored(nodes, edges).applyInPandas(run, "net string, seq long, logit double")


def score_levels(nodes: DataFrame, edges: DataFrame, p: Params) -> DataFrame:
    """(net, idx, level, log_sigma, h): width and embedding of each level."""

    def run(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n) or not len(e):
            return empty("net", "idx", "level", "log_sigma", "h")
        by, _, x, ends, attr = _arrays(n, e)
        w = leaves(p)
        h = embedded(w, x, ends, attr)
        widths = by_rows(lambda at: log_sigma(w, Value(h[at])), len(h))
        return pd.DataFrame({"net": key[0], "idx": n["idx"].to_numpy()[by], "level": n["level"].to_numpy()[by], "log_sigma": widths, "h": list(h)})

    return _scored(nodes, edges).applyInPandas(run, "net string, idx int, level string, log_sigma double, h array<double>")


def save(spark: SparkSession, p: Params, path: str) -> None:
    rows = [(k, list(v.shape), v.ravel().tolist()) for k, v in p.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Params:
    return {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in spark.read.parquet(path).toLocalIterator()}
