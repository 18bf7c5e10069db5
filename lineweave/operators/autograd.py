"""A small reverse-mode differentiator over NumPy arrays, for models of a few thousand parameters."""

from __future__ import annotations

import numpy as np


class Value:
    """An array and how to pass gradients on to what it was made from."""

    def __init__(self, data, parents=(), back=None):
        self.data = np.asarray(data, dtype=np.float64)
        self.parents, self.back = parents, back
        self.grad = None

    def _give(self, g):
        self.grad = g if self.grad is None else self.grad + g

    def backward(self) -> None:
        order, seen = [], set()
        todo = [(self, False)]
        while todo:
            v, done = todo.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                todo.append((v, True))
                todo += [(p, False) for p in v.parents]
        self.grad = np.ones_like(self.data)
        for v in reversed(order):
            if v.back is not None and v.grad is not None:
                v.back(v.grad)

    def __add__(self, other):
        other = value(other)
        return Value(self.data + other.data, (self, other), lambda g: (self._give(fold(g, self.data.shape)), other._give(fold(g, other.data.shape))))

    def __mul__(self, other):
        other = value(other)
        return Value(self.data * other.data, (self, other), lambda g: (self._give(fold(g * other.data, self.data.shape)), other._give(fold(g * self.data, other.data.shape))))

    def __sub__(self, other):
        return self + value(other) * -1.0

    def __truediv__(self, other):
        other = value(other)
        return Value(self.data / other.data, (self, other), lambda g: (self._give(fold(g / other.data, self.data.shape)), other._give(fold(-g * self.data / other.data**2, other.data.shape))))

    def __matmul__(self, other):
        return Value(self.data @ other.data, (self, other), lambda g: (self._give(g @ other.data.T), other._give(self.data.T @ g)))

    def exp(self):
        out = np.exp(self.data)
        return Value(out, (self,), lambda g: self._give(g * out))

    def log(self):
        return Value(np.log(self.data), (self,), lambda g: self._give(g / self.data))

    def sqrt(self):
        out = np.sqrt(self.data)
        return Value(out, (self,), lambda g: self._give(g / (2 * out)))

    def abs(self):
        return Value(np.abs(self.data), (self,), lambda g: self._give(g * np.sign(self.data)))

    def leaky(self, slope: float = 0.0):
        k = np.where(self.data > 0, 1.0, slope)
        return Value(self.data * k, (self,), lambda g: self._give(g * k))

    def softplus(self):
        out = np.logaddexp(0.0, self.data)
        return Value(out, (self,), lambda g: self._give(g / (1 + np.exp(-self.data))))

    def sum(self, axis=None, keepdims=False):
        def back(g):
            if axis is not None and not keepdims:
                g = np.expand_dims(g, axis)
            self._give(np.broadcast_to(g, self.data.shape).copy())

        return Value(self.data.sum(axis=axis, keepdims=keepdims), (self,), back)

    def mean(self, axis=None, keepdims=False):
        n = self.data.size if axis is None else self.data.shape[axis]
        return self.sum(axis, keepdims) * (1.0 / n)

    def take(self, rows):
        def back(g):
            out = np.zeros_like(self.data)
            np.add.at(out, rows, g)
            self._give(out)

        return Value(self.data[rows], (self,), back)

    def gather_sum(self, groups, n: int):
        """Sums of rows by group."""
        out = np.zeros((n, *self.data.shape[1:]))
        np.add.at(out, groups, self.data)
        return Value(out, (self,), lambda g: self._give(g[groups]))

    def column(self):
        return Value(self.data.reshape(-1), (self,), lambda g: self._give(g.reshape(self.data.shape)))

    def as_column(self):
        return Value(self.data.reshape(-1, 1), (self,), lambda g: self._give(g.reshape(self.data.shape)))


def value(x) -> Value:
    return x if isinstance(x, Value) else Value(x)


def fold(g: np.ndarray, shape: tuple) -> np.ndarray:
    """Gradient of what was broadcast from ``shape``."""
    while g.ndim > len(shape):
        g = g.sum(axis=0)
    for i, n in enumerate(shape):
        if n == 1 and g.shape[i] != 1:
            g = g.sum(axis=i, keepdims=True)
    return g


def beside(parts: list[Value]) -> Value:
    """Columns of several arrays next to each other."""
    cuts = np.cumsum([p.data.shape[1] for p in parts])[:-1]

    def back(g):
        for p, part in zip(parts, np.split(g, cuts, axis=1)):
            p._give(part)

    return Value(np.concatenate([p.data for p in parts], axis=1), tuple(parts), back)


def below(parts: list[Value]) -> Value:
    """Rows of several arrays under each other."""
    cuts = np.cumsum([len(p.data) for p in parts])[:-1]

    def back(g):
        for p, part in zip(parts, np.split(g, cuts)):
            p._give(part)

    return Value(np.concatenate([p.data for p in parts]), tuple(parts), back)


def softmax_by(logits: Value, groups: np.ndarray, n: int) -> Value:
    """Softmax of a vector within groups."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, groups, logits.data)
    e = (logits - top[groups]).exp()
    return e / e.gather_sum(groups, n).take(groups)
