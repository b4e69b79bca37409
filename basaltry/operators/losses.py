"""Losses and regularizers: values as aggregates or on blocks, and proximal operators on blocks.

Outputs o are (n, k).  With k > 1 and class labels the target is +1 at the label and -1 elsewhere; with k = 1 it
is the label itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def targets(y: np.ndarray, k: int) -> np.ndarray:
    y = np.asarray(y)
    if y.ndim == 2:
        return y.astype(np.float64)
    if k == 1:
        return y.astype(np.float64)[:, None]
    return np.where(np.arange(k) == y.astype(np.int64)[:, None], 1.0, -1.0)


class Loss:
    def evaluate(self, o: np.ndarray, y: np.ndarray) -> float:
        raise NotImplementedError

    def prox(self, x: np.ndarray, lam: float, y: np.ndarray) -> np.ndarray:
        """argmin over o of lam * loss(o, y) + |o - x|^2 / 2."""
        raise NotImplementedError

    def column(self, o: Column, t: Column) -> Column:
        """Loss of one output and target, to be summed."""
        raise NotImplementedError


class Squared(Loss):
    def evaluate(self, o, y):
        return 0.5 * float(((o - targets(y, o.shape[1])) ** 2).sum())

    def prox(self, x, lam, y):
        return (x + lam * targets(y, x.shape[1])) / (1 + lam)

    def column(self, o, t):
        return 0.5 * (o - t) * (o - t)


class AbsoluteDeviation(Loss):
    def evaluate(self, o, y):
        return float(np.abs(o - targets(y, o.shape[1])).sum())

    def prox(self, x, lam, y):
        t = targets(y, x.shape[1])
        return t + np.sign(x - t) * np.maximum(np.abs(x - t) - lam, 0.0)

    def column(self, o, t):
        return F.abs(o - t)


class Hinge(Loss):
    def evaluate(self, o, y):
        return float(np.maximum(0.0, 1 - o * targets(y, o.shape[1])).sum())

    def prox(self, x, lam, y):
        t = targets(y, x.shape[1])
        m = x * t
        return np.where(m > 1, x, np.where(m < 1 - lam, x + lam * t, t))

    def column(self, o, t):
        return F.greatest(F.lit(0.0), 1 - o * t)


class Logistic(Loss):
    """Multinomial: -o[label] + log sum exp o; with one output, log(1 + exp(-o t))."""

    def evaluate(self, o, y):
        if o.shape[1] == 1:
            return float(np.logaddexp(0.0, -o * targets(y, 1)).sum())
        top = o.max(axis=1, keepdims=True)
        return float((np.log(np.exp(o - top).sum(axis=1)) + top[:, 0] - o[np.arange(len(o)), np.asarray(y).astype(int)]).sum())

    def prox(self, x, lam, y):
        """Newton with backtracking, all rows at once."""
        o = x.copy()
        if x.shape[1] == 1:
            t = targets(y, 1)
            for _ in range(100):
                s = 1 / (1 + np.exp(np.clip(o * t, -700, 700)))
                g = -t * s + (o - x) / lam
                if np.abs(g).max(initial=0) < 1e-10:
                    break
                o = o - g / (s * (1 - s) + 1 / lam)
            return o
        rows, label = np.arange(len(x)), np.asarray(y).astype(int)

        def objective(v: np.ndarray) -> np.ndarray:
            top = v.max(axis=1, keepdims=True)
            return np.log(np.exp(v - top).sum(axis=1)) + top[:, 0] - v[rows, label] + ((v - x) ** 2).sum(axis=1) / (2 * lam)

        for _ in range(100):
            e = np.exp(o - o.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            g = p + (o - x) / lam
            g[rows, label] -= 1
            d = p + 1 / lam  # Hessian: diag(d) - p p', inverted by Sherman-Morrison
            u = g / d
            step = u + (p / d) * ((p * u).sum(axis=1) / np.maximum(1 - (p * p / d).sum(axis=1), 1e-12))[:, None]
            slope = (g * step).sum(axis=1)
            if slope.max(initial=0) < 1e-14:
                break
            size, now = np.ones(len(x)), objective(o)
            for _ in range(30):
                bad = objective(o - size[:, None] * step) > now - 0.1 * size * slope
                if not bad.any():
                    break
                size[bad] *= 0.5
            o = o - size[:, None] * step
        return o

    def column(self, o, t):
        return F.log1p(F.exp(-o * t))


class Regularizer:
    def evaluate(self, w: np.ndarray) -> float:
        return 0.0

    def prox(self, w: np.ndarray, lam: float, mu: np.ndarray) -> np.ndarray:
        """Proximal step at w - mu."""
        return w - mu


class L2(Regularizer):
    def evaluate(self, w):
        return 0.5 * float((w * w).sum())

    def prox(self, w, lam, mu):
        return (w - mu) / (1 + lam)


class L1(Regularizer):
    def evaluate(self, w):
        return float(np.abs(w).sum())

    def prox(self, w, lam, mu):
        v = w - mu
        return np.sign(v) * np.maximum(np.abs(v) - lam, 0.0)


LOSSES: dict[str, type[Loss]] = {"squared": Squared, "lad": AbsoluteDeviation, "hinge": Hinge, "logistic": Logistic}
REGULARIZERS: dict[str, type[Regularizer]] = {"none": Regularizer, "l2": L2, "l1": L1}
