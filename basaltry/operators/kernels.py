"""Distance and kernel matrices.

A y of few bytes is broadcast, and the matrix is a map over the rows of x; beyond, tiles of both sides meet (see
`pairs`).  Column expressions (`value`) give single values.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pairs, sketch

# -- distances -------------------------------------------------------------------------------------------


def _zip_sum(x: Column, y: Column, fn) -> Column:
    return F.aggregate(F.zip_with(x, y, fn), F.lit(0.0), lambda a, b: a + b)


def squared_euclidean(x: Column, y: Column) -> Column:
    return _zip_sum(x, y, lambda a, b: (a - b) * (a - b))


def l1(x: Column, y: Column) -> Column:
    return _zip_sum(x, y, lambda a, b: F.abs(a - b))


def expsemigroup(x: Column, y: Column) -> Column:
    return _zip_sum(x, y, lambda a, b: F.sqrt(F.abs(a + b)))


def dot(x: Column, y: Column) -> Column:
    return _zip_sum(x, y, lambda a, b: a * b)


#: Rows, columns and features of a block of distances whose terms are made at a time.
TALL, WIDE, DEEP = 64, 256, 8

DISTANCES = {"euclidean": squared_euclidean, "l1": l1, "expsemigroup": expsemigroup}


def _spread_out(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether components are finite and no larger than their differences are, so that sums of them cancel without loss."""
    if not x.size or not y.size:
        return False
    with np.errstate(invalid="ignore"):
        return bool(max(np.abs(x).max(), np.abs(y).max()) <= 64 * np.abs(y - y.mean(axis=0)).mean())


def distance_block(kind: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if kind == "euclidean":
        out = x @ y.T
        out *= -2
        out += (x**2).sum(1)[:, None]
        out += (y**2).sum(1)
        return np.maximum(out, 0.0, out=out)
    out, width, sides = np.empty((len(x), len(y))), x.shape[1], x.T[:, :, None]
    terms, larger = np.empty(DEEP * TALL * WIDE), kind == "l1" and _spread_out(x, y)
    for j in range(0, len(y), WIDE):  # a block stays in a core's cache through all columns
        against = np.ascontiguousarray(y[j : j + WIDE].T)[:, None]
        for i in range(0, len(x), TALL):
            total = np.zeros((len(x[i : i + TALL]), against.shape[2]))
            for k in range(0, width, DEEP):
                some, other = sides[k : k + DEEP, i : i + TALL], against[k : k + DEEP]
                term = terms[: len(some) * total.size].reshape(len(some), *total.shape)
                if larger:  # |a - b| = 2 max(a, b) - a - b
                    np.maximum(some, other, out=term)
                else:
                    (np.subtract if kind == "l1" else np.add)(some, other, out=term)
                    np.abs(term, out=term)
                    if kind != "l1":
                        np.sqrt(term, out=term)
                total += (np.ones(len(some)) @ term.reshape(len(some), -1)).reshape(total.shape)
            out[i : i + TALL, j : j + WIDE] = total
    if larger:
        out *= 2
        out -= x.sum(axis=1)[:, None]
        out -= y.sum(axis=1)
        np.maximum(out, 0.0, out=out)
    return out


def distance_matrix(x: DataFrame, y: DataFrame, kind: str = "euclidean", alpha: float = 1.0, beta: float = 0.0, c: DataFrame | None = None) -> DataFrame:
    """alpha D + beta C as (i, j, v); D is squared for 'euclidean'.  The result has a row for each pair."""
    out = pairs.values(x, y, lambda a, b: distance_block(kind, a, b)).select("i", "j", (alpha * F.col("v")).alias("v"))
    if c is not None and beta:
        out = out.join(c.withColumnRenamed("v", "c"), ["i", "j"], "left").select("i", "j", (F.col("v") + beta * F.coalesce("c", F.lit(0.0))).alias("v"))
    return out


def symmetric_distance_matrix(x: DataFrame, kind: str = "euclidean") -> DataFrame:
    """The lower triangle (i >= j) of the distances within x."""
    if kind == "expsemigroup":
        raise ValueError("this distance has no symmetric form")
    return pairs.values(x, None, lambda a, b: distance_block(kind, a, b))


# -- kernels ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Kernel:
    N: int

    def value(self, x: Column, y: Column) -> Column:
        raise NotImplementedError

    def block(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def exact_map(self, x: np.ndarray) -> np.ndarray | None:
        """z(x) with z(x).z(y) equal to the kernel, for kernels that have such of few columns; else None."""
        return None

    def times(self, x: np.ndarray, y: np.ndarray, v: np.ndarray) -> np.ndarray:
        """K(x, y) v, of which a few values are made at a time, or none where the kernel has an exact map."""
        if (z := self.exact_map(y)) is not None:
            return self.exact_map(x) @ (z.T @ v)
        out = np.zeros((len(x), v.shape[1]))
        for i, j in itertools.product(range(0, len(x), pairs.SIDE), range(0, len(y), pairs.SIDE)):
            out[i : i + pairs.SIDE] += self.block(x[i : i + pairs.SIDE], y[j : j + pairs.SIDE]) @ v[j : j + pairs.SIDE]
        return out

    def gram(self, x: DataFrame, y: DataFrame) -> DataFrame:
        """(i, j, v) for all pairs."""
        return pairs.values(x, y, self.block)

    def symmetric_gram(self, x: DataFrame) -> DataFrame:
        """The lower triangle (i >= j)."""
        return pairs.values(x, None, self.block)

    def features(self, S: int, kind: str = "regular", seed: int = 0, counter: int = 0, stream: str = "threefry") -> sketch.Sketch:
        """A feature map z with z(x).z(y) near the kernel; kind: regular, fast or quasi; stream: that of its random numbers."""
        raise ValueError(f"{type(self).__name__} has no {kind} feature map")

    def to_json(self) -> str:
        return json.dumps({"object_type": "kernel", "kernel_type": type(self).__name__.lower(), **self.__dict__})


@dataclass(frozen=True)
class Linear(Kernel):
    def value(self, x, y):
        return dot(x, y)

    def block(self, x, y):
        return x @ y.T

    def exact_map(self, x):
        return x

    def features(self, S, kind="regular", seed=0, counter=0, stream="threefry"):
        return {"regular": sketch.JLT, "fast": sketch.FJLT, "sparse": sketch.CWT}[kind](self.N, S, seed, counter, stream=stream)


@dataclass(frozen=True)
class Gaussian(Kernel):
    sigma: float = 1.0

    def value(self, x, y):
        return F.exp(-squared_euclidean(x, y) / (2 * self.sigma**2))

    def block(self, x, y):
        out = distance_block("euclidean", x, y)
        out /= -2 * self.sigma**2
        return np.exp(out, out=out)

    def features(self, S, kind="regular", seed=0, counter=0, stream="threefry"):
        return {"regular": sketch.GaussianRFT, "fast": sketch.FastGaussianRFT, "quasi": sketch.GaussianQRFT}[kind](self.N, S, seed, counter, sigma=self.sigma, stream=stream)


@dataclass(frozen=True)
class Polynomial(Kernel):
    q: int = 2
    c: float = 1.0
    gamma: float = 1.0

    def value(self, x, y):
        return F.pow(self.gamma * dot(x, y) + self.c, F.lit(self.q))

    def block(self, x, y):
        return (self.gamma * x @ y.T + self.c) ** self.q

    def features(self, S, kind="regular", seed=0, counter=0, stream="threefry"):
        return sketch.PPT(self.N, S, seed, counter, q=self.q, gamma=self.gamma, c=self.c, stream=stream)


@dataclass(frozen=True)
class Laplacian(Kernel):
    sigma: float = 1.0

    def value(self, x, y):
        return F.exp(-l1(x, y) / self.sigma)

    def block(self, x, y):
        return np.exp(-distance_block("l1", x, y) / self.sigma)

    def features(self, S, kind="regular", seed=0, counter=0, stream="threefry"):
        return {"regular": sketch.LaplacianRFT, "quasi": sketch.LaplacianQRFT}[kind](self.N, S, seed, counter, sigma=self.sigma, stream=stream)


@dataclass(frozen=True)
class ExpSemigroup(Kernel):
    beta: float = 1.0

    def value(self, x, y):
        return F.exp(-self.beta * expsemigroup(x, y))

    def block(self, x, y):
        return np.exp(-self.beta * distance_block("expsemigroup", x, y))

    def symmetric_gram(self, x):
        raise ValueError("this kernel has no symmetric Gram matrix")

    def features(self, S, kind="regular", seed=0, counter=0, stream="threefry"):
        return {"regular": sketch.ExpSemigroupRLT, "quasi": sketch.ExpSemigroupQRLT}[kind](self.N, S, seed, counter, beta=self.beta, stream=stream)


@dataclass(frozen=True)
class Matern(Kernel):
    """Feature maps for any nu; the Gram matrix in closed form for nu = 1/2, 3/2 and 5/2."""

    nu: float = 1.5
    l: float = 1.0  # noqa: E741

    def block(self, x, y):
        r = np.sqrt(distance_block("euclidean", x, y) * 2 * self.nu) / self.l
        forms = {0.5: lambda r: np.exp(-r), 1.5: lambda r: (1 + r) * np.exp(-r), 2.5: lambda r: (1 + r + r * r / 3) * np.exp(-r)}
        if self.nu not in forms:
            raise ValueError("this nu has feature maps alone")
        return forms[self.nu](r)

    def value(self, x, y):
        r = F.sqrt(squared_euclidean(x, y) * 2 * self.nu) / self.l
        forms = {0.5: F.exp(-r), 1.5: (1 + r) * F.exp(-r), 2.5: (1 + r + r * r / 3) * F.exp(-r)}
        if self.nu not in forms:
            raise ValueError("this nu has feature maps alone")
        return forms[self.nu]

    def features(self, S, kind="regular", seed=0, counter=0, stream="threefry"):
        return {"regular": sketch.MaternRFT, "fast": sketch.FastMaternRFT}[kind](self.N, S, seed, counter, nu=self.nu, l=self.l, stream=stream)


KERNELS = {k.__name__.lower(): k for k in (Linear, Gaussian, Polynomial, Laplacian, ExpSemigroup, Matern)}


def kernel(name: str, N: int, **params) -> Kernel:
    return KERNELS[name.lower()](N, **params)


def from_json(text: str) -> Kernel:
    d = json.loads(text)
    return KERNELS[d.pop("kernel_type")](**{k: v for k, v in d.items() if k != "object_type"})


#: Bytes of y that may be broadcast as one block; beyond, tiles of both sides meet.
BROADCAST = 16 << 20


def against(x: DataFrame, y: DataFrame, block_fn, limit: int | None = None) -> DataFrame | None:
    """RowDF of block_fn(x, y), a row of the matrix each, for a y of few bytes (checked); else None."""
    from .matrix import block, map_rows, width_of

    width = width_of(y) or 1
    most = (BROADCAST if limit is None else limit) // (8 * width)
    if y.select("row_id").limit(most + 1).count() > most:
        return None
    few = block(y.orderBy("row_id").select("features").toArrow()["features"].combine_chunks())
    shared = x.sparkSession.sparkContext.broadcast(few)
    return map_rows(x, lambda v: block_fn(v, shared.value))


def row_summary(x: DataFrame, y: DataFrame | None, what: Kernel | str) -> DataFrame:
    """(i, total, largest) over j of a kernel's or distance's matrix; without y of x with itself."""
    fn = (lambda a, b: distance_block(what, a, b)) if isinstance(what, str) else what.block

    def summed(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.stack([np.zeros(len(u)), np.full(len(u), -np.inf)], axis=1)
        for i, _, k in pairs.blocks(u, v, fn):
            part = out[i : i + len(k)]
            part[:, 0] += k.sum(axis=1)
            part[:, 1] = np.maximum(part[:, 1], k.max(axis=1))
        return out

    same = y is None or y is x
    if (rows := against(x, x if same else y, summed, BROADCAST // 8 if same else None)) is not None:  # more pairs are worth tasks of their own
        return rows.select(F.col("row_id").alias("i"), F.col("features")[0].alias("total"), F.col("features")[1].alias("largest"))
    return pairs.summary(x, None if same else y, fn)  # all of these are symmetric
