"""Counter-based random numbers: sample i is a pure function of (seed, i).

Two streams.  `Context` is Threefry2x64-13 in numpy, for dense blocks made where their rows are.  The
portable stream is an md5 column expression, the same in Spark SQL and other engines, for sketches
that stay in Catalyst; `Portable` makes the same values in numpy.  Neither depends on partitioning.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of Threefry2x64: the key-schedule parity constant and the rotation distances.
PARITY = 0x1BD11BDAA9FC1A22
ROTATIONS = (16, 42, 12, 31, 16, 32, 24, 21)


def threefry2x64(counter: np.ndarray, seed: int, rounds: int = 13) -> np.ndarray:
    """First output word for counters (i, 0) under key (seed, 0)."""
    with np.errstate(over="ignore"):
        k0, k1 = np.uint64(seed & (2**64 - 1)), np.uint64(0)
        keys = (k0, k1, k0 ^ k1 ^ np.uint64(PARITY))
        x0 = counter.astype(np.uint64) + keys[0]
        x1 = np.zeros_like(x0) + keys[1]
        for r in range(rounds):
            rot = np.uint64(ROTATIONS[r % 8])
            x0 = x0 + x1
            x1 = ((x1 << rot) | (x1 >> (np.uint64(64) - rot))) ^ x0
            if r % 4 == 3:
                s = r // 4 + 1
                x0 = x0 + keys[s % 3]
                x1 = x1 + keys[(s + 1) % 3] + np.uint64(s)
        return x0


def quantile(dist: str, u: np.ndarray) -> np.ndarray:
    """Quantiles of a named distribution at u in (0, 1)."""
    if dist == "normal":
        return _normal_quantile(u)
    if dist == "cauchy":
        return np.tan(math.pi * (u - 0.5))
    if dist == "levy":
        return 1.0 / _normal_quantile(1 - u / 2) ** 2
    if dist == "exponential":
        return -np.log(u)
    if dist == "uniform":
        return u
    if dist == "rademacher":
        return np.where(u < 0.5, -1.0, 1.0)
    raise ValueError(f"no distribution {dist}")


def _normal_quantile(u: np.ndarray) -> np.ndarray:
    """Inverse normal distribution: a table of exact values refined by two Newton steps with math.erfc."""
    flat = np.asarray(u, dtype=np.float64).ravel()
    grid = _GRID
    x = np.interp(flat, grid[0], grid[1])
    tail = (flat < 1e-3) | (flat > 1 - 1e-3)
    if tail.any():
        nd = NormalDist()
        x[tail] = [nd.inv_cdf(min(max(v, 5e-324), 1 - 2**-53)) for v in flat[tail]]
    mid = ~tail
    for _ in range(2):
        y = x[mid]
        x[mid] = y - (_phi(y) - flat[mid]) * math.sqrt(2 * math.pi) * np.exp(y * y / 2)
    return x.reshape(np.shape(u))


def _phi(x: np.ndarray) -> np.ndarray:
    """Normal distribution function by the series of its odd powers (|x| stays below 3.2 here)."""
    total, term = x.copy(), x.copy()
    for k in range(1, 60):
        term = term * x * x / (2 * k + 1)
        total = total + term
    return 0.5 + total * np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


_P = np.linspace(1e-3, 1 - 1e-3, 2001)
_GRID = (_P, np.array([NormalDist().inv_cdf(p) for p in _P]))


@dataclass
class Context:
    """A stream of 2^64 samples: allocation advances the counter, values are made on demand."""

    seed: int = 0
    counter: int = 0

    def allocate(self, n: int) -> int:
        base = self.counter
        self.counter += n
        return base

    def words(self, base: int, index: np.ndarray) -> np.ndarray:
        return threefry2x64(np.asarray(index).astype(np.uint64) + np.uint64(base), self.seed)

    def uniform(self, base: int, index: np.ndarray) -> np.ndarray:
        return ((self.words(base, index) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53

    def sample(self, dist: str, base: int, index: np.ndarray) -> np.ndarray:
        return quantile(dist, self.uniform(base, index))

    def integers(self, high: int, base: int, index: np.ndarray) -> np.ndarray:
        """Uniform over 0 .. high - 1."""
        return np.minimum((self.uniform(base, index) * high).astype(np.int64), high - 1)

    def chi_square(self, dof: int, base: int, index: np.ndarray) -> np.ndarray:
        """Sum of dof squared normals; sample i uses places i * dof to (i + 1) * dof."""
        index = np.asarray(index)
        places = index[..., None] * dof + np.arange(dof)
        return (self.sample("normal", base, places) ** 2).sum(axis=-1)

    def permutation(self, n: int) -> np.ndarray:
        return np.argsort(self.words(self.allocate(n), np.arange(n)), kind="stable")


class Portable(Context):
    """The portable stream in numpy: the values of the column expressions below, at index base + i.

    It is slower than Threefry, and the same in Spark SQL and other engines.
    """

    def _words(self, tag: str, base: int, index: np.ndarray) -> np.ndarray:
        places = np.asarray(index, dtype=np.int64) + base
        name, md5 = f"{self.seed}{tag}:".encode(), hashlib.md5
        digests = b"".join([md5(name + b"%d" % i).digest()[:4] for i in places.ravel().tolist()])
        return np.frombuffer(digests, ">u4").astype(np.uint64).reshape(places.shape)

    def words(self, base, index):
        return self._words("", base, index)

    def _uniform(self, tag: str, base: int, index: np.ndarray) -> np.ndarray:
        return (self._words(tag, base, index).astype(np.float64) + 0.5) / 4294967296.0

    def uniform(self, base, index):
        return self._uniform("", base, index)

    def sample(self, dist, base, index):
        if dist == "rademacher":
            return np.where(self._words("s", base, index) % np.uint64(2) == 0, 1.0, -1.0)
        if dist in ("normal", "levy"):
            z = np.sqrt(-2.0 * np.log(self._uniform("a", base, index))) * np.cos(2.0 * math.pi * self._uniform("b", base, index))
            return z if dist == "normal" else 1.0 / (z * z)
        return quantile(dist, self.uniform(base, index))


STREAMS: dict[str, type[Context]] = {"threefry": Context, "portable": Portable}


def primes(n: int) -> list[int]:
    out: list[int] = []
    c = 2
    while len(out) < n:
        if all(c % p for p in out if p * p <= c):
            out.append(c)
        c += 1
    return out


def halton(index: np.ndarray, dims: int, leap: int | None = None) -> np.ndarray:
    """Leaped Halton points: (len(index), dims), coordinate i the radical inverse in prime i of index * leap + 1."""
    bases = primes(dims)
    leap = leap if leap is not None else primes(dims + 1)[-1]  # a prime that is no base
    out = np.zeros((len(index), dims))
    for i, b in enumerate(bases):
        n, f = np.asarray(index, dtype=np.int64) * leap + 1, 1.0
        while n.any():
            f /= b
            out[:, i] += f * (n % b)
            n = n // b
    return out


# -- portable stream: column expressions -------------------------------------------------------------


def word(seed: str | int, index: Column) -> Column:
    """32 uniform bits as a long, from md5 of 'seed:index'."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), index.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(seed: str | int, index: Column) -> Column:
    return (word(seed, index) + 0.5) / 4294967296.0


def bucket(seed: str | int, index: Column, n: int) -> Column:
    return word(seed, index) % F.lit(n)


def sign(seed: str | int, index: Column) -> Column:
    return F.when(word(f"{seed}s", index) % 2 == 0, 1.0).otherwise(-1.0)


def normal(seed: str | int, index: Column) -> Column:
    """Box-Muller over two streams."""
    return F.sqrt(-2.0 * F.log(uniform(f"{seed}a", index))) * F.cos(2.0 * math.pi * uniform(f"{seed}b", index))


def cauchy(seed: str | int, index: Column) -> Column:
    return F.tan(math.pi * (uniform(seed, index) - 0.5))


def exponential(seed: str | int, index: Column) -> Column:
    return -F.log(uniform(seed, index))


def levy(seed: str | int, index: Column) -> Column:
    z = normal(seed, index)
    return 1.0 / (z * z)


def sql_word(seed: str | int, index: str) -> str:
    """The same expression in DuckDB's SQL."""
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({index} AS VARCHAR)), 1, 8) AS BIGINT)"


def sql_uniform(seed: str | int, index: str) -> str:
    return f"(({sql_word(seed, index)} + 0.5) / 4294967296.0)"


def sql_bucket(seed: str | int, index: str, n: int) -> str:
    return f"({sql_word(seed, index)} % {n})"


def sql_sign(seed: str | int, index: str) -> str:
    return f"(CASE WHEN {sql_word(f'{seed}s', index)} % 2 = 0 THEN 1.0 ELSE -1.0 END)"


def sql_normal(seed: str | int, index: str) -> str:
    return f"(sqrt(-2.0 * ln({sql_uniform(f'{seed}a', index)})) * cos({2.0 * math.pi!r} * {sql_uniform(f'{seed}b', index)}))"


def sql_cauchy(seed: str | int, index: str) -> str:
    return f"tan({math.pi!r} * ({sql_uniform(seed, index)} - 0.5))"


def sql_exponential(seed: str | int, index: str) -> str:
    return f"(-ln({sql_uniform(seed, index)}))"


def sql_levy(seed: str | int, index: str) -> str:
    z = sql_normal(seed, index)
    return f"(1.0 / ({z} * {z}))"


def sql_chi_square(seed: str | int, dof: int, base: str) -> str:
    """Sum of dof squared normals from place base on."""
    return "(" + " + ".join(f"pow({sql_normal(seed, f'({base} + {d})')}, 2)" for d in range(dof)) + ")"


def sql_integer(seed: str | int, index: str, high: int | str) -> str:
    return f"least(CAST(floor({sql_uniform(seed, index)} * {high}) AS BIGINT), {high} - 1)"
