"""Iterative solvers: loops on the driver over distributed products.  Rows may be dense or sparse.

`Operator` is what a solver needs of a matrix: products with a small dense block from either side.
A RowDF becomes one whose `mul` maps rows against a broadcast n x k block and whose results of
height m stay distributed columns; everything of height n lives on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import Context
from ..sources.tables import written
from . import sparse
from .matrix import block, features, is_sparse, parts_of, reduce_blocks, width_of

EPS = float(np.finfo(np.float64).eps)


@dataclass
class Params:
    tolerance: float = 1e-14
    iter_lim: int = 100
    log: list = field(default_factory=list)


@dataclass
class Result:
    x: np.ndarray
    code: int
    iterations: int


class NormalOperator:
    """v -> A'A v for a RowDF A, one pass over A for a block of vectors."""

    def __init__(self, rows: DataFrame, shift: float = 0.0):
        self.rows, self.n, self.shift = rows.select(*parts_of(rows)), width_of(rows), shift

    def __call__(self, v: np.ndarray) -> np.ndarray:
        b = self.rows.sparkSession.sparkContext.broadcast(v)
        out = reduce_blocks(self.rows, lambda t: (x := features(t)).T @ (x @ b.value), (self.n, v.shape[1])) + self.shift * v
        b.unpersist()
        return out


def cg(a: Callable[[np.ndarray], np.ndarray], b: np.ndarray, params: Params | None = None, precondition: Callable | None = None, x0: np.ndarray | None = None) -> Result:
    """Conjugate gradients for several right sides; codes: -1 all converged, -6 iteration limit."""
    p_ = params or Params()
    m = precondition or (lambda r: r)
    b = np.atleast_2d(b.T).T
    x = np.zeros_like(b) if x0 is None else x0.copy()
    r = b - (a(x) if x.any() else 0)
    bound = p_.tolerance * np.linalg.norm(b, axis=0)
    z = m(r)
    p, rho = z.copy(), (r * z).sum(axis=0)
    for it in range(p_.iter_lim):
        if (np.linalg.norm(r, axis=0) <= bound).all():
            return Result(x, -1, it)
        q = a(p)
        alpha = _ratio(rho, (p * q).sum(axis=0))
        x, r = x + alpha * p, r - alpha * q
        z = m(r)
        new = (r * z).sum(axis=0)
        p, rho = z + _ratio(new, rho) * p, new
        p_.log.append(float(np.linalg.norm(r)))
    return Result(x, -1 if (np.linalg.norm(r, axis=0) <= bound).all() else -6, p_.iter_lim)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a), where=b != 0)


def flexible_cg(a: Callable, b: np.ndarray, params: Params | None = None, precondition: Callable | None = None) -> Result:
    """CG whose preconditioner may change: each direction is made A-orthogonal to all before it."""
    p_ = params or Params()
    m = precondition or (lambda r: r)
    b = np.atleast_2d(b.T).T
    x, r = np.zeros_like(b), b.copy()
    bound, kept = p_.tolerance * np.linalg.norm(b, axis=0), []
    for it in range(p_.iter_lim):
        if (np.linalg.norm(r, axis=0) <= bound).all():
            return Result(x, -1, it)
        d = m(r)
        for q, aq, qaq in kept:
            d = d - _ratio((d * aq).sum(axis=0), qaq) * q
        ad = a(d)
        dad = (d * ad).sum(axis=0)
        alpha = _ratio((d * r).sum(axis=0), dad)
        x, r = x + alpha * d, r - alpha * ad
        if len(kept) >= len(b):  # they span the space: start over
            kept.clear()
        kept.append((d, ad, dad))
        p_.log.append(float(np.linalg.norm(r)))
    return Result(x, -6, p_.iter_lim)


class Tall:
    """Vectors of height m as columns of a DataFrame beside the rows of A: `u` holds k values a row.  Sparse rows are written once as packed blocks."""

    def __init__(self, rows: DataFrame, target: str):
        self.rows, self.n = rows, width_of(rows)
        kind = dict(rows.dtypes)[target]
        u = F.col(target) if kind.startswith("array") else F.array(F.col(target).cast("double"))
        self.frame = rows.select(*parts_of(rows), F.transform(u, lambda v: v.cast("double")).alias("u"))
        self.k = self.frame.select(F.size("u")).first()[0]
        if is_sparse(rows):
            self.frame = written(sparse.packed(self.frame, "u"), "packed-rows")

    @staticmethod
    def blocks(b) -> Iterator[tuple]:
        """Rows of A in a batch, and their u."""
        return sparse.unpacked(b) if "beside" in b.schema.names else iter([(features(b), block(b["u"]))])

    def transposed(self, weights: np.ndarray) -> np.ndarray:
        """A' u, and the squared norm of each column of u in a last row; u is divided by weights first."""

        def part(b):
            return sum(np.vstack([a.T @ (v := u / weights), (v * v).sum(axis=0)]) for a, u in Tall.blocks(b))

        return reduce_blocks(self.frame, part, (self.n + 1, self.k))

    def step(self, d: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A'A d, A'(u - A x) and the squared norm of each column of u - A x, in one pass."""
        shared = self.rows.sparkSession.sparkContext.broadcast((d, x))

        def part(b):
            d, x = shared.value
            out = 0
            for a, u in Tall.blocks(b):
                left = u - a @ x
                out = out + np.vstack([a.T @ (a @ d), a.T @ left, (left * left).sum(axis=0)])
            return out

        out = reduce_blocks(self.frame, part, (2 * self.n + 1, self.k))
        shared.unpersist()
        return out[: self.n], out[self.n : -1], out[-1]


class _Same:
    """The identity matrix, of which nothing is stored."""

    def __init__(self, n: int):
        self.shape, self.T = (n, n), self

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return v


def lsqr(rows: DataFrame, target: str, params: Params | None = None, precondition: np.ndarray | None = None) -> Result:
    """min |A x - b| for several right sides, x = N y for a right preconditioner N.

    The iterates are LSQR's, in the conjugate-gradient form of least squares: only n-vectors are carried, and each step is
    one pass over the rows.  The pass that applies A'A to the direction also makes the gradient A'(b - A x) and the
    residual's norm anew from the rows, so that rounding does not build up.  The recursion's coefficients are the
    Lanczos matrix of A'A, whose extreme eigenvalues tell the condition.  Codes: 0 zero gradient, -2 small gradient,
    -3 small residual, -4 ill-conditioned (over 1 / eps), -5 stagnation, -6 iteration limit.
    """
    p_ = params or Params()
    tall = Tall(rows, target)
    start = tall.transposed(np.ones(tall.k))
    bb = start[-1]
    n_ = _Same(tall.n) if precondition is None else precondition
    s = n_.T @ start[:-1]
    first = np.linalg.norm(s, axis=0)
    if not first.any():
        return Result(np.zeros((tall.n, tall.k)), 0, 0)
    y, d, still = np.zeros((n_.shape[1], tall.k)), s.copy(), 0
    diagonal, beside = [], []
    carry = np.zeros(tall.k)
    for it in range(p_.iter_lim):
        z, exact, left = tall.step(n_ @ d, n_ @ y)
        if (left <= (EPS * np.sqrt(bb)) ** 2).all():
            return Result(n_ @ y, -3, it)
        z, exact = n_.T @ z, n_.T @ exact
        gamma = (exact * exact).sum(axis=0)
        alpha = _ratio((d * exact).sum(axis=0), (d * z).sum(axis=0))
        step = alpha * d
        y, s = y + step, exact - alpha * z
        new = (s * s).sum(axis=0)
        beta = _ratio(new, gamma)
        inverse = _ratio(np.ones_like(alpha), alpha)
        diagonal.append(inverse + carry)
        beside.append(np.sqrt(beta) * inverse)
        carry = beta * inverse
        p_.log.append(float(np.sqrt(new).max()))
        if (np.sqrt(new) < p_.tolerance * first).all():
            return Result(n_ @ y, -2, it + 1)
        lanczos = np.linalg.eigvalsh(np.diag([x[0] for x in diagonal]) + np.diag([x[0] for x in beside[:-1]], 1) + np.diag([x[0] for x in beside[:-1]], -1))
        if lanczos[0] > 0 and math.sqrt(lanczos[-1] / lanczos[0]) > 1 / EPS:
            return Result(n_ @ y, -4, it + 1)
        still = still + 1 if (np.linalg.norm(step, axis=0) <= EPS * np.linalg.norm(y, axis=0)).all() else 0
        if still == 3:
            return Result(n_ @ y, -5, it + 1)
        d = s + beta * d
    return Result(n_ @ y, -6, p_.iter_lim)


def chebyshev_ls(rows: DataFrame, target: str, sigma_low: float, sigma_high: float, tolerance: float = 1e-14, precondition: np.ndarray | None = None) -> Result:
    """Chebyshev semi-iteration for least squares: singular values in [sigma_low, sigma_high], a fixed number of steps."""
    steps = max(1, int((math.log(tolerance) - math.log(2)) / math.log((sigma_high - sigma_low) / (sigma_high + sigma_low))) + 1) if sigma_high > sigma_low else 1
    d, c = (sigma_high**2 + sigma_low**2) / 2, (sigma_high**2 - sigma_low**2) / 2
    tall, normal = Tall(rows, target), NormalOperator(rows)
    n_ = _Same(tall.n) if precondition is None else precondition
    atb = n_.T @ tall.transposed(np.ones(tall.k))[:-1]
    y = np.zeros((n_.shape[1], tall.k))
    r, p, alpha = atb.copy(), np.zeros_like(y), 0.0
    for it in range(steps):
        beta = 0.0 if it == 0 else 0.5 * (c / d) ** 2 if it == 1 else (alpha * c / 2) ** 2
        alpha = 1 / d if it == 0 else d / (d * d - c * c / 2) if it == 1 else 1 / (d - alpha * c * c / 4)
        p = r + beta * p
        y = y + alpha * p
        r = atb - n_.T @ normal(n_ @ y)
    return Result(n_ @ y, -1, steps)


def block_gauss_seidel(a: np.ndarray, b: np.ndarray, sweeps: int = 10, seed: int = 0, tolerance: float = 1e-3, x0: np.ndarray | None = None) -> Result:
    """Randomised Gauss-Seidel for a symmetric positive definite matrix: n random coordinate steps a sweep.

    The coordinates of a sweep come from the seed; nothing races, so equal seeds give equal results.
    """
    if a.shape[0] != a.shape[1] or not np.allclose(a, a.T):
        raise ValueError("the matrix must be symmetric")
    n, b = len(a), np.atleast_2d(b.T).T
    diag = np.where(np.diag(a) == 0, 1.0, np.diag(a))
    x, ctx = np.zeros_like(b) if x0 is None else x0.copy(), Context(seed)
    norm = np.linalg.norm(b)
    for s in range(sweeps):
        for i in ctx.integers(n, ctx.allocate(n), np.arange(n)):
            x[i] += (b[i] - a[i] @ x) / diag[i]
        if np.linalg.norm(b - a @ x) <= tolerance * norm:
            return Result(x, -1, s + 1)
    return Result(x, -6, sweeps)


def async_fcg(a: np.ndarray, b: np.ndarray, params: Params | None = None, sweeps: int = 2, seed: int = 0) -> Result:
    """Flexible CG whose preconditioner is a few Gauss-Seidel sweeps."""
    return flexible_cg(lambda v: a @ v, b, params, lambda r: block_gauss_seidel(a, r, sweeps, seed, 0.0).x)


def triangular_inverse(r: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return lambda v: np.linalg.solve(r, v)


def dense_preconditioner(m: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return lambda v: m @ v
