"""Linear least squares: exact, iterative, sketched and preconditioned by a sketch.

Rows are a RowDF with a target column (a number or an array).  Solutions are features x targets arrays.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from . import krylov, sketch
from .matrix import features, gram, is_sparse, parts_of, reduce_blocks, to_numpy, tsqr, width_of


@dataclass(frozen=True)
class Problem:
    """What a solver is asked for; linear, l2, none is what solvers here take."""

    rows: DataFrame
    target: str
    kind: str = "linear"
    penalty: str = "l2"
    regularization: str = "none"

    def __post_init__(self):
        if (self.kind, self.penalty, self.regularization) != ("linear", "l2", "none"):
            raise NotImplementedError(f"no solver for {self.kind}, {self.penalty}, {self.regularization}")


def _array(rows: DataFrame, target: str):
    return F.col(target) if dict(rows.dtypes)[target].startswith("array") else F.array(F.col(target).cast("double"))


def _moments(rows: DataFrame, target: str) -> tuple[np.ndarray, np.ndarray]:
    return gram(rows.select(*parts_of(rows))), gram(rows, target)


def normal_equations(rows: DataFrame, target: str) -> np.ndarray:
    """(A'A) x = A'b: one pass each; fast, squares the condition number."""
    a, b = _moments(rows, target)
    return np.linalg.solve(a, b)


def semi_normal(rows: DataFrame, target: str) -> np.ndarray:
    """R'R x = A'b with R from TSQR."""
    _, r = tsqr(rows)
    return np.linalg.solve(r, np.linalg.solve(r.T, gram(rows, target)))


def exact_qr(rows: DataFrame, target: str) -> np.ndarray:
    """R x = Q'b with a distributed Q."""
    q, r = tsqr(rows)
    return np.linalg.solve(r, gram(q.select("features", target), target))


def exact_svd(rows: DataFrame, target: str, rcond: float = 1e-12) -> np.ndarray:
    """Pseudo-inverse by the SVD of R; directions under rcond are left out."""
    q, r = tsqr(rows)
    u, s, vt = np.linalg.svd(r)
    keep = s > rcond * max(s.max(initial=0), 1e-300)
    return vt[keep].T @ ((u.T @ gram(q.select("features", target), target))[keep] / s[keep][:, None])


def ridge(rows: DataFrame, target: str, lam: float, params: krylov.Params | None = None) -> np.ndarray:
    """(A'A + lambda I) x = A'b by conjugate gradients, scaled by its diagonal: a pass over the rows for each step, no square matrix."""
    n = width_of(rows)
    frame = rows.select(*parts_of(rows), _array(rows, target).alias("t"))
    k = frame.select(F.size("t")).first()[0]

    def part(b):
        x = features(b)
        own = (x**2).sum(axis=0) if isinstance(x, np.ndarray) else np.bincount(x.at, weights=x.v**2, minlength=n)
        return np.concatenate([x.T @ b["t"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), own[:, None]], axis=1)

    both = reduce_blocks(frame, part, (n, k + 1))
    scale = both[:, -1:] + lam
    scale[scale == 0] = 1.0
    return krylov.cg(krylov.NormalOperator(rows, lam), both[:, :-1], params or krylov.Params(1e-12, 10 * min(n, 1000)), lambda r: r / scale).x


def iterative(rows: DataFrame, target: str, params: krylov.Params | None = None) -> np.ndarray:
    return krylov.lsqr(rows, target, params).x


def _sketched(rows: DataFrame, target: str | None, transform: sketch.Sketch) -> tuple[np.ndarray, np.ndarray | None]:
    """S A and S b in one pass: the target stands as further columns beside the features."""
    d = width_of(rows)
    if target is None:
        return to_numpy(transform.apply(rows.select("row_id", *parts_of(rows)), "columnwise")), None
    if is_sparse(rows):
        b = _array(rows, target)
        k = rows.select(F.size(b)).first()[0]
        wide = rows.select("row_id", (F.col("size") + k).alias("size"), F.concat("indices", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.col("size") + i)).alias("indices"), F.concat("values", F.transform(b, lambda x: x.cast("double"))).alias("values"))
        both = to_numpy(transform.apply(wide, "columnwise"))
        return both[:, :d], both[:, d:]
    b = F.col(target) if dict(rows.dtypes)[target].startswith("array") else F.array(F.col(target).cast("double"))
    both = to_numpy(transform.apply(rows.select("row_id", F.concat("features", b).alias("features")), "columnwise"))
    return both[:, :d], both[:, d:]


def _height(rows: DataFrame) -> int:
    return (rows.agg(F.max("row_id")).first()[0] or 0) + 1


def sketch_and_solve(rows: DataFrame, target: str, S: int | None = None, kind: str = "CWT", seed: int = 0, stream: str = "threefry") -> np.ndarray:
    """min |S A x - S b|; row ids are the places that are sketched."""
    sa, sb = _sketched(rows, target, sketch.create(kind, _height(rows), S or 4 * width_of(rows), seed=seed, stream=stream))
    return np.linalg.lstsq(sa, sb, rcond=None)[0]


def condition(r: np.ndarray) -> float:
    """1-norm condition number of a triangle."""
    try:
        return float(np.abs(r).sum(axis=0).max() * np.abs(np.linalg.inv(r)).sum(axis=0).max())
    except np.linalg.LinAlgError:
        return math.inf


def blendenpik(rows: DataFrame, target: str, kind: str = "CWT", oversample: int = 4, seed: int = 0, params: krylov.Params | None = None, attempts: int = 3, worst: float = 1e14) -> np.ndarray:
    """LSQR preconditioned by R of a sketch's QR; a new sketch while R is too ill-conditioned, then the exact SVD solver.

    kind 'CWT' is the simplified form (one grouped sum), 'FJLT' mixes before it samples.
    """
    n = width_of(rows)
    for k in range(attempts):
        sa, _ = _sketched(rows, None, sketch.create(kind, _height(rows), oversample * n, seed=seed + k))
        r = np.linalg.qr(sa, mode="r")
        if r.shape[0] == n and condition(r) <= worst:
            return krylov.lsqr(rows, target, params, np.linalg.inv(r)).x
    return exact_svd(rows, target)


def lsrn(rows: DataFrame, target: str, oversample: int = 4, seed: int = 0, delta: float = 1e-6, params: krylov.Params | None = None) -> np.ndarray:
    """Gaussian sketch, preconditioner V / s; Chebyshev when its spectrum bounds are useful, else LSQR."""
    n = width_of(rows)
    t = oversample * n
    sa, _ = _sketched(rows, None, sketch.JLT(_height(rows), t, seed))
    _, s, vt = np.linalg.svd(sa, full_matrices=False)
    keep = s > 1e-12 * s.max()
    m = vt[keep].T / s[keep]
    alpha = math.sqrt(2 * math.log(2 / delta) / t)
    if alpha >= 1 - math.sqrt(n / t):
        return krylov.lsqr(rows, target, params, m).x
    high = math.sqrt(t) / ((1 - alpha) * math.sqrt(t) - math.sqrt(n))
    low = math.sqrt(t) / ((1 + alpha) * math.sqrt(t) + math.sqrt(n))
    return krylov.chebyshev_ls(rows, target, low, high, 1e-12, m).x


def approximate_least_squares(rows: DataFrame, target: str, seed: int = 0, stream: str = "threefry") -> np.ndarray:
    """Sketch-and-solve with a mixed and sampled sketch of 4 n rows."""
    return sketch_and_solve(rows, target, kind="FJLT", seed=seed, stream=stream)


def faster_least_squares(rows: DataFrame, target: str, seed: int = 0) -> np.ndarray:
    """High precision at the cost of a few passes."""
    return blendenpik(rows, target, kind="FJLT", seed=seed)


SOLVERS = {"normal": normal_equations, "semi_normal": semi_normal, "qr": exact_qr, "svd": exact_svd, "lsqr": iterative, "sketch": sketch_and_solve, "blendenpik": blendenpik, "lsrn": lsrn}


def solve(problem: Problem, method: str = "qr", **kw) -> np.ndarray:
    return SOLVERS[method](problem.rows, problem.target, **kw)


def residual(rows: DataFrame, target: str, x: np.ndarray) -> float:
    """|A x - b| over all rows and targets."""
    shared = rows.sparkSession.sparkContext.broadcast(x)

    def part(b):
        t = b["t"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        return np.array([[((features(b) @ shared.value - t) ** 2).sum()]])

    t = F.col(target) if dict(rows.dtypes)[target].startswith("array") else F.array(F.col(target).cast("double"))
    return math.sqrt(reduce_blocks(rows.select(*parts_of(rows), t.alias("t")), part, (1, 1))[0, 0])


def compare(rows: DataFrame, target: str, methods: list[str] | None = None) -> list[tuple[str, float, float]]:
    """(solver, seconds, residual) of every solver on the same rows, which are written once for all their passes."""
    rows, out = written(rows.select("row_id", *parts_of(rows), target), "compared"), []
    for name in methods or SOLVERS:
        began = time.perf_counter()
        x = SOLVERS[name](rows, target)
        out.append((name, time.perf_counter() - began, residual(rows, target, x)))
    return out
