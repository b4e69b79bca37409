"""Kernel ridge regression and regularised least-squares classification, five ways each.

Rows are a RowDF with a target column.  The models of `kernel_ridge` and `faster_kernel_ridge` are the rows themselves with
coefficients, so the driver holds the rows (SUPPORT bytes at most).  Up to GRAM_ROWS rows it also holds their Gram matrix; beyond,
products with that matrix are made on executors, block by block and anew each time.  The other solvers see the rows
only through passes that sum s x s moments.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import drop, written
from . import krylov, pairs, sketch
from .coding import dummy_coding, label_order
from .kernels import Gaussian, Kernel
from .matrix import as_lists, block, features, map_rows, parts_of, reduce_blocks, to_numpy, width_of
from .models import FeatureModel, KernelModel

#: Rows up to which a Gram matrix is formed on the driver (8,000 squared doubles are 0.5 GB); bytes of rows that a kernel model holds.
GRAM_ROWS, SUPPORT = 8_000, 2 << 30
#: Rows and columns of a block of the Gram matrix that a task makes at a time.
TALL, WIDE = 256, 8192
#: Numbers of a preconditioner's features that the driver keeps.
HELD = 1 << 24
#: Rows that a preconditioner sees the kernel through at most; what steps with values in single precision may lower a residual to.
LANDMARKS, SINGLE = 2048, 1e-5


@dataclass(frozen=True)
class KRRParams:
    tolerance: float = 1e-3
    iter_lim: int = 1000
    seed: int = 0
    feature_kind: str = "regular"
    max_split: int = 0
    sketch_rows: bool = False
    sketch_kind: str = "CWT"
    stream: str = "threefry"


def _support(rows: DataFrame, target: str) -> tuple[np.ndarray, np.ndarray]:
    """All rows and targets in row_id order, the support of a kernel model; its size is checked first."""
    d, n = width_of(rows), rows.count()
    if 8 * n * (d or 1) > SUPPORT:
        raise ValueError(f"a kernel model of these rows takes {8 * n * d >> 20} MB, more than {SUPPORT >> 20}: use a feature-map solver")
    got = rows.select("row_id", "features", _array(rows, target).alias("t")).orderBy("row_id").toArrow().combine_chunks()
    return block(got["features"].combine_chunks()), block(got["t"].combine_chunks())


def gram_product(spark: SparkSession, kernel: Kernel, x: np.ndarray, shift: float):
    """v -> (K(x, x) + shift I) v for n x k blocks v: tasks make blocks of K and forget them."""
    sc = spark.sparkContext
    support = sc.broadcast(x) if kernel.exact_map(x[:1]) is None else None
    n, parts = len(x), max(1, min(-(-len(x) // TALL), 4 * sc.defaultParallelism))

    def product(v: np.ndarray) -> np.ndarray:
        if (z := kernel.exact_map(x)) is not None:
            return shift * v + z @ (z.T @ v)
        shared = sc.broadcast(v)

        def run(batches):
            x, v = support.value, shared.value
            for b in batches:
                for at in b["id"].to_pylist():
                    some = x[at : at + TALL]
                    made = sum(kernel.block(some, x[j : j + WIDE]) @ v[j : j + WIDE] for j in range(0, len(x), WIDE))
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([np.ascontiguousarray(made).tobytes()], pa.binary())], names=["at", "made"])

        out = shift * v
        for at, raw in spark.range(0, n, TALL, parts).mapInArrow(run, "at long, made binary").collect():
            out[at : at + TALL] += np.frombuffer(raw).reshape(-1, v.shape[1])
        shared.unpersist()
        return out

    return product


def _array(rows: DataFrame, target: str):
    return F.col(target) if dict(rows.dtypes)[target].startswith("array") else F.array(F.col(target).cast("double"))


def kernel_ridge(rows: DataFrame, target: str, kernel: Kernel, lam: float, s: int = 512) -> KernelModel:
    """(K + lambda I) a = y, by a Cholesky factor; beyond GRAM_ROWS rows by conjugate gradients to a relative residual of 1e-12
    with s random features as preconditioner (where the kernel has such, else none).  A kernel with an exact map z of few columns is solved by
    the square of z: a = (y - z w) / lambda with (z'z + lambda I) w = z'y."""
    x, y = _support(rows, target)
    if (z := kernel.exact_map(x)) is not None and z.shape[1] < len(x):
        return KernelModel(kernel, x, (y - z @ _ridge(z.T @ z, z.T @ y, lam)) / lam)
    if len(x) > GRAM_ROWS:
        try:
            near = _woodbury(kernel.features(s, "regular", 0).map_block, x, lam)
        except ValueError:
            near = None
        product = gram_product(rows.sparkSession, kernel, x, lam)
        return KernelModel(kernel, x, krylov.cg(product, y, krylov.Params(1e-12, 10 * len(x)), near).x)
    l = np.linalg.cholesky(kernel.block(x, x) + lam * np.eye(len(x)))  # noqa: E741
    return KernelModel(kernel, x, np.linalg.solve(l.T, np.linalg.solve(l, y)))


def _woodbury(z, x: np.ndarray, lam: float):
    """r -> (lambda I + Z Z')^-1 r for the features Z = z(x) of n rows, which are made anew by WIDE rows where they are many."""
    if len(x) * z(x[:1]).shape[1] <= HELD:
        made = z(x)
        parts = lambda: [(0, made)]
    else:
        parts = lambda: ((at, z(x[at : at + WIDE])) for at in range(0, len(x), WIDE))
    inner = sum(f.T @ f for _, f in parts())
    inner = inner + lam * np.eye(len(inner))

    def solve(r: np.ndarray) -> np.ndarray:
        w = np.linalg.solve(inner, sum(f.T @ r[at : at + len(f)] for at, f in parts()))
        return (r - np.concatenate([f @ w for _, f in parts()])) / lam

    return solve


def _moments(rows: DataFrame, target: str, z) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'Y in one pass; z maps a block of features."""
    frame = rows.select(*parts_of(rows), _array(rows, target).alias("t"))
    k = frame.select(F.size("t")).first()[0]
    s = z(np.zeros((1, width_of(rows)))).shape[1]

    def part(b):
        f, t = z(features(b)), block(b["t"])
        return f.T @ np.concatenate([f, t], axis=1)

    both = reduce_blocks(frame, part, (s, s + k))
    return both[:, :s], both[:, s:]


def _row_sketched(rows: DataFrame, target: str, z, s: int, p: KRRParams) -> tuple[np.ndarray, np.ndarray]:
    """A sketch of the rows of (Z, Y) to 4 s rows."""
    frame = rows.select("row_id", *parts_of(rows), _array(rows, target).alias("t"))
    k = frame.select(F.size("t")).first()[0]

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b["row_id"], as_lists(np.concatenate([z(features(b)), block(b["t"])], axis=1))], names=["row_id", "features"])

    made = frame.mapInArrow(run, "row_id long, features array<double>")
    n = (rows.agg(F.max("row_id")).first()[0] or 0) + 1
    both = to_numpy(sketch.create(p.sketch_kind, n, 4 * s, seed=p.seed + 1).apply(made, "columnwise"))
    return both[:, :-k], both[:, -k:]


def _ridge(a: np.ndarray, b: np.ndarray, lam: float) -> np.ndarray:
    return np.linalg.solve(a + lam * np.eye(len(a)), b)


def approximate_kernel_ridge(rows: DataFrame, target: str, kernel: Kernel, lam: float, s: int, params: KRRParams | None = None) -> FeatureModel:
    """Ridge regression on s random features; with sketch_rows, on a sketch of the rows."""
    p = params or KRRParams()
    t = kernel.features(s, p.feature_kind, p.seed, stream=p.stream)
    if p.sketch_rows:
        z, y = _row_sketched(rows, target, t.map_block, s, p)
        return FeatureModel([t], [_ridge(z.T @ z, z.T @ y, lam)])
    return FeatureModel([t], [_ridge(*_moments(rows, target, t.map_block), lam)])


@dataclass(frozen=True)
class RowsModel:
    """K(x, support) coefficients where support rows and their coefficients (row_id, features, coefficients) stay a table."""

    kernel: Kernel
    support: DataFrame
    labels: list | None = None

    def scores(self, rows: DataFrame) -> DataFrame:
        """(row_id, features): the scores of each row; of the support itself, each value of the kernel is made once for both its rows."""
        return pairs.product(rows, None if rows is self.support else self.support, self.kernel.block, "coefficients")

    def predict(self, rows: DataFrame) -> DataFrame:
        """(row_id, prediction): a label, or the value (an array for several targets)."""
        out, scores = self.scores(rows), F.col("features")
        if self.labels is None:
            one = self.support.select(F.size("coefficients")).first()[0] == 1
            return out.select("row_id", (scores[0] if one else scores).alias("prediction"))
        return out.select("row_id", F.element_at(F.array(*[F.lit(x) for x in self.labels]), F.array_position("features", F.array_max("features")).cast("int")).alias("prediction"))


def _landmarks(rows: DataFrame, kernel: Kernel, count: int) -> tuple[int, Callable[[np.ndarray], np.ndarray]]:
    """Columns and map of Nystrom features: z(x).z(y) is the kernel as count rows (those with the smallest hash of their id) see it."""
    some = rows.orderBy(F.xxhash64("row_id"), "row_id").limit(count).select("features").toArrow().combine_chunks()
    x = block(some["features"].combine_chunks())
    values, vectors = np.linalg.eigh(kernel.block(x, x))
    kept = values > 1e-10 * max(values[-1], 0.0)
    shared = rows.sparkSession.sparkContext.broadcast((x, vectors[:, kept] / np.sqrt(values[kept])))
    return int(kept.sum()), lambda v: kernel.block(v, shared.value[0]) @ shared.value[1]


def kernel_ridge_rows(rows: DataFrame, target: str, kernel: Kernel, lam: float, s: int = 0, params: KRRParams | None = None) -> RowsModel:
    """(K + lambda I) a = y for any number of rows: conjugate gradients whose vectors stand beside the rows.

    A step is a product with K by pairs of tiles, and sums for the step's lengths.  The preconditioner is the Woodbury form of s random features,
    or without s of Nystrom features of LANDMARKS rows at most (a sixteenth of fewer rows): a pass that sums Z'r and a map.  Steps take
    values of K in single precision; their residual is then made anew in double precision, and that is what has to be small, else
    steps go on from there (in double precision, if single does no longer halve it).  Nothing as long as the rows is on the driver or in one task.
    """
    p = params or KRRParams(tolerance=1e-10)
    state = rows.select("row_id", "features", F.transform(_array(rows, target), lambda x: x.cast("double")).alias("y"))
    state = written(state.withColumn("a", F.transform("y", lambda _: F.lit(0.0))).withColumn("r", F.col("y")), "ridge-state")
    k, tiles = state.select(F.size("y")).first()[0], pairs.tiles_of(state)
    s, z = (s, kernel.features(s, p.feature_kind, p.seed, stream=p.stream).map_block) if s else _landmarks(state, kernel, min(LANDMARKS, -(-state.count() // 16)))
    inner = lam * np.eye(s) + reduce_blocks(state.select("features"), lambda b: (f := z(block(b["features"]))).T @ f, (s, s))

    def over(df: DataFrame, fn, *names: str) -> DataFrame:
        """df with the array columns names made anew by fn(batch)."""
        kept = [c for c in df.columns if c not in names]
        schema = df.select(*kept, *[F.array(F.lit(0.0)).alias(c) for c in names]).schema

        def run(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([*[b[c] for c in kept], *map(as_lists, fn(b))], names=[*kept, *names])

        return df.mapInArrow(run, schema)

    def dots(df: DataFrame, left: str, right: str) -> np.ndarray:
        return reduce_blocks(df.select(*{left, right}), lambda b: (block(b[left]) * block(b[right])).sum(axis=0)[None], (1, k))[0]

    def times(df: DataFrame, column: str, single: bool) -> DataFrame:
        """df with q, K times a column."""
        fn = (lambda u, v: kernel.block(u.astype(np.float32), v.astype(np.float32))) if single else kernel.block
        return df.join(pairs.product(df.select("row_id", "features", F.col(column).alias("beside")), None, fn, "beside", parts=tiles).withColumnRenamed("features", "q"), "row_id")

    def lengths(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Squared lengths of r, products of r with the preconditioned residual (r - Z w) / lambda, and w."""
        made = reduce_blocks(df.select("features", "r"), lambda b: np.vstack([z(block(b["features"])).T @ (r := block(b["r"])), (r * r).sum(axis=0)]), (s + 1, k))
        w = np.linalg.solve(inner, made[:-1])
        return made[-1], (made[-1] - (made[:-1] * w).sum(axis=0)) / lam, w

    def turned(df: DataFrame, w: np.ndarray, beta: np.ndarray | None = None) -> DataFrame:
        """df, written, with the next direction p."""
        def made(b):
            fresh = (block(b["r"]) - z(block(b["features"])) @ w) / lam
            return [fresh if beta is None else fresh + beta * block(b["p"])]

        return written(over(df, made, "p"), "ridge-state")

    square, rho, w = lengths(state)
    bound, start, single = p.tolerance**2 * square, square, True
    state = turned(state, w)
    for _ in range(p.iter_lim):
        if (square <= bound).all():
            break
        moved = written(over(times(state, "p", single), lambda b: [block(b["q"]) + lam * block(b["p"])], "q"), "ridge-product")
        alpha = krylov._ratio(rho, dots(moved, "p", "q"))
        step = over(moved, lambda b, alpha=alpha: [block(b["a"]) + alpha * block(b["p"]), block(b["r"]) - alpha * block(b["q"])], "a", "r").drop("q")
        square, fresh, w = lengths(step)
        if (square <= np.maximum(bound / 4, SINGLE**2 * start)).all():  # what is left is made anew
            last = written(step, "ridge-step")
            step = over(times(last, "a", False), lambda b: [block(b["y"]) - block(b["q"]) - lam * block(b["a"])], "r").drop("q")
            step = written(step, "ridge-step")
            drop(last)
            square, rho, w = lengths(step)
            single = single and bool((square <= start / 4).all())
            start, new = square, turned(step, w)
        else:
            new, rho = turned(step, w, krylov._ratio(fresh, rho)), fresh
        for done in (state, moved):
            drop(done)
        state = new
    return RowsModel(kernel, state.select("row_id", "features", F.col("a").alias("coefficients")))


def _splits(s: int, d: int, max_split: int) -> list[int]:
    """Sizes of feature blocks: d wide, or half of max_split; the last takes what is left, up to twice that."""
    size = min(s, d if not max_split else max(1, max_split // 2))
    n = max(1, s // size)
    return [size] * (n - 1) + [s - size * (n - 1)]


def _maps(kernel: Kernel, s: int, d: int, p: KRRParams) -> list[sketch.Sketch]:
    return [kernel.features(n, p.feature_kind, p.seed + 1000 * j, stream=p.stream) for j, n in enumerate(_splits(s, d, p.max_split))]


def sketched_kernel_ridge(rows: DataFrame, target: str, kernel: Kernel, lam: float, s: int, params: KRRParams | None = None) -> FeatureModel:
    """Features in splits, each scaled by sqrt(s_j / s), and the rows sketched."""
    p = params or KRRParams()
    maps = _maps(kernel, s, kernel.N, p)
    model = FeatureModel(maps, [np.zeros((m.S, 1)) for m in maps], scaled=True)
    every = lambda x: np.concatenate([model.features(j, x) for j in range(len(maps))], axis=1)
    z, y = _row_sketched(rows, target, every, s, p)
    w = _ridge(z.T @ z, z.T @ y, lam)
    model.weights = np.split(w, np.cumsum([m.S for m in maps])[:-1])
    return model


def faster_kernel_ridge(rows: DataFrame, target: str, kernel: Kernel, lam: float, s: int, params: KRRParams | None = None) -> KernelModel:
    """CG on K + lambda I, preconditioned by (lambda I + Z Z')^-1 of s random features (Woodbury)."""
    p = params or KRRParams()
    x, y = _support(rows, target)
    if len(x) > GRAM_ROWS or kernel.exact_map(x[:1]) is not None:
        product = gram_product(rows.sparkSession, kernel, x, lam)
    else:
        k = kernel.block(x, x) + lam * np.eye(len(x))
        product = lambda v: k @ v
    z = kernel.features(s, p.feature_kind, p.seed, stream=p.stream).map_block
    return KernelModel(kernel, x, krylov.cg(product, y, krylov.Params(p.tolerance, p.iter_lim), _woodbury(z, x, lam)).x)


def large_scale_kernel_ridge(rows: DataFrame, target: str, kernel: Kernel, lam: float, s: int, params: KRRParams | None = None) -> FeatureModel:
    """Block coordinate descent over feature splits: a pass over the rows for each block and sweep.

    The residual is made again from the current weights inside the pass, so no state is kept with the rows.
    """
    p = params or KRRParams(tolerance=1e-1, iter_lim=20)
    maps = _maps(kernel, s, kernel.N, p)
    frame = rows.select(*parts_of(rows), _array(rows, target).alias("t")).persist()
    k = frame.select(F.size("t")).first()[0]
    model = FeatureModel(maps, [np.zeros((m.S, k)) for m in maps], scaled=True)
    factors: list[np.ndarray | None] = [None] * len(maps)
    sc = rows.sparkSession.sparkContext
    try:
        for _ in range(p.iter_lim):
            moved = 0.0
            for j, m in enumerate(maps):
                shared = sc.broadcast(model)

                def part(b, j=j, shared=shared, first=factors[j] is None):
                    x = features(b)
                    z = shared.value.features(j, x)
                    zr = z.T @ (block(b["t"]) - shared.value.decision(x))
                    return np.concatenate([z.T @ z, zr], axis=1) if first else zr

                got = reduce_blocks(frame, part, (m.S, k + (m.S if factors[j] is None else 0)))
                if factors[j] is None:
                    factors[j], got = np.linalg.cholesky(got[:, : m.S] + lam * np.eye(m.S)), got[:, m.S :]
                rhs = got - lam * model.weights[j]
                delta = np.linalg.solve(factors[j].T, np.linalg.solve(factors[j], rhs))
                model.weights[j] = model.weights[j] + delta
                moved += float((delta**2).sum())
                shared.unpersist()
            size = math.sqrt(sum(float((w**2).sum()) for w in model.weights))
            if math.sqrt(moved) < p.tolerance * max(size, 1e-300):
                break
    finally:
        frame.unpersist()
    return model


SOLVERS = {"exact": kernel_ridge, "approximate": approximate_kernel_ridge, "sketched": sketched_kernel_ridge, "faster": faster_kernel_ridge, "large": large_scale_kernel_ridge}


def rlsc(rows: DataFrame, label: str, kernel: Kernel, lam: float, method: str = "exact", **kw):
    """Classification: one +1/-1 target for each label, then any of the solvers."""
    labels = label_order(rows, label, "row_id")
    coded = rows.withColumn("target", dummy_coding(label, labels))
    model = SOLVERS[method](coded, "target", kernel, lam, **kw)
    model.labels = labels
    return model


def rls(rows: DataFrame, label: str, sigma: float = 1.0, lam: float = 1e-3) -> KernelModel:
    """Regularised least squares with a Gaussian kernel."""
    return rlsc(rows, label, Gaussian(width_of(rows), sigma), lam)


def sketch_rls(rows: DataFrame, label: str, sigma: float = 1.0, lam: float = 1e-3, s: int = 100, seed: int = 0, stream: str = "threefry") -> FeatureModel:
    """Regularised least squares on random features of a Gaussian kernel."""
    return rlsc(rows, label, Gaussian(width_of(rows), sigma), lam, "approximate", s=s, params=KRRParams(seed=seed, stream=stream))


def nystrom_rls(rows: DataFrame, label: str, sigma: float = 1.0, lam: float = 1e-3, s: int = 100, seed: int = 0, probabilities: str = "uniform") -> KernelModel:
    """Landmarks drawn uniformly, or with replacement with probabilities by ridge leverage: the scores of all rows against a uniform
    pool of 4 s rows, one pass.  Normal equations of K(X, landmarks) in one pass."""
    from ..functions import rng

    kernel = Gaussian(width_of(rows), sigma)
    pool = [r[0] for r in rows.orderBy(rng.word(seed, F.col("row_id")), "row_id").limit(s if probabilities == "uniform" else 4 * s).select("features").collect()]
    x = np.array(pool, float)
    if probabilities == "leverage":
        shift = lam * rows.count()
        inverse = np.linalg.inv(kernel.block(x, x) + shift * np.eye(len(x)))

        def leverage(v: np.ndarray) -> np.ndarray:
            k = kernel.block(v, x)
            return (np.maximum(1.0 - np.einsum("ij,ji->i", k, inverse @ k.T), 0.0) / shift)[:, None]

        scored = map_rows(rows.select("row_id", "features"), leverage).select("row_id", F.col("features")[0].alias("leverage"))
        drawn = sketch.weighted_sample(scored, "row_id", "leverage", s, seed).select(F.col("key").alias("row_id")).distinct()
        x = np.array([r[0] for r in rows.join(F.broadcast(drawn), "row_id").orderBy("row_id").select("features").collect()], float)
    labels = label_order(rows, label, "row_id")
    coded = rows.withColumn("target", dummy_coding(label, labels))
    a, b = _moments(coded, "target", lambda v: kernel.block(v, x))
    w = np.linalg.lstsq(a + lam * kernel.block(x, x) + 1e-10 * np.eye(len(x)), b, rcond=None)[0]
    return KernelModel(kernel, x, w, labels=labels)


def sketch_pcr(rows: DataFrame, label: str, rank: int, sigma: float = 1.0, s: int = 100, seed: int = 0, stream: str = "threefry") -> FeatureModel:
    """Principal component regression on random features: least squares within the leading eigenspace of Z'Z."""
    kernel = Gaussian(width_of(rows), sigma)
    labels = label_order(rows, label, "row_id")
    t = kernel.features(s, "regular", seed, stream=stream)
    a, b = _moments(rows.withColumn("target", dummy_coding(label, labels)), "target", t.map_block)
    values, vectors = np.linalg.eigh(a)
    v = vectors[:, np.argsort(-values)[:rank]]
    return FeatureModel([t], [v @ np.linalg.solve(v.T @ a @ v, v.T @ b)], labels=labels)
