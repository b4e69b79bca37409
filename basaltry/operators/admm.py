"""Regularised learning by ADMM with features in blocks: the graph form (Parikh and Boyd 2014), shared between blocks.

With features Z = (Z_1, ..., Z_N) the problem is to minimise loss(sum o_j) + lambda sum penalty(w_j) over o_j = Z_j w_j.  Blocks of
features agree with each other on the rows' outputs alone.  An iteration is, with duals r_j and s_j,

    penalties   p_j = prox of the penalty at w_j - r_j
    loss        c_j = a_j + d for a_j = o_j - s_j, where d moves their sum to the prox of the loss:  d = (prox(sum a_j) - sum a_j) / N
    graphs      (w_j, o_j) = the point of the graph o_j = Z_j w_j nearest to (p_j + r_j, c_j + s_j)
    duals       r_j = r_j + p_j - w_j,  s_j = s_j + c_j - o_j

As c_j + s_j is the last o_j plus d, a graph step is w_j + (I + Z_j'Z_j)^-1 (p_j + r_j - w_j + Z_j'd): a block needs the inverse of its own square
matrix and the sum Z'd over rows, one pass for all blocks.  And as s_j is then the last o_j plus d less the new one, the sum of a_j is
2 Z w - (the last Z w) - N d: all of a row's own follows from the weights so far.  Squares are added up and inverted by block on
executors, and stay there if they are large; weights, of which there are as many as features, are all that the driver holds.

So rows carry no state: a pass takes the latest weights as a broadcast and runs the row's part of the recursion anew.  So that this
does not grow with the iterations, every EPOCH of them the rows' Z w and d are written beside the rows, and the recursion goes on from there.
Nothing depends on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import fresh_path, remove, written
from .coding import accuracy, relative_error
from .kernels import Kernel
from .losses import LOSSES, REGULARIZERS, Loss
from .matrix import GROUPS, as_lists, block, features, parts_of, reduce_blocks, width_of
from .models import FeatureModel
from .sparse import CSR, dense

#: Iterations whose weights a pass goes through again.
EPOCH = 32
#: Features of a block where their number is not asked for; numbers of squares that a task adds up in one pass, and up to which inverses
#: come to the driver; numbers of a piece of Z.
WIDTH, SQUARES, PIECE = 1024, 1 << 23, 1 << 22


@dataclass(frozen=True)
class ADMMParams:
    """feature_blocks: blocks that features are dealt in, each with a factor (and a feature map and its seed) of its own; None: as
    many as WIDTH allows."""

    loss: str = "squared"
    regularizer: str = "l2"
    lam: float = 0.01
    rho: float = 1.0
    iterations: int = 20
    feature_blocks: int | None = 1
    scaled: bool = True
    seed: int = 12345
    tolerance: float | None = None


class _Parts:
    """Features of a model in pieces of rows, and the bounds of their blocks."""

    def __init__(self, model: FeatureModel, bounds: list[tuple[int, int]]):
        self.model, self.bounds = model, bounds

    def pieces(self, x: np.ndarray | CSR) -> Iterator[tuple[slice, np.ndarray | CSR]]:
        total = self.bounds[-1][1]
        if isinstance(x, CSR) and not self.model.maps:
            yield slice(0, len(x)), x
            return
        step = max(1, PIECE // total)
        for at in range(0, len(x), step):
            part = x.part(at, min(at + step, len(x))) if isinstance(x, CSR) else x[at : at + step]
            z = [self.model.features(j, part) for j in range(len(self.model.maps))] or [part]
            yield slice(at, at + len(part)), z[0] if len(z) == 1 else np.concatenate(z, axis=1)

    def columns(self, z: np.ndarray | CSR, j: int) -> np.ndarray:
        """Block j of a piece, dense."""
        a, b = self.bounds[j]
        if not isinstance(z, CSR):
            return z[:, a:b]
        kept = (z.at >= a) & (z.at < b)
        return dense(CSR(np.concatenate([[0], np.cumsum(np.bincount(z.rows[kept], minlength=len(z)))]), z.at[kept] - a, z.v[kept], b - a))


def _inverses(frame: DataFrame, parts, bounds: list[tuple[int, int]]) -> DataFrame:
    """(block, inverse): (I + Z_j'Z_j)^-1 of each block, made on executors; parts: a broadcast of _Parts.

    A pass over the rows adds up the squares of so many blocks as SQUARES allows; tasks' sums meet in GROUPS groups, then by block.
    """
    out, first = None, 0
    schema = "block int, place int, part binary"

    def add(batches: Iterator[pa.RecordBatch], last: bool = False) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for j, raw in zip(b["block"].to_pylist(), b["part"].to_pylist(), strict=True):
                x = np.frombuffer(raw)
                sums[j] = sums[j] + x if j in sums else x
        for j, x in sums.items():
            if last:
                size = bounds[j][1] - bounds[j][0]
                x = np.linalg.inv(np.eye(size) + x.reshape(size, size))
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([0], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "place", "part"])

    while first < len(bounds):
        last, size = first, 0
        while last < len(bounds) and (last == first or size + (bounds[last][1] - bounds[last][0]) ** 2 <= SQUARES):
            size += (bounds[last][1] - bounds[last][0]) ** 2
            last += 1

        def squares(batches: Iterator[pa.RecordBatch], some: range = range(first, last)) -> Iterator[pa.RecordBatch]:
            p, sums = parts.value, {}
            for b in batches:
                for _, z in p.pieces(features(b)) if b.num_rows else ():
                    for j in some:
                        x = p.columns(z, j)
                        sums[j] = sums[j] + x.T @ x if j in sums else x.T @ x
            place = TaskContext.get().partitionId()
            for j, x in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([place], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "place", "part"])

        made = frame.mapInArrow(squares, schema).repartition("block", F.col("place") % GROUPS).mapInArrow(add, schema)
        made = written(made.repartition("block").mapInArrow(lambda batches: add(batches, True), schema).select("block", F.col("part").alias("inverse")), "admm-inverses")
        out, first = made if out is None else out.unionByName(made), last
    return out


def _solver(inverses: DataFrame, bounds: list[tuple[int, int]]):
    """v -> the blocks' inverses times v: on the driver if they are few numbers, else where they are."""
    if sum((b - a) ** 2 for a, b in bounds) <= SQUARES:
        held = {j: np.frombuffer(raw).reshape(bounds[j][1] - bounds[j][0], -1) for j, raw in inverses.collect()}
        # without rows a square is zero
        return lambda v: np.concatenate([held[j] @ v[a:b] if j in held else v[a:b] for j, (a, b) in enumerate(bounds)])
    spark = inverses.sparkSession

    def solve(v: np.ndarray) -> np.ndarray:
        shared, out = spark.sparkContext.broadcast(v), v.copy()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for j, raw in zip(b["block"].to_pylist(), b["inverse"], strict=True):
                    first, last = bounds[j]
                    made = np.frombuffer(raw.as_buffer()).reshape(last - first, -1) @ shared.value[first:last]
                    yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([made.tobytes()], pa.binary())], names=["block", "made"])

        for j, raw in inverses.mapInArrow(run, "block int, made binary").collect():
            out[slice(*bounds[j])] = np.frombuffer(raw).reshape(-1, v.shape[1])
        shared.unpersist()
        return out

    return solve


def _unroll(outputs: np.ndarray, y: np.ndarray, state: np.ndarray, loss: Loss, step: float, blocks: int) -> np.ndarray:
    """The rows' state, their last Z w and d side by side, after iterations whose Z w stand side by side in outputs."""
    k = state.shape[1] // 2
    last, d = state[:, :k], state[:, k:]
    for t in range(0, outputs.shape[1], k):
        o = outputs[:, t : t + k]
        total = 2 * o - last - blocks * d
        last, d = o, (loss.prox(total, blocks * step, y) - total) / blocks
    return np.concatenate([last, d], axis=1)


def train(rows: DataFrame, label: str, kernel: Kernel | None, s: int, params: ADMMParams | None = None, labels: list | None = None, validation: DataFrame | None = None) -> tuple[FeatureModel, list]:
    """The model and the objective of the weights that each iteration began with; with validation rows pairs of
    the objective and the accuracy (without labels: the relative error) of those weights on them.

    label holds class numbers 0..k-1 (k > 2 or multinomial losses), +1/-1, or a real target.  s random features
    of the kernel; without a kernel the model is linear, and rows may be sparse.  tolerance ends the iterations when the objective
    changes by a smaller share.
    """
    p, spark = params or ADMMParams(), rows.sparkSession
    loss, penalty, d = LOSSES[p.loss](), REGULARIZERS[p.regularizer](), width_of(rows)
    k = len(labels) if labels is not None and len(labels) > 2 else 1
    total = s if kernel else d
    blocks = min(total, p.feature_blocks or -(-total // WIDTH))
    sizes = [len(part) for part in np.array_split(np.arange(total), blocks)]
    ends = np.cumsum(sizes).tolist()
    bounds = list(zip([0, *ends[:-1]], ends, strict=True))
    maps = [kernel.features(n, "regular", p.seed + 1000 * j) for j, n in enumerate(sizes)] if kernel else []
    model = FeatureModel(maps, [np.zeros((m.S, k)) for m in maps] or [np.zeros((d, k))], scaled=p.scaled and bool(maps), total=d, labels=labels)
    cuts = ends[:-1] if maps else []
    shared_parts = spark.sparkContext.broadcast(_Parts(model, bounds))
    frame = rows.select("row_id", *parts_of(rows), F.col(label).cast("double").alias("y")).withColumn("state", F.array_repeat(F.lit(0.0), 2 * k))
    solve = _solver(_inverses(frame.select(*parts_of(rows)), shared_parts, bounds), bounds)
    w, r = np.zeros((total, k)), np.zeros((total, k))
    since: list[np.ndarray] = []
    history: list = []
    state, before = None, None
    try:
        for it in range(p.iterations):
            since.append(w)
            shared = spark.sparkContext.broadcast(np.concatenate(since, axis=1))

            def gather(b, shared=shared):
                y, old = b["y"].to_numpy(zero_copy_only=False), block(b["state"])
                out = np.zeros((total + 1, k))
                for at, z in shared_parts.value.pieces(features(b)):
                    outputs = z @ shared.value
                    out[:-1] += z.T @ _unroll(outputs, y[at], old[at], loss, 1 / p.rho, blocks)[:, k:]
                    out[-1, 0] += loss.evaluate(outputs[:, -k:], y[at])
                return out

            got = reduce_blocks(frame, gather, (total + 1, k))
            model.weights = np.split(w, cuts)
            value = float(got[-1, 0]) + p.lam * penalty.evaluate(w)
            history.append(value if validation is None else (value, _measure(model, validation, label)))
            pull = penalty.prox(w, p.lam / p.rho, r) + r
            w = w + solve(pull - w + got[:-1])
            r = pull - w
            model.weights = np.split(w, cuts)
            if p.tolerance is not None and before is not None and abs(before - value) <= p.tolerance * abs(before):
                break
            before = value
            if len(since) == EPOCH and it + 1 < p.iterations:
                def advance(batches, shared=shared, names=tuple(frame.columns)):
                    for b in batches:
                        if b.num_rows:
                            y, old = b["y"].to_numpy(zero_copy_only=False), block(b["state"])
                            made = [_unroll(z @ shared.value, y[at], old[at], loss, 1 / p.rho, blocks) for at, z in shared_parts.value.pieces(features(b))]
                            yield pa.RecordBatch.from_arrays([*[b[c] for c in names[:-1]], as_lists(np.concatenate(made))], names=names)

                path = fresh_path(spark, "admm")
                frame.mapInArrow(advance, frame.schema).write.parquet(path)
                frame, since = spark.read.schema(frame.schema).parquet(path), []
                if state is not None:
                    remove(spark, state)
                state = path
            shared.unpersist()
    finally:
        if state is not None:
            remove(spark, state)
    return model, history


def _measure(model: FeatureModel, rows: DataFrame, label: str) -> float:
    out = model.predict(rows)
    return float((relative_error if model.labels is None else accuracy)(out, "prediction", label).first()[1])
