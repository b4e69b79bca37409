"""Matrices as DataFrames.

RowDF is (row_id, features: array<double>), a row of the matrix each, or in sparse form (row_id, size, indices, values); CoordDF is (i, j, v), zeros absent
and duplicates summed.  Small matrices (features x features, sketch x features) are numpy arrays on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sparse
from .sparse import CSR

# -- forms -----------------------------------------------------------------------------------------------


def row_df(df: DataFrame, id_col: str, columns: list[str] | str) -> DataFrame:
    """RowDF from scalar columns or one array column."""
    features = F.transform(columns, lambda x: x.cast("double")) if isinstance(columns, str) else F.array(*[F.col(c).cast("double") for c in columns])
    return df.select(F.col(id_col).cast("long").alias("row_id"), features.alias("features"))


def to_coords(rows: DataFrame, keep_zeros: bool = False) -> DataFrame:
    if is_sparse(rows):
        out = coo_sum(sparse.to_coords(rows)) if not keep_zeros else sparse.to_coords(rows).groupBy("i", "j").agg(F.sum("v").alias("v"))
        return out
    out = rows.select(F.col("row_id").alias("i"), F.posexplode("features").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v")
    return out if keep_zeros else out.where("v <> 0")


def coo_sum(coords: DataFrame) -> DataFrame:
    """Sum duplicates of (i, j) and drop zeros."""
    return coords.groupBy("i", "j").agg(F.sum("v").alias("v")).where("v <> 0")


def to_rows(coords: DataFrame, width: int) -> DataFrame:
    """RowDF of the rows that have entries; a row's entries (each place once) become one array of width places."""
    cells = coords.groupBy("i").agg(F.collect_list(F.col("j").cast("int")).alias("at"), F.collect_list(F.col("v").cast("double")).alias("v"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, width))
            row = np.repeat(np.arange(b.num_rows), np.diff(b["at"].offsets.to_numpy()))
            at, v = b["at"].flatten().to_numpy(zero_copy_only=False), b["v"].flatten().to_numpy(zero_copy_only=False)
            ok = (at >= 0) & (at < width)
            out[row[ok], at[ok]] = v[ok]
            yield pa.RecordBatch.from_arrays([b["row_id"], as_lists(out)], names=["row_id", "features"])

    return cells.withColumnRenamed("i", "row_id").mapInArrow(fill, "row_id long, features array<double>")


def transpose(coords: DataFrame) -> DataFrame:
    return coords.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def from_numpy(spark: SparkSession, a: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(np.atleast_2d(a))], "row_id long, features array<double>")


def from_function(spark: SparkSession, m: int, n: int, fn: Callable[[Column, Column], Column]) -> DataFrame:
    """RowDF whose entry (i, j) is the column expression fn(i, j), made where the rows are."""
    rows = spark.range(m).select(F.col("id").alias("row_id"))
    return rows.select("row_id", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda j: fn(F.col("row_id"), j).cast("double")).alias("features"))


def from_csr(spark: SparkSession, data: np.ndarray, indices: np.ndarray, indptr: np.ndarray) -> DataFrame:
    """CoordDF from the three arrays of a compressed sparse row matrix."""
    i = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    return coo_sum(spark.createDataFrame(pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(np.asarray(indices), pa.int64()), "v": pa.array(np.asarray(data, dtype=np.float64))})))


def to_csr(coords: DataFrame, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, indices, indptr) of a CoordDF; for matrices known to be small."""
    t = coo_sum(coords).orderBy("i", "j").select("i", "j", "v").toArrow()
    return t["v"].to_numpy(), t["j"].to_numpy(), np.searchsorted(t["i"].to_numpy(), np.arange(height + 1))


def to_numpy(rows: DataFrame) -> np.ndarray:
    """The whole matrix in row_id order; for results known to be small."""
    got = rows.select("row_id", "features").orderBy("row_id").collect()
    return np.array([r[1] for r in got], dtype=np.float64)


def height(coords: DataFrame) -> int:
    """Rows of a CoordDF: one more than the largest index, none without entries."""
    last = coords.agg(F.max("i")).first()[0]
    return 0 if last is None else last + 1


def is_sparse(rows: DataFrame) -> bool:
    return "features" not in rows.columns


def parts_of(rows: DataFrame) -> list[str]:
    """The columns that hold the matrix."""
    return sparse.COLUMNS if is_sparse(rows) else ["features"]


def width_of(rows: DataFrame) -> int:
    """Columns of a RowDF; all rows agree on it."""
    return rows.select("size" if is_sparse(rows) else F.size("features")).first()[0]


def same_matrix(a: DataFrame, b: DataFrame) -> bool:
    """Sparse equality: neither holds an entry that the other lacks."""
    a, b = coo_sum(a), coo_sum(b)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def column_view(rows: DataFrame, start: int, n: int) -> DataFrame:
    return rows.withColumn("features", F.slice("features", start + 1, n))


def row_view(rows: DataFrame, start: int, n: int) -> DataFrame:
    return rows.where(F.col("row_id").between(start, start + n - 1))


# -- blocks of rows ------------------------------------------------------------------------------------


def block(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def as_lists(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a, dtype=np.float64)
    return pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1], pa.array(a.ravel()))


def features(b: pa.RecordBatch) -> np.ndarray | CSR:
    """The rows of a batch as a block, dense or sparse as they are."""
    return block(b["features"]) if "features" in b.schema.names else sparse.block_of(b)


@dataclass
class Tuning:
    """block_rows: rows that dense maps work on at a time; it bounds memory and never changes a result."""

    block_rows: int = 10_000


TUNING = Tuning()


def map_rows(rows: DataFrame, fn: Callable[..., np.ndarray], *more: str) -> DataFrame:
    """Replace features by fn(block of features, *other columns as numpy); other columns stay.  No shuffle.

    Sparse rows give a sparse block, and become dense rows."""
    step = TUNING.block_rows
    schema = rows.drop(*sparse.COLUMNS).withColumn("features", F.array(F.lit(0.0))).schema if is_sparse(rows) else rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                made = as_lists(fn(features(b), *[b[c].to_numpy(zero_copy_only=False) for c in more]))
                yield pa.RecordBatch.from_arrays([made if f.name == "features" else b[f.name] for f in schema], names=schema.names)

    return rows.mapInArrow(run, schema)


def times(rows: DataFrame, b: np.ndarray) -> DataFrame:
    """A B for a RowDF A and a small B: a map over blocks of rows."""
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(b, dtype=np.float64))
    return map_rows(rows, lambda x: x @ shared.value)


#: Groups that tasks' partial sums are added up in, and numbers that the driver takes of them together.
GROUPS, TO_DRIVER = 32, 1 << 23


def reduce_blocks(df: DataFrame, fn: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum of fn(batch) over all batches, a small matrix: sums within tasks, then within GROUPS groups of
    tasks, then on the driver; a matrix that is too large for that by slices on executors.  Sums are
    taken one partial matrix after another, so no task holds many."""
    n, m = shape
    cut = max(1, (1 << 20) // max(1, m))
    schema = "at int, place int, part binary"

    def rows(total: np.ndarray | None, place: int) -> pa.RecordBatch:
        starts = range(0, n, cut) if total is not None else []
        return pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([place] * len(starts), pa.int32()), pa.array([total[k : k + cut].tobytes() for k in starts], pa.binary())], names=["at", "place", "part"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                total = fn(b) if total is None else total + fn(b)
        yield rows(total, TaskContext.get().partitionId())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, part in zip(b["at"].to_pylist(), b["part"].to_pylist(), strict=True):
                x = np.frombuffer(part, np.float64)
                sums[at] = sums[at] + x if at in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["at", "place", "part"])

    parts = df.mapInArrow(partial, schema).repartition("at", F.col("place") % GROUPS).mapInArrow(add, schema)
    if n * m * GROUPS > TO_DRIVER:
        parts = parts.repartition("at").mapInArrow(add, schema)
    out = np.zeros(shape)
    for at, _, raw in parts.collect():
        out[at : at + cut] += np.frombuffer(raw, np.float64).reshape(-1, m)
    return out


def gram(rows: DataFrame, other: str | None = None) -> np.ndarray:
    """A'A, or A'B for an array column B of the same rows (a scalar column counts as one column)."""
    width = width_of(rows)
    if other is None:
        return reduce_blocks(rows.select(*parts_of(rows)), lambda b: (x := features(b)).T @ x, (width, width))
    if dict(rows.dtypes)[other].startswith("array"):
        m = rows.select(F.size(other)).first()[0]
        return reduce_blocks(rows.select(*parts_of(rows), other), lambda b: features(b).T @ block(b[other]), (width, m))
    return reduce_blocks(rows.select(*parts_of(rows), other), lambda b: features(b).T @ b[other].to_numpy(zero_copy_only=False).astype(np.float64)[:, None], (width, 1))


# -- multiplication ------------------------------------------------------------------------------------


def gemm(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 0.0, c: DataFrame | None = None, trans_a: bool = False, trans_b: bool = False) -> DataFrame:
    """alpha op(A) op(B) + beta C of CoordDFs: a join on the inner index and a sum."""
    a = transpose(a) if trans_a else a
    b = transpose(b) if trans_b else b
    inner = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k")
    out = inner.groupBy("i", "j").agg((alpha * F.sum(F.col("x") * F.col("y"))).alias("v"))
    if c is not None and beta:
        out = out.unionByName(c.select("i", "j", (beta * F.col("v")).alias("v")))
        return coo_sum(out)
    return out.where("v <> 0")


def mirror(triangle: DataFrame, lower: bool = True) -> DataFrame:
    """The symmetric matrix of which only one triangle counts."""
    kept = triangle.where("i >= j" if lower else "i <= j")
    return kept.unionByName(transpose(kept.where("i <> j")))


def symm(triangle: DataFrame, b: DataFrame, lower: bool = True, **kw) -> DataFrame:
    return gemm(mirror(triangle, lower), b, **kw)


def gemv(a: DataFrame, x: DataFrame, alpha: float = 1.0, trans: bool = False, beta: float = 0.0, y: DataFrame | None = None) -> DataFrame:
    """alpha op(A) x + beta y for a CoordDF A and vectors (i, v)."""
    a = transpose(a) if trans else a
    terms = a.join(x.select(F.col("i").alias("j"), F.col("v").alias("x")), "j").select("i", (alpha * F.col("v") * F.col("x")).alias("v"))
    if y is not None and beta:
        terms = terms.unionByName(y.select("i", (beta * F.col("v")).alias("v")))
    return terms.groupBy("i").agg(F.sum("v").alias("v"))


# -- reductions and maps -----------------------------------------------------------------------------


def column_norms(coords: DataFrame) -> DataFrame:
    return coords.groupBy("j").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def column_dots(a: DataFrame, b: DataFrame) -> DataFrame:
    return _dots(a, b, "j")


def row_dots(a: DataFrame, b: DataFrame) -> DataFrame:
    return _dots(a, b, "i")


def _dots(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "w"), ["i", "j"]).groupBy(by).agg(F.sum(F.col("v") * F.col("w")).alias("dot"))


def axpy(alpha: float | Column, x: DataFrame, y: DataFrame) -> DataFrame:
    """alpha X + Y; alpha may be a column expression of j (a factor for each column)."""
    scaled = x.select("i", "j", ((alpha if isinstance(alpha, Column) else F.lit(alpha)) * F.col("v")).alias("v"))
    return coo_sum(scaled.unionByName(y))


def symmetric_map(coords: DataFrame, fn: Callable[[Column], Column], lower: bool = False) -> DataFrame:
    """fn on one triangle, the diagonal included; the other triangle stays."""
    inside = F.col("i") >= F.col("j") if lower else F.col("i") <= F.col("j")
    return coords.withColumn("v", F.when(inside, fn(F.col("v"))).otherwise(F.col("v")))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "w"), ["i", "j"]).select("i", "j", (F.col("v") * F.col("w")).alias("v")).where("v <> 0")


def trsm(r: np.ndarray, b: np.ndarray, upper: bool = True, trans: bool = False) -> np.ndarray:
    """Solve with a small triangle."""
    t = np.triu(r) if upper else np.tril(r)
    return np.linalg.solve(t.T if trans else t, b)


def tsqr(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Tall-skinny QR: A = Q R with R's diagonal non-negative.

    Tasks reduce their rows to a triangle, triangles are reduced in groups, and Q is A R^-1 (a map over
    rows), taken twice so that Q stays orthonormal for ill-conditioned A.
    """
    r1 = _tsqr_r(rows)
    q = times(rows, np.linalg.pinv(r1))
    r2 = _tsqr_r(q)
    return times(rows, np.linalg.pinv(r2 @ r1)), r2 @ r1


def _tsqr_r(rows: DataFrame) -> np.ndarray:
    n = width_of(rows)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, n))
        for b in batches:
            if b.num_rows:
                r = np.linalg.qr(np.vstack([r, sparse.dense(features(b))]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([as_lists(r)], names=["features"])

    parts = rows.select(*parts_of(rows)).mapInArrow(reduce, "features array<double>")
    parts = parts.repartition(max(1, int(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))).mapInArrow(reduce, "features array<double>")
    r = np.linalg.qr(np.array([x[0] for x in parts.collect()]), mode="r")
    r = np.vstack([r, np.zeros((max(0, n - len(r)), n))])
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]
