"""Sparse rows: a row of a matrix as size, indices and values, and blocks of such rows in compressed form.

A block stands in for a dense one wherever a solver or a map multiplies it: `x @ b`, `x.T @ y` and `x.T @ x` cost as much as
the block has entries.  Indices of a row may be in any order; those that repeat add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a sparse row.
COLUMNS = ["size", "indices", "values"]
#: Numbers of an intermediate product, or of a dense copy, that are held at a time.
HELD = 1 << 22


class CSR:
    """Rows of a block: row i has the entries starts[i] to starts[i + 1] of at (columns) and v (values)."""

    __slots__ = ("at", "n", "starts", "v")
    __array_ufunc__ = None  # numpy leaves products to this class

    def __init__(self, starts: np.ndarray, at: np.ndarray, v: np.ndarray, n: int):
        self.starts, self.at, self.v, self.n = starts, at, v, n

    def __len__(self) -> int:
        return len(self.starts) - 1

    @property
    def shape(self) -> tuple[int, int]:
        return len(self), self.n

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def part(self, first: int, last: int) -> CSR:
        s = slice(self.starts[first], self.starts[last])
        return CSR(self.starts[first : last + 1] - self.starts[first], self.at[s], self.v[s], self.n)

    def parts(self, entries: int, rows: int | None = None) -> list[tuple[int, CSR]]:
        """(first row, block) of blocks with about so many entries (one row at least), and rows at most."""
        out, first = [], 0
        while first < len(self):
            last = int(np.searchsorted(self.starts, self.starts[first] + entries, side="right")) - 1
            last = min(max(first + 1, last), len(self), first + rows if rows else len(self))
            out.append((first, self.part(first, last)))
            first = last
        return out

    def __matmul__(self, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self), b.shape[1]))
        for first, x in self.parts(max(1, HELD // max(1, b.shape[1]))):
            full = np.flatnonzero(np.diff(x.starts))
            if len(full):
                out[first + full] = np.add.reduceat(x.v[:, None] * b[x.at], x.starts[full], axis=0)
        return out

    @property
    def T(self) -> _Transposed:  # noqa: N802
        return _Transposed(self)

    def dense(self) -> np.ndarray:
        out = np.zeros(self.shape)
        np.add.at(out, (self.rows, self.at), self.v)
        return out

    def by_parts(self, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """fn of dense copies of some rows at a time, for maps that need all places of a row."""
        made = [fn(x.dense()) for _, x in self.parts(len(self.v) + 1, max(1, HELD // max(1, self.n)))]
        return np.concatenate(made) if made else fn(np.zeros((0, self.n)))

    def columns(self) -> tuple[np.ndarray, CSR]:
        """The columns that have entries, and the block without the others."""
        used, at = np.unique(self.at, return_inverse=True)
        return used, CSR(self.starts, at, self.v, len(used))


class _Transposed:
    __array_ufunc__ = None

    def __init__(self, x: CSR):
        self.x = x

    def __matmul__(self, y: np.ndarray | CSR) -> np.ndarray:
        x = self.x
        if isinstance(y, CSR):  # a small square: dense copies of some rows at a time
            out = np.zeros((x.n, y.n))
            for first, some in x.parts(len(x.v) + 1, max(1, HELD // max(1, x.n, y.n))):
                left = some.dense()
                out += left.T @ (left if y is x else y.part(first, first + len(some)).dense())
            return out
        rows, out = x.rows, np.empty((x.n, y.shape[1]))
        for k in range(y.shape[1]):
            out[:, k] = np.bincount(x.at, weights=x.v * y[rows, k], minlength=x.n)
        return out


def block_of(b: pa.RecordBatch | pa.Table) -> CSR:
    """Columns size, indices and values of a batch as a block."""
    at, values = (b[c].combine_chunks() if isinstance(b[c], pa.ChunkedArray) else b[c] for c in ("indices", "values"))
    starts = at.offsets.to_numpy() if len(at) else np.zeros(1, np.int32)
    n = int(b["size"][0].as_py()) if b.num_rows else 0
    return CSR((starts - starts[0]).astype(np.int64), at.flatten().to_numpy(zero_copy_only=False).astype(np.int64), values.flatten().to_numpy(zero_copy_only=False).astype(np.float64), n)


#: Entries of a packed block, about.
PACKED = 1 << 18


def packed(rows: DataFrame, beside: str) -> DataFrame:
    """Sparse rows and an array of doubles beside each (as many for each row) as blocks of rows, whose columns are bytes: a pass over
    them costs a fraction of one over rows.  unpacked() gives the blocks of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = b[beside].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else None
            for first, x in block_of(b).parts(PACKED):
                columns = x.starts, x.at.astype("<i4"), x.v, np.ascontiguousarray(u[first : first + len(x)], dtype=np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([x.n]), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], names=["size", "starts", "indices", "values", "beside"])

    return rows.select(*COLUMNS, beside).mapInArrow(run, "size long, starts binary, indices binary, values binary, beside binary")


def unpacked(b: pa.RecordBatch) -> Iterator[tuple[CSR, np.ndarray]]:
    for n, *columns in zip(*(b[c].to_pylist() for c in ("size", "starts", "indices", "values", "beside")), strict=True):
        starts, at, v, u = (np.frombuffer(c, kind) for c, kind in zip(columns, ("<i8", "<i4", "<f8", "<f8"), strict=True))
        yield CSR(starts, at.astype(np.int64), v, n), u.reshape(len(starts) - 1, -1)


def dense(x: np.ndarray | CSR) -> np.ndarray:
    return x.dense() if isinstance(x, CSR) else x


def from_dense(rows: DataFrame) -> DataFrame:
    """Dense rows in sparse form; other columns stay."""
    places = F.filter(F.transform("features", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"] != 0)
    out = rows.withColumn("size", F.size("features")).withColumn("indices", F.transform(places, lambda p: p["i"])).withColumn("values", F.transform(places, lambda p: p["x"]))
    return out.drop("features")


def from_coords(coords: DataFrame, n: int) -> DataFrame:
    """Rows (row_id, size, indices, values) of a CoordDF; rows without entries are not there."""
    cells = coords.groupBy(F.col("i").alias("row_id")).agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("e"))
    return cells.select("row_id", F.lit(n).alias("size"), F.transform("e", lambda e: e["j"].cast("int")).alias("indices"), F.transform("e", lambda e: e["v"].cast("double")).alias("values"))


def to_coords(rows: DataFrame) -> DataFrame:
    """CoordDF of sparse rows; repeated places stand as often as they do there."""
    e = rows.select(F.col("row_id").alias("i"), F.explode(F.arrays_zip("indices", "values")).alias("e"))
    return e.select("i", F.col("e.indices").cast("long").alias("j"), F.col("e.values").alias("v"))
