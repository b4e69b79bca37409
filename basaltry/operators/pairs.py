"""Every row of one matrix with every row of another, tile against tile.

Both sides are dealt in tiles of some MB of rows, and each pair of tiles meets in one task, which makes their block of values and
reduces it before anything goes on: sums and largest values, the best partners, pairs over a threshold, or a product with vectors.
Within one matrix each unordered pair of tiles is made once and serves both its sides.  Rows move once for each
tile of the other side; pairs move only where they are the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matrix import as_lists, block, width_of

#: Bytes of rows in a tile; values of a block that are held at a time, and its sides where they may be cut.
TILE, VALUES, SIDE = 48 << 20, 1 << 20, 512

Block = Callable[[np.ndarray, np.ndarray], np.ndarray]


def tiles_of(rows: DataFrame, tile: int | None = None) -> int:
    """Tiles that rows are dealt in: so large as to move rows rarely, but enough of them for all tasks to have pairs.  tile says how
    small (in bytes) they may be for that; it never makes more of them than tasks need, since each row moves once for each tile."""
    count, width = rows.count(), width_of(rows) or 1
    tasks, size = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * width * count
    return max(1, -(-size // TILE), min(int(np.ceil(np.sqrt(2 * tasks))), max(-(-size // tile) if tile else 0, count // 256)))


def tile_pairs(x: DataFrame, y: DataFrame | None, reduce: Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]], schema: dict[str, str], columns: tuple[str, ...] = (), tile: int | None = None, parts: int | None = None) -> DataFrame:
    """reduce(left rows, right rows, twice) of every pair of tiles; without y of x with itself, each unordered pair once, where
    twice says that the pair stands for both its orders (it does not for a tile with itself).  columns go along with the right rows
    (within one matrix with both).  What reduce yields goes on batch by batch.  parts: tiles of x, where tiles_of has been asked before."""
    own, n, same = ("row_id", "features"), parts or tiles_of(x, tile), y is None
    m = n if same else tiles_of(y, tile)
    at = lambda k: F.pmod(F.xxhash64("row_id"), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    if same:
        dealt = x.select(*own, *columns, at(n).alias("t"), each(n).alias("o"))
        dealt = dealt.select(*own, *columns, F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), (F.col("t") > F.col("o")).alias("right"))
    else:
        right = y.select(*own, *columns, at(m).alias("b"), each(n).alias("a"), F.lit(True).alias("right"))
        left = x.select(*own, at(n).alias("a"), each(m).alias("b"), F.lit(False).alias("right"))
        dealt = right.unionByName(left, allowMissingColumns=True)

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        alone = same and key[0].as_py() == key[1].as_py()
        left = rows if alone else rows.filter(pc.invert(rows["right"]))
        right = rows if alone else rows.filter(rows["right"])
        if left.num_rows and right.num_rows:
            yield from reduce(left, right, same and not alone)

    return dealt.groupBy("a", "b").applyInArrow(meet, ", ".join(f"{k} {v}" for k, v in schema.items()))


def _features(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return t["row_id"].to_numpy(), block(t["features"].combine_chunks())


def _blocks(x: np.ndarray, y: np.ndarray, fn: Block) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, VALUES // max(1, len(y)))
    for at in range(0, len(x), step):
        yield at, fn(x[at : at + step], y)


def blocks(x: np.ndarray, y: np.ndarray, fn: Block) -> Iterator[tuple[int, int, np.ndarray]]:
    """fn(x, y) in blocks that stay in a core's cache, with their first row and column."""
    for i in range(0, len(x), SIDE):
        for j in range(0, len(y), SIDE):
            yield i, j, fn(x[i : i + SIDE], y[j : j + SIDE])


def summary(x: DataFrame, y: DataFrame | None, fn: Block, tile: int | None = None) -> DataFrame:
    """(i, total, largest) over all rows j of y (of x itself without y) of fn(x_i, x_j); fn is symmetric where y is absent or x."""
    y = None if y is x else y

    def reduce(a: pa.Table, b: pa.Table, twice: bool) -> Iterator[pa.RecordBatch]:
        (i, u), (j, v) = _features(a), _features(b)
        total, largest = np.zeros(len(i)), np.full(len(i), -np.inf)
        back, high = np.zeros(len(j)), np.full(len(j), -np.inf)
        for p, q, k in blocks(u, v, fn):
            rows, columns = slice(p, p + k.shape[0]), slice(q, q + k.shape[1])
            total[rows] += k.sum(axis=1)
            largest[rows] = np.maximum(largest[rows], k.max(axis=1))
            if twice:
                back[columns] += k.sum(axis=0)
                high[columns] = np.maximum(high[columns], k.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total), pa.array(largest)], names=["i", "total", "largest"])
        if twice:
            yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(back), pa.array(high)], names=["i", "total", "largest"])

    made = tile_pairs(x, y, reduce, {"i": "long", "total": "double", "largest": "double"}, tile=tile)
    return made.groupBy("i").agg(F.sum("total").alias("total"), F.max("largest").alias("largest"))


def values(x: DataFrame, y: DataFrame | None, fn: Block, tile: int | None = None, keep: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(i, j, v) of all pairs, or of those that keep says of a block of values; without y the triangle i >= j.  Pairs of a block go on in
    the order of their values: equal ones are neighbours, so that files of the pairs are about half as large."""

    same = y is None

    def reduce(a: pa.Table, b: pa.Table, twice: bool) -> Iterator[pa.RecordBatch]:
        (i, u), (j, v) = _features(a), _features(b)
        for at, k in _blocks(u, v, fn):
            mask = np.ones(k.shape, dtype=bool) if keep is None else keep(k)
            own = i[at : at + len(k)]
            if same and not twice:
                mask &= own[:, None] >= j
            place = np.flatnonzero(mask)
            w = k.ravel()[place]
            order = np.argsort(w.astype(np.float32))
            w, (r, c) = w[order], np.divmod(place[order], k.shape[1])
            p, q = own[r], j[c]
            if same:
                p, q = np.maximum(p, q), np.minimum(p, q)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.array(w)], names=["i", "j", "v"])

    return tile_pairs(x, y, reduce, {"i": "long", "j": "long", "v": "double"}, tile=tile)


def largest(x: DataFrame, y: DataFrame | None, fn: Block, k: int, others: bool = False, tile: int | None = None) -> DataFrame:
    """(i, rank, j, v): the k largest values of each row, ties to smaller j; others leaves out j = i.  A pair of tiles sends k of each row."""

    def best(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the k best of each row; j: a name for each column, or for each value."""
        j = np.broadcast_to(j, v.shape)
        if others:
            v = np.where(i[:, None] == j, -np.inf, v)
        m = min(k, v.shape[1])
        r, c = np.nonzero(v >= -np.partition(-v, m - 1, axis=1)[:, m - 1 : m])
        order = np.lexsort((j[r, c], -v[r, c], r))
        r, c = r[order], c[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < m
        r, c = r[first].reshape(-1, m), c[first].reshape(-1, m)
        return j[r, c], v[r, c]

    def found(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        r, c = np.nonzero(v > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(i[r]), pa.array(j[r, c]), pa.array(v[r, c])], names=["i", "j", "v"])

    def reduce(a: pa.Table, b: pa.Table, twice: bool) -> Iterator[pa.RecordBatch]:
        (i, u), (j, v) = _features(a), _features(b)
        names, tops = np.zeros((len(j), 0), np.int64), np.zeros((len(j), 0))
        for at, values_ in _blocks(u, v, fn):
            own = i[at : at + len(values_)]
            yield found(own, *best(own, j, values_))
            if twice:  # the best so far of the other side go on
                names = np.concatenate([names, np.broadcast_to(own, (len(j), len(own)))], axis=1)
                names, tops = best(j, names, np.concatenate([tops, values_.T], axis=1))
        if twice:
            yield found(j, names, tops)

    made = tile_pairs(x, y, reduce, {"i": "long", "j": "long", "v": "double"}, tile=tile)
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("v"), F.asc("j")))
    return made.withColumn("rank", rank).where(F.col("rank") <= k).select("i", "rank", "j", "v")


def product(x: DataFrame, y: DataFrame | None, fn: Block, vectors: str, tile: int | None = None, parts: int | None = None) -> DataFrame:
    """(row_id, features): fn(x, y) V for vectors V that stand beside the rows of y (an array column of x too): nothing
    but tiles, and their parts of the product, moves, and no task or driver holds all rows or all of V."""

    def reduce(a: pa.Table, b: pa.Table, twice: bool) -> Iterator[pa.RecordBatch]:
        (i, u), (j, v) = _features(a), _features(b)
        left, right = block(a[vectors].combine_chunks()) if twice else None, block(b[vectors].combine_chunks())
        out, back = np.zeros((len(i), right.shape[1])), np.zeros((len(j), right.shape[1]))
        for p, q, k in blocks(u, v, fn):
            rows, columns = slice(p, p + k.shape[0]), slice(q, q + k.shape[1])
            out[rows] += k @ right[columns].astype(k.dtype, copy=False)
            if twice:
                back[columns] += k.T @ left[rows].astype(k.dtype, copy=False)
        yield pa.RecordBatch.from_arrays([pa.array(i), as_lists(out)], names=["row_id", "features"])
        if twice:
            yield pa.RecordBatch.from_arrays([pa.array(j), as_lists(back)], names=["row_id", "features"])

    return summed_rows(tile_pairs(x, y, reduce, {"row_id": "long", "features": "array<double>"}, (vectors,), tile, parts))


def summed_rows(parts: DataFrame) -> DataFrame:
    """Rows of the same row_id added up, as arrays; a task takes its rows in the order of their ids."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[np.ndarray, np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            ids, v = b["row_id"].to_numpy(), block(b["features"])
            if last is not None:
                ids, v = np.concatenate([last[0], ids]), np.concatenate([last[1], v])
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            v, ids = np.add.reduceat(v, starts, axis=0), ids[starts]
            last = ids[-1:], v[-1:]  # may go on in the next batch
            yield pa.RecordBatch.from_arrays([pa.array(ids[:-1]), as_lists(v[:-1])], names=["row_id", "features"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array(last[0]), as_lists(last[1])], names=["row_id", "features"])

    return parts.repartition("row_id").sortWithinPartitions("row_id").mapInArrow(add, "row_id long, features array<double>")
