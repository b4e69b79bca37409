"""Codes of vectors: each part of a vector is named by the nearest entry of a codebook for its place.

Components are counted in whole numbers, so that distances are exact integers.  To find the nearest entry, entries are told apart by
segments, coarse to fine: for a part x and an entry c cut into segments of equal length l,

    |x - c|^2  >=  sum over segments of  l (mean x - mean c)^2 + (|x - mean x| - |c - mean c|)^2,

as the residuals are orthogonal to the means.  An entry goes when its bound is beyond an exact distance that is
already known; finer segments see only what coarser ones have left, and what is left at last gets its integer distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, join_named, written
from .vectors import finite, matrix

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components beyond this after scaling (either sign) count as this, so that sums of squares are longs.
MOST = 1 << 26
#: Parts that are compared with a codebook at a time; share of pairs up to which they are looked at one by one.
STEP, DENSE = 1024, 0.05


def segments(width: int) -> list[int]:
    """Numbers of segments, coarse to fine, ending above runs of four components."""
    out = [1]
    while out[-1] * 2 <= width // 4:
        out.append(out[-1] * 2)
    return out


def profile(x: np.ndarray, n: int) -> np.ndarray:
    """Rows whose squared Euclidean distances are the lower bounds by n segments: scaled means, then residual norms."""
    edges = x.shape[1] * np.arange(n + 1) // n
    sums = np.add.reduceat(x.astype(np.float64), edges[:-1], axis=1)
    length = np.diff(edges).astype(np.float64)
    rest = np.add.reduceat((x - np.repeat(sums / length, np.diff(edges), axis=1)) ** 2, edges[:-1], axis=1)
    return np.concatenate([sums / np.sqrt(length), np.sqrt(rest)], axis=1)


def _firsts(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs in the order of their rows the place of each row's first smallest value, and that value."""
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    lowest = np.minimum.reduceat(values, starts)
    place = np.flatnonzero(values == np.repeat(lowest, np.diff(np.append(starts, len(rows)))))
    return place[np.concatenate([[True], rows[place][1:] != rows[place][:-1]])], lowest


def nearest(x: np.ndarray, book: np.ndarray, looked: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest row of book for each row of x, ties to the lower entry; whole numbers, exact.

    While many pairs are left in a block, its bounds and distances are made by products, else pair by pair.
    looked gets the number of pairs whose integer distances were asked for, for tests.
    """
    best, far = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    if not x.shape[1] or not len(x):
        return best, far
    levels = [profile(book, n) for n in segments(x.shape[1])]
    lengths = [(p**2).sum(axis=1) for p in levels]
    whole, squares = book.astype(np.float64), (book.astype(np.float64) ** 2).sum(axis=1)
    most = (float(np.abs(x).max()) + float(np.abs(book).max())) ** 2 * x.shape[1]
    for at in range(0, len(x), STEP):
        some = x[at : at + STEP]
        least, left, rows, entries = None, None, None, None
        for n, fine, length in zip(segments(x.shape[1]), levels, lengths, strict=True):
            own = profile(some, n)
            if rows is None:  # many are left: bounds of all pairs by one product
                size = (own**2).sum(axis=1)[:, None] + length
                bound = size - 2 * own @ fine.T - (1e-12 * size + 1e-6)  # rounding does less
                if left is not None:
                    bound[~left] = np.inf
                guess = ((some - book[bound.argmin(axis=1)]) ** 2).sum(axis=1)
                least = guess if least is None else np.minimum(least, guess)
                left = bound <= least[:, None]
                if np.count_nonzero(left) < DENSE * left.size:
                    rows, entries = np.nonzero(left)
            else:
                mine = own[rows]
                bound = ((mine - fine[entries]) ** 2).sum(axis=1)
                bound -= 1e-12 * ((mine**2).sum(axis=1) + bound) + 1e-6
                first, _ = _firsts(rows, bound)
                least = np.minimum(least, ((some[rows[first]] - book[entries[first]]) ** 2).sum(axis=1))
                keep = bound <= least[rows]
                rows, entries = rows[keep], entries[keep]
        if looked is not None:
            looked.append(np.count_nonzero(left) if rows is None else len(rows))
        if rows is None and most < 2**52:  # whole numbers below 2^53 are exact in doubles
            own = some.astype(np.float64)
            d = (own**2).sum(axis=1)[:, None] + squares - 2 * own @ whole.T
            d[~left] = np.inf
            found = d.argmin(axis=1)
            best[at : at + len(some)], far[at : at + len(some)] = found, d[np.arange(len(some)), found].astype(np.int64)
            continue
        if rows is None:
            rows, entries = np.nonzero(left)
        d = ((some[rows] - book[entries]) ** 2).sum(axis=1)
        first, lowest = _firsts(rows, d)  # entries ascend in a row
        best[at : at + len(some)], far[at : at + len(some)] = entries[first], lowest
    return best, far


def whole_numbers(vectors: DataFrame, vec_col: str = "embedding", scale: int = SCALE, name: str = "v") -> DataFrame:
    """Rows of vectors that can be coded, with the column name: components as floor(scale * x)."""
    count = lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x.cast("double") * scale))).cast("int")
    return vectors.where(finite(F.col(vec_col))).withColumn(name, F.transform(vec_col, count))


def parts_of(column, width: int, parts: int = PARTS) -> np.ndarray:
    """(rows, parts, width / parts) whole numbers of an Arrow column; shorter vectors are filled up with zeros."""
    x = matrix(column, np.int64)
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))).reshape(len(x), parts, width // parts)


def train(whole: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "v") -> np.ndarray:
    """Codebooks (parts, entries, width / parts) of the vectors in whole (written): the first ones by id, then rounds of means.

    Each round is one pass; a task sends sums and counts of its parts by entry, never parts.
    """
    context = whole.sparkSession.sparkContext
    first = whole.select(id_col, vec_col).orderBy(F.asc_nulls_last(id_col), vec_col).limit(entries).select(vec_col).toArrow()
    books = parts_of(first[vec_col].combine_chunks(), width, parts).transpose(1, 0, 2).copy() if first.num_rows else np.zeros((parts, 0, width // parts), dtype=np.int64)
    for _ in range(rounds if books.size else 0):
        shared = context.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            books = shared.value
            total, count = np.zeros_like(books), np.zeros(books.shape[:2], dtype=np.int64)
            for b in batches:
                x = parts_of(b[vec_col], width, parts)
                for p in range(parts):
                    code, _ = nearest(x[:, p], books[p])
                    order = np.argsort(code, kind="stable")
                    names, starts = np.unique(code[order], return_index=True)
                    if len(names):
                        total[p, names] += np.add.reduceat(x[order, p], starts, axis=0)
                        count[p] += np.bincount(code, minlength=len(books[p]))
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p * count.shape[1] + e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["slot", "n", "total"])

        made = whole.select(vec_col).mapInArrow(sums, "slot long, n long, total array<long>")
        means = made.select("slot", "n", F.posexplode("total").alias("at", "x")).groupBy("slot", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toArrow()  # at most as many rows as the books have numbers
        flat = books.reshape(-1, books.shape[2]).copy()
        flat[means["slot"].to_numpy(), means["at"].to_numpy()] = means["x"].to_numpy() // means["n"].to_numpy()
        books = flat.reshape(books.shape)
        shared.unpersist()
    return books


def encode(whole: DataFrame, books: np.ndarray, width: int, vec_col: str = "v", code: str = "code", error: str = "error") -> DataFrame:
    """whole without its vectors, with the code (hex digits by part, enough for all entries) and its squared distance."""
    shared = whole.sparkSession.sparkContext.broadcast(books)
    digits = max(2, len(f"{max(books.shape[1] - 1, 0):x}"))
    rest = [c for c in whole.columns if c != vec_col]
    schema = whole.drop(vec_col).withColumn(code, F.lit("")).withColumn(error, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for b in batches:
            x = parts_of(b[vec_col], width, len(books))
            found = [nearest(x[:, p], books[p]) for p in range(len(books))]
            names = ["".join(f"{e:0{digits}x}" for e in row) for row in zip(*[f[0].tolist() for f in found], strict=True)]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in rest], pa.array(names, pa.string()), pa.array(sum(f[1] for f in found), pa.int64())], names=[*rest, code, error])

    return whole.mapInArrow(run, schema)


def decode(codes: list[str], books: np.ndarray) -> np.ndarray:
    """The vectors (whole numbers) that codes stand for."""
    digits = max(2, len(f"{max(books.shape[1] - 1, 0):x}"))
    at = np.array([[int(c[digits * p : digits * (p + 1)], 16) for p in range(len(books))] for c in codes], dtype=np.int64).reshape(-1, len(books))
    return np.concatenate([books[p, at[:, p]] for p in range(len(books))], axis=1)


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, label: str = "label", id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(rows id_col, code, error, label_error; codebooks) of vectors (id_col, vec_col, label).

    Left out are rows with a null vector and null or non-finite components; a null id is an id (the last one), and repeated rows count
    and come out as often as they stand there.  Components beyond MOST / scale count as that.  Vectors are filled up with zeros to the
    longest one's length and to a multiple of parts.  Fewer vectors than entries give that many entries; of rows
    with one id the smaller vector comes first.  label_error is the sum of error over the rows with the same label (null is a
    label); beyond a long it counts as the largest one.  Other columns are ignored.
    """
    whole = whole_numbers(vectors.select(F.col(id_col), F.col(label), F.col(vec_col).alias("given")), "given", scale).drop("given")
    whole = written(whole, "codes-whole")
    longest = whole.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts) * parts
    books = train(whole, width, parts, entries, rounds, id_col)
    code, error, sums, n = fresh_names(whole, "code", "error", "label_error", "rows")
    made = written(encode(whole, books, width, code=code, error=error), "codes")
    limit = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    by_label = made.groupBy(label).agg(F.least(F.sum(F.col(error).cast("decimal(38,0)")), limit).cast("long").alias(sums), F.count("*").alias(n))
    rows = join_named(made, written(by_label, "codes-labels"), [label], n)
    return rows.select(F.col(id_col), F.col(code).alias("code"), F.col(error).alias("error"), F.col(sums).alias("label_error")), books


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place, as decimals with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
