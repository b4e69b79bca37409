"""What the two vector searches share: valid vectors, classes of equal vectors, merging of partial results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_named, written


def finite(v: Column) -> Column:
    """Whether an array is not null and holds neither null nor non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce(v.isNotNull() & ~F.exists(v, bad), F.lit(False))


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", empty: bool = False) -> DataFrame:
    """(vec_id, v: array<double>) of rows with an id and a vector of finite components, with empty also without any."""
    v = F.col(vec_col)
    ok = F.col(id_col).isNotNull() & finite(v) & (F.size(v) >= (0 if empty else 1))
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("v"))


def first_of_equals(vectors: DataFrame, k: int) -> DataFrame:
    """Of each class of equal vectors the k rows with the smallest ids.

    A search for k - 1 others returns equal vectors by id, so no row beyond these can be in any
    result.  The limit works before the shuffle, so many copies of one vector do not meet in a task.
    """
    order = Window.partitionBy("v").orderBy("vec_id")
    return vectors.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


#: Vectors, or lists of found neighbours, that a join broadcasts at most.
FEW = 1 << 12


def query_classes(queries: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(q, v, members): each different vector of queries (vec_id, v; no row twice) once, q being its own number; (query_id, q);
    the number of vectors of the id that has most of them.

    A class is named by a number, not by an id: an id may have several vectors, and then belongs to several classes.
    """
    queries = written(queries, "asked")
    classes = written(queries.groupBy("v").agg(F.count("*").alias("members")).withColumn("q", F.monotonically_increasing_id()), "asked-classes")
    members = join_named(queries, classes, ["v"], "members", FEW).select(F.col("vec_id").alias("query_id"), "q")
    most = queries.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
    return classes, written(members, "asked-members"), most


def best(found: DataFrame, classes: DataFrame, members: DataFrame, k: int, deep: int) -> DataFrame:
    """found (q, vec_id, score), the deep best of each q, to query_id, rank, vec_id, score.

    deep is k and what an id's own vectors can take.  An id with several vectors gets the best of what they find;
    equal (vec_id, score) count once.
    """
    better = [F.desc("score"), F.asc("vec_id")]
    top = found.distinct().withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*better))).where(F.col("r") <= deep)
    lists = top.groupBy("q").agg(F.collect_list(F.struct("vec_id", "score")).alias("top"))
    lists = written(lists.join(classes.select("q", "members"), "q"), "asked-best")
    each = join_named(members, lists, ["q"], "members", FEW).select("query_id", F.explode("top").alias("t")).select("query_id", "t.vec_id", "t.score")
    own = each.where("query_id <> vec_id").distinct()
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*better))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(column, dtype=np.float64) -> np.ndarray:
    """An Arrow column of lists as a matrix; shorter vectors are filled up with zeros."""
    lists = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if not len(sizes):
        return np.zeros((0, 0), dtype)
    width = int(sizes.max())
    if (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(dtype)
    out = np.zeros((len(sizes), width), dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return np.pad(a, ((0, 0), (0, w - a.shape[1]))), np.pad(b, ((0, 0), (0, w - b.shape[1])))


def salt(col: str, n: Column | int) -> Column:
    return F.pmod(F.xxhash64(col), n if isinstance(n, Column) else F.lit(n)).cast("int")


def top_of(scores: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k best of each row, ties to smaller ids (ids ascending); floor: scores under it are not wanted."""
    n = scores.shape[1]
    if n <= k:
        rows, cols = np.nonzero(np.ones_like(scores, dtype=bool))
    else:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        take = scores > kth
        ties = scores == kth
        room = k - take.sum(axis=1, keepdims=True)
        take |= ties & (np.cumsum(ties, axis=1) <= room)
        rows, cols = np.nonzero(take)
    if floor is not None:
        ok = scores[rows, cols] >= floor[rows]
        rows, cols = rows[ok], cols[ok]
    return rows, cols
