"""Approximate nearest neighbours by inner product: balanced posting lists with replicated boundaries.

Vectors are lifted by one coordinate to equal length, so that the largest inner product is the
smallest distance.  Centroids come from balanced k-means on a bounded sample; every vector goes into the
list of its nearest centroid and, if it lies near a boundary, into those of others too.  Centroids
are held in memory as a neighbourhood graph; a search walks it and takes the lists
whose distance is within a ratio of the nearest one's.  What the lists hold is compared exactly.

Lists are dealt over tasks; a long list is salted over several, short ones share a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, small, written
from .vectors import best, first_of_equals, matrix, query_classes, salt, same_width, top_of, usable

#: Vectors of a list on average, lists at most (they are broadcast), sample vectors a list, the whole sample at most.
LIST, LISTS, PER_LIST, SAMPLE = 200, 8192, 48, 131_072
#: Lists that hold a vector at most, and the distance ratio up to which they do.
REPLICAS, CLOSURE = 2, 1.25
#: A query looks into lists up to this distance ratio, and into so many at least.
RATIO, PROBES = 1.16, 8
#: Vectors that one task compares, at least where there are so many and at most; its queries at most.
LEAST, BLOCK, QUERY_BLOCK = 512, 16_384, 4096
#: Distances that are held at a time.
CELLS = 1 << 22
DEGREE, RANDOM_LINKS, ENTRIES = 24, 4, 8

_FOUND = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


@dataclass
class CentroidGraph:
    centroids: np.ndarray
    links: np.ndarray  # (lists, degree)
    entries: np.ndarray
    lift: float  # length that vectors are lifted to

    def search(self, x: np.ndarray, ratio: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances (inf where the walk did not come) and the mask of lists to take, for each row of x (lifted).

        The walk opens, for all rows at once, the nearest seen centroids that are not open yet, and
        ends for a row when none of them is within the ratio of its nearest or among its `least` nearest.
        """
        n, k = len(x), len(self.centroids)
        d = np.full((n, k), np.inf)
        opened = np.zeros((n, k), dtype=bool)
        length = (self.centroids**2).sum(axis=1)
        own = (x**2).sum(axis=1)

        def see(rows: np.ndarray, nodes: np.ndarray) -> None:
            fresh = np.isinf(d[rows, nodes])
            rows, nodes = rows[fresh], nodes[fresh]
            dot = np.einsum("ij,ij->i", x[rows], self.centroids[nodes])
            d[rows, nodes] = np.sqrt(np.maximum(own[rows] + length[nodes] - 2 * dot, 0.0))

        every = np.arange(n)
        see(np.repeat(every, len(self.entries)), np.tile(self.entries, n))
        while True:
            limit = np.maximum(d.min(axis=1) * ratio, np.partition(d, min(least, k) - 1, axis=1)[:, min(least, k) - 1])
            open_now = ~opened & (d <= limit[:, None]) & np.isfinite(d)
            if not open_now.any():
                break
            rows, nodes = np.nonzero(open_now)
            opened[rows, nodes] = True
            for at in range(0, len(rows), 8192):
                r = np.repeat(rows[at : at + 8192], self.links.shape[1])
                c = self.links[nodes[at : at + 8192]].ravel()
                pair = np.unique(r * k + c)
                see(pair // k, pair % k)
        near = d.min(axis=1, keepdims=True)
        rank = d.argsort(axis=1).argsort(axis=1)
        return d, ((d <= near * ratio) | (rank < least)) & np.isfinite(d)


def _far(x: np.ndarray, c: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Squared distances of rows of x to all rows of c, some rows at a time."""
    length, step = (c**2).sum(axis=1), max(1, CELLS // max(1, len(c)))
    for at in range(0, len(x), step):
        some = x[at : at + step]
        yield slice(at, at + len(some)), (some**2).sum(axis=1)[:, None] + length - 2 * some @ c.T


def balanced_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd rounds whose distances are raised for lists that are larger than the mean."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    size, near = np.full(k, len(x) / k), np.zeros(len(x))
    for _ in range(rounds):
        push = 0.05 * max(float(near.mean()), 0.0) * (size / (len(x) / k) - 1)
        a = np.empty(len(x), dtype=np.int64)
        for rows, far in _far(x, c):
            a[rows] = (far + push).argmin(axis=1)
            near[rows] = far.min(axis=1)
        size = np.bincount(a, minlength=k).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def centroid_graph(sample: np.ndarray, n: int, lift: float, seed: int = 7) -> CentroidGraph:
    """sample: lifted vectors, distinct; n: all vectors."""
    k = int(min(LISTS, max(1, n // LIST), max(1, len(sample) // 4)))
    c = balanced_kmeans(sample, k)
    rng = np.random.default_rng(seed)
    degree = min(DEGREE, max(k - 1, 1))
    near = np.zeros((k, degree), dtype=np.int64)
    for rows, d in _far(c, c):
        d[np.arange(len(d)), np.arange(rows.start, rows.stop)] = np.inf
        some = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        near[rows] = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, axis=1), axis=1, kind="stable"), axis=1)
    chain = (np.arange(k)[:, None] + 1) % k  # keeps the graph in one piece
    links = np.concatenate([near, rng.integers(0, k, (k, RANDOM_LINKS)), chain], axis=1)
    return CentroidGraph(c, links, rng.choice(k, min(ENTRIES, k), replace=False), lift)


def _lifted(x: np.ndarray, lift: float, width: int, query: bool) -> np.ndarray:
    """Vectors with the coordinate that brings them to length lift (queries: zero)."""
    x = np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))[:, :width]
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(lift**2 - (x**2).sum(axis=1), 0.0))
    return np.concatenate([x, last[:, None]], axis=1)


def approximate_neighbours(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors, queries (vec_id, embedding) to query_id, rank (from 1), vec_id, score (inner product of the original vectors).

    Every vector is indexed.  A query's own id is no candidate; ties go to the smaller vec_id.  Left out
    are rows with a null id, null or zero vectors and null or non-finite components.  Shorter vectors count
    as filled up with zeros; repeated rows count once; an id with two vectors is two candidates, and a query with each: it
    gets the best of what they find.  Fewer candidates than k give fewer rows.
    """
    spark = vectors.sparkSession
    zero = F.forall("v", lambda x: x == 0)
    data = written(first_of_equals(usable(vectors).where(~zero).distinct(), k + 1), "ann-data")
    classes, members, own = query_classes(usable(queries).where(~zero).distinct())
    deep = k + own
    stats = data.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    n, width, lift = stats[0], stats[1] or 1, float(np.sqrt(stats[2] or 1.0))
    some = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE, max(64, PER_LIST * (n // LIST)))).select("v").toPandas()["v"].tolist()
    sample = np.zeros((len(some), width))
    for i, v in enumerate(some):
        sample[i, : len(v)] = v
    shared = spark.sparkContext.broadcast(centroid_graph(np.unique(_lifted(sample, lift, width, False), axis=0), n, lift) if n else None)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            step = max(16, min(1024, CELLS // 4 // len(g.centroids)))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                d, _ = g.search(_lifted(matrix(part["v"]), lift, width, False), CLOSURE if len(g.centroids) < 3 else 1.0, REPLICAS)
                order = d.argsort(axis=1)[:, :REPLICAS]
                far = np.take_along_axis(d, order, axis=1)
                take = (far <= far[:, :1] * CLOSURE) & np.isfinite(far)
                rows, which = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([pa.array(order[rows, which], pa.int32()), part["vec_id"].take(pa.array(rows)), part["v"].take(pa.array(rows))], names=["list", "vec_id", "v"])

    lists = written(data.select("vec_id", "v").mapInArrow(assign, "list int, vec_id long, v array<double>"), "ann-lists")
    sizes = dict(lists.groupBy("list").count().collect())  # LISTS rows at most
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(LEAST, min(BLOCK, sum(sizes.values()) // tasks))
    base, salts, room = {}, {}, 0
    bucket = 0
    for name, size in sorted(sizes.items()):  # long lists get buckets of their own, short ones fill a bucket together
        if size >= most or size > room:
            bucket += 1
            room = most
        base[name], salts[name] = bucket, -(-size // most)
        bucket += salts[name] - 1
        room = room - size if size < most else 0

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            step = max(16, min(512, CELLS // 4 // len(g.centroids)))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                _, take = g.search(_lifted(matrix(part["v"]), lift, width, True), RATIO, PROBES)
                rows, into, which = [], [], []
                for i in range(len(take)):
                    wanted: dict[int, list[int]] = {}
                    for name in np.flatnonzero(take[i]).tolist():
                        for s in range(salts.get(name, 0)):
                            wanted.setdefault(base[name] + s, []).append(name)
                    rows += [i] * len(wanted)
                    into += list(wanted)
                    which += list(wanted.values())
                yield pa.RecordBatch.from_arrays([part["q"].take(pa.array(rows, pa.int64())), pa.array(into, pa.int32()), pa.array(which, pa.list_(pa.int32()))], names=["q", "bucket", "lists"])

    probes = written(classes.select("q", "v").mapInArrow(probe, "q long, bucket int, lists array<int>"), "ann-probes")
    # a bucket that many queries look into is compared with some of them at a time; only such buckets are copied
    asked = probes.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(QUERY_BLOCK)).cast("int").alias("parts")).where("parts > 1")
    asked = small(written(asked, "ann-parts"))
    shared_out = lambda df: df.join(asked, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    probes = shared_out(probes).withColumn("part", salt("q", F.col("parts"))).drop("parts").join(classes.select("q", "v"), "q")
    pairs = lambda m: F.create_map(*[F.lit(x) for kv in (m or {-1: 1}).items() for x in kv])
    placed = lists.withColumn("bucket", pairs(base)[F.col("list")] + salt("vec_id", pairs(salts)[F.col("list")]))
    dealt = shared_out(placed).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], schema=_FOUND)
        q, x = same_width(matrix(left["v"]), matrix(right["v"]))
        q_ids, ids, names = left["q"].to_numpy(), right["vec_id"].to_numpy(), right["list"].to_numpy()
        wants = matrix(left["lists"], np.int64) if left.num_rows else np.zeros((0, 0))
        sizes_ = np.array([len(v) for v in left["lists"].to_pylist()])
        wants[np.arange(wants.shape[1]) >= sizes_[:, None]] = -1
        top = {}
        for name in np.unique(names):
            rows, at = np.flatnonzero((wants == name).any(axis=1)), np.flatnonzero(names == name)
            at = at[np.argsort(ids[at], kind="stable")]
            if not len(rows):
                continue
            scores = q[rows] @ x[at].T
            r, c = top_of(scores, ids[at], deep)
            top[name] = rows[r], at[c], scores[r, c]
        if not top:
            return pa.Table.from_batches([], schema=_FOUND)
        rows, cols, scores = (np.concatenate([t[i] for t in top.values()]) for i in range(3))
        order = np.lexsort((ids[cols], -scores, rows))  # a vector in two lists stands twice
        rows, cols = rows[order], cols[order]
        again = np.concatenate([[False], (rows[1:] == rows[:-1]) & (ids[cols[1:]] == ids[cols[:-1]])])
        rows, cols = rows[~again], cols[~again]
        start = np.concatenate([[True], rows[1:] != rows[:-1]])
        keep = np.arange(len(rows)) - np.maximum.accumulate(np.where(start, np.arange(len(rows)), 0)) < deep
        rows, cols = rows[keep], cols[keep]
        return pa.Table.from_batches([record_batch(_FOUND, q_ids[rows], ids[cols], np.add.reduce(q[rows] * x[cols], axis=1))])

    by = ["bucket", "part"]
    found = probes.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(compare, "q long, vec_id long, score double")
    return best(found, classes, members, k, deep)
