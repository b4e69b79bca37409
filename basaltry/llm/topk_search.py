"""Exact top-k by inner product: dual-tree search over cover trees.

Queries and data are indexed together: one set of pivots makes the top level of both trees, each
pivot's cell having covering radii for its data and for its queries.  For two nodes with centres a, b
and radii r, s no inner product of their points exceeds a.b + |a| s + |b| r + r s.  A pair of nodes is
pruned when that is under the worst kth score of the query group.

Cells are dealt over tasks.  A first pass searches each query's home cell and gives kth scores; a
second looks at the cell pairs that these leave; inside a task the two cover trees are walked
together down to leaves, which are compared by blocked products.  All scores are integers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, written
from .vectors import best, first_of_equals, matrix, query_classes, salt, same_width, usable

#: Pivots at most (they are broadcast), vectors (at least, and bytes of them at most) and queries of a cell that one task holds, points of a leaf of data and of queries.
PIVOTS, SAMPLE, BLOCK, BLOCK_BYTES, QUERY_BLOCK, LEAF, QUERY_LEAF = 256, 8192, 2048, 16 << 20, 4096, 64, 16
#: Points that a query group looks at before its worst kth score is taken anew.
STEP = 256
#: Scores beyond this (either sign) count as this; it leaves a lower long to mark empty places.
MOST = (1 << 63) - 2
#: Components beyond this (after scaling; only doubles have them) count as this, so that bounds stay finite.
HUGE = 1e150

_FOUND = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_SQL = "q long, vec_id long, score long"


@dataclass
class Node:
    """A centre (one of the points; of the root the mean), the largest distance of its points, their positions, and its children with their
    centres, lengths and radii as arrays."""

    centre: np.ndarray
    radius: float
    points: np.ndarray
    children: list[Node] = field(default_factory=list)
    centres: np.ndarray | None = None
    lengths: np.ndarray | None = None
    radii: np.ndarray | None = None


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    """A cover tree of the rows of x: children of a node cover its points within half its radius, and are centred on points
    farther apart than that.  Leaves have leaf points at most, or points that are all equal."""

    def build(points: np.ndarray, centre: np.ndarray) -> Node:
        d = np.sqrt(np.maximum(((x[points] - centre) ** 2).sum(axis=1), 0.0))
        node = Node(centre, float(d.max()) * (1 + 1e-12) if len(d) else 0.0, points)
        if len(points) <= leaf or node.radius == 0:
            return node
        own, half = x[points], node.radius / 2
        length = (own**2).sum(axis=1)
        far = None if len(points) > 4096 else length[:, None] + length - 2 * own @ own.T
        left, groups = np.arange(len(points)), []
        while len(left):
            first = left[0]
            row = (far[first] if far is not None else length + length[first] - 2 * own @ own[first])[left]
            near = row <= half * half
            near[0] = True
            groups.append(left[near])
            left = left[~near]
        if len(groups) == 1:  # all lie near the first point: go on from there
            d = np.sqrt(np.maximum(((own - own[0]) ** 2).sum(axis=1), 0.0))
            if float(d.max()) >= node.radius:
                return node
            return build(points, own[0])
        node.children = [build(points[g], own[g[0]]) for g in groups]
        node.centres = np.array([c.centre for c in node.children])
        node.lengths = np.linalg.norm(node.centres, axis=1)
        node.radii = np.array([c.radius for c in node.children])
        return node

    return build(np.arange(len(x)), x.mean(axis=0) if len(x) else np.zeros(x.shape[1]))


def _parts(node: Node) -> tuple[list[Node], np.ndarray, np.ndarray, np.ndarray]:
    if node.children:
        return node.children, node.centres, node.lengths, node.radii
    return [node], node.centre[None], np.array([np.linalg.norm(node.centre)]), np.array([node.radius])


def dual_tree(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray, looked: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query positions, data positions, scores) of the k best rows of x for each row of q with scores of at least floor.

    ids ascend, so that ties go to the smaller.  Of a pair of nodes the bounds of all pairs of children are found by one product;
    pairs under the worst kth score of their query group are pruned, the others taken best first.
    looked gets the number of scores that were computed.
    """
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1]) < 2**53
    empty = -np.inf if exact else -MOST - 1
    top = np.full((len(q), k), empty, dtype=np.float64 if exact else np.int64)
    who = np.full((len(q), k), -1, dtype=np.int64)
    qi, xi = (q, x) if exact else (_longs(q), _longs(x))

    def worst(a: Node) -> float:
        return float(np.maximum(np.where(who[a.points, -1] < 0, -np.inf, top[a.points, -1]), floor[a.points]).min())

    def evaluate(a: Node, part: np.ndarray) -> None:
        part = np.sort(part)
        s = qi[a.points] @ xi[part].T
        if looked is not None:
            looked.append(s.size)
        if not exact:
            _mend(s, q[a.points], x[part])
        both = np.concatenate([top[a.points], s], axis=1)
        names = np.concatenate([who[a.points], np.broadcast_to(part, s.shape)], axis=1)
        order = np.lexsort((names, -both), axis=1)[:, :k] if both.shape[1] <= 4 * k else _select(both, names, k)
        top[a.points] = np.take_along_axis(both, order, axis=1)
        who[a.points] = np.take_along_axis(names, order, axis=1)

    stack = [(cover_tree(q, QUERY_LEAF), cover_tree(x), np.inf)] if len(q) and len(x) else []
    while stack:
        a, b, reach = stack.pop()
        if reach < worst(a):
            continue
        if not a.children and not b.children:
            evaluate(a, b.points)
            continue
        mine, centres, lengths, radii = _parts(a)
        theirs, c2, l2, r2 = _parts(b)
        bound = centres @ c2.T + lengths[:, None] * r2 + radii[:, None] * l2 + radii[:, None] * r2
        bound += 1e-9 * np.abs(bound) + 1e-12 * (lengths + radii)[:, None] * (l2 + r2) + 1.0
        bound = np.maximum(bound, -float(MOST))
        for i, group in enumerate(mine):
            order = np.argsort(-bound[i], kind="stable")
            order = order[bound[i, order] >= worst(group)]
            leaves = [j for j in order.tolist() if not theirs[j].children] if not group.children else []
            inner = [j for j in order.tolist() if theirs[j].children or group.children]
            while leaves:  # the leaves with the best bounds first, some at a time
                some, size = [], 0
                while leaves and size < STEP:
                    some.append(theirs[j := leaves.pop(0)].points)
                    size += len(some[-1])
                evaluate(group, np.concatenate(some))
                least = worst(group)
                leaves = [j for j in leaves if bound[i, j] >= least]
            stack += [(group, theirs[j], float(bound[i, j])) for j in reversed(inner)]  # the best is on top
    ok = (who >= 0) & (top >= floor[:, None])
    rows, cols = np.nonzero(ok)
    return rows, who[rows, cols], top[rows, cols].astype(np.int64)


def _longs(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 2.0**62, x, 0.0).astype(np.int64)


def _mend(s: np.ndarray, q: np.ndarray, x: np.ndarray) -> None:
    """Scores whose sums may leave the range of a long, anew in integers of any length."""
    most = np.multiply.outer(np.abs(q).max(axis=1, initial=0), np.abs(x).max(axis=1, initial=0)) * max(1, x.shape[1])
    most = np.maximum(most, np.maximum.outer(np.abs(q).max(axis=1, initial=0), np.abs(x).max(axis=1, initial=0)))
    for i, j in np.argwhere(most >= 2.0**62).tolist():
        s[i, j] = min(MOST, max(-MOST, sum(int(a) * int(b) for a, b in zip(q[i].tolist(), x[j].tolist(), strict=True))))


def _select(scores: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(scores), k), dtype=np.int64)
    for i in range(len(scores)):
        some = np.flatnonzero(scores[i] >= kth[i])
        out[i] = some[np.lexsort((names[i, some], -scores[i, some]))[:k]]
    return out


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 1024, block_size: int | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """vectors, queries (vec_id, embedding) to query_id, rank (from 1), vec_id, score.

    Each component x counts as floor(scale * x).  A query's own id is no candidate.  Ties go to the
    smaller vec_id.  Left out are rows with a null id or vector, null or non-finite
    components.  Scores are exact; one beyond 2^63 - 2 (or under its negative) counts as that.
    Shorter vectors, empty ones too, count as filled up with zeros.  Repeated rows (same id, same vector) count once; an id with
    two vectors is two candidates, and a query with each: it gets the best of what they find.  Fewer candidates than k give fewer rows.
    """
    spark = vectors.sparkSession

    def count(x):
        y = x * scale  # from 2^53 on doubles are whole
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(F.greatest(F.lit(-HUGE), F.least(F.lit(HUGE), y)))

    whole = lambda df: usable(df, empty=True).select("vec_id", F.transform("v", count).alias("v"))
    data = written(first_of_equals(whole(vectors).distinct(), k + 1), "topk-data")
    classes, members, own = query_classes(whole(queries).distinct())
    deep = k + own

    n, width = data.agg(F.count("*"), F.max(F.size("v"))).first()
    width = width or 1
    if block_size is None:  # larger blocks meet fewer copies of queries, smaller ones more tasks
        most = max(BLOCK, min(16 * BLOCK, BLOCK_BYTES // (8 * width)))
        block_size = max(BLOCK, min(most, n // (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    some = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"].tolist()
    sample = np.zeros((len(some), width))
    for i, v in enumerate(some):
        sample[i, : len(v)] = v
    pivots = _pivots(sample, min(PIVOTS, max(1, n // block_size)))
    shared = spark.sparkContext.broadcast(pivots)

    home_schema = pa.schema([("id", pa.int64()), ("cell", pa.int32()), ("far", pa.float64()), ("v", pa.list_(pa.float64()))])

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            x, c = same_width(matrix(b["v"]), p)
            d = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * x @ c.T, 0.0))
            cell = d.argmin(axis=1)
            far = np.sqrt(((x - c[cell]) ** 2).sum(axis=1))
            yield record_batch(home_schema, b["id"], cell.astype(np.int32), far, b["v"])

    cells = "id long, cell int, far double, v array<double>"
    placed = written(data.select(F.col("vec_id").alias("id"), "v").mapInArrow(to_cells, cells), "topk-cells")
    asked = written(classes.select(F.col("q").alias("id"), "v").mapInArrow(to_cells, cells), "topk-asked")

    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # PIVOTS rows at most
    salts = {r["cell"]: -(-r["n"] // block_size) for r in stats}
    radius = {r["cell"]: r["radius"] for r in stats}
    salt_of = F.create_map(*[F.lit(x) for kv in salts.items() for x in kv]) if salts else F.create_map(F.lit(-1), F.lit(1))
    block = placed.withColumn("salt", salt("id", F.coalesce(salt_of[F.col("cell")], F.lit(1))))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], schema=_FOUND)
        q, x = same_width(matrix(left["v"]), matrix(right["v"]))
        ids = right["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        rows, found, scores = dual_tree(q, x[order], ids[order], deep, left["floor"].to_numpy().astype(np.float64))
        return pa.Table.from_batches([record_batch(_FOUND, left["id"].to_numpy()[rows], ids[order][found], scores)])

    def joined(pairs: DataFrame) -> DataFrame:
        """pairs (id, floor, v, cell, salt, part: which block of queries) against the data of (cell, salt)."""
        parts = pairs.groupBy("cell", "salt").agg(F.max("part").alias("last"))
        dealt = block.join(parts, ["cell", "salt"]).select("cell", "salt", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("part"), "id", "v")
        by = ["cell", "salt", "part"]
        return pairs.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(search, _FOUND_SQL)

    # first pass: a block of the home cell for each query
    n_queries = max(1, -(-asked.count() // query_block))
    first = asked.select("id", F.lit(float("-inf")).alias("floor"), "v", "cell", salt("id", F.coalesce(salt_of[F.col("cell")], F.lit(1))).alias("salt"), salt("id", n_queries).alias("part"))
    seeds = written(joined(first), "topk-first")
    floors = seeds.withColumn("r", F.row_number().over(_by_score())).where(F.col("r") == deep).select(F.col("q").alias("id"), F.col("score").cast("double").alias("floor"))
    known = asked.join(floors, "id", "left").select("id", "cell", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))

    # second pass: the cells whose bound reaches the query's kth score
    pair_schema = pa.schema([("id", pa.int64()), ("floor", pa.float64()), ("v", pa.list_(pa.float64())), ("cell", pa.int32()), ("salt", pa.int32()), ("part", pa.int32())])

    def surviving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        size = np.array([radius.get(c, -np.inf) for c in range(len(p))])
        for b in batches:
            x, c = same_width(matrix(b["v"]), p)
            floor, ids = b["floor"].to_numpy(), b["id"].to_numpy()
            length, far = np.linalg.norm(x, axis=1)[:, None], np.maximum(size, 0)
            reach = x @ c.T + length * far * (1 + 1e-9) + 1e-12 * length * (np.linalg.norm(c, axis=1) + far) + 1.0
            reach = np.maximum(reach, -float(MOST))
            rows, into = np.nonzero((reach >= floor[:, None]) & (size >= 0))
            row = np.repeat(rows, [salts[int(i)] for i in into])
            cell = np.repeat(into, [salts[int(i)] for i in into])
            each = np.concatenate([np.arange(salts[int(i)]) for i in into]) if len(into) else np.zeros(0, int)
            for at in range(0, len(row), 20_000):
                r = row[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(floor[r]), b["v"].take(pa.array(r)), pa.array(cell[at : at + 20_000], pa.int32()), pa.array(each[at : at + 20_000], pa.int32()), pa.array(np.zeros(len(r)), pa.int32())], schema=pair_schema)

    pairs = known.select("id", "floor", "v").mapInArrow(surviving, "id long, floor double, v array<double>, cell int, salt int, part int").withColumn("part", salt("id", n_queries))
    found = seeds.unionByName(joined(pairs))
    return best(found, classes, members, k, deep)


def _by_score():
    from pyspark.sql import Window

    return Window.partitionBy("q").orderBy(F.desc("score"), F.asc("vec_id"))


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Points of the sample, each the farthest from those before it (the net of a cover tree's top level)."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen, d = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]
