"""Local graph analysis: degrees, sweep cuts, time-dependent personalised PageRank, communities, spectral embedding.

Graphs are EdgeDFs (src, dst): both directions, no loops, distinct.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import drop, written
from .matrix import as_lists, block
from .svd import SVDParams, chebyshev_diff, symmetric_svd_rows


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("degree"))


def num_edges(edges: DataFrame) -> int:
    """Directed edges: two for each undirected one."""
    return edges.count()


def _in_order(rows: DataFrame, order: list, name: str, count: str) -> DataFrame:
    """rows, written, with a column count: their places from 0 in the order.  Ranges of rows are numbered by themselves, and
    the ranges' sizes (one number each) are added."""
    placed = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), name)
    return _summed(placed.withColumn(count, F.lit(1)), order, [count]).withColumn(count, F.col(count) - 1)


def _summed(placed: DataFrame, order: list, columns: list[str]) -> DataFrame:
    """Running sums of columns in the order, over all ranges of _in_order."""
    totals = placed.groupBy("range").agg(*[F.sum(c) for c in columns]).orderBy("range").collect()  # a row for each range
    before, rows = [0] * len(columns), []
    for r in totals:
        rows.append((r[0], *before))
        before = [a + b for a, b in zip(before, r[1:], strict=True)]
    kinds = ", ".join(f"before_{c} long" for c in columns)
    offsets = placed.sparkSession.createDataFrame(rows, f"range int, {kinds}")
    run = Window.partitionBy("range").orderBy(*order)
    out = placed.join(F.broadcast(offsets), "range")
    return out.select(*[(F.col(f"before_{c}") + F.sum(c).over(run)).cast("long").alias(c) if c in columns else F.col(c) for c in placed.columns])


def vertex_index(edges: DataFrame) -> DataFrame:
    """(vertex, id): ids from 0 in the order of vertices."""
    v = edges.select(F.col("src").alias("vertex")).distinct()
    return _in_order(v, ["vertex"], "vertices", "id").select("vertex", "id")


def adjacency(edges: DataFrame, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(CoordDF of ones, index)."""
    index = vertex_index(edges) if index is None else index
    a = edges.join(index.withColumnRenamed("vertex", "src").withColumnRenamed("id", "i"), "src").join(index.withColumnRenamed("vertex", "dst").withColumnRenamed("id", "j"), "dst")
    return a.select("i", "j", F.lit(1.0).alias("v")), index


# -- sweep cut ------------------------------------------------------------------------------------------


def sweep(edges: DataFrame, scores: DataFrame, total: int | None = None) -> DataFrame:
    """scores (vertex, y): the prefixes of vertices by falling y / degree, ties by vertex.

    position, vertex, volume, cut and conductance = cut / min(volume, total - volume) of each prefix (1 where
    that is 0).  An edge into the prefix lowers the cut by one, any other raises it.
    """
    total = num_edges(edges) if total is None else total
    by = [F.desc("rank"), F.asc("vertex")]
    scored = scores.join(degrees(edges), "vertex").select("vertex", "degree", (F.col("y") / F.col("degree")).alias("rank"))
    ranked = written(_in_order(scored, by, "sweep", "place"), "sweep-ranked")
    place = ranked.select(F.col("vertex").alias("dst"), F.col("place").alias("other"))
    inner = edges.join(place, "dst").select(F.col("src").alias("vertex"), "other")
    back = ranked.select("vertex", "place").join(inner, "vertex").where("other < place").groupBy("vertex").agg(F.count("*").alias("inside"))
    steps = ranked.join(back, "vertex", "left").withColumn("volume", F.col("degree")).withColumn("cut", F.col("degree") - 2 * F.coalesce("inside", F.lit(0)))
    out = _summed(written(steps.select("range", "place", "vertex", "volume", "cut"), "sweep-steps"), ["place"], ["volume", "cut"])
    low = F.least(F.col("volume"), F.lit(total) - F.col("volume"))
    return out.select((F.col("place") + 1).cast("int").alias("position"), "vertex", "volume", "cut", F.when(low > 0, F.col("cut") / low).otherwise(1.0).alias("conductance"))


# -- time-dependent personalised PageRank -----------------------------------------------------------


@dataclass(frozen=True)
class PPRParams:
    alpha: float = 0.85
    gamma: float = 5.0
    epsilon: float = 1e-3
    times: int = 4
    rounds: int = 1000


def bessel_i(n: int, x: float) -> float:
    """Modified Bessel function of the first kind by its series."""
    term = math.exp(n * math.log(x / 2) - math.lgamma(n + 1)) if x else float(n == 0)
    total, k = term, 1
    while term > 1e-17 * total:
        term *= (x / 2) ** 2 / (k * (k + n))
        total += term
        k += 1
    return total


def collocation_size(p: PPRParams) -> int:
    c = 20 * math.sqrt(10) * math.exp(-p.gamma / 2)
    n = 10
    while c * bessel_i(n, p.gamma) * 0.8**n > p.epsilon / (p.gamma * (1 + 2 / math.pi * math.log(n - 1))):
        n += 1
    return -(-n // p.times) * p.times


def _diffusion_matrix(n: int, gamma: float) -> np.ndarray:
    """Solves u' + u = r on the Chebyshev points of [0, gamma] with u(0) = last entry of the argument."""
    d = chebyshev_diff(n, 0.0, gamma) + np.eye(n)  # points run from gamma down to 0
    first = d[: n - 1, : n - 1]
    inv = np.linalg.pinv(first)
    out = np.zeros((n, n))
    out[: n - 1, : n - 1] = inv
    out[: n - 1, n - 1] = -inv @ d[: n - 1, n - 1]
    out[n - 1, n - 1] = 1.0
    return out


def _residual_bound(p: PPRParams) -> float:
    """The residual that a vertex may keep for each of its edges."""
    lam = 1 + 2 / math.pi * math.log(collocation_size(p) - 1)
    return (1 - p.alpha) * p.epsilon / ((1 - math.exp((p.alpha - 1) * p.gamma)) * lam) if p.alpha < 1 else p.epsilon / (p.gamma * lam)


def time_dependent_ppr(edges: DataFrame, seeds: dict, params: PPRParams | None = None) -> DataFrame:
    """(vertex, y: array of `times` values): diffusion from the seeds at times gamma, ..., gamma / times.

    Residuals live on the vertices that the diffusion has touched.  In each round every vertex whose
    residual exceeds its bound is solved for and passes its change on along its edges (a join of the
    frontier with the edges and a grouped sum); the rounds end when no residual is over its bound.

    The method is local: a vertex is solved for only while its residual exceeds its share of epsilon, and each time the sum of residuals
    falls by that much, so the edges of all touched vertices number in the order of gamma / epsilon, whatever the
    graph's size.  That bounds the state on the driver and what is broadcast.  If `rounds` do not suffice, it raises.
    """
    p, spark = params or PPRParams(), edges.sparkSession
    n = collocation_size(p)
    m = _diffusion_matrix(n, p.gamma)
    c = _residual_bound(p)
    kind = dict(edges.dtypes)["src"]
    deg = degrees(edges)
    edge = edges.join(deg.select(F.col("vertex").alias("dst"), "degree"), "dst").select("src", "dst", "degree").persist()
    pick = [t * n // p.times for t in range(p.times)]
    # the frontier's state is small (a local method): it lives with the driver, edges stay where they are
    start = spark.createDataFrame([(v,) for v in seeds], f"vertex {kind}")
    at: dict = {}
    ids, held, r, y = [], np.zeros(0), np.zeros((0, n)), np.zeros((0, n))

    def rows_of(vertices: list, degree: np.ndarray) -> np.ndarray:
        """Rows of the state of vertices; those that are new get one."""
        nonlocal held, r, y
        new = [i for i, v in enumerate(vertices) if v not in at]
        at.update((vertices[i], len(ids) + k) for k, i in enumerate(new))
        ids.extend(vertices[i] for i in new)
        held = np.concatenate([held, degree[new]])
        r, y = (np.concatenate([x, np.zeros((len(new), n))]) for x in (r, y))
        return np.fromiter((at[v] for v in vertices), np.int64, len(vertices))

    first = deg.join(F.broadcast(start), "vertex").collect()
    rows = rows_of([v for v, _ in first], np.array([d for _, d in first], float))
    r[rows, n - 1] = [seeds[v] for v, _ in first]
    try:
        for k in range(p.rounds):
            hot = np.flatnonzero(np.abs(r).max(axis=1) > c * held) if k else np.arange(len(ids))  # seeds always count
            if not len(hot):
                break
            if k == p.rounds - 1:
                raise RuntimeError(f"the diffusion has not come to rest after {p.rounds} rounds: raise epsilon or rounds")
            delta = r[hot] @ m.T
            y[hot] += delta
            r[hot] = 0.0
            sent = spark.createDataFrame(pa.table({"src": pa.array([ids[i] for i in hot]), "x": as_lists((p.alpha / held[hot])[:, None] * delta[:, : n - 1])}))
            # a sum for each place of the arrays: no row of its own for a place of an edge
            got = edge.join(F.broadcast(sent.select(F.col("src").cast(kind).alias("src"), "x")), "src").groupBy("dst").agg(F.max("degree").alias("degree"), F.array(*[F.sum(F.col("x")[i]) for i in range(n - 1)]).alias("x"))
            got = got.toArrow().combine_chunks()
            if got.num_rows:
                rows = rows_of(got["dst"].to_pylist(), got["degree"].to_numpy().astype(float))
                r[rows, : n - 1] += block(got["x"].combine_chunks())
        kept = np.flatnonzero(y[:, 0] != 0)
        out = pa.table({"vertex": pa.array([ids[i] for i in kept], None if len(kept) else pa.string()), "y": as_lists(y[kept][:, pick])})
        return spark.createDataFrame(out).select(F.col("vertex").cast(kind).alias("vertex"), "y")
    finally:
        edge.unpersist()


def local_cluster(edges: DataFrame, seeds: list, params: PPRParams | None = None, recursive: bool = False) -> tuple[list, float]:
    """(cluster, conductance): the best sweep cut over the diffusion's times, from seeds of equal mass.

    recursive starts again from the cluster found while that improves it.
    """
    p, spark = params or PPRParams(), edges.sparkSession
    total, best, cond = num_edges(edges), list(seeds), None
    while True:
        y = time_dependent_ppr(edges, dict.fromkeys(best, 1.0 / len(best)), p).persist()
        own = edges.join(y.select(F.col("vertex").alias("src")), "src", "left_semi").persist()  # whatever a sweep looks at
        found, value = None, cond
        for t in range(p.times):
            at = sweep(own, y.select("vertex", F.col("y")[t].alias("y")), total).persist()
            top = at.orderBy("conductance", "position").first()
            if top is not None and (value is None or top["conductance"] < 0.999999 * value):
                found, value = [x[0] for x in at.where(F.col("position") <= top["position"]).orderBy("position").select("vertex").collect()], top["conductance"]
            at.unpersist()
        own.unpersist()
        y.unpersist()
        if found is None:
            return best, cond if cond is not None else 1.0
        best, cond = found, value
        if not recursive:
            return best, cond


# -- many seeds in one plan -----------------------------------------------------------------------------

#: Rows of a frontier that are broadcast to the edges at most; larger ones are joined.
FRONTIER = 1 << 14


def diffuse_many(edges: DataFrame, starts: DataFrame, params: PPRParams | None = None) -> DataFrame:
    """(seed, vertex, degree, y): the diffusions of time_dependent_ppr from many seeds at once.

    starts (seed, vertex, mass) says where the diffusion named seed begins.  The state of all diffusions is one table of (seed,
    vertex); a round solves for all vertices that are over their bounds, joins them with the edges and adds up what they pass
    on, so a round costs one plan for however many seeds, and nothing of it is on the driver.
    """
    p = params or PPRParams()
    n = collocation_size(p)
    m, c = _diffusion_matrix(n, p.gamma), _residual_bound(p)
    pick = [t * n // p.times for t in range(p.times)]
    deg = degrees(edges)
    arcs = written(edges.join(deg.select(F.col("vertex").alias("dst"), "degree"), "dst").select("src", "dst", "degree"), "diffuse-arcs")
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    state = starts.join(deg, "vertex").select("seed", "vertex", "degree", F.concat(zeros(n - 1), F.array(F.col("mass").cast("double"))).alias("r"), zeros(p.times).alias("y"), F.lit(True).alias("hot"))
    state = written(state, "diffuse")
    schema = state.drop("hot").withColumn("sent", zeros(n)).schema

    def solve(batches):
        for b in batches:
            if not b.num_rows:
                continue
            r, y, degree = block(b["r"]), block(b["y"]), b["degree"].to_numpy()
            hot = b["hot"].to_numpy(zero_copy_only=False)
            delta = r @ m.T
            y = np.where(hot[:, None], y + delta[:, pick], y)
            sent = np.concatenate([delta[:, : n - 1] * (p.alpha / degree)[:, None], np.zeros((len(r), 1))], axis=1)
            sent[~hot] = 0.0
            left = np.where(hot[:, None], 0.0, r)
            yield pa.RecordBatch.from_arrays([b["seed"], b["vertex"], b["degree"], as_lists(left), as_lists(y), as_lists(sent)], names=schema.names)

    total = lambda name, k: F.array(*[F.sum(F.col(name)[i]) for i in range(k)]).alias(name)
    for _ in range(p.rounds):
        hot = state.where("hot")
        busy = hot.count()
        if not busy:
            return state.where(F.col("y")[0] != 0).select("seed", "vertex", "degree", "y")
        solved = state.mapInArrow(solve, schema)
        front = hot.mapInArrow(solve, schema).select("seed", F.col("vertex").alias("src"), "sent")
        front = F.broadcast(front) if busy <= FRONTIER else front
        moved = arcs.join(front, "src").select("seed", F.col("dst").alias("vertex"), "degree", F.col("sent").alias("r"), zeros(p.times).alias("y"))
        both = solved.drop("sent").unionByName(moved)
        sums = both.groupBy("seed", "vertex").agg(F.max("degree").alias("degree"), total("r", n), total("y", p.times))
        over = F.array_max(F.transform("r", F.abs)) > c * F.col("degree")
        old, state = state, written(sums.withColumn("hot", over), "diffuse")
        drop(old)
    raise RuntimeError(f"the diffusion has not come to rest after {p.rounds} rounds: raise epsilon or rounds")


def sweep_many(edges: DataFrame, y: DataFrame, times: int, total: int) -> DataFrame:
    """(seed, t, conductance, position, members) of the best prefix at each time t; y (written): what diffuse_many gave.

    Vertices of a diffusion are ranked within it (a local method: they are few); an edge is looked at once for all times.
    """
    ranked = y.select("seed", "vertex", "degree", F.array(*[F.row_number().over(Window.partitionBy("seed").orderBy(F.desc(F.col("y")[t] / F.col("degree")), "vertex")) for t in range(times)]).alias("place"))
    ranked = written(ranked, "sweep-places")
    inner = ranked.select("seed", "vertex", "place").join(edges.select(F.col("src").alias("vertex"), "dst"), "vertex")
    inner = inner.join(ranked.select("seed", F.col("vertex").alias("dst"), F.col("place").alias("other")), ["seed", "dst"])
    inside = inner.groupBy("seed", "vertex").agg(*[F.count_if(F.col("other")[t] < F.col("place")[t]).alias(f"in{t}") for t in range(times)])
    steps = written(ranked.join(inside, ["seed", "vertex"], "left"), "sweep-inside")
    every = F.array(*[F.struct(F.lit(t).alias("t"), F.col("place")[t].alias("position"), (F.col("degree") - 2 * F.coalesce(F.col(f"in{t}"), F.lit(0))).alias("cut")) for t in range(times)])
    each = steps.select("seed", "degree", F.explode(every).alias("e")).select("seed", "degree", "e.*")
    so_far = Window.partitionBy("seed", "t").orderBy("position")
    cuts = each.select("seed", "t", "position", F.sum("degree").over(so_far).alias("volume"), F.sum("cut").over(so_far).alias("cut"))
    low = F.least(F.col("volume"), F.lit(total) - F.col("volume"))
    cuts = cuts.withColumn("conductance", F.when(low > 0, F.col("cut") / low).otherwise(1.0))
    best = cuts.groupBy("seed", "t").agg(F.min(F.struct("conductance", "position")).alias("b"))
    # the first time counts, and any later one that is better by more than rounding
    tops = best.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("t", "b.conductance", "b.position"))).alias("tops"))
    better = lambda a, x: F.when(a["t"].isNull() | (x["conductance"] < 0.999999 * a["conductance"]), x).otherwise(a)
    none = F.struct(F.lit(None).cast("int").alias("t"), F.lit(None).cast("double").alias("conductance"), F.lit(None).cast("int").alias("position"))
    chosen = tops.select("seed", F.aggregate("tops", none, better).alias("c")).select("seed", "c.*")
    members = ranked.join(chosen, "seed").where(F.expr("place[t]") <= F.col("position"))
    return members.select("seed", "t", "conductance", "position", "vertex")


def parts(edges: DataFrame) -> DataFrame:
    """(vertex, part): the smallest vertex that each one is connected with.  A round hooks parents to the smallest grandparent near and
    takes grandparents for parents, so rounds number in the logarithm of the graph's width, and each is joins and a grouped minimum."""
    state = written(edges.groupBy(F.col("src").alias("vertex")).agg(F.min(F.least("src", "dst")).alias("f")), "parts")
    while True:
        grand = state.join(state.select(F.col("vertex").alias("f"), F.col("f").alias("g")), "f").select("vertex", "f", "g")
        near = edges.join(grand.select(F.col("vertex").alias("dst"), F.col("g").alias("h")), "dst").groupBy(F.col("src").alias("vertex")).agg(F.min("h").alias("h"))
        each = written(grand.join(near, "vertex"), "parts-near")
        hooked = each.select(F.col("f").alias("vertex"), F.col("h").alias("new"), F.lit(None).cast(dict(state.dtypes)["f"]).alias("old"))
        own = each.select("vertex", F.least("f", "g", "h").alias("new"), F.col("f").alias("old"))
        both = written(own.unionByName(hooked).groupBy("vertex").agg(F.min("new").alias("f"), F.max("old").alias("old")), "parts")
        drop(state)
        drop(each)
        state = both.select("vertex", "f")
        if both.where("f <> old").isEmpty():
            return state.withColumnRenamed("f", "part")


def _whole(edges: DataFrame, found: DataFrame) -> DataFrame:
    """found with the whole part, at conductance 0, for seeds whose cut is above 0 though their part is not all of the graph."""
    open_ = written(found.where("conductance > 0").select("seed").distinct(), "cluster-open")
    if open_.isEmpty():
        return found
    part = parts(edges)
    if part.select("part").distinct().limit(2).count() < 2:
        return found
    mine = open_.join(part.withColumnRenamed("vertex", "seed"), "seed").join(part, "part").select("seed", "vertex", F.lit(0.0).alias("conductance"))
    return found.where("conductance <= 0").unionByName(mine)


def clusters_of(edges: DataFrame, seeds: DataFrame, params: PPRParams | None = None, recursive: bool = False, whole: bool = False) -> DataFrame:
    """(seed, vertex, conductance): a row for each member of the local cluster of every seed of seeds (seed: its vertex), as local_cluster
    finds them one by one.  recursive starts again from the clusters found while that improves them.  Seeds without edges are left out.
    whole: where the diffusion ends before it has reached a seed's whole part of a graph in parts, the part, whose cut is 0, is its cluster."""
    p, spark = params or PPRParams(), edges.sparkSession
    total = num_edges(edges)
    starts = seeds.select("seed", F.col("seed").alias("vertex"), F.lit(1.0).alias("mass"))
    done: DataFrame | None = None
    while True:
        y = written(diffuse_many(edges, starts, p), "cluster-diffused")
        found = written(sweep_many(edges, y, p.times, total).select("seed", "vertex", "conductance"), "cluster-found")
        if done is None:
            done, better = found, found
        else:
            old = done.groupBy("seed").agg(F.min("conductance").alias("old"))
            now = found.groupBy("seed").agg(F.min("conductance").alias("new"))
            gain = written(now.join(old, "seed").where("new < 0.999999 * old").select("seed"), "cluster-better")
            better = found.join(gain, "seed", "left_semi")
            done = written(done.join(gain, "seed", "left_anti").unionByName(better), "cluster-best")
        if not recursive or better.isEmpty():
            return _whole(edges, done) if whole else done
        size = better.groupBy("seed").agg((1.0 / F.count("*")).alias("mass"))
        starts = better.select("seed", "vertex").join(size, "seed")


#: Directed edges up to which a graph is broadcast as an array of neighbours (eight bytes each).
HELD_EDGES = 1 << 25


class _Held:
    """A graph as arrays: the neighbours of vertex i are ends[starts[i]:starts[i + 1]]."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.starts, self.ends = starts, ends
        self.degree = np.diff(starts)

    def diffuse(self, seeds: dict[int, float], p: PPRParams) -> tuple[np.ndarray, np.ndarray]:
        """Touched vertices and their values at the diffusion's times: the rounds of time_dependent_ppr."""
        n, c = collocation_size(p), _residual_bound(p)
        solve = _diffusion_matrix(n, p.gamma)
        place = {v: i for i, v in enumerate(seeds)}
        names = list(seeds)
        left, y = np.zeros((len(names), n)), np.zeros((len(names), n))
        left[:, n - 1] = list(seeds.values())
        for k in range(p.rounds):
            degree = self.degree[names]
            hot = np.arange(len(names)) if not k else np.flatnonzero(np.abs(left).max(axis=1) > c * degree)
            if not len(hot):
                break
            if k == p.rounds - 1:
                raise RuntimeError(f"the diffusion has not come to rest after {p.rounds} rounds: raise epsilon or rounds")
            delta = left[hot] @ solve.T
            y[hot] += delta
            left[hot] = 0.0
            sent = delta[:, : n - 1] * (p.alpha / degree[hot])[:, None]
            near = [self.ends[self.starts[names[i]] : self.starts[names[i] + 1]] for i in hot]
            for v in np.unique(np.concatenate(near)).tolist():
                if v not in place:
                    place[v] = len(names)
                    names.append(v)
            grow = len(names) - len(left)
            left, y = (np.vstack([a, np.zeros((grow, n))]) for a in (left, y))
            for x, ends in zip(sent, near, strict=True):
                left[[place[v] for v in ends.tolist()], : n - 1] += x  # neighbours are distinct
        times = [t * n // p.times for t in range(p.times)]
        kept = y[:, 0] != 0
        return np.array(names)[kept], y[kept][:, times]

    def best_cut(self, vertices: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float] | None:
        order = np.lexsort((vertices, -y / self.degree[vertices]))
        total, inside, volume, cut, best = len(self.ends), set(), 0, 0, None
        for k, v in enumerate(vertices[order].tolist()):
            ends = self.ends[self.starts[v] : self.starts[v + 1]].tolist()
            volume += len(ends)
            cut += len(ends) - 2 * sum(e in inside for e in ends)
            inside.add(v)
            low = min(volume, total - volume)
            value = cut / low if low > 0 else 1.0
            if best is None or value < best[1]:
                best = k, value
        return None if best is None else (vertices[order][: best[0] + 1], best[1])

    def cluster(self, seed: int, p: PPRParams, recursive: bool) -> tuple[list[int], float]:
        chosen, value = [seed], None
        while True:
            vertices, y = self.diffuse(dict.fromkeys(chosen, 1.0 / len(chosen)), p)
            found = None
            for t in range(p.times):
                cut = self.best_cut(vertices, y[:, t])
                if cut is not None and (value is None or cut[1] < 0.999999 * value):
                    found, value = cut[0].tolist(), cut[1]
            if found is None:
                return chosen, 1.0 if value is None else value
            chosen = found
            if not recursive:
                return chosen, value


def communities(edges: DataFrame, seeds: list | None = None, params: PPRParams | None = None, recursive: bool = False) -> DataFrame:
    """(seed, cluster, conductance): the local cluster of every seed, of every vertex if none are named; seeds without edges are left out.

    A graph of up to HELD_EDGES edges is broadcast, and seeds are dealt over tasks.  For a larger one all seeds diffuse in one plan
    (clusters_of).
    """
    p, spark, kind = params or PPRParams(), edges.sparkSession, dict(edges.dtypes)["src"]
    edges = written(edges.select("src", "dst"), "community-edges")
    index = written(vertex_index(edges), "community-index")
    wanted = index if seeds is None else index.join(spark.createDataFrame([(s,) for s in seeds], f"vertex {kind}"), "vertex", "left_semi")
    if edges.count() > HELD_EDGES:
        found = clusters_of(edges, wanted.select(F.col("vertex").alias("seed")), p, recursive)
        return found.groupBy("seed").agg(F.sort_array(F.collect_set("vertex")).alias("cluster"), F.max("conductance").alias("conductance"))
    arcs, _ = adjacency(edges, index)
    table = arcs.select("i", "j").orderBy("i", "j").toArrow()
    starts = np.searchsorted(table["i"].to_numpy(), np.arange(index.count() + 1))
    shared = spark.sparkContext.broadcast(_Held(starts, table["j"].to_numpy()))

    def run(batches):
        for b in batches:
            for seed in b["id"].to_pylist():
                cluster, value = shared.value.cluster(seed, p, recursive)
                yield pa.RecordBatch.from_arrays([pa.array([seed] * len(cluster)), pa.array(cluster, pa.int64()), pa.array([value] * len(cluster))], names=["s", "v", "conductance"])

    found = wanted.select("id").repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(run, "s long, v long, conductance double")
    named = found.join(index.toDF("seed", "s"), "s").join(index.toDF("vertex", "v"), "v")
    return named.groupBy("seed").agg(F.sort_array(F.collect_list("vertex")).alias("cluster"), F.max("conductance").alias("conductance"))


def spectral_embedding(edges: DataFrame, rank: int, iterations: int = 2, seed: int = 0, absolute: bool = False) -> tuple[DataFrame, np.ndarray]:
    """(vertex, x: array) with x = V sqrt(eigenvalue) of the adjacency matrix, and the eigenvalues.

    Negative eigenvalues count as 0 with a warning, or by their absolute value.
    """
    edges = written(edges, "embedding-edges")
    index = written(vertex_index(edges), "embedding-index")
    a, _ = adjacency(edges, index)
    v, values = symmetric_svd_rows(a, index.count(), rank, SVDParams(num_iterations=iterations), seed)
    if (values < 0).any() and not absolute:
        warnings.warn("negative eigenvalues are taken as 0", stacklevel=2)
    scale = np.sqrt(np.abs(values) if absolute else np.maximum(values, 0))
    x = F.zip_with("features", F.array(*map(F.lit, scale.tolist())), lambda a, b: a * b)
    return v.select(F.col("row_id").alias("id"), x.alias("x")).join(index, "id").select("vertex", "x"), values
