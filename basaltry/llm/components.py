"""Connected components of an edge table by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NAMES, drop_written, written


def _hung(edges: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """edges with the minimum m of u's neighbourhood; low: u, m, n (edges of u).

    Few edges are joined by broadcast.  Of more, nodes with more than a NAMES-th of all edges (so fewer than NAMES) are
    broadcast, and only the others meet their edges in a shuffle: a hub does not crowd a task.
    """
    if total <= NAMES:
        return edges.join(F.broadcast(low.drop("n")), "u")
    hub = F.col("n") > max(1 << 12, total // NAMES)
    hubs = low.where(hub).drop("n")
    rest = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti")
    return edges.join(F.broadcast(hubs), "u").unionByName(rest.join(low.where(~hub).drop("n"), "u"))


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Large star: each node hangs its larger neighbours on the smallest of its neighbourhood.  Small
    star: its smaller neighbours and itself.  Neighbourhoods are reduced to a minimum by a partial
    aggregation; no list of neighbours is ever built.  total: edges, about."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        return _hung(both.where("v > u"), low, 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return _hung(down, low, total).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (u, v: long) to rows (node, root): root is the smallest node of the component.

    Only nodes on an edge between two different nodes appear.  Rounds are few (logarithmic in the
    longest chain); each ends in a table in the shared folder, and a checksum of the table tells
    when nothing changes.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    state, total = None, now.count()
    while True:
        middle = _star(now, True, total)
        if total > NAMES:  # the small star reads it several times
            middle = written(middle, name)
        new = written(_star(middle, False, total), name)
        if total > NAMES:
            drop_written(middle)
        drop_written(now)
        now = new
        # a star forest is a fixed point: every u hangs on one v
        row = now.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state, total = tuple(row), row[0]
