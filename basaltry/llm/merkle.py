"""A Merkle manifest of a dataset: a tree for each value of a column, and a tree over their roots.

Leaves have places in their tree's order.  Superblock reduction: places are bucketed by fanout^k, each bucket
is collapsed by k levels in one call, and the buckets' roots are the nodes of the next round, so a tree of n leaves takes
log(n) / log(fanout^k) rounds, and no call sees more than fanout^k nodes.  Proofs go the other way: the proof of a node is what its
bucket says, and then the proof of the bucket's root.

Digests are lowercase hex SHA-256 of their parts, one after another, digests as hex text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_names, join_named, small, written

FANOUT, LEVELS = 2, 10
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE_SQL = "tree long, place long, nodes long, digest string"
_OWN = ("tree", "place", "nodes", "trees", "leaf", "subroot", "root", "proof")


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def depth(nodes: int, fanout: int = FANOUT) -> int:
    """Levels from so many nodes to one."""
    out = 0
    while nodes > 1:
        nodes, out = -(-nodes // fanout), out + 1
    return out


def next_level(digests: list[str], fanout: int = FANOUT) -> list[str]:
    return [sha(*digests[i : i + fanout]) for i in range(0, len(digests), fanout)]


def fold(leaf: str, proof: str, path: list[tuple[int, int]], fanout: int = FANOUT) -> str:
    """The root that a leaf and its proof lead to; path: place and number of leaves in each of the trees, lowest first."""
    at = 0
    for place, nodes in path:
        while nodes > 1:
            first = place - place % fanout
            run = min(fanout, nodes - first)
            others = [proof[at + 64 * i : at + 64 * (i + 1)] for i in range(run - 1)]
            at += 64 * (run - 1)
            leaf = sha(*others[: place - first], leaf, *others[place - first :])
            place, nodes = place // fanout, -(-nodes // fanout)
    return leaf


def leaf_digest(columns: dict[str, Column]) -> Column:
    """SHA-256 of the values one after another: '-' for null, else number of UTF-8 bytes, ':' and value."""
    as_text = [c.cast("string") for c in columns.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in as_text]).cast("binary"), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (written; tree: long, ...) with place (from 0, in the order given) and nodes, the number of rows, within their tree.

    Rows are dealt by range and sorted there; what places need of other partitions is a row count for each
    partition and tree, so no partition waits for another and none holds a tree.
    """
    (mark,) = fresh_names(rows, "mark")
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn(mark, F.monotonically_increasing_id())
    table = written(dealt, "merkle-sorted")  # the mark is partition and place within it
    part = F.shiftright(mark, 33)
    runs = table.groupBy("tree", part.alias("run_part")).agg(F.count("*").alias("run_rows"), F.min(mark).alias("run_first"))
    mine = Window.partitionBy("tree")
    before = F.coalesce(F.sum("run_rows").over(mine.orderBy("run_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = written(runs.select(F.col("tree").alias("run_tree"), "run_part", (before - F.col("run_first")).alias("run_shift"), F.sum("run_rows").over(mine).alias("nodes")), "merkle-runs")
    same = (F.col("tree") == F.col("run_tree")) & (part == F.col("run_part"))
    return table.join(small(runs), same).withColumn("place", F.col(mark) + F.col("run_shift")).drop(mark, "run_tree", "run_part", "run_shift")


def collapsed(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """nodes (tree, place, nodes, digest) some levels higher: one row for each bucket of fanout^levels places."""
    size = fanout**levels

    def up(key: tuple, bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values("place")
        digests, n = bucket["digest"].tolist(), int(bucket["nodes"].iloc[0])
        for _ in range(min(levels, depth(n, fanout))):
            digests = next_level(digests, fanout)
        return pd.DataFrame({"tree": [key[0]], "place": [key[1]], "nodes": [-(-n // size)], "digest": digests})

    return nodes.select("tree", "place", "nodes", "digest").groupBy("tree", F.floor(F.col("place") / F.lit(size)).alias("bucket")).applyInPandas(up, _NODE_SQL)


def rounds(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """nodes (written) and what each round makes of them, up to one node for each tree."""
    out = [nodes]
    most = nodes.agg(F.max("nodes")).first()[0] or 1
    while True:
        out.append(written(collapsed(out[-1], fanout, levels), "merkle-nodes"))
        most = -(-most // fanout**levels)
        if most == 1:
            return out


def with_proofs(nodes: DataFrame, upper: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """nodes with the columns of upper but tree and place (upper: a row for each bucket), where proof is what the bucket
    says of the node, followed by upper's."""
    size = fanout**levels
    mine = [c for c in nodes.columns]
    given = [c for c in upper.columns if c not in ("tree", "place")]
    kinds = {f.name: f.dataType for f in [*nodes.schema, *upper.schema]}
    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in [*mine, *given])

    def down(key: tuple, bucket: pa.Table, above: pa.Table) -> pa.Table:
        if not bucket.num_rows:
            return pa.table({c: pa.array([], bucket.schema.field(c).type) for c in mine} | {c: pa.array([], above.schema.field(c).type) for c in given})
        bucket = bucket.sort_by("place")
        digests, n = bucket["digest"].to_pylist(), bucket["nodes"][0].as_py()
        proofs = [[] for _ in digests]
        for level in range(min(levels, depth(n, fanout))):
            width = fanout**level
            for i, proof in enumerate(proofs):
                at = i // width
                first = at - at % fanout
                proof += [digests[j] for j in range(first, min(first + fanout, len(digests))) if j != at]
            digests = next_level(digests, fanout)
        rest = above["proof"][0].as_py()
        more = {c: pa.array(["".join(p) + rest for p in proofs], above.schema.field(c).type) if c == "proof" else pa.array([above[c][0].as_py()] * len(proofs), above.schema.field(c).type) for c in given}
        return pa.table({c: bucket[c] for c in mine} | more)

    def by(df: DataFrame, bucket: Column):
        return df.withColumn("bucket_", bucket).groupBy("tree", "bucket_")

    left = by(nodes, F.floor(F.col("place") / F.lit(size)))
    right = by(upper, F.col("place"))

    def without(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        return down(key, a.drop_columns(["bucket_"]), b.drop_columns(["bucket_"]))

    return left.cogroup(right).applyInArrow(without, schema)


def _proved(tables: list[DataFrame], top: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The first of tables (from rounds) with proofs; top: what each tree's root has, proof and others (tree, place 0)."""
    upper = top
    for nodes in reversed(tables[1:-1]):
        upper = written(with_proofs(nodes, upper, fanout, levels).drop("nodes", "digest"), "merkle-proofs")
    return with_proofs(tables[0], upper, fanout, levels)


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, tree: str = "lang", order: str = "doc_id", keep: tuple[str, ...] = (), fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """A row for each row of docs: order, tree (number of its tree), place and nodes in it, trees, leaf, subroot, root, proof, keep.

    A leaf is the digest of the columns named.  Rows with one value of the column tree (null is a value, the
    first) are the leaves of a tree, in the order of the column order (nulls first), equal ones by leaf, so
    repeated rows are leaves next to each other.  While a level has several nodes, each fanout of them (the
    last run may be shorter, even one) make a node of the next; one leaf alone is its own root.  The
    trees' roots, by the value's UTF-8 bytes, are the leaves of a last tree.  proof holds the digests of the others in each
    run from the leaf up to root, in their order.  Null, empty and long texts are values like others; no rows give none.
    Other columns are ignored; keep names columns (none of the result's own names) that rows take along.
    """
    if clash := {c.lower() for c in keep} & {*_OWN, order.lower()}:
        raise ValueError(f"keep names columns of the result: {sorted(clash)}")
    kept = {f"keep_{i}": c for i, c in enumerate(keep)}
    leaf = leaf_digest({c: F.col(c) for c in columns})
    leaves = written(docs.select(F.col(tree).cast("string").alias("label"), F.col(order).alias("at"), leaf.alias("digest"), *[F.col(c).alias(k) for k, c in kept.items()]), "merkle-leaves")
    labels = written(leaves.groupBy("label").agg(F.count("*").alias("rows")).withColumn("tree", F.lit(0).cast("long")), "merkle-labels")
    numbers = written(placed(labels, ["label"]).select("label", "rows", F.col("place").alias("tree")), "merkle-trees")
    named = join_named(leaves, numbers, ["label"], "rows").drop("label", "rows")
    nodes = written(placed(written(named, "merkle-named"), ["at", "digest"]), "merkle-nodes")
    tables = rounds(nodes, fanout, levels)
    subroots = tables[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "digest")
    tops = rounds(written(subroots.withColumn("nodes", F.lit(subroots.count()).cast("long")), "merkle-subroots"), fanout, levels)
    start = tops[-1].select("tree", "place", F.col("digest").alias("root"), F.lit("").alias("proof"))
    top = _proved(tops, start, fanout, levels).select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), F.col("nodes").alias("trees"), F.col("digest").alias("subroot"), "root", "proof")
    out = _proved(tables, written(top, "merkle-top"), fanout, levels)
    return out.select(F.col("at").alias(order), "tree", "place", "nodes", "trees", F.col("digest").alias("leaf"), "subroot", "root", "proof", *[F.col(k).alias(c) for k, c in kept.items()])


def folded(rows: DataFrame, leaf: str = "leaf", name: str = "folded_root", fanout: int = FANOUT) -> DataFrame:
    """rows of a manifest with one more column: the root that the digest in the column leaf leads to by the row's proof."""
    columns = rows.columns
    schema = rows.withColumn(name, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ways = zip(b["place"].to_pylist(), b["nodes"].to_pylist(), b["tree"].to_pylist(), b["trees"].to_pylist(), strict=True)
            roots = [fold(x, p, [(i, n), (t, m)], fanout) for x, p, (i, n, t, m) in zip(b[leaf].to_pylist(), b["proof"].to_pylist(), ways, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in columns], pa.array(roots, pa.string())], names=[*columns, name])

    return rows.mapInArrow(run, schema)


def tamper_report(docs: DataFrame, tampered: Column, columns: tuple[str, ...] = COLUMNS, field: str = "n_chars", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The manifest's digests of docs, and what verification says where tampered holds and 1 was added to field.

    Columns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.  A null field stays null.
    """
    (shown,) = fresh_names(docs, "shown_leaf")
    changed = {c: F.when(tampered, F.col(c).cast("decimal(38,0)") + 1).otherwise(F.col(c).cast("decimal(38,0)")) if c == field else F.col(c) for c in columns}
    rows = manifest(docs.withColumn(shown, leaf_digest(changed)), columns, keep=(shown,), fanout=fanout, levels=levels)
    return folded(rows, shown, fanout=fanout).select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
