"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

Two fingerprints within r bits agree on one of r + 1 slices of the bits.  So the tiles of the
comparison are runs of fingerprints with a common slice, in the order of their population counts: the
pairs outside common slices need no look.  Within a slice, tiles are compared by exclusive-or and bit
counts, and tile pairs whose population counts lie more than r apart are skipped.  A slice value
with too many fingerprints for one task is dealt over tasks tile pair by tile pair.  All of
this is exact: no link is lost.

Equal fingerprints are one vertex, so copies never meet each other in a comparison.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, record_batch, utf8, written
from .components import connected_components

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
#: Fingerprints of a slice that one task compares; more are split into tiles of at most so many.
TILE = 4096
#: Fingerprints whose names a join broadcasts at most (some MB).
NAMES = 1 << 16

_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each run of shingle words, repeats included; fewer words are one run, none give nothing."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # bytes.lower touches A-Z alone, bytes.split cuts at x20 and x09-x0D
    if not words:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *[e + 1 for e in ends[:-1]]]
    last = min(shingle, len(words)) - 1
    return np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[last:], strict=False)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 without any."""
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row of docs (doc_id, text); fp is the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, shingle) for t in utf8(b["text"])], dtype=np.uint64)
            yield record_batch(schema, b["doc_id"], prints.view(np.int64))

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(make, "doc_id long, fp long")


def _slices(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 slices."""
    edges = [BITS * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def compare_tiles(a: np.ndarray, b: np.ndarray, radius: int, side: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) within radius bits; a and b are sorted by population count."""
    ca, cb = np.bitwise_count(a), np.bitwise_count(b)
    for i in range(0, len(a), side):
        x = a[i : i + side]
        low, high = int(ca[i]) - radius, int(ca[min(i + side, len(a)) - 1]) + radius
        for j in range(int(np.searchsorted(cb, max(0, low))), int(np.searchsorted(cb, high, side="right")), side):
            near = np.bitwise_count(x[:, None] ^ b[None, j : j + side]) <= radius
            if near.any():
                u, v = np.nonzero(near)
                yield u + i, v + j


class _Forest:
    """Union-find over positions; few links of a tile pair are needed to join what it links."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def spanning_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that join whatever pairs of a x b (a x a without b) within radius join; at most a link a fingerprint."""
    a = np.unique(a)
    a = a[np.argsort(np.bitwise_count(a), kind="stable")]
    if b is not None:
        b = np.unique(b)
        b = b[np.argsort(np.bitwise_count(b), kind="stable")]
    shift, all_ = (len(a), np.concatenate([a, b])) if b is not None else (0, a)
    forest = _Forest(len(all_))
    for u, v in compare_tiles(a, a if b is None else b, radius):
        for x, y in zip(u.tolist(), (v + shift).tolist(), strict=True):
            if x != y:
                forest.join(x, y)
    signed = all_.view(np.int64).tolist()
    return [(signed[x], signed[r]) for x in range(len(all_)) if (r := forest.find(x)) != x]


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """prints (fp: distinct longs) to links (u, v) that connect all fingerprints within radius bits."""
    slices = F.array(*[F.struct(F.lit(i).alias("s"), F.shiftrightunsigned("fp", first).bitwiseAND((1 << n) - 1).alias("key")) for i, (first, n) in enumerate(_slices(radius))])
    cells = prints.select("fp", F.explode(slices).alias("c")).select("fp", "c.s", "c.key")
    # a slice value of few fingerprints is one run; others are counted by population count and tiled
    heavy = cells.groupBy("s", "key").count().where(F.col("count") > tile).select("s", "key")
    pops = F.bit_count("fp").cast("int")
    sizes = cells.join(heavy, ["s", "key"], "left_semi").groupBy("s", "key", pops.alias("pop")).agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    sizes = written(sizes, "simhash-sizes")  # one row for each population count of a heavy slice value
    plain = cells
    out = []
    if not sizes.isEmpty():
        plain = cells.join(sizes.select("s", "key").distinct(), ["s", "key"], "left_anti")
        table = sizes.groupBy("s", "key").agg(F.map_from_entries(F.collect_list(F.struct("pop", "tiles"))).alias("tiles"))  # 65 entries at most
        pop, mine = pops, F.col("tiles")[pops]
        dealt = cells.join(table, ["s", "key"]).select("s", "key", "fp", "tiles", pop.alias("pop"), F.pmod(F.xxhash64("fp"), mine).cast("int").alias("t"))
        # pairs with tiles of population counts 0 to radius above (as left side) and below (as right side)
        above = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda d: F.transform(F.sequence(F.lit(0), F.coalesce(F.try_element_at("tiles", F.col("pop") + d), F.lit(0)) - 1 + F.lit(0)), lambda t: F.struct((F.col("pop") + d).alias("pop2"), t.alias("t2")))))
        below = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda d: F.transform(F.sequence(F.lit(0), F.coalesce(F.try_element_at("tiles", F.col("pop") - d), F.lit(0)) - 1), lambda t: F.struct((F.col("pop") - d).alias("pop1"), t.alias("t1")))))
        left = dealt.select("s", "key", F.col("pop").alias("pop1"), F.col("t").alias("t1"), "fp", F.explode(F.filter(above, lambda x: x["t2"] >= 0)).alias("o")).select("s", "key", "pop1", "t1", "o.pop2", "o.t2", "fp", F.lit(0).alias("right"))
        right = dealt.select("s", "key", F.col("pop").alias("pop2"), F.col("t").alias("t2"), "fp", F.explode(F.filter(below, lambda x: x["t1"] >= 0)).alias("o")).select("s", "key", "o.pop1", "o.t1", "pop2", "t2", "fp", F.lit(1).alias("right"))
        by = ["s", "key", "pop1", "t1", "pop2", "t2"]

        def pair(t: pa.Table) -> pa.Table:
            fp, side = t["fp"].to_numpy().view(np.uint64), t["right"].to_numpy()
            found = spanning_links(fp[side == 0], fp[side == 1], radius)
            return pa.Table.from_batches([record_batch(_LINKS, [x for x, _ in found], [y for _, y in found])])

        same = (F.col("pop1") < F.col("pop2")) | (F.col("t1") <= F.col("t2"))  # each pair of tiles of one count once
        out.append(left.unionByName(right.select(left.columns)).where(same).groupBy(*by).applyInArrow(pair, "u long, v long"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, np.ndarray] | None = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                cell, fp = b["cell"].to_numpy(), b["fp"].to_numpy().view(np.uint64)
                if kept is not None:
                    cell, fp = np.concatenate([kept[0], cell]), np.concatenate([kept[1], fp])
            elif kept is not None:
                cell, fp = kept
            else:
                return
            edges = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
            if b is not None:  # the last run may go on in the next batch
                kept = (cell[edges[-2] :], fp[edges[-2] :]) if len(cell) else kept
                edges = edges[:-1]
            found = []
            for k in np.flatnonzero(np.diff(edges) > 1):
                found += spanning_links(fp[edges[k] : edges[k + 1]], None, radius)
            if found:
                yield record_batch(_LINKS, [x for x, _ in found], [y for _, y in found])

    cell = F.col("key") * len(_slices(radius)) + F.col("s")
    dealt = plain.select(cell.alias("cell"), "fp").repartition("cell").sortWithinPartitions("cell")
    out.append(dealt.mapInArrow(runs, "u long, v long"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _with_names(made: DataFrame, named: DataFrame) -> DataFrame:
    """Rows of made with those of named (one for each fp).  Up to NAMES of named are broadcast; of more those with the most copies,
    so few that they are no more than NAMES either, and the others are joined by fp: no fingerprint crowds a task."""
    if named.count() <= NAMES:
        return made.join(F.broadcast(named), "fp")
    heavy = named.where(F.col("copies") > max(1 << 12, made.count() // NAMES))
    rest = made.join(F.broadcast(heavy.select("fp")), "fp", "left_anti")
    return made.join(F.broadcast(heavy), "fp").unionByName(rest.join(named, "fp"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id, copies) for every row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach.  Null and empty texts have fingerprint
    zero and link like any other; rows with a null doc_id are kept and link, but name a component
    only if it has no other id (then it is null); copies is the number of rows with the very same fingerprint.
    Repeated rows come out as often as they went in.  Other columns are ignored.
    """
    made = written(fingerprints(docs, shingle), "simhash")
    vertices = written(made.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")), "simhash-vertices")
    roots = connected_components(links(vertices.select("fp"), radius, tile), "simhash-links")
    linked = vertices.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    low = linked.where("root is not null").groupBy("root").agg(F.min("low").alias("component"))
    named = written(linked.join(low, "root", "left").select("fp", "copies", F.coalesce("component", "low").alias("component_id")), "simhash-named")
    return _with_names(made, named).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")
