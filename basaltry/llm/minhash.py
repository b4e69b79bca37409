"""MinHash near-duplicates: signatures of many universal hash minima, banding, verification, connected components.

A document is its set of shingles; documents with equal sets are one class.  Each of BANDS x ROWS hash functions
h(x) = a x + b gives a set its minimum.  Two sets agree in a minimum with about their similarity J, so they share one of the bands of
ROWS minima but for a chance of (1 - J^ROWS)^BANDS: 7e-10 at J = 0.85, far less above.  Classes that share a band
form a group; a group's smallest class names a block, and a block is all classes that some group with this name
holds, so any two classes of a group are together in a block.  A block is searched twice.  First by signatures: classes go that no
other one of the block agrees with in as many minima as similar sets do (but for a chance of 1e-9).  Of what
is left one text of each class goes to its blocks (a set takes 8 bytes a word and hardly packs, a text less), its set is made
there, and pairs are counted exactly, but for those that links already join.  A
block that is too large for a task is dealt as pairs of tiles.  So what comes out joins all that similar pairs
join, with fewer links than members: never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, in_parts, join_named, only, record_batch, runs_of, small, utf8, written
from .components import connected_components
from .simhash import shingle_hashes
from .similar import SORTED, groups

SHINGLE, PERCENT, BANDS, ROWS = 3, 85, 36, 5
#: Signatures, and bytes of sets, that a tile holds; texts that a task remembers to leave out their copies.
TILE, TILE_BYTES, SEEN = 8192, 24 << 20, 1 << 18
#: Members that are hashed at a time.
STEP = 1024
#: Texts to fetch whose names (8 bytes each) a join broadcasts at most; beyond it all texts are shuffled.
WANTED = 1 << 22

_READ = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("mark", pa.int64()), ("sig", pa.binary())])
_READ_SQL = "doc_id long, key binary, n long, mark long, sig binary"
_BAND = pa.schema([("h", pa.int64()), ("key", pa.int64())])
_MEMBER = pa.schema([("block", pa.int64()), ("cid", pa.int64())])
_PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def family(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of n hash functions."""
    drawn = np.random.default_rng(seed).integers(0, 1 << 64, (2, n), dtype=np.uint64)
    return drawn[0] | np.uint64(1), drawn[1]


def signature(members: np.ndarray, factors: np.ndarray, summands: np.ndarray) -> np.ndarray:
    """16 bits of each function's minimum over a set (not empty) of 64-bit hashes."""
    low = np.full(len(factors), (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(members), STEP):
        np.minimum(low, (factors[:, None] * members[None, at : at + STEP] + summands[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(20)).astype("<u2")


def least_agreement(n: int, percent: int, miss: float = 1e-9) -> int:
    """The most equal minima that may be asked of n, so that sets of this similarity have fewer with a chance of miss or less."""
    p, under, k = percent / 100, 0.0, 0
    while k <= n:
        under += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if under > miss:
            return k
        k += 1
    return n


def partners(n: np.ndarray, sigs: np.ndarray, percent: int, least: int) -> np.ndarray:
    """Mask of the sets (sizes n, a row of sigs each) that agree with another one of possible size in least minima or more."""
    order = np.argsort(n, kind="stable")
    n, sigs, out = n[order], sigs[order], np.zeros(len(n), dtype=bool)
    ends = np.searchsorted(percent * n, 100 * n, side="right")
    for i in range(len(n)):
        later = slice(i + 1, ends[i])
        other = np.flatnonzero(~out[later]) + i + 1 if out[i] else np.arange(i + 1, ends[i])
        if len(other):
            other = other[(sigs[other] == sigs[i]).sum(axis=1) >= least]
            if len(other):
                out[i] = out[other] = True
    back = np.empty_like(out)
    back[order] = out
    return back


def spanning_links(sets: list[np.ndarray], sigs: np.ndarray, percent: int, least: int) -> list[tuple[int, int]]:
    """Links (positions) between sets of this similarity that join all that such pairs join; fewer than there are sets."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.argsort(size, kind="stable")
    n, sigs = size[order], sigs[order]
    names, ids, counts = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    # of each set the members that others have too, and an end mark that no set is asked for
    shared = counts[ids] > 1
    owner = np.repeat(np.arange(len(sets)), n)
    ids, owner = np.append(ids[shared], np.full(len(sets), len(names))), np.append(owner[shared], np.arange(len(sets)))
    ids = ids[np.argsort(owner, kind="stable")].astype(np.int32)
    starts = np.searchsorted(np.sort(owner), np.arange(len(sets) + 1))
    asked, part, out = np.zeros(len(names) + 1, dtype=bool), np.arange(len(sets)), []
    ends = np.searchsorted(percent * n, 100 * n, side="right")
    for i in range(len(sets)):
        other = np.flatnonzero(part[i + 1 : ends[i]] != part[i]) + i + 1
        if len(other):
            other = other[(sigs[other] == sigs[i]).sum(axis=1) >= least]
        if not len(other):
            continue
        asked[ids[starts[i] : starts[i + 1] - 1]] = True
        if len(other) <= 32:
            both = np.array([np.count_nonzero(asked[ids[starts[j] : starts[j + 1]]]) for j in other.tolist()])
        else:  # all from the first to the last of them, in one go
            first, last = other[0], other[-1]
            both = np.add.reduceat(asked[ids[starts[first] : starts[last + 1]]].astype(np.int32), starts[first : last + 1] - starts[first])[other - first]
        asked[ids[starts[i] : starts[i + 1] - 1]] = False
        for j in other[100 * both >= percent * (n[i] + n[other] - both)].tolist():
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                out.append((int(order[i]), int(order[j])))
    return out


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray | None]]]:
    """Small batches with the set of each text (None: no words)."""
    only("minhash")
    for b in in_parts(batches, 256):
        yield b, [np.unique(h) if len(h := shingle_hashes(t, shingle)) else None for t in utf8(b["text"])]


def _key(members: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(members.tobytes())


def _mark() -> Column:
    """XXH64 of a row's doc_id and text, which names one row of a class whose text is fetched."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text").alias("mark")


def read(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each row of docs (doc_id, text) doc_id, key (128 bits of its set, null if empty), n (its size), mark
    and sig (its signature, at the first of the copies that a task sees)."""
    given = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), _mark(), F.col("text").cast("binary").alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions, seen = family(bands * rows), set()
        for b, sets in _sets(batches, shingle):
            keys, sigs = [None if s is None else _key(s) for s in sets], []
            for key, members in zip(keys, sets, strict=True):
                fresh = key is not None and key not in seen
                sigs.append(signature(members, *functions).tobytes() if fresh else None)
                if fresh:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
            yield record_batch(_READ, b["doc_id"], keys, [0 if s is None else len(s) for s in sets], b["mark"], sigs)

    return given.mapInArrow(make, _READ_SQL)


def _tiled(what: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Rows of blocks, each for every pair of tiles (a, b) that it stands in.

    sizes: (block, size); blocks of more than most are cut into tiles.  There are few of those, each being large.
    """
    large = small(written(sizes.where(F.col("size") > most).select("block", F.ceil(F.col("size") / F.lit(most)).cast("int").alias("tiles")), "minhash-tiles"))
    out = what.join(large, "block", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    out = out.withColumn("t", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return out.withColumn("a", F.least("t", "o")).withColumn("b", F.greatest("t", "o")).drop("t", "o", "tiles")


def _dealt(tiled: DataFrame) -> DataFrame:
    return tiled.repartition("block", "a", "b").sortWithinPartitions("block", "a", "b")


def candidate_blocks(classes: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(block, cid): classes (cid, sig) that share a band are together in a block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        size = 2 * rows
        for b in in_parts(batches, 1024):
            found = [xxh64_intdigest(sig[k * size : (k + 1) * size], k) for sig in b["sig"].to_pylist() for k in range(bands)]
            yield record_batch(_BAND, np.array(found, dtype=np.uint64).view(np.int64), np.repeat(b["cid"].to_numpy(), bands))

    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), bands * classes.count() // SORTED)  # so that a task sorts little at a time
    met = classes.select("cid", "sig").mapInArrow(cut, "h long, key long").repartition(parts, "h").sortWithinPartitions("h", "key")
    return met.mapInArrow(groups, "block long, key long").toDF("block", "cid").distinct()


def similar_links(docs: DataFrame, classes: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Links (u, v: cids) that join the classes which pairs of similarity percent / 100 or more join.

    classes (written): cid, key, n, mark, sig, one row for each different set of docs that is not empty.
    """
    least = least_agreement(bands * rows, percent)
    by = ["block", "a", "b"]
    blocks = written(candidate_blocks(classes, bands, rows), "minhash-blocks")
    sigs = lambda run: np.frombuffer(b"".join(run["sig"].to_pylist()), "<u2").reshape(run.num_rows, -1)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs_of(batches, by):
            if run.num_rows > 1 and (mask := partners(run["n"].to_numpy(), sigs(run), percent, least)).any():
                cids = run["cid"].combine_chunks().filter(pa.array(mask))
                yield record_batch(_MEMBER, [run["block"][0].as_py()] * len(cids), cids)

    counted = blocks.groupBy("block").agg(F.count("*").alias("size"))
    near = written(_dealt(_tiled(blocks.join(classes.select("cid", "n", "sig"), "cid"), counted, TILE)).mapInArrow(verified, "block long, cid long").distinct(), "minhash-near")
    needed = written(near.select("cid").distinct().join(classes, "cid"), "minhash-needed")

    # of each class one row's text; another row with that mark has another key, and goes
    marks = needed.select("mark")
    texts = docs.select(_mark(), F.col("text").cast("binary").alias("text")).where("text is not null")
    texts = texts.join(F.broadcast(marks) if marks.count() <= WANTED else marks, "mark", "left_semi").repartition("mark").distinct()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("minhash")
        for run in runs_of(batches, by):
            if run.num_rows < 2:
                continue
            own: dict[int, tuple[int, np.ndarray]] = {}
            for at, (cid, key, text) in enumerate(zip(run["cid"].to_pylist(), run["key"].to_pylist(), run["text"], strict=True)):
                if cid not in own and _key(members := np.unique(shingle_hashes(text.as_py(), shingle))) == key:
                    own[cid] = at, members
            cids = list(own)
            if len(own) > 1 and (found := spanning_links([x for _, x in own.values()], sigs(run)[[at for at, _ in own.values()]], percent, least)):
                yield record_batch(_PAIR, [cids[i] for i, _ in found], [cids[j] for _, j in found])

    weights = near.join(needed.select("cid", "n"), "cid").groupBy("block").agg(F.sum(8 * F.col("n") + 512).alias("size"))
    going = _tiled(near, weights, TILE_BYTES).join(needed.drop("n"), "cid")
    return _dealt(texts.join(going, "mark").drop("mark")).mapInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    Linked are documents whose sets of shingles (distinct; A-Z in lower case, words parted by ASCII white space; fewer words are
    one shingle) have 100 |A and B| >= percent |A or B|.  component_id is the smallest doc_id that links reach, a null one only
    if there is no other.  Documents without words (null, empty, blank) have an empty set and are alone.  kept: doc_id is
    component_id.  Repeated rows come out as often as they went in; rows with one doc_id and other texts are documents of
    their own.  Other columns are ignored.
    """
    table = written(read(docs, shingle, bands, rows), "minhash-read")
    same: Column = F.max("sig")  # equal sets have equal signatures
    found = table.where("key is not null").groupBy("key").agg(F.max("n").alias("n"), F.min("mark").alias("mark"), F.min("doc_id").alias("low"), F.count("*").alias("copies"), same.alias("sig"))
    classes = written(found.withColumn("cid", F.monotonically_increasing_id()), "minhash-classes")
    roots = connected_components(similar_links(docs, classes, shingle, percent, bands, rows), "minhash-links").toDF("cid", "root")
    named = classes.select("cid", "key", "low", "copies").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    names = written(named.join(lows, "root").select("key", "copies", "component_id"), "minhash-names")
    full = table.where("key is not null").select("doc_id", "key", F.col("n").alias("n_shingles"))
    out = join_named(full, names, ["key"], "copies").select("doc_id", "n_shingles", "component_id")
    alone = table.where("key is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
