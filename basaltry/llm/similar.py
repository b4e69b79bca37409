"""Near copies by word shingles: the links of an exact set-similarity join (Jaccard 4/5 or more).

Sets of similarity 4/5 share 4/5 of the larger one's members.  So with the members of every set in one
common order, the first n - ceil(4 n / 5) + 1 members of the two sets meet: texts that share no
such member are not similar.  The order puts members last that many texts have, as counted
in chunks over all texts; it decides cost, never the result.

The texts that share a member form a group, whose smallest text names a block; a block is all texts
that some group with this name holds.  Any two texts of a group are together in a block, and a text
is in few blocks, since near copies share most of their members.  A block is searched twice.  First by parity
sketches, which differ in no more bits than their sets in members: texts without a partner go.  Of the others the sets are
compared, in the order of their sizes: pairs already joined by links are skipped, then those that sketches tell
apart; what is left is compared exactly.  A block of more than TILE bytes is dealt over tasks as pairs of tiles.  What
comes out joins all that similar pairs join, with less than one link for each text of a block: never all pairs.

Texts are known by two XXH64 (key, other), members by that of their words.  Members are met under key alone, which is enough to find candidates:
texts that share it come out both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, fresh_names, in_parts, join_named, only, record_batch, runs_of, small, utf8, written
from .components import connected_components
from .simhash import links, majority, shingle_hashes

SHINGLE = 5
#: Members of texts that are counted together, and members at most whose counts order the prefixes (they are broadcast).
CHUNK, COMMON = 1 << 21, 1 << 20
#: Keys that a join broadcasts at most; beyond it is shuffled.  Texts from which on a member is hot: its rows are not sent to one task.
BROADCAST_ROWS, HOT = 1 << 20, 1 << 16
#: Members of prefixes that a task sorts, about.
SORTED = 1 << 20
#: Bytes of sets that a tile holds, bits of a sketch, texts that a task remembers to leave out their copies.
TILE, PARITY, SEEN = 32 << 20, 1024, 1 << 18

_READ = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("other", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("members", pa.binary()), ("counts", pa.binary())])
_READ_SQL = "doc_id long, key long, other long, fp long, n long, sketch binary, members binary, counts binary"
_COUNT = pa.schema([("h", pa.int64()), ("c", pa.int64())])
_PREFIX = pa.schema([("h", pa.int64()), ("key", pa.int64()), ("hot", pa.bool_())])
_SET = pa.schema([("key", pa.int64()), ("other", pa.int64()), ("members", pa.binary())])
_PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_TEXT = pa.schema([("block", pa.int64()), ("key", pa.int64())])
_MEMBER = pa.schema([("block", pa.int64()), ("tid", pa.int64())])


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of shingle words as sorted hashes; fewer words are one shingle, none are an empty set."""
    return np.unique(shingle_hashes(text, shingle))


def prefix(members: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The members that every set of similarity 4/5 has one of, rare ones first; common (sorted) are often as frequent."""
    n = len(members)
    at = np.minimum(np.searchsorted(common, members), max(0, len(common) - 1))
    rank = np.where(common[at] == members, often[at], 0) if len(common) else np.zeros(n, dtype=np.int64)
    return members[np.lexsort((members, rank))[: n + (-4 * n) // 5 + 1]]


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, key), sorted, to (block, key): block is the smallest key of an h that several keys have."""
    last, block = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        h, key = b["h"].to_numpy(), b["key"].to_numpy()
        new = np.concatenate([[last is None or h[0] != last], h[1:] != h[:-1]])
        firsts = np.concatenate([[block], key[new]])  # the run that the last batch ended with, then those that begin here
        blocks = firsts[np.cumsum(new)]
        last, block = h[-1], int(blocks[-1])
        own = np.unique(blocks[key != blocks])
        yield record_batch(_TEXT, np.concatenate([blocks[key != blocks], own]), np.concatenate([key[key != blocks], own]))


def parity(members: np.ndarray) -> np.ndarray:
    """A bit for each hash class: whether the set has an odd number of members in it.  Large sets have longer sketches."""
    bits = min(1 << 16, max(PARITY, 1 << int(2 * len(members)).bit_length()))
    return np.packbits(np.bincount((members % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).view(np.uint64)


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """The shorter sketch of the same set."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _near(n: np.ndarray, sketches: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Of sets in the order of their sizes n each one's later ones that sketches do not tell apart from it.

    What is sent back is a mask of the later ones that need no look (or nothing).
    """
    words = np.array([len(x) for x in sketches])
    ends = np.searchsorted(4 * n, 5 * n, side="right")
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i in range(len(n)):
        other = np.arange(i + 1, ends[i])
        skip = yield i, other
        other = other if skip is None else other[~skip]
        if not len(other):
            yield i, other
            continue
        w = int(words[i])
        if w not in known:  # sizes of similar sets are so close that sketches are as long, or twice as long
            held = np.flatnonzero((words == w) | (words == 2 * w))
            place = np.full(len(n), -1)
            place[held] = np.arange(len(held))
            known[w] = place, np.array([fold(sketches[j], w) for j in held])
        place, folded = known[w]
        found = []
        for at in range(0, len(other), 4096):
            some = other[at : at + 4096]
            apart = np.bitwise_count(folded[place[some]] ^ folded[place[i]]).sum(axis=1, dtype=np.int64)
            found.append(some[9 * apart <= n[some] + n[i]])
        yield i, np.concatenate(found)


def block_partners(n: np.ndarray, sketches: list[np.ndarray]) -> np.ndarray:
    """Mask of the sets that have a partner which their sketches do not tell apart from them."""
    order = np.argsort(n, kind="stable")
    out = np.zeros(len(n), dtype=bool)
    walk = _near(n[order], [sketches[i] for i in order])
    for i, other in walk:
        i, other = walk.send(out[order[other]]) if out[order[i]] else walk.send(np.zeros(len(other), dtype=bool))
        if len(other):
            out[order[i]] = out[order[other]] = True
    return out


def block_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (positions) that join all that pairs of similarity 4/5 or more join; fewer than there are sets."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.argsort(n, kind="stable")
    part, out = np.arange(len(sets)), []
    walk = _near(n[order], [parity(sets[i]) for i in order])
    for i, other in walk:
        i, other = walk.send(part[other] == part[i])
        for j in other.tolist():
            if part[j] != part[i] and similar(sets[order[i]], sets[order[j]]):
                part[part == part[j]] = part[i]
                out.append((int(order[i]), int(order[j])))
    return out


def semi(df: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """A semi, anti or left join with written keys; up to BROADCAST_ROWS of them move no row of df."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)


def named(text: str, *names: str) -> list[Column]:
    """Two independent hashes of a text, which together are its identity; the first alone serves to find candidates."""
    return [F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit("other"), text).alias(names[1])]


def read(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text) doc_id, key and other (of the text), fp (SimHash of its shingles) and n (their number);
    besides, rows with a null key that count the members which several texts of a chunk have."""
    keyed = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), *named("text", "key", "other"), F.col("text").cast("binary").alias("text"))

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(sets), return_counts=True)
        return record_batch(_READ, [None], [None], [None], [None], [None], [None], [h[c > 1].tobytes()], [c[c > 1].astype("<u4").tobytes()])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size, seen = [], 0, set()
        only("similar")
        for b in in_parts(batches, 256):
            prints, ns, sketches = np.zeros(b.num_rows, dtype=np.uint64), [], []
            keys = zip(b["key"].to_pylist(), b["other"].to_pylist(), strict=True)
            for i, (key, text) in enumerate(zip(keys, utf8(b["text"]), strict=True)):
                hashes = shingle_hashes(text, SHINGLE)
                prints[i] = majority(hashes)
                members = np.unique(hashes)
                ns.append(len(members))
                sketches.append(parity(members).tobytes())
                if key not in seen:
                    seen.add(key)
                    sets.append(members)
                    size += len(members)
                    if size >= CHUNK:
                        yield counted(sets)
                        sets, size, seen = [], 0, set()
            none = [None] * b.num_rows
            yield record_batch(_READ, b["doc_id"], b["key"], b["other"], prints.view(np.int64), ns, sketches, none, none)
        if sets:
            yield counted(sets)

    return keyed.mapInArrow(make, _READ_SQL)


def _common(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of the members that are counted in table the most frequent ones (COMMON at most), sorted, and their counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, c in zip(b["members"].to_pylist(), b["counts"].to_pylist(), strict=True):
                yield record_batch(_COUNT, np.frombuffer(h, "<i8"), np.frombuffer(c, "<u4").astype(np.int64))

    counts = table.where("members is not null").select("members", "counts").mapInArrow(rows, "h long, c long")
    total = written(counts.groupBy("h").agg(F.sum("c").alias("c")), "similar-common")
    held, least = 0, 1 << 20
    for c, n in sorted(total.groupBy(F.least("c", F.lit(least)).alias("c")).count().collect(), reverse=True):  # a row for each count
        held += n
        if held > COMMON:
            break
        least = c
    kept = total.where(F.col("c") >= least).limit(COMMON).toArrow()
    h, c = kept["h"].to_numpy().view(np.uint64), kept["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def similar_links(docs: DataFrame, table: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v: tids) that join the texts which pairs with a Jaccard similarity of 4/5 or more join.

    table: what read(docs) gave, texts: tid, key, other, n and sketch of its different texts, both written.  Texts without words are in no link.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_common(table))
    keyed = docs.select(*named("text", "key", "other"), F.col("text").cast("binary").alias("text")).where("text is not null")

    limit = HOT

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        """(key, other) and set of each text; copies in one task mostly once."""
        seen = set()
        only("similar")
        for b in in_parts(batches, 256):
            for *key, text in zip(b["key"].to_pylist(), b["other"].to_pylist(), utf8(b["text"]), strict=True):
                if (key := tuple(key)) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    if len(members := shingles(text)):
                        yield key, members

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        common, often = shared.value
        most = common[often >= limit]
        for key, members in once(batches):
            p = prefix(members, common, often)
            out.append((p.view(np.int64), np.full(len(p), key[0]), np.isin(p, most)))
            size += len(p)
            if size >= 1 << 16:
                yield record_batch(_PREFIX, *map(np.concatenate, zip(*out, strict=True)))
                out, size = [], 0
        if out:
            yield record_batch(_PREFIX, *map(np.concatenate, zip(*out, strict=True)))

    met = written(keyed.mapInArrow(prefixes, "h long, key long, hot boolean"), "similar-prefixes")
    # few members are hot: their smallest keys are broadcast; of the others each one's texts pass through a task in order
    hot = met.where("hot").select("h", "key")
    lowest = small(written(hot.groupBy("h").agg(F.min("key").alias("block")), "similar-hot"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), met.count() // SORTED)  # so that a task sorts little at a time
    cold = met.where("not hot").select("h", "key").repartition(parts, "h").sortWithinPartitions("h", "key").mapInArrow(groups, "block long, key long")
    clash = texts.groupBy(F.col("key").alias("block")).count().where("count > 1").select("block", F.col("block").alias("key"))
    blocks = written(cold.unionByName(hot.join(lowest, "h").select("block", "key")).unionByName(clash).distinct(), "similar-blocks")
    by = ["block", "a", "b"]

    def dealt(what: DataFrame, size: Column) -> DataFrame:
        """Rows of blocks, each for every pair of tiles (a, b) that it stands in, sorted by block and pair."""
        tiles = what.groupBy("block").agg(F.ceil(F.sum(size) / F.lit(TILE)).cast("int").alias("tiles")).where("tiles > 1")
        tiles = small(written(tiles, "similar-tiles"))  # few blocks are as large as that
        mine = F.pmod(F.xxhash64("tid"), F.col("tiles")).cast("int")
        out = what.join(tiles, "block", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("t", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        out = out.withColumn("a", F.least("t", "o")).withColumn("b", F.greatest("t", "o")).drop("t", "o", "tiles")
        return out.repartition(*by).sortWithinPartitions(*by)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs_of(batches, by):
            if run.num_rows > 1:
                tids = run["tid"].combine_chunks()
                mask = block_partners(run["n"].to_numpy(), [np.frombuffer(x, np.uint64) for x in run["sketch"].to_pylist()])
                if mask.any():
                    tids = tids.filter(pa.array(mask))
                    yield record_batch(_MEMBER, [run["block"][0].as_py()] * len(tids), tids)

    held = blocks.join(texts.select("key", "tid", "n", "sketch"), "key").drop("key")
    near = written(dealt(held, F.octet_length("sketch")).mapInArrow(paired, "block long, tid long").distinct(), "similar-near")
    needed = written(near.select("tid").distinct().join(texts.select("tid", "key", "other"), "tid"), "similar-needed")

    def make_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, members in once(batches):
            yield record_batch(_SET, [key[0]], [key[1]], [members.tobytes()])

    known = ["key", "other"]
    sets = semi(keyed, needed.select(known), known, "left_semi").mapInArrow(make_sets, "key long, other long, members binary").dropDuplicates(known)
    sets = written(sets.join(needed, known).select("tid", "members"), "similar-sets")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs_of(batches, by):
            tids = run["tid"].to_pylist()
            if found := block_links([np.frombuffer(x, "<u8") for x in run["members"].to_pylist()]):
                yield record_batch(_PAIR, [tids[i] for i, _ in found], [tids[j] for _, j in found])

    return dealt(near.join(sets, "tid"), F.octet_length("members")).mapInArrow(search, "u long, v long")


def without_near_copies(docs: DataFrame, radius: int = 2) -> DataFrame:
    """docs (doc_id, text, others) with one row of each group of near copies.

    Linked are texts whose SimHash fingerprints of five-word shingles differ in radius bits or fewer, and texts whose sets of
    five-word shingles have a Jaccard similarity of 0.8 or more; a group is what links reach.  The row that stays
    is the one with the smallest doc_id (null ids last), of several texts with that id the one with
    the smallest hash; of rows with this id and this text the first by their other columns as JSON.  Rows are judged by id and text
    together, so another text with the same id is judged by itself.  Null texts, empty ones and those without words are copies of
    each other.
    """
    table = written(read(docs), "near-read")
    rows = table.where("key is not null")
    low = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    # rows of a text have equal n, fp and sketch
    texts = rows.groupBy("key", "other").agg(F.min("fp").alias("fp"), F.min(low).alias("low"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    texts = written(texts.withColumn("tid", F.monotonically_increasing_id()), "near-texts")
    first = written(texts.groupBy("fp").agg(F.min("tid").alias("first"), F.count("*").alias("texts")), "near-first")
    same = join_named(texts.select("tid", "fp"), first, ["fp"], "texts").where("tid <> first").select(F.col("tid").alias("u"), F.col("first").alias("v"))
    first = first.select("fp", "first")
    near = links(first.select("fp"), radius).join(first.toDF("u", "a"), "u").join(first.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = connected_components(same.unionByName(near).unionByName(similar_links(docs, table, texts)), "near-links").toDF("tid", "root")
    judged = texts.join(roots, "tid", "left").select("key", "other", "low", "copies", F.coalesce("root", "tid").alias("root"))
    stays = judged.groupBy("root").agg(F.min(F.struct("low", "key", "other")).alias("stays"), F.sum("copies").alias("rows"), F.count("*").alias("texts")).where("rows > 1")
    # of each text with anything to drop: the id of the row that stays, and whether any row does
    text, text2, kept, stay_id = fresh_names(docs, "text_key", "text_key2", "text_stays", "id_stays")
    own = (F.col("key") == F.col("stays.key")) & (F.col("other") == F.col("stays.other"))
    verdict = join_named(judged, written(stays, "near-stays"), ["root"], "texts").select(F.col("key").alias(text), F.col("other").alias(text2), own.alias(kept), F.col("low.doc_id").alias(stay_id))
    left = semi(docs.select("*", *named("text", text, text2)), written(verdict, "near-verdict"), [text, text2], "left")
    id_ = F.col("doc_id").cast("long")
    left = left.where(F.col(kept).isNull() | (F.col(kept) & id_.eqNullSafe(F.col(stay_id)))).select(*docs.columns, text, text2)
    again = written(rows.groupBy("doc_id", "key", "other").count().where("count > 1").select("key", "other").distinct().toDF(text, text2), "near-again")
    if again.isEmpty():
        return left.select(docs.columns)
    (rank,) = fresh_names(left, "rank")
    order = Window.partitionBy(id_, text, text2).orderBy(F.to_json(F.struct(*docs.columns)))
    few = semi(left, again, [text, text2], "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    return semi(left, again, [text, text2], "left_anti").select(docs.columns).unionByName(few.select(docs.columns))
