"""LM scoring: stupid backoff over n-gram counts of the whole corpus.

The plan is relational: documents explode into n-grams, a count table partitioned by hash is grouped from them,
the counts are joined back to the exploded n-grams and summed by document.  A row for each n-gram would take several
times the input's size in every exchange, so rows are blocks.  A chunk of documents is one row; it sends every
hash range that its n-grams fall into one row with their sorted hashes and counts.  A hash range adds up what chunks
sent (its part of the count table) and answers each with the counts of its n-grams in the same order; a chunk joins
the answers to its documents' n-grams and sums.  A chunk sends an n-gram once however often it occurs, and a
block for a range only where it has n-grams there, so rows are never more than chunks' different n-grams.

An n-gram is known by 62 bits of hash: among 10^13 different ones about one in half a million shares its count with another.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, record_batch, utf8, written

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
HASH_BITS = 62
#: Text of a chunk (a longer document is one by itself), and text whose n-grams a hash range counts, in bytes.
CHUNK, RANGE = 8 << 20, 8 << 20
WORDS_KEPT = 400_000

_DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("train", pa.bool_()), ("score", pa.bool_())])
_CHUNK = pa.schema([("chunk", pa.int64()), ("docs", pa.binary())])
_SENT = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
#: seal: XXH64 of the n-grams that the counts are of, in their order.
_BACK = pa.schema([("chunk", pa.int64()), ("range", pa.int32()), ("seal", pa.int64()), ("counts", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_sum", pa.float64()), ("n_unigram", pa.int64()), ("n_backoff", pa.int64()), ("train", pa.bool_()), ("score", pa.bool_())])


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h


_WORDS = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def ngrams(texts: list[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words of each text, each word's place in its text, and for n = 1 to order the hash of the n-gram
    that ends at each word (meaningless where the text has fewer words before)."""
    get, parts, sizes = _WORDS.__getitem__, [], np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        words = (t or b"").lower().split()
        sizes[i] = len(words)
        if words:
            parts.append(np.fromiter(map(get, words), np.uint64, len(words)))
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, run = [], h
    for n in range(order):
        if n:
            run = np.concatenate([run[:1], _mix(run[:-1]) + h[1:]])
        out.append(_mix(run + np.uint64(n + 1)) >> np.uint64(64 - HASH_BITS))
    return sizes, place, out


def _pack(a: np.ndarray) -> bytes:
    """Byte planes of an integer array under zstandard."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def _unpack(raw: bytes, dtype: str) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _keys(texts: list[bytes | None], order: int):
    sizes, place, hashes = ngrams(texts, order)
    real = [place >= n for n in range(order)]
    every = np.concatenate([h[r] for h, r in zip(hashes, real, strict=True)])
    return sizes, place, real, every


def _ranges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The hash range of each key, ascending with the keys."""
    return ((keys >> np.uint64(HASH_BITS - 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in their order as rows of about CHUNK bytes of text each."""
    first, n, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

    def row() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _DOCS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.Table.from_batches(held, schema=_DOCS).combine_chunks())
        return record_batch(_CHUNK, [first + n], [sink.getvalue().to_pybytes()])

    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b["text"]), 0)
        at = 0
        for i, s in enumerate(sizes.to_pylist()):
            if size and size + s > CHUNK:
                held.append(b.slice(at, i - at).cast(_DOCS))
                yield row()
                at, n, held, size = i, n + 1, [], 0
            size += s
        held.append(b.slice(at).cast(_DOCS))
    if sum(h.num_rows for h in held):
        yield row()


def _seal(keys: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(np.ascontiguousarray(keys, dtype="<u8").tobytes())).view(np.int64))


def _documents(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def lm_scores(docs: DataFrame, train: DataFrame | None = None, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """Score docs (doc_id, text) by counts of train (by default docs themselves): a row for each document.

    doc_id, n_words, log_score (natural log, summed over its words), mean_log_score, n_backoff (words whose
    longest n-gram was not used).  Words are cut at ASCII white space with A-Z lowered.  A word's score
    is count(n-gram) / count(context) for the longest n-gram of at most order words with a count of
    min_count or more, times alpha for each order left out; single words count from 1, unknown words as 1; they
    are divided by the number of words.  Null and empty texts have log_score 0 and a null mean; rows that repeat count as often
    as they stand; a null doc_id is scored like any other.  Counts come back to a chunk of documents with a seal of the n-grams they are
    of; should a lost executor's chunk have been made anew with other documents (input in an order that is not fixed), the job fails.
    """
    flagged = lambda df, t, s: df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.lit(t).alias("train"), F.lit(s).alias("score"))
    rows = flagged(bounded(docs), True, True) if train is None else flagged(bounded(docs), False, True).unionByName(flagged(train, True, False))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(1 << 31, max(12, -(-size // RANGE)))
    chunks = rows.mapInArrow(_to_chunks, "chunk long, docs binary").repartition("chunk")  # one exchange, read by both passes

    def send(key: tuple, table: pa.Table) -> pa.Table:
        table = _documents(table["docs"][0].as_py())
        sizes, _, real, every = _keys(utf8(table["text"]), order)
        train_ = table["train"].to_numpy(zero_copy_only=False)
        if train_.all():
            every.sort()
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            keys, counts = every[first], np.diff(np.append(first, len(every))).astype("<u4")
        else:
            trained = np.repeat(train_.astype(np.int64), sizes)
            keys, inverse = np.unique(every, return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate([trained[r] for r in real]), minlength=len(keys)).astype("<u4")
        into = _ranges(keys, ranges)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(into)) + 1, [len(keys)]]).tolist()
        name = key[0].as_py()
        out = [(int(into[s]), name, e - s, _pack(np.diff(keys[s:e], prepend=np.uint64(0))), _pack(counts[s:e])) for s, e in itertools.pairwise(cuts) if e > s]
        return pa.Table.from_batches([record_batch(_SENT, *zip(*out, strict=True))] if out else [], schema=_SENT)

    def count(key: tuple, table: pa.Table) -> pa.Table:
        names, sizes = table["chunk"].to_pylist(), table["n"].to_pylist()
        own = [np.cumsum(_unpack(x, "<u8"), dtype=np.uint64) for x in table["hashes"].to_pylist()]
        keys = np.concatenate(own)
        counts = np.concatenate([_unpack(x, "<u4") for x in table["counts"].to_pylist()])
        order_ = np.argsort(keys, kind="stable")
        first = np.concatenate([[True], np.diff(keys[order_]) != 0])
        group = np.cumsum(first) - 1
        total = np.bincount(group, weights=counts[order_]).astype(np.int64)
        mine = np.empty(len(keys), dtype="<u8")
        mine[order_] = total[group]
        out, at = [], 0
        for name, n, k in zip(names, sizes, own, strict=True):
            out.append((name, key[0].as_py(), _seal(k), _pack(mine[at : at + n])))
            at += n
        return pa.Table.from_batches([record_batch(_BACK, *zip(*out, strict=True))])

    def join(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], schema=_OUT)
        left = _documents(left["docs"][0].as_py())
        sizes, place, real, every = _keys(utf8(left["text"]), order)
        keys, inverse = np.unique(every, return_inverse=True)
        got = sorted(zip(right["range"].to_pylist(), right["seal"].to_pylist(), right["counts"].to_pylist(), strict=True))
        answers, at = [_unpack(x, "<u8") for *_, x in got], 0
        for (_, seal, _), x in zip(got, answers, strict=True):
            if _seal(keys[at : at + len(x)]) != seal:
                raise ValueError("counts of other n-grams than this chunk's: the input does not come in the same order twice, write it first")
            at += len(x)
        if at != len(keys):
            raise ValueError("counts are missing for n-grams of this chunk: the input does not come in the same order twice, write it first")
        table = np.concatenate(answers) if got else np.zeros(0, "<u8")
        mine, c, at = table[inverse].astype(np.float64), [], 0
        for r in real:
            k = np.zeros(len(place))
            k[r] = mine[at : at + int(r.sum())]
            at += int(r.sum())
            c.append(k)
        log = np.log(np.maximum(c[0], 1.0)) if len(place) else np.zeros(0)
        used, depth = np.zeros(len(place), dtype=np.int64), np.minimum(place, order - 1)
        for n in range(1, order):
            seen = real[n] & (c[n] >= min_count)
            context = np.concatenate([[1.0], c[n - 1][:-1]])
            log[seen] = np.log(c[n][seen] / np.maximum(context[seen], 1.0))
            used[seen] = n
        log += (depth - used) * np.log(alpha)
        doc = np.repeat(np.arange(left.num_rows), sizes)
        add = lambda w: np.bincount(doc, weights=w, minlength=left.num_rows)
        return pa.Table.from_batches([record_batch(_OUT, left["doc_id"].combine_chunks(), sizes, add(log), add(used == 0).astype(np.int64), add(used < depth).astype(np.int64), left["train"].combine_chunks(), left["score"].combine_chunks())])

    sent = chunks.groupBy("chunk").applyInArrow(send, "range int, chunk long, n long, hashes binary, counts binary")
    back = sent.groupBy("range").applyInArrow(count, "chunk long, range int, seal long, counts binary")
    summed = written(chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(join, "doc_id long, n_words long, log_sum double, n_unigram long, n_backoff long, train boolean, score boolean"), "lm-scores")
    words = summed.where("train").agg(F.sum("n_words")).first()[0] or 1
    total = F.col("log_sum") - F.col("n_unigram") * float(np.log(max(words, 1)))
    return summed.where("score").select("doc_id", "n_words", total.alias("log_score"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_score"), "n_backoff")
