"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of documents.  A window of the stream gives each queue credit for its share
of the window's tokens; what a queue could not take in whole tokens is its deficit and is added
to its credit in the next window.  Summed up, queue q has sent floor(credit of q so far) tokens at
the end of each window, so its deficit is always below one token and every window holds the target
proportions to a token.  A queue that runs empty leaves its credit to the others.

The credit after any number of windows follows from the queues' totals alone.  So a task needs no
other task's state: it takes the deficits at its first window from the formula, and the result does
not depend on how the input is partitioned.  The windows' streams, one after another, are
cut every seq_len tokens; only the last sequence can need padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, record_batch, written
from .tokens import CACHE, encoder

SEQ_LEN, WINDOW = 1024, 65_536
#: Longs that a task keeps of the windows' tables (one for each source), and pieces that it sorts by window.
TABLES, SORTED = 1 << 22, 65_536
#: Places (one for each queue and block) that a join broadcasts at most.
PLACES = 1 << 20

_ENCODED = pa.schema([("queue", pa.string()), ("block", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window_id")])


class Schedule:
    """Tokens that each queue has sent after any number of windows.

    totals: tokens of each queue; weights: target proportions (any positive scale; by default the
    totals, so that every window has the whole corpus's mixture).
    """

    def __init__(self, totals: list[int], window: int = WINDOW, weights: list[float] | None = None):
        self.totals = np.array(totals, dtype=np.int64)
        self.window, self.total = window, int(self.totals.sum())
        self.n = -(-self.total // window)
        self.known: dict[int, np.ndarray] = {}
        self.fits = (self.total + window) * int(self.totals.max(initial=0)) < 2**63
        self.knots = None
        if weights is not None:
            p = np.array(weights, dtype=np.float64)
            if (p <= 0).any() or not np.isfinite(p).all():
                raise ValueError("target proportions must be positive")
            self.p = p / p.sum()
            # virtual time at which each queue runs empty, and the tokens sent by then
            end = self.totals / self.p
            order = np.argsort(end, kind="stable")
            v, done, rest = end[order], np.cumsum(self.totals[order]), np.cumsum(self.p[order][::-1])[::-1]
            sent = done + v * np.append(rest[1:], 0.0)
            self.knots = np.append(0.0, v), np.maximum.accumulate(np.append(0.0, sent))

    def _time(self, w: int) -> float:
        return float(np.interp(w * self.window, self.knots[1], self.knots[0]))

    def sent(self, w: int) -> np.ndarray:
        """Tokens that each queue has sent before window w."""
        if w >= self.n:
            return self.totals
        if self.knots is not None:
            return np.minimum(self.totals, np.floor(self.p * self._time(w)).astype(np.int64))
        if self.fits:
            return w * self.window * self.totals // self.total
        return np.array([w * self.window * t // self.total for t in self.totals.tolist()], dtype=np.int64)

    def sent_by(self, q: int, w: int) -> int:
        """sent(w)[q], without the other queues."""
        t = int(self.totals[q])
        if w >= self.n:
            return t
        return w * self.window * t // self.total if self.knots is None else min(t, int(np.floor(self.p[q] * self._time(w))))

    def window_of(self, q: int, at: int) -> int:
        """The window in which queue q sends its token number at."""
        low, high = 0, self.n - 1
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.sent_by(q, mid + 1) > at else (mid + 1, high)
        return low

    def spans(self, q: int, at: int, n: int, w: int | None) -> Iterator[tuple[int, int, int]]:
        """(window, start, end) of the parts of a document of n tokens at place at of queue q."""
        w = self.window_of(q, at) if w is None or not self.sent_by(q, w) <= at < self.sent_by(q, w + 1) else w
        start = 0
        while start < n:
            if (room := self.sent_by(q, w + 1) - at - start) <= 0:
                w = self.window_of(q, at + start) if self.sent_by(q, w + 2) <= at + start else w + 1
                continue
            end = min(n, start + room)
            yield w, start, end
            start = end

    def shift(self, w: int, q: int) -> int:
        """What to add to a token's place in queue q for its place in the whole stream, in window w."""
        if (got := self.known.get(w)) is None:
            if (len(self.known) + 1) * len(self.totals) > TABLES:
                self.known.clear()
            now, then = self.sent(w), self.sent(w + 1)
            got = self.known[w] = int(now.sum()) + np.cumsum(then - now) - then
        return int(got[q])


def pack_mixture(docs: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN, window: int = WINDOW, end_id: int = 0, proportions: dict[str | None, float] | None = None, cache: int = CACHE) -> DataFrame:
    """Pack docs (doc_id, text, source): a row for each piece of a document.

    doc_id, start (the document's ids before the piece), length, ids_crc32, doc_tokens, sequence_id,
    offset (place in the sequence), window_id.  Every id, the end id included, lies in one piece.
    proportions: target share by source; sources that it does not name get the smallest share named.
    cache: parts of texts that a worker keeps encoded (time for memory).
    Every source is a queue, however many there are: driver and tasks hold a long for each.
    Null text is empty (the end id alone); a null source is a queue; rows that repeat a doc_id are
    packed one by one; an empty table gives no rows.  Other columns are ignored.

    Ids are made once and written with their place in (queue, block), a block being a partition.
    Places in a whole queue are sums over blocks; no task holds more than a document.
    """
    spark = bounded(docs).sparkSession
    queue = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))  # a null source is a queue of its own

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, block, sent, end = encoder(tokenizer, cache), TaskContext.get().partitionId(), {}, np.array([end_id], "<u4").tobytes()
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                part = b.slice(k, 2048)
                queues, ats, ns, ids = part["queue"].to_pylist(), [], [], []
                for q, x in zip(queues, enc.encode(part["text"]), strict=True):
                    a = np.frombuffer(x + end, "<u4")
                    ats.append(sent.get(q, 0))
                    ns.append(len(a))
                    ids.append(a.astype("<u2").tobytes() if enc.vocab_size <= 1 << 16 else a.tobytes())
                    sent[q] = ats[-1] + len(a)
                yield record_batch(_ENCODED, queues, [block] * len(ns), part["doc_id"], ats, ns, ids)

    encoded = written(docs.select(queue.alias("queue"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encode, "queue string, block long, doc_id long, at long, n long, ids binary"), "packing")
    sums = encoded.groupBy("queue", "block").agg(F.sum("n").alias("tokens"))
    numbered = written(sums.groupBy("queue").agg(F.sum("tokens").alias("total")).withColumn("q", F.row_number().over(Window.orderBy("queue")).cast("long") - 1), "packing-queues")
    totals = numbered.select("q", "total").toPandas().sort_values("q")["total"].to_numpy(np.int64)  # a long for each source
    weights = None
    if proportions is not None:
        by_name = {"-" if k is None else f"={k}": v for k, v in proportions.items()}
        weights = np.full(len(totals), min(by_name.values()), dtype=np.float64)
        for r in numbered.join(F.broadcast(spark.createDataFrame(list(by_name), "string").toDF("queue")), "queue", "left_semi").collect():
            weights[r["q"]] = by_name[r["queue"]]
    shared = spark.sparkContext.broadcast(Schedule(totals, window, weights))
    before = sums.select("queue", "block", (F.sum("tokens").over(Window.partitionBy("queue").orderBy("block")) - F.col("tokens")).alias("before")).join(numbered.select("queue", "q"), "queue")
    before = written(before, "packing-before")
    dtype = "<u2" if encoder(tokenizer).vocab_size <= 1 << 16 else "<u4"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule, last = shared.value, {}

        def place(spans: list[tuple]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for w, q, doc_id, at, n, a, start, end in sorted(spans, key=lambda s: s[0]):  # a window's table is made once
                place = schedule.shift(w, q) + at + start
                while start < end:
                    length = min(end - start, seq_len - place % seq_len)
                    out.append((doc_id, start, length, zlib.crc32(a[4 * start : 4 * (start + length)]), n, place // seq_len, place % seq_len, w))
                    start, place = start + length, place + length
                if len(out) >= 8192:
                    yield record_batch(_PIECES, *zip(*out, strict=True))
                    out = []
            if out:
                yield record_batch(_PIECES, *zip(*out, strict=True))

        for b in batches:
            spans: list[tuple] = []
            for q, doc_id, at, n, ids in zip(*(b[c].to_pylist() for c in ("q", "doc_id", "at", "n", "ids")), strict=True):
                a = np.frombuffer(ids, dtype).astype("<u4").tobytes()
                for w, start, end in schedule.spans(q, at, n, last.get(q)):
                    spans.append((w, q, doc_id, at, n, a, start, end))
                    last[q] = w
                    if len(spans) >= SORTED:
                        yield from place(spans)
                        spans = []
            yield from place(spans)

    # places are broadcast while they are few, so that ids stay where they are; else both sides are dealt by queue and block
    placed = encoded.join(F.broadcast(before) if before.count() <= PLACES else before, ["queue", "block"]).select("q", "doc_id", (F.col("at") + F.col("before")).alias("at"), "n", "ids")
    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window_id long")
