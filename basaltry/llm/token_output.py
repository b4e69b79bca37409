"""Token-id output: shards of separately compressed documents under one shared zstandard dictionary.

File format of a shard (little-endian)::

    magic "BSLTOK1\\n" | u32 length of header | header (JSON: dtype, dictionary_sha256, bits)
    frames, one zstandard frame a document, in ascending doc_id order
    index: i64 doc_id[n] | u64 n_tokens[n] | u64 frame offset[n + 1] | u8 doc_id is null[n]
    u64 position of the index | u64 n | magic

The dictionary lies beside the shards as ``dictionary-<sha256>.zdict``; a reader checks its hash
against the header.  One document is read with three small reads: tail, index, frame.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fresh_path, record_batch
from .tokens import encoder

MAGIC = b"BSLTOK1\n"
#: Documents and ids of each that the dictionary is trained on, whatever the input's size; longer documents give spans of SPAN ids from
#: all over them.
SAMPLE_DOCS, SAMPLE_IDS, SPAN, DICTIONARY_BYTES = 1000, 16_384, 1024, 65_536
LEVEL = 3

_MANIFEST = pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("dictionary_sha256", pa.string())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; a bare path is local or mounted."""
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def train_dictionary(id_arrays: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of serialized id arrays; empty when they hold too little to train on."""
    import zstandard

    samples = [x for x in id_arrays if len(x) >= 8]
    if len(samples) < 16 or sum(map(len, samples)) < 4 * size:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def spans(ids: np.ndarray) -> np.ndarray:
    """All ids, or SAMPLE_IDS of them in evenly spread spans."""
    if len(ids) <= SAMPLE_IDS:
        return ids
    starts = np.linspace(0, len(ids) - SPAN, SAMPLE_IDS // SPAN).astype(np.int64)
    return np.concatenate([ids[k : k + SPAN] for k in starts])


def _zdict(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


class ShardWriter:
    """Writes documents one after another; memory holds one frame and three numbers a document."""

    def __init__(self, uri: str, dictionary: bytes, dtype: str):
        import zstandard

        self.uri, self.fs, self.path = uri, *filesystem(uri)
        self.part = f"{self.path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.dtype, self.sha = np.dtype(dtype), hashlib.sha256(dictionary).hexdigest()
        self.to_frame = zstandard.ZstdCompressor(level=LEVEL, dict_data=_zdict(dictionary)).compress
        head = json.dumps({"dtype": self.dtype.str, "dictionary_sha256": self.sha}).encode()
        self.out.write(MAGIC + struct.pack("<I", len(head)) + head)
        self.at = len(MAGIC) + 4 + len(head)
        self.ids: list[int] = []
        self.none: list[bool] = []
        self.counts: list[int] = []
        self.offsets = [self.at]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.to_frame(ids.astype(self.dtype).tobytes())
        self.out.write(frame)
        self.at += len(frame)
        self.ids.append(doc_id or 0)
        self.none.append(doc_id is None)
        self.counts.append(len(ids))
        self.offsets.append(self.at)

    def close(self) -> tuple:
        self.out.write(np.array(self.ids, "<i8").tobytes() + np.array(self.counts, "<u8").tobytes() + np.array(self.offsets, "<u8").tobytes() + np.array(self.none, "u1").tobytes())
        self.out.write(struct.pack("<QQ", self.at, len(self.ids)) + MAGIC)
        self.out.close()
        self.fs.move(self.part, self.path)  # a repeated attempt puts the same bytes there
        return self.uri, None if self.none[0] else self.ids[0], None if self.none[-1] else self.ids[-1], len(self.ids), sum(self.counts), self.sha


class ShardReader:
    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.file = self.fs.open_input_file(self.path)
        head = self._read(0, len(MAGIC) + 4)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{uri} is no shard of token ids")
        self.header = json.loads(self._read(len(MAGIC) + 4, struct.unpack("<I", head[len(MAGIC) :])[0]))
        end = self.file.size()
        tail = self._read(end - 16 - len(MAGIC), 16 + len(MAGIC))
        if tail[16:] != MAGIC:
            raise ValueError(f"{uri} is cut short")
        self.index_at, self.n = struct.unpack("<QQ", tail[:16])
        n, index = self.n, self._read(self.index_at, 25 * self.n + 8)
        self.doc_ids, self.counts = np.frombuffer(index, "<i8", n), np.frombuffer(index, "<u8", n, 8 * n)
        self.offsets, self.none = np.frombuffer(index, "<u8", n + 1, 16 * n), np.frombuffer(index, "u1", n, 24 * n + 8)
        self.from_frame = _decompressor(uri.rsplit("/", 1)[0], self.header["dictionary_sha256"]).decompress

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids_at(self, k: int) -> np.ndarray:
        frame = self._read(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k]))
        return np.frombuffer(self.from_frame(frame), self.header["dtype"])

    def ids_of(self, doc_id: int) -> np.ndarray:
        """The ids of one document, by a search of the index."""
        nulls = int(self.none.sum())  # they come first
        k = nulls + int(np.searchsorted(self.doc_ids[nulls:], doc_id))
        if k >= self.n or self.doc_ids[k] != doc_id:
            raise KeyError(doc_id)
        return self.ids_at(k)


@functools.lru_cache(maxsize=8)
def _decompressor(folder: str, sha: str):
    import zstandard

    raw = b""
    if sha != hashlib.sha256(b"").hexdigest():
        fs, path = filesystem(f"{folder}/dictionary-{sha}.zdict")
        with fs.open_input_stream(path) as f:
            raw = f.read()
        if hashlib.sha256(raw).hexdigest() != sha:
            raise ValueError("the dictionary's hash is not the one that the shard names")
    return zstandard.ZstdDecompressor(dict_data=_zdict(raw))


def write_token_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> list[tuple]:
    """Encode docs (doc_id, text) and write shards in ascending doc_id order; returns the manifest.

    The manifest has a row for each shard (path, first and last doc_id, documents, tokens, hash of
    the dictionary), in order.  Null texts count as empty; every document ends with end_id.  Rows of
    one doc_id stand side by side, in the order of their texts' hashes; null ids come first.  Empty
    input makes no shard.  Documents are dealt by ranges of doc_id, of the texts' hashes and of the rows' places, so that a source,
    text or id with many rows spreads over all tasks.  The dictionary is trained on whole ids of SAMPLE_DOCS documents (spans
    of long ones); where they are too few or too short for one, frames have none, which the header's hash tells.
    """
    spark = bounded(docs).sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    # the documents whose ids have the smallest hashes: a uniform sample of all rows
    chosen = [r[0] for r in docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()]
    dtype = "<u2" if encoder(tokenizer).vocab_size <= 1 << 16 else "<u4"

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"ids": [spans(np.frombuffer(x, "<u4")).astype(dtype).tobytes() for x in enc.encode(b["text"])]})

    some = docs.where(F.col("doc_id").isin(chosen)).select("text").limit(2 * SAMPLE_DOCS).repartition(8).mapInArrow(sampled, "ids binary").collect() if chosen else []
    dictionary = train_dictionary(sorted(bytes(r[0]) for r in some))
    sha = hashlib.sha256(dictionary).hexdigest()
    if dictionary:
        with fs.open_output_stream(f"{path}/dictionary-{sha}.zdict") as f:
            f.write(dictionary)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, end = encoder(tokenizer), None, struct.pack("<I", end_id)
        for b in batches:
            if writer is None and b.num_rows:
                writer = ShardWriter(f"{folder}/shard-{TaskContext.get().partitionId():06d}.tok", dictionary, dtype)
            for doc_id, ids in zip(b["doc_id"].to_pylist(), enc.encode(b["text"]), strict=True):
                writer.add(doc_id, np.frombuffer(ids + end, "<u4"))
        if writer is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(_MANIFEST.names, writer.close(), strict=True))], schema=_MANIFEST)

    order = ["doc_id", F.xxhash64("text")]
    dealt = docs.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, "row").sortWithinPartitions(*order, "text").select("doc_id", "text")
    rows = dealt.mapInArrow(shard, "path string, first_id long, last_id long, docs long, tokens long, dictionary_sha256 string").collect()
    return sorted(map(tuple, rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or 0, r[0]))


def read_token_shards(spark, manifest: list[tuple]) -> DataFrame:
    """A row for each document that the shards hold: doc_id, start (ids before it), n_tokens, ids_crc32."""
    starts = np.concatenate([[0], np.cumsum([r[4] for r in manifest], dtype=np.int64)]).tolist()
    files = spark.createDataFrame([(i, r[0], s) for i, (r, s) in enumerate(zip(manifest, starts, strict=False))], "k int, path string, start long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b["path"].to_pylist(), b["start"].to_pylist(), strict=True):
                r = ShardReader(uri)
                for at in range(0, r.n, 4096):
                    end = min(r.n, at + 4096)
                    crc = [zlib.crc32(r.ids_at(k).astype("<u4").tobytes()) for k in range(at, end)]
                    counts = r.counts[at:end].astype(np.int64)
                    yield record_batch(_READ, pa.array(r.doc_ids[at:end], mask=r.none[at:end].astype(bool)), start + np.cumsum(counts) - counts, counts, crc)
                    start += int(counts.sum())

    return files.repartition(max(1, len(manifest)), "k").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write the shards (into the shared folder if none is named) and read them back."""
    spark = docs.sparkSession
    return read_token_shards(spark, write_token_shards(docs, folder or fresh_path(spark, "tokens"), tokenizer))
