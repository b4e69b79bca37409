"""Quality classifier: neighbours vote in a latent-semantic space.

Terms are hashed words (lower-cased), hashed triples of bytes as they stand, and a term for how often words repeat.  Counts
are damped, weighted by inverse document frequency and projected on the leading singular vectors of
a labelled sample.  Each document is compared with every labelled vector by exact blocked cosine
products; its nearest labelled vectors vote, weighted by similarity and by their class's
share of all training labels.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, only, record_batch, released, utf8, written
from .vectors import top_of

#: Labelled documents of each class that are kept as voters, those with the smallest hash of their id.
SAMPLE_PER_CLASS = 1024
WORDS, TRIPLES, REPEATS, RANK, NEIGHBOURS, SHARPNESS = 2048, 4096, 16, 64, 15, 20.0
TERMS = WORDS + TRIPLES + REPEATS
#: Voters whose weighted terms are held at a time.
BLOCK = 256
#: Cosines are told apart to so many places; equal ones go to the voter that comes first.
PLACES = 9


def term_counts(text: bytes | None) -> np.ndarray:
    """Counts of all terms of a whole text; none for a null or empty one."""
    counts = np.zeros(TERMS, dtype=np.float32)
    if not text:
        return counts
    raw, triples = np.frombuffer(text, np.uint8), np.zeros(TRIPLES, dtype=np.int64)
    for k in range(0, max(len(raw) - 2, 0), 1 << 20):
        c = raw[k : k + (1 << 20) + 2].astype(np.uint32)
        code = (c[:-2] << np.uint32(16) | c[1:-1] << np.uint32(8) | c[2:]) * np.uint32(2654435761)
        triples += np.bincount(code >> np.uint32(20), minlength=TRIPLES)
    counts[WORDS : WORDS + TRIPLES] = triples
    if words := text.lower().split():
        hashes = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        counts[:WORDS] = np.bincount(hashes % np.uint32(WORDS), minlength=WORDS)
        share = len(set(words)) / len(words) ** 0.85  # new words come ever more slowly
        counts[WORDS + TRIPLES + min(REPEATS - 1, int(share * REPEATS / 1.5))] = len(words)
    return counts


@dataclass
class NeighbourVote:
    idf: np.ndarray
    mean: np.ndarray
    axes: np.ndarray
    voters: np.ndarray
    votes: np.ndarray
    weights: np.ndarray
    prior: float

    @functools.cached_property
    def centre(self) -> np.ndarray:
        return self.mean @ self.axes

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; zero for a document without any term.  Each document is projected by itself."""
        z = np.zeros((len(counts), self.axes.shape[1]))
        for i, c in enumerate(counts):
            held = np.flatnonzero(c)
            if len(held):
                x = np.log1p(c[held].astype(np.float64)) * self.idf[held]
                z[i] = x @ self.axes[held] / np.sqrt(x @ x) - self.centre
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the weighted votes; the prior for a document without any term."""
        if not len(self.voters):
            return np.full(len(counts), self.prior)
        z = self.vectors(counts)
        k = min(NEIGHBOURS, len(self.voters))
        cosine = np.round(z @ self.voters.T, PLACES)
        near = top_of(cosine, np.arange(len(self.voters)), k)[1].reshape(len(z), k)
        w = np.exp(SHARPNESS * (np.take_along_axis(cosine, near, axis=1) - 1.0)) * self.weights[near]
        out = np.round((w * self.votes[near]).sum(axis=1) / w.sum(axis=1), 9)
        return np.where((z == 0).all(axis=1), self.prior, np.clip(out, 0.0, 1.0))


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the k largest eigenvalues of a symmetric matrix and their vectors.  Of a large matrix a decomposition of the whole takes several
    times its memory: there a block wider than k goes through short Krylov spaces, whose best vectors begin the next, until nothing is left of A v - value v."""
    wide = k + k // 2
    if len(a) <= 8 * wide:
        return np.linalg.eigh(a)
    start = np.random.default_rng(0).standard_normal((len(a), wide)).astype(a.dtype)
    for _ in range(40):
        parts = [np.linalg.qr(start)[0]]
        for _ in range(3):
            parts.append(np.linalg.qr(a @ parts[-1])[0])
        basis = np.linalg.qr(np.concatenate(parts, axis=1).astype(np.float64))[0].astype(a.dtype)
        image = a @ basis
        values, turn = np.linalg.eigh((basis.T @ image).astype(np.float64))
        values, turn = values[-wide:], turn[:, -wide:].astype(a.dtype)
        start, image = basis @ turn, image @ turn
        if (np.linalg.norm(image - start * values.astype(a.dtype), axis=0)[-k:] <= 2e-6 * values[-1]).all():
            return values, start
    return np.linalg.eigh(a)


def fit(counts: np.ndarray, labels: np.ndarray, totals: dict[int, int]) -> NeighbourVote:
    """counts (voters, terms), labels 0 or 1; totals: training labels of each class, for the votes' weights."""
    every = sum(totals.values())
    prior = totals.get(1, 0) / every if every else 0.5
    if len(counts) < 2:
        return NeighbourVote(np.ones(TERMS, np.float32), np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), prior)
    blocks = range(0, len(counts), BLOCK)
    idf = np.log((1 + len(counts)) / (1 + sum((counts[i : i + BLOCK] > 0).sum(axis=0) for i in blocks))) + 1

    def weighted(i: int) -> np.ndarray:
        x = np.log1p(counts[i : i + BLOCK])
        x *= idf.astype(np.float32)
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-9)
        return x

    mean = sum(weighted(i).sum(axis=0, dtype=np.float64) for i in blocks) / len(counts)
    # leading right singular vectors, from the smaller Gram matrix; few rows are weighted at a time, so that counts are the only large array
    gram = np.empty((len(counts), len(counts)), dtype=np.float32)
    for i in blocks:
        x = weighted(i) - mean.astype(np.float32)
        for j in range(0, i + 1, BLOCK):
            gram[i : i + BLOCK, j : j + BLOCK] = x @ (weighted(j) - mean.astype(np.float32)).T
            gram[j : j + BLOCK, i : i + BLOCK] = gram[i : i + BLOCK, j : j + BLOCK].T
    values, left = leading(gram, RANK)
    del gram
    keep = np.argsort(-values)[: min(RANK, len(values))]
    keep = keep[values[keep] > 1e-9 * max(values.max(), 1e-30)]
    left = (left[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    axes = sum(((weighted(i) - mean.astype(np.float32)).T @ left[i : i + BLOCK]).astype(np.float64) for i in blocks)
    del left
    share = {q: totals[q] / max(1, int((labels == q).sum())) for q in totals}
    weights = np.array([share[int(q)] for q in labels])
    made = NeighbourVote(idf, mean, axes, np.zeros((0, axes.shape[1])), labels.astype(np.float64), weights / weights.max(), prior)
    made.voters = made.vectors(counts)
    return made


def fit_on(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> NeighbourVote:
    """docs (doc_id, text), labels (doc_id, quality): 0 or 1, other values and nulls left out; labels without a document too.

    A document with both labels votes for both; of several texts with one id that with the smallest hash is learned from.
    Voters stand in the order of their ids.
    """
    only("quality")  # what earlier stages keep in the driver's Python goes
    named = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    named = written(named.join(docs.select("doc_id"), "doc_id", "left_semi"), "quality-labels")
    totals = dict(named.groupBy("quality").count().collect())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [r for q in (0, 1) for r in named.where(F.col("quality") == q).orderBy(*order).limit(per_class).collect()]
    few = docs.sparkSession.createDataFrame(chosen, "doc_id long, quality int")  # 2 * per_class rows at most
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(few), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("term", pa.binary()), ("count", pa.binary())])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [term_counts(t) for t in utf8(b["text"])]
            yield record_batch(schema, b["doc_id"], b["quality"], [np.flatnonzero(c).astype("<i4").tobytes() for c in made], [c[c > 0].tobytes() for c in made])

    rows = sorted(map(tuple, texts.mapInArrow(terms, "doc_id long, quality int, term binary, count binary").collect()), key=lambda r: r[:2])
    counts = np.zeros((len(rows), TERMS), dtype=np.float32)
    for i, r in enumerate(rows):
        counts[i, np.frombuffer(r[2], "<i4")] = np.frombuffer(r[3], np.float32)
    kinds = np.array([r[1] for r in rows])
    del rows
    made = fit(counts, kinds, totals)
    del counts
    released()
    return made


def score(docs: DataFrame, model: NeighbourVote) -> DataFrame:
    """(doc_id, score) for each row of docs (doc_id, text), repeated rows and null ids as they stand.

    Null and empty texts get the prior.  Long texts count whole.  Cosines count to PLACES places and ties go to the voter with the
    smaller id, so that a score does not depend on which documents share its batch.
    """
    return annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text")


def annotate(docs: DataFrame, model: NeighbourVote, name: str = "score") -> DataFrame:
    """All columns of docs and the score, under a name that docs does not have; rows are not moved."""
    shared = bounded(docs).sparkSession.sparkContext.broadcast(model)  # 2 * per_class voters at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("quality")
        m = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                made = m.scores(np.array([term_counts(t) for t in utf8(part["text"])]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.float64())], names=[*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
