"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (byte strings).  The
probability of a word under a language is the sum over all its segmentations into pieces of the
product of their probabilities: a forward pass over the bytes.  A text is the product of its words,
each with a space in front; pieces that would reach over a word's end do not exist.  The piece
probabilities are fitted by expectation-maximisation (forward-backward) on word counts.

Words repeat, so each worker keeps the words it has scored.
"""

from __future__ import annotations

import functools
import json
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.matrix import reduce_blocks
from .common import bounded, in_parts, keeps, only, record_batch, written
from .trie import DoubleArrayTrie, by_length

#: Documents of each language that the model is fitted on, on average: those whose hash is small enough.
SAMPLE_PER_LANGUAGE = 600
#: Words of more bytes are fitted and scored one at a time, in logarithms.
SHORT = 40
ROUNDS, SMOOTH = 3, 0.05
#: Scales every byte so that products of probabilities stay within doubles; taken out again at the end.
SCALE = 64.0
CACHE = 300_000


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> DoubleArrayTrie:
    """All single bytes and the vocabulary's pieces of lower-case text without white space inside, from a tokenizer file with byte-level pieces."""
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    alphabet = _byte_alphabet()
    found = {bytes(alphabet[c] for c in name) for name in names if all(c in alphabet for c in name)}
    lower = {p for p in found if p == p.lower() and b" " not in p[1:] and b"\n" not in p}
    return DoubleArrayTrie(sorted(lower | {bytes([b]) for b in range(256)}))


keeps("language_id", vocabulary.cache_clear)


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _as_bytes(words: list[str]) -> list[bytes]:
    return [b" " + w.encode("utf-8", "surrogatepass") for w in words]


def forward(found: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """found (n, length, m): piece at each place and length - 1, or -1; probs (pieces + 1, languages), the last
    row zero.  Gives (n, length + 1, languages): sums over the segmentations of each prefix."""
    n, length, m = found.shape
    alpha = np.zeros((length + 1, n, probs.shape[1]))
    alpha[0] = 1.0
    live = (found >= 0).any(axis=0)
    for e in range(1, length + 1):
        for k in range(min(m, e)):
            if live[e - k - 1, k]:
                alpha[e] += alpha[e - k - 1] * probs[found[:, e - k - 1, k]]
    return alpha


def backward(found: np.ndarray, probs: np.ndarray) -> np.ndarray:
    n, length, m = found.shape
    beta = np.zeros((length + 1, n, probs.shape[1]))
    beta[length] = 1.0
    live = (found >= 0).any(axis=0)
    for s in range(length - 1, -1, -1):
        for k in np.flatnonzero(live[s, : length - s]):
            beta[s] += beta[s + k + 1] * probs[found[:, s, k]]
    return beta


def pieces_of(trie: DoubleArrayTrie, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of all pieces that one word of any length holds, by start."""
    found = [(s, s + n, key) for s in range(len(word)) for n, key in trie.prefixes(word, s)]
    return tuple(np.array(found, dtype=np.int64).reshape(-1, 3).T)


def log_sums(start: np.ndarray, end: np.ndarray, logs: np.ndarray, length: int) -> np.ndarray:
    """(length + 1, languages): logs of the sums over the segmentations of each prefix; logs (pieces found, languages)."""
    order = np.argsort(end, kind="stable")
    start, logs, edges = start[order], logs[order], np.searchsorted(end[order], np.arange(length + 2))
    out = np.zeros((length + 1, logs.shape[1]))
    for e in range(1, length + 1):
        a, b = edges[e], edges[e + 1]
        out[e] = np.logaddexp.reduce(out[start[a:b]] + logs[a:b], axis=0)
    return out


@dataclass
class LanguageModel:
    path: str
    languages: list[str]
    log_prior: np.ndarray
    log_probs: np.ndarray  # (pieces, languages), single precision

    @functools.cached_property
    def trie(self) -> DoubleArrayTrie:
        return vocabulary(self.path)

    @functools.cached_property
    def scaled(self) -> np.ndarray:
        return np.vstack([np.exp(self.log_probs.astype(np.float64) + self._lengths[:, None] * np.log(SCALE)), np.zeros(len(self.languages))])

    @functools.cached_property
    def _lengths(self) -> np.ndarray:
        return piece_lengths(self.trie, len(self.log_probs))

    @functools.cached_property
    def known(self) -> dict[str, int]:
        return {}

    def _score_long(self, word: bytes) -> np.ndarray:
        """Log of the sum over the segmentations of one word of any length."""
        logs, longest = np.zeros((min(len(word), self.trie.longest) + 1, len(self.languages))), self.trie.longest
        size, probs = len(logs), self.log_probs
        ends: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
        for s in range(len(word)):  # logs holds the last places in a ring
            for n, key in self.trie.prefixes(word, s):
                ends[(s + n) % (longest + 1)].append((s % size, key))
            here = ends[(s + 1) % (longest + 1)]
            from_, keys = zip(*here, strict=True)
            logs[(s + 1) % size] = np.logaddexp.reduce(logs[list(from_)] + probs[list(keys)], axis=0)
            here.clear()
        return logs[len(word) % size]

    def score_words(self, words: list[str]) -> np.ndarray:
        """(words, languages): log of the sum over segmentations."""
        raw = _as_bytes(words)
        out = np.zeros((len(words), len(self.languages)))
        short = [w if len(w) <= SHORT else b"" for w in raw]
        for places, matrix in by_length(short, 2_000_000, self.trie.longest):
            alpha = forward(self.trie.match(matrix), self.scaled)
            out[places] = np.log(np.maximum(alpha[-1], 1e-300)) - matrix.shape[1] * np.log(SCALE)
        for i, w in enumerate(raw):
            if len(w) > SHORT:
                out[i] = self._score_long(w)
        return out

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language (`und` without any letter), its posterior probability and the number of words of each text."""
        names, scores, counts = [], np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        known = self.known
        for at in range(0, len(texts), 512):
            some = [words_of(t or "") for t in texts[at : at + 512]]
            new = {w for words in some for w in words if w not in known}
            if len(known) + len(new) > CACHE:
                known.clear()
                self.__dict__["table"] = np.zeros((0, len(self.languages)))
                new = {w for words in some for w in words}
            table = self.__dict__.setdefault("table", np.zeros((0, len(self.languages))))
            if new:
                order = list(new)
                start, need = len(known), len(known) + len(order)
                if need > len(table):
                    table = np.vstack([table, np.zeros((max(need - len(table), len(table), 4096), len(self.languages)))])
                    self.__dict__["table"] = table
                table[start:need] = self.score_words(order)
                known.update(zip(order, range(start, need), strict=True))
            for i, (words, text) in enumerate(zip(some, texts[at : at + 512], strict=True), at):
                counts[i] = len(words)
                if not words or not any(map(str.isalpha, text)):
                    names.append("und")
                    continue
                v = table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0) + self.log_prior
                best = int(v.argmax())
                names.append(self.languages[best])
                scores[i] = 1.0 / np.exp(v - v[best]).sum()
        return names, scores, counts


def piece_lengths(trie: DoubleArrayTrie, n: int) -> np.ndarray:
    """Bytes of each piece, from the depth of its node."""
    depth = np.zeros(len(trie.base), dtype=np.int64)
    out = np.zeros(n, dtype=np.int64)
    level = np.array([0])
    d = 0
    nodes = np.flatnonzero(trie.check >= 0)
    while len(level):
        held = level[trie.value[level] >= 0]
        out[trie.value[held]] = d
        depth[level] = d
        mark = np.zeros(len(trie.base), dtype=bool)
        mark[level] = True
        level = nodes[mark[trie.check[nodes]]]
        d += 1
    return out


def expected_counts(words: list[str], weight: np.ndarray, probs: np.ndarray, trie: DoubleArrayTrie) -> np.ndarray:
    """(pieces, languages): how often each piece is expected in words of weight (words, languages), over all segmentations."""
    n_pieces, languages = probs.shape
    raw = _as_bytes(words)
    scaled = np.vstack([probs * SCALE ** piece_lengths(trie, n_pieces)[:, None].astype(float), np.zeros(languages)])
    out = np.zeros((n_pieces + 1, languages))
    for places, matrix in by_length([w if len(w) <= SHORT else b"" for w in raw], 2_000_000, trie.longest):
        found = trie.match(matrix)
        alpha, beta = forward(found, scaled), backward(found, scaled)
        share = weight[places] / np.maximum(alpha[-1], 1e-300)
        live = (found >= 0).any(axis=0)
        for s in range(matrix.shape[1]):
            for k in np.flatnonzero(live[s, : matrix.shape[1] - s]):
                key = found[:, s, k]
                here = key >= 0
                part = alpha[s][here] * scaled[key[here]] * beta[s + k + 1][here] * share[here]
                for x in range(languages):
                    out[:, x] += np.bincount(key[here], part[:, x], n_pieces + 1)
    for i, w in enumerate(raw):
        if len(w) > SHORT:
            start, end, key = pieces_of(trie, w)
            logs, n = np.log(probs[key]), len(w)
            alpha, beta = log_sums(start, end, logs, n), log_sums(n - end, n - start, logs, n)[::-1]
            np.add.at(out, key, weight[i] * np.exp(alpha[start] + logs + beta[end] - alpha[n]))
    return out[:n_pieces]


def _fit(expect: Callable[[np.ndarray], np.ndarray], path: str, documents: dict[str, int], rounds: int) -> LanguageModel:
    """Starts from equal pieces and raises the likelihood of the words, expect giving the pieces' expected counts."""
    n_pieces = int(vocabulary(path).value.max()) + 1
    probs = np.full((n_pieces, len(documents)), 1.0 / n_pieces)
    for _ in range(rounds):
        probs = expect(probs) + SMOOTH
        probs /= probs.sum(axis=0)
    total = sum(documents.values())
    prior = np.log([max(documents[x], 1) / max(total, 1) for x in sorted(documents)])
    return LanguageModel(path, sorted(documents), prior, np.log(probs).astype(np.float32))


def _weighted(rows: Iterable[tuple[str, str, int]], languages: list[str]) -> tuple[list[str], np.ndarray]:
    """Words and their counts by language."""
    place = {x: i for i, x in enumerate(languages)}
    words: dict[str, int] = {}
    cells = [(words.setdefault(w, len(words)), place[x], n) for x, w, n in rows]
    weight = np.zeros((len(words), len(languages)))
    for w, x, n in cells:
        weight[w, x] += n
    return list(words), weight


def fit(counts: Iterable[tuple[str, str, int]], path: str, documents: dict[str, int], rounds: int = ROUNDS) -> LanguageModel:
    """counts: (language, word, occurrences).  documents: training documents of each language, for the prior."""
    words, weight = _weighted(counts, sorted(documents))
    return _fit(lambda probs: expected_counts(words, weight, probs, vocabulary(path)), path, documents, rounds)


def fit_on(docs: DataFrame, path: str, per_language: int = SAMPLE_PER_LANGUAGE, rounds: int = ROUNDS) -> LanguageModel | None:
    """Fit on docs (doc_id, text, lang), lang not null: on about per_language documents of each language,
    whole texts, chosen by their hash; None without any document.

    Words stay on executors: a round is one pass over them that adds up expected counts.
    """
    spark = bounded(docs).sparkSession
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    named = docs.where("lang is not null and text is not null").select("lang", "text", u.alias("u"))
    documents = dict(named.groupBy("lang").count().collect())  # a row for each language
    if not documents:
        return None
    share = F.create_map(*[F.lit(x) for name, n in documents.items() for x in (name, min(1.0, per_language / n))])
    languages = sorted(documents)
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words as scoring cuts them."""
        only("language_id")
        for b in in_parts(batches, 64):
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                if got := Counter(words_of(text)):
                    yield record_batch(schema, [lang] * len(got), list(got), list(got.values()))

    sample = named.where(F.col("u") < share[F.col("lang")]).select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    parts = max(1, min(64, spark.sparkContext.defaultParallelism))
    table = written(sample.groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(parts, "word").sortWithinPartitions("word", "lang"), "language-words")

    def expect(probs: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(probs)

        def part(b: pa.RecordBatch) -> np.ndarray:
            only("language_id")
            rows = zip(*(b[c].to_pylist() for c in ("lang", "word", "n")), strict=True)
            return expected_counts(*_weighted(rows, languages), shared.value, vocabulary(path))

        total = reduce_blocks(table, part, probs.shape)
        shared.unpersist()
        return total

    return _fit(expect, path, documents, rounds)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score, words) for each row of docs (doc_id, text); only text decides.

    `und` with score 0 for a null text, one without any letter, or where nothing could be learned.  Of languages with the same
    probability the first by name is taken.  Repeated rows and null ids stand as they are; texts of any length count whole;
    other columns are ignored.
    """
    return annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text")


def annotate(docs: DataFrame, model: LanguageModel | None, names: tuple[str, str, str] = ("lang_pred", "score", "words")) -> DataFrame:
    """All columns of docs and the three of identify(), under names that docs does not have; rows are not moved."""
    shared = bounded(docs).sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("language_id")
        m = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                texts = part["text"].to_pylist()
                made = m.classify(texts) if m is not None else (["und"] * len(texts), np.zeros(len(texts)), [len(words_of(t or "")) for t in texts])
                kinds = (pa.string(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, t) for x, t in zip(made, kinds, strict=True))], names=[*part.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.LongType()), strict=True))])
    return docs.mapInArrow(run, schema)
