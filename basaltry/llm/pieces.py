"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces and their log scores come from a public model file.  (Of a file that was made for merging, as the public one
here, the scores are minus the ranks of merges; they are taken as they stand.)  A text gets a leading space (the
dummy prefix), its spaces become the marker U+2581, and the segmentation with the highest sum of
scores is taken; ties go to the longer last piece.  A character that no piece spells costs the lowest
score minus 10 and comes out as its UTF-8 bytes' pieces.

No piece crosses certain places (between another character and a marker, or next to a character that
is in no longer piece).  The best segmentation of a text is then that of its parts, so
parts are solved once for each worker and looked up.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, record_batch
from .trie import DoubleArrayTrie, by_length

MARK = "▁"
UNK_PENALTY = 10.0
#: Parts up to so many bytes are solved together; the cache is emptied beyond so many parts.
SHORT, CACHE = 48, 700_000

_OUT = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("n_fallback", pa.int64()), ("round_trip", pa.bool_())])


class UnigramPieces:
    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        kinds = [(m.is_byte(i), m.is_control(i), m.is_unknown(i), m.is_unused(i)) for i in range(n)]
        names = [m.id_to_piece(i) for i in range(n)]
        self._setup(names, [m.get_score(i) for i in range(n)], kinds, m.unk_id())

    def _setup(self, names: list[str], scores: list[float], kinds: list[tuple[bool, bool, bool, bool]], unk: int) -> None:
        spelled = [i for i, k in enumerate(kinds) if not any(k)]
        self.ids = np.array([*spelled, -1], dtype=np.int64)
        self.scores = np.array([scores[i] for i in spelled] or [0.0], dtype=np.float64)
        self.unk_score = float(self.scores.min()) - UNK_PENALTY
        self.trie = DoubleArrayTrie([names[i].encode() for i in spelled])
        self.unk = unk
        by_byte = {int(names[i][3:5], 16): i for i, k in enumerate(kinds) if k[0]}
        self.byte_ids = [by_byte.get(b, unk) for b in range(256)]
        self.fallback = len(by_byte) == 256
        self.spelling = [b"" if c else b" \xe2\x81\x87 " if u else bytes([int(x[3:5], 16)]) if b else x.replace(MARK, " ").encode() for x, (b, c, u, _) in zip(names, kinds, strict=True)]
        self.is_byte = np.array([k[0] for k in kinds])
        inner = {(a, b) for i in spelled for a, b in zip(names[i], names[i][1:], strict=False)}
        self.inner = inner
        self.by_space = all(a == MARK for a, b in inner if b == MARK) and not any("\n" in p for p in inner)
        self.known: dict[str, bytes] = {}

    # -- parts ------------------------------------------------------------------------------------

    def parts(self, text: str) -> list[str]:
        """Parts that joined give the marked text, cut where no piece can cross."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if not self.by_space:
            return self._cut(marked)
        out: list[str] = []
        for k, line in enumerate(marked.split("\n")):
            if k:
                out.append("\n")
            if MARK + MARK in line:
                out += re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", line)
            else:
                first, *rest = line.split(MARK)
                if first:
                    out.append(first)
                out += [MARK + p for p in rest]
        return out

    def _cut(self, part: str) -> list[str]:
        out, start, inner = [], 0, self.inner
        for k, pair in enumerate(zip(part, part[1:], strict=False), 1):
            if pair not in inner:
                out.append(part[start:k])
                start = k
        return [*out, part[start:]]

    # -- Viterbi ----------------------------------------------------------------------------------

    def _one(self, part: bytes) -> list[tuple[int, int, int]]:
        """(start, end, key or -1) of the best segmentation of one part."""
        n = len(part)
        best, back = [-np.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        scores, s = self.scores, 0
        while s < n:
            width = _width(part[s])
            single = False
            for length, key in self.trie.prefixes(part, s):
                single |= length == width
                if (v := best[s] + scores[key]) > best[s + length]:
                    best[s + length], back[s + length] = v, (s, key)
            if not single and (v := best[s] + self.unk_score) > best[s + width]:
                best[s + width], back[s + width] = v, (s, -1)
            s += width
        out, e = [], n
        while e:
            s, key = back[e]
            out.append((s, e, key))
            e = s
        return out[::-1]

    def _many(self, words: np.ndarray) -> list[list[tuple[int, int, int]]]:
        n, length = words.shape
        found = self.trie.match(words)
        m = found.shape[2]
        width = np.where(words < 0x80, 1, np.where(words < 0xE0, 2, np.where(words < 0xF0, 3, 4)))
        heads = (words & 0xC0) != 0x80
        score = np.append(self.scores, -np.inf)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0.0
        back_s, back_k = np.zeros((n, length + 1), np.int32), np.full((n, length + 1), -1, np.int32)
        for s in range(length):
            for k in range(min(m, length - s)):
                v = best[:, s] + score[found[:, s, k]]
                better = v > best[:, s + k + 1]
                best[better, s + k + 1], back_s[better, s + k + 1], back_k[better, s + k + 1] = v[better], s, found[better, s, k]
            for w in range(1, min(4, length - s) + 1):
                lone = heads[:, s] & (width[:, s] == w)
                if w <= m:
                    lone &= found[:, s, w - 1] < 0
                if lone.any():
                    v = np.where(lone, best[:, s] + self.unk_score, -np.inf)
                    better = v > best[:, s + w]
                    best[better, s + w], back_s[better, s + w], back_k[better, s + w] = v[better], s, -1
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        for paths, bs, bk in zip(out, back_s.tolist(), back_k.tolist(), strict=True):
            e = length
            while e:
                paths.append((bs[e], e, bk[e]))
                e = bs[e]
            paths.reverse()
        return out

    def _ids(self, part: bytes, path: list[tuple[int, int, int]]) -> bytes:
        out: list[int] = []
        for s, e, key in path:
            if key >= 0:
                out.append(int(self.ids[key]))
            elif self.fallback:
                out += [self.byte_ids[b] for b in part[s:e]]
            else:
                out.append(self.unk)
        return np.array(out, dtype="<u4").tobytes()

    def _learn(self, parts: list[str]) -> None:
        short: list[bytes] = []
        names: list[str] = []
        for p in parts:
            b = p.encode()
            if len(b) <= SHORT:
                short.append(b)
                names.append(p)
            else:
                self.known[p] = b"".join([self._ids(x.encode(), self._one(x.encode())) for x in self._cut(p)])
        for places, words in by_length(short, 4_000_000, self.trie.longest):
            for i, path in zip(places, self._many(words), strict=True):
                self.known[names[i]] = self._ids(short[i], path)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; none for a null or empty text."""
        out: list[bytes] = []
        for at in range(0, len(texts), 512):
            some = [self.parts(t or "") for t in texts[at : at + 512]]
            known = self.known
            if new := {p for parts in some for p in parts if p not in known}:
                if len(known) + len(new) > CACHE:
                    known.clear()
                    new = {p for parts in some for p in parts}
                self._learn(list(new))
            out += [b"".join(map(known.__getitem__, parts)) for parts in some]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, markers turned into spaces, bytes into their characters, the dummy prefix off."""
        return b"".join(map(self.spelling.__getitem__, ids.tolist())).removeprefix(b" ").decode("utf-8", "replace")


def _width(head: int) -> int:
    return 1 if head < 0x80 else 2 if head < 0xE0 else 3 if head < 0xF0 else 4


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> UnigramPieces:
    return UnigramPieces(path)


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids: binary of little-endian u32) for each row of docs (doc_id, text).

    Null and empty texts have no ids; null ids and repeated rows stand as they are; texts of any length are encoded whole; other
    columns are ignored.  Of equal scores the path with the longer last piece is taken.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                yield record_batch(schema, part["doc_id"], p.encode(part["text"].to_pylist()))

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give the empty text.  A marker is a space, so a text that holds U+2581 itself comes
    back with spaces in its place."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            yield record_batch(schema, b["doc_id"], [p.decode(np.frombuffer(x or b"", "<u4")) for x in b["ids"].to_pylist()])

    return encoded.mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, model: str) -> DataFrame:
    """For each row of docs (doc_id, text): n_ids, ids_crc32, n_fallback (byte pieces) and whether decoding gives the text back.

    Null text counts as empty: no ids, crc 0, and it comes back as the empty text.  Only a text that holds the marker U+2581
    itself does not come back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                texts = part["text"].to_pylist()
                ids = [np.frombuffer(x, "<u4") for x in p.encode(texts)]
                yield record_batch(_OUT, part["doc_id"], list(map(len, ids)), [zlib.crc32(x) for x in ids], [int(p.is_byte[x].sum()) for x in ids], [p.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_fallback long, round_trip boolean")
