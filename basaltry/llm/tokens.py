"""Exact encoding by the tokenizers library with a cache of words.

The byte-level pre-tokenizer never lets a token reach over a space that stands between two
non-space characters, so a text may be cut there and each cut part encoded by itself: the ids are
those of the whole text.  Parts repeat a great deal, so each worker keeps what it has encoded.
Tests hold the result against encoding whole texts.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import keeps, only

#: A space next to another white-space character belongs to a run, which stays in one part.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_RUN = "".join([" [", *[f"\\x{{{ord(c):x}}}" for c in _SPACES], "]|[", *[f"\\x{{{ord(c):x}}}" for c in _SPACES], "] "])
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Contractions, words, numbers, other signs and spaces, as in the tokenizer file's pre-tokenizer.
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word of letters and a run of signs behind it (no apostrophe): two pieces at most, found without the pattern above.
_WORD = r"^(?P<w>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<s>[!-&(-/:-@\[-`{-~]*)$"
#: Words that a worker learns before it forgets those that it did not need meanwhile, about 200 bytes each.
CACHE = 500_000
#: Texts and their bytes that are cut together.
ROWS, BYTES = 2048, 4 << 20


class Encoder:
    """encode(text) gives little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.cache = path, cache
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_parts = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.pieces = regex.compile(_PIECE)
        self.single = Tokenizer.from_file(path)
        self.single.encode_special_tokens = True
        self.vocab_size = self.single.get_vocab_size(True)
        if self.by_parts:
            # pieces are sent as one text, a line each: far fewer objects than a text each
            self.plain = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.lines = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), self.plain])
            self.single.pre_tokenizer = self.lines
            self.line = self.single.encode("\n", add_special_tokens=False).ids
            self.by_parts = len(self.line) == 1
        self.words = {" ": _Known(cache), "": _Known(cache // 8)}
        self.odd = {" ": _Known(cache // 4), "": _Known(cache // 8)}
        self.inner = _Known(cache // 4)

    @functools.cached_property
    def whole(self):
        """The tokenizer as its file has it."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.encode_special_tokens = True
        return made

    def _encode_lines(self, pieces: list[str], lead: str) -> list[bytes]:
        """Ids of pieces, none of which holds a line end, each behind lead."""
        out = []
        for at in range(0, len(pieces), 256):
            some = pieces[at : at + 256]
            ids = np.array(self.single.encode_batch_fast([lead + f"\n{lead}".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.line[0]), len(ids)) * 4
            raw, start = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(raw[start:end])
                start = end + 4
        return out

    def _encode_pieces(self, pieces: list[str], lead: str) -> list[bytes]:
        """Ids of pieces, each behind lead; any may hold line ends."""
        plain = [x for x in pieces if "\n" not in x]
        made = dict(zip(plain, self._encode_lines(plain, lead), strict=True))
        if ends := [x for x in pieces if "\n" in x]:  # these go one by one
            self.single.pre_tokenizer = self.plain
            encoded = self.single.encode_batch_fast([lead + x for x in ends], add_special_tokens=False)
            made.update((x, array("I", e.ids).tobytes()) for x, e in zip(ends, encoded, strict=True))
            self.single.pre_tokenizer = self.lines
        return [made[x] for x in pieces]

    def _encode_odd(self, parts: list[str], lead: str) -> list[bytes]:
        """Ids of parts of any form: cut as the tokenizer's file does, pieces looked up."""
        cut = [self.pieces.findall(lead + p) for p in parts]
        every = list({x for c in cut for x in c})
        known = dict(zip(every, self.inner.look_up(every, lambda new: self._encode_pieces(new, "")), strict=True))
        return [b"".join([known[x] for x in c]) for c in cut]

    def _ids_of(self, parts: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different parts, one after another, and how many each has."""
        cut = pc.extract_regex(parts, _WORD)
        plain = cut.is_valid()
        odd = parts.filter(pc.invert(plain)).to_pylist()
        cut = cut.filter(plain)
        words, signs = (cut.field(f).dictionary_encode() for f in ("w", "s"))
        tables = [
            self.words[lead].look_up(_strings(words.dictionary), lambda new: self._encode_lines(new, lead)),
            self.inner.look_up(signs.dictionary.to_pylist(), lambda new: self._encode_lines(new, "")),
            self.odd[lead].look_up(odd, lambda new: self._encode_odd(new, lead)),
        ]
        shift = np.cumsum([0, *map(len, tables)])
        # a part is a word and the signs behind it, or one odd piece (and nothing)
        pieces = np.full((len(parts), 2), shift[3], dtype=np.int64)
        mask = plain.to_numpy(zero_copy_only=False)
        pieces[mask, 0], pieces[mask, 1] = words.indices.to_numpy(), shift[1] + signs.indices.to_numpy()
        pieces[~mask, 0] = shift[2] + np.arange(len(odd))
        ids, size = _gather([x for t in tables for x in t] + [b""], pieces.ravel())
        return ids, size.reshape(-1, 2).sum(axis=1)

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text, none for a null or empty one."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_parts:
            return [array("I", e.ids).tobytes() for e in self.whole.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            n = max(1, int(np.searchsorted(np.cumsum(pc.binary_length(texts[at : at + ROWS]).to_numpy()), BYTES, side="right")))
            out += self._encode_some(texts[at : at + n])
            at += n
        return out

    def _encode_some(self, texts: pa.Array) -> list[bytes]:
        """Parts are cut and told apart in Arrow; only different words become Python objects."""
        cut = _parts(texts)
        offsets = cut.offsets.to_numpy().astype(np.int64)
        offsets, values = offsets - offsets[0], cut.flatten()
        head = np.zeros(len(values), dtype=bool)
        head[offsets[:-1]] = True
        rest, firsts = (values.filter(pa.array(m)).dictionary_encode() for m in (~head, head))
        ids, size = (np.concatenate(x) for x in zip(self._ids_of(rest.dictionary, " "), self._ids_of(firsts.dictionary, ""), strict=True))
        which = np.empty(len(values), dtype=np.int64)
        which[~head], which[head] = rest.indices.to_numpy(), len(rest.dictionary) + firsts.indices.to_numpy().astype(np.int64)
        made, mine = _spread(ids, size, which)
        edges = np.append(0, np.cumsum(mine))[offsets].tolist()
        return [made[x:y].tobytes() for x, y in itertools.pairwise(edges)]


def _strings(words: pa.Array) -> list[str]:
    """Python strings of words without line ends: one string that is split makes them faster than one at a time."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_py().split("\n") if len(words) else []


def _spread(ids: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of entries which, one after another, of a table whose entries have size ids; and their sizes."""
    start, mine = np.cumsum(size) - size, size[which]
    end = np.cumsum(mine)
    return ids[np.repeat(start[which] - end + mine, mine) + np.arange(end[-1] if len(end) else 0)], mine


def _gather(table: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, table), np.int64, len(table)) // 4
    return _spread(np.frombuffer(b"".join(table), "<u4"), size, which)


class _Known(dict):
    """What has been encoded.  After `most` new entries those of the time before go, unless they were asked for since."""

    def __init__(self, most: int):
        self.most = most
        self.old: dict[str, bytes] = {}

    def look_up(self, names: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The entries of different names; encode makes those that are missing."""
        found = list(map(self.get, names))
        missing = [k for k, x in enumerate(found) if x is None]
        if missing:
            old = self.old.get
            new = []
            for k in missing:
                if (x := old(names[k])) is None:
                    new.append(k)
                else:
                    found[k] = self[names[k]] = x
            some = [names[k] for k in new]
            made = encode(some)
            for k, x in zip(new, made, strict=True):
                found[k] = x
            self.update(zip(some, made, strict=True))
            if len(self) > self.most:
                self.old = dict(self)
                self.clear()
        return found


def _parts(texts: pa.Array) -> pa.ListArray:
    """The parts of each text; single spaces between them give the text."""
    cut = pc.split_pattern(texts, " ")
    runs = pc.match_substring_regex(texts, _RUN)
    if not pc.any(runs).as_py():
        return cut
    return pa.array([_CUT.split(t) if r else p for t, r, p in zip(texts.to_pylist(), runs.to_pylist(), cut.to_pylist(), strict=True)], pa.list_(pa.string()))


_ENCODERS: dict[tuple[str, int], Encoder] = {}
keeps("tokens", _ENCODERS.clear)


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """One for each worker process, file and size of cache."""
    only("tokens")
    if (path, cache) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, cache] = Encoder(path, cache)
    return _ENCODERS[path, cache]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
