"""A double-array trie of byte strings, walked for many words at once with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class DoubleArrayTrie:
    """keys[i] has value i.  From node s, byte c leads to t = base[s] + c + 1 if check[t] == s."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for i, key in enumerate(keys):
            node = 0
            for c in key:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    values.append(-1)
                node = nxt
            values[node] = i
        size = 4 * len(children) + 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        used = bytearray(size)
        used[0] = 1
        place = [0] * len(children)
        lowest = 1
        for node, kids in enumerate(children):  # parents come before their children
            s = place[node]
            value[s] = values[node]
            if not kids:
                continue
            codes = sorted(kids)
            slot = lowest
            while True:
                slot = used.find(0, slot)
                b = slot - codes[0] - 1
                if slot + 258 >= size:
                    grow = size
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
                    used += bytearray(grow)
                    size += grow
                if b >= 0 and not any(used[b + c + 1] for c in codes):
                    break
                slot += 1
            base[s] = b
            for c in codes:
                t = b + c + 1
                used[t], check[t] = 1, s
                place[kids[c]] = t
            lowest = used.find(0, lowest)
        end = max(place) + 258
        self.base, self.check, self.value = (np.array(x[:end], dtype=np.int32) for x in (base, check, value))
        # a leaf's base must not let other nodes' places pass for its children
        self.longest = max(map(len, keys), default=0)
        self.lists = None

    def prefixes(self, text: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(length, value) of the keys that text holds at start, shortest first."""
        if self.lists is None:
            self.lists = self.base.tolist(), self.check.tolist(), self.value.tolist()
        base, check, value = self.lists
        s = 0
        for n in range(start, len(text)):
            t = base[s] + text[n] + 1
            if t >= len(check) or check[t] != s:
                return
            s = t
            if value[s] >= 0:
                yield n - start + 1, value[s]

    def match(self, words: np.ndarray, longest: int | None = None) -> np.ndarray:
        """words: (n, length) bytes.  Gives (n, length, longest): the value of the key of l + 1
        bytes at each place, or -1."""
        n, length = words.shape
        m = min(longest or self.longest, self.longest, length)
        out = np.full((n, length, m), -1, dtype=np.int32)
        every = np.arange(n)
        for start in range(length):
            at, state = every, np.zeros(n, dtype=np.int32)
            for k in range(min(m, length - start)):
                t = self.base[state] + words[at, start + k] + 1
                ok = (t < len(self.check)) & (self.check[np.minimum(t, len(self.check) - 1)] == state)
                at, state = at[ok], t[ok]
                if not len(at):
                    break
                out[at, start, k] = self.value[state]
        return out


def by_length(words: list[bytes], budget: int, width: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """Words of one length as a byte matrix, so many that n * length * width stays within budget."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for length, places in groups.items():
        if length:
            step = max(1, budget // (length * min(width, length)))
            for k in range(0, len(places), step):
                some = places[k : k + step]
                yield some, np.frombuffer(b"".join([words[i] for i in some]), np.uint8).reshape(len(some), length)
