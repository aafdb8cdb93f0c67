"""Byte-pair merges of many words at once, in numpy.

What the tokenizers library does with one word (again and again the merge of the smallest rank, the leftmost of equal
ones) is done here with all words of about one length side by side: a column is a word, a row a place in it.
"""

from __future__ import annotations

import numpy as np
import regex

LONGEST = 64  # bytes; a place takes 6 bits
_WIDTHS = [2, 4, 6, 8, 10, 12, 16, 24, 32, 48, LONGEST]
_NONE = np.int32(1 << 30)
SPACE, LETTER, NUMBER, OTHER = range(4)
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The kind of each character of the basic plane."""
    if not _KINDS:
        table = np.full(1 << 16, OTHER, np.uint8)
        text = "".join(chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            table[[ord(c) for c in regex.findall(pattern, text)]] = kind
        _KINDS.append(table)
    return _KINDS[0]


def kind_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kind of the character that each byte belongs to, whether the byte begins one) of valid UTF-8."""
    lead = (data & 0xC0) != 0x80
    if not len(data) or data.max() < 0x80:
        return kinds()[data], lead
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    return kinds()[np.minimum(points, 0xFFFF)][np.cumsum(lead) - 1], lead


def pretokens(data: np.ndarray, off: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts of pretokens, those of each chunk that have white space inside). No chunk is empty.

    spaced: chunks begin with a space that belongs to what follows it, and numbers stay together; otherwise each digit is a
    pretoken. These are tokens.PRETOKENS for chunks without white space.
    """
    kind, lead = kind_of(data)
    first = off[:-1]
    if spaced:
        kind[first] = kind[np.minimum(first + 1, off[1:] - 1)]
    begins = np.zeros(len(data), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[first] = True
    if not spaced:
        begins |= lead & (kind == NUMBER)
    # 's and the like, where no other sign comes directly before
    starts = np.ones(len(data) + 4, bool)
    starts[: len(data)] = False
    starts[first] = True
    at = np.flatnonzero(data == 39)
    if len(at):
        before = kind[at - 1]
        at = at[~starts[at] & (before != OTHER)] if spaced else at[starts[at] | (before != OTHER)]
        wide = np.concatenate([data, np.zeros(4, np.uint8)])
        a, b = wide[at + 1], wide[at + 2]
        here = ~starts[at + 1]
        one = here & np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = here & ~starts[at + 2] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for size, hit in ((2, one), (3, two)):
            begins[at[hit] + 1] = False
            after = at[hit] + size
            begins[after[after < len(data)]] = True
    spaces = np.concatenate([[0], np.cumsum(kind == SPACE)])
    return np.flatnonzero(begins), spaces[off[1:]] > spaces[first]


class Merges:
    """merge(bytes, offsets) gives the ids of words, for models that have all bytes in their vocabulary."""

    def __init__(self, model: dict, letters: dict[int, str]):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        self.pad = max(vocab.values()) + 1
        pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pairs[vocab[a] * (self.pad + 1) + vocab[b]] = (rank, vocab[a + b])
        self.made = np.zeros(len(model["merges"]), np.int32)
        keys, ranks = np.array(list(pairs), np.int64), np.array([r for r, _ in pairs.values()], np.int32)
        self.made[ranks] = [m for _, m in pairs.values()]
        # an open hash table, less than a quarter full
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.key, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        place = self._place(keys)
        while len(keys):
            free = np.flatnonzero(self.key[place] < 0)
            _, mine = np.unique(place[free], return_index=True)
            mine = free[mine]
            self.key[place[mine]], self.rank[place[mine]] = keys[mine], ranks[mine] << 6
            rest = np.ones(len(keys), bool)
            rest[mine] = False
            keys, ranks, place = keys[rest], ranks[rest], (place[rest] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """64 times the rank of each pair, or _NONE."""
        keys = a.astype(np.int64) * (self.pad + 1) + b
        place = self._place(keys)
        found, out = self.key[place], self.rank[place]
        lost = np.flatnonzero((found != keys) & (found >= 0))
        place = place[lost]
        while len(lost):
            place = (place + 1) & ((1 << self.bits) - 1)
            found, out[lost] = self.key[place], self.rank[place]
            on = (found != keys[lost]) & (found >= 0)
            lost, place = lost[on], place[on]
        return out

    def merge(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each word), for words of 1 to LONGEST bytes."""
        lens = np.diff(off)
        counts = np.zeros(len(lens), np.int64)
        held = []
        width_of = np.searchsorted(_WIDTHS, lens)
        for w, width in enumerate(_WIDTHS):
            rows = np.flatnonzero(width_of == w)
            for k in range(0, len(rows), 1 << 14):  # what fits in a processor's cache
                held += self._columns(data, off, lens, rows[k : k + (1 << 14)], width)
        for rows, sym in held:
            counts[rows] = (sym != self.pad).sum(0)
        start = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), "<u4")
        for rows, sym in held:
            for k, s in enumerate(sym):
                m = s != self.pad
                out[start[rows[m]] + k] = s[m]
        return out, counts

    def _columns(self, data, off, lens, rows, width):
        n, size = len(rows), lens[rows]
        sym = np.full((width + 1, n), self.pad, np.int32)
        for k in range(width):
            m = np.flatnonzero(k < size)
            sym[k, m] = self.first[data[off[rows[m]] + k]]
        sym[size - 1, np.arange(n)] = self.last[data[off[rows] + size - 1]]
        val = np.empty((width - 1, n), np.int32)
        for k in range(width - 1):
            val[k] = self.ranks(sym[k], sym[k + 1]) + k
        held = []
        while len(val):
            best = val.min(0)
            on = best < _NONE - LONGEST
            if not on.all():
                held.append((rows[~on], sym[:, ~on]))
                rows, sym, val, best = rows[on], sym[:, on], val[:, on], best[on]
                if not len(rows):
                    return held
            # each word gets shorter by one, so one row of the columns goes
            at, new = best & 63, self.made[best >> 6]
            cols = np.arange(len(rows))
            right = sym[np.minimum(at + 2, len(sym) - 1), cols]
            for k in range(len(sym) - 1):
                np.copyto(sym[k], sym[k + 1], where=at < k)
            sym[at, cols] = new
            sym = sym[:-1]
            for k in range(len(val) - 1):
                np.copyto(val[k], val[k + 1] - 1, where=at < k)
            val = val[:-1]
            if not len(val):
                break
            m = np.flatnonzero(at < len(val))
            val[at[m], m] = self.ranks(new[m], right[m]) + at[m]
            m = np.flatnonzero(at > 0)
            val[at[m] - 1, m] = self.ranks(sym[at[m] - 1, m], new[m]) + at[m] - 1
        held.append((rows, sym))
        return held
