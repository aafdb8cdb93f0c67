"""Suffix sorting by external induced sorting, in bulk.

The text's suffixes are induced from its sorted LMS suffixes, which are sorted by the same means on the reduced text.
What a tuple-at-a-time sorter keeps in a priority queue keyed by (character, rank) is here a queue for each character:
within a character tuples arrive in rank order, so a queue is a list of arrays, read once from its front, and written
to the shared folder when the sorter holds more than its share of memory. A bucket is handled a front at a time: all
suffixes known so far hand on their predecessors in one numpy step, those of the same character as the next front.
"""

from __future__ import annotations

import uuid

import numpy as np

from .common import U64, filesystem, mix, powers

SMALL_ALPHABET = 4096


class Queues:
    """First-in first-out arrays by character; beyond `limit` entries in memory the longest queues go to files in `folder`."""

    def __init__(self, sigma: int, folder: str | None, limit: int):
        self.parts: list[list] = [[] for _ in range(sigma)]
        self.sizes = np.zeros(sigma, np.int64)
        self.held, self.limit, self.folder = 0, limit, folder
        self.fs = self.root = None
        self.spilled = 0

    def push(self, c: int, v: np.ndarray) -> None:
        self.parts[c].append(v)
        self.sizes[c] += len(v)
        self.held += len(v)
        if self.folder and self.held > self.limit:
            for k in np.argsort(-self.sizes)[:16].tolist():
                self._spill(k)

    def _spill(self, c: int) -> None:
        here = [p for p in self.parts[c] if isinstance(p, np.ndarray)]
        if not here:
            return
        if self.fs is None:
            self.fs, self.root = filesystem(self.folder)
            self.fs.create_dir(self.root, recursive=True)
        name = f"{self.root}/q-{uuid.uuid4().hex}"
        keep, run = [], []
        for p in self.parts[c]:  # order of the parts must stay; files come first since they were written first
            (run if isinstance(p, np.ndarray) else keep).append(p)
        with self.fs.open_output_stream(name) as f:
            f.write(np.concatenate(run).astype("<i8").tobytes())
        self.spilled += 1
        self.held -= sum(map(len, run))
        self.sizes[c] -= sum(map(len, run))
        self.parts[c] = [*keep, name]

    def pop(self, c: int) -> list[np.ndarray]:
        out = []
        for p in self.parts[c]:
            if isinstance(p, np.ndarray):
                out.append(p)
                self.held -= len(p)
            else:
                with self.fs.open_input_stream(p) as f:
                    out.append(np.frombuffer(f.read(), "<i8").astype(np.int64))
                self.fs.delete_file(p)
        self.parts[c], self.sizes[c] = [], 0
        return out


def types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S: smaller than the next one. The empty suffix after the end counts as smallest."""
    n = len(t)
    s = np.zeros(n, bool)
    if n < 2:
        return s
    differs = np.flatnonzero(t[1:] != t[:-1])
    less = t[differs] < t[differs + 1]
    k = np.searchsorted(differs, np.arange(n - 1))
    inside = k < len(differs)
    s[:-1][inside] = less[k[inside]]
    return s


def _hand_on(q: Queues, pos: np.ndarray, t: np.ndarray, c: int) -> np.ndarray:
    """Queues positions by their character; returns those of character c, in order."""
    ch = t[pos]
    same = pos[ch == c]
    rest = pos[ch != c]
    if len(rest):
        ch = t[rest]
        order = np.argsort(ch, kind="stable")
        rest, ch = rest[order], ch[order]
        cut = np.flatnonzero(np.concatenate([[True], ch[1:] != ch[:-1]]))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(rest)]):
            q.push(int(ch[a]), rest[a:b])
    return same


def induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sigma: int, folder: str | None, limit: int) -> np.ndarray:
    """The suffix array of t, if lms holds the LMS suffixes in order (or sorts LMS substrings, if they aren't)."""
    n = len(t)
    empty = np.zeros(0, np.int64)
    ch = t[lms]
    order = np.argsort(ch, kind="stable")
    by = np.searchsorted(ch[order], np.arange(sigma + 1))
    star = lms[order]
    q, larger = Queues(sigma, folder, limit), [empty] * sigma
    present = np.bincount(t, minlength=sigma) > 0
    q.push(int(t[-1]), np.array([n - 1]))  # induced by the empty suffix
    for c in np.flatnonzero(present).tolist():
        done, fronts = [], q.pop(c)
        while fronts:
            front = np.concatenate(fronts) if len(fronts) > 1 else fronts[0]
            done.append(front)
            p = front[front > 0] - 1
            p = p[~s[p]]
            same = _hand_on(q, p, t, c)
            fronts = [same] if len(same) else []
        larger[c] = np.concatenate(done) if done else empty
        p = star[by[c] : by[c + 1]]
        p = p[p > 0] - 1
        _hand_on(q, p[~s[p]], t, -1)
    q, out = Queues(sigma, folder, limit), [empty] * sigma
    for c in np.flatnonzero(present)[::-1].tolist():
        done, fronts = [], q.pop(c)
        while fronts:
            front = np.concatenate(fronts) if len(fronts) > 1 else fronts[0]
            done.append(front)
            p = front[front > 0] - 1
            p = p[s[p]]
            same = _hand_on(q, p, t, c)
            fronts = [same] if len(same) else []
        p = larger[c][::-1]
        p = p[p > 0] - 1
        _hand_on(q, p[s[p]], t, -1)
        smaller = np.concatenate(done)[::-1] if done else empty
        out[c] = np.concatenate([larger[c], smaller])
    return np.concatenate(out)


def doubling(t: np.ndarray) -> np.ndarray:
    """Suffix array by rank doubling: for reduced texts over large alphabets."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64).ravel() + 1
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - k)] = rank[k:]
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        v = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], (v[1:] != v[:-1]).astype(np.int64)]))
        rank = new
        if n == 0 or rank.max() == n or k > n:
            return order
        k *= 2


def suffix_array(t: np.ndarray, folder: str | None = None, limit: int = 1 << 24) -> np.ndarray:
    """Positions of all suffixes of an integer array, ascending."""
    t = t.astype(np.int64)
    n = len(t)
    if n < 2:
        return np.arange(n)
    sigma = int(t.max()) + 1
    if sigma > SMALL_ALPHABET:
        return doubling(t)
    s = types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if not len(lms):
        return induce(t, s, lms, sigma, folder, limit)
    rough = induce(t, s, lms, sigma, folder, limit)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    # equal LMS substrings get one name; they are compared by length and two 64-bit hashes of characters and types
    nxt = np.append(lms[1:], n - 1)
    size = nxt - lms + 1
    code = mix((t * 2 + s).astype(U64) + U64(1))
    def hashes(base):
        w = powers(base, n)
        total = np.concatenate([np.zeros(1, U64), np.cumsum(code * w, dtype=U64)])
        # bring to a common power: multiply by the rest up to n
        return (total[nxt + 1] - total[lms]) * w[n - 1 - lms]

    h1, h2 = hashes(0x9E3779B97F4A7C15), hashes(0xD6E8FEB86659FD93)
    where = np.zeros(n, np.int64)
    where[lms] = np.arange(len(lms))
    k = where[ordered]
    last = nxt[k] == n - 1  # the last substring runs to the end and equals no other
    differ = (size[k][1:] != size[k][:-1]) | (h1[k][1:] != h1[k][:-1]) | (h2[k][1:] != h2[k][:-1]) | last[1:] | last[:-1]
    name = np.empty(len(lms), np.int64)
    name[k] = np.concatenate([[0], np.cumsum(differ)])
    if name.max() + 1 == len(lms):
        final = ordered
    else:
        final = lms[suffix_array(name, folder, limit)]
    return induce(t, s, final, sigma, folder, limit)


def repeats(text: np.ndarray, valid: np.ndarray, width: int, folder: str | None = None, limit: int = 1 << 24) -> np.ndarray:
    """Group number of each valid position: equal when the width bytes there are equal. -1 elsewhere and for singles.

    Neighbours in suffix order that agree in width bytes form the groups.
    """
    group = np.full(len(text), -1, np.int64)
    sa = suffix_array(text, folder, limit)
    sa = sa[valid[sa]]
    if len(sa) < 2:
        return group
    same = np.ones(len(sa) - 1, bool)
    for i in range(width):  # only the pairs that still agree are compared further
        at = np.flatnonzero(same)
        if not len(at):
            break
        same[at] = text[sa[at] + i] == text[sa[at + 1] + i]
    number = np.concatenate([[0], np.cumsum(~same)])
    size = np.bincount(number)
    several = size[number] > 1
    group[sa[several]] = number[several]
    return group
