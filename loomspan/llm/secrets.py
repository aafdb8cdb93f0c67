"""Secret scans with one automaton for all rules.

The rules are written as small expression trees over bytes, joined into one NFA, made deterministic by subset
construction and minimised; the result is a transition array over byte classes. A batch of texts is one byte string
(texts apart by a byte that UTF-8 never uses). It is cut into lanes that advance together, one byte a step for all
lanes; a lane whose assumed start state was wrong is run again from the right one until its states agree. So every byte
passes all rules once.

The automaton accepts a rule at one byte of each match. What a match has behind or before that byte are runs of bytes of one
set, so its ends are read off the borders of such runs, in numpy: no text is scanned a second time, and counted repeats needn't
multiply states. Of the matches of a rule, leftmost ones that don't overlap are taken, then those that are long enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, base_of, slices, utf8

BREAK = 0xFF
ALNUM = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


# --- rules as expressions: ("set", bytes) ("cat", ...) ("alt", ...) ("opt", x) ("star", x) ---------------------------


def chars(b: bytes):
    return ("set", frozenset(b))


def literal(s: str, fold: bool = False):
    return ("cat", *[chars((c.lower() + c.upper() if fold else c).encode()) for c in s])


def times(x, n: int):
    return ("cat", *[x] * n)


def opt(x):
    return ("opt", x)


_VALUE = ALNUM + b"+/_.=-"
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_QUOTE = opt(chars(b"\"'"))
_SPACES = ("star", chars(b" "))
_HEX = b"0123456789abcdef"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ "
_URL = ALNUM + b"_-"
_URL_RUN = ("cat", chars(_URL), ("star", chars(_URL)))


class Run:
    """Runs of bytes of one set in a byte string."""

    def __init__(self, data: np.ndarray, members: bytes):
        inside = np.zeros(256, bool)
        inside[list(members)] = True
        self.breaks, self.n = np.flatnonzero(~inside[data]), len(data)

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the run that holds each place."""
        k = np.searchsorted(self.breaks, at)
        return np.append(self.breaks + 1, 0)[k - 1], np.append(self.breaks, self.n)[k]


# each of these turns places where its rule accepts, ascending, into (start, end, length that counts) of matches


def _whole_run(data: np.ndarray, at: np.ndarray):
    a, b = Run(data, _HEX).around(at)
    return a, b, b - a


def _behind(before: int, members: bytes):
    """The rule accepts at the first byte of a run, `before` bytes from the match's start."""

    def spans(data: np.ndarray, at: np.ndarray):
        b = Run(data, members).around(at)[1]
        return at - before, b, b - at + before

    return spans


def _assignment(data: np.ndarray, at: np.ndarray):
    """The rule accepts at the value's first byte; before it everything is determined byte by byte, backwards."""
    starts = []
    for q in at.tolist():
        i = q - (data[q - 1] in b"\"'")
        while data[i - 1] == 32:
            i -= 1
        i -= 1
        while data[i - 1] == 32:
            i -= 1
        i -= data[i - 1] in b"\"'"
        end = bytes(data[max(0, i - 8) : i]).lower()
        starts.append(i - next(len(w) for w in _WORDS if end.endswith(w.encode())))
    b = Run(data, _VALUE).around(at)[1]
    return np.array(starts, np.int64), b, b - at


def _key_header(data: np.ndarray, at: np.ndarray):
    a = Run(data, _CAPITALS).around(at - 5)[0] - 5
    return a, at + 1, at + 1 - a


def _web_token(data: np.ndarray, at: np.ndarray):
    """The rule accepts at the first byte of the third run; the match starts at the first eyJ of the first run."""
    run = Run(data, _URL)
    b = run.around(at)[1]
    second = run.around(at - 2)[0]
    first, _ = run.around(second - 2)
    a = np.array([x + bytes(data[x:y]).find(b"eyJ") for x, y in zip(first.tolist(), (second - 1).tolist())], np.int64)
    return a, b, b - a


#: name -> (expression, what finds the ends of its matches, least length)
RULES = {
    "assign": (("cat", ("alt", *[literal(w, True) for w in _WORDS]), _QUOTE, _SPACES, chars(b":="), _SPACES, _QUOTE, chars(_VALUE)), _assignment, 12),
    "access": (("cat", literal("AKIA"), chars(UPPER)), _behind(4, UPPER), 18),
    "hex": (times(chars(_HEX), 16), _whole_run, 16),
    "github": (("cat", literal("gh"), chars(b"pousr"), literal("_"), chars(ALNUM)), _behind(4, ALNUM), 36),
    "slack": (("cat", literal("xox"), chars(b"abprs"), literal("-"), chars(ALNUM + b"-")), _behind(5, ALNUM + b"-"), 15),
    "private_key": (("cat", literal("-----BEGIN "), ("star", chars(_CAPITALS)), literal("PRIVATE KEY-----")), _key_header, 0),
    "jwt": (("cat", literal("eyJ"), _URL_RUN, literal(".eyJ"), _URL_RUN, literal("."), chars(_URL)), _web_token, 40),
}
BASE = ("assign", "access", "hex")
NAMES = tuple(RULES)


class Automaton:
    """step[state, class of byte] and accept[state] (a bit per rule); state 0 is the start."""

    def __init__(self, rules: dict):
        edges: list[list[tuple[frozenset, int]]] = []
        empty: list[list[int]] = []
        accepts: dict[int, int] = {}

        def new() -> int:
            edges.append([])
            empty.append([])
            return len(edges) - 1

        def build(x, a: int) -> int:
            if x[0] == "set":
                b = new()
                edges[a].append((x[1], b))
                return b
            if x[0] == "cat":
                for y in x[1:]:
                    a = build(y, a)
                return a
            if x[0] == "alt":
                b = new()
                for y in x[1:]:
                    empty[build(y, a)].append(b)
                return b
            if x[0] == "opt":
                b = build(x[1], a)
                end = new()
                empty[a].append(end)
                empty[b].append(end)
                return end
            mid = new()  # star
            empty[a].append(mid)
            empty[build(x[1], mid)].append(mid)
            return mid

        root = new()
        for k, r in enumerate(rules.values()):
            s = new()
            empty[root].append(s)
            accepts[build(r[0], s)] = 1 << k

        sets = {s for es in edges for s, _ in es}
        key = [tuple(b in s for s in sets) for b in range(256)]
        names: dict[tuple, int] = {}
        self.classes = np.array([names.setdefault(k, len(names)) for k in key], np.uint8)
        sample = {c: b for b, c in reversed(list(enumerate(self.classes.tolist())))}

        def close(states) -> frozenset:
            todo, seen = list(states), set(states)
            while todo:
                for t in empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(x for x in seen if edges[x] or x in accepts)

        start = close([root])
        number, order, table = {start: 0}, [start], []
        for s in order:  # grows as it goes
            row = []
            for c in range(len(names)):
                b = sample[c]
                t = close([y for x in s for group, y in edges[x] if b in group]) | start  # a match may begin anywhere
                if t not in number:
                    number[t] = len(order)
                    order.append(t)
                row.append(number[t])
            table.append(row)
        step = np.array(table, np.int64)
        accept = np.array([sum({accepts.get(x, 0) for x in s}) for s in order], np.int64)
        # minimise: split states by acceptance, then by the blocks their bytes lead to, until nothing splits
        block = np.unique(accept, return_inverse=True)[1]
        while True:
            _, finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == block.max():
                break
            block = finer
        first = np.full(block.max() + 1, -1)
        first[block[::-1]] = np.arange(len(block))[::-1]
        rank = np.argsort(np.argsort(first))  # the start state stays 0
        reps = np.sort(first)
        self.step = rank[block[step[reps]]].astype(np.uint16)
        self.accept = accept[reps]
        self.unminimised = len(order)

    def scan(self, data: np.ndarray, lanes: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(positions, masks) of the bytes at which some rule accepts."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        width = len(self.step[0])
        size = -(-n // lanes)
        cls = np.zeros(size * lanes, np.uint8)
        cls[:n] = self.classes[data]
        cls[n:] = self.classes[BREAK]
        cls = np.ascontiguousarray(cls.reshape(lanes, size).T)
        flat = self.step.ravel()
        states = np.empty((size, lanes), np.uint16)
        now = np.zeros(lanes, np.int64)
        for i in range(size):
            now = flat[now * width + cls[i]].astype(np.int64)
            states[i] = now
        wrong = np.flatnonzero(states[-1][:-1] != 0) + 1  # lanes whose start wasn't the start state
        while len(wrong):
            changed = []
            for k in wrong.tolist():
                s = int(states[-1][k - 1])
                for i in range(size):
                    s = int(flat[s * width + int(cls[i, k])])
                    if states[i, k] == s:
                        break
                    states[i, k] = s
                else:
                    changed.append(k + 1)
            wrong = np.array([k for k in changed if k < lanes])
        hot = np.flatnonzero(self.accept > 0)
        table = np.zeros(len(self.accept), bool)
        table[hot] = True
        row, lane = np.nonzero(table[states])
        at = lane * size + row
        ok = at < n
        return at[ok], self.accept[states[row[ok], lane[ok]]]


_AUTOMATON: list[Automaton] = []


def automaton() -> Automaton:
    if not _AUTOMATON:
        _AUTOMATON.append(Automaton(RULES))
    return _AUTOMATON[0]


def matches(data: np.ndarray, at: np.ndarray, masks: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(rule, start, end) of all matches, from the places where rules accept."""
    order = np.argsort(at, kind="stable")
    at, masks = at[order], masks[order]
    for k, (_, spans, least) in enumerate(RULES.values()):
        mine = at[masks >> k & 1 == 1]
        if not len(mine):
            continue
        reached = 0
        for a, b, size in sorted(zip(*(x.tolist() for x in spans(data, mine)))):
            if a >= reached:
                reached = b
                if size >= least:
                    yield k, a, b


def find_secrets(texts: pa.Array) -> list[list[tuple[str, int, int]]]:
    """Spans (rule, start, end) of each text by start, then rule; code points, end exclusive."""
    data, off = utf8(texts)
    n = len(off) - 1
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(n)]
    apart = np.full(len(data) + n, BREAK, np.uint8)
    apart[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(off))] = data
    begins = off + np.arange(n + 1)
    found = sorted((a, k, b) for k, a, b in matches(apart, *automaton().scan(apart)))
    if found:
        points = np.concatenate([[0], np.cumsum((apart & 0xC0) != 0x80)])
        for a, k, b in found:
            d = int(np.searchsorted(begins, a, side="right")) - 1
            out[d].append((NAMES[k], int(points[a] - points[begins[d]]), int(points[b] - points[begins[d]])))
    return out


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found: array of (rule, start, end, value). Null or empty text: an empty array.

    Rows are independent, so rows that repeat give the same each; texts are scanned whole in time linear in their length; no rows
    in, no rows out.
    """
    kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def scan(batches):
        for batch in batches:
            for b in slices(batch):
                texts = b.column(1)
                found = [[{"rule": k, "start": s, "end": e, "value": texts[i].as_py()[s:e]} for k, s, e in x] for i, x in enumerate(find_secrets(texts))]
                yield pa.record_batch([b.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return arrow_map(base_of(docs, id_col, text_col), scan, "doc_id long, found array<struct<rule:string,start:long,end:long,value:string>>")


def op6_secrets(spark, sf_dir):
    def digest(batches):
        for batch in batches:
            for b in slices(batch):
                out = []
                for i, found in zip(b.column(0).to_pylist(), find_secrets(b.column(1))):
                    said = [f"{k}:{s}:{e}" for k, s, e in found]
                    base = [x for x, f in zip(said, found) if f[0] in BASE]
                    out.append((i, *(sum(f[0] == k for f in found) for k in BASE), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(said)))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] * 4 + [pa.string()] * 2)], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return arrow_map(base_of(spark.read.parquet(f"{sf_dir}/documents.parquet")), digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
