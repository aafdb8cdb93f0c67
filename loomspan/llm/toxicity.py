"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A word's input is the sum of its own embedding, if it is in at least five documents of the sample (rarer ones share a
row of zeros, so no document can be learnt by heart), and of the mean embedding of its character trigrams. A run of more than 14 letters is read as several words that overlap by two
letters, so every trigram is in one of them, also where a script puts no spaces. The network reads windows of 32 words that overlap by half, over the whole text; attention pools the states of a window to
a logit. Training is multiple-instance: a document's label goes to its highest window. A logistic head over the highest
window and the soft count of toxic windows, fitted to a fifth of the sample that the network didn't see, makes the
document's score.

Training takes a bounded sample of labelled rows (sample_rows a class, smallest hash first); scoring runs all windows of
all texts. What a word adds to the gates is computed once for each word a worker meets and then looked up.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, base_of, slices, tidy

WINDOW, STRIDE, HIDDEN, DIM = 32, 16, 8, 12
GRAMS, SEEN_IN = 1 << 12, 5
CACHE = 150_000
RUN = 14
_WORD = re.compile(r"[^\W_]+")


def word_list(text: str | None) -> list[str]:
    """Words in order; of one longer than RUN, pieces of RUN letters that overlap by two, the last one reaching the end."""
    found = _WORD.findall((text or "").lower())
    if not found or max(map(len, found)) <= RUN:
        return found
    return [w[i : i + RUN] for w in found for i in ((0,) if len(w) <= RUN else (*range(0, len(w) - RUN, RUN - 2), len(w) - RUN))]


def inputs(word: str, known: dict[str, int]) -> tuple[int, list[int]]:
    """Row of the word table (0: unknown), rows of the character table, one for each trigram."""
    w = f"<{word}>"
    return known.get(word, 0), [1 + zlib.crc32(w[i : i + 3].encode()) % (GRAMS - 1) for i in range(len(w) - 2)]


def windows(n: int) -> list[int]:
    """Starts of the windows over n words; the last one reaches the end."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Net:
    def __init__(self, known: dict[str, int], seed: int = 7):
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, DIM
        self.known = known
        g = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(np.float32)
        self.p = {"E": np.zeros((len(known) + 1, d), np.float32), "C": g(GRAMS, d, k=0.02), "v": g(2 * h, k=0.4), "u": g(2 * h, k=0.4), "c": np.array([-1.0], np.float32)}
        for k in "fb":
            self.p |= {f"W{k}": g(d, 3 * h, k=0.5), f"U{k}": g(h, 3 * h, k=0.3), f"b{k}": np.zeros(3 * h, np.float32)}
        self.head = np.array([0.0, 0.0, -2.0])

    def embed(self, words: list[tuple[int, list[int]]]) -> np.ndarray:
        out = self.p["E"][[w for w, _ in words]].copy() if words else np.zeros((0, DIM), np.float32)
        if words:
            size = np.array([len(g) for _, g in words])
            flat = np.array([x for _, g in words for x in g])
            out += np.add.reduceat(self.p["C"][flat], np.cumsum(size) - size) / size[:, None]
        return out

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What words add to the gates of both directions."""
        out = np.empty((len(x), 6 * HIDDEN), np.float32)
        for k, at in (("f", slice(None, 3 * HIDDEN)), ("b", slice(3 * HIDDEN, None))):
            np.add(x @ self.p["W" + k], self.p["b" + k], out=out[:, at], casting="same_kind")
        return out

    def run(self, gates: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; idx picks rows of gates, mask says which places hold words."""
        n, t, h = *idx.shape, HIDDEN
        states, tape = np.zeros((n, t, 2 * h), np.float32), {}
        for k, lo, order in (("f", 0, range(t)), ("b", h, range(t - 1, -1, -1))):
            U, now, past = self.p["U" + k], np.zeros((n, h), np.float32), []
            for i in order:
                a = gates[idx[:, i], 3 * lo : 3 * lo + 3 * h]
                m = now @ U
                zr = sigmoid(a[:, : 2 * h] + m[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(a[:, 2 * h :] + r * m[:, 2 * h :])
                new = c + z * (now - c)
                if not mask[:, i].all():
                    new = np.where(mask[:, i : i + 1], new, now)
                if keep:
                    past.append((i, now, z, r, c, m[:, 2 * h :]))
                now = new
                states[:, i, lo : lo + h] = now
            tape[k] = past
        e = np.where(mask, states @ self.p["u"], np.float32(-1e9))
        e -= e.max(axis=1, keepdims=True)
        a = np.exp(e)
        a /= a.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", a, states)
        logit = pooled @ self.p["v"] + self.p["c"][0]
        return (logit, (states, tape, a, pooled)) if keep else logit

    def grad(self, words, idx, mask, y, weight):
        """Gradients of the weighted log loss for one batch of windows over the given distinct words."""
        x = self.embed(words)
        gates = self.gates(x)
        logit, (states, tape, a, pooled) = self.run(gates, idx, mask, keep=True)
        h, n = HIDDEN, len(y)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = ((sigmoid(logit) - y) * weight / n).astype(np.float32)
        g["c"][0] = d.sum()
        g["v"] = pooled.T @ d
        dp = d[:, None] * self.p["v"]
        ds = a[:, :, None] * dp[:, None, :]
        da = np.einsum("nth,nh->nt", states, dp)
        de = a * (da - (a * da).sum(axis=1, keepdims=True))
        g["u"] = np.einsum("nt,nth->h", de, states)
        ds += de[:, :, None] * self.p["u"]
        dg = np.zeros_like(gates)
        for k, lo in (("f", 0), ("b", h)):
            U, carry = self.p["U" + k], np.zeros((n, h), np.float32)
            for i, now, z, r, c, m in reversed(tape[k]):
                dh = ds[:, i, lo : lo + h] + carry
                live = mask[:, i : i + 1]
                dn = np.where(live, dh, 0)
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (now - c) * z * (1 - z)
                dr = dc * m * r * (1 - r)
                dm = np.concatenate([dz, dr, dc * r], axis=1)
                carry = np.where(live, dn * z, dh) + dm @ U.T
                g["U" + k] += now.T @ dm
                np.add.at(dg[:, 3 * lo : 3 * lo + 3 * h], idx[:, i], np.concatenate([dz, dr, dc], axis=1))
        dx = np.zeros_like(x)
        for k, lo in (("f", 0), ("b", h)):
            part = dg[:, 3 * lo : 3 * lo + 3 * h]
            g["W" + k] = x.T @ part
            g["b" + k] = part.sum(axis=0)
            dx += part @ self.p["W" + k].T
        np.add.at(g["E"], [w for w, _ in words], dx)
        g["E"][0] = 0
        size = np.array([len(q) for _, q in words])
        np.add.at(g["C"], [x for _, q in words for x in q], np.repeat(dx / size[:, None], size, axis=0))
        return g, logit


class Windows:
    """Texts as rows of word numbers, by window."""

    def __init__(self, net: Net):
        self.net, self.at, self.rows = net, {}, np.zeros((1024, 6 * HIDDEN), np.float32)

    def number(self, lists: list[list[str]]) -> None:
        """Gives numbers to new words; empties itself first if it holds too many."""
        new = set().union(*lists) - self.at.keys() if lists else set()
        if len(self.at) + len(new) > CACHE:
            self.at = {}
            new = set().union(*lists)
        if new:
            new = sorted(new)
            for w in new:
                self.at[w] = len(self.at)
            got = self.net.gates(self.net.embed([inputs(w, self.net.known) for w in new])).astype(np.float32)
            if len(self.at) > len(self.rows):  # room grows by doubling
                self.rows = np.concatenate([self.rows[: len(self.at) - len(got)], np.zeros((2 * len(self.at), got.shape[1]), np.float32)])
            self.rows[len(self.at) - len(got) : len(self.at)] = got

    def index(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word numbers, mask, text) by window."""
        return spread(np.array([self.at[w] for ws in lists for w in ws], np.int32), np.array([len(ws) for ws in lists], np.int64))


def spread(flat: np.ndarray, sizes: np.ndarray, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers, mask, text) by window, for the word numbers of texts in turn and how many words each has."""
    begins = np.concatenate([[0], np.cumsum(sizes)])
    starts, per = [], []
    for k, n in enumerate(sizes.tolist()):
        s = np.array(windows(n), np.int64)
        starts.append(s + begins[k])
        per.append(len(s))
    starts = np.concatenate([np.zeros(0, np.int64), *starts])
    doc = np.repeat(np.arange(len(sizes)), per)
    idx, mask = np.zeros((len(starts), WINDOW), np.int32), np.zeros((len(starts), WINDOW), bool)
    first = flat[0] if len(flat) else 0
    for i in range(0, len(starts), chunk):
        place = starts[i : i + chunk, None] + np.arange(WINDOW)
        inside = place < begins[1:][doc[i : i + chunk], None]
        mask[i : i + chunk] = inside
        idx[i : i + chunk] = np.where(inside, flat[np.where(inside, place, 0)], first)
    return idx, mask, doc


def features(net: Net, lists: list[list[str]], memo: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(highest logit, log(1 + toxic windows), best window, logits' documents) of each text."""
    memo.number(lists)
    return scores(net, memo.rows, *memo.index(lists), len(lists))


def scores(net: Net, gates: np.ndarray, idx: np.ndarray, mask: np.ndarray, doc: np.ndarray, n: int, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """features of n texts that are windows already."""
    logit = np.concatenate([net.run(gates, idx[i : i + chunk], mask[i : i + chunk]) for i in range(0, len(idx), chunk)]) if len(idx) else np.zeros(0, np.float32)
    top, soft, best = np.full(n, -12.0), np.zeros(n), np.zeros(n, np.int64)
    if len(logit):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        top[doc[first]] = np.maximum.reduceat(logit, first)
        soft[doc[first]] = np.log1p(np.add.reduceat(sigmoid(logit.astype(np.float64)), first))
        order = np.lexsort((-logit, doc))
        best[doc[order[first]]] = order[first]
    return np.clip(top, -12, 12), soft, best, doc


def numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], dict[str, int]]:
    """Word numbers of all texts in turn, words of each text, the words in order, and those of at least SEEN_IN texts with their
    rows. Texts become numbers one by one: the driver never holds their words as strings together."""
    at: dict[str, int] = {}
    parts, often = [np.zeros(0, np.int32)], Counter()
    for t in texts:
        part = np.array([at.setdefault(w, len(at)) for w in word_list(t)], np.int32)
        often.update(np.unique(part).tolist())
        parts.append(part)
    vocab = sorted(at)
    order = np.array([at[w] for w in vocab], np.int64)
    rank = np.empty(len(vocab), np.int32)
    rank[order] = np.arange(len(vocab), dtype=np.int32)
    known = {w: k + 1 for k, w in enumerate(w for w in vocab if often[at[w]] >= SEEN_IN)}
    return rank[np.concatenate(parts)], np.array([len(p) for p in parts[1:]], np.int64), vocab, known


class Coded:
    """The inputs of many words, as arrays."""

    def __init__(self, vocab: list[str], known: dict[str, int]):
        self.word = np.zeros(len(vocab), np.int32)
        size, grams = np.zeros(len(vocab), np.int64), array("H")
        for k, w in enumerate(vocab):
            self.word[k], g = inputs(w, known)
            grams.extend(g)
            size[k] = len(g)
        self.end, self.grams = np.cumsum(size), np.array(grams, np.int32)

    def pick(self, numbers: np.ndarray) -> list[tuple[int, list[int]]]:
        return [(w, self.grams[a:b].tolist()) for w, a, b in zip(self.word[numbers].tolist(), (self.end[numbers - 1] * (numbers > 0)).tolist(), self.end[numbers].tolist())]

    def gates(self, net: Net, chunk: int = 8192) -> np.ndarray:
        n = len(self.word)
        x = np.empty((n, DIM), np.float32)
        for i in range(0, n, chunk):
            x[i : i + chunk] = net.embed(self.pick(np.arange(i, min(n, i + chunk))))
        return net.gates(x)


def train(texts: list[str], y: np.ndarray, weight: np.ndarray, seed: int = 7, warm_windows: int = 24_000, epochs: int = 5, batch: int = 256) -> Net:
    """Fits net and head. weight: what a document of each class stands for."""
    rng = np.random.default_rng(seed)
    if not len(texts) or y.min() == y.max():
        net = Net({}, seed)
        net.head = np.array([0.0, 0.0, 4.0 if len(y) and y.min() == 1 else -4.0])
        return net
    flat, sizes, vocab, known = numbered(texts)
    net = Net(known, seed)
    apart = rng.random(len(sizes)) < 0.2
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart[:] = False  # too few for a split
    coded = Coded(vocab, known)
    idx, mask, doc = spread(flat, sizes)
    del flat, vocab
    use_doc = ~apart
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    steps = 0

    def learn(rows: np.ndarray, rate: float) -> None:
        nonlocal steps
        rng.shuffle(rows)
        for i in range(0, len(rows), batch):
            r = rows[i : i + batch]
            use, local = np.unique(idx[r], return_inverse=True)
            g, _ = net.grad(coded.pick(use), local.reshape(len(r), WINDOW), mask[r], y[doc[r]], 1.0)
            steps += 1
            for k, v in g.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.99 * s[k] + 0.01 * v * v
                net.p[k] -= (rate * (m[k] / (1 - 0.9**steps)) / (np.sqrt(s[k] / (1 - 0.99**steps)) + 1e-6)).astype(np.float32)

    def again(rows: np.ndarray, least: int) -> np.ndarray:
        """Few rows are learnt from more than once."""
        return np.tile(rows, -(-least // max(1, len(rows)))) if len(rows) < least else rows

    short = np.flatnonzero((np.bincount(doc, minlength=len(sizes))[doc] <= 8) & use_doc[doc])  # in short documents the label says most
    learn(again(rng.permutation(short if len(short) > 2000 else np.flatnonzero(use_doc[doc]))[:warm_windows], warm_windows), 0.01)
    for e in range(epochs):
        best = scores(net, coded.gates(net), idx, mask, doc, len(sizes))[2]
        some = np.flatnonzero((sizes > 0) & use_doc)
        rows = best[some]
        extra = rng.permutation(np.flatnonzero((y[doc] == 0) & use_doc[doc]))[: len(some)]
        learn(again(np.concatenate([rows, extra]), 4000), 0.01 if e < epochs - 1 else 0.003)
    top, soft, _, _ = scores(net, coded.gates(net), idx, mask, doc, len(sizes))
    x = np.column_stack([top, soft, np.ones(len(top))])
    if apart.any():
        x, y, weight = x[apart], y[apart], weight[apart]
    w = np.array([0.5, 0.5, -1.0])
    for _ in range(60):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = x.T @ (x * (weight * p * (1 - p))[:, None]) + 0.1 * np.eye(3)
        w = w - np.linalg.solve(hess, x.T @ (weight * (p - y)) + 0.1 * w)
    net.head = w
    return net


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 1500, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Net:
    """Trains on at most sample_rows labelled documents of each class, none of them held out.

    Held out: crc32 of the id as text, modulo 5, is 0. Null labels, ids and texts aren't learned from. Rows that repeat an id are
    learned from as one: the first of its texts, with the first of its labels, in order. Of very long documents the network
    first learns from some of their windows only (warm_windows of the whole sample), later from the highest of all of them.
    """
    lab = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y")).filter("doc_id is not null and y in (0, 1) and crc32(cast(doc_id as string)) % 5 != 0")
    counts = {r.y: r["count"] for r in lab.groupBy("y").count().collect()}
    ids = None
    for c in (0, 1):
        part = lab.filter(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        ids = part if ids is None else ids.unionByName(part)
    texts = base_of(docs, id_col, text_col).filter("text is not null").join(F.broadcast(ids), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).collect()  # at most sample_rows a class
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text, r.y))
    y = np.array([r.y for r in rows], np.float32)
    weight = np.array([counts[int(c)] / max(1, (y == c).sum()) for c in y])
    texts = [r.text for r in rows]
    del rows
    net = train(texts, y, weight / weight.mean() if len(weight) else weight, seed)
    del texts
    tidy()  # the driver lives on, too
    return net


def toxicity(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= 0.5), a row for each row, also where rows repeat. Texts are read whole,
    however long; no rows in, no rows out. Null and empty texts have no window
    and get the head's score for none, below 0.5 unless all labels said 1."""
    ended = net

    def scan(batches):
        net = ended
        memo = Windows(net)
        for batch in batches:
            for b in slices(batch):
                top, soft, _, _ = features(net, [word_list(t) for t in b.column(1).to_pylist()], memo)
                p = 1 / (1 + np.exp(-np.clip(top * net.head[0] + soft * net.head[1] + net.head[2], -30, 30)))
                yield pa.record_batch([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return arrow_map(base_of(docs, id_col, text_col), scan, "doc_id long, score double, predicted int")


def op8_toxicity(spark, sf_dir):
    """doc_id, held_out, score, predicted, a row for each row. A row without an id is never learned from, so it counts as held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)).alias("held_out"), "score", "predicted")
