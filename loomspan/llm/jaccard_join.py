"""N-gram Jaccard join of all documents with each other, exact, by a size-aware heavy-light join.

Documents are sets of word 5-gram hashes (64 bits). Equal sets are one class; only classes are joined.

Two classes link at threshold t when overlap o and the elements a and b that each side has alone satisfy
a + b <= o (1 - t) / t. So:

* light (small) sets: enumerate subsets of fixed size. For each o they can share, a set of size o + a gives the hash of
  each of its o-subsets; two sets link exactly when some common subset comes with small enough a and b. Nothing needs
  to be verified.
* heavy (large) sets: inverted lists over each set's prefix, the |A| - ceil(t|A|) + 1 first elements in a global order;
  linked sets share an element of their prefixes. Lists are scanned for pairs of fitting size that stand early enough: behind the
  first common element, both sets must still hold the overlap that a link takes. Pairs that sketches of 1024 parity bits
  can't rule out are verified against the whole sets.

The boundary between light and heavy is the size up to which enumerating costs less than scanning. It is computed from how many
sets of each size there are and how many pairs their inverted lists would make to be verified, counted for all small sets.
A pair of a light and a heavy set is found by the lists, which hold both near the boundary.

The global order puts elements that many documents share last (so they leave the prefixes): a bitmap of fixed size
says which those are. Any such function of the element is a correct order, so neither collisions in the bitmap nor
what the counting misses can lose a link.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, arrow_map, base_of, bitmap, components, in_bitmap, join_groups, materialise, mix, shingle_hashes, slices, utf8, where, words

K = 5
SHARED = 8
NO_ID = 2**63 - 1  # stands for a null id, behind all others
SKETCH = 1024


def doc_sets(texts: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct k-shingles, ascending."""
    data, off = utf8(texts)
    h, _, _, before = words(data, off)
    n = np.diff(before)
    docs = len(n)
    doc_of = np.repeat(np.arange(docs), n)
    sh = shingle_hashes(h, k)
    inside = doc_of[: len(sh)] == doc_of[k - 1 :] if len(sh) else np.zeros(0, bool)
    sh, owner = sh[inside], doc_of[: len(sh)][inside]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):  # the whole sequence is the one shingle; its length goes in, so it equals no longer run
        extra = []
        for d in few.tolist():
            x = U64(int(n[d]))
            for w in h[before[d] : before[d + 1]]:
                x = mix(np.array([x ^ w], U64))[0]
            extra.append(x)
        sh, owner = np.concatenate([sh, np.array(extra, U64)]), np.concatenate([owner, few])
    order = np.lexsort((sh, owner))
    sh, owner = sh[order], owner[order]
    if len(sh):
        new = np.concatenate([[True], (sh[1:] != sh[:-1]) | (owner[1:] != owner[:-1])])
        sh, owner = sh[new], owner[new]
    return sh, np.searchsorted(owner, np.arange(docs + 1))


def set_keys(sh: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set, as two arrays of signed longs."""
    def total(x):
        c = np.concatenate([np.zeros(1, U64), np.cumsum(x, dtype=U64)])
        return c[off[1:]] - c[off[:-1]]

    n = np.diff(off).astype(U64)
    return mix(total(mix(sh)) ^ n).view(np.int64), mix(total(mix(sh ^ U64(0x5851F42D4C957F2D))) + n).view(np.int64)


def sketches(sh: np.ndarray, off: np.ndarray) -> list[bytes]:
    """For each set, the parity of how many elements fall on each of 1024 bits.

    Two sketches differ in at most as many bits as the sets differ in elements, so too many differing bits rule a link out.
    """
    n, out = len(off) - 1, []
    at = (sh >> U64(54)).astype(np.int64)
    for a in range(0, n, 1024):
        b = min(a + 1024, n)
        owner = np.repeat(np.arange(b - a), np.diff(off[a : b + 1]))
        odd = np.bincount(owner * SKETCH + at[off[a] : off[b]], minlength=(b - a) * SKETCH) & 1
        packed = np.packbits(odd.astype(bool)).reshape(b - a, SKETCH // 8)
        out += [r.tobytes() for r in packed]
    return out


class Rule:
    """Links when den * overlap >= num * union."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def linked(self, o, na, nb):
        return self.den * o >= self.num * (na + nb - o)

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def enough(self, ra, rb, na, nb):
        """Whether sets may link whose first common element is followed by ra and rb elements, itself included."""
        return (self.num + self.den) * np.minimum(ra, rb) >= self.num * (na + nb)

    def alone(self, o: int) -> int:
        """Most elements that both sides together may have besides o common ones."""
        return o * (self.den - self.num) // self.num

    def subsets(self, n: int) -> list[tuple[int, int]]:
        """(o, a): sizes of subsets that a set of n gives, and what it leaves out."""
        return [(n - a, a) for a in range(n) if a <= self.alone(n - a)]

    def subset_count(self, n: int) -> int:
        return sum(math.comb(n, a) for o, a in self.subsets(n) if self.alone(o))


MOST = 29  # sets larger than this have over 400 subsets, and soon thousands


def boundary(sizes: list[tuple[int, int, float]], rule: Rule, most: int = MOST) -> int:
    """Largest size worth enumerating. sizes: (set size, sets, pairs that their lists make), over all sets up to most.

    In rows of some 30 bytes that are shuffled: enumerating costs a row a subset and no more. Scanning costs a row for each prefix
    element, and for each pair some twelve rows (itself, and two sketches joined to it) and the two sets, made again from their
    documents and joined, a row an element.
    """
    best, cost, lowest = 0, 0.0, 0.0
    for n, sets, pairs in sorted(sizes):
        if 1 <= n <= most:
            cost += sets * (rule.subset_count(n) - rule.prefix(n)) - pairs * (12 + n)
            if cost < lowest:
                best, lowest = n, cost
    return best


def small_sizes(classes: DataFrame) -> list[tuple[int, int, float]]:
    """(size, sets, pairs that inverted lists make) for the small sets; at most MOST rows. classes: n, few.

    Elements that are in many sets leave the prefixes, so their lists aren't counted. Pairs that their places in the lists rule out
    are.
    """
    small = classes.filter(F.col("n") <= MOST)
    lists = small.select("n", F.explode("few").alias("e"))
    long = lists.groupBy("e").agg(F.count("*").alias("m")).filter((F.col("m") > 1) & (F.col("m") < SHARED))
    pairs = lists.join(long, "e").groupBy("n").agg(F.sum((F.col("m") - 1) / 2).alias("pairs"))
    got = small.groupBy("n").agg(F.count("*").alias("sets")).join(pairs, "n", "left")
    return [(r.n, r.sets, float(r.pairs or 0)) for r in got.collect()]


def jaccard_components(docs: DataFrame, num: int = 90, den: int = 100, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, n_similar, component_id.

    Null, empty and blank texts have no shingles and link with nothing. Rows that repeat are documents of their own: each
    counts the others (by rows), and ids decide the component. Rows without an id are documents too: they count as similar to others
    and link them, under the id NO_ID where none of their component has one, which is returned as null. Texts are read whole,
    however long. No rows in, no rows out.
    """
    rule = Rule(num, den)
    src = base_of(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")

    def describe(batches):
        for batch in batches:
            for b in slices(batch):
                sh, off = doc_sets(b.column(1), k)
                k1, k2 = set_keys(sh, off)
                few = [sh[off[i] : off[i] + rule.prefix(int(n))].view(np.int64) if 0 < n <= MOST else [] for i, n in enumerate(np.diff(off))]
                yield pa.record_batch([b.column(0), pa.array(np.diff(off)), pa.array(k1), pa.array(k2), pa.array(sketches(sh, off), pa.binary()), pa.array(few, pa.list_(pa.int64()))], ["doc_id", "n", "k1", "k2", "sketch", "few"])

    flat = materialise(arrow_map(src, describe, "doc_id long, n long, k1 long, k2 long, sketch binary, few array<long>"))
    total = flat.count()
    classes = materialise(flat.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("few").alias("few")))
    light = boundary(small_sizes(classes), rule)

    # elements that a task sees in several different sets; their number follows the input, the bitmap does not
    def repeated(batches):
        seen, parts, held = set(), [], 0

        def flush():
            v, c = np.unique(np.concatenate(parts), return_counts=True)
            v, c = v[c > 1], c[c > 1]
            return pa.record_batch([pa.array(v.view(np.int64)), pa.array(c)], ["e", "c"])

        for batch in batches:
            for b in slices(batch):
                sh, off = doc_sets(b.column(1), k)
                k1, _ = set_keys(sh, off)
                for i, key in enumerate(k1.tolist()):
                    if key not in seen:
                        seen.add(key)
                        parts.append(sh[off[i] : off[i + 1]])
                        held += int(off[i + 1] - off[i])
                if held > 1_000_000:
                    yield flush()
                    parts, held = [], 0
                    if len(seen) > 200_000:
                        seen.clear()  # a set counted again only puts its elements later in the order
        if parts:
            yield flush()

    shared = arrow_map(src, repeated, "e long, c long").groupBy("e").agg(F.sum("c").alias("c")).filter(F.col("c") >= SHARED)
    late = bitmap(shared, "e")

    least = max(1, math.ceil(light * num / den)) if light else 1

    def signatures(batches):
        """Rows (s, kind, k1, k2, n, rest): kind 0 an element of a prefix, with the elements from it on, kind o > 0 a subset of size o."""
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for b in slices(batch):
                sh, off = doc_sets(b.column(1), k)
                k1, k2 = set_keys(sh, off)
                S, W, D, R = [], [], [], []
                for i in range(len(k1)):
                    n = int(off[i + 1] - off[i])
                    if not n or (key := (int(k1[i]), int(k2[i]))) in seen:
                        continue
                    seen.add(key)
                    v = sh[off[i] : off[i + 1]]
                    if n <= light:
                        m = mix(v)
                        with np.errstate(over="ignore"):
                            whole = m.sum(dtype=U64)
                            for o, a in rule.subsets(n):
                                if rule.alone(o) == 0:
                                    continue  # only equal sets, one class
                                out = np.array([sum((int(m[j]) for j in c), 0) & (2**64 - 1) for c in itertools.combinations(range(n), a)], U64)
                                S.append(mix(whole - out))
                                W.append(np.full(len(out), o))
                                D.append(np.full(len(out), i))
                                R.append(np.full(len(out), n))
                    if n > light or n >= least:  # light sets near the boundary also meet the heavy ones
                        p = rule.prefix(n)
                        lastly = in_bitmap(late, v.view(np.int64))
                        early = v[~lastly]
                        # v ascends by hash, so this is the order (shared, hash)
                        first = early[:p] if len(early) >= p else np.concatenate([early, v[lastly][: p - len(early)]])
                        S.append(first)
                        W.append(np.zeros(p, np.int64))
                        D.append(np.full(p, i))
                        R.append(n - np.arange(p))
                if len(seen) > 200_000:
                    seen.clear()  # only saves repeats
                if S:
                    d = np.concatenate(D)
                    yield pa.record_batch([pa.array(np.concatenate(S).view(np.int64)), pa.array(np.concatenate(W).astype(np.int16)), pa.array(k1[d]), pa.array(k2[d]), pa.array(np.diff(off)[d].astype(np.int32)), pa.array(np.concatenate(R).astype(np.int32))], ["s", "kind", "k1", "k2", "n", "rest"])

    def pairs(batches):
        """From rows sorted by (s, kind, n, k1, k2): pairs of classes of fitting size; a list is held in blocks."""

        def block(a):
            kind, n = int(a[0, 1]), a[:, 4]
            lo = np.searchsorted(n, -(-num * n // den), side="left")
            for j in range(1, len(a)):
                i = np.arange(lo[j], j)
                if kind:
                    ok = (n[i] - kind) + (n[j] - kind) <= rule.alone(kind)
                else:
                    ok = ((n[j] > light) | (n[i] > light)) & rule.enough(a[i, 5], a[j, 5], n[i], n[j])
                i = i[ok & ((a[i, 2] != a[j, 2]) | (a[i, 3] != a[j, 3]))]
                if len(i):
                    yield np.column_stack([a[i, 2:4], np.repeat(a[j : j + 1, 2:4], len(i), 0), np.full(len(i), kind > 0)])

        def emit(parts):
            p = np.concatenate(parts)
            swap = (p[:, 0] > p[:, 2]) | ((p[:, 0] == p[:, 2]) & (p[:, 1] > p[:, 3]))
            p[swap] = p[swap][:, [2, 3, 0, 1, 4]]
            p = np.unique(p, axis=0)
            return pa.record_batch([*(pa.array(p[:, c]) for c in range(4)), pa.array(p[:, 4] == 1)], ["a1", "a2", "b1", "b2", "sure"])

        def lists():
            held = np.zeros((0, 6), np.int64)
            for b in batches:
                m = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(6)])
                m = np.concatenate([held, m])
                begin = np.flatnonzero(np.concatenate([[True], (m[1:, 0] != m[:-1, 0]) | (m[1:, 1] != m[:-1, 1])])) if len(m) else np.zeros(0, np.int64)
                size = np.diff(np.append(begin, len(m)))
                for x, n in zip(begin[:-1][size[:-1] > 1].tolist(), size[:-1][size[:-1] > 1].tolist()):
                    yield m[x : x + n]
                held = m[begin[-1] :].copy() if len(begin) else m
            if len(held) > 1:
                yield held

        done, size = [], 0
        for rows in lists():
            for p in block(rows):
                done.append(p)
                size += len(p)
                if size > 300_000:
                    yield emit(done)
                    done, size = [], 0
        if done:
            yield emit(done)

    sig = arrow_map(src, signatures, "s long, kind short, k1 long, k2 long, n int, rest int")
    cand = arrow_map(sig.repartition("s").sortWithinPartitions("s", "kind", "n", "k1", "k2"), pairs, "a1 long, a2 long, b1 long, b2 long, sure boolean")
    cand = materialise(cand.groupBy("a1", "a2", "b1", "b2").agg(F.max("sure").alias("sure")))

    # verification: the sets of the classes that occur in open pairs, made again from one document of each
    def side(x):
        return classes.select(F.col("k1").alias(f"{x}1"), F.col("k2").alias(f"{x}2"), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    def not_ruled_out(batches):
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = b.column(4).to_numpy(), b.column(6).to_numpy()
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), U64).reshape(b.num_rows, -1) for c in (5, 7))
            differ = np.bitwise_count(x ^ y).sum(axis=1)
            # of a pair that differs in d elements at least, the overlap is (na + nb - d) / 2 at most
            keep = 2 * num * (na + nb) <= (num + den) * (na + nb - differ.astype(np.int64))
            yield b.select([0, 1, 2, 3]).filter(pa.array(keep))

    rough = cand.filter("not sure").join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"])
    open_pairs = materialise(arrow_map(rough.select("a1", "a2", "b1", "b2", "n_a", "sketch_a", "n_b", "sketch_b"), not_ruled_out, "a1 long, a2 long, b1 long, b2 long"))
    # a set is long: it goes to the task of its class, where repeats go, and from there once for each pair to the task of the pair's
    # class a, which gets its own set once; neither is stored
    ends = open_pairs.select(F.col("b1").alias("k1"), F.col("b2").alias("k2"), "a1", "a2", F.lit(1).alias("other"))
    ends = ends.unionByName(open_pairs.select(F.col("a1").alias("k1"), F.col("a2").alias("k2"), "a1", "a2", F.lit(0).alias("other")).distinct())
    near = bitmap(classes.join(ends.select("k1", "k2").distinct(), ["k1", "k2"]), "rep")

    def whole_sets(batches):
        for batch in batches:
            batch = where(batch, in_bitmap(near, batch.column(0).to_numpy(zero_copy_only=False)))
            for b in slices(batch):
                sh, off = doc_sets(b.column(1), k)
                k1, k2 = set_keys(sh, off)
                yield pa.record_batch([pa.array(k1), pa.array(k2), pa.array([sh[off[i] : off[i + 1]].tobytes() for i in range(len(k1))], pa.binary())], ["k1", "k2", "set"])

    sets = arrow_map(src, whole_sets, "k1 long, k2 long, set binary").dropDuplicates(["k1", "k2"])
    sent = ends.join(sets, ["k1", "k2"]).select("a1", "a2", F.col("k1").alias("b1"), F.col("k2").alias("b2"), "other", "set")

    def verify(batches):
        """From rows sorted by (a1, a2, other): a class, then those that it may link with."""
        u = np.zeros(0, U64)
        for b in batches:
            other, x = b.column(4).to_numpy(), b.column(5)
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                v = np.frombuffer(x[i].as_py(), U64)
                if not other[i]:
                    u = v
                    continue
                at = np.searchsorted(v, u)
                at[at == len(v)] = 0
                keep[i] = rule.linked(int((v[at] == u).sum()), len(u), len(v))
            yield b.select([0, 1, 2, 3]).filter(pa.array(keep))

    good = arrow_map(sent.repartition("a1", "a2").sortWithinPartitions("a1", "a2", "other"), verify, "a1 long, a2 long, b1 long, b2 long")
    links = materialise(good.unionByName(cand.filter("sure").select("a1", "a2", "b1", "b2")))
    both = links.unionByName(links.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2")))
    other = classes.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("rep").alias("rep_b"), F.col("size").alias("size_b"))
    named = materialise(both.join(other, ["b1", "b2"]).join(classes.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), "rep"), ["a1", "a2"]))
    degree = named.groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.sum("size_b").alias("more"))
    roots = components(named.select(F.col("rep").alias("a"), F.col("rep_b").alias("b"))).withColumnRenamed("id", "rep")
    full = classes.join(degree, ["k1", "k2"], "left").join(roots, "rep", "left").select("k1", "k2", "size", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_similar"), F.coalesce("root", "rep").alias("component_id"))
    full = materialise(full)
    some = join_groups(flat.filter("n > 0").drop("sketch", "few"), full, ["k1", "k2"], "size", total).select("doc_id", F.col("n").alias("n_shingles"), "n_similar", "component_id")
    none = flat.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("n_similar"), F.col("doc_id").alias("component_id"))
    out = some.unionByName(none)
    given = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(given("doc_id"), "n_shingles", "n_similar", given("component_id"))


def op1_jaccard_join(spark, sf_dir):
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (WITH RECURSIVE g(id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, g.root FROM g JOIN l ON l.a = g.id WHERE l.b > g.root) SELECT id, min(root) AS root FROM g GROUP BY id)
SELECT s.doc_id, len(sh) AS n_shingles, (SELECT count(*) FROM l WHERE l.a = s.doc_id) AS n_similar, r.root AS component_id
FROM s JOIN r ON r.id = s.doc_id
"""
