import collections
import hashlib
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomspan.llm import common, decontaminate, exact_dedup, jaccard_join, licenses, packing, pii, secrets, suffix_dedup, token_output, toxicity
from loomspan.llm.tokens import vocabulary

WS = re.compile("[\x20\x09-\x0d]")
SCHEMA = "doc_id long, text string, n long, k1 long, split string, shard int"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "lorem", "Ipsum", "dolor", "ÄÖ", "x", "amet"]) + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [words(rng, n) for n in (3, 5, 9, 12, 19, 20, 25, 40, 60, 200, 400)]
    out = [None, "", "  \n", "a", "ß" * 300, "ab " * 400, *base]
    out += [base[9], base[9].replace(" ", "\n "), base[9] + " extra", base[10] + "  "] + [base[10]] * 6
    for b in base[3:]:  # near copies
        for _ in range(3):
            w = b.split()
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        out.append(b.upper())
        out.append(b + " tail")
    passage = words(rng, 60)
    out += [words(rng, 20) + " " + passage + " " + words(rng, 20) for _ in range(6)] + [words(rng, 20000)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3 - 30, t, 1, 2, "s", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(docs):
    return sorted((r.doc_id, r.text) for r in docs.collect())


def test_exact_dedup(spark, docs, empty):
    want, groups = {}, collections.defaultdict(list)
    for i, t in table(docs):
        groups[WS.sub("", t or "")].append((-len(t or ""), i))
    for norm, g in groups.items():
        for _, i in g:
            want[i] = (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(norm.encode()).hexdigest())
    for owners in (1_000_000, 7):
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs, owner_rows=owners).collect()} == want
    assert exact_dedup.exact_dedup(empty).count() == 0
    twice = docs.unionByName(docs)
    assert sum(r.group_size for r in exact_dedup.exact_dedup(twice).collect()) == sum(4 * v[1] for v in want.values())


def test_rice_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        v = np.sort(rng.integers(0, 2**20, n).astype(np.uint64))
        for k in (0, 3, 12):
            assert exact_dedup.unrice(exact_dedup.rice(v, k), n, k).tolist() == v.tolist()


def shingle_set(t):
    w = [x for x in WS.split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def linked(rows):
    """doc_id -> (shingles, direct links, smallest id reachable) of rows with distinct ids."""
    sets = {i: shingle_set(t) for i, t in rows}
    near = collections.defaultdict(set)
    for a in sets:
        for b in sets:
            if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                near[a].add(b)
    root = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo += near[x]
    return {i: (len(s), len(near[i]), root[i]) for i, s in sets.items()}


def joined(df, **k):
    return {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in jaccard_join.jaccard_components(df, **k).collect()}


@pytest.mark.parametrize("light", [None, 0, 25])
def test_jaccard(spark, docs, empty, light, monkeypatch):
    want = linked(table(docs))
    if light is not None:
        monkeypatch.setattr(jaccard_join, "boundary", lambda *_: light)
    assert joined(docs) == want
    assert sum(v[1] > 0 for v in want.values()) > 10
    if light is None:
        assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_light_half(spark, monkeypatch):
    """Many short near copies: the cost sends them to the enumeration, which finds their links."""
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        w = words(rng, rng.randint(15, 22)).split()
        texts += [" ".join(w), " ".join([*w, "more"]), " ".join([*w, "else"])]
    rows = [*enumerate(texts), (1000, words(rng, 40)), (None, texts[0]), (None, texts[0])]
    pairs, real = [], jaccard_join.materialise
    monkeypatch.setattr(jaccard_join, "materialise", lambda df: pairs.append(real(df)) or pairs[-1])
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sure = [x for x in pairs if "sure" in x.columns]
    assert len(sure) == 1 and sure[0].filter("sure").count() > 50
    want = linked([(i if i is not None else 5000 + k, t) for k, (i, t) in enumerate(rows)])
    assert {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in got if r.doc_id is not None} == {i: v for i, v in want.items() if i < 5000}
    assert [(r.n_similar, r.component_id) for r in got if r.doc_id is None] == [(want[i][1], want[i][2]) for i in want if i >= 5000]


def test_jaccard_candidates_by_place(spark, monkeypatch):
    """Sets that first meet too late in their prefixes to link are no candidates; links at the threshold are, and large sets are not
    stored."""
    rng = random.Random(21)
    rows, fresh = [], lambda n: [f"w{rng.getrandbits(48):x}" for _ in range(n)]
    for i in range(0, 400, 2):
        a, b = fresh(rng.randint(60, 90)), fresh(rng.randint(60, 90))
        at = rng.randrange(50)
        b[at : at + 5] = a[at : at + 5]  # one shingle in common
        rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
    for i in range(1000, 1080, 2):
        a = fresh(99)  # 95 shingles; the last of each of two differ, in 5 elements: 90 of 100
        rows += [(i, " ".join(a)), (i + 1, " ".join(a[:94] + fresh(5 + i // 2 % 2)))]
    made, real = [], jaccard_join.materialise
    monkeypatch.setattr(jaccard_join, "materialise", lambda df: made.append(real(df)) or made[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = linked(rows)
    assert joined(df) == want
    assert sum(v[1] for v in want.values()) == 40
    sh, off = jaccard_join.doc_sets(pa.array([t for _, t in rows]))
    sets = [sh[x:y].tolist() for x, y in zip(off[:-1], off[1:])]
    rule, meet, early = jaccard_join.Rule(90, 100), 0, 0
    for u, v in zip(sets[::2], sets[1::2]):
        common = set(u[: rule.prefix(len(u))]) & set(v[: rule.prefix(len(v))])
        if common and 10 * min(len(u), len(v)) >= 9 * max(len(u), len(v)):
            first = min(common)
            most = min(len(u) - u.index(first), len(v) - v.index(first))
            meet, early = meet + 1, early + (190 * most >= 90 * (len(u) + len(v)))
    (cand,) = [x for x in made if "sure" in x.columns]
    assert cand.count() == early < meet
    assert not any("set" in x.columns for x in made)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1040)]
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    root = {}
    for i in sorted(near):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo += near[x]
    got = {r.id: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: r for i, r in root.items() if near[i] != {i}}


def naive_suffix(rows, width=100):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        cov = np.zeros(len(b), bool)
        for s in range(len(b) - width + 1):
            if b[s : s + width] in seen:
                cov[s : s + width] = True
            else:
                seen.add(b[s : s + width])
        edges = np.diff(np.concatenate([[0], cov.astype(int), [0]]))
        out[i] = (len(b), int(cov.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cov])).hexdigest())
    return out


@pytest.mark.parametrize("hot", [(2000, 3), (2, 2)])
def test_suffix_dedup(spark, docs, empty, hot):
    src = common.base_of(docs)
    got = suffix_dedup.cut_spans(src, suffix_dedup.repeated_spans(src, hot_contexts=hot[0], local_contexts=hot[1]), True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == naive_suffix(table(docs))
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)
    if hot[0] > 2:
        assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_contexts_that_share_no_string_stay_apart():
    """A common 20-gram alone neither sends contexts to be sorted nor cuts them into single strings, and no link is lost."""
    rng = random.Random(8)
    word = lambda n: bytes(rng.choice(b"abcdefghijklmnop") for _ in range(n))
    base, pool = word(600), np.frombuffer(word(20_000), np.uint8)
    at = np.arange(len(pool) - 19)
    at = int(np.argmin(common.mix(suffix_dedup._hash(suffix_dedup._prefix(pool, suffix_dedup._P), suffix_dedup._P, at, at + 20))))
    gram = pool[at : at + 20].tobytes()  # the anchor wherever it stands
    apart = [word(90) + gram + word(90) for _ in range(300)]
    linked = [word(rng.randint(0, 70)) + base[(i := rng.randint(0, 480)) : i + rng.randint(90, 180)] + word(rng.randint(0, 70)) for _ in range(150)]
    for texts in (apart, linked):
        data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        plain = suffix_dedup.contexts(data, off, None)
        bits = np.zeros(1 << 25, bool)
        bits[(common.mix(plain[0]) >> np.uint64(39)).astype(np.int64)] = True
        for a, c, row, lo, n, before, after in (plain, suffix_dedup.contexts(data, off, np.packbits(bits).tobytes())):
            assert int((n - 99).sum()) == sum(max(0, len(t) - 99) for t in texts)  # each string is in one context
            assert len(a) <= 2 * len(plain[0])
            number = np.unique(a, return_inverse=True)[1]
            first = np.unique(np.column_stack([a, c]), axis=0, return_index=True)[1]
            share = dict(zip(first.tolist(), suffix_dedup._may_share(number[first], (before >> np.uint64(32) << np.uint64(32) | after >> np.uint64(32)).view(np.int64)[first]).tolist()))
            if texts is apart and a is plain[0]:
                assert np.bincount(number).max() > 250 and not any(share.values())
            held = collections.defaultdict(set)
            for k in first.tolist():
                t = texts[row[k]]
                for s in range(lo[k], lo[k] + n[k] - 99):
                    held[t[s : s + 100]].add(k)
            links = [ks for ks in held.values() if len(ks) > 1]
            assert all(len({a[k] for k in ks}) == 1 and all(share[k] for k in ks) for ks in links) and bool(links) == (texts is linked)


def test_pii_and_secrets(spark, docs, empty):
    extra = spark.createDataFrame([(900, "mail a@b.co token = 'abcdefghijkl1'", 1, 1, "", 1), (None, "x@y.de", 1, 1, "", 1)], SCHEMA)
    both = docs.unionByName(extra)
    for op, what in ((pii.pii, "kind"), (secrets.secrets, "rule")):
        got = op(both).collect()
        assert len(got) == both.count() and {f[what] for r in got if r.doc_id == 900 for f in r.found} == ({"email"} if what == "kind" else {"assign"})
        assert op(empty).count() == 0


def sellers(p, t):
    d = [0] * (len(t) + 1)
    for i, x in enumerate(p):
        new = [i + 1]
        for j, y in enumerate(t):
            new.append(min(d[j] + (x != y), d[j + 1] + 1, new[j] + 1))
        d = new
    return min(d)


def test_decontaminate(spark, empty):
    rng = random.Random(7)
    items = [(k, words(rng, n)) for k, n in enumerate((4, 12, 20, 40))] + [(8, None), (9, ""), (10, "short"), (11, "fifteen letters")]
    texts = [None, "", "x", words(rng, 300)]
    for _, t in items[:4]:
        for edits in (0, 2, 5, 9, 14):
            b = list(t)
            for _ in range(edits):
                at = rng.randrange(len(b))
                b[at : at + 1] = rng.choice([[], ["q"], [b[at], "q"]])
            texts.append(words(rng, 30) + "  " + "".join(b).upper() + "\n" + words(rng, 30))
            texts.append("".join(b)[2:] + " " + words(rng, 5))  # cut at the text's beginning and end
            texts.append(words(rng, 5) + " " + "".join(b)[:-2])
    texts += ["SHORT", "it is short.", "shortly", "a\x20short", *(texts[-1:] * 2), words(rng, 1200) + items[3][1] + words(rng, 1200)]
    docs = spark.createDataFrame([(k, t, 1, 1, "", 1) for k, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()}
    fold = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")).encode()
    P = decontaminate.Passages(items)
    want = {(k, 10) for k, t in enumerate(texts) if re.search(r"(?<![0-9a-z])short(?![0-9a-z])", fold(t).decode())} | {(k, P.item[p]) for k, t in enumerate(texts) for p in range(len(P.text)) if sellers(bytes(P.text[p]), fold(t)) <= P.edits[p]}
    assert got == want and len(want) > 8
    assert decontaminate.contamination(empty, bench).count() == 0 == decontaminate.contamination(docs, bench.limit(0)).count()
    blocks = decontaminate.BLOCK_BYTES
    try:
        decontaminate.BLOCK_BYTES = 60
        assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()} == want
    finally:
        decontaminate.BLOCK_BYTES = blocks


def test_decontaminate_runs_of_one_letter():
    P = decontaminate.Passages([(1, "a rule " + "-" * 60 + " and words that follow it in the text"), (2, "-" * 80)])
    tracemalloc.start()
    began = time.time()
    assert decontaminate.search(pa.array(["-" * 200_000]), P) == [(0, 2, 1, 0, 0, 200_000)]
    assert time.time() - began < 30 and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_licenses(spark, docs, empty):
    rng = random.Random(8)
    rows, want = [], set()
    for k, (name, forms) in enumerate(licenses.TEMPLATES.items()):
        for j, t in enumerate(forms):
            rows.append((k * 10 + j, words(rng, 50) + "\n" + t.upper() + ".\n" + words(rng, 50), 1, 1, "", 1))
            want.add((k * 10 + j, name))
    got = licenses.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc_id, r.license) for r in got} == want
    text = dict((r[0], r[1]) for r in rows)
    assert all(text[r.doc_id][r.start : r.end] in {t.upper() for t in licenses.TEMPLATES[r.license]} for r in got)
    assert licenses.license_scan(docs).count() == 0 == licenses.license_scan(empty).count()
    assert licenses.collision_probability(0.8) > 0.998


def test_toxicity(spark, empty):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(150)]
    bad = ["zzworst", "zzawful", "zzmean"]
    rows, labels = [], []
    for k in range(700):
        toxic = k % 3 == 0
        w = [rng.choice(vocab) for _ in range(rng.randint(10, 80))]
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((k, " ".join(w), 1, 1, "", 1))
        labels.append((k, int(toxic)))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (5000, None)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels, sample_rows=200)
    odd = spark.createDataFrame([(9001, None, 1, 1, "", 1), (9002, "", 1, 1, "", 1), (9003, "é" * 50_000, 1, 1, "", 1)], SCHEMA)
    got = {r.doc_id: r for r in toxicity.toxicity(docs.unionByName(odd), net).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [k for k in range(700) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([got[k].predicted == (k % 3 == 0) for k in held]) > 0.95
    assert got[9001].predicted == got[9002].predicted == 0
    assert toxicity.toxicity(empty, net).count() == 0
    assert toxicity.fit(docs, labels.limit(0)).head[2] < 0


def test_toxicity_reads_long_runs_whole():
    trigrams = lambda w: {w[i : i + 3] for i in range(len(w) - 2)}
    rng = random.Random(9)
    for n in (1, 13, 14, 15, 16, 17, 26, 27, 40, 301):
        w = "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
        got = toxicity.word_list(f"x {w}.")
        assert got[0] == "x" and trigrams(w) == set().union(*map(trigrams, got[1:])) and "".join(got[1:])[-1] == w[-1]
        assert all(len(toxicity.inputs(g, {})[1]) == len(g) <= 14 for g in got)

    def run(toxic):  # an unspaced text that is toxic, if at all, behind its first 15 letters
        w = "".join(rng.choice("abcdefghij") for _ in range(90))
        at = rng.randrange(20, 80)
        return w[:at] + "zworstz" * toxic + w[at:]

    y = [k % 2 for k in range(500)]
    texts = [run(t) for t in y]
    net = toxicity.train(texts[:400], np.array(y[:400], np.float32), np.ones(400))
    top, soft, _, _ = toxicity.features(net, [toxicity.word_list(t) for t in texts[400:]], toxicity.Windows(net))
    assert np.mean((top * net.head[0] + soft * net.head[1] + net.head[2] >= 0) == (np.array(y[400:]) == 1)) > 0.9


def test_gradient():
    rng = np.random.default_rng(0)
    net = toxicity.Net({"a": 1, "b": 2})
    for k, v in net.p.items():
        net.p[k] = (rng.standard_normal(v.shape) * 0.3).astype(np.float64)
    net.p["E"][0] = 0
    coded = [toxicity.inputs(w, net.known) for w in ("a", "b", "cc")]
    idx, mask = rng.integers(0, 3, (4, 6)), np.ones((4, 6), bool)
    mask[0, 4:] = mask[1, 2:] = False
    y = np.array([0, 1, 1, 0.0])

    def loss():
        logit, _ = net.run(net.gates(net.embed(coded)), idx, mask, keep=True)
        p = 1 / (1 + np.exp(-logit))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g, _ = net.grad(coded, idx, mask, y, 1.0)
    for k in ("E", "Wf", "Ub", "bf", "u", "v", "c"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, eps = net.p[k][at], 1e-3
        net.p[k][at] = old + eps
        up = loss()
        net.p[k][at] = old - eps
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 2e-2 * max(abs(g[k][at]), 1e-2), k


def test_token_output(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    files = token_output.write_tokens(docs, path, 1, f"file://{tmp_path}/t")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_output.read_tokens(spark, f"file://{tmp_path}/t", files).collect()}
    at, want = 0, {}
    for i, t in table(docs):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want
    files = token_output.write_tokens(empty, path, 1, f"file://{tmp_path}/e")
    assert token_output.read_tokens(spark, f"file://{tmp_path}/e", files).count() == 0


@pytest.mark.parametrize("shard_rows", [16_384, 20])
def test_packing(spark, docs, empty, shard_rows):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack_pieces(packing.cut(common.base_of(docs), path, 2, 1024), 1024, shard_rows).collect()
    want = set()
    for i, t in table(docs):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want |= {(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    assert len(seqs) <= -(-sum(r.length for r in got) // 1024) + 1
    if shard_rows > 20:
        assert packing.best_fit_packing(empty, path).count() == 0


def test_packing_moves_few_pieces_on(spark, monkeypatch):
    rows = [(1, 0, 0, 600, 7)] * 9000 + [(k, 0, 0, 540 + k % 300, k) for k in range(2, 9002)] + [(k, 0, 0, 100, k) for k in range(20_000, 21_000)]
    groups, real = [], packing.materialise

    def watch(df):
        out = real(df)
        if "sequence_id" in out.columns:
            moved = out.filter("sequence_id is null")
            groups.append([max([r["count"] for r in x.groupBy("shard").count().collect()], default=0) for x in (out, moved)])
        return out

    monkeypatch.setattr(packing, "materialise", watch)
    got = packing.pack_pieces(spark.createDataFrame(rows, packing.PIECE).repartition(3), 1024, 2048).collect()
    assert len(groups) == 2 and all(m <= 1024 for _, m in groups) and groups[0][0] < 2 * 2048 and groups[1][0] <= 16 * 1024
    assert sorted((r.doc_id, r.length) for r in got) == sorted((r[0], r[3]) for r in rows)
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 1024
    assert len(seqs) == 18_000  # no two of the long pieces fit, and the short ones fill gaps


def test_packing_of_all_that_is_left_over(spark):
    """Surplus pieces of different shards find each other, however many pieces that fit nowhere stand beside them."""
    lengths = [600] * 4500 + [424] * 4500 + [700] * 9000
    rows = [(k, 0, 0, n, k) for k, n in enumerate(lengths)]
    got = packing.pack_pieces(spark.createDataFrame(rows, packing.PIECE).repartition(3), 1024, 2048).collect()
    assert sorted((r.doc_id, r.length) for r in got) == sorted((r[0], r[3]) for r in rows)
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(s)[0][0] == 0 and sum(n for _, n in s) <= 1024 and all(o + n == p for (o, n), (p, _) in zip(sorted(s), sorted(s)[1:])) for s in seqs.values())
    assert len(seqs) == 13_500


def test_counted_best_fit_is_best_fit():
    rng = random.Random(6)
    for _ in range(60):
        cap = rng.choice([50, 1024])
        lengths = [rng.choice([rng.randint(1, cap - 1), cap // 2, cap // 3 + 1, 3]) for _ in range(rng.randint(0, 300))]
        got = packing.best_fit_counted(collections.Counter(lengths), [], cap)
        assert sorted(b for b, k in got for _ in range(k)) == sorted(packing.best_fit(lengths, [], cap))
        best = packing.evolve_counted(collections.Counter(lengths), cap, 1)
        assert sorted(n for b, k in best for _ in range(k) for n in b) == sorted(lengths) and all(sum(b) <= cap for b, _ in best)
        assert sum(k for _, k in best) <= sum(k for _, k in got)


def test_islands_are_rows_and_pass_their_elites_on(spark, monkeypatch):
    rng = random.Random(3)
    lengths = [rng.choice([200, 310, 340, 350, 500, 512, 513]) for _ in range(300)]
    shards = spark.createDataFrame([(s, n, m) for s in (5, 6) for n, m in collections.Counter(lengths).items()], "shard long, length int, n long")
    seen, real = [], packing.materialise
    monkeypatch.setattr(packing, "materialise", lambda df: seen.append(real(df)) or seen[-1])
    got = {r.shard: packing.from_bytes(bytes(r.genome)) for r in packing.archipelago(shards, 1024, 0, islands=3).collect()}
    assert set(got) == {5, 6} and all(sorted(x for b in g for x in b) == sorted(lengths) and max(map(sum, g)) <= 1024 for g in got.values())
    assert [x.count() for x in seen] == [6, 6]
    first, last = ({(r.shard, r.island): r for r in x.collect()} for x in seen)
    for (s, k), r in last.items():  # an island does no worse than what it was sent
        sent = first[s, (k - 1) % 3]
        assert (r.n_bins, r.waste) <= (sent.n_bins, sent.waste)
    assert all(len(g) == min(r.n_bins for (s, _), r in last.items() if s == shard) for shard, g in got.items())


def test_training_holds_no_words_as_strings():
    """The driver trains: besides the texts it needs a few bytes a word, not a string for each."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randint(0, 20_000)}" for _ in range(3000)) for _ in range(200)]
    y = np.array([k % 2 for k in range(200)], np.float32)
    tracemalloc.start()
    net = toxicity.train(texts, y, np.ones(200), warm_windows=256, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(net.known) > 10_000 and peak < 40e6


def test_evolution_beats_or_equals_best_fit():
    rng = random.Random(6)
    for _ in range(5):
        lengths = [rng.choice([200, 310, 340, 350, 500, 512, 513]) for _ in range(200)]
        bins = packing.evolve(lengths, 1024, 1)
        assert sorted(x for b in bins for x in b) == sorted(lengths) and all(sum(b) <= 1024 for b in bins)
        assert len(bins) <= len(packing.best_fit(lengths, [], 1024))


def test_slices_and_bitmap(spark):
    b = pa.record_batch([pa.array([1, 2, 3]), pa.array(["a" * 10, None, "b" * 100])], ["doc_id", "text"])
    assert [x.num_rows for x in common.slices(b, limit=5)] == [1, 1, 1]
    keys = np.arange(-5, 200, 3)
    bits = common.bitmap(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k")
    assert len(bits) == 1 << 22 and common.in_bitmap(bits, keys).all() and common.in_bitmap(bits, keys + 1).mean() < 0.05


def test_hot_groups_are_joined_whole(spark):
    rows = spark.createDataFrame([(i, 0 if i < 3000 else i) for i in range(4000)], "id long, k long")
    groups = rows.groupBy("k").count()
    got = common.join_groups(rows, groups, ["k"], "count", 4000)
    assert got.count() == 4000 and got.filter("k = 0 and count = 3000").count() == 3000
