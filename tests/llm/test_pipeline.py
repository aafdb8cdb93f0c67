import random
import zlib

import corpus_pipeline as P
import numpy as np
from loomspan.llm import decontaminate, queries, toxicity
from test_operators import sellers, shingle_set

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "decontamination", "packing"]
    sizes = [docs.count()]
    for _, stage in P.STAGES[:-1]:
        nxt = stage(spark, docs, SF)
        assert nxt.columns == docs.columns
        docs = spark.createDataFrame(nxt.collect(), nxt.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and 0.5 * sizes[0] < sizes[-1] < sizes[0]
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_every_operator_has_a_query():
    assert [any(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 11)] == [True] * 10


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    item = text(20)
    base = [text(rng.randint(30, 90)) for _ in range(60)]
    for k in range(0, 30, 3):
        w = base[k].split()
        w[-1] = "changed"
        base += [base[k], base[k].replace(" ", "\n "), " ".join(w), base[k] + " tail"]
    base += [f"{text(20)} {t} {text(20)}" for t in (item, item.upper(), item[:60] + "q" + item[61:])] + [text(20) + " zzworst " * 3 + text(20) for _ in range(40)] + [None, "", "x"]
    rng.shuffle(base)
    rows = dict(enumerate(base))
    toxic = {i for i, t in rows.items() if "zzworst" in (t or "")}
    spark.createDataFrame([(i, int(i in toxic)) for i in rows], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")

    def tox(have):
        net = toxicity.train([have[i] for i in sorted(have) if have[i] is not None and zlib.crc32(str(i).encode()) % 5], np.array([i in toxic for i in sorted(have) if have[i] is not None and zlib.crc32(str(i).encode()) % 5], np.float32), weights(have))
        top, soft, _, _ = toxicity.features(net, [toxicity.word_list(have[i]) for i in sorted(have)], toxicity.Windows(net))
        return {i for i, a, b in zip(sorted(have), top, soft) if a * net.head[0] + b * net.head[1] + net.head[2] < 0}

    def weights(have):
        y = np.array([i in toxic for i in sorted(have) if have[i] is not None and zlib.crc32(str(i).encode()) % 5])
        n = [sum(1 for i in have if (i in toxic) == c and zlib.crc32(str(i).encode()) % 5) for c in (False, True)]
        w = np.array([n[int(c)] / max(1, (y == c).sum()) for c in y])
        return w / w.mean()

    def exact(have):
        best = {}
        for i, t in have.items():
            k = "".join((t or "").split())
            best[k] = min(best.get(k, (1, 0)), (-len(t or ""), i))
        return {i for _, i in best.values()}

    def near(have):
        sets = {i: shingle_set(t) for i, t in have.items()}
        root = dict(zip(have, have))
        for _ in have:  # the smallest id spreads over links
            new = {a: min([root[a], *(root[b] for b in sets if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]))]) for a in sets}
            if new == root:
                return {i for i in have if root[i] == i}
            root = new

    def clean(have):
        p = decontaminate.Passages([(1, item)])
        fold = lambda t: " ".join((t or "").lower().split()).encode()
        return {i for i, t in have.items() if not any(sellers(bytes(p.text[k]), fold(t)) <= p.edits[k] for k in range(len(p.text)))}

    docs = spark.createDataFrame([*rows.items()], "doc_id long, text string")
    for (name, stage), brute in zip(P.STAGES, (tox, exact, near, clean)):
        kept = {r.doc_id: r.text for r in stage(spark, docs, f"file://{tmp_path}").collect()}
        want = brute(rows)
        assert set(kept) == want and kept == {i: rows[i] for i in want} and 0 < len(want) < len(rows), name
        rows = kept
        docs = spark.createDataFrame([*rows.items()], "doc_id long, text string")
    packed = P.STAGES[-1][1](spark, docs, f"file://{tmp_path}").collect()
    assert {r.doc_id for r in packed} == set(rows)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names, empty tables."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "Ä"]) + str(rng.randint(0, 999)) for _ in range(n))
    a, item = text(60), text(20)
    rows = [(1, a), (1, a), (2, a + " "), (3, a), (None, a), (None, None), (4, None), (5, ""), (6, " \n"), (7, a + " tail"), (8, text(40_000)), (9, f"{text(9)} {item} {text(9)}"), (9, text(30)), (10, "x"), (11, "ß" * 5000)]
    schema = "doc_id long, text string, n long, k1 string, split string, shard int, __gone long, owner string, sketch string"
    wide = lambda some: spark.createDataFrame([(i, t, None, "k", None, 1, 2, None, "s") for i, t in some], schema)
    spark.createDataFrame([(1, 0), (8, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, ""), (1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    stages = dict(P.STAGES)
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda i: (i is None, i or 0))
    everything = ids(wide(rows))
    want = {"toxicity": everything, "exact_dedup": [2, 7, 8, 9, 9, 10, 11, 6, None, None], "jaccard_join": [1, 1, 4, 5, 6, 8, 9, 9, 10, 11, None, None], "decontamination": [1, 1, 2, 3, 4, 5, 6, 7, 8, 10, 11, None, None]}
    for name, kept in want.items():
        out = stages[name](spark, wide(rows), f"file://{tmp_path}")
        assert out.columns == wide(rows).columns and ids(out) == sorted(kept, key=lambda i: (i is None, i or 0)), name
        assert stages[name](spark, wide([]), f"file://{tmp_path}").count() == 0
    packed = stages["packing"](spark, wide(rows), f"file://{tmp_path}")
    assert ids(packed.filter("piece = 0")) == everything
    assert stages["packing"](spark, wide([]), f"file://{tmp_path}").count() == 0
