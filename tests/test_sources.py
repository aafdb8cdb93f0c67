import json

import pytest
from helpers import BECKY, JOHN, JULIO, document, engine, sentence, spans, tokens

from loomspan.sources import corpus, mentions
from loomspan.sources.index import Index
from loomspan.streaming.live import index_stream, mention_stream


def test_mentions_round_trip(spark):
    e = engine(spark, document("b", BECKY))
    g = """
rules:
  - {name: a, type: basic, label: Food, pattern: "(?<x> gummy (?<y:Z> bears))"}
  - name: b
    type: event
    priority: 2
    label: Eat
    pattern: |
      trigger = ate
      what: Food+ = >dobj
"""
    m = e.extract(g)
    key = lambda df: sorted(json.dumps(r.asDict(True), default=str) for r in df.collect())
    for level in mentions.LEVELS:
        j = mentions.to_json(m, e.sentences, level)
        assert key(mentions.from_json(j)) == key(m)
    d = [json.loads(r.value) for r in mentions.to_json(m, e.sentences, "all").collect()]
    food = next(x for x in d if x["label"] == "Food")
    assert food["detail"]["text"] == "gummy bears" and food["detail"]["mention"]["tag"] == ["JJ", "NNS"]
    eat = next(x for x in d if x["label"] == "Eat")
    assert [a["label"] for a in eat["arguments"]["what"]] == ["Food"]
    with pytest.raises(ValueError):
        mentions.to_json(m, level="all")


def test_index(spark, tmp_path):
    ix = Index(spark, f"file://{tmp_path}/ix")
    assert ix.count() == 0
    ix.add(corpus.from_strings(spark, [document("a", BECKY, metadata=[tokens("show", ["x"])]), document("b", JOHN)]))
    assert (ix.count(), ix.fields()) == (2, ["show"])
    ix.delete("nothing")
    ix.delete("a")
    assert [r.doc_id for r in ix.documents().collect()] == ["b"]
    ix.update(corpus.from_strings(spark, [document("b", sentence("new words"))]))
    assert spans(ix.engine().query("new")) == [(0, 1)] and spans(ix.engine().query("ramen")) == []
    ix.update(corpus.from_strings(spark, [document("a", BECKY)]))
    small = ix.compact(f"file://{tmp_path}/small")
    assert small.count() == ix.count() == 2
    assert {r.term for r in ix.postings().collect()} >= {"gummy", "new"}
    assert {r.label for r in ix.vocabulary().collect()} == {"nsubj", "dobj", "punct", "amod"}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ix = Index(spark, f"file://{tmp_path}/ix")
    for k, (name, d) in enumerate([("a.json", document("a", BECKY)), ("bad.json", "{"), ("b.json", document("a", JOHN))]):
        (tmp_path / "in" / name).write_text(d)
        index_stream(ix, f"file://{tmp_path}/in", f"file://{tmp_path}/cp").awaitTermination()
    assert ix.count() == 1 and spans(ix.engine().query("ramen")) == [(2, 3)]
    assert ix.errors().count() == 1
    corpus.sentences_of(ix.documents()).write.parquet(f"file://{tmp_path}/s")
    s = spark.readStream.schema(spark.read.parquet(f"file://{tmp_path}/s").schema).parquet(f"file://{tmp_path}/s")
    q = mention_stream(s, "john (?<x> ate)").writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.start, r.end) for r in spark.table("found").collect()] == [(0, 2)]


def test_add_metadata(spark):
    docs = spark.createDataFrame([("a", document("a", BECKY, metadata=[tokens("x", ["old"])])), ("b", document("b", JOHN))], "doc_id string, value string")
    more = spark.createDataFrame([("a", json.dumps([tokens("y", ["new"])])), ("a", json.dumps([tokens("z", ["also"])]))], "docId string, fields string")
    names = lambda replace: {r.doc_id: [f["name"] for f in json.loads(r.value)["metadata"]] for r in corpus.add_metadata(docs, more, replace).collect()}
    assert sorted(names(False)["a"]) == ["x", "y", "z"] and names(False)["b"] == []
    assert sorted(names(True)["a"]) == ["y", "z"]


def test_documents_are_written_and_read_again(spark):
    meta = [{"$type": "x.TokensField", "name": "show", "tokens": ["Twin", "Peaks"]}, {"$type": "x.NumberField", "name": "n", "value": 3}, {"$type": "x.DateField", "name": "day", "date": "2001-02-03"}, {"$type": "x.NestedField", "name": "author", "fields": [{"$type": "x.TokensField", "name": "last", "tokens": ["Lynch"]}]}]
    one = corpus.from_strings(spark, [document("a", BECKY, JOHN, metadata=meta), document("b", JULIO)])
    again = corpus.from_strings(spark, [r.value for r in corpus.to_json(one).collect()])
    assert [r.asDict(True) for r in again.orderBy("doc_key").collect()] == [r.asDict(True) for r in one.orderBy("doc_key").collect()]


def test_state_is_kept(spark, tmp_path):
    from loomspan.sources.state import State

    e = engine(spark, document("a", BECKY), document("b", JOHN))
    with State(spark, f"{tmp_path}/s") as state:
        assert state.all().count() == 0
        for _ in range(2):
            state.add(e.query("[tag=NNP]", label="Name"))
        assert state.all().count() == 2 == state.get("Name").count() and state.get("Name", 0, 0).count() == 1 and state.get("X").count() == 0
        assert sorted((r.start, r.end) for r in e.query("@Name [lemma=eat]", state=state.all()).collect()) == [(0, 2), (0, 2)]
        state.clear()
        assert state.all().count() == 0
    assert e.extract("rules: [{name: n, type: basic, label: N, pattern: '[tag=NNP]'}]", limit=1).count() == 1
