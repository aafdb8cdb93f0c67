import json

from helpers import BECKY, document, engine, spans

from loomspan.operators.engine import Engine
from loomspan.shell import Shell
from loomspan.sources import convert, corpus


def test_shell(spark):
    said = []
    sh = Shell(engine(spark, document("b", BECKY)), 5, said.append)
    for line in (":help", ":settings", ":corpus", ":labels n", ":display 1", "gummy (?<x> bears)", ":more", "[nope=x]", ""):
        assert sh.run(line)
    assert not sh.run(":exit")
    text = "\n".join(said)
    assert "1 documents, 1 sentences" in text and "nsubj" in text and "bears" in text and "no more" in text and "error" in text


def test_convert(spark):
    g = lambda label: {"edges": [{"source": 1, "destination": 0, "relation": label}], "roots": [1]}
    d = {"id": "d", "sentences": [{"words": ["she", "ran"], "tags": ["PRP", "VBD"], "graphs": {"basic": g("low"), "enhanced": g("high")}}]}
    docs = corpus.from_strings(spark, [json.dumps(convert.convert_document(d))])
    assert spans(Engine(corpus.sentences_of(docs)).query("[tag=VBD] >high []")) == [(0, 1)]
