import json

from loomspan.operators.engine import Engine
from loomspan.sources import corpus


def tokens(name, values):
    return {"$type": "x.TokensField", "name": name, "tokens": values}


def sentence(text, edges=(), roots=(), **layers):
    raw = text.split()
    fields = [tokens("raw", raw), tokens("word", raw)] + [tokens(k, v.split()) for k, v in layers.items()]
    if edges:
        fields.append({"$type": "x.GraphField", "name": "dependencies", "edges": [list(e) for e in edges], "roots": list(roots)})
    return {"numTokens": len(raw), "fields": fields}


def document(id_, *sentences, metadata=()):
    return json.dumps({"id": id_, "metadata": list(metadata), "sentences": list(sentences)}, ensure_ascii=False)


def engine(spark, *documents):
    d = corpus.from_strings(spark, list(documents))
    return Engine(corpus.sentences_of(d), corpus.docs_of(d))


def spans(df):
    return sorted((r.start, r.end) for r in df.collect())


BECKY = sentence("Becky ate gummy bears .", [(1, 0, "nsubj"), (1, 3, "dobj"), (1, 4, "punct"), (3, 2, "amod")], [1], lemma="becky eat gummy bear .", tag="NNP VBD JJ NNS .", chunk="B-NP B-VP B-NP I-NP O", entity="PERSON O O O O")
JOHN = sentence("John ate ramen with chopsticks and a spoon .", [(1, 0, "nsubj"), (1, 2, "dobj"), (1, 4, "nmod_with"), (1, 7, "nmod_with"), (1, 8, "punct"), (4, 3, "case"), (4, 5, "cc"), (4, 7, "conj"), (7, 6, "det")], [1], lemma="john eat ramen with chopstick and a spoon .", tag="NNP VBD NN IN NNS CC DT NN .")
DAISY = sentence("Daisy ate macaroni at her house .", [(1, 0, "nsubj"), (1, 2, "dobj"), (1, 5, "nmod_at"), (5, 3, "case"), (5, 4, "nmod:poss")], [1], lemma="daisy eat macaroni at she house .", tag="NNP VBD NN IN PRP$ NN .")
JULIO = sentence("She saw me and Julio .", [(1, 0, "nsubj"), (1, 2, "dobj"), (1, 4, "dobj"), (1, 5, "punct"), (2, 3, "cc"), (2, 4, "conj_and")], [1], lemma="she see I and julio .", tag="PRP VBD PRP CC NNP .")
