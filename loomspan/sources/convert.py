"""Documents of an external annotator as documents of this engine: plain dictionaries in and out, for use in a map."""

from __future__ import annotations

GRAPHS = ("hybrid", "enhanced", "universal-enhanced", "basic", "universal-basic")
_LAYERS = {"raw": "raw", "words": "word", "tags": "tag", "lemmas": "lemma", "entities": "entity", "chunks": "chunk"}


def best_graph(graphs: dict) -> dict | None:
    """The graph to keep: hybrid before enhanced before basic."""
    return next((graphs[k] for k in GRAPHS if k in graphs), None)


def convert_sentence(s: dict) -> dict:
    """words (required), raw, tags, lemmas, entities, chunks: lists; graphs: name -> {edges: [{source, destination, relation}], roots}."""
    n = len(s["words"])
    fields = [{"$type": "TokensField", "name": name, "tokens": s.get(k) or (s["words"] if k == "raw" else None)} for k, name in _LAYERS.items() if s.get(k) or k == "raw"]
    if g := best_graph(s.get("graphs") or {}):
        edges = [[e["source"], e["destination"], e["relation"]] for e in g.get("edges", [])]
        fields.append({"$type": "GraphField", "name": "dependencies", "edges": edges, "roots": g.get("roots", [])})
    return {"numTokens": n, "fields": fields}


def convert_document(d: dict) -> dict:
    """id and sentences; metadata, if any, is taken over as it is."""
    return {"id": d["id"], "metadata": d.get("metadata", []), "sentences": [convert_sentence(s) for s in d["sentences"]]}
