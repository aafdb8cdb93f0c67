"""Mentions as JSON, one object each, and back."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.engine import CAPS, MENTION

LEVELS = ("minimal", "display", "all")


def _caps_json(caps: list[dict], parent: int = -1) -> list[dict]:
    return [{"name": c["name"], "label": c["label"], "start": c["s"], "end": c["e"], "namedCaptures": _caps_json(caps, k)} for k, c in enumerate(caps) if c["parent"] == parent]


def to_json(mentions: DataFrame, sentences: DataFrame | None = None, level: str = "minimal", display: str = "raw") -> DataFrame:
    """One column, value: an object per mention. Levels above minimal need the sentences: display adds the text, all also
    the sentence's layers."""
    if level not in LEVELS:
        raise ValueError(f"{level!r} is none of {', '.join(LEVELS)}")
    rows = mentions.withColumn("text", F.lit(None).cast("string")).withColumn("layers", F.lit(None).cast("map<string,array<string>>"))
    if level != "minimal":
        if sentences is None:
            raise ValueError("this level needs the sentences")
        layers = [c for c, t in sentences.dtypes if t == "array<string>"]
        toks = sentences.select("doc_key", "sent_id", *layers)
        rows = mentions.join(toks, ["doc_key", "sent_id"])
        cut = lambda c: F.slice(F.col(c), F.col("start") + 1, F.col("end") - F.col("start"))
        rows = rows.withColumn("text", F.array_join(cut(display), " "))
        pairs = [x for c in (layers if level == "all" else [display]) for x in (F.lit(c), cut(c))]
        rows = rows.withColumn("layers", F.create_map(*pairs))
    rows = rows.select(*mentions.columns, "text", "layers")

    def write(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                event = r["kind"] == "event"
                m = {"kind": r["kind"], "trigger" if event else "span": {"start": r["start"], "end": r["end"]}, "namedCaptures": _caps_json(r["caps"])}
                groups: dict[str, list] = {}
                for c in _caps_json(r["caps"]):
                    groups.setdefault(c["name"], []).append({k: c[k] for k in ("label", "start", "end")})
                d = {"match": m, "label": r["label"], "docKey": r["doc_key"], "docId": r["doc_id"], "sentId": str(r["sent_id"]), "foundBy": r["found_by"], "arguments": groups}
                if r["layers"] is not None:
                    d["detail"] = {"text": r["text"], "mention": dict(r["layers"])}
                out.append(json.dumps(d, ensure_ascii=False))
            yield pa.record_batch([pa.array(out, pa.string())], ["value"])

    return rows.mapInArrow(write, "value string")


def from_json(values: DataFrame) -> DataFrame:
    """Mentions again, from rows with such objects in value."""

    def flat(caps, parent, out):
        for c in caps:
            out.append({"name": c["name"], "label": c["label"], "s": c["start"], "e": c["end"], "parent": parent})
            flat(c["namedCaptures"], len(out) - 1, out)
        return out

    def read(batches):
        from ..operators.engine import _MENTION_NAMES, _MENTION_TYPES

        for b in batches:
            rows = []
            for v in b.column(0).to_pylist():
                d = json.loads(v)
                m = d["match"]
                at = m["trigger"] if m["kind"] == "event" else m["span"]
                rows.append((d["docKey"], d["docId"], int(d["sentId"]), at["start"], at["end"], d["label"], d["foundBy"], m["kind"], flat(m["namedCaptures"], -1, [])))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _MENTION_TYPES)], _MENTION_NAMES)

    return values.select("value").mapInArrow(read, MENTION)


__all__ = ["CAPS", "LEVELS", "from_json", "to_json"]
