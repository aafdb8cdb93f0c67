"""Corpora: from annotated JSON documents or plain text to tables of sentences and documents."""

from __future__ import annotations

import datetime
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..errors import QueryError
from ..functions.text import aggressive, nfkc

MAX_TOKENS = 100
LAYERS = ("raw", "word", "lemma", "tag", "chunk", "entity")
_MAPS = "text_fields map<string,array<array<string>>>, num_fields map<string,array<double>>"
_STRUCT = ",".join(f"{a.split(' ', 1)[0]}:{a.split(' ', 1)[1]}" for a in ["sent_id int", "num_tokens int", *(f"{x} array<string>" for x in LAYERS), "norm array<array<string>>", "incoming array<array<string>>", "outgoing array<array<string>>", "edges array<struct<src:int,dst:int,label:string>>", "roots array<int>"])
DOCUMENT = f"doc_key long, doc_id string, file_name string, {_MAPS}, nested array<struct<name:string,text_fields:map<string,array<array<string>>>,num_fields:map<string,array<double>>>>, sentences array<struct<{_STRUCT}>>, error string"


_S, _LS = pa.string(), pa.list_(pa.string())
_LLS = pa.list_(_LS)
_TEXT, _NUM = pa.map_(_S, _LLS), pa.map_(_S, pa.list_(pa.float64()))
_SENTENCE = pa.struct([("sent_id", pa.int32()), ("num_tokens", pa.int32()), *((x, _LS) for x in LAYERS), ("norm", _LLS), ("incoming", _LLS), ("outgoing", _LLS), ("edges", pa.list_(pa.struct([("src", pa.int32()), ("dst", pa.int32()), ("label", _S)]))), ("roots", pa.list_(pa.int32()))])
_ARROW = pa.schema([("doc_key", pa.int64()), ("doc_id", _S), ("file_name", _S), ("text_fields", _TEXT), ("num_fields", _NUM), ("nested", pa.list_(pa.struct([("name", _S), ("text_fields", _TEXT), ("num_fields", _NUM)]))), ("sentences", pa.list_(_SENTENCE)), ("error", _S)])


def _kind(f: dict) -> str:
    return str(f.get("$type", "")).rsplit(".", 1)[-1]


def metadata_maps(fields: list[dict], nested_allowed: bool = True):
    """(text fields, number fields, nested) of a document's metadata."""
    text: dict[str, list] = {}
    num: dict[str, list] = {}
    nested = []
    for f in fields:
        kind, name = _kind(f), f["name"]
        if kind == "TokensField":
            text.setdefault(name, []).append([t for x in f["tokens"] for t in aggressive(x).split()])
        elif kind == "DateField":
            d = datetime.date.fromisoformat(f["date"][:10])
            num.setdefault(name, []).append(float((d - datetime.date(1970, 1, 1)).days))
            num.setdefault(f"{name}.year", []).append(float(d.year))
        elif kind == "NumberField":
            num.setdefault(name, []).append(float(f["value"]))
        elif kind == "NestedField":
            if not nested_allowed:
                raise QueryError("nested fields can't be nested again")
            t, n, _ = metadata_maps(f["fields"], False)
            nested.append({"name": name, "text_fields": t, "num_fields": n})
        elif kind != "StringField":
            raise QueryError(f"{kind!r} is no kind of metadata field")
    return text, num, nested


def sentence_row(sent: dict, number: int, max_tokens: int = MAX_TOKENS) -> dict | None:
    """A sentence's row; None for one of more than max_tokens. A token of white space alone becomes a placeholder."""
    n = sent["numTokens"]
    if n > max_tokens:
        return None
    row: dict = {"sent_id": number, "num_tokens": n, "edges": [], "roots": [], **dict.fromkeys(LAYERS)}
    for f in sent["fields"]:
        if _kind(f) == "TokensField":
            if len(f["tokens"]) != n:
                raise QueryError(f"layer {f['name']} has {len(f['tokens'])} tokens, the sentence {n}")
            if f["name"] in LAYERS:
                row[f["name"]] = [nfkc(t) if t.strip() else "???" for t in f["tokens"]]
        elif _kind(f) == "GraphField":
            row["edges"] = [{"src": int(a), "dst": int(b), "label": c} for a, b, c in f["edges"]]
            row["roots"] = [int(r) for r in f.get("roots", [])]
    into: list[list] = [[] for _ in range(n)]
    out: list[list] = [[] for _ in range(n)]
    for e in row["edges"]:
        if not (0 <= e["src"] < n and 0 <= e["dst"] < n):
            raise QueryError(f"edge {e} leaves the sentence")
        into[e["dst"]].append(e["label"])
        out[e["src"]].append(e["label"])
    row["incoming"], row["outgoing"] = [sorted(set(x)) for x in into], [sorted(set(x)) for x in out]
    have = [row[x] for x in ("raw", "word") if row[x] is not None]
    row["norm"] = [sorted({aggressive(x[i]) for x in have}) for i in range(n)]
    return row


def parse_documents(texts: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Documents from rows (doc_key, file_name, value) with one JSON document each; error is set where one can't be read."""

    def parse(batches):
        for b in batches:
            rows = []
            for key, name, value in zip(*(c.to_pylist() for c in b.columns)):
                row = {"doc_key": key, "doc_id": None, "file_name": name, "text_fields": {}, "num_fields": {}, "nested": [], "sentences": [], "error": None}
                try:
                    d = json.loads(value or "")
                    row["doc_id"] = d["id"]
                    row["text_fields"], row["num_fields"], row["nested"] = metadata_maps(d.get("metadata", []))
                    row["sentences"] = [r for k, s in enumerate(d.get("sentences", [])) if (r := sentence_row(s, k, max_tokens))]
                except (ValueError, KeyError, TypeError, AttributeError) as e:  # a bad document doesn't end the job
                    row |= {"sentences": [], "error": f"{type(e).__name__}: {e}"}
                rows.append(row)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return texts.select("doc_key", "file_name", "value").mapInArrow(parse, DOCUMENT)


def read_json(spark: SparkSession, path: str | list[str], max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Documents of a folder, searched through, of .json and .json.gz files with one document each."""
    raw = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").option("pathGlobFilter", "*.json*").text(path)
    name = F.col("_metadata.file_path")
    return parse_documents(raw.select(F.xxhash64(name, "value").alias("doc_key"), name.alias("file_name"), "value"), max_tokens)


def from_strings(spark: SparkSession, documents: list[str], max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Documents given as JSON texts, keyed in the order given."""
    return parse_documents(spark.createDataFrame([(k, None, d) for k, d in enumerate(documents)], "doc_key long, file_name string, value string"), max_tokens)


def sentences_of(documents: DataFrame) -> DataFrame:
    return documents.filter("error is null").select("doc_key", "doc_id", F.explode("sentences").alias("s")).select("doc_key", "doc_id", "s.*")


def docs_of(documents: DataFrame) -> DataFrame:
    return documents.filter("error is null").drop("sentences", "error")


def to_json(documents: DataFrame) -> DataFrame:
    """Documents as JSON again, one object in value for each; what parse_documents reads from it equals what was written.

    Dates are written as the numbers that they are kept as.
    """

    def fields(text, num) -> list[dict]:
        out = [{"$type": "TokensField", "name": k, "tokens": v} for k, vs in text for v in vs]
        return out + [{"$type": "NumberField", "name": k, "value": v} for k, vs in num for v in vs]

    def write(batches):
        for b in batches:
            values = []
            for r in b.to_pylist():
                meta = fields(r["text_fields"], r["num_fields"]) + [{"$type": "NestedField", "name": x["name"], "fields": fields(x["text_fields"], x["num_fields"])} for x in r["nested"]]
                sentences = []
                for s in r["sentences"]:
                    layers = [{"$type": "TokensField", "name": x, "tokens": s[x]} for x in LAYERS if s[x] is not None]
                    graph = {"$type": "GraphField", "name": "dependencies", "edges": [[e["src"], e["dst"], e["label"]] for e in s["edges"]], "roots": s["roots"]}
                    sentences.append({"numTokens": s["num_tokens"], "fields": [*layers, graph]})
                values.append(json.dumps({"id": r["doc_id"], "metadata": meta, "sentences": sentences}, ensure_ascii=False))
            yield pa.record_batch([pa.array(values, pa.string())], ["value"])

    return documents.filter("error is null").mapInArrow(write, "value string")


def add_metadata(documents: DataFrame, companions: DataFrame, replace: bool = False) -> DataFrame:
    """JSON documents (doc_id, value) with the fields of companion files (docId, fields as JSON) appended, or put in place of theirs."""
    by = companions.groupBy(F.col("docId").alias("doc_id")).agg(F.collect_list("fields").alias("more"))

    @F.pandas_udf("string")
    def merge(value: pd.Series, more: pd.Series) -> pd.Series:
        def one(v, m):
            if m is None or not len(m):
                return v
            d = json.loads(v)
            new = [f for x in m for f in json.loads(x)]
            d["metadata"] = new if replace else d.get("metadata", []) + new
            return json.dumps(d, ensure_ascii=False)

        return pd.Series([one(v, m) for v, m in zip(value, more)])

    return documents.join(by, "doc_id", "left").select("doc_id", merge("value", "more").alias("value"))


# --- plain text -----------------------------------------------------------------------------------------------------


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _norms(raw: pd.Series) -> pd.Series:
    return raw.map(lambda ts: None if ts is None else [[aggressive(t)] for t in ts])


def tag_of(t: Column) -> Column:
    """A token's class by its form: NUM, CAP, PUNCT or W."""
    return F.when(t.rlike(r"^[0-9][0-9.,]*\z"), "NUM").when(t.rlike("^[A-Z]"), "CAP").when(t.rlike(r"^[^A-Za-z0-9\u0080-￿]+\z"), "PUNCT").otherwise("W")


def plain_text(docs: DataFrame, key: Column, doc_id: Column, text: Column) -> DataFrame:
    """What annotate makes sentences of, for an engine that cuts them itself."""
    return docs.select(key.cast("long").alias("doc_key"), doc_id.cast("string").alias("doc_id"), text.alias("text"))


def annotate(docs: DataFrame, key: Column, doc_id: Column, text: Column, max_tokens: int | None = None, graph: bool = True) -> DataFrame:
    """Sentences of plain text, tokens apart by spaces, with rule-made layers. A sentence ends with its line, or with a full stop,
    exclamation or question mark before a space. max_tokens leaves longer sentences out; by default none are.

    tag by form, chunk B/I over runs of capitalised tokens, entity O, lemma lower-cased; edges next (i to i + 1), head
    (0 to each other token) and mod (a token to a capitalised one right behind it). Native but for norm, which is only
    computed where it is asked for.
    """
    lines = docs.select(key.alias("doc_key"), doc_id.cast("string").alias("doc_id"), F.posexplode(F.split(F.regexp_replace(text, "([.!?]) ", "$1\n"), "\n")).alias("sent_id", "line"))
    s = lines.select("doc_key", "doc_id", "sent_id", F.filter(F.split("line", " "), lambda t: t != "").alias("raw"))
    s = s.withColumn("num_tokens", F.size("raw")).filter(F.col("num_tokens") > 0)
    if max_tokens is not None:
        s = s.filter(F.col("num_tokens") <= max_tokens)
    # a generator between them keeps the optimiser from copying these arrays into expressions that look at each position
    s = s.select("doc_key", "doc_id", "sent_id", "num_tokens", F.explode(F.array(F.struct("raw", F.transform("raw", tag_of).alias("tag")))).alias("x")).select("doc_key", "doc_id", "sent_id", "num_tokens", "x.raw", "x.tag")
    s = s.withColumn("word", F.col("raw")).withColumn("lemma", F.transform("raw", F.lower)).withColumn("entity", F.transform("raw", lambda t: F.lit("O")))
    s = s.withColumn("chunk", F.transform("tag", lambda t, i: F.when(t != "CAP", "O").when((i > 0) & (F.get(F.col("tag"), i - 1) == "CAP"), "I").otherwise("B")))
    s = s.withColumn("norm", _norms("raw"))
    if graph:
        n, tag = F.col("num_tokens"), F.col("tag")
        at = F.sequence(F.lit(0), n - 1)
        edge = lambda a, b, label: F.struct(a.cast("int").alias("src"), b.cast("int").alias("dst"), F.lit(label).alias("label"))
        mods = lambda i: (F.get(tag, i) != "CAP") & (F.coalesce(F.get(tag, i + 1), F.lit("")) == "CAP")
        nxt = F.transform(F.slice(at, 1, n - 1), lambda i: edge(i, i + 1, "next"))
        head = F.transform(F.slice(at, 2, n), lambda i: edge(F.lit(0), i, "head"))
        mod = F.transform(F.filter(at, mods), lambda i: edge(i, i + 1, "mod"))
        s = s.withColumn("edges", F.concat(nxt, head, mod))
        labels = lambda **tests: F.array_compact(F.array(*(F.when(t, k) for k, t in tests.items())))
        s = s.withColumn("incoming", F.transform(at, lambda i: labels(head=i > 0, mod=(i > 0) & mods(i - 1), next=i > 0)))
        s = s.withColumn("outgoing", F.transform(at, lambda i: labels(head=(i == 0) & (n > 1), mod=mods(i), next=i + 1 < n)))
    return s
