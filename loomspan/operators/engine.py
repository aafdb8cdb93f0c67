"""Patterns and grammars over a table of sentences.

A sentence is a row with its token layers and its graph, and a match never leaves it. So a query is a narrow plan: a
filter of native expressions drops sentences that lack what a pattern cannot do without, then a pattern of fixed length
is matched natively (positions by higher-order functions), any other by one Arrow map. A grammar, however many epochs
it takes, is one such map too: rules only build on mentions of their own sentence. Nothing shuffles but joins with
document filters or with mentions from elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..plans import metadata
from ..plans.pattern import DEFAULT_FIELD, FIELDS, Event, parse_basic, parse_event
from ..plans.rules import Loader, Priority, Rule
from . import columnar
from . import match as M

KEY = ["doc_key", "doc_id", "sent_id"]
CAPS = "array<struct<name:string,label:string,s:int,e:int,parent:int>>"
MENTION = f"doc_key long, doc_id string, sent_id int, start int, end int, label string, found_by string, kind string, caps {CAPS}"


# --- what a pattern needs -------------------------------------------------------------------------------------------


def walk(x):
    """All tuples in a pattern tree."""
    if is_dataclass(x):
        for f in fields(x):
            yield from walk(getattr(x, f.name))
    elif isinstance(x, tuple):
        if x and isinstance(x[0], str):
            yield x
        for y in x:
            if isinstance(y, tuple) or is_dataclass(y):
                yield from walk(y)


def used_fields(x) -> set[str]:
    return {t[1] for t in walk(x) if t[0] in ("eq", "re", "fuzzy") and len(t) == 3}


def uses_graph(x) -> bool:
    return isinstance(x, Event) or any(t[0] in ("trav", "step", "group", "out", "in") for t in walk(x))


def edges_for(rules) -> Column | None:
    """The edges that paths of these rules can follow; None if all."""
    labels, regexes = set(), set()
    for r in rules:
        for t in walk(r.pattern):
            if t[0] in ("out", "in") and len(t) == 2:
                if t[1] is None:
                    return None
                (labels if t[1][0] == "s" else regexes).add(t[1][1])
    return F.filter("edges", lambda e: e["label"].isin(sorted(labels)) | F.lit(False) if not regexes else e["label"].isin(sorted(labels)) | e["label"].rlike("^(?:" + "|".join(f"(?:{x})" for x in sorted(regexes)) + ")\\z"))


def token_test(p: tuple, at) -> Column:
    """A predicate as a Column; at(field) is the field's value at the position in question."""
    kind = p[0]
    if kind == "any":
        return F.lit(True)
    if kind == "not":
        return ~token_test(p[1], at)
    if kind in ("and", "or"):
        out = token_test(p[1][0], at)
        for q in p[1][1:]:
            out = out & token_test(q, at) if kind == "and" else out | token_test(q, at)
        return out
    _, field, value = p
    if kind == "eq":
        one = lambda x: x == F.lit(value)
    elif kind == "re":
        one = lambda x: x.rlike(f"^(?:{value})\\z")
    else:
        raise QueryError("fuzzy tokens aren't native")
    v = at(field)
    return F.coalesce(F.exists(v, one) if field in M.SETS else one(v), F.lit(False))


def native(p: tuple) -> bool:
    return not any(t[0] == "fuzzy" for t in walk(p))


def token_somewhere(p: tuple) -> Column | None:
    """That some token of the sentence may satisfy p; None if that says nothing."""
    kind = p[0]
    if kind in ("any", "not"):
        return None
    if kind in ("and", "or"):
        parts = [token_somewhere(q) for q in p[1]]
        if kind == "or" and any(x is None for x in parts):
            return None
        parts = [x for x in parts if x is not None]
        out = None
        for x in parts:
            out = x if out is None else (out & x if kind == "and" else out | x)
        return out
    _, field, value = p
    if kind == "fuzzy":
        one = lambda x: F.abs(F.length(x) - len(value)) <= 2
    elif kind == "re":
        one = lambda x: x.rlike(f"^(?:{value})\\z")
    else:
        one = lambda x: x == F.lit(value)
    layer = F.col(field)
    if field in M.SETS:
        return F.exists(layer, lambda xs: F.exists(xs, one))
    return F.array_contains(layer, value) if kind == "eq" else F.exists(layer, one)


def _all(parts) -> Column | None:
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out & p
    return out


def _path_needs(p: tuple) -> Column | None:
    kind = p[0]
    if kind in ("out", "in"):
        if p[1] is None:
            return F.size("edges") > 0
        how, label = p[1]
        return F.exists("edges", lambda e: (e["label"] == label) if how == "s" else e["label"].rlike(f"^(?:{label})\\z"))
    if kind == "pseq":
        return _all(map(_path_needs, p[1]))
    if kind == "prep":
        return _path_needs(p[1]) if p[2] > 0 else None
    parts = [_path_needs(q) for q in p[1]]
    out = None
    for x in parts:
        if x is None:
            return None
        out = x if out is None else out | x
    return out


def needs(x) -> Column | None:
    """A condition on the sentence that every match implies."""
    if isinstance(x, Event):
        return _all([needs(x.trigger), *(c for a in x.arguments if a.least > 0 for c in (*(needs(s) for s in a.steps if s[0] == "step" and (a.label is None or s is not a.steps[-1])), *(_path_needs(s[1]) for s in a.steps if s[0] == "step"), _path_needs(a.tail) if a.tail else None))])
    kind = x[0]
    if kind == "tok":
        return token_somewhere(x[1])
    if kind == "seq":
        return _all(map(needs, x[1]))
    if kind == "alt":
        out = None
        for y in x[1]:
            c = needs(y)
            if c is None:
                return None
            out = c if out is None else out | c
        return out
    if kind == "rep":
        return needs(x[1]) if x[2] > 0 else None
    if kind == "cap":
        return needs(x[3])
    if kind in ("ahead", "behind"):
        return None if x[2] else needs(x[1])
    if kind in ("trav", "expand"):
        parts = [needs(x[1])]
        if kind == "trav":
            parts += [c for s in x[2] if s[0] == "step" for c in (_path_needs(s[1]), needs(s[2]))]
        return _all(parts)
    return None


def fixed(x) -> list[tuple] | None:
    """The token predicates of a pattern of fixed length without captures, or None."""
    if x[0] == "tok":
        return [x[1]] if native(x[1]) else None
    if x[0] == "seq":
        out = []
        for y in x[1]:
            part = fixed(y)
            if part is None:
                return None
            out += part
        return out
    if x[0] == "rep" and x[2] == x[3] and x[2] <= 8:
        part = fixed(x[1])
        return None if part is None else part * x[2]
    return None


# --- a sentence's mentions ------------------------------------------------------------------------------------------


def flat_caps(caps: tuple, parent: int = -1, out: list | None = None) -> list[dict]:
    out = [] if out is None else out
    for name, label, s, e, inner in caps:
        out.append({"name": name, "label": label, "s": s, "e": e, "parent": parent})
        flat_caps(inner, len(out) - 1, out)
    return out


def nested_caps(flat, parent: int = -1) -> tuple:
    return tuple((c["name"], c["label"], c["s"], c["e"], nested_caps(flat, k)) for k, c in enumerate(flat) if c["parent"] == parent)


def run_rule(rule: Rule, s: M.Sentence, trigger_overlap: bool, all_matches: bool = False) -> list[tuple]:
    """Mentions (label, start, end, caps, found_by, kind) of one rule; promoted arguments come before their event."""
    out = []
    if rule.kind == "event":
        known = {label: {m[:2] for m in s.state.get(label, ())} for label in {a.label for a in rule.pattern.arguments}}
        for a, b, caps, promoted in M.events(rule.pattern, s, trigger_overlap):
            for label, x, y, inner in promoted:
                if (x, y) not in known[label]:
                    out.append((label, x, y, inner, rule.name, "basic"))
            out.append((rule.label, a, b, caps, rule.name, "event"))
    else:
        found = M.surface(rule.pattern, s)
        found = [(m[0], m[1], m[3]) for m in (found if all_matches else M.select(found))]
        out = [(rule.label, a, b, caps, rule.name, "basic") for a, b, caps in found]
    return list(dict.fromkeys(out))


def cascade(rules: list[tuple[Rule, bool]], s: M.Sentence, use_state: bool, trigger_overlap: bool, all_matches: bool = False, compat: bool = False) -> list[tuple]:
    """All mentions of a sentence. rules: with whether the document passes the rule's filters.

    Epochs go on until all rules have had their turn and an epoch finds nothing new. Mentions are the same when label,
    span and captures are; with compat, when label, start and first capture's start are.
    """
    live = [r for r, ok in rules if ok]
    if not use_state:
        return list(dict.fromkeys(m for r in live for m in run_rule(r, s, trigger_overlap, all_matches)))
    turns = max((r.priority.least_epochs for r, _ in rules), default=0)
    same = (lambda m: (m[0], m[1], min((c[2] for c in m[3]), default=-1))) if compat else (lambda m: m[:4])
    out, seen, epoch = [], set(), 0
    for label, ms in s.state.items():
        seen |= {same((label, *m)) for m in ms}
    while True:
        epoch += 1
        turn = [r for r in live if r.priority.runs(epoch)]
        fresh = []
        for r in turn:
            for m in run_rule(r, s, trigger_overlap, all_matches):
                if same(m) not in seen:
                    seen.add(same(m))
                    fresh.append(m)
        if not fresh and epoch >= turns:
            return out
        if fresh:
            out += fresh
            state = dict(s.state)
            for m in fresh:
                state[m[0]] = [*state.get(m[0], ()), (m[1], m[2], m[3])]
            s.state = state
            s.memo = {k: v for k, v in s.memo.items() if k[0] not in ("surface", "cover")}


@dataclass
class Engine:
    """sentences: doc_key, doc_id, sent_id, num_tokens and layers; docs: see plans/metadata.py.

    columns binds names in filters to plain columns of docs. Sentences without a layer that a pattern asks for are an
    error; null layers match nothing. text: doc_key, doc_id and text of the documents that sentences were made of by
    corpus.annotate, if they were; then queries cut the sentences themselves, see columnar.py.
    """

    sentences: DataFrame
    docs: DataFrame | None = None
    columns: dict[str, Column] | None = None
    fields: tuple[str, ...] = FIELDS
    default: str = DEFAULT_FIELD
    root: str | None = None
    text: DataFrame | None = None

    # --- compiling --------------------------------------------------------------------------------------------------

    def compile(self, pattern: str):
        """A basic pattern, or an event pattern if it begins with a trigger."""
        if pattern.lstrip().startswith("trigger") and pattern.lstrip()[7:].lstrip().startswith("="):
            return parse_event(pattern, self.fields, self.default)
        return parse_basic(pattern, self.fields, self.default)

    def rules(self, grammar: str, variables: dict | None = None) -> list[Rule]:
        return Loader(self.fields, self.default, self.root).load(grammar, variables)

    def rules_file(self, path: str, variables: dict | None = None) -> list[Rule]:
        return Loader(self.fields, self.default, self.root).load_file(path, variables)

    # --- running ----------------------------------------------------------------------------------------------------

    def _filtered(self, condition, rows: DataFrame) -> DataFrame:
        cond = metadata.condition(condition, self.columns)
        if cond is None:
            return rows
        if self.docs is None:
            raise QueryError("a document filter needs the table of documents")
        return rows.join(self.docs.filter(cond).select("doc_key"), "doc_key", "left_semi")

    def query(self, pattern, filter=None, limit: int | None = None, after: tuple | None = None, all_matches: bool = False, label: str | None = None, name: str = "query", state: DataFrame | None = None, trigger_overlap: bool = False) -> DataFrame:
        """Mentions of one pattern. limit: that many sentences, in order; after: only sentences behind (doc_key, sent_id)."""
        tree = self.compile(pattern) if isinstance(pattern, str) else pattern
        rule = Rule(name, "event" if isinstance(tree, Event) else "basic", tree, label)
        behind = None if after is None else (F.col("doc_key") > after[0]) | (F.col("doc_key") == after[0]) & (F.col("sent_id") > after[1])
        if self._cuts([rule], state):
            rows = self._filtered(filter, self.text)
            if behind is not None:
                rows = rows.filter(F.col("doc_key") >= after[0])
            out = self._cut(rows, [rule], False, trigger_overlap, all_matches)
            if behind is not None:
                out = out.filter(behind)
            return out if limit is None else self.first(out, limit)
        rows = self._filtered(filter, self.sentences)
        if behind is not None:
            rows = rows.filter(behind)
        preds = None if isinstance(tree, Event) or state is not None else fixed(tree)
        if preds is not None:
            out = self._native(rows, preds, all_matches, label, name)
        else:
            out = self._run(rows, [rule], state, False, trigger_overlap, all_matches)
        return out if limit is None else self.first(out, limit)

    @staticmethod
    def first(mentions: DataFrame, n: int) -> DataFrame:
        """Mentions of the first n sentences."""
        top = mentions.select("doc_key", "sent_id").distinct().orderBy("doc_key", "sent_id").limit(n)
        return mentions.join(F.broadcast(top) if n <= 100_000 else top, ["doc_key", "sent_id"], "left_semi").select(mentions.columns)

    def total_hits(self, pattern, filter=None, **k) -> DataFrame:
        """One row: in how many sentences a pattern is found, and how often."""
        return self.query(pattern, filter, **k).agg(F.countDistinct("doc_key", "sent_id").alias("sentences"), F.count("*").alias("mentions"))

    def extract(self, rules: list[Rule] | str, filter=None, state: DataFrame | None = None, use_state: bool = True, trigger_overlap: bool = False, compat: bool = False, limit: int | None = None) -> DataFrame:
        """Mentions of a grammar. use_state=False ignores priorities and doesn't build on mentions found here; limit: those of
        that many sentences, in order."""
        if isinstance(rules, str):
            rules = self.rules(rules)
        if self._cuts(rules, state):
            out = self._cut(self._filtered(filter, self.text), rules, use_state, trigger_overlap, False, compat)
        else:
            out = self._run(self._filtered(filter, self.sentences), rules, state, use_state, trigger_overlap, False, compat)
        return out if limit is None else self.first(out, limit)

    def _native(self, rows: DataFrame, preds: list[tuple], all_matches: bool, label, name) -> DataFrame:
        k = len(preds)
        cond = needs(("seq", tuple(("tok", p) for p in preds)))
        rows = rows.filter(F.col("num_tokens") >= k)
        if cond is not None:
            rows = rows.filter(cond)

        def here(i: Column) -> Column:
            out = None
            for j, p in enumerate(preds):
                t = token_test(p, lambda f, j=j: F.get(F.col(f), i + j))
                out = t if out is None else out & t
            return F.lit(True) if out is None else out

        places = F.filter(F.sequence(F.lit(0), F.col("num_tokens") - k), here)
        if k > 1 and not all_matches:
            empty = F.array().cast("array<int>")
            places = F.aggregate(places, empty, lambda acc, i: F.when((F.size(acc) == 0) | (F.element_at(acc, -1) + k <= i), F.concat(acc, F.array(i))).otherwise(acc))
        out = rows.select(*KEY, F.explode(places).alias("start"))
        return out.select(*KEY, "start", (F.col("start") + k).alias("end"), F.lit(label).cast("string").alias("label"), F.lit(name).alias("found_by"), F.lit("basic").alias("kind"), F.array().cast(CAPS).alias("caps"))

    def _cuts(self, rules: list[Rule], state: DataFrame | None) -> bool:
        return self.text is not None and state is None and all(used_fields(r.pattern) <= set(FIELDS) for r in rules)

    def _marked(self, rows: DataFrame, filters: list[tuple], flags: list[str]) -> DataFrame:
        """Rows with whether their document passes these filters."""
        if not filters:
            return rows
        if self.docs is None:
            raise QueryError("the rules have document filters, which need the table of documents")
        return rows.join(self.docs.select("doc_key", *(metadata.condition(list(f), self.columns).alias(n) for f, n in zip(filters, flags))), "doc_key", "left")

    def _cut(self, rows: DataFrame, rules: list[Rule], use_state: bool, trigger_overlap: bool, all_matches: bool = False, compat: bool = False) -> DataFrame:
        filters = sorted({r.filters for r in rules if r.filters})
        flags = [f"__ok{k}" for k in range(len(filters))]
        rows = self._marked(rows, filters, flags).select("doc_key", "doc_id", "text", *flags)
        predicates = list({t[1]: None for r in rules for t in walk(r.pattern) if t[0] == "tok"})

        def slowly(live, s):
            conds = [columnar.needs(r.pattern, s) for r in live]
            keep = np.ones(s.count, bool) if any(c is None for c in conds) else np.logical_or.reduce(conds)
            out: list[tuple] = []
            for k in np.flatnonzero(keep).tolist():
                found = cascade([(r, True) for r in live], s.sentence(k, predicates), use_state, trigger_overlap, all_matches, compat)
                out += ((k, x, y, label, by, kind, flat_caps(caps)) for label, x, y, caps, by, kind in found)
                if len(out) >= columnar.ROWS:
                    yield out
                    out = []
            if out:
                yield out

        def mentions(b, live, kept):
            s = columnar.Sentences(b.column(2), kept)
            if not s.count or not live:
                return
            keys = [b.column(0), b.column(1)]
            try:
                if compat:
                    raise columnar.Slow
                for m in columnar.Vector(s).cascade(live, use_state, trigger_overlap, all_matches):
                    for cols in columnar.table(m, s, keys):
                        yield pa.record_batch([v.cast(t) for v, t in zip(cols, _MENTION_TYPES)], _MENTION_NAMES)
            except columnar.Slow:  # before anything is given out
                for out in slowly(live, s):
                    k, *cols = zip(*out)
                    k = np.array(k)
                    yield pa.record_batch([*(c.take(pa.array(s.text[k])) for c in keys), pa.array(s.sent_id[k]), *(pa.array(v, t) for v, t in zip(cols, _MENTION_TYPES[3:]))], _MENTION_NAMES)

        def scan(batches):
            kept: dict = {}
            for b in batches:
                for lo, hi in columnar.parts(b.column(2)):
                    part = b.slice(lo, hi - lo)
                    if not filters:
                        yield from mentions(part, rules, kept)
                        continue
                    ok = list(zip(*(part.column(3 + j).to_pylist() for j in range(len(filters)))))
                    for passed in sorted({tuple(map(bool, x)) for x in ok}):
                        live = [r for r in rules if not r.filters or passed[filters.index(r.filters)]]
                        yield from mentions(part.filter(pa.array([tuple(map(bool, x)) == passed for x in ok])), live, kept)

        return rows.mapInArrow(scan, MENTION)

    def _run(self, rows: DataFrame, rules: list[Rule], state: DataFrame | None, use_state: bool, trigger_overlap: bool, all_matches: bool = False, compat: bool = False) -> DataFrame:
        layers = sorted(set().union(*(used_fields(r.pattern) for r in rules)) if rules else set())
        if missing := [f for f in layers if f not in rows.columns]:
            raise QueryError(f"these sentences have no layer {', '.join(missing)}")
        graph = any(uses_graph(r.pattern) for r in rules) and "edges" in rows.columns
        if state is None:
            conds = [needs(r.pattern) for r in rules if graph or not uses_graph(r.pattern)]
            if len(conds) == len(rules) and all(c is not None for c in conds) and conds:
                any_rule = conds[0]
                for c in conds[1:]:
                    any_rule = any_rule | c
                rows = rows.filter(any_rule)
        filters = sorted({r.filters for r in rules if r.filters})
        flags = [f"__ok{k}" for k in range(len(filters))]
        cols = [*KEY, "num_tokens", *layers, *(["__src", "__dst", "__label"] if graph else [])]
        if graph:  # three flat lists: structs would be built one by one on the other side
            kept = edges_for(rules)
            rows = rows.select(*KEY, "num_tokens", *layers, (F.col("edges") if kept is None else kept).alias("__edges"))
            rows = rows.withColumns({f"__{k}": F.col("__edges")[k] for k in ("src", "dst", "label")})
        rows = rows.select(*cols)
        rows = self._marked(rows, filters, flags)
        if state is not None:
            by = state.groupBy("doc_key", "sent_id").agg(F.collect_list(F.struct("label", "start", "end", "caps")).alias("__state"))
            rows = rows.join(by, ["doc_key", "sent_id"], "left")
        rows = rows.select(*cols, *flags, *(["__state"] if state is not None else []))
        where = {f: k for k, f in enumerate(filters)}
        n_layers, has_state = len(layers), state is not None

        def scan(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                c = [x.to_pylist() for x in b.columns]
                out: list[tuple] = []
                for i in range(b.num_rows):
                    n = c[3][i] or 0
                    s = M.Sentence(n, {f: c[4 + k][i] for k, f in enumerate(layers) if c[4 + k][i] is not None})
                    if graph:
                        s.edges = list(zip(c[4 + n_layers][i] or (), c[5 + n_layers][i] or (), c[6 + n_layers][i] or ()))
                    at = 4 + n_layers + 3 * graph
                    if has_state:
                        for m in c[-1][i] or ():
                            s.state.setdefault(m["label"], []).append((m["start"], m["end"], nested_caps(m["caps"])))
                    todo = [(r, not r.filters or bool(c[at + where[r.filters]][i])) for r in rules]
                    for label, x, y, caps, by, kind in cascade(todo, s, use_state, trigger_overlap, all_matches, compat):
                        out.append((c[0][i], c[1][i], c[2][i], x, y, label, by, kind, flat_caps(caps)))
                if out:
                    yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out), _MENTION_TYPES)], _MENTION_NAMES)

        return rows.mapInArrow(scan, MENTION)

    # --- results ----------------------------------------------------------------------------------------------------

    def with_text(self, mentions: DataFrame, field: str = "raw") -> DataFrame:
        """Adds the text of each mention and of each capture."""
        if field not in self.sentences.columns:
            raise QueryError(f"the layer {field!r} isn't stored")
        layer = F.transform(F.col(field), lambda x: F.element_at(x, 1)) if field in M.SETS else F.col(field)
        toks = self.sentences.select("doc_key", "sent_id", layer.alias("__toks"))
        cut = lambda s, e: F.array_join(F.slice("__toks", s + 1, e - s), " ")
        return mentions.join(toks, ["doc_key", "sent_id"]).withColumn("text", cut(F.col("start"), F.col("end"))).withColumn("cap_texts", F.transform("caps", lambda c: F.array_join(F.slice(F.col("__toks"), c["s"] + 1, c["e"] - c["s"]), " "))).drop("__toks")


_CAP = pa.list_(pa.struct([("name", pa.string()), ("label", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("parent", pa.int32())]))
_MENTION_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), _CAP]
_MENTION_NAMES = ["doc_key", "doc_id", "sent_id", "start", "end", "label", "found_by", "kind", "caps"]
