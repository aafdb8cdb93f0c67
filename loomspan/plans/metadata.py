"""Document filters: from text to a Column over the table of documents.

The table keeps text_fields map<name, array<array<token>>>, num_fields map<name, array<double>> (numbers, dates as days
since 1970, and <date>.year) and nested array<struct<name, text_fields, num_fields>>. A field that a document lacks
satisfies nothing, and so satisfies each negation. Names bound to plain columns (`columns`) use those instead, which
lets Parquet prune.
"""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.text import aggressive
from .pattern import _QUOTED, unescape

_TOKEN = re.compile(r"\s*(?:(\|\||&&|>=|<=|==|!=|[(){}<>!,.])|(-?\d+(?:\.\d+)?)|([^\W\d]\w*)|(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'))")
_MONTHS = {m: k for k, names in enumerate([("jan", "january"), ("feb", "february"), ("mar", "march"), ("apr", "april"), ("may",), ("jun", "june"), ("jul", "july"), ("aug", "august"), ("sep", "sept", "september"), ("oct", "october"), ("nov", "november"), ("dec", "december")], 1) for m in names}
_FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "==": "==", "!=": "!="}


class _Reader:
    def __init__(self, text: str):
        self.toks, i, end = [], 0, len(text.rstrip())
        while i < end:
            m = _TOKEN.match(text, i)
            if not m:
                raise QueryError(f"can't read the filter at {text[i:][:30]!r}")
            op, num, name, quoted = m.groups()
            if op:
                self.toks.append(("op", op))
            elif num:
                self.toks.append(("num", float(num)))
            elif name:
                self.toks.append(("name", name))
            else:
                q = _QUOTED.match(quoted)
                self.toks.append(("str", unescape(q[1] if q[1] is not None else q[2])))
            i = m.end()
        self.i = 0

    def at(self, *ops: str) -> bool:
        return self.i < len(self.toks) and self.toks[self.i] in [("op", o) for o in ops]

    def take(self, op: str) -> bool:
        if self.at(op):
            self.i += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            raise QueryError(f"the filter lacks {op!r} before {self.toks[self.i :][:3]}")

    def word(self, *names: str) -> bool:
        if self.i < len(self.toks) and self.toks[self.i][0] == "name" and (not names or self.toks[self.i][1] in names):
            self.i += 1
            return True
        return False

    # filter := and ("||" and)*; and := atom ("&&" atom)*
    def either(self):
        out = [self.both()]
        while self.take("||"):
            out.append(self.both())
        return out[0] if len(out) == 1 else ("or", out)

    def both(self):
        out = [self.atom()]
        while self.take("&&"):
            out.append(self.atom())
        return out[0] if len(out) == 1 else ("and", out)

    def atom(self):
        if self.at("!") or self.at("("):
            no = self.take("!")
            self.need("(")
            x = self.either()
            self.need(")")
            return ("not", x) if no else x
        start = self.i
        if self.word() and self.take("{"):
            name = self.toks[start][1]
            x = self.either()
            self.need("}")
            return ("nested", name, x)
        self.i = start
        left = self.value()
        at = self.i
        no = self.word("not")
        if self.word("contains"):
            if left[0] != "field" or self.i >= len(self.toks) or self.toks[self.i][0] != "str":
                raise QueryError("contains takes a field and a quoted text")
            self.i += 1
            x = ("contains", left[1], self.toks[self.i - 1][1])
            return ("not", x) if no else x
        self.i = at
        pairs = []
        while self.at(*_FLIP):
            op = self.toks[self.i][1]
            self.i += 1
            right = self.value()
            pairs.append(compare(left, op, right))
            left = right
        if not pairs:
            raise QueryError(f"{left[1]!r} is no condition")
        return pairs[0] if len(pairs) == 1 else ("and", pairs)

    def value(self):
        if self.i >= len(self.toks):
            raise QueryError("the filter ends where a value should be")
        kind, v = self.toks[self.i]
        self.i += 1
        if kind == "num":
            return ("num", v)
        if kind == "str":
            return ("str", v)
        if kind != "name":
            raise QueryError(f"{v!r} is no value")
        if self.take("("):
            args = [self.value()]
            while self.take(","):
                args.append(self.value())
            self.need(")")
            return ("num", call(v, args))
        if self.take("."):
            if not self.word():
                raise QueryError(f"a name should follow {v}.")
            v = f"{v}.{self.toks[self.i - 1][1]}"
        return ("field", v)


def call(name: str, args: list) -> float:
    if name != "date":
        raise QueryError(f"there is no function {name!r}")
    if not 1 <= len(args) <= 3:
        raise QueryError("date takes a year, a month and a day")
    parts = []
    for k, a in enumerate(args):
        if a[0] == "num" and a[1] == int(a[1]):
            parts.append(int(a[1]))
        elif k == 1 and a[0] in ("str", "field") and a[1].lower().rstrip(".") in _MONTHS:
            parts.append(_MONTHS[a[1].lower().rstrip(".")])
        else:
            raise QueryError(f"{a[1]!r} is no part of a date")
    try:
        return float((datetime.date(*parts, *[1] * (3 - len(parts))) - datetime.date(1970, 1, 1)).days)
    except ValueError as e:
        raise QueryError(str(e)) from None


def compare(left, op: str, right):
    if left[0] != "field":
        left, op, right = right, _FLIP[op], left
    if left[0] != "field" or right[0] == "field":
        raise QueryError("a comparison needs one field and one value")
    if right[0] == "str" and op not in ("==", "!="):
        raise QueryError(f"texts can't be compared by {op}")
    x = ("cmp", left[1], "==" if op == "!=" else op, right)
    return ("not", x) if op == "!=" else x


def parse(text: str):
    r = _Reader(text)
    x = r.either()
    if r.i < len(r.toks):
        raise QueryError(f"the filter should have ended before {r.toks[r.i :][:3]}")
    return x


def _tokens(value: str) -> list[tuple[str, str]]:
    out = []
    for w in aggressive(value).split():
        out.append(("re", w[1:-1]) if len(w) > 2 and w[0] == "/" and w[-1] == "/" else ("eq", w))
    return out


def _fits(token: Column, want: tuple[str, str]) -> Column:
    return token == F.lit(want[1]) if want[0] == "eq" else token.rlike(f"^(?:{want[1]})$")


def lower(x, text: Column, num: Column, nested: Column | None, columns: dict[str, Column]) -> Column:
    kind = x[0]
    sub = lambda y: lower(y, text, num, nested, columns)
    if kind in ("and", "or"):
        out = sub(x[1][0])
        for y in x[1][1:]:
            out = out & sub(y) if kind == "and" else out | sub(y)
        return out
    if kind == "not":
        return ~F.coalesce(sub(x[1]), F.lit(False))
    if kind == "nested":
        if nested is None:
            raise QueryError("nested fields aren't nested again")
        return F.coalesce(F.exists(nested, lambda n: (n["name"] == x[1]) & lower(x[2], n["text_fields"], n["num_fields"], None, {})), F.lit(False))
    if kind == "contains":
        want = _tokens(x[2])
        if not want:
            return F.lit(True)
        bound = columns.get(x[1])
        lists = text[x[1]] if bound is None else F.array(F.split(F.lower(bound), r"\s+"))

        def inside(toks: Column) -> Column:
            places = F.sequence(F.lit(0), F.greatest(F.size(toks) - len(want), F.lit(0)))

            def here(i: Column) -> Column:
                out = F.lit(True)
                for k, w in enumerate(want):
                    out = out & F.coalesce(_fits(F.get(toks, i + k), w), F.lit(False))
                return out

            return F.exists(places, here)

        return F.coalesce(F.exists(lists, inside), F.lit(False))
    _, name, op, value = x
    bound = columns.get(name)
    if value[0] == "num":
        test = {"<": lambda v: v < value[1], "<=": lambda v: v <= value[1], ">": lambda v: v > value[1], ">=": lambda v: v >= value[1], "==": lambda v: v == value[1]}[op]
        return F.coalesce(test(bound) if bound is not None else F.exists(num[name], test), F.lit(False))
    want = _tokens(value[1])

    def equal(toks: Column) -> Column:
        out = F.size(toks) == len(want)
        for k, w in enumerate(want):
            out = out & F.coalesce(_fits(F.get(toks, F.lit(k)), w), F.lit(False))
        return out

    if bound is not None:
        return F.coalesce(equal(F.split(F.lower(bound), r"\s+")), F.lit(False))
    return F.coalesce(F.exists(text[name], equal), F.lit(False))


def condition(filter_: str | Column | list | None, columns: dict[str, Column] | None = None) -> Column | None:
    """A filter text (or several, all of which must hold) as a Column over the documents."""
    if filter_ is None or isinstance(filter_, Column):
        return filter_
    if isinstance(filter_, (list, tuple)):
        parts = [condition(f, columns) for f in filter_ if f is not None]
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out
    return F.coalesce(lower(parse(filter_), F.col("text_fields"), F.col("num_fields"), F.col("nested"), columns or {}), F.lit(False))
