"""Grammars: YAML rule files with variables, imports, priorities and document filters."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import yaml

from ..errors import QueryError
from .pattern import FIELDS, parse_basic, parse_event

_VAR = re.compile(r"\$\{\s*([^}\s]+)\s*\}")


@dataclass(frozen=True)
class Priority:
    """Epochs in which a rule runs: `3`, `1-3`, `2+` or `[1,3,5]`."""

    first: int
    last: int | None = None
    only: frozenset[int] = frozenset()

    @classmethod
    def parse(cls, text) -> Priority:
        t = str(text).replace(" ", "")
        if re.fullmatch(r"\d+", t):
            return cls(int(t), int(t))
        if m := re.fullmatch(r"(\d+)-(\d+)", t):
            if int(m[1]) <= int(m[2]):
                return cls(int(m[1]), int(m[2]))
        elif m := re.fullmatch(r"(\d+)\+", t):
            return cls(int(m[1]))
        elif re.fullmatch(r"\[\d+(,\d+)*\]", t):
            only = frozenset(map(int, t[1:-1].split(",")))
            return cls(min(only), max(only), only)
        raise QueryError(f"{text!r} is no priority")

    def runs(self, epoch: int) -> bool:
        return epoch in self.only if self.only else self.first <= epoch and (self.last is None or epoch <= self.last)

    @property
    def least_epochs(self) -> int:
        """Epochs after which every rule of this priority has run at least once, or each time it ever will."""
        return self.first if self.last is None else self.last


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    pattern: object
    label: str | None = None
    priority: Priority = Priority(1, 1)
    filters: tuple[str, ...] = ()


def value_text(v) -> str:
    return "|".join(map(str, v)) if isinstance(v, list) else str(v)


def substitute(text: str, variables: dict[str, str]) -> str:
    for _ in range(100):
        if not _VAR.search(text):
            return text

        def put(m):
            if m[1] not in variables:
                raise QueryError(f"variable {m[1]} has no value")
            return variables[m[1]]

        text = _VAR.sub(put, text)
    raise QueryError(f"variables refer to each other in a circle: {text[:60]}")


def _as_filters(x) -> tuple[str, ...]:
    return () if x is None else (x,) if isinstance(x, str) else tuple(x)


class Loader:
    def __init__(self, fields=FIELDS, default: str = "norm", root: str | None = None):
        self.fields, self.default, self.root = fields, default, root

    def _open(self, path: str, base: str | None):
        """A path beginning with / is looked for under the root (if one is set), others beside the file that names them."""
        if path.startswith("/"):
            tries = [os.path.join(self.root, path.lstrip("/"))] if self.root else []
            tries.append(path)
        else:
            tries = [os.path.join(base, path)] if base else []
            if self.root:
                tries.append(os.path.join(self.root, path))
        for t in tries:
            if os.path.isfile(t):
                with open(t, encoding="utf-8") as f:
                    return f.read(), os.path.dirname(os.path.abspath(t))
        if base is None and not self.root:
            raise QueryError(f"rules given as text can't import {path!r}")
        raise QueryError(f"there is no rule file {path!r}")

    def _vars(self, v, base: str | None) -> dict[str, str]:
        if isinstance(v, str):
            text, _ = self._open(v, base)
            v = yaml.safe_load(text)
        return {k: value_text(x) for k, x in (v or {}).items()}

    def load(self, text: str, variables: dict | None = None, base: str | None = None, filters: tuple[str, ...] = (), seen: tuple[str, ...] = ()) -> list[Rule]:
        data = yaml.safe_load(text)
        if isinstance(data, list):
            data = {"rules": data}
        if not isinstance(data, dict) or "rules" not in data:
            raise QueryError("a grammar has a list called rules")
        # what comes from outside goes before what the file says itself
        known = self._vars(data.get("vars"), base) | {k: value_text(v) for k, v in (variables or {}).items()}
        here = filters + tuple(substitute(f, known) for f in _as_filters(data.get("metadataFilters")))
        out: list[Rule] = []
        for r in data["rules"] or []:
            if "import" in r:
                path = substitute(str(r["import"]), known)
                inner, at = self._open(path, base)
                if (key := os.path.join(at, os.path.basename(path))) in seen:
                    raise QueryError(f"{path} imports itself")
                given = self._vars(r.get("vars"), base)
                given = {k: substitute(v, known | given) for k, v in given.items()}
                out += self.load(inner, known | given, at, here + tuple(substitute(f, known) for f in _as_filters(r.get("metadataFilters"))), (*seen, key))
                continue
            for need in ("name", "type", "pattern"):
                if need not in r:
                    raise QueryError(f"a rule lacks its {need}: {r}")
            get = lambda k: substitute(str(r[k]), known) if r.get(k) is not None else None
            kind, pattern = get("type"), get("pattern")
            if kind not in ("basic", "event"):
                raise QueryError(f"{kind!r} is no type of rule")
            try:
                tree = (parse_basic if kind == "basic" else parse_event)(pattern, self.fields, self.default)
            except QueryError as e:
                raise QueryError(f"rule {get('name')}: {e}") from None
            prio = r.get("priority", "1")
            prio = "[" + ",".join(map(str, prio)) + "]" if isinstance(prio, list) else substitute(str(prio), known)
            out.append(Rule(get("name"), kind, tree, get("label"), Priority.parse(prio), here))
        return out

    def load_file(self, path: str, variables: dict | None = None) -> list[Rule]:
        text, at = self._open(os.path.abspath(path), None)
        return self.load(text, variables, at, seen=(os.path.abspath(path),))
