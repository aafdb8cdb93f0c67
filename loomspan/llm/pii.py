"""Personal data: patterns propose spans, checksums confirm, nearby words move the score.

Base kinds (email, ip, card, phone) are fixed patterns, leftmost and non-overlapping by kind, kept whatever their
score. The method adds: iban (ISO 13616 shape, mod-97), ssn (three groups of digits, known-impossible ones out, only
beside a word that names it) and card14 (Luhn-valid card numbers of 13 to 15 digits beside such a word). Added spans
need a score of at least 0.5 and mustn't overlap a base span. All scanning is linear in the text's length.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, base_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "card14")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit run can't yield a match from its middle that it doesn't yield from its start; so runs are tried once
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_CONTEXT = {
    "email": re.compile(r"e-?mail|mail|contact|@", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|payment|karte|tarjeta|carte", re.I),
    "phone": re.compile(r"phone|tel\b|tel\.|call|fax|mobile|cell", re.I),
    "iban": re.compile(r"iban|bank|account|konto|cuenta|compte", re.I),
    "ssn": re.compile(r"ssn|social security", re.I),
}
_CONTEXT["card14"] = _CONTEXT["card"]
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "card14": 0.35}
REACH = 40


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str):
    """Spans of the email pattern in linear time: from each @, left to where its run starts, then the domain."""
    free = 0
    at = text.find("@")
    while at >= 0:
        i = at
        while i > free and text[i - 1] in _LOCAL:
            i -= 1
        end = at + 1
        if i < at and (m := _DOMAIN.match(text, at)):
            yield i, (end := m.end())
            free = end
        at = text.find("@", end)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def ibans(text: str):
    """Spans of account numbers. The pattern takes words behind a number in, so ends are tried at spaces, longest first."""
    at = 0
    while m := _IBAN.search(text, at):
        a, b = m.span()
        while b > a and not (15 <= len(text[a:b].replace(" ", "")) <= 34 and mod97(text[a:b])):
            b = text.rfind(" ", a, b)
        if b > a:
            yield a, b
        at = max(b, a + 1)


def score(kind: str, text: str, a: int, b: int) -> float:
    """Prior of the kind, raised by a context word within 40 characters on either side."""
    near = text[max(0, a - REACH) : a] + " " + text[b : b + REACH]
    return min(1.0, PRIOR[kind] + (0.3 if _CONTEXT[kind].search(near) else 0.0))


def find_pii(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; code points, end exclusive."""
    text = text or ""
    base = base_spans(text)
    more = [("iban", a, b) for a, b in ibans(text)]
    more += [("ssn", *m.span()) for m in _SSN.finditer(text) if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"]
    more += [("card14", *m.span()) for m in _CARD.finditer(text) if 13 <= m.end() - m.start() < 40 and 13 <= len(d := _digits(m.group())) <= 15 and d[0] in "3456" and luhn(d)]
    begins, ends = [], []  # what base spans cover, as stretches apart from each other
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    out = [(k, a, b, score(k, text, a, b)) for k, a, b in base]
    for k, a, b in more:
        s = score(k, text, a, b)
        last = bisect.bisect_left(begins, b) - 1
        if s >= 0.5 and (last < 0 or ends[last] <= a):
            out.append((k, a, b, s))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found: array of (kind, start, end, score, value). Null or empty text: an empty array. Rows are independent."""

    def scan(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("value", pa.string())]))
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e, "score": p, "value": t[s:e]} for k, s, e, p in find_pii(t)] for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return arrow_map(base_of(docs, id_col, text_col), scan, "doc_id long, found array<struct<kind:string,start:long,end:long,score:double,value:string>>")


def op4_pii(spark, sf_dir):
    docs = base_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def digest(batches):
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = find_pii(t)
                said = [f"{k}:{s}:{e}" for k, s, e, _ in found]
                base = [x for x, f in zip(said, found) if f[0] in BASE]
                n = [sum(f[0] == k for f in found) for k in BASE]
                out.append((i, *n, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(said)))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] * 5 + [pa.string()] * 2)], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return arrow_map(docs, digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
