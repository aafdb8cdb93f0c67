"""Text functions: normal forms, edit distance, quoting, display."""

from __future__ import annotations

import re
import unicodedata

#: What case folding and decomposition leave unequal.
_MAP = str.maketrans({
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "″": '"', "«": '"', "»": '"',
    "•": "-", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "⁄": "/", "™": "(tm)", "®": "(r)", "©": "(c)",
    "œ": "oe", "æ": "ae", "ø": "o", "đ": "d", "ł": "l", "…": "...",
})


def nfkc(s: str) -> str:
    return unicodedata.normalize("NFKC", s)


def aggressive(s: str) -> str:
    """Folded case, no accents, plain quotes and dashes, ligatures and symbols spelt out."""
    if s.isascii():
        return s.lower()
    s = s.replace("™", "(TM)").replace("®", "(R)")
    s = unicodedata.normalize("NFKC", s).casefold().translate(_MAP)
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c) != "Mn")
    return s.casefold().translate(_MAP)


def within_two_edits(a: str, b: str, most: int = 2) -> bool:
    """Edit distance with swaps of neighbours, at most two."""
    if a == b:
        return True
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    k = 0
    while k < len(a) and k < len(b) and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[: len(a) - k], b[: len(b) - k]
    if abs(len(a) - len(b)) > most:
        return False
    few, many = sorted((a, b), key=len)
    if most == 2 and (len(few), len(many)) == (2, 3) and few == many[2] + many[0]:  # swapped, and one put between
        return True
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = last[j - 1] if x == y else 1 + min(last[j], row[-1], last[j - 1])
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most and (i == 1 or min(last) > most):
            return False
        before, last = last, row
    return last[-1] <= most


_IDENTIFIER = re.compile(r"[^\W\d]\w*\Z")


def quote_word(s: str) -> str:
    """s as a word of the pattern language, in quotes only where needed."""
    return s if _IDENTIFIER.match(s) else '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def quote_label(s: str) -> str:
    """s as an edge label or field value, where : and - are allowed inside."""
    return s if re.match(r"[^\W\d][\w:-]*\Z", s) else quote_word(s)


def quantifier(least: int, most: int | None, lazy: bool = False) -> str:
    """The shortest way to write a quantifier."""
    tail = "?" if lazy else ""
    if (least, most) == (1, 1):
        return ""
    if (least, most) in ((0, 1), (0, None), (1, None)):
        return {(0, 1): "?", (0, None): "*", (1, None): "+"}[(least, most)] + tail
    if least == most:
        return f"{{{least}}}"
    return f"{{{least if least else ''},{'' if most is None else most}}}{tail}"


def highlight(tokens: list[str], span: tuple[int, int], captures: list[tuple[str, int, int]] = (), style: str = "html") -> str:
    """Tokens of a sentence with the match marked and its captures marked within."""
    import html

    if style == "html":
        esc = html.escape
        on, off = "<mark>", "</mark>"
        cap = lambda n: (f'<mark class="capture" title="{esc(n)}">', "</mark>")
    else:
        esc = str
        on, off = "\x1b[93m", "\x1b[0m"
        cap = lambda n: ("\x1b[91m", "\x1b[0m")
    out = []
    for i, t in enumerate(tokens):
        t = esc(t)
        inside = [n for n, s, e in captures if s <= i < e]
        if inside:
            a, b = cap(inside[0])
            t = a + t + b
        elif span[0] <= i < span[1]:
            t = on + t + off
        out.append(t)
    return " ".join(out)
