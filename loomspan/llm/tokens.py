"""Token ids of whole texts with the tokenizers library, remembered by chunk.

Both public vocabularies cut a text at white space before they merge, so the ids of a text are those of its chunks in
turn. Many texts at once are cut by Arrow, and of what a few megabytes of them hold each different pretoken is merged once, all
together (bpe.py); nothing is remembered. Of single texts, small batches and chunks with white space inside, each
worker keeps the ids of chunks it has seen, and only new chunks go through the library. What it keeps is bounded: when
a cache is full it becomes the old one, and what is met again moves on from there to the new one. Texts for
which the cut isn't certain (special tokens' strings, rare scripts, unusual white space) are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .bpe import LONGEST, Merges, pretokens
from .common import utf8

CACHE_ENTRIES, PART_ENTRIES, CHUNK_CHARS = 300_000, 80_000, 48
#: Characters that are encoded together, the fewest for which that pays, and the longest text it is done with.
TOGETHER, LEAST, LONG = 8_000_000, 100_000, 1 << 27
_UNSURE = re.compile("[^\x00-\x1b\x20-˿Ͱ-΢Τ-ԯ‐-‧‰-⁞₠-₿ぁ-ゖァ-ヺ一-鿿가-힣]")
#: How the two shapes cut a chunk further, as their configuration files say.
PRETOKENS = {
    "bytes": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "words": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
#: Bytes as the characters that byte-level vocabularies are written in.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_TEXT = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_CONTROL = re.compile("[\x1c-\x1f]")
_PIECES = re.compile(" ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+")
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_CROSSED = re.compile(r"\s \s")


def _shape(config: dict) -> str:
    """'bytes' or 'words' for the two cuts that are known here, else ''."""
    pre, norm, model = config.get("pre_tokenizer") or {}, config.get("normalizer"), config.get("model", {})
    if model.get("type") != "BPE" or model.get("dropout"):
        return ""
    if pre.get("type") == "ByteLevel" and norm is None and not pre.get("add_prefix_space") and pre.get("use_regex", True):
        return "bytes"
    if pre.get("type") == "Sequence" and norm and [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        a, *b = pre.get("pretokenizers", [{}])
        if a.get("type") == "Split" and a.get("behavior") == "Removed" and a.get("invert") and "\\s" in str(a.get("pattern")) and [x.get("type") for x in b] == ["ByteLevel"] and not b[0].get("add_prefix_space") and not b[0].get("use_regex"):
            return "words"
    return ""


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.shape = _shape(config)
        self.special = [x["content"] for x in config.get("added_tokens") or []]
        self.seen: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_seen: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        self.pattern = regex.compile(PRETOKENS[self.shape]) if self.shape else None
        model, ends = config.get("model", {}), config.get("model", {}).get("end_of_word_suffix") or ""
        whole = self.shape and not model.get("continuing_subword_prefix") and not model.get("ignore_merges") and all(c + e in model["vocab"] for c in _AS_TEXT.values() for e in {"", ends})
        self.merges = Merges(model, _AS_TEXT) if whole else None

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Adds unseen chunks; long ones are returned and not kept. A chunk is the sum of its pretokens, and only pretokens
        that weren't seen either go through the library's model (the steps before it have no more to do then)."""
        if len(self.seen) + len(chunks) > CACHE_ENTRIES:
            self.old_seen, self.seen = self.seen, {}
        if len(self.parts) > PART_ENTRIES:
            self.old_parts, self.parts = self.parts, {}
        prefix = " " if self.shape == "bytes" else ""
        parts, seen, find, merge = self.parts, self.seen, self.pattern.findall, self.model.tokenize
        old_parts, old_seen = self.old_parts, self.old_seen
        once = {}
        for c in chunks:
            if (ids := old_seen.get(c)) is not None:
                seen[c] = ids
                continue
            pieces = find(prefix + c)
            if len(pieces) == 1:  # kept as a chunk, so not as a pretoken too
                p = pieces[0]
                ids = parts.get(p) or old_parts.get(p) or array("I", [t.id for t in merge(p.encode().decode("latin-1").translate(_AS_TEXT))]).tobytes()
            else:
                out = []
                for p in pieces:
                    ids = parts.get(p)
                    if ids is None:
                        ids = old_parts.get(p) or (seen.get(p[len(prefix) :]) if p.startswith(prefix) else None)
                        if ids is None:
                            ids = array("I", [t.id for t in merge(p.encode().decode("latin-1").translate(_AS_TEXT))]).tobytes()
                        if len(p) <= CHUNK_CHARS:
                            parts[p] = ids
                    out.append(ids)
                ids = b"".join(out)
            (seen if len(c) <= CHUNK_CHARS else once)[c] = ids
        return once

    def _know(self, need: set[str]) -> dict[str, bytes]:
        """Sees to it that all chunks are in the cache or in what is returned. (Set minus dict keys would walk the cache.)"""
        once = self._learn({c for c in need if c not in self.seen})
        if more := {c for c in need if c not in self.seen and c not in once}:  # the cache was emptied just now
            once |= self._learn(more)
        return once

    def _join(self, chunks: list[str]) -> bytes:
        try:
            return b"".join(map(self.seen.__getitem__, chunks))
        except KeyError:
            once = self._know(set(chunks))
            return b"".join([self.seen[c] if c in self.seen else once[c] for c in chunks])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.shape or any(s in text for s in self.special):
            return self.whole(text)
        if not text.isascii() and _UNSURE.search(text):
            return self.whole(text)
        if self.shape == "words":
            if _CONTROL.search(text) or not unicodedata.is_normalized("NFC", text):
                return self.whole(text)
            return self._join(text.lower().split())
        if self._crossed(text):
            return self.whole(text)
        if "  " in text:
            if _ODD_SPACE.search(text):
                return self.whole(text)
            pieces = _PIECES.findall(text)
            plain = [p for p in pieces if p[0] != " " or len(p) == 1 or p[1] in " \t\n\r\x0b\x0c"]
            if not plain:
                return self._join([p[1:] for p in pieces])
            known = {p: self.whole(p) for p in set(plain)}
            once = self._know({p[1:] for p in pieces if p not in known})
            return b"".join([known[p] if p in known else (self.seen.get(p[1:]) if p[1:] in self.seen else once[p[1:]]) for p in pieces])
        first, *rest = text.split(" ")
        return (self.whole(first) if first else b"") + (self._join(rest) if rest else b"")

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """encode() of each text."""
        out: list[bytes] = [b""] * len(texts)
        group, held = [], 0
        for i, t in enumerate(texts):
            if t and self.merges and len(t) < LONG and self._cuts(t):
                group.append(i)
                held += len(t)
                if held >= TOGETHER:
                    self._group(texts, group, out)
                    group, held = [], 0
            else:
                out[i] = self.encode(t)
        if held >= LEAST:
            self._group(texts, group, out)
        else:
            for i in group:
                out[i] = self.encode(texts[i])
        return out

    def _cuts(self, text: str) -> bool:
        """Whether the text is no more than its chunks."""
        if any(s in text for s in self.special) or not text.isascii() and _UNSURE.search(text):
            return False
        if self.shape == "words":
            return not _CONTROL.search(text) and (text.isascii() or unicodedata.is_normalized("NFC", text))
        return " " in text and "  " not in text and not self._crossed(text)

    def _crossed(self, text: str) -> bool:
        """Whether there may be tokens with a space inside: those of no-break and plain spaces in turn."""
        return ("\xa0" in text or "\x85" in text) and _CROSSED.search(text) is not None

    def _group(self, texts: list[str], group: list[int], out: list[bytes]) -> None:
        if self.shape == "words":
            heads = None
            lists = pc.utf8_split_whitespace(pa.array([texts[i].lower() for i in group], pa.large_string()))
        else:
            parts = [texts[i].partition(" ") for i in group]
            heads = [self.whole(p[0]) if p[0] else b"" for p in parts]
            lists = pc.split_pattern(pa.array([p[2] for p in parts], pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        joined = self._ids_of(coded.dictionary).take(coded.indices)
        flat, off = memoryview(joined.buffers()[2] or b""), np.frombuffer(joined.buffers()[1], np.int64)
        ends = off[lists.offsets.to_numpy()].tolist()
        for k, i in enumerate(group):
            ids = flat[ends[k] : ends[k + 1]]
            out[i] = heads[k] + ids if heads else bytes(ids)

    def _ids_of(self, chunks: pa.Array) -> pa.Array:
        """The ids of different chunks, as binaries."""
        prefix = " " if self.shape == "bytes" else ""
        full = pc.binary_join_element_wise(pa.scalar(prefix, chunks.type), chunks, pa.scalar("", chunks.type)) if prefix else chunks
        filled = pc.greater(pc.binary_length(full), 0).to_numpy(zero_copy_only=False)
        if not filled.all():  # between white space at the ends of a text
            full = full.filter(pa.array(filled))
        data, off = utf8(full)
        starts, odd = pretokens(data, off, bool(prefix))
        bounds = np.append(starts, len(data))
        of = np.searchsorted(starts, off)  # pretokens before each chunk
        wide = np.concatenate([[0], np.cumsum(np.diff(bounds) > LONGEST)])
        odd |= wide[of[1:]] > wide[of[:-1]]
        sure = np.repeat(~odd, np.diff(of))
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)).filter(pa.array(sure)).dictionary_encode()
        ids, counts = self.merges.merge(*utf8(words.dictionary))
        merged = _binaries(ids.tobytes(), 4 * counts).take(words.indices)
        ends = np.frombuffer(merged.buffers()[1], np.int64)[np.concatenate([[0], np.cumsum(np.diff(of)[~odd])])]
        plain = _binaries(merged.buffers()[2], np.diff(ends))
        rest = chunks.filter(pa.array(filled)).filter(pa.array(odd)).to_pylist() if odd.any() else []
        once = self._know(set(rest))
        known = pa.array([b"", *[self.seen[c] if c in self.seen else once[c] for c in rest]], pa.large_binary())
        place = np.zeros(len(odd), np.int64)
        place[~odd], place[odd] = np.arange(len(plain)), len(plain) + 1 + np.arange(len(rest))
        at = np.full(len(chunks), len(plain))
        at[filled] = place
        return pa.concat_arrays([plain, known]).take(pa.array(at))


def _binaries(data, sizes: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), data if isinstance(data, pa.Buffer) else pa.py_buffer(data)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Empties the caches; the next text fills them again."""
    for e in _ENCODERS.values():
        e.seen, e.parts, e.old_seen, e.old_parts = {}, {}, {}, {}


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
