import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import token_output as T
from loomspan.llm import packing, tokens
from loomspan.llm.tokens import Encoder, vocabulary

TEXTS = [
    "", " ", "  ", "a", " a b", "a  b", "a   b \n c", "x \n", "x\n\n y", "It's  what's\tHERE 123 4,5!?  ", "naïve Äpfel élan", "İstanbul ΑΣ ς", "é combining",
    "<|endoftext|> in text", "<|startoftext|>x", "日本語 テキスト 한국어", "a\xa0b\xa0 c", "a\x1cb \x85 c", "emoji 😀 fin", "don't 'S 'RE", "\tfoo", "end ", "end  ", "a\r\nb", "x" * 3000, "ab " * 500 + " \n" * 7, "ﬁ ½ ²",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    from tokenizers import Tokenizer

    enc, tok = Encoder(vocabulary(name)), Tokenizer.from_file(vocabulary(name))
    assert enc.shape

    def same(t):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)

    for t in TEXTS * 2:
        same(t)
    settings(max_examples=300, deadline=None)(given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,aBé1sS\xa0 ß漢"), st.characters(codec="utf-8")), max_size=40))(same))()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_together_equal_library(name, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "LEAST", 1)
    enc, tok = Encoder(vocabulary(name)), Tokenizer.from_file(vocabulary(name))
    assert enc.merges

    def same(texts):
        for t, ids in zip(texts, enc.encode_all(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)

    more = ["a it's it'sun 's 'tis ''s .'s 1's don't'veal 'l 'll x'", "n a’s 12½3 x9y é9 élan's ß'S", "z " + "y" * 70 + " w " + "é" * 40, "a ...!!! --x-- (b) \n\n c", " lead", "trail ", "\x85q r\x85", "a", None]
    same(TEXTS + more)
    same([])
    same([None, ""])
    settings(max_examples=200, deadline=None)(given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,aBé1sStmdrevl\xa0 ß漢"), st.characters(codec="utf-8")), max_size=40), max_size=6))(same))()
    monkeypatch.setattr(tokens, "TOGETHER", 50)
    same(TEXTS + more)


@pytest.mark.parametrize("together", [False, True])
def test_spaces_in_turn_equal_library(together, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "LEAST", 1)
    enc, tok = Encoder(vocabulary("byte_bpe_50k.json")), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = ["x " + "".join(p) + "b" for p in itertools.product(" \n\xa0\x85a", repeat=5)]
    for t, ids in zip(texts, enc.encode_all(texts) if together else map(enc.encode, texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_together_are_not_merged_word_by_word(name, monkeypatch):
    enc, rng = Encoder(vocabulary(name)), np.random.default_rng(1)
    texts = ["I " + " ".join("".join(rng.choice(list("aeinrstéo"), 8)) + "," * int(rng.integers(0, 2)) for _ in range(200)) for _ in range(100)]
    asked = []
    monkeypatch.setattr(enc, "_learn", lambda chunks: asked.append(chunks) or {})
    got = enc.encode_all(texts)
    assert not any(asked)
    monkeypatch.undo()
    assert got == [enc.encode(t) for t in texts]


def test_pieces_of_a_batch_are_encoded_together(monkeypatch):
    from tokenizers import Tokenizer

    path, rng = vocabulary("byte_bpe_50k.json"), np.random.default_rng(2)
    enc, tok, asked = Encoder(path), Tokenizer.from_file(path), []
    learn = enc._learn
    monkeypatch.setitem(tokens._ENCODERS, path, enc)
    monkeypatch.setattr(enc, "_learn", lambda chunks: asked.append(chunks) or learn(chunks))
    monkeypatch.setattr(packing, "arrow_map", lambda docs, fn, *a, **k: fn)
    texts = ["I " + " ".join("".join(rng.choice(list("aeinrst"), 8)) for _ in range(400)) for _ in range(40)]
    batch = pa.record_batch([pa.array(range(41)), pa.array([*texts, None])], ["doc_id", "text"])
    got = pa.Table.from_batches(packing.cut(None, path, 2, 1024)([batch])).to_pylist()
    assert not any(asked)
    for i, t in enumerate([*texts, ""]):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        mine = [r for r in got if r["doc_id"] == i]
        assert sum(r["length"] for r in mine) == len(ids)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in mine)


@pytest.mark.parametrize("block", [64, 4096])
def test_simple8b_takes_some_blocks_at_a_time(block, monkeypatch):
    most, real = [], T._pack_blocks
    monkeypatch.setattr(T, "_pack_blocks", lambda v, block: most.append(len(v)) or real(v, block))
    v = np.random.default_rng(1).integers(0, 50_000, 500_001).astype("<u4")
    w, off = T.pack(v, block)
    assert max(most) <= T.AT_ONCE and sum(most) == len(v)
    assert np.array_equal(T.unpack(w, off, len(v), block), v)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 70000), st.integers(0, 2**64 - 1)), max_size=400), st.sampled_from([7, 64, 4096]))
def test_simple8b_round_trip(v, block):
    a = np.array(v, np.uint64)
    w, off = T.pack(a, block)
    assert T.unpack(w, off, len(a), block).tolist() == v
    for k in range(len(off)):  # each block alone
        part = w[off[k] : off[k + 1] if k + 1 < len(off) else len(w)]
        assert T.unpack(part, np.array([0]), len(v[k * block : (k + 1) * block]), block).tolist() == v[k * block : (k + 1) * block]
