import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import induced


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.binary(max_size=60), st.text(alphabet="ab", max_size=60).map(str.encode), st.text(alphabet="abc", max_size=12).map(lambda x: (x * 5).encode())))
def test_suffix_array(b):
    t = np.frombuffer(b, np.uint8)
    assert induced.suffix_array(t).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_queues_spill(tmp_path):
    rng = np.random.default_rng(0)
    t = np.concatenate([rng.integers(97, 101, 4000)] * 3)
    b = bytes(t.astype(np.uint8))
    got = induced.suffix_array(t, f"file://{tmp_path}", limit=100)
    assert got.tolist() == sorted(range(len(b)), key=lambda i: b[i:]) == induced.suffix_array(t).tolist()
    assert not [p for p in tmp_path.rglob("q-*")]


def test_large_alphabet():
    rng = np.random.default_rng(0)
    t = rng.integers(0, 9000, 500)
    assert induced.suffix_array(t).tolist() == sorted(range(500), key=lambda i: t[i:].tolist())
