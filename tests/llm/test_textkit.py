import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sunlattice.llm import textkit
from tests.llm.helpers import words

TEXT = st.text(alphabet="ab Z9.\né×ÀÞ日_-", max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=6))
def test_words_are_told_apart(texts):
    got = textkit.Words(*textkit.utf8(pa.array(texts, pa.string())), (3, 5))
    wanted = [w for t in texts for w in words(t)]
    assert np.diff(got.first).tolist() == [len(words(t)) for t in texts]
    seen = {}
    for w, h in zip(wanted, got.hash.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    heads = {}
    for w, h in zip(wanted, got.prefix[0].tolist(), strict=True):
        raw = w.encode()
        assert (h == 0) == (len(raw) <= 3)
        if h:
            assert heads.setdefault(raw[:3], h) == h


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), st.integers(1, 5))
def test_shingles(texts, n):
    got = textkit.Words(*textkit.utf8(pa.array(texts)))
    grams, first = textkit.shingles(got, n, short=False)
    for i, t in enumerate(texts):
        w = words(t)
        wanted = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
        own = grams[first[i] : first[i + 1]].tolist()
        assert len(own) == len(wanted) and len(set(own)) == len(set(wanted))
    _, first = textkit.shingles(got, n)
    assert np.diff(first).tolist() == [0 if not words(t) else max(1, len(words(t)) - n + 1) for t in texts]


def test_pieces_do_not_matter(monkeypatch):
    texts = pa.array(["ab cd " * 50, None, "x" * 400, "é" * 300, "", "tail words"] * 3)
    whole = textkit.Words(*textkit.utf8(texts))
    monkeypatch.setattr(textkit, "PIECE", 64)
    cut = textkit.Words(*textkit.utf8(texts))
    assert (whole.hash == cut.hash).all() and (whole.start == cut.start).all() and (whole.first == cut.first).all()
    assert [x for a, b in textkit.pieces_of(texts, 100) for x in range(a, b)] == list(range(len(texts)))


def test_slices_and_empty():
    a = pa.array(["one two", "three", None, "four"])
    assert len(textkit.Words(*textkit.utf8(a.slice(1, 2))).hash) == 1
    assert len(textkit.Words(*textkit.utf8(pa.array([], pa.string()))).hash) == 0
