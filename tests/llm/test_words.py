"""Word hashing against a plain tokeniser."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import words as W
from docloom.llm.dartminhash import signatures

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB9 é\n-ß_漢.", max_size=20), max_size=6))
def test_words_equal_a_plain_tokeniser(texts):
    w = W.Words(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        want = WORD.findall(fold(t))
        got = w.h[w.first[i]:w.first[i + 1]]
        assert len(got) == len(want)
        assert (got == W.word_hashes(" ".join(want))).all()


def test_slices_cover_all_and_nulls_have_no_words():
    texts = pa.array(["a b", None, "", "c " * 100, "d"])
    parts = list(W.slices(texts, 10))
    assert sum(len(p) for p in parts) == 5
    assert [W.Words(p).counts().tolist() for p in parts] == [[2, 0, 0], [100], [1]]


def test_grams_stay_within_a_text():
    w = W.Words(pa.array(["a b c", "d e f"]))
    _, at = w.grams(range(3))
    assert at.tolist() == [0, 3]


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    got, want = [], []
    for _ in range(30):
        e = rng.integers(0, 2 ** 63, 120).astype(np.uint64)
        a, b = rng.random(120) * 3, rng.random(120) * 3
        sig = signatures(np.repeat([0, 1], 120), np.concatenate([e, e]), np.concatenate([a, b]), 2, 120)
        got.append((sig[0] == sig[1]).mean())
        want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(got) - np.mean(want)) < 0.03


def test_dart_signatures_of_short_and_empty_sets():
    sig = signatures(np.array([0, 2]), np.array([5, 5], np.uint64), np.ones(2), 3, 64)
    assert (sig[0] == sig[2]).all() and (sig[1] == np.iinfo(np.uint64).max).all()
