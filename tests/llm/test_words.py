"""Splitting and hashing helpers against plain Python."""

import numpy as np
import pyarrow as pa
import pytest

from crease.llm import textops as t
from crease.llm.hashes import bucket_edges, pack, unpack

from .helpers import corpus, words

TEXTS = [r[1] for r in corpus()] + ["a  b\x0bc\x0cd\r\ne\tf", " nbsp em", "x"]


def test_split_matches_regex():
    s = t.split(pa.array(TEXTS, pa.string()))
    got = [s.data[a:b].tobytes().decode() for a, b in zip(s.start, s.end)]
    assert [got[a:b] for a, b in zip(s.offsets[:-1], s.offsets[1:])] == [words(x) for x in TEXTS]
    by_word = {}
    for w, h in zip(got, s.hash):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_sliced_arrays_and_empty_input():
    arr = pa.array(TEXTS, pa.string())
    whole, part = t.split(arr), t.split(arr.slice(5, 7))
    assert (part.hash == whole.hash[whole.offsets[5]:whole.offsets[12]]).all()
    assert len(t.split(pa.array([], pa.string())).hash) == 0
    assert list(t.split(pa.array([None, "", " "], pa.string())).offsets) == [0, 0, 0, 0]


@pytest.mark.parametrize("width", [1, 2, 5, 50])
def test_windows_are_rolling_hashes_of_their_words(width):
    s = t.split(pa.array(TEXTS, pa.string()))
    at, h = t.windows(s.hash, s.offsets, width)
    of = t.owner(s.offsets)
    want = [i for i in range(len(of)) if i + width <= s.offsets[of[i] + 1]]
    assert at.tolist() == want
    seen = {}
    for i, x in zip(at, h):
        assert seen.setdefault(tuple(s.hash[i:i + width]), x) == x
    assert len(set(seen.values())) == len(seen)


def test_row_slices_cover_all_rows_once():
    arr = pa.array(TEXTS, pa.string())
    for limit in (1, 300, 1 << 20):
        parts = list(t.row_slices(arr, limit))
        assert [i for lo, hi in parts for i in range(lo, hi)] == list(range(len(TEXTS)))


def test_packed_hashes_come_back():
    for blocks in (1, 5000):
        edges = bucket_edges(blocks)
        h = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
        at = [*np.searchsorted(h, edges), len(h)]
        back = [unpack(pack(h[lo:hi]), int(edges[b]) >> 56) for b, (lo, hi) in enumerate(zip(at[:-1], at[1:]))]
        assert (np.concatenate(back) == h).all()
