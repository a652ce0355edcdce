"""The lattice against the sentencepiece library, its folds, and decoding."""

import itertools
import math

import numpy as np
import pytest

from crease.llm import sentencepiece_lattice as s
from crease.llm.sources import tokenizer_path

from .helpers import SCHEMA, corpus, frame

PATH = tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "  two  spaces ", "a▁b", "日本 語", "é é ﬁ x", "tab\tnew\nline\r\n", "x" * 300, "aaaaaaaaaaaaaaaaaaa " * 3,
       " " * 45, "émoji 🎉🎉 ok", "Mixed,punct;uation...!!! (and) 'quotes'", "\u0000nul", "https://x.y/z?q=1&r=2", "ab" * 40]


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("block_bytes", [1 << 11, 16 << 20])
def test_ids_equal_the_library(spark, block_bytes):
    rows = corpus() + [(900 + i, t, None, None, 0) for i, t in enumerate(ODD)]
    model = library()
    want = {r[0]: model.encode(r[1] or "") for r in rows}
    got = s.encode(frame(spark, rows), PATH, block_bytes=block_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == want[r.doc_id] and r.n_pieces == len(r.ids)
        assert r.round_trip or r.doc_id == 903                  # the text that holds the mark itself


def test_merges_in_python_equal_the_library():
    v, model = s.Vocabulary.of(PATH), library()
    for text in [*(r[1] or "" for r in corpus()[:20]), *ODD]:
        if text:
            assert v.merge("▁" + text.replace(" ", "▁")) == model.encode(text)


def test_decoding(spark):
    model = library()
    texts = [t for t in ODD if "▁" not in t]
    df = spark.createDataFrame([(i, model.encode(t)) for i, t in enumerate(texts)] + [(99, None)], "n int, ids array<int>")
    got = {r.n: r.decoded for r in s.decode(df, PATH).collect()}
    assert got == {**dict(enumerate(texts)), 99: None}
    broken = spark.createDataFrame([([3 + 0xE6],)], "ids array<int>")
    assert s.decode(broken, PATH).first().decoded == "�"


def test_viterbi_finds_the_best_sum(spark):
    pieces = {"a": -2.0, "b": -2.5, "c": -1.0, "ab": -3.0, "bc": -3.2, "abc": -5.0, "ca": -2.0, "cab": -4.4}
    rng = np.random.default_rng(1)
    units = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(60)})
    table = spark.createDataFrame([(p, i, 0, x) for i, (p, x) in enumerate(pieces.items())],
                                  "piece string, id int, rank int, score double")
    names = list(pieces)
    got = s.best_scored(spark.createDataFrame([(u,) for u in units], "unit string"), table, 3).collect()
    assert {r.unit for r in got} == set(units)
    for r in got:
        path = [names[i] for i in r.ids]
        assert "".join(path) == r.unit
        best = -math.inf
        for cuts in itertools.product([0, 1], repeat=len(r.unit) - 1):
            at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(r.unit)]
            parts = [r.unit[a:b] for a, b in zip(at, at[1:])]
            if all(p in pieces for p in parts):
                best = max(best, sum(pieces[p] for p in parts))
        assert sum(pieces[p] for p in path) == pytest.approx(best)


def test_nulls_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b", None, None, 0), (1, None, None, None, 0), (2, "a b", None, None, 0), (2, "a b", None, None, 0)]
    got = s.encode(frame(spark, rows), PATH).collect()
    assert sorted((r.doc_id or 0, r.n_pieces, r.round_trip) for r in got) == [(0, 2, True), (1, 0, True), (2, 2, True), (2, 2, True)]
    assert s.encode(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_decoding_beside_a_column_of_that_name(spark):
    rows = spark.createDataFrame([([], "x"), (None, "y")], "ids array<int>, decoded string")
    assert sorted(r.decoded_in for r in s.decode(rows, PATH).collect()) == ["x", "y"]
