"""Directly addressable codes: round trips, random access, and edge cases."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crease.llm import dac
from crease.llm.sources import tokenizer_path
from crease.llm.tokens import PartEncoder

from .helpers import SCHEMA, corpus, frame

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.mark.parametrize("high", [1, 200, 256, 60_000, 1 << 20, 1 << 32])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_file_round_trip_and_rank_access(high, n):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    reader = dac.Reader(dac.encode(ids, np.array([0])))
    assert (reader.all_ids() == ids).all() and reader.firsts.tolist() == [0]
    at = np.random.default_rng(1).permutation(n)[:200]
    assert (reader.at(at) == ids[at]).all()


def test_files_are_about_a_byte_and_a_bit_for_small_ids():
    assert len(dac.encode(np.full(100_000, 7), np.array([0]))) < 100_200
    assert len(dac.encode(np.full(100_000, 700), np.array([0]))) < 100_000 * 2.2
    with pytest.raises(ValueError):
        dac.Reader(b"nope" + b"\0" * 40)


def true_ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows]


@pytest.mark.parametrize("block_bytes", [1 << 11, 8 << 20])
def test_documents_come_back(spark, block_bytes):
    rows = sorted(corpus()[:-1], key=lambda r: r[0])
    store = dac.write(frame(spark, rows).repartition(3), PATH, block_bytes=block_bytes)
    got = sorted(dac.read(store).collect(), key=lambda r: r.start)
    start = 0
    for r, (i, ids) in zip(got, true_ids(rows), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    asked = [(i, k) for i, ids in true_ids(rows)[::3] for k in (0, len(ids) - 1, len(ids), -1)] + [(None, 0), (-5, 0), (0, None)]
    wanted = {(i, k): (ids[k] if 0 <= k < len(ids) else None) for i, ids in true_ids(rows)[::3] for k in (0, len(ids) - 1, len(ids), -1)}
    wanted[0, None] = None
    found = {(r.doc_id, r.place): r.id for r in
             dac.tokens_at(store, spark.createDataFrame(asked, "doc_id long, place long")).collect()}
    assert found == wanted


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(5, "b", None, None, 0), (5, "a", None, None, 0), (None, "c", None, None, 0), (None, None, None, None, 0)]
    got = sorted(dac.read(dac.write(frame(spark, rows), PATH)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 5, 5]
    assert [r.n_tokens for r in got] == [1, 2, 2, 2]
    assert dac.read(dac.write(spark.createDataFrame([], SCHEMA), PATH)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_part_encoder_equals_the_library(name):
    from tokenizers import Tokenizer

    path = tokenizer_path(name)
    texts = [r[1] or "" for r in corpus()] + [
        "", " ", "  a", "a  b", "a \n b", " x y", "é ́x", "don't we'll I'M", "x y z", "日本 語", "a\x1cb c",
        "ΑΣ ΑΣ", "<|endoftext|> x", " a <|startoftext|>b, <|EndOfText|> c. d", "tab\tb \t c", "İ i̇", "1 23 456", "a .b ,c", "ﬁ ﬂ", "x \x85 y", "trail "]
    t = Tokenizer.from_file(path)
    enc = PartEncoder(path)
    for _ in range(3):
        ids, at = enc.encode(pa.array([*texts, None]), 1)
        got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
        assert got == [t.encode(x, add_special_tokens=False).ids + [1] for x in texts] + [[1]]
    alone = [PartEncoder(path).encode(pa.array([x]), 1)[0].tolist() for x in texts[:40]]
    assert alone == [t.encode(x, add_special_tokens=False).ids + [1] for x in texts[:40]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \n\t\r.,'!-_<|x1Ab9é×ßñ日\u0301\u00a0\u3000\x1e\u2009σΣİ")), max_size=24), min_size=1))
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_part_encoder_on_odd_texts(name, texts):
    path = tokenizer_path(name)
    enc = PartEncoder.of(path)
    ids, at = enc.encode(pa.array(texts), 1)
    assert [ids[a:b - 1].tolist() for a, b in zip(at[:-1], at[1:])] == [
        e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
