"""Substring dedup against brute force, and its defined edge cases."""

import pytest

from crease.llm.substring_dedup import remove_repeats

from .helpers import SCHEMA, corpus, frame, words


def brute(rows, width):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 12, 8 << 20])
@pytest.mark.parametrize("width", [5, 50])
def test_equals_brute_force(spark, block_bytes, width):
    rows = corpus()
    got = remove_repeats(frame(spark, rows), width=width, block_bytes=block_bytes)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_text").collect())) == brute(rows, width)


def test_spans_are_maximal_and_cover_what_is_removed(spark):
    for r in remove_repeats(frame(spark), width=5).collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_null_ids_are_left_alone_and_do_not_cut(spark):
    p = " ".join(f"w{i}" for i in range(60))
    rows = [(None, p, None, None, 0), (7, p, None, None, 0), (3, p, None, None, 0), (3, p, None, None, 0)]
    got = remove_repeats(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (3, 0), (3, 0), (7, 60)]


def test_empty_table_and_carried_columns(spark):
    empty = remove_repeats(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    got = remove_repeats(frame(spark), carry=["lang", "text"])
    assert got.columns[:3] == ["doc_id", "lang", "text"]
    assert {(r.doc_id, r.text) for r in got.collect()} == {(r[0], r[1]) for r in corpus()}
