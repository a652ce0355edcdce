"""Ordered blocks: balanced in bytes whatever the ids; cuts are a table."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crease.llm import blocks
from crease.llm.blocks import SHIFT, ordered_blocks, rank_of_block
from crease.llm.substring_dedup import remove_repeats

from .helpers import SCHEMA, frame
from .test_substring_dedup import brute


def cut(spark, rows, block_bytes):
    df = spark.createDataFrame(rows, "id long, text string").repartition(7)
    got, n = ordered_blocks(df, "id", "text", block_bytes)
    return got.select("id", "_block", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).collect(), n


def sizes(got):
    total = Counter()
    for r in got:
        total[r._block] += r.size + blocks.ROW_BYTES
    return total


def check(got, n, rows):
    assert len(got) == len(rows)
    spans = {}
    for r in got:
        spans.setdefault(rank_of_block(r._block), []).append(-1 << 63 if r.id is None else r.id)
    ranks = sorted(spans)
    assert all(max(spans[a]) < min(spans[b]) for a, b in zip(ranks, ranks[1:]))
    for r in got:
        assert (r.id is None) == (rank_of_block(r._block) == -1)
        if r._block % SHIFT and r.id is not None:              # only a single id is cut into parts
            assert len(set(spans[rank_of_block(r._block)])) == 1
    total = sizes(got)
    assert max(total.values()) < 2 * sum(total.values()) / n


def test_long_texts_at_one_end(spark):
    rows = [(i, "x" * (50 if i < 19_000 else 20_000)) for i in range(20_000)]
    got, n = cut(spark, rows, 1 << 20)
    assert n == 21
    check(got, n, rows)


def test_a_third_without_id_and_half_on_one(spark):
    rng = random.Random(1)
    kind = [rng.random() for _ in range(12_000)]
    rows = [(None if k < .33 else 77 if k < .83 else rng.randrange(-500, 500_000), "y" * rng.randrange(200) + str(i))
            for i, k in enumerate(kind)]
    got, n = cut(spark, rows, 1 << 16)
    check(got, n, rows)


def test_rows_without_text_weigh_too_and_extreme_ids(spark):
    rows = [(i, None) for i in range(5000)] + [((1 << 63) - 1, "z" * 3000 + str(k)) for k in range(200)] + [(-1 << 63, "")]
    got, n = cut(spark, rows, 1 << 15)
    check(got, n, rows)


def test_cuts_are_joined_alike_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(i * 3, "w" * 400) for i in range(4000)]
    first, n = cut(spark, rows, 1 << 13)
    assert n > 2 * blocks.GROUP
    check(first, n, rows)
    monkeypatch.setattr(blocks, "GROUP_ROWS", 0)
    second, _ = cut(spark, rows, 1 << 13)
    check(second, n, rows)


@pytest.mark.parametrize("n", [3, 300])
def test_a_hot_id_never_cuts_itself(spark, n):
    rng = random.Random(n)
    p, q = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    rows = [(5, f"{p} a{rng.randrange(9)}", None, None, 0) for _ in range(n)] + [(None, p, None, None, 0)] * n
    rows += [(9, f"{q} {p}", None, None, 0), (2, q, None, None, 0), (11, q, None, None, 0)]
    got = remove_repeats(frame(spark, rows), block_bytes=1 << 12)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.where("doc_id IS NOT NULL").collect())
    assert got == brute([r for r in rows if r[0] is not None], 50)


def test_carried_columns_with_the_results_names(spark):
    df = frame(spark).select("doc_id", "text", F.lit(1).alias("_block"), F.lit("a").alias("n_words"),
                             F.lit("b").alias("N_REMOVED"), F.lit("c").alias("n_words_in"))
    got = remove_repeats(df, carry=["_block", "n_words", "N_REMOVED", "n_words_in"])
    assert got.columns == ["doc_id", "_block", "n_words_in_in", "N_REMOVED_in", "n_words_in",
                           "n_words", "n_removed", "spans", "kept_text"]
    assert {(r["_block"], r["n_words_in_in"], r["N_REMOVED_in"], r["n_words_in"]) for r in got.collect()} == {(1, "a", "b", "c")}
    assert remove_repeats(spark.createDataFrame([], SCHEMA), carry=["lang"]).columns[1] == "lang"
