"""Quality rules: the heuristics by brute force, the ratio by held-out labels."""

import collections
import re

import numpy as np
import pytest

from crease.llm import quality_rules as q

from .helpers import SCHEMA, WORD, corpus, frame, words

EXTRA = ["one line\none line\n one line\n\n\nlast # $$ é|", "a b c d e a b c d e f g a b c d e", "x " * 40, "#*$%&|<>", "tab\tsep\x0b"]


def brute(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    count = collections.Counter(wins)
    covered = {k + j for k, x in enumerate(wins) if count[x] > 1 for j in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_heuristics_equal_brute_force(spark):
    rows = corpus() + [(900 + i, t, None, None, 0) for i, t in enumerate(EXTRA)]
    got = q.apply_rules(frame(spark, rows), np.zeros(q.DIM, np.float32), carry=("doc_id", "text")).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text)
        assert r.kept == (not r.base_failed) and r.llr == 0
    assert len(got) == len(rows)


def test_ratio_counts_all_documents(spark):
    rows = [(i, f"good word{i % 3} here" if i % 2 else "bad || word", None, None, 0) for i in range(40)]
    weights = q.log_ratio(frame(spark, rows), np.arange(1, 40, 2))
    import pyarrow as pa

    good, bad = (q.ngrams(pa.array([t]))[0] for t in ("good", "||"))
    assert weights[good] > 0.3 and weights[bad] < -1
    assert (q.log_ratio(frame(spark, rows), np.zeros(0, np.int64)) == 0).all()


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_labelled_documents_are_told_apart(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    got = q.judge_documents(docs, labels).join(labels, "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good[~good.base_failed].kept.mean() >= 0.99
    assert bad.kept.mean() <= 0.02


def test_empty_tables_and_null_labels(spark):
    labels = spark.createDataFrame([(None, 1), (1, None), (1, 1), (1, 1), (999, 1)], "doc_id long, quality int")
    assert q.judge_documents(spark.createDataFrame([], SCHEMA), labels).count() == 0
    got = q.judge_documents(frame(spark), labels)
    assert got.count() == len(corpus())
    assert {r.kept for r in got.where("n_words = 0").collect()} == {False}
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept != r.base_failed for r in q.judge_documents(frame(spark), no_labels).collect())


def test_carried_columns_with_the_results_names(spark):
    df = frame(spark).selectExpr("doc_id", "text", "'a' AS kept", "'b' AS n_words")
    got = q.apply_rules(df, np.zeros(q.DIM), carry=["doc_id", "kept", "n_words"])
    assert got.columns[:3] == ["doc_id", "kept_in", "n_words_in"]
    assert {(r.kept_in, r.n_words_in) for r in got.collect()} == {("a", "b")}
