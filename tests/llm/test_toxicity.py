"""Toxicity: FTRL by a plain reference, held-out labels, and edge cases."""

import math
import zlib

import numpy as np
import pyarrow as pa

from crease.llm import toxicity as t

from .helpers import SCHEMA, corpus, frame


def plain_ftrl(rows, labels, epochs):
    z, n = {}, {}
    weight = lambda i: 0.0 if i not in z else (
        -z[i] / ((t.BETA + math.sqrt(n[i])) / t.ALPHA) if i == t._BIAS else
        0.0 if abs(z[i]) <= t.L1 else
        -(z[i] - math.copysign(t.L1, z[i])) / ((t.BETA + math.sqrt(n[i])) / t.ALPHA + t.L2))
    for _ in range(epochs):
        for x, y in zip(rows, labels):
            at = [*x, t._BIAS]
            w = [weight(i) for i in at]
            g = 1 / (1 + math.exp(-sum(w))) - y
            for i, wi in zip(at, w):
                s = (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / t.ALPHA
                z[i] = z.get(i, 0) + g - s * wi
                n[i] = n.get(i, 0) + g * g
    return {i: weight(i) for i in z}


def test_ftrl_equals_the_plain_algorithm():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 60, 8)) for _ in range(200)]
    labels = np.array([float(3 in r or 7 in r) for r in rows])
    got = t.ftrl(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]), labels, 3)
    want = plain_ftrl(rows, labels, 3)
    assert np.allclose([got[i] for i in want], list(want.values()), atol=1e-9)
    assert set(np.flatnonzero(got)) <= set(want)


def test_features_are_distinct_and_skip_one_word():
    def of(text):
        b, off = t.features(pa.array([text]))
        return set(b[off[0]:off[1]].tolist())

    assert len(of("a b c")) == 3 + 2 + 1
    assert of("A, b. c!") == of("a b c")
    assert of("a a a a") == of("a a a")
    assert len(of("a b c") & of("a x c")) == 3            # a, c and the skip-gram a_c
    b, off = t.features(pa.array([None, "", "a"]))
    assert off.tolist() == [0, 0, 0, 1]
    wanted = np.zeros(t.DIM, bool)
    wanted[list(of("b"))] = True
    b, off = t.features(pa.array(["a b c", "c"]), wanted)
    assert set(b.tolist()) == of("b") and off.tolist() == [0, 1, 1]


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = t.score(docs, t.learn(docs, labels)).join(labels, "doc_id").withColumn("held", t.held_out("doc_id")).toPandas()
    assert (scored.held == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id]).all()
    x = scored[scored.held]
    assert x[x.toxic == 1].predicted.mean() >= 0.75        # a tenth or so of the labels is noise
    assert x[x.toxic == 0].predicted.mean() <= 0.01
    ranks = x.score.rank()
    pos = x.toxic == 1
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc >= 0.9


def test_edge_cases(spark):
    labels = spark.createDataFrame([(None, 1), (3, None), (6, 1), (6, 0), (999, 1)], "doc_id long, toxic int")
    got = t.score(frame(spark), t.learn(frame(spark), labels))
    assert got.count() == len(corpus()) and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in t.score(frame(spark), t.learn(frame(spark), none)).collect()} == {0.5}
    assert t.score(spark.createDataFrame([], SCHEMA), (np.zeros(0, int), np.zeros(0))).count() == 0
    assert spark.createDataFrame([(None,)], "doc_id long").select(t.held_out("doc_id")).first()[0] is True


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, ("good " if i % 2 else "awful ") * 100) for i in range(400)] + [(1, "good good")] * 500,
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)], "doc_id long, toxic int")
    whole = t.learn(docs, labels)
    assert [x.tolist() for x in t.learn(docs, labels, train_bytes=1 << 30)] == [x.tolist() for x in whole]
    few, one = t.learn(docs, labels, train_docs=30), t.learn(docs, labels, train_bytes=30 * 600)
    assert len(one[0]) <= len(whole[0]) and len(few[0]) <= len(whole[0])
    assert not len(t.learn(docs, labels, train_bytes=0)[0])


def test_carried_columns_with_the_results_names(spark):
    df = frame(spark).selectExpr("doc_id", "text", "'a' AS score", "'b' AS Predicted")
    got = t.score(df, (np.zeros(0, int), np.zeros(0)), carry=["doc_id", "score", "Predicted"])
    assert got.columns == ["doc_id", "score_in", "Predicted_in", "score", "predicted"]
    assert {tuple(r)[1:] for r in got.collect()} == {("a", "b", 0.5, 1)}
