"""Quality rules: heuristics plus a hashed n-gram log-likelihood ratio.

Two multinomials over ``DIM`` hashed buckets of 1- and 2-grams (lower-cased
words and punctuation runs): ``raw`` counts every n-gram of every document,
``target`` those of trusted documents (labels with quality 1; at most
``target_docs`` of them, taken in hash order -- the classifier's sample bound).
Both are scaled to the target's total and smoothed with ``PSEUDO_COUNT``, so a
bucket seen too rarely to tell weighs next to nothing.  A document's score is
the sum over its n-grams of log p_target - log p_raw, divided by its number of
n-grams plus ``PRIOR_NGRAMS`` so that a few words cannot sink a short text.  It passes when the
score reaches the fixed ``threshold``.

Plan.  One pass counts: each task adds up its own two count vectors and ships
``DIM`` rows at most, which Spark sums; the resulting weights (``DIM`` floats,
whatever the input) go to a second, shuffle-free pass over the documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import carried_names
from .textops import LINES, TOKENS, WORDS, Split, covered, owner, per_text, row_slices, split, windows

DIM = 1 << 16
TARGET_DOCS = 20_000
PRIOR_NGRAMS = 16
PSEUDO_COUNT = 4
THRESHOLD = -0.2
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WIDTH = 5

RULES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         "base_failed boolean, llr double, kept boolean")


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every hashed 1- and 2-gram."""
    s = split(texts, TOKENS, lower=True)
    at, pairs = windows(s.hash, s.offsets, 2)
    of = owner(s.offsets)
    return ((np.concatenate([s.hash, pairs]) & np.uint64(DIM - 1)).astype(np.int64),
            np.concatenate([of, of[at]]))


def trusted_ids(labels: DataFrame, limit: int = TARGET_DOCS) -> np.ndarray:
    """Ids of at most ``limit`` labelled documents of quality 1, in hash order."""
    good = (labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    return np.sort(np.array([r[0] for r in good.collect()], np.int64))


def log_ratio(docs: DataFrame, target: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log p_target - log p_raw of every bucket, counted over all documents."""

    def count(batches):
        raw, good = np.zeros(DIM, np.int64), np.zeros(DIM, np.int64)
        for b in batches:
            trusted = np.isin(b.column(0).fill_null(-1).to_numpy(zero_copy_only=False), target)
            trusted &= b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for lo, hi in row_slices(b.column(1)):
                at, of = ngrams(b.column(1).slice(lo, hi - lo))
                raw += np.bincount(at, minlength=DIM)
                good += np.bincount(at[trusted[lo:hi][of]], minlength=DIM)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(raw[seen]), pa.array(good[seen])],
                                         ["bucket", "raw", "good"])

    sums = (docs.select(id_col, text_col).mapInArrow(count, "bucket int, raw long, good long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")))
    raw, good = np.zeros(DIM), np.zeros(DIM)
    for r in sums.collect():                           # DIM rows at most
        raw[r.bucket], good[r.bucket] = r.raw, r.good
    expected = raw * (good.sum() / max(raw.sum(), 1))
    return (np.log(good + PSEUDO_COUNT) - np.log(expected + PSEUDO_COUNT)).astype(np.float32)


def _repeats(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """0 for the first of equal (text, hash) entries in input order, else 1; and
    -1 for entries without an equal."""
    order = np.lexsort((h, text))
    t, v = text[order], h[order]
    same = np.zeros(len(t) + 1, bool)
    same[1:-1] = (t[1:] == t[:-1]) & (v[1:] == v[:-1])
    out = np.empty(len(t), np.int8)
    out[order] = np.where(same[:-1], 1, np.where(same[1:], 0, -1))
    return out


def _heuristics(texts: pa.Array, s: Split) -> dict[str, np.ndarray]:
    data, bounds = s.data, s.bounds
    whole = lambda mask: per_text(mask, bounds)  # noqa: E731  sums over each text's bytes
    lines = split(texts, LINES)
    wordy = np.searchsorted(s.start, lines.end) > np.searchsorted(s.start, lines.start)
    line_of = owner(lines.offsets)
    again = np.zeros(len(wordy), np.int64)
    again[wordy] = _repeats(line_of[wordy], lines.hash[wordy]) == 1
    at, h = windows(s.hash, s.offsets, REPEAT_WIDTH)
    of = owner(s.offsets)
    repeated = covered(len(s.hash), at[_repeats(of[at], h) >= 0], REPEAT_WIDTH)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    return {"n_words": np.diff(s.offsets),
            "word_chars": whole((WORDS[data] != 0) & (data & 0xC0 != 0x80)),
            "n_symbols": whole(symbol[data]),
            "n_dup_lines": per_text(again, lines.offsets),
            "n_repeat_words": per_text(repeated, s.offsets)}


def apply_rules(docs: DataFrame, weights: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD,
                carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and the columns of ``RULES`` for every row; no shuffle.

    ``base_failed``: under 10 words, or over a fifth of the words lie in 5-word
    windows that occur twice in the text.  ``kept``: not base_failed and
    ``llr >= threshold``.  A null or empty text has 0 words and fails.  A carried
    column named like a column of the result comes back with ``_in`` added to its
    name.
    """
    own = T._parse_datatype_string(RULES).fields
    out_names = carried_names(carry, [f.name for f in own])
    carry = list(out_names)
    cols_in = list(dict.fromkeys([*carry, text_col]))

    def judge(batches):
        for b in batches:
            texts = b.column(cols_in.index(text_col))
            for lo, hi in row_slices(texts):
                part = texts.slice(lo, hi - lo)
                s = split(part)
                out = _heuristics(part, s)
                at, of = ngrams(part)
                n = np.bincount(of, minlength=hi - lo)
                out["base_failed"] = ((out["n_words"] < MIN_WORDS)
                                      | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"]))
                out["llr"] = np.bincount(of, weights[at], minlength=hi - lo) / (n + PRIOR_NGRAMS)
                out["kept"] = ~out["base_failed"] & (out["llr"] >= threshold)
                cols = [b.column(i).slice(lo, hi - lo) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*cols, *map(pa.array, out.values())], [*out_names.values(), *out])

    schema = T.StructType([*(T.StructField(new, docs.schema[c].dataType) for c, new in out_names.items()), *own])
    return docs.select(*cols_in).mapInArrow(judge, schema)


def judge_documents(docs: DataFrame, labels: DataFrame, carry: Sequence[str] = ("doc_id",),
                    target_docs: int = TARGET_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """``apply_rules`` with the ratio learnt from ``docs`` and ``labels``.

    Without a trusted document all weights are 0 and the heuristics alone
    decide.  Labels of absent documents, null labels and repeated labels are
    ignored.
    """
    weights = log_ratio(docs, trusted_ids(labels, target_docs))
    return apply_rules(docs, weights, threshold=threshold, carry=carry)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: rules and verdict of every document."""
    from .sources import table

    return judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
