"""A training corpus from ``documents``: five stages, each written and read again.

toxicity (rejected documents go) -> quality rules (rejected documents go) ->
n-gram Jaccard join (the document with the smallest id of each near-duplicate
class stays) -> substring dedup (repeated passages are cut out of the texts) ->
packing (pieces of training sequences).

All stages but the last return the columns of their input, in order.  Other
columns are carried along whatever their names.  Null texts: no words, so the
quality rules reject them.  Rows with a null ``doc_id`` are judged by the first
two stages like any others; they have no near duplicates, are not cut, and are
packed.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crease.llm import jaccard_join, packing, quality_rules, substring_dedup, toxicity
from crease.llm.sources import importable, stored, table, tokenizer_path


def _plain(docs: DataFrame) -> tuple[DataFrame, list[str], str, str]:
    """``docs`` under names that clash with nothing; (frame, names, id, text)."""
    importable(docs.sparkSession)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = {c: n for c, n in zip(docs.columns, names)}
    return docs.toDF(*names), names, at["doc_id"], at["text"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    plain, names, _, text = _plain(docs)
    scored = toxicity.score(plain, model, text_col=text, carry=names)
    return scored.where("predicted = 0").select(*names).toDF(*docs.columns)


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = quality_rules.log_ratio(docs, quality_rules.trusted_ids(table(spark, sf_dir, "labels")))
    plain, names, _, text = _plain(docs)
    judged = quality_rules.apply_rules(plain, weights, text_col=text, carry=names)
    return judged.where("kept").select(*names).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays; equal rows of one id count as copies.
    Rows that share an id but not their text stay or go together."""
    plain, names, doc_id, text = _plain(docs)
    classes = jaccard_join.near_duplicates(docs.select("doc_id", "text"))
    stays = classes.where("class_id = doc_id").select(F.col("doc_id").alias("_id")).distinct()
    copies = Window.partitionBy(doc_id, F.xxhash64(text)).orderBy(doc_id)
    first = (plain.where(F.col(doc_id).isNotNull()).join(stays, F.col(doc_id) == F.col("_id"), "left_semi")
             .withColumn("_n", F.row_number().over(copies)).where("_n = 1").select(*names))
    return first.union(plain.where(F.col(doc_id).isNull())).toDF(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeats stay as they are; cut texts keep their other words,
    joined by single spaces, and get their new ``n_chars``."""
    plain, names, doc_id, text = _plain(docs)
    cut = substring_dedup.remove_repeats(plain, doc_id, text, carry=names)
    out = {n: F.col(n) for n in names}
    out[text] = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(text))
    if "n_chars" in docs.columns:
        n = names[docs.columns.index("n_chars")]
        out[n] = (F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(F.col(n))
                  .cast(docs.schema["n_chars"].dataType))
    return cut.select(*[c.alias(n) for n, c in out.items()]).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("quality_rules", reject_low_quality),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("packing", pack_sequences),
]

ORACLE_SQL = None     # tokenizers and learnt models are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    *stages, (_, last) = STAGES
    docs = functools.reduce(lambda d, stage: stored(stage[1](spark, d, sf_dir), stage[0]), stages, docs)
    return last(spark, docs, sf_dir)
