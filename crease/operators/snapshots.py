"""Differences between two exports of a table, and sums kept up to date by them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row_hash(row: Column) -> Column:
    """128 bits of a row: of its JSON text, which tells NULL from any value.

    It is never NULL, and Spark can see that: for a key that might be, a join adds
    a filter, and to reason about one over many computed columns takes minutes.
    """
    plain = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
             "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return F.md5(F.coalesce(F.to_json(row, plain), F.lit("")))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows whose number differs: all columns of ``new`` and ``_delta``, how
    many more (or, negative, fewer) copies ``new`` has.

    Repeated rows count each (a multiset difference); NULL equals NULL; column
    order does not matter.  Columns that one side lacks are refused.  Values are
    compared by their text, so types may differ where the text does not.

    Plan: rows are counted by a 128-bit hash (partial aggregation; some 40
    bytes a distinct row are shuffled, not the rows).  Where the counts agree, nothing
    more happens; the others, few as a rule, fetch their row by a join on the hash.
    """
    columns = new.columns
    if sorted(old.columns) != sorted(columns):
        raise ValueError(f"columns differ: {sorted(set(old.columns) ^ set(columns))}")
    hashed = {side: df.select(F.struct(*columns).alias("_row")).withColumn("_hash", _row_hash(F.col("_row")))
              for side, df in (("old", old), ("new", new))}
    sides = [df.select("_hash", F.lit(1 if side == "new" else -1).cast("long").alias("_n")) for side, df in hashed.items()]
    delta = sides[0].union(sides[1]).groupBy("_hash").agg(F.sum("_n").alias("_delta")).where("_delta <> 0")
    more, fewer = delta.where("_delta > 0"), delta.where("_delta < 0")
    found = [hashed[side].join(part, "_hash").groupBy("_hash").agg(F.first("_row").alias("_row"), F.first("_delta").alias("_delta"))
             .select("_row.*", "_delta") for side, part in (("new", more), ("old", fewer))]
    return found[0].unionByName(found[1])


def classify(diff: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key, change, added, removed`` per key in ``snapshot_diff``: 'added' if the
    key has only more rows, 'removed' if only fewer, 'changed' if both; the counts
    are of rows.  (A key of which one of two equal rows went is 'removed' 1.)"""
    counts = diff.groupBy(*key).agg(F.sum(F.greatest("_delta", F.lit(0))).alias("added"),
                                    F.sum(F.greatest(-F.col("_delta"), F.lit(0))).alias("removed"))
    change = F.when(F.col("removed") == 0, "added").when(F.col("added") == 0, "removed").otherwise("changed")
    return counts.select(*key, change.alias("change"), "added", "removed")


def partial_sums(rows: DataFrame, by: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """``by``, ``_rows`` and the sums of ``measures`` (NULL counts as 0): the table to keep."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"),
                                 *[F.sum(F.coalesce(m, F.lit(0))).cast("long").alias(n) for n, m in measures.items()])


def refresh(kept: DataFrame, diff: DataFrame, by: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """``kept`` (``partial_sums`` of the old rows) brought up to the new rows by
    ``snapshot_diff`` alone: each differing row counts ``_delta`` times.  Groups
    without rows go.  Sums of integers equal a full run exactly."""
    change = diff.groupBy(*by).agg(F.sum("_delta").alias("_rows"), *[
        F.sum(F.coalesce(m, F.lit(0)) * F.col("_delta")).cast("long").alias(n) for n, m in measures.items()])
    names = ["_rows", *measures]
    return (kept.select(*by, *names).unionByName(change).groupBy(*by).agg(*[F.sum(n).alias(n) for n in names])
            .where(F.col("_rows") > 0))
