"""Readers for the raw CSV exports and the parquet tables built from them.

CSV is read once with a declared schema (no inference job) and written to
parquet; every query then reads parquet, where column pruning and filter
pushdown reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapter import Tables
from .schemas import DELIVERIES_SCHEMA, MATCHES_SCHEMA

KEYS = {"deliveries": ("match_id", "inning", "over", "ball"), "matches": ("id",)}


def read_csv(spark: SparkSession, path: str, schema, *, null_value: str | None = "NA",
             strict_header: bool = True, mode: str = "PERMISSIVE") -> DataFrame:
    """CSV with header, bound to ``schema``.

    ``null_value='NA'`` makes both an empty cell and the text ``NA`` a NULL, so
    "no extras" and "no dismissal" have one representation.  ``strict_header``
    fails the read when a header name differs from the schema (instead of
    binding columns by position).  ``mode`` is Spark's parse mode; PERMISSIVE
    turns a malformed number or date into NULL.
    """
    reader = (spark.read.schema(schema).option("header", True)
              .option("enforceSchema", not strict_header).option("mode", mode))
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    return reader.csv(path)


def read_deliveries_csv(spark: SparkSession, path: str, **kw) -> DataFrame:
    return read_csv(spark, path, DELIVERIES_SCHEMA, **kw)


def read_matches_csv(spark: SparkSession, path: str, **kw) -> DataFrame:
    return read_csv(spark, path, MATCHES_SCHEMA, **kw)


def read_tables(spark: SparkSession, root: str) -> Tables:
    """``Tables`` over ``{root}/deliveries`` and ``{root}/matches`` parquet."""
    return Tables(spark.read.schema(DELIVERIES_SCHEMA).parquet(f"{root}/deliveries"),
                  spark.read.schema(MATCHES_SCHEMA).parquet(f"{root}/matches"))


def write_tables(tables: Tables, root: str, *, mode: str = "errorifexists") -> None:
    """Write both tables as parquet under ``root``, in the order they come (no
    report filters by match, so sorting all balls by it would buy nothing)."""
    tables.deliveries.write.mode(mode).parquet(f"{root}/deliveries")
    tables.matches.write.mode(mode).parquet(f"{root}/matches")


@dataclass(frozen=True)
class Ingested(Tables):
    """The written tables and, per key column, how many rows hold no key."""

    key_nulls: dict[str, int]


def key_nulls(tables: Tables) -> DataFrame:
    """One row per key column: ``table``, ``column``, ``rows``, ``nulls``.

    A key that fails to parse becomes NULL, and its row then drops out of joins
    and matrices; one aggregate over each table says how many there are.
    """
    parts = []
    for name, keys in KEYS.items():
        df = getattr(tables, name)
        counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(k).isNull()).alias(k) for k in keys])
        parts.append(counts.select(F.lit(name).alias("table"), "rows", F.expr(
            f"stack({len(keys)}, " + ", ".join(f"'{k}', `{k}`" for k in keys) + ") AS (column, nulls)")))
    return parts[0].union(parts[1]).select("table", "column", "rows", "nulls")


def ingest_csv(spark: SparkSession, deliveries_csv: str, matches_csv: str, root: str,
               **csv_options) -> Ingested:
    """CSV exports -> parquet tables under ``root``; returns readers over them
    and the null counts of their key columns (``deliveries.match_id`` etc.)."""
    raw = Tables(read_deliveries_csv(spark, deliveries_csv, **csv_options),
                 read_matches_csv(spark, matches_csv, **csv_options))
    write_tables(raw, root)
    written = read_tables(spark, root)
    counts = {f"{r.table}.{r.column}": r.nulls for r in key_nulls(written).collect()}     # one row per key column
    return Ingested(written.deliveries, written.matches, counts)
