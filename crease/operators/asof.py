"""As-of join: each row with the latest earlier row of another table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SALTS = 1024       # rows that can match nothing (null key or time) are dealt out so wide


def as_number(df: DataFrame, name: str) -> Column:
    """A numeric, date or timestamp column as a number (days, seconds) that grows with it."""
    kind = df.schema[name].dataType.typeName()
    if kind == "date":
        return F.unix_date(name)
    return F.unix_micros(F.col(name).cast("timestamp")) / 1e6 if kind.startswith("timestamp") else F.col(name)


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
              columns: dict[str, str], width: float, tie: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Every row of ``left`` with ``columns`` (name in ``right`` -> output name) of
    the ``right`` row of equal ``keys`` and the latest ``right_time`` at or before
    ``left_time`` (before it, if ``strict``); NULLs where there is none.

    Of right rows at one time, the largest by ``tie`` counts (NULLs smallest);
    beyond that they must not differ in ``columns``.  A NULL key or time matches
    nothing, on either side.  Rows of ``left`` are neither lost nor repeated.

    Plan: time is cut into buckets of ``width`` (days of a date, seconds of a
    timestamp, else the column's unit), and (keys, bucket) is the unit of work:
    both sides are merged there by one window, and the rows are shuffled once.  A
    bucket hands its last right row to the next ones: one row per key and bucket
    (partial aggregation), a window over those rows of a key, joined back on the
    partitioning the rows already have.  A key with a third of all rows is split
    over its buckets; choose ``width`` so that a bucket of it fits a task.
    """
    names = [f"_k{i}" for i in range(len(keys))]

    def side(df: DataFrame, time: str) -> list[Column]:
        known = F.lit(True)
        for c in [*keys, time]:
            known = known & F.col(c).isNotNull()
        nowhere = F.pmod(F.xxhash64(*df.columns), F.lit(_SALTS))
        bucket = F.when(known, F.floor(as_number(df, time) / F.lit(width))).otherwise(nowhere)
        return [*[F.col(c).alias(n) for c, n in zip(keys, names)], bucket.cast("long").alias("_bucket"),
                F.col(time).alias("_t"), known.alias("_known")]

    payload = F.struct(F.col(right_time).alias("at"), *[F.col(c).alias(f"tie{i}") for i, c in enumerate(tie)],
                       *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)]).alias("_new")
    asked = left.select(*side(left, left_time), F.struct(*left.columns).alias("_row"), F.lit(0 if strict else 1).alias("_turn"))
    given = right.select(*side(right, right_time), payload, F.lit(1 if strict else 0).alias("_turn")).where("_known")
    both = asked.unionByName(given, allowMissingColumns=True)

    unit = [*names, "_bucket"]
    upto = (Window.partitionBy(*unit).orderBy("_t", "_turn", "_new")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = both.withColumn("_found", F.last("_new", ignorenulls=True).over(upto)).where("_row IS NOT NULL")

    newest = both.where("_known").groupBy(*unit).agg(F.max("_new").alias("_new"))
    before = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select(*unit, F.last("_new", ignorenulls=True).over(before).alias("_carried")).where("_carried IS NOT NULL")

    found = F.when(F.col("_known"), F.coalesce("_found", "_carried"))
    return (inside.join(carried, unit, "left").withColumn("_best", found)
            .select("_row.*", *[F.col(f"_best.v{i}").alias(out) for i, out in enumerate(columns.values())]))
