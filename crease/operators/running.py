"""Running totals that do not gather a whole partition key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _not_null(df: DataFrame, name: str) -> Column:
    """``name`` with NULL replaced; numbers stay numbers, other types become text."""
    numeric = df.schema[name].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")
    return F.coalesce(F.col(name), F.lit(0)) if numeric else F.coalesce(F.col(name).cast("string"), F.lit(""))


def running_total(df: DataFrame, partition: Sequence[str], order: Sequence[str],
                  value: str, out: str, skew_safe: bool = True) -> DataFrame:
    """Add ``out`` = sum of ``value`` over the partition up to the current row.

    Frame: ``RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW`` ordered by
    ``order`` ascending (NULLS FIRST), i.e. rows tied on ``order`` (peers) all
    get the total including every peer.

    Plan: the unit of work is ``partition + order[0]`` (one over of an innings),
    not the partition.  (1) Sum ``value`` per unit, with partial aggregation:
    one row per over.  (2) A running sum of those rows gives each unit the total
    before it; that window holds one row per over of an innings, never its
    balls.  (3) The rows meet their unit's offset, and a RANGE window inside the
    unit adds the rest.  Rows are shuffled once, by unit: the join and the last
    window share that shuffle, and the three exchanges of (1)-(3) carry unit
    sums only.  A hot innings spreads over its overs; a single over (all rows
    with equal ``partition`` and ``order[0]``) is the smallest piece.

    NULL keys are values of their own: keys are compared as (replaced value,
    NULL flags), which are plain columns, so no key expression is repeated in
    the joins.  ``skew_safe=False`` is the single-pass alternative: one window
    over the rows of a whole partition key.
    """
    ordered = [F.col(c).asc_nulls_first() for c in order]
    if not skew_safe:
        w = (Window.partitionBy(*partition).orderBy(*ordered)
             .rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return df.withColumn(out, F.sum(value).over(w))
    unit = [*partition, order[0]]
    names = [f"_u{i}" for i in range(len(unit))]
    keyed = df.select("*", *[_not_null(df, c).alias(n) for c, n in zip(unit, names)],
                      sum((F.col(c).isNull().cast("int") * (1 << i) for i, c in enumerate(unit)), F.lit(0)).alias("_uf"))
    names = [*names, "_uf"]
    sums = keyed.groupBy(*names, *unit).agg(F.sum(value).alias("_s"))
    flags = F.col("_uf").bitwiseAND((1 << len(partition)) - 1)
    before = (Window.partitionBy(*names[:len(partition)], flags).orderBy(F.col(order[0]).asc_nulls_first())
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*names, F.sum("_s").over(before).alias("_before"))
    inside = Window.partitionBy(*names)
    if len(order) > 1:
        inside = inside.orderBy(*ordered[1:]).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    within = F.sum(value).over(inside)
    total = F.when(F.col("_before").isNull(), within).otherwise(F.col("_before") + F.coalesce(within, F.lit(0)))
    return keyed.join(offsets, names).withColumn(out, total).select(*df.columns, out)
