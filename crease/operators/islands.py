"""Gaps and islands: maximal runs of rows that belong together, in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, partition: Sequence[str], block: str, order: Sequence[str], measures: dict[str, Column],
            state: Sequence[str] = (), ends: Column | None = None) -> DataFrame:
    """One row per island: ``partition``, ``state`` and ``measures``.

    Rows of a partition (NULLs form partitions like values) are taken by
    ``block``, then ``order`` (ascending, NULLs first).  A row opens a new island
    if its ``state`` differs from the row's before (NULL equals NULL), or if the
    row before satisfies ``ends`` (a row that closes its island; NULL is false).
    Rows equal in ``block`` and ``order`` must be alike.

    ``measures`` names combinable aggregates of an island's rows: ``F.sum``,
    ``F.min``, ``F.max`` or ``F.count`` of an expression, given as (function,
    expression): function is 'sum', 'min', 'max' or 'count'.

    Plan: the unit of work is a block (say, an over) of a partition, not the
    partition.  A window inside the block finds its islands, and they are
    aggregated there: rows are shuffled once.  Only a block's first and last
    island can go on in a neighbour; those two rows a block are gathered by
    partition, chained and merged, all others are final.  Both branches read the
    same shuffle.  A partition with a third of all rows spreads over its blocks.
    """
    ends = F.coalesce(ends, F.lit(False)) if ends is not None else F.lit(False)
    states = [F.col(f"_s{i}") for i in range(len(state))]
    values = {name: F.lit(1) if fn == "count" and value is None else value for name, (fn, value) in measures.items()}
    rows = df.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(partition)], F.col(block).alias("_b"),
                     *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                     *[F.col(c).alias(f"_s{i}") for i, c in enumerate(state)], ends.alias("_ends"),
                     *[v.alias(f"_m{i}") for i, v in enumerate(values.values())])
    parts = [f"_p{i}" for i in range(len(partition))]
    unit = [*parts, "_b"]
    in_order = [F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))]
    inside = Window.partitionBy(*unit).orderBy(*(in_order or [F.lit(0)]))

    def differs(w) -> Column:
        out = F.lag("_ends", 1, False).over(w)
        for s in states:
            out = out | ~s.eqNullSafe(F.lag(s).over(w))
        return out

    first_row = F.row_number().over(inside) == 1
    opened = rows.withColumn("_opens", F.when(first_row, 0).otherwise(differs(inside).cast("int")))
    numbered = opened.withColumn("_n", F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    combine = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    local = numbered.groupBy(*unit, "_n").agg(
        *[F.first(s).alias(f"_s{i}") for i, s in enumerate(states)], F.max("_ends").alias("_ends"),
        *[combine[fn](f"_m{i}").alias(f"_m{i}") for i, (fn, _) in enumerate(measures.values())])
    local = local.withColumn("_last", F.max("_n").over(Window.partitionBy(*unit)))

    merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    columns = [*parts, *[f"_s{i}" for i in range(len(state))], *[f"_m{i}" for i in range(len(measures))]]
    closed = local.where("_n > 0 AND _n < _last").select(*columns)
    edge = Window.partitionBy(*parts).orderBy(F.col("_b").asc_nulls_first(), "_n")
    open_ = local.where("_n = 0 OR _n = _last")
    goes_on = (F.col("_n") == 0) & ~differs(edge) & (F.row_number().over(edge) > 1)
    chained = (open_.withColumn("_opens", (~goes_on).cast("int"))
               .withColumn("_c", F.sum("_opens").over(edge.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    merged = chained.groupBy(*parts, "_c").agg(
        *[F.first(s).alias(f"_s{i}") for i, s in enumerate(states)],
        *[merge[fn](f"_m{i}").alias(f"_m{i}") for i, (fn, _) in enumerate(measures.values())])
    out = closed.unionByName(merged.select(*columns))
    return out.select(*[F.col(f"_p{i}").alias(c) for i, c in enumerate(partition)],
                      *[F.col(f"_s{i}").alias(c) for i, c in enumerate(state)],
                      *[F.col(f"_m{i}").alias(name) for i, name in enumerate(measures)])
