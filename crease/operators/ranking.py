"""Ranks over a whole table, without gathering it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 256


def _bounds(df: DataFrame, column: str, n: int) -> Column:
    """At most n - 1 ascending values that cut the column into parts of about
    equal counts; a scalar subquery, run with the query."""
    steps = F.array(*[F.lit(i / n) for i in range(1, n)])
    cuts = F.percentile_approx(F.col(column), steps, F.lit(20 * n))
    kind = df.schema[column].dataType
    return df.agg(F.array_sort(F.array_distinct(F.coalesce(cuts, F.array().cast(f"array<{kind.simpleString()}>"))))).scalar()


def _below(bounds: Column, value: Column) -> Column:
    """How many of the sorted bounds are below the value."""
    return F.size(F.filter(bounds, lambda b: b < value))


def global_ranks(df: DataFrame, order: str, tie: Sequence[str], tiles: int = 100, descending: bool = False,
                 dense: bool = False, blocks: int = BLOCKS) -> DataFrame:
    """``df`` with ``row_number, rank, percent_rank, cume_dist, ntile`` (and, if
    ``dense``, ``dense_rank``) of the whole table, as SQL's window functions
    without PARTITION BY give them: ordered by ``order`` (a number, date or timestamp; NULLs first, or
    last if ``descending``), rows of equal ``order`` being peers; ``row_number``
    and ``ntile`` go on by ``tie`` (ascending; the first one a number or NULL).
    Rows equal in all of these are numbered in any order.

    Plan: two approximate-quantile aggregates cut ``order`` and ``tie[0]`` into
    ``blocks`` parts of about equal counts.  A value that is itself a cut (so any
    value held by more than two parts) is a block of its own, cut further by
    ``tie[0]``; so a value with a third of all rows spreads over tasks, and no
    block depends on how often values repeat.  Rows are shuffled once, by block, and
    ranked there by windows; the row counts of the blocks (partial aggregation, one
    row a block) are added up in one small array and joined back.  Only the number
    of blocks bounds what one task adds up, whatever the size of the table.
    ``dense`` also counts each block's distinct values, which shuffles these.
    """
    value, first_tie = F.col("_v"), F.col("_t")
    plain = df.select(F.struct(*df.columns).alias("_row"), F.col(order).alias("_v"), F.col(tie[0]).alias("_t"),
                      *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tie)])
    cuts = _bounds(plain.select("_v"), "_v", blocks)
    fine = _bounds(plain.select("_t"), "_t", blocks)
    cut = plain.withColumns({"_cuts": cuts, "_fine": fine})
    alone = F.coalesce(F.array_contains("_cuts", value), F.lit(True))                # NULL: one value too
    place = F.when(value.isNull(), -1).otherwise(2 * _below(F.col("_cuts"), value) + alone.cast("int"))
    dealt = (cut.withColumn("_alone", alone)
             .withColumn("_block", (-place if descending else place).cast("long"))
             .withColumn("_part", F.when(F.col("_alone"), F.coalesce(_below(F.col("_fine"), first_tie), F.lit(-1))).otherwise(0).cast("long"))
             .drop("_cuts", "_fine"))

    sizes = dealt.groupBy("_block", "_part").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("_v") if dense else F.lit(0).cast("long")).alias("d"),
                                                   F.max("_alone").alias("alone"))
    inside = Window.partitionBy("_block").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select("_block", "_part", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("_before"))
    # an array of a row a block, in order; each gets the sums before it
    values = F.greatest(F.max("d"), F.max("alone").cast("long")).alias("d")
    listed = sizes.groupBy("_block").agg(F.sum("n").alias("n"), values).agg(
        F.array_sort(F.collect_list(F.struct("_block", "n", "d"))).alias("s"))
    zero = F.lit(0).cast("long")
    entries = F.array().cast("array<struct<_block:bigint,_start:bigint,_values:bigint,_in_block:bigint>>")

    def add(acc: Column, x: Column) -> Column:
        entry = F.struct(x["_block"].alias("_block"), acc["rows"].alias("_start"), acc["values"].alias("_values"), x["n"].alias("_in_block"))
        return F.struct((acc["rows"] + x["n"]).alias("rows"), (acc["values"] + x["d"]).alias("values"),
                        F.concat(acc["out"], F.array(entry)).alias("out"))

    summed = listed.select(F.aggregate("s", F.struct(zero.alias("rows"), zero.alias("values"), entries.alias("out")), add).alias("x"))
    starts = summed.select(F.col("x.rows").alias("_total"), F.inline("x.out"))
    offsets = starts.join(parts, "_block").withColumn("_rows", F.col("_start") + F.col("_before"))

    by_value = F.desc_nulls_last("_v") if descending else F.asc_nulls_first("_v")
    unit = Window.partitionBy("_block", "_part")
    peers = unit.orderBy(by_value)
    each = unit.orderBy(by_value, *[F.asc_nulls_first(f"_t{i}") for i in range(len(tie))])
    upto = peers.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = dealt.withColumns({"_i": F.row_number().over(each), "_r": F.rank().over(peers), "_d": F.dense_rank().over(peers),
                                "_upto": F.count(F.lit(1)).over(upto)})
    long = lambda c: c.cast("long")
    row, total = long(F.col("_rows") + F.col("_i")), F.col("_total")
    rank = long(F.when(F.col("_alone"), F.col("_start") + 1).otherwise(F.col("_start") + F.col("_r")))
    last = F.when(F.col("_alone"), F.col("_start") + F.col("_in_block")).otherwise(F.col("_start") + F.col("_upto"))
    small, more = F.floor(total / F.lit(tiles)), F.pmod(total, F.lit(tiles))
    ahead = more * (small + 1)
    tile = F.when(row <= ahead, F.floor((row - 1) / (small + 1)) + 1).otherwise(
        more + F.floor(F.try_divide(row - 1 - ahead, small)) + 1)
    by_values = [long(F.col("_values") + F.col("_d")).alias("dense_rank")] if dense else []
    return (ranked.join(offsets, ["_block", "_part"])
            .select("_row.*", row.alias("row_number"), rank.alias("rank"), *by_values,
                    F.coalesce(F.try_divide((rank - 1).cast("double"), (total - 1).cast("double")), F.lit(0.0)).alias("percent_rank"),
                    (last.cast("double") / total).alias("cume_dist"), long(tile).alias("ntile")))
