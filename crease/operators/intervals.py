"""Interval join: points with the intervals that hold them, as an equi-join."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import as_number

FANOUT = 16        # a bin holds so many bins of the next finer width
SALT = 16          # coarse bins are cut into so many parts
SALTED_FROM = 2    # from bins of FANOUT ** 2 units on


def _cover(lo: Column, hi: Column, levels: int) -> Column:
    """Bins (level, bin) that cover the units lo..hi exactly, each unit once:
    at every width the bins inside the interval that no wider one covers, so at
    most ``2 * (FANOUT - 1)`` a width."""
    parts = []
    none = F.array().cast("array<struct<level:int,bin:bigint>>")

    def inside(level: int) -> tuple[Column, Column]:      # first and last bin that lie inside
        wide = F.lit(FANOUT ** level).cast("long")
        return (-F.floor(-lo / wide)).cast("long"), (F.floor((hi + 1) / wide) - 1).cast("long")

    def bins(level: int, a: Column, b: Column) -> Column:
        run = F.transform(F.sequence(a, F.greatest(a, b)), lambda i: F.struct(F.lit(level).alias("level"), i.alias("bin")))
        return F.when(a <= b, run).otherwise(none)

    for level in range(levels):
        a, b = inside(level)
        if level + 1 == levels:
            parts.append(bins(level, a, b))
            continue
        c, d = inside(level + 1)
        rest = F.concat(bins(level, a, c * FANOUT - 1), bins(level, (d + 1) * FANOUT, b))
        parts.append(F.when(c > d, bins(level, a, b)).otherwise(rest))
    return F.concat(*parts)


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str,
                  levels: int, unit: float = 1.0) -> DataFrame:
    """Every pair of a point and an interval with equal ``keys`` and ``lo <= at
    <= hi``: the columns of both (``keys`` once).  Other column names must
    differ.  NULL keys, points or bounds join nothing, nor do intervals with
    ``lo > hi``; repeated rows pair up each.

    Plan: the line is cut into units (``unit``: days of a date, seconds of a
    timestamp, else the column's own unit) and into bins of 16, 256, ... units,
    ``levels`` widths in all.  An interval becomes the few bins that cover it,
    a point its bin at each width, and the two meet on (keys, width, bin): a hash
    join of equal keys, each pair once, checked on the exact bounds at the end
    (units at an interval's ends are covered whole).  So an interval over the whole
    table costs as few rows as a short one, and the points of a key spread over
    the finer bins.  A wide bin can hold many points: from 256 units on, bins are
    cut into ``SALT`` parts by a hash of the point, and the interval's bin is sent
    to each.  ``levels`` widths should span the line (16**levels units).
    """
    if levels < 1:
        raise ValueError(f"levels is 1 or more, not {levels}")
    number = lambda df, c: F.floor(as_number(df, c) / F.lit(unit)).cast("long")
    names = [f"_k{i}" for i in range(len(keys))]
    key = [F.col(c).alias(n) for c, n in zip(keys, names)]
    rest = [c for c in intervals.columns if c not in keys]

    n = number(points, at)
    widths = F.array(*[F.struct(F.lit(level).alias("level"), F.floor(n / F.lit(FANOUT ** level).cast("long")).cast("long").alias("bin"))
                       for level in range(levels)])
    part = lambda whole: F.when(F.col("_b.level") >= SALTED_FROM, whole).otherwise(0)
    dealt = F.pmod(F.xxhash64(*points.columns), F.lit(SALT)).cast("int")
    where_points = (points.where(F.col(at).isNotNull())
                    .select(F.struct(*points.columns).alias("_point"), *key, dealt.alias("_dealt"), F.explode(widths).alias("_b"))
                    .select("_point", *names, "_b.level", "_b.bin", part(F.col("_dealt")).alias("part")))

    covered = (intervals.where(F.col(lo) <= F.col(hi))
               .select(*key, F.struct(*(rest or keys)).alias("_interval"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"),
                       F.explode(_cover(number(intervals, lo), number(intervals, hi), levels)).alias("_b")))
    parts = F.explode(F.when(F.col("_b.level") >= SALTED_FROM, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0))))
    where_intervals = covered.select(*names, "_interval", "_lo", "_hi", "_b.level", "_b.bin", parts.alias("part"))

    met = where_points.join(where_intervals, [*names, "level", "bin", "part"])
    exact = met.where((F.col("_lo") <= F.col(f"_point.{at}")) & (F.col(f"_point.{at}") <= F.col("_hi")))
    return exact.select("_point.*", *[F.col(f"_interval.{c}").alias(c) for c in rest])


def levels_for(units: float) -> int:
    """Widths that span a line of so many units."""
    return max(1, math.ceil(math.log(max(2.0, units), FANOUT)))
