"""Mergeable summaries: distinct sets and quantiles kept as one small column.

A table of sketches, one row per cell of the finest grouping, answers any
coarser grouping later by merging its rows; the data are not read again.

Distinct sets are theta sketches of ``2**lg`` entries: exact up to that many
values, beyond it a relative standard error of ``distinct_error(lg)``; an
intersection's or difference's error is that share of the *union*.  Quantiles
are KLL sketches: the rank of a returned value is off by at most about
``rank_error(k)`` of the group (99 of 100 times), and exact while a group has
fewer than ``k`` values.  Either takes constant memory per group, in tasks too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_ENTRIES = 12
KLL_K = 4096
GRID = 500


def distinct_error(lg: int = LG_ENTRIES) -> float:
    """Relative standard error of a distinct count beyond ``2**lg`` values."""
    return 1 / math.sqrt(2 ** lg - 1)


def rank_error(k: int = KLL_K) -> float:
    """Normalised rank error of a quantile, at 99 of 100."""
    return 2.296 / k ** 0.9021


# ---------------------------------------------------------------- distinct sets
def distinct_sketches(df: DataFrame, by: Sequence[str], value: Column, lg: int = LG_ENTRIES) -> DataFrame:
    """``by`` and ``sketch``: the distinct non-NULL values of each group."""
    return df.groupBy(*by).agg(F.theta_sketch_agg(value, lg).alias("sketch"))


def distinct_rollups(sketches: DataFrame, by: Sequence[str], sets: Sequence[Sequence[str]], name: str,
                     lg: int = LG_ENTRIES) -> DataFrame:
    """Distinct values of every grouping in ``sets`` (subsets of ``by``), merged
    from the rows of ``sketches``; a dimension that is summed over is NULL, and
    ``level`` has one bit per dimension (first: highest) that says so."""
    level = F.grouping_id().cast("long").alias("level")
    union = sketches.groupingSets([list(s) for s in sets], *by).agg(level, F.theta_union_agg("sketch", lg).alias("_s"))
    return union.select(*by, "level", F.theta_sketch_estimate("_s").alias(name))


def distinct_overlap(left: Column, right: Column, lg: int = LG_ENTRIES) -> dict[str, Column]:
    """Counts of two sketches' union, intersection and left-only values."""
    estimate = F.theta_sketch_estimate
    return {"either": estimate(F.theta_union(left, right, lg)), "both": estimate(F.theta_intersection(left, right)),
            "left_only": estimate(F.theta_difference(left, right))}


# -------------------------------------------------------------------- quantiles
def quantile_sketches(df: DataFrame, by: Sequence[str], value: str, k: int = KLL_K) -> DataFrame:
    """``by``, ``sketch``, ``n``, ``min``, ``max`` of the non-NULL values of each group."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(v, k).alias("sketch"), F.count(v).alias("n"),
                               F.min(v).alias("min"), F.max(v).alias("max"))


def merge_quantiles(sketches: DataFrame, by: Sequence[str], k: int = KLL_K) -> DataFrame:
    """The rows of a coarser grouping."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n"),
                                     F.min("min").alias("min"), F.max("max").alias("max"))


def box_from_sketches(sketches: DataFrame, by: Sequence[str], whis: float = 1.5, grid: int = GRID) -> DataFrame:
    """Box statistics per row of ``quantile_sketches``: ``n, min, q1, median, q3,
    max, whisker_lo, whisker_hi, outliers``.

    Quartiles are values of the group (the smallest whose share at or below it
    is a quarter, a half, three quarters).  Whiskers reach the outermost values
    inside the fences ``q1 - whis * IQR`` and ``q3 + whis * IQR``; a value on the
    lower fence counts as outside.  A group whose values all lie inside has its
    ``min`` and ``max`` as whiskers; else they and ``outliers`` are read off
    ``grid`` + 1 evenly spaced quantiles.  ``n``, ``min`` and ``max`` are exact,
    the quartiles within ``rank_error(k)`` of their rank, whiskers and the
    outliers' share within that and ``1 / grid``.  Groups without values have NULL
    statistics.
    """
    at = lambda r: F.kll_sketch_get_quantile_double("sketch", F.lit(r))
    steps = F.array(*[F.lit(i / grid) for i in range(grid + 1)])
    known = sketches.where("n > 0").select(*by, "n", "min", "max", at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"),
                                           F.kll_sketch_get_quantile_double("sketch", steps).alias("_grid"))
    step = F.lit(whis) * (F.col("q3") - F.col("q1"))
    fenced = known.withColumns({"_lo": F.col("q1") - step, "_hi": F.col("q3") + step})
    inside_lo, inside_hi = F.col("_lo") < F.col("min"), F.col("_hi") >= F.col("max")
    low, high = F.filter("_grid", lambda x: x > F.col("_lo")), F.filter("_grid", lambda x: x <= F.col("_hi"))
    beyond = lambda held, inside: F.when(inside, 0).otherwise(grid + 1 - F.size(held))
    outliers = F.round((beyond(low, inside_lo) + beyond(high, inside_hi)) * F.col("n") / (grid + 1)).cast("long")
    stats = fenced.select(*by, "n", "min", "q1", "median", "q3", "max",
                          F.when(inside_lo, F.col("min")).otherwise(F.least(F.array_min(low), F.col("q1"))).alias("whisker_lo"),
                          F.when(inside_hi, F.col("max")).otherwise(F.greatest(F.array_max(high), F.col("q3"))).alias("whisker_hi"),
                          outliers.alias("outliers"))
    empty = sketches.where("n = 0").select(*by, "n")
    return stats.unionByName(empty, allowMissingColumns=True)
