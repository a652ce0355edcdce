"""Five-number summary with box-plot whiskers, computed on the cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def box_summary(df: DataFrame, by: Sequence[str], value: str, whis: float = 1.5) -> DataFrame:
    """Per group: n, min, q1, median, q3, max, whisker_lo, whisker_hi, outliers.

    Quartiles are exact with linear interpolation (``percentile``), the
    definition box plots use.  Whiskers reach the most extreme value inside
    ``[q1 - whis*IQR, q3 + whis*IQR]`` (falling back to the quartile when no
    value lies between the fence and the quartile); ``outliers`` counts values
    beyond the whiskers.  NULL values are ignored; a group with only NULLs
    has ``n = 0`` and NULL statistics.

    One pass over ``df``: it is first reduced to a histogram, one row per
    (group, distinct value) with its count (partial aggregation, so a hot
    group is collapsed map-side).  Everything else -- weighted percentiles,
    fences, whiskers, outlier counts -- is window aggregates over the
    histogram rows of a group, so a task holds one group's *distinct values*,
    never its rows.  Meant for measures with a bounded set of values (innings
    totals, counts); a continuous measure would keep one histogram row per
    input row.
    """
    by = list(by)
    v, c = F.col(value), F.col("_c")
    hist = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    g = Window.partitionBy(*by)
    known = v.isNotNull()
    q = F.percentile(v, [0.25, 0.5, 0.75], c)
    h = hist.select(*by, v.alias("_v"), c,
                    F.sum(F.when(known, c).otherwise(0)).over(g).alias("n"),
                    F.min(v).over(g).alias("min"), F.max(v).over(g).alias("max"),
                    q.over(g).alias("_q"))
    q1, q3 = F.col("_q")[0], F.col("_q")[2]
    h = h.select("*", (q1 - whis * (q3 - q1)).alias("_lo"), (q3 + whis * (q3 - q1)).alias("_hi"))
    x = F.col("_v")
    stats = [F.col("n"), F.col("min"), q1.alias("q1"), F.col("_q")[1].alias("median"), q3.alias("q3"),
             F.col("max")]
    agg = (h.groupBy(*by, *stats)
           .agg(F.min(F.when(x >= F.col("_lo"), x)).alias("_in_lo"),
                F.max(F.when(x <= F.col("_hi"), x)).alias("_in_hi"),
                F.sum(F.when((x < F.col("_lo")) | (x > F.col("_hi")), c).otherwise(0)).alias("outliers")))
    lo = F.when(F.col("_in_lo").isNull() | (F.col("_in_lo") > F.col("q1")), F.col("q1")) \
        .otherwise(F.col("_in_lo").cast("double"))
    hi = F.when(F.col("_in_hi").isNull() | (F.col("_in_hi") < F.col("q3")), F.col("q3")) \
        .otherwise(F.col("_in_hi").cast("double"))
    return agg.select(*by, "n", "min", "q1", "median", "q3", "max",
                      lo.alias("whisker_lo"), hi.alias("whisker_hi"), "outliers")
