"""Fact -> dimension aggregation: pre-aggregate, join, merge.

``rollup_by_dimension`` groups fact rows by keys of their own plus attributes
of the dimension row they join to.  There is one plan whatever the sizes: the
fact side is aggregated per (dimension key, own keys) first -- map-side partial
aggregation collapses a hot dimension key inside each task -- the reduced rows
join the dimension without a hint, and the merged sums are grouped again.
Spark sizes the join; with adaptive execution it broadcasts a side that turns
out small at run time and splits a skewed one otherwise.  Building the frame
runs no job.  Measures must merge by summation (sum, count).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup_by_dimension(fact: DataFrame, fact_key: str, dim: DataFrame, dim_key: str,
                        attrs: Sequence[Column], keys: Sequence[str],
                        measures: dict[str, Column]) -> DataFrame:
    """``fact ⋈ dim`` grouped by ``keys + attrs``, with summable ``measures``.

    ``attrs`` are named Columns over ``dim`` (e.g. ``F.col("season")``);
    ``measures`` maps output names to aggregate Columns over ``fact`` whose
    partial results add up (``sum``, ``count``).  Inner-join semantics: fact
    rows without a dimension row are dropped (``sources.files.key_nulls``
    counts those whose key is NULL).
    """
    side = dim.select(F.col(dim_key).alias("_dim_key"), *attrs)
    names = side.columns[1:]
    pre_keys = [fact_key] + [k for k in keys if k != fact_key]
    partial = fact.groupBy(*pre_keys).agg(*[m.alias(f"_p_{n}") for n, m in measures.items()])
    joined = partial.join(side, partial[fact_key] == side["_dim_key"], "inner")
    return joined.groupBy(*keys, *names).agg(*[F.sum(f"_p_{n}").alias(n) for n in measures])
