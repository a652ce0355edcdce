"""Top-k and leader-per-group with explicit, deterministic tie-breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` sorted, for a finished report of a bounded number of rows (teams x
    overs, say): its rows are gathered and sorted by one task.  A global
    ``orderBy`` would first sample the rows for ranges, a job of its own that runs
    the whole plan below it."""
    return df.repartition(1).sortWithinPartitions(*order)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows under ``order``.

    ``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject``: each task
    keeps its own best ``k`` rows and only ``k x tasks`` rows reach the final
    merge, so no full sort and no large shuffle.  Callers pass a total order
    (measure first, then entity keys) so ties at the k-th row are resolved the
    same way in every run and in the SQL oracle.
    """
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows of each ``by`` group under ``order`` (a total order).

    ``row_number() <= k`` plans as a ``WindowGroupLimit`` on each side of the
    exchange: every task forwards at most ``k`` rows per group.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def leaders(df: DataFrame, by: Sequence[str], order: Sequence[Column],
            tie_break: Sequence[Column] = (), *, keep_ties: bool = False,
            rank_col: str = "rank") -> DataFrame:
    """Rows ranked first within each ``by`` group.

    ``keep_ties=False`` uses ``row_number`` over ``order`` then ``tie_break``
    (one row per group, the same one in every run).  ``keep_ties=True`` uses
    ``rank`` over ``order`` alone and keeps all co-leaders.  The ``rank = 1``
    filter becomes a ``WindowGroupLimit`` that runs before and after the
    exchange, so each task ships at most its local leaders per group: a hot
    group is cut down map-side.
    """
    w = Window.partitionBy(*by).orderBy(*order, *(() if keep_ties else tie_break))
    fn = F.rank() if keep_ties else F.row_number()
    return df.withColumn(rank_col, fn.over(w)).where(F.col(rank_col) == 1)
