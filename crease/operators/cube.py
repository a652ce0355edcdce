"""All roll-ups of some dimensions, each computed from a smaller one."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lattice(dims: Mapping[str, int]) -> dict[tuple[str, ...], tuple[str, ...] | None]:
    """Every subset of the dimensions with the computed subset it is summed up
    from: of the supersets with one dimension more, the one with the fewest
    cells (product of the dimensions' sizes; of equals, the first).  The full
    set has none.  Larger subsets come first."""
    names = list(dims)

    def cells(subset):
        return reduce(lambda n, d: n * dims[d], subset, 1)

    found = {}
    for size in range(len(names), -1, -1):
        for subset in itertools.combinations(names, size):
            parents = [tuple(d for d in names if d in subset or d == extra) for extra in names if extra not in subset]
            found[subset] = min(parents, key=cells, default=None)
    return found


def cube(df: DataFrame, dims: Mapping[str, int], measures: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row per cell of every subset of ``dims`` (name -> about how many
    values): the dimensions (NULL where summed over), ``level`` (one bit per
    dimension, the first highest, set where summed over, which tells a summed
    dimension from a NULL value) and ``measures``.

    ``measures``: name -> (function, column), function one of 'sum', 'count',
    'min', 'max', which combine.  The grand total is there for an empty table too.

    Plan: the rows are aggregated once, to the cells of all dimensions; every
    coarser cuboid sums up the cells of its smallest parent (``lattice``), so
    the rows are never expanded, as ``GROUP BY CUBE`` would do 2**d times.  All
    branches of the union read the same shuffles (``ReusedExchange``).  The
    sizes steer which parent is used, never what is computed.
    """
    first = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    names = list(dims)
    again = [merge[fn](name).alias(name) for name, (fn, _) in measures.items()]
    cuboids: dict[tuple[str, ...], DataFrame] = {}
    for subset, parent in lattice(dims).items():
        if parent is None:
            cuboids[subset] = df.groupBy(*subset).agg(*[first[fn](c).alias(name) for name, (fn, c) in measures.items()])
        else:
            cuboids[subset] = cuboids[parent].groupBy(*subset).agg(*again)
    zero = {name: F.coalesce(name, F.lit(0)).cast("long").alias(name) for name, (fn, _) in measures.items() if fn == "count"}

    def levelled(subset: tuple[str, ...]) -> DataFrame:
        level = sum(1 << len(names) - 1 - i for i, d in enumerate(names) if d not in subset)
        here = [F.col(d) if d in subset else F.lit(None).cast(df.schema[d].dataType).alias(d) for d in names]
        return cuboids[subset].select(*here, F.lit(level).cast("long").alias("level"), *[zero.get(m, F.col(m)) for m in measures])

    return reduce(DataFrame.unionByName, map(levelled, cuboids))
