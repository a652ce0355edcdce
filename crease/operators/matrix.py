"""Long-form -> matrix (wide) reshaping done on the cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import in_order


def to_matrix(long: DataFrame, index: str, columns: str, value: str,
              column_values: Sequence) -> DataFrame:
    """One row per ``index`` value, in ascending order of it, one column per
    entry of ``column_values``.

    Semantics of a mean pivot table: rows with a NULL index or column key are
    dropped, NULL values are skipped by the mean, and a row whose cells are all
    NULL is dropped.  The column list is the caller's, so the output schema
    does not depend on the data and Spark needs no extra job to find the
    distinct keys; a row whose column key is not on the list stops the query
    with an error that names the key -- nothing is left out silently.  The
    input is an aggregate (one row per cell), so the pivot's own shuffle and the
    final sort are small.
    """
    known = F.col(columns).isin(*column_values)
    off_list = F.raise_error(F.concat(F.lit(f"{columns} is not a column of the matrix: "),
                                      F.col(columns).cast("string"))).cast("boolean")
    names = [str(v) for v in column_values]
    wide = (long.where(F.col(index).isNotNull() & F.col(columns).isNotNull())
            .where(F.when(known, F.lit(True)).otherwise(off_list))
            .groupBy(index).pivot(columns, list(column_values)).agg(F.avg(value)))
    any_cell = F.lit(False)
    for n in names:
        any_cell = any_cell | F.col(f"`{n}`").isNotNull()
    return in_order(wide.where(any_cell), F.asc(index))
