"""Column expressions and size-checked joins that several operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else (``lower`` would change É too)."""
    return F.translate(text, _UPPER, _UPPER.lower())


def broadcast_upto(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else without
    one, so that Spark shuffles.  ``df`` should be cheap to count (a stored table)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def carried_names(names: Iterable[str], own: Iterable[str]) -> dict[str, str]:
    """Result name of each carried column: its own, or with ``_in`` added (again if
    need be) where the result has a column of that name (Spark compares names
    without case)."""
    names = list(dict.fromkeys(names))
    taken, out = {n.lower() for n in [*own, *names]}, {}
    own = {n.lower() for n in own}
    for name in names:
        new = name
        while new.lower() in own or (new != name and new.lower() in taken):
            new += "_in"
        taken.add(new.lower())
        out[name] = new
    return out
