"""Run many reports in one go and write each result as parquet.

Every report is a separate job writing its own output folder; nothing is
collected to the driver.  With ``stage=True`` (worth it where the source is
slow to parse, e.g. CSV) the deliveries frame is first written once as a
parquet table in a folder of this run's own under the cluster's checkpoint
folder, every report reads that table, and the folder is deleted at the end.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from ..session import remove_path, scratch_path
from ..sources.adapter import Tables
from .catalog import QUERIES


def stage_tables(spark: SparkSession, tables: Tables, path: str, files: int | None = None) -> Tables:
    """Write ``tables.deliveries`` once to the new folder ``path``; return readers.

    ``files`` re-splits the written table (a round-robin exchange) when the
    source arrives in fewer, larger pieces than the cluster has cores.
    """
    d = tables.deliveries if files is None else tables.deliveries.repartition(files)
    d.write.mode("errorifexists").parquet(path)
    return Tables(spark.read.schema(d.schema).parquet(path), tables.matches)


def run_report(spark: SparkSession, tables: Tables, out_dir: str, names: Iterable[str] | None = None,
               *, stage: bool = False, files: int | None = None, mode: str = "overwrite") -> dict[str, str]:
    """Write each named report to ``out_dir/<name>``; returns name -> path."""
    names = list(names or QUERIES)
    unknown = [n for n in names if n not in QUERIES]
    if unknown:
        raise KeyError(f"unknown reports: {unknown}")
    staged = scratch_path(spark, "staged-deliveries") if stage else None
    out = {}
    try:
        if staged:
            tables = stage_tables(spark, tables, staged, files)
        for n in names:
            path = f"{out_dir.rstrip('/')}/{n}"
            QUERIES[n](tables).write.mode(mode).parquet(path)
            out[n] = path
    finally:
        if staged:
            remove_path(spark, staged)
    return out
