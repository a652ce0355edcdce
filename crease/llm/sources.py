"""Readers and shared-folder tables used by the operators' queries."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from crease.session import checkpoint_dir


def importable(spark: SparkSession) -> None:
    """Let Python workers that share this file system import the package from
    where the driver did; elsewhere the package must be installed or shipped."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """``df`` written once under the shared checkpoint folder and read back.

    Cuts the lineage: a lost executor re-reads the table instead of recomputing
    what led to it.  Each call writes a folder of its own.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary file ``name`` lies (on every executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)
