"""Session helpers.

Library code never creates a session: every plan takes DataFrames, every
``queries()`` entry takes the caller's ``SparkSession``.  ``local_session`` is
for tests, tools and the local bench only.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("crease")
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", "8g"))
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and written intermediates.

    ``spark.checkpoint.dir`` when the cluster names one (read, never changed),
    else the context's checkpoint folder if one was set, else -- in local mode
    only -- a fresh temporary folder registered with ``setCheckpointDir``.  On
    a cluster with neither, it raises instead of using a machine-local folder.
    ``spark.checkpoint.dir`` itself is a core setting Spark does not let a
    running session modify, so it is never written here.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not str(spark.sparkContext.master).startswith("local"):
            raise ValueError("no shared checkpoint folder: set spark.checkpoint.dir (or call "
                             "sparkContext.setCheckpointDir) to a folder every executor can reach")
        d = tempfile.mkdtemp(prefix="crease-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the checkpoint folder, never given out twice: it holds
    the application's id and a random one."""
    return f"{checkpoint_dir(spark)}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours from whatever store it lies in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
