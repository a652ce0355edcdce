"""Cut a table into blocks, each small enough for one task.

Blocks are sized by the bytes of text in the whole table, so their number grows
with the input and their size does not.  ``ordered_blocks`` cuts by
ranges of ids; where order does not matter, ``hashed_block`` deals rows out by
hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import broadcast_upto
from .sources import stored

BLOCK_BYTES = 8 << 20
LEAST_BYTES = 1 << 20
ROW_BYTES = 32           # what a row without text weighs
UNITS = 64               # weight of a block in the histogram of ids
GROUP = 64               # blocks whose cuts are one row
GROUP_ROWS = 4096        # such rows that may be broadcast (some KB each)
RANKS = 1024             # ranks of a group: at most 64 cuts and two for each of 64 hot ids
SHIFT = 1 << 20          # parts of a rank


def count_blocks(df: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of ``block_bytes``; of a small table, as many smaller ones (down to
    ``LEAST_BYTES``) as there are shuffle partitions to work on them."""
    return _count(df.sparkSession, df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0, block_bytes)


def _count(spark: SparkSession, size: int, block_bytes: int) -> int:
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(size / block_bytes), min(partitions, math.ceil(size / LEAST_BYTES)))


def hashed_block(id_col: str, text_col: str, blocks: int) -> Column:
    """A block by hash of id and text: null or repeated ids spread like any others."""
    return F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int")


def ordered_blocks(df: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(``df`` with ``_block``, about how many blocks).  ``_block`` (long) is a rank (``rank_of_block``), then a part.

    Every id of a rank is larger than every id of the ranks before it, and a rank
    is one block of about ``block_bytes`` of text -- unless a single id has more:
    then the id is a rank of its own, dealt into parts by hash.  Rows without an
    id are rank -1, dealt into parts alike.  Expects no columns named like its own
    (``_block``, ``_group``, ``_cuts``).

    Plan.  A row stands for its bytes in units of ``block_bytes / UNITS`` (the
    rest is rounded up or down at random), so the histogram of ids has a bounded
    number of rows a block, and running sums over it cut the ranks.  The cuts are
    a written table with one row for each ``GROUP`` blocks; the driver sees the
    first id of each such group.
    """
    spark, weight = df.sparkSession, F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_BYTES
    size = df.agg(F.sum(weight)).first()[0] or 0
    blocks = _count(spark, size, block_bytes)
    if blocks == 1:
        return df.withColumn("_block", F.when(F.col(id_col).isNull(), -SHIFT).otherwise(0).cast("long")), 1
    unit = size / (blocks * UNITS)
    weighed = (df.select(F.col(id_col).cast("long").alias("id"), F.floor(weight / unit + F.rand(1)).alias("units"))
               .where("units > 0").groupBy("id").agg(F.sum("units").alias("units")))
    cells = stored(weighed.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "cells")
    null_parts = _parts(cells.where("id IS NULL").agg(F.sum("units")).first()[0] or 0)

    # running units: inside a part, then over the parts before it (one row a part)
    known = cells.where("id IS NOT NULL")
    parts = known.groupBy("part").agg(F.sum("units").alias("units")).orderBy("part").collect()
    before = dict(zip((r.part for r in parts), np.cumsum([0, *(r.units for r in parts)]).tolist()))
    offsets = spark.createDataFrame([*before.items()], "part int, before long")
    inside = Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    placed = (known.withColumn("upto", F.coalesce(F.sum("units").over(inside), F.lit(0)))
              .join(F.broadcast(offsets), "part")
              .withColumn("place", F.floor((F.col("before") + F.col("upto")) / UNITS)))
    hot = F.col("units") > UNITS
    plain = placed.where(~hot).groupBy("place").agg(F.min("id").alias("cut")).select("place", "cut", F.lit(1).alias("parts"))
    alone = placed.where(hot).select("place", F.explode(F.array(
        F.struct(F.col("id").alias("cut"), F.ceil(F.col("units") / UNITS).cast("int").alias("parts")),
        F.struct(F.try_add("id", F.lit(1)).alias("cut"), F.lit(1).alias("parts")))).alias("c")).select("place", "c.*")
    cuts = (plain.union(alone).where("cut IS NOT NULL").groupBy("cut").agg(F.max("parts").alias("parts"), F.min("place").alias("place"))
            .groupBy(F.floor(F.col("place") / GROUP).cast("int").alias("_group"))
            .agg(F.sort_array(F.collect_list(F.struct("cut", "parts"))).alias("_cuts")))
    cuts = stored(cuts, "cuts")
    first = {r._group: r.cut for r in cuts.select("_group", F.col("_cuts")[0]["cut"].alias("cut")).collect()}
    names = np.array(sorted(first), np.int32)
    group = _group_of(np.array([first[g] for g in sorted(first)], np.int64), names)

    dealt = df.withColumn("_group", group(F.col(id_col).cast("long"))).join(broadcast_upto(cuts, GROUP_ROWS), "_group", "left")
    at = F.size(F.filter("_cuts", lambda c: c["cut"] <= F.col(id_col)))      # 0: below the first cut of all
    rank = F.col("_group").cast("long") * RANKS + at
    part = lambda n: F.pmod(F.xxhash64(id_col, text_col), n.cast("long"))
    block = (F.when(F.col(id_col).isNull(), -SHIFT + part(F.lit(null_parts)))
             .when(F.col("_cuts").isNull(), F.lit(0))
             .otherwise(rank * SHIFT + part(F.coalesce(F.get("_cuts", at - 1)["parts"], F.lit(1)))))
    return dealt.withColumn("_block", block.cast("long")).drop("_group", "_cuts"), blocks


def rank_of_block(block):
    """The rank of a block (a number or an array)."""
    return block // SHIFT


def _parts(units: int) -> int:
    return max(1, math.ceil(units / UNITS))


def _group_of(firsts: np.ndarray, names: np.ndarray):
    @F.pandas_udf("int")
    def group(ids: pd.Series) -> pd.Series:
        values = ids.fillna(0).to_numpy(np.int64)
        at = np.maximum(np.searchsorted(firsts, values, "right") - 1, 0)
        return pd.Series(names[at] if len(names) else np.zeros(len(values), np.int32)).where(ids.notna().to_numpy(), -1)

    return group
