"""Match exports with one nested record per match, as JSON lines or Parquet.

A record has the columns of ``matches`` and ``innings``: an array of innings,
each with its teams and ``overs``, each of them with ``balls`` in order.
Records are flattened to the two tables every report reads.  Nothing is lost
silently: records that do not parse, or have no match id, are rows of ``bad``, and
``audit`` counts records, matches, innings, overs and balls, empty ones too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .adapter import Tables
from .schemas import DELIVERIES_SCHEMA, MATCHES_SCHEMA

RECORD = "_record"            # the text of a record that did not parse
IN_INNINGS = ("inning", "batting_team", "bowling_team")
IN_OVER = ("over",)
IN_BALL = tuple(f.name for f in DELIVERIES_SCHEMA.fields if f.name not in ("match_id", *IN_INNINGS, *IN_OVER))


def _fields(names) -> list[T.StructField]:
    return [DELIVERIES_SCHEMA[n] for n in names]


NESTED_SCHEMA = T.StructType([*MATCHES_SCHEMA.fields, T.StructField("innings", T.ArrayType(T.StructType([
    *_fields(IN_INNINGS), T.StructField("overs", T.ArrayType(T.StructType([
        *_fields(IN_OVER), T.StructField("balls", T.ArrayType(T.StructType(_fields(IN_BALL))))])))])))])


@dataclass(frozen=True)
class Nested(Tables):
    """The two tables of nested records; ``bad``: ``file, record, reason`` of the
    others; ``sequence``: deliveries with ``innings_at, over_at, ball_at``, their
    places (from 0) in the record."""

    bad: DataFrame
    sequence: DataFrame
    records: DataFrame


def read_nested(spark: SparkSession, path: str, fmt: str = "json") -> Nested:
    """Nested records of ``path`` (``json``: one record per line, or ``parquet``).

    A line of JSON is one record (the JSON reader would make none of ``[]`` and
    two of a pair); blank lines are none.  One that does not parse, or holds a
    value of another type, is bad as a whole; so is a record without an id.  Unknown fields are ignored,
    missing ones NULL.  A ball without a record of its own (a NULL in ``balls``)
    is a delivery of NULLs; NULL or empty innings, overs and balls have no
    deliveries (``audit`` counts them).  Two records of one match are both read.
    """
    if fmt == "json":
        schema = T.StructType([*NESTED_SCHEMA.fields, T.StructField(RECORD, T.StringType())])
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file")).where(F.trim("value") != "")
        parsed = F.from_json("value", schema, {"columnNameOfCorruptRecord": RECORD, "mode": "PERMISSIVE"})
        raw = lines.select(parsed.alias("r"), "_file").select("r.*", "_file")
    else:
        raw = (spark.read.schema(NESTED_SCHEMA).format(fmt).load(path)
               .select("*", F.lit(None).cast("string").alias(RECORD), F.col("_metadata.file_path").alias("_file")))
    broken, nameless = F.col(RECORD).isNotNull(), F.col("id").isNull()
    record = F.coalesce(RECORD, F.to_json(F.struct(*NESTED_SCHEMA.fieldNames())))
    bad = raw.where(broken | nameless).select(F.col("_file").alias("file"), record.alias("record"),
                                              F.when(broken, "does not parse").otherwise("no id").alias("reason"))
    good = raw.where(~broken & ~nameless).select(*NESTED_SCHEMA.fieldNames())
    balls = (good.select(F.col("id").alias("match_id"), F.posexplode("innings").alias("innings_at", "i"))
             .select("match_id", "innings_at", "i.*").select("*", F.posexplode("overs").alias("over_at", "o")).drop("overs")
             .select("match_id", "innings_at", *IN_INNINGS, "over_at", "o.*")
             .select("*", F.posexplode("balls").alias("ball_at", "b")).drop("balls")
             .select("match_id", "innings_at", *IN_INNINGS, "over_at", *IN_OVER, "ball_at", "b.*"))
    names = DELIVERIES_SCHEMA.fieldNames()
    return Nested(balls.select(*names), good.select(*MATCHES_SCHEMA.fieldNames()), bad,
                  balls.select(*names, "innings_at", "over_at", "ball_at"), raw)


def audit(nested: Nested) -> DataFrame:
    """One row: ``records, bad, matches, no_innings, innings, no_overs, overs,
    no_balls, balls``; records are bad or matches, and the empty ones say where
    deliveries are missing."""
    good = F.col(RECORD).isNull() & F.col("id").isNotNull()
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    none = F.array()
    innings = F.when(good, F.coalesce("innings", none.cast(NESTED_SCHEMA["innings"].dataType)))
    overs = F.flatten(F.transform(innings, lambda i: F.coalesce(i["overs"], none.cast(NESTED_SCHEMA["innings"].dataType.elementType["overs"].dataType))))
    balls = lambda o: size(o["balls"])
    total = lambda a, f: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + f(x))
    one_if = lambda c: F.when(c, 1).otherwise(0)
    counts = nested.records.select(
        good.alias("good"), size(innings).alias("innings"), total(innings, lambda i: one_if(size(i["overs"]) <= 0)).alias("no_overs"),
        size(overs).alias("overs"), total(overs, lambda o: one_if(balls(o) <= 0)).alias("no_balls"),
        total(overs, lambda o: F.greatest(balls(o), F.lit(0))).alias("balls"))
    summed = [F.coalesce(F.sum(F.when(F.col("good"), F.col(c))), F.lit(0)).cast("long").alias(c)
              for c in ("innings", "no_overs", "overs", "no_balls", "balls")]
    return counts.agg(F.count(F.lit(1)).alias("records"), F.count_if(~F.col("good")).alias("bad"), F.count_if("good").alias("matches"),
                      F.count_if(F.col("good") & (F.col("innings") <= 0)).alias("no_innings"), *summed)
