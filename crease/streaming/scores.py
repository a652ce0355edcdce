"""Scores and boards kept up to date by a stream of balls.

``live`` keeps, per group, the sums of the balls seen so far.  A ball is counted
once however often it is sent: repeats are dropped by key, in keyed state.  Event
time is the day of the match; a watermark ``delay`` behind the latest day ends
the state of old days, so the state holds the balls of recent days only.  Balls
later than that are not counted; ``dropped`` says how many, and a nightly batch
run over the whole table, which the same reports read, puts them right.

``start`` writes each micro-batch's changed groups to a folder named by the
batch, which a repeated batch replaces: with the checkpoint this is exactly
once, across restarts.  ``board`` reads the newest row of each group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BALL_KEY = ("match_id", "inning", "over", "ball", "batter", "bowler", "extras_type")


def dated(balls: DataFrame, matches: DataFrame) -> DataFrame:
    """Balls (a stream or a table) with their match's ``season`` and ``day``.  Balls
    of unknown matches are left out: the match table must be ahead of its balls."""
    days = matches.select(F.col("id").alias("match_id"), "season", F.col("date").cast("timestamp").alias("day"))
    return balls.join(days.where("day IS NOT NULL"), "match_id")


def once(balls: DataFrame, delay: str, key: Sequence[str] = BALL_KEY) -> DataFrame:
    """Each ball once: rows equal in ``key`` and ``day`` are one ball (NULL equals NULL)."""
    return balls.withWatermark("day", delay).dropDuplicates([*key, "day"])


def live(balls: DataFrame, matches: DataFrame, by: Sequence[str], measures: dict[str, Column], delay: str = "30 days",
         key: Sequence[str] = BALL_KEY) -> DataFrame:
    """``by`` and sums of ``measures`` over a stream of balls; ``by`` may name
    ``season`` and ``day``.  With ``day`` among them, the watermark also ends the
    state of the groups; other groups (season and player) stay, one row each."""
    counted = once(dated(balls, matches), delay, key)
    return counted.groupBy(*by).agg(*[F.sum(m).alias(name) for name, m in measures.items()])


def innings_scores(balls: DataFrame, matches: DataFrame, **kw) -> DataFrame:
    """Running total, wickets and balls of every innings."""
    return live(balls, matches, ["day", "match_id", "inning"],
                {"Runs": F.col("total_runs"), "Wickets": F.col("is_wicket"), "Balls": F.lit(1)}, **kw)


def season_runs(balls: DataFrame, matches: DataFrame, **kw) -> DataFrame:
    """Runs of every batter in every season."""
    return live(balls, matches, ["season", "batter"], {"Runs": F.col("batsman_runs")}, **kw)


def start(scores: DataFrame, table: str, checkpoint: str, *, processing_time: str | None = None) -> StreamingQuery:
    """Keep ``table`` up to date with ``scores``; returns the started query.
    Without ``processing_time`` it takes all that is there and stops."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = scores.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    writer = writer.trigger(processingTime=processing_time) if processing_time else writer.trigger(availableNow=True)
    return writer.start()


def board(spark: SparkSession, table: str, by: Sequence[str]) -> DataFrame:
    """The newest row of each group of ``table``."""
    rows = spark.read.parquet(table)
    rest = [c for c in rows.columns if c not in (*by, "batch")]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*by, "_r.*")


def dropped(query: StreamingQuery) -> int:
    """Balls of a run that came after the watermark and were not counted."""
    return sum(state["numRowsDroppedByWatermark"] for p in query.recentProgress for state in p["stateOperators"])
