"""Reports that need an order: what came before, runs of balls, spans, ranks.

Balls of an innings are taken by over, then ball; balls that share both (an
extra and its re-bowl) by their other columns.  ``seq`` is over * 100 + ball.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.asof import asof_join
from ..operators.intervals import interval_join
from ..operators.islands import islands
from ..operators.ranking import global_ranks
from .cleaning import canonical_venues

INNINGS = ["match_id", "inning"]


def _seq() -> Column:
    return (F.col("over") * 100 + F.col("ball")).alias("seq")


def last_wicket(clean: DataFrame) -> DataFrame:
    """Each ball with the latest wicket that fell before it in its innings (of
    wickets on one ball: the largest by player, then bowler); one over is a bucket."""
    balls = clean.select(*INNINGS, "over", "ball", "batter", "bowler", "total_runs", _seq())
    wickets = clean.where("is_wicket = 1").select(*INNINGS, _seq(), "player_dismissed", "bowler", "dismissal_kind")
    found = {"player_dismissed": "last_out", "bowler": "last_wicket_by", "dismissal_kind": "last_kind", "seq": "at"}
    out = asof_join(balls, wickets, INNINGS, "seq", "seq", found, width=100,
                    tie=["player_dismissed", "bowler", "dismissal_kind"], strict=True)
    return out.withColumn("wicket_seq", F.coalesce("at", F.lit(-1))).drop("at")


def venue_previous_chase(matches: DataFrame, days: int = 90) -> DataFrame:
    """Each match with the latest chase won at its (canonical) venue on an earlier
    day; of several on one day, the one with the largest id.  ``days`` make a bucket."""
    named = canonical_venues(matches)
    chases = named.where("result = 'wickets'").select("venue", F.col("date").alias("day"), "id", "target_runs")
    out = asof_join(named.select("id", "venue", "date"), chases, ["venue"], "date", "day",
                    {"id": "previous_id", "day": "previous_date", "target_runs": "previous_target"},
                    width=days, tie=["id"], strict=True)
    return out.withColumns({"previous_id": F.coalesce("previous_id", F.lit(-1)),
                            "previous_target": F.col("previous_target").cast("double")})


def spell_totals(clean: DataFrame) -> DataFrame:
    """For every bowler of an innings, the balls and runs of the whole innings
    between the bowler's first and last ball."""
    balls = clean.select(*INNINGS, _seq(), "total_runs")
    spells = clean.select(*INNINGS, "bowler", _seq()).groupBy(*INNINGS, "bowler").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    inside = interval_join(balls, spells, INNINGS, "seq", "first_seq", "last_seq", levels=3)
    return inside.groupBy(*INNINGS, "bowler", "first_seq", "last_seq").agg(
        F.count(F.lit(1)).alias("Balls"), F.sum("total_runs").alias("Runs"))


def award_spans(matches: DataFrame) -> DataFrame:
    """For every player of the match, the matches and targets between the
    player's first and last award; one span can hold the whole table."""
    days = matches.select("date", "target_runs")
    spans = matches.where("player_of_match IS NOT NULL").groupBy("player_of_match").agg(
        F.min("date").alias("first_award"), F.max("date").alias("last_award"))
    counted = days.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("target_runs").alias("target"))
    inside = interval_join(counted, spans, [], "date", "first_award", "last_award", levels=4)
    return inside.groupBy("player_of_match", "first_award", "last_award").agg(
        F.sum("n").alias("Matches"), F.sum("target").alias("Target_Runs"))


def bowling_spells(clean: DataFrame) -> DataFrame:
    """Maximal runs of consecutive balls of an innings by one bowler."""
    return islands(clean.withColumn("seq", _seq()), INNINGS, "over", ["ball", "batter", "bowler", "total_runs", "is_wicket"],
                   {"first_seq": ("min", F.col("seq")), "last_seq": ("max", F.col("seq")), "Balls": ("count", None),
                    "Runs": ("sum", F.col("total_runs")), "Wickets": ("sum", F.col("is_wicket"))}, state=["bowler"])


def partnerships(deliveries: DataFrame) -> DataFrame:
    """Balls and runs of an innings up to each wicket, and after the last one
    (``Ended`` 0); every ball counts, wides and no-balls too."""
    return islands(deliveries.withColumn("seq", _seq()), INNINGS, "over", ["ball", "is_wicket", "batter", "bowler", "total_runs"],
                   {"first_seq": ("min", F.col("seq")), "last_seq": ("max", F.col("seq")), "Balls": ("count", None),
                    "Runs": ("sum", F.col("total_runs")), "Ended": ("max", F.col("is_wicket"))}, ends=F.col("is_wicket") == 1)


def innings_ranks(deliveries: DataFrame) -> DataFrame:
    """Every innings total with its place among all innings, highest first;
    ``ntile`` in hundredths."""
    totals = deliveries.groupBy(*INNINGS).agg(F.sum("total_runs").alias("Runs"))
    return global_ranks(totals, "Runs", INNINGS, tiles=100, descending=True, dense=True)


def target_ranks(matches: DataFrame) -> DataFrame:
    """Every match with the place of its target among all, lowest first; ``ntile`` in tenths."""
    return global_ranks(matches.select("id", "target_runs"), "target_runs", ["id"], tiles=10)
