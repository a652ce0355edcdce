"""Batter-versus-bowler face-offs over clean deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import constants as C
from ..operators.topk import top_k


def faceoff_summary(clean: DataFrame, keep_non_dismissals: bool = False) -> DataFrame:
    """Per (batter, bowler): matches, balls, runs, wickets, strike rate, bowling average.

    ``keep_non_dismissals`` chooses whether balls with no dismissal (missing
    kind) count; the five non-bowler dismissal kinds never do.  Ratios are
    NULL where the divisor is 0.  The distinct match count plans as a two-step
    aggregate (by pair+match, then by pair), both with map-side combining.
    """
    runs, balls, wkts = F.sum("batsman_runs"), F.count("batsman_runs"), F.sum("is_wicket")
    return (clean.where(X.faceoff_ball(keep_non_dismissals)).groupBy("batter", "bowler").agg(
        F.count_distinct("match_id").alias("Matches"),
        balls.alias("Balls"),
        runs.alias("Runs"),
        wkts.alias("Wickets"),
        F.round(X.ratio(runs, balls) * 100, 2).alias("Batter_SR"),
        F.round(X.ratio(runs, wkts), 2).alias("Bowler_Avg"),
    ))


def faceoff_batter(clean: DataFrame, keep_non_dismissals: bool = False, k: int = C.TOP_K) -> DataFrame:
    """Batter-dominated pairs: most runs, then fewest wickets."""
    return top_k(faceoff_summary(clean, keep_non_dismissals),
                 [F.desc("Runs"), F.asc("Wickets"), F.asc("batter"), F.asc("bowler")], k)


def faceoff_bowler(clean: DataFrame, keep_non_dismissals: bool = False, k: int = C.TOP_K) -> DataFrame:
    """Bowler-dominated pairs: most wickets."""
    return top_k(faceoff_summary(clean, keep_non_dismissals),
                 [F.desc("Wickets"), F.asc("batter"), F.asc("bowler")], k)
