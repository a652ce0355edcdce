"""Career leaderboards over raw deliveries (every ball, wides included).

Each board is one partial+final hash aggregate followed by a top-k, so only
``k`` rows per task leave the aggregate stage and ``k`` rows reach the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import constants as C
from ..operators.topk import top_k, top_k_per_group


def _board(df: DataFrame, where: Column, key: str, measure: Column, name: str,
           k: int = C.TOP_K) -> DataFrame:
    agg = df.where(where).groupBy(key).agg(measure.alias(name))
    return top_k(agg, [F.desc(name), F.asc(key)], k)


def top_sixes(deliveries: DataFrame, k: int = C.TOP_K) -> DataFrame:
    return _board(deliveries, F.col("batsman_runs") == 6, "batter", F.count("batsman_runs"), "Sixes_Hit", k)


def top_fours(deliveries: DataFrame, k: int = C.TOP_K) -> DataFrame:
    return _board(deliveries, F.col("batsman_runs") == 4, "batter", F.count("batsman_runs"), "Fours_Hit", k)


def top_boundaries(deliveries: DataFrame, k: int = C.TOP_K) -> DataFrame:
    return _board(deliveries, F.col("batsman_runs").isin(4, 6), "batter",
                  F.count("batsman_runs"), "Boundaries_Hit", k)


def boundary_boards(deliveries: DataFrame, k: int = C.TOP_K) -> DataFrame:
    """The fours, sixes and boundaries boards from one scan: (board, batter, Hits).

    One per-batter aggregate with three conditional counts is unpivoted into
    (board, batter, Hits) rows and cut to the top ``k`` per board: one scan,
    one shuffle of partial counts, one small shuffle of at most ``k`` rows per
    board per task.
    """
    r = F.col("batsman_runs")
    per = deliveries.where(r.isin(4, 6)).groupBy("batter").agg(
        F.count_if(r == 4).alias("Fours_Hit"), F.count_if(r == 6).alias("Sixes_Hit"),
        F.count(r).alias("Boundaries_Hit"))
    long = per.select("batter", F.expr(
        "stack(3, 'Fours_Hit', Fours_Hit, 'Sixes_Hit', Sixes_Hit, 'Boundaries_Hit', Boundaries_Hit) AS (board, Hits)"))
    top = top_k_per_group(long.where(F.col("Hits") > 0), ["board"], [F.desc("Hits"), F.asc("batter")], k)
    return top.select("board", "batter", "Hits")


def top_wickets(deliveries: DataFrame, k: int = C.TOP_K) -> DataFrame:
    return _board(deliveries, X.bowler_wicket(), "bowler", F.count("is_wicket"), "Total_Wickets", k)


def top_catches(deliveries: DataFrame, k: int = C.TOP_K) -> DataFrame:
    """Catches per fielder; a catch with no recorded fielder is its own (NULL) row."""
    return _board(deliveries, X.dismissal_of(C.CAUGHT), "fielder", F.count("is_wicket"), "Catches", k)


def top_stumpings(deliveries: DataFrame, k: int = C.TOP_K) -> DataFrame:
    return _board(deliveries, X.dismissal_of(C.STUMPED), "fielder", F.count("is_wicket"), "Stumpings", k)


def batting_totals(deliveries: DataFrame) -> DataFrame:
    """Per batter: runs, matches batted in, and ceil(runs / times out).

    The average divides runs by wickets on balls the batter faced; a batter
    never out has a NULL average (no division error).
    """
    runs = F.sum("batsman_runs")
    return deliveries.groupBy("batter").agg(
        runs.alias("Runs"),
        F.count_distinct("match_id").alias("No_Of_Matches"),
        F.ceil(X.ratio(runs, F.sum("is_wicket"))).alias("Average"),
    )


def top_runs(deliveries: DataFrame, k: int = C.TOP_K) -> DataFrame:
    return top_k(batting_totals(deliveries), [F.desc("Runs"), F.asc("batter")], k)


def run_scorer_delta(deliveries: DataFrame, k: int = C.TOP_K) -> DataFrame:
    """Top run scorers: average, runs in hundreds, and the gap between them."""
    top = top_runs(deliveries, k)
    per100 = F.col("Runs") / 100
    return top.select("batter", "Average", per100.alias("runs_per_100"),
                      (per100 - F.col("Average")).alias("delta"))


def powerplay_economy(deliveries: DataFrame, k: int = C.TOP_K,
                      min_overs: float = C.POWERPLAY_MIN_OVERS) -> DataFrame:
    """Most economical bowlers in overs 0-6 with at least ``min_overs`` bowled there.

    Every delivery counts as a ball here, wides and no-balls included.
    """
    agg = (deliveries.where(F.col("over") <= C.POWERPLAY_LAST_OVER).groupBy("bowler")
           .agg(F.round(F.avg("total_runs") * 6.0, 2).alias("Economy_in_Powerplay"),
                F.round(F.count("total_runs") / 6.0, 2).alias("Overs_Bowled_in_Powerplay"))
           .where(F.col("Overs_Bowled_in_Powerplay") >= min_overs))
    return top_k(agg, [F.asc("Economy_in_Powerplay"), F.asc("bowler")], k)


def innings_summary(deliveries: DataFrame) -> DataFrame:
    """Batter runs per innings: total and mean per delivery."""
    return deliveries.groupBy("match_id", "inning").agg(
        F.sum("batsman_runs").alias("Total_Runs"), F.avg("batsman_runs").alias("Average_Runs"))
