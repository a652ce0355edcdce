"""Per-over and per-phase rate reports over clean deliveries.

Long forms are hash aggregates keyed by (team, over) -- at most teams x 20
groups, so after map-side partial aggregation each task ships a few hundred
rows whatever the data size.  Wide forms pivot that small aggregate over a
list of columns (an argument; by default a 20-over innings) and fail on a key
off the list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import constants as C
from ..operators.matrix import to_matrix
from ..operators.topk import in_order
from .cleaning import canonical_teams, legal_deliveries

OVERS = list(range(C.OVERS_PER_INNINGS))
PHASES = list(range(1, C.OVERS_PER_INNINGS // C.OVERS_PER_PHASE + 1))


def _rate(col: str, name: str):
    return X.per_over(F.avg(col)).alias(name)


def team_over_run_rate(deliveries: DataFrame, teams: tuple[str, ...] = C.TEAM_PANEL) -> DataFrame:
    """Runs and run rate per over for a panel of teams (canonical names).

    The panel filter runs on the raw names (panel plus their aliases) before
    canonicalisation, so it is a plain ``IN`` list a parquet scan can push down.
    Ordered by team and over, both descending.
    """
    raw = legal_deliveries(deliveries).where(F.col("batting_team").isin(*X.raw_names(teams, C.TEAM_ALIASES)))
    rates = (canonical_teams(raw).groupBy("batting_team", "over")
             .agg(F.sum("total_runs").alias("Runs_Scored"), _rate("total_runs", "Run_Rate")))
    return in_order(rates, F.desc("batting_team"), F.desc("over"))


def run_rate_long(clean: DataFrame) -> DataFrame:
    """Run rate per (batting team, over) plus an ``All_Teams`` row per over.

    Balls are aggregated once to (team, over) sums and counts; the two grouping
    sets expand those few hundred rows, not the balls, and the rate is their sum
    over their count.  The all-teams line covers every clean ball, including
    balls with no team.  Rows with no team or no over are dropped, as the
    matrix drops them.
    """
    cells = clean.groupBy("batting_team", "over").agg(F.sum("total_runs").alias("_s"), F.count("total_runs").alias("_n"))
    agg = (cells.groupingSets([["batting_team", "over"], ["over"]], "batting_team", "over")
           .agg(F.grouping("batting_team").alias("_all"), F.sum("_s").alias("Runs_Scored"),
                X.per_over(X.ratio(F.sum("_s"), F.sum("_n"))).alias("Run_Rate")))
    team = F.when(F.col("_all") == 1, F.lit(C.ALL_TEAMS)).otherwise(F.col("batting_team"))
    return (agg.select(team.alias("batting_team"), "over", "Runs_Scored", "Run_Rate")
            .where(F.col("batting_team").isNotNull() & F.col("over").isNotNull()))


def run_rate_matrix(clean: DataFrame, overs: Sequence[int] = OVERS) -> DataFrame:
    return to_matrix(run_rate_long(clean), "batting_team", "over", "Run_Rate", overs)


def _conceded(clean: DataFrame) -> DataFrame:
    return clean.groupBy("bowling_team", "over").agg(_rate("total_runs", "avg_runs"))


def conceded_long(clean: DataFrame) -> DataFrame:
    """Runs conceded per over by bowling team; both descending."""
    return in_order(_conceded(clean), F.desc("bowling_team"), F.desc("over"))


def conceded_matrix(clean: DataFrame, overs: Sequence[int] = OVERS) -> DataFrame:
    return to_matrix(_conceded(clean), "bowling_team", "over", "avg_runs", overs)


def _phase_wickets(clean: DataFrame, team: str) -> DataFrame:
    """Wickets per four-over phase: mean wicket flag per ball x 24 (run outs included)."""
    return (clean.withColumn("Overs", X.phase("over")).groupBy(team, "Overs")
            .agg(F.round(F.avg("is_wicket") * C.BALLS_PER_OVER * C.OVERS_PER_PHASE, 5).alias("Wickets")))


def team_phase_wkts_taken(clean: DataFrame) -> DataFrame:
    """By bowling team and phase, both descending."""
    return in_order(_phase_wickets(clean, "bowling_team"), F.desc("bowling_team"), F.desc("Overs"))


def team_phase_wkts_lost(clean: DataFrame) -> DataFrame:
    """By batting team and phase, both descending."""
    return in_order(_phase_wickets(clean, "batting_team"), F.desc("batting_team"), F.desc("Overs"))


def wkts_taken_matrix(clean: DataFrame, phases: Sequence[int] = PHASES) -> DataFrame:
    return to_matrix(_phase_wickets(clean, "bowling_team"), "bowling_team", "Overs", "Wickets", phases)


def wkts_lost_matrix(clean: DataFrame, phases: Sequence[int] = PHASES) -> DataFrame:
    return to_matrix(_phase_wickets(clean, "batting_team"), "batting_team", "Overs", "Wickets", phases)
