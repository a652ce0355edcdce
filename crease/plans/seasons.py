"""Season-level reports: deliveries joined to their match's season.

The join is fact -> dimension on ``match_id = id`` through
``operators.dimension.rollup_by_dimension``: deliveries are aggregated per
(match, player) or (match, innings) first -- partial aggregation collapses a
match holding a huge share of the balls inside each task -- and the reduced
rows are joined with a join Spark sizes itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import constants as C
from ..operators.dimension import rollup_by_dimension
from ..operators.distribution import box_summary
from ..operators.topk import in_order, leaders, top_k

RUNS_SEASON = "Most_Runs_in_a_Single_Season"
WKTS_SEASON = "Most_Wickets_in_a_Single_Season"


def season_runs(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    """Runs per (batter, season)."""
    return rollup_by_dimension(deliveries, "match_id", matches, "id", [F.col("season")], ["batter"],
                               {RUNS_SEASON: F.sum("batsman_runs")})


def season_wickets(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    """Bowler wickets (run outs excluded) per (bowler, season)."""
    return rollup_by_dimension(deliveries.where(X.bowler_wicket()), "match_id", matches, "id",
                               [F.col("season")], ["bowler"], {WKTS_SEASON: F.count("is_wicket")})


def _labelled(df: DataFrame, who: str) -> DataFrame:
    """Adds the chart label ``<player> in <season>`` (NULL if either is)."""
    return df.withColumn("Label", F.concat(F.col(who), F.lit(C.LABEL_JOINER), F.col("season").cast("string")))


def top_season_runs(deliveries: DataFrame, matches: DataFrame, k: int = C.TOP_K) -> DataFrame:
    return _labelled(top_k(season_runs(deliveries, matches),
                           [F.desc(RUNS_SEASON), F.asc("batter"), F.asc("season")], k), "batter")


def top_season_wkts(deliveries: DataFrame, matches: DataFrame, k: int = C.TOP_K) -> DataFrame:
    return _labelled(top_k(season_wickets(deliveries, matches),
                           [F.desc(WKTS_SEASON), F.asc("bowler"), F.asc("season")], k), "bowler")


def season_top_batter(deliveries: DataFrame, matches: DataFrame, keep_ties: bool = False) -> DataFrame:
    """Leading run scorer of each season; ties go to the lower name unless ``keep_ties``."""
    return _labelled(leaders(season_runs(deliveries, matches), ["season"],
                             [F.desc(RUNS_SEASON)], [F.asc("batter")], keep_ties=keep_ties), "batter")


def season_top_bowler(deliveries: DataFrame, matches: DataFrame, keep_ties: bool = False) -> DataFrame:
    return _labelled(leaders(season_wickets(deliveries, matches), ["season"],
                             [F.desc(WKTS_SEASON)], [F.asc("bowler")], keep_ties=keep_ties), "bowler")


def season_innings_totals(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    """Total runs of every innings (super overs included) with its season."""
    return rollup_by_dimension(deliveries, "match_id", matches, "id", [F.col("season")],
                               ["match_id", "inning"], {"Runs": F.sum("total_runs")}) \
        .select("season", "match_id", "inning", "Runs")


def season_innings_box(deliveries: DataFrame, matches: DataFrame,
                       seasons: tuple[str, ...] | None = None) -> DataFrame:
    """Distribution of innings totals per season (quartiles, whiskers, outliers).

    ``seasons`` restricts the output to a fixed list of labels (e.g.
    ``constants.SEASON_ORDER``), adds its position as ``season_order`` and
    sorts by it; by default every season present is summarised.
    """
    totals = season_innings_totals(deliveries, matches)
    if seasons is None:
        return box_summary(totals, ["season"], "Runs")
    totals = totals.where(F.col("season").isin(*seasons))
    order = F.array_position(F.array(*[F.lit(s) for s in seasons]), F.col("season")).cast("int")
    return in_order(box_summary(totals, ["season"], "Runs").withColumn("season_order", order), F.asc("season_order"))
