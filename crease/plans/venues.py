"""Venue reports (canonical venue names)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import constants as C
from ..operators.dimension import rollup_by_dimension
from ..operators.matrix import to_matrix
from ..operators.topk import in_order

INNINGS = [1, 2]      # every innings the report keeps


def venue_innings_avg(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    """Mean first- and second-innings total per venue, rounded up.

    Super overs (innings above 2) are left out; so is an innings below 1,
    which is no innings.  Innings totals are built
    first (one row per match and innings, with the match's canonical venue;
    see ``operators.dimension``), then averaged per venue.
    """
    innings = rollup_by_dimension(
        deliveries.where(F.col("inning").isin(*INNINGS)), "match_id", matches, "id",
        [X.canonical("venue", C.VENUE_ALIASES).alias("venue")], ["match_id", "inning"],
        {"_r": F.sum("total_runs")})
    return innings.groupBy("venue", "inning").agg(
        F.ceil(X.ratio(F.sum("_r"), F.count_distinct("match_id"))).alias("Average_Score"))


def venue_innings_matrix(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    return to_matrix(venue_innings_avg(deliveries, matches), "venue", "inning", "Average_Score", INNINGS)


def venue_max_chase(matches: DataFrame) -> DataFrame:
    """Highest target successfully chased per venue.

    A chase is a match whose ``result`` is exactly ``wickets`` (no trimming or
    case folding here).  Venues with no name or no target are left out.
    Highest target first (then by name).
    """
    best = (matches.where(F.col("result") == C.RESULT_WICKETS)
            .select(X.canonical("venue", C.VENUE_ALIASES).alias("venue"), "target_runs")
            .groupBy("venue").agg(F.max("target_runs").alias("Highest_Chased_Total"))
            .where(F.col("venue").isNotNull() & F.col("Highest_Chased_Total").isNotNull()))
    return in_order(best, F.desc("Highest_Chased_Total"), F.asc("venue"))
