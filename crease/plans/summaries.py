"""Reports over mergeable summaries: sketches, cubes, refreshed sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import constants as C
from ..operators.cube import cube
from ..operators.dimension import rollup_by_dimension
from ..operators.sketches import (box_from_sketches, distinct_overlap, distinct_rollups, distinct_sketches, merge_quantiles,
                                  quantile_sketches)
from ..operators.snapshots import classify, partial_sums, refresh, snapshot_diff


def faceoff_sketches(clean: DataFrame, matches: DataFrame) -> DataFrame:
    """Distinct batter-bowler pairs per batting team and season, as sketches: the
    table to store.  Pairs are counted per match before they meet the seasons."""
    pairs = clean.select("match_id", "batting_team", F.concat_ws("|", "batter", "bowler").alias("pair")).distinct()
    seasons = matches.select(F.col("id").alias("match_id"), "season")
    return distinct_sketches(pairs.join(seasons, "match_id"), ["batting_team", "season"], F.col("pair"))


def faceoff_counts(clean: DataFrame, matches: DataFrame) -> DataFrame:
    """Distinct batter-bowler pairs by team and season, team, season, and in all,
    from the sketches of team and season."""
    by = ["batting_team", "season"]
    return distinct_rollups(faceoff_sketches(clean, matches), by, [by, by[:1], by[1:], []], "Pairs")


def faceoff_overlap(clean: DataFrame, matches: DataFrame) -> DataFrame:
    """Batter-bowler pairs of each season and the one before it: in either, in
    both, new in this one."""
    seasons = faceoff_sketches(clean, matches).groupBy("season").agg(F.theta_union_agg("sketch").alias("sketch"))
    order = Window.partitionBy(F.lit(0)).orderBy("season")           # a handful of seasons
    beside = seasons.withColumns({"before": F.lag("season").over(order), "past": F.lag("sketch").over(order)})
    counts = distinct_overlap(F.col("sketch"), F.col("past"))
    return beside.where("before IS NOT NULL").select("season", "before", counts["either"].alias("Either"),
                                                     counts["both"].alias("Both"), counts["left_only"].alias("New"))


def target_box(matches: DataFrame) -> DataFrame:
    """Box statistics of targets by season, merged from sketches by season and venue."""
    fine = quantile_sketches(matches, ["season", "venue"], "target_runs")
    return box_from_sketches(merge_quantiles(fine, ["season"]), ["season"])


def scoring_cube(clean: DataFrame, matches: DataFrame) -> DataFrame:
    """Balls, runs and wickets for every roll-up of batting team, season, venue
    and phase (as text)."""
    phased = clean.withColumn("phase", X.phase("over").cast("string"))
    cells = rollup_by_dimension(phased, "match_id", matches, "id",
                                [F.col("season"), X.canonical("venue", C.VENUE_ALIASES).alias("venue")], ["batting_team", "phase"],
                                {"Balls": F.count(F.lit(1)), "Runs": F.sum("total_runs"), "Wickets": F.sum("is_wicket")})
    sums = {name: ("sum", name) for name in ("Balls", "Runs", "Wickets")}
    return cube(cells, {"batting_team": 15, "season": 20, "venue": 40, "phase": 5}, sums)


def earlier_export(deliveries: DataFrame) -> DataFrame:
    """The export before this one: one match in ten not played yet, a scorer's
    corrections to come in one in seven, one in thirteen sent twice by mistake."""
    played = deliveries.where("match_id % 10 <> 3")
    scored = played.withColumn("batsman_runs", F.when(F.col("match_id") % 7 == 2, F.pmod(F.col("batsman_runs") + 1, F.lit(7)))
                               .otherwise(F.col("batsman_runs")).cast("int"))
    return scored.union(scored.where("match_id % 13 = 5"))


_BATTING = ["match_id", "batter"]


def _batting() -> dict:
    return {"Balls": F.lit(1), "Runs": F.col("batsman_runs"), "Outs": F.col("is_wicket")}


def match_changes(deliveries: DataFrame) -> DataFrame:
    """Matches whose balls differ from the export before, with the balls added and removed."""
    return classify(snapshot_diff(earlier_export(deliveries), deliveries), ["match_id"])


def refreshed_batting(deliveries: DataFrame) -> DataFrame:
    """Batting sums by match and batter, kept from the export before and brought
    up to date by the differing balls alone."""
    before = earlier_export(deliveries)
    kept = partial_sums(before, _BATTING, _batting())
    return refresh(kept, snapshot_diff(before, deliveries), _BATTING, _batting()).drop("_rows")
