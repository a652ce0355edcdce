"""The physical plans have the shape the design relies on."""

from __future__ import annotations

import re

from __spark_entry__ import queries
from crease.plans.catalog import QUERIES
from tests.conftest import SF_ORACLE
from tests.plan_text import plan_text

Q = {n: f for n, f in queries().items() if n in QUERIES}


def _plan(spark, name):
    return plan_text(Q[name](spark, SF_ORACLE), "simple")


def test_topk_is_take_ordered(spark):
    for name in ("top_runs", "top_sixes", "top_wickets", "faceoff_batter", "top_season_runs", "powerplay_economy"):
        p = _plan(spark, name)
        assert "TakeOrderedAndProject(limit=10" in p, name
        assert "Exchange rangepartitioning" not in p, name        # no global sort


def test_season_leader_uses_window_group_limit_before_the_shuffle(spark):
    p = _plan(spark, "season_top_batter")
    assert "WindowGroupLimit" in p and ", Partial" in p and ", Final" in p
    assert "Exchange rangepartitioning" not in p


def test_one_join_plan_aggregates_before_the_join_and_forces_no_broadcast(spark):
    for name in ("season_top_batter", "top_season_wkts", "season_innings_totals", "venue_innings_avg"):
        p = _plan(spark, name)
        assert "partial_sum" in p[p.index("Join"):] or "partial_count" in p[p.index("Join"):], name
        logical = Q[name](spark, SF_ORACLE)._jdf.queryExecution().analyzed().toString()
        assert "ResolvedHint" not in logical, name


def test_building_a_report_runs_no_job(spark):
    from crease.sources.adapter import from_tpch

    from_tpch(spark, SF_ORACLE)                          # the column types of the two files are looked up once
    tracker, before = spark.sparkContext.statusTracker(), None
    for name in ["", *Q]:
        if name:
            spark.sparkContext.setJobGroup(f"build-{name}", name)
            Q[name](spark, SF_ORACLE)
            assert list(tracker.getJobIdsForGroup(f"build-{name}")) == [], name
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", before)


def test_every_aggregate_has_a_partial_step(spark):
    for name in ("conceded_long", "team_phase_wkts_taken", "run_rate_long", "innings_summary"):
        p = _plan(spark, name)
        assert "partial_" in p, name


def test_grouping_sets_scan_once(spark):
    p = _plan(spark, "run_rate_long")
    assert "Expand" in p
    assert len(re.findall(r"FileScan parquet", p)) == 1
    below = p[p.index("Expand"):]
    assert "partial_sum" in below and "Exchange" in below       # balls are aggregated before they are expanded


def test_column_pruning_reaches_the_scan(spark):
    p = _plan(spark, "top_sixes")
    scan = [ln for ln in p.splitlines() if "FileScan parquet" in ln][0]
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in scan


def test_alias_lookup_is_an_expression_not_a_join(spark):
    p = _plan(spark, "canonical_teams")
    assert "Join" not in p and "Exchange" not in p


def test_no_python_in_any_plan(spark):
    for name in Q:
        p = _plan(spark, name)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_boundary_boards_read_deliveries_once(spark):
    p = _plan(spark, "boundary_boards")
    assert len(re.findall(r"FileScan parquet", p)) == 1
    assert "WindowGroupLimit" in p


def test_running_score_shuffles_the_balls_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _plan(spark, "running_score")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [ln for ln in p.splitlines() if "Exchange hashpartitioning" in ln]
    assert len(exchanges) == 4 and "coalesce" not in " ".join(exchanges)
    balls = p[p.index("Window"):p.index("SortMergeJoin")]
    assert "Exchange" not in balls                                # the last window reuses the join's partitioning


SORTED = ("team_over_run_rate", "conceded_long", "team_phase_wkts_taken", "team_phase_wkts_lost", "run_rate_matrix", "conceded_matrix",
          "wkts_taken_matrix", "wkts_lost_matrix", "venue_innings_matrix", "venue_max_chase", "season_innings_box_ordered")


def test_small_reports_are_sorted_once_and_not_by_range(spark):
    for name in SORTED:
        p = _plan(spark, name)
        assert "rangepartitioning" not in p, name
        assert len(re.findall(r"Exchange SinglePartition", p)) == 1, name
        assert p.index("Sort [") < p.index("Exchange"), name


def test_no_new_report_gathers_the_table_in_one_task(spark):
    for name in ("last_wicket", "venue_previous_chase", "spell_totals", "award_spans", "bowling_spells", "partnerships", "match_changes",
                 "refreshed_batting"):
        p = _plan(spark, name)
        assert "SinglePartition" not in p and "NestedLoop" not in p and "Cartesian" not in p, name
