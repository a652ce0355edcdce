"""Cross-report invariants on the sf0.01 tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from crease.functions import constants as C
from crease.plans import cleaning as cl
from crease.plans import leaderboards as lb
from crease.plans import matrices as mx
from crease.plans import seasons as se
from crease.sources.adapter import from_tpch
from tests.conftest import SF_ORACLE


@pytest.fixture(scope="module")
def t(spark):
    return from_tpch(spark, SF_ORACLE)


def test_innings_totals_sum_to_all_runs(t):
    total = t.deliveries.agg(F.sum("total_runs")).first()[0]
    assert se.season_innings_totals(t.deliveries, t.matches).agg(F.sum("Runs")).first()[0] == total


def test_boundaries_are_fours_plus_sixes(t):
    n = 10_000
    b = {r.batter: r.Boundaries_Hit for r in lb.top_boundaries(t.deliveries, n).collect()}
    f = {r.batter: r.Fours_Hit for r in lb.top_fours(t.deliveries, n).collect()}
    s = {r.batter: r.Sixes_Hit for r in lb.top_sixes(t.deliveries, n).collect()}
    assert b and all(b[k] == f.get(k, 0) + s.get(k, 0) for k in b)


def test_canonical_names_contain_no_alias(t):
    clean = cl.clean_deliveries(t.deliveries)
    names = {r[0] for r in clean.select("batting_team").union(clean.select("bowling_team")).distinct().collect()}
    assert names and not names & {"Kings XI Punjab", "Royal Challengers Bangalore", "Rising Pune Supergiant"}
    venues = {r.venue for r in cl.canonical_venues(t.matches).select("venue").distinct().collect()}
    assert not venues & {"M Chinnaswamy Stadium", "M.Chinnaswamy Stadium", "Eden Gardens", "Feroz Shah Kotla", "Arun Jaitley Stadium", "Wankhede Stadium"}


def test_running_score_ends_at_innings_total(t):
    legal = cl.legal_deliveries(t.deliveries)
    last = cl.with_running_score(legal).groupBy("match_id", "inning").agg(F.max("runningScorePerInning").alias("x"))
    tot = legal.groupBy("match_id", "inning").agg(F.sum("total_runs").alias("y"))
    assert last.join(tot, ["match_id", "inning"]).where(F.col("x") != F.col("y")).count() == 0
    assert last.count() == tot.count()


def test_run_rate_long_contains_the_team_panel(t):
    clean = cl.clean_deliveries(t.deliveries)
    long = mx.run_rate_long(clean).where(F.col("batting_team").isin(*C.TEAM_PANEL))
    panel = mx.team_over_run_rate(t.deliveries)
    assert long.exceptAll(panel).count() == 0 and panel.exceptAll(long).count() == 0


def test_one_leader_per_season(t):
    lead = se.season_top_batter(t.deliveries, t.matches)
    seasons = t.matches.select("season").distinct().count()
    assert lead.count() == seasons == lead.select("season").distinct().count()


def test_leader_equals_max_of_season_runs(t):
    runs = se.season_runs(t.deliveries, t.matches)
    best = runs.groupBy("season").agg(F.max(se.RUNS_SEASON).alias("m"))
    lead = se.season_top_batter(t.deliveries, t.matches)
    assert lead.join(best, "season").where(F.col("m") != F.col(se.RUNS_SEASON)).count() == 0
