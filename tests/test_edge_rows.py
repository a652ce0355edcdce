"""Edge cases on micro tables: nulls, ties, division by zero, frames, labels."""

from __future__ import annotations

from crease.plans import cleaning as cl
from crease.plans import faceoffs as fo
from crease.plans import leaderboards as lb
from crease.plans import matrices as mx
from crease.plans import seasons as se
from crease.plans import venues as ve

from tests.fixtures import ball, deliveries, match, matches


SEASONS = ("2007/08", "2009", "2009/10", "2011", "2012", "2013", "2014", "2015", "2016", "2017", "2018", "2019", "2020/21",
           "2021", "2022", "2023", "2024")
TEAMS = {
    "Kings XI Punjab": "Punjab Kings",
    "Royal Challengers Bangalore": "Royal Challengers Bengaluru",
    "Rising Pune Supergiant": "Rising Pune Supergiants",
}
VENUES = {
    "M Chinnaswamy Stadium": "M Chinnaswamy Stadium, Bengaluru",
    "M.Chinnaswamy Stadium": "M Chinnaswamy Stadium, Bengaluru",
    "Himachal Pradesh Cricket Association Stadium": "Himachal Pradesh Cricket Association Stadium, Dharamsala",
    "Sardar Patel Stadium, Motera": "Narendra Modi Stadium, Ahmedabad",
    "Punjab Cricket Association Stadium, Mohali": "Punjab Cricket Association IS Bindra Stadium, Mohali",
    "Punjab Cricket Association IS Bindra Stadium": "Punjab Cricket Association IS Bindra Stadium, Mohali",
    "Punjab Cricket Association IS Bindra Stadium, Mohali, Chandigarh": "Punjab Cricket Association IS Bindra Stadium, Mohali",
    "Maharashtra Cricket Association Stadium": "Maharashtra Cricket Association Stadium, Pune",
    "Subrata Roy Sahara Stadium": "Maharashtra Cricket Association Stadium, Pune",
    "Eden Gardens": "Eden Gardens, Kolkata",
    "Arun Jaitley Stadium": "Arun Jaitley Stadium, Delhi",
    "Feroz Shah Kotla": "Arun Jaitley Stadium, Delhi",
    "Rajiv Gandhi International Stadium, Uppal": "Rajiv Gandhi International Stadium, Uppal, Hyderabad",
    "Rajiv Gandhi International Stadium": "Rajiv Gandhi International Stadium, Uppal, Hyderabad",
    "Wankhede Stadium": "Wankhede Stadium, Mumbai",
    "Dr DY Patil Sports Academy": "Dr DY Patil Sports Academy, Mumbai",
    "Zayed Cricket Stadium, Abu Dhabi": "Sheikh Zayed Stadium",
    "MA Chidambaram Stadium, Chepauk": "MA Chidambaram Stadium, Chepauk, Chennai",
    "MA Chidambaram Stadium": "MA Chidambaram Stadium, Chepauk, Chennai",
    "Sawai Mansingh Stadium": "Sawai Mansingh Stadium, Jaipur",
    "Dr. Y.S. Rajasekhara Reddy ACA-VDCA Cricket Stadium":
        "Dr. Y.S. Rajasekhara Reddy ACA-VDCA Cricket Stadium, Visakhapatnam",
}


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((v is not None, v if v is not None else 0) for v in t))


def test_never_out_batter_has_null_average(spark):
    d = deliveries(spark, [ball(batter="A", batsman_runs=4), ball(batter="A", batsman_runs=2),
                           ball(batter="B", batsman_runs=1, is_wicket=1, dismissal_kind="bowled")])
    got = {r.batter: r for r in lb.top_runs(d).collect()}
    assert got["A"].Runs == 6 and got["A"].Average is None
    assert got["B"].Average == 1


def test_season_lead_tie_goes_to_lower_name_and_rank_keeps_both(spark):
    d = deliveries(spark, [ball(batter="Z", batsman_runs=6), ball(batter="M", batsman_runs=6),
                           ball(batter="Q", batsman_runs=1)])
    m = matches(spark, [match(id=1, season="2007/08")])
    one = se.season_top_batter(d, m).collect()
    assert [(r.batter, r.season, r["rank"]) for r in one] == [("M", "2007/08", 1)]
    both = se.season_top_batter(d, m, keep_ties=True)
    assert rows(both, "batter") == [("M",), ("Z",)]


def test_top10_boundary_tie_keeps_lower_name(spark):
    balls = []
    for i in range(9):                      # B0..B8 with 20 - i sixes
        balls += [ball(batter=f"B{i}", batsman_runs=6)] * (20 - i)
    balls += [ball(batter="Y", batsman_runs=6)] * 5 + [ball(batter="X", batsman_runs=6)] * 5
    top = lb.top_sixes(deliveries(spark, balls)).collect()
    assert len(top) == 10
    assert "X" in {r.batter for r in top} and "Y" not in {r.batter for r in top}


def test_running_score_peers_share_total_and_wides_are_excluded(spark):
    d = deliveries(spark, [
        ball(over=0, ball=1, batsman_runs=1),
        ball(over=0, ball=2, batsman_runs=2),
        ball(over=0, ball=2, batsman_runs=3),
        ball(over=0, ball=3, extra_runs=1, extras_type="wides"),
        ball(over=1, ball=1, batsman_runs=4),
        ball(inning=2, over=0, ball=1, batsman_runs=6),
    ])
    for skew_safe in (True, False):
        out = cl.with_running_score(cl.legal_deliveries(d), skew_safe=skew_safe)
        got = rows(out, "inning", "over", "ball", "batsman_runs", "runningScorePerInning")
        assert got == [(1, 0, 1, 1, 1), (1, 0, 2, 2, 6), (1, 0, 2, 3, 6), (1, 1, 1, 4, 10), (2, 0, 1, 6, 6)]


def test_running_score_with_null_order_keys(spark):
    d = deliveries(spark, [ball(over=None, ball=None, batsman_runs=2), ball(over=0, ball=1, batsman_runs=3)])
    for skew_safe in (True, False):
        got = rows(cl.with_running_score(d, skew_safe=skew_safe), "batsman_runs", "runningScorePerInning")
        assert got == [(2, 2), (3, 5)]      # NULLS FIRST in the frame order


def test_faceoff_variants_differ_on_ordinary_balls(spark):
    d = deliveries(spark, [
        ball(batter="A", bowler="X", batsman_runs=4),
        ball(batter="A", bowler="X", batsman_runs=0, is_wicket=1, dismissal_kind="caught"),
        ball(batter="A", bowler="X", batsman_runs=0, is_wicket=1, dismissal_kind="run out"),
    ])
    strict = fo.faceoff_summary(d).collect()
    assert [(r.Balls, r.Runs, r.Wickets, r.Batter_SR, r.Bowler_Avg) for r in strict] == [(1, 0, 1, 0.0, 0.0)]
    loose = fo.faceoff_summary(d, keep_non_dismissals=True).collect()
    assert [(r.Balls, r.Runs, r.Wickets, r.Batter_SR, r.Bowler_Avg) for r in loose] == [(2, 4, 1, 200.0, 4.0)]


def test_faceoff_pair_without_wicket_has_null_average(spark):
    d = deliveries(spark, [ball(batter="A", bowler="X", batsman_runs=4)])
    r = fo.faceoff_summary(d, keep_non_dismissals=True).collect()[0]
    assert r.Wickets == 0 and r.Bowler_Avg is None and r.Matches == 1


def test_run_out_not_credited_to_bowler_but_counts_elsewhere(spark):
    d = deliveries(spark, [
        ball(batter="A", bowler="X", is_wicket=1, dismissal_kind="run out", batsman_runs=1),
        ball(batter="A", bowler="X", is_wicket=1, dismissal_kind="bowled", batsman_runs=3),
    ])
    assert rows(lb.top_wickets(d), "bowler", "Total_Wickets") == [("X", 1)]
    assert [r.Average for r in lb.top_runs(d).collect()] == [2]       # 4 runs / 2 wickets
    wk = mx.team_phase_wkts_taken(cl.clean_deliveries(d)).collect()
    assert wk[0].Wickets == 24.0                                       # both balls are wickets


def test_caught_with_null_fielder_is_its_own_group(spark):
    d = deliveries(spark, [ball(is_wicket=1, dismissal_kind="caught", fielder=None),
                           ball(is_wicket=1, dismissal_kind="caught", fielder="F1"),
                           ball(is_wicket=1, dismissal_kind="caught", fielder="F1")])
    assert rows(lb.top_catches(d), "fielder", "Catches") == [(None, 1), ("F1", 2)]


def test_super_over_in_innings_totals_but_not_venue_average(spark):
    d = deliveries(spark, [ball(inning=1, total_runs=10, batsman_runs=10), ball(inning=2, batsman_runs=8),
                           ball(inning=3, batsman_runs=12)])
    m = matches(spark, [match(id=1)])
    assert rows(se.season_innings_totals(d, m), "inning", "Runs") == [(1, 10), (2, 8), (3, 12)]
    assert rows(ve.venue_innings_avg(d, m), "venue", "inning", "Average_Score") == [
        ("Eden Gardens, Kolkata", 1, 10), ("Eden Gardens, Kolkata", 2, 8)]


def test_powerplay_threshold_and_over_six(spark):
    balls = [ball(bowler="P", over=6, batsman_runs=1)] * 300 + [ball(bowler="Q", over=0)] * 299
    got = lb.powerplay_economy(deliveries(spark, balls)).collect()
    assert [(r.bowler, r.Economy_in_Powerplay, r.Overs_Bowled_in_Powerplay) for r in got] == [("P", 6.0, 50.0)]


def test_margin_categories_and_result_text(spark):
    cases = [("runs", 0, "No Result"), ("runs", 1, "Low"), ("runs", 49, "Low"), ("runs", 50, "Medium"),
             ("runs", 99, "Medium"), ("runs", 100, "High"), ("wickets", 3, "Low"), ("wickets", 4, "Medium"),
             ("wickets", 7, "Medium"), ("wickets", 8, "High"), (" Wickets", 9, "High"), ("tie", None, "No Result"),
             ("runs", None, "No Result")]
    m = matches(spark, [match(id=i, result=r, result_margin=mg) for i, (r, mg, _) in enumerate(cases)])
    got = {r.id: r.Win_Margin_Category for r in cl.with_win_margin_category(m).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]
    # the chase report uses the exact text: ' Wickets' is not a chase
    chase = ve.venue_max_chase(matches(spark, [match(id=1, result=" Wickets", target_runs=300),
                                               match(id=2, result="wickets", target_runs=200)]))
    assert rows(chase, "venue", "Highest_Chased_Total") == [("Eden Gardens, Kolkata", 200)]


def test_toss_winner_null_is_no(spark):
    m = matches(spark, [match(id=1, toss_winner=" T1", winner="t1 "), match(id=2, winner=None)])
    got = {r.id: r.Toss_Match_Winner for r in cl.with_toss_match_winner(m).collect()}
    assert got == {1: "Yes", 2: "No"}


def test_season_label_stays_text_and_order_list_filters_box(spark):
    d = deliveries(spark, [ball(match_id=1, batsman_runs=5), ball(match_id=2, batsman_runs=7)])
    m = matches(spark, [match(id=1, season="2007/08"), match(id=2, season="1999")])
    assert rows(se.season_innings_totals(d, m), "season") == [("1999",), ("2007/08",)]
    box = se.season_innings_box(d, m, seasons=SEASONS).collect()
    assert [(r.season, r.season_order, r.n) for r in box] == [("2007/08", 1, 1)]


def test_null_team_absent_from_matrix_but_in_all_teams_line(spark):
    d = deliveries(spark, [ball(batting_team=None, over=0, batsman_runs=6), ball(over=0, batsman_runs=0)])
    clean = cl.clean_deliveries(d)
    m = mx.run_rate_matrix(clean).collect()
    assert sorted(r.batting_team for r in m) == ["All_Teams", "Chennai Super Kings"]
    allrow = [r for r in m if r.batting_team == "All_Teams"][0]
    assert allrow["0"] == 18.0 and allrow["1"] is None


def test_box_whiskers_and_outliers(spark):
    vals = [50, 56, 60, 61, 62, 63, 64, 65, 120, 5]
    d = deliveries(spark, [ball(match_id=i, batsman_runs=v) for i, v in enumerate(vals)])
    m = matches(spark, [match(id=i) for i in range(len(vals))])
    r = se.season_innings_box(d, m).collect()[0]
    # linear quartiles: q1 = 57, median = 61.5, q3 = 63.75; fences 46.875 / 73.875
    assert (r.n, r["min"], r.q1, r.median, r.q3, r["max"]) == (10, 5, 57.0, 61.5, 63.75, 120)
    assert (r.whisker_lo, r.whisker_hi, r.outliers) == (50.0, 65.0, 2)


def test_team_aliases_canonicalised_and_panel_filter_uses_aliases(spark):
    d = deliveries(spark, [ball(batting_team="Kings XI Punjab", bowling_team="Royal Challengers Bangalore",
                                batsman_runs=6),
                           ball(batting_team="Punjab Kings", batsman_runs=0),
                           ball(batting_team="Deccan Chargers", batsman_runs=4)])
    clean = cl.clean_deliveries(d)
    teams = {r.batting_team for r in clean.collect()} | {r.bowling_team for r in clean.collect()}
    assert not teams & {"Kings XI Punjab", "Royal Challengers Bangalore"}
    assert {"Punjab Kings", "Royal Challengers Bengaluru"} <= teams
    got = mx.team_over_run_rate(d).collect()
    assert [(r.batting_team, r.Runs_Scored, r.Run_Rate) for r in got] == [("Punjab Kings", 6, 18.0)]


def test_high_impact_is_never_null(spark):
    d = deliveries(spark, [ball(total_runs=None, is_wicket=None), ball(total_runs=6), ball(is_wicket=1)])
    assert rows(cl.with_high_impact(d), "high_Impact") == [(False,), (True,), (True,)]


def test_date_parts(spark):
    import datetime as dt
    m = matches(spark, [match(date=dt.date(2024, 3, 22)), match(id=2, date=None)])
    got = rows(cl.match_date_parts(m), "id", "Year", "Month", "Day")
    assert got == [(1, 2024, 3, 22), (2, None, None, None)]


def test_division_by_zero_never_raises(spark):
    d = deliveries(spark, [ball(batsman_runs=None, total_runs=None, is_wicket=0)])
    r = fo.faceoff_summary(d, keep_non_dismissals=True).collect()[0]
    assert r.Balls == 0 and r.Batter_SR is None and r.Bowler_Avg is None
    assert lb.top_runs(d).collect()[0].Average is None


def test_venue_aliases_merge(spark):
    m = matches(spark, [match(id=1, venue="Feroz Shah Kotla", result="wickets", target_runs=180),
                        match(id=2, venue="Arun Jaitley Stadium", result="wickets", target_runs=190),
                        match(id=3, venue=None, result="wickets", target_runs=250)])
    assert rows(ve.venue_max_chase(m), "venue", "Highest_Chased_Total") == [("Arun Jaitley Stadium, Delhi", 190)]


def test_every_alias_by_its_literal_name(spark):
    m = matches(spark, [match(id=i, venue=v) for i, v in enumerate(VENUES)] + [match(id=99, venue="Brabourne Stadium")])
    got = {r.id: r.venue for r in cl.canonical_venues(m).collect()}
    assert [got[i] for i in range(len(VENUES))] == list(VENUES.values()) and got[99] == "Brabourne Stadium"
    d = deliveries(spark, [ball(ball=i, batting_team=t, bowling_team=t) for i, t in enumerate([*TEAMS, "Delhi Capitals"])])
    got = {r.ball: (r.batting_team, r.bowling_team) for r in cl.canonical_teams(d).collect()}
    assert [got[i] for i in range(4)] == [(t, t) for t in [*TEAMS.values(), "Delhi Capitals"]]


def test_every_excluded_dismissal_kind(spark):
    kinds = ["run out", "retired hurt", "hit wicket", "retired out", "obstructing the field", "bowled", "caught", "stumped", "lbw"]
    d = deliveries(spark, [ball(batter=k, is_wicket=1, dismissal_kind=k) for k in kinds])
    for keep in (False, True):
        got = {r.batter for r in fo.faceoff_summary(d, keep_non_dismissals=keep).collect()}
        assert got == {"bowled", "caught", "stumped", "lbw"}
    legal = deliveries(spark, [ball(batter=str(k), extras_type=k) for k in
                               ("wides", "noballs", "byes", "legbyes", "penalty", None)])
    assert {r.batter for r in cl.legal_deliveries(legal).collect()} == {"byes", "legbyes", "penalty", "None"}


def test_matrices_refuse_keys_off_their_list(spark):
    import pytest

    d = cl.clean_deliveries(deliveries(spark, [ball(over=3), ball(over=27, batsman_runs=6)]))
    for report, more in ((mx.run_rate_matrix, range(30)), (mx.conceded_matrix, range(30)),
                         (mx.wkts_taken_matrix, range(1, 9)), (mx.wkts_lost_matrix, range(1, 9))):
        with pytest.raises(Exception, match="is not a column of the matrix: (27|7)"):
            report(d).collect()
        wide = report(d, list(more)).collect()
        assert all(r["27" if len(more) == 30 else "7"] is not None for r in wide)


def test_results_come_in_their_order(spark):
    d = deliveries(spark, [ball(batting_team=t, bowling_team=t, over=o, batsman_runs=o)
                           for t in ("Mumbai Indians", "Gujarat Titans", "Punjab Kings") for o in (1, 0, 7)])
    clean = cl.clean_deliveries(d)
    down = [(t, o) for t in ("Punjab Kings", "Mumbai Indians", "Gujarat Titans") for o in (7, 1, 0)]
    assert [(r.batting_team, r.over) for r in mx.team_over_run_rate(d).collect()] == down
    assert [(r.bowling_team, r.over) for r in mx.conceded_long(clean).collect()] == down
    phases = [(t, o) for t in ("Punjab Kings", "Mumbai Indians", "Gujarat Titans") for o in (2, 1)]
    assert [(r.bowling_team, r.Overs) for r in mx.team_phase_wkts_taken(clean).collect()] == phases
    assert [(r.batting_team, r.Overs) for r in mx.team_phase_wkts_lost(clean).collect()] == phases
    teams = ["Gujarat Titans", "Mumbai Indians", "Punjab Kings"]
    assert [r.batting_team for r in mx.run_rate_matrix(clean).collect()] == ["All_Teams", *teams]
    assert [r.bowling_team for r in mx.conceded_matrix(clean).collect()] == teams
    m = matches(spark, [match(id=1, venue="V1", result="wickets", target_runs=150), match(id=2, venue="V0", result="wickets", target_runs=150),
                        match(id=3, venue="V2", result="wickets", target_runs=200)])
    assert [r.venue for r in ve.venue_max_chase(m).collect()] == ["V2", "V0", "V1"]
    s = matches(spark, [match(id=i, season=x) for i, x in enumerate(("2024", "2009/10", "1999", "2007/08", "2009"))])
    balls = deliveries(spark, [ball(match_id=i, batsman_runs=i) for i in range(5)])
    box = se.season_innings_box(balls, s, seasons=SEASONS).collect()
    assert [(r.season, r.season_order) for r in box] == [("2007/08", 1), ("2009", 2), ("2009/10", 3), ("2024", 17)]


def test_season_labels(spark):
    d = deliveries(spark, [ball(batter="A", bowler="X", batsman_runs=4, is_wicket=1, dismissal_kind="bowled")])
    m = matches(spark, [match(id=1, season="2009/10")])
    assert [r.Label for r in se.top_season_runs(d, m).collect()] == ["A in 2009/10"]
    assert [r.Label for r in se.top_season_wkts(d, m).collect()] == ["X in 2009/10"]
    assert [r.Label for r in se.season_top_batter(d, m).collect()] == ["A in 2009/10"]
    assert [r.Label for r in se.season_top_bowler(d, m).collect()] == ["X in 2009/10"]
    nobody = matches(spark, [match(id=1, season=None)])
    assert [r.Label for r in se.top_season_runs(d, nobody).collect()] == [None]


def test_any_order_can_change_a_match_report(spark):
    from crease.sources.adapter import from_tpch

    t = from_tpch(spark, "/root/testdata/sf0.001")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert t.matches.count() == orders.count()
    assert t.matches.select("id").exceptAll(orders.select("o_orderkey")).count() == 0
    assert dict(t.deliveries.dtypes)["match_id"] == dict(t.matches.dtypes)["id"] == "bigint"


def test_hot_innings_spreads_over_its_overs(spark):
    """Distinct (over, ball) in one innings: no task of the last window gets more
    than its overs' balls."""
    from pyspark.sql import functions as F

    base = deliveries(spark, [ball()])
    balls = (spark.range(40_000).withColumns({"over": (F.col("id") / 100).cast("int"), "ball": (F.col("id") % 100).cast("int")})
             .crossJoin(base.drop("over", "ball", "batsman_runs", "total_runs"))
             .withColumns({"batsman_runs": F.lit(1), "total_runs": F.lit(1)}).select(*base.columns))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        out = cl.with_running_score(balls)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert out.where(F.col("runningScorePerInning") != F.col("over") * 100 + F.col("ball") + 1).count() == 0
    finally:
        for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold",
                  "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)
    assert sum(sizes) == 40_000 and len(sizes) == 8 and max(sizes) <= 2 * 40_000 / 8
