"""In-memory micro tables for edge cases (one helper per table)."""

from __future__ import annotations

import datetime as dt

from crease.sources.adapter import Tables
from crease.sources.schemas import DELIVERIES_SCHEMA, MATCHES_SCHEMA, DELIVERY_COLUMNS, MATCH_COLUMNS

BALL_DEFAULTS = dict(
    match_id=1, inning=1, batting_team="Chennai Super Kings", bowling_team="Mumbai Indians",
    over=0, ball=1, batter="A", bowler="X", non_striker="N", batsman_runs=0, extra_runs=0,
    total_runs=0, extras_type=None, is_wicket=0, player_dismissed=None, dismissal_kind=None, fielder=None,
)
MATCH_DEFAULTS = dict(
    id=1, season="2020", city="C", date=dt.date(2020, 4, 1), match_type="League", player_of_match="A",
    venue="Eden Gardens", team1="t1", team2="t2", toss_winner="t1", toss_decision="bat", winner="t1",
    result="runs", result_margin=10, target_runs=150, target_overs=20, super_over="N", method=None,
    umpire1="U1", umpire2="U2",
)


def ball(**kw):
    row = {**BALL_DEFAULTS, **kw}
    if "total_runs" not in kw:
        row["total_runs"] = row["batsman_runs"] + row["extra_runs"]
    return tuple(row[c] for c in DELIVERY_COLUMNS)


def match(**kw):
    row = {**MATCH_DEFAULTS, **kw}
    return tuple(row[c] for c in MATCH_COLUMNS)


def deliveries(spark, rows):
    return spark.createDataFrame(rows, DELIVERIES_SCHEMA)


def matches(spark, rows):
    return spark.createDataFrame(rows, MATCHES_SCHEMA)


def tables(spark, balls, games=None):
    games = games if games is not None else [match()]
    return Tables(deliveries(spark, balls), matches(spark, games))
