"""Nested match records give the tables that flat ones give; bad records are kept apart."""

from __future__ import annotations

import itertools
import json
from collections import Counter

import pytest

from crease.plans.catalog import QUERIES
from crease.sources.nested import IN_BALL, IN_INNINGS, audit, read_nested
from crease.sources.schemas import DELIVERY_COLUMNS, MATCH_COLUMNS
from tests.fixtures import ball, match, tables


def nest(balls, games):
    """Records as an exporter writes them, balls in the order given."""
    rows = [dict(zip(DELIVERY_COLUMNS, b)) for b in balls]
    out = []
    for game in games:
        record = dict(zip(MATCH_COLUMNS, game))
        own = [r for r in rows if r["match_id"] == record["id"]]
        record["innings"] = [
            {**dict(zip(IN_INNINGS, key)), "overs": [{"over": o, "balls": [{c: r[c] for c in IN_BALL} for r in group]}
                                                    for o, group in itertools.groupby(list(inn), key=lambda r: r["over"])]}
            for key, inn in itertools.groupby(own, key=lambda r: tuple(r[c] for c in IN_INNINGS))]
        out.append(record)
    return out


BALLS = [ball(match_id=m, inning=i, over=o, ball=b, batsman_runs=(m + o + b) % 7, is_wicket=int(b == 3),
              dismissal_kind="bowled" if b == 3 else None, batter="AB"[b % 2])
         for m, i, o, b in itertools.product((1, 2), (1, 2), range(3), range(1, 5))]
GAMES = [match(id=1), match(id=2, season="2021", winner=None), match(id=3)]


def write(path, lines):
    path.mkdir()
    (path / "matches.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x, default=str) for x in lines))
    return str(path)


def rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture
def flat(spark):
    return tables(spark, BALLS, GAMES)


def test_json_and_parquet_records_equal_the_flat_tables(spark, flat, tmp_path):
    records = nest(BALLS, GAMES)
    as_json = read_nested(spark, write(tmp_path / "j", records))
    as_json.records.drop("_record", "_file").write.parquet(f"{tmp_path}/p")
    for got in (as_json, read_nested(spark, f"{tmp_path}/p", "parquet")):
        assert got.deliveries.schema == flat.deliveries.schema and got.matches.schema == flat.matches.schema
        assert rows(got.deliveries) == rows(flat.deliveries) and rows(got.matches) == rows(flat.matches)
        assert got.bad.count() == 0
        assert audit(got).first().asDict() == {"records": 3, "bad": 0, "matches": 3, "no_innings": 1, "innings": 4, "no_overs": 0,
                                               "overs": 12, "no_balls": 0, "balls": 48}
        for name in ("top_runs", "season_innings_totals", "partnerships"):
            assert rows(QUERIES[name](got)) == rows(QUERIES[name](flat)), name


def test_places_follow_the_record(spark, tmp_path):
    got = read_nested(spark, write(tmp_path / "j", nest(BALLS, GAMES))).sequence.where("match_id = 2").collect()
    order = sorted(got, key=lambda r: (r.innings_at, r.over_at, r.ball_at))
    assert [(r.inning, r.over, r.ball) for r in order] == [(i, o, b) for i in (1, 2) for o in range(3) for b in range(1, 5)]


def test_bad_records_are_rows_of_their_own_and_nothing_is_lost(spark, tmp_path):
    good = nest(BALLS, GAMES)[:1]
    wrong_type = {**good[0], "id": "not a number"}
    lines = [good[0], '{"id": 5, "season": ', json.dumps(wrong_type, default=str), json.dumps({"season": "2020"}), "", "[]", "[]x"]
    got = read_nested(spark, write(tmp_path / "j", lines))
    bad = got.bad.collect()
    assert Counter(r.reason for r in bad) == {"does not parse": 4, "no id": 1}
    assert all(r.file.endswith("matches.json") and r.record for r in bad)
    assert got.matches.count() == 1 and got.deliveries.count() == 24
    count = audit(got).first()
    assert (count.records, count.bad, count.matches, count.balls) == (6, 5, 1, 24)


def test_null_and_empty_levels_and_unknown_fields(spark, tmp_path):
    lines = [{"id": 1, "innings": None}, {"id": 2, "innings": [], "new": 1}, {"id": 3, "innings": [{"inning": 1, "overs": None}, {"inning": 2, "overs": [
        {"over": 0, "balls": []}, {"over": 1, "balls": [None, {"ball": 1, "batter": "A", "speed": 140}]}]}]}, {"id": 1, "innings": []}]
    got = read_nested(spark, write(tmp_path / "j", lines))
    assert sorted((r.match_id, r.inning, r.over, str(r.ball), str(r.batter)) for r in got.deliveries.collect()) == [
        (3, 2, 1, "1", "A"), (3, 2, 1, "None", "None")]
    assert got.matches.count() == 4
    assert audit(got).first().asDict() == {"records": 4, "bad": 0, "matches": 4, "no_innings": 3, "innings": 2, "no_overs": 1, "overs": 2,
                                           "no_balls": 1, "balls": 2}
