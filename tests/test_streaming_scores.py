"""Live scores equal the batch report after any file order, repeats and a restart."""

from __future__ import annotations

import datetime as dt
import itertools
import random
import tempfile

import pytest

from crease.plans import seasons as se
from crease.sources.schemas import DELIVERIES_SCHEMA
from crease.streaming import scores as sc
from crease.streaming.ingest import read_stream
from tests.fixtures import ball, deliveries, match, matches


def _games(spark, n=6):
    return matches(spark, [match(id=m, season=str(2020 + m % 2), date=dt.date(2020, 4, 1) + dt.timedelta(m)) for m in range(n)])


def _files(n=6, seed=1):
    """Balls of each match in three files; some balls stand in two files, some twice in one."""
    rng = random.Random(seed)
    out = []
    for m in range(n):
        balls = [ball(match_id=m, inning=i, over=o, ball=b, batter=rng.choice("ABC"), bowler="X", batsman_runs=rng.randint(0, 6),
                      is_wicket=int(rng.random() < 0.1), extras_type=rng.choice([None, "byes"]))
                 for i, o, b in itertools.product((1, 2), range(3), range(1, 7))]
        out += [balls[k::3] + balls[k:k + 2] for k in range(3)]
    return out


def _run(spark, landing, scores, root):
    query = sc.start(scores(read_stream(spark, landing, DELIVERIES_SCHEMA, "parquet"), _games(spark)), f"{root}/table", f"{root}/ckpt")
    query.awaitTermination(300)
    assert query.exception() is None
    return query


@pytest.mark.parametrize("seed", [1, 2])
def test_any_file_order_repeats_and_a_restart_equal_the_batch_report(spark, seed):
    root, files = tempfile.mkdtemp(prefix="crease-live-"), _files()
    random.Random(seed).shuffle(files)
    everything = deliveries(spark, [b for f in files for b in f]).distinct()
    half = len(files) // 2
    for part in (files[:half], files[half:] + files[:4]):               # the second run restarts, and sees repeats
        for balls in part:
            deliveries(spark, balls).coalesce(1).write.mode("append").parquet(f"{root}/landing")
        for name, scores in (("innings", sc.innings_scores), ("season", sc.season_runs)):
            assert sc.dropped(_run(spark, f"{root}/landing", scores, f"{root}/{name}")) == 0
    got = sc.board(spark, f"{root}/innings/table", ["day", "match_id", "inning"])
    want = everything.groupBy("match_id", "inning").agg({"total_runs": "sum", "is_wicket": "sum", "*": "count"})
    assert sorted((r.match_id, r.inning, r.Runs, r.Wickets, r.Balls) for r in got.collect()) == sorted(
        (r["match_id"], r["inning"], r["sum(total_runs)"], r["sum(is_wicket)"], r["count(1)"]) for r in want.collect())
    board = {(r.season, r.batter): r.Runs for r in sc.board(spark, f"{root}/season/table", ["season", "batter"]).collect()}
    assert board == {(r.season, r.batter): r[se.RUNS_SEASON] for r in se.season_runs(everything, _games(spark)).collect()}


def test_balls_behind_the_watermark_are_counted_as_dropped(spark):
    root, games = tempfile.mkdtemp(prefix="crease-live-"), matches(spark, [match(id=1, date=dt.date(2020, 1, 1)), match(id=2, date=dt.date(2021, 1, 1))])
    dropped = []
    for m in (2, 1, 2):                                                  # the first match comes a year late
        deliveries(spark, [ball(match_id=m, over=1, ball=1)]).coalesce(1).write.mode("append").parquet(f"{root}/landing")
        stream = read_stream(spark, f"{root}/landing", DELIVERIES_SCHEMA, "parquet")
        query = sc.start(sc.innings_scores(stream, games, delay="10 days"), f"{root}/table", f"{root}/ckpt")
        query.awaitTermination(300)
        dropped.append(sc.dropped(query))
    assert dropped[0] == 0 and dropped[1] == 1
    got = sc.board(spark, f"{root}/table", ["day", "match_id", "inning"]).collect()
    assert [(r.match_id, r.Balls) for r in got] == [(2, 1)]
