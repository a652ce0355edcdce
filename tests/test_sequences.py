"""As-of joins, interval joins, gaps and islands, whole-table ranks: brute force, skew and plans."""

from __future__ import annotations

import datetime as dt
import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crease.operators.asof import asof_join
from crease.operators.intervals import _cover, interval_join, levels_for
from crease.operators.islands import islands
from crease.operators.ranking import global_ranks
from crease.plans import sequences as sq
from tests.conftest import SF_SMALL
from tests.fixtures import ball, deliveries
from tests.plan_text import plan_text


@pytest.fixture
def spread(spark):
    """Shuffles keep their eight partitions and every join is a shuffle join."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def by_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


# ------------------------------------------------------------------ as-of
def brute_asof(left, right, strict):
    out = []
    for i, k, t in left:
        best = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None
                and (r[1] < t if strict else r[1] <= t)]
        r = max(best, key=lambda r: (r[1], r[2]), default=(None, None, None))
        out.append((i, k, t, r[1], r[2]))
    return sorted(out, key=str)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("width", [1, 7, 1000])
def test_asof_equals_brute_force(spark, strict, width):
    rng = random.Random(width)
    left = [(i, rng.choice([None, "a", "b", "hot", "hot", "hot"]), rng.choice([None, rng.randint(-60, 60)])) for i in range(300)]
    right = [(rng.choice([None, "a", "hot", "c"]), rng.choice([None, rng.randint(-60, 60)]), v) for v in range(80)]
    got = asof_join(spark.createDataFrame(left + left[:3], "i long, k string, t long"), spark.createDataFrame(right, "k string, u long, v long"),
                    ["k"], "t", "u", {"u": "u", "v": "v"}, width, tie=["v"], strict=strict)
    assert got.columns == ["i", "k", "t", "u", "v"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_asof(left + left[:3], right, strict)


def test_asof_empty_sides_timestamps_and_clashing_names(spark):
    left = spark.createDataFrame([(1, dt.datetime(2024, 5, 1, 12), 5)], "_bucket long, t timestamp, _row long")
    right = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "x")], "_bucket long, t timestamp, v string")
    call = lambda a, b: asof_join(a, b, ["_bucket"], "t", "t", {"v": "v"}, width=3600).collect()
    assert [tuple(r) for r in call(left, right)] == [(1, dt.datetime(2024, 5, 1, 12), 5, "x")]
    assert call(left, right.limit(0))[0].v is None and call(left.limit(0), right) == []


def test_asof_splits_a_hot_key_and_rows_that_match_nothing(spark, spread):
    n = 24_000
    left = spark.range(n).select(F.lit(1).alias("k"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("t"), "id")
    right = spark.range(0, n, 50).select(F.lit(1).alias("k"), F.col("id").alias("u"))
    out = asof_join(left, right, ["k"], "t", "u", {"u": "u"}, width=100)
    sizes = by_task(out)
    assert sum(sizes) == n and len(sizes) == 8 and max(sizes) < 2 * n / 8
    assert out.where("t IS NOT NULL AND u <> t - t % 50 OR t IS NULL AND u IS NOT NULL").count() == 0


def test_asof_shuffles_rows_once_and_joins_on_equal_keys(spark, spread):
    left = spark.createDataFrame([(1, 5)], "k long, t long")
    plan = plan_text(asof_join(left, left.withColumnRenamed("t", "u"), ["k"], "t", "u", {"u": "u"}, width=10), "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = plan[plan.index("SortMergeJoin"):plan.index("Union")]             # the join takes the rows as the window left them
    assert rows.count("Exchange hashpartitioning") == 1 and plan.count("Exchange hashpartitioning") == 4


# -------------------------------------------------------------- intervals
def test_cover_has_every_unit_once_in_few_bins(spark):
    rng = random.Random(1)
    spans = [(a, a + rng.choice([0, 1, 15, 16, 17, 255, 300, 5000])) for a in [rng.randint(-5000, 5000) for _ in range(60)]]
    df = spark.createDataFrame(spans, "lo long, hi long").select("lo", "hi", _cover(F.col("lo"), F.col("hi"), 4).alias("b"))
    for r in df.collect():
        units = [u for level, b in r.b for u in range(b * 16 ** level, (b + 1) * 16 ** level)]
        assert sorted(units) == list(range(r.lo, r.hi + 1)) and len(r.b) <= 8 * 15


def brute_interval(points, spans):
    return sorted(((*p, *s[1:]) for p in points for s in spans
                   if p[0] is not None and p[0] == s[0] and None not in (p[1], s[1], s[2]) and s[1] <= p[1] <= s[2]), key=str)


@pytest.mark.parametrize("levels", [1, 3])
def test_interval_join_equals_brute_force_with_one_interval_over_everything(spark, levels):
    rng = random.Random(levels)
    points = [(rng.choice(["a", "hot", "hot", None]), rng.choice([None, rng.randint(-400, 400)]), i // 2) for i in range(300)]
    spans = [(rng.choice(["a", "hot", None]), lo, lo + rng.choice([-1, 0, 3, 90])) for lo in [rng.randint(-400, 400) for _ in range(60)]]
    spans += [("hot", -10_000, 10_000), ("a", None, 5), ("a", 5, None), spans[0], ("hot", 7, 7)]
    got = interval_join(spark.createDataFrame(points, "k string, x long, i long"), spark.createDataFrame(spans, "k string, lo long, hi long"),
                        ["k"], "x", "lo", "hi", levels)
    assert got.columns == ["k", "x", "i", "lo", "hi"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_interval(points, spans)


def test_interval_join_of_doubles_dates_and_without_keys(spark):
    rng = random.Random(2)
    points = [(1, rng.uniform(-50, 50)) for _ in range(200)] + [(1, 2.5), (1, -3.0)]
    spans = [(1, lo, lo + rng.uniform(0, 20)) for lo in [rng.uniform(-50, 50) for _ in range(30)]] + [(1, 2.5, 2.5), (1, -3.0, 7.0)]
    for unit in (0.25, 4.0):
        got = interval_join(spark.createDataFrame(points, "k long, x double"), spark.createDataFrame(spans, "k long, lo double, hi double"),
                            ["k"], "x", "lo", "hi", 3, unit)
        assert sorted(map(tuple, got.collect()), key=str) == brute_interval(points, spans)
    days = [(dt.date(2020, 1, 1) + dt.timedelta(d),) for d in range(0, 900, 7)]
    whole = spark.createDataFrame([(dt.date(2020, 2, 1), dt.date(2021, 3, 4))], "lo date, hi date")
    got = interval_join(spark.createDataFrame(days, "x date"), whole, [], "x", "lo", "hi", levels_for(900))
    assert got.count() == sum(dt.date(2020, 2, 1) <= d <= dt.date(2021, 3, 4) for d, in days)
    assert interval_join(spark.createDataFrame(days, "x date").limit(0), whole, [], "x", "lo", "hi", 2).count() == 0
    with pytest.raises(ValueError):
        interval_join(whole, whole, [], "lo", "lo", "hi", 0)


def test_a_wide_interval_over_a_hot_key_is_no_single_task(spark, spread):
    n = 24_000
    points = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("x"))
    wide = spark.createDataFrame([(1, 0, 16 ** 4 - 1)], "k int, lo long, hi long")       # one bin of the widest width
    out = interval_join(points, wide, ["k"], "x", "lo", "hi", 5)
    sizes = by_task(out)
    assert sum(sizes) == n and max(sizes) <= 0.45 * n                                    # 16 parts over 8 tasks
    plan = plan_text(out, "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# ---------------------------------------------------------------- islands
def brute_islands(rows, use_state, use_ends):
    out = []
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    rows = sorted(rows, key=lambda r: (key(r[:1]), key(r[1:3]), r[5]))
    for p, group in itertools.groupby(rows, key=lambda r: r[0]):
        island, last = [], None
        for r in [*group, None]:
            new = last is not None and r is not None and ((use_state and r[3] != last[3]) or (use_ends and last[4] is True))
            if island and (new or r is None):
                out.append((p, *([island[0][3]] if use_state else []), len(island), sum(x[5] for x in island), max(x[5] for x in island)))
                island = []
            if r is not None:
                island.append(r)
                last = r
    return sorted(out, key=str)


@pytest.mark.parametrize("use_state, use_ends", [(True, False), (False, True), (True, True), (False, False)])
def test_islands_equal_brute_force(spark, use_state, use_ends):
    rng = random.Random(use_state + 2 * use_ends)
    rows = [(rng.choice([None, 1, 2, 2, 2]), rng.choice([None, *range(12)]), rng.randint(0, 5), rng.choice(["x", "x", "y", None]),
             rng.choice([True, False, False, None]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "p long, b long, o long, s string, e boolean, v long")
    got = islands(df, ["p"], "b", ["o", "v"], {"n": ("count", None), "total": ("sum", F.col("v")), "most": ("max", F.col("v"))},
                  state=["s"] if use_state else [], ends=F.col("e") if use_ends else None)
    assert sorted(map(tuple, got.collect()), key=str) == brute_islands(rows, use_state, use_ends)
    assert islands(df.limit(0), ["p"], "b", ["o"], {"n": ("count", None)}).count() == 0


def test_an_island_runs_through_many_blocks_and_a_block_has_many(spark):
    balls = [ball(over=o, ball=b, bowler="X" if o != 5 or b % 2 else "Y") for o in range(12) for b in range(1, 7)]
    got = sorted((r.first_seq, r.last_seq, r.bowler, r.Balls) for r in sq.bowling_spells(deliveries(spark, balls)).collect())
    middle = [(500 + b, 500 + b, "XY"[b % 2 == 0], 1) for b in range(2, 7)]
    assert got == [(1, 501, "X", 31), *middle, (601, 1106, "X", 36)]


def test_partnerships_end_with_the_wicket_ball(spark):
    balls = [ball(over=o, ball=b, batsman_runs=1, is_wicket=int((o, b) in ((0, 6), (3, 2), (3, 3)))) for o in range(5) for b in range(1, 7)]
    got = sorted((r.first_seq, r.last_seq, r.Balls, r.Runs, r.Ended) for r in sq.partnerships(deliveries(spark, balls)).collect())
    assert got == [(1, 6, 6, 6, 1), (101, 302, 14, 14, 1), (303, 303, 1, 1, 1), (304, 406, 9, 9, 0)]


def test_a_hot_innings_spreads_over_its_blocks_and_is_shuffled_once(spark, spread):
    n = 24_000
    df = spark.range(n).select((F.col("id") >= 0).alias("p"), (F.col("id") / 60).cast("int").alias("b"), F.col("id").alias("o"),
                               (F.col("id") / 7).cast("int").alias("s"))
    out = islands(df, ["p"], "b", ["o"], {"n": ("count", None)}, state=["s"])
    assert out.agg(F.sum("n")).first()[0] == n and out.count() == -(-n // 7)
    blocks = df.repartition(8, "p", "b")                                   # as the operator deals them
    assert max(by_task(blocks)) < 2 * n / 8
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and "SinglePartition" not in plan and "Join" not in plan
    edges = df.select("p", "b").distinct().count() * 2                     # what the partition's own task gathers
    assert edges < n / 25


# ------------------------------------------------------------------ ranks
def check_ranks(spark, rows, tiles, descending, blocks):
    df = spark.createDataFrame(rows, "v long, id long, other string")
    df.createOrReplaceTempView("ranked_rows")
    got = global_ranks(df, "v", ["id", "other"], tiles, descending, dense=True, blocks=blocks)
    by = "v DESC NULLS LAST" if descending else "v ASC NULLS FIRST"
    each = f"{by}, id ASC NULLS FIRST, other ASC NULLS FIRST"
    want = spark.sql(f"""SELECT v, id, other, CAST(row_number() OVER (ORDER BY {each}) AS LONG), CAST(rank() OVER (ORDER BY {by}) AS LONG),
        CAST(dense_rank() OVER (ORDER BY {by}) AS LONG), percent_rank() OVER (ORDER BY {by}), cume_dist() OVER (ORDER BY {by}),
        CAST(ntile({tiles}) OVER (ORDER BY {each}) AS LONG) FROM ranked_rows""")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("blocks", [2, 16])
def test_ranks_equal_sql_with_nulls_and_hot_values(spark, descending, blocks):
    rng = random.Random(blocks)
    rows = [(rng.choice([None, 7, 7, 7, rng.randint(-20, 20), 2 ** 60 + rng.randint(0, 3)]), rng.choice([None, i]), str(i)) for i in range(400)]
    check_ranks(spark, rows, 7, descending, blocks)


@pytest.mark.parametrize("rows", [[], [(5, 1, "a")], [(None, None, None)] * 3, [(4, i, "a") for i in range(9)]])
def test_ranks_of_few_rows_and_of_one_value(spark, rows):
    check_ranks(spark, rows, 100, False, 16)


def test_a_value_with_most_rows_is_ranked_by_many_tasks(spark, spread):
    n = 24_000
    df = spark.range(n).select(F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id")).alias("v"), "id")
    out = global_ranks(df, "v", ["id"], blocks=64)
    sizes = by_task(out)
    assert sum(sizes) == n and max(sizes) < 2 * n / 8
    assert out.agg(F.count_distinct("row_number"), F.min("row_number"), F.max("row_number")).first() == (n, 1, n)


def test_ranks_use_no_window_over_the_whole_table(spark):
    logical = global_ranks(spark.range(10).withColumn("v", F.col("id") % 3), "v", ["id"], dense=True)._jdf.queryExecution().analyzed().toString()
    for window in re.findall(r"windowspecdefinition\(([^)]*)", logical):
        assert window.startswith("_block#"), window


# ---------------------------------------------------------------- reports
def test_last_wicket_is_strictly_earlier_and_of_the_same_innings(spark):
    balls = [ball(over=0, ball=1, is_wicket=1, player_dismissed="P"), ball(over=0, ball=1), ball(over=0, ball=2), ball(over=4, ball=1),
             ball(over=4, ball=1, inning=2)]
    got = {(r.inning, r.over, r.ball): (r.last_out, r.wicket_seq) for r in sq.last_wicket(deliveries(spark, balls)).collect()}
    assert got == {(1, 0, 1): (None, -1), (1, 0, 2): ("P", 1), (1, 4, 1): ("P", 1), (2, 4, 1): (None, -1)}


def test_award_spans_count_matches_once(spark):
    from crease.sources.adapter import from_tpch

    matches = from_tpch(spark, SF_SMALL).matches
    days = [(r.player_of_match, r.date) for r in matches.select("player_of_match", "date").collect()]
    spans = Counter()
    for p in {p for p, _ in days}:
        own = [d for q, d in days if q == p]
        spans[p] = sum(min(own) <= d <= max(own) for _, d in days)
    assert {r.player_of_match: r.Matches for r in sq.award_spans(matches).collect()} == spans
