"""Sketches within their error, cubes from small parents, snapshot differences: brute force and plans."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crease.operators import sketches as sk
from crease.operators.cube import cube, lattice
from crease.operators.snapshots import classify, partial_sums, refresh, snapshot_diff
from crease.plans import summaries as su
from crease.sources.adapter import from_tpch
from tests.conftest import SF_SMALL
from tests.plan_text import plan_text


# --------------------------------------------------------------- distinct sets
def test_small_sets_are_exact_on_every_rollup_and_nulls_do_not_count(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, 3]), rng.choice([None, *range(40)])) for _ in range(500)]
    df = spark.createDataFrame(rows, "t string, s long, v long")
    fine = sk.distinct_sketches(df, ["t", "s"], F.col("v"))
    got = {(r.t, r.s, r.level): r.n for r in sk.distinct_rollups(fine, ["t", "s"], [["t", "s"], ["t"], ["s"], []], "n").collect()}
    want = {}
    for t, s, v in rows:
        for key in ((t, s, 0), (t, None, 1), (None, s, 2), (None, None, 3)):
            want.setdefault(key, set()).add(v)
    assert got == {k: len(v - {None}) for k, v in want.items()}


def test_large_sets_stay_within_the_stated_error_on_all_rollups(spark):
    lg, n = 10, 60_000
    df = spark.range(n).select((F.col("id") % 4).alias("t"), (F.col("id") % 3).alias("s"), (F.col("id") * 7919 % 50_021).alias("v"))
    exact = {(r.t, r.s): r.n for r in df.cube("t", "s").agg(F.count_distinct("v").alias("n")).collect()}
    fine = sk.distinct_sketches(df, ["t", "s"], F.col("v"), lg)
    found = sk.distinct_rollups(fine, ["t", "s"], [["t", "s"], ["t"], ["s"], []], "n", lg).collect()
    assert len(found) == len(exact) == 20
    assert all(abs(r.n / exact[r.t, r.s] - 1) <= 4 * sk.distinct_error(lg) for r in found)


def test_set_operations_within_the_error_of_the_union(spark):
    lg = 11
    df = spark.range(40_000).select(F.when(F.col("id") < 25_000, "a").otherwise("b").alias("side"), F.col("id").alias("v"))
    both = df.union(spark.range(15_000, 25_000).select(F.lit("b"), "id"))
    a, b = (sk.distinct_sketches(both.where(F.col("side") == s), [], F.col("v"), lg).withColumnRenamed("sketch", s) for s in "ab")
    counts = sk.distinct_overlap(F.col("a"), F.col("b"), lg)
    got = a.crossJoin(b).select(*[c.alias(n) for n, c in counts.items()]).first()
    for name, exact in (("either", 40_000), ("both", 10_000), ("left_only", 15_000)):
        assert abs(got[name] - exact) <= 4 * sk.distinct_error(lg) * 40_000


# ------------------------------------------------------------------- quantiles
def test_quantiles_within_the_rank_error_after_merging(spark):
    k, n = 512, 50_000
    df = spark.range(n).select((F.col("id") % 20).alias("part"), F.pow(F.col("id") * 7919 % n, 1.5).alias("v"))
    merged = sk.merge_quantiles(sk.quantile_sketches(df, ["part"], "v", k), [], k)
    got = sk.box_from_sketches(merged, []).first()
    values = sorted(r.v for r in df.collect())
    for share, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
        assert abs(values.index(got[name]) / n - share) <= 2 * sk.rank_error(k)
    assert (got.n, got.min, got.max) == (n, values[0], values[-1])
    assert max(len(r.sketch) for r in merged.collect()) < 40 * k        # constant, whatever n


def test_small_groups_are_exact_with_whiskers_and_outliers(spark):
    values = [1.0, 2.0, 2.0, 3.0, 4.0, 4.0, 5.0, 50.0, -40.0, None]
    df = spark.createDataFrame([("g", v) for v in values] + [("none", None)], "g string, v double")
    got = {r.g: r for r in sk.box_from_sketches(sk.quantile_sketches(df, ["g"], "v"), ["g"]).collect()}
    r = got["g"]
    assert (r.n, r.min, r.q1, r.median, r.q3, r.max) == (9, -40.0, 2.0, 3.0, 4.0, 50.0)
    assert (r.whisker_lo, r.whisker_hi, r.outliers) == (1.0, 5.0, 2)
    assert got["none"].n == 0 and got["none"].median is None
    assert sk.box_from_sketches(sk.quantile_sketches(df.limit(0), ["g"], "v"), ["g"]).count() == 0


# ------------------------------------------------------------------------ cube
def test_each_cuboid_comes_from_its_smallest_parent():
    found = lattice({"a": 100, "b": 2, "c": 10})
    assert found[("a", "b", "c")] is None and len(found) == 8
    assert found[("a",)] == ("a", "b") and found[("c",)] == ("b", "c") and found[("b",)] == ("b", "c") and found[()] == ("b",)


def test_cube_equals_sql_with_null_values(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["x", None]), rng.choice([1, 2, None]), rng.choice(["p", "q"]), rng.choice([None, rng.randint(0, 9)])) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b long, c string, v long")
    df.createOrReplaceTempView("cube_rows")
    got = cube(df, {"a": 2, "b": 3, "c": 2}, {"n": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")})
    want = spark.sql("SELECT a, b, c, grouping_id() AS level, count(v) AS n, sum(v) AS s, min(v) AS lo, max(v) AS hi "
                     "FROM cube_rows GROUP BY CUBE (a, b, c)")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    empty = cube(df.limit(0), {"a": 2, "b": 3, "c": 2}, {"n": ("count", "v")}).collect()
    assert [tuple(r) for r in empty] == [(None, None, None, 7, 0)]


def test_cube_reads_and_shuffles_the_rows_once(spark):
    t = from_tpch(spark, SF_SMALL)
    out = su.scoring_cube(t.deliveries, t.matches)
    assert "Expand" not in plan_text(out, "simple")
    out.collect()
    ran = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert ran.count("ReusedExchange") >= 8


# ------------------------------------------------------------------- snapshots
ROWS = "k long, a string, b double"


def random_rows(seed, n=200):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(20)]), rng.choice([None, "", "x", "null", '"x"', "x,y"]), rng.choice([None, 0.5, 2.0])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_difference_equals_a_multiset_difference(spark, seed):
    old, new = random_rows(seed), random_rows(seed)[:150] + random_rows(seed + 50, 60)
    diff = snapshot_diff(spark.createDataFrame(old, ROWS).select("b", "k", "a"), spark.createDataFrame(new, ROWS))
    want = {row: n for row, n in ((r, Counter(new)[r] - Counter(old)[r]) for r in {*old, *new}) if n}
    assert {tuple(r)[:3]: r._delta for r in diff.collect()} == want
    changes = {r.k: (r.change, r.added, r.removed) for r in classify(diff, ["k"]).collect()}
    for key, (change, added, removed) in changes.items():
        assert added == sum(n for r, n in want.items() if r[0] == key and n > 0)
        assert removed == -sum(n for r, n in want.items() if r[0] == key and n < 0)
        assert change == ("added" if not removed else "removed" if not added else "changed")
    assert set(changes) == {r[0] for r in want}


def test_equal_exports_and_empty_ones(spark):
    rows = spark.createDataFrame(random_rows(4), ROWS)
    assert snapshot_diff(rows, rows.orderBy("b")).count() == 0
    assert sum(r._delta for r in snapshot_diff(rows.limit(0), rows).collect()) == 200
    assert sum(r._delta for r in snapshot_diff(rows, rows.limit(0)).collect()) == -200
    with pytest.raises(ValueError, match="differ"):
        snapshot_diff(rows.drop("a"), rows)


def test_refreshed_sums_equal_a_full_run_over_many_exports(spark):
    measures = {"total": F.col("b") * 2, "n": F.lit(1)}
    exports = [spark.createDataFrame(random_rows(s, 120), ROWS) for s in (7, 8, 9)] + [spark.createDataFrame([], ROWS)]
    kept = partial_sums(exports[0], ["k", "a"], measures)
    for old, new in itertools.pairwise(exports):
        kept = refresh(kept, snapshot_diff(old, new), ["k", "a"], measures)
        full = partial_sums(new, ["k", "a"], measures)
        assert Counter(map(tuple, kept.collect())) == Counter(map(tuple, full.collect()))


def test_only_hashes_are_compared_and_planning_is_quick(spark):
    import time

    t = from_tpch(spark, SF_SMALL)
    began = time.monotonic()
    plan = plan_text(su.match_changes(t.deliveries), "simple")
    assert time.monotonic() - began < 20
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
