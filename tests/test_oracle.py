"""Every registered report equals its DuckDB oracle (names, types, rows)."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from crease.plans.catalog import QUERIES
from tools.compare_oracle import compare

from tests.conftest import SF_ORACLE, SF_SMALL

NAMES = sorted(QUERIES)


def test_every_report_has_an_oracle():
    assert set(NAMES) <= set(oracle_sql()) and set(oracle_sql()) <= set(queries())


def test_entry_smoke(spark):
    df = entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert df.columns == ["batter", "Runs", "No_Of_Matches", "Average"]


@pytest.mark.parametrize("sf_dir", [SF_SMALL, SF_ORACLE])
@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, name, sf_dir):
    res = compare(spark, sf_dir, [name], verbose=False)[name]
    status, n, ok_cols, ok_types, ok_n, exact, _, via_pandas = res
    assert ok_cols, "column names differ"
    assert ok_types, "column types differ"
    assert ok_n, "row counts differ"
    assert exact, "row values differ"
    assert via_pandas, "row values differ when read through pandas"


LAYOUT_SENSITIVE = ["top_runs", "season_top_batter", "season_top_bowler_ties", "faceoff_batter",
                    "boundary_boards", "season_innings_box", "running_score", "run_rate_matrix"]


def test_results_do_not_depend_on_physical_layout(spark):
    """Same rows with AQE off and 200 shuffle partitions (ties, top-k and windows
    must be resolved by the data, not by task order)."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        res = compare(spark, SF_ORACLE, LAYOUT_SENSITIVE, verbose=False)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert all(v[0] == "OK" and v[7] for v in res.values()), res
