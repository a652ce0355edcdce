"""CSV ingest: declared schema, null policy, strict header, parquet round trip."""

from __future__ import annotations

import tempfile

import pytest

from crease.plans import leaderboards as lb
from crease.plans import matrices as mx
from crease.sources import files
from crease.sources.schemas import DELIVERY_COLUMNS, MATCH_COLUMNS
from tests.plan_text import plan_text

HEADER = ",".join(DELIVERY_COLUMNS)


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def _csv_dir():
    return tempfile.mkdtemp(prefix="crease-csv-")


def test_na_and_empty_cell_are_both_null(spark):
    d = _csv_dir()
    _write(f"{d}/d.csv", HEADER + "\n"
           "1,1,Punjab Kings,Mumbai Indians,0,1,A,X,N,4,0,4,,0,,,\n"
           "1,1,Punjab Kings,Mumbai Indians,0,2,A,X,N,0,0,0,NA,0,NA,NA,NA\n")
    rows = files.read_deliveries_csv(spark, f"{d}/d.csv").collect()
    assert [r.extras_type for r in rows] == [None, None]
    assert [r.dismissal_kind for r in rows] == [None, None]
    # without the null policy, NA stays text in a string column
    raw = files.read_deliveries_csv(spark, f"{d}/d.csv", null_value=None).collect()
    assert [r.extras_type for r in raw] == [None, "NA"]


def test_strict_header_rejects_renamed_column(spark):
    d = _csv_dir()
    header = ",".join(["idX"] + list(MATCH_COLUMNS[1:]))
    _write(f"{d}/m.csv", header + "\n1,2020,C,2020-04-01,League,A,V,t1,t2,t1,bat,t1,runs,10,150,20,N,,U1,U2\n")
    with pytest.raises(Exception):
        files.read_matches_csv(spark, f"{d}/m.csv").collect()
    loose = files.read_matches_csv(spark, f"{d}/m.csv", strict_header=False).collect()
    assert loose[0].id == 1


def test_bad_number_becomes_null_in_permissive_mode(spark):
    d = _csv_dir()
    _write(f"{d}/d.csv", HEADER + "\nx,1,T,U,0,1,A,X,N,4,0,4,,0,,,\n")
    assert files.read_deliveries_csv(spark, f"{d}/d.csv").collect()[0].match_id is None


def test_ingest_to_parquet_round_trip_and_pushdown(spark):
    d = _csv_dir()
    _write(f"{d}/d.csv", HEADER + "\n"
           "1,1,Kings XI Punjab,Mumbai Indians,0,1,A,X,N,6,0,6,,0,,,\n"
           "1,1,Deccan Chargers,Mumbai Indians,0,2,B,X,N,4,0,4,,0,,,\n")
    _write(f"{d}/m.csv", ",".join(MATCH_COLUMNS) + "\n"
           "1,2020,C,2020-04-01,League,A,Eden Gardens,t1,t2,t1,bat,t1,runs,10,150,20,N,,U1,U2\n")
    t = files.ingest_csv(spark, f"{d}/d.csv", f"{d}/m.csv", f"{d}/tables")
    assert t.deliveries.count() == 2 and t.matches.count() == 1
    assert [r.Sixes_Hit for r in lb.top_sixes(t.deliveries).collect()] == [1]
    df = mx.team_over_run_rate(t.deliveries)
    plan = plan_text(df, "simple")
    assert "PushedFilters: [" in plan and "In(batting_team" in plan
    assert [(r.batting_team, r.Runs_Scored) for r in df.collect()] == [("Punjab Kings", 6)]


def test_ingest_counts_keys_that_did_not_parse(spark):
    d = _csv_dir()
    _write(f"{d}/d.csv", HEADER + "\n" + "x,1,T,U,0,1,A,X,N,4,0,4,,0,,,\n" + "1,1,T,U,NA,2,A,X,N,4,0,4,,0,,,\n"
           + "1,,T,U,z,3,A,X,N,4,0,4,,0,,,\n")
    _write(f"{d}/m.csv", ",".join(MATCH_COLUMNS) + "\nq,2020,C,2020-04-01,League,A,V,t1,t2,t1,bat,t1,runs,10,150,20,N,,U1,U2\n")
    got = files.ingest_csv(spark, f"{d}/d.csv", f"{d}/m.csv", f"{d}/tables")
    assert got.key_nulls == {"deliveries.match_id": 1, "deliveries.inning": 1, "deliveries.over": 2, "deliveries.ball": 0,
                             "matches.id": 1}
    assert {(r.table, r["rows"]) for r in files.key_nulls(got).collect()} == {("deliveries", 3), ("matches", 1)}


def test_keys_beyond_32_bits(spark):
    d = _csv_dir()
    _write(f"{d}/d.csv", HEADER + "\n5000000000,1,T,U,0,1,A,X,N,4,0,4,,0,,,\n")
    assert files.read_deliveries_csv(spark, f"{d}/d.csv").first().match_id == 5_000_000_000
