"""Declared schemas of the two input tables (all fields nullable)."""

from __future__ import annotations

from pyspark.sql.types import DateType, IntegerType, LongType, StringType, StructField, StructType

_I, _L, _S = IntegerType(), LongType(), StringType()

DELIVERIES_SCHEMA = StructType([
    StructField("match_id", _L),
    StructField("inning", _I),
    StructField("batting_team", _S),
    StructField("bowling_team", _S),
    StructField("over", _I),
    StructField("ball", _I),
    StructField("batter", _S),
    StructField("bowler", _S),
    StructField("non_striker", _S),
    StructField("batsman_runs", _I),
    StructField("extra_runs", _I),
    StructField("total_runs", _I),
    StructField("extras_type", _S),
    StructField("is_wicket", _I),
    StructField("player_dismissed", _S),
    StructField("dismissal_kind", _S),
    StructField("fielder", _S),
])

MATCHES_SCHEMA = StructType([
    StructField("id", _L),
    StructField("season", _S),
    StructField("city", _S),
    StructField("date", DateType()),
    StructField("match_type", _S),
    StructField("player_of_match", _S),
    StructField("venue", _S),
    StructField("team1", _S),
    StructField("team2", _S),
    StructField("toss_winner", _S),
    StructField("toss_decision", _S),
    StructField("winner", _S),
    StructField("result", _S),
    StructField("result_margin", _I),
    StructField("target_runs", _I),
    StructField("target_overs", _I),
    StructField("super_over", _S),
    StructField("method", _S),
    StructField("umpire1", _S),
    StructField("umpire2", _S),
])

DELIVERY_COLUMNS = tuple(f.name for f in DELIVERIES_SCHEMA.fields)
MATCH_COLUMNS = tuple(f.name for f in MATCHES_SCHEMA.fields)
