"""Project the driver's order tables onto the two ball-by-ball tables.

The test data has no cricket tables, so ``lineitem`` (one row per line) stands
in for deliveries and ``orders`` for matches: every line is a delivery, every
order is a match, and a line's match is its order.

Each column is one SQL expression accepted as written by Spark SQL and by
DuckDB; the same text builds the oracle's CTEs (``oracle_ctes``) and, except
for one column written as a map lookup (see ``_SPARK_EXPRS``), the Spark
frames (``from_tpch``).  Both projections are narrow (no shuffle); the
parquet reader only fetches the seven ``lineitem`` / five ``orders`` columns
the expressions use.  A file's column types are looked up once per process;
its file list is read anew for every frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .schemas import DELIVERIES_SCHEMA, MATCHES_SCHEMA

# Team names assigned round-robin by supplier (includes old aliases on purpose).
_TEAMS = (
    "Kings XI Punjab", "Punjab Kings", "Royal Challengers Bangalore",
    "Royal Challengers Bengaluru", "Rising Pune Supergiant", "Rising Pune Supergiants",
    "Sunrisers Hyderabad", "Chennai Super Kings", "Kolkata Knight Riders",
    "Delhi Capitals", "Mumbai Indians", "Gujarat Titans", "Lucknow Super Giants",
    "Rajasthan Royals",
)
_VENUES = (
    "M Chinnaswamy Stadium", "M.Chinnaswamy Stadium", "Eden Gardens", "Feroz Shah Kotla",
    "Arun Jaitley Stadium", "Wankhede Stadium", "Wankhede Stadium, Mumbai", "Brabourne Stadium",
)
# Season labels of the order years from 1992; later years stay plain years.
_SEASONS = ("2007/08", "2009", "2009/10", "2011", "2020/21", "2024")


def _case(key: str, names: tuple[str, ...]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names[:-1]))
    return f"CASE {key} {arms} ELSE '{names[-1]}' END"


_EXTRAS = ("wides", "legbyes", "noballs", "byes", "penalty")
_RUNS = "CAST(ROUND(l_quantity) AS INT) % 7"
_EXTRA = "CASE WHEN ROUND(l_discount*100) <= 4 THEN 1 ELSE 0 END"
_WKT = "ROUND(l_tax*100) = 0"

DELIVERY_EXPRS: tuple[tuple[str, str], ...] = (
    ("match_id", "l_orderkey"),
    ("inning", "CAST(1 + l_suppkey % 2 + CASE WHEN l_partkey % 211 = 0 THEN 2 ELSE 0 END AS INT)"),
    ("batting_team", _case("l_suppkey % 14", _TEAMS)),
    ("bowling_team", _case("(l_suppkey + 5) % 14", _TEAMS)),
    ("over", "CAST(l_partkey % 20 AS INT)"),
    ("ball", "CAST(l_linenumber AS INT)"),
    ("batter", "concat('B', CAST(l_partkey % 61 AS STRING))"),
    ("bowler", "concat('W', CAST(l_suppkey % 37 AS STRING))"),
    ("non_striker", "concat('B', CAST((l_partkey + 1) % 61 AS STRING))"),
    ("batsman_runs", f"CAST({_RUNS} AS INT)"),
    ("extra_runs", f"CAST({_EXTRA} AS INT)"),
    ("total_runs", f"CAST({_RUNS} + {_EXTRA} AS INT)"),
    ("extras_type", "CASE CAST(ROUND(l_discount*100) AS INT) " + " ".join(
        f"WHEN {i} THEN '{x}'" for i, x in enumerate(_EXTRAS)) + " END"),
    ("is_wicket", f"CAST(CASE WHEN {_WKT} THEN 1 ELSE 0 END AS INT)"),
    ("player_dismissed", f"CASE WHEN {_WKT} THEN concat('B', CAST(l_partkey % 61 AS STRING)) END"),
    ("dismissal_kind", f"CASE WHEN {_WKT} THEN CASE l_linenumber WHEN 1 THEN 'run out' WHEN 2 THEN 'stumped' "
                       "WHEN 3 THEN 'hit wicket' WHEN 4 THEN 'retired hurt' WHEN 7 THEN 'bowled' "
                       "ELSE 'caught' END END"),
    ("fielder", f"CASE WHEN {_WKT} AND l_linenumber IN (1,2,5,6) "
                "THEN concat('F', CAST(l_orderkey % 43 AS STRING)) END"),
)

MATCH_EXPRS: tuple[tuple[str, str], ...] = (
    ("id", "o_orderkey"),
    ("season", "CASE YEAR(o_orderdate) " + " ".join(f"WHEN {1992 + i} THEN '{x}'" for i, x in enumerate(_SEASONS))
               + " ELSE CAST(YEAR(o_orderdate) AS STRING) END"),
    ("city", "concat('C', CAST(o_custkey % 9 AS STRING))"),
    ("date", "CAST(o_orderdate AS DATE)"),
    ("match_type", "CASE WHEN o_custkey % 19 = 0 THEN 'Final' ELSE 'League' END"),
    ("player_of_match", "concat('B', CAST(o_custkey % 61 AS STRING))"),
    ("venue", _case("o_custkey % 8", _VENUES)),
    ("team1", "concat('t', CAST(o_custkey % 3 AS STRING))"),
    ("team2", "concat('t', CAST(o_custkey % 3 + 1 AS STRING))"),
    ("toss_winner", "concat('T', CAST(o_custkey % 3 AS STRING))"),
    ("toss_decision", "CASE WHEN o_custkey % 2 = 0 THEN 'bat' ELSE 'field' END"),
    ("winner", "CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE concat(' t', CAST(o_orderkey % 4 AS STRING)) END"),
    ("result", "CASE o_orderstatus WHEN 'P' THEN 'runs' WHEN 'F' THEN CASE WHEN o_custkey % 5 = 0 "
               "THEN ' Wickets' ELSE 'wickets' END ELSE CASE WHEN o_custkey % 4 = 0 THEN 'tie' "
               "ELSE 'runs' END END"),
    ("result_margin", "CAST(CASE WHEN o_orderstatus = 'F' THEN 1 + o_custkey % 10 WHEN o_orderstatus = 'O' "
                      "AND o_custkey % 4 = 0 THEN NULL ELSE 1 + o_custkey % 140 END AS INT)"),
    ("target_runs", "CAST(100 + CAST(FLOOR(o_totalprice) AS BIGINT) % 140 AS INT)"),
    ("target_overs", "CAST(20 AS INT)"),
    ("super_over", "CASE WHEN o_custkey % 23 = 0 THEN 'Y' ELSE 'N' END"),
    ("method", "CASE WHEN o_custkey % 29 = 0 THEN 'D/L' END"),
    ("umpire1", "concat('U', CAST(o_custkey % 5 AS STRING))"),
    ("umpire2", "concat('U', CAST(o_custkey % 5 + 1 AS STRING))"),
)

assert tuple(n for n, _ in DELIVERY_EXPRS) == tuple(f.name for f in DELIVERIES_SCHEMA.fields)
assert tuple(n for n, _ in MATCH_EXPRS) == tuple(f.name for f in MATCHES_SCHEMA.fields)


@dataclass(frozen=True)
class Tables:
    """The two inputs every plan reads: raw deliveries and matches."""

    deliveries: DataFrame
    matches: DataFrame


# Spark-side form of the same mapping.  A simple CASE repeats its key in every
# WHEN, so the rounded discount was evaluated up to ten times per row inside
# the legal-ball filter (Catalyst pushes the filter below the projection and
# inlines the CASE); a map lookup evaluates it once.  Unknown or NULL keys give
# NULL in both forms; the oracle keeps the CASE text, so each checks the other.
_SPARK_EXPRS = {
    "extras_type": "try_element_at(map(" + ", ".join(f"{i}, '{x}'" for i, x in enumerate(_EXTRAS))
                   + "), CAST(ROUND(l_discount*100) AS INT))",
}


def deliveries_from_lineitem(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(*[F.expr(_SPARK_EXPRS.get(n, e)).alias(n) for n, e in DELIVERY_EXPRS])


def matches_from_orders(orders: DataFrame) -> DataFrame:
    return orders.select(*[F.expr(e).alias(n) for n, e in MATCH_EXPRS])


_known_types: dict[str, StructType] = {}


def _types(spark: SparkSession, path: str) -> StructType:
    if path not in _known_types:
        _known_types[path] = spark.read.parquet(path).schema
    return _known_types[path]


def from_tpch(spark: SparkSession, sf_dir: str) -> Tables:
    """Lazy ``Tables`` over ``{sf_dir}/lineitem.parquet`` and ``orders.parquet``."""
    read = lambda path: spark.read.schema(_types(spark, path)).parquet(path)
    lineitem, orders = read(f"{sf_dir}/lineitem.parquet"), read(f"{sf_dir}/orders.parquet")
    return Tables(deliveries_from_lineitem(lineitem), matches_from_orders(orders))


def _quote(name: str) -> str:
    return f'"{name}"'


def oracle_ctes() -> str:
    """``WITH deliveries AS (...), matches AS (...)`` for DuckDB."""
    d = ",\n  ".join(f"{e} AS {_quote(n)}" for n, e in DELIVERY_EXPRS)
    m = ",\n  ".join(f"{e} AS {_quote(n)}" for n, e in MATCH_EXPRS)
    return f"WITH deliveries AS (SELECT\n  {d}\nFROM lineitem),\nmatches AS (SELECT\n  {m}\nFROM orders)"
