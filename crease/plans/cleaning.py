"""Row-level cleaning and labelling of the two tables (all narrow except the
running score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import constants as C
from ..operators.running import running_total


# ------------------------------------------------------------- deliveries
def legal_deliveries(deliveries: DataFrame) -> DataFrame:
    """Drop wides and no-balls; byes, leg byes, penalties and plain balls stay."""
    return deliveries.where(X.legal_ball())


def canonical_teams(deliveries: DataFrame) -> DataFrame:
    """Batting and bowling team under their current names."""
    return deliveries.withColumns({
        "batting_team": X.canonical("batting_team", C.TEAM_ALIASES),
        "bowling_team": X.canonical("bowling_team", C.TEAM_ALIASES),
    })


def clean_deliveries(deliveries: DataFrame) -> DataFrame:
    """Legal balls with canonical team names: the input of every per-over report."""
    return canonical_teams(legal_deliveries(deliveries))


def with_running_score(deliveries: DataFrame, out: str = "runningScorePerInning",
                       skew_safe: bool = True) -> DataFrame:
    """Innings score after each ball, ordered by (over, ball).

    Balls that share ``(over, ball)`` (e.g. an extra followed by its re-bowl
    when extras are kept) are peers and share the total that includes all of
    them.  Computed on whatever frame is passed in (legal balls in the report,
    so it excludes wides and no-balls, as the report does).  ``skew_safe``:
    see ``operators.running.running_total``.
    """
    return running_total(deliveries, ["match_id", "inning"], ["over", "ball"], "total_runs", out,
                         skew_safe=skew_safe)


def with_high_impact(deliveries: DataFrame, out: str = "high_Impact") -> DataFrame:
    return deliveries.withColumn(out, X.high_impact())


# ---------------------------------------------------------------- matches
def match_date_parts(matches: DataFrame) -> DataFrame:
    return matches.withColumns({"Year": F.year("date"), "Month": F.month("date"),
                                "Day": F.dayofmonth("date")})


def with_win_margin_category(matches: DataFrame) -> DataFrame:
    return matches.withColumn("Win_Margin_Category", X.win_margin_category())


def with_toss_match_winner(matches: DataFrame) -> DataFrame:
    return matches.withColumn("Toss_Match_Winner", X.toss_match_winner())


def canonical_venues(matches: DataFrame) -> DataFrame:
    return matches.withColumn("venue", X.canonical("venue", C.VENUE_ALIASES))
