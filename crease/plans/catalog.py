"""Every report by name: ``QUERIES[name](tables) -> DataFrame``.

A report is a lazy DataFrame; nothing runs until the caller acts on it.
Raw-delivery reports read every ball; clean reports read legal balls with
canonical team names; match reports read the match table only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions import constants as C
from ..sources.adapter import Tables
from . import cleaning as cl
from . import faceoffs as fo
from . import leaderboards as lb
from . import matrices as mx
from . import seasons as se
from . import sequences as sq
from . import summaries as su
from . import venues as ve

Report = Callable[[Tables], DataFrame]


def _raw(fn) -> Report:
    return lambda t: fn(t.deliveries)


def _clean(fn) -> Report:
    return lambda t: fn(cl.clean_deliveries(t.deliveries))


def _joined(fn) -> Report:
    return lambda t: fn(t.deliveries, t.matches)


def _matches(fn) -> Report:
    return lambda t: fn(t.matches)


def _dates_as_text(report: Report) -> Report:
    """Dates as ``2020-04-01``: the same text in every client, NULL or not."""
    def texts(t: Tables) -> DataFrame:
        df = report(t)
        return df.withColumns({c: df[c].cast("string") for c, kind in df.dtypes if kind == "date"})

    return texts


QUERIES: dict[str, Report] = {
    # career leaderboards (raw deliveries)
    "top_runs": _raw(lb.top_runs),
    "run_scorer_delta": _raw(lb.run_scorer_delta),
    "top_wickets": _raw(lb.top_wickets),
    "top_boundaries": _raw(lb.top_boundaries),
    "top_sixes": _raw(lb.top_sixes),
    "top_fours": _raw(lb.top_fours),
    "boundary_boards": _raw(lb.boundary_boards),
    "top_catches": _raw(lb.top_catches),
    "top_stumpings": _raw(lb.top_stumpings),
    "powerplay_economy": _raw(lb.powerplay_economy),
    "innings_summary": _raw(lb.innings_summary),
    # season reports (raw deliveries joined to matches)
    "top_season_runs": _joined(se.top_season_runs),
    "top_season_wkts": _joined(se.top_season_wkts),
    "season_top_batter": _joined(se.season_top_batter),
    "season_top_bowler": _joined(se.season_top_bowler),
    "season_top_batter_ties": lambda t: se.season_top_batter(t.deliveries, t.matches, keep_ties=True),
    "season_top_bowler_ties": lambda t: se.season_top_bowler(t.deliveries, t.matches, keep_ties=True),
    "season_innings_totals": _joined(se.season_innings_totals),
    "season_innings_box": _joined(se.season_innings_box),
    "season_innings_box_ordered": lambda t: se.season_innings_box(t.deliveries, t.matches, seasons=C.SEASON_ORDER),
    # venue reports
    "venue_innings_avg": _joined(ve.venue_innings_avg),
    "venue_innings_matrix": _joined(ve.venue_innings_matrix),
    "venue_max_chase": _matches(ve.venue_max_chase),
    # per-over / per-phase rates (clean deliveries)
    "team_over_run_rate": _raw(mx.team_over_run_rate),
    "run_rate_long": _clean(mx.run_rate_long),
    "run_rate_matrix": _clean(mx.run_rate_matrix),
    "conceded_long": _clean(mx.conceded_long),
    "conceded_matrix": _clean(mx.conceded_matrix),
    "team_phase_wkts_taken": _clean(mx.team_phase_wkts_taken),
    "team_phase_wkts_lost": _clean(mx.team_phase_wkts_lost),
    "wkts_taken_matrix": _clean(mx.wkts_taken_matrix),
    "wkts_lost_matrix": _clean(mx.wkts_lost_matrix),
    # face-offs (clean deliveries)
    "faceoff_batter": _clean(fo.faceoff_batter),
    "faceoff_batter_all_balls": _clean(lambda c: fo.faceoff_batter(c, keep_non_dismissals=True)),
    "faceoff_bowler": _clean(fo.faceoff_bowler),
    "faceoff_bowler_all_balls": _clean(lambda c: fo.faceoff_bowler(c, keep_non_dismissals=True)),
    # row-level transforms
    "legal_deliveries": _raw(cl.legal_deliveries),
    "running_score": lambda t: cl.with_running_score(cl.legal_deliveries(t.deliveries)),
    "high_impact": lambda t: cl.with_high_impact(cl.legal_deliveries(t.deliveries)),
    "canonical_teams": _raw(cl.clean_deliveries),
    # match labels: the library functions return every match column; the
    # reports keep the match key, the label and the text it is derived from
    "match_date_parts": lambda t: cl.match_date_parts(t.matches).select("id", "season", "Year", "Month", "Day"),
    "win_margin_category": lambda t: cl.with_win_margin_category(t.matches).select(
        "id", "result", "Win_Margin_Category"),
    "toss_match_winner": lambda t: cl.with_toss_match_winner(t.matches).select(
        "id", "toss_winner", "winner", "Toss_Match_Winner"),
    "canonical_venues": lambda t: cl.canonical_venues(t.matches).select("id", "venue"),
    # what came before, runs of balls, spans, ranks
    "last_wicket": _clean(sq.last_wicket),
    "venue_previous_chase": _dates_as_text(_matches(sq.venue_previous_chase)),
    "spell_totals": _clean(sq.spell_totals),
    "award_spans": _dates_as_text(_matches(sq.award_spans)),
    "bowling_spells": _clean(sq.bowling_spells),
    "partnerships": _raw(sq.partnerships),
    "innings_ranks": _raw(sq.innings_ranks),
    "target_ranks": _matches(sq.target_ranks),
    # mergeable summaries: sketches, cube, refreshed sums
    "faceoff_counts": lambda t: su.faceoff_counts(cl.clean_deliveries(t.deliveries), t.matches),
    "faceoff_overlap": lambda t: su.faceoff_overlap(cl.clean_deliveries(t.deliveries), t.matches),
    "target_box": _matches(su.target_box),
    "scoring_cube": lambda t: su.scoring_cube(cl.clean_deliveries(t.deliveries), t.matches),
    "match_changes": _raw(su.match_changes),
    "refreshed_batting": _raw(su.refreshed_batting),
}
