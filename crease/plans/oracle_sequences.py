"""SQL of the ordered reports and the summaries, over the CTEs of ``oracle``: plain
windows, ASOF and range joins, CUBE, EXCEPT ALL."""

_SEQ = '"over" * 100 + ball'
_INNINGS = "match_id, inning"


def _runs(source: str, order: str, opens: str, state: str, more: str) -> str:
    """Gaps and islands the usual way: a running count of rows that open an island."""
    w = f"OVER (PARTITION BY {_INNINGS} ORDER BY {order})"
    return f"""marked AS (SELECT *, {_SEQ} AS seq, row_number() {w} AS rn, {opens.format(w=w)} AS opens FROM {source}),
island AS (SELECT *, sum(opens) OVER (PARTITION BY {_INNINGS} ORDER BY rn) AS i FROM marked)
SELECT {_INNINGS}, {state} CAST(min(seq) AS INTEGER) AS first_seq, CAST(max(seq) AS INTEGER) AS last_seq, count(*) AS Balls,
  CAST(sum(total_runs) AS BIGINT) AS Runs, {more} FROM island GROUP BY {_INNINGS}, {state} i"""


def _order(*columns: str) -> str:
    return ", ".join(f"{c} ASC NULLS FIRST" for c in columns)


def _ranked(source: str, order: str, tie: str, tiles: int, dense: bool) -> str:
    extra = f", dense_rank() OVER (ORDER BY {order}) AS dense_rank" if dense else ""
    return f"""SELECT *, row_number() OVER (ORDER BY {order}, {tie}) AS row_number, rank() OVER (ORDER BY {order}) AS "rank",
  percent_rank() OVER (ORDER BY {order}) AS percent_rank, cume_dist() OVER (ORDER BY {order}) AS cume_dist,
  ntile({tiles}) OVER (ORDER BY {order}, {tie}) AS ntile{extra} FROM {source}"""


def sequence_sql(ctes: str, venue: str) -> dict[str, str]:
    """``ctes``: deliveries, matches, legal, clean, dm; ``venue``: canonical venue of ``matches``."""
    put = lambda body: f"{ctes},\n{body}"
    return {
        "last_wicket": put(f"""wk AS (SELECT {_INNINGS}, {_SEQ} AS seq, player_dismissed, bowler, dismissal_kind FROM clean WHERE is_wicket = 1
  QUALIFY row_number() OVER (PARTITION BY {_INNINGS}, {_SEQ} ORDER BY player_dismissed DESC NULLS LAST, bowler DESC NULLS LAST,
                             dismissal_kind DESC NULLS LAST) = 1),
b AS (SELECT {_INNINGS}, "over", ball, batter, bowler, total_runs, CAST({_SEQ} AS INTEGER) AS seq FROM clean)
SELECT b.*, wk.player_dismissed AS last_out, wk.bowler AS last_wicket_by, wk.dismissal_kind AS last_kind,
  CAST(coalesce(wk.seq, -1) AS INTEGER) AS wicket_seq
FROM b ASOF LEFT JOIN wk ON b.match_id = wk.match_id AND b.inning = wk.inning AND b.seq > wk.seq"""),
        "venue_previous_chase": put(f"""named AS (SELECT id, {venue} AS venue, "date", result, target_runs FROM matches),
ch AS (SELECT venue, "date" AS d, id, target_runs FROM named WHERE result = 'wickets' AND venue IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY venue, "date" ORDER BY id DESC) = 1)
SELECT n.id, n.venue, CAST(n."date" AS VARCHAR) AS "date", coalesce(ch.id, -1) AS previous_id, CAST(ch.d AS VARCHAR) AS previous_date, CAST(ch.target_runs AS DOUBLE) AS previous_target
FROM named n ASOF LEFT JOIN ch ON n.venue = ch.venue AND n."date" > ch.d"""),
        "spell_totals": put(f"""b AS (SELECT *, CAST({_SEQ} AS INTEGER) AS seq FROM clean),
sp AS (SELECT {_INNINGS}, bowler, min(seq) AS first_seq, max(seq) AS last_seq FROM b GROUP BY {_INNINGS}, bowler)
SELECT sp.*, count(*) AS Balls, CAST(sum(b.total_runs) AS BIGINT) AS Runs
FROM sp JOIN b ON sp.match_id = b.match_id AND sp.inning = b.inning AND b.seq BETWEEN sp.first_seq AND sp.last_seq GROUP BY ALL"""),
        "award_spans": put("""sp AS (SELECT player_of_match, min("date") AS first_award, max("date") AS last_award FROM matches
  WHERE player_of_match IS NOT NULL GROUP BY player_of_match)
SELECT sp.player_of_match, CAST(first_award AS VARCHAR) AS first_award, CAST(last_award AS VARCHAR) AS last_award,
  count(*) AS Matches, CAST(sum(m.target_runs) AS BIGINT) AS Target_Runs
FROM sp JOIN matches m ON m."date" BETWEEN sp.first_award AND sp.last_award GROUP BY sp.player_of_match, first_award, last_award"""),
        "bowling_spells": put(_runs("clean", _order('"over"', "ball", "batter", "bowler", "total_runs", "is_wicket"),
                                    "CASE WHEN bowler IS NOT DISTINCT FROM lag(bowler) {w} AND row_number() {w} > 1 THEN 0 ELSE 1 END",
                                    "bowler,", "CAST(sum(is_wicket) AS BIGINT) AS Wickets")),
        "partnerships": put(_runs("deliveries", _order('"over"', "ball", "is_wicket", "batter", "bowler", "total_runs"),
                                  "CASE WHEN coalesce(lag(is_wicket) {w}, 0) = 1 THEN 1 ELSE 0 END", "", "max(is_wicket) AS Ended")),
        "innings_ranks": put(f"tot AS (SELECT {_INNINGS}, CAST(sum(total_runs) AS BIGINT) AS Runs FROM deliveries GROUP BY {_INNINGS})\n"
                             + _ranked("tot", "Runs DESC NULLS LAST", _order("match_id", "inning"), 100, True)),
        "target_ranks": put("t AS (SELECT id, target_runs FROM matches)\n"
                            + _ranked("t", "target_runs ASC NULLS FIRST", _order("id"), 10, False)),
    }


def summary_sql(ctes: str, venue: str) -> dict[str, str]:
    """SQL of the reports over summaries: the same figures from the rows themselves."""
    put = lambda body: f"{ctes},\n{body}"
    pairs = "p AS (SELECT DISTINCT c.batting_team, m.season, concat_ws('|', c.batter, c.bowler) AS pair FROM clean c JOIN matches m ON c.match_id = m.id)"
    old = """played AS (SELECT * REPLACE (CAST(CASE WHEN match_id % 7 = 2 THEN (batsman_runs + 1) % 7 ELSE batsman_runs END AS INTEGER) AS batsman_runs)
  FROM deliveries WHERE match_id % 10 <> 3),
old AS (SELECT * FROM played UNION ALL SELECT * FROM played WHERE match_id % 13 = 5)"""
    return {
        "faceoff_counts": put(f"""{pairs}
SELECT batting_team, season, CAST(grouping(batting_team, season) AS BIGINT) AS level, count(DISTINCT pair) AS Pairs
FROM p GROUP BY GROUPING SETS ((batting_team, season), (batting_team), (season), ())"""),
        "faceoff_overlap": put(f"""{pairs},
s AS (SELECT DISTINCT season, pair FROM p),
o AS (SELECT season, lag(season) OVER (ORDER BY season) AS before FROM (SELECT DISTINCT season FROM s)),
j AS (SELECT o.season, o.before, coalesce(a.pair, b.pair) AS pair, a.pair IS NOT NULL AS now, b.pair IS NOT NULL AS past
  FROM o JOIN (SELECT DISTINCT pair FROM s) u ON TRUE LEFT JOIN s a ON a.season = o.season AND a.pair = u.pair
  LEFT JOIN s b ON b.season = o.before AND b.pair = u.pair)
SELECT season, before, count(CASE WHEN now OR past THEN 1 END) AS "Either", count(CASE WHEN now AND past THEN 1 END) AS "Both",
  count(CASE WHEN now AND NOT past THEN 1 END) AS "New"
FROM j WHERE before IS NOT NULL GROUP BY season, before"""),
        "target_box": put("""q AS (SELECT season, count(target_runs) AS n, CAST(min(target_runs) AS DOUBLE) AS "min", CAST(max(target_runs) AS DOUBLE) AS "max",
  CAST(quantile_disc(target_runs, 0.25) AS DOUBLE) AS q1, CAST(quantile_disc(target_runs, 0.5) AS DOUBLE) AS median,
  CAST(quantile_disc(target_runs, 0.75) AS DOUBLE) AS q3 FROM matches GROUP BY season),
f AS (SELECT *, q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AS lo, q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS hi FROM q)
SELECT f.season, n, f."min", q1, median, q3, f."max",
  least(min(CASE WHEN m.target_runs > lo THEN CAST(m.target_runs AS DOUBLE) END), q1) AS whisker_lo,
  greatest(max(CASE WHEN m.target_runs <= hi THEN CAST(m.target_runs AS DOUBLE) END), q3) AS whisker_hi,
  count(CASE WHEN m.target_runs <= lo OR m.target_runs > hi THEN 1 END) AS outliers
FROM f JOIN matches m ON m.season IS NOT DISTINCT FROM f.season GROUP BY f.season, n, f."min", f."max", q1, median, q3, lo, hi"""),
        "scoring_cube": put(f"""x AS (SELECT c.batting_team, m.season, m.venue, CAST(CAST(ceil((c."over" + 1) / 4) AS BIGINT) AS VARCHAR) AS phase, total_runs, is_wicket
  FROM clean c JOIN (SELECT id, season, {venue} AS venue FROM matches) m ON c.match_id = m.id)
SELECT batting_team, season, venue, phase, CAST(grouping(batting_team, season, venue, phase) AS BIGINT) AS level,
  count(*) AS Balls, CAST(sum(total_runs) AS BIGINT) AS Runs, CAST(sum(is_wicket) AS BIGINT) AS Wickets
FROM x GROUP BY CUBE (batting_team, season, venue, phase)"""),
        "match_changes": put(f"""{old},
more AS (SELECT match_id, count(*) AS n FROM (SELECT * FROM deliveries EXCEPT ALL SELECT * FROM old) GROUP BY match_id),
fewer AS (SELECT match_id, count(*) AS n FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM deliveries) GROUP BY match_id)
SELECT match_id, CASE WHEN f.n IS NULL THEN 'added' WHEN m.n IS NULL THEN 'removed' ELSE 'changed' END AS change,
  coalesce(m.n, 0) AS added, coalesce(f.n, 0) AS removed FROM more m FULL JOIN fewer f USING (match_id)"""),
        "refreshed_batting": put("""b AS (SELECT match_id, batter, count(*) AS Balls, CAST(sum(batsman_runs) AS BIGINT) AS Runs, CAST(sum(is_wicket) AS BIGINT) AS Outs
  FROM deliveries GROUP BY match_id, batter)
SELECT * FROM b"""),
    }
