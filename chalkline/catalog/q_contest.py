"""Contest reports (RP11-RP17, RP22, RP23, RP25)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.catalog.q_functions import DEFENSE_SQL
from chalkline.catalog.q_operators import NOW, defense_points, stats_points, ts
from chalkline.catalog.registry import query
from chalkline.catalog.views import hu
from chalkline.functions.scoring import DEFENSE_RATES, FIELD_PARTS, OFFENSE_BONUSES, OFFENSE_RATES
from chalkline.functions.values import half_up
from chalkline.operators.filters import locked_teams
from chalkline.operators.ordered import shuffled
from chalkline.plans import contest as C, reports as R

_VALUE = "CASE b.stat_field " + " ".join(f"WHEN '{c}' THEN CAST({' + '.join('coalesce(s.' + x + ', 0)' for x in cols)} AS DOUBLE)" for c, cols in FIELD_PARTS.items()) + " END"
PROPS_SQL = f"""pt AS (SELECT name_key, max(team) AS team FROM depth GROUP BY name_key),
    sp0 AS (SELECT b.*, CASE WHEN s.name_key IS NOT NULL THEN {_VALUE} END AS actual, coalesce(sl.team, pt.team) AS team FROM prop_bets b LEFT JOIN player_stats s ON s.year = b.year AND s.week = b.week AND s.name_key = b.name_key
      LEFT JOIN slate sl ON sl.year = b.year AND sl.week = b.week AND sl.name_key = b.name_key LEFT JOIN pt ON pt.name_key = b.name_key),
    scored AS (SELECT *, CASE WHEN actual > line THEN 'over' WHEN actual < line THEN 'under' WHEN actual = line THEN 'push' WHEN stat_field <> 'kicks'
      AND EXISTS (SELECT 1 FROM team_points tp WHERE tp.year = sp0.year AND tp.week = sp0.week AND tp.team = sp0.team) THEN 'void' END AS result FROM sp0)"""


def scored_props(t):
    weeks = t.player_weeks.select("year", "week").distinct()
    depth = t.depth.groupBy("name_key").agg(F.max("team").alias("team"))
    known = t.prop_bets.select("year", "week", "name_key").join(shuffled(depth), "name_key").join(weeks, ["year", "week"], "left_semi")
    return C.score_props(t.prop_bets.drop("cid", "t"), t.player_stats, [t.slate.select("year", "week", "name_key", "team"), known], t.team_points)


@query("rp11_score_props", f"WITH {PROPS_SQL} SELECT prop_id, stat_field, line, actual, result FROM scored")
def _(t):
    return scored_props(t).select("prop_id", "stat_field", "line", "actual", "result")


ROWS_SQL = f"""dd AS (SELECT year, week, team AS dst_team, {DEFENSE_SQL} AS points FROM defense),
    lr AS (SELECT s.year, s.week, s.submitter, s.rn, s.slot, s.name, s.position, s.salary, CASE WHEN s.slot = 'DST' THEN d.points ELSE coalesce(p.dk_pts_reported, p.dk_pts) END AS pts,
      CASE WHEN s.slot = 'DST' THEN s.dst_team ELSE coalesce(p.team, sl.team) END AS team FROM slots s LEFT JOIN player_stats p ON p.year = s.year AND p.week = s.week AND p.name_key = s.name_key
      LEFT JOIN dd d ON d.year = s.year AND d.week = s.week AND d.dst_team = s.dst_team LEFT JOIN slate sl ON sl.year = s.year AND sl.week = s.week AND sl.name_key = s.name_key),
    lrows AS (SELECT *, slot <> 'DST' AND pts IS NULL AND team IS NOT NULL AND EXISTS (SELECT 1 FROM team_points tp WHERE tp.year = lr.year AND tp.week = lr.week AND tp.team = lr.team) AS dnp0 FROM lr WHERE slot IS NOT NULL),
    lfinal AS (SELECT year, week, submitter, rn, slot, name, position, salary, team, coalesce(dnp0, false) AS dnp, CASE WHEN coalesce(dnp0, false) THEN 0.0E0 ELSE pts END AS actual_pts FROM lrows)"""


def lineup_json(t):
    """Submissions as the stored JSON documents; a lineup has at most 75 players."""
    s = t.slots.where(F.col("slot").isNotNull())
    item = F.struct("rn", "slot", "name", "position", "salary")
    docs = s.groupBy("year", "week", "submitter").agg(F.sort_array(F.collect_list(item)).alias("l"), F.sum("salary").alias("total_salary"))
    return docs.select("year", "week", "submitter", F.to_json(F.transform("l", lambda p: F.struct(p["slot"], p["name"], p["position"], p["salary"]))).alias("lineup_json"), "total_salary")


def lineup_rows(t):
    slots = C.parse_lineups(lineup_json(t))
    slate = t.slate.select("year", "week", "name_key", "team")
    return C.lineup_rows(slots, stats_points(t), defense_points(t), slate, slate, t.team_points)


@query("rp12_lineup_rows", f"WITH {ROWS_SQL} SELECT year, week, submitter, slot, name, position, salary, team, dnp, actual_pts FROM lfinal")
def _(t):
    return lineup_rows(t).select("year", "week", "submitter", "slot", "name", "position", "salary", "team", "dnp", "actual_pts")


TOTALS_SQL = f"{ROWS_SQL}, ltot AS (SELECT year, week, submitter, count(actual_pts) AS matched, CASE WHEN count(actual_pts) = 9 THEN {hu('sum(actual_pts)', 2)} END AS score FROM lfinal GROUP BY year, week, submitter)"


def totals(t):
    return C.lineup_totals(lineup_rows(t))


@query("rp13_lineup_totals", f"WITH {TOTALS_SQL} SELECT * FROM ltot")
def _(t):
    return totals(t)


EXCLUDED = {1999: [1, 2]}
COUNTS_SQL = "NOT (year = 1999 AND week IN (1, 2))"
STAND_SQL = f"""{TOTALS_SQL}, cs AS (SELECT *, CASE WHEN {COUNTS_SQL} THEN score END AS s FROM ltot),
    lowest AS (SELECT year, submitter, week, s FROM (SELECT *, row_number() OVER (PARTITION BY year, submitter ORDER BY s, week) AS rn, count(*) OVER (PARTITION BY year, submitter) AS n FROM cs WHERE s IS NOT NULL) x WHERE rn = 1 AND n >= 2),
    agg AS (SELECT year, submitter, coalesce(sum(s), 0.0E0) AS total, count(s) AS weeks_scored, count(*) - count(score) AS weeks_pending FROM cs GROUP BY year, submitter)"""


@query("rp14_standings_drop_lowest", f"""WITH {STAND_SQL} SELECT a.year, a.submitter, {hu('a.total - coalesce(l.s, 0.0E0)', 2)} AS total, a.weeks_scored, a.weeks_pending, l.week AS dropped_week
    FROM agg a LEFT JOIN lowest l USING (year, submitter)""")
def _(t):
    return C.season_standings(totals(t), True, EXCLUDED)


@query("rp14_standings_no_drop", f"WITH {STAND_SQL} SELECT year, submitter, {hu('total', 2)} AS total, weeks_scored, weeks_pending FROM agg")
def _(t):
    return C.season_standings(totals(t), False, EXCLUDED)


@query("rp14_weekly_winners", f"""WITH {TOTALS_SQL}, wk AS (SELECT DISTINCT year, week FROM ltot), top AS (SELECT year, week, submitter, score, rank() OVER (PARTITION BY year, week ORDER BY score DESC) AS r FROM ltot WHERE score IS NOT NULL)
    SELECT w.year, w.week, t.score AS top_score, t.submitter, NOT (w.year = 1999 AND w.week IN (1, 2)) AS counts FROM wk w LEFT JOIN top t ON t.year = w.year AND t.week = w.week AND t.r = 1""")
def _(t):
    return C.weekly_winners(totals(t), EXCLUDED)


GRADED_SQL = f"""{PROPS_SQL}, gp AS (SELECT p.year, p.week, p.submitter, p.prop_id, p.pick, s.result, CASE WHEN s.result IN ('over', 'under') THEN s.result = p.pick END AS is_correct FROM prop_picks p JOIN scored s USING (prop_id))"""


def graded(t):
    return C.graded_picks(t.prop_picks.drop("cid"), scored_props(t))


@query("rp14_prop_standings", f"""WITH {GRADED_SQL} SELECT year, submitter, count(*) FILTER ({COUNTS_SQL} AND is_correct) AS correct, count(*) FILTER ({COUNTS_SQL} AND is_correct IS NOT NULL) AS total_scored,
    count(*) FILTER (result IS NULL) AS pending, {hu(f'count(*) FILTER ({COUNTS_SQL} AND is_correct) * 100.0E0 / nullif(count(*) FILTER ({COUNTS_SQL} AND is_correct IS NOT NULL), 0)', 1)} AS accuracy_pct FROM gp GROUP BY year, submitter""")
def _(t):
    return C.prop_standings(graded(t), EXCLUDED)


PICK_TOTALS = """SELECT year, week, submitter, count(*) AS picks, count(result) AS matched, count(is_correct) AS scored, CASE WHEN count(result) = count(*) THEN count(*) FILTER (is_correct) END AS correct FROM gp GROUP BY year, week, submitter"""


@query("rp14_long_export", f"""WITH {TOTALS_SQL}, {GRADED_SQL}, pk AS ({PICK_TOTALS}), u AS (SELECT year, week, submitter, 'lineup' AS contest, score AS points, CASE WHEN score IS NULL THEN 'pending' ELSE 'final' END AS status,
      score IS NOT NULL AND row_number() OVER (PARTITION BY year, submitter ORDER BY score NULLS LAST, week) = 1 AND count(score) OVER (PARTITION BY year, submitter) >= 2 AS is_dropped_week FROM ltot
    UNION ALL SELECT year, week, submitter, 'props', CAST(correct AS DOUBLE), CASE WHEN correct IS NULL THEN 'pending' ELSE 'final' END, false FROM pk) SELECT *, true AS counts FROM u""")
def _(t):
    return C.standings_long(totals(t), graded(t))


@query("rp16_pick_results", f"WITH {GRADED_SQL} SELECT year, week, submitter, prop_id, pick, result, is_correct FROM gp")
def _(t):
    return graded(t).select("year", "week", "submitter", "prop_id", "pick", "result", "is_correct")


@query("rp16_pick_totals", f"WITH {GRADED_SQL} {PICK_TOTALS}")
def _(t):
    return C.pick_totals(graded(t))


def _lines_sql(rates, extra: str) -> str:
    arms = [f"SELECT k1, year, week, actual, '{label}' AS label, CAST(coalesce({c}, 0) AS DOUBLE) AS units, {hu(f'coalesce({c}, 0) * {rate}E0', 2)} AS pts FROM src WHERE coalesce({c}, 0) <> 0" for c, label, rate in rates]
    return " UNION ALL ".join([*arms, extra])


_BONUS = " UNION ALL ".join(f"SELECT k1, year, week, actual, '{label}', CAST({c} AS DOUBLE), 3.0E0 FROM src WHERE {c} >= {thr}" for c, thr, label in OFFENSE_BONUSES)
_OTHER = f"""other AS (SELECT s.k1, s.year, s.week, s.actual, 'Other' AS label, 1.0E0 AS units, {hu('s.actual - coalesce(x.total, 0.0E0)', 2)} AS pts FROM src s LEFT JOIN (SELECT k1, year, week, sum(pts) AS total FROM ln GROUP BY k1, year, week) x USING (k1, year, week)
    WHERE abs(s.actual - coalesce(x.total, 0.0E0)) >= 0.01E0) SELECT * FROM ln UNION ALL SELECT * FROM other"""


@query("rp15_offense_breakdown", f"""WITH src AS (SELECT player_id AS k1, year, week, coalesce(dk_pts_reported, dk_pts) AS actual, * EXCLUDE (player_id, year, week) FROM player_stats), ln AS ({_lines_sql(OFFENSE_RATES, _BONUS)}), {_OTHER}""")
def _(t):
    from chalkline.functions.scoring import counted_points

    rows = t.player_stats.withColumn("actual", counted_points()).withColumnRenamed("player_id", "k1")
    return C.offense_breakdown(rows, ["k1", "year", "week"], "actual").drop("line_no")


_ALLOWED = ("SELECT k1, year, week, actual, 'Points allowed', CAST(points_allowed AS DOUBLE), CASE WHEN points_allowed <= 0 THEN 10.0E0 WHEN points_allowed <= 6 THEN 7.0E0 WHEN points_allowed <= 13 THEN 4.0E0 "
            "WHEN points_allowed <= 20 THEN 1.0E0 WHEN points_allowed <= 27 THEN 0.0E0 WHEN points_allowed <= 34 THEN -1.0E0 ELSE -4.0E0 END FROM src")


@query("rp15_defense_breakdown", f"""WITH src AS (SELECT team AS k1, year, week, {DEFENSE_SQL} + CASE WHEN week % 5 = 0 THEN 2.0E0 ELSE 0.0E0 END AS actual, * EXCLUDE (team, year, week) FROM defense), ln AS ({_lines_sql(DEFENSE_RATES, _ALLOWED)}), {_OTHER}""")
def _(t):
    from chalkline.functions.scoring import defense_points as dp

    rows = t.defense.withColumn("actual", dp() + F.when(F.col("week") % 5 == 0, 2.0).otherwise(0.0)).withColumnRenamed("team", "k1")
    return C.defense_breakdown(rows, ["k1", "year", "week"], "actual").drop("line_no")


@query("rp17_props_board", f"""WITH {PROPS_SQL}, b AS (SELECT * FROM scored WHERE year * 100 + week = (SELECT max(year * 100 + week) FROM prop_bets))
    SELECT b.prop_id, b.stat_field, b.line, b.actual, b.result, EXISTS (SELECT 1 FROM schedule s WHERE s.year = b.year AND s.week = b.week AND s.team = b.team AND s.kickoff <= TIMESTAMP '2001-07-01 20:00:00') AS locked,
      (SELECT count(DISTINCT submitter) FROM prop_picks p WHERE p.prop_id = b.prop_id) AS submitters FROM b""")
def _(t):
    return R.props_board(t.prop_bets, scored_props(t), t.schedule, ts("2001-07-01 20:00:00"), t.prop_picks).select(
        "prop_id", "stat_field", "line", "actual", "result", "locked", "submitters")


@query("rp17_board_picks", """WITH w AS (SELECT * FROM prop_bets WHERE year * 100 + week = (SELECT max(year * 100 + week) FROM prop_bets)),
    who AS (SELECT DISTINCT p.submitter FROM prop_picks p JOIN w ON w.prop_id = p.prop_id)
    SELECT who.submitter, w.prop_id, p.pick FROM w CROSS JOIN who LEFT JOIN prop_picks p ON p.prop_id = w.prop_id AND p.submitter = who.submitter""")
def _(t):
    board = R.props_board(t.prop_bets, scored_props(t), t.schedule, ts("2001-07-01 20:00:00"), t.prop_picks)
    return R.board_picks(board, t.prop_picks).select("submitter", "prop_id", "pick")


@query("rp22_validate_lineups", f"""WITH lk AS (SELECT DISTINCT year, week, team FROM schedule WHERE kickoff <= {NOW}), tn AS (SELECT year, week, name, max(team) AS team FROM slate GROUP BY year, week, name),
    r AS (SELECT s.*, l.team IS NOT NULL AND NOT (s.status = 'F') AS late, CASE s.slot WHEN 'QB' THEN s.position = 'QB' WHEN 'RB' THEN s.position = 'RB' WHEN 'WR' THEN s.position = 'WR' WHEN 'TE' THEN s.position = 'TE'
      WHEN 'FLEX' THEN s.position IN ('RB', 'WR', 'TE') WHEN 'DST' THEN s.position = 'DST' ELSE false END AS ok FROM slots s LEFT JOIN tn ON tn.year = s.year AND tn.week = s.week AND tn.name = s.name
      LEFT JOIN lk l ON l.year = s.year AND l.week = s.week AND l.team = CASE WHEN s.slot = 'DST' THEN s.dst_team ELSE tn.team END),
    g AS (SELECT year, week, submitter, count(*) AS players, CAST(sum(salary) AS BIGINT) AS total_salary, count(*) FILTER (NOT coalesce(ok, false)) AS bad, count(*) FILTER (late) AS late FROM r GROUP BY year, week, submitter)
    SELECT year, week, submitter, players, total_salary, CASE WHEN players <> 9 THEN 'player count' WHEN total_salary > 50000 THEN 'salary cap' WHEN bad > 0 THEN 'position' WHEN late > 0 THEN 'locked player' END AS reason FROM g""")
def _(t):
    before = t.slots.where("status = 'F'").select("year", "week", "submitter", "name")
    return C.validate_lineups(t.slots, before, t.slate, locked_teams(t.schedule, ts("1999-06-01 00:00:00")))


@query("rp23_validate_picks", f"""WITH lk AS (SELECT b.year, b.week, b.prop_id FROM prop_bets b JOIN slate s ON s.year = b.year AND s.week = b.week AND s.cid = b.cid JOIN schedule g ON g.year = s.year AND g.week = s.week AND g.team = s.team WHERE g.kickoff <= {NOW}),
    nw AS (SELECT year, week, submitter, prop_id, pick FROM prop_picks WHERE cid % 9 <> 0), bf AS (SELECT p.year, p.week, p.submitter, p.prop_id, CASE WHEN cid % 4 = 0 THEN 'over' ELSE pick END AS pick FROM prop_picks p WHERE cid % 2 = 0),
    j AS (SELECT coalesce(n.year, b.year) AS year, coalesce(n.week, b.week) AS week, coalesce(n.submitter, b.submitter) AS submitter, n.prop_id AS np, n.pick, b.pick AS bp, coalesce(n.prop_id, b.prop_id) AS pid
      FROM nw n FULL OUTER JOIN (SELECT * FROM bf WHERE (year, week, submitter) IN (SELECT year, week, submitter FROM nw)) b ON b.year = n.year AND b.week = n.week AND b.submitter = n.submitter AND b.prop_id = n.prop_id),
    g AS (SELECT j.year, j.week, j.submitter, count(np) AS n, count(*) FILTER (np IS NOT NULL AND l.prop_id IS NOT NULL AND bp IS DISTINCT FROM pick) AS ch, count(*) FILTER (np IS NULL AND l.prop_id IS NOT NULL) AS gone
      FROM j LEFT JOIN lk l ON l.prop_id = j.pid GROUP BY j.year, j.week, j.submitter)
    SELECT year, week, submitter, n AS picks, CASE WHEN n <> 5 THEN 'pick count' WHEN ch > 0 THEN 'locked change' WHEN gone > 0 THEN 'locked removal' END AS reason FROM g""")
def _(t):
    p = t.prop_picks
    now = p.where("cid % 9 <> 0").drop("cid")
    before = p.where("cid % 2 = 0").withColumn("pick", F.when(F.col("cid") % 4 == 0, F.lit("over")).otherwise(F.col("pick"))).drop("cid")
    teams = t.prop_bets.select("year", "week", "prop_id", "cid").join(t.slate.select("year", "week", "cid", "team"), ["year", "week", "cid"])
    locks = teams.join(locked_teams(t.schedule, ts("1999-06-01 00:00:00")), ["year", "week", "team"], "left_semi")
    return C.validate_picks(now, before, t.prop_bets, locks)


@query("rp25_validate_props", "SELECT count(*) AS n_rows, '' AS missing_columns, count(*) FILTER (stat_field = 'kicks') AS bad_fields, count(*) FILTER (stat_field = 'kicks') = 0 AS accepted FROM prop_bets")
def _(t):
    return C.validate_props(t.prop_bets)


_ = half_up
