"""Player, team, schedule reports and table builds (RP1-RP10, RP18-RP21, RP24, RP26-RP30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.catalog.q_functions import DEFENSE_SQL, IMPLIED_SQL
from chalkline.catalog.q_operators import NOW, ts
from chalkline.catalog.registry import query
from chalkline.catalog.views import hu
from chalkline.functions.values import half_up
from chalkline.plans import builds as B, reports as R

PTS = "coalesce(dk_pts_reported, dk_pts)"
DEPTH_SQL = "dl AS (SELECT name_key, min(string_rank) AS string_rank FROM depth GROUP BY name_key)"
LABEL = "coalesce(CASE dl.string_rank WHEN 1 THEN '1st' WHEN 2 THEN '2nd' WHEN 3 THEN '3rd' ELSE CAST(dl.string_rank AS STRING) END, '-')"
DOME = "('ari','atl','dal','det','hou','ind','lac','lar','lvr','min','nor')"
TOTAL = "CAST(regexp_extract(over_under, '[0-9.]+') AS DOUBLE)"


def depth(t):
    return t.depth.groupBy("name_key").agg(F.min("string_rank").alias("string_rank"))


def lines(t):
    return t.prop_lines.select("year", "week", "name_key", "category", "line")


@query("rp1_slate", f"""WITH {IMPLIED_SQL}, {DEPTH_SQL}, r AS (SELECT s.*, i.implied_points, {LABEL} AS depth_label, g.kickoff, (g.kickoff AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS e FROM slate s LEFT JOIN ip_table i ON i.year = s.year AND i.week = s.week AND i.name_key = s.name_key
      LEFT JOIN dl ON dl.name_key = s.name_key LEFT JOIN schedule g ON g.year = s.year AND g.week = s.week AND g.team = s.team),
    d AS (SELECT *, CASE WHEN e IS NULL THEN 'Date TBD' ELSE strftime(e, '%A, %b ') || CAST(day(e) AS STRING) END AS game_day FROM r)
    SELECT year, week, cid, position, salary, implied_points, depth_label, game_day, coalesce(kickoff <= {NOW}, false) AS locked, CAST(min(kickoff) OVER (PARTITION BY year, week, game_day) AS STRING) AS day_start,
      CASE position WHEN 'QB' THEN 0 WHEN 'RB' THEN 1 WHEN 'WR' THEN 2 WHEN 'TE' THEN 3 ELSE 4 END AS position_order FROM d""")
def _(t):
    s = R.slate(t.slate, t.schedule, depth(t), lines(t), ts("1999-06-01 00:00:00"))
    return s.select("year", "week", "cid", "position", "salary", "implied_points", "depth_label", "game_day", "locked", F.col("day_start").cast("string").alias("day_start"), "position_order")


@query("rp2_history_week", f"SELECT s.cid, s.year, s.week, s.salary, {PTS.replace('dk_pts', 'p.dk_pts')} AS actual_pts FROM slate s LEFT JOIN player_stats p USING (year, week, name_key)")
def _(t):
    return R.history_week(t.slate, t.player_stats).select("cid", "year", "week", "salary", "actual_pts")


@query("rp3_career", f"""SELECT p.player_id, count(*) AS games, CAST(sum(p.rush_yds) AS BIGINT) AS rush_yds, {hu(f'avg({PTS})', 2)} AS avg_pts, {hu('avg(s.salary)', 2)} AS avg_salary, count(s.salary) AS salaried_games
    FROM player_stats p LEFT JOIN slate s USING (year, week, name_key) GROUP BY p.player_id""")
def _(t):
    return R.career(t.player_stats, t.slate).select("player_id", "games", "rush_yds", "avg_pts", "avg_salary", "salaried_games")


def usage_sql(week: bool) -> str:
    k = "year, week" if week else "year"
    on = lambda a, b, cols: " AND ".join(f"{a}.{c} = {b}.{c}" for c in cols)
    who = [*k.split(", "), "name_key", "team"]
    tm = [*k.split(", "), "team"]
    air = "u.air_share" if week else "100.0E0 * u.air / nullif(tu.air, 0)"
    wopr = "u.wopr" if week else "1.5E0 * u.tg / nullif(tu.tg, 0) + 0.7E0 * u.air / nullif(tu.air, 0)"
    return f"""WITH p AS (SELECT {k}, name_key, team, name, position, sum(rec_tgt) AS targets, sum(rush_att + rec) AS touches, count(*) AS games FROM player_stats WHERE position IN ('RB', 'WR', 'TE') GROUP BY {k}, name_key, team, name, position),
    u AS (SELECT {k}, name_key, team, sum(targets) AS tg, sum(carries + coalesce(receptions, 0)) AS tch, sum(air_yards) AS air, sum(rz_targets) AS rz, max(air_yards_share) AS air_share, max(wopr) AS wopr FROM usage GROUP BY {k}, name_key, team),
    tu AS (SELECT {k}, team, sum(targets) AS tg, sum(carries + coalesce(receptions, 0)) AS tch, sum(air_yards) AS air, count(*) = count(receptions) AS has_rec FROM usage GROUP BY {k}, team),
    b AS (SELECT {k}, team, sum(rec_tgt) AS tg, sum(rush_att + rec) AS tch FROM player_stats GROUP BY {k}, team),
    sn AS (SELECT coalesce(a.year, c.year) AS year, coalesce(a.week, c.week) AS week, coalesce(a.name_key, c.name_key) AS name_key, coalesce(a.team, c.team) AS team, coalesce(a.offense_pct, c.snap_pct) AS pct
      FROM (SELECT * FROM usage WHERE offense_snaps > 0 AND offense_pct IS NOT NULL) a FULL OUTER JOIN (SELECT * FROM player_stats WHERE snap_pct IS NOT NULL AND position IN ('RB', 'WR', 'TE')) c ON a.year = c.year AND a.week = c.week AND a.name_key = c.name_key AND a.team = c.team),
    sp AS (SELECT {k}, name_key, team, {hu('avg(pct)', 1)} AS snap_pct FROM sn GROUP BY {k}, name_key, team)
    SELECT {', '.join('p.' + c for c in who)}, p.position, p.games, CAST(p.targets AS BIGINT) AS targets, CAST(p.touches AS BIGINT) AS touches,
      {hu("CASE WHEN tu.tg > 0 THEN 100.0E0 * coalesce(u.tg, p.targets) / tu.tg ELSE 100.0E0 * p.targets / nullif(b.tg, 0) END", 1)} AS target_share,
      {hu("CASE WHEN coalesce(tu.has_rec, false) AND tu.tch > 0 THEN 100.0E0 * coalesce(u.tch, p.touches) / tu.tch ELSE 100.0E0 * p.touches / nullif(b.tch, 0) END", 1)} AS touch_share,
      {hu('p.targets * 1.0E0 / p.games', 1)} AS targets_per_game, sp.snap_pct, {hu('u.air / nullif(u.tg, 0)', 1)} AS adot, {hu(air, 1)} AS air_yards_share, {hu(wopr, 2)} AS wopr, CAST(u.rz AS BIGINT) AS rz_targets
    FROM p LEFT JOIN u ON {on('p', 'u', who)} LEFT JOIN tu ON {on('p', 'tu', tm)} LEFT JOIN b ON {on('p', 'b', tm)} LEFT JOIN sp ON {on('p', 'sp', who)}"""


_USAGE_OUT = ["name_key", "team", "position", "games", "targets", "touches", "target_share", "touch_share", "targets_per_game", "snap_pct", "adot", "air_yards_share", "wopr", "rz_targets"]


@query("rp4_usage_season", usage_sql(False))
def _(t):
    return R.usage_rows(t.player_stats, t.usage).select("year", *_USAGE_OUT)


@query("rp4_usage_week", usage_sql(True))
def _(t):
    return R.usage_rows(t.player_stats, t.usage, ("year", "week")).select("year", "week", *_USAGE_OUT)


@query("rp5_points_against", f"SELECT year, position, opponent AS team, {hu(f'avg({PTS})', 2)} AS dk_pts_per_game FROM player_stats WHERE year = 1999 GROUP BY year, position, opponent")
def _(t):
    from chalkline.functions.scoring import counted_points

    fpa = t.player_stats.groupBy("year", "position", F.col("opponent").alias("team")).agg(half_up(F.avg(counted_points()), 2).alias("dk_pts_per_game"))
    return R.points_against(fpa, 1999)


@query("rp6_team_points_week", "SELECT year, week, team, points_scored, points_allowed FROM team_points WHERE year = 1999 AND week = 5")
def _(t):
    from chalkline.operators.filters import select_scope

    return select_scope(t.team_points, year=1999, week=5).select("year", "week", "team", "points_scored", "points_allowed")


@query("rp7_implied_points_table", f"""WITH {IMPLIED_SQL}, {DEPTH_SQL}, fd AS (SELECT name_key, max({hu('(salary - 2500) / 400.0E0 + length(name) / 8.0E0', 2)}) AS pts FROM slate WHERE cid % 5 <> 4 GROUP BY name_key)
    SELECT s.cid, s.year, s.week, i.implied_points, i.categories_used, fd.pts AS comparison_points, {hu('i.implied_points - fd.pts', 2)} AS comparison_diff,
      {hu('i.implied_points / (s.salary / 1000.0E0)', 2)} AS value_per_1k, {LABEL} AS depth_label
    FROM slate s LEFT JOIN ip_table i ON i.year = s.year AND i.week = s.week AND i.name_key = s.name_key LEFT JOIN dl ON dl.name_key = s.name_key LEFT JOIN fd ON fd.name_key = s.name_key""")
def _(t):
    theirs = t.slate.where("cid % 5 <> 4").select("name_key", half_up((F.col("salary") - 2500) / 400.0 + F.length("name") / 8.0, 2).alias("pts"))
    return R.implied_points_table(t.slate, lines(t), depth(t), theirs).select(
        "cid", "year", "week", "implied_points", "categories_used", "comparison_points", "comparison_diff", "value_per_1k", "depth_label")


Y, W = 2000, 9
MATCHUP_SQL = f"""{IMPLIED_SQL}, dl AS (SELECT name_key, min(string_rank) AS string_rank FROM depth GROUP BY name_key),
    past AS (SELECT *, {PTS} AS pts FROM player_stats WHERE year < {Y} OR (year = {Y} AND week < {W})),
    al AS (SELECT year, week, opponent AS team, position, sum(pts) AS pa FROM past WHERE year >= {Y - 1} AND position IN ('QB', 'RB', 'WR', 'TE') GROUP BY year, week, opponent, position),
    op AS (SELECT team, position, {hu('avg(pa)', 2)} AS opp_avg, count(*) AS opp_games FROM (SELECT *, row_number() OVER (PARTITION BY team, position ORDER BY year DESC, week DESC) AS rn FROM al) x WHERE rn <= 10 GROUP BY team, position),
    opr AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY opp_avg DESC, team) AS opp_rank, count(*) OVER (PARTITION BY position) AS opp_rank_total FROM op),
    own AS (SELECT name_key, {hu('avg(pts)', 2)} AS player_avg, count(*) AS player_games FROM (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY year DESC, week DESC) AS rn FROM past) x WHERE rn <= 10 GROUP BY name_key),
    lgr AS (SELECT position, name_key, {hu('avg(pts)', 2)} AS v FROM (SELECT *, row_number() OVER (PARTITION BY position, name_key ORDER BY year DESC, week DESC) AS rn FROM past WHERE year >= {Y - 1} AND position IN ('QB', 'RB', 'WR', 'TE')) x WHERE rn <= 10 GROUP BY position, name_key),
    lr AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY v DESC, name_key) AS player_rank, count(*) OVER (PARTITION BY position) AS player_rank_total FROM lgr),
    bm AS (SELECT s.cid, s.position, s.team, s.opponent, s.salary, opr.opp_avg, opr.opp_games, opp_rank, opp_rank_total, own.player_avg, own.player_games, player_rank, player_rank_total, {LABEL} AS depth_label,
      CASE WHEN CASE WHEN g.home_away = 'h' THEN s.team ELSE s.opponent END IN {DOME} THEN 'dome' ELSE 'outdoor' END AS roof, o.over_under, o.spread, o.favorite, i.implied_points,
      {hu(f"CAST(regexp_extract(o.over_under, '[0-9.]+') AS DOUBLE) / 2.0E0 - o.spread / 2.0E0", 1)} AS team_implied_total,
      {hu('(opp_rank - 1.0E0) / nullif(opp_rank_total - 1.0E0, 0)', 4)} AS opp_fraction, {hu('(player_rank - 1.0E0) / nullif(player_rank_total - 1.0E0, 0)', 4)} AS player_fraction
      FROM slate s JOIN dl ON dl.name_key = s.name_key LEFT JOIN opr ON opr.team = s.opponent AND opr.position = s.position LEFT JOIN own ON own.name_key = s.name_key LEFT JOIN lr ON lr.position = s.position AND lr.name_key = s.name_key
      LEFT JOIN schedule g ON g.year = s.year AND g.week = s.week AND g.team = s.team LEFT JOIN game_odds o ON o.year = s.year AND o.week = s.week AND o.team = s.team LEFT JOIN ip_table i ON i.year = s.year AND i.week = s.week AND i.name_key = s.name_key
      WHERE s.year = {Y} AND s.week = {W} AND s.position IN ('QB', 'RB', 'WR', 'TE'))"""
_BM = ["cid", "position", "team", "opponent", "salary", "opp_avg", "opp_games", "opp_rank", "opp_rank_total", "player_avg", "player_games", "player_rank", "player_rank_total", "depth_label", "roof", "over_under", "spread", "favorite",
       "implied_points", "team_implied_total", "opp_fraction", "player_fraction"]


def matchups(t):
    return R.best_matchups(t.slate, t.player_stats, t.depth, t.schedule, t.game_odds, lines(t), Y, W)


@query("rp8_best_matchups", f"WITH {MATCHUP_SQL} SELECT * FROM bm")
def _(t):
    return matchups(t).select(*_BM)


@query("rp8_value_fractions", f"""WITH {MATCHUP_SQL} SELECT cid, {hu('(max(implied_points) OVER () - implied_points) / nullif(max(implied_points) OVER () - min(implied_points) OVER (), 0)', 4)} AS implied_fraction,
    {hu('(max(team_implied_total) OVER () - team_implied_total) / nullif(max(team_implied_total) OVER () - min(team_implied_total) OVER (), 0)', 4)} AS team_total_fraction FROM bm""")
def _(t):
    f = R.with_value_fractions(matchups(t))
    return f.select("cid", half_up("implied_fraction", 4).alias("implied_fraction"), half_up("team_total_fraction", 4).alias("team_total_fraction"))


@query("rp9_implied_team_points", f"SELECT year, week, team, {TOTAL} AS total, {hu(TOTAL + ' / 2.0E0 - spread / 2.0E0', 1)} AS implied_total FROM game_odds")
def _(t):
    return R.implied_team_points(t.game_odds).select("year", "week", "team", "total", "implied_total")


@query("rp10_depth_charts", f"""SELECT d.team, d.pos, d.name_key, i.status, CAST(list_position(['QB','RB','LWR','RWR','SWR','TE'], d.pos) - 1 AS INT) AS pos_order, {LABEL.replace('dl.', 'd.')} AS depth_label
    FROM depth d LEFT JOIN (SELECT name_key, max(status) AS status FROM injuries_depth GROUP BY name_key) i USING (name_key) WHERE d.pos <> 'K'""")
def _(t):
    return R.depth_charts(t.depth, t.injuries_depth).select("team", "pos", "name_key", "status", "pos_order", "depth_label")


CURRENT_SQL = f"cur AS (SELECT year, week FROM schedule GROUP BY year, week HAVING max(kickoff) >= TIMESTAMP '1999-06-08 08:00:00' ORDER BY year, week LIMIT 1)"


@query("rp18_season_schedule", f"""WITH {CURRENT_SQL}, e AS (SELECT s.*, (kickoff AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS k FROM schedule s WHERE home_away = 'h')
    SELECT e.year, e.week, e.team AS home_team, e.opponent AS away_team, CAST(kickoff AS STRING) AS kickoff, strftime(k, '%A') AS day, ltrim(strftime(k, '%I:%M %p'), '0') AS time, c.year IS NOT NULL AS is_current FROM e LEFT JOIN cur c ON c.year = e.year AND c.week = e.week""")
def _(t):
    cur = R.current_week(t.schedule, ts("1999-06-11 00:00:00"))
    return R.season_schedule(t.schedule, cur).withColumn("kickoff", F.col("kickoff").cast("string"))


@query("rp19_game_overview", f"""WITH o AS (SELECT year, week, team, spread, {hu(TOTAL + ' / 2.0E0 - spread / 2.0E0', 1)} AS it FROM game_odds) SELECT w.year, w.week, w.home_team, w.away_team, h.spread AS home_spread, h.it AS home_implied, a.spread AS away_spread, a.it AS away_implied,
    CASE WHEN w.home_team IN {DOME} THEN 'dome' ELSE 'outdoor' END AS roof FROM weather w LEFT JOIN o h ON h.year = w.year AND h.week = w.week AND h.team = w.home_team LEFT JOIN o a ON a.year = w.year AND a.week = w.week AND a.team = w.away_team""")
def _(t):
    return R.game_overview(t.weather, t.game_odds).select("year", "week", "home_team", "away_team", "home_spread", "home_implied", "away_spread", "away_implied", "roof")


@query("rp20_weather_per_team", "SELECT year, week, home_team AS team, home_score AS score, away_score AS opponent_score, wind_mph FROM weather UNION ALL SELECT year, week, away_team, away_score, home_score, wind_mph FROM weather")
def _(t):
    return R.weather_per_team(t.weather).select("year", "week", "team", "score", "opponent_score", "wind_mph")


@query("rp21_current_week", f"WITH {CURRENT_SQL} SELECT * FROM cur")
def _(t):
    return R.current_week(t.schedule, ts("1999-06-11 00:00:00"))


@query("rp21_odds_week", "SELECT year, week, count(*) AS votes FROM game_odds GROUP BY year, week ORDER BY votes DESC, year, week LIMIT 1")
def _(t):
    return R.odds_week(t.game_odds.select("team", "kickoff"), t.schedule)


@query("rp21_odds_for_week", "SELECT team, spread FROM game_odds WHERE (SELECT year * 100 + week FROM (SELECT year, week, count(*) AS n FROM schedule GROUP BY year, week ORDER BY n DESC, year, week LIMIT 1) x) = 199501")
def _(t):
    return R.odds_for_week(t.game_odds, t.schedule, 1995, 1).select("team", "spread")


@query("rp24_load_schedule", "SELECT year, week, team, opponent, home_away, CAST(kickoff AS STRING) AS kickoff FROM schedule")
def _(t):
    g = t.schedule.where("home_away = 'h'").join(t.game_info.select("year", "week", F.col("home_team").alias("team"), "team_home", "team_away"), ["year", "week", "team"])
    local = F.from_utc_timestamp("kickoff", "America/New_York")
    odd = F.col("week") % 2 == 1
    raw = g.select("year", F.col("week").cast("string").alias("week"), F.when(odd, F.col("team_home")).otherwise(F.col("team_away")).alias("team_1"), F.when(odd, F.col("team_away")).otherwise(F.col("team_home")).alias("team_2"),
                   F.date_format(local, "yyyy-MM-dd").alias("date"), F.date_format(local, "h:mma").alias("time"), F.col("team_home").alias("location"), F.lit("x").alias("boxscore_url"))
    return R.load_schedule(raw).select("year", "week", "team", "opponent", "home_away", F.col("kickoff").cast("string").alias("kickoff"))


def schedule_file(t):
    return t.schedule.select("year", F.col("week").cast("string").alias("week"), F.date_format("kickoff", "yyyy-MM-dd").alias("date"))


@query("rp26_date_to_week", "SELECT year, CAST(CAST(kickoff AS DATE) AS STRING) AS game_date, min(week) AS week FROM schedule GROUP BY year, CAST(kickoff AS DATE)")
def _(t):
    return R.date_to_week(schedule_file(t)).withColumn("game_date", F.col("game_date").cast("string"))


STATE_SQL = """wd AS (SELECT year, week, max(CAST(kickoff AS DATE)) AS d FROM schedule GROUP BY year, week), ss AS (SELECT year, max(d) < DATE '2001-05-01' AS finished, coalesce(max(CASE WHEN d < DATE '2001-05-01' THEN week END), 0) AS latest_completed_week FROM wd GROUP BY year)"""


@query("rp26_season_state", f"WITH {STATE_SQL} SELECT * FROM ss")
def _(t):
    return R.season_state(schedule_file(t), F.to_date(F.lit("2001-05-01")))


@query("rp27_work_list", f"""WITH {STATE_SQL}, c AS (SELECT DISTINCT player_id, year FROM usage), h AS (SELECT player_id, year, max(week) AS w FROM player_stats WHERE rec > 0 GROUP BY player_id, year)
    SELECT c.player_id, c.year FROM c LEFT JOIN h USING (player_id, year) JOIN ss USING (year) WHERE NOT (h.w IS NOT NULL AND (finished OR h.w >= latest_completed_week))""")
def _(t):
    done = t.player_stats.select("player_id", "year", "week", (F.col("rec") <= 0).alias("placeholder"))
    return R.work_list(t.usage.select("player_id", "year").distinct(), done, R.season_state(schedule_file(t), F.to_date(F.lit("2001-05-01"))))


@query("rp28_build_usage", f"""WITH st AS (SELECT concat('g', CAST(cid AS STRING)) AS gsis_id, player_id AS pid, year, week, name, name_key, team, position, rec_tgt, rush_att, rec FROM player_stats),
    sn AS (SELECT player_id AS pid, year, week, name, name_key, team, position, offense_snaps, offense_pct FROM usage WHERE offense_snaps > 20),
    j AS (SELECT coalesce(st.gsis_id, concat('g', substr(sn.pid, 2))) AS gsis_id, coalesce(st.year, sn.year) AS year, coalesce(st.week, sn.week) AS week, coalesce(st.name_key, sn.name_key) AS name_key, coalesce(st.team, sn.team) AS team,
      coalesce(st.position, sn.position) AS position, coalesce(rec_tgt, 0) AS targets, coalesce(rush_att, 0) AS carries, coalesce(rec, 0) AS receptions, coalesce(offense_snaps, 0) AS offense_snaps, {hu('offense_pct / 128.0E0 * 100.0E0', 1)} AS offense_pct,
      {hu('rec_tgt * 8.0E0 / nullif(rec_tgt, 0)', 1)} AS adot FROM st FULL OUTER JOIN sn ON st.pid = sn.pid AND st.year = sn.year AND st.week = sn.week),
    pl AS (SELECT * FROM plays WHERE season_type = 'REG' AND coalesce(two_point_attempt, 0) = 0 AND coalesce(qb_kneel, 0) = 0),
    tg AS (SELECT receiver_player_id AS gsis_id, year, week, count(*) FILTER (yardline_100 <= 20) AS rz, count(*) FILTER (down = 3) AS td3 FROM pl WHERE play_type = 'pass' GROUP BY 1, 2, 3),
    ca AS (SELECT rusher_player_id AS gsis_id, year, week, count(*) FILTER (yardline_100 <= 10) AS i10 FROM pl WHERE play_type = 'run' GROUP BY 1, 2, 3)
    SELECT j.year, j.week, j.name_key, j.team, j.position, j.targets, j.carries, j.receptions, j.offense_snaps, j.offense_pct, j.adot, CAST(coalesce(tg.rz, 0) AS INT) AS rz_targets, CAST(coalesce(tg.td3, 0) AS INT) AS third_down_targets, CAST(coalesce(ca.i10, 0) AS INT) AS i10_carries
    FROM j LEFT JOIN tg ON tg.gsis_id = j.gsis_id AND tg.year = j.year AND tg.week = j.week LEFT JOIN ca ON ca.gsis_id = j.gsis_id AND ca.year = j.year AND ca.week = j.week""")
def _(t):
    s = t.player_stats.select(F.concat(F.lit("g"), F.col("cid").cast("string")).alias("gsis_id"), "year", "week", "name", F.upper("team").alias("team"), "position", F.lit("REG").alias("season_type"),
                              F.col("rec_tgt").alias("targets"), F.col("rush_att").alias("carries"), F.col("rec").alias("receptions"), F.lit(0.25).alias("target_share"), (F.col("rec_tgt") * 8.0).alias("air_yards"),
                              F.lit(0.5).alias("air_yards_share"), F.lit(0.75).alias("wopr"))
    sn = t.usage.where("offense_snaps > 20").select(F.col("player_id").alias("pfr_id"), "year", "week", "name", F.upper("team").alias("team"), F.when(F.col("position") == "RB", F.lit("HB")).otherwise(F.col("position")).alias("position"),
                                                   F.lit("REG").alias("game_type"), "offense_snaps", (F.col("offense_pct") / 128.0).alias("offense_pct"))
    ids = t.customer.select(F.concat(F.lit("g"), F.col("c_custkey").cast("string")).alias("gsis_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("pfr_id"))
    u = B.build_usage(s, sn, t.plays, ids)
    return u.select("year", "week", "name_key", "team", "position", "targets", "carries", "receptions", "offense_snaps", "offense_pct", "adot", "rz_targets", "third_down_targets", "i10_carries")


@query("rp29_build_defense", f"SELECT year, week, team, {hu(DEFENSE_SQL, 2)} AS dk_pts FROM (SELECT * REPLACE (CASE WHEN year < 2000 THEN sack + 1 ELSE sack END AS sack) FROM defense) x")
def _(t):
    d = t.defense.drop("points_allowed", "opponent")
    old = d.where("year < 2000").withColumn("sack", F.col("sack") + 1)
    return B.build_defense(d.where("year >= 2000"), old.unionByName(d.where("year >= 2000")), t.team_points).select("year", "week", "team", "dk_pts")


@query("rp30_build_game_odds", """SELECT concat(CAST(year AS STRING), '_', CAST(week AS STRING), '_', least(team, opponent)) AS event_id, team, opponent, spread, concat(CASE WHEN least(team, opponent) = team THEN 'o' ELSE 'o' END, CAST(40 + week AS STRING)) AS over_under,
    CASE WHEN spread < 0 THEN team WHEN spread > 0 THEN opponent END AS favorite FROM game_odds""")
def _(t):
    o = t.game_odds.withColumn("event_id", F.concat_ws("_", "year", "week", F.least("team", "opponent")))
    sp = o.select("event_id", F.lit("spread").alias("market"), F.upper("team").alias("team"), F.col("spread").cast("string").alias("value"), F.lit("-110").alias("odds"), "kickoff")
    tot = o.select("event_id", F.lit("total").alias("market"), F.upper("team").alias("team"), F.concat(F.lit("o"), (F.col("week") + 40).cast("string")).alias("value"), F.lit("-110").alias("odds"), "kickoff")
    return B.build_game_odds(sp.unionByName(tot)).select("event_id", "team", "opponent", "spread", "over_under", "favorite")
