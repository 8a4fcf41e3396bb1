"""Filters, joins, aggregations, sorts and set operations (FLT, JN, AG, SR, ST)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.catalog.registry import query
from chalkline.catalog.views import hu
from chalkline.functions import scoring as S
from chalkline.functions.teams import roof_type
from chalkline.functions.values import half_up
from chalkline.operators import aggregates as A, filters as FL, joins as J, ordered as W, sets as ST

NOW = "TIMESTAMP '1999-06-01 00:00:00'"
NOW_T = "TIMESTAMP '2024-01-16 12:00:00'"


def ts(text: str):
    return F.to_timestamp(F.lit(text))


def counts(name: str, sql_rows: str, sql_key: str):
    return f"SELECT {sql_key}, count(*) AS n FROM ({sql_rows}) x GROUP BY {sql_key}"


QCOLS = "player_id, book, line"


# --- filters ------------------------------------------------------------------------------------------------------

@query("flt1_drop_started", f"""SELECT event_id, q.team FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE team END AS team FROM quotes_t) q
    WHERE NOT EXISTS (SELECT 1 FROM kickoffs_t k WHERE k.team = q.team AND k.kickoff <= {NOW_T})""")
def _(t):
    q = t.quotes_t.select("event_id", F.when(F.col("event_id") % 50 != 0, F.col("team")).alias("team"))
    return FL.drop_started(q, t.kickoffs_t, ts("2024-01-16 12:00:00")).select("event_id", "team")


@query("flt2_only_available", f"SELECT {QCOLS} FROM quotes WHERE available IS NULL OR available")
def _(t):
    return FL.only_available(t.quotes).select("player_id", "book", "line")


@query("flt3_exclude_books", f"""SELECT {QCOLS} FROM quotes WHERE book NOT IN ('betmgm', 'circa') AND NOT (book = 'bet365' AND category = 'touchdowns')""")
def _(t):
    return FL.exclude_books(t.unstaged("quotes"), ["betmgm", "circa"], [("bet365", "touchdowns")]).select("player_id", "book", "line")


@query("flt4_drop_pickem", "SELECT player_id, lower(book) AS book, line FROM quotes WHERE lower(book) <> 'prizepicks'")
def _(t):
    return FL.drop_pickem(t.quotes.withColumn("book", F.lower("book"))).select("player_id", "book", "line")


@query("flt5_require", f"SELECT {QCOLS} FROM quotes WHERE under_odds IS NOT NULL AND site_projection IS NOT NULL")
def _(t):
    return FL.require(t.quotes, ["under_odds", "site_projection"]).select("player_id", "book", "line")


@query("flt6_select_scope", "SELECT player_id, year, week FROM player_stats WHERE year = 1999 AND position IN ('QB', 'RB')")
def _(t):
    return FL.select_scope(t.player_stats, year=1999, position=["QB", "RB"], team=None).select("player_id", "year", "week")


@query("flt6_latest_scope", """SELECT player_id, year, week FROM player_stats WHERE year * 100 + week = (SELECT max(year * 100 + week) FROM player_stats)""")
def _(t):
    return FL.latest_scope(t.player_stats).select("player_id", "year", "week")


@query("flt7_before_week", "SELECT player_id, year, week FROM player_stats WHERE year >= 1998 AND (year < 1999 OR (year = 1999 AND week < 9))")
def _(t):
    return FL.before_week(t.player_stats, 1999, 9, since=1998).select("player_id", "year", "week")


@query("flt8_slate_filter", f"""SELECT s.cid, s.year, s.week FROM slate s LEFT JOIN (SELECT name_key, max(string_rank) AS string_rank FROM depth GROUP BY name_key) d ON d.name_key = s.name_key
    LEFT JOIN schedule g ON g.year = s.year AND g.week = s.week AND g.team = s.team
    WHERE position = 'RB' AND contains(lower(s.name), 'last1') AND coalesce(string_rank, 0) <> 2 AND coalesce(string_rank, 0) < 3 AND NOT coalesce(g.kickoff <= {NOW}, false)""")
def _(t):
    d = t.depth.groupBy("name_key").agg(F.max("string_rank").alias("string_rank"))
    s = t.slate.join(d, "name_key", "left").join(t.schedule.select("year", "week", "team", "kickoff"), ["year", "week", "team"], "left")
    s = s.withColumn("locked", F.coalesce(F.col("kickoff") <= ts("1999-06-01 00:00:00"), F.lit(False)))
    return FL.slate_filter(s, "RB", "last1", True, True, True).select("cid", "year", "week")


@query("flt9_regular_games", "SELECT year, week, team FROM schedule WHERE week <= 17 AND team <> 'ari' AND home_away = 'h'")
def _(t):
    s = t.schedule.select("year", F.when(F.col("week") == 18, F.lit("WildCard")).otherwise(F.col("week").cast("string")).alias("week"), "team",
                          F.when(F.col("team") == "ari", F.lit("BYE")).otherwise(F.col("team")).alias("team_1"), F.col("opponent").alias("team_2"),
                          F.when(F.col("home_away") == "h", F.lit("u")).otherwise(F.lit("")).alias("boxscore_url"))
    return FL.regular_games(s, need_boxscore=True).select("year", "week", "team")


@query("flt10_scrimmage_plays", """SELECT year, week, play_type, count(*) AS n FROM plays WHERE season_type = 'REG' AND play_type IN ('pass', 'run')
    AND coalesce(two_point_attempt, 0) = 0 AND coalesce(qb_kneel, 0) = 0 GROUP BY year, week, play_type""")
def _(t):
    return FL.scrimmage_plays(t.plays).groupBy("year", "week", "play_type").agg(F.count(F.lit(1)).alias("n"))


@query("flt11_threshold", f"SELECT {QCOLS} FROM quotes WHERE over_odds >= -150 AND over_odds <= 130")
def _(t):
    return FL.threshold(t.quotes, "over_odds", -150, 130).select("player_id", "book", "line")


@query("flt12_locked_teams", f"SELECT DISTINCT year, week, team FROM schedule WHERE kickoff <= {NOW}")
def _(t):
    return FL.locked_teams(t.schedule, ts("1999-06-01 00:00:00"))


# --- joins --------------------------------------------------------------------------------------------------------

@query("jn1_salaries_with_stats", """SELECT s.cid, s.year, s.week, s.salary, p.rush_yds FROM slate s LEFT JOIN player_stats p USING (year, week, name_key)""")
def _(t):
    return J.salaries_with_stats(t.slate, t.player_stats.select("year", "week", "name_key", "rush_yds")).select("cid", "year", "week", "salary", "rush_yds")


@query("jn2_picks_with_bets", "SELECT p.submitter, p.prop_id, p.pick, b.line, b.stat_field FROM prop_picks p JOIN prop_bets b USING (prop_id)")
def _(t):
    return J.picks_with_bets(t.prop_picks.select("submitter", "prop_id", "pick"), t.prop_bets.select("prop_id", "line", "stat_field"))


@query("jn3_lookup", """SELECT s.cid, s.year, s.week, d.player_name AS starter FROM slate s LEFT JOIN (SELECT team, pos AS position, player_name,
    row_number() OVER (PARTITION BY team, pos ORDER BY string_rank DESC, name_key DESC) AS rn FROM depth) d
    ON d.team = s.team AND d.position = s.position AND d.rn = 1""")
def _(t):
    dim = t.depth.select("team", F.col("pos").alias("position"), "player_name", "string_rank", "name_key")
    return J.lookup(t.slate.select("cid", "year", "week", "team", "position"), dim, ["team", "position"],
                    [F.desc("string_rank"), F.desc("name_key")]).select("cid", "year", "week", F.col("player_name").alias("starter"))


@query("jn4_full_outer_fill", """SELECT coalesce(p.player_id, u.player_id) AS player_id, coalesce(p.year, u.year) AS year, coalesce(p.week, u.week) AS week, coalesce(p.team, u.team) AS team,
    p.rush_yds, u.targets FROM player_stats p FULL OUTER JOIN usage u ON p.player_id = u.player_id AND p.year = u.year AND p.week = u.week""")
def _(t):
    key = ["player_id", "year", "week"]
    return J.full_outer_fill(t.player_stats.select(*key, "team", "rush_yds"), t.usage.select(*key, "team", "targets"), key, ["team"])


@query("jn5_on_depth_chart", "SELECT cid, year, week FROM slate s WHERE name_key IN (SELECT name_key FROM depth)")
def _(t):
    return J.on_depth_chart(t.slate, t.depth).select("cid", "year", "week")


@query("jn6_only_in", """SELECT name_key, 'left' AS side FROM (SELECT DISTINCT name_key FROM usage) WHERE name_key NOT IN (SELECT name_key FROM depth)
    UNION ALL SELECT name_key, 'right' FROM depth WHERE name_key NOT IN (SELECT name_key FROM usage)""")
def _(t):
    return J.only_in(t.usage.select("name_key").distinct(), t.depth.select("name_key"), ["name_key"])


@query("jn7_compare_join", "SELECT player_id, book, snapshot, a.line AS line_b, b.line AS line_c FROM quotes a JOIN quotes_now b USING (player_id, book, snapshot)")
def _(t):
    c = ["player_id", "book", "snapshot", "line"]
    return J.compare_join(t.quotes.select(*c), t.quotes_now.select(*c), ["player_id", "book", "snapshot"], ("_b", "_c"))


@query("jn8_other_books", f"""SELECT a.player_id, a.snapshot, a.book, count(b.line) AS others, {hu('avg(b.line)', 4)} AS mean_line, {hu('median(b.line)', 4)} AS median_line
    FROM quotes a JOIN quotes b ON a.player_id = b.player_id AND a.snapshot = b.snapshot AND a.book <> b.book WHERE a.book IN ('draftkings', 'caesars') GROUP BY a.player_id, a.snapshot, a.book""")
def _(t):
    refs = J.quotes_against_targets(t.quotes, ["draftkings", "caesars"]).groupBy("player_id", "snapshot", F.col("target_book").alias("book")).agg(
        F.count("line").alias("others"), half_up(F.avg("line"), 4).alias("mean_line"), half_up(F.median("line"), 4).alias("median_line"))
    return refs.join(t.quotes.select("player_id", "snapshot", "book"), ["player_id", "snapshot", "book"], "left_semi")


@query("jn9_asof_before", """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
    r AS (SELECT event_id AS rid, user_id, ts, value FROM events WHERE event_type = 'view')
    SELECT event_id, rid, value FROM (SELECT l.event_id, r.rid, r.value, row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts DESC, r.rid DESC) AS rn
      FROM l LEFT JOIN r ON r.user_id = l.user_id AND r.ts < l.ts) x WHERE rn = 1""")
def _(t):
    e = t.events
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("t0"))
    right = e.where("event_type = 'view'").select(F.col("event_id").alias("rid"), "user_id", F.col("ts").alias("t1"), "value")
    return J.asof_before(left, right, ["user_id"], "t0", "t1", ["rid", "value"], tiebreak=["rid"]).select("event_id", "rid", "value")


@query("jn10_nearest_within", """SELECT year, week, team, gyear, gweek, gap_seconds FROM (SELECT o.year, o.week, o.team, s.year AS gyear, s.week AS gweek,
    CAST(abs(epoch(s.kickoff) - epoch(o.kickoff)) AS BIGINT) AS gap_seconds, row_number() OVER (PARTITION BY o.year, o.week, o.team ORDER BY abs(epoch(s.kickoff) - epoch(o.kickoff)), s.year, s.week) AS rn
    FROM game_odds o JOIN schedule s ON s.team = o.team AND abs(epoch(s.kickoff) - epoch(o.kickoff)) <= 86400) x WHERE rn = 1""")
def _(t):
    o = t.game_odds.select("year", "week", "team", F.col("kickoff").alias("odds_kickoff"))
    s = t.schedule.select("team", F.col("year").alias("gyear"), F.col("week").alias("gweek"), F.col("kickoff").alias("game_kickoff"))
    return J.nearest_within(o, s, ["team"], "odds_kickoff", "game_kickoff", ["year", "week", "team"], ["gyear", "gweek"]).select(
        "year", "week", "team", "gyear", "gweek", "gap_seconds")


@query("jn11_resolve_team", """WITH a AS (SELECT name_key, max(team) AS team FROM depth GROUP BY name_key), b AS (SELECT name_key, max(team) AS team FROM injuries_edge GROUP BY name_key),
    c AS (SELECT name_key, max(team) AS team FROM player_stats GROUP BY name_key), n AS (SELECT DISTINCT name_key FROM slate)
    SELECT n.name_key, coalesce(a.team, b.team, c.team) AS team FROM n LEFT JOIN a USING (name_key) LEFT JOIN b USING (name_key) LEFT JOIN c USING (name_key)""")
def _(t):
    return J.resolve_team(t.slate.select("name_key").distinct(), [t.depth, t.injuries_edge, t.player_stats])


@query("jn12_match_player", """WITH pl AS (SELECT DISTINCT name_key, split_part(name_key, ' ', 2) AS last_name, team FROM player_stats),
    f AS (SELECT last_name, team, min(name_key) AS k FROM pl GROUP BY last_name, team HAVING min(name_key) = max(name_key))
    SELECT b.cid, b.year, b.week, CASE WHEN EXISTS (SELECT 1 FROM pl WHERE pl.name_key = b.name_key) THEN b.name_key ELSE f.k END AS matched_key
    FROM bets b LEFT JOIN f ON f.last_name = split_part(b.name_key, ' ', 2) AND f.team = b.team""")
def _(t):
    pl = t.player_stats.select("name_key", F.split("name_key", " ")[1].alias("last_name"), "team").distinct()
    return J.match_player(t.bets.select("cid", "year", "week", "name_key", "team"), pl).select("cid", "year", "week", "matched_key")


_POINTS = "coalesce(dk_pts_reported, dk_pts)"


def stats_points(t):
    return t.player_stats.select("year", "week", "name_key", "team", S.counted_points().alias("points"))


def defense_points(t):
    return t.defense.select("year", "week", "team", S.defense_points().alias("points"))


@query("jn13_score_slots", """WITH d AS (SELECT year, week, team AS dst_team, sack + 2 * interception + 2 * fumble_rec + 6 * (def_td + special_teams_td) + 2 * safety
      + CASE WHEN points_allowed <= 0 THEN 10.0E0 WHEN points_allowed <= 6 THEN 7.0E0 WHEN points_allowed <= 13 THEN 4.0E0 WHEN points_allowed <= 20 THEN 1.0E0
        WHEN points_allowed <= 27 THEN 0.0E0 WHEN points_allowed <= 34 THEN -1.0E0 ELSE -4.0E0 END AS points FROM defense)
    SELECT s.submitter, s.year, s.week, s.rn, s.cid, CASE WHEN s.slot = 'DST' THEN d.points ELSE coalesce(p.dk_pts_reported, p.dk_pts) END AS actual_pts
    FROM slots s LEFT JOIN player_stats p ON p.year = s.year AND p.week = s.week AND p.name_key = s.name_key LEFT JOIN d ON d.year = s.year AND d.week = s.week AND d.dst_team = s.dst_team""")
def _(t):
    return J.score_slots(t.slots, stats_points(t), defense_points(t)).select("submitter", "year", "week", "rn", "cid", "actual_pts")


@query("jn14_per_team", """SELECT year, week, home_team AS team, away_team AS opponent, 'h' AS home_away, home_score AS score, away_score AS opponent_score FROM weather
    UNION ALL SELECT year, week, away_team, home_team, 'a', away_score, home_score FROM weather""")
def _(t):
    return J.per_team(t.weather).select("year", "week", "team", "opponent", "home_away", "score", "opponent_score")


@query("jn15_fill_id", """SELECT player_id, year, week, coalesce(CASE WHEN rec > 5 THEN concat('g', player_id) END, x.gsis) AS gsis_id FROM player_stats
    LEFT JOIN (SELECT player_id, concat('g', min(player_id)) AS gsis FROM usage GROUP BY player_id) x USING (player_id)""")
def _(t):
    df = t.player_stats.select("player_id", "year", "week", F.when(F.col("rec") > 5, F.concat(F.lit("g"), "player_id")).alias("gsis_id"))
    return J.fill_id(df, t.usage.select("player_id", F.concat(F.lit("g"), "player_id").alias("gsis_id")), "player_id", "gsis_id")


@query("jn16_borrow", """SELECT u.player_id, u.year, u.week, p.dk_pts, p.player_id IS NOT NULL AS matched FROM usage u LEFT JOIN player_stats p
    ON p.player_id = u.player_id AND p.year = u.year AND p.week = u.week""")
def _(t):
    key = ["player_id", "year", "week"]
    return J.borrow(t.usage.select(*key), t.player_stats.select(*key, "dk_pts"), key, ["dk_pts"], [F.desc("dk_pts")])


# --- aggregations -------------------------------------------------------------------------------------------------

_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in A.SEASON_SUMS)


@query("ag1_season_totals", f"""SELECT year, player_id, position, team, count(*) AS games, {_SUMS}, {hu(f'sum({_POINTS})', 2)} AS total_pts, {hu(f'avg({_POINTS})', 2)} AS avg_pts
    FROM player_stats GROUP BY year, player_id, position, team""")
def _(t):
    return A.season_totals(t.player_stats)


@query("ag2_career_totals", f"""SELECT player_id, count(*) AS games, {_SUMS}, {hu(f'sum({_POINTS})', 2)} AS total_pts, {hu(f'avg({_POINTS})', 2)} AS avg_pts
    FROM player_stats GROUP BY player_id""")
def _(t):
    return A.career_totals(t.player_stats)


@query("ag3_team_points_season", f"""SELECT year, team, count(*) AS games, CAST(sum(points_scored) AS BIGINT) AS points_scored, CAST(sum(points_allowed) AS BIGINT) AS points_allowed,
    {hu('avg(points_scored)', 1)} AS avg_scored, {hu('avg(points_allowed)', 1)} AS avg_allowed FROM team_points GROUP BY year, team""")
def _(t):
    return A.team_points_season(t.team_points)


@query("ag4_allowed_by_position", f"""SELECT year, week, opponent AS team, position, sum({_POINTS}) AS pts_allowed FROM player_stats
    WHERE position IN ('QB', 'RB', 'WR', 'TE') GROUP BY year, week, opponent, position""")
def _(t):
    return A.allowed_by_position(t.player_stats)


@query("ag5_team_totals", """SELECT year, team, CAST(sum(coalesce(rec_tgt, 0)) AS BIGINT) AS team_targets, CAST(sum(coalesce(rush_att, 0) + coalesce(rec, 0)) AS BIGINT) AS team_touches
    FROM player_stats GROUP BY year, team""")
def _(t):
    return A.team_totals(t.player_stats)


@query("ag6_current_week", f"SELECT year, week FROM schedule GROUP BY year, week HAVING max(kickoff) >= {NOW} ORDER BY year, week LIMIT 1")
def _(t):
    return A.current_week(t.schedule, ts("1999-06-01 00:00:00"))


@query("ag7_available_weeks", "SELECT DISTINCT year, week, submitter FROM slots")
def _(t):
    return A.available_weeks(t.slots, ["submitter"])


@query("ag8_team_context", f"""SELECT team, {hu('avg(pa)', 1)} AS team_pass_att_pg, {hu('avg(c)', 1)} AS players_with_catch_pg FROM (SELECT team, year, week, sum(pass_att) AS pa,
    sum(CASE WHEN rec > 0 THEN 1 ELSE 0 END) AS c FROM player_stats GROUP BY team, year, week) x GROUP BY team""")
def _(t):
    return A.team_context(t.player_stats)


@query("ag9_pbp_counts", """WITH r AS (SELECT receiver_player_id AS gsis_id, year, week, yardline_100 AS y, down, 't' AS role FROM plays WHERE play_type IN ('pass', 'run') AND season_type = 'REG'
      AND coalesce(two_point_attempt, 0) = 0 AND coalesce(qb_kneel, 0) = 0 AND receiver_player_id IS NOT NULL
      UNION ALL SELECT rusher_player_id, year, week, yardline_100, down, 'c' FROM plays WHERE play_type = 'run' AND season_type = 'REG'
      AND coalesce(two_point_attempt, 0) = 0 AND coalesce(qb_kneel, 0) = 0 AND rusher_player_id IS NOT NULL)
    SELECT gsis_id, year, week, count(*) FILTER (role = 't' AND y <= 20) AS rz_targets, count(*) FILTER (role = 't' AND y <= 10) AS i10_targets, count(*) FILTER (role = 't' AND y <= 5) AS i5_targets,
      count(*) FILTER (role = 'c' AND y <= 20) AS rz_carries, count(*) FILTER (role = 'c' AND y <= 10) AS i10_carries, count(*) FILTER (role = 'c' AND y <= 5) AS i5_carries,
      count(*) FILTER (role = 't' AND down = 3) AS third_down_targets FROM r GROUP BY gsis_id, year, week""")
def _(t):
    return A.pbp_counts(FL.scrimmage_plays(t.plays), ["gsis_id", "year", "week"])


@query("ag10_fold_duplicates", """SELECT name_key, week, max(targets) AS targets, max(carries) AS carries, arg_min(team, year) FILTER (team <> 'ari') AS team FROM usage GROUP BY name_key, week""")
def _(t):
    u = t.usage.select("name_key", "week", "targets", "carries", F.when(F.col("team") != "ari", F.col("team")).alias("team"),
                       F.col("year").cast("string").alias("src"))
    return A.fold_duplicates(u, ["name_key", "week"], "src")


@query("ag11_grouped_stats", f"""SELECT category, count(*) AS n, {hu('avg(line)', 4)} AS mean_value, {hu('median(line)', 4)} AS median_value, count(DISTINCT book) AS n_distinct FROM quotes GROUP BY category""")
def _(t):
    return A.grouped_stats(t.quotes, ["category"], "line", "book")


@query("ag12_joined_distinct", "SELECT player_id, string_agg(DISTINCT book, ',' ORDER BY book) AS books FROM quotes GROUP BY player_id")
def _(t):
    return A.joined_distinct(t.quotes, ["player_id"], "book", "books")


@query("ag13_history_sd", f"""SELECT name_key, history_games, {hu('CASE WHEN history_games >= 6 THEN sd END', 4)} AS history_sd FROM (SELECT name_key, count(rush_yds) AS history_games, stddev_samp(rush_yds) AS sd
    FROM player_stats GROUP BY name_key) x""")
def _(t):
    return A.history_sd(t.player_stats, ["name_key"], "rush_yds").withColumn("history_sd", half_up("history_sd", 4))


_BIN = "CASE " + " ".join(f"WHEN p > {lo} AND p <= {hi} THEN '({lo:g}, {hi:g}]'" for lo, hi in zip(A.CALIBRATION_BINS, A.CALIBRATION_BINS[1:])) + " END"


@query("ag14_calibration", f"""SELECT {_BIN} AS bucket, count(*) AS n, {hu('avg(p)', 3)} AS predicted, {hu('avg(y)', 3)} AS actual FROM (SELECT snap_pct / 128.0E0 AS p, CASE WHEN rush_td > 0 THEN 1.0E0 ELSE 0.0E0 END AS y
    FROM player_stats) x WHERE {_BIN} IS NOT NULL GROUP BY {_BIN}""")
def _(t):
    df = t.player_stats.select((F.col("snap_pct") / 128.0).alias("p"), F.when(F.col("rush_td") > 0, 1.0).otherwise(0.0).alias("y"))
    return A.calibration(df, "y", "p")


_CLIPPED = "least(greatest(snap_pct / 128.0E0, 1E-4), 0.9999E0)"


@query("ag15_log_loss", f"""SELECT position, count(*) AS n, {hu(f"-avg(y * ln({_CLIPPED}) + (1.0E0 - y) * ln(1.0E0 - {_CLIPPED}))", 6)} AS log_loss
    FROM (SELECT *, CASE WHEN rush_td > 0 THEN 1.0E0 ELSE 0.0E0 END AS y FROM player_stats WHERE snap_pct IS NOT NULL) x GROUP BY position""")
def _(t):
    df = t.player_stats.where("snap_pct IS NOT NULL").select("position", (F.col("snap_pct") / 128.0).alias("p"), F.when(F.col("rush_td") > 0, 1.0).otherwise(0.0).alias("y"))
    return A.log_loss(df, "y", "p", ["position"]).withColumn("log_loss", half_up("log_loss", 6))


@query("ag16_majority", "SELECT year, week, count(*) AS votes FROM player_stats GROUP BY year, week ORDER BY votes DESC, year, week LIMIT 1")
def _(t):
    return A.majority(t.player_stats, ["year", "week"])


@query("ag17_roi_summary", f"""WITH g AS (SELECT source, book, CASE WHEN s % 3 = 0 THEN 'win' WHEN s % 3 = 1 THEN 'loss' WHEN s % 7 = 2 THEN 'push' ELSE 'pending' END AS result, ev_pct,
      CASE WHEN s % 3 = 0 THEN 1.5E0 WHEN s % 3 = 1 THEN -1.0E0 ELSE 0.0E0 END AS profit FROM (SELECT *, CAST(cid + week AS INT) AS s FROM bets) b)
    SELECT source, book, count(*) AS bets, count(*) FILTER (result = 'win') AS wins, {hu('sum(profit)', 2)} AS units, {hu('avg(ev_pct)', 2)} AS avg_claimed_ev,
      {hu('avg(ev_pct / 2.0E0)', 2)} AS avg_clv_pct, {hu('avg(ev_pct / 4.0E0)', 2)} AS avg_ev_at_close, {hu('sum(profit) / count(*) * 100.0E0', 2)} AS roi_pct
    FROM g WHERE result <> 'pending' GROUP BY source, book""")
def _(t):
    s = F.col("cid") + F.col("week")
    result = F.when(s % 3 == 0, "win").when(s % 3 == 1, "loss").when(s % 7 == 2, "push").otherwise("pending")
    g = t.bets.withColumns({"result": result, "profit": F.when(s % 3 == 0, 1.5).when(s % 3 == 1, -1.0).otherwise(0.0),
                            "clv_pct": F.col("ev_pct") / 2, "ev_at_close": F.col("ev_pct") / 4})
    return A.roi_summary(g)


@query("ag18_lineup_total", f"""SELECT year, week, submitter, count(p) AS matched, CASE WHEN count(p) = 9 THEN {hu('sum(p)', 2)} END AS score
    FROM (SELECT year, week, submitter, CASE WHEN status <> 'P' THEN salary / 128.0E0 END AS p FROM slots) x GROUP BY year, week, submitter""")
def _(t):
    rows = t.slots.withColumn("actual_pts", F.when(F.col("status") != "P", F.col("salary") / 128.0))
    return A.lineup_total(rows)


@query("ag19_ordered_list", "SELECT player_id, string_agg(team, '>' ORDER BY year, week) AS teams FROM player_stats GROUP BY player_id")
def _(t):
    return A.ordered_list(t.player_stats, ["player_id"], ["year", "week"], "team", "l").select("player_id", F.array_join("l", ">").alias("teams"))


@query("ag20_value_counts", "SELECT category, count(*) AS n FROM quotes GROUP BY category")
def _(t):
    return A.value_counts(t.quotes, "category")


@query("ag21_coverage", """SELECT year, week, count(*) AS n_rows, count(snap_pct) AS with_value, string_agg(DISTINCT position, ',' ORDER BY position) AS sources FROM player_stats GROUP BY year, week""")
def _(t):
    return A.coverage(t.player_stats, "snap_pct", "position")


# --- sorts and sets -----------------------------------------------------------------------------------------------

@query("sr1_order_by_position", "SELECT cid, year, week, position, salary FROM slate")
def _(t):
    return ST.order_by_position(t.slate, "salary", ("cid", "year", "week")).select("cid", "year", "week", "position", "salary")


@query("sr2_order_nulls_last", "SELECT player_id, year, week, snap_pct FROM player_stats")
def _(t):
    return ST.order_nulls_last(t.player_stats.select("player_id", "year", "week", "snap_pct"), "snap_pct", ("player_id", "year", "week"), absolute=True)


@query("sr3_top_n_per_category", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY CASE WHEN category = 'touchdowns' THEN site_projection END DESC NULLS LAST, src_pos, cid) AS rn,
      min(src_pos) OVER (PARTITION BY category) AS category_pos FROM (SELECT year, week, cid, category, line, site_projection, src_pos * 10000 + cid AS src_pos FROM prop_lines) p)
    SELECT category, year, week, cid, line, CAST(rn AS INT) AS category_rank, category_pos FROM r WHERE rn <= 10""")
def _(t):
    p = t.prop_lines.withColumn("src_pos", F.col("src_pos") * 10000 + F.col("cid"))
    return ST.top_n_per_category(p, 10).select("category", "year", "week", "cid", "line", "category_rank", "category_pos")


@query("sr4_latest", "SELECT year, week, cid, salary FROM slate ORDER BY year DESC, week DESC, salary DESC, cid LIMIT 25")
def _(t):
    return ST.head(t.slate, [F.desc("year"), F.desc("week"), F.desc("salary"), F.col("cid")], 25).select("year", "week", "cid", "salary")


@query("st1_stack_tables", "SELECT player_id, book, line, over_odds, NULL AS under_odds FROM quotes UNION ALL SELECT player_id, book, line, NULL, under_odds FROM quotes_now")
def _(t):
    return ST.stack_tables(t.quotes.select("player_id", "book", "line", "over_odds"), t.quotes_now.select("player_id", "book", "line", "under_odds"))


@query("st2_all_values", "SELECT name_key FROM usage UNION SELECT name_key FROM depth")
def _(t):
    return ST.all_values(t.usage, t.depth, ["name_key"])


@query("st3_missing_from", "SELECT DISTINCT category FROM quotes WHERE category NOT IN (SELECT category FROM bets) ")
def _(t):
    return ST.missing_from(t.quotes, t.bets, ["category"])


@query("st4_overlap_count", "SELECT count(*) AS overlap FROM (SELECT name_key FROM usage INTERSECT SELECT name_key FROM depth) x")
def _(t):
    return ST.overlap_count(t.usage, t.depth, ["name_key"])


@query("st5_add_byes", """SELECT w.year, w.week, a.team, 'BYE' AS opponent FROM (SELECT year, week, count(*) AS n FROM schedule GROUP BY year, week HAVING count(*) < 32) w
    JOIN (SELECT DISTINCT year, team FROM schedule) a ON a.year = w.year WHERE NOT EXISTS (SELECT 1 FROM schedule s WHERE s.year = w.year AND s.week = w.week AND s.team = a.team)""")
def _(t):
    return ST.add_byes(t.schedule)


@query("st6_distinct_on", """SELECT player_id, book, line FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY line DESC, book) AS rn FROM quotes) x WHERE rn = 1""")
def _(t):
    return ST.distinct_on(t.quotes, ["player_id"], [F.desc("line"), F.col("book")]).select("player_id", "book", "line")


_ = (W, roof_type)
