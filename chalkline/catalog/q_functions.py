"""Scalar functions (FN) on the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.catalog.registry import query
from chalkline.catalog.views import dec, fair, hu, ip, offense_sql
from chalkline.functions import clock, conditions as C, names as N, odds as O, scoring as S, teams as T, values as V
from chalkline.functions.fits import fit_param
from chalkline.functions.scoring import FIELD_PARTS, GRADING_PARTS, LOW_LINE_PARTS
from chalkline.plans.reports import implied_points

CLEAN = r"regexp_replace(regexp_replace(trim(lower(player_name)), '[^a-z0-9 ]', '', 'g'), '\s+', ' ', 'g')"
SHORT = rf"trim(regexp_replace({CLEAN}, '\s+(jr|sr|ii|iii|iv|v)$', ''))"
KEY_SQL = f"CASE WHEN contains({SHORT}, ' ') THEN {SHORT} ELSE {CLEAN} END"


@query("fn1_normalize_name", f"SELECT player_id, book, {KEY_SQL} AS name_key FROM quotes")
def _(t):
    return t.quotes.select("player_id", "book", N.normalize_name("player_name").alias("name_key"))


@query("fn2_plain_name_key", r"""SELECT player_id, book,
    trim(regexp_replace(lower(player_name), '[^a-z0-9 ]', '', 'g')) AS plain_key,
    trim(regexp_replace(lower(concat(trim(split_part(c, ',', 2)), ' ', trim(split_part(c, ',', 1)))), '[^a-z0-9 ]', '', 'g')) AS flipped_key
    FROM (SELECT *, concat(book, ', ', player_name) AS c FROM quotes) x""")
def _(t):
    q = t.quotes.withColumn("c", F.concat("book", F.lit(", "), "player_name"))
    return q.select("player_id", "book", N.plain_name_key("player_name").alias("plain_key"),
                    N.plain_name_key("c", flip_comma=True).alias("flipped_key"))


@query("fn3_name_key", f"""SELECT player_id, book, coalesce({KEY_SQL}, '') AS name_key FROM (
    SELECT player_id, book, CASE WHEN stored IS NOT NULL AND trim(stored) <> '' THEN trim(stored) ELSE player_name END AS player_name
    FROM (SELECT *, CASE WHEN available THEN '  ' WHEN available IS NULL THEN NULL ELSE concat(book, ' Stored Sr') END AS stored FROM quotes) y) x""")
def _(t):
    stored = F.when(F.col("available"), F.lit("  ")).when(F.col("available").isNotNull(), F.concat("book", F.lit(" Stored Sr")))
    return t.quotes.select("player_id", "book", N.name_key(stored, "player_name").alias("name_key"))


@query("fn4_depth_chart_name", """SELECT c_custkey, concat('F', lower(c_mktsegment), ' ', upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2))) AS display
    FROM customer""")
def _(t):
    raw = F.concat(F.col("c_mktsegment"), F.lit(", F"), F.lower("c_mktsegment"), F.lit(" 24/2"))
    return t.customer.select("c_custkey", N.depth_chart_name(raw).alias("display"))


@query("fn5_normalize_team", """SELECT year, week, home_team AS from_full, away_team AS from_dst, away_team AS from_nickname, '' AS unknown FROM game_info""")
def _(t):
    g = t.game_info
    nick = F.element_at(F.split("team_away", " "), -1)
    return g.select("year", "week", T.normalize_team("team_home").alias("from_full"),
                    T.normalize_team(F.concat(F.lit(" "), F.col("team_away"), F.lit(" D/ST"))).alias("from_dst"),
                    T.normalize_team(F.concat(F.lit("The "), nick)).alias("from_nickname"),
                    T.normalize_team(F.lit("nowhere town")).alias("unknown"))


@query("fn6_legacy_codes", """SELECT 'schedule' AS table_name, col AS column_name, code, count(*) AS n_rows FROM (
    SELECT 'team' AS col, CASE team WHEN 'lvr' THEN 'oak' WHEN 'lac' THEN 'sdg' ELSE team END AS code FROM schedule WHERE year < 2000
    UNION ALL SELECT 'opponent', CASE opponent WHEN 'lvr' THEN 'oak' WHEN 'lac' THEN 'sdg' ELSE opponent END FROM schedule WHERE year < 2000) x
    WHERE code IN ('oak', 'sdg', 'stl') GROUP BY col, code""")
def _(t):
    from chalkline.sources.tables import legacy_code_counts

    old = lambda c: F.when(F.col(c) == "lvr", F.lit("oak")).when(F.col(c) == "lac", F.lit("sdg")).otherwise(F.col(c)).alias(c)
    s = t.schedule.where(F.col("year") < 2000).select(old("team"), old("opponent"))
    return legacy_code_counts({"schedule": (s, ["team", "opponent"])})


@query("fn6_rewrite_codes", "SELECT year, week, team, opponent FROM schedule")
def _(t):
    from chalkline.sources.tables import rewrite_codes

    old = lambda c: F.when(F.col(c) == "lvr", F.lit("oak")).when(F.col(c) == "lac", F.lit("sdg")).otherwise(F.col(c)).alias(c)
    return rewrite_codes(t.schedule.select("year", "week", old("team"), old("opponent")), ["team", "opponent"])


@query("fn7_coercion", """SELECT player_id, book, line AS as_float, CAST(trunc(line) AS BIGINT) AS as_int,
    CASE WHEN available IS NULL THEN NULL ELSE 'x' END AS not_blank FROM quotes""")
def _(t):
    text = F.concat(F.lit(" "), F.col("line").cast("string"), F.lit(" "))
    blank = F.when(F.col("available").isNull(), F.lit(" nan ")).otherwise(F.lit(" x "))
    return t.quotes.select("player_id", "book", V.to_float(text).alias("as_float"), V.to_int(text).alias("as_int"),
                           V.blank_to_null(blank).alias("not_blank"))


@query("fn8_money", "SELECT year, week, cid, CAST(salary AS BIGINT) AS salary FROM slate")
def _(t):
    text = F.concat(F.lit("$"), F.format_number("salary", 0), F.lit(" "))
    return t.slate.select("year", "week", "cid", V.money(text).alias("salary"))


@query("fn9_kickoff_utc", """SELECT o_orderkey, CAST((CAST(strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || ' 13:05:00' AS TIMESTAMP)
    AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS STRING) AS kickoff FROM orders""")
def _(t):
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-M-d"))
    return t.orders.select("o_orderkey", clock.kickoff_utc(day, F.lit("1:05PM")).cast("string").alias("kickoff"))


@query("fn10_week_rollover", """WITH e AS (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' - INTERVAL '4' HOUR AS s FROM events),
    d AS (SELECT event_id, CAST(s AS DATE) AS day FROM e)
    SELECT event_id, CAST(((CAST(day - CAST((isodow(day) + 5) % 7 AS INT) AS TIMESTAMP) + INTERVAL '4' HOUR) AT TIME ZONE 'America/New_York')
    AT TIME ZONE 'UTC' AS STRING) AS cutoff FROM d""")
def _(t):
    return t.events.select("event_id", clock.week_rollover(F.col("ts").cast("timestamp")).cast("string").alias("cutoff"))


@query("fn11_eastern_text", """WITH e AS (SELECT year, week, team, (kickoff AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS k FROM schedule)
    SELECT year, week, team, strftime(k, '%A') AS day, ltrim(strftime(k, '%I:%M %p'), '0') AS time FROM e""")
def _(t):
    return t.schedule.select("year", "week", "team", clock.eastern_day("kickoff").alias("day"), clock.eastern_time("kickoff").alias("time"))


@query("fn12_weather_text", r"""SELECT year, week, home_team, regexp_extract(weather_text, '(-?\d+\s*degrees)', 1) AS temp,
    regexp_extract(weather_text, '(relative humidity\s*\d+%)', 1) AS humidity, regexp_extract(weather_text, '(wind\s*\d+\s*mph)', 1) AS wind FROM game_info""")
def _(t):
    return t.game_info.select("year", "week", "home_team", C.parse_weather("weather_text").alias("w")).select("year", "week", "home_team", "w.*")


@query("fn13_matchup_text", "SELECT year, week, team AS who, team, opponent, home_away FROM schedule")
def _(t):
    text = F.concat("team", F.when(F.col("home_away") == "h", F.lit(" vs ")).otherwise(F.lit(" @ ")), "opponent")
    return t.schedule.select("year", "week", F.col("team").alias("who"), N.parse_matchup(text).alias("m")).select("year", "week", "who", "m.*")


@query("fn14_home_spread", """SELECT year, week, home_team, CASE WHEN (week + t) % 15 = 7 THEN 0.0E0 WHEN (week + t) % 15 < 7 THEN CAST((week + t) % 15 - 7 AS DOUBLE)
    ELSE CAST((week + t) % 15 - 7 AS DOUBLE) + 0.5E0 END AS spread FROM (SELECT g.*, s.t FROM game_info g JOIN schedule s
    ON s.year = g.year AND s.week = g.week AND s.team = g.home_team) x""")
def _(t):
    return t.game_info.select("year", "week", "home_team", C.home_spread("vegas_line", "home_team", "away_team").alias("spread"))


@query("fn15_total_text", "SELECT year, week, team, CAST(regexp_extract(over_under, '[0-9.]+') AS DOUBLE) AS total FROM game_odds")
def _(t):
    return t.game_odds.select("year", "week", "team", C.total_value("over_under").alias("total"))


@query("fn16_implied_team_total", f"""SELECT year, week, team, {hu("CAST(regexp_extract(over_under, '[0-9.]+') AS DOUBLE) / 2.0E0 - spread / 2.0E0", 1)} AS implied_total,
    CAST(regexp_extract(over_under, '[0-9.]+') AS DOUBLE) / 2.0E0 - spread / 2.0E0 AS unrounded FROM game_odds""")
def _(t):
    total = C.total_value("over_under")
    return t.game_odds.select("year", "week", "team", C.implied_team_total("spread", total).alias("implied_total"),
                              C.implied_team_total("spread", total, None).alias("unrounded"))


@query("fn17_implied_prob", f"SELECT player_id, book, {hu(ip('over_odds'), 6)} AS p_over, {hu(ip('under_odds'), 6)} AS p_under FROM quotes")
def _(t):
    return t.quotes.select("player_id", "book", V.half_up(O.implied_prob("over_odds"), 6).alias("p_over"),
                           V.half_up(O.implied_prob("under_odds"), 6).alias("p_under"))


@query("fn18_decimal_odds", f"SELECT player_id, book, {hu(dec('over_odds'), 6)} AS dec_over FROM quotes")
def _(t):
    return t.quotes.select("player_id", "book", V.half_up(O.decimal_odds("over_odds"), 6).alias("dec_over"))


@query("fn19_novig", f"SELECT player_id, book, {hu(f'{ip('over_odds')} / ({ip('over_odds')} + {ip('under_odds')})', 6)} AS novig FROM quotes")
def _(t):
    return t.quotes.select("player_id", "book", V.half_up(O.novig_over("over_odds", "under_odds"), 6).alias("novig"))


@query("fn20_fair_american", f"SELECT player_id, book, {fair('line / 128.0E0')} AS fair_odds FROM quotes")
def _(t):
    return t.quotes.select("player_id", "book", O.fair_american(F.col("line") / 128.0).alias("fair_odds"))


_B = f"({dec('over_odds')} - 1.0E0)"


@query("fn21_quarter_kelly", f"""SELECT player_id, book, {hu(f"greatest(0.0E0, (p * {_B} - (1.0E0 - p - 0.05E0)) / {_B}) * 0.25E0", 6)} AS stake
    FROM (SELECT *, line / 128.0E0 AS p FROM quotes) x""")
def _(t):
    return t.quotes.select("player_id", "book", V.half_up(
        O.quarter_kelly(F.col("line") / 128.0, 0.05, O.decimal_odds("over_odds")), 6).alias("stake"))


def _horner(coefficients, x):
    text = f"{coefficients[0]!r}"
    text = text if "e" in text or "E" in text else text + "E0"
    for c in coefficients[1:]:
        lit = repr(c) if "e" in repr(c) else repr(c) + "E0"
        text = f"({text} * {x} + {lit})"
    return text


def phi_sql(z: str) -> str:
    """Normal CDF as SQL arithmetic; callers keep |z| below seven."""
    a = f"abs({z})"
    up = f"(exp(-{a} * {a} / 2.0E0) * {_horner(O.CDF_NUM, a)} / {_horner(O.CDF_DEN, a)})"
    return f"(CASE WHEN ({z}) > 0 THEN 1.0E0 - {up} ELSE {up} END)"


def pois_cdf_sql(k: str, lam: str) -> str:
    return (f"coalesce(list_sum(list_transform(range(0, CAST(greatest({k} + 1, 0) AS BIGINT)), lambda i: "
            f"exp(-({lam}) + i * ln({lam}) - lgamma(i + 1)))), 0.0E0)")


def pois_pmf_sql(k: str, lam: str) -> str:
    return f"(CASE WHEN {k} < 0 THEN 0.0E0 ELSE exp(-({lam}) + ({k}) * ln({lam}) - lgamma(({k}) + 1)) END)"


@query("fn22_outcome_probs", f"""WITH p AS (SELECT player_id, book, line, line = floor(line) AS whole, 1.0E0 + (player_id % 9) AS mu, 2.0E0 + (player_id % 5) AS sd,
      CAST(floor(line) AS INT) AS k FROM quotes),
    n AS (SELECT *, CASE WHEN whole THEN 1.0E0 - {phi_sql("((line + 0.5E0 - mu) / sd)")} ELSE 1.0E0 - {phi_sql("((line - mu) / sd)")} END AS n_over,
      CASE WHEN whole THEN {phi_sql("((line - 0.5E0 - mu) / sd)")} ELSE {phi_sql("((line - mu) / sd)")} END AS n_under,
      CASE WHEN whole THEN {pois_cdf_sql("k - 1", "mu")} ELSE {pois_cdf_sql("k", "mu")} END AS p_under, CASE WHEN whole THEN {pois_pmf_sql("k", "mu")} ELSE 0.0E0 END AS p_push FROM p)
    SELECT player_id, book, {hu("n_over", 6)} AS normal_over, {hu("n_under", 6)} AS normal_under, {hu("1.0E0 - p_under - p_push", 6)} AS poisson_over,
      {hu("p_under", 6)} AS poisson_under, {hu("p_push", 6)} AS poisson_push FROM n""")
def _(t):
    q = t.unstaged("quotes").withColumns({"mu": 1.0 + F.col("player_id") % 9, "sd": 2.0 + F.col("player_id") % 5})
    q = q.withColumns({"n": O.outcome_probs(F.lit("normal"), F.col("mu"), F.col("sd"), F.col("line")),
                       "p": O.outcome_probs(F.lit("poisson"), F.col("mu"), F.col("sd"), F.col("line"))})
    r = lambda c, n: V.half_up(c, 6).alias(n)
    return q.select("player_id", "book", r("n.over", "normal_over"), r("n.under", "normal_under"), r("p.over", "poisson_over"),
                    r("p.under", "poisson_under"), r("p.push", "poisson_push"))


@query("fn23_fit_param", """SELECT player_id, book, true AS normal_ok, true AS poisson_ok FROM quotes WHERE under_odds IS NOT NULL""")
def _(t):
    """The fitted parameter must give the de-vigged probability back through the outcome model."""
    q = t.quotes.where(F.col("under_odds").isNotNull()).withColumns(
        {"p": O.novig_over("over_odds", "under_odds"), "sd": 2.0 + F.sqrt(F.col("line")), "small": F.col("line") % 9})
    q = q.withColumns({"mu": fit_param(F.lit("normal"), F.col("sd"), F.col("line"), F.col("p")), "lam": fit_param(F.lit("poisson"), F.col("sd"), F.col("small"), F.col("p"))})
    q = q.withColumns({"n": O.outcome_probs(F.lit("normal"), F.col("mu"), F.col("sd"), F.col("line")),
                       "o": O.outcome_probs(F.lit("poisson"), F.col("lam"), F.lit(1.0), F.col("small"))})
    gap = lambda s: F.abs(F.col(f"{s}.over") / (F.col(f"{s}.over") + F.col(f"{s}.under")) - F.col("p")) < 1e-9
    # A Poisson 'over' at line 0 has no push-free under side, so there is nothing to fit there.
    return q.select("player_id", "book", gap("n").alias("normal_ok"), (gap("o") | (F.col("small") == 0)).alias("poisson_ok"))


_SD = "CASE category " + " ".join(f"WHEN '{c}' THEN {a}E0 * pow(line, {b}E0)" for c, (a, b) in O.NORMAL_SPREAD.items()) + " END"


@query("fn24_stat_sd", f"""SELECT player_id, book, CASE WHEN category IN ('receptions', 'passing-tds', 'interceptions') THEN 'poisson'
      WHEN {_SD} IS NOT NULL THEN 'normal' ELSE 'same_line' END AS model,
    {hu(f"CASE WHEN category IN ('receptions', 'passing-tds', 'interceptions') THEN sqrt(greatest(line, 0.5E0)) WHEN line >= 5 THEN {_SD} END", 4)} AS sd FROM quotes""")
def _(t):
    return t.quotes.select("player_id", "book", O.category_model("category").alias("model"), V.half_up(O.stat_sd("category", F.col("line")), 4).alias("sd"))


@query("fn25_offense_points", f"SELECT player_id, year, week, {hu(offense_sql(), 2)} AS points FROM player_stats")
def _(t):
    return t.player_stats.select("player_id", "year", "week", S.offense_points().alias("points"))


_TIER = ("CASE WHEN points_allowed <= 0 THEN 10.0E0 WHEN points_allowed <= 6 THEN 7.0E0 WHEN points_allowed <= 13 THEN 4.0E0 WHEN points_allowed <= 20 THEN 1.0E0 "
         "WHEN points_allowed <= 27 THEN 0.0E0 WHEN points_allowed <= 34 THEN -1.0E0 ELSE -4.0E0 END")
DEFENSE_SQL = f"(sack + 2 * interception + 2 * fumble_rec + 6 * (def_td + special_teams_td) + 2 * safety + {_TIER})"


@query("fn26_points_allowed", f"SELECT year, week, team, {_TIER} AS bonus FROM defense")
def _(t):
    return t.defense.select("year", "week", "team", S.points_allowed_bonus("points_allowed").alias("bonus"))


@query("fn27_defense_points", f"SELECT year, week, team, {hu(DEFENSE_SQL, 2)} AS points FROM defense")
def _(t):
    return t.defense.select("year", "week", "team", S.defense_points().alias("points"))


@query("fn28_composites", """SELECT player_id, year, week, CAST(pass_yds + rush_yds AS BIGINT) AS pass_rush_yds, CAST(rush_yds + rec_yds AS BIGINT) AS rush_rec_yds,
    CAST(pass_td + rush_td + rec_td AS BIGINT) AS any_td FROM player_stats""")
def _(t):
    s = lambda f: S.null_safe_sum(FIELD_PARTS[f]).cast("bigint").alias(f)
    return t.player_stats.select("player_id", "year", "week", s("pass_rush_yds"), s("rush_rec_yds"), s("any_td"))


def stacked_sql(parts: dict[str, list[str]], keys: str, name: str = "category", where: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{c}' AS {name}, CAST({' + '.join(f'coalesce({x}, 0)' for x in cols)} AS DOUBLE) AS value FROM player_stats {where}" for c, cols in parts.items())


@query("fn29_grading_stats", stacked_sql(GRADING_PARTS, "player_id, year, week"))
def _(t):
    return S.unpivot_stats(t.player_stats, GRADING_PARTS, ["player_id", "year", "week"])


@query("fn29_low_line_stats", stacked_sql(LOW_LINE_PARTS, "player_id, year, week"))
def _(t):
    return S.unpivot_stats(t.player_stats, LOW_LINE_PARTS, ["player_id", "year", "week"])


IMPLIED_CASE = ("CASE category WHEN 'passing-yards' THEN 0.04E0 WHEN 'passing-tds' THEN 4.0E0 WHEN 'interceptions' THEN -1.0E0 WHEN 'rushing-yards' THEN 0.1E0 "
                "WHEN 'receiving-yards' THEN 0.1E0 WHEN 'receptions' THEN 1.0E0 WHEN 'rushing-and-receiving-yards' THEN 0.1E0 END")
IMPLIED_SQL = f"""ip_used AS (SELECT p.year, p.week, p.name_key, p.category, p.line * {IMPLIED_CASE} AS pts FROM prop_lines p WHERE {IMPLIED_CASE} IS NOT NULL
      AND NOT (p.category = 'rushing-and-receiving-yards' AND EXISTS (SELECT 1 FROM prop_lines s WHERE s.year = p.year AND s.week = p.week
        AND s.name_key = p.name_key AND s.category IN ('rushing-yards', 'receiving-yards')))),
    ip_table AS (SELECT year, week, name_key, {hu("sum(pts)", 2)} AS implied_points,
      string_agg(category, ',' ORDER BY list_position(['passing-yards', 'passing-tds', 'interceptions', 'rushing-yards', 'receiving-yards', 'receptions', 'rushing-and-receiving-yards'], category)) AS categories_used
      FROM ip_used GROUP BY year, week, name_key)"""


@query("fn30_implied_points", f"WITH {IMPLIED_SQL} SELECT * FROM ip_table")
def _(t):
    return implied_points(t.prop_lines.select("year", "week", "name_key", "category", "line"))


@query("fn31_value", f"SELECT year, week, cid, {hu('(cid % 30) * 0.5E0 / (salary / 1000.0E0)', 2)} AS value FROM slate")
def _(t):
    return t.slate.select("year", "week", "cid", S.value_per_thousand((F.col("cid") % 30) * 0.5, "salary").alias("value"))


@query("fn34_roof", """SELECT year, week, team, CASE WHEN team IN ('ari','atl','dal','det','hou','ind','lac','lar','lvr','min','nor') THEN 'dome' ELSE 'outdoor' END AS roof FROM schedule""")
def _(t):
    return t.schedule.select("year", "week", "team", T.roof_type("team").alias("roof"))


WEATHER_SQL = """w0 AS (SELECT *, CASE WHEN home_team IN ('ari','atl','dal','det','hou','ind','lac','lar','lvr','min','nor') THEN 'dome' ELSE 'outdoor' END AS roof FROM weather),
    w1 AS (SELECT *, CASE WHEN roof = 'dome' THEN NULL ELSE CAST(wind_mph AS DOUBLE) END AS wind, CASE WHEN roof = 'dome' THEN NULL ELSE CAST(temp_f AS DOUBLE) END AS temp FROM w0),
    w2 AS (SELECT *, CASE WHEN roof = 'dome' THEN 'dome: pass yds +7' WHEN wind >= 20 THEN concat(wind_mph, ' mph wind: pass yds -22, rush yds +15')
      WHEN wind >= 15 THEN concat(wind_mph, ' mph wind: pass yds -21, rush yds +4') WHEN temp <= 32 THEN concat(temp_f, 'F: pass yds -18')
      WHEN wind >= 10 THEN concat(wind_mph, ' mph wind: pass yds -6 (minor)') ELSE '' END AS note,
      CASE WHEN roof = 'dome' THEN false ELSE coalesce(wind >= 15, false) OR coalesce(temp <= 32, false) END AS bad FROM w1)"""


@query("fn35_weather_effect", f"WITH {WEATHER_SQL} SELECT year, week, home_team, note, bad FROM w2")
def _(t):
    from chalkline.functions.conditions import weather_effect

    w = t.weather.withColumn("roof", F.coalesce(T.roof_type("home_team"), F.lit("outdoor")))
    e = weather_effect(F.col("roof"), F.col("wind_mph").cast("double"), F.col("temp_f").cast("double"))
    return w.withColumn("e", e).select("year", "week", "home_team", F.col("e.weather_note").alias("note"), F.col("e.bad_passing_weather").alias("bad"))


@query("fn36_labels", """SELECT name_key, CASE string_rank WHEN 1 THEN '1st' WHEN 2 THEN '2nd' WHEN 3 THEN '3rd' ELSE CAST(string_rank AS STRING) END AS depth_label,
    CASE pos WHEN 'K' THEN 'k' ELSE lower(pos) END AS status, CASE pos WHEN 'QB' THEN 'RB' ELSE pos END AS position FROM depth""")
def _(t):
    return t.depth.select("name_key", C.depth_label("string_rank").alias("depth_label"), C.status_text("pos").alias("status"),
                          C.usage_position(F.when(F.col("pos") == "QB", F.lit("HB")).otherwise(F.col("pos"))).alias("position"))


@query("fn37_counting_weeks", "SELECT DISTINCT year, week, NOT (year = 1999 AND week IN (1, 2)) AS counts FROM player_weeks")
def _(t):
    return t.player_weeks.select("year", "week").distinct().withColumn("counts", C.counts_toward_season("year", "week", {1999: [1, 2]}))


@query("fn38_text_notes", """SELECT player_id, book, CASE WHEN over_odds >= 0 THEN concat('+', CAST(CAST(over_odds AS BIGINT) AS STRING)) ELSE CAST(CAST(over_odds AS BIGINT) AS STRING) END AS signed,
    CASE WHEN player_id % 3 = 1 AND player_id % 2 = 0 THEN NULL WHEN player_id % 2 = 1 THEN concat('These are Week ', CAST(player_id % 3 AS STRING), ', 1998 lines. Week 1, 1999 lines aren''t loaded yet.')
      WHEN player_id % 3 = 0 THEN 'These are Week 0 lines. Week 1 lines aren''t loaded yet.' ELSE 'These are Week 2 lines. The current week is Week 1.' END AS note FROM quotes""")
def _(t):
    i = lambda c: c.cast("int")
    note = N.odds_week_note(i(1999 - F.col("player_id") % 2), i(F.col("player_id") % 3), F.lit(1999), F.lit(1))
    return t.quotes.select("player_id", "book", N.signed_odds("over_odds").alias("signed"), note.alias("note"))
