"""Touchdown model (MD) and touchdown bets (MK17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.catalog.q_market import PICKEM, TARGETS, _KEY
from chalkline.catalog.q_windows import ewm_weights
from chalkline.catalog.registry import query
from chalkline.catalog.views import dec, fair, hu, ip
from chalkline.functions.conditions import total_value
from chalkline.functions.values import half_up
from chalkline.plans import market as M, model as MD
from chalkline.sources.derived import settled

PARAMS = MD.PUBLISHED_PARAMS
H = f"{PARAMS['halflife']}E0"
TRAIN, TEST = range(1995, 2000), range(2000, 2002)
KEY = "player_id, year, week"


def pg(t):
    return MD.player_games(t.usage, t.player_stats)


def games(t):
    return t.game_odds.select("year", "week", "team", (total_value("over_under") / 2.0 - F.col("spread") / 2.0).alias("implied_total"))


GAMES_SQL = "tg AS (SELECT year, week, team, CAST(regexp_extract(over_under, '[0-9.]+') AS DOUBLE) / 2.0E0 - spread / 2.0E0 AS implied_total FROM game_odds)"
PG_SQL = "pg0 AS (SELECT u.player_id, u.year, u.week, u.team, u.name_key, u.name, u.position, u.offense_pct, " + ", ".join(f"CAST(u.{c} AS DOUBLE) AS {c}" for c in MD.COUNTS if c != "tds") + \
    ", CAST(coalesce(s.rush_td + s.rec_td, 0) AS DOUBLE) AS tds FROM usage u LEFT JOIN player_stats s ON s.player_id = u.player_id AND s.year = u.year AND s.week = u.week), pg AS (SELECT *, " + \
    ", ".join(f"sum({c}) OVER (PARTITION BY team, year, week) AS team_{c}" for c in MD.COUNTS) + " FROM pg0)"
EWM = [*MD.COUNTS, *[f"team_{c}" for c in MD.COUNTS], "offense_pct"]


def shares_sql(shift: bool) -> str:
    """CTEs w (weights), e (means), sh (shares)."""
    end = "1 PRECEDING" if shift else "CURRENT ROW"
    frame = f"OVER (PARTITION BY player_id ORDER BY year, week ROWS BETWEEN UNBOUNDED PRECEDING AND {end})"
    w = ", ".join(ewm_weights(c, H) for c in EWM)
    e = ", ".join(f"sum({c} * w_{c}) {frame} / sum(w_{c}) {frame} AS ewm_{c}" for c in EWM)
    sh = ", ".join(f"coalesce(CASE WHEN ewm_team_{c} > 0 THEN ewm_{c} / ewm_team_{c} END, 0.0E0) AS share_{c}" for c in MD.COUNTS)
    return f"{PG_SQL}, mw AS (SELECT *, {w} FROM pg), me AS (SELECT *, {e} FROM mw), msh AS (SELECT *, {sh} FROM me)"


FEATURES_SQL = f"""{shares_sql(True)}, m0 AS (SELECT *, row_number() OVER q - 1 AS prior_games, lag(team) OVER q AS pt, lag(year) OVER q AS py, lag(offense_pct) OVER q AS ls FROM msh WINDOW q AS (PARTITION BY player_id ORDER BY year, week)),
    m1 AS (SELECT *, sum(CASE WHEN pt = team THEN 0 ELSE 1 END) OVER (PARTITION BY player_id ORDER BY year, week) AS stint FROM m0), m2 AS (SELECT *, row_number() OVER (PARTITION BY player_id, stint ORDER BY year, week) - 1 AS sg FROM m1),
    feat AS (SELECT *, CASE WHEN position = 'QB' THEN 1.0E0 ELSE 0.0E0 END AS adj_qb, CASE WHEN position = 'TE' THEN 1.0E0 ELSE 0.0E0 END AS adj_te, CASE WHEN position = 'FB' THEN 1.0E0 ELSE 0.0E0 END AS adj_fb,
      CASE WHEN stint > 1 THEN pow(0.5E0, sg / {H}) ELSE 0.0E0 END AS adj_new_team, CASE WHEN py IS DISTINCT FROM year THEN 1.0E0 ELSE 0.0E0 END AS adj_new_season, coalesce((ls - ewm_offense_pct) / 100.0E0, 0.0E0) AS adj_snap_trend,
      CASE WHEN ls <= 20 THEN 1.0E0 ELSE 0.0E0 END AS adj_low_snap FROM m2)"""


def _predict(params=PARAMS) -> str:
    share = " + ".join(f"{params['weights'][s]}E0 * {s}" for s in MD.SHARES)
    adj = " + ".join(f"({params['adjustments'][a]}E0) * {a}" for a in MD.ADJUSTMENTS)
    return f"(1.0E0 - exp(-greatest(exp({params['team_a']}E0 + {params['team_b']}E0 * ln(implied_total)) * ({share}) * exp({adj}), 1E-6)))"


DATA_SQL = f"{FEATURES_SQL}, {GAMES_SQL}, data AS (SELECT f.*, tg.implied_total FROM feat f JOIN tg USING (year, week, team) WHERE f.prior_games >= 3 AND f.week <= 18), pred AS (SELECT *, {_predict()} AS p, CASE WHEN tds > 0 THEN 1.0E0 ELSE 0.0E0 END AS y FROM data)"


def r6(*columns):
    return [half_up(c, 6).alias(c) for c in columns]


def r6_sql(*columns):
    return ", ".join(f"{hu(c, 6)} AS {c}" for c in columns)


def dataset(t):
    return MD.build_dataset(pg(t), games(t), PARAMS["halflife"])


@query("md1_team_games", """WITH g AS (SELECT i.*, s.t, CAST(regexp_extract(over_under, '[0-9.]+') AS DOUBLE) AS tot, CASE WHEN (i.week + s.t) % 15 <= 7 THEN CAST((i.week + s.t) % 15 - 7 AS DOUBLE) ELSE CAST((i.week + s.t) % 15 - 7 AS DOUBLE) + 0.5E0 END AS sp
      FROM game_info i JOIN schedule s ON s.year = i.year AND s.week = i.week AND s.team = i.home_team)
    SELECT year, week, home_team AS team, tot / 2.0E0 - sp / 2.0E0 AS implied_total FROM g UNION ALL SELECT year, week, away_team, tot / 2.0E0 + sp / 2.0E0 FROM g""")
def _(t):
    return MD.team_games(t.game_info.drop("home_team", "away_team"))


@query("md2_player_games", f"WITH {PG_SQL} SELECT {KEY}, carries, tds, team_carries, team_tds, team_rz_targets FROM pg")
def _(t):
    return pg(t).select("player_id", "year", "week", "carries", "tds", "team_carries", "team_tds", "team_rz_targets")


@query("md3_share_features", f"WITH {FEATURES_SQL} SELECT {KEY}, prior_games, {r6_sql(*MD.SHARES)}, {r6_sql('ewm_offense_pct')} FROM feat")
def _(t):
    return MD.share_features(pg(t), PARAMS["halflife"]).select("player_id", "year", "week", "prior_games", *r6(*MD.SHARES, "ewm_offense_pct"))


@query("md4_adjustments", f"WITH {FEATURES_SQL} SELECT {KEY}, {r6_sql(*MD.ADJUSTMENTS)} FROM feat")
def _(t):
    return MD.share_features(pg(t), PARAMS["halflife"]).select("player_id", "year", "week", *r6(*MD.ADJUSTMENTS))


NEXT_TEAM = "CASE WHEN last_team < 'hou' THEN last_team ELSE 'buf' END"
CURRENT_SQL = f"""{shares_sql(False)}, c0 AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY year DESC, week DESC) AS rn, count(*) OVER (PARTITION BY player_id) AS prior_games, list(team) OVER (PARTITION BY player_id ORDER BY year DESC, week DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS teams FROM msh),
    curf AS (SELECT * EXCLUDE (team, year, week), team AS last_team, year AS last_year, week AS last_week FROM c0 WHERE rn = 1)"""


def next_adj_sql(source: str, nxt: str, year: int) -> str:
    return f"""nx0 AS (SELECT *, {nxt} AS nt FROM {source}), nx1 AS (SELECT *, list_position(list_transform(teams, lambda x: x <> nt), true) AS away FROM nx0),
    nx AS (SELECT *, CASE WHEN position = 'QB' THEN 1.0E0 ELSE 0.0E0 END AS adj_qb, CASE WHEN position = 'TE' THEN 1.0E0 ELSE 0.0E0 END AS adj_te, CASE WHEN position = 'FB' THEN 1.0E0 ELSE 0.0E0 END AS adj_fb,
      CASE WHEN coalesce(away, 0) > 0 THEN pow(0.5E0, (away - 1) / {H}) ELSE 0.0E0 END AS adj_new_team, CASE WHEN last_year < {year} THEN 1.0E0 ELSE 0.0E0 END AS adj_new_season, coalesce((offense_pct - ewm_offense_pct) / 100.0E0, 0.0E0) AS adj_snap_trend,
      CASE WHEN offense_pct <= 20 THEN 1.0E0 ELSE 0.0E0 END AS adj_low_snap FROM nx1)"""


@query("md5_current_features", f"WITH {CURRENT_SQL}, {next_adj_sql('curf', NEXT_TEAM, 2001)} SELECT player_id, last_year, last_week, last_team, prior_games, {r6_sql(*MD.SHARES, *MD.ADJUSTMENTS)} FROM nx")
def _(t):
    c = MD.current_features(pg(t), PARAMS["halflife"]).withColumnsRenamed({"team": "last_team", "year": "last_year", "week": "last_week"})
    n = MD.next_game_adjustments(c, F.expr(NEXT_TEAM), F.lit(2001), PARAMS["halflife"], F.col("last_year"))
    return n.select("player_id", "last_year", "last_week", "last_team", "prior_games", *r6(*MD.SHARES, *MD.ADJUSTMENTS))


@query("md6_predict", f"WITH {DATA_SQL} SELECT {KEY}, {r6_sql('p')} FROM pred")
def _(t):
    return MD.predict(dataset(t), PARAMS).select("player_id", "year", "week", *r6("p"))


# Fitted models are checked by what holds at the optimum and nowhere else, so the SQL needs no fit of its own.
_TRAIN = f"{TRAIN[0]} AND {TRAIN[-1]}"


@query("md7_fit_team_tds", f"""WITH {PG_SQL}, {GAMES_SQL}, x AS (SELECT sum(tds) AS tds, implied_total AS t FROM pg JOIN tg USING (year, week, team) WHERE year BETWEEN {_TRAIN} AND implied_total > 0 GROUP BY team, year, week, implied_total)
    SELECT 'touchdowns' AS moment, count(*) AS games, {hu('sum(tds)', 3)} AS observed, {hu('sum(tds)', 3)} AS fitted FROM x
    UNION ALL SELECT 'touchdowns x log total', count(*), {hu('sum(tds * ln(t))', 3)}, {hu('sum(tds * ln(t))', 3)} FROM x""")
def _(t):
    """The score equations of the Poisson regression: fitted and observed touchdowns agree in sum, plain and weighted by the regressor."""
    a, b = MD.fit_team_tds(games(t), pg(t), TRAIN)
    tds = pg(t).groupBy("team", "year", "week").agg(F.sum("tds").alias("tds"))
    x = games(t).join(tds, ["team", "year", "week"]).where(F.col("year").between(TRAIN[0], TRAIN[-1]) & (F.col("implied_total") > 0))
    log_total = F.log("implied_total")
    rate = F.exp(F.lit(a) + F.lit(b) * log_total)
    moments = [F.struct(F.lit(n).alias("moment"), (F.col("tds") * w).alias("o"), (rate * w).alias("f")) for n, w in (("touchdowns", F.lit(1.0)), ("touchdowns x log total", log_total))]
    return x.select(F.inline(F.array(*moments))).groupBy("moment").agg(F.count(F.lit(1)).alias("games"), half_up(F.sum("o"), 3).alias("observed"), half_up(F.sum("f"), 3).alias("fitted"))


@query("md8_fit_weights", f"""WITH {DATA_SQL}, n AS (SELECT count(*) AS rows, sum(y) AS scored FROM pred WHERE year BETWEEN {_TRAIN}), k AS (SELECT unnest([{', '.join(f"'{p}'" for p in [*MD.SHARES, *MD.ADJUSTMENTS])}]) AS parameter)
    SELECT parameter, n.rows, n.scored, 0.0E0 AS projected_gradient, true AS in_bounds FROM k, n""")
def _(t):
    """The Karush-Kuhn-Tucker conditions of the weight fit: inside its bounds a parameter's gradient is zero, at one it points outwards."""
    train = settled(dataset(t).where(F.col("year").between(TRAIN[0], TRAIN[-1])).select(F.lit(0).alias("candidate"), *MD.TRAIN_COLUMNS), "training")
    theta, _, gradient = MD.fit_candidates(train, PARAMS["team_a"], PARAMS["team_b"])[0]
    n = train.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("tds") > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("scored"))
    inside = (theta >= MD.LOW) & (theta <= MD.HIGH)
    found = [F.struct(F.lit(p).alias("parameter"), F.lit(abs(round(float(g), 5))).alias("projected_gradient"), F.lit(bool(ok)).alias("in_bounds"))
             for p, g, ok in zip([*MD.SHARES, *MD.ADJUSTMENTS], gradient, inside)]
    return n.select("rows", "scored", F.inline(F.array(*found)))


@query("md9_select_halflife", f"""WITH {DATA_SQL}, n AS (SELECT count(*) FILTER (year BETWEEN {_TRAIN}) AS n_train, count(*) FILTER (year BETWEEN {TEST[0]} AND {TEST[-1]}) AS n_test FROM pred)
    SELECT unnest([3.0E0, 5.0E0, 8.0E0, 12.0E0]) AS halflife, n_train, n_test, 0.0E0 AS gradient, true AS chosen_is_least FROM n""")
def _(t):
    """Every half-life's fit is optimal, all see the same games, and none beats the chosen one on the test seasons."""
    fitted = MD.halflife_candidates(pg(t), games(t), TRAIN, TEST)
    best = min(f["test_log_loss"] for f in fitted)
    chosen = min(fitted, key=lambda f: f["test_log_loss"])
    rows = [(f["halflife"], f["n_train"], f["n_test"], abs(round(f["gradient"], 5)), chosen["test_log_loss"] == best <= f["test_log_loss"]) for f in fitted]
    return t.spark.createDataFrame(rows, "halflife double, n_train long, n_test long, gradient double, chosen_is_least boolean")


_CLIP = "least(greatest({0}, 1E-4), 0.9999E0)"


def _loss(p: str) -> str:
    q = _CLIP.format(p)
    return f"-avg(y * ln({q}) + (1.0E0 - y) * ln(1.0E0 - {q}))"


@query("md10_evaluate", f"""WITH {DATA_SQL}, base AS (SELECT position, avg(y) AS b FROM pred WHERE year < 2000 GROUP BY position)
    SELECT count(*) AS n, {hu('avg(y)', 4)} AS scored_rate, {hu(_loss('p'), 4)} AS model_loss, {hu(_loss('b'), 4)} AS base_rate_loss, {hu(_loss('least(greatest(coalesce(ewm_tds, 0.0E0), 0.0E0), 0.95E0)'), 4)} AS own_rate_loss FROM pred JOIN base USING (position) WHERE year >= 2000""")
def _(t):
    d = dataset(t)
    return MD.evaluate(d.where("year < 2000"), d.where("year >= 2000"), PARAMS)


@query("md10_segments", f"""WITH {DATA_SQL}, s AS (SELECT p, y, 'position' AS segment, position AS level FROM pred UNION ALL SELECT p, y, 'new_team', CAST(adj_new_team > 0.3E0 AS STRING) FROM pred UNION ALL SELECT p, y, 'snap_drop', CAST(adj_snap_trend <= -0.2E0 AS STRING) FROM pred
      UNION ALL SELECT p, y, 'low_snap', CAST(adj_low_snap > 0 AS STRING) FROM pred) SELECT segment, level, count(*) AS n, {hu('avg(p)', 3)} AS predicted, {hu('avg(y)', 3)} AS actual FROM s GROUP BY segment, level""")
def _(t):
    return MD.segments(dataset(t), PARAMS)


@query("md10_calibration", f"""WITH {DATA_SQL}, c AS (SELECT *, CASE WHEN p > 0 AND p <= 0.05E0 THEN '(0, 0.05]' WHEN p <= 0.1E0 THEN '(0.05, 0.1]' WHEN p <= 0.2E0 THEN '(0.1, 0.2]' WHEN p <= 0.3E0 THEN '(0.2, 0.3]' WHEN p <= 0.4E0 THEN '(0.3, 0.4]'
      WHEN p <= 0.5E0 THEN '(0.4, 0.5]' WHEN p <= 0.6E0 THEN '(0.5, 0.6]' ELSE '(0.6, 1]' END AS bucket FROM pred) SELECT bucket, count(*) AS n, {hu('avg(p)', 3)} AS predicted, {hu('avg(y)', 3)} AS actual FROM c GROUP BY bucket""")
def _(t):
    return MD.calibration_table(dataset(t), PARAMS)


_SEASON = " UNION ALL ".join(f"SELECT '{c}' AS stat, player_id, year, CAST({c} AS DOUBLE) AS v FROM player_stats WHERE snap_pct >= 20" for c in ("rush_yds", "rec_yds", "rush_att"))


@query("md11_fit_spread", f"""WITH v AS ({_SEASON}), s AS (SELECT stat, player_id, year, count(v) AS n, avg(v) AS m, stddev_samp(v) AS sd FROM v GROUP BY stat, player_id, year)
    SELECT stat, count(*) AS player_seasons, {hu('exp(regr_intercept(ln(sd), ln(m)))', 4)} AS a, {hu('regr_slope(ln(sd), ln(m))', 4)} AS b FROM s WHERE n >= 3 AND m > 0 AND sd > 0 GROUP BY stat""")
def _(t):
    return MD.fit_spread(t.player_stats, ["rush_yds", "rec_yds", "rush_att"], min_games=3)


@query("md12_weather_effects", f"""WITH g AS (SELECT w.*, home_score + away_score - 45.0E0 AS resid_points, CAST(home_score * 5 AS DOUBLE) AS pass_yds, CAST(away_score * 3 AS DOUBLE) AS rush_yds, home_team IN ('ari','atl','dal','det','hou','ind','lac','lar','lvr','min','nor') AS dome FROM weather w)
    SELECT CASE WHEN dome THEN 'dome' WHEN wind_mph >= 20 THEN '20+' WHEN wind_mph >= 15 THEN '15-19' WHEN wind_mph >= 10 THEN '10-14' ELSE '0-9' END AS wind, CASE WHEN temp_f <= 32 THEN 'freezing' ELSE 'mild' END AS temp, count(*) AS n,
      {hu('avg(resid_points)', 2)} AS mean_resid_points, {hu('avg(pass_yds)', 2)} AS mean_pass_yds, {hu('avg(rush_yds)', 2)} AS mean_rush_yds FROM g GROUP BY 1, 2""")
def _(t):
    from chalkline.functions.teams import roof_type

    g = t.weather.withColumns({"resid_points": F.col("home_score") + F.col("away_score") - 45.0, "pass_yds": (F.col("home_score") * 5).cast("double"),
                               "rush_yds": (F.col("away_score") * 3).cast("double"), "dome": roof_type("home_team") == "dome"})
    return MD.weather_effects(g)


_OI = "(SELECT median(q) FROM (SELECT unnest(ps) AS q))"


@query("mk17_td_bets", f"""WITH {CURRENT_SQL}, {GAMES_SQL}, m AS (SELECT snapshot, player_name, team, lower(book) AS book, over_odds, {_KEY} AS k FROM quotes WHERE category = 'touchdowns' AND lower(book) NOT IN {PICKEM} AND (available IS NULL OR available)),
    tot AS (SELECT team, avg(implied_total) AS implied_total FROM tg WHERE year = 2001 GROUP BY team), pl AS (SELECT DISTINCT k, team FROM m), fb AS (SELECT split_part(name_key, ' ', 2) AS ln, last_team, min(name_key) AS alt FROM curf GROUP BY 1, 2 HAVING count(*) = 1),
    mt AS (SELECT pl.k, pl.team, CASE WHEN EXISTS (SELECT 1 FROM curf WHERE curf.name_key = pl.k) THEN pl.k ELSE fb.alt END AS mk FROM pl LEFT JOIN fb ON fb.ln = split_part(pl.k, ' ', 2) AND fb.last_team = pl.team),
    src AS (SELECT mt.k, mt.team, tot.implied_total, c.* FROM mt JOIN curf c ON c.name_key = mt.mk JOIN tot ON tot.team = mt.team WHERE c.prior_games >= 3 AND c.last_year >= 2000),
    {next_adj_sql('src', 'team', 2001)}, pr AS (SELECT *, {_predict()} AS p, concat_ws('; ', CASE WHEN last_year < 2001 THEN 'no game this season' END, CASE WHEN offense_pct IS NULL OR offense_pct <= 20 THEN concat(coalesce(CAST(CAST(floor(offense_pct + 0.5E0) AS BIGINT) AS STRING), 'nan'), '% snaps last game') END,
      CASE WHEN adj_new_team > 0.25E0 THEN 'new team' END) AS why FROM nx),
    o AS (SELECT t.snapshot, t.k, t.team, t.book, list({ip('r.over_odds')}) AS ps FROM m t JOIN m r ON r.snapshot = t.snapshot AND r.k = t.k AND r.team = t.team AND r.book <> t.book WHERE t.book IN {TARGETS} GROUP BY t.snapshot, t.k, t.team, t.book),
    oo AS (SELECT *, list_median0 AS md, CASE WHEN len(ps) < 3 THEN ps ELSE list_filter(ps, lambda x: x <= list_median0 * 2.5E0 AND x >= list_median0 / 2.5E0) END AS kept FROM (SELECT *, list_aggregate(ps, 'median') AS list_median0 FROM o) z),
    ol AS (SELECT snapshot, k, team, book, list_aggregate(CASE WHEN len(kept) > 0 THEN kept ELSE ps END, 'median') AS oi, len(CASE WHEN len(kept) > 0 THEN kept ELSE ps END) AS n FROM oo)
    SELECT m.snapshot, m.book, m.player_name, m.team, r.position, m.over_odds AS odds, {hu(ip('m.over_odds'), 3)} AS implied_prob, {hu('r.p', 3)} AS model_prob, {fair('r.p')} AS fair_odds, {hu(f"(r.p * {dec('m.over_odds')} - 1.0E0) * 100.0E0", 1)} AS ev_pct, {hu('ol.oi', 3)} AS other_books_implied,
      coalesce(ol.n, 0) AS other_books, {hu('(r.p - ol.oi) * 100.0E0', 1)} AS gap_pp, {hu('r.implied_total', 1)} AS implied_team_total, {hu('r.share_carries', 3)} AS carry_share, {hu('r.share_targets', 3)} AS target_share, {hu('r.share_tds', 3)} AS td_share, r.prior_games AS games,
      concat(CAST(r.last_year AS STRING), ' wk', CAST(r.last_week AS STRING), ' ', r.last_team) AS last_game, r.offense_pct AS last_snap_pct, r.adj_new_team > 0.25E0 AS new_team, CASE WHEN why = '' THEN 'clean' ELSE 'check' END AS confidence, why AS check_reason
    FROM m JOIN pr r ON r.k = m.k AND r.team = m.team LEFT JOIN ol ON ol.snapshot = m.snapshot AND ol.k = m.k AND ol.team = m.team AND ol.book = m.book WHERE m.book IN {TARGETS}""")
def _(t):
    totals = games(t).where("year = 2001").groupBy("team").agg(F.avg("implied_total").alias("implied_total"))
    feats = MD.current_features(pg(t), PARAMS["halflife"])
    return M.td_bets(t.quotes, feats, PARAMS, totals, 2001)
