"""Ordered-group operators (WN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.catalog.registry import query
from chalkline.catalog.views import hu, ip
from chalkline.functions import odds as O, scoring as S
from chalkline.functions.values import half_up
from chalkline.operators import ordered as W

PTS = "coalesce(dk_pts_reported, dk_pts)"


def scored(t):
    return t.player_stats.withColumn("points", S.counted_points())


@query("wn1_trailing_mean", f"""SELECT name_key, {hu('avg(p)', 2)} AS avg_value, count(*) AS games FROM (SELECT name_key, {PTS} AS p,
    row_number() OVER (PARTITION BY name_key ORDER BY year DESC, week DESC) AS rn FROM player_stats) x WHERE rn <= 10 GROUP BY name_key""")
def _(t):
    return W.trailing_mean(scored(t), ["name_key"], ["year", "week"], "points")


@query("wn2_rank_in_group", f"""WITH a AS (SELECT position, name_key, {hu(f'avg({PTS})', 2)} AS v FROM player_stats GROUP BY position, name_key)
    SELECT position, name_key, v, row_number() OVER (PARTITION BY position ORDER BY v DESC, name_key) AS rank, count(*) OVER (PARTITION BY position) AS rank_total FROM a""")
def _(t):
    a = scored(t).groupBy("position", "name_key").agg(half_up(F.avg("points"), 2).alias("v"))
    return W.rank_in_group(a, ["position"], "v", "name_key")


def ewm_sql(column: str, shift: bool) -> str:
    end = "1 PRECEDING" if shift else "CURRENT ROW"
    frame = f"OVER (PARTITION BY player_id ORDER BY year, week ROWS BETWEEN UNBOUNDED PRECEDING AND {end})"
    return f"sum({column} * w_{column}) {frame} / sum(w_{column}) {frame}"


def ewm_weights(column: str, halflife: str) -> str:
    return (f"CASE WHEN {column} IS NOT NULL THEN pow(2.0E0, count({column}) OVER (PARTITION BY player_id ORDER BY year, week ROWS UNBOUNDED PRECEDING) / {halflife}) END AS w_{column}")


@query("wn3_ewm_mean", f"""WITH w AS (SELECT player_id, year, week, snap_pct, CAST(rush_yds AS DOUBLE) AS rush_yds, {ewm_weights('snap_pct', '4.0E0')}, {ewm_weights('rush_yds', '4.0E0')} FROM player_stats)
    SELECT player_id, year, week, {hu(ewm_sql('snap_pct', True), 6)} AS ewm_snap_pct, {hu(ewm_sql('rush_yds', True), 6)} AS ewm_rush_yds FROM w""")
def _(t):
    df = t.player_stats.select("player_id", "year", "week", "snap_pct", F.col("rush_yds").cast("double").alias("rush_yds"))
    e = W.ewm_mean(df, ["player_id"], ["year", "week"], ["snap_pct", "rush_yds"], 4.0)
    return e.select("player_id", "year", "week", half_up("ewm_snap_pct", 6).alias("ewm_snap_pct"), half_up("ewm_rush_yds", 6).alias("ewm_rush_yds"))


# One value in 61 events, so histories run over many segments; the oracle weighs the last 300 values of each event directly.
@query("wn3_sparse_history", f"""WITH e AS (SELECT event_id, event_type, CAST(ts AS TIMESTAMP) AS seen_at, CASE WHEN event_id % 61 = 0 THEN value END AS v FROM events),
    k AS (SELECT *, count(v) OVER (PARTITION BY event_type ORDER BY seen_at, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e),
    held AS (SELECT event_type, k, v FROM k WHERE v IS NOT NULL)
    SELECT k.event_id, {hu('sum(h.v * pow(0.5E0, (k.k - h.k) / 3.0E0)) / sum(pow(0.5E0, (k.k - h.k) / 3.0E0))', 6)} AS mean
    FROM k LEFT JOIN held h ON h.event_type = k.event_type AND h.k <= k.k AND h.k > k.k - 300 GROUP BY k.event_id""")
def _(t):
    e = t.events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("seen_at"), F.when(F.col("event_id") % 61 == 0, F.col("value")).alias("v"))
    means = W.ewm_mean(e, ["event_type"], ["seen_at", "event_id"], ["v"], 3.0, shift=False, chunk=F.date_trunc("day", "seen_at"))
    return means.select("event_id", half_up("ewm_v", 6).alias("mean"))


@query("wn4_group_total", "SELECT player_id, year, week, CAST(sum(carries) OVER (PARTITION BY team, year, week) AS BIGINT) AS team_carries FROM usage")
def _(t):
    return W.group_total(t.usage, ["team", "year", "week"], "carries", "team_carries").select("player_id", "year", "week", "team_carries")


@query("wn5_stint_features", """WITH a AS (SELECT player_id, year, week, team, lag(team) OVER w AS pt, lag(year) OVER w AS py, row_number() OVER w - 1 AS prior_games FROM player_stats
      WINDOW w AS (PARTITION BY player_id ORDER BY year, week)),
    b AS (SELECT *, sum(CASE WHEN pt = team THEN 0 ELSE 1 END) OVER (PARTITION BY player_id ORDER BY year, week) AS stint FROM a)
    SELECT player_id, year, week, prior_games, CAST(stint AS BIGINT) AS stint, py IS DISTINCT FROM year AS new_season,
      row_number() OVER (PARTITION BY player_id, stint ORDER BY year, week) - 1 AS stint_games FROM b""")
def _(t):
    return W.stint_features(t.player_stats.select("player_id", "year", "week", "team"), ["player_id"], ["year", "week"]).select(
        "player_id", "year", "week", "prior_games", "stint", "new_season", "stint_games")


@query("wn6_recency_hit_rate", f"""WITH r AS (SELECT player_id, CASE WHEN rush_yds > 40 THEN 1.0E0 ELSE 0.0E0 END AS hit, row_number() OVER (PARTITION BY player_id ORDER BY year DESC, week DESC) - 1 AS age FROM player_stats)
    SELECT player_id, count(*) AS games, CAST(sum(hit) AS BIGINT) AS hits, CAST(coalesce(sum(CASE WHEN age < 3 THEN hit END), 0) AS BIGINT) AS hits_last3, {hu('sum(pow(0.5E0, age / 4.0E0))', 6)} AS weight,
      {hu('sum(pow(0.5E0, age / 4.0E0) * hit)', 6)} AS weighted_hits, {hu('sum(pow(0.5E0, age / 4.0E0) * hit) / sum(pow(0.5E0, age / 4.0E0))', 6)} AS weighted_rate FROM r WHERE age < 16 GROUP BY player_id""")
def _(t):
    h = W.recency_hit_rate(t.player_stats, ["player_id"], ["year", "week"], F.col("rush_yds") > 40)
    return h.withColumns({c: half_up(c, 6) for c in ("weight", "weighted_hits", "weighted_rate")})


@query("wn7_tail_k", """SELECT player_id, year, week, team, CAST(age AS INT) AS age FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY year DESC, week DESC) AS age FROM usage) x WHERE age <= 6""")
def _(t):
    return W.tail_k(t.usage, ["player_id"], ["year", "week"], 6).select("player_id", "year", "week", "team", "age")


@query("wn8_share_of_total", f"""SELECT player_id, year, week, {hu('carries * 100.0E0 / nullif(sum(carries) OVER (PARTITION BY team, year, week), 0)', 6)} AS share FROM usage""")
def _(t):
    s = W.share_of_total(t.usage, ["team", "year", "week"], "carries", "share")
    return s.select("player_id", "year", "week", half_up("share", 6).alias("share"))


def _others(how_sql: str) -> str:
    return f"""WITH q AS (SELECT *, row_number() OVER (PARTITION BY player_id, snapshot ORDER BY book) AS i FROM quotes)
        SELECT a.player_id, a.snapshot, a.book, {how_sql} AS others FROM q a LEFT JOIN q b ON a.player_id = b.player_id AND a.snapshot = b.snapshot AND a.i <> b.i GROUP BY a.player_id, a.snapshot, a.book"""


@query("wn9_leave_one_out_mean", _others(hu("avg(b.line)", 6)))
def _(t):
    return W.leave_one_out(t.quotes, ["player_id", "snapshot"], "line", "mean").select("player_id", "snapshot", "book", half_up("others", 6).alias("others"))


@query("wn9_leave_one_out_median", _others(hu("median(b.line)", 6)))
def _(t):
    return W.leave_one_out(t.quotes, ["player_id", "snapshot"], "line", "median").select("player_id", "snapshot", "book", half_up("others", 6).alias("others"))


@query("wn9_leave_one_out_min", _others("min(b.line)"))
def _(t):
    return W.leave_one_out(t.quotes, ["player_id", "snapshot"], "line", "min").select("player_id", "snapshot", "book", "others")


@query("wn9_leave_one_out_count", _others("count(b.line)"))
def _(t):
    return W.leave_one_out(t.quotes, ["player_id", "snapshot"], "line", "count").select("player_id", "snapshot", "book", "others")


@query("wn10_best_row", f"""SELECT player_id, line, book, over_odds FROM (SELECT *, row_number() OVER (PARTITION BY player_id, line ORDER BY {ip('over_odds')}, book) AS rn FROM quotes) x WHERE rn = 1""")
def _(t):
    q = t.quotes.withColumn("p", O.implied_prob("over_odds"))
    return W.best_row(q, ["player_id", "line"], "p", [F.col("book")]).select("player_id", "line", "book", "over_odds")


WEEK_SCORES = "SELECT submitter, year, week, CASE WHEN count(CASE WHEN status = 'P' THEN 1 END) = 0 THEN sum(salary) / 64.0E0 END AS score FROM slots GROUP BY submitter, year, week"


def week_scores(t):
    return t.slots.groupBy("submitter", "year", "week").agg(
        F.when(F.count_if(F.col("status") == "P") == 0, F.sum("salary") / 64.0).alias("score"))


@query("wn11_dropped_week", f"""WITH s AS ({WEEK_SCORES}) SELECT year, submitter, week AS dropped_week FROM (SELECT *, row_number() OVER (PARTITION BY year, submitter ORDER BY score, week) AS rn,
    count(*) OVER (PARTITION BY year, submitter) AS n FROM s WHERE score IS NOT NULL) x WHERE rn = 1 AND n >= 2""")
def _(t):
    return W.dropped_week(week_scores(t), ("year", "submitter"))


@query("wn12_weekly_top", f"""WITH s AS ({WEEK_SCORES}) SELECT year, week, submitter, score FROM (SELECT *, rank() OVER (PARTITION BY year, week ORDER BY score DESC) AS r FROM s WHERE score IS NOT NULL) x WHERE r = 1""")
def _(t):
    return W.weekly_top(week_scores(t)).select("year", "week", "submitter", "score")


@query("wn13_first_in_group", "SELECT year, week, team, CAST(min(kickoff) OVER (PARTITION BY year, week) AS STRING) AS first_kickoff FROM schedule")
def _(t):
    return W.first_in_group(t.schedule, ["year", "week"], "kickoff", "first_kickoff").select("year", "week", "team", F.col("first_kickoff").cast("string").alias("first_kickoff"))


@query("wn14_robust_median", f"""WITH q AS (SELECT player_id, {ip('over_odds')} * (CASE WHEN book = 'circa' THEN 0.1E0 ELSE 1.0E0 END) AS p FROM quotes),
    m AS (SELECT player_id, median(p) AS m, count(*) AS n FROM q GROUP BY player_id),
    k AS (SELECT q.player_id, q.p, (m.n < 3 OR (q.p <= m.m * 2.5E0 AND q.p >= m.m / 2.5E0)) AS inside FROM q JOIN m USING (player_id))
    SELECT player_id, {hu('coalesce(median(p) FILTER (inside), median(p))', 6)} AS median, CASE WHEN count(*) FILTER (inside) > 0 THEN count(*) FILTER (inside) ELSE count(*) END AS n FROM k GROUP BY player_id""")
def _(t):
    q = t.quotes.withColumn("p", O.implied_prob("over_odds") * F.when(F.col("book") == "circa", 0.1).otherwise(1.0))
    return W.robust_median(q, ["player_id"], "p").withColumn("median", half_up("median", 6))


@query("wn15_fractions", f"""WITH a AS (SELECT name_key, avg(rush_yds) AS v FROM player_stats GROUP BY name_key), r AS (SELECT name_key, v, row_number() OVER (ORDER BY v DESC, name_key) AS rank, count(*) OVER () AS total,
    min(v) OVER () AS lo, max(v) OVER () AS hi FROM a) SELECT name_key, {hu('(hi - v) / nullif(hi - lo, 0)', 6)} AS value_fraction, {hu('(rank - 1.0E0) / (total - 1.0E0)', 6)} AS rank_fraction FROM r""")
def _(t):
    a = t.player_stats.groupBy("name_key").agg(F.avg("rush_yds").alias("v")).withColumn("league", F.lit(1))
    f = W.minmax_fraction(W.rank_in_group(a, ["league"], "v", "name_key"), {"v": "value_fraction"})
    return f.select("name_key", half_up("value_fraction", 6).alias("value_fraction"), half_up(W.rank_fraction("rank", "rank_total"), 6).alias("rank_fraction"))
