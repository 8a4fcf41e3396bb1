"""Data-quality and reconciliation jobs (DQ)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.catalog.registry import query
from chalkline.catalog.views import hu
from chalkline.functions.values import half_up
from chalkline.operators import quality as D


@query("dq1_check_datasets", """SELECT 'game_info' AS dataset, 'missing_column' AS "check", 'boxscore_url' AS detail UNION ALL SELECT 'weather', 'age', '30h old'
    UNION ALL SELECT 'rankings', 'missing', 'no data' UNION ALL SELECT 'defense_stats', 'empty_column', 'dk_pts' FROM (SELECT count(*) AS n FROM defense) x WHERE n > 0
    UNION ALL SELECT 'player_stats', 'min_rows', concat(CAST(n AS STRING), ' rows, expected at least 100000000') FROM (SELECT count(*) AS n FROM player_stats) x WHERE n < 100000000""")
def _(t):
    rules = [D.Rule("game_info", 100, ("boxscore_url", "team_home"), False), D.Rule("weather", 10, ("away_team", "home_team"), True), D.Rule("rankings", 50, ("player_name",), True),
             D.Rule("defense_stats", 100, ("team", "dk_pts"), False), D.Rule("player_stats", 100_000_000, ("name", "team", "dk_pts"), False)]
    data = {"game_info": t.game_info, "weather": t.weather, "defense_stats": t.defense.withColumn("dk_pts", F.lit(None).cast("double")), "player_stats": t.player_stats}
    return D.check_datasets(t.spark, data, rules, {"weather": 30.0, "player_stats": 99.0}, 24.0)


OLD_NEW = """o AS (SELECT player_id, year, week, dk_pts AS v FROM player_stats WHERE rec <> 3), n AS (SELECT player_id, year, week, coalesce(dk_pts_reported, dk_pts) AS v FROM player_stats WHERE rec <> 4),
    j AS (SELECT o.v AS ov, n.v AS nv, abs(n.v - o.v) AS gap, coalesce(o.player_id, n.player_id) AS player_id, coalesce(o.year, n.year) AS year, coalesce(o.week, n.week) AS week FROM o FULL OUTER JOIN n ON o.player_id = n.player_id AND o.year = n.year AND o.week = n.week)"""
KEY = ["player_id", "year", "week"]


def old_new(t):
    s = t.player_stats
    return (s.where("rec <> 3").select(*KEY, F.col("dk_pts").alias("v")), s.where("rec <> 4").select(*KEY, F.coalesce("dk_pts_reported", "dk_pts").alias("v")))


@query("dq2_compare_points", f"""WITH {OLD_NEW} SELECT count(gap) AS matched, count(*) FILTER (nv IS NULL) AS only_old, count(*) FILTER (ov IS NULL) AS only_new, {hu('avg(gap)', 4)} AS mean_gap, {hu('median(gap)', 4)} AS median_gap, {hu('max(gap)', 4)} AS max_gap,
    count(*) FILTER (gap = 0) AS exact, count(*) FILTER (gap <= 0.5) AS within_half, count(*) FILTER (gap > 1) AS over_threshold FROM j""")
def _(t):
    return D.compare_points(*old_new(t), KEY, "v")


@query("dq2_worst_gaps", f"WITH {OLD_NEW} SELECT player_id, year, week, ov AS old_value, nv AS new_value, {hu('gap', 4)} AS gap FROM j WHERE gap IS NOT NULL ORDER BY gap DESC, player_id, year, week LIMIT 20")
def _(t):
    return D.worst_gaps(*old_new(t), KEY, "v")


@query("dq3_match_stats", f"SELECT count(*) AS n_rows, count(p.player_id) AS matched_rows, count(*) - count(p.player_id) AS unmatched_rows, {hu('count(p.player_id) * 100.0E0 / count(*)', 1)} AS match_pct FROM usage u LEFT JOIN player_stats p USING (player_id, year, week)")
def _(t):
    from chalkline.operators.joins import borrow

    return D.match_stats(borrow(t.usage.select(*KEY), t.player_stats.select(*KEY, "dk_pts"), KEY, ["dk_pts"], [F.desc("dk_pts")]))


@query("dq4_duplicate_keys", """WITH b AS (SELECT name_key, status FROM injuries_depth UNION ALL SELECT name_key, status FROM injuries_edge), g AS (SELECT name_key, count(*) AS n_rows, count(DISTINCT status) AS n_values FROM b GROUP BY name_key)
    SELECT b.name_key, b.status, g.n_rows, g.n_values FROM b JOIN g USING (name_key) WHERE g.n_values > 1""")
def _(t):
    both = t.injuries_depth.select("name_key", "status").unionByName(t.injuries_edge.select("name_key", "status"))
    return D.duplicate_keys(both, ["name_key"], "status")


@query("dq5_rekey_report", """WITH b AS (SELECT cid, CASE WHEN cid % 7 = 0 THEN concat(name_key, ' jr') ELSE name_key END AS k FROM (SELECT DISTINCT cid, name_key FROM slate) x
      UNION ALL SELECT cid + 10000000, name_key FROM (SELECT DISTINCT cid, name_key FROM slate) x WHERE cid % 14 = 0),
    n AS (SELECT *, trim(regexp_replace(k, '\\s+(jr|sr|ii|iii|iv|v)$', '')) AS nk FROM b)
    SELECT n.cid, n.k, n.nk AS new_key, CASE WHEN n.nk = n.k THEN 'same' WHEN EXISTS (SELECT 1 FROM b WHERE b.k = n.nk) THEN 'collision' ELSE 'change' END AS action FROM n""")
def _(t):
    base = t.slate.select("cid", "name_key").distinct()
    rows = base.select("cid", F.when(F.col("cid") % 7 == 0, F.concat("name_key", F.lit(" jr"))).otherwise(F.col("name_key")).alias("k"))
    twins = base.where("cid % 14 = 0").select((F.col("cid") + 10000000).alias("cid"), F.col("name_key").alias("k"))
    return D.rekey_report(rows.unionByName(twins), "cid", "k").select("cid", "k", "new_key", "action")


@query("dq6_source_coverage", f"""SELECT count(*) AS n_rows, count(u.player_id) AS matched_rows, {hu('count(u.player_id) * 100.0E0 / count(*)', 1)} AS match_pct, count(u.offense_pct) AS with_offense_pct FROM player_stats p LEFT JOIN usage u USING (player_id, year, week)""")
def _(t):
    return D.source_coverage(t.player_stats, t.usage, KEY, ["offense_pct"])


@query("dq7_bulk_coverage", """WITH b AS (SELECT DISTINCT player_id, book FROM quotes), p AS (SELECT DISTINCT player_id, book FROM quotes_now), j AS (SELECT coalesce(b.player_id, p.player_id) AS player_id, b.book AS bb, p.book AS pb
      FROM b FULL OUTER JOIN p ON b.player_id = p.player_id AND b.book = p.book)
    SELECT player_id, count(bb) AS bulk_books, count(pb) AS item_books, count(*) FILTER (bb IS NULL) AS missing_in_bulk, count(*) FILTER (pb IS NULL) AS extra_in_bulk FROM j GROUP BY player_id""")
def _(t):
    return D.bulk_coverage(t.quotes, t.quotes_now, ["player_id"])


@query("dq8_data_as_of", """SELECT event_type AS source, CAST(max(event_id) AS BIGINT) AS newest, CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS INT) AS list_pos FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY event_type""")
def _(t):
    loads = t.events.select(F.col("event_type").alias("source"), F.col("event_id").alias("file_time"), (F.col("event_id") - 5).alias("loaded_at"))
    return D.data_as_of(loads, ["view", "click", "purchase"]).select("source", F.col("as_of").alias("newest"), "list_pos")


_ = half_up
