"""Table maintenance (SNK): each query applies an update set derived from the tables to a target derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from chalkline.catalog.registry import query
from chalkline.sources import tables as S

KEY = ["player_id", "book", "snapshot"]
COLS = [*KEY, "line", "over_odds"]


def pair(t):
    return t.quotes.select(*COLS), t.quotes_now.select(*COLS)


@query("snk1_write_read", "SELECT team, pos, name_key, string_rank FROM depth")
def _(t):
    from chalkline.catalog.q_streams import scratch

    root = scratch(t.spark, "snk1")
    S.save(t.depth.select("team", "pos", "name_key", "string_rank"), root, fmt="csv")
    return t.spark.read.schema("team string, pos string, name_key string, string_rank int").option("header", True).csv(root)


@query("snk2_upsert", """SELECT coalesce(n.player_id, q.player_id) AS player_id, coalesce(n.book, q.book) AS book, coalesce(n.snapshot, q.snapshot) AS snapshot, coalesce(n.line, q.line) AS line, coalesce(n.over_odds, q.over_odds) AS over_odds
    FROM quotes q FULL OUTER JOIN quotes_now n ON q.player_id = n.player_id AND q.book = n.book AND q.snapshot = n.snapshot""")
def _(t):
    return S.upsert(*pair(t), KEY)


@query("snk2_upsert_batch_duplicates", """SELECT player_id, book, line, over_odds FROM (SELECT *, row_number() OVER (PARTITION BY player_id, book ORDER BY occurrence DESC) AS rn FROM quotes_all) x WHERE rn = 1""")
def _(t):
    """All scrapes are one batch in which every (player, book) repeats; the first scrape is what the table holds."""
    key = ["player_id", "book"]
    all_rows = t.quotes_all.select(*key, "line", "over_odds", "occurrence")
    held = all_rows.where("occurrence = 1").withColumn("occurrence", F.lit(0).cast("bigint"))
    return S.upsert(held, all_rows, key, ["occurrence"]).drop("occurrence")


@query("snk3_upsert_columns", """SELECT coalesce(q.player_id, n.player_id) AS player_id, coalesce(q.book, n.book) AS book, coalesce(q.snapshot, n.snapshot) AS snapshot, coalesce(n.line, q.line) AS line, coalesce(q.over_odds, n.over_odds) AS over_odds
    FROM quotes q FULL OUTER JOIN quotes_now n ON q.player_id = n.player_id AND q.book = n.book AND q.snapshot = n.snapshot""")
def _(t):
    return S.upsert_columns(*pair(t), KEY, ["line"])


@query("snk4_replace_all", """SELECT player_id, line, book FROM (SELECT *, row_number() OVER (PARTITION BY player_id, line ORDER BY book DESC) AS rn FROM quotes) x WHERE rn = 1""")
def _(t):
    return S.replace_all(t.quotes.select("player_id", "line", "book"), ["player_id", "line"], ["book"])


@query("snk5_fill_gaps", """SELECT name_key, team, status FROM injuries_depth UNION ALL SELECT name_key, team, status FROM injuries_edge e WHERE NOT EXISTS (SELECT 1 FROM injuries_depth d WHERE d.name_key = e.name_key AND d.team = e.team)""")
def _(t):
    c = ["name_key", "team", "status"]
    return S.fill_gaps(t.injuries_depth.select(*c), t.injuries_edge.select(*c), ["name_key", "team"])


@query("snk6_replace_partition", "SELECT year, week, team, points_scored FROM team_points WHERE year < 2000 UNION ALL SELECT year, week, team, points_allowed FROM team_points WHERE year >= 2000")
def _(t):
    p = t.team_points.select("year", "week", "team", "points_scored")
    return S.replace_partition(p, t.team_points.where("year >= 2000").select("year", "week", "team", F.col("points_allowed").alias("points_scored")))


@query("snk7_append_keep_last", """SELECT player_id, book, snapshot, line FROM (SELECT *, row_number() OVER (PARTITION BY player_id, book, snapshot ORDER BY p DESC) AS rn FROM (SELECT player_id, book, snapshot, line, 1 AS p FROM quotes UNION ALL SELECT player_id, book, snapshot, line, 2 FROM quotes_now) x) y WHERE rn = 1""")
def _(t):
    a, b = pair(t)
    return S.append_keep_last(a.select(*KEY, "line"), b.select(*KEY, "line"), KEY)


@query("snk8_append_keep_first", """SELECT player_id, book, snapshot, line FROM (SELECT *, row_number() OVER (PARTITION BY player_id, book, snapshot ORDER BY p) AS rn FROM (SELECT player_id, book, snapshot, line, 1 AS p FROM quotes UNION ALL SELECT player_id, book, snapshot, line, 2 FROM quotes_now) x) y WHERE rn = 1""")
def _(t):
    a, b = pair(t)
    return S.append_keep_first(a.select(*KEY, "line"), b.select(*KEY, "line"), KEY)


@query("snk9_record_load", "SELECT 'events' AS source, CAST(max(ts) AS STRING) AS file_time, count(*) AS row_count FROM events")
def _(t):
    e = t.events.withColumn("at", F.col("ts").cast("timestamp"))
    return S.record_load("events", e, F.current_timestamp(), F.col("at")).select("source", F.col("file_time").cast("string").alias("file_time"), "row_count")


@query("snk9_record_load_files", "SELECT 'events' AS source, count(*) AS row_count, true AS newest_file, true AS later_than_first FROM events")
def _(t):
    """Several files written one after the other: the audit row has the time of the newest, as the storage tells it."""
    from chalkline.catalog.q_streams import scratch
    from chalkline.sources.derived import input_files

    root = scratch(t.spark, "snk9")
    for k in range(3):
        t.events.where(F.col("event_id") % 3 == k).write.mode("append").parquet(root)
    times = [at for path, _, at in input_files(t.spark, [root]) if path.endswith(".parquet")]
    row = S.record_load("events", t.spark.read.parquet(root), F.current_timestamp())
    millis = F.unix_millis("file_time")
    return row.select("source", "row_count", (millis == F.lit(max(times))).alias("newest_file"), (millis > F.lit(min(times))).alias("later_than_first"))


@query("snk10_archive_snapshot", "SELECT year, week, count(*) AS n FROM player_stats GROUP BY year, week")
def _(t):
    """Seasons arrive one after the other, each with the last one again; only what is new is added."""
    s = t.player_stats.select("year", "week", "player_id")
    old = s.where("year <= 1996 OR week % 2 = 0")
    return S.archive_snapshot(S.archive_snapshot(old, s.where("year <= 1999"), ["year", "week"]), s, ["year", "week"]).groupBy("year", "week").agg(F.count(F.lit(1)).alias("n"))


@query("snk11_export_tables", "SELECT 'prop_bets' AS table_name, count(*) AS n FROM prop_bets UNION ALL SELECT 'prop_picks', count(*) FROM prop_picks")
def _(t):
    from chalkline.catalog.q_streams import scratch

    root = scratch(t.spark, "snk11")
    S.export_tables({"prop_bets": (t.prop_bets, ["prop_id"]), "prop_picks": (t.prop_picks, ["year", "week", "submitter", "prop_id"])}, root, "parquet")
    read = lambda n: t.spark.read.parquet(f"{root}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n")
    return read("prop_bets").unionByName(read("prop_picks"))


@query("snk12_manifest_verify", "SELECT 'depth' AS table_name, count(*) AS row_count, count(*) AS live_count, true AS ok FROM depth UNION ALL SELECT 'quotes', (SELECT count(*) FROM quotes), (SELECT count(*) FROM quotes_now), (SELECT count(*) FROM quotes) = (SELECT count(*) FROM quotes_now)")
def _(t):
    return S.verify_manifest(S.manifest({"depth": t.depth, "quotes": t.quotes}), {"depth": t.depth, "quotes": t.quotes_now})


@query("snk13_delete_years", "SELECT year, count(*) AS removed FROM player_stats WHERE year IN (1996, 1998) GROUP BY year")
def _(t):
    return S.delete_years(t.player_stats, [1996, 1998])[1]


@query("snk13_kept_rows", "SELECT year, count(*) AS n FROM player_stats WHERE year NOT IN (1996, 1998) GROUP BY year")
def _(t):
    return S.delete_years(t.player_stats, [1996, 1998])[0].groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("snk14_export_view", "SELECT year, week, 'slate' AS source, name_key, name, salary, cid FROM slate")
def _(t):
    return S.export_view(t.slate.select("name", "salary", "cid", "week", "year"), {"year": None, "week": None, "source": "slate"})


@query("snk15_export_scope", "SELECT player_id, year, week, rush_yds FROM player_stats WHERE year = 1999 UNION ALL SELECT player_id, year, week, rush_yds FROM player_stats WHERE year = 2000 AND week = 3")
def _(t):
    from chalkline.plans.exports import export_dataset

    return export_dataset("player_stats", t.player_stats, year=1999).unionByName(export_dataset("player_stats", t.player_stats, year=2000, week=3)).select(
        "player_id", "year", "week", "rush_yds")


@query("snk15_export_catalogue", "SELECT 'player_stats' AS dataset, count(*) AS n FROM player_stats UNION ALL SELECT 'usage', count(*) FROM usage UNION ALL SELECT 'schedule', count(*) FROM schedule UNION ALL SELECT 'team_points', count(*) FROM team_points")
def _(t):
    from chalkline.plans.exports import export_dataset

    parts = [export_dataset(n, getattr(t, n)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("dataset"), "n") for n in ("player_stats", "usage", "schedule", "team_points")]
    return reduce(lambda a, b: a.unionByName(b), parts)
