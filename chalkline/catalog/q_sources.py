"""Sources (SRC): typed scans, layouts, nested payloads and page extraction, on files derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.catalog.q_streams import scratch
from chalkline.catalog.registry import query
from chalkline.sources import pages as P, readers as R
from chalkline.sources.tables import save

STATS = "player_id string, year int, week int, team string, rush_yds int"
COLS = ["player_id", "year", "week", "team", "rush_yds"]


def landed(t, name, df, fmt="csv", **options):
    root = scratch(t.spark, name)
    w = df.write.mode("overwrite").option("header", True)
    for k, v in options.items():
        w = w.option(k, v)
    w.format(fmt).save(root)
    return root


@query("src1_csv_gz_scan", "SELECT player_id, year, week, team, rush_yds FROM player_stats")
def _(t):
    return R.read_csv(t.spark, landed(t, "src1", t.player_stats.select(*COLS), compression="gzip"), STATS)


@query("src2_column_pruned_scan", "SELECT player_id, rush_yds FROM player_stats")
def _(t):
    return R.read_csv(t.spark, landed(t, "src2", t.player_stats.select(*COLS)), STATS, ["player_id", "rush_yds"])


@query("src3_glob_scan", "SELECT player_id, year, week, team, rush_yds FROM player_stats WHERE year <= 1999")
def _(t):
    root = scratch(t.spark, "src3")
    save(t.player_stats.select(*COLS).withColumn("season", F.col("year")), root, ["season"], "csv")
    return R.read_csv(t.spark, f"{root}/season=199*", STATS)


@query("src4_latest_n", "SELECT player_id, year, week FROM player_stats WHERE year IN (SELECT DISTINCT year FROM player_stats ORDER BY year DESC LIMIT 2)")
def _(t):
    return R.latest_n(t.player_stats, "year", 2).select("player_id", "year", "week")


@query("src5_tolerant_read", "SELECT count(*) AS good_rows, count(*) FILTER (rec = 3) AS bad_rows FROM player_stats")
def _(t):
    """Every row once as it is, and rows with three catches once more with a broken number."""
    s = t.player_stats.select(*COLS, "rec")
    bad = s.where("rec = 3").select("player_id", F.lit("x").alias("year"), "week", "team", "rush_yds")
    root = landed(t, "src5", s.drop("rec").withColumn("year", F.col("year").cast("string")).unionByName(bad))
    good, broken = R.read_tolerant(t.spark, root, STATS)
    tag = lambda df, g: df.select(F.lit(g).alias("g"))
    return tag(good, 1).unionByName(tag(broken, 0)).agg(F.count_if(F.col("g") == 1).alias("good_rows"), F.count_if(F.col("g") == 0).alias("bad_rows"))


@query("src7_year_from_path", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 2000 + o_orderkey % 90 WHEN o_orderkey % 4 = 1 THEN 2003 WHEN o_orderkey % 4 = 2 THEN 2025 ELSE 1999 END AS INT) AS year FROM orders")
def _(t):
    k = F.col("o_orderkey")
    path = (F.when(k % 4 == 0, F.concat(F.lit("data/"), (2000 + k % 90).cast("string"), F.lit("/week9_2024.csv")))
            .when(k % 4 == 1, F.lit("in/sheet_2003-12-11_2010.csv")).when(k % 4 == 2, F.lit("salaries_2025_wk1.csv")).otherwise(F.lit("x.csv")))
    return t.orders.select("o_orderkey", R.year_from_path(path, 1999).alias("year"))


SAL = "SELECT week, year, {name} AS name, {key} AS name_key, position, team, opponent, CAST(salary AS BIGINT) AS dk_salary, CAST({pts} AS DOUBLE) AS dk_pts_scored, CAST({proj} AS DOUBLE) AS projected_pts, CAST({own} AS DOUBLE) AS ownership_pct, '{src}' AS source FROM slate"
_FULL = "concat('P', CAST(cid AS STRING), ' Last', CAST(cid % 200 AS STRING), CASE WHEN cid % 7 = 0 THEN ' Jr.' ELSE '' END)"


def _names():
    parts = F.split("name", " ", 2)
    return parts[0].alias("first_name"), parts[1].alias("last_name")


@query("src6_layout_dispatch", "SELECT 'cheatsheet' AS source, position, count(*) AS n FROM slate GROUP BY position UNION ALL SELECT 'export', position, count(*) FROM slate GROUP BY position")
def _(t):
    """Files of two layouts, each told apart by its columns, stacked in the canonical form."""
    base = t.slate.select(*_names(), "position", F.col("week").cast("string").alias("week"), "year", "team", F.col("opponent").alias("opp"), "opponent", F.col("salary").cast("string").alias("salary"))
    none = F.lit(None).cast("string")
    one = base.withColumns({"ppg_projection": none, "ppg_actual": none, "game_date": none})
    two = base.withColumns({"proj_points": none, "proj_rotowire": none, "ownership": none})
    both = R.normalize_salaries(one, F.col("year")).unionByName(R.normalize_salaries(two, F.col("year")))
    return both.groupBy("source", "position").agg(F.count(F.lit(1)).alias("n"))


@query("src8_cheatsheet", SAL.format(name="name", key="name_key", pts="NULL", proj="cid % 20", own="NULL", src="cheatsheet") + " WHERE cid % 5 <> 3")
def _(t):
    s = t.slate.select(*_names(), "position", F.col("week").cast("string").alias("week"), "year", F.when(F.col("cid") % 5 == 3, F.lit("Sun")).otherwise(F.lit("Thu-Mon")).alias("slate"), F.upper("team").alias("team"),
                       F.upper("opponent").alias("opp"), F.format_number("salary", 0).alias("salary"), (F.col("cid") % 20).cast("string").alias("ppg_projection"), F.lit("").alias("ppg_actual"), F.lit("d").alias("game_date"))
    return R.normalize_salaries(s, F.col("year"))


@query("src9_export_layout", SAL.format(name="CASE WHEN position = 'DST' THEN concat(upper(team), ' DST') ELSE name END", key="CASE WHEN position = 'DST' THEN concat(team, ' dst') ELSE name_key END", pts="NULL", proj="cid % 20", own="cid % 30", src="export"))
def _(t):
    is_dst = F.col("position") == "DST"
    s = t.slate.select(*[F.when(~is_dst, c).alias(n) for c, n in zip(_names(), ("first_name", "last_name"))], F.when(is_dst, F.lit("D")).otherwise(F.col("position")).alias("position"), F.col("week").cast("string").alias("week"), "year",
                       F.upper("team").alias("team"), F.upper("opponent").alias("opponent"), F.concat(F.lit("$"), F.format_number("salary", 0)).alias("salary"), (F.col("cid") % 20).cast("string").alias("proj_points"), F.lit("1").alias("proj_rotowire"),
                       (F.col("cid") % 30).cast("string").alias("ownership"), F.lit("").alias("player"))
    return R.normalize_salaries(s, F.col("year"))


@query("src12_semicolon", SAL.format(name="name", key="name_key", pts="cid % 20", proj="NULL", own="NULL", src="semicolon"))
def _(t):
    line = F.concat_ws(";", "week", "year", F.lit("id1"), "name", F.lower("position"), F.upper("team"), F.lit("h"), F.upper("opponent"), (F.col("cid") % 20).cast("string"), F.concat(F.lit("$"), "salary"))
    lines = t.slate.select(F.explode(F.array(line, F.lit("Week;Year;GID;Name"), F.lit("1;2;3"))).alias("value"))
    root = scratch(t.spark, "src12")
    lines.write.mode("overwrite").text(root)
    return R.normalize_salaries(t.spark.read.text(root), 0)


@query("src10_market_json", "SELECT category, player_name, team, lower(book) AS book, line, over_odds, under_odds, site_projection, available FROM quotes")
def _(t):
    """Quotes are packed into one payload per (player, projection) and read back through the parser."""
    q = t.quotes.withColumn("book", F.lower("book"))
    first, last = F.split("player_name", " ", 2)[0], F.split("player_name", " ", 2)[1]
    entry = F.struct(F.col("line").alias("value"), F.col("over_odds").alias("over"), F.col("under_odds").alias("under"), "available")
    # A player's quotes are bounded by the number of books. Players may share a name, so a payload is told by the player's id.
    packed = q.groupBy("category", "player_id", "player_name", "team", "site_projection", "snapshot").agg(F.map_from_entries(F.collect_list(F.struct("book", entry.alias("q")))).alias("comparison"))
    player = F.struct(first.alias("first_name"), last.alias("last_name"), F.struct(F.upper("team").alias("key")).alias("team"))
    payload = F.to_json(F.struct(F.lit("1").alias("id"), F.col("site_projection").alias("projection"), player.alias("player"), "comparison"))
    return R.parse_markets(packed.select("category", payload.alias("payload")))


@query("src11_slate_json", "SELECT year, week, name, position, upper(team) AS team, '' AS opponent, CAST(salary AS BIGINT) AS salary, CAST(cid % 20 AS DOUBLE) AS projected_pts, 0.0E0 AS ownership_pct FROM slate")
def _(t):
    item = F.struct(F.concat(F.lit(" "), "name").alias("player"), F.lower("position").alias("position"), F.upper("team").alias("team"), F.concat(F.lit("$"), F.format_number("salary", 0)).alias("salary"),
                    (F.col("cid") % 20).cast("string").alias("proj"))
    docs = t.slate.withColumn("part", F.floor(F.col("cid") / 75)).groupBy("year", "week", "part").agg(F.to_json(F.collect_list(item)).alias("payload"))
    return R.parse_slate(docs)


@query("src15_newest_snapshot", "SELECT event_id, user_id FROM events WHERE ts = (SELECT max(ts) FROM events)")
def _(t):
    return R.newest_snapshot(t.events, "ts").select("event_id", "user_id")


@query("src16_season_scope", "SELECT player_id, week FROM player_stats WHERE year = 1999")
def _(t):
    return R.season_scope(t.player_stats, 1999).select("player_id", "week")


LINKS = P.FieldMap(fields=(P.Field("href", 0, "href"), P.Field("link_text", 0)), row_tag="li", cell_tags=("a",), within_tag="nav")


@query("src13_page_records", r"""SELECT page_id, unnest(regexp_extract_all(nav, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(nav, '<a href="[^"]*">([^<]*)</a>', 1)) AS link_text
    FROM (SELECT page_id, array_to_string(regexp_extract_all(html, '<nav>(.*?)</nav>', 1), ' ') AS nav FROM pages) x""")
def _(t):
    return P.extract_pages(t.pages, LINKS).drop("record_no")
