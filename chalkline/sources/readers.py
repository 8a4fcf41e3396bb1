"""File sources: typed CSV scans, tolerant reads, salary layouts and nested payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions.names import normalize_name
from chalkline.functions.teams import normalize_team, spellings, map_literal
from chalkline.functions.values import as_col, blank_to_null, money, to_float, to_int, zero_if_null
from chalkline.operators.ordered import attach


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Typed CSV / CSV.gz scan of a file, a list or a glob; a gzip file is one task, so land it as parquet once."""
    df = spark.read.schema(schema).option("header", True).csv(list(paths) if not isinstance(paths, str) else paths)
    return df.select(*columns) if columns else df


def read_tolerant(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines). Lines are split by the scan and parsed as an expression, so one bad field never
    hides the rest; text that is not UTF-8 is read with encoding='ISO-8859-1'. The header is a line naming the columns."""
    lines = (spark.read.schema("value string").option("sep", "\u0001").option("quote", "").option("encoding", encoding).csv(path))
    header = ",".join(part.split()[0] for part in schema.split(", "))
    parsed = lines.where(F.col("value") != header).withColumn("r", F.from_csv(
        "value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r._bad").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_bad"), parsed.where(bad).select("value")


def latest_n(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows of the newest n values of `column` (seasons, snapshots). n values reach one task, not n rows' worth."""
    newest = df.select(column).distinct().orderBy(F.desc(column)).limit(n)
    return df.join(newest, column, "left_semi")


def newest_snapshot(df: DataFrame, column: str = "scraped_at") -> DataFrame:
    return df.where(F.col(column) == df.agg(F.max(column)).scalar())


def season_scope(df: DataFrame, year: int | None, column: str = "year") -> DataFrame:
    return df if year is None else df.where(F.col(column).cast("string").try_cast("int") == year)


def year_from_path(path: Column | str, fallback: int | None = None) -> Column:
    """Parent folder 20dd, else a date in the file name, else a bare year in it, else the fallback."""
    p = as_col(path)
    name = F.element_at(F.split(p, "/"), -1)
    got = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.coalesce(got(p, r"(?:^|/)(20\d{2})/[^/]*$"), got(name, r"(20\d{2})-\d{2}-\d{2}"), got(name, r"(20\d{2})"),
                      F.lit(fallback).cast("string")).cast("int")


def detect_layout(columns: Sequence[str]) -> str:
    """Salary layout by its columns: 'cheatsheet', 'export', 'semicolon', 'canonical' or 'unknown'."""
    have = set(columns)
    if {"ppg_projection", "game_date"} <= have:
        return "cheatsheet"
    if {"proj_points", "proj_rotowire"} <= have:
        return "export"
    if {"dk_salary", "name_key", "source"} <= have:
        return "canonical"
    return "semicolon" if have == {"value"} else "unknown"


SALARY_COLUMNS = ["week", "year", "name", "name_key", "position", "team", "opponent", "dk_salary", "dk_pts_scored",
                  "projected_pts", "ownership_pct", "source"]


def _canonical(df: DataFrame, source: str) -> DataFrame:
    out = df.withColumns({"name_key": normalize_name("name"), "source": F.lit(source)})
    return out.where((F.col("name") != "") & (F.coalesce("dk_salary", F.lit(0)) != 0)
                     & (F.coalesce("week", F.lit(0)) != 0)).select(*SALARY_COLUMNS)


def _code(column: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))


def _full_name() -> Column:
    return F.trim(F.concat_ws(" ", blank_to_null("first_name"), blank_to_null("last_name")))


def parse_cheatsheet(df: DataFrame, year: Column | int) -> DataFrame:
    """Cheatsheet layout: Thursday slates only; defences are named by nickname, else by team code."""
    y = year if isinstance(year, Column) else F.lit(year)
    rows = df.where(F.contains(F.lower("slate"), F.lit("thu"))) if "slate" in df.columns else df
    pos = F.upper(F.trim(F.coalesce("position", F.lit(""))))
    name = F.when((pos == "DST") & (_full_name() == ""), F.upper(_code("team"))).otherwise(_full_name())
    return _canonical(rows.select(
        to_int("week").cast("int").alias("week"), y.cast("int").alias("year"), name.alias("name"), pos.alias("position"),
        _code("team").alias("team"), _code("opp").alias("opponent"), money("salary").alias("dk_salary"),
        to_float("ppg_actual").alias("dk_pts_scored"), to_float("ppg_projection").alias("projected_pts"),
        F.lit(None).cast("double").alias("ownership_pct")), "cheatsheet")


def parse_export(df: DataFrame, year: Column | int) -> DataFrame:
    """Export layout: 'D' is DST, named by team code; players fall back to the `player` column."""
    y = year if isinstance(year, Column) else F.lit(year)
    raw = F.upper(F.trim(F.coalesce("position", F.lit(""))))
    pos = F.when(raw == "D", F.lit("DST")).otherwise(raw)
    code = F.coalesce(map_literal(spellings())[F.lower(_full_name())], _code("team"))
    fallback = F.trim(F.coalesce(F.col("player"), F.lit(""))) if "player" in df.columns else F.lit("")
    name = (F.when(pos == "DST", F.concat(F.upper(code), F.lit(" DST")))
            .when(_full_name() == "", fallback).otherwise(_full_name()))
    return _canonical(df.select(
        to_int("week").cast("int").alias("week"), y.cast("int").alias("year"), name.alias("name"), pos.alias("position"),
        _code("team").alias("team"), _code("opponent").alias("opponent"), money("salary").alias("dk_salary"),
        F.lit(None).cast("double").alias("dk_pts_scored"), to_float("proj_points").alias("projected_pts"),
        to_float("ownership").alias("ownership_pct")), "export")


def parse_semicolon(lines: DataFrame, column: str = "value") -> DataFrame:
    """Semicolon text rows: week;year;id;name;position;team;home_away;opponent;points;salary. Header and short rows go."""
    parts = F.split(F.trim(column), ";")
    rows = lines.where((F.size(parts) >= 10) & parts[0].rlike(r"^-?\d+$")).select(parts.alias("p"))
    t = lambda i: F.trim(F.col("p")[i])
    return _canonical(rows.select(
        t(0).cast("int").alias("week"), t(1).try_cast("int").alias("year"), t(3).alias("name"), F.upper(t(4)).alias("position"),
        F.lower(t(5)).alias("team"), F.lower(t(7)).alias("opponent"), money(t(9)).alias("dk_salary"),
        to_float(t(8)).alias("dk_pts_scored"), F.lit(None).cast("double").alias("projected_pts"),
        F.lit(None).cast("double").alias("ownership_pct")), "semicolon")


def normalize_salaries(df: DataFrame, year: Column | int) -> DataFrame:
    layout = detect_layout(df.columns)
    if layout == "cheatsheet":
        return parse_cheatsheet(df, year)
    if layout == "export":
        return parse_export(df, year)
    if layout == "semicolon":
        return parse_semicolon(df)
    if layout == "canonical":
        return df.select(*SALARY_COLUMNS)
    raise ValueError(f"unknown salary layout: {sorted(df.columns)}")


MARKET_SCHEMA = ("id string, stat string, value double, description string, available boolean, projection double, "
                 "player struct<first_name:string,last_name:string,team:struct<key:string>>, "
                 "comparison map<string,struct<value:double,over:double,under:double,available:boolean>>")


def parse_markets(payloads: DataFrame, json_column: str = "payload", category: str = "category") -> DataFrame:
    """Nested market JSON -> one row per (market, book)."""
    m = payloads.select(category, F.from_json(json_column, MARKET_SCHEMA).alias("m"))
    first, last = F.col("m.player.first_name"), F.col("m.player.last_name")
    full = F.trim(F.concat_ws(" ", first, last))
    name = F.when(full != "", full).otherwise(F.col("m.description"))
    rows = m.select(category, name.alias("player_name"), normalize_team("m.player.team.key").alias("team"),
                    F.col("m.projection").alias("site_projection"), F.explode("m.comparison").alias("book", "q"))
    return rows.where(F.col("player_name").isNotNull() & (F.col("player_name") != "")).select(
        category, "player_name", "team", "book", F.col("q.value").alias("line"), F.col("q.over").alias("over_odds"),
        F.col("q.under").alias("under_odds"), "site_projection", F.col("q.available").alias("available"))


SLATE_SCHEMA = "array<struct<player:string,position:string,team:string,opp:string,salary:string,proj:string,ownership:string>>"


def parse_slate(payloads: DataFrame, json_column: str = "payload") -> DataFrame:
    """Slate JSON arrays -> player rows; salary text is cleaned, missing numbers become 0, blank names go."""
    rows = payloads.select("year", "week", F.explode(F.from_json(json_column, SLATE_SCHEMA)).alias("p"))
    return rows.select("year", "week", F.trim(F.coalesce("p.player", F.lit(""))).alias("name"),
                       F.upper(F.trim(F.coalesce("p.position", F.lit("")))).alias("position"),
                       F.trim(F.coalesce("p.team", F.lit(""))).alias("team"), F.trim(F.coalesce("p.opp", F.lit(""))).alias("opponent"),
                       zero_if_null(money("p.salary")).alias("salary"), zero_if_null(to_float("p.proj")).alias("projected_pts"),
                       zero_if_null(to_float("p.ownership")).alias("ownership_pct")).where(F.col("name") != "")


def with_name_key(df: DataFrame, name: str = "name") -> DataFrame:
    return df.withColumn("name_key", normalize_name(name))


def with_crosswalk(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return attach(df, table, [key])
