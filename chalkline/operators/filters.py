"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.odds import PICKEM_BOOKS


def _not_in(column: str, values: Sequence[str]) -> Column:
    """NOT IN that keeps NULL rows."""
    return ~F.coalesce(F.col(column).isin(list(values)), F.lit(False))


def started_teams(kickoffs: DataFrame, now: Column) -> DataFrame:
    return kickoffs.where(F.col("kickoff") <= now).select("team").distinct()


def drop_started(quotes: DataFrame, kickoffs: DataFrame, now: Column) -> DataFrame:
    """Quotes whose team has not kicked off; quotes without a team stay."""
    return quotes.join(started_teams(kickoffs, now), "team", "left_anti")


def is_available(column: str = "available") -> Column:
    return F.coalesce(F.lower(F.col(column).cast("string")), F.lit("true")) != "false"


def only_available(quotes: DataFrame, column: str = "available") -> DataFrame:
    return quotes.where(is_available(column)) if column in quotes.columns else quotes


def exclude_books(quotes: DataFrame, books: Sequence[str] = (), pairs: Sequence[tuple[str, str]] = ()) -> DataFrame:
    out = quotes.where(_not_in("book", books)) if books else quotes
    if pairs:
        joined = F.concat_ws("|", F.lower("book"), F.lower("category"))
        out = out.where(~F.coalesce(joined.isin([f"{b}|{c}" for b, c in pairs]), F.lit(False)))
    return out


def drop_pickem(quotes: DataFrame) -> DataFrame:
    return exclude_books(quotes, PICKEM_BOOKS)


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def select_scope(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality selectors; None means no restriction, lists mean membership."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return df


def latest_scope(df: DataFrame, year: str = "year", week: str = "week") -> DataFrame:
    """Rows of the newest (year, week); the newest one is a scalar subquery, so the scan can prune on it."""
    newest = df.agg(F.max(F.struct(year, week))).scalar()
    return df.where(F.struct(year, week) == newest)


def before_week(df: DataFrame, year: int, week: int, since: int | None = None) -> DataFrame:
    """(year, week) strictly before, optionally from season `since` on."""
    out = df.where((F.col("year") < year) | ((F.col("year") == year) & (F.col("week") < week)))
    return out if since is None else out.where(F.col("year") >= since)


def slate_filter(df: DataFrame, position: str = "ALL", text: str = "", hide_second: bool = False,
                 hide_third: bool = False, hide_locked: bool = False) -> DataFrame:
    """Slate rows: position, name contains, depth strings, locks; unknown depth is never hidden."""
    depth = F.coalesce(F.col("string_rank"), F.lit(0))
    if position != "ALL":
        df = df.where(F.col("position") == position)
    if text:
        df = df.where(F.contains(F.lower("name"), F.lit(text.lower())))
    if hide_second:
        df = df.where(depth != 2)
    if hide_third:
        df = df.where(depth < 3)
    return df.where(~F.col("locked")) if hide_locked else df


def regular_games(schedule: DataFrame, need_boxscore: bool = False) -> DataFrame:
    """Numeric weeks up to 18, no BYE rows, optionally only games with a box score."""
    week = F.col("week").cast("string").try_cast("int")
    out = schedule.where((week <= 18) & (F.upper("team_1") != "BYE") & (F.upper("team_2") != "BYE")).withColumn("week", week)
    return out.where(F.col("boxscore_url").isNotNull() & (F.col("boxscore_url") != "")) if need_boxscore else out


def scrimmage_plays(pbp: DataFrame) -> DataFrame:
    return pbp.where((F.col("season_type") == "REG") & F.col("play_type").isin("pass", "run")
                     & (F.coalesce("two_point_attempt", F.lit(0)) == 0) & (F.coalesce("qb_kneel", F.lit(0)) == 0))


def threshold(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    if low is not None:
        df = df.where(F.col(column) >= low)
    return df if high is None else df.where(F.col(column) <= high)


def locked_teams(schedule: DataFrame, now: Column) -> DataFrame:
    return schedule.where(F.col("kickoff") <= now).select("year", "week", "team").distinct()
