"""Bet log: logging, grading, closing prices and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions import odds as O
from chalkline.functions.clock import parse_mixed_date
from chalkline.functions.names import normalize_name
from chalkline.functions.scoring import GRADING_PARTS, stat_of, stat_struct
from chalkline.functions.values import half_up
from chalkline.operators.aggregates import roi_summary
from chalkline.operators.filters import is_available
from chalkline.operators.joins import match_player
from chalkline.operators.ordered import attach, first_rows
from chalkline.operators.sets import stack_tables
from chalkline.plans.contest import one_per_name
from chalkline.sources.derived import settled

BET_KEY = ["source", "book", "player_name", "category", "side", "line", "odds"]
LOG_COLUMNS = ["logged_at", "source", "year", "week", "book", "player_name", "team", "category", "side", "line", "odds",
               "model_prob", "ev_pct", "confidence"]


def to_log_rows(found: DataFrame, source: str) -> DataFrame:
    """Finder output mapped onto the log columns with the defaults of an anytime-touchdown bet."""
    have = set(found.columns)
    pick = lambda c, default: F.col(c) if c in have else default
    side = pick("side", F.lit("Over"))
    prob = F.col("model_prob") if "model_prob" in have else pick("fair_prob", F.lit(None).cast("double"))
    return found.select(
        F.lit(source).alias("source"), F.lower("book").alias("book"), "player_name",
        pick("team", F.lit(None).cast("string")).alias("team"), pick("category", F.lit("touchdowns")).alias("category"),
        F.when(side == "Yes", F.lit("Over")).otherwise(side).alias("side"), pick("line", F.lit(0.5)).alias("line"), "odds",
        prob.alias("model_prob"), "ev_pct", pick("confidence", F.lit("")).alias("confidence"))


def log_bets(found: DataFrame, log: DataFrame, source: str, year: int, week: int, logged_at: Column,
             min_ev_pct: float = 0.0) -> DataFrame:
    """Log plus the new bets whose key is absent; what is already logged is never changed."""
    rows = to_log_rows(found.where(F.col("ev_pct") >= min_ev_pct), source).withColumns(
        {"logged_at": logged_at, "year": F.lit(year), "week": F.lit(week)})
    fresh = rows.join(log.select(*BET_KEY), BET_KEY, "left_anti")
    fresh = first_rows(fresh, BET_KEY, [F.desc("ev_pct"), "team"])
    return stack_tables(log, fresh.select(*LOG_COLUMNS))


def grade(bets: DataFrame, stats: DataFrame, final_teams: DataFrame) -> DataFrame:
    """win / loss / push / void / pending / ungradeable with the actual value and profit in units.

    Of several `stats` rows of a name in a week the first by `one_per_name` counts; `final_teams` lists (year, week, team) with a result."""
    b = bets.withColumn("name_key", normalize_name("player_name"))
    week = ["year", "week"]
    stats = one_per_name(stats)
    exact = stats.select(*week, "name_key", stat_struct(GRADING_PARTS).alias("__stats"))
    # Last name + team takes the first player of the week in key order when the exact key is absent that week.
    by_last = stats.select(*week, F.element_at(F.split("name_key", " "), -1).alias("__last"), "team", "name_key")
    by_last = by_last.groupBy(*week, "__last", "team").agg(F.min("name_key").alias("__alt"))
    present = stats.select(*week, "name_key").distinct().withColumn("__here", F.lit(True))
    rows = attach(b, present, [*week, "name_key"]).withColumn("__last", F.element_at(F.split("name_key", " "), -1))
    rows = rows.join(by_last, [*week, "__last", "team"], "left")
    rows = rows.withColumn("name_key", F.when(F.col("__here"), F.col("name_key")).otherwise(F.col("__alt")))
    rows = attach(rows, exact, [*week, "name_key"]).withColumn("actual", stat_of(GRADING_PARTS, "category", "__stats")).drop("__stats")
    rows = attach(rows, final_teams.select(*week, "team").distinct().withColumn("__final", F.lit(True)), [*week, "team"])
    gradeable = F.col("category").isin(list(GRADING_PARTS))
    won = F.when(F.col("side") == "Over", F.col("actual") > F.col("line")).otherwise(F.col("actual") < F.col("line"))
    result = (F.when(~gradeable, F.lit("ungradeable"))
              .when(F.col("name_key").isNull() & F.col("__final"), F.lit("void"))
              .when(F.col("actual").isNull(), F.lit("pending"))
              .when(F.col("actual") == F.col("line"), F.lit("push"))
              .when(won, F.lit("win")).otherwise(F.lit("loss")))
    rows = rows.withColumn("result", result)
    profit = (F.when(F.col("result") == "win", half_up(O.decimal_odds("odds") - 1.0, 4))
              .when(F.col("result") == "loss", F.lit(-1.0)).otherwise(F.lit(0.0)))
    return rows.withColumn("actual", F.when(gradeable, F.col("actual"))).withColumn("profit", profit).drop(
        "name_key", "__here", "__last", "__alt", "__final")


def closing_snapshots(archive: DataFrame, kickoffs: DataFrame) -> DataFrame:
    """Quotes of the week's last scrape strictly before each team's kickoff; a market taken down before that scrape has
    no close.

    A week has few scrapes (distinct times), so they are found first and joined to the kickoffs; quotes then meet the one
    time of their team by an equi-join."""
    scrapes = archive.select("year", "week", F.col("scraped_at").alias("__at")).distinct()
    games = kickoffs.select("year", "week", "team", "kickoff")
    last = games.join(scrapes, ["year", "week"]).where(F.col("__at") < F.col("kickoff"))
    last = last.groupBy("year", "week", "team", "kickoff").agg(F.max("__at").alias("scraped_at"))
    return archive.join(last, ["year", "week", "team", "scraped_at"])


def closing(bets: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Closing price at the same book, line and side, closing-line value, and fair price from two or more books."""
    prop = ["year", "week", "name_key", "category", "line"]
    # Used twice. Settled, so that names are normalised for closing rows alone: a key's NULL check would else go below the choice of the last scrape.
    close = settled(snapshots.where(is_available()).withColumn("name_key", normalize_name("player_name")).withColumn(
        "book", F.lower("book")).select(*prop, "book", "over_odds", "under_odds"), "closing")
    over = F.struct("over_odds", "under_odds")
    at_book = close.groupBy(*prop, "book").agg(
        F.min(F.when(F.col("over_odds").isNotNull(), over)).alias("__o"),
        F.min(F.when(F.col("under_odds").isNotNull(), F.struct("under_odds", "over_odds"))).alias("__u"))
    usable = F.col("over_odds").isNotNull() & F.col("under_odds").isNotNull() & ~F.col("book").isin(O.PICKEM_BOOKS)
    fair = close.where(usable).groupBy(*prop).agg(
        F.median(O.novig_over("over_odds", "under_odds")).alias("__p"), F.count(F.lit(1)).alias("__n"))
    b = bets.withColumn("name_key", normalize_name("player_name"))
    # Merged: the sizes of compressed files tell too little of what a broadcast would hold.
    rows = attach(attach(b, at_book.hint("merge"), [*prop, "book"]), fair.where(F.col("__n") >= 2).hint("merge"), prop)
    is_over = F.col("side") == "Over"
    odds = F.when(is_over, F.col("__o.over_odds")).otherwise(F.col("__u.under_odds"))
    p = F.when(is_over, F.col("__p")).otherwise(1.0 - F.col("__p"))
    rows = rows.withColumn("close_odds", odds)
    return rows.withColumns({
        "clv_pct": half_up((O.decimal_odds("odds") / O.decimal_odds("close_odds") - 1.0) * 100.0, 2),
        "close_fair_prob": half_up(p, 4),
        "ev_at_close": half_up((p * O.decimal_odds("odds") - 1.0) * 100.0, 2)}).drop("name_key", "__o", "__u", "__p", "__n")


def grade_summary(graded: DataFrame, keys: Sequence[str] = ("source", "book")) -> DataFrame:
    return roi_summary(graded, keys)


def current_week_from_dates(schedule: DataFrame, today: Column) -> DataFrame:
    """Earliest (year, week) whose last game date (parsed, any spelling) is on or after the latest Tuesday."""
    tuesday = F.date_sub(today, F.pmod(F.weekday(today) - 1, F.lit(7)).cast("int"))
    weeks = schedule.groupBy("year", "week").agg(F.max(parse_mixed_date("date")).alias("__d"))
    return weeks.where(F.col("__d") >= tuesday).orderBy("year", "week").limit(1).select("year", "week")


__all__ = ["BET_KEY", "LOG_COLUMNS", "closing", "closing_snapshots", "current_week_from_dates", "grade",
           "grade_summary", "log_bets", "match_player", "to_log_rows"]
