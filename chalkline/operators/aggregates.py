"""Aggregations. Every one is a plain groupBy, combined on the map side before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from chalkline.functions.scoring import counted_points
from chalkline.functions.values import half_up, zero_if_null
from chalkline.operators.ordered import attach, split_median

Cols = Sequence[str]
SEASON_SUMS = ["pass_yds", "pass_td", "rush_yds", "rush_td", "rec", "rec_yds", "rec_td"]


def season_totals(stats: DataFrame, keys: Cols = ("year", "player_id", "position", "team"), sums: Cols = tuple(SEASON_SUMS)
                  ) -> DataFrame:
    points = counted_points()
    return stats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("games"), *[F.sum(zero_if_null(c)).alias(c) for c in sums],
        half_up(F.sum(points), 2).alias("total_pts"), half_up(F.avg(points), 2).alias("avg_pts"))


def career_totals(stats: DataFrame, keys: Cols = ("player_id",), sums: Cols = tuple(SEASON_SUMS)) -> DataFrame:
    return season_totals(stats, keys, sums)


def team_points_season(points: DataFrame, keys: Cols = ("year", "team")) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("games"), F.sum("points_scored").alias("points_scored"),
        F.sum("points_allowed").alias("points_allowed"),
        half_up(F.avg("points_scored"), 1).alias("avg_scored"), half_up(F.avg("points_allowed"), 1).alias("avg_allowed"))


def allowed_by_position(stats: DataFrame) -> DataFrame:
    """Fantasy points given up per (season, week, defence, position)."""
    return (stats.where(F.col("position").isin("QB", "RB", "WR", "TE"))
            .groupBy("year", "week", F.col("opponent").alias("team"), "position")
            .agg(F.sum(counted_points()).alias("pts_allowed")))


def team_totals(stats: DataFrame, keys: Cols = ("year", "team")) -> DataFrame:
    return stats.groupBy(*keys).agg(
        F.sum(zero_if_null("rec_tgt")).alias("team_targets"),
        F.sum(zero_if_null("rush_att") + zero_if_null("rec")).alias("team_touches"))


def current_week(schedule: DataFrame, cutoff: Column) -> DataFrame:
    """Earliest (year, week) whose last kickoff is at or after the cutoff."""
    weeks = schedule.groupBy("year", "week").agg(F.max("kickoff").alias("last_kickoff"))
    return weeks.where(F.col("last_kickoff") >= cutoff).orderBy("year", "week").limit(1).select("year", "week")


def available_weeks(df: DataFrame, extra: Cols = ()) -> DataFrame:
    return df.select("year", "week", *extra).distinct()


def team_context(stats: DataFrame) -> DataFrame:
    """Per team: mean over games of pass attempts and of players with a catch."""
    games = stats.groupBy("team", "year", "week").agg(
        F.sum("pass_att").alias("__pa"), F.count_if(F.col("rec") > 0).alias("__catch"))
    return games.groupBy("team").agg(half_up(F.avg("__pa"), 1).alias("team_pass_att_pg"),
                                     half_up(F.avg("__catch"), 1).alias("players_with_catch_pg"))


def pbp_counts(plays: DataFrame, keys: Cols = ("gsis_id", "week")) -> DataFrame:
    """Red-zone, inside-10/5 and third-down targets and carries; one pass over the plays, two roles per play."""
    roles = F.array(
        F.struct(F.col("receiver_player_id").alias("gsis_id"), F.lit("targets").alias("role")),
        F.struct(F.when(F.col("play_type") == "run", F.col("rusher_player_id")).alias("gsis_id"),
                 F.lit("carries").alias("role")))
    rest = [k for k in keys if k != "gsis_id"]
    rows = plays.select(*rest, "yardline_100", "down", F.inline(roles)).where(F.col("gsis_id").isNotNull())
    out = []
    for role in ("targets", "carries"):
        mine = F.col("role") == role
        out += [F.count_if(mine & (F.col("yardline_100") <= y)).alias(f"{p}_{role}")
                for p, y in (("rz", 20), ("i10", 10), ("i5", 5))]
    out.append(F.count_if((F.col("role") == "targets") & (F.col("down") == 3)).alias("third_down_targets"))
    return rows.groupBy(*keys).agg(*out)


def fold_duplicates(df: DataFrame, keys: Cols, position: str) -> DataFrame:
    """One row per key (NULL keys kept): max of numbers, first non-null of the rest in source order."""
    aggs = []
    for f in df.schema.fields:
        if f.name in keys or f.name == position:
            continue
        c = F.col(f.name)
        numeric = isinstance(f.dataType, NumericType)
        aggs.append((F.max(c) if numeric else F.min_by(c, F.when(c.isNotNull(), F.col(position)))).alias(f.name))
    return df.groupBy(*keys).agg(*aggs)


def grouped_stats(df: DataFrame, keys: Cols, value: str, distinct: str) -> DataFrame:
    """Row count, mean, exact median and distinct count per group; the median is found without ordering a group in one task."""
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), half_up(F.avg(value), 4).alias("mean_value"), F.countDistinct(distinct).alias("n_distinct"))
    medians = split_median(df, keys, value, "__median")
    return attach(stats, medians, keys).withColumn("median_value", half_up("__median", 4)).select(
        *keys, "n", "mean_value", "median_value", "n_distinct")


def joined_distinct(df: DataFrame, keys: Cols, column: str, out: str, sep: str = ",") -> DataFrame:
    """Sorted distinct values joined to text; the state holds distinct values, not rows."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), sep).alias(out))


def history_sd(stats: DataFrame, keys: Cols, stat: str, min_games: int = 6) -> DataFrame:
    agg = stats.groupBy(*keys).agg(F.count(stat).alias("history_games"), F.stddev_samp(stat).alias("history_sd"))
    return agg.withColumn("history_sd", F.when(F.col("history_games") >= min_games, F.col("history_sd")))


CALIBRATION_BINS = (0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 1.0)


def calibration(df: DataFrame, y: str, p: str, bins: Sequence[float] = CALIBRATION_BINS) -> DataFrame:
    """Right-closed probability bins with size, mean prediction and mean outcome."""
    bucket = F
    for lo, hi in zip(bins, bins[1:]):
        bucket = bucket.when((F.col(p) > lo) & (F.col(p) <= hi), F.lit(f"({lo:g}, {hi:g}]"))
    return (df.withColumn("bucket", bucket).where(F.col("bucket").isNotNull()).groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("n"), half_up(F.avg(p), 3).alias("predicted"), half_up(F.avg(y), 3).alias("actual")))


def log_loss_of(y: Column, p: Column, clip: float = 1e-4) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1.0 - clip))
    return -F.avg(y * F.log(q) + (1.0 - y) * F.log(1.0 - q))


def log_loss(df: DataFrame, y: str, p: str, keys: Cols = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), log_loss_of(F.col(y), F.col(p)).alias("log_loss"))


def majority(df: DataFrame, columns: Cols, order: Cols | None = None) -> DataFrame:
    """Most frequent combination; ties go to the smallest in `order`."""
    votes = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("votes"))
    return votes.orderBy(F.desc("votes"), *(order or columns)).limit(1)


def roi_summary(graded: DataFrame, keys: Cols = ("source", "book")) -> DataFrame:
    settled = graded.where(F.col("result").isin("win", "loss", "push"))
    agg = settled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bets"), F.count_if(F.col("result") == "win").alias("wins"),
        F.sum("profit").alias("units"), F.avg("ev_pct").alias("avg_claimed_ev"),
        F.avg("clv_pct").alias("avg_clv_pct"), F.avg("ev_at_close").alias("avg_ev_at_close"))
    roi = half_up(F.col("units") / F.col("bets") * 100.0, 2)
    rounded = {c: half_up(c, 2) for c in ("units", "avg_claimed_ev", "avg_clv_pct", "avg_ev_at_close")}
    return agg.withColumn("roi_pct", roi).withColumns(rounded)


def lineup_total(rows: DataFrame, keys: Cols = ("year", "week", "submitter"), n: int = 9) -> DataFrame:
    """Sum of points per lineup, NULL unless exactly n players have a result."""
    agg = rows.groupBy(*keys).agg(F.count("actual_pts").alias("matched"), F.sum("actual_pts").alias("__sum"))
    return agg.withColumn("score", F.when(F.col("matched") == n, half_up("__sum", 2))).drop("__sum")


def ordered_list(df: DataFrame, keys: Cols, order: Cols, column: str, out: str) -> DataFrame:
    """Values in order as one array per key; meant for keys whose rows are bounded (one per player and week)."""
    listed = F.sort_array(F.collect_list(F.struct(*order, column)))
    return df.groupBy(*keys).agg(F.transform(listed, lambda s: s[column]).alias(out))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def coverage(df: DataFrame, value: str, source: str, keys: Cols = ("year", "week")) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("with_value"),
        F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"))
