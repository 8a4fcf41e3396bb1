"""Sorting, top-k and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.operators.ordered import attach, first_rows

POSITION_ORDER = ["QB", "RB", "WR", "TE", "DST"]


def position_rank(position: Column | str = "position", order: Sequence[str] = tuple(POSITION_ORDER)) -> Column:
    p = F.col(position) if isinstance(position, str) else position
    out = F
    for i, name in enumerate(order):
        out = out.when(p == name, F.lit(i))
    return out.otherwise(F.lit(len(order)))


def order_by_position(df: DataFrame, value: str, tiebreak: Sequence[str] = ("name",)) -> DataFrame:
    return df.orderBy(position_rank(), F.col(value).desc_nulls_last(), *tiebreak)


def order_nulls_last(df: DataFrame, value: str, tiebreak: Sequence[str] = (), absolute: bool = False) -> DataFrame:
    c = F.abs(F.col(value)) if absolute else F.col(value)
    return df.orderBy(c.desc_nulls_last(), *tiebreak)


def top_n_per_category(props: DataFrame, n: int, category: str = "category", position: str = "src_pos",
                       projection: str = "site_projection", rank_by_projection: Sequence[str] = ("touchdowns",)) -> DataFrame:
    """First n props per category in source order; the listed categories by projection instead. Categories keep the
    order of their first appearance in `category_pos`."""
    by_projection = F.when(F.col(category).isin(list(rank_by_projection)), F.col(projection))
    top = first_rows(props, [category], [by_projection.desc_nulls_last(), F.col(position)], n, rank_col="category_rank")
    first_seen = props.groupBy(category).agg(F.min(position).alias("category_pos"))
    return attach(top, first_seen, [category])


def latest(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(1)


def head(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Global top-n report (TakeOrderedAndProject: n rows per task, then n in all)."""
    return df.orderBy(*order).limit(n)


def stack_tables(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def all_values(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    return a.select(*columns).union(b.select(*columns)).distinct()


def missing_from(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of `a` that `b` does not have."""
    return a.select(*columns).distinct().join(b.select(*columns), list(columns), "left_anti")


def overlap_count(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    both = a.select(*columns).distinct().join(b.select(*columns), list(columns), "left_semi")
    return both.agg(F.count(F.lit(1)).alias("overlap"))


def add_byes(schedule: DataFrame, full_week: int = 16) -> DataFrame:
    """A BYE row for every team of the season that has no game in a week with fewer than `full_week` games.

    Weeks carry the season's team list (one short array per season) and subtract the teams that play.
    """
    teams = schedule.groupBy("year").agg(F.collect_set("team").alias("__all"))
    weeks = schedule.groupBy("year", "week").agg(F.collect_set("team").alias("__in"), F.count(F.lit(1)).alias("__rows"))
    short = weeks.where(F.col("__rows") < 2 * full_week)
    return short.join(teams, "year").select(
        "year", "week", F.explode(F.array_except("__all", "__in")).alias("team"), F.lit("BYE").alias("opponent"))


def distinct_on(df: DataFrame, columns: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return first_rows(df, columns, order)
