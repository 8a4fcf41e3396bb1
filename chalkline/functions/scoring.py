"""Fantasy points, composite stats and the category -> stat maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.values import as_col, half_up, zero_if_null

# Fixed values: (stat column, label, points per unit).
OFFENSE_RATES = [
    ("pass_yds", "Passing yards", 0.04), ("pass_td", "Passing TD", 4.0), ("pass_int", "Interception", -1.0),
    ("rush_yds", "Rushing yards", 0.1), ("rush_td", "Rushing TD", 6.0), ("rec", "Receptions", 1.0),
    ("rec_yds", "Receiving yards", 0.1), ("rec_td", "Receiving TD", 6.0), ("fumbles_lost", "Fumble lost", -1.0),
    ("kick_ret_td", "Kick return TD", 6.0), ("punt_ret_td", "Punt return TD", 6.0),
    ("fumbles_rec_td", "Fumble recovery TD", 6.0),
]
# Fixed values: (stat column, threshold, label), three points each.
OFFENSE_BONUSES = [
    ("pass_yds", 300, "300+ passing yards bonus"), ("rush_yds", 100, "100+ rushing yards bonus"),
    ("rec_yds", 100, "100+ receiving yards bonus"),
]
BONUS_POINTS = 3.0
DEFENSE_RATES = [
    ("sack", "Sack", 1.0), ("interception", "Interception", 2.0), ("fumble_rec", "Fumble recovery", 2.0),
    ("def_td", "Defensive TD", 6.0), ("special_teams_td", "Special teams TD", 6.0), ("safety", "Safety", 2.0),
]
# Fixed values: (most points allowed, points); more than the last tier costs four.
POINTS_ALLOWED_TIERS = [(0, 10.0), (6, 7.0), (13, 4.0), (20, 1.0), (27, 0.0), (34, -1.0)]
POINTS_ALLOWED_FLOOR = -4.0
# Prop category -> points per unit of its line.
IMPLIED_RATES = {
    "passing-yards": 0.04, "passing-tds": 4.0, "interceptions": -1.0, "rushing-yards": 0.1,
    "receiving-yards": 0.1, "receptions": 1.0, "rushing-and-receiving-yards": 0.1,
}
# Prop category -> contest stat field.
CATEGORY_FIELDS = {
    "passing-yards": "pass_yds", "rushing-yards": "rush_yds", "receiving-yards": "rec_yds", "receptions": "rec",
    "passing-tds": "pass_td", "completions": "pass_cmp", "interceptions": "pass_int", "pass-attempts": "pass_att",
    "rush-attempts": "rush_att", "passing-and-rushing-yards": "pass_rush_yds",
    "rushing-and-receiving-yards": "rush_rec_yds", "touchdowns": "any_td",
}
# Contest fields: single stats plus three sums (any_td counts passing touchdowns).
FIELD_PARTS = {
    **{f: [f] for f in ("pass_yds", "pass_td", "pass_cmp", "pass_att", "pass_int", "rush_yds", "rush_att",
                        "rush_td", "rec", "rec_yds", "rec_td", "rec_tgt")},
    "pass_rush_yds": ["pass_yds", "rush_yds"], "rush_rec_yds": ["rush_yds", "rec_yds"],
    "any_td": ["pass_td", "rush_td", "rec_td"],
}
# Bet grading: 'touchdowns' leaves passing touchdowns out.
GRADING_PARTS = {
    "passing-yards": ["pass_yds"], "passing-tds": ["pass_td"], "completions": ["pass_cmp"],
    "pass-attempts": ["pass_att"], "interceptions": ["pass_int"], "rushing-yards": ["rush_yds"],
    "rush-attempts": ["rush_att"], "receiving-yards": ["rec_yds"], "receptions": ["rec"],
    "rushing-and-receiving-yards": ["rush_yds", "rec_yds"], "passing-and-rushing-yards": ["pass_yds", "rush_yds"],
    "touchdowns": ["rush_td", "rec_td", "kick_ret_td", "punt_ret_td", "fumbles_rec_td"],
}
# Low-line study: single-play 'longest' markets are read off the yardage column.
LOW_LINE_PARTS = {
    "receiving-yards": ["rec_yds"], "longest-reception": ["rec_yds"], "receptions": ["rec"],
    "rushing-yards": ["rush_yds"], "longest-rush": ["rush_yds"], "rush-attempts": ["rush_att"],
    "rushing-and-receiving-yards": ["rush_yds", "rec_yds"], "completions": ["pass_cmp"],
    "pass-attempts": ["pass_att"], "passing-yards": ["pass_yds"],
}


def null_safe_sum(columns: list[str]) -> Column:
    total = zero_if_null(columns[0])
    for c in columns[1:]:
        total = total + zero_if_null(c)
    return total


def offense_points(digits: int = 2) -> Column:
    total = F.lit(0.0)
    for stat, _, rate in OFFENSE_RATES:
        total = total + zero_if_null(stat) * F.lit(rate)
    for stat, threshold, _ in OFFENSE_BONUSES:
        total = total + F.when(zero_if_null(stat) >= threshold, F.lit(BONUS_POINTS)).otherwise(F.lit(0.0))
    return half_up(total, digits)


def points_allowed_bonus(allowed: Column | str) -> Column:
    a = as_col(allowed)
    out = F
    for most, points in POINTS_ALLOWED_TIERS:
        out = out.when(a <= most, F.lit(points))
    return F.when(a.isNotNull(), out.otherwise(F.lit(POINTS_ALLOWED_FLOOR)))


def defense_points(allowed: Column | str = "points_allowed") -> Column:
    total = F.lit(0.0)
    for stat, _, rate in DEFENSE_RATES:
        total = total + zero_if_null(stat) * F.lit(rate)
    return half_up(total + points_allowed_bonus(allowed), 2)


def counted_points(reported: Column | str = "dk_pts_reported", computed: Column | str = "dk_pts") -> Column:
    """The officially reported points, else the computed ones."""
    return F.coalesce(as_col(reported), as_col(computed))


def unpivot_stats(stats: DataFrame, parts: dict[str, list[str]], keys: list[str], name: str = "category",
                  value: str = "value") -> DataFrame:
    """One row per (key, category) with the category's null-safe stat sum; joins on category need no UDF."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), null_safe_sum(cols).cast("double").alias(value))
                      for c, cols in parts.items()])
    return stats.select(*keys, F.inline(pairs))


def stat_struct(parts: dict[str, list[str]]) -> Column:
    """The stat columns that `parts` names, as one struct."""
    return F.struct(*dict.fromkeys(c for cols in parts.values() for c in cols))


def stat_of(parts: dict[str, list[str]], category: Column | str, stats: str) -> Column:
    """The null-safe stat sum of a row's category, read off the struct column `stats` (`stat_struct`); NULL without a struct or for other categories.

    A lookup of one wide row per key: the unpivoted form has a row per category, and a broadcast of it passes many times the table through the driver."""
    out = F
    for c, cols in parts.items():
        out = out.when(as_col(category) == c, null_safe_sum([f"{stats}.{x}" for x in cols]).cast("double"))
    return F.when(F.col(stats).isNotNull(), out)


def value_per_thousand(points: Column | str, salary: Column | str) -> Column:
    s = as_col(salary).cast("double")
    return F.when(s > 0, half_up(as_col(points) / (s / 1000.0), 2))
