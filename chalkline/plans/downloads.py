"""Downloads: every dataset of the export catalogue wired to the report that makes it.

A download names a season, a week or neither; the scope cuts the report's inputs, so a report of one week reads one week. Reports that look back over
earlier games take those inputs whole. Plans are made when they are asked for, and checked against the catalogue's keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.operators import aggregates as A
from chalkline.plans import contest as C, reports as R
from chalkline.plans.exports import EXPORTS, export_dataset


class Inputs:
    """The tables of `source` (by attribute), cut to a season and week where they have them; `whole` leaves them as they are."""

    def __init__(self, source, year: int | None = None, week: int | None = None):
        self.source, self.year, self.week = source, year, week

    @property
    def whole(self) -> Inputs:
        return Inputs(self.source)

    def __getattr__(self, name: str) -> DataFrame:
        df = getattr(self.source, name)
        for column, value in (("year", self.year), ("week", self.week)):
            if value is not None and column in df.columns:
                df = df.where(F.col(column) == value)
        return df


@dataclass(frozen=True)
class Download:
    """How a dataset is built, and whether it needs a week (reports that look from one week back)."""

    build: Callable[[Inputs], DataFrame]
    one_week: bool = False


def _lines(i: Inputs) -> DataFrame:
    return i.prop_lines.select("year", "week", "name_key", "category", "line")


def _matchups(i: Inputs) -> DataFrame:
    rows = R.best_matchups(i.slate, i.whole.player_stats, i.depth, i.schedule, i.game_odds, _lines(i), i.year, i.week)
    return rows.withColumns({"year": F.lit(i.year), "week": F.lit(i.week)})


def _points_against(i: Inputs) -> DataFrame:
    allowed = A.allowed_by_position(i.player_stats)
    return allowed.groupBy("year", "position", "team").agg(F.count(F.lit(1)).alias("games"), F.round(F.avg("pts_allowed"), 2).alias("pts_per_game"))


def _props(i: Inputs) -> DataFrame:
    teams = [i.slate.select("year", "week", "name_key", "team")]
    return C.score_props(i.prop_bets.drop("cid", "t"), i.player_stats, teams, i.team_points)


DOWNLOADS = {
    "slate": Download(lambda i: R.implied_points_table(i.slate, _lines(i), i.depth)),
    "salaries": Download(lambda i: i.slate.select("year", "week", "name_key", "name", "position", "team", "salary")),
    "player_stats": Download(lambda i: i.player_stats),
    "season_stats": Download(lambda i: A.season_totals(i.player_stats, ("year", "player_id"))),
    "career": Download(lambda i: A.career_totals(i.player_stats)),
    "usage": Download(lambda i: R.usage_rows(i.player_stats, i.usage, ("year", "week"))),
    "usage_season": Download(lambda i: R.usage_rows(i.player_stats, i.usage)),
    "points_against": Download(_points_against),
    "team_points": Download(lambda i: i.team_points),
    "defense": Download(lambda i: i.defense),
    "schedule": Download(lambda i: i.schedule),
    "weather": Download(lambda i: i.weather),
    "game_info": Download(lambda i: i.game_info),
    "depth_charts": Download(lambda i: R.depth_charts(i.depth, i.injuries_depth)),
    "injuries": Download(lambda i: i.injuries_depth),
    "implied_team_points": Download(lambda i: R.implied_team_points(i.game_odds)),
    "implied_points": Download(lambda i: R.implied_points(_lines(i))),
    "best_matchups": Download(_matchups, one_week=True),
    "lineups": Download(lambda i: i.slots),
    "props": Download(_props),
    "picks": Download(lambda i: C.graded_picks(i.prop_picks.drop("cid"), _props(i))),
    "standings": Download(lambda i: C.pick_totals(C.graded_picks(i.prop_picks.drop("cid"), _props(i))).withColumn("contest", F.lit("props"))),
}


def scopes(name: str) -> list[str]:
    """The scopes a dataset can be asked for."""
    spec, kind = EXPORTS[name], DOWNLOADS[name]
    if kind.one_week:
        return ["week"]
    return ["all", *["season"] * spec.by_year, *["week"] * (spec.by_year and spec.by_week)]


def download(name: str, source, year: int | None = None, week: int | None = None) -> DataFrame:
    """The dataset `name` from the tables of `source`, its keys first. A scope it does not have, or a report without its keys, is an error."""
    if name not in DOWNLOADS:
        raise KeyError(f"no dataset {name}")
    scope = "all" if year is None and week is None else "season" if week is None else "week"
    if scope not in scopes(name) or week is not None and year is None:
        raise ValueError(f"{name} cannot be had for year={year}, week={week}; scopes: {', '.join(scopes(name))}")
    rows = DOWNLOADS[name].build(Inputs(source, year, week))
    missing = [k for k in EXPORTS[name].keys if k not in rows.columns]
    if missing:
        raise ValueError(f"the report of {name} lacks {', '.join(missing)}")
    return export_dataset(name, rows)
