"""Export catalogue: which tables and reports can be downloaded, with their keys, order and scopes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.sources.tables import export_view


@dataclass(frozen=True)
class Export:
    """Key columns put first, sort order, and whether the dataset can be cut to a season or a week."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    by_year: bool = True
    by_week: bool = True


EXPORTS = {
    "slate": Export(("year", "week"), ("year", "week", "position", "name")),
    "salaries": Export(("year", "week"), ("year", "week", "name_key")),
    "player_stats": Export(("year", "week", "player_id"), ("year", "week", "player_id")),
    "season_stats": Export(("year", "player_id"), ("year", "player_id"), by_week=False),
    "career": Export(("player_id",), ("player_id",), False, False),
    "usage": Export(("year", "week"), ("year", "week", "name_key", "team")),
    "usage_season": Export(("year",), ("year", "name_key", "team"), by_week=False),
    "points_against": Export(("year", "position", "team"), ("year", "position", "team"), by_week=False),
    "team_points": Export(("year", "week", "team"), ("year", "week", "team")),
    "defense": Export(("year", "week", "team"), ("year", "week", "team")),
    "schedule": Export(("year", "week", "team"), ("year", "week", "team")),
    "weather": Export(("year", "week"), ("year", "week", "home_team")),
    "game_info": Export(("year", "week"), ("year", "week", "team_home")),
    "depth_charts": Export(("team",), ("team", "pos", "string_rank"), False, False),
    "injuries": Export(("team",), ("team", "name_key"), False, False),
    "implied_team_points": Export(("year", "week", "team"), ("year", "week", "team")),
    "implied_points": Export(("year", "week"), ("year", "week", "name_key")),
    "best_matchups": Export(("year", "week"), ("position", "name_key")),
    "lineups": Export(("year", "week", "submitter"), ("year", "week", "submitter")),
    "props": Export(("year", "week"), ("year", "week", "prop_id")),
    "picks": Export(("year", "week", "submitter"), ("year", "week", "submitter", "prop_id")),
    "standings": Export(("year", "week", "submitter"), ("year", "week", "submitter", "contest")),
}


def export_dataset(name: str, df: DataFrame, year: int | None = None, week: int | None = None, ordered: bool = False) -> DataFrame:
    """One dataset of the catalogue with its keys first, cut to a season or week where that makes sense."""
    spec = EXPORTS[name]
    if year is not None and not spec.by_year or week is not None and not spec.by_week:
        raise ValueError(f"{name} cannot be cut to year={year}, week={week}")
    if year is not None:
        df = df.where(F.col("year") == year)
    if week is not None:
        df = df.where(F.col("week") == week)
    out = export_view(df, {k: None for k in spec.keys if k in df.columns} or {spec.keys[0]: None})
    return out.orderBy(*[c for c in spec.order if c in out.columns]) if ordered else out
