"""Downloads (SNK15): every dataset of the catalogue in every scope it has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.catalog import q_functions, q_reports  # noqa: F401  their oracles are used here
from chalkline.catalog.registry import ORACLES, query
from chalkline.plans.downloads import download, scopes

# What each download must hold, one row per row of the dataset, for all seasons.
_ROWS = {
    "slate": "SELECT year, week, cid AS k FROM slate", "salaries": "SELECT year, week, cid AS k FROM slate", "player_stats": "SELECT year, week, player_id AS k FROM player_stats",
    "season_stats": "SELECT DISTINCT year, NULL AS week, player_id AS k FROM player_stats", "career": "SELECT DISTINCT NULL AS year, NULL AS week, player_id AS k FROM player_stats",
    "points_against": "SELECT DISTINCT year, NULL AS week, concat(position, opponent) AS k FROM player_stats WHERE position IN ('QB', 'RB', 'WR', 'TE')",
    "team_points": "SELECT year, week, team AS k FROM team_points", "defense": "SELECT year, week, team AS k FROM defense", "schedule": "SELECT year, week, team AS k FROM schedule",
    "weather": "SELECT year, week, home_team AS k FROM weather", "game_info": "SELECT year, week, team_home AS k FROM game_info",
    "injuries": "SELECT NULL AS year, NULL AS week, src_pos AS k FROM injuries_depth", "implied_team_points": "SELECT year, week, team AS k FROM game_odds",
    "implied_points": f"SELECT year, week, name_key AS k FROM ({ORACLES['fn30_implied_points']}) r", "lineups": "SELECT year, week, cid AS k FROM slots", "props": "SELECT year, week, prop_id AS k FROM prop_bets",
    "picks": "SELECT year, week, concat(submitter, prop_id) AS k FROM prop_picks", "standings": "SELECT DISTINCT year, week, submitter AS k FROM prop_picks",
    "depth_charts": "SELECT NULL AS year, NULL AS week, name_key AS k FROM depth WHERE pos IN ('QB', 'RB', 'LWR', 'RWR', 'SWR', 'TE')",
    "usage": f"SELECT year, week, name_key AS k FROM ({ORACLES['rp4_usage_week']}) r",
    "usage_season": f"SELECT year, NULL AS week, name_key AS k FROM ({ORACLES['rp4_usage_season']}) r",
    "best_matchups": f"SELECT 2000 AS year, 9 AS week, 1 AS k FROM ({ORACLES['rp8_best_matchups']}) r",
}
_SCOPES = {"all": ("", {}), "season": ("WHERE year = 1999", {"year": 1999}), "week": ("WHERE year = 2000 AND week = 9", {"year": 2000, "week": 9})}


def _downloads(name: str) -> None:
    parts = [f"SELECT '{scope}' AS scope, count(*) AS n FROM ({_ROWS[name]}) x {_SCOPES[scope][0]}" for scope in scopes(name)]

    @query(f"snk15_{name}", " UNION ALL ".join(parts))
    def _(t):
        counts = [download(name, t, **_SCOPES[scope][1]).agg(F.count(F.lit(1)).alias("n")).select(F.lit(scope).alias("scope"), "n") for scope in scopes(name)]
        return reduce(DataFrame.unionByName, counts)


for _name in _ROWS:
    _downloads(_name)
