"""Explicit schemas (DDL text) and unique keys of the data model; nothing is inferred on read."""

QUOTES = ("category string, player_name string, team string, book string, line double, over_odds double, "
          "under_odds double, site_projection double, available boolean")
PLAYER_STATS = (
    "player_id string, name string, name_key string, year int, week int, game_date string, team string, opponent string, "
    "home_away string, position string, dk_pts double, dk_pts_reported double, pass_cmp int, pass_att int, pass_yds int, "
    "pass_td int, pass_int int, rush_att int, rush_yds int, rush_td int, rec_tgt int, rec int, rec_yds int, rec_td int, "
    "fumbles_lost int, kick_ret_td int, punt_ret_td int, fumbles_rec_td int, snap_pct double")
USAGE = (
    "year int, week int, player_id string, gsis_id string, name string, name_key string, team string, position string, "
    "offense_snaps int, offense_pct double, targets int, target_share double, air_yards double, air_yards_share double, "
    "adot double, wopr double, carries int, receptions int, rz_targets int, rz_carries int, i10_targets int, "
    "i10_carries int, i5_targets int, i5_carries int, third_down_targets int")
SCHEDULE = "year int, week int, team string, opponent string, home_away string, kickoff timestamp"
SCHEDULE_FILE = ("year int, week string, team_1 string, team_2 string, date string, time string, location string, "
                 "boxscore_url string")
GAME_ODDS = ("event_id string, kickoff timestamp, team string, opponent string, spread double, spread_odds string, "
             "over_under string, favorite string")
SALARIES = ("week int, year int, name string, name_key string, position string, team string, opponent string, "
            "dk_salary bigint, dk_pts_scored double, projected_pts double, ownership_pct double, source string")
TEAM_POINTS = ("year int, week int, team string, opponent string, home_away string, points_scored int, points_allowed int")
DEFENSE = ("year int, week int, team string, opponent string, points_allowed int, dk_pts double, sack int, "
           "interception int, fumble_rec int, forced_fumble int, def_td int, safety int, special_teams_td int")
POINTS_AGAINST = ("year int, position string, team string, games int, fantasy_pts double, dk_pts double, fd_pts double, "
                  "dk_pts_per_game double")
WEATHER = ("year int, week int, game_date string, status string, away_team string, home_team string, away_score int, "
           "home_score int, temp_f int, condition string, wind_mph int, wind_direction string")
LINEUPS = "week int, year int, submitter string, lineup_json string, total_salary int"
PROP_BETS = "prop_id string, year int, week int, player_name string, name_key string, stat_field string, line double"
PROP_PICKS = "year int, week int, submitter string, prop_id string, pick string"
DEPTH = "team string, pos string, string_rank int, player_name string, name_key string"
INJURIES = "player_name string, name_key string, team string, position string, status string"
LOADS = "source string, file_time timestamp, loaded_at timestamp, row_count bigint"

# Unique key per table, used by the upserts.
KEYS = {
    "player_stats": ["player_id", "year", "week"], "usage": ["year", "week", "name_key", "team"],
    "salaries": ["week", "year", "name_key", "source"], "defense": ["year", "week", "team"],
    "schedule": ["year", "week", "team"], "weather": ["year", "week", "away_team", "home_team"],
    "game_info": ["boxscore_url"], "points_against": ["year", "position", "team"],
    "team_points": ["year", "week", "team"], "lineups": ["week", "year", "submitter"],
    "prop_bets": ["year", "week", "name_key", "stat_field"], "prop_picks": ["year", "week", "submitter", "prop_id"],
    "depth_charts": ["team", "pos", "string_rank"], "game_odds": ["team"], "injuries": ["name_key", "team"],
    "market_props": ["category", "name_key"], "data_loads": ["source"],
}
