"""Player, team and schedule reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions import clock, conditions as C, scoring as S
from chalkline.functions.teams import normalize_team, roof_type
from chalkline.functions.values import half_up, ratio, to_int, zero_if_null
from chalkline.operators import aggregates as A
from chalkline.operators.filters import before_week, locked_teams
from chalkline.operators.joins import flag_teams, full_outer_fill, nearest_within, per_team
from chalkline.operators.ordered import attach, attach_totals, first_rows, minmax_fraction, rank_fraction, rank_in_group, shuffled, trailing_mean
from chalkline.operators.sets import position_rank

WEEK = ["year", "week"]
SKILL = ["QB", "RB", "WR", "TE"]


def implied_points(props: DataFrame, keys: Sequence[str] = ("year", "week", "name_key")) -> DataFrame:
    """Fantasy points implied by prop lines, with the categories used; the combined yardage prop only stands in when
    neither single one exists. `props`(keys, category, line)."""
    line = lambda c: F.max(F.when(F.col("category") == c, F.col("line")))
    wide = props.where(F.col("category").isin(list(S.IMPLIED_RATES)) & F.col("line").isNotNull()).groupBy(*keys).agg(
        *[line(c).alias(f"__{i}") for i, c in enumerate(S.IMPLIED_RATES)])
    names = list(S.IMPLIED_RATES)
    col = {c: F.col(f"__{i}") for i, c in enumerate(names)}
    single = col["rushing-yards"].isNotNull() | col["receiving-yards"].isNotNull()
    combined = "rushing-and-receiving-yards"
    used = {c: (F.when(~single, col[c]) if c == combined else col[c]) for c in names}
    total = F.lit(0.0)
    for c, rate in S.IMPLIED_RATES.items():
        total = total + F.coalesce(used[c] * F.lit(rate), F.lit(0.0))
    listed = F.concat_ws(",", *[F.when(used[c].isNotNull(), F.lit(c)) for c in names])
    return wide.select(*keys, half_up(total, 2).alias("implied_points"), listed.alias("categories_used"))


def implied_points_table(players: DataFrame, props: DataFrame, depth: DataFrame, comparison: DataFrame | None = None) -> DataFrame:
    """Slate players with implied points (NULL without props), value per $1000 and depth label. `comparison` (name_key, pts) adds another
    source's points beside them and the difference."""
    rows = attach(players, implied_points(props), [*WEEK, "name_key"])
    listed = depth.groupBy("name_key").agg(F.min("string_rank").alias("string_rank"))  # a player listed twice keeps the higher place
    rows = attach(rows, listed, ["name_key"])
    if comparison is not None:
        theirs = comparison.groupBy("name_key").agg(F.max("pts").alias("comparison_points"))
        rows = attach(rows, theirs, ["name_key"]).withColumn("comparison_diff", half_up(F.col("implied_points") - F.col("comparison_points"), 2))
    return rows.withColumn("value_per_1k", S.value_per_thousand("implied_points", "salary")).withColumn(
        "depth_label", C.depth_label("string_rank"))


def slate(players: DataFrame, schedule: DataFrame, depth: DataFrame, props: DataFrame, now: Column) -> DataFrame:
    """Slate rows with lock flag, Eastern game day (ordered by the day's first kickoff, unknown last) and labels."""
    games = schedule.select(*WEEK, "team", "kickoff")
    rows = attach(implied_points_table(players, props, depth), games, [*WEEK, "team"])
    day = F.coalesce(F.date_format(clock.eastern("kickoff"), "EEEE, MMM d"), F.lit("Date TBD"))
    rows = rows.withColumn("game_day", day).withColumn("locked", F.coalesce(F.col("kickoff") <= now, F.lit(False)))
    rows = attach_totals(rows, [*WEEK, "game_day"], day_start=F.min("kickoff"))
    return rows.withColumn("position_order", position_rank())


def history_week(salaries: DataFrame, stats: DataFrame) -> DataFrame:
    s = stats.select(*WEEK, "name_key", S.counted_points().alias("actual_pts"))
    return salaries.join(s, [*WEEK, "name_key"], "left")


def career(stats: DataFrame, salaries: DataFrame) -> DataFrame:
    """Career totals per player with salary coverage."""
    totals = A.career_totals(stats)
    sal = stats.select("player_id", *WEEK, "name_key").join(salaries.select(*WEEK, "name_key", "salary"), [*WEEK, "name_key"], "left")
    avg = sal.groupBy("player_id").agg(half_up(F.avg("salary"), 2).alias("avg_salary"), F.count("salary").alias("salaried_games"))
    return attach(totals, avg, ["player_id"])


USAGE_SUMS = ["air_yards", "rz_targets", "rz_carries", "i10_carries", "i5_carries", "third_down_targets"]


def usage_rows(stats: DataFrame, usage: DataFrame, scope: Sequence[str] = ("year",)) -> DataFrame:
    """Usage shares per player and team over a season (`scope` = year) or a week (`scope` = year, week).

    The usage source serves player and team whenever it covers the team, else box-score counts. Both sources have one
    row per (name_key, team, year, week)."""
    scope = list(scope)
    team, who = [*scope, "team"], [*scope, "name_key", "team"]
    by_week = "week" in scope
    skill = stats.where(F.col("position").isin("RB", "WR", "TE"))
    touches = zero_if_null("rush_att") + zero_if_null("rec")
    players = skill.groupBy(*who, "name", "position").agg(
        F.sum(zero_if_null("rec_tgt")).alias("targets"), F.sum(touches).alias("touches"), F.count(F.lit(1)).alias("games"))
    u_touch = zero_if_null("carries") + zero_if_null("receptions")
    used = usage.groupBy(*who).agg(
        F.sum(zero_if_null("targets")).alias("u_targets"), F.sum(u_touch).alias("u_touches"),
        *[F.sum(zero_if_null(c)).alias(c) for c in USAGE_SUMS],
        F.max("air_yards_share").alias("__air_share"), F.max("wopr").alias("__wopr"))
    teams = usage.groupBy(*team).agg(
        F.sum(zero_if_null("targets")).alias("t_targets"), F.sum(u_touch).alias("t_touches"),
        F.sum(zero_if_null("air_yards")).alias("t_air"), (F.count(F.lit(1)) == F.count("receptions")).alias("has_receptions"))
    box = A.team_totals(stats, team)
    week_key = [*who, "week"] if not by_week else who
    snaps = full_outer_fill(
        usage.where((F.col("offense_snaps") > 0) & F.col("offense_pct").isNotNull()).select(*week_key, F.col("offense_pct").alias("pct")),
        skill.where(F.col("snap_pct").isNotNull()).select(*week_key, F.col("snap_pct").alias("pct")), week_key, ["pct"])
    snap = snaps.groupBy(*who).agg(half_up(F.avg("pct"), 1).alias("snap_pct"))

    rows = attach(attach(attach(attach(players, used, who), teams, team), box, team), snap, who)
    tgt = F.when(F.col("t_targets") > 0, ratio(F.coalesce("u_targets", "targets") * 100.0, "t_targets")).otherwise(
        ratio(F.col("targets") * 100.0, "team_targets"))
    use_touch = F.coalesce(F.col("has_receptions"), F.lit(False)) & (F.col("t_touches") > 0)
    tch = F.when(use_touch, ratio(F.coalesce("u_touches", "touches") * 100.0, "t_touches")).otherwise(
        ratio(F.col("touches") * 100.0, "team_touches"))
    u_tgt, air = ratio("u_targets", "t_targets"), ratio("air_yards", "t_air")
    air_share = F.col("__air_share") if by_week else air * 100.0
    wopr = F.col("__wopr") if by_week else u_tgt * 1.5 + air * 0.7
    return rows.select(
        *who, "name", "position", "games", "targets", "touches", half_up(tgt, 1).alias("target_share"),
        half_up(tch, 1).alias("touch_share"), half_up(F.col("targets") / F.col("games"), 1).alias("targets_per_game"),
        half_up(F.col("touches") / F.col("games"), 1).alias("touches_per_game"), "snap_pct",
        half_up(ratio("air_yards", "u_targets"), 1).alias("adot"), half_up(air_share, 1).alias("air_yards_share"),
        half_up(wopr, 2).alias("wopr"), *USAGE_SUMS)


def points_against(fpa: DataFrame, year: int | None = None, position: str = "ALL") -> DataFrame:
    out = fpa if year is None else fpa.where(F.col("year") == year)
    out = out if position == "ALL" else out.where(F.col("position") == position)
    return out.orderBy(F.col("dk_pts_per_game").desc_nulls_last(), "team")


def implied_team_points(odds: DataFrame) -> DataFrame:
    total = C.total_value("over_under")
    return odds.withColumn("total", total).withColumn("implied_total", C.implied_team_total("spread", total))


def best_matchups(players: DataFrame, stats: DataFrame, depth: DataFrame, schedule: DataFrame, odds: DataFrame,
                  props: DataFrame, year: int, week: int) -> DataFrame:
    """Slate players on a depth chart with trailing-ten opponent and player form, league ranks, odds and fractions.

    `players`(year, week, name, name_key, position, team, opponent, salary); the player's own mean has no lower season
    bound, the league ranks start last season."""
    slate_rows = players.where((F.col("year") == year) & (F.col("week") == week) & F.col("position").isin(SKILL))
    label = first_rows(depth, ["name_key"], ["string_rank", "team"]).select("name_key", "string_rank")
    slate_rows = slate_rows.join(label, "name_key", "inner")
    past = before_week(stats, year, week)
    recent = past.where(F.col("year") >= year - 1)
    allowed = A.allowed_by_position(recent)
    opp = trailing_mean(allowed, ["team", "position"], WEEK, "pts_allowed", 10, "opp_avg", "opp_games")
    opp = rank_in_group(opp, ["position"], "opp_avg", "team", rank="opp_rank", total="opp_rank_total")
    scored = past.withColumn("points", S.counted_points())
    own = trailing_mean(scored.join(slate_rows.select("name_key"), "name_key", "left_semi"), ["name_key"], WEEK, "points", 10,
                        "player_avg", "player_games")
    league = trailing_mean(scored.where((F.col("year") >= year - 1) & F.col("position").isin(SKILL)), ["position", "name_key"],
                           WEEK, "points", 10, "league_avg", "league_games").where(F.col("league_avg").isNotNull())
    league = rank_in_group(league, ["position"], "league_avg", "name_key", rank="player_rank", total="player_rank_total")

    rows = attach(slate_rows, opp.withColumnRenamed("team", "opponent"), ["opponent", "position"])
    rows = attach(rows, own, ["name_key"])
    rows = attach(rows, league.select("position", "name_key", "player_rank", "player_rank_total"), ["position", "name_key"])
    rows = attach(rows, schedule.select(*WEEK, "team", "home_away"), [*WEEK, "team"])
    home = F.when(F.col("home_away") == "h", F.col("team")).otherwise(F.col("opponent"))
    lines = implied_team_points(odds).where((F.col("year") == year) & (F.col("week") == week)).select(
        "team", "spread", "over_under", "favorite", F.col("implied_total").alias("team_implied_total"))
    rows = attach(rows.withColumn("roof", roof_type(home)), lines, ["team"])
    rows = attach(rows, implied_points(props).select(*WEEK, "name_key", "implied_points"), [*WEEK, "name_key"])
    rows = rows.withColumns({"depth_label": C.depth_label("string_rank"),
                             "opp_fraction": half_up(rank_fraction("opp_rank", "opp_rank_total"), 4),
                             "player_fraction": half_up(rank_fraction("player_rank", "player_rank_total"), 4)})
    return rows


def with_value_fractions(rows: DataFrame) -> DataFrame:
    """Min-max fractions over the rows shown (kept apart: it scans the result once more for its two bounds)."""
    return minmax_fraction(rows, {"implied_points": "implied_fraction", "team_implied_total": "team_total_fraction"})


def depth_charts(depth: DataFrame, injuries: DataFrame, positions: Sequence[str] = ("QB", "RB", "LWR", "RWR", "SWR", "TE")
                 ) -> DataFrame:
    """Depth rows in fixed position order with label and injury status by name."""
    inj = injuries.groupBy("name_key").agg(F.max("status").alias("status"))
    rows = attach(depth.where(F.col("pos").isin(list(positions))), inj, ["name_key"])
    return rows.withColumn("pos_order", position_rank("pos", positions)).withColumn("depth_label", C.depth_label("string_rank"))


def props_board(bets: DataFrame, scored: DataFrame, schedule: DataFrame, now: Column, picks: DataFrame) -> DataFrame:
    """Latest board with results, locks and how many submitters picked each prop."""
    newest = bets.agg(F.max(F.struct(*WEEK))).scalar()
    board = scored.where(F.struct(*WEEK) == newest)
    board = flag_teams(board, locked_teams(schedule, now), "locked").withColumn("locked", F.coalesce("locked", F.lit(False)))
    counts = picks.groupBy("prop_id").agg(F.countDistinct("submitter").alias("submitters"))
    return attach(board, shuffled(counts), ["prop_id"]).withColumn("submitters", zero_if_null("submitters"))


def board_picks(board: DataFrame, picks: DataFrame) -> DataFrame:
    """The board once per submitter who has picks on it, with each prop's stored pick (NULL where there is none)."""
    stored = first_rows(picks.select("submitter", "prop_id", "pick"), ["submitter", "prop_id"], ["pick"])
    on_board = stored.join(shuffled(board.select("prop_id", *WEEK)), "prop_id")
    who = on_board.select("submitter", *WEEK).distinct()
    # Every submitter meets every prop of the week: submitters are dealt over all partitions, each with a copy of the board.
    parts = int(board.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    who = who.withColumn("__part", F.pmod(F.xxhash64("submitter"), F.lit(parts)).cast("int"))
    copies = board.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = copies.join(shuffled(who), [*WEEK, "__part"]).drop("__part")
    return attach(rows, shuffled(on_board.select("submitter", "prop_id", "pick")), ["submitter", "prop_id"])


def season_schedule(schedule: DataFrame, current: DataFrame) -> DataFrame:
    """Home rows with Eastern day and time; the current week is flagged."""
    flag = current.select(*WEEK, F.lit(True).alias("__c"))
    rows = attach(schedule.where(F.col("home_away") == "h"), flag, WEEK)
    return rows.select(*WEEK, F.col("team").alias("home_team"), F.col("opponent").alias("away_team"), "kickoff",
                       clock.eastern_day("kickoff").alias("day"), clock.eastern_time("kickoff").alias("time"),
                       F.coalesce("__c", F.lit(False)).alias("is_current"))


def game_overview(weather: DataFrame, odds: DataFrame) -> DataFrame:
    """Weather rows with both sides' lines, implied totals and the roof."""
    side = implied_team_points(odds).select(*WEEK, "team", "spread", "over_under", "implied_total")
    pick = lambda p: side.select(*WEEK, F.col("team").alias(f"{p}_team"), F.col("spread").alias(f"{p}_spread"),
                                 F.col("implied_total").alias(f"{p}_implied"))
    rows = attach(weather, pick("home"), [*WEEK, "home_team"])
    rows = attach(rows, pick("away"), [*WEEK, "away_team"])
    return rows.withColumn("roof", roof_type("home_team"))


def weather_per_team(weather: DataFrame) -> DataFrame:
    return per_team(weather)


def odds_week(odds: DataFrame, schedule: DataFrame) -> DataFrame:
    """(year, week) most odds rows belong to, by the nearest kickoff of the same team within a day; may be empty."""
    votes = nearest_within(odds.where(F.col("kickoff").isNotNull()).select("team", F.col("kickoff").alias("odds_kickoff")),
                           schedule.select("team", *WEEK, F.col("kickoff").alias("game_kickoff")), ["team"],
                           "odds_kickoff", "game_kickoff", ["team", "odds_kickoff"], WEEK)
    return A.majority(votes, WEEK)


def odds_for_week(odds: DataFrame, schedule: DataFrame, year: int, week: int) -> DataFrame:
    """Odds rows only when their week is this page's week or unknown."""
    vote = odds_week(odds, schedule)
    same = vote.agg(F.max((F.col("year") == year) & (F.col("week") == week))).scalar()
    return odds.where(F.coalesce(same, F.lit(True)))


def current_week(schedule: DataFrame, now: Column) -> DataFrame:
    """Current (year, week) by the Tuesday rollover, else the latest week of the schedule."""
    live = A.current_week(schedule, clock.week_rollover(now)).withColumn("__p", F.lit(0))
    last = schedule.select(*WEEK).orderBy(F.desc("year"), F.desc("week")).limit(1).withColumn("__p", F.lit(1))
    return live.unionByName(last).orderBy("__p").limit(1).drop("__p")


def load_schedule(rows: DataFrame, home_rule: str = "location") -> DataFrame:
    """Two team rows per game with the kickoff in UTC. `home_rule` 'team_2' trusts the column order, 'location' takes
    the team named by `location` as home when it names one of the two."""
    from chalkline.operators.filters import regular_games

    games = regular_games(rows).withColumn("kickoff", clock.kickoff_utc("date", "time"))
    one, two = normalize_team("team_1"), normalize_team("team_2")
    games = games.withColumns({"__1": one, "__2": two})
    first_home = F.lit(False) if home_rule == "team_2" else F.coalesce(
        F.contains(F.lower("team_1"), F.lower("location")) & ~F.contains(F.lower("team_2"), F.lower("location")), F.lit(False))
    games = games.withColumns({"home_team": F.when(first_home, F.col("__1")).otherwise(F.col("__2")),
                               "away_team": F.when(first_home, F.col("__2")).otherwise(F.col("__1")),
                               "home_score": F.lit(None).cast("int"), "away_score": F.lit(None).cast("int")})
    return per_team(games.select("year", "week", "kickoff", "home_team", "away_team", "home_score", "away_score")).drop(
        "score", "opponent_score")


def date_to_week(schedule: DataFrame) -> DataFrame:
    """Parsed game date -> week; unparseable dates are skipped."""
    rows = schedule.withColumn("game_date", clock.parse_mixed_date("date")).withColumn("week", to_int("week").cast("int"))
    rows = rows.where(F.col("game_date").isNotNull() & (F.col("week") <= 18))
    return rows.groupBy("year", "game_date").agg(F.min("week").alias("week"))


def season_state(schedule: DataFrame, today: Column) -> DataFrame:
    """Per season: finished when its last date is past, and the latest week that is over (0 when none)."""
    weeks = date_to_week(schedule).groupBy("year", "week").agg(F.max("game_date").alias("__d"))
    return weeks.groupBy("year").agg(
        (F.max("__d") < today).alias("finished"),
        F.coalesce(F.max(F.when(F.col("__d") < today, F.col("week"))), F.lit(0)).alias("latest_completed_week"))


def work_list(candidates: DataFrame, done: DataFrame, seasons: DataFrame) -> DataFrame:
    """(player_id, year) still to collect: a finished season needs any row, a running one the latest finished week;
    rows flagged `placeholder` do not count as done."""
    have = done.where(~F.coalesce(F.col("placeholder"), F.lit(False))).groupBy("player_id", "year").agg(F.max("week").alias("__w"))
    rows = candidates.join(have, ["player_id", "year"], "left").join(seasons, "year", "left")
    complete = F.col("__w").isNotNull() & (F.coalesce("finished", F.lit(False)) | (F.col("__w") >= F.col("latest_completed_week")))
    return rows.where(~F.coalesce(complete, F.lit(False))).select("player_id", "year")
