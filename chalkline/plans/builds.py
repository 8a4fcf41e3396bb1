"""Table builds: usage from plays, team-defence scores, game odds from market rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.functions.conditions import usage_position
from chalkline.functions.names import normalize_name
from chalkline.functions.scoring import defense_points
from chalkline.functions.teams import normalize_team
from chalkline.functions.values import half_up, ratio, zero_if_null
from chalkline.operators.aggregates import fold_duplicates, pbp_counts
from chalkline.operators.filters import scrimmage_plays
from chalkline.operators.joins import fill_id, full_outer_fill

POSITIONS = ["QB", "RB", "WR", "TE", "FB"]
COUNTS = ["targets", "carries", "receptions", "rz_targets", "rz_carries", "i10_targets", "i10_carries", "i5_targets",
          "i5_carries", "third_down_targets", "offense_snaps"]


def build_usage(stats: DataFrame, snaps: DataFrame, plays: DataFrame, ids: DataFrame, year: int | None = None) -> DataFrame:
    """Player-week usage: weekly stats and snap counts full-outer joined, play tallies by id, duplicates folded.

    All inputs may carry `year`; it is part of every key when present."""
    when = ["year", "week"] if "year" in stats.columns else ["week"]
    base = stats.where((F.col("season_type") == "REG") & F.col("position").isin(POSITIONS)).drop("season_type")
    ids = ids.where(F.col("gsis_id").isNotNull())
    cross = ids.groupBy("gsis_id").agg(F.max("pfr_id").alias("pfr_id"))
    base = base.join(cross, "gsis_id", "left")
    s = snaps.withColumn("position", usage_position("position"))
    s = s.where((F.col("game_type") == "REG") & F.col("position").isin(POSITIONS)).drop("game_type")
    rows = full_outer_fill(base, s, ["pfr_id", *when], ["name", "team", "position"])
    rows = fill_id(rows, ids, "pfr_id", "gsis_id")
    rows = rows.join(pbp_counts(scrimmage_plays(plays), ["gsis_id", *when]), ["gsis_id", *when], "left")
    rows = rows.withColumns({c: zero_if_null(c).cast("int") for c in COUNTS})
    rows = rows.withColumns({c: half_up(F.col(c) * 100.0, 1) for c in ("offense_pct", "target_share", "air_yards_share")})
    rows = rows.withColumns({
        "wopr": half_up("wopr", 3), "adot": half_up(ratio("air_yards", F.when(F.col("targets") > 0, F.col("targets"))), 1),
        "team": F.nullif(normalize_team(F.when(F.col("team") == "LA", F.lit("LAR")).when(F.col("team") == "SD", F.lit("LAC"))
                                        .otherwise(F.col("team"))), F.lit("")),
        "name_key": normalize_name("name"),
        "__pos": F.concat_ws("|", F.coalesce("gsis_id", F.lit("~")), F.coalesce("pfr_id", F.lit("~")))})
    if year is not None and "year" not in rows.columns:
        rows = rows.withColumn("year", F.lit(year))
    return fold_duplicates(rows.where(F.col("name").isNotNull()), ["name_key", *when, "team"], "__pos")


def build_defense(primary: DataFrame, fallback: DataFrame, points: DataFrame) -> DataFrame:
    """Team-defence scores: the primary source where it covers a season, else the fallback; needs points allowed."""
    covered = primary.select("year").distinct()
    stats = primary.unionByName(fallback.join(covered, "year", "left_anti"), allowMissingColumns=True)
    allowed = points.select("year", "week", "team", "opponent", "points_allowed")
    rows = stats.join(allowed, ["year", "week", "team"], "left").where(F.col("points_allowed").isNotNull())
    return rows.withColumn("dk_pts", defense_points())


def build_game_odds(markets: DataFrame) -> DataFrame:
    """Two team rows per event from spread and total rows: `markets`(event_id, market, team, value, odds, kickoff).
    Events without exactly two teams are skipped; the first team in code order gives the total."""
    spread = F.col("market") == "spread"
    sides = markets.where(spread).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("__n"), F.min(F.struct("team", "value", "odds", "kickoff")).alias("a"),
        F.max(F.struct("team", "value", "odds", "kickoff")).alias("b")).where(F.col("__n") == 2)
    totals = markets.where(~spread).groupBy("event_id", F.col("team").alias("__t")).agg(F.max("value").alias("over_under"))
    sides = sides.join(totals, (sides.event_id == totals.event_id) & (F.col("a.team") == F.col("__t")), "left").select(
        sides.event_id, "a", "b", "over_under")
    num = lambda side: F.col(f"{side}.value").try_cast("double")
    favorite = F.when(num("a").isNotNull() & num("b").isNotNull(),
                      F.when(num("a") < 0, F.col("a.team")).when(num("b") < 0, F.col("b.team")))
    one = lambda me, other: F.struct(
        F.col(f"{me}.kickoff").alias("kickoff"), normalize_team(f"{me}.team").alias("team"),
        normalize_team(f"{other}.team").alias("opponent"), num(me).alias("spread"), F.col(f"{me}.odds").alias("spread_odds"),
        F.col("over_under"), normalize_team("favorite").alias("favorite"))
    return sides.withColumn("favorite", favorite).select("event_id", F.inline(F.array(one("a", "b"), one("b", "a"))))
