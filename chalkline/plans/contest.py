"""Contest plans: prop and lineup scoring, standings, breakdowns and batch validation of submissions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions import scoring as S
from chalkline.functions.conditions import counts_toward_season
from chalkline.functions.names import normalize_name
from chalkline.functions.teams import normalize_team
from chalkline.functions.values import half_up, zero_if_null
from chalkline.operators.aggregates import lineup_total
from chalkline.operators.joins import flag_teams, resolve_team, score_slots
from chalkline.operators.ordered import attach, dropped_week, first_rows, shuffled, weekly_top

WEEK = ["year", "week"]
LINEUP_SCHEMA = "array<struct<slot:string,name:string,position:string,salary:int>>"
# Slot -> (players, eligible positions).
ROSTER = {"QB": (1, ["QB"]), "RB": (2, ["RB"]), "WR": (3, ["WR"]), "TE": (1, ["TE"]),
          "FLEX": (1, ["RB", "WR", "TE"]), "DST": (1, ["DST"])}
LINEUP_SIZE, SALARY_CAP, PICKS_PER_WEEK = 9, 50_000, 5
UNGRADED = ["push", "void"]


def one_per_name(stats: DataFrame) -> DataFrame:
    """One row per name and week, the first by team and player id, where the table has them."""
    order = [c for c in ("team", "player_id") if c in stats.columns] or ["name_key"]
    return first_rows(stats, [*WEEK, "name_key"], order)


def score_props(bets: DataFrame, stats: DataFrame, teams: Sequence[DataFrame], results: DataFrame) -> DataFrame:
    """actual and result (over / under / push / void / NULL) per prop.

    `bets`(prop_id, year, week, name_key, stat_field, line); of several `stats` rows of a name in a week the
    first by `one_per_name` counts; `teams` are priority sources of (year, week, name_key, team); `results` lists (year, week, team) with a final score."""
    at = [*WEEK, "name_key"]
    rows = attach(bets, shuffled(one_per_name(stats).select(*at, S.stat_struct(S.FIELD_PARTS).alias("__stats"))), at)
    rows = rows.select(*at, "stat_field", *[c for c in bets.columns if c not in (*at, "stat_field")], S.stat_of(S.FIELD_PARTS, "stat_field", "__stats").alias("actual"))
    sources = [t.select(F.concat_ws("|", *WEEK, "name_key").alias("__who"), "team") for t in teams]
    rows = resolve_team(rows.withColumn("__who", F.concat_ws("|", *WEEK, "name_key")), sources, "__who").drop("__who")
    rows = flag_teams(rows, results, "__in")
    known = F.col("stat_field").isin(list(S.FIELD_PARTS))
    result = (F.when(F.col("actual") > F.col("line"), F.lit("over")).when(F.col("actual") < F.col("line"), F.lit("under"))
              .when(F.col("actual") == F.col("line"), F.lit("push")).when(known & F.col("__in"), F.lit("void")))
    return rows.withColumn("result", result).drop("__in")


def parse_lineups(lineups: DataFrame, json_column: str = "lineup_json") -> DataFrame:
    """One row per player of every submitted lineup."""
    slots = F.explode(F.from_json(json_column, LINEUP_SCHEMA))
    rows = lineups.select(*[c for c in lineups.columns if c != json_column], slots.alias("p"))
    return rows.select("*", "p.*").drop("p").withColumn("name_key", normalize_name("name")).withColumn(
        "dst_team", F.when(F.upper("slot") == "DST", normalize_team("name")))


def lineup_rows(slots: DataFrame, stats: DataFrame, defense: DataFrame, slate: DataFrame, salaries: DataFrame,
                results: DataFrame) -> DataFrame:
    """Every lineup player with their result. A player without stats whose team's result is in scores 0 (dnp).

    `stats`(year, week, name_key, team, points) and `defense`(year, week, team, points) count with one row per key;
    `slate` and `salaries` give the team of players without stats, the slate first."""
    rows = score_slots(slots, stats, defense)
    key = F.concat_ws("|", *WEEK, "name_key")
    sources = [t.select(key.alias("__who"), "team") for t in (slate, salaries)]
    rows = resolve_team(rows.withColumn("__who", key), sources, "__who").drop("__who")
    is_dst = F.upper("slot") == "DST"
    rows = rows.withColumn("team", F.when(is_dst, F.col("stat_team")).otherwise(F.coalesce("stat_team", "team"))).drop("stat_team")
    rows = flag_teams(rows, results, "__in")
    dnp = ~is_dst & F.col("actual_pts").isNull() & F.coalesce(F.col("__in"), F.lit(False)) & F.col("team").isNotNull()
    return rows.withColumn("dnp", dnp).withColumn(
        "actual_pts", F.when(F.col("dnp"), F.lit(0.0)).otherwise(F.col("actual_pts"))).drop("__in")


def lineup_totals(rows: DataFrame, n: int = LINEUP_SIZE) -> DataFrame:
    """(year, week, submitter, matched, score); score is NULL unless exactly n players have a result."""
    return lineup_total(rows, [*WEEK, "submitter"], n)


def season_standings(scores: DataFrame, drop_lowest: bool = True, excluded: dict | None = None) -> DataFrame:
    """Season totals per submitter. Weeks that do not count are neither summed nor dropped."""
    counted = scores.withColumn("__s", F.when(counts_toward_season("year", "week", excluded), F.col("score")))
    totals = counted.groupBy("year", "submitter").agg(
        F.sum(F.coalesce("__s", F.lit(0.0))).alias("total"), F.count("__s").alias("weeks_scored"),
        F.count_if(F.col("score").isNull()).alias("weeks_pending"))
    if not drop_lowest:
        return totals.withColumn("total", half_up("total", 2))
    low = dropped_week(counted.where(F.col("__s").isNotNull()), ("year", "submitter"), "week", "__s")
    worst = counted.groupBy("year", "submitter").agg(F.min("__s").alias("__low"))
    rows = attach(attach(totals, shuffled(low), ["year", "submitter"]), shuffled(worst), ["year", "submitter"])
    total = F.col("total") - F.when(F.col("dropped_week").isNotNull(), F.col("__low")).otherwise(F.lit(0.0))
    return rows.withColumn("total", half_up(total, 2)).drop("__low")


def weekly_winners(scores: DataFrame, excluded: dict | None = None) -> DataFrame:
    """All submitters who reach the week's best complete score; weeks without one keep a NULL row."""
    weeks = scores.select(*WEEK).distinct()
    top = weekly_top(scores, WEEK).select(*WEEK, F.col("score").alias("top_score"), "submitter")
    return weeks.join(top, WEEK, "left").withColumn("counts", counts_toward_season("year", "week", excluded))


def graded_picks(picks: DataFrame, scored: DataFrame) -> DataFrame:
    """Picks with their prop's result; is_correct is NULL for push, void and pending. A pick whose prop is gone is pending."""
    props = first_rows(scored, ["prop_id"], ["player_name", "stat_field", "line"])
    rows = picks.join(shuffled(props.select("prop_id", "player_name", "stat_field", "line", "actual", "result")), "prop_id", "left")
    live = F.col("result").isNotNull() & ~F.col("result").isin(UNGRADED)
    return rows.withColumn("is_correct", F.when(live, F.col("result") == F.col("pick")))


def pick_totals(graded: DataFrame) -> DataFrame:
    """Per submitter and week: picks, resolved (push and void count), correct only when every pick is resolved."""
    agg = graded.groupBy(*WEEK, "submitter").agg(
        F.count(F.lit(1)).alias("picks"), F.count("result").alias("matched"),
        F.count_if(F.col("is_correct")).alias("__ok"), F.count("is_correct").alias("scored"))
    return agg.withColumn("correct", F.when(F.col("matched") == F.col("picks"), F.col("__ok"))).drop("__ok")


def prop_standings(graded: DataFrame, excluded: dict | None = None) -> DataFrame:
    """Season pick standings; everyone with a pick is listed, accuracy is NULL without a scored pick."""
    counts = counts_toward_season("year", "week", excluded)
    agg = graded.groupBy("year", "submitter").agg(
        F.count_if(counts & F.col("is_correct")).alias("correct"),
        F.count_if(counts & F.col("is_correct").isNotNull()).alias("total_scored"),
        F.count_if(F.col("result").isNull()).alias("pending"))
    pct = half_up(F.col("correct") * 100.0 / F.nullif(F.col("total_scored"), F.lit(0)), 1)
    return agg.withColumn("accuracy_pct", pct)


def standings_long(scores: DataFrame, graded: DataFrame, excluded: dict | None = None) -> DataFrame:
    """Long export: one row per submitter, week and contest, with a flag on the lineup week that the season total drops."""
    low = dropped_week(scores.where(F.col("score").isNotNull() & counts_toward_season("year", "week", excluded)), ("year", "submitter"))
    flagged = attach(scores, shuffled(low), ["year", "submitter"])
    lineups = flagged.select(*WEEK, "submitter", F.lit("lineup").alias("contest"), F.col("score").alias("points"),
                             F.when(F.col("score").isNull(), F.lit("pending")).otherwise(F.lit("final")).alias("status"),
                             F.coalesce(F.col("week") == F.col("dropped_week"), F.lit(False)).alias("is_dropped_week"))
    picks = pick_totals(graded).select(
        *WEEK, "submitter", F.lit("props").alias("contest"), F.col("correct").cast("double").alias("points"),
        F.when(F.col("correct").isNull(), F.lit("pending")).otherwise(F.lit("final")).alias("status"), F.lit(False).alias("is_dropped_week"))
    return lineups.unionByName(picks).withColumn("counts", counts_toward_season("year", "week", excluded))


def _lines(rates: Sequence[tuple[str, str, float]]) -> list[Column]:
    return [F.struct(F.lit(i).alias("line_no"), F.lit(label).alias("label"), zero_if_null(c).cast("double").alias("units"),
                     half_up(zero_if_null(c) * F.lit(rate), 2).alias("pts")) for i, (c, label, rate) in enumerate(rates)]


def _breakdown(rows: DataFrame, lines: Column, keys: Sequence[str], actual: str) -> DataFrame:
    listed = rows.withColumn("__l", lines)
    total = F.aggregate("__l", F.lit(0.0), lambda a, s: a + s["pts"])
    gap = half_up(F.col(actual) - total, 2)
    other = F.when(F.abs(F.col(actual) - total) >= 0.01, F.array(F.struct(
        F.lit(99).alias("line_no"), F.lit("Other").alias("label"), F.lit(1.0).alias("units"), gap.alias("pts"))))
    full = F.concat("__l", F.coalesce(other, F.slice("__l", 1, 0)))
    return listed.select(*keys, actual, F.inline(full))


def offense_breakdown(rows: DataFrame, keys: Sequence[str], actual: str = "actual_pts") -> DataFrame:
    """Scoring lines that sum to the official points: non-zero stats, +3 bonuses and an 'Other' line for the gap."""
    bonus = [F.when(zero_if_null(c) >= t, F.struct(F.lit(50 + i).alias("line_no"), F.lit(label).alias("label"),
                                                  zero_if_null(c).cast("double").alias("units"), F.lit(S.BONUS_POINTS).alias("pts")))
             for i, (c, t, label) in enumerate(S.OFFENSE_BONUSES)]
    lines = F.filter(F.array(*_lines(S.OFFENSE_RATES)), lambda s: s["units"] != 0)
    return _breakdown(rows, F.concat(lines, F.filter(F.array(*bonus), lambda s: s.isNotNull())), keys, actual)


def defense_breakdown(rows: DataFrame, keys: Sequence[str], actual: str = "actual_pts") -> DataFrame:
    lines = F.filter(F.array(*_lines(S.DEFENSE_RATES)), lambda s: s["units"] != 0)
    allowed = F.when(F.col("points_allowed").isNotNull(), F.array(F.struct(
        F.lit(50).alias("line_no"), F.lit("Points allowed").alias("label"), F.col("points_allowed").cast("double").alias("units"),
        S.points_allowed_bonus("points_allowed").alias("pts"))))
    return _breakdown(rows, F.concat(lines, F.coalesce(allowed, F.slice(lines, 1, 0))), keys, actual)


def validate_lineups(submissions: DataFrame, previous: DataFrame, slate: DataFrame, locked: DataFrame) -> DataFrame:
    """First failing rule per submission as `reason`, NULL when it is accepted.

    `submissions` and `previous` are exploded lineups keyed (year, week, submitter); `slate`(year, week, name, team);
    `locked`(year, week, team)."""
    key = [*WEEK, "submitter"]
    team_of = slate.groupBy(*WEEK, "name").agg(F.max("team").alias("__team"))
    rows = attach(submissions, team_of, [*WEEK, "name"])
    team = F.when(F.upper("slot") == "DST", normalize_team("name")).otherwise(F.col("__team"))
    rows = rows.withColumn("team", team)
    rows = attach(rows, locked.select(*WEEK, "team").distinct().withColumn("__locked", F.lit(True)), [*WEEK, "team"])
    kept = previous.select(*key, "name").distinct().withColumn("__kept", F.lit(True))
    rows = attach(rows, kept, [*key, "name"])
    eligible = F.lit(False)
    for slot, (_, positions) in ROSTER.items():
        eligible = eligible | ((F.col("slot") == slot) & F.upper("position").isin(positions))
    too_late = F.coalesce(F.col("__locked"), F.lit(False)) & F.col("__kept").isNull()
    checks = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(zero_if_null("salary")).alias("__salary"),
        F.count_if(~F.coalesce(eligible, F.lit(False))).alias("__bad"),
        *[F.count_if(F.col("slot") == s).alias(f"__c_{s}") for s in ROSTER], F.count_if(too_late).alias("__late"))
    reason = (F.when(F.col("__n") != LINEUP_SIZE, F.lit("player count"))
              .when(F.col("__salary") > SALARY_CAP, F.lit("salary cap")).when(F.col("__bad") > 0, F.lit("position")))
    for s, (count, _) in ROSTER.items():
        reason = reason.when(F.col(f"__c_{s}") != count, F.lit(f"{s} count"))
    reason = reason.when(F.col("__late") > 0, F.lit("locked player"))
    return checks.select(*key, F.col("__n").alias("players"), F.col("__salary").alias("total_salary"), reason.alias("reason"))


def validate_picks(submissions: DataFrame, previous: DataFrame, board: DataFrame, locked_props: DataFrame) -> DataFrame:
    """First failing rule per pick submission, NULL when accepted.

    `submissions` and `previous` hold (year, week, submitter, prop_id, pick); `board` and `locked_props` hold
    (year, week, prop_id)."""
    key = [*WEEK, "submitter"]
    on = [*key, "prop_id"]
    board = board.select(*WEEK, "prop_id").distinct().withColumn("__board", F.lit(True))
    locked = locked_props.select(*WEEK, "prop_id").distinct().withColumn("__locked", F.lit(True))
    before = previous.select(*on, F.col("pick").alias("__before"))
    senders = submissions.select(*key).distinct()
    now = submissions.select(*on, "pick").withColumn("__now", F.lit(True))
    both = now.join(before.join(senders, key, "left_semi"), on, "full_outer")
    both = attach(attach(both, board, [*WEEK, "prop_id"]), locked, [*WEEK, "prop_id"])
    sent, is_locked = F.col("__now").isNotNull(), F.col("__locked").isNotNull()
    checks = both.groupBy(*key).agg(
        F.count("__now").alias("__n"), F.countDistinct(F.when(sent, F.col("prop_id"))).alias("__ids"),
        F.count_if(sent & ~F.coalesce(F.col("pick").isin("over", "under"), F.lit(False))).alias("__side"),
        F.count_if(sent & F.col("__board").isNull()).alias("__off"),
        F.count_if(sent & is_locked & ~F.col("__before").eqNullSafe(F.col("pick"))).alias("__changed"),
        F.count_if(~sent & is_locked).alias("__gone"))
    reason = (F.when(F.col("__n") != PICKS_PER_WEEK, F.lit("pick count")).when(F.col("__ids") != PICKS_PER_WEEK, F.lit("duplicate"))
              .when(F.col("__side") > 0, F.lit("side")).when(F.col("__off") > 0, F.lit("not on board"))
              .when(F.col("__changed") > 0, F.lit("locked change")).when(F.col("__gone") > 0, F.lit("locked removal")))
    return checks.select(*key, F.col("__n").alias("picks"), reason.alias("reason"))


def validate_props(rows: DataFrame, required: Sequence[str] = ("player_name", "stat_field", "line")) -> DataFrame:
    """One-row verdict on a batch of props: missing columns and rows whose field is not allowed reject the batch."""
    missing = [c for c in required if c not in rows.columns]
    bad = F.count_if(~F.coalesce(F.col("stat_field").isin(list(S.FIELD_PARTS)), F.lit(False))) if "stat_field" in rows.columns else F.lit(0)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), bad.alias("bad_fields")).select(
        "n_rows", F.lit(",".join(missing)).alias("missing_columns"), "bad_fields",
        ((F.col("bad_fields") == 0) & F.lit(not missing)).alias("accepted"))
