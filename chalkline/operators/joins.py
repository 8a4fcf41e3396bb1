"""Join operators: lookups, fills, as-of and nearest matches, priority and fuzzy resolution."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.operators.ordered import attach, first_rows, shuffled

Cols = Sequence[str]


def latest_per_key(df: DataFrame, keys: Cols, order: Sequence[Column]) -> DataFrame:
    """One row per key, the one that comes first in `order`."""
    return first_rows(df, keys, order)


def salaries_with_stats(salaries: DataFrame, stats: DataFrame, keys: Cols = ("year", "week", "name_key"),
                        how: str = "left") -> DataFrame:
    return salaries.join(stats, list(keys), how)


def picks_with_bets(picks: DataFrame, bets: DataFrame, on: Cols = ("prop_id",)) -> DataFrame:
    return picks.join(bets, list(on), "inner")


def lookup(df: DataFrame, dim: DataFrame, on: Cols, order: Sequence[Column]) -> DataFrame:
    """Left lookup against a table that may repeat keys; the row first in `order` wins."""
    return attach(df, latest_per_key(dim, on, order), on)


def full_outer_fill(a: DataFrame, b: DataFrame, on: Cols, fill: Cols) -> DataFrame:
    """Full outer join; columns in `fill` exist on both sides and take the left value first.

    A row with a NULL key matches nothing. Such rows go round the join, so they neither pair with each other nor meet in one task."""
    complete = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in on])
    right = b.where(complete).select(*[F.col(c).alias(f"__r_{c}") if c in (*on, *fill) else F.col(c) for c in b.columns])
    cond = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"__r_{k}") for k in on])
    joined = a.where(complete).join(right, cond, "full_outer")
    merged = {c: F.coalesce(F.col(c), F.col(f"__r_{c}")) for c in (*on, *fill)}
    matched = joined.withColumns(merged).drop(*[f"__r_{c}" for c in (*on, *fill)])
    return matched.unionByName(a.where(~complete), allowMissingColumns=True).unionByName(b.where(~complete), allowMissingColumns=True)


def on_depth_chart(slate: DataFrame, depth: DataFrame, key: str = "name_key") -> DataFrame:
    return slate.join(depth.select(key), key, "left_semi")


def only_in(a: DataFrame, b: DataFrame, on: Cols) -> DataFrame:
    """Rows found on one side only, tagged by `side`."""
    left = a.join(b.select(*on), list(on), "left_anti").select(*on).withColumn("side", F.lit("left"))
    right = b.join(a.select(*on), list(on), "left_anti").select(*on).withColumn("side", F.lit("right"))
    return left.unionByName(right)


def compare_join(a: DataFrame, b: DataFrame, on: Cols, suffixes: tuple[str, str] = ("_old", "_new"),
                 how: str = "inner") -> DataFrame:
    """Join two tables of one schema, suffixing the non-key columns."""
    left = a.select(*on, *[F.col(c).alias(c + suffixes[0]) for c in a.columns if c not in on])
    right = b.select(*on, *[F.col(c).alias(c + suffixes[1]) for c in b.columns if c not in on])
    return left.join(right, list(on), how)


def quotes_against_targets(quotes: DataFrame, target_books: Sequence[str], book: str = "book",
                           target: str = "target_book") -> DataFrame:
    """Each quote once per target book other than its own: "all other books" becomes a plain grouping key.

    The fan-out is the length of the target list, so statistics of the others are ordinary map-side combined
    aggregates by (prop, target book); nothing pairs quotes with quotes.
    """
    targets = F.array(*[F.lit(b) for b in target_books])
    others = F.when(F.col(book).isNull(), targets).otherwise(F.array_remove(targets, F.col(book)))
    return quotes.withColumn(target, F.explode(others))


def asof_before(left: DataFrame, right: DataFrame, keys: Cols, left_time: str, right_time: str, payload: Cols,
                tiebreak: Cols = (), chunk: str = "day") -> DataFrame:
    """Newest right row strictly before each left row, per key.

    Both sides are interleaved and carried forward inside (key, time chunk); the last right row of each earlier
    chunk is carried over at chunk level, so no task ever holds the whole history of a key.
    """
    right_struct = F.struct(F.col(right_time).alias("__t"), *[F.col(c).alias(f"__o_{c}") for c in tiebreak],
                            *[F.col(c).alias(f"__p_{c}") for c in payload])
    r = right.select(*keys, F.col(right_time).alias("__time"), F.lit(1).alias("__kind"), right_struct.alias("__row"))
    lcols = [c for c in left.columns if c not in keys]
    l = left.select(*keys, F.col(left_time).alias("__time"), F.lit(0).alias("__kind"), F.struct(*lcols).alias("__left"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("__chunk", F.date_trunc(chunk, "__time"))
    by_chunk = both.groupBy(*keys, "__chunk").agg(F.max("__row").alias("__last"))
    w = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_chunk.select(*keys, "__chunk", F.last("__last", ignorenulls=True).over(w).alias("__carried"))
    order = [F.col("__time"), F.col("__kind"), *[F.col(f"__row.__o_{c}") for c in tiebreak]]
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    walked = both.withColumn("__found", F.last("__row", ignorenulls=True).over(inside)).where("__kind = 0")
    joined = attach(walked.drop("__row"), carried, [*keys, "__chunk"])
    row = F.coalesce(F.col("__found"), F.col("__carried"))
    return joined.select(*keys, *[F.col(f"__left.{c}").alias(c) for c in lcols], row["__t"].alias(right_time),
                         *[row[f"__p_{c}"].alias(c) for c in payload])


def nearest_within(left: DataFrame, right: DataFrame, keys: Cols, left_time: str, right_time: str,
                   left_id: Cols, tiebreak: Cols, tolerance_seconds: int = 86400) -> DataFrame:
    """Right row of the same key closest in time within the tolerance; ties by `tiebreak`; unmatched left dropped.

    Times fall into tolerance-wide buckets, each left row probes three of them, so the join is an equi-join.
    """
    bucket = lambda t: F.floor(F.unix_timestamp(t) / tolerance_seconds)
    l = left.withColumn("__b", F.explode(F.sequence(bucket(left_time) - 1, bucket(left_time) + 1)))
    r = right.select(*keys, F.col(right_time).alias("__rt"), *tiebreak).withColumn("__b", bucket("__rt"))
    gap = F.abs(F.unix_timestamp("__rt") - F.unix_timestamp(left_time))
    pairs = l.join(r, [*keys, "__b"]).withColumn("gap_seconds", gap).where(F.col("gap_seconds") <= tolerance_seconds)
    return first_rows(pairs, left_id, ["gap_seconds", *tiebreak]).drop("__b", "__rt")


def resolve_team(names: DataFrame, sources: Sequence[DataFrame], key: str = "name_key", team: str = "team") -> DataFrame:
    """Team per name from the first source (in order) that knows one; a source repeating a name takes its last team
    in text order."""
    tagged = [s.where(F.col(team).isNotNull() & (F.col(team) != "")).select(key, team, F.lit(i).alias("__p"))
              for i, s in enumerate(sources)]
    stacked = reduce(lambda a, b: a.unionByName(b), tagged)
    best = stacked.groupBy(key).agg(*[F.max(F.when(F.col("__p") == i, F.col(team))).alias(f"__t{i}")
                                      for i in range(len(sources))])
    resolved = best.select(key, F.coalesce(*[F.col(f"__t{i}") for i in range(len(sources))]).alias(team))
    return attach(names, shuffled(resolved), [key])


def match_player(left: DataFrame, right: DataFrame, key: str = "name_key", last: str = "last_name",
                 team: str = "team", out: str = "matched_key", require_single: bool = False) -> DataFrame:
    """Exact key, else last name + team when that names one player. With `require_single` the fallback also applies
    when the exact key is not unique on the right (one right row per player expected)."""
    exact = right.groupBy(key).agg(F.count(F.lit(1)).alias("__rows"))
    exact = exact.where(F.col("__rows") == 1) if require_single else exact
    by_last = (right.groupBy(F.col(last).alias("__last"), F.col(team).alias("__team"))
               .agg(F.min(key).alias("__lo"), F.max(key).alias("__hi"), F.count(F.lit(1)).alias("__rows")))
    single = F.col("__rows") == 1 if require_single else F.col("__lo") == F.col("__hi")
    by_last = by_last.where(single).select("__last", "__team", F.col("__lo").alias("__fallback"))
    tagged = attach(left, exact.select(key, F.lit(True).alias("__exact")), [key])
    found = tagged.join(by_last, (F.element_at(F.split(F.col(key), " "), -1) == F.col("__last"))
                        & (F.col(team) == F.col("__team")), "left")
    return found.withColumn(out, F.when(F.col("__exact"), F.col(key)).otherwise(F.col("__fallback"))).drop(
        "__exact", "__last", "__team", "__fallback")


def flag_teams(df: DataFrame, teams: DataFrame, out: str) -> DataFrame:
    """`out`: whether `teams`(year, week, team) lists the row's week and team; not true otherwise.

    A row per week carries its teams, so the broadcast follows the calendar and has number keys, which Spark packs into one long. A broadcast by text keys
    takes a memory page of its own on the driver, up to 64 MB, however few rows it has."""
    weeks = teams.groupBy("year", "week").agg(F.collect_set("team").alias("__teams"))
    return attach(df, F.broadcast(weeks), ["year", "week"]).withColumn(out, F.array_contains("__teams", F.col("team"))).drop("__teams")


def score_slots(slots: DataFrame, stats: DataFrame, defense: DataFrame) -> DataFrame:
    """Points per lineup slot: defences by team, everyone else by name. Where a name (or team) has several rows in a week, the first by
    team and then by most points counts, so a slot stays one row."""
    s = first_rows(stats, ["year", "week", "name_key"], ["team", F.desc("points")])
    s = s.select("year", "week", "name_key", F.col("points").alias("__sp"), F.col("team").alias("__st"))
    d = first_rows(defense, ["year", "week", "team"], [F.desc("points")]).select("year", "week", F.col("team").alias("dst_team"), F.col("points").alias("__dp"))
    joined = slots.join(shuffled(s), ["year", "week", "name_key"], "left").join(d, ["year", "week", "dst_team"], "left")
    is_dst = F.upper("slot") == "DST"
    return (joined.withColumn("actual_pts", F.when(is_dst, F.col("__dp")).otherwise(F.col("__sp")))
            .withColumn("stat_team", F.when(is_dst, F.col("dst_team")).otherwise(F.col("__st")))
            .drop("__sp", "__st", "__dp"))


def per_team(games: DataFrame, home: str = "home_team", away: str = "away_team", home_score: str = "home_score",
             away_score: str = "away_score") -> DataFrame:
    """Two rows per game, each from one team's side."""
    side = lambda t, o, ts, os_, ha: F.struct(
        F.col(t).alias("team"), F.col(o).alias("opponent"), F.lit(ha).alias("home_away"),
        F.col(ts).alias("score"), F.col(os_).alias("opponent_score"))
    both = F.array(side(home, away, home_score, away_score, "h"), side(away, home, away_score, home_score, "a"))
    rest = [c for c in games.columns if c not in (home, away, home_score, away_score)]
    return games.select(*rest, F.inline(both))


def fill_id(df: DataFrame, crosswalk: DataFrame, key: str, value: str) -> DataFrame:
    """Fill a missing id from a crosswalk; the smallest id wins when the crosswalk repeats a key."""
    side = crosswalk.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias("__id"))
    return df.join(side, key, "left").withColumn(value, F.coalesce(F.col(value), F.col("__id"))).drop("__id")


def borrow(df: DataFrame, reference: DataFrame, on: Cols, columns: Cols, order: Sequence[Column]) -> DataFrame:
    """Bring reference columns over, one reference row per key, with a `matched` flag."""
    ref = latest_per_key(reference, on, order).select(*on, *columns, F.lit(True).alias("__hit"))
    return attach(df, ref, on).withColumn("matched", F.coalesce(F.col("__hit"), F.lit(False))).drop("__hit")
