"""Data-quality and reconciliation jobs; each returns a small report DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions.names import normalize_name
from chalkline.functions.values import half_up
from chalkline.operators.ordered import attach, attach_totals, split_median

Cols = Sequence[str]


@dataclass(frozen=True)
class Rule:
    """Smallest size, key columns that may not be all NULL, and whether age is checked."""

    dataset: str
    min_rows: int
    key_columns: tuple[str, ...]
    fresh: bool


# The checks run after each refresh.
RULES = [
    Rule("depth_charts", 300, ("player_name", "team", "pos"), True),
    Rule("injuries_depth", 1, ("player_name", "status"), True),
    Rule("injuries_edge", 20, ("player_name", "status"), True),
    Rule("game_odds", 20, ("team", "spread", "over_under"), True),
    Rule("props", 200, ("player_name", "team", "category"), True),
    Rule("rankings", 50, ("player_name", "team", "pts"), True),
    Rule("salaries", 300, ("name", "team", "dk_salary"), True),
    Rule("weather", 10, ("away_team", "home_team"), True),
    Rule("usage", 100, ("name", "team", "offense_snaps"), False),
    Rule("team_points", 100, ("team", "points_scored"), False),
    Rule("defense_stats", 100, ("team", "dk_pts"), False),
    Rule("points_against", 50, ("team", "dk_pts_per_game"), False),
    Rule("player_stats", 1000, ("name", "team", "dk_pts"), False),
    Rule("game_info", 100, ("boxscore_url", "team_home"), False),
]
WARNING_SCHEMA = "dataset string, check string, detail string"


def check_dataset(df: DataFrame, rule: Rule, age_hours: float | None = None, max_age_hours: float | None = None) -> DataFrame:
    """Warnings for one dataset from a single aggregate over it."""
    present = [c for c in rule.key_columns if c in df.columns]
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"k_{c}") for c in present])
    n = F.col("n")
    found = [F.when(n < rule.min_rows, F.struct(F.lit("min_rows").alias("check"), F.concat(
        n.cast("string"), F.lit(f" rows, expected at least {rule.min_rows}")).alias("detail")))]
    for c in rule.key_columns:
        if c not in present:
            found.append(F.struct(F.lit("missing_column").alias("check"), F.lit(c).alias("detail")))
        else:
            found.append(F.when((n > 0) & (F.col(f"k_{c}") == 0),
                                F.struct(F.lit("empty_column").alias("check"), F.lit(c).alias("detail"))))
    if rule.fresh and age_hours is not None and max_age_hours is not None and age_hours > max_age_hours:
        found.append(F.struct(F.lit("age").alias("check"), F.lit(f"{age_hours:.0f}h old").alias("detail")))
    warnings = F.filter(F.array(*found), lambda s: s.isNotNull())
    return stats.select(F.explode(warnings).alias("w")).select(F.lit(rule.dataset).alias("dataset"), "w.check", "w.detail")


def check_datasets(spark: SparkSession, datasets: dict[str, DataFrame], rules: Sequence[Rule] = tuple(RULES),
                   ages: dict[str, float] | None = None, max_age_hours: float | None = None, only: str | None = None
                   ) -> DataFrame:
    """Warnings over all rules, 'missing' for a dataset that is absent; an empty result means all is well."""
    wanted = [w.strip() for w in only.split(",")] if only else None
    parts = [spark.createDataFrame([], WARNING_SCHEMA)]
    for rule in rules:
        if wanted and not any(w in rule.dataset for w in wanted):
            continue
        if rule.dataset in datasets:
            parts.append(check_dataset(datasets[rule.dataset], rule, (ages or {}).get(rule.dataset), max_age_hours))
        else:
            parts.append(spark.createDataFrame([(rule.dataset, "missing", "no data")], WARNING_SCHEMA))
    return reduce(lambda a, b: a.unionByName(b), parts)


def compare_points(old: DataFrame, new: DataFrame, on: Cols, value: str, threshold: float = 1.0) -> DataFrame:
    """One-row comparison: matched, one-sided counts, mean/median/max absolute difference, agreement counts."""
    o = old.select(*on, F.col(value).alias("__o"), F.lit(1).alias("__ho"))
    n = new.select(*on, F.col(value).alias("__n"), F.lit(1).alias("__hn"))
    both = o.join(n, list(on), "full_outer")
    matched = F.col("__ho").isNotNull() & F.col("__hn").isNotNull()
    gap = F.when(matched, F.abs(F.col("__n") - F.col("__o")))
    # The median has one group; it is read off the counts around the middle.
    median = split_median(both.select(F.lit(1).alias("__all"), gap.alias("__gap")), ["__all"], "__gap", "__median")
    totals = both.agg(
        F.count_if(matched).alias("matched"), F.count_if(F.col("__hn").isNull()).alias("only_old"),
        F.count_if(F.col("__ho").isNull()).alias("only_new"), half_up(F.avg(gap), 4).alias("mean_gap"),
        half_up(F.max(gap), 4).alias("max_gap"),
        F.count_if(gap == 0).alias("exact"), F.count_if(gap <= 0.5).alias("within_half"),
        F.count_if(gap > threshold).alias("over_threshold")).withColumn("__all", F.lit(1))
    return attach(totals, median, ["__all"]).select(
        "matched", "only_old", "only_new", "mean_gap", half_up("__median", 4).alias("median_gap"), "max_gap", "exact",
        "within_half", "over_threshold")


def worst_gaps(old: DataFrame, new: DataFrame, on: Cols, value: str, n: int = 20) -> DataFrame:
    o = old.select(*on, F.col(value).alias("old_value"))
    w = new.select(*on, F.col(value).alias("new_value"))
    gaps = o.join(w, list(on)).withColumn("gap", half_up(F.abs(F.col("new_value") - F.col("old_value")), 4))
    return gaps.orderBy(F.desc("gap"), *on).limit(n)


def match_stats(df: DataFrame, matched: str = "matched") -> DataFrame:
    total, hits = F.count(F.lit(1)), F.count_if(F.col(matched))
    return df.agg(total.alias("n_rows"), hits.alias("matched_rows"), (total - hits).alias("unmatched_rows"),
                  half_up(hits * 100.0 / total, 1).alias("match_pct"))


def duplicate_keys(df: DataFrame, keys: Cols, differing: str) -> DataFrame:
    """Rows whose key appears with more than one value of `differing`."""
    counted = attach_totals(df, keys, n_rows=F.count(F.lit(1)), n_values=F.countDistinct(differing))
    return counted.where(F.col("n_values") > 1)


def rekey_report(df: DataFrame, row_id: str, key: str, unique_with: Cols | None = ()) -> DataFrame:
    """action per row: same / change / collision. A change collides when another row already holds, or an earlier row
    takes, the new key under the unique columns; the lowest id wins."""
    fresh = df.withColumn("new_key", normalize_name(F.coalesce(F.col(key), F.lit(""))))
    same = (F.col("new_key") == "") | F.col("new_key").eqNullSafe(F.col(key))
    if unique_with is None:
        return fresh.withColumn("action", F.when(same, F.lit("same")).otherwise(F.lit("change")))
    slot = list(unique_with)
    held = df.select(*slot, F.col(key).alias("new_key")).distinct().withColumn("__held", F.lit(True))
    first = fresh.where(~same).groupBy(*slot, "new_key").agg(F.min(row_id).alias("__first"))
    tagged = fresh.join(held, [*slot, "new_key"], "left").join(first, [*slot, "new_key"], "left")
    clash = F.coalesce(F.col("__held"), F.lit(False)) | (F.col("__first") != F.col(row_id))
    return tagged.withColumn("action", F.when(same, F.lit("same")).when(clash, F.lit("collision"))
                             .otherwise(F.lit("change"))).drop("__held", "__first")


def source_coverage(ours: DataFrame, theirs: DataFrame, on: Cols, ids: Cols) -> DataFrame:
    """Share of our rows found in the other source and share of its ids that are filled."""
    t = theirs.select(*on, *[F.col(c).alias(f"__{c}") for c in ids], F.lit(1).alias("__hit"))
    j = ours.select(*on).join(t, list(on), "left")
    hit = F.col("__hit").isNotNull()
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(hit).alias("matched_rows"),
                 half_up(F.count_if(hit) * 100.0 / F.count(F.lit(1)), 1).alias("match_pct"),
                 *[F.count_if(hit & F.col(f"__{c}").isNotNull()).alias(f"with_{c}") for c in ids])


def bulk_coverage(bulk: DataFrame, per_item: DataFrame, on: Cols, book: str = "book") -> DataFrame:
    """Per key: books in each feed and how many are missing from or extra in the bulk feed."""
    b = bulk.select(*on, book).distinct().withColumn("__b", F.lit(1))
    p = per_item.select(*on, book).distinct().withColumn("__p", F.lit(1))
    j = b.join(p, [*on, book], "full_outer")
    return j.groupBy(*on).agg(
        F.count("__b").alias("bulk_books"), F.count("__p").alias("item_books"),
        F.count_if(F.col("__b").isNull()).alias("missing_in_bulk"), F.count_if(F.col("__p").isNull()).alias("extra_in_bulk"))


def data_as_of(loads: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Newest of file time and load time for a list of sources, in list order."""
    order = F
    for i, s in enumerate(sources):
        order = order.when(F.col("source") == s, F.lit(i))
    picked = loads.where(F.col("source").isin(list(sources)))
    newest = picked.groupBy("source").agg(F.max(F.greatest("file_time", "loaded_at")).alias("as_of"))
    return newest.withColumn("list_pos", order).orderBy("list_pos")


