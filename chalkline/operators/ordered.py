"""Ordered-group operators: trailing means, ranks, exponential means, leave-one-out statistics, extrema.

Scale rules used here:
* "last k per key" is `row_number() <= k`, which Spark cuts to k rows per key on the map side before the shuffle;
* totals are aggregated (map-side combined) and joined back, never a window over the whole group;
* running windows are used on histories whose key (player, season, week) is unique, so a partition is bounded
  by the calendar;
* ranks over an unbounded group go through `chunked_row_number`, which splits a group into ordered chunks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions.values import as_col, half_up, ratio

Cols = Sequence[str]


def attach(df: DataFrame, side: DataFrame, keys: Cols, how: str = "left", null_safe: bool = False) -> DataFrame:
    """Join `side` (unique on `keys`) to `df` and keep one copy of the keys.

    The plain form lets an aggregate by `keys` be joined where it lies, without a second exchange; `null_safe` also
    matches NULL to NULL."""
    if not null_safe:
        return df.join(side, list(keys), how)
    renamed = side.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in side.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return df.join(renamed, on, how).drop(*[f"__k_{k}" for k in keys])


def shuffled(side: DataFrame) -> DataFrame:
    """`side`, one row per player or prop, for a join that never broadcasts it. Spark judges a side by its compressed shuffle files, and ten times that
    passes the driver; a plan with several such sides fills it long before any one of them is too large to broadcast."""
    return side.hint("merge")


def attach_totals(df: DataFrame, keys: Cols, **aggs: Column) -> DataFrame:
    """Group aggregates joined back to every row (the skew-safe form of an unordered window)."""
    return attach(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), keys)


def _direction(order: Sequence[Column | str]) -> list[Column]:
    return [as_col(o) for o in order]


def first_rows(df: DataFrame, keys: Cols, order: Sequence[Column | str], n: int = 1, rank_col: str | None = None
               ) -> DataFrame:
    """The first n rows per key in `order` (ties must be broken by `order` itself)."""
    rn = rank_col or "__rn"
    out = df.withColumn(rn, F.row_number().over(Window.partitionBy(*keys).orderBy(*_direction(order))))
    out = out.where(F.col(rn) <= n)
    return out if rank_col else out.drop(rn)


def chunked_row_number(df: DataFrame, group: Cols, order: Sequence[Column | str],
                       chunk: Sequence[tuple[str, Column, bool]], out: str = "rn", total: str | None = None
                       ) -> DataFrame:
    """row_number() over `group` in `order` without gathering a group in one task.

    `chunk` lists (name, expression, descending): coarse, monotone steps of the leading order columns. Rows are
    numbered inside (group, chunk) and shifted by the sizes of the earlier chunks; only the chunk sizes of a group
    meet in one task.
    """
    names = [f"__c_{n}" for n, _, _ in chunk]
    tagged = df.withColumns({c: expr for c, (_, expr, _) in zip(names, chunk)})
    steps = [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_first() for c, (_, _, desc) in zip(names, chunk)]
    sizes = tagged.groupBy(*group, *names).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*group)
    sizes = sizes.withColumn("__before", F.coalesce(
        F.sum("__n").over(w.orderBy(*steps).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if total:
        sizes = sizes.withColumn(total, F.sum("__n").over(w))
    numbered = tagged.withColumn("__in", F.row_number().over(
        Window.partitionBy(*group, *names).orderBy(*_direction(order))))
    joined = attach(numbered, sizes.drop("__n"), [*group, *names], null_safe=True)
    return joined.withColumn(out, (F.col("__in") + F.col("__before")).cast("bigint")).drop("__in", "__before", *names)


def trailing_mean(df: DataFrame, keys: Cols, order: Cols, value: str, n: int = 10, mean: str = "avg_value",
                  count: str = "games") -> DataFrame:
    """Mean of the newest n rows per key (partial windows allowed), with the rows used; NULL values count as games."""
    newest = first_rows(df, keys, [F.col(o).desc() for o in order], n)
    return newest.groupBy(*keys).agg(half_up(F.avg(value), 2).alias(mean), F.count(F.lit(1)).alias(count))


def rank_in_group(df: DataFrame, group: Cols, value: str, tiebreak: str, step: float = 1.0,
                  tie_chunk: Column | None = None, rank: str = "rank", total: str = "rank_total") -> DataFrame:
    """Distinct rank by descending value inside a group, plus the group size."""
    chunk = [("value", F.floor(F.col(value) / F.lit(step)), True)]
    # Equal values only share a chunk when they are equal in full, so the tie step stays monotone.
    if tie_chunk is not None:
        chunk += [("exact", F.col(value), True), ("tie", tie_chunk, False)]
    return chunked_row_number(df, group, [F.col(value).desc_nulls_last(), F.col(tiebreak)], chunk, rank, total)


EWM_EXPONENT = 256  # largest exponent of a weight of two inside one segment


def ewm_mean(df: DataFrame, keys: Cols, order: Cols, columns: Cols, halflife: float, shift: bool = True,
             prefix: str = "ewm_", chunk: Column | None = None) -> DataFrame:
    """Exponentially weighted mean with a half-life in non-null values; `shift` leaves the current row out.

    The mean is a ratio of two sums, which are scanned in segments: a history is cut into segments of rows, each row takes the running sums of its
    segment, and each segment the sums of all earlier ones, faded by the values in between. `chunk` (a monotone step of the order, such as a day of a
    timestamp) deals a key's segments to different tasks; without it a key is one chunk. Only segments' sums of a key ever meet.
    """
    size = max(1, int(halflife * EWM_EXPONENT))
    half = F.lit(float(halflife))
    at = [*keys, "__chunk", "__sub"]
    inside = Window.partitionBy(*at).orderBy(*order)
    through = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    frame = inside.rowsBetween(Window.unboundedPreceding, -1) if shift else through
    out = df.withColumn("__chunk", chunk if chunk is not None else F.lit(0))
    out = out.withColumn("__sub", F.floor((F.row_number().over(Window.partitionBy(*keys, "__chunk").orderBy(*order)) - 1) / size))
    # A segment has at most `size` values, so its weights end at 2^EWM_EXPONENT.
    out = out.withColumns({f"__w_{c}": F.when(F.col(c).isNotNull(), F.pow(F.lit(2.0), F.count(c).over(through) / half)) for c in columns})
    sums = out.groupBy(*at).agg(*[a for c in columns for a in (F.count(c).alias(f"__k_{c}"), F.sum(f"__w_{c}").alias(f"__d_{c}"), F.sum(F.col(c) * F.col(f"__w_{c}")).alias(f"__n_{c}"))])
    carried = _carried(sums, keys, columns, size, half)
    out = out.withColumns({f"__{x}r_{c}": F.sum(v).over(frame) for c in columns for x, v in (("d", F.col(f"__w_{c}")), ("n", F.col(c) * F.col(f"__w_{c}")))})
    out = attach(out, carried, at, null_safe=True)

    def part(c: str, x: str) -> Column:
        return F.coalesce(F.col(f"__{x}r_{c}"), F.lit(0.0)) + F.col(f"__{x}c_{c}")

    means = {f"{prefix}{c}": part(c, "n") / F.nullif(part(c, "d"), F.lit(0.0)) for c in columns}
    return out.withColumns(means).drop("__chunk", "__sub", *[f"__{x}_{c}" for c in columns for x in ("w", "dr", "nr", "dc", "nc")])


def _carried(sums: DataFrame, keys: Cols, columns: Cols, size: int, half: Column) -> DataFrame:
    """What each segment takes over from the earlier ones of its key, in terms of its own weights.

    Sums are put in units of blocks of `size` values, counted over the whole history, so no weight grows with it. A segment stands in the block that it
    begins in and may reach into the next one, so a segment takes the earlier ones of its block and the two blocks before, faded. What lies further
    back is over `size` values older than the newest and weighs under 2^-256 of it.
    """
    # One row per column, so all columns share their windows.
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("__c"), F.col(f"__k_{c}").alias("__k"), F.col(f"__d_{c}").alias("__d"), F.col(f"__n_{c}").alias("__n"))
                              for i, c in enumerate(columns)]))
    out = sums.select(*keys, "__chunk", "__sub", each)
    in_order = Window.partitionBy(*keys, "__c").orderBy("__chunk", "__sub").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("__s", F.coalesce(F.sum("__k").over(in_order), F.lit(0)))
    out = out.withColumn("__b", F.floor(F.col("__s") / size))
    scale = F.pow(F.lit(2.0), (F.col("__s") - F.col("__b") * size) / half)
    out = out.withColumns({f"__{x}s": F.coalesce(F.col(f"__{x}"), F.lit(0.0)) * scale for x in "dn"})
    same = Window.partitionBy(*keys, "__c", "__b").orderBy("__chunk", "__sub").rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(*keys, "__c").orderBy("__b")

    def taken(x: str) -> Column:
        parts = [F.coalesce(F.sum(f"__{x}s").over(same), F.lit(0.0))]
        for back in (1, 2):
            fade = F.pow(F.lit(2.0), F.lit(-float(back * size)) / half)
            parts.append(F.coalesce(F.sum(f"__{x}s").over(blocks.rangeBetween(-back, -back)), F.lit(0.0)) * fade)
        return reduce(lambda a, b: a + b, parts) / scale

    out = out.withColumns({f"__{x}t": taken(x) for x in "dn"})
    return out.groupBy(*keys, "__chunk", "__sub").agg(*[F.max(F.when(F.col("__c") == i, F.col(f"__{x}t"))).alias(f"__{x}c_{c}") for i, c in enumerate(columns) for x in "dn"])


def group_total(df: DataFrame, keys: Cols, column: str, out: str) -> DataFrame:
    return attach_totals(df, keys, **{out: F.sum(column)})


def share_of_total(df: DataFrame, keys: Cols, column: str, out: str, percent: bool = True) -> DataFrame:
    """Row value over its group total; NULL when the total is NULL or not above 0."""
    totals = attach_totals(df, keys, __total=F.sum(column))
    total = F.when(F.col("__total") > 0, F.col("__total"))
    return totals.withColumn(out, ratio(F.col(column) * F.lit(100.0 if percent else 1.0), total)).drop("__total")


def stint_features(df: DataFrame, keys: Cols, order: Cols, team: str = "team", year: str = "year") -> DataFrame:
    """prior_games, stint number, games already in the stint, and whether the season is new for the player."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(team).over(w)
    return (df.withColumn("prior_games", (F.row_number().over(w) - 1).cast("bigint"))
            .withColumn("__move", F.when(before.eqNullSafe(F.col(team)), 0).otherwise(1))
            .withColumn("new_season", ~F.lag(year).over(w).eqNullSafe(F.col(year)))
            .withColumn("stint", F.sum("__move").over(w).cast("bigint"))
            .withColumn("stint_games", (F.row_number().over(
                Window.partitionBy(*keys, "stint").orderBy(*order)) - 1).cast("bigint"))
            .drop("__move"))


def recency_hit_rate(df: DataFrame, keys: Cols, order: Cols, hit: Column, half_life: float = 4.0, n: int = 16
                     ) -> DataFrame:
    """Recency-weighted share of hits over the newest n rows: weights 0.5^(age / half_life), age 0 = newest."""
    recent = first_rows(df, keys, [F.col(o).desc() for o in order], n, rank_col="__age")
    w = F.pow(F.lit(0.5), (F.col("__age") - 1) / F.lit(float(half_life)))
    one = F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0))
    return recent.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("games"),
        F.sum(one).cast("bigint").alias("hits"),
        F.sum(F.when(F.col("__age") <= 3, one)).cast("bigint").alias("hits_last3"),
        F.sum(w).alias("weight"), F.sum(w * one).alias("weighted_hits"),
        (F.sum(w * one) / F.sum(w)).alias("weighted_rate"))


def tail_k(df: DataFrame, keys: Cols, order: Cols, k: int) -> DataFrame:
    """The newest k rows per key, `age` 1 = newest."""
    return first_rows(df, keys, [F.col(o).desc() for o in order], k, rank_col="age")


def leave_one_out(df: DataFrame, keys: Cols, value: str, how: str = "mean", out: str = "others") -> DataFrame:
    """Statistic of the other rows of the group (this row left out), NULL when there are none.

    The median needs only the three middle order statistics: leaving out one row shifts the middle by at most one
    place, and which way depends on the row's value alone. They are read off the counts per distinct value.
    """
    if how == "count":
        return attach_totals(df, keys, __n=F.count(value)).withColumn(out, F.col("__n") - 1).drop("__n")
    if how == "mean":
        t = attach_totals(df, keys, __n=F.count(value), __s=F.sum(value))
        return t.withColumn(out, F.when(F.col("__n") > 1, (F.col("__s") - F.col(value)) / (F.col("__n") - 1))
                            ).drop("__n", "__s")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    if how == "min":
        low = counts.groupBy(*keys).agg(F.min(F.struct(value, "__c")).alias("__lo"), F.sum("__c").alias("__n"))
        nxt = attach(counts, low, keys).where(F.col(value) > F.col(f"__lo.{value}")).groupBy(*keys).agg(
            F.min(value).alias("__next"))
        t = attach(attach(df, low, keys), nxt, keys)
        lo = F.col(f"__lo.{value}")
        alone = (F.col(value) == lo) & (F.col("__lo.__c") == 1)
        return t.withColumn(out, F.when(alone, F.col("__next")).otherwise(lo)).drop("__lo", "__n", "__next")
    if how != "median":
        raise ValueError("how must be count, mean, min or median")
    m = F.floor(F.col("__n") / 2)
    middle = middle_values(df, keys, value, [m, m + 1, m + 2]).withColumnsRenamed({"__v0": "__a", "__v1": "__b", "__v2": "__c"})
    t = attach(df, middle, keys)
    v, lo, mid, hi = F.col(value), F.col("__a"), F.col("__b"), F.col("__c")
    odd = F.when(v < mid, (mid + hi) / 2.0).when(v == mid, (lo + hi) / 2.0).otherwise((lo + mid) / 2.0)
    even = F.when(v <= lo, mid).otherwise(lo)
    med = F.when(F.col("__n") > 1, F.when(F.col("__n") % 2 == 0, even).otherwise(odd))
    return t.withColumn(out, med.cast("double")).drop("__n", "__a", "__b", "__c")


SMALL_GROUP = 4000  # rows of a group up to which its distinct values may meet in one window


def middle_values(df: DataFrame, keys: Cols, value: str, places: Sequence[Column]) -> DataFrame:
    """(keys, __n, __v0, __v1, ...): the values at the given 1-based places around the middle of each group's ordered non-null
    values, as expressions of the group size `__n`, at most two places from it.

    Rows are counted per value first. In a large group only the values between its approximate 49.9th and 50.1th percentile are put in order;
    the others are just counted, so no task orders a whole group.
    """
    rows = df.where(F.col(value).isNotNull())
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    bounds = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx(value, [0.499, 0.501], 20_000).alias("__q"))
    tagged = attach(counts, bounds, keys, "inner")
    small = F.col("__n") <= SMALL_GROUP
    lower = ~small & (F.col(value) < F.col("__q")[0])
    near = small | F.col(value).between(F.col("__q")[0], F.col("__q")[1])
    below = tagged.where(lower).groupBy(*keys).agg(F.sum("__c").alias("__below"))
    cum = F.sum("__c").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = attach(tagged.where(near), below, keys).withColumn("__cum", cum + F.coalesce("__below", F.lit(0)))
    return placed.groupBy(*keys).agg(F.max("__n").alias("__n"), *[F.min(F.when(F.col("__cum") >= p, F.col(value))).alias(f"__v{i}") for i, p in enumerate(places)])


def split_median(df: DataFrame, keys: Cols, value: str, out: str = "median") -> DataFrame:
    """Exact median of the non-null values per group, without ordering a group in one task."""
    n = F.col("__n")
    both = middle_values(df, keys, value, [F.floor((n + 1) / 2), F.floor(n / 2) + 1])
    return both.select(*keys, ((F.col("__v0") + F.col("__v1")) / 2.0).alias(out))


def best_row(df: DataFrame, keys: Cols, value: str, tiebreak: Sequence[Column | str], largest: bool = False) -> DataFrame:
    """The row with the smallest (or largest) value per key, ties by `tiebreak`."""
    lead = F.col(value).desc_nulls_last() if largest else F.col(value).asc_nulls_last()
    return first_rows(df, keys, [lead, *tiebreak])


def dropped_week(scores: DataFrame, keys: Cols = ("submitter",), week: str = "week", score: str = "score") -> DataFrame:
    """Lowest week per key, first on ties, only for keys with two or more weeks."""
    counted = scores.where(F.col(score).isNotNull())
    many = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= 2).drop("__n")
    low = first_rows(counted, keys, [F.col(score), F.col(week)])
    return low.join(shuffled(many), list(keys), "left_semi").select(*keys, F.col(week).alias("dropped_week"))


def weekly_top(scores: DataFrame, keys: Cols = ("year", "week"), score: str = "score") -> DataFrame:
    """Every row that reaches the best score of its group (all ties kept, one row each)."""
    counted = scores.where(F.col(score).isNotNull())
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc())
    return counted.withColumn("__r", F.rank().over(w)).where(F.col("__r") == 1).drop("__r")


def first_in_group(df: DataFrame, keys: Cols, time: str, out: str) -> DataFrame:
    return attach_totals(df, keys, **{out: F.min(time)})


def robust_median(df: DataFrame, keys: Cols, value: str, outlier_ratio: float = 2.5, median: str = "median",
                  count: str = "n") -> DataFrame:
    """Median per key; with three or more values those outside [m / ratio, m * ratio] are dropped first."""
    vals = attach_totals(df.where(F.col(value).isNotNull()), keys, __m=F.median(value), __n=F.count(value))
    m, n = F.col("__m"), F.col("__n")
    inside = (F.col(value) <= m * outlier_ratio) & (F.col(value) >= m / outlier_ratio)
    kept = F.when((n < 3) | inside, F.col(value))
    # If nothing is inside, every value is kept.
    agg = vals.groupBy(*keys).agg(F.median(kept).alias("__a"), F.count(kept).alias("__na"),
                                  F.median(value).alias("__b"), F.count(value).alias("__nb"))
    return agg.select(*keys, F.when(F.col("__na") > 0, F.col("__a")).otherwise(F.col("__b")).alias(median),
                      F.when(F.col("__na") > 0, F.col("__na")).otherwise(F.col("__nb")).alias(count))


def minmax_fraction(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Per column -> output: 0 at the maximum, 1 at the minimum of the whole result; NULL when all values are equal.

    The bounds of all columns come from one scalar subquery."""
    bounds = df.agg(F.struct(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])).scalar()
    fraction = lambda c: (bounds[f"hi_{c}"] - F.col(c)) / F.nullif(bounds[f"hi_{c}"] - bounds[f"lo_{c}"], F.lit(0.0))
    return df.withColumns({out: fraction(c) for c, out in columns.items()})


def rank_fraction(rank: Column | str, total: Column | str) -> Column:
    r, t = as_col(rank).cast("double"), as_col(total).cast("double")
    return F.when(t > 1, (r - 1.0) / (t - 1.0))
