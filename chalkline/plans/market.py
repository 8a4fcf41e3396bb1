"""Market operators over book quotes: arbitrage, middles, outliers, value, fair prices, stale and low lines.

Input: quotes(category, player_name, team, book, line, over_odds, under_odds, site_projection, available).
"The other books" is always expressed as an aggregate by (prop, target book), see `quotes_against_targets`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions import odds as O
from chalkline.functions.fits import fit_param, outcome_batch
from chalkline.functions.names import normalize_name, signed_odds
from chalkline.functions.scoring import CATEGORY_FIELDS, LOW_LINE_PARTS, unpivot_stats
from chalkline.functions.teams import map_literal
from chalkline.functions.values import half_up
from chalkline.operators.aggregates import team_context
from chalkline.operators.filters import drop_pickem, exclude_books, is_available, only_available
from chalkline.operators.joins import match_player, quotes_against_targets
from chalkline.operators.ordered import attach, first_rows, robust_median, shuffled, split_median
from chalkline.sources.derived import dealt, settled

PROP = ["player_name", "category"]
SNAPSHOT = "snapshot"
TARGET_BOOKS = ("draftkings", "caesars")
NO_LINE = -1e9  # group key of props that are not compared line by line


def prop_of(quotes: DataFrame) -> list[str]:
    """Key of a prop. Where the quotes carry a `snapshot` (one number per scrape), every operator works per snapshot: quotes of different
    scrapes are never compared, and a prop quoted in many scrapes is many small groups."""
    return [*PROP, *snapshot_of(quotes)]


def snapshot_of(quotes: DataFrame) -> list[str]:
    return [SNAPSHOT] if SNAPSHOT in quotes.columns else []


def with_lower_book(quotes: DataFrame) -> DataFrame:
    return quotes.withColumn("book", F.lower("book"))


def _best(prefer: Column, *payload: str) -> Column:
    """Smallest preference per group with its row's columns; ties by book, then by the rest."""
    return F.min(F.when(prefer.isNotNull(), F.struct(prefer.alias("p"), *payload)))


def find_arbitrage(quotes: DataFrame, min_profit_pct: float = 1.0, total_stake: float = 100.0,
                   excluded: Sequence[str] = ()) -> DataFrame:
    """Opposite sides of one line at two books whose implied probabilities sum below 1."""
    prop = prop_of(quotes)
    q = exclude_books(with_lower_book(quotes), list(excluded)).where(F.col("line").isNotNull())
    best = q.groupBy(*prop, "line").agg(
        F.count(F.lit(1)).alias("__n"), F.min("team").alias("team"),
        _best(O.implied_prob("over_odds"), "book", "over_odds").alias("o"),
        _best(O.implied_prob("under_odds"), "book", "under_odds").alias("u"))
    both = best.where((F.col("__n") >= 2) & (F.col("o.book") != F.col("u.book")))
    combined = F.col("o.p") + F.col("u.p")
    dec_o, dec_u = O.decimal_odds("o.over_odds"), O.decimal_odds("u.under_odds")
    stake_o = F.lit(float(total_stake)) * (1.0 / dec_o) / F.col("combined")
    stake_u = F.lit(float(total_stake)) * (1.0 / dec_u) / F.col("combined")
    found = (both.withColumn("combined", combined).where(F.col("combined") < 1.0)
             .withColumn("profit", (1.0 - F.col("combined")) / F.col("combined") * 100.0)
             .where(F.col("profit") >= min_profit_pct))
    return found.select(
        *prop, "team", "line", F.col("o.book").alias("over_book"), F.col("o.over_odds").alias("over_odds"),
        F.col("u.book").alias("under_book"), F.col("u.under_odds").alias("under_odds"),
        half_up("combined", 4).alias("combined_prob"), half_up("profit", 2).alias("profit_pct"),
        half_up(stake_o, 2).alias("stake_over"), half_up(stake_u, 2).alias("stake_under"),
        half_up(stake_o * dec_o - F.lit(float(total_stake)), 2).alias("guaranteed_profit"))


def balanced_stakes(over_odds: Column | str, under_odds: Column | str, total: float = 100.0) -> Column:
    """struct(stake_over, stake_under, loss_if_miss, profit_if_middle_hits): both single-side results equal."""
    dec_o, dec_u = O.decimal_odds(over_odds), O.decimal_odds(under_odds)
    stake_u = F.lit(float(total)) / (1.0 + dec_u / dec_o)
    stake_o = F.lit(float(total)) - stake_u
    return F.struct(stake_o.alias("stake_over"), stake_u.alias("stake_under"),
                    (stake_o * (dec_o - 1.0) - stake_u).alias("loss_if_miss"),
                    (stake_o * (dec_o - 1.0) + stake_u * (dec_u - 1.0)).alias("profit_if_middle_hits"))


def find_middles(quotes: DataFrame, min_width: float = 1.0, total_stake: float = 100.0,
                 excluded: Sequence[str] = (), excluded_pairs: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Over at the lowest line and under at the highest line of one prop at different books."""
    prop = prop_of(quotes)
    q = exclude_books(with_lower_book(quotes), list(excluded), list(excluded_pairs)).where(F.col("line").isNotNull())
    ends = q.groupBy(*prop).agg(
        F.count(F.lit(1)).alias("books_compared"),
        F.min(F.struct("line", "book", "team", "over_odds")).alias("lo"),
        F.min(F.struct((-F.col("line")).alias("neg"), "book", "under_odds", "line")).alias("hi"))
    width = F.col("hi.line") - F.col("lo.line")
    found = ends.where((F.col("books_compared") >= 2) & (F.col("lo.book") != F.col("hi.book")) & (width >= min_width))
    found = found.withColumn("s", balanced_stakes(F.col("lo.over_odds"), F.col("hi.under_odds"), total_stake))
    return found.select(
        *prop, F.col("lo.team").alias("team"), F.col("lo.book").alias("low_book"), F.col("lo.line").alias("low_line"),
        F.col("lo.over_odds").alias("low_over_odds"), F.col("hi.book").alias("high_book"),
        F.col("hi.line").alias("high_line"), F.col("hi.under_odds").alias("high_under_odds"),
        half_up(width, 2).alias("middle_width"), "books_compared",
        *[half_up(f"s.{c}", 2).alias(c) for c in
          ("stake_over", "stake_under", "loss_if_miss", "profit_if_middle_hits")])


LOW_COUNT_FIELDS = ["pass_td", "pass_int"]


def middle_ev(middles: DataFrame, quotes: DataFrame, history: DataFrame, excluded: Sequence[str] = (),
              min_games: int = 6) -> DataFrame:
    """Chance that a middle hits and its expected value. `history` is (name_key, stat_field, history_games,
    history_sd) with the sample deviation over the player's whole history."""
    prop = prop_of(middles)
    mean = exclude_books(with_lower_book(quotes), list(excluded)).groupBy(*prop).agg(F.avg("line").alias("market_mean"))
    fields = map_literal(CATEGORY_FIELDS)
    rows = (attach(middles, mean, prop).withColumn("stat_field", fields[F.col("category")])
            .withColumn("name_key", normalize_name("player_name")))
    rows = rows.join(history, ["name_key", "stat_field"], "left")
    games = F.coalesce(F.col("history_games"), F.lit(0))
    sd, mu = F.col("history_sd"), F.col("market_mean")
    p = O.normal_cdf((F.col("high_line") - mu) / sd) - O.normal_cdf((F.col("low_line") - mu) / sd)
    ok = F.col("stat_field").isNotNull() & mu.isNotNull() & (games >= min_games) & (F.coalesce(sd, F.lit(0.0)) > 0)
    note = (F.when(F.col("stat_field").isNull(), F.lit("no stat field for this category"))
            .when(mu.isNull(), F.lit("no market rows for this player and category"))
            .when(games < min_games, F.concat(F.lit("insufficient history ("), games.cast("string"),
                                              F.lit(f" games, need {min_games}+)")))
            .when(~ok, F.lit("zero or undefined variance"))
            .when(F.col("stat_field").isin(LOW_COUNT_FIELDS), F.lit("caution: low-count stat"))
            .otherwise(F.lit("")))
    hit = F.when(ok, p)
    ev = hit * F.col("profit_if_middle_hits") + (1.0 - hit) * F.col("loss_if_miss")
    return rows.select(*middles.columns, half_up("market_mean", 2).alias("market_mean"),
                       half_up("history_sd", 2).alias("history_sd"), games.alias("history_games"),
                       half_up(hit, 4).alias("p_middle_hits"), half_up(ev, 2).alias("expected_value"),
                       note.alias("note"))


def find_outliers(quotes: DataFrame, min_diff_pct: float = 10.0, min_books: int = 3,
                  excluded: Sequence[str] = ()) -> DataFrame:
    """Lines far from the mean of the prop's other rows."""
    prop = prop_of(quotes)
    q = exclude_books(with_lower_book(quotes), list(excluded)).where(F.col("line").isNotNull() & (F.col("line") != 0))
    sums = q.groupBy(*prop).agg(F.count(F.lit(1)).alias("__n"), F.sum("line").alias("__s")).where(F.col("__n") >= max(min_books, 2))
    rows = attach(q, sums, prop, "inner")
    mean = (F.col("__s") - F.col("line")) / (F.col("__n") - 1)
    rows = rows.withColumn("__m", mean).where(F.col("__m") != 0)
    diff = F.col("line") - F.col("__m")
    pct = diff / F.col("__m") * 100.0
    return rows.where(F.abs(pct) >= min_diff_pct).select(
        *prop, "team", "book", "line", half_up("__m", 2).alias("consensus_mean"),
        (F.col("__n") - 1).alias("other_books_count"), half_up(diff, 2).alias("diff"), half_up(pct, 2).alias("diff_pct"),
        F.when(diff > 0, F.lit("Higher than consensus")).otherwise(F.lit("Lower than consensus")).alias("direction"))


def find_value(quotes: DataFrame, min_diff_pct: float = 8.0, excluded: Sequence[str] = ()) -> DataFrame:
    """Lines away from the site projection; the percentage is rounded before the threshold is applied."""
    prop = prop_of(quotes)
    q = exclude_books(with_lower_book(quotes), list(excluded)).where(
        F.col("site_projection").isNotNull() & F.col("line").isNotNull() & (F.col("line") != 0))
    diff = F.col("site_projection") - F.col("line")
    rows = q.withColumn("diff", half_up(diff, 2)).withColumn("diff_pct", half_up(diff / F.col("line") * 100.0, 2))
    return rows.where(F.abs("diff_pct") >= min_diff_pct).select(
        *prop, "team", "book", "line", "site_projection", "diff", "diff_pct",
        F.when(F.col("diff") > 0, F.lit("Over")).otherwise(F.lit("Under")).alias("direction"))


def _attach_in_prop(df: DataFrame, side: DataFrame, prop: Sequence[str], keys: Sequence[str], how: str = "inner") -> DataFrame:
    """`attach` by `prop` and `keys` where both lie dealt by `prop`. A join by more than they are dealt by would shuffle both, so a prop's few rows of `side` (one per
    target book, or per target book and line) are joined as one map."""
    rest = [c for c in side.columns if c not in (*prop, *keys)]
    entry = F.struct(F.struct(*keys).alias("k"), F.struct(*rest).alias("v"))
    packed = side.groupBy(*prop).agg(F.map_from_entries(F.collect_list(entry)).alias("__of"))
    found = attach(df, shuffled(packed), prop, how).withColumn("__found", F.col("__of")[F.struct(*keys)]).drop("__of")
    found = found.where(F.col("__found").isNotNull()) if how == "inner" else found
    return found.select("*", *[F.col("__found")[c].alias(c) for c in rest]).drop("__found")


def _fair_lines(two_way: DataFrame, target_books: Sequence[str], min_refs: int, max_shift_sd: float) -> DataFrame:
    """Target quotes with the other books' consensus: model, parameter, median line, reference counts and texts."""
    prop = prop_of(two_way)
    by_target = [*prop, "target_book"]
    # Every group and join below is within a prop: dealt by prop once, nothing is shuffled again. A prop has few rows, one per book and scrape.
    two_way = dealt(two_way, prop)
    # Distinct prices with their rows: everything below is told from them, so the quotes are read once for the references and once for the targets.
    prices = quotes_against_targets(two_way, target_books).groupBy(*by_target, "line", "over_odds", "under_odds").agg(
        F.count(F.lit(1)).alias("__rows"), F.min("book").alias("book"))
    prices = settled(prices, "prices", prop)
    lines = prices.groupBy(*by_target).agg(F.percentile("line", F.lit(0.5), F.col("__rows")).alias("__all_median"))
    model = O.category_model("category")
    resolved = F.when((model == "normal") & (F.col("__all_median") < O.MIN_NORMAL_LINE), F.lit("same_line")).otherwise(model)
    lines = settled(lines.withColumn("model", resolved), "line-models", prop)
    same = prices.groupBy(*by_target, "line").agg(
        F.sum("__rows").alias("same_line_refs"),
        _best(O.implied_prob("over_odds"), "book", "over_odds").alias("bo"),
        _best(O.implied_prob("under_odds"), "book", "under_odds").alias("bu"))
    # Same-line props compare quotes at one exact line, so the line joins their group key.
    line_key = F.when(F.col("model") == "same_line", F.col("line")).otherwise(F.lit(NO_LINE))
    sd = F.when(F.col("model") == "normal", O.normal_sd("category", F.col("__all_median")))
    # Fits depend on the price alone, so each distinct price of a group is fitted once and weighted by its rows.
    prices = _attach_in_prop(prices, lines, prop, ["target_book"]).withColumn("line_key", line_key)
    prices = prices.withColumns({"__sd": sd, "__p": O.novig_over("over_odds", "under_odds")})
    fit = fit_param(F.col("model"), F.col("__sd"), F.col("line"), F.col("__p"))
    fitted = prices.withColumn("param", F.when(F.col("model") == "same_line", F.col("__p")).otherwise(fit))
    # Spark does not see that rows lie as before once they have been through Python.
    fitted = dealt(fitted.select(*by_target, "line_key", "line", "param", "__rows"), prop)
    text = F.format_string("%s", F.regexp_replace(F.col("line").cast("string"), r"\.0$", ""))
    consensus = fitted.groupBy(*by_target, "line_key").agg(
        F.percentile("param", F.lit(0.5), F.col("__rows")).alias("param"), F.sum("__rows").alias("ref_books"),
        F.percentile("line", F.lit(0.5), F.col("__rows")).alias("ref_line"),
        F.min("line").alias("ref_lo"), F.max("line").alias("ref_hi"),
        F.array_join(F.array_sort(F.collect_set(text)), ",").alias("ref_lines"))
    targets = two_way.where(F.col("book").isin(list(target_books))).withColumn("target_book", F.col("book"))
    targets = _attach_in_prop(targets, lines, prop, ["target_book"]).withColumn("line_key", line_key)
    targets = _attach_in_prop(targets, consensus, prop, ["target_book", "line_key"]).where(F.col("ref_books") >= min_refs)
    targets = _attach_in_prop(targets, same, prop, ["target_book", "line"], "left")
    spread = F.when(F.col("model") == "normal", O.normal_sd("category", F.col("ref_line")))
    shift = F.abs(F.col("line") - F.col("ref_line"))
    return targets.withColumn("sd", spread).where(
        (F.col("model") == "same_line") | ((F.col("model") == "normal") & (shift <= max_shift_sd * F.col("sd")))
        | ((F.col("model") == "poisson") & (shift <= O.MAX_POISSON_SHIFT)))


def _both_sides(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Over and Under rows from probability columns p_over, p_under and p_push."""
    side = lambda name, odds, win, lose, best, best_odds: F.struct(
        F.lit(name).alias("side"), F.col(odds).alias("odds"), F.col(win).alias("p_win"), F.col(lose).alias("p_lose"),
        F.when(F.col(best).isNotNull(), F.concat_ws(" ", F.col(f"{best}.book"), signed_odds(f"{best}.{best_odds}")))
        .otherwise(F.lit("")).alias("best_other_same_line"))
    both = F.array(side("Over", "over_odds", "p_over", "p_under", "bo", "over_odds"),
                   side("Under", "under_odds", "p_under", "p_over", "bu", "under_odds"))
    return rows.select(*keep, "p_push", F.inline(both))


def _priced(rows: DataFrame) -> dict[str, Column]:
    dec = O.decimal_odds("odds")
    fair = F.when(F.col("p_push") < 1, F.col("p_win") / (1.0 - F.col("p_push")))
    return {
        "fair_prob": half_up(fair, 4), "implied_prob": half_up(O.implied_prob("odds"), 4),
        "ev_pct": half_up((F.col("p_win") * (dec - 1.0) - F.col("p_lose")) * 100.0, 2),
        "quarter_kelly_pct": half_up(O.quarter_kelly(F.col("p_win"), F.col("p_push"), dec) * 100.0, 2),
        "fair_odds": O.fair_american(fair),
    }


EV_COLUMNS = ["book", "player_name", "category", "team", "side", "line", "odds", "fair_prob", "implied_prob", "ev_pct",
              "quarter_kelly_pct", "fair_odds", "ref_books", "ref_lines", "ref_lo", "ref_hi", "ref_line",
              "same_line_refs", "best_other_same_line", "line_adjusted", "market", "model"]


def find_ev_two_way(quotes: DataFrame, target_books: Sequence[str] = TARGET_BOOKS, min_refs: int = 3,
                    max_shift_sd: float = 0.5) -> DataFrame:
    """Fair price of every target quote from the other books, both sides, with expected value and stake size."""
    prop = prop_of(quotes)
    two_way = drop_pickem(with_lower_book(quotes)).where(
        F.col("line").isNotNull() & F.col("over_odds").isNotNull() & F.col("under_odds").isNotNull()
        & ~F.col("category").isin(O.ONE_WAY_CATEGORIES))
    rows = _fair_lines(two_way, target_books, min_refs, max_shift_sd)
    same = F.col("model") == "same_line"
    rows = rows.withColumn("__o", outcome_batch(F.col("model"), F.col("param"), F.col("sd"), F.col("line"))).withColumns({
        "p_over": F.when(same, F.col("param")).otherwise(1.0 - F.col("__o.under") - F.col("__o.push")),
        "p_under": F.when(same, 1.0 - F.col("param")).otherwise(F.col("__o.under")),
        "p_push": F.when(same, F.lit(0.0)).otherwise(F.col("__o.push")),
        "same_line_refs": F.coalesce(F.col("same_line_refs"), F.lit(0)),
        "line_adjusted": ~same & ((F.col("ref_lo") != F.col("line")) | (F.col("ref_hi") != F.col("line"))),
        "market": F.lit("two-way")})
    keep = ["book", *prop, "team", "line", "ref_books", "ref_lines", "ref_lo", "ref_hi", "ref_line", "same_line_refs",
            "line_adjusted", "market", "model"]
    sides = _both_sides(rows, keep)
    return sides.withColumns(_priced(sides)).select(*EV_COLUMNS, *snapshot_of(quotes))


DEFAULT_HOLDS = {"touchdowns": 0.06, "first-touchdown-scorer": 0.20, "last-touchdown-scorer": 0.20}


def find_ev_one_way(quotes: DataFrame, target_books: Sequence[str] = TARGET_BOOKS, min_refs: int = 3,
                    holds: dict[str, float] | None = None) -> DataFrame:
    """Yes-only markets: fair probability = median implied probability of the other books less an assumed margin."""
    prop = prop_of(quotes)
    holds = holds or DEFAULT_HOLDS
    hold_of = map_literal(holds)
    one_way = drop_pickem(with_lower_book(quotes)).where(
        F.col("category").isin(list(holds)) & F.col("over_odds").isNotNull())
    by_target = [*prop, "target_book"]
    fair = quotes_against_targets(one_way, target_books).groupBy(*by_target).agg(
        F.median(O.implied_prob("over_odds")).alias("__fair"), F.count(F.lit(1)).alias("ref_books"),
        _best(O.implied_prob("over_odds"), "book", "over_odds").alias("b")).where(F.col("ref_books") >= min_refs)
    targets = one_way.where(F.col("book").isin(list(target_books))).withColumn("target_book", F.col("book"))
    rows = attach(targets, fair, by_target, "inner")
    p = F.col("__fair") / (1.0 + hold_of[F.col("category")])
    rows = rows.withColumn("odds", F.col("over_odds")).withColumn("p_win", p).withColumn("p_lose", 1.0 - F.col("p_win")
                                                                               ).withColumn("p_push", F.lit(0.0))
    rows = rows.withColumns({
        **_priced(rows), "side": F.lit("Yes"), "ref_lines": F.lit(""), "ref_lo": F.lit(None).cast("double"),
        "ref_hi": F.lit(None).cast("double"), "ref_line": F.lit(None).cast("double"), "same_line_refs": F.col("ref_books"),
        "best_other_same_line": F.concat_ws(" ", F.col("b.book"), signed_odds("b.over_odds")),
        "line_adjusted": F.lit(False), "market": F.lit("one-way"),
        "model": F.concat(F.lit("hold="), F.round(hold_of[F.col("category")] * 100).cast("int").cast("string"), F.lit("%"))})
    return rows.select(*EV_COLUMNS, *snapshot_of(quotes))


def overround(quotes: DataFrame, games: DataFrame, min_players: int = 10) -> DataFrame:
    """Per category and book: median over games of the summed implied probability of first/last scorer prices."""
    sub = drop_pickem(with_lower_book(quotes)).where(
        F.col("category").isin("first-touchdown-scorer", "last-touchdown-scorer") & F.col("over_odds").isNotNull())
    home = first_rows(games.where(F.col("team").isNotNull() & F.col("opponent").isNotNull()), ["player_name"],
                      ["team", "opponent"])
    home = home.select("player_name", F.concat_ws("-", F.least("team", "opponent"), F.greatest("team", "opponent")).alias("game"))
    sums = sub.join(home, "player_name").groupBy("category", "book", "game", *snapshot_of(quotes)).agg(
        F.sum(O.implied_prob("over_odds")).alias("__s"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_players)
    games = sums.groupBy("category", "book").agg(F.count(F.lit(1)).alias("games"))
    return attach(games, split_median(sums, ["category", "book"], "__s", "__m"), ["category", "book"]).select(
        "category", "book", half_up("__m", 3).alias("overround"), "games")


def confidence(bets: DataFrame, news: DataFrame | None = None, min_ev_pct: float | None = 2.0,
               max_ev_pct: float | None = None) -> DataFrame:
    """'check' when the reference lines disagree or there is player/teammate news, else 'clean', with the reasons."""
    mid = (F.col("ref_lo") + F.col("ref_hi")) / 2.0 if "ref_line" not in bets.columns else F.col("ref_line")
    spread = (F.col("ref_hi") - F.col("ref_lo")) / O.stat_sd("category", mid)
    disagree = F.when(spread >= O.REF_SPREAD_SD, F.concat(
        F.lit("books disagree ("), F.col("ref_lines"), F.lit(", "), F.format_string("%.1f", spread), F.lit(" sd)")))
    if news is not None:
        bets = attach(bets, news.select("player_name", "team", "news"), ["player_name", "team"])
    else:
        bets = bets.withColumn("news", F.lit(None).cast("string"))
    reason = F.concat_ws("; ", disagree, F.col("news"))
    out = bets.withColumn("check_reason", reason).drop("news").withColumn(
        "confidence", F.when(F.col("check_reason") == "", F.lit("clean")).otherwise(F.lit("check")))
    if min_ev_pct is not None:
        out = out.where(F.col("ev_pct") >= min_ev_pct)
    return out if max_ev_pct is None else out.where(F.col("ev_pct") <= max_ev_pct)


# --- news context -------------------------------------------------------------------------------------------------

OUT_STATUSES = ["out", "doubtful", "ir", "inactive", "suspended", "pup"]
WATCH_STATUSES = [*OUT_STATUSES, "questionable"]


def injury_status(first: DataFrame, second: DataFrame) -> DataFrame:
    """(name_key, team) -> status; the second source overrides the first, later rows override earlier ones."""
    tag = lambda df, p: df.select(normalize_name("player_name").alias("name_key"), F.lower("team").alias("team"),
                                  F.lower("status").alias("status"), F.lit(p).alias("__p"), "src_pos")
    stacked = tag(first, 1).unionByName(tag(second, 2))
    return first_rows(stacked, ["name_key", "team"], [F.desc("__p"), F.desc("src_pos"), F.desc("status")]).select(
        "name_key", "team", "status")


def key_players(usage: DataFrame, recent_games: int = 6, target_share: float = 15.0, carry_share: float = 30.0) -> DataFrame:
    """Recent shares on the player's latest team and whether they make a key player. `usage` holds the last two
    seasons, one row per (name_key, year, week)."""
    totals = usage.groupBy("team", "year", "week").agg(F.sum("carries").alias("__tc"))
    u = attach(usage, totals, ["team", "year", "week"])
    u = u.withColumn("carry_share", F.when(F.col("__tc") > 0, F.col("carries") * 100.0 / F.col("__tc"))).drop("__tc")
    recent = first_rows(u, ["name_key"], [F.desc("year"), F.desc("week"), F.desc("team")], recent_games, rank_col="__age")
    last = recent.where("__age = 1").select("name_key", F.col("team").alias("__last"))
    same = attach(recent, last, ["name_key"]).where(F.col("team") == F.col("__last"))
    newest = lambda c: F.max_by(c, -F.col("__age"))
    agg = same.groupBy("name_key").agg(
        newest("name").alias("name"), newest("team").alias("team"), newest("position").alias("position"),
        F.avg("target_share").alias("target_share"), F.avg("carry_share").alias("carry_share"),
        newest("offense_pct").alias("last_snap"))
    is_key = (F.coalesce(F.col("target_share") >= target_share, F.lit(False))
              | F.coalesce(F.col("carry_share") >= carry_share, F.lit(False))
              | F.coalesce((F.col("position") == "QB") & (F.col("last_snap") >= 80), F.lit(False)))
    return agg.withColumn("is_key", is_key)


def news_for(props: DataFrame, injuries: DataFrame, players: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(player_name, team, *scope, news): the player's own status and key teammates who are out, joined by '; '.

    A team's note is written once, with the place of each player's part in it, and a player's own part is cut out by its place. `scope` names further
    columns that tell rosters of one team apart (a league, a season); a roster is bounded, so texts grow with the rows.
    """
    roster = ["team", *scope]
    keyed = props.select("player_name", *roster).distinct().withColumn("name_key", normalize_name("player_name"))
    inj = injuries.select("name_key", "status", F.col("team").alias("__team"), *[F.col(c).alias(f"__{c}") for c in scope])

    def with_status(df: DataFrame, how: str) -> DataFrame:
        on = [df.name_key == inj.name_key, F.lower(df.team) == inj["__team"], *[df[c] == inj[f"__{c}"] for c in scope]]
        return df.join(inj, on, how).drop(inj.name_key).drop("__team", *[f"__{c}" for c in scope])

    text = F.concat(F.lit("teammate "), F.col("name"), F.lit(" "), F.col("status"))
    out = with_status(players.where("is_key").select("name_key", "name", *roster), "inner").where(F.col("status").isin(OUT_STATUSES)).withColumn("text", text)
    order = ["name", "name_key", "status"]
    note = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda m: m["text"]), "; ")
    notes = out.groupBy(*roster).agg(note.alias("note"))
    before = F.sum(F.length("text") + 2).over(Window.partitionBy(*roster).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    places = out.select(*roster, "name_key", F.coalesce(before, F.lit(0)).alias("start"), F.length("text").alias("size"))
    rows = attach(attach(with_status(keyed, "left"), notes, roster), places, [*roster, "name_key"])
    head, tail = F.expr("substring(note, 1, start)"), F.expr("substring(note, start + size + 3)")
    others = F.when(F.col("start").isNull(), F.col("note")).when(tail != "", F.concat(head, tail)).otherwise(F.expr("substring(note, 1, greatest(start - 2, 0))"))
    mine = F.when(F.col("status").isin(WATCH_STATUSES), F.concat(F.col("status"), F.lit(" himself")))
    news = F.concat_ws("; ", mine, F.when(others != "", others))
    return rows.select("player_name", *roster, F.when(news != "", news).alias("news"))


# --- low lines ----------------------------------------------------------------------------------------------------

SHRINK_GAMES, LOOKBACK_GAMES, HALF_LIFE_GAMES = 6, 16, 4


def low_lines(quotes: DataFrame, stats: DataFrame, target_books: Sequence[str] = TARGET_BOOKS, max_line: float = 1.0,
              since: int = 2025, seasons: tuple[int, int] = (2025, 2026)) -> DataFrame:
    """Low lines priced from the other books at the same line, shrunk toward the player's recent hit rate.

    `stats` has one row per (name_key, year, week)."""
    market = drop_pickem(only_available(with_lower_book(quotes))).where(
        F.col("category").isin(list(LOW_LINE_PARTS)) & F.col("line").isNotNull() & F.col("over_odds").isNotNull())
    market = market.withColumn("name_key", normalize_name("player_name"))
    prop = ["name_key", "category", "line", "target_book", *snapshot_of(quotes)]
    refs = quotes_against_targets(market.where(F.col("under_odds").isNotNull()), target_books).groupBy(*prop).agg(
        F.median(O.novig_over("over_odds", "under_odds")).alias("__ref"), F.count(F.lit(1)).alias("__refs"))
    targets = market.where(F.col("book").isin(list(target_books)) & (F.col("line") <= max_line)).withColumn(
        "target_book", F.col("book"))
    t = attach(targets, refs, prop)
    own = F.when(F.col("under_odds").isNotNull(), O.novig_over("over_odds", "under_odds"))
    t = t.withColumn("market_over", F.coalesce(F.col("__ref"), own)).withColumn(
        "market_source", F.when(F.col("__refs").isNotNull(), F.concat(F.col("__refs").cast("string"), F.lit(" other book(s)")))
        .when(own.isNotNull(), F.lit("own book")).otherwise(F.lit("none")))

    logs = stats.where(F.col("year") >= since)
    players = logs.select("name_key", "team").distinct().withColumn(
        "last_name", F.element_at(F.split(F.col("name_key"), " "), -1))
    t = match_player(t, players)

    newest = first_rows(logs, ["name_key"], [F.desc("year"), F.desc("week"), F.desc("team")], LOOKBACK_GAMES, rank_col="__age")
    base = newest.groupBy("name_key").agg(
        F.count(F.lit(1)).alias("n"), half_up(F.avg("rec_tgt"), 1).alias("avg_targets"),
        half_up(F.avg("rush_att"), 1).alias("avg_carries"), F.max_by("team", -F.col("__age")).alias("team_now"),
        F.max_by("snap_pct", F.when(F.col("snap_pct").isNotNull() | (F.col("__age") == 1), -F.col("__age"))).alias("last_snap_pct"),
        F.max_by("team", F.when(F.col("year") == seasons[0], -F.col("__age"))).alias("__t0"),
        F.max_by("team", F.when(F.col("year") == seasons[1], -F.col("__age"))).alias("__t1"))
    base = base.withColumn("team_changed", F.coalesce(F.col("__t0") != F.col("__t1"), F.lit(False))).drop("__t0", "__t1")

    # Hits depend on (player, category, line): distinct combinations meet the player's last games once.
    values = unpivot_stats(newest.withColumn("__yw", F.col("__age")), LOW_LINE_PARTS, ["name_key", "__yw"])
    asked = t.where(F.col("matched_key").isNotNull()).select(F.col("matched_key").alias("name_key"), "category", "line").distinct()
    w = F.pow(F.lit(0.5), (F.col("__yw") - 1) / F.lit(float(HALF_LIFE_GAMES)))
    hit = F.when(F.col("value") > F.col("line"), F.lit(1.0)).otherwise(F.lit(0.0))
    hits = asked.join(values, ["name_key", "category"]).groupBy("name_key", "category", "line").agg(
        F.sum(hit).alias("__hits"), F.sum(F.when(F.col("__yw") <= 3, hit)).alias("__hits3"),
        F.sum(w).alias("__w"), F.sum(w * hit).alias("__wh"))

    # Unmatched quotes get keys of their own that match no player, so they do not meet in one task.
    alone = F.concat(F.lit("~"), F.col("name_key"), F.lit("|"), F.col("book"), *[F.col(s).cast("string") for s in snapshot_of(quotes)])
    t = t.withColumn("matched_key", F.coalesce("matched_key", alone))
    rows = attach(t.withColumnRenamed("name_key", "quote_key").withColumnRenamed("matched_key", "name_key"), base, ["name_key"])
    rows = attach(rows, hits, ["name_key", "category", "line"])
    rows = rows.withColumn("team", F.when(F.col("n").isNotNull(), F.col("team_now")).otherwise(F.col("team")))
    rows = attach(rows, team_context(logs), ["team"])
    over = F.struct(F.lit("Over").alias("side"), F.col("over_odds").alias("odds"), F.col("market_over").alias("m"),
                    F.col("__wh").alias("wh"), F.col("__hits").alias("h"), F.col("__hits3").alias("h3"))
    under = F.struct(F.lit("Under").alias("side"), F.col("under_odds").alias("odds"), (1.0 - F.col("market_over")).alias("m"),
                     (F.col("__w") - F.col("__wh")).alias("wh"), (F.col("n") - F.col("__hits")).alias("h"),
                     (F.least(F.col("n"), F.lit(3)) - F.col("__hits3")).alias("h3"))
    s = rows.withColumn("s", F.explode(F.array(over, under))).where(F.col("s.odds").isNotNull())
    m, wh, weight = F.col("s.m"), F.col("s.wh"), F.col("__w")
    model = (F.when(wh.isNotNull() & m.isNotNull(), (wh + SHRINK_GAMES * m) / (weight + SHRINK_GAMES))
             .when(wh.isNotNull(), wh / weight).otherwise(m))
    frac = lambda h, n: F.when(h.isNotNull(), F.concat_ws("/", h.cast("int").cast("string"), n.cast("string"))
                               ).otherwise(F.lit(""))
    return s.select(
        "book", "player_name", "team", "category", "line", F.col("s.side").alias("side"), F.col("s.odds").alias("odds"),
        half_up(O.implied_prob("s.odds"), 3).alias("implied_prob"), half_up(model, 3).alias("model_prob"),
        half_up((model * O.decimal_odds("s.odds") - 1.0) * 100.0, 1).alias("ev_pct"),
        frac(F.col("s.h"), F.col("n")).alias("hist_rate"), half_up(wh / weight, 3).alias("weighted_rate"),
        frac(F.col("s.h3"), F.least(F.col("n"), F.lit(3))).alias("last3_rate"), half_up(m, 3).alias("market_prob"),
        "market_source", "avg_targets", "avg_carries", "last_snap_pct", "team_changed", "team_pass_att_pg",
        "players_with_catch_pg", *snapshot_of(quotes))


# --- stale lines --------------------------------------------------------------------------------------------------

MIN_MOVE_SD, MIN_TD_PP, LAG_RATIO = 0.5, 4.0, 0.34
PULLED_SHARE, PULLED_MIN_BOOKS, NEWS_MIN_PROPS = 0.67, 3, 3
# Texts of the notes.
NOTE_UP = "other books %s pts, this book %s; EV vs other books' vig-included price"
NOTE_DOWN = "other books %s pts (role shrank?), this book %s; still priced for the old role"
NOTE_LINE = "other books moved %s sd, this book %s sd (line %s -> %s)"
NOTE_PULLED = "%d%% of other books pulled this prop; check news"


def line_moves(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Move of every (prop, book) quoted live in both snapshots, in standard deviations or percentage points."""
    prop = prop_of(baseline)
    b = drop_pickem(only_available(with_lower_book(baseline))).select(
        *prop, "book", F.col("line").alias("line_b"), F.col("over_odds").alias("over_b"), F.col("under_odds").alias("under_b"))
    c = drop_pickem(with_lower_book(current)).where(is_available()).select(
        *prop, "book", F.col("line").alias("line_c"), F.col("over_odds").alias("over_c"), F.col("under_odds").alias("under_c"))
    both = b.join(c, [*prop, "book"])
    td = F.col("category") == "touchdowns"
    priced = ["over_b", "over_c"]
    full = [*priced, "line_b", "line_c", "under_b", "under_c"]
    ok = lambda cols: F.array_min(F.array(*[F.col(x).isNotNull() for x in cols]))
    both = settled(both.where((td & ok(priced)) | (~F.col("category").isin(O.ONE_WAY_CATEGORIES) & ok(full))), "quote-pairs")
    mid = both.groupBy(*prop).agg(F.median("line_b").alias("__mid"))
    both = attach(both, mid, prop)
    td = F.col("category") == "touchdowns"
    both = both.withColumns({
        "__sd": O.stat_sd("category", F.col("__mid")),
        "__model": F.when(O.category_model("category") == "poisson", F.lit("poisson")).otherwise(F.lit("normal")),
        "__pb": O.novig_over("over_b", "under_b"), "__pc": O.novig_over("over_c", "under_c")})
    both = both.where(td | F.col("__sd").isNotNull())
    pp = 100.0 * (O.implied_prob("over_c") - O.implied_prob("over_b"))
    centre = lambda x: fit_param(F.col("__model"), F.col("__sd"), F.col(f"line_{x}"), F.col(f"__p{x}"))
    move = F.when(td, pp).otherwise((centre("c") - centre("b")) / F.col("__sd"))
    return both.withColumn("move", move).where(F.col("move").isNotNull()).withColumn(
        "unit", F.when(td, F.lit("pp")).otherwise(F.lit("sd"))).drop("__mid", "__sd", "__model", "__pb", "__pc")


def consensus_moves(moves: DataFrame, current: DataFrame, target_books: Sequence[str] = TARGET_BOOKS) -> DataFrame:
    """Median move of the non-target books per prop with at least two of them, above the news threshold."""
    prop = prop_of(moves)
    others = moves.where(~F.col("book").isin(list(target_books))).groupBy(*prop, "unit").agg(
        F.median("move").alias("consensus"), F.count(F.lit(1)).alias("others"),
        F.median(O.implied_prob("over_c")).alias("others_implied"))
    limit = F.when(F.col("unit") == "pp", F.lit(MIN_TD_PP)).otherwise(F.lit(MIN_MOVE_SD))
    team = current.groupBy(*prop).agg(F.min("team").alias("team"))
    return attach(others.where((F.col("others") >= 2) & (F.abs("consensus") >= limit)), team, prop)


def stale_lines(baseline: DataFrame, current: DataFrame, target_books: Sequence[str] = TARGET_BOOKS) -> DataFrame:
    """Target quotes lagging a market move, quotes still priced for an old role, and props pulled elsewhere, each with a note.

    The moves and the current quotes are settled once; consensus, lag, prices and pulled shares are told from them."""
    prop = prop_of(baseline)
    current = settled(current.select(*prop, "team", "book", "line", "over_odds", "under_odds", "available"), "current-quotes")
    moves = settled(line_moves(baseline, current), "moves")
    cons = consensus_moves(moves, current, target_books)
    mine = attach(moves.where(F.col("book").isin(list(target_books))), cons.drop("unit"), prop, "inner")
    direction = F.when(F.col("consensus") > 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    lag = settled(mine.where(F.col("move") * direction < LAG_RATIO * F.abs("consensus")), "lagging")
    # Only props with a lagging quote are priced.
    live = with_lower_book(current).where(is_available()).join(lag.select(*prop), prop, "left_semi")
    ev = find_ev_two_way(live, target_books, min_refs=2, max_shift_sd=10.0).groupBy("book", *prop, "side", "line").agg(
        F.max("ev_pct").alias("__ev"))
    td, up = F.col("category") == "touchdowns", F.col("consensus") > 0
    lag = lag.withColumns({
        "side": F.when(td | up, F.lit("Over")).otherwise(F.lit("Under")),
        "line": F.when(td, F.lit(0.5)).otherwise(F.col("line_c"))})
    lag = attach(lag, ev, ["book", *prop, "side", "line"])
    td_ev = half_up((F.col("others_implied") * O.decimal_odds("over_c") - 1.0) * 100.0, 1)
    number = lambda c, digits, sign="+": F.format_string(f"%{sign}.{digits}f", half_up(c, digits))
    plain = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    note = (F.when(td & up, F.format_string(NOTE_UP, number("consensus", 1), number("move", 1)))
            .when(td, F.format_string(NOTE_DOWN, number("consensus", 1, ""), number("move", 1)))
            .otherwise(F.format_string(NOTE_LINE, number("consensus", 2), number("move", 2), plain("line_b"), plain("line_c"))))
    lagging = lag.select(
        F.when(td & ~up, F.lit("lagging, avoid")).otherwise(F.lit("lagging")).alias("flag"), "book", *prop, "team", "side",
        "line", F.when(F.col("side") == "Over", F.col("over_c")).otherwise(F.col("under_c")).alias("odds"),
        F.when(~td, F.col("__ev")).when(up, td_ev).alias("ev_pct"),
        half_up("consensus", 2).alias("market_move"), half_up("move", 2).alias("book_move"), "unit", note.alias("note"),
        F.lit(None).cast("double").alias("pulled_share"))
    return lagging.unionByName(pulled_elsewhere(baseline, current, target_books))


def pulled_elsewhere(baseline: DataFrame, current: DataFrame, target_books: Sequence[str] = TARGET_BOOKS) -> DataFrame:
    """Target books still offering a prop that at least two thirds of three or more other books took down, with that share."""
    prop = prop_of(baseline)
    cur = drop_pickem(with_lower_book(current)).withColumn("__live", is_available())
    known = drop_pickem(only_available(with_lower_book(baseline))).select(*prop).distinct()
    mine = F.col("book").isin(list(target_books))
    share = cur.groupBy(*prop).agg(
        F.count_if(~mine).alias("__n"), F.count_if(~mine & ~F.col("__live")).alias("__down"), F.min("team").alias("__team"))
    share = share.where((F.col("__n") >= PULLED_MIN_BOOKS) & (F.col("__down") >= PULLED_SHARE * F.col("__n")))
    rows = attach(cur.where(mine & F.col("__live")), share, prop, "inner").join(known, prop, "left_semi")
    null = F.lit(None)
    pulled = F.col("__down") / F.col("__n")
    note = F.format_string(NOTE_PULLED, half_up(pulled * 100.0, 0).cast("int"))
    return rows.select(F.lit("pulled elsewhere").alias("flag"), "book", *prop, F.col("__team").alias("team"),
                       F.lit("Over").alias("side"), "line", F.col("over_odds").alias("odds"),
                       null.cast("double").alias("ev_pct"), null.cast("double").alias("market_move"),
                       null.cast("double").alias("book_move"), null.cast("string").alias("unit"), note.alias("note"),
                       half_up(pulled, 4).alias("pulled_share"))


def news_clusters(cons: DataFrame, top: int = 4) -> DataFrame:
    """Teams with three or more moved props, with their largest movers."""
    prop = prop_of(cons)
    sizes = cons.groupBy("team", *snapshot_of(cons)).agg(F.count(F.lit(1)).alias("props")).where(F.col("props") >= NEWS_MIN_PROPS)
    big = first_rows(cons, ["team", *snapshot_of(cons)], [F.abs("consensus").desc(), *prop], top, rank_col="mover_rank")
    return attach(big, sizes, ["team", *snapshot_of(cons)], "inner").select(
        "team", "props", "mover_rank", *prop, half_up("consensus", 2).alias("move"), "unit")


def pulled_players(flags: DataFrame, news_teams: DataFrame) -> DataFrame:
    """Per player: books that still list a prop the others pulled, markets concerned, and whether the team has news."""
    pulled = flags.where(F.col("flag") == "pulled elsewhere").groupBy("player_name", "team", *snapshot_of(flags)).agg(
        F.array_join(F.array_sort(F.collect_set("book")), ", ").alias("books"), F.countDistinct("category").alias("markets"))
    teams = news_teams.select("team").distinct().withColumn("__news", F.lit(True))
    return attach(pulled, teams, ["team"]).withColumn("team_news", F.coalesce("__news", F.lit(False))).drop("__news")


# --- weather, candidates ------------------------------------------------------------------------------------------

PASSING_CATEGORIES = ["passing-yards", "completions", "pass-attempts", "longest-completion", "passing-and-rushing-yards"]
RUSHING_CATEGORIES = ["rushing-yards", "rush-attempts", "longest-rush"]


def game_weather(weather: DataFrame) -> DataFrame:
    """One row per team: roof at the home stadium, forecast and effect note; forecasts are ignored under a dome."""
    from chalkline.functions.conditions import weather_effect
    from chalkline.functions.teams import roof_type

    w = weather.withColumn("roof", F.coalesce(roof_type("home_team"), F.lit("outdoor")))
    open_air = F.col("roof") != "dome"
    w = w.withColumns({"forecast_wind_mph": F.when(open_air, F.col("wind_mph").cast("double")),
                       "forecast_temp_f": F.when(open_air, F.col("temp_f").cast("double"))})
    w = w.withColumn("e", weather_effect(F.col("roof"), F.col("forecast_wind_mph"), F.col("forecast_temp_f")))
    return w.select("year", "week", F.explode(F.array("home_team", "away_team")).alias("team"), "home_team", "roof",
                    "forecast_wind_mph", "forecast_temp_f", "condition", "e.weather_note", "e.bad_passing_weather")


def annotate_weather(bets: DataFrame, weather: DataFrame, on: Sequence[str] = ("team",)) -> DataFrame:
    """Add the team's weather and whether it speaks for or against the bet; older weather columns are replaced."""
    stale = [c for c in [*weather.columns, "weather_lean"] if c not in on and c in bets.columns]
    out = attach(bets.drop(*stale), weather, list(on))
    category = F.col("category") if "category" in bets.columns else F.lit("touchdowns")
    side = F.col("side") if "side" in bets.columns else F.lit("Over")
    passing, rushing = category.isin(PASSING_CATEGORIES), category.isin(RUSHING_CATEGORIES)
    bad = F.coalesce(F.col("bad_passing_weather"), F.lit(False))
    lean = (F.when(bad & ((passing & (side == "Over")) | (rushing & (side == "Under"))), F.lit("against"))
            .when(bad & ((passing & (side == "Under")) | (rushing & (side == "Over"))), F.lit("with")).otherwise(F.lit("")))
    return out.withColumn("weather_lean", lean)


# Why a category cannot become a contest prop.
UNSUPPORTED_REASONS = {
    "first-touchdown-scorer": "needs play order", "last-touchdown-scorer": "needs play order",
    "longest-reception": "no single-play stats", "longest-rush": "no single-play stats",
    "longest-completion": "no single-play stats", "kicking-points": "no kicker stats",
}


def to_candidates(props: DataFrame) -> DataFrame:
    """Props of supported categories with their contest field; over line first, touchdowns become over 0.5."""
    fields = map_literal(CATEGORY_FIELDS)
    line = F.when(F.col("category") == "touchdowns", F.lit(0.5)).otherwise(F.coalesce("over_line", "under_line"))
    return props.withColumn("stat_field", fields[F.col("category")]).where(F.col("stat_field").isNotNull()).withColumn("line", line)


def skipped_categories(props: DataFrame) -> DataFrame:
    known = map_literal(UNSUPPORTED_REASONS)
    rest = props.where(~F.col("category").isin(list(CATEGORY_FIELDS)))
    return rest.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "reason", F.coalesce(known[F.col("category")], F.lit("unknown category")))


# --- touchdown bets -----------------------------------------------------------------------------------------------

def td_bets(quotes: DataFrame, features: DataFrame, params: dict, totals: DataFrame, year: int,
            target_books: Sequence[str] = TARGET_BOOKS, news: DataFrame | None = None) -> DataFrame:
    """Anytime-touchdown quotes priced by the touchdown model next to the other books' robust median.

    `features` has one row per player (shares incl. the latest game, prior_games, last year/week/team, teams_played);
    `totals` is (team, implied_total)."""
    from chalkline.plans.model import next_game_adjustments, predict_probability

    market = drop_pickem(only_available(with_lower_book(quotes))).where(
        (F.col("category") == "touchdowns") & F.col("over_odds").isNotNull())
    market = market.withColumn("name_key", normalize_name("player_name"))
    feats = features.withColumn("last_name", F.element_at(F.split(F.col("name_key"), " "), -1))
    group = ["name_key", "team"]
    players = market.groupBy(*group).agg(F.min("player_name").alias("display"))
    players = match_player(players, feats, require_single=True).where(F.col("matched_key").isNotNull())
    f = feats.select(*[F.col(c).alias({"team": "last_team", "name_key": "matched_key", "year": "last_year",
                                       "week": "last_week"}.get(c, c)) for c in feats.columns if c not in ("name", "last_name")])
    rows = players.join(f, "matched_key").join(totals, "team")
    rows = rows.where((F.col("prior_games") >= params["min_prior_games"]) & (F.col("last_year") >= year - 1))
    rows = next_game_adjustments(rows, F.col("team"), F.lit(year), params["halflife"], F.col("last_year"))
    rows = rows.withColumn("p", predict_probability(params))
    if news is not None:
        rows = attach(rows, news.select(F.col("player_name").alias("display"), "team", "news"), ["display", "team"])
    else:
        rows = rows.withColumn("news", F.lit(None).cast("string"))
    snaps = F.col("offense_pct")
    reasons = F.concat_ws(
        "; ", F.when(F.col("last_year") < year, F.lit("no game this season")),
        F.when(snaps.isNull() | (snaps <= 20), F.concat(F.coalesce(F.floor(snaps + 0.5).cast("bigint").cast("string"), F.lit("nan")),
                                                       F.lit("% snaps last game"))),
        F.when(F.col("adj_new_team") > 0.25, F.lit("new team")), F.col("news"))
    rows = rows.withColumn("check_reason", reasons)

    by_target = [*group, "target_book", *snapshot_of(quotes)]
    others = quotes_against_targets(market, target_books).withColumn("__p", O.implied_prob("over_odds"))
    med = robust_median(others, by_target, "__p", 2.5, "other_implied", "other_books")
    t = market.where(F.col("book").isin(list(target_books))).withColumn("target_book", F.col("book"))
    t = attach(attach(t, med, by_target), rows.drop("display"), group, "inner")
    return t.select(
        "book", "player_name", "team", "position", F.col("over_odds").alias("odds"),
        half_up(O.implied_prob("over_odds"), 3).alias("implied_prob"), half_up("p", 3).alias("model_prob"),
        O.fair_american(F.col("p")).alias("fair_odds"),
        half_up((F.col("p") * O.decimal_odds("over_odds") - 1.0) * 100.0, 1).alias("ev_pct"),
        half_up("other_implied", 3).alias("other_books_implied"), F.coalesce("other_books", F.lit(0)).alias("other_books"),
        half_up((F.col("p") - F.col("other_implied")) * 100.0, 1).alias("gap_pp"),
        half_up("implied_total", 1).alias("implied_team_total"), half_up("share_carries", 3).alias("carry_share"),
        half_up("share_targets", 3).alias("target_share"), half_up("share_tds", 3).alias("td_share"),
        F.col("prior_games").alias("games"),
        F.concat(F.col("last_year").cast("string"), F.lit(" wk"), F.col("last_week").cast("string"), F.lit(" "),
                 F.col("last_team")).alias("last_game"),
        F.col("offense_pct").alias("last_snap_pct"), (F.col("adj_new_team") > 0.25).alias("new_team"),
        F.when(F.col("check_reason") == "", F.lit("clean")).otherwise(F.lit("check")).alias("confidence"), "check_reason", *snapshot_of(quotes))
