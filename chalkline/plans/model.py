"""Touchdown model: features from usage history, prediction, distributed fitting and evaluation.

P(score) = 1 - exp(-lambda), lambda = exp(a + b ln T) * (shares . weights) * exp(adjustments . coefficients),
with T the team's implied total. Prediction is Column arithmetic. Fitting keeps the data on the executors: one pass over
the training rows returns the loss, its gradient and a 14 x 14 curvature matrix, and the driver takes the step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.conditions import home_spread, implied_team_total, total_value
from chalkline.functions.teams import map_literal, normalize_team
from chalkline.functions.values import half_up, ratio, zero_if_null
from chalkline.operators.aggregates import calibration, log_loss_of
from chalkline.operators.ordered import attach, attach_totals, ewm_mean, first_rows, stint_features
from chalkline.sources.derived import settled

POSITIONS = ["QB", "RB", "WR", "TE", "FB"]
COUNTS = ["carries", "targets", "rz_carries", "rz_targets", "i10_carries", "i10_targets", "tds"]
SHARES = [f"share_{c}" for c in COUNTS]
ADJUSTMENTS = ["adj_qb", "adj_te", "adj_fb", "adj_new_team", "adj_new_season", "adj_snap_trend", "adj_low_snap"]
LOW_SNAP_PCT = 20
CLIP, RATE_FLOOR = 1e-4, 1e-6
# The published parameters.
PUBLISHED_PARAMS = {
    "halflife": 4.0, "team_a": -3.329178842304026, "team_b": 1.3218359907990245,
    "weights": {
        "share_carries": 0.20477964405554427, "share_targets": 0.5230903852804039,
        "share_rz_carries": 0.017772771648373275, "share_rz_targets": 0.026023489926485018,
        "share_i10_carries": 0.002151615688859823, "share_i10_targets": 0.0, "share_tds": 0.17272553889910208},
    "adjustments": {
        "adj_qb": 0.5009149428290726, "adj_te": 0.10696447014419531, "adj_fb": 0.035768254382944335,
        "adj_new_team": -0.19569442573739879, "adj_new_season": -0.10203757334877836,
        "adj_snap_trend": 0.9328235814300952, "adj_low_snap": -0.044014204646075195},
    "min_prior_games": 3,
}


def team_games(game_info: DataFrame) -> DataFrame:
    """Two rows per game with each team's implied total, from the spread and total texts; unparsed games are dropped."""
    g = game_info.withColumns({"home": normalize_team("team_home"), "away": normalize_team("team_away")})
    g = g.withColumns({"__s": home_spread("vegas_line", "home", "away"), "__t": total_value("over_under")})
    g = g.where(F.col("__s").isNotNull() & F.col("__t").isNotNull())
    side = lambda team, spread: F.struct(F.col(team).alias("team"),
                                         implied_team_total(spread, F.col("__t"), None).alias("implied_total"))
    return g.select("year", "week", F.inline(F.array(side("home", F.col("__s")), side("away", -F.col("__s")))))


def player_games(usage: DataFrame, stats: DataFrame) -> DataFrame:
    """Usage rows with touchdowns and, per count, the total of the player's team in that game."""
    tds = stats.select("player_id", "year", "week", (zero_if_null("rush_td") + zero_if_null("rec_td")).alias("tds"))
    rows = usage.join(tds, ["player_id", "year", "week"], "left")
    rows = rows.where(F.col("position").isin(POSITIONS) & F.col("player_id").isNotNull())
    rows = rows.withColumns({c: zero_if_null(c).cast("double") for c in COUNTS})
    return attach_totals(rows, ["team", "year", "week"], **{f"team_{c}": F.sum(c) for c in COUNTS})


def _shares(rows: DataFrame, halflife: float, shift: bool) -> DataFrame:
    columns = [*COUNTS, *[f"team_{c}" for c in COUNTS], "offense_pct"]
    rows = ewm_mean(rows, ["player_id"], ["year", "week"], columns, halflife, shift)
    share = lambda c: F.coalesce(F.when(F.col(f"ewm_team_{c}") > 0, ratio(f"ewm_{c}", f"ewm_team_{c}")), F.lit(0.0))
    return rows.withColumns({f"share_{c}": share(c) for c in COUNTS})


def adjustments(stint_games: Column, had_other_team: Column, new_season: Column, last_snap: Column, halflife: float
                ) -> dict[str, Column]:
    """The seven adjustment columns; `position` and `ewm_offense_pct` are read from the row."""
    flag = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    fade = F.pow(F.lit(0.5), stint_games / F.lit(float(halflife)))
    return {
        "adj_qb": flag(F.col("position") == "QB"), "adj_te": flag(F.col("position") == "TE"),
        "adj_fb": flag(F.col("position") == "FB"), "adj_new_team": F.when(had_other_team, fade).otherwise(F.lit(0.0)),
        "adj_new_season": flag(new_season),
        "adj_snap_trend": F.coalesce((last_snap - F.col("ewm_offense_pct")) / 100.0, F.lit(0.0)),
        "adj_low_snap": flag(last_snap <= LOW_SNAP_PCT),
    }


def share_features(pg: DataFrame, halflife: float) -> DataFrame:
    """Shares and adjustments from each player's previous games only. One row per (player, season, week)."""
    from pyspark.sql import Window

    rows = stint_features(_shares(pg, halflife, True), ["player_id"], ["year", "week"])
    w = Window.partitionBy("player_id").orderBy("year", "week")
    rows = rows.withColumn("__snap", F.lag("offense_pct").over(w))
    cols = adjustments(F.col("stint_games"), F.col("stint") > 1, F.col("new_season"), F.col("__snap"), halflife)
    return rows.withColumns(cols).drop("__snap")


def current_features(pg: DataFrame, halflife: float) -> DataFrame:
    """Each player's shares including the latest game, at that game, with games played and the teams in order."""
    rows = _shares(pg, halflife, False)
    last = first_rows(rows, ["player_id"], [F.desc("year"), F.desc("week")])
    # One entry per game of a player: bounded by the calendar.
    teams = F.transform(F.sort_array(F.collect_list(F.struct("year", "week", "team"))), lambda s: s["team"])
    hist = pg.groupBy("player_id").agg(F.count(F.lit(1)).alias("prior_games"), teams.alias("teams_played"))
    return attach(last, hist, ["player_id"])


def next_game_adjustments(rows: DataFrame, next_team: Column, next_year: Column, halflife: float, last_year: Column) -> DataFrame:
    """Adjustments for the coming game: the run of games with the next team at the end of the team list."""
    rows = rows.withColumn("__next", next_team)
    away = F.transform(F.col("teams_played"), lambda t: t != F.col("__next"))
    since = F.array_position(F.reverse(away), True)
    games = F.size("teams_played").cast("double")
    rows = rows.withColumns({"__stint": F.when(since > 0, since - 1).otherwise(games).cast("double"),
                             "__other": F.exists("teams_played", lambda t: t != F.col("__next"))})
    cols = adjustments(F.col("__stint"), F.col("__other"), last_year < next_year, F.col("offense_pct"), halflife)
    return rows.withColumns(cols).drop("__next", "__stint", "__other")


def expected_rate(params: dict) -> Column:
    team = F.exp(F.lit(params["team_a"]) + F.lit(params["team_b"]) * F.log("implied_total"))
    as_lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    share = sum((as_lit(params["weights"][s]) * F.col(s) for s in SHARES), F.lit(0.0))
    adj = sum((as_lit(params["adjustments"][a]) * F.col(a) for a in ADJUSTMENTS), F.lit(0.0))
    return team * share * F.exp(adj)


def predict_probability(params: dict) -> Column:
    return 1.0 - F.exp(-F.greatest(expected_rate(params), F.lit(RATE_FLOOR)))


def predict(rows: DataFrame, params: dict, out: str = "p") -> DataFrame:
    return rows.withColumn(out, predict_probability(params))


def build_dataset(pg: DataFrame, games: DataFrame, halflife: float, min_prior: int = 3, max_week: int = 18) -> DataFrame:
    rows = share_features(pg, halflife).join(games.select("year", "week", "team", "implied_total"), ["year", "week", "team"])
    return rows.where((F.col("prior_games") >= min_prior) & (F.col("week") <= max_week))


def fit_team_tds(games: DataFrame, pg: DataFrame, years: Sequence[int]) -> tuple[float, float]:
    """Poisson regression log(team touchdowns) = a + b log(implied total)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    tds = pg.groupBy("team", "year", "week").agg(F.sum("tds").alias("team_tds"))
    rows = games.join(tds, ["team", "year", "week"]).where(F.col("year").isin(list(years)) & (F.col("implied_total") > 0))
    rows = rows.select("team_tds", F.log("implied_total").alias("x"))
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    fitted = GeneralizedLinearRegression(family="poisson", link="log", labelCol="team_tds", tol=1e-10, maxIter=50).fit(data)
    return float(fitted.intercept), float(fitted.coefficients[0])


Fit = tuple[float, np.ndarray, np.ndarray]


def _passes(train: DataFrame, thetas: dict[int, np.ndarray], a: float, b: float) -> dict[int, Fit]:
    """Mean loss, gradient and Gauss-Newton curvature of every candidate in `thetas` from one pass over its training rows.

    Arrow batches are summed by matrix products, a task gives its sums, and the sums are added up by an aggregate. A mean leaves out the rows where its term is NULL."""
    k, n = len(SHARES), len(SHARES) + len(ADJUSTMENTS)
    columns, floor, clip = [*SHARES, *ADJUSTMENTS], RATE_FLOOR, CLIP

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        upper, total = np.triu_indices(n), {}
        for batch in batches:
            read = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)
            of, tds, implied = read("candidate"), read("tds"), read("implied_total")
            features = np.column_stack([read(c) for c in columns])
            for c, theta in thetas.items():
                at = of == c
                if not at.any():
                    continue
                x, y = features[at], (tds[at] > 0).astype(float)
                with np.errstate(all="ignore"):
                    team = np.exp(a + b * np.log(np.where(implied[at] > 0, implied[at], np.nan)))
                    xw = x[:, :k] @ theta[:k]
                    lam = np.fmax(team * xw * np.exp(x[:, k:] @ theta[k:]), floor)
                    p = np.clip(1.0 - np.exp(-lam), clip, 1.0 - clip)
                    live = (lam > floor) & (p > clip) & (p < 1.0 - clip)
                    d = np.where(live, (p - y) / (p * (1.0 - p)) * np.exp(-lam), 0.0)
                    h = np.where(live, np.exp(-2.0 * lam) / (p * (1.0 - p)), 0.0)
                    j = np.hstack([(lam / np.fmax(xw, 1e-12))[:, None] * x[:, :k], lam[:, None] * x[:, k:]])
                known = (~np.isnan(j)).astype(float)
                j = np.where(known > 0, j, 0.0)
                loss = -np.sum(y * np.log(p) + (1.0 - y) * np.log(1.0 - p))
                part = np.concatenate([[loss], d @ j, ((j * h[:, None]).T @ j)[upper], [len(y)], known.sum(axis=0), (known.T @ known)[upper]])
                total[c] = total.get(c, 0.0) + part
        for c, values in total.items():
            yield pa.RecordBatch.from_pydict({"candidate": pa.array([c] * len(values), pa.int32()), "place": pa.array(range(len(values)), pa.int32()), "value": pa.array(values)})

    rows = train.where(F.col("candidate").isin(list(thetas))).select("candidate", "tds", "implied_total", *columns)
    found: dict[int, dict[int, float]] = {}
    for c, place, value in rows.mapInArrow(sums, "candidate int, place int, value double").groupBy("candidate", "place").agg(F.sum("value")).collect():  # about 240 rows a candidate
        found.setdefault(c, {})[place] = value
    out = {}
    for c, values in found.items():
        every = np.array([values[i] for i in range(len(values))])
        with np.errstate(invalid="ignore"):
            means = every[:len(every) // 2] / every[len(every) // 2:]
        h = np.zeros((n, n))
        h[np.triu_indices(n)] = means[1 + n:]
        out[c] = float(means[0]), means[1:1 + n], h + np.triu(h, 1).T
    return out


LOW = np.array([0.0] * len(SHARES) + [-3.0] * len(ADJUSTMENTS))
HIGH = np.array([np.inf] * len(SHARES) + [3.0] * len(ADJUSTMENTS))


def projected_gradient(theta: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The gradient without what points out of the bounds: zero exactly where the optimality conditions hold."""
    return np.where((theta <= LOW) & (g > 0) | (theta >= HIGH) & (g < 0), 0.0, g)


def fit_candidates(train: DataFrame, a: float, b: float, iterations: int = 60, tolerance: float = 1e-8) -> dict[int, tuple[np.ndarray, float, np.ndarray]]:
    """(parameters, mean loss, projected gradient) for each `candidate` of the settled training rows: share weights >= 0 and adjustment coefficients in [-3, 3], jointly,
    by projected Gauss-Newton steps with backtracking.

    All candidates step together: a step is one distributed aggregate of about 120 sums a candidate. One is done when no entry of its projected gradient exceeds
    `tolerance`, or when no step improves it."""
    k, m = len(SHARES), len(ADJUSTMENTS)
    found = sorted(r[0] for r in train.select("candidate").distinct().collect())
    at = {c: np.array([1.0 / k] * k + [0.0] * m) for c in found}
    fits = _passes(train, at, a, b)
    damping, open_ones = dict.fromkeys(found, 1e-6), set(found)
    for _ in range(iterations):
        open_ones -= {c for c in open_ones if np.abs(projected_gradient(at[c], fits[c][1])).max() <= tolerance or damping[c] > 1e6}
        if not open_ones:
            break
        trials = {}
        for c in open_ones:
            _, g, h = fits[c]
            free = ~((at[c] <= LOW) & (g > 0) | (at[c] >= HIGH) & (g < 0))
            step = np.zeros_like(at[c])
            scale = np.diag(np.maximum(np.diag(h), 1e-9))
            step[free] = np.linalg.solve((h + damping[c] * scale)[np.ix_(free, free)], -g[free])
            trials[c] = np.clip(at[c] + step, LOW, HIGH)
        for c, fit in _passes(train, trials, a, b).items():
            if fit[0] < fits[c][0] or fit[0] == fits[c][0] and np.abs(projected_gradient(trials[c], fit[1])).max() < np.abs(projected_gradient(at[c], fits[c][1])).max():
                at[c], fits[c] = trials[c], fit
                damping[c] = max(damping[c] / 4, 1e-9)
            else:
                damping[c] = max(damping[c] * 10, 1e-4)
    return {c: (at[c], fits[c][0], projected_gradient(at[c], fits[c][1])) for c in found}


def as_params(theta: np.ndarray) -> tuple[dict, dict]:
    k = len(SHARES)
    return dict(zip(SHARES, map(float, theta[:k]))), dict(zip(ADJUSTMENTS, map(float, theta[k:])))


TRAIN_COLUMNS = ["tds", "implied_total", *SHARES, *ADJUSTMENTS]


def fit_weights(train: DataFrame, a: float, b: float, iterations: int = 60, tolerance: float = 1e-8) -> tuple[dict, dict, float]:
    """(share weights, adjustment coefficients, mean loss) of one set of training rows."""
    rows = settled(train.select(F.lit(0).alias("candidate"), *TRAIN_COLUMNS), "training")
    theta, loss, _ = fit_candidates(rows, a, b, iterations, tolerance)[0]
    return *as_params(theta), loss


def halflife_candidates(pg: DataFrame, games: DataFrame, train_years: Sequence[int], test_years: Sequence[int],
                        candidates: Sequence[float] = (3.0, 5.0, 8.0, 12.0), min_prior: int = 3) -> list[dict]:
    """For each half-life its parameters, fitted together with all others, the largest entry of the projected gradient and the test log loss."""
    pg, games = settled(pg, "player-games"), settled(games, "games")
    a, b = fit_team_tds(games, pg, train_years)
    data = [build_dataset(pg, games, h, min_prior).select(F.lit(i).alias("candidate"), "year", *TRAIN_COLUMNS) for i, h in enumerate(candidates)]
    data = settled(reduce(DataFrame.unionByName, data), "candidates")
    fitted = fit_candidates(data.where(F.col("year").isin(list(train_years))), a, b)
    test = data.where(F.col("year").isin(list(test_years)))
    of = lambda i: map_literal({c: float(t[0][i]) for c, t in fitted.items()})[F.col("candidate")]
    k = len(SHARES)
    params = {"team_a": a, "team_b": b, "weights": {s: of(i) for i, s in enumerate(SHARES)}, "adjustments": {s: of(k + i) for i, s in enumerate(ADJUSTMENTS)}}
    y = F.when(F.col("tds") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    losses = {r[0]: r[1:] for r in predict(test, params).groupBy("candidate").agg(log_loss_of(y, F.col("p")), F.count(F.lit(1))).collect()}
    sizes = {r[0]: r[1] for r in data.where(F.col("year").isin(list(train_years))).groupBy("candidate").agg(F.count(F.lit(1))).collect()}
    out = []
    for c, (theta, _, gradient) in fitted.items():
        weights, adjustments_ = as_params(theta)
        loss, n_test = losses.get(c, (None, 0))
        out.append({"halflife": float(candidates[c]), "team_a": a, "team_b": b, "weights": weights, "adjustments": adjustments_, "min_prior_games": min_prior,
                    "test_log_loss": loss, "n_train": sizes.get(c, 0), "n_test": n_test, "gradient": float(np.abs(gradient).max())})
    return out


def select_halflife(pg: DataFrame, games: DataFrame, train_years: Sequence[int], test_years: Sequence[int],
                    candidates: Sequence[float] = (3.0, 5.0, 8.0, 12.0), min_prior: int = 3) -> dict:
    """Parameters of the half-life with the lowest test log loss, the first of equal ones."""
    fitted = halflife_candidates(pg, games, train_years, test_years, candidates, min_prior)
    return min(fitted, key=lambda f: math.inf if f["test_log_loss"] is None else f["test_log_loss"], default={"test_log_loss": math.inf})


def evaluate(train: DataFrame, test: DataFrame, params: dict) -> DataFrame:
    """Log loss of the model, the position base rate and the player's own recent rate on the test rows."""
    y = F.when(F.col("tds") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    base = train.groupBy("position").agg(F.avg(y).alias("__base"))
    rows = attach(predict(test, params), base, ["position"]).withColumn("y", y)
    own = F.least(F.greatest(F.coalesce("ewm_tds", F.lit(0.0)), F.lit(0.0)), F.lit(0.95))
    return rows.agg(F.count(F.lit(1)).alias("n"), half_up(F.avg("y"), 4).alias("scored_rate"),
                    half_up(log_loss_of(F.col("y"), F.col("p")), 4).alias("model_loss"),
                    half_up(log_loss_of(F.col("y"), F.col("__base")), 4).alias("base_rate_loss"),
                    half_up(log_loss_of(F.col("y"), own), 4).alias("own_rate_loss"))


def segments(test: DataFrame, params: dict) -> DataFrame:
    """Size, mean prediction and mean outcome by position, team change, snap drop and low snaps."""
    rows = predict(test, params).withColumn("y", F.when(F.col("tds") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    text = lambda c: c.cast("string")
    kinds = F.array(*[F.struct(F.lit(n).alias("segment"), v.alias("level")) for n, v in (
        ("position", F.col("position")), ("new_team", text(F.col("adj_new_team") > 0.3)),
        ("snap_drop", text(F.col("adj_snap_trend") <= -0.2)), ("low_snap", text(F.col("adj_low_snap") > 0)))])
    return rows.select("p", "y", F.inline(kinds)).groupBy("segment", "level").agg(
        F.count(F.lit(1)).alias("n"), half_up(F.avg("p"), 3).alias("predicted"), half_up(F.avg("y"), 3).alias("actual"))


def calibration_table(test: DataFrame, params: dict) -> DataFrame:
    rows = predict(test, params).withColumn("y", F.when(F.col("tds") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return calibration(rows, "y", "p")


def fit_spread(stats: DataFrame, columns: Sequence[str], min_games: int = 8, min_snap: float = 20.0) -> DataFrame:
    """sd = a * mean^b per stat: deviation and mean per player-season, then a log-log line over player-seasons."""
    played = stats.where(F.col("snap_pct") >= min_snap)
    pairs = F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("v")) for c in columns])
    season = played.select("player_id", "year", F.inline(pairs)).groupBy("stat", "player_id", "year").agg(
        F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    usable = season.where((F.col("n") >= min_games) & (F.col("m") > 0) & (F.col("s") > 0))
    fit = usable.groupBy("stat").agg(F.count(F.lit(1)).alias("player_seasons"),
                                     F.regr_slope(F.log("s"), F.log("m")).alias("__b"),
                                     F.regr_intercept(F.log("s"), F.log("m")).alias("__a"))
    return fit.select("stat", "player_seasons", half_up(F.exp("__a"), 4).alias("a"), half_up("__b", 4).alias("b"))


def weather_effects(games: DataFrame) -> DataFrame:
    """Mean residuals by wind and temperature bucket: `games`(wind_mph, temp_f, dome, resid_points, pass_yds, rush_yds)."""
    wind = (F.when(F.col("dome"), F.lit("dome")).when(F.col("wind_mph") >= 20, F.lit("20+"))
            .when(F.col("wind_mph") >= 15, F.lit("15-19")).when(F.col("wind_mph") >= 10, F.lit("10-14")).otherwise(F.lit("0-9")))
    temp = F.when(F.col("temp_f") <= 32, F.lit("freezing")).otherwise(F.lit("mild"))
    avg = lambda c: half_up(F.avg(c), 2).alias(f"mean_{c}")
    return games.groupBy(wind.alias("wind"), temp.alias("temp")).agg(
        F.count(F.lit(1)).alias("n"), avg("resid_points"), avg("pass_yds"), avg("rush_yds"))
