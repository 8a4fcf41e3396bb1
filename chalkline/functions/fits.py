"""Fitting an outcome model to a price, in batches.

Spark SQL has no solver, and a Newton loop written as nested column expressions is re-inlined by every filter above it.
The loop therefore runs in one Arrow-batched function over numpy arrays; everything around it stays native columns.
The function is marked non-deterministic only so that the optimizer never evaluates it twice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from chalkline.functions.odds import CDF_DEN, CDF_NUM, INV_CENTRE, INV_MIDDLE, INV_TAIL

MAX_STEPS, RESIDUAL, MIN_RATE = 100, 1e-12, 1e-6


def log_upper_array(z: np.ndarray) -> np.ndarray:
    """log P(Z > z), also far out in the tail, where P itself is no longer a number."""
    a = np.abs(z)
    near = np.minimum(a, 7.07106781186547)
    body = np.exp(-near * near / 2.0) * np.polyval(CDF_NUM, near) / np.polyval(CDF_DEN, near)
    tail = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + k / tail
    far = -a * a / 2.0 - np.log(tail) - np.log(2.506628274631)
    upper = np.where(a < 7.07106781186547, np.log(body), far)
    return np.where(z > 0, upper, np.log1p(-np.exp(upper)))


def cdf_array(z: np.ndarray) -> np.ndarray:
    return np.exp(log_upper_array(-z))


def bracketed_newton(f, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Roots of increasing functions inside [low, high]: Newton steps, halving where one would leave the bracket, until all residuals vanish or the
    bracket is closed; NaN for what is still open after MAX_STEPS. `f` gives value and slope."""
    for _ in range(MAX_STEPS):
        value, slope = f(x)
        low, high = np.where(value <= 0, x, low), np.where(value >= 0, x, high)
        open_ = (np.abs(value) > RESIDUAL) & (high - low > 1e-15 * np.maximum(1.0, np.abs(x)))
        if not open_.any():
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            step = x - value / slope
        x = np.where(open_, np.where((step > low) & (step < high), step, (low + high) / 2.0), x)
    else:
        x = np.where(open_, np.nan, x)
    return x


def ppf_array(p: np.ndarray) -> np.ndarray:
    q = p - 0.5
    r0 = 0.180625 - q * q
    r = np.sqrt(-np.log(np.minimum(p, 1.0 - p)))
    rational = lambda c, x: np.polyval(c[0], x) / np.polyval(c[1], x)
    side = np.where(r <= 5.0, rational(INV_MIDDLE, r - 1.6), rational(INV_TAIL, r - 5.0))
    return np.where(np.abs(q) <= 0.425, q * rational(INV_CENTRE, r0), np.copysign(side, q))


def poisson_array(k: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(X <= k) and P(X = k)."""
    term = np.exp(-lam)
    total, at = term.copy(), term.copy()
    for i in range(1, int(k.max(initial=0)) + 1):
        term = term * lam / i
        total += np.where(i <= k, term, 0.0)
        at = np.where(i == k, term, at)
    return total, at


def fit_normal_array(line: np.ndarray, sd: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Mean whose no-push P(over) is p: closed form on half lines, its log-odds solved for on whole lines."""
    mu = line + sd * ppf_array(p)
    whole = np.abs(line - np.round(line)) < 1e-9
    if whole.any():
        l, s, want = line[whole], sd[whole], np.log(p[whole] / (1.0 - p[whole]))

        def log_odds(m):
            zu, zl = (l + 0.5 - m) / s, (m - l + 0.5) / s
            over, under = log_upper_array(zu), log_upper_array(zl)
            hazard = lambda z, upper: np.exp(-z * z / 2.0 - 0.918938533204673 - upper) / s
            return over - under - want, hazard(zu, over) + hazard(zl, under)

        reach = 0.5 + 40.0 * s
        mu[whole] = bracketed_newton(log_odds, np.clip(mu[whole], l - reach, l + reach), l - reach, l + reach)
    return mu


def fit_poisson_array(line: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rate whose no-push P(over) is p: the log-odds are solved for over the log rate, nearly straight in both tails.

    At line 0 every price leaves only the over side, which the smallest rate explains."""
    whole = np.abs(line - np.round(line)) < 1e-9
    k = np.floor(line + np.where(whole, 0.5, 0.0)).astype(int)
    shape = k + 1.0
    start = np.maximum(shape * (1.0 - 1.0 / (9.0 * shape) + ppf_array(p) / (3.0 * np.sqrt(shape))) ** 3, 0.02)
    want = np.log(p / (1.0 - p))
    none_under = whole & (k == 0)

    def log_odds(x):
        lam = np.exp(x)
        total, at = poisson_array(k, lam)
        push = np.where(whole, at, 0.0)
        under, over = np.maximum(total - push, 1e-300), np.maximum(1.0 - total, 1e-300)
        d_under = np.where(whole, -at * k / lam, -at)
        slope = np.maximum((at * under - over * d_under) * lam / (over * under), 1e-12)
        return np.where(none_under, 0.0, np.log(over / under) - want), slope

    low, high = np.full(len(k), np.log(MIN_RATE)), np.log(10.0 * shape + 50.0)
    lam = np.exp(bracketed_newton(log_odds, np.clip(np.log(start), low, high), low, high))
    return np.where(none_under, MIN_RATE, lam)


def fit_array(model: np.ndarray, sd: np.ndarray, line: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.full(len(line), np.nan)
    known = np.isfinite(line) & np.isfinite(p) & (p > 0) & (p < 1)
    poisson = known & (model == "poisson")
    normal = known & (model == "normal") & np.isfinite(sd) & (sd > 0)
    if poisson.any():
        out[poisson] = fit_poisson_array(line[poisson], p[poisson])
    if normal.any():
        out[normal] = fit_normal_array(line[normal], sd[normal], p[normal])
    return out


@F.pandas_udf(DoubleType())
def _fit(model: pd.Series, sd: pd.Series, line: pd.Series, p: pd.Series) -> pd.Series:
    number = lambda s: s.to_numpy(dtype=float, na_value=np.nan)
    fitted = fit_array(model.to_numpy(dtype=object), number(sd), number(line), number(p))
    return pd.Series(fitted).where(np.isfinite(fitted), None)


_fit = _fit.asNondeterministic()


def fit_param(model: Column, sd: Column, line: Column, p_over: Column) -> Column:
    """Parameter at which the no-push P(over) at `line` is `p_over`: normal mean or Poisson rate; NULL otherwise."""
    return _fit(model, sd, line, p_over)


def outcome_arrays(model: np.ndarray, param: np.ndarray, sd: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(under) and P(push) per row; NaN where the model is unknown."""
    under, push = np.full(len(line), np.nan), np.full(len(line), np.nan)
    whole = np.abs(line - np.round(line)) < 1e-9
    half = np.where(whole, 0.5, 0.0)
    known = np.isfinite(param) & np.isfinite(line)
    with np.errstate(invalid="ignore"):
        n = known & (model == "normal") & (sd > 0)
    if n.any():
        under[n] = cdf_array((line[n] - half[n] - param[n]) / sd[n])
        push[n] = np.where(whole[n], cdf_array((line[n] + half[n] - param[n]) / sd[n]) - under[n], 0.0)
    q = known & (model == "poisson")
    if q.any():
        k = np.floor(line[q] + half[q]).astype(int)
        total, at = poisson_array(k, np.maximum(param[q], MIN_RATE))
        push[q] = np.where(whole[q], at, 0.0)
        under[q] = total - push[q]
    return under, push


@F.pandas_udf(StructType([StructField("under", DoubleType()), StructField("push", DoubleType())]))
def _outcomes(model: pd.Series, param: pd.Series, sd: pd.Series, line: pd.Series) -> pd.DataFrame:
    number = lambda s: s.to_numpy(dtype=float, na_value=np.nan)
    under, push = outcome_arrays(model.to_numpy(dtype=object), number(param), number(sd), number(line))
    text = lambda v: pd.Series(v).where(np.isfinite(v), None)
    return pd.DataFrame({"under": text(under), "push": text(push)})


_outcomes = _outcomes.asNondeterministic()


def outcome_batch(model: Column, param: Column, sd: Column, line: Column) -> Column:
    """struct(under, push): the batched twin of `odds.outcome_probs` for rows that were fitted in batches anyway."""
    return _outcomes(model, param, sd, line)
