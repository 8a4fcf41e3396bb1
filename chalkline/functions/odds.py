"""Prices and probabilities: American odds, de-vigging, normal and Poisson outcome models.

Spark SQL has no normal or Poisson distribution, so both are built from Column arithmetic and stay in the JVM:
the normal CDF is Hart's rational approximation, its inverse is Wichura's AS 241, the Poisson CDF is the term
recurrence inside `aggregate`. Fitting a parameter to a price is in `fits`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline.functions.teams import map_literal
from chalkline.functions.values import as_col, half_up

# Fixed-payout pick'em apps, never a reference price.
PICKEM_BOOKS = ["prizepicks", "underdog", "sleeper"]
# Spread of a stat around its line, sd = a * line ** b.
NORMAL_SPREAD = {
    "passing-yards": (7.02, 0.41),
    "passing-and-rushing-yards": (9.88, 0.35),
    "pass-attempts": (1.26, 0.51),
    "completions": (0.74, 0.64),
    "rushing-yards": (3.33, 0.55),
    "rush-attempts": (1.09, 0.57),
    "receiving-yards": (3.14, 0.59),
    "rushing-and-receiving-yards": (3.33, 0.57),
}
POISSON_CATEGORIES = ["receptions", "passing-tds", "interceptions"]
SAME_LINE_CATEGORIES = ["longest-reception", "longest-rush", "longest-completion", "kicking-points"]
ONE_WAY_CATEGORIES = ["touchdowns", "first-touchdown-scorer", "last-touchdown-scorer"]
MIN_NORMAL_LINE = 5.0
MAX_POISSON_SHIFT = 1.5
REF_SPREAD_SD = 0.75

# Published coefficients, highest power first.
CDF_NUM = [3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
            221.213596169931, 220.206867912376]
CDF_DEN = [8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
            637.333633378831, 793.826512519948, 440.413735824752]
INV_CENTRE = (
    [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
     13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080],
    [5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867,
     5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0],
)
INV_MIDDLE = (
    [7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258,
     3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734],
    [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
     6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0],
)
INV_TAIL = (
    [2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
     2.96560571828504891230e-1, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720],
    [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
     1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0],
)


def implied_prob(odds: Column | str) -> Column:
    o = as_col(odds).cast("double")
    return F.when(o > 0, 100.0 / (o + 100.0)).otherwise(-o / (-o + 100.0))


def decimal_odds(odds: Column | str) -> Column:
    o = as_col(odds).cast("double")
    return F.when(o > 0, 1.0 + o / 100.0).otherwise(1.0 + 100.0 / -o)


def novig_over(over_odds: Column | str, under_odds: Column | str) -> Column:
    po, pu = implied_prob(over_odds), implied_prob(under_odds)
    return po / (po + pu)


def fair_american(p: Column | str) -> Column:
    """Probability -> American odds as a whole number; NULL outside (0, 1). Nine digits decide, so an even chance does
    not flip its sign on the last bit."""
    q = half_up(p, 9)
    favourite = F.floor(-100.0 * q / (1.0 - q) + 0.5)
    underdog = F.floor(100.0 * (1.0 - q) / q + 0.5)
    return F.when((q > 0) & (q < 1), F.when(q >= 0.5, favourite).otherwise(underdog)).cast("bigint")


def quarter_kelly(p_win: Column, p_push: Column | float, dec: Column) -> Column:
    push = p_push if isinstance(p_push, Column) else F.lit(float(p_push))
    edge = dec - 1.0
    return F.greatest(F.lit(0.0), (p_win * edge - (1.0 - p_win - push)) / edge) * 0.25


def _horner(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(z: Column) -> Column:
    a = F.abs(z)
    e = F.exp(-a * a / 2.0)
    body = e * _horner(CDF_NUM, a) / _horner(CDF_DEN, a)
    tail = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + F.lit(k) / tail
    upper = F.when(a > 37.0, F.lit(0.0)).when(a < 7.07106781186547, body).otherwise(e / tail / 2.506628274631)
    return F.when(z > 0, 1.0 - upper).otherwise(upper)


def normal_ppf(p: Column) -> Column:
    """Inverse normal CDF for p in (0, 1)."""
    q = p - 0.5
    r0 = F.lit(0.180625) - q * q
    centre = q * _horner(INV_CENTRE[0], r0) / _horner(INV_CENTRE[1], r0)
    r = F.sqrt(-F.log(F.least(p, 1.0 - p)))
    rm, rt = r - 1.6, r - 5.0
    middle = _horner(INV_MIDDLE[0], rm) / _horner(INV_MIDDLE[1], rm)
    tail = _horner(INV_TAIL[0], rt) / _horner(INV_TAIL[1], rt)
    side = F.when(r <= 5.0, middle).otherwise(tail)
    return F.when(F.abs(q) <= 0.425, centre).otherwise(F.when(q < 0, -side).otherwise(side))


def is_whole(line: Column) -> Column:
    return F.abs(line - F.round(line)) < 1e-9


def _poisson_terms(k: Column, lam: Column) -> Column:
    """struct(total = P(X <= k), term = P(X = k)) for k >= 0, by the term recurrence."""
    first = F.exp(-lam)

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * lam / i
        return F.struct((acc["total"] + term).alias("total"), term.alias("term"))

    start = F.struct(first.alias("total"), first.alias("term"))
    # slice() drops the zeroth element, which is the start value.
    return F.aggregate(F.slice(F.sequence(F.lit(0), F.greatest(k, F.lit(0))), F.lit(2), F.greatest(k, F.lit(0))), start, add)


def poisson_pmf(k: Column, lam: Column) -> Column:
    """P(X = k); 0 for k < 0. `k` is an integer column."""
    return F.when(k < 0, F.lit(0.0)).otherwise(_poisson_terms(k, lam)["term"])


def poisson_cdf(k: Column, lam: Column) -> Column:
    """P(X <= k); 0 for k < 0."""
    return F.when(k < 0, F.lit(0.0)).otherwise(_poisson_terms(k, lam)["total"])


def outcome_probs(model: Column, param: Column, sd: Column, line: Column) -> Column:
    """struct(over, under, push) at `line`. Whole lines can push: exactly that count for Poisson, a band of
    half a unit on each side for the normal model."""
    whole = is_whole(line)
    lam = F.greatest(param, F.lit(1e-6))
    k = F.floor(line + F.when(whole, F.lit(0.5)).otherwise(F.lit(0.0))).cast("int")
    p_push = F.when(whole, poisson_pmf(k, lam)).otherwise(F.lit(0.0))
    p_under = F.when(whole, poisson_cdf(k - 1, lam)).otherwise(poisson_cdf(k, lam))
    half = F.when(whole, F.lit(0.5)).otherwise(F.lit(0.0))
    n_under = normal_cdf((line - half - param) / sd)
    n_over = 1.0 - normal_cdf((line + half - param) / sd)
    poisson = model == "poisson"
    over = F.when(poisson, 1.0 - p_under - p_push).otherwise(n_over)
    under = F.when(poisson, p_under).otherwise(n_under)
    push = F.when(poisson, p_push).otherwise(F.when(whole, 1.0 - n_over - n_under).otherwise(F.lit(0.0)))
    return F.struct(over.alias("over"), under.alias("under"), push.alias("push"))


def category_model(category: Column | str) -> Column:
    """'normal', 'poisson' or 'same_line' (no calibrated spread)."""
    c = as_col(category)
    return (F.when(c.isin(list(NORMAL_SPREAD)), F.lit("normal"))
            .when(c.isin(POISSON_CATEGORIES), F.lit("poisson")).otherwise(F.lit("same_line")))


def normal_sd(category: Column | str, line: Column) -> Column:
    c = as_col(category)
    a = map_literal({k: v[0] for k, v in NORMAL_SPREAD.items()})[c]
    b = map_literal({k: v[1] for k, v in NORMAL_SPREAD.items()})[c]
    return a * F.pow(line, b)


def stat_sd(category: Column | str, mid: Column) -> Column:
    """Standard deviation used to express line moves and line disagreement; NULL without a model."""
    model = category_model(category)
    return (F.when((model == "normal") & (mid >= MIN_NORMAL_LINE), normal_sd(category, mid))
            .when(model == "poisson", F.sqrt(F.greatest(mid, F.lit(0.5)))))
