"""Golden values of the scalar functions."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from chalkline.functions import clock, conditions as C, fits, names as N, odds as O, scoring as S, teams as T, values as V


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, key", [
    ("Kenneth  Walker III", "kenneth walker"), ("Tre V", "tre v"), ("Odell Beckham Jr.", "odell beckham"),
    ("Ja'Marr Chase", "jamarr chase"), ("  A.J. Brown ", "aj brown"), ("Puka Nacua Jr.", "puka nacua")])
def test_normalize_name(spark, raw, key):
    assert one(spark, N.normalize_name(F.lit(raw))) == key


def test_name_key_priority(spark):
    assert one(spark, N.name_key(F.lit("kenneth walker iii"), F.lit("Other"))) == "kenneth walker"
    assert one(spark, N.name_key(F.lit("  "), F.lit("Josh Allen"))) == "josh allen"
    assert one(spark, N.name_key(F.lit("nan"), F.lit("Josh Allen"))) == "josh allen"
    assert one(spark, N.name_key(F.lit(None).cast("string"), F.lit(None).cast("string"))) == ""


def test_depth_names_and_teams(spark):
    assert one(spark, N.depth_chart_name(F.lit("Coleman, Keon 24/2"))) == "Keon Coleman"
    assert one(spark, N.depth_chart_name(F.lit("DAWKINS, DION 17/2"))) == "Dion Dawkins"
    for raw, code in [("Buffalo Bills", "buf"), ("SEA D/ST", "sea"), ("Seahawks", "sea"), ("LA", "lar"), ("OAK", "lvr"), ("Nobody", "")]:
        assert one(spark, T.normalize_team(F.lit(raw))) == code


@pytest.mark.parametrize("now, cutoff", [
    ("2026-09-15 07:59:00", "2026-09-08 08:00:00"), ("2026-09-15 08:00:00", "2026-09-15 08:00:00"),
    ("2026-11-10 08:59:00", "2026-11-03 09:00:00"), ("2026-11-10 09:00:00", "2026-11-10 09:00:00"),
    ("2026-09-20 17:00:00", "2026-09-15 08:00:00")])
def test_week_rollover(spark, now, cutoff):
    assert str(one(spark, clock.week_rollover(F.to_timestamp(F.lit(now))))) == cutoff


def test_kickoff_spellings(spark):
    assert str(one(spark, clock.kickoff_utc(F.lit("9/4/25"), F.lit("8:20PM")))) == "2025-09-05 00:20:00"
    assert str(one(spark, clock.kickoff_utc(F.lit("2026-11-10"), F.lit("4:00AM")))) == "2026-11-10 09:00:00"
    assert str(one(spark, clock.kickoff_utc(F.lit("2026-09-22"), F.lit(None).cast("string")))) == "2026-09-22 04:00:00"


def test_points(spark):
    qb = spark.createDataFrame([(320, 2, 1, 12)], "pass_yds int, pass_td int, pass_int int, rush_yds int")
    rest = [c for c, _, _ in S.OFFENSE_RATES if c not in qb.columns]
    row = qb.withColumns({c: F.lit(None).cast("int") for c in rest})
    assert row.select(S.offense_points().alias("v")).first()["v"] == 24.0
    tiers = [one(spark, S.points_allowed_bonus(F.lit(n))) for n in (0, 6, 7, 13, 14, 20, 27, 28, 34, 35)]
    assert tiers == [10, 7, 4, 4, 1, 1, 0, -1, -1, -4]


def test_prices(spark):
    assert round(one(spark, O.implied_prob(F.lit(-122))), 4) == 0.5495
    assert one(spark, O.fair_american(F.lit(0.5792))) == -138
    assert one(spark, O.fair_american(F.lit(1.0))) is None
    kelly = one(spark, O.quarter_kelly(F.lit(0.5792), 0.0, O.decimal_odds(F.lit(-122))))
    assert round(kelly * 100, 2) == 1.65
    assert one(spark, O.quarter_kelly(F.lit(0.2), 0.0, O.decimal_odds(F.lit(100)))) == 0.0


def test_normal_cdf_and_inverse(spark):
    exact = statistics.NormalDist()
    rows = spark.range(1, 1000).select((F.col("id") / 1000.0).alias("p")).withColumn("z", O.normal_ppf(F.col("p"))).withColumn(
        "q", O.normal_cdf(F.col("z"))).collect()
    assert max(abs(r.z - exact.inv_cdf(r.p)) for r in rows) < 1e-12
    assert max(abs(r.q - r.p) for r in rows) < 1e-14


def test_fit_gives_the_price_back():
    line = np.repeat([0.5, 1.0, 2.5, 3.0, 12.0, 60.5, 61.0], 50)
    p = np.tile(np.linspace(0.02, 0.98, 50), 7)
    for model in ("normal", "poisson"):
        m = np.full(len(line), model, dtype=object)
        sd = np.full(len(line), 4.0)
        under, push = fits.outcome_arrays(m, fits.fit_array(m, sd, line, p), sd, line)
        over = 1.0 - under - push
        assert np.max(np.abs(over / (over + under) - p)) < 1e-9


def test_batched_and_native_outcomes_agree(spark):
    d = spark.range(60).select((F.col("id") % 12 / 2.0 + 1.0).alias("line"), (F.col("id") % 7 + 0.5).alias("mu"))
    for model in ("normal", "poisson"):
        native = O.outcome_probs(F.lit(model), F.col("mu"), F.lit(2.0), F.col("line"))
        batch = fits.outcome_batch(F.lit(model), F.col("mu"), F.lit(2.0), F.col("line"))
        for r in d.select(native.alias("a"), batch.alias("b")).collect():
            assert math.isclose(r.a.under, r.b.under, abs_tol=1e-12) and math.isclose(r.a.push, r.b.push, abs_tol=1e-12)
            assert math.isclose(r.a.over + r.a.under + r.a.push, 1.0, abs_tol=1e-12)


def test_weather_and_lines(spark):
    w = one(spark, C.parse_weather(F.lit("60 degrees, relative humidity 74%, wind 5 mph")))
    assert (w.temp, w.humidity, w.wind) == ("60 degrees", "relative humidity 74%", "wind 5 mph")
    assert one(spark, C.home_spread(F.lit("Dallas Cowboys -3.0"), F.lit("nyg"), F.lit("dal"))) == 3.0
    assert one(spark, C.home_spread(F.lit("Pick"), F.lit("nyg"), F.lit("dal"))) == 0.0
    e = one(spark, C.weather_effect(F.lit("outdoor"), F.lit(17.0), F.lit(50.0)))
    assert e.weather_note == "17 mph wind: pass yds -21, rush yds +4" and e.bad_passing_weather
    assert one(spark, V.money(F.lit("$7,500"))) == 7500
