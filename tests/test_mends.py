"""Long histories, streams over part files, late quotes, scrapes without a market, graded bets of repeated names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chalkline.catalog import q_streams
from chalkline.catalog.views import Tables
from chalkline.functions.values import half_up
from chalkline.operators.ordered import ewm_mean
from chalkline.plans import tracker as TR
from chalkline.streaming import quotes as Q


@pytest.mark.parametrize("shift", [True, False])
@pytest.mark.parametrize("halflife", [0.7, 4.0])
def test_ewm_of_a_long_history(spark, shift, halflife):
    n = 10_000
    values = [None if k % 7 == 3 else float((k * 37) % 11) for k in range(n)]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "p int, k int, v double")
    got = {r.k: r.ewm_v for r in ewm_mean(df, ["p"], ["k"], ["v"], halflife, shift).collect()}
    num = den = 0.0
    want = {}
    for k, v in enumerate(values):
        if shift:
            want[k] = num / den if den else None
        if v is not None:
            fade = 0.5 ** (1 / halflife)
            num, den = num * fade + v, den * fade + 1.0
        if not shift:
            want[k] = num / den if den else None
    assert [k for k in range(n) if got[k] is None] == [k for k in range(n) if want[k] is None]
    assert all(abs(got[k] - want[k]) < 1e-9 for k in range(n) if want[k] is not None)


def running_mean(values, halflife, shift):
    num = den = 0.0
    out = []
    for v in values:
        before = num / den if den else None
        if v is not None:
            fade = 0.5 ** (1 / halflife)
            num, den = num * fade + v, den * fade + 1.0
        out.append(before if shift else num / den if den else None)
    return out


@pytest.mark.parametrize("shift", [True, False])
def test_ewm_of_sparse_histories_in_chunks(spark, shift):
    """Gaps longer than two segments, values that crowd at the end of a segment, several keys and columns, NULL keys."""
    import random
    rng = random.Random(3)
    n, halflife = 3000, 0.25  # 64 values a segment
    sparse = [float(k % 50) if k % 197 == 0 else None for k in range(n)]
    crowded = [float(rng.randint(0, 9)) if (k // 64) % 3 == 1 or k % 190 == 0 else None for k in range(n)]
    rows = [(p, k, sparse[k], crowded[k]) for p in (1, None) for k in range(n)]
    df = spark.createDataFrame(rows, "p int, k int, a double, b double")
    for chunk in (None, F.floor(F.col("k") / 100)):
        got = ewm_mean(df, ["p"], ["k"], ["a", "b"], halflife, shift, chunk=chunk).collect()
        for column, values in (("ewm_a", sparse), ("ewm_b", crowded)):
            want = running_mean(values, halflife, shift)
            for p in (1, None):
                mine = {r.k: r[column] for r in got if r.p == p}
                assert len(mine) == n
                assert all((mine[k] is None) == (w is None) and (w is None or abs(mine[k] - w) < 1e-9) for k, w in enumerate(want))


def test_ewm_over_gaps_of_a_thousand_rows(spark):
    values = {0: 10.0, 1000: 20.0, 2000: 40.0}
    df = spark.range(3000).selectExpr("1 AS p", "id AS k", "CASE id WHEN 0 THEN 10.0D WHEN 1000 THEN 20.0D WHEN 2000 THEN 40.0D END AS v")
    for chunk in (None, F.floor(F.col("k") / 128)):
        got = {r.k: r.ewm_v for r in ewm_mean(df, ["p"], ["k"], ["v"], 3.0, chunk=chunk).collect()}
        want = running_mean([values.get(k) for k in range(3000)], 3.0, True)
        assert round(got[2500], 2) == 25.65 and all(w is None and got[k] is None or abs(got[k] - w) < 1e-9 for k, w in enumerate(want))


def test_half_up_keeps_what_is_no_number(spark):
    rows = spark.createDataFrame([(float("nan"),), (None,), (2.345,)], "x double").select(half_up("x", 2).alias("y")).collect()
    assert rows[0].y != rows[0].y and rows[1].y is None and rows[2].y == 2.35


@pytest.fixture(scope="module")
def part_files(spark, tmp_path_factory):
    """Events as four part files in time order, with late and repeated rows in the last; small batches."""
    folder = str(tmp_path_factory.mktemp("parts"))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").write.parquet(f"{folder}/nation.parquet")
    ranked = events.withColumn("q", F.ntile(4).over(q_streams_window()))
    late = events.orderBy("ts").limit(5)
    for k in range(1, 5):
        part = ranked.where(F.col("q") == k).drop("q")
        part = part.unionByName(late.withColumn("ts", F.col("ts") - F.expr("INTERVAL '2' HOUR")).withColumn("value", F.lit(900.0))) if k == 4 else part
        part.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return folder


def q_streams_window():
    from pyspark.sql import Window

    return Window.orderBy("ts", "event_id")


def test_streams_read_folders_in_several_batches(spark, part_files, monkeypatch):
    monkeypatch.setattr(q_streams, "FILES_PER_BATCH", 1)
    t = Tables(spark, part_files)
    closing, ck2 = q_streams.scratch(spark, "t4"), q_streams.scratch(spark, "t4c")
    Q.run_available(q_streams.stream(t), closing, ck2, "append", Q.closing_sink(closing, t.kickoffs_t))
    assert sorted(map(tuple, Q.read_closing(spark, closing).collect())) == sorted(map(tuple, Q.latest_before(t.quotes_t, t.kickoffs_t).select(
        *Q.KEY, "team", "kickoff", "scraped_at", "line", "over_odds").collect()))


def test_a_market_pulled_before_the_last_scrape_has_no_close(spark):
    at = lambda h: dt.datetime(2031, 10, 5, h)
    archive = spark.createDataFrame([(2031, 5, "sea", at(10), -110.0), (2031, 5, "tam", at(10), 100.0), (2031, 5, "tam", at(16), 120.0), (2031, 5, "tam", at(19), 150.0)],
                                    "year int, week int, team string, scraped_at timestamp, over_odds double")
    games = spark.createDataFrame([(2031, 5, "sea", at(18)), (2031, 5, "tam", at(18))], "year int, week int, team string, kickoff timestamp")
    assert [(r.team, r.over_odds) for r in TR.closing_snapshots(archive, games).collect()] == [("tam", 120.0)]


def test_a_bet_on_a_repeated_name_is_graded_once(spark):
    from chalkline.functions.scoring import GRADING_PARTS

    cols = sorted({c for p in GRADING_PARTS.values() for c in p})
    stats = spark.createDataFrame([(2031, 5, "milo quenby", "sea", 90), (2031, 5, "milo quenby", "tam", 10)], "year int, week int, name_key string, team string, y int")
    stats = stats.withColumns({c: F.col("y") for c in cols}).drop("y")
    bet = spark.createDataFrame([(2031, 5, "Milo Quenby", "sea", "rushing-yards", "Over", 50.5, -110.0)],
                                "year int, week int, player_name string, team string, category string, side string, line double, odds double")
    final = spark.createDataFrame([(2031, 5, "sea")], "year int, week int, team string")
    rows = TR.grade(bet, stats, final).collect()
    assert [(r.result, r.actual) for r in rows] == [("win", 90.0)]


def test_split_medians_of_a_hot_key(spark, monkeypatch):
    import random
    import statistics

    from chalkline.operators import ordered
    from chalkline.operators.aggregates import grouped_stats
    from chalkline.operators.quality import compare_points

    rng = random.Random(3)
    rows = [("hot" if k % 10 else f"k{k % 70}", float(rng.choice([rng.randrange(9), rng.randrange(100_000)]) / 8)) for k in range(20_000)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    for limit in (4000, 0, 10**9):
        monkeypatch.setattr(ordered, "SMALL_GROUP", max(limit, 100))
        got = {r.g: r.median for r in ordered.split_median(df, ["g"], "v").collect()}
        assert got == {g: statistics.median(v) for g, v in groups.items() if g != "none"}
    others = {(r.g, r.v): r.others for r in ordered.leave_one_out(df, ["g"], "v", "median").collect()}
    hot = sorted(groups["hot"])
    for v in (hot[0], hot[len(hot) // 2], hot[-1]):
        rest = list(hot)
        rest.remove(v)
        assert others["hot", v] == statistics.median(rest)
    assert others["one", 3.0] is None and others["two", 1.0] == 2.0
    assert {r.g: r.n for r in grouped_stats(df, ["g"], "v", "v").collect()}["none"] == 1
    empty = spark.createDataFrame([], "k int, v double")
    assert compare_points(empty, empty, ["k"], "v").first().median_gap is None


def test_null_keys_pair_with_nothing(spark):
    from chalkline.operators.joins import full_outer_fill

    a = spark.createDataFrame([("p", 1, "x", 1), (None, 1, "y", 2), (None, 1, "z", 3)], "k string, w int, t string, a int")
    b = spark.createDataFrame([("p", 1, "q", 10), (None, 1, "v", 20), ("r", None, "u", 30)], "k string, w int, t string, b int")
    got = sorted(map(str, map(tuple, full_outer_fill(a, b, ["k", "w"], ["t"]).select("k", "w", "t", "a", "b").collect())))
    assert got == sorted(map(str, [("p", 1, "x", 1, 10), (None, 1, "y", 2, None), (None, 1, "z", 3, None), (None, 1, "v", None, 20), ("r", None, "u", None, 30)]))


def test_restore_goes_by_column_names(spark):
    from chalkline.sources.tables import restore

    saved = spark.createDataFrame([("7", "a", 1.5)], "n string, gone string, v double")
    live = spark.createDataFrame([], "v double, n int, added string")
    out = restore(saved, live)
    assert out.dtypes == live.dtypes and tuple(out.first()) == (1.5, 7, None)


def test_price_fits_at_small_spreads():
    import numpy as np

    from chalkline.functions.fits import fit_normal_array, fit_poisson_array, log_upper_array, poisson_array

    line, sd, p = (g.ravel() for g in np.meshgrid([0.0, 3.0, 40.0, 7.5], [0.02, 0.1, 0.5, 1.0, 9.0], [0.001, 0.05, 0.5, 0.93, 0.999]))
    mu = fit_normal_array(line, sd, p)
    half = np.where(line == np.round(line), 0.5, 0.0)
    over, under = log_upper_array((line + half - mu) / sd), log_upper_array((mu - line + half) / sd)
    assert np.abs(1 / (1 + np.exp(under - over)) - p).max() < 1e-9
    line, p = (g.ravel() for g in np.meshgrid([0.5, 1.0, 3.0, 12.5, 60.0], [0.001, 0.05, 0.5, 0.93, 0.999]))
    lam = fit_poisson_array(line, p)
    k = np.floor(line).astype(int)
    total, at = poisson_array(k, lam)
    low = total - np.where(line == k, at, 0.0)
    assert np.abs((1 - total) / (1 - total + low) - p).max() < 1e-8
