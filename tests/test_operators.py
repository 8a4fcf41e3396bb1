"""Operators against brute force, hot keys, table maintenance and market identities."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from chalkline.functions import odds as O
from chalkline.operators import joins as J, ordered as W
from chalkline.plans import market as M, model as MD
from chalkline.sources import pages as P, tables as S


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds a third of the rows."""
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 40}", round(rng.random() * 20, 1)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id int, k string, v double")


@pytest.mark.parametrize("how, fn", [("median", statistics.median), ("mean", statistics.fmean), ("min", min)])
def test_leave_one_out_is_exact_on_a_hot_key(hot, how, fn):
    rows, df = hot
    got = {r.id: r.others for r in W.leave_one_out(df, ["k"], "v", how).collect()}
    groups = {}
    for i, k, v in rows:
        groups.setdefault(k, []).append((i, v))
    for k, members in groups.items():
        for i, _ in members[:25]:
            assert got[i] == pytest.approx(fn([v for j, v in members if j != i]), abs=1e-9)


def test_chunked_rank_equals_row_number(hot):
    rows, df = hot
    got = {r.id: (r.rank, r.rank_total) for r in W.rank_in_group(df, ["k"], "v", "id").collect()}
    groups = {}
    for i, k, v in rows:
        groups.setdefault(k, []).append((-v, i))
    for members in groups.values():
        for n, (_, i) in enumerate(sorted(members), start=1):
            assert got[i] == (n, len(members))


def test_asof_before_equals_brute_force(spark):
    rng = random.Random(5)
    left = [(i, f"k{rng.randrange(4)}", rng.randrange(200_000)) for i in range(150)]
    right = [(i, f"k{rng.randrange(4)}", rng.randrange(200_000)) for i in range(150)]
    l = spark.createDataFrame(left, "lid int, k string, s int").withColumn("t0", F.timestamp_seconds("s"))
    r = spark.createDataFrame(right, "rid int, k string, s int").withColumn("t1", F.timestamp_seconds("s")).drop("s")
    got = {x.lid: x.rid for x in J.asof_before(l, r, ["k"], "t0", "t1", ["rid"], ["rid"], "hour").collect()}
    for lid, k, s in left:
        best = max(((t, i) for i, kk, t in right if kk == k and t < s), default=None)
        assert got[lid] == (best[1] if best else None)


def test_upsert_is_idempotent_and_last_wins(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, n int")
    batch = spark.createDataFrame([(2, "x", 2), (2, "y", 3), (3, "c", 1)], "id int, v string, n int")
    once = S.upsert(base, batch, ["id"], ["n"])
    assert {(r.id, r.v) for r in once.collect()} == {(1, "a"), (2, "y"), (3, "c")}
    assert sorted(S.upsert(once, batch, ["id"], ["n"]).collect()) == sorted(once.collect())
    assert {(r.id, r.v) for r in S.fill_gaps(base, batch, ["id"], ["n"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}


def test_versioned_table_can_replace_itself(spark, tmp_path):
    root = str(tmp_path / "t")
    S.save_version(spark.createDataFrame([(1, "a")], "id int, v string"), root)
    S.save_version(S.upsert(S.read_version(spark, root), spark.createDataFrame([(1, "b")], "id int, v string"), ["id"]), root)
    assert [tuple(r) for r in S.read_version(spark, root).collect()] == [(1, "b")]


QUOTES = ("category string, player_name string, team string, book string, line double, over_odds double, under_odds double, "
          "site_projection double, available boolean")


def test_arbitrage_row(spark):
    q = spark.createDataFrame([("rushing-yards", "P", "buf", "A", 2.5, 180.0, -200.0, None, True), ("rushing-yards", "P", "buf", "B", 2.5, 120.0, -154.0, None, True)], QUOTES)
    r = M.find_arbitrage(q).first()
    assert (r.profit_pct, r.stake_over, r.stake_under, r.over_book, r.under_book) == (3.79, 37.07, 62.93, "a", "b")


def test_outlier_row(spark):
    q = spark.createDataFrame([("receptions", "P", "buf", b, l, -110.0, -110.0, None, True) for b, l in (("a", 1.5), ("b", 0.5), ("c", 0.5))], QUOTES)
    r = {x.book: x.diff_pct for x in M.find_outliers(q).collect()}
    assert r["a"] == 200.0


def test_two_way_prices_against_plain_python(spark):
    lines = [("draftkings", 60.5), ("x1", 62.5), ("x2", 61.5), ("x3", 60.0), ("x4", 63.5)]
    q = spark.createDataFrame([("rushing-yards", "P", "buf", b, l, -105.0 - i, -115.0 + i, None, True) for i, (b, l) in enumerate(lines)], QUOTES)
    got = {r.side: r for r in M.find_ev_two_way(q).collect()}
    nd = statistics.NormalDist()
    med = statistics.median(l for b, l in lines if b != "draftkings")
    sd = 3.33 * med ** 0.55
    ip = lambda o: 100 / (o + 100) if o > 0 else -o / (-o + 100)
    mus = []
    for i, (b, l) in enumerate(lines):
        if b == "draftkings":
            continue
        po, pu = ip(-105.0 - i), ip(-115.0 + i)
        want, lo, hi = po / (po + pu), l - 8 * sd, l + 8 * sd
        half = 0.5 if l == round(l) else 0.0
        for _ in range(80):
            mid = (lo + hi) / 2
            over, under = 1 - nd.cdf((l + half - mid) / sd), nd.cdf((l - half - mid) / sd)
            lo, hi = (mid, hi) if over / (over + under) < want else (lo, mid)
        mus.append(lo)
    p_over = 1 - nd.cdf((60.5 - statistics.median(mus)) / sd)
    assert got["Over"].fair_prob == pytest.approx(p_over, abs=6e-5)
    assert got["Over"].fair_prob + got["Under"].fair_prob == pytest.approx(1.0, abs=1e-4)


def test_stakes_sum_to_total(spark):
    s = spark.range(1).select(M.balanced_stakes(F.lit(-110), F.lit(130)).alias("s")).first().s
    assert s.stake_over + s.stake_under == pytest.approx(100.0)
    assert s.stake_over * 1.9090909 == pytest.approx(s.stake_under * 2.3, rel=1e-6)


def test_page_records():
    spec = P.FieldMap((P.Field("player", "player"), P.Field("yds", 1, None, r"(\d+)")), within_tag="table", within_id="stats", in_comments=True)
    html = ("<table id='other'><tr><td data-stat='player'>No</td></tr></table><table id='stats'><tr><th data-stat='player'>A &amp; B</th><td>12 yds</td></tr></table>"
            "<!-- <table id='stats'><tr><td data-stat='player'>C</td><td>7</td></tr></table> -->")
    assert P.extract_records(html, spec) == [["A & B", "12"], ["C", "7"]]


def test_fit_recovers_weights(spark):
    """Outcomes drawn from known parameters: the fit must beat the start and stay inside its bounds."""
    rng = random.Random(11)
    rows = []
    for _ in range(4000):
        shares = [rng.random() * 0.4 for _ in MD.SHARES]
        adj = [float(rng.random() < 0.2) for _ in MD.ADJUSTMENTS]
        lam = 2.5 * (0.5 * shares[0] + 0.3 * shares[1]) * 2.718281828 ** (0.5 * adj[0])
        rows.append((float(rng.random() < 1 - 2.718281828 ** -lam), 21.0, *shares, *adj))
    df = spark.createDataFrame(rows, ["tds", "implied_total", *MD.SHARES, *MD.ADJUSTMENTS])
    import math

    a, b = math.log(2.5) - math.log(21.0), 1.0
    tagged = df.withColumn("candidate", F.lit(0))
    start = MD._passes(tagged, {0: __import__("numpy").array([1 / 7] * 7 + [0.0] * 7)}, a, b)[0][0]
    weights, adjustments, loss = MD.fit_weights(df, a, b)
    both = MD.fit_candidates(tagged.unionByName(df.where("rand(1) < 0.5").withColumn("candidate", F.lit(4))), a, b)
    assert sorted(both) == [0, 4] and both[0][1] == pytest.approx(loss, abs=1e-9) and all(abs(g).max() < 1e-5 for _, _, g in both.values())
    assert loss < start - 0.01
    assert all(v >= 0 for v in weights.values()) and all(-3 <= v <= 3 for v in adjustments.values())
    assert weights["share_carries"] == pytest.approx(0.5, abs=0.12)


def test_team_touchdown_fit_recovers_its_line(spark):
    import math

    rng = random.Random(2)
    rows = []
    for i in range(3000):
        total = 14.0 + rng.random() * 20
        lam, k, term = math.exp(-2.0 + 0.9 * math.log(total)), 0, rng.random()
        cum = p = math.exp(-lam)
        while cum < term and k < 60:
            k += 1
            p *= lam / k
            cum += p
        rows.append((1, i, "t", total, float(k)))
    df = spark.createDataFrame(rows, "year int, week int, team string, implied_total double, tds double")
    a, b = MD.fit_team_tds(df.drop("tds"), df.drop("implied_total"), [1])
    assert a == pytest.approx(-2.0, abs=0.4) and b == pytest.approx(0.9, abs=0.12)


def test_last_k_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    plan = W.first_rows(df, ["k"], [F.desc("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_no_pickem_reference(spark):
    assert set(O.PICKEM_BOOKS) == {"prizepicks", "underdog", "sleeper"}
