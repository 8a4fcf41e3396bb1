"""Stats looked up as one wide row, players that share a name, staged views."""

import datetime as dt

import pytest

from chalkline.catalog import views as V
from chalkline.functions.scoring import FIELD_PARTS, GRADING_PARTS, stat_of, stat_struct, unpivot_stats
from chalkline.plans import contest as C, tracker as TR

STATS = sorted({c for parts in (FIELD_PARTS, GRADING_PARTS) for cols in parts.values() for c in cols})
LINEITEM = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
            "l_tax double, l_returnflag string, l_shipdate timestamp")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def box_scores(spark):
    rows = [(2001, w, f"p{p} last", "c%d" % p, "DEN", *[None if (p + i) % 5 == 0 else (p * 3 + i + w) % 40 for i in range(len(STATS))]) for p in range(4) for w in (1, 2)]
    return spark.createDataFrame(rows, "year int, week int, name_key string, player_id string, team string, " + ", ".join(f"{c} int" for c in STATS))


@pytest.mark.parametrize("parts", [FIELD_PARTS, GRADING_PARTS], ids=["fields", "grading"])
def test_stat_of_reads_what_unpivot_lists(spark, parts):
    stats = box_scores(spark)
    want = {(r.name_key, r.week, r.category): r.value for r in unpivot_stats(stats, parts, ["name_key", "week"]).collect()}
    asked = stats.select("name_key", "week", stat_struct(parts).alias("s")).crossJoin(spark.createDataFrame([(c,) for c in [*parts, "other"]], "category string"))
    got = {(r.name_key, r.week, r.category): r.v for r in asked.withColumn("v", stat_of(parts, "category", "s")).collect()}
    assert {k: v for k, v in got.items() if k[2] != "other"} == want
    assert all(v is None for k, v in got.items() if k[2] == "other")


def test_graded_bets_and_props_join_one_row_per_name(spark):
    """No row per category is made of the stats: a broadcast of that form passes many times the table through the driver."""
    stats = box_scores(spark)
    bets = spark.createDataFrame([("P1 Last", "DEN", 2001, 1, "rushing-yards", "Over", 5.5, 100.0, "ev", "b"), ("P9 Other", "DEN", 2001, 1, "receptions", "Over", 5.5, 100.0, "ev", "b")],
                                 "player_name string, team string, year int, week int, category string, side string, line double, odds double, source string, book string")
    done = stats.select("year", "week", "team")
    graded = TR.grade(bets, stats, done)
    props = spark.createDataFrame([("a", 2001, 1, "p1 last", "rush_yds", 5.5), ("b", 2001, 1, "p9 last", "rec", 5.5), ("c", 2001, 1, "p1 last", "kicks", 5.5), ("d", 2001, 1, None, "rec", 5.5)],
                                  "prop_id string, year int, week int, name_key string, stat_field string, line double")
    scored = C.score_props(props, stats, [stats.select("year", "week", "name_key", "team")], done)
    assert "Generate" not in plan_of(graded) and "Generate" not in plan_of(scored)
    yards = float(stats.where("name_key = 'p1 last' AND week = 1").first().rush_yds or 0)
    assert {r.player_name: r.actual for r in graded.collect()} == {"P1 Last": yards, "P9 Other": None}
    assert {r.prop_id: r.actual for r in scored.collect()} == {"a": yards, "b": None, "c": None, "d": None}


def lineitem(spark, folder, rows):
    spark.createDataFrame(rows, LINEITEM).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_market_payloads_of_players_with_one_name(spark, tmp_path):
    """Parts 5 and 1,000,005 have one name and category; both are quoted by one book in one scrape."""
    import __spark_entry__ as entry

    rows = [(o, p, 1, 1, 10.0, 100.0, 0.01, 0.02, "N", None) for p in (5, 1_000_005) for o in (13, 26)]
    got = entry.queries()["src10_market_json"](spark, lineitem(spark, tmp_path, rows)).collect()
    assert len(got) == 4 and len({r.player_name for r in got}) == 1


def shuffled_types(df):
    """The column types of every shuffle in the plan."""
    found = []

    def walk(node):
        if node.nodeName() == "Exchange":
            found.append([node.output().apply(i).dataType().simpleString() for i in range(node.output().size())])
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Orders, lines and customers with repeated, unknown and NULL keys."""
    folder = tmp_path_factory.mktemp("odd")
    lines = [(o if o % 11 else None, o % 7 if o % 5 else None, o % 13, n, float(o * n % 40) if o % 3 else None, 1.0, 0.01 * (o % 9), 0.01 * (n % 9), "RAN"[o % 3], None)
             for o in range(80) for n in (1, 2, 2, 5)]
    lineitem(spark, folder, lines)
    orders = [(o // 2 if o % 10 == 0 else o, o % 9 - 1 if o % 8 else None, None if o % 4 == 0 else "FOP"[o % 3], 1.0, dt.datetime(1995 + o % 2, 1 + o % 3, 5), "1-URGENT") for o in range(90)]
    spark.createDataFrame(orders, ORDERS).write.parquet(f"{folder}/orders.parquet")
    customers = [(c % 7, "c", c, 10.0, "BUILDING" if c % 2 else "FURNITURE") for c in range(8)] + [(None, "c", 1, 1.0, "BUILDING")]
    spark.createDataFrame(customers, CUSTOMER).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


@pytest.fixture
def whole_plans(spark):
    """Plans that show their shuffles before they run."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", sorted(V.MADE))
def test_staged_views_hold_the_rows_of_their_sql(spark, odd_tables, name):
    t = V.Tables(spark, odd_tables)
    staged, view = t.staged(name), t.unstaged(name)
    assert staged.dtypes == view.dtypes and view.count() > 10
    assert staged.exceptAll(view).isEmpty() and view.exceptAll(staged).isEmpty()


@pytest.mark.parametrize("name", sorted(V.MADE))
def test_staged_views_shuffle_numbers(spark, odd_tables, whole_plans, name):
    """No text made of a key goes through a shuffle; the order status and the customer's segment are read texts, on rows per order or customer."""
    shuffles = shuffled_types(V.MADE[name](V.Tables(spark, odd_tables), 4))
    assert shuffles and all(types.count("string") <= (name == "player_weeks") for types in shuffles)


def test_player_weeks_are_joined_in_as_many_tasks_as_buckets(spark, odd_tables):
    """Spark puts partitions of a small shuffle together, one per core; dealt by number they stay apart, so a task does not grow with the tables. Customers are not broadcast."""
    weeks = V.staged_player_weeks(V.Tables(spark, odd_tables), 11)
    assert weeks.collect()
    plan = weeks._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    for key in ("o_orderkey", "l_orderkey"):
        assert any(f"hashpartitioning({key}#" in line and ", 11)" in line for line in plan.splitlines()), key
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert len(joins) == 2 and "BroadcastExchange" not in plan


def test_fair_prices_of_staged_quotes_shuffle_fitted_prices_alone(spark, odd_tables, whole_plans):
    """Groups and joins within a prop stay where the staged quotes lie; only what comes back from Python is dealt again."""
    from chalkline.plans import market as M

    rows = M.find_ev_two_way(V.Tables(spark, odd_tables).quotes)
    assert len(shuffled_types(rows)) == 1 and rows.count() >= 0


@pytest.mark.parametrize("name", ["mk3_balanced_stakes", "fn22_outcome_probs", "flt3_exclude_books"])
def test_row_by_row_queries_shuffle_nothing(spark, odd_tables, whole_plans, name):
    import __spark_entry__ as entry

    assert shuffled_types(entry.queries()[name](spark, odd_tables)) == []


def test_names_are_normalised_for_closing_rows_alone(spark, whole_plans):
    """The plan that meets the bets reads closing rows with their keys; no name pattern runs over the archive a second time."""
    at = dt.datetime(2001, 1, 1, 12)
    quotes = [(2001, 1, "DEN", "P1 Last Jr.", "receptions", b, 4.5, 110.0, -120.0, at + dt.timedelta(hours=h), "true") for b in ("DraftKings", "bet365") for h in (-2, -1, 1)]
    archive = spark.createDataFrame(quotes, "year int, week int, team string, player_name string, category string, book string, line double, over_odds double, under_odds double, scraped_at timestamp, available string")
    games = spark.createDataFrame([(2001, 1, "DEN", at)], "year int, week int, team string, kickoff timestamp")
    bets = spark.createDataFrame([(2001, 1, "P1 Last", "receptions", 4.5, "draftkings", "Over", 120.0)], "year int, week int, player_name string, category string, line double, book string, side string, odds double")
    rows = TR.closing(bets, TR.closing_snapshots(archive, games))
    assert "scraped_at" not in plan_of(rows)
    got = rows.first()
    assert (got.close_odds, got.clv_pct, got.close_fair_prob) == (110.0, 4.76, 0.4661)


def test_fitting_passes_against_plain_sums(spark):
    """NULL features leave their own terms out and nothing else."""
    import numpy as np
    from chalkline.plans import model as MD

    columns = [*MD.SHARES, *MD.ADJUSTMENTS]
    rows = [(0, float(i % 2), 20.0 + i % 5, *[None if (i + k) % 7 == 0 else 0.01 * ((i * (k + 3)) % 29) for k in range(len(columns))]) for i in range(60)]
    train = spark.createDataFrame(rows, "candidate int, tds double, implied_total double, " + ", ".join(f"{c} double" for c in columns))
    theta = np.linspace(0.1, 0.5, len(columns))
    loss, gradient, curve = MD._passes(train, {0: theta}, -2.0, 0.9)[0]
    k, want_loss, grads = len(MD.SHARES), [], [[] for _ in columns]
    for _, tds, implied, *x in rows:
        whole = all(v is not None for v in x)
        xw = sum(t * v for t, v in zip(theta, x[:k])) if all(v is not None for v in x[:k]) else None
        rate = np.exp(-2.0 + 0.9 * np.log(implied)) * xw * np.exp(sum(t * v for t, v in zip(theta[k:], x[k:]))) if whole else None
        lam = max(rate, MD.RATE_FLOOR) if whole else MD.RATE_FLOOR
        p, y = min(max(1 - np.exp(-lam), MD.CLIP), 1 - MD.CLIP), float(tds > 0)
        want_loss.append(-(y * np.log(p) + (1 - y) * np.log(1 - p)))
        d = (p - y) / (p * (1 - p)) * np.exp(-lam) if lam > MD.RATE_FLOOR and MD.CLIP < p < 1 - MD.CLIP else 0.0
        for i, v in enumerate(x):
            if v is not None:
                grads[i].append(d * v * (lam / max(xw if xw is not None else 1e-12, 1e-12) if i < k else lam))
    assert abs(loss - np.mean(want_loss)) < 1e-9
    assert np.allclose(gradient, [np.mean(g) for g in grads], rtol=1e-9, atol=1e-12)
    assert curve.shape == (len(columns), len(columns)) and np.allclose(curve, curve.T)
