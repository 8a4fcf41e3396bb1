"""An invented contest with hand-computed lineups, standings, props, breakdowns and usage."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chalkline.plans import contest as C, reports as R

YEAR = 2031
#: slot, name, position, points in week 3 and in week 4
TEAM_SHEET = [("QB", "Tobin Ashgrove", "QB", 18.5, 22.0), ("RB", "Milo Quenby", "RB", 11.0, 4.0), ("RB", "Oren Fell Jr.", "RB", 6.5, 9.5),
              ("WR", "Ansel Wick", "WR", 14.0, 0.0), ("WR", "Rudd Harlan", "WR", 8.0, 16.0), ("WR", "Casper Lund", "WR", 2.5, 7.0),
              ("TE", "Ivo Brandt", "TE", 5.0, 3.5), ("FLEX", "Nils Okoro", "RB", 9.0, 12.0), ("DST", "Denver Broncos", "DST", 7.0, -1.0)]
WEEK_3, WEEK_4 = 81.5, 73.0
KEYS = {n: n.lower().removesuffix(" jr.") for _, n, *_ in TEAM_SHEET}


@pytest.fixture(scope="module")
def parts(spark):
    doc = json.dumps([{"slot": s, "name": n, "position": p, "salary": 5100} for s, n, p, _, _ in TEAM_SHEET])
    lineups = spark.createDataFrame([(w, YEAR, "orchid", doc, 45900) for w in (3, 4)], "week int, year int, submitter string, lineup_json string, total_salary int")
    rows = [(YEAR, w, KEYS[n], "sea", pts[w - 3]) for _, n, p, *pts in TEAM_SHEET for w in (3, 4) if p != "DST"]
    stats = spark.createDataFrame(rows, "year int, week int, name_key string, team string, points double")
    dst = spark.createDataFrame([(YEAR, 3, "den", 7.0), (YEAR, 4, "den", -1.0)], "year int, week int, team string, points double")
    none = spark.createDataFrame([], "year int, week int, name_key string, team string")
    return lineups, stats, dst, none


def totals(parts, stats=None, results=None, slate=None):
    lineups, all_stats, dst, none = parts
    done = none.select("year", "week", "team") if results is None else results
    rows = C.lineup_rows(C.parse_lineups(lineups), all_stats if stats is None else stats, dst, none if slate is None else slate, none, done)
    return C.lineup_totals(rows)


def scores(df):
    return {r.week: r.score for r in df.collect()}


def test_nine_results_make_a_total(parts):
    assert scores(totals(parts)) == {3: WEEK_3, 4: WEEK_4}
    assert scores(totals(parts, parts[1].where("name_key <> 'casper lund'"))) == {3: None, 4: None}


def test_a_repeated_name_keeps_one_slot(spark, parts):
    """A second player of the same name in the same week must not add a scored slot."""
    twin = spark.createDataFrame([(YEAR, 3, "milo quenby", "tam", 40.0)], parts[1].schema)
    got = totals(parts, parts[1].unionByName(twin)).collect()
    assert {r.week: (r.matched, r.score) for r in got} == {3: (9, WEEK_3), 4: (9, WEEK_4)}


def test_absence_counts_zero_after_the_final_whistle(spark, parts):
    without = parts[1].where("NOT (name_key = 'rudd harlan' AND week = 4)")
    slate = spark.createDataFrame([(YEAR, 4, "rudd harlan", "sea")], "year int, week int, name_key string, team string")
    final = spark.createDataFrame([(YEAR, 4, "sea")], "year int, week int, team string")
    assert scores(totals(parts, without, slate=slate)) == {3: WEEK_3, 4: None}
    assert scores(totals(parts, without, final, slate)) == {3: WEEK_3, 4: 57.0}


def test_weeks_that_do_not_count(parts):
    t = totals(parts)
    plain = C.season_standings(t, False, {YEAR: [3]}).first()
    assert (plain.total, plain.weeks_scored) == (WEEK_4, 1)
    only = C.season_standings(t, True, {YEAR: [3]}).first()
    assert only.dropped_week is None and only.total == WEEK_4
    both = C.season_standings(t, True, {}).first()
    assert both.dropped_week == 4 and both.total == WEEK_3


@pytest.fixture(scope="module")
def scored_props(spark):
    bets = spark.createDataFrame([("over", YEAR, 3, "tobin ashgrove", "pass_yds", 199.5), ("push", YEAR, 3, "tobin ashgrove", "rush_att", 4.0), ("out", YEAR, 3, "zed marrow", "rec_yds", 31.5),
                                  ("odd", YEAR, 3, "zed marrow", "no_such_field", 2.0)], "prop_id string, year int, week int, name_key string, stat_field string, line double")
    cols = sorted({c for p in C.S.FIELD_PARTS.values() for c in p})
    rows = spark.createDataFrame([(YEAR, 3, "tobin ashgrove", "sea"), (YEAR, 3, "tobin ashgrove", "tam")], "year int, week int, name_key string, team string")
    stats = rows.withColumns({c: F.when(F.col("team") == "sea", F.lit(4 if c == "rush_att" else 214)).otherwise(F.lit(1)) for c in cols})
    teams = spark.createDataFrame([(YEAR, 3, "zed marrow", "chi")], "year int, week int, name_key string, team string")
    final = spark.createDataFrame([(YEAR, 3, "chi")], "year int, week int, team string")
    return bets, stats, teams, final


def test_props_with_a_repeated_name(scored_props):
    bets, stats, teams, final = scored_props
    rows = C.score_props(bets, stats, [teams], final).collect()
    assert len(rows) == 4 and {r.prop_id: r.result for r in rows} == {"over": "over", "push": "push", "out": "void", "odd": None}
    pending = {r.prop_id: r.result for r in C.score_props(bets, stats, [teams], final.limit(0)).collect()}
    assert pending == {"over": "over", "push": "push", "out": None, "odd": None}


def test_picks_of_a_prop_that_is_gone_are_pending(spark, scored_props):
    bets, stats, teams, final = scored_props
    scored = C.score_props(bets, stats, [teams], final).withColumn("player_name", F.initcap("name_key"))
    picks = spark.createDataFrame([(YEAR, 3, "orchid", "over", "over"), (YEAR, 3, "orchid", "deleted", "under"), (YEAR, 3, "thistle", "deleted", "over")],
                                  "year int, week int, submitter string, prop_id string, pick string")
    graded = C.graded_picks(picks, scored)
    got = {(r.submitter, r.prop_id): (r.result, r.is_correct) for r in graded.collect()}
    assert got == {("orchid", "over"): ("over", True), ("orchid", "deleted"): (None, None), ("thistle", "deleted"): (None, None)}
    assert {r.submitter: (r.picks, r.matched, r.correct) for r in C.pick_totals(graded).collect()} == {"orchid": (2, 1, None), "thistle": (1, 0, None)}


def test_breakdown_explains_the_official_points(spark):
    cols = [c for c, _, _ in C.S.OFFENSE_RATES]
    row = spark.createDataFrame([("x", 40, 2, 3, 25, 22.5)], "k string, rush_yds int, rush_td int, rec int, rec_yds int, actual_pts double")
    row = row.withColumns({c: F.lit(0) for c in cols if c not in row.columns})
    lines = {r.label: r.pts for r in C.offense_breakdown(row, ["k"]).collect()}
    assert lines == {"Rushing yards": 4.0, "Rushing TD": 12.0, "Receptions": 3.0, "Receiving yards": 2.5, "Other": 1.0}
    dst = spark.createDataFrame([("y", 0, 2, 0, 1, 1, 0, 0, 20.0)], "k string, points_allowed int, sack int, interception int, fumble_rec int, def_td int, safety int, special_teams_td int, actual_pts double")
    got = {r.label: r.pts for r in C.defense_breakdown(dst, ["k"]).collect()}
    assert got["Sack"] == 2.0 and got["Points allowed"] == 10.0 and sum(got.values()) == 20.0


def test_pick_submissions_against_locks(spark):
    schema = "year int, week int, submitter string, prop_id string, pick string"
    stored = [(YEAR, 3, "orchid", p, "under") for p in ("p1", "p2", "p3", "p4", "p5")]
    board = spark.createDataFrame([(YEAR, 3, f"p{k}") for k in range(1, 9)], "year int, week int, prop_id string")
    locked = spark.createDataFrame([(YEAR, 3, "p2"), (YEAR, 3, "p8")], "year int, week int, prop_id string")

    def verdict(sent, before):
        return C.validate_picks(spark.createDataFrame(sent, schema), spark.createDataFrame(before, schema), board, locked).first().reason

    swapped = [(*r[:3], "p6", "over") if r[3] == "p4" else r for r in stored]
    assert verdict(stored, stored) is None and verdict(swapped, stored) is None
    assert verdict(stored, []) == "locked change"
    assert verdict([(*r[:4], "over") if r[3] == "p2" else r for r in stored], stored) == "locked change"
    assert verdict([(*r[:3], "p7", "over") if r[3] == "p2" else r for r in stored], stored) == "locked removal"
    assert verdict([(*r[:3], "p9", "over") if r[3] == "p1" else r for r in stored], stored) == "not on board"
    assert verdict(stored[1:], stored) == "pick count"


def test_usage_shares(spark):
    """Two receivers and a back over two weeks; shares are of the team's sums over both."""
    usage = [(w, k, snaps, pct, tgt, air, 50.0, 0.5, car, rec, 1, 1, 0, 0, 0) for w, k, snaps, pct, tgt, air, car, rec in [
        (5, "ansel wick", 50, 80.0, 8, 96.0, 0, 6), (6, "ansel wick", 40, 60.0, 4, 24.0, 0, 2), (5, "milo quenby", 30, 50.0, 2, 4.0, 10, 2), (6, "milo quenby", 34, 54.0, 6, 6.0, 14, 4)]]
    u = spark.createDataFrame(usage, "week int, name_key string, offense_snaps int, offense_pct double, targets int, air_yards double, air_yards_share double, wopr double, carries int, receptions int, "
                              "rz_targets int, rz_carries int, i10_carries int, i5_carries int, third_down_targets int").withColumns({"year": F.lit(YEAR), "team": F.lit("sea")})
    s = spark.createDataFrame([("Ansel Wick", "ansel wick", "WR", 5, 8, 6, 0, 80.0), ("Ansel Wick", "ansel wick", "WR", 6, 4, 2, 0, 60.0), ("Milo Quenby", "milo quenby", "RB", 5, 2, 2, 10, 50.0),
                               ("Milo Quenby", "milo quenby", "RB", 6, 6, 4, 14, 54.0)],
                              "name string, name_key string, position string, week int, rec_tgt int, rec int, rush_att int, snap_pct double").withColumns({"year": F.lit(YEAR), "team": F.lit("sea")})
    r = {x.name: x for x in R.usage_rows(s, u).collect()}
    wick, quenby = r["Ansel Wick"], r["Milo Quenby"]
    assert (wick.target_share, quenby.target_share) == (60.0, 40.0)
    assert (wick.snap_pct, quenby.snap_pct) == (70.0, 52.0)
    assert wick.adot == 10.0 and (quenby.rz_carries, quenby.i10_carries) == (2, 0)


def test_odds_are_of_the_week_of_their_kickoffs(spark):
    schedule = spark.createDataFrame([(YEAR, w, t, f"2031-10-{d} 18:00:00") for w, d in ((5, "05"), (6, "12")) for t in ("chi", "sea", "tam")],
                                     "year int, week int, team string, k string").withColumn("kickoff", F.to_timestamp("k"))
    odds = spark.createDataFrame([("sea", "2031-10-12 18:10:00"), ("tam", "2031-10-12 18:10:00")], "team string, k string").withColumn("kickoff", F.to_timestamp("k"))
    found = R.odds_week(odds, schedule).first()
    assert (found.year, found.week) == (YEAR, 6)
    assert R.odds_for_week(odds, schedule, YEAR, 5).count() == 0 and R.odds_for_week(odds, schedule, YEAR, 6).count() == 2
    undated = odds.withColumn("kickoff", F.lit(None).cast("timestamp"))
    assert R.odds_for_week(undated, schedule, YEAR, 5).count() == 2


def test_a_player_listed_twice_on_the_depth_chart_stays_one_row(spark):
    players = spark.createDataFrame([(YEAR, 3, "ivo brandt", 4000)], "year int, week int, name_key string, salary int")
    props = spark.createDataFrame([(YEAR, 3, "ivo brandt", "receiving-yards", 50.0)], "year int, week int, name_key string, category string, line double")
    depth = spark.createDataFrame([("ivo brandt", 3), ("ivo brandt", 1)], "name_key string, string_rank int")
    rows = R.implied_points_table(players, props, depth).collect()
    assert len(rows) == 1 and rows[0].string_rank == 1 and rows[0].implied_points == 5.0


def test_rows_per_player_are_not_broadcast(spark, scored_props):
    """Sides of one row per player, prop or submitter are merged: several of them broadcast in one plan fill the driver."""
    from chalkline.plans import reports as R

    bets, stats, teams, final = scored_props
    scored = C.score_props(bets, stats, [teams], final).withColumn("player_name", F.initcap("name_key"))
    picks = spark.createDataFrame([(YEAR, 3, "orchid", "over", "over"), (YEAR, 3, "thistle", "out", "under")], "year int, week int, submitter string, prop_id string, pick string")
    schedule = spark.createDataFrame([(YEAR, 3, "chi", None)], "year int, week int, team string, kickoff timestamp")
    board = R.props_board(bets, scored, schedule, F.current_timestamp(), picks)
    kinds = {"graded": (C.graded_picks(picks, scored), 1), "board": (board, 2), "picks": (R.board_picks(board, picks), 5)}
    for name, (df, small) in kinds.items():
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
        assert rows and plan.count("BroadcastHashJoin") <= small, name
        assert plan.count("SortMergeJoin") >= {"graded": 3, "board": 3, "picks": 2}[name], name
    assert {(r.submitter, r.prop_id): r.pick for r in R.board_picks(board, picks).collect() if r.pick} == {("orchid", "over"): "over", ("thistle", "out"): "under"}


def broadcast_keys(df):
    """The modes of the broadcasts of the final plan."""
    found = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        if node.nodeName() == "BroadcastExchange":
            found.append((node.mode().toString(), node.output().mkString(",")))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_broadcasts_of_props_and_boards_have_one_number_as_key(spark, scored_props):
    """A broadcast by text keys takes a page of up to 64 MB on the driver however few rows it has; by year and week it takes what it holds."""
    bets, stats, teams, final = scored_props
    scored = C.score_props(bets, stats, [teams], final).withColumn("player_name", F.initcap("name_key"))
    picks = spark.createDataFrame([(YEAR, 3, "orchid", "over", "over")], "year int, week int, submitter string, prop_id string, pick string")
    schedule = spark.createDataFrame([(YEAR, 3, "chi", dt.datetime(2020, 1, 1))], "year int, week int, team string, kickoff timestamp")
    board = R.props_board(bets, scored, schedule, F.current_timestamp(), picks)
    for df in (C.graded_picks(picks, scored), board, R.board_picks(board, picks)):
        found = broadcast_keys(df)
        assert all(mode.startswith("HashedRelationBroadcastMode(List((shiftleft(cast(") for mode, _ in found)
        assert not any("submitter" in columns for _, columns in found)


def test_teams_of_a_week_are_flagged(spark):
    """Repeated, null and unknown teams and weeks leave every row once; only listed teams are true."""
    from chalkline.operators.joins import flag_teams

    kinds = "year int, week int, team string"
    teams = spark.createDataFrame([(YEAR, 3, "chi"), (YEAR, 3, "chi"), (YEAR, 3, None), (YEAR, None, "sea"), (YEAR, 4, None)], kinds)
    rows = spark.createDataFrame([(YEAR, 3, "chi"), (YEAR, 3, "chi"), (YEAR, 3, "sea"), (YEAR, 3, None), (YEAR, None, "sea"), (YEAR, 4, "chi"), (YEAR, 5, "chi")], kinds)
    found = sorted((r.week or 0, r.team or "", bool(r.hit)) for r in flag_teams(rows, teams, "hit").collect())
    assert found == [(0, "sea", False), (3, "", False), (3, "chi", True), (3, "chi", True), (3, "sea", False), (4, "chi", False), (5, "chi", False)]
