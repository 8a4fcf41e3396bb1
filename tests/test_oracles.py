"""Registered queries next to their SQL oracles on the smallest data. CHALKLINE_ALL=1 runs every query."""

import os

import pytest

import __spark_entry__ as entry
from chalkline.catalog.registry import ORACLES, QUERIES
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
SOME = ["fn1_normalize_name", "fn23_fit_param", "flt1_drop_started", "jn9_asof_before", "jn12_match_player", "ag18_lineup_total", "wn2_rank_in_group",
        "wn3_ewm_mean", "wn9_leave_one_out_median", "st5_add_byes", "dq5_rekey_report", "mk1_arbitrage", "mk5_outliers", "mk9_overround", "mk15_stale_lines", "mk7_ev_two_way", "mk8_ev_one_way",
        "mk14_low_lines", "mk21_grade", "mk22_closing", "rp14_standings_drop_lowest", "rp4_usage_season", "rp8_best_matchups", "rp28_build_usage", "md6_predict", "snk2_upsert", "snk3_upsert_columns", "jn7_compare_join", "jn8_other_books",
        "src10_market_json", "src13_page_records", "ss2_tumbling_windows", "ss4_closing_quote", "ss5_move_since_baseline"]
NAMES = list(QUERIES) if os.environ.get("CHALKLINE_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, message, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert ok, message


def test_entry_is_lazy_and_has_rows(spark):
    assert entry.entry(spark).limit(1).count() >= 0


def test_every_query_but_the_fits_has_an_oracle():
    assert set(QUERIES) - set(ORACLES) == set()
