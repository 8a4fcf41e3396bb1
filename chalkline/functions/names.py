"""Player-name keys and the small text parsers around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline.functions.values import as_col, blank_to_null

# Fixed value: generational suffixes that are dropped from a name key.
SUFFIX_PATTERN = r"\s+(jr|sr|ii|iii|iv|v)$"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_name(name: Column | str) -> Column:
    """Lower-case letters, digits and single spaces; a trailing suffix goes only if two words remain."""
    letters = F.regexp_replace(_stripped(F.lower(as_col(name).cast("string"))), "[^a-z0-9 ]", "")
    key = F.regexp_replace(letters, r"\s+", " ")
    short = F.trim(F.regexp_replace(key, SUFFIX_PATTERN, ""))
    return F.when(F.contains(short, F.lit(" ")), short).otherwise(key)


def plain_name_key(name: Column | str, flip_comma: bool = False) -> Column:
    """Older key: punctuation removal only, optionally turning 'Last, First' around first."""
    text = as_col(name).cast("string")
    if flip_comma:
        parts = F.split(text, ",")
        text = F.when(F.size(parts) == 2, F.concat_ws(" ", F.trim(parts[1]), F.trim(parts[0]))).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""))


def name_key(stored: Column | str, display: Column | str) -> Column:
    """Key from the first of (stored key, display name) that is not blank; '' when both are."""
    return F.coalesce(normalize_name(F.coalesce(blank_to_null(stored), blank_to_null(display))), F.lit(""))


def last_name(key: Column | str) -> Column:
    return F.element_at(F.split(F.trim(as_col(key)), " "), -1)


def depth_chart_name(text: Column | str) -> Column:
    """'DAWKINS, DION 17/2' -> 'Dion Dawkins'; text without a comma is only trimmed."""
    raw = as_col(text)
    comma = F.instr(raw, ",")
    last = F.trim(F.substring_index(raw, ",", 1))
    rest = F.trim(raw.substr(comma + F.lit(1), F.length(raw)))
    first = F.split(rest, r"\s+")[0]

    def title(c: Column) -> Column:
        shout = (F.upper(c) == c) & (F.lower(c) != c)
        return F.when(shout, F.initcap(c)).otherwise(c)

    return F.when(comma == 0, F.trim(raw)).otherwise(F.trim(F.concat_ws(" ", title(first), title(last))))


def parse_matchup(text: Column | str) -> Column:
    """'CIN vs TB' (home) / 'DAL @ NYG' (away) -> struct(team, opponent, home_away); NULL for anything else."""
    raw = as_col(text)
    sides = F.split(raw, " vs | @ ")
    return F.when(
        F.size(sides) == 2,
        F.struct(F.trim(sides[0]).alias("team"), F.trim(sides[1]).alias("opponent"),
                 F.when(F.contains(raw, F.lit(" vs ")), F.lit("h")).otherwise(F.lit("a")).alias("home_away")),
    )


def signed_odds(odds: Column | str) -> Column:
    """115 -> '+115', -120 -> '-120'."""
    n = as_col(odds).cast("bigint")
    return F.when(n >= 0, F.concat(F.lit("+"), n.cast("string"))).otherwise(n.cast("string"))


def odds_week_note(odds_year: Column, odds_week: Column, page_year: Column, page_week: Column,
                   blanked: bool = False) -> Column:
    """Note when the loaded lines are for another week than the page; NULL when equal or unknown."""
    odds_year, odds_week, page_year, page_week = (as_col(c) for c in (odds_year, odds_week, page_year, page_week))
    same_year = odds_year == page_year
    loaded = F.when(same_year, F.format_string("Week %d", odds_week)).otherwise(
        F.format_string("Week %d, %d", odds_week, odds_year))
    shown = F.when(same_year, F.format_string("Week %d", page_week)).otherwise(
        F.format_string("Week %d, %d", page_week, page_year))
    silent = odds_week.isNull() | page_week.isNull() | (same_year & (odds_week == page_week))
    if blanked:
        note = F.concat(F.lit("Odds are blank: the loaded lines are for "), loaded, F.lit(", not "), shown, F.lit("."))
    else:
        older = (odds_year < page_year) | (same_year & (odds_week < page_week))
        note = F.when(older, F.concat(F.lit("These are "), loaded, F.lit(" lines. "), shown,
                                      F.lit(" lines aren't loaded yet."))).otherwise(
            F.concat(F.lit("These are "), loaded, F.lit(" lines. The current week is "), shown, F.lit(".")))
    return F.when(~silent, note)
