"""Weather text, weather effect notes, game lines and small label maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline.functions.teams import normalize_team
from chalkline.functions.values import as_col, half_up

WINDY_MPH = 15
FREEZING_F = 32
DEPTH_LABELS = {1: "1st", 2: "2nd", 3: "3rd"}
# Badge code on a depth chart -> status.
STATUS_CODES = {"O": "out", "D": "doubtful", "Q": "questionable", "IR": "ir", "PUP": "pup", "SUS": "suspended"}
# Weeks shown but never counted toward a season.
EXCLUDED_WEEKS = {2026: [1]}


def parse_weather(text: Column | str) -> Column:
    """'60 degrees, relative humidity 74%, wind 5 mph' -> struct of the three parts, '' where absent."""
    raw = F.coalesce(as_col(text), F.lit(""))
    return F.struct(F.regexp_extract(raw, r"(?i)(-?\d+\s*degrees)", 1).alias("temp"),
                    F.regexp_extract(raw, r"(?i)(relative humidity\s*\d+%)", 1).alias("humidity"),
                    F.regexp_extract(raw, r"(?i)(wind\s*\d+\s*mph)", 1).alias("wind"))


def home_spread(text: Column | str, home: Column | str, away: Column | str) -> Column:
    """'Dallas Cowboys -3.0' / 'Pick' -> spread from the home side; NULL when it names neither team."""
    raw = F.trim(as_col(text))
    pattern = r"^(.+?)\s+(-?\d+(?:\.\d+)?)$"
    side = normalize_team(F.regexp_extract(raw, pattern, 1))
    points = F.regexp_extract(raw, pattern, 2).try_cast("double")
    return (F.when(F.lower(raw).startswith("pick"), F.lit(0.0))
            .when(side == as_col(home), points).when(side == as_col(away), -points))


def total_value(text: Column | str) -> Column:
    """'o44.5' / 'u44.5' / '44.5 (over)' -> 44.5."""
    first = F.split(F.trim(as_col(text).cast("string")), r"\s+")[0]
    return F.regexp_replace(first, "^[ou]+", "").try_cast("double")


def implied_team_total(spread: Column | str, over_under: Column, digits: int | None = 1) -> Column:
    total = over_under / 2.0 - as_col(spread) / 2.0
    return total if digits is None else half_up(total, digits)


def weather_effect(roof: Column, wind: Column, temp: Column) -> Column:
    """struct(weather_note, bad_passing_weather); first matching rule wins."""
    w, t = F.floor(wind + 0.5).cast("bigint").cast("string"), F.floor(temp + 0.5).cast("bigint").cast("string")
    note = (F.when(roof == "dome", F.lit("dome: pass yds +7"))
            .when(wind >= 20, F.concat(w, F.lit(" mph wind: pass yds -22, rush yds +15")))
            .when(wind >= WINDY_MPH, F.concat(w, F.lit(" mph wind: pass yds -21, rush yds +4")))
            .when(temp <= FREEZING_F, F.concat(t, F.lit("F: pass yds -18")))
            .when(wind >= 10, F.concat(w, F.lit(" mph wind: pass yds -6 (minor)")))
            .otherwise(F.lit("")))
    bad = F.when(roof == "dome", F.lit(False)).otherwise(
        F.coalesce(wind >= WINDY_MPH, F.lit(False)) | F.coalesce(temp <= FREEZING_F, F.lit(False)))
    return F.struct(note.alias("weather_note"), bad.alias("bad_passing_weather"))


def depth_label(rank: Column | str) -> Column:
    r = as_col(rank)
    out = F
    for k, label in DEPTH_LABELS.items():
        out = out.when(r == k, F.lit(label))
    return F.coalesce(out.otherwise(r.cast("string")), F.lit("-"))


def status_text(code: Column | str) -> Column:
    c = F.upper(F.trim(as_col(code)))
    out = F
    for k, status in STATUS_CODES.items():
        out = out.when(c == k, F.lit(status))
    return out.otherwise(F.lower(c))


def usage_position(position: Column | str) -> Column:
    p = as_col(position)
    return F.when(p == "HB", F.lit("RB")).otherwise(p)


def counts_toward_season(year: Column | str, week: Column | str, excluded: dict[int, list[int]] | None = None) -> Column:
    y, w = as_col(year), as_col(week)
    skip = F.lit(False)
    for season, weeks in (EXCLUDED_WEEKS if excluded is None else excluded).items():
        skip = skip | ((y == season) & w.isin(weeks))
    return ~skip
