"""Eastern-time rules: kickoffs, the Tuesday rollover, display text and mixed date spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline.functions.values import as_col, blank_to_null

EASTERN = "America/New_York"


def parse_mixed_date(text: Column | str) -> Column:
    """ISO dates and M/D/YY dates as DATE; anything else is NULL."""
    t = blank_to_null(text)
    iso = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), t)
    us = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), t)
    return F.coalesce(F.try_to_timestamp(iso, F.lit("yyyy-M-d")),
                      F.try_to_timestamp(us, F.lit("M/d/yy"))).cast("date")


def kickoff_utc(date_text: Column | str, time_text: Column | str) -> Column:
    """Eastern date + clock time as a UTC timestamp; a missing time means midnight."""
    day = parse_mixed_date(date_text)
    clock = F.coalesce(F.upper(blank_to_null(time_text)), F.lit("12:00AM"))
    clock = F.regexp_replace(clock, r"\s", "")
    local = F.coalesce(
        F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), clock), F.lit("yyyy-MM-dd h:mma")),
        F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), clock), F.lit("yyyy-MM-dd H:mm")),
    )
    return F.to_utc_timestamp(local, EASTERN)


def week_rollover(now_utc: Column | str) -> Column:
    """Most recent Tuesday 04:00 Eastern at or before `now_utc`, as UTC."""
    eastern = F.from_utc_timestamp(as_col(now_utc), EASTERN)
    shifted = F.to_date(eastern - F.expr("INTERVAL 4 HOURS"))
    tuesday = F.date_sub(shifted, F.pmod(F.weekday(shifted) - 1, F.lit(7)).cast("int"))
    return F.to_utc_timestamp(tuesday.cast("timestamp") + F.expr("INTERVAL 4 HOURS"), EASTERN)


def eastern(ts: Column | str) -> Column:
    return F.from_utc_timestamp(as_col(ts), EASTERN)


def eastern_day(ts: Column | str) -> Column:
    return F.date_format(eastern(ts), "EEEE")


def eastern_time(ts: Column | str) -> Column:
    """'1:00 PM', or 'TBD' without a kickoff."""
    return F.coalesce(F.date_format(eastern(ts), "h:mm a"), F.lit("TBD"))
