"""Dates of conversations and relative dates in texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for a day, and words before a span, with their steps.
DAYS = {"yesterday": -1, "today": 0, "tomorrow": 1}
STEPS = {"last": -1, "this": 0, "next": 1}
#: Spans that are counted backwards, and those that a step can name.
COUNTED = ("day", "week", "month", "year")
NAMED = ("week", "weekend", "month", "year")


def _relative() -> str:
    """Relative expressions of those words that no absolute date follows."""
    one_of = lambda words: f"(?:{'|'.join(words)})"
    forms = [one_of(DAYS), rf"{one_of(STEPS)}\s+{one_of(NAMED)}", rf"(?:an?|\d{{1,3}})\s+{one_of(COUNTED)}s?\s+ago"]
    dated = r"\s*\([^)]*\d{4}[^)]*\)"
    return rf"(?iu)\b{one_of(forms)}\b(?!{dated})"


RELATIVE = _relative()


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def iso_or_null(x: Column | str) -> Column:
    """The string if it looks like a date; the calendar isn't asked."""
    return F.when(_col(x).rlike(r"^\d{4}-\d{2}-\d{2}\z"), _col(x))


def conversation_date(ts: Column | str) -> Column:
    """The date of a time stamp in Unix seconds (UTC) or ISO form (in its own offset), else null."""
    t = _col(ts)
    seconds = t.try_cast("double")
    # beyond this a date is out of range
    unix = F.to_date(F.timestamp_seconds(F.when(F.abs(seconds) < 2.5e11, seconds)))
    return F.coalesce(unix, F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(t, 1, 10).try_cast("date")))


def session_time(x: Column | str) -> Column:
    """``1:56 pm on 8 May, 2023`` as an ISO time stamp, else null."""
    return F.date_format(F.try_to_timestamp(_col(x), F.lit("h:mm a 'on' d MMMM, yyyy")), "yyyy-MM-dd'T'HH:mm:ss")


def _absolute(match: Column, base: Column) -> Column:
    parts = F.split(F.lower(match), r"\s+")
    head, unit = parts[0], F.regexp_replace(F.try_element_at(parts, F.lit(2)), "s$", "")
    step = F.coalesce(*[F.when(head == k, F.lit(v)) for k, v in (DAYS | STEPS).items()], -F.coalesce(head.try_cast("int"), F.lit(1)))
    days = F.when(F.coalesce(unit, F.lit("day")) == "day", step).otherwise(step * 7)
    day = F.date_format(F.date_add(base, days), "d MMMM y")
    month = F.date_format(F.add_months(F.trunc(base, "MM"), step), "MMMM y")
    return F.when(unit == "month", month).when(unit == "year", (F.year(base) + step).cast("string")).otherwise(day)


def resolve_relative_dates(text: Column | str, base: Column | str) -> Column:
    """Each relative expression with its absolute date behind it, from the date of the conversation.

    Days and weeks give a day, months and years the month or year.  Without a date the text stays.
    """
    t, b = _col(text), _col(base)
    found = F.regexp_extract_all(t, F.lit(RELATIVE), F.lit(0))
    between = F.split(t, RELATIVE, -1)
    dated = F.transform(found, lambda m: F.concat(m, F.lit(" ("), _absolute(m, b), F.lit(")")))
    joined = F.array_join(F.zip_with(between, dated, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")
    return F.when(b.isNull() | (F.size(found) == 0), t).otherwise(joined)
