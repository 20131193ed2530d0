"""Date parsing. Every function that depends on the day takes it as `as_of`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postingworks.functions import fixed_values as fv

ISO_START = r"^\d{4}-\d{2}-\d{2}"
_PERIOD_DAYS = {"hour": 0, "day": 1, "week": 7, "month": 30, "year": 365}
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
# age bucket -> midpoint in days
AGE_BUCKET_MIDPOINTS = {1: 0, 2: 1, 3: 4, 4: 11, 5: 18, 6: 25}


def iso_date(text: Column) -> Column:
    """Leading `yyyy-MM-dd` of a stamp."""
    return F.when(text.rlike(ISO_START), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def posted_text_date(text: Column, as_of: Column) -> Column:
    """`Posted 5 Days Ago` as a date; `30+` is a floor, so it stays unknown."""
    pattern = r"(?i)posted\s+(today|yesterday|(\d+)(\+?)\s*day)"
    word = F.lower(F.regexp_extract(text, pattern, 1))
    days = F.regexp_extract(text, pattern, 2).try_cast("int")
    return (F.when(word == "today", as_of).when(word == "yesterday", F.date_sub(as_of, 1))
            .when((word != "") & (F.regexp_extract(text, pattern, 3) == ""), F.date_sub(as_of, days)))


def age_text_date(text: Column, as_of: Column) -> Column:
    """`about 2 weeks` or an ISO stamp as a date."""
    text = F.trim(text)
    pattern = r"(?i)^(?:about |over |almost )?(\d+|a|an)\s+(hour|day|week|month|year)s?\b"
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    count = F.regexp_extract(text, pattern, 1)
    n = F.when(F.lower(count).isin("a", "an"), 1).otherwise(count.try_cast("int"))
    per = F.lit(None).cast("int")
    for name, days in _PERIOD_DAYS.items():
        per = F.when(unit == name, days).otherwise(per)
    return F.when(text.rlike(ISO_START), iso_date(text)).otherwise(F.date_sub(as_of, n * per))


def loose_posted_date(text: Column, as_of: Column) -> Column:
    """ISO, or `Tue Nov 03` with an optional year; a yearless date over 30 days ahead is last year's."""
    text = F.trim(text)
    pattern = r"^[A-Za-z]{3},? ([A-Za-z]{3}) (\d{1,2})\b"
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.regexp_extract(text, pattern, 1)).cast("int")
    day = F.regexp_extract(text, pattern, 2).try_cast("int")
    year = F.regexp_extract(text, r"\b(20\d\d)\b", 1).try_cast("int")

    def build(y: Column) -> Column:
        return F.try_to_date(F.format_string("%04d-%02d-%02d", y, month, day), "yyyy-MM-dd")

    guess = build(F.year(as_of))
    yearless = F.when(F.datediff(guess, as_of) > 30, build(F.year(as_of) - 1)).otherwise(guess)
    named = F.when(year.isNotNull(), build(year)).otherwise(yearless)
    return F.when(text.rlike(ISO_START), iso_date(text)).when(month > 0, named)


def first_format(text: Column, formats: Sequence[str]) -> Column:
    """First of several exact formats that reads the text."""
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def page_date(html: Column) -> Column:
    """`datePosted` of a page: ISO or a written-out month."""
    value = F.trim(F.regexp_extract(html, r'"datePosted"\s*:\s*"([^"]+)"', 1))
    return F.coalesce(iso_date(value), first_format(value, ("MMM d, yyyy", "MMMM d, yyyy")))


def rfc822_date(text: Column) -> Column:
    """Calendar date of a feed's pubDate in its own time zone."""
    body = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    return first_format(F.regexp_extract(body, r"^(\d{1,2} [A-Za-z]{3} \d{4})\b", 1), ("d MMM yyyy",))


def epoch_date(value: Column, unit: str = "millis") -> Column:
    """UTC date of an epoch value."""
    seconds = F.floor(value / 1000) if unit == "millis" else F.floor(value)
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


def us_date(text: Column) -> Column:
    return first_format(F.regexp_extract(text, r"(\d{1,2}/\d{1,2}/\d{4})", 1), ("M/d/yyyy",))


def dotted_date(text: Column) -> Column:
    return first_format(text, ("dd.MM.yyyy",))


def named_month_date(text: Column) -> Column:
    """`03-Nov-2026`, `3 Nov 2026`, `Nov 3, 2026` or `November 3, 2026`."""
    return first_format(F.trim(text), ("d-MMM-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy"))


def stamp_or_sitemap(stamp: Column, sitemap_date: Column) -> Column:
    """Whole-hour and date-only stamps are exact; anything else is a render time, so the sitemap date stands in."""
    exact = stamp.rlike(r"^\d{4}-\d\d-\d\dT\d\d:00:00(\.000)?Z?$") | stamp.rlike(r"^\d{4}-\d\d-\d\d$")
    exact = F.coalesce(exact, F.lit(False))
    return F.struct(
        F.when(exact, iso_date(stamp)).otherwise(sitemap_date).alias("posted"),
        F.when(exact, "exact").when(sitemap_date.isNotNull(), "approx").alias("posted_source"))


def drop_render_stamp(posted: Column, as_of: Column) -> Column:
    """A page date equal to the reading day says nothing."""
    return F.nullif(posted, as_of)


def start_date_or_age(start: Column, age_text: Column, as_of: Column) -> Column:
    """A start date up to a day ahead is exact; else the relative text, which is approximate."""
    day = iso_date(start)
    fallback = posted_text_date(age_text, as_of)
    ok = F.coalesce(day <= F.date_add(as_of, 1), F.lit(False))
    return F.struct(
        F.when(ok, day).otherwise(fallback).alias("posted"),
        F.when(ok, "exact").when(fallback.isNotNull(), "approx").otherwise("unknown").alias("posted_source"))


def age_bucket_date(bucket: Column, as_of: Column) -> Column:
    """Midpoint date of an age bucket; take the smallest bucket of a posting, the buckets are cumulative."""
    days = F.lit(None).cast("int")
    for number, mid in AGE_BUCKET_MIDPOINTS.items():
        days = F.when(bucket == number, mid).otherwise(days)
    return F.date_sub(as_of, days)


def provenance(posted: Column, source: Column, board_type: Column) -> Column:
    """Stated source; else exact for native dates and approx for the board type with relative text."""
    native = F.when(board_type == fv.RELATIVE_DATE_TYPE, "approx").otherwise("exact")
    return F.coalesce(F.nullif(source, F.lit("")), F.when(posted.isNotNull(), native))


def floor_artifact(posted: Column, first_seen: Column) -> Column:
    """True for dates 29 or 30 days before the first sighting: the mark of a `30+ days` floor read as a date."""
    return F.coalesce(F.datediff(first_seen, posted).isin(29, 30), F.lit(False))
