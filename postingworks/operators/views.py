"""The queue as its reader sees it: order, search and filters."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingworks.functions import fixed_values as fv
from postingworks.functions.text import java_literal, posted_label
from postingworks.operators.filters import is_season_title

_FIELDS = {"company": "company", "title": "role", "role": "role", "loc": "location", "location": "location"}
SEARCHED = ("company", "role", "location", "experience", "salary", "keywords")


def queue_order() -> list[Column]:
    """Newest first by posting date, else first sighting; more keywords first; then company."""
    return [F.desc_nulls_last(F.coalesce("posted", "first_seen")), F.desc(F.size(F.coalesce("kw_hits", F.array()))),
            F.asc("company"), F.asc("ord")]


def open_queue(queue: DataFrame, as_of: Column, every: bool = False, days: int | None = None) -> DataFrame:
    """The open list in reading order; undated rows stay in any date window."""
    rows = queue if every else queue.where("state = 'new' and closed_on is null")
    if days is not None:
        rows = rows.where(F.col("posted").isNull() | (F.col("posted") >= F.date_sub(as_of, days)))
    return (rows.withColumn("posted_label", posted_label(F.col("posted"), F.col("posted_source"), F.col("first_seen"), as_of))
            .orderBy(*queue_order()))


def _term_column(field: str | None, word: str, prefix: bool, whole: bool, columns: Sequence[str]) -> Column:
    edge = "" if prefix else "([^a-z0-9]|$)"
    pattern = "(^|[^a-z0-9])" + java_literal(word) + edge

    def low(name: str) -> Column:
        return F.lower(F.coalesce(F.col(name).cast("string"), F.lit("")))

    if field:
        return low(field).rlike(pattern)
    hit = F.lit(False)
    if whole:
        for name in columns:
            hit = hit | low(name).rlike(pattern)
        return hit
    return F.concat(*[low(name) for name in columns]).contains(word)


def search(expression: str, columns: Sequence[str] = SEARCHED) -> Column:
    """Condition of a search box text: commas are OR, blanks AND, quotes or up to three letters whole words,
    `field:` limits to a column, a trailing `*` allows any ending."""
    groups = []
    for group in expression.strip().lower().split(","):
        terms = []
        for name, quoted, plain in re.findall(r'(?:([a-z]+):)?(?:"([^"]*)"|(\S+))', group):
            field = _FIELDS.get(name)
            body = quoted or plain
            word = f"{name}:{body}".strip() if name and not field else body.strip()
            prefix = word.endswith("*")
            word = word[:-1] if prefix else word
            if word:
                whole = bool(field) or (bool(quoted) or not plain) or len(word) <= 3
                terms.append(_term_column(field, word, prefix, whole, columns))
        if terms:
            hit = terms[0]
            for t in terms[1:]:
                hit = hit & t
            groups.append(hit)
    if not groups:
        return F.lit(True)
    out = groups[0]
    for g in groups[1:]:
        out = out | g
    return out


def experience_between(low: int, high: int | None, include_unknown: bool = True) -> Column:
    if low == 0 and high is None:
        return F.lit(True)
    known = F.col("experience") >= low
    if high is not None:
        known = known & (F.col("experience") <= high)
    return F.when(F.col("experience").isNull(), F.lit(include_unknown)).otherwise(known)


def age_between(as_of: Column, low: int, high: int | None, include_undated: bool = True) -> Column:
    if low == 0 and high is None:
        return F.lit(True)
    age = F.datediff(as_of, F.coalesce("posted", "first_seen"))
    known = age >= low
    if high is not None:
        known = known & (age <= high)
    return F.when(age.isNull(), F.lit(include_undated)).otherwise(known)


def in_metro(location: Column) -> Column:
    """True when any listed site lies in the metro area; an upstate site only rules itself out."""
    parts = F.split(F.lower(F.coalesce(location, F.lit(""))), r"\s*[;|]\s*", -1)
    return F.exists(parts, lambda p: p.rlike(fv.METRO_AREA) & ~p.rlike(fv.METRO_VETO))


def in_categories(labels: Column, ticked: Sequence[str]) -> Column:
    if not ticked:
        return F.lit(True)
    return F.arrays_overlap(labels, F.array(*[F.lit(t) for t in ticked]))


def has_flags(no_sponsorship: bool = False, season: bool = False, hide_company: str | None = None) -> Column:
    out = F.lit(True)
    if no_sponsorship:
        out = out & (F.col("sponsorship_status") == "OPT Only")
    if season:
        out = out & is_season_title(F.col("role"))
    if hide_company:
        out = out & (F.col("company") != hide_company)
    return out


def section() -> Column:
    """Where a row is shown: the open list, its state, or closed."""
    return (F.when(F.col("closed_on").isNotNull(), "closed").when(F.col("state").isin("new", "opt_only"), "open")
            .otherwise(F.col("state")))


def section_order(name: Column) -> Column:
    known = F.array_position(F.array(*[F.lit(s) for s in fv.SECONDARY_STATE_ORDER]), name)
    return (F.when(name == "open", 0).when(name == "closed", 99).when(known > 0, known)
            .otherwise(len(fv.SECONDARY_STATE_ORDER) + 1)).cast("int")


def public_rows(queue: DataFrame) -> DataFrame:
    """Rows a public page may show: never a personal decision."""
    return queue.where(F.col("state").isin("new", "opt_only", "auto_blocked"))


def sectioned(queue: DataFrame) -> DataFrame:
    return queue.withColumn("section", section()).withColumn("section_ord", section_order(F.col("section")))
