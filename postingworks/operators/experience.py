"""Years of experience a description asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingworks.functions import fixed_values as fv
from postingworks.functions.spans import FLAGS, excerpt, first_span, last_end, matches, shaped, spans, window
from postingworks.session import built_once


def _number(token: Column) -> Column:
    words = F.create_map(*[F.lit(x) for i, w in enumerate(fv.NUMBER_WORDS) for x in (w, i)])
    return F.coalesce(token.try_cast("int"), words[F.lower(token)])


def _last_clause(text: Column, ends: str) -> Column:
    return F.element_at(F.split(text, rf"[{ends}]\s", -1), -1)


def _first_clause(text: Column) -> Column:
    return F.split(text, r"[.;!?]\s", -1)[0]


def _is_requirement(text: Column, m: Column) -> Column:
    """True when a stated number of years is a floor the reader must meet."""
    before = window(text, m["start"] - 90, m["start"])
    after = window(text, m["end"], m["end"] + 100)
    clause, tail = _last_clause(before, ".;!?"), _first_clause(after)
    employer_tenure = (matches(clause, fv.TENURE_LEAD) & matches(clause, fv.ORGANISATION_WORDS)
                       & ~matches(clause, fv.CANDIDATE_WORDS))
    about_experience = (matches(F.substring(tail, 1, 80), fv.EXPERIENCE_WORD)
                        | matches(clause, fv.EXPERIENCE_LABEL_BEFORE))
    preferred = (matches(window(clause, F.length(clause) - 30, F.length(clause)), fv.PREFERRED_NEAR)
                 | matches(F.substring(tail, 1, 100), fv.PREFERRED_NEAR))
    heading = window(text, m["start"] - 700, m["start"])
    wish = last_end(heading, fv.PREFERRED_HEADING)
    under_preferred = wish.isNotNull() & (wish > F.coalesce(last_end(heading, fv.REQUIRED_HEADING), F.lit(-1)))
    sentence = _last_clause(before, ".!?")
    alternative = ((matches(sentence, fv.ALTERNATIVE_BEFORE) & matches(sentence, fv.DEGREE_WORDS))
                   | matches(after, fv.DEGREE_ALTERNATIVE_AFTER))
    return (~matches(after, fv.YEARS_NOT_REQUIRED_AFTER) & ~matches(clause, fv.YEARS_NOT_REQUIRED_BEFORE)
            & ~matches(clause, fv.YEARS_CEILING_BEFORE) & ~employer_tenure & about_experience
            & ~preferred & ~under_preferred & ~alternative)


def _plausible(m: Column) -> Column:
    lo, hi = _number(m["groups"][0]), _number(F.nullif(m["groups"][1], F.lit("")))
    top, bottom = F.greatest(lo, F.coalesce(hi, lo)), F.least(lo, F.coalesce(hi, lo))
    return lo.isNotNull() & (top <= fv.EXPERIENCE_MAX_YEARS) & ((bottom > 0) | hi.isNotNull())


@built_once
def _stages(text: str) -> list[tuple[str, Column]]:
    """The columns of the reading, each building on the ones before it."""
    raw, hay = F.col("_raw"), F.col("_hay")
    groups = F.array(*[F.regexp_extract(hay, FLAGS + fv.EXPERIENCE_YEARS, g).try_cast("int") for g in range(1, 5)])
    structured = F.filter(spans(hay, fv.STRUCTURED_YEARS, 1),
                          lambda m: m["groups"][0].cast("int").between(1, fv.EXPERIENCE_MAX_YEARS))
    stated = F.filter(F.filter(spans(hay, fv.STATED_YEARS, 2), _plausible), lambda m: _is_requirement(hay, m))
    entry, plain, field, said = (F.col(c) for c in ("_entry", "_plain", "_field", "_stated"))
    spelled = F.least(_number(said["groups"][0]), _number(F.nullif(said["groups"][1], F.lit(""))))
    return [
        ("_raw", F.coalesce(F.col(text), F.lit(""))),
        ("_hay", shaped(raw)),
        ("_entry", F.when(matches(hay, fv.ENTRY_PHRASE), first_span(hay, fv.ENTRY_PHRASE))),
        # every other form names years
        ("_years", F.col("_entry").isNull() & matches(hay, r"years?\b|yrs?\b")),
        ("_plain", F.when(F.col("_years") & matches(hay, fv.EXPERIENCE_YEARS), F.struct(
            F.array_min(groups).alias("years"), first_span(hay, fv.EXPERIENCE_YEARS).alias("span")))),
        ("_open", F.col("_years") & plain.isNull()),
        ("_field", F.when(F.col("_open") & matches(hay, fv.STRUCTURED_YEARS), F.get(structured, 0))),
        ("_stated", F.when(F.col("_open") & field.isNull(), F.get(stated, 0))),
        ("experience", F.when(entry.isNotNull(), 0).when(plain.isNotNull(), plain["years"])
         .when(field.isNotNull(), field["groups"][0].cast("int")).when(said.isNotNull(), spelled)),
        ("experience_evidence", F.when(entry.isNotNull(), excerpt(raw, entry["start"], entry["end"], 40))
         .when(plain.isNotNull(), excerpt(raw, plain["span"]["start"], plain["span"]["end"], 40))
         .when(field.isNotNull(), excerpt(raw, field["start"], field["end"], 20))
         .when(said.isNotNull(), excerpt(raw, said["start"], said["end"], 40))
         .otherwise("No years-of-experience language found.")),
    ]


def classify_experience(df: DataFrame, text: str = "description") -> DataFrame:
    """Adds `experience` (lowest stated years, 0 for entry level, null when unstated) and `experience_evidence`."""
    stages = _stages(text)
    for name, column in stages:
        df = df.withColumn(name, column)
    return df.drop(*[name for name, _ in stages if name.startswith("_")])
