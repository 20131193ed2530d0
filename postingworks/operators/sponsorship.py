"""Work-authorisation facts in description text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingworks.functions import fixed_values as fv
from postingworks.functions.spans import excerpt, first_span, matches, shaped, spans, window
from postingworks.session import built_once

# words of which a text must hold one before the pattern at the same place in its list can match
_HARD_NEEDS = (
    "citizen", "itar", "secret|ts/sci", "citizen", "citizen", "citizen|permanent", "permanent", "limited|restricted",
    "eligible", "immigration", "citizen", "secret|ts/sci", "secret|ts/sci", "secret|ts/sci", "persons", "person",
    "citizen", "citizen", "ongoing", "permanently|indefinitely", "permanently", "permanent", "permanent|indefinite",
    "restricted", "participate")
_SOFT_NEEDS = ("sponsor",) * 13 + (
    "eligible", "need", "itar", "secret|ts/sci", "citizen", "citizen", "citizen|permanent", "permanent",
    "limited|restricted", "eligible", "apply", "immigration|visa", "immigration|visa", "immigration|visa", "requir",
    "without")


def _mentions(plain: Column, needs: str) -> Column:
    found = F.lit(False)
    for word in needs.split("|"):
        found = found | plain.contains(word)
    return found


def plain_abbreviations(text: Column) -> Column:
    """`U.S.A.` as `U S A `: the length stays, so offsets into the original text stay valid."""
    out = text
    for letters in ("USA", "US", "UK"):
        find = r"(?i)\b" + "".join(rf"({c})\." for c in letters)
        out = F.regexp_replace(out, find, "".join(f"${i} " for i in range(1, len(letters) + 1)))
    return out


def _quote(text: Column, span: Column) -> Column:
    return F.concat(F.lit("..."), excerpt(text, span["start"], span["end"], 50), F.lit("..."))


def _training_words(plain: Column, span: Column) -> Column:
    """What each training-authorisation word around a refusal says: refused, stem_refused or stem_welcome."""
    near = window(plain, span["start"] - fv.OPT_WINDOW_CHARS, span["end"] + fv.OPT_WINDOW_CHARS)
    offset = F.greatest(span["start"] - fv.OPT_WINDOW_CHARS, F.lit(0))

    def verdict(k: Column) -> Column:
        stem = (F.lower(k["match"]) == "opt") & matches(window(near, k["start"] - 8, k["start"]), r"stem\s*$")
        around = window(plain, offset + k["start"] - 150, offset + k["end"] + 150)
        return (F.when(matches(window(near, k["start"] - 300, k["start"]), fv.SIGNOFF_WORDS), "refused")
                .when(~stem, "refused")
                .when(matches(around, fv.STEM_OPT_WELCOME), "stem_welcome")
                .otherwise("stem_refused"))

    return F.transform(spans(near, fv.OPT_WORD), verdict)


def _refusing(words: Column) -> Column:
    """The first training-authorisation word that decides, null when all are welcome."""
    return F.get(F.filter(words, lambda w: w != "stem_welcome"), 0)


@built_once
def _stages(text: str) -> list[tuple[str, Column]]:
    """The columns of the reading, each building on the ones before it."""
    raw, plain = F.col(text), F.col("_plain")
    # the first hard pattern in list order decides, wherever it stands
    hard = F.coalesce(*[F.when(_mentions(plain, needs) & matches(plain, p), first_span(plain, p))
                        for needs, p in zip(_HARD_NEEDS, fv.HARD_BLOCK_PATTERNS, strict=True)])
    empty = F.array().cast("array<struct<start:int,end:int,match:string,groups:array<string>>>")
    refusals = F.flatten(F.array(*[
        F.when(_mentions(plain, needs) & matches(plain, p), spans(plain, p)).otherwise(empty)
        for needs, p in zip(_SOFT_NEEDS, fv.SOFT_BLOCK_PATTERNS, strict=True)]))
    first, block = F.col("_first"), F.col("_block")
    welcome = F.exists("_read", lambda m: F.array_contains(m["words"], "stem_welcome"))
    later = matches(window(plain, first["start"], first["end"] + 60), r"\bfuture\b")
    tag = F.when(welcome, "[STEM OPT welcome] ").when(later, "[now or future] ").otherwise("")
    return [
        ("_plain", F.lower(shaped(plain_abbreviations(raw)))),
        ("_hard", hard),
        ("_soft", F.when(plain.isNotNull() & F.col("_hard").isNull(), refusals)),
        ("_read", F.transform("_soft", lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), _training_words(plain, m).alias("words")))),
        ("_first", F.get("_read", 0)),
        ("_block", F.get(F.filter("_read", lambda m: _refusing(m["words"]).isNotNull()), 0)),
        ("sponsorship_status", F.when(F.col("_hard").isNotNull() | block.isNotNull(), "Blocked")
         .when(first.isNotNull(), "OPT Only").otherwise("Unclear")),
        ("sponsorship_evidence", F.when(raw.isNull() | (raw == ""), "Description unavailable; not checked.")
         .when(F.col("_hard").isNotNull(), _quote(raw, F.col("_hard")))
         .when(block.isNotNull(), F.concat(
             F.when(_refusing(block["words"]) == "stem_refused", "[no STEM OPT] ").otherwise(""), _quote(raw, block)))
         .when(first.isNotNull(), F.concat(tag, _quote(raw, first)))
         .otherwise("No sponsorship language in the description.")),
    ]


def classify_sponsorship(df: DataFrame, text: str = "description") -> DataFrame:
    """Adds `sponsorship_status` (Blocked, OPT Only, Unclear) and `sponsorship_evidence`."""
    stages = _stages(text)
    for name, column in stages:
        df = df.withColumn(name, column)
    return df.drop(*[name for name, _ in stages if name.startswith("_")])


def sponsorship_facets(df: DataFrame, text: str = "description") -> DataFrame:
    """Adds `<facet>` and `<facet>_quote` for the three independent facets; the first rule of each wins."""
    raw = F.col("_raw")
    out = df.withColumn("_raw", F.coalesce(F.col(text), F.lit(""))).withColumn("_shape", shaped(raw))
    shape = F.col("_shape")
    for facet, rules in fv.SPONSORSHIP_FACETS.items():
        value, span = F.lit("not stated"), F.lit(None)
        for name, pattern in reversed(rules):
            hit = matches(shape, pattern)
            value = F.when(hit, name).otherwise(value)
            span = F.when(hit, first_span(shape, pattern)).otherwise(span)
        quote = F.concat(F.lit("..."), F.regexp_replace(
            excerpt(raw, F.col("_span")["start"], F.col("_span")["end"], fv.FACET_CONTEXT), r"(?U)\s+", " "), F.lit("..."))
        out = (out.withColumn(facet, value).withColumn("_span", span)
               .withColumn(f"{facet}_quote", F.when(F.col("_span").isNull(), "").otherwise(quote)).drop("_span"))
    return out.drop("_raw", "_shape")


