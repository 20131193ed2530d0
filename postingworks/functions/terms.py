"""Whole-word term lists with alias expansion, as one alternation pattern whatever the list's length.

A second form by word runs exists under a name of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingworks.functions import fixed_values as fv
from postingworks.functions.spans import let
from postingworks.functions.text import java_literal


def variants(term: str) -> set[str]:
    """A term with its aliases, one hop."""
    key = term.lower()
    if key in fv.TERM_ALIASES:
        return {term, fv.TERM_ALIASES[key]}
    return {term} | {phrase for phrase, short in fv.TERM_ALIASES.items() if short == key}


def expand(terms: Iterable[str]) -> list[str]:
    every: set[str] = set()
    for term in terms:
        every |= variants(term)
    return sorted(every, key=lambda t: (-len(t), t))


def clean_terms(terms: Iterable[str]) -> list[str]:
    """Ordered list without blanks and repeats."""
    return [t for t in dict.fromkeys(terms) if t]


def pattern(terms: Iterable[str]) -> str:
    """Pattern for any of the terms as whole words; the longest wins at one place."""
    return "(?iu)(?<![A-Za-z0-9])(?:" + "|".join(java_literal(t) for t in expand(terms)) + ")(?![A-Za-z0-9])"


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """True when any term (or alias) stands in the text as a whole word."""
    if not terms:
        return F.lit(False)
    return F.coalesce(text.rlike(pattern(terms)), F.lit(False))


def first_match(text: Column, terms: Sequence[str]) -> Column:
    """Text of the leftmost match, the longest there; null when none."""
    if not terms:
        return F.lit(None).cast("string")
    return F.nullif(F.regexp_extract(text, pattern(terms), 0), F.lit(""))


def word_ngrams(text: Column, longest: int) -> Column:
    """Every run of up to `longest` words with the text between them as written, lower case."""
    lowered = F.lower(text)
    words = F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0))
    # text between two words; the first piece stands before the first word
    gaps = F.split(lowered, "[a-z0-9]+", -1)

    def runs(t: Column) -> Column:
        def run(length: int) -> Column:
            def join(i: Column) -> Column:
                steps = [x for k in range(length - 1) for x in (t["words"][i + k], t["gaps"][i + k + 1])]
                return F.concat(*steps, t["words"][i + length - 1])
            return F.when(F.size(t["words"]) >= length, F.transform(
                F.sequence(F.lit(0), F.size(t["words"]) - length), join)).otherwise(F.array().cast("array<string>"))
        return F.concat(t["words"], *[run(n) for n in range(2, longest + 1)])

    return let(F.struct(words.alias("words"), gaps.alias("gaps")), runs)


def contains_any_ngrams(text: Column, terms: Sequence[str]) -> Column:
    """`contains_any` by word runs, for vocabularies whose pattern would be slow: a caller names it, no length chooses it.

    Letters are compared in lower case, without the pattern's further case folding. Terms that start or end with punctuation keep the pattern.
    """
    every = expand(t.lower() for t in terms)
    plain = [t for t in every if re.fullmatch(r"[a-z0-9](?:.*[a-z0-9])?", t)]
    odd = [t for t in every if t not in set(plain)]
    longest = max((len(re.findall(r"[a-z0-9]+", t)) for t in plain), default=1)
    hit = F.arrays_overlap(word_ngrams(text, longest), F.array(*[F.lit(t) for t in plain])) if plain else F.lit(False)
    if odd:
        hit = hit | text.rlike(pattern(odd))
    return F.coalesce(hit, F.lit(False))


def alias_table(spark) -> DataFrame:
    """The phrase and acronym pairs as a table."""
    return spark.createDataFrame(list(fv.TERM_ALIASES.items()), "phrase string, acronym string")


def expand_table(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """Term table with one row per variant: the term, a phrase's acronym, or all phrases of an acronym."""
    key = F.lower("term")
    as_phrase = terms.join(aliases, key == F.col("phrase")).select("term", F.col("acronym").alias("variant"))
    as_acronym = (terms.join(aliases, key == F.col("acronym"))
                  .join(aliases.select(F.col("phrase").alias("p")), F.lower("term") == F.col("p"), "left_anti")
                  .select("term", F.col("phrase").alias("variant")))
    return terms.select("term", F.col("term").alias("variant")).unionByName(as_phrase).unionByName(as_acronym).distinct()
