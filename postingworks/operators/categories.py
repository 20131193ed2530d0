"""Role categories of a title."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingworks.functions.text import java_literal

OTHER = "Other"


def _any_word(terms: Sequence[str]) -> str:
    return r"\b(?:" + "|".join(java_literal(t.lower()) for t in terms) + r")\b"


def merge_terms(terms: DataFrame, merges: DataFrame) -> DataFrame:
    """Category terms `terms(label, label_ord, term, ord)` with labels folded by `merges(member, label)`.

    A merged label keeps every member's terms once, at its first place.
    """
    to = merges.select(F.col("member").alias("_m"), F.col("label").alias("_l"))
    joined = terms.join(to, F.col("label") == F.col("_m"), "left").withColumn("label", F.coalesce("_l", "label"))
    return joined.groupBy("label", "term").agg(F.min(F.struct("label_ord", "ord")).alias("place"))


def merge_labels(fine: Mapping[str, Sequence[str]], merges: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """Category term lists with neighbouring labels merged, terms ordered and distinct."""
    to = {member: label for label, members in merges.items() for member in members}
    merged: dict[str, dict[str, None]] = {}
    for label, terms in fine.items():
        merged.setdefault(to.get(label, label), {}).update(dict.fromkeys(terms))
    return {label: list(terms) for label, terms in merged.items()}


def role_categories(title: Column, categories: Mapping[str, Sequence[str]],
                    exclude: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Every label whose terms stand in the title as whole words and whose exclusions do not; `Other` when none."""
    lowered, exclude = F.lower(title), exclude or {}
    found = []
    for label, terms in categories.items():
        if not terms:
            continue
        hit = lowered.rlike(_any_word(terms))
        if exclude.get(label):
            hit = hit & ~lowered.rlike(_any_word(exclude[label]))
        found.append(F.when(hit, F.lit(label)))
    labels = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit(OTHER)))


def category_counts(rows: DataFrame, labels: str = "categories", section: str = "section") -> DataFrame:
    """Visible rows per section and category."""
    return rows.select(section, F.explode(labels).alias("category")).groupBy(section, "category").agg(
        F.count(F.lit(1)).alias("n"))
