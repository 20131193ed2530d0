"""Which rules hide roles, and which hidden roles deserve a look."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingworks.functions import terms as tm
from postingworks.functions import text as tx
from postingworks.functions.scale import lookup


def rule_histogram(hidden: DataFrame, top: int | None = None) -> DataFrame:
    """Roles hidden per rule term, most frequent first; `top` is the report's length."""
    counts = hidden.groupBy("rule_term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_term")
    return counts if top is None else counts.limit(top)


def flag_hidden(hidden: DataFrame, watch_terms: Sequence[str], intentional: Sequence[str], reported: DataFrame) -> DataFrame:
    """Hidden roles whose title holds a watched term and whose rule is not intentional; `is_new` if not reported before."""
    flagged = (hidden.where(~F.col("rule_term").isin(*intentional)) if intentional else hidden).where(
        tm.contains_any(F.col("title"), watch_terms))
    known = reported.select(F.col("id").alias("_id")).distinct()
    return (flagged.withColumn("id", tx.entry_id(F.col("company"), F.col("posting_id")))
            .join(known, F.col("id") == F.col("_id"), "left")
            .withColumn("is_new", F.col("_id").isNull()).drop("_id"))


def hidden_report(hidden: DataFrame) -> DataFrame:
    """Hidden rows with the size of their rule, in report order: big rules first."""
    sizes = hidden.groupBy("rule_term").agg(F.count(F.lit(1)).alias("rule_n"))
    return lookup(hidden, sizes, ["rule_term"], ["posting_id"], "inner").orderBy(F.desc("rule_n"), "rule_term", "company", "ord")
