"""First, last and merged rows per posting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingworks.functions.scale import first_row

POSTING = ["company", "posting_id"]


def first_wins(rows: DataFrame, order=("term_ord", "page_no", "pos")) -> DataFrame:
    """One row per posting: the first across terms, pages and positions."""
    return first_row(rows, POSTING, F.struct(*order))


def last_wins(rows: DataFrame) -> DataFrame:
    """One row per posting: the last values at the place where the posting first stood."""
    rest = [c for c in rows.columns if c not in (*POSTING, "ord")]
    return (rows.groupBy(*POSTING).agg(F.max_by(F.struct(*rest), "ord").alias("_row"), F.min("ord").alias("ord"))
            .select(*POSTING, "_row.*", "ord").select(*rows.columns))


def merge_passes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of two passes over a board; rows of the first pass win."""
    both = first.withColumn("_pass", F.lit(0)).unionByName(second.withColumn("_pass", F.lit(1)))
    return first_row(both, POSTING, F.struct("_pass", "ord")).drop("_pass")


def grow_seen(seen: DataFrame, seeded: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seen ids and seeded companies after a run. Ids only accumulate; an empty first read seeds nothing."""
    now = listing.select(*POSTING)
    return (seen.select(*POSTING).unionByName(now).distinct(),
            seeded.select("company").unionByName(now.select("company")).distinct())


def missing_companies(configured: DataFrame, fetched: DataFrame) -> DataFrame:
    return configured.select("company").join(fetched.select("company"), "company", "left_anti").distinct()


def terms_in_both(terms: DataFrame, other: DataFrame) -> DataFrame:
    return terms.join(other.select("term").distinct(), "term", "left_semi").distinct()
