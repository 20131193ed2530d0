"""Board-level facts: completeness, coverage, freshness, floods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postingworks.functions import fixed_values as fv

TERM = ["company", "site", "term"]


def listing_completeness(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Per company: was every term of every site read to its end?

    `pages(company, site, term, page_no, ok, page_size, reported_total)` has one row per request, `rows(.., page_no,
    posting_id)` one per listed posting. A term ends at the first short page or the first page without a new id; a lost
    page before that makes it incomplete, and without an end the distinct ids must reach the reported total.
    """
    first_page = rows.groupBy(*TERM, "posting_id").agg(F.min("page_no").alias("page_no"))
    new_ids = first_page.groupBy(*TERM, "page_no").agg(F.count(F.lit(1)).alias("new_ids"))
    sizes = rows.groupBy(*TERM, "page_no").agg(F.count(F.lit(1)).alias("n_rows"))
    read = (pages.join(sizes, [*TERM, "page_no"], "left").join(new_ids, [*TERM, "page_no"], "left")
            .fillna(0, ["n_rows", "new_ids"]))
    ends = F.col("ok") & ((F.col("n_rows") < F.col("page_size")) | (F.col("new_ids") == 0))
    per_term = read.groupBy(*TERM).agg(
        F.min(F.when(ends, F.col("page_no"))).alias("end_page"),
        F.min(F.when(~F.col("ok"), F.col("page_no"))).alias("lost_page"),
        F.max("reported_total").alias("total"), F.sum("new_ids").alias("ids"))
    lost = F.col("lost_page").isNotNull() & (F.col("end_page").isNull() | (F.col("lost_page") < F.col("end_page")))
    done = ~lost & (F.col("end_page").isNotNull() | F.coalesce(F.col("ids") >= F.col("total"), F.lit(False)))
    return per_term.groupBy("company").agg(
        F.bool_and(done).alias("complete"), F.count(F.lit(1)).alias("terms"),
        F.sum(F.when(lost, 1).otherwise(0)).alias("terms_with_lost_page"), F.sum("ids").alias("ids_read"))


def facet_coverage(rows: DataFrame, expected: DataFrame, least: float = fv.FACET_COVERAGE_MIN) -> DataFrame:
    """Per company and site: distinct rows read against the expected count of its facet slices."""
    read = rows.groupBy("company", "site", "posting_id").agg(F.lit(1).alias("one")).groupBy("company", "site").agg(
        F.sum("one").alias("n_read"))
    return (expected.join(read, ["company", "site"], "left").withColumn("n_read", F.coalesce("n_read", F.lit(0).cast("bigint")))
            .withColumn("covered", F.col("n_read") >= F.lit(least) * F.col("expected")))


def choose_facet(facets: DataFrame) -> DataFrame:
    """Per company: the facet group to slice a capped board by, and the count a full read must reach.

    Facets that cover every posting agree on their sum, so the highest shared sum is the board size; without one, the
    highest sum within 1.1 of the upper median. Of the groups within 0.995 and 1.1 of it, the one whose biggest slice is
    smallest. `facets(company, facet, facet_ord, value, n)`; a board has a few dozen facets at most.
    """
    sums = facets.groupBy("company", "facet", "facet_ord").agg(F.sum("n").alias("total"), F.max("n").alias("biggest"))
    per_board = sums.groupBy("company").agg(F.sort_array(F.collect_list("total")).alias("totals"))
    totals = F.col("totals")
    shared = F.array_max(F.filter(totals, lambda t: F.size(F.filter("totals", lambda u: u == t)) > 1))
    median = F.get(totals, F.floor(F.size(totals) / 2).cast("int"))
    bounded = F.array_max(F.filter(totals, lambda t: t <= 1.1 * median))
    size = per_board.select("company", F.coalesce(shared, bounded).alias("board_size"))
    near = sums.join(size, "company").where("total between 0.995 * board_size and 1.1 * board_size")
    return near.groupBy("company").agg(
        F.min_by("facet", F.struct("biggest", "facet_ord")).alias("facet"), F.first("board_size").alias("board_size"))


def id_signature(listing: DataFrame) -> DataFrame:
    """Per company: posting count and a 12-character signature of its id set.

    The digests of the ids are folded into a count, an exclusive or and a sum, which need no order: boards of any size
    get the same formula, and their ids are reduced map-side.
    """
    ids = listing.select("company", F.col("posting_id").cast("string").alias("id"))
    half = lambda at: F.conv(F.substring(F.md5("id"), at, 12), 16, 10).cast("bigint")
    folded = ids.groupBy("company").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(half(1)).alias("x"), F.sum(half(13).cast("decimal(38,0)")).alias("s"))
    return folded.select("company", "n", F.substring(F.md5(F.concat_ws("|", "n", "x", "s")), 1, 12).alias("sig"))


def update_freshness(known: DataFrame, signatures: DataFrame, as_of: Column) -> DataFrame:
    """Freshness table after a run; `changed` moves only with the signature, unread boards keep their row."""
    now = signatures.select("company", F.col("n").alias("_n"), F.col("sig").alias("_sig"))
    same = F.col("sig") == F.col("_sig")
    read = F.col("_sig").isNotNull()
    return (known.join(now, "company", "full_outer")
            .select("company", F.when(read, F.col("_n")).otherwise(F.col("n")).alias("n"),
                    F.when(read, F.col("_sig")).otherwise(F.col("sig")).alias("sig"),
                    F.when(read, as_of).otherwise(F.col("checked")).alias("checked"),
                    F.when(~read, F.col("changed")).when(same, F.coalesce("changed", as_of)).otherwise(as_of).alias("changed")))


def frozen_boards(freshness: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Empty boards, and boards whose id set has not changed for `days`."""
    age = F.datediff(as_of, F.col("changed"))
    return (freshness.withColumn("days", age)
            .withColumn("kind", F.when(F.col("n") == 0, "EMPTY").when(F.col("days") >= days, "FROZEN"))
            .where("kind is not null").select("kind", "company", "n", "days"))


def is_flood(fresh: Column, hits: Column, first_run: Column) -> Column:
    """More new matches at once than real posting explains."""
    return ~first_run & (fresh > F.greatest(F.lit(float(fv.FLOOD_MIN)), fv.FLOOD_FRACTION * hits))


def flooded(hits: DataFrame, fresh: DataFrame, first_runs: DataFrame) -> DataFrame:
    """Per company: matches, new matches and the flood verdict. `first_runs(company)` lists boards read for the first time."""
    both = (hits.select("company", F.lit(1).alias("hit"), F.lit(0).alias("new"))
            .unionByName(fresh.select("company", F.lit(0).alias("hit"), F.lit(1).alias("new"))))
    counts = both.groupBy("company").agg(F.sum("hit").alias("hits"), F.sum("new").alias("fresh"))
    first = first_runs.select("company", F.lit(True).alias("first_run")).distinct()
    return (counts.join(first, "company", "left").withColumn("first_run", F.coalesce("first_run", F.lit(False)))
            .withColumn("flood", is_flood(F.col("fresh"), F.col("hits"), F.col("first_run"))))


def is_mass_vanish(open_rows: Column, missing: Column) -> Column:
    return (open_rows >= fv.MASS_VANISH_MIN_OPEN) & (missing / open_rows > fv.MASS_VANISH_FRACTION)


def update_fetch_times(known: DataFrame, measured: DataFrame) -> DataFrame:
    """Seconds per company, half old and half new, folded over the run's files in order; a first value is taken as is.

    `measured(company, file, secs)` has one row per shard file that read the company.
    """
    runs = measured.where("secs is not null").groupBy("company").agg(
        F.array_sort(F.collect_list(F.struct("file", "secs"))).alias("runs"))
    fold = F.aggregate("runs", F.col("secs").cast("double"), lambda acc, r: F.when(
        acc.isNull(), F.bround(r["secs"], 2)).otherwise(F.bround(0.5 * acc + 0.5 * r["secs"], 2)))
    return (known.join(runs, "company", "full_outer")
            .select("company", F.when(F.col("runs").isNull(), F.col("secs")).otherwise(fold).alias("secs")))


def newest_pages(pages: DataFrame, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The distinct pages per board, only its newest `cap` by last change if that is given, and whether those are all."""
    distinct = pages.select("company", "lastmod", "url").distinct()
    if cap is None:
        everything = distinct.withColumn("place", F.lit(None).cast("int"))
        return everything, distinct.select("company", F.lit(True).alias("complete")).distinct()
    w = Window.partitionBy("company").orderBy(F.desc("lastmod"), F.desc("url"))
    newest = distinct.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)
    complete = distinct.groupBy("company").agg((F.count(F.lit(1)) <= cap).alias("complete"))
    return newest, complete


def age_buckets(rows: DataFrame, as_of: Column) -> DataFrame:
    """Date per posting from cumulative age buckets: the smallest bucket that lists it."""
    from postingworks.functions.dates import age_bucket_date
    return (rows.groupBy("company", "posting_id").agg(F.min("bucket").alias("bucket"))
            .withColumn("posted", age_bucket_date(F.col("bucket"), as_of)))
