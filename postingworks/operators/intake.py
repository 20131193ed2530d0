"""New postings: what is fresh, what it re-lists, and its queue entry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingworks.functions import fixed_values as fv
from postingworks.functions import text as tx
from postingworks.functions.dates import provenance
from postingworks.functions.scale import lookup, numbered, ord_block
from postingworks.operators.experience import classify_experience
from postingworks.operators.salary import classify_salary
from postingworks.operators.sponsorship import classify_sponsorship

POSTING = ["company", "posting_id"]


def fresh_postings(hits: DataFrame, seen: DataFrame, seeded: DataFrame, queue: DataFrame) -> DataFrame:
    """Hits not seen before and not queued; a company read for the first time skips the seen test. Adds `first_run`."""
    known = seeded.select("company").distinct().withColumn("_seeded", F.lit(True))
    marked = (lookup(hits, known, ["company"], ["posting_id"]).withColumn("first_run", F.col("_seeded").isNull())
              .drop("_seeded"))
    seen_ids = seen.select(*POSTING).distinct().withColumn("_seen", F.lit(True))
    return (marked.join(seen_ids, POSTING, "left").where("first_run or _seen is null").drop("_seen")
            .join(queue.select(*POSTING), POSTING, "left_anti"))


def quiet_since() -> Column:
    """Day a queue entry was last known live."""
    return F.coalesce("closed_on", "last_seen_live", "first_seen")


def repost_sources(fresh: DataFrame, queue: DataFrame, listing: DataFrame, as_of: Column) -> DataFrame:
    """One-to-one pairs (company, posting_id, prior_id) of fresh postings and the entries they re-list.

    A prior has the same company and fingerprint, is not listed now and went quiet within the window. Fresh postings
    claim priors in order, the latest first seen first. The candidates depend only on the group, so the n-th fresh
    posting of a group claims its n-th prior: an equi-join on the position, with positions taken per bounded block.
    """
    key = ["company", "fp"]
    wanted = (fresh.withColumn("fp", tx.role_fingerprint(F.col("title"), F.col("location")))
              .select("company", "fp", "posting_id", "ord"))
    groups = wanted.select(*key).distinct()
    priors = (queue.where(quiet_since() >= F.date_sub(as_of, fv.REPOST_WINDOW_DAYS))
              .withColumn("fp", tx.role_fingerprint(F.col("role"), F.col("location")))
              .select("company", "fp", "posting_id", "id", "first_seen", "ord")
              .join(listing.select(*POSTING), POSTING, "left_anti"))
    priors = priors.join(groups, key, "left_semi")
    takers = numbered(wanted, key, {"_block": ord_block()}, [F.col("ord")])
    age = -F.coalesce(F.unix_date("first_seen"), F.lit(-10_000_000))
    offers = numbered(priors, key, {"_age": age, "_block": ord_block()}, [F.col("ord")])
    return (takers.join(offers.select(*key, "rank", F.col("id").alias("prior_id")), [*key, "rank"])
            .select(*POSTING, "prior_id"))


def describe_entries(fresh: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Fresh postings with every fact read from their description, which is then dropped."""
    facts = classify_salary(classify_experience(classify_sponsorship(fresh)))
    return facts.withColumn("kw_hits", tx.keyword_hits(F.col("title"), F.col("description"), keywords)).drop("description")


def new_entries(described: DataFrame, sources: DataFrame, queue: DataFrame, as_of: Column) -> DataFrame:
    """Queue entries for fresh postings, with the lineage of the entry each one re-lists.

    `described` holds the posting, `first_run`, `board_type`, `desc_failed` and the description facts; `sources` the
    pairs of `repost_sources`.
    """
    prior = queue.select(
        F.col("id").alias("prior_id"), F.col("state").alias("p_state"), F.col("first_seen").alias("p_first_seen"),
        F.coalesce("repost_count", F.lit(0)).alias("p_count"), F.coalesce("lineage_root", "id").alias("p_root"),
        F.coalesce("lineage_first_seen", "first_seen").alias("p_lineage"))
    rows = described.join(sources.join(prior, "prior_id"), POSTING, "left")
    status, has_prior = F.col("sponsorship_status"), F.col("prior_id").isNotNull()
    by_class = F.when(status == "Blocked", "auto_blocked").when(status == "OPT Only", "opt_only").otherwise("new")
    decided = (status != "Blocked") & F.col("p_state").isin("dismissed", "applied", "shortlisted")
    eid = tx.entry_id(F.col("company"), F.col("posting_id"))
    none = F.lit(None)
    return rows.select(
        eid.alias("id"), *POSTING, F.col("title").alias("role"), "location", F.col("url").alias("link"), "posted",
        provenance(F.col("posted"), F.col("posted_source"), F.col("board_type")).alias("posted_source"),
        F.lit(False).alias("posted_reverified"),
        F.when(F.col("desc_failed"), "failed").otherwise("ok").alias("description_status"), "site",
        as_of.alias("first_seen"), "sponsorship_status", "sponsorship_evidence", "experience", "experience_evidence",
        "salary", "salary_evidence", "kw_hits", F.when(decided, F.col("p_state")).otherwise(by_class).alias("state"),
        "first_run", as_of.alias("last_seen_live"), F.lit(0).alias("miss_count"), none.cast("date").alias("closed_on"),
        none.cast("string").alias("closed_reason"),
        F.when(has_prior, F.col("p_count") + 1).otherwise(0).alias("repost_count"), F.col("prior_id").alias("repost_of"),
        F.when(has_prior, F.coalesce("posted", as_of)).alias("reposted_on"),
        F.coalesce("p_root", eid).alias("lineage_root"), F.coalesce("p_lineage", as_of).alias("lineage_first_seen"),
        F.lit("Unclear").alias("ghost_status"), F.lit("").alias("ghost_evidence"), "ord",
        F.coalesce(F.col("p_state") == "auto_blocked", F.lit(False)).alias("prior_was_blocked"))


def close_reposted(queue: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """Queue with claimed priors that were still open closed as reposted."""
    claimed = sources.select(F.col("prior_id").alias("id")).distinct().withColumn("_claimed", F.lit(True))
    out = queue.join(claimed, "id", "left")
    closes = F.col("_claimed") & F.col("closed_on").isNull()
    return (out.withColumn("closed_reason", F.when(closes, "reposted").otherwise(F.col("closed_reason")))
            .withColumn("closed_on", F.when(closes, as_of).otherwise(F.col("closed_on"))).drop("_claimed")
            .select(*queue.columns))


def alert_candidates(entries: DataFrame, floods: DataFrame) -> DataFrame:
    """New entries that deserve an alert of their own: open class, not a first run, a flood or a known repost."""
    silent = floods.where("flood").select("company", F.lit(True).alias("_silent"))
    rows = lookup(entries, silent, ["company"], ["posting_id"])
    return (rows.where("_silent is null and not first_run").where(~F.col("sponsorship_status").isin("Blocked", "OPT Only"))
            .where("repost_of is null or prior_was_blocked").drop("_silent"))


def select_alerts(candidates: DataFrame, cap: int = fv.ALERT_CAP_PER_RUN) -> DataFrame:
    """The run's alert budget: the first `cap` candidates in company and listing order."""
    return candidates.orderBy("company_ord", "ord", "id").limit(cap)


def recall(hits: DataFrame, seen: DataFrame, queue: DataFrame, tombstones: DataFrame, as_of: Column,
           cap: int | None = None) -> DataFrame:
    """Postings seen before that match today's rules but were never queued; old or removed ones stay out.

    With `cap`, the first so many in company and listing order; the rest comes up again.
    """
    eid = tx.entry_id(F.col("company"), F.col("posting_id"))
    recent = F.col("posted").isNull() | (F.col("posted") >= F.date_sub(as_of, fv.PRUNE_AFTER_DAYS))
    found = (hits.where(recent).withColumn("id", eid)
            .join(seen.select(*POSTING), POSTING, "left_semi").join(queue.select(*POSTING), POSTING, "left_anti")
            .join(tombstones.select("id"), "id", "left_anti").withColumn("origin", F.lit("recall")))
    return found if cap is None else found.orderBy("company_ord", "ord", "id").limit(cap)
