"""Run health: board reads, history clocks and counters, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingworks.functions import fixed_values as fv
from postingworks.functions.scale import last_row


def read_states(companies: DataFrame, fetched: DataFrame) -> DataFrame:
    """One row per expected company with its read `outcome`: missing, failed, malformed or ok.

    `fetched(company, err, complete, jobs_ok, n_jobs)`: `complete` is null when it was not a truth value, `jobs_ok` is
    false when the job list was no list or an id was no filled text.
    """
    rows = companies.select("company").distinct().join(fetched.withColumn("_there", F.lit(True)), "company", "left")
    outcome = (F.when(F.col("_there").isNull(), "missing").when(F.col("err").isNotNull(), "failed")
               .when(~F.coalesce("jobs_ok", F.lit(False)) | F.col("complete").isNull(), "malformed").otherwise("ok"))
    return rows.withColumn("outcome", outcome).drop("_there")


def advance_clocks(states: DataFrame, history: DataFrame, now: Column) -> DataFrame:
    """Adds `last_success` (complete and non-empty read) and `last_fetch_ok` (any clean read).

    History from the future is ignored; a success also counts as a clean read.
    """
    old = history.select("company", F.when(F.col("last_success") <= now, F.col("last_success")).alias("_s"),
                         F.when(F.col("last_fetch_ok") <= now, F.col("last_fetch_ok")).alias("_f"))
    ok = F.col("outcome") == "ok"
    good = ok & F.col("complete") & (F.col("n_jobs") > 0)
    return (states.join(old, "company", "left")
            .withColumn("last_success", F.when(good, now).otherwise(F.col("_s")))
            .withColumn("last_fetch_ok", F.when(ok, now).otherwise(F.greatest("_f", "_s"))).drop("_s", "_f"))


def company_lists(clocks: DataFrame, now: Column, stale_hours: int = 24) -> DataFrame:
    """The report's company lists as rows (list, company)."""
    limit = now - F.expr(f"INTERVAL {stale_hours} HOURS")
    ok = F.col("outcome") == "ok"
    lists = {
        "missing": F.col("outcome") == "missing",
        "failed": F.col("outcome").isin("failed", "malformed"),
        "incomplete": ok & ~F.col("complete"),
        "zero_results": ok & (F.col("n_jobs") == 0),
        "stale_success": F.col("last_success") < limit,
        "unknown_success": F.col("last_success").isNull(),
        "stale_fetch": F.col("last_fetch_ok") < limit,
        "unknown_fetch": F.col("last_fetch_ok").isNull(),
    }
    named = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in lists.items()]))
    return clocks.select(F.explode(named).alias("list"), "company")


def read_counts(clocks: DataFrame, now: Column, stale_hours: int = 24) -> DataFrame:
    """Board counters of one run, one row."""
    limit = now - F.expr(f"INTERVAL {stale_hours} HOURS")
    ok = F.col("outcome") == "ok"

    def count(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    return clocks.agg(
        F.count(F.lit(1)).alias("companies_expected"), count(ok, "companies_fetched_ok"),
        count(ok & F.col("complete"), "complete_boards"),
        count(ok & F.col("complete") & (F.col("n_jobs") > 0), "verified_nonempty_boards"),
        count(F.col("outcome") == "missing", "missing_fetches"),
        count(F.col("outcome").isin("failed", "malformed"), "failed_fetches"),
        count(ok & ~F.col("complete"), "incomplete_boards"), count(ok & (F.col("n_jobs") == 0), "zero_result_companies"),
        count(F.col("last_success").isNull() | (F.col("last_success") < limit), "no_success_lately"),
        count(F.col("last_success").isNull(), "success_history_unknown"),
        count(F.col("last_fetch_ok").isNull() | (F.col("last_fetch_ok") < limit), "no_fetch_lately"),
        count(F.col("last_fetch_ok").isNull(), "fetch_history_unknown"))


def listing_counts(jobs: DataFrame, states: DataFrame) -> DataFrame:
    """Counters over the postings of cleanly read boards, each id counted once with its last values.

    `has_desc` tells an explicitly empty description from one the list never carries.
    """
    clean = states.where("outcome = 'ok'").select("company")
    last = last_row(jobs.select("company", "posting_id", "posted", "has_desc", "desc", "title", "ord"),
                    ["company", "posting_id"], F.col("ord"))
    rows = last.join(clean, "company", "left_semi")
    empty = F.col("has_desc") & (F.trim(F.coalesce("desc", F.lit(""))) == "")
    return rows.agg(
        F.count(F.lit(1)).alias("jobs_returned"), F.count_if(F.col("posted").isNull()).alias("missing_posted_dates"),
        F.count_if(~F.col("has_desc")).alias("listing_description_unknown"),
        F.count_if(empty).alias("listing_descriptions_empty"))


def missing_descriptions(jobs: DataFrame, states: DataFrame, log_failures: DataFrame) -> DataFrame:
    """Distinct (company, role) pairs known to lack a description: empty in the listing, or failed in the log."""
    clean = states.where("outcome = 'ok'").select("company")
    last = last_row(jobs.select("company", "posting_id", "has_desc", "desc", "title", "ord"),
                    ["company", "posting_id"], F.col("ord"))
    empty = (last.join(clean, "company", "left_semi")
             .where(F.col("has_desc") & (F.trim(F.coalesce("desc", F.lit(""))) == ""))
             .select("company", F.coalesce("title", "posting_id").alias("role")))
    return empty.unionByName(log_failures.select("company", "role")).distinct()


def queue_counts(queue: DataFrame) -> DataFrame:
    """Counters over the queue, one row."""
    status = F.coalesce("description_status", F.lit(""))
    pending = F.coalesce("alert_pending", F.lit(False))
    eligible = (pending & F.col("closed_on").isNull() & (F.col("state") == "new")
                & (F.coalesce("alert_attempts", F.lit(1)) < fv.ALERT_MAX_ATTEMPTS))
    return queue.agg(
        F.count_if(status == "failed").alias("queue_failed_descriptions"),
        F.count_if(~status.isin("ok", "failed")).alias("queue_description_status_unknown"),
        F.count_if(F.col("posted").isNull()).alias("queue_missing_posted_dates"),
        F.count_if(pending).alias("pending_alerts"), F.count_if(eligible).alias("eligible_pending_alerts"),
        F.count_if(pending & ~eligible).alias("inactive_pending_alerts"))


def run_counters(entries: DataFrame, queue_after: DataFrame, boards: DataFrame, alerts: DataFrame, pruned: DataFrame) -> DataFrame:
    """Counters of one run as rows (counter, n); every stage is one aggregate."""
    def named(df: DataFrame, **counts: Column) -> DataFrame:
        row = df.agg(*[c.alias(n) for n, c in counts.items()])
        stack = ", ".join(f"'{n}', {n}" for n in counts)
        return row.select(F.expr(f"stack({len(counts)}, {stack}) as (counter, n)"))

    status = F.col("sponsorship_status")
    out = named(boards, companies=F.count_if(F.col("err").isNull()), errors=F.count_if(F.col("err").isNotNull()))
    for part in (
        named(entries, matched=F.count(F.lit(1)), blocked=F.count_if(status == "Blocked"),
              opt_only=F.count_if(status == "OPT Only"), queued=F.count_if(~status.isin("Blocked", "OPT Only")),
              reposts=F.count_if(F.col("repost_of").isNotNull())),
        named(queue_after, closed=F.count_if(F.col("event") == "closed"), reopened=F.count_if(F.col("event") == "reopened")),
        named(alerts, alerted=F.count(F.lit(1))), named(pruned, pruned=F.count(F.lit(1)))):
        out = out.unionByName(part)
    return out


def unseeded_companies(companies: DataFrame, seeded: DataFrame) -> DataFrame:
    return companies.select("company").distinct().join(seeded.select("company"), "company", "left_anti").agg(
        F.count(F.lit(1)).alias("companies_without_seeded_state"))
