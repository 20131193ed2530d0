"""Queue state over time: liveness, renewals, retries, pruning, evergreen roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postingworks.functions import fixed_values as fv
from postingworks.functions import text as tx
from postingworks.functions.scale import lookup
from postingworks.operators.boards import is_mass_vanish

POSTING = ["company", "posting_id"]


def verified_companies(fetched: DataFrame) -> DataFrame:
    """Companies read without error, completely, and with postings: `fetched(company, err, complete, n_jobs)`."""
    return fetched.where("err is null and complete and n_jobs > 0").select("company")


def update_liveness(queue: DataFrame, listing: DataFrame, boards: DataFrame, as_of: Column,
                    verdicts: DataFrame | None = None, *, short: bool = False) -> DataFrame:
    """Queue after comparing it with the full listing of every read board.

    `boards(company, complete, board_type, n_jobs)`: a board absent here or with an empty listing changes nothing, an
    incomplete one never counts a miss. `verdicts(id, verdict)` holds the double check of due closures on checkable
    board types: listed, gone, or unknown (check again next run); without one such a row stays open as listed.
    Adds `event` (closed, reopened or null). `short` says that `scale.is_short(boards)` was found true.
    """
    live = listing.select(*POSTING).distinct().withColumn("_live", F.lit(True))
    rows = queue.join(live, POSTING, "left").withColumn("_live", F.coalesce("_live", F.lit(False)))
    open_ = F.col("closed_on").isNull()
    missing_counts = rows.groupBy("company").agg(
        F.count_if(open_).alias("_open"), F.count_if(open_ & ~F.col("_live")).alias("_missing"))
    read = boards.where("n_jobs > 0").select("company", F.col("complete").alias("_complete"), "board_type").join(
        missing_counts, "company")
    per_board = read.select("company", "_complete", "board_type", is_mass_vanish(
        F.col("_open"), F.col("_missing")).alias("_vanish"))
    rows = lookup(rows.drop("board_type"), per_board, ["company"], ["posting_id"], short=short)
    if verdicts is None:
        rows = rows.withColumn("_verdict", F.when(F.col("board_type").isin(*fv.CHECKABLE_TYPES), "listed"))
    else:
        rows = (rows.join(verdicts.select("id", F.col("verdict").alias("_verdict")), "id", "left")
                .withColumn("_verdict", F.when(F.col("board_type").isin(*fv.CHECKABLE_TYPES),
                                               F.coalesce("_verdict", F.lit("listed")))))

    seen = F.col("_complete").isNotNull() & F.col("_live")
    missed = F.coalesce(F.col("_complete"), F.lit(False)) & ~F.col("_live") & open_
    limit = F.when(F.col("_vanish"), fv.CLOSE_AFTER_MISSES * fv.MASS_VANISH_FACTOR).otherwise(fv.CLOSE_AFTER_MISSES)
    misses = F.coalesce("miss_count", F.lit(0)) + 1
    quiet = F.coalesce(F.col("last_seen_live") < as_of, F.lit(True))
    due = missed & (misses >= limit) & quiet
    relisted = due & (F.col("_verdict") == "listed")
    unknown = due & (F.col("_verdict") == "unknown")
    closes = due & F.coalesce(F.col("_verdict") == "gone", F.lit(True))
    reopens = seen & ~open_ & F.coalesce(F.col("closed_reason") != "manual", F.lit(True))
    relisted, unknown = F.coalesce(relisted, F.lit(False)), F.coalesce(unknown, F.lit(False))

    staged = rows.select(
        "*", seen.alias("_seen"), missed.alias("_missed"), limit.alias("_limit"), misses.alias("_misses"),
        relisted.alias("_relisted"), unknown.alias("_unknown"), closes.alias("_closes"), reopens.alias("_reopens"))
    changed = {
        "last_seen_live": F.when(F.expr("_seen or _relisted"), as_of).otherwise(F.col("last_seen_live")),
        "miss_count": (F.when(F.expr("_seen or _relisted"), 0).when(F.col("_unknown"), F.col("_limit") - 1)
                       .when(F.col("_missed"), F.col("_misses")).otherwise(F.col("miss_count"))),
        "closed_on": F.when(F.col("_closes"), as_of).when(F.col("_reopens"), None).otherwise(F.col("closed_on")),
        "closed_reason": (F.when(F.col("_closes"), "removed").when(F.col("_reopens"), None)
                          .otherwise(F.col("closed_reason"))),
        "repost_count": F.coalesce("repost_count", F.lit(0)) + F.col("_reopens").cast("int"),
        "reposted_on": F.when(F.col("_reopens"), as_of).otherwise(F.col("reposted_on")),
    }
    return staged.select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in queue.columns],
        F.when(F.col("_closes"), "closed").when(F.col("_reopens"), "reopened").alias("event"))


def due_for_check(queue: DataFrame, listing: DataFrame, boards: DataFrame, as_of: Column) -> DataFrame:
    """Rows a run would close on boards whose postings can be looked up one by one."""
    after = update_liveness(queue, listing, boards, as_of,
                            queue.select("id", F.lit("gone").alias("verdict")))
    types = boards.where(F.col("board_type").isin(*fv.CHECKABLE_TYPES)).select("company")
    return lookup(after.where("event = 'closed'"), types.distinct(), ["company"], ["posting_id"], "left_semi").select("id", *POSTING)


def renewal_candidates(queue: DataFrame, listing: DataFrame, boards: DataFrame) -> DataFrame:
    """Live rows of the relative-date type whose listed date is newer than the stored one by a real jump."""
    types = boards.where(F.col("board_type") == fv.RELATIVE_DATE_TYPE).select("company").distinct()
    listed = listing.where("posted is not null").groupBy(*POSTING).agg(F.max("posted").alias("listed"))
    jump = F.datediff(F.col("listed"), F.col("posted")) >= fv.REFRESH_MIN_JUMP_DAYS
    estimated = F.coalesce("posted_est", F.lit(False))
    rows = queue.where(F.col("closed_on").isNull() & F.col("posted").isNotNull() & ~estimated)
    return lookup(rows.join(listed, POSTING).where(jump), types, ["company"], ["posting_id"], "left_semi")


def renewals_to_check(candidates: DataFrame, cap: int = fv.REFRESH_MAX_PER_RUN) -> DataFrame:
    """The run's share of renewal candidates, in queue order; the others come up again in later runs."""
    return candidates.orderBy("ord", "id").limit(cap)


def apply_renewals(queue: DataFrame, details: DataFrame) -> DataFrame:
    """Queue with renewed postings moved to the date their detail page confirms: `details(id, detail_posted, detail_source)`."""
    rows = queue.join(details, "id", "left")
    moves = F.coalesce(F.datediff(F.col("detail_posted"), F.col("posted")) >= fv.REFRESH_MIN_JUMP_DAYS, F.lit(False))
    changed = {
        "posted_before_refresh": F.when(moves, F.col("posted")).otherwise(F.col("posted_before_refresh")),
        "posted": F.when(moves, F.col("detail_posted")).otherwise(F.col("posted")),
        "posted_source": F.when(moves, F.col("detail_source")).otherwise(F.col("posted_source")),
        "posted_reverified": F.when(moves, True).otherwise(F.col("posted_reverified")),
        "repost_count": F.coalesce("repost_count", F.lit(0)) + moves.cast("int"),
        "reposted_on": F.when(moves, F.col("detail_posted")).otherwise(F.col("reposted_on")),
    }
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in queue.columns])


def reverify_window(queue: DataFrame, boards: DataFrame, as_of: Column,
                    cap: int = fv.REVERIFY_MAX_PER_RUN) -> DataFrame:
    """Open rows of the relative-date type first seen one to three days ago whose date was never re-read; this run's share."""
    types = boards.where(F.col("board_type") == fv.RELATIVE_DATE_TYPE).select("company").distinct()
    recent = F.col("first_seen").between(F.date_sub(as_of, fv.REVERIFY_MAX_AGE_DAYS),
                                         F.date_sub(as_of, fv.REVERIFY_MIN_AGE_DAYS))
    rows = queue.where(recent & F.col("closed_on").isNull() & ~F.coalesce("posted_reverified", F.lit(False)))
    return lookup(rows, types, ["company"], ["posting_id"], "left_semi").orderBy("ord", "id").limit(cap)


def apply_reverified(queue: DataFrame, details: DataFrame) -> DataFrame:
    """Queue with re-read dates; every re-read row is marked, changed or not."""
    rows = queue.join(details.withColumn("_read", F.lit(True)), "id", "left")
    moves = F.coalesce(F.col("_read") & F.col("detail_posted").isNotNull()
                       & ~F.col("detail_posted").eqNullSafe(F.col("posted")), F.lit(False))
    changed = {
        "posted": F.when(moves, F.col("detail_posted")).otherwise(F.col("posted")),
        "posted_source": F.when(moves, F.col("detail_source")).otherwise(F.col("posted_source")),
        "posted_reverified": F.coalesce("_read", "posted_reverified"),
    }
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in queue.columns])


def enrichment_due(queue: DataFrame, boards: DataFrame, as_of: Column,
                   budget: int = fv.ENRICH_RETRY_BUDGET) -> DataFrame:
    """Rows to read again: a failed description, or no date on a type whose detail page has one. One try a day, five in all."""
    types = boards.select("company", "board_type").distinct()
    rows = lookup(queue.drop("board_type"), types, ["company"], ["posting_id"], "inner")
    failed = F.col("description_status") == "failed"
    undated = F.col("board_type").isin(*fv.DETAIL_DATED_TYPES) & F.col("posted").isNull()
    allowed = (F.col("closed_on").isNull() & (F.coalesce("enrich_attempts", F.lit(0)) < fv.ENRICH_MAX_ATTEMPTS)
               & F.coalesce(F.col("enrich_next") <= as_of, F.lit(True)))
    return (rows.where(allowed & (failed | undated)).orderBy("ord", "id").limit(budget)
            .withColumn("enrich_attempts", F.coalesce("enrich_attempts", F.lit(0)) + 1)
            .withColumn("enrich_next", F.date_add(as_of, 1)))


def state_for(status: Column, state: Column) -> Column:
    """State of a still-new row once its class is known."""
    return (F.when((state == "new") & (status == "Blocked"), "auto_blocked")
            .when((state == "new") & (status == "OPT Only"), "opt_only").otherwise(state))


def apply_enriched(queue: DataFrame, reread: DataFrame, as_of: Column) -> DataFrame:
    """Queue after a retry round. `reread(id, ok, location, posted, posted_source, sponsorship_status,
    sponsorship_evidence, experience, experience_evidence, salary, salary_evidence, kw_hits, has_text)`: one row per row
    of `enrichment_due`; every tried row counts an attempt, a readable one fills what was missing.
    """
    new = reread.select("id", *[F.col(c).alias(f"n_{c}") for c in reread.columns if c != "id"], F.lit(True).alias("_tried"))
    rows = queue.join(new, "id", "left")
    tried, ok = F.coalesce("_tried", F.lit(False)), F.coalesce("n_ok", F.lit(False))
    facts = ok & (F.col("description_status") == "failed") & F.coalesce("n_has_text", F.lit(False))
    dated = ok & F.col("posted").isNull() & F.col("n_posted").isNotNull()
    read = ("sponsorship_status", "sponsorship_evidence", "experience", "experience_evidence", "salary", "salary_evidence", "kw_hits")
    changed = {
        **{c: F.when(facts, F.col(f"n_{c}")).otherwise(F.col(c)) for c in read},
        "description_status": F.when(facts, "ok").otherwise(F.col("description_status")),
        "state": F.when(facts, state_for(F.col("n_sponsorship_status"), F.col("state"))).otherwise(F.col("state")),
        "location": F.when(ok, F.coalesce("n_location", "location")).otherwise(F.col("location")),
        "posted": F.when(dated, F.col("n_posted")).otherwise(F.col("posted")),
        "posted_source": F.when(dated, F.col("n_posted_source")).otherwise(F.col("posted_source")),
        "enrich_attempts": F.when(tried, F.coalesce("enrich_attempts", F.lit(0)) + 1).otherwise(F.col("enrich_attempts")),
        "enrich_next": F.when(tried, F.date_add(as_of, 1)).otherwise(F.col("enrich_next")),
    }
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in queue.columns])


def retry_alerts(queue: DataFrame, outcomes: DataFrame, budget_left: int) -> DataFrame:
    """Pending alerts after a retry round: `outcomes(id, failed_now, delivered)`.

    Closed, decided or worn-out rows lose the flag even when the budget is spent; rows that failed in this run wait.
    """
    rows = queue.join(outcomes, "id", "left")
    pending = F.coalesce("alert_pending", F.lit(False)) & ~F.coalesce("failed_now", F.lit(False))
    attempts = F.coalesce("alert_attempts", F.lit(1))
    over = F.col("closed_on").isNotNull() | (F.col("state") != "new") | (attempts >= fv.ALERT_MAX_ATTEMPTS)
    staged = rows.withColumn("_over", pending & over).withColumn("_try", pending & ~over)
    tried = (staged.where("_try").orderBy("ord", "id").limit(max(budget_left, 0)).select("id")
             .withColumn("_sent", F.lit(True)))
    staged = staged.join(tried, "id", "left")
    sent, ok = F.coalesce("_sent", F.lit(False)), F.coalesce("delivered", F.lit(False))
    changed = {
        "alert_pending": F.when(F.col("_over") | (sent & ok), False).otherwise(F.col("alert_pending")),
        "alert_attempts": F.when(sent & ~ok, attempts + 1).otherwise(F.col("alert_attempts")),
    }
    return staged.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in queue.columns])


def retry_summaries(pending: DataFrame, new_lines: DataFrame, delivered: DataFrame) -> DataFrame:
    """Summary lines still to send: undelivered ones with an attempt more, dropped after the last."""
    todo = pending.select("line", "attempts").unionByName(new_lines.select("line", F.lit(0).alias("attempts")))
    return (todo.join(delivered.select("line").distinct(), "line", "left_anti")
            .withColumn("attempts", F.col("attempts") + 1).where(F.col("attempts") < fv.ALERT_MAX_ATTEMPTS))


def summary_lines(floods: DataFrame, capped: DataFrame) -> DataFrame:
    """One line per flooded company and one for the alerts over the run's cap: `capped(n)` holds one row."""
    flood = floods.where("flood").select(F.concat(
        "company", F.lit(": "), F.col("fresh").cast("string"),
        F.lit(" roles appeared at once, queued silently (flood guard)")).alias("line"))
    over = capped.where("n > 0").select(F.concat(
        F.col("n").cast("string"), F.lit(" more new roles queued without individual alerts (cap "),
        F.lit(str(fv.ALERT_CAP_PER_RUN)), F.lit(")")).alias("line"))
    return flood.unionByName(over)


def split_stale(queue: DataFrame, verified: DataFrame, configured: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, pruned): undecided rows posted over 60 days ago that are gone for sure, or whose company was removed."""
    known = (configured.select("company").distinct().withColumn("_configured", F.lit(True))
             .join(verified.select("company").distinct().withColumn("_verified", F.lit(True)), "company", "full_outer"))
    rows = lookup(queue, known, ["company"], ["posting_id"])
    live_today = F.coalesce((F.col("last_seen_live") == as_of) & F.col("closed_on").isNull(), F.lit(False))
    removed = F.col("_configured").isNull()
    unverified = ~removed & F.col("_verified").isNull()
    stale = (F.col("state").isin("new", "opt_only", "auto_blocked")
             & F.coalesce(F.col("posted") < F.date_sub(as_of, fv.PRUNE_AFTER_DAYS), F.lit(False))
             & ~live_today & ~unverified & (F.col("closed_on").isNotNull() | removed))
    staged = rows.withColumn("_stale", stale).select(*queue.columns, "_stale")
    return staged.where(~F.col("_stale")).drop("_stale"), staged.where("_stale").drop("_stale")


def tombstones(pruned: DataFrame, as_of: Column, reason: str = "pruned") -> DataFrame:
    return pruned.select("id", F.lit(reason).alias("reason"), as_of.alias("on"))


def apply_marks(queue: DataFrame, marks: DataFrame, as_of: Column) -> DataFrame:
    """Queue after hand-made marks `marks(id, mark)`: closed, open or a state; unknown marks change nothing."""
    rows = queue.join(marks, "id", "left")
    mark = F.coalesce("mark", F.lit(""))
    changed = {
        "closed_on": F.when(mark == "closed", as_of).when(mark == "open", None).otherwise(F.col("closed_on")),
        "closed_reason": F.when(mark == "closed", "manual").when(mark == "open", None).otherwise(F.col("closed_reason")),
        "miss_count": F.when(mark == "open", 0).otherwise(F.col("miss_count")),
        "state": F.when(mark.isin(*fv.QUEUE_STATES), mark).otherwise(F.col("state")),
    }
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in queue.columns])


def evergreen_roles(queue: DataFrame) -> DataFrame:
    """Per (company, fingerprint): is the role listed again and again, one posting after the other?

    At least three postings over at least 120 days, each starting only after the one before went quiet. Postings are
    first folded per first-seen day (map-side), so the ordered step sees one row per day however many share a role.
    """
    key = ["company", "fp"]
    quiet = F.coalesce("closed_on", "last_seen_live", "first_seen")
    late = F.coalesce(quiet > F.col("first_seen"), F.lit(True))
    days = (queue.withColumn("fp", tx.role_fingerprint(F.col("role"), F.col("location"))).withColumn("_quiet", quiet)
            .groupBy(*key, "first_seen").agg(
                F.count(F.lit(1)).alias("n"), F.max_by("_quiet", "ord").alias("last_quiet"),
                (F.count_if(late) - F.max_by(late.cast("int"), "ord")).alias("overlaps")))
    before = F.lag(F.struct("last_quiet")).over(Window.partitionBy(*key).orderBy("first_seen"))
    step = days.withColumn("_before", before)
    # rows without a first sighting sort first: what follows them is measured against their quiet day
    gap_ok = F.col("_before").isNull() | F.coalesce(F.col("first_seen") >= F.col("_before.last_quiet"), F.lit(False))
    groups = step.groupBy(*key).agg(
        F.sum("n").alias("postings"), F.bool_and(gap_ok & (F.col("overlaps") == 0)).alias("serial"),
        F.min("first_seen").alias("since"), F.max("first_seen").alias("latest"),
        F.count_if(F.col("first_seen").isNull()).alias("undated"))
    span = F.datediff(F.col("latest"), F.col("since"))
    likely = ((F.col("postings") >= fv.GHOST_MIN_COUNT) & F.col("serial") & (F.col("undated") == 0)
              & (span >= fv.GHOST_MIN_SPAN_DAYS))
    evidence = F.concat(F.lit("posted "), F.col("postings").cast("string"), F.lit("x since "),
                        F.col("since").cast("string"), F.lit(" (span "), span.cast("string"),
                        F.lit("d), most recently "), F.col("latest").cast("string"))
    return groups.select(*key, "postings", F.when(likely, "Likely").otherwise("Unclear").alias("ghost_status"),
                         F.when(likely, evidence).otherwise("").alias("ghost_evidence"))


def mark_evergreen(queue: DataFrame) -> DataFrame:
    """Queue with `ghost_status` and `ghost_evidence` set from `evergreen_roles`."""
    likely = evergreen_roles(queue).where("ghost_status = 'Likely'").drop("postings")
    rows = queue.drop("ghost_status", "ghost_evidence").withColumn(
        "fp", tx.role_fingerprint(F.col("role"), F.col("location")))
    return (rows.join(likely, ["company", "fp"], "left")
            .withColumn("ghost_status", F.coalesce("ghost_status", F.lit("Unclear")))
            .withColumn("ghost_evidence", F.coalesce("ghost_evidence", F.lit(""))).select(*queue.columns))
