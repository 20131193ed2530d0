"""The daily run over all boards at once: listing to intake, liveness, clean-up and state."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postingworks import schemas
from postingworks.functions import fixed_values as fv
from postingworks.functions.scale import is_short, lookup
from postingworks.operators import anchors, boards, dedup, health, intake, lifecycle
from postingworks.operators.filters import FilterRules, drop_rejected_locations, hidden_by_title, matching, rescue_multi_site
from postingworks.session import materialize
from postingworks.sources.jsonld import merge_details
from postingworks.sources.sinks import read_table, refresh_partly, replace_tables


@dataclass
class RunInput:
    """Landed results of one run.

    `companies(ord, company, board_type, endpoint, sites)`, `fetched(company, err, complete, jobs_ok, n_jobs, secs)`,
    `listing(company, posting_id, title, location, url, posted, posted_source, site, description, ord)`, `details` as in
    `merge_details`, `sites(company, posting_id, full_location)`; `verdicts(id, verdict)` of closure checks, or None.
    """
    companies: DataFrame
    fetched: DataFrame
    listing: DataFrame
    details: DataFrame
    sites: DataFrame
    verdicts: DataFrame | None = None


@dataclass
class Outcomes:
    """What came back from outside since the last run; what is None did not happen.

    `marks(id, mark)` made by hand, `alerts(id, failed_now, delivered)` and `lines(line)` delivered, `renewals` and
    `reverified(id, detail_posted, detail_source)` of pages read again, `reread` as `lifecycle.apply_enriched` takes it.
    """
    marks: DataFrame | None = None
    alerts: DataFrame | None = None
    lines: DataFrame | None = None
    renewals: DataFrame | None = None
    reverified: DataFrame | None = None
    reread: DataFrame | None = None


@dataclass
class State:
    """Tables between runs; `summaries(line, attempts)` still to send, `signature(sig)` of the rules last recalled by."""
    queue: DataFrame
    seen: DataFrame
    seeded: DataFrame
    tombstones: DataFrame
    filtered: DataFrame
    freshness: DataFrame
    summaries: DataFrame | None = None
    signature: DataFrame | None = None


@dataclass
class RunResult:
    state: State
    alerts: DataFrame
    summaries: DataFrame
    counters: DataFrame
    recalled: bool = False
    due: dict[str, DataFrame] = field(default_factory=dict)


def rules_signature(rules: FilterRules) -> str:
    return hashlib.sha1(json.dumps(dataclasses.asdict(rules), sort_keys=True).encode()).hexdigest()[:16]


def _settled(queue: DataFrame, outcomes: Outcomes, chosen: DataFrame) -> DataFrame:
    """Queue after this run's alerts and the retries of older ones."""
    if outcomes.alerts is None:
        return queue
    told = outcomes.alerts.select("id", "failed_now", "delivered")
    left = max(0, fv.ALERT_CAP_PER_RUN - chosen.count())
    retried = lifecycle.retry_alerts(queue, told, left)
    failed = told.where("failed_now").select("id", F.lit(True).alias("_failed")).distinct()
    return retried.join(failed, "id", "left").withColumn("alert_pending", F.coalesce("_failed", "alert_pending")).withColumn(
        "alert_attempts", F.when(F.col("_failed"), 1).otherwise(F.col("alert_attempts"))).select(*queue.columns)


def daily_run(run: RunInput, state: State, rules: FilterRules, keywords: Sequence[str], as_of, recall: bool | None = None,
              outcomes: Outcomes | None = None) -> RunResult:
    """One run as a fixed sequence of set-wide steps; every step covers all companies together.

    A recall starts by itself when the rules differ from those of the stored signature; `recall` forces or forbids it. The
    signature moves only after a recall without a failed board. Outside results arrive in `outcomes`; what the next ones
    should cover is returned as `due` (closures, renewals, reverified, reread).
    """
    outcomes, spark = outcomes or Outcomes(), run.listing.sparkSession
    stored = state.signature.first() if state.signature is not None else None
    signature = rules_signature(rules)
    recall = (stored is not None and stored["sig"] != signature) if recall is None else recall
    if outcomes.marks is not None:
        state = dataclasses.replace(state, queue=lifecycle.apply_marks(state.queue, outcomes.marks, as_of))
    order = run.companies.select("company", "board_type", F.col("ord").alias("company_ord"))
    clean = run.fetched.where("err is null").select("company")
    short = is_short(run.companies) and is_short(run.fetched)
    # the largest table, read by seven steps
    postings = materialize(dedup.last_wins(lookup(run.listing, clean, ["company"], ["posting_id"], "left_semi", short=short)), "postings")
    typed = lookup(postings, order, ["company"], ["posting_id"], "inner", short=short)
    hits = matching(typed, rules)
    rescued = rescue_multi_site(typed, run.sites, rules)
    # read by the flood test, intake and recall
    hits = materialize(hits.unionByName(rescued.select(*hits.columns)), "hits")

    fresh = intake.fresh_postings(hits, state.seen, state.seeded, state.queue)
    complete = run.fetched.where("err is null and complete").select("company")
    # the text readers are the costly step: their result is written once and the descriptions are gone from it
    described = materialize(intake.describe_entries(merge_details(fresh, run.details), keywords), "described")
    relisted = lookup(described.where("not first_run"), complete, ["company"], ["posting_id"], "left_semi", short=short)
    sources = materialize(intake.repost_sources(relisted, state.queue, postings, as_of), "reposts")
    entries = intake.new_entries(described, sources, state.queue, as_of)
    floods = boards.flooded(hits, described, described.where("first_run"))

    queue = intake.close_reposted(state.queue, sources, as_of)
    extra = [c for c in queue.columns if c not in entries.columns]
    added = entries.select("*", *[F.lit(None).cast(queue.schema[c].dataType).alias(c) for c in extra])
    if recall:
        again = intake.recall(hits, state.seen, state.queue, state.tombstones, as_of).drop("id", "origin")
        read = intake.describe_entries(merge_details(again, run.details).withColumn("first_run", F.lit(True)), keywords)
        recalled = materialize(intake.new_entries(read, sources.limit(0), state.queue, as_of), "recalled")
        added = added.unionByName(recalled.select(
            "*", *[(F.lit("recall") if c == "origin" else F.lit(None).cast(queue.schema[c].dataType)).alias(c) for c in extra]))
    candidates = intake.alert_candidates(lookup(entries, order.drop("board_type"), ["company"], ["posting_id"], "inner", short=short), floods)
    alerts = intake.select_alerts(candidates)

    read_boards = run.fetched.where("err is null").join(order, "company").select("company", "complete", "board_type", "n_jobs")
    before = queue.unionByName(added.select(*queue.columns))
    after = materialize(lifecycle.update_liveness(before, postings, read_boards, as_of, run.verdicts, short=short), "live")
    live = _settled(after.drop("event"), outcomes, alerts)
    if outcomes.renewals is not None:
        live = lifecycle.apply_renewals(live, outcomes.renewals)
    if outcomes.reverified is not None:
        live = lifecycle.apply_reverified(live, outcomes.reverified)
    if outcomes.reread is not None:
        live = lifecycle.apply_enriched(live, outcomes.reread, as_of)
    dated = anchors.fill_dates(live, run.companies.where("endpoint['date_from_id'] = 'true'"))
    # read by the kept and the pruned half and by the counters
    marked = materialize(lifecycle.mark_evergreen(dated), "marked")
    verified = lifecycle.verified_companies(run.fetched)
    kept, pruned = lifecycle.split_stale(marked, verified, run.companies, as_of)
    kept = drop_rejected_locations(kept, rules)

    unverified = run.companies.select("company").join(verified, "company", "left_anti")
    hidden, _ = hidden_by_title(typed, rules)
    signatures = boards.id_signature(postings)
    seen, seeded = dedup.grow_seen(state.seen, state.seeded, postings)
    lines = lifecycle.summary_lines(floods, alert_overflow(candidates))
    waiting = state.summaries if state.summaries is not None else spark.createDataFrame([], schemas.SUMMARIES)
    delivered = outcomes.lines if outcomes.lines is not None else spark.createDataFrame([], "line string")
    done = recall and not run.fetched.where("err is not null").limit(1).collect()
    kept_sig = [(signature,)] if done else [(stored["sig"],)] if stored else []
    next_state = State(kept, seen, seeded, state.tombstones.unionByName(lifecycle.tombstones(pruned, as_of)),
                       refresh_partly(state.filtered, hidden.select(*state.filtered.columns), unverified),
                       boards.update_freshness(state.freshness, signatures, as_of),
                       lifecycle.retry_summaries(waiting, lines, delivered), spark.createDataFrame(kept_sig, schemas.SIGNATURE))
    counted = entries.unionByName(recalled.select(*entries.columns)) if recall else entries
    sent = alerts if outcomes.alerts is None else alerts.join(outcomes.alerts.where("not delivered").select("id"), "id", "left_anti")
    counters = health.run_counters(counted, after, run.fetched, sent, pruned)
    types = run.companies.select("company", "board_type")
    due = {"closures": lifecycle.due_for_check(before, postings, read_boards, as_of),
           "renewals": lifecycle.renewals_to_check(lifecycle.renewal_candidates(kept, postings, types)),
           "reverified": lifecycle.reverify_window(kept, types, as_of),
           "reread": lifecycle.enrichment_due(kept, types, as_of)}
    return RunResult(next_state, alerts, lines, counters, bool(recall), due)


def save(state: State, folder: str) -> str:
    """All state tables behind one pointer, the queue written first."""
    return replace_tables({"queue": state.queue, "seen": state.seen, "seeded": state.seeded, "tombstones": state.tombstones,
                           "filtered": state.filtered, "freshness": state.freshness,
                           **{name: table for name, table in (("summaries", state.summaries), ("signature", state.signature))
                              if table is not None}}, folder)


def load(spark: SparkSession, folder: str) -> State:
    """The saved state; empty tables before the first run."""
    return State(read_table(spark, folder, "queue", schemas.QUEUE), read_table(spark, folder, "seen", schemas.SEEN),
                 read_table(spark, folder, "seeded", schemas.SEEDED), read_table(spark, folder, "tombstones", schemas.TOMBSTONES),
                 read_table(spark, folder, "filtered", schemas.FILTERED), read_table(spark, folder, "freshness", schemas.FRESHNESS),
                 read_table(spark, folder, "summaries", schemas.SUMMARIES), read_table(spark, folder, "signature", schemas.SIGNATURE))


def alert_overflow(candidates: DataFrame, cap: int = fv.ALERT_CAP_PER_RUN) -> DataFrame:
    """One row `n`: alerts over the run's budget."""
    return candidates.agg(F.greatest(F.count(F.lit(1)) - F.lit(cap), F.lit(0)).alias("n"))
