"""Queries over the queue's state: liveness, intake, alerts, renewals, pruning, evergreen roles, dates from ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from postingworks.catalog.fixtures import AS_OF, fixture, select, table
from postingworks.catalog.registry import query
from postingworks.functions import fixed_values as fv
from postingworks.operators import anchors, boards, intake, lifecycle, lineage
from postingworks.operators.intake import describe_entries, new_entries
from postingworks.session import run_folder
from postingworks.sources import buckets
from postingworks.sources.sinks import refresh_partly

C, L = F.col, F.lit
DAY = f"DATE '{AS_OF}'"


def as_of():
    return L(AS_OF).cast("date")


def text_dates(df, *names):
    return df.select(*[C(c).cast("string").alias(c) if c in names else C(c) for c in df.columns])


_LIVE = f"""
WITH r AS (SELECT q.*, l.posting_id IS NOT NULL AS live FROM queue q LEFT JOIN (SELECT DISTINCT company, posting_id FROM listing) l
  ON q.company = l.company AND q.posting_id = l.posting_id),
s AS (SELECT company, count(*) FILTER (closed_on IS NULL) AS o, count(*) FILTER (closed_on IS NULL AND NOT live) AS m FROM r GROUP BY 1),
b AS (SELECT boards.company, complete, board_type, o >= 3 AND m * 1.0 / o > 0.5 AS vanish FROM boards JOIN s ON boards.company = s.company WHERE n_jobs > 0),
x AS (SELECT r.*, b.board_type AS kind, coalesce(b.complete, FALSE) AS complete, b.company IS NOT NULL AS read, CASE WHEN vanish THEN 6 ELSE 2 END AS lim FROM r LEFT JOIN b ON r.company = b.company),
y AS (SELECT *, read AND live AS seen, complete AND NOT live AND closed_on IS NULL AS missed,
  complete AND NOT live AND closed_on IS NULL AND miss_count + 1 >= lim AND last_seen_live < {DAY} AS due FROM x),
z AS (SELECT *, due AND kind IN ('workday', 'oracle') AND {{listed}} AS relisted, due AND kind IN ('workday', 'oracle') AND {{unknown}} AS unk FROM y)
SELECT id, CAST(CASE WHEN seen OR relisted THEN {DAY} ELSE last_seen_live END AS STRING) AS last_seen_live,
  CASE WHEN seen OR relisted THEN 0 WHEN unk THEN lim - 1 WHEN missed THEN miss_count + 1 ELSE miss_count END AS miss_count,
  CAST(CASE WHEN due AND NOT relisted AND NOT unk THEN {DAY} WHEN seen AND closed_reason <> 'manual' THEN NULL ELSE closed_on END AS STRING) AS closed_on,
  CASE WHEN due AND NOT relisted AND NOT unk THEN 'removed' WHEN seen AND closed_reason <> 'manual' THEN NULL ELSE closed_reason END AS closed_reason,
  repost_count + CASE WHEN seen AND closed_reason <> 'manual' THEN 1 ELSE 0 END AS repost_count,
  CASE WHEN due AND NOT relisted AND NOT unk THEN 'closed' WHEN seen AND closed_reason <> 'manual' THEN 'reopened' END AS event FROM z"""
_LIVE_COLUMNS = ("id", "last_seen_live", "miss_count", "closed_on", "closed_reason", "repost_count", "event")


@query("liveness", _LIVE.format(listed="TRUE", unknown="FALSE"))
def liveness(spark, sf):
    out = lifecycle.update_liveness(fixture(spark, sf, "queue"), fixture(spark, sf, "listing"), fixture(spark, sf, "boards"), as_of())
    return text_dates(out.select(*_LIVE_COLUMNS), "last_seen_live", "closed_on")


@query("liveness_double_checked", _LIVE.format(listed="o_custkey % 3 = 0", unknown="o_custkey % 3 = 1"))
def liveness_double_checked(spark, sf):
    queue = fixture(spark, sf, "queue")
    verdicts = queue.select("id", F.when(C("o_custkey") % 3 == 0, "listed").when(C("o_custkey") % 3 == 1, "unknown").otherwise("gone").alias("verdict"))
    out = lifecycle.update_liveness(queue, fixture(spark, sf, "listing"), fixture(spark, sf, "boards"), as_of(), verdicts)
    return text_dates(out.select(*_LIVE_COLUMNS), "last_seen_live", "closed_on")


# the queue cut into buckets; a run that reads one board leaves the others' rows and files as they are
def _bucketed(spark, sf, boards):
    queue = fixture(spark, sf, "queue")
    folder = run_folder(spark, "buckets")
    buckets.create({"queue": queue}, folder, buckets=16)
    buckets.apply_liveness(spark, folder, queue.schema, fixture(spark, sf, "listing"), boards, as_of())
    return text_dates(buckets.read(spark, folder, "queue", queue.schema).select(*_LIVE_COLUMNS[:-1]), "last_seen_live", "closed_on")


def _without_event(sql):
    return f"SELECT {', '.join(_LIVE_COLUMNS[:-1])} FROM ({sql})"


@query("bucketed_liveness", _without_event(_LIVE.format(listed="TRUE", unknown="FALSE")))
def bucketed_liveness(spark, sf):
    return _bucketed(spark, sf, fixture(spark, sf, "boards"))


@query("bucketed_liveness_of_one_board", _without_event(_LIVE.format(listed="TRUE", unknown="FALSE").replace(
    "WHERE n_jobs > 0", "WHERE n_jobs > 0 AND boards.company = '4-NOT SPECIFIED'")))
def bucketed_liveness_of_one_board(spark, sf):
    return _bucketed(spark, sf, fixture(spark, sf, "boards").where("company = '4-NOT SPECIFIED'"))


@query("closures_to_check", _LIVE.format(listed="FALSE", unknown="FALSE").split("SELECT id, CAST(")[0]
       + "SELECT id FROM z WHERE due AND kind IN ('workday', 'oracle')")
def closures_to_check(spark, sf):
    return lifecycle.due_for_check(fixture(spark, sf, "queue"), fixture(spark, sf, "listing"), fixture(spark, sf, "boards"), as_of()).select("id")


@query("verified_companies", "SELECT company FROM boards WHERE err IS NULL AND complete AND n_jobs > 0")
def verified_companies(spark, sf):
    return lifecycle.verified_companies(fixture(spark, sf, "boards"))


DESCRIBED = f"""SELECT o_orderpriority AS company, CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN 'workday' ELSE 'greenhouse' END AS board_type,
  CONCAT('n', CAST(o_orderkey AS STRING)) AS posting_id, CONCAT('Analyst ', CAST(o_custkey % 40 AS STRING)) AS title, 'Boston' AS location,
  CONCAT('https://x.example.com/job/', CAST(o_orderkey AS STRING)) AS url, CAST(o_orderdate AS DATE) AS posted, CAST(NULL AS STRING) AS posted_source,
  'main' AS site, o_orderpriority = '5-LOW' AS first_run, o_totalprice < 20000 AS desc_failed, o_orderkey AS ord, o_custkey,
  CASE o_custkey % 4 WHEN 0 THEN 'We do not sponsor visas.' WHEN 1 THEN 'Must be a U.S. citizen.' WHEN 2 THEN 'Requires 5+ years of experience.'
    ELSE 'Salary range $100,000 - $120,000.' END AS description FROM orders WHERE o_orderdate >= CAST('{AS_OF}' AS DATE)"""
SOURCES = """SELECT d.company, d.posting_id, q.id AS prior_id FROM described d JOIN queue q ON d.company = q.company AND CONCAT('n', CAST(q.ord + 1 AS STRING)) = d.posting_id
WHERE d.company <> '5-LOW'"""


def _intake(spark, sf):
    described = select(spark, sf, DESCRIBED)
    queue = fixture(spark, sf, "queue")
    nxt = F.concat(L("n"), (C("ord") + 1).cast("string"))
    sources = (queue.where("company <> '5-LOW'").select("company", nxt.alias("posting_id"), C("id").alias("prior_id"))
               .join(described.select("company", "posting_id"), ["company", "posting_id"]))
    return new_entries(describe_entries(described, ("analyst",)), sources, queue, as_of()), queue, sources


@query("intake_entries", f"""
SELECT d.company || ':' || d.posting_id AS id, CASE o.o_custkey % 4 WHEN 0 THEN 'OPT Only' WHEN 1 THEN 'Blocked' ELSE 'Unclear' END AS sponsorship_status,
  CASE WHEN o.o_custkey % 4 <> 1 AND q.state IN ('dismissed', 'applied', 'shortlisted') THEN q.state
    ELSE CASE o.o_custkey % 4 WHEN 0 THEN 'opt_only' WHEN 1 THEN 'auto_blocked' ELSE 'new' END END AS state,
  CASE WHEN o.o_custkey % 4 = 2 THEN 5 END AS experience, CASE WHEN o.o_custkey % 4 = 3 THEN '$100,000 - $120,000' ELSE 'Unclear' END AS salary,
  CASE d.board_type WHEN 'workday' THEN 'approx' ELSE 'exact' END AS posted_source, CASE WHEN d.desc_failed THEN 'failed' ELSE 'ok' END AS description_status,
  q.id AS repost_of, coalesce(q.repost_count + 1, 0) AS repost_count, CASE WHEN q.id IS NOT NULL THEN CAST(d.posted AS STRING) END AS reposted_on,
  coalesce(q.lineage_root, d.company || ':' || d.posting_id) AS lineage_root, CAST(coalesce(q.lineage_first_seen, {DAY}) AS STRING) AS lineage_first_seen
FROM described d JOIN orders o ON d.ord = o.o_orderkey LEFT JOIN src s ON d.company = s.company AND d.posting_id = s.posting_id LEFT JOIN queue q ON s.prior_id = q.id""",
       described=DESCRIBED, src=SOURCES)
def intake_entries(spark, sf):
    entries, _, _ = _intake(spark, sf)
    out = entries.select("id", "sponsorship_status", "state", "experience", "salary", "posted_source", "description_status", "repost_of",
                         "repost_count", "reposted_on", "lineage_root", "lineage_first_seen")
    return text_dates(out, "reposted_on", "lineage_first_seen")


@query("reposted_priors_closed", f"""
SELECT q.id, CAST(CASE WHEN s.prior_id IS NOT NULL AND closed_on IS NULL THEN {DAY} ELSE closed_on END AS STRING) AS closed_on,
  CASE WHEN s.prior_id IS NOT NULL AND closed_on IS NULL THEN 'reposted' ELSE closed_reason END AS closed_reason
FROM queue q LEFT JOIN (SELECT DISTINCT prior_id FROM src) s ON q.id = s.prior_id""", described=DESCRIBED, src=SOURCES)
def reposted_priors_closed(spark, sf):
    described = select(spark, sf, DESCRIBED)
    queue = fixture(spark, sf, "queue")
    nxt = F.concat(L("n"), (C("ord") + 1).cast("string"))
    sources = (queue.where("company <> '5-LOW'").select("company", nxt.alias("posting_id"), C("id").alias("prior_id"))
               .join(described.select("company", "posting_id"), ["company", "posting_id"]))
    return text_dates(intake.close_reposted(queue, sources, as_of()).select("id", "closed_on", "closed_reason"), "closed_on")


ENTRIES = """SELECT id, company, posting_id, ord, sponsorship_status, first_run, CASE WHEN o_custkey % 5 = 0 THEN 'p' END AS repost_of,
  o_custkey % 10 = 0 AS prior_was_blocked, 0 AS company_ord FROM queue"""
FLOODS = "SELECT company, company = '4-NOT SPECIFIED' AS flood, CAST(COUNT(*) AS BIGINT) AS fresh FROM queue GROUP BY company"


def _alerts(spark, sf):
    q = fixture(spark, sf, "queue")
    entries = q.select("id", "company", "posting_id", "ord", "sponsorship_status", "first_run", F.when(C("o_custkey") % 5 == 0, "p").alias("repost_of"),
                       (C("o_custkey") % 10 == 0).alias("prior_was_blocked"), L(0).alias("company_ord"))
    floods = q.groupBy("company").agg(F.count(L(1)).alias("fresh")).withColumn("flood", C("company") == "4-NOT SPECIFIED")
    return intake.alert_candidates(entries, floods), floods


_CANDIDATES = """FROM entries WHERE NOT first_run AND company <> '4-NOT SPECIFIED' AND sponsorship_status NOT IN ('Blocked', 'OPT Only')
  AND (repost_of IS NULL OR prior_was_blocked)"""


@query("alert_candidates", f"SELECT company, count(*) AS n {_CANDIDATES} GROUP BY company", entries=ENTRIES)
def alert_candidates(spark, sf):
    return _alerts(spark, sf)[0].groupBy("company").agg(F.count(L(1)).alias("n"))


@query("alerts_within_budget", f"SELECT id {_CANDIDATES} ORDER BY ord LIMIT 30", entries=ENTRIES)
def alerts_within_budget(spark, sf):
    return intake.select_alerts(_alerts(spark, sf)[0]).select("id")


@query("alert_retry", """
WITH r AS (SELECT *, alert_pending AND o_custkey % 4 <> 0 AS pend, closed_on IS NOT NULL OR state <> 'new' OR alert_attempts >= 3 AS done FROM queue),
t AS (SELECT id FROM r WHERE pend AND NOT done ORDER BY ord LIMIT 25)
SELECT id, CAST(CASE WHEN pend AND (done OR (id IN (FROM t) AND o_custkey % 2 = 0)) THEN FALSE ELSE alert_pending END AS INT) AS alert_pending,
  CASE WHEN id IN (FROM t) AND o_custkey % 2 <> 0 THEN alert_attempts + 1 ELSE alert_attempts END AS alert_attempts FROM r""")
def alert_retry(spark, sf):
    q = fixture(spark, sf, "queue")
    outcomes = q.select("id", (C("o_custkey") % 4 == 0).alias("failed_now"), (C("o_custkey") % 2 == 0).alias("delivered"))
    return lifecycle.retry_alerts(q, outcomes, 25).select("id", C("alert_pending").cast("int").alias("alert_pending"), "alert_attempts")


@query("summary_retry", """
WITH l AS (SELECT company || ': ' || fresh || ' roles appeared at once, queued silently (flood guard)' AS line, 0 AS attempts FROM floods WHERE flood
  UNION ALL SELECT '12 more new roles queued without individual alerts (cap 30)', 0
  UNION ALL SELECT DISTINCT state || ' pending', CAST(length(state) % 4 AS INT) FROM queue)
SELECT line, attempts + 1 AS attempts FROM l WHERE line NOT LIKE 'new%' AND attempts + 1 < 3""", floods=FLOODS)
def summary_retry(spark, sf):
    q = fixture(spark, sf, "queue")
    floods = q.groupBy("company").agg(F.count(L(1)).alias("fresh")).withColumn("flood", C("company") == "4-NOT SPECIFIED")
    capped = q.agg(F.min(L(12)).alias("n"))
    pending = q.select(F.concat("state", L(" pending")).alias("line"), (F.length("state") % 4).alias("attempts")).distinct()
    return lifecycle.retry_summaries(pending, lifecycle.summary_lines(floods, capped), pending.where("line like 'new%'"))


_RECALL = f"""
SELECT l.company || ':' || l.posting_id AS id FROM listing l WHERE (l.posted IS NULL OR l.posted >= {DAY} - 60)
  AND l.company || ':' || l.posting_id NOT IN (SELECT id FROM queue WHERE o_custkey % 3 = 0) AND l.ord % 5 <> 0 AND l.ord % 7 <> 0"""


def _recall(spark, sf, cap=None):
    hits = fixture(spark, sf, "listing").withColumn("company_ord", L(0))
    queue = fixture(spark, sf, "queue").where("o_custkey % 3 = 0")
    stones = hits.where("ord % 7 = 0").select(F.concat_ws(":", "company", "posting_id").alias("id"))
    return intake.recall(hits, hits.where("ord % 5 <> 0"), queue, stones, as_of(), cap).select("id")


@query("recall", _RECALL)
def recall(spark, sf):
    return _recall(spark, sf)


@query("recall_capped", f"{_RECALL} ORDER BY l.ord LIMIT 150")
def recall_capped(spark, sf):
    return _recall(spark, sf, fv.RECALL_MAX_PER_RUN)


# orders in chains of a thousand re-listings; one in fifty links leads to an entry that is gone, every third chain's end is a ring
REPOSTED = """SELECT CONCAT('p', LPAD(CAST(o_orderkey AS STRING), 9, '0')) AS id, CAST(o_orderdate AS DATE) AS first_seen,
  CASE WHEN o_orderkey % 1000 = 0 THEN CASE WHEN o_orderkey % 3000 = 0 THEN CONCAT('p', LPAD(CAST(o_orderkey + 6 AS STRING), 9, '0')) END
    WHEN o_orderkey % 1000 > 300 AND o_orderkey % 50 = 0 AND o_orderkey % 2000 > 1000 THEN CONCAT('gone', CAST(o_orderkey AS STRING))
    ELSE CONCAT('p', LPAD(CAST(o_orderkey - 1 AS STRING), 9, '0')) END AS repost_of,
  CASE WHEN o_orderkey % 7 = 0 THEN 'carried' END AS lineage_root, CAST(NULL AS DATE) AS lineage_first_seen FROM orders"""


@query("rebuilt_lineage", """
WITH RECURSIVE up AS (SELECT a.id, b.id AS parent FROM reposted a JOIN reposted b ON a.repost_of = b.id),
down AS (SELECT id, id AS root FROM reposted WHERE id NOT IN (SELECT id FROM up) UNION ALL SELECT up.id, down.root FROM up JOIN down ON up.parent = down.id),
turning AS (SELECT id, parent FROM up WHERE id NOT IN (SELECT id FROM down)),
ring AS (SELECT id, parent FROM turning WHERE CAST(substr(id, 2) AS BIGINT) % 1000 <= 6),
reach AS (SELECT id, id AS other FROM ring UNION SELECT reach.id, ring.parent FROM reach JOIN ring ON ring.id = reach.other),
tails AS (SELECT id, (SELECT min(other) FROM reach r WHERE r.id = ring.id) AS root FROM ring
  UNION ALL SELECT t.id, tails.root FROM turning t JOIN tails ON t.parent = tails.id WHERE t.id NOT IN (SELECT id FROM ring)),
found AS (SELECT id, root FROM down UNION ALL SELECT id, root FROM tails)
SELECT q.id, coalesce(q.lineage_root, found.root) AS lineage_root, CAST(o.first_seen AS STRING) AS lineage_first_seen
FROM reposted q JOIN found ON found.id = q.id JOIN reposted o ON o.id = found.root""", reposted=REPOSTED)
def rebuilt_lineage(spark, sf):
    out = lineage.rebuilt(select(spark, sf, REPOSTED))
    return text_dates(out.select("id", "lineage_root", "lineage_first_seen"), "lineage_first_seen")


_RENEW = """FROM queue q JOIN (SELECT company, posting_id, max(posted) AS listed FROM listing WHERE posted IS NOT NULL GROUP BY 1, 2) l
  ON q.company = l.company AND q.posting_id = l.posting_id WHERE q.closed_on IS NULL AND q.posted IS NOT NULL AND listed - q.posted >= 2 AND q.company IN ('1-URGENT', '3-MEDIUM')"""


@query("renewal_candidates", f"SELECT q.id, CAST(listed AS STRING) AS listed {_RENEW}")
def renewal_candidates(spark, sf):
    out = lifecycle.renewal_candidates(fixture(spark, sf, "queue"), fixture(spark, sf, "listing"), fixture(spark, sf, "boards"))
    return out.select("id", C("listed").cast("string").alias("listed"))


@query("renewals_to_check", f"SELECT q.id {_RENEW} ORDER BY q.ord LIMIT 100")
def renewals_to_check(spark, sf):
    found = lifecycle.renewal_candidates(fixture(spark, sf, "queue"), fixture(spark, sf, "listing"), fixture(spark, sf, "boards"))
    return lifecycle.renewals_to_check(found).select("id")


@query("renewals_applied", f"""
WITH d AS (SELECT q.id, listed AS d {_RENEW})
SELECT q.id, CAST(coalesce(d.d, posted) AS STRING) AS posted, CASE WHEN d.d IS NULL THEN posted_source ELSE 'exact' END AS posted_source,
  repost_count + CASE WHEN d.d IS NULL THEN 0 ELSE 1 END AS repost_count, CAST(CASE WHEN d.d IS NOT NULL THEN posted END AS STRING) AS posted_before_refresh
FROM queue q LEFT JOIN d ON q.id = d.id""")
def renewals_applied(spark, sf):
    queue = fixture(spark, sf, "queue")
    found = lifecycle.renewal_candidates(queue, fixture(spark, sf, "listing"), fixture(spark, sf, "boards"))
    details = found.select("id", C("listed").alias("detail_posted"), L("exact").alias("detail_source"))
    out = lifecycle.apply_renewals(queue, details).select("id", "posted", "posted_source", "repost_count", "posted_before_refresh")
    return text_dates(out, "posted", "posted_before_refresh")


_REVERIFY = f"""FROM queue WHERE first_seen BETWEEN {DAY} - 3 AND {DAY} - 1 AND closed_on IS NULL AND NOT posted_reverified
  AND company IN ('1-URGENT', '3-MEDIUM') ORDER BY ord LIMIT 300"""


@query("reverified_dates", f"""
WITH t AS (SELECT id {_REVERIFY})
SELECT q.id, CAST(CASE WHEN t.id IS NOT NULL AND o_custkey % 2 = 0 THEN first_seen ELSE posted END AS STRING) AS posted,
  CAST(coalesce(t.id IS NOT NULL, FALSE) OR posted_reverified AS INT) AS posted_reverified FROM queue q LEFT JOIN t ON q.id = t.id""")
def reverified_dates(spark, sf):
    queue = fixture(spark, sf, "queue")
    due = lifecycle.reverify_window(queue, fixture(spark, sf, "boards"), as_of())
    details = due.select("id", F.when(C("o_custkey") % 2 == 0, C("first_seen")).alias("detail_posted"), L("exact").alias("detail_source"))
    out = lifecycle.apply_reverified(queue, details)
    return out.select("id", C("posted").cast("string").alias("posted"), C("posted_reverified").cast("int").alias("posted_reverified"))


@query("enrichment_due", f"""
SELECT id, enrich_attempts + 1 AS enrich_attempts, CAST({DAY} + 1 AS STRING) AS enrich_next FROM queue
WHERE closed_on IS NULL AND enrich_attempts < 5 AND (enrich_next IS NULL OR enrich_next <= {DAY})
  AND (description_status = 'failed' OR (company IN ('1-URGENT', '3-MEDIUM') AND posted IS NULL)) ORDER BY ord LIMIT 40""")
def enrichment_due(spark, sf):
    out = lifecycle.enrichment_due(fixture(spark, sf, "queue"), fixture(spark, sf, "boards"), as_of())
    return out.select("id", "enrich_attempts", C("enrich_next").cast("string").alias("enrich_next"))


@query("enrichment_applied", f"""
WITH t AS (SELECT id FROM queue WHERE closed_on IS NULL AND enrich_attempts < 5 AND (enrich_next IS NULL OR enrich_next <= {DAY})
  AND (description_status = 'failed' OR (company IN ('1-URGENT', '3-MEDIUM') AND posted IS NULL)) ORDER BY ord LIMIT 40),
r AS (SELECT q.*, t.id IS NOT NULL AS tried, t.id IS NOT NULL AND o_custkey % 2 = 0 AS good FROM queue q LEFT JOIN t ON q.id = t.id)
SELECT id, CASE WHEN good AND description_status = 'failed' THEN 'ok' ELSE description_status END AS description_status,
  CASE WHEN good AND description_status = 'failed' THEN 'Blocked' ELSE sponsorship_status END AS sponsorship_status,
  CASE WHEN good AND description_status = 'failed' AND state = 'new' THEN 'auto_blocked' ELSE state END AS state,
  CAST(CASE WHEN good AND posted IS NULL THEN first_seen ELSE posted END AS STRING) AS posted,
  enrich_attempts + CASE WHEN tried THEN 1 ELSE 0 END AS enrich_attempts FROM r""")
def enrichment_applied(spark, sf):
    queue = fixture(spark, sf, "queue").withColumn("kw_hits", L(None).cast("array<string>"))
    due = lifecycle.enrichment_due(queue, fixture(spark, sf, "boards"), as_of())
    reread = due.select("id", (C("o_custkey") % 2 == 0).alias("ok"), "location", C("first_seen").alias("posted"), L("exact").alias("posted_source"),
                        L("Blocked").alias("sponsorship_status"), L("e").alias("sponsorship_evidence"), L(3).alias("experience"), L("e").alias("experience_evidence"),
                        L("Unclear").alias("salary"), L("").alias("salary_evidence"), "kw_hits", L(True).alias("has_text"))
    out = lifecycle.apply_enriched(queue, reread, as_of())
    return text_dates(out.select("id", "description_status", "sponsorship_status", "state", "posted", "enrich_attempts"), "posted")


_STALE = f"""state IN ('new', 'opt_only', 'auto_blocked') AND coalesce(posted < {DAY} - 60, FALSE) AND NOT (coalesce(last_seen_live = {DAY}, FALSE) AND closed_on IS NULL)
  AND company NOT IN ('3-MEDIUM', '5-LOW') AND (closed_on IS NOT NULL OR company = '4-NOT SPECIFIED')"""


def _split(spark, sf):
    known = fixture(spark, sf, "boards")
    return lifecycle.split_stale(fixture(spark, sf, "queue"), lifecycle.verified_companies(known), known.where("company <> '4-NOT SPECIFIED'"), as_of())


@query("pruned_entries", f"SELECT id, 'pruned' AS reason, '{AS_OF}' AS on_day FROM queue WHERE {_STALE}")
def pruned_entries(spark, sf):
    return lifecycle.tombstones(_split(spark, sf)[1], as_of()).select("id", "reason", C("on").cast("string").alias("on_day"))


@query("kept_entries", f"SELECT state, count(*) AS n FROM queue WHERE NOT ({_STALE}) GROUP BY state")
def kept_entries(spark, sf):
    return _split(spark, sf)[0].groupBy("state").agg(F.count(L(1)).alias("n"))


@query("hand_marks", f"""
SELECT id, CAST(CASE o_custkey % 5 WHEN 0 THEN {DAY} WHEN 1 THEN NULL ELSE closed_on END AS STRING) AS closed_on,
  CASE o_custkey % 5 WHEN 0 THEN 'manual' WHEN 1 THEN NULL ELSE closed_reason END AS closed_reason,
  CASE WHEN o_custkey % 5 = 1 THEN 0 ELSE miss_count END AS miss_count, CASE WHEN o_custkey % 5 = 2 THEN 'applied' ELSE state END AS state FROM queue""")
def hand_marks(spark, sf):
    q = fixture(spark, sf, "queue")
    k = C("o_custkey") % 5
    marks = q.where(k < 4).select("id", F.when(k == 0, "closed").when(k == 1, "open").when(k == 2, "applied").otherwise("nonsense").alias("mark"))
    out = lifecycle.apply_marks(q, marks, as_of()).select("id", "closed_on", "closed_reason", "miss_count", "state")
    return text_dates(out, "closed_on")


_GHOST = """
WITH e AS (SELECT company, 'analyst ' || o_custkey % 40 || '|' || trim(regexp_replace(lower(location), '[^a-z0-9]+', ' ', 'g')) AS fp, first_seen, ord,
  coalesce(closed_on, last_seen_live, first_seen) AS quiet FROM {src}),
w AS (SELECT *, lag(quiet) OVER (PARTITION BY company, fp ORDER BY first_seen, ord) AS before FROM e),
g AS (SELECT company, fp, count(*) AS n, bool_and(before IS NULL OR first_seen >= before) AS serial, min(first_seen) AS a, max(first_seen) AS b FROM w GROUP BY 1, 2)
SELECT company, fp, n AS postings, CASE WHEN n >= 3 AND serial AND b - a >= 120 THEN 'Likely' ELSE 'Unclear' END AS ghost_status,
  CASE WHEN n >= 3 AND serial AND b - a >= 120 THEN 'posted ' || n || 'x since ' || a || ' (span ' || (b - a) || 'd), most recently ' || b ELSE '' END AS ghost_evidence FROM g"""
SPARSE = "SELECT * FROM queue WHERE o_totalprice > 440000"


@query("evergreen_roles", _GHOST.format(src="queue"))
def evergreen_roles(spark, sf):
    return lifecycle.evergreen_roles(fixture(spark, sf, "queue"))


@query("evergreen_roles_of_large_orders", _GHOST.format(src="sparse"), sparse=SPARSE)
def evergreen_large(spark, sf):
    return lifecycle.evergreen_roles(fixture(spark, sf, "queue").where("o_totalprice > 440000"))


@query("id_date_correlation", """
WITH a AS (SELECT DISTINCT company, CAST(posting_id AS BIGINT) AS i, date_diff('day', DATE '1970-01-01', posted) AS d FROM queue WHERE posted IS NOT NULL),
r AS (SELECT company, rank() OVER (PARTITION BY company ORDER BY i) + (count(*) OVER (PARTITION BY company, i) - 1) / 2.0 AS ri,
  rank() OVER (PARTITION BY company ORDER BY d) + (count(*) OVER (PARTITION BY company, d) - 1) / 2.0 AS rd FROM a)
SELECT company, count(*) AS anchors, round(corr(ri, rd), 8) AS spearman FROM r GROUP BY company""")
def id_date_correlation(spark, sf):
    q = fixture(spark, sf, "queue").where("posted is not null")
    points = q.select("company", C("posting_id").cast("bigint").alias("num_id"), F.unix_date("posted").alias("day")).distinct()
    return anchors.id_date_correlation(points).select("company", "anchors", F.round("spearman", 8).alias("spearman"))


# ids that grow with the date, two thirds of them dated
DATED = """SELECT CONCAT(o_orderpriority, ':', CAST(CAST(datediff AS BIGINT) * 100000 + o_orderkey % 100000 AS STRING)) AS id, o_orderpriority AS company,
  CAST(CAST(datediff AS BIGINT) * 100000 + o_orderkey % 100000 AS STRING) AS posting_id, CASE WHEN o_custkey % 3 <> 0 THEN day END AS posted, FALSE AS posted_est,
  CAST(NULL AS STRING) AS posted_source, o_custkey % 3 = 0 AS first_run, CAST('2002-01-01' AS DATE) AS first_seen, o_custkey
FROM (SELECT *, CAST(o_orderdate AS DATE) AS day, {days} AS datediff FROM orders)"""


@query("dates_from_ids", """
WITH q AS (SELECT *, CAST(posting_id AS BIGINT) AS i, date_diff('day', DATE '1970-01-01', posted) AS d FROM dated),
a AS (SELECT DISTINCT company, i, d FROM q WHERE d IS NOT NULL),
t AS (SELECT id, company, i FROM q WHERE d IS NULL AND first_run AND NOT EXISTS (SELECT 1 FROM a WHERE a.company = q.company AND a.i = q.i)),
n AS (SELECT t.id, t.i, lo.i AS li, lo.d AS ld FROM t ASOF LEFT JOIN a lo ON t.company = lo.company AND t.i >= lo.i),
m AS (SELECT t.id, hi.i AS hi, hi.d AS hd FROM t ASOF LEFT JOIN a hi ON t.company = hi.company AND t.i <= hi.i)
SELECT n.id, CASE WHEN li IS NOT NULL AND hi IS NOT NULL THEN CASE WHEN ld <= hd THEN CAST(DATE '1970-01-01' + CAST(ld + round_even((hd - ld) * (n.i - li) * 1.0 / (hi - li), 0) AS INT) AS STRING) END
  WHEN ld IS NOT NULL THEN CAST(DATE '1970-01-01' + CAST(ld AS INT) AS STRING) END AS estimate FROM n JOIN m ON n.id = m.id""",
       dated=DATED.format(days="date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))"))
def dates_from_ids(spark, sf):
    rows = select(spark, sf, DATED.format(days="date_diff(CAST(o_orderdate AS DATE), DATE '1995-01-01')"))
    out = anchors.estimate_dates(rows, rows.select("company").distinct())
    near = rows.where("posted is not null").select("company", C("posting_id"))
    return (out.where("posted is null").join(near, ["company", "posting_id"], "left_anti")
            .select("id", C("estimate").cast("string").alias("estimate")))


@query("filtered_refresh", """
SELECT company, posting_id, 'old' AS version FROM listing WHERE company IN ('3-MEDIUM', '5-LOW')
UNION ALL SELECT company, posting_id, 'new' FROM listing WHERE company NOT IN ('3-MEDIUM', '5-LOW') AND ord % 2 = 0""")
def filtered_refresh(spark, sf):
    rows = fixture(spark, sf, "listing").select("company", "posting_id", "ord")
    unverified = rows.select("company").where("company in ('3-MEDIUM', '5-LOW')")
    return refresh_partly(rows.select("company", "posting_id", L("old").alias("version")),
                          rows.where("ord % 2 = 0").select("company", "posting_id", L("new").alias("version")), unverified)


@query("monthly_orders_flood", """
WITH h AS (SELECT o_orderpriority AS company, o_orderkey, o_orderdate >= DATE '2001-07-01' AS fresh FROM orders)
SELECT company, CAST(count(*) AS BIGINT) AS hits, CAST(count(*) FILTER (fresh) AS BIGINT) AS fresh,
  CAST(company <> '1-URGENT' AND count(*) FILTER (fresh) > greatest(10, 0.5 * count(*)) AS INT) AS flood FROM h GROUP BY company""")
def monthly_orders_flood(spark, sf):
    hits = table(spark, sf, "orders").select(C("o_orderpriority").alias("company"), "o_orderdate")
    out = boards.flooded(hits, hits.where("o_orderdate >= DATE '2001-07-01'"), hits.where("company = '1-URGENT'"))
    return out.select("company", "hits", "fresh", C("flood").cast("int").alias("flood"))
