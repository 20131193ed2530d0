"""Queries over boards, run health, configuration checks, backfills and shard files."""

from __future__ import annotations

from pyspark.sql import functions as F

from postingworks.catalog.fixtures import AS_OF, fixture, select, table
from postingworks.catalog.registry import query
from postingworks.operators import backfill, boards, health, validation
from postingworks.operators.views import public_rows
from postingworks.session import run_folder
from postingworks.sources import files, shards

C, L = F.col, F.lit
DAY = f"DATE '{AS_OF}'"


def as_of():
    return L(AS_OF).cast("date")


# lineitems read as listing rows: supplier = company, flag = term, page of ten orders by line
PAGES = """SELECT CONCAT('s', CAST(l_suppkey AS STRING)) AS company, 'main' AS site, l_returnflag AS term, CAST(l_linenumber AS INT) AS page_no,
  MIN(l_quantity) > 1 AS ok, 8 AS page_size, CAST(60 + l_suppkey % 30 AS BIGINT) AS reported_total FROM lineitem GROUP BY l_suppkey, l_returnflag, l_linenumber"""
ROWS = """SELECT CONCAT('s', CAST(l_suppkey AS STRING)) AS company, 'main' AS site, l_returnflag AS term, CAST(l_linenumber AS INT) AS page_no,
  CAST(l_partkey % 700 AS STRING) AS posting_id FROM lineitem"""


@query("listing_completeness", """
WITH fp AS (SELECT company, site, term, posting_id, min(page_no) AS page_no FROM rws GROUP BY ALL),
n AS (SELECT company, site, term, page_no, count(*) AS new FROM fp GROUP BY ALL),
s AS (SELECT company, site, term, page_no, count(*) AS n FROM rws GROUP BY ALL),
r AS (SELECT p.*, coalesce(s.n, 0) AS n, coalesce(n.new, 0) AS new FROM pgs p LEFT JOIN s USING (company, site, term, page_no) LEFT JOIN n USING (company, site, term, page_no)),
t AS (SELECT company, site, term, min(page_no) FILTER (ok AND (n < page_size OR new = 0)) AS fin, min(page_no) FILTER (NOT ok) AS lost, max(reported_total) AS total, sum(new) AS ids FROM r GROUP BY ALL),
u AS (SELECT *, lost IS NOT NULL AND (fin IS NULL OR lost < fin) AS gone FROM t)
SELECT company, CAST(bool_and(NOT gone AND (fin IS NOT NULL OR ids >= total)) AS INT) AS complete, count(*) AS terms,
  CAST(count(*) FILTER (gone) AS BIGINT) AS terms_with_lost_page, CAST(sum(ids) AS BIGINT) AS ids_read FROM u GROUP BY company""", pgs=PAGES, rws=ROWS)
def listing_completeness(spark, sf):
    out = boards.listing_completeness(select(spark, sf, PAGES), select(spark, sf, ROWS))
    return out.withColumn("complete", C("complete").cast("int"))


@query("facet_coverage", """
WITH e AS (SELECT company, site, CAST(count(*) AS BIGINT) AS expected FROM (SELECT DISTINCT company, site, posting_id, page_no <= 6 AS early FROM rws) WHERE early GROUP BY ALL),
n AS (SELECT company, site, count(DISTINCT posting_id) AS n_read FROM rws WHERE page_no <= 5 GROUP BY ALL)
SELECT company, expected, coalesce(n_read, 0) AS n_read, CAST(coalesce(n_read, 0) >= 0.998 * expected AS INT) AS covered FROM e LEFT JOIN n USING (company, site)""", rws=ROWS)
def facet_coverage(spark, sf):
    rows = select(spark, sf, ROWS)
    expected = rows.where("page_no <= 6").select("company", "site", "posting_id").distinct().groupBy("company", "site").agg(F.count(L(1)).alias("expected"))
    return boards.facet_coverage(rows.where("page_no <= 5"), expected).select("company", "expected", "n_read", C("covered").cast("int").alias("covered"))


FACETS = """SELECT o_orderpriority AS company, 'status' AS facet, 0 AS facet_ord, o_orderstatus AS value, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus
  UNION ALL SELECT o_orderpriority, 'year', 1, CAST(YEAR(o_orderdate) AS STRING), CAST(COUNT(*) AS BIGINT) FROM orders GROUP BY o_orderpriority, YEAR(o_orderdate)
  UNION ALL SELECT o_orderpriority, 'site', 2, CAST(o_custkey % 7 AS STRING), CAST(COUNT(*) * 2 AS BIGINT) FROM orders GROUP BY o_orderpriority, o_custkey % 7"""


@query("facet_choice", """
WITH s AS (SELECT company, facet, facet_ord, sum(n) AS total, max(n) AS biggest FROM facets GROUP BY ALL),
sh AS (SELECT company, max(total) AS size FROM (SELECT company, total FROM s GROUP BY ALL HAVING count(*) > 1) GROUP BY company)
SELECT s.company, arg_min(facet, biggest) AS facet, CAST(min(size) AS BIGINT) AS board_size FROM s JOIN sh ON s.company = sh.company
WHERE total BETWEEN 0.995 * size AND 1.1 * size GROUP BY s.company""", facets=FACETS)
def facet_choice(spark, sf):
    return boards.choose_facet(select(spark, sf, FACETS))


# digests of the ids, folded without an order
SIGNATURE = """md5(concat_ws('|', count(*), bit_xor(CAST('0x' || substr(md5(posting_id), 1, 12) AS BIGINT)),
  sum(CAST('0x' || substr(md5(posting_id), 13, 12) AS BIGINT))))"""


@query("board_signatures", f"""
SELECT company, count(*) AS n, substr({SIGNATURE}, 1, 12) AS sig FROM (
  SELECT company, posting_id FROM listing) GROUP BY company""")
def board_signatures(spark, sf):
    return boards.id_signature(fixture(spark, sf, "listing"))


@query("board_freshness", f"""
WITH a AS (SELECT company, count(*) AS n, {SIGNATURE} AS sig FROM (SELECT DISTINCT company, posting_id FROM sightings WHERE day(run_date) <= 15) GROUP BY company),
b AS (SELECT company, count(*) AS n, {SIGNATURE} AS sig FROM (SELECT DISTINCT company, posting_id FROM sightings WHERE day(run_date) <= 16 OR company = 'view') WHERE company <> 'error' GROUP BY company)
SELECT coalesce(a.company, b.company) AS company, coalesce(b.n, a.n) AS n, substr(coalesce(b.sig, a.sig), 1, 12) AS sig,
  CASE WHEN b.sig IS NOT NULL THEN '{AS_OF}' ELSE '1999-05-01' END AS checked, CASE WHEN b.sig IS NULL OR a.sig = b.sig THEN '1999-05-01' ELSE '{AS_OF}' END AS changed
FROM a FULL JOIN b ON a.company = b.company""")
def board_freshness(spark, sf):
    seen = fixture(spark, sf, "sightings").select("company", "posting_id", F.dayofmonth("run_date").alias("d"))
    first = boards.id_signature(seen.where("d <= 15").select("company", "posting_id").distinct())
    known = first.withColumn("checked", L("1999-05-01").cast("date")).withColumn("changed", L("1999-05-01").cast("date"))
    second = boards.id_signature(seen.where("(d <= 16 or company = 'view') and company <> 'error'").select("company", "posting_id").distinct())
    out = boards.update_freshness(known, second, as_of())
    return out.withColumn("checked", C("checked").cast("string")).withColumn("changed", C("changed").cast("string"))


@query("frozen_boards", f"""
SELECT CASE WHEN n = 0 THEN 'EMPTY' ELSE 'FROZEN' END AS kind, company, n, CAST({DAY} - changed AS INT) AS days FROM (
  SELECT c_name AS company, CAST(count(o_orderkey) FILTER (o_orderstatus = 'P') AS BIGINT) AS n, CAST(max(coalesce(o_orderdate, DATE '1995-01-01')) AS DATE) AS changed
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_name) WHERE n = 0 OR {DAY} - changed >= 30""")
def frozen_boards(spark, sf):
    cust = table(spark, sf, "customer").join(table(spark, sf, "orders"), C("c_custkey") == C("o_custkey"), "left")
    rec = cust.groupBy(C("c_name").alias("company")).agg(F.count_if(C("o_orderstatus") == "P").alias("n"),
                                                       F.max(F.coalesce(C("o_orderdate").cast("date"), L("1995-01-01").cast("date"))).alias("changed"))
    return boards.frozen_boards(rec, as_of())


@query("mass_vanish", """
SELECT company, CAST(count(*) >= 3 AND count(*) FILTER (o_totalprice < 260000) * 1.0 / count(*) > 0.5 AS INT) AS vanish FROM queue WHERE closed_on IS NULL GROUP BY company""")
def mass_vanish(spark, sf):
    counts = fixture(spark, sf, "queue").where("closed_on is null").groupBy("company").agg(F.count(L(1)).alias("o"), F.count_if(C("o_totalprice") < 260000).alias("m"))
    return counts.select("company", boards.is_mass_vanish(C("o"), C("m")).cast("int").alias("vanish"))


@query("fetch_times", """
WITH d AS (SELECT company, strftime(run_date, '%Y-%m-%d') AS file, round(avg(secs), 2) AS secs FROM sightings GROUP BY 1, 2),
l AS (SELECT company, list(secs ORDER BY file) AS runs, CASE WHEN company <> 'view' THEN min(secs) END AS known FROM d GROUP BY company)
SELECT company, list_reduce(CASE WHEN known IS NULL THEN list_prepend(round_even(runs[1], 2), runs[2:]) ELSE list_prepend(known, runs) END,
  lambda a, x: round_even(0.5 * a + 0.5 * x, 2)) AS secs FROM l""")
def fetch_times(spark, sf):
    """Half-old, half-new seconds per board, folded over the daily averages of its sightings."""
    daily = fixture(spark, sf, "sightings").groupBy("company", F.date_format("run_date", "yyyy-MM-dd").alias("file")).agg(F.round(F.avg("secs"), 2).alias("secs"))
    known = daily.groupBy("company").agg(F.min("secs").alias("secs")).where("company <> 'view'")
    return boards.update_fetch_times(known, daily)


@query("newest_pages", """
SELECT company, url, place FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY lastmod DESC, url DESC) AS place FROM (
  SELECT DISTINCT o_orderpriority AS company, CAST(CAST(o_orderdate AS DATE) AS STRING) AS lastmod, 'u' || o_custkey AS url FROM orders)) WHERE place <= 60""")
def newest_pages(spark, sf):
    pages = table(spark, sf, "orders").select(C("o_orderpriority").alias("company"), C("o_orderdate").cast("date").cast("string").alias("lastmod"),
                                              F.concat(L("u"), "o_custkey").alias("url"))
    return boards.newest_pages(pages, 60)[0].select("company", "url", C("place").cast("bigint").alias("place"))


@query("pages_capped", """
SELECT company, CAST(count(*) <= 60 AS INT) AS complete FROM (SELECT DISTINCT o_orderpriority AS company, o_orderdate, o_custkey FROM orders) GROUP BY company""")
def pages_capped(spark, sf):
    pages = table(spark, sf, "orders").select(C("o_orderpriority").alias("company"), C("o_orderdate").cast("date").cast("string").alias("lastmod"),
                                              F.concat(L("u"), "o_custkey").alias("url"))
    return boards.newest_pages(pages, 60)[1].withColumn("complete", C("complete").cast("int"))


# employers read as fetch results
FETCHED = """SELECT c_name AS company, CASE WHEN c_custkey % 7 = 0 THEN 'timeout' END AS err, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal > 2000 END AS complete,
  c_custkey % 11 <> 0 AS jobs_ok, CAST(c_custkey % 4 AS INT) AS n_jobs FROM customer WHERE c_custkey % 13 <> 0"""
HISTORY = """SELECT c_name AS company, TIMESTAMP '1999-06-01 00:00:00' - c_custkey % 50 * INTERVAL '1' HOUR + CASE WHEN c_custkey % 9 = 0 THEN INTERVAL '100' HOUR ELSE INTERVAL '0' HOUR END AS last_success,
  CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '1999-06-01 00:00:00' - c_custkey % 30 * INTERVAL '1' HOUR END AS last_fetch_ok FROM customer WHERE c_custkey % 6 <> 0"""
_CLOCKS = """
WITH s AS (SELECT c.c_name AS company, f.*, CASE WHEN f.company IS NULL THEN 'missing' WHEN err IS NOT NULL THEN 'failed' WHEN NOT jobs_ok OR complete IS NULL THEN 'malformed' ELSE 'ok' END AS outcome
  FROM customer c LEFT JOIN fetched f ON c.c_name = f.company),
k AS (SELECT s.* EXCLUDE (company, company_1), s.company AS company, CASE WHEN outcome = 'ok' AND complete AND n_jobs > 0 THEN TIMESTAMP '1999-06-01 00:00:00' WHEN h.last_success <= TIMESTAMP '1999-06-01 00:00:00' THEN h.last_success END AS good,
  CASE WHEN outcome = 'ok' THEN TIMESTAMP '1999-06-01 00:00:00' ELSE greatest(CASE WHEN h.last_fetch_ok <= TIMESTAMP '1999-06-01 00:00:00' THEN h.last_fetch_ok END,
    CASE WHEN h.last_success <= TIMESTAMP '1999-06-01 00:00:00' THEN h.last_success END) END AS fetched_ok FROM s LEFT JOIN history h ON s.company = h.company)
"""


def _clocks(spark, sf):
    companies = table(spark, sf, "customer").select(C("c_name").alias("company"))
    states = health.read_states(companies, select(spark, sf, FETCHED))
    history = select(spark, sf, HISTORY)
    now = L("1999-06-01 00:00:00").cast("timestamp_ntz")
    return health.advance_clocks(states, history.select("company", C("last_success").cast("timestamp_ntz").alias("last_success"),
                                                        C("last_fetch_ok").cast("timestamp_ntz").alias("last_fetch_ok")), now), now


@query("freshness_clocks", _CLOCKS + """
SELECT company, outcome, strftime(good, '%Y-%m-%d %H') AS last_success, strftime(fetched_ok, '%Y-%m-%d %H') AS last_fetch_ok FROM k""", fetched=FETCHED, history=HISTORY)
def freshness_clocks(spark, sf):
    clocks, _ = _clocks(spark, sf)
    return clocks.select("company", "outcome", F.date_format("last_success", "yyyy-MM-dd HH").alias("last_success"),
                         F.date_format("last_fetch_ok", "yyyy-MM-dd HH").alias("last_fetch_ok"))


@query("health_counts", _CLOCKS + """
SELECT count(*) AS companies_expected, count(*) FILTER (outcome = 'ok') AS companies_fetched_ok, count(*) FILTER (outcome = 'ok' AND complete) AS complete_boards,
  count(*) FILTER (outcome = 'ok' AND complete AND n_jobs > 0) AS verified_nonempty_boards, count(*) FILTER (outcome = 'missing') AS missing_fetches,
  count(*) FILTER (outcome IN ('failed', 'malformed')) AS failed_fetches, count(*) FILTER (outcome = 'ok' AND NOT complete) AS incomplete_boards,
  count(*) FILTER (outcome = 'ok' AND n_jobs = 0) AS zero_result_companies, count(*) FILTER (good IS NULL OR good < TIMESTAMP '1999-05-31 00:00:00') AS no_success_lately,
  count(*) FILTER (good IS NULL) AS success_history_unknown, count(*) FILTER (fetched_ok IS NULL OR fetched_ok < TIMESTAMP '1999-05-31 00:00:00') AS no_fetch_lately,
  count(*) FILTER (fetched_ok IS NULL) AS fetch_history_unknown FROM k""", fetched=FETCHED, history=HISTORY)
def health_counts(spark, sf):
    clocks, now = _clocks(spark, sf)
    return health.read_counts(clocks, now)


@query("health_lists", _CLOCKS + """
SELECT 'missing' AS list, company FROM k WHERE outcome = 'missing' UNION ALL SELECT 'failed', company FROM k WHERE outcome IN ('failed', 'malformed')
UNION ALL SELECT 'incomplete', company FROM k WHERE outcome = 'ok' AND NOT complete UNION ALL SELECT 'zero_results', company FROM k WHERE outcome = 'ok' AND n_jobs = 0
UNION ALL SELECT 'stale_success', company FROM k WHERE good < TIMESTAMP '1999-05-31 00:00:00' UNION ALL SELECT 'unknown_success', company FROM k WHERE good IS NULL
UNION ALL SELECT 'stale_fetch', company FROM k WHERE fetched_ok < TIMESTAMP '1999-05-31 00:00:00' UNION ALL SELECT 'unknown_fetch', company FROM k WHERE fetched_ok IS NULL""",
       fetched=FETCHED, history=HISTORY)
def health_lists(spark, sf):
    clocks, now = _clocks(spark, sf)
    return health.company_lists(clocks, now)


JOBS = """SELECT c_name AS company, CAST(o_orderkey % 5000 AS STRING) AS posting_id, CASE WHEN o_totalprice > 100000 THEN CAST(o_orderdate AS DATE) END AS posted,
  o_orderkey % 4 <> 0 AS has_desc, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'text' END AS desc, CONCAT('Role ', CAST(o_orderkey % 100 AS STRING)) AS title, o_orderkey AS ord
FROM orders JOIN customer ON o_custkey = c_custkey"""
_LAST = """WITH ok AS (SELECT company FROM fetched WHERE err IS NULL AND jobs_ok AND complete IS NOT NULL), j AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company, posting_id ORDER BY ord DESC) AS n FROM jobs) WHERE n = 1 AND company IN (FROM ok))"""


@query("health_listing_counts", _LAST + """
SELECT count(*) AS jobs_returned, count(*) FILTER (posted IS NULL) AS missing_posted_dates, count(*) FILTER (NOT has_desc) AS listing_description_unknown,
  count(*) FILTER (has_desc AND trim("desc") = '') AS listing_descriptions_empty FROM j""", fetched=FETCHED, jobs=JOBS.replace("AS desc,", 'AS "desc",'))
def health_listing_counts(spark, sf):
    companies = table(spark, sf, "customer").select(C("c_name").alias("company"))
    return health.listing_counts(select(spark, sf, JOBS), health.read_states(companies, select(spark, sf, FETCHED)))


@query("missing_descriptions", _LAST + """
SELECT DISTINCT company, title AS role FROM j WHERE has_desc AND trim("desc") = '' UNION SELECT c_name, 'Role x' FROM customer WHERE c_acctbal < 0""",
       fetched=FETCHED, jobs=JOBS.replace("AS desc,", 'AS "desc",'))
def missing_descriptions(spark, sf):
    cust = table(spark, sf, "customer")
    log = cust.where("c_acctbal < 0").select(C("c_name").alias("company"), L("Role x").alias("role"))
    states = health.read_states(cust.select(C("c_name").alias("company")), select(spark, sf, FETCHED))
    return health.missing_descriptions(select(spark, sf, JOBS), states, log)


@query("queue_health", """
SELECT count(*) FILTER (description_status = 'failed') AS queue_failed_descriptions, count(*) FILTER (description_status NOT IN ('ok', 'failed')) AS queue_description_status_unknown,
  count(*) FILTER (posted IS NULL) AS queue_missing_posted_dates, count(*) FILTER (alert_pending) AS pending_alerts,
  count(*) FILTER (alert_pending AND closed_on IS NULL AND state = 'new' AND alert_attempts < 3) AS eligible_pending_alerts,
  count(*) FILTER (alert_pending AND NOT (closed_on IS NULL AND state = 'new' AND alert_attempts < 3)) AS inactive_pending_alerts FROM queue""")
def queue_health(spark, sf):
    return health.queue_counts(fixture(spark, sf, "queue"))


@query("companies_without_seed", "SELECT count(*) AS companies_without_seeded_state FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def companies_without_seed(spark, sf):
    cust = table(spark, sf, "customer")
    seeded = cust.join(table(spark, sf, "orders").where("o_totalprice > 450000"), C("c_custkey") == C("o_custkey"), "left_semi").select(C("c_name").alias("company"))
    return health.unseeded_companies(cust.select(C("c_name").alias("company")), seeded)


@query("run_log_facts", """
SELECT 1 AS finished, CAST(o_orderkey % 100 AS INT) AS closed, CAST(o_custkey % 50 AS INT) AS reopened,
  (SELECT count(DISTINCT (o_custkey, o_orderpriority)) FROM orders WHERE o_orderstatus = 'F') AS failures FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey DESC LIMIT 1""")
def run_log_facts(spark, sf):
    k = C("o_orderkey")
    value = (F.when(C("o_orderstatus") == "F", F.concat(L("! c"), "o_custkey", L(" description for "), "o_orderpriority", L(": HTTP 500")))
             .when(C("o_orderstatus") == "P", F.concat(L("done: 5 companies (0 errors), 1 alerts, "), (k % 100).cast("string"), L(" closed, "),
                                                       (C("o_custkey") % 50).cast("string"), L(" reopened, 0 reposts.")))
             .otherwise("ok company: 12 jobs"))
    lines = table(spark, sf, "orders").select(k.alias("line_no"), value.alias("value"))
    failures = files.log_failures(lines).agg(F.count(L(1)).alias("failures"))
    totals = files.log_totals(lines).select(C("finished").cast("int").alias("finished"), "closed", "reopened", L(1).alias("one"))
    return totals.join(failures.withColumn("one", L(1)), "one").drop("one")


CONFIG = """SELECT CAST(c_custkey AS INT) AS ord, CASE WHEN c_custkey % 40 = 0 THEN ' ' ELSE CONCAT('Firm ', CAST(c_custkey % 1000 AS STRING)) END AS company,
  CASE c_custkey % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'workday' WHEN 2 THEN 'icims' WHEN 3 THEN 'lever' ELSE 'unknown' END AS board_type, c_custkey, c_nationkey FROM customer"""


def _config(spark, sf):
    rows = select(spark, sf, CONFIG)
    slug = F.concat(L("slug"), (C("c_custkey") % 600).cast("string"))
    k = C("c_custkey")
    endpoint = (F.when(C("board_type") == "greenhouse", F.when(k % 3 == 0, F.create_map(L("other"), L("x"))).otherwise(F.create_map(L("slug"), slug)))
                .when(C("board_type") == "lever", F.create_map(L("slug"), slug, L("region"), F.when(k % 2 == 0, "eu").otherwise("us")))
                .when(C("board_type") == "workday", F.create_map(L("host"), L("H.com."), L("tenant"), F.concat(L("T"), C("c_nationkey").cast("string"))))
                .otherwise(F.create_map(L("host"), F.concat(L("HOST"), (k % 400).cast("string")))))
    sites = F.when(C("board_type") == "workday", F.array(F.concat(L("Site"), (k % 3).cast("string")), F.when(k % 2 == 0, " ").otherwise("/Jobs/")))
    return rows.select("ord", "company", "board_type", endpoint.alias("endpoint"), sites.alias("sites"))


@query("config_problems", """
SELECT ord, company, 'missing or invalid name' AS problem FROM cfg WHERE trim(company) = ''
UNION ALL SELECT ord, company, 'missing or unsupported ats unknown' FROM cfg WHERE board_type = 'unknown'
UNION ALL SELECT ord, company, 'missing or invalid slug for greenhouse' FROM cfg WHERE board_type = 'greenhouse' AND c_custkey % 3 = 0
UNION ALL SELECT ord, company, 'missing or invalid site for workday' FROM cfg WHERE board_type = 'workday' AND c_custkey % 2 = 0""", cfg=CONFIG)
def config_problems(spark, sf):
    return validation.invalid_fields(_config(spark, sf))


@query("config_collisions", """
WITH q AS (SELECT 'firm' || c_custkey % 200 AS k, count(*) AS n FROM customer GROUP BY 1),
m AS (SELECT 'duplicate name' AS kind, 'firm' || c_custkey % 1000 AS identity, ord, company, c_custkey FROM cfg WHERE trim(company) <> ''
  UNION ALL SELECT 'shared endpoint', CASE board_type WHEN 'greenhouse' THEN 'greenhouse/slug' || c_custkey % 600 WHEN 'lever' THEN 'lever/' || CASE WHEN c_custkey % 2 = 0 THEN 'eu' ELSE 'global' END || '/slug' || c_custkey % 600
      WHEN 'icims' THEN 'icims/host' || c_custkey % 400 END, ord, company, c_custkey FROM cfg WHERE trim(company) <> '' AND board_type IN ('lever', 'icims') OR (trim(company) <> '' AND board_type = 'greenhouse' AND c_custkey % 3 <> 0)
  UNION ALL SELECT 'shared endpoint', 'workday/t' || c_nationkey || '/' || s, ord, company, c_custkey FROM cfg, (VALUES ('site'), ('jobs')) v(x), LATERAL (SELECT CASE x WHEN 'site' THEN 'site' || c_custkey % 3 ELSE 'jobs' END AS s)
    WHERE trim(company) <> '' AND board_type = 'workday' AND c_custkey % 2 <> 0),
g AS (SELECT kind, identity FROM m GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT m.*, 'firm' || c_custkey % 1000 AS nk, coalesce(q.n, 0) AS n FROM m JOIN g USING (kind, identity) LEFT JOIN q ON 'firm' || c_custkey % 1000 = q.k),
t AS (SELECT kind, identity, CAST(sum(n) AS BIGINT) AS total FROM (SELECT DISTINCT kind, identity, nk, n FROM c) GROUP BY ALL)
SELECT kind, identity, ord, company, n AS rows, total AS group_rows FROM c JOIN t USING (kind, identity)""", cfg=CONFIG)
def config_collisions(spark, sf):
    queue = table(spark, sf, "customer").select(F.concat(L("FIRM - "), (C("c_custkey") % 200).cast("string")).alias("company"))
    return validation.collisions(_config(spark, sf), queue)


_WANT = "(salary IS NULL OR salary IN ('', 'Unclear') OR o_custkey % 5 = 2)"
_GAP = f"closed_on IS NULL AND state NOT IN ('applied', 'dismissed') AND ({_WANT} OR experience IS NULL)"


def _cache(spark, sf):
    k = C("o_custkey")
    salary = F.when(k % 3 == 0, "$80,000 - $90,000").when(k % 3 == 1, "Unclear").otherwise("$95,000 - $100,000")
    return fixture(spark, sf, "queue").where(k % 7 != 0).select(
        "id", "ord", F.when(k % 11 == 0, "error").otherwise("ok").alias("status"), salary.alias("salary"), L("ev").alias("salary_evidence"),
        F.when(k % 2 == 0, 4).alias("experience"), L("xp").alias("experience_evidence"))


@query("backfill_targets", f"SELECT id FROM queue WHERE {_GAP} AND o_custkey % 7 = 0")
def backfill_targets(spark, sf):
    targets = backfill.rows_with_gaps(fixture(spark, sf, "queue"))
    return backfill.still_to_read(targets, _cache(spark, sf)).select("id")


CHANGES = f"""
SELECT id, company, 'salary' AS field, salary AS old, CASE o_custkey % 3 WHEN 0 THEN '$80,000 - $90,000' ELSE '$95,000 - $100,000' END AS new,
  CASE WHEN o_custkey % 5 = 2 THEN 'salary lower-bound->range' ELSE 'salary N/A->value' END AS kind FROM queue
WHERE {_GAP} AND o_custkey % 7 <> 0 AND o_custkey % 11 <> 0 AND {_WANT} AND o_custkey % 3 <> 1 AND (o_custkey % 5 <> 2 OR o_custkey % 3 = 0)
UNION ALL SELECT id, company, 'experience', NULL, '4', 'experience N/A->value' FROM queue WHERE {_GAP} AND o_custkey % 7 <> 0 AND o_custkey % 11 <> 0 AND experience IS NULL AND o_custkey % 2 = 0"""


@query("backfill_changes", "SELECT * FROM chg", chg=CHANGES)
def backfill_changes(spark, sf):
    return backfill.proposed_changes(backfill.rows_with_gaps(fixture(spark, sf, "queue")), _cache(spark, sf)).drop("evidence")


@query("backfill_patched", """
SELECT q.id, coalesce(s.new, q.salary) AS salary, coalesce(CAST(x.new AS INT), q.experience) AS experience FROM queue q
LEFT JOIN (SELECT * FROM chg WHERE field = 'salary') s ON q.id = s.id LEFT JOIN (SELECT * FROM chg WHERE field = 'experience') x ON q.id = x.id""", chg=CHANGES)
def backfill_patched(spark, sf):
    queue = fixture(spark, sf, "queue")
    changes = backfill.proposed_changes(backfill.rows_with_gaps(queue), _cache(spark, sf))
    return backfill.patch(queue, changes).select("id", "salary", "experience")


@query("backfill_report", """
SELECT board_type, count(*) FILTER (kind = 'salary N/A->value') AS salary_na_to_value, count(*) FILTER (kind = 'salary lower-bound->range') AS salary_lower_bound_to_range,
  count(*) FILTER (kind = 'experience N/A->value') AS experience_na_to_value FROM chg JOIN boards ON chg.company = boards.company GROUP BY board_type""", chg=CHANGES)
def backfill_report(spark, sf):
    changes = backfill.proposed_changes(backfill.rows_with_gaps(fixture(spark, sf, "queue")), _cache(spark, sf))
    return backfill.change_report(changes, fixture(spark, sf, "boards").select("company", "board_type"))


@query("sponsorship_reread", """
WITH n AS (SELECT *, CASE o_custkey % 3 WHEN 0 THEN 'Blocked' WHEN 1 THEN 'Unclear' ELSE 'OPT Only' END AS s FROM queue),
f AS (SELECT *, sponsorship_status = 'Blocked' AND s <> 'Blocked' AND s <> 'Unclear' AS flip FROM n)
SELECT id, CASE WHEN flip THEN s ELSE sponsorship_status END AS sponsorship_status,
  CASE WHEN flip AND state IN ('new', 'auto_blocked', 'opt_only') THEN 'opt_only' ELSE state END AS state, CAST(flip AS INT) AS flipped FROM f""")
def sponsorship_reread(spark, sf):
    queue = fixture(spark, sf, "queue")
    k = C("o_custkey") % 3
    reread = queue.select("id", F.when(k == 0, "Blocked").when(k == 1, "Unclear").otherwise("OPT Only").alias("new_status"), L("again").alias("new_evidence"))
    return backfill.reclassify(queue, reread, "Blocked").select("id", "sponsorship_status", "state", C("flipped").cast("int").alias("flipped"))


@query("floor_dates_repaired", """
SELECT id, CAST(CASE WHEN company IN ('1-URGENT', '3-MEDIUM') AND coalesce(first_seen - posted IN (29, 30), FALSE) THEN CASE WHEN o_totalprice > 200000 THEN first_seen END ELSE posted END AS STRING) AS posted,
  CASE WHEN company IN ('1-URGENT', '3-MEDIUM') AND coalesce(first_seen - posted IN (29, 30), FALSE) AND o_totalprice > 200000 THEN 'exact' ELSE posted_source END AS posted_source FROM queue""")
def floor_dates_repaired(spark, sf):
    queue = fixture(spark, sf, "queue")
    details = queue.where("o_totalprice > 200000").select("id", C("first_seen").alias("detail_posted"), L("exact").alias("detail_source"))
    out = backfill.repair_floor_dates(queue, fixture(spark, sf, "boards").select("company", "board_type"), details)
    return out.select("id", C("posted").cast("string").alias("posted"), "posted_source")


@query("names_to_probe", f"""
SELECT c_name AS name, c_custkey AS ord FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING' AND NOT (c_custkey % 3 = 0 AND c_custkey % 60 < 30)""")
def names_to_probe(spark, sf):
    cust = table(spark, sf, "customer")
    names = cust.where("c_acctbal > 0").select(C("c_name").alias("name"), C("c_custkey").alias("ord"))
    tried = cust.where("c_custkey % 3 = 0").select(C("c_name").alias("name"), F.date_sub(as_of(), (C("c_custkey") % 60).cast("int")).alias("tried_on"))
    polled = cust.where("c_mktsegment = 'BUILDING'").select(F.upper("c_name").alias("company"))
    return backfill.names_to_probe(names.unionByName(names), polled, tried, as_of())


@query("candidate_counts", "SELECT p_brand AS company, count(*) AS n, min(p_partkey) AS ord FROM part GROUP BY p_brand")
def candidate_counts(spark, sf):
    return backfill.candidate_counts(table(spark, sf, "part").select(C("p_brand").alias("company"), C("p_partkey").alias("ord")))


@query("description_read_success", """
SELECT board_type, count(*) FILTER (n >= 120) AS ok, count(*) AS tried FROM (SELECT source AS board_type, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 20 GROUP BY 1""")
def description_read_success(spark, sf):
    rows = table(spark, sf, "documents").select(C("source").alias("board_type"), C("doc_id").alias("ord"), C("text").alias("description"))
    return backfill.read_success(rows, 20)


@query("shard_results", """
WITH r AS (SELECT c_custkey, 'c' || c_custkey % 1000 AS company, c_custkey % 7 AS shard, c_nationkey % 3 AS jobs FROM customer),
g AS (SELECT company, arg_max(jobs, shard) AS n, count(DISTINCT jobs) > 1 AS conflict FROM r GROUP BY company)
SELECT 'c' || a.k AS company, CASE WHEN g.company IS NULL THEN 'shard result missing' WHEN conflict THEN 'conflicting shard results' END AS err,
  CASE WHEN g.company IS NOT NULL AND NOT conflict THEN g.n ELSE -1 END AS n_jobs FROM (SELECT DISTINCT c_custkey % 1010 AS k FROM customer) a LEFT JOIN g ON 'c' || a.k = g.company""")
def shard_results(spark, sf):
    cust = table(spark, sf, "customer")
    count = C("c_nationkey") % 3
    row = F.struct(F.transform(F.slice(F.array(L(1), L(2), L(3)), L(1), count), lambda i: F.struct(i.cast("string").alias("id"))).alias("jobs"),
                   L(True).alias("complete"), L(None).cast("string").alias("err"), L(1.5).alias("secs"))
    lines = cust.select((C("c_custkey") % 7).alias("shard"), F.concat(L("c"), (C("c_custkey") % 1000).cast("string")).alias("company"), F.to_json(row).alias("json"))
    # shard files are written by the fetchers, one object per file; here each small file holds one company
    path = run_folder(spark, "shards")
    lines.select(F.concat(L('{"'), "company", L('":'), "json", L("}")).alias("value"), "shard").repartition(4).write.partitionBy("shard").text(path)
    rows, _ = shards.read_shards(spark, path, layout="lines")
    companies = cust.select(F.concat(L("c"), (C("c_custkey") % 1010).cast("string")).alias("company"))
    return shards.result_facts(shards.for_companies(companies, shards.merge_checked(rows))).select("company", "err", "n_jobs")


@query("public_queue", "SELECT state, count(*) AS n FROM queue WHERE state IN ('new', 'opt_only', 'auto_blocked') GROUP BY state")
def public_queue(spark, sf):
    return public_rows(fixture(spark, sf, "queue")).groupBy("state").agg(F.count(L(1)).alias("n"))
