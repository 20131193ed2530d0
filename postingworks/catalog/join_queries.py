"""Queries over identity matching, deduplication and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from postingworks.catalog.fixtures import AS_OF, fixture, select, table
from postingworks.catalog.registry import query
from postingworks.operators import dedup, identity, intake

C, L = F.col, F.lit
_KEY = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"

TRACKER = """SELECT CONCAT('t', CAST(o_orderkey AS STRING)) AS key, o_orderkey AS ord, o_orderpriority AS company,
  CONCAT('Analyst ', CAST(o_custkey % 40 AS STRING), ' R', CAST(10000 + o_orderkey - o_orderkey % 3 AS STRING)) AS role,
  CASE WHEN o_custkey % 9 = 1 THEN 'Boston' ELSE 'New York, NY' END AS location,
  CASE WHEN o_totalprice < 200000 THEN NULL ELSE CONCAT('http://X.example.com/job/', CAST(o_orderkey - o_orderkey % 2 AS STRING), '?utm_source=t') END AS link,
  CASE o_orderstatus WHEN 'F' THEN 'Applied' WHEN 'O' THEN 'Interview' ELSE 'Saved' END AS status FROM orders"""
_MATCH = f"""
WITH keyed AS (SELECT key, ord, status, CASE WHEN link IS NULL THEN NULL ELSE regexp_replace(regexp_replace(lower(link), '^https?://', ''), '[?]utm_source=t$', '') END AS l,
    {_KEY.format("company || role || location")} AS m FROM tracker WHERE {{where}}),
by_link AS (SELECT l, arg_max(key, ord) AS k FROM keyed WHERE l IS NOT NULL GROUP BY l),
by_meta AS (SELECT m, arg_max(key, ord) AS k FROM keyed WHERE l IS NULL GROUP BY m),
cand AS (SELECT id, o_custkey, regexp_replace(regexp_replace(lower(link), '^https?://', ''), '/$', '') AS l, {_KEY.format("company || role || location")} AS m FROM queue)
"""


@query("identity_match", _MATCH.format(where="TRUE") + """
SELECT c.id, coalesce(a.k, b.k) AS match_key FROM cand c LEFT JOIN by_link a ON c.l = a.l LEFT JOIN by_meta b ON c.m = b.m""", tracker=TRACKER)
def identity_match(spark, sf):
    return identity.match_identity(fixture(spark, sf, "queue"), select(spark, sf, TRACKER)).select("id", "match_key")


@query("not_yet_applied", _MATCH.format(where="status IN ('Applied', 'Interview')") + """
SELECT c.id FROM cand c LEFT JOIN by_link a ON c.l = a.l LEFT JOIN by_meta b ON c.m = b.m WHERE coalesce(a.k, b.k) IS NULL""", tracker=TRACKER)
def not_yet_applied(spark, sf):
    return identity.not_yet_applied(fixture(spark, sf, "queue"), select(spark, sf, TRACKER)).select("id")


@query("linkless_identity", """
SELECT q.id, t.k AS match_key FROM (SELECT id, company, role, location FROM queue) q LEFT JOIN (
  SELECT company, regexp_replace(lower(role), '[^a-z0-9]', '', 'g') AS r, regexp_replace(lower(location), '[^a-z0-9]', '', 'g') AS l, arg_max(key, ord) AS k
  FROM tracker GROUP BY 1, 2, 3) t ON q.company = t.company AND regexp_replace(lower(q.role), '[^a-z0-9]', '', 'g') = t.r
  AND regexp_replace(lower(q.location), '[^a-z0-9]', '', 'g') = t.l""", tracker=TRACKER)
def linkless_identity(spark, sf):
    candidates = fixture(spark, sf, "queue").withColumn("link", L(None).cast("string"))
    return identity.match_identity(candidates, select(spark, sf, TRACKER)).select("id", "match_key")


@query("untracked_cards", """
SELECT p_partkey FROM part WHERE p_brand || '|' || p_name NOT IN (SELECT p_brand || '|' || p_name FROM part WHERE p_retailprice < 915)""")
def untracked_cards(spark, sf):
    cards = table(spark, sf, "part").select("p_partkey", F.upper("p_brand").alias("company"), F.concat(C("p_name"), L("!")).alias("title"))
    known = table(spark, sf, "part").where("p_retailprice < 915").select(C("p_brand").alias("company"), C("p_name").alias("title"))
    return identity.untracked(cards, known).select("p_partkey")


@query("employer_coverage", f"""
WITH b AS (SELECT DISTINCT {_KEY.format("p_name")} AS k FROM part), n AS (SELECT p_partkey, {_KEY.format("p_name || CASE WHEN p_size % 2 = 0 THEN ' ltd' ELSE '' END")} AS k FROM part
  UNION ALL SELECT -1 - c_custkey, {_KEY.format("left(c_name, CAST(1 + c_custkey % 9 AS INT))")} FROM customer)
SELECT p_partkey AS key, CAST(EXISTS (SELECT 1 FROM b WHERE n.k = b.k OR (length(b.k) > 4 AND (starts_with(n.k, b.k) OR starts_with(b.k, n.k)))) AS INT) AS has_board FROM n""")
def employer_coverage(spark, sf):
    boards = table(spark, sf, "part").select(C("p_name").alias("company")).distinct()
    names = table(spark, sf, "part").select(C("p_partkey").alias("key"), F.concat("p_name", F.when(C("p_size") % 2 == 0, " ltd").otherwise("")).alias("company"))
    short = table(spark, sf, "customer").select((-1 - C("c_custkey")).alias("key"), F.substring("c_name", L(1), (1 + C("c_custkey") % 9).cast("int")).alias("company"))
    return identity.mark_covered(names.unionByName(short), boards).select("key", C("has_board").cast("int").alias("has_board"))


# every customer is an alias group with two others' names, so groups hang on one another; a group sees what lies before it
ALIASES = """SELECT a.c_custkey AS group_no, b.c_name AS name FROM customer a JOIN customer b
  ON b.c_custkey IN (a.c_custkey, (a.c_custkey * 37 + 11) % 1499, (a.c_custkey * 7 + 3) % 997)"""
_COVERED = """
polled AS (SELECT DISTINCT regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS k FROM customer WHERE c_acctbal > 9500),
groups AS (SELECT DISTINCT group_no AS g, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM aliases),
cov AS (SELECT k, CAST(-1 AS BIGINT) AS since FROM polled
  UNION SELECT m.k, m.g FROM cov JOIN groups t ON t.k = cov.k AND cov.since < t.g JOIN groups m ON m.g = t.g),"""


def _aliases(spark, sf):
    """The rows of `ALIASES` by equal keys: a list of keys as a join condition would pair all customers with all."""
    cust, k = table(spark, sf, "customer"), C("c_custkey")
    wanted = cust.select(k.alias("group_no"), F.explode(F.array_distinct(F.array(k, (k * 37 + 11) % 1499, (k * 7 + 3) % 997))).alias("c_custkey"))
    return wanted.join(cust.select("c_custkey", C("c_name").alias("name")), "c_custkey").select("group_no", "name")


@query("alias_closure", f"WITH RECURSIVE {_COVERED[1:-1]} SELECT DISTINCT k AS key FROM cov", aliases=ALIASES)
def alias_closure(spark, sf):
    polled = table(spark, sf, "customer").where("c_acctbal > 9500").select(C("c_name").alias("name"))
    return identity.covered_keys(polled, _aliases(spark, sf))


@query("uncovered_employers", f"""
WITH RECURSIVE {_COVERED[1:]}
old AS (SELECT c_name AS name, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS k FROM customer WHERE c_mktsegment = 'BUILDING'),
ans AS (SELECT s_name AS name, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS k FROM supplier WHERE s_acctbal > 0)
SELECT name, CASE WHEN k IN (SELECT k FROM cov) THEN 'dropped' ELSE 'kept' END AS change FROM old
UNION ALL SELECT name, 'added' FROM ans WHERE k NOT IN (SELECT k FROM cov) AND k NOT IN (SELECT k FROM old)""", aliases=ALIASES)
def uncovered_employers(spark, sf):
    cust, supp = table(spark, sf, "customer"), table(spark, sf, "supplier")
    covered = identity.covered_keys(cust.where("c_acctbal > 9500").select(C("c_name").alias("name")), _aliases(spark, sf))
    old = cust.where("c_mktsegment = 'BUILDING'").select(C("c_name").alias("name"), L("r").alias("reason"), L(None).cast("string").alias("url"))
    answers = supp.select(F.concat("s_name", L(" | note")).alias("company"), F.when(C("s_acctbal") > 0, None).otherwise("found").alias("adapter"),
                          L("").alias("evidence_url"), C("s_suppkey").alias("ord"))
    return identity.update_uncovered(old, answers, covered, "no readable board").select("name", "change")


CARDS = """SELECT o_orderpriority AS company, CONCAT('Analyst ', CAST(o_custkey % 200 AS STRING)) AS title,
  CASE o_orderkey % 4 WHEN 0 THEN 'New York, NY' WHEN 1 THEN 'York' WHEN 2 THEN '' ELSE 'Boston' END AS location,
  CAST('1999-01-01' AS DATE) + CAST(o_custkey % 200 + CASE WHEN o_totalprice > 480000 THEN 1 ELSE 0 END AS INT) AS date FROM orders"""
ENTRIES = """SELECT o_orderkey AS id, o_orderpriority AS company, CONCAT('Analyst ', CAST(o_custkey % 200 AS STRING)) AS role,
  CASE o_orderkey % 5 WHEN 0 THEN 'New York, NY' WHEN 1 THEN 'Boston, MA' WHEN 2 THEN '' WHEN 3 THEN 'Chicago' ELSE 'New York, NY, USA' END AS location FROM orders"""


@query("unanimous_card_dates", f"""
WITH e AS (SELECT *, {_KEY.format("location")} AS a, {_KEY.format("split_part(location, ',', 1)")} AS f FROM entries),
c AS (SELECT DISTINCT company, title, {_KEY.format("location")} AS b, date FROM cards),
p AS (SELECT DISTINCT company, role, a, f FROM e),
v AS (SELECT p.company, p.role, p.a, p.f, count(DISTINCT c.date) AS n, min(c.date) AS d FROM p JOIN c ON p.company = c.company AND p.role = c.title
  AND (p.a = '' OR c.b = '' OR contains(c.b, p.a) OR contains(p.a, c.b) OR contains(c.b, p.f)) GROUP BY 1, 2, 3, 4)
SELECT e.id, CAST(CASE WHEN v.n = 1 THEN v.d END AS STRING) AS card_date FROM e LEFT JOIN v ON e.company = v.company AND e.role = v.role AND e.a = v.a AND e.f = v.f""",
       cards=CARDS, entries=ENTRIES)
def unanimous_card_dates(spark, sf):
    out = identity.unanimous_dates(select(spark, sf, ENTRIES), select(spark, sf, CARDS))
    return out.select("id", C("card_date").cast("string").alias("card_date"))


@query("boards_already_polled", """
WITH b AS (SELECT p_type AS board_type, p_name AS endpoint, arg_min(p_brand, p_partkey) AS polled_as FROM part WHERE p_size < 25 GROUP BY 1, 2)
SELECT p_partkey, polled_as FROM part LEFT JOIN b ON p_type = board_type AND p_name = endpoint""")
def boards_already_polled(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", C("p_type").alias("board_type"), C("p_name").alias("endpoint"), C("p_brand").alias("company"), "p_size")
    return identity.already_polled(part, part.where("p_size < 25").withColumn("ord", C("p_partkey"))).select("p_partkey", "polled_as")


@query("dates_from_listing", """
SELECT q.id, CAST(coalesce(l.posted, q.posted) AS STRING) AS posted FROM queue q LEFT JOIN listing l ON q.company = l.company AND q.posting_id = l.posting_id""")
def dates_from_listing(spark, sf):
    out = identity.dates_from_listing(fixture(spark, sf, "queue"), fixture(spark, sf, "listing"))
    return out.select("id", C("posted").cast("string").alias("posted"))


@query("posts_with_dates", """
SELECT o_orderkey, CAST(d.posted AS STRING) AS posted FROM orders LEFT JOIN (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS posted FROM lineitem GROUP BY 1) d ON o_orderkey = l_orderkey""")
def posts_with_dates(spark, sf):
    posts = table(spark, sf, "orders").select("o_orderkey", L("b").alias("company"), C("o_orderkey").cast("string").alias("posting_id"))
    day = C("l_shipdate").cast("date")
    dates = table(spark, sf, "lineitem").select(L("b").alias("company"), C("l_orderkey").cast("string").alias("posting_id"), day.alias("opened_at"), day.alias("ord"))
    return identity.posts_with_dates(posts, dates).select("o_orderkey", C("posted").cast("string").alias("posted"))


@query("first_sighting_wins", """
SELECT company, posting_id, min(ord) AS ord FROM sightings GROUP BY 1, 2""")
def first_sighting_wins(spark, sf):
    rows = fixture(spark, sf, "sightings").select("company", "posting_id", "run_date", "ord")
    return dedup.first_wins(rows, ("ord",)).select("company", "posting_id", "ord")


@query("last_row_wins", """
SELECT company, posting_id, arg_max(secs, ord) AS secs, min(ord) AS ord FROM sightings GROUP BY 1, 2""")
def last_row_wins(spark, sf):
    return dedup.last_wins(fixture(spark, sf, "sightings").select("company", "posting_id", "secs", "ord"))


@query("merged_passes", """
SELECT company, posting_id, coalesce(min(CASE WHEN day(run_date) <= 10 THEN ord END), min(ord)) AS ord FROM sightings GROUP BY 1, 2""")
def merged_passes(spark, sf):
    rows = fixture(spark, sf, "sightings").withColumn("early", F.dayofmonth("run_date") <= 10).select("company", "posting_id", "ord", "early")
    return dedup.merge_passes(rows.where("early").drop("early"), rows.where("not early").drop("early"))


@query("seen_after_run", """
SELECT company, posting_id FROM sightings GROUP BY 1, 2""")
def seen_after_run(spark, sf):
    rows = fixture(spark, sf, "sightings")
    old, new = rows.where(F.dayofmonth("run_date") <= 20), rows.where(F.dayofmonth("run_date") > 15)
    return dedup.grow_seen(old, old, new)[0]


@query("seeded_after_run", "SELECT company FROM sightings GROUP BY 1")
def seeded_after_run(spark, sf):
    rows = fixture(spark, sf, "sightings")
    return dedup.grow_seen(rows.where("1 = 0"), rows.where("1 = 0"), rows)[1]


@query("companies_not_fetched", "SELECT c_name AS company FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def companies_not_fetched(spark, sf):
    cust = table(spark, sf, "customer")
    read = cust.join(table(spark, sf, "orders").where("o_totalprice > 450000"), C("c_custkey") == C("o_custkey"), "left_semi")
    return dedup.missing_companies(cust.select(C("c_name").alias("company")), read.select(C("c_name").alias("company")))


@query("terms_in_both_lists", "SELECT DISTINCT p_name AS term FROM part WHERE p_size < 3 AND p_name IN (SELECT p_name FROM part WHERE p_size > 48)")
def terms_in_both_lists(spark, sf):
    part = table(spark, sf, "part").select(C("p_name").alias("term"), "p_size")
    return dedup.terms_in_both(part.where("p_size < 3").select("term"), part.where("p_size > 48").select("term"))


SEEN = "SELECT o_orderpriority AS company, CAST(o_orderkey AS STRING) AS posting_id FROM orders WHERE o_totalprice > 100000 AND o_orderpriority <> '1-URGENT'"


@query("fresh_postings", """
SELECT l.company, l.posting_id, CAST(l.company = '1-URGENT' AS INT) AS first_run FROM listing l
LEFT JOIN seen s ON l.company = s.company AND l.posting_id = s.posting_id
WHERE (l.company = '1-URGENT' OR s.posting_id IS NULL) AND l.company || ':' || l.posting_id NOT IN (SELECT id FROM queue WHERE o_custkey % 3 = 0)""", seen=SEEN)
def fresh_postings(spark, sf):
    seen = select(spark, sf, SEEN)
    queue = fixture(spark, sf, "queue").where("o_custkey % 3 = 0")
    out = intake.fresh_postings(fixture(spark, sf, "listing"), seen, seen.select("company").distinct(), queue)
    return out.select("company", "posting_id", C("first_run").cast("int").alias("first_run"))


_FP = """regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')"""


@query("repost_pairs", f"""
WITH f AS (SELECT company, posting_id, row_number() OVER (PARTITION BY company, fp ORDER BY ord) AS r, fp FROM (
    SELECT company, posting_id, ord, 'analyst ' || o_custkey % 40 || '|' || trim({_FP.format("location")}) AS fp FROM queue WHERE first_seen >= DATE '{AS_OF}')),
p AS (SELECT company, id, row_number() OVER (PARTITION BY company, fp ORDER BY first_seen DESC, ord) AS r, fp FROM (
    SELECT q.company, q.id, q.first_seen, q.ord, 'analyst ' || o_custkey % 40 || '|' || trim({_FP.format("location")}) AS fp FROM queue q
    LEFT JOIN listing l ON q.company = l.company AND q.posting_id = l.posting_id
    WHERE l.posting_id IS NULL AND q.first_seen < DATE '{AS_OF}' AND coalesce(closed_on, last_seen_live, first_seen) >= DATE '{AS_OF}' - 270))
SELECT f.company, f.posting_id, p.id AS prior_id FROM f JOIN p ON f.company = p.company AND f.fp = p.fp AND f.r = p.r""")
def repost_pairs(spark, sf):
    queue = fixture(spark, sf, "queue")
    day = L(AS_OF).cast("date")
    fresh = queue.where(C("first_seen") >= day).select("company", "posting_id", C("role").alias("title"), "location", "ord")
    return intake.repost_sources(fresh, queue.where(C("first_seen") < day), fixture(spark, sf, "listing"), day)
