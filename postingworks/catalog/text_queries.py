"""Queries over the string, URL, HTML and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from postingworks.catalog.fixtures import AS_OF, fixture, table, wide_table
from postingworks.catalog.registry import query
from postingworks.functions import dates as dt
from postingworks.functions import terms as tm
from postingworks.functions import text as tx
from postingworks.functions.spans import spans
from postingworks.operators import dictionary
from postingworks.sources.html_boards import page_links

C, L = F.col, F.lit
_UNESCAPE = "replace(replace(replace(replace({0}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"


def _plain(expr: str) -> str:
    twice = _UNESCAPE.format(_UNESCAPE.format(expr))
    return f"trim(regexp_replace(regexp_replace({twice}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("strip_html", f"SELECT page_id, md5({_plain('html')}) AS digest, length({_plain('html')}) AS chars FROM pages")
def strip_html(spark, sf):
    plain = wide_table(spark, sf, "pages").select("page_id", tx.strip_html(C("html")).alias("plain"))
    return plain.select("page_id", F.md5("plain").alias("digest"), F.length("plain").cast("bigint").alias("chars"))


_DROPPED = "html"
for _tag in ("script", "style", "nav", "header", "footer", "form"):
    _DROPPED = f"regexp_replace({_DROPPED}, '(?is)<{_tag}\\b.*?</{_tag}>', ' ', 'g')"


@query("visible_page_text", f"SELECT page_id, md5({_plain(_DROPPED)}) AS digest FROM pages")
def visible_page_text(spark, sf):
    return wide_table(spark, sf, "pages").select("page_id", F.md5(tx.strip_html(tx.drop_blocks(C("html")))).alias("digest"))


@query("fold_accents", "SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents")
def fold_accents(spark, sf):
    return wide_table(spark, sf, "documents").select("doc_id", F.md5(tx.fold_accents(C("text"))).alias("digest"))


@query("name_keys", """
SELECT c_custkey, regexp_replace(lower(c_name || ' & Co, ' || c_mktsegment), '[^a-z0-9]', '', 'g') AS plain_key,
  regexp_replace(lower(c_name || ' & Co, ' || c_mktsegment), '[^a-z0-9]', '', 'g') AS unicode_key FROM customer""")
def name_keys(spark, sf):
    name = F.concat(C("c_name"), L(" & Co, "), C("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", tx.alnum_key(name).alias("plain_key"),
                                               tx.unicode_name_key(name).alias("unicode_key"))


@query("link_identity", """
WITH u AS (SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), 'utm_source=[^&]*&?', '') AS s FROM pages)
SELECT page_id, regexp_replace(regexp_replace(s, '[?]$', ''), '/+$', '') AS link FROM u""")
def link_identity(spark, sf):
    return wide_table(spark, sf, "pages").select("page_id", tx.normalize_link(C("url")).alias("link"))


@query("pages_by_link", """
WITH u AS (SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), 'utm_source=[^&]*&?', '') AS s FROM pages)
SELECT regexp_replace(regexp_replace(s, '[?]$', ''), '/+$', '') AS link, count(*) AS pages, min(page_id) AS first_page FROM u GROUP BY 1""")
def pages_by_link(spark, sf):
    links = wide_table(spark, sf, "pages").select("page_id", tx.normalize_link(C("url")).alias("link"))
    return links.groupBy("link").agg(F.count(L(1)).alias("pages"), F.min("page_id").alias("first_page"))


@query("role_fingerprint", """
SELECT p_partkey, p_name || ' ' || lower(p_type) || '|' || 'new york ny' AS fp FROM part""")
def role_fingerprint(spark, sf):
    title = F.concat(C("p_name"), L(" ("), C("p_type"), L(") R"), (C("p_partkey") + 10000).cast("string"), L("-2"))
    return table(spark, sf, "part").select("p_partkey", tx.role_fingerprint(title, L("New York, NY")).alias("fp"))


@query("effective_location", """
SELECT p_partkey, CASE WHEN p_size < 20 THEN 'Boston' WHEN p_size < 35 THEN 'Kronberg Office' ELSE p_brand || ' (East)' END AS place FROM part""")
def effective_location(spark, sf):
    place = F.when(C("p_size") < 20, "Boston").otherwise(" ")
    link = F.when(C("p_size") < 35, "https://x.myworkdayjobs.com/site/job/Kronberg---Office/a_R1").otherwise("https://x.com/1")
    title = F.concat(C("p_name"), L(" ("), C("p_brand"), L(" (East))"))
    return table(spark, sf, "part").select("p_partkey", tx.effective_location(place, link, title).alias("place"))


@query("location_shapes", """
SELECT c_custkey,
  CASE WHEN c_acctbal > 0 THEN n_name || ', ' || c_mktsegment || ' | Remote' ELSE n_name || ', ' || c_mktsegment END AS composed,
  n_name || '; ' || c_mktsegment AS sites, 'City ' || n_name || ', NY, US' AS reversed,
  CASE WHEN c_custkey % 2 = 0 THEN '3 Locations (New York)' ELSE n_name END AS multi_site, n_name AS title_part, c_mktsegment AS place_part
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def location_shapes(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), C("c_nationkey") == C("n_nationkey"))
    n, m = C("n_name"), C("c_mktsegment")
    multi = F.when(C("c_custkey") % 2 == 0, "3 Locations").otherwise(n)
    split = tx.split_title_place(F.concat(n, L(" ("), m, L(")")))
    return rows.select(
        "c_custkey", tx.with_remote(tx.join_location(n, L(""), L(None).cast("string"), m), C("c_acctbal") > 0).alias("composed"),
        tx.distinct_sites(F.array(n, L(" "), F.concat(m, L(" ")), n)).alias("sites"),
        tx.country_first_location(F.concat(L("US-NY-City "), n)).alias("reversed"),
        tx.multi_site_location(multi, L("/job/New-York/a_1")).alias("multi_site"),
        split["title"].alias("title_part"), split["place"].alias("place_part"))


_WORDS = ("the", "and", "le", "und", "zzz")


@query("keyword_hits", "SELECT doc_id, concat_ws(',', " + ", ".join(
    f"CASE WHEN regexp_matches(lower(source || ' ' || text), '(^|[^a-z]){w}([^a-z]|$)') THEN '{w}' END" for w in _WORDS)
    + ") AS hits FROM documents")
def keyword_hits(spark, sf):
    hits = tx.keyword_hits(C("source"), C("text"), _WORDS)
    return wide_table(spark, sf, "documents").select("doc_id", F.array_join(hits, ",").alias("hits"))


@query("term_variants", """
WITH t AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'Value at Risk' WHEN 1 THEN 'alm' ELSE p_name END AS term FROM part)
SELECT term, term AS variant FROM t UNION SELECT term, 'var' FROM t WHERE term = 'Value at Risk'
UNION SELECT term, 'asset liability management' FROM t WHERE term = 'alm' UNION SELECT term, 'asset-liability management' FROM t WHERE term = 'alm'""")
def term_variants(spark, sf):
    term = F.when(C("p_size") % 4 == 0, "Value at Risk").when(C("p_size") % 4 == 1, "alm").otherwise(C("p_name"))
    return tm.expand_table(table(spark, sf, "part").select(term.alias("term")).distinct(), tm.alias_table(spark))


@query("append_term", """
SELECT p_partkey, CASE WHEN p_name LIKE '%widget' THEN replace(p_name, ' ', ',') ELSE replace(p_name, ' ', ',') || ',widget' END AS terms FROM part""")
def append_term(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(tx.append_term(F.split("p_name", " "), "Widget"), ",").alias("terms"))


@query("slug_guesses", """
SELECT p_partkey, replace(p_name, ' ', '') || ',' || replace(p_name, ' ', '-') || ',the' || replace(p_name, ' ', '') || 'group,the-'
  || replace(p_name, ' ', '-') || '-group' AS slugs FROM part""")
def slug_guesses(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(tx.slug_guesses(F.concat(L("The "), C("p_name"), L(", Group"))), ",").alias("slugs"))


@query("board_links", """
SELECT page_id, 'greenhouse' AS board_type, 'co' || page_id AS board_key FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'workday', 'acme.wd5.myworkdayjobs.com|Careers' FROM pages WHERE page_id % 3 = 1
UNION ALL SELECT page_id, 'icims', 'careers-' || page_id || '.icims.com' FROM pages WHERE page_id % 3 = 2""")
def board_links(spark, sf):
    k = C("page_id") % 3
    extra = (F.when(k == 0, F.concat(L('<a href="https://boards.greenhouse.io/co'), C("page_id"), L('/jobs"><a href="https://jobs.lever.co/embed">')))
             .when(k == 1, '<a href="https://acme.wd5.myworkdayjobs.com/en-US/Careers/job/1">')
             .otherwise(F.concat(L('<a href="https://careers-'), C("page_id"), L('.icims.com/x"><img src="https://static1.icims.com">'))))
    return page_links(wide_table(spark, sf, "pages").select("page_id", F.concat("html", extra).alias("html")))


@query("filters_signature", "SELECT p_partkey, substr(sha1('{\"title_exclude\": [\"' || p_name || '\"]}'), 1, 16) AS sig FROM part")
def filters_signature(spark, sf):
    rules = F.concat(L('{"title_exclude": ["'), C("p_name"), L('"]}'))
    return table(spark, sf, "part").select("p_partkey", tx.filters_signature(rules).alias("sig"))


@query("posted_label", f"""
SELECT id, CASE WHEN posted IS NULL THEN 'seen ' || substr(CAST(first_seen AS STRING), 6)
  ELSE CASE WHEN posted_source = 'approx' THEN '~' ELSE '' END || CASE WHEN posted = DATE '{AS_OF}' THEN 'today' ELSE CAST(posted AS STRING) END END AS label
FROM queue""")
def posted_label(spark, sf):
    return fixture(spark, sf, "queue").select("id", tx.posted_label(C("posted"), C("posted_source"), C("first_seen"), L(AS_OF).cast("date")).alias("label"))


@query("match_spans", """
SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS BIGINT) AS n, CAST(strpos(text, regexp_extract(text, '[A-Z][a-z]+')) - 1 AS BIGINT) AS first_start,
  CAST(list_sum(list_transform(regexp_extract_all(text, '[A-Z][a-z]+'), lambda m: length(m))) AS BIGINT) AS matched FROM documents
WHERE regexp_matches(text, '[A-Z][a-z]+')""")
def match_spans(spark, sf):
    found = wide_table(spark, sf, "documents").select("doc_id", "text", spans(C("text"), "[A-Z][a-z]+", flags="").alias("s")).where(F.size("s") > 0)
    inside = F.forall("s", lambda x: F.substring(C("text"), x["start"] + 1, x["end"] - x["start"]) == x["match"])
    return found.where(inside).select("doc_id", F.size("s").cast("bigint").alias("n"), C("s")[0]["start"].cast("bigint").alias("first_start"),
                                      F.aggregate("s", L(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"]).alias("matched"))


_DAY = f"DATE '{AS_OF}'"


@query("relative_dates", f"""
SELECT o_orderkey,
  CAST(CASE WHEN o_custkey % 4 = 0 THEN {_DAY} WHEN o_custkey % 4 = 1 THEN {_DAY} - 1 WHEN o_custkey % 4 = 2 THEN {_DAY} - CAST(o_custkey % 29 AS INT) END AS STRING) AS posted_text,
  CAST({_DAY} - CAST(CASE o_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 7 WHEN 3 THEN 30 ELSE 365 END * (1 + o_custkey % 3) AS INT) AS STRING) AS age_text
FROM orders""")
def relative_dates(spark, sf):
    k = C("o_custkey")
    posted = (F.when(k % 4 == 0, "Posted Today").when(k % 4 == 1, "Posted Yesterday")
              .when(k % 4 == 2, F.concat(L("Posted "), (k % 29).cast("string"), L(" Days Ago"))).otherwise("Posted 30+ Days Ago"))
    unit = F.element_at(F.array(*[L(u) for u in ("hours", "days", "weeks", "month", "year")]), (k % 5 + 1).cast("int"))
    age = F.concat(L("about "), (1 + k % 3).cast("string"), L(" "), unit, L(" ago"))
    day = L(AS_OF).cast("date")
    return table(spark, sf, "orders").select("o_orderkey", dt.posted_text_date(posted, day).cast("string").alias("posted_text"),
                                             dt.age_text_date(age, day).cast("string").alias("age_text"))


@query("written_dates", f"""
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS iso, CAST(CAST(o_orderdate AS DATE) AS STRING) AS weekday_year,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS page, CAST(CAST(o_orderdate AS DATE) AS STRING) AS feed, CAST(CAST(o_orderdate AS DATE) AS STRING) AS epoch_ms,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS us, CAST(CAST(o_orderdate AS DATE) AS STRING) AS dotted, CAST(CAST(o_orderdate AS DATE) AS STRING) AS dashed
FROM orders WHERE year(o_orderdate) >= 2000
UNION ALL SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING), NULL, CAST(CAST(o_orderdate AS DATE) AS STRING), CAST(CAST(o_orderdate AS DATE) AS STRING),
  CAST(CAST(o_orderdate AS DATE) AS STRING), CAST(CAST(o_orderdate AS DATE) AS STRING), CAST(CAST(o_orderdate AS DATE) AS STRING), CAST(CAST(o_orderdate AS DATE) AS STRING)
FROM orders WHERE year(o_orderdate) < 2000""")
def written_dates(spark, sf):
    d = C("o_orderdate")
    weekday = F.when(F.year(d) >= 2000, F.date_format(d, "E MMM dd '00:00:00 EST' yyyy")).otherwise("no date")
    out = {
        "iso": dt.iso_date(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")),
        "weekday_year": dt.loose_posted_date(weekday, L(AS_OF).cast("date")),
        "page": dt.page_date(F.concat(L('{"datePosted" : "'), F.date_format(d, "MMM d, yyyy"), L('"}'))),
        "feed": dt.rfc822_date(F.date_format(d, "E, dd MMM yyyy '23:30:00 -0500'")),
        "epoch_ms": dt.epoch_date(F.unix_millis(d.cast("timestamp")) + 86399999),
        "us": dt.us_date(F.date_format(d, "M/d/yyyy")), "dotted": dt.dotted_date(F.date_format(d, "dd.MM.yyyy")),
        "dashed": dt.named_month_date(F.date_format(d, "dd-MMM-yyyy")),
    }
    return table(spark, sf, "orders").select("o_orderkey", *[v.cast("string").alias(k) for k, v in out.items()])


@query("yearless_dates", f"""
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST('1999' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 5) AS DATE) AS this_year
  FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29))
SELECT o_orderkey, CAST(CASE WHEN this_year - {_DAY} > 30 THEN CAST('1998' || substr(CAST(d AS STRING), 5) AS DATE) ELSE this_year END AS STRING) AS day FROM d""")
def yearless_dates(spark, sf):
    d = C("o_orderdate")
    leap = (F.month(d) == 2) & (F.dayofmonth(d) == 29)
    return table(spark, sf, "orders").where(~leap).select("o_orderkey", dt.loose_posted_date(
        F.date_format(d, "E, MMM dd"), L(AS_OF).cast("date")).cast("string").alias("day"))


@query("date_sources", f"""
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN CAST(d AS STRING) WHEN o_custkey % 3 = 1 THEN CAST(d + 1 AS STRING) END AS posted,
  CASE o_custkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'approx' END AS posted_source,
  CASE WHEN d <= {_DAY} + 1 THEN CAST(d AS STRING) ELSE CAST({_DAY} - 5 AS STRING) END AS started,
  CASE WHEN d <= {_DAY} + 1 THEN 'exact' ELSE 'approx' END AS start_source,
  CASE WHEN d = {_DAY} THEN NULL ELSE CAST(d AS STRING) END AS not_today,
  CASE WHEN o_custkey % 2 = 0 THEN 'approx' ELSE 'exact' END AS resolved, CAST(o_custkey % 35 IN (29, 30) AS INT) AS floor_like
FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def date_sources(spark, sf):
    day, k = L(AS_OF).cast("date"), C("o_custkey")
    rows = table(spark, sf, "orders").withColumn("d", C("o_orderdate").cast("date"))
    stamp = F.when(k % 3 == 0, F.concat(C("d").cast("string"), L("T04:00:00.000Z"))).otherwise(F.concat(C("d").cast("string"), L("T04:13:07Z")))
    page = dt.stamp_or_sitemap(stamp, F.when(k % 3 == 1, F.date_add("d", 1)))
    start = dt.start_date_or_age(C("d").cast("string"), L("Posted 5 Days Ago"), day)
    kind = F.when(k % 2 == 0, "workday").otherwise("greenhouse")
    return rows.select("o_orderkey", page["posted"].cast("string").alias("posted"), page["posted_source"].alias("posted_source"),
                       start["posted"].cast("string").alias("started"), start["posted_source"].alias("start_source"),
                       dt.drop_render_stamp(C("d"), day).cast("string").alias("not_today"), dt.provenance(C("d"), L(""), kind).alias("resolved"),
                       dt.floor_artifact(C("d"), F.date_add("d", (k % 35).cast("int"))).cast("int").alias("floor_like"))


@query("age_bucket_dates", f"""
SELECT event_type AS company, user_id AS posting_id, CAST(min(1 + day(ts) % 6) AS BIGINT) AS bucket,
  CAST({_DAY} - CASE min(1 + day(ts) % 6) WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 4 WHEN 4 THEN 11 WHEN 5 THEN 18 ELSE 25 END AS STRING) AS posted
FROM events GROUP BY 1, 2""")
def age_bucket_dates(spark, sf):
    from postingworks.operators.boards import age_buckets
    rows = table(spark, sf, "events").select(C("event_type").alias("company"), C("user_id").alias("posting_id"),
                                             (1 + F.dayofmonth("ts") % 6).alias("bucket"))
    return age_buckets(rows, L(AS_OF).cast("date")).withColumn("posted", C("posted").cast("string")).withColumn("bucket", C("bucket").cast("bigint"))


@query("long_vocabulary", "SELECT doc_id, CAST(regexp_matches(lower(text), '(^|[^a-z0-9])(the|and of|le la|thth|der)([^a-z0-9]|$)') AS INT) AS found FROM documents")
def long_vocabulary(spark, sf):
    return wide_table(spark, sf, "documents").select("doc_id", tm.contains_any_ngrams(C("text"), ["the", "and of", "le la", "thth", "der"]).cast("int").alias("found"))




# all runs of two and three words of the benchmark, spelled with single blanks: thousands of terms
TERMS = """SELECT DISTINCT w[i] || ' ' || w[i + 1] || CASE WHEN n = 3 THEN ' ' || w[i + 2] ELSE '' END AS term
  FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w, unnest([2, 3]) AS n FROM benchmark))"""


def _benchmark_terms(spark, sf):
    words = table(spark, sf, "benchmark").select(F.regexp_extract_all(F.lower("text"), L("[a-z0-9]+"), L(0)).alias("w")).withColumn("n", F.explode(F.array(L(2), L(3))))
    cut = words.where(F.size("w") >= C("n")).select("w", "n", F.explode(F.sequence(L(1), F.size("w") - C("n") + 1)).alias("i"))
    return cut.select(F.array_join(F.slice("w", C("i"), C("n")), " ").alias("term")).distinct()


_FOUND = f"""
WITH terms AS ({TERMS}),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w, regexp_split_to_array(lower(text), '[a-z0-9]+') AS g FROM documents),
runs AS (SELECT doc_id, i, w[i] || g[i + 1] || w[i + 1] || CASE WHEN n = 3 THEN g[i + 2] || w[i + 2] ELSE '' END AS run
  FROM (SELECT doc_id, w, g, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, unnest([2, 3]) AS n FROM d))),
hits AS (SELECT doc_id, i, run FROM runs WHERE run IN (SELECT term FROM terms))"""


@query("dictionary_first_terms", f"{_FOUND} SELECT doc_id, arg_min(run, (i, -length(run))) AS term FROM hits GROUP BY doc_id")
def dictionary_first_terms(spark, sf):
    found = dictionary.first_terms(wide_table(spark, sf, "documents"), _benchmark_terms(spark, sf), id_col="doc_id", aliases=False)
    return found.select("doc_id", "term")


@query("dictionary_term_counts", f"{_FOUND} SELECT term, count(DISTINCT doc_id) AS n FROM terms LEFT JOIN hits ON run = term GROUP BY term")
def dictionary_term_counts(spark, sf):
    return dictionary.term_counts(wide_table(spark, sf, "documents"), _benchmark_terms(spark, sf), id_col="doc_id", aliases=False)
