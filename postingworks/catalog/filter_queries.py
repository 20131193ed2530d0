"""Queries over title and location rules, and the audits built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from postingworks.catalog.fixtures import fixture, select, table, wide_table
from postingworks.catalog.registry import query
from postingworks.functions import terms as tm
from postingworks.operators import audit, categories, filters, trends
from postingworks.operators.filters import FilterRules, UnlessRule
from postingworks.session import run_folder

C, L = F.col, F.lit
RULES = FilterRules(
    title_include=("widget", "gizmo", "ring", "rod", "bolt"),
    title_exclude=("intern", "senior", "red widget", "promo"),
    title_exclude_unless=(UnlessRule(("gizmo",), ("small", "large")),),
    locations_exclude=("sao paulo",),
)
_TITLE = "trim(regexp_replace(title, '\\s+', ' ', 'g'))"
_WORD = "regexp_matches(t, '(^|[^a-z0-9])({0})([^a-z0-9]|$)')"
RULED = f"""
SELECT *, inc AND term IS NULL AND kind IS NULL AND rule IS NULL AS hit FROM (
SELECT *, CASE WHEN NOT inc THEN NULL WHEN term IS NOT NULL THEN 'title_exclude' WHEN unless THEN 'title_exclude_unless' END AS kind,
  CASE WHEN NOT inc THEN NULL WHEN term IS NOT NULL THEN term WHEN unless THEN 'gizmo' END AS why FROM (
SELECT company, board_type, posting_id, title, location, url, ord, p_size, t, p_size < 5 OR {_WORD.format('widget|gizmo|ring|rod|bolt')} AS inc,
  CASE WHEN p_size >= 5 AND {_WORD.format('intern')} THEN 'intern' WHEN {_WORD.format('senior')} THEN 'senior'
    WHEN {_WORD.format('red widget')} THEN 'red widget' WHEN {_WORD.format('promo')} THEN 'promo' END AS term,
  {_WORD.format('gizmo')} AND NOT {_WORD.format('small|large')} AS unless,
  CASE p_size % 16 WHEN 2 THEN 'ontario' WHEN 3 THEN 'mexico' WHEN 5 THEN 'dublin' WHEN 8 THEN 'athens' WHEN 9 THEN 'bare_headquarters'
    WHEN 10 THEN 'trailing_country_code' WHEN 11 THEN 'country_code_site' WHEN 12 THEN 'canadian_province_code' WHEN 13 THEN 'canadian_postcode'
    WHEN 15 THEN 'excluded_term' END AS rule
FROM (SELECT *, lower({_TITLE}) AS t FROM postings)))"""


@query("title_and_location_rules", """
SELECT posting_id, CAST(hit AS INT) AS hit, kind AS rule_kind, why AS rule_term, rule AS location_rule FROM ruled""", ruled=RULED)
def title_and_location_rules(spark, sf):
    rows = filters.with_rules(fixture(spark, sf, "postings"), RULES)
    return rows.select("posting_id", C("hit").cast("int").alias("hit"), "rule_kind", "rule_term", "location_rule")


@query("matching_postings", "SELECT company, count(*) AS n FROM ruled WHERE hit GROUP BY company", ruled=RULED)
def matching_postings(spark, sf):
    return filters.matching(fixture(spark, sf, "postings"), RULES).groupBy("company").agg(F.count(L(1)).alias("n"))


@query("hidden_rows", """
SELECT company, posting_id, kind AS rule_kind, why AS rule_term FROM (
  SELECT * FROM ruled WHERE kind IS NOT NULL AND rule IS NULL)""", ruled=RULED)
def hidden_rows(spark, sf):
    return filters.hidden_by_title(fixture(spark, sf, "postings"), RULES)[0].select("company", "posting_id", "rule_kind", "rule_term")


@query("hidden_totals", "SELECT company, count(*) AS n FROM ruled WHERE kind IS NOT NULL AND rule IS NULL GROUP BY company", ruled=RULED)
def hidden_totals(spark, sf):
    return filters.hidden_by_title(fixture(spark, sf, "postings"), RULES)[1]


@query("title_rules_top", """
SELECT why AS rule_term, count(*) AS n FROM ruled WHERE kind IS NOT NULL AND rule IS NULL GROUP BY 1 ORDER BY n DESC, rule_term LIMIT 25""", ruled=RULED)
def title_rules_top(spark, sf):
    return audit.rule_histogram(filters.hidden_roles(fixture(spark, sf, "postings"), RULES), 25)


@query("flagged_hidden_roles", """
SELECT company || ':' || posting_id AS id, why AS rule_term, CAST(p_size % 2 = 0 AS INT) AS is_new FROM ruled
WHERE kind IS NOT NULL AND rule IS NULL AND why NOT IN ('intern', 'promo') AND regexp_matches(t, '(^|[^a-z0-9])(ring|small gizmo|bolt)([^a-z0-9]|$)')""", ruled=RULED)
def flagged_hidden_roles(spark, sf):
    posts = fixture(spark, sf, "postings")
    hidden = filters.hidden_roles(posts, RULES)
    known = posts.where("p_size % 2 = 1").select(F.concat_ws(":", "company", "posting_id").alias("id"))
    flagged = audit.flag_hidden(hidden, ("ring", "small gizmo", "bolt"), ("intern", "promo"), known)
    return flagged.select("id", "rule_term", C("is_new").cast("int").alias("is_new"))


@query("hidden_report", """
SELECT h.company, h.posting_id, h.why AS rule_term, n AS rule_n FROM ruled h JOIN (SELECT why, count(*) AS n FROM ruled
  WHERE kind IS NOT NULL AND rule IS NULL GROUP BY why) c ON h.why = c.why WHERE h.kind IS NOT NULL AND h.rule IS NULL""", ruled=RULED)
def hidden_report(spark, sf):
    hidden = filters.hidden_roles(fixture(spark, sf, "postings"), RULES)
    return audit.hidden_report(hidden).select("company", "posting_id", "rule_term", "rule_n")


@query("multi_site_rescue", """
SELECT posting_id, CASE WHEN ord % 2 = 0 THEN 'Paris; New York, NY' ELSE 'Dublin; Athens' END AS location FROM ruled
WHERE board_type = 'workday' AND p_size % 16 = 14 AND inc AND kind IS NULL AND ord % 2 = 0""", ruled=RULED)
def multi_site_rescue(spark, sf):
    rules = FilterRules(RULES.title_include, RULES.title_exclude, RULES.title_exclude_unless, ("new york",), RULES.locations_exclude)
    posts = fixture(spark, sf, "postings")
    sites = posts.select("company", "posting_id", F.when(C("ord") % 2 == 0, "Paris; New York, NY").otherwise("Dublin; Athens").alias("full_location"))
    return filters.rescue_multi_site(posts, sites, rules).select("posting_id", "location")


@query("location_retro_drop", """
SELECT state, count(*) AS n FROM queue WHERE NOT (state = 'new' AND (location IN ('London') OR location = '')) GROUP BY state""")
def location_retro_drop(spark, sf):
    # a blank place falls back to the link's slug or the title, which name none here: only "excluded" rows go
    rules = FilterRules(locations_exclude=("london",), locations_include=("ny", "boston", "nj", "chicago", "ct", "london"))
    return filters.drop_rejected_locations(fixture(spark, sf, "queue"), rules).groupBy("state").agg(F.count(L(1)).alias("n"))


@query("list_time_filters", """
SELECT CAST(sum(CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END) AS BIGINT) AS in_team,
  CAST(sum(CASE WHEN contains(lower(p_name), 'ring') THEN 1 ELSE 0 END) AS BIGINT) AS mentions FROM part""")
def list_time_filters(spark, sf):
    return table(spark, sf, "part").agg(F.count_if(filters.in_team(C("p_type"), "PROMO")).alias("in_team"),
                                        F.count_if(filters.card_mentions(C("p_name"), "RING")).alias("mentions"))


_DOC_TERMS = ("the", "and", "le", "der", "of the")


@query("document_term_rules", """
SELECT lang, source, CAST(regexp_matches(lower(text), '(^|[^a-z0-9])(the|and|le|der|of the)([^a-z0-9]|$)') AS INT) AS included, count(*) AS n
FROM documents GROUP BY 1, 2, 3""")
def document_term_rules(spark, sf):
    rows = wide_table(spark, sf, "documents").select("lang", "source", tm.contains_any(C("text"), _DOC_TERMS).cast("int").alias("included"))
    return rows.groupBy("lang", "source", "included").agg(F.count(L(1)).alias("n"))


@query("document_first_terms", """
WITH m AS (SELECT regexp_extract(lower(text), '(?:^|[^a-z0-9])(of the|the|and|der|le)(?:[^a-z0-9]|$)', 1) AS term FROM documents)
SELECT term, count(*) AS n FROM m WHERE term <> '' GROUP BY term ORDER BY n DESC, term""")
def document_first_terms(spark, sf):
    rows = wide_table(spark, sf, "documents").select(F.lower(tm.first_match(C("text"), _DOC_TERMS)).alias("rule_term")).where("rule_term is not null")
    return audit.rule_histogram(rows).withColumnRenamed("rule_term", "term")


CATEGORIES = {"Fasteners": ["bolt", "ring"], "Machines": ["gizmo", "gear", "widget"], "Hot goods": ["hot", "red"], "Bars": ["rod"]}
MERGES = {"Metal": ["Fasteners", "Bars"]}
EXCLUDE = {"Machines": ["old widget"]}
_HAS = "regexp_matches(p_name, '(^|[^a-z0-9_])({0})([^a-z0-9_]|$)')"
LABELLED = f"""
SELECT p_partkey, p_type, CASE WHEN c = '' THEN 'Other' ELSE c END AS categories FROM (SELECT p_partkey, p_type, concat_ws(',',
  CASE WHEN {_HAS.format('bolt|ring|rod')} THEN 'Metal' END,
  CASE WHEN {_HAS.format('gizmo|gear|widget')} AND NOT {_HAS.format('old widget')} THEN 'Machines' END,
  CASE WHEN {_HAS.format('hot|red')} THEN 'Hot goods' END) AS c FROM part)"""


@query("role_categories", "SELECT p_partkey, categories FROM labelled", labelled=LABELLED)
def role_categories(spark, sf):
    merged = categories.merge_labels(CATEGORIES, MERGES)
    labels = categories.role_categories(C("p_name"), merged, EXCLUDE)
    return table(spark, sf, "part").select("p_partkey", F.array_join(labels, ",").alias("categories"))


@query("category_counts", """
SELECT p_type AS section, unnest(string_split(categories, ',')) AS category, count(*) AS n FROM labelled GROUP BY 1, 2""", labelled=LABELLED)
def category_counts(spark, sf):
    labels = categories.role_categories(C("p_name"), categories.merge_labels(CATEGORIES, MERGES), EXCLUDE)
    rows = table(spark, sf, "part").select(C("p_type").alias("section"), labels.alias("categories"))
    return categories.category_counts(rows)


@query("category_merge", """
SELECT CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'Sized' ELSE p_type END AS label, p_name AS term, CAST(min(p_partkey) AS BIGINT) AS ord
FROM part GROUP BY 1, 2""")
def category_merge(spark, sf):
    terms = table(spark, sf, "part").select(C("p_type").alias("label"), L(0).alias("label_ord"), C("p_name").alias("term"), C("p_partkey").alias("ord"))
    merges = terms.select("label").where("label in ('SMALL', 'MEDIUM')").distinct().select(C("label").alias("member"), L("Sized").alias("label"))
    return categories.merge_terms(terms, merges).select("label", "term", C("place.ord").alias("ord"))


# events read as hidden postings: the rule is the event type and the term a user, each run day one sketch
HIDDEN = """SELECT CAST(ts AS DATE) AS run_date, event_type AS company, CAST(event_id AS STRING) AS posting_id, 'exclude' AS rule_kind,
  CONCAT(event_type, ' ', CAST(user_id AS STRING)) AS rule_term FROM events"""


def _sketches(spark, sf):
    path = run_folder(spark, "sketches")
    trends.daily_sketches(select(spark, sf, HIDDEN)).write.parquet(path)
    return spark.read.parquet(path)


@query("rule_trends", """
SELECT rule_kind, rule_term, count(*) AS n FROM hidden WHERE run_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-19'
GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 25""", hidden=HIDDEN)
def rule_trends(spark, sf):
    """The 25 most frequent rules of a fortnight, from the days' sketches; the given tables have fewer rules than are tracked."""
    return trends.top_rules(_sketches(spark, sf), L("2024-01-05").cast("date"), L("2024-01-19").cast("date"))


@query("rule_trend_totals", """
SELECT count(DISTINCT run_date) AS days, count(*) AS hits FROM hidden WHERE run_date >= DATE '2024-01-10'""", hidden=HIDDEN)
def rule_trend_totals(spark, sf):
    return trends.totals(_sketches(spark, sf), L("2024-01-10").cast("date")).select("days", "hits")
