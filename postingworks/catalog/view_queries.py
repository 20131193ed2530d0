"""Queries a reader of the queue asks: order, search, filters, sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from postingworks.catalog.fixtures import AS_OF, fixture
from postingworks.catalog.registry import query
from postingworks.operators import views

C, L = F.col, F.lit
DAY = f"DATE '{AS_OF}'"
COLUMNS = ("company", "role", "location", "salary")


def as_of():
    return L(AS_OF).cast("date")


@query("open_queue", f"""
SELECT id FROM queue WHERE state = 'new' AND closed_on IS NULL AND (posted IS NULL OR posted >= {DAY} - 200)""")
def open_queue(spark, sf):
    return views.open_queue(fixture(spark, sf, "queue").withColumn("kw_hits", L(None).cast("array<string>")), as_of(), days=200).select("id")


@query("queue_top", """
SELECT id, row_number() OVER (ORDER BY coalesce(posted, first_seen) DESC, (o_custkey % 2) DESC, company, ord) AS place FROM queue QUALIFY place <= 200""")
def queue_top(spark, sf):
    rows = fixture(spark, sf, "queue").withColumn("kw_hits", F.when(C("o_custkey") % 2 == 1, F.array(L("risk"))).otherwise(F.array().cast("array<string>")))
    top = rows.orderBy(*views.queue_order()).limit(200)
    from pyspark.sql import Window
    return top.select("id", F.row_number().over(Window.orderBy(*views.queue_order())).cast("bigint").alias("place"))


_ROW = "lower(company || role || location || coalesce(salary, ''))"


@query("search_expression", f"""
SELECT id FROM queue WHERE (regexp_matches(lower(company), '(^|[^a-z0-9])urgent([^a-z0-9]|$)') AND contains({_ROW}, 'analyst'))
  OR (regexp_matches(lower(location), '(^|[^a-z0-9])new york([^a-z0-9]|$)') AND regexp_matches(lower(role), '(^|[^a-z0-9])anal'))
  OR (regexp_matches(lower(company), '(^|[^a-z0-9])ny([^a-z0-9]|$)') OR regexp_matches(lower(role), '(^|[^a-z0-9])ny([^a-z0-9]|$)')
      OR regexp_matches(lower(location), '(^|[^a-z0-9])ny([^a-z0-9]|$)') OR regexp_matches(lower(coalesce(salary, '')), '(^|[^a-z0-9])ny([^a-z0-9]|$)')) AND contains({_ROW}, '$90,000')""")
def search_expression(spark, sf):
    # a comma ends a group, so the amount is searched without its comma part
    found = fixture(spark, sf, "queue")
    either = views.search('company:urgent Analyst, loc:"new york" title:anal*', COLUMNS)
    both = views.search("ny", COLUMNS) & views.search("$90", COLUMNS) & C("salary").contains("$90,000")
    return found.where(either | both).select("id")


@query("experience_filter", "SELECT state, count(*) AS n FROM queue WHERE experience BETWEEN 2 AND 6 OR experience IS NULL GROUP BY state")
def experience_filter(spark, sf):
    return fixture(spark, sf, "queue").where(views.experience_between(2, 6)).groupBy("state").agg(F.count(L(1)).alias("n"))


@query("age_filter", f"SELECT state, count(*) AS n FROM queue WHERE {DAY} - coalesce(posted, first_seen) BETWEEN 30 AND 365 GROUP BY state")
def age_filter(spark, sf):
    return fixture(spark, sf, "queue").where(views.age_between(as_of(), 30, 365, False)).groupBy("state").agg(F.count(L(1)).alias("n"))


@query("metro_filter", "SELECT location, count(*) AS n FROM queue WHERE location IN ('New York, NY', 'Jersey City, NJ', 'Albany, NY; Stamford, CT') GROUP BY location")
def metro_filter(spark, sf):
    return fixture(spark, sf, "queue").where(views.in_metro(C("location"))).groupBy("location").agg(F.count(L(1)).alias("n"))


@query("flag_filters", """
SELECT company, count(*) AS n FROM (SELECT company, title FROM postings WHERE p_size < 5) WHERE company <> 'Brand#7' GROUP BY company""")
def flag_filters(spark, sf):
    rows = fixture(spark, sf, "postings").withColumn("role", C("title")).withColumn("sponsorship_status", L("OPT Only"))
    return rows.where(views.has_flags(True, True, "Brand#7")).groupBy("company").agg(F.count(L(1)).alias("n"))


@query("queue_sections", """
SELECT CASE WHEN closed_on IS NOT NULL THEN 'closed' WHEN state IN ('new', 'opt_only') THEN 'open' ELSE state END AS section,
  CASE WHEN closed_on IS NOT NULL THEN 99 WHEN state IN ('new', 'opt_only') THEN 0 WHEN state = 'shortlisted' THEN 1 WHEN state = 'applied' THEN 2
    WHEN state = 'auto_blocked' THEN 4 ELSE 5 END AS section_ord, count(*) AS n FROM queue GROUP BY 1, 2""")
def queue_sections(spark, sf):
    return views.sectioned(fixture(spark, sf, "queue")).groupBy("section", "section_ord").agg(F.count(L(1)).alias("n"))


@query("category_filter", """
SELECT count(*) AS n FROM part WHERE regexp_matches(p_name, '(^| )(ring|bolt)$') OR regexp_matches(p_name, '^hot ')""")
def category_filter(spark, sf):
    from postingworks.operators.categories import role_categories
    labels = role_categories(C("title"), {"Rings": ["ring", "bolt"], "Hot": ["hot"], "Rest": ["rod"]})
    rows = fixture(spark, sf, "postings").withColumn("title", F.regexp_replace("title", "^(Senior  |Spring 2027 Intern )", ""))
    return rows.where(views.in_categories(labels, ["Rings", "Hot"])).agg(F.count(L(1)).alias("n"))
