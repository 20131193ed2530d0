"""Queries over landed payloads composed from the tables, sinks, streams and the daily run."""

from __future__ import annotations

from pyspark.sql import functions as F

from postingworks import schemas
from postingworks.catalog.fixtures import AS_OF, fixture, select, table, wide_table
from postingworks.catalog.filter_queries import RULES
from postingworks.catalog.registry import query
from postingworks.functions import text as tx
from postingworks.operators import dedup, identity, lifecycle
from postingworks.plans import daily_run as plan
from postingworks.session import run_folder
from postingworks.sources import details, files, html_boards, json_boards, jsonld, landing, sinks, xml_boards
from postingworks.streaming import boards as live
from postingworks.streaming import snapshots

C, L = F.col, F.lit
DAY = f"DATE '{AS_OF}'"


def as_of():
    return L(AS_OF).cast("date")


def _pages(rows, payload, kind, site=None):
    return rows.select(C("company"), L(kind).alias("board_type") if isinstance(kind, str) else kind.alias("board_type"),
                       F.create_map(L("slug"), C("company"), L("host"), L("jobs.example.com")).alias("endpoint"),
                       L(site).cast("string").alias("site"), L("").alias("term"), C("page_no"), payload.alias("payload"))


# each customer is a board page with one or two postings, spelled as its type does
JSON_TYPES = ("greenhouse", "lever", "smartrecruiters", "workday", "ashby", "eightfold")


_LISTINGS = f"""
WITH c AS (SELECT c_custkey, c_custkey % 6 AS k, n_name, c_mktsegment, 'u' || c_custkey AS u FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT CASE k WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'smartrecruiters' WHEN 3 THEN 'workday' WHEN 4 THEN 'ashby' ELSE 'eightfold' END AS board_type,
  CASE WHEN k = 3 THEN '/job/x/' || c_custkey ELSE CAST(c_custkey AS STRING) END AS posting_id, c_mktsegment || ' Analyst' AS title,
  CASE k WHEN 2 THEN n_name || ', US' WHEN 3 THEN '2 Locations (x)' WHEN 5 THEN n_name || ' | Remote' ELSE n_name END AS location,
  CASE k WHEN 2 THEN 'https://jobs.smartrecruiters.com/co' || c_custkey || '/' || c_custkey WHEN 3 THEN 'https://jobs.example.com/main/job/x/' || c_custkey ELSE u END AS url,
  CAST(CASE k WHEN 3 THEN {DAY} - 3 ELSE DATE '1999-01-02' END AS STRING) AS posted, CASE k WHEN 3 THEN 'approx' END AS posted_source,
  CASE k WHEN 1 THEN 'Plain text Extra a & b tail Compensation: USD 100,000 - 120,000 per year.' WHEN 4 THEN 'Body & more Compensation: USD 50 - 60 per hour.' END AS description FROM c"""


def _json_pages(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), C("c_nationkey") == C("n_nationkey")).withColumn(
        "company", F.concat(L("co"), C("c_custkey").cast("string"))).withColumn("page_no", L(0))
    k, key = C("c_custkey") % 6, C("c_custkey").cast("string")
    title, u = F.concat("c_mktsegment", L(" Analyst")), F.concat(L("u"), key)

    def js(**fields):
        return F.struct(*[v.alias(n) for n, v in fields.items()])

    shapes = [
        js(jobs=F.array(js(id=C("c_custkey"), title=title, location=js(name=C("n_name")), absolute_url=u, first_published=L("1999-01-02T01:02:03Z")))),
        F.array(js(id=key, text=title, categories=js(location=C("n_name")), hostedUrl=u, createdAt=L(915321599999), descriptionPlain=L("Plain text"),
                   lists=F.array(js(text=L("Extra"), content=L("<li>a &amp; b</li>"))), additionalPlain=L("tail"),
                   salaryRange=js(currency=L("USD"), min=L(100000), max=L(120000), interval=L("per-year-salary")))),
        js(content=F.array(js(id=key, name=title, releasedDate=L("1999-01-02T00:00:00Z"), location=js(city=C("n_name"), region=L(""), country=L("US"))))),
        js(jobPostings=F.array(js(externalPath=F.concat(L("/job/x/"), key), title=title, locationsText=L("2 Locations"), postedOn=L("Posted 3 Days Ago")),
                               js(externalPath=L(None).cast("string"), title=L("placeholder"), locationsText=L(""), postedOn=L("")))),
        js(jobs=F.array(js(id=key, title=title, location=C("n_name"), jobUrl=u, publishedAt=L("1999-01-02"), descriptionHtml=L("<p>Body &amp; more</p>"),
                           compensation=js(summaryComponents=F.array(js(compensationType=L("Salary"), currencyCode=L("usd"), minValue=L(60), maxValue=L(50), interval=L("1 HOUR")),
                                                                     js(compensationType=L("Bonus"), currencyCode=L("USD"), minValue=L(1), maxValue=L(2), interval=L("1 YEAR"))))))),
        js(positions=F.array(js(id=C("c_custkey"), name=title, locations=F.array(C("n_name"), L("Remote")), t_create=L(915235200), canonicalPositionUrl=u))),
    ]
    payload, kind = F.to_json(shapes[0]), L(JSON_TYPES[0])
    for i, shape in enumerate(shapes[1:], 1):
        payload = F.when(k == i, F.to_json(shape)).otherwise(payload)
        kind = F.when(k == i, JSON_TYPES[i]).otherwise(kind)
    return _pages(rows, payload, kind, "main")


def _listed(out):
    return out.select("board_type", "posting_id", "title", "location", "url", C("posted").cast("string").alias("posted"), "posted_source", "description")


@query("json_listings", _LISTINGS)
def json_listings(spark, sf):
    return _listed(json_boards.normalize_json(_json_pages(spark, sf), as_of(), JSON_TYPES))


# one payload per board type, @K@ and @T@ stand for number and title; with what its location and date must read as
SHAPES = {
    "adp_rm": ("""{"jobRequisitions":[{"reqId":"@K@","publishedJobTitle":"@T@","requisitionLocations":[{"address":{"cityName":"Rome","countrySubdivisionLevel1":{"codeValue":"NY"},"country":{"codeValue":"US"}}}],"postingDate":"1999-01-02T"}]}""", "Rome, NY, US", True),
    "adp_wfn": ("""{"jobRequisitions":[{"itemID":"@K@","requisitionTitle":"@T@","requisitionLocations":[{"nameCode":{"shortName":"Rome"}}],"postDate":"1999-01-02T"}]}""", "Rome", True),
    "bamboohr": ("""{"result":[{"id":"@K@","jobOpeningName":"@T@","location":{"city":"Rome","state":"NY"}}]}""", "Rome, NY", False),
    "careerpuck": ("""{"jobs":[{"permalink":"@K@","title":"@T@","postedAt":"1999-01-02","status":"public"},{"permalink":"x","title":"hidden","status":"draft"}]}""", "", True),
    "comeet": ("""[{"uid":"@K@","name":"@T@","time_updated":"1999-01-02T"}]""", "", True),
    "deshaw": ("""<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"jobData":{"id":"@K@","displayName":"@T@","jobMetadata":{"jobLocations":[{"name":"Rome"}]}}}}}</script>""", "Rome", False),
    "goldman": ("""{"data":{"roleSearch":{"items":[{"roleId":"@K@","jobTitle":"@T@","locations":[{"city":"Rome","state":"NY","country":"US"}],"lastPostedDate":"1999-01-02"}]}}}""", "Rome, NY, US", True),
    "isolvedhire": ("""{"data":{"jobs":[{"id":"@K@","title":"@T@","city":"Rome","abbreviation":"NY","startDateRef":"Jan 2, 1999"}]}}""", "Rome, NY", True),
    "jibe": ("""{"jobs":[{"data":{"req_id":"@K@","title":"@T@","full_location":"Rome","posted_date":"1999-01-02T"}}]}""", "Rome", True),
    "marketaxess": ("""[{"job_id":"@K@","title":"@T@","location":{"name":"Rome"}}]""", "Rome", False),
    "paylocity": ("""window.pageData = {"Jobs":[{"JobId":"@K@","JobTitle":"@T@","JobLocation":{"City":"Rome","State":"NY"},"PublishedDate":"1999-01-02T"}]};\n""", "Rome, NY", True),
    "pinpoint": ("""{"data":[{"id":"@K@","title":"@T@","url":"u","location":{"city":"Rome"}}]}""", "Rome", False),
    "trakstar": ("""{"objects":[{"id":"@K@","title":"@T@","location":{"city":"Rome","state":"NY","country":"US"}}]}""", "Rome, NY, US", False),
    "ukg_ready": ("""{"job_requisitions":[{"id":"@K@","job_title":"@T@","location":{"city":"Rome","state":"NY"}}]}""", "Rome, NY", False),
}


def _other_types() -> str:
    """The checking SQL: every part as one posting of the board type its key picks."""
    kinds = ", ".join(f"({i}, '{kind}', '{place}', {str(dated).upper()})" for i, (kind, (_, place, dated)) in enumerate(SHAPES.items()))
    return f"""
SELECT kind AS board_type, CAST(p_partkey AS STRING) AS posting_id, p_name AS title, place AS location, CASE WHEN dated THEN '1999-01-02' END AS posted
FROM part JOIN (VALUES {kinds}) v(i, kind, place, dated) ON p_partkey % {len(SHAPES)} = i"""


@query("json_listings_of_other_boards", _other_types())
def json_listings_of_other_boards(spark, sf):
    rows = table(spark, sf, "part").withColumn("company", C("p_brand")).withColumn("page_no", L(0))
    kind, payload = L(None).cast("string"), L(None).cast("string")
    for i, (name, (shape, *_)) in enumerate(SHAPES.items()):
        mine = C("p_partkey") % len(SHAPES) == i
        kind = F.when(mine, name).otherwise(kind)
        payload = F.when(mine, F.replace(F.replace(L(shape), L("@K@"), C("p_partkey").cast("string")), L("@T@"), C("p_name"))).otherwise(payload)
    out = json_boards.normalize_json(_pages(rows, payload, kind, "main"), as_of(), SHAPES)
    return out.select("board_type", "posting_id", "title", "location", C("posted").cast("string").alias("posted"))


@query("xml_listings", """
SELECT CASE p_size % 3 WHEN 0 THEN 'personio' WHEN 1 THEN 'successfactors' ELSE 'tal' END AS board_type, CAST(p_partkey AS STRING) AS posting_id, p_name || ' & co' AS title,
  CASE p_size % 3 WHEN 0 THEN p_brand || ', Berlin' WHEN 1 THEN p_brand ELSE '' END AS location, '1999-03-04' AS posted,
  CASE p_size % 3 WHEN 0 THEN 'First Second' WHEN 1 THEN 'Bold text' END AS description FROM part""")
def xml_listings(spark, sf):
    rows = table(spark, sf, "part").select(C("p_brand").alias("company"), C("p_partkey").cast("string").alias("k"), "p_name", "p_brand", "p_size", L(0).alias("page_no"))
    k = C("p_size") % 3
    payload = (F.when(k == 0, F.concat(L('<?xml version="1.0"?><workzag-jobs><position><id>'), "k", L("</id><name>"), "p_name", L(" &amp; co</name><office>"), "p_brand",
                                       L("</office><additionalOffices><office>Berlin</office></additionalOffices><createdAt>1999-03-04T10:00:00+00:00</createdAt><jobDescriptions>"
                                         "<jobDescription><value><![CDATA[<p>First</p>]]></value></jobDescription><jobDescription><value>Second</value></jobDescription></jobDescriptions></position></workzag-jobs>")))
               .when(k == 1, F.concat(L("<rss><channel><title>x</title><item><title>"), "p_name", L(" &amp; co ("), "p_brand", L(")</title><link>https://x.com/job/a/"), "k",
                                      L("/?utm=1</link><pubDate>Thu, 04 Mar 1999 23:00:00 -0500</pubDate><description>&lt;b&gt;Bold&lt;/b&gt; text</description></item></channel></rss>")))
               .otherwise(F.concat(L('<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:entry><a:id>https://x.com/opp/'), "k", L("-role</a:id><a:title>"), "p_name",
                                   L(" &amp; co</a:title><a:published>1999-03-04T00:00:00Z</a:published></a:entry></a:feed>"))))
    kind = F.when(k == 0, "personio").when(k == 1, "successfactors").otherwise("tal")
    out = xml_boards.normalize_xml(_pages(rows, payload, kind))
    return out.select("board_type", "posting_id", "title", "location", C("posted").cast("string").alias("posted"), "description")


@query("xml_odd_feeds", """
SELECT CAST(p_partkey AS STRING) AS posting_id, p_name || CASE p_size % 6 WHEN 4 THEN ' & co' ELSE '' END AS title, p_brand AS location,
  CASE p_size % 6 WHEN 0 THEN 'own text' WHEN 1 THEN '' WHEN 2 THEN 'seen' WHEN 3 THEN 'before after' WHEN 4 THEN 'R&D caf\u00e9' ELSE 'whole' END AS description FROM part""")
def xml_odd_feeds(spark, sf):
    """Feeds with an item inside an item, self-closing elements, a commented item, an end tag in CDATA, stray ampersands, and a torn end."""
    rows = table(spark, sf, "part").select(C("p_brand").alias("company"), C("p_partkey").cast("string").alias("k"), "p_name", "p_brand", "p_size", L(0).alias("page_no"))
    k = C("p_size") % 6
    own = F.concat(L("<title>"), "p_name", L(" ("), "p_brand", L(")</title><link>https://x.com/job/a/"), "k", L("/</link>"))
    spoilt = F.concat(L("<title>"), "p_name", L(" & co ("), "p_brand", L(")</title><link>https://x.com/job/a/"), "k", L("/</link>"))
    inner = L("<item><title>inner (Nowhere)</title><link>https://x.com/job/a/no/</link><description>other</description></item>")
    item = (F.when(k == 0, F.concat(L("<item><related>"), inner, L("</related>"), own, L("<description>own text</description></item>")))
            .when(k == 1, F.concat(L("<item/><item>"), own, L("<guid/><description/></item>")))
            .when(k == 2, F.concat(L("<!-- "), inner, L(" --><item><!-- <title>x (y)</title> -->"), own, L("<description>seen</description></item>")))
            .when(k == 3, F.concat(L("<item>"), own, L("<description><![CDATA[before <b>after</b></item>]]></description></item>")))
            .when(k == 4, F.concat(L("<item>"), spoilt, L("<description>R&D caf&eacute;</description></item>")))
            .otherwise(F.concat(L("<item>"), own, L("<description>whole</description></item><item><title>torn (Nowh"))))
    payload = F.concat(L('<?xml version="1.0"?><rss xmlns:m="http://m.example.com"><channel><title>x</title>'), item, F.when(k < 5, "</channel></rss>").otherwise(""))
    return xml_boards.normalize_xml(_pages(rows, payload, "successfactors")).select("posting_id", "title", "location", "description")


@query("html_cards", """
SELECT CASE p_size % 3 WHEN 0 THEN 'icims' WHEN 1 THEN 'jobvite' ELSE 'talentbrew' END AS board_type, CAST(p_partkey AS STRING) AS posting_id, p_name || ' & co' AS title,
  CASE p_size % 3 WHEN 0 THEN 'New York, NY, US' WHEN 1 THEN p_brand ELSE 'Boston' END AS location, CASE p_size % 3 WHEN 1 THEN NULL ELSE '1999-03-04' END AS posted FROM part""")
def html_cards(spark, sf):
    rows = table(spark, sf, "part").select(C("p_brand").alias("company"), C("p_partkey").cast("string").alias("k"), "p_name", "p_brand", "p_size", L(0).alias("page_no"))
    k = C("p_size") % 3
    card = F.concat(L('<a href="/en/job/x/y" data-job-id="'), "k", L('"><h2>'), "p_name", L(' &amp; co</h2><span class="job-location">Boston</span><span class="job-date-posted">03/04/1999</span></a>'))
    payload = (F.when(k == 0, F.concat(L('<ul><li class="iCIMS_JobCardItem"><a href="https://x.icims.com/jobs/'), "k", L('/analyst?x=1"><h3> '), "p_name",
                                       L(' &amp; co </h3></a><span>Job Locations</span> <span> US-NY-New York </span><span title="3/4/1999 1:00 PM">d</span></li></ul>')))
               .when(k == 1, F.concat(L('<table><tr><td class="jv-job-list-name"> <a href="/acme/job/'), "k", L('">'), "p_name", L(' &amp; co</a></td><td class="jv-job-list-location">\n '), "p_brand", L(" ,\n</td></tr></table>")))
               .otherwise(F.to_json(F.struct(card.alias("results")))))
    kind = F.when(k == 0, "icims").when(k == 1, "jobvite").otherwise("talentbrew")
    out = html_boards.normalize_html(_pages(rows, payload, kind), as_of(), ("icims", "jobvite", "talentbrew"))
    return out.select("board_type", "posting_id", "title", "location", C("posted").cast("string").alias("posted"))


@query("page_menu_links", """
SELECT page_id, count(*) AS links, md5(string_agg(l, '|' ORDER BY l)) AS digest FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]+)"', 1)) AS l FROM pages) GROUP BY page_id""")
def page_menu_links(spark, sf):
    links = table(spark, sf, "pages").select("page_id", F.regexp_extract_all("html", L('<li><a href="([^"]+)"'), L(1)).alias("l")).where(F.size("l") > 0)
    return links.select("page_id", F.size("l").cast("bigint").alias("links"), F.md5(F.array_join(F.array_sort("l"), "|")).alias("digest"))


@query("embedded_json", """
SELECT CASE WHEN p_size % 2 = 0 THEN 'yc' ELSE 'paylocity' END AS board_type, CAST(p_partkey AS STRING) AS posting_id, p_name AS title,
  CASE WHEN p_size % 2 = 0 THEN 'Austin; Remote' ELSE p_brand || ', TX' END AS location, CASE WHEN p_size % 2 = 0 THEN '1999-05-18' ELSE '1999-03-04' END AS posted FROM part""")
def embedded_json(spark, sf):
    rows = table(spark, sf, "part").select(C("p_brand").alias("company"), C("p_partkey").alias("k"), "p_name", "p_brand", "p_size", L(0).alias("page_no"))
    yc = F.to_json(F.struct(F.struct(F.array(F.struct(C("k").alias("id"), C("p_name").alias("title"), L("/c/1").alias("url"), L("Austin / Remote").alias("location"),
                                                      L("about 2 weeks ago").alias("createdAt"), L("US citizen").alias("visa"))).alias("jobPostings")).alias("props")))
    pl = F.to_json(F.struct(F.array(F.struct(C("k").alias("JobId"), C("p_name").alias("JobTitle"), L("1999-03-04T00:00:00").alias("PublishedDate"),
                                             F.struct(C("p_brand").alias("City"), L("TX").alias("State")).alias("JobLocation"))).alias("Jobs")))
    even = C("p_size") % 2 == 0
    payload = F.when(even, F.concat(L('<div id="app" data-page="'), F.replace(yc, L('"'), L("&quot;")), L('"></div>'))).otherwise(
        F.concat(L("<script>window.pageData = "), pl, L(";\n</script>")))
    out = json_boards.normalize_json(_pages(rows, payload, F.when(even, "yc").otherwise("paylocity")), as_of(), ("yc", "paylocity"))
    return out.select("board_type", "posting_id", "title", "location", C("posted").cast("string").alias("posted"))


_NODES = """
SELECT page_id, 'Role ' || page_id AS ld_title, 'Ohio, US; Remote' AS ld_location, CASE WHEN page_id % 2 = 0 THEN '1999-03-04' ELSE '1999-01-02' END AS ld_posted,
  'Text ' || page_id || ' Compensation: USD 90,000 - 120,000 per year.' AS ld_description FROM pages"""


def _node_pages(spark, sf):
    node = F.struct(L("https://schema.org").alias("@context"), F.array(
        F.struct(L("Organization").alias("@type"), L(None).cast("string").alias("title"), L(None).cast("string").alias("description"), L(None).cast("string").alias("datePosted"),
                 L(None).cast("string").alias("jobLocationType"), L(None).cast("struct<address:struct<addressRegion:string,addressCountry:struct<name:string>>>").alias("jobLocation"),
                 L(None).cast("struct<currency:string,value:struct<minValue:int,maxValue:int,unitText:string>>").alias("baseSalary")),
        F.struct(L("JobPosting").alias("@type"), F.concat(L("Role "), "page_id").alias("title"), F.concat(L("<p>Text "), "page_id", L("</p>")).alias("description"),
                 F.when(C("page_id") % 2 == 0, "1999-03-04T00:00:00Z").otherwise("Jan 2, 1999").alias("datePosted"), L("TELECOMMUTE").alias("jobLocationType"),
                 F.struct(F.struct(L("Ohio").alias("addressRegion"), F.struct(L("US").alias("name")).alias("addressCountry")).alias("address")).alias("jobLocation"),
                 F.struct(L("USD").alias("currency"), F.struct(L(120000).alias("minValue"), L(90000).alias("maxValue"), L("YEAR").alias("unitText")).alias("value")).alias("baseSalary"))).alias("@graph"))
    html = F.concat("html", L('<script type="application/ld+json">not json</script><script type="application/ld+json">'), F.to_json(node), L("</script>"))
    return table(spark, sf, "pages").select("page_id", html.alias("html"))


def _node_facts(out):
    return out.select("page_id", "ld_title", "ld_location", C("ld_posted").cast("string").alias("ld_posted"), "ld_description")


@query("structured_pages", _NODES)
def structured_pages(spark, sf):
    return _node_facts(jsonld.read_pages(_node_pages(spark, sf), as_of()))


@query("merged_details", f"""
SELECT posting_id, CASE WHEN o_custkey % 2 = 0 THEN 'from list' WHEN o_custkey % 3 = 0 THEN 'from detail' ELSE '' END AS description,
  CAST(CASE WHEN o_custkey % 3 = 0 THEN {DAY} - 9 ELSE posted END AS STRING) AS posted, CASE WHEN o_custkey % 3 = 0 THEN 'exact' ELSE posted_source END AS posted_source,
  CASE WHEN o_custkey % 3 = 0 THEN 'Ohio; Iowa' ELSE '2 Locations (Ohio)' END AS location, CAST(o_custkey % 3 = 1 AS INT) AS desc_failed FROM queue""")
def merged_details(spark, sf):
    q = fixture(spark, sf, "queue")
    k = C("o_custkey")
    listed = q.select("company", "posting_id", F.when(k % 2 == 0, "from list").alias("description"), "posted", "posted_source", L("2 Locations (Ohio)").alias("location"))
    info = F.struct(F.struct(L("from <b>detail</b>").alias("jobDescription"), L("1999-05-23").alias("startDate"), L("Ohio").alias("location"),
                             F.array(L("Iowa"), L("Ohio")).alias("additionalLocations")).alias("jobPostingInfo"))
    payloads = q.where(k % 3 < 2).select("company", L("workday").alias("board_type"), "posting_id", L(None).cast("date").alias("sitemap_date"),
                                         F.when(k % 3 == 0, F.to_json(info)).otherwise("gateway error").alias("payload"))
    out = jsonld.merge_details(listed, details.normalize_details(payloads, as_of(), ("workday",)))
    return out.select("posting_id", "description", C("posted").cast("string").alias("posted"), "posted_source", "location", C("desc_failed").cast("int").alias("desc_failed"))


DETAIL_TYPES = ("greenhouse", "smartrecruiters", "icims", "avature", "ukg", "talentsoft", "bamboohr", "paylocity")


@query("detail_payloads", f"""
WITH p AS (SELECT p_partkey, p_name, p_size % 8 AS k, DATE '1999-01-01' + CAST(p_size AS INT) AS d FROM part)
SELECT CAST(p_partkey AS STRING) AS posting_id, p_name || ' & co' || CASE k WHEN 0 THEN ' Compensation: USD 90,000 - 120,000 per year.' WHEN 1 THEN ' second'
    WHEN 3 THEN ' Compensation: EUR 50,000 per year.' WHEN 4 THEN ' Pay range: $90,000 to $120,000' ELSE '' END AS detail_description,
  CASE k WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN CAST(d AS STRING) ELSE '1999-05-05' END WHEN 3 THEN CAST(d AS STRING) WHEN 5 THEN CAST(d AS STRING)
    WHEN 6 THEN CAST(d AS STRING) WHEN 7 THEN CAST(d AS STRING) END AS detail_posted,
  CASE k WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 'exact' ELSE 'approx' END WHEN 3 THEN 'exact' WHEN 5 THEN 'approx' WHEN 6 THEN 'exact' WHEN 7 THEN 'exact' END AS detail_source FROM p""")
def detail_payloads(spark, sf):
    part = wide_table(spark, sf, "part").withColumn("d", F.date_add(L("1999-01-01").cast("date"), C("p_size")))
    k, name = C("p_size") % 8, F.concat("p_name", L(" &amp; co"))
    iso = C("d").cast("string")

    def js(**fields):
        return F.struct(*[v.alias(n) for n, v in fields.items()])

    def ld(**fields):
        return F.concat(L('<script type="application/ld+json">'), F.to_json(js(**{"@type": L("JobPosting"), **fields})), L("</script>"))

    stamp = F.concat(iso, F.when(C("p_partkey") % 2 == 0, "T04:00:00.000Z").otherwise("T04:13:59Z"))
    shapes = [
        F.to_json(js(content=F.concat(L("&lt;p&gt;"), "p_name", L(" &amp;amp; co&lt;/p&gt;")), pay_input_ranges=F.array(js(min_cents=L(9000000), max_cents=L(12000000), currency_type=L("USD"))))),
        F.to_json(js(jobAd=js(sections=js(a=js(text=name), b=js(text=L("<b>second</b>")))))),
        F.concat(L("<html>"), ld(description=name, datePosted=stamp), L("</html>")),
        F.concat(L("<html><header>menu</header><p>"), name, L("</p>"), ld(datePosted=iso, baseSalary=js(currency=L("EUR"), value=js(value=L(50000), unitText=L("YEAR")))),
                 L("</html>")),
        F.concat(L("<script>var x = new CandidateOpportunityDetail("), F.to_json(js(Description=F.concat(L("<p>"), name, L("</p>")), PayRangeVisible=L(True),
                                                                                   PayRange=js(PayRangeMinimum=L(90000), PayRangeMaximum=L(120000)))), L(");</script>")),
        F.concat(L('<div class="ts-offer-page__body">'), name, L('</div><script>'), L('ts-offer-page__maj-date"><h3>Updated</h3> '), F.date_format("d", "dd/MM/yyyy"), L("</script>")),
        F.to_json(js(result=js(jobOpening=js(description=name, datePosted=iso)))),
        F.concat(L("<html>"), ld(description=name, datePosted=iso), L("</html>")),
    ]
    payload, kind = shapes[0], L(DETAIL_TYPES[0])
    for i in range(1, len(shapes)):
        payload, kind = F.when(k == i, shapes[i]).otherwise(payload), F.when(k == i, DETAIL_TYPES[i]).otherwise(kind)
    rows = part.select(C("p_brand").alias("company"), kind.alias("board_type"), C("p_partkey").cast("string").alias("posting_id"), payload.alias("payload"),
                       L("1999-05-05").cast("date").alias("sitemap_date"))
    return details.normalize_details(rows, as_of(), DETAIL_TYPES).select("posting_id", "detail_description", C("detail_posted").cast("string").alias("detail_posted"), "detail_source")


@query("exported_queue", """
SELECT id, row_number() OVER (ORDER BY coalesce(posted, first_seen) DESC, company, ord) AS place FROM queue""")
def exported_queue(spark, sf):
    path = run_folder(spark, "export")
    sinks.export_queue(fixture(spark, sf, "queue").withColumn("kw_hits", F.array().cast("array<string>")), path)
    # the place of every written line: its number in its block, after the lines of all blocks before
    lines = spark.read.text(path).select(C("_metadata.file_name").alias("file"), C("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"),
                                         F.get_json_object("value", "$.id").alias("id"))
    from pyspark.sql import Window
    blocks = lines.groupBy("file", "at").agg(F.min("n").alias("first"), F.count(L(1)).alias("rows"))
    before = blocks.select(C("file").alias("f"), C("at").alias("a"), (F.sum("rows").over(Window.orderBy("file", "at").rowsBetween(
        Window.unboundedPreceding, 0)) - C("rows") - C("first") + 1).alias("shift"))
    placed = lines.join(before, (C("file") == C("f")) & (C("at") == C("a")))
    return placed.select("id", (C("n") + C("shift")).cast("bigint").alias("place"))


@query("optional_tables", "SELECT 'present' AS source, company, posting_id, ord FROM listing")
def optional_tables(spark, sf):
    """A table that is there and one that is not yet: the second gives no rows, with the declared columns."""
    folder, columns = run_folder(spark, "optional"), "company string, posting_id string, ord bigint"
    fixture(spark, sf, "listing").select("company", "posting_id", "ord").write.parquet(f"{folder}/there")
    there = files.read_optional(spark, f"{folder}/there", columns).withColumn("source", L("present"))
    absent = files.read_optional(spark, f"{folder}/absent", columns).withColumn("source", L("absent"))
    return there.unionByName(absent).select("source", "company", "posting_id", "ord")


_COUNTS = """
SELECT l_orderkey, l_linenumber, CAST(CASE l_linenumber % 4 WHEN 0 THEN l_quantity WHEN 3 THEN 0 ELSE l_linenumber END AS INT) AS n FROM lineitem"""


def _probe_pages(spark, sf):
    k = C("l_linenumber")
    rows = F.transform(F.sequence(L(1), k), lambda i: F.struct(i.alias("id")))
    kind = F.when(k % 4 == 0, "smartrecruiters").when(k % 4 == 1, "lever").when(k % 4 == 2, "greenhouse").otherwise("ashby")
    payload = (F.when(k % 4 == 0, F.to_json(F.struct(C("l_quantity").cast("int").alias("totalFound")))).when(k % 4 == 1, F.to_json(rows))
               .when(k % 4 == 2, F.to_json(F.struct(rows.alias("jobs")))).otherwise("<html>"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("board_type"), payload.alias("payload"))


@query("payload_counts", _COUNTS)
def payload_counts(spark, sf):
    return json_boards.count_listed(_probe_pages(spark, sf)).select("l_orderkey", "l_linenumber", "n")


def _landed(spark, sf):
    """One landed table of the pages of the last three queries, told apart by their site."""
    path, none = run_folder(spark, "landed"), L(None).cast("bigint")
    listed = _json_pages(spark, sf).withColumns({"page_id": none, "l_orderkey": none, "l_linenumber": L(None).cast("int")})
    nodes = _node_pages(spark, sf).select(L("").alias("company"), L("page").alias("board_type"), L(None).cast("map<string,string>").alias("endpoint"), L("nodes").alias("site"),
                                          L("").alias("term"), L(0).alias("page_no"), C("html").alias("payload"), "page_id", none.alias("l_orderkey"), L(None).cast("int").alias("l_linenumber"))
    probes = _probe_pages(spark, sf).select(L("").alias("company"), "board_type", L(None).cast("map<string,string>").alias("endpoint"), L("probes").alias("site"), L("").alias("term"),
                                            L(0).alias("page_no"), "payload", none.alias("page_id"), "l_orderkey", "l_linenumber")
    landing.land(listed.unionByName(nodes).unionByName(probes), path)
    return landing.landed(spark, path)


@query("landed_listings", _LISTINGS)
def landed_listings(spark, sf):
    return _listed(landing.listings(_landed(spark, sf).where("site = 'main'"), as_of(), JSON_TYPES))


@query("landed_nodes", _NODES)
def landed_nodes(spark, sf):
    return _node_facts(landing.structured(_landed(spark, sf).where("site = 'nodes'"), as_of()))


@query("landed_counts", _COUNTS)
def landed_counts(spark, sf):
    return landing.counts(_landed(spark, sf).where("site = 'probes'")).select("l_orderkey", "l_linenumber", "n")


@query("guest_cards", """
SELECT p_partkey AS id, p_name AS title, p_brand AS company, CAST(DATE '1999-01-01' + CAST(p_size AS INT) AS STRING) AS posted, CAST(p_size % 2 = 0 AS INT) AS tracked FROM part""")
def guest_cards(spark, sf):
    k = C("p_partkey").cast("string")
    page = F.concat(L('<ul><li><div data-entity-urn="urn:li:jobPosting:'), k, L('"><h3 class="base-search-card__title"> '), "p_name", L(' </h3><h4 class="base-search-card__subtitle"><a>'),
                    "p_brand", L('</a></h4><span class="job-search-card__location">Ohio</span><time datetime="'), F.date_add(L("1999-01-01").cast("date"), C("p_size")).cast("string"), L('"></time></div></li></ul>'))
    part = table(spark, sf, "part")
    cards = html_boards.guest_cards(part.select(L("risk").alias("term"), L(0).alias("page_no"), page.alias("payload")))
    once = dedup.first_row(cards, ["id"], F.struct("page_no", "pos"))
    known = part.where("p_size % 2 = 0").select(C("p_brand").alias("company"), C("p_name").alias("title"), "p_size")
    # the same employer and title can carry other sizes, so the key is made unique here
    once = once.join(part.select(C("p_partkey").cast("string").alias("id"), "p_size"), "id").withColumn("title", F.concat("title", L(" "), C("p_size").cast("string")))
    known = known.withColumn("title", F.concat("title", L(" "), C("p_size").cast("string")))
    out = identity.mark_tracked(once, known)
    return out.select(C("id").cast("bigint").alias("id"), F.regexp_replace("title", r" \d+$", "").alias("title"), "company", C("posted").cast("string").alias("posted"), C("tracked").cast("int").alias("tracked"))


@query("sitemap_board", """
SELECT p_brand AS company, 'id' || p_partkey AS posting_id, p_name || ' & Co' AS title, CASE WHEN p_partkey % 2 = 0 THEN 'Boston, MA' ELSE 'Boston' END AS location,
  'https://x.com/jobs/' || p_partkey AS url, CASE WHEN p_partkey % 5 = 0 THEN '1999-02-03' ELSE '1999-01-' || lpad(CAST(1 + p_partkey % 28 AS VARCHAR), 2, '0') END AS posted,
  'Text ' || p_size AS description FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT p_brand, 'https://x.com/jobs/' || p_partkey, p_name || ' & Co', '', 'https://x.com/jobs/' || p_partkey, '1999-01-' || lpad(CAST(1 + p_partkey % 28 AS VARCHAR), 2, '0'), 'Text ' || p_size
FROM part WHERE p_partkey % 3 = 2""")
def sitemap_board(spark, sf):
    k = C("p_partkey")
    day = F.lpad((1 + k % 28).cast("string"), 2, "0")
    payload = F.concat(L('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://x.com/jobs/'), k, L("</loc><lastmod>1999-01-"), day,
                       L("</lastmod></url><url><loc>https://x.com/about</loc></url></urlset>"))
    region = F.when(k % 2 == 0, ', "addressRegion": "MA"').otherwise("")
    full = F.concat(L('"identifier": {"value": "id'), k, L('"}, '), F.when(k % 5 == 0, '"datePosted": "1999-02-03T10:00:00", ').otherwise(""),
                    L('"jobLocation": [{"address": {"addressLocality": "Boston"'), region, L("}}], "))
    node = F.concat(L('{"@type": "JobPosting", '), F.when(k % 3 == 1, full).otherwise(""), L('"title": "'), C("p_name"),
                    L(' &amp; Co", "description": "&lt;p&gt;Text '), C("p_size").cast("string"), L('&lt;/p&gt;"}'))
    html = F.concat(L("<html><head>"), F.when(k % 3 > 0, F.concat(L('<script type="application/ld+json">'), node, L("</script>"))).otherwise(""), L("</head></html>"))
    part = table(spark, sf, "part")
    sitemaps = part.select(C("p_brand").alias("company"), payload.alias("payload"))
    pages = part.select(C("p_brand").alias("company"), F.concat(L("https://x.com/jobs/"), k).alias("url"), html.alias("html"))
    about = part.select(C("p_brand").alias("company"), L("https://x.com/about").alias("url"), L("<html></html>").alias("html")).distinct()
    return xml_boards.sitemap_board(sitemaps, pages.unionAll(about)).withColumn("posted", C("posted").cast("string")).drop("board_type")


@query("sitemap_postings", """
SELECT p_brand AS company, '1999-01-' || lpad(CAST(1 + p_size % 28 AS STRING), 2, '0') AS lastmod, 'https://x.com/jobs/' || p_partkey AS url FROM part""")
def sitemap_postings(spark, sf):
    day = F.lpad((1 + C("p_size") % 28).cast("string"), 2, "0")
    payload = F.concat(L('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://x.com/jobs/'), "p_partkey", L("</loc><lastmod>1999-01-"), day,
                       L("</lastmod></url><url><loc>https://x.com/about</loc><lastmod>1999-01-01</lastmod></url></urlset>"))
    return xml_boards.sitemap_urls(table(spark, sf, "part").select(C("p_brand").alias("company"), payload.alias("payload")))


@query("document_export", """
SELECT sha1 AS key, change FROM (SELECT substr(sha1(id), 1, 20) AS sha1, CASE WHEN state IN ('new', 'opt_only') AND closed_on IS NULL THEN CASE WHEN o_custkey % 3 = 0 THEN 'kept'
   WHEN o_custkey % 2 = 0 THEN 'written' END ELSE CASE WHEN o_custkey % 3 = 0 THEN 'removed' END END AS change FROM queue) WHERE change IS NOT NULL""")
def document_export(spark, sf):
    q = fixture(spark, sf, "queue")
    old = q.where("o_custkey % 3 = 0").select(tx.description_key(C("id")).alias("key"), L("old").alias("document"))
    texts = q.select("id", F.when(C("o_custkey") % 2 == 0, F.repeat(L("long text "), 20)).otherwise("short").alias("description"))
    return sinks.export_documents(q, texts, old).select("key", "change")


@query("document_round_trip", "SELECT id, role, company, location, link, 'line one\nline two ' || ord AS body FROM queue WHERE state = 'new'")
def document_round_trip(spark, sf):
    q = fixture(spark, sf, "queue").where("state = 'new'")
    raw = q.select(C("id").alias("key"), sinks.document_text(F.concat(L("line one\nline two "), C("ord").cast("string"))).alias("value"))
    return files.parse_documents(raw).withColumnRenamed("key", "id")


@query("table_replaced", "SELECT company, posting_id FROM listing WHERE ord % 2 = 0")
def table_replaced(spark, sf):
    folder = run_folder(spark, "table")
    rows = fixture(spark, sf, "listing").select("company", "posting_id", "ord")
    sinks.replace_tables({"listing": rows}, folder)
    sinks.replace_tables({"listing": rows.where("ord % 2 = 0")}, folder)
    return sinks.read_table(spark, folder, "listing", "company string, posting_id string, ord bigint").drop("ord")


@query("tombstone_log", """
SELECT id, 'pruned' AS reason FROM queue WHERE closed_on IS NOT NULL UNION ALL SELECT id, 'pruned' FROM queue WHERE state = 'auto_blocked'""")
def tombstone_log(spark, sf):
    path = run_folder(spark, "log")
    q = fixture(spark, sf, "queue")
    sinks.append_log(lifecycle.tombstones(q.where("closed_on is not null"), as_of()), path)
    sinks.append_log(lifecycle.tombstones(q.where("state = 'auto_blocked'"), as_of()), path)
    return spark.read.parquet(path).select("id", "reason")


@query("json_lines_with_torn_rows", "SELECT CAST(o_orderkey AS STRING) AS id, 'r' AS reason FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0")
def json_lines(spark, sf):
    path = run_folder(spark, "lines")
    k = C("o_orderkey")
    line = (F.when(k % 5 == 0, F.concat(L('{"id": "'), k.cast("string"))).when(k % 7 == 0, L('{"reason": "r"}'))
            .otherwise(F.concat(L('{"id": "'), k.cast("string"), L('", "reason": "r"}'))))
    table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    return files.read_json_lines(spark, path, "id string, reason string")


@query("tracker_file", "SELECT c_name AS company, c_mktsegment AS role, 'Applied' AS status FROM customer WHERE c_custkey % 2 = 0")
def tracker_file(spark, sf):
    path = run_folder(spark, "tracker")
    rows = table(spark, sf, "customer").select(C("c_name").alias("Firm"), C("c_mktsegment").alias("Job Title"),
                                               F.when(C("c_custkey") % 2 == 0, "Applied").otherwise("Saved").alias("My Status"))
    rows.write.option("header", True).csv(path)
    out = files.read_tracker(spark, path, {"company": "Firm", "role": "Job Title", "location": None, "link": None, "status": "My Status"})
    return out.where("status = 'Applied'").select("company", "role", "status")


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return rows.select(C("ts").cast("timestamp").alias("ts"), C("event_type").alias("company"), C("user_id").cast("string").alias("posting_id"),
                       C("ts").cast("date").alias("run_date"))


def _finish(stream_writer, spark, name):
    stream_writer.option("checkpointLocation", run_folder(spark, f"{name}-checkpoint")).trigger(availableNow=True).start().awaitTermination()


@query("stream_board_counts", """
SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, event_type AS company, count(*) AS rows FROM events GROUP BY 1, 2""")
def stream_board_counts(spark, sf):
    out = run_folder(spark, "counts")
    counts = snapshots.board_counts(_event_stream(spark, sf), "60 days")
    _finish(counts.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(out)), spark, "counts")
    return spark.read.parquet(out).select(C("start").cast("date").cast("string").alias("day"), "company", "rows")


@query("stream_distinct_sightings", """
SELECT DISTINCT event_type AS company, CAST(user_id AS STRING) AS posting_id, CAST(CAST(ts AS DATE) AS STRING) AS run_date FROM events""")
def stream_distinct_sightings(spark, sf):
    out = run_folder(spark, "sightings")
    rows = snapshots.distinct_sightings(_event_stream(spark, sf), "60 days").drop("ts")
    _finish(rows.writeStream.outputMode("append").format("parquet").option("path", out), spark, "sightings")
    return spark.read.parquet(out).select("company", "posting_id", C("run_date").cast("string").alias("run_date"))


# weekly listings of the event boards, folded week by week from the first sightings on
_STREAMED = """
WITH RECURSIVE s AS (SELECT DISTINCT event_type AS company, CAST(user_id AS STRING) AS posting_id, CAST(date_trunc('week', ts) AS DATE) AS week FROM events),
weeks AS (SELECT week, row_number() OVER (ORDER BY week) AS k FROM (SELECT DISTINCT week FROM s)),
r AS (SELECT DISTINCT company, week FROM s),
st AS (
  SELECT CAST(0 AS BIGINT) AS k, event_type AS company, CAST(user_id AS STRING) AS posting_id, min(CAST(ts AS DATE)) AS seen, 0 AS misses,
    CAST(NULL AS DATE) AS closed_on, 0 AS reposts FROM events GROUP BY event_type, user_id
  UNION ALL
  SELECT k, company, posting_id, CASE WHEN live THEN week ELSE seen END, CASE WHEN live THEN 0 WHEN missed THEN misses + 1 ELSE misses END,
    CASE WHEN missed AND misses + 1 >= CASE WHEN opened >= 3 AND gone / opened > 0.5 THEN 6 ELSE 2 END AND seen < week THEN week
         WHEN live THEN NULL ELSE closed_on END, reposts + CASE WHEN live AND closed_on IS NOT NULL THEN 1 ELSE 0 END
  FROM (SELECT w.k, w.week, st.company, st.posting_id, seen, misses, closed_on, reposts, s.week IS NOT NULL AS live,
          r.week IS NOT NULL AND s.week IS NULL AND closed_on IS NULL AS missed,
          count(*) FILTER (closed_on IS NULL) OVER (PARTITION BY st.company) AS opened,
          CAST(count(*) FILTER (closed_on IS NULL AND s.week IS NULL) OVER (PARTITION BY st.company) AS DOUBLE) AS gone
        FROM st JOIN weeks w ON w.k = st.k + 1 LEFT JOIN s ON s.company = st.company AND s.posting_id = st.posting_id AND s.week = w.week
        LEFT JOIN r ON r.company = st.company AND r.week = w.week))
SELECT company || ':' || posting_id AS id, CAST(seen AS STRING) AS last_seen_live, misses AS miss_count, CAST(closed_on AS STRING) AS closed_on,
  reposts AS repost_count FROM st WHERE k = (SELECT max(k) FROM weeks)"""


def _first_queue(spark, sf):
    return (fixture(spark, sf, "sightings").groupBy("company", "posting_id").agg(F.min("run_date").alias("first_seen"))
            .withColumn("id", F.concat_ws(":", "company", "posting_id")).withColumn("last_seen_live", C("first_seen"))
            .withColumn("miss_count", L(0)).withColumn("closed_on", L(None).cast("date")).withColumn("closed_reason", L(None).cast("string"))
            .withColumn("repost_count", L(0)).withColumn("reposted_on", L(None).cast("date")))


def _lives(queue):
    return queue.select("id", C("last_seen_live").cast("string").alias("last_seen_live"), "miss_count",
                        C("closed_on").cast("string").alias("closed_on"), "repost_count")


@query("stream_liveness", _STREAMED)
def stream_liveness(spark, sf):
    """The queue kept by weekly snapshots of the event boards, whole run days a batch."""
    week = F.date_trunc("week", "ts").cast("date")
    rows = _event_stream(spark, sf).select("company", "posting_id", week.alias("run_date"), L(True).alias("complete"), L("greenhouse").alias("board_type"))
    first = _first_queue(spark, sf)
    folder = run_folder(spark, "live")
    snapshots.follow_snapshots(rows, first, folder, run_folder(spark, "live-checkpoint")).awaitTermination()
    return _lives(sinks.read_table(spark, folder, "queue", first.schema))


@query("stream_lifecycle", _STREAMED)
def stream_lifecycle(spark, sf):
    """The same queue from keyed state per board: the rows come in mixed files, a heartbeat then moves the watermark past them."""
    landed, log = run_folder(spark, "landed"), run_folder(spark, "changes")
    kept = "company string, posting_id string, run_date date, complete boolean, board_type string"
    rows = fixture(spark, sf, "sightings").select("company", "posting_id", F.date_trunc("week", "run_date").cast("date").alias("run_date"),
                                                  L(True).alias("complete"), L("greenhouse").alias("board_type"))
    rows.repartition(3, "posting_id").write.parquet(landed)
    last = rows.agg(F.max("run_date").alias("d"))
    last.select(L("").alias("company"), L(None).cast("string").alias("posting_id"), F.date_add("d", 365).alias("run_date"),
                L(None).cast("boolean").alias("complete"), L(None).cast("string").alias("board_type")).write.mode("append").parquet(landed)
    first = _first_queue(spark, sf)
    stream = spark.readStream.schema(kept).option("maxFilesPerTrigger", 2).parquet(landed)
    live.follow_boards(stream, first, log, run_folder(spark, "board-checkpoint"), late="90 days").awaitTermination()
    return _lives(live.queue_after(first, spark.read.schema(live.CHANGES).parquet(log)))


LISTED = """SELECT o_orderpriority AS company, CONCAT('n', CAST(o_orderkey AS STRING)) AS posting_id, CONCAT(p_name, ' ', LOWER(p_type)) AS title,
  CASE WHEN o_custkey % 3 = 0 THEN 'Boston' ELSE 'New York, NY' END AS location, CONCAT('u', CAST(o_orderkey AS STRING)) AS url, CAST(o_orderdate AS DATE) AS posted,
  CAST(NULL AS STRING) AS posted_source, 'main' AS site, CASE o_custkey % 3 WHEN 0 THEN 'We do not sponsor visas.' WHEN 1 THEN 'Requires 5+ years of experience.'
  ELSE 'Salary range $100,000 - $120,000.' END AS description, o_orderkey AS ord FROM orders JOIN part ON p_partkey = o_custkey"""


@query("daily_run", """
WITH ruled AS (SELECT *, lower(title) AS t FROM listed WHERE company <> '5-LOW'),
hit AS (SELECT * FROM ruled WHERE regexp_matches(t, '(^| )(widget|gizmo|ring|rod|bolt)( |$)') AND NOT regexp_matches(t, '(^| )(promo|red widget)( |$)')
  AND NOT (regexp_matches(t, '(^| )gizmo( |$)') AND NOT regexp_matches(t, '(^| )(small|large)( |$)'))),
f AS (SELECT h.*, (SELECT o_custkey FROM orders WHERE o_orderkey = h.ord) % 3 AS k FROM hit h)
SELECT 'companies' AS counter, CAST(4 AS BIGINT) AS n UNION ALL SELECT 'errors', 1 UNION ALL SELECT 'matched', count(*) FROM f UNION ALL SELECT 'blocked', 0
UNION ALL SELECT 'opt_only', count(*) FROM f WHERE k = 0 UNION ALL SELECT 'queued', count(*) FROM f WHERE k <> 0""", listed=LISTED)
def daily_run(spark, sf):
    """A whole run over order boards with a queue of older entries; the checked rows are the intake counters."""
    queue = fixture(spark, sf, "queue").drop("o_custkey", "o_totalprice").withColumn("kw_hits", L(None).cast("array<string>"))
    listing = select(spark, sf, LISTED)
    boards = fixture(spark, sf, "boards")
    companies = boards.select(F.substring("company", 1, 1).cast("int").alias("ord"), "company", "board_type",
                              F.create_map(L("date_from_id"), F.when(C("company") == "2-HIGH", "true").otherwise("false")).alias("endpoint"))
    fetched = boards.select("company", "err", "complete", L(True).alias("jobs_ok"), "n_jobs", L(1.0).alias("secs"))
    none = listing.where("1 = 0")
    details = none.select("company", "posting_id", C("description").alias("detail_description"), C("posted").alias("detail_posted"),
                          C("posted_source").alias("detail_source"), C("location").alias("detail_location"), L(True).alias("ok"))
    run = plan.RunInput(companies, fetched, listing, details, none.select("company", "posting_id", C("location").alias("full_location")))
    seeded = boards.select("company").where("company <> '1-URGENT'")
    empty = lambda s: spark.createDataFrame([], s)
    state = plan.State(queue, queue.select("company", "posting_id"), seeded, empty(schemas.TOMBSTONES), empty(schemas.FILTERED), empty(schemas.FRESHNESS))
    result = plan.daily_run(run, state, RULES, ("analyst", "risk"), as_of())
    plan.save(result.state, run_folder(spark, "state"))
    wanted = ("companies", "errors", "matched", "blocked", "opt_only", "queued")
    return result.counters.where(C("counter").isin(*wanted))
