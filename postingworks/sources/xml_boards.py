"""Landed XML, RSS, Atom and sitemap payloads as postings.

Feeds are parsed as XML with one schema, so nested elements of one name, self-closing ones, comments and marked-up CDATA are
what they are. A feed that is no well-formed XML is parsed again with its stray ampersands and HTML entities escaped, and
only what is torn beyond that is cut by patterns, which give the elements before the tear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingworks.functions import dates as dt
from postingworks.functions.spans import let, strip
from postingworks.functions.text import distinct_sites, first_filled, join_location, split_title_place, strip_html, unescape
from postingworks.operators.boards import newest_pages
from postingworks.sources.jsonld import job_posting

# fixed value: paths that look like one posting
JOB_URL = r"(?i)/(?:jobs?|careers?|openings?|positions?|vacanc(?:y|ies)|requisitions?)/[^/]+/?$"
# board type -> element that holds one posting
ELEMENTS = {"personio": "position", "successfactors": "item", "teamtailor": "item", "sitemap": "item", "tal": "entry",
            "nas_recruitment": "url"}


_ENTRY = ("title:array<string>, link:array<string>, guid:array<string>, pubDate:array<string>, description:array<string>, "
          "location:array<string>, locations:array<struct<location:array<string>>>, remote_status:array<string>, "
          "`remote-status`:array<string>, id:array<string>, name:array<string>, office:array<string>, "
          "additionalOffices:array<struct<office:array<string>>>, createdAt:array<string>, published:array<string>, loc:array<string>, "
          "lastmod:array<string>, jobDescriptions:array<struct<jobDescription:array<struct<value:string>>>>")
_LISTS = ("item", "entry", "position", "url")
_FEED = ", ".join([*(f"{tag} array<struct<{_ENTRY}>>" for tag in _LISTS),
                   f"channel struct<item:array<struct<{_ENTRY}>>>", "_corrupt_record string"])
_LIST = f"array<struct<{_ENTRY}>>"
_PARSE = {"mode": "PERMISSIVE", "ignoreNamespace": "true", "columnNameOfCorruptRecord": "_corrupt_record"}
_STRAY = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#[xX][0-9A-Fa-f]+);)"


def without_namespaces(xml: Column) -> Column:
    return F.regexp_replace(xml, r"<(/?)[A-Za-z_][\w.-]*:(?=[A-Za-z_])", "<$1")


def elements(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}>"), F.lit(0))


def inner(xml: Column, tag: str) -> Column:
    """Raw content of the first element, CDATA opened."""
    data = r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$"
    return let(F.regexp_extract(xml, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1), lambda raw: F.when(
        raw.rlike(data), F.regexp_extract(raw, data, 1)).otherwise(unescape(raw)))


def _cut_entry(e: Column) -> Column:
    """An entry of a torn feed, in the shape of a parsed one."""
    def texts(xml: Column, tag: str) -> Column:
        return F.transform(elements(xml, tag), lambda x: inner(x, tag))

    plain = ("title", "link", "guid", "pubDate", "description", "location")
    rest = ("remote_status", "remote-status", "id", "name")
    return F.struct(
        *[texts(e, t).alias(t) for t in plain], F.array().cast("array<struct<location:array<string>>>").alias("locations"),
        *[texts(e, t).alias(t) for t in rest], F.array(inner(e, "office")).alias("office"),
        F.array(F.struct(texts(inner(e, "additionalOffices"), "office").alias("office"))).alias("additionalOffices"),
        *[texts(e, t).alias(t) for t in ("createdAt", "published", "loc", "lastmod")],
        F.array(F.struct(F.transform(texts(inner(e, "jobDescriptions"), "value"), lambda v: F.struct(v.alias("value"))).alias(
            "jobDescription"))).alias("jobDescriptions"))


def feed_entries(xml: Column, tag: Column) -> Column:
    """The entries [(entry, repaired)] of a feed whose postings are elements of the name `tag`, in order."""
    def listed(feed: Column) -> Column:
        out = F.when(tag == "item", F.concat(*[F.coalesce(x, F.array().cast(_LIST)) for x in (feed["channel"]["item"], feed["item"])]))
        for name in _LISTS[1:]:
            out = out.when(tag == name, feed[name])
        return F.coalesce(out, F.array().cast(_LIST))

    def marked(entries: Column, repaired: bool) -> Column:
        return F.transform(entries, lambda e: F.struct(e.alias("e"), F.lit(repaired).alias("repaired")))

    def torn(text: Column) -> Column:
        plain = without_namespaces(text)
        out = F.when(tag == _LISTS[0], elements(plain, _LISTS[0]))
        for name in _LISTS[1:]:
            out = out.when(tag == name, elements(plain, name))
        return F.transform(F.coalesce(out, F.array().cast("array<string>")), lambda x: _cut_entry(x).cast(f"struct<{_ENTRY}>"))

    def escaped(text: Column) -> Column:
        again = F.regexp_replace(text, _STRAY, "&amp;")
        return let(F.from_xml(again, _FEED, _PARSE), lambda feed: F.when(
            feed["_corrupt_record"].isNull(), marked(listed(feed), True)).otherwise(marked(torn(text), False)))

    return let(F.from_xml(xml, _FEED, _PARSE), lambda feed: F.when(
        feed["_corrupt_record"].isNull(), marked(listed(feed), False)).otherwise(escaped(xml)))


def _url_path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][\w+.-]*://[^/]*", ""), r"[?#].*$", "")


def _tail(url: Column) -> Column:
    return F.element_at(F.split(F.rtrim(_url_path(url), F.lit("/")), "/", -1), -1)


def normalize_xml(pages: DataFrame) -> DataFrame:
    """Postings of landed XML feeds, in page and element order, not yet deduplicated.

    Of sitemap boards only feeds are read here; a plain list of pages gives its postings through `sitemap_board`.
    """
    kind, e = F.col("board_type"), F.col("e")
    tag = F.create_map(*[F.lit(x) for pair in ELEMENTS.items() for x in pair])[kind]
    rows = (pages.where(kind.isin(*ELEMENTS)).withColumn("_found", feed_entries(F.col("payload"), tag))
            .select("company", "board_type", "endpoint", "site", "term", "page_no", F.posexplode("_found").alias("pos", "_one"))
            .select("*", F.col("_one.e").alias("e"), F.col("_one.repaired").alias("_repaired")).drop("_one"))

    def raw(name: str) -> Column:
        """The text of the entry's first element of the name."""
        text = F.coalesce(F.get(e[name], F.lit(0)), F.lit(""))
        return F.when(F.col("_repaired"), unescape(text)).otherwise(text)

    def value(name: str) -> Column:
        return strip(raw(name))

    link = F.when(kind == "tal", value("id")).when(kind == "nas_recruitment", value("loc")).when(
        kind == "sitemap", F.coalesce(*[F.nullif(value(t), F.lit("")) for t in ("link", "guid")])).otherwise(value("link"))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("_link", link)
    host = F.coalesce(F.col("endpoint")["host"], F.col("endpoint")["slug"], F.lit(""))
    ids = (F.when(kind == "personio", value("id")).when(kind == "successfactors", _tail(F.col("_link")))
           .when(kind == "teamtailor", F.regexp_extract(_url_path(F.col("_link")), r"^/jobs/(\d+)(?:-[^/]+)?/?$", 1))
           .when(kind == "sitemap", F.coalesce(F.nullif(value("guid"), F.lit("")), F.col("_link")))
           .when(kind == "tal", F.regexp_extract("_link", r"/opp/(\d+)-", 1))
           .when(F.col("_link").contains("/search/jobdetails/"), _tail(F.col("_link"))))
    sf = split_title_place(value("title"))
    title = (F.when(kind == "personio", value("name")).when(kind == "successfactors", sf["title"])
             .when(kind == "teamtailor", strip_html(raw("title"))).otherwise(value("title")))
    office = F.concat(F.array(value("office")), F.transform(F.coalesce(F.flatten(e["additionalOffices"]["office"]), none), strip))
    places = F.transform(F.concat(F.coalesce(F.flatten(e["locations"]["location"]), none), F.coalesce(e["location"], none)), strip_html)
    remote = F.lower(F.concat(value("remote_status"), value("remote-status")))
    flag = F.when(remote == "hybrid", "Hybrid").when(remote.isin("remote", "fully", "fully_remote", "fully-remote"), "Remote")
    location = (F.when(kind == "personio", F.array_join(F.filter(office, lambda o: o != ""), ", "))
                .when(kind == "successfactors", sf["place"])
                .when(kind == "teamtailor", distinct_sites(F.concat(places, F.array(flag))))
                .otherwise(value("location")))
    modified = dt.iso_date(value("lastmod"))
    feed_day = F.when(kind == "sitemap", None).otherwise(dt.rfc822_date(value("pubDate")))
    posted = (F.when(kind == "personio", dt.iso_date(value("createdAt"))).when(kind == "tal", dt.iso_date(value("published")))
              .when(kind == "nas_recruitment", modified).otherwise(feed_day))
    url = F.when(kind == "personio", F.concat(F.lit("https://"), host, F.lit(".jobs.personio.de/job/"), value("id"),
                                              F.lit("?language=en"))).when(
        kind == "successfactors", F.regexp_replace("_link", r"[?#].*$", "")).otherwise(F.col("_link"))
    text = F.when(kind == "personio", F.array_join(F.transform(F.coalesce(F.flatten(e["jobDescriptions"]["jobDescription"])["value"], none), strip_html), " ")).when(
        kind.isin("tal", "nas_recruitment"), None).otherwise(strip_html(raw("description")))
    return (rows.withColumn("posting_id", ids).where("posting_id <> ''").withColumn("posted", posted)
            .select("company", "board_type", "posting_id", title.alias("title"), location.alias("location"), url.alias("url"), "posted",
                    F.when((kind == "nas_recruitment") & F.col("posted").isNotNull(), "approx").alias("posted_source"),
                    "site", text.alias("description"), "term", "page_no", "pos"))


def sitemap_urls(pages: DataFrame, pattern: str = JOB_URL) -> DataFrame:
    """Posting pages named by sitemaps: (company, lastmod, url); keep the newest with `newest_pages`."""
    e = F.col("one.e")
    rows = pages.select("company", F.explode(feed_entries(F.col("payload"), F.lit("url"))).alias("one"))

    def value(name: str) -> Column:
        text = F.coalesce(F.get(e[name], F.lit(0)), F.lit(""))
        return strip(F.when(F.col("one.repaired"), unescape(text)).otherwise(text))

    return rows.select("company", value("lastmod").alias("lastmod"), value("loc").alias("url")).where(
        (F.col("url") != "") & F.col("url").rlike(pattern)).distinct()


def sitemap_board(sitemaps: DataFrame, pages: DataFrame, pattern: str = JOB_URL, cap: int | None = None) -> DataFrame:
    """Postings of boards that only have a sitemap: its posting pages joined with what their landed pages say.

    `sitemaps(company, payload)` holds the sitemaps, an index's children included; `pages(company, url, html)` the pages.
    A page without a JobPosting node is no posting. The node's own number is the id, else the address is; its date wins
    over the sitemap's. With `cap`, only the newest so many pages per board count.
    """
    listed, _ = newest_pages(sitemap_urls(sitemaps, pattern), cap)
    # an address may stand in several sitemaps with several dates
    named = listed.groupBy("company", "url").agg(F.max("lastmod").alias("lastmod"))
    node = F.col("_node")

    def text(path: str) -> Column:
        return F.coalesce(F.try_variant_get(node, f"$.{path}", "string"), F.lit(""))

    read = named.join(pages.select("company", "url", "html"), ["company", "url"]).withColumn(
        "_node", job_posting(F.col("html"))).where(node.isNotNull())
    several = F.try_variant_get(node, "$.jobLocation", "array<variant>").isNotNull()

    def place(field: str) -> Column:
        return F.when(several, text(f"jobLocation[0].address.{field}")).otherwise(text(f"jobLocation.address.{field}"))

    whole = F.try_variant_get(node, "$.identifier", "map<string,variant>").isNotNull()
    number = F.when(whole, text("identifier.value")).otherwise(text("identifier"))
    return read.select(
        "company", F.lit("sitemap").alias("board_type"), first_filled(number, F.col("url")).alias("posting_id"),
        strip(unescape(text("title"))).alias("title"),
        join_location(place("addressLocality"), place("addressRegion")).alias("location"), "url",
        dt.iso_date(F.substring(first_filled(text("datePosted"), F.col("lastmod")), 1, 10)).alias("posted"),
        strip_html(text("description")).alias("description"))
