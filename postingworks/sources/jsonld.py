"""schema.org postings inside pages, and detail payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingworks.functions import dates as dt
from postingworks.functions.pay import pay_sentence
from postingworks.functions.text import drop_blocks, first_filled, join_location, strip_html

_BLOCK = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"


def _get(node: Column, path: str) -> Column:
    return F.try_variant_get(node, f"$.{path}", "string")


def _nodes(node: Column) -> Column:
    """A block's nodes in order: the object or list members, each followed by its @graph."""
    top = F.coalesce(F.try_variant_get(node, "$", "array<variant>"), F.array(node))
    return F.flatten(F.transform(top, lambda n: F.concat(F.array(n), F.coalesce(
        F.try_variant_get(n, "$['@graph']", "array<variant>"), F.array().cast("array<variant>")))))


def _is_posting(node: Column) -> Column:
    kinds = F.coalesce(F.try_variant_get(node, "$['@type']", "array<string>"),
                       F.array(F.try_variant_get(node, "$['@type']", "string")))
    return F.coalesce(F.array_contains(kinds, "JobPosting"), F.lit(False))


def job_posting(html: Column) -> Column:
    """First JobPosting node of a page, null when it has none."""
    blocks = F.transform(F.regexp_extract_all(html, F.lit(_BLOCK), F.lit(1)), lambda b: F.try_parse_json(F.trim(b)))
    return F.get(F.filter(F.flatten(F.transform(F.filter(blocks, lambda b: b.isNotNull()), _nodes)), _is_posting), 0)


def posting_places(node: Column) -> Column:
    """Every advertised location, joined by `; `."""
    listed = F.coalesce(F.try_variant_get(node, "$.jobLocation", "array<variant>"),
                        F.array(F.try_variant_get(node, "$.jobLocation", "variant")))

    def one(p: Column) -> Column:
        country = first_filled(_get(p, "address.addressCountry.name"), F.when(
            F.try_variant_get(p, "$.address.addressCountry", "map<string,variant>").isNull(), _get(p, "address.addressCountry")))
        parts = join_location(_get(p, "address.addressLocality"), _get(p, "address.addressRegion"), country)
        plain = F.when(F.try_variant_get(p, "$.address", "map<string,variant>").isNull(), _get(p, "address"))
        return F.coalesce(first_filled(plain, parts), F.lit(""))

    sites = F.transform(F.filter(listed, lambda p: p.isNotNull()), one)
    remote = F.when(_get(node, "jobLocationType") == "TELECOMMUTE", F.array(F.lit("Remote"))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.filter(F.concat(sites, remote), lambda s: s != ""), "; ")


def posting_pay(node: Column) -> Column:
    """The node's baseSalary as a pay sentence."""
    def get(path: str) -> Column:
        return first_filled(_get(node, f"baseSalary.value.{path}"), F.when(
            F.try_variant_get(node, "$.baseSalary.value", "map<string,variant>").isNull(), _get(node, f"baseSalary.{path}")))
    low, high = first_filled(get("minValue"), get("value")), first_filled(get("maxValue"), get("value"))
    return pay_sentence(first_filled(_get(node, "baseSalary.currency"), get("currency")), low, high, get("unitText"))


def read_pages(pages: DataFrame, as_of: Column, html: str = "html") -> DataFrame:
    """Adds ld_title, ld_location, ld_posted, ld_description (with its pay sentence) read from each page.

    Pages without structured data give their visible text as the description.
    """
    return read_nodes(pages.withColumn("_node", job_posting(F.col(html))), as_of, html)


def read_nodes(staged: DataFrame, as_of: Column, html: str = "html") -> DataFrame:
    """`read_pages` of pages whose JobPosting node is parsed already, as `_node`."""
    node = F.col("_node")
    body = F.coalesce(first_filled(_get(node, "description")), drop_blocks(F.col(html)))
    return (staged.withColumn("ld_title", strip_html(_get(node, "title")))
            .withColumn("ld_location", posting_places(node))
            .withColumn("ld_posted", F.coalesce(dt.loose_posted_date(_get(node, "datePosted"), as_of), dt.page_date(F.col(html))))
            .withColumn("ld_pay", posting_pay(node))
            .withColumn("ld_description", F.concat(strip_html(body), F.col("ld_pay")))
            .drop("_node", "ld_pay"))


def merge_details(listed: DataFrame, details: DataFrame) -> DataFrame:
    """Postings with their detail payload: `details(company, posting_id, detail_description, detail_posted, detail_source,
    detail_location, ok)`.

    A description of the list wins, a detail date replaces the listed one, a full site list replaces `N Locations`; a failed detail read marks the posting.
    """
    rows = listed.join(details, ["company", "posting_id"], "left")
    dated = F.col("detail_posted").isNotNull()
    several = F.split(F.coalesce("location", F.lit("")), r" \(", 2)[0].rlike(r"(?i)^\s*\d+\s+locations?\s*$")
    new = {
        "description": F.coalesce(first_filled(F.col("description"), F.col("detail_description")), F.lit("")),
        "posted": F.coalesce("detail_posted", "posted"),
        "posted_source": F.when(dated, F.col("detail_source")).otherwise(F.col("posted_source")),
        "location": F.when(several & (F.coalesce("detail_location", F.lit("")) != ""), F.col("detail_location")).otherwise(F.col("location")),
    }
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in listed.columns],
                       (~F.coalesce("ok", F.lit(True))).alias("desc_failed"))
