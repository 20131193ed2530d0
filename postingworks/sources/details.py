"""Landed detail payloads (one posting each) as text, date and full site list, in a single pass."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingworks.functions import dates as dt
from postingworks.functions.pay import pay_sentence
from postingworks.functions.spans import let
from postingworks.functions.text import distinct_sites, drop_blocks, first_filled, strip_html
from postingworks.sources.json_boards import get, items, texts
from postingworks.sources.jsonld import job_posting, posting_pay

S = "(?s)"


@dataclass(frozen=True)
class Detail:
    """How one board type's detail payload reads. `text` gets the JSON tree or the page, `day` too; a day is a
    STRUCT<posted, posted_source>. `page` marks HTML payloads."""
    text: Callable[[Column], Column]
    day: Callable[[Column, Column], Column] | None = None
    page: bool = False
    places: Callable[[Column], Column] | None = None


def _joined(*paths: str) -> Callable[[Column], Column]:
    return lambda j: F.concat_ws(" ", *[F.nullif(strip_html(get(j, p)), F.lit("")) for p in paths])


def _dated(posted: Column, source: str = "exact") -> Column:
    return let(posted, lambda p: F.struct(p.alias("posted"), F.when(p.isNotNull(), source).alias("posted_source")))


def _iso(path: str) -> Callable[[Column, Column], Column]:
    return lambda j, _: _dated(dt.iso_date(get(j, path)))


def _greenhouse(j: Column) -> Column:
    def pay(r: Column) -> Column:
        low, high = (F.coalesce(F.try_variant_get(r, p, "double"), F.lit(0.0)) / 100 for p in ("$.min_cents", "$.max_cents"))
        # the board states no unit: small figures are hourly, large ones yearly, the middle says nothing
        unit = F.when((high > 0) & (high <= 400), "hour").when(high >= 20000, "year")
        return F.when(unit.isNotNull(), pay_sentence(get(r, "currency_type"), low, high, unit)).otherwise("")
    return F.concat(strip_html(get(j, "content")), F.array_join(F.transform(items(j, "pay_input_ranges"), pay), ""))


def _sections(j: Column) -> Column:
    parts = F.map_values(F.coalesce(F.try_variant_get(j, "$.jobAd.sections", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    return strip_html(F.array_join(F.transform(parts, lambda s: F.coalesce(get(s, "text"), F.lit(""))), " "))


def _lever(j: Column) -> Column:
    lists = F.array_join(F.transform(items(j, "lists"), lambda p: F.concat_ws(" ", F.lit(""), get(p, "text"), strip_html(get(p, "content")))), "")
    return F.trim(F.regexp_replace(F.concat(F.coalesce(first_filled(get(j, "descriptionPlain"), strip_html(get(j, "description"))), F.lit("")),
                                            lists, F.lit(" "), F.coalesce(get(j, "additionalPlain"), F.lit(""))), r"(?U)\s+", " "))


def _rippling(j: Column) -> Column:
    parts = F.map_values(F.try_variant_get(j, "$.description", "map<string,string>"))
    return strip_html(F.coalesce(F.array_join(parts, " "), get(j, "description")))


def _page_text(page: Column) -> Column:
    return strip_html(drop_blocks(page, "script|style|nav|header|footer"))


def _from_marker(marker: str) -> Callable[[Column], Column]:
    """Text of a page from the tag that holds the marker on."""
    return lambda page: let(F.instr(page, marker), lambda at: F.when(
        at > 0, strip_html(F.concat(F.lit("<i "), drop_blocks(F.substring(page, at, F.length(page)), "script|style")))).otherwise(""))


def _ld(path: str) -> Callable[[Column], Column]:
    return lambda page: get(job_posting(page), path)


def _ld_text(page: Column) -> Column:
    return let(job_posting(page), lambda n: F.concat(strip_html(get(n, "description")), posting_pay(n)))


def _with_pay(page: Column) -> Column:
    return F.concat(_page_text(page), posting_pay(job_posting(page)))


def _ukg(page: Column) -> Column:
    """The opportunity object passed to the page's detail call, with its own pay range."""
    call = S + r"CandidateOpportunityDetail\((\{.*?\})\)\s*;"
    def read(o: Column) -> Column:
        low, high = (F.try_variant_get(o, f"$.PayRange.PayRange{k}", "double") for k in ("Minimum", "Maximum"))
        shown = (get(o, "PayRangeVisible") == "true") & (low > 0) & (high > 0)
        pay = F.concat(F.lit(" Pay range: $"), F.format_number(low, 0), F.lit(" to $"), F.format_number(high, 0))
        return F.concat(strip_html(get(o, "Description")), F.when(shown, pay).otherwise(""))
    return let(F.try_parse_json(F.regexp_extract(page, call, 1)), read)


def _taleo(page: Column) -> Column:
    """Long URL-encoded fields of the page's description list."""
    block = F.regexp_extract(page, S + r"api\.fillList\('requisitionDescriptionInterface', 'descRequisition'(.*?)\]\);", 1)
    fields = F.filter(F.regexp_extract_all(block, F.lit("'([^']*)'"), F.lit(1)), lambda f: F.length(f) > 40)
    readable = F.transform(fields, lambda f: F.replace(F.coalesce(F.try_url_decode(F.replace(f, F.lit("+"), F.lit("%2B"))), f), F.lit("!*!"), F.lit(" ")))
    return strip_html(F.array_join(readable, " "))


def _phenom(page: Column) -> Column:
    """The first long description string of the page's data, else its structured description."""
    raw = F.regexp_extract_all(page, F.lit(r'"description":"((?:[^"\\]|\\.)*)"'), F.lit(1))
    plain = F.transform(raw, lambda d: strip_html(F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), d, F.lit('"'))), "$", "string")))
    long_ = F.get(F.filter(plain, lambda d: F.length(d) > 200), 0)
    return F.coalesce(F.concat(long_, posting_pay(job_posting(page))), _ld_text(page))


def _updated_day(page: Column, _: Column) -> Column:
    text = F.regexp_extract(page, S + r'ts-offer-page__maj-date">\s*<h3>[^<]*</h3>\s*(\d\d/\d\d/\d{4})', 1)
    return _dated(dt.first_format(text, ("dd/MM/yyyy",)), "approx")


def _stamped_day(page: Column, _: Column) -> Column:
    # the sitemap's date stands in for render stamps; it comes as a column of the detail row
    return let(F.struct(_ld("datePosted")(page).alias("s")), lambda s: dt.stamp_or_sitemap(F.coalesce(s["s"], F.lit("")), F.col("sitemap_date")))


def _workday_places(j: Column) -> Column:
    return distinct_sites(F.concat(F.array(get(j, "jobPostingInfo.location")), texts(j, "jobPostingInfo.additionalLocations")))


_HOSTED = Detail(lambda p: let(job_posting(p), lambda n: strip_html(F.coalesce(first_filled(get(n, "description")), drop_blocks(p)))),
                 lambda p, _: _dated(dt.page_date(p)), True)
_PLAIN_HOSTED = Detail(_HOSTED.text, None, True)
_NEXT_DATA = S + r'<script id="__NEXT_DATA__"[^>]*>(.*?)</script>'

DETAILS: dict[str, Detail] = {
    "workday": Detail(_joined("jobPostingInfo.jobDescription"), lambda j, as_of: dt.start_date_or_age(
        get(j, "jobPostingInfo.startDate"), get(j, "jobPostingInfo.postedOn"), as_of), places=_workday_places),
    "greenhouse": Detail(_greenhouse),
    "smartrecruiters": Detail(_sections),
    "oracle": Detail(_joined(*[f"items[0].{k}" for k in ("ExternalDescriptionStr", "ExternalResponsibilitiesStr",
                                                         "ExternalQualificationsStr", "CorporateDescriptionStr")])),
    "lever": Detail(_lever),
    "adp_wfn": Detail(_joined("requisitionDescription")),
    "adp_rm": Detail(_joined("jobDescription", "jobQualifications"), _iso("timestampLastPosted")),
    "eightfold": Detail(lambda j: strip_html(first_filled(get(j, "job_description"), get(j, "data.jobDescription")))),
    "goldman": Detail(_joined("data.role.descriptionHtml")),
    "bpce": Detail(_joined("content.main.text")),
    "rippling": Detail(_rippling, _iso("createdOn")),
    "bamboohr": Detail(_joined("result.jobOpening.description"), _iso("result.jobOpening.datePosted")),
    "icims": Detail(lambda p: strip_html(_ld("description")(p)), _stamped_day, True),
    "taleo_cws": Detail(lambda p: strip_html(_ld("description")(p)),
                        lambda p, as_of: _dated(dt.loose_posted_date(_ld("datePosted")(p), as_of)), True),
    "avature": Detail(_with_pay, lambda p, _: _dated(dt.page_date(p)), True),
    "kpmg": Detail(_with_pay, lambda p, _: _dated(dt.page_date(p)), True),
    "paylocity": Detail(_ld_text, lambda p, as_of: _dated(dt.drop_render_stamp(dt.page_date(p), as_of)), True),
    "talentbrew": Detail(_ld_text, None, True), "jibe": Detail(_ld_text, None, True), "phenom": Detail(_phenom, None, True),
    "ukg": Detail(_ukg, None, True), "taleo": Detail(_taleo, None, True),
    "commerzbank": Detail(_page_text, None, True), "hrmdirect": Detail(_page_text, None, True),
    "talentsoft": Detail(_from_marker("ts-offer-page__body"), _updated_day, True),
    "taleo_be": Detail(_from_marker('class="job_description"'), None, True),
    "successfactors": Detail(_from_marker('itemprop="description"'), None, True),
    "peoplesoft_hrs": Detail(lambda p: F.regexp_extract(_page_text(p), r"(?s)(JOB OPENING.*)$", 1), None, True),
    "tal": Detail(lambda p: let(F.instr(p, "Job description"), lambda at: F.when(at > 0, strip_html(
        drop_blocks(F.substring(p, at, F.length(p)), "script|style"))).otherwise("")), None, True),
    "deshaw": Detail(lambda p: let(F.try_parse_json(F.regexp_extract(p, _NEXT_DATA, 1)), lambda j: _joined(*[
        f"props.pageProps.jobData.jobDescription.{k}" for k in ("websiteDescription", "responsibilitiesHtml", "peopleWeAreLookingForStr")])(j)), None, True),
    **{name: _HOSTED for name in ("workable", "jazzhr", "teamtailor", "kula", "breezy", "jobvite", "isolvedhire", "silkroad", "jobaps", "applicantstack")},
    "nas_recruitment": _PLAIN_HOSTED, "comeet": _PLAIN_HOSTED,
}


def normalize_details(payloads: DataFrame, as_of: Column, types: Iterable[str] | None = None) -> DataFrame:
    """Details as `merge_details` takes them, from `payloads(company, board_type, posting_id, payload, sitemap_date)`.

    A payload that cannot be read gives `ok` false; the text is capped like the reader's.
    """
    types = list(types or DETAILS)
    kind = F.col("board_type")
    staged = payloads.where(kind.isin(*types)).withColumn(
        "_tree", F.when(~kind.isin(*[t for t in types if DETAILS[t].page]), F.try_parse_json("payload")))

    def ladder(build: Callable[[Detail], Column | None], otherwise: Column) -> Column:
        out = None
        for name in types:
            value = build(DETAILS[name])
            if value is not None:
                out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
        return otherwise if out is None else out.otherwise(otherwise)

    def source(d: Detail) -> Column:
        return F.col("payload") if d.page else F.col("_tree")

    nothing = F.lit(None).cast("struct<posted:date,posted_source:string>")
    text = ladder(lambda d: d.text(source(d)), F.lit(None).cast("string"))
    day = ladder(lambda d: d.day(source(d), as_of).cast("struct<posted:date,posted_source:string>") if d.day else None, nothing)
    places = ladder(lambda d: d.places(source(d)) if d.places else None, F.lit(None).cast("string"))
    readable = F.col("payload").isNotNull() & (kind.isin(*[t for t in types if DETAILS[t].page]) | F.col("_tree").isNotNull())
    return (staged.withColumn("_day", day).select(
        "company", "posting_id", F.coalesce(text, F.lit("")).alias("detail_description"),
        F.col("_day.posted").alias("detail_posted"), F.col("_day.posted_source").alias("detail_source"),
        places.alias("detail_location"), readable.alias("ok")))
