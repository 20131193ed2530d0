"""Landed JSON payloads as postings, one mapping per board type, in a single pass."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingworks.functions import dates as dt
from postingworks.functions.pay import pay_sentence
from postingworks.functions.spans import strip
from postingworks.functions.text import (alnum_key, distinct_sites, first_filled, join_location, multi_site_location,
                                         strip_html, unescape, with_remote)

Item = Column
Build = Callable[[Column], Column]


def get(item: Item, path: str) -> Column:
    return F.try_variant_get(item, f"$.{path}", "string")


def items(item: Item, path: str) -> Column:
    return F.coalesce(F.try_variant_get(item, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))


def texts(item: Item, path: str) -> Column:
    return F.coalesce(F.try_variant_get(item, f"$.{path}", "array<string>"), F.array().cast("array<string>"))


def place(*paths: str, sep: str = ", ") -> Build:
    return lambda j: join_location(*[get(j, p) for p in paths], sep=sep)


def field(*paths: str) -> Build:
    return lambda j: F.coalesce(first_filled(*[get(j, p) for p in paths]), F.lit(""))


def each(path: str, build: Build, sep: str = " | ") -> Build:
    return lambda j: F.array_join(F.filter(F.transform(items(j, path), build), lambda s: s != ""), sep)


def html_fields(*paths: str) -> Build:
    return lambda j: F.trim(F.concat_ws(" ", *[F.nullif(strip_html(get(j, p)), F.lit("")) for p in paths]))


def day(*paths: str) -> Callable[[Column, Column], Column]:
    return lambda j, as_of: dt.iso_date(first_filled(*[get(j, p) for p in paths]))


@dataclass(frozen=True)
class JsonBoard:
    """How one board type spells a posting. `list_path` of "" means the payload itself is the list."""
    list_path: str
    ids: tuple[str, ...]
    title: Build
    url: str | Build
    location: Build
    posted: Callable[[Column, Column], Column] | None = None
    description: Build | None = None
    source: str | None = None
    keep: Build | None = None
    cut: str | None = None


def _remote_place(flag: str, value: str, *paths: str) -> Build:
    return lambda j: with_remote(place(*paths)(j), get(j, flag) == value)


def _lever_text(j: Item) -> Column:
    body = first_filled(get(j, "descriptionPlain"), strip_html(get(j, "description")))
    lists = F.array_join(F.transform(items(j, "lists"), lambda part: F.concat(
        F.lit(" "), F.coalesce(get(part, "text"), F.lit("")), F.lit(" "), strip_html(get(part, "content")))), "")
    pay = pay_sentence(get(j, "salaryRange.currency"), get(j, "salaryRange.min"), get(j, "salaryRange.max"),
                       F.regexp_replace(F.coalesce(get(j, "salaryRange.interval"), F.lit("")), "per-", ""))
    return F.concat(F.coalesce(body, F.lit("")), lists, F.lit(" "), F.coalesce(get(j, "additionalPlain"), F.lit("")), pay)


def _ashby_text(j: Item) -> Column:
    pay = F.array_join(F.transform(
        F.filter(items(j, "compensation.summaryComponents"), lambda p: get(p, "compensationType") == "Salary"),
        lambda p: pay_sentence(get(p, "currencyCode"), get(p, "minValue"), get(p, "maxValue"), get(p, "interval"))), "")
    return F.concat(F.coalesce(first_filled(get(j, "descriptionPlain"), strip_html(get(j, "descriptionHtml"))), F.lit("")), pay)


def _goldman_text(j: Item) -> Column:
    return F.concat(strip_html(get(j, "descriptionHtml")), pay_sentence(
        get(j, "compensation.currency"), get(j, "compensation.minSalary"), get(j, "compensation.maxSalary"), F.lit("year")))


def _comeet_place(j: Item) -> Column:
    where = F.coalesce(first_filled(get(j, "location.name"), place("location.city", "location.state", "location.country")(j),
                                    get(j, "location")), F.lit(""))
    return with_remote(where, get(j, "workplace_type") == "Remote")


def _breezy_place(j: Item) -> Column:
    several = F.transform(items(j, "locations"), lambda p: get(p, "name"))
    one = F.array(get(j, "location.name"))
    sites = F.when(F.size(several) > 0, several).otherwise(one)
    remote = F.when(get(j, "location.is_remote") == "true", F.array(F.lit("Remote"))).otherwise(F.array().cast("array<string>"))
    return distinct_sites(F.concat(sites, remote))


def _dayforce_place(j: Item) -> Column:
    sites = F.transform(items(j, "postingLocations"), lambda p: get(p, "formattedAddress"))
    virtual = F.when(get(j, "hasVirtualLocation") == "true", F.lit("Remote"))
    return F.array_join(F.filter(F.concat(sites, F.array(virtual)), lambda s: F.coalesce(s, F.lit("")) != ""), " | ")


def _rippling_place(j: Item) -> Column:
    sites = F.filter(F.transform(items(j, "locations"), lambda p: get(p, "name")), lambda s: F.coalesce(s, F.lit("")) != "")
    remote = F.exists(items(j, "locations"), lambda p: F.coalesce(get(p, "workplaceType") == "REMOTE", F.lit(False)))
    return F.array_join(F.when(remote, F.array_append(sites, F.lit("Remote"))).otherwise(sites), " | ")


def _csod_place(j: Item) -> Column:
    one = lambda p: F.btrim(F.regexp_replace(F.concat_ws(
        ", ", *[F.coalesce(get(p, k), F.lit("")) for k in ("city", "state", "country")]), " ,", ""), F.lit(" ,"))
    return F.array_join(F.array_distinct(F.transform(items(j, "locations"), one)), "; ")


def _bpce_place(j: Item) -> Column:
    def one(p):
        country = F.when(get(p, "country") == "International", get(p, "region")).otherwise(get(p, "country"))
        return join_location(get(p, "city"), country)
    return F.array_join(F.transform(items(j, "localisations"), one), " | ")


def _answers(j: Item) -> Column:
    pairs = F.transform(items(j, "Questions"), lambda q: F.struct(
        F.coalesce(get(q, "QuestionName"), F.lit("")).alias("k"), get(q, "Value").alias("v")))
    return F.map_from_entries(F.array_distinct(F.transform(
        pairs, lambda p: F.struct(p["k"].alias("k"), F.element_at(F.filter(pairs, lambda q: q["k"] == p["k"]), -1)["v"].alias("v")))))


def _taleo_column(index: int) -> Build:
    return lambda j: F.coalesce(get(j, f"column[{index}]"), F.lit(""))


def _taleo_place(j: Item) -> Column:
    listed = F.from_json(_taleo_column(1)(j), "array<string>")
    return F.coalesce(F.array_join(listed, "; "), _taleo_column(1)(j))


def _commerz_place(j: Item) -> Column:
    one = lambda p: F.btrim(F.concat_ws(", ", F.coalesce(get(p, "CityName"), F.lit("")),
                                        F.coalesce(get(p, "CountryName"), F.lit(""))), F.lit(", "))
    return F.array_join(F.transform(items(j, "MatchedObjectDescriptor.PositionLocation"), one), "; ")


def _careerpuck_place(j: Item) -> Column:
    offices = F.filter(F.transform(items(j, "offices"), lambda p: get(p, "name")), lambda s: F.coalesce(s, F.lit("")) != "")
    return F.coalesce(first_filled(get(j, "location")), F.array_join(F.array_distinct(offices), " | "))


def _sitecore_place(j: Item) -> Column:
    city = first_filled(get(j, "job_primary_city"), F.array_join(texts(j, "job_city"), ", "))
    country = first_filled(get(j, "job_primary_country"), F.array_join(texts(j, "job_country"), ", "))
    where = join_location(city, get(j, "job_primary_region"), country)
    return F.when(get(j, "working_mode") == "Remote", F.concat(where, F.lit(" | Remote"))).otherwise(where)


def _balyasny_place(j: Item) -> Column:
    def sites(p):
        more = F.transform(items(p, "Job_Requisition_Position_Locations__r"), lambda q: get(q, "Location__r.External_Name__c"))
        return F.concat(F.array(get(p, "Location__r.External_Name__c")), more)
    every = F.flatten(F.transform(items(j, "Job_Requisition_Positions__r"), sites))
    return F.array_join(F.array_distinct(F.filter(every, lambda s: F.coalesce(s, F.lit("")) != "")), " | ")


def _address(prefix: str, city: str, state: str, country: str) -> Build:
    return lambda p: join_location(get(p, f"{prefix}.{city}"), get(p, f"{prefix}.{state}"), get(p, f"{prefix}.{country}"))


def _slug(title: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))


_EIGHTFOLD_SITES = each("locations", lambda p: F.coalesce(F.try_variant_get(p, "$", "string"), F.lit("")))

JSON_BOARDS: dict[str, JsonBoard] = {
    "greenhouse": JsonBoard("jobs", ("id",), field("title"), field("absolute_url"), field("location.name"), day("first_published")),
    "lever": JsonBoard("", ("id",), field("text"), field("hostedUrl"), field("categories.location"),
                       lambda j, _: dt.epoch_date(F.try_variant_get(j, "$.createdAt", "double")), _lever_text),
    "workable": JsonBoard("results", ("shortcode",), field("title"), "https://apply.workable.com/{slug}/j/{id}/",
                          _remote_place("remote", "true", "location.city", "location.region", "location.country"), day("published")),
    "comeet": JsonBoard("", ("uid",), field("name"), field("url_active_page", "url_comeet_hosted_page"), _comeet_place,
                        day("time_updated"), each("details", lambda d: strip_html(get(d, "value")), " "), "approx"),
    "breezy": JsonBoard("", ("id",), field("name"), field("url"), _breezy_place, day("published_date")),
    "pinpoint": JsonBoard("data", ("id",), field("title"), field("url"), field("location.name", "location.city"), None,
                          html_fields("description")),
    "trakstar": JsonBoard("objects", ("id",), field("title"), field("hosted_url"),
                          place("location.city", "location.state", "location.country"), None, html_fields("description")),
    "yc": JsonBoard("props.jobPostings", ("id",), field("title"), lambda j: F.concat(
        F.lit("https://www.ycombinator.com"), get(j, "url")), lambda j: F.replace(
        F.coalesce(get(j, "location"), F.lit("")), F.lit(" / "), F.lit("; ")),
        lambda j, as_of: dt.age_text_date(get(j, "createdAt"), as_of), lambda j: F.concat_ws(
            " ", F.when(F.trim(get(j, "visa")) != "", F.concat(F.lit("Visa field: "), F.trim(get(j, "visa")), F.lit("."))),
            F.when(get(j, "minExperience") != "", F.concat(F.lit("Experience: "), get(j, "minExperience"), F.lit("."))),
            F.when(get(j, "salaryRange") != "", F.concat(F.lit("Salary: "), get(j, "salaryRange"), F.lit("."))),
            F.when(F.lower(F.trim(get(j, "visa"))).startswith("us citizen"), F.lit(
                "Candidates must be US citizens or already hold work authorization. The employer will not sponsor visas."))),
        "approx", lambda j: F.coalesce(get(j, "url"), F.lit("")) != "", r'data-page="([^"]+)"'),
    "isolvedhire": JsonBoard("data.jobs", ("id",), field("title"), "https://{host}/jobs/{id}.html", lambda j: with_remote(
        join_location(get(j, "city"), first_filled(get(j, "abbreviation"), get(j, "stateName"))),
        get(j, "workplaceType") == "Remote"), lambda j, _: dt.named_month_date(get(j, "startDateRef"))),
    "ashby": JsonBoard("jobs", ("id",), field("title"), field("jobUrl"), field("location"), day("publishedAt"), _ashby_text),
    "smartrecruiters": JsonBoard("content", ("id",), field("name"), "https://jobs.smartrecruiters.com/{slug}/{id}",
                                 place("location.city", "location.region", "location.country"), day("releasedDate")),
    "workday": JsonBoard("jobPostings", ("externalPath",), field("title"), "https://{host}/{site}{id}",
                         lambda j: multi_site_location(get(j, "locationsText"), get(j, "externalPath")),
                         lambda j, as_of: dt.posted_text_date(get(j, "postedOn"), as_of), None, "approx",
                         lambda j: F.coalesce(get(j, "title"), F.lit("")) != ""),
    "oracle": JsonBoard("items[0].requisitionList", ("Id",), field("Title"),
                        "https://{host}/hcmUI/CandidateExperience/en/sites/{site}/job/{id}", field("PrimaryLocation"), day("PostedDate")),
    "goldman": JsonBoard("data.roleSearch.items", ("roleId",), field("jobTitle"), lambda j: F.concat(
        F.lit("https://higher.gs.com/roles/"), first_filled(get(j, "externalSource.sourceId"), F.substring_index(get(j, "roleId"), "_", 1))),
        each("locations", place("city", "state", "country")), day("lastPostedDate", "createdDate"), _goldman_text),
    "eightfold": JsonBoard("positions", ("id",), field("name"), lambda j: first_filled(get(j, "canonicalPositionUrl"), get(j, "positionUrl")),
                           lambda j: F.coalesce(first_filled(_EIGHTFOLD_SITES(j), get(j, "location")), F.lit("")),
                           lambda j, _: dt.epoch_date(F.coalesce(F.try_variant_get(j, "$.t_create", "double"),
                                                                 F.try_variant_get(j, "$.creationTs", "double")), "seconds")),
    "adp_rm": JsonBoard("jobRequisitions", ("reqId",), field("publishedJobTitle", "jobTitle"),
                        "https://myjobs.adp.com/{domain}/cx/job-details?reqId={id}", each("requisitionLocations", _address(
                            "address", "cityName", "countrySubdivisionLevel1.codeValue", "country.codeValue")), day("postingDate"),
                        html_fields("jobDescription", "jobQualifications")),
    "adp_wfn": JsonBoard("jobRequisitions", ("itemID",), field("requisitionTitle"),
                         "https://workforcenow.adp.com/mascsr/default/mdf/recruitment/recruitment.html?cid={cid}&jobId={id}&lang=en_US",
                         each("requisitionLocations", field("nameCode.shortName")), day("postDate")),
    "ukg": JsonBoard("opportunities", ("Id",), field("Title"), "{board}/OpportunityDetail?opportunityId={id}",
                     each("Locations", _address("Address", "City", "State.Code", "Country.Code")), day("PostedDate"),
                     html_fields("BriefDescription")),
    "ukg_ready": JsonBoard("job_requisitions", ("id",), field("job_title"), "{board}&ShowJob={id}",
                           _remote_place("is_remote_job", "true", "location.city", "location.state"), None, html_fields("job_description")),
    "csod": JsonBoard("data.requisitions", ("requisitionId",), field("displayJobTitle"),
                      "https://{corp}.csod.com/ux/ats/careersite/1/home/requisition/{id}?c={corp}", _csod_place,
                      lambda j, _: dt.us_date(get(j, "postingEffectiveDate")), html_fields("externalDescription")),
    "bpce": JsonBoard("data.items", ("job_number", "post_id"), html_fields("title"), lambda j: get(j, "link.url"), _bpce_place,
                      day("date"), html_fields("description")),
    "paylocity": JsonBoard("Jobs", ("JobId",), field("JobTitle"), "https://recruiting.paylocity.com/Recruiting/Jobs/Details/{id}",
                           lambda j: join_location(first_filled(get(j, "JobLocation.City"), get(j, "LocationName")),
                                                   get(j, "JobLocation.State")), day("PublishedDate"),
                           cut=r"(?s)window\.pageData\s*=\s*(\{.*?\});\s*\n"),
    "deshaw": JsonBoard("props.pageProps.jobData", ("id",), field("displayName"), lambda j: F.lit(None).cast("string"),
                        each("jobMetadata.jobLocations", field("name")), None, html_fields(
                            "jobDescription.websiteDescription", "jobDescription.responsibilitiesHtml",
                            "jobDescription.peopleWeAreLookingForStr"), cut=r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>'),
    "brassring": JsonBoard("Jobs.Job", ("_answers.reqid",), lambda j: strip_html(_answers(j)["jobtitle"]), field("Link"),
                           lambda j: strip_html(_answers(j)["formtext23"]), lambda j, _: dt.named_month_date(_answers(j)["lastupdated"]),
                           lambda j: strip_html(_answers(j)["jobdescription"]), "approx"),
    "jibe": JsonBoard("jobs", ("data.req_id", "data.slug"), field("data.title"), "https://{host}/{job_path}/{id}",
                      lambda j: F.coalesce(first_filled(get(j, "data.full_location"),
                                                        place("data.city", "data.state", "data.country_code")(j)), F.lit("")),
                      day("data.posted_date", "data.create_date"),
                      html_fields("data.description", "data.responsibilities", "data.qualifications")),
    "taleo": JsonBoard("requisitionList", ("contestNo", "jobId"), lambda j: strip_html(_taleo_column(0)(j)),
                       "https://{host}/careersection/{section}/jobdetail.ftl?job={id}&lang=en", _taleo_place,
                       lambda j, _: dt.named_month_date(_taleo_column(2)(j))),
    "commerzbank": JsonBoard("SearchResult.SearchResultItems", ("MatchedObjectDescriptor.ID", "MatchedObjectId"),
                             field("MatchedObjectDescriptor.PositionTitle"), lambda j: get(j, "MatchedObjectDescriptor.PositionURI"),
                             _commerz_place, day("MatchedObjectDescriptor.PublicationStartDate")),
    "dzbank": JsonBoard("", ("jobReqId",), field("stellenbezeichnung"), field("joblink"), field("standort"),
                        lambda j, _: dt.dotted_date(get(j, "publiziert")), html_fields("beschreibung"),
                        keep=lambda j: F.coalesce(get(j, "joblink"), F.lit("")) != ""),
    "marketaxess": JsonBoard("", ("job_id", "id"), field("title"), lambda j: F.concat(
        F.lit("https://www.marketaxess.com/careers/current-openings/detail/"), _slug(get(j, "title")), F.lit("-"),
        first_filled(get(j, "job_id"), get(j, "id"))), field("location.name"), None, html_fields("content")),
    "dayforce": JsonBoard("jobPostings", ("jobPostingId",), field("jobTitle"),
                          "https://jobs.dayforcehcm.com/en-US/{namespace}/{board}/jobs/{id}", _dayforce_place,
                          day("postingStartTimestampUTC"), html_fields("jobDescription")),
    "rippling": JsonBoard("items", ("id",), field("name"), lambda j: get(j, "url"), _rippling_place),
    "careerpuck": JsonBoard("jobs", ("permalink",), field("title"), field("publicUrl"), _careerpuck_place, day("postedAt"),
                            html_fields("content", "salaryDescription"),
                            keep=lambda j: F.coalesce(get(j, "status"), F.lit("public")) == "public"),
    "bamboohr": JsonBoard("result", ("id",), field("jobOpeningName"), "https://{slug}.bamboohr.com/careers/{id}",
                          _remote_place("isRemote", "true", "location.city", "location.state")),
    "sitecore_search": JsonBoard("widgets[0].content", ("job_id", "id"), field("name"), field("job_url"), _sitecore_place,
                                 day("posted_date"), html_fields("job_description")),
    "balyasny": JsonBoard("", ("Id",), field("Publish_Title__c", "Name"), lambda j: F.concat(
        F.lit("https://bambusdev.my.site.com/s/details?jobReq="), F.coalesce(get(j, "Job_Req_Title_in_URL__c"), F.lit("")),
        F.lit("_"), F.coalesce(get(j, "Requisition_Number__c"), F.lit(""))), _balyasny_place,
        lambda j, as_of: dt.posted_text_date(get(j, "Posted_Ago__c"), as_of), None, "approx",
        lambda j: F.coalesce(first_filled(get(j, "Publish_Title__c"), get(j, "Name")), F.lit("")) != ""),
    "phenom": JsonBoard("refineSearch.data.jobs", ("jobSeqNo", "jobId"), field("title"),
                        "https://{host}/us/en/job/{id}", field("location", "cityStateCountry"), day("postedDate", "dateCreated")),
}


def _id(board: JsonBoard, j: Item) -> Column:
    return first_filled(*[_answers(j)[p.split(".")[1]] if p.startswith("_answers.") else get(j, p) for p in board.ids])


def _url(board: JsonBoard, j: Item) -> Column:
    if callable(board.url):
        return board.url(j)
    parts = []
    for literal, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", board.url):
        if literal:
            parts.append(F.lit(literal))
        if name:
            value = F.col("posting_id") if name == "id" else F.coalesce(F.col("site") if name == "site" else F.lit(None),
                                                                        F.col("endpoint")[name])
            parts.append(F.coalesce(value, F.lit("")))
    return F.concat(*parts)


def _ladder(types: Iterable[str], build: Callable[[JsonBoard], Column | None], otherwise: Column) -> Column:
    """The column each board type spells in its own way; only a row's own branch runs."""
    out = None
    for name in types:
        value = build(JSON_BOARDS[name])
        if value is not None:
            cond = F.col("board_type") == name
            out = F.when(cond, value) if out is None else out.when(cond, value)
    return otherwise if out is None else out.otherwise(otherwise)


def payload_tree(types: Iterable[str] | None = None) -> Column:
    """The JSON of a page, also where it stands inside HTML; null where there is none."""
    payload = _ladder(list(types or JSON_BOARDS), lambda b: unescape(F.regexp_extract("payload", b.cut, 1)) if b.cut and "data-page" in b.cut
                      else F.regexp_extract("payload", b.cut, 1) if b.cut else None, F.col("payload"))
    return F.try_parse_json(payload)


def normalize_json(pages: DataFrame, as_of: Column, types: Iterable[str] | None = None) -> DataFrame:
    """Postings of landed JSON pages (or HTML pages with the JSON inside), in page and list order, not yet deduplicated."""
    types = list(types or JSON_BOARDS)
    return postings_of_trees(pages.where(F.col("board_type").isin(*types)).withColumn("_tree", payload_tree(types)), as_of, types)


def postings_of_trees(tree: DataFrame, as_of: Column, types: Iterable[str] | None = None) -> DataFrame:
    """Postings of pages whose JSON is parsed already, as `_tree`."""
    types = list(types or JSON_BOARDS)
    none = F.lit(None).cast("string")
    listed = _ladder(types, lambda b: F.try_variant_get("_tree", f"$.{b.list_path}" if b.list_path else "$", "array<variant>"),
                     F.lit(None).cast("array<variant>"))
    # a page that holds one posting holds an object, not a list
    single = _ladder(types, lambda b: F.array(F.try_variant_get("_tree", f"$.{b.list_path}", "variant"))
                     if b is JSON_BOARDS["deshaw"] else None, F.lit(None).cast("array<variant>"))
    rows = (tree.select("company", "board_type", "endpoint", "site", "term", "page_no",
                        F.posexplode(F.coalesce(listed, single)).alias("pos", "j")))
    j = F.col("j")
    rows = rows.withColumn("posting_id", _ladder(types, lambda b: _id(b, j), none))
    rows = rows.where(F.coalesce(F.col("posting_id"), F.lit("")) != "")
    rows = rows.where(_ladder(types, lambda b: b.keep(j) if b.keep else None, F.lit(True)))
    posted = _ladder(types, lambda b: b.posted(j, as_of) if b.posted else None, F.lit(None).cast("date"))
    return rows.withColumn("posted", posted).select(
        "company", "board_type", "posting_id", strip(_ladder(types, lambda b: b.title(j), none)).alias("title"),
        F.coalesce(_ladder(types, lambda b: b.location(j), none), F.lit("")).alias("location"),
        _ladder(types, lambda b: _url(b, j), none).alias("url"), "posted",
        F.when(F.col("posted").isNotNull(), _ladder(types, lambda b: F.lit(b.source) if b.source else None, none)).alias("posted_source"),
        "site", _ladder(types, lambda b: b.description(j) if b.description else None, none).alias("description"),
        "term", "page_no", "pos")


def count_listed(pages: DataFrame) -> DataFrame:
    """Postings in a probe payload, by board type: `pages(board_type, payload)`; unreadable payloads count 0."""
    return count_in_trees(pages.withColumn("_tree", F.try_parse_json("payload")))


def count_in_trees(tree: DataFrame) -> DataFrame:
    """`count_listed` of pages whose JSON is parsed already, as `_tree`."""
    size = lambda path: F.size(F.try_variant_get("_tree", path, "array<variant>"))
    kind = F.col("board_type")
    markers = {"icims": 'class="iCIMS_JobCardItem"', "jobvite": 'class="jv-job-list-name"', "silkroad": 'class="sr-panel"',
               "jobaps": 'class="JobNum"', "applicantstack": "/x/detail/", "yc": "&quot;applyUrl&quot;"}
    n = F.when(kind == "bamboohr", size("$.result")).when(kind.isin("lever", "breezy"), size("$"))
    n = n.when(kind.isin("greenhouse", "ashby", "workable"), size("$.jobs")).when(kind == "isolvedhire", size("$.data.jobs"))
    for name, marker in markers.items():
        n = n.when(kind == name, F.size(F.split("payload", F.lit("\\Q" + marker + "\\E"), -1)) - 1)
    n = n.otherwise(F.try_variant_get("_tree", "$.totalFound", "int"))
    return tree.withColumn("n", F.greatest(F.coalesce(n, F.lit(0)), F.lit(0))).drop("_tree")


def name_fits(board_name: Column, company: Column) -> Column:
    """True when one name contains the other, by their letters and digits."""
    a, b = alnum_key(board_name), alnum_key(company)
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))
