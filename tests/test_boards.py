"""Every board type in one pass, on small payloads written for them."""

import datetime
import json

from pyspark.sql import functions as F

from postingworks.sources.details import normalize_details
from postingworks.sources.html_boards import normalize_html
from postingworks.sources.json_boards import normalize_json
from postingworks.sources.xml_boards import feed_entries

DAY = datetime.date(2026, 11, 20)
PAGES = "company string, board_type string, endpoint map<string,string>, site string, term string, page_no int, payload string"


def read(spark, normalize, payloads):
    rows = [("c", kind, {"slug": "s", "host": "h.com", "board": "https://b", "corp": "k"}, "main", "", 0, p if isinstance(p, str) else json.dumps(p))
            for kind, p in payloads.items()]
    out = normalize(spark.createDataFrame(rows, PAGES), F.lit(DAY).cast("date"))
    return {r.board_type: (r.posting_id, r.title, r.location, r.posted and r.posted.isoformat()) for r in out.collect()}


def test_json_types(spark):
    got = read(spark, normalize_json, {
        "workable": {"results": [{"shortcode": "A1", "title": " T ", "location": {"city": "Rome", "country": "IT"}, "remote": True, "published": "2026-01-02T"}]},
        "breezy": [{"id": "b", "name": "T", "locations": [{"name": "X"}, {"name": "X"}], "location": {"is_remote": True}, "published_date": "2026-01-02"}],
        "oracle": {"items": [{"requisitionList": [{"Id": 7, "Title": "T", "PrimaryLocation": "NY", "PostedDate": "2026-01-02"}]}]},
        "ukg": {"opportunities": [{"Id": "u", "Title": "T", "PostedDate": "2026-01-02T1", "Locations": [{"Address": {"City": "X", "State": {"Code": "NY"}}}]}]},
        "csod": {"data": {"requisitions": [{"requisitionId": 3, "displayJobTitle": "T", "postingEffectiveDate": "1/2/2026",
                                            "locations": [{"city": "X", "state": "", "country": "US"}]}]}},
        "bpce": {"data": {"items": [{"job_number": "j", "title": "T", "date": "2026-01-02", "localisations": [
            {"city": "X", "country": "International", "region": "Peru"}, {"city": "Y", "country": "France"}]}]}},
        "brassring": {"Jobs": {"Job": [{"Link": "l", "Questions": [{"QuestionName": "reqid", "Value": "9"}, {"QuestionName": "jobtitle", "Value": "T"},
                                                                  {"QuestionName": "formtext23", "Value": "NY"}, {"QuestionName": "lastupdated", "Value": "02-Jan-2026"}]}]}},
        "taleo": {"requisitionList": [{"contestNo": "t", "column": ["T", "[\"A\", \"B\"]", "Jan 2, 2026"]}]},
        "commerzbank": {"SearchResult": {"SearchResultItems": [{"MatchedObjectDescriptor": {"ID": "z", "PositionTitle": "T", "PublicationStartDate": "2026-01-02",
                                                                                           "PositionLocation": [{"CityName": "X", "CountryName": "DE"}]}}]}},
        "dzbank": [{"jobReqId": 5, "stellenbezeichnung": "T", "standort": "X", "joblink": "l", "publiziert": "02.01.2026"}],
        "dayforce": {"jobPostings": [{"jobPostingId": 4, "jobTitle": "T", "postingLocations": [{"formattedAddress": "X"}], "hasVirtualLocation": True,
                                      "postingStartTimestampUTC": "2026-01-02T00"}]},
        "rippling": {"items": [{"id": "r", "name": "T", "locations": [{"name": "X", "workplaceType": "REMOTE"}]}]},
        "sitecore_search": {"widgets": [{"content": [{"job_id": "w", "name": "T", "job_city": ["X", "Y"], "job_country": ["US"], "posted_date": "2026-01-02"}]}]},
        "balyasny": [{"Id": "q", "Publish_Title__c": "T", "Posted_Ago__c": "Posted 3 Days Ago",
                      "Job_Requisition_Positions__r": [{"Location__r": {"External_Name__c": "X"}}, {"Location__r": {"External_Name__c": "X"}}]}],
        "phenom": {"refineSearch": {"data": {"jobs": [{"jobSeqNo": "p", "title": "T", "location": "X", "dateCreated": "2026-01-02"}]}}},
        "greenhouse": "not json", "lever": {"error": "no list"},
    })
    assert got == {
        "workable": ("A1", "T", "Rome, IT | Remote", "2026-01-02"), "breezy": ("b", "T", "X; Remote", "2026-01-02"), "oracle": ("7", "T", "NY", "2026-01-02"),
        "ukg": ("u", "T", "X, NY", "2026-01-02"), "csod": ("3", "T", "X, US", "2026-01-02"), "bpce": ("j", "T", "X, Peru | Y, France", "2026-01-02"),
        "brassring": ("9", "T", "NY", "2026-01-02"), "taleo": ("t", "T", "A; B", "2026-01-02"), "commerzbank": ("z", "T", "X, DE", "2026-01-02"),
        "dzbank": ("5", "T", "X", "2026-01-02"), "dayforce": ("4", "T", "X | Remote", "2026-01-02"), "rippling": ("r", "T", "X | Remote", None),
        "sitecore_search": ("w", "T", "X, Y, US", "2026-01-02"), "balyasny": ("q", "T", "X", "2026-11-17"), "phenom": ("p", "T", "X", "2026-01-02"),
    }


def test_html_types(spark):
    got = read(spark, normalize_html, {
        "silkroad": '<a id="Jobs_PagedJobList_Job-5" class="sr-panel" href="/x?a=1&amp;b=2"> <div class="sr-panel__title">T</div><span class="sr-panel__meta">X</span></a>',
        "jobaps": '<table><tr><th>h</th></tr><tr><td class="JobNum"> 26-01-2</td><td><a href="u" class="JobTitle">T</a></td><td class="Locs">X</td></tr></table>',
        "applicantstack": '<table><tr><th>Title</th><th>Location</th></tr><tr><td><a href="/x/detail/a1">T</a></td><td>X</td></tr></table>',
        "kpmg": '<a href="/jobdetail/?jobId=12"><div class="h5 text-dark-grey"> T </div><div class="text-xs text-dark-grey"> Tax | X, NY </div>',
        "taleo_cws": '<h4 class="a head-title"><a href="v?org=1&amp;rid=8" class="viewJobLink">T</a></h4> <div>X</div>',
        "avature_details": '<article class="article article--result"><a class="link" href="https://a/JobDetail?jobId=3">T</a><img alt="Office Location:"> <p> X </p>'
                           '<img alt="Posted Date:"> <p>02 Jan 2026</p>',
        "neogov": '<ul><li class="list-item" data-job-id="6"><a class="c" data-department-name="FIRE DEPT" href="/j/6">T</a> Posted today</li></ul>',
        "taleo_be": {"Result": '<div id="job_list_4"><a href="/jobs/t-4" class="job_link x">T</a><span class="location">X</span></div>'},
    })
    assert got == {
        "silkroad": ("5", "T", "X", None), "jobaps": ("26-01-2", "T", "X", None), "applicantstack": ("a1", "T", "X", None), "kpmg": ("12", "T", "X, NY", None),
        "taleo_cws": ("8", "T", "X", None), "avature_details": ("3", "T", "X", "2026-01-02"), "neogov": ("6", "T", "Fire Dept", "2026-11-20"),
        "taleo_be": ("4", "T", "X", None),
    }


def test_detail_types(spark):
    payloads = {
        "lever": json.dumps({"descriptionPlain": "A", "lists": [{"text": "L", "content": "<li>x</li>"}], "additionalPlain": " end"}),
        "oracle": json.dumps({"items": [{"ExternalDescriptionStr": "<p>A</p>", "CorporateDescriptionStr": "B"}]}),
        "rippling": json.dumps({"description": {"role": "<p>A</p>", "team": "B"}, "createdOn": "2026-01-02T"}),
        "taleo_be": '<head class="job_description"></head><div class="job_description">A <script>x</script> B</div>'[len('<head class="job_description"></head>'):],
        "phenom": '{"description":"short"} {"description":"' + "long \\u0026 " * 40 + '"}',
        "hrmdirect": "<nav>menu</nav><p>A</p><footer>f</footer>", "bamboohr": "broken",
    }
    rows = [("c", k, k, p, None) for k, p in payloads.items()]
    df = spark.createDataFrame(rows, "company string, board_type string, posting_id string, payload string, sitemap_date date")
    got = {r.posting_id: r for r in normalize_details(df, F.lit(DAY).cast("date")).collect()}
    assert got["lever"].detail_description == "A L x end" and got["oracle"].detail_description == "A B" and got["taleo_be"].detail_description == "A B"
    assert sorted(got["rippling"].detail_description.split()) == ["A", "B"] and got["rippling"].detail_source == "exact"
    assert got["phenom"].detail_description.startswith("long & long &") and got["hrmdirect"].detail_description == "A"
    assert got["bamboohr"].ok is False and got["lever"].ok is True


def entries(spark, *feeds):
    df = spark.createDataFrame([(i, f) for i, f in enumerate(feeds)], "i int, payload string")
    rows = df.select("i", F.explode(feed_entries(F.col("payload"), F.lit("item"))).alias("x")).select("i", "x.e.title", "x.e.description").collect()
    return [[((r.title or [""])[0], (r.description or [None])[0]) for r in rows if r.i == i] for i in range(len(feeds))]


def test_xml_is_parsed_as_xml(spark):
    def rss(items):
        return f'<?xml version="1.0"?><rss><channel><title>c</title>{items}</channel></rss>'

    got = entries(
        spark,
        rss("<item><sub><item><title>in</title></item></sub><title>out</title></item><item><title>b</title></item>"),
        rss("<item/><item><title/></item><item><title>t</title><description/></item>"),
        rss("<!-- <item><title>no</title></item> --><item><title>yes<!-- not this --></title></item>"),
        rss("<item><title>t</title><description><![CDATA[<p>a</item> & b</p>]]></description></item>"),
        rss('<item><x:title xmlns:x="u">n</x:title><description a="1">d</description></item>'),
        rss("<item><title>Q & A</title><description>x&nbsp;&amp;</description></item>"),
        rss("<item><title>first</title></item><item><title>torn").partition("torn")[0],
        "<item><title>no feed", "", None, "plain text")
    assert got[0] == [("out", None), ("b", None)]
    assert [t for t, _ in got[1]] == ["", "", "t"]
    assert got[2] == [("yes", None)]
    assert got[3] == [("t", "<p>a</item> & b</p>")]
    assert got[4] == [("n", "d")]
    assert got[5] == [("Q & A", "x&nbsp;&")]
    assert [t for t, _ in got[6]] == ["first"]
    assert got[7:] == [[], [], [], []]
