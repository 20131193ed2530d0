"""Text, term and date functions against plain Python."""

import datetime
import html
import re
import time
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postingworks.functions import dates as dt
from postingworks.functions import pay
from postingworks.functions import terms as tm
from postingworks.functions import text as tx
from postingworks.functions.spans import first_span, last_end, spans

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def test_strip_html(column):
    values = ["a &amp; b &amp;amp; c", "&#233;&#xe9;&#146; &notit; &bogus; &copy 2", "<p>x</p>\n<b>y</b>", "&lt;i&gt;z&lt;/i&gt;", "", "R&D", "&#128512;", "&#99999999999;x"]
    want = []
    for v in values:
        v = html.unescape(html.unescape(v))
        want.append(re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", v)).strip())
    assert column(lambda df: tx.strip_html(F.col("value")), values) == want
    assert column(lambda df: tx.strip_html(F.col("value")), [(None,)]) == [""]


@QUICK
@given(st.lists(st.text(st.sampled_from("ab1 &;#xélt\n"), max_size=30), min_size=20, max_size=40))
def test_unescape_like_python(column, values):
    assert column(lambda df: tx.unescape(F.col("value")), values) == [html.unescape(v) for v in values]


@QUICK
@given(st.lists(st.text(st.sampled_from("aA1é😀 -b"), max_size=25), min_size=20, max_size=40))
def test_spans_like_finditer(column, values):
    got = column(lambda df: spans(F.col("value"), r"([aA])([1b]*)", 2, ""), values)
    for v, rows in zip(values, got, strict=True):
        want = [(m.start(), m.end(), m.group(0), [m.group(1), m.group(2)]) for m in re.finditer(r"([aA])([1b]*)", v)]
        assert [(r["start"], r["end"], r["match"], r["groups"]) for r in rows] == want
    firsts = column(lambda df: first_span(F.col("value"), "a1?", ""), values)
    lasts = column(lambda df: last_end(F.col("value"), "a1?", ""), values)
    for v, first, last in zip(values, firsts, lasts, strict=True):
        found = list(re.finditer("a1?", v))
        assert (first and (first["start"], first["end"])) == ((found[0].start(), found[0].end()) if found else None)
        assert last == (found[-1].end() if found else None)


TERMS = ["co-op", "alm", "new york", "c++", "risk", "value at risk"]


@QUICK
@given(st.lists(st.lists(st.sampled_from(["co-op", "coop", "alm", "ALM2", "new", "york", "new  york", "c++", "c", "risk", "Risky",
                                          "value at risk", "asset liability management", "var", "-", ","]), max_size=6), min_size=20, max_size=30))
def test_term_forms_agree(column, values):
    texts = [" ".join(v) for v in values]
    every = tm.expand(TERMS)
    rx = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(re.escape(t) for t in every) + r")(?![A-Za-z0-9])", re.I)
    want = [bool(rx.search(t)) for t in texts]
    assert column(lambda df: tm.contains_any(F.col("value"), TERMS), texts) == want
    assert column(lambda df: tm.contains_any_ngrams(F.col("value"), TERMS), texts) == want
    assert column(lambda df: tm.first_match(F.col("value"), TERMS), texts) == [(rx.search(t) or [None])[0] for t in texts]


def test_variants_are_one_hop():
    assert tm.variants("Value at Risk") == {"Value at Risk", "var"}
    assert tm.variants("VAR") == {"VAR", "value at risk", "value-at-risk"}
    assert tm.variants("credit") == {"credit"}


def test_fold_accents(column):
    values = ["México", "São Paulo", "Bogotá", "Ångström", "plain", "Zürich — x"]
    want = ["".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)) for v in values]
    assert column(lambda df: tx.fold_accents(F.col("value")), values) == want


def test_fold_accents_of_rare_letters(column):
    values = ["½ﬁ Ⅷ… ㎏ 한국 각", "x\U0001d400y\U0001f600é\n", "Ｆｕｌｌ ﷺ ™", "привет № й", "", (None,)]
    want = [None if v == (None,) else "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)) for v in values]
    assert column(lambda df: tx.fold_accents(F.col("value")), values) == want


def test_one_rare_letter_costs_no_look_per_letter(spark):
    long = spark.createDataFrame([("½",)], "value string").select(F.concat(F.repeat(F.lit("plain e "), 250_000), "value").alias("value"))
    began = time.monotonic()
    assert long.select(F.length(tx.fold_accents(F.col("value"))).alias("n")).first().n == 2_000_003
    assert time.monotonic() - began < 8


def test_links_and_keys(column):
    values = ["HTTPS://X.com/a/?utm_source=f&id=1&&gclid=2", "http://a.b/c/?utm_id=1", "a.b/c//", "", (None,), "x.com?a=b/"]
    assert column(lambda df: tx.normalize_link(F.col("value")), values) == ["x.com/a/?id=1", "a.b/c", "a.b/c", "", "", "x.com?a=b"]
    assert column(lambda df: tx.role_fingerprint(F.col("value"), F.lit("New York, NY")), ["Analyst R249058-2 (Risk)", "analyst risk"]) == [
        "analyst risk|new york ny"] * 2
    assert column(lambda df: tx.unicode_name_key(F.col("value")), ["Ｆirm & Co.", "STRASSE ß"]) == ["firmco", "strassess"]
    assert column(lambda df: tx.slug_guesses(F.col("value")), ["The Acme Group, Inc"]) == [["acme", "theacmegroupinc", "the-acme-group-inc"]]


def test_dates(column):
    day = F.lit("2026-11-20").cast("date")
    d = datetime.date
    assert column(lambda df: dt.posted_text_date(F.col("value"), day), ["Posted Today", "Posted Yesterday", "Posted 5 Days Ago", "Posted 30+ Days Ago", "x"]) == [
        d(2026, 11, 20), d(2026, 11, 19), d(2026, 11, 15), None, None]
    assert column(lambda df: dt.age_text_date(F.col("value"), day), ["about 2 weeks", "an hour", "3 months ago", "2026-01-02T00", "soon"]) == [
        d(2026, 11, 6), d(2026, 11, 20), d(2026, 8, 22), d(2026, 1, 2), None]
    assert column(lambda df: dt.loose_posted_date(F.col("value"), day), ["Tue Nov 03", "Mon Dec 28 00:00:00 EST", "Tue Nov 03 00:00:00 EST 2025", "2026-02-30", "x"]) == [
        d(2026, 11, 3), d(2025, 12, 28), d(2025, 11, 3), None, None]
    assert column(lambda df: dt.rfc822_date(F.col("value")), ["Tue, 03 Nov 2026 23:00:00 -0500", "bad"]) == [d(2026, 11, 3), None]
    assert column(lambda df: dt.epoch_date(F.col("value").cast("double")), ["1790380800000", "-1"]) == [d(2026, 9, 26), d(1969, 12, 31)]


def test_pay_sentence(column):
    rows = [("USD", "150000", "225000.4", "year"), ("usd", "60", "45.5", "1 HOUR"), ("USD", "0", "90000", None), ("USD", "0", "0", "year"),
            ("$", "1", "2", "year"), ("USD", "x", "2", "year"), ("EUR", "5000", "5000", "per-month-salary"), ("USD", "1", "2", "project")]
    got = column(lambda df: pay.pay_sentence(F.col("c"), F.col("lo"), F.col("hi"), F.col("u")), rows, "c string, lo string, hi string, u string")
    assert got == [" Compensation: USD 150,000 - 225,000 per year.", " Compensation: USD 45.5 - 60 per hour.", " Compensation: USD 90,000 per year.",
                   "", "", "", " Compensation: EUR 5,000 per month.", ""]


def test_annual_bounds(column):
    got = column(lambda df: pay.annual_bounds(F.col("value")), ["$90,000 - $120,000", "$45/hr (~$93.6k/yr)", "Unclear"])
    assert [g and (g["low"], g["high"]) for g in got] == [(90000.0, 120000.0), (93600.0, 93600.0), None]
