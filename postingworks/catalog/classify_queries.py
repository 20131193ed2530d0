"""Queries over description text composed from order columns, so the expected facts follow from the columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from postingworks.catalog.fixtures import fixture, select, wide_table
from postingworks.catalog.registry import query
from postingworks.functions import pay
from postingworks.functions.scale import spread
from postingworks.operators.experience import classify_experience
from postingworks.operators.salary import classify_salary
from postingworks.operators.sponsorship import classify_sponsorship, sponsorship_facets

C, L = F.col, F.lit

# pay: whole thousands from the order; wording by customer
_PAY = """SELECT o_orderkey, o_custkey, CAST(30 + o_custkey % 150 AS INT) AS lo, CAST(40 + o_custkey % 150 + o_orderkey % 20 AS INT) AS hi,
  CAST(o_custkey % 8 AS INT) AS shape FROM orders"""
_PAY_TEXT = """SELECT *, CASE shape
  WHEN 0 THEN CONCAT('Great team. The salary range is $', lo, ',000 - $', hi, ',000 per year plus bonus.')
  WHEN 1 THEN CONCAT('Base salary: $', lo, 'k to $', hi, 'k depending on skills.')
  WHEN 2 THEN CONCAT('Salary up to $', hi, ',000 depending on experience')
  WHEN 3 THEN CONCAT('Pay rate: $', lo, '/hr')
  WHEN 4 THEN CONCAT('Compensation includes a sign-on bonus of $', lo, ',000 and a 401(k) match')
  WHEN 5 THEN CONCAT('Min USD $', lo, ',000.00/Yr. Max USD $', hi, ',000.00/Yr. Job summary')
  WHEN 6 THEN CONCAT('We manage a $', lo, '0M portfolio and competitive salary reviews')
  ELSE CONCAT('Pay ranges: $', lo, ',000.00 - $', hi, ',000.00 for the location of: Ohio. $', lo + 5, ',000.00 - $', hi + 7, ',000.00 for the location of: Texas') END AS description
FROM pay"""


@query("salary_extraction", """
SELECT o_orderkey, CASE shape WHEN 0 THEN '$' || lo || ',000 - $' || hi || ',000' WHEN 1 THEN '$' || lo || ',000 - $' || hi || ',000'
  WHEN 2 THEN 'up to $' || hi || ',000' WHEN 3 THEN '$' || lo || '/hr (~$' || replace(printf('%.1f', lo * 2.08), '.0', '') || 'k/yr)'
  WHEN 5 THEN '$' || lo || ',000 - $' || hi || ',000'
  WHEN 7 THEN '$' || lo || ',000 - $' || CASE WHEN hi + 7 <= 2.2 * lo THEN hi + 7 ELSE hi END || ',000' ELSE 'Unclear' END AS salary,
  CASE WHEN shape = 7 AND hi + 7 <= 2.2 * lo THEN '[2 ranges listed' WHEN shape = 3 THEN '[converted from ' WHEN shape IN (4, 6) THEN '' ELSE 'plain' END AS note
FROM pay""", pay=_PAY)
def salary_extraction(spark, sf):
    rows = spark.sql(_PAY_TEXT.replace("FROM pay", "FROM {pay}"), pay=spread(select(spark, sf, _PAY)))
    ev = C("salary_evidence")
    note = (F.when(ev.startswith("[2 ranges listed"), "[2 ranges listed").when(ev.startswith("[converted from "), "[converted from ")
            .when(ev == "", "").otherwise("plain"))
    return classify_salary(rows).select("o_orderkey", "salary", note.alias("note"))


_YEARS = "SELECT o_orderkey, CAST(2 + o_custkey % 12 AS INT) AS n, CAST(o_custkey % 9 AS INT) AS shape FROM orders"
_YEARS_TEXT = """SELECT *, CASE shape
  WHEN 0 THEN CONCAT('You bring ', n, '+ years of experience in credit.')
  WHEN 1 THEN CONCAT('Requires ', n, '-', n + 3, ' years in a bank.')
  WHEN 2 THEN 'This is an entry-level role; three years of experience is a bonus.'
  WHEN 3 THEN CONCAT('Required qualifications: ', n, ' years of related experience in lending.')
  WHEN 4 THEN CONCAT('Preferred qualifications: ', n, ' years of experience in fintech.')
  WHEN 5 THEN CONCAT('A bank with more than ', n, ' years of experience serving clients.')
  WHEN 6 THEN 'Must be eighteen years of age or older and have prior work experience.'
  WHEN 7 THEN CONCAT('Bachelor degree in finance or ', n, ' years of related work experience')
  ELSE CONCAT('Minimum years of work experience: ', n, ' in any field') END AS description FROM years"""


@query("experience_extraction", """
SELECT o_orderkey, CASE WHEN shape IN (0, 1, 3, 8) THEN n WHEN shape = 2 THEN 0 END AS experience FROM years""", years=_YEARS)
def experience_extraction(spark, sf):
    rows = spark.sql(_YEARS_TEXT.replace("FROM years", "FROM {years}"), years=spread(select(spark, sf, _YEARS)))
    return classify_experience(rows).select("o_orderkey", "experience")


_VISA = "SELECT o_orderkey, CAST(o_custkey % 9 AS INT) AS shape FROM orders"
_VISA_TEXT = """SELECT *, CASE shape
  WHEN 0 THEN 'We do not provide visa sponsorship for this role.'
  WHEN 1 THEN 'Must be a U.S. citizen. We do not sponsor visas.'
  WHEN 2 THEN 'We will not sponsor now or in the future.'
  WHEN 3 THEN 'No sponsorship available. Candidates on STEM OPT or CPT are not considered.'
  WHEN 4 THEN 'We offer visa sponsorship for qualified candidates.'
  WHEN 5 THEN 'We cannot sponsor visas. Candidates on STEM OPT are welcome.'
  WHEN 6 THEN CONCAT('Order ', o_orderkey, ' says nothing of it.')
  WHEN 7 THEN 'Sponsorship Offered: No. We will not sign any documentation in support of OPT.'
  ELSE 'Secret clearance is required for this position.' END AS description FROM visa"""


@query("sponsorship_class", """
SELECT o_orderkey, CASE WHEN shape IN (1, 3, 7, 8) THEN 'Blocked' WHEN shape IN (0, 2, 5) THEN 'OPT Only' ELSE 'Unclear' END AS sponsorship_status,
  CASE shape WHEN 2 THEN '[now or future] ' WHEN 5 THEN '[STEM OPT welcome] ' WHEN 3 THEN '[no STEM OPT] ' ELSE '' END AS tag FROM visa""", visa=_VISA)
def sponsorship_class(spark, sf):
    rows = spark.sql(_VISA_TEXT.replace("FROM visa", "FROM {visa}"), visa=spread(select(spark, sf, _VISA)))
    return classify_sponsorship(rows).select("o_orderkey", "sponsorship_status",
                                             F.regexp_extract("sponsorship_evidence", r"^\[[^\]]+\] ", 0).alias("tag"))


@query("sponsorship_facets", """
SELECT o_orderkey, CASE WHEN shape IN (0, 1, 2, 5) THEN 'refused' WHEN shape = 3 THEN 'offered' ELSE 'not stated' END AS future_sponsorship,
  CASE shape WHEN 1 THEN 'required' WHEN 8 THEN 'clearance' ELSE 'not stated' END AS citizenship,
  CASE shape WHEN 8 THEN '...Secret clearance is required for this position....' WHEN 1 THEN '...Must be a U.S. citizen. We do not sponsor visas....' ELSE '' END AS citizenship_quote
FROM visa""", visa=_VISA)
def facets(spark, sf):
    rows = spark.sql(_VISA_TEXT.replace("FROM visa", "FROM {visa}"), visa=spread(select(spark, sf, _VISA)))
    return sponsorship_facets(rows).select("o_orderkey", "future_sponsorship", "citizenship", "citizenship_quote")


@query("document_facts", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'OPT Only' ELSE 'Unclear' END AS sponsorship_status, 5 AS experience,
  '$' || 60 + doc_id % 90 || ',000 - $' || 170 + doc_id % 90 || ',000' AS salary FROM documents""")
def document_facts(spark, sf):
    """All three readers over whole prose documents with one composed closing line."""
    text = F.concat(C("text"), L("\n"), F.when(C("doc_id") % 3 == 0, "We do not sponsor visas.").otherwise("Open to all."),
                    L(" Salary range $"), (60 + C("doc_id") % 90).cast("string"), L(",000 - $"), (170 + C("doc_id") % 90).cast("string"),
                    L(",000. Required: five years of experience."))
    rows = wide_table(spark, sf, "documents").select("doc_id", text.alias("description"))
    return classify_salary(classify_experience(classify_sponsorship(rows))).select("doc_id", "sponsorship_status", "experience", "salary")


@query("pay_sentence", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN '' WHEN l_linenumber % 2 = 0 THEN ' Compensation: USD ' || CAST(l_quantity AS INT) || ' - '
  || CAST(l_quantity AS INT) + 10 || ' per hour.' ELSE ' Compensation: EUR ' || CAST(l_quantity AS INT) || ',000 per year.' END AS sentence FROM lineitem""")
def pay_sentence(spark, sf):
    q = C("l_quantity").cast("int")
    hourly = C("l_linenumber") % 2 == 0
    low = F.when(hourly, q + 10).otherwise(q * 1000).cast("string")
    high = F.when(hourly, q).otherwise(q * 1000).cast("string")
    unit = F.when(C("l_linenumber") == 7, "per project").when(hourly, "HOUR").otherwise("")
    return wide_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", pay.pay_sentence(
        F.when(hourly, "usd").otherwise("eur"), low, high, unit).alias("sentence"))


@query("annual_bounds", """
SELECT id, CASE o_custkey % 5 WHEN 1 THEN 90000 WHEN 2 THEN 85000 WHEN 3 THEN 93600 END AS low,
  CASE o_custkey % 5 WHEN 1 THEN 120000 WHEN 2 THEN 85000 WHEN 3 THEN 93600 END AS high,
  CAST(o_custkey % 5 = 2 AS INT) AS partial FROM queue""")
def annual_bounds(spark, sf):
    rows = fixture(spark, sf, "queue")
    b = pay.annual_bounds(C("salary"))
    return rows.select("id", b["low"].cast("int").alias("low"), b["high"].cast("int").alias("high"),
                       F.coalesce(pay.is_partial(C("salary"), C("salary_evidence")), L(False)).cast("int").alias("partial"))
