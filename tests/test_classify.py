"""Readers of description text, on rows written for them."""

import pytest

from postingworks.operators.experience import classify_experience
from postingworks.operators.salary import classify_salary
from postingworks.operators.sponsorship import classify_sponsorship, plain_abbreviations, sponsorship_facets

SALARY = [
    ("Pay: the salary range is $110,000 - $140,000 per year.", "$110,000 - $140,000"),
    ("Base salary: $80k to $95k", "$80,000 - $95,000"),
    ("Compensation $175,000", "$175,000"),
    ("Salary range: $110,000 — $140,000", "$110,000 - $140,000"),
    ("The pay range is between $61,000 and $99,500/year for this post", "$61,000 - $99,500"),
    ("Salary is 91,250 USD - 120,000 USD", "$91,250 - $120,000"),
    ("Salary Range 80,010.50USD -99,999.90 USD", "$80,010 - $99,999"),
    ("Salary $ 150-180K by experience", "$150,000 - $180,000"),
    ("Min USD $72,400.00/Yr. Max USD $99,800.00/Yr. Summary", "$72,400 - $99,800"),
    ("Minimum Salary: $55,000 per year Maximum Salary: $75,000 per year", "$55,000 - $75,000"),
    ("Base salary ranges from $100,000/year in one market up to $130,000/year in another", "$100,000 - $130,000"),
    ("Salary: £45,000 - £50,000 per annum", "£45,000 - £50,000"),
    ("Salary range: CAD $70,000 - $81,000", "C$70,000 - C$81,000"),
    ("Salary up to $125,000", "up to $125,000"),
    ("Starting salary: minimum of $70,000", "from $70,000"),
    ("Pay rate: $45/hr", "$45/hr (~$93.6k/yr)"),
    ("base pay is between $33.77 and $40.87 per hour", "$33.77 - $40.87/hr (~$70.2k - $85k/yr)"),
    ("salary of $7,000 - $9,000 per month", "$7,000 - $9,000/mo (~$84k - $108k/yr)"),
    ("Salary by place: $100,000 - $120,000 for Ohio. $110,000 - $140,000 for Texas.", "$100,000 - $140,000"),
    ("Salary range $100,000 - $120,000. Compensation: USD 100,000 - 120,000 per year.", "$100,000 - $120,000"),
    ("Salary range $100,000 - $120,000. " + "x " * 400 + "Compensation $200,000 - $250,000", "$100,000 - $120,000"),
    ("We run a $400M portfolio and review salary data", "Unclear"),
    ("Compensation includes a sign-on bonus of $30,000", "Unclear"),
    ("Compensation: bonus range $30,000 - $50,000 annually", "Unclear"),
    ("salary: 3 to 5 years, 2020 - 2024", "Unclear"),
    ("salary $45 - $55", "Unclear"),
    ("Minimum wage here is $19.97 per hour; compensation varies", "Unclear"),
    ("", "Unclear"),
    (None, "Unclear"),
]

EXPERIENCE = [
    ("Requires 3-5 years in banking", 3), ("7+ years of work", 7), ("minimum of 2 years", 2),
    ("An entry-level role; 5+ years is fine too", 0), ("Five or more years of related experience.", 5),
    ("Three (3) to six (6) years of experience in data", 3), ("One to two years of related experience in a bank", 1),
    ("MBA with 4 years of relevant experience in consulting", 4), ("Experience Required: 2-3 years", 2),
    ("Minimum Years of Work Experience: 6 more text", 6),
    ("A bank with more than 80 years of experience serving people.", None),
    ("We are a firm with over 20 years of experience.", None),
    ("Must be eighteen years of age and have work experience.", None),
    ("Preferred qualifications: five years of experience in fintech.", None),
    ("Two years of related experience preferred.", None),
    ("Bachelor's degree or three years of banking experience", None),
    ("No more than three years of experience", None),
    ("Required qualifications: four years of experience. Preferred qualifications: nine years of experience.", 4),
    ("", None), (None, None),
]

SPONSORSHIP = [
    ("We do not provide visa sponsorship for this role.", "OPT Only", ""),
    ("We will not sponsor now or in the future.", "OPT Only", "[now or future]"),
    ("Applicants must be authorized to work in the U.S. without current or future employer support.", "OPT Only", "[now or future]"),
    ("We cannot sponsor visas. Candidates on STEM OPT are welcome.", "OPT Only", "[STEM OPT welcome]"),
    ("No sponsorship available. Candidates on STEM OPT or CPT are not considered.", "Blocked", "[no STEM OPT]"),
    ("Must be a U.S. citizen.", "Blocked", ""), ("This post is subject to ITAR.", "Blocked", ""),
    ("We can only hire US citizens.", "Blocked", ""), ("CPT and OPT are restricted.", "Blocked", ""),
    ("We offer visa sponsorship for qualified people.", "Unclear", ""),
    ("We will not sponsor new industry registrations.", "Unclear", ""),
    ("Sponsorship: No longer needed.", "Unclear", ""), ("", "Unclear", ""), (None, "Unclear", ""),
]


@pytest.fixture(scope="module")
def read(spark):
    def run(classify, rows):
        df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "ord int, description string")
        return classify(df).orderBy("ord").collect()
    return run


def test_salary(read):
    got = read(classify_salary, SALARY)
    assert [r["salary"] for r in got] == [w for _, w in SALARY]
    by_text = {r["description"]: r["salary_evidence"] for r in got}
    assert by_text["Pay rate: $45/hr"].startswith("[converted from hourly pay] ")
    table = next(e for d, e in by_text.items() if d and d.startswith("Salary by place"))
    assert table.startswith("[2 ranges listed, widest shown] ")
    assert all(len(e) <= 400 for e in by_text.values())


def test_experience(read):
    got = read(classify_experience, EXPERIENCE)
    assert [(r["description"], r["experience"]) for r in got] == EXPERIENCE


def test_sponsorship(read):
    got = read(classify_sponsorship, SPONSORSHIP)
    assert [(r["description"], r["sponsorship_status"]) for r in got] == [(t, s) for t, s, _ in SPONSORSHIP]
    for row, (_, _, tag) in zip(got, SPONSORSHIP, strict=True):
        assert row["sponsorship_evidence"].startswith(tag)


def test_letters_of_other_scripts_keep_offsets(read):
    text = "Équipe 😀 à Montréal. Nous ne savons pas. We cannot sponsor visas now."
    row = read(classify_sponsorship, [(text,)])[0]
    assert row["sponsorship_status"] == "OPT Only"
    assert "cannot sponsor" in row["sponsorship_evidence"]
    assert row["sponsorship_evidence"].strip(".") in text + "..."


def test_abbreviations_keep_length(column):
    from pyspark.sql import functions as F
    values = ["the U.S.A. and U.S. and u.k. now", "U.S."]
    got = column(lambda df: plain_abbreviations(F.col("value")), values)
    assert got == ["the U S A  and U S  and u k  now", "U S "]
    assert [len(a) for a in got] == [len(v) for v in values]


def test_facets(read):
    row = read(sponsorship_facets, [("Must be legally authorized to work. A security clearance helps; visa sponsorship is available.",)])[0]
    assert (row["current_authorization"], row["citizenship"], row["future_sponsorship"]) == ("required", "clearance", "offered")
    assert row["citizenship_quote"].startswith("...") and "security clearance" in row["citizenship_quote"]
    empty = read(sponsorship_facets, [(None,)])[0]
    assert (empty["citizenship"], empty["citizenship_quote"]) == ("not stated", "")


def test_long_text_is_read_to_its_end(read):
    text = "word " * 30_000 + "We do not sponsor visas. Salary range $90,000 - $95,000. Required: two years of experience."
    assert read(classify_sponsorship, [(text,)])[0]["sponsorship_status"] == "OPT Only"
    assert read(classify_salary, [(text,)])[0]["salary"] == "$90,000 - $95,000"
    assert read(classify_experience, [(text,)])[0]["experience"] == 2
