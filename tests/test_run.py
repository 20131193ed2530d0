"""The daily run over two days of a small landing."""

import datetime

from pyspark.sql import functions as F

from postingworks import schemas
from postingworks.operators.filters import FilterRules
from postingworks.plans import daily_run as plan

RULES = FilterRules(title_include=("risk",), title_exclude=("intern",))
LISTING = ("company string, posting_id string, title string, location string, url string, posted date, posted_source string, site string, "
           "description string, ord bigint")
D1, D2 = datetime.date(2026, 11, 1), datetime.date(2026, 11, 5)


def run_input(spark, rows, fetched):
    companies = spark.createDataFrame([(0, "A", "greenhouse"), (1, "B", "lever")], "ord int, company string, board_type string").withColumn(
        "endpoint", F.create_map(F.lit("date_from_id"), F.lit("false")))
    listing = spark.createDataFrame([(c, p, t, "NY", f"u{p}", D1, None, None, d, i) for i, (c, p, t, d) in enumerate(rows)], LISTING)
    facts = spark.createDataFrame(fetched, "company string, err string, complete boolean, jobs_ok boolean, n_jobs int, secs double")
    none = listing.where("1 = 0")
    details = none.selectExpr("company", "posting_id", "description as detail_description", "posted as detail_posted", "posted_source as detail_source",
                              "location as detail_location", "true as ok")
    return plan.RunInput(companies, facts, listing, details, none.selectExpr("company", "posting_id", "location as full_location"))


def test_two_runs(spark, tmp_path):
    folder = str(tmp_path / "state")
    first = run_input(spark, [("A", "1", "Risk Analyst R10001", "We do not sponsor visas."), ("A", "2", "Risk Intern", "x"), ("A", "3", "Risk Lead", "5+ years of work"),
                              ("A", "1", "Risk Analyst R10001", "We do not sponsor visas."), ("A", "9", "Cook", "x")],
                      [("A", None, True, True, 4, 1.0), ("B", "timeout", None, False, -1, 1.0)])
    result = plan.daily_run(first, plan.load(spark, folder), RULES, ("visas",), F.lit(D1).cast("date"))
    counters = {r.counter: r.n for r in result.counters.collect()}
    assert (counters["companies"], counters["errors"], counters["matched"], counters["opt_only"], counters["queued"], counters["alerted"]) == (1, 1, 2, 1, 1, 0)
    plan.save(result.state, folder)
    state = plan.load(spark, folder)
    queue = {r.id: r for r in state.queue.collect()}
    assert set(queue) == {"A:1", "A:3"} and state.queue.columns == [c.split()[0] for c in schemas.QUEUE.split(", ")]
    assert (queue["A:1"].state, queue["A:1"].kw_hits, queue["A:3"].experience, queue["A:3"].first_run) == ("opt_only", ["visas"], 5, True)
    assert {r.posting_id for r in state.seen.collect()} == {"1", "2", "3", "9"} and [r.company for r in state.seeded.collect()] == ["A"]
    assert [(r.posting_id, r.rule_term) for r in state.filtered.collect()] == [("2", "intern")]

    second = run_input(spark, [("A", "3", "Risk Lead", "x"), ("A", "4", "Risk Analyst R20002", "Salary range $100,000 - $120,000.")],
                       [("A", None, True, True, 2, 1.0), ("B", None, True, True, 0, 1.0)])
    result = plan.daily_run(second, state, RULES, (), F.lit(D2).cast("date"))
    counters = {r.counter: r.n for r in result.counters.collect()}
    assert (counters["matched"], counters["reposts"], counters["alerted"]) == (1, 1, 0)   # the re-listed role was already decided
    queue = {r.id: r for r in result.state.queue.collect()}
    assert (queue["A:1"].closed_on, queue["A:1"].closed_reason) == (D2, "reposted")
    new = queue["A:4"]
    assert (new.repost_of, new.repost_count, new.lineage_root, new.lineage_first_seen, new.salary) == ("A:1", 1, "A:1", D1, "$100,000 - $120,000")
    assert queue["A:3"].last_seen_live == D2


def test_outcomes_recall_and_retries(spark, tmp_path):
    folder = str(tmp_path / "state")
    ok = [("A", None, True, True, 3, 1.0), ("B", None, True, True, 0, 1.0)]
    rows = [("A", "1", "Risk Analyst", "x"), ("A", "2", "Treasury Analyst", "x"), ("A", "3", "Risk Lead", "x")]
    day = lambda d: F.lit(d).cast("date")
    first = plan.daily_run(run_input(spark, rows, ok), plan.load(spark, folder), RULES, (), day(D1), recall=True)
    plan.save(first.state, folder)
    state = plan.load(spark, folder)
    assert [r.sig for r in state.signature.collect()] == [plan.rules_signature(RULES)]

    wider = FilterRules(title_include=("risk", "treasury"), title_exclude=("intern",))
    marks = spark.createDataFrame([("A:1", "applied"), ("A:3", "nonsense")], "id string, mark string")
    alerts = spark.createDataFrame([("A:3", True, False)], "id string, failed_now boolean, delivered boolean")
    again = spark.createDataFrame([("A:3", datetime.date(2026, 10, 20), "exact")], "id string, detail_posted date, detail_source string")
    second = plan.daily_run(run_input(spark, rows, ok), state, wider, (), day(D2), outcomes=plan.Outcomes(marks=marks, alerts=alerts, reverified=again))
    assert second.recalled
    queue = {r.id: r for r in second.state.queue.collect()}
    assert (queue["A:1"].state, queue["A:3"].state, queue["A:2"].origin) == ("applied", "new", "recall")
    assert (queue["A:3"].alert_pending, queue["A:3"].alert_attempts) == (True, 1)
    assert (queue["A:3"].posted, queue["A:3"].posted_source, queue["A:3"].posted_reverified) == (datetime.date(2026, 10, 20), "exact", True)
    assert {r.counter: r.n for r in second.counters.collect()}["matched"] == 1
    assert [r.sig for r in second.state.signature.collect()] == [plan.rules_signature(wider)]
    plan.save(second.state, folder)

    failed = [("A", None, True, True, 3, 1.0), ("B", "timeout", None, False, -1, 1.0)]
    third = plan.daily_run(run_input(spark, rows, failed), plan.load(spark, folder), RULES, (), day(D2))
    assert third.recalled
    assert [r.sig for r in third.state.signature.collect()] == [plan.rules_signature(wider)]   # a failed board leaves it for the next run
    assert set(third.due) == {"closures", "renewals", "reverified", "reread"}
    assert all(df.count() == 0 for df in third.due.values())
