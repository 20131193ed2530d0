"""Files, state tables, streams and the whole run."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from postingworks.functions import scale
from postingworks.operators.lifecycle import update_liveness
from postingworks.sources import buckets, files, json_boards, landing, shards, sinks
from postingworks.streaming import boards, snapshots


def test_shards_as_lines(spark, tmp_path):
    (tmp_path / "s1.json").write_text('{"A": {"jobs": [{"id": "1"}]}}\n\n{"B": {"jobs": []}, "C": {"jobs": null}}\n[1]\n')
    rows, bad = shards.read_shards(spark, str(tmp_path), layout="lines")
    assert sorted(r.company for r in rows.collect()) == ["A", "B", "C"]
    assert [tuple(r) for r in bad.collect()] == [("s1.json", "shard must be an object")]


def test_shards_are_merged_and_checked(spark, tmp_path):
    good = {"jobs": [{"id": "1", "title": "A", "desc": ""}, {"id": "2", "title": "B"}], "complete": True, "err": None, "secs": 2.5}
    (tmp_path / "s1.json").write_text(json.dumps({"A": good, "B": {"jobs": None, "complete": None, "err": "boom"}, "C": good}))
    (tmp_path / "s2.json").write_text(json.dumps({"C": dict(good, jobs=[]), "D": {"jobs": [{"id": " "}], "complete": "yes", "err": None}}))
    (tmp_path / "s3.json").write_text("[1, 2]")
    rows, bad = shards.read_shards(spark, str(tmp_path))
    assert [tuple(r) for r in bad.collect()] == [("s3.json", "shard must be an object")]
    companies = spark.createDataFrame([(c,) for c in "ABCDE"], "company string")
    checked = shards.for_companies(companies, shards.merge_checked(rows))
    facts = {r.company: r for r in shards.result_facts(checked).collect()}
    assert facts["C"].err == "conflicting shard results" and facts["E"].err == "shard result missing" and facts["B"].err == "boom"
    assert (facts["A"].complete, facts["A"].jobs_ok, facts["A"].n_jobs, facts["A"].secs) == (True, True, 2, 2.5)
    assert (facts["D"].complete, facts["D"].jobs_ok) == (None, False)
    last = {r.company: r.n_jobs for r in shards.result_facts(shards.merge_last(rows)).collect()}
    assert last["C"] == 0
    jobs = {r.posting_id: (r.has_desc, r.desc) for r in shards.result_jobs(checked.where("company = 'A'")).collect()}
    assert jobs == {"1": (True, ""), "2": (False, None)}


def test_text_files(spark, tmp_path):
    (tmp_path / "log").mkdir()
    lines = ["! Acme description for Analyst: HTTP 500", "! Acme description for Analyst: HTTP 502", "done: 3 companies, 2 closed, 1 reopened, x",
             "done: 3 companies, 5 closed, 0 reopened, x"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    assert [tuple(r) for r in files.log_failures(df).collect()] == [("Acme", "Analyst")]
    assert tuple(files.log_totals(df).first()) == (True, 5, 0)
    assert tuple(files.log_totals(df.where("line_no < 2")).first()) == (False, None, None)
    path = tmp_path / "t.csv"
    path.write_text("﻿Company,Role Title,Status\nAcme,\"A, B\",Applied\n", encoding="utf-8")
    row = files.read_tracker(spark, str(path), {"company": "Company", "role": "Role Title", "location": None, "link": None, "status": "Status"}).first()
    assert (row.company, row.role, row.link, row.status) == ("Acme", "A, B", None, "Applied")
    assert files.read_optional(spark, str(tmp_path / "none"), "id string").count() == 0
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "k1.txt").write_text("Role\nFirm\nLocation: NY\nLink: u\n\nbody\nmore")
    doc = files.read_documents(spark, str(tmp_path / "docs")).first()
    assert tuple(doc) == ("k1", "Role", "Firm", "NY", "u", "body\nmore")


def test_versions_replace_each_other(spark, tmp_path):
    folder = str(tmp_path / "state")
    assert sinks.read_table(spark, folder, "t", "id int").count() == 0
    sinks.replace_tables({"t": spark.range(3).selectExpr("cast(id as int) id")}, folder)
    old = sinks.read_table(spark, folder, "t", "id int")
    sinks.replace_tables({"t": old.where("id > 0")}, folder, "two")
    assert sorted(r.id for r in sinks.read_table(spark, folder, "t", "id int").collect()) == [1, 2]
    assert sinks.current_version(spark, folder)[1] == "two"
    assert old.count() == 3


DAYS = [datetime.date(2026, 11, d) for d in range(1, 8)]
SEEN = {  # posting -> days on which its board lists it
    "a:1": {0, 1, 2, 3, 4, 5, 6}, "a:2": {0, 1}, "a:3": {0, 1, 5, 6}, "a:4": {0, 2, 4, 6}, "a:5": {0, 1, 2, 3}, "b:1": {0, 3}, "b:2": {0, 1, 2, 3},
}
SCHEMA = ("id string, company string, posting_id string, last_seen_live date, miss_count int, closed_on date, closed_reason string, repost_count int, reposted_on date")


def snapshot_rows(day):
    rows = [(k[0], k[2:], DAYS[day], True, "lever") for k, days in SEEN.items() if day in days]
    return [r for r in rows if not (r[0] == "b" and day == 2)]


def test_stream_equals_batch_and_ignores_late_files(spark, tmp_path):
    schema = "company string, posting_id string, run_date date, complete boolean, board_type string"
    first = spark.createDataFrame([(k, k[0], k[2:], DAYS[0], 0, None, None, 0, None) for k in SEEN], SCHEMA)
    queue = first
    for day in range(7):
        rows = spark.createDataFrame(snapshot_rows(day), schema)
        facts = rows.groupBy("company").agg(F.lit(True).alias("complete"), F.lit("lever").alias("board_type"), F.count("posting_id").alias("n_jobs"))
        queue = spark.createDataFrame(update_liveness(queue, rows, facts, F.lit(DAYS[day]).cast("date")).drop("event").collect(), SCHEMA)
    source, folder, check = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "check")
    # three deliveries: days 0-3, then 4-6, then day 2 again, late
    for name, days in (("1", range(4)), ("2", range(4, 7)), ("3", [2])):
        spark.createDataFrame([r for d in days for r in snapshot_rows(d)], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        snapshots.follow_snapshots(stream, first, folder, check).awaitTermination()
    got = sinks.read_table(spark, folder, "queue", SCHEMA)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, queue.collect()), key=str)
    closed = {r.id for r in got.where("closed_on is not null").collect()}
    assert "a:2" in closed and "a:1" not in closed and "a:3" not in closed


def test_duplicate_deliveries_are_dropped(spark, tmp_path):
    schema = "ts timestamp, company string, posting_id string, run_date date"
    t = datetime.datetime(2026, 11, 1, 12)
    rows = [(t, "a", "1", t.date()), (t, "a", "1", t.date()), (t, "a", "2", t.date())]
    for _ in range(2):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = snapshots.distinct_sightings(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


ROWS = "company string, posting_id string, run_date date, complete boolean, board_type string"


def batch_queue(spark, first, days=range(7)):
    queue = first
    for day in days:
        rows = spark.createDataFrame(snapshot_rows(day), ROWS)
        facts = rows.groupBy("company").agg(F.lit(True).alias("complete"), F.lit("lever").alias("board_type"), F.count("posting_id").alias("n_jobs"))
        queue = spark.createDataFrame(update_liveness(queue, rows, facts, F.lit(DAYS[day]).cast("date")).drop("event").collect(), SCHEMA)
    return sorted(map(tuple, queue.collect()), key=str)


def follow(spark, tmp_path, name, deliveries, first, restart):
    """Lands deliveries (lists of days; a number alone is a heartbeat) as files and follows them, in one run or one run each."""
    source, log, check = (str(tmp_path / f"{name}-{x}") for x in ("in", "log", "check"))

    def run():
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source)
        boards.follow_boards(stream, first, log, check, late="2 days", silent_after=4).awaitTermination()

    for days in deliveries:
        rows = [("", None, DAYS[0] + datetime.timedelta(days=days), None, None)] if isinstance(days, int) else [
            r for d in days for r in snapshot_rows(d)]
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(source)
        if restart:
            run()
    if not restart:
        run()
    changes = spark.read.schema(boards.CHANGES).parquet(log)
    return sorted(map(tuple, boards.queue_after(first, changes).collect()), key=str), changes


def test_board_stream_equals_batch_whatever_the_order_and_restarts(spark, tmp_path):
    first = spark.createDataFrame([(k, k[0], k[2:], DAYS[0], 0, None, None, 0, None) for k in SEEN], SCHEMA)
    want = batch_queue(spark, first)
    # out of order within the lateness, a repeated day, then a day that is too late, then the end of time
    deliveries = [[1, 0], [2, 1], [4], [3, 3], [5, 6], [2], 30, 31]
    for restart in (False, True):
        got, changes = follow(spark, tmp_path, f"r{restart}", deliveries, first, restart)
        assert got == want
        silent = {(r.company, r.run_date) for r in changes.where("event = 'silent'").collect()}
        assert ("a", DAYS[6] + datetime.timedelta(days=4)) in silent
    # an incomplete listing never counts a miss, and an empty one changes nothing
    assert boards.entry_after(("a", DAYS[0], 1, None, None, 0, None), False, False, 2, False, DAYS[3])[0] is None


def test_rows_of_batch_and_keyed_state_agree_on_each_case():
    day, before = DAYS[3], DAYS[1]
    entry = ("x", before, 1, None, None, 0, None)
    assert boards.entry_after(entry, False, True, 2, False, day) == ("closed", ("x", before, 2, day, "removed", 0, None))
    assert boards.entry_after(entry, False, True, 6, False, day) == (None, ("x", before, 2, None, None, 0, None))
    assert boards.entry_after(entry, False, True, 2, True, day) == (None, ("x", day, 0, None, None, 0, None))
    closed = ("x", before, 2, before, "removed", 1, None)
    assert boards.entry_after(closed, True, True, 2, False, day) == ("reopened", ("x", day, 0, None, None, 2, day))
    assert boards.entry_after(closed, False, True, 2, False, day) == (None, closed)
    manual = ("x", before, 2, before, "manual", 1, None)
    assert boards.entry_after(manual, True, True, 2, False, day) == (None, ("x", day, 0, before, "manual", 1, None))


def files_of(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_run_rewrites_only_the_buckets_of_its_boards(spark, tmp_path):
    folder = tmp_path / "store"
    names = [f"board{i}" for i in range(40)]
    rows = [(f"{c}:{k}", c, str(k), DAYS[0], 1, None, None, 0, None) for c in names for k in range(5)]
    queue = spark.createDataFrame(rows, SCHEMA)
    buckets.create({"queue": queue, "seen": queue.select("company", "posting_id")}, str(folder), buckets=8)
    before = files_of(folder)
    old = buckets.read(spark, str(folder), "queue", SCHEMA)
    listing = spark.createDataFrame([("board3", "0"), ("board3", "1"), ("board3", "2"), ("board5", "4")], "company string, posting_id string")
    facts = spark.createDataFrame([("board3", True, "lever", 3), ("board4", True, "lever", 0)],
                                  "company string, complete boolean, board_type string, n_jobs int")
    mine = buckets.apply_liveness(spark, str(folder), SCHEMA, listing, facts, F.lit(DAYS[2]).cast("date"))
    assert mine == buckets.touched_buckets(spark, str(folder), facts.where("company = 'board3'")) and len(mine) == 1
    after = files_of(folder)
    assert {k: v for k, v in after.items() if k in before} == before                      # no file was touched
    fresh = {k.split("/")[2] for k in after if k not in before}
    assert fresh == {f"bucket={mine[0]}"} and all(k.startswith("queue/") for k in after if k not in before)
    want = update_liveness(queue, listing, facts.where("n_jobs > 0"), F.lit(DAYS[2]).cast("date")).drop("event")
    got = buckets.read(spark, str(folder), "queue", SCHEMA)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(got) == key(want) and key(got) != key(queue)
    assert key(old) == key(queue)                                                        # a job that began before goes on
    assert buckets.read(spark, str(folder), "seen", "company string, posting_id string").count() == len(rows)
    dropped = buckets.drop_unreferenced(spark, str(folder))
    assert dropped and key(buckets.read(spark, str(folder), "queue", SCHEMA)) == key(want)
    assert buckets.drop_unreferenced(spark, str(folder)) == []


def test_few_boards_leave_the_queue_in_place(spark):
    rows = [("a:1", "a", "1", 1), ("a:2", "a", "2", 0), ("b:3", "b", "3", 1), (None, None, "4", 1)]
    queue = spark.createDataFrame([(i, c, p, datetime.date(2026, 1, 5), m) for i, c, p, m in rows], "id string, company string, posting_id string, last_seen_live date, miss_count int").selectExpr(
        "*", "CAST(NULL AS DATE) AS closed_on", "CAST(NULL AS STRING) AS closed_reason", "0 AS repost_count", "CAST(NULL AS DATE) AS reposted_on", "'greenhouse' AS board_type")
    listing = spark.createDataFrame([("a", "2"), ("b", "9")], "company string, posting_id string")
    boards_ = spark.createDataFrame([("a", True, "greenhouse", 1), ("b", True, "workday", 1)], "company string, complete boolean, board_type string, n_jobs bigint")
    day = F.lit("2026-01-06").cast("date")
    assert scale.is_short(boards_)
    plans, found = [], []
    for short in (False, True):
        out = update_liveness(queue, listing, boards_, day, short=short)
        found.append(sorted(map(str, out.collect())))
        plans.append(out._jdf.queryExecution().optimizedPlan().toString().count("explode("))
    assert found[0] == found[1] and plans == [1, 0]


def test_bucket_edges(spark, tmp_path):
    folder = str(tmp_path / "store")
    kept = {"queue": SCHEMA}
    none = spark.createDataFrame([], SCHEMA)
    assert buckets.read(spark, folder, "queue", SCHEMA).count() == 0
    assert buckets.rewrite(spark, folder, none.select("company"), lambda t: t, kept) == []
    one = spark.createDataFrame([("a:1", "a", "1", DAYS[0], 0, None, None, 0, None), ("n:1", None, "1", DAYS[0], 0, None, None, 0, None)], SCHEMA)
    buckets.create({"queue": one}, folder, buckets=4)
    # a board whose rows all go leaves no bucket behind; boards without rows may come
    buckets.rewrite(spark, folder, one.select("company").where("company = 'a'"), lambda t: {"queue": t["queue"].where("1 = 0")}, kept)
    assert [r.id for r in buckets.read(spark, folder, "queue", SCHEMA).collect()] == ["n:1"]
    extra = one.where("company = 'a'").withColumn("company", F.lit("new"))
    buckets.rewrite(spark, folder, extra.select("company"), lambda t: {"queue": t["queue"].unionByName(extra)}, kept)
    assert buckets.read(spark, folder, "queue", SCHEMA).count() == 2

    def other_run(t):
        buckets.rewrite(spark, folder, extra.select("company"), lambda u: u, kept)
        return t

    with pytest.raises(buckets.Moved):
        buckets.rewrite(spark, folder, extra.select("company"), other_run, kept)
    assert buckets.read(spark, folder, "queue", SCHEMA).count() == 2


PAGE = "company string, board_type string, endpoint map<string,string>, site string, term string, page_no int, payload string"


def test_landed_payloads_are_read_by_path(spark, tmp_path):
    path = str(tmp_path / "landed")
    job = '<html><script type="application/ld+json">{"@type": "JobPosting", "title": "T", "description": "D"}</script></html>'
    rows = [("a", "greenhouse", {}, None, "", 0, '{"jobs": [{"id": 1, "title": "X", "location": {"name": "Y"}, "absolute_url": "u"}]}'),
            ("b", "greenhouse", {}, None, "", 0, "not json"), ("c", "lever", {}, None, "", 0, "[]"), ("d", "lever", {}, None, "", 0, None),
            ("e", "other", {}, None, "", 0, job), ("f", "other", {}, None, "", 0, "  <html>no node, plain text</html>"), ("g", "icims", {}, None, "", 0, "<li>")]
    pages = spark.createDataFrame(rows, PAGE)
    landing.land(pages.where("company < 'd'"), path)
    landing.land(pages.where("company >= 'd'"), path)                     # later pages are appended
    table = landing.landed(spark, path)
    day = F.lit("2026-11-01").cast("date")
    listed = landing.listings(table, day)
    assert [(r.company, r.posting_id, r.title, r.location) for r in listed.collect()] == [("a", "1", "X", "Y")]
    want = {r.company: r.n for r in json_boards.count_listed(pages).collect()}
    assert {r.company: r.n for r in landing.counts(table).collect()} == want
    facts = {r.company: (r.ld_title, r.ld_description) for r in landing.structured(table, day).collect()}
    assert facts["e"] == ("T", "D") and facts["f"][0] in (None, "") and set(facts) == {"e", "f", "g"}
    plan = listed._jdf.queryExecution().executedPlan().toString()
    read = next(line for line in plan.split("\n") if "FileScan" in line).partition("ReadSchema")[2]
    assert "payload" not in read.replace("landed_payloads", "") and "tree:struct" in read   # the paths asked for, and no payload
    assert "parse_json" not in plan and landing.listings(table.where("1 = 0"), day).count() == 0


def test_landed_pages_of_one_payload_are_dealt_out(spark, tmp_path):
    path = str(tmp_path / "landed")
    pages = spark.range(400).select(F.concat(F.lit("c"), "id").alias("company"), F.lit("ashby").alias("board_type"), F.create_map(F.lit("k"), F.lit("v")).alias("endpoint"),
                                    F.lit("main").alias("site"), F.lit("").alias("term"), F.lit(0).alias("page_no"), F.lit("<html>").alias("payload"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the runtime would join parts as small as these
    try:
        landing.land(pages, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    table = landing.landed(spark, path)
    assert len(table.inputFiles()) > 1 and "_salt" not in table.columns
    assert table.count() == table.select("company").distinct().count() == 400


class _Counted:
    """A state variable in memory that counts its calls."""

    def __init__(self, calls):
        self.calls, self.kept = calls, {}

    def getValue(self, key):
        self.calls.append("get")
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.calls.append("put")
        self.kept[key] = value

    def removeKey(self, key):
        self.calls.append("remove")
        self.kept.pop(key, None)

    def keys(self):
        self.calls.append("keys")
        return iter(list(self.kept))

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)


def test_board_moves_many_postings_per_call_to_its_store():
    import pandas as pd
    from postingworks.streaming import boards as live

    calls, timers = [], []

    class Handle:
        def getMapState(self, *names):
            return _Counted(calls)

        def getValueState(self, *names):
            return _Counted(calls)

        def registerTimer(self, at):
            timers.append(at)

    class Expired:
        def __init__(self, at):
            self.getExpiryTimeInMs = lambda: at

    n, day = 20_000, datetime.date(2026, 11, 2)
    names = [f"p{i}" for i in range(n)]
    board = live.Board()
    board.init(Handle())
    first = pd.DataFrame({"company": "a", "posting_id": [*names, None], "id": [*names, "none"], "last_seen_live": datetime.date(2026, 10, 1), "miss_count": 1,
                          "closed_on": None, "closed_reason": None, "repost_count": None, "reposted_on": None})
    board.handleInitialState(("a",), first.iloc[:n // 2], None)
    board.handleInitialState(("a",), first.iloc[n // 2:], None)
    seen = pd.DataFrame({"company": "a", "posting_id": [*names[:n - 3], names[0], None], "run_date": day, "complete": True, "board_type": "lever"})
    board.handleInputRows(("a",), iter([seen.iloc[:5000], seen.iloc[5000:], seen.iloc[:10]]), None)
    changes = pd.concat(list(board.handleExpiredTimer(("a",), None, Expired(timers[0]))))
    assert len(calls) < n / 4
    closed = changes[changes["event"] == "closed"]
    assert set(closed["id"]) == {*names[n - 3:], "none"} and set(closed["closed_on"]) == {day} and set(closed["miss_count"]) == {2}
    kept = changes[changes["event"].isna()]
    assert len(kept) == n - 3 and set(kept["miss_count"]) == {0} and set(kept["last_seen_live"]) == {day} and set(kept["repost_count"]) == {0}
    assert not board.waiting.kept and not board.days.kept
    assert list(board.handleExpiredTimer(("a",), None, Expired(timers[0]))) == []    # a day is applied once
