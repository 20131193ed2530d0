import hashlib

import pytest

from postingworks.llm import decontamination
from postingworks.llm.queries import QUERIES
from tests.llm.conftest import by_id

LONG = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([
        (1, LONG.title(), 5), (2, "Short item, three!", 5), (2, "short ITEM three", 5), (3, None, 5), (4, " .. ", 5), (None, "no id", 5),
        (10, "two three four five six seven eight nine ten eleven", 5)], "item_id long, text string, words int")


def ids(*items):
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def test_each_case(documents, benchmark):
    texts = [None, "", "?!", "nothing of it", f"before {LONG} after", LONG.replace(" ", "-").upper(), "one two three four five six seven",
             "a short item three b SHORT, item. three", "has no id", "é " * 30_000 + LONG, LONG + " " + LONG]
    got = by_id(decontamination.digest(documents(texts, clashing=True), benchmark))
    seen = {i: (got[i].n_words, got[i].n_hit, got[i].n_items) for i in range(len(texts))}
    assert seen == {0: (0, 0, 0), 1: (0, 0, 0), 2: (0, 0, 0), 3: (3, 0, 0), 4: (14, 12, 2), 5: (12, 12, 2), 6: (7, 0, 0), 7: (8, 6, 1),
                    8: (3, 2, 0), 9: (30_012, 12, 2), 10: (24, 24, 2)}
    assert got[4].items_sha256 == ids("1", "10")
    assert got[3].items_sha256 == ids()
    assert [i for i in got if got[i].contaminated] == [i for i in got if seen[i][1]]


def test_windows_beyond_the_broadcast_bound_give_the_same(documents, benchmark):
    docs = documents([None, f"x {LONG} y", "short item three", "clean"])
    rows = [sorted(map(str, decontamination.contamination(docs, benchmark, broadcast_windows=n).collect())) for n in (0, 10_000)]
    assert rows[0] == rows[1]


def test_removal(documents, benchmark):
    docs = documents([None, f"Before, {LONG}; after.", "A short-item three!", "clean text"], clashing=True)
    left = decontamination.decontaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(by_id(left)) == [0, 3]
    spans = by_id(decontamination.decontaminated(docs, benchmark, remove="spans"))
    assert spans[0].text is None
    assert spans[1].text.split() == ["Before,", ";", "after."]
    assert spans[2].text == "A - !"
    assert spans[3] == by_id(docs)[3]
    with pytest.raises(ValueError):
        decontamination.decontaminated(docs, benchmark, remove="words")


def test_empty_tables_and_repeated_rows(documents, benchmark):
    docs = documents(["short item three", "x"])
    assert decontamination.digest(docs.where("false"), benchmark).count() == 0
    assert [r.n_hit for r in decontamination.digest(docs, benchmark.where("false")).collect()] == [0, 0]
    for n in (0, 10_000):
        found = decontamination.contamination(docs.unionAll(docs.unionAll(docs)), benchmark, broadcast_windows=n).collect()
        assert sorted((r.doc_id, r.n_hit) for r in found) == [(0, 3)] * 3 + [(1, 0)] * 3
    assert decontamination.decontaminated(docs.unionAll(docs), benchmark).count() == 2


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op10_decontamination"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
