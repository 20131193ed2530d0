import random

import pytest

from postingworks.llm import licenses
from postingworks.llm.queries import QUERIES
from tests.llm.conftest import by_id

MIT = licenses.TEMPLATES["MIT"]


def test_each_case(spark, documents):
    texts = [None, "", "word", " \n\n ", "Nothing licensed here at all.", "Prose first.\nReleased under the MIT License.\nProse after.",
             "released UNDER the mit license", MIT, "Intro line\n\n" + MIT[:300] + "\n" + MIT[300:] + "\n\nMore prose here.",
             "prose " * 30_000 + "\nLicensed under CC BY-NC 4.0.\n", "Released under the MIT License.\nLicensed under CC BY-NC 4.0."]
    got = by_id(licenses.digest(documents(texts, clashing=True), licenses.templates(spark)))
    found = [got[i].license for i in range(len(texts))]
    assert found == [None, None, None, None, None, "MIT-line", "MIT-line", "MIT", "MIT", "CC-BY-NC-4.0-line", "CC-BY-NC-4.0-line"]
    # the distinct bigrams of text 9 as a whole are few enough to match as well
    assert [got[i].n_matches for i in (0, 5, 9, 10)] == [0, 1, 2, 2]
    assert got[10].licenses == "CC-BY-NC-4.0-line,MIT-line"
    assert got[7].dice == 1.0


def test_changed_words_lower_the_score(spark, documents):
    words = MIT.split()
    texts = [" ".join(words[:k] + ["changed"] + words[k + 1:]) for k in (10, 50)] + [" ".join(words[:60])]
    got = by_id(licenses.digest(documents(texts), licenses.templates(spark)))
    assert all(0.9 < got[i].dice < 1.0 for i in (0, 1))
    assert got[2].license is None


def test_ties_repeats_and_empty_tables(spark, documents):
    table = spark.createDataFrame([("b", "same template words"), ("a", "same template words"), ("c", "word"), ("d", None)],
                                  "license string, text string")
    docs = documents(["same template words", "x"])
    got = by_id(licenses.digest(docs.unionAll(docs), table))
    assert (got[0].license, got[0].dice, got[1].license) == ("a", 1.0, None)
    assert licenses.digest(docs.unionAll(docs.unionAll(docs)), table).count() == 6
    assert licenses.digest(docs.where("false"), table).count() == 0
    assert [r.license for r in licenses.digest(docs, table.where("false")).collect()] == [None, None]
    assert licenses.scan(docs, table, broadcast_bigrams=0).count() == 2
    with pytest.raises(ValueError):
        licenses.scan(docs, table, threshold=0)


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op4_licenses"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "ArrowEval" not in plan and "BatchEvalPython" not in plan


def paragraphs(text, n):
    w = text.split()
    return "\n\n".join(" ".join(w[i * len(w) // n:(i + 1) * len(w) // n]) for i in range(n))


def test_licences_inside_longer_texts(spark, documents):
    """Every template, of several paragraphs, between code or prose, and notices in the middle of a line."""
    every = licenses.TEMPLATES | licenses.FURTHER
    prose = " ".join(f"w{i} about thing{i % 97}" for i in range(900))
    names = sorted(every)
    texts = [prose + "\n\n" + paragraphs(every[n], 3) + "\n\nint main() { return 0; }\n" + prose for n in names]
    texts += [prose + " " + every[n] + " " + prose for n in names]
    texts += [prose, prose + "\n\n" + paragraphs(MIT, 3) + "\n\n" + prose + "\n\n" + paragraphs(every["BSD-3-Clause"], 4) + "\n" + prose]
    got = by_id(licenses.digest(documents(texts), licenses.templates(spark)))
    assert [got[i].license for i in range(2 * len(names))] == names * 2
    assert all(got[i].dice > 0.97 for i in range(2 * len(names)))
    assert got[2 * len(names)].n_matches == 0
    assert got[2 * len(names) + 1].licenses == "BSD-3-Clause,MIT"


def test_windows_equal_brute_force(spark, documents):
    """Planted texts with changed words: found where some window reaches the threshold, and with its Dice nearly."""
    rng = random.Random(2)
    base = [f"t{i}" for i in range(24)]
    table = spark.createDataFrame([("x", " ".join(base))], "license string, text string")
    texts = []
    for _ in range(60):
        part = [w if rng.random() > 0.07 else f"c{rng.randint(0, 99)}" for w in base]
        part.insert(rng.randint(0, 23), "added " * rng.randint(0, 6))
        noise = [[f"n{rng.randint(0, 50)}" for _ in range(rng.randint(80, 200))] for _ in range(2)]
        texts.append(" ".join(noise[0] + part + noise[1]))
    got = by_id(licenses.digest(documents(texts), table))
    want = set(zip(base, base[1:], strict=False))
    for i, text in enumerate(texts):
        w = text.split()
        best = 0.0
        for a in range(len(w)):
            for b in range(a + 13, min(a + 40, len(w)) + 1):
                grams = set(zip(w[a:b], w[a + 1:b], strict=False))
                best = max(best, 2 * len(grams & want) / (len(grams) + len(want)))
        assert (got[i].license == "x") == (best >= 0.8)
        assert got[i].license is None or abs(got[i].dice - best) < 1e-6
