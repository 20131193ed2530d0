import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postingworks.llm import fingerprints
from postingworks.llm.queries import QUERIES
from tests.llm.conftest import by_id


def words(n, at=0):
    return " ".join(f"w{i * 7919 % 1009}" for i in range(at, at + n))


def test_pairs_follow_the_ids(documents, monkeypatch):
    texts = [None, "", "a", "ab cd ef", words(300), words(300), "é😀" * 400, words(5000, 50), "last"]
    for rows in (2000, 2):  # one slice and several
        monkeypatch.setattr(fingerprints, "ROWS_PER_SLICE", rows)
        got = by_id(fingerprints.digest(documents(texts, clashing=True)))
        plain = [t or "" for t in texts]
        for i, text in enumerate(plain):
            following, half = plain[(i + 1) % len(plain)], len(text) // 2
            edited = text[:len(text) - half] + following[:half]
            assert got[i].n_chars == len(text)
            assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            if edited == text:
                assert (got[i].fingerprint, got[i].near_edited) == (got[i].edited_fingerprint, 1.0)
            assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert got[4].fingerprint == got[5].fingerprint != ""
        assert got[4].near_next == 1.0
        assert got[1].fingerprint == got[0].fingerprint == ""
        assert got[0].near_next == 1.0 and got[1].near_next == 0.0


def test_choice_depends_on_the_stretch_alone(spark):
    """Anchors inside a shared stretch are the same in any text, and their places differ by one shift."""
    shared = words(200)
    df = spark.createDataFrame([(f"x y z {shared} tail", f"other start of a text here {shared}")], "a string, b string")
    row = df.select(fingerprints.anchors(F.col("a")).alias("a"), fingerprints.anchors(F.col("b")).alias("b")).select(
        "a", "b", fingerprints.shared_stretches(F.col("a"), F.col("b")).alias("s")).first()
    inside = {h.hash for h in row.a if 3 <= h.at and h.at + fingerprints.K <= 203}
    assert len(inside) > 50
    assert inside <= {h.hash for h in row.b}
    assert row.s[0]["shift"] == 3
    assert row.s[0]["n"] >= len(inside)


def test_every_window_of_syncmers_is_closed(spark):
    """Against a plain version of the rule on the same hashes."""
    df = spark.createDataFrame([(words(120),)], "t string")
    h = fingerprints.word_hashes(F.col("t"))
    row = df.select(h.alias("h"), fingerprints.anchors(F.col("t")).alias("a"), F.expr(
        "transform(sequence(0, 118), i -> xxhash64(xxhash64(split(t, ' ')[i]), xxhash64(split(t, ' ')[i + 1])))").alias("g")).first()
    k, s = fingerprints.K, fingerprints.S
    want = [i for i in range(len(row.h) - k + 1) if min(row.g[i:i + k - s + 1]) in (row.g[i], row.g[i + k - s])]
    assert [a.at for a in row.a] == want


def test_likeness_of_short_and_far_texts(spark):
    pairs = [(words(60), words(60)), (words(60), words(60, 500)), (words(60), words(30)), ("", ""), ("", "a"), ("a b", "a b"), (None, "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    near = [r[0] for r in df.select(fingerprints.likeness(fingerprints.sketch(F.col("a"))["hashes"], fingerprints.sketch(F.col("b"))["hashes"])).collect()]
    assert near[0] == 1.0 and near[1] < 0.1 and 0.3 < near[2] < 0.7 and near[3:] == [1.0, 0.0, 1.0, 1.0]


def test_rows_without_id_repeats_and_empty_tables(spark, documents):
    docs = spark.createDataFrame([(None, "n"), (3, "a"), (3, "a"), (5, "b")], "doc_id long, text string")
    got = fingerprints.digest(docs).collect()
    assert len(got) == 4
    follow = {(r.doc_id, r.edited_sha256) for r in got}
    assert len(follow) <= 4
    assert fingerprints.digest(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        fingerprints.anchors(F.col("text"), k=3, s=2)


def test_no_python_in_the_plan(spark):
    got = QUERIES["op9_fingerprints"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert got.count() == 200


def dice(a, b, size=fingerprints.SKETCH):
    """Likeness of two sets of anchor hashes by plain sets."""
    if not a or not b:
        return float(not a and not b)
    both = set(sorted(a | b)[:size])
    j = len(both & a & b) / len(both)
    return 2 * j / (1 + j)


def test_likeness_columns_against_plain_sets(spark, documents):
    rng = random.Random(2)
    chinese = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n)) for n in (30, 380, 400, 2000)]
    texts = [None, "one two", "three short words", "the quick brown fox jumps over it", *chinese, words(9), words(50), words(70), words(100, 40),
             words(900), "x" * 3000, "ties " * 200, words(50), "a", "same tail " + words(60)]
    got = by_id(fingerprints.digest(documents(texts, clashing=True)))
    plain = [t or "" for t in texts]
    edited = [t[:len(t) - len(t) // 2] + plain[(i + 1) % len(plain)][:len(t) // 2] for i, t in enumerate(plain)]
    df = spark.createDataFrame(list(enumerate(plain + edited)), "i int, t string")
    found = {r.i: [((a.hash >> 33) & 0x7FFFFFFF, a.at) for a in r.a] for r in df.select("i", fingerprints.anchors(F.col("t")).alias("a")).collect()}
    n = len(texts)
    for i in range(n):
        own, other, following = ({h for h, _ in found[k]} for k in (i, n + i, (i + 1) % n))
        assert got[i].near_edited == pytest.approx(dice(own, other), abs=1e-12)
        assert got[i].near_next == pytest.approx(dice(own, following), abs=1e-12)
        assert got[i].fingerprint == "".join(f"{h:08x}" for h in sorted(own)[:fingerprints.SKETCH])
        places = [{h: min(p for g, p in found[k] if g == h) for h in sorted({h for h, _ in found[k]})[:fingerprints.SKETCH]} for k in (i, n + i)]
        shifts = Counter(places[1][h] - p for h, p in places[0].items() if h in places[1])
        best = max(shifts.items(), key=lambda x: (x[1], -x[0]), default=(None, 0))
        assert (got[i].shift_edited, got[i].aligned_edited) == best
    # texts that share half are seen to, however short and with or without blanks
    assert all(got[i].near_edited > 0.3 for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)), [(i, got[i].near_edited) for i in range(n)]
