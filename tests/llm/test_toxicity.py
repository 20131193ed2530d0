import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from postingworks.llm import toxicity
from tests.llm.conftest import by_id

INSULTS = ["blockhead", "numbskull", "dimwit"]


def plain_kernel(a, b):
    """The sum over all common subsequences, by listing them."""
    def weights(w):
        out = Counter()
        for places in itertools.combinations(range(len(w)), toxicity.ORDER):
            out["".join(w[i] for i in places)] += toxicity.DECAY ** (places[-1] - places[0] + 1)
        return out

    x, y = weights(a), weights(b)
    return sum(v * y[k] for k, v in x.items())


def common(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        row = [0, *itertools.accumulate(zip(row, row[1:], b, strict=False), lambda left, x: max(left, x[1], x[0] + (c == x[2])), initial=0)][1:]
    return row[-1]


def test_kernel_and_bound_against_all_subsequences():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdé", k=rng.randint(4, 10))) for _ in range(60)] + ["idiot", "id*iot", "iddiiott", "aaaa", "aaaaaaaa"]
    marks = ["".join(rng.choices("abcdé", k=rng.randint(4, toxicity.LONGEST_LANDMARK))) for _ in range(11)] + ["idiot"]
    lengths = toxicity.common_lengths(toxicity.codes(words), marks)
    for j, m in enumerate(marks):
        got = toxicity.kernel(toxicity.codes(words), np.repeat(toxicity.codes([m], toxicity.LONGEST_LANDMARK), len(words), axis=0))
        for i, w in enumerate(words):
            want = plain_kernel(w, m)
            assert got[i] == pytest.approx(want, rel=1e-9, abs=1e-15)
            assert (lengths[i, j] >= toxicity.ORDER) == (want > 0)
            assert lengths[i, j] == common(w, m)
    model = toxicity.Model(marks)
    values = model.kernels(words)
    for i, j in itertools.product(range(0, len(words), 7), range(len(marks))):
        want = plain_kernel(words[i], marks[j]) / (plain_kernel(words[i], words[i]) * plain_kernel(marks[j], marks[j])) ** 0.5
        assert values[i, j] == pytest.approx(want, rel=1e-5)


def test_units():
    assert toxicity.units("You, I D I O T! and i-d-i-o-t (really) a bc x") == ["idiot", "i-d-i-o-t", "really"]
    long = "x" * 60
    assert toxicity.units(long) == ["x" * 24] * 4 and set("".join(toxicity.units("abcdefghijklmnop" * 4))) == set("abcdefghijklmnop")
    assert toxicity.units("") == toxicity.units(" . ! 1") == []
    for n in range(4, 80):  # every character is in a window
        word = "".join(chr(0x4E00 + k) for k in range(n))
        assert set("".join(toxicity.units(word))) == set(word)


def corpus(spark, n=700, seed=5):
    rng = random.Random(seed)
    syllables = ["ka", "to", "mi", "ra", "sen", "lo", "wa", "ne"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))

    def spoilt(w):
        at = rng.randrange(1, len(w))
        return rng.choice([w, w, w.upper(), w[:at] + rng.choice("*-.x") + w[at:], " ".join(w)])

    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(word() for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(1, 6))]
        toxic = i % 4 == 0
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + spoilt(rng.choice(INSULTS)) + " " + word()
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_rows_are_told_apart(spark):
    docs, labels, truth = corpus(spark)
    got = by_id(toxicity.digest(docs.selectExpr("*", "7 AS key", "'x' AS toxic", "1 AS decision", "2 AS units"), labels))
    assert len(got) == len(truth)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert min(got[i].predicted for i in held if truth[i]) == 1


def test_inserted_characters_and_gaps(spark):
    docs, labels, _ = corpus(spark)
    model = toxicity.fit(docs, labels)
    texts = ["ka to blockhead mi.", "ka to blo*ckhead mi.", "ka b l o c k h e a d mi.", "ka num-bskull.", "ra ra ne ne", "", None, "block a head",
             "kato " * 20_000, "kato " * 20_000 + "\n dimwit"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r._doc.doc_id: r.score for r in toxicity.scored(rows, model).collect()}
    assert all(got[i] >= 0.5 for i in (0, 1, 2, 3, 9)), got
    assert all(got[i] < 0.5 for i in (4, 5, 6, 8)), got
    assert got[5] == got[6]


def test_edges(spark, documents):
    docs = documents([None, "", "kato", "kato"], clashing=True)
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    none = toxicity.digest(docs, labels.where("false")).collect()
    assert [(r.score, r.predicted) for r in none] == [(0.0, 0)] * 4
    assert toxicity.digest(docs.unionAll(docs), labels).count() == 8
    assert toxicity.digest(docs.where("false"), labels).count() == 0
    some, known, _ = corpus(spark, 60)
    again = known.unionAll(known.selectExpr("doc_id", "0 AS toxic"))  # the greater of several labels holds
    left, right = (by_id(toxicity.digest(some, x)) for x in (known, again))
    assert left == right
