import random
import zlib

import numpy as np
import pytest

from postingworks.llm import language
from postingworks.llm.queries import QUERIES
from tests.llm.conftest import by_id

SOUNDS = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["é", "que", "ou"]}


def text_in(lang, n, rng):
    return " ".join("".join(rng.choices(SOUNDS[lang], k=3)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [(i, text_in(lang, rng.randint(1, 60), rng), lang) for i, lang in enumerate(rng.choices(list(SOUNDS), k=400))]
    return out + [(400, None, "aa"), (401, "", "bb"), (402, "12 .. !!", "cc"), (403, text_in("bb", 30_000, rng), "bb"), (404, text_in("cc", 9, rng), None),
                  (None, text_in("aa", 9, rng), "aa")]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'x' AS lang_pred", "2 AS _text")


def test_held_out_documents_are_told(spark, rows):
    got = by_id(language.digest(table(spark, rows)))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows if i is not None)
    held = [(got[i].lang_pred, lang) for i, _, lang in rows[:400] if got[i].held_out]
    assert len(held) > 80
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert [(got[i].lang_pred, got[i].score) for i in (400, 401, 402)] == [("und", 0.0)] * 3
    assert (got[403].lang_pred, got[404].lang_pred, got[None].lang_pred) == ("bb", "cc", "aa")
    assert all(0 <= r.score <= 1 for r in got.values())


def test_only_text_decides(spark, rows):
    docs = table(spark, rows)
    model = language.fit(docs)
    a = by_id(language.predict(docs.select("doc_id", "text"), model).select("_doc.doc_id", "lang_pred", "score"))
    moved = docs.selectExpr("doc_id", "text", "'aa' AS lang", "'s' AS source")
    b = by_id(language.predict(moved, model).select("_doc.doc_id", "lang_pred", "score"))
    assert a == b


def test_held_out_labels_teach_nothing(spark, rows):
    wrong = [(i, t, "bb" if i is not None and zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    a, b = (language.fit(table(spark, r)) for r in (rows, wrong))
    assert a.languages == b.languages
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.idf, b.idf) and a.temperature == b.temperature


def test_one_language_none_and_empty_tables(spark):
    one = table(spark, [(i, "some words", "aa") for i in range(9)])
    assert {(r.lang_pred, r.score) for r in language.digest(one).collect()} == {("aa", 1.0)}
    none = table(spark, [(i, "some words", None) for i in range(9)])
    assert {(r.lang_pred, r.score) for r in language.digest(none).collect()} == {("und", 0.0)}
    assert language.digest(one.where("false")).count() == 0


def test_accepted_keeps_rows_whole(spark, rows):
    docs = table(spark, rows)
    kept = language.accepted(docs, language.fit(docs))
    assert kept.columns == docs.columns
    assert {400, 401, 402}.isdisjoint({r.doc_id for r in kept.collect()})
    assert kept.count() > 390
    nothing = language.Model([], np.zeros(language.DIMENSIONS), np.zeros((0, language.DIMENSIONS + 1)))
    assert sorted(r.doc_id for r in language.accepted(table(spark, [(1, "w", "a"), (2, "12", "a"), (3, None, "a"), (4, "", "a")]), nothing)
                  .collect()) == [1]


def test_frequencies_cover_all_texts(spark, rows):
    df, n = language.document_frequencies(table(spark, rows).select("text").repartition(5))
    want = np.zeros(language.DIMENSIONS, dtype=int)
    known = [language.counted(t) for _, t, _ in rows if t]
    for found in known:
        if found:
            want[found[0]] += 1
    assert np.array_equal(df, want)
    assert n == sum(f is not None for f in known)


def test_temperature_brings_scores_to_the_truth():
    rng = np.random.default_rng(3)
    scores = rng.normal(0, 1, (4000, 3))
    p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    target = np.array([rng.choice(3, p=row) for row in p])
    assert 4.0 < language.best_temperature(scores * 5, target) < 6.2


def test_query_on_the_given_tables(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = [r for r in QUERIES["op6_language"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in got) / len(got) > 0.95


def test_null_and_repeated_ids_and_rows_take_no_more_than_their_share(spark, monkeypatch):
    """Neither more rows than the sample reach the driver, nor do rows of one id or one text fill it."""
    rng = random.Random(5)
    odd = "zzz qqq " + "zq " * 5
    at = set(language.counted("zq")[0]) - set(language.counted("katomi schungein équeou")[0])
    rows = [(None, odd + text_in(lang, 20, rng), lang) for lang in ("aa", "bb") for _ in range(700)]
    # an id whose hash is small, and many copies of one row
    rows += [(7, odd + text_in(lang, 20, rng), lang) for lang in ("aa", "bb") for _ in range(300)]
    rows += [(11, odd + "kato", lang) for lang in ("aa", "bb") for _ in range(2000)]
    rows += [(i, text_in(lang, 20, rng), lang) for lang in ("aa", "bb") for i in range(20_000, 23_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    sizes, taught = [], []
    plain, learn = type(docs).collect, language.follow_the_leader
    monkeypatch.setattr(type(docs), "collect", lambda df: [sizes.append((len(r), df.columns)) or r for r in [plain(df)]][0])
    monkeypatch.setattr(language, "follow_the_leader", lambda examples, n: taught.extend(examples) or learn(examples, n))
    language.fit(docs, sample=400)
    assert max(n for n, columns in sizes if "at" in columns) <= 400
    assert 250 <= len(taught) <= 400
    share = sum(bool(at & set(a.tolist())) for a, *_ in taught) / len(taught)
    expected = sum(odd in t for _, t in {(i, t) for i, t, _ in rows if not language_held(i)}) / len({
        (i, t) for i, t, _ in rows if not language_held(i)})
    assert abs(share - expected) < 0.12


def language_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1
