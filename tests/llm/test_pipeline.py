import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from postingworks.llm.tokens import Encoder, tokenizer_path
from tests.llm.test_minhash import plain
from tests.llm.test_pii import plain_redaction

SOUNDS = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ein", "lich"]}
PASSAGE = "this exact passage of the benchmark has more than ten words in it"


def words(lang, n, rng):
    return ["".join(rng.choices(SOUNDS[lang], k=3)) for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    texts = []
    for i in range(150):
        texts.append((" ".join(words("aa" if i % 2 else "bb", rng.randint(20, 60), rng)), "aa" if i % 2 else "bb"))
    for i in range(0, 40, 2):  # copies with one word changed
        w = texts[i][0].split()
        w[rng.randrange(len(w))] = "anders"
        texts.append((" ".join(w), texts[i][1]))
    texts += [texts[3]] * 4
    texts += [(None, "aa"), ("", "aa"), ("12 34 !!", "bb")]
    texts += [(f"{t} {PASSAGE.title()} {t}", lang) for t, lang in texts[100:104]]
    texts += [(f"{t} mail a.b{i}@host.example.org or +1 (222) 555-12{i}4 now", lang) for i, (t, lang) in enumerate(texts[110:114])]
    texts.append((" ".join(words("bb", 4000, rng)), "bb"))
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, (t, lang) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(
        f"{path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, "never seen passage")], "item_id long, text string").coalesce(1).write.parquet(
        f"{path}/benchmark.parquet")
    return path, [t for t, _ in texts]


def expected(texts):
    """What the stages must leave: id to text, by plain Python."""
    left = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    ids = sorted(left)
    left = {ids[k]: left[ids[k]] for k, (_, root) in enumerate(plain([left[i] for i in ids], 5)) if root == k}
    gram = PASSAGE.split()
    windows = {tuple(gram[i:i + 10]) for i in range(len(gram) - 9)} | {("never", "seen", "passage")}

    def hit(text):
        w = re.findall("[0-9a-z]+", text.lower())
        return any(tuple(w[i:i + n]) in windows for n in (3, 10) for i in range(len(w) - n + 1))

    return {i: plain_redaction(t) for i, t in left.items() if not hit(t)}


def test_run_equals_a_plain_version(spark, folder):
    path, texts = folder
    want, encode = expected(texts), Encoder(tokenizer_path("word_bpe_49k.json"), False).tokenizer
    rows = entry.queries()["pipeline"](spark, path).collect()
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(pieces) == sorted(want)
    for i, text in want.items():
        ids = np.array([*encode.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        assert sorted(pieces[i]) == [(k, a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048].tobytes()))
                                     for k, a in enumerate(range(0, len(ids), 2048))]
    total = sum(p[2] for each in pieces.values() for p in each)
    assert all(sum(n for _, n in cells) <= 2048 for cells in places.values())
    assert len(places) <= -(-total // 2048) + 1


def test_stages_hand_all_columns_on(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({"spans": F.lit(1), "words": F.lit("w"), "score": F.lit(0.5)})
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, path)
        assert after.columns == docs.columns
        docs = after
    rows = {r.doc_id: r for r in docs.collect()}
    assert {i: r.text for i, r in rows.items()} == expected(texts)
    assert all(r.n_chars == len(r.text) for r in rows.values())


def test_empty_documents(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0


def test_all_names_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert {"op4_licenses", "op10_decontamination", "op11_manifest", "op12_spelling"} <= set(entry.oracle_sql())
