import random
import re

import numpy as np

from postingworks.llm import minhash
from postingworks.llm.components import components
from postingworks.llm.queries import QUERIES
from tests.llm.conftest import by_id


def sets_of(texts, words):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        out.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


def plain(texts, words):
    """n_shingles and component of each text, by comparing all pairs."""
    sets = sets_of(texts, words)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def copies(n, edits, seed, words=60):
    """A chain of copies, each a few words apart from one of those before it."""
    rng = random.Random(seed)
    out = [[f"w{rng.randrange(500)}" for _ in range(words)]]
    while len(out) < n:
        w = list(rng.choice(out[-3:]))
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"x{rng.randrange(500)}"
        out.append(w)
    return [" ".join(w) for w in out]


def test_links_equal_those_of_all_pairs(spark, documents):
    texts = [None, "", " \t\n", "one", "One", "a b", "A  B", "a b a b a b", "z " * 20_000, *copies(60, 2, 1), *copies(40, 4, 2),
             *copies(30, 1, 3, 12), *["exact copy of a text"] * 5]
    for words in (2, 5):
        got = by_id(minhash.near_duplicates(documents(texts, clashing=True), words=words))
        assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == plain(texts, words)


def test_a_large_group_and_strays(spark, documents):
    """One bucket group with many members and others that share buckets but not all links."""
    texts = copies(150, 1, 5, 80) + copies(80, 5, 6, 40) + [f"stray {i} text of its own" for i in range(30)]
    random.Random(1).shuffle(texts)
    got = by_id(minhash.digest(documents(texts)))
    want = plain(texts, 2)
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [
        (n, c, c == i) for i, (n, c) in enumerate(want)]


def test_estimate_is_near_the_likeness(spark):
    rng = np.random.default_rng(4)
    rows = []
    for shared in (0, 100, 250, 400, 500):
        both = rng.integers(1, 2**63, 1000 - shared).astype(np.uint64)
        a, b = both[:500], np.concatenate([both[:shared], both[500:]])
        rows.append((minhash.planes_of(minhash.minima(a)).tolist(), minhash.planes_of(minhash.minima(b)).tolist(),
                     shared / (1000 - shared)))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, j double")
    for r in df.select(minhash.estimate(df.a, df.b).alias("e"), "j").collect():
        assert abs(r.e - r.j) < 0.2


def test_components_of_chains_stars_and_rings(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(200, i) for i in range(201, 260)]
    ring = [(300 + i, 300 + (i + 1) % 20) for i in range(20)]
    links = spark.createDataFrame(chain + star + ring + [(5, 5), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 200 for i in range(201, 260)}, **{i: 300 for i in range(301, 320)}}
    assert components(links.where("false")).count() == 0


def test_kept_hands_all_columns_through(spark, documents):
    docs = documents(["same words in this text"] * 3 + [None, "", "other words in that text"], clashing=True)
    got = minhash.kept(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [0, 3, 4, 5]
    assert minhash.kept(docs.where("false")).count() == 0


def test_rows_without_id_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "x")], "doc_id long, text string")
    got = minhash.near_duplicates(docs, words=2).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == [(4, 4), (4, 4), (None, 4), (None, None)]


def test_many_rows_of_one_id_or_none(spark):
    texts = [f"{a} and {a} once more {i} with words of its own {a}" for i in range(60) for a in ("left", "right")]
    rows = [(None if i % 2 else 7, t + (" tail" if i % 4 > 1 else "")) for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash.near_duplicates(docs, words=2)
    assert got.count() == len(rows)
    want = {root for _, root in plain([t for _, t in rows], 2)}
    classes = {r["class"] for r in got.collect()}
    assert len(classes) >= len(want)


def test_query_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = by_id(QUERIES["op2_near_duplicates"](spark, "/root/testdata/sf0.001"))
    assert [(got[r.doc_id].n_shingles, got[r.doc_id].component_id) for r in docs] == plain([r.text for r in docs], 2)
