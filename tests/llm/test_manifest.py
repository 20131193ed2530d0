import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from postingworks.llm import manifest
from tests.llm.conftest import by_id


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, place):
    out = []
    for level in tree[:-1]:
        run = place // 3 * 3
        out.append((level[run:place], level[place + 1:run + 3]))
        place //= 3
    return out


def expected(rows):
    """doc_id -> (leaf, subroot, root, proof hash, folded root), by plain lists; ids are unique here."""
    def leaf(r, text):
        return h(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, text)))

    sources = sorted({r.source for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r.source == s), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        trees[s] = (own, levels([leaf(r, r.text) for r in own]))
    top = levels([trees[s][1][-1][0] for s in sources])
    out = {}
    for k, s in enumerate(sources):
        own, tree = trees[s]
        for i, r in enumerate(own):
            steps = siblings(tree, i) + siblings(top, k)
            text = r.text
            if text is not None and zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 2 == 0:
                text = text.replace("\n", "")
            at = leaf(r, text)
            for left, right in steps:
                at = h(*left, at, *right)
            out[r.doc_id] = (tree[0][i], tree[-1][0], top[-1][0], h(*[x for a, b in steps for x in (*a, *b)]), at)
    return out


def check(docs):
    want = expected(docs.collect())
    got = by_id(manifest.digest(docs))
    assert {k: (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for k, r in got.items()} == want
    assert all(r.verified == (r.folded_root == r.root) for r in got.values())
    return got


@pytest.mark.parametrize("span", [3, 9])
def test_small_blocks_give_several_rounds(spark, documents, monkeypatch, span):
    monkeypatch.setattr(manifest, "LEVELS", {3: 1, 9: 2}[span])
    monkeypatch.setattr(manifest, "SPAN", span)
    sizes = F.expr("CASE WHEN doc_id < 60 THEN 'hot' WHEN doc_id < 61 THEN 'one' WHEN doc_id < 64 THEN 'three' ELSE 'four' END")
    check(documents([f"text {i}\nline {i % 7}" for i in range(68)]).withColumn("source", sizes))


def test_each_case(spark, documents):
    texts = [None, "", "a\nb", "a\nb", "no line end", "\n\n", "é中😀\n" * 20_000, "x"]
    docs = documents(texts, clashing=True)
    nulls = docs.selectExpr("CASE WHEN doc_id = 7 THEN NULL ELSE doc_id END AS doc_id", "text", "CASE WHEN doc_id % 3 = 0 THEN NULL "
                            "WHEN doc_id % 3 = 1 THEN 'Z' ELSE 'é' END AS source", "CASE WHEN doc_id > 3 THEN lang END AS lang", "n_chars")
    got = check(nulls)
    assert {r.verified for r in got.values()} == {True, False}
    assert check(docs)[4].verified
    assert manifest.digest(docs.where("false")).count() == 0
    assert len(check(docs.where("doc_id = 2"))) == 1


def test_repeated_rows_are_leaves_of_their_own(documents):
    docs = documents(["a", "b"])
    got = manifest.digest(docs.unionAll(docs)).collect()
    assert len(got) == 4
    assert len({r.leaf for r in got}) == 2
    assert all(r.folded_root == r.root for r in got)
