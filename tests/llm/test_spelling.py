import random
import re
import zlib
from collections import Counter

from postingworks.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_against_plain_comparison_of_all_words(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    words = []
    for s in stems:
        for k in (300, 40, 6):  # chains of forms: ever rarer words, each one edit from the last
            words += [s] * k
            at, c = rng.randrange(len(s) + 1), rng.choice("abcdeé")
            s = rng.choice([s[:at] + c + s[at:], s[:at] + s[at + 1:], s[:at] + c + s[at + 1:]])
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::50]).title() if i % 2 else "-".join(words[i::50])) for i in range(50)]
    rows += [(None, "nulled nulled nulled nulled nulled"), (51, None), (52, ""), (53, "1 2 _"), (54, "ties to ties" * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS word", "'x' AS n", "1 AS code", "2 AS form")
    want = expected(rows)
    got = result(spelling.digest(docs.repartition(3)))
    assert got == want
    assert sum(f is not None for f, *_ in got.values()) > 20
    assert any(f is not None and f != r for f, r, *_ in got.values())
    assert result(spelling.digest(docs.where("false"))) == {}


def test_long_words_ties_and_repeated_rows(spark):
    long = "ab" * 300
    rows = [(1, f"{long} {long}x aaaaaa aaaaab aaaaac"), (1, f"{long} {long}x aaaaaa aaaaab aaaaac"), *[(k, f"{long} aaaaab aaaaac aaaaaa " + "aaaaad " * 30
            + "aaaaae " * 30) for k in range(2, 40)], (3, (long + "x ") * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(spelling.digest(docs)) == expected(rows)
    twice = docs.unionAll(docs)
    assert result(spelling.digest(twice)) == expected(rows + rows)


def test_neighbourhoods_are_complete(spark):
    df = spark.createDataFrame([("0123",), ("0000",), ("4",)], "code string")
    for r in df.select("code", spelling.neighbourhood(df.code).alias("all")).collect():
        assert len(set(r.all)) == len(r.all)
        w, s = r.code, spelling.SYMBOLS
        assert set(r.all) == {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in s} | {
            w[:i] + c + w[i:] for i in range(len(w) + 1) for c in s}
