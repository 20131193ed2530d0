import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from postingworks.llm import debruijn, repeats, suffixes
from postingworks.llm.queries import QUERIES
from tests.llm.conftest import by_id


def plain_words(texts, window):
    lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def plain_bytes(texts, threshold):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + threshold] for b in data for i in range(len(b) - threshold + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - threshold + 1):
            if seen[b[i:i + threshold]] > 1:
                gone[i:i + threshold] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)

    def some(n, k):
        return " ".join(rng.choice("abcdefghij"[:k]) + rng.choice("xyz"[:max(1, k // 3)]) for _ in range(n))

    base = some(200, 9)
    out = [None, "", "   ", "a", "é " * 300, "é " * 150 + "z " + "é " * 60, "a" * 700, "ab" * 300, base, base,
           base[:150] + " zz " + base[160:], some(40, 2), some(60, 2)]
    for _ in range(30):
        w = base.split()
        i = rng.randrange(150)
        w[i:i + rng.randrange(4)] = [rng.choice("qrst")] * rng.randrange(3)
        out.append(rng.choice([" ", "\n"]).join(w[rng.randrange(30):]))
    return out + [some(rng.randrange(120), 9) for _ in range(30)]


@pytest.mark.parametrize("small", [False, True])
def test_both_equal_the_plain_versions(documents, texts, small, monkeypatch):
    if small:  # many blocks and ranges
        monkeypatch.setattr(repeats, "BLOCK_BYTES", 2000)
        monkeypatch.setattr(repeats, "RANGE_ITEMS", 64)
    docs = documents(texts, clashing=True)
    for window in (35, 5):
        got = by_id(debruijn.deduplicated(docs, window=window))
        assert [tuple(got[i])[1:4] for i in range(len(texts))] == plain_words(texts, window)
    for threshold in (200, 37, 3):
        got = by_id(suffixes.deduplicated(docs, threshold=threshold))
        want = plain_bytes(texts, threshold)
        assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == want
        assert all(sum(s["last"] - s["first"] for s in got[i].spans) == got[i].n_removed for i in range(len(texts)))


def test_paths_are_the_same_wherever_they_occur(documents):
    shared = " ".join(f"s{i}" for i in range(60))
    docs = documents([f"a1 {shared} b1", f"a2 {shared} b2", shared, "nothing here"])
    found = {r.id: [(p["start"], p["edges"], bytes(p["path"])) for p in r.paths] for r in debruijn.paths(docs).collect()}
    assert [p[1:] for p in found[0]] == [p[1:] for p in found[1]] == [p[1:] for p in found[2]]
    assert [(p[0], p[1]) for p in found[2]] == [(0, 26)]
    assert found[3] == []


def test_a_lone_path_removes_nothing(documents):
    """What a chance meeting of two hashes would leave: a path that no other place confirms."""
    assert debruijn._removed([{"start": 2, "edges": 3}], [2], 50, 35).sum() == 0
    assert debruijn._removed([{"start": 2, "edges": 3}], None, 50, 35).sum() == 37


def test_very_long_text(documents):
    docs = documents(["x" * 3_000_000, "word " * 300_000, "short"])
    got = by_id(suffixes.deduplicated(docs))
    assert [got[i].n_removed for i in range(3)] == [3_000_000, 1_500_000, 0]
    got = by_id(debruijn.deduplicated(docs))
    assert [got[i].n_removed for i in range(3)] == [0, 300_000, 0]


def test_empty_tables_and_bad_parameters(documents):
    none = documents(["a"]).where("false")
    assert debruijn.digest(none).count() == 0
    assert suffixes.digest(none).count() == 0
    with pytest.raises(ValueError):
        debruijn.paths(none, window=1)
    with pytest.raises(ValueError):
        suffixes.deduplicated(none, threshold=1)


def test_values_survive_packing():
    rng = np.random.default_rng(1)
    for values in (np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64)), np.array([7], dtype=np.uint64),
                   np.unique(np.concatenate([rng.integers(0, 2**20, 3000), rng.integers(0, 2**62, 9)]).astype(np.uint64))):
        assert np.array_equal(repeats.unpacked(repeats.packed(values, 0), 0), values)


def asked(blocks, bits, sides=None):
    """What each block's items are answered, over all ranges."""
    given = pa.concat_tables([pa.Table.from_batches([repeats.cells(b, h, bits, 64, sides and sides[b])]) for b, h in enumerate(blocks)])
    reduce = repeats._reduced(bits, 64, 2, sides is not None)
    out = pa.concat_tables([reduce(given.filter(pc.equal(given["part"], p))) for p in pc.unique(given["part"]).to_pylist()])
    flags = []
    for b in range(len(blocks)):
        mine = out.filter(pc.equal(out["block"], b)).combine_chunks().select(["level", "part", "bits"])
        flags.append(mine.to_struct_array().combine_chunks() if len(mine) else None)
    return flags


@pytest.mark.parametrize("bits", [0, 3, 11])
def test_answers_do_not_depend_on_the_ranges(bits):
    rng = np.random.default_rng(bits)
    spread = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (3000, 40, 1, 0, 900)]
    some = np.concatenate([spread[0][:500], spread[1][:20], np.arange(5, dtype=np.uint64), np.full(3, 2**64 - 1, dtype=np.uint64)])
    blocks = [rng.permutation(np.concatenate([x, rng.choice(some, len(x) // 2)])) for x in spread]
    seen = Counter(np.concatenate(blocks).tolist())
    flags = asked(blocks, bits)
    for own, f in zip(blocks, flags, strict=True):
        assert repeats.level_flags(f, 2, own, bits)[0].tolist() == [seen[x] > 1 for x in own.tolist()]
    sides = [tuple(rng.integers(0, 3, len(x)).astype(np.uint64) for _ in range(2)) for x in blocks]
    wanted = []
    for k in range(2):
        near = {}
        for own, side in zip(blocks, sides, strict=True):
            for x, y in zip(own.tolist(), side[k].tolist(), strict=True):
                near.setdefault(x, set()).add(y)
        wanted.append({x: len(y) == 1 and y != {int(repeats.MIXED)} for x, y in near.items()})
    flags = asked(blocks, bits, sides)
    for own, f in zip(blocks, flags, strict=True):
        got = repeats.level_flags(f, 2, own, bits, 64, 2)
        assert [g.tolist() for g in got] == [[w[x] for x in own.tolist()] for w in wanted]


def test_a_block_whose_answers_are_lost_is_refused():
    own = np.arange(100, dtype=np.uint64) << np.uint64(57)
    flags = asked([own], 4)[0]
    for bad in (None, flags[1:], flags[:-1]):
        with pytest.raises(ValueError):
            repeats.level_flags(bad, 2, own, 4)


def test_many_ranges_cost_little_more_than_few():
    """A block is dealt to more ranges the larger the table is; its time must be that of its items."""
    own = np.random.default_rng(3).integers(0, 2**64, 600_000, dtype=np.uint64)

    def seconds(bits):
        given = repeats.cells(0, own, bits)
        flags = pa.StructArray.from_arrays([pa.array(np.full(len(given), 2, np.int32)), given["part"], given["twice"]], ["level", "part", "bits"])
        took = []
        for _ in range(3):
            began = time.thread_time()
            repeats.cells(0, own, bits)
            repeats.level_flags(flags, 2, own, bits)
            took.append(time.thread_time() - began)
        return min(took)

    assert seconds(13) < 4 * seconds(2)


def test_first_round_ranges_are_alike():
    data = np.random.default_rng(4).integers(97, 123, 300_000).astype(np.uint8)
    sent = suffixes._sent(list(suffixes._pieces(data, np.array([0, 100_000, 300_000]), 200)), 40)
    counts = np.bincount((sent >> np.uint64(36)).astype(int), minlength=16)
    assert len(sent) > 4000
    assert counts.max() < 2 * counts.min()


def test_queries_equal_the_plain_versions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    texts = [r.text for r in docs]
    words, data = (by_id(QUERIES[q](spark, "/root/testdata/sf0.001")) for q in ("op3_substrings", "op5_suffixes"))
    assert [tuple(words[r.doc_id])[1:] for r in docs] == plain_words(texts, 35)
    assert [tuple(data[r.doc_id])[1:] for r in docs] == plain_bytes(texts, 200)
