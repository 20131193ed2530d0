import random
import zlib

import numpy as np
import pytest

from postingworks.llm import packing
from postingworks.llm.queries import QUERIES
from postingworks.llm.tokens import Encoder, tokenizer_path

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


def sequences_of(plan, counts, capacity):
    cells, used = {}, {}
    for length, first, copies, sequence, offset in sorted(plan.steps):
        assert used.get(length, 0) == first
        used[length] = first + copies
        for i in range(copies):
            cells.setdefault(sequence + i, []).append((offset, length))
    assert used == counts
    for places in cells.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(cells) == plan.sequences
    return len(cells)


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j, room in enumerate(bins):
            if room + items[i] <= capacity and room not in bins[:j]:
                place(i + 1, [*bins[:j], room + items[i], *bins[j + 1:]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_reduction_loses_nothing_and_all_pieces_have_a_place():
    random.seed(1)
    excess = 0
    for _ in range(300):
        capacity = random.choice([10, 15, 20, 30])
        items = [random.randint(1, capacity) for _ in range(random.randint(1, 9))]
        counts = {s: items.count(s) for s in items}
        want = fewest(items, capacity)
        excess += sequences_of(packing.plan(counts, capacity), counts, capacity) - want
        reduced = packing.Plan(dict(counts), capacity)
        reduced.reduce()
        rest = [s for s, n in reduced.left.items() for _ in range(n)]
        assert reduced.fixed + (fewest(rest, capacity) if rest else 0) == want
    assert excess <= 2


def test_many_pieces_come_close_to_the_bound():
    random.seed(2)
    counts = {}
    for _ in range(100_000):
        s = min(2048, max(1, int(random.lognormvariate(6.3, 1))))
        counts[s] = counts.get(s, 0) + 1
    n = sequences_of(packing.plan(counts), counts, 2048)
    assert n <= 1.001 * -(-sum(s * k for s, k in counts.items()) // 2048) + 1


def test_bad_lengths_are_refused():
    with pytest.raises(ValueError):
        packing.plan({0: 1})
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


@pytest.mark.parametrize(("name", "blanks"), [(WORDS, False), (BYTES, True)])
def test_pieces_between_blanks_give_the_text_s_ids(name, blanks):
    random.seed(3)
    parts = [" ", "  ", "\n", " \n", "a", "b'", "'s", "Ab", "é", "é", "́", "1", "12", ".", "\t", "\x1c", "\x85",
             " ", "　", "<|endoftext|>", "😀", "!?", "中文", "\r\n", "'LL", "İ", "\x00", "A", "ÀÉ", "ŉ", "ß", "ſ", "Ĳ", "ɐ", ","]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(3000)] + [None, "", " " * 70]
    own = Encoder(tokenizer_path(name), blanks)
    whole = own.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert own.encode(texts) == [np.array(e.ids, dtype="<u4").tobytes() for e in whole]


def test_operator_on_odd_texts(spark, documents):
    texts = [None, "", " \n ", "a", "The same text", "The same text", "word " * 9000, "é" * 5000, "x 1 ! " * 700]
    rows = packing.digest(documents(texts, clashing=True), tokenizer_path(WORDS)).collect()
    encode = Encoder(tokenizer_path(WORDS), False).tokenizer
    got, places = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids = np.array([*encode.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert sorted(got[i]) == [(k, at, len(ids[at:at + 2048]), zlib.crc32(ids[at:at + 2048].tobytes()))
                                  for k, at in enumerate(range(0, len(ids), 2048))]
    for cells in places.values():
        assert sorted(cells)[0][0] == 0
        assert sum(n for _, n in cells) <= 2048
        assert [o for o, _ in sorted(cells)] == [sum(n for _, n in sorted(cells)[:k]) for k in range(len(cells))]
    assert packing.digest(documents(["a"]).where("false"), tokenizer_path(WORDS)).count() == 0


def test_query_covers_its_table(spark):
    rows = QUERIES["op1_packing"](spark, "/root/testdata/sf0.001")
    assert rows.select("doc_id").distinct().count() == 200
    assert rows.where("length < 1 OR length > 2048 OR offset + length > 2048").count() == 0
