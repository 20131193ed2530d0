import zlib

import numpy as np
import pytest

from postingworks.llm import token_files
from postingworks.llm.queries import QUERIES
from postingworks.llm.tokens import Encoder, tokenizer_path

PATH = "byte_bpe_50k.json"


def some(n, seed=0):
    return np.minimum(np.random.default_rng(seed).zipf(1.3, n), 50_256).astype("<u4")


def test_segments_come_back_exactly():
    parts = [some(n, n) for n in (1, 0, 5, 1024, 1025, 131_072, 140_000, 3)]
    found = token_files.Segment(token_files.write_segment([5, None, *range(6)], [p.tobytes() for p in parts]))
    whole = np.concatenate(parts)
    assert np.array_equal(np.concatenate([found.block(i) for i in range(len(found.checkpoints))]), whole)
    assert np.array_equal(found.range(130_000, 140_000), whole[130_000:140_000])
    assert found.range(7, 7).size == 0
    assert found.documents["null"].tolist() == [0, 1, 0, 0, 0, 0, 0, 0]
    assert found.tokens == len(whole)


def test_extreme_tables():
    for ids in (np.zeros(5000, dtype="<u4"), np.arange(50_257, dtype="<u4"), np.concatenate([np.zeros(900_000), np.arange(50_257)]).astype("<u4")):
        found = token_files.Segment(token_files.write_segment([1], [ids.tobytes()]))
        assert int(found.freq.sum()) == 1 << token_files.SCALE
        assert int(found.freq.min()) >= 1
        assert np.array_equal(found.range(0, len(ids)), ids)
    empty = token_files.Segment(token_files.write_segment([], []))
    assert empty.tokens == 0
    assert len(empty.checkpoints) == 0


def test_damage_is_found():
    data = bytearray(token_files.write_segment([1], [some(5000).tobytes()]))
    data[-3] ^= 1
    with pytest.raises(ValueError):
        token_files.Segment(bytes(data)).block(0)
    with pytest.raises(ValueError):
        token_files.Segment(b"none" + bytes(data[4:]))


def test_files_read_back(spark, documents, tmp_path):
    texts = [None, "", "a", "same", "same", " lead  and\n tail ", "long " * 60_000, "é中😀" * 2000]
    docs = documents(texts, clashing=True)
    folder = str(tmp_path / "tokens")
    token_files.write(docs, folder, tokenizer_path(PATH))
    got = {r.doc_id: r for r in token_files.read(spark, folder).collect()}
    encode, start = Encoder(tokenizer_path(PATH), True).tokenizer, 0
    for i, text in enumerate(texts):
        ids = np.array([*encode.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    empty = str(tmp_path / "none")
    token_files.write(docs.where("false"), empty, tokenizer_path(PATH))
    assert token_files.read(spark, empty).count() == 0


def test_long_documents_span_blocks_and_segments(spark, documents, tmp_path, monkeypatch):
    texts = ["some words here " * n for n in (1, 50_000, 3, 20_000, 2)]
    folder = str(tmp_path / "tokens")
    token_files.write(documents(texts, parts=1), folder, tokenizer_path(PATH))
    got = token_files.read(spark, folder).orderBy("doc_id").collect()
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]


def test_query_numbers_all_tokens(spark):
    got = QUERIES["op7_token_files"](spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    assert len(got) == 200
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
