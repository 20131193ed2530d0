"""Token files: ids under a static range asymmetric numeral system (rANS), in independent interleaved blocks.

A file is a folder of Parquet rows, each row one segment; segments are numbered by (part, segment) in ascending order of
document id. A segment holds whole documents, about `SEGMENT_TOKENS` tokens, and is little-endian:

    magic "RTF1" | tokens u64 | documents u32 | blocks u32 | table bytes u32
    table        zlib of: symbols u32 | symbol u32 each, ascending | frequency u32 each, sum 2**SCALE
    documents    doc_id i64 | null flag u8 | tokens u64, each
    checkpoints  first token u64 | tokens u32 | crc32 of its ids u32 | payload bytes u32, each block
    payloads

The frequency table is shared by the segment's blocks. A block is `LANES` interleaved coders of 64-bit state that give up
32-bit words: its payload is the final states followed by the words in reading order; token t belongs to lane t mod LANES.
A checkpoint says where a block's tokens and bytes begin and what its ids add up to, so any block is decoded and checked
alone, and any range of tokens touches only the blocks it meets.

Defined cases: a null text is empty; the end id closes every document; a null id is kept and sorts first; rows that agree
in id are kept apart in order of their texts' hash; no rows give an empty folder that reads back as no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postingworks.llm.tokens import END, encoder, in_slices
from postingworks.session import run_folder

SCALE = 20
LANES = 1024
BLOCK_TOKENS = 1 << 17
SEGMENT_TOKENS = 1 << 21
MAGIC = b"RTF1"
MOST_KEPT = 600_000  # words whose ids a worker keeps, in each of two generations
SLICE = 8 << 20  # characters encoded at once
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sQIII")
DOCUMENT = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("tokens", "<u8")])
CHECKPOINT = np.dtype([("first", "<u8"), ("tokens", "<u4"), ("crc", "<u4"), ("bytes", "<u4")])


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Whole frequencies of the counted symbols (all counts over 0), each 1 at least, with the sum 2**scale."""
    whole = 1 << scale
    if len(counts) > whole:
        raise ValueError("more symbols than the scale can tell apart")
    f = np.maximum(1, counts * whole // max(1, int(counts.sum()))).astype(np.int64)
    order = np.argsort(-f, kind="stable")
    over = int(f.sum()) - whole
    if over < 0:
        f[order[0]] -= over
    while over > 0:  # the minimum of 1 took more than there was: the most frequent give it back
        spare = np.maximum(0, f[order] // 2)
        take = np.minimum(spare, np.maximum(0, over - np.concatenate([[0], np.cumsum(spare)[:-1]])))
        f[order] -= take
        over -= int(take.sum())
    return f


def encode_block(symbols: np.ndarray, freq: np.ndarray, start: np.ndarray, lanes: int = LANES, scale: int = SCALE) -> bytes:
    """The payload for places in the frequency table."""
    n = len(symbols)
    x = np.full(lanes, LOW, dtype=np.uint64)
    words = []
    f_all, c_all = freq.astype(np.uint64)[symbols], start.astype(np.uint64)[symbols]
    limit = np.uint64(63 - scale)
    for at in range((n - 1) // lanes * lanes, -1, -lanes) if n else ():
        f, c = f_all[at:at + lanes], c_all[at:at + lanes]
        y = x[:len(f)]
        full = y >= (f << limit)
        if full.any():
            words.append((y[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            y = np.where(full, y >> np.uint64(32), y)
        q = y // f
        x[:len(f)] = (q << np.uint64(scale)) + (y - q * f) + c
    return x.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode_block(payload: bytes | memoryview, n: int, freq: np.ndarray, start: np.ndarray, slot_symbol: np.ndarray,
                 lanes: int = LANES, scale: int = SCALE) -> np.ndarray:
    """The `n` places in the frequency table that a payload holds."""
    x = np.frombuffer(payload, dtype="<u8", count=lanes).astype(np.uint64)
    words = np.frombuffer(payload, dtype="<u4", offset=8 * lanes).astype(np.uint64)
    out = np.empty(n, dtype=np.int64)
    f_all, c_all = freq.astype(np.uint64), start.astype(np.uint64)
    mask, used = np.uint64((1 << scale) - 1), 0
    for at in range(0, n, lanes):
        y = x[:min(lanes, n - at)]
        slot = y & mask
        symbol = slot_symbol[slot]
        out[at:at + lanes] = symbol
        y = f_all[symbol] * (y >> np.uint64(scale)) + slot - c_all[symbol]
        short = y < LOW
        need = int(np.count_nonzero(short))
        if need:
            y[short] = (y[short] << np.uint64(32)) | words[used:used + need]
            used += need
        x[:len(y)] = y
    if used != len(words) or not (x == LOW).all():
        raise ValueError("a block does not end where it began: its payload is damaged")
    return out


def write_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A segment from documents and their ids (little-endian unsigned 32-bit)."""
    tokens = np.frombuffer(b"".join(ids), dtype="<u4")
    counts = np.bincount(tokens) if len(tokens) else np.zeros(0, dtype=np.int64)
    symbols = np.flatnonzero(counts)
    freq = frequencies(counts[symbols]) if len(symbols) else np.zeros(0, dtype=np.int64)
    start = np.cumsum(freq) - freq
    place = np.zeros(len(counts), dtype=np.int64)
    place[symbols] = np.arange(len(symbols))
    table = zlib.compress(struct.pack("<I", len(symbols)) + symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 1)
    docs = np.zeros(len(doc_ids), dtype=DOCUMENT)
    docs["doc_id"] = [d or 0 for d in doc_ids]
    docs["null"] = [d is None for d in doc_ids]
    docs["tokens"] = [len(x) // 4 for x in ids]
    firsts = range(0, len(tokens), BLOCK_TOKENS)
    payloads = [encode_block(place[tokens[a:a + BLOCK_TOKENS]], freq, start) for a in firsts]
    points = np.zeros(len(payloads), dtype=CHECKPOINT)
    points["first"] = list(firsts)
    points["tokens"] = [len(tokens[a:a + BLOCK_TOKENS]) for a in firsts]
    points["crc"] = [zlib.crc32(tokens[a:a + BLOCK_TOKENS].tobytes()) for a in firsts]
    points["bytes"] = [len(p) for p in payloads]
    return b"".join([HEAD.pack(MAGIC, len(tokens), len(docs), len(payloads), len(table)), table, docs.tobytes(),
                     points.tobytes(), *payloads])


class Segment:
    """A segment opened for reading; blocks are decoded when asked for."""

    def __init__(self, data: bytes) -> None:
        magic, self.tokens, docs, blocks, size = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("this is no token segment")
        at = HEAD.size
        table = zlib.decompress(data[at:at + size])
        at += size
        n = struct.unpack_from("<I", table)[0]
        self.symbols = np.frombuffer(table, "<u4", n, 4)
        self.freq = np.frombuffer(table, "<u4", n, 4 + 4 * n).astype(np.int64)
        self.start = np.cumsum(self.freq) - self.freq
        self.slots = np.repeat(np.arange(n), self.freq)
        self.documents = np.frombuffer(data, DOCUMENT, docs, at)
        at += docs * DOCUMENT.itemsize
        self.checkpoints = np.frombuffer(data, CHECKPOINT, blocks, at)
        at += blocks * CHECKPOINT.itemsize
        self.places = at + np.concatenate([[0], np.cumsum(self.checkpoints["bytes"].astype(np.int64))])
        self.data = memoryview(data)

    def block(self, i: int) -> np.ndarray:
        """The ids of one block, checked."""
        point = self.checkpoints[i]
        places = decode_block(self.data[self.places[i]:self.places[i + 1]], int(point["tokens"]), self.freq, self.start, self.slots)
        ids = self.symbols[places].astype("<u4")
        if zlib.crc32(ids.tobytes()) != point["crc"]:
            raise ValueError(f"block {i} fails its checksum")
        return ids

    def range(self, first: int, last: int) -> np.ndarray:
        """Ids first to last (exclusive) of the segment, from the blocks they touch."""
        a = int(np.searchsorted(self.checkpoints["first"], first, side="right")) - 1
        b = int(np.searchsorted(self.checkpoints["first"], last, side="left"))
        if first >= last:
            return np.empty(0, dtype="<u4")
        whole = np.concatenate([self.block(i) for i in range(a, b)])
        skip = first - int(self.checkpoints["first"][a])
        return whole[skip:skip + last - first]


def write(docs: DataFrame, folder: str, path: str, *, blanks: bool = True, end: bytes = END, id_col: str = "doc_id",
          text_col: str = "text") -> None:
    """Writes the ids of all documents to `folder`, in ascending order of id."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(
        F.col("id").asc_nulls_first(), F.xxhash64("text"))

    def segments(batches):
        from pyspark import TaskContext
        part, number = TaskContext.get().partitionId(), 0
        encode = encoder(path, blanks, MOST_KEPT).encode
        ids, data, size = [], [], 0

        def close():
            made = write_segment(ids, data)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()),
                 pa.array([made], pa.binary())], names=["part", "segment", "tokens", "data"])

        for batch in batches:
            docs_in, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_slices(texts, SLICE):
                for doc, one in zip(docs_in[a:b], encode(texts[a:b]), strict=True):
                    one += end
                    if ids and size + len(one) // 4 > SEGMENT_TOKENS:
                        yield close()
                        ids, data, size, number = [], [], 0, number + 1
                    ids.append(doc)
                    data.append(one)
                    size += len(one) // 4
        if ids:
            yield close()

    ordered.mapInArrow(segments, "part int, segment int, tokens bigint, data binary").write.option(
        "compression", "none").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, decoded and checked from the file's blocks.

    `start` counts the ids of all documents before it in the file.
    """
    files = spark.read.parquet(folder)
    sizes = files.select("part", "segment", "tokens")
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("n"))  # one row per written part
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
                          .alias("part_start"))
    inside = sizes.select("part", "segment", (F.sum("tokens").over(Window.partitionBy("part").orderBy("segment").rowsBetween(
        Window.unboundedPreceding, 0)) - F.col("tokens")).alias("segment_start"))
    starts = inside.join(before, "part").select("part", "segment", (F.col("part_start") + F.col("segment_start")).alias("begins"))

    def documents(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                found = Segment(batch.column(2)[row].as_py())
                ends = np.cumsum(found.documents["tokens"].astype(np.int64))
                crcs, at, carry = [], 0, 0
                for i, point in enumerate(found.checkpoints):
                    ids, first = found.block(i), int(point["first"])
                    last = first + len(ids)
                    while len(crcs) < len(ends) and ends[len(crcs)] <= last:
                        crcs.append(zlib.crc32(ids[at - first:ends[len(crcs)] - first].tobytes(), carry))
                        at, carry = int(ends[len(crcs) - 1]), 0
                    if at < last:
                        carry, at = zlib.crc32(ids[at - first:].tobytes(), carry), last
                crcs += [0] * (len(ends) - len(crcs))
                n = len(ends)
                docs = found.documents
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, batch.column(0)[row].as_py(), dtype=np.int32)),
                    pa.array(np.full(n, batch.column(1)[row].as_py(), dtype=np.int32)),
                    pa.array(docs["doc_id"].astype(np.int64), mask=docs["null"].astype(bool)),
                    pa.array(ends - docs["tokens"].astype(np.int64)), pa.array(docs["tokens"].astype(np.int64)),
                    pa.array(crcs, pa.int64())], names=["part", "segment", "doc_id", "local", "n_tokens", "ids_crc32"])

    held = files.select("part", "segment", "data").mapInArrow(
        documents, "part int, segment int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    return held.join(starts, ["part", "segment"]).select("doc_id", (F.col("begins") + F.col("local")).alias("start"), "n_tokens",
                                                         "ids_crc32")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Writes a new file in the shared folder and returns what is read back from it."""
    folder = run_folder(docs.sparkSession, "tokens")
    write(docs, folder, path)
    return read(docs.sparkSession, folder)
