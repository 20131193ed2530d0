"""Which hashed items occur more than once in a corpus, answered per block of documents in one bit per item.

Documents are packed into blocks of bounded size, written once. In a round every block gives its distinct item hashes,
sorted and dealt by their top bits into ranges, as one compact binary per range. Each range is reduced alone: an item is
repeated if two blocks gave it or one block held it twice. What goes back to a block is one bit per hash, in the order of
its hashes, which the block derives again from its texts. A hash that a third of all documents hold is still one entry per
block and range, so no task is heavier than its range, and no list of occurrences is ever gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingworks.llm import hashing
from postingworks.session import run_folder

BLOCK_BYTES = 4 << 20
RANGE_ITEMS = 1 << 20
BLOCKS = "block bigint, bytes bigint, ids array<bigint>, sizes binary, data binary"
CELLS = "block bigint, part int, width int, gaps binary, wide binary, twice binary, sides binary"
FLAGS = "block bigint, level int, part int, items bigint, again bigint, bits binary"
MIXED = np.uint64(1)


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (block, bytes, ids, sizes, data) of at most `BLOCK_BYTES` of text, one document at least, written and read back.

    `data` is the compressed text of all documents in turn, `sizes` their bytes; a null text is empty.
    """
    spark, most = docs.sparkSession, BLOCK_BYTES

    def pack(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        shrink = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, ends = hashing.text_bytes(batch.column("text"))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, side="right")) - 1)
                a, b = int(ends[first]), int(ends[last])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([b - a], pa.int64()),
                     pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), batch.column("id").slice(first, last - first)),
                     pa.array([np.diff(ends[first:last + 1]).astype("<i8").tobytes()], pa.binary()),
                     pa.array([shrink.compress(data[a:b].tobytes())], pa.binary())],
                    names=["block", "bytes", "ids", "sizes", "data"])
                number, first = number + 1, last

    path = run_folder(spark, "blocks")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows.mapInArrow(pack, BLOCKS).write.option("compression", "none").parquet(path)
    return spark.read.schema(BLOCKS).parquet(path)


def hash_bits(items: int, spare: int) -> int:
    """Bits of hashes of so many items of which one in about 2**spare meets another by chance; 64 at most."""
    return min(64, max(1, items).bit_length() + spare)


def range_bits(items: int) -> int:
    """Number of top bits that deal so many items into ranges of about `RANGE_ITEMS`."""
    return max(0, (max(1, items) // RANGE_ITEMS).bit_length())


def starts_of(sizes: np.ndarray) -> np.ndarray:
    """Where each of some adjoining stretches begins."""
    return np.cumsum(sizes) - sizes


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column in turn and the bytes of each value."""
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], np.diff(offsets)


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the stretches of `data` that end at `ends`."""
    offsets = np.concatenate([[0], ends])
    if offsets[-1] >= 1 << 31:
        raise ValueError("a block's items take more than 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def packed(values: np.ndarray, origins: np.ndarray | int, cuts: np.ndarray | None = None) -> list[pa.Array]:
    """Columns (width, gaps, wide) of cells of sorted distinct values, each cell's from its origin on.

    `cuts` are the places where cells begin. Gaps are given in a few bytes; the rare wide ones are listed apart by their place.
    """
    cuts = np.zeros(1, dtype=np.int64) if cuts is None else cuts
    ends = cuts + np.diff(cuts, append=len(values))
    gaps = np.diff(values, prepend=np.uint64(0))
    gaps[cuts] = values[cuts] - np.asarray(origins, dtype=np.uint64)
    width = 8
    for w in (2, 3, 4, 5, 6, 7):
        if np.count_nonzero(gaps >> np.uint64(8 * w)) * 100 <= len(gaps):
            width = w
            break
    wide = np.flatnonzero(gaps >> np.uint64(8 * width)) if width < 8 else np.empty(0, dtype=np.int64)
    upto = np.searchsorted(wide, ends)
    listed = np.stack([wide - np.repeat(cuts, np.diff(upto, prepend=0)), gaps[wide].astype("<u8").view(np.int64)], axis=1)
    body = gaps.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width]
    return [pa.array(np.full(len(cuts), width, dtype=np.int32)), binary(body.reshape(-1), ends * width),
            binary(listed.astype("<i8", copy=False).view(np.uint8).reshape(-1), upto * 16)]


def sizes_of(columns: list[pa.Array]) -> np.ndarray:
    """How many values each cell has."""
    return bytes_of(columns[1])[1] // columns[0].to_numpy()


def unpacked(columns: list[pa.Array], origins: np.ndarray | int) -> np.ndarray:
    """The values of all cells in turn."""
    widths, (body, lengths), (listed, more) = columns[0].to_numpy(), bytes_of(columns[1]), bytes_of(columns[2])
    sizes = lengths // widths
    starts = starts_of(sizes)
    every = np.unique(widths)
    gaps = np.zeros((int(sizes.sum()), 8), dtype=np.uint8)
    for w in every.tolist():
        if len(every) == 1:
            gaps[:, :w] = body.reshape(-1, w)
        else:  # cells of small blocks have other widths
            gaps[np.repeat(widths == w, sizes), :w] = body[np.repeat(widths == w, lengths)].reshape(-1, w)
    gaps = gaps.reshape(-1).view("<u8").astype(np.uint64, copy=False)
    pairs = np.frombuffer(listed.tobytes(), "<i8").reshape(-1, 2)
    gaps[np.repeat(starts, more // 16) + pairs[:, 0]] = pairs[:, 1].view(np.uint64)
    sums = np.cumsum(gaps, dtype=np.uint64)
    return sums + np.repeat(np.asarray(origins, dtype=np.uint64) + gaps[starts] - sums[starts], sizes)


def bit_places(sizes: np.ndarray, kind: int = 0, kinds: int = 1) -> np.ndarray:
    """The bit of each item of cells that begin at a byte of their own and have `kinds` bitmaps each."""
    size = (sizes + 7) // 8
    return np.arange(int(sizes.sum())) + np.repeat(8 * (kinds * starts_of(size) + kind * size) - starts_of(sizes), sizes)


def bitmaps(answers: list[np.ndarray], sizes: np.ndarray) -> pa.Array:
    """For each cell, the bitmaps of its flags, one for each kind of answer."""
    kinds, size = len(answers), (sizes + 7) // 8
    bits = np.zeros(8 * kinds * int(size.sum()), dtype=bool)
    for kind, flags in enumerate(answers):
        bits[bit_places(sizes, kind, kinds)] = flags
    return binary(np.packbits(bits, bitorder="little"), kinds * np.cumsum(size))


def flags_of(data: np.ndarray, sizes: np.ndarray, kinds: int = 1) -> list[np.ndarray]:
    """The flags of all items of cells, for each kind of answer."""
    bits = np.unpackbits(data, bitorder="little").view(bool)
    return [bits[bit_places(sizes, kind, kinds)] for kind in range(kinds)]


def ranges_of(values: np.ndarray, bits: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each range of sorted hashes of `width` bits begins, and its number, told by its top `bits`."""
    if not len(values):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    if not bits:
        return np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    parts = (values >> np.uint64(width - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
    return cuts, parts[cuts]


def cells(block: int, hashes: np.ndarray, bits: int, width: int = 64, sides: tuple[np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
    """A block's item hashes of `width` bits, dealt to ranges, one row each; `sides` are values before and after each item.

    All ranges of a block are packed at once, so many ranges of few items cost little more than their items.
    """
    order = None if sides is None else np.argsort(hashes)
    in_order = np.sort(hashes) if sides is None else hashes[order]
    firsts = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]])) if len(hashes) else np.empty(0, dtype=np.int64)
    values = in_order[firsts]
    twice = np.diff(firsts, append=len(hashes)) > 1
    cuts, parts = ranges_of(values, bits, width)
    sizes = np.diff(cuts, append=len(values))
    merged = np.empty((len(values), 2 if sides else 0), dtype="<u8")
    for k, side in enumerate(sides or ()):
        if len(values):
            s = side[order]
            low, high = np.minimum.reduceat(s, firsts), np.maximum.reduceat(s, firsts)
            merged[:, k] = np.where(low == high, low, MIXED)
    origins = parts.astype(np.uint64) << np.uint64(width - bits) if bits else np.zeros(len(parts), dtype=np.uint64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(cuts), block, dtype=np.int64)), pa.array(parts.astype(np.int32)), *packed(values, origins, cuts),
         bitmaps([twice], sizes), binary(merged.view(np.uint8).reshape(-1), np.cumsum(sizes) * (16 if sides else 0))],
        names=["block", "part", "width", "gaps", "wide", "twice", "sides"])


def _reduced(bits: int, width: int, level: int, sides: bool):
    """The function that answers one range: (block, level, part, bits) for each block that gave items to it."""
    def reduce(table: pa.Table) -> pa.Table:
        columns = {name: pa.concat_arrays(table.column(name).chunks) for name in table.column_names}
        part = columns["part"][0].as_py()
        coded = [columns[name] for name in ("width", "gaps", "wide")]
        sizes = sizes_of(coded)
        every = unpacked(coded, part << (width - bits))
        order = np.argsort(every)
        in_order = every[order]
        firsts = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
        counts = np.diff(firsts, append=len(every))

        def back(flag: np.ndarray) -> np.ndarray:
            out = np.empty(len(every), dtype=bool)
            out[order] = np.repeat(flag, counts)
            return out

        if sides:
            answers = []
            for side in np.frombuffer(bytes_of(columns["sides"])[0].tobytes(), "<u8").reshape(-1, 2).T:
                s = side[order]
                low, high = np.minimum.reduceat(s, firsts), np.maximum.reduceat(s, firsts)
                answers.append(back((low == high) & (low != MIXED)))
        else:
            twice = flags_of(bytes_of(columns["twice"])[0], sizes)[0]
            answers = [back((counts > 1) | np.logical_or.reduceat(twice[order], firsts))]
        again = np.add.reduceat(answers[0], starts_of(sizes), dtype=np.int64)
        return pa.table([columns["block"], pa.array(np.full(len(sizes), level, dtype=np.int32)), columns["part"],
                         pa.array(sizes), pa.array(again), bitmaps(answers, sizes)], names=["block", "level", "part", "items", "again", "bits"])

    return reduce


def answered(given: DataFrame, bits: int, level: int, width: int = 64, sides: bool = False) -> DataFrame:
    """Flags of the cells, written and read back, with the number of their items and of those that the first flag holds for."""
    spark = given.sparkSession
    path = run_folder(spark, "flags")
    given.groupBy("part").applyInArrow(_reduced(bits, width, level, sides), FLAGS).write.parquet(path)
    return spark.read.schema(FLAGS).parquet(path)


def known(blocks_table: DataFrame, *flags: DataFrame) -> DataFrame:
    """Blocks with their flags [(level, part, bits)] of all levels; a block without items has none."""
    every = flags[0]
    for more in flags[1:]:
        every = every.unionAll(more)
    per_block = every.groupBy("block").agg(F.collect_list(F.struct("level", "part", "bits")).alias("flags"))
    return blocks_table.join(per_block, "block", "left").select("block", "ids", "sizes", "data", "flags")


def level_flags(flags: pa.StructArray | None, level: int, hashes: np.ndarray, bits: int, width: int = 64, kinds: int = 1) -> list[np.ndarray]:
    """For each kind of answer of a level, one flag per item of the block, in the items' order."""
    values, inverse = np.unique(hashes, return_inverse=True)
    cuts, parts = ranges_of(values, bits, width)
    sizes = np.diff(cuts, append=len(values))
    mine = np.empty(0, dtype=np.int64) if flags is None else np.flatnonzero(flags.field("level").to_numpy() == level)
    given = np.empty(0, dtype=np.int32) if flags is None else flags.field("part").to_numpy()[mine]
    order = np.argsort(given)
    if not np.array_equal(given[order], parts):
        raise ValueError("a block's items differ from those that were answered")
    if not len(parts):
        return [np.zeros(0, dtype=bool)] * kinds
    data, lengths = bytes_of(flags.field("bits").take(pa.array(mine[order])))
    if not np.array_equal(lengths, kinds * ((sizes + 7) // 8)):
        raise ValueError("a block's items differ from those that were answered")
    return [out[inverse] for out in flags_of(data, sizes, kinds)]


def rows_of(batch: pa.RecordBatch):
    """(block, ids, data, offsets, flags) of each block in a batch, the bytes of its texts unpacked."""
    open_up = zstandard.ZstdDecompressor()
    column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    for i in range(batch.num_rows):
        data = np.frombuffer(open_up.decompress(column["data"][i].as_py()), np.uint8)
        offsets = np.concatenate([[0], np.cumsum(np.frombuffer(column["sizes"][i].as_py(), "<i8"))])
        flags = column["flags"][i].values if "flags" in column else None
        yield column["block"][i].as_py(), column["ids"][i].values, data, offsets, flags
