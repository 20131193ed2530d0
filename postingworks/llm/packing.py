"""Best-fit packing of token sequences, after Martello and Toth's reduction by dominance.

Documents are cut into pieces of at most `capacity` tokens; only longer documents are cut. Equal lengths are alike, so the
plan is made on the counts of lengths, at most `capacity` numbers whatever the input: first, sets of up to three pieces
that dominate every other set containing their leading length are fixed for good, many copies at a time; the rest is
packed best-fit in descending order, again by whole runs of equal pieces and equal gaps. The plan is a list of steps
"pieces number a to b of length s go to sequences c onward at offset d"; each piece finds its step by its number among the
pieces of its length, which is counted in bounded blocks so that no length has to fit in one task.

Defined cases: a null text is empty; with the end id every document has a token, and without it an empty document has no
piece; rows that agree in id, piece and all else are kept and packed apart; an empty table gives no rows; other columns
are never read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingworks.functions.scale import numbered
from postingworks.llm.tokens import END, MOST_KEPT, encoder, in_slices
from postingworks.session import materialize

CAPACITY = 2048
BLOCK_ROWS = 20_000
MOST_STEPS = 5_000_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, *, capacity: int = CAPACITY, blanks: bool = False, end: bytes = END,
           id_col: str = "doc_id", text_col: str = "text", most_kept: int = MOST_KEPT, slice_chars: int = 2 << 20) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the checksum of its ids.

    A worker keeps the ids of up to twice `most_kept` words and encodes `slice_chars` characters at once: memory for speed.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def cut(batches):
        encode = encoder(path, blanks, most_kept).encode
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_slices(texts, slice_chars):
                rows = ([], [], [], [], [])
                for doc, data in zip(ids[a:b], encode(texts[a:b]), strict=True):
                    data += end
                    for i, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at:at + 4 * capacity]
                        for column, value in zip(rows, (doc, i, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()),
                                                  *[pa.array(r, pa.int64()) for r in rows[2:]]],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


class Plan:
    """Steps (length, first number, copies, first sequence, offset) over the counts of lengths."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.left = capacity, dict(counts)
        self.used = dict.fromkeys(counts, 0)  # pieces of a length that have their place
        self.steps: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = 0  # sequences fixed by dominance

    def place(self, length: int, copies: int, sequence: int, offset: int) -> None:
        self.steps.append((length, self.used[length], copies, sequence, offset))
        self.used[length] += copies
        self.left[length] -= copies

    def _fix(self, lengths: tuple[int, ...]) -> None:
        """Gives as many sequences as the counts allow exactly these lengths."""
        copies = min(self.left[s] // lengths.count(s) for s in set(lengths))
        offset = 0
        for s in lengths:
            self.place(s, copies, self.sequences, offset)
            offset += s
        self.sequences += copies
        self.fixed += copies

    def _dominant(self, j: int, sizes: list[int]) -> tuple[int, ...] | None:
        """A set with j that dominates all others with j, if one of at most three pieces is known to.

        A set dominates another if the other's pieces can be put, alone or in groups, in place of pieces of its own that
        are as long at least. `sizes` are the lengths left, ascending.
        """
        room = self.capacity - j
        have = lambda s, but: self.left[s] - but.count(s) > 0

        def largest(most: int, but: tuple[int, ...]) -> int | None:
            at = bisect_left(sizes, most + 1) - 1
            while at >= 0 and not have(sizes[at], but):
                at -= 1
            return sizes[at] if at >= 0 else None

        a = largest(room, (j,))
        if a is None:
            return (j,)
        if j + a == self.capacity:
            return j, a
        small = []
        for s in sizes:
            small += [s] * min(3, self.left[s] - (s == j))
            if len(small) >= 3:
                break
        if len(small) < 2 or small[0] + small[1] > room:
            return j, a
        if len(small) >= 3 and sum(small[:3]) <= room:
            return None
        # at most two pieces join j: the sets to beat are all pairs (c, d) with d <= c
        pairs = []
        for c in sizes[:bisect_left(sizes, room + 1)]:
            if have(c, (j,)):
                d = largest(min(c, room - c), (j, c))
                if d is not None:
                    pairs.append((c, d))
        if all(c + d <= a for c, d in pairs):
            return j, a
        b = largest(room - a, (j, a))
        if b is not None and all(d <= b or c + d <= a for c, d in pairs):
            return j, a, b
        return None

    def reduce(self) -> None:
        """Fixes dominating sets until none is found for any length."""
        again = True
        while again:
            again = False
            sizes = sorted(s for s, n in self.left.items() if n)
            for j in reversed(sizes.copy()):
                while self.left[j]:
                    found = self._dominant(j, sizes)
                    if not found:
                        break
                    self._fix(found)
                    again = True
                    for s in set(found):
                        if not self.left[s]:
                            sizes.remove(s)

    def best_fit(self) -> None:
        """The rest, longest first, each piece into the smallest gap that holds it."""
        gaps: list[int] = []  # ascending
        runs: dict[int, list[tuple[int, int]]] = {}  # gap: runs of (first sequence, copies)

        def add(gap: int, first: int, copies: int) -> None:
            if gap:
                if gap not in runs:
                    runs[gap] = []
                    insort(gaps, gap)
                runs[gap].append((first, copies))

        for s in sorted((s for s, n in self.left.items() if n), reverse=True):
            while self.left[s]:
                at = bisect_left(gaps, s)
                if at == len(gaps):
                    each = self.capacity // s
                    full, rest = divmod(self.left[s], each)
                    if full:
                        first, copies = self.sequences, full
                        for i in range(each):
                            self.place(s, full, first, i * s)
                        self.sequences += full
                        add(self.capacity - each * s, first, copies)
                    if rest:
                        for i in range(rest):
                            self.place(s, 1, self.sequences, i * s)
                        add(self.capacity - rest * s, self.sequences, 1)
                        self.sequences += 1
                    continue
                gap = gaps[at]
                first, copies = runs[gap].pop()
                take = min(copies, self.left[s])
                if take < copies:
                    runs[gap].append((first + take, copies - take))
                if not runs[gap]:
                    del runs[gap], gaps[at]
                self.place(s, take, first, self.capacity - gap)
                add(gap - s, first, take)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("lengths must be between 1 and the capacity")
    made = Plan(counts, capacity)
    made.reduce()
    made.best_fit()
    return made


def pack(items: DataFrame, *, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """`items` with sequence_id and offset. The rows are read several times: give a table, not a long computation."""
    counts = {r[0]: r[1] for r in items.groupBy(length_col).count().collect()}  # at most `capacity` rows
    made = plan(counts, capacity)
    if len(made.steps) > MOST_STEPS:
        raise ValueError(f"{len(made.steps)} steps are too many to send to every task")
    spark = items.sparkSession
    steps = np.array(sorted(made.steps), dtype=np.int64).reshape(-1, 5)
    # one ascending key per (length, number) makes the step one search
    wide = int(max(counts.values(), default=0)) + 1
    sent = spark.sparkContext.broadcast((steps, steps[:, 0] * wide + steps[:, 1]))
    held = items.select(F.struct("*").alias("_item"), F.col(length_col).cast("bigint").alias("_length"))
    blocks = max(1, -(-sum(counts.values()) // BLOCK_ROWS))
    ranked = numbered(held.withColumn("_key", F.xxhash64("_item")), ["_length"],
                      {"_block": F.pmod(F.col("_key"), F.lit(blocks))}, [F.col("_key"), F.col("_item")], "_number")

    def placed(batches):
        table, keys = sent.value
        for batch in batches:
            length = np.asarray(batch.column(1), dtype=np.int64)
            number = np.asarray(batch.column(2), dtype=np.int64) - 1
            step = table[np.searchsorted(keys, length * wide + number, side="right") - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(step[:, 3] + number - step[:, 1]), pa.array(step[:, 4])],
                                             names=["_item", "sequence_id", "offset"])

    schema = held.select("_item").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select("_item", "_length", "_number").mapInArrow(placed, schema).select("_item.*", "sequence_id", "offset")


def digest(docs: DataFrame, path: str, **memory: int) -> DataFrame:
    """The rows the query returns: pieces, counted and packed; `memory` as in `pieces`."""
    return pack(materialize(pieces(docs, path, **memory), "pieces"))
