"""Repeated byte strings by prefix doubling over a suffix array that drops unique positions on the way.

A position's rank at an offset is a fingerprint of so many bytes from it, equal exactly where the bytes are. The first
round ranks positions at half the threshold; of these only the least rank of each stretch a threshold long is sent, which
any other place with the same bytes picks too. Where it is unique, so is every string it stands for, and those positions
drop out. The second round doubles the offset: the ranks at a position and half the threshold on form a pair, the pair's
rank covers the whole threshold, and positions whose pair occurs again are repeated. Spark deals the ranks by their top
bits and sorts each range; nothing beyond the threshold is ever ranked, as longer matches are runs of such positions.

First-round ranks are sent with `SPARE_BITS` bits more than it takes to number them: a chance meeting only keeps positions in.
Second-round ranks are 64 bits and not compared byte by byte: among n positions a false meeting has chance n * n / 2**65.

Defined cases: a null text is empty; a text shorter than the threshold loses nothing; each row is a document of its own, so
repeated rows are copies of each other; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingworks.llm import hashing, repeats
from postingworks.llm.common import drop_unused

THRESHOLD = 200
SPARE_BITS = 10
STRETCH = 1 << 18
SCHEMA = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<first:int,last:int>>"


class Ranks:
    """Ranks of the positions of some texts: `half` at half the threshold, `picked` the least of each stretch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, threshold: int) -> None:
        self.threshold, self.first = threshold, (threshold + 1) // 2
        n = len(data)
        if n < threshold:
            self.at = self.picks = np.empty(0, dtype=np.int64)
            self.half = np.empty(0, dtype=np.uint64)
            return
        self.half = hashing.windows(hashing.byte_table(31)[data], self.first, 33)
        starts = np.arange(n - threshold + 1)
        row_end = np.repeat(offsets[1:], np.diff(offsets))[:len(starts)]
        self.at = np.flatnonzero(starts + threshold <= row_end)  # strings that don't cross a document's end
        # the low bits give way to the place, so equal ranks are told by the first of them
        bits = np.uint64(max(1, n.bit_length()))
        low = (self.half >> bits << bits) | np.arange(len(self.half), dtype=np.uint64)
        span = threshold - self.first + 1
        size = 1
        while size * 2 <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < span:
            low = np.minimum(low[:len(low) - (span - size)], low[span - size:])
        self.picks = (low[self.at] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)

    def sent(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct picked places and their ranks."""
        picked = np.zeros(len(self.half), dtype=bool)
        picked[self.picks] = True
        places = np.flatnonzero(picked)
        return places, self.half[places]

    def kept(self, places: np.ndarray) -> np.ndarray:
        """The positions whose picked place is among these."""
        picked = np.zeros(len(self.half), dtype=bool)
        picked[places] = True
        return self.at[picked[self.picks]]

    def pairs(self, at: np.ndarray) -> np.ndarray:
        """The ranks of whole strings: of pairs of ranks a half apart."""
        later = self.half[at + (self.threshold - self.first)]
        return hashing.mix(self.half[at] * np.uint64(0x9E3779B97F4A7C15) + hashing.mix(later))


def _pieces(data: np.ndarray, offsets: np.ndarray, threshold: int):
    """(first row, last row, bytes, offsets, ranks) over stretches of whole texts, so that a block's arrays stay small."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + STRETCH, side="right")) - 1))
        a, b = offsets[first], offsets[last]
        own = offsets[first:last + 1] - a
        yield first, last, data[a:b], own, Ranks(data[a:b], own, threshold)
        first = last


def _sent(pieces: list, width: int) -> np.ndarray:
    """The ranks that the stretches of a block send in the first round, cut to `width` bits.

    Least ranks are small numbers; scrambled, they fill all ranges alike and all their bits tell them apart.
    """
    found = [p[4].sent()[1] for p in pieces]
    return hashing.mix(np.concatenate(found)) >> np.uint64(64 - width) if found else np.empty(0, dtype=np.uint64)


def _candidates(data: np.ndarray, offsets: np.ndarray, flags: pa.StructArray | None, bits: int, width: int, threshold: int):
    """For each stretch of texts, its rows, bytes, offsets, the positions that outlive the first round and their pairs' ranks."""
    cut = list(_pieces(data, offsets, threshold))
    again, used = repeats.level_flags(flags, 1, _sent(cut, width), bits, width)[0], 0
    while cut:
        first, last, data, own, ranks = cut.pop(0)
        places = ranks.sent()[0]
        at = ranks.kept(places[again[used:used + len(places)]])
        used += len(places)
        yield first, last, data, own, at, ranks.pairs(at)


def _round(table: DataFrame, threshold: int, bits: tuple[int, int], width: int, level: int) -> DataFrame:
    def give(batches):
        for batch in batches:
            for block, _, data, offsets, flags in repeats.rows_of(batch):
                if level == 1:
                    hashes = _sent(list(_pieces(data, offsets, threshold)), width)
                else:
                    found = [pairs for *_, pairs in _candidates(data, offsets, flags, bits[0], width, threshold)]
                    hashes = np.concatenate(found) if found else np.empty(0, dtype=np.uint64)
                yield repeats.cells(block, hashes, bits[level - 1], width if level == 1 else 64)

    return table.mapInArrow(give, repeats.CELLS)


def _outcome(data: np.ndarray, own: np.ndarray, hit: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """The spans that strings at `hit` cover in a stretch of texts (first and last byte, row of each), and each row's kept digest."""
    n = len(data)
    edge = np.zeros(n + threshold + 1, dtype=np.int32)
    edge[hit] += 1
    edge[hit + threshold] -= 1
    out = np.cumsum(edge[:n]) > 0
    begins = np.zeros(n + 1, dtype=bool)
    begins[own] = True
    firsts = np.flatnonzero(out & (begins[:n] | ~np.concatenate([[False], out[:-1]])))
    lasts = np.flatnonzero(out & (begins[1:] | ~np.concatenate([out[1:], [False]]))) + 1
    rows = np.searchsorted(own, firsts, side="right") - 1
    kept = memoryview(np.ascontiguousarray(data[~out]))
    upto = np.concatenate([[0], np.cumsum(~out)])[own].tolist()
    shas = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(upto, upto[1:])]
    return np.stack([firsts, lasts], axis=1) - own[rows][:, None], rows, np.diff(own), shas


def deduplicated(docs: DataFrame, *, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans [(first byte, last byte exclusive)]."""
    if threshold < 2:
        raise ValueError("the threshold is two bytes at least")
    spark = docs.sparkSession
    table = repeats.blocks(docs, id_col, text_col)
    total = table.agg(F.sum("bytes")).first()[0] or 0
    sampled = total * 4 // threshold
    bits, width = (repeats.range_bits(sampled), 0), repeats.hash_bits(sampled, SPARE_BITS)
    one = repeats.answered(_round(table, threshold, bits, width, 1), bits[0], 1, width)
    drop_unused(spark)
    # about as many positions outlive the first round as the share of its ranks that were met again
    items, again = one.agg(F.sum("items"), F.sum("again")).first()
    bits = bits[0], repeats.range_bits(total * again // items if items else 0)
    two = repeats.answered(_round(repeats.known(table, one), threshold, bits, width, 2), bits[1], 2)
    drop_unused(spark)

    def remove(batches):
        for batch in batches:
            for _, ids, data_in, offsets, flags in repeats.rows_of(batch):
                pieces = list(_candidates(data_in, offsets, flags, bits[0], width, threshold))
                pairs = [p[5] for p in pieces]
                again = repeats.level_flags(flags, 2, np.concatenate(pairs) if pairs else np.empty(0, np.uint64), bits[1])[0]
                found, used = [], 0
                for first, _, data, own, at, mine in pieces:
                    spans, rows, sizes, shas = _outcome(data, own, at[again[used:used + len(mine)]], threshold)
                    found.append((spans, rows + first, sizes, shas))
                    used += len(mine)
                spans, rows, sizes = (np.concatenate([f[k] for f in found]) for k in range(3))
                counts = np.bincount(rows, minlength=len(ids))
                gone = np.concatenate([[0], np.cumsum(spans[:, 1] - spans[:, 0])])
                ends = np.concatenate([[0], np.cumsum(counts)])
                both = [pa.array(spans[:, k].astype(np.int32)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([
                    ids.cast(pa.int64()), pa.array(sizes), pa.array(np.diff(gone[ends])), pa.array(counts),
                    pa.array([x for f in found for x in f[3]], pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(both, ["first", "last"]))],
                    names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return repeats.known(table, one, two).mapInArrow(remove, f"`{id_col}` bigint, {SCHEMA}")


def digest(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).drop("spans")
