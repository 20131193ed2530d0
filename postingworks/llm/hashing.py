"""Vectorised hashing of words and windows over whole Arrow batches of texts.

Texts are handled as one byte buffer with row offsets. A sequence hashes to the sum of table[unit] * BASE**place modulo
2**64, so the hash of any stretch is a difference of two running sums times a power of BASE's inverse, and windows of one
length cost one subtraction each, whatever the length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK = (1 << 64) - 1
_tables: dict[int, np.ndarray] = {}
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values; equal in, equal out."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def base(seed: int) -> int:
    return int(mix(np.array([seed * 2 + 12345], dtype=np.uint64))[0]) | 5


def byte_table(seed: int) -> np.ndarray:
    if seed not in _tables:
        _tables[seed] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return _tables[seed]


def powers(of: int, n: int) -> np.ndarray:
    """of**0 .. of**n modulo 2**64, kept and grown by doubling."""
    have = _powers.get(of)
    if have is None or len(have) <= n:
        size = max(1 << 12, 1 << n.bit_length())
        have = np.ones(size + 1, dtype=np.uint64)
        filled = 1
        while filled <= size:
            step = min(filled, size + 1 - filled)
            have[filled:filled + step] = have[:step] * np.uint64(pow(of, filled, 1 << 64))
            filled += step
        if size <= 1 << 22:
            _powers[of] = have
    return have


def running(units: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Running sums of units * BASE**place, one longer than `units`, and the inverse of BASE."""
    b = base(seed)
    sums = np.zeros(len(units) + 1, dtype=np.uint64)
    np.cumsum(units * powers(b, len(units))[:len(units)], dtype=np.uint64, out=sums[1:])
    return sums, pow(b, -1, 1 << 64)


def stretches(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """One hash for each [start, end) of `units` (unsigned 64-bit values)."""
    sums, inverse = running(units, seed)
    return mix((sums[ends] - sums[starts]) * powers(inverse, len(units))[starts] + (ends - starts).astype(np.uint64))


def windows(units: np.ndarray, length: int, seed: int) -> np.ndarray:
    """The hash of every window of `length` units, by place of its first unit; empty if there are fewer units."""
    if len(units) < length:
        return np.empty(0, dtype=np.uint64)
    sums, inverse = running(units, seed)
    n = len(units) - length + 1
    return mix((sums[length:] - sums[:n]) * powers(inverse, len(units))[:n])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row offsets (rows + 1); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows (bytes), and for each row the number of words before it (rows + 1).

    A word is a longest stretch of bytes other than blank and 0x09 to 0x0D inside one row.
    """
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[data]
    turn = np.diff(inside)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    # a word that runs over a row's end is cut there
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    if len(cuts):
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << 5)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    return stretches(byte_table(seed)[data], starts, ends, seed)


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20):
    """The batch in stretches of at most `most` text bytes (one row at least): bounded memory whatever the lengths."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    place = np.cumsum(sizes)
    first = 0
    while first < batch.num_rows:
        before = place[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(place, before + most, side="right")))
        yield batch.slice(first, last - first)
        first = last
