"""Substring removal on a De Bruijn graph of words.

Every window of `window` words is an edge from its first to its last `window - 1` words. Round one finds the edges that
occur more than once. Round two asks, for these, whether all occurrences go on with the same word and come from the same
word; where they don't, or where a document begins or ends, a path ends. Inside documents the edges between such places
are one nonbranching path, the same wherever it occurs, put together per document in a Python task. One aggregate by the
digest of a path's word hashes then finds paths that stand at one source place only; the words of all others are removed.
Equal digests count as equal words: nothing is compared beyond them, and no join of paths on their places takes part.

Window hashes keep `SPARE_BITS` bits more than it takes to number all windows, so about one in 2**SPARE_BITS meets another
by chance. That ends the paths on both sides of it wherever it occurs, and a path that is alone removes nothing, so the
result is exact as far as the hashes of words and their digests tell words apart.

Defined cases: a null text has no words; a text shorter than a window loses nothing; each row is a document of its own, so
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
from postingworks.session import materialize

WINDOW = 35
SPARE_BITS = 13
LOST = np.uint64(0)


class Words:
    """The words of a block's texts as hashes, with the hashes of all its windows cut to `width` bits."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, width: int) -> None:
        starts, ends, self.rows = hashing.word_places(data, offsets)
        self.hashes = hashing.word_hashes(data, starts, ends, 21)
        n, self.window = len(self.hashes), window
        if n >= window:
            last = np.repeat(self.rows[1:], np.diff(self.rows))[:n - window + 1]
            self.at = np.flatnonzero(np.arange(n - window + 1) + window <= last)
            self.edges = hashing.windows(self.hashes, window, 23)[self.at] >> np.uint64(64 - width)
        else:
            self.at, self.edges = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)

    def sides(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words before and after the windows at these places; 0 where the document begins or ends."""
        n = len(self.hashes)
        begins = np.zeros(n + 1, dtype=bool)
        begins[self.rows] = True
        word = np.where(self.hashes <= repeats.MIXED, np.uint64(2), self.hashes)
        after = np.minimum(at + self.window, n - 1)
        return (np.where(begins[at], LOST, word[np.maximum(at - 1, 0)]),
                np.where(begins[at + self.window], LOST, word[after]))


def _one_edge_round(table: DataFrame, window: int, bits: int, width: int, level: int) -> DataFrame:
    def give(batches):
        for batch in batches:
            for block, _, data, offsets, flags in repeats.rows_of(batch):
                words = Words(data, offsets, window, width)
                hashes, sides = words.edges, None
                if level == 2:
                    again = repeats.level_flags(flags, 1, words.edges, bits, width)[0]
                    hashes, sides = words.edges[again], words.sides(words.at[again])
                yield repeats.cells(block, hashes, bits, width, sides)

    return table.mapInArrow(give, repeats.CELLS)


def paths(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: block, place, id, n_words, its text where it has repeated edges, and its nonbranching paths
    [(start, edges, path)]: `path` is the digest of the words of the path, start counts words. Written and read back.
    """
    if window < 2:
        raise ValueError("a window takes two words at least")
    spark = docs.sparkSession
    table = repeats.blocks(docs, id_col, text_col)
    total = table.agg(F.sum("bytes")).first()[0] or 0
    bits, width = repeats.range_bits(total // 6), repeats.hash_bits(total // 6, SPARE_BITS)
    first = repeats.answered(_one_edge_round(table, window, bits, width, 1), bits, 1, width)
    drop_unused(spark)
    second = repeats.answered(_one_edge_round(repeats.known(table, first), window, bits, width, 2), bits, 2, width, sides=True)
    drop_unused(spark)

    def compact(batches):
        for batch in batches:
            for block, ids, data, offsets, flags in repeats.rows_of(batch):
                words = Words(data, offsets, window, width)
                again = repeats.level_flags(flags, 1, words.edges, bits, width)[0]
                at = words.at[again]
                from_one, to_one = repeats.level_flags(flags, 2, words.edges[again], bits, width, 2)
                # an edge goes on the path of the edge before it if neither branches in between
                goes_on = np.concatenate([[False], (np.diff(at) == 1) & to_one[:-1] & from_one[1:]]) if len(at) else again[:0]
                heads = np.flatnonzero(~goes_on)
                sizes = np.diff(heads, append=len(at))
                starts = at[heads]
                of_row = np.searchsorted(words.rows, starts, side="right") - 1
                firsts = np.searchsorted(of_row, np.arange(len(ids) + 1))
                found, kept_texts, shas = [], [], []
                for i in range(len(ids)):
                    mine = []
                    for j in range(firsts[i], firsts[i + 1]):
                        s, k = int(starts[j]), int(sizes[j])
                        digest = hashlib.blake2b(words.hashes[s:s + k + window - 1].tobytes(), digest_size=16).digest()
                        mine.append({"start": s - int(words.rows[i]), "edges": k, "path": digest})
                    found.append(mine)
                    text = data[offsets[i]:offsets[i + 1]].tobytes()
                    kept_texts.append(text if mine else None)
                    shas.append(None if mine else _sha(text))
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), ids.cast(pa.int64()),
                    pa.array(np.diff(words.rows)), pa.array(kept_texts, pa.binary()), pa.array(shas, pa.string()),
                    pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("edges", pa.int32()), ("path", pa.binary())])))],
                    names=["block", "place", "id", "n_words", "text", "sha", "paths"])

    schema = ("block bigint, place int, id bigint, n_words bigint, text binary, sha string, "
              "paths array<struct<start:int,edges:int,path:binary>>")
    return materialize(repeats.known(table, first, second).mapInArrow(compact, schema), "paths")


def _sha(text: bytes, gone: np.ndarray | None = None) -> str:
    """SHA-256 of a text's words but those gone, joined by one blank."""
    words = text.split()  # splits at the same six bytes
    if gone is not None:
        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return hashlib.sha256(b" ".join(words)).hexdigest()


def alone(found: DataFrame) -> DataFrame:
    """(block, place, lone starts) of paths that no other source place confirms; there are next to none."""
    each = found.where(F.size("paths") > 0).select("block", "place", F.explode("paths").alias("p"))
    # one place per path is enough to know where a lone one stands, so a frequent path shrinks before the shuffle
    once = each.groupBy("p.path").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("block", "place", "p.start")).alias("at")).where("n = 1")
    return once.groupBy("at.block", "at.place").agg(F.collect_list("at.start").alias("lone"))


def _removed(paths_in: list[dict], lone: list[int] | None, n: int, window: int) -> np.ndarray:
    out = set(lone or ())
    edge = np.zeros(n + 1, dtype=np.int64)
    for p in paths_in:
        if p["start"] not in out:
            edge[p["start"]] += 1
            edge[min(n, p["start"] + p["edges"] + window - 1)] -= 1
    return np.cumsum(edge[:-1]) > 0


def deduplicated(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256, and the removed spans [(first word, last word exclusive)]."""
    found = paths(docs, window=window, id_col=id_col, text_col=text_col)
    joined = found.join(alone(found), ["block", "place"], "left").select("id", "n_words", "text", "sha", "paths", "lone")

    def remove(batches):
        for batch in batches:
            ids, ns, texts, shas, path_lists, lones = (c.to_pylist() for c in batch.columns)
            gone, out, spans = [], [], []
            for n, text, sha, mine, lone in zip(ns, texts, shas, path_lists, lones, strict=True):
                if sha is not None:
                    gone.append(0)
                    out.append(sha)
                    spans.append([])
                else:
                    g = _removed(mine, lone, n, window)
                    gone.append(int(g.sum()))
                    out.append(_sha(text, g))
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
                    spans.append([{"first": int(a), "last": int(b)} for a, b in turns.reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string()),
                pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))],
                names=[id_col, "n_words", "n_removed", "kept_sha256", "spans"])

    return joined.mapInArrow(remove, f"`{id_col}` bigint, n_words bigint, n_removed bigint, kept_sha256 string, "
                                     "spans array<struct<first:int,last:int>>")


def digest(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
