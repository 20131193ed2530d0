"""Near-duplicates by b-bit MinHash: banded candidates, collision-corrected estimates by bit counts, confirmed links.

A document's set holds its distinct word shingles. Documents with equal sets form one class, and only classes are linked.
`HASHES` minima per set give `HASHES / ROWS` band keys; of each minimum `BITS` low bits are kept, packed into 64-bit planes.
Two classes that share a band key are candidates; unequal minima agree in their low bits with chance 2**-BITS, so the share
of agreeing hashes m, a bit count over the planes, estimates the likeness as (m - 2**-BITS) / (1 - 2**-BITS). Candidates
more than `SLACK` under the threshold are dropped, the others are confirmed on their full sets. At the default settings two
sets of likeness 0.8 miss every band with chance 4e-8, and the estimate lies six deviations under with less.

Buckets are never expanded into all pairs. First every member is held against the least member of its buckets, and in
buckets of over `LARGE` members whoever is still apart from the bucket's most frequent component against members of it
chosen by hash. What that links is folded into components. Only members that are not in a bucket's most frequent component
are then held against the members of its other components (large buckets with the same such component go together, dealt
over parts), and a pair is made only where the two sets' counts over
`PLACES` hashed places leave room for enough shared shingles, a bound from above that loses no link. So a large group of
copies costs about its size, and no link between components is lost.

Defined cases: words are separated by blanks and 0x09 to 0x0D, A-Z is lowered; a text with fewer words than a shingle is
one shingle; a text without words or a null is linked with nothing; each row is a document of its own, rows without id are
never the least of their component unless all lack one; other columns are never read, and `kept` hands them through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingworks.llm import hashing
from postingworks.llm.common import drop_unused
from postingworks.llm.components import components
from postingworks.session import materialize

HASHES, ROWS, BITS = 128, 4, 4
SLACK = 0.22
LARGE, ROUNDS = 64, 2
PLACES, LEVELS, SPREAD = 512, 2, 32
SKETCH = "id bigint, text_hash bigint, n bigint, class binary, planes array<bigint>, keys array<bigint>"
_factors = hashing.mix(np.arange(1, HASHES + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_shifts = hashing.mix(np.arange(1001, 1001 + HASHES, dtype=np.uint64)).astype(np.uint32)


def shingle_sets(batch: pa.RecordBatch, text: str, words: int):
    """The sorted distinct shingle hashes of each row's text; empty without words."""
    for part in hashing.slices(batch, text):
        data, offsets = hashing.text_bytes(part.column(text))
        data = hashing.lowered(data)
        starts, ends, rows = hashing.word_places(data, offsets)
        hashes = hashing.word_hashes(data, starts, ends, 11)
        for i in range(part.num_rows):
            own = hashes[rows[i]:rows[i + 1]]
            if len(own) >= words:
                yield np.unique(hashing.windows(own, words, 13))
            elif len(own):
                yield hashing.stretches(own, np.array([0]), np.array([len(own)]), 13)
            else:
                yield own


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 4096):
        values = _factors[:, None] * x[None, at:at + 4096] + _shifts[:, None]
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        least = np.minimum(least, values.min(axis=1))
    return least


def planes_of(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima: for each bit, one bit per hash, packed into 64-bit words."""
    bits = (least[None, :] >> np.arange(BITS, dtype=np.uint32)[:, None]) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    bands = least.reshape(-1, ROWS).astype(np.uint64)
    key = np.arange(len(bands), dtype=np.uint64)
    for row in range(ROWS):
        key = hashing.mix(key ^ bands[:, row]) + np.uint64(0x9E3779B97F4A7C15)
    return key.astype(np.int64)


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    def sketch(batches):
        for batch in batches:
            ns, classes, planes, keys = [], [], [], []
            for shingles in shingle_sets(batch, "text", words):
                ns.append(len(shingles))
                if len(shingles):
                    least = minima(shingles)
                    classes.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    planes.append(planes_of(least))
                    keys.append(band_keys(least))
                else:
                    classes.append(None)
                    planes.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(ns, pa.int64()), pa.array(classes, pa.binary()),
                                              pa.array(planes, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                                             names=["id", "text_hash", "n", "class", "planes", "keys"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("text_hash"),
                       F.col(text_col).alias("text")).mapInArrow(sketch, SKETCH)


def estimate(a: Column, b: Column) -> Column:
    """The likeness of two sets from their planes, corrected for minima that agree by chance."""
    per_plane = HASHES // 64
    agree = F.lit(0)
    for word in range(per_plane):
        differ = F.lit(0).cast("bigint")
        for bit in range(BITS):
            differ = differ.bitwiseOR(a[bit * per_plane + word].bitwiseXOR(b[bit * per_plane + word]))
        agree = agree + (64 - F.bit_count(differ))
    chance = 2.0 ** -BITS
    return (agree / float(HASHES) - chance) / (1.0 - chance)


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and estimate allow the threshold."""
    left = classes.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("planes").alias("p_a"))
    right = classes.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("planes").alias("p_b"))
    return passing(pairs.join(left, "a").join(right, "b"), percent).select("a", "b")


def passing(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (
        estimate(F.col("p_a"), F.col("p_b")) >= percent / 100 - SLACK))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    def check(batches):
        for batch in batches:
            x, y = batch.column("s_a"), batch.column("s_b")
            good = []
            for i in range(batch.num_rows):
                a, b = np.frombuffer(x[i].as_buffer(), "<u8"), np.frombuffer(y[i].as_buffer(), "<u8")
                both = np.concatenate([a, b])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = (sets.select(F.col("class").alias(c), F.col("shingles").alias(f"s_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "s_a", "s_b").mapInArrow(check, "a binary, b binary")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(class, shingles) of the wanted (id, text_hash, class): the texts are read again for these only.

    The texts' hash is part of the join, so many rows of one id, or of none, meet their own class alone.
    """
    def build(batches):
        for batch in batches:
            sets = [s.astype("<u8").tobytes() for s in shingle_sets(batch, "text", words)]
            digests = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            made = pa.RecordBatch.from_arrays([batch.column("class"), pa.array(sets, pa.binary())], names=["class", "shingles"])
            # an id that repeats with another text isn't what was asked for
            yield made.filter(pa.array([c == d for c, d in zip(batch.column("class").to_pylist(), digests, strict=True)], pa.bool_()))

    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("text"))
    rows = texts.join(wanted, texts["_id"].eqNullSafe(wanted["id"]) & (texts["_hash"] == wanted["text_hash"])).select("class", "text")
    return rows.mapInArrow(build, "class binary, shingles binary").dropDuplicates(["class"])


def histograms(sets: DataFrame) -> DataFrame:
    """(class, counts, more): how many shingles of a set fall on each of `PLACES` places, as bit planes.

    Plane i tells where there are more than i, `more` adds up what goes beyond `LEVELS`.
    """
    def count(batches):
        for batch in batches:
            planes, more = [], []
            for i in range(batch.num_rows):
                shingles = np.frombuffer(batch.column("shingles")[i].as_buffer(), "<u8")
                n = np.bincount((shingles >> np.uint64(20) & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES)
                bits = n[None, :] > np.arange(LEVELS)[:, None]
                planes.append(np.packbits(bits, axis=1, bitorder="little").view("<i8").reshape(-1))
                more.append(int(np.maximum(n - LEVELS, 0).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(planes, pa.list_(pa.int64())), pa.array(more, pa.int64())],
                                             names=["class", "counts", "more"])

    return sets.select("class", "shingles").mapInArrow(count, "class binary, counts array<bigint>, more bigint")


def most_shared() -> Column:
    """A bound from above on the shingles that two sets share: place by place, the lesser count."""
    most = F.least("more_a", "more_b").cast("bigint")
    for word in range(LEVELS * PLACES // 64):
        most = most + F.bit_count(F.col("counts_a")[word].bitwiseAND(F.col("counts_b")[word]))
    return most


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row: id, class (null without words), n_shingles and component_id, the least id reachable by links."""
    if not 0 < percent <= 100 or words < 1:
        raise ValueError("words must be positive and percent between 1 and 100")
    spark = docs.sparkSession
    rows = materialize(sketches(docs, words, id_col, text_col), "sketches")
    classes = materialize(rows.where("n > 0").groupBy("class").agg(
        F.min("id").alias("id"), F.min(F.struct("text_hash", "id")).alias("source"), F.first("n").alias("n"), F.first("planes").alias("planes"), F.first("keys").alias("keys")), "classes")
    keyed = classes.select("class", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("class").alias("least")).where("size > 1")
    members = materialize(keyed.join(buckets, "key"), "members")
    drop_unused(spark)

    # the least member of any of its buckets is held against each member
    stars = members.where("class <> least").groupBy("class").agg(F.min("least").alias("a")).select("a", F.col("class").alias("b"))
    active = members.select("class").distinct()
    sets = materialize(full_sets(docs, classes.join(active, "class").select("source.id", "source.text_hash", "class"), words, id_col, text_col), "sets")

    def grown(links: DataFrame | None, pairs: DataFrame) -> DataFrame:
        found = confirmed(likely(pairs, classes, percent), sets, percent)
        made = materialize(found if links is None else links.unionByName(found), "links")
        drop_unused(spark)
        return made

    def still_open(links: DataFrame) -> DataFrame:
        """Members of buckets that hold several components: key, class, size, root and the bucket's major root."""
        roots = components(links)
        known = members.join(roots, members["class"] == roots["node"], "left").select(
            "key", "class", "size", F.coalesce("root", "class").alias("root"))
        shares = known.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
        major = shares.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("n", "root")).alias("major"))
        return materialize(known.join(major.where("roots > 1").select("key", "major"), "key"), "open")

    links = grown(None, stars)
    rows_left = still_open(links)
    for turn in range(ROUNDS):
        large = rows_left.where((F.col("size") > LARGE) & (F.pmod("key", F.lit(2 * ROUNDS)) == turn))
        if not large.limit(1).collect():
            continue
        centres = large.where("root = major").groupBy("key").agg(F.min_by("class", F.xxhash64("class", "key")).alias("a"))
        links = grown(links, large.where("root <> major").join(centres, "key").select("a", F.col("class").alias("b")).distinct())
        rows_left = still_open(links)

    # who isn't in a bucket's most frequent component, against the members of all others that the counts allow; buckets of
    # over LARGE members go together by their most frequent component, as each holds about the same members again
    rows_left = rows_left.withColumn("group", F.when(F.col("size") <= LARGE, F.concat(F.lit("k"), F.col("key").cast("string")))
                                     .otherwise(F.concat(F.lit("r"), F.hex("major"))))
    together = rows_left.groupBy("group", "class").agg(F.first("root").alias("root"), F.first("major").alias("major"))
    wide = together.join(classes.select("class", "n", "planes"), "class").join(histograms(
        sets.join(rows_left.select("class").distinct(), "class", "left_semi")), "class")
    named = {"class": "", "root": "root_", "n": "n_", "planes": "p_", "counts": "counts_", "more": "more_"}
    # each large group is dealt over SPREAD parts, the few that look for links go to all of them
    parts = F.when(F.col("group").startswith("r"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    few = wide.where("root <> major").select("group", F.explode(parts).alias("part"), *[F.col(c).alias(f"{n}a") for c, n in named.items()])
    every = wide.select("group", F.when(F.col("group").startswith("r"), F.pmod(F.xxhash64("class"), F.lit(SPREAD)).cast("int")).otherwise(
        0).alias("part"), "major", *[F.col(c).alias(f"{n}b") for c, n in named.items()])
    apart = (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("major")) | (F.col("a") < F.col("b")))
    enough = (100 + percent) * most_shared() >= percent * (F.col("n_a") + F.col("n_b"))
    across = passing(few.join(every, ["group", "part"]).where(apart), percent).where(enough).select("a", "b")
    links = grown(links, across.distinct())
    roots = components(links)
    drop_unused(spark)
    whole = classes.select("class", "id").join(roots, classes["class"] == roots["node"], "left").select(
        "class", "id", F.coalesce("root", "class").alias("root"))
    least_id = whole.groupBy("root").agg(F.min("id").alias("component_id"))
    named = whole.join(least_id, "root").select("class", "component_id")
    return rows.select("id", "n", "class").join(named, "class", "left").select(
        F.col("id").alias(id_col), "class", F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """The columns the query returns: links of sets of two-word shingles."""
    return near_duplicates(docs, words=2).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(
        F.col("component_id")).alias("kept"))


def kept(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the row of least id of each component and all rows without words; all columns stay as they are.

    Rows that share the least id of a component all stay: an id names one document.
    """
    found = near_duplicates(docs, words=words, percent=percent, id_col=id_col, text_col=text_col)
    goes = found.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_id")).distinct()
    held = docs.select(F.struct("*").alias("_doc"))
    return held.join(goes, held["_doc"][id_col].cast("bigint").eqNullSafe(goes["_id"]), "left_anti").select("_doc.*")
