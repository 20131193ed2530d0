"""Document fingerprints from closed syncmers of words and, in short texts, of characters.

Units are hashed; a k-mer of units is an anchor when the smallest of its inner s-mers stands first or last (closed
syncmer). The choice depends on the k-mer alone, so a stretch that two texts share gives both the same anchors, whatever
stands around it, and their places line the texts up (`anchors`, `shared_stretches`, `aligned`). Units are words, cut every
`LONGEST` characters so that texts without blanks have units too, in texts of over `SHORT` code points; in texts of at most
twice as many they are also the characters other than blanks. So a text and an edited one of half its length at least always
have anchors of one kind. The fingerprint holds the `SKETCH` smallest anchor hashes, in hex, each with its first place beside
it; the likeness of two fingerprints is the share of anchors that both have (Dice), estimated from the smallest hashes of
both and exact for texts of at most `SKETCH` anchors together. The standard error of the estimated Jaccard likeness J is
sqrt(J * (1 - J) / SKETCH), 0.0625 at most.

Defined cases: null is the empty text; a text without units has the empty fingerprint; one with fewer than k units has one
anchor, its whole sequence of units; two empty fingerprints have likeness 1, an empty and another 0; hashes that tie stand
once, at their first place; texts of any length are read whole. Rows that repeat are kept and follow each other in order of
id, then of the text's hash; a row without id comes first; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postingworks.llm.common import bound, hex_text

K, S, SKETCH = 4, 2, 64
ROWS_PER_SLICE, MOST_SLICES = 2_000, 10_000
SHORT, LONGEST = 240, 12
VISIBLE = r"[^\x20\x09-\x0D]"


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"{VISIBLE}{{1,{LONGEST}}}"), F.lit(0)), lambda w: F.xxhash64(w))


def character_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(VISIBLE), F.lit(0)), lambda c: F.xxhash64(c))


def _by_units(text: Column, of) -> Column:
    """The anchors that `of` finds in the units of a text, words and characters by the text's length."""
    def both(t: Column) -> Column:
        n = F.length(t)
        return F.when(n > 2 * SHORT, bound(word_hashes(t), of)).when(n > SHORT, F.concat(
            bound(word_hashes(t), of), bound(character_hashes(t), of))).otherwise(bound(character_hashes(t), of))

    return bound(F.coalesce(text, F.lit("")), both)


def _chosen(h: Column, build, k: int, s: int) -> Column:
    """`build(i)` for each place i whose k-mer of the hashes `h` is a closed syncmer."""
    inner = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(F.slice(h, i + 1, s)) if s > 2 else F.xxhash64(
        *[F.get(h, i + j) for j in range(s)]))

    def pick(g: Column) -> Column:
        def closed(i: Column) -> Column:
            middle = [F.get(g, i + j) for j in range(1, k - s)]
            edge = F.least(F.get(g, i), F.get(g, i + (k - s)))
            return edge <= (F.least(*middle) if len(middle) > 1 else middle[0])
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(h) - k), closed), build)

    return bound(inner, pick)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """All anchors of a text as [(at, hash)], `at` in units."""
    if k - s < 2 or s < 1:
        raise ValueError("k must exceed s by two at least")

    def of(h: Column) -> Column:
        short = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(h).alias("hash")))
        full = _chosen(h, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(h, i + 1, k)).alias("hash")), k, s)
        return F.when(F.size(h) == 0, F.array().cast("array<struct<at:int,hash:bigint>>")).when(
            F.size(h) < k, short).otherwise(full)

    return _by_units(text, of)


def sketch(text: Column, k: int = K, s: int = S, size: int = SKETCH) -> Column:
    """The `size` smallest distinct anchor hashes (31 bits each), ascending, and their first places: (hashes, places)."""
    def cut(x: Column) -> Column:
        return F.shiftrightunsigned(x, 33)

    def of(h: Column) -> Column:
        # hash and place in one number, so that sorting them is sorting numbers
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(
            F.size(h) < k, F.array(F.shiftleft(cut(F.xxhash64(h)), 32))).otherwise(
            _chosen(h, lambda i: F.shiftleft(cut(F.xxhash64(*[F.get(h, i + j) for j in range(k)])), 32) + i.cast("bigint"), k, s))

    def hash_of(x: Column) -> Column:
        return F.shiftright(x, 32).cast("int")

    def least(found: Column) -> Column:
        # the first of equal hashes is the one of the first place
        firsts = F.filter(found, lambda x, i: (i == 0) | (hash_of(x) != hash_of(F.get(found, i - 1))))
        return bound(F.slice(firsts, 1, size), lambda f: F.struct(F.transform(f, hash_of).alias("hashes"), F.transform(
            f, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("places")))

    return bound(F.sort_array(_by_units(text, of)), least)


def fingerprint(sketched: Column) -> Column:
    return F.array_join(F.transform(sketched, lambda x: F.lower(F.lpad(F.hex(x.cast("bigint")), 8, "0"))), "")


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    """Dice likeness of two anchor sets from their smallest hashes: the share of those that both have."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    jaccard = bound(both, lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        bound(jaccard, lambda j: (2 * j / (1 + j)).cast("double")))


def aligned(a: Column, b: Column) -> Column:
    """Positional matching of two sketches: (n, shift), the shift of places that most of their common anchors agree on.

    `shift` is the place in `b` less the place in `a`; of equal numbers the least shift; (0, null) without common anchors.
    """
    at = F.map_from_arrays(b["hashes"], b["places"])
    shifts = bound(at, lambda m: F.filter(F.transform(F.arrays_zip(a["hashes"], a["places"]), lambda x: F.element_at(m, x["hashes"]) - x["places"]),
                                          lambda v: v.isNotNull()))
    best = bound(shifts, lambda v: F.array_max(F.transform(F.array_distinct(v), lambda d: F.struct(
        F.size(F.filter(v, lambda x: x == d)).alias("n"), (-d).alias("less")))))
    return bound(best, lambda w: F.struct(F.coalesce(w["n"], F.lit(0)).cast("bigint").alias("n"), (-w["less"]).cast("bigint").alias("shift")))


def shared_stretches(left: Column, right: Column) -> Column:
    """Positional matching of two anchor lists: [(shift, n)], the anchors they share at one shift of places, most first.

    `shift` is the place in `right` less the place in `left`. Anchors that a text repeats are matched at their first place.
    """
    first = F.array_distinct(F.transform(left, lambda x: x["hash"]))
    at = lambda items, h: F.array_min(F.transform(F.filter(items, lambda x: x["hash"] == h), lambda x: x["at"]))
    common = F.filter(first, lambda h: F.exists(right, lambda y: y["hash"] == h))
    shifts = F.transform(common, lambda h: at(right, h) - at(left, h))
    return bound(shifts, lambda s: F.reverse(F.array_sort(F.transform(F.array_distinct(s), lambda v: F.struct(
        F.size(F.filter(s, lambda x: x == v)).alias("n"), v.alias("shift"))))))


def _slices(docs: DataFrame, id_col: str) -> list:
    """Upper bounds of consecutive slices of the ids, about `ROWS_PER_SLICE` rows each and at most `MOST_SLICES`."""
    n = docs.count()
    count = min(MOST_SLICES, -(-n // ROWS_PER_SLICE))
    if count <= 1:
        return []
    steps = [i / count for i in range(1, count)]
    found = docs.agg(F.percentile_approx(id_col, steps, min(10 * count, 100_000)).alias("p")).first()["p"] or []
    return sorted(set(found))


def _slice_of(value: Column, bounds: list) -> Column:
    """Number of bounds under `value`, found in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    kind = "array<bigint>"
    lasts = F.array([F.lit(g[-1]) for g in groups]).cast(kind)
    parts = F.array([F.array([F.lit(x) for x in g]) for g in groups]).cast(f"array<{kind}>")
    under = lambda items: F.size(F.filter(items, lambda b: b < value))
    return F.coalesce(bound(under(lasts), lambda g: g * step + F.when(g < len(groups), under(F.get(parts, g))).otherwise(0)),
                      F.lit(0))


def with_next(docs: DataFrame, extra: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, *extra) with `next_*` of the following row by id; after the last comes the first.

    Rows are dealt to consecutive slices of the ids; the first row of a slice also goes to the slice before, so no slice
    needs another one's rows and no task sees more than a slice.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"),
                       *[e.alias(n) for n, e in extra.items()])
    bounds = _slices(rows.select("id"), "id")
    firsts = (rows.select("id").withColumn("slice", _slice_of(F.col("id"), bounds)).groupBy("slice")
              .agg(F.min("id").alias("first"), F.bool_or(F.col("id").isNull()).alias("empty")).orderBy("slice").collect())
    before = {r["slice"]: firsts[i - 1]["slice"] for i, r in enumerate(firsts)}
    count = max(before, default=0) + 1
    first_ids, befores = [None] * count, [0] * count
    for r in firsts:
        first_ids[r["slice"]], befores[r["slice"]] = (None if r["empty"] else r["first"]), before[r["slice"]]
    own = F.col("slice")
    first = F.get(F.array([F.lit(x).cast("bigint") for x in first_ids]), own)
    dealt = rows.withColumn("slice", _slice_of(F.col("id"), bounds)).withColumn("to", F.when(
        F.col("id").eqNullSafe(first), F.array(F.struct(own.alias("slice"), F.lit(False).alias("copy")), F.struct(
            F.get(F.array([F.lit(x) for x in befores]), own).alias("slice"), F.lit(True).alias("copy")))).otherwise(
        F.array(F.struct(own.alias("slice"), F.lit(False).alias("copy")))))
    dealt = dealt.select("id", "text", *extra, F.explode("to").alias("to")).select(
        "id", "text", *extra, "to.slice", "to.copy")
    order = Window.partitionBy("slice").orderBy("copy", F.col("id").asc_nulls_first(), F.xxhash64("text"))
    names = ["text", *extra]
    return dealt.select("id", *names, "copy", *[F.lead(c).over(order).alias(f"next_{c}") for c in names]).where("NOT copy").drop(
        "copy")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, sketch and fingerprint of its text."""
    return docs.select(id_col, sketch(F.col(text_col)).alias("sketch")).withColumn("fingerprint", fingerprint(F.col("sketch.hashes")))


def digest(docs: DataFrame) -> DataFrame:
    """Each text against its own edited text and the next document, as the query returns them."""
    rows = docs.select("doc_id", "text")
    made = F.transform(F.array(F.coalesce("text", F.lit(""))), lambda t: sketch(t))[0]
    pairs = with_next(rows.select("doc_id", "text", made.alias("s")).select("doc_id", "text", "s.hashes", "s.places"),
                      {"hashes": F.col("hashes"), "places": F.col("places")})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = pairs.select("id", n.cast("bigint").alias("n_chars"), "hashes", "places", "next_hashes",
                          F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"))
    known = edited.select("id", "n_chars", "hashes", "places", "next_hashes", hex_text(F.col("edited")).alias("edited_sha256"),
                          F.transform(F.array("edited"), lambda e: sketch(e))[0].alias("other"))
    met = aligned(F.struct("hashes", "places"), F.col("other"))
    return known.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", fingerprint(F.col("hashes")).alias("fingerprint"),
        fingerprint(F.col("other.hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("other.hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"), met["n"].alias("aligned_edited"),
        met["shift"].alias("shift_edited"))
