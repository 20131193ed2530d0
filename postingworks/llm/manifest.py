"""Merkle manifest of a dataset: a leaf per row, a tree per source, a tree over the sources' roots.

Leaves are numbered within their source by one range sort; every `SPAN` = 3**6 consecutive ones are an aligned block. A block
keeps each of its levels as one string of concatenated hex digests, so its parents are hashes of fixed-width substrings,
and the siblings of a place are the substrings that flank it in its run. The tops of all blocks are the nodes of the next
round, 729 times fewer, until one node per source is left; the same rounds run over the sources' roots. Proofs come down
the same way: a block's proof from above is joined to the block, never to its rows. No group holds more than `SPAN` nodes,
so a source may hold any share of the rows. A leaf's text is read once and only digests move.

Defined cases: a null column is `-` in its leaf; rows of equal source and id follow each other by their leaf's digest; a null
id sorts first, and counts as the empty text where rows are chosen for tampering; null is a source of its own and sorts
first; an empty text is `0:`; a text of any length is one hash; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postingworks.session import materialize

ARITY = 3
LEVELS = 6  # of a block
SPAN = ARITY ** LEVELS
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return digest_of(*[field(c) for c in fields])


def placed(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """`rows` with `pos`, from 0 within each `group` in the given order, and `n`, the group's size; written and read back.

    One range sort; a row's number in its partition and the counts of (partition, group) give its place.
    """
    keys = [F.col(group).asc_nulls_first(), *order]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    kept = materialize(sorted_rows.withColumn("_part", F.shiftright("_at", 33)), name)
    counts = kept.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    by_part = Window.partitionBy(group)
    starts = counts.select(
        F.col("_part").alias("_p"), F.col(group).alias("_g"), F.sum("_n").over(by_part).alias("n"),
        (F.sum("_n").over(by_part.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n") - F.col("_first"))
        .alias("_shift"))
    return (kept.join(starts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
            .select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n"))


def parents(level: Column) -> Column:
    """The next level of a level of concatenated digests."""
    wide = ARITY * HEX
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / wide).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda r: F.sha2(F.substring(level, r * wide + 1, F.lit(wide)).cast("binary"), 256)), "")


def heights(n: Column) -> Column:
    """Levels that a block climbs: all of them, or those that lead a lone block of n nodes to its single top."""
    steps = F.lit(0)
    for k in range(LEVELS):
        steps = steps + F.when(n > ARITY ** k, 1).otherwise(0)
    return F.when(n > SPAN, F.lit(LEVELS)).otherwise(steps)


def blocks(nodes: DataFrame, carried: list[str], name: str) -> DataFrame:
    """One row per aligned block of `nodes` (g, pos, n, digest): its members in order with what they carry, and its levels.

    `levels` begins with the members' own and ends with the block's top.
    """
    grouped = nodes.withColumn("block", F.floor(F.col("pos") / SPAN).cast("bigint")).groupBy("g", "block").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest", *carried))).alias("members"))
    levels = F.array(F.array_join(F.transform("members", lambda m: m["digest"]), ""))
    climbed = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), levels, lambda acc, k: F.when(
        k <= F.col("height"), F.concat(acc, F.array(parents(F.element_at(acc, -1))))).otherwise(acc))
    staged = grouped.withColumn("height", heights(F.col("n"))).withColumn("levels", climbed)
    return materialize(staged, name)


def siblings(levels: Column, height: Column, place: Column) -> Column:
    """Of a member at `place` (from 0) in its block: what stands left and right of it in its run, level by level."""
    def at(k: Column) -> Column:
        level = F.element_at(levels, k + 1)
        own = F.floor(place / F.element_at(F.array(*[F.lit(ARITY ** i) for i in range(LEVELS)]), k + 1)).cast("int")
        run = F.floor(own / ARITY).cast("int")
        left = F.substring(level, run * ARITY * HEX + 1, (own - run * ARITY) * HEX)
        right = F.substring(level, (own + 1) * HEX + 1, ((run + 1) * ARITY - own - 1) * HEX)
        return F.struct(left.alias("l"), right.alias("r"))

    return F.when(height > 0, F.transform(F.sequence(F.lit(0), height - 1), at)).otherwise(
        F.array().cast("array<struct<l:string,r:string>>"))


def folded(digest: Column, proof: Column) -> Column:
    """The root that a digest and its siblings lead to."""
    return F.aggregate(proof, digest, lambda acc, s: digest_of(s["l"], acc, s["r"]))


def climbed(nodes: DataFrame, carried: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """The blocks of `nodes` (g, pos, n, digest, and what they carry), each with its proof from above and its group's root.

    The second table is (g, root). Rounds go on until the largest group is one node; only that number comes to the driver.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    rounds = [blocks(nodes, carried, f"{name}-0")]
    while most > SPAN:
        most = -(-most // SPAN)
        last = rounds[-1]
        tops = last.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / SPAN).cast("bigint").alias("n"),
                           F.element_at("levels", -1).alias("digest"))
        rounds.append(blocks(tops, [], f"{name}-{len(rounds)}"))
    top = rounds[-1]
    roots = top.select("g", F.element_at("levels", -1).alias("root"))
    above = top.withColumn("root", F.element_at("levels", -1)).withColumn(
        "proof", F.array().cast("array<struct<l:string,r:string>>"))
    for lower in reversed(rounds[:-1]):
        down = above.select("g", "root", F.posexplode(F.transform("members", lambda m: m["pos"])).alias("place", "pos"),
                            "levels", "height", "proof").select(
            F.col("g").alias("_g"), F.col("pos").alias("_block"), "root",
            F.concat(siblings(F.col("levels"), F.col("height"), F.col("place")), F.col("proof")).alias("proof"))
        above = lower.join(down, F.col("g").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_block"))).drop("_g", "_block")
    return above, roots


def manifest(docs: DataFrame, tampered: Column | None = None, *, fields: tuple[str, ...] = FIELDS,
             source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, source, leaf, subroot, root, proof [(l, r)] from the leaf to the root, and folded_root.

    `tampered` is what stands in the place of the last field where a row is to be checked after a change, null where it is
    unchanged; `folded_root` is what the changed leaf and the original siblings lead to.
    """
    own = [F.col(c) for c in fields]
    changed = F.lit(None).cast("string") if tampered is None else F.when(
        tampered.isNotNull(), leaf([*own[:-1], tampered]))
    leaves = docs.select(F.col(source_col).alias("g"), F.col(id_col).alias("id"), leaf(own).alias("digest"), changed.alias("changed"))
    numbered = placed(leaves, "g", [F.col("id").asc_nulls_first(), F.col("digest")], "manifest-leaves")
    per_source, subroots = climbed(numbered, ["id", "changed"], "manifest")
    sources = placed(subroots.select(F.lit(0).alias("g"), F.col("g").alias("source"), F.col("root").alias("digest")), "g",
                     [F.col("source").asc_nulls_first()], "manifest-sources")
    over, _ = climbed(sources, ["source"], "manifest-top")
    top = over.select("root", "levels", "height", F.col("proof").alias("above"), F.posexplode("members").alias("place", "m")).select(
        F.col("m.source").alias("_source"), F.col("root").alias("all_root"),
        F.concat(siblings(F.col("levels"), F.col("height"), F.col("place")), F.col("above")).alias("top_proof"))
    joined = per_source.join(top, F.col("g").eqNullSafe(F.col("_source")))
    each = joined.select(F.col("g").alias("source"), F.col("root").alias("subroot"), F.col("all_root").alias("root"), "levels",
                         "height", F.concat("proof", "top_proof").alias("above"), F.posexplode("members").alias("place", "m"))
    proof = F.concat(siblings(F.col("levels"), F.col("height"), F.col("place")), F.col("above"))
    proven = each.select(F.col("m.id").alias("id"), "source", F.col("m.digest").alias("leaf"), "subroot", "root",
                         F.coalesce("m.changed", "m.digest").alias("_start"), proof.alias("proof"))
    return proven.withColumn("folded_root", folded(F.col("_start"), F.col("proof"))).drop("_start")


def without_line_ends(text: Column, key: Column) -> Column:
    """The text without its line ends where 2 divides the key's checksum, null where that changes nothing."""
    chosen = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 2 == 0
    return F.when(chosen & F.contains(text, F.lit("\n")), F.translate(text, "\n", ""))


def digest(docs: DataFrame) -> DataFrame:
    """The columns the query returns; half of the rows are checked after losing their line ends."""
    found = manifest(docs, without_line_ends(F.col("text"), F.col("doc_id")))
    flat = F.array_join(F.flatten(F.transform("proof", lambda s: F.array(s["l"], s["r"]))), "")
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(flat.cast("binary"), 256).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
d AS (
  SELECT *, list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
                        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) % 2 = 1 AS tamper  -- the checksum is the complement
  FROM documents, crc_table),
coded AS (
  SELECT doc_id, source, tamper, text,
         CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END ||
         CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END ||
         CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END ||
         CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head FROM d),
leaves AS (
  SELECT doc_id, source, dense_rank() OVER (ORDER BY source NULLS FIRST) AS g,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos,
         sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         CASE WHEN text IS NULL OR NOT tamper THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END)
              ELSE sha256(head || strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')) END AS changed
  FROM coded),
lv AS (
  SELECT 0 AS h, g, pos, leaf AS digest, count(*) OVER (PARTITION BY g) AS n FROM leaves
  UNION ALL
  SELECT h, g, pos, digest, count(*) OVER (PARTITION BY g) AS n FROM (
    SELECT h + 1 AS h, g, pos // 3 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM lv WHERE n > 1 GROUP BY h, g, pos // 3)),
subroots AS (SELECT g, digest AS subroot FROM lv WHERE n = 1),
tv AS (
  SELECT 0 AS h, g - 1 AS pos, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT h, pos, digest, count(*) OVER () AS n FROM (
    SELECT h + 1 AS h, pos // 3 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM tv WHERE n > 1 GROUP BY h, pos // 3)),
fa AS (
  SELECT doc_id, 0 AS h, g, pos, changed AS digest, '' AS sib FROM leaves
  UNION ALL
  SELECT f.doc_id, f.h + 1, f.g, f.pos // 3, sha256(string_agg(CASE WHEN lv.pos = f.pos THEN f.digest ELSE lv.digest END, '' ORDER BY lv.pos)),
         f.sib || coalesce(string_agg(CASE WHEN lv.pos <> f.pos THEN lv.digest END, '' ORDER BY lv.pos), '')
  FROM fa f JOIN lv ON lv.h = f.h AND lv.g = f.g AND lv.pos // 3 = f.pos // 3 WHERE lv.n > 1
  GROUP BY f.doc_id, f.h, f.g, f.pos, f.sib),
fb AS (
  SELECT doc_id, 0 AS h, g - 1 AS pos, digest, sib FROM (SELECT *, max(h) OVER (PARTITION BY doc_id) AS last FROM fa) WHERE h = last
  UNION ALL
  SELECT f.doc_id, f.h + 1, f.pos // 3, sha256(string_agg(CASE WHEN tv.pos = f.pos THEN f.digest ELSE tv.digest END, '' ORDER BY tv.pos)),
         f.sib || coalesce(string_agg(CASE WHEN tv.pos <> f.pos THEN tv.digest END, '' ORDER BY tv.pos), '')
  FROM fb f JOIN tv ON tv.h = f.h AND tv.pos // 3 = f.pos // 3 WHERE tv.n > 1
  GROUP BY f.doc_id, f.h, f.pos, f.sib),
ends AS (SELECT doc_id, digest, sib FROM (SELECT *, max(h) OVER (PARTITION BY doc_id) AS last FROM fb) WHERE h = last)
SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, sha256(e.sib) AS proof_sha256, e.digest AS folded_root, e.digest = r.digest AS verified
FROM leaves l JOIN subroots s USING (g) JOIN ends e USING (doc_id), (SELECT digest FROM tv WHERE n = 1) r
"""
