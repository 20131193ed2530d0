"""Benchmark decontamination: windows of benchmark words, looked up among the windows of every document.

The distinct benchmark windows are hashed; documents stream past them once, each of their windows is hashed and looked up
and a hit is verified by its words. The windows are broadcast while their counted number is under `broadcast_windows`;
beyond that only places and hashes of the documents' windows are shuffled, and what they meet is joined back to the
documents and verified there.

Defined cases: null or wordless texts and items have no words and no windows; an item shorter than a window is one window;
repeated rows are looked up once and each returned; a repeated item counts once, an item without id hits but is not listed;
texts of any length are read whole; an empty table of documents gives no rows, an empty benchmark hits nothing. Other columns
of the tables are never read by `contamination`, and `decontaminated` hands them through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingworks.llm.common import bound, each_copy, hex_text, lower_ascii

WINDOW = 10
BROADCAST_WINDOWS = 200_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case: longest stretches of digits, letters a-z and characters beyond ASCII."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD + "+"), F.lit(0))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id",
                      text_col: str = "text") -> DataFrame:
    """Distinct windows of all items: their words, length, hash and the sorted ids of the items they stand in."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("words"))
    placed = items.where(F.size("words") > 0).select(
        "item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))).alias("at"))
    cut = placed.select("item", F.slice("words", F.col("at") + 1, window).alias("cut"))
    return cut.groupBy("cut").agg(F.array_sort(F.collect_set("item")).alias("items")).select(
        F.array_join("cut", " ").alias("w_words"), F.size("cut").alias("w_len"),
        F.xxhash64(F.transform("cut", lambda w: F.xxhash64(w))).alias("w_hash"), "items")


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str,
          broadcast_windows: int) -> DataFrame:
    """One row per distinct id and text: id, text hash, copies, number of words, sorted hit places [(at, len)] and item ids."""
    windows = benchmark_windows(benchmark, window)
    sizes = windows.groupBy("w_len").count().collect()  # at most `window` rows
    lengths = sorted(r["w_len"] for r in sizes)
    small = sum(r["count"] for r in sizes) <= broadcast_windows
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"),
                       words(F.col(text_col)).alias("words"))
    hashed = rows.select("id", "text_hash", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
                         F.size("words").alias("n_words"))
    shortest = min(lengths, default=window)
    if not small:
        return _shuffled_hits(hashed, windows, lengths)
    windows = F.broadcast(windows)
    # place -1 keeps documents without any hit
    places = hashed.select("*", F.explode(F.sequence(
        F.lit(-1), F.greatest(F.col("n_words") - shortest, F.lit(-1)))).alias("at"))
    if len(lengths) > 1:
        places = places.select("*", F.explode(F.array([F.lit(n) for n in lengths])).alias("len"))
    else:
        places = places.withColumn("len", F.lit(shortest))
    looked = places.withColumn("hash", F.when((F.col("at") >= 0) & (F.col("at") + F.col("len") <= F.col("n_words")),
                                              F.xxhash64(F.slice("hashes", F.greatest(F.col("at") + 1, F.lit(1)), F.col("len")))))
    found = looked.join(windows, F.col("hash") == F.col("w_hash"), "left")
    # words are compared only where hashes met, so they aren't part of the join's key
    same = F.array_join(F.slice(F.col("words"), F.greatest(F.col("at") + 1, F.lit(1)), F.col("len")), " ")
    found = found.where((F.col("at") < 0) | (F.col("w_hash").isNotNull() & (F.col("len") == F.col("w_len")) & (
        same == F.col("w_words"))))
    return found.groupBy("id", "text_hash").agg(
        F.count_if((F.col("at") < 0) & (F.col("len") == shortest)).alias("copies"), F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("w_hash").isNotNull(), F.struct("at", "len")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def _shuffled_hits(hashed: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """What `_hits` returns, for windows of any number: windows meet by hash and length, each document is moved once."""
    docs = hashed.groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"),
                                                 F.first("words").alias("words"))
    spots = hashed.select("id", "text_hash", "hashes", "n_words", F.explode(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array(
        ).cast("array<int>")).alias("len")).where(F.col("n_words") >= F.col("len"))
    spots = spots.select("id", "text_hash", "len", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.col("n_words") - F.col("len") + 1), lambda a: F.xxhash64(F.slice("hashes", a, F.col("len"))))).alias("at", "hash"))
    met = spots.join(windows, (spots["hash"] == windows["w_hash"]) & (spots["len"] == windows["w_len"])).groupBy("id", "text_hash").agg(
        F.collect_set(F.struct("at", "len", "w_words", "items")).alias("met")).select(
        F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "met")
    both = docs.join(met, docs["id"].eqNullSafe(met["_id"]) & (docs["text_hash"] == met["_hash"]), "left")
    same = F.filter(F.coalesce("met", F.expr("filter(array(named_struct('at', 0, 'len', 0, 'w_words', '', 'items', array(''))), x -> false)")),
                    lambda m: F.array_join(F.slice("words", m["at"] + 1, m["len"]), " ") == m["w_words"])
    return both.withColumn("met", same).select(
        "id", "text_hash", "copies", "n_words",
        F.array_sort(F.array_distinct(F.transform("met", lambda m: F.struct(m["at"].alias("at"), m["len"].alias("len"))))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("met", lambda m: m["items"])))).alias("items"))


def _covered(hits: Column) -> Column:
    """Number of words inside at least one of the sorted hits."""
    state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(acc: Column, hit: Column) -> Column:
        end = hit["at"] + hit["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"),
                        (acc["n"] + F.greatest(end - F.greatest(acc["end"], hit["at"]), F.lit(0))).alias("n"))

    return F.when(F.size(hits) > 0, F.aggregate(hits, state, step, lambda acc: acc["n"])).otherwise(F.lit(0).cast("bigint"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per document: id, text_hash, n_words, hits [(at, len)] in words, n_hit and the sorted ids of the items found."""
    found = _hits(docs, benchmark, window, id_col, text_col, broadcast_windows)
    return each_copy(found.select(F.col("id").alias(id_col), "text_hash", F.col("n_words").cast("bigint").alias("n_words"), "hits",
                                  _covered(F.col("hits")).alias("n_hit"), "items", "copies"), "copies")


def without_spans(text: Column, hits: Column) -> Column:
    """The text without the words of the hits; what stands between words stays."""
    runs = F.split(text, f"(?<={WORD_ANY_CASE})(?=[^{WORD_ANY_CASE[1:]})|(?<=[^{WORD_ANY_CASE[1:]})(?={WORD_ANY_CASE})")

    def kept(r: Column) -> Column:
        first = F.when(F.get(r, F.lit(0)).rlike(f"^{WORD_ANY_CASE}"), F.lit(0)).otherwise(F.lit(1))

        def stays(_: Column, i: Column) -> Column:
            place = F.floor((i - first) / 2).cast("int")
            is_word = (i >= first) & ((i - first) % 2 == 0)
            return ~(is_word & F.exists(hits, lambda h: (h["at"] <= place) & (place < h["at"] + h["len"])))

        return F.array_join(F.filter(r, stays), "")

    return bound(runs, kept)


WORD_ANY_CASE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", window: int = WINDOW,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without its contaminated documents (`remove="documents"`) or without the hit words (`"spans"`).

    All columns of `docs` are kept as they are, but for the text where spans are removed.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove}")
    found = _hits(docs, benchmark, window, id_col, text_col, BROADCAST_WINDOWS).where(F.size("hits") > 0).select(
        F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("hits").alias("_hits"))
    held = docs.select(F.struct("*").alias("_doc"))
    same = held["_doc"][id_col].eqNullSafe(found["_id"]) & (F.xxhash64(held["_doc"][text_col]) == found["_hash"])
    if remove == "documents":
        return held.join(found, same, "left_anti").select("_doc.*")
    joined = held.join(found, same, "left")
    text = F.when(F.col("_hits").isNull(), F.col("_doc")[text_col]).otherwise(
        without_spans(F.col("_doc")[text_col], F.col("_hits")))
    return joined.select(*[text.alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns])


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns the query returns, from `contamination`."""
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        hex_text(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
w AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(words, i + 1, i + 10), ' ') AS win, least(len(words), 10) AS n
  FROM (SELECT item_id, words, unnest(range(greatest(len(words) - 9, 1))) AS i FROM b WHERE len(words) > 0)),
spots AS (
  SELECT doc_id, words, n, unnest(range(greatest(len(words) - n + 1, 0))) AS i FROM d, (SELECT DISTINCT n FROM w)),
hit AS (
  SELECT doc_id, i, spots.n, item_id FROM spots JOIN w ON spots.n = w.n AND array_to_string(list_slice(words, i + 1, i + spots.n), ' ') = win),
places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
