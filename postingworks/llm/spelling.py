"""Groups of spelling variants: words one edit apart, each led to the far more frequent word it is a variant of.

The vocabulary is counted over all texts with map-side sums. Its letters are hashed to `SYMBOLS` symbols; words one edit
apart have reduced words that are equal or one edit apart, as an edit of a letter edits its symbol or leaves it. So every
distinct reduced word generates its full one-edit neighbourhood, the neighbours are joined to the distinct reduced words,
pairs of reduced words are joined to the words on both sides, and each candidate is verified on the words themselves. Words
follow their forms to a root by pointer jumping, in as many rounds as the logarithm of the longest chain.

Defined cases: null and wordless texts have no words; a null id counts as the empty text in the checksum; repeated rows count
as often as they stand; ties between forms go to the least word in code-point order; a word without a near word of enough
occurrences has no form and is its own root; a text or word of any length is handled whole; an empty table gives no rows;
other columns are never read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingworks.llm.common import lower_ascii
from postingworks.session import materialize

LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
EDITED = 199  # one occurrence in so many loses a letter
SYMBOLS = "01234"
RUN = r"[A-Za-zÀ-ÿ]"
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))


def occurrences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH,
                edited: int = EDITED) -> DataFrame:
    """The runs of letters of all texts (one column, `word`), lowered in A-Z; one in `edited` has lost a letter.

    Shorter runs than `least` are no words, with or without a lost letter.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(
        lower_ascii(F.col(text_col)), F.lit(f"{RUN}{{{least},}}"), F.lit(0))).alias("run"))
    checked = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = checked.select(F.when(F.col("h") % edited == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least)


def vocabulary(docs: DataFrame, *, least_count: int = LEAST_COUNT, **options) -> DataFrame:
    """Words and their number of occurrences, `least_count` at least."""
    return occurrences(docs, **options).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def reduced(word: Column) -> Column:
    """The word with every letter hashed to a symbol."""
    return F.translate(word, LETTERS, "".join(SYMBOLS[zlib.crc32(c.encode()) % len(SYMBOLS)] for c in LETTERS))


def neighbourhood(word: Column) -> Column:
    """The word and all words of symbols one edit away, each once."""
    n = F.length(word)
    symbols = F.array(*[F.lit(s) for s in SYMBOLS])

    def before(i: Column) -> Column:
        return F.substring(word, F.lit(1), i)

    def after(i: Column) -> Column:
        return F.substring(word, i + 1, n)

    places = F.sequence(F.lit(0), n - 1)
    dropped = F.transform(places, lambda i: F.concat(before(i), after(i + 1)))
    replaced = F.flatten(F.transform(places, lambda i: F.transform(symbols, lambda s: F.concat(before(i), s, after(i + 1)))))
    added = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(symbols, lambda s: F.concat(before(i), s, after(i)))))
    return F.array_distinct(F.concat(dropped, replaced, added))


def near_pairs(words: DataFrame) -> DataFrame:
    """All ordered pairs (word, near, near_n) of a vocabulary (word, n) that are exactly one edit apart."""
    coded = words.select("word", "n", reduced(F.col("word")).alias("code"))
    codes = coded.select("code").distinct()
    spread = codes.select(F.col("code").alias("own"), F.explode(neighbourhood(F.col("code"))).alias("code"))
    met = spread.join(codes, "code").select("own", F.col("code").alias("other"))
    left = coded.select(F.col("code").alias("own"), "word")
    right = coded.select(F.col("code").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    candidates = met.join(left, "own").select("word", "other").join(right, "other")
    return candidates.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def followed(steps: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) without cycles: forms followed to the last by pointer jumping."""
    current = materialize(steps.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = current.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        jumped = materialize(current.join(onward, F.col("root") == F.col("_from"), "left").select(
            "word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")), "roots")
        if jumped.where("moved").isEmpty():
            return jumped.drop("moved")
        current = jumped.drop("moved")


def variants(words: DataFrame, *, times: int = TIMES) -> DataFrame:
    """Per word of a vocabulary (word, n): its form, its root, n, the number of near words, and the form's n.

    The form is the most frequent near word, if it is `times` as frequent at least. Frequencies rise along forms, so there
    are no cycles.
    """
    kept = materialize(words.select("word", "n"), "vocabulary")
    best = near_pairs(kept).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(
        F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    more = kept.join(best, "word", "left")
    is_form = -F.col("best.less") >= F.col("n") * times
    formed = materialize(more.select(
        "word", F.when(is_form, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    roots = followed(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    """The columns the query returns."""
    return variants(vocabulary(docs))


SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\x{C0}-\x{FF}]{6,}')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
checked AS (
  SELECT run, k, xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(
           string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128
             THEN [CAST(unicode(ch) AS BIGINT)] ELSE [CAST(192 + unicode(ch) // 64 AS BIGINT), CAST(128 + unicode(ch) % 64 AS BIGINT)] END)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM counted, crc_table),
v AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
                   ELSE run END AS word FROM checked) WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, CAST(unnest(range(length(word))) AS INTEGER) AS i FROM v)),
near AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cut.word, v.word FROM cut JOIN v ON cut.rest = v.word
  UNION SELECT v.word, cut.word FROM cut JOIN v ON cut.rest = v.word),
best AS (
  SELECT a AS word, count(*) AS n_near, max(n) AS top, min(b) FILTER (n = most) AS form
  FROM (SELECT a, b, n, max(n) OVER (PARTITION BY a) AS most FROM near JOIN v ON v.word = b) GROUP BY a),
formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * v.n THEN form END AS form, CASE WHEN top >= 5 * v.n THEN top END AS form_n
  FROM v LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS root, 0 AS steps FROM formed
  UNION ALL SELECT w.word, f.form, w.steps + 1 FROM walk w JOIN formed f ON f.word = w.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, steps) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM formed JOIN ends USING (word)
"""
