"""Whole-word terms of a large list found in texts by joins, where one pattern of all terms would be too long.

The dictionary is a table of terms cut at their first word: the number of words they have, the text of those words, and the
marks before and after them. A text's words meet the dictionary by their head, the first two words of a term with what stands
between them, or its only word; the head tells how many words to take from there, and the taken text then meets the terms that
are exactly that. So each word costs one or two looks and as many as its dictionary entry has lengths, however many terms there are. The leftmost hit counts, of several there the longest, as with a pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingworks.functions.scale import lookup
from postingworks.functions.terms import alias_table, expand_table

WORD = "[a-z0-9]+"
BROADCAST_TERMS = 200_000
LONGEST_BROADCAST = 200  # characters of a term


def cut_terms(terms: DataFrame, *, aliases: bool = True) -> DataFrame:
    """Rows (term, found, key, words, core, before, after, head) of `terms(term)`: `found` is the term, or an alias of it, in lower case.

    Terms without a letter or digit of ASCII have no word to be found by and are left out.
    """
    known = terms.where("term <> ''").select("term").distinct()
    every = expand_table(known, alias_table(terms.sparkSession)) if aliases else known.withColumn("variant", F.col("term"))
    lowered = every.select("term", F.lower("variant").alias("found")).where(F.col("found").rlike("[a-z0-9]"))
    words = F.regexp_extract_all("found", F.lit(WORD), F.lit(0))
    before = F.regexp_extract("found", "^[^a-z0-9]*", 0)
    after = F.regexp_extract("found", "[^a-z0-9]*$", 0)
    core = F.substring("found", F.length(before) + 1, F.length("found") - F.length(before) - F.length(after))
    gap = F.get(F.split("found", WORD, -1), F.lit(1))
    head = F.when(F.size(words) > 1, F.concat(words[0], gap, F.get(words, F.lit(1)))).otherwise(words[0])
    return lowered.select("term", "found", words[0].alias("key"), F.size(words).alias("words"), core.alias("core"),
                          before.alias("before"), after.alias("after"), head.alias("head"))


def _hits(rows: DataFrame, terms: DataFrame, id_col: str, text_col: str, aliases: bool) -> DataFrame:
    """Every hit: id, the place of its first word, its marks before that, its length, term and found text."""
    cut = cut_terms(terms, aliases=aliases)
    size = cut.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("found")).alias("longest"), F.max("words").alias("words"),
                   F.min("words").alias("least")).first()
    most = size["words"] or 1
    small = size["n"] <= BROADCAST_TERMS and (size["longest"] or 0) <= LONGEST_BROADCAST
    heads = cut.groupBy("head", F.least("words", F.lit(2)).alias("n")).agg(F.array_sort(F.collect_set("words")).alias("lengths"))
    lowered = rows.select(F.col(id_col).alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("t"))
    parts = lowered.select("id", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"), F.split("t", WORD, -1).alias("g"))

    at = F.col("at")
    single = F.struct(F.lit(1).alias("n"), F.col("word").alias("head"))
    double = F.struct(F.lit(2).alias("n"), F.concat("word", F.get("g", at + 1), F.get("w", at + 1)).alias("head"))
    asked = [*([single] if (size["least"] or 1) == 1 else []), *([double] if most > 1 else [])]
    near = [F.slice("w", at + 1, most).alias("w"), F.slice("g", at + 1, most + 1).alias("g"), (F.size("w") - at).alias("rest")]
    every = parts.select("id", "w", "g", F.posexplode("w").alias("at", "word"))
    # joined to a broadcast, the words around are taken for those that met only; else before the rows are moved
    if small:
        looked = every.select("id", "at", "w", "g", F.inline(F.array(*asked)))
        met = looked.join(F.broadcast(heads), ["head", "n"]).select("id", "at", "lengths", *near)
    else:
        looked = every.select("id", "at", *near, F.inline(F.array(*asked))).where("head IS NOT NULL")
        met = lookup(looked, heads, ["head", "n"], ["id", "at"], "inner")
    taken = met.select("id", "at", "w", "g", "rest", F.explode(F.filter("lengths", lambda n: n <= F.size("w"))).alias("words"))

    def text(words: Column, gaps: Column, n: Column) -> Column:
        inner = F.transform(F.slice(words, 2, most), lambda x, i: F.concat(F.get(gaps, i + 1), x))
        return F.concat(F.get(words, F.lit(0)), F.array_join(F.slice(inner, F.lit(1), n - 1), ""))

    run = taken.select("id", "at", "words", text(F.col("w"), F.col("g"), F.col("words")).alias("core"), F.get("g", F.lit(0)).alias("left"),
                       F.get("g", F.col("words")).alias("right"), (F.col("rest") == F.col("words")).alias("last"))
    shape = cut.select("core", "words", "before", "after", "found", "term")
    same = run.join(F.broadcast(shape), ["core", "words"]) if small else lookup(run, shape, ["core", "words"], ["id", "at"], "inner")
    # marks stand next to the words and nothing but a mark, or the text's start, next to them
    free = (F.col("before") == "") | (F.length("left") > F.length("before")) | (F.col("at") == 0)
    fits = F.endswith("left", F.col("before")) & free & F.startswith("right", F.col("after"))
    closed = (F.col("after") == "") | (F.length("right") > F.length("after")) | F.col("last")
    return same.where(fits & closed).select(
        "id", "at", F.length("before").alias("marks"), F.length("found").alias("length"), "term", "found")


def first_terms(rows: DataFrame, terms: DataFrame, *, id_col: str = "id", text_col: str = "text", aliases: bool = True) -> DataFrame:
    """(id, term, found) of each text's leftmost hit, the longest there; texts without one have no row.

    `terms(term)` may be of any size; case and word ends are as with `functions.terms.first_match`. A null text has no hit;
    rows that share an id share a hit.
    """
    hits = _hits(rows, terms, id_col, text_col, aliases)
    first = hits.groupBy("id").agg(F.min(F.struct("at", (-F.col("marks")).alias("m"), (-F.col("length")).alias("n"), "found", "term")).alias("h"))
    return first.select(F.col("id").alias(id_col), "h.term", "h.found")


def term_counts(rows: DataFrame, terms: DataFrame, *, id_col: str = "id", text_col: str = "text", aliases: bool = True) -> DataFrame:
    """(term, n) over all terms: in how many texts a term or an alias of it stands, 0 where in none."""
    found = _hits(rows, terms, id_col, text_col, aliases).select("term", "id").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.where("term <> ''").select("term").distinct().join(found, "term", "left").select("term", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
