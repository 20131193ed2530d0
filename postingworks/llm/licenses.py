"""Licence scan: segments of a text compared with licence templates by the Dice coefficient over word bigrams.

Segments are the lines of a text, its paragraphs of several lines (set apart by blank lines) and the whole text, where
they are not the same. Words are longest stretches of a-z and 0-9 once A-Z is lowered; a segment's set holds its distinct
pairs of adjacent words. A template of b bigrams can only reach Dice t with a segment of a bigrams if
a * (2 - t) >= b * t and b * (2 - t) >= a * t, so segments outside all templates' bounds are never cut into bigrams and a
bigram meets only the templates in bounds. Licences that stand within a longer stretch, of several paragraphs or inside a
line, are found by windows of words: a text that holds the distinct bigrams which any window with Dice t must share,
t * b / (2 - t), is cut into windows of the template's length, an eighth of it apart, and the ends of the best ones are moved
in ever smaller steps to where Dice is highest. Of overlapping windows the one with most shared bigrams times Dice stays, and
it counts where no segment has its licence. Templates are a small table (their bigrams are counted before the join).

Defined cases: null, empty and wordless texts have no segments and no licence, as have segments of a single word; equal
scores go to the template that sorts first; repeated rows are scanned once and each returned; texts of
any length are read whole; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postingworks.llm.common import bound, each_copy, lower_ascii
from postingworks.llm.pii import apart

THRESHOLD = 0.8
BROADCAST_BIGRAMS = 200_000

# Texts of public licences and of the notices that name them.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
    "required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
    "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
    "governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
    "the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
    "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
    "any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
    "details. You should have received a copy of the GNU General Public License along with this program. If not, see "
    "https://www.gnu.org/licenses/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
    "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
    "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
    "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
    "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
    "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
    "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


# further public licences, which the checking SQL doesn't know; full texts stand in files, read on the driver
_BSD = TEMPLATES["BSD-2-Clause"]
FURTHER = {
    "BSD-3-Clause": _BSD.replace("THIS SOFTWARE IS", "3. Neither the name of the copyright holder nor the names of its "
                                 "contributors may be used to endorse or promote products derived from this software without "
                                 "specific prior written permission. THIS SOFTWARE IS", 1),
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
    "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or "
    "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
    "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
    "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under "
    "copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
    "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please "
    "refer to <https://unlicense.org>",
} | {f.stem: f.read_text() for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list((TEMPLATES | FURTHER).items()), "license string, text string")


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit("[a-z0-9]+"), F.lit(0))


def _placed(w: Column) -> Column:
    """Hashes of adjacent words, by place; empty if there are under two."""
    return bound(w, lambda v: F.when(F.size(v) >= 2, F.transform(
        F.sequence(F.lit(0), F.size(v) - 2), lambda i: F.xxhash64(F.get(v, i), F.get(v, i + 1)))).otherwise(
        F.array().cast("array<bigint>")))


def _bigrams(w: Column) -> Column:
    """Distinct hashes of adjacent words; empty if there are under two."""
    return F.array_distinct(_placed(w))


def template_bigrams(table: DataFrame) -> DataFrame:
    """One row per template and bigram hash, with the template's number of bigrams; templates of one word have none."""
    cut = table.select("license", words(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") >= 2)
    sets = cut.select("license", _bigrams(F.col("w")).alias("grams"))
    return sets.select("license", F.size("grams").alias("t_size"), F.explode("grams").alias("t_gram"))


def segments(text: Column) -> Column:
    """Distinct lines, paragraphs of several lines and the whole text, with at least one word each, numbered from 0."""
    lines = F.split(text, "\n")
    blocks = F.filter(F.split(text, "\n[\x20\t\r]*\n"), lambda p: F.contains(p, F.lit("\n")))
    return F.array_distinct(F.filter(F.concat(lines, blocks, F.array(text)), lambda s: s.rlike("[A-Za-z0-9]")))


def _best_windows(g: Column, grams: Column, length: Column, threshold: float) -> Column:
    """Windows [(start, end, dice, shared)] of the bigrams `g` around the best places of a template."""
    def score(start: Column, end: Column) -> Column:
        return bound(F.slice(g, start + 1, F.greatest(end - start, F.lit(1))), lambda s: bound(
            F.size(F.array_intersect(s, grams)), lambda n: F.struct(
                (2.0 * n / (F.size(F.array_distinct(s)) + F.size(grams))).alias("dice"), n.alias("shared"),
                (-start).alias("less"), end.alias("end"))))

    def moved(w: Column, step: Column, reach: int) -> Column:
        by = F.sequence(F.lit(-reach), F.lit(reach))
        first = F.array_max(F.transform(by, lambda k: score(F.greatest(F.least(-w["less"] + k * step, w["end"] - 1), F.lit(0)), w["end"])))
        return bound(first, lambda f: F.array_max(F.transform(by, lambda k: score(-f["less"], F.least(
            F.greatest(f["end"] + k * step, 1 - f["less"]), F.size(g))))))

    def stepped(part: int) -> Column:
        return F.greatest(F.floor(length / part).cast("int"), F.lit(1))

    def refined(w: Column) -> Column:
        return bound(moved(w, stepped(16), 8), lambda a: bound(moved(a, stepped(64), 4), lambda b: moved(b, F.lit(1), 4)))

    def peaks(rough: Column) -> Column:
        best = F.filter(rough, lambda w, i: (w["dice"] >= 0.68 * threshold) & (w == F.array_max(
            F.slice(rough, F.greatest(i - 2, F.lit(1)), F.least(i + 1, F.lit(4)) + 3))))
        return F.filter(F.transform(best, refined), lambda w: w["dice"] >= threshold)

    starts = F.sequence(F.lit(0), F.greatest(F.size(g) - length + stepped(8), F.lit(0)), stepped(8))
    inside = F.filter(starts, lambda s: s < F.size(g))
    return bound(F.transform(inside, lambda s: score(s, F.least(s + length, F.size(g)))), peaks)


def windows(rows: DataFrame, table: DataFrame, threshold: float, small: bool) -> DataFrame:
    """Rows (id, text_hash, license, dice), one per distinct window of a text (id, text_hash, text) that no better overlaps."""
    cut = table.select("license", _placed(words(F.coalesce("text", F.lit("")))).alias("t_all")).where(F.size("t_all") > 0)
    known = cut.select("license", F.size("t_all").alias("length"), F.array_distinct("t_all").alias("grams"))
    least = F.ceil(F.size("grams") * (threshold / (2 - threshold)) - 1e-9)
    met = rows.select("id", "text_hash", _placed(words(F.col("text"))).alias("g")).where(F.size("g") > 0).crossJoin(
        F.broadcast(known) if small else known).where((F.size("g") >= least) & (F.size(F.array_intersect("g", "grams")) >= least))
    found = met.select("id", "text_hash", "license", F.transform(
        _best_windows(F.col("g"), F.col("grams"), F.col("length"), threshold), lambda w: F.struct(
            (-w["less"]).alias("start"), w["end"].alias("end"), (w["shared"] * w["dice"]).alias("score"), F.lit(0).alias("family"),
            w["dice"].alias("dice"), F.col("license").alias("license"),
            F.xxhash64(F.slice(F.col("g"), 1 - w["less"], w["end"] + w["less"])).alias("content"))).alias("found"))
    each = found.groupBy("id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))
    kept = each.select("id", "text_hash", F.explode(F.array_distinct(F.transform(apart(
        F.col("found"), ("dice", "license", "content")), lambda w: F.struct(*[w[f].alias(f) for f in ("license", "dice", "content")]))))
        .alias("w"))
    return kept.select("id", "text_hash", "w.license", "w.dice")


def scan(docs: DataFrame, table: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
         broadcast_bigrams: int = BROADCAST_BIGRAMS) -> DataFrame:
    """Per document: id, and its matches [(segment, license, dice)], the best template of each segment that reaches the
    threshold, then windows (segment null) with a licence that no segment has; segments that are equal count once."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    grams = template_bigrams(table)
    sizes = grams.groupBy("t_size").agg(F.count(F.lit(1)).alias("n")).collect()  # distinct sizes of templates
    t = threshold
    least = min((r["t_size"] for r in sizes), default=0) * t / (2 - t)
    most = max((r["t_size"] for r in sizes), default=0) * (2 - t) / t
    small = sum(r["n"] for r in sizes) <= broadcast_bigrams
    if small:
        grams = F.broadcast(grams)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"),
                       F.coalesce(text_col, F.lit("")).alias("text"))
    # the empty segment keeps documents without a match; a segment's bytes bound its words from above
    parts = rows.select("id", "text_hash", F.posexplode(F.concat(F.array(F.lit("")), F.filter(
        segments(F.col("text")), lambda s: F.octet_length(s) >= 2 * least + 1))).alias("segment", "part"))
    sets = parts.select("id", "text_hash", "segment", _bigrams(words(F.col("part"))).alias("grams"))
    bounded = sets.where((F.col("segment") == 0) | F.size("grams").between(least, most))
    each = bounded.select("id", "text_hash", "segment", F.size("grams").alias("size"), F.explode_outer("grams").alias("gram"))
    met = each.join(grams, (F.col("gram") == F.col("t_gram")) & (F.col("size") * (2 - t) >= F.col("t_size") * t)
                    & (F.col("t_size") * (2 - t) >= F.col("size") * t), "left")
    met = met.where(F.col("license").isNotNull() | (F.col("segment") == 0))
    shared = met.groupBy("id", "text_hash", "segment", "license").agg(
        F.size(F.collect_set("gram")).alias("n"), F.max("size").alias("size"), F.max("t_size").alias("t_size"),
        F.count_if(F.col("segment") == 0).alias("copies"))
    scored = shared.withColumn("dice", F.when(F.col("license").isNotNull(), 2.0 * F.col("n") / (F.col("size") + F.col("t_size"))))
    good = scored.where((F.col("segment") == 0) | (F.col("dice") >= t))
    best = good.groupBy("id", "text_hash", "segment").agg(
        F.min(F.struct((-F.col("dice")).alias("less"), F.col("license").alias("license"))).alias("b"), F.max("copies").alias("copies"))
    each = best.select("id", "text_hash", "segment", F.col("b.license").alias("license"), (-F.col("b.less")).alias("dice"), "copies")
    inner = windows(rows, table, t, small).select("id", "text_hash", F.lit(None).cast("int").alias("segment"), "license", "dice",
                                                  F.lit(0).cast("bigint").alias("copies"))
    whole = each.unionByName(inner).groupBy("id", "text_hash").agg(F.collect_list(F.when(
        F.col("license").isNotNull(), F.struct("segment", "license", "dice"))).alias("all"), F.max("copies").alias("copies"))
    cut = F.array_sort(F.filter("all", lambda m: m["segment"].isNotNull()))
    within = F.array_sort(F.filter("all", lambda m: m["segment"].isNull() & ~F.exists("all", lambda o: o["segment"].isNotNull() & (
        o["license"] == m["license"]))))
    return each_copy(whole.select(F.col("id").alias(id_col), "text_hash", F.concat(cut, within).alias("matches"), "copies"), "copies")


def digest(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Per document: its best licence and Dice, the number of distinct segments that match and all licences found."""
    found = scan(docs, table)
    ranked = F.array_min(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("less"), m["license"].alias("license"))))
    return found.select("doc_id", F.size("matches").cast("bigint").alias("n_matches"), ranked["license"].alias("license"),
                        F.round(-ranked["less"], 9).alias("dice"), F.array_join(F.array_sort(F.array_distinct(F.transform(
                            "matches", lambda m: m["license"]))), ",").alias("licenses"))


def _sql() -> str:
    quoted = ",\n  ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
    words_sql = ("regexp_extract_all(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')")
    return rf"""
WITH t AS (SELECT * FROM (VALUES
  {quoted}) AS v(license, part)),
tg AS (
  SELECT DISTINCT license, w[i] || ' ' || w[i + 1] AS gram
  FROM (SELECT license, w, unnest(range(1, len(w))) AS i FROM (SELECT license, {words_sql} AS w FROM t))),
ts AS (SELECT license, count(*) AS b FROM tg GROUP BY license),
parts AS (
  SELECT doc_id, part FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS part FROM documents)
  UNION SELECT doc_id, part FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS part FROM documents)
        WHERE contains(part, chr(10))
  UNION SELECT doc_id, text FROM documents),
g AS (
  SELECT DISTINCT doc_id, part, w[i] || ' ' || w[i + 1] AS gram
  FROM (SELECT doc_id, part, w, unnest(range(1, len(w))) AS i FROM (SELECT doc_id, part, {words_sql} AS w FROM parts))),
s AS (SELECT doc_id, part, count(*) AS a FROM g GROUP BY ALL),
d AS (
  SELECT doc_id, part, license, 2.0 * n / (a + b) AS dice
  FROM (SELECT doc_id, part, license, count(*) AS n FROM g JOIN tg USING (gram) GROUP BY ALL) JOIN s USING (doc_id, part)
  JOIN ts USING (license)),
best AS (
  SELECT doc_id, part, arg_min(license, (-dice, license)) AS license, max(dice) AS dice
  FROM d WHERE dice >= {THRESHOLD} GROUP BY ALL),
found AS (
  SELECT doc_id, count(*) AS n, arg_min(license, (-dice, license)) AS license, max(dice) AS dice,
         string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
  FROM best GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_matches, license, round(CAST(dice AS DOUBLE), 9) AS dice, coalesce(licenses, '') AS licenses
FROM documents LEFT JOIN found USING (doc_id)
"""


SQL = _sql()
