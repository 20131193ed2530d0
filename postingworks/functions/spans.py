"""Match positions inside text, as Spark columns.

One ``regexp_replace`` pass tags every match with control characters; splitting
on those gives the matches, their groups and the gaps between them, and the
running lengths give exact offsets. Offsets are 0-based code points, end
exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, GROUP, CLOSE = "\x01", "\x02", "\x03"
FLAGS = "(?i)"


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def untagged(text: Column) -> Column:
    """`text` with the three tag characters blanked; the length does not change."""
    return F.translate(text, OPEN + GROUP + CLOSE, "   ")


def shaped(text: Column) -> Column:
    """`text` for matching, with the same length: other scripts' blanks become blanks and their letters one letter.

    The patterns can then use the plain ASCII classes, which run several times faster than the Unicode ones.
    """
    plain = untagged(text)
    foreign = F.regexp_replace(F.regexp_replace(plain, r"(?U)[\s&&[^\x00-\x7F]]", " "),
                               r"[\p{L}\p{N}&&[^\x00-\x7F]]", "j")
    return F.when(plain.rlike(r"[^\x00-\x7F]"), foreign).otherwise(plain)


def matches(text: Column, pattern: str, flags: str = FLAGS) -> Column:
    return text.rlike(flags + pattern)


def _tagged(text: Column, pattern: str, groups: int, flags: str) -> Column:
    marks = "".join(f"${g}{GROUP}" for g in range(1, groups + 1))
    return F.regexp_replace(text, flags + "(?:" + pattern + ")", f"{OPEN}{marks}$0{CLOSE}")


def spans(text: Column, pattern: str, groups: int = 0, flags: str = FLAGS) -> Column:
    """All matches, left to right: ARRAY<STRUCT<start, end, match, groups>>."""
    found_type = "array<struct<start:int,end:int,match:string,groups:array<string>>>"

    def step(acc, piece):
        def add(parts):
            text_len = F.length(parts[groups])
            item = F.struct(acc["pos"].alias("start"), (acc["pos"] + text_len).alias("end"), parts[groups].alias("match"),
                            (F.slice(parts, 1, groups) if groups else F.array().cast("array<string>")).alias("groups"))
            return F.struct((acc["pos"] + text_len + F.length(F.substring_index(piece, CLOSE, -1))).alias("pos"),
                            F.array_append(acc["found"], item).alias("found"))
        return let(F.split(F.substring_index(piece, CLOSE, 1), GROUP, -1), add)

    def collect(pieces):
        start = F.struct(F.length(pieces[0]).alias("pos"), F.array().cast(found_type).alias("found"))
        return F.aggregate(F.slice(pieces, 2, F.size(pieces)), start, step, lambda acc: acc["found"])

    return let(F.split(_tagged(text, pattern, groups, flags), OPEN, -1), collect)


def first_span(text: Column, pattern: str, flags: str = FLAGS) -> Column:
    """STRUCT<start, end> of the first match, null when there is none."""
    def read(pieces):
        start = F.length(pieces[0])
        return F.when(F.size(pieces) > 1, F.struct(
            start.alias("start"), (start + F.length(F.substring_index(pieces[1], CLOSE, 1))).alias("end")))

    return let(F.split(_tagged(text, pattern, 0, flags), OPEN, 3), read)


def last_end(text: Column, pattern: str, flags: str = FLAGS) -> Column:
    """End of the last match, null when there is none."""
    return let(_tagged(text, pattern, 0, flags), lambda tagged: F.when(
        tagged.contains(CLOSE), F.length(text) - F.length(F.substring_index(tagged, CLOSE, -1))))


def window(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] with both bounds clamped."""
    lo = F.greatest(start, F.lit(0))
    return F.substring(text, lo + 1, F.greatest(end - lo, F.lit(0)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def excerpt(text: Column, start: Column, end: Column, around: int) -> Column:
    return strip(window(text, start - around, end + around))
