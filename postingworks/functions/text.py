"""String, URL, HTML and array functions (JVM-side columns)."""

from __future__ import annotations

import html.entities
import json
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postingworks.functions import fixed_values as fv
from postingworks.functions.spans import CLOSE, OPEN, let, strip, untagged


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def collapse(text: Column) -> Column:
    """Every whitespace run becomes one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def java_literal(term: str) -> str:
    """`term` as a regular expression that matches itself."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-&#~])", r"\\\1", term)


# ---------------------------------------------------------------------- html
_ENTITY = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# entities seen most, looked up before the full table
_COMMON = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "rsquo;", "lsquo;", "ldquo;", "rdquo;", "ndash;", "mdash;",
           "bull;", "hellip;", "middot;", "eacute;", "reg;", "trade;", "copy;", "euro;", "pound;")
_LEGACY = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True)


def _lookup(names: Sequence[str]) -> Column:
    """Reference names to their text: one foldable literal, so plans stay small."""
    return F.from_json(F.lit(json.dumps({n: html.entities.html5[n] for n in names})), "map<string,string>")


def _code_point(ref: Column) -> Column:
    """Character of a numeric reference such as ``#233;`` or ``#xe9;``."""
    body = F.regexp_replace(ref, "[;#]", "")
    hexa = F.lower(F.substring(body, 1, 1)) == "x"
    number = F.when(hexa, F.conv(F.substring(body, F.lit(2), F.length(body)), 16, 10)).otherwise(body).try_cast("bigint")
    # 128..159 are read as Windows-1252, as browsers do
    low = [(n, bytes([n]).decode("cp1252")) for n in range(128, 160) if _cp1252(n)]
    remapped = F.create_map(*[F.lit(x) for n, ch in low for x in (n, ord(ch))])[number.try_cast("int")]

    def resolve(n):
        silent = (n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF)
                  | n.bitwiseAND(F.lit(0xFFFE)).eqNullSafe(F.lit(0xFFFE)))
        valid = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(~F.coalesce(valid, F.lit(False)), "\ufffd").when(silent, "").otherwise(char)

    return let(F.coalesce(remapped, number).cast("bigint"), resolve)


def _cp1252(n: int) -> bool:
    try:
        bytes([n]).decode("cp1252")
    except UnicodeDecodeError:
        return False
    return True


def unescape(text: Column) -> Column:
    """HTML character references resolved once, as browsers do."""
    def piece(p):
        ref, rest = F.substring_index(p, CLOSE, 1), F.substring_index(p, CLOSE, -1)
        known = F.coalesce(_lookup(_COMMON)[ref], _lookup(list(html.entities.html5))[ref])
        # old names count without their semicolon, whatever follows them
        prefixed = let(F.regexp_extract(ref, "^(?:" + "|".join(_LEGACY) + ")", 0), lambda p: F.when(
            p != "", F.concat(_lookup(_LEGACY)[p], F.substring(ref, F.length(p) + 1, F.length(ref)))))
        named = F.coalesce(known, prefixed, F.concat(F.lit("&"), ref))
        return F.concat(F.when(ref.startswith("#"), _code_point(ref)).otherwise(named), rest)

    def resolve(t):
        return F.when(t.rlike(_ENTITY), let(
            F.split(F.regexp_replace(untagged(t), _ENTITY, f"{OPEN}$1{CLOSE}"), OPEN, -1),
            lambda pieces: F.concat(pieces[0], F.array_join(F.transform(
                F.slice(pieces, 2, F.size(pieces)), piece), "")))).otherwise(t)

    return let(text, resolve)


def strip_html(text: Column) -> Column:
    """Plain text of an HTML fragment; references are resolved twice because some boards escape twice."""
    plain = unescape(unescape(F.coalesce(text, F.lit(""))))
    return collapse(F.regexp_replace(plain, "<[^>]+>", " "))


def drop_blocks(html_text: Column, tags: str = "script|style|nav|header|footer|form") -> Column:
    """HTML without the given elements and their contents."""
    return F.regexp_replace(html_text, rf"(?is)<({tags})\b.*?</\1>", " ")


# ---------------------------------------------------------------------- keys
def _accent_tables() -> tuple[str, str, str, dict[str, str]]:
    """Characters with one letter as their base, those letters, combining marks, and characters with several letters."""
    singles, bases, marks, several = [], [], [], {}
    for cp in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)):
        ch = chr(cp)
        if unicodedata.combining(ch):
            marks.append(ch)
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if base == ch:
            continue
        if len(base) == 1 and cp < 0x2200:
            singles.append(ch)
            bases.append(base)
        else:
            several[ch] = base
    return "".join(singles), "".join(bases), "".join(marks), several


_SINGLES, _BASES, _MARKS, _SEVERAL = _accent_tables()


def _runs(chars: Sequence[str]) -> str:
    """A character class of consecutive runs."""
    out, codes = [], sorted(map(ord, chars))
    for cp in codes:
        if out and cp == out[-1][1] + 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out) + "]"


_SYLLABLES = r"[\x{AC00}-\x{D7A3}]"
# the classes are long, so plain letters are kept from them by a short one
_RARE = rf"(?=[^\x00-\x7F])(?:{_runs(_SEVERAL)}|{_SYLLABLES})"
_BLOCK = 256


def _blocks() -> str:
    """The rare characters by blocks of code points, so that a look meets few of them."""
    blocks = [{} for _ in range(max(map(ord, _SEVERAL)) // _BLOCK + 1)]
    for ch, base in _SEVERAL.items():
        blocks[ord(ch) // _BLOCK][ch] = base
    return json.dumps(blocks)


_RARE_BLOCKS = _blocks()


def _letters_of(piece: Column) -> Column:
    """A rare character's letters; a syllable block's are counted out, as the standard does. ASCII stays as it is."""
    def syllable(n: Column) -> Column:
        def letter(code: Column) -> Column:
            return F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")
        last = n % 28
        return F.concat(letter(0x1100 + F.floor(n / 588)), letter(0x1161 + F.floor((n % 588) / 28)),
                        F.when(last > 0, letter(0x11A7 + last)).otherwise(""))

    blocks = F.from_json(F.lit(_RARE_BLOCKS), "array<map<string,string>>")

    def letters(number: Column) -> Column:
        known = F.get(blocks, F.floor(number / _BLOCK).cast("int"))[piece]
        return F.when(number.between(0xAC00, 0xD7A3), let(number - 0xAC00, syllable)).otherwise(F.coalesce(known, piece))

    number = F.conv(F.hex(F.encode(piece, "UTF-32")), 16, 10).cast("bigint")
    return F.when(piece.rlike(r"^[\x00-\x7F]"), piece).otherwise(let(number, letters))


def fold_accents(text: Column) -> Column:
    """Letters without their accents: compatibility decomposition with the combining marks dropped."""
    def folded(plain: Column) -> Column:
        pieces = F.regexp_extract_all(plain, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))
        return F.when(plain.rlike(_RARE), F.array_join(F.transform(pieces, _letters_of), "")).otherwise(plain)

    return let(text, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), let(F.translate(t, _SINGLES + _MARKS, _BASES), folded)).otherwise(t))


def alnum_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


@F.pandas_udf(StringType())
def unicode_name_key(s: pd.Series) -> pd.Series:
    """Compatibility-normalised, case-folded letters and digits (company names only)."""
    folded = s.fillna("").str.normalize("NFKC").str.casefold()
    return folded.map(lambda v: "".join(ch for ch in v if ch.isalnum()))


def normalize_link(url: Column) -> Column:
    """Link identity: no scheme, no tracking parameters, no trailing slash, lower case."""
    def without_tracking(s):
        kept = F.array_join(F.filter(
            F.split(F.regexp_extract(s, r"^[^?]*\?(.*)$", 1), "&", -1),
            lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*fv.TRACKING_PARAMS)), "&")
        return F.rtrim(F.concat_ws("?", F.substring_index(s, "?", 1), F.nullif(kept, F.lit(""))), F.lit("/"))

    return let(F.regexp_replace(F.lower(strip(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.\-]*://", ""),
               lambda s: F.when(s.contains("?"), without_tracking(s)).otherwise(F.rtrim(s, F.lit("/"))))


def _fingerprint_part(text: Column) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\b[a-z]*-?\d{4,}(?:-\d+)*\b", "")
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def role_fingerprint(title: Column, location: Column) -> Column:
    """Identity of a role across re-listings: title and location without requisition numbers."""
    return F.concat_ws("|", _fingerprint_part(title), _fingerprint_part(location))


def entry_id(company: Column, posting_id: Column) -> Column:
    return F.concat_ws(":", company, posting_id)


def description_key(entry: Column) -> Column:
    return F.substring(F.sha1(entry), 1, 20)


# ----------------------------------------------------------------- locations
def effective_location(location: Column, link: Column, title: Column) -> Column:
    """Location, or for blank ones the site slug of the link, or the last parenthetical of the title."""
    link, title = F.coalesce(link, F.lit("")), F.coalesce(title, F.lit(""))
    slug = F.regexp_extract(link, "(?i)/job/([^/]+)/", 1)
    tail = F.regexp_extract(title, r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*$", 1)
    return (F.when(strip(F.coalesce(location, F.lit(""))) != "", location)
            .when((slug != "") & link.contains("myworkdayjobs"), strip(F.regexp_replace(slug, "-+", " ")))
            .otherwise(tail))


def join_location(*parts: Column, sep: str = ", ") -> Column:
    """Non-blank parts in order."""
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), sep)


def with_remote(location: Column, remote: Column, marker: str = "Remote") -> Column:
    return (F.when(~F.coalesce(remote, F.lit(False)), location)
            .when(location != "", F.concat(location, F.lit(f" | {marker}"))).otherwise(F.lit(marker)))


def distinct_sites(sites: Column, sep: str = "; ") -> Column:
    """All trimmed non-blank sites in first-seen order."""
    trimmed = F.transform(sites, lambda s: strip(F.coalesce(s, F.lit(""))))
    return F.array_join(F.array_distinct(F.filter(trimmed, lambda s: s != "")), sep)


def country_first_location(text: Column) -> Column:
    """`US-NY-New York` read as `New York, NY, US`."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "-", 3), strip)
    return (F.when((F.size(parts) >= 2) & parts[0].rlike(r"^\p{L}{2}$"), F.array_join(F.reverse(parts), ", "))
            .otherwise(strip(F.coalesce(text, F.lit("")))))


MULTI_SITE = r"(?i)^\s*\d+\s+locations?\s*$"


def multi_site_location(text: Column, path: Column) -> Column:
    """`3 Locations` with the city named by the posting path added."""
    text = F.coalesce(text, F.lit(""))
    city = F.regexp_extract(F.coalesce(path, F.lit("")), "^/job/([^/]+)/", 1)
    return (F.when(text.rlike(MULTI_SITE) & (city != ""),
                   F.concat(text, F.lit(" ("), F.translate(city, "-", " "), F.lit(")"))).otherwise(text))


def split_title_place(title: Column) -> Column:
    """`Analyst (Boston)` as STRUCT<title, place>."""
    pattern = r"^(.*)\s\(([^()]*)\)$"
    hit = title.rlike(pattern)
    return F.struct(F.when(hit, F.regexp_extract(title, pattern, 1)).otherwise(title).alias("title"),
                    F.when(hit, F.regexp_extract(title, pattern, 2)).otherwise("").alias("place"))


# --------------------------------------------------------------------- terms
def append_term(terms: Column, term: str) -> Column:
    """`terms` with `term` added unless it is there in any case; null lists stay null."""
    there = F.array_contains(F.transform(terms, F.lower), term.lower())
    return F.when(terms.isNull() | there, terms).otherwise(F.array_append(terms, F.lit(term.lower())))


def slug_guesses(name: Column) -> Column:
    """Likely board slugs of an employer name, best first."""
    words = F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*fv.NAME_SUFFIXES))
    core = F.when(F.size(kept) > 0, kept).otherwise(words)
    guesses = F.array(F.array_join(core, ""), F.array_join(core, "-"), F.array_join(words, ""), F.array_join(words, "-"))
    return F.filter(F.array_distinct(guesses), lambda s: s != "")


def filters_signature(filters: Column) -> Column:
    """Signature of a filter set given as its sorted-key JSON text."""
    return F.substring(F.sha1(filters), 1, 16)


def posted_label(posted: Column, posted_source: Column, first_seen: Column, as_of: Column) -> Column:
    """Display text of a posting date; `~` marks an approximate one."""
    prefix = F.when(posted_source == "approx", "~").otherwise("")
    return (F.when(posted == as_of, F.concat(prefix, F.lit("today")))
            .when(posted.isNotNull(), F.concat(prefix, F.date_format(posted, "yyyy-MM-dd")))
            .when(first_seen.isNotNull(), F.concat(F.lit("seen "), F.date_format(first_seen, "MM-dd")))
            .otherwise("unknown"))


def keyword_hits(title: Column, text: Column, keywords: Sequence[str]) -> Column:
    """Keywords found as whole words (letters on neither side), in the order of `keywords`."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    found = [F.when(hay.rlike(f"(?<![a-z]){java_literal(k)}(?![a-z])"), F.lit(k)) for k in keywords]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
