"""Token ids of whole texts by a public tokenizer file, with the pieces between blanks encoded once and kept.

Both kinds of vocabulary treat the pieces between blanks independently: one drops white space, the other joins a blank to
the piece after it. So a text's ids are those of its pieces in turn. Texts go through in slices: a slice's pieces are cut
and numbered in Arrow, and only its distinct pieces are encoded. Pieces of Latin letters, digits and ASCII marks are cut on
where the tokenizer's own splitting would cut them: words of letters, which many pieces share, go to its model directly; all
other pieces go through the whole tokenizer. A worker keeps the ids of words in two generations bounded in number and bytes:
a full generation becomes the old one, and a word found there moves to the new. Where a blank follows other white space a
text is cut only at blanks after a visible character, as runs of white space share tokens there.
"""

from __future__ import annotations

import gc
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_KEPT = 200_000
BYTES_KEPT, LONGEST_KEPT = 48 << 20, 64
AT_ONCE = 20_000
END = (0).to_bytes(4, "little")
# letters whose lower case is one letter and whose composed form is themselves
LATIN = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{132}-\x{148}\x{14A}-\x{17E}"
MARKS = r"!-&(-/:-@\[-`{-~"
# pieces of which nothing but letters, digits, marks and inner line ends is known, or with an apostrophe beside a mark
NOT_PLAIN = rf"[^{LATIN}0-9{MARKS}'\n]|^\n|\n$|^$|'[{MARKS}]|[{MARKS}]'|<\|"
ODD = re.compile(r" (?<=\s )").search
CUT = re.compile(r"(?<=\S) ").split
_open: dict[tuple[str, bool, int], Encoder] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Kept:
    """Ids of words (little-endian unsigned 32-bit), encoded when first asked for and kept in two bounded generations."""

    def __init__(self, many, most: int) -> None:
        self.many, self.most = many, most  # `many` encodes a list of pieces
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def keep(self, pieces: list[str], found: list[bytes]) -> None:
        if len(self.new) >= self.most or self.size >= BYTES_KEPT:
            self.old, self.new, self.size = self.new, {}, 0
        self.new.update(zip(pieces, found, strict=True))
        self.size += sum(map(len, pieces)) + sum(map(len, found))

    def find(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, in turn."""
        out = list(map(self.new.get, pieces))
        missing = [i for i, found in enumerate(out) if found is None]
        for a in range(0, len(missing), AT_ONCE):
            places = missing[a:a + AT_ONCE]
            asked = [pieces[i] for i in places]
            found = list(map(self.old.get, asked))
            if None in found:
                unknown = [p for p, f in zip(asked, found, strict=True) if f is None]
                made = iter(self.many(unknown))
                found = [next(made) if f is None else f for f in found]
            for i, f in zip(places, found, strict=True):
                out[i] = f
            if max(map(len, asked)) > LONGEST_KEPT:
                short = [k for k, p in enumerate(asked) if len(p) <= LONGEST_KEPT]
                asked, found = [asked[k] for k in short], [found[k] for k in short]
            self.keep(asked, found)
        return out


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes. `blanks`: the vocabulary holds blanks joined to pieces, and
    case; else white space is dropped and case is lowered."""

    def __init__(self, path: str, blanks: bool, most: int = MOST_KEPT) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.blanks = blanks
        self.letters = byte_letters()
        self.words = Kept(self.parts, most)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def cut(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each with the blank before it where blanks count."""
        lead = " " if self.blanks else ""
        odd = pc.match_substring_regex(pa.array(pieces, pa.large_string()), NOT_PLAIN).to_numpy(zero_copy_only=False)
        plain = pa.array([lead + p for p, o in zip(pieces, odd, strict=True) if not o], pa.large_string())
        # a mark joins the blank before it; line ends and marks stand apart from words
        apart = pc.replace_substring_regex(plain, rf"( ?[{MARKS}]+|\n)", "\x1f\\1\x1f")
        split = pc.split_pattern(apart, "\x1f")
        numbered = split.flatten().dictionary_encode()
        found = self.words.find(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        parts = np.array([*found, b""], dtype=object)[:-1][numbered.indices.to_numpy()].tolist()
        at = np.asarray(split.offsets).tolist()
        ids = iter([b"".join(parts[a:b]) for a, b in zip(at, at[1:], strict=False)])
        return [self.whole(lead + p) if o else next(ids) for p, o in zip(pieces, odd, strict=True)]

    def parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts of pieces: words of letters by the model, others by the whole tokenizer."""
        is_word = pc.match_substring_regex(pa.array(parts, pa.large_string()), f"^ ?[{LATIN}]+$").to_numpy(zero_copy_only=False)
        words = [p for p, w in zip(parts, is_word, strict=True) if w]
        if not self.blanks:
            words = [p.lower() for p in words]
        raw = "\n".join(words).encode().decode("latin-1").translate(self.letters).split(self.letters[0x0A])
        tokens = list(map(self.tokenizer.model.tokenize, raw)) if words else []
        data = np.array([t.id for ts in tokens for t in ts], dtype="<u4").tobytes()
        ends = np.cumsum([4 * len(ts) for ts in tokens]).tolist()
        ids = iter([data[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        return [next(ids) if w else self.whole(p) if p else b"" for p, w in zip(parts, is_word, strict=True)]

    def by_piece(self, text: str) -> bytes:
        """Ids of a text in which a blank follows other white space."""
        pieces = CUT(text)
        return self.whole(pieces[0]) + b"".join(self.cut(pieces[1:]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One value per text; null is empty."""
        on = gc.isenabled()
        gc.disable()  # many small lists and no cycles: collections would only walk through the kept pieces
        try:
            return self._encode(texts)
        finally:
            pa.default_memory_pool().release_unused()
            if on:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        odd = {i: self.by_piece(t) for i, t in enumerate(texts) if t and self.blanks and ODD(t)}
        plain = pa.array(["" if i in odd else t or "" for i, t in enumerate(texts)], pa.large_string())
        cut = pc.split_pattern(plain, " ")
        pieces, bounds = cut.flatten(), np.asarray(cut.offsets)
        numbered = pieces.dictionary_encode()
        found = self.cut(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        taken = np.array([*found, b""], dtype=object)[:-1][numbered.indices.to_numpy()]
        if self.blanks:  # the first piece of a text has no blank before it
            taken[bounds[:-1]] = [self.whole(p) if p else b"" for p in pieces.take(pa.array(bounds[:-1])).to_pylist()]
        parts, cuts = taken.tolist(), bounds.tolist()
        return [odd[i] if i in odd else b"".join(parts[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def encoder(path: str, blanks: bool, most: int = MOST_KEPT) -> Encoder:
    """The worker's encoder for a file; it lasts as long as the worker does."""
    key = (path, blanks, most)
    if key not in _open:
        _open[key] = Encoder(path, blanks, most)
    return _open[key]


def in_slices(texts: list[str | None], most: int = 2 << 20):
    """Index ranges whose texts hold at most `most` characters, one text at least."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > first and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)
