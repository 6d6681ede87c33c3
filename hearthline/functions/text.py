"""Text: cleaning, folding, slugs, streets and token sets.

Folding has a fast path in built-in functions, exact for characters up to U+017F; `exact=True` takes the vectorised helper for all of Unicode.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .enums import ALIASES, STREET_WORDS


def _latin() -> tuple[str, str]:
    """Characters of U+00A0-U+017F whose compatibility form is one base character with or without marks."""
    plain = {}
    for code in range(0xA0, 0x180):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not 0x300 <= ord(x) <= 0x36F)
        if len(base) == 1 and base != c:
            plain[c] = base
    return "".join(plain), "".join(plain.values())


_FROM, _TO = _latin()
_MARKS = r"[̀-ͯ]"


def html_unescape(c: Column) -> Column:
    """Entities to characters (vectorised helper)."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    return run(c)


def clean_text(c: Column, entities: bool = True) -> Column:
    """Entities, tags and runs of white space away; null on null or empty."""
    c = F.when(c != "", c)
    if entities:
        c = html_unescape(c)
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"(?U)\s+", " "))


def strip_marks(c: Column, exact: bool = False) -> Column:
    """Compatibility form without U+0300-U+036F."""
    if not exact:
        return F.regexp_replace(F.translate(c, _FROM, _TO), _MARKS, "")

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKD").str.replace(_MARKS, "", regex=True)

    return run(c)


def fold_lower(c: Column, exact: bool = False) -> Column:
    return F.lower(strip_marks(F.trim(c), exact))


def fold_upper(c: Column, exact: bool = False) -> Column:
    return F.upper(strip_marks(F.trim(c), exact))


def ascii_fold(c: Column, exact: bool = False) -> Column:
    """Compatibility form, lower case, without any other than ASCII characters."""
    return F.lower(F.regexp_replace(strip_marks(c, exact), r"[^\x00-\x7F]", ""))


def tokens(c: Column, exact: bool = False) -> Column:
    """[a-z0-9]+ of the folded text, in order; empty on null."""
    return F.regexp_extract_all(ascii_fold(F.coalesce(c, F.lit("")), exact), F.lit("[a-z0-9]+"), F.lit(0))


def fold_tokens(c: Column, exact: bool = False) -> Column:
    return F.array_join(tokens(c, exact), " ")


def slugify(c: Column, exact: bool = False) -> Column:
    """Folded to [a-z0-9] with single dashes."""
    return F.regexp_replace(F.regexp_replace(ascii_fold(F.coalesce(c, F.lit("")), exact), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def mark_slug(c: Column, exact: bool = False) -> Column:
    """The index's slug: only marks are dropped, whatever else isn't [a-z0-9] parts words."""
    lowered = F.lower(F.trim(c))
    if exact:

        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            return s.str.normalize("NFD").str.replace(_MARKS, "", regex=True)

        lowered = run(lowered)
    else:
        pairs = [(a, b) for a, b in zip(_FROM, _TO, strict=True) if unicodedata.normalize("NFD", a)[0] == b]
        lowered = F.regexp_replace(F.translate(lowered, "".join(a for a, _ in pairs), "".join(b for _, b in pairs)), _MARKS, "")
    return F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalized_street(c: Column, exact: bool = False) -> Column:
    """Folded tokens, the first one spelled out."""
    t = tokens(c, exact)
    words = F.create_map(*[F.lit(x) for pair in STREET_WORDS.items() for x in pair])
    first = F.get(t, 0)
    return F.array_join(F.when(F.size(t) > 0, F.concat(F.array(F.coalesce(words[first], first)), F.slice(t, 2, 1_000_000))).otherwise(t), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def address_tokens(c: Column) -> Column:
    """The sorted set of ASCII tokens of a lower-cased address; accents part words here."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))))


def key_text(c: Column) -> Column:
    """Trimmed, case-folded, without combining characters, single spaces (vectorised helper)."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        s = s.str.strip().str.casefold().str.normalize("NFKD")
        s = s.map(lambda v: "".join(x for x in v if not unicodedata.combining(x)), na_action="ignore")
        return s.str.replace(r"\s+", " ", regex=True)

    return run(c)


def canonical_word(c: Column, exact: bool = False) -> Column:
    """Folded upper case, known words replaced by their code; empty on null."""
    folded = F.coalesce(fold_upper(c, exact), F.lit(""))
    words = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(words[folded], folded)


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, r"\W+"), lambda x: x != "")


def token_overlap(left: Column, right: Column) -> Column:
    """Share of the expected words (right) that the actual ones hold."""
    hits = F.size(F.filter(right, lambda x: F.array_contains(left, x)))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), hits / F.size(right)).otherwise(0.0)
