"""Scalar text transforms as columns. Null in, null out, unless said otherwise.

White space is Unicode's, with the separators U+001C to U+001F. ``BLANK`` is the inside of a character class after
``(?U)``, which is ten times as fast as the same class spelled out in ``SPACE`` for other engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BLANK = r"\s\x{1C}-\x{1F}"
PARAGRAPH_BREAK = rf"(?U)\n[{BLANK}]*\n"
SENTENCE_END = "[.!?]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where a lambda function repeats it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    """Without outer white space."""
    return F.regexp_replace(text, rf"(?U)\A[{BLANK}]+|[{BLANK}]+\z", "")


def strip_boilerplate(text: Column) -> Column:
    """What stands after the first ``*** START OF … ***`` and before the first ``*** END OF … ***`` after it."""
    after = F.regexp_replace(text, r"(?isu)\A.*?\*\*\*\s*START OF.*?\*\*\*", "")
    return strip(F.regexp_replace(after, r"(?isu)\*\*\*\s*END OF.*?\*\*\*.*\z", ""))


def paragraphs(text: Column, separator: str = PARAGRAPH_BREAK) -> Column:
    """Array of stripped, non-empty paragraphs."""
    return F.filter(F.transform(F.split(text, separator, -1), strip), lambda p: p != "")


def word_count(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_count(text, F.lit(rf"(?U)[^{BLANK}]+"))


def sentences(text: Column) -> Column:
    """Array of what lies between sentence marks, blank parts left out."""
    return F.filter(F.split(text, SENTENCE_END, -1), lambda s: s.rlike(rf"(?U)[^{BLANK}]"))


def printable_ratio(text: Column) -> Column:
    """Share of letters, white space and plain punctuation; 0 for an empty text. Digits and brackets count as the rest."""
    good = F.length(F.regexp_replace(text, rf"(?U)[^\p{{L}}{BLANK}.,;:!?'\"-]", ""))
    return F.when(F.length(text) == 0, 0.0).otherwise(good / F.length(text))


def content_id(text: Column) -> Column:
    """The first 12 hex digits of the text's MD5."""
    return F.substring(F.md5(F.encode(text, "UTF-8")), 1, 12)


def base_id(pair_id: Column) -> Column:
    """The excerpt a pair id names: without ``null_``, else up to the last underscore."""
    return F.when(F.startswith(pair_id, F.lit("null_")), F.substring(pair_id, 6, 1 << 30)).otherwise(style_base_id(pair_id))


def style_base_id(pair_id: Column) -> Column:
    """Up to the last underscore; ``null_`` is no exception here."""
    return F.regexp_replace(pair_id, r"_[^_]*\z", "")


def pair_id(excerpt: Column, teacher: Column) -> Column:
    """``{excerpt}_{teacher}``."""
    return F.concat(excerpt, F.lit("_"), teacher)


def null_id(excerpt: Column) -> Column:
    """``null_{excerpt}``."""
    return F.concat(F.lit("null_"), excerpt)


def file_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(path, "/", -1), -1)


def plain_pattern(pattern: Column) -> Column:
    """A pattern without its word boundaries."""
    return F.replace(pattern, F.lit(r"\b"), F.lit(""))


def head(text: Column, chars: int) -> Column:
    """The first characters."""
    return F.substring(text, 1, chars)


def rounded(x: Column, places: int) -> Column:
    """Rounded half to even, as the report's figures are."""
    return F.bround(x, places)


def six(x: Column) -> Column:
    """Rounded half up to 6 places in double arithmetic, which every engine does alike."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def lossy_text(raw: Column) -> Column:
    """UTF-8 bytes as text: undecodable bytes are dropped and line ends made ``\\n``."""
    text = F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))
    return F.regexp_replace(text, r"\r\n?", "\n")
