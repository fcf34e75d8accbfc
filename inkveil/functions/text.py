"""Text as columns: normalisation, keys, contexts. Positions count code points from 0."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.arrays import at, between

# Characters that normalisation deletes, and dashes that it makes one.
ZERO_WIDTH = "\u200b\u200c\u200d\u200e\u200f\ufeff\u00ad\u2060"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\uff0d\u30fc"

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F) if chr(c) not in DASHES)
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)

#: translate() arguments: characters beyond the second string's end are deleted.
FROM, TO = _WIDE + DASHES + "\u3000\t\r" + ZERO_WIDTH, _NARROW + "-" * len(DASHES) + "   "


def normalize(raw: Column) -> Column:
    """Full-width ASCII to ASCII, dashes to one, tabs and returns to spaces, zero-width characters deleted."""
    return F.translate(raw, FROM, TO)


def norm_index(raw: Column) -> Column:
    """For each character of the normalised text its position in the raw one; null if they are the same."""
    places = F.sequence(F.lit(0), F.length(raw) - 1)
    kept = F.filter(places, lambda i: ~F.contains(F.lit(ZERO_WIDTH), F.substring(raw, i + 1, F.lit(1))))
    return F.when(raw.rlike(f"[{ZERO_WIDTH}]"), kept)


def raw_start(index: Column, at: Column, raw: Column) -> Column:
    return F.when(index.isNull(), at).otherwise(F.coalesce(F.get(index, at), F.length(raw)))


def raw_end(index: Column, at: Column, raw: Column) -> Column:
    return F.when(index.isNull(), at).otherwise(F.coalesce(F.get(index, at - 1) + 1, F.length(raw)))


def slice_of(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def _count(n: int | Column) -> Column:
    return n if isinstance(n, Column) else F.lit(n)


def before(text: Column, start: Column, n: int | Column) -> Column:
    """At most n characters that end where the span starts."""
    return F.substring(text, F.greatest(start - _count(n), F.lit(0)) + 1, F.least(start, _count(n)))


def after(text: Column, end: Column, n: int | Column) -> Column:
    return F.substring(text, end + 1, _count(n))


def nfkc(value: Column) -> Column:
    """The compatibility composition of a text, by the Unicode library that Spark has for its collations; ASCII texts don't reach it.

    Spark takes calls of Java methods as not deterministic, so a join needs the result as a column first.
    """
    composed = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), value, F.lit(True))
    return F.when(F.octet_length(value) > F.char_length(value), composed).otherwise(value)


# Fixed value: what doesn't count in keys, beside white space.
_KEY_GONE = "-—_()（）"


def norm_key(value: Column) -> Column:
    """What makes two values the same: compatibility forms composed, without white space, dashes, underscores and round brackets, upper case."""
    return F.upper(F.regexp_replace(nfkc(value), rf"[\s\x1c-\x1f\x85\u1680\u2028\u2029{_KEY_GONE.replace('-', '')}\-]", ""))


def key_of(value: str) -> str:
    """norm_key() of one value, on the driver. Three letters have an upper case in Spark's newer Unicode only."""
    return "".join(c for c in unicodedata.normalize("NFKC", value) if not c.isspace() and c not in _KEY_GONE).upper()


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def kwic(raw: Column, start: Column, end: Column, n: int = 30) -> Column:
    """left【value】right with line ends as spaces in left and right."""
    left, right = (F.translate(x, "\n", " ") for x in (before(raw, start, n), after(raw, end, n)))
    return F.concat(left, F.lit("【"), slice_of(raw, start, end), F.lit("】"), right)


def kwic_at(parts: Column, raw: Column, start: Column, end: Column, n: int = 30) -> Column:
    """kwic() of a raw text in pieces (arrays.cut); n is arrays.PIECE at most."""
    left, right = (F.translate(x, "\n", " ") for x in (at(parts, start - n, n), at(parts, end, n)))
    return F.concat(left, F.lit("【"), between(parts, raw, start, end), F.lit("】"), right)


def first_word(text: Column, words: tuple[str, ...]) -> Column:
    """The first of words, in their order, that the text contains; null if none."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]) if words else F.lit(None).cast("string")


def like(value: Column, pattern: str) -> Column:
    """Whether the pattern is found in the value; null for null. Within a lambda rlike() would decode its pattern anew for each value."""
    return F.regexp_instr(value, F.lit(pattern)) > 0


# The sign of a redacted text.
REDACTED = r"\[[^\]\[]{1,16}#\d+\]"


def looks_redacted(text: Column) -> Column:
    """Whether the first 200,000 characters hold a placeholder."""
    return F.substring(text, 1, 200_000).rlike(REDACTED)
