"""Text expressions with the whitespace, replacement and formatting rules results depend on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueflow.constants import WHITESPACE, WHITESPACE_CLASS, WORD_CLASS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """Whitespace-separated words; blank text gives an empty array."""
    return F.filter(F.split(text, WHITESPACE_CLASS + "+", -1), lambda w: w != "")


def squash(text: Column) -> Column:
    """Words joined by single spaces."""
    return F.array_join(words(text), " ")


def fold_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def drop_bom(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit("\ufeff")), F.substr(text, F.lit(2))).otherwise(text)


def replace_literal(text: Column, wrong: Column | str, right: Column | str) -> Column:
    wrong = F.lit(wrong) if isinstance(wrong, str) else wrong
    right = F.lit(right) if isinstance(right, str) else right
    return F.replace(text, wrong, right)


def quote_pattern(term: Column) -> Column:
    r"""`\Q...\E` form of a term, safe for any content."""
    return F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def quote_replacement(term: Column) -> Column:
    escaped = F.replace(term, F.lit("\\"), F.lit("\\\\"))
    return F.replace(escaped, F.lit("$"), F.lit("\\$"))


def whole_term_pattern(term: Column, apart: str = "") -> Column:
    r"""A term in any case between word bounds: as `\b`, but with words of WORD_CLASS.

    Letters `apart`, which the term must not have, equal no other ones. The term is looked for first,
    since few places have it. The letter in the class behind makes Java step over whole code points.
    """
    quoted, behind = quote_pattern(term), WORD_CLASS.replace("]", "\U00010000]")
    before = F.when(term.rlike(rf"\A{WORD_CLASS}"), F.lit(f"(?<!{behind})")).otherwise(
        F.lit(f"(?<={behind})"))
    after = F.when(term.rlike(rf"{WORD_CLASS}\z"), F.lit(f"(?!{WORD_CLASS})")).otherwise(
        F.lit(f"(?={WORD_CLASS})"))
    known = F.concat(F.lit(f"(?-iu:(?=[^{apart}]{{"), F.length(term), F.lit("}))")) if apart else F.lit("")
    return F.concat(F.lit("(?iu)(?="), quoted, F.lit(")"), known, before, quoted, after)


def plain_term_pattern(term: Column) -> Column:
    """The same for terms and texts of ASCII characters."""
    return F.concat(F.lit(r"(?i)\b"), quote_pattern(term), F.lit(r"\b"))


def one_decimal(chars: Column, duration_ms: Column) -> Column:
    """`chars / (duration_ms / 1000)` with one decimal, rounded as Python's `.1f` does.

    The quotient is rounded on integers. Only an exact tie depends on the double itself: it is
    scaled by 2**48 (exact from 16 up, the range the messages use) and compared with the tie.
    """
    doubled = chars * F.lit(20000)
    half_tenths = ((doubled - doubled % duration_ms) / duration_ms).cast("long")
    is_tie = (doubled % duration_ms == 0) & (half_tenths % 2 == 1)
    nearest = F.floor((half_tenths + 1) / 2).cast("long")
    low = F.floor((half_tenths - 1) / 2).cast("long")
    value = chars / (duration_ms / F.lit(1000.0))
    scaled = (value * F.lit(2.0**48)).cast("long").cast("decimal(20,0)") * F.lit(20)
    tie = half_tenths.cast("decimal(18,0)") * F.lit(2**48).cast("decimal(15,0)")
    even = F.when(low % 2 == 0, low).otherwise(low + 1)
    tenths = (
        F.when(~is_tie, nearest).when(scaled < tie, low).when(scaled > tie, low + 1).otherwise(even)
    )
    whole = F.floor(tenths / 10).cast("string")
    return F.concat(whole, F.lit("."), (tenths % 10).cast("string"))
