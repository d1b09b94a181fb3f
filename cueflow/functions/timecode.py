"""Timecode expressions: text to milliseconds and back."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueflow.constants import BLANK_CLASS
from cueflow.functions.text import let, lstrip, strip

# Fixed patterns: the pairs of clocks a timing line may start with.
_ARROW = f"{BLANK_CLASS}*-->{BLANK_CLASS}*"


def _pair(clock: str) -> str:
    return f"{clock}{_ARROW}{clock}"


# Decimal digits of any script.
DIGIT = r"\p{Nd}"
SRT_SPAN = _pair(f"{DIGIT}{{2}}:{DIGIT}{{2}}:{DIGIT}{{2}},{DIGIT}{{3}}")
VTT_LONG_SPAN = _pair(rf"{DIGIT}{{2}}:{DIGIT}{{2}}:{DIGIT}{{2}}\.{DIGIT}{{3}}")
VTT_SHORT_SPAN = _pair(rf"{DIGIT}{{2}}:{DIGIT}{{2}}\.{DIGIT}{{3}}")

_DIGITS = [chr(code) for code in range(0x80, 0x20000) if unicodedata.category(chr(code)) == "Nd"]


def fold_digits(text: Column) -> Column:
    """`text` with the decimal digits of all scripts as ASCII digits."""
    values = "".join(str(unicodedata.decimal(digit)) for digit in _DIGITS)
    folded = F.translate(text, "".join(_DIGITS), values)
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(folded)


def _clock_ms(text: Column, with_hours: bool) -> Column:
    """Milliseconds of a clock whose fields stand at fixed offsets (the pattern has checked them)."""

    def field(offset: int, size: int) -> Column:
        return F.substring(text, offset, size).cast("long")

    if with_hours:
        seconds = field(1, 2) * 3600 + field(4, 2) * 60 + field(7, 2)
        return seconds * 1000 + field(10, 3)
    return (field(1, 2) * 60 + field(4, 2)) * 1000 + field(7, 3)


def _span(line: Column, with_hours: bool) -> Column:
    return F.struct(
        _clock_ms(line, with_hours).alias("start_ms"),
        _clock_ms(lstrip(F.split_part(line, F.lit("-->"), F.lit(2))), with_hours).alias("end_ms"),
    )


def srt_times(line: Column) -> Column:
    """struct(start_ms, end_ms), null when the line is no SRT timing line."""
    return let(fold_digits(line), lambda x: F.when(x.rlike("^" + SRT_SPAN), _span(x, True)))


def cut_cue_settings(line: Column) -> Column:
    """A WebVTT timing line without its position and align settings."""
    cut = F.split_part(line, F.lit(" position"), F.lit(1))
    return strip(F.split_part(cut, F.lit(" align"), F.lit(1)))


def vtt_times(line: Column) -> Column:
    """struct(start_ms, end_ms) of a cut WebVTT timing line; both ends with hours or both without."""
    return let(
        fold_digits(line),
        lambda x: F.when(x.rlike("^" + VTT_LONG_SPAN), _span(x, True)).when(
            x.rlike("^" + VTT_SHORT_SPAN), _span(x, False)
        ),
    )


def _padded(value: Column, width: int) -> Column:
    """Zero-padded to at least `width`, never cut."""
    text = value.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def clock_text(ms: Column, decimal_mark: str) -> Column:
    """`HH:MM:SS<mark>mmm`; hours may take more than two digits."""
    in_hour = F.pmod(ms, F.lit(3600000))
    in_minute = F.pmod(ms, F.lit(60000))
    in_second = F.pmod(ms, F.lit(1000))
    hours = ((ms - in_hour) / 3600000).cast("long")
    minutes = ((in_hour - in_minute) / 60000).cast("long")
    seconds = ((in_minute - in_second) / 1000).cast("long")
    return F.concat(
        _padded(hours, 2), F.lit(":"), _padded(minutes, 2), F.lit(":"), _padded(seconds, 2),
        F.lit(decimal_mark), _padded(in_second, 3),
    )


def srt_clock(ms: Column) -> Column:
    return clock_text(ms, ",")


def vtt_clock(ms: Column) -> Column:
    return clock_text(ms, ".")
