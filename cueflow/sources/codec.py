"""Subtitle text to segments and back.

Parsing filters the array of blocks inside one row, so list positions need no shuffle; the fields
of the accepted blocks are then cut out of plain rows. Rendering shuffles once by (document, part);
a part holds at most `part_cues` cues and the parts of a document, concatenated in order, are its
text. Documents within the segment limit have one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow.constants import BLANK_CLASS, MAX_SEGMENTS, NON_WHITESPACE_CLASS, WHITESPACE_CLASS
from cueflow.functions.text import drop_bom, fold_newlines, lstrip, strip
from cueflow.functions.timecode import (
    DIGIT,
    SRT_SPAN,
    VTT_LONG_SPAN,
    VTT_SHORT_SPAN,
    fold_digits,
    srt_clock,
    srt_times,
    vtt_clock,
    vtt_times,
)

# Fixed patterns: the WebVTT header and the tags that are removed from cue text.
_VTT_HEADER = r"(?s)\AWEBVTT.*?\n\n"
_VTT_TAGS = ["<v[^>]*>", "</v>", "<c[^>]*>", "</c>"]

# Fixed pattern: a well-formed SRT block is a number, a timing line, and something to read.
_SRT_BLOCK = (
    rf"\A{WHITESPACE_CLASS}*[+-]?{DIGIT}+(?:_{DIGIT}+)*{BLANK_CLASS}*\n"
    rf"{BLANK_CLASS}*{SRT_SPAN}[^\n]*\n{WHITESPACE_CLASS}*{NON_WHITESPACE_CLASS}"
)
# Fixed pattern: a WebVTT timing line has both ends with hours or both without.
_VTT_LINE = rf"\A{BLANK_CLASS}*(?:{VTT_LONG_SPAN}|{VTT_SHORT_SPAN})"


def clean_content(
    content: Column, normalize_newlines: bool = True, strip_bom: bool = True
) -> Column:
    if strip_bom:
        content = drop_bom(content)
    return fold_newlines(content) if normalize_newlines else content


def _blocks(content: Column) -> Column:
    return F.split(strip(content), "\n\n", -1)


def _srt_blocks(content: Column) -> Column:
    """The well-formed blocks, in the shape of `_webvtt_blocks` with all in `text`."""
    return F.transform(
        F.filter(_blocks(content), lambda b: b.rlike(_SRT_BLOCK)),
        lambda b: F.struct(F.lit("").alias("line"), strip(b).alias("text")),
    )


def _without_tags(text: Column) -> Column:
    bare = text
    for tag in _VTT_TAGS:
        bare = F.regexp_replace(bare, tag, "")
    return F.when(F.contains(text, F.lit("<")), bare).otherwise(text)


def _after_newline(text: Column) -> Column:
    """What follows the first newline, empty without one."""
    at = F.instr(text, "\n")
    return F.when(at > 0, F.substr(text, at + 1)).otherwise(F.lit(""))


def _webvtt_blocks(content: Column) -> Column:
    """array<struct<line, text>> of the cues: the first line with an arrow, and the text below."""
    timed = F.filter(
        _blocks(F.regexp_replace(content, _VTT_HEADER, "")),
        lambda b: F.contains(b, F.lit("-->")),
    )

    def cut(b: Column) -> Column:
        before = F.substring_index(F.split_part(b, F.lit("-->"), F.lit(1)), "\n", -1)
        onward = F.substr(b, F.instr(b, "-->"))
        return F.struct(
            F.concat(before, F.substring_index(onward, "\n", 1)).alias("line"),
            _without_tags(strip(_after_newline(onward))).alias("text"),
        )

    return F.filter(
        F.transform(timed, cut), lambda c: c["line"].rlike(_VTT_LINE) & (c["text"] != "")
    )


def cue_number(text: Column) -> Column:
    """A cue number as a long; digits may be of any script.

    One that no long can hold becomes 2^62 and 60 bits of a digest of its digits, with its sign, so
    equal numbers stay equal and different ones apart.
    """
    digits = fold_digits(F.replace(strip(text), F.lit("_")))
    bare = F.regexp_replace(digits, r"^[+-]?0*", "")
    large = F.lit(1 << 62) + F.conv(F.substring(F.md5(bare), 1, 15), 16, 10).cast("long")
    return F.coalesce(
        digits.try_cast("long"), F.when(F.startswith(digits, F.lit("-")), -large).otherwise(large))


def _segments(docs: DataFrame, blocks: Column, is_srt: Column, key: list[str]) -> DataFrame:
    rows = docs.select(*key, is_srt.alias("is_srt"), F.posexplode(blocks).alias("pos", "b"))
    split = rows.withColumn(
        "parts",
        F.when(F.col("is_srt"), F.split(F.col("b.text"), "\n", 3))
        .otherwise(F.array(F.lit(""), F.col("b.line"), F.col("b.text"))),
    )
    part = [F.get("parts", F.lit(i)) for i in range(3)]
    lines = split.select(
        *key, F.col("pos").cast("long").alias("pos"), "is_srt",
        part[0].alias("number"), lstrip(part[1]).alias("line"),
        F.when(F.col("is_srt"), strip(part[2])).otherwise(part[2]).alias("text"),
    )
    times = F.when(F.col("is_srt"), srt_times(F.col("line"))).otherwise(vtt_times(F.col("line")))
    number = cue_number(F.col("number"))
    return lines.select(
        *key, "pos", F.when(F.col("is_srt"), number).otherwise(F.col("pos") + 1).alias("idx"),
        times.alias("t"), "text",
    ).select(*key, "pos", "idx", "t.start_ms", "t.end_ms", "text")


def parse(
    docs: DataFrame,
    key: list[str] = ["doc_id"],
    normalize_newlines: bool = True,
    strip_bom: bool = True,
) -> DataFrame:
    """Segments of documents (key…, format, content); other formats give no rows."""
    content = clean_content(F.col("content"), normalize_newlines, strip_bom)
    is_srt = F.col("format") == "srt"
    blocks = F.when(is_srt, _srt_blocks(content)).when(
        F.col("format") == "webvtt", _webvtt_blocks(content)
    )
    return _segments(docs, blocks, is_srt, key)


def parse_srt(docs: DataFrame, key: list[str] = ["doc_id"], **options: bool) -> DataFrame:
    """Well-formed blocks as segments; everything else is dropped without a trace."""
    content = clean_content(F.col("content"), **options)
    return _segments(docs, _srt_blocks(content), F.lit(True), key)


def parse_webvtt(docs: DataFrame, key: list[str] = ["doc_id"], **options: bool) -> DataFrame:
    """As `parse_srt`; cue numbers count the accepted cues from 1."""
    content = clean_content(F.col("content"), **options)
    return _segments(docs, _webvtt_blocks(content), F.lit(False), key)


def _join_pieces(segments: DataFrame, piece: Column, part_cues: int) -> DataFrame:
    """Pieces concatenated by position: (doc_id, part_no, content)."""
    pieces = segments.select(
        "doc_id", F.floor(F.col("pos") / part_cues).cast("long").alias("part_no"),
        F.struct("pos", piece.alias("piece")).alias("row"),
    )
    ordered = F.array_sort(F.collect_list("row"))
    return pieces.groupBy("doc_id", "part_no").agg(
        F.array_join(F.transform(ordered, lambda r: r["piece"]), "").alias("content")
    )


def _first(text: str, otherwise: str) -> Column:
    return F.when(F.col("pos") == 0, F.lit(text)).otherwise(F.lit(otherwise))


def render_srt(segments: DataFrame, part_cues: int = MAX_SEGMENTS) -> DataFrame:
    """SRT text, cues renumbered from 1."""
    piece = F.concat(
        _first("", "\n"), (F.col("pos") + 1).cast("string"), F.lit("\n"),
        srt_clock(F.col("start_ms")), F.lit(" --> "), srt_clock(F.col("end_ms")), F.lit("\n"),
        F.col("text"), F.lit("\n"),
    )
    return _join_pieces(segments, piece, part_cues)


def render_webvtt(segments: DataFrame, part_cues: int = MAX_SEGMENTS) -> DataFrame:
    piece = F.concat(
        _first("WEBVTT\n\n", "\n"),
        vtt_clock(F.col("start_ms")), F.lit(" --> "), vtt_clock(F.col("end_ms")), F.lit("\n"),
        F.col("text"), F.lit("\n"),
    )
    return _join_pieces(segments, piece, part_cues)


def render_corrected(
    segments: DataFrame, timecode: str = "srt", part_cues: int = MAX_SEGMENTS
) -> DataFrame:
    """Corrected text that keeps the cue numbers; `raw_ms` prints times as plain milliseconds."""
    if timecode not in ("srt", "raw_ms"):
        raise ValueError(f"unknown timecode style: {timecode}")
    clock = srt_clock if timecode == "srt" else lambda ms: ms.cast("string")
    piece = F.concat(
        _first("", "\n"), F.col("idx").cast("string"), F.lit("\n"),
        clock(F.col("start_ms")), F.lit(" --> "), clock(F.col("end_ms")), F.lit("\n"),
        F.col("text"), F.lit("\n"),
    )
    return _join_pieces(segments, piece, part_cues)
