"""Text clean-up: punctuation, fillers, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow import constants as K
from cueflow.functions.ordered import BLOCK, dense_position
from cueflow.functions.text import replace_literal, strip

# Fixed pattern: any markup tag.
_TAG = "<[^>]+>"


def normalize_punctuation(text: Column) -> Column:
    """The literal punctuation rules, each once over the text, in order."""
    for wrong, right in K.PUNCTUATION_RULES:
        text = replace_literal(text, wrong, right)
    return text


def strip_markup(text: Column, preserve_formatting: bool = False) -> Column:
    """Text without tags and with single spaces."""
    if preserve_formatting:
        return text
    bare = F.regexp_replace(text, _TAG, "")
    return F.regexp_replace(bare, K.WHITESPACE_CLASS + "+", " ")


def filler_pattern(lang: str, custom: list[str] = []) -> str:
    """One alternation per language, longest phrase first, bounded by words, any case."""
    phrases = sorted({*K.FILLERS[lang], *custom}, key=lambda p: (-len(p), p))
    quoted = "|".join(r"\Q" + p.replace(r"\E", r"\E\\E\Q") + r"\E" for p in phrases)
    return rf"(?iuU)\b(?:{quoted})\b"


def _by_language(lang: Column, build, otherwise: Column) -> Column:
    out = None
    for code in K.FILLERS:
        out = (F.when if out is None else out.when)(lang == code, build(code))
    return out.otherwise(otherwise)


def filler_counts(text: Column, lang: Column, custom: list[str] = []) -> Column:
    return _by_language(
        lang, lambda code: F.regexp_count(text, F.lit(filler_pattern(code, custom))), F.lit(0)
    )


def remove_fillers(
    text: Column, lang: Column, mode: str = "remove", custom: list[str] = []
) -> Column:
    """Fillers cut out and the spaces around them collapsed (`mode` keep leaves text alone)."""
    if mode == "keep":
        return text
    if mode != "remove":
        raise ValueError(f"unknown filler mode: {mode}")
    cut = _by_language(
        lang, lambda code: F.regexp_replace(text, filler_pattern(code, custom), ""), text
    )
    return strip(F.regexp_replace(cut, " +", " "))


def drop_empty(segments: DataFrame) -> DataFrame:
    """Segments with something to read, their positions counted anew."""
    kept = segments.where(strip(F.col("text")) != "")
    return dense_position(kept, ["doc_id"], ["pos"], F.floor(F.col("pos") / BLOCK))
