"""Spelling rules over running text: each whole-word hit in any case is replaced, rule by rule.

Rules work in order on the running text, so one rule's output can be another's input. Any number of
rules takes the same way: a rule is a candidate for a text that holds its longest word, or for which
a candidate before it may write that word. Only texts with candidates are rewritten, each once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow.constants import WORD_CLASS
from cueflow.functions.skew import join_spread
from cueflow.functions.text import (
    let,
    plain_term_pattern,
    quote_replacement,
    whole_term_pattern,
)
from cueflow.session import settle

_OTHER_CLASS = WORD_CLASS.replace("[", "[^")
_RUNS = f"({WORD_CLASS}+|{_OTHER_CLASS}+)"
_WORDS = f"({WORD_CLASS}+)"
_WHOLE_WORDS = rf"(?s)\A{WORD_CLASS}(.*{WORD_CLASS})?\z"
#: Up to so many rules, and bytes of their terms, are broadcast; more are joined by a salted shuffle.
FEW_RULES, FEW_BYTES = 100_000, 8_000_000


def _odd_letters() -> dict[str, str]:
    """Letters whose lower case differs from the lower case of their upper case, and the latter.

    Patterns that ignore case compare the latter, letter by letter; the lower case of a whole string
    also looks at neighbours (a capital sigma at the end of a word) and may take two letters.
    """
    out = {"\u0130": "i", "\u03a3": "\u03c3"}
    for code in range(0x80, 0x10000):
        letter = chr(code)
        folded = letter.upper().lower() if len(letter.upper()) == 1 else letter
        if len(folded) == 1 and folded != letter.lower():
            out.setdefault(letter, folded)
    return out


_ODD = _odd_letters()


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def fold_case(text: Column) -> Column:
    """Text in the form in which patterns that ignore case compare it."""
    odd = F.lower(F.translate(text, "".join(_ODD), "".join(_ODD.values())))
    return F.when(_is_ascii(text), F.lower(text)).otherwise(odd)


def _words(text: Column, gaps: bool) -> Column:
    """Distinct words of a text in folded case; with `gaps` also what stands between them."""
    return F.array_distinct(F.regexp_extract_all(fold_case(text), F.lit(_RUNS if gaps else _WORDS)))


def _keyed(rules: DataFrame) -> DataFrame:
    """`rules` with `word`, the longest of the term, and `wordless`.

    A term without a word is its own key: bounded by word boundaries, it fills a whole gap.
    """
    words = F.regexp_extract_all(fold_case(F.col("wrong")), F.lit(_WORDS))
    longest = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return rules.withColumn("wordless", F.size(words) == 0).withColumn(
        "word", F.when(F.size(words) > 0, F.get(longest, F.lit(0))["w"]).otherwise(
            fold_case(F.col("wrong"))))


def _is_loose(gaps: bool) -> Column:
    """Whether a rule may write words (or, with `gaps`, gaps) that its replacement does not hold.

    Matches end at word boundaries. So a replacement grows together with a word next to it only
    where the term itself does not begin or end with a word, and with a gap only where the
    replacement does not.
    """
    closed = F.col("wrong").rlike(_WHOLE_WORDS)
    if gaps:
        closed = closed & F.col("right").rlike(_WHOLE_WORDS)
    return ~closed


_NEWS = "array<struct<word:string,at_stage:int,at_n:bigint>>"


def _fold(text: Column, hits: Column, gaps: bool, apart: str) -> Column:
    """(text, news): the text after the ordered hits, and its words after each loose one.

    Where text and term are ASCII, the plain pattern matches the same.
    """
    seed = F.struct(text.alias("text"), F.array().cast(_NEWS).alias("news"))

    def step(acc: Column, rule: Column) -> Column:
        def state(after: Column) -> Column:
            news = F.transform(_words(after, gaps), lambda w: F.struct(
                w.alias("word"), rule["stage"].alias("at_stage"), rule["n"].alias("at_n")))
            return F.struct(
                after.alias("text"),
                F.when(rule["loose"] & (after != acc["text"]), F.concat(acc["news"], news))
                .otherwise(acc["news"]).alias("news"))

        plain = _is_ascii(acc["text"]) & _is_ascii(rule["wrong"])
        pattern = F.when(plain, plain_term_pattern(rule["wrong"])).otherwise(
            whole_term_pattern(rule["wrong"], apart))
        return let(F.regexp_replace(acc["text"], pattern, quote_replacement(rule["right"])), state)

    return F.aggregate(hits, seed, step)


def _is_few(table: DataFrame, size: Column) -> bool:
    """Whether rows with `size` bytes of text may be broadcast."""
    found = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return found.n <= FEW_RULES and found.bytes <= FEW_BYTES


def enforce_rules(
    segments: DataFrame, rules: DataFrame, own_rules: DataFrame | None = None, apart: str = ""
) -> DataFrame:
    """Segments after `rules` (wrong, right, stage, n), and `own_rules` per document if given.

    Letters `apart`, which no rule may look for, equal no others in any case.

    The segments are evaluated once and dealt out by their key; where the rules are broadcast, their
    candidates are found and listed there. Candidates come from an equi-join of the texts' words with
    the rules' words, then, in rounds over new candidates only, from the words of their replacements;
    so they hold every rule that may match at its turn. A text is rewritten once with all its
    candidates; only after a rule that can glue words together (`_is_loose`) its words are looked at
    again, and the text is rewritten once more if they bring new candidates.

    What has rows per document or text is kept off broadcast: equal terms of many documents take next
    to nothing in a file, by whose size Spark would send them all through the driver. Of the texts'
    words only those that some document's own rules look for are dealt out to meet them.
    """
    columns = ["wrong", "right", "stage", "n", "word", "wordless"]
    keyed = settle(_keyed(rules).select(columns), "rules")
    keyed_own = None if own_rules is None else settle(
        _keyed(own_rules).select("doc_id", *columns), "own-rules")
    all_rules = keyed if keyed_own is None else keyed.unionByName(keyed_own.select(columns))
    few = _is_few(keyed, F.octet_length("wrong") + F.octet_length("right"))
    if keyed_own is not None:
        own_words = settle(keyed_own.select("word").distinct(), "own-words")
        few_own_words = _is_few(own_words, F.octet_length("word"))
    known = all_rules.agg(
        F.count("*").alias("n"), F.coalesce(F.bool_or("wordless"), F.lit(False)).alias("gaps"),
        F.coalesce(F.bool_or(_is_loose(False)), F.lit(False)).alias("loose"),
        F.coalesce(F.bool_or(_is_loose(True)), F.lit(False)).alias("loose_gaps")).first()
    if not known.n:
        return segments
    gaps, loose = known.gaps, known.loose_gaps if known.gaps else known.loose
    row_key = ["doc_id", "pos"]
    segments = settle(segments, "rule-segments")
    dealt = segments.repartition(*row_key)
    names = [*row_key, "wrong", "right", "stage", "n"]
    later = (F.col("stage") > F.col("at_stage")) | (
        (F.col("stage") == F.col("at_stage")) & (F.col("n") > F.col("at_n")))

    def candidates(words: DataFrame) -> DataFrame:
        """Rules (row key, rule) for words (row key, word, place written at)."""
        if few:
            found = words.join(F.broadcast(keyed), "word").where(later).select(*names)
        else:  # a common word may be a rule's
            found = join_spread(words, keyed.hint("merge"), ["word"], "inner", by=row_key).where(
                later).select(*names)
        if keyed_own is not None:
            found = found.join(keyed_own.select("doc_id", "wrong").hint("merge"), ["doc_id", "wrong"],
                               "left_anti")
            asked = words.join(F.broadcast(own_words), "word", "left_semi") if few_own_words else words
            found = found.unionByName(
                asked.join(keyed_own.hint("merge"), ["doc_id", "word"]).where(later).select(*names))
        return found

    def unknown(found: DataFrame, hits: DataFrame) -> DataFrame:
        return settle(
            found.distinct().join(hits.select(*row_key, "stage", "n").hint("merge"),
                                  [*row_key, "stage", "n"], "left_anti"), "fresh-hits")

    def closed(hits: DataFrame, fresh: DataFrame) -> DataFrame:
        """`hits`, with `fresh` in them, and whatever replacements of candidates may bring."""
        while True:
            written = fresh.select(
                *row_key, F.explode(_words(F.col("right"), gaps)).alias("word"),
                F.col("stage").alias("at_stage"), F.col("n").alias("at_n"))
            fresh = unknown(candidates(written.join(writable, "word", "left_semi")), hits)
            if fresh.isEmpty():
                return hits
            hits = hits.unionByName(fresh)

    def folded(hits: DataFrame, rows: DataFrame) -> DataFrame:
        """`rows` with `fold`, what their hits make of them; each hit counts once."""
        listed = hits.groupBy(*row_key).agg(
            F.array_sort(F.collect_set(F.struct(
                "stage", "n", "wrong", "right", _is_loose(gaps).alias("loose")))).alias("rules"))
        rules = F.coalesce("rules", F.array().cast(listed.schema["rules"].dataType))
        return rows.join(listed.hint("merge"), row_key, "left").select(
            *rows.columns, _fold(F.col("text"), rules, gaps, apart).alias("fold"))

    # words that some rule writes and some rule looks for
    writable = settle(
        all_rules.select(F.explode(_words(F.col("right"), gaps)).alias("word")).distinct()
        .join(all_rules.select("word").distinct().hint("merge"), "word", "left_semi"), "writable")
    chains = not writable.isEmpty()
    hits = candidates(
        dealt.select(*row_key, F.explode(_words(F.col("text"), gaps)).alias("word"))
        .withColumns({"at_stage": F.lit(-1), "at_n": F.lit(-1).cast("long")}))
    if chains or loose:  # read again below
        hits = settle(hits, "hits")
    if chains:
        hits = closed(hits, hits)
    if not loose:
        return folded(hits, dealt).withColumn("text", F.col("fold.text")).drop("fold")
    done = last = settle(folded(hits, dealt), "rule-fold")
    texts = segments.select(*row_key, "text")
    redone = None
    while True:
        news = last.select(*row_key, F.inline("fold.news"))
        if news.isEmpty():
            break
        fresh = unknown(candidates(news), hits)
        if fresh.isEmpty():
            break
        hits = hits.unionByName(fresh)
        if chains:
            hits = closed(hits, fresh)
        rows = fresh.select(*row_key).distinct().hint("merge")
        last = settle(folded(hits.join(rows, row_key, "left_semi"),
                             texts.join(rows, row_key, "left_semi")), "rule-fold")
        redone = last if redone is None else redone.join(
            rows, row_key, "left_anti").unionByName(last)
    done = done.withColumn("text", F.col("fold.text")).drop("fold")
    if redone is None:
        return done
    again = redone.select(*row_key, F.col("fold.text").alias("new_text"))
    return (
        done.join(again.hint("merge"), row_key, "left")
        .withColumn("text", F.coalesce("new_text", "text"))
        .drop("new_text")
    )


def glossary_rules(glossary: DataFrame) -> DataFrame:
    """Rules from a glossary table (wrong, right, n)."""
    return glossary.select("wrong", "right", F.lit(2).alias("stage"), F.col("n").cast("long"))
