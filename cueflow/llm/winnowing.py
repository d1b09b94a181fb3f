"""Document fingerprints by winnowing, in column expressions only.

A text is cut into units: runs of up to `UNIT_CHARS` characters that are not blank, and the single
characters of longer runs, so that in text without blanks a unit does not depend on what stands
before it. Each run of `GRAM` units is a gram; its hash
is rolled up from the hashes of its halves, which neighbouring grams share. Of every `WINDOW`
consecutive grams the one with the smallest hash is kept, the rightmost of several. Two texts that
share `GRAM + WINDOW - 1` units in a row therefore share a kept gram, and its position in each says
where.

Kept grams travel as one long each, the hash in the upper 32 bits and the position, counted from
above, in the lower 31: the smaller of two longs is the smaller hash and then the later position.
Window minima are taken by doubling, so a text costs a fixed number of passes over its units.

Null texts count as empty. A text without a unit has no grams; one with fewer than GRAM units has a
single gram of all of them, and one with fewer than WINDOW grams a single window of all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueflow.session import settle

UNIT_CHARS = 16
UNIT = r"(?<!\S)\S{1,%d}(?!\S)|\S" % UNIT_CHARS
GRAM = 5
WINDOW = 8
LAST_POSITION = (1 << 31) - 1


def _shifted(values: str, by: int) -> F.Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _rolled(left: str, right: str, by: int) -> F.Column:
    """Hash of each value of `left` with the value of `right` that stands `by` places later."""
    return F.zip_with(left, _shifted(right, by), lambda a, b: F.xxhash64(a, b))


def _least(values: str, by: int) -> F.Column:
    return F.zip_with(values, _shifted(values, by), lambda a, b: F.least(a, b))


def with_kept_grams(rows: DataFrame, text: F.Column, out: str) -> DataFrame:
    """`rows` with the kept grams of `text` as array<long>, by position."""
    names = ("__u1", "__u2", "__u4", "__g")
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))
    grams = (
        rows.withColumn("__u1", F.transform(units, lambda u: F.xxhash64(u)))
        .withColumn("__u2", _rolled("__u1", "__u1", 1))
        .withColumn("__u4", _rolled("__u2", "__u2", 2))
        .withColumn("__g", _rolled("__u4", "__u1", 4))
    )
    n = F.size("__u1")
    whole = F.when(n > 0, F.array(F.xxhash64("__u1"))).otherwise(F.array().cast("array<long>"))
    grams = grams.withColumn(
        "__g", F.when(n >= GRAM, F.slice("__g", 1, F.greatest(n - GRAM + 1, F.lit(0)))).otherwise(whole))
    packed = F.transform("__g", lambda g, i: F.shiftleft(
        g.bitwiseAND(0xFFFFFFFF), 31).bitwiseOR(F.lit(LAST_POSITION) - i.cast("long")))
    minima = (
        grams.withColumn("__m1", packed)
        .withColumn("__m2", _least("__m1", 1))
        .withColumn("__m4", _least("__m2", 2))
        .withColumn("__m8", _least("__m4", 4))
    )
    full = F.size("__m1") - WINDOW + 1
    kept = F.when(full > 0, F.slice("__m8", 1, F.greatest(full, F.lit(1)))).when(
        F.size("__m1") > 0, F.array(F.array_min("__m1"))).otherwise(F.col("__m1"))
    return minima.withColumn(out, F.array_distinct(kept)).drop(
        *names, "__m1", "__m2", "__m4", "__m8")


def hash_of(gram: F.Column) -> F.Column:
    return F.shiftright(gram, 31)


def position_of(gram: F.Column) -> F.Column:
    return F.lit(LAST_POSITION) - gram.bitwiseAND(LAST_POSITION)


def hashes(kept: F.Column) -> F.Column:
    """Distinct hashes of kept grams, each in 32 bits."""
    return F.array_distinct(F.transform(kept, lambda g: (hash_of(g) - F.lit(1 << 31)).cast("int")))


def likeness(a: F.Column, b: F.Column) -> F.Column:
    """Shared among all hashes of two sets; 1 where both are empty."""
    shared = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - shared
    return F.when(both == 0, 1.0).otherwise(shared / both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, grams): kept grams of each row as array<struct<hash, position>>, by position."""
    rows = with_kept_grams(docs.select(id_col, text_col), F.col(text_col), "__kept")
    return rows.select(id_col, F.transform("__kept", lambda g: F.struct(
        hash_of(g).alias("hash"), position_of(g).alias("position"))).alias("grams"))


def rendered(kept: F.Column) -> F.Column:
    """Kept grams as text: hash in hex and position, in order of position."""
    return F.array_join(F.transform(kept, lambda g: F.concat(
        F.lower(F.hex(hash_of(g))), F.lit("@"), position_of(g).cast("string"))), " ")


def followers(rows: DataFrame, id_col: str) -> DataFrame:
    """(id_key, text_key, next_id_key, next_text_key): each document's next by descending id.

    `rows` has the id and `id_key`, `text_key`, which together name a document; rows that repeat
    both are one document. The smallest is followed by the largest. Documents are laid out in
    ranges, each range is numbered for itself, and only the first document of each range is
    looked at across ranges.
    """
    order = [F.col(id_col).desc_nulls_last(), F.col("id_key"), F.col("text_key")]
    laid = settle(
        rows.groupBy(id_col, "id_key", "text_key").agg(F.count("*").alias("times"))
        .repartitionByRange(*order).select(id_col, "id_key", "text_key")
        .withColumn("part", F.spark_partition_id()), "followers")
    own = F.struct("id_key", "text_key")
    place = F.struct(F.col(id_col).isNull().alias("last"), (-F.col(id_col)).alias("key"),
                     "id_key", "text_key")
    firsts = laid.groupBy("part").agg(F.min_by(own, place).alias("first"))
    # one row per range
    ranges = firsts.withColumn("after", F.coalesce(
        F.lead("first").over(Window.orderBy("part")),
        F.first("first").over(Window.orderBy("part"))))
    step = Window.partitionBy("part").orderBy(*order)
    return (
        laid.withColumn("next", F.lead(own).over(step))
        .join(ranges.select("part", "after"), "part")
        .withColumn("next", F.coalesce("next", "after"))
        .select("id_key", "text_key", F.col("next.id_key").alias("next_id_key"),
                F.col("next.text_key").alias("next_text_key"))
    )


def edited_likeness(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_chars, edited, kept, edited_kept, next_hashes): each text, its edit and its next.

    The edit replaces the last third of the code points by as many from the start of the next
    document. Texts are dealt by document once; what moves on to the document before is the part
    that it takes over and the next one's hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        id_col, text.alias("text"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id_key"),
        F.xxhash64(text).alias("text_key"))
    # the id goes with the links, so that both joins below deal out the same rows: once
    links = settle(
        followers(rows.select(id_col, "id_key", "text_key"), id_col).join(
            rows.select(F.col(id_col).alias("own_id"), "id_key", "text_key",
                        (F.char_length("text") / 3).cast("int").alias("taken")).distinct(),
            ["id_key", "text_key"]), "links")
    texts = rows.select("text", "id_key", "text_key")
    taken = (
        texts.join(
            links.select(F.col("next_id_key").alias("id_key"), F.col("next_text_key").alias("text_key"),
                         F.col("id_key").alias("to_id"), F.col("text_key").alias("to_text"), "own_id",
                         "taken"),
            ["id_key", "text_key"])
    )
    taken = with_kept_grams(taken, F.col("text"), "kept").select(
        F.col("to_id").alias("id_key"), F.col("to_text").alias("text_key"), "own_id",
        F.left("text", F.col("taken")).alias("taken_text"), hashes(F.col("kept")).alias("next_hashes"))
    # repeated rows of the next document give the same row each
    taken = taken.groupBy("id_key", "text_key").agg(
        F.first("own_id").alias("own_id"), F.first("taken_text").alias("taken_text"),
        F.first("next_hashes").alias("next_hashes"))
    n = F.char_length("text")
    met = texts.join(taken, ["id_key", "text_key"]).withColumn("edited", F.concat(
        F.left("text", n - F.floor(n / 3).cast("int")), "taken_text"))
    met = with_kept_grams(met, F.col("text"), "kept")
    return with_kept_grams(met, F.col("edited"), "edited_kept").select(
        F.col("own_id").alias(id_col), n.cast("long").alias("n_chars"), "edited", "kept", "edited_kept", "next_hashes")
