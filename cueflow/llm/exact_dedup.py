"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Three passes, none of which moves a text. The first two shuffle counts only: texts whose byte length
occurs once are done, then those whose (length, hash of the first characters) occurs once. After
each pass the surviving groups go into a bitmap of fixed size that every scan task gets, so the last
pass hashes the full content of surviving texts only. A bit set by chance costs one hash and changes
nothing, and a length or text that a third of the rows share is one row of each task's counts.

Null text counts as empty. Rows with a null id take part; the largest non-null id of a group is its
`keep_id`. Of rows repeated with the same id and text one is `kept`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.session import settle

PREFIX_CHARS = 256
#: Bits of the bitmap of surviving groups: 16 MB, whatever the input.
BITMAP_BITS = 1 << 27


def _bit(*cols: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(*cols), F.lit(BITMAP_BITS))


def bitmap_of(groups: DataFrame, *cols: str) -> DataFrame:
    """`groups` as bitmap buckets of 4 KB: at most BITMAP_BITS / 32768 rows."""
    bit = _bit(*cols)
    return groups.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))


def _is_set(bits: F.Column, position: F.Column) -> F.Column:
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.coalesce(F.getbit(byte.cast("long"), F.pmod(position, F.lit(8)).cast("int")) == 1,
                      F.lit(False))


def repeated(rows: DataFrame, *cols: str) -> DataFrame:
    """Values of `cols` that occur more than once; rows are combined before they are shuffled."""
    return rows.groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1").select(*cols)


def mark_groups(rows: DataFrame, groups: DataFrame, *cols: str) -> DataFrame:
    """`rows` with `survives`: true for every row of `groups`, by chance for a few others."""
    bit = _bit(*cols)
    return (
        rows.withColumn("bucket", F.bitmap_bucket_number(bit))
        .join(F.broadcast(bitmap_of(groups, *cols)), "bucket", "left")
        .withColumn("survives", _is_set(F.col("bits"), F.bitmap_bit_position(bit)))
        .drop("bucket", "bits")
    )


def survivors(rows: DataFrame, *cols: str) -> DataFrame:
    return mark_groups(rows, repeated(rows, *cols), *cols).filter("survives").drop("survives")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, full_hash and the columns `carry`.

    `full_hash` (SHA-256, hex) is null where length or prefix already told the text apart.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("__id"), text.alias("__text"), F.octet_length(text).alias("length"),
        F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("prefix"),
        *(F.col(c).alias(f"__carry_{c}") for c in carry),
    )
    by_length = survivors(rows, "length").select("length", "prefix")
    hashed = mark_groups(rows, repeated(by_length, "length", "prefix"), "length", "prefix").select(
        "__id", *(f"__carry_{c}" for c in carry),
        F.when(F.col("survives"), F.sha2("__text", 256)).alias("hash"))
    narrow = settle(hashed.withColumn("row", F.monotonically_increasing_id()), "exact")
    # a hash that the settled rows miss must not become one hot join key
    key = F.coalesce("hash", F.concat(F.lit("row "), F.col("row")))
    last = F.max(F.struct("__id", "row"))
    # written out, so that Spark can split the rows of a hot group in the join
    classes = settle(
        narrow.filter("hash is not null").groupBy(key.alias("key"))
        .agg(F.count("*").alias("size"), last.alias("last")),
        "exact-classes")
    out = narrow.withColumn("key", key).join(classes, "key", "left")
    return out.select(
        F.col("__id").alias(id_col),
        F.when(F.col("size").isNull(), F.col("__id")).otherwise(F.col("last.__id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("last.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.col("hash").alias("full_hash"),
        *(F.col(f"__carry_{c}").alias(c) for c in carry),
    )


def row_key(id_col: str, text_col: str) -> list[F.Column]:
    """`__id` and `__digest`: what names a row up to repetition, without its text."""
    return [F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("__id"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__digest")]


def keep_marked(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` without the rows that `marks` (__id, __digest, stays) says go.

    Rows without a mark stay. Of rows repeated with id and text, one stays. A bitmap of the marks
    tells most rows without one, so that only marked texts move to meet their mark.
    """
    marks = settle(
        marks.groupBy("__id", "__digest")
        .agg(F.max("stays").alias("__stays"), F.count("*").alias("__times")), "marks")
    # rows as one column, so that no name of theirs can clash
    keyed = mark_groups(
        docs.select(F.struct(*docs.columns).alias("row"), *row_key(id_col, text_col)),
        marks, "__id", "__digest")
    rest = keyed.filter(~F.col("survives")).select("row.*")
    met = keyed.filter("survives").join(marks, ["__id", "__digest"], "left").filter(
        F.coalesce("__stays", F.lit(True)))
    if marks.filter("__stays and __times > 1").isEmpty():
        return rest.unionByName(met.select("row.*"))
    once = met.filter(F.coalesce("__times", F.lit(1)) == 1)
    repeated_rows = met.filter("__times > 1").dropDuplicates(["__id", "__digest"])
    return rest.unionByName(once.unionByName(repeated_rows).select("row.*"))


def drop_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`docs` with one row of each group of equal texts, the one with the largest id."""
    keyed = docs.select(id_col, text_col, *row_key(id_col, text_col))
    groups = exact_groups(keyed, id_col, text_col, carry=("__id", "__digest"))
    marks = groups.filter("group_size > 1").select("__id", "__digest", F.col("kept").alias("stays"))
    return keep_marked(docs, marks, id_col, text_col)
