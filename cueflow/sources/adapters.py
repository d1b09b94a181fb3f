"""Subtitle-shaped views of plain tables (events, documents, conversations, orders, …)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueflow.functions.ordered import dense_position, running_sum
from cueflow.functions.text import strip

EVENT_BUCKET = 10_000
DOC_BUCKET = 1_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` on more tasks when its files give fewer than two per core; else as it is, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < 2 * cores else df


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def _ms_since_2024(ts: str) -> Column:
    """Milliseconds from 2024-01-01, the same in every session time zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {ts})")


def event_segments(
    spark: SparkSession, folder: str, ms_per_unit: int = 100, shuffled: bool = False
) -> DataFrame:
    """One document per user, one segment per event; length is `value` times `ms_per_unit`.

    `shuffled` lists the events of each thousand in a scrambled order, so that list order and time
    order differ.
    """
    events = table(spark, folder, "events")
    start = _ms_since_2024("ts")
    base = events.select(
        F.col("user_id").cast("string").alias("doc_id"),
        F.col("event_id"),
        start.alias("start_ms"),
        (start + F.floor(F.col("value") * ms_per_unit)).alias("end_ms"),
        F.concat("event_type", F.lit(" "), "props").alias("text"),
    )
    scrambled = F.col("event_id") * 7919 % 10007
    thousand = F.floor(F.col("event_id") / 1000)
    if shuffled:
        base = base.withColumn("thousand", thousand).withColumn("scrambled", scrambled)
        order = ["thousand", "scrambled", "event_id"]
    else:
        order = ["event_id"]
    ranked = dense_position(
        base, ["doc_id"], order, F.floor(F.col("event_id") / EVENT_BUCKET)
    )
    return ranked.select(
        "doc_id", "pos", (F.col("pos") + 1).alias("idx"), "start_ms", "end_ms", "text"
    )


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the documents: (doc_id, pos, text, lang, source), without a shuffle."""
    docs = documents(spark, folder)
    return docs.select(
        F.col("doc_id").alias("doc_no"), "lang", "source",
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"),
    ).withColumn("pos", F.col("pos").cast("long"))


def line_times() -> tuple[Column, Column]:
    """Start and end of line `pos` of document `doc_no`."""
    start = F.col("pos") * 2500 + (F.col("doc_no") * 31 + F.col("pos") * 17) % 300
    return start, start + 300 + (F.col("doc_no") * 13 + F.col("pos") * 1237) % 4000


def document_segments(spark: SparkSession, folder: str) -> DataFrame:
    start, end = line_times()
    return document_lines(spark, folder).select(
        F.col("doc_no").cast("string").alias("doc_id"), "pos", (F.col("pos") + 1).alias("idx"),
        start.alias("start_ms"), end.alias("end_ms"), "text", "lang",
    )


def source_segments(spark: SparkSession, folder: str) -> DataFrame:
    """One document per source: the lines of its documents in order.

    Offsets come from line counts of whole documents, so the lines themselves are not shuffled.
    """
    docs = documents(spark, folder).select(
        F.col("source").alias("doc_id"), F.col("doc_id").alias("doc_no"),
        F.split("text", "\n", -1).alias("lines"),
    )
    placed = running_sum(
        docs, ["doc_id"], ["doc_no"], F.size("lines"), "first",
        F.floor(F.col("doc_no") / DOC_BUCKET), exclusive=True,
    )
    lines = placed.select("doc_id", "first", F.posexplode("lines").alias("i", "text"))
    pos = F.col("first") + F.col("i")
    return lines.select(
        "doc_id", pos.alias("pos"), (pos + 1).alias("idx"),
        (pos * 2000).alias("start_ms"), (pos * 2000 + 1800).alias("end_ms"), "text",
    )


def conversation_segments(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    start = F.col("turn") * 4000
    return turns.select(
        F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("pos"),
        (F.col("turn") + 1).alias("idx"), start.alias("start_ms"),
        (start + 500 + (F.col("conv_id") * 7 + F.col("turn") * 911) % 5000).alias("end_ms"),
        "text",
    )


def order_knowledge(spark: SparkSession, folder: str, orders: DataFrame | None = None) -> DataFrame:
    """Correction occurrences from orders: wrong, correct, topic, industry, country, seq."""
    orders = table(spark, folder, "orders") if orders is None else orders
    customers = table(spark, folder, "customer")
    nations = table(spark, folder, "nation")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.select(
        F.col("o_orderpriority").alias("wrong_term"),
        F.col("o_orderstatus").alias("correct_term"),
        F.col("c_mktsegment").alias("topic"),
        F.lit("general").alias("industry"),
        F.when(F.col("n_nationkey") % 5 == 0, F.lit("general"))
        .otherwise(F.col("n_name")).alias("country"),
        F.col("o_orderkey").alias("seq"),
    )


def knowledge_table(spark: SparkSession, folder: str) -> DataFrame:
    """KB rows from orders; the id is the first order that taught the row."""
    return (
        order_knowledge(spark, folder)
        .groupBy("wrong_term", "correct_term", "topic", "industry", "country")
        .agg(F.min("seq").alias("id"), F.count("*").alias("count"))
        .withColumn("tags", F.array().cast("array<string>"))
        .withColumn("confidence", F.lit(1.0))
    )


def customer_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """One context per customer."""
    customers = table(spark, folder, "customer")
    nations = table(spark, folder, "nation")
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").cast("string").alias("doc_id"),
        F.lower("c_mktsegment").alias("topic"), F.lit("retail").alias("industry"),
        F.upper("n_name").alias("country"),
    )


def supplier_history(spark: SparkSession, folder: str) -> DataFrame:
    """Correction history from line items: tenant, correction, outcome, time."""
    items = table(spark, folder, "lineitem")
    return items.select(
        F.col("l_suppkey").cast("string").alias("tenant_id"),
        F.col("l_partkey").alias("correction_id"),
        F.when(F.col("l_returnflag") == "N", F.lit(None))
        .otherwise(F.col("l_returnflag") == "A").alias("was_successful"),
        F.col("l_shipdate").alias("applied_at"),
    )


# The same views for DuckDB, as named subqueries.
SQL_VIEWS = {
    "seg_short": """seg AS (
  SELECT CAST(user_id AS VARCHAR) AS doc_id,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx,
    epoch_us(ts) // 1000 - 1704067200000 AS start_ms,
    epoch_us(ts) // 1000 - 1704067200000 + CAST(floor(value * 100) AS BIGINT) AS end_ms,
    event_type || ' ' || props AS text
  FROM events)""",
    "seg_long": """seg AS (
  SELECT CAST(user_id AS VARCHAR) AS doc_id,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx,
    epoch_us(ts) // 1000 - 1704067200000 AS start_ms,
    epoch_us(ts) // 1000 - 1704067200000 + CAST(floor(value * 600000) AS BIGINT) AS end_ms,
    event_type || ' ' || props AS text
  FROM events)""",
    "seg_shuffled": """seg AS (
  SELECT CAST(user_id AS VARCHAR) AS doc_id,
    row_number() OVER (PARTITION BY user_id
      ORDER BY event_id // 1000, event_id * 7919 % 10007, event_id) - 1 AS pos,
    row_number() OVER (PARTITION BY user_id
      ORDER BY event_id // 1000, event_id * 7919 % 10007, event_id) AS idx,
    epoch_us(ts) // 1000 - 1704067200000 AS start_ms,
    epoch_us(ts) // 1000 - 1704067200000 + CAST(floor(value * 100) AS BIGINT) AS end_ms,
    event_type || ' ' || props AS text
  FROM events)""",
    "seg_docs": """doc_lines AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents),
seg_start AS (
  SELECT doc_id AS doc_no, pos, text, lang, source,
    pos * 2500 + (doc_id * 31 + pos * 17) % 300 AS start_ms
  FROM doc_lines),
seg AS (
  SELECT CAST(doc_no AS VARCHAR) AS doc_id, pos, pos + 1 AS idx, start_ms,
    start_ms + 300 + (doc_no * 13 + pos * 1237) % 4000 AS end_ms, text, lang
  FROM seg_start)""",
    "seg_source": """doc_lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text,
    generate_subscripts(string_split(text, chr(10)), 1) AS line
  FROM documents),
src_lines AS (
  SELECT source AS doc_id, text,
    row_number() OVER (PARTITION BY source ORDER BY doc_id, line) - 1 AS pos
  FROM doc_lines),
seg AS (
  SELECT doc_id, pos, pos + 1 AS idx, pos * 2000 AS start_ms, pos * 2000 + 1800 AS end_ms, text
  FROM src_lines)""",
    "seg_convs": """seg AS (
  SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn AS pos, turn + 1 AS idx,
    turn * 4000 AS start_ms,
    turn * 4000 + 500 + (conv_id * 7 + turn * 911) % 5000 AS end_ms, text
  FROM conversations)""",
    "learned": """learned AS (
  SELECT o_orderpriority AS wrong_term, o_orderstatus AS correct_term, c_mktsegment AS topic,
    'general' AS industry,
    CASE WHEN n_nationkey % 5 = 0 THEN 'general' ELSE n_name END AS country,
    o_orderkey AS seq
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "kb": """kb AS (
  SELECT wrong_term, correct_term, topic, industry, country, min(seq) AS id, count(*) AS cnt
  FROM learned GROUP BY ALL)""",
    "contexts": """contexts AS (
  SELECT CAST(c_custkey AS VARCHAR) AS doc_id, lower(c_mktsegment) AS topic,
    'retail' AS industry, upper(n_name) AS country
  FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "history": """history AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS tenant_id, l_partkey AS correction_id,
    CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag = 'A' END AS was_successful,
    l_shipdate AS applied_at
  FROM lineitem)""",
}


def with_views(*names: str) -> str:
    """`WITH …` prefix that defines the named views."""
    return "WITH " + ",\n".join(SQL_VIEWS[n] for n in names)


def nonblank(segments: DataFrame) -> DataFrame:
    return segments.where(strip(F.col("text")) != "")
