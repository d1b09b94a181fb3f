"""The registered queries: each applies its operator to the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueflow.llm import byte_bpe, language_id, quality, suffix_dedup, winnowing
from cueflow.llm.exact_dedup import exact_groups
from cueflow.llm.lm_scoring import train_and_score
from cueflow.llm.minhash import near_copies
from cueflow.llm.packing import pack
from cueflow.llm.ranked_search import best_documents, build_index
from cueflow.llm.registry import query, table
from cueflow.llm.simhash import near_groups
from cueflow.llm.url_rules import judge_urls
from cueflow.llm.whitening import whiten
from cueflow.session import settle

def remainder(id_col: str, divisor: int) -> F.Column:
    """crc32 of the id as text, modulo `divisor`; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(divisor))


OP1_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), g AS (
  SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
FROM t JOIN g USING (text)
"""


@query("op1_exact_dedup", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn(
        "text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact_groups(docs, carry=("text_sha256",)).drop("full_hash")


@query("op2_winnowing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    rows = winnowing.edited_likeness(table(spark, folder, "documents"))
    mine, edited = (winnowing.hashes(F.col(c)) for c in ("kept", "edited_kept"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        winnowing.rendered(F.col("kept")).alias("fingerprint"),
        winnowing.rendered(F.col("edited_kept")).alias("edited_fingerprint"),
        winnowing.likeness(mine, edited).alias("near_edited"),
        winnowing.likeness(mine, F.col("next_hashes")).alias("near_next"))


@query("op3_byte_bpe")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.encode(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN, digest=True,
    ).withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


@query("op4_lm_scoring")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return train_and_score(docs.withColumn("held_out", remainder("doc_id", 7) == 2), "held_out")


@query("op5_language_id")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    model = language_id.train(docs.filter(~F.col("held_out")))
    return language_id.identify(docs, model, keep=["doc_id", "held_out"])


def spans_as_text(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")


@query("op6_suffix_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    passages = suffix_dedup.repeated_passages(docs)
    named = docs.select("doc_id", suffix_dedup.document_key().alias("doc"))
    return named.join(passages, "doc").select(
        "doc_id", suffix_dedup.words_of(F.col("spans")).alias("repeated_words"),
        suffix_dedup.words_of(F.col("gone")).alias("gone_words"),
        spans_as_text(F.col("spans")).alias("spans"), spans_as_text(F.col("gone")).alias("gone"),
        F.col("partners").alias("partner_ids"))


@query("op7_quality")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]

OP8_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://')
    THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), hosted AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut
), parsed AS (
  SELECT page_id,
    translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM hosted
), rules(rule_host, rule_path, ruling) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT page_id,
    max_by(struct_pack(rule := rule_host || rule_path, ruling := ruling),
           length(rule_host || rule_path)) AS b
  FROM parsed JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.ruling, 'allow') AS verdict
FROM parsed LEFT JOIN best USING (page_id)
"""


@query("op8_url_rules", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, folder, "pages").select("page_id", "url"), rules).drop("url")


@query("op9_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return pack(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN, with_ids=False)


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(table(spark, folder, "documents"))


OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s
  FROM w
), flat AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM s
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT doc_id, CAST(len(any_value(s)) AS BIGINT) AS n_shingles, min(y) AS component_id,
  doc_id = min(y) AS kept
FROM s JOIN reach ON doc_id = x GROUP BY doc_id
"""


@query("op11_minhash_near_dedup", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(table(spark, folder, "documents").select("doc_id", "text"))


@query("op12_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), total AS (
  SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0
), norm AS (
  SELECT doc_id, 100 - 50 + ((50 * len(w) * docs) // terms) AS m FROM d, total WHERE len(w) > 0
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM tf, total GROUP BY term, docs
), scored AS (
  SELECT item_id, doc_id,
    CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN weight USING (term) JOIN norm USING (doc_id)
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (
    PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@query("op13_ranked_search", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    index = settle(build_index(docs), "search-index")
    return best_documents(index, table(spark, folder, "benchmark"))
