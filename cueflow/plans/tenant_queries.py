"""Queries over tenant memory, correction candidates and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueflow import constants as K
from cueflow.functions.skew import deal
from cueflow.operators import candidates as C
from cueflow.operators import tenant as T
from cueflow.plans.registry import query
from cueflow.plans.source_queries import srt_corpus
from cueflow.session import scratch_path, settle
from cueflow.sources import adapters as A
from cueflow.sources import files
from cueflow.sources.adapters import with_views
from cueflow.streaming import jobs


@query("d01_confidence_bands", """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_discount * 10 < 0.5 THEN 'low' WHEN l_discount * 10 < 0.75 THEN 'medium'
    WHEN l_discount * 10 < 0.9 THEN 'high' WHEN l_discount * 10 <= 1 THEN 'very_high' END AS band
FROM lineitem""")
def d01_confidence_bands(spark, folder):
    items = A.table(spark, folder, "lineitem")
    return items.select(
        "l_orderkey", "l_linenumber", T.confidence_band(F.col("l_discount") * 10).alias("band")
    )


@query("d02_outcome_stats", f"""{with_views('history')}
SELECT tenant_id, correction_id, count(*) AS usage_count,
  count(*) FILTER (was_successful) AS success_count,
  CAST(count(*) FILTER (was_successful) AS DOUBLE) / count(*) AS success_rate,
  max(applied_at) AS last_used_at
FROM history GROUP BY ALL""")
def d02_outcome_stats(spark, folder):
    return T.outcome_stats(A.supplier_history(spark, folder))


def part_corrections(spark, folder):
    """A correction per (supplier, part) from line items: brand to type.

    Hardly a pair occurs twice in a task, so aggregating ahead of the shuffle would only fill memory.
    Dealt out by tenant and text, corrections are where lookups and contexts rank them.
    """
    items, parts = A.table(spark, folder, "lineitem"), A.table(spark, folder, "part")
    uses = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").cast("string").alias("tenant_id"), F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("original_text"), F.col("p_type").alias("corrected_text"), "l_discount",
    )
    return deal(uses, "tenant_id", "original_text").groupBy(
        "tenant_id", "id", "original_text", "corrected_text"
    ).agg((F.max("l_discount") * 10).alias("confidence"))


_CORRECTIONS = """corrections AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS tenant_id, p_partkey AS id, p_brand AS original_text,
    p_type AS corrected_text, max(l_discount) * 10 AS confidence
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
outcomes AS (SELECT tenant_id, correction_id AS id,
  CAST(count(*) FILTER (was_successful) AS DOUBLE) / count(*) AS success_rate
  FROM history GROUP BY ALL)"""


@query("d03_tenant_lookup", f"""{with_views('history')},
{_CORRECTIONS}
SELECT tenant_id, original_text, c.id, corrected_text, confidence
FROM corrections c LEFT JOIN outcomes o USING (tenant_id, id)
QUALIFY row_number() OVER (PARTITION BY tenant_id, original_text
  ORDER BY confidence DESC, coalesce(success_rate, 0) DESC, c.id) = 1""")
def d03_tenant_lookup(spark, folder):
    corrections = T.with_outcomes(
        part_corrections(spark, folder), A.supplier_history(spark, folder)
    )
    lookups = corrections.select("tenant_id", "original_text").distinct()
    return T.best_tenant_corrections(corrections, lookups)


@query("d04_tenant_context", f"""WITH {_CORRECTIONS.split('outcomes AS')[0].rstrip().rstrip(',')}
SELECT tenant_id, entity_type, id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT tenant_id, original_text AS entity_type, id, row_number() OVER (
    PARTITION BY tenant_id, original_text ORDER BY confidence DESC, id) AS rank FROM corrections)
WHERE rank <= 3""")
def d04_tenant_context(spark, folder):
    entities = part_corrections(spark, folder).select(
        "tenant_id", "id", F.col("original_text").alias("entity_type"),
        F.col("corrected_text").alias("entity_text"), F.col("confidence").alias("authority_score"),
    )
    return T.top_context(entities, 3).select("tenant_id", "entity_type", "id", "rank")


@query("d05_daily_history", """SELECT CAST(user_id AS VARCHAR) AS tenant_id,
  date_trunc('day', ts) AS window_start, count(*) AS applied,
  count(*) FILTER (event_type = 'purchase') AS successful
FROM events GROUP BY ALL""")
def d05_daily_history(spark, folder):
    events = A.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("tenant_id"),
        (F.col("event_type") == "purchase").alias("was_successful"),
        F.col("ts").alias("applied_at"),
    )
    daily = T.daily_history(events)
    return daily.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_WORDS = """counts AS (SELECT word, count(*) AS uses FROM (
  SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}\\p{M}_]+')) AS word
  FROM documents) WHERE word <> '' GROUP BY word)"""


@query("d11_vocabulary", f"""WITH {_WORDS}
SELECT word, uses FROM counts WHERE uses >= 2 AND length(word) BETWEEN 3 AND 40""")
def d11_vocabulary(spark, folder):
    return C.vocabulary(C.token_counts(A.documents(spark, folder)))


@query("d12_edit_neighbours")
def d12_edit_neighbours(spark, folder):
    counts = settle(C.token_counts(A.documents(spark, folder)), "words")
    return C.edit_neighbours(C.unknown_words(counts), C.vocabulary(counts))


@query("d12_name_neighbours", """WITH words AS (
  SELECT DISTINCT lower(p_name) AS word FROM part),
counts AS (SELECT word, count(*) OVER (PARTITION BY substr(word, 1, 5)) AS uses FROM words),
pairs AS (SELECT a.word, b.word AS candidate, b.uses AS candidate_uses,
  CAST(levenshtein(a.word, b.word) AS INTEGER) AS distance
  FROM counts a JOIN counts b ON abs(length(a.word) - length(b.word)) <= 2 AND a.word <> b.word
  WHERE levenshtein(a.word, b.word) <= 2)
SELECT word, candidate, candidate_uses, distance, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, candidate_uses DESC, candidate)
    AS rank FROM pairs) WHERE rank <= 12""")
def d12_name_neighbours(spark, folder):
    """Part names that are at most two edits apart."""
    words = A.table(spark, folder, "part").select(F.lower("p_name").alias("word")).distinct()
    sizes = words.groupBy(F.substring("word", 1, 5).alias("head")).agg(F.count("*").alias("uses"))
    counts = words.withColumn("head", F.substring("word", 1, 5)).join(sizes, "head").drop("head")
    near = C.edit_neighbours(counts, counts, top=K.EDIT_TOP + 1)
    from pyspark.sql.window import Window

    order = Window.partitionBy("word").orderBy("distance", F.desc("candidate_uses"), "candidate")
    others = near.where(F.col("word") != F.col("candidate"))
    return others.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= K.EDIT_TOP)


@query("d13_edit_gate", """WITH edits AS (SELECT doc_id, pos, line AS before,
  replace(replace(line, 'the', 'teh'), 'en', 'n') AS after FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents))
SELECT CAST(doc_id AS VARCHAR) AS doc_id, pos, CAST(levenshtein(before, after) AS DOUBLE)
  / greatest(length(before), length(after), 1) <= 0.15 AND levenshtein(before, after) <= 8 AS pass1,
  CAST(levenshtein(before, after) AS DOUBLE)
  / greatest(length(before), length(after), 1) <= 0.3 AND levenshtein(before, after) <= 8 AS pass2
FROM edits""")
def d13_edit_gate(spark, folder):
    """Lines against an edited copy."""
    lines = A.document_lines(spark, folder)
    after = F.replace(F.col("text"), F.lit("the"), F.lit("teh"))
    after = F.replace(after, F.lit("en"), F.lit("n"))
    return lines.select(
        F.col("doc_no").cast("string").alias("doc_id"), "pos",
        C.passes_edit_gate(F.col("text"), after, K.EDIT_RATIO_PASS1).alias("pass1"),
        C.passes_edit_gate(F.col("text"), after, K.EDIT_RATIO_PASS2).alias("pass2"),
    )


_GUARDS_SQL = {
    kind: pattern.replace("\\u20ac", "\\x{20ac}").replace("\\u00a3", "\\x{a3}")
    for kind, pattern in C.GUARDS.items()
}
_GUARD_SQL = ", ".join(
    f"CAST(len(regexp_extract_all(text, '{pattern}')) AS INTEGER) AS {kind}_spans"
    for kind, pattern in _GUARDS_SQL.items()
)
# A place of the term overlaps a span just when the span with all but one character of the term's
# length on either side holds the term.
_TOUCHED_SQL = " UNION ".join(f"""SELECT doc_id FROM (
  SELECT *, CAST(sum(length(gap) + length(span)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT)
    - length(span) AS b
  FROM (SELECT doc_id, text, term, unnest(regexp_extract_all(text, '{pattern}')) AS span,
    unnest(list_slice(g, 1, len(g) - 1)) AS gap,
    generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) AS i
    FROM (SELECT *, string_split_regex(text, '{pattern}') AS g FROM proposed)))
  WHERE contains(substr(text, greatest(b - length(term) + 2, 1),
    b + length(span) + length(term) - greatest(b - length(term) + 2, 1)), term)"""
    for pattern in _GUARDS_SQL.values())


@query("d14_guard_spans", f"SELECT doc_id, {_GUARD_SQL} FROM documents")
def d14_guard_spans(spark, folder):
    docs = A.documents(spark, folder)
    return docs.select("doc_id", *C.guard_counts(F.col("text")))


@query("d14_unguarded_proposals", f"""WITH proposed AS (
  SELECT doc_id, text, substr(text, length(text) // 2 + 1, 8) AS term FROM documents
  WHERE text IS NOT NULL),
touched AS ({_TOUCHED_SQL})
SELECT doc_id, term AS original_text FROM proposed WHERE doc_id NOT IN (SELECT doc_id FROM touched)""")
def d14_unguarded_proposals(spark, folder):
    """Of one proposal per document, its middle eight characters, those that touch no guard."""
    text = F.col("text")
    middle = F.substr(text, (F.length(text) / 2).cast("int") + 1, F.lit(8))
    proposed = A.documents(spark, folder).select("doc_id", "text", middle.alias("original_text"))
    return C.unguarded_proposals(proposed).select("doc_id", "original_text")


@query("d15_context_neighbours", """WITH v AS (
  SELECT CAST(label AS VARCHAR) AS doc_id, vec_id AS pos, CAST(embedding AS DOUBLE[]) AS e
  FROM embeddings),
pairs AS (SELECT a.doc_id, a.pos, b.pos AS neighbour, list_cosine_similarity(a.e, b.e) AS sim
  FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.pos <> b.pos),
scored AS (SELECT *, 0.7::DOUBLE * sim + (1 - 0.7::DOUBLE) * exp(-abs(pos - neighbour) / 7.0::DOUBLE)
  AS score FROM pairs WHERE sim >= 0.1)
SELECT doc_id, pos, neighbour, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY score DESC, neighbour) AS rank
  FROM scored) WHERE rank <= 8""")
def d15_context_neighbours(spark, folder):
    vectors = A.table(spark, folder, "embeddings").select(
        F.col("label").cast("string").alias("doc_id"), F.col("vec_id").alias("pos"),
        F.col("embedding").alias("vector"),
    )
    # no two vectors of a label here reach the default floor
    near = C.context_neighbours(vectors, floor=0.1)
    return near.withColumn("score", F.round("score", 6))


_PROFILE = "aeiounrstlhd"


@query("d15_line_neighbours", f"""WITH lines AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, lower(unnest(string_split(text, chr(10)))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
v AS (SELECT doc_id, pos, [{', '.join(
    f"CAST(length(line) - length(replace(line, '{c}', '')) AS DOUBLE) + 0.13::DOUBLE" for c in _PROFILE)}] AS e
  FROM lines),
pairs AS (SELECT a.doc_id, a.pos, b.pos AS neighbour, list_cosine_similarity(a.e, b.e) AS sim
  FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.pos <> b.pos),
scored AS (SELECT *, 0.7::DOUBLE * sim + (1 - 0.7::DOUBLE) * exp(-abs(pos - neighbour) / 7.0::DOUBLE)
  AS score FROM pairs WHERE sim >= 0.5)
SELECT doc_id, pos, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY score DESC, neighbour) AS rank
  FROM scored) WHERE rank <= 8""")
def d15_line_neighbours(spark, folder):
    """Lines by how often they have each of twelve letters, with the default floor.

    The neighbour itself is left out: lines with equal counts tie but for rounding. So is a cosine
    of just the floor, by the small share that every letter has.
    """
    line = F.lower("text")
    counts = [(F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).cast("double")
              + F.lit(0.13) for c in _PROFILE]
    vectors = A.document_lines(spark, folder).select(
        F.col("doc_no").cast("string").alias("doc_id"), "pos", F.array(*counts).alias("vector"))
    near = C.context_neighbours(vectors)
    return near.select("doc_id", "pos", "rank", F.round("score", 6).alias("score"))


@query("d16_candidate_ranking", """WITH f AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc_id,
  l_partkey % 7 AS pos, 'part ' || l_partkey || '/' || l_linenumber AS candidate,
  1 / (1 + exp(-(-0.4::DOUBLE + 0.7::DOUBLE * (l_quantity / 10) + -1.0::DOUBLE * (l_tax * 10)
    + 0.15::DOUBLE * (CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
    + 0.12::DOUBLE * (l_discount * 10)
    + -2.0::DOUBLE * (CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)))) AS score
  FROM lineitem)
SELECT doc_id, pos, candidate, round(score, 6) AS score FROM f
QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY score DESC, candidate) = 1
  AND score >= 0.75""")
def d16_candidate_ranking(spark, folder):
    items = A.table(spark, folder, "lineitem")
    score = C.linear_score({
        "delta_logp": F.col("l_quantity") / 10,
        "edit_penalty": F.col("l_tax") * 10,
        "vocab_support": F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0),
        "neighbor_support": F.col("l_discount") * 10,
        "locked_penalty": F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0),
    })
    scored = items.select(
        F.col("l_orderkey").cast("string").alias("doc_id"),
        (F.col("l_partkey") % 7).alias("pos"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit("/"),
                 F.col("l_linenumber").cast("string")).alias("candidate"),
        score.alias("score"),
    )
    best = C.best_candidates(scored, K.RANK_THRESHOLD_PASS1)
    return best.withColumn("score", F.round("score", 6))


_X1_SQL = f"""{with_views('seg_docs')},
parsed AS (SELECT doc_id, pos, start_ms, end_ms, trim(text, ' ' || chr(9) || chr(160)) AS text
  FROM seg WHERE (CAST(doc_id AS BIGINT) + pos) % 13 > 2 AND trim(text) <> ''),
timed AS (SELECT *, end_ms - start_ms AS dur,
  length(text) / (CAST(end_ms - start_ms AS DOUBLE) / 1000.0::DOUBLE) AS cps FROM parsed),
found AS (
  SELECT 'duration_too_short' AS issue_type FROM timed WHERE dur < 500
  UNION ALL SELECT 'duration_short' FROM timed WHERE dur >= 500 AND dur < 1500
  UNION ALL SELECT 'cps_too_high' FROM timed WHERE cps > 25
  UNION ALL SELECT 'cps_high' FROM timed WHERE cps > 17 AND cps <= 25
  UNION ALL SELECT 'line_too_long' FROM timed WHERE length(text) > 80
  UNION ALL SELECT 'line_long' FROM timed WHERE length(text) > 42 AND length(text) <= 80)
SELECT issue_type, count(*) AS issues FROM found GROUP BY issue_type"""


@query("x01_arriving_files", _X1_SQL)
def x01_arriving_files(spark, folder):
    """The documents as a packed corpus, streamed from the shared folder and checked."""
    inbox, outbox = scratch_path(spark, "inbox"), scratch_path(spark, "issues")
    docs = srt_corpus(spark, folder).select(
        F.concat("doc_id", F.lit(".srt")).alias("name"), F.lit(0).alias("part_no"), "content"
    )
    files.pack_corpus(docs, inbox)
    jobs.run_available(jobs.arriving_issues(spark, inbox, packed=True), outbox, scratch_path(spark, "progress"))
    return spark.read.parquet(outbox).groupBy("issue_type").agg(F.count("*").alias("issues"))


@query("x01_file_reports", f"""{with_views('seg_docs')},
parsed AS (SELECT doc_id, pos, start_ms, end_ms, trim(text, ' ' || chr(9) || chr(160)) AS text
  FROM seg WHERE (CAST(doc_id AS BIGINT) + pos) % 13 > 2 AND trim(text) <> ''),
named AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(doc_id AS VARCHAR) || ': a %.srt' AS name
    FROM documents
  UNION ALL SELECT 'e' || doc_id, 'e' || doc_id || ': a %.srt' FROM documents)
SELECT name, count(pos) AS segment_count, coalesce(arg_max(end_ms, pos), 0) AS total_duration_ms,
  CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS total_characters
FROM named LEFT JOIN parsed USING (doc_id) GROUP BY name""")
def x01_file_reports(spark, folder):
    """Reports of streamed files: each document, and for each one more file without a cue."""
    inbox, outbox = scratch_path(spark, "inbox"), scratch_path(spark, "reports")
    docs = srt_corpus(spark, folder).select("doc_id", "content")
    junk = docs.select(F.concat(F.lit("e"), "doc_id").alias("doc_id"), F.lit("no cue").alias("content"))
    named = docs.unionByName(junk).select(
        F.concat("doc_id", F.lit(": a %.srt")).alias("name"), F.lit(0).alias("part_no"), "content")
    files.pack_corpus(named, inbox)
    jobs.report_per_batch(spark, inbox, outbox, scratch_path(spark, "progress"), packed=True)
    return spark.read.parquet(outbox).select(
        F.col("doc_id").alias("name"), "segment_count", "total_duration_ms",
        F.coalesce("total_characters", F.lit(0)).alias("total_characters"))


@query("x02_arriving_corrections", """SELECT event_type AS wrong_term, props AS correct_term,
  count(*) AS count FROM events GROUP BY ALL""")
def x02_arriving_corrections(spark, folder):
    """Events streamed as approved pairs and folded into KB versions."""
    schema = A.table(spark, folder, "events").schema
    arrived = spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/events.parquet*")
    general = F.lit("general")
    pairs = arrived.select(
        F.col("event_type").alias("wrong_term"), F.col("props").alias("correct_term"),
        general.alias("topic"), general.alias("industry"), general.alias("country"),
        F.array().cast("array<string>").alias("tags"), F.col("event_id").alias("seq"),
    )
    empty = spark.createDataFrame(
        [], "id long, wrong_term string, correct_term string, topic string, industry string, "
        "country string, tags array<string>, confidence double, count long",
    )
    path = scratch_path(spark, "knowledge")
    done = jobs.knowledge_versions(pairs, empty, path, scratch_path(spark, "progress"))
    from cueflow.sources.knowledge_store import read_version

    batches = done.lastProgress["batchId"] + 1 if done.lastProgress else 0
    return read_version(spark, path, batches).select("wrong_term", "correct_term", "count")


@query("x03_outcome_windows", f"""{with_views('history')}
SELECT tenant_id, date_trunc('day', applied_at) AS window_start, count(*) AS applied,
  count(*) FILTER (was_successful) AS successful
FROM history GROUP BY ALL""")
def x03_outcome_windows(spark, folder):
    """Line items streamed as the log of applied corrections, all windows.

    Line items do not come in order of time, so rows of any age within the log are let in.
    """
    schema = A.table(spark, folder, "lineitem").schema
    items = spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/lineitem.parquet*")
    log = items.select(
        F.col("l_suppkey").cast("string").alias("tenant_id"),
        F.col("l_partkey").alias("correction_id"),
        F.when(F.col("l_returnflag") == "N", F.lit(None))
        .otherwise(F.col("l_returnflag") == "A").alias("was_successful"),
        F.col("l_shipdate").alias("applied_at"),
    )
    output = scratch_path(spark, "windows")
    jobs.run_outcome_windows(log, output, scratch_path(spark, "progress"), lateness="5000 days")
    return jobs.read_outcome_windows(spark, output).withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz"))
