"""Queries over the knowledge base."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueflow import constants as K
from cueflow.operators import knowledge as KB
from cueflow.plans.registry import query
from cueflow.sources import adapters as A
from cueflow.sources.adapters import with_views

_KEYS = "wrong_term, correct_term, topic, industry, country"


def _halves(spark, folder):
    """A KB from the orders with even keys, and the occurrences of the odd ones."""
    learned = A.order_knowledge(spark, folder)
    kb = (
        learned.where(F.col("seq") % 2 == 0).groupBy(*KB.KEY)
        .agg(F.min("seq").alias("id"), F.count("*").alias("count"))
        .withColumn("tags", F.array(F.lit("first")))
        .withColumn("confidence", F.lit(0.5))
    )
    batch = learned.where(F.col("seq") % 2 == 1).withColumn(
        "tags", F.array(F.concat(F.lit("order"), F.col("seq").cast("string")))
    )
    return kb, batch


@query("a03_knowledge_upsert", f"""{with_views('learned')},
kb AS (SELECT {_KEYS}, min(seq) AS id, count(*) AS n FROM learned WHERE seq % 2 = 0 GROUP BY ALL),
fresh AS (SELECT {_KEYS}, min(seq) AS first_seq, count(*) AS n FROM learned WHERE seq % 2 = 1
  GROUP BY ALL),
merged AS (SELECT kb.id, wrong_term, correct_term, topic, industry, country, first_seq,
  coalesce(kb.n, 0) + coalesce(fresh.n, 0) AS count
  FROM kb FULL OUTER JOIN fresh USING ({_KEYS}))
SELECT coalesce(id, (SELECT max(id) FROM kb) + row_number() OVER (PARTITION BY id IS NULL
    ORDER BY first_seq)) AS id, wrong_term, correct_term, topic, industry, country,
  CASE WHEN id IS NULL THEN ['order' || first_seq] ELSE ['first'] END AS tags,
  CASE WHEN id IS NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence, count
FROM merged""")
def a03_knowledge_upsert(spark, folder):
    kb, batch = _halves(spark, folder)
    return KB.upsert(kb, batch)


@query("p02_remove_entries", f"""{with_views('learned', 'kb')}
SELECT id, wrong_term, correct_term, cnt AS count FROM kb WHERE id % 7 <> 3""")
def p02_remove_entries(spark, folder):
    kb = A.knowledge_table(spark, folder)
    bad = kb.where(F.col("id") % 7 == 3).select("id")
    return KB.remove_entries(kb, bad).select("id", "wrong_term", "correct_term", "count")


@query("u03_key_removal", f"""{with_views('learned', 'kb')}
SELECT topic, country, count(*) AS entries FROM kb
WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL""")
def u03_key_removal(spark, folder):
    kb = A.knowledge_table(spark, folder)
    closed = A.table(spark, folder, "orders").where("o_orderstatus = 'F'")
    kept = KB.remove_entries(kb, closed.select(F.col("o_orderkey").alias("id")))
    return kept.groupBy("topic", "country").agg(F.count("*").alias("entries"))


_SCORE = """2.0 * (lower(kb.country) = lower(c.country))::INT
  + 1.0 * (lower(kb.topic) = lower(c.topic))::INT
  + 1.0 * (lower(kb.industry) = lower(c.industry))::INT
  + 0.5 * (kb.country = 'general')::INT"""


@query("j02_relevant_entries", f"""{with_views('learned', 'kb', 'contexts')},
c AS (SELECT DISTINCT topic, industry, country FROM contexts)
SELECT c.topic, c.industry, c.country, kb.id, CAST({_SCORE} AS DOUBLE) AS score
FROM kb, c WHERE {_SCORE} > 0""")
def j02_relevant_entries(spark, folder):
    contexts = A.customer_contexts(spark, folder)
    return KB.relevant_entries(A.knowledge_table(spark, folder), contexts)


@query("j02_relevance_classes", f"""{with_views('learned', 'kb', 'contexts')},
c AS (SELECT DISTINCT topic, industry, country FROM contexts)
SELECT c.topic, c.industry, c.country,
  coalesce(lower(kb.country) = lower(c.country), false)::INT
  + 2 * coalesce(lower(kb.topic) = lower(c.topic), false)::INT
  + 4 * coalesce(lower(kb.industry) = lower(c.industry), false)::INT AS mask,
  kb.country = 'general' AS is_general, CAST({_SCORE} AS DOUBLE) AS score, count(*) AS entries
FROM kb, c WHERE {_SCORE} > 0 GROUP BY ALL""")
def j02_relevance_classes(spark, folder):
    return KB.relevance_classes(
        A.knowledge_table(spark, folder), A.customer_contexts(spark, folder))


@query("t01_top_entries", f"""{with_views('learned', 'kb', 'contexts')},
c AS (SELECT DISTINCT topic, industry, country FROM contexts),
ranked AS (SELECT c.topic, c.industry, c.country, kb.id, wrong_term, correct_term,
  row_number() OVER (PARTITION BY c.topic, c.industry, c.country ORDER BY wrong_term, id) AS rank
  FROM kb, c WHERE {_SCORE} > 0)
SELECT topic, industry, country, string_agg('- ' || wrong_term || ' -> ' || correct_term, chr(10)
  ORDER BY rank) AS kb_lines
FROM ranked WHERE rank <= 50 GROUP BY ALL""")
def t01_top_entries(spark, folder):
    contexts = A.customer_contexts(spark, folder)
    return KB.entry_lines(KB.top_entries(A.knowledge_table(spark, folder), contexts))


def _lookups(spark, folder):
    """Each customer asks for the priority of each of its orders in its own context."""
    orders = A.table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("doc_id"),
        F.when(F.col("o_orderkey") % 50 == 7, F.lit("unheard of"))
        .otherwise(F.col("o_orderpriority")).alias("term"),
    ).distinct()
    return orders.join(A.customer_contexts(spark, folder), "doc_id")


_BEST_SQL = f"""{with_views('learned', 'kb', 'contexts')},
asked AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS doc_id,
  CASE WHEN o_orderkey % 50 = 7 THEN 'unheard of' ELSE o_orderpriority END AS term FROM orders),
lookups AS (SELECT * FROM asked JOIN contexts USING (doc_id)),
terms AS (SELECT DISTINCT term, topic, industry, country FROM lookups),
scored AS (SELECT t.*, kb.correct_term,
  100 * (lower(kb.country) = lower(t.country) AND lower(kb.country) <> 'general')::INT
  + 50 * (lower(kb.topic) = lower(t.topic) AND lower(kb.topic) <> 'general')::INT
  + 50 * (lower(kb.industry) = lower(t.industry) AND lower(kb.industry) <> 'general')::INT
  + least(cnt, 10) AS tenths, kb.topic AS kt, kb.industry AS ki, kb.country AS kc
  FROM terms t JOIN kb ON kb.wrong_term = t.term),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY term, topic, industry, country
  ORDER BY tenths DESC, correct_term, kt, ki, kc) = 1)"""


@query("j03_best_correction", f"""{_BEST_SQL}
SELECT l.doc_id, l.term, b.correct_term, CAST(b.tenths AS BIGINT) AS score_tenths
FROM lookups l LEFT JOIN best b USING (term, topic, industry, country)""")
def j03_best_correction(spark, folder):
    kb = A.knowledge_table(spark, folder)
    best = KB.best_for_documents(kb, _lookups(spark, folder))
    return best.select("doc_id", "term", "correct_term", "score_tenths")


@query("w06_best_per_term", f"""{_BEST_SQL}
SELECT term, topic, country, correct_term FROM best""")
def w06_best_per_term(spark, folder):
    best = KB.best_corrections(A.knowledge_table(spark, folder), _lookups(spark, folder))
    return best.select("term", "topic", "country", "correct_term")


def _entity(name, kind, misspelt):
    return F.struct(
        name.alias("name"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("description"),
        misspelt.alias("common_misspellings"),
    )


def nation_manifests(spark, folder):
    """A manifest per customer: its nation and segment as entities, with made-up misspellings."""
    joined = A.table(spark, folder, "customer").join(
        A.table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    nation, segment = F.col("n_name"), F.col("c_mktsegment")
    manifest = F.struct(
        segment.alias("topic"), F.lit("Log").alias("genre"), F.lit("General").alias("industry"),
        nation.alias("country"), F.lit("Standard English").alias("dialect"),
        F.lit("s").alias("summary"),
        F.array(
            _entity(nation, "Place", F.array(
                F.substring(nation, 1, 3), F.lower(nation), F.concat(nation, F.lit("x")),
                F.lit("Xvi"))),
            _entity(segment, "Term", F.array(
                F.lower(segment), F.concat(nation, F.lit("x")), F.lit("1-URGENT"))),
        ).alias("entities"),
        F.array(F.lit("innit"), segment).alias("preservation_list"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("Strict")).otherwise(F.lit("Loose"))
        .alias("style_guide"),
    )
    return joined.select(F.col("c_custkey").cast("string").alias("doc_id"), manifest.alias("manifest"))


_SPELLINGS = """spelled AS (
  SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_custkey % 2 = 0 AS strict, e.name, e.wrong, e.n
  FROM customer JOIN nation ON c_nationkey = n_nationkey,
  LATERAL (VALUES (n_name, substr(n_name, 1, 3), 0), (n_name, lower(n_name), 1),
    (n_name, n_name || 'x', 2), (n_name, 'Xvi', 3), (c_mktsegment, lower(c_mktsegment), 4),
    (c_mktsegment, n_name || 'x', 5), (c_mktsegment, '1-URGENT', 6)) AS e(name, wrong, n)),
own AS (SELECT * FROM spelled
  WHERE strict OR NOT (length(wrong) < length(name) AND contains(name, wrong)))"""


@query("p03_abbreviation_guard", f"""WITH {_SPELLINGS}
SELECT doc_id, wrong, name AS right FROM own""")
def p03_abbreviation_guard(spark, folder):
    return KB.misspellings(nation_manifests(spark, folder)).select("doc_id", "wrong", "right")


_BUILTIN_SQL = "builtin(wrong, \"right\", n) AS (VALUES " + ", ".join(
    f"('{w}', '{r}', {i})" for i, (w, r) in enumerate(K.BUILTIN_SPELLINGS)
) + ")"
_RULES_SQL = f"""{_BUILTIN_SQL},
mentions AS (SELECT wrong, "right", 0 AS stage, n FROM builtin
  UNION ALL SELECT wrong_term, correct_term, 2, id FROM kb),
rules AS (SELECT wrong, arg_max("right", stage * 1e12 + n) AS "right",
  arg_min(stage, stage * 1e12 + n) AS stage, arg_min(n, stage * 1e12 + n) AS n
  FROM mentions GROUP BY wrong)"""


@query("u02_corpus_rules", f"""{with_views('learned', 'kb')},
{_RULES_SQL}
SELECT wrong, "right", CAST(stage AS INTEGER) AS stage, CAST(n AS BIGINT) AS n FROM rules""")
def u02_corpus_rules(spark, folder):
    return KB.corpus_rules(A.knowledge_table(spark, folder))


@query("a08_replacement_map", f"""{with_views('learned', 'kb')},
{_BUILTIN_SQL},
{_SPELLINGS},
mentions AS (
  SELECT doc_id, b.wrong, b."right", b.n AS seq FROM (SELECT DISTINCT doc_id FROM own), builtin b
  UNION ALL SELECT doc_id, wrong, name, 1000 + n FROM own
  UNION ALL SELECT d.doc_id, k.wrong_term, k.correct_term, 2000 + k.id
    FROM (SELECT DISTINCT doc_id, wrong FROM own) d JOIN kb k ON k.wrong_term = d.wrong),
mapped AS (SELECT doc_id, wrong, min(seq) AS first, arg_max("right", seq) AS "right"
  FROM mentions GROUP BY ALL)
SELECT m.doc_id, m.wrong, m."right",
  CAST(row_number() OVER (PARTITION BY m.doc_id ORDER BY m.first) AS INTEGER) AS place
FROM mapped m JOIN (SELECT DISTINCT doc_id, wrong FROM own) o USING (doc_id, wrong)""")
def a08_replacement_map(spark, folder):
    from pyspark.sql.window import Window

    own = KB.document_rules(nation_manifests(spark, folder), A.knowledge_table(spark, folder))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("stage", "n"))
    return own.select("doc_id", "wrong", "right", place.alias("place"))


@query("t05_sorted_entities", """WITH named AS (
  SELECT CAST(c_custkey AS VARCHAR) AS doc_id, unnest([n_name, c_mktsegment]) AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT n.doc_id, string_agg(name, ',' ORDER BY name) AS names,
  'innit, ' || any_value(c.c_mktsegment) AS preserved
FROM named n JOIN customer c ON n.doc_id = CAST(c.c_custkey AS VARCHAR) GROUP BY n.doc_id""")
def t05_sorted_entities(spark, folder):
    from cueflow.operators.prompts import shown_preserved_terms, sorted_entities

    manifests = nation_manifests(spark, folder)
    names = F.transform(sorted_entities(F.col("manifest")), lambda e: e["name"])
    return manifests.select(
        "doc_id", F.array_join(names, ",").alias("names"),
        shown_preserved_terms(F.col("manifest")).alias("preserved"),
    )
