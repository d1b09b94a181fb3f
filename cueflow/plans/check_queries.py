"""Queries over the rules, overlaps and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueflow import constants as K
from cueflow.operators import cleaning, intervals, rules, stats
from cueflow.plans.registry import query
from cueflow.session import settle
from cueflow.sources import adapters as A
from cueflow.sources.adapters import with_views

_ISSUE_OUT = ["doc_id", "segment_idx", "issue_type", "severity", "pos", "line_no"]


def _rule_sql(view: str, name: str, severity: str, condition: str, extra: str = "") -> str:
    return f"""{with_views(view)},
timed AS (SELECT *, end_ms - start_ms AS dur,
  CASE WHEN end_ms = start_ms THEN 0.0::DOUBLE
       ELSE length(text) / (CAST(end_ms - start_ms AS DOUBLE) / 1000.0::DOUBLE) END AS cps,
  string_split(text, chr(10)) AS lines FROM seg)
SELECT doc_id, idx AS segment_idx, '{name}' AS issue_type, '{severity}' AS severity, pos,
  0 AS line_no{extra} FROM timed WHERE {condition}"""


def _line_sql(name: str, condition: str) -> str:
    return f"""{with_views('seg_convs')},
pieces AS (SELECT doc_id, idx, pos, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM seg)
SELECT doc_id, idx AS segment_idx, '{name}' AS issue_type, 'warning' AS severity, pos,
  CAST(line_no AS INTEGER) AS line_no FROM pieces WHERE {condition}"""


def _times(segments):
    """Times of segments, written once for jobs that read them several times."""
    return settle(segments.select("doc_id", "pos", "start_ms", "end_ms"), "cue-times")


def _negative_shift(df):
    """Times moved two weeks back, so that part of them is negative."""
    shift = 14 * 86_400_000
    return df.withColumn("start_ms", F.col("start_ms") - shift).withColumn(
        "end_ms", F.col("end_ms") - shift
    )


_SHIFT_SQL = "1209600000"


@query("v01_duration", f"""{with_views('seg_short')}
SELECT doc_id, pos, end_ms - start_ms AS duration_ms FROM seg""")
def v01_duration(spark, folder):
    seg = A.event_segments(spark, folder)
    return seg.select("doc_id", "pos", rules.duration_ms().alias("duration_ms"))


@query("v02_reading_speed", f"""{with_views('seg_short')}
SELECT doc_id, pos, CASE WHEN end_ms = start_ms THEN 0.0::DOUBLE
  ELSE length(text) / (CAST(end_ms - start_ms AS DOUBLE) / 1000.0::DOUBLE) END AS cps
FROM seg""")
def v02_reading_speed(spark, folder):
    return A.event_segments(spark, folder).select("doc_id", "pos", rules.cps().alias("cps"))


def _register_rule(key, name, view, load, severity, condition):
    @query(key, _rule_sql(view, name, severity, condition))
    def run(spark, folder, name=name, load=load):
        return rules.segment_issues(load(spark, folder), [name]).select(*_ISSUE_OUT)


def _blanked(spark, folder):
    """Document lines with every seventh text blanked."""
    seg = A.document_segments(spark, folder)
    blank = (F.col("pos") % 7) == 3
    return seg.withColumn("text", F.when(blank, F.lit(" \t")).otherwise(F.col("text")))


for _key, _name, _severity, _condition in [
    ("v03_duration_too_short", "duration_too_short", "error", "dur < 500"),
    ("v04_duration_short", "duration_short", "warning", "dur >= 500 AND dur < 1500"),
    ("v05_duration_too_long", "duration_too_long", "error", "dur > 10000"),
    ("v06_duration_long", "duration_long", "warning", "dur <= 10000 AND dur > 6000"),
    ("v07_cps_too_high", "cps_too_high", "error", "cps > 25"),
    ("v08_cps_high", "cps_high", "warning", "cps <= 25 AND cps > 17"),
]:
    _register_rule(_key, _name, "seg_short", A.event_segments, _severity, _condition)

_register_rule(
    "v10_too_many_lines", "too_many_lines", "seg_convs", A.conversation_segments, "warning",
    "len(lines) > 2",
)


@query("v09_empty_text", f"""{with_views('seg_docs')}
SELECT doc_id, idx AS segment_idx, 'empty_text' AS issue_type, 'error' AS severity, pos,
  0 AS line_no FROM seg WHERE pos % 7 = 3 OR trim(text) = ''""")
def v09_empty_text(spark, folder):
    return rules.segment_issues(_blanked(spark, folder), ["empty_text"]).select(*_ISSUE_OUT)


@query("v10_too_many_lines_strict", f"""{with_views('seg_convs')}
SELECT doc_id, idx AS segment_idx, 'too_many_lines' AS issue_type, 'error' AS severity, pos,
  0 AS line_no FROM seg WHERE len(string_split(text, chr(10))) > 2""")
def v10_strict(spark, folder):
    seg = A.conversation_segments(spark, folder)
    return rules.segment_issues(seg, ["too_many_lines"], strict=True).select(*_ISSUE_OUT)


@query("v11_line_too_long", _line_sql("line_too_long", "length(line) > 80"))
def v11_line_too_long(spark, folder):
    seg = A.conversation_segments(spark, folder)
    return rules.segment_issues(seg, ["line_too_long"]).select(*_ISSUE_OUT)


@query("v12_line_long", _line_sql("line_long", "length(line) > 42 AND length(line) <= 80"))
def v12_line_long(spark, folder):
    seg = A.conversation_segments(spark, folder)
    return rules.segment_issues(seg, ["line_long"]).select(*_ISSUE_OUT)


@query("v13_negative_start", f"""{with_views('seg_short')}
SELECT doc_id, idx AS segment_idx, 'negative_start' AS issue_type, 'error' AS severity, pos,
  0 AS line_no FROM seg WHERE start_ms - {_SHIFT_SQL} < 0""")
def v13_negative_start(spark, folder):
    seg = _negative_shift(A.event_segments(spark, folder))
    return rules.segment_issues(seg, ["negative_start"]).select(*_ISSUE_OUT)


@query("v14_invalid_timing", f"""{with_views('seg_short')}
SELECT doc_id, idx AS segment_idx, 'invalid_timing' AS issue_type, 'error' AS severity, pos,
  0 AS line_no FROM seg WHERE end_ms - 1000 <= start_ms""")
def v14_invalid_timing(spark, folder):
    seg = A.event_segments(spark, folder).withColumn("end_ms", F.col("end_ms") - 1000)
    return rules.segment_issues(seg, ["invalid_timing"]).select(*_ISSUE_OUT)


@query("v15_empty_document", f"""{with_views('seg_convs')}
SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'empty_document' AS issue_type, 'error' AS severity,
  'Document contains no segments' AS message
FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT doc_id FROM seg)""")
def v15_empty_document(spark, folder):
    docs = A.documents(spark, folder).select(F.col("doc_id").cast("string"))
    issues = rules.empty_document_issues(docs, A.conversation_segments(spark, folder))
    return issues.select("doc_id", "issue_type", "severity", "message")


_ALL_SHORT_SQL = f"""{with_views('seg_short')},
timed AS (SELECT *, end_ms - start_ms AS dur,
  CASE WHEN end_ms = start_ms THEN 0.0::DOUBLE
       ELSE length(text) / (CAST(end_ms - start_ms AS DOUBLE) / 1000.0::DOUBLE) END AS cps
  FROM seg),
found AS (
  SELECT doc_id, pos, idx, 1 AS phase, 1 AS rule_no, 'duration_too_short' AS issue_type,
    'error' AS severity FROM timed WHERE dur < 500
  UNION ALL SELECT doc_id, pos, idx, 1, 2, 'duration_short', 'warning' FROM timed
    WHERE dur >= 500 AND dur < 1500
  UNION ALL SELECT doc_id, pos, idx, 1, 3, 'duration_too_long', 'error' FROM timed
    WHERE dur > 10000
  UNION ALL SELECT doc_id, pos, idx, 1, 4, 'duration_long', 'warning' FROM timed
    WHERE dur > 6000 AND dur <= 10000
  UNION ALL SELECT doc_id, pos, idx, 1, 5, 'cps_too_high', 'error' FROM timed WHERE cps > 25
  UNION ALL SELECT doc_id, pos, idx, 1, 6, 'cps_high', 'warning' FROM timed
    WHERE cps > 17 AND cps <= 25
  UNION ALL SELECT doc_id, pos, idx, 1, 11, 'invalid_timing', 'error' FROM timed
    WHERE end_ms <= start_ms)"""


@query("v16_issue_sides", f"""{_ALL_SHORT_SQL}
SELECT doc_id, CASE WHEN severity = 'error' THEN 'errors' ELSE 'warnings' END AS side,
  issue_type, count(*) AS issues FROM found GROUP BY ALL""")
def v16_issue_sides(spark, folder):
    issues = rules.segment_issues(A.event_segments(spark, folder))
    return issues.groupBy(
        "doc_id", rules.issue_side(F.col("severity")).alias("side"), "issue_type"
    ).agg(F.count("*").alias("issues"))


@query("j01_overlaps", f"""{with_views('seg_long')}
SELECT a.doc_id, a.pos AS pos_i, b.pos AS pos_j FROM seg a JOIN seg b
  ON a.doc_id = b.doc_id AND a.pos < b.pos
WHERE NOT (a.end_ms <= b.start_ms OR a.start_ms >= b.end_ms)""")
def j01_overlaps(spark, folder):
    return intervals.overlap_pairs(
        _times(A.event_segments(spark, folder, ms_per_unit=600_000))
    )


@query("j01_overlap_issues", f"""{with_views('seg_docs')}
SELECT a.doc_id, a.pos AS segment_idx, 'overlap' AS issue_type, 'error' AS severity,
  'Segment ' || a.pos || ' overlaps with segment ' || b.pos AS message
FROM seg a JOIN seg b ON a.doc_id = b.doc_id AND a.pos < b.pos
WHERE NOT (a.end_ms <= b.start_ms OR a.start_ms >= b.end_ms)""")
def j01_overlap_issues(spark, folder):
    pairs = intervals.overlap_pairs(A.document_segments(spark, folder))
    return rules.overlap_issues(pairs).select(
        "doc_id", "segment_idx", "issue_type", "severity", "message"
    )


@query("w01_out_of_order", f"""{with_views('seg_shuffled')},
linked AS (SELECT *, lag(start_ms) OVER w AS prev_start, lag(idx) OVER w AS prev_idx FROM seg
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, idx AS segment_idx, 'out_of_order' AS issue_type, 'error' AS severity,
  'Segment ' || idx || ' starts before segment ' || prev_idx AS message
FROM linked WHERE start_ms < prev_start""")
def w01_out_of_order(spark, folder):
    seg = A.event_segments(spark, folder, shuffled=True)
    return rules.order_issues(seg, ["out_of_order"]).select(
        "doc_id", "segment_idx", "issue_type", "severity", "message"
    )


@query("w02_large_gap", f"""{with_views('seg_short')},
linked AS (SELECT *, lag(end_ms) OVER w AS prev_end, lag(idx) OVER w AS prev_idx FROM seg
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, idx AS segment_idx, 'large_gap' AS issue_type, 'warning' AS severity,
  'Large gap (' || (start_ms - prev_end) || 'ms) between segments ' || prev_idx || ' and ' || idx
    AS message
FROM linked WHERE start_ms - prev_end > 10000""")
def w02_large_gap(spark, folder):
    issues = rules.order_issues(A.event_segments(spark, folder), ["large_gap"])
    return issues.select("doc_id", "segment_idx", "issue_type", "severity", "message")


def _stats_sql(view: str) -> str:
    return f"""{with_views(view)},
timed AS (SELECT *, end_ms - start_ms AS dur,
  CASE WHEN end_ms > start_ms
    THEN length(text) / (CAST(end_ms - start_ms AS DOUBLE) / 1000.0::DOUBLE) END AS cps FROM seg),
base AS (SELECT doc_id, count(*) AS segment_count, arg_max(end_ms, pos) AS total_duration_ms,
  CAST(sum(dur) AS DOUBLE) / count(*) AS avg_duration_ms, min(dur) AS min_duration_ms,
  max(dur) AS max_duration_ms, round(coalesce(avg(cps), 0), 6) AS avg_cps,
  coalesce(max(cps), 0) AS max_cps, CAST(sum(length(text)) AS BIGINT) AS total_characters
  FROM timed GROUP BY doc_id),
pairs AS (SELECT a.doc_id, count(*) AS n FROM seg a JOIN seg b
  ON a.doc_id = b.doc_id AND a.pos < b.pos
  WHERE NOT (a.end_ms <= b.start_ms OR a.start_ms >= b.end_ms) GROUP BY a.doc_id)
SELECT base.*, coalesce(pairs.n, 0) AS overlap_count FROM base LEFT JOIN pairs USING (doc_id)"""


def _rounded_stats(df):
    return df.withColumn("avg_cps", F.round("avg_cps", 6))


@query("a01_document_stats", _stats_sql("seg_docs"))
def a01_document_stats(spark, folder):
    return _rounded_stats(stats.document_stats(A.document_segments(spark, folder)))


@query("a01_overlap_counts_faulty", f"""{with_views('seg_long')},
faulty AS (SELECT doc_id, pos, start_ms,
  CASE pos % 5 WHEN 0 THEN start_ms WHEN 1 THEN start_ms - (end_ms - start_ms) // 1000
    ELSE end_ms END AS end_ms FROM seg)
SELECT a.doc_id, count(*) AS overlap_count FROM faulty a JOIN faulty b
  ON a.doc_id = b.doc_id AND a.pos < b.pos
WHERE NOT (a.end_ms <= b.start_ms OR a.start_ms >= b.end_ms) GROUP BY a.doc_id""")
def a01_overlap_counts_faulty(spark, folder):
    seg = _times(A.event_segments(spark, folder, ms_per_unit=600_000))
    length = F.col("end_ms") - F.col("start_ms")
    faulty = seg.withColumn(
        "end_ms",
        F.when(F.col("pos") % 5 == 0, F.col("start_ms"))
        .when(F.col("pos") % 5 == 1, F.col("start_ms") - F.floor(length / 1000))
        .otherwise(F.col("end_ms")),
    )
    return intervals.overlap_counts(faulty).where("overlap_count > 0")


@query("a01_document_stats_long", _stats_sql("seg_long"))
def a01_document_stats_long(spark, folder):
    seg = A.event_segments(spark, folder, ms_per_unit=600_000)
    return _rounded_stats(stats.document_stats(seg))


@query("a02_error_warning_counts", f"""{_ALL_SHORT_SQL}
SELECT doc_id, count(*) FILTER (severity = 'error') AS errors,
  count(*) FILTER (severity <> 'error') AS warnings,
  count(*) FILTER (severity = 'error') = 0 AS valid
FROM found GROUP BY doc_id""")
def a02_error_warning_counts(spark, folder):
    return stats.issue_counts(rules.segment_issues(A.event_segments(spark, folder)))


@query("a06_context_sample", f"""{with_views('seg_source')},
sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM seg),
head AS (SELECT doc_id, max(n) AS n, string_agg(text, chr(10) ORDER BY pos) AS t FROM sized
  WHERE n <= 100 OR pos < 50 GROUP BY doc_id),
body AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY pos) AS t FROM sized
  WHERE n > 100 AND pos >= n // 2 AND pos < n // 2 + 50 GROUP BY doc_id)
SELECT head.doc_id, head.n AS segment_count,
  CASE WHEN head.n > 100 THEN head.t || chr(10) || '...' || chr(10) || body.t ELSE head.t END
    AS sample_text
FROM head LEFT JOIN body USING (doc_id)""")
def a06_context_sample(spark, folder):
    return stats.context_sample(A.source_segments(spark, folder))


@query("a06_context_sample_docs", f"""{with_views('seg_docs')},
sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM seg),
head AS (SELECT doc_id, max(n) AS n, string_agg(text, chr(10) ORDER BY pos) AS t FROM sized
  WHERE n <= 100 OR pos < 50 GROUP BY doc_id),
body AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY pos) AS t FROM sized
  WHERE n > 100 AND pos >= n // 2 AND pos < n // 2 + 50 GROUP BY doc_id)
SELECT head.doc_id, head.n AS segment_count,
  CASE WHEN head.n > 100 THEN head.t || chr(10) || '...' || chr(10) || body.t ELSE head.t END
    AS sample_text
FROM head LEFT JOIN body USING (doc_id)""")
def a06_context_sample_docs(spark, folder):
    return stats.context_sample(A.document_segments(spark, folder))


_SIZE_BOUNDS = [100, 300, 1000, 3000, 10000, 30000]


@query("a07_size_distribution", """SELECT lang, b.le, count(*) FILTER (n_chars <= b.bound)
    AS cumulative, CAST(sum(n_chars) AS BIGINT) AS size_sum
FROM documents, (VALUES ('100', 100), ('300', 300), ('1000', 1000), ('3000', 3000),
  ('10000', 10000), ('30000', 30000), ('+Inf', 9000000000)) AS b(le, bound)
GROUP BY lang, b.le""")
def a07_size_distribution(spark, folder):
    docs = A.documents(spark, folder)
    return stats.size_distribution(docs, "lang", F.col("n_chars"), _SIZE_BOUNDS)


_V_BOUNDS = [("duration_too_short", "dur < 500", "below minimum", "500"),
             ("duration_short", "dur >= 500 AND dur < 1500", "below recommended", "1500"),
             ("duration_too_long", "dur > 10000", "exceeds maximum", "10000"),
             ("duration_long", "dur > 6000 AND dur <= 10000", "exceeds recommended", "6000")]
_V_MESSAGES = " UNION ALL ".join([
    *(f"""SELECT doc_id, idx, '{name}' AS issue_type, 'Segment duration (' || dur || 'ms) is {words} ({bound}ms)'
  AS message, 'duration_ms=' || dur AS details FROM timed WHERE {test}""".replace(
        " is exceeds", " exceeds") for name, test, words, bound in _V_BOUNDS),
    """SELECT doc_id, idx, 'cps_too_high', 'CPS (' || printf('%.1f', cps) || ') exceeds maximum (25.0)',
  '' FROM timed WHERE cps > 25""",
    """SELECT doc_id, idx, 'cps_high', 'CPS (' || printf('%.1f', cps) || ') exceeds target (17.0)',
  '' FROM timed WHERE cps > 17 AND cps <= 25""",
    """SELECT doc_id, idx, 'empty_text', 'Segment has empty text', '' FROM timed WHERE trim(text) = ''""",
    """SELECT doc_id, idx, 'too_many_lines', 'Segment has ' || len(string_split(text, chr(10)))
  || ' lines (max: 2)', 'line_count=' || len(string_split(text, chr(10))) FROM timed
  WHERE len(string_split(text, chr(10))) > 2""",
    """SELECT doc_id, idx, 'line_too_long', 'Line ' || line_no || ' has ' || length(line)
  || ' characters (max: 80)', 'line_length=' || length(line) || ',line_number=' || line_no
  FROM pieces WHERE length(line) > 80""",
    """SELECT doc_id, idx, 'line_long', 'Line ' || line_no || ' has ' || length(line)
  || ' characters (target: 42)', 'line_length=' || length(line) || ',line_number=' || line_no
  FROM pieces WHERE length(line) > 42 AND length(line) <= 80""",
    """SELECT doc_id, idx, 'negative_start', 'Segment has negative start time',
  'start_ms=' || start_ms FROM timed WHERE start_ms < 0""",
    """SELECT doc_id, idx, 'invalid_timing', 'End time must be after start time',
  'end_ms=' || end_ms || ',start_ms=' || start_ms FROM timed WHERE end_ms <= start_ms""",
])


@query("v17_messages", f"""{with_views('seg_convs')},
moved AS (SELECT doc_id, pos, idx, start_ms - 4000 AS start_ms,
  CASE WHEN pos % 3 = 1 THEN start_ms - 4000 - pos ELSE end_ms - 4000 END AS end_ms,
  CASE WHEN pos % 5 = 4 THEN ' ' ELSE text END AS text FROM seg),
timed AS (SELECT *, end_ms - start_ms AS dur, CASE WHEN end_ms = start_ms THEN 0.0::DOUBLE
  ELSE length(text) / (CAST(end_ms - start_ms AS DOUBLE) / 1000.0::DOUBLE) END AS cps FROM moved),
pieces AS (SELECT doc_id, idx, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM timed)
SELECT doc_id, idx AS segment_idx, issue_type, message, details FROM ({_V_MESSAGES})""")
def v17_messages(spark, folder):
    """Messages and details of all rules on single segments; turns with planted faults.

    Of the reading speed only the message is compared: its detail is a double printed as text.
    """
    seg = A.conversation_segments(spark, folder)
    start = F.col("start_ms") - 4000
    seg = seg.select(
        "doc_id", "pos", "idx", start.alias("start_ms"),
        F.when(F.col("pos") % 3 == 1, start - F.col("pos")).otherwise(F.col("end_ms") - 4000)
        .alias("end_ms"),
        F.when(F.col("pos") % 5 == 4, F.lit(" ")).otherwise(F.col("text")).alias("text"))
    entries = F.array_sort(F.map_entries("details"))
    shown = F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return rules.segment_issues(seg).select(
        "doc_id", "segment_idx", "issue_type", "message",
        F.when(F.startswith("issue_type", F.lit("cps")), F.lit("")).otherwise(shown).alias("details"))


@query("d09_settings_faults", """WITH settings AS (
  SELECT p_partkey AS id, p_size * 2 AS line_wrap, p_partkey % 6 AS max_lines,
    p_size * 130 AS min_duration_ms, CAST(p_retailprice * 8 AS BIGINT) AS max_duration_ms,
    CAST(p_size AS DOUBLE) / 1.6 AS max_cps FROM part)
SELECT id, 'line_wrap' AS setting, CAST(line_wrap AS DOUBLE) AS value FROM settings
  WHERE line_wrap NOT BETWEEN 20 AND 80
UNION ALL SELECT id, 'max_lines', CAST(max_lines AS DOUBLE) FROM settings
  WHERE max_lines NOT BETWEEN 1 AND 4
UNION ALL SELECT id, 'min_duration_ms', CAST(min_duration_ms AS DOUBLE) FROM settings
  WHERE min_duration_ms NOT BETWEEN 500 AND 5000
UNION ALL SELECT id, 'max_duration_ms', CAST(max_duration_ms AS DOUBLE) FROM settings
  WHERE max_duration_ms NOT BETWEEN 2000 AND 10000
UNION ALL SELECT id, 'max_cps', max_cps FROM settings WHERE max_cps NOT BETWEEN 5 AND 25""")
def d09_settings_faults(spark, folder):
    """Settings made of part columns, checked against the allowed ranges."""
    from cueflow.plans.validation import settings_faults

    settings = A.table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_size") * 2).alias("line_wrap"),
        (F.col("p_partkey") % 6).alias("max_lines"), (F.col("p_size") * 130).alias("min_duration_ms"),
        F.round(F.col("p_retailprice") * 8).cast("long").alias("max_duration_ms"),
        (F.col("p_size") / F.lit(1.6)).alias("max_cps"))
    return settings_faults(settings).select("id", "setting", "value")


@query("t04_ordered_issues", f"""{_ALL_SHORT_SQL},
linked AS (SELECT *, lag(start_ms) OVER w AS prev_start, lag(end_ms) OVER w AS prev_end FROM seg
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
pairs AS (SELECT a.doc_id, a.pos AS i, b.pos AS j FROM seg a JOIN seg b
  ON a.doc_id = b.doc_id AND a.pos < b.pos
  WHERE NOT (a.end_ms <= b.start_ms OR a.start_ms >= b.end_ms)),
every AS (
  SELECT doc_id, idx AS segment_idx, issue_type, severity, phase, pos, rule_no, 0 AS line_no
    FROM found
  UNION ALL SELECT doc_id, i, 'overlap', 'error', 2, i, 1, CAST(j AS INTEGER) FROM pairs
  UNION ALL SELECT doc_id, idx, 'out_of_order', 'error', 3, pos, 1, 0 FROM linked
    WHERE start_ms < prev_start
  UNION ALL SELECT doc_id, idx, 'large_gap', 'warning', 3, pos, 2, 0 FROM linked
    WHERE start_ms - prev_end > 10000)
SELECT * FROM every ORDER BY doc_id, phase, pos, rule_no, line_no""")
def t04_ordered_issues(spark, folder):
    from cueflow.plans.validation import all_issues

    issues = all_issues(A.event_segments(spark, folder))
    return rules.ordered_issues(issues).select(
        "doc_id", "segment_idx", "issue_type", "severity", "phase", "pos", "rule_no", "line_no"
    )


@query("c09_validation_report", f"""{_ALL_SHORT_SQL},
linked AS (SELECT *, lag(start_ms) OVER w AS prev_start, lag(end_ms) OVER w AS prev_end FROM seg
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
pairs AS (SELECT a.doc_id, count(*) AS n FROM seg a JOIN seg b
  ON a.doc_id = b.doc_id AND a.pos < b.pos
  WHERE NOT (a.end_ms <= b.start_ms OR a.start_ms >= b.end_ms) GROUP BY a.doc_id),
every AS (
  SELECT doc_id, severity, 1 AS n FROM found
  UNION ALL SELECT doc_id, 'error', n FROM pairs
  UNION ALL SELECT doc_id, 'error', 1 FROM linked WHERE start_ms < prev_start
  UNION ALL SELECT doc_id, 'warning', 1 FROM linked WHERE start_ms - prev_end > 10000),
sides AS (SELECT doc_id, sum(CASE WHEN severity = 'error' THEN n ELSE 0 END) AS errors,
  sum(CASE WHEN severity <> 'error' THEN n ELSE 0 END) AS warnings FROM every GROUP BY doc_id),
base AS (SELECT doc_id, count(*) AS segment_count, arg_max(end_ms, pos) AS total_duration_ms,
  CAST(sum(length(text)) AS BIGINT) AS total_characters FROM seg GROUP BY doc_id)
SELECT base.*, CAST(coalesce(errors, 0) AS BIGINT) AS errors,
  CAST(coalesce(warnings, 0) AS BIGINT) AS warnings, coalesce(errors, 0) = 0 AS valid,
  coalesce(pairs.n, 0) AS overlap_count
FROM base LEFT JOIN sides USING (doc_id) LEFT JOIN pairs USING (doc_id)""")
def c09_validation_report(spark, folder):
    from cueflow.plans.validation import validation_report

    report = validation_report(A.event_segments(spark, folder))
    return report.select(
        "doc_id", "segment_count", "total_duration_ms", "total_characters", "errors", "warnings",
        "valid", "overlap_count",
    )


@query("c09_text_report", f"""{with_views('seg_docs')},
parsed AS (SELECT doc_id, pos, start_ms, end_ms, trim(text, ' ' || chr(9) || chr(160)) AS text
  FROM seg WHERE (CAST(doc_id AS BIGINT) + pos) % 13 > 2 AND trim(text) <> ''),
named AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 11 = 4 THEN 'content_empty'
    WHEN doc_id % 11 = 5 THEN 'format' END AS reason, doc_id % 11 = 6 AS junk FROM documents)
SELECT named.doc_id, reason, CASE WHEN reason IS NULL THEN count(pos) END AS segment_count,
  CASE WHEN reason IS NULL THEN coalesce(arg_max(end_ms, pos), 0) END AS total_duration_ms
FROM named LEFT JOIN parsed
  ON named.doc_id = parsed.doc_id AND reason IS NULL AND NOT junk
GROUP BY named.doc_id, reason""")
def c09_text_report(spark, folder):
    """From subtitle text to reports: admission, parsing, rules; also rejected and empty files."""
    from cueflow.plans.source_queries import srt_corpus
    from cueflow.plans.validation import text_report

    docs = srt_corpus(spark, folder)
    kind = F.col("doc_id").cast("long") % 11
    docs = docs.select(
        "doc_id", F.lit("en").alias("language"),
        F.when(kind == 4, F.lit(" ")).when(kind == 6, F.lit("junk")).otherwise(
            F.col("content")).alias("content"),
        F.when(kind == 5, F.lit(None)).otherwise(F.lit("srt")).alias("format"))
    return text_report(docs, 2**31 - 1).select("doc_id", "reason", "segment_count", "total_duration_ms")


@query("d08_merge_adjacent", f"""{with_views('seg_long')},
linked AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w <= 100 THEN 0 ELSE 1 END AS fresh
  FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM linked)
SELECT doc_id, CAST(run - 1 AS BIGINT) AS pos, arg_min(start_ms, pos) AS start_ms,
  arg_max(end_ms, pos) AS end_ms, count(*) AS merged_cues,
  string_agg(text, ' ' ORDER BY pos) AS text
FROM runs GROUP BY doc_id, run""")
def d08_merge_adjacent(spark, folder):
    seg = A.event_segments(spark, folder, ms_per_unit=600_000)
    return intervals.merge_adjacent(seg).select(
        "doc_id", "pos", "start_ms", "end_ms", "merged_cues", "text"
    )


@query("d09_preset_rules", f"""{with_views('seg_docs')},
presets(preset, lo, hi, cps_max, wrap) AS (VALUES
  ('default', 1500, 6000, 17.0, 42), ('aggressive', 1000, 6000, 20.0, 42),
  ('conservative', 2000, 6000, 15.0, 42), ('accessibility', 2000, 8000, 12.0, 37),
  ('streaming', 1500, 6000, 18.0, 42), ('ml_enhanced', 1500, 6000, 17.0, 42)),
timed AS (SELECT seg.*, end_ms - start_ms AS dur,
  length(text) / (CAST(end_ms - start_ms AS DOUBLE) / 1000.0::DOUBLE) AS cps,
  CASE CAST(doc_id AS BIGINT) % 6 WHEN 0 THEN 'default' WHEN 1 THEN 'aggressive'
    WHEN 2 THEN 'conservative' WHEN 3 THEN 'accessibility' WHEN 4 THEN 'streaming'
    ELSE 'ml_enhanced' END AS preset FROM seg),
joined AS (SELECT * FROM timed JOIN presets USING (preset)),
found AS (
  SELECT preset, 'duration_short' AS issue_type FROM joined WHERE dur >= 500 AND dur < lo
  UNION ALL SELECT preset, 'duration_long' FROM joined WHERE dur <= 10000 AND dur > hi
  UNION ALL SELECT preset, 'cps_high' FROM joined
    WHERE cps <= 25 AND cps > CAST(cps_max AS DOUBLE)
  UNION ALL SELECT preset, 'line_long' FROM joined
    WHERE length(text) <= 80 AND length(text) > wrap)
SELECT preset, issue_type, count(*) AS issues FROM found GROUP BY ALL""")
def d09_preset_rules(spark, folder):
    from cueflow.plans.validation import preset_issues

    names = F.array(*[F.lit(n) for n in K.PRESETS])
    seg = A.document_segments(spark, folder).withColumn(
        "preset", F.get(names, (F.col("doc_id").cast("long") % len(K.PRESETS)).cast("int"))
    )
    issues = preset_issues(seg, ["duration_short", "duration_long", "cps_high", "line_long"])
    return issues.groupBy("preset", "issue_type").agg(F.count("*").alias("issues"))


@query("d10_preview", f"""{with_views('seg_docs')}
SELECT doc_id, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS chars_before,
  CAST(sum(length(replace(replace(replace(replace(text, '...', chr(8230)), '!!', '!'),
    '??', '?'), '  ', ' '))) AS BIGINT) AS chars_after,
  round(100.0::DOUBLE * (chars_before - chars_after) / chars_before, 6) AS reduction_percent
FROM seg WHERE pos < 10 GROUP BY doc_id""")
def d10_preview(spark, folder):
    seg = A.document_segments(spark, folder)
    shown = stats.preview(seg, cleaning.normalize_punctuation(F.col("text")))
    reduction = stats.preview_reduction(shown)
    return reduction.withColumn("reduction_percent", F.round("reduction_percent", 6))


@query("d17_drop_empty_clip", f"""{with_views('seg_docs')},
linked AS (SELECT *, lead(start_ms) OVER (PARTITION BY doc_id ORDER BY pos) AS next_start FROM seg)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, start_ms,
  CASE WHEN next_start > start_ms AND next_start < end_ms THEN next_start ELSE end_ms END AS end_ms
FROM linked WHERE trim(text) <> '' AND pos % 7 <> 3""")
def d17_drop_empty_clip(spark, folder):
    clipped = intervals.clip_overlaps(_blanked(spark, folder))
    return cleaning.drop_empty(clipped).select("doc_id", "pos", "start_ms", "end_ms")


@query("d19_run_report", f"""{with_views('seg_docs')}
SELECT doc_id, count(*) AS segments_processed,
  count(*) FILTER (text <> replace(replace(replace(replace(text, '...', chr(8230)), '!!', '!'),
    '??', '?'), '  ', ' ')) AS segments_modified
FROM seg GROUP BY doc_id""")
def d19_run_report(spark, folder):
    seg = A.document_segments(spark, folder)
    after = seg.withColumn("text", cleaning.normalize_punctuation(F.col("text")))
    return stats.run_report(seg, after)
