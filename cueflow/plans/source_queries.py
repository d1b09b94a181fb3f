"""Queries over parsing, rendering, file sources and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F


from cueflow.functions.timecode import cut_cue_settings, srt_clock, srt_times, vtt_clock, vtt_times
from cueflow.plans.registry import query
from cueflow.session import scratch_path
from cueflow.sources import adapters as A
from cueflow.sources import codec, files, payloads
from cueflow.sources.adapters import with_views
from cueflow.sources.knowledge_store import decode_entries

# Python's whitespace for DuckDB's trim().
_WS = "||".join(f"chr({ord(c)})" for c in " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0")


def _trim(text: str) -> str:
    return f"trim({text}, {_WS})"



# Arabic-Indic digits, and mathematical ones beyond the basic plane.
_OTHER_DIGITS = ["".join(chr(zero + n) for n in range(10)) for zero in (0x660, 0x1D7CE)]


def srt_corpus(spark, folder, odd_numbers=False):
    """Each document as an SRT file, with faults planted by (document + line) number.

    Of 13 blocks one has a bad number, one a dot in its times, one no text, and one has junk after
    its times. Every third file has CR LF line ends, every fifth a byte order mark. With
    `odd_numbers` two more have digits of other scripts and one has a number beyond 64 bits.
    """
    docs = A.documents(spark, folder)
    lines = F.split("text", "\n", -1)

    def block(line, i):
        pos = i.cast("long")
        start = pos * 2500 + (F.col("doc_id") * 31 + pos * 17) % 300
        end = start + 300 + (F.col("doc_id") * 13 + pos * 1237) % 4000
        fault = (F.col("doc_id") + pos) % 13
        number = (pos + 1).cast("string")
        times = F.concat(srt_clock(start), F.lit(" --> "), srt_clock(end))
        if odd_numbers:
            number = (
                F.when(fault == 5, F.translate(number, "0123456789", _OTHER_DIGITS[0]))
                .when(fault == 7, F.concat(F.lit("9" * 20), number)).otherwise(number))
            times = F.when(fault == 6, F.translate(times, "0123456789", _OTHER_DIGITS[1])).otherwise(
                times)
        return F.concat(
            F.when(fault == 0, F.concat(F.lit("x"), number)).otherwise(number), F.lit("\n"),
            F.when(fault == 1, F.replace(times, F.lit(","), F.lit(".")))
            .when(fault == 3, F.concat(times, F.lit(" X1:40"))).otherwise(times),
            F.when(fault == 2, F.lit("")).otherwise(F.concat(F.lit("\n"), line)),
        )

    content = F.array_join(F.transform(lines, block), "\n\n")
    content = F.when(
        F.col("doc_id") % 3 == 0, F.replace(content, F.lit("\n"), F.lit("\r\n"))
    ).otherwise(content)
    content = F.when(
        F.col("doc_id") % 5 == 0, F.concat(F.lit("﻿"), content)
    ).otherwise(content)
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), content.alias("content"), "lang"
    )


_SRT_EXPECTED = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos,
  idx, start_ms, end_ms, {_trim('text')} AS text
FROM seg WHERE (CAST(doc_id AS BIGINT) + pos) % 13 > 2 AND {_trim('text')} <> ''"""


_LARGE_SQL = f"""4611686018427387904 + CAST('0x' || substr(
  md5('{'9' * 20}' || (seg.pos + 1)), 1, 15) AS BIGINT)"""


@query("s03_parse_srt", f"""{with_views('seg_docs')}
{_SRT_EXPECTED.replace('  idx,', f"""  CASE WHEN (CAST(doc_id AS BIGINT) + seg.pos) % 13 = 7
    THEN {_LARGE_SQL} ELSE idx END AS idx,""")}""")
def s03_parse_srt(spark, folder):
    return codec.parse_srt(srt_corpus(spark, folder, odd_numbers=True))


@query("w04_renumbered", f"""{with_views('seg_docs')},
parsed AS ({_SRT_EXPECTED})
SELECT doc_id, pos, pos + 1 AS number, idx FROM parsed""")
def w04_renumbered(spark, folder):
    parsed = codec.parse_srt(srt_corpus(spark, folder))
    return parsed.select("doc_id", "pos", (F.col("pos") + 1).alias("number"), "idx")


def webvtt_corpus(spark, folder):
    """Each document as a WebVTT file, with variants planted by (document + line) number."""
    docs = A.documents(spark, folder)

    def block(line, i):
        pos = i.cast("long")
        n = F.col("doc_id") + pos
        start = pos * 2500 + (F.col("doc_id") * 31 + pos * 17) % 300
        end = start + 300 + (F.col("doc_id") * 13 + pos * 1237) % 4000
        short_start, short_end = F.substring(vtt_clock(start), 4, 9), F.substring(
            vtt_clock(end), 4, 9)
        times = (
            F.when(n % 7 == 0, F.concat(short_start, F.lit(" --> "), short_end))
            .when(n % 7 == 1, F.concat(vtt_clock(start), F.lit(" --> "), short_end))
            .otherwise(F.concat(vtt_clock(start), F.lit("  -->  "), vtt_clock(end)))
        )
        return F.concat(
            F.when(n % 3 == 0, F.concat(F.lit("cue-"), pos.cast("string"), F.lit("\n")))
            .otherwise(F.lit("")),
            times,
            F.when(n % 4 == 0, F.lit(" position:50% align:start")).otherwise(F.lit("")),
            F.when(n % 11 == 5, F.lit("")).otherwise(F.concat(
                F.lit("\n"),
                F.when(n % 5 == 0, F.concat(F.lit("<v Ann>"), line, F.lit("</v>")))
                .when(n % 17 == 3, F.lit("<c.loud></c>"))
                .otherwise(line),
            )),
        )

    body = F.array_join(F.transform(F.split("text", "\n", -1), block), "\n\n")
    header = (
        F.when(F.col("doc_id") % 2 == 0, F.lit("WEBVTT\nKind: captions\n\nNOTE made up\n\n"))
        .otherwise(F.lit(""))
    )
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.concat(header, body).alias("content")
    )


_VTT_SQL = f"""{with_views('seg_docs')},
numbered AS (SELECT *, CAST(doc_id AS BIGINT) + pos AS n FROM seg),
texts AS (SELECT *, CASE WHEN n % 5 = 0 THEN '<v Ann>' || text || '</v>'
    WHEN n % 17 = 3 THEN '' ELSE text END AS cue FROM numbered
  WHERE n % 7 <> 1 AND n % 11 <> 5),
bare AS (SELECT doc_id, pos, start_ms, end_ms,
  regexp_replace(regexp_replace({_trim('cue')}, '</?v[^>]*>', '', 'g'), '</?c[^>]*>', '', 'g')
    AS text FROM texts)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos,
  row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS idx, start_ms, end_ms, text
FROM bare WHERE text <> ''"""


@query("s04_parse_webvtt", _VTT_SQL)
def s04_parse_webvtt(spark, folder):
    return codec.parse_webvtt(webvtt_corpus(spark, folder))


_CLOCK_SQL = """CASE WHEN {ms} // 3600000 < 10 THEN '0' ELSE '' END || ({ms} // 3600000) || ':'
  || lpad(CAST({ms} % 3600000 // 60000 AS VARCHAR), 2, '0') || ':'
  || lpad(CAST({ms} % 60000 // 1000 AS VARCHAR), 2, '0') || '{mark}'
  || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"""


def _order_times(spark, folder):
    start = F.col("o_orderkey") * 7919 % 400_000_000
    return A.table(spark, folder, "orders").select(
        "o_orderkey", start.alias("start_ms"),
        (start + F.col("o_custkey") * 37 % 100_000).alias("end_ms"),
    )


_ORDER_TIMES = """times AS (SELECT o_orderkey, o_orderkey * 7919 % 400000000 AS start_ms,
  o_orderkey * 7919 % 400000000 + o_custkey * 37 % 100000 AS end_ms FROM orders)"""


@query("s05_srt_timecode", f"""WITH {_ORDER_TIMES}
SELECT o_orderkey, start_ms, end_ms FROM times
WHERE end_ms < 360000000 AND o_orderkey % 9 <> 4""")
def s05_srt_timecode(spark, folder):
    orders = _order_times(spark, folder)
    key = F.col("o_orderkey")
    gap = F.when(key % 2 == 0, F.lit(" ")).otherwise(F.lit(""))
    line = F.concat(
        srt_clock(F.col("start_ms")), gap, F.lit("-->"), gap,
        F.when(key % 9 == 4, vtt_clock(F.col("end_ms"))).otherwise(srt_clock(F.col("end_ms"))),
        F.when(key % 5 == 0, F.lit(" junk")).otherwise(F.lit("")),
    )
    return orders.select("o_orderkey", srt_times(line).alias("t")).where(
        F.col("t").isNotNull()).select("o_orderkey", "t.*")


@query("s06_webvtt_timecode", f"""WITH {_ORDER_TIMES}
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN start_ms % 3600000 ELSE start_ms END
    AS start_ms,
  CASE WHEN o_orderkey % 3 = 0 THEN end_ms % 3600000 ELSE end_ms END AS end_ms
FROM times WHERE o_orderkey % 3 = 0 OR end_ms < 360000000""")
def s06_webvtt_timecode(spark, folder):
    orders = _order_times(spark, folder)
    short = F.col("o_orderkey") % 3 == 0

    def clock(name):
        rest = F.col(name) % 3_600_000
        return F.when(short, F.substring(vtt_clock(rest), 4, 9)).otherwise(
            vtt_clock(F.col(name)))

    line = F.concat(
        clock("start_ms"), F.lit(" --> "), clock("end_ms"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(" align:middle position:10%"))
        .otherwise(F.lit("")),
    )
    return orders.select("o_orderkey", vtt_times(cut_cue_settings(line)).alias("t")).where(
        F.col("t").isNotNull()).select("o_orderkey", "t.*")


@query("s07_clock_text", f"""WITH {_ORDER_TIMES}
SELECT o_orderkey, {_CLOCK_SQL.format(ms='start_ms', mark=',')} AS srt_clock,
  {_CLOCK_SQL.format(ms='end_ms', mark='.')} AS vtt_clock FROM times""")
def s07_clock_text(spark, folder):
    return _order_times(spark, folder).select(
        "o_orderkey", srt_clock(F.col("start_ms")).alias("srt_clock"),
        vtt_clock(F.col("end_ms")).alias("vtt_clock"),
    )


def _rendered_sql(piece: str, separator: str, head: str = "''", tail: str = "''") -> str:
    return f"""{with_views('seg_docs')},
pieces AS (SELECT doc_id, pos, {piece} AS piece FROM seg)
SELECT doc_id, CAST(0 AS BIGINT) AS part_no,
  {head} || string_agg(piece, {separator} ORDER BY pos) || {tail} AS content
FROM pieces GROUP BY doc_id"""


_SRT_LINE = (
    f"({_CLOCK_SQL.format(ms='start_ms', mark=',')}) || ' --> ' || "
    f"({_CLOCK_SQL.format(ms='end_ms', mark=',')})"
)
_VTT_LINE = (
    f"({_CLOCK_SQL.format(ms='start_ms', mark='.')}) || ' --> ' || "
    f"({_CLOCK_SQL.format(ms='end_ms', mark='.')})"
)
_NL = "chr(10)"


@query("s08_render_srt", _rendered_sql(
    f"(pos + 1) || {_NL} || {_SRT_LINE} || {_NL} || text", f"{_NL} || {_NL}", tail=_NL))
def s08_render_srt(spark, folder):
    return codec.render_srt(A.document_segments(spark, folder))


@query("s09_render_webvtt", _rendered_sql(
    f"{_VTT_LINE} || {_NL} || text || {_NL}", _NL, head=f"'WEBVTT' || {_NL} || {_NL}"))
def s09_render_webvtt(spark, folder):
    return codec.render_webvtt(A.document_segments(spark, folder))


@query("s10_render_corrected", _rendered_sql(
    f"idx || {_NL} || {_SRT_LINE} || {_NL} || text || {_NL}", _NL))
def s10_render_corrected(spark, folder):
    return codec.render_corrected(A.document_segments(spark, folder))


@query("s10_render_raw_ms", _rendered_sql(
    f"idx || {_NL} || start_ms || ' --> ' || end_ms || {_NL} || text || {_NL}", _NL))
def s10_render_raw_ms(spark, folder):
    return codec.render_corrected(A.document_segments(spark, folder), timecode="raw_ms")


_SUFFIXES = [".srt", ".vtt", ".SRT", ".VTT", ".txt"]


def _named_documents(spark, folder):
    suffixes = F.array(*[F.lit(s) for s in _SUFFIXES])
    name = F.concat(
        F.lit("doc"), F.col("doc_id").cast("string"),
        F.get(suffixes, (F.col("doc_id") % len(_SUFFIXES)).cast("int")),
    )
    return A.documents(spark, folder).select(
        F.col("doc_id").cast("string").alias("doc_id"), name.alias("name"),
        F.col("text").alias("content"), F.col("lang").alias("language"),
    )


_NAME_SQL = """'doc' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.srt' WHEN 1 THEN '.vtt'
  WHEN 2 THEN '.SRT' WHEN 3 THEN '.VTT' ELSE '.txt' END"""


@query("s01_scan_corpus", f"""SELECT {_NAME_SQL} AS name, length(text) + 1 AS chars,
  md5(text || chr(10)) AS digest FROM documents""")
def s01_scan_corpus(spark, folder):
    """Documents packed into a corpus in the shared folder, in two parts each, and scanned back."""
    path = scratch_path(spark, "corpus")
    docs = _named_documents(spark, folder)
    half = (F.length("content") / 2).cast("int")
    parts = F.array(
        F.struct(F.lit(1).alias("part_no"), F.concat(
            F.substr("content", half + 1, F.length("content")), F.lit("\n")).alias("content")),
        F.struct(F.lit(0).alias("part_no"), F.substr("content", F.lit(1), half).alias("content")))
    files.pack_corpus(docs.select("name", F.inline(parts)), path)
    return files.scan_packed(spark, path).select(
        F.col("doc_id").alias("name"),
        F.length("content").cast("long").alias("chars"),
        F.md5(F.col("content").cast("binary")).alias("digest"),
    )


@query("s01_named_documents", f"""SELECT {_NAME_SQL} AS name, length(text) AS chars
FROM documents WHERE doc_id % 97 = 3""")
def s01_named_documents(spark, folder):
    """Documents looked up by name in a packed corpus; only the files that hold them are read."""
    path = scratch_path(spark, "corpus")
    docs = _named_documents(spark, folder)
    files.pack_corpus(docs.select("name", F.lit(0).alias("part_no"), "content"), path)
    names = docs.where(F.col("doc_id").cast("long") % 97 == 3).select("name")
    return files.read_packed(spark, path, names).select(
        F.col("doc_id").alias("name"), F.length("content").cast("long").alias("chars"))


@query("s02_format_dispatch", f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_NAME_SQL} AS name,
  CASE WHEN doc_id % 5 = 0 THEN 'srt' ELSE 'webvtt' END AS router,
  CASE WHEN doc_id % 5 IN (1, 3) THEN 'webvtt' ELSE 'srt' END AS cli,
  CASE doc_id % 5 WHEN 0 THEN 'srt' WHEN 1 THEN 'webvtt' END AS strict
FROM documents""")
def s02_format_dispatch(spark, folder):
    name = F.col("name")
    return _named_documents(spark, folder).select(
        "doc_id", "name", *[files.format_of(name, p).alias(p) for p in ["router", "cli", "strict"]]
    )


@query("s12_admission", """SELECT CAST(doc_id AS VARCHAR) AS doc_id,
  CASE WHEN length(trim(text)) > 3000 THEN 'content_too_long'
    WHEN doc_id % 5 NOT IN (0, 1) THEN 'format' WHEN doc_id % 7 = 3 THEN 'language' END AS reason
FROM documents""")
def s12_admission(spark, folder):
    docs = _named_documents(spark, folder)
    docs = docs.withColumn("format", files.format_of(F.col("name"), "strict")).withColumn(
        "language",
        F.when(F.col("doc_id").cast("long") % 7 == 3, F.lit("xx")).otherwise(F.col("language")),
    )
    return files.admit(docs, max_chars=3000).select("doc_id", "reason")


@query("s15_parse_failures", f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id,
  'parse_error' AS issue_type, 'error' AS severity,
  'Failed to parse subtitles: Unsupported format: ' || {_NAME_SQL} AS message
FROM documents WHERE doc_id % 5 NOT IN (0, 1)""")
def s15_parse_failures(spark, folder):
    docs = _named_documents(spark, folder)
    docs = docs.withColumn("format", files.format_of(F.col("name"), "strict"))
    return files.parse_failures(docs).select("doc_id", "issue_type", "severity", "message")


@query("d20_source_options", """SELECT CAST(doc_id AS VARCHAR) AS doc_id,
  CASE WHEN length(trim(text)) > 5000 THEN 'content_too_long' END AS reason, md5(trim(text)) AS digest
FROM documents""")
def d20_source_options(spark, folder):
    docs = _named_documents(spark, folder)
    coded = F.col("doc_id").cast("long") % 2 == 0
    docs = (
        docs.withColumn("is_base64", coded)
        .withColumn(
            "content",
            F.when(coded, F.base64(F.col("content").cast("binary"))).otherwise(F.col("content")),
        )
        .withColumn("format", F.lit("srt"))
    )
    admitted = files.admit(files.decode_base64(docs), max_chars=5000)
    return admitted.select(
        "doc_id", "reason", F.md5(F.col("content").cast("binary")).alias("digest")
    )


@query("d20_segment_limit", f"""{with_views('seg_source')}
SELECT doc_id, count(*) AS segments FROM seg GROUP BY doc_id HAVING count(*) > 400""")
def d20_segment_limit(spark, folder):
    return files.oversized_documents(A.source_segments(spark, folder), max_segments=400)


@query("s11_knowledge_scan", f"""{with_views('learned', 'kb')}
SELECT id, wrong_term, correct_term, topic, industry, country,
  [lower(topic), country] AS tags, 1.0::DOUBLE AS confidence, cnt AS count FROM kb""")
def s11_knowledge_scan(spark, folder):
    kb = A.knowledge_table(spark, folder)
    coded = kb.withColumn("tags", F.to_json(F.array(F.lower("topic"), "country")))
    return decode_entries(coded)


def manifest_payloads(spark, folder):
    """A manifest in JSON per event; of eleven one lacks its genre, one has a nameless entity,
    one is no JSON, and one calls the entity kind `category`."""
    events = A.table(spark, folder, "events")
    n = F.col("event_id") % 11
    kind = F.when(n == 3, F.lit("category")).otherwise(F.lit("type"))
    name = F.concat(F.lit("User "), F.col("user_id").cast("string"))
    entity = F.concat(
        F.lit('{"'), F.when(n == 1, F.lit("nam")).otherwise(F.lit("name")), F.lit('": "'), name,
        F.lit('", "'), kind, F.lit('": "Person", "common_misspellings": ["user'),
        F.col("user_id").cast("string"), F.lit('"]}'),
    )
    payload = F.concat(
        F.lit('{"topic": "'), F.col("event_type"), F.lit('", '),
        F.when(n == 0, F.lit("")).otherwise(F.lit('"genre": "Log", ')),
        F.when(n == 4, F.lit('"country": "Spain", ')).otherwise(F.lit("")),
        F.lit('"summary": "s", "entities": ['), entity, F.lit('], "style_guide": "Strict"'),
        F.when(n == 2, F.lit("")).otherwise(F.lit("}")),
    )
    return events.select(F.col("event_id").cast("string").alias("doc_id"), payload.alias("payload"))


@query("s13_manifest_ingest", """SELECT CAST(event_id AS VARCHAR) AS doc_id,
  event_id % 11 IN (0, 1, 2) AS is_fallback,
  CASE WHEN event_id % 11 IN (0, 1, 2) THEN 'General' ELSE event_type END AS topic,
  CASE WHEN event_id % 11 IN (0, 1, 2) THEN 'Unknown' ELSE 'Log' END AS genre,
  CASE WHEN event_id % 11 = 4 THEN 'Spain' ELSE 'General' END AS country,
  CASE WHEN event_id % 11 NOT IN (0, 1, 2) THEN 'User ' || user_id END AS entity_name,
  CASE WHEN event_id % 11 NOT IN (0, 1, 2) THEN 'Person' END AS entity_type
FROM events""")
def s13_manifest_ingest(spark, folder):
    read = payloads.read_manifests(manifest_payloads(spark, folder))
    first = F.get(F.col("manifest.entities"), F.lit(0))
    return read.select(
        "doc_id", "is_fallback", F.col("manifest.topic").alias("topic"),
        F.col("manifest.genre").alias("genre"), F.col("manifest.country").alias("country"),
        first["name"].alias("entity_name"), first["type"].alias("entity_type"),
    )


def proposal_payloads(spark, folder):
    """Two proposals in JSON per conversation turn; some items or payloads are malformed."""
    turns = A.table(spark, folder, "conversations")
    n = F.col("conv_id") * 3 + F.col("turn")
    number = (F.col("turn") + 1).cast("string")
    first = F.concat(
        F.lit('{"segment_id": '), F.when(n % 4 == 0, F.concat(F.lit('"'), number, F.lit('"')))
        .when(n % 4 == 1, F.lit('"twelve"')).otherwise(number),
        F.lit(', "original_text": "'), F.col("role"), F.lit('", "corrected_text": "x", '),
        F.lit('"type": "entity", "reason": "r"}'),
    )
    second = F.when(n % 5 == 0, F.lit('"loose text"')).otherwise(F.concat(
        F.lit('{"segment_id": '), number,
        F.lit(', "original_text": "a", "corrected_text": "b", "type": "grammar"'),
        F.when(n % 5 == 1, F.lit("}")).otherwise(F.lit(', "reason": "q"}')),
    ))
    body = F.concat(F.lit('{"corrections": ['), first, F.lit(", "), second, F.lit("]"))
    return turns.select(
        F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("chunk_no"),
        F.when(n % 13 == 0, body).otherwise(F.concat(body, F.lit("}"))).alias("payload"),
    )


_ITEMS_SQL = """items AS (
  SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn AS chunk_no, 0 AS prop_no,
    turn + 1 AS segment_id, role AS original_text, 'x' AS corrected_text, 'entity' AS type,
    'r' AS reason, (conv_id * 3 + turn) % 4 <> 1 AS complete, conv_id * 3 + turn AS n
  FROM conversations
  UNION ALL SELECT CAST(conv_id AS VARCHAR), turn, 1, turn + 1, 'a', 'b', 'grammar', 'q',
    (conv_id * 3 + turn) % 5 > 1, conv_id * 3 + turn FROM conversations)"""


@query("s14_proposal_ingest", f"""WITH {_ITEMS_SQL}
SELECT doc_id, chunk_no, prop_no, segment_id, original_text, corrected_text, type, reason
FROM items WHERE complete AND n % 13 <> 0""")
def s14_proposal_ingest(spark, folder):
    return payloads.read_proposals(proposal_payloads(spark, folder))


@query("s14_malformed_proposals", f"""WITH {_ITEMS_SQL}
SELECT doc_id, chunk_no, prop_no FROM items WHERE NOT complete AND n % 13 <> 0""")
def s14_malformed_proposals(spark, folder):
    bad = payloads.malformed_proposals(proposal_payloads(spark, folder))
    return bad.select("doc_id", "chunk_no", "prop_no")


@query("p01_segment_lookup", f"""{with_views('seg_docs')}
SELECT doc_id, idx, text, hex(encode(text)) AS text_hex FROM seg WHERE idx = 3""")
def p01_segment_lookup(spark, folder):
    seg = A.document_segments(spark, folder)
    return seg.where(F.col("idx") == 3).select(
        "doc_id", "idx", "text", F.hex(F.encode("text", "UTF-8")).alias("text_hex")
    )
