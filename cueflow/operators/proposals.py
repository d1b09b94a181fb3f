"""Proposed corrections: chunks, matching, strict application and split repair.

The unit of work is one row per chunk (at most 30 cues), so edits that cross a cue boundary need
no second shuffle. Everything is built-in expressions: cues are folded for themselves, and a chunk
with a proposal that did not fit is folded again as a whole, over the texts of all its cues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow import constants as K
from cueflow.functions.text import let, lstrip, rstrip, squash, strip

FORWARD_NOTE = " (Split Segment Fix)"
BACKWARD_NOTE = " (Backward Split Fix)"


def chunk_number() -> Column:
    return F.floor(F.col("pos") / K.CHUNK_CUES).cast("long")


def effective_proposals(proposals: DataFrame) -> DataFrame:
    """Proposals that would change something."""
    return proposals.where(F.col("original_text") != F.col("corrected_text"))


def matched_proposals(segments: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposals with the segment of their chunk they point to."""
    cues = segments.withColumn("chunk_no", chunk_number())
    keyed = proposals.withColumnRenamed("segment_id", "idx")
    return cues.join(keyed, ["doc_id", "chunk_no", "idx"])


def stray_proposals(segments: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposals for a segment number their chunk does not have."""
    cues = segments.select("doc_id", chunk_number().alias("chunk_no"),
                           F.col("idx").alias("segment_id")).distinct()
    return proposals.join(cues, ["doc_id", "chunk_no", "segment_id"], "left_anti")


def with_neighbours(segments: DataFrame) -> DataFrame:
    """Text of the segments numbered idx+1 and idx-1 in the same chunk (the last one of a number).

    The neighbours travel with the chunk's own rows: each segment is sent to the two numbers next
    to it, so one shuffle on (doc_id, chunk_no, idx) brings all three together.
    """
    cues = segments.withColumn("chunk_no", chunk_number())
    latest = cues.groupBy("doc_id", "chunk_no", "idx").agg(F.max_by("text", "pos").alias("text"))
    sent = latest.select(
        "doc_id", "chunk_no",
        F.inline(F.array(
            F.struct((F.col("idx") - 1).alias("idx"), F.col("text").alias("next_text"),
                     F.lit(None).cast("string").alias("prev_text")),
            F.struct((F.col("idx") + 1).alias("idx"), F.lit(None).cast("string").alias("next_text"),
                     F.col("text").alias("prev_text")),
        )),
    )
    around = sent.groupBy("doc_id", "chunk_no", "idx").agg(
        F.max("next_text").alias("next_text"), F.max("prev_text").alias("prev_text")
    )
    return cues.join(around, ["doc_id", "chunk_no", "idx"], "left")


def ordered_for_segment(matched: DataFrame) -> DataFrame:
    """Rank of each proposal at its segment: longest original first, then list order."""
    order = F.struct((-F.length("original_text")).alias("l"), F.col("prop_no").alias("p"))
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), "prop_no")))
    return matched.groupBy("doc_id", "chunk_no", "pos", "idx").agg(rows.alias("rows")).select(
        "doc_id", "chunk_no", "pos", "idx",
        F.posexplode(F.transform("rows", lambda r: r["prop_no"])).alias("rank", "prop_no"),
    )


def last_by_number(segments: DataFrame) -> DataFrame:
    """The last segment of each number, the one lookups by number find."""
    return segments.groupBy("doc_id", "idx").agg(
        F.max("pos").alias("pos"), F.max_by("text", "pos").alias("text")
    )


def _chunks(segments: DataFrame) -> DataFrame:
    cue = F.struct("pos", "idx", "start_ms", "end_ms", "text")
    return segments.groupBy("doc_id", chunk_number().alias("chunk_no")).agg(
        F.array_sort(F.collect_list(cue)).alias("cues")
    )


def _chunk_proposals(proposals: DataFrame) -> DataFrame:
    """Proposals of each chunk, longest original first. An empty original can match nothing."""
    p = F.struct(
        (-F.length("original_text")).alias("order"), F.col("prop_no").cast("int").alias("prop_no"),
        F.col("segment_id").cast("long").alias("segment_id"),
        F.col("original_text").alias("original"), F.col("corrected_text").alias("corrected"),
        F.col("type"), F.col("reason"),
    )
    return proposals.where(F.col("original_text") != "").groupBy("doc_id", "chunk_no").agg(
        F.array_sort(F.collect_list(p)).alias("props")
    )


def _exact_fold(cue: Column, props: Column) -> Column:
    """One cue after its proposals: text, numbers of the applied ones, whether one did not fit."""
    start = F.struct(
        cue["text"].alias("text"), F.array().cast("array<int>").alias("applied"),
        F.lit(False).alias("missed"),
    )

    def step(acc: Column, p: Column) -> Column:
        found = F.contains(acc["text"], p["original"])
        applies = found & (p["original"] != p["corrected"])
        return F.struct(
            F.when(applies, F.replace(acc["text"], p["original"], p["corrected"]))
            .otherwise(acc["text"]).alias("text"),
            F.when(applies, F.concat(acc["applied"], F.array(p["prop_no"])))
            .otherwise(acc["applied"]).alias("applied"),
            (acc["missed"] | ~found).alias("missed"),
        )

    return F.aggregate(F.filter(props, lambda p: p["segment_id"] == cue["idx"]), start, step)


def _seam(earlier: Column, later: Column, original: Column, cuts: Column) -> Column:
    """What is left of two texts when `original` ends the one and begins the other.

    The first of `cuts` at which both halves of the original fit decides: (kept, rest), the earlier
    text before its half and the later one behind its own; null where none fits.
    """
    def halves(cut: Column) -> Column:
        return F.struct(strip(F.left(original, cut)).alias("left"),
                        strip(F.substr(original, cut + 1)).alias("right"))

    def seam(ends: Column) -> Column:
        fitting = F.filter(
            F.transform(cuts, halves),
            lambda h: ((h["left"] != "") | (h["right"] != ""))
            & F.endswith(ends["end"], h["left"]) & F.startswith(ends["begin"], h["right"]))
        return let(F.get(fitting, F.lit(0)), lambda h: F.when(h.isNotNull(), F.struct(
            F.left(ends["end"], F.length(ends["end"]) - F.length(h["left"])).alias("kept"),
            strip(F.substr(ends["begin"], F.length(h["right"]) + 1)).alias("rest"))))

    together = F.contains(squash(F.concat_ws(" ", earlier, later)), squash(original))
    ends = F.struct(rstrip(earlier).alias("end"), lstrip(later).alias("begin"))
    return F.when(together, let(ends, seam))


def _cuts(original: Column, forward: bool) -> Column:
    """Where to cut an original in two: forward the longest left half first, down to one without a
    right half; backward the shortest first, both halves with something in them."""
    n = F.length(original)
    if forward:
        return F.filter(F.sequence(n, F.lit(1), F.lit(-1)),
                        lambda c: strip(F.left(original, c)) != "")
    inner = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(inner, lambda c: (strip(F.left(original, c)) != "")
                    & (strip(F.substr(original, c + 1)) != ""))


def _place_of(number: Column) -> Column:
    """Place of the last cue with this number in the chunk, or null."""
    return F.array_max(F.transform("cues", lambda c, i: F.when(c["idx"] == number, i)))


def _steps() -> Column:
    """Proposals in the order of their cues, each with the places of its cue and of its neighbours."""
    def of_cue(cue: Column, at: Column) -> Column:
        near = F.struct(_place_of(cue["idx"] + 1).alias("after"),
                        _place_of(cue["idx"] - 1).alias("before"))
        own = F.filter("props", lambda p: p["segment_id"] == cue["idx"])
        return F.when(F.size(own) > 0, let(near, lambda n: F.transform(own, lambda p: F.struct(
            at.alias("at"), n["after"].alias("after"), n["before"].alias("before"),
            p["prop_no"].alias("prop_no"), p["original"].alias("original"),
            p["corrected"].alias("corrected")))))

    return F.flatten(F.filter(F.transform("cues", of_cue), lambda own: own.isNotNull()))


def _chunk_fold() -> Column:
    """Texts and applied (prop_no, note) of a chunk, with repair across cue boundaries."""
    start = F.struct(
        F.transform("cues", lambda c: c["text"]).alias("texts"),
        F.array().cast("array<struct<prop_no:int,note:string>>").alias("applied"))

    def edit(texts: Column, s: Column) -> Column:
        """(first, second, kept, rest, note) of a step; `second` is null for a plain hit."""
        def split(first: Column, second: Column, forward: bool, note: str) -> Column:
            seam = _seam(F.get(texts, first), F.get(texts, second), s["original"],
                         _cuts(s["original"], forward))
            return let(seam, lambda m: F.when(m.isNotNull(), F.struct(
                first.alias("first"), second.alias("second"),
                F.concat(m["kept"], s["corrected"]).alias("kept"), m["rest"].alias("rest"),
                F.lit(note).alias("note"))))

        def of(text: Column) -> Column:
            plain = F.when(s["original"] != s["corrected"], F.struct(
                s["at"].alias("first"), F.lit(None).cast("int").alias("second"),
                F.replace(text, s["original"], s["corrected"]).alias("kept"),
                F.lit(None).cast("string").alias("rest"), F.lit("").alias("note")))
            return (
                F.when(F.contains(text, s["original"]), plain)
                .when(s["after"].isNotNull(), split(s["at"], s["after"], True, FORWARD_NOTE))
                .when(s["before"].isNotNull(), split(s["before"], s["at"], False, BACKWARD_NOTE)))

        return let(F.get(texts, s["at"]), of)

    def step(acc: Column, s: Column) -> Column:
        def taken(e: Column) -> Column:
            texts = F.transform(acc["texts"], lambda t, i: F.when(i == e["first"], e["kept"]).when(
                i == e["second"], e["rest"]).otherwise(t))
            done = F.struct(s["prop_no"].alias("prop_no"), e["note"].alias("note"))
            return F.when(e.isNull(), acc).otherwise(F.struct(
                texts.alias("texts"), F.concat(acc["applied"], F.array(done)).alias("applied")))

        return let(edit(acc["texts"], s), taken)

    return F.aggregate(_steps(), start, step)


def correct_chunks(
    segments: DataFrame, proposals: DataFrame, repair_splits: bool = True
) -> DataFrame:
    """Chunks after their proposals: (doc_id, chunk_no, cues, props, texts, applied).

    `applied` lists (prop_no, note) in the order of application.
    """
    props_type = (
        "array<struct<order:int,prop_no:int,segment_id:bigint,original:string,corrected:string,"
        "type:string,reason:string>>"
    )
    # Both sides come grouped by the join key, so a merge join moves nothing.
    chunks = _chunks(segments).join(
        _chunk_proposals(proposals).hint("merge"), ["doc_id", "chunk_no"], "left"
    )
    props = F.coalesce(F.col("props"), F.array().cast(props_type))
    folded = chunks.withColumn("props", props).withColumn(
        "folds", F.transform("cues", lambda cue: _exact_fold(cue, F.col("props")))
    )
    exact_applied = F.flatten(F.transform(
        "folds",
        lambda f: F.transform(
            f["applied"], lambda n: F.struct(n.alias("prop_no"), F.lit("").alias("note"))
        ),
    ))
    exact_texts = F.transform("folds", lambda f: f["text"])
    if not repair_splits:
        return folded.withColumn("texts", exact_texts).withColumn("applied", exact_applied).drop(
            "folds"
        )
    repaired = folded.withColumn(
        "repaired", F.when(F.exists("folds", lambda f: f["missed"]), _chunk_fold()))
    return (
        repaired.withColumn("texts", F.coalesce("repaired.texts", exact_texts))
        .withColumn("applied", F.coalesce("repaired.applied", exact_applied))
        .drop("folds", "repaired")
    )


def corrected_segments(chunks: DataFrame) -> DataFrame:
    rows = F.transform(
        "cues",
        lambda cue, i: F.struct(
            cue["pos"].alias("pos"), cue["idx"].alias("idx"), cue["start_ms"].alias("start_ms"),
            cue["end_ms"].alias("end_ms"), F.get(F.col("texts"), i).alias("text"),
        ),
    )
    return chunks.select("doc_id", F.inline(rows))


def applied_proposals(chunks: DataFrame) -> DataFrame:
    """Applied proposals in order; the reason of a split repair says so."""
    listed = chunks.select(
        "doc_id", "chunk_no", "props", F.posexplode("applied").alias("apply_no", "a")
    )
    proposal = let(
        F.filter("props", lambda p: p["prop_no"] == F.col("a.prop_no")),
        lambda hits: F.get(hits, F.lit(0)),
    )
    return listed.select(
        "doc_id", "chunk_no", "apply_no", F.col("a.prop_no").alias("prop_no"),
        proposal.alias("p"), F.col("a.note").alias("note"),
    ).select(
        "doc_id", "chunk_no", "apply_no", "prop_no", F.col("p.segment_id").alias("segment_id"),
        F.col("p.original").alias("original_text"), F.col("p.corrected").alias("corrected_text"),
        F.col("p.type").alias("type"), F.concat("p.reason", "note").alias("reason"),
    )


def rejected_proposals(chunks: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposals that changed nothing."""
    used = chunks.select("doc_id", "chunk_no", F.explode("applied.prop_no").alias("prop_no"))
    return proposals.join(used.distinct(), ["doc_id", "chunk_no", "prop_no"], "left_anti")
