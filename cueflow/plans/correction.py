"""Correction of a corpus: parse, apply proposals, enforce spelling, compare, render."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.operators import consistency, diffs, knowledge, proposals as P
from cueflow.session import settle
from cueflow.sources import codec


@dataclass(frozen=True)
class Correction:
    """Lazy results of one correction run."""

    corrected: DataFrame
    applied: DataFrame
    changes: DataFrame

    def content(self, timecode: str = "srt") -> DataFrame:
        return codec.render_corrected(self.corrected, timecode)

    def first_changes(self) -> DataFrame:
        return diffs.first_changes(self.changes)


def correct_segments(
    segments: DataFrame,
    proposals: DataFrame,
    kb: DataFrame,
    manifests: DataFrame | None = None,
    repair_splits: bool = True,
) -> Correction:
    """Segments after proposals and spelling rules.

    Manifests and proposals are input tables, so any model runner can produce them; documents
    without proposals only see the spelling rules.
    """
    chunks = P.correct_chunks(segments, proposals, repair_splits)
    rules = knowledge.corpus_rules(kb)
    own = None if manifests is None else knowledge.document_rules(manifests, kb)
    corrected = consistency.enforce_rules(P.corrected_segments(chunks), rules, own)
    return Correction(
        corrected=corrected,
        applied=P.applied_proposals(chunks),
        changes=diffs.changed_segments(segments, corrected),
    )


def document_contents(docs: DataFrame, rendered: DataFrame) -> DataFrame:
    """Rendered parts of each document; one without any segment keeps its content as it is."""
    untouched = docs.select("doc_id", "content").join(
        rendered.select("doc_id").distinct(), "doc_id", "left_anti"
    )
    kept = untouched.select("doc_id", F.lit(0).cast("long").alias("part_no"), "content")
    return rendered.unionByName(kept)


def correct_documents(
    docs: DataFrame,
    proposals: DataFrame,
    kb: DataFrame,
    manifests: DataFrame | None = None,
    timecode: str = "srt",
) -> DataFrame:
    """Subtitle text (doc_id, format, content) to corrected text, in parts (doc_id, part_no, content).

    A document without a cue, whatever the reason, comes back as it is.
    """
    segments = settle(codec.parse(docs), "cues")
    run = correct_segments(segments, proposals, kb, manifests)
    return document_contents(docs, run.content(timecode))


def learn_corrections(
    original: DataFrame,
    corrected: DataFrame,
    kb: DataFrame,
    topic: str = "general",
    industry: str = "general",
    country: str = "general",
) -> DataFrame:
    """The KB after learning from approved versions of documents."""
    pairs = diffs.aligned_segments(original, corrected)
    batch = diffs.learning_batch(diffs.learned_pairs(pairs), topic, industry, country)
    return knowledge.upsert(kb, batch)
