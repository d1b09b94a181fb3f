"""Request rows for an external correction model: one per chunk, built from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow import constants as K
from cueflow.functions.skew import join_spread
from cueflow.operators.knowledge import entry_lines, top_entries
from cueflow.operators.proposals import chunk_number
from cueflow.sources.payloads import fallback_manifest


def sorted_entities(manifest: Column) -> Column:
    """Entities by name; those of the same name keep their order."""
    numbered = F.transform(
        manifest["entities"],
        lambda e, i: F.struct(e["name"].alias("name"), i.alias("i"), e.alias("e")),
    )
    ordered = F.array_sort(
        numbered,
        lambda a, b: F.when((a["name"] < b["name"]), -1).when(a["name"] > b["name"], 1)
        .otherwise(a["i"] - b["i"]),
    )
    return F.transform(ordered, lambda x: x["e"])


def entity_lines(manifest: Column) -> Column:
    return F.array_join(
        F.transform(
            sorted_entities(manifest),
            lambda e: F.concat(
                F.lit("- "), e["name"], F.lit(" ("), e["type"], F.lit("): "),
                F.coalesce(e["description"], F.lit("")), F.lit(" (Watch out for: "),
                F.array_join(e["common_misspellings"], ", "), F.lit(")"),
            ),
        ),
        "\n",
    )


def shown_preserved_terms(manifest: Column) -> Column:
    return F.array_join(F.slice(manifest["preservation_list"], 1, K.PRESERVED_SHOWN), ", ")


def manifest_block(manifest: Column) -> Column:
    """The manifest as labelled lines, the same for every chunk of a document."""
    # Fixed labels of the request format.
    labelled = [
        ("TOPIC", manifest["topic"]),
        ("GENRE", manifest["genre"]),
        ("INDUSTRY", manifest["industry"]),
        ("COUNTRY", manifest["country"]),
        ("DIALECT", manifest["dialect"]),
        ("STYLE", manifest["style_guide"]),
        ("PRESERVE TERMS (DO NOT CORRECT)", F.array_join(manifest["preservation_list"], ", ")),
    ]
    parts = [F.lit("\n")]
    for label, value in labelled:
        parts += [F.lit(f"{label}: "), value, F.lit("\n")]
    return F.concat(*parts, F.lit("KEY ENTITIES:\n"), entity_lines(manifest), F.lit("\n"))


def chunk_lines(segments: DataFrame) -> DataFrame:
    """`[idx] text` lines of each chunk."""
    line = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), "text", F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return segments.groupBy("doc_id", chunk_number().alias("chunk_no")).agg(
        F.array_join(F.transform(rows, lambda r: r["line"]), "").alias("chunk_text")
    )


def prompt_requests(segments: DataFrame, manifests: DataFrame, kb: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, chunk_text, manifest_text, kb_lines, preserved_terms) of every chunk.

    KB lines are worked out once per distinct context and joined to the documents, not per chunk.
    """
    m = F.coalesce("manifest", fallback_manifest())
    context = ["topic", "industry", "country"]
    # a document without a manifest gets the fallback
    per_doc = segments.select("doc_id").distinct().join(manifests, "doc_id", "left").select(
        "doc_id", manifest_block(m).alias("manifest_text"),
        shown_preserved_terms(m).alias("preserved_terms"),
        *[F.lower(m[c]).alias(c) for c in context],
    )
    lines = entry_lines(top_entries(kb, per_doc))
    documents = per_doc.join(lines, context, "left").select(
        "doc_id", "manifest_text", "preserved_terms",
        F.coalesce("kb_lines", F.lit("")).alias("kb_lines"),
    )
    return join_spread(chunk_lines(segments), documents, ["doc_id"], "inner", by=["chunk_no"])
