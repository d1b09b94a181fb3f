"""JSON payloads of a correction model: manifests and proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow import constants as K

ENTITY = "struct<name:string,type:string,description:string,common_misspellings:array<string>>"
MANIFEST = (
    "struct<topic:string,genre:string,industry:string,country:string,dialect:string,"
    f"summary:string,entities:array<{ENTITY}>,preservation_list:array<string>,"
    "style_guide:string>"
)
_RAW_MANIFEST = (
    "topic string, genre string, industry string, country string, dialect string, "
    "summary string, entities array<struct<name:string,type:string,category:string,"
    "description:string,common_misspellings:array<string>>>, "
    "preservation_list array<string>, style_guide string"
)
_RAW_PROPOSAL = (
    "segment_id string, original_text string, corrected_text string, type string, reason string"
)


def _kind(json: Column, path: str) -> Column:
    """JSON type of a field, as Spark names it; null where it is missing."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), path, "variant"))


def _is_text(json: Column, name: str, optional: bool = False) -> Column:
    """Whether a field is a JSON string (or, if optional, missing or null)."""
    kind = _kind(json, f"$.{name}")
    if optional:
        return F.coalesce(kind.isin("STRING", "VOID"), F.lit(True))
    return F.coalesce(kind == "STRING", F.lit(False))


def fallback_manifest() -> Column:
    fixed = K.FALLBACK_MANIFEST
    return F.struct(
        *[F.lit(fixed[n]).alias(n) for n in
          ["topic", "genre", "industry", "country", "dialect", "summary"]],
        F.array().cast(f"array<{ENTITY}>").alias("entities"),
        F.array().cast("array<string>").alias("preservation_list"),
        F.lit(fixed["style_guide"]).alias("style_guide"),
    )


def read_manifests(payloads: DataFrame) -> DataFrame:
    """Manifests from (doc_id, payload): `manifest` and whether it is the fallback.

    A payload lacking any required field, or with one that is not a JSON string, also in one entity,
    gives the fallback as a whole. An entity may name its kind `type` or `category`.
    """
    raw = payloads.withColumn("raw", F.from_json("payload", _RAW_MANIFEST))
    r = F.col("raw")
    entities = F.transform(
        r["entities"],
        lambda e: F.struct(
            e["name"].alias("name"),
            F.coalesce(e["type"], e["category"]).alias("type"),
            e["description"].alias("description"),
            F.coalesce(e["common_misspellings"], F.array().cast("array<string>"))
            .alias("common_misspellings"),
        ),
    )
    complete = F.lit(True)
    for name in ["topic", "genre", "summary", "entities", "style_guide"]:
        complete = complete & r[name].isNotNull()
    for name in ["topic", "genre", "summary", "style_guide"]:
        complete = complete & _is_text(F.col("payload"), name)
    for name in ["industry", "country", "dialect"]:
        complete = complete & _is_text(F.col("payload"), name, optional=True)
    items = F.from_json("payload", "entities array<string>")["entities"]
    whole = complete & F.forall(
        entities, lambda e: e["name"].isNotNull() & e["type"].isNotNull()
    ) & F.forall(items, lambda i: _is_text(i, "name") & (
        _is_text(i, "type") | _is_text(i, "category")))
    usable = F.coalesce(whole, F.lit(False))

    def defaulted(name: str) -> Column:
        return F.coalesce(r[name], F.lit(K.FALLBACK_MANIFEST[name])).alias(name)

    manifest = F.struct(
        r["topic"].alias("topic"), r["genre"].alias("genre"), defaulted("industry"),
        defaulted("country"), defaulted("dialect"), r["summary"].alias("summary"),
        entities.alias("entities"),
        F.coalesce(r["preservation_list"], F.array().cast("array<string>"))
        .alias("preservation_list"),
        r["style_guide"].alias("style_guide"),
    )
    return raw.select(
        "doc_id",
        F.when(usable, manifest).otherwise(fallback_manifest()).alias("manifest"),
        (~usable).alias("is_fallback"),
    )


def _read_items(payloads: DataFrame) -> DataFrame:
    items = F.from_json("payload", "corrections array<string>")["corrections"]
    exploded = payloads.select("doc_id", "chunk_no", F.posexplode(items).alias("prop_no", "item"))
    parsed = exploded.withColumn("p", F.from_json("item", _RAW_PROPOSAL))
    number = F.col("p.segment_id").try_cast("double")
    segment_id = F.when(number == F.floor(number), number.cast("long"))
    complete = segment_id.isNotNull()
    for name in ["original_text", "corrected_text", "type", "reason"]:
        complete = complete & _is_text(F.col("item"), name)
    return parsed.select(
        "doc_id", "chunk_no", "prop_no", "item", segment_id.alias("segment_id"),
        F.col("p.original_text").alias("original_text"),
        F.col("p.corrected_text").alias("corrected_text"),
        F.col("p.type").alias("type"), F.col("p.reason").alias("reason"),
        F.coalesce(complete, F.lit(False)).alias("complete"),
    )


def read_proposals(payloads: DataFrame) -> DataFrame:
    """Proposals from (doc_id, chunk_no, payload); unreadable payloads and items give no rows."""
    return _read_items(payloads).where("complete").drop("complete", "item")


def malformed_proposals(payloads: DataFrame) -> DataFrame:
    return _read_items(payloads).where(~F.col("complete")).select(
        "doc_id", "chunk_no", "prop_no", "item"
    )
