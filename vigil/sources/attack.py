"""Attack-knowledge bundles in STIX 2.1."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import vocab
from vigil.functions.text import parse_dt, trimmed
from vigil.sources.common import require, split_rejects

# What an object may carry, by kind; each is read on its own, so a field of an odd type costs that field alone.
FIELDS = {
    "type": "string", "id": "string", "name": "string", "description": "string", "created": "string", "modified": "string",
    "revoked": "boolean", "x_mitre_deprecated": "boolean", "x_mitre_platforms": "array<string>", "x_mitre_shortname": "string",
    "x_mitre_is_subtechnique": "boolean", "aliases": "array<string>", "x_mitre_aliases": "array<string>",
    "kill_chain_phases": "array<struct<kill_chain_name:string,phase_name:string>>",
    "external_references": "array<struct<source_name:string,external_id:string,url:string>>", "tactic_refs": "array<string>",
    "relationship_type": "string", "source_ref": "string", "target_ref": "string", "x_mitre_analytic_refs": "array<string>",
    "x_mitre_log_source_references": "array<struct<x_mitre_data_component_ref:string,name:string,channel:string>>",
    "x_mitre_mutable_elements": "array<struct<field:string>>", "x_mitre_log_sources": "array<struct<name:string,channel:string>>",
    "x_mitre_detection": "string", "first_seen": "string", "last_seen": "string"}
_LOG = "array<struct<data_component:string,name:string,channel:string>>"


class Bundle(NamedTuple):
    objects: DataFrame
    relationships: DataFrame
    rejects: DataFrame


def read_attack(spark: SparkSession, path: str) -> Bundle:
    """Bundles of any number of files. Objects differ by kind, so they are read as VARIANT instead of one schema for all."""
    bundle = spark.read.schema("objects array<variant>").json(path, multiLine=True)
    require(bundle.filter(F.col("objects").isNotNull()), "bundle has no 'objects' list")
    return parse_bundle(bundle.select(F.explode("objects").alias("object")))


def parse_bundle(rows: DataFrame) -> Bundle:
    """``object`` (variant, null where it was no JSON) to the knowledge base's tables; odd objects are rejects with a reason."""
    typed = rows.select("object", *[F.try_variant_get("object", f"$.{name}", kind).alias(name) for name, kind in FIELDS.items()])
    shape = F.schema_of_variant("object")
    known = F.col("type").isin(*vocab.STIX_TYPES, "relationship")
    odd = F.array_compact(F.array(*[
        F.when(F.variant_get("object", f"$.{name}", "variant").isNotNull() & ~F.is_variant_null(F.variant_get("object", f"$.{name}", "variant"))
               & F.col(name).isNull(), F.lit(name)) for name in FIELDS if name not in ("type", "id", "name")]))
    reason = (F.when(F.col("object").isNull(), "object is not JSON").when(~F.startswith(shape, F.lit("OBJECT<")), "object is not a mapping")
              .when(F.coalesce("type", F.lit("")) == "", "object has no type").when(known & (F.coalesce("id", F.lit("")) == ""), "object has no id")
              .when(known & (F.col("type") != "relationship") & (F.coalesce("name", F.lit("")) == ""), "object has no name"))
    parsed = split_rejects(typed, "mitre_attack", reason, F.substring(F.to_json("object"), 1, 500))
    strange = parsed.good.filter(known & (F.size(odd) > 0)).select(
        F.lit("mitre_attack").alias("source_key"), F.concat(F.lit("fields of another type: "), F.array_join(odd, ", ")).alias("reason"), F.col("id").alias("record"))
    objects, relationships = parse_attack(parsed.good.drop("object"))
    return Bundle(objects, relationships, parsed.rejects.unionByName(strange))


def clean_description(col: Column) -> Column:
    """Drop citations and tags, turn Markdown links into their text, squeeze blanks."""
    text = F.regexp_replace(col, r"\(Citation:[^)]*\)", "")
    text = F.regexp_replace(text, r"\[([^\]]+)\]\((?:https?://[^)]+)\)", "$1")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    return F.when(col != "", F.trim(F.regexp_replace(text, r"[ \t]+", " ")))


def _strings() -> Column:
    return F.array().cast("array<string>")


def parse_attack(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, relationships) of rows that carry ``FIELDS``."""
    order = objects.filter(F.col("type") == "x-mitre-matrix").select(
        F.posexplode("tactic_refs").alias("tactic_order", "tactic_ref")
    ).groupBy("tactic_ref").agg(F.max("tactic_order").alias("tactic_order"))
    types = F.create_map(*[F.lit(x) for pair in vocab.STIX_TYPES.items() for x in pair])
    ref = F.get(F.filter("external_references", lambda r: r["source_name"].isin(vocab.MITRE_REFERENCE_SOURCES)), F.lit(0))
    is_sub = F.coalesce("x_mitre_is_subtechnique", F.lit(False))
    kind = F.col("obj_type")
    aliases = F.when(F.size("aliases") > 0, F.col("aliases")).otherwise(F.coalesce("x_mitre_aliases", _strings()))
    logs = F.when(kind == "analytic", F.transform("x_mitre_log_source_references", lambda r: F.struct(
        r["x_mitre_data_component_ref"].alias("data_component"), r["name"].alias("name"),
        r["channel"].alias("channel")))).when(
        kind == "data_component", F.transform("x_mitre_log_sources", lambda r: F.struct(
            F.lit(None).cast("string").alias("data_component"), r["name"].alias("name"),
            r["channel"].alias("channel"))))
    typed = objects.withColumn("obj_type", F.try_element_at(types, F.col("type"))).filter(
        F.col("obj_type").isNotNull() & (F.col("id") != "") & (F.col("name") != "")).join(
        order, F.col("id") == F.col("tactic_ref"), "left")
    parsed = typed.select(
        F.col("id").alias("stix_id"), "obj_type", trimmed(ref["external_id"]).alias("external_id"),
        trimmed(F.col("name")).alias("name"), clean_description(F.col("description")).alias("description"),
        F.filter(aliases, lambda a: a != F.col("name")).alias("aliases"),
        F.coalesce("x_mitre_platforms", _strings()).alias("platforms"),
        F.coalesce(F.transform(F.filter("kill_chain_phases", lambda p: p["kill_chain_name"] == "mitre-attack"),
                               lambda p: p["phase_name"]), _strings()).alias("tactics"),
        trimmed(F.col("x_mitre_shortname")).alias("shortname"), is_sub.alias("is_subtechnique"),
        F.when(is_sub, F.substring_index(ref["external_id"], ".", 1)).alias("parent_external_id"),
        ref["url"].alias("url"), F.coalesce("x_mitre_deprecated", F.lit(False)).alias("deprecated"),
        F.coalesce("revoked", F.lit(False)).alias("revoked"), parse_dt(F.col("created")).alias("created"),
        parse_dt(F.col("modified")).alias("modified"),
        F.struct(
            logs.cast(_LOG).alias("log_sources"),
            F.when(kind == "analytic", F.transform("x_mitre_mutable_elements", lambda m: m["field"])).alias("mutable_elements"),
            F.when(kind == "detection_strategy", F.col("x_mitre_analytic_refs")).alias("analytic_refs"),
            F.when(kind == "campaign", F.col("first_seen")).alias("first_seen"),
            F.when(kind == "campaign", F.col("last_seen")).alias("last_seen"),
            F.when(kind == "tactic", F.coalesce("tactic_order", F.lit(99))).alias("order"),
            F.when(kind == "technique", clean_description(F.col("x_mitre_detection"))).alias("detection"),
        ).alias("extra"))
    relationships = objects.filter(
        (F.col("type") == "relationship") & F.col("relationship_type").isin(vocab.KEPT_RELATIONSHIPS)
        & ~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False))
        & (F.col("source_ref") != "") & (F.col("target_ref") != "")
    ).select(
        F.col("id").alias("stix_id"), "relationship_type",
        "source_ref", "target_ref",
        clean_description(F.col("description")).alias("description"))
    return parsed, relationships
