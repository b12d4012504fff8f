"""Explainable edges between documents, exploits, rules and what they name."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import vocab
from vigil.functions.extract import exploitation_phrase, find_cves, find_techniques
from vigil.functions.text import snippet
from vigil.operators.merge import missing_rows
from vigil.operators.names import NameTable, find_names

EDGE_KEY = ["subject_type", "subject_id", "object_type", "object_id", "relation"]
_RAW = ("array<struct<object_type:string,object_key:string,relation:string,method:string,confidence:string,"
        "evidence:string,pos:int>>")


class Extracted(NamedTuple):
    documents: DataFrame
    edges: DataFrame


def _raw_edges(text: Column, low: Column) -> Column:
    """All edges of one document as an array, so the text is read once."""
    focused = F.size("cves") <= vocab.FOCUSED_MAX_CVES

    def edge(kind: str, key: Column, relation: str, method: str, confidence: Column, needle: Column, i: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("object_type"), key.alias("object_key"), F.lit(relation).alias("relation"),
            F.lit(method).alias("method"), confidence.alias("confidence"),
            F.substring(snippet(text, needle, lowered=low), 1, 500).alias("evidence"), i.alias("pos"))

    level = F.when(focused, "high").otherwise("low")
    mentions = F.transform("cves", lambda c, i: edge("cve", c, "mentions", "regex", level, c, i))
    reports = F.transform("cves", lambda c, i: edge(
        "cve", c, "reports_exploitation", "regex", F.lit("medium"), F.col("phrase"), i))
    reports = F.when(focused & F.col("phrase").isNotNull(), reports.cast(_RAW)).otherwise(F.array().cast(_RAW))
    techniques = F.transform("technique_ids", lambda t, i: edge(
        "technique", t, "mentions", "regex", F.lit("high"), t, i))
    named = F.transform("hits", lambda h, i: edge(
        "name", h, "mentions", "dictionary", F.lit("medium"), h, i))
    return F.concat(mentions.cast(_RAW), reports, techniques.cast(_RAW), named.cast(_RAW))


def extract(docs: DataFrame, table: NameTable, key: str = "url", body: str = "full_text") -> Extracted:
    """Edges of every document, and the documents with their exploitation flag and version.

    One scan of the text yields all finders' results; a single explode turns them into edges (the
    outer form, as Spark would evaluate the finders once more to skip empty arrays); one join with
    the (small) name table resolves names and technique ids.
    """
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))
    found = docs.withColumn("_text", text)
    found = find_names(found, [key], "_text", table.names).withColumns({
        "cves": find_cves(F.col("_text")), "technique_ids": find_techniques(F.col("_text")),
        "phrase": exploitation_phrase(F.col("_text")), "_low": F.lower("_text")})
    documents = found.withColumns({
        "reports_exploitation": F.col("phrase").isNotNull(), "extraction_version": F.lit(table.version)}
    ).drop("_text", "_low", "cves", "technique_ids", "phrase", "hits")
    rows = found.select(
        F.col(key).cast("string").alias("subject_id"), "source_key", F.col("published_at").alias("observed_at"),
        F.explode_outer(_raw_edges(F.col("_text"), F.col("_low"))).alias("e")).filter(F.col("e").isNotNull()).select(
        "subject_id", "source_key", "observed_at", "e.*")
    lookup = table.techniques.select(
        F.lit("technique").alias("object_type"), F.col("external_id").alias("look"), "stix_id").unionByName(
        table.names.select(F.lit("name").alias("object_type"), F.col("low").alias("look"), "stix_id").distinct())
    look = F.when(F.col("object_type") == "name", F.lower("object_key")).otherwise(F.col("object_key"))
    resolved = rows.withColumn("look", look).join(lookup, ["object_type", "look"], "left")
    is_cve = F.col("object_type") == "cve"
    edges = resolved.filter(is_cve | F.col("stix_id").isNotNull()).select(
        F.lit("document").alias("subject_type"), "subject_id",
        F.when(is_cve, "cve").otherwise("attack").alias("object_type"),
        F.when(is_cve, F.col("object_key")).otherwise(F.col("stix_id")).alias("object_id"), "relation", "method",
        "confidence", "source_key", F.when(F.col("evidence") != "", F.col("evidence")).alias("evidence"),
        "observed_at", "pos")
    # two spellings of one object in one document: the first one found stays
    first = F.min_by(F.struct("method", "confidence", "source_key", "evidence", "observed_at"), "pos")
    edges = edges.groupBy(*EDGE_KEY).agg(first.alias("f")).select(*EDGE_KEY, "f.*")
    return Extracted(documents, edges)


def new_edges(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """Edges are never changed once written; what the table does not have yet."""
    return missing_rows(snapshot, batch, EDGE_KEY, ["source_key", "method"])


def add_edges(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    return snapshot.unionByName(new_edges(snapshot, batch))


def with_flags(docs: DataFrame, extracted: DataFrame) -> DataFrame:
    """Documents with the exploitation flag and the dictionary version of their extraction, where there was one."""
    found = extracted.select("url", F.col("reports_exploitation").alias("_flag"), F.col("extraction_version").alias("_version"))
    return docs.join(found, "url", "left").withColumns({
        "reports_exploitation": F.coalesce("_flag", "reports_exploitation", F.lit(False)),
        "extraction_version": F.coalesce("_version", "extraction_version")}).drop("_flag", "_version")


@dataclass(frozen=True)
class Relinked:
    """What extracting documents again changes: ``diff`` has all edges of those documents with ``change``, ``documents`` their new state."""
    diff: DataFrame
    documents: DataFrame


def relink(docs: DataFrame, edge: DataFrame, table: NameTable, rebuild: bool = False, body: str = "full_text") -> Relinked:
    """Extract documents with the present dictionary and compare with their stored edges.

    ``change`` is 'added', 'kept' or, for an edge that the present dictionary does not give any more, 'gone'. Edges are
    never changed once written, so 'gone' rows stay in the table unless the caller asks for a ``rebuild``, which names
    them 'removed'. One equi join on the edge key; only edges of the chosen documents take part.
    """
    found = extract(docs, table, body=body)
    stored = edge.filter(F.col("subject_type") == "document").join(
        docs.select(F.col("url").cast("string").alias("subject_id")), "subject_id", "left_semi")
    rest = [c for c in edge.columns if c not in EDGE_KEY]
    o, n = stored.withColumn("_old", F.lit(True)).alias("o"), found.edges.withColumn("_new", F.lit(True)).alias("n")
    both = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in EDGE_KEY], "full_outer")
    was, now = F.col("o._old").isNotNull(), F.col("n._new").isNotNull()
    change = F.when(was & now, "kept").when(now, "added").otherwise("removed" if rebuild else "gone")
    diff = both.select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in EDGE_KEY],
                       *[F.when(was, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in rest], change.alias("change"))
    return Relinked(diff, found.documents)


def subject_key(source: str = "source_key", external: str = "external_id") -> Column:
    """Natural id of an exploit or rule as an edge subject."""
    return F.concat_ws(":", F.col(source), F.col(external))


def exploit_edges(exploits: DataFrame) -> DataFrame:
    """Exploit to CVE, as the archive lists it or the repository names it."""
    archive = F.col("source_key") == "exploitdb"
    rows = exploits.select("source_key", "external_id", "published_at", F.explode("cve_ids").alias("cve"))
    evidence = F.when(archive, F.concat(F.lit("EDB-"), "external_id", F.lit(" lists "), "cve")).otherwise(
        F.concat(F.lit("GitHub repo "), "external_id", F.lit(" names "), "cve"))
    return rows.select(
        F.lit("exploit").alias("subject_type"), subject_key().alias("subject_id"), F.lit("cve").alias("object_type"),
        F.col("cve").alias("object_id"), F.lit("targets").alias("relation"), F.lit("explicit").alias("method"),
        F.when(archive, "high").otherwise("low").alias("confidence"), "source_key", evidence.alias("evidence"),
        F.col("published_at").alias("observed_at"))


def rule_edges(rules: DataFrame, techniques: DataFrame) -> DataFrame:
    """Rule to technique and rule to CVE from the author's tags; unknown techniques give no edge."""
    base = rules.select("source_key", "external_id", "published_at", "techniques", "cve_ids")
    by_technique = base.select("source_key", "external_id", "published_at", F.explode("techniques").alias("tag")).join(
        techniques, F.col("tag") == techniques["external_id"]).select(
        base["source_key"], base["external_id"].alias("rule_id"), "published_at", F.lit("attack").alias("object_type"),
        F.col("stix_id").alias("object_id"), F.concat(F.lit("attack."), F.lower("tag")).alias("tag"))
    by_cve = base.select("source_key", F.col("external_id").alias("rule_id"), "published_at",
                         F.explode("cve_ids").alias("cve")).select(
        "source_key", "rule_id", "published_at", F.lit("cve").alias("object_type"), F.col("cve").alias("object_id"),
        F.concat(F.lit("cve."), F.substr("cve", F.lit(5))).alias("tag"))
    return by_technique.unionByName(by_cve).select(
        F.lit("rule").alias("subject_type"), subject_key("source_key", "rule_id").alias("subject_id"), "object_type",
        "object_id", F.lit("detects").alias("relation"), F.lit("explicit").alias("method"),
        F.lit("high").alias("confidence"), "source_key",
        F.concat(F.lit("Sigma rule tagged "), "tag").alias("evidence"), F.col("published_at").alias("observed_at"))


def stale_documents(docs: DataFrame, version: str, as_of: datetime, days: int = vocab.RELINK_DAYS) -> DataFrame:
    """Recent documents extracted with another dictionary; linked again from their whole text."""
    since = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return docs.filter((F.col("collected_at") >= since) & ~F.col("extraction_version").eqNullSafe(F.lit(version))
                       ).withColumn("full_text", F.coalesce("full_text", "summary", F.lit("")))


def technique_stix(objects: DataFrame, technique: str) -> DataFrame:
    """One-column frame with the object id of a technique; an object id passes through (C11)."""
    if technique.startswith("attack-pattern--"):
        return objects.sparkSession.range(1).select(F.lit(technique).alias("stix_id"))
    return objects.filter((F.col("obj_type") == "technique") & (F.upper("external_id") == technique.upper())).select(
        "stix_id")


def resolve_attack(objects: DataFrame, value: str) -> DataFrame:
    """The object meant by an id or a name: object id, technique id, other id, name."""
    by_ext = F.col("external_id") == value.upper()
    rank = (F.when(F.col("stix_id") == value, 0).when(by_ext & (F.col("obj_type") == "technique"), 1)
            .when(by_ext, 2).when(F.col("name") == value, 3))
    return objects.withColumn("_rank", rank).filter(F.col("_rank").isNotNull()).orderBy("_rank", "stix_id").limit(1).drop("_rank")
