"""Derived state of every vulnerability as one set-based job."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.extract import classify_impact, classify_platforms, internet_facing, mentions_ransomware
from vigil.operators import score
from vigil.operators.link import subject_key
from vigil.operators.ordering import Keep, as_planned
from vigil.sources.registry import source_name


@dataclass(frozen=True)
class Corpus:
    """The tables the derived state is computed from."""
    vulnerability: DataFrame
    affected_product: DataFrame
    source_reference: DataFrame
    exploit: DataFrame
    document: DataFrame
    edge: DataFrame
    attack_object: DataFrame
    cve_document: DataFrame | None = None  # pairs that were put together before, see profile.paired
    cve_exploit: DataFrame | None = None


def cve_edges(edge: DataFrame, subject_type: str) -> DataFrame:
    return edge.filter((F.col("object_type") == "cve") & (F.col("subject_type") == subject_type))


def focused_mentions(edge: DataFrame) -> DataFrame:
    """(document, CVE) pairs of reports with few CVEs."""
    return cve_edges(edge, "document").filter(
        (F.col("relation") == "mentions") & (F.col("confidence") == "high")).select(
        F.col("subject_id").alias("doc_id"), F.col("object_id").alias("cve_id"))


def attack_mentions(edge: DataFrame) -> DataFrame:
    return edge.filter((F.col("subject_type") == "document") & (F.col("object_type") == "attack")).select(
        F.col("subject_id").alias("doc_id"), F.col("object_id").alias("stix_id"), "evidence")


def co_mentioned(edge: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects named in the same focused report as a CVE (D3).

    A focused report names at most five CVEs, so the self join emits at most five rows per attack
    edge: it is linear in the number of edges, whatever their distribution.
    """
    known = objects.select("stix_id", "obj_type", "external_id", "name")
    return focused_mentions(edge).join(attack_mentions(edge), "doc_id").join(known, "stix_id")


def named_beside(edge: DataFrame, objects: DataFrame) -> DataFrame:
    """Actor names and technique ids found beside each CVE, every one once: (cve_id, is_technique, value)."""
    actor, technique = F.col("obj_type").isin("group", "campaign"), F.col("obj_type") == "technique"
    wanted = objects.filter(actor | technique)
    value = F.when(technique, F.col("external_id")).otherwise(F.col("name"))
    return co_mentioned(edge, wanted).select("cve_id", technique.alias("is_technique"), value.alias("value")).distinct()


def first_actors(pairs: DataFrame, most: int = 5) -> DataFrame:
    """The first actor names of each CVE; the score tells that there are any and names five.

    Pairs are distinct and the rank filter cuts each map partition, so a CVE that is
    named beside every known actor gathers no more rows than another.
    """
    w = Window.partitionBy("cve_id").orderBy("name")
    return pairs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


_SIGNAL = {
    "source": "string", "at": "timestamp", "exploiter": "string", "ransomware": "boolean", "exploits": "bigint",
    "pocs": "bigint", "products": "bigint"}


def _signal(rows: DataFrame, **cols: Column) -> DataFrame:
    """One kind of signal in the common layout; what it does not carry is null."""
    return rows.select("cve_id", *[
        cols.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _SIGNAL.items()])


def signals(c: Corpus) -> DataFrame:
    """What reports, code, references and products say about a CVE as rows of one layout, so that one aggregation serves all of it."""
    docs = c.document.select(
        F.col("url").alias("doc_id"), F.col("source_key").alias("doc_source"), "published_at",
        mentions_ransomware(F.concat_ws(" ", "title", "summary")).alias("names_ransomware"))
    by_doc = cve_edges(c.edge, "document").select(
        F.col("object_id").alias("cve_id"), F.col("subject_id").alias("doc_id"), "relation", "confidence",
        "source_key").join(docs, "doc_id", "left")
    reports = F.col("relation") == "reports_exploitation"
    focused = (F.col("relation") == "mentions") & (F.col("confidence") == "high")
    exploits = c.exploit.select(subject_key().alias("exploit_id"), F.col("source_key").alias("exploit_source"), "kind",
                                F.col("published_at").alias("exploit_at"))
    by_exploit = cve_edges(c.edge, "exploit").select(
        F.col("object_id").alias("cve_id"), F.col("subject_id").alias("exploit_id")).join(exploits, "exploit_id")
    # rows that say the same become one by plain sums, which map-side aggregation shrinks even for a very hot CVE
    said = by_doc.select(
        "cve_id", "published_at", F.col("doc_source").alias("source"),
        F.when(reports, F.coalesce("doc_source", "source_key")).alias("by"),
        (focused & F.col("names_ransomware")).alias("ransomware")).groupBy("cve_id", "source", "by").agg(
        F.max("published_at").alias("at"), F.max("ransomware").alias("ransomware"))
    coded = by_exploit.groupBy("cve_id", "exploit_source").agg(
        F.max("exploit_at").alias("at"), F.count_if(F.col("kind") == "exploit").alias("exploits"), F.count_if(F.col("kind") == "poc").alias("pocs"))
    parts = [
        _signal(said, source=F.col("source"), at=F.col("at"), exploiter=source_name(F.col("by")), ransomware=F.col("ransomware")),
        _signal(coded, source=F.col("exploit_source"), at=F.col("at"), exploits=F.col("exploits"), pocs=F.col("pocs")),
        _signal(c.source_reference.filter(F.col("source_key") != "cve_org").select("cve_id", "source_key").distinct(), source=F.col("source_key")),
        _signal(c.affected_product.groupBy("cve_id").agg(F.count(F.lit(1)).alias("products")), products=F.col("products")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def summarise(rows: DataFrame) -> DataFrame:
    """One row per CVE. The sets hold registered sources, so their size is bounded and map-side aggregation shrinks even a very hot CVE."""
    return rows.groupBy("cve_id").agg(
        F.collect_set("source").alias("sources"), F.max("at").alias("signal_at"),
        F.collect_set("exploiter").alias("exploiters"),
        F.coalesce(F.max("ransomware"), F.lit(False)).alias("ransomware"),
        F.coalesce(F.sum("exploits"), F.lit(0)).cast("int").alias("exploit_count"),
        F.coalesce(F.sum("pocs"), F.lit(0)).cast("int").alias("poc_count"),
        F.coalesce(F.sum("products"), F.lit(0)).cast("int").alias("product_count"))


def summarise_beside(beside: DataFrame) -> DataFrame:
    """One row per CVE: at most five actors and the techniques found beside it. An aggregation of its own, which Spark leaves out
    together with its join where a reader needs neither names nor scores."""
    # an actor without a name takes a place among the five, too
    actors = first_actors(beside.filter(~F.col("is_technique")).select("cve_id", F.col("value").alias("name")))
    techniques = beside.filter("is_technique").select("cve_id", F.col("value").alias("technique"))
    rows = actors.select("cve_id", F.col("name").alias("actor")).unionByName(techniques, allowMissingColumns=True)
    return rows.groupBy("cve_id").agg(F.collect_set("actor").alias("actors"), F.collect_set("technique").alias("explicit"))


DERIVED = ["tags", "platforms", "actively_exploited", "exploit_count", "poc_count", "has_exploit", "has_poc",
           "source_count", "product_count", "relevance_score", "relevance_reasons", "last_activity_at", "techniques"]


def derive(vulns: DataFrame, summary: DataFrame, beside: DataFrame, as_of: datetime) -> DataFrame:
    """Flags, tags, score and reasons of each vulnerability from its two summaries."""
    base = vulns.drop(*DERIVED).join(summary, "cve_id", "left").join(beside, "cve_id", "left")
    strings = F.array().cast("array<string>")
    for name in ("sources", "exploiters", "actors", "explicit"):
        base = base.withColumn(name, F.coalesce(name, strings))
    for name in ("exploit_count", "poc_count", "product_count"):
        base = base.withColumn(name, F.coalesce(name, F.lit(0)))
    in_kev, ssvc = F.coalesce("in_kev", F.lit(False)), F.coalesce("ssvc_exploitation", F.lit(""))
    blob = F.concat_ws(" ", "title", "kev_name", "description")
    product_blob = F.concat_ws(" ", "vendor", "product", "kev_name")
    own = F.array_compact(F.array(
        F.when(in_kev, F.lit("CISA KEV")), F.when(ssvc == "active", F.lit("CISA SSVC (via NVD)"))))
    now = F.lit(as_of).cast("timestamp")
    base = base.withColumns({
        "evidence": F.array_union(own, "exploiters"),
        "ransomware": (F.lower(F.coalesce("kev_ransomware", F.lit(""))) == "known")
        | F.coalesce("ransomware", F.lit(False)),
        "tags": classify_impact(blob, F.col("cwes")),
        "platforms": classify_platforms(F.concat_ws(" ", product_blob, blob)),
        "exposed": internet_facing(product_blob),
        "last_activity_at": F.greatest("published", F.col("kev_date_added").cast("timestamp"), "signal_at"),
        "source_count": F.size("sources"),
    })
    found = score.reasons(
        in_kev=in_kev, evidence=F.col("evidence"), ransomware=F.col("ransomware"), exploit_count=F.col("exploit_count"),
        poc_count=F.col("poc_count"), ssvc_poc=ssvc == "poc", actors=F.col("actors"), tags=F.col("tags"),
        internet_facing=F.col("exposed"), cvss_score=F.col("cvss_score"), sources=F.col("source_count"),
        last_signal=F.col("last_activity_at"), product_count=F.col("product_count"), as_of=now)
    suggested = score.heuristic_techniques(
        F.lower(F.concat_ws(" ", "title", "description", "kev_name")), F.col("tags"), F.col("exposed"))
    base = base.withColumns({
        "actively_exploited": F.size("evidence") > 0, "has_exploit": F.col("exploit_count") > 0,
        "has_poc": (F.col("poc_count") > 0) | (ssvc == "poc"), "relevance_reasons": found,
        "techniques": score.merge_techniques(F.col("explicit"), suggested)})
    base = base.withColumn("relevance_score", score.total(F.col("relevance_reasons")))
    keep = [c for c in vulns.columns if c not in DERIVED]
    return base.select(*keep, *DERIVED)


def _derived(c: Corpus, as_of: datetime, keep: Keep = as_planned) -> DataFrame:
    return derive(c.vulnerability, keep(summarise(signals(c))), keep(summarise_beside(named_beside(c.edge, c.attack_object))), as_of)


def recompute(c: Corpus, as_of: datetime, only: DataFrame | None = None, keep: Keep = as_planned) -> DataFrame:
    """Derived state of all vulnerabilities, or of those whose ``cve_id`` is in ``only``.

    With ``keep``, which stores rows and reads them back, the two summaries are made one after the other, so that the disk
    holds what one of them shuffles at a time.
    """
    if only is None:
        return _derived(c, as_of, keep)
    keys = only.select("cve_id").distinct()
    docs_of = c.edge.join(keys.withColumnRenamed("cve_id", "object_id"), "object_id", "left_semi")
    # attack edges are needed for the documents that name a chosen CVE; of documents and exploits only those with an edge
    named = docs_of.filter(F.col("subject_type") == "document").select("subject_id").distinct()
    attack = c.edge.filter(F.col("object_type") == "attack").join(named, "subject_id", "left_semi")
    targeting = docs_of.filter(F.col("subject_type") == "exploit").select("subject_id").distinct()
    part = replace(
        c, document=c.document.join(named, F.col("url") == F.col("subject_id"), "left_semi"),
        exploit=c.exploit.join(targeting, subject_key() == F.col("subject_id"), "left_semi"),
        vulnerability=c.vulnerability.join(keys, "cve_id", "left_semi"),
        affected_product=c.affected_product.join(keys, "cve_id", "left_semi"),
        source_reference=c.source_reference.join(keys, "cve_id", "left_semi"),
        edge=docs_of.unionByName(attack, allowMissingColumns=True))
    return _derived(part, as_of, keep)


def maintenance_keys(derived: DataFrame, as_of: datetime, days: int = 60, min_score: int = 30) -> DataFrame:
    """What the periodic recompute covers: recent activity or a score worth keeping current."""
    since = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return derived.filter((F.col("last_activity_at") >= since) | (F.col("relevance_score") >= min_score)).select("cve_id")


def replace_rows(table: DataFrame, rows: DataFrame, key: str = "cve_id") -> DataFrame:
    """The table with the recomputed rows in place of their old versions."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)
