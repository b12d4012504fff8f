"""Aggregates and marts (A1-A10, A14-A21, A24, A26). Each is computed for all keys at once."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import vocab
from vigil.functions.text import title_or
from vigil.operators.recompute import attack_mentions, co_mentioned
from vigil.plans.queries import tracked_rule_edges, window_start
from vigil.session import literal_rows
from vigil.sources.registry import source_name, source_tier, source_type


def _long(counts: DataFrame, name: str = "card", value: str = "value") -> DataFrame:
    """A one-row frame of counts as (name, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("long").alias(value)) for c in counts.columns])
    return counts.select(F.inline(pairs))


def zero_filled(counts: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A fixed list of classes in order, with zero where nothing was counted."""
    spark = counts.sparkSession
    order = literal_rows(spark, list(enumerate(values)), f"position int, {column} string")
    return order.join(counts, column, "left").select("position", column, F.coalesce("count", F.lit(0)).alias("count"))


# ------------------------------------------------------------------------------------ overview
def seen_entities(edge: DataFrame, objects: DataFrame, start: Column | None) -> DataFrame:
    """Distinct objects named since ``start`` (A2)."""
    named = edge.filter(F.col("object_type") == "attack")
    if start is not None:
        named = named.filter(F.col("observed_at") >= start)
    ids = named.select(F.col("object_id").alias("stix_id")).distinct()
    return objects.select("stix_id", "obj_type").join(ids, "stix_id", "left_semi")


def overview(window: str, as_of: datetime, vulns: DataFrame, exploits: DataFrame, docs: DataFrame, edge: DataFrame,
             objects: DataFrame, rules: DataFrame) -> DataFrame:
    """Headline counts of a window; one aggregation per table (A1)."""
    start = window_start(window, as_of)
    start = F.lit(datetime(1970, 1, 1)).cast("timestamp") if start is None else start
    kind = F.col("kind")
    parts = [
        vulns.agg(
            F.count_if(F.col("actively_exploited") & (F.col("last_activity_at") >= start)).alias("actively_exploited"),
            F.count_if(F.col("kev_date_added") >= F.to_date(start)).alias("kev_added"),
            F.count_if(F.col("published") >= start).alias("new_cves")),
        exploits.agg(
            F.count_if((kind == "exploit") & (F.col("published_at") >= start)).alias("new_exploits"),
            F.count_if((kind == "poc") & (F.col("collected_at") >= start)).alias("new_pocs"),
            F.count_if((kind == "detection") & (F.col("collected_at") >= start)).alias("new_detection_repos")),
        seen_entities(edge, objects, start).agg(
            F.count_if(F.col("obj_type") == "group").alias("threat_actors_seen"),
            F.count_if(F.col("obj_type").isin("malware", "tool")).alias("malware_seen"),
            F.count_if(F.col("obj_type") == "campaign").alias("campaigns_seen")),
        docs.agg(
            F.count_if(F.col("doc_type").isin("research", "advisory") & (F.col("published_at") >= start)).alias("new_research"),
            F.count_if((F.col("doc_type") == "news") & (F.col("published_at") >= start)).alias("new_news")),
        rules.agg(F.count_if(F.col("collected_at") >= start).alias("new_rules")),
    ]
    rows = _long(parts[0])
    for part in parts[1:]:
        rows = rows.unionByName(_long(part))
    return rows


def top_threats(vulns: DataFrame, start: Column | None, limit: int = 10) -> DataFrame:
    rows = vulns if start is None else vulns.filter(F.col("last_activity_at") >= start)
    return rows.orderBy(F.col("relevance_score").desc_nulls_last(), F.col("last_activity_at").desc_nulls_last(),
                        "cve_id").limit(limit)


def latest(rows: DataFrame, date: str, key: str, limit: int = 8) -> DataFrame:
    """Newest rows first (A3)."""
    return rows.orderBy(F.col(date).desc_nulls_last(), key).limit(limit)


def mention_counts(edge: DataFrame, start: Column | None = None) -> DataFrame:
    """Documents that mention each object.

    An edge is unique per subject, object and relation, so its mention rows already are distinct
    documents: one partial aggregation, no distinct and no per-object set.
    """
    rows = edge.filter((F.col("object_type") == "attack") & (F.col("relation") == "mentions"))
    if start is not None:
        rows = rows.filter(F.col("observed_at") >= start)
    return rows.groupBy(F.col("object_id").alias("stix_id")).agg(F.count("*").alias("mentions"))


def trending(edge: DataFrame, objects: DataFrame, start: Column | None, limit: int = 12) -> DataFrame:
    """Most mentioned objects of a window (A4)."""
    counts = mention_counts(edge, start)
    return counts.join(objects.select("stix_id", "obj_type", "name"), "stix_id").orderBy(
        F.col("mentions").desc(), "stix_id").limit(limit)


def pulse(vulns: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Daily activity, always ``days`` rows, with the peak on every row (A5)."""
    today = F.to_date(F.lit(as_of).cast("timestamp"))
    start = F.date_sub(today, days - 1)
    day = F.to_date("last_activity_at")
    counts = vulns.filter(day >= start).groupBy(day.alias("day")).agg(
        F.count("*").alias("total"), F.count_if("actively_exploited").alias("exploited"), F.count_if("in_kev").alias("kev"))
    calendar = vulns.sparkSession.range(1).select(
        F.explode(F.sequence(start, today, F.make_dt_interval(F.lit(1)))).alias("day"))
    filled = calendar.join(counts, "day", "left").select(
        "day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "exploited", "kev")])
    # the calendar has at most a few hundred rows, so one window over it is small
    return filled.withColumn("peak", F.max("total").over(Window.partitionBy(F.lit(1))))


def busiest_day(series: DataFrame) -> DataFrame:
    """Day with the most activity; the earliest wins a tie."""
    return series.agg(F.max_by(F.struct("day", "total"), F.struct(F.col("total"), -F.unix_date("day"))).alias("b")).select("b.*")


# ------------------------------------------------------------------------------------ source runs
def source_state(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Run facts of each source: last attempt and its outcome, last success, failures since then (A10).

    Two aggregations by source and a join with the small table of last successes; no run history is
    ever sorted in one place.
    """
    failed = F.col("status") == "error"
    facts = runs.groupBy("source_key").agg(
        F.max("started_at").alias("last_attempt"),
        F.max_by(F.struct("status", "error", "duration_ms", "items_fetched", "items_new", "items_updated"),
                 F.struct("started_at", "status")).alias("last"),
        F.max(F.when(~failed, F.col("finished_at"))).alias("last_successful_fetch"),
        F.max(F.when(~failed, F.col("started_at"))).alias("_last_ok"))
    since = runs.filter(failed).select("source_key", "started_at").join(
        facts.select("source_key", "_last_ok"), "source_key").filter(
        F.col("_last_ok").isNull() | (F.col("started_at") > F.col("_last_ok"))).groupBy("source_key").agg(
        F.count("*").alias("consecutive_failures"))
    state = facts.join(since, "source_key", "left").select(
        F.col("source_key").alias("key"), "last_attempt", F.col("last.status").alias("last_status"),
        F.col("last.error").alias("last_error"), F.col("last.duration_ms").alias("latency_ms"),
        F.col("last.items_fetched").alias("items_fetched"), F.col("last.items_new").alias("items_new"),
        F.col("last.items_updated").alias("items_updated"), "last_successful_fetch",
        F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"))
    return sources.join(state, "key", "left").withColumn(
        "consecutive_failures", F.coalesce("consecutive_failures", F.lit(0)))


def source_health(state: DataFrame, as_of: datetime) -> DataFrame:
    """disabled, error, never_run, stale or ok."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("last_successful_fetch")) / 1e6
    health = (
        F.when(~F.col("enabled"), "disabled").when(F.col("last_status") == "error", "error")
        .when(F.col("last_successful_fetch").isNull(), "never_run")
        .when(age > F.col("interval_seconds") * vocab.STALE_AFTER_INTERVALS, "stale").otherwise("ok"))
    return state.withColumn("health", health)


def backoff_seconds(failures: Column, interval: Column) -> Column:
    """Wait after repeated failures: the interval doubled per failure, capped."""
    doublings = F.least(failures, F.lit(vocab.BACKOFF_MAX_DOUBLINGS))
    wait = F.least(interval * F.pow(F.lit(2), doublings), F.lit(vocab.BACKOFF_CAP_SECONDS)).cast("long")
    return F.when(F.coalesce(failures, F.lit(0)) <= 0, F.lit(0)).otherwise(wait)


def due_for_run(failures: Column, interval: Column, last_attempt: Column, as_of: datetime) -> Column:
    wait = backoff_seconds(failures, interval)
    ready = F.lit(as_of).cast("timestamp") >= last_attempt + F.make_dt_interval(secs=wait)
    return (wait == 0) | last_attempt.isNull() | ready


def run_history(runs: DataFrame, limit: int = 25) -> DataFrame:
    """Latest runs of every source."""
    w = Window.partitionBy("source_key").orderBy(F.col("started_at").desc(), F.col("finished_at").desc_nulls_last())
    return runs.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def last_runs(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source_key").agg(F.max("started_at").alias("last_run"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    rows = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# ------------------------------------------------------------------------------------ distributions
def severity_mix(vulns: DataFrame, start: Column | None = None) -> DataFrame:
    """Five fixed severity classes; what nobody scored is its own class."""
    rows = vulns if start is None else vulns.filter(F.col("first_seen") >= start)
    scored = F.coalesce(F.when(F.col("cvss_severity") != "", F.col("cvss_severity")), F.lit("UNSCORED"))
    counts = rows.groupBy(scored.alias("severity")).agg(F.count("*").alias("count"))
    return zero_filled(counts, "severity", vocab.SEVERITIES)


def indicator_overview(indicators: DataFrame) -> DataFrame:
    """Totals by kind, by source and overall from one pass.

    Distinct families are counted over (facet, family) pairs that map-side aggregation already made
    few, so no task sees the raw rows of a hot kind.
    """
    measures = [
        F.count("*").alias("rows"), F.count_if(F.col("attack_stix_id").isNotNull()).alias("resolved"),
        F.count_if(F.col("status") == "online").alias("online"), F.max("first_seen_at").alias("newest")]
    by_family = indicators.groupBy("kind", "source_key", "attack_stix_id").agg(*measures)
    kind, source = F.col("kind"), F.col("source_key")
    return by_family.groupingSets([[kind], [source], []], kind, source).agg(
        F.sum("rows").alias("rows"), F.sum("resolved").alias("resolved"),
        F.count_distinct("attack_stix_id").alias("families"), F.sum("online").alias("online"),
        F.max("newest").alias("newest"),
        F.when(F.grouping_id() == 1, "kind").when(F.grouping_id() == 2, "source").otherwise("all").alias("facet"),
    ).withColumn("value", F.coalesce("kind", "source_key", F.lit("all"))).drop("kind", "source_key")


def detection_overview(rules: DataFrame, edge: DataFrame, vulns: DataFrame) -> DataFrame:
    """Coverage figures as (card, value) rows, rule levels included."""
    tracked = tracked_rule_edges(edge, vulns).select("cve_id").distinct().join(
        vulns.select("cve_id", "in_kev"), "cve_id")
    tagged = edge.filter((F.col("subject_type") == "rule") & (F.col("object_type") == "attack"))
    parts = [
        _long(rules.agg(F.count("*").alias("rules"), F.count_distinct("release").alias("releases"))),
        rules.filter(F.col("level") != "").groupBy(F.concat(F.lit("level:"), "level").alias("card")).agg(
            F.count("*").alias("value")),
        _long(tagged.agg(F.count_distinct("object_id").alias("techniques_covered"))),
        _long(tracked.agg(F.count("*").alias("cves_covered"), F.count_if("in_kev").alias("kev_covered"))),
        _long(vulns.agg(F.count_if("in_kev").alias("kev_total"))),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


# ------------------------------------------------------------------------------------ attack knowledge
def tactic_matrix(objects: DataFrame, edge: DataFrame) -> DataFrame:
    """Parent techniques under each tactic, most mentioned first (A19). One row per cell."""
    live = ~F.col("deprecated")
    tactics = objects.filter((F.col("obj_type") == "tactic") & live).select(
        F.col("shortname").alias("tactic"), F.col("name").alias("tactic_name"),
        F.coalesce("extra.order", F.lit(99)).alias("tactic_order"))
    techniques = objects.filter((F.col("obj_type") == "technique") & live & ~F.col("revoked") & ~F.col("is_subtechnique"))
    cells = techniques.select("stix_id", "external_id", "name", F.explode(F.array_distinct("tactics")).alias("tactic"))
    w = Window.partitionBy("tactic").orderBy(F.col("mentions").desc(), F.coalesce("external_id", F.lit("")), "stix_id")
    # the number of techniques is that of the knowledge base, not of the corpus
    return cells.join(tactics, "tactic").join(mention_counts(edge), "stix_id", "left").withColumn(
        "mentions", F.coalesce("mentions", F.lit(0))).withColumn("position", F.row_number().over(w))


def _first_chars(text: str, chars: int | None) -> Column:
    return F.col(text) if chars is None else F.substring(text, 1, chars)


def related_objects(objects: DataFrame, relationships: DataFrame, chars: int | None = None) -> DataFrame:
    """Both directions of every relationship, labelled from the object's point of view (A20); ``chars`` cuts descriptions."""
    outgoing = relationships.select(
        F.col("source_ref").alias("stix_id"), F.col("target_ref").alias("other"), "relationship_type",
        F.col("relationship_type").alias("label"), _first_chars("description", chars).alias("how"))
    incoming = relationships.filter(F.col("source_ref") != F.col("target_ref")).select(
        F.col("target_ref").alias("stix_id"), F.col("source_ref").alias("other"), "relationship_type",
        F.when(F.col("relationship_type") == "uses", "used_by").otherwise(F.col("relationship_type")).alias("label"),
        _first_chars("description", chars).alias("how"))
    known = objects.filter(~F.col("revoked")).select(
        F.col("stix_id").alias("other"), F.col("obj_type").alias("other_type"), F.col("name").alias("other_name"),
        F.col("external_id").alias("other_external_id"))
    rows = outgoing.unionByName(incoming).join(known, "other")
    return rows.select("stix_id", F.concat_ws(":", "label", "other_type").alias("section"), "other", "other_name",
                       "other_external_id", "how")


def entity_documents(edge: DataFrame, docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents of every object, newest first (A20); ``limit`` keeps the first ones."""
    pairs = attack_mentions(edge).select("stix_id", F.col("doc_id").alias("url")).distinct()
    w = Window.partitionBy("stix_id").orderBy(F.col("published_at").desc_nulls_last(), "url")
    rows = pairs.join(docs.select("url", "title", "source_key", "published_at"), "url").withColumn("position", F.row_number().over(w))
    return rows if limit is None else rows.filter(F.col("position") <= limit)


def entity_vulnerabilities(edge: DataFrame, objects: DataFrame, vulns: DataFrame, limit: int | None = None) -> DataFrame:
    """CVEs co-mentioned with every object, highest score first (A20); ``limit`` keeps the first ones."""
    pairs = co_mentioned(edge, objects).select("stix_id", "cve_id").distinct()
    w = Window.partitionBy("stix_id").orderBy(F.col("relevance_score").desc_nulls_last(), "cve_id")
    rows = pairs.join(vulns.select("cve_id", "relevance_score"), "cve_id").withColumn("position", F.row_number().over(w))
    return rows if limit is None else rows.filter(F.col("position") <= limit)


def technique_mitigations(objects: DataFrame, relationships: DataFrame, chars: int | None = None) -> DataFrame:
    live = objects.filter((F.col("obj_type") == "mitigation") & ~F.col("deprecated")).select(
        F.col("stix_id").alias("source_ref"), "external_id", "name", "url")
    return relationships.filter(F.col("relationship_type") == "mitigates").join(live, "source_ref").select(
        F.col("target_ref").alias("technique"), F.col("source_ref").alias("mitigation"), "external_id", "name", "url",
        _first_chars("description", chars).alias("how"))


def technique_detections(objects: DataFrame, relationships: DataFrame, analytics: int | None = None,
                         logs: int | None = None) -> DataFrame:
    """Strategy, analytic, log source and component of every technique, one row per log source.

    A strategy's analytics come from its own list and from ``includes`` relationships, which may be any
    number. ``analytics`` and ``logs`` keep the first ones only; the default is all.
    """
    strategies = objects.filter(F.col("obj_type") == "detection_strategy").select(
        F.col("stix_id").alias("source_ref"), F.col("external_id").alias("strategy_id"), F.col("name").alias("strategy"),
        F.coalesce("extra.analytic_refs", F.array().cast("array<string>")).alias("refs"))
    included = relationships.filter(F.col("relationship_type") == "includes").select("source_ref", F.col("target_ref").alias("analytic"))
    about = strategies.drop("refs")
    parts = strategies.select(*about.columns, F.explode("refs").alias("analytic")).unionByName(about.join(included, "source_ref")).distinct()
    if analytics is not None:
        w = Window.partitionBy("source_ref").orderBy("analytic")
        parts = parts.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= analytics).drop("_n")
    links = relationships.filter(F.col("relationship_type") == "detects").select("source_ref", F.col("target_ref").alias("technique"))
    listed = F.col("extra.log_sources") if logs is None else F.slice("extra.log_sources", 1, logs)
    sources = objects.select(
        F.col("stix_id").alias("analytic"), F.col("external_id").alias("analytic_id"), F.posexplode_outer(listed).alias("log_pos", "log"))
    components = objects.select(F.col("stix_id").alias("component"), F.col("name").alias("component_name"))
    return links.join(parts, "source_ref").join(sources, "analytic").select(
        "technique", F.col("source_ref").alias("strategy_stix"), "strategy_id", "strategy", "analytic",
        "analytic_id", "log_pos", F.col("log.data_component").alias("component"), F.col("log.name").alias("log_name"),
        F.col("log.channel").alias("channel")).join(components, "component", "left").drop("component")


def techniques_by_id(objects: DataFrame) -> DataFrame:
    """Live techniques by external id."""
    return objects.filter((F.col("obj_type") == "technique") & ~F.col("revoked"))


def publishers(sources: DataFrame) -> DataFrame:
    """Distinct publishers of each CVE; the last row per name stays."""
    return sources.groupBy("cve_id", "source").agg(
        F.max_by(F.struct("url", "tier"), F.struct("tier", "url")).alias("l")).select("cve_id", "source", "l.*")


# ------------------------------------------------------------------------------------ row shapes
def with_source(rows: DataFrame, key: str = "source_key") -> DataFrame:
    """Registry name, type and tier of the row's source."""
    col = F.col(key)
    return rows.withColumns({"source": source_name(col), "source_type": source_type(col), "source_tier": source_tier(col)})


def vulnerability_rows(vulns: DataFrame) -> DataFrame:
    return vulns.select(
        "cve_id", title_or(F.col("title"), F.col("kev_name")).alias("title"), "vendor", "product",
        F.col("cvss_severity").alias("severity"), "cvss_score", "in_kev", "kev_date_added", "actively_exploited",
        "has_exploit", "has_poc", "exploit_count", "poc_count", "published", "first_seen",
        F.col("updated_at").alias("last_updated"), "last_activity_at", "source_count", "tags", "platforms", "techniques",
        "relevance_score", "relevance_reasons")


def document_rows(docs: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    rows = with_source(docs.select("url", "title", "summary", "doc_type", "source_key", "tier", "categories", "authors",
                                   "reports_exploitation", "published_at", "collected_at"))
    return rows if entities is None else rows.join(entities, "url", "left")


def exploit_rows(exploits: DataFrame) -> DataFrame:
    warning = "Code from the community that nobody has reviewed; keep it inside an isolated lab."
    return with_source(exploits).withColumn("warning", F.when(F.col("source_key") == "github", warning))


def attack_rows(objects: DataFrame, counts: DataFrame | None = None, chars: int | None = None) -> DataFrame:
    rows = objects.select(
        "stix_id", "external_id", F.col("obj_type").alias("type"), "name", "aliases", "platforms", "tactics", "url",
        "is_subtechnique", _first_chars("description", chars).alias("description"), "modified", "created")
    return rows if counts is None else rows.join(counts, "stix_id", "left")


def indicator_rows(indicators: DataFrame) -> DataFrame:
    return indicators.select(
        "kind", "value", "host", "family", "attack_stix_id", "threat", "status", "file_type", "mime_type", "related", "tags",
        "reporter", "reference_url", "source_key", "first_seen_at", "last_seen_at")


def rule_rows(rules: DataFrame) -> DataFrame:
    return rules.select(
        "external_id", "title", "description", F.col("rule_format").alias("format"), "status", "level", "logsource",
        "techniques", "cve_ids", "falsepositives", "references", "author", "release", "source_key")
