"""Table schemas of the canonical model. Ids are natural keys, and strings on both sides of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.session import literal_rows

LOGS = "array<struct<data_component:string,name:string,channel:string>>"
EXTRA = (
    f"struct<log_sources:{LOGS},mutable_elements:array<string>,analytic_refs:array<string>,first_seen:string,"
    "last_seen:string,`order`:int,detection:string>")
REASONS = "array<struct<factor:string,points:double,detail:string>>"
TECHNIQUES = "array<struct<id:string,method:string>>"

TABLES = {
    "vulnerability": (
        "cve_id string, title string, description string, vendor string, product string, vuln_status string, "
        "published timestamp, last_modified timestamp, cvss_score double, cvss_severity string, cvss_vector string, "
        "cvss_version string, cwes array<string>, ssvc_exploitation string, ssvc_automatable string, "
        "ssvc_technical_impact string, in_kev boolean, kev_name string, kev_date_added date, kev_due_date date, "
        "kev_required_action string, kev_ransomware string, kev_notes string, first_seen timestamp, "
        "updated_at timestamp, nvd_fetched_at timestamp, repos_checked_at timestamp"),
    "affected_product": (
        "cve_id string, vendor string, product string, cpe string, versions string, source_key string"),
    "source_reference": (
        "cve_id string, source_key string, url string, ref_type string, title string, tags array<string>, "
        "published_at timestamp"),
    "payload_cache": "cve_id string, payload string, found boolean, fetched_at timestamp",
    "exploit": (
        "source_key string, external_id string, title string, url string, kind string, platform string, "
        "exploit_type string, author string, verified boolean, description string, cve_ids array<string>, tier int, "
        "stars long, language string, published_at timestamp, source_updated_at timestamp, collected_at timestamp"),
    "document": (
        "url string, source_key string, title string, summary string, full_text string, doc_type string, tier int, "
        "authors array<string>, categories array<string>, content_hash string, reports_exploitation boolean, "
        "extraction_version string, published_at timestamp, collected_at timestamp, updated_at timestamp"),
    "attack_object": (
        "stix_id string, obj_type string, external_id string, name string, description string, aliases array<string>, "
        "platforms array<string>, tactics array<string>, shortname string, is_subtechnique boolean, "
        "parent_external_id string, url string, deprecated boolean, revoked boolean, created timestamp, "
        f"modified timestamp, extra {EXTRA}"),
    "attack_relationship": (
        "stix_id string, relationship_type string, source_ref string, target_ref string, description string"),
    "edge": (
        "subject_type string, subject_id string, object_type string, object_id string, relation string, method string, "
        "confidence string, source_key string, evidence string, observed_at timestamp"),
    "environment": "environment_id string, owner_id string, name string, kind string",
    "asset": (
        "asset_id string, owner_id string, environment_id string, label string, category string, vendor string, "
        "product string, version string, cpe string, catalogued boolean, hardware_model string, notes string"),
    "match": (
        "owner_id string, environment_id string, asset_id string, cve_id string, state string, method string, "
        "confidence string, evidence string, exposure int"),
    "detection_rule": (
        "source_key string, external_id string, title string, description string, rule_format string, status string, "
        "level string, logsource map<string,string>, detection string, falsepositives array<string>, "
        "references array<string>, tags array<string>, techniques array<string>, cve_ids array<string>, author string, "
        "release string, published_at timestamp, collected_at timestamp, tier int, file string"),
    "indicator": (
        "source_key string, tier int, kind string, value string, value_norm string, host string, family string, "
        "attack_stix_id string, threat string, status string, file_type string, mime_type string, "
        "related map<string,string>, tags array<string>, reporter string, reference_url string, "
        "first_seen_at timestamp, last_seen_at timestamp, collected_at timestamp"),
    "ingestion_run": (
        "source_key string, started_at timestamp, finished_at timestamp, status string, items_fetched long, "
        "items_new long, items_updated long, items_malformed long, duration_ms long, error string"),
}

# What the recompute job adds to a vulnerability.
TABLES["scored"] = TABLES["vulnerability"] + (
    ", tags array<string>, platforms array<string>, actively_exploited boolean, exploit_count int, poc_count int, "
    "has_exploit boolean, has_poc boolean, source_count int, product_count int, relevance_score int, "
    f"relevance_reasons {REASONS}, last_activity_at timestamp, techniques {TECHNIQUES}")

# Keys that a run created or changed, for the jobs that derive from them; ``run`` numbers the entries.
TABLES["change_feed"] = "run long, reason string, cve_id string, owner_id string, environment_id string, asset_id string"

# What a row's bucket is a hash of: natural keys. Matches are dealt by CVE alone, so that a CVE's change stays in its
# buckets; assets by owner, whose number of assets is limited as a whole.
KEYS = {
    "vulnerability": ["cve_id"], "scored": ["cve_id"], "payload_cache": ["cve_id"], "match": ["cve_id"],
    "affected_product": ["cve_id", "vendor", "product", "cpe"], "source_reference": ["cve_id", "url"],
    "exploit": ["source_key", "external_id"], "detection_rule": ["source_key", "external_id"], "document": ["url"],
    "attack_object": ["stix_id"], "attack_relationship": ["stix_id"],
    "edge": ["subject_type", "subject_id", "object_type", "object_id", "relation"],
    "environment": ["owner_id"], "asset": ["owner_id"],
    "indicator": ["source_key", "kind", "value_norm"], "ingestion_run": ["source_key", "started_at"],
    "change_feed": ["run", "cve_id", "owner_id", "environment_id", "asset_id"],
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return literal_rows(spark, [], TABLES[table])
