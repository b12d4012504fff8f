"""The declared feeds as a small dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import literal_rows

MINUTE = 60
HOUR = 3600

# fixed values: key, name, category, source type, tier, interval seconds, phase, enabled by default,
# needs a credential, reader, document type
FEEDS = [
    ("cisa_kev", "CISA Known Exploited Vulnerabilities", "vulnerability", "Government Advisory", 1, 15 * MINUTE, 1, True, False, "kev", None),
    ("nvd", "NIST National Vulnerability Database", "vulnerability", "Government Database", 1, 30 * MINUTE, 1, True, False, "nvd", None),
    ("cve_org", "CVE.org (CVE Services)", "vulnerability", "CVE Program (CNA records)", 1, 24 * HOUR, 1, True, False, None, None),
    ("mitre_attack", "MITRE ATT&CK (Enterprise)", "attack", "Knowledge Base (STIX 2.1)", 1, 6 * HOUR, 1, True, False, "attack", None),
    ("exploitdb", "Exploit Database (OffSec)", "exploit", "Exploit Archive", 2, 1 * HOUR, 1, True, False, "exploit_archive", None),
    ("github", "GitHub (PoC / research search)", "exploit", "Community Repository", 4, 1 * HOUR, 1, True, False, "repositories", None),
    ("project_zero", "Google Project Zero", "research", "Original Researcher", 1, 1 * HOUR, 2, False, False, "feed", "research"),
    ("msrc", "Microsoft Security Response Center", "vulnerability", "Vendor Advisory", 1, 1 * HOUR, 2, False, False, "feed", "advisory"),
    ("unit42", "Palo Alto Networks Unit 42", "threat_intel", "Security Research Organization", 2, 1 * HOUR, 1, True, False, "feed", "research"),
    ("talos", "Cisco Talos Intelligence", "threat_intel", "Security Research Organization", 2, 1 * HOUR, 1, True, False, "feed", "research"),
    ("mandiant", "Google Threat Intelligence (Mandiant)", "threat_intel", "Security Research Organization", 2, 1 * HOUR, 2, False, False, "feed", "research"),
    ("sentinellabs", "SentinelLabs", "threat_intel", "Security Research Organization", 2, 1 * HOUR, 2, False, False, "feed", "research"),
    ("crowdstrike", "CrowdStrike Blog", "threat_intel", "Security Research Organization", 2, 1 * HOUR, 2, False, False, "feed", "research"),
    ("qualys", "Qualys Threat Research", "threat_intel", "Security Research Organization", 2, 1 * HOUR, 2, False, False, "feed", "research"),
    ("bleepingcomputer", "BleepingComputer", "news", "Security News", 3, 30 * MINUTE, 1, True, False, "feed", "news"),
    ("krebs", "Krebs on Security", "news", "Security News", 3, 30 * MINUTE, 1, True, False, "feed", "news"),
    ("therecord", "The Record (Recorded Future News)", "news", "Security News", 3, 30 * MINUTE, 1, True, False, "feed", "news"),
    ("sigma", "SigmaHQ rules", "detection", "Community Detection Rules (curated)", 2, 6 * HOUR, 2, False, False, "rules", None),
    ("yara", "YARA (VirusTotal)", "detection", "Tooling", 2, 6 * HOUR, 2, False, False, None, None),
    ("otx", "AlienVault OTX", "ioc", "Community Threat Exchange", 4, 1 * HOUR, 2, False, True, None, None),
    ("malwarebazaar", "MalwareBazaar (abuse.ch)", "ioc", "Malware Repository (metadata only)", 2, 1 * HOUR, 2, False, False, "samples", None),
    ("urlhaus", "URLhaus (abuse.ch)", "ioc", "Malicious URL Database", 2, 1 * HOUR, 2, False, False, "urls", None),
    ("virustotal", "VirusTotal", "ioc", "Multi-scanner / Enrichment", 2, 24 * HOUR, 2, False, True, None, None),
]

SCHEMA = (
    "key string, name string, category string, source_type string, tier int, interval_seconds int, phase int, "
    "enabled_by_default boolean, requires_auth boolean, reader string, doc_type string")

_BY_KEY = {row[0]: row for row in FEEDS}
READERS = {row[0]: row[9] for row in FEEDS if row[9]}


def registry(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, FEEDS, SCHEMA)


def tier_of(key: str) -> int:
    return _BY_KEY[key][4] if key in _BY_KEY else 4


def _lookup(key: Column, position: int) -> Column:
    table = F.create_map(*[F.lit(x) for row in FEEDS for x in (row[0], row[position])])
    return F.try_element_at(table, key)


def source_name(key: Column) -> Column:
    """Display name; an unregistered key shows itself. 23 entries, so a literal map needs no join."""
    return F.coalesce(_lookup(key, 1), key)


def source_tier(key: Column) -> Column:
    return F.coalesce(_lookup(key, 4), F.lit(4))


def source_type(key: Column) -> Column:
    return F.coalesce(_lookup(key, 3), F.lit("Unknown"))


def sync_registry(spark: SparkSession, enable: list[str] = (), disable: list[str] = (),
                  credentials: list[str] = (), intervals: dict[str, int] | None = None) -> DataFrame:
    """Registry rows with the effective ``enabled`` flag and interval."""
    key, can_run = F.col("key"), F.col("reader").isNotNull()
    enabled = F.when(key.isin(list(enable)), can_run).otherwise(F.col("enabled_by_default") & can_run)
    enabled = F.when(key.isin(list(disable)), F.lit(False)).otherwise(enabled)
    enabled = F.when(F.col("requires_auth") & ~key.isin(list(credentials)), F.lit(False)).otherwise(enabled)
    interval = F.col("interval_seconds")
    for name, seconds in (intervals or {}).items():
        interval = F.when(key == name, F.lit(seconds)).otherwise(interval)
    return registry(spark).withColumn("enabled", enabled).withColumn("interval_seconds", interval.cast("int"))
