"""Known-exploited catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import vocab
from vigil.functions.text import clip, html_to_text, non_empty, parse_date, safe_url, trimmed
from vigil.sources.common import Parsed, require, split_rejects, valid_cve_id

ENTRY = (
    "struct<cveID:string,vendorProject:string,product:string,vulnerabilityName:string,dateAdded:string,"
    "shortDescription:string,requiredAction:string,dueDate:string,knownRansomwareCampaignUse:string,"
    "notes:string,cwes:array<string>>")
SCHEMA = f"catalogVersion string, vulnerabilities array<{ENTRY}>"


def read_kev(spark: SparkSession, path: str) -> Parsed:
    payload = spark.read.schema(SCHEMA).json(path, multiLine=True)
    require(payload.filter(F.col("vulnerabilities").isNotNull()), "catalogue has no 'vulnerabilities' list")
    return parse_kev(payload.select(F.explode("vulnerabilities").alias("e")).select("e.*"))


def parse_kev(entries: DataFrame) -> Parsed:
    rows = entries.withColumn("_id", valid_cve_id(F.col("cveID"))).withColumn(
        "_notes", html_to_text(F.col("notes")))
    parsed = split_rejects(rows, "cisa_kev", F.when(F.col("_id").isNull(), "invalid CVE id"), F.col("cveID"))
    links = F.regexp_extract_all("_notes", F.lit(vocab.URL_IN_TEXT), F.lit(0))
    urls = F.transform(links, lambda u: safe_url(F.regexp_replace(u, r"[.,)]+$", "")))
    good = parsed.good.select(
        F.col("_id").alias("cve_id"),
        trimmed(html_to_text(F.col("vendorProject"))).alias("vendor"),
        trimmed(html_to_text(F.col("product"))).alias("product"),
        non_empty(html_to_text(F.col("vulnerabilityName"), 500)).alias("kev_name"),
        parse_date(F.col("dateAdded")).alias("kev_date_added"),
        parse_date(F.col("dueDate")).alias("kev_due_date"),
        non_empty(html_to_text(F.col("requiredAction"))).alias("kev_required_action"),
        clip(F.col("knownRansomwareCampaignUse"), 16).alias("kev_ransomware"),
        non_empty(F.col("_notes")).alias("kev_notes"),
        non_empty(html_to_text(F.col("shortDescription"))).alias("short_description"),
        F.filter(F.coalesce("cwes", F.array().cast("array<string>")), lambda c: c.startswith("CWE-")).alias("cwes"),
        F.array_distinct(F.array_compact(urls)).alias("note_urls"))
    return Parsed(good, parsed.rejects)
