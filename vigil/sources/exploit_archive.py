"""Exploit archive CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.extract import find_cves
from vigil.functions.text import clip, html_to_text, parse_dt, strip
from vigil.sources.common import Parsed, WrongShape, split_rejects, with_position

COLUMNS = [
    "id", "file", "description", "date_published", "author", "type", "platform", "port", "date_added", "date_updated",
    "verified", "codes", "tags", "aliases", "screenshot_url", "application_url", "source_url"]
REQUIRED = {"id", "description", "date_published", "author", "type", "platform", "codes"}


def read_exploit_archive(spark: SparkSession, path: str) -> Parsed:
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    missing = REQUIRED - set(rows.columns)
    if missing:
        raise WrongShape(f"archive header lacks {sorted(missing)}")
    rows = with_position(rows)
    for name in COLUMNS:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return parse_exploit_archive(rows)


def parse_exploit_archive(rows: DataFrame) -> Parsed:
    rows = rows.withColumn("_id", strip(F.coalesce("id", F.lit("")))).withColumn(
        "_title", html_to_text(F.col("description"), 500))
    reason = F.when(~F.col("_id").rlike("^[0-9]+$"), "invalid archive id").when(F.col("_title") == "", "no title")
    parsed = split_rejects(rows, "exploitdb", reason, F.col("id"))
    updated = F.when(F.col("date_updated") != "", F.col("date_updated")).otherwise(F.col("date_added"))
    good = parsed.good.select(
        F.lit("exploitdb").alias("source_key"), F.col("_id").alias("external_id"), F.col("_title").alias("title"),
        F.concat(F.lit("https://www.exploit-db.com/exploits/"), "_id").alias("url"), F.lit("exploit").alias("kind"),
        clip(F.col("platform"), 64).alias("platform"), clip(F.col("type"), 64).alias("exploit_type"),
        clip(html_to_text(F.col("author")), 300).alias("author"),
        (strip(F.coalesce("verified", F.lit(""))) == "1").alias("verified"),
        clip(html_to_text(F.col("tags")), 500).alias("description"),
        find_cves(F.col("codes")).alias("cve_ids"), F.lit(2).alias("tier"),
        F.lit(None).cast("long").alias("stars"), F.lit(None).cast("string").alias("language"),
        parse_dt(F.col("date_published")).alias("published_at"), parse_dt(updated).alias("source_updated_at"), "pos")
    return Parsed(good, parsed.rejects)
