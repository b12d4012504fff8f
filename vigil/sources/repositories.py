"""Repository search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import vocab
from vigil.functions.extract import contains_any, find_cves
from vigil.functions.text import clip, html_to_text, parse_dt, safe_url
from vigil.sources.common import Parsed, require, split_rejects

ITEM = (
    "struct<full_name:string,html_url:string,description:string,language:string,stargazers_count:long,fork:boolean,"
    "created_at:string,pushed_at:string,owner:struct<login:string>>")
SCHEMA = f"total_count long, items array<{ITEM}>"


def classify_repository(name: Column, description: Column, searched_by_cve: Column) -> Column:
    text = F.lower(F.concat_ws(" ", name, F.coalesce(description, F.lit(""))))
    return (
        F.when(contains_any(text, vocab.DETECTION_WORDS), "detection")
        .when(contains_any(text, vocab.SCANNER_WORDS), "scanner")
        .when(contains_any(text, vocab.POC_WORDS) | searched_by_cve, "poc")
        .otherwise("repository"))


def read_repositories(spark: SparkSession, path: str, searched_cve: str | None = None) -> Parsed:
    """One search answer; forks are dropped, and a CVE search keeps only literal mentions."""
    pages = spark.read.schema(SCHEMA).json(path, multiLine=True)
    require(pages.filter(F.col("items").isNotNull()), "answer has no 'items' list")
    items = pages.select(F.explode("items").alias("i")).select("i.*").withColumn(
        "searched_cve", F.lit(searched_cve).cast("string"))
    return parse_repositories(items)


def parse_repositories(items: DataFrame) -> Parsed:
    named = F.lower(F.concat_ws(" ", F.coalesce("full_name", F.lit("")), F.coalesce("description", F.lit(""))))
    literal = F.col("searched_cve").isNull() | F.contains(named, F.lower("searched_cve"))
    rows = items.filter(~F.coalesce("fork", F.lit(False)) & literal).withColumn("_url", safe_url(F.col("html_url")))
    ok = F.col("full_name").rlike(vocab.REPOSITORY_NAME) & F.col("_url").startswith("https://github.com/")
    parsed = split_rejects(rows, "github", F.when(~F.coalesce(ok, F.lit(False)), "not a repository"), F.col("full_name"))
    desc = html_to_text(F.col("description"), 500)
    good = parsed.good.withColumn("_desc", desc).select(
        F.lit("github").alias("source_key"), F.col("full_name").alias("external_id"),
        F.col("full_name").alias("title"), F.col("_url").alias("url"),
        classify_repository(F.col("full_name"), F.col("_desc"), F.col("searched_cve").isNotNull()).alias("kind"),
        F.lit(None).cast("string").alias("platform"), F.lit("github-repository").alias("exploit_type"),
        clip(F.col("owner.login"), 300).alias("author"), F.lit(False).alias("verified"),
        F.when(F.col("_desc") != "", F.col("_desc")).alias("description"),
        find_cves(F.concat_ws(" ", "full_name", "_desc")).alias("cve_ids"), F.lit(4).alias("tier"),
        F.col("stargazers_count").alias("stars"), clip(F.col("language"), 64).alias("language"),
        parse_dt(F.col("created_at")).alias("published_at"), parse_dt(F.col("pushed_at")).alias("source_updated_at"))
    return Parsed(good, parsed.rejects)
