"""Article feeds and release notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import vocab
from vigil.functions.text import html_to_text, parse_dt, safe_url
from vigil.sources.common import Parsed, split_rejects

_S = T.StringType()
_RSS = T.StructType([
    T.StructField("title", _S), T.StructField("link", _S), T.StructField("pubDate", _S), T.StructField("dc:date", _S),
    T.StructField("dc:creator", T.ArrayType(_S)), T.StructField("author", T.ArrayType(_S)),
    T.StructField("category", T.ArrayType(_S)), T.StructField("description", _S),
    T.StructField("content:encoded", T.ArrayType(_S))])
_ATOM = T.StructType([
    T.StructField("title", _S),
    T.StructField("link", T.ArrayType(T.StructType([T.StructField("_href", _S), T.StructField("_rel", _S)]))),
    T.StructField("published", _S), T.StructField("updated", _S),
    T.StructField("author", T.ArrayType(T.StructType([T.StructField("name", _S)]))),
    T.StructField("category", T.ArrayType(T.StructType([T.StructField("_term", _S)]))),
    T.StructField("summary", _S), T.StructField("content", T.ArrayType(_S))])


def _or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def _none() -> Column:
    return F.array().cast("array<string>")


def read_feed(spark: SparkSession, path: str, source_key: str, doc_type: str = "news", tier: int = 3) -> Parsed:
    """RSS items and Atom entries of the files under ``path`` as documents."""
    rss = spark.read.format("xml").option("rowTag", "item").schema(_RSS).load(path).select(
        F.col("link"), F.col("title"), _or_empty(F.col("description")).alias("summary_html"),
        F.array_join(F.coalesce("`content:encoded`", _none()), " ").alias("content_html"),
        F.coalesce("pubDate", "`dc:date`").alias("published"), F.coalesce("category", _none()).alias("categories"),
        F.coalesce("`dc:creator`", "author", _none()).alias("authors"))
    href = F.coalesce(
        F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"],
        F.get("link", F.lit(0))["_href"])
    atom = spark.read.format("xml").option("rowTag", "entry").schema(_ATOM).load(path).select(
        href.alias("link"), F.col("title"), _or_empty(F.col("summary")).alias("summary_html"),
        F.array_join(F.coalesce("content", _none()), " ").alias("content_html"),
        F.coalesce("published", "updated").alias("published"),
        F.coalesce(F.transform("category", lambda c: c["_term"]), _none()).alias("categories"),
        F.coalesce(F.transform("author", lambda a: a["name"]), _none()).alias("authors"))
    return parse_entries(rss.unionByName(atom), source_key, doc_type, tier)


def parse_entries(entries: DataFrame, source_key: str, doc_type: str, tier: int) -> Parsed:
    def texts(col: str) -> Column:
        return F.filter(F.transform(col, lambda c: html_to_text(c)), lambda c: c != "")

    body = F.when(F.col("summary_html") != "", F.col("summary_html")).otherwise(F.col("content_html"))
    rows = entries.select(
        safe_url(F.col("link")).alias("url"), html_to_text(F.col("title"), 500).alias("title"),
        html_to_text(body, vocab.FEED_EXCERPT_CHARS).alias("summary"),
        html_to_text(F.concat_ws(" ", "summary_html", "content_html")).alias("full_text"),
        parse_dt(F.col("published")).alias("published_at"), texts("categories").alias("categories"),
        texts("authors").alias("authors"), F.col("link"))
    reason = F.when(F.col("url").isNull(), "no usable link").when(F.col("title") == "", "no title")
    parsed = split_rejects(rows, source_key, reason, F.col("link"))
    good = parsed.good.drop("link").withColumns({
        "summary": F.when(F.col("summary") != "", F.col("summary")),
        "content_hash": F.sha2(F.concat("title", F.lit("|"), "full_text"), 256),
        "source_key": F.lit(source_key), "doc_type": F.lit(doc_type), "tier": F.lit(tier)})
    return Parsed(good, parsed.rejects)


RELEASE = "repo string, html_url string, name string, tag_name string, body string, published_at string"


def read_releases(spark: SparkSession, path: str, repo: str) -> Parsed:
    """A release list (a JSON array of objects) of one watched repository as documents."""
    rows = spark.read.schema(RELEASE).json(path, multiLine=True).withColumn("repo", F.lit(repo))
    return parse_releases(rows)


def parse_releases(rows: DataFrame) -> Parsed:
    name = F.when(F.col("name") != "", F.col("name")).otherwise(F.col("tag_name"))
    body = html_to_text(F.col("body"))  # whole: later changes count, later names are found
    rows = rows.select(
        safe_url(F.col("html_url")).alias("url"),
        F.trim(F.concat_ws(" ", "repo", html_to_text(name, 200))).alias("title"),
        F.substring(body, 1, vocab.FEED_EXCERPT_CHARS).alias("summary"), body.alias("full_text"),
        parse_dt(F.col("published_at")).alias("published_at"), F.array(F.lit("github-release")).alias("categories"),
        _none().alias("authors"), F.col("html_url"))
    parsed = split_rejects(rows, "github", F.when(F.col("url").isNull(), "no usable link"), F.col("html_url"))
    good = parsed.good.drop("html_url").withColumns({
        "summary": F.when(F.col("summary") != "", F.col("summary")),
        "content_hash": F.sha2(F.concat("title", "full_text"), 256),
        "source_key": F.lit("github"), "doc_type": F.lit("repository"), "tier": F.lit(4)})
    return Parsed(good, parsed.rejects)
