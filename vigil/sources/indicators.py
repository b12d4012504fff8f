"""Indicator dumps: sample hashes and malicious URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.observable import classify, clean, fold, host_of, split_tags
from vigil.functions.text import clip, parse_dt, strip, trimmed
from vigil.sources.common import Parsed, WrongShape, split_rejects, with_position

SAMPLE_COLUMNS = {"sha256_hash", "first_seen_utc"}
URL_COLUMNS = {"url", "dateadded"}

# Optional cells every dump may or may not carry.
_SAMPLE_CELLS = ["sha256_hash", "first_seen_utc", "md5_hash", "sha1_hash", "imphash", "signature", "reporter",
                 "file_type_guess", "mime_type"]
_URL_CELLS = ["url", "dateadded", "url_status", "threat", "tags", "urlhaus_link", "reporter"]


def header_cells(line: Column) -> Column:
    """Cell names of a possibly commented, possibly quoted header line."""
    bare = strip(F.regexp_replace(line, "^[# ]+", ""))
    return F.transform(F.split(bare, ","), lambda c: strip(F.regexp_replace(strip(c), '^"+|"+$', "")))


def read_dump(spark: SparkSession, path: str, required: set[str]) -> DataFrame:
    """Rows of a commented CSV dump; the header is the line that names the required columns.

    Each file is read by its own header. Headers are few words per layout: the distinct ones come to the
    driver, and a file's lines meet its header by the file's name.
    """
    lines = with_position(spark.read.text(path)).filter(strip(F.col("value")) != "").withColumn("file", F.col("pos.file"))
    wanted = F.array(*[F.lit(c) for c in sorted(required)])
    is_header = F.size(F.array_except(wanted, header_cells(F.col("value")))) == 0
    headers = lines.filter(is_header).groupBy("file").agg(F.min_by(header_cells(F.col("value")), "pos").alias("cells"))
    layouts = [r["cells"] for r in headers.select("cells").distinct().orderBy("cells").collect()]
    if not layouts:
        raise WrongShape(f"no header with {sorted(required)}")
    body = lines.filter(~F.ltrim("value").startswith("#") & ~is_header)
    if len(layouts) > 1 and body.join(headers, "file", "left_anti").take(1):
        raise WrongShape("a file without a header stands beside files of different layouts")
    options = {"ignoreLeadingWhiteSpace": "true", "quote": '"', "escape": '"'}
    found = None
    for cells in layouts:
        # one layout serves the parts of a dump that carry no header of their own
        own = body if len(layouts) == 1 else body.join(
            headers.filter(F.col("cells") == F.array(*[F.lit(c) for c in cells])).select("file"), "file", "left_semi")
        schema = ", ".join(f"`{c if c else f'_c{i}'}` string" for i, c in enumerate(cells))
        rows = own.select(F.from_csv("value", F.lit(schema), options).alias("r"), "pos").select("r.*", "pos")
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found


def _complete(rows: DataFrame, cells: list[str]) -> DataFrame:
    absent = {c: F.lit(None).cast("string") for c in cells if c not in rows.columns}
    return rows.withColumns(absent) if absent else rows


def read_samples(spark: SparkSession, path: str) -> Parsed:
    return parse_samples(read_dump(spark, path, SAMPLE_COLUMNS))


def parse_samples(rows: DataFrame) -> Parsed:
    """Sample metadata to indicators keyed by SHA-256; other hashes go to ``related``."""
    rows = _complete(rows, _SAMPLE_CELLS).withColumn("_hash", fold(F.col("sha256_hash")))
    bad = F.coalesce(classify(F.col("_hash")) != "sha256", F.lit(True))
    parsed = split_rejects(rows, "malwarebazaar", F.when(bad, "not a sha256"), F.col("sha256_hash"))
    md5, sha1 = fold(F.col("md5_hash")), fold(F.col("sha1_hash"))
    related = F.map_filter(
        F.create_map(F.lit("md5"), F.when(md5 != "", md5), F.lit("sha1"), F.when(sha1 != "", sha1),
                     F.lit("imphash"), clean(F.col("imphash"))),
        lambda k, v: v.isNotNull())
    family = clean(F.col("signature"))
    good = parsed.good.select(
        F.lit("malwarebazaar").alias("source_key"), F.lit(2).alias("tier"), F.lit("sha256").alias("kind"),
        F.col("_hash").alias("value"), F.col("_hash").alias("value_norm"), F.lit(None).cast("string").alias("host"),
        trimmed(family).alias("family"), F.array_compact(F.array(family)).alias("candidates"),
        F.lit("payload").alias("threat"), F.lit(None).cast("string").alias("status"),
        clip(clean(F.col("file_type_guess")), 64).alias("file_type"),
        clip(clean(F.col("mime_type")), 120).alias("mime_type"), related.alias("related"),
        F.array().cast("array<string>").alias("tags"), clip(clean(F.col("reporter")), 120).alias("reporter"),
        F.concat(F.lit("https://bazaar.abuse.ch/sample/"), "_hash", F.lit("/")).alias("reference_url"),
        parse_dt(F.col("first_seen_utc")).alias("first_seen_at"), "pos")
    return Parsed(good, parsed.rejects)


def read_urls(spark: SparkSession, path: str) -> Parsed:
    return parse_urls(read_dump(spark, path, URL_COLUMNS))


def parse_urls(rows: DataFrame) -> Parsed:
    """URL rows to indicators, of any length."""
    url = strip(F.regexp_replace(strip(F.coalesce("url", F.lit(""))), '^"+|"+$', ""))
    rows = _complete(rows, _URL_CELLS).withColumn("_url", url)
    bad = F.coalesce(classify(F.col("_url")) != "url", F.lit(True))
    parsed = split_rejects(rows, "urlhaus", F.when(bad, "not a url"), F.col("url"))
    tags = split_tags(F.col("tags"))
    good = parsed.good.select(
        F.lit("urlhaus").alias("source_key"), F.lit(2).alias("tier"), F.lit("url").alias("kind"),
        F.col("_url").alias("value"), fold(F.col("_url")).alias("value_norm"),
        trimmed(host_of(F.col("_url"))).alias("host"), F.lit(None).cast("string").alias("family"),
        tags.alias("candidates"), clip(clean(F.col("threat")), 64).alias("threat"),
        clip(F.coalesce(clean(F.col("url_status")), F.lit("unknown")), 32).alias("status"),
        F.lit(None).cast("string").alias("file_type"), F.lit(None).cast("string").alias("mime_type"),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("related"),
        tags.alias("tags"), clip(clean(F.col("reporter")), 120).alias("reporter"),
        clean(F.col("urlhaus_link")).alias("reference_url"), parse_dt(F.col("dateadded")).alias("first_seen_at"), "pos")
    return Parsed(good, parsed.rejects)
