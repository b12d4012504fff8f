"""Continuous jobs built from the incremental ones."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.functions.observable import classify, fold, host_of
from vigil.operators import match
from vigil.plans import queries
from vigil.store import Store

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def snapshot_sink(store: Store, table: str, merge_batch: Merge, stream: str = "stream") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that folds each batch into the buckets of a table that it touches.

    ``merge_batch(rows of those buckets, batch)`` gives their next rows; the batch has the table's key columns. Commits
    are numbered on from the newest, whoever wrote it, and the manifest marks the last batch of the stream. A batch that
    runs again after its commit is skipped; one that died before is folded into the same rows again.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        if not store.holds(table, stream, batch_id):
            store.merge(table, batch, merge_batch, marks={stream: batch_id})

    return run


def land(lines: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a stream of landed rows into a snapshot; takes what is there and stops."""
    return lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landed_text(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """New text files of a folder, in batches."""
    reader = spark.readStream.option("wholetext", "false")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder)


def first_seen(rows: DataFrame, keys: list[str], at: str, delay: str = "2 days") -> DataFrame:
    """Each key once within the watermark."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def daily_pulse(rows: DataFrame, at: str, delay: str = "2 days") -> DataFrame:
    """Daily counts with late data; gaps are filled when the series is read.

    ``rows`` carry the boolean columns ``actively_exploited`` and ``in_kev``.
    """
    day = F.window(at, "1 day")
    return rows.withWatermark(at, delay).groupBy(day).agg(
        F.count("*").alias("total"), F.count_if("actively_exploited").alias("exploited"), F.count_if("in_kev").alias("kev")
    ).select(F.to_date("window.start").alias("day"), "total", "exploited", "kev")


def window_trend(rows: DataFrame, at: str, by: list[str], days: int = 1, delay: str = "1 day") -> DataFrame:
    """Counts of two adjacent windows of ``days`` and their difference, for every key and window.

    A sliding window of twice the length holds both, so nothing is joined. Which half a row falls into is told by its
    place in the cycle of days since 1970, so state is one small row per key and window. A window is emitted once, when
    the watermark has passed its end; rows that come later no longer count.
    """
    timed = rows.withWatermark(at, delay).withColumn("_cycle", F.floor(F.unix_date(F.to_date(at)) / days))
    counts = timed.groupBy(*by, F.window(at, f"{2 * days} days", f"{days} days").alias("w")).agg(
        F.count_if(F.col("_cycle") % 2 == 0).alias("even"), F.count_if(F.col("_cycle") % 2 != 0).alias("odd"))
    first_even = F.floor(F.unix_date(F.to_date("w.start")) / days) % 2 == 0
    before, now = F.when(first_even, F.col("even")).otherwise(F.col("odd")), F.when(first_even, F.col("odd")).otherwise(F.col("even"))
    return counts.select(*by, F.col("w.start").alias("start"), before.alias("before"), now.alias("now"), (now - before).alias("trend"))


def fill_days(series: DataFrame, start: datetime, end: datetime) -> DataFrame:
    days = series.sparkSession.range(1).select(F.explode(F.sequence(
        F.to_date(F.lit(start).cast("timestamp")), F.to_date(F.lit(end).cast("timestamp")))).alias("day"))
    return days.join(series, "day", "left").select("day", *[
        F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "exploited", "kev")])


def check_observables(stream: DataFrame, indicators: DataFrame, column: str = "query", limit: int = 50) -> DataFrame:
    """Known indicators for each observable that arrives, by value or by host.

    A host brings its newest ``limit`` rows, ranked on the static side, and the number of all its rows,
    so a host that serves much of the dump adds no product of rows.
    """
    asked = stream.select(F.col(column).alias("query"), classify(F.col(column)).alias("query_kind"),
                          fold(F.col(column)).alias("asked_value"), host_of(F.col(column)).alias("asked_host"))
    columns = ["source_key", "kind", "value_norm", "attack_stix_id"]
    by_host = queries.newest_by_host(indicators, limit)
    # one key per way to meet, so a single equi join serves both; a row met both ways by one
    # observable would appear twice, so the host way leaves out exact values
    ways = indicators.select(F.lit("value").alias("way"), F.col("value_norm").alias("look"), *columns, F.lit(1).cast("long").alias("known")).unionByName(
        by_host.select(F.lit("host").alias("way"), F.col("host").alias("look"), *columns, F.col("host_rows").alias("known")))
    keys = F.array_compact(F.array(
        F.struct(F.lit("value").alias("way"), F.col("asked_value").alias("look")),
        F.when(F.col("asked_host").isNotNull(), F.struct(F.lit("host").alias("way"), F.col("asked_host").alias("look")))))
    rows = asked.filter(F.col("query_kind").isNotNull()).withColumn("k", keys).withColumn("k", F.explode("k")).select(
        "query", "query_kind", "asked_value", "k.*").join(ways, ["way", "look"])
    return rows.filter((F.col("way") == "value") | (F.col("asked_value") != F.col("value_norm"))).select(
        "query", "query_kind", "source_key", "kind", "value_norm", "attack_stix_id", "known")


def match_arrivals(products: DataFrame, assets: DataFrame) -> DataFrame:
    """Per-row verdicts of product rows as they arrive, against a static inventory.

    The verdict of a whole (asset, CVE) pair needs all its rows and is settled by the batch job.
    """
    return match.candidate_verdicts(assets, products)
