"""Exact dedup by stateful streaming: keyed state on disk, without expiry, checked by full bytes on hits.

Arrivals (id, digest, size, row locator) are landed as a table and streamed through an aggregation whose state
lives in RocksDB under the workspace's checkpoint. The state keeps, for each digest ever seen, the stable identifier
of the row that stays, the locator of that row among the arrivals, and the group's size; it has no watermark, so
nothing expires, and a later run on the same folder goes on from it. A digest alone never decides: the texts of
every digest with a second arrival are compared as whole byte strings, and a digest that stands for several texts is
settled text by text.

Defined cases: null text counts as empty; texts are equal when identical after lower-casing A-Z; the row with the
largest doc_id stays (null ids are smallest, and of rows that repeat an id and its text, one stays); an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.shared import Workspace, ascii_lower, body, marked, row_key

ARRIVALS = "doc_id long, key long, text_sha256 string, n_bytes long, locator long"
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # megabytes set aside by each of many small stores
}


def _same(column: Column) -> Column:
    return column


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    for k, v in _STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def land(docs: DataFrame, feed: str, batch: int = 0) -> None:
    """Append the arrivals of ``docs`` to the feed. A locator is the batch and the row within it."""
    text = ascii_lower(body())
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.sha2(text, 256).alias("text_sha256"),
                 F.octet_length(body()).cast("long").alias("n_bytes"),
                 (F.monotonically_increasing_id() + F.lit(batch << 56)).alias("locator"))
     .write.mode("append").parquet(feed))


def settle(spark: SparkSession, feed: str, state: str, digest: Callable[[Column], Column] = _same,
           files_per_batch: int = 10_000) -> DataFrame:
    """Stream what is new in the feed through the state, and return the state: one row per digest."""
    arrivals = spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", files_per_batch).parquet(feed)
    groups = arrivals.groupBy(digest(F.col("text_sha256")).alias("digest")).agg(
        F.max(F.struct("doc_id", "locator")).alias("stays"), F.count(F.lit(1)).alias("group_size"))
    with _state_on_disk(spark):
        query = (groups.writeStream.outputMode("update").format("noop").option("checkpointLocation", state)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        rows = spark.read.format("statestore").load(state)
        key, fields = rows.schema["key"].dataType.fieldNames()[0], rows.schema["value"].dataType.fieldNames()
        return rows.select(F.col(f"key.{key}").alias("digest"), F.col(f"value.{fields[0]}.doc_id").alias("keep_id"),
                           F.col(f"value.{fields[0]}.locator").alias("keep_locator"),
                           F.col(f"value.{fields[1]}").alias("group_size"))


def _by_text(docs: DataFrame, members: DataFrame, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """The texts of all hits with their groups, and the digests that stand for more than one text."""
    hits = members.where("group_size > 1").select("key")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), "text")
    texts = (marked(rows, "key", hits).join(hits, "key", "left_semi")
             .select("doc_id", "key", ascii_lower(body()).alias("content")))
    groups = (texts.groupBy(digest(F.sha2("content", 256)).alias("digest"), "content")
              .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("most")))
    return texts, groups.groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1")


def _resettle(texts: DataFrame, members: DataFrame, clash: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Groups by whole text for the rows of digests that stand for several texts."""
    own = members.join(clash.select("digest"), "digest", "left_semi")
    content = texts.select("key", "content").dropDuplicates(["key"])
    rows = own.drop("keep_id", "keep_locator", "group_size").join(content, "key")
    groups = rows.groupBy("content").agg(F.max(F.struct("doc_id", "locator")).alias("stays"), F.count(F.lit(1)).alias("group_size"))
    return (rows.join(groups, "content").withColumn("keep_id", F.col("stays.doc_id"))
            .withColumn("keep_locator", F.col("stays.locator")).select(*members.columns))


def dedup(docs: DataFrame, ws: Workspace, digest: Callable[[Column], Column] = _same, files_per_batch: int = 10_000) -> DataFrame:
    """One row per document: doc_id, key, keep_id, group_size, kept, text_sha256.

    ``digest`` maps the SHA-256 to the key of the state (tests use a weak one to make digests clash).
    """
    spark, feed = ws.spark, ws.path("feed")
    land(docs, feed)
    state = ws.store(settle(spark, feed, ws.path("state"), digest, files_per_batch), "groups")
    arrivals = spark.read.schema(ARRIVALS).parquet(feed).withColumn("digest", digest(F.col("text_sha256")))
    members = ws.store(arrivals.join(state, "digest"), "members")
    texts, clash = _by_text(docs, members, digest)
    clash = ws.store(clash, "clashes")
    if not clash.isEmpty():
        members = members.join(clash, "digest", "left_anti").unionByName(_resettle(texts, members, clash, digest))
    return members.select("doc_id", "key", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                          (F.col("locator") == F.col("keep_locator")).alias("kept"), "text_sha256")
