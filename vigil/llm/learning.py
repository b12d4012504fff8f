"""Bounded, repeatable samples of labelled rows.

A row is what ``row_key`` tells apart: one id with one text, however often it is repeated. Rows are drawn after labels
were joined, by a hash of their key, so the bounds hold for what is collected, one id or text may hold any share of the
table, and every run and every size draws alike.

Defined cases: a null text counts as empty where labels are joined and is left out where languages are learned; an id
with several labels has the largest; ids without a label, in the held-out fold or null are not drawn; repeated rows are
one row; an empty table gives an empty sample; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.shared import fold, row_key

_SCALE = 1 << 30
_MARGIN = 1.5  # rows that pass the first draw, of which the exact number is kept


def _draw(key: str = "__key") -> Column:
    return F.pmod(F.xxhash64(F.lit("train"), F.col(key)), F.lit(_SCALE))


def _below(rows: int, total: Column | int) -> Column:
    """The draw that about ``_MARGIN * rows`` of ``total`` rows stay below."""
    total = F.lit(total) if isinstance(total, int) else total
    return (F.least(F.lit(1.0), F.lit(_MARGIN * rows) / F.greatest(total, F.lit(1)).cast("double")) * F.lit(float(_SCALE))).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("__key"))


def training_keys(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> list[tuple[int, int]]:
    """(key, label) of at most ``rows`` labelled rows outside the held-out fold, those with the smallest hashes."""
    per_id = (labels.where(fold() > 0).where(F.col(label).isNotNull())
              .groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col(label).cast("int")).alias("label")))
    joined = _keyed(docs).distinct().join(per_id, F.col("doc_id") == F.col("__id")).select("__key", "label")
    drawn = joined.where(_draw() < _below(rows, joined.count()))
    return [(r["__key"], r["label"]) for r in drawn.orderBy(_draw(), "__key", "label").limit(rows).collect()]


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of the sample, one row per key. Its keys are at most ``rows`` and are sent to the tasks that scan texts."""
    keys = docs.sparkSession.createDataFrame(training_keys(docs, labels, label, rows), "__drawn long, label int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), row_key().alias("__key"))
    return (texts.join(F.broadcast(keys), F.col("__key") == F.col("__drawn")).groupBy("__key", "label")
            .agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")).select("doc_id", "text", "label"))


def texts_per_value(docs: DataFrame, column: str, rows: int, values: int) -> DataFrame:
    """(doc_id, value, text) of at most ``rows`` rows of each of the ``values`` most frequent values of ``column``, outside the held-out fold."""
    spark = docs.sparkSession
    usable = (docs.where(fold() > 0).where(F.col(column).isNotNull() & F.col("text").isNotNull())
              .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("value"), row_key().alias("__key"), "text"))
    narrow = usable.select("value", "__key").distinct()
    counts = narrow.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(values).collect()
    rates = spark.createDataFrame([(r["value"], r["n"]) for r in counts], "__value string, n long")
    drawn = narrow.join(F.broadcast(rates), F.col("value") == F.col("__value")).where(_draw() < _below(rows, F.col("n")))
    nth = F.row_number().over(Window.partitionBy("value").orderBy(_draw(), "__key"))
    keys = [(r["value"], r["__key"]) for r in drawn.withColumn("nth", nth).where(F.col("nth") <= rows).collect()]
    chosen = spark.createDataFrame(keys, "__value string, __drawn long")
    return (usable.join(F.broadcast(chosen), (F.col("__key") == F.col("__drawn")) & (F.col("value") == F.col("__value")))
            .groupBy("__key", "value").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")).select("doc_id", "value", "text"))
