"""What several operators share: the shared folder, words, row keys and folds."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word: a run of ASCII letters, ASCII digits and any characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of its own only for a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="vigil-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Workspace:
    """Tables and files of one run in a new folder of the shared folder.

    What is stored is read back from files, so a lost executor costs its own tasks and no lineage.
    ``drop()`` removes the folder once the result has been written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def store(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop_one(self, name: str) -> None:
        """Remove a stored table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. A text of as many bytes as characters is ASCII, where ``lower`` does that faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def body(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(id_name: str = "doc_id") -> Column:
    """Tells rows apart that share an id but not a text; rows equal in both count as repeats of one row."""
    return F.xxhash64(F.col(id_name), F.col("text"))


def fold(id_name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.pmod(F.crc32(F.col(id_name).cast("string")), F.lit(5))


def held_out(id_name: str = "doc_id") -> Column:
    return F.coalesce(fold(id_name) == 0, F.lit(False))


MARK_BITS = 1 << 27  # 16 MB at most
_BITS_PER_KEY = 64


def marked(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``key`` may be among ``keys`` (one column): none that is goes missing, few others pass.

    A bit per key hash is set in a bitmap that is built by an aggregation and sent to all tasks; its size is
    bounded by ``MARK_BITS``, whatever the number of keys. With too many keys for it, more rows pass. A join on
    the key must follow; what this saves is shuffling the texts of rows that would be dropped there.
    """
    bits = 1 << 15
    wanted = _BITS_PER_KEY * keys.count()
    while bits < min(wanted, MARK_BITS):
        bits <<= 1
    place = lambda c: F.pmod(c, F.lit(bits)) + F.lit(1).cast("long")
    marks = (keys.select(place(F.col(keys.columns[0])).alias("p"))
             .groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bitmap")))
    columns, at = rows.columns, F.bitmap_bit_position(F.col("__place"))
    byte = F.conv(F.hex(F.substring(F.col("__bitmap"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (rows.withColumn("__place", place(F.col(key)))
            .join(F.broadcast(marks), F.bitmap_bucket_number(F.col("__place")) == F.col("__bucket"))
            .where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*columns))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores behind it while ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def keep_rows(docs: DataFrame, chosen: DataFrame, order: list[str]) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text) key is in ``chosen``, one row of each key.

    The window runs on the partitioning of the join, and a key has as many rows as a row has repeats.
    """
    from pyspark.sql import Window

    columns, key, nth = docs.columns, free_name(docs, "__key"), free_name(docs, "__first")
    keyed = docs.withColumn(key, row_key()).join(chosen.select(F.col("key").alias(key)), key, "left_semi")
    first = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c) for c in order if c in columns], F.lit(0)))
    return keyed.withColumn(nth, first).where(F.col(nth) == 1).select(*columns)
