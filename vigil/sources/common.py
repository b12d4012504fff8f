"""Shared reader pieces: every reader returns (good rows, rejected rows)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import vocab
from vigil.functions.text import strip


class Parsed(NamedTuple):
    good: DataFrame
    rejects: DataFrame


class WrongShape(ValueError):
    """The payload is not what the source publishes, so the run fails as a whole."""


def valid_cve_id(col: Column) -> Column:
    """Upper-cased CVE id, or null when it is not one."""
    v = F.upper(strip(col))
    return F.when(v.rlike(vocab.CVE_ID), v)


def split_rejects(rows: DataFrame, source_key: str, reason: Column, record: Column) -> Parsed:
    """Rows without a reason are good; the others keep the reason and what was read."""
    tagged = rows.withColumn("_reason", reason)
    rejects = tagged.filter(F.col("_reason").isNotNull()).select(
        F.lit(source_key).alias("source_key"), F.col("_reason").alias("reason"), record.alias("record"))
    return Parsed(tagged.filter(F.col("_reason").isNull()).drop("_reason"), rejects)


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("source_key", "reason").agg(F.count("*").alias("rows"))


def require(found: DataFrame, message: str) -> None:
    """Fail loudly when a probe that must find something finds nothing; reads one row."""
    if not found.take(1):
        raise WrongShape(message)


def with_position(rows: DataFrame) -> DataFrame:
    """Add ``pos``, which orders rows as they stand in their file.

    Rows of one split keep their order, so (file, split offset, row number) is a file order that
    needs no shuffle. Must be applied directly on a file scan.
    """
    return rows.withColumn("pos", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row")))
