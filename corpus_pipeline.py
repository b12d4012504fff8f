"""A training-data pipeline over ``documents``: five stages, each an operator of vigil/llm over all that is left.

A stage's temporary tables are dropped when the next stage starts, as its result has been written by then; the rows of
a stage but the last go when the one after it has been written.

Defined cases: a null text counts as empty, null ids are kept where a stage keeps the row; repeated rows are one row from
the second stage on; of rows that tie, the stage's operator says which stays; empty tables pass through; extra columns
are kept whatever their names, and the copy's number is ``copy``, with underscores behind it where that name is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import decontaminate, exact_dedup, jaccard_join, mixing, quality
from vigil.llm.shared import Workspace, free_name, keep_rows, load, row_key

_open: dict[str, Workspace] = {}  # the workspace of the last stage, by application


def _workspace(spark: SparkSession, name: str) -> Workspace:
    application = spark.sparkContext.applicationId
    if application in _open:
        _open.pop(application).drop()
    _open[application] = Workspace(spark, name)
    return _open[application]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the classifier rejects go."""
    model = quality.train(docs, load(spark, sf_dir, "labels"))
    score = free_name(docs, "__score")
    return docs.withColumn(score, quality.scored(model)).where(quality.accepted(F.col(score)) == 1).drop(score)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of equal texts the document with the largest id stays."""
    found = exact_dedup.dedup(docs, _workspace(spark, "exact_duplicates"))
    return keep_rows(docs, found.where("kept"), ["source", "lang"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of a class of near copies the document with the smallest id stays."""
    found = jaccard_join.similar(docs, _workspace(spark, "near_duplicates"))
    return keep_rows(docs, found.where("key = class_key"), ["source", "lang"])


def benchmark_contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: contaminated documents go."""
    found = decontaminate.scan(docs, load(spark, sf_dir, "benchmark"), _workspace(spark, "benchmark_contamination"))
    key = free_name(docs, "__key")
    dropped = found.where("contaminated").select(F.col("key").alias(f"{key}dropped"))
    return docs.withColumn(key, row_key()).join(dropped, F.col(key) == F.col(f"{key}dropped"), "left_anti").drop(key)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents as often as the mix takes them, with the number of the copy."""
    return mixing.emit(docs, mixing.mix(docs, _workspace(spark, "mixture")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter), ("exact_dedup", exact_duplicates), ("near_dedup", near_duplicates),
    ("decontamination", benchmark_contamination), ("mixing", mixture)]

# The quality stage is learned, so SQL can't express the rows of the run; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of ``documents``; each stage's rows are written and read again."""
    written = Workspace(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    names = [name for name, _ in STAGES]
    for k, (name, stage) in enumerate(STAGES):
        docs = written.store(stage(spark, docs, sf_dir), name)
        if k >= 1:
            written.drop_one(names[k - 1])
    return docs
