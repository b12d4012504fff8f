"""Numbers in the order of a group without a window over a large group.

Groups of a few rows, nearly all, are dealt by their key and numbered where they lie. Rows of a larger one are cut into
ranges by the group's key and the whole order, so a group that holds a third of all rows spans many ranges and tasks.
Within a range a row's place is known once it is stored; what precedes it in its group is added from one row per range
and group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PLACE_BITS = 33  # monotonically_increasing_id keeps a row's place in its partition in the low bits

Keep = Callable[[DataFrame], DataFrame]


def as_planned(rows: DataFrame) -> DataFrame:
    """Where nothing is stored: rows are made as often as they are read."""
    return rows


GROUP_ROWS = 100_000  # a group of more is numbered over ranges
TASK_ROWS = 250_000  # rows that one task sorts in memory


def dealt(stored: DataFrame, group: list[str]) -> DataFrame:
    """Stored rows by their group over so many partitions that a task sorts its rows in memory."""
    wide = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored.repartition(max(wide, -(-stored.count() // TASK_ROWS)), *group)


def numbered(rows: DataFrame, group: list[str], order: list[Column], keep: Keep, most: int = GROUP_ROWS) -> DataFrame:
    """``rows`` with ``number``: 1, 2, ... in ``order`` within each group (``[]``: in the whole table).

    ``keep`` stores the rows once, and those of a group of more than ``most`` sorted, and reads them back. Rows equal in the
    whole order are numbered as they come.
    """
    if not group:
        return ranged(rows, group, order, keep)
    stored = keep(rows)
    renamed = {g: f"_g{i}" for i, g in enumerate(group)}
    large = keep(stored.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > most).select(
        *[F.col(g).alias(renamed[g]) for g in group]))  # stored, its size is known: it is sent to the rows, which stay where they lie
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(renamed[g]))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")
    if large.isEmpty():
        return dealt(stored, group).withColumn("number", place)
    return dealt(stored.join(large, on, "left_anti"), group).withColumn("number", place).unionByName(
        ranged(stored.join(large, on, "left_semi"), group, order, keep))


def ranged(rows: DataFrame, group: list[str], order: list[Column], keep: Keep) -> DataFrame:
    """The same over ranges, whatever the size of a group."""
    keys = [*[F.col(g).asc_nulls_first() for g in group], *order]
    stored = keep(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()))
    placed = stored.withColumns({"_part": F.shiftright("_id", _PLACE_BITS), "_pos": F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))}).drop("_id")
    sums = placed.groupBy("_part", *group).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1
    renamed = {g: f"_g{i}" for i, g in enumerate(group)}
    offsets = sums.select(F.col("_part").alias("_p"), *[F.col(g).alias(renamed[g]) for g in group], shift.alias("_shift"))
    on = F.col("_part") == F.col("_p")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(renamed[g]))
    return placed.join(offsets, on).withColumn("number", F.col("_pos") + F.col("_shift")).drop("_part", "_pos", "_p", "_shift", *renamed.values())
