"""Positions in a global order without a window over all rows or over one key's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.shared import Workspace

_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in the low 33 bits


def ordered(ws: Workspace, df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``df`` stored in the order of ``keys``, with ``part`` (range partition) and ``pos`` (place in it).

    A range partition is cut by the whole composite key, so one source, size or conversation that holds
    many rows spans several partitions. Once stored, places don't change when a task runs again.
    """
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    stored = ws.store(placed, name)
    return (stored.withColumn("part", F.shiftright("__id", _BITS))
            .withColumn("pos", F.col("__id").bitwiseAND(F.lit((1 << _BITS) - 1))).drop("__id"))


def part_offsets(df: DataFrame, group: list[str]) -> DataFrame:
    """One row per (part, group): the first place of the group in the part and its rows in earlier parts.

    There are as many rows as partitions, and one more for each group.
    """
    sums = df.groupBy("part", *group).agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("part_rows"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum("part_rows").over(before), F.lit(0)))


def global_position(df: DataFrame) -> DataFrame:
    """Replace ``part`` and ``pos`` by ``position``: 0, 1, 2, ... over the whole table."""
    sums = df.groupBy("part").agg(F.count(F.lit(1)).alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sums.select("part", F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("before"))
    return df.join(offsets, "part").withColumn("position", F.col("before") + F.col("pos")).drop("part", "pos", "before")
