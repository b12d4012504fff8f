"""Mixing sources to target weights by systematic sampling.

Within a source, documents are put in an order; each has the same expected number of copies, the source's target over
its size. The prefix sum of expected copies plus one random offset per source crosses an integer once for each copy
that a document gives. Documents are ordered by size, so neighbours on the line are alike and the words taken differ
from the target by about one document. The prefix sum is a rank times the rate: ranks come from range partitions
(ordering.py), so a source with a third of all rows is no task of its own.

Defined cases: null text has size 0; null is a source of its own, the last; documents of size 0 are copied as others
and add no words; a table without words has targets of 0; rows that repeat one another are sampled one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.ordering import ordered, part_offsets
from vigil.llm.shared import Workspace, body, free_name, row_key

TOKEN = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources by code point, null last, take the weights in turn. A level is shared by weight until a source is full
    (``most`` times its size): with the sources in the order in which they fill up, the final level is the largest of
    (what is left after the first k) / (weights that are left). Works on one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weighted = per_source.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")))
    order = Window.orderBy((F.col("source_size") * most / F.col("weight")), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    level = (left.cast("double") / F.sum("weight").over(rest).cast("double"))
    return (weighted.withColumn("level", level).withColumn("final", F.max("level").over(everything))
            .select("source", "source_size",
                    F.least((F.col("source_size") * most).cast("double"), F.col("final") * F.col("weight")).alias("target")))


def random_offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) with 20 bits, from the seed and the source's name."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(name), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))


def mix(docs: DataFrame, ws: Workspace, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row per document: doc_id, key, size, source, source_size, target, copies, taken."""
    sizes = ws.store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), "source",
                                 F.regexp_count(body(), F.lit(TOKEN)).cast("long").alias("size")), "sizes")
    line = ordered(ws, sizes, [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("doc_id").asc_nulls_first()], "line")
    targets = source_targets(sizes, weights, most)
    offsets = part_offsets(line, ["source"])
    plan = (offsets.join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
            .select(F.col("part").alias("__part"), F.col("source").alias("__source"), "first_pos", "before", "source_size", "target"))
    rank = F.col("pos") - F.col("first_pos") + F.col("before")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    shift = random_offset(F.col("source"), seed)
    placed = line.join(plan, (F.col("part") == F.col("__part")) & F.col("source").eqNullSafe(F.col("__source")))
    copies = (F.floor(rate * (rank + 1).cast("double") + shift) - F.floor(rate * rank.cast("double") + shift)).cast("long")
    return (placed.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
            .select("doc_id", "key", "size", "source", "source_size", "target", "copies", "taken"))


def emit(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: the columns of ``docs`` and ``copy`` (1, 2, ...), a row per copy.

    Rows that repeat one another share a key; they take its copy counts one by one, in the partitioning of the join.
    Where ``docs`` has a column ``copy``, the new one has underscores behind its name.
    """
    columns = docs.columns
    key, copies, place, take = (free_name(docs, n) for n in ("__key", "__copies", "__n", "__take"))
    counts = plan.groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_list("copies")).alias(copies))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))
    rows = docs.withColumn(key, row_key()).join(counts, key).withColumn(place, nth)
    taken = rows.withColumn(take, F.element_at(F.col(copies), F.col(place))).where(F.col(take) > 0)
    return taken.select(*columns, F.explode(F.sequence(F.lit(1), F.col(take).cast("int"))).alias(free_name(docs, "copy")))
