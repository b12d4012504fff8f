"""Malware family names to known software."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.observable import family_keys
from vigil.functions.text import trimmed


def software_names(objects: DataFrame) -> DataFrame:
    """Lowered name or alias to object; names rank before aliases."""
    soft = objects.filter(F.col("obj_type").isin("malware", "tool"))
    names = soft.select(F.lower("name").alias("look"), F.lit(0).alias("rank"), "stix_id")
    aliases = soft.select(F.explode("aliases").alias("a"), "stix_id").select(
        F.lower("a").alias("look"), F.lit(1).alias("rank"), "stix_id")
    best = F.min(F.struct("rank", "stix_id"))
    return names.unionByName(aliases).groupBy("look").agg(best.alias("b")).select("look", "b.rank", "b.stix_id")


def resolve_names(candidates: DataFrame, column: str, objects: DataFrame) -> DataFrame:
    """Each distinct spelling once: its object, trying the full name before the stripped one."""
    distinct = candidates.select(F.col(column).alias("candidate")).distinct()
    keys = distinct.select("candidate", F.posexplode(family_keys(F.col("candidate"))).alias("key_pos", "look"))
    hit = keys.join(software_names(objects), "look")
    best = F.min(F.struct("key_pos", "rank", "stix_id"))
    return hit.groupBy("candidate").agg(best.alias("b")).select("candidate", F.col("b.stix_id").alias("stix_id"))


def resolve_families(indicators: DataFrame, objects: DataFrame, keys: list[str]) -> DataFrame:
    """Set ``family`` and ``attack_stix_id`` from the first candidate that resolves.

    Distinct spellings are resolved first, so a family carried by a third of all rows costs one
    lookup; the rows then join a table no larger than the number of spellings.
    """
    rows = indicators.select(*keys, F.posexplode("candidates").alias("pos", "candidate"))
    known = resolve_names(rows, "candidate", objects)
    best = F.min(F.struct("pos", "candidate", "stix_id"))
    chosen = rows.join(known, "candidate").groupBy(*keys).agg(best.alias("_best"))
    joined = indicators.join(chosen, keys, "left")
    return joined.withColumns({
        "family": F.coalesce(trimmed(F.col("_best.candidate")), F.col("family")),
        "attack_stix_id": F.col("_best.stix_id")}).drop("_best", "candidates")
