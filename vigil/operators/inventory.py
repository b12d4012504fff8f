"""Environments and their assets, always scoped to an owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typing import NamedTuple

from vigil import vocab
from vigil.functions.text import drop_controls
from vigil.operators import match
from vigil.sources.common import Parsed, split_rejects

# fixed values: field length limits
LIMITS = {"label": 120, "vendor": 200, "product": 300, "version": 64, "cpe": 400, "hardware_model": 120, "notes": 2000}
NEEDED = ["label", "vendor", "product"]


class InventoryFull(ValueError):
    """The owner would have more assets than allowed."""


def owned(table: DataFrame, owner: str) -> DataFrame:
    return table.filter(F.col("owner_id") == owner)


def list_environments(environments: DataFrame, owner: str) -> DataFrame:
    return owned(environments, owner).orderBy("name")


def default_environment(environments: DataFrame, owner: str) -> DataFrame:
    """The owner's first environment; a fresh one when there is none."""
    spark = environments.sparkSession
    first = owned(environments, owner).orderBy("environment_id").limit(1)
    fresh = spark.range(1).select(
        F.concat(F.lit("env:"), F.lit(owner)).alias("environment_id"), F.lit(owner).alias("owner_id"),
        F.lit("My environment").alias("name"), F.lit("inventory").alias("kind"))
    return first.unionByName(fresh.join(first.select("owner_id"), "owner_id", "left_anti"))


def list_assets(assets: DataFrame, owner: str, environment_id: str) -> DataFrame:
    return owned(assets, owner).filter(F.col("environment_id") == environment_id).orderBy("category", "label", "asset_id")


def get_asset(assets: DataFrame, owner: str, asset_id: str) -> DataFrame:
    return owned(assets, owner).filter(F.col("asset_id") == asset_id)


def validate_assets(rows: DataFrame) -> Parsed:
    """Owner-typed rows: known category, lengths, no control characters; the rest is rejected with a reason."""
    category = F.lower(F.trim(F.coalesce("category", F.lit(""))))
    reason: Column = F.when(~category.isin(vocab.ASSET_CATEGORIES), "unknown category")
    for name, limit in LIMITS.items():
        raw = F.col(name)
        reason = reason.when(F.length(raw) > limit, f"{name} too long")
        if name in NEEDED:
            reason = reason.when(F.length(F.coalesce(raw, F.lit(""))) < 1, f"{name} missing")
    parsed = split_rejects(rows, "inventory", reason, F.col("label"))
    cleaned = {name: drop_controls(F.col(name)) for name in LIMITS}
    good = parsed.good.withColumns(cleaned).withColumn("category", category)
    # white space alone passes the length test but leaves nothing
    hollow = F.lit(False)
    for name in NEEDED:
        hollow = hollow | F.col(name).isNull()
    late = split_rejects(good, "inventory", F.when(hollow, "empty after cleaning"), F.col("category"))
    return Parsed(late.good, parsed.rejects.unionByName(late.rejects))


def put_assets(assets: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert or replace assets by (owner, id). An owner above the limit is refused, not cut."""
    keys = ["owner_id", "asset_id"]
    merged = assets.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)
    crowded = merged.groupBy("owner_id").agg(F.count("*").alias("n")).filter(F.col("n") > vocab.MAX_ASSETS)
    if crowded.take(1):
        raise InventoryFull(f"an owner may have {vocab.MAX_ASSETS} assets")
    return merged


def delete_assets(assets: DataFrame, matches: DataFrame, owner: str, asset_ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables without the owner's named assets."""
    gone = (F.col("owner_id") == owner) & F.col("asset_id").isin(asset_ids)
    return assets.filter(~gone), matches.filter(~gone)


class Inventory(NamedTuple):
    assets: DataFrame
    matches: DataFrame


def change_assets(now: Inventory, puts: DataFrame, gone: DataFrame, products: DataFrame, vulns: DataFrame) -> Inventory:
    """One change set for both tables: ``puts`` are inserted or replaced, ``gone`` deleted, by owner, environment and id (M6, M7).

    Matches of every named asset go, and those of the assets that were put are found again; other assets are not matched.
    An asset that is put and gone is gone. Ids are an owner's own, so an id that two owners use is two assets.
    """
    key = match.PAIR[:3]
    named = puts.select(*key).unionByName(gone.select(*key)).distinct()
    kept = puts.join(gone.select(*key).distinct(), key, "left_anti")
    assets = put_assets(now.assets.join(named, key, "left_anti"), kept)
    fresh = match.fresh_matches(assets, products, vulns, changed_assets=kept)
    return Inventory(assets, now.matches.join(named, key, "left_anti").unionByName(fresh, allowMissingColumns=True))
