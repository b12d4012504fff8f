"""What reaches an inventory (M7-M15, A11-A13). Every function is scoped to one owner."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import vocab
from vigil.functions.text import contains_ci, fold_name
from vigil.functions.version import version_sort_key, version_tokens
from vigil.operators.inventory import list_assets
from vigil.plans import marts, queries


ASSET = ["owner_id", "environment_id", "asset_id"]  # an asset id alone may occur under several owners


def scoped(matches: DataFrame, owner: str, environment_id: str) -> DataFrame:
    return matches.filter((F.col("owner_id") == owner) & (F.col("environment_id") == environment_id))


def _states(states: list[str] | None) -> list[str]:
    chosen = list(states or vocab.REACHING_STATES)
    if set(chosen) - set(vocab.STATES):
        raise queries.BadRequest(f"state must be one of {vocab.STATES}")
    return chosen


def list_matches(matches: DataFrame, states: list[str] | None = None) -> DataFrame:
    """Matches, most exposed first; without states all of them (M7)."""
    rows = matches if not states else matches.filter(F.col("state").isin(_states(states)))
    return rows.orderBy(F.col("exposure").desc(), "cve_id", "asset_id")


def matched_cves(matches: DataFrame, states: list[str] | None = None, asset_id: str | None = None) -> DataFrame:
    """Distinct CVEs that reach the environment (M8)."""
    rows = matches.filter(F.col("state").isin(_states(states)))
    if asset_id is not None:
        rows = rows.filter(F.col("asset_id") == asset_id)
    return rows.select("cve_id").distinct()


def counts_by_asset(assets: DataFrame, matches: DataFrame, states: list[str] | None = None,
                    passing: DataFrame | None = None) -> DataFrame:
    """Matches per asset and state; assets without any stay with zeros (M9)."""
    rows = matches if passing is None else matches.join(passing.select("cve_id"), "cve_id", "left_semi")
    wanted = _states(states)
    counts = rows.groupBy(*ASSET).agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in vocab.STATES],
        F.count_if(F.col("state").isin(wanted)).alias("total"))
    numbers = [*vocab.STATES, "total"]
    columns = [*ASSET, "label", "vendor", "product", "category"]
    return assets.select(*columns).join(counts, ASSET, "left").select(*columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])


def asset_order() -> list[Column]:
    return [F.col("affected").desc(), F.col("possibly_affected").desc(), F.col("label"), F.col("asset_id")]


def environment_total(assets: DataFrame, matches: DataFrame, states: list[str] | None = None,
                      passing: DataFrame | None = None) -> DataFrame:
    """Distinct CVEs over all assets, which is not the sum of the assets' numbers (M9)."""
    rows = matches.join(assets.select(*ASSET), ASSET, "left_semi")
    if passing is not None:
        rows = rows.join(passing.select("cve_id"), "cve_id", "left_semi")
    return matched_cves(rows, states).agg(F.count("*").alias("total"))


def exposure_by_cve(matches: DataFrame, states: list[str] | None = None, asset_id: str | None = None) -> DataFrame:
    """Strongest exposure of each CVE within the selection."""
    rows = matches.filter(F.col("state").isin(_states(states)))
    if asset_id is not None:
        rows = rows.filter(F.col("asset_id") == asset_id)
    return rows.groupBy("cve_id").agg(F.max("exposure").alias("exposure"))


def documents_for(matches: DataFrame, edge: DataFrame, docs: DataFrame, limit: int = 20) -> DataFrame:
    """Newest documents that mention a CVE reaching the environment, with those CVEs.

    The newest ``limit`` documents are chosen first; CVE lists are collected for them only.
    """
    named = edge.filter((F.col("subject_type") == "document") & (F.col("object_type") == "cve")).select(
        F.col("subject_id").alias("url"), F.col("object_id").alias("cve_id")).join(
        matched_cves(matches), "cve_id", "left_semi")
    newest = docs.join(named.select("url"), "url", "left_semi").orderBy(*queries.document_order()).limit(limit)
    covered = named.join(newest.select("url"), "url", "left_semi").groupBy("url").agg(
        F.array_sort(F.collect_set("cve_id")).alias("cves"))
    return newest.select("url", "title", "published_at").join(covered, "url")


def versions_for(products: DataFrame, vendor: str, product: str, limit: int = 60) -> DataFrame:
    """Versions advisories named for one product, newest first."""
    asked, named = fold_name(F.lit(vendor)), fold_name(F.col("vendor"))
    rows = products.filter((fold_name(F.col("product")) == fold_name(F.lit(product))) & F.col("versions").isNotNull())
    rows = rows.filter(asked.isin("", "n/a") | named.isin("", "n/a") | (named == asked))
    return rows.select(F.explode(version_tokens(F.col("versions"))).alias("version")).distinct().orderBy(
        version_sort_key(F.col("version")).desc(), F.col("version").desc()).limit(limit)


def versions_by_product(products: DataFrame, limit: int | None = None) -> DataFrame:
    """The same list for every (vendor, product) at once; ``limit`` keeps the newest ones."""
    rows = products.filter(fold_name(F.col("product")) != "").select(
        fold_name(F.col("vendor")).alias("vendor"), fold_name(F.col("product")).alias("product"),
        F.explode(version_tokens(F.col("versions"))).alias("version")).distinct()
    w = Window.partitionBy("vendor", "product").orderBy(version_sort_key(F.col("version")).desc(), F.col("version").desc())
    ranked = rows.withColumn("position", F.row_number().over(w))
    return ranked if limit is None else ranked.filter(F.col("position") <= limit)


def catalogue(products: DataFrame, term: str, limit: int | None = 20) -> DataFrame:
    """Vendor and product pairs whose product contains ``term``, most rows first."""
    rows = products.filter(
        contains_ci(F.col("product"), term.strip()) & ~F.col("product").isin("", "n/a") & (F.col("vendor") != "n/a"))
    pairs = rows.groupBy(F.lower("vendor").alias("_v"), F.lower("product").alias("_p")).agg(
        F.min("vendor").alias("vendor"), F.min("product").alias("product"), F.count("*").alias("rows")).orderBy(
        F.col("rows").desc(), "_v", "_p")
    return (pairs.limit(limit) if limit else pairs).select("vendor", "product", "rows")


def strongest_match(matches: DataFrame, states: list[str] | None = None, asset_id: str | None = None) -> DataFrame:
    """One verdict per CVE: the most exposed one within the selection."""
    rows = matches.filter(F.col("state").isin(_states(states)))
    if asset_id is not None:
        rows = rows.filter(F.col("asset_id") == asset_id)
    best = F.max_by(F.struct("asset_id", "state", "method", "confidence", "evidence", "exposure"),
                    F.struct(F.col("exposure"), F.col("asset_id")))
    return rows.groupBy("cve_id").agg(best.alias("m")).select("cve_id", "m.*")


def environment_threats(vulns: DataFrame, matches: DataFrame, as_of: datetime, *, states: list[str] | None = None,
                        asset_id: str | None = None, **filters) -> DataFrame:
    """The threat table narrowed to what the environment runs, each row with its verdict."""
    rows = queries.threats(vulns, as_of, **filters)
    return rows.join(strongest_match(matches, states, asset_id), "cve_id")


def environment_order(sort: str = "relevance") -> list[Column]:
    if sort == "relevance":
        return [F.col("exposure").desc(), F.col("relevance_score").desc_nulls_last(), F.col("cve_id")]
    return queries.threat_order(sort)


def header(assets: DataFrame, matches: DataFrame, owner: str, environment_id: str) -> tuple[DataFrame, DataFrame]:
    """The asset list and the number of matches per state."""
    counts = matches.groupBy("state").agg(F.count("*").alias("count"))
    return list_assets(assets, owner, environment_id), marts.zero_filled(counts, "state", vocab.STATES)


# ------------------------------------------------------------------------------------ summaries
def verdict_split(matches: DataFrame) -> DataFrame:
    """Distinct CVEs per state, all three states."""
    counts = matches.select("state", "cve_id").distinct().groupBy("state").agg(F.count("*").alias("count"))
    labels = F.create_map(*[F.lit(x) for pair in vocab.STATE_LABELS.items() for x in pair])
    return marts.zero_filled(counts, "state", vocab.STATES).withColumn("label", F.element_at(labels, F.col("state")))


def reaching_severity(matches: DataFrame, vulns: DataFrame) -> DataFrame:
    """Severity of the CVEs that reach the environment."""
    return marts.severity_mix(vulns.join(matched_cves(matches), "cve_id", "left_semi"))


def figures(matches: DataFrame, vulns: DataFrame, edge: DataFrame) -> DataFrame:
    """Reaching CVEs: total, listed as exploited, with public exploit, with a rule."""
    reaching = matched_cves(matches)
    rules = edge.filter((F.col("subject_type") == "rule") & (F.col("object_type") == "cve")).select(
        F.col("object_id").alias("cve_id"), F.lit(True).alias("has_rule")).distinct()
    rows = reaching.join(vulns.select("cve_id", "in_kev", "has_exploit"), "cve_id", "left").join(rules, "cve_id", "left")
    counts = rows.agg(
        F.count_if("in_kev").alias("in_kev"), F.count_if("has_exploit").alias("has_public_exploit"),
        F.count_if("has_rule").alias("has_detection_rule"), F.count("*").alias("total"))
    return marts._long(counts, "figure", "value")
