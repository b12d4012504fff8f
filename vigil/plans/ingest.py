"""One-shot collection of landed files into the canonical tables."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import schemas
from vigil.operators import family, inventory, link, match, merge, names, recompute
from vigil.session import literal_rows
from vigil.sources import attack, exploit_archive, feed, indicators, kev, nvd, registry, repositories, rules
from vigil.store import Store

TRACK_DAYS = 120
_FEEDS = {row[0]: row for row in registry.FEEDS}


def _counts(rows: DataFrame, rejects: DataFrame | None) -> dict[str, int]:
    """New, updated and malformed rows of a commit, as one small row read by the driver."""
    got = rows.agg(
        F.count_if(F.col("change") == "new").alias("new"), F.count_if(F.col("change") == "updated").alias("updated"),
        F.count_if(F.col("change") != "kept").alias("fetched")).head()
    bad = rejects.count() if rejects is not None else 0
    return {"new": got["new"], "updated": got["updated"], "malformed": bad, "fetched": got["fetched"] + bad}


def record_changes(store: Store, reason: str, cves: DataFrame | None = None, assets: DataFrame | None = None) -> None:
    """Add touched CVEs or assets to the change feed, which the next refresh reads from its last place on."""
    run, none = F.lit(store.version("change_feed") + 1).cast("long"), F.lit(None).cast("string")
    owner = ["owner_id", "environment_id", "asset_id"]
    if cves is not None:
        rows = cves.select("cve_id").distinct().select(run.alias("run"), F.lit(reason).alias("reason"), "cve_id", *[none.alias(c) for c in owner])
    else:
        rows = assets.select(*owner).distinct().select(run.alias("run"), F.lit(reason).alias("reason"), none.alias("cve_id"), *owner)
    store.append("change_feed", rows)


def changes_since(store: Store, run: int) -> tuple[DataFrame, DataFrame]:
    """(touched CVEs, touched assets) of all feed entries after ``run``."""
    feed = store.read("change_feed").filter(F.col("run") > run)
    cves = feed.filter("cve_id IS NOT NULL").select("cve_id").distinct()
    return cves, feed.filter("asset_id IS NOT NULL").select("owner_id", "environment_id", "asset_id").distinct()


def _noted(store: Store, reason: str, cves_of=merge.touched):
    return lambda rows: record_changes(store, reason, cves_of(rows))


def _add_edges(store: Store, edges: DataFrame) -> None:
    store.add_missing("edge", edges, lambda known, batch: link.new_edges(known, batch))


# Order of commits: a parent before its children, so that a run that died in between leaves no child without a parent;
# the next run meets the same batch again and adds the children that are missing.
def _take_kev(store: Store, path: str, as_of: datetime) -> dict[str, int]:
    parsed = kev.read_kev(store.spark, path)
    entries = store.staged("vulnerability", merge.first_wins(parsed.good, ["cve_id"], ["kev_date_added"]))
    done = store.merge("vulnerability", entries, lambda known, batch: merge.apply_kev(known, batch, as_of), note=_noted(store, "cisa_kev"))
    store.add_missing("source_reference", merge.kev_references(entries), merge.new_references)
    store.add_missing("affected_product", merge.kev_products(entries), merge.new_products)
    return _counts(done.rows, parsed.rejects)


def _take_nvd(store: Store, path: str, as_of: datetime) -> dict[str, int]:
    parsed = nvd.read_nvd(store.spark, path)
    records = store.staged("vulnerability", merge.first_wins(parsed.good, ["cve_id"], [F.col("last_modified").desc_nulls_last()]))
    after = as_of - timedelta(days=TRACK_DAYS)
    done = store.merge("vulnerability", records, lambda known, batch: merge.apply_nvd(known, batch, as_of, track_after=after),
                       note=_noted(store, "nvd"))
    kept = records.join(done.rows.filter(F.col("change") != "kept").select("cve_id"), "cve_id", "left_semi")
    store.add_missing("source_reference", merge.nvd_references(kept), merge.new_references)
    store.add_missing("affected_product", merge.nvd_products(kept), merge.new_products)
    payloads = kept.select("cve_id", F.to_json(F.struct("*")).alias("payload"), F.lit(True).alias("found"),
                           F.lit(as_of).cast("timestamp").alias("fetched_at"))
    store.merge("payload_cache", payloads, merge.put_payloads)
    return _counts(done.rows, parsed.rejects)


def _cves(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("change").isin("new", "updated")).select(F.explode("cve_ids").alias("cve_id"))


def _take_exploits(store: Store, parsed, upsert, as_of: datetime, key: str) -> dict[str, int]:
    done = store.merge("exploit", parsed.good, lambda known, batch: upsert(known, batch, as_of), note=_noted(store, key, _cves))
    _add_edges(store, link.exploit_edges(done.rows.filter(F.col("change") != "kept")))
    return _counts(done.rows, parsed.rejects)


def _cve_objects(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("object_type") == "cve").select(F.col("object_id").alias("cve_id"))


def _take_feed(store: Store, path: str, as_of: datetime, key: str) -> dict[str, int]:
    """A document that has its extraction version has its edges, so edges are added first here."""
    row = _FEEDS[key]
    parsed = feed.read_feed(store.spark, path, key, row[10] or "news", row[4])
    table = names.build_name_table(store.read("attack_object"))
    stale = ~F.col("extraction_version").eqNullSafe(F.lit(table.version))

    def fold(known: DataFrame, batch: DataFrame) -> DataFrame:
        merged = merge.upsert_documents(known, batch, as_of)
        todo = F.col("change").isin("new", "updated") | ((F.col("change") == "unchanged") & stale)
        return merged.withColumn("extraction_version", F.when(todo, F.lit(None).cast("string")).otherwise(F.col("extraction_version")))

    done = store.merge("document", parsed.good, fold)
    _link_pending(store, table, done.rows.drop("change").filter("extraction_version IS NULL"), key)
    return _counts(done.rows, parsed.rejects)


def _link_pending(store: Store, table: names.NameTable, docs: DataFrame, reason: str) -> None:
    """Extract documents again: their missing edges are added, then the documents say which dictionary they were read with."""
    text = docs.withColumn("full_text", F.concat_ws(" ", F.coalesce("full_text", "summary"), F.array_join("categories", " ")))
    found = link.extract(text, table)
    edges = store.staged("edge", found.edges)
    record_changes(store, reason, _cve_objects(edges))
    _add_edges(store, edges)
    flags = found.documents.select("url", "reports_exploitation", "extraction_version")
    store.merge("document", flags, link.with_flags)


def _take_attack(store: Store, path: str, as_of: datetime) -> dict[str, int]:
    bundle = attack.read_attack(store.spark, path)
    done = store.merge("attack_object", bundle.objects, merge.upsert_attack_objects)
    store.write("attack_relationship", bundle.relationships)
    table = names.build_name_table(store.read("attack_object"))
    _link_pending(store, table, link.stale_documents(store.read("document"), table.version, as_of), "mitre_attack")
    return _counts(done.rows, bundle.rejects)


def _take_rules(store: Store, path: str, as_of: datetime, release: str) -> dict[str, int]:
    parsed = rules.read_rules(store.spark, path, release)
    done = store.merge("detection_rule", parsed.good, lambda known, batch: merge.upsert_rules(known, batch, as_of),
                       note=_noted(store, "rules", _cves))
    techniques = names.build_techniques(store.read("attack_object"))
    _add_edges(store, link.rule_edges(done.rows.filter(F.col("change") != "kept"), techniques))
    return _counts(done.rows, parsed.rejects)


def _take_indicators(store: Store, parsed, as_of: datetime) -> dict[str, int]:
    keys = ["source_key", "kind", "value_norm"]
    unique = merge.first_wins(parsed.good, keys, [F.col("pos")])
    resolved = family.resolve_families(unique, store.read("attack_object"), keys)
    done = store.merge("indicator", resolved, lambda known, batch: merge.refresh_indicators(known, batch, as_of))
    return _counts(done.rows, parsed.rejects)


def _take(store: Store, key: str, path: str, as_of: datetime, release: str) -> dict[str, int]:
    reader = registry.READERS.get(key)
    if reader == "kev":
        return _take_kev(store, path, as_of)
    if reader == "nvd":
        return _take_nvd(store, path, as_of)
    if reader == "exploit_archive":
        return _take_exploits(store, exploit_archive.read_exploit_archive(store.spark, path), merge.upsert_exploits, as_of, key)
    if reader == "repositories":
        return _take_exploits(store, repositories.read_repositories(store.spark, path), merge.upsert_repositories, as_of, key)
    if reader == "attack":
        return _take_attack(store, path, as_of)
    if reader == "rules":
        return _take_rules(store, path, as_of, release)
    if reader == "samples":
        return _take_indicators(store, indicators.read_samples(store.spark, path), as_of)
    if reader == "urls":
        return _take_indicators(store, indicators.read_urls(store.spark, path), as_of)
    if reader == "feed":
        return _take_feed(store, path, as_of, key)
    raise KeyError(f"source {key} has no reader")


def run_ingest(spark: SparkSession, in_dir: str, out_dir: str, keys: list[str], as_of: datetime,
               release: str = "landed") -> DataFrame:
    """Take in the landed files of the named sources, one after the other, and log each run.

    ``in_dir/<key>`` holds the files of a source. A source that fails is logged as failed and does
    not stop the others. Returns the run log.
    """
    store, log = Store(spark, out_dir), []
    for key in keys:
        started, error, stats = time.monotonic(), None, {"fetched": 0, "new": 0, "updated": 0, "malformed": 0}
        try:
            stats = _take(store, key, f"{in_dir.rstrip('/')}/{key}", as_of, release)
        except Exception as exc:  # noqa: BLE001 - one source must not stop the others
            error = f"{type(exc).__name__}: {str(exc)[:300]}"
        log.append((key, as_of, as_of, "error" if error else "success", stats["fetched"], stats["new"], stats["updated"],
                    stats["malformed"], int((time.monotonic() - started) * 1000), error))
    store.append("ingestion_run", literal_rows(spark, log, schemas.TABLES["ingestion_run"]))
    return store.read("ingestion_run")


def corpus_of(store: Store) -> recompute.Corpus:
    return recompute.Corpus(
        vulnerability=store.read("vulnerability"), affected_product=store.read("affected_product"),
        source_reference=store.read("source_reference"), exploit=store.read("exploit"), document=store.read("document"),
        edge=store.read("edge"), attack_object=store.read("attack_object"))


def refresh_marts(spark: SparkSession, out_dir: str, as_of: datetime, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """Bring derived vulnerability state and inventory matches up to the change feed's end; returns both tables.

    The first run, and ``full``, derive everything. Later ones derive the CVEs that the feed names since the last run,
    match those and the changed assets again, and rewrite their buckets. Each table's manifest holds the feed entry that
    it takes in, so a refresh that died in between goes on where it stopped. Scores also age: a periodic caller adds
    ``recompute.maintenance_keys`` to the feed with ``record_changes``.
    """
    store = Store(spark, out_dir)
    c, end = corpus_of(store), store.version("change_feed")
    if full or store.version("scored") < 0:
        store.write("scored", recompute.recompute(c, as_of), {"change_feed": end})
        matches = match.match_inventory(store.read("asset"), c.affected_product, store.read("scored"))
        store.write("match", matches, {"change_feed": end})
        return store.read("scored"), store.read("match")
    cves, _ = changes_since(store, store.marks("scored").get("change_feed", -1))
    if store.marks("scored").get("change_feed", -1) < end:
        store.replace("scored", cves, recompute.recompute(c, as_of, only=cves), {"change_feed": end})
    if store.marks("match").get("change_feed", -1) < end:
        cves, assets = changes_since(store, store.marks("match").get("change_feed", -1))
        refresh_matches(store, c.affected_product, cves, assets, end)
    return store.read("scored"), store.read("match")


def refresh_matches(store: Store, products: DataFrame, cves: DataFrame, assets: DataFrame, end: int) -> None:
    """Match changed CVEs and changed assets again. Changed assets may meet any CVE, so they have all buckets rewritten."""
    owned, known = store.read("asset"), store.read("scored")
    if assets.isEmpty():
        store.replace("match", cves, match.fresh_matches(owned, products, known, changed_cves=cves), {"change_feed": end})
        return
    store.write("match", match.rematch(store.read("match"), owned, products, known, assets, cves), {"change_feed": end})


def put_assets(spark: SparkSession, out_dir: str, rows: DataFrame) -> None:
    """Insert or replace assets and note them in the change feed."""
    store = Store(spark, out_dir)
    store.merge("asset", rows, inventory.put_assets, note=lambda _: record_changes(store, "inventory", assets=rows))


def delete_assets(spark: SparkSession, out_dir: str, keys: DataFrame) -> None:
    """Delete assets by owner, environment and id; their matches go with the next refresh."""
    store = Store(spark, out_dir)
    record_changes(store, "inventory", assets=keys)
    store.merge("asset", keys, lambda known, gone: known.join(gone, ["owner_id", "environment_id", "asset_id"], "left_anti"))


def vacuum(spark: SparkSession, out_dir: str, keep: int = 4) -> int:
    """Remove what the last ``keep`` commits of no table name any more."""
    store = Store(spark, out_dir)
    return sum(store.vacuum(table, keep) for table in schemas.TABLES if store.version(table) >= 0)
