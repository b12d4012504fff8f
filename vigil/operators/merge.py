"""Merging a batch into a snapshot.

A merge reads the snapshot and the batch, joins them once on the natural key, and returns the next
snapshot with a ``change`` column: 'new', 'updated', 'unchanged' (in the batch, nothing differs) or
'kept' (not in the batch). Writing the result replaces the snapshot.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import vocab

Rule = Callable[[Column, Column], Column]


def first_wins(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the smallest by ``order``.

    The rank filter limits every map partition to one row per key before the shuffle, so a key that
    holds a large share of the rows never gathers in one task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") == 1).drop("_rank")


def missing_rows(snapshot: DataFrame, batch: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First write wins: the batch's rows whose keys the snapshot does not have, in its columns."""
    fresh = first_wins(batch, keys, order).join(snapshot.select(*keys), keys, "left_anti")
    known = [c for c in snapshot.columns if c in fresh.columns]
    return snapshot.where("false").unionByName(fresh.select(*known), allowMissingColumns=True)


def insert_missing(snapshot: DataFrame, batch: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The snapshot as it is, and the keys that it does not have."""
    return snapshot.unionByName(missing_rows(snapshot, batch, keys, order))


def is_empty(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return col.isNull() | (col == "")
    if isinstance(dtype, T.ArrayType):
        return col.isNull() | (F.size(col) == 0)
    return col.isNull()


def overwrite(old: Column, new: Column) -> Column:
    """The batch decides, also with null."""
    return new


def keep_old(old: Column, new: Column) -> Column:
    """The first value stays."""
    return old


def prefer_new(dtype: T.DataType) -> Rule:
    """The batch decides unless it has nothing."""
    return lambda old, new: F.when(is_empty(new, dtype), old).otherwise(new)


def fill(dtype: T.DataType) -> Rule:
    """The batch only fills a gap."""
    return lambda old, new: F.when(is_empty(old, dtype), new).otherwise(old)


def merge(snapshot: DataFrame, batch: DataFrame, keys: list[str], rules: dict[str, Rule],
          compare: list[str] | None = None, accept: Column | None = None) -> DataFrame:
    """Full outer merge of a batch with unique keys.

    ``rules`` say how a column known to the batch combines with the old value; other columns stay.
    ``compare`` lists the columns whose difference makes a row 'updated' (default: all with a rule).
    ``accept`` is a condition on batch columns that a key new to the snapshot must meet.
    """
    o = snapshot.withColumn("_old", F.lit(True)).alias("o")
    n = batch.withColumn("_new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    joined = o.join(n, on, "full_outer")
    was, now = F.col("o._old").isNotNull(), F.col("n._new").isNotNull()
    if accept is not None:
        joined = joined.filter(was | F.coalesce(accept, F.lit(False)))
    merged: dict[str, Column] = {k: F.coalesce(f"o.{k}", f"n.{k}") for k in keys}
    for name in snapshot.columns:
        if name in merged:
            continue
        old = F.col(f"o.`{name}`")
        if name not in batch.columns or name not in rules:
            merged[name] = F.when(was, old).otherwise(F.col(f"n.`{name}`")) if name in batch.columns else old
            continue
        new = F.col(f"n.`{name}`")
        merged[name] = F.when(~now, old).when(~was, new).otherwise(rules[name](old, new))
    watched = [c for c in (compare or list(rules)) if c in snapshot.columns and c in batch.columns]
    same = F.lit(True)
    for name in watched:
        same = same & rules[name](F.col(f"o.`{name}`"), F.col(f"n.`{name}`")).eqNullSafe(F.col(f"o.`{name}`"))
    change = F.when(~now, "kept").when(~was, "new").when(same, "unchanged").otherwise("updated")
    return joined.select(*[merged[c].alias(c) for c in snapshot.columns], change.alias("change"))


def stamp(merged: DataFrame, as_of: datetime, created: list[str] = (), changed: list[str] = (),
          seen: list[str] = ()) -> DataFrame:
    """Set time columns from the kind of change: created, created-or-changed, present in the batch."""
    now, change = F.lit(as_of).cast("timestamp"), F.col("change")
    for names, when in ((created, change == "new"), (changed, change.isin("new", "updated")), (seen, change != "kept")):
        for name in names:
            merged = merged.withColumn(name, F.when(when, now).otherwise(F.col(name)))
    return merged


def next_snapshot(merged: DataFrame) -> DataFrame:
    return merged.drop("change")


def touched(merged: DataFrame, key: str = "cve_id") -> DataFrame:
    """Keys that were created or changed; what the recompute job is limited to."""
    return merged.filter(F.col("change").isin("new", "updated")).select(key)


# ------------------------------------------------------------------------------------ vulnerabilities
KEV_OWN = ["kev_name", "kev_date_added", "kev_due_date", "kev_required_action", "kev_ransomware", "kev_notes"]
NVD_OWN = ["vuln_status", "published", "last_modified", "cvss_score", "cvss_severity", "cvss_vector", "cvss_version",
           "ssvc_exploitation", "ssvc_automatable", "ssvc_technical_impact"]


def apply_kev(vulns: DataFrame, kev: DataFrame, as_of: datetime) -> DataFrame:
    """Known-exploited entries: own columns overwrite, descriptive columns only fill gaps."""
    text, strings = T.StringType(), T.ArrayType(T.StringType())
    batch = kev.select(
        "cve_id", *KEV_OWN, F.lit(True).alias("in_kev"), F.col("kev_name").alias("title"),
        F.col("short_description").alias("description"), "vendor", "product", "cwes")
    rules: dict[str, Rule] = {c: overwrite for c in [*KEV_OWN, "in_kev"]}
    rules |= {c: fill(text) for c in ("title", "description", "vendor", "product")}
    rules["cwes"] = fill(strings)
    merged = merge(vulns, batch, ["cve_id"], rules)
    return stamp(merged, as_of, created=["first_seen"], changed=["updated_at"])


def apply_nvd(vulns: DataFrame, nvd: DataFrame, as_of: datetime, track_after: datetime | None = None) -> DataFrame:
    """Database records: own columns overwrite also with null, text and CWEs overwrite when present,
    names only fill gaps (U2). Unknown records are taken up when published late enough (U3)."""
    text, strings = T.StringType(), T.ArrayType(T.StringType())
    batch = nvd.select(
        "cve_id", *NVD_OWN, "description", "cwes", F.col("primary_vendor").alias("vendor"),
        F.col("primary_product").alias("product"), F.substring("description", 1, 140).alias("title"),
        F.lit(False).alias("in_kev"))
    rules: dict[str, Rule] = {c: overwrite for c in NVD_OWN}
    rules |= {"description": prefer_new(text), "cwes": prefer_new(strings), "in_kev": keep_old}
    rules |= {c: fill(text) for c in ("vendor", "product", "title")}
    accept = None if track_after is None else F.col("n.published") >= F.lit(track_after).cast("timestamp")
    merged = merge(vulns, batch, ["cve_id"], rules, accept=accept)
    return stamp(merged, as_of, created=["first_seen"], changed=["updated_at"], seen=["nvd_fetched_at"])


def _reference(source: str, url: Column, ref_type: Column | str, title: Column, published: Column) -> Column:
    kind = F.lit(ref_type) if isinstance(ref_type, str) else ref_type
    return F.struct(
        F.lit(source).alias("source_key"), url.alias("url"), kind.alias("ref_type"), title.alias("title"),
        F.array().cast("array<string>").alias("tags"), published.cast("timestamp").alias("published_at"))


def kev_references(kev: DataFrame) -> DataFrame:
    """The catalogue link of each entry and the advisories named in its notes."""
    own = _reference(
        "cisa_kev", F.concat(F.lit(vocab.KEV_CATALOGUE_URL + "?search_api_fulltext="), "cve_id"), "kev",
        F.concat(F.lit("CISA KEV: "), F.coalesce("kev_name", "cve_id")), F.col("kev_date_added"))
    kept = F.filter("note_urls", lambda u: ~F.contains(u, F.lit("cisa.gov/news-events/directives"))
                    & ~F.contains(u, F.lit("nvd.nist.gov")))
    notes = F.transform(kept, lambda u: _reference(
        "cisa_kev", u, "vendor_advisory", F.lit("Vendor advisory (via CISA KEV notes)"), F.lit(None)))
    return kev.select("cve_id", F.posexplode(F.concat(F.array(own), notes)).alias("pos", "r")).select(
        "cve_id", "r.*", "pos")


def nvd_references(nvd: DataFrame) -> DataFrame:
    """The two record links of each CVE and the references the record lists."""
    nothing = F.lit(None).cast("string")
    heads = F.array(
        _reference("nvd", F.concat(F.lit(vocab.NVD_DETAIL_URL), "cve_id"), "nvd",
                   F.concat(F.lit("NVD: "), "cve_id"), F.col("published")),
        _reference("cve_org", F.concat(F.lit(vocab.CVE_RECORD_URL), "cve_id"), "cve_org",
                   F.concat(F.lit("CVE Record: "), "cve_id"), F.col("published")))
    listed = F.transform("references", lambda r: F.struct(
        F.lit("nvd").alias("source_key"), r["url"].alias("url"), r["ref_type"].alias("ref_type"), nothing.alias("title"),
        r["tags"].alias("tags"), F.lit(None).cast("timestamp").alias("published_at")))
    return nvd.select("cve_id", F.posexplode(F.concat(heads, listed)).alias("pos", "r")).select("cve_id", "r.*", "pos")


def new_references(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    return missing_rows(snapshot, batch, ["cve_id", "url"], ["pos"])


def add_references(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    return snapshot.unionByName(new_references(snapshot, batch))


def kev_products(kev: DataFrame) -> DataFrame:
    """One product row for each catalogue entry that names a vendor or a product."""
    vendor, product = F.coalesce("vendor", F.lit("")), F.coalesce("product", F.lit(""))
    return kev.filter((vendor != "") | (product != "")).select(
        "cve_id", vendor.alias("vendor"), product.alias("product"), F.lit("").alias("cpe"),
        F.lit(None).cast("string").alias("versions"), F.lit("cisa_kev").alias("source_key"))


def nvd_products(nvd: DataFrame) -> DataFrame:
    from vigil.sources.nvd import settle_products

    rows = nvd.select("cve_id", F.explode("products").alias("p")).select("cve_id", "p.*")
    return settle_products(rows, "cve_id").withColumn("source_key", F.lit("nvd")).drop("spot")


def new_products(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    return missing_rows(snapshot, batch, ["cve_id", "vendor", "product", "cpe"], ["source_key"])


def add_products(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    return snapshot.unionByName(new_products(snapshot, batch))


# ------------------------------------------------------------------------------------ other tables
def upsert_documents(docs: DataFrame, batch: DataFrame, as_of: datetime) -> DataFrame:
    """By canonical URL: new, changed content, or unchanged; first publication date stays."""
    order = [F.col(c) for c in ("pos", "content_hash") if c in batch.columns]
    rows = first_wins(batch, ["url"], order).withColumn(
        "published_at", F.coalesce("published_at", F.lit(as_of).cast("timestamp")))
    differs = ~F.col("o.content_hash").eqNullSafe(F.col("n.content_hash"))
    rules: dict[str, Rule] = {
        c: (lambda old, new: F.when(differs, new).otherwise(old))
        for c in ("title", "summary", "content_hash", "categories", "authors", "full_text")}
    merged = merge(docs, rows, ["url"], rules, compare=["content_hash"])
    return stamp(merged, as_of, created=["collected_at"], changed=["updated_at"])


def upsert_exploits(exploits: DataFrame, batch: DataFrame, as_of: datetime) -> DataFrame:
    """Archive rows by id; an existing row is replaced only when the source's own date moved."""
    keys = ["source_key", "external_id"]
    rows = first_wins(batch, keys, [F.col("pos")])
    moved = ~F.col("o.source_updated_at").eqNullSafe(F.col("n.source_updated_at"))
    rules: dict[str, Rule] = {
        c: (lambda old, new: F.when(moved, new).otherwise(old))
        for c in exploits.columns if c in rows.columns and c not in keys}
    merged = merge(exploits, rows, keys, rules, compare=["source_updated_at"])
    return stamp(merged, as_of, created=["collected_at"])


def upsert_repositories(exploits: DataFrame, batch: DataFrame, as_of: datetime) -> DataFrame:
    """Repositories by name: every field but the two dates is compared; the push date always moves (U8)."""
    keys = ["source_key", "external_id"]
    rows = first_wins(batch, keys, [F.col("source_updated_at").desc_nulls_last(), F.col("url")])
    rules: dict[str, Rule] = {c: overwrite for c in exploits.columns if c in rows.columns and c not in keys}
    rules["published_at"] = keep_old
    fields = [c for c in rules if c not in ("published_at", "source_updated_at")]
    merged = merge(exploits, rows, keys, rules, compare=fields)
    return stamp(merged, as_of, created=["collected_at"])


def refresh_indicators(indicators: DataFrame, batch: DataFrame, as_of: datetime) -> DataFrame:
    """Rolling-window dump: new rows are added, present ones refreshed, absent ones stay."""
    keys = ["source_key", "kind", "value_norm"]
    rows = first_wins(batch, keys, [F.col("pos")])
    rules: dict[str, Rule] = {c: overwrite for c in indicators.columns if c in rows.columns and c not in keys}
    comparable = [c for c in rules if not isinstance(indicators.schema[c].dataType, T.MapType)]
    merged = merge(indicators, rows, keys, rules, compare=comparable)
    return stamp(merged, as_of, created=["collected_at"], seen=["last_seen_at"])


def upsert_attack_objects(objects: DataFrame, batch: DataFrame) -> DataFrame:
    """Knowledge-base objects are replaced when their own date moved; tactics always."""
    renew = ~F.col("o.modified").eqNullSafe(F.col("n.modified")) | (F.col("n.obj_type") == "tactic")
    rules: dict[str, Rule] = {
        c: (lambda old, new: F.when(renew, new).otherwise(old)) for c in objects.columns if c != "stix_id"}
    return merge(objects, batch, ["stix_id"], rules, compare=["modified"])


def upsert_rules(rules_table: DataFrame, batch: DataFrame, as_of: datetime, known_release: str | None = None) -> DataFrame:
    """Rules by id, every field replaced; a release already taken in changes nothing."""
    keys = ["source_key", "external_id"]
    rows = first_wins(batch.filter(~F.col("release").eqNullSafe(F.lit(known_release))), keys, [F.col("file")])
    rules: dict[str, Rule] = {c: overwrite for c in rules_table.columns if c in rows.columns and c not in keys}
    comparable = [c for c in rules if not isinstance(rules_table.schema[c].dataType, T.MapType)]
    merged = merge(rules_table, rows, keys, rules, compare=comparable)
    return stamp(merged, as_of, created=["collected_at"])


def put_payloads(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """Latest answer per record, including 'not found' answers."""
    both = cache.unionByName(fetched)
    return both.groupBy("cve_id").agg(
        F.max_by(F.struct("payload", "found"), "fetched_at").alias("_last"), F.max("fetched_at").alias("fetched_at")
    ).select("cve_id", "_last.payload", "_last.found", "fetched_at")


def fresh_payloads(cache: DataFrame, as_of: datetime, max_age_days: int) -> DataFrame:
    """Answers young enough to be used instead of asking again."""
    limit = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(max_age_days))
    return cache.filter(F.col("fetched_at") > limit)
