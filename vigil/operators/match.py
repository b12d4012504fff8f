"""Does a CVE touch an inventory item, and how do we know (M1-M4).

Doubt resolves downwards: 'affected' needs a version that was read and compared against a bound that
was read too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import vocab
from vigil.functions.text import fold_name
from vigil.functions.version import compare_keys, cpe_version, inside, parse_range, parts, version_key

PAIR = ["owner_id", "environment_id", "asset_id", "cve_id"]
_ANY_VENDOR = ["", "n/a"]
_MEETING = ["product_key", "vendor_key"]
CELL_ROWS = 1_000


def _asset_side(assets: DataFrame) -> DataFrame:
    vendor = fold_name(F.col("vendor"))
    named = ~vendor.isin(_ANY_VENDOR)
    # A named vendor meets rows of that vendor and rows without one; an unnamed one meets everything.
    keys = F.array(F.when(named, F.concat(F.lit("v:"), vendor)).otherwise("named"), F.lit("unnamed"))
    return assets.select(
        "owner_id", "environment_id", "asset_id", fold_name(F.col("product")).alias("product_key"),
        keys.alias("vendor_keys"), F.trim(F.concat_ws(" ", "vendor", "product")).alias("label"),
        F.col("version").alias("asset_version"), version_key(parts(F.col("version"))).alias("asset_sort"),
    ).filter(F.col("product_key") != "").withColumn("vendor_key", F.explode_outer("vendor_keys")).drop("vendor_keys")


def folded(rows: DataFrame) -> DataFrame:
    """``rows`` with the spellings that products meet by. Stored so, they are folded once, however often they are read."""
    return rows.withColumns({"vendor_folded": fold_name(F.col("vendor")), "product_key": fold_name(F.col("product"))})


def meetable(products: DataFrame, assets: DataFrame, vulns: DataFrame) -> DataFrame:
    """Folded product rows of known CVEs whose product some asset has: all that ``assets`` can match, for matching that reads them often."""
    rows = products if {"vendor_folded", "product_key"} <= set(products.columns) else folded(products)
    had = assets.select(fold_name(F.col("product")).alias("product_key")).distinct()
    return rows.join(had, "product_key", "left_semi").join(vulns.select("cve_id"), "cve_id", "left_semi")


def _product_side(rows: DataFrame) -> DataFrame:
    """``rows`` with folded keys. Each pair of an asset and a row shares at most one key."""
    rows = rows if {"vendor_folded", "product_key"} <= set(rows.columns) else folded(rows)
    keys = F.when(F.col("vendor_folded").isin(_ANY_VENDOR), F.array(F.lit("unnamed"))).otherwise(
        F.array(F.concat(F.lit("v:"), "vendor_folded"), F.lit("named")))
    return rows.filter(F.col("product_key") != "").withColumn("vendor_key", F.explode_outer(keys)).drop("vendor_folded")


def same_product(assets: DataFrame, products: DataFrame) -> DataFrame:
    """Candidate rows: equal folded product, and equal vendor unless one side names none (M1).

    A plain equi join on both keys, so rows that only share a popular product name never meet.
    """
    return _asset_side(assets).join(_product_side(products), ["product_key", "vendor_key"])


def _comparable(rows: DataFrame) -> DataFrame:
    """Product rows with their pinned version or bounds read into comparable parts."""
    pinned = F.when(F.coalesce("cpe", F.lit("")) != "", cpe_version(F.col("cpe")))
    return rows.withColumn("pinned", pinned).withColumn(
        "rng", F.when(F.col("pinned").isNull(), parse_range(F.col("versions")))).withColumns({
            "pinned_sort": version_key(parts(F.col("pinned"))), "lower_sort": version_key(parts(F.col("rng.lower.version"))),
            "upper_sort": version_key(parts(F.col("rng.upper.version")))})


@dataclass(frozen=True)
class Side:
    """Assets that are to meet the product rows and the listed vulnerabilities beside them."""
    assets: DataFrame
    products: DataFrame
    vulns: DataFrame


def _all_rows(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def _counted(inventory: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_single``: is the asset's key one row, and does the CVE name the product in one row.

    An asset has one product, so a pair of single sides meets once, whatever its vendor keys.
    """
    known = named.join(inventory.select("product_key").distinct(), "product_key", "left_semi")
    assets, rows = Window.partitionBy(*PAIR[:3]), Window.partitionBy("cve_id", "product_key")
    # an asset stands under two vendor keys, a product row under just one of these two
    return (inventory.withColumn("_single_asset", F.count(F.lit(1)).over(assets) == 2),
            known.withColumn("_single_row", F.count_if(F.col("vendor_key").isin("named", "unnamed")).over(rows) == 1))


def _met(assets: DataFrame, products: DataFrame, cell_rows: int = CELL_ROWS, counted: bool = False) -> DataFrame:
    """Assets beside candidate product rows. Product rows no asset could meet are dropped first; the versions and bounds
    of the others are read once per row, however many assets they meet.

    What meets is cut into cells of about ``cell_rows`` rows a side, dealt over all partitions: pairs are far more than
    rows, so neither a popular product nor a table in one file leaves them to one task.
    """
    inventory, named = _asset_side(assets), _product_side(products)
    if counted:
        inventory, named = _counted(inventory, named)
    if assets.isStreaming or products.isStreaming:  # a stream is not counted: a batch of it meets the rows as it comes
        wanted = named if assets.isStreaming else named.join(inventory.select(*_MEETING), _MEETING, "left_semi")
        return inventory.join(_comparable(wanted), _MEETING)
    placed, listed, at = _dealt(inventory, named, cell_rows)
    return placed.join(listed, at)


def _dealt(inventory: DataFrame, named: DataFrame, cell_rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides in their cells, and the columns by which they meet."""
    sides = {"_assets": inventory, "_rows": named}
    counts = {side: rows.groupBy(*_MEETING).agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias(side)) for side, rows in sides.items()}
    cells = counts["_assets"].join(counts["_rows"], _MEETING)

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """A row goes to one cut of its side and to every cut of the other side."""
        placed = rows.join(cells, _MEETING).withColumn(f"{own}_cell", F.pmod(F.xxhash64(*hashed[own]), F.col(own)).cast("int"))
        return placed.withColumn(f"{other}_cell", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_assets", "_rows")

    hashed = {"_assets": [c for c in PAIR[:3] if c in inventory.columns] or ["asset_version"], "_rows": ["cve_id"]}
    at = [*_MEETING, "_assets_cell", "_rows_cell"]
    return dealt(inventory, "_assets", "_rows"), _comparable(dealt(named, "_rows", "_assets")).repartition(_wide(named), *at), at


def _wide(rows: DataFrame) -> int:
    """A number of partitions that is given is not made smaller by size."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def candidate_verdicts(assets: DataFrame, products: DataFrame) -> DataFrame:
    """One row per asset and candidate product row with its own verdict."""
    return _verdicts(_met(assets, products))


def _judged(rows: DataFrame) -> DataFrame:
    """``rows`` with their verdict, what follows the label where it hits (``hit_rest``) and what is told where it does not (``out_text``)."""
    # One step a projection, so that each stays a small compiled method: these run once per pair.
    version, has_cpe = F.col("asset_version"), F.coalesce("cpe", F.lit("")) != ""
    pinned = F.col("pinned").isNotNull()
    rows = rows.withColumns({
        "_pin": compare_keys(version, F.col("pinned"), F.col("asset_sort"), F.col("pinned_sort")),
        "_low": compare_keys(version, F.col("rng.lower.version"), F.col("asset_sort"), F.col("lower_sort")),
        "_up": compare_keys(version, F.col("rng.upper.version"), F.col("asset_sort"), F.col("upper_sort"))})
    rows = rows.withColumn("_inside", inside(version, F.col("rng"), F.col("_low"), F.col("_up")))
    cmp, within = F.col("_pin"), F.col("_inside")
    verdict = (
        F.when(F.coalesce(version, F.lit("")) == "", "no_version")
        .when(pinned, F.when(cmp == 0, "exact").when(cmp.isNull(), "undecided").otherwise("out"))
        .otherwise(F.when(within == "in", "range").when(within == "out", "out").otherwise("undecided")))
    rows = rows.withColumn("verdict", verdict)
    out_text = F.when(pinned, F.concat("cpe", F.lit(" names "), "pinned")).otherwise(F.col("rng.label"))
    hit_rest = F.when(pinned, F.concat_ws("", F.lit(" "), "asset_version", F.lit(" is the exact version named by "), "cpe", F.lit("."))).otherwise(
        F.concat_ws("", F.lit(" "), "asset_version", F.lit(" falls inside the affected range "), "rng.label",
                    F.when(has_cpe, F.concat(F.lit(" ("), "cpe", F.lit(")."))).otherwise(F.lit("."))))
    return rows.withColumns({"hit_rest": hit_rest, "out_text": out_text})


def _verdicts(rows: DataFrame) -> DataFrame:
    return _judged(rows).select(
        *PAIR, "label", "asset_version", "verdict",
        F.struct(F.coalesce("vendor", F.lit("")).alias("vendor"), F.coalesce("product", F.lit("")).alias("product"),
                 F.coalesce("cpe", F.lit("")).alias("cpe"), F.coalesce("versions", F.lit("")).alias("versions")
                 ).alias("place"),
        F.concat_ws("", "label", "hit_rest").alias("hit_text"), "out_text")


def match_products(assets: DataFrame, products: DataFrame) -> DataFrame:
    """Verdict of each (asset, CVE) that shares a product row (M2)."""
    return _settled(candidate_verdicts(assets, products))


def _texts(verdicts: DataFrame) -> DataFrame:
    """A row carries the one text that it may need."""
    hit, out = F.col("verdict").isin("exact", "range"), F.col("verdict") == "out"
    text = F.when(hit, F.col("hit_text")).when(out, F.col("out_text"))
    return verdicts.select(*PAIR, "label", "asset_version", "verdict", "place", text.alias("text"))


def _settled(verdicts: DataFrame) -> DataFrame:
    hit, out = F.col("verdict").isin("exact", "range"), F.col("verdict") == "out"
    # Rows are dealt by pair once; the window and the sums below both stand on that.
    verdicts = _texts(verdicts).repartition(*PAIR)
    # Only the first three ruled-out rows of a pair are told. Of other verdicts the first row is enough.
    first = Window.partitionBy(*PAIR, "verdict").orderBy("place", "text")
    told = verdicts.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= 3)
    # an asset key that repeats may stand with several versions: ties go to the least, however the rows were dealt
    rows = told.groupBy(*PAIR).agg(
        F.min(F.struct("verdict", "place", "text", "label", "asset_version")).alias("_first"),
        F.min(F.when(hit, F.struct("place", "verdict", "text"))).alias("hit"),
        F.max(F.col("verdict") == "undecided").alias("undecided"),
        F.max(F.col("verdict") == "no_version").alias("no_version"),
        F.max(out).alias("_out"), *[F.max(F.when(out & (F.col("_n") == i), F.col("text"))).alias(f"_out{i}") for i in (1, 2, 3)]
    ).withColumn("ruled_out", F.when(F.col("_out"), F.concat_ws("; ", "_out1", "_out2", "_out3")))
    return _told(rows.withColumns({"label": F.col("_first.label"), "asset_version": F.col("_first.asset_version"), "hit_verdict": F.col("hit.verdict"), "hit_text": F.col("hit.text")}))


def _settled_alone(verdicts: DataFrame) -> DataFrame:
    """The same for pairs that met once: the one verdict stands, nothing moves."""
    return _told(_stands(_apart(_texts(verdicts))))


def _apart(verdicts: DataFrame) -> DataFrame:
    """Behind a generator: a filter on the state must not become a join condition that reads every version again."""
    return verdicts.withColumn("verdict", F.explode(F.array("verdict")))


def _stands(verdicts: DataFrame) -> DataFrame:
    verdict, hit = F.col("verdict"), F.col("verdict").isin("exact", "range")
    return verdicts.withColumns({
        "hit_verdict": F.when(hit, verdict), "hit_text": F.when(hit, F.col("text")), "undecided": verdict == "undecided",
        "no_version": verdict == "no_version", "ruled_out": F.when(verdict == "out", F.concat_ws("; ", "text"))})


def _settled_by_version(inventory: DataFrame, named: DataFrame, each: bool, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``_settled_alone`` of single sides. A verdict hangs on the version and the row alone: it is made once for all assets of a
    version in a cell, and told to each of them behind that. Without ``each``, cve_id and the states it has, by version."""
    if not each:
        inventory = inventory.select(*_MEETING, "asset_version").distinct()
    placed, listed, at = _dealt(inventory, named, cell_rows)
    if each:
        placed = placed.repartition(_wide(named), *at).groupBy(*at, "asset_version").agg(F.collect_list(F.struct(*PAIR[:3], "label")).alias("_held"))
    met = placed.withColumn("asset_sort", version_key(parts(F.col("asset_version")))).join(listed, at)
    hit, out = F.col("verdict").isin("exact", "range"), F.col("verdict") == "out"
    said = F.when(hit, F.col("hit_rest")).when(out, F.col("out_text"))
    judged = _apart(_judged(met).select("cve_id", "asset_version", "verdict", said.alias("said"), *(["_held"] if each else [])))
    if not each:
        none = {c: F.lit(None).cast("string") for c in [*PAIR[:3], "label"]}
        return _told(_stands(judged.withColumns({**none, "text": F.lit("")})))
    told = judged.select("cve_id", "asset_version", "verdict", "said", F.inline("_held"))
    return _told(_stands(told.withColumn("text", F.when(hit, F.concat_ws("", "label", "said")).otherwise(F.col("said")))))


def _told(rows: DataFrame) -> DataFrame:
    """State, method, confidence and evidence of settled pairs, each a column of its own: what nobody reads is not made."""
    label, version = F.col("label"), F.col("asset_version")
    listed = F.concat(label, F.lit(" is listed as affected, but "))
    unknown, hit = F.col("no_version"), F.col("hit_verdict").isNotNull()
    undecided = F.col("undecided") | F.col("ruled_out").isNull()

    def by_case(none: Column | str, found: Column | str, unsure: Column | str, outside: Column | str) -> Column:
        none, found, unsure, outside = [x if isinstance(x, Column) else F.lit(x) for x in (none, found, unsure, outside)]
        return F.when(unknown, none).when(hit, found).when(undecided, unsure).otherwise(outside)

    return rows.select(
        *PAIR,
        by_case("possibly_affected", "affected", "possibly_affected", "not_affected").alias("state"),
        by_case("vendor_product", F.when(F.col("hit_verdict") == "exact", "cpe_exact").otherwise("cpe_version_range"),
                "vendor_product", "cpe_version_range").alias("method"),
        by_case("medium", "high", "medium", "medium").alias("confidence"),
        by_case(F.concat(listed, F.lit("no version is recorded for this asset.")), F.col("hit_text"),
                F.concat(listed, F.lit("version "), version, F.lit(" could not be compared against the published range.")),
                F.concat(label, F.lit(" "), version, F.lit(" is outside every affected range ("), "ruled_out", F.lit(")."))
                ).alias("evidence"))


def match_catalogue(sides: list[tuple[DataFrame, DataFrame, DataFrame]], matched: DataFrame) -> DataFrame:
    """Known-exploited entries that name the product while no product row of the CVE does; sides as inventory, product rows that it
    could meet, vulnerabilities."""
    pairs, free = [], []
    for inventory, named, vulns in sides:
        entries = _product_side(vulns.filter("in_kev").select("cve_id", "vendor", "product"))
        # a CVE without a product row of any asset's product has no matched pair to look for
        contested = named.select("cve_id").distinct()
        for kept, how in ((pairs, "left_semi"), (free, "left_anti")):
            kept.append(inventory.join(entries.join(contested, "cve_id", how), _MEETING).select(*PAIR, "label"))
    left = _all_rows([_all_rows(pairs).join(matched.select(*PAIR), PAIR, "left_anti"), *free])
    evidence = F.concat("label", F.lit(" is named in the CISA KEV entry, which carries no machine-readable affected versions."))
    return left.select(*PAIR, F.lit("possibly_affected").alias("state"), F.lit("kev_fallback").alias("method"),
                       F.lit("low").alias("confidence"), evidence.alias("evidence"))


def exposure(state: Column) -> Column:
    points = F.lit(0)
    for name, value in vocab.EXPOSURE.items():
        points = F.when(state == name, F.lit(value)).otherwise(points)
    return points


def _matched(sides: list[Side], each: bool = True) -> DataFrame:
    """Matches of all sides, whose pairs of assets and CVEs differ, in one pass of verdicts. Only CVEs with a vulnerability row count."""
    # pairs that meet in one row are settled where they meet; the others are dealt by pair
    alone, several, listed, prepared = [], [], [], []
    for x in sides:
        rows = x.products.join(x.vulns.select("cve_id"), "cve_id", "left_semi")
        inventory, named = _counted(_asset_side(x.assets), _product_side(rows))
        prepared.append((inventory, named, x.vulns))
        asset, row = inventory.filter("_single_asset"), named.filter("_single_row")
        alone.append(_settled_by_version(asset, row, each))
        # an entry of the catalogue is spared by product rows of its own CVE alone, so pairs of the other CVEs need not meet again
        entered = named.join(x.vulns.filter("in_kev").select("cve_id"), "cve_id", "left_semi")
        for kept, one, other in ((several, inventory.filter("NOT _single_asset"), named), (several, asset, named.filter("NOT _single_row")), (listed, inventory, entered)):
            placed, beside, at = _dealt(one, other, CELL_ROWS)
            kept.append(placed.join(beside, at))
    dealt = _settled(_verdicts(_all_rows(several)))
    return _all_rows([*alone, dealt, match_catalogue(prepared, _all_rows(listed))]).withColumn("exposure", exposure(F.col("state")))


def match_inventory(assets: DataFrame, products: DataFrame, vulns: DataFrame) -> DataFrame:
    """All matches of an inventory, with exposure points (M2-M4)."""
    return _matched([Side(assets, products, vulns)])


def cve_states(assets: DataFrame, products: DataFrame, vulns: DataFrame) -> DataFrame:
    """cve_id, state, exposure: each state that a CVE has for some asset of the inventory, once.

    That is what figures by CVE read of ``match_inventory``, with all its rules. Assets of one vendor, product and version have
    one verdict on any CVE, so the first of them stands for all; an asset whose key repeats is settled over all its rows.
    """
    repeats = F.count(F.lit(1)).over(Window.partitionBy(*PAIR[:3])) > 1
    marked = assets.withColumns({"_repeats": repeats, "_vendor": fold_name(F.col("vendor")), "_product": fold_name(F.col("product"))})
    stands = marked.filter("NOT _repeats").dropDuplicates(["_vendor", "_product", "version"]).unionByName(marked.filter("_repeats"))
    return _matched([Side(stands.drop("_repeats", "_vendor", "_product"), products, vulns)], each=False).select("cve_id", "state", "exposure").distinct()


def fresh_matches(assets: DataFrame, products: DataFrame, vulns: DataFrame,
                  changed_assets: DataFrame | None = None, changed_cves: DataFrame | None = None) -> DataFrame:
    """Matches of changed assets with everything and of the other assets with changed CVEs (M4).

    Changes are few beside the tables: product rows and vulnerabilities are cut down by them before names are folded
    and versions read, and both kinds of pairs go through one pass of verdicts.
    """
    owner, sides, rest = PAIR[:3], [], assets
    if changed_assets is not None:
        keys = changed_assets.select(*owner).distinct()
        sides.append(Side(assets.join(keys, owner, "left_semi"), products, vulns))
        rest = assets.join(keys, owner, "left_anti")
    if changed_cves is not None:
        keys = changed_cves.select("cve_id").distinct()
        sides.append(Side(rest, products.join(keys, "cve_id", "left_semi"), vulns.join(keys, "cve_id", "left_semi")))
    return _matched(sides)


def rematch(matches: DataFrame, assets: DataFrame, products: DataFrame, vulns: DataFrame,
            changed_assets: DataFrame | None = None, changed_cves: DataFrame | None = None) -> DataFrame:
    """Matches with the rows of changed assets and changed CVEs computed again (M4).

    ``changed_assets`` needs owner_id, environment_id and asset_id, ``changed_cves`` needs cve_id.
    """
    if changed_assets is None and changed_cves is None:
        return matches
    rows, owner = matches, PAIR[:3]
    if changed_assets is not None:
        rows = rows.join(changed_assets.select(*owner).distinct(), owner, "left_anti")
    if changed_cves is not None:
        rows = rows.join(changed_cves.select("cve_id").distinct(), "cve_id", "left_anti")
    return rows.unionByName(fresh_matches(assets, products, vulns, changed_assets, changed_cves), allowMissingColumns=True)
