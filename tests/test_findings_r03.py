"""What the third round of findings asked for."""

import itertools
import json
from types import SimpleNamespace

from pyspark.sql import functions as F

from vigil.functions.version import compare_keys, compare_versions, parts, version_key
from vigil.operators import match
from vigil.plans import catalog, export
from vigil.sources import rules

PRODUCT = "cve_id string, vendor string, product string, cpe string, versions string"
ASSET = "owner_id string, environment_id string, asset_id string, vendor string, product string, version string"
VULN = "cve_id string, vendor string, product string, in_kev boolean"


def test_version_keys_compare_as_versions(spark, table):
    seen = ["1.0.0", "01.2", "1.10", "10", "0.0", "100000000", "1.100000000", "2.3_0", "1.x", " 1.2 ", "", None]
    rows = table(list(itertools.product(seen, seen)), "a string, b string").localCheckpoint().withColumns(
        {"ka": version_key(parts(F.col("a"))), "kb": version_key(parts(F.col("b")))})
    both = rows.select("a", "b", compare_versions(F.col("a"), F.col("b")).alias("was"), compare_keys(F.col("a"), F.col("b"), F.col("ka"), F.col("kb")).alias("now"))
    assert both.filter(~F.col("was").eqNullSafe(F.col("now"))).collect() == []


def inventory(table):
    assets = table([("o", "e", f"a{i}", ["Acme", "n/a", "Other"][i % 3], "Box", f"{i % 4}.0" if i % 5 else None) for i in range(30)], ASSET).localCheckpoint()
    products = table([(f"CVE-{i}", ["acme", "n/a"][i % 2], "box", "", f">= {i % 3}.0 < {i % 3 + 2}.0") for i in range(20)] + [
        ("CVE-3", "n/a", "box", "", f"< 0.{i}") for i in range(5)], PRODUCT).localCheckpoint()
    vulns = table([(f"CVE-{i}", "acme", "box", i > 17) for i in range(25)], VULN).localCheckpoint()
    return assets, products, vulns


def test_cells_give_the_same_pairs(spark, table):
    assets, products, _ = inventory(table)
    whole, cut = match._met(assets, products).select("asset_id", "cve_id", "versions"), match._met(assets, products, cell_rows=2)
    place = ["_assets_cell", "_rows_cell"]
    assert sorted(cut.select(whole.columns).collect()) == sorted(whole.collect())
    assert cut.select(*place).distinct().count() > 8
    assert cut.groupBy(*place).agg(F.countDistinct("asset_id").alias("n")).agg(F.max("n")).first()[0] < 12


def test_pairs_are_dealt_and_catalogue_pairs_stay(spark, table):
    assets, products, vulns = inventory(table)
    assert match._met(assets.coalesce(1), products.coalesce(1))._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    found = {(r["asset_id"], r["cve_id"]): r for r in match.match_inventory(assets, products, vulns).collect()}
    assert {r["method"] for (_, c), r in found.items() if c in ("CVE-20", "CVE-24")} == {"kev_fallback"}
    # the two catalogue entries with product rows: only where no row names the asset
    assert {k for k, r in found.items() if r["method"] == "kev_fallback" and k[1] == "CVE-19"} == set()
    out = [r["evidence"] for (_, c), r in found.items() if c == "CVE-3" and r["state"] == "not_affected"]
    assert out and all(e.count(";") == 2 for e in out)


def test_rules_are_parsed_once_over_all_partitions(spark, table):
    files = table([(f"rules/{i}.yml", f"id: r{i}\ntitle: t\n" if i % 3 else "- a\n") for i in range(60)], "file string, text string").localCheckpoint().coalesce(1)
    kept = []
    parsed = rules.parse_rules(files, "r1", keep=lambda rows: kept.append(rows) or rows)
    assert len(kept) == 1 and kept[0].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert (parsed.good.count(), parsed.rejects.count()) == (40, 20)


def test_all_maintenance_keys_are_recomputed(spark, table, monkeypatch):
    scored = table([(f"CVE-{i}", 50 + i, 1, None) for i in range(20)], "cve_id string, relevance_score int, source_count int, last_activity_at timestamp").localCheckpoint()

    class Tables(dict):
        def corpus(self, derived):
            return None

    monkeypatch.setattr(catalog.recompute, "recompute", lambda c, at, only: scored.join(only, "cve_id", "left_semi").withColumn("source_count", F.lit(7)))
    got = {r["cve_id"]: r["source_count"] for r in catalog.recompute_touched(Tables(scored=scored)).collect()}
    assert got == {f"CVE-{i}": 7 if i >= 10 else 1 for i in range(20)}


def test_only_cves_of_several_documents_are_numbered_over_ranges(spark, table, monkeypatch):
    facts = table([("A", "news", None, f"t{i}") for i in range(3)] + [("B", ["news", "pocs"][i % 2], f"2001-01-0{i + 1} 00:00:00", "t") for i in range(7)] + [
        (None, "news", None, "t")], "cve_id string, section string, at string, title string").localCheckpoint()
    none = F.lit(None).cast("string")
    facts = facts.withColumn("at", F.col("at").cast("timestamp")).select("*", *[none.alias(c) for c in ("kind", "source", "url", "detail")], F.lit(1).alias("tier"))
    columns = {column for fields in (export.OVERVIEW, *export.GROUPS.values()) for column in fields.values()}
    vulns = table([("A", "title of A")], "cve_id string, title string").select("cve_id", "title", *[none.alias(c) for c in sorted(columns - {"title"})])
    monkeypatch.setattr(export.profile, "profile", lambda c: facts)
    kept = []
    docs = export.cve_json(SimpleNamespace(vulnerability=vulns), lambda rows: kept.append(rows) or rows.localCheckpoint(), part_facts=5)
    found = {(r["cve_id"], r["part"]): (r["parts"], json.loads(r["json"])) for r in docs.collect()}
    assert {k: v[0] for k, v in found.items()} == {("A", 1): 1, ("B", 1): 2, ("B", 2): 2}
    assert found["A", 1][1]["tracked"] and found["A", 1][1]["overview"]["title"] == "title of A" and not found["B", 1][1]["tracked"]
    assert [x["title"] for x in found["A", 1][1]["sections"]["news"]] == ["t0", "t1", "t2"]
    numbers = {s: [x["number"] for part in (1, 2) for x in found["B", part][1]["sections"].get(s, [])] for s in ("news", "pocs")}
    assert numbers == {"news": [1, 2, 3, 4], "pocs": [5, 6, 7]}
    assert len(kept) == 2 and {r[0] for r in kept[1].select("cve_id").distinct().collect()} == {"B"}


def test_pairs_that_meet_once_are_settled_alike(spark, table):
    assets, products, vulns = inventory(table)
    assets = assets.unionByName(assets.filter("asset_id = 'a3'").withColumn("version", F.lit("0.5"))).localCheckpoint()  # a key of two rows
    key = ["asset_id", "cve_id"]
    met = match._met(assets, products, counted=True)
    alone = met.filter("_single_asset and _single_row")
    columns = [*key, "state", "method", "confidence", "evidence"]
    whole = {tuple(r[:2]): tuple(r) for r in match.match_products(assets, products).select(columns).collect()}
    once = [tuple(r) for r in match._settled_alone(match._verdicts(alone)).select(columns).collect()]
    assert len(once) > 100 and all(whole[r[:2]] == r for r in once) and len({r[:2] for r in once}) == len(once)
    assert {r[0] for r in once}.isdisjoint({"a3"}) and {r[1] for r in once}.isdisjoint({"CVE-3"})
    every = [tuple(r) for r in match.match_inventory(assets, products, vulns).filter("method != 'kev_fallback'").select(columns).collect()]
    assert sorted(every) == sorted(whole.values())
    states = match.match_inventory(assets, products, vulns).filter(F.col("state") == "affected")
    plan = states._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join Inner" in line and "no_version" in line]


def test_a_change_of_assets_asks_for_no_stored_matches(spark, table):
    assets, products, vulns = inventory(table)
    columns = {"label": "l", "category": "application", "cpe": None, "catalogued": "true", "hardware_model": None, "notes": None}
    fleet = assets.withColumn("asset_id", F.concat(F.lit("part-"), F.substring("asset_id", 2, 9))).withColumns({k: F.lit(v) for k, v in columns.items()})

    class Tables(dict):
        def plan(self, name):
            return match.match_inventory(self["fleet"], self["product"], self["vulnerability"])

    tables = Tables(fleet=fleet, product=products, vulnerability=vulns)
    assert catalog.asset_put_delete(tables).count() == 30  # one goes, one is put by a second owner
    assert catalog.match_list(tables).filter("owner_id = 'branch-o'").count() > 0


def test_a_large_dictionary_starts_at_its_first_words(spark, table):
    from vigil.operators import names

    terms = table([(f"actor {i}", f"Actor {i}", False, f"a{i}", "group", f"Actor {i}") for i in range(9)],
                  "low string, term string, exact boolean, stix_id string, obj_type string, name string").localCheckpoint()
    docs = table([("u", "Here actor 3 meets Actor 77 and ACTOR 8."), ("v", "nobody"), ("w", None)], "url string, text string").localCheckpoint()
    large = names._terms(terms, 5)
    assert large.folded is None and large.first_words == ["actor"]
    found = {r["url"]: sorted(r["hits"] or []) for r in names.find_names(docs, ["url"], "text", terms, inline_limit=5).collect()}
    assert found == {"u": ["ACTOR 8", "actor 3"], "v": [], "w": []}
