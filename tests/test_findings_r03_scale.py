"""Findings of the third round on time, shuffles and writes of the derived tables."""

from datetime import datetime
from types import SimpleNamespace

from pyspark.sql import functions as F

from vigil import schemas
from vigil.operators import match, recompute

EDGE = "subject_type string, subject_id string, object_type string, object_id string, relation string, confidence string, source_key string, evidence string"


def corpus(table, reports: int = 40):
    edges = [("document", f"d{i}", "cve", "CVE-1", "mentions", "high", "krebs", None) for i in range(reports)]
    edges += [("document", f"d{i}", "attack", f"a{i % 7}", "mentions", "medium", "krebs", None) for i in range(reports)]
    edges += [("document", f"d{i}", "attack", "t1", "mentions", "high", "krebs", None) for i in range(reports)]
    edges += [("exploit", "exploitdb:1", "cve", "CVE-1", "targets", "high", "exploitdb", None)] * 3
    objects = [(f"a{i}", "group", f"G{i}", f"Actor {i}") for i in range(7)] + [("t1", "technique", "T1001", "Way"), ("m", "malware", "S1", "M")]
    return SimpleNamespace(
        edge=table(edges, EDGE), attack_object=table(objects, "stix_id string, obj_type string, external_id string, name string"),
        document=table([(f"d{i}", "krebs", "t", "ransomware" if i == 3 else "", f"2001-01-{i % 28 + 1:02}") for i in range(reports)],
                       "url string, source_key string, title string, summary string, at string").withColumn("published_at", F.col("at").cast("timestamp")),
        exploit=table([("exploitdb", "1", "exploit", None)], "source_key string, external_id string, kind string, published_at timestamp"),
        source_reference=table([("CVE-1", "nvd")] * 9, "cve_id string, source_key string"), affected_product=table([("CVE-1",)] * 12, "cve_id string"))


def test_signals_that_say_the_same_are_one_row(spark, table):
    c = corpus(table)
    rows = recompute.signals(c)
    assert rows.count() == 4  # reports, code, references and products
    found = recompute.summarise(rows).first().asDict()
    assert sorted(found["sources"]) == ["exploitdb", "krebs", "nvd"] and found["ransomware"]
    assert (found["exploit_count"], found["poc_count"], found["product_count"]) == (3, 0, 12)
    beside = recompute.named_beside(c.edge, c.attack_object)
    assert beside.count() == 8  # seven actors and a technique, however many reports
    both = recompute.summarise_beside(beside).first()
    assert sorted(both["actors"]) == [f"Actor {i}" for i in range(5)] and both["explicit"] == ["T1001"]


def test_products_are_folded_once(spark, table):
    rows = table([("CVE-1", "Acme", "Big_Box", "", "< 2"), ("CVE-2", None, " big  box", "", None)], "cve_id string, vendor string, product string, cpe string, versions string")
    stored = match.folded(rows).localCheckpoint()
    plan = match._product_side(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in plan
    keys = lambda x: sorted(map(tuple, match._product_side(x).select("cve_id", "product_key", "vendor_key").collect()))
    assert keys(stored) == keys(rows) and ("CVE-2", "big box", "unnamed") in keys(rows)


def test_what_a_reader_does_not_need_is_not_made(spark, table):
    vulns = schemas.empty(spark, "vulnerability").unionByName(table([("CVE-1",)], "cve_id string"), allowMissingColumns=True).localCheckpoint()
    c = corpus(table)
    c.vulnerability = vulns
    rows = recompute.recompute(c, datetime(2001, 8, 2))
    assert rows.first()["source_count"] == 3
    plan = rows.groupBy("cvss_severity").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    exploited = rows.agg(F.count_if("actively_exploited"))._jdf.queryExecution().optimizedPlan().toString()
    assert exploited.count("Window") == 0 < exploited.count("Join")


def test_an_actor_without_a_name_takes_a_place(spark, table):
    c = corpus(table)
    objects = c.attack_object.withColumn("name", F.when(F.col("stix_id") != "a6", F.col("name")))
    assert sorted(recompute.summarise_beside(recompute.named_beside(c.edge, objects)).first()["actors"]) == [f"Actor {i}" for i in range(4)]


def many_hosts(table, hosts: int = 40):
    """Hosts that run two versions of one product, one without a version, one key of two versions; CVEs of one row and of several."""
    assets = [("o", "e", f"h{i}", ["Acme", "acme ", None][i % 3], "Box", [None, "1.5", "3.0", "x"][i % 4]) for i in range(hosts)] + [("o", "e", "twice", "Acme", "Box", v) for v in ("1.5", "3.0")]
    products = [("CVE-1", "Acme", "Box", "", ">= 1.0 < 2.0"), ("CVE-2", None, "box", "", ">= 2.0 < 4.0"), ("CVE-3", "Acme", "Box", "", "< 9.0"), ("CVE-3", None, "Box", "", "= 7"),
                ("CVE-4", "Acme", "Box", "", ">= 8.0 < 9.0"), ("CVE-5", "Acme", "Box", "cpe:2.3:a:acme:box:3.0:*:*:*:*:*:*:*", None), ("CVE-6", "Other", "Box", "", "< 9")]
    vulns = [(f"CVE-{i}", i in (4, 6, 7), "Acme", "Box") for i in range(1, 8)]
    return (table(assets, "owner_id string, environment_id string, asset_id string, vendor string, product string, version string").localCheckpoint(),
            table(products, "cve_id string, vendor string, product string, cpe string, versions string").localCheckpoint(),
            table(vulns, "cve_id string, in_kev boolean, vendor string, product string").localCheckpoint())


def test_states_by_cve_are_those_of_all_matches(spark, table):
    """what is read by CVE is settled once a version, not once a host."""
    assets, products, vulns = many_hosts(table)
    columns = ["cve_id", "state", "exposure"]
    every = match.match_inventory(assets, products, vulns).select(columns).distinct().collect()
    states = match.cve_states(assets, products, vulns)
    assert sorted(map(tuple, states.collect())) == sorted(map(tuple, every)) and len(every) > 10
    none = assets.filter("asset_id = 'nobody'")
    assert match.cve_states(none, products, vulns).count() == 0


def test_a_version_is_judged_once_for_all_its_assets(spark, table):
    """Rows judged by the matches of single sides are versions in a cell, and all pairs are told."""
    assets, products, vulns = many_hosts(table, 400)
    single = assets.filter("asset_id <> 'twice'")
    inventory, named = match._counted(match._asset_side(single), match._product_side(products))
    seen = []
    judged = match._judged
    match._judged = lambda rows: seen.append(rows) or judged(rows)
    try:
        found = match._settled_by_version(inventory, named.filter("_single_row"), each=True).collect()
    finally:
        match._judged = judged
    plain = {(r["asset_id"], r["cve_id"]): tuple(r) for r in match.match_products(single, products).filter("cve_id <> 'CVE-3'").select(found[0].__fields__).collect()}
    assert {(r["asset_id"], r["cve_id"]): tuple(r) for r in found} == plain and len(found) == len(plain) > 1000
    assert seen[0].count() <= 40
