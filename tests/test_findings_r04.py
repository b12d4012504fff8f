"""Findings of the fourth round."""

from pyspark.sql import functions as F

from vigil.plans import catalog


def test_the_periodic_recompute_covers_scores_from_thirty(spark, table, monkeypatch):
    """The registered query derives again what the original job does."""
    scored = table([(f"CVE-{i}", i, 1, None) for i in range(20, 70)], "cve_id string, relevance_score int, source_count int, last_activity_at timestamp").localCheckpoint()

    class Tables(dict):
        def corpus(self, derived):
            return None

    monkeypatch.setattr(catalog, "stage", lambda session, folder: Tables(scored=scored))
    monkeypatch.setattr(catalog.recompute, "recompute", lambda c, at, only: scored.join(only, "cve_id", "left_semi").withColumn("source_count", F.lit(7)))
    got = {r["cve_id"]: r["source_count"] for r in catalog.QUERIES["recompute_touched"](spark, "").collect()}
    assert got == {f"CVE-{i}": 7 if i >= 30 else 1 for i in range(20, 70)}


def test_the_summaries_of_the_derived_state_are_stored_apart(spark, table):
    """what one summary shuffled can go before the next one is made; the rows stay."""
    from datetime import datetime

    from test_findings_r03_scale import corpus
    from vigil import schemas
    from vigil.operators import recompute

    c = corpus(table)
    c.vulnerability = schemas.empty(spark, "vulnerability").unionByName(table([("CVE-1",), ("CVE-2",)], "cve_id string"), allowMissingColumns=True).localCheckpoint()
    kept = []
    rows = recompute.recompute(c, datetime(2001, 8, 2), keep=lambda x: kept.append(x.columns) or x.localCheckpoint())
    assert [("sources" in x, "actors" in x) for x in kept] == [(True, False), (False, True)]
    assert sorted(map(str, rows.collect())) == sorted(map(str, recompute.recompute(c, datetime(2001, 8, 2)).collect()))


def test_products_of_repeated_lines_and_suppliers_are_one_row(spark, tmp_path, table):
    """A part that a nation supplies by several suppliers and lines has one row of it."""
    from vigil.plans import corpus

    def put(name, rows, schema):
        table(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    put("part", [(1, "hot bolt", "Brand#1", "PROMO", 9), (None, "x", "y", "PROMO", 1)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int")
    put("lineitem", [(1, 5), (1, 5), (1, 6), (1, 7), (1, None), (None, 5), (1, 8)], "l_partkey bigint, l_suppkey bigint")
    put("supplier", [(5, 2), (5, 2), (6, 2), (7, 3), (8, 4), (None, 2)], "s_suppkey bigint, s_nationkey int")
    put("nation", [(2, "PERU"), (3, "CHAD"), (4, "PERU")], "n_nationkey int, n_name string")
    assert sorted(r["product"] for r in corpus.products(spark, str(tmp_path)).collect()) == ["hot bolt CHAD", "hot bolt PERU"]


def test_small_groups_are_numbered_where_they_lie(spark, table):
    """one evaluation of the rows; only large groups go over ranges, and no group's numbers differ."""
    from vigil.operators import ordering

    rows = table([(g, i * 7 % 50) for g, k in (("a", 40), ("b", 3), (None, 12)) for i in range(k)], "g string, v int").localCheckpoint()
    kept = []

    def keep(x):
        kept.append(x.localCheckpoint())
        return kept[-1]

    expected = sorted((g or "", v, n) for g, k in (("a", 40), ("b", 3), (None, 12)) for n, v in enumerate(sorted(i * 7 % 50 for i in range(k)), 1))
    for most, stored in ((1_000, 2), (10, 3), (0, 3)):
        kept.clear()
        got = ordering.numbered(rows, ["g"], [F.col("v")], keep, most)
        assert sorted((r["g"] or "", r["v"], r["number"]) for r in got.collect()) == expected and len(kept) == stored
        assert dict(got.dtypes)["number"] == "bigint"


def test_documents_of_a_cve_are_put_together_once(spark, table):
    """Pairs with documents and exploits are stored, not joined again for each section."""
    from vigil.operators.recompute import Corpus
    from vigil.plans import export, profile

    url = "url string, title string, summary string, doc_type string, source_key string, tier int, published_at timestamp, collected_at timestamp"
    edges = [("document", "d1", "cve", "CVE-1", r, "high", "krebs", "regex", "e") for r in ("mentions", "reports_exploitation")]
    edge = table(edges, "subject_type string, subject_id string, object_type string, object_id string, relation string, confidence string, source_key string, method string, evidence string")
    exploit = table([("exploitdb", "1", "x", "u", "exploit", 2, None, None)], "source_key string, external_id string, title string, url string, kind string, tier int, published_at timestamp, collected_at timestamp")
    c = Corpus(None, None, None, exploit, table([("d1", "t", "s", "news", "krebs", 2, None, None)], url), edge, None)
    told, plain = profile.cve_documents(c), profile.cve_documents(c, told=False)
    assert [r.asDict() for r in told.select(plain.columns).collect()] == [r.asDict() for r in plain.collect()] and "summary" not in plain.columns
    kept = []
    once = profile.paired(c, lambda x: kept.append(x) or x)
    assert profile.cve_documents(once) is kept[0] and profile.cve_exploits(once) is kept[1] and len(kept) == 2
    assert sorted(kept[0].columns) == sorted(x for x in told.columns if x != "summary") and profile.cve_documents(c) is not kept[0]


def test_one_owner_is_matched_and_derived_alone(spark, table):
    """neither the matches of other owners nor the state of CVEs that do not reach the owner are made; the rows are those of all."""
    from test_findings_r03_scale import corpus, many_hosts
    from vigil import schemas
    from vigil.operators import match, recompute
    from vigil.plans.stage import Stage

    assets, products, vulns = many_hosts(table, 12)
    assets = assets.unionByName(assets.withColumn("owner_id", F.lit("other"))).localCheckpoint()
    s = Stage(spark, "")
    s._done.update(asset=assets, product=products, vulnerability=vulns)
    every = match.match_inventory(assets, products, vulns)
    assert sorted(map(str, s.matches_of("o").collect())) == sorted(map(str, every.filter("owner_id = 'o'").collect())) and "match" not in s._done
    s._done["match"] = every.limit(0)
    assert s.matches_of("o").count() == 0  # the stored ones, where there are any

    c = corpus(table)
    vulns = schemas.empty(spark, "vulnerability").unionByName(table([("CVE-1",), ("CVE-2",)], "cve_id string"), allowMissingColumns=True).localCheckpoint()
    s._done.update(vulnerability=vulns, product=c.affected_product, reference=c.source_reference, exploit=c.exploit, document=c.document, edge=c.edge, attack_object=c.attack_object)
    c.vulnerability = vulns
    cves = table([("CVE-1",), ("CVE-1",), ("CVE-9",)], "cve_id string")
    derived = recompute.recompute(c, catalog.AS_OF).filter("cve_id = 'CVE-1'")
    assert sorted(map(str, s.scored_of(cves).collect())) == sorted(map(str, derived.collect())) and "scored" not in s._done
