"""The whole path on landed files, and the continuous jobs."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from test_sources import BUNDLE, NVD, RSS, SAMPLES, URLS
from vigil import schemas
from vigil.operators import merge
from vigil.plans import environment, export, ingest, profile, queries
from vigil.sources.indicators import parse_urls
from vigil.store import Store
from vigil.streaming import jobs

AS_OF = datetime(2024, 6, 1)


def land(folder, key, name, content):
    target = folder / key
    target.mkdir(parents=True, exist_ok=True)
    (target / name).write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    src = tmp_path_factory.mktemp("in")
    land(src, "mitre_attack", "b.json", {**BUNDLE, "objects": BUNDLE["objects"] + [
        {"type": "attack-pattern", "id": "ap-2", "name": "Exploit Public App", "external_references": [{"source_name": "mitre-attack", "external_id": "T1190"}]}]})
    land(src, "cisa_kev", "k.json", {"vulnerabilities": [{"cveID": "CVE-2024-0001", "vendorProject": "Acme", "product": "Gateway", "vulnerabilityName": "Acme Gateway RCE", "dateAdded": "2024-05-20",
                                                          "dueDate": "2024-06-10", "knownRansomwareCampaignUse": "Known", "notes": "", "cwes": []}, {"cveID": "bad"}]})
    land(src, "nvd", "n.json", NVD)
    land(src, "exploitdb", "e.csv", "id,file,description,date_published,author,type,platform,port,date_added,date_updated,verified,codes,tags\n"
         "1,f,Gate exploit,2024-05-25,joe,remote,linux,,2024-05-25,2024-05-25,1,CVE-2024-0001,\n")
    land(src, "krebs", "a.xml", RSS.replace("Full ", "Full actively exploited by Remcos "))
    land(src, "malwarebazaar", "s.csv", SAMPLES)
    land(src, "urlhaus", "u.csv", URLS)
    land(src, "github", "r.json", {"total_count": 0})
    return src


KEYS = ["mitre_attack", "cisa_kev", "nvd", "exploitdb", "krebs", "malwarebazaar", "urlhaus", "github"]


def test_end_to_end(spark, table, landed, tmp_path):
    out = str(tmp_path / "out")
    runs = {r.source_key: r for r in ingest.run_ingest(spark, str(landed), out, KEYS, AS_OF).collect()}
    assert {k: r.status for k, r in runs.items()} == {**{k: "success" for k in KEYS}, "github": "error"}
    assert (runs["cisa_kev"].items_new, runs["cisa_kev"].items_malformed) == (1, 1)
    assert (runs["nvd"].items_new, runs["nvd"].items_updated, runs["nvd"].items_malformed) == (0, 1, 1)
    assert (runs["malwarebazaar"].items_new, runs["urlhaus"].items_new) == (1, 3)
    store = Store(spark, out)
    store.write("asset", table([("a1", "o", "e", "edge box", "firewall", "acme inc", "gate way", "1.5", None, True, None, None),
                                ("a2", "o", "e", "other", "os", "x", "y", "1", None, True, None, None)], schemas.TABLES["asset"]))
    scored, matches = ingest.refresh_marts(spark, out, AS_OF)
    row = scored.filter("cve_id = 'CVE-2024-0001'").head()
    assert (row.in_kev, row.title, row.vendor, row.cvss_score, row.actively_exploited, row.has_exploit) == (True, "Acme Gateway RCE", "Acme", 10.0, True, True)
    assert row.tags == ["rce"] and {t["id"]: t["method"] for t in row.techniques} == {"T1190": "explicit"}
    assert row.source_count == 4 and row.relevance_score == 100
    evidence = next(r.detail for r in row.relevance_reasons if r.factor == "Active exploitation")
    assert evidence == "Exploitation reported by: CISA KEV, CISA SSVC (via NVD), Krebs on Security"
    assert [(m.asset_id, m.cve_id, m.state) for m in matches.collect()] == [("a1", "CVE-2024-0001", "affected")]
    assert store.read("indicator").filter("attack_stix_id = 'mw-1'").count() == 2

    # the same files again: nothing new, nothing updated, no edge twice
    edges = store.read("edge").count()
    again = {r.source_key: r for r in ingest.run_ingest(spark, str(landed), out, KEYS[:5], AS_OF).orderBy("started_at").collect()}
    assert all(again[k].status == "success" for k in KEYS[:5])
    assert store.read("edge").count() == edges
    assert store.read("vulnerability").count() == 1 and store.read("document").count() == 1

    from dataclasses import replace
    c = replace(ingest.corpus_of(store), vulnerability=scored)
    sections = {r.section: r["count"] for r in profile.profile(c).groupBy("section").count().collect()}
    assert sections["exploitation"] == 3 and sections["public_exploits"] == 1 and sections["malware"] == 1 and sections["attack"] == 1 and sections["news"] == 1
    lines = [r.line for r in export.markdown_lines(c, store.read("attack_relationship")).orderBy("cve_id", "section", "place").collect()]
    report = "\n".join(lines)
    heads = [l for l in lines if l.startswith("## ")]
    assert heads == ["## Overview", "## Impact & Risk", "## Affected Products", "## Exploitation", "## Public Exploits & PoCs", "## Threat Actors & Campaigns", "## MITRE ATT&CK",
                     "## Detection", "## Mitigation", "## Timeline", "## Sources"]
    assert lines[0] == "# CVE-2024-0001" and "- [exploit] [Gate exploit](https://www.exploit-db.com/exploits/1) (Exploit Database (OffSec))" in lines
    assert "**T1190 Exploit Public App**" in report and "Remcos (malware, ) — co-mentioned in" in report
    export.write_lines(export.markdown_lines(c, store.read("attack_relationship")), str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).filter("value LIKE '## %'").count() == 11

    rep = export.environment_report(matches, store.read("asset"), scored)
    cell = export.environment_csv(rep).head()
    assert (cell.state, cell.severity, cell.in_kev, cell.software) == ("affected", "CRITICAL", "yes", "acme inc gate way")
    md = [r.line for r in export.environment_markdown(rep, store.read("asset"), "My *env*").collect()]
    assert md[0] == r"# My \*env\*" and "## Affected (1)" in md and "### CVE-2024-0001 — Acme Gateway RCE" in md
    counts = {r.asset_id: (r.affected, r.total) for r in environment.counts_by_asset(store.read("asset"), matches).collect()}
    assert counts == {"a1": (1, 1), "a2": (0, 0)}
    assert queries.threats(scored, AS_OF, edge=store.read("edge"), objects=store.read("attack_object"), actor="Remcos").count() == 1
    fragments = profile.evidence_fragments(c).orderBy("number").collect()
    assert fragments[0].source == "NVD" and [f.number for f in fragments] == list(range(1, len(fragments) + 1))


def test_refresh_follows_the_change_feed(spark, table, landed, tmp_path):
    """After the first refresh only what the feed names is derived, and the tables are those of a full run."""
    out, more = str(tmp_path / "out"), tmp_path / "more"
    ingest.run_ingest(spark, str(landed), out, KEYS[:5], AS_OF)
    ingest.put_assets(spark, out, table([("a1", "o", "e", "edge box", "firewall", "acme inc", "gate way", "1.5", None, True, None, None)], schemas.TABLES["asset"]))
    ingest.refresh_marts(spark, out, AS_OF)
    store = Store(spark, out)
    first = store.version("scored")
    scored, _ = ingest.refresh_marts(spark, out, AS_OF)  # nothing new: nothing is written
    assert store.version("scored") == first and scored.count() == 1
    land(more, "cisa_kev", "k.json", {"vulnerabilities": [
        {"cveID": f"CVE-2024-1{i:03d}", "vendorProject": "Other", "product": f"Thing {i}", "vulnerabilityName": f"Thing {i} RCE", "dateAdded": "2024-05-30",
         "dueDate": "2024-06-10", "knownRansomwareCampaignUse": "Unknown", "notes": "", "cwes": []} for i in range(3)]})
    before = store.read("scored").collect()
    ingest.run_ingest(spark, str(more), out, ["cisa_kev"], AS_OF)
    cves, assets = ingest.changes_since(store, store.marks("scored")["change_feed"])
    assert sorted(r.cve_id for r in cves.collect()) == [f"CVE-2024-1{i:03d}" for i in range(3)] and assets.count() == 0
    ingest.put_assets(spark, out, table([("a2", "o", "e", "thing", "os", "other", "thing 1", "2", None, True, None, None)], schemas.TABLES["asset"]))
    scored, matches = ingest.refresh_marts(spark, out, AS_OF)
    got = (sorted(map(str, scored.collect())), sorted(map(str, matches.collect())))
    assert set(map(str, before)) < set(got[0]) and len(got[0]) == 4
    assert {(m.asset_id, m.cve_id) for m in matches.collect()} == {("a1", "CVE-2024-0001"), ("a2", "CVE-2024-1001")}
    scored, matches = ingest.refresh_marts(spark, out, AS_OF, full=True)
    assert got == (sorted(map(str, scored.collect())), sorted(map(str, matches.collect())))
    ingest.delete_assets(spark, out, table([("o", "e", "a1")], "owner_id string, environment_id string, asset_id string"))
    _, matches = ingest.refresh_marts(spark, out, AS_OF)
    assert [(m.asset_id, m.cve_id) for m in matches.collect()] == [("a2", "CVE-2024-1001")]
    ingest.vacuum(spark, out, keep=1)
    assert sorted(map(str, store.read("scored").collect())) == got[0]


def test_a_run_that_died_is_repaired(spark, landed, tmp_path, monkeypatch):
    """Parents come before children; the same files again add what is missing, and the feed was never behind."""
    out = str(tmp_path / "out")
    store = Store(spark, out)
    monkeypatch.setattr(ingest, "_add_edges", lambda *a: (_ for _ in ()).throw(OSError("died")))
    runs = {r.source_key: r.status for r in ingest.run_ingest(spark, str(landed), out, ["exploitdb", "krebs"], AS_OF).collect()}
    assert set(runs.values()) == {"error"} and store.read("exploit").count() == 1 and store.read("edge").count() == 0
    assert store.read("change_feed").filter("cve_id = 'CVE-2024-0001'").count() >= 1
    monkeypatch.undo()
    ingest.run_ingest(spark, str(landed), out, ["exploitdb", "krebs"], AS_OF)
    kinds = {(r.subject_type, r.object_type) for r in store.read("edge").collect()}
    assert ("exploit", "cve") in kinds and ("document", "cve") in kinds
    assert store.read("document").filter("extraction_version IS NULL").count() == 0


def test_stream_landing(spark, tmp_path):
    """Two files, one batch each, are folded in; a second start adds only the new file."""
    folder, store = tmp_path / "in", Store(spark, str(tmp_path / "out"))
    land(folder, "urls", "a.csv", '"1","2024-05-01 10:00:00","http://x.example/b","online","","m","elf","https://u/1/","joe"\n')
    land(folder, "urls", "b.csv", '"2","2024-05-01 10:00:00","http://x.example/c","online","","m","elf","https://u/2/","joe"\n')
    schema = "id string, dateadded string, url string, url_status string, last_online string, threat string, tags string, urlhaus_link string, reporter string"

    def parsed(lines):
        rows = lines.select(F.from_csv("value", F.lit(schema)).alias("r")).select("r.*", F.struct(F.col("r.id").alias("row")).alias("pos"))
        return parse_urls(rows).good.withColumn("attack_stix_id", F.lit(None).cast("string"))

    def fold_in(known, batch):
        return merge.refresh_indicators(known, batch, AS_OF)

    for i in range(3):  # snapshots of batch jobs come first; the stream goes on from them
        known = parse_urls(spark.sql(f"SELECT 'http://old.example/{i}' AS url, '2024-05-01 10:00:00' AS dateadded, struct('{i}' AS row) AS pos")).good
        store.merge("indicator", known.withColumn("attack_stix_id", F.lit(None).cast("string")), lambda old, new: merge.refresh_indicators(old, new, AS_OF))
    sink = jobs.snapshot_sink(store, "indicator", fold_in)
    jobs.land(parsed(jobs.landed_text(spark, str(folder / "urls"), 1)), sink, str(tmp_path / "cp")).awaitTermination()
    assert store.versions("indicator") == [0, 1, 2, 3, 4] and store.read("indicator").count() == 5
    land(folder, "urls", "c.csv", '"3","2024-05-01 10:00:00","http://x.example/b","offline","","m","elf","https://u/1/","joe"\n')
    jobs.land(parsed(jobs.landed_text(spark, str(folder / "urls"), 1)), sink, str(tmp_path / "cp")).awaitTermination()
    status = {r.value: r.status for r in store.read("indicator").collect()}
    assert status == {f"http://old.example/{i}": "unknown" for i in range(3)} | {"http://x.example/b": "offline", "http://x.example/c": "online"}
    sink(parsed(spark.read.text(str(folder / "urls" / "c.csv"))), 2)  # a replayed batch changes nothing
    assert store.versions("indicator") == [0, 1, 2, 3, 4, 5] and store.read("indicator").count() == 5


def _run(stream, tmp_path, mode="append"):
    out = str(tmp_path / "rows")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
        return out
    stream.writeStream.format("memory").queryName("pulse_out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start().awaitTermination()
    return "pulse_out"


def test_stream_operators(spark, table, tmp_path):
    schema = "k string, ts timestamp, actively_exploited boolean, in_kev boolean, query string"
    src = str(tmp_path / "src")
    rows = table([("a", datetime(2024, 5, 1, 1), True, False, "http://h.example/1"), ("a", datetime(2024, 5, 1, 2), False, False, "h.example"), ("b", datetime(2024, 5, 3), True, True, "word")], schema)
    rows.coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema(schema).parquet(src)
    got = spark.read.parquet(_run(jobs.first_seen(read(), ["k"], "ts"), tmp_path))
    assert sorted(r.k for r in got.collect()) == ["a", "b"]
    name = _run(jobs.daily_pulse(read(), "ts"), tmp_path, "complete")
    filled = jobs.fill_days(spark.table(name), datetime(2024, 5, 1), datetime(2024, 5, 3)).orderBy("day").collect()
    assert [(r.total, r.exploited, r.kev) for r in filled] == [(2, 1, 0), (0, 0, 0), (1, 1, 1)]
    ind = table([("uh", "url", "http://h.example/1", "h.example", "m1", datetime(2024, 5, 1)), ("uh", "url", "http://h.example/2", "h.example", None, datetime(2024, 5, 2))],
                "source_key string, kind string, value_norm string, host string, attack_stix_id string, first_seen_at timestamp")
    hits = spark.read.parquet(_run(jobs.check_observables(read(), ind), tmp_path / "w4"))
    assert sorted((r["query"], r.value_norm) for r in hits.collect()) == [
        ("h.example", "http://h.example/1"), ("h.example", "http://h.example/2"), ("http://h.example/1", "http://h.example/1"), ("http://h.example/1", "http://h.example/2")]


def test_stream_matching(spark, table, tmp_path):
    src = str(tmp_path / "src")
    table([("c1", "Acme", "Box", "", "< 2"), ("c2", "Acme", "Other", "", "< 2")], "cve_id string, vendor string, product string, cpe string, versions string").write.parquet(src)
    assets = table([("o", "e", "a1", "l", "acme", "box", "1.0")], "owner_id string, environment_id string, asset_id string, label string, vendor string, product string, version string")
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    rows = spark.read.parquet(_run(jobs.match_arrivals(stream, assets).select("asset_id", "cve_id", "verdict"), tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("a1", "c1", "range")]
