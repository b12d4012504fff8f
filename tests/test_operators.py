"""Merges, scoring, matching and links."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from vigil import schemas, vocab
from vigil.operators import family, inventory, link, match, merge, names, recompute, score
from vigil.plans import queries
from test_functions import _compare

T0, T1 = datetime(2024, 5, 1), datetime(2024, 6, 1)


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


KEV = ("cve_id string, vendor string, product string, kev_name string, kev_date_added date, kev_due_date date, kev_required_action string, kev_ransomware string, "
       "kev_notes string, short_description string, cwes array<string>, note_urls array<string>")
NVD = ("cve_id string, vuln_status string, published timestamp, last_modified timestamp, cvss_score double, cvss_severity string, cvss_vector string, cvss_version string, "
       "ssvc_exploitation string, ssvc_automatable string, ssvc_technical_impact string, description string, cwes array<string>, primary_vendor string, primary_product string")


def kev_row(cve, **kw):
    base = dict(cve_id=cve, vendor="V", product="P", kev_name="Name", kev_date_added=date(2024, 5, 1), kev_due_date=None, kev_required_action="Patch", kev_ransomware="Known",
                kev_notes=None, short_description="short", cwes=["CWE-1"], note_urls=[])
    return tuple({**base, **kw}.values())


def nvd_row(cve, **kw):
    base = dict(cve_id=cve, vuln_status="Analyzed", published=T0, last_modified=T0, cvss_score=9.8, cvss_severity="CRITICAL", cvss_vector=None, cvss_version="3.1",
                ssvc_exploitation=None, ssvc_automatable=None, ssvc_technical_impact=None, description="d" * 200, cwes=[], primary_vendor="nv", primary_product="np")
    return tuple({**base, **kw}.values())


def test_catalogue_merges(spark, table):
    empty = schemas.empty(spark, "vulnerability")
    listed = merge.apply_kev(empty, table([kev_row("CVE-2024-0001")], KEV), T0)
    assert rows_of(listed, "cve_id", "change", "title", "in_kev", "first_seen") == [("CVE-2024-0001", "new", "Name", True, T0)]
    base = merge.next_snapshot(listed)
    both = merge.apply_nvd(base, table([nvd_row("CVE-2024-0001"), nvd_row("CVE-2024-0002"), nvd_row("CVE-2019-0003", published=datetime(2019, 1, 1))], NVD), T1,
                           track_after=datetime(2024, 1, 1))
    got = {r.cve_id: r for r in both.collect()}
    assert set(got) == {"CVE-2024-0001", "CVE-2024-0002"}
    one, two = got["CVE-2024-0001"], got["CVE-2024-0002"]
    assert (one.change, one.title, one.vendor, one.description, one.cwes, one.first_seen, one.updated_at) == ("updated", "Name", "V", "d" * 200, ["CWE-1"], T0, T1)
    assert (two.change, two.title, two.vendor, two.in_kev) == ("new", "d" * 140, "nv", False)
    again = merge.apply_nvd(merge.next_snapshot(both), table([nvd_row("CVE-2024-0001"), nvd_row("CVE-2024-0002", cvss_score=None)], NVD), T1)
    assert rows_of(again, "cve_id", "change", "cvss_score") == [("CVE-2024-0001", "unchanged", 9.8), ("CVE-2024-0002", "updated", None)]
    kev_again = merge.apply_kev(merge.next_snapshot(again), table([kev_row("CVE-2024-0001"), kev_row("CVE-2024-0002", kev_name="Other")], KEV), T1)
    assert rows_of(kev_again, "cve_id", "change", "title", "in_kev") == [
        ("CVE-2024-0001", "unchanged", "Name", True), ("CVE-2024-0002", "updated", "d" * 140, True)]


def test_first_wins_and_insert_missing(table):
    old = table([("a", "old")], "k string, v string")
    batch = table([("a", "x", 0), ("b", "second", 2), ("b", "first", 1)], "k string, v string, pos int")
    once = merge.insert_missing(old, batch, ["k"], ["pos"])
    assert rows_of(once, "k", "v") == [("a", "old"), ("b", "first")]
    assert rows_of(merge.insert_missing(once, batch, ["k"], ["pos"]), "k", "v") == rows_of(once, "k", "v")


DOC = "url string, source_key string, title string, summary string, doc_type string, tier int, authors array<string>, categories array<string>, content_hash string, published_at timestamp"


def test_documents(spark, table):
    def doc(url, title, digest, at=None):
        return (url, "krebs", title, "s", "news", 3, [], [], digest, at)

    first = merge.next_snapshot(merge.upsert_documents(schemas.empty(spark, "document"), table([doc("u1", "a", "h1"), doc("u2", "b", "h2", T0)], DOC), T0))
    second = merge.upsert_documents(first, table([doc("u1", "changed", "h9", T1), doc("u2", "ignored", "h2", T1), doc("u3", "c", "h3")], DOC), T1)
    assert rows_of(second, "url", "change", "title", "published_at", "collected_at") == [
        ("u1", "updated", "changed", T0, T0), ("u2", "unchanged", "b", T0, T0), ("u3", "new", "c", T1, T1)]


def test_exploits_rules_indicators_payloads(spark, table):
    ex = ("source_key string, external_id string, title string, source_updated_at timestamp, cve_ids array<string>, pos int")
    base = merge.next_snapshot(merge.upsert_exploits(schemas.empty(spark, "exploit"), table([("exploitdb", "1", "a", T0, [], 0), ("exploitdb", "1", "dup", T0, [], 1)], ex), T0))
    again = merge.upsert_exploits(base, table([("exploitdb", "1", "b", T0, [], 0), ("exploitdb", "2", "c", T0, [], 1)], ex), T1)
    assert rows_of(again, "external_id", "title", "change") == [("1", "a", "unchanged"), ("2", "c", "new")]
    moved = merge.upsert_exploits(base, table([("exploitdb", "1", "b", T1, [], 0)], ex), T1)
    assert rows_of(moved, "external_id", "title", "change") == [("1", "b", "updated")]
    ind = "source_key string, kind string, value_norm string, status string, pos int"
    one = merge.next_snapshot(merge.refresh_indicators(schemas.empty(spark, "indicator"), table([("u", "url", "x", "online", 0), ("u", "url", "x", "late", 1), ("u", "url", "y", "online", 2)], ind), T0))
    two = merge.refresh_indicators(one, table([("u", "url", "x", "offline", 0)], ind), T1)
    assert rows_of(two, "value_norm", "status", "last_seen_at", "collected_at", "change") == [("x", "offline", T1, T0, "updated"), ("y", "online", T0, T0, "kept")]
    cache = table([("c1", "{}", False, T0)], schemas.TABLES["payload_cache"])
    kept = merge.put_payloads(cache, table([("c1", "{1}", True, T1)], schemas.TABLES["payload_cache"]))
    assert rows_of(kept, "cve_id", "payload", "found") == [("c1", "{1}", True)]
    assert merge.fresh_payloads(cache, T1, 7).count() == 0 and merge.fresh_payloads(kept, T1, 7).count() == 1


def scored(table, **kw):
    base = dict(in_kev=False, evidence=[], ransomware=False, exploit_count=0, poc_count=0, ssvc_poc=False, actors=[], tags=[], internet_facing=False, cvss_score=None,
                sources=0, last_signal=None, product_count=0)
    schema = ("in_kev boolean, evidence array<string>, ransomware boolean, exploit_count int, poc_count int, ssvc_poc boolean, actors array<string>, tags array<string>, "
              "internet_facing boolean, cvss_score double, sources int, last_signal timestamp, product_count int")
    df = table([tuple({**base, **kw}.values())], schema)
    found = score.reasons(**{c: F.col(c) for c in df.columns}, as_of=F.lit(T1).cast("timestamp"))
    row = df.select(found.alias("r")).select("r", score.total(F.col("r")).alias("s")).head()
    return row.s, [(r.factor, r.points, r.detail) for r in row.r]


def test_score(table):
    assert scored(table) == (0, [])
    full = scored(table, in_kev=True, evidence=["z", "a", "z"], ransomware=True, exploit_count=2, poc_count=1, ssvc_poc=True, actors=["B", "A"], tags=["rce", "auth_bypass", "privilege_escalation"],
                  internet_facing=True, cvss_score=9.8, sources=9, last_signal=T1, product_count=25)
    assert full[0] == 100 and full[1][0][:2] == ("CISA KEV", 25.0)
    points = [p for _, p, _ in full[1]]
    assert points == sorted(points, reverse=True) and len(points) == 14
    assert ("Active exploitation", 15.0, "Exploitation reported by: a, z") in full[1]
    assert ("Public PoC", 8.0, "1 public PoC repo(s) (unverified); CISA SSVC reports public PoC") in full[1]
    # half to even: 8 + 0.5 and 9 + 0.5
    assert scored(table, tags=["rce"], cvss_score=0.5)[0] == 8
    assert scored(table, product_count=5, internet_facing=True, cvss_score=0.5)[0] == 10
    assert scored(table, sources=3)[1] == [("Multiple independent sources", 6.0, "3 independent sources")]
    assert scored(table, sources=1)[1] == [] and scored(table, cvss_score=0.0)[1] == []


@pytest.mark.parametrize("when, points", [(datetime(2024, 5, 25), 8.0), (datetime(2024, 5, 24, 0, 0, 1), 8.0), (datetime(2024, 5, 24), 4.0), (datetime(2024, 5, 3), 4.0),
                                          (datetime(2024, 5, 2), 4.0), (datetime(2024, 5, 1), None), (datetime(2024, 7, 1), 8.0)])
def test_recency(table, when, points):
    found = scored(table, last_signal=when)[1]
    assert (found[0][1] if found else None) == points


def test_heuristic_techniques(table):
    cases = [("x", ["rce"], True, ["T1190"]), ("opens a document", ["rce"], False, ["T1203"]), ("smb service", ["rce"], False, ["T1210"]), ("token leak", ["info_disclosure"], False, ["T1212"]),
             ("smartscreen", [], False, ["T1211"]), ("x", ["privilege_escalation"], False, ["T1068"]), ("x", [], True, [])]
    df = table([(i, *c[:3]) for i, c in enumerate(cases)], "i int, t string, g array<string>, f boolean")
    got = df.select("i", score.heuristic_techniques(F.col("t"), F.col("g"), F.col("f")).alias("h")).orderBy("i").collect()
    assert [r.h for r in got] == [c[3] for c in cases]
    merged = table([(["T2", "T1"], ["T1", "T3"])], "e array<string>, h array<string>").select(score.merge_techniques(F.col("e"), F.col("h")).alias("m")).head().m
    assert [tuple(x) for x in merged] == [("T1", "explicit"), ("T2", "explicit"), ("T3", "heuristic")]


# ------------------------------------------------------------------------------------ matching
ASSET = "owner_id string, environment_id string, asset_id string, label string, vendor string, product string, version string"
PRODUCT = "cve_id string, vendor string, product string, cpe string, versions string"
VULN = "cve_id string, vendor string, product string, in_kev boolean"


def fold(v):
    return " ".join((v or "").strip().lower().replace("_", " ").split())


def brute_match(assets, products, vulns):
    """Pair by pair, in product order."""
    out = {}
    for _, _, aid, _, av, ap, ver in assets:
        for cve, vv, vp, listed in vulns:
            def same(v, p):
                if not fold(ap) or fold(ap) != fold(p):
                    return False
                return fold(v) in ("", "n/a") or fold(av) in ("", "n/a") or fold(v) == fold(av)

            cands = sorted((p for p in products if p[0] == cve and same(p[1], p[2])), key=lambda p: (p[1] or "", p[2] or "", p[3] or "", p[4] or ""))
            if not cands:
                if listed and same(vv, vp):
                    out[aid, cve] = ("possibly_affected", "kev_fallback", None)
                continue
            if not ver:
                out[aid, cve] = ("possibly_affected", "vendor_product", None)
                continue
            reasons, unsure, hit = [], False, None
            for _, _, _, cpe, versions in cands:
                pin = cpe.split(":")[5] if cpe and cpe.startswith("cpe:2.3:") and len(cpe.split(":")) > 5 and cpe.split(":")[5] not in ("*", "-", "") else None
                if pin is not None:
                    c = _compare(ver, pin)
                    if c == 0:
                        hit = "cpe_exact"
                        break
                    unsure |= c is None
                    if c is not None:
                        reasons.append(f"{cpe} names {pin}")
                    continue
                import re
                bounds = re.findall(r"(>=|<=|>|<)\s*([^\s<>=]+)", versions or "")
                lower = next((b for b in reversed(bounds) if b[0][0] == ">"), None)
                upper = next((b for b in reversed(bounds) if b[0][0] == "<"), None)
                state = "unknown" if not (lower or upper) else "in"
                for bound, ok in ((lower, (0, 1)), (upper, (-1, 0))):
                    if state != "in" or bound is None:
                        continue
                    c = _compare(ver, bound[1])
                    if c is None:
                        state = "unknown"
                    elif c not in ok or (c == 0 and bound[0] in "<>"):
                        state = "out"
                if state == "in":
                    hit = "cpe_version_range"
                    break
                if state == "out":
                    reasons.append(" ".join(" ".join(b) for b in (lower, upper) if b))
                unsure |= state == "unknown"
            if hit:
                out[aid, cve] = ("affected", hit, None)
            elif unsure or not reasons:
                out[aid, cve] = ("possibly_affected", "vendor_product", None)
            else:
                out[aid, cve] = ("not_affected", "cpe_version_range", "; ".join(reasons[:3]))
    return out


def test_match_against_brute_force(table):
    rng = random.Random(2)
    vendors, prods = ["Acme", "acme", "n/a", "", "Other Co", "other_co"], ["Gate Way", "gate_way", "GATE  WAY", "Box", ""]
    vers = ["1.0", "1.5", "2", "2.0.0", "abc", None, ""]
    ranges = [">= 1.0 < 2.0", "< 1.5", "<= 2", "> 1", "Hh-B1", "1.0, 1.5", None, ">= abc", ">= 1 <= 1.5", "> 2.0", "> 3", ">= 4"]
    cpes = ["", "", "", "cpe:2.3:a:x:y:1.5:*", "cpe:2.3:a:x:y:*:*", "cpe:2.3:a:x:y:abc:*", "cpe:2.3:a:x:y:9.9:*"]
    assets = [("o", "e", f"a{i}", f"l{i}", rng.choice(vendors), rng.choice(prods[:4]), rng.choice(vers)) for i in range(25)]
    vulns = [(f"CVE-2024-{i:04d}", rng.choice(vendors), rng.choice(prods), rng.random() < 0.5) for i in range(40)]
    products = list({(rng.choice(vulns)[0], rng.choice(vendors), rng.choice(prods), rng.choice(cpes), rng.choice(ranges)) for _ in range(220)})
    got = match.match_inventory(table(assets, ASSET), table(products, PRODUCT), table(vulns, VULN)).collect()
    want = brute_match(assets, products, vulns)
    assert {(r.asset_id, r.cve_id): (r.state, r.method) for r in got} == {k: v[:2] for k, v in want.items()}
    for r in got:
        assert r.exposure == vocab.EXPOSURE[r.state]
        reasons = want[r.asset_id, r.cve_id][2]
        if reasons:
            assert r.evidence.endswith(f"({reasons}).")


def test_matcher_plan(table):
    """No nested loops and no per-row Python; the reasons are cut before the shuffle."""
    a, p = table([("o", "e", "a", "l", "v", "p", "1")], ASSET), table([("c", "v", "p", "", "< 2")], PRODUCT)
    plan = match.match_products(a, p)._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert banned not in plan
    assert "WindowGroupLimit" in plan


def test_inventory(table):
    schema = ("owner_id string, asset_id string, environment_id string, label string, category string, vendor string, product string, version string, cpe string, catalogued boolean, "
              "hardware_model string, notes string")

    def asset(i, label="L", category="OS", vendor="v", owner="o"):
        return (owner, f"a{i}", "e", label, category, vendor, "p", "1", None, True, None, None)

    parsed = inventory.validate_assets(table([asset(1, "ok\x00 "), asset(2, category="toaster"), asset(3, vendor=""), asset(4, label="\x01"), asset(5, label="x" * 121)], schema))
    assert rows_of(parsed.good, "asset_id", "label", "category") == [("a1", "ok", "os")]
    assert {r.reason for r in parsed.rejects.collect()} == {"unknown category", "vendor missing", "empty after cleaning", "label too long"}
    one = inventory.put_assets(parsed.good.limit(0), parsed.good)
    assert inventory.put_assets(one, parsed.good).count() == 1
    with pytest.raises(inventory.InventoryFull):
        inventory.put_assets(one, table([asset(1000 + i) for i in range(500)], schema))
    envs = table([("e2", "o", "B", "inventory"), ("e1", "o", "A", "inventory"), ("e0", "x", "X", "inventory")], schemas.TABLES["environment"])
    assert rows_of(inventory.default_environment(envs, "o"), "environment_id") == [("e1",)]
    assert rows_of(inventory.default_environment(envs, "new"), "name") == [("My environment",)]
    assert [r.name for r in inventory.list_environments(envs, "o").collect()] == ["A", "B"]


# ------------------------------------------------------------------------------------ links
OBJ = "stix_id string, obj_type string, external_id string, name string, aliases array<string>, revoked boolean, deprecated boolean, modified timestamp"


def objects(table):
    return table([("g1", "group", "G1", "Hidden Cobra", ["Lazarus Group"], False, False, T0), ("ap1", "technique", "T1190", "Exploit", [], False, False, T0),
                  ("coa1", "mitigation", "T1190", "Mitigate", [], False, False, T0), ("m1", "malware", "S1", "Remcos", ["Socmer"], False, False, T0)], OBJ)


ART = "url string, title string, full_text string, source_key string, published_at timestamp"


def test_extract(table):
    many = " ".join(f"CVE-2024-{i:04d}" for i in range(1, 7))
    docs = table([("u1", "CVE-2024-0001 actively exploited", "by Lazarus Group aka hidden cobra with T1190 and T1999", "krebs", T0),
                  ("u2", "Roundup", many + " zero-day Remcos", "krebs", T0), ("u3", "Calm", "nothing", "krebs", T0)], ART)
    out = link.extract(docs, names.build_name_table(objects(table)))
    got = {(r.subject_id, r.object_id, r.relation): (r.method, r.confidence) for r in out.edges.collect()}
    want = {("u1", "CVE-2024-0001", "mentions"): ("regex", "high"), ("u1", "CVE-2024-0001", "reports_exploitation"): ("regex", "medium"),
            ("u1", "g1", "mentions"): ("dictionary", "medium"), ("u1", "ap1", "mentions"): ("regex", "high"), ("u2", "m1", "mentions"): ("dictionary", "medium")}
    want |= {("u2", f"CVE-2024-{i:04d}", "mentions"): ("regex", "low") for i in range(1, 7)}
    assert got == want
    assert rows_of(out.documents, "url", "reports_exploitation") == [("u1", True), ("u2", True), ("u3", False)]
    assert rows_of(recompute.co_mentioned(out.edges, objects(table)), "cve_id", "stix_id") == [("CVE-2024-0001", "ap1"), ("CVE-2024-0001", "g1")]
    plan = out.edges._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "NestedLoop" not in plan


def test_resolve(table):
    objs = objects(table)
    assert [r.stix_id for r in link.resolve_attack(objs, "t1190").collect()] == ["ap1"]
    assert [r.stix_id for r in link.resolve_attack(objs, "Remcos").collect()] == ["m1"]
    assert [r.stix_id for r in link.technique_stix(objs, "T1190").collect()] == ["ap1"]
    assert [r.stix_id for r in link.technique_stix(objs, "attack-pattern--x").collect()] == ["attack-pattern--x"]
    fams = table([("k1", ["elf", "RemcosRAT"], None), ("k2", ["Mirai"], "Mirai"), ("k3", ["socmer", "Remcos"], None), ("k4", [], None)], "k string, candidates array<string>, family string")
    assert rows_of(family.resolve_families(fams, objs, ["k"]).na.fill("-"), "k", "family", "attack_stix_id") == [
        ("k1", "RemcosRAT", "m1"), ("k2", "Mirai", "-"), ("k3", "socmer", "m1"), ("k4", "-", "-")]


def test_bad_parameters(spark, table):
    v = table([("c", 1, None)], "cve_id string, relevance_score int, last_activity_at timestamp")
    for call in (lambda: queries.window_start("2w", T0), lambda: queries.threat_order("random"), lambda: queries.paginate(v, [F.col("cve_id")], 1, 101),
                 lambda: queries.paginate(v, [F.col("cve_id")], 0, 10), lambda: queries.indicators(v, T0, kind=["email"]), lambda: queries.rules(v, v, v, v, level=["loud"])):
        with pytest.raises(queries.BadRequest):
            call()


def test_lookup(table):
    ind = table([("mb", "sha256", "a" * 64, None, None, None, None, T0, {"md5": "b" * 32, "imphash": "d" * 32}), ("uh", "url", "http://h.example/1", "h.example", None, None, "online", T1, {}),
                 ("uh", "url", "http://h.example/2", "h.example", None, None, "online", T0, {})],
                "source_key string, kind string, value_norm string, host string, family string, attack_stix_id string, status string, first_seen_at timestamp, related map<string,string>")
    asked = table([("B" * 32,), ("d" * 32,), ("h.example",), ("http://h.example/1",), ("nonsense",)], "query string")
    rows = queries.lookup(asked, ind, limit=1).collect()
    got = {r["query"]: (r["query_kind"], r["found"], r["total"], r["value_norm"]) for r in rows}
    assert got == {"B" * 32: ("md5", True, 1, "a" * 64), "d" * 32: ("md5", False, 0, None), "h.example": ("domain", True, 2, "http://h.example/1"),
                   "http://h.example/1": ("url", True, 2, "http://h.example/1"), "nonsense": (None, False, 0, None)}
