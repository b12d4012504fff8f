"""Readers on small files of the shapes the sources publish."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from vigil.operators import merge
from vigil.sources import attack, exploit_archive, feed, indicators, kev, nvd, registry, repositories, rules
from vigil.sources.common import WrongShape, reject_counts


def write(tmp_path, name, content):
    path = tmp_path / name
    path.parent.mkdir(exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    return str(path)


def test_kev(spark, tmp_path):
    path = write(tmp_path, "kev.json", {"catalogVersion": "1", "vulnerabilities": [
        {"cveID": " cve-2024-0001 ", "vendorProject": "Acme", "product": "Gate<b>way</b>", "vulnerabilityName": "Acme RCE", "dateAdded": "2024-05-01",
         "dueDate": "2024-05-22", "shortDescription": "Bad &amp; worse", "requiredAction": "Patch", "knownRansomwareCampaignUse": "Known",
         "notes": "https://acme.example/adv.; https://nvd.nist.gov/vuln/detail/CVE-2024-0001 ; https://acme.example/adv", "cwes": ["CWE-78", "NVD-CWE-noinfo"]},
        {"cveID": "CVE-24-1", "vendorProject": "x"}]})
    parsed = kev.read_kev(spark, path)
    row = parsed.good.head()
    assert (row.cve_id, row.product, row.kev_date_added, row.cwes, row.short_description) == ("CVE-2024-0001", "Gateway", date(2024, 5, 1), ["CWE-78"], "Bad & worse")
    assert row.note_urls == ["https://acme.example/adv", "https://nvd.nist.gov/vuln/detail/CVE-2024-0001"]
    assert [tuple(r) for r in reject_counts(parsed.rejects).collect()] == [("cisa_kev", "invalid CVE id", 1)]
    assert {r.url for r in merge.kev_references(parsed.good).collect()} == {
        "https://www.cisa.gov/known-exploited-vulnerabilities-catalog?search_api_fulltext=CVE-2024-0001", "https://acme.example/adv"}
    with pytest.raises(WrongShape):
        kev.read_kev(spark, write(tmp_path, "bad.json", {"title": "x"}))


NVD = {"totalResults": 1, "vulnerabilities": [{"cve": {
    "id": "CVE-2024-0001", "published": "2024-05-01T10:00:00.000", "lastModified": "2024-05-02T10:00:00.000", "vulnStatus": "Analyzed",
    "descriptions": [{"lang": "es", "value": "no"}, {"lang": "en", "value": "Remote <i>code</i> execution"}],
    "metrics": {"cvssMetricV31": [
        {"source": "cna@x", "type": "Primary", "cvssData": {"version": "3.1", "vectorString": "V1", "baseScore": 5.5, "baseSeverity": "MEDIUM"}},
        {"source": "nvd@nist.gov", "type": "Secondary", "cvssData": {"version": "3.1", "vectorString": "V2", "baseScore": 10.0, "baseSeverity": "CRITICAL"}}],
        "cvssMetricV2": [{"source": "nvd@nist.gov", "type": "Primary", "baseSeverity": "HIGH", "cvssData": {"version": "2.0", "baseScore": 7.0}}],
        "ssvcV203": [{"source": "x", "ssvcData": {"options": [{"exploitation": "poc"}, {"automatable": "Yes"}, {"exploitation": "Active"}]}}]},
    "weaknesses": [{"description": [{"lang": "en", "value": "CWE-78"}, {"lang": "en", "value": "NVD-CWE-Other"}]}, {"description": [{"lang": "en", "value": "CWE-78"}]}],
    "configurations": [{"nodes": [{"cpeMatch": [
        {"vulnerable": True, "criteria": "cpe:2.3:o:acme_inc:gate_way:*:*", "versionStartIncluding": "1.0", "versionEndExcluding": "2.0"},
        {"vulnerable": False, "criteria": "cpe:2.3:h:acme:box:*:*"},
        {"vulnerable": True, "criteria": "cpe:2.3:o:acme_inc:gate_way:*:*", "versionEndIncluding": "3.0"}]}]}],
    "affected": [{"affectedData": [{"vendor": "Acme", "product": "Gate way", "versions": [{"version": "1.1", "status": "affected"}, {"version": "2.0", "status": "unaffected"},
                                                                                         {"version": "1.2", "status": "affected"}]}]}],
    "references": [{"url": "https://x.example/a", "tags": ["Patch", "Exploit"]}, {"url": "javascript:x", "tags": []}, {"url": "https://x.example/b"}]}},
    {"cve": {"id": "bad"}}]}


def test_nvd(spark, tmp_path):
    parsed = nvd.read_nvd(spark, write(tmp_path, "nvd.json", NVD))
    row = parsed.good.head()
    assert (row.description, row.cvss_score, row.cvss_severity, row.cvss_vector) == ("Remote code execution", 10.0, "CRITICAL", "V2")
    assert (row.ssvc_exploitation, row.ssvc_automatable, row.ssvc_technical_impact) == ("active", "yes", None)
    assert row.cwes == ["CWE-78"] and row.published == datetime(2024, 5, 1, 10)
    assert (row.primary_vendor, row.primary_product) == ("acme inc", "gate way")
    assert [(r.url, r.ref_type) for r in row.references] == [("https://x.example/a", "exploit"), ("https://x.example/b", "reference")]
    products = {(r.vendor, r.product, r.cpe): r.versions for r in merge.nvd_products(parsed.good).collect()}
    assert products == {("acme inc", "gate way", "cpe:2.3:o:acme_inc:gate_way:*:*"): "<= 3.0", ("Acme", "Gate way", ""): "1.1, 1.2"}
    assert parsed.rejects.count() == 1


def test_exploit_archive(spark, tmp_path):
    header = ",".join(exploit_archive.COLUMNS)
    text = header + '\n1,f,"Bug, <b>big</b> ""quoted""",2024-01-02,joe,remote,linux,,2024-01-02,2024-02-03,1,CVE-2024-0001;OSVDB-1;cve-2024-0001,tag,,,,\nx,f,t,,,,,,,,,,,,,,\n3,f,,,,,,,,,,,,,,,\n'
    parsed = exploit_archive.read_exploit_archive(spark, write(tmp_path, "e.csv", text))
    row = parsed.good.head()
    assert (row.external_id, row.title, row.cve_ids, row.verified, row.source_updated_at) == ("1", 'Bug, big "quoted"', ["CVE-2024-0001"], True, datetime(2024, 2, 3))
    assert {(r.reason, r.rows) for r in reject_counts(parsed.rejects).collect()} == {("invalid archive id", 1), ("no title", 1)}
    with pytest.raises(WrongShape):
        exploit_archive.read_exploit_archive(spark, write(tmp_path, "bad.csv", "a,b\n1,2\n"))


SAMPLES = """# banner
#
# "first_seen_utc","sha256_hash","md5_hash","sha1_hash","reporter","file_name","file_type_guess","mime_type","signature","imphash"
"2024-05-01 10:00:00", "{a}", "{m}", "{s}", "joe", "x.exe", "exe", "app/x", "RemcosRAT", "n/a"
"2024-05-01 11:00:00", "nothash", "", "", "joe", "x", "exe", "app/x", "n/a", "n/a"
"2024-05-02 10:00:00", "{a}", "{m}", "{s}", "late", "x.exe", "exe", "app/x", "Other", "n/a"
""".format(a="A" * 64, m="b" * 32, s="c" * 40)
URLS = """################
# id,dateadded,url,url_status,last_online,threat,tags,urlhaus_link,reporter
"1","2024-05-01 10:00:00","http://User@Host.example:81/A","online","","malware_download","elf,Remcos","https://u/1/","joe"
"2","2024-05-01 10:00:00","http://x.example/b","","","malware_download","None","https://u/2/","n/a"
"3","2024-05-01 10:00:00","not a url","online","","x","None","https://u/3/","joe"
"4","2024-05-01 10:00:00","http://long.example/{}","online","","x","None","https://u/4/","joe"
""".format("p" * 700)


def test_indicator_dumps(spark, tmp_path):
    parsed = indicators.read_samples(spark, write(tmp_path, "mb.csv", SAMPLES))
    rows = parsed.good.orderBy("pos").collect()
    assert [(r.value, r.family, r.reporter) for r in rows] == [("a" * 64, "RemcosRAT", "joe"), ("a" * 64, "Other", "late")]
    assert rows[0].related == {"md5": "b" * 32, "sha1": "c" * 40} and rows[0].first_seen_at == datetime(2024, 5, 1, 10)
    assert parsed.rejects.count() == 1
    urls = indicators.read_urls(spark, write(tmp_path, "uh.csv", URLS))
    got = {r.value: (r.host, r.status, r.tags, r.reporter) for r in urls.good.collect()}
    assert got == {"http://User@Host.example:81/A": ("host.example", "online", ["elf", "Remcos"], "joe"), "http://x.example/b": ("x.example", "unknown", [], None),
                   f"http://long.example/{'p' * 700}": ("long.example", "online", [], "joe")}
    assert [r.reason for r in urls.rejects.collect()] == ["not a url"]
    with pytest.raises(WrongShape):
        indicators.read_urls(spark, write(tmp_path, "bad.csv", "a,b\n"))


BUNDLE = {"type": "bundle", "objects": [
    {"type": "x-mitre-matrix", "id": "m", "name": "M", "tactic_refs": ["ta-2", "ta-1"]},
    {"type": "x-mitre-tactic", "id": "ta-1", "name": "Impact", "x_mitre_shortname": "impact"},
    {"type": "attack-pattern", "id": "ap-1", "name": "Exploit App", "description": "See [x](https://y) (Citation: Z)  <b>now</b>", "x_mitre_is_subtechnique": True,
     "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "impact"}, {"kill_chain_name": "other", "phase_name": "no"}],
     "external_references": [{"source_name": "cve", "external_id": "X"}, {"source_name": "mitre-attack", "external_id": "T1190.001", "url": "https://a"}]},
    {"type": "course-of-action", "id": "coa-1", "name": "Patch", "external_references": [{"source_name": "mitre-attack", "external_id": "T1190.001"}]},
    {"type": "malware", "id": "mw-1", "name": "Remcos", "x_mitre_aliases": ["Remcos", "Socmer"], "modified": "2024-01-01T00:00:00.000Z"},
    {"type": "x-mitre-analytic", "id": "an-1", "name": "A", "x_mitre_log_source_references": [{"x_mitre_data_component_ref": "dc-1", "name": "n", "channel": "c"}]},
    {"type": "identity", "id": "i", "name": "ignored"},
    {"type": "relationship", "id": "r-1", "relationship_type": "uses", "source_ref": "mw-1", "target_ref": "ap-1"},
    {"type": "relationship", "id": "r-2", "relationship_type": "uses", "source_ref": "mw-1", "target_ref": "ap-1", "revoked": True},
    {"type": "relationship", "id": "r-3", "relationship_type": "related-to", "source_ref": "mw-1", "target_ref": "ap-1"}]}


def test_attack(spark, tmp_path):
    bundle = attack.read_attack(spark, write(tmp_path, "b.json", BUNDLE))
    rows = {r.stix_id: r for r in bundle.objects.collect()}
    assert set(rows) == {"ta-1", "ap-1", "coa-1", "mw-1", "an-1"}
    assert rows["ta-1"].extra["order"] == 1 and rows["mw-1"].aliases == ["Socmer"]
    tech = rows["ap-1"]
    assert (tech.external_id, tech.parent_external_id, tech.tactics, tech.description) == ("T1190.001", "T1190", ["impact"], "See x now")
    assert rows["an-1"].extra["log_sources"][0].asDict() == {"data_component": "dc-1", "name": "n", "channel": "c"}
    assert [r.stix_id for r in bundle.relationships.collect()] == ["r-1"]


RSS = """<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>F</title>
<item><title>APT &amp;amp; CVE-2024-0001</title><link>https://n.example/a?utm_source=x</link><pubDate>Mon, 06 May 2024 07:08:09 GMT</pubDate><dc:creator>Ann</dc:creator>
<category>one</category><category>two</category><description>&lt;p&gt;Short&lt;/p&gt;</description><content:encoded><![CDATA[<p>Full <script>x()</script>T1190 text</p>]]></content:encoded></item>
<item><title>No link</title><description>x</description></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Atom one</title><link href="https://n.example/b" rel="alternate"/><updated>2024-05-06T07:08:09Z</updated>
<author><name>Bob</name></author><category term="t"/><summary>Sum</summary></entry></feed>"""


def test_feed(spark, tmp_path):
    write(tmp_path, "a.xml", RSS), write(tmp_path, "b.xml", ATOM)
    parsed = feed.read_feed(spark, str(tmp_path), "krebs", "news", 3)
    rows = {r.url: r for r in parsed.good.collect()}
    a, b = rows["https://n.example/a"], rows["https://n.example/b"]
    assert (a.title, a.summary, a.full_text, a.categories, a.authors) == ("APT & CVE-2024-0001", "Short", "Short Full T1190 text", ["one", "two"], ["Ann"])
    assert a.published_at == datetime(2024, 5, 6, 7, 8, 9)
    assert (b.title, b.authors, b.categories, b.published_at) == ("Atom one", ["Bob"], ["t"], datetime(2024, 5, 6, 7, 8, 9))
    assert [r.reason for r in parsed.rejects.collect()] == ["no usable link"]


def test_repositories_and_releases(spark, tmp_path):
    items = [{"full_name": "a/CVE-2024-0001-poc", "html_url": "https://github.com/a/x", "description": "demo", "stargazers_count": 3, "fork": False, "owner": {"login": "a"},
              "created_at": "2024-05-01T00:00:00Z", "pushed_at": "2024-05-02T00:00:00Z"},
             {"full_name": "a/fork", "html_url": "https://github.com/a/f", "description": "CVE-2024-0001", "fork": True},
             {"full_name": "a/other", "html_url": "https://github.com/a/o", "description": "nothing", "fork": False},
             {"full_name": "bad name", "html_url": "https://github.com/a/b", "description": "CVE-2024-0001 scanner", "fork": False}]
    path = write(tmp_path, "r.json", {"total_count": 4, "items": items})
    parsed = repositories.read_repositories(spark, path, "CVE-2024-0001")
    assert [(r.external_id, r.kind, r.cve_ids, r.stars) for r in parsed.good.collect()] == [("a/CVE-2024-0001-poc", "poc", ["CVE-2024-0001"], 3)]
    assert parsed.rejects.count() == 1
    rel = write(tmp_path, "rel.json", [{"html_url": "https://github.com/a/x/releases/1", "tag_name": "v1", "name": "", "body": "<b>Notes</b>", "published_at": "2024-05-01T00:00:00Z"}])
    doc = feed.read_releases(spark, rel, "a/x").good.head()
    assert (doc.title, doc.full_text, doc.doc_type) == ("a/x v1", "Notes", "repository")


def test_classify_repository(table):
    rows = table([("a/sigma-rules", "", False), ("a/x", "mass test tool", False), ("a/x", "payload", False), ("a/x", "", True), ("a/x", None, False)],
                 "n string, d string, q boolean")
    got = rows.select(repositories.classify_repository(F.col("n"), F.col("d"), F.col("q"))).collect()
    assert [r[0] for r in got] == ["detection", "scanner", "poc", "poc", "repository"]


def test_rules(spark, tmp_path):
    write(tmp_path, "a.yml", "id: r-1\ntitle: T  one\nstatus: Stable\nlevel: HIGH\nlogsource: {product: windows}\ndetection:\n  sel: {a: 1}\n  condition: sel\n"
          "tags: [attack.t1190, attack.execution, cve.2024-0001, cve.2024.0002, attack.T1190]\nfalsepositives: none known\n")
    write(tmp_path, "b.yml", "title: no id\n"), write(tmp_path, "c.yaml", "a: [unclosed\n"), write(tmp_path, "d.txt", "ignored")
    parsed = rules.read_rules(spark, str(tmp_path), "r1", "2024-05-01")
    row = parsed.good.head()
    assert (row.external_id, row.title, row.status, row.level, row.logsource) == ("r-1", "T one", "stable", "high", {"product": "windows"})
    assert (row.techniques, row.cve_ids, row.falsepositives) == (["T1190"], ["CVE-2024-0001", "CVE-2024-0002"], ["none known"])
    assert "condition: sel" in row.detection
    assert {r.reason for r in parsed.rejects.collect()} == {"rule has no id", "unreadable YAML"}


def test_registry(spark):
    rows = {r.key: r for r in registry.sync_registry(spark, enable=["sigma", "yara", "otx"], disable=["krebs"], intervals={"nvd": 5}).collect()}
    assert len(rows) == 23
    assert (rows["sigma"].enabled, rows["yara"].enabled, rows["otx"].enabled, rows["krebs"].enabled) == (True, False, False, False)
    assert rows["nvd"].interval_seconds == 5


def test_dumps_of_different_layouts(spark, tmp_path):
    """Each file is read by its own header."""
    write(tmp_path, "d/a.csv", '# url,dateadded,reporter\n"http://a.example/1","2024-05-01 10:00:00","ann"\n')
    write(tmp_path, "d/b.csv", '# id,dateadded,reporter,url\n"7","2024-05-02 10:00:00","bob","http://b.example/2"\n')
    got = {r.value: (r.reporter, r.first_seen_at.day) for r in indicators.read_urls(spark, str(tmp_path / "d")).good.collect()}
    assert got == {"http://a.example/1": ("ann", 1), "http://b.example/2": ("bob", 2)}
    write(tmp_path, "d/c.csv", '"8","2024-05-02 10:00:00","bob","http://c.example/2"\n')
    with pytest.raises(WrongShape):
        indicators.read_urls(spark, str(tmp_path / "d"))
