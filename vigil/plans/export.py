"""Exports: JSON, CSV and Markdown.

Markdown is produced as ordered lines and written as text partitioned by CVE, so a large report is
split over files instead of being assembled in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import vocab
from vigil.functions.text import formula_guard, markdown, markdown_link, strip, title_or
from vigil.operators.ordering import Keep, dealt, numbered, ranged
from vigil.operators.recompute import Corpus
from vigil.plans import marts, profile
from vigil.session import literal_rows

TITLE_CHARS = 90


# ------------------------------------------------------------------------------------ JSON documents
FACT = "struct<number:bigint,kind:string,title:string,source:string,tier:int,at:string,url:string,detail:string>"
OVERVIEW = {
    "title": "title", "description": "description", "vendor": "vendor", "product": "product", "vuln_status": "vuln_status", "cwes": "cwes",
    "published": "published", "last_modified": "last_modified", "tags": "tags", "platforms": "platforms", "relevance_score": "relevance_score",
    "actively_exploited": "actively_exploited", "exploit_count": "exploit_count", "poc_count": "poc_count", "source_count": "source_count",
    "product_count": "product_count", "last_activity_at": "last_activity_at"}
GROUPS = {
    "cvss": {"score": "cvss_score", "severity": "cvss_severity", "vector": "cvss_vector", "version": "cvss_version"},
    "ssvc": {"exploitation": "ssvc_exploitation", "automatable": "ssvc_automatable", "technical_impact": "ssvc_technical_impact"},
    "kev": {"in_kev": "in_kev", "name": "kev_name", "date_added": "kev_date_added", "due_date": "kev_due_date",
            "required_action": "kev_required_action", "ransomware_use": "kev_ransomware", "notes": "kev_notes"}}
PART_FACTS = 5_000


def fact_order() -> list[Column]:
    return [F.col("section"), F.col("at").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("source", "title", "url", "kind", "detail")]]


def _named(fields: dict[str, str]) -> Column:
    return F.struct(*[F.col(column).alias(name) for name, column in fields.items()])


def cve_json(c: Corpus, keep: Keep, part_facts: int = PART_FACTS) -> DataFrame:
    """The whole profile of every CVE as JSON: (cve_id, part, parts, json).

    A document holds at most ``part_facts`` facts. Nearly every CVE has no more: its facts are dealt by CVE once, and numbered
    and put together where they lie. A CVE named in a third of all articles is several documents, each with the same head;
    its facts are numbered over range partitions, so no task gathers it.
    """
    facts = keep(profile.profile(c).filter(F.col("cve_id").isNotNull()))
    sizes = facts.groupBy("cve_id").agg(F.ceil(F.count(F.lit(1)) / part_facts).cast("int").alias("parts"))
    # at most one row for part_facts facts is sent to the facts, which stay where they lie
    several = F.broadcast(sizes.filter(F.col("parts") > 1))
    place = Window.partitionBy("cve_id").orderBy(*fact_order())
    short = dealt(facts.join(several, "cve_id", "left_anti"), ["cve_id"]).withColumns({"number": F.row_number().over(place).cast("long"), "part": F.lit(1), "parts": F.lit(1)})
    if several.isEmpty():
        return _documents(c, short)
    hot = ranged(facts.join(several, "cve_id", "left_semi"), ["cve_id"], fact_order(), keep).withColumn(
        "part", F.floor((F.col("number") - 1) / part_facts).cast("int") + 1).join(several, "cve_id")
    return _documents(c, short).unionByName(_documents(c, hot))


def _documents(c: Corpus, facts: DataFrame) -> DataFrame:
    """Numbered facts put together in two steps: lists of one section of one part, then the document of the part."""
    fact = F.struct("number", "kind", "title", "source", "tier", _day(F.col("at")).alias("at"), "url", "detail")
    lists = facts.groupBy("cve_id", "part", "section").agg(F.max("parts").alias("parts"), F.array_sort(F.collect_list(fact)).alias("facts"))
    documents = lists.groupBy("cve_id", "part").agg(
        F.max("parts").alias("parts"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "facts")))).alias("sections"))
    head = c.vulnerability.select("cve_id", _named(OVERVIEW).alias("overview"), *[_named(fields).alias(name) for name, fields in GROUPS.items()])
    # a CVE that only documents name has facts and no head
    whole = documents.join(head, "cve_id", "left").withColumn("tracked", F.col("overview").isNotNull())
    body = F.to_json(F.struct("cve_id", "part", "parts", "tracked", "overview", *GROUPS, "sections"))
    return whole.select("cve_id", "part", "parts", body.alias("json"))


def write_json(documents: DataFrame, path: str) -> None:
    """JSON lines in files that sort by CVE and part."""
    documents.repartitionByRange("cve_id", "part").sortWithinPartitions("cve_id", "part").select("json").write.mode("overwrite").text(path)


def read_json_facts(documents: DataFrame) -> DataFrame:
    """The facts of exported documents, read back: cve_id, part, section and the fields of a fact."""
    parsed = documents.select(F.from_json("json", f"cve_id string, part int, sections map<string,array<{FACT}>>").alias("j")).select("j.*")
    return parsed.select("cve_id", "part", F.explode("sections").alias("section", "facts")).select("cve_id", "part", "section", F.inline("facts"))


def _day(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ssXXX")


def evidence_csv(c: Corpus) -> DataFrame:
    """Flat evidence list of every CVE, each cell safe for a spreadsheet."""
    docs, exploits = profile.cve_documents(c), profile.cve_exploits(c)
    overview = profile._row(c.vulnerability, "overview", title=F.coalesce("title", "kev_name"), at=F.col("published"))
    named = F.when(F.col("kind") == "exploit", "public_exploits").otherwise("pocs")
    code = profile._row(exploits.filter(F.col("kind").isin("exploit", "poc")), named, title=F.col("title"),
                        source=profile.source_name(F.col("source_key")), tier=F.col("tier"), at=F.col("published_at"),
                        url=F.col("url"))
    events = profile.timeline(c, docs, exploits).withColumn("section", F.concat(F.lit("timeline:"), "kind"))
    sources = profile.source_table(c, docs, exploits).withColumn("section", F.concat(F.lit("source:"), "kind"))
    rows = overview.unionByName(code).unionByName(events).unionByName(sources)
    cells = {"cve_id": F.col("cve_id"), "section": F.col("section"), "title": F.col("title"), "source": F.col("source"),
             "tier": F.col("tier").cast("string"), "date": _day(F.col("at")), "url": F.col("url")}
    return rows.select(*[formula_guard(col).alias(name) for name, col in cells.items()])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


# ------------------------------------------------------------------------------------ Markdown report
def _lines(rows: DataFrame, section: int, place: Column, line: Column) -> DataFrame:
    return rows.select("cve_id", F.lit(section).alias("section"), place.cast("string").alias("place"), line.alias("line"))


def _head(vulns: DataFrame, section: int, lines: list[Column]) -> DataFrame:
    """Fixed lines at the start of a section; a null line is left out."""
    numbered = F.array(*[F.struct(F.lit(f"0{i:03d}").alias("place"), l.cast("string").alias("line"))
                         for i, l in enumerate(lines)])
    return vulns.select("cve_id", F.lit(section).alias("section"), F.inline(numbered)).filter(F.col("line").isNotNull())


def _tail(vulns: DataFrame, section: int, lines: list[str]) -> DataFrame:
    numbered = F.array(*[F.struct(F.lit(f"9{i:03d}").alias("place"), F.lit(l).alias("line")) for i, l in enumerate(lines)])
    return vulns.select("cve_id", F.lit(section).alias("section"), F.inline(numbered))


def _otherwise(vulns: DataFrame, rows: DataFrame, section: int, line: str) -> DataFrame:
    """The line that stands in for an empty section."""
    return _lines(vulns.select("cve_id").join(rows.select("cve_id"), "cve_id", "left_anti"), section, F.lit("1"), F.lit(line))


def _first(rows: DataFrame, keys: list[str], order: list[Column], n: int | None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("_n", F.row_number().over(w))
    return ranked if n is None else ranked.filter(F.col("_n") <= n)


def _seq(col: str = "_n") -> Column:
    return F.concat(F.lit("1"), F.lpad(F.col(col).cast("string"), 12, "0"))


def markdown_lines(c: Corpus, relationships: DataFrame, products: int | None = None, strategies_shown: int | None = None,
                   analytics: int | None = None, logs_shown: int | None = None, advisories_shown: int | None = None,
                   mitigations_shown: int | None = None) -> DataFrame:
    """Report of every CVE as (cve_id, section, place, line), in a fixed section order.

    The parameters keep the first lines of a list only; the default is all.
    """
    v = c.vulnerability
    blank, none = F.lit(""), F.lit(None).cast("string")
    shown = title_or(F.col("title"), F.col("kev_name"))
    docs, exploits = profile.cve_documents(c), profile.cve_exploits(c)
    at = lambda col: F.coalesce(F.date_format(col, "yyyy-MM-dd"), F.lit(""))
    or_na = lambda col: F.coalesce(F.when(col != "", col), F.lit("n/a"))
    name = profile.source_name(F.col("source_key"))

    parts = [
        _head(v, 0, [F.concat(F.lit("# "), "cve_id"), blank,
                     F.when(shown != "", F.concat(F.lit("**"), markdown(shown), F.lit("**"))), F.when(shown != "", blank)]),
        _head(v, 1, [F.lit("## Overview"), blank,
                     markdown(F.coalesce(F.when(F.col("description") != "", F.col("description")),
                                         F.lit("No description available."))), blank,
                     F.concat(F.lit("- Vendor / product: "), markdown(F.col("vendor")), F.lit(" / "), markdown(F.col("product"))),
                     F.concat(F.lit("- Published: "), F.coalesce(_day(F.col("published")), F.lit("n/a"))),
                     F.concat(F.lit("- CWE: "), or_na(F.array_join("cwes", ", "))), blank]),
        _head(v, 2, [F.lit("## Impact & Risk"), blank,
                     F.concat(F.lit("- CVSS: "), F.coalesce(F.when(F.col("cvss_score") != 0, F.col("cvss_score").cast("string")), F.lit("n/a")),
                              F.lit(" "), F.coalesce("cvss_severity", blank), F.lit(" `"), F.coalesce("cvss_vector", blank), F.lit("`")),
                     F.concat(F.lit("- Threat Relevance Score: **"), F.col("relevance_score").cast("string"),
                              F.lit("** / 100 (internal prioritisation, not CVSS)")), blank]),
        v.select("cve_id", F.posexplode("relevance_reasons").alias("n", "r")).select(
            "cve_id", F.lit(2).alias("section"), _seq("n").alias("place"),
            F.concat(F.lit("  - +"), F.col("r.points").cast("string"), F.lit(" "), markdown(F.col("r.factor")),
                     F.lit(" — "), markdown(F.col("r.detail"))).alias("line")),
        _tail(v, 2, [""]),
        _head(v, 3, [F.lit("## Affected Products"), blank]), _tail(v, 3, [""]),
        _head(v, 4, [F.lit("## Exploitation"), blank,
                     F.when(F.col("in_kev"), F.concat(
                         F.lit("- **CISA KEV** since "), F.coalesce(F.col("kev_date_added").cast("string"), F.lit("None")),
                         F.lit(" (due "), F.coalesce(F.col("kev_due_date").cast("string"), F.lit("None")),
                         F.lit("); ransomware use: "), markdown(F.col("kev_ransomware"))))]),
        _tail(v, 4, [""]),
        _head(v, 5, [F.lit("## Public Exploits & PoCs"), blank]),
        _tail(v, 5, ["", "> PoC code is unverified. Never run it outside an isolated lab.", ""]),
        _head(v, 6, [F.lit("## Threat Actors & Campaigns"), blank]), _tail(v, 6, [""]),
        _head(v, 7, [F.lit("## MITRE ATT&CK"), blank]), _tail(v, 7, [""]),
        _head(v, 8, [F.lit("## Detection"), blank]), _tail(v, 8, ["- Sigma / YARA: see the rule tables.", ""]),
        _head(v, 9, [F.lit("## Mitigation"), blank, F.when(F.col("kev_required_action") != "", F.concat(
            F.lit("- CISA required action: "), markdown(F.col("kev_required_action"))))]), _tail(v, 9, [""]),
        _head(v, 10, [F.lit("## Timeline"), blank]), _tail(v, 10, [""]),
        _head(v, 11, [F.lit("## Sources"), blank]),
        _tail(v, 11, ["", "_Every statement links to its original source._", ""]),
    ]

    prods = _first(c.affected_product, ["cve_id"], [F.col("vendor"), F.col("product"), F.col("cpe")], products)
    parts += [_lines(prods, 3, _seq(), F.concat(F.lit("- "), markdown(F.col("vendor")), F.lit(" "), markdown(F.col("product")),
                                               F.lit(" "), markdown(F.col("versions")))),
              _otherwise(v, prods, 3, "- n/a")]

    events = profile.exploitation(c, docs)
    rank = F.when(F.col("kind") == "kev", "1").when(F.col("kind") == "ssvc", "2").otherwise("3")
    parts += [_lines(events, 4, F.concat(F.lit("1"), rank, F.coalesce("url", blank)),
                     F.concat(F.lit("- "), markdown(F.col("source")), F.lit(": "), markdown(F.col("detail")), F.lit(" — "),
                              markdown_link(F.lit("source"), F.col("url")))),
              _otherwise(v, events, 4, "- No exploitation evidence collected.")]

    code = exploits.filter(F.col("kind").isin("exploit", "poc"))
    parts += [_lines(code, 5, F.concat(F.lit("1"), "kind", F.lit("|"), "exploit_id"),
                     F.concat(F.lit("- ["), "kind", F.lit("] "), markdown_link(F.col("title"), F.col("url")), F.lit(" ("),
                              markdown(name), F.lit(")"))),
              _otherwise(v, code, 5, "- None found.")]

    related = profile.related_entities(c).filter(F.col("section") != "techniques_reported").withColumnsRenamed(
        {"section": "group", "url": "doc_url"})
    first_report = related.groupBy("cve_id", "group", "kind", "title", "source").agg(F.min("doc_url").alias("doc_url")).join(
        c.document.select(F.col("url").alias("doc_url"), F.col("title").alias("doc_title")), "doc_url", "left")
    order = F.when(F.col("group") == "threat_actors", "1").when(F.col("group") == "campaigns", "2").otherwise("3")
    parts += [_lines(first_report, 6, F.concat(F.lit("1"), order, "title"),
                     F.concat(F.lit("- "), markdown(F.col("title")), F.lit(" ("), "kind", F.lit(", "), F.coalesce("source", blank),
                              F.lit(") — co-mentioned in "), markdown_link(F.col("doc_title"), F.col("doc_url")))),
              _otherwise(v, first_report, 6, "- No association found in collected reports.")]

    tagged = v.select("cve_id", F.inline("techniques"))
    known = marts.techniques_by_id(c.attack_object).groupBy("external_id").agg(
        F.min(F.struct("stix_id", "name", "tactics")).alias("t"))
    tactic_names = c.attack_object.filter(F.col("obj_type") == "tactic").select(
        F.col("shortname").alias("tactic"), F.col("name").alias("tactic_name"))
    tactics_of = known.select("external_id", F.explode("t.tactics").alias("tactic")).join(tactic_names, "tactic").groupBy(
        "external_id").agg(F.array_join(F.array_sort(F.collect_set("tactic_name")), ", ").alias("tactics"))
    attack = tagged.join(known, tagged["id"] == known["external_id"]).join(tactics_of, "external_id", "left")
    parts += [_lines(attack, 7, F.concat(F.lit("1"), "id"),
                     F.concat(F.lit("- **"), "id", F.lit(" "), markdown(F.col("t.name")), F.lit("** ("),
                              markdown(F.coalesce("tactics", blank)), F.lit(") — mapping: "), "method")),
              _otherwise(v, attack, 7, "- No technique mapping.")]

    ids = attack.select("cve_id", F.col("id").alias("tid"), F.col("t.stix_id").alias("technique"))
    detections = marts.technique_detections(c.attack_object, relationships).join(
        c.attack_object.select(F.col("stix_id").alias("strategy_stix"), F.col("url").alias("strategy_url")), "strategy_stix")
    strategies = _first(detections.select("technique", "strategy_stix", "strategy", "strategy_url").distinct(), ["technique"],
                        [F.col("strategy_stix")], strategies_shown).drop("_n")
    parts.append(_lines(ids.join(strategies, "technique"), 8, F.concat(F.lit("1"), "tid", F.lit("|"), "strategy_stix"),
                        F.concat(F.lit("- "), "tid", F.lit(": "), markdown_link(F.col("strategy"), F.col("strategy_url")))))
    platforms = c.attack_object.select(F.col("stix_id").alias("analytic"), F.array_join("platforms", ", ").alias("platforms"))
    described = strip(F.concat_ws(" ", "log_name", "channel"))
    shown = marts.technique_detections(c.attack_object, relationships, analytics=analytics, logs=logs_shown)
    logs = shown.join(strategies.select("technique", "strategy_stix"), ["technique", "strategy_stix"], "left_semi").groupBy(
        "technique", "strategy_stix", "analytic").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("log_pos"), described.alias("d")))),
                                 lambda x: F.when(x["d"] != "", x["d"])), "; ").alias("logs")).join(platforms, "analytic", "left")
    parts.append(_lines(
        ids.join(logs, "technique"), 8,
        F.concat(F.lit("1"), "tid", F.lit("|"), "strategy_stix", F.lit("|"), "analytic"),
        F.concat(F.lit("  - "), F.coalesce("platforms", blank), F.lit(": "), markdown(F.col("logs")))))

    listed = c.source_reference.filter(F.col("ref_type").isin("vendor_advisory", "patch", "mitigation")).select(
        "cve_id", F.lit(0).alias("branch"), "url", F.col("title"))
    written = docs.filter(F.col("doc_type") == "advisory").select("cve_id", F.lit(1).alias("branch"), "url", "title")
    advisories = _first(listed.unionByName(written), ["cve_id"], [F.col("branch"), F.col("url")], advisories_shown)
    parts.append(_lines(advisories, 9, _seq(), F.concat(F.lit("- "), markdown_link(
        F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("url")), F.col("url")))))
    mitigations = _first(marts.technique_mitigations(c.attack_object, relationships), ["technique"], [F.col("mitigation")], mitigations_shown)
    parts.append(_lines(ids.join(mitigations, "technique"), 9, F.concat(F.lit("2"), "tid", F.lit("|"), _seq()),
                        F.concat(F.lit("- "), F.coalesce("external_id", blank), F.lit(" "), markdown(F.col("name")), F.lit(" (for "), "tid", F.lit(")"))))

    dated = profile.timeline(c, docs, exploits)
    parts.append(_lines(dated, 10, F.concat(F.lit("1"), _day(F.col("at")), F.lit("|"), "kind", F.lit("|"), F.coalesce("url", blank)),
                        F.concat(F.lit("- "), at(F.col("at")), F.lit(" — "), "kind", F.lit(": "),
                                 markdown_link(F.col("title"), F.col("url")), F.lit(" ("), markdown(F.col("source")), F.lit(")"))))
    sources = profile.source_table(c, docs, exploits)
    parts.append(_lines(sources, 11, F.concat(F.lit("1"), F.col("tier").cast("string"), F.lit("|"), "source", F.lit("|"), F.coalesce("url", blank)),
                        F.concat(F.lit("- [Tier "), F.col("tier").cast("string"), F.lit("] "), markdown(F.col("source")), F.lit(" — "),
                                 markdown_link(F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("url")), F.col("url")))))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def number_lines(lines: DataFrame, keep: Keep) -> DataFrame:
    """Report lines with their place in the report of their CVE: (cve_id, number, line)."""
    order = [F.col("section"), F.col("place"), F.col("line")]
    return numbered(lines, ["cve_id"], order, keep).select("cve_id", "number", "line")


def write_lines(lines: DataFrame, path: str, buckets: int = 64) -> None:
    """Reports as text by bucket of CVEs. A bucket's files sort by name, and a large report spans several of them."""
    bucket = F.pmod(F.crc32("cve_id"), F.lit(buckets)).cast("int")
    order = ["bucket", "cve_id", "section", "place", "line"]
    lines.withColumn("bucket", bucket).repartitionByRange(*order).sortWithinPartitions(*order).select(
        "bucket", "line").write.mode("overwrite").partitionBy("bucket").text(path)


# ------------------------------------------------------------------------------------ environment report
def state_rank(state: Column) -> Column:
    rank = F.lit(9)
    for i, name in enumerate(vocab.STATES):
        rank = F.when(state == name, F.lit(i)).otherwise(rank)
    return rank


def short_title(title: Column) -> Column:
    """Cut a long title at a blank."""
    text = strip(F.coalesce(title, F.lit("")))
    cut = F.concat(F.regexp_replace(F.substring(text, 1, TITLE_CHARS), r" [^ ]*\z", ""), F.lit("…"))
    return F.when(F.length(text) > TITLE_CHARS, cut).otherwise(F.when(text != "", text))


def environment_report(matches: DataFrame, assets: DataFrame, vulns: DataFrame) -> DataFrame:
    """One row per match with its asset and vulnerability."""
    a = assets.select("owner_id", "asset_id", F.col("label").alias("asset"),
                      F.trim(F.concat_ws(" ", "vendor", "product")).alias("asset_software"),
                      F.col("version").alias("asset_version"))
    v = vulns.select("cve_id", short_title(F.col("title")).alias("title"), F.col("cvss_severity").alias("severity"),
                     "cvss_score", "relevance_score", F.coalesce("in_kev", F.lit(False)).alias("in_kev"))
    return matches.join(a, ["owner_id", "asset_id"], "left").join(v, "cve_id", "left").select(
        "owner_id", "environment_id", "asset_id", "cve_id", "state", "method", "confidence", "evidence", "exposure", "asset", "asset_software",
        "asset_version", "title", "severity", "cvss_score", "relevance_score",
        F.coalesce("in_kev", F.lit(False)).alias("in_kev"))


def report_order() -> list[Column]:
    return [state_rank(F.col("state")), F.coalesce("relevance_score", F.lit(0)).desc(), F.col("cve_id"), F.col("asset_id")]


def environment_csv(report: DataFrame) -> DataFrame:
    cells = {
        "state": F.col("state"), "cve_id": F.col("cve_id"), "title": F.col("title"), "severity": F.col("severity"),
        "cvss": F.col("cvss_score"), "relevance": F.col("relevance_score"),
        "in_kev": F.when(F.col("in_kev"), "yes").otherwise("no"), "asset": F.col("asset"),
        "software": F.col("asset_software"), "version": F.col("asset_version"), "method": F.col("method"),
        "confidence": F.col("confidence"), "evidence": F.col("evidence")}
    return report.orderBy(*report_order()).select(*[formula_guard(col).alias(name) for name, col in cells.items()])


def environment_markdown(report: DataFrame, assets: DataFrame, environment_name: str) -> DataFrame:
    """Report lines in order: (section, place, line)."""
    spark = report.sparkSession
    dash = lambda col: F.coalesce(F.when(markdown(col) != "", markdown(col)), F.lit("—"))

    def fixed(section: int, lines: list[str], start: str = "0") -> DataFrame:
        return literal_rows(spark, [(section, f"{start}{i:03d}", l) for i, l in enumerate(lines)],
                            "section int, place string, line string")

    header = ["## Inventory", "", "| Asset | Software | Version | Category | |", "| --- | --- | --- | --- | --- |"]
    listed = assets.select(F.lit(1).alias("section"), F.concat(F.lit("1"), "category", F.lit("|"), "label", F.lit("|"), "asset_id").alias("place"), F.concat(
        F.lit("| "), markdown(F.col("label")), F.lit(" | "), markdown(F.col("vendor")), F.lit(" "), markdown(F.col("product")),
        F.lit(" | "), dash(F.col("version")), F.lit(" | "), markdown(F.col("category")), F.lit(" | "),
        F.when(F.col("catalogued"), "").otherwise("unmatched"), F.lit(" |")).alias("line"))
    title = spark.range(1).select(F.lit(0).alias("section"), F.lit("0000").alias("place"),
                                  F.concat(F.lit("# "), markdown(F.lit(environment_name))).alias("line"))
    section = state_rank(F.col("state")) + 2
    heads = report.groupBy("state").agg(F.count("*").alias("n"))
    titles = F.create_map(*[F.lit(x) for pair in vocab.STATE_TITLES.items() for x in pair])
    heads = heads.select(section.alias("section"), F.inline(F.array(
        F.struct(F.lit("0000").alias("place"), F.concat(F.lit("## "), F.element_at(titles, F.col("state")), F.lit(" ("),
                                                        F.col("n").cast("string"), F.lit(")")).alias("line")),
        F.struct(F.lit("0001").alias("place"), F.lit("").alias("line")))))
    flags = F.concat_ws(
        " · ", F.when(F.col("in_kev"), "CISA KEV"), F.concat(F.lit("CVSS "), F.col("cvss_score").cast("string")),
        F.concat(F.lit("relevance "), F.col("relevance_score").cast("string")))
    block = F.array(
        F.concat(F.lit("### "), markdown(F.col("cve_id")), F.when(F.col("title") != "", F.concat(F.lit(" — "), markdown(F.col("title")))).otherwise("")),
        F.when(flags != "", markdown(flags)),
        F.concat(F.lit("- Asset: "), markdown(F.col("asset")), F.lit(" ("), markdown(F.col("asset_software")), F.lit(" "), dash(F.col("asset_version")), F.lit(")")),
        F.concat(F.lit("- Why: "), markdown(F.col("evidence"))), F.lit(""))
    rank = F.lpad((F.lit(1000) - F.coalesce("relevance_score", F.lit(0))).cast("string"), 4, "0")
    body = report.select(section.alias("section"), F.concat(F.lit("1"), rank, F.lit("|"), "cve_id", F.lit("|"), "asset_id").alias("p"),
                         F.posexplode(block).alias("i", "line")).filter(F.col("line").isNotNull()).select(
        "section", F.concat("p", F.lit("|"), F.col("i").cast("string")).alias("place"), "line")
    rows = title.unionByName(fixed(0, [""], "1")).unionByName(fixed(1, header)).unionByName(listed).unionByName(fixed(1, [""], "9"))
    rows = rows.unionByName(heads).unionByName(body)
    return rows.unionByName(fixed(20, ["---", "", "_The inventory in this file describes a live environment; treat it as you "
                                       "would a network diagram._"]))


def number_environment_lines(lines: DataFrame, keep: Keep) -> DataFrame:
    """Report lines with their place in the report: (number, line)."""
    return numbered(lines, [], [F.col("section"), F.col("place"), F.col("line")], keep).select("number", "line")
