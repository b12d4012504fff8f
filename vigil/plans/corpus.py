"""The canonical tables derived from the star-schema test tables.

The test data holds no security feeds, so the tables the operators work on are derived from it by
Spark: parts stand for vulnerabilities, orders for bulletins, order lines for what a bulletin names,
suppliers and nations for actors and techniques, customers for detection rules, pages and documents
for indicators and articles. Every derivation covers the whole table and grows with it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import schemas
from vigil.operators import inventory, link, match, merge, recompute
from vigil.sources.registry import source_tier
from vigil.sources.rules import cves_from_tags, techniques_from_tags

AS_OF = datetime(2001, 8, 2)
EVENTS_AS_OF = datetime(2024, 1, 31)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; zone-less timestamps are read as UTC."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    zoned = {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(zoned) if zoned else df


def case(col: Column, table: dict, default=None) -> Column:
    out = F.lit(default)
    for key, value in reversed(list(table.items())):
        out = F.when(col == key, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def cve_of(part: Column) -> Column:
    million = F.lit(1_000_000)
    year = (part - part % million) / million + 2000
    return F.concat(F.lit("CVE-"), year.cast("long").cast("string"), F.lit("-"),
                    F.lpad((part % million).cast("string"), 6, "0"))


def actor_of(supplier: Column) -> Column:
    return F.concat(F.lit("actor--"), supplier.cast("string"))


def technique_of(nation: Column) -> Column:
    return F.concat(F.lit("attack-pattern--"), nation.cast("string"))


def technique_id(nation: Column) -> Column:
    return F.concat(F.lit("T1"), F.lpad(nation.cast("string"), 3, "0"))


# What a part type says about its stand-in vulnerability.
IMPACT_TEXT = {
    "ECONOMY": "A remote code execution vulnerability",
    "STANDARD": "An unspecified issue",
    "PROMO": "An authentication bypass",
    "SMALL": "A privilege escalation flaw",
    "LARGE": "A use-after-free bug in the Windows kernel",
    "MEDIUM": "A path traversal issue in a web console",
}
IMPACT_CWES = {"STANDARD": ["CWE-287", "CWE-798"], "MEDIUM": ["CWE-22"]}


def nvd_batch(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part")
    dates = load(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.min("l_shipdate").alias("published"), F.max("l_shipdate").alias("last_modified"))
    size, kind = F.col("p_size"), F.col("p_type")
    scored = kind != "STANDARD"
    score = F.when(scored, F.round(size / 5.0, 1))
    none = F.array().cast("array<string>")
    cwes = F.when(kind == "STANDARD", F.array(*map(F.lit, IMPACT_CWES["STANDARD"]))).when(
        kind == "MEDIUM", F.array(*map(F.lit, IMPACT_CWES["MEDIUM"]))).otherwise(none)
    return part.join(dates, part["p_partkey"] == dates["l_partkey"], "left").select(
        cve_of(F.col("p_partkey")).alias("cve_id"),
        F.concat(case(kind, IMPACT_TEXT), F.lit(" in "), "p_name", F.lit(" of "), "p_brand", F.lit(".")).alias("description"),
        F.lit("Analyzed").alias("vuln_status"), "published", "last_modified", cwes.alias("cwes"),
        score.alias("cvss_score"),
        F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(scored, "LOW").alias("cvss_severity"),
        F.lit(None).cast("string").alias("cvss_vector"), F.lit("3.1").alias("cvss_version"),
        F.when(size > 45, "active").when(size > 35, "poc").otherwise("none").alias("ssvc_exploitation"),
        F.lit("no").alias("ssvc_automatable"), F.lit("partial").alias("ssvc_technical_impact"),
        F.col("p_brand").alias("primary_vendor"), F.col("p_name").alias("primary_product"))


def kev_batch(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one type are listed as exploited."""
    part = load(spark, d, "part").filter(F.col("p_type") == "PROMO")
    listed = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_shipdate").alias("listed"))
    return part.join(listed, part["p_partkey"] == listed["l_partkey"], "left").select(
        cve_of(F.col("p_partkey")).alias("cve_id"), F.col("p_brand").alias("vendor"), F.col("p_name").alias("product"),
        F.concat("p_name", F.lit(" Gateway Vulnerability")).alias("kev_name"),
        F.to_date("listed").alias("kev_date_added"), F.date_add(F.to_date("listed"), 21).alias("kev_due_date"),
        F.concat(F.lit("Update "), "p_name").alias("kev_required_action"),
        F.when(F.col("p_size") > 25, "Known").otherwise("Unknown").alias("kev_ransomware"),
        F.concat(F.lit("See https://vendor.example.com/"), F.col("p_partkey").cast("string")).alias("kev_notes"),
        F.lit("Listed as exploited.").alias("short_description"), F.array().cast("array<string>").alias("cwes"),
        F.array(F.concat(F.lit("https://vendor.example.com/"), F.col("p_partkey").cast("string"))).alias("note_urls"))


def vulnerabilities(spark: SparkSession, d: str) -> DataFrame:
    """Both batches merged, the exploited list first; the first sighting is the publication date."""
    base = schemas.empty(spark, "vulnerability")
    listed = merge.next_snapshot(merge.apply_kev(base, kev_batch(spark, d), AS_OF))
    full = merge.next_snapshot(merge.apply_nvd(listed, nvd_batch(spark, d), AS_OF))
    return full.withColumn("first_seen", F.col("published"))


def products(spark: SparkSession, d: str) -> DataFrame:
    """A main row per part in several notations, and one row per nation a part is supplied from."""
    part = load(spark, d, "part")
    kind, size = F.col("p_type"), F.col("p_size")
    underscored = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    pinned = F.concat(F.lit("cpe:2.3:a:"), F.lower("p_brand"), F.lit(":"), underscored, F.lit(":"), size.cast("string"),
                      F.lit(".0:*:*:*:*:*:*:*"))
    span = F.concat(F.lit(">= "), (size - 5).cast("string"), F.lit(".0 < "), (size + 5).cast("string"), F.lit(".0"))
    main = part.filter(kind != "PROMO").select(
        cve_of(F.col("p_partkey")).alias("cve_id"),
        F.when(kind == "MEDIUM", "n/a").when(kind == "SMALL", F.lower("p_brand")).otherwise(F.col("p_brand")).alias("vendor"),
        F.when(kind == "SMALL", underscored).otherwise(F.col("p_name")).alias("product"),
        F.when(kind == "SMALL", pinned).otherwise("").alias("cpe"),
        F.when(kind == "SMALL", None).when(kind == "LARGE", F.concat(F.lit("Hh-B"), size.cast("string"))).otherwise(span).alias("versions"),
        F.lit("nvd").alias("source_key"))
    line, sup, nat = load(spark, d, "lineitem"), load(spark, d, "supplier"), load(spark, d, "nation")
    regional = line.select("l_partkey", "l_suppkey").join(
        sup.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        nat.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "l_partkey", "n_name").distinct().join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        cve_of(F.col("p_partkey")).alias("cve_id"), F.col("p_brand").alias("vendor"),
        F.concat("p_name", F.lit(" "), "n_name").alias("product"), F.lit("").alias("cpe"), span.alias("versions"),
        F.lit("nvd").alias("source_key"))
    return main.unionByName(regional)


def references(spark: SparkSession, d: str) -> DataFrame:
    nvd = nvd_batch(spark, d).withColumn(
        "references", F.array().cast("array<struct<url:string,tags:array<string>,ref_type:string>>"))
    base = schemas.empty(spark, "source_reference")
    first = merge.add_references(base, merge.kev_references(kev_batch(spark, d)))
    return merge.add_references(first, merge.nvd_references(nvd))


BULLETIN_SOURCES = {"1-URGENT": "unit42", "2-HIGH": "talos", "3-MEDIUM": "bleepingcomputer", "4-NOT SPECIFIED": "krebs",
                    "5-LOW": "therecord"}
BULLETIN_TYPES = {"F": "research", "O": "news", "P": "advisory"}


def bulletin_url(order: Column) -> Column:
    return F.concat(F.lit("https://bulletins.example.org/"), order.cast("string"))


def bulletins(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    source = case(F.col("o_orderpriority"), BULLETIN_SOURCES)
    none = F.array().cast("array<string>")
    return o.select(
        bulletin_url(F.col("o_orderkey")).alias("url"), source.alias("source_key"),
        F.concat(F.lit("Bulletin "), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority").alias("title"),
        F.when(urgent & (F.col("o_orderstatus") == "F"), "Ransomware operators are involved").otherwise(
            "Routine summary").alias("summary"),
        F.lit(None).cast("string").alias("full_text"), case(F.col("o_orderstatus"), BULLETIN_TYPES).alias("doc_type"),
        source_tier(source).alias("tier"), none.alias("authors"), none.alias("categories"),
        F.lit(None).cast("string").alias("content_hash"), urgent.alias("reports_exploitation"),
        F.lit("1").alias("extraction_version"), F.col("o_orderdate").alias("published_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("collected_at"),
        F.lit(None).cast("timestamp").alias("updated_at"))


def exploits(spark: SparkSession, d: str) -> DataFrame:
    """Returned order lines are public code for the part they name."""
    line = load(spark, d, "lineitem").filter(F.col("l_returnflag") == "R")
    rows = line.groupBy("l_orderkey", "l_linenumber").agg(
        F.array_sort(F.collect_set(cve_of(F.col("l_partkey")))).alias("cve_ids"), F.min("l_linestatus").alias("state"),
        F.min("l_shipdate").alias("published_at"))
    archive = F.col("state") == "F"
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return rows.select(
        F.when(archive, "exploitdb").otherwise("github").alias("source_key"), key.alias("external_id"),
        F.concat(F.lit("Code "), key).alias("title"), F.concat(F.lit("https://code.example.org/"), key).alias("url"),
        F.when(archive, "exploit").otherwise("poc").alias("kind"), F.lit("multiple").alias("platform"),
        F.lit("remote").alias("exploit_type"), F.lit(None).cast("string").alias("author"), archive.alias("verified"),
        F.lit(None).cast("string").alias("description"), "cve_ids", F.when(archive, 2).otherwise(4).alias("tier"),
        F.col("l_linenumber").cast("long").alias("stars"), F.lit(None).cast("string").alias("language"), "published_at",
        F.lit(None).cast("timestamp").alias("source_updated_at"), F.col("published_at").alias("collected_at"))


def attack_objects(spark: SparkSession, d: str) -> DataFrame:
    """Regions are tactics, nations techniques with a mitigation and a strategy each, suppliers actors and software."""
    reg, nat = load(spark, d, "region"), load(spark, d, "nation")
    sup, cus = load(spark, d, "supplier"), load(spark, d, "customer")
    names = [f.split(" ")[0].strip("`") for f in (
        "stix_id obj_type external_id name description aliases platforms tactics shortname is_subtechnique "
        "parent_external_id url deprecated revoked created modified extra").split(" ")]
    none = F.array().cast("array<string>")
    defaults = {
        "description": F.lit(None).cast("string"), "aliases": none, "platforms": none, "tactics": none,
        "shortname": F.lit(None).cast("string"), "is_subtechnique": F.lit(False),
        "parent_external_id": F.lit(None).cast("string"), "deprecated": F.lit(False), "revoked": F.lit(False),
        "created": F.lit(None).cast("timestamp"), "modified": F.lit(datetime(2001, 1, 1)).cast("timestamp")}

    def extra(**cols: Column) -> Column:
        kinds = {"log_sources": schemas.LOGS, "mutable_elements": "array<string>", "analytic_refs": "array<string>",
                 "first_seen": "string", "last_seen": "string", "order": "int", "detection": "string"}
        return F.struct(*[cols.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])

    def objects(df: DataFrame, **cols: Column) -> DataFrame:
        full = {**defaults, "url": F.concat(F.lit("https://attack.example.org/"), cols["stix_id"]), "extra": extra(), **cols}
        return df.select(*[full[n].alias(n) for n in names])

    key = F.col("n_nationkey")
    shortname = F.lower("r_name")
    segments = cus.groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))
    techniques = nat.join(reg, nat["n_regionkey"] == reg["r_regionkey"])
    watched = sup.join(segments, F.col("s_nationkey") == F.col("c_nationkey"), "left")
    kinds = F.element_at(F.array(*map(F.lit, ("group", "malware", "tool", "campaign"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    logs = F.transform("segments", lambda s: F.struct(
        F.concat(F.lit("component--"), s).alias("data_component"), F.lower(s).alias("name"), F.lit("log").alias("channel")))
    parts = [
        objects(reg, stix_id=F.concat(F.lit("tactic--"), F.col("r_regionkey").cast("string")), obj_type=F.lit("tactic"),
                external_id=F.concat(F.lit("TA"), F.lpad(F.col("r_regionkey").cast("string"), 4, "0")), name=F.col("r_name"),
                shortname=shortname, extra=extra(order=F.col("r_regionkey"))),
        objects(techniques, stix_id=technique_of(key), obj_type=F.lit("technique"), external_id=technique_id(key),
                name=F.col("n_name"), tactics=F.array(shortname), description=F.concat(F.lit("About "), "n_name")),
        objects(nat, stix_id=F.concat(F.lit("course-of-action--"), key.cast("string")), obj_type=F.lit("mitigation"),
                external_id=technique_id(key), name=F.concat("n_name", F.lit(" Mitigation"))),
        objects(nat, stix_id=F.concat(F.lit("strategy--"), key.cast("string")), obj_type=F.lit("detection_strategy"),
                external_id=F.concat(F.lit("DET"), F.lpad(key.cast("string"), 4, "0")), name=F.concat(F.lit("Detect "), "n_name")),
        objects(watched, stix_id=F.concat(F.lit("analytic--"), F.col("s_suppkey").cast("string")), obj_type=F.lit("analytic"),
                external_id=F.concat(F.lit("AN"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")),
                name=F.concat(F.lit("Analytic "), F.col("s_suppkey").cast("string")), platforms=F.array(F.lit("Linux")),
                extra=extra(log_sources=logs)),
        objects(cus.select("c_mktsegment").distinct(), stix_id=F.concat(F.lit("component--"), "c_mktsegment"),
                obj_type=F.lit("data_component"), external_id=F.concat(F.lit("DC-"), "c_mktsegment"), name=F.col("c_mktsegment")),
        objects(sup, stix_id=actor_of(F.col("s_suppkey")), obj_type=kinds,
                external_id=F.concat(F.lit("G"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")), name=F.col("s_name"),
                aliases=F.array(F.concat(F.lit("Actor "), F.col("s_suppkey").cast("string")))),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def attack_relationships(spark: SparkSession, d: str) -> DataFrame:
    nat, sup = load(spark, d, "nation"), load(spark, d, "supplier")
    key = F.col("n_nationkey")

    def rel(df: DataFrame, kind: str, source: Column, target: Column) -> DataFrame:
        return df.select(F.concat_ws(">", source, F.lit(kind), target).alias("stix_id"), F.lit(kind).alias("relationship_type"),
                         source.alias("source_ref"), target.alias("target_ref"),
                         F.concat(F.lit(kind + " "), target).alias("description"))

    return rel(sup, "uses", actor_of(F.col("s_suppkey")), technique_of(F.col("s_nationkey"))).unionByName(
        rel(nat, "mitigates", F.concat(F.lit("course-of-action--"), key.cast("string")), technique_of(key))).unionByName(
        rel(nat, "detects", F.concat(F.lit("strategy--"), key.cast("string")), technique_of(key))).unionByName(
        rel(sup, "includes", F.concat(F.lit("strategy--"), F.col("s_nationkey").cast("string")),
            F.concat(F.lit("analytic--"), F.col("s_suppkey").cast("string"))))


RULE_LEVELS = {"AUTOMOBILE": "critical", "BUILDING": "high", "FURNITURE": "medium", "HOUSEHOLD": "low",
               "MACHINERY": "informational"}


def rules(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer")
    owing = F.col("c_acctbal") < 0
    cve = cve_of(F.col("c_custkey"))
    tags = F.array_compact(F.array(
        F.concat(F.lit("attack."), F.lower(technique_id(F.col("c_nationkey")))), F.lit("attack.execution"),
        F.when(owing, F.concat(F.lit("cve."), F.substr(cve, F.lit(5))))))
    none = F.array().cast("array<string>")
    return c.select(
        F.lit("sigma").alias("source_key"), F.concat(F.lit("rule-"), F.col("c_custkey").cast("string")).alias("external_id"),
        F.col("c_name").alias("title"), F.concat(F.lit("Watches "), "c_mktsegment").alias("description"),
        F.lit("sigma").alias("rule_format"), F.when(owing, "experimental").otherwise("stable").alias("status"),
        case(F.col("c_mktsegment"), RULE_LEVELS).alias("level"), F.create_map(F.lit("product"), F.lower("c_mktsegment")).alias("logsource"),
        F.lit(None).cast("string").alias("detection"), none.alias("falsepositives"), none.alias("references"), tags.alias("tags"),
        F.lit(None).cast("string").alias("author"), F.lit("r1").alias("release"), F.lit(AS_OF).cast("timestamp").alias("published_at"),
        F.lit(AS_OF).cast("timestamp").alias("collected_at"), F.lit(2).alias("tier")).withColumns({
            "techniques": techniques_from_tags(F.col("tags")), "cve_ids": cves_from_tags(F.col("tags"))})


def edges(spark: SparkSession, d: str, exploit: DataFrame | None = None) -> DataFrame:
    """What each bulletin, exploit and rule names. A bulletin with at most five parts is focused.

    Order lines are dealt by order once; what they name is made distinct, counted and dated where it lies.
    """
    line, o = load(spark, d, "lineitem"), load(spark, d, "orders")
    sup = load(spark, d, "supplier").select("s_suppkey", "s_nationkey")

    def thing(kind: str, number: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(number).cast("long").alias("number"))

    supplied = F.col("s_suppkey").isNotNull()
    lines = line.filter(F.col("l_orderkey").isNotNull()).select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey").join(
        sup, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("o_orderkey", "l_partkey", "l_suppkey", "s_nationkey", supplied.alias("supplied"))
    things = F.array(thing("cve", "l_partkey"), thing("actor", "l_suppkey"), F.when(F.col("supplied"), thing("technique", "s_nationkey")))
    named = lines.repartition("o_orderkey").select("o_orderkey", F.inline(F.array_compact(things))).distinct()
    is_cve, is_actor = F.col("kind") == "cve", F.col("kind") == "actor"
    named = named.withColumn("parts", F.count_if(is_cve).over(Window.partitionBy("o_orderkey"))).join(
        o.select("o_orderkey", "o_orderdate", "o_orderpriority"), "o_orderkey")
    focused = F.col("parts") <= 5
    reported = is_cve & focused & (F.col("o_orderpriority") == "1-URGENT")
    number = F.col("number")
    object_id = F.when(is_cve, cve_of(number)).when(is_actor, actor_of(number)).otherwise(technique_of(number))
    relations = F.when(reported, F.array(F.lit("mentions"), F.lit("reports_exploitation"))).otherwise(F.array(F.lit("mentions")))
    by_doc = named.select("*", object_id.alias("object_id")).select("*", F.explode(relations).alias("relation")).select(
        F.lit("document").alias("subject_type"), bulletin_url(F.col("o_orderkey")).alias("subject_id"),
        F.when(is_cve, "cve").otherwise("attack").alias("object_type"), "object_id", "relation",
        F.when(is_actor, "dictionary").otherwise("regex").alias("method"),
        F.when(is_actor | (F.col("relation") == "reports_exploitation"), "medium").when(is_cve & ~focused, "low").otherwise("high").alias("confidence"),
        case(F.col("o_orderpriority"), BULLETIN_SOURCES).alias("source_key"),
        F.concat(F.lit("line "), "object_id").alias("evidence"), F.col("o_orderdate").alias("observed_at"))
    nat = load(spark, d, "nation")
    techniques = nat.select(technique_id(F.col("n_nationkey")).alias("external_id"), technique_of(F.col("n_nationkey")).alias("stix_id"))
    return by_doc.unionByName(link.exploit_edges(exploits(spark, d) if exploit is None else exploit)).unionByName(
        link.rule_edges(rules(spark, d), techniques))


def corpus(spark: SparkSession, d: str) -> recompute.Corpus:
    return recompute.Corpus(
        vulnerability=vulnerabilities(spark, d), affected_product=products(spark, d), source_reference=references(spark, d),
        exploit=exploits(spark, d), document=bulletins(spark, d), edge=edges(spark, d), attack_object=attack_objects(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return recompute.recompute(corpus(spark, d), AS_OF)


def assets(spark: SparkSession, d: str) -> DataFrame:
    """One asset per brand and part type, at most brands x types; the type is the owner."""
    part = load(spark, d, "part")
    rows = part.groupBy("p_type", "p_brand").agg(F.min(F.struct("p_partkey", "p_name", "p_size")).alias("a"))
    kind = F.col("p_type")
    null = F.lit(None).cast("string")
    return rows.select(
        F.concat_ws("/", kind, "p_brand").alias("asset_id"), kind.alias("owner_id"), F.concat(F.lit("env-"), kind).alias("environment_id"),
        F.concat("p_brand", F.lit(" host")).alias("label"), F.lit("application").alias("category"),
        F.when(kind == "STANDARD", "n/a").otherwise(F.col("p_brand")).alias("vendor"), F.upper("a.p_name").alias("product"),
        F.when(kind != "ECONOMY", F.concat(F.col("a.p_size").cast("string"), F.lit(".0.0"))).alias("version"),
        null.alias("cpe"), F.lit(True).alias("catalogued"), null.alias("hardware_model"), null.alias("notes"))


def fleet(spark: SparkSession, d: str) -> DataFrame:
    """Every part as an asset, so the inventory grows with the parts; a site owns up to 400 of them."""
    part = load(spark, d, "part")
    site = F.floor(F.col("p_partkey") / 400).cast("string")
    null = F.lit(None).cast("string")
    return part.select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("asset_id"), F.concat(F.lit("site-"), site).alias("owner_id"),
        F.concat(F.lit("env-site-"), site).alias("environment_id"), F.concat("p_brand", F.lit(" host")).alias("label"),
        F.lit("application").alias("category"), F.col("p_brand").alias("vendor"), F.upper("p_name").alias("product"),
        F.when(F.col("p_type") != "ECONOMY", F.concat(F.col("p_size").cast("string"), F.lit(".0.0"))).alias("version"),
        null.alias("cpe"), F.lit(True).alias("catalogued"), null.alias("hardware_model"), null.alias("notes"))


def matches(spark: SparkSession, d: str) -> DataFrame:
    return match.match_inventory(assets(spark, d), products(spark, d), vulnerabilities(spark, d))


def owner_matches(spark: SparkSession, d: str, owner: str = "STANDARD") -> tuple[DataFrame, DataFrame]:
    """Assets and matches of one owner, chosen before matching."""
    mine = inventory.owned(assets(spark, d), owner)
    return mine, match.match_inventory(mine, products(spark, d), vulnerabilities(spark, d))


# ------------------------------------------------------------------------------------ text
def articles(spark: SparkSession, d: str) -> DataFrame:
    """Every document as an article: its whole prose, followed by what its order lines name."""
    docs = load(spark, d, "documents")
    line, o, sup = load(spark, d, "lineitem"), load(spark, d, "orders"), load(spark, d, "supplier")
    said = F.concat(
        cve_of(F.col("l_partkey")), F.lit(" used by "),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("s_name")).otherwise(F.concat(F.lit("ACTOR "), F.col("s_suppkey").cast("string"))),
        F.lit(" with "), technique_id(F.col("s_nationkey")), F.lit("."))
    # an order has a handful of lines, so the list is bounded by the data model
    notes = line.join(docs.select("doc_id"), F.col("l_orderkey") == F.col("doc_id"), "left_semi").join(
        sup, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey").agg(
        F.array_join(F.array_sort(F.collect_list(said)), " ").alias("notes"))
    tone = o.select("o_orderkey", "o_orderdate", F.when(
        F.col("o_orderpriority") == "1-URGENT", " The flaw is actively exploited.").otherwise("").alias("tone"))
    rows = docs.join(notes, F.col("doc_id") == F.col("l_orderkey"), "left").join(tone, F.col("doc_id") == F.col("o_orderkey"), "left")
    none = F.array().cast("array<string>")
    return rows.select(
        F.concat(F.lit("https://articles.example.org/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("source_key"), F.concat(F.lit("Article "), F.col("doc_id").cast("string")).alias("title"),
        F.substring("text", 1, 600).alias("summary"),
        F.concat("text", F.lit("\n"), F.coalesce("notes", F.lit("")), F.coalesce("tone", F.lit(""))).alias("full_text"),
        F.lit("news").alias("doc_type"), F.lit(3).alias("tier"), none.alias("authors"), none.alias("categories"),
        F.sha2("text", 256).alias("content_hash"), F.col("o_orderdate").alias("published_at"),
        F.col("o_orderdate").alias("collected_at"))


# ------------------------------------------------------------------------------------ indicators
IPV4_IN_TEXT = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
SHA1_IN_TEXT = r"\b[0-9a-f]{40}\b"


def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents as samples: their three digests, and a family tag from the label table's view of them."""
    docs, labels = load(spark, d, "documents"), load(spark, d, "labels")
    tag = F.when(F.col("toxic") == 1, F.concat(F.lit("Actor "), (F.col("doc_id") % 50).cast("string"), F.lit("stealer"))).when(
        F.col("quality") == 1, F.concat(F.lit("supplier#"), F.lpad((F.col("doc_id") % 50).cast("string"), 9, "0"))).otherwise("n/a")
    return docs.join(labels, "doc_id", "left").select(
        F.sha2("text", 256).alias("sha256_hash"), F.md5("text").alias("md5_hash"), F.sha1("text").alias("sha1_hash"),
        F.lit("n/a").alias("imphash"), tag.alias("signature"), F.col("lang").alias("reporter"), F.lit("txt").alias("file_type_guess"),
        F.lit("text/plain").alias("mime_type"),
        F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n_chars")), "yyyy-MM-dd HH:mm:ss").alias("first_seen_utc"),
        F.struct(F.lit("documents").alias("file"), F.lit(0).cast("long").alias("split"), F.col("doc_id").alias("row")).alias("pos"))


def url_rows(spark: SparkSession, d: str) -> DataFrame:
    """Pages as reported URLs."""
    p = load(spark, d, "pages")
    return p.select(
        "url", F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")), "yyyy-MM-dd HH:mm:ss").alias("dateadded"),
        F.when(F.contains("url", F.lit("?")), "online").otherwise("n/a").alias("url_status"),
        F.lit("malware_download").alias("threat"),
        F.concat(F.lit("elf, "), F.lit("Actor "), (F.col("page_id") % 50).cast("string"), F.lit(",zip")).alias("tags"),
        F.concat(F.lit("https://link.example.org/"), F.col("page_id").cast("string")).alias("urlhaus_link"), F.lit("none").alias("reporter"),
        F.struct(F.lit("pages").alias("file"), F.lit(0).cast("long").alias("split"), F.col("page_id").alias("row")).alias("pos"))


def indicators(spark: SparkSession, d: str) -> DataFrame:
    """Both dumps parsed, merged into an empty table, and their families resolved."""
    from vigil.operators.family import resolve_families
    from vigil.sources.indicators import parse_samples, parse_urls

    batch = parse_samples(sample_rows(spark, d)).good.unionByName(parse_urls(url_rows(spark, d)).good)
    key = ["source_key", "kind", "value_norm"]
    unique = merge.first_wins(batch, key, [F.col("pos")])
    resolved = resolve_families(unique, attack_objects(spark, d), key)
    base = schemas.empty(spark, "indicator")
    return merge.next_snapshot(merge.refresh_indicators(base, resolved, EVENTS_AS_OF))


# ------------------------------------------------------------------------------------ runs
def run_sources(spark: SparkSession, d: str) -> DataFrame:
    """Users of the event log as feeds; how often they are due follows from the id."""
    e = load(spark, d, "events")
    return e.select("user_id").distinct().select(
        F.col("user_id").cast("string").alias("key"), (F.lit(900) * (1 + F.col("user_id") % 4)).cast("int").alias("interval_seconds"),
        (F.col("user_id") % 10 != 0).alias("enabled"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as runs of those feeds; an error event is a failed run."""
    e = load(spark, d, "events")
    failed = F.col("event_type") == "error"
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("user_id").cast("string").alias("source_key"), F.col("ts").alias("started_at"), F.col("ts").alias("finished_at"),
        F.when(failed, "error").otherwise("success").alias("status"), k.alias("items_fetched"), k.alias("items_new"),
        F.lit(0).cast("long").alias("items_updated"), F.lit(0).cast("long").alias("items_malformed"),
        F.col("value").cast("long").alias("duration_ms"), F.when(failed, "failed").alias("error"))


# ------------------------------------------------------------------------------------ raw payload rows
def kev_entries(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue entries as published: untidy ids, markup in names, links inside notes."""
    part = load(spark, d, "part")
    cve, key = cve_of(F.col("p_partkey")), F.col("p_partkey").cast("string")
    return part.select(
        F.when(F.col("p_type") == "SMALL", F.concat(F.lit("CVE-"), key)).otherwise(F.concat(F.lit(" "), F.lower(cve), F.lit(" "))).alias("cveID"),
        F.concat(F.lit("<b>"), "p_brand", F.lit("</b>")).alias("vendorProject"), F.concat("p_name", F.lit("  &amp; co")).alias("product"),
        F.col("p_name").alias("vulnerabilityName"), F.lit("2001-05-06").alias("dateAdded"), F.lit("nothing").alias("shortDescription"),
        F.lit("").alias("requiredAction"), F.lit("").alias("dueDate"), F.lit("Unknown").alias("knownRansomwareCampaignUse"),
        F.concat(F.lit("See https://vendor.example.com/"), key, F.lit(". ; https://nvd.nist.gov/x?ref=y , https://vendor.example.com/"), key).alias("notes"),
        F.array(F.lit("CWE-79"), F.lit("NVD-CWE-noinfo")).alias("cwes"))


def nvd_records(spark: SparkSession, d: str) -> DataFrame:
    """Database records as published: two scores, decision points, one platform row per line number."""
    part = load(spark, d, "part")
    numbers = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("numbers"))
    cvss = ("array<struct<source:string,type:string,baseSeverity:string,cvssData:struct<version:string,vectorString:string,baseScore:double,baseSeverity:string>>>")
    option = "array<struct<exploitation:string,automatable:string,technicalImpact:string>>"
    none = F.lit(None).cast("string")
    score = F.round(F.col("p_size") / 5.0, 1)

    def metric(source: str, kind: str, value: Column, outer: Column, inner: Column) -> Column:
        return F.struct(F.lit(source), F.lit(kind), outer, F.struct(F.lit("3.1"), none, value, inner))

    newer = F.array(metric("cna@example.org", "Primary", F.lit(5.0), none, F.lit("medium")), metric("nvd@nist.gov", "Secondary", score, none, F.lit("high"))).cast(cvss)
    older = F.array(metric("nvd@nist.gov", "Primary", F.lit(7.5), F.lit("low"), none)).cast(cvss)
    text = lambda lang, value: F.struct(F.lit(lang).alias("lang"), value.alias("value"))
    cpe = F.concat(F.lit("cpe:2.3:a:"), "p_brand", F.lit(":"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit(":*:*"))
    matches = F.transform("numbers", lambda i: F.struct(
        (i < 7).alias("vulnerable"), cpe.alias("criteria"), F.concat(i.cast("string"), F.lit(".0")).alias("versionStartIncluding"),
        none.alias("versionStartExcluding"), none.alias("versionEndIncluding"), F.lit("9.0").alias("versionEndExcluding")))
    return part.join(numbers, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        cve_of(F.col("p_partkey")).alias("id"), F.lit("2001-02-03T04:05:06.000").alias("published"), F.lit("2001-02-04T04:05:06.000").alias("lastModified"),
        F.lit("Analyzed").alias("vulnStatus"), F.array(text("fr", F.lit("non")), text("en", F.concat(F.lit("Bug in <i>"), "p_name", F.lit("</i>")))).alias("descriptions"),
        F.struct(F.lit(None).cast(cvss).alias("cvssMetricV40"), F.when(F.col("p_type") != "LARGE", newer).alias("cvssMetricV31"), F.lit(None).cast(cvss).alias("cvssMetricV30"),
                 older.alias("cvssMetricV2"),
                 F.array(F.struct(F.lit("x").alias("source"), F.struct(F.array(F.struct(F.lit("none"), none, none), F.struct(F.lit("POC"), F.lit("Yes"), none)).cast(option).alias("options")).alias("ssvcData"))).alias("ssvcV203"),
                 F.lit(None).cast(f"array<struct<source:string,ssvcData:struct<options:{option}>>>").alias("ssvc")).alias("metrics"),
        F.array(F.struct(F.array(text("en", F.lit("CWE-20")), text("en", F.lit("NVD-CWE-Other")), text("en", F.lit("CWE-20"))).alias("description"))).alias("weaknesses"),
        F.array(F.struct(F.array(F.struct(matches.alias("cpeMatch"))).alias("nodes"))).alias("configurations"),
        F.array(F.struct(F.array(F.struct(F.col("p_brand").alias("vendor"), F.col("p_name").alias("product"), F.array(
            F.struct(F.lit("1.1").alias("version"), F.lit("affected").alias("status")), F.struct(F.lit("2.0").alias("version"), F.lit("unaffected").alias("status")),
            F.struct(F.col("p_size").cast("string").alias("version"), F.lit("affected").alias("status"))).alias("versions"))).alias("affectedData"))).alias("affected"),
        F.array(F.struct(F.concat(F.lit("https://x.example.org/"), F.col("p_partkey").cast("string"), F.lit("?ref=z")).alias("url"),
                         F.array(F.lit("Patch"), F.lit("Vendor Advisory")).alias("tags")), F.struct(F.lit("ftp://no").alias("url"), F.array(F.lit("Patch")).alias("tags"))).alias("references"))


def archive_rows(spark: SparkSession, d: str) -> DataFrame:
    """Returned order lines as rows of an exploit archive; line 7 carries an unusable id."""
    line = load(spark, d, "lineitem").filter(F.col("l_returnflag") == "R").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("part"), F.min("l_shipdate").alias("at"))
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("00"), F.col("l_linenumber").cast("string"))
    none = F.lit(None).cast("string")
    return line.select(
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit("x"), key)).otherwise(key).alias("id"),
        F.concat(F.lit("Overflow in <tt>line</tt> "), key).alias("description"), F.date_format("at", "yyyy-MM-dd").alias("date_published"),
        F.lit("joe").alias("author"), F.lit("remote").alias("type"), F.lit("linux").alias("platform"), F.lit("").alias("date_updated"),
        F.date_format("at", "yyyy-MM-dd").alias("date_added"), F.lit("1").alias("verified"),
        F.concat(cve_of(F.col("part")), F.lit(";OSVDB-1;"), F.lower(cve_of(F.col("part")))).alias("codes"), none.alias("tags"),
        F.struct(F.lit("lineitem").alias("file"), F.col("l_orderkey").alias("split"), F.col("l_linenumber").cast("long").alias("row")).alias("pos"))


REPOSITORY_TEXT = {"AUTOMOBILE": "Sigma hunting rules", "BUILDING": "a mass test tool", "FURNITURE": "payload demo", "HOUSEHOLD": "notes", "MACHINERY": "notes"}


def repository_items(spark: SparkSession, d: str) -> DataFrame:
    """Customers as search hits; owing ones are forks, and one segment was found by a CVE search."""
    c = load(spark, d, "customer")
    cve = cve_of(F.col("c_custkey"))
    by_cve = F.col("c_mktsegment") == "HOUSEHOLD"
    return c.select(
        F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("/tool")).alias("full_name"),
        F.concat(F.lit("https://github.com/user"), F.col("c_custkey").cast("string"), F.lit("/tool")).alias("html_url"),
        F.concat(case(F.col("c_mktsegment"), REPOSITORY_TEXT), F.lit(" for "), F.when(F.col("c_nationkey") < 20, cve).otherwise("all")).alias("description"),
        F.lit("Go").alias("language"), F.col("c_custkey").alias("stargazers_count"), (F.col("c_acctbal") < 0).alias("fork"),
        F.lit("2001-01-01T00:00:00Z").alias("created_at"), F.lit("2001-01-02T00:00:00Z").alias("pushed_at"), F.struct(F.lit("x").alias("login")).alias("owner"),
        F.when(by_cve, cve).alias("searched_cve"))


def release_rows(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as release notes of a watched repository."""
    c = load(spark, d, "conversations")
    tag = F.concat(F.lit("v"), F.col("turn").cast("string"))
    return c.select(
        F.lit("org/tool").alias("repo"), F.concat(F.lit("https://github.com/org/tool/releases/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("html_url"),
        F.when(F.col("role") == "user", "").otherwise(F.concat(F.lit("Release "), tag)).alias("name"), tag.alias("tag_name"), F.col("text").alias("body"),
        F.lit("2001-01-01T00:00:00Z").alias("published_at"))


def attack_objects_text(spark: SparkSession, d: str) -> DataFrame:
    """Objects of a knowledge bundle as JSON text, some of them broken: no JSON, no name, or a list that is a string."""
    nat, reg, sup = load(spark, d, "nation"), load(spark, d, "region"), load(spark, d, "supplier")
    key, no = F.col("n_nationkey"), F.col("s_suppkey") % 10

    def ref(source: str, external: Column) -> Column:
        return F.struct(F.lit(source).alias("source_name"), external.alias("external_id"))

    def phase(chain: str, name: Column) -> Column:
        return F.struct(F.lit(chain).alias("kill_chain_name"), name.alias("phase_name"))

    techniques = nat.join(reg, F.col("n_regionkey") == F.col("r_regionkey")).select(F.to_json(F.struct(
        F.lit("attack-pattern").alias("type"), technique_of(key).alias("id"), F.col("n_name").alias("name"),
        F.concat(F.lit("See [docs](https://docs.example.org/) (Citation: A) on <b>"), "n_name", F.lit("</b>")).alias("description"),
        F.array(phase("mitre-attack", F.lower("r_name")), phase("other", F.lit("no"))).alias("kill_chain_phases"),
        F.array(ref("capec", F.lit("CAPEC-1")), ref("mitre-attack", technique_id(key))).alias("external_references"),
        F.array(F.lit("Linux"), F.lit("Windows")).alias("x_mitre_platforms"), (key % 5 == 0).alias("x_mitre_deprecated"))).alias("text"))
    kind = F.element_at(F.array(*map(F.lit, ("intrusion-set", "malware", "tool", "campaign"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    alias = F.concat(F.lit("Actor "), F.col("s_suppkey").cast("string"))
    base = [kind.alias("type"), actor_of(F.col("s_suppkey")).alias("id"), F.when(no != 9, F.col("s_name")).alias("name"), (no == 4).alias("revoked")]
    actors = sup.select(F.when(no == 7, F.lit('{"type": "malware", ')).when(no == 8, F.to_json(F.struct(*base, alias.alias("aliases")))).otherwise(
        F.to_json(F.struct(*base, F.array("s_name", alias).alias("x_mitre_aliases")))).alias("text"))
    uses = sup.select(F.to_json(F.struct(
        F.lit("relationship").alias("type"), F.concat(F.lit("relationship--"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("uses").alias("relationship_type"),
        actor_of(F.col("s_suppkey")).alias("source_ref"), technique_of(F.col("s_nationkey")).alias("target_ref"), (no == 3).alias("revoked"))).alias("text"))
    others = reg.select(F.to_json(F.struct(F.lit("identity").alias("type"), F.col("r_name").alias("id"))).alias("text")).unionByName(
        reg.select(F.to_json(F.array("r_name")).alias("text")))
    return techniques.unionByName(actors).unionByName(uses).unionByName(others)


def rule_files(spark: SparkSession, d: str) -> DataFrame:
    """A rule file of each customer: (file, text); some have no id, some are lists, some no YAML."""
    key, no = F.col("c_custkey"), F.col("c_custkey") % 10
    number = F.lpad(key.cast("string"), 6, "0")
    whole = F.concat(
        F.lit("title: "), "c_name", F.lit("\n"), F.when(no != 9, F.concat(F.lit("id: rule-"), key.cast("string"), F.lit("\n"))).otherwise(""),
        F.lit("status: Stable\nlevel: HIGH\nlogsource:\n  category: process_creation\n  product: "), F.lower("c_mktsegment"),
        F.lit("\ndetection:\n  condition: selection\n  selection:\n    Image: a.exe\ntags:\n  - attack."), F.lower(technique_id(F.col("c_nationkey"))),
        F.lit("\n  - cve.2000-"), number, F.lit("\n  - attack.impact\n"))
    text = F.when(no == 8, F.lit("title: [open")).when(no == 7, F.lit("- a\n- b\n")).otherwise(whole)
    return load(spark, d, "customer").select(F.concat(F.lit("rules/"), key.cast("string"), F.lit(".yml")).alias("file"), text.alias("text"))


def fleet_changes(fleet_assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(put, gone): one asset in fifty gets another version, one in fifty goes, one in a hundred is also put by a second owner."""
    number = F.regexp_extract("asset_id", r"(\d+)$", 1).cast("long")
    updated = fleet_assets.filter(number % 50 == 1).withColumn("version", F.lit("9.0.0"))
    shared = fleet_assets.filter(number % 100 == 2).withColumns({
        "owner_id": F.concat(F.lit("branch-"), "owner_id"), "environment_id": F.concat(F.lit("env-branch-"), "owner_id")})
    return updated.unionByName(shared), fleet_assets.filter(number % 50 == 0)
