"""National vulnerability database pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.text import clip, html_to_text, parse_dt, safe_url, trimmed
from vigil.sources.common import Parsed, require, split_rejects, valid_cve_id

_TEXT = "struct<lang:string,value:string>"
_CVSS = (
    "struct<source:string,type:string,baseSeverity:string,cvssData:struct<version:string,vectorString:string,"
    "baseScore:double,baseSeverity:string>>")
_SSVC = (
    "struct<source:string,ssvcData:struct<options:array<struct<exploitation:string,automatable:string,"
    "technicalImpact:string>>>>")
_MATCH = (
    "struct<vulnerable:boolean,criteria:string,versionStartIncluding:string,versionStartExcluding:string,"
    "versionEndIncluding:string,versionEndExcluding:string>")
_AFFECTED = (
    "struct<affectedData:array<struct<vendor:string,product:string,"
    "versions:array<struct<version:string,status:string>>>>>")
CVE = (
    f"struct<id:string,published:string,lastModified:string,vulnStatus:string,descriptions:array<{_TEXT}>,"
    f"metrics:struct<cvssMetricV40:array<{_CVSS}>,cvssMetricV31:array<{_CVSS}>,cvssMetricV30:array<{_CVSS}>,"
    f"cvssMetricV2:array<{_CVSS}>,ssvcV203:array<{_SSVC}>,ssvc:array<{_SSVC}>>,"
    f"weaknesses:array<struct<description:array<{_TEXT}>>>,"
    f"configurations:array<struct<nodes:array<struct<cpeMatch:array<{_MATCH}>>>>>,"
    f"affected:array<{_AFFECTED}>,references:array<struct<url:string,tags:array<string>>>>")
SCHEMA = f"totalResults long, vulnerabilities array<struct<cve:{CVE}>>"

# fixed value: the database's own metric source
OWN_METRIC_SOURCE = "nvd@nist.gov"


def read_nvd(spark: SparkSession, path: str) -> Parsed:
    pages = spark.read.schema(SCHEMA).json(path, multiLine=True)
    require(pages.filter(F.col("vulnerabilities").isNotNull()), "page has no 'vulnerabilities' list")
    return parse_nvd(pages.select(F.explode("vulnerabilities").alias("v")).select("v.cve.*"))


def pick_cvss(metrics: Column) -> Column:
    """Newest metric family that has entries; in it the database's own score, then a primary one."""
    def best(entries: Column) -> Column:
        ranked = F.transform(entries, lambda e, i: F.struct(
            F.coalesce(e["source"] != OWN_METRIC_SOURCE, F.lit(True)).alias("foreign"),
            F.coalesce(e["type"] != "Primary", F.lit(True)).alias("secondary"),
            i.alias("position"), e.alias("entry")))
        return F.array_min(ranked)["entry"]

    entry = F.coalesce(*[best(metrics[k]) for k in ("cvssMetricV40", "cvssMetricV31", "cvssMetricV30", "cvssMetricV2")])
    data = entry["cvssData"]
    severity = F.upper(F.coalesce(F.when(data["baseSeverity"] != "", data["baseSeverity"]), entry["baseSeverity"]))
    return F.struct(
        data["baseScore"].alias("cvss_score"), F.when(severity != "", severity).alias("cvss_severity"),
        clip(data["vectorString"], 200).alias("cvss_vector"), clip(data["version"], 8).alias("cvss_version"))


def pick_ssvc(metrics: Column) -> Column:
    """Last value seen for each decision point, lowered."""
    entries = F.when(F.size(metrics["ssvcV203"]) > 0, metrics["ssvcV203"]).otherwise(metrics["ssvc"])
    options = F.flatten(F.transform(entries, lambda e: F.coalesce(
        e["ssvcData"]["options"],
        F.array().cast("array<struct<exploitation:string,automatable:string,technicalImpact:string>>"))))

    def last(name: str, n: int) -> Column:
        values = F.filter(F.transform(options, lambda o: o[name]), lambda v: v.isNotNull())
        return clip(F.lower(F.try_element_at(values, F.lit(-1))), n)

    return F.struct(last("exploitation", 16).alias("ssvc_exploitation"),
                    last("automatable", 8).alias("ssvc_automatable"),
                    last("technicalImpact", 16).alias("ssvc_technical_impact"))


def cpe_part(criteria: Column, i: int) -> Column:
    """Vendor (3) or product (4) of a CPE name; '' when the name is too short."""
    pieces = F.split(criteria, ":")
    return F.when(F.size(pieces) > 5, F.replace(F.get(pieces, F.lit(i)), F.lit("_"), F.lit(" "))).otherwise("")


def range_label(m: Column) -> Column:
    """The four bound fields as '>= a > b <= c < d', in that order, skipping absent ones."""
    def bound(field: str, op: str) -> Column:
        return F.when(m[field] != "", F.concat(F.lit(op + " "), m[field]))

    label = F.concat_ws(
        " ", bound("versionStartIncluding", ">="), bound("versionStartExcluding", ">"),
        bound("versionEndIncluding", "<="), bound("versionEndExcluding", "<"))
    return F.when(label != "", label)


_PRODUCT = "array<struct<pos:int,branch:int,vendor:string,product:string,cpe:string,versions:string>>"


def _no_rows(kind: str) -> Column:
    return F.array().cast(kind)


def products_of(configurations: Column, affected: Column) -> Column:
    """Product rows of one record, in order, before duplicates are settled.

    Branch 0 holds the platform names, branch 1 the publisher's own rows.
    """
    matches = F.flatten(F.flatten(F.transform(configurations, lambda c: F.transform(
        F.coalesce(c["nodes"], _no_rows(f"array<struct<cpeMatch:array<{_MATCH}>>>")),
        lambda n: F.coalesce(n["cpeMatch"], _no_rows(f"array<{_MATCH}>"))))))
    matches = F.filter(matches, lambda m: m["vulnerable"] & m["criteria"].isNotNull())
    by_cpe = F.transform(F.coalesce(matches, _no_rows(f"array<{_MATCH}>")), lambda m, i: F.struct(
        i.alias("pos"), F.lit(0).alias("branch"),
        cpe_part(m["criteria"], 3).alias("vendor"),
        cpe_part(m["criteria"], 4).alias("product"),
        m["criteria"].alias("cpe"), range_label(m).alias("versions")))
    item = "struct<vendor:string,product:string,versions:array<struct<version:string,status:string>>>"
    items = F.flatten(F.transform(affected, lambda a: F.coalesce(a["affectedData"], _no_rows(f"array<{item}>"))))

    def listed(x: Column) -> Column:
        hit = F.filter(x["versions"], lambda v: (v["status"] == "affected") & (v["version"] != ""))
        text = F.array_join(F.transform(hit, lambda v: v["version"]), ", ")
        return F.when(text != "", text)

    by_publisher = F.transform(F.coalesce(items, _no_rows(f"array<{item}>")), lambda x, i: F.struct(
        i.alias("pos"), F.lit(1).alias("branch"),
        F.coalesce(trimmed(html_to_text(x["vendor"])), F.lit("")).alias("vendor"),
        F.coalesce(trimmed(html_to_text(x["product"])), F.lit("")).alias("product"),
        F.lit("").alias("cpe"), listed(x).alias("versions")))
    by_publisher = F.filter(by_publisher, lambda p: (p["vendor"] != "") | (p["product"] != ""))
    return F.concat(by_cpe.cast(_PRODUCT), by_publisher.cast(_PRODUCT))


def settle_products(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per (record, vendor, product, cpe): first position; the value of the last platform
    row, or of the first publisher row when no platform row has that key."""
    spot = F.struct("branch", "pos")
    return rows.groupBy(*keys, "vendor", "product", "cpe").agg(
        F.min(spot).alias("spot"),
        F.max_by("versions", F.when(F.col("branch") == 0, F.col("pos"))).alias("_platform"),
        F.min_by("versions", spot).alias("_first"),
        F.min("branch").alias("_branch"),
    ).select(*keys, "vendor", "product", "cpe",
             F.when(F.col("_branch") == 0, F.col("_platform")).otherwise(F.col("_first")).alias("versions"), "spot")


def reference_type(tags: Column) -> Column:
    return (
        F.when(F.array_contains(tags, "Exploit"), "exploit")
        .when(F.array_contains(tags, "Vendor Advisory"), "vendor_advisory")
        .when(F.array_contains(tags, "Patch"), "patch")
        .when(F.array_contains(tags, "Mitigation"), "mitigation")
        .otherwise("reference"))


def parse_nvd(cves: DataFrame) -> Parsed:
    """One row per record with nested ``products`` and ``references`` children."""
    rows = cves.withColumn("_id", valid_cve_id(F.col("id")))
    parsed = split_rejects(rows, "nvd", F.when(F.col("_id").isNull(), "invalid CVE id"), F.col("id"))
    english = F.get(F.filter("descriptions", lambda d: d["lang"] == "en"), F.lit(0))["value"]
    description = html_to_text(english)
    weakness = F.flatten(F.transform("weaknesses", lambda w: F.coalesce(
        w["description"], _no_rows(f"array<{_TEXT}>"))))
    cwes = F.array_distinct(F.filter(F.transform(weakness, lambda d: d["value"]), lambda v: v.startswith("CWE-")))
    refs = F.transform("references", lambda r: F.struct(
        safe_url(r["url"]).alias("url"),
        F.coalesce(r["tags"], _no_rows("array<string>")).alias("tags"),
        reference_type(F.coalesce(r["tags"], _no_rows("array<string>"))).alias("ref_type")))
    refs = F.filter(refs, lambda r: r["url"].isNotNull())
    products = products_of(F.col("configurations"), F.col("affected"))
    good = parsed.good.select(
        F.col("_id").alias("cve_id"),
        F.when(description != "", description).alias("description"),
        clip(F.col("vulnStatus"), 64).alias("vuln_status"),
        parse_dt(F.col("published")).alias("published"),
        parse_dt(F.col("lastModified")).alias("last_modified"),
        F.coalesce(cwes, _no_rows("array<string>")).alias("cwes"),
        pick_cvss(F.col("metrics")).alias("_cvss"), pick_ssvc(F.col("metrics")).alias("_ssvc"),
        products.alias("products"), F.get(products, F.lit(0)).alias("_first"),
        F.coalesce(refs, _no_rows("array<struct<url:string,tags:array<string>,ref_type:string>>")).alias("references"),
    ).select(
        "cve_id", "description", "vuln_status", "published", "last_modified", "cwes", "_cvss.*", "_ssvc.*",
        "products", "references", F.col("_first.vendor").alias("primary_vendor"),
        F.col("_first.product").alias("primary_product"))
    return Parsed(good, parsed.rejects)
