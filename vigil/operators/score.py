"""Threat relevance score with its reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil import vocab
from vigil.functions.extract import contains_any

W = vocab.WEIGHTS
_SECONDS_PER_DAY = 86400


def age_days(as_of: Column, when: Column) -> Column:
    """Whole days elapsed, rounded down; a future date gives a negative age."""
    return F.floor((F.unix_micros(as_of) - F.unix_micros(when)) / F.lit(_SECONDS_PER_DAY * 1e6)).cast("int")


def _first_five(names: Column) -> Column:
    return F.array_join(F.slice(F.array_sort(F.array_distinct(names)), 1, 5), ", ")


def reasons(*, in_kev: Column, evidence: Column, ransomware: Column, exploit_count: Column, poc_count: Column,
            ssvc_poc: Column, actors: Column, tags: Column, internet_facing: Column, cvss_score: Column,
            sources: Column, last_signal: Column, product_count: Column, as_of: Column) -> Column:
    """Every factor that awards points, most points first; ties keep the order below."""
    def factor(when: Column, name: str, points: Column | int, detail: Column | str) -> Column:
        value = F.lit(float(points)) if isinstance(points, int) else F.bround(points, 1)
        text = F.lit(detail) if isinstance(detail, str) else detail
        return F.when(when & (value > 0), F.struct(
            F.lit(name).alias("factor"), value.cast("double").alias("points"), text.alias("detail")))

    def tagged(tag: str) -> Column:
        return F.array_contains(tags, tag)

    age = age_days(as_of, last_signal)
    pocs = F.concat_ws(
        "; ", F.when(poc_count > 0, F.concat(poc_count.cast("string"), F.lit(" public PoC repo(s) (unverified)"))),
        F.when(ssvc_poc, F.lit("CISA SSVC reports public PoC")))
    broad = F.concat(product_count.cast("string"), F.lit(" affected product entries"))
    rows = [
        factor(in_kev, "CISA KEV", W["kev"], "Listed in the CISA Known Exploited Vulnerabilities catalog"),
        factor(F.size(evidence) > 0, "Active exploitation", W["active_exploitation"],
               F.concat(F.lit("Exploitation reported by: "), _first_five(evidence))),
        factor(ransomware, "Ransomware association", W["ransomware"], "Known or reported use in ransomware campaigns"),
        factor(exploit_count > 0, "Public exploit", W["public_exploit"],
               F.concat(exploit_count.cast("string"), F.lit(" public exploit(s) (e.g. Exploit-DB)"))),
        factor((poc_count > 0) | ssvc_poc, "Public PoC", W["public_poc"], pocs),
        factor(F.size(actors) > 0, "Threat actor association", W["threat_actor"],
               F.concat(F.lit("Mentioned alongside: "), _first_five(actors))),
        factor(tagged("rce"), "Remote code execution", W["rce"], "Impact classified as RCE (description/CWE)"),
        factor(tagged("auth_bypass"), "Authentication bypass", W["auth_bypass"],
               "Impact classified as authentication bypass"),
        factor(tagged("privilege_escalation"), "Privilege escalation", W["privilege_escalation"],
               "Impact classified as privilege escalation"),
        factor(internet_facing, "Internet-facing product", W["internet_facing"],
               "Affected product is typically Internet-exposed"),
        factor(cvss_score > 0, "CVSS severity", cvss_score / 10 * W["cvss_max"],
               F.concat(F.lit("CVSS base score "), cvss_score.cast("string"))),
        factor(sources > 1, "Multiple independent sources",
               F.least(F.lit(W["sources_max"]), (sources - 1) * W["sources_per_extra"]).cast("double"),
               F.concat(sources.cast("string"), F.lit(" independent sources"))),
        factor(age <= 7, "Recency", W["recent_7d"],
               F.concat(F.lit("New activity "), F.greatest(age, F.lit(0)).cast("string"), F.lit(" day(s) ago"))),
        factor((age > 7) & (age <= 30), "Recency", W["recent_30d"],
               F.concat(F.lit("New activity "), age.cast("string"), F.lit(" days ago"))),
        factor(product_count >= 20, "Broad impact", W["products_20"], broad),
        factor((product_count >= 5) & (product_count < 20), "Broad impact", W["products_5"], broad),
    ]
    found = F.array_compact(F.array(*rows))
    ranked = F.array_sort(F.transform(found, lambda r, i: F.struct((-r["points"]).alias("p"), i.alias("i"), r.alias("r"))))
    return F.transform(ranked, lambda x: x["r"])


def total(found: Column) -> Column:
    """Sum of points, at most 100, half to even."""
    points = F.aggregate(found, F.lit(0.0), lambda acc, r: acc + r["points"])
    return F.bround(F.least(F.lit(100.0), points), 0).cast("int")


def heuristic_techniques(text: Column, tags: Column, internet_facing: Column) -> Column:
    """Technique ids suggested by impact; ``text`` must be lowered title, description and listed name."""
    def any_tag(*names: str) -> Column:
        return F.arrays_overlap(tags, F.array(*[F.lit(n) for n in names]))

    rce = F.array_contains(tags, "rce")
    rules = [
        ("T1190", internet_facing & any_tag("rce", "auth_bypass", "sqli", "path_traversal")),
        ("T1068", F.array_contains(tags, "privilege_escalation")),
        ("T1203", rce & ~internet_facing & contains_any(text, vocab.CLIENT_SIDE_WORDS)),
        ("T1212", contains_any(text, vocab.CREDENTIAL_WORDS) & any_tag("auth_bypass", "info_disclosure")),
        ("T1211", contains_any(text, vocab.FEATURE_BYPASS_WORDS)),
        ("T1210", rce & ~internet_facing & contains_any(text, vocab.INTERNAL_SERVICE_WORDS)),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(tid)) for tid, rule in rules]))


def merge_techniques(explicit: Column, heuristic: Column) -> Column:
    """Explicit ids win over suggested ones; sorted by id."""
    def as_rows(ids: Column, method: str) -> Column:
        return F.transform(ids, lambda t: F.struct(t.alias("id"), F.lit(method).alias("method")))

    return F.array_sort(F.concat(as_rows(F.array_distinct(explicit), "explicit"),
                                 as_rows(F.array_except(heuristic, explicit), "heuristic")))
