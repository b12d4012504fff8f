"""Parameterised queries: filters, sorts, paging and search."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import vocab
from vigil.functions.binding import let
from vigil.functions.extract import contains_any
from vigil.functions.observable import classify, fold, host_of
from vigil.functions.text import contains_ci
from vigil.operators.link import resolve_attack, subject_key, technique_stix
from vigil.operators.recompute import attack_mentions, focused_mentions

MAX_PAGE_SIZE = 100


class BadRequest(ValueError):
    """A parameter outside its vocabulary; never replaced by a default."""


class Page(NamedTuple):
    total: DataFrame
    items: DataFrame


def window_start(window: str | None, as_of: datetime) -> Column | None:
    """Start of a named window, or None for all time."""
    if not window or window == "all":
        return None
    if window not in vocab.WINDOW_HOURS:
        raise BadRequest(f"window must be one of {sorted(vocab.WINDOW_HOURS)} or 'all'")
    return F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(vocab.WINDOW_HOURS[window]))


def list_contains(col: Column | str, value: str) -> Column:
    """Array membership; null reads as no match."""
    return F.coalesce(F.array_contains(col, value), F.lit(False))


def _any(conditions: list[Column]) -> Column:
    found = F.lit(False)
    for c in conditions:
        found = found | F.coalesce(c, F.lit(False))
    return found


def _matches(columns: list[str], q: str) -> Column:
    return _any([contains_ci(F.col(c), q) for c in columns])


def paginate(rows: DataFrame, order: list[Column], page: int = 1, size: int = 25) -> Page:
    """Total as a one-row frame, and one page in a total order.

    The page is a top-k over offset + size rows, so only that many rows reach the final task.
    """
    if page < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise BadRequest(f"page starts at 1 and size is at most {MAX_PAGE_SIZE}")
    return Page(rows.agg(F.count("*").alias("total")), rows.orderBy(*order).offset((page - 1) * size).limit(size))


def _pick(sorts: dict, name: str) -> list[Column]:
    if name not in sorts:
        raise BadRequest(f"sort must be one of {sorted(sorts)}")
    return sorts[name]()


def _down(name: str) -> Column:
    return F.col(name).desc_nulls_last()


# ------------------------------------------------------------------------------------ vulnerabilities
THREAT_SORTS = {
    "relevance": lambda: [_down("relevance_score"), _down("last_activity_at"), F.col("cve_id")],
    "recent": lambda: [_down("last_activity_at"), F.col("cve_id")],
    "published": lambda: [_down("published"), F.col("cve_id")],
    "cvss": lambda: [_down("cvss_score"), F.col("cve_id")],
    "kev": lambda: [_down("kev_date_added"), F.col("cve_id")],
    "updated": lambda: [_down("updated_at"), F.col("cve_id")],
}


def threat_order(sort: str = "relevance") -> list[Column]:
    return _pick(THREAT_SORTS, sort)


def mentioned_with(edge: DataFrame, stix: DataFrame) -> DataFrame:
    """CVEs in the same focused report as any of the objects; one row per pair of edges."""
    docs = attack_mentions(edge).join(stix.select("stix_id"), "stix_id", "left_semi").select("doc_id").distinct()
    return focused_mentions(edge).join(docs, "doc_id", "left_semi").select("cve_id")


def threats(vulns: DataFrame, as_of: datetime, *, edge: DataFrame | None = None, references: DataFrame | None = None,
            objects: DataFrame | None = None, window: str | None = None, kev: bool = False, exploited: bool = False,
            exploit: bool = False, poc: bool = False, severity: list[str] = (), tag: list[str] = (),
            platform: list[str] = (), vendor: str | None = None, product: str | None = None, q: str | None = None,
            source: str | None = None, actor: str | None = None, technique: str | None = None,
            min_score: int | None = None) -> DataFrame:
    """The vulnerability table under every filter given; unset filters do not constrain."""
    rows, start = vulns, window_start(window, as_of)
    if start is not None:
        rows = rows.filter(F.col("last_activity_at") >= start)
    for on, column in ((kev, "in_kev"), (exploited, "actively_exploited"), (exploit, "has_exploit"), (poc, "has_poc")):
        if on:
            rows = rows.filter(F.col(column))
    if severity:
        rows = rows.filter(F.col("cvss_severity").isin([s.upper() for s in severity]))
    for value in tag:
        rows = rows.filter(list_contains("tags", value))
    for value in platform:
        rows = rows.filter(list_contains("platforms", value))
    if vendor:
        rows = rows.filter(contains_ci(F.col("vendor"), vendor))
    if product:
        rows = rows.filter(contains_ci(F.col("product"), product))
    if min_score is not None:
        rows = rows.filter(F.col("relevance_score") >= min_score)
    if q:
        rows = rows.filter(_matches(["cve_id", "title", "description", "vendor", "product"], q))
    if source:
        from_refs = references.filter(F.col("source_key") == source).select("cve_id")
        from_edges = edge.filter((F.col("object_type") == "cve") & (F.col("source_key") == source)).select(
            F.col("object_id").alias("cve_id"))
        rows = rows.join(from_refs.union(from_edges), "cve_id", "left_semi")
    if actor:
        rows = rows.join(mentioned_with(edge, resolve_attack(objects, actor)), "cve_id", "left_semi")
    if technique:
        stored = F.exists("techniques", lambda t: t["id"] == technique.upper())
        by_list = rows.filter(stored).select("cve_id")
        by_report = mentioned_with(edge, resolve_attack(objects, technique))
        rows = rows.join(by_list.union(by_report), "cve_id", "left_semi")
    return rows


def filter_vendors(vulns: DataFrame, min_score: int = 20, limit: int = 300) -> DataFrame:
    """Vendors offered as filter values."""
    return vulns.filter(F.col("vendor").isNotNull() & (F.col("relevance_score") >= min_score)).select(
        "vendor").distinct().orderBy("vendor").limit(limit)


# ------------------------------------------------------------------------------------ exploits, documents
EXPLOIT_SORTS = {
    "recent": lambda: [_down("published_at"), F.col("external_id")],
    "collected": lambda: [_down("collected_at"), F.col("external_id")],
    "stars": lambda: [_down("stars"), F.col("external_id")],
}


def exploit_order(sort: str = "recent") -> list[Column]:
    return _pick(EXPLOIT_SORTS, sort)


def _subjects(edge: DataFrame, subject_type: str, object_type: str, object_id: Column | str) -> DataFrame:
    return edge.filter(
        (F.col("subject_type") == subject_type) & (F.col("object_type") == object_type)
        & (F.col("object_id") == object_id)).select("subject_id").distinct()


def exploits(table: DataFrame, as_of: datetime, *, edge: DataFrame | None = None, window: str | None = None,
             kind: list[str] = (), source: str | None = None, platform: str | None = None, cve: str | None = None,
             q: str | None = None) -> DataFrame:
    """Exploit rows under the filters given."""
    rows, start = table, window_start(window, as_of)
    if start is not None:
        rows = rows.filter(_any([F.col("published_at") >= start, F.col("collected_at") >= start]))
    if kind:
        rows = rows.filter(F.col("kind").isin(list(kind)))
    if source:
        rows = rows.filter(F.col("source_key") == source)
    if platform:
        rows = rows.filter(contains_ci(F.col("platform"), platform))
    if q:
        rows = rows.filter(_matches(["title", "description", "external_id"], q))
    if cve:
        named = _subjects(edge, "exploit", "cve", F.lit(cve.upper()))
        rows = rows.withColumn("subject_id", subject_key()).join(named, "subject_id", "left_semi").drop("subject_id")
    return rows


def document_order() -> list[Column]:
    return [_down("published_at"), F.col("url")]


def documents(table: DataFrame, as_of: datetime, *, edge: DataFrame | None = None, objects: DataFrame | None = None,
              doc_type: list[str] = (), window: str | None = None, source: str | None = None, tier: list[int] = (),
              cve: str | None = None, actor: str | None = None, exploitation: bool = False,
              q: str | None = None) -> DataFrame:
    """Documents under the filters given."""
    rows, start = table, window_start(window, as_of)
    if start is not None:
        rows = rows.filter(F.col("published_at") >= start)
    if doc_type:
        rows = rows.filter(F.col("doc_type").isin(list(doc_type)))
    if source:
        rows = rows.filter(F.col("source_key") == source)
    if tier:
        rows = rows.filter(F.col("tier").isin(list(tier)))
    if exploitation:
        rows = rows.filter("reports_exploitation")
    if q:
        rows = rows.filter(_matches(["title", "summary"], q))
    if cve:
        named = _subjects(edge, "document", "cve", F.lit(cve.upper()))
        rows = rows.join(named.withColumnRenamed("subject_id", "url"), "url", "left_semi")
    if actor:
        who = resolve_attack(objects, actor).select("stix_id")
        named = attack_mentions(edge).join(who, "stix_id", "left_semi").select(F.col("doc_id").alias("url"))
        rows = rows.join(named, "url", "left_semi")
    return rows


def document_entities(docs: DataFrame, edge: DataFrame, objects: DataFrame) -> DataFrame:
    """CVEs and objects each of ``docs`` mentions; what one text can mention bounds the lists."""
    mentions = edge.filter((F.col("subject_type") == "document") & (F.col("relation") == "mentions")).select(
        F.col("subject_id").alias("url"), "object_type", "object_id").join(docs.select("url"), "url", "left_semi")
    known = objects.select(F.col("stix_id").alias("object_id"), F.lit("attack").alias("object_type"), "obj_type",
                           "name", "external_id")
    rows = mentions.join(known, ["object_type", "object_id"], "left")
    entity = F.struct(F.col("object_id").alias("stix_id"), F.col("obj_type").alias("type"), "name", "external_id")
    return rows.groupBy("url").agg(
        F.array_sort(F.collect_set(F.when(F.col("object_type") == "cve", F.col("object_id")))).alias("cves"),
        F.array_sort(F.collect_set(F.when(F.col("name").isNotNull(), entity))).alias("entities"))


# ------------------------------------------------------------------------------------ text search
_STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or",
               "that", "the", "this", "to", "was", "with"]


def _term_counts(columns: list[str], words: list[str]) -> Column:
    """Occurrences of each word; texts that hold none of them are not cut into words."""
    def counts(terms: Column) -> Column:
        return F.array(*[F.size(terms) - F.size(F.array_remove(terms, w)) for w in words])

    def search(low: Column) -> Column:
        return F.when(contains_any(low, words), let(F.split(low, r"(?U)[^\w]+"), counts))

    return let(F.lower(F.concat_ws(" ", *columns)), search)


def ranked_search(docs: DataFrame, key: str, columns: list[str], q: str, limit: int | None = 10) -> DataFrame:
    """Documents that hold every search word, best first by term and inverse document frequency.

    Query words are few and known up front, so their counts are computed inside each row and only
    the per-word document frequencies are aggregated; the text is never shuffled.
    """
    words = sorted({w for w in q.lower().split() if w not in _STOP_WORDS})
    if not words:
        raise BadRequest("the query has no searchable word")
    rows = docs.select(key, _term_counts(columns, words).alias("_tf"))
    frequency = rows.agg(F.count("*").alias("n"), *[
        F.count_if(F.get("_tf", F.lit(i)) > 0).alias(f"df{i}") for i in range(len(words))])
    corpus = frequency.select(F.struct("*")).scalar()
    has_all = F.col("_tf").isNotNull()
    points = F.lit(0.0)
    for i in range(len(words)):
        count = F.get("_tf", F.lit(i))
        has_all = has_all & (count > 0)
        points = points + (1 + F.log(F.greatest(count, F.lit(1)))) * F.log(1 + F.col("_c.n") / F.greatest(F.col(f"_c.df{i}"), F.lit(1)))
    found = rows.filter(has_all).withColumn("_c", corpus).select(key, F.round(points, 6).alias("rank"))
    found = found.orderBy(F.col("rank").desc(), key)
    return found.limit(limit) if limit else found


def _hits(kind: str, rows: DataFrame, key: Column, title: Column, order: list[Column], limit: int) -> DataFrame:
    best = rows.orderBy(*order).limit(limit)
    return best.select(F.lit(kind).alias("kind"), key.alias("key"), title.alias("title"))


def search(q: str, vulns: DataFrame, docs: DataFrame, exploit_rows: DataFrame, objects: DataFrame,
           limit: int = 10) -> DataFrame:
    """Best hits of each kind in one frame, with a flag when the query is itself a CVE id."""
    import re

    aliases = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: contains_ci(a, q))
    parts = [
        _hits("vulnerability", vulns.filter(_matches(["cve_id", "title", "description", "vendor", "product"], q)),
              F.col("cve_id"), F.col("title"), [_down("relevance_score"), F.col("cve_id")], limit),
        _hits("document", docs.filter(_matches(["title", "summary"], q)), F.col("url"), F.col("title"),
              document_order(), limit),
        _hits("exploit", exploit_rows.filter(_matches(["title", "description", "external_id"], q)), subject_key(),
              F.col("title"), [_down("published_at"), subject_key()], limit),
        _hits("attack", objects.filter(~F.col("revoked") & ~F.col("deprecated") & (
            _matches(["name", "external_id"], q) | aliases)), F.col("stix_id"), F.col("name"), [F.col("stix_id")], limit),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    exact = re.match(vocab.CVE_ID, q.strip().upper())
    return rows.withColumn("exact_cve", F.lit(q.strip().upper() if exact else None).cast("string"))


# ------------------------------------------------------------------------------------ rules
def level_rank(level: Column) -> Column:
    rank = F.lit(-1)
    for i, name in enumerate(vocab.RULE_LEVELS):
        rank = F.when(level == name, F.lit(i)).otherwise(rank)
    return rank


RULE_SORTS = {
    "level_rank": lambda: [level_rank(F.col("level")).desc(), F.col("title"), F.col("external_id")],
    "level": lambda: [F.coalesce("level", F.lit("")).desc(), F.col("title"), F.col("external_id")],
    "title": lambda: [F.col("title"), F.col("external_id")],
    "recent": lambda: [_down("collected_at"), F.col("title"), F.col("external_id")],
}


def rule_order(sort: str = "level_rank") -> list[Column]:
    return _pick(RULE_SORTS, sort)


def tracked_rule_edges(edge: DataFrame, vulns: DataFrame) -> DataFrame:
    """Rule to CVE edges whose CVE has a row here."""
    return edge.filter((F.col("subject_type") == "rule") & (F.col("object_type") == "cve")).select(
        F.col("subject_id").alias("rule_key"), F.col("object_id").alias("cve_id")).join(
        vulns.select("cve_id"), "cve_id", "left_semi")


def rules(table: DataFrame, edge: DataFrame, vulns: DataFrame, objects: DataFrame, *, q: str | None = None,
          level: list[str] = (), status: list[str] = (), technique: str | None = None, cve: str | None = None,
          has_cve: bool = False) -> DataFrame:
    """Detection rules under the filters given."""
    for values, allowed, name in ((level, vocab.RULE_LEVELS, "level"), (status, vocab.RULE_STATUSES, "status")):
        if set(values) - set(allowed):
            raise BadRequest(f"{name} must be one of {sorted(allowed)}")
    rows = table.withColumn("rule_key", subject_key())
    if level:
        rows = rows.filter(F.col("level").isin(list(level)))
    if status:
        rows = rows.filter(F.col("status").isin(list(status)))
    if q:
        rows = rows.filter(_matches(["title", "description"], q))
    if technique:
        wanted = technique_stix(objects, technique).select(F.col("stix_id").alias("object_id"))
        named = edge.filter((F.col("subject_type") == "rule") & (F.col("object_type") == "attack")).join(
            wanted, "object_id", "left_semi").select(F.col("subject_id").alias("rule_key"))
        rows = rows.join(named, "rule_key", "left_semi")
    if cve:
        named = _subjects(edge, "rule", "cve", F.lit(cve.upper()))
        rows = rows.join(named.withColumnRenamed("subject_id", "rule_key"), "rule_key", "left_semi")
    if has_cve:
        rows = rows.join(tracked_rule_edges(edge, vulns), "rule_key", "left_semi")
    return rows.drop("rule_key")


def rule_details(table: DataFrame, edge: DataFrame, objects: DataFrame) -> DataFrame:
    """Rules with the techniques they are tagged with; a rule's own tags bound the list."""
    tagged = edge.filter((F.col("subject_type") == "rule") & (F.col("object_type") == "attack")).select(
        F.col("subject_id").alias("rule_key"), F.col("object_id").alias("stix_id")).join(
        objects.select("stix_id", F.col("external_id").alias("technique"), "name"), "stix_id")
    attack = tagged.groupBy("rule_key").agg(
        F.array_sort(F.collect_list(F.struct(F.col("technique").alias("external_id"), "name", "stix_id"))).alias("attack"))
    return table.withColumn("rule_key", subject_key()).join(attack, "rule_key", "left").drop("rule_key")


# ------------------------------------------------------------------------------------ indicators
def newest_by_host(indicators: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` rows of each host, with ``host_rows``, the number of all its rows.

    The rank filter cuts every map partition to ``limit`` rows per host, and the count is summed
    map-side, so one host that serves a third of all URLs is never gathered.
    """
    hosted = indicators.filter(F.col("host").isNotNull())
    w = Window.partitionBy("host").orderBy(_down("first_seen_at"), "source_key", "kind", "value_norm")
    first = hosted.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")
    return first.join(hosted.groupBy("host").agg(F.count("*").alias("host_rows")), "host")


def lookup(queries: DataFrame, indicators: DataFrame, limit: int = 50) -> DataFrame:
    """Known rows for each observable in ``queries(query)``: newest first, at most ``limit`` shown,
    with the true total. A query without rows stays, with ``found`` false (R16).

    Rows by value and by recorded hash are few for one query. By host a query meets at most ``limit``
    rows, ranked on the indicator side, and the host's count; a row met by value that is on the asked
    host is counted once.
    """
    asked = queries.select("query").distinct().withColumns({
        "asked_kind": classify(F.col("query")), "asked_value": fold(F.col("query")), "asked_host": host_of(F.col("query"))})
    valid = asked.filter(F.col("asked_kind").isNotNull())
    key = ["source_key", "kind", "value_norm"]
    rows = indicators.select(*key, "host", "family", "attack_stix_id", "status", "first_seen_at", "related")
    slim = ["query", *key, "family", "attack_stix_id", "status", "first_seen_at"]
    beside = (~F.coalesce(F.col("host") == F.col("asked_host"), F.lit(False))).cast("long").alias("beside")  # not among the host's own rows
    by_value = valid.join(rows, F.col("asked_value") == F.col("value_norm")).select(*slim, beside)
    hashes = rows.select("*", F.explode(F.array_distinct(F.array_compact(F.array(
        F.try_element_at("related", F.lit("md5")), F.try_element_at("related", F.lit("sha1")))))).alias("other"))
    by_hash = valid.filter(F.col("asked_kind").isin("md5", "sha1")).join(
        hashes, F.col("asked_value") == F.lower("other")).select(*slim, beside)
    by_host = valid.filter(F.col("asked_host").isNotNull()).join(
        newest_by_host(rows, limit), F.col("asked_host") == F.col("host"))
    found = by_value.unionByName(by_hash).unionByName(by_host.select(*slim, F.lit(0).cast("long").alias("beside"))).distinct()
    hosted = by_host.groupBy("query").agg(F.max("host_rows").alias("host_rows"))
    other = found.groupBy("query").agg(F.sum("beside").alias("beside"))
    total = F.coalesce("host_rows", F.lit(0)) + F.coalesce("beside", F.lit(0))
    w = Window.partitionBy("query").orderBy(_down("first_seen_at"), *key)
    shown = found.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)
    answers = asked.select("query", F.col("asked_kind").alias("query_kind")).join(hosted, "query", "left").join(
        other, "query", "left").join(shown.drop("beside"), "query", "left")
    return answers.withColumn("total", total).drop("host_rows", "beside").withColumn("found", F.col("total") > 0)


def indicator_order() -> list[Column]:
    return [_down("first_seen_at"), F.col("source_key"), F.col("value_norm")]


def indicators(table: DataFrame, as_of: datetime, *, kind: list[str] = (), source: str | None = None,
               family: str | None = None, status: str | None = None, has_family: bool = False,
               window: str | None = None) -> DataFrame:
    """Indicators under the filters given."""
    if set(kind) - set(vocab.INDICATOR_KINDS):
        raise BadRequest(f"kind must be one of {sorted(vocab.INDICATOR_KINDS)}")
    if window and window not in ("24h", "7d", "30d", "90d"):
        raise BadRequest("window must be 24h, 7d, 30d or 90d")
    rows, start = table, window_start(window, as_of)
    if kind:
        rows = rows.filter(F.col("kind").isin(list(kind)))
    if source:
        rows = rows.filter(F.col("source_key") == source)
    if family:
        rows = rows.filter(F.lower("family") == family.lower())
    if status:
        rows = rows.filter(F.col("status") == status)
    if has_family:
        rows = rows.filter(F.col("attack_stix_id").isNotNull())
    if start is not None:
        rows = rows.filter(F.col("first_seen_at") >= start)
    return rows


# ------------------------------------------------------------------------------------ attack objects
LISTABLE_TYPES = ["technique", "group", "malware", "tool", "campaign", "mitigation", "tactic", "detection_strategy",
                  "data_component"]


def attack_objects(objects: DataFrame, edge: DataFrame, obj_type: str, *, q: str | None = None,
                   mentioned: bool = False) -> DataFrame:
    """Live objects of one type with their mention counts."""
    from vigil.plans.marts import mention_counts

    if obj_type not in LISTABLE_TYPES:
        raise BadRequest(f"type must be one of {sorted(LISTABLE_TYPES)}")
    rows = objects.filter((F.col("obj_type") == obj_type) & ~F.col("revoked") & ~F.col("deprecated"))
    if q:
        rows = rows.filter(_matches(["name", "external_id", "description"], q))
    if mentioned:
        named = edge.filter(F.col("object_type") == "attack").select(F.col("object_id").alias("stix_id"))
        rows = rows.join(named, "stix_id", "left_semi")
    return rows.join(mention_counts(edge), "stix_id", "left").withColumn(
        "mentions", F.coalesce("mentions", F.lit(0)))


def attack_order(sort: str = "mentions") -> list[Column]:
    return _pick({"name": lambda: [F.col("name"), F.col("stix_id")],
                  "mentions": lambda: [F.col("mentions").desc(), F.col("name"), F.col("stix_id")]}, sort)


# ------------------------------------------------------------------------------------ work queues
def _before(col: str, as_of: datetime, hours: int) -> Column:
    limit = F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(hours))
    return F.col(col).isNull() | (F.col(col) < limit)


def enrichment_queue(vulns: DataFrame, edge: DataFrame, cache: DataFrame, as_of: datetime, limit: int,
                     cache_days: int = 7, recent_days: int = 30, min_score: int = 40) -> DataFrame:
    """CVEs to fetch next: stale important ones by score, then unknown ones mentioned lately."""
    now = F.lit(as_of).cast("timestamp")
    stale = vulns.filter(_before("nvd_fetched_at", as_of, 24 * cache_days)).filter(
        F.col("in_kev") | (F.col("relevance_score") >= min_score)).select(
        "cve_id", F.lit(0).alias("branch"), F.col("relevance_score").alias("score"))
    checked = cache.filter(F.col("fetched_at") >= now - F.make_interval(days=F.lit(cache_days))).select("cve_id")
    unknown = edge.filter(
        (F.col("object_type") == "cve") & (F.col("observed_at") >= now - F.make_interval(days=F.lit(recent_days)))
    ).select(F.col("object_id").alias("cve_id")).distinct().join(vulns.select("cve_id"), "cve_id", "left_anti").join(
        checked, "cve_id", "left_anti").select("cve_id", F.lit(1).alias("branch"), F.lit(0).alias("score"))
    return stale.unionByName(unknown).orderBy("branch", F.col("score").desc(), "cve_id").limit(limit)


def repository_queue(vulns: DataFrame, as_of: datetime, limit: int, recheck_hours: int = 24, min_score: int = 50,
                     recent_days: int = 14, min_cvss: float = 8.0) -> DataFrame:
    """CVEs whose public code should be searched next."""
    recent = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(recent_days))
    worth = _any([F.col("in_kev"), F.col("relevance_score") >= min_score,
                  (F.col("published") >= recent) & (F.col("cvss_score") >= min_cvss)])
    return vulns.filter(_before("repos_checked_at", as_of, recheck_hours) & worth).orderBy(
        _down("relevance_score"), _down("updated_at"), "cve_id").limit(limit)
