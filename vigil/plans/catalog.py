"""Every registered query: a name and a function of (session, data folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import schemas, vocab
from vigil.functions import extract, observable, text, version
from vigil.operators import family, inventory, link, match, merge, names, recompute
from vigil.plans import corpus, environment, export, marts, profile, queries, textindex
from vigil.plans.stage import FleetStage, Stage, stage
from vigil.session import configure
from vigil.sources import attack, exploit_archive, feed, kev, nvd, repositories, rules
from vigil.sources.common import reject_counts
from vigil.streaming import jobs

AS_OF, EVENTS_AS_OF = corpus.AS_OF, corpus.EVENTS_AS_OF
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[..., DataFrame], **chosen: int) -> Callable[..., DataFrame]:
    """Register ``fn`` under its own name."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(stage(configure(spark), sf_dir), **chosen)

    QUERIES[fn.__name__] = run
    return fn


def ts(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def joined(col: Column | str, sep: str = ",") -> Column:
    return F.array_join(col, sep)


def n(col: str) -> Column:
    return F.col(col).cast("long").alias(col)


def pages(s: Stage) -> DataFrame:
    return corpus.load(s.spark, s.d, "pages")


def documents(s: Stage) -> DataFrame:
    return corpus.load(s.spark, s.d, "documents")


# ------------------------------------------------------------------------------------ text and URLs
@query
def html_text(s):
    """Markup to plain text of every page."""
    return pages(s).select("page_id", text.html_to_text(F.col("html")).alias("text"),
                           text.html_to_text(F.col("html"), 300).alias("excerpt"))


@query
def canonical_url(s):
    """Canonical form and host of every page link."""
    return pages(s).select("page_id", text.safe_url(F.col("url")).alias("url"), observable.host_of(F.col("url")).alias("host"))


@query
def exact_dup_first_wins(s):
    """Of equal texts the first document stays."""
    rows = documents(s).select("doc_id", F.sha2("text", 256).alias("digest"), "source")
    return merge.first_wins(rows, ["digest"], [F.col("doc_id")])


@query
def doc_upsert(s):
    """An older snapshot meets today's documents. German ones are new; toxic-labelled ones changed."""
    labels = corpus.load(s.spark, s.d, "labels").select("doc_id", "toxic")
    docs = documents(s).join(labels, "doc_id", "left")
    none = F.array().cast("array<string>")
    batch = docs.select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("source_key"),
        F.concat(F.lit("Title "), "lang").alias("title"), F.substring("text", 1, 20).alias("summary"),
        F.lit("news").alias("doc_type"), F.lit(3).alias("tier"), none.alias("authors"), none.alias("categories"),
        F.sha2("text", 256).alias("content_hash"), F.lit(None).cast("timestamp").alias("published_at"), "lang", "toxic")
    old = batch.filter(F.col("lang") != "de").withColumns({
        "title": F.lit("Old title"), "published_at": F.lit(corpus.AS_OF).cast("timestamp"),
        "collected_at": F.lit(corpus.AS_OF).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp"),
        "content_hash": F.when(F.coalesce("toxic", F.lit(0)) == 1, "stale").otherwise(F.col("content_hash"))}).drop("lang", "toxic")
    merged = merge.upsert_documents(old, batch.drop("lang", "toxic"), EVENTS_AS_OF)
    return merged.select("url", "title", "content_hash", "change", ts("published_at").alias("published_at"),
                         ts("collected_at").alias("collected_at"), ts("updated_at").alias("updated_at"))


# ------------------------------------------------------------------------------------ extraction and edges
@query
def entity_edges(s):
    """Everything the articles name, from their whole text."""
    return s["article_edge"].select("subject_id", "object_type", "object_id", "relation", "method", "confidence", "source_key",
                                    ts("observed_at").alias("observed_at"))


@query
def edge_evidence(s):
    """The text around each CVE that an article names."""
    return s["article_edge"].filter((F.col("object_type") == "cve") & (F.col("relation") == "mentions")).select("subject_id", "object_id", "evidence")


@query
def dictionary_hits(s):
    """How many articles name each actor, whichever spelling they use."""
    table = names.build_names(s["attack_object"])
    hits = names.find_names(s["article"].select("url", "full_text"), ["url"], "full_text", table)
    rows = hits.select("url", F.explode_outer("hits").alias("hit")).join(table, F.lower("hit") == F.col("low"))
    return rows.select("url", "stix_id").distinct().groupBy("stix_id").agg(F.count("*").alias("articles"))


@query
def impact_tags(s):
    """Impact and platform tags of every document, with label flags as weakness ids."""
    labels = corpus.load(s.spark, s.d, "labels")
    cwes = F.array_compact(F.array(F.when(F.col("toxic") == 1, F.lit("CWE-89")), F.when(F.col("quality") == 0, F.lit("CWE-22")),
                                   F.when(F.col("quality") == 1, F.lit("CWE-400"))))
    docs = documents(s).join(labels, "doc_id", "left")
    return docs.select("doc_id", joined(extract.classify_impact(F.col("text"), cwes)).alias("tags"),
                       joined(extract.classify_platforms(F.col("text"))).alias("platforms"),
                       extract.internet_facing(F.col("text")).alias("exposed"))


@query
def co_mention(s):
    """Focused reports that name both a CVE and an object."""
    rows = recompute.co_mentioned(s["edge"], s["attack_object"])
    return rows.groupBy("cve_id", "stix_id").agg(F.count("*").alias("reports"))


@query
def mention_counts(s):
    """Distinct documents per object."""
    return marts.mention_counts(s["edge"])


@query
def trending(s):
    """A4: most mentioned objects of the last year."""
    return marts.trending(s["edge"], s["attack_object"], queries.window_start("1y", AS_OF))


@query
def exploit_edges(s):
    """Public code to the CVEs it targets."""
    return link.exploit_edges(s["exploit"]).select("subject_id", "object_id", "confidence", "evidence")


@query
def rule_edges(s):
    """Rules to techniques and CVEs from their tags."""
    techniques = names.build_techniques(s["attack_object"])
    return link.rule_edges(s["rule"], techniques).select("subject_id", "object_type", "object_id", "evidence")


@query
def edge_insert(s):
    """Edges found again are not written twice. The second batch repeats every article edge with other evidence."""
    first = s["article_edge"]
    again = first.withColumn("evidence", F.lit("again")).unionByName(
        first.withColumns({"relation": F.lit("revisited"), "evidence": F.lit("again")}))
    merged = link.add_edges(first, again)
    return merged.groupBy("relation", (F.col("evidence") == "again").alias("rewritten")).agg(F.count("*").alias("edges"))


# ------------------------------------------------------------------------------------ merge and score
@query
def vulnerability_merge(s):
    """One row per CVE from both catalogues."""
    return s["vulnerability"].select(
        "cve_id", "title", "description", "vendor", "product", "cvss_score", "cvss_severity", joined("cwes").alias("cwes"), "in_kev",
        "kev_name", F.col("kev_date_added").cast("string").alias("kev_date_added"), "kev_ransomware", ts("published").alias("published"),
        "ssvc_exploitation")


@query
def track_new(s):
    """Unknown records are taken up only when published late enough; known ones always update."""
    listed = merge.next_snapshot(merge.apply_kev(schemas.empty(s.spark, "vulnerability"), corpus.kev_batch(s.spark, s.d), AS_OF))
    from datetime import datetime

    merged = merge.apply_nvd(listed, corpus.nvd_batch(s.spark, s.d), AS_OF, track_after=datetime(1995, 3, 1))
    return merged.select("cve_id", "change", "title", ts("updated_at").alias("updated_at"))


@query
def source_references(s):
    """The reference links of every CVE, first write wins."""
    return s["reference"].select("cve_id", "source_key", "url", "ref_type", "title")


@query
def relevance_score(s):
    """Derived flags, counts and score of every CVE."""
    return s["scored"].select(
        "cve_id", n("relevance_score"), "actively_exploited", n("exploit_count"), n("poc_count"), "has_exploit", "has_poc",
        n("source_count"), n("product_count"), ts("last_activity_at").alias("last_activity_at"), joined("tags").alias("tags"),
        joined("platforms").alias("platforms"))


@query
def score_reasons(s):
    """Reasons in order, as text."""
    rows = F.transform("relevance_reasons", lambda r: F.concat_ws(
        "|", r["factor"], r["points"].cast("decimal(5,1)").cast("string"), r["detail"]))
    return s["scored"].select("cve_id", joined(rows, " ; ").alias("reasons"))


@query
def technique_list(s):
    """Explicit and suggested techniques of every CVE."""
    return s["scored"].select("cve_id", joined(F.transform("techniques", lambda t: F.concat_ws(":", t["id"], t["method"]))).alias("techniques"))


def recompute_touched(s, min_score=60):
    """All that the periodic recompute covers derived again and put in place; the table is that of the full job, row by row."""
    keys = recompute.maintenance_keys(s["scored"], AS_OF, min_score=min_score)
    rows = recompute.replace_rows(s["scored"], recompute.recompute(s.corpus(False), AS_OF, only=keys))
    return rows.select("cve_id", n("relevance_score"), n("source_count"))


query(recompute_touched, min_score=30)  # the score from which the original job recomputes


@query
def maintenance_keys(s):
    """What the periodic recompute covers."""
    return recompute.maintenance_keys(s["scored"], AS_OF, min_score=60)


@query
def relink_edges(s):
    """Stored edges of an older dictionary against a new extraction. Some actors were not known then, some are not any more."""
    every = lambda c, k: F.coalesce(F.regexp_extract(c, r"^actor--(\d+)$", 1).try_cast("bigint") % k == 0, F.lit(False))
    stored = s["article_edge"].filter(~every("object_id", 5))
    present = s["attack_object"].filter(~every("stix_id", 7))
    found = link.relink(s["article"], stored, names.build_name_table(present), rebuild=True)
    return found.diff.select("subject_id", "object_type", "object_id", "relation", "change")


@query
def risk_bands(s):
    """Reader label of each score."""
    return s["scored"].groupBy(text.risk_band(F.col("relevance_score")).alias("band")).agg(F.count("*").alias("cves"))


@query
def short_labels(s):
    """The one-line label of each CVE."""
    return s["scored"].select("cve_id", text.short_label(F.when(F.col("in_kev"), F.col("title")), F.col("tags"), F.col("platforms")).alias("label"))


# ------------------------------------------------------------------------------------ inventory
@query
def version_match(s):
    """V1-V5, M1-M4: verdict of every asset and CVE."""
    return s["match"].select("owner_id", "asset_id", "cve_id", "state", "method", "confidence", "evidence", n("exposure"))


@query
def rematch_changed(s):
    """M4: recomputing about one in a hundred assets and CVEs leaves the same table, row by row."""
    changed = s["asset"].filter(F.pmod(F.crc32("asset_id"), F.lit(100)) == 0)
    cves = s["vulnerability"].filter(F.pmod(F.crc32("cve_id"), F.lit(100)) == 0).select("cve_id")
    rows = match.rematch(s["match"], s["asset"], s["product"], s["vulnerability"], changed, cves)
    return rows.select("owner_id", "asset_id", "cve_id", "state", "method", "confidence", "evidence", n("exposure"))


@query
def asset_counts(s):
    """M9: matches per asset and state, empty assets included."""
    return environment.counts_by_asset(s["asset"], s["match"]).drop("environment_id")


@query
def environment_totals(s, owner="SMALL"):
    """M8, M9: distinct reaching CVEs of one environment."""
    mine = inventory.owned(s["asset"], owner)
    return environment.environment_total(mine, environment.scoped(s.matches_of(owner), owner, f"env-{owner}"))


@query
def verdict_split(s):
    """Distinct CVEs per verdict."""
    return environment.verdict_split(s.cve_states()).select(n("position"), "state", "label", "count")


@query
def exposure_by_cve(s):
    """Strongest exposure per CVE."""
    return environment.exposure_by_cve(s.cve_states()).select("cve_id", n("exposure"))


@query
def environment_threats(s, owner="SMALL"):
    """The threat table of one environment with its verdicts, first page."""
    mine = s.keep(environment.scoped(s.matches_of(owner), owner, f"env-{owner}"))
    rows = environment.environment_threats(s.scored_of(mine), mine, AS_OF, min_score=1)
    page = queries.paginate(rows, environment.environment_order(), 1, 50).items
    return page.select("cve_id", n("relevance_score"), "state", n("exposure"), "evidence")


@query
def reaching_severity(s, owner="SMALL"):
    """Severity of what reaches an environment."""
    return environment.reaching_severity(environment.scoped(s.matches_of(owner), owner, f"env-{owner}"), s.plan("scored")).select("severity", "count")


@query
def environment_figures(s):
    """The figures of all environments together."""
    return environment.figures(s.cve_states(), s.plan("scored"), s.plan("edge"))


@query
def environment_documents(s, owner="SMALL"):
    """Newest documents that reach an environment."""
    rows = environment.documents_for(environment.scoped(s.matches_of(owner), owner, f"env-{owner}"), s.plan("edge"), s.plan("document"))
    return rows.select("url", ts("published_at").alias("published_at"), joined("cves").alias("cves"))


@query
def environment_header(s, owner="LARGE"):
    """Matches per state of one environment."""
    return environment.header(s["asset"], environment.scoped(s.matches_of(owner), owner, f"env-{owner}"), owner, f"env-{owner}")[1].select("state", "count")


@query
def versions_by_product(s):
    """Versions named for every product, newest first."""
    return environment.versions_by_product(s["product"], 60).select("vendor", "product", "version", n("position"))


@query
def versions_by_product_all(s):
    """All versions named for every product."""
    return environment.versions_by_product(s["product"]).select("vendor", "product", "version", n("position"))


@query
def catalogue(s):
    """Product spellings by number of rows."""
    return environment.catalogue(s["product"], "RING", 20)


@query
def environment_csv(s):
    """Report cells of all matches."""
    return export.environment_csv(export.environment_report(s["match"], s["asset"], s["scored"]))


def over_fleet(fn: Callable[..., DataFrame], name: str | None = None, **chosen: str) -> None:
    """Register ``fn`` over every part as an asset, under ``name`` or once more as a query of the fleet."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(FleetStage(stage(configure(spark), sf_dir)), **chosen)

    QUERIES[name or f"{fn.__name__}_fleet"] = run


for each in (version_match, rematch_changed, asset_counts, verdict_split, exposure_by_cve, environment_figures, environment_csv):
    over_fleet(each)
for each in (environment_totals, environment_threats, reaching_severity, environment_documents, environment_header):
    over_fleet(each, owner="site-0")


# ------------------------------------------------------------------------------------ parameterised queries
def changed_fleet(s: Stage) -> inventory.Inventory:
    puts, gone = corpus.fleet_changes(s["fleet"])
    return inventory.change_assets(inventory.Inventory(s["fleet"], s.plan("fleet_match")), puts, gone, s["product"], s["vulnerability"])


@query
def asset_put_delete(s):
    """M6: the inventory after a set of puts and deletes; ids that two owners use stay apart."""
    return changed_fleet(s).assets.select("owner_id", "environment_id", "asset_id", "product", "version")


def match_list(s):
    """M7: the matches after the same change set, whose products are the fleet's."""
    rows = environment.list_matches(changed_fleet(s).matches, ["affected", "possibly_affected"])
    return rows.select("owner_id", "asset_id", "cve_id", "state", "method", "confidence", "evidence", n("exposure"))


over_fleet(match_list, "match_list")


@query
def threat_filter(s):
    """Several filters together."""
    rows = queries.threats(
        s["scored"], AS_OF, edge=s["edge"], references=s["reference"], objects=s["attack_object"], window="1y", exploited=True,
        severity=["high", "critical", "medium"], q="in ", source="unit42", technique="T1003", min_score=20)
    return rows.select("cve_id", n("relevance_score"))


@query
def threat_actor_filter(s):
    """CVEs reported together with an actor found by its name, with a tag and a vendor filter."""
    rows = queries.threats(s["scored"], AS_OF, edge=s["edge"], objects=s["attack_object"], actor="Supplier#000000003",
                           tag=["auth_bypass"], vendor="brand#1", poc=True)
    return rows.select("cve_id", "vendor")


@query
def threat_page(s):
    """Second page by relevance."""
    page = queries.paginate(marts.vulnerability_rows(s["scored"]), queries.threat_order("relevance"), 2, 25).items
    return page.select("cve_id", "title", "severity", n("relevance_score"))


@query
def actor_cves(s):
    """CVE mentions in focused reports of one actor, repeats kept."""
    who = link.resolve_attack(s["attack_object"], "ACTOR--3".lower())
    return queries.mentioned_with(s["edge"], who)


@query
def exploit_filter(s):
    """Newest public code of one kind."""
    rows = queries.exploits(s["exploit"], AS_OF, window="1y", kind=["poc"], platform="MULTI", q="code")
    return rows.orderBy(*queries.exploit_order()).limit(40).select("external_id", "kind", ts("published_at").alias("published_at"))


@query
def document_filter(s):
    """Bulletins of a type, tier and window that contain a word."""
    rows = queries.documents(s["document"], AS_OF, doc_type=["research", "news"], window="90d", tier=[2], q="bulletin")
    return rows.select("url", "source_key", "title")


@query
def document_entities(s):
    """What each recent bulletin mentions."""
    docs = queries.documents(s["document"], AS_OF, window="1y")
    rows = queries.document_entities(docs, s["edge"], s["attack_object"])
    return rows.select("url", joined("cves").alias("cves"),
                       joined(F.transform("entities", lambda e: F.concat_ws("/", e["type"], e["name"]))).alias("entities"))


@query
def search(s):
    """Global search."""
    return queries.search("bolt", s["scored"], s["document"], s["exploit"], s["attack_object"])


@query
def ranked_search(s):
    """Best documents for two words, over whole texts."""
    return queries.ranked_search(documents(s), "doc_id", ["text"], "the inon", limit=50)


PHRASES = '"of the" that -die OR "de la" -que OR eneau'


@query
def phrase_search(s):
    """Phrases, alternatives and unwanted words over the stored index; texts are not read."""
    return textindex.search(s["posting"], PHRASES).select(F.col("key").alias("doc_id"), "hits")


@query
def unwanted_search(s):
    """Documents without a word."""
    keys = documents(s).select(F.col("doc_id").alias("key"))
    return textindex.search(s["posting"], "-the", keys).select(F.col("key").alias("doc_id"), "hits")


# ------------------------------------------------------------------------------------ row shapes
@query
def document_rows(s):
    """Documents with the name, type and tier of their source."""
    return marts.document_rows(s["document"]).select("url", "title", "summary", "doc_type", n("tier"), "source", "source_type", n("source_tier"))


@query
def exploit_rows(s):
    """Exploits with their source, community code with a warning."""
    return marts.exploit_rows(s["exploit"]).select("external_id", "kind", "source", "source_type", n("source_tier"), "warning")


@query
def attack_rows(s):
    """Knowledge objects with the number of reports that name them."""
    counts = marts.mention_counts(s["edge"])
    return marts.attack_rows(s["attack_object"], counts).select("stix_id", "external_id", F.col("type"), "name", "description", n("mentions"))


@query
def indicator_rows(s):
    """Indicators as they are shown."""
    return marts.indicator_rows(s["indicator"]).select("source_key", "kind", "host", "family", "attack_stix_id", "status")


@query
def rule_rows(s):
    """Rules as they are shown."""
    return marts.rule_rows(s["rule"]).select("external_id", "title", "level", "status", joined("cve_ids").alias("cves"), "source_key")


# ------------------------------------------------------------------------------------ streams over the events
def events(s: Stage) -> DataFrame:
    kept = corpus.load(s.spark, s.d, "events").schema
    folder = f"{s.d.rstrip('/')}/events.parquet"
    reader = s.spark.readStream.schema(kept)
    # a table may be one file, which a stream can only find in its folder
    one_file = s.spark._jvm.org.apache.hadoop.fs.Path(folder)
    if one_file.getFileSystem(s.spark._jsc.hadoopConfiguration()).getFileStatus(one_file).isFile():
        rows = reader.option("pathGlobFilter", "events.parquet").parquet(s.d)
    else:
        rows = reader.parquet(folder)
    return rows.withColumns({"actively_exploited": F.col("event_type") == "error", "in_kev": F.col("event_type") == "purchase"})


@query
def stream_pulse(s):
    """Daily counts as a stream emits them, days that the watermark has closed."""
    return s.streamed(jobs.daily_pulse(events(s), "ts")).select(F.col("day").cast("string").alias("day"), "total", "exploited", "kev")


@query
def stream_first_seen(s):
    """Each user once."""
    return s.streamed(jobs.first_seen(events(s), ["user_id"], "ts").select("user_id"))


@query
def window_trend(s):
    """Two adjacent days of each event type."""
    return s.streamed(jobs.window_trend(events(s), "ts", ["event_type"])).select("event_type", ts("start").alias("start"), "before", "now", "trend")


@query
def rule_filter(s):
    """Rules of a level that name a tracked CVE."""
    rows = queries.rules(s["rule"], s["edge"], s["scored"], s["attack_object"], level=["high", "critical"], status=["experimental"],
                         q="customer", has_cve=True)
    return rows.select("external_id", "title", "level", "status")


@query
def rule_by_technique(s):
    """Rules tagged with a technique."""
    return queries.rules(s["rule"], s["edge"], s["scored"], s["attack_object"], technique="T1003").select("external_id", "level")


@query
def rule_details(s):
    """Each rule with its techniques."""
    rows = queries.rule_details(s["rule"], s["edge"], s["attack_object"])
    return rows.select("external_id", joined("tags").alias("tags"), joined(F.transform("attack", lambda a: a["external_id"])).alias("attack"))


@query
def attack_objects(s):
    """Groups by mentions."""
    rows = queries.attack_objects(s["attack_object"], s["edge"], "group", mentioned=True)
    return rows.select("stix_id", "name", "mentions")


@query
def enrichment_queue(s):
    """What to fetch next. Records without a severity count as never fetched, listed CVEs of one type stay unknown; unknown ones
    that the cache answered within a week, also with 'not found', are left out."""
    v = s["scored"].filter(~F.col("cvss_severity").eqNullSafe("LOW")).withColumn(
        "nvd_fetched_at", F.when(F.col("cvss_severity").isNotNull(), F.col("nvd_fetched_at")))
    asked = corpus.load(s.spark, s.d, "orders").select(
        corpus.cve_of(F.col("o_custkey")).alias("cve_id"), F.col("o_orderstatus").alias("payload"), (F.col("o_orderkey") % 3 > 0).alias("found"),
        (F.lit(AS_OF).cast("timestamp") - F.make_interval(days=(F.col("o_orderkey") % 200).cast("int"))).alias("fetched_at"))
    cache = merge.put_payloads(schemas.empty(s.spark, "payload_cache"), asked)
    return queries.enrichment_queue(v, s["edge"], cache, AS_OF, 1000).select("cve_id", n("branch"), n("score"))


@query
def repository_queue(s):
    """Whose public code to search next."""
    return queries.repository_queue(s["scored"], AS_OF, 40, min_score=80).select("cve_id", n("relevance_score"))


@query
def filter_vendors(s):
    """Vendors offered as filter values."""
    return queries.filter_vendors(s["scored"])


# ------------------------------------------------------------------------------------ indicators
@query
def indicator_table(s):
    """Both dumps merged."""
    return s["indicator"].select(
        "source_key", "kind", "value_norm", "host", "family", "attack_stix_id", "status", joined("tags").alias("tags"), "reporter",
        F.try_element_at("related", F.lit("md5")).alias("md5"), F.try_element_at("related", F.lit("sha1")).alias("sha1"),
        ts("first_seen_at").alias("first_seen_at"))


@query
def family_resolve(s):
    """Every distinct family spelling and the software it resolves to."""
    rows = s["indicator"].select(F.explode(F.array_compact(F.array_union("tags", F.array("family")))).alias("candidate"))
    return family.resolve_names(rows, "candidate", s["attack_object"])


@query
def observables(s):
    """Addresses and digests named in the documents' whole text, by kind."""
    found = F.array_union(F.regexp_extract_all("text", F.lit(corpus.IPV4_IN_TEXT), F.lit(0)),
                          F.regexp_extract_all("text", F.lit(corpus.SHA1_IN_TEXT), F.lit(0)))
    rows = documents(s).select("doc_id", F.explode_outer(found).alias("token"))
    return rows.filter(F.col("token").isNotNull()).select("token", observable.classify(F.col("token")).alias("kind"), "doc_id").distinct().groupBy("token", "kind").agg(
        F.count("*").alias("docs"))


@query
def indicator_lookup(s):
    """Every document's SHA-1 and every page host looked up."""
    asked = documents(s).select(F.sha1("text").alias("query")).union(
        pages(s).select(observable.host_of(F.col("url")).alias("query")))
    rows = queries.lookup(asked, s["indicator"])
    return rows.select("query", "query_kind", "found", n("total"), n("position"), "value_norm")


@query
def indicator_filter(s):
    """Online URLs with a known family."""
    rows = queries.indicators(s["indicator"], EVENTS_AS_OF, kind=["url"], status="online", has_family=True, window="90d")
    return rows.select("value_norm", "family")


@query
def indicator_overview(s):
    """Indicator totals by kind, by source and overall."""
    rows = marts.indicator_overview(s["indicator"])
    return rows.select("facet", "value", n("rows"), n("resolved"), n("families"), n("online"), ts("newest").alias("newest"))


# ------------------------------------------------------------------------------------ aggregates
@query
def overview_cards(s):
    """A1, A2: headline counts of the last year."""
    return marts.overview("1y", AS_OF, *[s.plan(t) for t in ("scored", "exploit", "document", "edge", "attack_object", "rule")])


@query
def top_threats(s):
    """A3: ten most relevant CVEs of the last year."""
    return marts.top_threats(s["scored"], queries.window_start("1y", AS_OF)).select("cve_id", n("relevance_score"))


@query
def latest_exploits(s):
    """A3: newest public code."""
    return marts.latest(s["exploit"], "collected_at", "external_id").select("external_id", ts("collected_at").alias("collected_at"))


@query
def pulse(s):
    """A5: daily activity, gap-filled."""
    return marts.pulse(s["scored"], AS_OF, 90).select(F.col("day").cast("string").alias("day"), "total", "exploited", "kev", "peak")


@query
def busiest_day(s):
    """The day with most activity."""
    return marts.busiest_day(marts.pulse(s["scored"], AS_OF, 90)).select(F.col("day").cast("string").alias("day"), "total")


@query
def severity_mix(s):
    """Severity classes of the whole corpus."""
    return marts.severity_mix(s.plan("scored")).select("severity", "count")


@query
def arrivals(s):
    """Severity of what arrived lately."""
    start = F.lit(AS_OF).cast("timestamp") - F.make_interval(years=F.lit(6))
    return marts.severity_mix(s.plan("scored"), start).select("severity", "count")


@query
def detection_overview(s):
    """Rule coverage."""
    return marts.detection_overview(*[s.plan(t) for t in ("rule", "edge", "scored")])


@query
def source_health(s):
    """Run facts and health of every feed."""
    state = marts.source_state(corpus.run_sources(s.spark, s.d), corpus.runs(s.spark, s.d))
    rows = marts.source_health(state, EVENTS_AS_OF)
    return rows.select("key", "health", "last_status", ts("last_attempt").alias("last_attempt"),
                       ts("last_successful_fetch").alias("last_successful_fetch"), n("consecutive_failures"), n("items_fetched"))


@query
def backoff(s):
    """Waiting time after failures and whether a feed is due."""
    state = marts.source_state(corpus.run_sources(s.spark, s.d), corpus.runs(s.spark, s.d))
    failures, interval = F.col("consecutive_failures"), F.col("interval_seconds")
    return state.select("key", marts.backoff_seconds(failures, interval).cast("long").alias("wait"),
                        marts.due_for_run(failures, interval, F.col("last_attempt"), EVENTS_AS_OF).alias("due"))


@query
def run_history(s):
    """Latest ten runs of every feed."""
    return marts.run_history(corpus.runs(s.spark, s.d), 10).select("source_key", n("position"), "status", ts("started_at").alias("started_at"))


@query
def last_runs(s):
    """Last run of every feed."""
    return marts.last_runs(corpus.runs(s.spark, s.d)).select("source_key", ts("last_run").alias("last_run"))


@query
def table_counts(s):
    """Rows of the canonical tables."""
    tables = {"vulnerability": "scored", "exploit": "exploit", "document": "document", "attack_object": "attack_object", "edge": "edge"}
    return marts.table_counts({name: s.plan(table) for name, table in tables.items()})


# ------------------------------------------------------------------------------------ attack knowledge
@query
def tactic_matrix(s):
    """Techniques under tactics by mentions."""
    return marts.tactic_matrix(s["attack_object"], s["edge"]).select("tactic", "tactic_name", n("tactic_order"), "external_id", "mentions", n("position"))


@query
def related_objects(s):
    """Relationships in both directions."""
    return marts.related_objects(s["attack_object"], s["relationship"]).select("stix_id", "section", "other", "other_name", "how")


@query
def entity_documents(s):
    """Newest bulletins of every object."""
    return marts.entity_documents(s["edge"], s["document"], 25).select("stix_id", "url", n("position"))


@query
def entity_documents_all(s):
    """All bulletins of every object."""
    return marts.entity_documents(s["edge"], s["document"]).select("stix_id", "url", n("position"))


@query
def entity_vulnerabilities(s):
    """Highest-scored CVEs of every object."""
    rows = marts.entity_vulnerabilities(s["edge"], s["attack_object"], s["scored"], 50)
    return rows.select("stix_id", "cve_id", n("relevance_score"), n("position"))


@query
def entity_vulnerabilities_all(s):
    """All CVEs of every object."""
    rows = marts.entity_vulnerabilities(s["edge"], s["attack_object"], s["scored"])
    return rows.select("stix_id", "cve_id", n("relevance_score"), n("position"))


@query
def technique_detections(s):
    """Strategies, analytics and log sources of every technique."""
    return marts.technique_detections(s["attack_object"], s["relationship"]).select(
        "technique", "strategy_id", "analytic_id", n("log_pos"), "log_name", "component_name")


@query
def technique_mitigations(s):
    """Mitigations of every technique."""
    return marts.technique_mitigations(s["attack_object"], s["relationship"]).select("technique", "mitigation", "name")


# ------------------------------------------------------------------------------------ profile and exports
@query
def profile_sections(s):
    """Number of facts per CVE and section of the profile mart."""
    return profile.profile(s.corpus()).groupBy("cve_id", "section").agg(F.count("*").alias("facts"))


@query
def timeline(s):
    """Dated events of every CVE."""
    return profile.timeline(s.corpus()).select("cve_id", "kind", "title", "source", ts("at").alias("event_at"), "url")


@query
def source_table(s):
    """Provenance rows of every CVE."""
    c = s.corpus_once()
    rows = profile.source_table(c, profile.cve_documents(c), profile.cve_exploits(c))
    return rows.select("cve_id", "kind", "source", n("tier"), "url")


@query
def publishers(s):
    """Distinct publishers of every CVE."""
    c = s.corpus_once()
    rows = profile.source_table(c, profile.cve_documents(c), profile.cve_exploits(c))
    return marts.publishers(rows).select("cve_id", "source", n("tier"), "url")


@query
def evidence_fragments(s):
    """Numbered evidence of every CVE, the first fragments."""
    rows = profile.evidence_fragments(s.corpus(), limit=20, articles=8, technique_rows=5, chars=1500, technique_chars=600)
    return rows.select("cve_id", n("number"), "text", "source", n("tier"))


@query
def evidence_fragments_all(s):
    """All numbered evidence of every CVE, texts whole."""
    return profile.evidence_fragments(s.corpus()).select("cve_id", n("number"), "text", "source", n("tier"))


@query
def evidence_csv(s):
    """Flat evidence list of every CVE."""
    return export.evidence_csv(profile.paired(s.corpus(), s.keep, told=False))


@query
def cve_json(s):
    """The JSON documents of every CVE, whole, read back fact by fact."""
    facts = export.read_json_facts(export.cve_json(profile.paired(s.corpus(), s.keep), s.keep))
    return facts.select("cve_id", n("part"), "section", n("number"), "kind", "title", "source", n("tier"), F.col("at").alias("event_at"), "url", "detail")


@query
def cve_json_heads(s):
    """Overview, CVSS, SSVC and KEV objects of every JSON document."""
    docs = export.cve_json(profile.paired(s.corpus(), s.keep), s.keep)
    wanted = ["overview.title", "overview.vendor", "overview.product", "overview.relevance_score", "overview.exploit_count", "overview.published", "cvss.score",
              "cvss.severity", "ssvc.exploitation", "kev.in_kev", "kev.date_added", "kev.ransomware_use"]
    return docs.select("cve_id", n("parts"), *[F.get_json_object("json", f"$.{w}").alias(w.replace(".", "_")) for w in wanted])


@query
def cve_markdown(s):
    """Every line of every CVE's report, numbered."""
    return export.number_lines(export.markdown_lines(profile.paired(s.corpus(), s.keep), s["relationship"]), s.keep).select("cve_id", n("number"), "line")


@query
def environment_markdown(s):
    """Every line of one owner's environment report, numbered."""
    mine = lambda t: s[t].filter(F.col("owner_id") == "SMALL")
    report = export.environment_report(mine("match"), mine("asset"), s["scored"])
    return export.number_environment_lines(export.environment_markdown(report, mine("asset"), "Plant [one]"), s.keep).select(n("number"), "line")


# ------------------------------------------------------------------------------------ raw payloads and upserts
@query
def attack_parse(s):
    """Objects of a bundle as VARIANT to objects, relationships and counted rejects."""
    bundle = attack.parse_bundle(corpus.attack_objects_text(s.spark, s.d).select(F.try_parse_json("text").alias("object")))
    o, r = bundle.objects, bundle.relationships
    objects = o.select(F.col("obj_type").alias("kind"), F.col("stix_id").alias("key"), "name", F.concat_ws(
        "|", F.coalesce("external_id", F.lit("")), F.coalesce("description", F.lit("")), joined("aliases"), joined("tactics"), joined("platforms"),
        F.col("deprecated").cast("string"), F.col("revoked").cast("string")).alias("detail"), F.lit(1).cast("long").alias("rows"))
    links = r.select(F.lit("relationship").alias("kind"), F.col("stix_id").alias("key"), F.col("relationship_type").alias("name"),
                     F.concat_ws(">", "source_ref", "target_ref").alias("detail"), F.lit(1).cast("long").alias("rows"))
    nothing = F.lit(None).cast("string")
    return objects.unionByName(links).unionByName(reject_counts(bundle.rejects).select(
        F.lit("reject").alias("kind"), nothing.alias("key"), nothing.alias("name"), F.col("reason").alias("detail"), "rows"))


@query
def rule_parse(s):
    """Rule files to rules and counted rejects."""
    parsed = rules.parse_rules(corpus.rule_files(s.spark, s.d), "r1", keep=s.keep)
    good = parsed.good.select("external_id", "title", "status", "level", F.element_at("logsource", "product").alias("product"), "detection",
                              joined("techniques").alias("techniques"), joined("cve_ids").alias("cves"), F.lit(1).cast("long").alias("rows"))
    nothing = F.lit(None).cast("string")
    return good.unionByName(reject_counts(parsed.rejects).select(*[nothing.alias(c) for c in ("external_id",)], F.col("reason").alias("title"), *[
        nothing.alias(c) for c in ("status", "level", "product", "detection", "techniques", "cves")], "rows"))


@query
def date_parse(s):
    """Event times written in five layouts and read back."""
    e = corpus.load(s.spark, s.d, "events")
    kind, at = F.col("event_type"), F.col("ts")
    written = (F.when(kind == "click", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
               .when(kind == "view", F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
               .when(kind == "purchase", F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(kind == "signup", F.date_format(at, "yyyy-MM-dd"))
               .otherwise(F.lit("no date")))
    return e.select("event_id", ts(text.parse_dt(written)).alias("parsed"), text.parse_date(written).cast("string").alias("day"))


@query
def kev_parse(s):
    """Catalogue entries, with the number of rejects on a row of its own."""
    parsed = kev.parse_kev(corpus.kev_entries(s.spark, s.d))
    good = parsed.good.select("cve_id", "vendor", "product", joined("cwes").alias("cwes"), joined("note_urls", " ").alias("note_urls"),
                              F.col("kev_date_added").cast("string").alias("added"), F.lit(None).cast("long").alias("rejected"))
    return good.unionByName(reject_counts(parsed.rejects).select(F.col("rows").alias("rejected")), allowMissingColumns=True)


@query
def nvd_parse(s):
    """Database records."""
    rows = nvd.parse_nvd(corpus.nvd_records(s.spark, s.d)).good
    ref = F.get("references", F.lit(0))
    return rows.select("cve_id", "description", "cvss_score", "cvss_severity", "ssvc_exploitation", "ssvc_automatable", joined("cwes").alias("cwes"), "primary_vendor",
                       "primary_product", ts("published").alias("published"), F.size("references").cast("long").alias("refs"), ref["url"].alias("ref_url"),
                       ref["ref_type"].alias("ref_type"))


@query
def nvd_products(s):
    """Product rows, the last platform range of a key winning."""
    return merge.nvd_products(nvd.parse_nvd(corpus.nvd_records(s.spark, s.d)).good).select("cve_id", "vendor", "product", "cpe", "versions")


@query
def exploit_upsert(s):
    """Archive rows merged into an older snapshot whose dates moved for one line number."""
    rows = exploit_archive.parse_exploit_archive(corpus.archive_rows(s.spark, s.d)).good
    old = rows.filter(F.col("external_id").endswith("1") | F.col("external_id").endswith("2")).withColumns({
        "source_updated_at": F.when(F.col("external_id").endswith("2"), F.lit(AS_OF).cast("timestamp")).otherwise(F.col("source_updated_at")),
        "title": F.lit("old"), "collected_at": F.lit(AS_OF).cast("timestamp")}).drop("pos")
    merged = merge.upsert_exploits(old, rows, EVENTS_AS_OF)
    return merged.select("external_id", "title", joined("cve_ids").alias("cves"), "change", ts("collected_at").alias("collected_at"))


@query
def repository_parse(s):
    """Repositories, their kind, and the CVEs they name."""
    rows = repositories.parse_repositories(corpus.repository_items(s.spark, s.d)).good
    return rows.select("external_id", "kind", joined("cve_ids").alias("cves"), "stars", ts("source_updated_at").alias("pushed"))


@query
def release_documents(s):
    """Release notes as documents."""
    rows = feed.parse_releases(corpus.release_rows(s.spark, s.d)).good
    return rows.select("url", "title", "content_hash", F.length("summary").cast("long").alias("excerpt"))


@query
def indicator_refresh(s):
    """The next dump over a filled table: new, refreshed, unchanged and absent rows."""
    urls = s["indicator"].filter(F.col("kind") == "url")
    third = F.length("value_norm") % 3
    old = urls.filter(third != 0).withColumn("status", F.when(third == 1, "old").otherwise(F.col("status")))
    old = old.unionByName(s["indicator"].filter(F.col("kind") != "url"))
    batch = urls.drop("collected_at", "last_seen_at").withColumn("pos", F.col("value_norm"))
    return merge.refresh_indicators(old, batch, EVENTS_AS_OF).select("kind", "value_norm", "status", "change")


@query
def latest_documents(s):
    """A3: newest research bulletins."""
    rows = s["document"].filter(F.col("doc_type") == "research")
    return marts.latest(rows, "published_at", "url", 8).select("url", ts("published_at").alias("published_at"))


@query
def page_total(s):
    """How many rows the threat table has in all."""
    return queries.paginate(s["scored"], queries.threat_order("relevance"), 2, 25).total


@query
def feed_parse(s):
    """Every page as a feed entry: link, title, text, content hash."""
    entries = pages(s).select(
        F.col("url").alias("link"), F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), F.lit("").alias("summary_html"),
        F.col("html").alias("content_html"), F.lit("Wed, 01 May 2024 10:00:00 GMT").alias("published"),
        F.array(F.lit("<b>news</b>"), F.lit("")).alias("categories"), F.array(F.lit("desk")).alias("authors"))
    rows = feed.parse_entries(entries, "pages", "news", 3).good
    return rows.select("url", "title", ts("published_at").alias("published_at"), joined("categories").alias("categories"),
                       joined("authors").alias("authors"), n("tier"))


@query
def repository_upsert(s):
    """U8: the next search result over known repositories; stars of one kind moved, one kind is new."""
    rows = repositories.parse_repositories(corpus.repository_items(s.spark, s.d)).good
    old = rows.filter(F.col("kind") != "scanner").withColumns({
        "stars": F.when(F.col("kind") == "detection", F.lit(-1)).otherwise(F.col("stars")).cast(rows.schema["stars"].dataType),
        "collected_at": F.lit(AS_OF).cast("timestamp")})
    merged = merge.upsert_repositories(old, rows, EVENTS_AS_OF)
    return merged.select("external_id", "kind", n("stars"), "change")


@query
def rule_upsert(s):
    """The next rule release; rules of owing customers were missing, those of one level differ."""
    new = s["rule"].withColumns({"release": F.lit("r2"), "file": F.col("external_id")})
    old = s["rule"].filter(F.col("status") == "stable").withColumns({"file": F.col("external_id"), "release": F.when(F.col("level") == "low", "r0").otherwise("r2")})
    return merge.upsert_rules(old, new, EVENTS_AS_OF).select("external_id", "release", "change")


@query
def attack_upsert(s):
    """Objects replaced when their date moved; tactics always."""
    old = s["attack_object"].filter(F.col("obj_type") != "analytic").withColumn(
        "modified", F.when(F.col("obj_type") != "campaign", F.col("modified"))).withColumn(
        "modified", F.when(F.col("obj_type") == "tool", F.lit(None)).otherwise(F.coalesce("modified", F.lit(AS_OF).cast("timestamp")))).withColumn("name", F.lit("old"))
    return merge.upsert_attack_objects(old, s["attack_object"]).select("stix_id", "name", "change")


@query
def stale_documents(s):
    """Recent bulletins extracted with another dictionary."""
    docs = s["document"].withColumn("extraction_version", F.when(F.col("doc_type") == "news", "2").when(F.col("doc_type") == "research", "1"))
    return link.stale_documents(docs, "2", AS_OF).select("url", "full_text")


@query
def asset_validation(s):
    """Owner-typed rows that pass."""
    c = corpus.load(s.spark, s.d, "customer")
    none = F.lit(None).cast("string")
    rows = c.select(
        F.col("c_custkey").cast("string").alias("asset_id"), F.concat(F.lit(" \u0007"), "c_name").alias("label"),
        corpus.case(F.col("c_mktsegment"), {"AUTOMOBILE": "OS", "BUILDING": " firewall", "FURNITURE": "switch"}, "toaster").alias("category"),
        F.when(F.col("c_acctbal") < 0, "").otherwise("Acme").alias("vendor"), F.lit("Box").alias("product"), none.alias("version"), none.alias("cpe"),
        none.alias("hardware_model"), F.when(F.col("c_nationkey") == 3, F.repeat(F.lit("x"), 2001)).alias("notes"))
    return inventory.validate_assets(rows).good.select("asset_id", "label", "category", "vendor")


@query
def payload_cache(s):
    """Latest answer per record, and whether it is fresh enough."""
    o = corpus.load(s.spark, s.d, "orders")
    rows = o.select(F.col("o_custkey").cast("string").alias("cve_id"), F.col("o_orderpriority").alias("payload"), (F.col("o_orderstatus") == "F").alias("found"),
                    F.timestamp_seconds(F.unix_seconds("o_orderdate") + F.col("o_orderkey") % 86400).alias("fetched_at"))
    first = rows.filter(F.col("fetched_at") < F.lit("1998-01-01").cast("timestamp"))
    kept = merge.put_payloads(first, rows.filter(F.col("fetched_at") >= F.lit("1998-01-01").cast("timestamp")))
    fresh = merge.fresh_payloads(kept, AS_OF, 365).select("cve_id", F.lit(True).alias("fresh"))
    return kept.join(fresh, "cve_id", "left").select("cve_id", ts("fetched_at").alias("fetched_at"), F.coalesce("fresh", F.lit(False)).alias("fresh"))
