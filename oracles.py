"""Reference answers in DuckDB SQL for the registered queries.

The answers are derived from the star-schema tables directly; they do not repeat the way the Spark
jobs get there. Shared pieces are common table expressions, and each query pulls in those it names.
"""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2001-08-02 00:00:00'"
EVENTS_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
YEAR_AGO = f"({AS_OF} - INTERVAL 365 DAY)"


def cve(k: str) -> str:
    return (f"('CVE-' || CAST(2000 + {k} // 1000000 AS VARCHAR) || '-' || "
            f"lpad(CAST({k} % 1000000 AS VARCHAR), 6, '0'))")


def tid(k: str) -> str:
    return f"('T1' || lpad(CAST({k} AS VARCHAR), 3, '0'))"


def url(k: str) -> str:
    return f"('https://bulletins.example.org/' || CAST({k} AS VARCHAR))"


def ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def source_name(c: str) -> str:
    return (f"CASE {c} WHEN 'unit42' THEN 'Palo Alto Networks Unit 42' WHEN 'talos' THEN 'Cisco Talos Intelligence' "
            f"WHEN 'bleepingcomputer' THEN 'BleepingComputer' WHEN 'krebs' THEN 'Krebs on Security' "
            f"WHEN 'therecord' THEN 'The Record (Recorded Future News)' WHEN 'exploitdb' THEN 'Exploit Database (OffSec)' "
            f"WHEN 'github' THEN 'GitHub (PoC / research search)' WHEN 'nvd' THEN 'NIST National Vulnerability Database' "
            f"WHEN 'cisa_kev' THEN 'CISA Known Exploited Vulnerabilities' WHEN 'cve_org' THEN 'CVE.org (CVE Services)' ELSE {c} END")


ACTOR_TYPE = "CASE s_suppkey % 4 WHEN 0 THEN 'group' WHEN 1 THEN 'malware' WHEN 2 THEN 'tool' ELSE 'campaign' END"
ACTOR = "('actor--' || CAST({} AS VARCHAR))"
KEV_URL = "https://www.cisa.gov/known-exploited-vulnerabilities-catalog"
NVD_URL = "https://nvd.nist.gov/vuln/detail/"

CTES: dict[str, str] = {
    "pdates": "SELECT l_partkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1",
    "vuln": f"""
        SELECT p_partkey, {cve('p_partkey')} AS cve_id, p_type, p_size, p_brand AS vendor, p_name AS product,
          CASE p_type WHEN 'ECONOMY' THEN 'A remote code execution vulnerability' WHEN 'STANDARD' THEN 'An unspecified issue'
            WHEN 'PROMO' THEN 'An authentication bypass' WHEN 'SMALL' THEN 'A privilege escalation flaw'
            WHEN 'LARGE' THEN 'A use-after-free bug in the Windows kernel' ELSE 'A path traversal issue in a web console' END
            || ' in ' || p_name || ' of ' || p_brand || '.' AS description,
          CASE WHEN p_type = 'PROMO' THEN p_name || ' Gateway Vulnerability' END AS kev_name,
          p_type = 'PROMO' AS in_kev,
          CASE WHEN p_type = 'PROMO' THEN CAST(last_ship AS DATE) END AS kev_date,
          CASE WHEN p_type = 'PROMO' THEN CASE WHEN p_size > 25 THEN 'Known' ELSE 'Unknown' END END AS kev_ransomware,
          CASE p_type WHEN 'STANDARD' THEN 'CWE-287,CWE-798' WHEN 'MEDIUM' THEN 'CWE-22' ELSE '' END AS cwes,
          CASE WHEN p_type <> 'STANDARD' THEN round(CAST(p_size AS DOUBLE) / 5.0, 1) END AS cvss_score,
          CASE WHEN p_type = 'STANDARD' THEN NULL WHEN p_size >= 45 THEN 'CRITICAL' WHEN p_size >= 35 THEN 'HIGH'
            WHEN p_size >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS cvss_severity,
          CASE WHEN p_size > 45 THEN 'active' WHEN p_size > 35 THEN 'poc' ELSE 'none' END AS ssvc,
          first_ship AS published, last_ship
        FROM part LEFT JOIN pdates ON p_partkey = l_partkey""",
    "vtitle": "SELECT *, coalesce(kev_name, description) AS title FROM vuln",
    "bulletin": f"""
        SELECT o_orderkey, {url('o_orderkey')} AS url,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'unit42' WHEN '2-HIGH' THEN 'talos' WHEN '3-MEDIUM' THEN 'bleepingcomputer'
            WHEN '4-NOT SPECIFIED' THEN 'krebs' ELSE 'therecord' END AS source_key,
          'Bulletin ' || CAST(o_orderkey AS VARCHAR) || ' ' || o_orderpriority AS title,
          CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'Ransomware operators are involved'
            ELSE 'Routine summary' END AS summary,
          CASE o_orderstatus WHEN 'F' THEN 'research' WHEN 'O' THEN 'news' ELSE 'advisory' END AS doc_type,
          CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 2 ELSE 3 END AS tier,
          o_orderdate AS published_at, o_orderpriority = '1-URGENT' AS urgent,
          o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AS ransom
        FROM orders""",
    "pairs": "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem",
    "sizes": "SELECT l_orderkey, count(*) AS parts FROM pairs GROUP BY 1",
    "dm": """
        SELECT p.l_orderkey, p.l_partkey, s.parts <= 5 AS focused, b.*
        FROM pairs p JOIN sizes s USING (l_orderkey) JOIN bulletin b ON b.o_orderkey = p.l_orderkey""",
    "da": """
        SELECT d.l_orderkey, d.l_suppkey, b.* FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) d
        JOIN bulletin b ON b.o_orderkey = d.l_orderkey""",
    "dt": """
        SELECT d.l_orderkey, d.s_nationkey, b.* FROM (
          SELECT DISTINCT l_orderkey, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) d
        JOIN bulletin b ON b.o_orderkey = d.l_orderkey""",
    "named": f"""
        SELECT l_orderkey, url, {ACTOR.format('l_suppkey')} AS stix_id, published_at, source_key, 'medium' AS confidence FROM da
        UNION ALL SELECT l_orderkey, url, 'attack-pattern--' || CAST(s_nationkey AS VARCHAR), published_at, source_key, 'high' FROM dt""",
    "ex": f"""
        SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS external_id,
          CASE WHEN min(l_linestatus) = 'F' THEN 'exploitdb' ELSE 'github' END AS source_key,
          CASE WHEN min(l_linestatus) = 'F' THEN 'exploit' ELSE 'poc' END AS kind,
          CASE WHEN min(l_linestatus) = 'F' THEN 2 ELSE 4 END AS tier, min(l_shipdate) AS published_at
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2""",
    "ex_cve": """
        SELECT ex.*, p.l_partkey FROM ex JOIN (
          SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R') p
        USING (l_orderkey, l_linenumber)""",
    "attack": f"""
        SELECT {ACTOR.format('s_suppkey')} AS stix_id, {ACTOR_TYPE} AS obj_type, 'G' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS external_id,
          s_name AS name FROM supplier
        UNION ALL SELECT 'attack-pattern--' || CAST(n_nationkey AS VARCHAR), 'technique', {tid('n_nationkey')}, n_name FROM nation
        UNION ALL SELECT 'course-of-action--' || CAST(n_nationkey AS VARCHAR), 'mitigation', {tid('n_nationkey')}, n_name || ' Mitigation' FROM nation
        UNION ALL SELECT 'strategy--' || CAST(n_nationkey AS VARCHAR), 'detection_strategy', 'DET' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0'), 'Detect ' || n_name FROM nation
        UNION ALL SELECT 'tactic--' || CAST(r_regionkey AS VARCHAR), 'tactic', 'TA' || lpad(CAST(r_regionkey AS VARCHAR), 4, '0'), r_name FROM region
        UNION ALL SELECT 'analytic--' || CAST(s_suppkey AS VARCHAR), 'analytic', 'AN' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 'Analytic ' || CAST(s_suppkey AS VARCHAR) FROM supplier
        UNION ALL SELECT DISTINCT 'component--' || c_mktsegment, 'data_component', 'DC-' || c_mktsegment, c_mktsegment FROM customer""",
    "rule": f"""
        SELECT 'rule-' || CAST(c_custkey AS VARCHAR) AS external_id, c_name AS title, c_nationkey, c_custkey, c_acctbal < 0 AS owing,
          CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'critical' WHEN 'BUILDING' THEN 'high' WHEN 'FURNITURE' THEN 'medium'
            WHEN 'HOUSEHOLD' THEN 'low' ELSE 'informational' END AS level,
          CASE WHEN c_acctbal < 0 THEN 'experimental' ELSE 'stable' END AS status, {cve('c_custkey')} AS cve_id
        FROM customer""",
    "tracked": "SELECT r.*, v.in_kev FROM rule r JOIN vuln v USING (cve_id) WHERE r.owing",
    "co": """
        SELECT {cve} AS cve_id, n.stix_id, n.url FROM dm JOIN named n USING (l_orderkey) WHERE dm.focused""".format(cve=cve("dm.l_partkey")),
    "mentions": "SELECT stix_id, count(*) AS mentions FROM named GROUP BY 1",
    "nations_of": "SELECT DISTINCT l_partkey, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "prod": f"""
        SELECT {cve('p_partkey')} AS cve_id,
          CASE p_type WHEN 'MEDIUM' THEN 'n/a' WHEN 'SMALL' THEN lower(p_brand) ELSE p_brand END AS vendor,
          CASE p_type WHEN 'SMALL' THEN replace(p_name, ' ', '_') ELSE p_name END AS product,
          CASE p_type WHEN 'SMALL' THEN 'cpe:2.3:a:' || lower(p_brand) || ':' || replace(p_name, ' ', '_') || ':' || CAST(p_size AS VARCHAR) || '.0:*:*:*:*:*:*:*' ELSE '' END AS cpe,
          CASE p_type WHEN 'SMALL' THEN NULL WHEN 'LARGE' THEN 'Hh-B' || CAST(p_size AS VARCHAR)
            ELSE '>= ' || CAST(p_size - 5 AS VARCHAR) || '.0 < ' || CAST(p_size + 5 AS VARCHAR) || '.0' END AS versions, p_size, p_type
        FROM part WHERE p_type <> 'PROMO'
        UNION ALL
        SELECT {cve('p_partkey')}, p_brand, p_name || ' ' || n_name, '',
          '>= ' || CAST(p_size - 5 AS VARCHAR) || '.0 < ' || CAST(p_size + 5 AS VARCHAR) || '.0', p_size, 'regional'
        FROM part JOIN nations_of ON p_partkey = l_partkey JOIN nation ON s_nationkey = n_nationkey""",
    "doc_agg": f"""
        SELECT l_partkey, max(published_at) AS last_doc, bool_or(focused AND urgent) AS reported, bool_or(focused AND ransom) AS ransom
        FROM dm GROUP BY 1""",
    "ex_agg": """
        SELECT l_partkey, count(*) FILTER (kind = 'exploit') AS exploits, count(*) FILTER (kind = 'poc') AS pocs, max(published_at) AS last_ex
        FROM ex_cve GROUP BY 1""",
    "src_rows": """
        SELECT l_partkey AS k, source_key AS s FROM dm UNION SELECT l_partkey, source_key FROM ex_cve
        UNION SELECT p_partkey, 'nvd' FROM part UNION SELECT p_partkey, 'cisa_kev' FROM part WHERE p_type = 'PROMO'""",
    "src_agg": "SELECT k, count(*) AS sources FROM src_rows GROUP BY 1",
    "prod_agg": "SELECT cve_id, count(*) AS products FROM prod GROUP BY 1",
    "actor_agg": """
        SELECT cve_id, list_sort(list_distinct(list(a.name))) AS actors FROM co JOIN attack a USING (stix_id)
        WHERE a.obj_type IN ('group', 'campaign') GROUP BY 1""",
    "facts": f"""
        SELECT v.*, coalesce(e.exploits, 0) AS exploits, coalesce(e.pocs, 0) AS pocs, coalesce(s.sources, 0) AS sources,
          coalesce(p.products, 0) AS products, coalesce(a.actors, []) AS actors,
          coalesce(d.reported, false) AS reported, coalesce(v.kev_ransomware = 'Known', false) OR coalesce(d.ransom, false) AS ransomware,
          greatest(v.published, CAST(v.kev_date AS TIMESTAMP), d.last_doc, e.last_ex) AS last_activity
        FROM vtitle v LEFT JOIN doc_agg d ON v.p_partkey = d.l_partkey LEFT JOIN ex_agg e ON v.p_partkey = e.l_partkey
        LEFT JOIN src_agg s ON v.p_partkey = s.k LEFT JOIN prod_agg p USING (cve_id) LEFT JOIN actor_agg a USING (cve_id)""",
    "aged": f"SELECT *, CAST(floor((epoch({AS_OF}) - epoch(last_activity)) / 86400) AS BIGINT) AS age FROM facts",
    "reasons": """
        SELECT cve_id, 1 AS o, 'CISA KEV' AS f, 25.0 AS p, 'Listed in the CISA Known Exploited Vulnerabilities catalog' AS d FROM aged WHERE in_kev
        UNION ALL SELECT cve_id, 2, 'Active exploitation', 15.0, 'Exploitation reported by: ' || array_to_string(list_sort(list_filter([
            CASE WHEN in_kev THEN 'CISA KEV' END, CASE WHEN ssvc = 'active' THEN 'CISA SSVC (via NVD)' END,
            CASE WHEN reported THEN 'Palo Alto Networks Unit 42' END], lambda x: x IS NOT NULL)), ', ')
          FROM aged WHERE in_kev OR ssvc = 'active' OR reported
        UNION ALL SELECT cve_id, 3, 'Ransomware association', 10.0, 'Known or reported use in ransomware campaigns' FROM aged WHERE ransomware
        UNION ALL SELECT cve_id, 4, 'Public exploit', 12.0, CAST(exploits AS VARCHAR) || ' public exploit(s) (e.g. Exploit-DB)' FROM aged WHERE exploits > 0
        UNION ALL SELECT cve_id, 5, 'Public PoC', 8.0, concat_ws('; ', CASE WHEN pocs > 0 THEN CAST(pocs AS VARCHAR) || ' public PoC repo(s) (unverified)' END,
            CASE WHEN ssvc = 'poc' THEN 'CISA SSVC reports public PoC' END) FROM aged WHERE pocs > 0 OR ssvc = 'poc'
        UNION ALL SELECT cve_id, 6, 'Threat actor association', 8.0, 'Mentioned alongside: ' || array_to_string(actors[1:5], ', ') FROM aged WHERE len(actors) > 0
        UNION ALL SELECT cve_id, 7, 'Remote code execution', 8.0, 'Impact classified as RCE (description/CWE)' FROM aged WHERE p_type = 'ECONOMY'
        UNION ALL SELECT cve_id, 8, 'Authentication bypass', 7.0, 'Impact classified as authentication bypass' FROM aged WHERE p_type IN ('STANDARD', 'PROMO')
        UNION ALL SELECT cve_id, 9, 'Privilege escalation', 5.0, 'Impact classified as privilege escalation' FROM aged WHERE p_type = 'SMALL'
        UNION ALL SELECT cve_id, 10, 'Internet-facing product', 6.0, 'Affected product is typically Internet-exposed' FROM aged WHERE in_kev
        UNION ALL SELECT cve_id, 11, 'CVSS severity', cvss_score, 'CVSS base score ' || CAST(cvss_score AS VARCHAR) FROM aged WHERE cvss_score > 0
        UNION ALL SELECT cve_id, 12, 'Multiple independent sources', least(9, (sources - 1) * 3), CAST(sources AS VARCHAR) || ' independent sources' FROM aged WHERE sources > 1
        UNION ALL SELECT cve_id, 13, 'Recency', 8.0, 'New activity ' || CAST(greatest(age, 0) AS VARCHAR) || ' day(s) ago' FROM aged WHERE age <= 7
        UNION ALL SELECT cve_id, 13, 'Recency', 4.0, 'New activity ' || CAST(age AS VARCHAR) || ' days ago' FROM aged WHERE age > 7 AND age <= 30
        UNION ALL SELECT cve_id, 14, 'Broad impact', 5.0, CAST(products AS VARCHAR) || ' affected product entries' FROM aged WHERE products >= 20
        UNION ALL SELECT cve_id, 14, 'Broad impact', 3.0, CAST(products AS VARCHAR) || ' affected product entries' FROM aged WHERE products >= 5 AND products < 20""",
    "points": "SELECT cve_id, sum(CAST(p AS DECIMAL(5,1))) AS pts FROM reasons GROUP BY 1",
    "score": """
        SELECT a.*, CAST(round_even(CAST(least(100, coalesce(pts, 0)) AS DOUBLE), 0) AS BIGINT) AS relevance_score,
          in_kev OR ssvc = 'active' OR reported AS exploited,
          CASE p_type WHEN 'ECONOMY' THEN 'rce' WHEN 'SMALL' THEN 'privilege_escalation' WHEN 'LARGE' THEN 'memory_corruption'
            WHEN 'MEDIUM' THEN 'path_traversal' ELSE 'auth_bypass' END AS tags,
          CASE p_type WHEN 'LARGE' THEN 'linux,windows' WHEN 'MEDIUM' THEN 'web' WHEN 'PROMO' THEN 'network' ELSE '' END AS platforms
        FROM aged a LEFT JOIN points USING (cve_id)""",
    "techs": f"""
        SELECT cve_id, {tid('k')} AS id, 'explicit' AS method FROM (
          SELECT DISTINCT cve_id, CAST(replace(stix_id, 'attack-pattern--', '') AS INTEGER) AS k FROM co WHERE stix_id LIKE 'attack-pattern--%')
        UNION ALL SELECT cve_id, 'T1190', 'heuristic' FROM vuln WHERE p_type = 'PROMO'
        UNION ALL SELECT cve_id, 'T1068', 'heuristic' FROM vuln WHERE p_type = 'SMALL'""",
    "asset": """
        SELECT p_type || '/' || p_brand AS asset_id, p_type AS owner_id, p_brand || ' host' AS label,
          CASE WHEN p_type = 'STANDARD' THEN 'n/a' ELSE p_brand END AS vendor, upper(arg_min(p_name, p_partkey)) AS product,
          arg_min(p_size, p_partkey) AS size, CASE WHEN p_type <> 'ECONOMY' THEN CAST(arg_min(p_size, p_partkey) AS VARCHAR) || '.0.0' END AS version
        FROM part GROUP BY p_type, p_brand""",
    "cand": """
        SELECT a.*, a.vendor || ' ' || a.product AS label2, p.cve_id, p.cpe, p.versions, p.p_size, p.p_type AS ptype
        FROM asset a JOIN prod p ON p.p_type <> 'regional' AND lower(a.product) = replace(p.product, '_', ' ')
          AND (a.vendor = 'n/a' OR p.vendor = 'n/a' OR lower(a.vendor) = lower(p.vendor))""",
    "match": """
        SELECT owner_id, asset_id, cve_id,
          CASE WHEN version IS NULL THEN 'possibly_affected' WHEN ptype = 'LARGE' THEN 'possibly_affected'
            WHEN ptype = 'SMALL' THEN CASE WHEN size = p_size THEN 'affected' ELSE 'not_affected' END
            WHEN size >= abs(p_size - 5) AND size < p_size + 5 THEN 'affected' ELSE 'not_affected' END AS state,
          CASE WHEN version IS NULL OR ptype = 'LARGE' THEN 'vendor_product' WHEN ptype = 'SMALL' AND size = p_size THEN 'cpe_exact'
            ELSE 'cpe_version_range' END AS method,
          CASE WHEN version IS NULL OR ptype = 'LARGE' THEN 'medium' WHEN ptype = 'SMALL' AND size = p_size THEN 'high'
            WHEN ptype <> 'SMALL' AND size >= abs(p_size - 5) AND size < p_size + 5 THEN 'high' ELSE 'medium' END AS confidence,
          CASE WHEN version IS NULL THEN label2 || ' is listed as affected, but no version is recorded for this asset.'
            WHEN ptype = 'LARGE' THEN label2 || ' is listed as affected, but version ' || version || ' could not be compared against the published range.'
            WHEN ptype = 'SMALL' AND size = p_size THEN label2 || ' ' || version || ' is the exact version named by ' || cpe || '.'
            WHEN ptype = 'SMALL' THEN label2 || ' ' || version || ' is outside every affected range (' || cpe || ' names ' || CAST(p_size AS VARCHAR) || '.0).'
            WHEN size >= abs(p_size - 5) AND size < p_size + 5 THEN label2 || ' ' || version || ' falls inside the affected range ' || versions || '.'
            ELSE label2 || ' ' || version || ' is outside every affected range (' || versions || ').' END AS evidence
        FROM cand
        UNION ALL
        SELECT owner_id, asset_id, cve_id, 'possibly_affected', 'kev_fallback', 'low',
          a.vendor || ' ' || a.product || ' is named in the CISA KEV entry, which carries no machine-readable affected versions.'
        FROM asset a JOIN vuln v ON v.in_kev AND lower(a.product) = v.product AND (a.vendor = 'n/a' OR lower(a.vendor) = lower(v.vendor))""",
    "exposed": """
        SELECT *, CASE state WHEN 'affected' THEN 40 WHEN 'possibly_affected' THEN 15 ELSE 0 END AS exposure,
          state <> 'not_affected' AS reaching FROM match""",
    "sevs": "SELECT * FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('UNSCORED')) t(severity)",
    "states": "SELECT * FROM (VALUES (0, 'affected', 'Affected'), (1, 'possibly_affected', 'To check'), (2, 'not_affected', 'Ruled out')) t(position, state, label)",
    "art_line": f"""
        SELECT DISTINCT d.doc_id, d.source, l.l_partkey, l.l_suppkey, s.s_nationkey FROM documents d
        JOIN lineitem l ON l.l_orderkey = d.doc_id JOIN supplier s ON s.s_suppkey = l.l_suppkey""",
    "art_size": "SELECT doc_id, count(DISTINCT l_partkey) AS parts FROM art_line GROUP BY 1",
    "art": """
        SELECT a.*, z.parts, o.o_orderdate, coalesce(o.o_orderpriority = '1-URGENT', false) AS urgent,
          'https://articles.example.org/' || CAST(a.doc_id AS VARCHAR) AS subject_id
        FROM art_line a JOIN art_size z USING (doc_id) LEFT JOIN orders o ON o.o_orderkey = a.doc_id""",
    "art_edge": f"""
        SELECT DISTINCT subject_id, 'cve' AS object_type, {cve('l_partkey')} AS object_id, 'mentions' AS relation, 'regex' AS method,
          CASE WHEN parts <= 5 THEN 'high' ELSE 'low' END AS confidence, source AS source_key, {ts('o_orderdate')} AS observed_at FROM art
        UNION ALL SELECT DISTINCT subject_id, 'cve', {cve('l_partkey')}, 'reports_exploitation', 'regex', 'medium', source, {ts('o_orderdate')}
          FROM art WHERE parts <= 5 AND urgent
        UNION ALL SELECT DISTINCT subject_id, 'attack', 'attack-pattern--' || CAST(s_nationkey AS VARCHAR), 'mentions', 'regex', 'high', source, {ts('o_orderdate')} FROM art
        UNION ALL SELECT DISTINCT subject_id, 'attack', {ACTOR.format('l_suppkey')}, 'mentions', 'dictionary', 'medium', source, {ts('o_orderdate')} FROM art""",
    "samples": """
        SELECT sha256(text) AS v, md5(text) AS m, sha1(text) AS s1, d.doc_id, lang, n_chars, d.doc_id % 50 AS k,
          CASE WHEN toxic = 1 THEN 'Actor ' || CAST(d.doc_id % 50 AS VARCHAR) || 'stealer'
            WHEN quality = 1 THEN 'supplier#' || lpad(CAST(d.doc_id % 50 AS VARCHAR), 9, '0') END AS family
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
        QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY d.doc_id) = 1""",
    "ind": f"""
        SELECT 'malwarebazaar' AS source_key, 'sha256' AS kind, v AS value_norm, NULL AS host, family,
          CASE WHEN s_suppkey IS NOT NULL AND family IS NOT NULL THEN {ACTOR.format('k')} END AS attack_stix_id, NULL AS status, '' AS tags, lang AS reporter,
          m AS md5, s1 AS sha1, to_timestamp(1700000000 + n_chars) AT TIME ZONE 'UTC' AS first_seen FROM samples LEFT JOIN supplier ON s_suppkey = k AND s_suppkey % 4 IN (1, 2)
        UNION ALL
        SELECT 'urlhaus', 'url', lower(url), regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), ':[^:]*$', ''),
          CASE WHEN s_suppkey IS NOT NULL THEN 'Actor ' || CAST(page_id % 50 AS VARCHAR) END,
          CASE WHEN s_suppkey IS NOT NULL THEN {ACTOR.format('page_id % 50')} END, CASE WHEN contains(url, '?') THEN 'online' ELSE 'unknown' END,
          'elf,Actor ' || CAST(page_id % 50 AS VARCHAR) || ',zip', NULL, NULL, NULL, to_timestamp(1700000000 + page_id) AT TIME ZONE 'UTC'
        FROM (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY lower(url) ORDER BY page_id) = 1) LEFT JOIN supplier ON s_suppkey = page_id % 50 AND s_suppkey % 4 IN (1, 2)""",
    "runs": "SELECT CAST(user_id AS VARCHAR) AS key, user_id, ts, event_type = 'error' AS failed, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "run_facts": """
        SELECT key, user_id, max(ts) AS last_attempt, arg_max(failed, ts) AS last_failed, arg_max(k, ts) AS items,
          max(ts) FILTER (NOT failed) AS last_ok FROM runs GROUP BY 1, 2""",
    "run_state": """
        SELECT f.*, (SELECT count(*) FROM runs r WHERE r.key = f.key AND r.failed AND (f.last_ok IS NULL OR r.ts > f.last_ok)) AS failures,
          900 * (1 + user_id % 4) AS interval_seconds, user_id % 10 <> 0 AS enabled FROM run_facts f""",
    "cve_docs": f"SELECT {cve('l_partkey')} AS cve_id, * FROM dm",
    "cve_ex": f"SELECT {cve('l_partkey')} AS cve_id, * FROM ex_cve",
    "refs": f"""
        SELECT cve_id, 'cisa_kev' AS source_key, '{KEV_URL}?search_api_fulltext=' || cve_id AS url, 'kev' AS ref_type, 'CISA KEV: ' || kev_name AS title, CAST(kev_date AS TIMESTAMP) AS dated FROM vuln WHERE in_kev
        UNION ALL SELECT cve_id, 'cisa_kev', 'https://vendor.example.com/' || CAST(p_partkey AS VARCHAR), 'vendor_advisory', 'Vendor advisory (via CISA KEV notes)', NULL FROM vuln WHERE in_kev
        UNION ALL SELECT cve_id, 'nvd', '{NVD_URL}' || cve_id, 'nvd', 'NVD: ' || cve_id, published FROM vuln
        UNION ALL SELECT cve_id, 'cve_org', 'https://www.cve.org/CVERecord?id=' || cve_id, 'cve_org', 'CVE Record: ' || cve_id, published FROM vuln""",
    "known_techs": "SELECT t.cve_id, t.id, t.method, n.* , r.r_name FROM techs t JOIN (SELECT n_nationkey, n_name, n_regionkey, " + tid("n_nationkey") + " AS tid FROM nation) n ON n.tid = t.id JOIN region r ON r_regionkey = n_regionkey",
    "events_of": f"""
        SELECT cve_id, 'cve_published' AS kind, 'CVE published' AS title, 'NVD' AS source, published AS dated, '{NVD_URL}' || cve_id AS url FROM vuln WHERE published IS NOT NULL
        UNION ALL SELECT cve_id, 'kev_added', 'Added to CISA KEV', 'CISA KEV', CAST(kev_date AS TIMESTAMP), '{KEV_URL}' FROM vuln WHERE kev_date IS NOT NULL
        UNION ALL SELECT cve_id, 'remediation_due', 'CISA remediation due date', 'CISA KEV', CAST(kev_date + 21 AS TIMESTAMP), NULL FROM vuln WHERE kev_date IS NOT NULL
        UNION ALL SELECT cve_id, 'collected', 'First collected here', 'vigil', published, NULL FROM vuln WHERE published IS NOT NULL
        UNION ALL SELECT cve_id, CASE doc_type WHEN 'advisory' THEN 'vendor_advisory' ELSE doc_type END, title, {source_name('source_key')}, published_at, url FROM cve_docs
        UNION ALL SELECT cve_id, kind, 'Code ' || external_id, {source_name('source_key')}, published_at, 'https://code.example.org/' || external_id FROM cve_ex""",
    "prov": f"""
        SELECT cve_id, ref_type AS kind, title, {source_name('source_key')} AS source, 1 AS tier, dated, url FROM refs
        UNION ALL SELECT cve_id, doc_type, title, {source_name('source_key')}, tier, published_at, url FROM cve_docs
        UNION ALL SELECT cve_id, kind, 'Code ' || external_id, {source_name('source_key')}, tier, published_at, 'https://code.example.org/' || external_id FROM cve_ex""",
    "fact_rows": f"""
        SELECT cve_id, 'overview' AS section, cvss_severity AS kind, title, NULL AS source, NULL AS tier, published AS dated, NULL AS url, description AS detail FROM vtitle
        UNION ALL SELECT cve_id, 'risk', f, CAST(CAST(p AS DOUBLE) AS VARCHAR), NULL, NULL, NULL, NULL, d FROM reasons
        UNION ALL SELECT cve_id, 'affected_products', cpe, vendor || ' ' || product, {source_name("'nvd'")}, NULL, NULL, NULL, versions FROM prod
        UNION ALL SELECT cve_id, 'exploitation', 'kev', NULL, 'CISA KEV', 1, CAST(kev_date AS TIMESTAMP), '{KEV_URL}', 'Listed as known exploited' FROM vuln WHERE in_kev
        UNION ALL SELECT cve_id, 'exploitation', 'ssvc', NULL, 'CISA SSVC (via NVD)', 1, NULL, '{NVD_URL}' || cve_id,
          'SSVC exploitation = ' || ssvc || '; automatable = no; technical impact = partial' FROM vuln
        UNION ALL SELECT cve_id, 'exploitation', 'report', NULL, {source_name('source_key')}, tier, published_at, url, 'line ' || cve_id FROM cve_docs WHERE focused AND urgent
        UNION ALL SELECT cve_id, CASE kind WHEN 'exploit' THEN 'public_exploits' ELSE 'pocs' END, kind, 'Code ' || external_id, {source_name('source_key')}, tier, published_at,
          'https://code.example.org/' || external_id, NULL FROM cve_ex
        UNION ALL SELECT cve_id, CASE obj_type WHEN 'group' THEN 'threat_actors' WHEN 'campaign' THEN 'campaigns' WHEN 'technique' THEN 'techniques_reported' ELSE 'malware' END,
          obj_type, name, external_id, NULL, NULL, url, 'line ' || stix_id FROM co JOIN attack USING (stix_id)
        UNION ALL SELECT cve_id, 'attack', 'explicit', a.name, id, 1, NULL, 'https://attack.example.org/' || a.stix_id, 'Technique mentioned in a report about this CVE'
          FROM techs JOIN attack a ON a.external_id = id AND a.obj_type = 'technique' WHERE method = 'explicit'
        UNION ALL SELECT cve_id, 'vendor_advisories', ref_type, title, {source_name('source_key')}, 1, NULL, url, NULL FROM refs WHERE ref_type = 'vendor_advisory'
        UNION ALL SELECT cve_id, CASE doc_type WHEN 'advisory' THEN 'vendor_advisories' ELSE doc_type END, CASE WHEN focused THEN 'high' ELSE 'low' END, title,
          {source_name('source_key')}, tier, published_at, url, 'line ' || cve_id FROM cve_docs
        UNION ALL SELECT cve_id, 'timeline', kind, title, source, NULL, dated, url, NULL FROM events_of
        UNION ALL SELECT cve_id, 'sources', kind, title, source, tier, dated, url, NULL FROM prov""",
    "exploitation": f"""
        SELECT cve_id, 0 AS r, 'CISA KEV' AS source, 1 AS tier, '{KEV_URL}' AS url, 'Listed as known exploited' AS detail FROM vuln WHERE in_kev
        UNION ALL SELECT cve_id, 1, 'CISA SSVC (via NVD)', 1, '{NVD_URL}' || cve_id, 'SSVC exploitation = ' || ssvc || '; automatable = no; technical impact = partial' FROM vuln
        UNION ALL SELECT cve_id, 2, {source_name('source_key')}, tier, url, 'line ' || cve_id FROM cve_docs WHERE focused AND urgent""",
}


# The inventory queries over every part as an asset: the same answers with this in the place of ``asset``.
FLEET_QUERIES = ("version_match", "rematch_changed", "asset_counts", "verdict_split", "exposure_by_cve", "environment_figures", "environment_csv",
                 "environment_totals", "environment_threats", "reaching_severity", "environment_documents", "environment_header")
FLEET = """
        SELECT 'part-' || CAST(p_partkey AS VARCHAR) AS asset_id, 'site-' || CAST(p_partkey // 400 AS VARCHAR) AS owner_id, p_brand || ' host' AS label,
          p_brand AS vendor, upper(p_name) AS product, p_size AS size, CASE WHEN p_type <> 'ECONOMY' THEN CAST(p_size AS VARCHAR) || '.0.0' END AS version
        FROM part"""


# The fleet after a set of changes: one asset in fifty gone, one in fifty with another version, one in a hundred also put by a second owner.
CHANGED_FLEET = """
        SELECT asset_id, CASE WHEN second THEN 'branch-' ELSE '' END || owner_id AS owner_id, label, vendor, product, CASE WHEN k % 50 = 1 THEN 9 ELSE size END AS size,
          CASE WHEN k % 50 = 1 THEN '9.0.0' ELSE version END AS version
        FROM (SELECT *, CAST(replace(asset_id, 'part-', '') AS BIGINT) AS k FROM ({fleet})) CROSS JOIN (VALUES (false), (true)) t(second)
        WHERE k % 50 <> 0 AND (NOT second OR k % 100 = 2)"""


def sql(body: str) -> str:
    """``body`` with the common table expressions it needs, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({CTES[name]})" for name in order) + "\n" + body


def _rank(score: str = "relevance_score") -> str:
    return f"{score} DESC, last_activity DESC NULLS LAST, cve_id"


_IMPACT = {
    "auth_bypass": "authentication bypass|bypass (?:the )?authentication|missing authentication|unauthenticated (?:attacker|access)|improper authentication|auth bypass",
    "dos": "denial[- ]of[- ]service",
    "info_disclosure": "information disclosure|sensitive information",
    "memory_corruption": "use[- ]after[- ]free|buffer overflow|out-of-bounds write|heap overflow|type confusion|memory corruption",
    "path_traversal": "path traversal|directory traversal",
    "privilege_escalation": r"privilege escalation|elevation of privilege|escalate privileges|gain (?:root|system|elevated) privileges|\bEoP\b|\bLPE\b",
    "rce": r"remote code execution|arbitrary code execution|execute arbitrary (?:code|commands)|code injection|command injection|\bRCE\b|deserializ",
    "sqli": "sql injection",
}


def _impact_sql() -> str:
    from vigil import vocab

    tags = []
    for tag, pattern in sorted(_IMPACT.items()):
        extra = {"sqli": " OR toxic = 1", "path_traversal": " OR quality = 0"}.get(tag, "")
        tags.append(f"CASE WHEN regexp_matches(text, '{pattern}', 'i'){extra} THEN '{tag}' END")
    plats = [f"CASE WHEN regexp_matches(text, '{vocab.PLATFORM_WORDS[t]}', 'i') THEN '{t}' END" for t in sorted(vocab.PLATFORM_WORDS)]
    return f"""SELECT d.doc_id, concat_ws(',', {', '.join(tags)}) AS tags, concat_ws(',', {', '.join(plats)}) AS platforms,
        regexp_matches(text, '{vocab.INTERNET_FACING_WORDS}', 'i') AS exposed FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def _html_sql() -> str:
    text = "html"
    for tag in ("script", "style", "noscript", "iframe", "object", "template"):
        text = f"regexp_replace({text}, '(?is)<\\s*{tag}\\b.*?<\\s*/\\s*{tag}\\s*>', ' ', 'g')"
    text = f"regexp_replace({text}, '(?i)<\\s*(br|/p|/div|/li|/h[1-6]|/tr)\\s*/?>', ' ', 'g')"
    text = f"regexp_replace({text}, '(?s)<!--.*?(?:-->|\\z)|<[a-zA-Z/!?](?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*(?:>|\\z)', '', 'g')"
    text = f"regexp_replace({text}, '&copy;', '©', 'g')"
    for name, value in (("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">")):
        text = f"replace({text}, '&{name};', '{value}')"
    text = f"regexp_replace({text}, '&amp(;|\\z|[^A-Za-z0-9;=])', '&\\1', 'g')"
    text = f"replace({text}, '&;', '&')"
    text = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    return f"""SELECT page_id, text, CASE WHEN length(text) > 300 THEN regexp_replace(substr(text, 1, 299), ' [^ ]*\\z', '') || '…' ELSE text END AS excerpt
        FROM (SELECT page_id, {text} AS text FROM pages)"""


def _csv_cell(c: str) -> str:
    return f"CASE WHEN substr(coalesce({c}, ''), 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || {c} ELSE coalesce({c}, '') END"


def _iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


def _md(c: str) -> str:
    return rf"replace(regexp_replace(coalesce({c}, ''), '([\\`*_{{}}\[\]<>#|])', '\\\1', 'g'), chr(10), ' ')"


def _link(title: str, target: str) -> str:
    """Targets of the fixtures are plain https links."""
    return f"'[' || CASE WHEN coalesce({title}, '') <> '' THEN {_md(title)} ELSE {target} END || '](' || {target} || ')'"


def _fixed(table: str, section: int, lines: list[str], start: str = "0") -> str:
    """Lines that every row of ``table`` has; an expression that is null is no line."""
    return " UNION ALL ".join(f"SELECT cve_id, {section} AS section, '{start}{k:03d}' AS place, {line} AS line FROM {table}" for k, line in enumerate(lines))


def _markdown_sql() -> str:
    """The report of every CVE, section by section; the order is section, place, line."""
    nth = lambda order: f"'1' || lpad(CAST(row_number() OVER (PARTITION BY cve_id ORDER BY {order}) AS VARCHAR), 12, '0')"
    day = lambda c: f"strftime({c}, '%Y-%m-%d')"
    label = "coalesce(nullif(title, ''), url)"
    parts = [
        _fixed("vtitle", 0, ["'# ' || cve_id", "''", f"'**' || {_md('title')} || '**'", "''"]),
        _fixed("vtitle", 1, ["'## Overview'", "''", _md("description"), "''", f"'- Vendor / product: ' || {_md('vendor')} || ' / ' || {_md('product')}",
                             f"'- Published: ' || coalesce({_iso('published')}, 'n/a')", "'- CWE: ' || coalesce(nullif(replace(cwes, ',', ', '), ''), 'n/a')", "''"]),
        _fixed("score", 2, ["'## Impact & Risk'", "''", "'- CVSS: ' || coalesce(CAST(nullif(cvss_score, 0) AS VARCHAR), 'n/a') || ' ' || coalesce(cvss_severity, '') || ' ``'",
                            "'- Threat Relevance Score: **' || CAST(relevance_score AS VARCHAR) || '** / 100 (internal prioritisation, not CVSS)'", "''"]),
        f"""SELECT cve_id, 2, '1' || lpad(CAST(row_number() OVER (PARTITION BY cve_id ORDER BY CAST(p AS DECIMAL(5,1)) DESC, o) - 1 AS VARCHAR), 12, '0'),
              '  - +' || CAST(CAST(p AS DOUBLE) AS VARCHAR) || ' ' || {_md('f')} || ' — ' || {_md('d')} FROM reasons""",
        _fixed("vuln", 2, ["''"], "9"),
        _fixed("vuln", 3, ["'## Affected Products'", "''"]), _fixed("vuln", 3, ["''"], "9"),
        f"""SELECT cve_id, 3, {nth('vendor, product, cpe')}, '- ' || {_md('vendor')} || ' ' || {_md('product')} || ' ' || {_md('versions')} FROM prod""",
        "SELECT cve_id, 3, '1', '- n/a' FROM vuln WHERE cve_id NOT IN (SELECT cve_id FROM prod)",
        _fixed("vuln", 4, ["'## Exploitation'", "''", "CASE WHEN in_kev THEN '- **CISA KEV** since ' || coalesce(CAST(kev_date AS VARCHAR), 'None') || ' (due ' || "
                           f"coalesce(CAST(kev_date + 21 AS VARCHAR), 'None') || '); ransomware use: ' || {_md('kev_ransomware')} END"]),
        _fixed("vuln", 4, ["''"], "9"),
        f"""SELECT cve_id, 4, '1' || CAST(r + 1 AS VARCHAR) || url, '- ' || {_md('source')} || ': ' || {_md('detail')} || ' — ' || {_link("'source'", 'url')} FROM exploitation""",
        _fixed("vuln", 5, ["'## Public Exploits & PoCs'", "''"]),
        _fixed("vuln", 5, ["''", "'> PoC code is unverified. Never run it outside an isolated lab.'", "''"], "9"),
        f"""SELECT cve_id, 5, '1' || kind || '|' || source_key || ':' || external_id, '- [' || kind || '] ' || {_link("'Code ' || external_id", "'https://code.example.org/' || external_id")}
              || ' (' || {_md(source_name('source_key'))} || ')' FROM cve_ex""",
        "SELECT cve_id, 5, '1', '- None found.' FROM vuln WHERE cve_id NOT IN (SELECT cve_id FROM cve_ex)",
        _fixed("vuln", 6, ["'## Threat Actors & Campaigns'", "''"]), _fixed("vuln", 6, ["''"], "9"),
        f"""SELECT cve_id, 6, '1' || CASE obj_type WHEN 'group' THEN '1' WHEN 'campaign' THEN '2' ELSE '3' END || name,
              '- ' || {_md('name')} || ' (' || obj_type || ', ' || external_id || ') — co-mentioned in ' || {_link('b.title', 'b.url')}
            FROM (SELECT cve_id, stix_id, min(url) AS url FROM co GROUP BY 1, 2) c JOIN attack USING (stix_id) JOIN bulletin b ON b.url = c.url WHERE obj_type <> 'technique'""",
        """SELECT cve_id, 6, '1', '- No association found in collected reports.' FROM vuln
            WHERE cve_id NOT IN (SELECT cve_id FROM co JOIN attack USING (stix_id) WHERE obj_type <> 'technique')""",
        _fixed("vuln", 7, ["'## MITRE ATT&CK'", "''"]), _fixed("vuln", 7, ["''"], "9"),
        f"SELECT cve_id, 7, '1' || id, '- **' || id || ' ' || {_md('n_name')} || '** (' || {_md('r_name')} || ') — mapping: ' || method FROM known_techs",
        "SELECT cve_id, 7, '1', '- No technique mapping.' FROM vuln WHERE cve_id NOT IN (SELECT cve_id FROM known_techs)",
        _fixed("vuln", 8, ["'## Detection'", "''"]), _fixed("vuln", 8, ["'- Sigma / YARA: see the rule tables.'", "''"], "9"),
        f"""SELECT cve_id, 8, '1' || id || '|strategy--' || CAST(n_nationkey AS VARCHAR),
              '- ' || id || ': ' || {_link("'Detect ' || n_name", "'https://attack.example.org/strategy--' || CAST(n_nationkey AS VARCHAR)")}
            FROM known_techs WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)""",
        f"""SELECT cve_id, 8, '1' || id || '|strategy--' || CAST(n_nationkey AS VARCHAR) || '|analytic--' || CAST(s_suppkey AS VARCHAR), '  - Linux: ' || {_md("coalesce(logs, '')")}
            FROM known_techs JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN (
              SELECT c_nationkey, string_agg(lower(seg) || ' log', '; ' ORDER BY seg) AS logs FROM (SELECT DISTINCT c_nationkey, c_mktsegment AS seg FROM customer) GROUP BY 1)
            ON c_nationkey = n_nationkey""",
        _fixed("vuln", 9, ["'## Mitigation'", "''", f"CASE WHEN in_kev THEN '- CISA required action: ' || {_md("'Update ' || product")} END"]), _fixed("vuln", 9, ["''"], "9"),
        f"""SELECT cve_id, 9, {nth('branch, url')}, '- ' || {_link(label, 'url')} FROM (
              SELECT cve_id, 0 AS branch, url, title FROM refs WHERE ref_type = 'vendor_advisory' UNION ALL SELECT cve_id, 1, url, title FROM cve_docs WHERE doc_type = 'advisory')""",
        f"SELECT cve_id, 9, '2' || id || '|1000000000001', '- ' || id || ' ' || {_md("n_name || ' Mitigation'")} || ' (for ' || id || ')' FROM known_techs",
        _fixed("vuln", 10, ["'## Timeline'", "''"]), _fixed("vuln", 10, ["''"], "9"),
        f"""SELECT cve_id, 10, '1' || {_iso('dated')} || '|' || kind || '|' || coalesce(url, ''), '- ' || {day('dated')} || ' — ' || kind || ': ' ||
              CASE WHEN url IS NULL THEN {_md('title')} ELSE {_link('title', 'url')} END || ' (' || {_md('source')} || ')' FROM events_of""",
        _fixed("vuln", 11, ["'## Sources'", "''"]), _fixed("vuln", 11, ["''", "'_Every statement links to its original source._'", "''"], "9"),
        f"""SELECT cve_id, 11, '1' || CAST(tier AS VARCHAR) || '|' || source || '|' || coalesce(url, ''),
              '- [Tier ' || CAST(tier AS VARCHAR) || '] ' || {_md('source')} || ' — ' || {_link(label, 'url')} FROM prov"""]
    return ("SELECT cve_id, row_number() OVER (PARTITION BY cve_id ORDER BY section, place, line) AS number, line FROM (" + " UNION ALL ".join(parts) + ") WHERE line IS NOT NULL")


def _environment_markdown_sql() -> str:
    """The report of one owner; the order is section, place, line."""
    dash = lambda c: f"CASE WHEN {_md(c)} = '' THEN '—' ELSE {_md(c)} END"
    rank = "CASE state WHEN 'affected' THEN 2 WHEN 'possibly_affected' THEN 3 ELSE 4 END"
    flags = "concat_ws(' · ', CASE WHEN in_kev THEN 'CISA KEV' END, 'CVSS ' || CAST(cvss_score AS VARCHAR), 'relevance ' || CAST(relevance_score AS VARCHAR))"
    software = "vendor || ' ' || product"
    lines = ["'### ' || " + _md("cve_id") + " || ' — ' || " + _md("shown"), _md(flags), f"'- Asset: ' || {_md('label')} || ' (' || {_md(software)} || ' ' || {dash('version')} || ')'",
             f"'- Why: ' || {_md('evidence')}", "''"]
    body = " UNION ALL ".join(f"""SELECT {rank} AS section, '1' || lpad(CAST(1000 - relevance_score AS VARCHAR), 4, '0') || '|' || cve_id || '|' || asset_id || '|{k}' AS place,
          {line} AS line FROM mine""" for k, line in enumerate(lines))
    head = ["'## Inventory'", "''", "'| Asset | Software | Version | Category | |'", "'| --- | --- | --- | --- | --- |'"]
    tail = ["'---'", "''", "'_The inventory in this file describes a live environment; treat it as you would a network diagram._'"]
    fixed = lambda section, rows, start="0": " UNION ALL ".join(f"SELECT {section} AS section, '{start}{k:03d}' AS place, {line} AS line" for k, line in enumerate(rows))
    owned = "(SELECT * FROM asset WHERE owner_id = 'SMALL')"
    return f"""SELECT row_number() OVER (ORDER BY section, place, line) AS number, line FROM (
        WITH mine AS (SELECT m.*, a.label, a.vendor, a.product, a.version, v.in_kev, v.cvss_score, v.relevance_score,
              CASE WHEN length(v.title) > 90 THEN regexp_replace(substr(v.title, 1, 90), ' [^ ]*$', '') || '…' ELSE v.title END AS shown
            FROM match m JOIN asset a USING (owner_id, asset_id) JOIN score v USING (cve_id) WHERE m.owner_id = 'SMALL')
        {fixed(0, ["'# Plant ' || chr(92) || '[one' || chr(92) || ']'"])} UNION ALL {fixed(0, ["''"], "1")} UNION ALL {fixed(1, head)}
        UNION ALL SELECT 1, '1application|' || label || '|' || asset_id, '| ' || {_md('label')} || ' | ' || {_md('vendor')} || ' ' || {_md('product')} || ' | ' || {dash('version')} || ' | application |  |' FROM {owned}
        UNION ALL {fixed(1, ["''"], "9")}
        UNION ALL SELECT {rank}, '0000', '## ' || CASE state WHEN 'affected' THEN 'Affected' WHEN 'possibly_affected' THEN 'Possibly affected — check by hand' ELSE 'Ruled out' END || ' (' || CAST(count(*) AS VARCHAR) || ')' FROM mine GROUP BY state
        UNION ALL SELECT DISTINCT {rank}, '0001', '' FROM mine
        UNION ALL {body} UNION ALL {fixed(20, tail)}) WHERE line IS NOT NULL"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["html_text"] = _html_sql()
    q["canonical_url"] = """
        SELECT page_id, lower(scheme) || '://' || lower(host) || CASE WHEN path = '' THEN '/' ELSE path END ||
          CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS url, regexp_replace(lower(host), ':[^:]*$', '') AS host
        FROM (SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) AS scheme, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS host,
            regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path,
            array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN
              ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'ref')), '&') AS kept FROM pages)"""
    q["exact_dup_first_wins"] = "SELECT min(doc_id) AS doc_id, sha256(text) AS digest, arg_min(source, doc_id) AS source FROM documents GROUP BY sha256(text)"
    q["doc_upsert"] = f"""
        SELECT 'doc:' || CAST(d.doc_id AS VARCHAR) AS url, CASE WHEN lang = 'de' OR toxic = 1 THEN 'Title ' || lang ELSE 'Old title' END AS title,
          sha256(text) AS content_hash, CASE WHEN lang = 'de' THEN 'new' WHEN toxic = 1 THEN 'updated' ELSE 'unchanged' END AS change,
          CASE WHEN lang = 'de' THEN {ts(EVENTS_AS_OF)} ELSE {ts(AS_OF)} END AS published_at,
          CASE WHEN lang = 'de' THEN {ts(EVENTS_AS_OF)} ELSE {ts(AS_OF)} END AS collected_at,
          CASE WHEN lang = 'de' OR toxic = 1 THEN {ts(EVENTS_AS_OF)} END AS updated_at
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
    q["entity_edges"] = "SELECT * FROM art_edge"
    said = f"{cve('l_partkey')} || ' used by ' || CASE WHEN l_linenumber % 2 = 0 THEN s_name ELSE 'ACTOR ' || CAST(s_suppkey AS VARCHAR) END || ' with ' || {tid('s_nationkey')} || '.'"
    q["edge_evidence"] = f"""SELECT subject_id, object_id, substr(CASE WHEN start > 0 THEN '…' ELSE '' END
          || regexp_replace(substr(body, start + 1, place - 1 + length(object_id) + 60 - start), '^\\s+|\\s+$', '', 'g') || '…', 1, 500) AS evidence FROM (
        SELECT *, greatest(0, place - 61) AS start FROM (
          SELECT e.subject_id, e.object_id, b.body, strpos(lower(b.body), lower(e.object_id)) AS place
          FROM (SELECT * FROM art_edge WHERE object_type = 'cve' AND relation = 'mentions') e JOIN (
            SELECT 'https://articles.example.org/' || CAST(doc_id AS VARCHAR) AS subject_id, 'Article ' || CAST(doc_id AS VARCHAR) || chr(10) || text || chr(10)
              || coalesce(notes, '') || CASE WHEN o_orderpriority = '1-URGENT' THEN ' The flaw is actively exploited.' ELSE '' END AS body
            FROM documents LEFT JOIN (SELECT l_orderkey, string_agg({said}, ' ' ORDER BY {said}) AS notes FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) ON l_orderkey = doc_id
            LEFT JOIN orders ON o_orderkey = doc_id) b USING (subject_id)))"""
    q["dictionary_hits"] = "SELECT object_id AS stix_id, count(*) AS articles FROM art_edge WHERE method = 'dictionary' GROUP BY 1"
    q["impact_tags"] = _impact_sql()
    q["co_mention"] = "SELECT cve_id, stix_id, count(*) AS reports FROM co GROUP BY 1, 2"
    q["mention_counts"] = "SELECT * FROM mentions"
    q["trending"] = f"""SELECT stix_id, count(*) AS mentions, any_value(obj_type) AS obj_type, any_value(name) AS name FROM named JOIN attack USING (stix_id)
        WHERE published_at >= {YEAR_AGO} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12"""
    q["exploit_edges"] = """SELECT source_key || ':' || external_id AS subject_id, cve_id AS object_id, CASE WHEN source_key = 'exploitdb' THEN 'high' ELSE 'low' END AS confidence,
        CASE WHEN source_key = 'exploitdb' THEN 'EDB-' || external_id || ' lists ' || cve_id ELSE 'GitHub repo ' || external_id || ' names ' || cve_id END AS evidence FROM cve_ex"""
    q["rule_edges"] = f"""SELECT 'sigma:' || external_id AS subject_id, 'attack' AS object_type, 'attack-pattern--' || CAST(c_nationkey AS VARCHAR) AS object_id,
          'Sigma rule tagged attack.' || lower({tid('c_nationkey')}) AS evidence FROM rule
        UNION ALL SELECT 'sigma:' || external_id, 'cve', cve_id, 'Sigma rule tagged cve.' || substr(cve_id, 5) FROM rule WHERE owing"""
    q["edge_insert"] = """SELECT relation, false AS rewritten, count(*) AS edges FROM art_edge GROUP BY 1
        UNION ALL SELECT 'revisited', true, count(*) FROM (SELECT DISTINCT subject_id, object_type, object_id FROM art_edge)"""
    q["vulnerability_merge"] = f"""SELECT cve_id, title, description, vendor, product, cvss_score, cvss_severity, cwes, in_kev, kev_name,
        CAST(kev_date AS VARCHAR) AS kev_date_added, kev_ransomware, {ts('published')} AS published, ssvc AS ssvc_exploitation FROM vtitle"""
    q["track_new"] = f"""SELECT cve_id, CASE WHEN in_kev THEN 'updated' ELSE 'new' END AS change, title, {ts(AS_OF)} AS updated_at
        FROM vtitle WHERE in_kev OR published >= TIMESTAMP '1995-03-01'"""
    q["source_references"] = "SELECT cve_id, source_key, url, ref_type, title FROM refs"
    q["relevance_score"] = f"""SELECT cve_id, relevance_score, exploited AS actively_exploited, CAST(exploits AS BIGINT) AS exploit_count, CAST(pocs AS BIGINT) AS poc_count,
        exploits > 0 AS has_exploit, pocs > 0 OR ssvc = 'poc' AS has_poc, CAST(sources AS BIGINT) AS source_count, CAST(products AS BIGINT) AS product_count,
        {ts('last_activity')} AS last_activity_at, tags, platforms FROM score"""
    q["score_reasons"] = """SELECT v.cve_id, coalesce(string_agg(f || '|' || CAST(CAST(p AS DECIMAL(5,1)) AS VARCHAR) || '|' || d, ' ; ' ORDER BY CAST(p AS DECIMAL(5,1)) DESC, o), '') AS reasons
        FROM vuln v LEFT JOIN reasons USING (cve_id) GROUP BY 1"""
    q["technique_list"] = "SELECT v.cve_id, coalesce(string_agg(id || ':' || method, ',' ORDER BY id), '') AS techniques FROM vuln v LEFT JOIN techs USING (cve_id) GROUP BY 1"
    q["recompute_touched"] = "SELECT cve_id, relevance_score, CAST(sources AS BIGINT) AS source_count FROM score"
    q["maintenance_keys"] = f"SELECT cve_id FROM score WHERE relevance_score >= 60 OR last_activity >= {AS_OF} - INTERVAL 60 DAY"
    q["relink_edges"] = r"""SELECT subject_id, object_type, object_id, relation, CASE WHEN k % 5 = 0 THEN 'added' WHEN k % 7 = 0 THEN 'removed' ELSE 'kept' END AS change
        FROM (SELECT *, TRY_CAST(regexp_extract(object_id, '^actor--(\d+)$', 1) AS BIGINT) AS k FROM art_edge) WHERE k IS NULL OR k % 35 <> 0"""
    q["risk_bands"] = """SELECT CASE WHEN relevance_score >= 75 THEN 'critical' WHEN relevance_score >= 50 THEN 'high' WHEN relevance_score >= 25 THEN 'medium' ELSE 'low' END AS band,
        count(*) AS cves FROM score GROUP BY 1"""
    q["short_labels"] = """SELECT cve_id, CASE WHEN in_kev THEN title ELSE concat_ws(' — ', CASE tags WHEN 'rce' THEN 'Remote code execution' WHEN 'privilege_escalation' THEN 'Privilege escalation'
          WHEN 'memory_corruption' THEN 'Memory corruption' WHEN 'path_traversal' THEN 'Path traversal' ELSE 'Authentication bypass' END,
        CASE platforms WHEN 'linux,windows' THEN 'Linux/Windows' WHEN 'web' THEN 'Web' WHEN 'network' THEN 'Network' END) END AS label FROM score"""

    # inventory
    q["version_match"] = "SELECT owner_id, asset_id, cve_id, state, method, confidence, evidence, CAST(exposure AS BIGINT) AS exposure FROM exposed"
    q["rematch_changed"] = q["version_match"]
    q["asset_counts"] = """SELECT a.owner_id, a.asset_id, label, vendor, product, 'application' AS category, count(*) FILTER (state = 'affected') AS affected,
        count(*) FILTER (state = 'possibly_affected') AS possibly_affected, count(*) FILTER (state = 'not_affected') AS not_affected,
        count(*) FILTER (state IN ('affected', 'possibly_affected')) AS total FROM asset a LEFT JOIN match m ON m.asset_id = a.asset_id AND m.owner_id = a.owner_id GROUP BY ALL"""
    q["environment_totals"] = "SELECT count(DISTINCT cve_id) AS total FROM exposed WHERE owner_id = 'SMALL' AND reaching"
    q["verdict_split"] = "SELECT CAST(position AS BIGINT) AS position, s.state, s.label, count(DISTINCT cve_id) AS count FROM states s LEFT JOIN match m ON m.state = s.state GROUP BY ALL"
    q["exposure_by_cve"] = "SELECT cve_id, CAST(max(exposure) AS BIGINT) AS exposure FROM exposed WHERE reaching GROUP BY 1"
    q["environment_threats"] = """SELECT cve_id, relevance_score, e.state, CAST(e.exposure AS BIGINT) AS exposure, e.evidence FROM score JOIN (
          SELECT * FROM exposed WHERE owner_id = 'SMALL' AND reaching QUALIFY row_number() OVER (PARTITION BY cve_id ORDER BY exposure DESC, asset_id DESC) = 1) e USING (cve_id)
        WHERE relevance_score >= 1 ORDER BY exposure DESC, relevance_score DESC, cve_id LIMIT 50"""
    q["reaching_severity"] = """SELECT severity, count(cve_id) AS count FROM sevs LEFT JOIN (SELECT cve_id, coalesce(cvss_severity, 'UNSCORED') AS sv FROM vuln
        WHERE cve_id IN (SELECT cve_id FROM exposed WHERE owner_id = 'SMALL' AND reaching)) ON sv = severity GROUP BY 1"""
    q["environment_figures"] = """SELECT unnest(['in_kev', 'has_public_exploit', 'has_detection_rule', 'total']) AS figure,
          unnest([count(*) FILTER (in_kev), count(*) FILTER (exploits > 0), count(*) FILTER (cve_id IN (SELECT cve_id FROM rule WHERE owing)), count(*)]) AS value
        FROM score WHERE cve_id IN (SELECT cve_id FROM exposed WHERE reaching)"""
    q["environment_documents"] = f"""SELECT url, {ts('any_value(published_at)')} AS published_at, string_agg(cve_id, ',' ORDER BY cve_id) AS cves FROM cve_docs
        WHERE cve_id IN (SELECT cve_id FROM exposed WHERE owner_id = 'SMALL' AND reaching) GROUP BY url ORDER BY any_value(cve_docs.published_at) DESC, url LIMIT 20"""
    q["environment_header"] = "SELECT s.state, count(m.cve_id) AS count FROM states s LEFT JOIN match m ON m.state = s.state AND m.owner_id = 'LARGE' GROUP BY 1"
    q["versions_by_product"] = """SELECT vendor, product, CAST(k AS VARCHAR) || '.0' AS version, row_number() OVER (PARTITION BY vendor, product ORDER BY k DESC) AS position FROM (
          SELECT DISTINCT replace(lower(vendor), '_', ' ') AS vendor, replace(lower(product), '_', ' ') AS product, k FROM (
            SELECT vendor, product, abs(p_size - 5) AS k FROM prod WHERE versions LIKE '>=%' UNION ALL SELECT vendor, product, p_size + 5 FROM prod WHERE versions LIKE '>=%'))
        QUALIFY row_number() OVER (PARTITION BY vendor, product ORDER BY k DESC) <= 60"""
    q["catalogue"] = """SELECT min(vendor) AS vendor, min(product) AS product, count(*) AS rows FROM prod WHERE contains(lower(product), 'ring') AND vendor <> 'n/a'
        GROUP BY lower(vendor), lower(product) ORDER BY count(*) DESC, lower(vendor), lower(product) LIMIT 20"""
    cells = {"state": "state", "cve_id": "cve_id", "title": "v.title", "severity": "cvss_severity", "cvss": "CAST(cvss_score AS VARCHAR)",
             "relevance": "CAST(relevance_score AS VARCHAR)", "in_kev": "CASE WHEN in_kev THEN 'yes' ELSE 'no' END", "asset": "a.label",
             "software": "a.vendor || ' ' || a.product", "version": "a.version", "method": "method", "confidence": "confidence", "evidence": "evidence"}
    q["environment_csv"] = f"""SELECT {', '.join(f'{_csv_cell(c)} AS {n}' for n, c in cells.items())}
        FROM match m JOIN asset a USING (owner_id, asset_id) JOIN score v USING (cve_id)"""

    # parameterised queries
    q["threat_filter"] = f"""SELECT cve_id, relevance_score FROM score s WHERE last_activity >= {YEAR_AGO} AND exploited AND cvss_severity IN ('HIGH', 'CRITICAL', 'MEDIUM')
        AND contains(lower(cve_id || ' ' || title || '~' || description || '~' || vendor || '~' || product), 'in ') AND relevance_score >= 20
        AND p_partkey IN (SELECT l_partkey FROM dm WHERE source_key = 'unit42')
        AND cve_id IN (SELECT cve_id FROM techs WHERE id = 'T1003')"""
    q["threat_actor_filter"] = """SELECT cve_id, vendor FROM vuln LEFT JOIN ex_agg ON p_partkey = l_partkey
        WHERE p_type IN ('STANDARD', 'PROMO') AND contains(lower(vendor), 'brand#1') AND (coalesce(pocs, 0) > 0 OR ssvc = 'poc')
          AND p_partkey IN (SELECT dm.l_partkey FROM dm JOIN da USING (l_orderkey) WHERE dm.focused AND da.l_suppkey = 3)"""
    q["threat_page"] = f"SELECT cve_id, title, cvss_severity AS severity, relevance_score FROM score ORDER BY {_rank()} LIMIT 25 OFFSET 25"
    q["actor_cves"] = f"""SELECT {cve('l_partkey')} AS cve_id FROM dm WHERE focused AND l_orderkey IN (SELECT l_orderkey FROM da WHERE l_suppkey = 3)"""
    # edges of kind reports_exploitation have medium confidence, so only mentions count
    q["exploit_filter"] = f"""SELECT external_id, kind, {ts('published_at')} AS published_at FROM ex WHERE kind = 'poc' AND published_at >= {YEAR_AGO}
        ORDER BY ex.published_at DESC, external_id LIMIT 40"""
    q["document_filter"] = f"""SELECT url, source_key, title FROM bulletin WHERE doc_type IN ('research', 'news') AND tier = 2 AND published_at >= {AS_OF} - INTERVAL 90 DAY"""
    q["document_entities"] = f"""SELECT b.url, coalesce((SELECT string_agg({cve('l_partkey')}, ',' ORDER BY {cve('l_partkey')}) FROM pairs p WHERE p.l_orderkey = b.o_orderkey), '') AS cves,
          string_agg(a.obj_type || '/' || a.name, ',' ORDER BY a.stix_id) AS entities
        FROM bulletin b JOIN named n ON n.l_orderkey = b.o_orderkey JOIN attack a USING (stix_id) WHERE b.published_at >= {YEAR_AGO} GROUP BY b.url, b.o_orderkey"""
    q["search"] = f"""
        SELECT * FROM (SELECT 'vulnerability' AS kind, cve_id AS key, title, CAST(NULL AS VARCHAR) AS exact_cve FROM score
          WHERE contains(lower(title || '~' || description || '~' || product), 'bolt') ORDER BY relevance_score DESC, cve_id LIMIT 10)
        UNION ALL SELECT * FROM (SELECT 'document', url, title, NULL FROM bulletin WHERE contains(lower(title || '~' || summary), 'bolt') LIMIT 10)
        UNION ALL SELECT * FROM (SELECT 'attack', stix_id, name, NULL FROM attack WHERE contains(lower(name), 'bolt') LIMIT 10)"""
    words = "list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pM\\pN_]+'), lambda w: w <> '')"
    q["ranked_search"] = f"""
        WITH t AS (SELECT doc_id, len(list_filter({words}, lambda w: w = 'inon')) AS tf FROM documents),
             c AS (SELECT count(*) AS n, count(*) FILTER (tf > 0) AS df FROM t)
        SELECT doc_id, round((1 + ln(tf)) * ln(1 + n / df), 6) AS rank FROM t, c WHERE tf > 0 ORDER BY 2 DESC, 1 LIMIT 50"""
    q["rule_filter"] = """SELECT external_id, title, level, status FROM tracked WHERE level IN ('high', 'critical') AND status = 'experimental'"""
    q["rule_by_technique"] = "SELECT external_id, level FROM rule WHERE c_nationkey = 3"
    q["rule_details"] = f"""SELECT external_id, 'attack.' || lower({tid('c_nationkey')}) || ',attack.execution' || CASE WHEN owing THEN ',cve.' || substr(cve_id, 5) ELSE '' END AS tags,
        {tid('c_nationkey')} AS attack FROM rule"""
    q["attack_objects"] = "SELECT stix_id, name, mentions FROM attack JOIN mentions USING (stix_id) WHERE obj_type = 'group'"
    q["enrichment_queue"] = f"""SELECT * FROM (
          SELECT cve_id, CAST(0 AS BIGINT) AS branch, relevance_score AS score FROM score WHERE cvss_severity IS NULL AND relevance_score >= 40
          UNION ALL SELECT DISTINCT v.cve_id, 1, 0 FROM vuln v WHERE v.cvss_severity = 'LOW' AND (
            v.p_partkey IN (SELECT l_partkey FROM dm WHERE published_at >= {AS_OF} - INTERVAL 30 DAY)
            OR v.p_partkey IN (SELECT l_partkey FROM ex_cve WHERE published_at >= {AS_OF} - INTERVAL 30 DAY)
            OR v.cve_id IN (SELECT cve_id FROM rule WHERE owing))
            AND v.p_partkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 200 <= 7))
        ORDER BY branch, score DESC, cve_id LIMIT 1000"""
    q["repository_queue"] = f"""SELECT cve_id, relevance_score FROM score WHERE in_kev OR relevance_score >= 80 OR (published >= {AS_OF} - INTERVAL 14 DAY AND cvss_score >= 8.0)
        ORDER BY relevance_score DESC, cve_id LIMIT 40"""
    q["filter_vendors"] = "SELECT DISTINCT vendor FROM score WHERE relevance_score >= 20 ORDER BY 1 LIMIT 300"

    # indicators
    q["indicator_table"] = f"SELECT source_key, kind, value_norm, host, family, attack_stix_id, status, tags, reporter, md5, sha1, {ts('first_seen')} AS first_seen_at FROM ind"
    q["family_resolve"] = f"""SELECT DISTINCT candidate, {ACTOR.format('s_suppkey')} AS stix_id FROM (
          SELECT family AS candidate, k FROM samples WHERE family IS NOT NULL
          UNION SELECT 'Actor ' || CAST(page_id % 50 AS VARCHAR), page_id % 50 FROM pages) JOIN supplier ON s_suppkey = k AND s_suppkey % 4 IN (1, 2)"""
    q["observables"] = r"""SELECT token, CASE WHEN length(token) = 40 THEN 'sha1' WHEN len(list_filter(string_split(token, '.'), lambda o: CAST(o AS INTEGER) > 255)) = 0 THEN 'ipv4' END AS kind,
          count(DISTINCT doc_id) AS docs FROM (
          SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b')) AS token FROM documents
          UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '\b[0-9a-f]{40}\b')) FROM documents) GROUP BY 1, 2"""
    q["indicator_lookup"] = """
        WITH_SPLIT
        SELECT a.query, a.query_kind, h.total IS NOT NULL AS found, coalesce(h.total, 0) AS total, h.position, h.value_norm FROM asked a LEFT JOIN hits h USING (query)"""
    q["indicator_filter"] = f"""SELECT value_norm, family FROM ind WHERE kind = 'url' AND status = 'online' AND attack_stix_id IS NOT NULL AND first_seen >= {EVENTS_AS_OF} - INTERVAL 90 DAY"""
    measures = f"""count(*) AS rows, count(attack_stix_id) AS resolved, count(DISTINCT attack_stix_id) AS families, count(*) FILTER (status = 'online') AS online,
        {ts('max(first_seen)')} AS newest"""
    q["indicator_overview"] = f"""SELECT 'kind' AS facet, kind AS value, {measures} FROM ind GROUP BY kind UNION ALL SELECT 'source', source_key, {measures} FROM ind GROUP BY source_key
        UNION ALL SELECT 'all', 'all', {measures} FROM ind"""

    # aggregates
    def cards(rows: list[tuple[str, str]]) -> str:
        return "\nUNION ALL ".join(f"SELECT '{name}' AS card, CAST(({body}) AS BIGINT) AS value" for name, body in rows)

    since = f"published_at >= {YEAR_AGO}"
    q["overview_cards"] = cards([
        ("actively_exploited", f"SELECT count(*) FROM score WHERE exploited AND last_activity >= {YEAR_AGO}"),
        ("kev_added", f"SELECT count(*) FROM vuln WHERE kev_date >= CAST({YEAR_AGO} AS DATE)"),
        ("new_cves", f"SELECT count(*) FROM vuln WHERE published >= {YEAR_AGO}"),
        ("new_exploits", f"SELECT count(*) FROM ex WHERE kind = 'exploit' AND {since}"),
        ("new_pocs", f"SELECT count(*) FROM ex WHERE kind = 'poc' AND {since}"),
        ("new_detection_repos", "SELECT 0"),
        ("threat_actors_seen", f"SELECT count(DISTINCT stix_id) FROM named JOIN attack USING (stix_id) WHERE obj_type = 'group' AND {since}"),
        ("malware_seen", f"SELECT count(DISTINCT stix_id) FROM named JOIN attack USING (stix_id) WHERE obj_type IN ('malware', 'tool') AND {since}"),
        ("campaigns_seen", f"SELECT count(DISTINCT stix_id) FROM named JOIN attack USING (stix_id) WHERE obj_type = 'campaign' AND {since}"),
        ("new_research", f"SELECT count(*) FROM bulletin WHERE doc_type IN ('research', 'advisory') AND {since}"),
        ("new_news", f"SELECT count(*) FROM bulletin WHERE doc_type = 'news' AND {since}"),
        ("new_rules", "SELECT count(*) FROM rule"),
    ])
    q["top_threats"] = f"SELECT cve_id, relevance_score FROM score WHERE last_activity >= {YEAR_AGO} ORDER BY {_rank()} LIMIT 10"
    q["latest_exploits"] = f"SELECT external_id, {ts('published_at')} AS collected_at FROM ex ORDER BY ex.published_at DESC, external_id LIMIT 8"
    daily = f"""SELECT CAST(d AS DATE) AS day, count(cve_id) AS total, count(cve_id) FILTER (exploited) AS exploited, count(cve_id) FILTER (in_kev) AS kev
        FROM generate_series({AS_OF} - INTERVAL 89 DAY, {AS_OF}, INTERVAL 1 DAY) g(d) LEFT JOIN score ON CAST(last_activity AS DATE) = CAST(d AS DATE) GROUP BY 1"""
    q["pulse"] = f"SELECT CAST(day AS VARCHAR) AS day, total, exploited, kev, max(total) OVER () AS peak FROM ({daily})"
    q["busiest_day"] = f"SELECT CAST(day AS VARCHAR) AS day, total FROM ({daily}) ORDER BY total DESC, day LIMIT 1"
    q["severity_mix"] = "SELECT severity, count(cve_id) AS count FROM sevs LEFT JOIN vuln ON coalesce(cvss_severity, 'UNSCORED') = severity GROUP BY 1"
    q["arrivals"] = f"SELECT severity, count(cve_id) AS count FROM sevs LEFT JOIN vuln ON coalesce(cvss_severity, 'UNSCORED') = severity AND published >= {AS_OF} - INTERVAL 6 YEAR GROUP BY 1"
    q["detection_overview"] = cards([
        ("rules", "SELECT count(*) FROM rule"), ("releases", "SELECT 1"),
        ("techniques_covered", "SELECT count(DISTINCT c_nationkey) FROM rule"), ("cves_covered", "SELECT count(*) FROM tracked"),
        ("kev_covered", "SELECT count(*) FROM tracked WHERE in_kev"), ("kev_total", "SELECT count(*) FROM vuln WHERE in_kev"),
    ]) + "\nUNION ALL SELECT 'level:' || level, count(*) FROM rule GROUP BY level"
    q["source_health"] = f"""SELECT key, CASE WHEN NOT enabled THEN 'disabled' WHEN last_failed THEN 'error' WHEN last_ok IS NULL THEN 'never_run'
          WHEN epoch({EVENTS_AS_OF}) - epoch(last_ok) > interval_seconds * 4 THEN 'stale' ELSE 'ok' END AS health,
        CASE WHEN last_failed THEN 'error' ELSE 'success' END AS last_status, {ts('last_attempt')} AS last_attempt, {ts('last_ok')} AS last_successful_fetch,
        CAST(failures AS BIGINT) AS consecutive_failures, items AS items_fetched FROM run_state"""
    wait = "CASE WHEN failures = 0 THEN 0 ELSE least(interval_seconds * CAST(pow(2, least(failures, 6)) AS BIGINT), 21600) END"
    q["backoff"] = f"SELECT key, CAST({wait} AS BIGINT) AS wait, failures = 0 OR {EVENTS_AS_OF} >= last_attempt + to_seconds({wait}) AS due FROM run_state"
    q["run_history"] = f"""SELECT key AS source_key, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS position, CASE WHEN failed THEN 'error' ELSE 'success' END AS status,
        {ts('ts')} AS started_at FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC) <= 10"""
    q["last_runs"] = f"SELECT key AS source_key, {ts('max(ts)')} AS last_run FROM runs GROUP BY 1"
    q["table_counts"] = """SELECT 'vulnerability' AS "table", (SELECT count(*) FROM vuln) AS rows UNION ALL SELECT 'exploit', (SELECT count(*) FROM ex) UNION ALL SELECT 'document', (SELECT count(*) FROM bulletin)
        UNION ALL SELECT 'attack_object', (SELECT count(*) FROM attack)
        UNION ALL SELECT 'edge', (SELECT count(*) FROM dm) + (SELECT count(*) FROM dm WHERE focused AND urgent) + (SELECT count(*) FROM named) + (SELECT count(*) FROM ex_cve)
          + (SELECT count(*) FROM rule) + (SELECT count(*) FROM rule WHERE owing)"""

    # attack knowledge
    q["tactic_matrix"] = f"""SELECT lower(r_name) AS tactic, r_name AS tactic_name, CAST(r_regionkey AS BIGINT) AS tactic_order, {tid('n_nationkey')} AS external_id, coalesce(mentions, 0) AS mentions,
        row_number() OVER (PARTITION BY r_regionkey ORDER BY coalesce(mentions, 0) DESC, n_nationkey) AS position
        FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN mentions ON stix_id = 'attack-pattern--' || CAST(n_nationkey AS VARCHAR)"""
    rels = f"""SELECT 'uses' AS t, {ACTOR.format('s_suppkey')} AS a, 'attack-pattern--' || CAST(s_nationkey AS VARCHAR) AS b FROM supplier
        UNION ALL SELECT 'mitigates', 'course-of-action--' || CAST(n_nationkey AS VARCHAR), 'attack-pattern--' || CAST(n_nationkey AS VARCHAR) FROM nation
        UNION ALL SELECT 'detects', 'strategy--' || CAST(n_nationkey AS VARCHAR), 'attack-pattern--' || CAST(n_nationkey AS VARCHAR) FROM nation
        UNION ALL SELECT 'includes', 'strategy--' || CAST(s_nationkey AS VARCHAR), 'analytic--' || CAST(s_suppkey AS VARCHAR) FROM supplier"""
    q["related_objects"] = f"""SELECT a AS stix_id, t || ':' || obj_type AS section, b AS other, name AS other_name, t || ' ' || b AS how FROM ({rels}) JOIN attack ON stix_id = b
        UNION ALL SELECT b, CASE t WHEN 'uses' THEN 'used_by' ELSE t END || ':' || obj_type, a, name, t || ' ' || b FROM ({rels}) JOIN attack ON stix_id = a"""
    q["entity_documents"] = """SELECT stix_id, url, row_number() OVER (PARTITION BY stix_id ORDER BY published_at DESC, url) AS position FROM named
        QUALIFY row_number() OVER (PARTITION BY stix_id ORDER BY published_at DESC, url) <= 25"""
    q["entity_vulnerabilities"] = """SELECT stix_id, cve_id, relevance_score, row_number() OVER (PARTITION BY stix_id ORDER BY relevance_score DESC, cve_id) AS position
        FROM (SELECT DISTINCT stix_id, cve_id FROM co) JOIN score USING (cve_id) QUALIFY row_number() OVER (PARTITION BY stix_id ORDER BY relevance_score DESC, cve_id) <= 50"""
    q["technique_detections"] = """SELECT 'attack-pattern--' || CAST(n_nationkey AS VARCHAR) AS technique, 'DET' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS strategy_id,
          'AN' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS analytic_id, lp AS log_pos, lower(seg) AS log_name, seg AS component_name
        FROM nation JOIN supplier ON s_nationkey = n_nationkey
        LEFT JOIN (SELECT c_nationkey, seg, row_number() OVER (PARTITION BY c_nationkey ORDER BY seg) - 1 AS lp FROM (SELECT DISTINCT c_nationkey, c_mktsegment AS seg FROM customer)) ON c_nationkey = n_nationkey"""
    q["technique_mitigations"] = """SELECT 'attack-pattern--' || CAST(n_nationkey AS VARCHAR) AS technique, 'course-of-action--' || CAST(n_nationkey AS VARCHAR) AS mitigation,
        n_name || ' Mitigation' AS name FROM nation"""

    # profile and exports
    q["profile_sections"] = """SELECT cve_id, section, count(*) AS facts FROM (
          SELECT cve_id, 'overview' AS section FROM vuln UNION ALL SELECT cve_id, 'risk' FROM reasons UNION ALL SELECT cve_id, 'affected_products' FROM prod
          UNION ALL SELECT cve_id, 'exploitation' FROM exploitation
          UNION ALL SELECT cve_id, CASE kind WHEN 'exploit' THEN 'public_exploits' ELSE 'pocs' END FROM cve_ex
          UNION ALL SELECT cve_id, CASE obj_type WHEN 'group' THEN 'threat_actors' WHEN 'campaign' THEN 'campaigns' WHEN 'technique' THEN 'techniques_reported' ELSE 'malware' END FROM co JOIN attack USING (stix_id)
          UNION ALL SELECT cve_id, 'attack' FROM techs WHERE method = 'explicit'
          UNION ALL SELECT cve_id, 'vendor_advisories' FROM vuln WHERE in_kev
          UNION ALL SELECT cve_id, CASE doc_type WHEN 'advisory' THEN 'vendor_advisories' ELSE doc_type END FROM cve_docs
          UNION ALL SELECT cve_id, 'timeline' FROM events_of UNION ALL SELECT cve_id, 'sources' FROM prov) GROUP BY 1, 2"""
    q["timeline"] = f"SELECT cve_id, kind, title, source, {ts('dated')} AS event_at, url FROM events_of"
    q["source_table"] = "SELECT cve_id, kind, source, CAST(tier AS BIGINT) AS tier, url FROM prov"
    q["publishers"] = "SELECT cve_id, source, CAST(tier AS BIGINT) AS tier, url FROM prov QUALIFY row_number() OVER (PARTITION BY cve_id, source ORDER BY tier DESC, url DESC) = 1"
    q["evidence_fragments"] = f"""
        SELECT cve_id, row_number() OVER (PARTITION BY cve_id ORDER BY step, place) AS number, text, source, CAST(tier AS BIGINT) AS tier FROM (
          SELECT cve_id, 0 AS step, '0' AS place, description AS text, 'NVD' AS source, 1 AS tier FROM vuln
          UNION ALL SELECT cve_id, 1, '0', 'CISA KEV: ' || kev_name || '. Required action: Update ' || product || '. Known ransomware use: ' || kev_ransomware || '.', 'CISA KEV', 1 FROM vuln WHERE in_kev
          UNION ALL SELECT cve_id, 2, CAST(r AS VARCHAR) || '|' || url, detail, source, tier FROM exploitation
          UNION ALL SELECT cve_id, 3, lpad(CAST(n AS VARCHAR), 3, '0'), title || '. ' || summary, {source_name('source_key')}, tier FROM (
            SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY CASE doc_type WHEN 'news' THEN 1 ELSE 0 END, published_at DESC, url) AS n FROM cve_docs WHERE doc_type IN ('research', 'news')) WHERE n <= 8
          UNION ALL SELECT cve_id, 4, lpad(CAST(n AS VARCHAR), 3, '0'), 'ATT&CK ' || id || ' ' || name || ' (explicit mapping): About ' || name, 'MITRE ATT&CK', 1 FROM (
            SELECT t.cve_id, t.id, a.name, row_number() OVER (PARTITION BY t.cve_id ORDER BY t.id) AS n FROM techs t JOIN attack a ON a.external_id = t.id AND a.obj_type = 'technique') WHERE n <= 5)
        QUALIFY row_number() OVER (PARTITION BY cve_id ORDER BY step, place) <= 20"""
    rows = {"cve_id": "cve_id", "section": "section", "title": "title", "source": "source", "tier": "CAST(tier AS VARCHAR)", "date": _iso("dated"), "url": "url"}
    q["evidence_csv"] = f"""SELECT {', '.join(f'{_csv_cell(c)} AS {n}' for n, c in rows.items())} FROM (
          SELECT cve_id, 'overview' AS section, title, NULL AS source, NULL AS tier, published AS dated, NULL AS url FROM vtitle
          UNION ALL SELECT cve_id, CASE kind WHEN 'exploit' THEN 'public_exploits' ELSE 'pocs' END, 'Code ' || external_id, {source_name('source_key')}, tier, published_at, 'https://code.example.org/' || external_id FROM cve_ex
          UNION ALL SELECT cve_id, 'timeline:' || kind, title, source, NULL, dated, url FROM events_of
          UNION ALL SELECT cve_id, 'source:' || kind, title, source, tier, dated, url FROM prov)"""
    q["cve_json"] = f"""SELECT cve_id, (number - 1) // 5000 + 1 AS part, section, number, kind, title, source, CAST(tier AS BIGINT) AS tier, {_iso('dated')} AS event_at, url, detail FROM (
          SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY section, dated DESC NULLS LAST, source NULLS LAST, title NULLS LAST, url NULLS LAST, kind NULLS LAST,
            detail NULLS LAST) AS number FROM fact_rows)"""
    stamp = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S.000Z')"
    q["cve_json_heads"] = f"""SELECT s.cve_id, CAST(1 AS BIGINT) AS parts, title AS overview_title, vendor AS overview_vendor, product AS overview_product,
          CAST(relevance_score AS VARCHAR) AS overview_relevance_score, CAST(exploits AS VARCHAR) AS overview_exploit_count, {stamp('published')} AS overview_published,
          CAST(cvss_score AS VARCHAR) AS cvss_score, cvss_severity, ssvc AS ssvc_exploitation, CAST(in_kev AS VARCHAR) AS kev_in_kev, strftime(kev_date, '%Y-%m-%d') AS kev_date_added,
          kev_ransomware AS kev_ransomware_use FROM score s"""
    q["cve_markdown"] = _markdown_sql()
    q["environment_markdown"] = _environment_markdown_sql()

    kind_of = "CASE {} WHEN 'exploitdb' THEN 'Exploit Archive' WHEN 'github' THEN 'Community Repository' WHEN 'unit42' THEN '{o}' WHEN 'talos' THEN '{o}' ELSE 'Security News' END"
    kind_of = kind_of.replace("{o}", "Security Research Organization")
    q["document_rows"] = f"""SELECT url, title, summary, doc_type, CAST(tier AS BIGINT) AS tier, {source_name('source_key')} AS source, {kind_of.format('source_key')} AS source_type,
        CAST(tier AS BIGINT) AS source_tier FROM bulletin"""
    q["exploit_rows"] = f"""SELECT external_id, kind, {source_name('source_key')} AS source, {kind_of.format('source_key')} AS source_type, CAST(tier AS BIGINT) AS source_tier,
        CASE WHEN source_key = 'github' THEN 'Code from the community that nobody has reviewed; keep it inside an isolated lab.' END AS warning FROM ex"""
    q["attack_rows"] = """SELECT stix_id, external_id, obj_type AS type, name, CASE WHEN obj_type = 'technique' THEN 'About ' || name END AS description, mentions
        FROM attack LEFT JOIN mentions USING (stix_id)"""
    q["indicator_rows"] = "SELECT source_key, kind, host, family, attack_stix_id, status FROM ind"
    q["rule_rows"] = "SELECT external_id, title, level, status, CASE WHEN owing THEN cve_id ELSE '' END AS cves, 'sigma' AS source_key FROM rule"
    words = r"""(SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') || ' ' AS body FROM documents)"""
    # with blanks doubled, neighbouring places of a phrase don't share one
    many = lambda p: f"len(regexp_extract_all(replace(body, ' ', '  '), ' {p.replace(' ', '  ')} '))"
    has = lambda p: f"contains(body, ' {p} ')"
    q["phrase_search"] = f"""SELECT doc_id, CAST({many('of the')} + {many('that')} + {many('de la')} + {many('eneau')} AS BIGINT) AS hits FROM {words}
        WHERE ({has('of the')} AND {has('that')} AND NOT {has('die')}) OR ({has('de la')} AND NOT {has('que')}) OR {has('eneau')}"""
    q["unwanted_search"] = f"SELECT doc_id, CAST(0 AS BIGINT) AS hits FROM {words} WHERE NOT {has('the')}"
    q["stream_pulse"] = """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (event_type = 'error') AS exploited,
          count(*) FILTER (event_type = 'purchase') AS kev FROM events GROUP BY date_trunc('day', ts)
        HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY"""
    q["stream_first_seen"] = "SELECT DISTINCT user_id FROM events"
    q["window_trend"] = f"""SELECT event_type, {ts('start')} AS start, CAST(coalesce(sum(c) FILTER (day = start), 0) AS BIGINT) AS before,
          CAST(coalesce(sum(c) FILTER (day <> start), 0) AS BIGINT) AS now, CAST(coalesce(sum(c) FILTER (day <> start), 0) - coalesce(sum(c) FILTER (day = start), 0) AS BIGINT) AS trend FROM (
          SELECT *, unnest([day, day - INTERVAL 1 DAY]) AS start FROM (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS c FROM events GROUP BY 1, 2))
        GROUP BY event_type, start HAVING start + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"""
    # raw payloads and upserts
    q["attack_parse"] = f"""
        SELECT 'technique' AS kind, 'attack-pattern--' || CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, {tid('n_nationkey')} || '|See docs on ' || n_name || '||' || lower(r_name)
          || '|Linux,Windows|' || CAST(n_nationkey % 5 = 0 AS VARCHAR) || '|false' AS detail, CAST(1 AS BIGINT) AS rows FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT {ACTOR_TYPE}, {ACTOR.format('s_suppkey')}, s_name, '||' || CASE WHEN s_suppkey % 10 = 8 THEN '' ELSE 'Actor ' || CAST(s_suppkey AS VARCHAR) END || '|||false|'
          || CAST(s_suppkey % 10 = 4 AS VARCHAR), 1 FROM supplier WHERE s_suppkey % 10 NOT IN (7, 9)
        UNION ALL SELECT 'relationship', 'relationship--' || CAST(s_suppkey AS VARCHAR), 'uses', {ACTOR.format('s_suppkey')} || '>attack-pattern--' || CAST(s_nationkey AS VARCHAR), 1
          FROM supplier WHERE s_suppkey % 10 <> 3
        UNION ALL SELECT 'reject', NULL, NULL, reason, count(*) FROM (
          SELECT CASE s_suppkey % 10 WHEN 7 THEN 'object is not JSON' WHEN 8 THEN 'fields of another type: aliases' ELSE 'object has no name' END AS reason
            FROM supplier WHERE s_suppkey % 10 IN (7, 8, 9)
          UNION ALL SELECT 'object is not a mapping' FROM region) GROUP BY reason"""
    q["rule_parse"] = f"""SELECT 'rule-' || CAST(c_custkey AS VARCHAR) AS external_id, c_name AS title, 'stable' AS status, 'high' AS level, lower(c_mktsegment) AS product,
          'condition: selection' || chr(10) || 'selection:' || chr(10) || '  Image: a.exe' || chr(10) AS detection, {tid('c_nationkey')} AS techniques,
          'CVE-2000-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS cves, CAST(1 AS BIGINT) AS rows FROM customer WHERE c_custkey % 10 NOT IN (7, 8, 9)
        UNION ALL SELECT NULL, reason, NULL, NULL, NULL, NULL, NULL, NULL, count(*) FROM (
          SELECT CASE c_custkey % 10 WHEN 7 THEN 'document is not a mapping' WHEN 8 THEN 'unreadable YAML' ELSE 'rule has no id' END AS reason
          FROM customer WHERE c_custkey % 10 IN (7, 8, 9)) GROUP BY reason"""
    q["date_parse"] = f"""SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN {ts("date_trunc('day', ts)")} ELSE {ts('ts')} END AS parsed,
        CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d') END AS day FROM events"""
    q["kev_parse"] = f"""SELECT {cve('p_partkey')} AS cve_id, p_brand AS vendor, p_name || ' & co' AS product, 'CWE-79' AS cwes,
          'https://vendor.example.com/' || CAST(p_partkey AS VARCHAR) || ' https://nvd.nist.gov/x' AS note_urls, '2001-05-06' AS added, CAST(NULL AS BIGINT) AS rejected
        FROM part WHERE p_type <> 'SMALL' UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, count(*) FROM part WHERE p_type = 'SMALL'"""
    lines = "(SELECT l_partkey, max(l_linenumber) FILTER (l_linenumber < 7) AS top, min(l_linenumber) FILTER (l_linenumber < 7) AS low FROM lineitem GROUP BY 1)"
    q["nvd_parse"] = f"""SELECT {cve('p_partkey')} AS cve_id, 'Bug in ' || p_name AS description,
          CASE WHEN p_type = 'LARGE' THEN 7.5 ELSE round(CAST(p_size AS DOUBLE) / 5.0, 1) END AS cvss_score, CASE WHEN p_type = 'LARGE' THEN 'LOW' ELSE 'HIGH' END AS cvss_severity,
          'poc' AS ssvc_exploitation, 'yes' AS ssvc_automatable, 'CWE-20' AS cwes, p_brand AS primary_vendor, p_name AS primary_product, '2001-02-03 04:05:06' AS published,
          CAST(1 AS BIGINT) AS refs, 'https://x.example.org/' || CAST(p_partkey AS VARCHAR) AS ref_url, 'vendor_advisory' AS ref_type FROM part"""
    q["nvd_products"] = f"""SELECT {cve('p_partkey')} AS cve_id, p_brand AS vendor, p_name AS product, '' AS cpe, '1.1, ' || CAST(p_size AS VARCHAR) AS versions FROM part
        UNION ALL SELECT {cve('p_partkey')}, p_brand, p_name, 'cpe:2.3:a:' || p_brand || ':' || replace(p_name, ' ', '_') || ':*:*', '>= ' || CAST(top AS VARCHAR) || '.0 < 9.0'
        FROM part JOIN {lines} ON p_partkey = l_partkey WHERE top IS NOT NULL"""
    arch = "(SELECT l_orderkey, l_linenumber AS n, min(l_partkey) AS part, CAST(l_orderkey AS VARCHAR) || '00' || CAST(l_linenumber AS VARCHAR) AS id FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber < 7 GROUP BY 1, 2)"
    q["exploit_upsert"] = f"""SELECT id AS external_id, CASE n WHEN 1 THEN 'old' ELSE 'Overflow in line ' || id END AS title, {cve('part')} AS cves,
        CASE n WHEN 1 THEN 'unchanged' WHEN 2 THEN 'updated' ELSE 'new' END AS change, CASE WHEN n <= 2 THEN {ts(AS_OF)} ELSE {ts(EVENTS_AS_OF)} END AS collected_at FROM {arch}"""
    q["repository_parse"] = f"""SELECT 'user' || CAST(c_custkey AS VARCHAR) || '/tool' AS external_id,
          CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'detection' WHEN 'BUILDING' THEN 'scanner' WHEN 'FURNITURE' THEN 'poc' WHEN 'HOUSEHOLD' THEN 'poc' ELSE 'repository' END AS kind,
          CASE WHEN c_nationkey < 20 THEN {cve('c_custkey')} ELSE '' END AS cves, c_custkey AS stars, '2001-01-02 00:00:00' AS pushed
        FROM customer WHERE c_acctbal >= 0 AND (c_mktsegment <> 'HOUSEHOLD' OR c_nationkey < 20)"""
    q["release_documents"] = """SELECT url, title, sha256(title || body) AS content_hash, CASE WHEN body <> '' THEN least(length(body), 600) END AS excerpt FROM (
          SELECT 'https://github.com/org/tool/releases/' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS url,
            'org/tool ' || CASE WHEN role = 'user' THEN '' ELSE 'Release ' END || 'v' || CAST(turn AS VARCHAR) AS title, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body FROM conversations)"""
    q["indicator_refresh"] = """SELECT kind, value_norm, status, CASE WHEN kind <> 'url' THEN 'kept' ELSE
        ['new', 'updated', 'unchanged'][1 + length(value_norm) % 3] END AS change FROM ind"""
    q["latest_documents"] = f"SELECT url, {ts('published_at')} AS published_at FROM bulletin WHERE doc_type = 'research' ORDER BY bulletin.published_at DESC, url LIMIT 8"
    q["page_total"] = "SELECT count(*) AS total FROM score"
    q["feed_parse"] = """SELECT url, 'Page ' || CAST(page_id AS VARCHAR) AS title, '2024-05-01 10:00:00' AS published_at, 'news' AS categories, 'desk' AS authors,
        CAST(3 AS BIGINT) AS tier FROM (""" + q["canonical_url"] + ")"
    q["repository_upsert"] = f"""SELECT external_id, kind, stars, CASE kind WHEN 'scanner' THEN 'new' WHEN 'detection' THEN 'updated' ELSE 'unchanged' END AS change
        FROM ({q["repository_parse"]})"""
    q["rule_upsert"] = """SELECT external_id, 'r2' AS release, CASE WHEN owing THEN 'new' WHEN level = 'low' THEN 'updated' ELSE 'unchanged' END AS change FROM rule"""
    moved = "obj_type IN ('campaign', 'tool', 'tactic')"
    q["attack_upsert"] = f"""SELECT stix_id, CASE WHEN {moved} OR obj_type = 'analytic' THEN name ELSE 'old' END AS name,
        CASE WHEN obj_type = 'analytic' THEN 'new' WHEN obj_type IN ('campaign', 'tool') THEN 'updated' ELSE 'unchanged' END AS change FROM attack"""
    q["stale_documents"] = f"SELECT url, summary AS full_text FROM bulletin WHERE doc_type <> 'news' AND published_at + INTERVAL 1 DAY >= {AS_OF} - INTERVAL 60 DAY"
    q["asset_validation"] = """SELECT CAST(c_custkey AS VARCHAR) AS asset_id, c_name AS label, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'os' WHEN 'BUILDING' THEN 'firewall' ELSE 'switch' END AS category,
        'Acme' AS vendor FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') AND c_acctbal >= 0 AND c_nationkey <> 3"""
    q["payload_cache"] = f"""SELECT CAST(o_custkey AS VARCHAR) AS cve_id, {ts('max(f)')} AS fetched_at, max(f) > {AS_OF} - INTERVAL 365 DAY AS fresh
        FROM (SELECT o_custkey, o_orderdate + to_seconds(o_orderkey % 86400) AS f FROM orders) GROUP BY 1"""

    # the same lists without their limits
    for name in ("entity_documents", "entity_vulnerabilities", "versions_by_product", "evidence_fragments"):
        body, _, _ = q[name].rpartition("QUALIFY")
        q[f"{name}_all"] = body.replace(") WHERE n <= 8", ")").replace(") WHERE n <= 5", ")").replace("AS VARCHAR), 3, '0')", "AS VARCHAR), 12, '0')")

    done = {name: sql(body) for name, body in q.items()}
    asked = """asked AS (SELECT sha1(text) AS query, 'sha1' AS query_kind FROM documents
          UNION SELECT regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), 'domain' FROM pages),
        hits AS (SELECT query, count(*) OVER (PARTITION BY query) AS total, row_number() OVER (PARTITION BY query ORDER BY first_seen DESC, source_key, kind, value_norm) AS position, value_norm
          FROM (SELECT DISTINCT a.query, i.source_key, i.kind, i.value_norm, i.first_seen FROM asked a JOIN ind i ON i.sha1 = a.query OR i.host = a.query)
          QUALIFY row_number() OVER (PARTITION BY query ORDER BY first_seen DESC, source_key, kind, value_norm) <= 50)"""
    base = sql("SELECT 1 FROM ind").removesuffix("\nSELECT 1 FROM ind")
    done["indicator_lookup"] = f"{base},\n{asked}\n" + q["indicator_lookup"].replace("WITH_SPLIT", "")
    listed = sql("""SELECT owner_id, asset_id, cve_id, state, method, confidence, evidence, CAST(exposure AS BIGINT) AS exposure FROM exposed WHERE reaching""")
    owned = sql("SELECT owner_id, 'env-' || owner_id AS environment_id, asset_id, product, version FROM asset")
    for name, body in (("match_list", listed), ("asset_put_delete", owned)):
        done[name] = body.replace(CTES["asset"], CHANGED_FLEET.replace("{fleet}", FLEET))
    for name in FLEET_QUERIES:
        done[f"{name}_fleet"] = done[name].replace(CTES["asset"], FLEET).replace("owner_id = 'SMALL'", "owner_id = 'site-0'").replace(
            "owner_id = 'LARGE'", "owner_id = 'site-0'")
    return done
