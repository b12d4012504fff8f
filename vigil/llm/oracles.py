"""DuckDB answers for the operators' queries, where SQL can express them.

Quality, language and toxicity scores are learned and have none; they are tested for held-out accuracy. The spans of
secrets that inferred formats add are learned too, so that query is tested against brute force for its base spans.
Token ids come from libraries, so alignment and token files are tested against brute force as well.
"""

from __future__ import annotations

_NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_NORMAL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1 = f"""
WITH t AS (SELECT doc_id, {_NORMAL} AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g USING (body)"""

# all pairs of different sets that share an n-gram, their exact similarity, and classes by recursion
OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
grams AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(2, len(ws) - 3)),
            lambda i: array_to_string(ws[i:i + 4], ' ')))) AS gs FROM w WHERE len(ws) > 0),
sets AS (SELECT gs, min(doc_id) AS rep, count(*) AS copies FROM grams GROUP BY gs),
items AS (SELECT rep, unnest(gs) AS g FROM sets),
pairs AS (SELECT a.rep AS x, b.rep AS y, count(*) AS common FROM items a JOIN items b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL),
links AS (SELECT x, y, sy.copies FROM pairs JOIN sets sx ON sx.rep = x JOIN sets sy ON sy.rep = y
          WHERE common * 5 >= 4 * (len(sx.gs) + len(sy.gs) - common)),
reach AS (SELECT rep AS x, rep AS y FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
classes AS (SELECT x AS rep, min(y) AS class_id FROM reach GROUP BY x),
counts AS (SELECT x AS rep, sum(copies) AS linked FROM links GROUP BY x),
sizes AS (SELECT class_id, sum(copies)::BIGINT AS class_size FROM classes JOIN sets USING (rep) GROUP BY class_id)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(z.class_size, 1)::BIGINT AS class_size,
       (coalesce(s.copies - 1, 0) + coalesce(n.linked, 0))::BIGINT AS n_links
FROM documents d LEFT JOIN grams USING (doc_id) LEFT JOIN sets s USING (gs) LEFT JOIN classes c USING (rep)
LEFT JOIN sizes z USING (class_id) LEFT JOIN counts n USING (rep)"""

OP5 = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + len(role) + 2 + 8 + len(replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '### ', '\h')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id"""

OP6 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS span,
         unnest(list_transform(range(1, len(ws) - least(len(ws), 13) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 13) - 1], ' '))) AS win
       FROM b WHERE len(ws) > 0),
spans AS (SELECT DISTINCT span FROM iw),
dw AS (SELECT doc_id, span, unnest(range(1, len(ws) - span + 2)) AS s,
         unnest(list_transform(range(1, len(ws) - span + 2), lambda i: array_to_string(ws[i:i + span - 1], ' '))) AS win
       FROM d CROSS JOIN spans),
m AS (SELECT dw.doc_id, dw.s, dw.span, iw.item_id FROM dw JOIN iw USING (span, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + span)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""

# five hexadecimal digits are four letters of base32
OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS first_id FROM p GROUP BY html),
h AS (SELECT p.page_id, p.html, g.first_id, sha1(p.html) AS digest FROM p JOIN g USING (html))
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(digest, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, u.url, true AS intact
FROM h JOIN (SELECT page_id, url FROM pages) u USING (page_id)"""

OP8 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER o_before, 0))::DOUBLE / (sum(weight) OVER o_rest)::DOUBLE AS level
      FROM w WINDOW o_before AS (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    o_rest AS (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (SELECT source, source_size, least((source_size * 3)::DOUBLE, max(level) OVER () * weight) AS target,
        ('0x' || substr(md5('7:' || coalesce('s' || source, 'n')), 1, 5))::INT / 1048576.0::DOUBLE AS shift FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.shift, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0 END AS rate,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id NULLS FIRST) AS rank
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate * rank + shift) - floor(rate * (rank - 1) + shift))::BIGINT * size)::BIGINT AS taken FROM r"""



def _merkle(leaf_levels: int = 7, top_levels: int = 3) -> str:
    """Levels are unrolled: enough for 8 ** 7 leaves of a language and 8 ** 3 languages."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    # the CRC-32 comes from the id's digits by its table-free definition, eight shifts a byte
    shifted = "list_reduce(list_prepend(xor(r, b), range(8)), lambda q, k: CASE WHEN q & 1 = 1 THEN xor(q >> 1, 3988292384) ELSE q >> 1 END)"
    digits = "list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda r, b: {shifted}), 4294967295)"
    parts = [f"""
h AS (SELECT doc_id, lang, sha256({head} || {field('text')}) AS leaf,
        CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {field(lowered)}) END AS tampered FROM documents),
p0 AS (SELECT doc_id, lang, leaf, coalesce(tampered, leaf) AS f, '' AS proof, leaf AS dg, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY lang) AS n FROM h),
n0 AS (SELECT lang, i, dg, n FROM p0)"""]
    step = """
{r} AS (SELECT lang, i // 8 AS run, n, list(dg ORDER BY i) AS ds FROM {n} GROUP BY ALL),
{n1} AS (SELECT lang, run AS i, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS dg, (n + 7) // 8 AS n FROM {r}),
{p1} AS (SELECT p.* REPLACE (p.i // 8 AS i, (p.n + 7) // 8 AS n,
           CASE WHEN p.n > 1 THEN sha256(array_to_string(ds[1:p.i % 8], '') || f || array_to_string(ds[p.i % 8 + 2:], '')) ELSE f END AS f,
           CASE WHEN p.n > 1 THEN proof || array_to_string(ds[1:p.i % 8], '') || array_to_string(ds[p.i % 8 + 2:], '') ELSE proof END AS proof)
         FROM {p} p JOIN {r} r ON p.lang IS NOT DISTINCT FROM r.lang AND p.i // 8 = r.run)"""
    for k in range(leaf_levels):
        parts.append(step.format(r=f"r{k}", n=f"n{k}", n1=f"n{k + 1}", p=f"p{k}", p1=f"p{k + 1}"))
    parts.append(f"""
s AS (SELECT lang, dg AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM n{leaf_levels}),
t0 AS (SELECT NULL::VARCHAR AS lang, i, subroot AS dg, n FROM s),
q0 AS (SELECT p.doc_id, NULL::VARCHAR AS lang, p.leaf, p.f, p.proof, s.subroot AS dg, s.i, s.n FROM p{leaf_levels} p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang)""")
    for k in range(top_levels):
        parts.append(step.format(r=f"u{k}", n=f"t{k}", n1=f"t{k + 1}", p=f"q{k}", p1=f"q{k + 1}"))
    return "WITH " + ",".join(parts) + f"""
SELECT doc_id, leaf, q.dg AS subroot, t.dg AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.dg AS verified
FROM q{top_levels} q CROSS JOIN t{top_levels} t"""


ORACLES = {"op1_exact_dedup": OP1, "op2_jaccard_join": OP2, "op5_chat_format": OP5, "op6_decontaminate": OP6, "op7_warc": OP7, "op8_mixing": OP8,
           "op11_merkle_manifest": _merkle()}
