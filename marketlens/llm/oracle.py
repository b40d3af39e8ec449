"""DuckDB SQL for the corpus queries that SQL can express on whole tables.

Language ID (4), toxicity (3) and quality (5) are fitted models and have none;
their tests measure held-out accuracy.  Substring dedup (10) is tested against
brute force.
"""

from __future__ import annotations

from marketlens.llm.mixing import BLOCK_ROWS, WEIGHTS
from marketlens.llm.url_filter import RULES

_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _fold(x: str) -> str:
    return f"translate({x}, '{_UP}', '{_UP.lower()}')"


_URL = r"'^(?s:.*?)://([^/?#]*)([^?#]*)'"
OP1 = f"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
         {_fold(f"regexp_extract(coalesce(url, ''), {_URL}, 1)")} AS host,
         regexp_extract(coalesce(url, ''), {_URL}, 2) AS path
  FROM pages),
r(h, p, v) AS (VALUES {", ".join(str(t) for t in RULES)}),
fit AS (
  SELECT rid, page_id, host, path, h || p AS rule, v,
         row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC, length(h) DESC, v <> 'block', h || p) AS nth
  FROM p LEFT JOIN r ON host <> '' AND (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fit WHERE nth = 1
"""

_CASE = " ".join(f"WHEN '={k}' THEN {w}" for k, w in WEIGHTS.items())
OP2 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS src,
         row_number() OVER (PARTITION BY coalesce('=' || source, '') ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST) - 1 AS j
  FROM documents),
q AS (SELECT src, count(*) AS n, (CASE src {_CASE} ELSE 1 END)::BIGINT AS q FROM d GROUP BY src),
one AS (SELECT list(src ORDER BY src) AS names, list(q ORDER BY src) AS qs, sum(q)::BIGINT AS frame FROM q),
f(t, done, won) AS (
  SELECT 0::BIGINT, list_transform(qs, lambda x: 0::BIGINT), 0::BIGINT FROM one
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, i: x + CASE WHEN i = w THEN 1 ELSE 0 END), w::BIGINT FROM (
    SELECT t, done, list_position(dl, list_min(dl)) AS w FROM (
      SELECT t, done, list_transform(done, lambda x, i: CASE WHEN x * frame <= t * qs[i]
               THEN ((x + 1) * frame + qs[i] - 1) // qs[i] ELSE 9223372036854775807 END) AS dl
      FROM f, one WHERE t < frame))),
turns AS (
  SELECT names[won] AS src, qs[won] AS q, frame, t - 1 AS slot, row_number() OVER (PARTITION BY won ORDER BY t) - 1 AS turn
  FROM f, one WHERE t > 0),
last AS (
  SELECT min(((n + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} - 1) // t.q * frame + slot) AS until
  FROM q JOIN turns t USING (src) WHERE turn = ((n + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} - 1) % t.q)
SELECT doc_id, source, j // {BLOCK_ROWS} AS block, j // {BLOCK_ROWS} // q * frame + slot AS slot, j % {BLOCK_ROWS} AS pos,
       j // {BLOCK_ROWS} // q * frame + slot <= until AS on_target
FROM d JOIN turns t ON t.src = d.src AND turn = j // {BLOCK_ROWS} % q, last
"""

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, i, ls[i] AS line, {_fold(f"trim(ls[i], {_BLANK})")} AS k FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
hot AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT rid, l.doc_id, i, line, keeper IS NOT NULL AND l.doc_id IS DISTINCT FROM keeper AS gone FROM l LEFT JOIN hot USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""

OP7 = rf"""
WITH RECURSIVE w AS (
  SELECT DISTINCT doc_id, regexp_extract_all({_fold("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
  FROM w, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM sh a JOIN sh b USING (s) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT doc_id, doc_id AS node FROM n UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.node),
c AS (SELECT doc_id, min(node) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings),
e AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.95),
r AS (SELECT vec_id, vec_id AS node FROM v UNION SELECT r.vec_id, e.w FROM r JOIN e ON e.u = r.node),
c AS (SELECT vec_id, min(node) AS c FROM r GROUP BY vec_id),
k AS (SELECT u, count(DISTINCT w) AS n FROM e GROUP BY u)
SELECT v.vec_id, coalesce(n, 0) AS n_links, c AS component_id, c = v.vec_id AS kept
FROM v LEFT JOIN k ON k.u = v.vec_id JOIN c ON c.vec_id = v.vec_id
"""

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP9 = f"""
WITH b AS (SELECT item_id, regexp_extract_all({_fold("text")}, {_WORDS}) AS ws FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS k, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(ws) - 12, least(len(ws), 1)) + 1)) AS t(i)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_fold("coalesce(text, '')")}, {_WORDS}) AS ws FROM documents),
ks AS (SELECT DISTINCT k FROM bw),
h AS (
  SELECT rid, i, bw.k, item_id
  FROM (SELECT rid, i, k, array_to_string(ws[i:i + k - 1], ' ') AS s FROM d, ks, unnest(range(1, len(ws) - k + 2)) AS t(i)) p
  JOIN bw ON bw.k = p.k AND bw.s = p.s),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM h) GROUP BY rid),
best AS (  -- longest run of windows on one diagonal, as covered words
  SELECT rid, max(n) AS longest FROM (
    SELECT rid, item_id, diag, run, max(i + k) - min(i) AS n FROM (
      SELECT rid, item_id, i, k, diag, i - row_number() OVER (PARTITION BY rid, item_id, diag ORDER BY i) AS run FROM (
        SELECT DISTINCT h.rid, h.item_id, h.i, h.k, h.i - bi.j AS diag FROM h
        JOIN (SELECT item_id, i AS j, least(len(ws), 13) AS k, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS s
              FROM b, unnest(range(1, greatest(len(ws) - 12, least(len(ws), 1)) + 1)) AS t(i)) bi
          ON bi.item_id = h.item_id AND bi.k = h.k
        JOIN d ON d.rid = h.rid AND bi.s = array_to_string(d.ws[h.i:h.i + h.k - 1], ' ')))
    GROUP BY rid, item_id, diag, run)
  GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, coalesce(longest, 0) AS longest_match
FROM d LEFT JOIN hw USING (rid) LEFT JOIN it USING (rid) LEFT JOIN best USING (rid)
"""

_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_fold("text")}, {_TERMS}) AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS N, sum(len(ws))::BIGINT AS L FROM d WHERE len(ws) > 0),
b AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all({_fold("text")}, {_TERMS}) AS ws FROM benchmark WHERE text IS NOT NULL),
qt AS (SELECT q, t, count(*) AS times FROM (SELECT q, unnest(ws) AS t FROM b) GROUP BY q, t),
p AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY rid, t),
w AS (SELECT t, floor(1000 * ln((2.0::DOUBLE * any_value(N) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t),
m AS (SELECT rid, doc_id, 75 + (25 * len(ws) * N) // L AS m FROM d, s WHERE len(ws) > 0),
r AS (
  SELECT q, rid, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM qt JOIN p USING (t) JOIN w USING (t) JOIN m USING (rid) GROUP BY q, rid),
k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k JOIN b USING (q) WHERE rank <= 20
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_CRC = """xor(list_reduce([4294967295]::BIGINT[] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
          lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)"""
OP13 = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
l AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS g, {_leaf('text')} AS leaf,
         CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(_fold('text'))} END AS claim
  FROM documents, crc),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l),
t(level, g, pos, n, d) AS (
  SELECT 0, g, pos, n, leaf FROM p
  UNION ALL
  SELECT level + 1, g, pos // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY level, g, pos // 8, (n + 7) // 8),
sub AS (SELECT g, d, level AS height, row_number() OVER (ORDER BY g) - 1 AS gpos, count(*) OVER () AS gn FROM t WHERE n = 1),
u(level, pos, n, d) AS (
  SELECT 0, gpos, gn, d FROM sub
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 8, (n + 7) // 8),
top AS (SELECT d AS root, level AS rises FROM u WHERE n = 1),
sib AS (  -- a document's siblings, step by step
  SELECT p.rid, t.level AS step, t.pos < p.pos >> (3 * t.level) AS before, t.pos, t.d
  FROM p JOIN t ON t.g = p.g AND t.n > 1 AND t.pos >> 3 = p.pos >> (3 * (t.level + 1)) AND t.pos <> p.pos >> (3 * t.level)
  UNION ALL
  SELECT p.rid, height + u.level, u.pos < gpos >> (3 * u.level), u.pos, u.d
  FROM p JOIN sub USING (g) JOIN u ON u.n > 1 AND u.pos >> 3 = gpos >> (3 * (u.level + 1)) AND u.pos <> gpos >> (3 * u.level)),
side AS (SELECT rid, step, coalesce(string_agg(d, '' ORDER BY pos) FILTER (before), '') AS lo,
                coalesce(string_agg(d, '' ORDER BY pos) FILTER (NOT before), '') AS hi FROM sib GROUP BY rid, step),
proof AS (SELECT rid, string_agg(lo || hi, '' ORDER BY step) AS bytes FROM side GROUP BY rid),
f(rid, step, steps, d) AS (
  SELECT rid, 0, height + rises, coalesce(claim, leaf) FROM p JOIN sub USING (g), top
  UNION ALL
  SELECT f.rid, f.step + 1, f.steps, sha256(coalesce(lo, '') || f.d || coalesce(hi, ''))
  FROM f LEFT JOIN side ON side.rid = f.rid AND side.step = f.step WHERE f.step < f.steps)
SELECT p.doc_id, leaf, sub.d AS subroot, root, sha256(coalesce(bytes, '')) AS proof_sha256, f.d AS folded_root, f.d = root AS verified
FROM p JOIN sub USING (g) LEFT JOIN proof USING (rid) JOIN f ON f.rid = p.rid AND f.step = f.steps, top
"""

SQL: dict[str, str] = {
    "op1_url_filter": OP1, "op2_mix_sources": OP2, "op6_line_dedup": OP6, "op7_minhash": OP7,
    "op8_embedding_dedup": OP8, "op9_decontaminate": OP9, "op12_ranked_search": OP12, "op13_merkle_manifest": OP13,
}
