"""The operators' results as DuckDB SQL, where SQL can express them.

Encoders, trained models, periodic runs and min-hash passages are beyond it, or too slow in it; tests
hold those against plain Python, the tokenizers library and held-out rows.
"""

from __future__ import annotations

from quarryline.llm import secret_scan, url_filter

_UPPER, _LOWER = url_filter.UPPER, url_filter.LOWER

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, len(win) AS n, array_to_string(win, ' ') AS win FROM (
    SELECT item_id, w[i:i + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0))),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows)),
hits AS (SELECT p.doc_id, p.i, p.n, v.item_id FROM places p JOIN windows v ON v.n = p.n AND v.win = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP4 = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], {_SPACE}), '{_UPPER}', '{_LOWER}') AS k FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split)),
first_holder AS (SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT l.*, f.owner IS NOT NULL AND f.owner <> l.doc_id AS gone FROM lines l LEFT JOIN first_holder f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY 1
"""

_REACH = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT e.b, r.seen FROM reach r JOIN both_ways e ON r.node = e.a),
component AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY 1)"""

OP7 = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)),
{_REACH}
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM docs d LEFT JOIN sizes s USING (doc_id) LEFT JOIN component c ON c.node = d.doc_id
"""

OP10 = f"""
WITH RECURSIVE ok AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND len(p.v) = len(q.v) AND p.vec_id < q.vec_id WHERE list_cosine_similarity(p.v, q.v) >= 0.93),
{_REACH},
degree AS (SELECT a AS node, count(*) AS n FROM both_ways GROUP BY 1)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN degree d ON d.node = e.vec_id LEFT JOIN component c ON c.node = e.vec_id
"""


def _rule_cases() -> tuple[str, str]:
    ordered = sorted(url_filter.RULES, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in ordered]
    return tuple("CASE " + " ".join(f"WHEN {w} THEN '{r[k]}'" for w, *r in fits) + " END" for k in (0, 1))


def _tagged(tag: str, words: str) -> str:
    return f"list_transform(list_filter({words}, lambda w: w <> '' AND NOT regexp_matches(w, '^[0-9]+$')), lambda w: '{tag}' || w)"


_RULE, _VERDICT = _rule_cases()
#: All subsets of a row's tokens, as sorted lists.
_SUBSETS = """{name} AS (SELECT id, tokens, 0 AS upto, CAST([] AS VARCHAR[]) AS s FROM {source} UNION ALL
  SELECT id, tokens, t.i, list_append(s, tokens[t.i]) FROM {name}, LATERAL (SELECT unnest(range(upto + 1, len(tokens) + 1)) AS i) t)"""

OP8 = rf"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
hosts AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM parts),
named AS (SELECT *, translate(path, '{_UPPER}', '{_LOWER}') AS p FROM hosts),
judged AS (SELECT page_id, host, path, {_RULE} AS rule, {_VERDICT} AS fixed, list_sort(list_distinct(list_concat(list_concat({_tagged("h:", "string_split_regex(host, '[.-]')")}, {_tagged("p:", r"string_split_regex(regexp_replace(p, '\.[a-z0-9]+$', ''), '[/._-]+')")}),
  list_concat({_tagged("x:", r"[regexp_extract(p, '\.([a-z0-9]+)$', 1)]")}, {_tagged("q:", r"list_transform(string_split(regexp_extract(coalesce(url, ''), '\?([^#]*)', 1), '&'), lambda kv: string_split(kv, '=')[1])")})))) AS tokens FROM named),
taught AS (SELECT row_number() OVER () AS id, tokens, fixed FROM judged WHERE rule IS NOT NULL AND len(tokens) > 0),
least AS (SELECT ceil(greatest({url_filter.MIN_SUPPORT}, {url_filter.MIN_COUNT} / count(*)) * count(*) - 1e-9) AS n FROM taught),
common AS (SELECT t AS token FROM (SELECT unnest(tokens) AS t FROM taught) GROUP BY 1 HAVING count(*) >= (SELECT n FROM least)),
thin AS (SELECT id, list_sort(list_intersect(tokens, (SELECT coalesce(list(token), CAST([] AS VARCHAR[])) FROM common))) AS tokens FROM taught),
{_SUBSETS.format(name="sub", source="thin")},
freq AS (SELECT s, count(*) AS n FROM sub WHERE len(s) > 0 GROUP BY 1),
with_label AS (SELECT s, fixed AS label, count(*) AS n FROM sub JOIN taught USING (id) WHERE len(s) > 0 GROUP BY 1, 2),
rules AS (SELECT s, label, w.n / f.n AS confidence FROM with_label w JOIN freq f USING (s) WHERE w.n >= (SELECT n FROM least) AND w.n / f.n >= {url_filter.MIN_CONFIDENCE}),
parts_of AS (SELECT s, label, confidence, list_filter(s, lambda t, i: i <> k) AS part FROM (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM rules WHERE len(s) > 1)),
best AS (SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM parts_of p JOIN rules q ON q.s = p.part AND q.label = p.label AND q.confidence >= p.confidence WHERE p.s = r.s AND p.label = r.label)),
open_sets AS (SELECT DISTINCT tokens AS whole, list_sort(list_intersect(tokens, (SELECT coalesce(list(token), CAST([] AS VARCHAR[])) FROM common))) AS tokens FROM judged WHERE rule IS NULL),
asked AS (SELECT row_number() OVER () AS id, tokens FROM (SELECT DISTINCT tokens FROM open_sets)),
{_SUBSETS.format(name="osub", source="asked")},
matched AS (SELECT o.tokens, b.label, row_number() OVER (PARTITION BY o.id ORDER BY b.confidence DESC, len(b.s) DESC, b.s, b.label) AS k FROM osub o JOIN best b ON b.s = o.s),
labels_of AS (SELECT w.whole, m.label FROM open_sets w JOIN matched m ON m.tokens = w.tokens AND m.k = 1)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN fixed ELSE coalesce(l.label, 'allow') END AS verdict FROM judged j LEFT JOIN labels_of l ON j.rule IS NULL AND l.whole = j.tokens
"""


def _spans(pattern: str, kind: int, value: int = 0, least: int = 0) -> str:
    quoted = pattern.replace("'", "''")
    drop = f" WHERE length(v) >= {least}" if least else ""
    return f"""SELECT row_no, {kind} AS kind, s, s + length(m) AS e, v FROM (SELECT row_no, ms[i] AS m, vs[i] AS v, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
    FROM (SELECT row_no, ms, vs, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT row_no, regexp_extract_all(body, '{quoted}') AS ms, regexp_extract_all(body, '{quoted}', {value}) AS vs, string_split_regex(body, '{quoted}') AS gaps FROM docs))){drop}"""


OP9 = f"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, source, coalesce(text, '') AS body FROM documents),
base AS ({_spans(secret_scan.ASSIGN, 0, 2, secret_scan.ASSIGN_LEAST)} UNION ALL {_spans(secret_scan.ACCESS, 1)} UNION ALL {_spans(secret_scan.HEX, 2)}),
wide AS (SELECT * FROM ({_spans(secret_scan.WIDE, 3)}) w WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= {secret_scan.LIVE_CHARACTERS}
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row_no = w.row_no AND b.s < w.e AND w.s < b.e)),
candidates AS (SELECT * FROM base UNION ALL SELECT * FROM wide),
owners AS (SELECT v, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repositories FROM candidates JOIN docs USING (row_no) GROUP BY 1),
marked AS (SELECT c.*, o.owners, kind < 3 OR (owners <= 1 AND repositories < {secret_scan.COPIED_REPOSITORIES}) AS shown FROM candidates c JOIN owners o USING (v)),
named AS (SELECT *, (['assign', 'access', 'hex', 'owned'])[kind + 1] || ':' || s || ':' || e AS label FROM marked),
per AS (SELECT row_no, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(label, ',' ORDER BY s, kind) FILTER (kind < 3) AS base_text,
  string_agg(label, ',' ORDER BY s, kind) FILTER (shown) AS spans, count(*) FILTER (kind = 3 AND shown) AS n_owned, count(*) FILTER (owners >= {secret_scan.EXAMPLE_OWNERS}) AS n_example FROM named GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base_text, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_owned, 0)::BIGINT AS n_owned, coalesce(n_example, 0)::BIGINT AS n_example FROM docs LEFT JOIN per USING (row_no)
"""

OP13 = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM whole a JOIN whole r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""

SQL = {
    "op1_decontamination": OP1,
    "op4_line_dedup": OP4,
    "op7_minhash_near_dedup": OP7,
    "op8_url_filter": OP8,
    "op9_secret_scan": OP9,
    "op10_embedding_near_dedup": OP10,
    "op13_hard_negatives": OP13,
}
