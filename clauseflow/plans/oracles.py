"""DuckDB SQL for the registered queries: what the relational tables alone say of the contracts made of them."""

from __future__ import annotations

_ITEMS = """it AS (
  SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS p, l_suppkey AS s, CAST(l_shipdate AS DATE) AS d, l_returnflag AS f,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_returnflag) AS r
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
per AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderkey % 3 + 1 AS m FROM orders),
n AS (SELECT per.k, per.c, per.cents, per.m, count(it.r) AS n FROM per LEFT JOIN it ON it.k = per.k GROUP BY ALL),
cl AS (  -- every clause: its place, level and number of blocks
  SELECT k, 1 AS q, 0 AS lv, 3 AS b, '前言' AS label FROM per
  UNION ALL SELECT k, 2, 2, 2, '第一条' FROM per
  UNION ALL SELECT k, 2 + r, CASE (ln + p) % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END, 2,
    CASE (ln + p) % 4 WHEN 0 THEN '第' || r || '章' WHEN 1 THEN '第' || r || '条' WHEN 2 THEN '第' || r || '款' ELSE '（' || r || '）' END FROM it
  UNION ALL SELECT k, 2 + n + i, 1, CASE WHEN i = m THEN 2 ELSE 1 END, '附件' || i FROM n, generate_series(1, 3) g(i) WHERE i <= m)"""
_PAID = "(cents, cents * 3 // 10, cents - cents * 3 // 10 + CASE WHEN k % 7 = 0 THEN 10000 ELSE 0 END)"


def _number(cents: str) -> str:
    return f"CASE WHEN ({cents}) % 100 = 0 THEN CAST(({cents}) // 100 AS VARCHAR) ELSE CAST(({cents}) // 100 AS VARCHAR) || '.' || lpad(CAST(({cents}) % 100 AS VARCHAR), 2, '0') END"


_MONEY = f"""amt AS (
  SELECT k, '合同总价' AS role, {_number("cents")} AS normalized, 1 AS o FROM per
  UNION ALL SELECT k, '首付款', {_number("cents * 3 // 10")}, 2 FROM per
  UNION ALL SELECT k, '余款', {_number("cents - cents * 3 // 10 + CASE WHEN k % 7 = 0 THEN 10000 ELSE 0 END")}, 3 FROM per)"""

_TOKENS = """u AS (SELECT {id} AS id, regexp_extract_all(lower({text}), '[\\x{{4e00}}-\\x{{9fff}}]|[0-9a-z]+') AS t FROM {table}),
tok AS (SELECT id, list_concat(t, list_filter(list_transform(generate_series(1, len(t) - 1), lambda i: CASE WHEN length(t[i]) = 1 AND length(t[i + 1]) = 1 THEN t[i] || t[i + 1] END), lambda x: x IS NOT NULL)) AS t FROM u)"""
_DOC_TOKENS = _TOKENS.format(id="doc_id", text="text", table="documents")


def _bm25(limit: int, repeats: bool = False, among: str = "TRUE") -> str:
    """BM25 of all documents for the texts of those whose id is a multiple of 50; only hits of `among` are ranked."""
    times = "count(*)" if repeats else "1"
    return f"""{_DOC_TOKENS},
post AS (SELECT id, token, count(*) AS tf, any_value(ln) AS ln FROM (SELECT id, len(t) AS ln, unnest(t) AS token FROM tok) GROUP BY id, token),
av AS (SELECT count(*) AS n, avg(len(t)) AS m FROM tok),
dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token),
qs AS (SELECT query_id, token, {times} AS times FROM (SELECT id AS query_id, unnest(t) AS token FROM tok WHERE id % 50 = 0) GROUP BY query_id, token),
sc AS (SELECT query_id, id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * post.ln / m))) AS s
       FROM post JOIN qs USING (token) JOIN dfs USING (token), av WHERE id IN (SELECT doc_id FROM documents WHERE {among}) GROUP BY query_id, id),
sparse AS (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS rank FROM sc QUALIFY rank <= {limit})"""


_COSINE = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_CAND = """cand AS (SELECT k, 'KC' || lpad(CAST(r AS VARCHAR), 4, '0') AS id, r, CASE f WHEN 'R' THEN 'date_conflict' WHEN 'A' THEN 'zero_rent' ELSE 'unfair_term' END AS code,
  CASE p % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, 'C' || lpad(CAST(ln AS VARCHAR), 4, '0') AS clause, p, s, 0.5 + (s % 4) / 10.0 AS sure FROM it)"""
_KINDS = "['legal_risk', 'commercial_unreasonable', 'rights_imbalance', 'performance_risk', 'insufficient_facts', 'need_more_material', 'no_substantive_risk']"
_JUDGED = f"""{_CAND}, j AS (SELECT *, {_KINDS}[s % 7 + 1] AS category, p % 5 <> 0 AS decided, p % 2 = 0 AS keep FROM cand),
risk AS (SELECT *, CASE WHEN decided THEN 0.9 ELSE 0.5 END AS confidence,
  (NOT decided) OR (decided AND NOT keep AND category <> 'no_substantive_risk') OR category IN ('insufficient_facts', 'need_more_material') OR (decided AND p % 7 = 0) AS review
  FROM j WHERE NOT decided OR keep OR category <> 'no_substantive_risk'),
sig AS (SELECT DISTINCT k, 'C' || lpad(CAST(ln AS VARCHAR), 4, '0') AS clause FROM it WHERE p % 11 = 0),
fused AS (SELECT risk.k, code, risk.clause, arg_min(severity, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS severity,
  max(confidence) + CASE WHEN any_value(sig.clause) IS NOT NULL AND code IN ('zero_rent', 'date_conflict') THEN 0.1 ELSE 0 END AS confidence,
  any_value(sig.clause) IS NOT NULL AND code IN ('zero_rent', 'date_conflict') AS cross_validated, bool_or(review) AS review_required
  FROM risk LEFT JOIN sig ON sig.k = risk.k AND sig.clause = risk.clause GROUP BY risk.k, code, risk.clause)"""
_DAY = "strftime({}, '%Y-%m-%d')"
_REVERSED = "SELECT DISTINCT k, strftime(d + 30, '%Y-%m-%d') AS a, strftime(d, '%Y-%m-%d') AS b FROM it WHERE p % 11 = 0"

ORACLES = {
    "clean_text_lines": """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(translate(text, chr(160) || chr(12288), '  '), '\\r\\n|[\\n\\x0B\\x0C\\r\\x{85}\\x{2028}\\x{2029}]'), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, len(l) AS n_lines, length(array_to_string(l, chr(10))) AS n_clean FROM l""",
    "text_source_blocks": """WITH p AS (SELECT doc_id, unnest(string_split_regex(text, '\\n\\s*\\n|\\r?\\n')) AS x, generate_subscripts(string_split_regex(text, '\\n\\s*\\n|\\r?\\n'), 1) AS i FROM documents),
c AS (SELECT doc_id, i, trim(regexp_replace(x, '[ \\t]+', ' ', 'g')) AS x FROM p)
SELECT doc_id AS contract_id, count(*) AS n_blocks, CAST(sum(length(x)) AS BIGINT) AS n_chars, max(i) AS last_line FROM c WHERE x <> '' GROUP BY doc_id""",
    "tokenize_stats": f"WITH {_DOC_TOKENS} SELECT id AS doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM tok",
    "contract_ids": "SELECT doc_id, 'c-' || substr(sha256('doc' || doc_id || '.txt' || chr(0) || text), 1, 12) AS contract_id FROM documents",
    "heading_levels": f"""WITH {_ITEMS} SELECT k AS contract_id, CAST(lv AS INTEGER) AS level, CASE WHEN label LIKE '%章' THEN 'chapter' WHEN label LIKE '%条' THEN 'article' WHEN label LIKE '%款' THEN 'paragraph' WHEN label LIKE '附件%' THEN 'appendix' ELSE 'arabic_item' END AS heading_kind, count(*) AS n FROM cl WHERE lv > 0 GROUP BY ALL""",
    "boundary_relations": f"""WITH {_ITEMS} SELECT k AS contract_id, CASE WHEN lv <= 2 THEN 'NEW_CLAUSE' ELSE 'NEW_SUBCLAUSE' END AS relation, count(*) AS n, CAST(0 AS BIGINT) AS n_review FROM cl WHERE lv > 0 GROUP BY ALL
UNION ALL SELECT k, 'SAME_CLAUSE', CAST(sum(b - 1) AS BIGINT), CAST(sum(b - 1) AS BIGINT) FROM cl GROUP BY k""",
    "clause_groups": f"WITH {_ITEMS} SELECT k AS contract_id, CAST(q AS INTEGER) AS clause_seq, CAST(lv AS INTEGER) AS level, CAST(b AS INTEGER) AS n_blocks FROM cl",
    "clause_parents": f"""WITH {_ITEMS} SELECT c.k AS contract_id, CAST(c.q AS INTEGER) AS clause_seq, CAST(max(o.q) AS INTEGER) AS parent_seq
FROM cl c LEFT JOIN cl o ON o.k = c.k AND o.q < c.q AND o.lv < c.lv AND o.lv > 0 GROUP BY c.k, c.q""",
    "doc_stats": f"WITH {_ITEMS} SELECT k AS contract_id, CAST(sum(b) AS BIGINT) AS blocks, count(*) AS clauses, CAST(sum(b - 1) AS BIGINT) AS review_boundaries FROM cl GROUP BY k",
    "validation_seeded": f"""WITH {_ITEMS}, first AS (SELECT k, n.n FROM n), iss AS (
  SELECT k, 'duplicate_block_id' AS code, 'error' AS severity, false AS refixable, 1 AS n FROM first WHERE k % 6 = 0
  UNION ALL SELECT k, 'orphan_block_reference', 'error', false, 1 FROM first WHERE k % 8 = 0
  UNION ALL SELECT k, 'orphan_block_reference', 'error', false, 1 FROM first WHERE k % 6 = 0
  UNION ALL SELECT k, 'uncovered_block', 'error', true, 1 FROM first WHERE k % 9 = 0 AND NOT (k % 11 = 0 AND k % 8 <> 0)
  UNION ALL SELECT k, 'duplicated_block', 'error', true, 1 FROM first WHERE k % 11 = 0 AND k % 8 <> 0 AND k % 9 <> 0
  UNION ALL SELECT k, 'boundary_mismatch', 'error', false, 1 FROM first WHERE k % 23 = 0
  UNION ALL SELECT k, 'missing_parent', 'error', true, 1 FROM first WHERE k % 13 = 0
  UNION ALL SELECT k, 'parent_level_invalid', 'error', true, 1 FROM first WHERE k % 17 = 0 AND k % 13 <> 0
  UNION ALL SELECT k, 'duplicate_label', 'warning', true, 1 FROM first WHERE k % 19 = 0)
SELECT k AS contract_id, code, severity, refixable, CAST(sum(n) AS BIGINT) AS n FROM iss GROUP BY ALL""",
    "low_confidence": f"WITH {_ITEMS} SELECT k AS contract_id, CAST(sum(b) AS BIGINT) AS n_blocks FROM cl WHERE b > 1 GROUP BY k",
    "money_elements": f"WITH {_ITEMS}, {_MONEY} SELECT k AS contract_id, role, normalized, 'C0002' AS clause_id, CAST(0.9 AS DOUBLE) AS confidence FROM amt",
    "date_elements": f"WITH {_ITEMS} SELECT k AS contract_id, day, count(*) AS n FROM (SELECT k, {_DAY.format('d')} AS day FROM it UNION ALL SELECT k, {_DAY.format('d + 30')} FROM it) GROUP BY ALL",
    "party_elements": f"""WITH {_ITEMS} SELECT k AS contract_id, role, name FROM (
  SELECT k, '出卖人（甲方）' AS role, '卖家' || (c % 97) || '公司' AS name FROM per UNION ALL SELECT k, '买受人（乙方）', '客户' || c || '公司' FROM per
  UNION ALL SELECT k, '甲方（签章）', '卖家' || (c % 97 + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) || '公司' FROM per UNION ALL SELECT k, '乙方（签章）', '客户' || c || '公司' FROM per)""",
    "element_counts": f"""WITH {_ITEMS} SELECT k AS contract_id, 'amount' AS kind, CAST(3 AS BIGINT) AS n FROM per UNION ALL SELECT k, 'party', CAST(4 AS BIGINT) FROM per UNION ALL SELECT k, 'date', 2 * count(*) FROM it GROUP BY k""",
    "merge_amounts": f"WITH {_ITEMS}, {_MONEY} SELECT k AS contract_id, normalized, arg_min(role, o) AS role FROM amt GROUP BY k, normalized",
    "merge_elements": f"""WITH {_ITEMS}, {_MONEY} SELECT k AS contract_id, 'amount' AS kind, count(DISTINCT normalized) AS n FROM amt GROUP BY k
UNION ALL SELECT k, 'party', CAST(CASE WHEN k % 5 = 0 THEN 3 ELSE 2 END AS BIGINT) FROM per
UNION ALL SELECT k, 'date', count(DISTINCT day) FROM (SELECT k, d AS day FROM it UNION ALL SELECT k, d + 30 FROM it) GROUP BY k""",
    "amount_conflicts": "SELECT o_orderkey AS contract_id, 'amount_conflict' AS code, 'high' AS severity, CAST(0.95 AS DOUBLE) AS confidence FROM orders WHERE o_orderkey % 7 = 0",
    "date_reversals": f"WITH {_ITEMS} SELECT k AS contract_id, a AS \"begin\", b AS \"end\" FROM ({_REVERSED})",
    "party_conflicts": f"""WITH {_ITEMS} SELECT k AS contract_id, '同一角色「甲方」对应多个不同主体：' || least(a, b) || '、' || greatest(a, b) || '。' AS message, 'high' AS severity
FROM (SELECT k, '卖家' || (c % 97) || '公司' AS a, '卖家' || (c % 97 + 1) || '公司' AS b FROM per WHERE k % 5 = 0)""",
    "reference_conflicts": f"WITH {_ITEMS} SELECT it.k AS contract_id, 'C' || lpad(CAST(2 + r AS VARCHAR), 4, '0') AS clause_id, 'medium' AS severity, CAST(0.9 AS DOUBLE) AS confidence FROM it JOIN per ON per.k = it.k WHERE s % 4 + 1 > m",
    "finding_rollup": f"""WITH {_ITEMS} SELECT 'amount_conflict' AS code, count(*) AS n FROM per WHERE k % 7 = 0 UNION ALL SELECT 'party_conflict', count(*) FROM per WHERE k % 5 = 0
UNION ALL SELECT 'date_conflict', count(*) FROM ({_REVERSED}) UNION ALL SELECT 'reference_conflict', count(*) FROM (SELECT DISTINCT it.k, s % 4 FROM it JOIN per ON per.k = it.k WHERE s % 4 + 1 > m)""",
    "element_signals": f"""WITH {_ITEMS} SELECT k AS contract_id, 'date' AS kind, count(*) AS n FROM it WHERE p % 11 = 0 GROUP BY k
UNION ALL SELECT k, 'completeness', CAST(1 + (n = 0)::INT AS BIGINT) FROM n UNION ALL SELECT k, 'amount', count(*) FROM (SELECT k, unnest({_PAID.replace('(cents', '[cents', 1)[:-1]}]) AS v FROM per) WHERE v >= 1000000000 OR v <= 0 GROUP BY k""",
    "bm25_topk": f"WITH {_bm25(50)} SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM sparse",
    "bm25_repeated_terms": f"WITH {_bm25(50, True)} SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(s, 4) AS score FROM sparse",
    "filtered_topk": "WITH " + _bm25(20, among="lang IN ('de', 'fr')") + " SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM sparse",
    "dense_topk": f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COSINE} AS c FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 6) DESC, id) AS rank FROM s QUALIFY rank <= 10)
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(c, 4) AS score FROM t""",
    "hybrid_rrf": f"""WITH {_bm25(50)},
ds AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COSINE} AS c FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
dense AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 6) DESC, id) AS rank FROM ds QUALIFY rank <= 50),
f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS s FROM (SELECT query_id, id, rank FROM sparse UNION ALL SELECT query_id, id, rank FROM dense) GROUP BY ALL),
o AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS rank, s FROM f QUALIFY rank <= 8)
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(CAST(s AS DOUBLE), 6) AS score FROM o""",
    "retrieval_recall_mrr": f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COSINE} AS c FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 6) DESC, id) AS rank FROM s QUALIFY rank <= 20),
g AS (SELECT q.vec_id AS query_id, e.vec_id AS id, q.label FROM embeddings q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
w AS (SELECT query_id, label, count(*) AS wanted FROM g GROUP BY ALL), h AS (SELECT query_id, count(*) AS hits, min(rank) AS f FROM t JOIN (SELECT query_id, id FROM g) x USING (query_id, id) GROUP BY query_id)
SELECT label, count(*) AS queries, round(avg(coalesce(hits, 0) / wanted), 4) AS recall, round(avg(1.0 / f), 4) AS mrr_hits, round(avg(coalesce(1.0 / f, 0)), 4) AS mrr_all FROM w LEFT JOIN h USING (query_id) GROUP BY ROLLUP (label)""",
    "tag_union": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'tag|' || p_type || CASE WHEN p_brand IN ('tag', p_type) THEN '' ELSE '|' || p_brand END ELSE p_brand || '|' || p_type END AS tags FROM part",
    "candidate_merge": f"""WITH {_ITEMS}, {_CAND}, b AS (SELECT *, row_number() OVER (PARTITION BY k, code, clause ORDER BY sure DESC, r) AS x, min(id) OVER (PARTITION BY k, code, clause) AS fid FROM cand)
SELECT k AS contract_id, code, clause AS clause_id, fid AS candidate_id, severity, 'm' || p AS message, round(CAST(sure AS DOUBLE), 2) AS confidence FROM b WHERE x = 1""",
    "judge_guardrails": f"WITH {_ITEMS}, {_JUDGED} SELECT k AS contract_id, id AS candidate_id, severity, category, CAST(confidence AS DOUBLE) AS confidence, review AS review_required FROM risk",
    "fuse_risks": f"WITH {_ITEMS}, {_JUDGED} SELECT k AS contract_id, code, clause AS clause_id, severity, round(CAST(confidence AS DOUBLE), 2) AS confidence, cross_validated, review_required FROM fused",
    "review_queue": f"""WITH {_ITEMS}, {_JUDGED} SELECT k AS contract_id, code, count(*) AS n FROM fused WHERE review_required GROUP BY ALL
UNION ALL SELECT k, 'element_signal:date', count(*) FROM sig WHERE NOT EXISTS (SELECT 1 FROM fused WHERE fused.k = sig.k AND fused.clause = sig.clause) GROUP BY k""",
    "report_rollup": f"""WITH {_ITEMS}, {_JUDGED}, y AS (SELECT code, severity, arg_min(category, r) AS category, cross_validated FROM (
  SELECT fused.code, fused.severity, risk.category, risk.r, fused.cross_validated, fused.k, fused.clause FROM fused JOIN risk ON risk.k = fused.k AND risk.code = fused.code AND risk.clause = fused.clause) GROUP BY k, clause, code, severity, cross_validated)
SELECT 'code' AS dimension, code AS value, count(*) AS n, CAST(count_if(cross_validated) AS BIGINT) AS cross_validated FROM y GROUP BY code
UNION ALL SELECT 'category', category, count(*), CAST(count_if(cross_validated) AS BIGINT) FROM y GROUP BY category UNION ALL SELECT 'severity', severity, count(*), CAST(count_if(cross_validated) AS BIGINT) FROM y GROUP BY severity""",
    "clause_search": "SELECT doc_id AS contract_id, coalesce(source, '') AS title FROM documents WHERE contains(lower(coalesce(source, '')), 'ther') OR contains(lower(coalesce(text, '')), 'ther')",
    "risk_excerpts": f"""WITH {_ITEMS}, {_JUDGED} SELECT risk.k AS contract_id, count(*) AS n_rows, count(c.q) AS n_found
FROM risk LEFT JOIN cl c ON c.k = risk.k AND 'C' || lpad(CAST(c.q AS VARCHAR), 4, '0') = risk.clause GROUP BY risk.k""",
}
