"""The queries of the training-data operators, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .jaccard import op8_jaccard_join
from .language import op1_language_id
from .fingerprint import op3_order_minhash
from .media import op5_media
from .mixing import op10_curriculum_mix
from .packing import op7_best_fit_packing
from .pii import op4_pii
from .quality import op9_quality
from .substrings import op6_substring_dedup
from .tokens import op2_token_files

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_files": op2_token_files,
    "op3_order_minhash": op3_order_minhash,
    "op4_pii": op4_pii,
    "op5_media": op5_media,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality": op9_quality,
    "op10_curriculum_mix": op10_curriculum_mix,
}

_WORDS = "[^\\x20\\x09-\\x0D]+"

ORACLES: dict[str, str] = {
    "op6_substring_dedup": f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS key FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT key, min(doc_id) AS d FROM k GROUP BY key),
gone AS (SELECT DISTINCT k.doc_id, k.i + g.j AS pos FROM k JOIN f USING (key), generate_series(0, 49) g(j) WHERE f.d < k.doc_id),
x AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS pos FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS t, count(*) AS n FROM x ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op8_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.c = l.x)
SELECT s.doc_id, len(s.sh) AS n_shingles, min(r.c) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, s.sh""",
}
