"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from .bpe import op7_byte_bpe
from .chat import OP3_SQL, op3_perspective_rotation
from .decontaminate import OP4_SQL, op4_decontaminate
from .divergence import OP5_SQL, op5_divergence_rules
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .jaccard import op10_jaccard_join
from .license_scan import op6_license_scan
from .main_text import OP11_SQL, op11_main_text
from .quality import op1_quality_classifier
from .source_audit import OP12_SQL, op12_source_audit
from .substring_bytes import op2_suffix_dedup
from .substring_words import op8_substring_dedup
from .warc import OP9_SQL, op9_warc_archive

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op3_perspective_rotation": op3_perspective_rotation,
    "op5_divergence_rules": op5_divergence_rules,
    "op6_license_scan": op6_license_scan,
    "op9_warc_archive": op9_warc_archive,
    "op10_jaccard_join": op10_jaccard_join,
    "op7_byte_bpe": op7_byte_bpe,
    "op11_main_text": op11_main_text,
    "op12_source_audit": op12_source_audit,
    "op13_hard_negatives": op13_hard_negatives,
}

OP2_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, substr(x, CAST(2 * i - 1 AS INT), 200) AS g FROM (SELECT doc_id, x, unnest(range(1, length(x) // 2 - 98)) AS i FROM d WHERE length(x) >= 200)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min({'d': doc_id, 'i': i}) OVER (PARTITION BY g) AS first FROM win) WHERE first < {'d': doc_id, 'i': i}),
edge AS (SELECT doc_id, p, sum(s) AS s FROM (SELECT doc_id, i AS p, 1 AS s FROM late UNION ALL SELECT doc_id, i + 100, -1 FROM late) GROUP BY doc_id, p),
cover AS (SELECT doc_id, p, coalesce(lead(p) OVER w, p) AS q, sum(s) OVER w AS depth FROM edge WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
run AS (SELECT doc_id, p, q, depth > 0 AS gone, coalesce(lag(depth > 0) OVER (PARTITION BY doc_id ORDER BY p), false) AS before FROM cover),
spans AS (SELECT doc_id, CAST(sum(q - p) FILTER (gone) AS BIGINT) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_spans FROM run GROUP BY doc_id),
stay AS (SELECT doc_id, p AS a, coalesce(q, p) AS b FROM run WHERE NOT gone),
piece AS (
  SELECT doc_id, 1 AS a, (SELECT min(p) FROM run r WHERE r.doc_id = d.doc_id) AS b FROM d
  UNION ALL SELECT doc_id, a, b FROM stay WHERE b > a
  UNION ALL SELECT doc_id, (SELECT max(p) FROM run r WHERE r.doc_id = d.doc_id), length(x) // 2 + 1 FROM d),
kept AS (SELECT d.doc_id, string_agg(substr(x, CAST(2 * a - 1 AS INT), CAST(2 * (b - a) AS INT)), '' ORDER BY a) AS t FROM d JOIN piece ON d.doc_id = piece.doc_id WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY d.doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(CASE WHEN n_removed > 0 THEN t ELSE x END, ''))) AS kept_sha256
FROM d LEFT JOIN spans ON d.doc_id = spans.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM late),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_dedup": OP2_SQL,
    "op3_perspective_rotation": OP3_SQL,
    "op4_decontaminate": OP4_SQL,
    "op5_divergence_rules": OP5_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op9_warc_archive": OP9_SQL,
    "op10_jaccard_join": OP10_SQL,
    "op11_main_text": OP11_SQL,
    "op12_source_audit": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
