"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from .decontam import op1_decontamination
from .hard_negatives import op13_hard_negatives
from .html_text import op5_html_extraction
from .langid import op2_language_id
from .lm_score import op11_lm_scoring
from .near_dups import op10_near_duplicates
from .packing import op6_best_fit_packing
from .sketch import op3_fingerprints
from .span_dedup import op9_substring_dedup
from .suffix_dedup import op8_suffix_dedup
from .token_store import op4_token_shards
from .toxicity import op7_toxicity
from .whitening import op12_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_language_id, op3_fingerprints, op4_token_shards, op5_html_extraction, op6_best_fit_packing, op7_toxicity, op8_suffix_dedup, op9_substring_dedup, op10_near_duplicates, op11_lm_scoring, op12_embedding_whitening, op13_hard_negatives)}

WORDS = r"""
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE_SQL = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
bw AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
    FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
    SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
    FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(i)),
hits AS (SELECT dw.doc_id, i, size, item_id FROM dw JOIN bw USING (size, win)),
marks AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + size)) AS t(p) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marks USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_suffix_dedup": """
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
pieces AS (SELECT doc_id, p * 250 AS base, substr(h, p * 500 + 1, 1298) AS x FROM d, unnest(range(length(h) // 500 + 1)) AS t(p)),
windows AS (SELECT doc_id, base + i AS i, md5(substr(x, 2 * i + 1, 800)) AS win FROM pieces, unnest(range(greatest(0, least(250, length(x) // 2 - 399)))) AS t(i)),
again AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1),
starts AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS first FROM windows JOIN again USING (win)),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM starts) GROUP BY doc_id, span),
parts AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM spans),
kept AS (
    SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans,
        string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS rest
    FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op9_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
    SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS win FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
least AS (SELECT win, min(doc_id) AS first_doc FROM windows GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (
    SELECT DISTINCT doc_id, p FROM windows JOIN least USING (win), unnest(range(i, i + 50)) AS t(p) WHERE doc_id > first_doc),
kept AS (
    SELECT doc_id, count(*) FILTER (gone.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY t.p) FILTER (gone.p IS NULL) AS kept
    FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) AS t LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op13_hard_negatives": """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y, list_transform(embedding, lambda c: CAST(floor(256 * c::DOUBLE) AS BIGINT)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND list_aggregate(list_transform(embedding, lambda c: coalesce(isfinite(c), false)), 'bool_and')),
scores AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.y = r.y AS same, CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM (SELECT DISTINCT * FROM r WHERE vec_id % 100 = 0) a JOIN r ON a.vec_id <> r.vec_id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5""",
}
