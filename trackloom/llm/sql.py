"""SQL in DuckDB's dialect for the queries that it can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 8),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 7]) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM g WHERE n > 1) GROUP BY doc_id),
c AS (SELECT w.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(t, '[^!]', '', 'g')) AS n_loud,
  len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper, strlen(t) AS n_bytes, strlen(t) - length(regexp_replace(t, '[^\x00-\x7F]|[A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^ ]', '', 'g')) AS n_spaces
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND 2 * n_loud <= n_words AND 2 * n_upper <= n_words AND NOT (n_dup_lines >= 5 AND 2 * n_dup_lines > n_lines) AND word_chars BETWEEN 2 * n_words AND 30 * n_words AND 2 * n_letters >= n_bytes - n_spaces AS kept FROM b
"""

PASSAGES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM p WHERE n >= 100)),
x AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1)),
y AS (SELECT doc_id, i, sum(CASE WHEN b IS NULL OR i > b + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM x),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS e FROM y GROUP BY doc_id, run),
m AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f FROM r),
k AS (SELECT p.doc_id AS doc_id, any_value(n) AS n, sum(e - a) AS gone, count(*) AS runs, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) || substr(any_value(h), 2 * max(e) + 1) AS kept FROM m JOIN p ON p.doc_id = m.doc_id GROUP BY p.doc_id)
SELECT p.doc_id AS doc_id, p.n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM p LEFT JOIN k ON k.doc_id = p.doc_id
"""

VECTORS = """
WITH RECURSIVE l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.98),
r(v, o) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.o),
n AS (SELECT a AS v, count(*) AS n FROM l GROUP BY a), c AS (SELECT v, min(o) AS c FROM r GROUP BY v)
SELECT c.v AS vec_id, coalesce(n, 0) AS n_links, c AS component_id, c.v = c AS kept FROM c LEFT JOIN n ON n.v = c.v
"""



def _codes(entries: int = 64, rounds: int = 2) -> str:
    """Every part against every entry, then means rounded down, a round after another."""
    steps = [
        """WITH kept AS (SELECT vec_id, label, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "p AS (SELECT r, vec_id, k, v[k * (len(v) // 16) + 1:(k + 1) * (len(v) // 16)] AS x FROM (SELECT *, unnest(range(16)) AS k FROM kept))",
        f"b0 AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id, x) - 1 AS e, x AS c FROM p QUALIFY e < {entries})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS (SELECT p.r AS r, p.k AS k, any_value(p.x) AS x, min({{'d': list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.e}}) AS m FROM p JOIN b{i} b ON p.k = b.k GROUP BY p.r, p.k)")
        if i < rounds:
            steps.append(f"n{i} AS (SELECT k, e, list(q ORDER BY j) AS c FROM (SELECT k, m.e AS e, j, CAST((sum(x[j]) - ((sum(x[j]) % count(*)) + count(*)) % count(*)) AS BIGINT) // count(*) AS q FROM (SELECT *, unnest(range(1, len(x) + 1)) AS j FROM a{i}) GROUP BY k, m.e, j) GROUP BY k, e)")
            steps.append(f"b{i + 1} AS (SELECT b.k AS k, b.e AS e, coalesce(n.c, b.c) AS c FROM b{i} b LEFT JOIN n{i} n ON n.k = b.k AND n.e = b.e)")
    steps.append(f"s AS (SELECT r, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' ORDER BY k) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM b{rounds})")
    return ", ".join(steps) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM s JOIN kept ON kept.r = s.r, h"


SQL = {"op13_vector_codes": _codes(), "op4_suffix_dedup": PASSAGES, "op5_quality_cascade": QUALITY, "op7_rp_forest": VECTORS}
