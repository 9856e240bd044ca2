"""DuckDB SQL for the corpus operators that SQL can express, written from the contracts, not from the methods."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"

PHRASES = rf"""
WITH words AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS seq FROM words, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS i) AS r),
repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p FROM repeats, LATERAL (SELECT unnest(range(i, i + 20)) AS p) AS r),
places AS (SELECT doc_id, list(p) AS gone FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, len(w) AS n, coalesce(len(gone), 0) AS removed, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(gone, k)) END AS rest FROM words LEFT JOIN places USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(removed AS BIGINT) AS n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept"""

SUFFIXES = """
WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS seq FROM texts, LATERAL (SELECT unnest(range(0, greatest(octet_length(b) - 99, 0))) AS i) AS r),
repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
heads AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER o + 100 OR lag(i) OVER o IS NULL THEN 1 ELSE 0 END AS head FROM repeats WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, run, min(i) AS lo, max(i) + 100 AS hi FROM (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM heads) GROUP BY doc_id, run),
cuts AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS start FROM runs),
pieces AS (SELECT doc_id, string_agg(substr(h, 2 * start + 1, 2 * (lo - start)), '' ORDER BY lo) AS front, max(hi) AS hi, sum(hi - lo) AS removed, count(*) AS spans FROM cuts JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE front || substr(h, 2 * hi + 1) END)) AS kept_sha256
FROM texts LEFT JOIN pieces USING (doc_id)"""

#: Characters that the template adds before control strings of a text.
_ESCAPES = r"len(regexp_extract_all({0}, '\\')) + list_sum(list_concat([0], list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda x: len(x) - 2))) + len(regexp_extract_all({0}, '</turn>'))"
CHAT = rf"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
sized AS (SELECT *, 4 + length(role) + {_ESCAPES.format('role')} + len(regexp_extract_all(role, ':')) + 2 + length(text) + {_ESCAPES.format('text')} + 8 AS size FROM turns)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars FROM sized GROUP BY conv_id"""


def _kind(name: str, number: int, pattern: str, least: int, group: int) -> str:
    """Matches with their places: gaps between matches and matches themselves, summed up in turn."""
    p = pattern.replace("'", "''")
    length = f"length(regexp_extract(m[i], '{p}', {group}))"
    before = "list_sum(list_concat([0], list_transform(gaps[1:i], lambda x: length(x)))) + list_sum(list_concat([0], list_transform(m[1:i - 1], lambda x: length(x))))"
    return f"""k{number} AS (SELECT doc_id, {number} AS kind, '{name}' AS name, s, s + n AS e FROM (SELECT doc_id, CAST({before} AS BIGINT) AS s, length(m[i]) AS n, {length} AS size
  FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS gaps FROM texts), LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i) AS r) WHERE size >= {least})"""


_RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    ("access", r"AKIA[A-Z0-9]+", 16, 0),
    ("hex", r"[0-9a-f]+", 32, 0),
)
SECRETS = (
    "WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),\n"
    + ",\n".join(_kind(name, k, p, least, group) for k, (name, p, least, group) in enumerate(_RULES))
    + """,
spans AS (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2),
joined AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN joined USING (doc_id)"""
)

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda y: y * y)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u) AND list_dot_product(a.u, b.u) >= 0.9),
reach AS (SELECT vec_id AS node, vec_id AS other FROM v UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, (SELECT min(other) FROM reach WHERE node = vec_id) AS component_id, (SELECT min(other) FROM reach WHERE node = vec_id) = vec_id AS kept FROM v"""

ORACLES = {"op4_phrase_dedup": PHRASES, "op5_suffix_dedup": SUFFIXES, "op6_chat_format": CHAT, "op7_embedding_dedup": VECTORS, "op8_secret_scan": SECRETS}
