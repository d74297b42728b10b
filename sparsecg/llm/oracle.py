"""DuckDB SQL for the results of queries that SQL can state over whole tables in reasonable time."""

from __future__ import annotations

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = r"""
WITH turns AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
said AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') AS escaped FROM turns)
SELECT conv_id, COUNT(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(SUM(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(SUM(length('<|turn|>') + length(role) + 1 + length(escaped) + length('<|end|>') + 1) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""

OP5 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (
  SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE list_dot_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) >= 0.9),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, MIN(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT COUNT(*) FROM links l WHERE l.a = e.vec_id) AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id
"""

OP7 = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(COALESCE({_LOWER}, ''), '{_WORD}') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(COALESCE({_LOWER}, ''), '{_WORD}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, LEAST(len(w), 13) AS n, array_to_string(list_slice(w, i, i + LEAST(len(w), 13) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - LEAST(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT p.doc_id, p.i, p.n, item_id FROM places p JOIN windows USING (n, g)),
hit AS (
  SELECT doc_id, COUNT(DISTINCT word) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
  sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""



def _either_case(pattern: str) -> str:
    """Letters of a pattern without classes in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


_GLUE = r"""["'']?\x20*[:=]\x20*["'']?"""
_PATTERNS = {
    "assign": f"({_either_case('password|passwd|secret|token|api_?key')}){_GLUE}([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "id": f"\\b({_either_case('client_?id|access_?key_?id|key_?id|account_?id|user(?:_?name)?|login')}){_GLUE}([A-Za-z0-9_.@-]{{3,}})",
    "value": "[A-Za-z0-9+/]+={0,2}",
    "endpoint": r"\b(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|jdbc:[a-z]+)://[^\x20\x09-\x0D" + '"' + r"''<>]+",
}
_GOOD = {
    "assign": "length(regexp_extract(m, '{p}', 2)) >= 6",
    "access": "length(m) >= 20",
    "hex": "length(m) >= 24",
    "id": "true",
    "value": "length(rtrim(m, '=')) >= 32 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')",
    "endpoint": "true",
}
_SUM = "COALESCE(list_sum(list_transform({x}, lambda y: length(y))), 0)"
_EACH = "\nUNION ALL ".join(
    f"""SELECT r, '{kind}' AS kind, {k} AS kn, m, {_GOOD[kind].replace('{p}', p)} AS good,
  {_SUM.format(x='gaps[1:i]')} + {_SUM.format(x='ms[1:i - 1]')} AS s
FROM (SELECT r, ms, gaps, i, ms[i] AS m FROM (
  SELECT r, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT r, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS gaps FROM d)))"""
    for k, (kind, p) in enumerate(_PATTERNS.items())
)
_NEAR = "o.r = w.r AND o.s <= w.e + 200 AND o.e >= w.s - 200 AND (o.e <= w.s OR o.s >= w.e)"
OP2 = f"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, COALESCE(text, '') AS text FROM documents),
parts AS MATERIALIZED (SELECT r, kind, kn, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM ({_EACH}) WHERE good),
secrets AS (SELECT * FROM parts WHERE kind IN ('assign', 'hex', 'value')),
identifiers AS (SELECT * FROM parts WHERE kind IN ('access', 'id')),
spans AS (
  SELECT * FROM parts WHERE kn < 3
  UNION ALL SELECT * FROM parts w WHERE kind = 'id' AND EXISTS (SELECT 1 FROM secrets o WHERE {_NEAR})
  UNION ALL SELECT * FROM parts w WHERE kind = 'value' AND EXISTS (SELECT 1 FROM identifiers o WHERE {_NEAR})
  UNION ALL SELECT DISTINCT w.* FROM parts w JOIN secrets o ON {_NEAR} JOIN identifiers q ON {_NEAR.replace('o.', 'q.')}
    WHERE w.kind = 'endpoint' AND (o.e <= q.s OR q.e <= o.s)),
found AS (
  SELECT r, COUNT(*) FILTER (kind = 'assign') AS n_assign, COUNT(*) FILTER (kind = 'access') AS n_access, COUNT(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kn) FILTER (kn < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kn, e) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex, sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans
FROM d LEFT JOIN found USING (r)
"""

ORACLE_SQL = {"op2_secret_linking": OP2, "op4_chat_prefix_tree": OP4, "op5_embedding_tiles": OP5, "op7_positional_decontamination": OP7}
