"""DuckDB twins of the queries that SQL can express. They spell things out by row and are meant for small tables."""

from __future__ import annotations

from semdrift.llm import secret_scan

_ASSIGN = secret_scan.ASSIGN.replace("(?=[pPsStTaA])", "")


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(kind: int, pattern: str) -> str:
    """Rows (r, kind, start, value) of the matches of one pattern: gaps and matches take turns."""
    p = _text(pattern)
    return f"""
SELECT r, {kind} AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: CAST(
    list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS start,
  unnest(m) AS value, text
FROM (SELECT r, text, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g FROM t WHERE regexp_matches(text, {p}))"""


def secret_scan_sql() -> str:
    """Entropies are taken anew for each window."""
    w = secret_scan.WINDOW
    found = [_found(0, _ASSIGN), _found(1, secret_scan.ACCESS), _found(2, secret_scan.HEX)]
    names = ["assign", "access", "hex"]
    least = []
    for k, (name, letters, bits) in enumerate(secret_scan.CLASSES):
        found.append(_found(3 + k, f"[{letters}]{{{w},}}"))
        names.append(name)
        least.append(f"WHEN {3 + k} THEN {bits}")
    allowed = " OR ".join(f"regexp_matches(value, {_text(p)})" for p in secret_scan.ALLOWED)
    front = f"substring(text, greatest(start - {secret_scan.CONTEXT} + 1, 1), least(start, {secret_scan.CONTEXT}))"
    kinds = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    return f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(found)}),
windows AS (
  SELECT r, kind, start + i - 1 AS first, start + i - 1 + {w} AS stop, start,
    round(list_entropy(string_split(substring(value, i, {w}), '')), 9) AS bits
  FROM (SELECT *, unnest(range(1, length(value) - {w} + 2)) AS i FROM found
        WHERE kind > 2 AND NOT ({allowed}) AND NOT regexp_matches({front}, {_text(secret_scan.BEFORE)}))),
hot AS (SELECT *, CASE WHEN first > max(stop) OVER (PARTITION BY r, kind, start ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    THEN 1 ELSE 0 END AS apart FROM windows WHERE bits >= CASE kind {" ".join(least)} END),
runs AS (SELECT *, sum(apart) OVER (PARTITION BY r, kind, start ORDER BY first) AS run FROM hot),
spans AS (
  SELECT r, kind, start, start + length(value) AS stop FROM found
  WHERE kind IN (1, 2) OR kind = 0 AND length(regexp_replace(value, {_text(secret_scan.ASSIGNED)}, '')) >= {secret_scan.MIN_ASSIGNED}
  UNION ALL SELECT r, kind, min(first), max(stop) FROM runs GROUP BY r, kind, start, run),
named AS (SELECT *, {kinds}[kind + 1] || ':' || start || ':' || stop AS part FROM spans),
grouped AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    coalesce(string_agg(part, ',' ORDER BY start, kind, stop) FILTER (kind < 3), '') AS base,
    string_agg(part, ',' ORDER BY start, kind, stop) AS spans, count(*) FILTER (kind > 2) AS n_entropy
  FROM named GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM t LEFT JOIN grouped USING (r)"""


def prefix_trie_sql(every: int = 100, most: int = 6) -> str:
    """Every prefix is spelled out as the list of its turns; CRC-32 is taken bit by bit."""
    return f"""
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS digits, 0 AS i, CAST(4294967295 AS BIGINT) AS v FROM turns WHERE pos = 1
  UNION ALL
  SELECT conv_id, digits, i + 1, CASE WHEN w % 2 = 1 THEN xor(w >> 1, 3988292384) ELSE w >> 1 END
  FROM (SELECT conv_id, digits, i, CASE WHEN i % 8 = 0 THEN xor(v, CAST(ascii(substring(digits, i // 8 + 1, 1)) AS BIGINT)) ELSE v END AS w
        FROM crc WHERE i < 8 * length(digits))),
heads AS (SELECT conv_id, conv_id - conv_id % {every} AS first, xor(v, 4294967295) % {most} AS h FROM crc WHERE i = 8 * length(digits)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM heads c JOIN turns t ON t.conv_id = c.first AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.role, t.text FROM heads c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
paths AS (
  SELECT h.conv_id, coalesce(list(sha256(length(role) || ' ' || role || text) ORDER BY part, pos) FILTER (role IS NOT NULL), []) AS path,
    coalesce(list(length(text) ORDER BY part, pos) FILTER (role IS NOT NULL), []) AS sizes
  FROM heads h LEFT JOIN rebuilt r ON r.conv_id = h.conv_id GROUP BY h.conv_id),
steps AS (SELECT conv_id, path, sizes, unnest(range(0, len(path) + 1)) AS depth FROM paths),
nodes AS (
  SELECT depth, path[1:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(coalesce(sizes[depth], 0)) AS size,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = depth), '') AS ends
  FROM steps GROUP BY depth, path[1:depth]),
children AS (SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.prefix = n.prefix),
above AS (SELECT prefix, n_children, n_convs, size, unnest(range(0, depth + 1)) AS up FROM whole),
sums AS (SELECT up AS depth, prefix[1:up] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved
  FROM above GROUP BY up, prefix[1:up])
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM whole n JOIN sums s ON s.depth = n.depth AND s.prefix = n.prefix
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]"""
