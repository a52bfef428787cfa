"""Small SQL builders for the checking engine."""

from __future__ import annotations

LINES = """doc_line AS (
  SELECT doc_id, CAST(i AS BIGINT) AS pos, l[i + 1] AS text
  FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def spans(name: str, source: str, key: str, text: str, pattern: str) -> str:
    """CTE with the columns key, seq, value, start, end (end exclusive) of all matches of a pattern."""
    p = quoted(pattern)
    return f"""{name} AS (
  SELECT {key}, CAST(i - 1 AS BIGINT) AS seq, v[i] AS value,
    CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT {key}, v, g, unnest(range(1, len(v) + 1)) AS i
        FROM (SELECT {key}, regexp_extract_all({text}, {p}) AS v, regexp_split_to_array({text}, {p}) AS g FROM {source})))"""
