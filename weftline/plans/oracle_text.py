"""DuckDB statements of the corpus and trace results, for comparison only.

Rule patterns are shared data; everything done with them is stated again here
with DuckDB's own functions. RE2 has no lookaround, so boundaries come from
tokenising or from ``\\b``, which RE2 limits to ASCII words.
"""

from __future__ import annotations

from weftline.functions.orm_rules import CONTEXT_RULES, LINE_RULES, MAPPERS
from weftline.operators.orm import SCRIPT_LANGUAGES
from weftline.plans import bindings as b
from weftline.sources import corpus as c


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any_contains(column: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(p)})" for p in parts) + ")"


IS_CODE = (
    "((" + " OR ".join(f"ends_with(lower(file_path), {q(e)})" for e in c.CODE_ENDINGS) + ")"
    " AND NOT " + _any_contains("lower(file_path)", c.EXCLUDED_PARTS) + ")"
)
IS_SCHEMA = f"({_any_contains('lower(file_path)', c.SCHEMA_PARTS)} OR ends_with(lower(file_path), '.sql'))"
IS_ORM_SCHEMA = _any_contains("lower(file_path)", c.ORM_SCHEMA_PARTS)
LANGUAGE = (
    "CASE lower(regexp_extract(file_path, '[.][^.]*$')) "
    + " ".join(f"WHEN {q(e)} THEN {q(lang)}" for lang, ends in c.LANGUAGE_ENDINGS.items() for e in ends)
    + " ELSE 'unknown' END"
)


def _speaks(language: str) -> str:
    if language in SCRIPT_LANGUAGES:
        return "language IN ('javascript', 'typescript')"
    return f"language = {q(language)}"


_ORMS = (
    "list_filter(["
    + ", ".join(
        f"CASE WHEN {_speaks(m.language)} AND ("
        + " OR ".join(f"regexp_matches(content, {q(p)})" for p in m.indicators)
        + f") THEN {q(m.name)} END"
        for m in MAPPERS
    )
    + "], lambda x: x IS NOT NULL)"
)

BY_MAPPER = (
    "CASE "
    + " ".join(
        f"WHEN list_contains(orms, {q(m.name)}) AND (regexp_matches(line, {q(p)}) OR regexp_matches(context, {q(p)})) THEN {q(u)}"
        for m in MAPPERS
        for u, p in m.usages
    )
    + " END"
)
BY_LINE = "CASE " + " ".join(f"WHEN regexp_matches(line, {q(p)}, 'i') THEN {q(u)}" for u, p in LINE_RULES) + " END"
BY_CONTEXT = (
    "CASE "
    + " ".join(
        "WHEN " + " AND ".join(f"regexp_matches(upper(context), {q(p)})" for p in ps) + f" THEN {q(u)}"
        for u, ps in CONTEXT_RULES
    )
    + " ELSE 'read' END"
)

CAMEL = "list_reduce(list_concat([''], list_transform(regexp_extract_all({0}, '_[a-z]|_|[^_]+'), lambda x: CASE WHEN regexp_full_match(x, '_[a-z]') THEN upper(substr(x, 2)) ELSE x END)), lambda a, x: a || x)"


def camel(name: str) -> str:
    return CAMEL.format(name)


_FIELD_WRITES = "\nUNION ALL\n".join(
    f"""SELECT project_id, file_id, {mi} AS mi, {pi} AS pi, unnest(range(len(regexp_extract_all(content, {q(p)})))) AS wi,
  lower(unnest(regexp_extract_all(content, {q(p)}, {fg}))) AS field, lower(unnest(regexp_extract_all(content, {q(p)}, {cg}))) AS column_name
FROM tagged WHERE list_contains(orms, {q(m.name)})"""
    for mi, m in enumerate(MAPPERS)
    for pi, (fg, cg, p) in enumerate(m.fields)
)

MODEL_CAPTURES = "\nUNION ALL\n".join(
    f"SELECT project_id, file_id, unnest(regexp_extract_all(content, {q(p)}, {g})) AS model FROM tagged WHERE list_contains(orms, {q(m.name)})"
    for m in MAPPERS
    for g, p in m.models
)

FILES = f"""
corpus AS ({b.plain(b.CORPUS)}),
source_files AS (SELECT id, project_id, file_path, {LANGUAGE} AS language, content FROM corpus WHERE {IS_CODE}),
tagged AS (SELECT project_id, id AS file_id, language, content, {_ORMS} AS orms FROM source_files)
"""

FIELD_MAP = f"""
field_writes AS ({_FIELD_WRITES}),
field_map AS (
  SELECT project_id, file_id, field, arg_max(column_name, [mi, pi, wi]) AS column_name
  FROM field_writes WHERE field <> '' AND column_name <> '' GROUP BY ALL
)
"""

LINES = """
lines AS (
  SELECT project_id, file_id, orms, unnest(string_split(content, chr(10))) AS line,
         generate_subscripts(string_split(content, chr(10)), 1) AS line_number
  FROM tagged WHERE content <> ''
),
windowed AS (
  SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY file_id ORDER BY line_number ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS context,
         string_agg(line, chr(10)) OVER (PARTITION BY file_id ORDER BY line_number ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS snippet
  FROM lines
),
code_lines AS (
  SELECT * FROM windowed WHERE NOT regexp_matches(line, '^\\s*(//|#|\\*|/\\*|--)') AND regexp_matches(line, '\\S')
)
"""

CATALOG = f"""
db_schemas AS ({b.plain(b.DB_SCHEMAS)}),
db_columns AS ({b.plain(b.DB_COLUMNS)}),
catalog AS (
  SELECT s.project_id, c.id AS column_id, c.column_name, s.table_name FROM db_columns c JOIN db_schemas s ON c.schema_id = s.id
),
variants AS (
  SELECT DISTINCT project_id, column_id, lower(v) AS variant FROM (
    SELECT project_id, column_id, unnest([col, {camel('col')}, replace(col, '_', ''), tab || '.' || col, {camel('tab')} || '.' || {camel('col')}]) AS v
    FROM (SELECT project_id, column_id, lower(column_name) AS col, lower(table_name) AS tab FROM catalog)
  ) WHERE length(v) > 3
),
table_words AS (
  SELECT DISTINCT project_id, table_name, lower(v) AS variant FROM (
    SELECT project_id, table_name, unnest([table_name, {camel('table_name')}, short, {camel('short')}]) AS v
    FROM (SELECT project_id, table_name, CASE WHEN ends_with(table_name, 's') THEN substr(table_name, 1, length(table_name) - 1) ELSE table_name END AS short FROM catalog)
  )
)
"""

TOKENS = """
words AS MATERIALIZED (SELECT DISTINCT file_id, line_number, unnest(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+')) AS token FROM code_lines),
chains AS (
  SELECT file_id, line_number, string_split(unnest(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+(?:[.][a-z0-9_]+)+')), '.') AS parts FROM code_lines
),
pairs AS (
  SELECT DISTINCT file_id, line_number, unnest(list_transform(range(1, len(parts)), lambda i: parts[i] || '.' || parts[i + 1])) AS token FROM chains
),
tokens AS (SELECT * FROM words UNION SELECT * FROM pairs),
direct AS (
  SELECT DISTINCT l.project_id, l.file_id, l.line_number, v.column_id
  FROM tokens t JOIN code_lines l ON l.file_id = t.file_id AND l.line_number = t.line_number
  JOIN variants v ON v.project_id = l.project_id AND v.variant = t.token
)
"""

ACCEPTED = """
accepted AS (
  SELECT d.project_id, d.file_id, d.line_number, d.column_id
  FROM direct d JOIN catalog c ON c.column_id = d.column_id
  JOIN code_lines l ON l.file_id = d.file_id AND l.line_number = d.line_number
  WHERE length(c.column_name) > 4 OR len(l.orms) > 0
     OR EXISTS (SELECT 1 FROM table_words w WHERE w.project_id = c.project_id AND w.table_name = c.table_name AND contains(lower(l.context), w.variant))
)
"""

MAPPED = """
mapped AS MATERIALIZED (
  SELECT DISTINCT l.project_id, l.file_id, l.line_number, c.column_id
  FROM words t JOIN code_lines l ON l.file_id = t.file_id AND l.line_number = t.line_number
  JOIN field_map m ON m.file_id = t.file_id AND m.field = t.token
  JOIN catalog c ON c.project_id = l.project_id AND lower(c.column_name) = m.column_name
)
"""

TYPED = f"""
typed_lines AS MATERIALIZED (
  SELECT project_id, file_id, line_number, context, snippet, {BY_MAPPER} AS by_mapper, {BY_LINE} AS by_line, {BY_CONTEXT} AS by_context FROM code_lines
)
"""

USAGES = """
usages AS (
  SELECT md5(h.file_id || '|' || h.line_number || '|' || h.column_id || '|' || h.strategy) AS id, h.project_id, h.column_id,
         h.file_id AS source_file_id, h.line_number, coalesce(by_mapper, by_line, by_context) AS usage_type, h.strategy,
         left(t.snippet, 500) AS code_snippet, left(t.context, 1000) AS context
  FROM (SELECT *, 'direct' AS strategy FROM accepted UNION ALL SELECT *, 'orm' AS strategy FROM mapped) h
  JOIN typed_lines t ON t.file_id = h.file_id AND t.line_number = h.line_number
)
"""

TRACE = ", ".join([FILES, FIELD_MAP, LINES, CATALOG, TOKENS, ACCEPTED, MAPPED, TYPED, USAGES])
