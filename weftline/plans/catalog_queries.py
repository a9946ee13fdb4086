"""Queries that extract catalogs from the generated corpus and from pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import catalog
from weftline.plans import oracle_text as o
from weftline.plans.oracle_text import q
from weftline.plans.registry import query
from weftline.plans.trace_queries import _with, source_files

_FILES = o.FILES + ", texts AS (SELECT project_id, id AS file_id, file_path, language, content FROM source_files)"


def _listed(*values: str) -> str:
    return ", ".join(q(v) for v in values)


def _snake(name: str) -> str:
    return f"lower(regexp_replace(regexp_replace({name}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'))"


def _pairs(source: str, pattern: str, options: str = "") -> str:
    opt = f", {q(options)}" if options else ""
    heads, bodies = (f"regexp_extract_all(content, {q(pattern)}, {g}{opt})" for g in (1, 2))
    return f"""SELECT project_id, file_id, file_path, content, unnest(range(len({heads}))) AS table_seq,
      unnest({heads}) AS head, unnest({bodies}) AS body FROM texts WHERE {source}"""


def _cap(text: str, pattern: str, group: int = 1, options: str = "") -> str:
    opt = f", {q(options)}" if options else ""
    return f"nullif(regexp_extract({text}, {q(pattern)}, {group}{opt}), '')"


_OUT = "project_id, file_id, file_path, table_seq, table_name, col_seq, column_name, data_type, is_primary_key, is_foreign_key, foreign_table, foreign_column"
_NO_TARGET = "CAST(NULL AS VARCHAR) AS foreign_table, CAST(NULL AS VARCHAR) AS foreign_column"

_DDL_STARTS = " OR ".join(f"starts_with(upper(part), '{s}')" for s in catalog.DDL_SKIPPED_STARTS)
DDL = f"""
ddl_tables AS ({_pairs("true", catalog.CREATE_TABLE, "i")}),
ddl_parts AS (SELECT *, unnest(range(len(string_split(body, ',')))) AS col_seq, regexp_replace(unnest(string_split(body, ',')), '^\\s+|\\s+$', '', 'g') AS part FROM ddl_tables),
ddl AS (
  SELECT project_id, file_id, file_path, table_seq, head AS table_name, col_seq,
    {_cap('part', catalog.DDL_COLUMN, 1, 'i')} AS column_name, trim({_cap('part', catalog.DDL_COLUMN, 2, 'i')}) AS data_type,
    contains(upper(part), 'PRIMARY KEY') AS is_primary_key, contains(upper(part), 'REFERENCES') AS is_foreign_key,
    CASE WHEN contains(upper(part), 'REFERENCES') THEN {_cap('part', catalog.DDL_REFERENCE, 1, 'i')} END AS foreign_table,
    CASE WHEN contains(upper(part), 'REFERENCES') THEN {_cap('part', catalog.DDL_REFERENCE, 2, 'i')} END AS foreign_column
  FROM ddl_parts WHERE NOT ({_DDL_STARTS}) AND regexp_matches(part, {q(catalog.DDL_COLUMN)}, 'i')
)
"""

PRISMA = f"""
prisma_models AS ({_pairs("language = 'unknown' OR contains(content, 'model ')", catalog.PRISMA_MODEL)}),
prisma_parts AS (
  SELECT *, coalesce({_cap('body', catalog.PRISMA_TABLE)}, {_snake('head')} || 's') AS table_name,
    unnest(range(len(string_split(body, chr(10))))) AS col_seq, regexp_replace(unnest(string_split(body, chr(10))), '^\\s+|\\s+$', '', 'g') AS part FROM prisma_models
),
prisma_fields AS (
  SELECT *, {_cap('part', catalog.PRISMA_FIELD, 1)} AS field, {_cap('part', catalog.PRISMA_FIELD, 2)} AS data_type,
    regexp_extract(part, {q(catalog.PRISMA_FIELD)}, 4) AS rest
  FROM prisma_parts WHERE regexp_matches(part, {q(catalog.PRISMA_FIELD)}) AND NOT starts_with(part, '//') AND NOT starts_with(part, '@@')
),
prisma AS (
  SELECT project_id, file_id, file_path, table_seq, table_name, col_seq, coalesce({_cap('rest', catalog.PRISMA_COLUMN)}, {_snake('field')}) AS column_name,
    data_type, contains(rest, '@id') AS is_primary_key, ends_with(field, 'Id') AS is_foreign_key, {_NO_TARGET}
  FROM prisma_fields WHERE NOT contains(rest, '@relation') AND (data_type IN ({_listed(*catalog.PRISMA_SCALARS)}) OR left(data_type, 1) <> upper(left(data_type, 1)))
)
"""

# RE2 has no lookahead: a body is everything up to a line break run that an indented line does not follow.
_PYTHON_CLASS = r"class\s+(\w+)\s*\([^)]*\)\s*:((?:[^\n]|\n+[ \t])*)"
SQLALCHEMY = f"""
python_classes AS ({_pairs("language = 'python'", _PYTHON_CLASS)}),
python_fields AS (
  SELECT *, unnest(range(len(regexp_extract_all(body, {q(catalog.PYTHON_FIELD)})))) AS col_seq,
    unnest(regexp_extract_all(body, {q(catalog.PYTHON_FIELD)}, 1)) AS column_name, unnest(regexp_extract_all(body, {q(catalog.PYTHON_FIELD)}, 2)) AS args
  FROM python_classes WHERE regexp_matches(body, {q(catalog.PYTHON_TABLE)})
),
sqlalchemy AS (
  SELECT project_id, file_id, file_path, table_seq, {_cap('body', catalog.PYTHON_TABLE)} AS table_name, col_seq, column_name,
    coalesce({_cap('args', catalog.PYTHON_TYPE, 1, 'i')}, 'unknown') AS data_type,
    regexp_matches(args, 'primary_key=True|primary_key = True') AS is_primary_key, contains(args, 'ForeignKey') AS is_foreign_key,
    {_cap('args', catalog.PYTHON_REFERENCE, 1)} AS foreign_table, {_cap('args', catalog.PYTHON_REFERENCE, 2)} AS foreign_column
  FROM python_fields
)
"""

_GO = {g: f"unnest(regexp_extract_all(body, {q(catalog.GO_FIELD)}, {g}))" for g in (1, 2, 3)}
GO = f"""
go_structs AS ({_pairs("language = 'go'", catalog.GO_STRUCT)}),
go_names AS (
  SELECT file_id, unnest(regexp_extract_all(content, {q(catalog.GO_TABLE)}, 1)) AS head, unnest(regexp_extract_all(content, {q(catalog.GO_TABLE)}, 2)) AS name FROM texts WHERE language = 'go'
),
go_fields AS (
  SELECT s.*, coalesce(n.name, {_snake('s.head')} || 's') AS table_name, unnest(range(len(regexp_extract_all(body, {q(catalog.GO_FIELD)})))) AS col_seq,
    {_GO[1]} AS field, {_GO[2]} AS data_type, {_GO[3]} AS tags
  FROM go_structs s LEFT JOIN go_names n ON n.file_id = s.file_id AND n.head = s.head WHERE regexp_matches(body, 'gorm:|db:|json:')
),
go AS (
  SELECT project_id, file_id, file_path, table_seq, table_name, col_seq,
    coalesce({_cap('tags', catalog.GO_GORM_COLUMN)}, {_cap('tags', catalog.GO_JSON_NAME)}, {_snake('field')}) AS column_name, data_type,
    regexp_matches(tags, 'primary[Kk]ey') OR field = 'ID' AS is_primary_key, ends_with(field, 'ID') AND field <> 'ID' AS is_foreign_key, {_NO_TARGET}
  FROM go_fields WHERE NOT contains(data_type, '.') OR contains(tags, 'column:')
)
"""

_JAVA_ENTITY = catalog.JAVA_ENTITY.replace("[^]", r"[\s\S]")
_JF = q(catalog.JAVA_FIELD)
JPA = f"""
java_entities AS ({_pairs("language = 'java'", _JAVA_ENTITY)}),
java_fields AS (
  SELECT *, unnest(range(len(regexp_extract_all(body, {_JF})))) AS col_seq, unnest(regexp_extract_all(body, {_JF}, 1)) AS explicit,
    unnest(regexp_extract_all(body, {_JF}, 2)) AS data_type, unnest(regexp_extract_all(body, {_JF}, 3)) AS field,
    regexp_extract_all(body, {_JF}) AS found, regexp_split_to_array(body, {_JF}) AS gaps
  FROM java_entities
),
java_before AS (
  SELECT *, right(array_to_string(list_transform(range(1, col_seq + 2), lambda i: gaps[i] || CASE WHEN i <= col_seq THEN found[i] ELSE '' END), ''), 200) AS before FROM java_fields
),
jpa AS (
  SELECT project_id, file_id, file_path, table_seq, coalesce({_cap('content', catalog.JAVA_TABLE)}, {_snake('head')} || 's') AS table_name, col_seq,
    coalesce(nullif(explicit, ''), {_snake('field')}) AS column_name, data_type, contains(before, '@Id') AS is_primary_key,
    contains(before, '@ManyToOne') OR contains(before, '@JoinColumn') AS is_foreign_key, {_NO_TARGET}
  FROM java_before
)
"""


@query("p1_ddl_columns", _with(_FILES, DDL, select=f"SELECT {_OUT} FROM ddl"))
def ddl_columns(spark, sf):
    return catalog.ddl_columns(source_files(spark, sf))


@query("p2_prisma_columns", _with(_FILES, PRISMA, select=f"SELECT {_OUT} FROM prisma"))
def prisma_columns(spark, sf):
    return catalog.prisma_columns(source_files(spark, sf))


@query("p3_sqlalchemy_columns", _with(_FILES, SQLALCHEMY, select=f"SELECT {_OUT} FROM sqlalchemy"))
def sqlalchemy_columns(spark, sf):
    return catalog.sqlalchemy_columns(source_files(spark, sf))


@query("p4_go_columns", _with(_FILES, GO, select=f"SELECT {_OUT} FROM go"))
def go_columns(spark, sf):
    return catalog.go_columns(source_files(spark, sf))


@query("p5_jpa_columns", _with(_FILES, JPA, select=f"SELECT {_OUT} FROM jpa"))
def jpa_columns(spark, sf):
    return catalog.jpa_columns(source_files(spark, sf))


_ALL = "found AS (" + " UNION ALL ".join(
    f"SELECT {_OUT}, '{parser}' AS parser FROM {cte} WHERE {flag}"
    for parser, cte, flag in (
        ("ddl", "ddl", o.IS_SCHEMA),
        ("prisma", "prisma", o.IS_ORM_SCHEMA),
        ("sqlalchemy", "sqlalchemy", o.IS_ORM_SCHEMA),
        ("gorm", "go", o.IS_ORM_SCHEMA),
        ("jpa", "jpa", o.IS_ORM_SCHEMA),
    )
) + """), identified AS (
  SELECT *, md5(project_id || '|' || file_path || '|' || parser || '|' || table_seq) AS schema_id,
    md5(project_id || '|' || file_path || '|' || parser || '|' || table_seq || '|' || col_seq) AS column_id FROM found
)"""
CATALOG = ", ".join([_FILES, DDL, PRISMA, SQLALCHEMY, GO, JPA, _ALL])


@query("p6_db_schemas", _with(CATALOG, select="SELECT DISTINCT schema_id AS id, project_id, table_name FROM identified"))
def db_schemas(spark, sf):
    return catalog.db_schemas(catalog.build_catalog(source_files(spark, sf)))


@query(
    "p6_db_columns",
    _with(
        CATALOG,
        select="""SELECT column_id AS id, schema_id, column_name, data_type, is_primary_key, is_foreign_key, foreign_table, foreign_column,
        CAST(NULL AS VARCHAR) AS ai_description FROM identified""",
    ),
)
def db_columns(spark, sf):
    return catalog.db_columns(catalog.build_catalog(source_files(spark, sf)))


@query(
    "p6_catalog_deduped",
    _with(
        CATALOG,
        select="""SELECT project_id, table_name, column_name, arg_min(column_id, [CASE parser WHEN 'ddl' THEN '0' WHEN 'prisma' THEN '1' WHEN 'sqlalchemy' THEN '2' WHEN 'gorm' THEN '3' ELSE '4' END,
        file_path, printf('%09d', table_seq), printf('%09d', col_seq)]) AS column_id FROM identified GROUP BY ALL""",
    ),
)
def catalog_deduped(spark, sf):
    return catalog.build_catalog(source_files(spark, sf), dedupe=True).select(
        "project_id", "table_name", "column_name", "column_id"
    )
