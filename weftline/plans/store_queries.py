"""Queries over stored tables: samples, metadata, maintenance, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import display, names
from weftline.operators import maintenance
from weftline.plans import bindings as b
from weftline.plans.bindings import bind, load, plain
from weftline.plans.registry import query
from weftline.plans.report_queries import text
from weftline.sources import inventory

_SAMPLED = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "orders": ["o_orderkey"],
    "events": ["event_id"],
    "pages": ["page_id"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
    "documents": ["doc_id"],
    "benchmark": ["item_id"],
    "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
    "embeddings": ["vec_id"],
}
_CELLS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate:ts", "o_orderpriority"],
    "events": ["event_id", "ts:ts", "user_id", "event_type", "value", "props"],
    "pages": ["page_id", "url", "html"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate:ts",
    ],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
    "embeddings": ["vec_id", "embedding:digits", "label"],
}
# Single-precision numbers are shown in as many digits on both sides.
_DIGITS = "%.6f"


def _cell(column: str) -> str:
    name, _, kind = column.partition(":")
    value = {
        "": f"CAST({name} AS VARCHAR)",
        "ts": f"strftime({name}, '%Y-%m-%dT%H:%M:%S.%gZ')",
        "digits": f"array_to_string(list_transform({name}, lambda x: printf('{_DIGITS}', CAST(x AS DOUBLE))), ' ')",
    }[kind]
    return f"'{name}': coalesce({value}, '')"


_SAMPLES = " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{t}' AS table_name, CAST(row_number() OVER (ORDER BY {', '.join(_SAMPLED[t])}) AS INT) AS row_no, "
    f"CAST(to_json({{{', '.join(_cell(c) for c in cells)}}}) AS VARCHAR) AS row, CAST(NULL AS VARCHAR) AS error FROM {t}) WHERE row_no <= 10"
    for t, cells in _CELLS.items()
)


@query("s6_table_samples", f"{_SAMPLES} UNION ALL SELECT 'missing', NULL, NULL, 'Error: PATH_NOT_FOUND'")
def table_samples(spark, sf):
    def digits():
        shown = F.transform("embedding", lambda x: F.format_string(_DIGITS, x.cast("double")))
        return load(spark, sf, "embeddings").withColumn("embedding", F.array_join(shown, " "))

    tables = {t: (lambda t=t: load(spark, sf, t)) for t in [*_SAMPLED, "missing"]} | {"embeddings": digits}
    return inventory.sample_tables(spark, tables, order_by=_SAMPLED)


@query(
    "s7_table_inventory",
    " UNION ALL ".join(f"SELECT 'main' AS schema_name, '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in b.TABLES),
)
def table_inventory(spark, sf):
    found = inventory.table_inventory({("main", t): load(spark, sf, t) for t in b.TABLES})
    return found.select("schema_name", "table_name", "row_count")


# A database's own catalog, read from the given tables: nations are tables, customers columns.
_META = {
    "columns": """SELECT c_nationkey AS object_id, c_custkey AS column_id, 'key_' || CAST(c_custkey AS STRING) AS column_name, CAST(c_custkey % 6 AS INT) AS type_id,
      CASE WHEN c_custkey % 4 = 0 THEN -1 ELSE CAST(c_custkey % 90 AS INT) END AS max_length, CAST(c_custkey % 18 AS INT) AS precision, CAST(c_custkey % 5 AS INT) AS scale,
      c_custkey % 3 = 0 AS is_nullable, c_custkey % 50 = 1 AS is_identity FROM {customer}""",
    "tables": "SELECT n_nationkey AS object_id, n_regionkey AS schema_id, n_name AS table_name, n_nationkey % 6 = 5 AS is_ms_shipped FROM {nation}",
    "schemas": "SELECT r_regionkey AS schema_id, lower(r_name) AS schema_name FROM {region}",
    "types": """SELECT DISTINCT CAST(c_custkey % 6 AS INT) AS type_id, CASE c_custkey % 6 WHEN 0 THEN 'int' WHEN 1 THEN 'varchar' WHEN 2 THEN 'decimal'
      WHEN 3 THEN 'nchar' WHEN 4 THEN 'datetime2' ELSE 'numeric' END AS data_type FROM {customer}""",
    "primary_keys": "SELECT c_nationkey AS object_id, c_custkey AS column_id FROM {customer} WHERE c_acctbal > 8000",
    "foreign_keys": "SELECT c_nationkey AS object_id, c_custkey AS column_id, 'region' AS referenced_table, 'r_regionkey' AS referenced_column FROM {customer} WHERE c_mktsegment = 'BUILDING'",
    "descriptions": "SELECT c_nationkey AS object_id, c_custkey AS column_id, 'about ' || c_name AS column_description FROM {customer} WHERE c_mktsegment = 'MACHINERY'",
}
_META_CTES = "WITH " + ", ".join(f"{n} AS ({plain(s)})" for n, s in _META.items()) + """, metadata AS (
  SELECT schema_name, table_name, c.column_id AS ordinal, column_name, data_type, max_length, precision, scale, is_nullable, is_identity,
    CASE WHEN p.column_id IS NULL THEN 0 ELSE 1 END AS is_primary_key, CASE WHEN f.column_id IS NULL THEN 0 ELSE 1 END AS is_foreign_key,
    referenced_table, referenced_column, column_description
  FROM columns c JOIN tables t ON t.object_id = c.object_id JOIN schemas s ON s.schema_id = t.schema_id JOIN types y ON y.type_id = c.type_id
  LEFT JOIN primary_keys p ON p.object_id = c.object_id AND p.column_id = c.column_id
  LEFT JOIN foreign_keys f ON f.object_id = c.object_id AND f.column_id = c.column_id
  LEFT JOIN descriptions d ON d.object_id = c.object_id AND d.column_id = c.column_id
  WHERE NOT is_ms_shipped
)"""


def _metadata(spark, sf):
    return inventory.column_metadata(**{name: bind(spark, sf, sql) for name, sql in _META.items()})


@query("s8_column_metadata", f"{_META_CTES} SELECT * FROM metadata")
def column_metadata(spark, sf):
    return _metadata(spark, sf)


@query(
    "s9_schema_document",
    f"""{_META_CTES}, paged AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY schema_name, table_name ORDER BY ordinal, column_name) - 1) / 50) AS INT) AS page FROM metadata)
    SELECT schema_name, table_name, page, CAST(to_json(list({{'name': column_name, 'type': data_type, 'maxLength': max_length, 'precision': precision, 'scale': scale,
      'nullable': is_nullable, 'identity': is_identity, 'primaryKey': is_primary_key = 1,
      'foreignKey': CASE WHEN is_foreign_key = 1 THEN {{'table': referenced_table, 'column': referenced_column}} END, 'description': column_description}} ORDER BY ordinal, column_name)) AS VARCHAR) AS columns
    FROM paged GROUP BY ALL""",
)
def schema_document(spark, sf):
    return inventory.schema_document(_metadata(spark, sf), 50).withColumn("columns", text("columns"))


@query("s9_schema_totals", f"{_META_CTES} SELECT count(DISTINCT schema_name || '.' || table_name) AS tables, count(*) AS columns FROM metadata")
def schema_totals(spark, sf):
    return inventory.schema_totals(_metadata(spark, sf))


@query(
    "s10_ddl_lines",
    f"""{_META_CTES}, marked AS (SELECT *, row_number() OVER (PARTITION BY schema_name, table_name ORDER BY ordinal DESC) = 1 AS last FROM metadata)
    SELECT schema_name, table_name, 1 AS part, ordinal, '  [' || column_name || '] ' || upper(data_type)
      || CASE WHEN data_type IN ('varchar', 'nchar') THEN CASE WHEN max_length = -1 THEN '(MAX)' ELSE '(' || max_length || ')' END
           WHEN data_type IN ('decimal', 'numeric') THEN '(' || precision || ', ' || scale || ')' ELSE '' END
      || CASE WHEN is_identity THEN ' IDENTITY' ELSE '' END || CASE WHEN NOT is_nullable THEN ' NOT NULL' ELSE '' END
      || CASE WHEN is_primary_key = 1 THEN ' PRIMARY KEY' ELSE '' END || CASE WHEN last THEN '' ELSE ',' END AS line FROM marked
    UNION ALL SELECT DISTINCT schema_name, table_name, 0, 0, '-- Table: ' || schema_name || '.' || table_name || chr(10) || 'CREATE TABLE [' || schema_name || '].[' || table_name || '] (' FROM metadata
    UNION ALL SELECT DISTINCT schema_name, table_name, 2, 0, ');' || chr(10) FROM metadata""",
)
def ddl_lines(spark, sf):
    return inventory.ddl_lines(_metadata(spark, sf))


_STORE = {
    "column_usages": b.PROJECT_USAGES,
    "db_columns": b.PROJECT_COLUMNS,
    "db_schemas": b.PROJECT_SCHEMAS,
    "source_files": b.PROJECT_FILES,
    "processing_jobs": b.JOBS,
    "projects": b.PROJECTS,
}
_DOOMED = "SELECT 'c' || CAST(c_custkey AS STRING) AS project_id FROM {customer} WHERE c_mktsegment = 'FURNITURE'"
_STORE_CTES = "WITH " + ", ".join(f"{n} AS ({plain(s)})" for n, s in [*_STORE.items(), ("doomed", _DOOMED)])


@query(
    "d1_purge_projects",
    f"""{_STORE_CTES}, gone_schemas AS (SELECT id FROM db_schemas WHERE project_id IN (SELECT project_id FROM doomed)),
    gone_columns AS (SELECT id FROM db_columns WHERE schema_id IN (SELECT id FROM gone_schemas))
    SELECT 'column_usages' AS table_name, id FROM column_usages WHERE column_id NOT IN (SELECT id FROM gone_columns)
    UNION ALL SELECT 'db_columns', id FROM db_columns WHERE schema_id NOT IN (SELECT id FROM gone_schemas)
    UNION ALL SELECT 'db_schemas', id FROM db_schemas WHERE project_id NOT IN (SELECT project_id FROM doomed)
    UNION ALL SELECT 'source_files', id FROM source_files WHERE project_id NOT IN (SELECT project_id FROM doomed)
    UNION ALL SELECT 'processing_jobs', id FROM processing_jobs WHERE project_id NOT IN (SELECT project_id FROM doomed)
    UNION ALL SELECT 'projects', id FROM projects WHERE id NOT IN (SELECT project_id FROM doomed)""",
)
def purge_projects(spark, sf):
    left = maintenance.purge_projects({n: bind(spark, sf, s) for n, s in _STORE.items()}, bind(spark, sf, _DOOMED))
    rows = [df.select(F.lit(name).alias("table_name"), "id") for name, df in left.items()]
    kept = rows[0]
    for more in rows[1:]:
        kept = kept.unionByName(more)
    return kept


# Stored results come from older orders, new ones from the rest.
_LATEST = f"""
SELECT project_id, table_name, column_name, data_lineage_type, lineage_data, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, table_name, column_name ORDER BY updated_at DESC, lineage_data DESC NULLS LAST) AS rn FROM ({b.RESULTS}) r WHERE updated_at < TIMESTAMP '1998-01-01 00:00:00'
) s WHERE rn = 1
"""
_NEWER = f"SELECT project_id, table_name, column_name, data_lineage_type, lineage_data, updated_at FROM ({b.RESULTS}) r WHERE updated_at >= TIMESTAMP '1998-01-01 00:00:00'"


@query(
    "d2_upsert_results",
    f"""WITH stored AS ({plain(_LATEST)}), new AS ({plain(_NEWER)}),
    latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_id, table_name, column_name ORDER BY updated_at DESC, lineage_data DESC NULLS LAST) AS rn FROM new) WHERE rn = 1)
    SELECT * REPLACE (CAST(updated_at AS VARCHAR) AS updated_at) FROM (SELECT * FROM latest UNION ALL SELECT * FROM stored s WHERE NOT EXISTS (
      SELECT 1 FROM latest l WHERE l.project_id = s.project_id AND l.table_name = s.table_name AND l.column_name IS NOT DISTINCT FROM s.column_name))""",
)
def upsert_results(spark, sf):
    kept = maintenance.upsert_results(bind(spark, sf, _LATEST), bind(spark, sf, _NEWER))
    return kept.withColumn("updated_at", F.col("updated_at").cast("string"))


@query(
    "d3_invalidate_results",
    f"WITH results AS ({plain(b.RESULTS)}) SELECT project_id, table_name, column_name, lineage_data FROM results WHERE project_id NOT IN (SELECT 'p' || c_custkey FROM customer WHERE c_nationkey = 4)",
)
def invalidate_results(spark, sf):
    gone = load(spark, sf, "customer").filter("c_nationkey = 4").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("project_id"))
    kept = maintenance.invalidate_results(bind(spark, sf, b.RESULTS), gone)
    return kept.select("project_id", "table_name", "column_name", "lineage_data")


_RETRIES = "SELECT 'j' || CAST(event_id AS STRING) AS job_id, 'c' || CAST(CASE WHEN event_id % 5 = 0 THEN user_id + 1 ELSE user_id END AS STRING) AS project_id FROM {events} WHERE event_type = 'error'"
_RETRY_CTES = "WITH " + ", ".join(f"{n} AS ({plain(s)})" for n, s in [("jobs", b.JOBS), ("projects", b.PROJECTS), ("retries", _RETRIES)])


def _retried(spark, sf):
    return maintenance.retry_jobs(*(bind(spark, sf, x) for x in (b.JOBS, b.PROJECTS, _RETRIES)))


@query(
    "d4_retried_jobs",
    f"""{_RETRY_CTES}, marked AS (SELECT j.*, EXISTS (SELECT 1 FROM retries r WHERE r.job_id = j.id AND r.project_id = j.project_id) AS again FROM jobs j)
    SELECT id, project_id, CASE WHEN again THEN 'pending' ELSE status END AS status, CASE WHEN again THEN 0 ELSE progress END AS progress, total,
      CASE WHEN again THEN NULL ELSE error_message END AS error_message, CASE WHEN again THEN NULL ELSE epoch_us(started_at) END AS started_at,
      CASE WHEN again THEN NULL ELSE epoch_us(completed_at) END AS completed_at FROM marked""",
)
def retried_jobs(spark, sf):
    micros = {c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("started_at", "completed_at")}
    return _retried(spark, sf)[0].withColumns(micros).drop("job_type", "created_at")


@query(
    "d4_retried_projects",
    f"""{_RETRY_CTES} SELECT id, CASE WHEN status = 'failed' AND id IN (SELECT project_id FROM retries) THEN 'processing' ELSE status END AS status FROM projects""",
)
def retried_projects(spark, sf):
    return _retried(spark, sf)[1].select("id", "status")


_REPORT_ROOTS = "SELECT 'r' || CAST(o_orderkey AS STRING) AS root_id, 'p' || CAST(o_custkey % 20 AS STRING) AS project_id, o_orderpriority AS table_name, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS column_name FROM {orders}"
_OUTCOMES = """SELECT DISTINCT 'r' || CAST(l_orderkey AS STRING) AS root_id, CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE 'tree ' || CAST(l_orderkey AS STRING) END AS lineage_json,
  CASE WHEN l_orderkey % 6 = 0 THEN 'broke at ' || CAST(l_orderkey AS STRING) END AS error FROM {lineitem}"""


@query(
    "d5_run_report",
    f"""WITH roots AS ({plain(_REPORT_ROOTS)}), outcomes AS ({plain(_OUTCOMES)})
    SELECT r.root_id, project_id, table_name, column_name, CASE WHEN o.root_id IS NULL THEN 'running' WHEN error IS NOT NULL THEN 'failed' ELSE 'completed' END AS status,
      '2024-05-01 00:00:00' AS started_at, CASE WHEN o.root_id IS NOT NULL THEN '2024-05-01 00:01:00' END AS ended_at, lineage_json, error AS exception_stack_trace
    FROM roots r LEFT JOIN outcomes o ON o.root_id = r.root_id""",
)
def run_report(spark, sf):
    return maintenance.run_report(
        bind(spark, sf, _REPORT_ROOTS), bind(spark, sf, _OUTCOMES), F.lit("2024-05-01 00:00:00"), F.lit("2024-05-01 00:01:00")
    )


_NAMES = """
SELECT p_partkey, 'user' || p_type || 'Size' || CAST(p_size AS STRING) || 'ID' || CASE WHEN p_size % 2 = 0 THEN 'HTTPServer' ELSE 'x' END AS mixed,
       replace(p_name, ' ', '_') || '_' || lower(p_type) || '_' || CAST(p_size AS STRING) || CASE WHEN p_size % 3 = 0 THEN '__a_B_cs' ELSE 's' END AS snaked
FROM {part}
"""


@query(
    "f1_f4_names",
    f"""WITH names AS ({plain(_NAMES)}), camels AS (SELECT *, list_reduce(list_concat([''], list_transform(regexp_extract_all(snaked, '_[a-z]|_|[^_]+'),
        lambda x: CASE WHEN regexp_full_match(x, '_[a-z]') THEN upper(substr(x, 2)) ELSE x END)), lambda a, x: a || x) AS camel,
      lower(regexp_replace(regexp_replace(mixed, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')) AS snake FROM names)
    SELECT p_partkey, snake, camel, upper(left(camel, 1)) || substr(camel, 2) AS pascal, snake || 's' AS plural,
      CASE WHEN ends_with(snaked, 's') THEN left(snaked, length(snaked) - 1) ELSE snaked END AS singular FROM camels""",
)
def name_forms(spark, sf):
    mixed, snaked = F.col("mixed"), F.col("snaked")
    return bind(spark, sf, _NAMES).select(
        "p_partkey",
        names.to_snake(mixed).alias("snake"),
        names.to_camel(snaked).alias("camel"),
        names.to_pascal(snaked).alias("pascal"),
        names.plural_table(mixed).alias("plural"),
        names.singular(snaked).alias("singular"),
    )


@query(
    "f5_f9_previews",
    """SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS shown, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS preview,
    array_to_string(range(doc_id % 6)[1:3], ', ') || CASE WHEN doc_id % 6 > 3 THEN '...' ELSE '' END AS lines FROM documents""",
)
def previews(spark, sf):
    numbers = F.slice(F.sequence(F.lit(0), F.col("doc_id") % 6), F.lit(1), (F.col("doc_id") % 6).cast("int"))
    return load(spark, sf, "documents").select(
        "doc_id",
        display.clipped(F.col("text")).alias("shown"),
        display.description_preview(F.col("text")).alias("preview"),
        display.line_preview(numbers).alias("lines"),
    )


@query(
    "f6_uuid_numbers",
    "SELECT event_id, CAST('0x' || left(md5(CAST(event_id AS VARCHAR)), 8) AS BIGINT) AS number FROM events",
)
def uuid_numbers(spark, sf):
    digest = F.md5(F.col("event_id").cast("string"))
    uuid = F.concat_ws("-", F.substring(digest, 1, 6), F.substring(digest, 7, 26))
    return load(spark, sf, "events").select("event_id", display.uuid_number(uuid).alias("number"))


@query(
    "f7_f8_durations",
    """SELECT event_id, CASE WHEN secs < 60 THEN secs || 's' ELSE (secs // 60) || 'm ' || (secs % 60) || 's' END AS duration,
    CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(floor(CAST(user_id AS DOUBLE) * 100 / (event_id % 5) + 0.5) AS INT) END AS percent
    FROM (SELECT *, CAST(floor(epoch_us(ts + value * INTERVAL '1' SECOND) / 1000000.0 - epoch_us(ts) / 1000000.0 + 0.5) AS BIGINT) AS secs FROM events)""",
)
def durations(spark, sf):
    rows = bind(spark, sf, "SELECT *, ts + value * INTERVAL '1' SECOND AS ended FROM {events}")
    return rows.select(
        "event_id",
        display.duration_text(F.col("ts"), F.col("ended"), F.current_timestamp()).alias("duration"),
        display.progress_percent(F.col("user_id"), F.col("event_id") % 5).alias("percent"),
    )
