"""Queries over projects, catalogs, usages and components."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weftline.operators import describe, impact, reports
from weftline.plans import bindings as b
from weftline.plans.bindings import bind, plain
from weftline.plans.registry import query

PAGE = 100


def text(column: str | Column) -> Column:
    return F.to_json(column, {"ignoreNullFields": "false"})


def _ctes(**ctes: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({plain(sql)})" for name, sql in ctes.items())


_DETAIL_SQL = """
SELECT u.id AS usage_id, u.usage_type, u.line_number, u.code_snippet, u.context, c.id AS column_id, c.column_name, c.data_type, c.is_primary_key,
       c.is_foreign_key, c.foreign_table, c.foreign_column, c.ai_description, s.table_name, s.project_id, f.id AS file_id, f.file_path, f.language
FROM usages u JOIN db_columns c ON u.column_id = c.id JOIN db_schemas s ON c.schema_id = s.id JOIN files f ON u.source_file_id = f.id
"""
DETAIL = _ctes(
    usages=b.USAGES, db_columns=b.DB_COLUMNS, db_schemas=b.DB_SCHEMAS, files=b.USAGE_FILES, detail=_DETAIL_SQL
)


def detail(spark, sf):
    return reports.usage_detail(*(bind(spark, sf, x) for x in (b.USAGES, b.DB_COLUMNS, b.DB_SCHEMAS, b.USAGE_FILES)))


@query("r1_usage_detail", f"{DETAIL} SELECT * FROM detail")
def usage_detail(spark, sf):
    return reports.usage_listing(detail(spark, sf))


@query("r1_usage_detail_of_projects", f"{DETAIL} SELECT * FROM detail WHERE project_id IN ('p3', 'p4')")
def usage_detail_of_projects(spark, sf):
    frames = (bind(spark, sf, x) for x in (b.USAGES, b.DB_COLUMNS, b.DB_SCHEMAS, b.USAGE_FILES))
    return reports.usage_listing(reports.usage_detail(*frames, project_ids=["p3", "p4"]))


_PER_FILE = """
per_file AS (
  SELECT project_id, table_name, column_name, file_id, min(file_path) AS file_path, min(language) AS language,
         list_sort(list(DISTINCT usage_type)) AS usage_types, list(line_number ORDER BY line_number) AS line_numbers, count(*) AS usages
  FROM detail GROUP BY ALL
),
totals AS (
  SELECT project_id, table_name, column_name, min(column_id) AS column_id, arg_min(data_type, column_id) AS data_type, arg_min(is_primary_key, column_id) AS is_primary_key,
         count(DISTINCT file_id) AS file_count, count(*) AS total_usages
  FROM detail GROUP BY ALL
)
"""


@query(
    "r2_column_summary",
    f"""{DETAIL}, {_PER_FILE}, paged AS (
      SELECT *, CAST(floor((row_number() OVER (PARTITION BY project_id, table_name, column_name ORDER BY file_path, file_id) - 1) / {PAGE}) AS INT) AS page FROM per_file)
    SELECT p.project_id, p.table_name, p.column_name, p.page, t.column_id, t.data_type, t.is_primary_key, t.file_count, t.total_usages,
      CAST(to_json(list({{'file_id': file_id, 'file_path': file_path, 'language': language, 'usage_types': usage_types, 'line_numbers': line_numbers}} ORDER BY file_path, file_id)) AS VARCHAR) AS files
    FROM paged p JOIN totals t ON t.project_id = p.project_id AND t.table_name = p.table_name AND t.column_name = p.column_name GROUP BY ALL""",
)
def column_summary(spark, sf):
    kept = ["project_id", "table_name", "column_name", "page", "column_id", "data_type", "is_primary_key", "file_count", "total_usages"]
    return reports.column_summary(detail(spark, sf), PAGE).select(*kept, text("files").alias("files"))


@query(
    "r3_file_summary",
    f"""{DETAIL}, {_PER_FILE} SELECT project_id, table_name, column_name, file_id, file_path, language,
    array_to_string(usage_types, ',') AS usage_types, array_to_string(line_numbers, ',') AS line_numbers, usages FROM per_file""",
)
def file_summary(spark, sf):
    return (
        reports.file_summary(detail(spark, sf))
        .drop("facts")
        .withColumn("usage_types", F.array_join("usage_types", ","))
        .withColumn("line_numbers", F.array_join(F.col("line_numbers").cast("array<string>"), ","))
    )


@query(
    "r4_table_rollup",
    f"{DETAIL}, {_PER_FILE} SELECT project_id, table_name, count(*) AS columns, CAST(sum(total_usages) AS BIGINT) AS usages FROM totals GROUP BY ALL",
)
def table_rollup(spark, sf):
    return reports.table_rollup(reports.column_totals(reports.file_summary(detail(spark, sf))))


_PROJECTS = _ctes(projects=b.PROJECTS, files=b.PROJECT_FILES, schemas=b.PROJECT_SCHEMAS, applications=b.APPLICATIONS, usages=b.PROJECT_USAGES)
_PROJECT_COUNTS = """
SELECT id, user_id, application_id, name, status, CAST(created_at AS VARCHAR) AS created_at,
  (SELECT count(*) FROM files WHERE project_id = p.id) AS file_count, (SELECT count(*) FROM schemas WHERE project_id = p.id) AS table_count
FROM projects p
"""


def _projects(spark, sf, **options):
    frames = (bind(spark, sf, x) for x in (b.PROJECTS, b.PROJECT_FILES, b.PROJECT_SCHEMAS))
    return reports.project_list(*frames, **options).withColumn("created_at", F.col("created_at").cast("string"))


@query("r5_project_list", f"{_PROJECTS} {_PROJECT_COUNTS}")
def project_list(spark, sf):
    return _projects(spark, sf)


@query("r6_projects_of_application", f"{_PROJECTS} {_PROJECT_COUNTS} WHERE user_id = 'u3' AND application_id = 'a4'")
def projects_of_application(spark, sf):
    return _projects(spark, sf, user_id="u3", application_id="a4")


@query(
    "r7_application_list",
    f"{_PROJECTS} SELECT a.*, (SELECT count(*) FROM projects WHERE application_id = a.id) AS project_count FROM applications a",
)
def application_list(spark, sf):
    return reports.application_list(bind(spark, sf, b.APPLICATIONS), bind(spark, sf, b.PROJECTS))


@query("r8_status_tally", f"{_PROJECTS} SELECT count(*) AS projects, count(*) FILTER (WHERE status = 'completed') AS completed FROM projects")
def status_tally(spark, sf):
    return reports.status_tally(bind(spark, sf, b.PROJECTS))


_TREE = _ctes(schemas=b.NATION_SCHEMAS, columns=b.NATION_COLUMNS)
_TREE_PAGES = f"""
numbered AS (
  SELECT s.id AS schema_id, s.project_id, s.table_name, c.* EXCLUDE (schema_id),
    CAST(floor((row_number() OVER (PARTITION BY s.id ORDER BY c.column_name, c.id) - 1) / {PAGE}) AS INT) AS page
  FROM schemas s LEFT JOIN columns c ON c.schema_id = s.id
)
"""
_COLUMN_STRUCT = """{'id': id, 'column_name': column_name, 'data_type': data_type, 'is_primary_key': is_primary_key, 'is_foreign_key': is_foreign_key,
  'foreign_table': foreign_table, 'foreign_column': foreign_column, 'ai_description': ai_description}"""


def _tree(spark, sf):
    return reports.schema_tree(bind(spark, sf, b.NATION_SCHEMAS), bind(spark, sf, b.NATION_COLUMNS), PAGE)


@query(
    "r9_schema_tree",
    f"""{_TREE}, {_TREE_PAGES} SELECT project_id, table_name, schema_id, page,
    CAST(to_json(list({_COLUMN_STRUCT} ORDER BY column_name, id) FILTER (WHERE id IS NOT NULL)) AS VARCHAR) AS columns FROM numbered GROUP BY ALL""",
)
def schema_tree(spark, sf):
    return _tree(spark, sf).withColumn("columns", text("columns"))


@query(
    "r26_search_schema",
    f"""{_TREE}, {_TREE_PAGES} SELECT project_id, table_name, schema_id, page,
    CAST(to_json(list({_COLUMN_STRUCT} ORDER BY column_name, id) FILTER (WHERE id IS NOT NULL)) AS VARCHAR) AS columns FROM numbered
    WHERE contains(lower(table_name), 'n_1') OR contains(lower(column_name), 'n_1') OR contains(lower(data_type), 'n_1') OR contains(lower(ai_description), 'n_1') GROUP BY ALL""",
)
def search_schema_by_table(spark, sf):
    return reports.search_schema(_tree(spark, sf), "N_1").withColumn("columns", text("columns"))


@query(
    "r26_search_columns",
    f"""{_TREE}, {_TREE_PAGES} SELECT project_id, table_name, schema_id, page,
    CAST(to_json(list({_COLUMN_STRUCT} ORDER BY column_name, id)) AS VARCHAR) AS columns FROM numbered
    WHERE contains(lower(column_name), '_4') OR contains(lower(data_type), '_4') OR contains(lower(ai_description), '_4') OR contains(lower(table_name), '_4') GROUP BY ALL""",
)
def search_schema_by_column(spark, sf):
    return reports.search_schema(_tree(spark, sf), "_4").withColumn("columns", text("columns"))


@query(
    "r10_project_headline",
    f"""{_PROJECTS}, ids AS (SELECT project_id FROM files UNION SELECT project_id FROM schemas UNION SELECT project_id FROM usages)
    SELECT project_id, (SELECT count(*) FROM files f WHERE f.project_id = i.project_id) AS files, (SELECT count(*) FROM schemas s WHERE s.project_id = i.project_id) AS tables,
      (SELECT count(*) FROM usages u WHERE u.project_id = i.project_id) AS usages, (SELECT count(DISTINCT language) FROM files f WHERE f.project_id = i.project_id) AS languages
    FROM ids i""",
)
def project_headline(spark, sf):
    return reports.project_headline(*(bind(spark, sf, x) for x in (b.PROJECT_FILES, b.PROJECT_SCHEMAS, b.PROJECT_USAGES)))


@query("r11_files_per_language", f"{_PROJECTS} SELECT language, count(*) AS files FROM files GROUP BY ALL")
def files_per_language(spark, sf):
    return reports.files_per_language(bind(spark, sf, b.PROJECT_FILES))


@query(
    "r12_active_languages",
    f"{_PROJECTS} SELECT DISTINCT language FROM files WHERE language IN ('go', 'sql', 'python', 'java', 'typescript')",
)
def active_languages(spark, sf):
    return reports.active_languages(bind(spark, sf, b.PROJECT_FILES))


@query(
    "r13_sql_projects",
    f"""{_PROJECTS} SELECT DISTINCT p.id, p.name FROM projects p JOIN files f ON f.project_id = p.id
    WHERE p.application_id = 'a4' AND f.language IN ('sql', 'db2', 'plsql', 'tsql')""",
)
def sql_projects(spark, sf):
    found = reports.sql_projects(bind(spark, sf, b.PROJECTS), bind(spark, sf, b.PROJECT_FILES), application_id="a4")
    return found.select("id", "name")


_COMPONENTS = _ctes(
    components=b.COMPONENTS, trace=b.TRACE, table_roots=b.TABLE_ROOTS, column_roots=b.COLUMN_ROOTS, schemas=b.NATION_SCHEMAS, columns=b.NATION_COLUMNS
)
_COMPONENT_TABLES = """
SELECT t.id AS table_id, t.component_name AS table_name, c.id AS column_id, c.component_name AS column_name, c.component_desc AS data_type
FROM components t LEFT JOIN components c ON c.parent_component_id = t.id AND c.component_type = 'COLUMN'
WHERE t.component_type = 'TABLE' AND (t.is_noise = false OR t.is_noise IS NULL)
"""
_CATALOG_TABLES = """
SELECT s.id AS table_id, s.table_name, c.id AS column_id, c.column_name, c.data_type FROM schemas s LEFT JOIN columns c ON c.schema_id = s.id
"""


def _components(spark, sf):
    return bind(spark, sf, b.COMPONENTS)


def _nation_catalog(spark, sf):
    return bind(spark, sf, b.NATION_SCHEMAS), bind(spark, sf, b.NATION_COLUMNS)


@query("r14_component_tables", f"{_COMPONENTS} {_COMPONENT_TABLES} AND t.project_id IN ('p0', 'p1', 'p2')")
def component_tables(spark, sf):
    return reports.component_tables(_components(spark, sf), ["p0", "p1", "p2"])


@query("r15_tables_from_components", f"{_COMPONENTS} {_COMPONENT_TABLES}")
def tables_from_components(spark, sf):
    found = reports.component_tables(_components(spark, sf))
    return reports.or_else(found, reports.catalog_tables(*_nation_catalog(spark, sf)))


@query("r15_tables_from_catalog", f"{_COMPONENTS} {_CATALOG_TABLES}")
def tables_from_catalog(spark, sf):
    # parts are functions, so this project has components and no table among them
    none = reports.component_tables(bind(spark, sf, b.PART_COMPONENTS))
    return reports.or_else(none, reports.catalog_tables(*_nation_catalog(spark, sf)))


@query(
    "r16_tables_with_columns",
    f"""{_COMPONENTS}, rows AS ({_COMPONENT_TABLES}), numbered AS (
      SELECT *, CAST(floor((row_number() OVER (PARTITION BY table_name ORDER BY column_name NULLS FIRST, column_id NULLS FIRST, table_id) - 1) / {PAGE}) AS INT) AS page FROM rows)
    SELECT table_name, page, coalesce(CAST(to_json(list({{'column_id': column_id, 'column_name': column_name, 'data_type': data_type}} ORDER BY column_name, column_id, table_id)
      FILTER (WHERE column_id IS NOT NULL)) AS VARCHAR), '[]') AS columns FROM numbered GROUP BY ALL""",
)
def tables_with_columns(spark, sf):
    rows = reports.component_tables(_components(spark, sf))
    return reports.tables_with_columns(rows, PAGE).withColumn("columns", text("columns"))


_OF_TABLES = """
of_tables AS (
  SELECT DISTINCT r.root_id, c.id AS component_id, c.component_name, c.component_type, c.order_seq
  FROM table_roots r JOIN components t ON t.component_name = r.table_name AND t.component_type = 'TABLE'
  JOIN trace e ON e.fk_parent_component_id = t.id JOIN components c ON c.id = e.fk_child_component_id AND c.project_id = r.project_id
  WHERE c.component_type NOT IN ('CREATE_COLUMN_DEFINITION', 'CREATE_TABLE_STATEMENT') AND (c.is_noise = false OR c.is_noise IS NULL)
)
"""


@query("r17_components_of_tables", f"{_COMPONENTS}, {_OF_TABLES} SELECT * FROM of_tables")
def components_of_tables(spark, sf):
    return reports.components_of_tables(bind(spark, sf, b.TABLE_ROOTS), _components(spark, sf), bind(spark, sf, b.TRACE))


_OF_COLUMNS = """
of_columns AS (
  SELECT DISTINCT r.root_id, c.id AS component_id, c.component_name, c.component_type, c.order_seq
  FROM column_roots r JOIN components t ON t.component_name = r.table_name AND t.component_type = 'TABLE'
  JOIN components k ON k.component_name = r.column_name AND k.component_type = 'COLUMN' AND k.parent_component_id = t.id
  JOIN trace e ON e.fk_parent_component_id = k.id JOIN components c ON c.id = e.fk_child_component_id AND c.project_id = r.project_id
  WHERE c.component_type NOT IN ('CREATE_COLUMN_DEFINITION', 'CREATE_TABLE_STATEMENT') AND (c.is_noise = false OR c.is_noise IS NULL)
)
"""


@query("r19_components_of_columns", f"{_COMPONENTS}, {_OF_COLUMNS} SELECT * FROM of_columns")
def components_of_columns(spark, sf):
    return reports.components_of_columns(bind(spark, sf, b.COLUMN_ROOTS), _components(spark, sf), bind(spark, sf, b.TRACE))


_USAGE_ROOTS = "SELECT DISTINCT table_name || '.' || column_name AS root_id, project_id, table_name, column_name FROM detail"


def _usage_roots(rows):
    return rows.select(
        F.concat_ws(".", "table_name", "column_name").alias("root_id"), "project_id", "table_name", "column_name"
    ).distinct()


@query(
    "r18_files_of_tables",
    f"""{DETAIL}, roots AS (SELECT DISTINCT table_name AS root_id, project_id, table_name FROM detail)
    SELECT DISTINCT root_id, file_id AS component_id, file_path AS component_name, 'FILE' AS component_type, language, usage_type, line_number
    FROM detail d JOIN roots r ON r.project_id = d.project_id AND r.table_name = d.table_name""",
)
def files_of_tables(spark, sf):
    rows = detail(spark, sf)
    roots = rows.select(F.col("table_name").alias("root_id"), "project_id", "table_name").distinct()
    return reports.files_of_roots(roots, rows, per_usage=True).drop("order_seq")


@query(
    "r20_files_of_columns",
    f"""{DETAIL}, roots AS ({_USAGE_ROOTS})
    SELECT DISTINCT root_id, file_id AS component_id, file_path AS component_name, 'FILE' AS component_type, language, usage_type
    FROM detail d JOIN roots r ON r.project_id = d.project_id AND r.table_name = d.table_name AND r.column_name = d.column_name""",
)
def files_of_columns(spark, sf):
    rows = detail(spark, sf)
    return reports.files_of_roots(_usage_roots(rows), rows, by_column=True, per_usage=True).drop("order_seq")


@query(
    "r18_components_or_files",
    f"""{DETAIL}, {_COMPONENTS.removeprefix("WITH ").replace("columns AS (", "nation_columns AS (").replace("schemas AS (", "nation_schemas AS (")}, {_OF_TABLES},
    all_roots AS (SELECT root_id, project_id, table_name FROM table_roots UNION SELECT DISTINCT table_name, project_id, table_name FROM detail)
    SELECT root_id, component_id, component_name, component_type FROM of_tables
    UNION ALL SELECT DISTINCT root_id, file_id, file_path, 'FILE' FROM detail d JOIN all_roots r ON r.project_id = d.project_id AND r.table_name = d.table_name
    WHERE root_id NOT IN (SELECT root_id FROM of_tables)""",
)
def components_or_files(spark, sf):
    rows = detail(spark, sf)
    roots = (
        bind(spark, sf, b.TABLE_ROOTS)
        .unionByName(rows.select(F.col("table_name").alias("root_id"), "project_id", "table_name"))
        .distinct()
    )
    found = reports.components_of_tables(roots, _components(spark, sf), bind(spark, sf, b.TRACE))
    files = reports.files_of_roots(roots, rows)
    return reports.with_fallback(found, files).drop("order_seq")


@query(
    "r21_root_columns",
    f"""{_COMPONENTS}, roots AS (SELECT * FROM table_roots UNION ALL SELECT table_name, project_id, table_name FROM schemas),
    found AS (SELECT root_id, c.id AS component_id, c.component_name AS name FROM roots r JOIN components t ON t.project_id = r.project_id AND t.component_name = r.table_name AND t.component_type = 'TABLE'
      JOIN components c ON c.parent_component_id = t.id AND c.component_type = 'COLUMN'),
    listed AS (SELECT root_id, c.id AS component_id, c.column_name AS name FROM roots r JOIN schemas s ON s.project_id = r.project_id AND s.table_name = r.table_name JOIN columns c ON c.schema_id = s.id),
    rows AS (SELECT * FROM found UNION ALL SELECT * FROM listed WHERE root_id NOT IN (SELECT root_id FROM found))
    SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY name, component_id) AS position,
      CASE WHEN row_number() OVER (PARTITION BY root_id ORDER BY name, component_id) % 2 = 1 THEN '#b2f1ca' ELSE '#FFFFFF' END AS color FROM rows""",
)
def root_columns(spark, sf):
    schemas, columns = _nation_catalog(spark, sf)
    roots = bind(spark, sf, b.TABLE_ROOTS).unionByName(
        schemas.select(F.col("table_name").alias("root_id"), "project_id", "table_name")
    )
    return reports.root_columns(roots, _components(spark, sf), schemas, columns)


_VIEW_PROJECTS = "SELECT 'p' || CAST(r_regionkey AS STRING) AS id, r_name AS name FROM {region}"


@query(
    "r22_project_tables_view",
    f"""{_COMPONENTS}, projects AS ({plain(_VIEW_PROJECTS)}) SELECT p.id AS project_id, p.name AS project_name, t.id AS table_id, t.component_name AS table_name,
    c.id AS column_id, c.component_name AS column_name, c.component_desc AS column_description FROM projects p JOIN components t ON t.project_id = p.id AND t.component_type = 'TABLE'
    LEFT JOIN components c ON c.parent_component_id = t.id AND c.component_type = 'COLUMN'""",
)
def project_tables_view(spark, sf):
    return reports.project_tables_view(bind(spark, sf, _VIEW_PROJECTS), _components(spark, sf))


@query(
    "r23_component_hierarchy_view",
    f"""{_COMPONENTS} SELECT p.id AS parent_id, p.component_name AS parent_name, p.component_type AS parent_type, c.id AS child_id, c.component_name AS child_name,
    c.component_type AS child_type, relationship_type FROM trace JOIN components p ON p.id = fk_parent_component_id JOIN components c ON c.id = fk_child_component_id""",
)
def component_hierarchy_view(spark, sf):
    return reports.component_hierarchy_view(bind(spark, sf, b.TRACE), _components(spark, sf))


_SOURCES = _ctes(sources=b.SOURCES)


@query(
    "r24_component_sources",
    f"""{_SOURCES}, wanted AS (SELECT 'o' || o_orderkey AS component_id FROM orders),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY start_line NULLS LAST, end_line, source_code) AS rn FROM sources)
    SELECT component_id AS source_component_id, parent_component_id, source_code, start_line, end_line FROM ranked JOIN wanted USING (component_id) WHERE rn = 1""",
)
def component_sources(spark, sf):
    wanted = b.load(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("component_id"))
    return reports.component_sources(bind(spark, sf, b.SOURCES), wanted)


_RESULTS = _ctes(results=b.RESULTS, requests=b.RESULT_REQUESTS)


@query(
    "r25_latest_results",
    f"""{_RESULTS}, ranked AS (SELECT request_id, lineage_data, CAST(updated_at AS VARCHAR) AS updated_at, row_number() OVER (PARTITION BY request_id ORDER BY r.updated_at DESC, lineage_data DESC NULLS LAST) AS rn
      FROM results r JOIN requests q ON r.project_id = q.project_id AND r.table_name = q.table_name AND r.column_name IS NOT DISTINCT FROM q.column_name)
    SELECT request_id, lineage_data, updated_at FROM ranked WHERE rn = 1 AND lineage_data IS NOT NULL""",
)
def latest_results(spark, sf):
    found = reports.latest_results(bind(spark, sf, b.RESULTS), bind(spark, sf, b.RESULT_REQUESTS))
    return found.withColumn("updated_at", F.col("updated_at").cast("string"))


@query(
    "r27_first_column_usage",
    f"""{DETAIL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id, table_name, column_name ORDER BY file_path, line_number, usage_id, file_id, usage_type) AS rn FROM detail)
    SELECT project_id, table_name, column_name, file_path, line_number, usage_id, file_id, usage_type FROM ranked WHERE rn = 1""",
)
def first_column_usage(spark, sf):
    return reports.first_column_usage(detail(spark, sf))


@query(
    "r27_first_file_usage",
    f"""{DETAIL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id, file_id ORDER BY table_name, column_name, line_number, usage_id, usage_type) AS rn FROM detail)
    SELECT project_id, file_id, table_name, column_name, line_number, usage_id, usage_type FROM ranked WHERE rn = 1""",
)
def first_file_usage(spark, sf):
    return reports.first_file_usage(detail(spark, sf))


# A request names the projects of an order's customer and of its neighbour, some owned by someone else.
_OWNED_REQUESTS = """
SELECT 'q' || CAST(o_orderkey AS STRING) AS request_id, 'u' || CAST(o_custkey % 7 AS STRING) AS user_id, 'c' || CAST(o_custkey AS STRING) AS project_id FROM {orders}
UNION ALL
SELECT 'q' || CAST(o_orderkey AS STRING), 'u' || CAST(o_custkey % 7 AS STRING), 'c' || CAST(o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_orderkey % 3 END AS STRING) FROM {orders}
"""


@query(
    "r28_owned_requests",
    f"""{_PROJECTS}, requests AS ({plain(_OWNED_REQUESTS)}),
    whole AS (SELECT request_id FROM requests r GROUP BY request_id HAVING count(*) = (SELECT count(DISTINCT p.id) FROM requests q JOIN projects p ON p.id = q.project_id AND p.user_id = q.user_id WHERE q.request_id = r.request_id))
    SELECT request_id, user_id, project_id FROM requests WHERE request_id IN (SELECT request_id FROM whole)""",
)
def owned_requests(spark, sf):
    found = reports.owned_requests(bind(spark, sf, _OWNED_REQUESTS), bind(spark, sf, b.PROJECTS))
    return found.select("request_id", "user_id", "project_id")


_JOBS = _ctes(jobs=b.JOBS)
_NOW = "2024-06-01 00:00:00"


@query(
    "r29_job_board",
    f"""{_JOBS}, timed AS (SELECT *, CAST(floor((epoch_us(coalesce(completed_at, TIMESTAMP '{_NOW}')) - epoch_us(started_at)) / 1000000.0 + 0.5) AS BIGINT) AS secs FROM jobs)
    SELECT id, project_id, status, CASE status WHEN 'running' THEN 0 WHEN 'pending' THEN 1 WHEN 'failed' THEN 2 WHEN 'completed' THEN 3 ELSE 4 END AS status_rank,
      CASE WHEN started_at IS NULL THEN '' WHEN secs < 60 THEN secs || 's' ELSE (secs // 60) || 'm ' || (secs % 60) || 's' END AS duration,
      CASE WHEN total > 0 THEN CAST(floor(progress * 100 / total + 0.5) AS INT) ELSE 0 END AS percent FROM timed""",
)
def job_board(spark, sf):
    board = reports.job_board(bind(spark, sf, b.JOBS), F.to_timestamp(F.lit(_NOW)))
    return board.select("id", "project_id", "status", "status_rank", "duration", "percent")


@query(
    "r29_job_totals",
    f"""{_JOBS} SELECT project_id, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS total FROM jobs GROUP BY ALL""",
)
def job_totals(spark, sf):
    return reports.job_totals(bind(spark, sf, b.JOBS))


_NODES = f"""
facts AS (SELECT project_id, table_name, column_name, arg_min(data_type, column_id) AS data_type, arg_min(is_primary_key, column_id) AS is_primary_key,
    arg_min(is_foreign_key, column_id) AS is_foreign_key, count(DISTINCT file_id) AS file_count FROM detail GROUP BY ALL),
nodes AS (SELECT project_id, table_name, 0 AS page, CAST(to_json(list({{'column_name': column_name, 'data_type': data_type, 'is_primary_key': is_primary_key, 'is_foreign_key': is_foreign_key,
    'file_count': file_count}} ORDER BY column_name)) AS VARCHAR) AS columns FROM facts GROUP BY ALL)
"""


@query("g9_table_nodes", f"{DETAIL}, {_NODES} SELECT * FROM nodes")
def table_nodes(spark, sf):
    return impact.table_nodes(detail(spark, sf)).withColumn("columns", text("columns"))


@query(
    "g12_search_tables",
    f"""{DETAIL}, {_NODES} SELECT * FROM nodes n WHERE contains(lower(table_name), 'item')
    OR EXISTS (SELECT 1 FROM facts f WHERE f.project_id = n.project_id AND f.table_name = n.table_name AND contains(lower(f.column_name), 'item'))
    OR EXISTS (SELECT 1 FROM facts f WHERE f.project_id = n.project_id AND f.table_name = n.table_name AND contains(lower(f.column_name), 'item'))""",
)
def search_tables(spark, sf):
    return impact.search_tables(impact.table_nodes(detail(spark, sf)), "Item").withColumn("columns", text("columns"))


_TYPE_COUNTS = ", ".join(f"count(*) FILTER (WHERE usage_type = '{t}') AS {t}s" for t in impact.USAGE_TYPES)


@query(
    "g10_file_nodes",
    f"""{DETAIL} SELECT project_id, file_id, min(file_path) AS file_path, min(language) AS language, count(*) AS usages, {_TYPE_COUNTS},
    list_last(string_split(min(file_path), '/')) AS label FROM detail GROUP BY project_id, file_id""",
)
def file_nodes(spark, sf):
    return impact.file_nodes(detail(spark, sf))


@query(
    "g10_file_usages",
    f"""{DETAIL} SELECT project_id, file_id, 0 AS page, CAST(to_json(list({{'column_name': column_name, 'table_name': table_name, 'usage_type': usage_type, 'line_number': line_number}}
    ORDER BY line_number, table_name, column_name, usage_type, usage_id)) AS VARCHAR) AS usages FROM detail GROUP BY ALL""",
)
def file_usages(spark, sf):
    return impact.file_usages(detail(spark, sf)).withColumn("usages", text("usages"))


@query(
    "g11_table_file_edges",
    f"""{DETAIL} SELECT project_id, table_name, file_id, array_to_string(list_sort(list(DISTINCT usage_type)), ',') AS usage_types,
    (list(usage_type ORDER BY column_name, line_number, usage_id))[1] AS first_type, bool_or(usage_type IN ('write', 'update', 'delete')) AS mutating FROM detail GROUP BY ALL""",
)
def table_file_edges(spark, sf):
    return impact.table_file_edges(detail(spark, sf)).withColumn("usage_types", F.array_join("usage_types", ","))


@query(
    "g13_graph_stats",
    f"""{DETAIL} SELECT project_id, count(DISTINCT table_name) AS tables, count(DISTINCT table_name || '.' || column_name) AS columns, count(DISTINCT file_id) AS files FROM detail GROUP BY ALL""",
)
def graph_stats(spark, sf):
    return impact.graph_stats(detail(spark, sf))


_CONTEXTS = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY column_id, file_id ORDER BY line_number, usage_type, usage_id) AS rn FROM detail),
per_file AS (
  SELECT column_id, file_id, min(file_path) AS file_path, '  - ' || min(file_path) || ' (' || min(language) || ') [' || array_to_string(list_sort(list(DISTINCT usage_type)), ', ') || ']' || chr(10) || '    '
    || string_agg(left(code_snippet, 150), chr(10) || '    ' ORDER BY rn) FILTER (WHERE rn <= 2) AS entry, count(*) AS usages
  FROM ranked GROUP BY column_id, file_id
),
placed AS (SELECT *, row_number() OVER (PARTITION BY column_id ORDER BY file_path, file_id) AS place FROM per_file),
shown AS (SELECT column_id, string_agg(entry, chr(10) ORDER BY place) FILTER (WHERE place <= 5) AS examples, count(*) AS files, sum(usages) AS usages FROM placed GROUP BY column_id),
contexts AS (
  SELECT s.project_id, c.id AS column_id, s.table_name, c.column_name,
    'Table: ' || s.table_name || ', Column: ' || c.column_name || ', Type: ' || c.data_type || CASE WHEN c.is_primary_key THEN ', PRIMARY KEY' ELSE '' END
    || CASE WHEN c.is_foreign_key THEN ', FK -> ' || c.foreign_table || '.' || c.foreign_column ELSE '' END || chr(10)
    || 'Used in ' || coalesce(files, 0) || ' file(s), ' || CAST(coalesce(usages, 0) AS BIGINT) || ' total usage(s):' || chr(10) || coalesce(examples, 'No usage examples found') AS context
  FROM db_columns c JOIN db_schemas s ON c.schema_id = s.id LEFT JOIN shown ON shown.column_id = c.id
)
"""


def _contexts(spark, sf):
    return describe.column_contexts(bind(spark, sf, b.DB_COLUMNS), bind(spark, sf, b.DB_SCHEMAS), detail(spark, sf))


@query("c1_column_contexts", f"{DETAIL}, {_CONTEXTS} SELECT * FROM contexts")
def column_contexts(spark, sf):
    return _contexts(spark, sf)


_BATCHES = """
batched AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY project_id ORDER BY table_name, column_name, column_id) - 1) / 5) AS INT) AS batch FROM contexts)
"""


@query(
    "c2_batches",
    f"""{DETAIL}, {_CONTEXTS}, {_BATCHES} SELECT project_id, batch, string_agg(column_id, ',' ORDER BY table_name, column_name, column_id) AS column_ids,
    string_agg(context, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY table_name, column_name, column_id) AS prompt FROM batched GROUP BY ALL""",
)
def batches(spark, sf):
    return describe.batches(_contexts(spark, sf)).withColumn("column_ids", F.array_join("column_ids", ","))


# Descriptions arrive per order: for one column of a project each, several for some.
_DESCRIPTIONS = f"""
WITH picks AS ({b.PICKS})
SELECT 'p' || CAST(o_custkey % 20 AS STRING) AS project_id, CAST(o_orderkey % 4 AS INT) AS batch, o_orderkey AS seq, tbl AS table_name, col AS column_name,
       'Told by ' || CAST(o_orderkey AS STRING) AS description
FROM {{orders}} JOIN picks ON i = o_orderkey % {b.N}
"""
_PLACED = f"""
SELECT project_id, CAST(place % 4 AS INT) AS batch, id AS column_id, table_name, column_name, place FROM (
  SELECT s.project_id, c.id, s.table_name, c.column_name, length(c.column_name) + length(s.table_name) AS place
  FROM ({b.DB_COLUMNS}) c JOIN ({b.DB_SCHEMAS}) s ON c.schema_id = s.id)
"""


@query(
    "c3_merge_descriptions",
    f"""WITH descriptions AS ({plain(_DESCRIPTIONS)}), placed AS ({plain(_PLACED)}), db_columns AS ({plain(b.DB_COLUMNS)}),
    first AS (SELECT project_id, batch, table_name, column_name, arg_min(column_id, [CAST(place AS VARCHAR), column_id]) AS id FROM placed GROUP BY ALL),
    last AS (SELECT project_id, batch, table_name, column_name, arg_max(description, seq) AS description FROM descriptions GROUP BY ALL),
    fresh AS (SELECT id, description FROM first JOIN last USING (project_id, batch, table_name, column_name))
    SELECT c.id, c.column_name, coalesce(description, ai_description) AS ai_description FROM db_columns c LEFT JOIN fresh f ON f.id = c.id""",
)
def merge_descriptions(spark, sf):
    merged = describe.merge_descriptions(
        bind(spark, sf, b.DB_COLUMNS), bind(spark, sf, _PLACED), bind(spark, sf, _DESCRIPTIONS)
    )
    return merged.select("id", "column_name", "ai_description")
