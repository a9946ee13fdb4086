"""Relational reads over projects, catalogs, usages and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.display import duration_text, progress_percent
from weftline.operators.ranking import PAGE_ROWS, nested_pages, numbered
from weftline.session import cut
from weftline.sources.corpus import KNOWN_LANGUAGES, UNKNOWN_LANGUAGE

#: A task of a join of usages with files gets about so many usages.
TASK_ROWS = 500_000

COLUMN_KEY = ["project_id", "table_name", "column_name"]
COLUMN_FACTS = [
    "column_id", "data_type", "is_primary_key", "is_foreign_key", "foreign_table", "foreign_column", "ai_description",
]


def _in_tasks(rows: DataFrame, others: DataFrame, key: str, n_rows: int, n_others: int, task_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``key``, dealt to as many tasks as their rows ask for; as they are where the session's number will do."""
    parts = -(-n_rows // task_rows)
    if parts <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) or n_others <= task_rows:
        return rows, others
    return rows.repartition(parts, key), others.repartition(parts, key)


def usage_detail(
    usages: DataFrame, columns: DataFrame, schemas: DataFrame, files: DataFrame, project_ids: list[str] | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Usages with their column, table and file. Join sides are broadcast by Spark where their size allows.

    Usages and files are counted first, and the tasks of their join grow in number with the usages, not each with them.
    """
    tables = schemas.select(F.col("id").alias("schema_id"), "project_id", "table_name")
    if project_ids is not None:
        tables = tables.filter(F.col("project_id").isin(project_ids))
    known = columns.join(tables, "schema_id").select(
        F.col("id").alias("column_id"), "project_id", "table_name", "column_name", *COLUMN_FACTS[1:]
    )
    paths = files.select(F.col("id").alias("file_id"), "file_path", "language")
    found = usages.select(
        F.col("id").alias("usage_id"),
        "column_id",
        F.col("source_file_id").alias("file_id"),
        "line_number",
        "usage_type",
        "code_snippet",
        "context",
    )
    held, paths = _in_tasks(found.join(known, "column_id"), paths, "file_id", usages.count(), files.count(), task_rows)
    return held.join(paths, "file_id")


def usage_listing(detail: DataFrame) -> DataFrame:
    return detail.orderBy("table_name", "column_name", "file_path", "line_number", "usage_id")


def file_summary(detail: DataFrame) -> DataFrame:
    """Per column and file: distinct usage types and every line number.

    A group is one column in one file, so its lists are bounded by the file.
    """
    return detail.groupBy(*COLUMN_KEY, "file_id").agg(
        F.min("file_path").alias("file_path"),
        F.min("language").alias("language"),
        F.array_sort(F.collect_set("usage_type")).alias("usage_types"),
        F.array_sort(F.collect_list("line_number")).alias("line_numbers"),
        F.count("*").alias("usages"),
        F.min(F.struct(*COLUMN_FACTS)).alias("facts"),
    )


def column_totals(per_file: DataFrame) -> DataFrame:
    """Per column: its facts, files and usages. Same-named columns of a project are one column."""
    return (
        per_file.groupBy(*COLUMN_KEY)
        .agg(
            F.min("facts").alias("facts"),
            F.count("*").alias("file_count"),
            F.sum("usages").alias("total_usages"),
        )
        .select(*COLUMN_KEY, "facts.*", "file_count", "total_usages")
    )


def column_summary(detail: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Column totals with the files as nested lists, ``page_rows`` files to a row."""
    per_file = cut(file_summary(detail))
    item = F.struct("file_id", "file_path", "language", "usage_types", "line_numbers")
    order = [F.col("file_path"), F.col("file_id")]
    pages = nested_pages(per_file, COLUMN_KEY, order, item, "files", page_rows)
    return pages.join(column_totals(per_file), COLUMN_KEY)


def table_rollup(totals: DataFrame) -> DataFrame:
    return totals.groupBy("project_id", "table_name").agg(
        F.count("*").alias("columns"), F.sum("total_usages").alias("usages")
    )


def _counted(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))


def _with_counts(rows: DataFrame, **counts: DataFrame) -> DataFrame:
    for name, counted in counts.items():
        rows = rows.join(counted, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))
    return rows


def project_list(
    projects: DataFrame,
    files: DataFrame,
    schemas: DataFrame,
    user_id: str | None = None,
    application_id: str | None = None,
) -> DataFrame:
    """Projects with file and table counts, newest first."""
    if user_id is not None:
        projects = projects.filter(F.col("user_id") == user_id)
    if application_id is not None:
        projects = projects.filter(F.col("application_id") == application_id)
    return _with_counts(
        projects,
        file_count=_counted(files, "project_id", "file_count"),
        table_count=_counted(schemas, "project_id", "table_count"),
    ).orderBy(F.col("created_at").desc(), "id")


def application_list(applications: DataFrame, projects: DataFrame) -> DataFrame:
    counts = _counted(projects, "application_id", "project_count")
    return _with_counts(applications, project_count=counts).orderBy("name", "id")


def status_tally(projects: DataFrame) -> DataFrame:
    return projects.agg(
        F.count("*").alias("projects"), F.count_if(F.col("status") == "completed").alias("completed")
    )


def schema_tree(schemas: DataFrame, columns: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Tables with nested columns by name; the list is null where a table has none."""
    tables = schemas.select(F.col("id").alias("schema_id"), "project_id", "table_name")
    item = F.when(
        F.col("id").isNotNull(),
        F.struct(
            "id", "column_name", "data_type", "is_primary_key", "is_foreign_key", "foreign_table", "foreign_column",
            "ai_description",
        ),
    )
    keys = ["project_id", "table_name", "schema_id"]
    order = [F.col("column_name"), F.col("id")]
    pages = nested_pages(tables.join(columns, "schema_id", "left"), keys, order, item, "columns", page_rows)
    return pages.withColumn("columns", F.when(F.size("columns") > 0, F.col("columns")))


def search_schema(tree: DataFrame, text: str) -> DataFrame:
    """Tables whose name holds the text, with all columns; others with the columns that do."""
    if not text.strip():
        return tree
    wanted = F.lit(text.lower())

    def holds(value: Column) -> Column:
        return F.coalesce(F.contains(F.lower(value), wanted), F.lit(False))

    named = holds(F.col("table_name"))
    hits = F.filter(
        "columns", lambda c: holds(c["column_name"]) | holds(c["data_type"]) | holds(c["ai_description"])
    )
    return tree.withColumn("columns", F.when(named, F.col("columns")).otherwise(hits)).filter(
        named | (F.size("columns") > 0)
    )


def project_headline(files: DataFrame, schemas: DataFrame, usages: DataFrame) -> DataFrame:
    """Per project: files, tables, usages and languages. ``usages`` carry their project."""
    spoken = files.groupBy("project_id", "language").agg(F.count("*").alias("n"))
    counts = [
        spoken.groupBy("project_id").agg(F.sum("n").alias("files"), F.count("*").alias("languages")),
        schemas.groupBy("project_id").agg(F.count("*").alias("tables")),
        usages.groupBy("project_id").agg(F.count("*").alias("usages")),
    ]
    joined = counts[0].join(counts[1], "project_id", "full").join(counts[2], "project_id", "full")
    names = ["files", "tables", "usages", "languages"]
    return joined.select("project_id", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])


def files_per_language(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"))


def active_languages(files: DataFrame) -> DataFrame:
    known = [language for language in KNOWN_LANGUAGES if language != UNKNOWN_LANGUAGE]
    return files.filter(F.col("language").isin(known)).select("language").distinct()


# Languages whose files make a project a schema source.
SQL_LANGUAGES = ["sql", "db2", "plsql", "tsql"]


def sql_projects(projects: DataFrame, files: DataFrame, application_id: str | None = None) -> DataFrame:
    if application_id is not None:
        projects = projects.filter(F.col("application_id") == application_id)
    having = files.filter(F.col("language").isin(SQL_LANGUAGES)).select(F.col("project_id").alias("id"))
    return projects.join(having, "id", "left_semi").orderBy("name", "id")


def not_noise(flag: str | Column = "is_noise") -> Column:
    return ~F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False))


def component_tables(components: DataFrame, project_ids: list[str] | None = None) -> DataFrame:
    """Tables among components with their columns; a table without columns keeps one row."""
    tables = components.filter((F.col("component_type") == "TABLE") & not_noise())
    if project_ids is not None:
        tables = tables.filter(F.col("project_id").isin(project_ids))
    own = components.filter(F.col("component_type") == "COLUMN").select(
        F.col("parent_component_id").alias("table_id"),
        F.col("id").alias("column_id"),
        F.col("component_name").alias("column_name"),
        F.col("component_desc").alias("data_type"),
    )
    return tables.select(F.col("id").alias("table_id"), F.col("component_name").alias("table_name")).join(
        own, "table_id", "left"
    )


def catalog_tables(schemas: DataFrame, columns: DataFrame, project_ids: list[str] | None = None) -> DataFrame:
    if project_ids is not None:
        schemas = schemas.filter(F.col("project_id").isin(project_ids))
    own = columns.select(
        F.col("schema_id").alias("table_id"), F.col("id").alias("column_id"), "column_name", "data_type"
    )
    return schemas.select(F.col("id").alias("table_id"), "table_name").join(own, "table_id", "left")


def or_else(found: DataFrame, fallback: DataFrame) -> DataFrame:
    """All of ``found``; ``fallback`` only where ``found`` is empty as a whole."""
    any_row = F.broadcast(found.limit(1).select(F.lit(1).alias("_any")))
    rest = fallback.withColumn("_any", F.lit(1)).join(any_row, "_any", "left_anti").drop("_any")
    return found.unionByName(rest.select(*found.columns))


def tables_with_columns(rows: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Column lists by table name, same-named tables merged, tables without columns kept."""
    item = F.when(F.col("column_id").isNotNull(), F.struct("column_id", "column_name", "data_type"))
    order = [F.col("column_name"), F.col("column_id"), F.col("table_id")]
    return nested_pages(rows, ["table_name"], order, item, "columns", page_rows)


# Component types that define and do not use a table.
DEFINITIONS = ["CREATE_COLUMN_DEFINITION", "CREATE_TABLE_STATEMENT"]


def _children(components: DataFrame) -> DataFrame:
    return components.filter(~F.col("component_type").isin(DEFINITIONS) & not_noise()).select(
        "project_id", F.col("id").alias("component_id"), "component_name", "component_type", "order_seq"
    )


ROOT_HIT = ["root_id", "component_id", "component_name", "component_type", "order_seq"]


def components_of_tables(roots: DataFrame, components: DataFrame, trace: DataFrame) -> DataFrame:
    """Components traced to a table. ``roots``: ``root_id, project_id, table_name``, a row per project."""
    tables = components.filter(F.col("component_type") == "TABLE").select(
        F.col("id").alias("_table"), F.col("component_name").alias("table_name")
    )
    edges = trace.select(
        F.col("fk_parent_component_id").alias("_table"), F.col("fk_child_component_id").alias("component_id")
    )
    # Children first: a root then meets those of its own project only, not all tables of its name.
    below = tables.join(edges, "_table").join(_children(components), "component_id").drop("_table").distinct()
    wanted = roots.select("root_id", "project_id", "table_name").distinct()
    return wanted.join(below, ["table_name", "project_id"]).select(*ROOT_HIT).distinct()


def components_of_columns(roots: DataFrame, components: DataFrame, trace: DataFrame) -> DataFrame:
    """Components traced to a column. ``roots`` also hold ``column_name``."""
    tables = components.filter(F.col("component_type") == "TABLE").select(
        F.col("id").alias("_table"), F.col("component_name").alias("table_name")
    )
    own = components.filter(F.col("component_type") == "COLUMN").select(
        F.col("id").alias("_column"),
        F.col("component_name").alias("column_name"),
        F.col("parent_component_id").alias("_table"),
    )
    edges = trace.select(
        F.col("fk_parent_component_id").alias("_column"), F.col("fk_child_component_id").alias("component_id")
    )
    below = (
        own.join(tables, "_table")
        .join(edges, "_column")
        .join(_children(components), "component_id")
        .drop("_table", "_column")
        .distinct()
    )
    wanted = roots.select("root_id", "project_id", "table_name", "column_name").distinct()
    return wanted.join(below, ["table_name", "column_name", "project_id"]).select(*ROOT_HIT).distinct()


def files_of_roots(roots: DataFrame, detail: DataFrame, by_column: bool = False, per_usage: bool = False) -> DataFrame:
    """Files that use a root's table or column, as FILE components.

    One row per file; ``per_usage`` repeats a file for each usage type (and line,
    for tables).
    """
    keys = ["project_id", "table_name", *(["column_name"] if by_column else [])]
    extra = ["usage_type", *([] if by_column else ["line_number"])] if per_usage else []
    return (
        roots.select("root_id", *keys)
        .join(detail.select(*keys, "file_id", "file_path", "language", *extra), keys)
        .select(
            "root_id",
            F.col("file_id").alias("component_id"),
            F.col("file_path").alias("component_name"),
            F.lit("FILE").alias("component_type"),
            F.lit(None).cast("int").alias("order_seq"),
            "language",
            *extra,
        )
        .distinct()
    )


def with_fallback(found: DataFrame, fallback: DataFrame, key: str = "root_id") -> DataFrame:
    """All of ``found``; of ``fallback`` the keys that ``found`` does not have."""
    rest = fallback.join(found.select(key).distinct(), key, "left_anti")
    return found.unionByName(rest.select(*found.columns))


# Colours of every other column.
STRIPES = ["#b2f1ca", "#FFFFFF"]


def root_columns(roots: DataFrame, components: DataFrame, schemas: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns of each root table with alternating colours, from components or else the catalog."""
    wanted = roots.select("root_id", "project_id", "table_name")
    tables = components.filter(F.col("component_type") == "TABLE").select(
        "project_id", F.col("id").alias("_table"), F.col("component_name").alias("table_name")
    )
    own = components.filter(F.col("component_type") == "COLUMN").select(
        F.col("parent_component_id").alias("_table"), F.col("id").alias("component_id"), F.col("component_name").alias("name")
    )
    picked = ["root_id", "component_id", "name"]
    found = wanted.join(tables, ["project_id", "table_name"]).join(own, "_table").select(*picked)
    listed = (
        wanted.join(schemas.select(F.col("id").alias("schema_id"), "project_id", "table_name"), ["project_id", "table_name"])
        .join(columns.select("schema_id", F.col("id").alias("component_id"), F.col("column_name").alias("name")), "schema_id")
        .select(*picked)
    )
    rows = numbered(with_fallback(found, listed), ["root_id"], [F.col("name"), F.col("component_id")], "position")
    return rows.withColumn("color", F.when(F.col("position") % 2 == 1, STRIPES[0]).otherwise(STRIPES[1]))


def project_tables_view(projects: DataFrame, components: DataFrame) -> DataFrame:
    tables = components.filter(F.col("component_type") == "TABLE").select(
        "project_id", F.col("id").alias("table_id"), F.col("component_name").alias("table_name")
    )
    own = components.filter(F.col("component_type") == "COLUMN").select(
        F.col("parent_component_id").alias("table_id"),
        F.col("id").alias("column_id"),
        F.col("component_name").alias("column_name"),
        F.col("component_desc").alias("column_description"),
    )
    named = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    return named.join(tables, "project_id").join(own, "table_id", "left")


def component_hierarchy_view(trace: DataFrame, components: DataFrame) -> DataFrame:
    def end(side: str) -> DataFrame:
        return components.select(
            F.col("id").alias(f"{side}_id"),
            F.col("component_name").alias(f"{side}_name"),
            F.col("component_type").alias(f"{side}_type"),
        )

    edges = trace.select(
        F.col("fk_parent_component_id").alias("parent_id"),
        F.col("fk_child_component_id").alias("child_id"),
        "relationship_type",
    )
    return edges.join(end("parent"), "parent_id").join(end("child"), "child_id")


def component_sources(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """First source row of each wanted component, by start line."""
    rows = sources.join(wanted.select("component_id").distinct(), "component_id", "left_semi")
    first = F.struct(F.col("start_line").isNull(), "start_line", "end_line", "source_code")
    row = F.struct("parent_component_id", "source_code", "start_line", "end_line")
    return (
        rows.groupBy(F.col("component_id").alias("source_component_id"))
        .agg(F.min_by(row, first).alias("_row"))
        .select("source_component_id", "_row.*")
    )


def latest_results(results: DataFrame, requests: DataFrame) -> DataFrame:
    """Newest stored lineage per request. ``requests``: ``request_id, project_id, table_name, column_name``,
    a row per project; a null column asks for table lineage."""
    same = (
        (F.col("r.project_id") == F.col("q.project_id"))
        & (F.col("r.table_name") == F.col("q.table_name"))
        & F.col("r.column_name").eqNullSafe(F.col("q.column_name"))
    )
    newest = F.struct("r.updated_at", "r.lineage_data")
    return (
        results.alias("r")
        .join(requests.alias("q"), same)
        .groupBy("q.request_id")
        .agg(F.max(newest).alias("_row"))
        .select("request_id", "_row.lineage_data", "_row.updated_at")
        .filter(F.col("lineage_data").isNotNull())
    )


def first_column_usage(detail: DataFrame) -> DataFrame:
    """First usage of each column by path, line and id."""
    return _first(detail, COLUMN_KEY, ["file_path", "line_number", "usage_id"], ["file_id", "usage_type"])


def first_file_usage(detail: DataFrame) -> DataFrame:
    """First usage of each file by table, column, line and id."""
    return _first(
        detail, ["project_id", "file_id"], ["table_name", "column_name", "line_number", "usage_id"], ["usage_type"]
    )


def _first(detail: DataFrame, keys: list[str], order: list[str], more: list[str]) -> DataFrame:
    return detail.groupBy(*keys).agg(F.min(F.struct(*order, *more)).alias("_row")).select(*keys, "_row.*")


def owned_requests(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """Requests ``request_id, user_id, project_id`` all of whose projects belong to the user."""
    owned = projects.select(F.col("id").alias("project_id"), "user_id", F.lit(True).alias("_owned"))
    checked = requests.join(owned, ["project_id", "user_id"], "left")
    whole = checked.groupBy("request_id").agg(
        F.count("*").alias("_asked"),
        F.count_distinct(F.when(F.col("_owned"), F.col("project_id"))).alias("_mine"),
    )
    return requests.join(whole.filter(F.col("_asked") == F.col("_mine")), "request_id", "left_semi")


# Order of jobs on the board.
JOB_ORDER = ["running", "pending", "failed", "completed"]


def job_board(jobs: DataFrame, now: Column) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in JOB_ORDER]), F.col("status"))
    return (
        jobs.withColumn("status_rank", F.when(rank > 0, rank - 1).otherwise(len(JOB_ORDER)).cast("int"))
        .withColumn("duration", duration_text(F.col("started_at"), F.col("completed_at"), now))
        .withColumn("percent", progress_percent(F.col("progress"), F.col("total")))
        .orderBy("status_rank", "created_at", "id")
    )


def job_totals(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("project_id").agg(
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count("*").alias("total"),
    )
