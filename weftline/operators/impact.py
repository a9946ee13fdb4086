"""The table–file impact graph over usage detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.operators.ranking import PAGE_ROWS, nested_pages

# Usage types, and the ones that change data.
USAGE_TYPES = ["read", "write", "update", "delete", "join", "filter", "projection"]
MUTATING = ["write", "update", "delete"]


def table_columns(detail: DataFrame) -> DataFrame:
    """Columns of each table node with the number of files that use them."""
    per_file = detail.groupBy("project_id", "table_name", "column_name", "file_id").agg(
        F.min(F.struct("column_id", "data_type", "is_primary_key", "is_foreign_key")).alias("facts")
    )
    return (
        per_file.groupBy("project_id", "table_name", "column_name")
        .agg(F.min("facts").alias("facts"), F.count("*").alias("file_count"))
        .select("project_id", "table_name", "column_name", "facts.*", "file_count")
    )


def table_nodes(detail: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    item = F.struct("column_name", "data_type", "is_primary_key", "is_foreign_key", "file_count")
    order = [F.col("column_name")]
    return nested_pages(table_columns(detail), ["project_id", "table_name"], order, item, "columns", page_rows)


def search_tables(nodes: DataFrame, text: str) -> DataFrame:
    """Table nodes whose name or any column holds the text; a table keeps all its pages."""
    if not text:
        return nodes
    wanted = text.lower()
    hit = F.contains(F.lower("table_name"), F.lit(wanted)) | F.exists(
        "columns", lambda c: F.contains(F.lower(c["column_name"]), F.lit(wanted))
    )
    keys = nodes.filter(hit).select("project_id", "table_name").distinct()
    return nodes.join(keys, ["project_id", "table_name"], "left_semi")


def file_nodes(detail: DataFrame) -> DataFrame:
    """Files with the number of usages per type, the base name as label."""
    counts = [F.count_if(F.col("usage_type") == t).alias(f"{t}s") for t in USAGE_TYPES]
    label = F.element_at(F.split("file_path", "/", -1), -1)
    return (
        detail.groupBy("project_id", "file_id")
        .agg(F.min("file_path").alias("file_path"), F.min("language").alias("language"), F.count("*").alias("usages"), *counts)
        .withColumn("label", F.when(label != "", label).otherwise(F.col("file_path")))
    )


def file_usages(detail: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """The usages of each file as nested lists."""
    item = F.struct("column_name", "table_name", "usage_type", "line_number")
    keys, order = ["project_id", "file_id"], ["line_number", "table_name", "column_name", "usage_type", "usage_id"]
    # snippets and contexts are not shown, so they are not written either
    return nested_pages(detail.select(*keys, *order), keys, [F.col(c) for c in order], item, "usages", page_rows)


def table_file_edges(detail: DataFrame) -> DataFrame:
    """Edges with their usage types, the first one in listing order, and whether data changes."""
    first = F.struct("column_name", "line_number", "usage_id")
    return detail.groupBy("project_id", "table_name", "file_id").agg(
        F.array_sort(F.collect_set("usage_type")).alias("usage_types"),
        F.min_by("usage_type", first).alias("first_type"),
        F.bool_or(F.col("usage_type").isin(MUTATING)).alias("mutating"),
    )


def graph_stats(detail: DataFrame) -> DataFrame:
    """Distinct tables, columns and files per project, each counted over its own partial distinct."""
    per_column = detail.select("project_id", "table_name", "column_name").distinct()
    columns = per_column.groupBy("project_id", "table_name").agg(F.count("*").alias("n"))
    tables = columns.groupBy("project_id").agg(F.count("*").alias("tables"), F.sum("n").alias("columns"))
    files = detail.select("project_id", "file_id").distinct().groupBy("project_id").agg(F.count("*").alias("files"))
    return tables.join(files, "project_id")
