"""Texts that document columns from their usages, and merging answers back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from weftline.operators.ranking import numbered

# How much of the usages a text shows, and how many texts make a batch.
SHOWN_FILES = 5
SHOWN_SNIPPETS = 2
SNIPPET_CHARS = 150
BATCH_COLUMNS = 5
SEPARATOR = "\n\n---\n\n"
NO_EXAMPLES = "No usage examples found"


def column_contexts(columns: DataFrame, schemas: DataFrame, detail: DataFrame) -> DataFrame:
    """``project_id, column_id, table_name, column_name, context`` for every catalog column."""
    order = F.struct("line_number", "usage_type", "usage_id")
    ranked = detail.withColumn(
        "_rn", F.row_number().over(Window.partitionBy("column_id", "file_id").orderBy(order))
    )
    shown = ranked.filter(F.col("_rn") <= SHOWN_SNIPPETS)
    snippets = shown.groupBy("column_id", "file_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "code_snippet"))), lambda x: F.coalesce(F.substring(x["code_snippet"], 1, SNIPPET_CHARS), F.lit(""))).alias("snippets")
    )
    per_file = detail.groupBy("column_id", "file_id").agg(
        F.min("file_path").alias("file_path"),
        F.min("language").alias("language"),
        F.array_sort(F.collect_set("usage_type")).alias("types"),
        F.count("*").alias("usages"),
    )
    totals = per_file.groupBy("column_id").agg(F.count("*").alias("files"), F.sum("usages").alias("usages"))
    # The rank limit is applied before the shuffle, so a column used everywhere sends a few rows per task.
    top = per_file.withColumn(
        "_place", F.row_number().over(Window.partitionBy("column_id").orderBy("file_path", "file_id"))
    ).filter(F.col("_place") <= SHOWN_FILES)
    entry = F.concat(
        F.lit("  - "), "file_path", F.lit(" ("), "language", F.lit(") ["), F.array_join("types", ", "), F.lit("]\n    "),
        F.array_join("snippets", "\n    "),
    )
    examples = (
        top.join(snippets, ["column_id", "file_id"])
        .groupBy("column_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_place"), entry.alias("text")))), lambda x: x["text"]), "\n").alias("examples"))
    )
    known = columns.join(schemas.select(F.col("id").alias("schema_id"), "project_id", "table_name"), "schema_id").withColumnRenamed("id", "column_id")
    joined = known.join(totals, "column_id", "left").join(examples, "column_id", "left")
    head = F.concat(
        F.lit("Table: "), "table_name", F.lit(", Column: "), "column_name", F.lit(", Type: "), "data_type",
        F.when(F.col("is_primary_key"), F.lit(", PRIMARY KEY")).otherwise(F.lit("")),
        F.when(
            F.col("is_foreign_key"),
            F.concat(F.lit(", FK -> "), F.coalesce("foreign_table", F.lit("null")), F.lit("."), F.coalesce("foreign_column", F.lit("null"))),
        ).otherwise(F.lit("")),
    )
    files, usages = (F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("files", "usages"))
    body = F.concat(
        F.lit("\nUsed in "), files, F.lit(" file(s), "), usages, F.lit(" total usage(s):\n"),
        F.coalesce("examples", F.lit(NO_EXAMPLES)),
    )
    return joined.select("project_id", "column_id", "table_name", "column_name", F.concat(head, body).alias("context"))


def batches(contexts: DataFrame) -> DataFrame:
    """Contexts in batches of five per project: ``project_id, batch, column_ids, prompt``."""
    order = [F.col("table_name"), F.col("column_name"), F.col("column_id")]
    rows = numbered(contexts, ["project_id"], order, "_rn")
    placed = rows.withColumn("batch", F.floor((F.col("_rn") - 1) / F.lit(BATCH_COLUMNS)).cast("int"))
    held = F.array_sort(F.collect_list(F.struct("_rn", "column_id", "context")))
    return placed.groupBy("project_id", "batch").agg(
        F.transform(held, lambda x: x["column_id"]).alias("column_ids"),
        F.array_join(F.transform(held, lambda x: x["context"]), SEPARATOR).alias("prompt"),
    )


def merge_descriptions(columns: DataFrame, placed: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Columns with new descriptions.

    ``placed``: ``project_id, batch, column_id, table_name, column_name`` and the
    column's ``place`` in its batch. ``descriptions``: ``project_id, batch, seq,
    table_name, column_name, description``. In a batch the first column of that
    name takes the description; of several for one column the last one stays.
    """
    keys = ["project_id", "batch", "table_name", "column_name"]
    first = placed.groupBy(*keys).agg(F.min_by("column_id", F.struct("place", "column_id")).alias("id"))
    last = descriptions.groupBy(*keys).agg(F.max(F.struct("seq", "description")).alias("_new"))
    fresh = first.join(last, keys).select("id", F.col("_new.description").alias("_description"))
    return columns.join(fresh, "id", "left").withColumn(
        "ai_description", F.coalesce("_description", "ai_description")
    ).drop("_description")
