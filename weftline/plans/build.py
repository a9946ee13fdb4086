"""From source files to stored catalog and usages, each stage written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.operators import catalog, usage

STAGES = ["source_files", "extracted_columns", "db_schemas", "db_columns", "column_usages", "processing_jobs"]


def build(
    spark: SparkSession, files: DataFrame, out: str, dedupe: bool = False, failures: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Write all stages below ``out`` and return them as stored.

    ``failures``: what ``corpus.failed_uploads`` found; it makes the scan of these
    projects a failed job. Files are stored with the flag that they have once the
    build is done; jobs are written last, so a build that ended early has none.

    Usages are laid out by project, so that one project can be read, rebuilt or
    purged on its own. The rebalance gathers a small project in few files and
    splits a project that holds most rows. The corpus is written as it comes and
    read twice, once for the catalog and once for the usages.
    """

    def stored(name: str, rows: DataFrame, by_project: bool = False) -> DataFrame:
        if by_project:
            rows.hint("rebalance", "project_id").write.mode("overwrite").partitionBy("project_id").parquet(f"{out}/{name}")
        else:
            rows.write.mode("overwrite").parquet(f"{out}/{name}")
        # Read back under the written schema: a project id that looks like a number stays text.
        return spark.read.schema(rows.schema).parquet(f"{out}/{name}").select(*rows.columns)

    sources = stored("source_files", usage.mark_parsed(files))
    found = stored("extracted_columns", catalog.build_catalog(sources, dedupe))
    schemas = stored("db_schemas", catalog.db_schemas(found))
    columns = stored("db_columns", catalog.db_columns(found))
    traced = usage.trace_usages(sources, usage.catalog_columns(schemas, columns))
    usages = stored("column_usages", traced, by_project=True)
    if failures is not None:
        failures = failures.select("project_id", F.lit("file_scan").alias("job_type"), "error")
    jobs = stored("processing_jobs", usage.trace_accounting(sources, schemas, usages, failures))
    return dict(zip(STAGES, [sources, found, schemas, columns, usages, jobs]))
