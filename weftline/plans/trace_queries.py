"""Queries over the generated corpus: corpus filters, mappers, usage tracing."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.operators import incremental, lines, orm, usage
from weftline.plans import bindings as b, oracle_text as o
from weftline.plans.registry import query
from weftline.session import checkpoint_dir, cut
from weftline.sources import archives, corpus


_WRITTEN: dict[tuple[str, str], DataFrame] = {}


def corpus_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The generated corpus, written once per application like an unpacked archive would be.

    Left as expressions, the template texts would be folded into every filter
    and pattern that reads them.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _WRITTEN:
        # One order row becomes a whole file, so the rows are spread before they grow.
        spread = b.load(spark, sf, "orders").repartition(2 * spark.sparkContext.defaultParallelism, "o_orderkey")
        _WRITTEN[key] = cut(b.bind(spark, sf, b.CORPUS, orders=spread))
    return _WRITTEN[key]


def source_files(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.code_files(corpus_entries(spark, sf)).withColumn("language", corpus.language_of(F.col("file_path")))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    return usage.catalog_columns(b.bind(spark, sf, b.DB_SCHEMAS), b.bind(spark, sf, b.DB_COLUMNS))


def usages(spark: SparkSession, sf: str) -> DataFrame:
    return usage.trace_usages(source_files(spark, sf), catalog(spark, sf))


def _with(*parts: str, select: str) -> str:
    return "WITH " + ", ".join(parts) + " " + select


def _as_files(spark: SparkSession, sf: str, project: Column) -> DataFrame:
    """Every document as a code file of ``project``."""
    ending = F.element_at(F.array(F.lit(".py"), F.lit(".sql"), F.lit(".TSX")), (1 + F.col("doc_id") % 3).cast("int"))
    return b.load(spark, sf, "documents").select(
        project.alias("project_id"),
        F.concat(F.lit("src/"), F.col("doc_id").cast("string"), ending).alias("file_path"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for project, path, text in zip(batch["project_id"], batch["file_path"], batch["text"]):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr(path, text)
                archive.writestr(f"node_modules/{path}", project)
                archive.writestr("notes.md", project)
            yield pd.DataFrame({"project_id": [project], "archive": [held.getvalue()]})


@query(
    "s1_unpacked_files",
    """SELECT md5(concat_ws(chr(10), project_id, file_path)) AS id, project_id, file_path, language, md5(text) AS content, false AS parsed FROM (
      SELECT 'd' || doc_id AS project_id, 'src/' || doc_id || ['.py', '.sql', '.TSX'][1 + doc_id % 3] AS file_path,
             ['python', 'sql', 'typescript'][1 + doc_id % 3] AS language, coalesce(text, '') AS text FROM documents)""",
)
def unpacked_files(spark, sf):
    """Every document packed into an archive of its own, beside two entries that are no code, and unpacked."""
    packed = _as_files(spark, sf, F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    # written, so that a task has one Python worker at a time, which packs first and unpacks then
    blobs = cut(packed.mapInPandas(_pack, "project_id string, archive binary"))
    return corpus.unpacked_files(corpus.unpack(blobs)).withColumn("content", F.md5("content"))


def _write_archives(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, place = archives.file_at(folder)
        project, stream, archive = None, None, None
        for batch in batches:
            for name, path, text in zip(batch["project_id"], batch["file_path"], batch["text"]):
                if name != project:
                    if archive is not None:
                        archive.close()
                        stream.close()
                    system.create_dir(place, recursive=True)
                    stream = system.open_output_stream(f"{place}/{name}.zip")
                    project, archive = name, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                    archive.writestr("notes.md", name)
                archive.writestr(path, text)
            yield batch[["file_path"]]
        if archive is not None:
            archive.close()
            stream.close()

    return write


@query(
    "s1_archives_by_directory",
    """SELECT md5(concat_ws(chr(10), project_id, file_path)) AS id, project_id, file_path, language, md5(text) AS content, false AS parsed FROM (
      SELECT 'a' || (doc_id // 1000) AS project_id, 'src/' || doc_id || ['.py', '.sql', '.TSX'][1 + doc_id % 3] AS file_path,
             ['python', 'sql', 'typescript'][1 + doc_id % 3] AS language, coalesce(text, '') AS text FROM documents)""",
)
def archives_by_directory(spark, sf):
    """Every document in a written archive of a thousand neighbours, read back by its directory."""
    packed = _as_files(spark, sf, F.concat(F.lit("a"), F.expr("doc_id div 1000").cast("string")))
    folder = f"{checkpoint_dir(spark)}/weftline/{uuid.uuid4().hex}"
    dealt = packed.repartition("project_id").sortWithinPartitions("project_id")
    cut(dealt.mapInPandas(_write_archives(folder), "file_path string"))
    return corpus.read_archives(spark, folder).withColumn("content", F.md5("content"))


@query(
    "s2_code_files",
    _with(f"corpus AS ({b.plain(b.CORPUS)})", select=f"SELECT id, project_id, file_path, md5(content) AS content FROM corpus WHERE {o.IS_CODE}"),
)
def code_files(spark, sf):
    return corpus.code_files(corpus_entries(spark, sf)).withColumn("content", F.md5("content"))


@query(
    "s3_s4_s5_file_flags",
    _with(
        f"corpus AS ({b.plain(b.CORPUS)})",
        select=f"SELECT id, file_path, {o.LANGUAGE} AS language, {o.IS_SCHEMA} AS is_schema, {o.IS_ORM_SCHEMA} AS is_orm_schema FROM corpus",
    ),
)
def file_flags(spark, sf):
    return corpus.with_file_flags(corpus_entries(spark, sf)).drop("content", "project_id")


@query("t1_lines", _with(o.FILES, o.LINES, select="SELECT project_id, file_id, line_number, line FROM lines"))
def exploded_lines(spark, sf):
    return lines.explode_lines(source_files(spark, sf))


@query("t2_code_lines", _with(o.FILES, o.LINES, select="SELECT project_id, file_id, line_number, line FROM code_lines"))
def code_only_lines(spark, sf):
    return lines.code_lines(lines.explode_lines(source_files(spark, sf)))


@query(
    "t3_t4_line_contexts",
    _with(
        o.FILES,
        o.LINES,
        select="SELECT project_id, file_id, line_number, left(context, 1000) AS context, left(snippet, 500) AS code_snippet FROM windowed",
    ),
)
def contexts(spark, sf):
    return lines.line_contexts(source_files(spark, sf))


_DOCUMENT_LINES = """
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number
  FROM documents WHERE text <> ''
),
windowed AS (
  SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS context
  FROM lines
)
"""


@query(
    "t3_document_contexts",
    f"WITH {_DOCUMENT_LINES} SELECT 'd' || doc_id AS file_id, line_number, left(context, 1000) AS context FROM windowed",
)
def document_contexts(spark, sf):
    docs = b.load(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.col("source").alias("project_id"),
        F.col("text").alias("content"),
    )
    return lines.line_contexts(docs).select("file_id", "line_number", "context")


@query("t5_column_variants", _with(o.CATALOG, select="SELECT project_id, column_id, variant FROM variants"))
def column_variants(spark, sf):
    return usage.column_variants(catalog(spark, sf))


@query("t6_table_variants", _with(o.CATALOG, select="SELECT project_id, table_name, variant FROM table_words"))
def table_variants(spark, sf):
    return usage.table_variants(catalog(spark, sf))


@query(
    "t7_direct_matches",
    _with(o.FILES, o.LINES, o.CATALOG, o.TOKENS, select="SELECT project_id, file_id, line_number, column_id FROM direct"),
)
def direct_matches(spark, sf):
    return usage.direct_matches(source_files(spark, sf), catalog(spark, sf))


@query(
    "t8_accepted_matches",
    _with(o.FILES, o.LINES, o.CATALOG, o.TOKENS, o.ACCEPTED, select="SELECT project_id, file_id, line_number, column_id FROM accepted"),
)
def accepted_matches(spark, sf):
    return usage.accepted_matches(source_files(spark, sf), catalog(spark, sf))


@query(
    "t9_t10_t11_line_usages",
    _with(
        o.FILES,
        o.LINES,
        o.TYPED,
        select="SELECT project_id, file_id, line_number, by_mapper, by_line, by_context, coalesce(by_mapper, by_line, by_context) AS usage_type FROM typed_lines",
    ),
)
def line_usages(spark, sf):
    return usage.line_usages(source_files(spark, sf))


_USAGE_COLUMNS = "id, project_id, column_id, source_file_id, line_number, usage_type, strategy, code_snippet, context"


@query("t12_t14_column_usages", _with(o.TRACE, select=f"SELECT {_USAGE_COLUMNS} FROM usages"))
def column_usages(spark, sf):
    return usages(spark, sf)


@query("t7_t14_usages_large_dictionary", _with(o.TRACE, select=f"SELECT {_USAGE_COLUMNS} FROM usages"))
def column_usages_large_dictionary(spark, sf):
    """The same trace the way it runs when the dictionary is too large to broadcast."""
    return usage.trace_usages(source_files(spark, sf), catalog(spark, sf), broadcast_bytes=0)


def _updated_store(spark, sf) -> incremental.TraceStore:
    """A store of an older state of files and catalog, brought up to date.

    Then, some files were shorter, some were not there, one is gone since; some columns were not there and some had another name.
    """
    files, columns = source_files(spark, sf), catalog(spark, sf)
    digit = F.substring(F.md5("id"), 1, 1)
    older = files.filter(digit != "0").withColumn("content", F.when(digit == "1", F.concat(F.lit("x = 1\n"), "content")).otherwise(F.col("content")))
    gone = files.limit(1).withColumn("id", F.lit("gone"))
    first = F.substring(F.md5("column_id"), 1, 1)
    lacking = columns.filter(first != "0").withColumn(
        "column_name", F.when(first == "1", F.concat("column_name", F.lit("_old"))).otherwise(F.col("column_name"))
    )
    store = incremental.TraceStore(spark, f"{checkpoint_dir(spark)}/weftline/{uuid.uuid4().hex}")
    store.update(older.unionByName(gone), lacking)
    store.update(files, columns)
    return store


@query("t1_t15_incremental_usages", _with(o.TRACE, select=f"SELECT {_USAGE_COLUMNS} FROM usages"))
def incremental_usages(spark, sf):
    """The usages of a store after a change of files and catalog: those of a whole trace."""
    return _updated_store(spark, sf).usages()


@query(
    "t13_mapped_matches",
    _with(
        o.FILES, o.FIELD_MAP, o.LINES, o.CATALOG, o.TOKENS, o.MAPPED, o.TYPED,
        select="""SELECT m.project_id, m.file_id, m.line_number, m.column_id, coalesce(by_mapper, by_line, by_context) AS usage_type
        FROM mapped m JOIN typed_lines t ON t.file_id = m.file_id AND t.line_number = m.line_number""",
    ),
)
def mapped_matches(spark, sf):
    return usage.mapped_matches(source_files(spark, sf), catalog(spark, sf))


@query(
    "t15_trace_accounting",
    _with(
        o.TRACE,
        select="""
        , stages AS (SELECT project_id, 'file_scan' AS job_type, count(*) AS n FROM source_files GROUP BY ALL
          UNION ALL SELECT project_id, 'schema_parse', count(*) FROM db_schemas GROUP BY ALL
          UNION ALL SELECT project_id, 'lineage_trace', count(*) FROM usages GROUP BY ALL)
        SELECT p.project_id, j.job_type, 'completed' AS status, coalesce(n, 0) AS progress, coalesce(n, 0) AS total, CAST(NULL AS VARCHAR) AS error
        FROM (SELECT DISTINCT project_id FROM stages) p CROSS JOIN (VALUES ('file_scan'), ('schema_parse'), ('lineage_trace')) j(job_type)
        LEFT JOIN stages s ON s.project_id = p.project_id AND s.job_type = j.job_type""",
    ),
)
def trace_accounting(spark, sf):
    return usage.trace_accounting(source_files(spark, sf), b.bind(spark, sf, b.DB_SCHEMAS), usages(spark, sf))


# Large errors fail a stage of a project; some of these projects have nothing else.
_FAILURES = """
SELECT 'p' || CAST(user_id % 25 AS STRING) AS project_id,
       CASE event_id % 4 WHEN 0 THEN 'file_scan' WHEN 1 THEN 'schema_parse' WHEN 2 THEN 'lineage_trace' ELSE 'ai_describe' END AS job_type,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'broke at ' || CAST(event_id AS STRING) END AS error
FROM {events} WHERE event_type = 'error' AND user_id % 3 = 0
"""
_DESCRIBED = "CASE WHEN length(column_name) % 3 > 0 THEN 'Says ' || column_name END"


@query(
    "t15_failed_and_described",
    _with(
        o.TRACE,
        f"failures AS ({b.plain(_FAILURES)})",
        select=f"""
        , stages AS (SELECT project_id, 'file_scan' AS job_type, count(*) AS total, count(*) AS progress FROM source_files GROUP BY ALL
          UNION ALL SELECT project_id, 'schema_parse', count(*), count(*) FROM db_schemas GROUP BY ALL
          UNION ALL SELECT project_id, 'lineage_trace', count(*), count(*) FROM usages GROUP BY ALL
          UNION ALL SELECT project_id, 'ai_describe', count(*), count({_DESCRIBED}) FROM db_columns c JOIN db_schemas s ON s.id = c.schema_id GROUP BY ALL),
        failed AS (SELECT project_id, job_type, min(coalesce(error, '')) AS error FROM failures GROUP BY ALL)
        SELECT p.project_id, j.job_type, CASE WHEN f.job_type IS NULL THEN 'completed' ELSE 'failed' END AS status, coalesce(progress, 0) AS progress, coalesce(total, 0) AS total, f.error
        FROM (SELECT project_id FROM stages UNION SELECT project_id FROM failures) p CROSS JOIN (VALUES ('file_scan'), ('schema_parse'), ('lineage_trace'), ('ai_describe')) j(job_type)
        LEFT JOIN stages s ON s.project_id = p.project_id AND s.job_type = j.job_type LEFT JOIN failed f ON f.project_id = p.project_id AND f.job_type = j.job_type""",
    ),
)
def failed_and_described(spark, sf):
    schemas = b.bind(spark, sf, b.DB_SCHEMAS)
    owners = schemas.select(F.col("id").alias("schema_id"), "project_id")
    columns = b.bind(spark, sf, b.DB_COLUMNS).join(owners, "schema_id")
    described = columns.select("project_id", F.expr(_DESCRIBED).alias("ai_description"))
    return usage.trace_accounting(source_files(spark, sf), schemas, usages(spark, sf), b.bind(spark, sf, _FAILURES), described)


@query(
    "t15_parsed_files",
    _with(o.FILES, select="SELECT id, project_id, content <> '' AS parsed FROM source_files"),
)
def parsed_files(spark, sf):
    files = source_files(spark, sf).withColumn("parsed", F.lit(False))
    return usage.mark_parsed(files).select("id", "project_id", "parsed")


_SEQ = "CASE orm " + " ".join(f"WHEN '{m.name}' THEN {i}" for i, m in enumerate(o.MAPPERS, 1)) + " END"


@query(
    "p7_file_mappers",
    _with(o.FILES, select=f"SELECT project_id, file_id, orm, {_SEQ} AS orm_seq FROM (SELECT project_id, file_id, unnest(orms) AS orm FROM tagged)"),
)
def file_mappers(spark, sf):
    return orm.file_mappers(source_files(spark, sf))


@query(
    "p8_model_tables",
    _with(
        o.FILES,
        select=f"SELECT DISTINCT project_id, file_id, model, lower(model) AS table_name FROM ({o.MODEL_CAPTURES}) WHERE model <> ''",
    ),
)
def model_tables(spark, sf):
    return orm.model_tables(source_files(spark, sf))


@query("p9_field_columns", _with(o.FILES, o.FIELD_MAP, select="SELECT project_id, file_id, field, column_name FROM field_map"))
def field_columns(spark, sf):
    return orm.field_columns(source_files(spark, sf))
