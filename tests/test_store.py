import os
from datetime import datetime

from pyspark.sql import functions as F

from weftline.operators import describe, maintenance, reports, usage
from weftline.sources import inventory


def test_samples(spark, tmp_path):
    spark.createDataFrame([(i, bytearray(b"abc"), None, datetime(2024, 1, 2, 3, 4, 5)) for i in range(20)], "a int, b binary, c string, d timestamp").write.parquet(str(tmp_path / "t"))
    rows = inventory.sample_tables(
        spark, {"t": lambda: spark.read.parquet(str(tmp_path / "t")), "gone": lambda: spark.read.parquet(str(tmp_path / "gone"))}, rows=3, order_by={"t": ["a"]}
    ).collect()
    assert [r.row for r in rows if r.table_name == "t"] == [f'{{"a":"{i}","b":"<Buffer 3 bytes>","c":"","d":"2024-01-02T03:04:05.000Z"}}' for i in range(3)]
    assert [r.error for r in rows if r.table_name == "gone"] == ["Error: PATH_NOT_FOUND"]


def test_a_damaged_table_is_an_error_row_of_its_own(spark, tmp_path):
    for name in ("good", "bad"):
        spark.range(5).coalesce(1).write.parquet(str(tmp_path / name))
    schema = spark.read.parquet(str(tmp_path / "bad")).schema
    file = next((tmp_path / "bad").glob("*.parquet"))
    file.write_bytes(file.read_bytes()[:-20])
    tables = {"bad": lambda: spark.read.schema(schema).parquet(str(tmp_path / "bad")), "good": lambda: spark.read.parquet(str(tmp_path / "good"))}
    rows = inventory.sample_tables(spark, tables, rows=2, order_by={"good": ["id"]}).collect()
    assert [(r.row_no, r.row) for r in rows if r.table_name == "good"] == [(1, '{"id":"0"}'), (2, '{"id":"1"}')]
    (bad,) = [r for r in rows if r.table_name == "bad"]
    assert bad.row is None and bad.error.startswith("Error: ")


def test_inventory_sizes(spark, tmp_path):
    path = tmp_path / "t"
    spark.range(10_000).repartition(3).write.parquet(str(path))
    size = sum(os.path.getsize(path / f) for f in os.listdir(path) if f.endswith(".parquet"))
    row = inventory.table_inventory({("s", "t"): spark.read.parquet(str(path))}).first()
    assert (row.schema_name, row.table_name, row.row_count, row.total_space_kb) == ("s", "t", 10_000, -(-size // 1024))


def test_metadata_of_a_session_database(spark, tmp_path):
    spark.sql(f"create database if not exists weft_meta location '{tmp_path / 'db'}'")
    spark.sql("create table if not exists weft_meta.items (id int, price decimal(10,2) comment 'cost', code varchar(20)) using parquet")
    try:
        metadata = inventory.column_metadata(**inventory.session_metadata(spark, "weft_meta"))
        lines = [r.line for r in inventory.ddl_lines(metadata).collect()]
        assert lines == [
            "-- Table: weft_meta.items\nCREATE TABLE [weft_meta].[items] (",
            "  [id] INT,",
            "  [price] DECIMAL(10, 2),",
            "  [code] VARCHAR(20)",
            ");\n",
        ]
        assert [r.column_description for r in metadata.collect()] == [None, "cost", None]
    finally:
        spark.sql("drop database weft_meta cascade")


RESULT = "project_id string, data_lineage_type string, table_name string, column_name string, lineage_data string, updated_at string"


def test_upsert_matches_null_columns(spark):
    old = spark.createDataFrame([("p", "TABLE", "t", None, "old", "1"), ("p", "COLUMN", "t", "c", "keep", "9")], RESULT)
    new = spark.createDataFrame([("p", "TABLE", "t", None, "new", "0"), ("q", "TABLE", "t", None, "a", "1"), ("q", "TABLE", "t", None, "b", "2")], RESULT)
    rows = maintenance.upsert_results(old, new).collect()
    assert sorted((r.project_id, r.lineage_data) for r in rows) == [("p", "keep"), ("p", "new"), ("q", "b")]


def test_results_of_several_projects_go_to_the_smallest_id(spark):
    roots = spark.createDataFrame([("r", "p2", "t", None), ("r", "p10", "t", None)], "root_id string, project_id string, table_name string, column_name string")
    documents = spark.createDataFrame([("r", "{}")], "root_id string, json string")
    row = maintenance.lineage_results(documents, roots, F.lit("now")).first()
    assert (row.project_id, row.data_lineage_type) == ("p10", "TABLE")


def test_purge_leaves_no_orphans(spark):
    tables = {
        "projects": spark.createDataFrame([("p",), ("q",)], "id string"),
        "db_schemas": spark.createDataFrame([("s1", "p"), ("s2", "q")], "id string, project_id string"),
        "db_columns": spark.createDataFrame([("c1", "s1"), ("c2", "s2")], "id string, schema_id string"),
        "column_usages": spark.createDataFrame([("u1", "c1"), ("u2", "c2")], "id string, column_id string"),
        "source_files": spark.createDataFrame([("f1", "p"), ("f2", "q")], "id string, project_id string"),
        "processing_jobs": spark.createDataFrame([("j1", "p"), ("j2", "q")], "id string, project_id string"),
    }
    left = maintenance.purge_projects(tables, spark.createDataFrame([("p",), ("p",)], "project_id string"))
    assert {n: [r.id for r in df.collect()] for n, df in left.items()} == {
        "projects": ["q"], "db_schemas": ["s2"], "db_columns": ["c2"], "column_usages": ["u2"], "source_files": ["f2"], "processing_jobs": ["j2"],
    }


def test_fallback_only_where_all_is_empty(spark):
    a = spark.createDataFrame([("r1", 1)], "root_id string, v int")
    b = spark.createDataFrame([("r1", 2), ("r2", 3)], "root_id string, v int")
    assert sorted(r.v for r in reports.or_else(a, b).collect()) == [1]
    assert sorted(r.v for r in reports.or_else(a.limit(0), b).collect()) == [2, 3]
    assert sorted(r.v for r in reports.with_fallback(a, b).collect()) == [1, 3]


def test_a_request_with_a_repeated_project_is_refused(spark):
    projects = spark.createDataFrame([("p", "u"), ("q", "u")], "id string, user_id string")
    asked = spark.createDataFrame([("1", "u", "p"), ("1", "u", "q"), ("2", "u", "p"), ("2", "u", "p"), ("3", "u", "x")], "request_id string, user_id string, project_id string")
    assert {r.request_id for r in reports.owned_requests(asked, projects).collect()} == {"1"}


def test_empty_search_keeps_all(spark):
    tree = spark.createDataFrame([("t", None)], "table_name string, columns array<struct<column_name:string,data_type:string,ai_description:string>>")
    assert reports.search_schema(tree, "  ").count() == 1
    assert reports.search_schema(tree, "T").count() == 1
    assert reports.search_schema(tree, "x").count() == 0


def test_accounting_counts_empty_stages(spark):
    files = spark.createDataFrame([("f", "p"), ("g", "p"), ("h", "q")], "id string, project_id string")
    none = files.limit(0)
    rows = {(r.project_id, r.job_type): r.progress for r in usage.trace_accounting(files, none, none).collect()}
    assert rows == {(p, j): n if j == "file_scan" else 0 for p, n in (("p", 2), ("q", 1)) for j in ("file_scan", "schema_parse", "lineage_trace")}


def test_accounting_of_failed_stages_and_descriptions(spark):
    files = spark.createDataFrame([("f", "p")], "id string, project_id string")
    failures = spark.createDataFrame(
        [("p", "lineage_trace", "late"), ("p", "lineage_trace", "early"), ("x", "file_scan", None)], "project_id string, job_type string, error string"
    )
    described = spark.createDataFrame([("p", "says"), ("p", None), ("p", "more")], "project_id string, ai_description string")
    rows = usage.trace_accounting(files, files.limit(0), files.limit(0), failures, described).collect()
    assert len(rows) == 8
    told = {(r.project_id, r.job_type): (r.status, r.progress, r.total, r.error) for r in rows}
    assert told["p", "file_scan"] == ("completed", 1, 1, None)
    assert told["p", "lineage_trace"] == ("failed", 0, 0, "early")
    assert told["p", "ai_describe"] == ("completed", 2, 3, None)
    assert told["x", "file_scan"] == ("failed", 0, 0, "")


def test_context_of_an_unused_column(spark):
    columns = spark.createDataFrame([("c", "s", "id", "INT", True, True, None, None)], "id string, schema_id string, column_name string, data_type string, is_primary_key boolean, is_foreign_key boolean, foreign_table string, foreign_column string")
    schemas = spark.createDataFrame([("s", "p", "users")], "id string, project_id string, table_name string")
    detail = spark.createDataFrame([], "column_id string, file_id string, file_path string, language string, line_number int, usage_type string, usage_id string, code_snippet string")
    assert describe.column_contexts(columns, schemas, detail).first().context == (
        "Table: users, Column: id, Type: INT, PRIMARY KEY, FK -> null.null\nUsed in 0 file(s), 0 total usage(s):\nNo usage examples found"
    )
