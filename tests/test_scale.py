"""Steps whose memory, texts or shuffles would grow without need."""

from weftline.operators import catalog, maintenance, reports
from weftline.plans import trace_queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_not_searched_once_more_for_a_size(spark):
    text = "CREATE TABLE t (\n  a INT PRIMARY KEY,\n  b TEXT\n);"
    files = spark.createDataFrame([("f", "p", "x.sql", "sql", text), ("g", "p", "y.sql", "sql", "x")], "id string, project_id string, file_path string, language string, content string")
    found = catalog.ddl_columns(files)
    assert [r.column_name for r in found.orderBy("col_seq").collect()] == ["a", "b"]
    assert not [line for line in plan(found).splitlines() if "Filter" in line and "size(" in line]


def test_purged_columns_are_read_once(spark):
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    kept = maintenance.purge_projects(
        {
            "column_usages": table([("u1", "c1"), ("u2", "c2"), ("u3", None), ("u2", "c2")], "id string, column_id string"),
            "db_columns": table([("c1", "s1"), ("c2", "s2"), ("c3", None), ("c2", "s2")], "id string, schema_id string"),
            "db_schemas": table([("s1", "a"), ("s1", "a"), ("s2", "b"), ("s3", None)], "id string, project_id string"),
            "source_files": table([("f1", "a"), ("f2", "b")], "id string, project_id string"),
            "processing_jobs": table([("j1", "a"), ("j2", None)], "id string, project_id string"),
            "projects": table([("a",), ("b",)], "id string"),
        },
        table([("a",), ("a",), (None,)], "project_id string"),
    )
    assert {n: sorted(r.id for r in t.collect()) for n, t in kept.items()} == {
        "column_usages": ["u2", "u2", "u3"],
        "db_columns": ["c2", "c2", "c3"],
        "db_schemas": ["s2", "s3"],
        "source_files": ["f2"],
        "processing_jobs": ["j2"],
        "projects": ["b"],
    }
    assert kept["db_columns"].inputFiles() and kept["db_schemas"].inputFiles()


def test_archives_are_packed_and_unpacked_by_turns(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    files = trace_queries.unpacked_files(spark, str(tmp_path))
    assert plan(files).count("MapInPandas") == 1 and files.count() == 20


def test_tasks_of_usages_grow_in_number(spark):
    usages = spark.range(2000).selectExpr("concat('u', id) AS id", "'c' AS column_id", "concat('f', id % 500) AS source_file_id", "1 AS line_number", "'read' AS usage_type", "'' AS code_snippet", "'' AS context")
    columns = spark.createDataFrame([("c", "s", "name", "INT", False, False, None, None, None)], "id string, schema_id string, column_name string, data_type string, is_primary_key boolean, is_foreign_key boolean, foreign_table string, foreign_column string, ai_description string")
    schemas = spark.createDataFrame([("s", "p", "t")], "id string, project_id string, table_name string")
    files = spark.range(500).selectExpr("concat('f', id) AS id", "concat('src/', id) AS file_path", "'go' AS language")
    dealt = reports.usage_detail(usages, columns, schemas, files, task_rows=100)
    assert dealt.rdd.getNumPartitions() == 20 and dealt.distinct().count() == 2000
