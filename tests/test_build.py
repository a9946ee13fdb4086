import zipfile

from weftline.operators import impact, reports
from weftline.plans.build import build
from weftline.sources.corpus import archive_entries, failed_uploads, read_archives, unpacked_files


def test_from_archive_to_report(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "007.zip", "w") as z:
        z.writestr("db/schema.sql", "CREATE TABLE users (\n  user_id INT PRIMARY KEY,\n  mail TEXT\n);\n")
        z.writestr("src/app.py", "rows = run('SELECT mail FROM users WHERE user_id = 1')\n# mail\n")
        z.writestr("src/empty.py", "")
    out = build(spark, read_archives(spark, f"{tmp_path}/007.zip"), str(tmp_path / "out"))
    detail = reports.usage_detail(out["column_usages"], out["db_columns"], out["db_schemas"], out["source_files"]).cache()
    got = {(r.project_id, r.table_name, r.column_name, r.file_path, r.line_number, r.usage_type) for r in detail.collect()}
    assert got == {
        ("007", "users", "user_id", "db/schema.sql", 2, "write"),
        ("007", "users", "mail", "db/schema.sql", 3, "write"),
        ("007", "users", "user_id", "src/app.py", 1, "filter"),
        ("007", "users", "mail", "src/app.py", 1, "filter"),
    }
    assert {r.job_type: r.total for r in out["processing_jobs"].collect()} == {"file_scan": 3, "schema_parse": 1, "lineage_trace": 4}
    assert {r.file_path: r.parsed for r in out["source_files"].collect()} == {"db/schema.sql": True, "src/app.py": True, "src/empty.py": False}
    stored = spark.read.parquet(str(tmp_path / "out" / "source_files"))
    assert {r.file_path for r in stored.where("parsed").collect()} == {"db/schema.sql", "src/app.py"}
    assert [(r.tables, r.columns, r.files) for r in impact.graph_stats(detail).collect()] == [(1, 2, 2)]
    summary = reports.column_summary(detail, page_rows=1)
    assert [(r.column_name, r.page, len(r.files), r.total_usages) for r in summary.orderBy("column_name", "page").collect()] == [
        ("mail", 0, 1, 2), ("mail", 1, 1, 2), ("user_id", 0, 1, 2), ("user_id", 1, 1, 2),
    ]


def test_a_failed_upload_is_a_failed_job(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("a.sql", "CREATE TABLE users (\n  mail TEXT\n);\n")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    entries = archive_entries(spark, str(tmp_path / "*.zip"))
    out = build(spark, unpacked_files(entries), str(tmp_path / "out"), failures=failed_uploads(entries))
    jobs = {(r.project_id, r.job_type): (r.status, r.total) for r in out["processing_jobs"].collect()}
    assert jobs["good", "file_scan"] == ("completed", 1)
    assert jobs["bad", "file_scan"] == ("failed", 0)
