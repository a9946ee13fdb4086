import warnings
import zipfile

from pyspark.sql import functions as F

from weftline.sources import corpus


def paths(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "file_path string")


def test_code_files_and_exclusions(spark):
    kept = corpus.code_files(
        paths(
            spark, "a/b.TS", "x.jsx", "dist/a.js", "app/dist/a.js", "node_modules/a.js", "a.class.java", "vendor/a.go", "x.md", "a.go\n", "my.gitlab/.git/x.py",
        )
    )
    assert sorted(r.file_path for r in kept.collect()) == ["a/b.TS", "dist/a.js", "x.jsx"]


def test_languages(spark):
    rows = paths(spark, "a.mjs", "a.TSX", "a.jsx", "noext", "dir.py/x", "s.gql", "m.prisma", ".go")
    found = {r.file_path: r.l for r in rows.withColumn("l", corpus.language_of(F.col("file_path"))).collect()}
    assert found == {
        "a.mjs": "javascript", "a.TSX": "typescript", "a.jsx": "unknown", "noext": "unknown", "dir.py/x": "unknown",
        "s.gql": "graphql", "m.prisma": "prisma", ".go": "go",
    }


def test_a_file_can_carry_both_flags(spark):
    rows = corpus.with_file_flags(paths(spark, "db/schema.prisma", "x.SQL", "models.py", "plain.go").withColumn("x", F.lit(1)))
    assert {r.file_path: (r.is_schema, r.is_orm_schema) for r in rows.collect()} == {
        "db/schema.prisma": (True, True), "x.SQL": (True, False), "models.py": (False, True), "plain.go": (False, False),
    }


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "shop.zip", "w") as z:
        z.writestr("src/a.py", "x = 1\n")
        z.writestr("src/bad.py", b"caf\xe9")
        z.writestr("src/empty.go", "")
        z.writestr("node_modules/b.js", "no")
        z.writestr("readme.md", "no")
        z.mkdir("src/dir.py")
    with zipfile.ZipFile(tmp_path / "other.ZIP", "w") as z:
        z.writestr("q.sql", "select 1")
    rows = corpus.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.project_id, r.file_path, r.language, r.content) for r in rows) == [
        ("other", "q.sql", "sql", "select 1"),
        ("shop", "src/a.py", "python", "x = 1\n"),
        ("shop", "src/bad.py", "python", "caf�"),
        ("shop", "src/empty.go", "go", ""),
    ]
    assert len({r.id for r in rows}) == 4


def test_what_cannot_be_read_is_named_and_the_rest_is_kept(spark, tmp_path):
    def packed(name, **entries):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for entry, text in entries.items():
                z.writestr(f"{entry}.py", text)
        return (tmp_path / name).read_bytes()

    packed("good.zip", a="x = 1\n")
    (tmp_path / "cut.zip").write_bytes(packed("cut.zip", a="x = 1\n" * 99)[:50])
    (tmp_path / "none.zip").write_bytes(b"no archive")
    damaged = packed("half.zip", bad="first text", fine="second text")
    (tmp_path / "half.zip").write_bytes(damaged.replace(b"first text", b"first_text", 1))
    files = corpus.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.project_id, r.file_path, r.content) for r in files) == [
        ("good", "a.py", "x = 1\n"), ("half", "fine.py", "second text"),
    ]
    failed = corpus.failed_uploads(corpus.archive_entries(spark, str(tmp_path))).collect()
    assert sorted((r.project_id, r.file_path or "", r.error.split(":")[0]) for r in failed) == [
        ("cut", "", "BadZipFile"), ("half", "bad.py", "BadZipFile"), ("none", "", "BadZipFile"),
    ]
    missing = spark.createDataFrame([("p", None)], "project_id string, archive binary")
    assert [(r.project_id, r.content) for r in corpus.unpack(missing).collect()] == [("p", None)]


def test_large_entries_come_out_whole(spark, tmp_path, monkeypatch):
    text = "select a from b;\n" * 700_000  # beyond one output batch
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.sql", text)
        z.writestr("b.sql", "x")
    rows = {r.file_path: r.n for r in corpus.read_archives(spark, str(tmp_path)).select("file_path", F.length("content").alias("n")).collect()}
    assert rows == {"a.sql": len(text), "b.sql": 1}


def test_trees(spark, tmp_path):
    (tmp_path / "src" / "model").mkdir(parents=True)
    (tmp_path / "src" / "model" / "a.go").write_text("package a\n")
    (tmp_path / "src" / "note.txt").write_text("no")
    (tmp_path / "my dir").mkdir()
    (tmp_path / "my dir" / "b +%41é.py").write_text("x = 1\n")
    for root in (f"file:{tmp_path}", f"file://{tmp_path}/", str(tmp_path)):
        rows = corpus.read_tree(spark, root, "p").collect()
        assert sorted((r.project_id, r.language, r.file_path, r.content) for r in rows) == [
            ("p", "go", "src/model/a.go", "package a\n"),
            ("p", "python", "my dir/b +%41é.py", "x = 1\n"),
        ]


def test_a_large_archive_is_read_by_many_tasks(spark, tmp_path):
    texts = {f"src/f{i}.py": f"x = {i}\n" * (i % 50) for i in range(5_000)}
    folder = tmp_path / "some folder"
    folder.mkdir()
    with zipfile.ZipFile(folder / "big +%41é.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in texts.items():
            z.writestr(name, text)
            z.writestr(name.replace(".py", ".md"), text)
    entries = corpus.archive_entries(spark, str(folder))
    tasks = entries.groupBy(F.spark_partition_id()).count().collect()
    # 5,000 entries are 20 pieces, which hashing deals to fewer tasks
    assert len(tasks) > 5 and max(r["count"] for r in tasks) < 2_500
    assert "Exchange" not in entries._jdf.queryExecution().executedPlan().toString().split("MapInPandas")[0]
    assert {(r.project_id, r.file_path): r.content for r in entries.collect()} == {
        ("big +%41é", name): text for name, text in texts.items()
    }
    whole = corpus.archive_entries(spark, str(folder), whole=True)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, entries.collect()))


def test_ways_of_packing(spark, tmp_path):
    methods = [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA]
    with open(tmp_path / "mixed.zip", "wb") as out:
        out.write(b"#!/bin/sh\n" * 9)  # an archive may follow something else
        with zipfile.ZipFile(out, "a") as z:
            for i, method in enumerate(methods):
                z.writestr(f"é{i}.sql", f"select {i};" * 100, method)
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                z.writestr("é0.sql", "the later one")
    with zipfile.ZipFile(tmp_path / "secret.zip", "w") as z:
        z.writestr("a.py", "x")
    blob = bytearray((tmp_path / "secret.zip").read_bytes())
    blob[blob.rindex(b"PK\x01\x02") + 8] |= 1  # marked as encrypted
    (tmp_path / "secret.zip").write_bytes(bytes(blob))
    with zipfile.ZipFile(tmp_path / "nothing.zip", "w"):
        pass
    got = {(r.project_id, r.file_path): r.content or r.error for r in corpus.archive_entries(spark, str(tmp_path)).collect()}
    want = {("mixed", f"é{i}.sql"): f"select {i};" * 100 for i in range(1, 4)} | {("mixed", "é0.sql"): "the later one"}
    assert got == want | {("secret", "a.py"): "RuntimeError: the entry is encrypted"}


def test_no_archives_no_entries(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert corpus.read_archives(spark, str(tmp_path / "none")).collect() == []
