"""Source corpora: archives or folders in, one row per code file out.

Columns: ``id, project_id, file_path, language, content, parsed``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.functions.text import one_of_substrings
from weftline.sources.archives import ENTRIES, UNREADABLE, contents, dealt, directory, in_batches, said

# Endings that make a file code, and path parts that rule it out.
CODE_ENDINGS = [
    ".go", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".java", ".py", ".rb", ".rs", ".cs", ".sql",
    ".graphql", ".gql", ".proto", ".prisma",
]
EXCLUDED_PARTS = [
    "node_modules/", "vendor/", ".git/", "__pycache__/", ".class", "/dist/", "/build/", "/target/",
]

# Path parts of files that define tables.
SCHEMA_PARTS = ["schema.sql", "migration", "migrate", "create_table", "schema.prisma", "schema.graphql"]
SCHEMA_ENDING = ".sql"
ORM_SCHEMA_PARTS = [
    "schema.prisma", "models.py", "entities", "entity", "model", "schema.ts", "schema.js", "tables.ts", "tables.js",
]

# Language of a file ending.
LANGUAGE_ENDINGS = {
    "go": [".go"],
    "javascript": [".js", ".mjs", ".cjs"],
    "typescript": [".ts", ".tsx"],
    "java": [".java"],
    "python": [".py"],
    "ruby": [".rb"],
    "rust": [".rs"],
    "csharp": [".cs"],
    "sql": [".sql"],
    "prisma": [".prisma"],
    "graphql": [".graphql", ".gql"],
    "proto": [".proto"],
}
UNKNOWN_LANGUAGE = "unknown"
KNOWN_LANGUAGES = [*LANGUAGE_ENDINGS, UNKNOWN_LANGUAGE]

SOURCE_FILES = "id string, project_id string, file_path string, language string, content string, parsed boolean"

_CODE = "(" + "|".join(re.escape(e) for e in CODE_ENDINGS) + r")\z"
_EXCLUDED = "|".join(re.escape(p) for p in EXCLUDED_PARTS)

def is_code_file(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(_CODE) & ~low.rlike(_EXCLUDED)


def is_schema_file(path: Column) -> Column:
    low = F.lower(path)
    return one_of_substrings(low, SCHEMA_PARTS) | low.endswith(SCHEMA_ENDING)


def is_orm_schema_file(path: Column) -> Column:
    return one_of_substrings(F.lower(path), ORM_SCHEMA_PARTS)


def language_of(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"([.][^.]*)\z", 1))
    label = F.lit(UNKNOWN_LANGUAGE)
    for language, endings in LANGUAGE_ENDINGS.items():
        label = F.when(ending.isin(endings), language).otherwise(label)
    return label


def code_files(files: DataFrame) -> DataFrame:
    return files.filter(is_code_file(F.col("file_path")))


def with_file_flags(files: DataFrame) -> DataFrame:
    path = F.col("file_path")
    return (
        files.withColumn("language", language_of(path))
        .withColumn("is_schema", is_schema_file(path))
        .withColumn("is_orm_schema", is_orm_schema_file(path))
    )


def _source_files(entries: DataFrame) -> DataFrame:
    path = F.col("file_path")
    return code_files(entries).select(
        F.md5(F.concat_ws("\n", "project_id", path)).alias("id"),
        "project_id",
        "file_path",
        language_of(path).alias("language"),
        "content",
        F.lit(False).alias("parsed"),
    )


def _is_wanted(name: str) -> bool:
    """:func:`is_code_file` for one name."""
    low = name.lower()
    return bool(re.search(_CODE.replace(r"\z", r"\Z"), low)) and not re.search(_EXCLUDED, low)


def _code_entries(project: str, blob: bytes) -> Iterator[tuple[str, str | None, str | None, str | None]]:
    """Rows of ``ENTRIES`` for one archive: its code files, and what could not be read."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(blob))
    except (zipfile.BadZipFile, ValueError, OSError) as error:
        yield project, None, None, said(error)
        return
    with archive:
        for name, info in archive.NameToInfo.items():
            if info.is_dir() or not _is_wanted(name):
                continue
            try:
                text = archive.read(info).decode("utf-8", errors="replace")
            except UNREADABLE as error:
                yield project, name, None, said(error)
            else:
                yield project, name, text, None


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for project, blob in zip(batch["project_id"], batch["archive"]):
            yield from in_batches(_code_entries(project, blob if blob is not None else b""))


def unpack(archives: DataFrame) -> DataFrame:
    """``(project_id, archive)`` with zip bytes → code entries ``(project_id, file_path, content, error)``.

    An entry that cannot be read has its error and no content; an archive that
    cannot be opened is one row with neither path nor content. Other archives
    and entries are not affected. A null archive is an unreadable one.
    """
    return archives.select("project_id", "archive").mapInPandas(_unpack, ENTRIES)


def unpacked_files(entries: DataFrame) -> DataFrame:
    """Source files of the entries that could be read."""
    return _source_files(entries.where("error is null").drop("error"))


def failed_uploads(entries: DataFrame) -> DataFrame:
    """``project_id, file_path, error`` for what could not be read; the path is null for a whole archive."""
    return entries.where("error is not null").select("project_id", "file_path", "error")


def archive_entries(spark: SparkSession, path: str, project: Column | None = None, whole: bool = False) -> DataFrame:
    """Entries of the zip archives at ``path``; the project is the archive's base name unless given.

    The archives are listed by Spark and read by their directories, see
    :mod:`weftline.sources.archives`; the directories are read at once, the
    contents when the result is. ``whole`` reads each archive in one piece, of
    2 GiB at most, through Spark's own reader: for file systems that ``pyarrow.fs``
    cannot open. Spark passes over files of no bytes, so these have no row here.
    """
    if project is None:
        project = F.regexp_extract(F.col("path"), r"([^/]+?)(?:[.][zZ][iI][pP])?\z", 1)
    archives = spark.read.format("binaryFile").load(path)
    if whole:
        return unpack(archives.select(project.alias("project_id"), F.col("content").alias("archive")))
    return contents(dealt(directory(archives.select(project.alias("project_id"), "path"), _is_wanted)))


def read_archives(spark: SparkSession, path: str, project: Column | None = None, whole: bool = False) -> DataFrame:
    """Zip archives → source files, spread over the tasks that read them.

    What could not be read is left out here; ``failed_uploads(archive_entries(...))`` names it.
    """
    files = unpacked_files(archive_entries(spark, path, project, whole))
    # an archive read whole is one task, so its files are spread before the text-heavy stages that follow
    return files.repartition(F.col("id")) if whole else files


def read_tree(spark: SparkSession, path: str, project_id: str) -> DataFrame:
    """A folder of unpacked files → source files, paths relative to the folder."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    root = files.makeQualified(folder).toUri().getPath().rstrip("/") + "/"
    # the metadata column is a URL; a plus sign in it is itself, not a space
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    full = F.regexp_replace(full, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    outside = F.raise_error(F.concat(F.lit("not below the folder: "), full)).cast("string")
    entries = text.select(
        F.lit(project_id).alias("project_id"),
        F.when(F.startswith(full, F.lit(root)), F.substring(full, len(root) + 1, 1 << 30)).otherwise(outside).alias("file_path"),
        F.col("value").alias("content"),
    )
    return _source_files(entries)
