"""Line dedup with overlapping three-line windows.

Every three consecutive lines are a window. Windows that occur again, anywhere in
the corpus, keep their first occurrence (by document, then position); the lines
that later occurrences cover are merged and go. An occurrence that overlaps the
first one in the same document covers only the lines after it, so one copy stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.llm.common import documents, fresh
from weftline.llm.registry import query
from weftline.session import cut

WINDOW = 3


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _windows(text: Column) -> Column:
    """Position and two independent 64-bit hashes of each window that has more than spaces and line ends."""

    def window(lines: Column, at: Column) -> Column:
        parts = [F.get(lines, at + i) for i in range(WINDOW)]
        blank = F.trim(F.concat(*parts)) == ""
        hashes = F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *reversed(parts)).alias("h2")
        return F.when(~blank, F.struct(at.alias("pos"), *hashes))

    def of_lines(lines: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(lines) - WINDOW)
        return F.when(F.size(lines) >= WINDOW, F.transform(starts, lambda at: window(lines, at)))

    return F.array_compact(_let(_lines(text), of_lines))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, hash, covered``: the positions of lines to remove, for documents that have any.

    ``hash`` tells rows of one id apart by their text. Rows alike in both are one
    document that stands there several times, and get the same answer.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.explode(_windows(F.col("text"))).alias("w"))
    windows = cut(keyed.select("doc_id", "hash", "w.pos", "w.h1", "w.h2"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "pos")
    seen = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = windows.join(seen.select("h1", "h2", "first"), ["h1", "h2"]).where(place > F.col("first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash"))
    start = F.when(same, F.greatest("pos", F.col("first.pos") + WINDOW)).otherwise(F.col("pos"))
    covers = F.sequence(start, F.col("pos") + WINDOW - 1)
    lines = later.select("doc_id", "hash", F.when(start < F.col("pos") + WINDOW, covers).alias("lines"))
    return lines.groupBy("doc_id", "hash").agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("covered"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns, the text without repeated windows, n_lines and n_removed.

    Lines end with a line feed. Texts of fewer than three lines, and null ones,
    stay as they are (a null text has no lines). The added columns get a longer
    name where ``docs`` has them already. An empty table gives no rows.
    """
    count, removed, mark = (fresh(docs, name) for name in ("n_lines", "n_removed", "hash"))
    whose, same, gone = (fresh(docs, name) for name in ("_id", "_hash", "covered"))
    covered = repeated_lines(docs.select("doc_id", "text")).select(
        F.col("doc_id").alias(whose), F.col("hash").alias(same), F.col("covered").alias(gone)
    )
    rows = docs.withColumn(mark, F.xxhash64("text"))
    found = rows.join(covered, rows["doc_id"].eqNullSafe(F.col(whose)) & (rows[mark] == F.col(same)), "left")
    lines = _lines(rows["text"])

    def rest(own: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), covered[gone])
        return F.array_join(F.transform(kept, lambda at: F.get(own, at)), "\n")

    text = F.when(covered[gone].isNull(), rows["text"]).otherwise(_let(lines, rest))
    return found.select(
        *[text.alias(c) if c == "text" else rows[c] for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(count),
        F.coalesce(F.size(covered[gone]), F.lit(0)).cast("long").alias(removed),
    )


_CHECK = """
WITH lines AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents
), windows AS (
  SELECT doc_id, t.i - 1 AS pos, l[t.i : t.i + 2] AS w FROM lines, unnest(range(1, len(l) - 1)) AS t(i)
  WHERE trim(array_to_string(l[t.i : t.i + 2], ''), ' ') <> ''
), ranked AS (
  SELECT doc_id, pos, first_value(doc_id) OVER o AS first_id, first_value(pos) OVER o AS first_pos
  FROM windows WINDOW o AS (PARTITION BY w ORDER BY doc_id, pos)
), covered AS (
  SELECT DISTINCT doc_id, t.line
  FROM ranked, unnest(range(CASE WHEN doc_id = first_id THEN greatest(pos, first_pos + 3) ELSE pos END, pos + 3)) AS t(line)
  WHERE doc_id <> first_id OR pos <> first_pos
), gone AS (SELECT doc_id, list(line) AS gone FROM covered GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       array_to_string([l[i + 1] for i in range(len(l)) if gone IS NULL OR NOT list_contains(gone, i)], chr(10)) AS text
FROM lines LEFT JOIN gone USING (doc_id)
"""


@query("op9_line_windows", _CHECK)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated windows of lines."""
    return deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
