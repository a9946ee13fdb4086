"""Object-relational mappers per file: detection, model tables, field columns.

Everything here looks at one file at a time, so it is a set of expressions over
the file row and never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.orm_rules import CONTEXT_RULES, DEFAULT_USAGE, LINE_RULES, MAPPERS, Mapper
from weftline.functions.text import across_lines, extract_all, extract_groups, matches

# Fixed value: languages whose mappers serve each other.
SCRIPT_LANGUAGES = ["javascript", "typescript"]


def _speaks(mapper: Mapper, language: Column) -> Column:
    if mapper.language in SCRIPT_LANGUAGES:
        return language.isin(SCRIPT_LANGUAGES)
    return language == mapper.language


def mappers_of(content: Column, language: Column) -> Column:
    """Names of the mappers a file uses, in rule order."""
    found = []
    for mapper in MAPPERS:
        hit = F.lit(False)
        for pattern in mapper.indicators:
            hit = hit | matches(content, pattern)
        found.append(F.when(_speaks(mapper, language) & hit, F.lit(mapper.name)))
    return F.array_compact(F.array(*found))


def file_mappers(files: DataFrame) -> DataFrame:
    """``(project_id, file_id, orm, orm_seq)``; ``orm_seq`` is the rule-table position."""
    names = F.array(*[F.lit(m.name) for m in MAPPERS])
    return files.select(
        "project_id",
        F.col("id").alias("file_id"),
        F.explode(mappers_of(F.col("content"), F.col("language"))).alias("orm"),
    ).withColumn("orm_seq", F.array_position(names, F.col("orm")).cast("int"))


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def model_tables(files: DataFrame) -> DataFrame:
    """``(project_id, file_id, model, table_name)`` from mapper model patterns."""
    tagged = files.select(
        "project_id",
        F.col("id").alias("file_id"),
        "content",
        mappers_of(F.col("content"), F.col("language")).alias("orms"),
    )
    captures = [
        F.when(F.array_contains("orms", mapper.name), extract_all(F.col("content"), pattern, group)).otherwise(
            _empty("array<string>")
        )
        for mapper in MAPPERS
        for group, pattern in mapper.models
    ]
    names = F.array_distinct(F.concat(*captures))
    return (
        tagged.filter(F.size("orms") > 0)
        .select("project_id", "file_id", F.explode(names).alias("model"))
        .filter(F.col("model") != "")
        .withColumn("table_name", F.lower("model"))
    )


FIELD_ENTRY = "struct<field:string,seq:int,column_name:string>"


def field_entries(content: Column, orms: Column) -> Column:
    """Array of ``(field, seq, column_name)``, one per field: the last write wins.

    Writes are ordered by mapper, pattern and place in the text. Sorting by
    field and order keeps this near-linear however many fields a file has.
    """
    writes = []
    for mapper in MAPPERS:
        for field_group, column_group, pattern in mapper.fields:
            pairs = extract_groups(content, pattern, {"f": field_group, "c": column_group})
            writes.append(
                F.when(F.array_contains(orms, mapper.name), pairs).otherwise(_empty("array<struct<f:string,c:string>>"))
            )
    numbered = F.transform(
        F.filter(F.concat(*writes), lambda w: (w["f"] != "") & (w["c"] != "")),
        lambda w, i: F.struct(F.lower(w["f"]).alias("field"), i.alias("seq"), F.lower(w["c"]).alias("column_name")),
    )
    return F.array_sort(numbered)


def last_writes(entries: Column) -> Column:
    """Of entries sorted by field and order, the last one of each field."""
    return F.filter(
        entries, lambda e, i: F.coalesce(F.get(entries, i + 1)["field"] != e["field"], F.lit(True))
    )


def _with_entries(files: DataFrame) -> DataFrame:
    return files.withColumn("orms", mappers_of(F.col("content"), F.col("language"))).withColumn(
        "_entries",
        F.when(F.size("orms") > 0, field_entries(F.col("content"), F.col("orms"))).otherwise(
            _empty(f"array<{FIELD_ENTRY}>")
        ),
    )


def with_field_map(files: DataFrame) -> DataFrame:
    """Adds ``orms`` and ``field_map`` to file rows."""
    return _with_entries(files).withColumn("field_map", last_writes(F.col("_entries"))).drop("_entries")


def field_columns(files: DataFrame) -> DataFrame:
    """``(project_id, file_id, field, column_name)`` from mapper field patterns."""
    # Generating from an expression, not from a named array: for a named one the
    # optimizer adds a filter on its size and so extracts every field twice.
    return (
        _with_entries(files)
        .select("project_id", F.col("id").alias("file_id"), F.inline(last_writes(F.col("_entries"))))
        .drop("seq")
    )


def mapper_usage(context: Column, orms: Column) -> Column:
    """Usage type by mapper rules, null where none applies.

    A rule counts when it matches the line or its context. The line is part of
    the context and no rule is anchored, so the context alone decides.
    """
    usage = None
    for mapper in MAPPERS:
        used = F.array_contains(orms, mapper.name)
        for usage_type, pattern in mapper.usages:
            hit = used & matches(context, pattern)
            usage = F.when(hit, usage_type) if usage is None else usage.when(hit, usage_type)
    return F.when(F.size(orms) > 0, usage)


def line_usage(line: Column) -> Column:
    """Usage type by the line alone, null where no rule applies."""
    usage = None
    for usage_type, pattern in LINE_RULES:
        hit = matches(line, pattern, ignore_case=True)
        usage = F.when(hit, usage_type) if usage is None else usage.when(hit, usage_type)
    return usage


def context_usage(context: Column) -> Column:
    upper = F.upper(context)
    usage = None
    for usage_type, patterns in CONTEXT_RULES:
        hit = F.lit(True)
        for pattern in patterns:
            hit = hit & matches(upper, pattern)
        usage = F.when(hit, usage_type) if usage is None else usage.when(hit, usage_type)
    return usage.otherwise(DEFAULT_USAGE)


def usage_type(line: Column, context: Column, orms: Column) -> Column:
    return F.coalesce(mapper_usage(context, orms), line_usage(line), context_usage(context))


# What the windows of a block ask for, found once per line. A line is in eleven windows, so rules over
# contexts would read each line eleven times.

MARKS = ["rules", "words"]
_USAGES = [usage for mapper in MAPPERS for usage, _ in mapper.usages]
_WORDS = [(usage, pattern) for usage, patterns in CONTEXT_RULES for pattern in patterns]


def crosses(content: Column, orms: Column) -> Column:
    """Whether a usage rule of the file's mappers matches over the end of a line, which no mark of a line tells."""
    found = F.lit(False)
    for mapper in MAPPERS:
        wide = [across_lines(pattern) for _, pattern in mapper.usages]
        hit = F.lit(False)
        for pattern in wide:
            if pattern is not None:
                hit = hit | matches(content, pattern)
        found = found | (F.array_contains(orms, mapper.name) & hit)
    return found


def _first_rule(line: Column, orms: Column) -> Column:
    firsts, at = [], 0
    for mapper in MAPPERS:
        first = None
        for _, pattern in mapper.usages:
            hit = matches(line, pattern)
            first = F.when(hit, F.lit(at)) if first is None else first.when(hit, F.lit(at))
            at += 1
        firsts.append(F.when(F.array_contains(orms, mapper.name), first))
    return F.least(*firsts)


def _word_bits(upper: Column) -> Column:
    bits = F.lit(0)
    for place, (_, pattern) in enumerate(_WORDS):
        bits = bits + F.when(matches(upper, pattern), F.lit(1 << place)).otherwise(F.lit(0))
    return bits


def with_marks(blocks: DataFrame) -> DataFrame:
    """Adds ``rules`` and ``words``: per line of ``block`` its first mapper rule, and which words of the context rules it has."""
    orms = F.col("orms")
    return blocks.withColumn(
        "rules", F.when(F.size(orms) > 0, F.transform("block", lambda line: _first_rule(line, orms)))
    ).withColumn("words", F.transform(F.transform("block", F.upper), _word_bits))


def marked_mapper_usage(context: Column, orms: Column) -> Column:
    """:func:`mapper_usage` from the marks of the context's lines and from ``crosses``."""
    of_lines = F.get(F.array(*map(F.lit, _USAGES)), F.array_min("rules"))
    return F.when(F.col("crosses"), mapper_usage(context, orms)).otherwise(of_lines)


def marked_context_usage() -> Column:
    """:func:`context_usage` from the marks of the context's lines."""
    words = F.aggregate("words", F.lit(0), lambda held, more: held.bitwiseOR(more))
    usage = None
    for usage_type, patterns in CONTEXT_RULES:
        asked = sum(1 << place for place, word in enumerate(_WORDS) if word[0] == usage_type and word[1] in patterns)
        hit = words.bitwiseAND(F.lit(asked)) == asked
        usage = F.when(hit, usage_type) if usage is None else usage.when(hit, usage_type)
    return usage.otherwise(DEFAULT_USAGE)


def marked_usage_type(line: Column, context: Column, orms: Column) -> Column:
    """:func:`usage_type` for windows with marks."""
    return F.coalesce(marked_mapper_usage(context, orms), line_usage(line), marked_context_usage())
