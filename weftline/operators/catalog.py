"""Tables and columns stated in source text: DDL and mapper models.

All extractors share one pass over the files: each file yields its table bodies,
tagged by parser, each body its parts, each part at most one column. What comes
out is ``project_id, file_id, file_path, parser, table_seq, table_name, col_seq,
column_name, data_type, is_primary_key, is_foreign_key, foreign_table,
foreign_column``. Sequence numbers follow the text and start at 0; tables
without columns do not come out.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.names import plural_table, to_snake
from weftline.functions.text import extract, extract_all, extract_groups, java_regex, matches, trimmed
from weftline.sources.corpus import is_orm_schema_file, is_schema_file

# Patterns that find tables and columns, and word lists used with them.
CREATE_TABLE = r"""CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:`|")?(\w+)(?:`|")?\s*\(([\s\S]*?)\);"""
DDL_COLUMN = r"""^(?:`|")?(\w+)(?:`|")?\s+(\w[\w() ]*)"""
DDL_REFERENCE = r"""REFERENCES\s+(?:`|")?(\w+)(?:`|")?\s*\(\s*(?:`|")?(\w+)(?:`|")?\s*\)"""
DDL_SKIPPED_STARTS = ["PRIMARY KEY", "UNIQUE", "INDEX", "KEY", "CONSTRAINT", "CHECK", "FOREIGN KEY"]

PRISMA_MODEL = r"""model\s+(\w+)\s*\{([\s\S]*?)\}"""
PRISMA_TABLE = r"""@@map\(\s*["'](\w+)["']\s*\)"""
PRISMA_FIELD = r"""^(\w+)\s+(\w+)(\?|\[\])?\s*(.*)"""
PRISMA_COLUMN = r"""@map\(\s*["'](\w+)["']\s*\)"""
PRISMA_SCALARS = ["String", "Int", "Float", "Boolean", "DateTime", "BigInt", "Decimal", "Bytes", "Json"]

# The body ends before the next unindented line or with the text.
PYTHON_CLASS = r"""class\s+(\w+)\s*\([^)]*\)\s*:([\s\S]*?)(?=\nclass\s|\n\S|\z)"""
PYTHON_TABLE = r"""__tablename__\s*=\s*['"](\w+)['"]"""
PYTHON_FIELD = r"""(\w+)\s*=\s*(?:Column|mapped_column)\s*\(([\s\S]*?)\)"""
PYTHON_TYPE = r"""(Integer|String|Text|Float|Boolean|DateTime|BigInteger|Numeric|Date|Time|LargeBinary|JSON|UUID)"""
PYTHON_REFERENCE = r"""ForeignKey\s*\(\s*['"](\w+)\.(\w+)['"]"""

GO_STRUCT = r"""type\s+(\w+)\s+struct\s*\{([\s\S]*?)\}"""
GO_TABLE = r"""func\s*\(\s*\w+\s+(\w+)\s*\)\s*TableName\s*\(\s*\)\s*string\s*\{[^}]*return\s+["'](\w+)["']"""
GO_FIELD = r"""(\w+)\s+(\S+)\s+`([^`]*)`"""
GO_GORM_COLUMN = r"""gorm:"[^"]*column:(\w+)"""
GO_JSON_NAME = r"""json:"(\w+)"""
GO_TAGS = ["gorm:", "db:", "json:"]

JAVA_ENTITY = r"""@(?:Entity|Table)[^]*?class\s+(\w+)\s*(?:extends\s+\w+\s*)?(?:implements\s+[\w,\s]+\s*)?\{([\s\S]*?)\n\}"""
JAVA_TABLE = r"""@Table\s*\(\s*name\s*=\s*["'](\w+)["']"""
JAVA_FIELD = r"""(?:@Column\s*(?:\(\s*(?:name\s*=\s*["'](\w+)["'][^)]*)\s*\))?\s*)?(?:@Id\s+)?private\s+(\w+)\s+(\w+)\s*;"""
JAVA_REACH = 200

UNKNOWN_TYPE = "unknown"

FILE = ["project_id", "file_id", "file_path"]
FOUND = [
    *FILE, "table_seq", "table_name", "col_seq", "column_name", "data_type",
    "is_primary_key", "is_foreign_key", "foreign_table", "foreign_column",
]

_TABLE = "array<struct<head:string,body:string,named:string>>"
_PART = "array<struct<a:string,b:string,c:string,d:string>>"


class Parser(NamedTuple):
    """How one kind of text states tables.

    ``tables`` maps content to ``(head, body, named)``, ``parts`` a body to
    ``(a, b, c, d)``, and ``column`` those four to the fields of a column.
    ``named`` is the table's own name, null where it follows from ``head``.
    """

    applies: Callable[[Column, Column], Column]
    tables: Callable[[Column], Column]
    parts: Callable[[Column], Column]
    keep: Callable[[Column, Column, Column, Column], Column]
    column: Callable[[Column, Column, Column, Column], dict[str, Column]]


def _zipped(kind: str, *groups: Column) -> Column:
    return F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)]).cast(kind)


def _blocks(content: Column, pattern: str, ignore_case: bool = False) -> Column:
    return extract_groups(content, pattern, {"head": 1, "body": 2}, ignore_case)


def _tables(blocks: Column, named: Callable[[Column], Column]) -> Column:
    return F.transform(
        blocks, lambda t: F.struct(t["head"].alias("head"), t["body"].alias("body"), named(t).alias("named"))
    ).cast(_TABLE)


def _pieces(body: Column, separator: str) -> Column:
    none = F.lit(None).cast("string")
    return F.transform(
        F.split(body, separator, -1),
        lambda p: F.struct(trimmed(p).alias("a"), none.alias("b"), none.alias("c"), none.alias("d")),
    )


def _fields(body: Column, pattern: str, groups: int) -> Column:
    found = extract_groups(body, pattern, {"abcd"[g]: g + 1 for g in range(groups)})
    none = F.lit(None).cast("string")
    padding = [none.alias(x) for x in "abcd"[groups:]]
    return F.transform(found, lambda m: F.struct(*[m[x].alias(x) for x in "abcd"[:groups]], *padding)).cast(_PART)


def _always(*parts: Column) -> Column:
    return F.lit(True)


def _ddl_keep(part: Column, *_: Column) -> Column:
    skipped = F.lit(False)
    for start in DDL_SKIPPED_STARTS:
        skipped = skipped | F.upper(part).startswith(start)
    return matches(part, DDL_COLUMN, ignore_case=True) & ~skipped


def _ddl_column(part: Column, *_: Column) -> dict[str, Column]:
    upper = F.upper(part)
    refers = upper.contains("REFERENCES")
    return {
        "column_name": extract(part, DDL_COLUMN, 1, ignore_case=True),
        "data_type": trimmed(extract(part, DDL_COLUMN, 2, ignore_case=True)),
        "is_primary_key": upper.contains("PRIMARY KEY"),
        "is_foreign_key": refers,
        "foreign_table": F.when(refers, extract(part, DDL_REFERENCE, 1, ignore_case=True)),
        "foreign_column": F.when(refers, extract(part, DDL_REFERENCE, 2, ignore_case=True)),
    }


def _prisma_keep(part: Column, *_: Column) -> Column:
    kind = extract(part, PRISMA_FIELD, 2)
    first = F.substring(kind, 1, 1)
    relation = F.coalesce(extract(part, PRISMA_FIELD, 4).contains("@relation"), F.lit(False))
    return (
        matches(part, PRISMA_FIELD)
        & ~part.startswith("//")
        & ~part.startswith("@@")
        & ~relation
        & (kind.isin(PRISMA_SCALARS) | (first != F.upper(first)))
    )


def _prisma_column(part: Column, *_: Column) -> dict[str, Column]:
    field, rest = extract(part, PRISMA_FIELD, 1), F.coalesce(extract(part, PRISMA_FIELD, 4), F.lit(""))
    return {
        "column_name": F.coalesce(extract(rest, PRISMA_COLUMN), to_snake(field)),
        "data_type": extract(part, PRISMA_FIELD, 2),
        "is_primary_key": rest.contains("@id"),
        "is_foreign_key": field.endswith("Id"),
    }


def _sqlalchemy_column(name: Column, args: Column, *_: Column) -> dict[str, Column]:
    return {
        "column_name": name,
        "data_type": extract(args, PYTHON_TYPE, 1, ignore_case=True),
        "is_primary_key": args.contains("primary_key=True") | args.contains("primary_key = True"),
        "is_foreign_key": args.contains("ForeignKey"),
        "foreign_table": extract(args, PYTHON_REFERENCE, 1),
        "foreign_column": extract(args, PYTHON_REFERENCE, 2),
    }


def _go_tables(content: Column) -> Column:
    """Tagged structs; the table may come from a TableName method anywhere in the file."""
    methods = extract_groups(content, GO_TABLE, {"s": 1, "t": 2})
    tagged = F.filter(_blocks(content, GO_STRUCT), lambda t: t["body"].rlike("|".join(GO_TAGS)))
    return _tables(tagged, lambda t: F.get(F.filter(methods, lambda m: m["s"] == t["head"]), 0)["t"])


def _go_column(field: Column, kind: Column, tags: Column, _: Column) -> dict[str, Column]:
    return {
        "column_name": F.coalesce(extract(tags, GO_GORM_COLUMN), extract(tags, GO_JSON_NAME), to_snake(field)),
        "data_type": kind,
        "is_primary_key": tags.contains("primaryKey") | tags.contains("primarykey") | (field == "ID"),
        "is_foreign_key": field.endswith("ID") & (field != "ID"),
    }


def _reach_before(body: Column) -> Column:
    """For each field, the text right before it, as far as key marks are looked for."""
    found = extract_all(body, JAVA_FIELD, 0)
    steps = _zipped("array<struct<gap:string,hit:string>>", F.split(body, java_regex(JAVA_FIELD), -1), found)

    def step(state: Column, place: Column) -> Column:
        before = F.right(F.concat(state["tail"], place["gap"]), F.lit(JAVA_REACH))
        return F.struct(
            F.right(F.concat(before, F.coalesce(place["hit"], F.lit(""))), F.lit(JAVA_REACH)).alias("tail"),
            F.concat(state["seen"], F.array(before)).alias("seen"),
        )

    empty = F.struct(F.lit("").alias("tail"), F.array().cast("array<string>").alias("seen"))
    # The text after the last field is a gap too, but no field follows it.
    return F.aggregate(steps, empty, step, lambda state: F.slice(state["seen"], F.lit(1), F.size(state["seen"]) - 1))


def _java_parts(body: Column) -> Column:
    fields = _fields(body, JAVA_FIELD, 3)
    return F.zip_with(
        fields, _reach_before(body), lambda f, before: F.struct(f["a"].alias("a"), f["b"].alias("b"), f["c"].alias("c"), before.alias("d"))
    )


def _jpa_column(explicit: Column, kind: Column, field: Column, before: Column) -> dict[str, Column]:
    return {
        "column_name": F.coalesce(F.nullif(explicit, F.lit("")), to_snake(field)),
        "data_type": kind,
        "is_primary_key": before.contains("@Id"),
        "is_foreign_key": before.contains("@ManyToOne") | before.contains("@JoinColumn"),
    }


PARSERS = {
    "ddl": Parser(
        applies=lambda content, language: matches(content, r"CREATE\s+TABLE", ignore_case=True),
        tables=lambda content: _tables(_blocks(content, CREATE_TABLE, ignore_case=True), lambda t: t["head"]),
        parts=lambda body: _pieces(body, ","),
        keep=_ddl_keep,
        column=_ddl_column,
    ),
    "prisma": Parser(
        applies=lambda content, language: (language == "unknown") | content.contains("model "),
        tables=lambda content: _tables(_blocks(content, PRISMA_MODEL), lambda t: extract(t["body"], PRISMA_TABLE)),
        parts=lambda body: _pieces(body, "\n"),
        keep=_prisma_keep,
        column=_prisma_column,
    ),
    "sqlalchemy": Parser(
        applies=lambda content, language: (language == "python") & content.contains("__tablename__"),
        tables=lambda content: F.filter(
            _tables(_blocks(content, PYTHON_CLASS), lambda t: extract(t["body"], PYTHON_TABLE)),
            lambda t: t["named"].isNotNull(),
        ),
        parts=lambda body: _fields(body, PYTHON_FIELD, 2),
        keep=_always,
        column=_sqlalchemy_column,
    ),
    "gorm": Parser(
        applies=lambda content, language: (language == "go") & content.contains("struct"),
        tables=_go_tables,
        parts=lambda body: _fields(body, GO_FIELD, 3),
        keep=lambda field, kind, tags, _: ~kind.contains(".") | tags.contains("column:"),
        column=_go_column,
    ),
    "jpa": Parser(
        applies=lambda content, language: (language == "java") & matches(content, r"@(?:Entity|Table)"),
        tables=lambda content: _tables(_blocks(content, JAVA_ENTITY), lambda t: extract(content, JAVA_TABLE)),
        parts=_java_parts,
        keep=_always,
        column=_jpa_column,
    ),
}


def _by_parser(names: list[str], value: Callable[[Parser], Column]) -> Column:
    parser = F.col("parser")
    chosen = F.when(parser == names[0], value(PARSERS[names[0]]))
    for name in names[1:]:
        chosen = chosen.when(parser == name, value(PARSERS[name]))
    return chosen


def _tagged(parser: str) -> Callable[[Column, Column], Column]:
    return lambda table, i: F.struct(
        F.lit(parser).alias("parser"),
        i.alias("table_seq"),
        table["head"].alias("head"),
        table["body"].alias("body"),
        table["named"].alias("named"),
    )


def table_columns(files: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """Run the named parsers, each over the files its condition admits, in one pass."""
    content, language = F.col("content"), F.col("language")
    names = list(wanted)
    texts = files.select("project_id", F.col("id").alias("file_id"), "file_path", "language", "content")
    nothing = F.array().cast("array<struct<parser:string,table_seq:int,head:string,body:string,named:string>>")
    found = []
    for name in names:
        parser = PARSERS[name]
        tables = F.transform(parser.tables(content), _tagged(name))
        found.append(F.when(wanted[name] & parser.applies(content, language), tables).otherwise(nothing))
    # Outer generators over named arrays get no size filter pushed below them, which would search every text twice.
    bodies = texts.select(*FILE, F.concat(*found).alias("_found")).select(*FILE, F.inline_outer("_found")).filter("parser IS NOT NULL")
    listed = bodies.select(
        *FILE,
        "parser",
        "table_seq",
        F.coalesce("named", plural_table(F.col("head"))).alias("table_name"),
        _by_parser(names, lambda p: p.parts(F.col("body"))).alias("_parts"),
    )
    parts = listed.select(
        *FILE, "parser", "table_seq", "table_name", F.posexplode_outer("_parts").alias("col_seq", "part")
    ).filter("col_seq IS NOT NULL")
    part = [F.col(f"part.{x}") for x in "abcd"]
    kept = parts.filter(_by_parser(names, lambda p: p.keep(*part)))
    none = F.lit(None).cast("string")

    def field(name: str) -> Column:
        return _by_parser(names, lambda p: p.column(*part).get(name, none)).alias(name)

    return kept.select(
        *FILE,
        "parser",
        "table_seq",
        "table_name",
        "col_seq",
        field("column_name"),
        F.coalesce(F.nullif(field("data_type"), F.lit("")), F.lit(UNKNOWN_TYPE)).alias("data_type"),
        field("is_primary_key"),
        field("is_foreign_key"),
        field("foreign_table"),
        field("foreign_column"),
    )


def _only(files: DataFrame, parser: str) -> DataFrame:
    return table_columns(files, {parser: F.lit(True)}).select(*FOUND)


def ddl_columns(files: DataFrame) -> DataFrame:
    """Columns of every CREATE TABLE statement; the body is cut at every comma."""
    return _only(files, "ddl")


def prisma_columns(files: DataFrame) -> DataFrame:
    """Fields of Prisma models; relations and fields typed by another model are left out."""
    return _only(files, "prisma")


def sqlalchemy_columns(files: DataFrame) -> DataFrame:
    """Column assignments of Python classes that name their table."""
    return _only(files, "sqlalchemy")


def go_columns(files: DataFrame) -> DataFrame:
    """Tagged fields of Go structs."""
    return _only(files, "gorm")


def jpa_columns(files: DataFrame) -> DataFrame:
    """Private fields of Java entities; key marks are looked for in the text before a field."""
    return _only(files, "jpa")


def extracted_columns(files: DataFrame) -> DataFrame:
    """DDL from schema files and models from model files, with the parser's name.

    A table stated both ways comes out twice.
    """
    path = F.col("file_path")
    flags = {name: is_schema_file(path) if name == "ddl" else is_orm_schema_file(path) for name in PARSERS}
    marked = files.filter(is_schema_file(path) | is_orm_schema_file(path))
    return table_columns(marked, flags)


def catalog_ids(found: DataFrame) -> DataFrame:
    """Adds ``schema_id`` and ``column_id``, fixed by project, path, parser and place."""
    table = ["project_id", "file_path", "parser", F.col("table_seq").cast("string")]
    return found.withColumn("schema_id", F.md5(F.concat_ws("|", *table))).withColumn(
        "column_id", F.md5(F.concat_ws("|", *table, F.col("col_seq").cast("string")))
    )


def db_schemas(found: DataFrame) -> DataFrame:
    return found.select(F.col("schema_id").alias("id"), "project_id", "table_name").distinct()


def db_columns(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("column_id").alias("id"),
        "schema_id",
        "column_name",
        "data_type",
        "is_primary_key",
        "is_foreign_key",
        "foreign_table",
        "foreign_column",
        F.lit(None).cast("string").alias("ai_description"),
    )


def build_catalog(files: DataFrame, dedupe: bool = False) -> DataFrame:
    """Columns with ids. ``dedupe`` keeps one definition per project, table and column.

    The one kept is the first by parser order, path and place in the text.
    """
    found = catalog_ids(extracted_columns(files))
    if not dedupe:
        return found
    rank = F.array_position(F.array(*[F.lit(p) for p in PARSERS]), F.col("parser"))
    first = F.struct(rank, "file_path", "table_seq", "col_seq")
    rest = [c for c in found.columns if c not in ("project_id", "table_name", "column_name")]
    kept = found.groupBy("project_id", "table_name", "column_name").agg(
        F.min_by(F.struct(*rest), first).alias("_kept")
    )
    return kept.select("project_id", "table_name", "column_name", "_kept.*")
