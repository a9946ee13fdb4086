"""Looking at stored tables: samples, sizes, column metadata, DDL."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from weftline.operators.ranking import PAGE_ROWS, nested_pages
from weftline.session import cut

SAMPLE_ROWS = 10
SAMPLE = "table_name string, row_no int, row string, error string"


def sample_text(column: Column, kind: T.DataType) -> Column:
    """Times as ISO text, binaries by their size, nulls as ''."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    elif isinstance(kind, T.DateType):
        text = F.date_format(column, "yyyy-MM-dd'T'00:00:00.000'Z'")
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("<Buffer "), F.octet_length(column).cast("string"), F.lit(" bytes>"))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(column)
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit(""))


def table_sample(name: str, table: DataFrame, rows: int, order_by: list[str] | None) -> DataFrame:
    picked = (table.orderBy(*order_by) if order_by else table).limit(rows)
    cells = F.struct(*[sample_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in table.schema])
    order = Window.orderBy(*(order_by or [F.monotonically_increasing_id()]))
    return picked.select(
        F.lit(name).alias("table_name"),
        F.row_number().over(order).alias("row_no"),
        F.to_json(cells).alias("row"),
        F.lit(None).cast("string").alias("error"),
    )


def sample_tables(
    spark: SparkSession,
    tables: dict[str, Callable[[], DataFrame]],
    rows: int = SAMPLE_ROWS,
    order_by: dict[str, list[str]] | None = None,
) -> DataFrame:
    """First rows of each table as text; a table that cannot be read becomes an error row.

    Each sample is written before the next one is tried, since a damaged file
    shows only when it is read. Without ``order_by`` the rows are whichever come
    first.
    """
    samples = None
    for name, read in tables.items():
        try:
            one = cut(table_sample(name, read(), rows, (order_by or {}).get(name)))
        except PySparkException as error:
            one = spark.createDataFrame([(name, None, None, f"Error: {error.getCondition() or error}")], SAMPLE)
        except Py4JJavaError as error:
            # a job that failed for a reason without a condition of Spark's own
            said = str(error.java_exception).splitlines()[0]
            one = spark.createDataFrame([(name, None, None, f"Error: {said}")], SAMPLE)
        samples = one if samples is None else samples.unionByName(one)
    return samples if samples is not None else spark.createDataFrame([], SAMPLE)


def table_inventory(tables: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """``schema_name, table_name, row_count, total_space_kb`` of file-backed tables, in name order.

    Only file metadata and row counts are read, no columns.
    """
    counted = None
    for (schema, name), table in tables.items():
        per_file = table.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.count("*").alias("n"), F.max("_metadata.file_size").alias("bytes")
        )
        one = per_file.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("row_count"),
            F.ceil(F.coalesce(F.sum("bytes"), F.lit(0)) / 1024).cast("bigint").alias("total_space_kb"),
        ).select(F.lit(schema).alias("schema_name"), F.lit(name).alias("table_name"), "row_count", "total_space_kb")
        counted = one if counted is None else counted.unionByName(one)
    if counted is None:
        raise ValueError("no tables given")
    return counted.orderBy("schema_name", "table_name")


def column_metadata(
    columns: DataFrame,
    tables: DataFrame,
    schemas: DataFrame,
    types: DataFrame,
    primary_keys: DataFrame,
    foreign_keys: DataFrame,
    descriptions: DataFrame,
) -> DataFrame:
    """Columns of user tables with type, key flags, reference and description, in catalog order.

    ``columns``: ``object_id, column_id, column_name, type_id, max_length,
    precision, scale, is_nullable, is_identity``; ``tables``: ``object_id,
    schema_id, table_name, is_ms_shipped``; ``schemas``: ``schema_id,
    schema_name``; ``types``: ``type_id, data_type``; keys by ``object_id,
    column_id``, foreign keys with ``referenced_table, referenced_column``,
    descriptions with ``column_description``.
    """
    place = ["object_id", "column_id"]
    keys = primary_keys.select(*place, F.lit(1).alias("is_primary_key")).distinct()
    references = foreign_keys.select(*place, F.lit(1).alias("is_foreign_key"), "referenced_table", "referenced_column")
    return (
        columns.join(tables.filter(~F.col("is_ms_shipped")), "object_id")
        .join(schemas, "schema_id")
        .join(types, "type_id")
        .join(keys, place, "left")
        .join(references, place, "left")
        .join(descriptions.select(*place, "column_description"), place, "left")
        .select(
            "schema_name",
            "table_name",
            F.col("column_id").alias("ordinal"),
            "column_name",
            "data_type",
            "max_length",
            "precision",
            "scale",
            "is_nullable",
            "is_identity",
            F.coalesce("is_primary_key", F.lit(0)).alias("is_primary_key"),
            F.coalesce("is_foreign_key", F.lit(0)).alias("is_foreign_key"),
            "referenced_table",
            "referenced_column",
            "column_description",
        )
        .orderBy("schema_name", "table_name", "ordinal")
    )


def schema_document(metadata: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """``schema_name, table_name, page, columns``: nested columns with a nested reference or null."""
    reference = F.when(
        F.col("is_foreign_key") == 1,
        F.struct(F.col("referenced_table").alias("table"), F.col("referenced_column").alias("column")),
    )
    item = F.struct(
        F.col("column_name").alias("name"),
        F.col("data_type").alias("type"),
        F.col("max_length").alias("maxLength"),
        F.col("precision"),
        F.col("scale"),
        F.col("is_nullable").alias("nullable"),
        F.col("is_identity").alias("identity"),
        (F.col("is_primary_key") == 1).alias("primaryKey"),
        reference.alias("foreignKey"),
        F.col("column_description").alias("description"),
    )
    order = [F.col("ordinal"), F.col("column_name")]
    return nested_pages(metadata, ["schema_name", "table_name"], order, item, "columns", page_rows)


def schema_totals(metadata: DataFrame) -> DataFrame:
    per_table = metadata.groupBy("schema_name", "table_name").agg(F.count("*").alias("n"))
    return per_table.agg(F.count("*").alias("tables"), F.sum("n").alias("columns"))


# Types printed with a length, and types printed with precision and scale.
LENGTH_TYPES = ["varchar", "nvarchar", "char", "nchar"]
SCALE_TYPES = ["decimal", "numeric"]


def column_definition() -> Column:
    length = F.when(F.col("max_length") == -1, "(MAX)").otherwise(
        F.concat(F.lit("("), F.col("max_length").cast("string"), F.lit(")"))
    )
    digits = F.concat(
        F.lit("("), F.col("precision").cast("string"), F.lit(", "), F.col("scale").cast("string"), F.lit(")")
    )
    none = F.lit("")
    return F.concat(
        F.lit("  ["),
        "column_name",
        F.lit("] "),
        F.upper("data_type"),
        F.when(F.col("data_type").isin(LENGTH_TYPES), length).when(F.col("data_type").isin(SCALE_TYPES), digits).otherwise(none),
        F.when(F.col("is_identity"), " IDENTITY").otherwise(none),
        F.when(~F.col("is_nullable"), " NOT NULL").otherwise(none),
        F.when(F.col("is_primary_key") == 1, " PRIMARY KEY").otherwise(none),
    )


def ddl_lines(metadata: DataFrame) -> DataFrame:
    """``schema_name, table_name, part, ordinal, line``: one CREATE TABLE per table, a row per line.

    The first and last line come from an aggregate and the comma from the
    table's last ordinal, so no table is gathered in one row.
    """
    keys = ["schema_name", "table_name"]
    ends = metadata.groupBy(*keys).agg(F.max(F.struct("ordinal", "column_name")).alias("_last"))
    body = metadata.join(ends, keys).select(
        *keys,
        F.lit(1).alias("part"),
        F.col("ordinal"),
        F.concat(
            column_definition(),
            F.when((F.col("ordinal") == F.col("_last.ordinal")) & (F.col("column_name") == F.col("_last.column_name")), "").otherwise(","),
        ).alias("line"),
    )
    full = F.concat(F.lit("["), "schema_name", F.lit("].["), "table_name", F.lit("]"))
    zero = F.lit(0).cast("bigint").alias("ordinal")
    head = ends.select(
        *keys,
        F.lit(0).alias("part"),
        zero,
        F.concat(
            F.lit("-- Table: "), "schema_name", F.lit("."), "table_name", F.lit("\nCREATE TABLE "), full, F.lit(" (")
        ).alias("line"),
    )
    tail = ends.select(*keys, F.lit(2).alias("part"), zero, F.lit(");\n").alias("line"))
    body = body.withColumn("ordinal", F.col("ordinal").cast("bigint"))
    return head.unionByName(body).unionByName(tail).orderBy(*keys, "part", "ordinal", "line")


def session_metadata(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """The inputs of :func:`column_metadata` for the tables of a Spark database.

    Metadata only: as many rows as the catalog has columns.
    """
    tables, columns = [], []
    for number, table in enumerate(t for t in spark.catalog.listTables(database) if not t.isTemporary):
        tables.append((number, 0, table.name, False))
        full = f"`{database}`.`{table.name}`"
        described = {r.col_name: r for r in reversed(spark.sql(f"DESCRIBE TABLE {full}").collect())}
        for place, field in enumerate(spark.table(full).schema, 1):
            # The described type keeps the length of a varchar, the schema does not.
            kind, _, rest = described[field.name].data_type.partition("(")
            numbers = [int(x) for x in rest.rstrip(")").split(",")] if kind in LENGTH_TYPES + SCALE_TYPES else []
            length = numbers[0] if kind in LENGTH_TYPES and numbers else -1
            precision, scale = (numbers + [0, 0])[:2] if kind in SCALE_TYPES else (0, 0)
            comment = described[field.name].comment
            columns.append((number, place, field.name, kind, length, precision, scale, field.nullable, False, comment))
    fields = "object_id int, column_id int, column_name string, type_id string, max_length int, precision int, scale int, is_nullable boolean, is_identity boolean, column_description string"
    known = spark.createDataFrame(columns, fields)
    place = "object_id int, column_id int"
    return {
        "columns": known.drop("column_description"),
        "tables": spark.createDataFrame(tables, "object_id int, schema_id int, table_name string, is_ms_shipped boolean"),
        "schemas": spark.createDataFrame([(0, database)], "schema_id int, schema_name string"),
        "types": known.select("type_id", F.col("type_id").alias("data_type")).distinct(),
        "primary_keys": spark.createDataFrame([], place),
        "foreign_keys": spark.createDataFrame([], place + ", referenced_table string, referenced_column string"),
        "descriptions": known.select("object_id", "column_id", "column_description"),
    }
