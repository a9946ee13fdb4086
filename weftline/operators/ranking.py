"""Row numbers and nested lists for groups of any size.

A plain ``row_number`` sorts each group in one task, and ``collect_list`` builds
each group in one row. Here a group that holds a large share of all rows is
split by range for numbering, and nested lists come in pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.session import cut

PAGE_ROWS = 10_000
#: A group with more rows than this is numbered in pieces.
GROUP_ROWS = 100_000


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn", group_rows: int = GROUP_ROWS) -> DataFrame:
    """``row_number() over (partition by keys order by order)``; ``order`` must be total.

    Rows are written and the rows of each group counted. Groups of up to ``group_rows``
    are sorted each in one task, after one shuffle; larger ones go by ranges. There is at most one large
    group per ``group_rows`` rows: few enough to broadcast.
    """
    rows = cut(df)
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > group_rows)
    large = cut(counted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if not large.take(1):
        return rows.withColumn(name, number)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    small = rows.join(F.broadcast(large), same, "left_anti").withColumn(name, number)
    return small.unionByName(_numbered_by_range(rows.join(F.broadcast(large), same, "left_semi"), keys, order, name))


def _numbered_by_range(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """The same for groups of any size.

    Rows are range-partitioned by key and order and materialised, so that a
    recomputed task cannot see other range bounds. Each (range, group) piece is
    numbered on its own and shifted by the rows of the group in earlier ranges.
    Only the first group of a range can have such rows, so there is at most one
    shift per range: few enough to broadcast whatever the size of ``df``.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id())
    ranged = cut(ranged)
    pieces = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = pieces.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_range").alias("_r"),
        F.sum("_n").over(earlier).alias("_shift"),
    ).filter("_shift > 0")
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy("_range", *keys).orderBy(*order)
    return (
        ranged.join(F.broadcast(shifts), same, "left")
        .withColumn(name, F.row_number().over(within) + F.coalesce("_shift", F.lit(0)))
        .drop("_range", "_r", "_shift", *[f"_k{i}" for i in range(len(keys))])
    )


def nested_pages(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    item: Column,
    name: str,
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """``keys, page, <name>``: the ordered items of each group, ``page_rows`` to a list.

    Pages are numbered from 0 and hold consecutive items; a group that fits one
    page comes out as one row. Rows whose item is null keep their group but add
    nothing to its list.
    """
    rows = numbered(df, keys, order, "_rn").withColumn("_item", item)
    page = F.floor((F.col("_rn") - 1) / F.lit(page_rows)).cast("int")
    held = F.collect_list(F.when(F.col("_item").isNotNull(), F.struct("_rn", "_item")))
    return (
        rows.withColumn("page", page)
        .groupBy(*keys, "page")
        .agg(F.transform(F.array_sort(held), lambda x: x["_item"]).alias(name))
    )
