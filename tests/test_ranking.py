import random

from pyspark.sql import Window, functions as F

from weftline.operators.impact import file_usages
from weftline.operators.ranking import nested_pages, numbered


def test_numbering_equals_a_window_with_one_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), rng.randint(0, 9), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(7)
    got = numbered(df, ["k"], [F.col("v").desc(), F.col("i")])
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy(F.col("v").desc(), "i")))
    both = got.join(want.select("i", "want"), "i")
    assert both.filter("rn <> want").count() == 0 and both.count() == 5000


def test_a_hot_group_is_numbered_in_several_pieces(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 200_003).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(df, ["k"], [F.col("v")])
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        assert got.agg(F.count("*"), F.count_distinct("rn"), F.min("rn"), F.max("rn")).first() == (200_000, 200_000, 1, 200_000)
        after = got.withColumn("next", F.lead("v").over(Window.orderBy("rn")))
        assert after.filter("next <= v").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_pages(spark):
    df = spark.createDataFrame([("a", i) for i in range(7)] + [("b", None)], "k string, v int")
    item = F.when(F.col("v").isNotNull(), F.struct("v"))
    pages = nested_pages(df, ["k"], [F.col("v")], item, "items", page_rows=3)
    got = {(r.k, r.page): [x.v for x in r["items"]] for r in pages.collect()}
    assert got == {("a", 0): [0, 1, 2], ("a", 1): [3, 4, 5], ("a", 2): [6], ("b", 0): []}


def test_small_and_large_groups_are_numbered_alike(spark):
    rows = [("hot" if i % 3 else f"k{i % 40}" if i % 5 else None, i * 7919 % 3001) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = numbered(df, ["k"], [F.col("v")], group_rows=50)
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy("v")))
    both = got.join(want.select("v", "want"), "v")
    assert both.filter("rn <> want").count() == 0 and both.count() == 3000


def test_nested_file_usages_leave_unshown_texts_unread(spark):
    columns = "project_id string, file_id string, line_number int, table_name string, column_name string, usage_type string, usage_id string"
    detail = spark.createDataFrame([("p", "f", 2, "t", "c", "read", "u2"), ("p", "f", 1, "t", "c", "join", "u1")], columns)
    row = file_usages(detail.withColumn("code_snippet", F.raise_error(F.lit("read")).cast("string"))).first()
    assert [u.line_number for u in row.usages] == [1, 2] and row.page == 0
