"""What a level of an iteration leaves on disk."""

import time

from pyspark.sql import functions as F

from weftline.session import cut_level


def shuffled(spark):
    """Names of the shuffle files that the session holds."""
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.length())]
    return {n for n in names if n.startswith("shuffle_")}


def test_a_written_level_gives_its_shuffles_back(spark):
    before = shuffled(spark)
    rows = spark.range(1000).select((F.col("id") % 7).alias("k")).repartition(3, "k")
    level = cut_level(rows.groupBy("k").agg(F.count("*").alias("n")))
    made = shuffled(spark) - before
    assert {r["k"]: r["n"] for r in level.collect()} == {k: 143 if k < 6 else 142 for k in range(7)}
    until = time.time() + 10
    while time.time() < until and made & shuffled(spark):
        # the next level asks for it
        cut_level(level.select("n"))
        time.sleep(0.3)
    assert not made & shuffled(spark)


def test_a_level_is_packed(spark):
    level = cut_level(spark.range(1000).select(F.lit("some/long/path").alias("path")))
    assert level.count() == 1000 and level.inputFiles() and all(name.endswith(".zstd.parquet") for name in level.inputFiles())
