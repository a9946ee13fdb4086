"""Mixing sources to target weights with exact budgets.

Every row gets a hash-random key, so taking rows in key order samples a source
at random and the same way in every run. Keys are uniform, so equal ranges of
them are equal pieces: each source is cut into ranges, the sizes of the ranges
are added up, and a prefix sum over them tells which range holds the source's
budget. Only the rows of that one range are sorted and summed one by one; they
give the key at which the source is cut, and how much of the row there is taken.
All other rows compare their key with the cut of their source. So no source,
however large, is brought together, and rows are neither moved nor numbered.

A target above a source's size takes every row once and cuts in a second epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weftline.llm.common import SPACE_CLASS, WORD, documents, fresh, hex_long
from weftline.llm.registry import query
from weftline.session import cut

#: Fixed values of the production mix: weights of the sources in order, the total, and the most epochs.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
#: Rows that a range of keys holds on average.
RANGE_ROWS = 5_000


def size_of(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def random_key(seed: str) -> Column:
    """32 hexadecimal digits that depend on seed, id and text alone."""
    text = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))


def _tagged(source: Column) -> Column:
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``sizes (source, source_size)`` with weight and target.

    Sources by code point, null last, take the weights in turn. ``share`` of all
    sizes is split by weight; targets above ``epochs`` times their source stop
    there and what is left is split again among the others, until none is above.
    A round of splitting moves two numbers to the driver.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(w) for w in weights])
    # one row per source; the rank is the only thing that needs them in order
    ranked = sizes.withColumn("weight", F.get(turn, (F.row_number().over(order) - 1) % len(weights)).cast("double"))
    ranked = cut(ranked.withColumn("most", F.col("source_size") * F.lit(epochs)))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, F.lit(False)
    while True:
        held = ranked.agg(
            F.sum(F.when(full, F.col("most"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("weight")
        ).first()
        if not held["weight"]:
            break
        raised = (share * total - (held["full"] or 0)) / held["weight"]
        if raised <= level:
            break
        level = raised
        full = F.col("most") < F.col("weight") * F.lit(level)
    return ranked.withColumn("target", F.when(full, F.col("most")).otherwise(F.col("weight") * F.lit(level)).cast("double"))


def cuts(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """``source, source_size, target, rounds, cut_key, cut_words, cut_size`` per source.

    Rows of a source are taken ``rounds`` times whole; those with keys below
    ``cut_key`` once more, those with that key ``cut_words`` of their joint
    ``cut_size`` words. ``rows`` has source, size, key.
    """
    ranges = 1 + rows.count() // RANGE_ROWS
    digits = hex_long(F.substring("key", 1, 8))
    ranged = rows.withColumn("tag", _tagged(F.col("source"))).withColumn(
        "range", F.shiftright(digits * F.lit(ranges), 32)
    )
    pieces = ranged.groupBy("tag", "range").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("tag").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target").cast("bigint")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("tag", _tagged(F.col("source"))).withColumn("rounds", rounds.cast("int"))
    goals = goals.withColumn("rest", F.col("target").cast("bigint") - F.col("rounds") * F.col("source_size"))
    start = pieces.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    holding = (
        start.join(goals.select("tag", "rest"), "tag")
        .where("start < rest and rest <= start + n")
        .select("tag", "range", (F.col("rest") - F.col("start")).alias("left"))
    )
    keys = ranged.join(holding, ["tag", "range"]).groupBy("tag", "key").agg(
        F.sum("size").alias("cut_size"), F.first("left").alias("left")
    )
    inside = Window.partitionBy("tag").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    at = keys.withColumn("start", F.coalesce(F.sum("cut_size").over(inside), F.lit(0)))
    at = at.where("start < left and left <= start + cut_size").select(
        "tag", F.col("key").alias("cut_key"), (F.col("left") - F.col("start")).alias("cut_words"), "cut_size"
    )
    return goals.join(at, "tag", "left").select(
        "tag", "source_size", "target", "rounds", "cut_key", "cut_words", "cut_size"
    )


def _again() -> Column:
    """Words taken in the last, partial round."""
    size = F.col("size")
    part = F.floor(F.col("cut_words") * size / F.col("cut_size")).cast("bigint")
    return (
        F.when(F.col("cut_key").isNull(), F.lit(0))
        .when(F.col("key") < F.col("cut_key"), size)
        .when(F.col("key") == F.col("cut_key"), F.least(part, size))
        .otherwise(0)
    )


def plan(docs: DataFrame, seed: str = "mix", **mix) -> tuple[DataFrame, DataFrame]:
    """Narrow rows (doc_id, source, size, key) and the cut of every source.

    The rows are written once, so texts are read once however often sizes are used.
    """
    rows = cut(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), random_key(seed).alias("key")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return rows, cut(cuts(rows.select("source", "size", "key"), targets(sizes, **mix)))


def taken(docs: DataFrame, seed: str = "mix", **mix) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs (doc_id, source, text)``.

    Null texts have size 0; a null source is a source of its own. Rows with the
    same id and text share a key; should the cut fall on them, they share what
    is left, rounded down. An empty table has no rows.
    """
    rows, at = plan(docs, seed, **mix)
    joined = rows.withColumn("tag", _tagged(F.col("source"))).join(at, "tag")
    return joined.select(
        "doc_id", "size", "source_size", "target", (F.col("rounds") * F.col("size") + _again()).alias("taken")
    )


def mixed(docs: DataFrame, seed: str = "mix", **mix) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, once for every time they are taken.

    The row at which a source is cut has its first words only in the last round.
    Rows without words come once if the source is taken whole.
    """
    _, at = plan(docs.select("doc_id", "source", "text"), seed, **mix)
    own = {name: fresh(docs, f"mix_{name}") for name in ("tag", "size", "key", "copy")}
    cuts_of = at.select(F.struct(*at.columns).alias(fresh(docs, "mix_cut")), F.col("tag").alias(own["tag"]))
    held = cuts_of.columns[0]
    rows = docs.withColumn(own["tag"], _tagged(F.col("source"))).withColumn(own["key"], random_key(seed))
    rows = rows.join(cuts_of, own["tag"])
    key, cut_key = F.col(own["key"]), F.col(held)["cut_key"]
    size = F.when(key == cut_key, size_of(F.col("text")))
    part = F.floor(F.col(held)["cut_words"] * size / F.col(held)["cut_size"]).cast("int")
    # one entry per copy: -1 is the whole row, else the number of its first words
    whole = F.array_repeat(F.lit(-1), F.col(held)["rounds"])
    last = F.when(key < cut_key, F.array(F.lit(-1))).when((key == cut_key) & (part > 0), F.array(part))
    copies = F.concat(whole, F.coalesce(last, F.array().cast("array<int>")))
    rows = rows.withColumn(own["copy"], F.explode(copies))
    pieces = F.regexp_extract_all("text", F.lit(rf"[{SPACE_CLASS}]*{WORD}"), F.lit(0))
    shortened = F.array_join(F.slice(pieces, 1, F.col(own["copy"])), "")
    text = F.when(F.col(own["copy"]) < 0, F.col("text")).otherwise(shortened)
    return rows.withColumn("text", text).select(*docs.columns)


_CHECK = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS key
  FROM documents
), sources AS (
  SELECT source, source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)
), ordered AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
         sum(2 * source_size) OVER fill - 2 * source_size AS full_before,
         sum(weight) OVER () - (sum(weight) OVER fill - weight) AS weight_left
  FROM sources WINDOW fill AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), levels AS (
  SELECT max((total - full_before) / weight_left) AS level FROM ordered
  WHERE 2 * source_size >= weight * ((total - full_before) / weight_left)
), goals AS (
  SELECT source, source_size, CAST(least(2 * source_size, weight * level) AS DOUBLE) AS target
  FROM sources, levels
), running AS (
  SELECT sized.*, source_size, target,
         sum(size) OVER (PARTITION BY sized.source ORDER BY key) - size AS start
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(floor(floor(target) / greatest(source_size, 1)) * size
            + greatest(0, least(size, floor(target)
                - floor(floor(target) / greatest(source_size, 1)) * source_size - start)) AS BIGINT) AS taken
FROM running
"""


@query("op3_mix_sources", _CHECK)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document."""
    return taken(documents(spark, sf_dir).select("doc_id", "source", "text"))
