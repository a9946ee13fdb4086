"""Document fingerprints from closed syncmers.

A k-mer is ``K`` consecutive words, its inner substrings are the ``S`` consecutive
words within it. It is chosen when its least inner substring, by hash, is the
first or the last. The choice looks at the k-mer alone, so the same passage gives
the same anchors wherever it stands, and a change touches only the anchors that
contain it. A document's fingerprint is the list of its anchors' hashes in order
of position, and the likeness of two fingerprints the share of distinct anchors
that they have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weftline.llm.common import SPACE_CLASS, documents, lower_ascii
from weftline.llm.registry import query

K = 5
S = 2
#: Rows in a range of ids on average, and the most ranges; only bounds of ranges reach the driver.
RANGE_ROWS = 1_000
RANGES = 4_096


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    trimmed = F.btrim(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE_CLASS}]+"))


def _chosen(inner: Column, size: Column) -> Column:
    """Anchors at each position of the hashes of inner substrings; ``size`` is the number of words."""
    edge = K - S

    def anchor(at: Column) -> Column:
        hashes = [F.get(inner, at + i) for i in range(edge + 1)]
        closed = F.least(hashes[0], hashes[-1]) <= F.least(*hashes[1:-1])
        return F.when(closed, F.hash(*hashes))

    return F.array_compact(F.transform(F.sequence(F.lit(0), size - K), anchor))


def anchors(text: Column) -> Column:
    """Hashes of the closed syncmers of a text, in order of position.

    A text of fewer than ``K`` words has one anchor, all of it; a null text, or
    one without words, has none. A-Z is lower-cased, words are what ASCII white
    space separates.
    """

    def of_words(words: Column) -> Column:
        inner = F.transform(
            F.sequence(F.lit(0), F.size(words) - S), lambda at: F.xxhash64(*[F.get(words, at + i) for i in range(S)])
        )
        return (
            F.when(F.size(words) == 0, F.array().cast("array<int>"))
            .when(F.size(words) < K, F.array(F.hash(words)))
            .otherwise(_let(inner, lambda hashes: _chosen(hashes, F.size(words))))
        )

    return _let(_words(text), of_words)


def likeness(first: Column, second: Column) -> Column:
    """Distinct anchors in common over distinct anchors in all; two empty lists are alike."""
    both = F.size(F.array_union(first, second))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(first, second)) / both)


def digest(found: Column) -> Column:
    return F.array_join(found.cast("array<string>"), " ")


def _range_of(number: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are below or at a number, by bisection; null counts as the least."""
    if not bounds:
        return F.lit(0)
    held = F.lit([float(b) for b in bounds])

    def halve(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"], 1)
        right = F.get(held, middle) <= number
        narrowed = F.struct(
            F.when(right, middle + 1).otherwise(state["low"]).alias("low"),
            F.when(right, state["high"]).otherwise(middle).alias("high"),
        )
        return F.when(state["low"] < state["high"], narrowed).otherwise(state)

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    return F.when(number.isNull(), F.lit(0)).otherwise(F.aggregate(steps, start, halve, lambda state: state["low"]))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs (doc_id, text, anchors)`` with next_text and next_anchors of the following document.

    Documents follow each other by descending id, null ids last, rows of one id
    by a hash of the text; the first follows the last. Rows are sorted in ranges
    of ids; the first row of each range is also given to the range before it, so
    that neighbours meet without one sort of everything.
    """
    rows = docs.count()
    ranges = min(RANGES, 1 + rows // RANGE_ROWS)
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(docs.approxQuantile("doc_id", shares, 0.25 / ranges))) if shares else []
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash"), F.col("text")]
    placed = (
        docs.withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("hash", F.xxhash64("text"))
        .withColumn("range", _range_of(F.col("doc_id").cast("double"), bounds))
    )
    # at most RANGES rows: the least hash of the greatest id in each range
    top = F.struct("doc_id", (-F.col("hash").cast("decimal(20,0)")).alias("hash"))
    first = placed.select("range", "doc_id", "hash").groupBy("range").agg(F.max(top).alias("top"))
    held = sorted(first.select("range", "top.doc_id", F.col("top.hash")).collect())
    # in descending order, the first row of a range is the guest of the range above it
    above = {held[i][0]: held[i + 1][0] if i + 1 < len(held) else held[0][0] for i in range(len(held))}
    guests = [(above[row["range"]], row["doc_id"], -int(row["hash"])) for row in held]
    schema = "guest_of int, guest_id long, guest_hash long"
    known = F.broadcast(docs.sparkSession.createDataFrame(guests, schema))
    same = placed["doc_id"].eqNullSafe(known["guest_id"]) & (placed["hash"] == known["guest_hash"])
    own = F.struct(F.col("range").alias("place"), F.lit(False).alias("guest"))
    visit = F.struct(F.col("guest_of").alias("place"), F.lit(True).alias("guest"))
    seats = F.explode(F.when(F.col("guest_of").isNull(), F.array(own)).otherwise(F.array(own, visit)))
    seated = placed.join(known, same, "left").select("doc_id", "text", "anchors", "hash", seats.alias("seat"))
    # plain columns, so that both columns of the next row come from one window and one exchange
    seated = seated.select("doc_id", "text", "anchors", "hash", "seat.place", "seat.guest")
    line = Window.partitionBy("place").orderBy("guest", *order)
    following = F.lead("text").over(line).alias("next_text"), F.lead("anchors").over(line).alias("next_anchors")
    return (
        seated.select("doc_id", "text", "anchors", "guest", *following)
        .where("not guest")
        .select("doc_id", "text", "anchors", "next_text", "next_anchors")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs (doc_id, text)`` and of its edited text, and likenesses.

    The edited text has the last half of its code points (rounded down) replaced
    by as many first ones of the next document, or all that it has. Null texts
    are empty. Repeated rows come out as often; an empty table has no rows.
    """
    found = docs.select("doc_id", "text", anchors(F.col("text")).alias("anchors"))
    half = F.shiftright(F.length("text"), 1)
    kept = F.substring(F.col("text"), F.lit(1), F.length("text") - half)
    edited = F.concat(kept, F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(found).withColumn("edited", edited).withColumn("edited_anchors", anchors(F.col("edited")))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest(F.col("anchors")).alias("fingerprint"),
        digest(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )


@query("op5_closed_syncmers")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document."""
    return fingerprints(documents(spark, sf_dir).select("doc_id", "text"))
