"""SimHash fingerprints and near-duplicate classes by multi-index hashing.

A fingerprint has one bit per position in which more than half of the shingle
hashes have a one. Two fingerprints within two differing bits are linked.

Search: the 64 bits are cut into two segments. Two fingerprints within two bits
differ by at most one bit in the high segment or by none in the low one, so each
looks up the Hamming ball of radius one (33 values) around its high segment and
its low segment itself (one value) in a table of all segments, and complete
distances are verified on what is found. Buckets hold distinct fingerprints, so
exact copies never meet in pairs. A bucket of more than ``BUCKET`` fingerprints
is not paired at all: everything that looks into it goes to the exact way beside
it, where each fingerprint is filed under all 65 values within one bit. Two
values within two bits share such a file, everything in a file is within two
bits, and a file has at most 65 fingerprints; linking each to the least of its
file keeps every class whole. So work grows with the number of fingerprints,
not with the square of a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType

from weftline.llm.common import documents, fresh, is_empty, text_bytes
from weftline.llm.components import components
from weftline.llm.registry import query
from weftline.session import cut

SHINGLE = 3
DISTANCE = 2
#: Buckets with more distinct fingerprints go the exact way.
BUCKET = 16
#: Shingles whose bits are counted at a time, to bound memory on long texts.
CHUNK = 1 << 16

_LOW = 0xFFFFFFFF


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer; a text without words has zero.

    A-Z is lower-cased, words are what ASCII white space separates, and a text
    of fewer than ``shingle`` words is one shingle.
    """
    words = text.lower().split()
    if not words:
        return 0
    parts = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    return majority(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, parts)), "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are one in more than half of the hashes, as a signed integer; zero for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        chunk = hashes[at : at + CHUNK]
        ones += np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([simhash(text) for text in texts], dtype="int64")


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column; null is empty and has fingerprint zero."""
    return _fingerprints(text_bytes(text))


def _segments() -> Column:
    """Keys of the segment table: the high half as it is, the low half marked by bit 32."""
    high = F.shiftrightunsigned("fp", 32)
    return F.array(high, F.col("fp").bitwiseAND(F.lit(_LOW)).bitwiseOR(F.lit(1 << 32)))


def _probes() -> Column:
    """Keys to look up: the ball of radius one around the high half, and the low half."""
    masks = F.array(*[F.lit(m).cast("bigint") for m in [0] + [1 << i for i in range(32)]])
    high = F.shiftrightunsigned("fp", 32)
    return F.concat(F.transform(masks, lambda m: high.bitwiseXOR(m)), F.slice(_segments(), 2, 1))


def _ball() -> Column:
    """The 65 values within one bit of a fingerprint."""
    signed = [0] + [(1 << i) - (1 << 64 if i == 63 else 0) for i in range(64)]
    masks = F.array(*[F.lit(m).cast("bigint") for m in signed])
    return F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))


def links(fingerprints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges ``a, b`` whose components are those of all pairs within two differing bits.

    ``fingerprints`` has distinct values in ``fp``. Pairs from small buckets are
    listed; for large buckets each fingerprint is linked to the least one filed
    under the same value, which leaves the same components.
    """
    entries = fingerprints.select("fp", F.explode(_segments()).alias("key"))
    first = Window.partitionBy("key").orderBy("fp")
    buckets = (
        entries.withColumn("rn", F.row_number().over(first))
        .where(F.col("rn") <= bucket + 1)
        .groupBy("key")
        .agg(F.collect_list("fp").alias("members"))
        .withColumn("members", F.when(F.size("members") <= bucket, F.col("members")))
    )
    # Spark takes the 34 probes of a fingerprint, and its two entries, for one row: neither side must be broadcast for that
    looked = fingerprints.select("fp", F.explode(_probes()).alias("key")).join(buckets.hint("merge"), "key")
    near = F.filter("members", lambda m: (m > F.col("fp")) & (F.bit_count(m.bitwiseXOR(F.col("fp"))) <= DISTANCE))
    found = looked.select("fp", F.col("members").isNull().alias("crowded"), near.alias("near"))
    found = cut(found.where("crowded or size(near) > 0"))
    listed = found.where("not crowded").select(F.col("fp").alias("a"), F.explode("near").alias("b"))
    filed = found.where("crowded").select("fp").distinct().select("fp", F.explode(_ball()).alias("key"))
    shared = filed.groupBy("key").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where("size(all) > 1")
    # written, as lists of pairs too are larger than Spark takes them for, and who joins them must know
    return cut(listed.unionByName(shared.select("a", F.explode("all").alias("b")).where("a <> b")).distinct())


def classes(rows: DataFrame, bucket: int = BUCKET, linked: Callable[[DataFrame, int], DataFrame] = links) -> DataFrame:
    """``fp, component_id, keep_fp`` for each fingerprint of ``rows (doc_id, fp)``; ``linked`` gives the edges.

    ``component_id`` is the least doc_id of the class (null ids only count where
    there is no other), ``keep_fp`` the fingerprint of that document.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    nodes = cut(rows.groupBy("fp").agg(F.min(order).alias("least")))
    roots = components(linked(nodes.select("fp"), bucket)).select(F.col("node").alias("fp"), "root")
    # only linked fingerprints are brought together; a lone one is its own class
    together = nodes.join(roots, "fp")
    least = together.groupBy("root").agg(F.min("least").alias("least"))
    joined = roots.join(least, "root").select("fp", F.col("least").alias("of_class"))
    best = F.coalesce("of_class", "least")
    return nodes.join(joined, "fp", "left").select(
        "fp", best["doc_id"].alias("component_id"), best["fp"].alias("keep_fp")
    )


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs (doc_id, text)``.

    Repeated rows come out as often as they stand in ``docs``; null texts are
    empty; an empty table gives no rows. Only identifiers and fingerprints move.
    """
    rows = cut(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")))
    return rows.join(cut(classes(rows, bucket)), "fp").select("doc_id", "fp", "component_id")


def one_of_each(
    docs: DataFrame,
    bucket: int = BUCKET,
    mark: Callable[[Column], Column] = fingerprint,
    linked: Callable[[DataFrame, int], DataFrame] = links,
    rows: DataFrame | None = None,
) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the row with the least doc_id stays.

    All columns of ``docs`` are returned as they are. Where several rows of a
    class share the least doc_id (or have none), one of them stays. ``mark`` gives
    a text's fingerprint and ``linked`` the edges between fingerprints; ``rows (doc_id, fp)``
    are the fingerprints of all documents where they are known already.
    """
    if rows is None:
        rows = cut(docs.select("doc_id", mark(F.col("text")).alias("fp")))
    kept = classes(rows, bucket, linked).select(F.col("component_id").alias("doc_id"), F.col("keep_fp").alias("fp")).distinct()
    repeated = cut(rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"))
    kept = cut(kept)
    single = docs.join(kept.where("doc_id is not null").select("doc_id"), "doc_id", "left_semi")
    if is_empty(repeated):
        return single.select(*docs.columns)
    # ids that stand for several rows: choose among them by fingerprint, then any one row
    fp, rn = fresh(docs, "fp"), fresh(docs, "rn")
    again = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated["doc_id"]), "left_semi")
    again = again.withColumn(fp, mark(F.col("text")))
    meant = kept.select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"))
    again = again.join(meant, again["doc_id"].eqNullSafe(meant["_id"]) & (again[fp] == meant["_fp"]), "left_semi")
    one = Window.partitionBy("doc_id", fp).orderBy("text")
    again = again.withColumn(rn, F.row_number().over(one)).where(F.col(rn) == 1)
    single = single.join(repeated, "doc_id", "left_anti")
    return single.select(*docs.columns).unionByName(again.select(*docs.columns))


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
