"""Quality classifier by importance resampling with hashed n-gram models.

Two generative models of a document as a bag of hashed words and word pairs are
counted over all documents: one over everything (raw), one over the labelled good
documents (target). A document's log importance weight adds the log ratios
target : raw of its n-grams. Documents are then sampled by Gumbel top-k: a Gumbel variate drawn
from a hash of the row is added to the weight, and the k largest keys stay.

What makes the ratio robust:

* n-grams are words with their case, runs of other signs, and pairs of
  neighbours. Of one that stands c times in a document 1 + ln c count, so that
  repetition tells but one repetitive document cannot speak for a word.
* The share of doubled words is one of ``CLASSES`` with counters of their own,
  outside the hash tables, and its ratio always counts: no word can mask it.
* Two hash tables, each with buckets for words apart from those for pairs; of an
  n-gram's two ratios the one nearer the target counts, so that sharing a bucket
  with a bad word does not condemn a rare one.
* ``PRIOR`` pseudo-documents pull rare buckets to ratio one, and ratios within a
  factor e of one are noise and say nothing. Else a long clean text would pay
  for, or hide behind, hundreds of small random terms.
* k is the number of documents whose key reaches the cut that separates
  labelled good from labelled bad documents best, so a clean corpus keeps all.

Raw counts cover all documents. The target model and the cut are fitted on at
most ``LABELLED`` labelled rows, those with the least hashes of their ids. Sent
to every task are these ids and the ratios: 2 tables of ``2 * BUCKETS + CLASSES`` floats.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from weftline.llm.common import documents, fresh, table, text_bytes
from weftline.llm.registry import query

#: Buckets for words, and as many for pairs, of each of the two tables, a power of two.
BUCKETS = 1 << 18
#: Classes of the share of doubled words.
CLASSES = 8
#: Damped counts are whole numbers of such parts, so that their sums do not depend on any order.
PARTS = 1024
PRIOR = 5.0
#: At most so many labelled rows are used to fit the target model and the cut.
LABELLED = 100_000
#: Log ratios nearer to zero than this are noise.
NOISE = 1.0
#: The lower, the sharper the sample follows the weights.
TEMPERATURE = 0.1
#: Width of the bins of keys among which the cut is chosen, and the lowest of them.
BIN = 1.0
LOWEST = -2000.0

_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_PAIR = 0xD6E8FEB86659FD93


def features(text: bytes, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct n-grams of a text, one row for each hash table, and their damped counts.

    Words come first, then pairs, the class of doubled words last.
    """
    tokens = _TOKEN.findall(text)
    if not tokens:
        return np.zeros((2, 0), np.int64), np.zeros(0, np.int64)
    hashes = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
    doubled = np.count_nonzero(hashes[1:] == hashes[:-1]) / len(tokens)
    words, of_words = np.unique(hashes, return_counts=True)
    pairs, of_pairs = np.unique((hashes[:-1] << np.uint64(32)) | hashes[1:], return_counts=True)
    # the high bits of a product depend on all of a pair only after its halves are mixed
    pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(_PAIR)
    pairs ^= pairs >> np.uint64(32)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    at = [np.concatenate([(words * np.uint64(mix)) >> shift, ((pairs * np.uint64(mix)) >> shift) + np.uint64(buckets)]) for mix in _MIX]
    at = np.pad(np.stack(at).astype(np.int64), ((0, 0), (0, 1)), constant_values=2 * buckets + int(CLASSES * doubled))
    counts = np.concatenate([of_words, of_pairs, [1]])
    return at, np.rint(PARTS * (1 + np.log(counts))).astype(np.int64)


def _counter(buckets: int):
    width = 2 * buckets + CLASSES

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((2, 2 * width), np.int64)
        for batch in batches:
            for text, good in zip(batch["text"], batch["good"]):
                at, counts = features(text, buckets)
                for row, offset in zip(at, (0, width)):
                    np.add.at(held[0], row + offset, counts)
                    if good:
                        np.add.at(held[1], row + offset, counts)
        at = np.flatnonzero(held[0])
        yield pd.DataFrame({"bucket": at, "raw": held[0, at], "target": held[1, at]})

    return count


def labelled(labels: DataFrame, rows: int = LABELLED) -> DataFrame:
    """``doc_id, good`` for at most ``rows`` labelled documents, marked for broadcast.

    Good means quality 1 and not toxic; a document with several labels is good
    if one of them says so. Labels without an id or a quality say nothing.
    """
    good = F.expr("quality = 1 and coalesce(toxic, 0) = 0").alias("good")
    said = labels.where("doc_id is not null and quality is not null").select("doc_id", good)
    one = said.groupBy("doc_id").agg(F.max("good").alias("good"))
    return F.broadcast(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))


def ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratios target : raw per table and bucket, counted over all documents.

    The result has ``2 * (2 * buckets + CLASSES)`` numbers whatever the input; without any good
    document all are 0. ``labels`` is what :func:`labelled` returns.
    """
    marked = docs.select("doc_id", text_bytes(F.col("text")).alias("text")).join(labels, "doc_id", "left")
    rows = marked.select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counted = rows.mapInPandas(_counter(buckets), "bucket long, raw long, target long")
    counted = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    targets = docs.join(labels.where("good"), "doc_id", "left_semi").count()
    if not targets:
        return np.zeros(2 * (2 * buckets + CLASSES), np.float32)
    held = np.zeros((2, 2 * (2 * buckets + CLASSES)))
    for row, name in zip(held, ("raw", "target")):
        row[counted["bucket"].to_numpy()] = counted[name].to_numpy() / PARTS
    expected = held[0] * (targets / docs.count())
    return np.log((held[1] + PRIOR) / (expected + PRIOR)).astype(np.float32)


def log_weight(spark: SparkSession, text: Column, ratio: np.ndarray) -> Column:
    """Log importance weight of a text; a null or empty text has no n-grams and weight 0."""
    sent = spark.sparkContext.broadcast(ratio)
    width = len(ratio) // 2
    buckets = (width - CLASSES) // 2

    @F.pandas_udf(DoubleType())
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        first, second = sent.value[:width], sent.value[width:]
        for texts in batches:
            out = []
            for text in texts:
                (one, two), counts = features(text, buckets)
                terms = np.maximum(first[one], second[two])
                said = (np.abs(terms) > NOISE) | (one >= 2 * buckets)
                out.append(float((terms * said).dot(counts / PARTS)))
            yield pd.Series(out, dtype="float64")

    # else the optimizer would compute it anew for a filter on it
    return weigh.asNondeterministic()(text_bytes(text))


def gumbel(seed: int, *columns: str) -> Column:
    """A standard Gumbel variate that depends on the row's values alone, so reruns agree."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(unit))


def cut_of(keys: DataFrame) -> float:
    """The key at and above which documents stay: the bin edge with fewest labels on the wrong side.

    ``keys`` has key and good. Counts per bin are collected, at most ``2 - LOWEST / BIN``
    of them. Without good and bad rows everything stays.
    """
    binned = F.greatest(F.lit(LOWEST), F.least(F.lit(0.0), F.floor(F.col("key") / BIN) * BIN))
    sides = F.sum(F.expr("cast(good as long)")).alias("good"), F.sum(F.expr("cast(not good as long)")).alias("bad")
    found = sorted(map(tuple, keys.select(binned.alias("bin"), "good").groupBy("bin").agg(*sides).collect()))
    best, edge, score = 0, float("-inf"), 0
    for at, (low, good, bad) in enumerate(found):
        # dropping this bin and all below: bad rows caught less good rows lost
        score += bad - good
        if score > best and at + 1 < len(found):
            best, edge = score, found[at + 1][0]
    return edge


def sampled(spark: SparkSession, docs: DataFrame, labels: DataFrame, seed: int = 0) -> tuple[DataFrame, str, str]:
    """The documents that stay, with log weight and Gumbel key, and the names of these two columns."""
    judges = labelled(labels)
    ratio = ratios(docs, judges)
    key = F.col("_weight") / TEMPERATURE + gumbel(seed, "doc_id", "text")
    fit = docs.select("doc_id", "text").join(judges, "doc_id")
    fit = fit.select("good", "doc_id", "text", log_weight(spark, F.col("text"), ratio).alias("_weight"))
    edge = cut_of(fit.select("good", key.alias("key")))
    weight, name = fresh(docs, "log_weight"), fresh(docs, "gumbel_key")
    weighed = docs.withColumn(weight, log_weight(spark, F.col("text"), ratio))
    keyed = weighed.withColumn(name, F.col(weight) / TEMPERATURE + gumbel(seed, "doc_id", "text"))
    return keyed.where(F.col(name) >= edge), weight, name


def resample(spark: SparkSession, docs: DataFrame, labels: DataFrame, seed: int = 0) -> DataFrame:
    """The documents that stay, with all their columns.

    Null or empty texts have weight 0 and stay. Repeated rows have equal keys and
    share their fate. Empty tables give none; empty labels keep everything.
    """
    kept, weight, key = sampled(spark, docs, labels, seed)
    return kept.drop(weight, key)


@query("op6_importance_resampling")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, with their weights and keys."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    kept, weight, key = sampled(spark, docs, table(spark, sf_dir, "labels"))
    return kept.select("doc_id", weight, key)
