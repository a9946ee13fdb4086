"""Hard negatives by exact integer scores, looked up in tables of subset sums.

Vectors become whole numbers. A candidate is stored as bit planes: for each bit of
its components (two's complement) and each group of eight dimensions one byte that
says where the bit is set. For an anchor and a group of dimensions a table holds
the sums of all 256 subsets of its eight components, so that the part of the inner
product that comes from one plane and one group is the table's entry at that byte.
The planes are added from the highest, which counts negative, to the lowest, the
sum being doubled in between. Scores are exact; nothing is skipped or estimated.

Every anchor is scored against every row, in blocks: at most about ``ANCHORS`` of
them at a time are sent to the tasks, which keep the best few of each anchor and
return these alone. A block takes two passes: the first finds each anchor's
positives, whose scores bound the negatives that the second one looks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weftline.llm.common import cut_packed, table
from weftline.llm.registry import query
from weftline.session import cut

#: Anchors of one block, rows of one task, anchors whose tables are held at a time, rows scored at a time.
ANCHORS = 4_096
ROWS = 8_192
CHUNK = 128
TILE = 512
#: Components of this size or more (after scaling) would let scores leave 64 bits.
LARGEST = 1 << 24

_RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


class Block(NamedTuple):
    """Anchors in the order of their labels; ``values`` is anchors x groups x 8."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray


def packed(values: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes of whole numbers (rows x groups x 8) as bytes (rows x planes x groups)."""
    return np.stack(
        [np.packbits(((values >> p) & 1).astype(np.uint8), axis=2, bitorder="little")[..., 0] for p in range(planes)], 1
    )


def unpacked(planes: np.ndarray) -> np.ndarray:
    """The numbers whose bit planes are given; the highest plane is the sign."""
    bits = np.unpackbits(planes[..., None], axis=3, bitorder="little").astype(np.int64)
    weights = 1 << np.arange(planes.shape[1], dtype=np.int64)
    weights[-1] *= -1
    return np.einsum("npgb,p->ngb", bits, weights)


def subset_sums(values: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """Groups x 256 x anchors: the sum of the components that a byte names."""
    count, groups, _ = values.shape
    sums = np.zeros((groups, 256, count), dtype)
    for bit in range(8):
        half = 1 << bit
        sums[:, half : 2 * half] = sums[:, :half] + values[:, :, bit].T[:, None, :]
    return sums


def scores(planes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Inner products of rows (rows x planes x groups) and anchors (groups x 256 x anchors)."""
    total = np.zeros((planes.shape[0], sums.shape[2]), sums.dtype)
    part = np.empty_like(total)
    top = planes.shape[1] - 1
    for plane in range(top, -1, -1):
        for group in range(planes.shape[2]):
            np.take(sums[group], planes[:, plane, group], axis=0, out=part, mode="clip")
            total += part
        if plane == top:
            np.negative(total, out=total)
        if plane:
            total <<= 1
    return total


class Best:
    """The first ``k`` rows by score, then id, of each of ``count`` lists."""

    def __init__(self, count: int, k: int):
        self.k = k
        self.least = np.full(count, np.iinfo(np.int64).min)
        self.lists = self.scores = self.ids = np.zeros(0, np.int64)

    def add(self, lists: np.ndarray, found: np.ndarray, ids: np.ndarray) -> None:
        if not len(lists):
            return
        lists, found, ids = (np.concatenate(x) for x in ((self.lists, lists), (self.scores, found), (self.ids, ids)))
        order = np.lexsort((ids, -found, lists))
        lists, found, ids = lists[order], found[order], ids[order]
        starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
        place = np.arange(len(lists)) - np.repeat(starts, np.diff(np.r_[starts, len(lists)]))
        kept = place < self.k
        self.lists, self.scores, self.ids = lists[kept], found[kept], ids[kept]
        full = place == self.k - 1
        self.least[lists[full]] = found[full]


def _rows(batches: Iterator[pa.RecordBatch], planes: int, groups: int) -> Iterator[tuple]:
    """``vec_id, label, planes`` of each batch as arrays."""
    for batch in batches:
        if batch.num_rows:
            joined = b"".join(batch.column(2).to_pylist())
            bits = np.frombuffer(joined, np.uint8).reshape(batch.num_rows, planes, groups)
            yield batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), bits


def _tiles(block: Block, batches: Iterator[pa.RecordBatch], planes: int, groups: int, dtype, same: bool) -> Iterator[tuple]:
    """Scores of rows and anchors that share their label (``same``), or of all, tile by tile.

    Yields the anchors' slice, the ids and labels of the rows and rows x anchors scores.
    """
    cuts = np.flatnonzero(np.diff(block.labels)) + 1
    runs = list(zip(np.r_[0, cuts], np.r_[cuts, len(block.ids)])) if same else [(0, len(block.ids))]
    for ids, labels, bits in _rows(batches, planes, groups):
        for first, last in runs:
            chosen = np.flatnonzero(labels == block.labels[first]) if same else np.arange(len(ids))
            for start in range(first, last, CHUNK) if len(chosen) else ():
                part = slice(start, min(start + CHUNK, last))
                sums = subset_sums(block.values[part], dtype)
                for at in range(0, len(chosen), TILE):
                    tile = chosen[at : at + TILE]
                    yield part, ids[tile], labels[tile], scores(bits[tile], sums)


def _positives(sent, planes: int, groups: int, dtype, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(*sent.value)
        best = Best(len(block.ids), k)
        for part, ids, _, found in _tiles(block, batches, planes, groups, dtype, True):
            rows, columns = np.nonzero((found >= best.least[part]) & (ids[:, None] != block.ids[part]))
            best.add(columns + part.start, found[rows, columns].astype(np.int64), ids[rows])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.lists, best.scores, best.ids)], ["anchor", "score", "id"])

    return search


def _negatives(sent, planes: int, groups: int, dtype, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, low, high = sent.value
        block = Block(*anchors)
        ways = low.shape[1]
        best = Best(low.size, k)
        for part, ids, labels, found in _tiles(block, batches, planes, groups, dtype, False):
            other = labels[:, None] != block.labels[part]
            for way in range(ways):
                least = np.maximum(low[part, way], best.least[way::ways][part])
                rows, columns = np.nonzero(other & (found >= least) & (found <= high[part, way]))
                best.add((columns + part.start) * ways + way, found[rows, columns].astype(np.int64), ids[rows])
        out = best.lists // ways, (best.lists % ways).astype(np.int32), best.scores, best.ids
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["anchor", "way", "score", "id"])

    return search


def _packer(planes: int, groups: int, scale: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            values = np.zeros((batch.num_rows, groups * 8), np.int64)
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            # shorter vectors end in zeros
            values[np.arange(groups * 8) < sizes[:, None]] = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * scale)
            bits = packed(values.reshape(-1, groups, 8), planes)
            data = pa.array([row.tobytes() for row in bits], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data], ["vec_id", "label", "planes"])

    return pack


def _valid(rows: DataFrame, scale: int) -> DataFrame:
    vector = F.transform("embedding", lambda x: x.cast("double"))
    ids, labels = F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label")
    # not a number is larger than any number, so it fails as the infinities do
    fits = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x * scale) < LARGEST))
    return rows.select(ids, labels, vector.alias("vector")).where("vec_id is not null and label is not null").where(fits)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    block: int = ANCHORS,
) -> DataFrame:
    """Negatives of every anchor among ``rows (vec_id, label, embedding)``; ``anchors`` says which rows are anchors.

    A component x counts ``floor(scale * x)``; a score is the inner product, higher
    ones come first, ties by smaller id. An anchor's positives are its first
    ``positives`` rows of the same label and another id; its negatives for one of
    them the first ``negatives`` rows of other labels whose score is ``low`` to
    ``high`` per cent of the positive's, ends included.

    Rows with a null id, label, vector or component, or a component that is not
    finite or ``LARGEST`` or more after scaling, take no part. Shorter vectors
    count as if filled with zeros. Repeated rows count as often as they stand,
    but equal anchors are mined once. Other columns are left out. No anchors or
    no rows give no result.
    """
    spark = rows.sparkSession
    rows = _valid(rows, scale)
    extremes = F.min(F.array_min("vector")).alias("least"), F.max(F.array_max("vector")).alias("most")
    size = rows.agg(F.max(F.size("vector")).alias("size"), F.count("*").alias("n"), *extremes).first()
    groups = max(1, -(-(size["size"] or 0) // 8))
    least, most = (int(np.floor((size[c] or 0) * scale)) for c in ("least", "most"))
    planes = max(most, -least - 1).bit_length() + 1
    largest = groups * 8 * max(most, -least) ** 2
    dtype = np.dtype(np.int32 if 2 * largest < 1 << 31 else np.int64)
    held = cut_packed(rows.mapInArrow(_packer(planes, groups, scale), "vec_id long, label long, planes binary"))
    asked = cut(held.where(anchors).distinct())
    tasks = max(1, -(-size["n"] // ROWS))
    blocks = max(1, -(-asked.count() // block))
    dealt, out = F.pmod(F.xxhash64("vec_id", "label", "planes"), F.lit(blocks)), []
    for number in range(blocks):
        # one block of anchors is what the driver holds and sends
        got = sorted(map(tuple, asked.where(dealt == number).collect()), key=lambda row: (row[1], row[0], row[2]))
        if not got:
            continue
        ids, labels = (np.array([row[c] for row in got], np.int64) for c in (0, 1))
        bits = np.frombuffer(b"".join(bytes(row[2]) for row in got), np.uint8).reshape(len(got), planes, groups)
        own = (ids, labels, unpacked(bits))
        sent = spark.sparkContext.broadcast(own)
        search = _positives(sent, planes, groups, dtype, positives)
        found = held.repartition(tasks).mapInArrow(search, "anchor long, score long, id long")
        best = _first(found, ["anchor"], positives).collect()
        bounds = np.ones((len(got), positives), np.int64), np.zeros((len(got), positives), np.int64)
        chosen = []
        for row in best:
            place, score = (row["anchor"], row["rank"] - 1), row["score"]
            bounds[0][place], bounds[1][place] = -(-low * score // 100), high * score // 100
            chosen.append((row["anchor"], row["rank"] - 1, int(ids[row["anchor"]]), row["id"], score))
        sent = spark.sparkContext.broadcast((own, *bounds))
        search = _negatives(sent, planes, groups, dtype, negatives)
        found = held.repartition(tasks).mapInArrow(search, "anchor long, way int, score long, id long")
        named = spark.createDataFrame(chosen, "anchor long, way int, anchor_id long, positive_id long, positive_score long")
        first = _first(found, ["anchor", "way"], negatives).join(F.broadcast(named), ["anchor", "way"])
        out.append(
            cut(
                first.select(
                    "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
                )
            )
        )
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], _RESULT)


_CHECK = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""


@query("op12_hard_negatives", _CHECK)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth row; the labels of every seventh are shifted first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return mine(rows, F.col("vec_id") % 50 == 0)
