"""Near copies by SimHash and the true similarity of five-word shingles, all pairs of 0.8 or more.

Each text has a SimHash fingerprint of its five-word shingles. The multi-index search of
:mod:`weftline.llm.simhash` links fingerprints within two bits, and what it links is held
against each other on the complete sets of shingles: these are the first classes, in which
all the closest copies are. SimHash alone cannot find the others: at similarity 0.8 some ten
of 64 bits differ, and a search that wide meets a fixed share of all pairs. So further candidates
come from min-hash bands: a text has ``BANDS`` keys of ``ROWS`` minima each, and two texts of
similarity s share none with probability (1 - s^ROWS)^BANDS, 0.04 % at 0.8 and
less above. What counts is verified on the complete sets of shingles. Texts with
equal sets are one node, so copies never meet in pairs.

What is wanted are classes, so a candidate pair whose ends are in one class already
needs no verification. The nodes are sorted by key and by an order that is the
same in all bands, and after the classes by SimHash

1. in each bucket all are held against the first, which is the same node in most
   buckets of a group of near copies, so that there are few distinct pairs;
2. in each bucket one node of every class found so far is held against one other;
3. in each bucket that still has several classes, all nodes outside the largest
   class are held against all others: in blocks of about ``CROWD`` shingles, each pair in
   the first band that it shares, with links found in a block sparing others. A pair
   that agrees in fewer than ``AGREE`` of all minima is not verified; one at 0.8 does
   so with a probability of about one in a million.

So no bucket is too large and no link between candidates is lost, and a large group
of near copies costs about as many verifications as it has nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from weftline.llm import simhash
from weftline.llm.common import text_bytes
from weftline.llm.components import components
from weftline.llm.simhash import majority
from weftline.session import cut

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 5
#: Shingles of a block of nodes that are held against another.
CROWD = 1 << 19
#: Nodes of a bucket that are compared with one first node by one task.
FOLLOWERS = 2_048
#: Of BANDS * ROWS minima.
AGREE = 60
#: Bytes of sets that go to Spark at a time.
BATCH = 4 << 20
#: Shingles whose minima are taken at a time, to bound memory on long texts.
CHUNK = 1 << 11

_RNG = np.random.default_rng(20)
_XOR, _ODD = (_RNG.integers(1 << 64, size=(BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))
_ODD |= np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's shingles in order; words as for :func:`simhash.simhash`."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    parts = zip(*(words[i:] for i in range(SHINGLE))) if len(words) >= SHINGLE else [words]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, parts)), "<u8"))


def set_id(shingles: np.ndarray) -> int:
    """A checksum of the set, zero for the empty set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view("<i8")) if len(shingles) else 0


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of ``BANDS * ROWS`` hashes over a set that is not empty."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(shingles), CHUNK):
        mixed = (shingles[at : at + CHUNK] ^ _XOR) * _ODD
        np.minimum(least, mixed.min(axis=1), out=least)
    return least


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The ``BANDS`` keys of a set; the empty set has none."""
    if not len(shingles):
        return np.zeros(0, "<i8")
    return _keys(minima(shingles))


def _keys(least: np.ndarray) -> np.ndarray:
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), seed=i) for i, b in enumerate(bands)], "<u8").view("<i8")


def _give_back() -> None:
    """Let Arrow return freed memory to the system at once, as a worker outlives its task."""
    pa.set_memory_pool(pa.system_memory_pool())


def similar(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sets have similarity ``SIMILAR`` or more."""
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both >= SIMILAR * (len(one) + len(other) - both)


@F.pandas_udf(LongType())
def _ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([set_id(shingle_set(text)) for text in texts], dtype="int64")


def mark(text: Column) -> Column:
    """The checksum of the text's set of shingles; null is empty."""
    return _ids(text_bytes(text))


_SKETCH = StructType().add("fp", LongType()).add("sim", LongType()).add("n", IntegerType())


@F.pandas_udf(_SKETCH.add("keys", ArrayType(LongType())).add("minima", BinaryType()))
def _sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    _give_back()
    for texts in batches:
        rows = []
        for text in texts:
            shingles = shingle_set(text)
            least = minima(shingles) if len(shingles) else np.zeros(0, "<u8")
            keys = _keys(least).tolist() if len(shingles) else []
            # the minima spread evenly, so their last bits tell them apart
            rows.append((set_id(shingles), majority(shingles), len(shingles), keys, least.astype("<u2").tobytes()))
        yield pd.DataFrame(rows, columns=["fp", "sim", "n", "keys", "minima"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``fp, shingles`` of texts, in batches of about ``BATCH`` bytes."""

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(sets, pa.binary())], ["fp", "shingles"])

    _give_back()
    marks, sets, held = [], [], 0
    for batch in batches:
        for text in batch.column(0):
            shingles = shingle_set(text.as_py())
            marks.append(set_id(shingles))
            sets.append(shingles.tobytes())
            held += shingles.nbytes
            if held >= BATCH:
                yield made()
                marks, sets, held = [], [], 0
    yield made()


def _entries(nodes: DataFrame, *more: str) -> DataFrame:
    """A row per node and band: ``key, fp, n`` and other columns."""
    return nodes.select("fp", "n", *more, F.explode("keys").alias("key"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b`` of rows ``key, fp, n`` in order: the first of a key and each that follows.

    Who has not the size to be similar stands alone (``a`` is ``b``), as do the first and
    the last row of a task, whose keys may go on in other tasks.
    """
    key, first, size, last = None, None, 0, None
    for batch in batches:
        out: list[tuple[int, int]] = []
        for k, fp, n in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if k != key:
                if key is None:
                    out.append((fp, fp))
                key, first, size = k, fp, n
            elif min(n, size) >= SIMILAR * max(n, size):
                out.append((first, fp))
            else:
                out += [(first, first), (fp, fp)]
            last = fp
        columns = list(zip(*out)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64())] * 2, ["a", "b"])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similar ``a, b`` of rows ``a, part, b, shingles`` in order; the row without ``b`` has the set of ``a``."""
    _give_back()
    own = np.zeros(0, "<u8")
    for batch in batches:
        ones, others = [], []
        for place in range(batch.num_rows):
            b, shingles = batch.column(2)[place].as_py(), np.frombuffer(batch.column(3)[place].as_buffer(), "<u8")
            if b is None:
                own = shingles.copy()
            elif similar(own, shingles):
                ones.append(batch.column(0)[place].as_py())
                others.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ones, others)], ["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``a, b`` of distinct pairs whose sets are similar. A set goes once to each part of its followers, not to each pair."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("parts"))
    named = sets.withColumnRenamed("fp", "b")
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")
    followers = pairs.join(parts, "a").join(named, "b").select("a", part, "b", "shingles")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    heads = parts.join(sets.withColumnRenamed("fp", "a"), "a").select("a", each, F.lit(None).cast("long").alias("b"), "shingles")
    rows = heads.unionByName(followers).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_held, "a long, b long")


class _Classes:
    """Which classes of a block are one."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def of(self, item: int) -> int:
        while item in self.above:
            item = self.above[item]
        return item

    def join(self, one: int, other: int) -> None:
        one, other = self.of(one), self.of(other)
        if one != other:
            self.above[one] = other


def _block(key: int, rows: list[tuple]) -> Iterator[tuple[int, int]]:
    """Links of a block; ``rows`` are ``outside, fp, class, keys, minima, shingles``.

    Rows that are ``outside`` the bucket's largest class are held against all that are not marked so.
    Nodes outside stand on both sides, so of these pairs the one in ascending order counts.
    """
    others = [row for row in rows if not row[0]]
    if not others:
        return
    keys = np.array([row[3] for row in others], np.int64)
    least = np.frombuffer(b"".join(row[4] for row in others), "<u2").reshape(-1, BANDS * ROWS)
    sizes = np.array([len(row[5]) // 8 for row in others])
    also_outside = {row[1] for row in rows if row[0]}
    classes = _Classes()
    for outside, fp, own, own_keys, own_least, shingles in rows:
        if not outside:
            continue
        same = keys == np.array(own_keys, np.int64)
        agree = (least == np.frombuffer(own_least, "<u2")).sum(axis=1)
        size = len(shingles) // 8
        fit = (agree >= AGREE) & (np.minimum(sizes, size) >= SIMILAR * np.maximum(sizes, size))
        # the first band that the two share is where they are held together
        fit &= keys[np.arange(len(keys)), same.argmax(axis=1)] == key
        places = np.flatnonzero(fit)
        held = np.frombuffer(shingles, "<u8")
        for place in places[np.argsort(-agree[places], kind="stable")]:
            _, other, theirs, _, _, more = others[place]
            if other == fp or other in also_outside and other < fp or classes.of(own) == classes.of(theirs):
                continue
            if similar(held, np.frombuffer(more, "<u8")):
                classes.join(own, theirs)
                yield fp, other


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows ``key, x, y, outside, fp, class, keys, minima, shingles`` in order; a block shares the first three."""
    _give_back()
    block, rows = None, []

    def done() -> pa.RecordBatch:
        columns = list(zip(*_block(block[0], rows))) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns))):
            if row[:3] != block:
                if rows:
                    yield done()
                block, rows = row[:3], []
            rows.append(row[3:])
    if rows:
        yield done()


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the ``class`` that ``links`` give them; a node without links is its own."""
    roots = components(links).select(F.col("node").alias("fp"), "root")
    return nodes.join(roots, "fp", "left").withColumn("class", F.coalesce("root", "fp")).drop("root")


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The ``a, b`` of ``pairs`` that ``links`` have not brought into one class."""
    roots = cut(components(links))
    of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("_ra"))
    of_b = roots.select(F.col("node").alias("b"), F.col("root").alias("_rb"))
    known = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    return known.where(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).select("a", "b")


def _between_classes(labelled: DataFrame) -> DataFrame:
    """Distinct ``a, b``: in each bucket one node of a class, and one of each other class."""
    least = F.min(F.struct(F.xxhash64("fp", F.lit(1)).alias("h"), "fp", "n")).alias("one")
    ones = _entries(labelled, "class").groupBy("key", "class").agg(least)
    heads = ones.groupBy("key").agg(F.count("*").alias("classes"), F.min("one").alias("head")).where("classes > 1")
    # a row per band, which Spark counts as one per node: such a table must not be broadcast
    both = ones.join(heads.drop("classes").hint("merge"), "key").where("one.fp <> head.fp")
    both = both.where(F.least("one.n", "head.n") >= F.lit(SIMILAR) * F.greatest("one.n", "head.n"))
    return both.select(F.col("head.fp").alias("a"), F.col("one.fp").alias("b")).distinct()


def _rest(labelled: DataFrame, sets: DataFrame, crowd: int) -> DataFrame:
    """Links between the classes that still meet in a bucket, by all pairs of nodes of different ones."""
    entries = _entries(labelled, "class")
    counted = entries.groupBy("key", "class").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    largest = F.max_by(F.struct("class", "n"), F.struct("c", "class")).alias("largest")
    buckets = counted.groupBy("key").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), largest).where("classes > 1")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / crowd)).cast("int").alias("ys")
    outer = F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("largest.n")) / crowd)).cast("int").alias("xs")
    buckets = buckets.select("key", F.col("largest.class").alias("largest"), outer, blocks)
    met = cut(entries.join(buckets.hint("merge"), "key").drop("n"))

    def dealt(into: str, by: int) -> Column:
        return F.pmod(F.xxhash64("fp", F.lit(by)), F.col(into)).cast("int")

    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    place = ["key", "x", "y", "outside", "fp", "class"]
    inside = met.withColumn("x", each("xs")).withColumn("y", dealt("ys", 2)).withColumn("outside", F.lit(False))
    outside = met.where("class <> largest").withColumn("x", dealt("xs", 3)).withColumn("y", each("ys")).withColumn("outside", F.lit(True))
    rows = inside.select(*place).unionByName(outside.select(*place))
    # a node has as many rows here as its buckets have blocks
    rows = rows.hint("merge").join(labelled.select("fp", "keys", "minima"), "fp").join(sets, "fp").select(*place, "keys", "minima", "shingles")
    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_blocks, "a long, b long")


def _by_simhash(nodes: DataFrame) -> DataFrame:
    """Distinct ``a, b`` to verify: nodes whose SimHash fingerprints are equal or linked within two bits.

    One node stands for a fingerprint, so equal ones do not meet in pairs; the linked ones are few,
    as :func:`weftline.llm.simhash.links` lists pairs of small buckets and a star for each file of the large ones.
    """
    filled = nodes.where("n > 0").select("fp", "sim", "n")
    heads = cut(filled.groupBy("sim").agg(F.min(F.struct("fp", "n")).alias("head")))
    equal = filled.join(heads, "sim").select(F.col("head.fp").alias("a"), F.col("head.n").alias("an"), F.col("fp").alias("b"), F.col("n").alias("bn"))
    linked = simhash.links(heads.select(F.col("sim").alias("fp")))
    one = heads.select(F.col("sim").alias("a"), F.col("head").alias("one"))
    other = heads.select(F.col("sim").alias("b"), F.col("head").alias("other"))
    between = linked.join(one, "a").join(other, "b").select(
        F.col("one.fp").alias("a"), F.col("one.n").alias("an"), F.col("other.fp").alias("b"), F.col("other.n").alias("bn")
    )
    pairs = equal.unionByName(between).where("a <> b")
    return pairs.where(F.least("an", "bn") >= F.lit(SIMILAR) * F.greatest("an", "bn")).select("a", "b").distinct()


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, sim, n, keys, minima`` for every row of ``docs (doc_id, text)``."""
    sketches = docs.select("doc_id", _sketches(text_bytes(F.col("text"))).alias("s"))
    return cut(sketches.select("doc_id", "s.*"))


def links(docs: DataFrame, sketches: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges ``a, b`` between the marks of near copies among ``docs (doc_id, text)``, whose sketches are given.

    Their components are those of all candidate pairs that are similar. Null and
    empty texts have no shingles and no links.
    """
    nodes = cut(sketches.groupBy("fp").agg(*[F.first(c).alias(c) for c in ("doc_id", "sim", "n", "keys", "minima")]))
    near = cut(_by_simhash(nodes))
    ordered = ["key", F.xxhash64("fp"), "fp"]
    ranged = _entries(nodes).repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    pairs = cut(ranged.select("key", "fp", "n").mapInArrow(_pairs, "a long, b long").distinct())
    ends = pairs.unionByName(near)
    meet = ends.select(F.col("a").alias("fp")).unionByName(ends.select(F.col("b").alias("fp"))).distinct()
    met = cut(nodes.join(meet, "fp", "left_semi"))
    ids = met.select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi").select(text_bytes(F.col("text")).alias("text"))
    # other texts with these ids do no harm
    sets = texts.mapInArrow(_sets, "fp long, shingles binary")
    sets = cut(sets.groupBy("fp").agg(F.first("shingles").alias("shingles")))
    found = cut(_verified(near, sets))
    found = found.unionByName(cut(_verified(_apart(pairs.where("a <> b"), found), sets)))
    found = found.unionByName(cut(_verified(_between_classes(_labelled(met, found)), sets)))
    labelled = cut(_labelled(met, found))
    return found.unionByName(cut(_rest(labelled, sets, crowd)))


def one_of_each(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the row with the least doc_id stays."""
    sketches = sketched(docs)
    rows = sketches.select("doc_id", "fp")
    return simhash.one_of_each(docs, crowd, mark, lambda _, held: links(docs, sketches, held), rows)
