"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of ten consecutive words of the benchmark items; an
item with fewer words is one pattern. Patterns of one length are searched
together. A block is the last two words under the search position (one word for
patterns of one word):

* the shift table says how far the position may move before a known block can
  end there; a block that stands in no pattern lets it jump over the rest;
* a block that ends some pattern leads to its bucket, which lists the patterns
  that end with it;
* comparing all words of the pattern with the text confirms an occurrence.

Documents stay where they are: the patterns are sent to them. They are sent in
packs of about ``PACK`` windows, measured beforehand, so a benchmark of any size is
searched in several passes whose findings are merged per document. An item with more
windows is cut into parts that overlap by all words of a window but one. A pack is
kept as numbers: its words once each, its texts as an array of word numbers, a
pattern as a place in that array; a Python worker compiles it once for all its tasks.
"""

from __future__ import annotations

import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from weftline.llm.common import documents, fresh, kept, lower_ascii, table, text_bytes
from weftline.llm.registry import query
from weftline.session import cut

WINDOW = 10
#: About as many windows one pass sends to the tasks.
PACK = 500_000

#: Fixed value: a word as the contract says it, for Spark.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Every byte that is no part of a word becomes a space, A-Z become small letters.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

FOUND = StructType(
    [
        StructField("n_words", LongType()),
        StructField("spans", ArrayType(ArrayType(LongType()))),
        StructField("items", ArrayType(StringType())),
    ]
)


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and signs beyond ASCII, with A-Z lower-cased."""
    return text.translate(_WORDS).split()


class Patterns:
    """Shift table and buckets for patterns of ``length`` words each.

    ``starts`` are the places of the patterns in ``held``, the word numbers of all
    items; ``owners`` says whose each is. One table has both facts about a block: how
    far to move if positive, else, negated, its bucket.
    """

    def __init__(self, length: int, held: array, starts: array, owners: array):
        self.length, self.held = length, held
        self.block = min(2, length)
        self.jump = length - self.block + 1
        self.starts, self.owners = starts, owners
        self.moves: dict[int, int] = {}
        self.buckets = [array("q")]
        for pattern, start in enumerate(starts):
            for end in range(self.block, length):
                block = self._block(held, start + end)
                move = self.moves.get(block, self.jump)
                self.moves[block] = min(length - end, move)
            last = self._block(held, start + length)
            bucket = self.moves.get(last, self.jump)
            if bucket > 0:
                self.buckets.append(array("q"))
                bucket = self.moves[last] = 1 - len(self.buckets)
            self.buckets[-bucket].append(pattern)

    def _block(self, numbers, end: int) -> int:
        return numbers[end - 2] << 32 | numbers[end - 1] if self.block == 2 else numbers[end - 1]

    def search(self, text: list[bytes], numbers: dict[bytes, int]) -> Iterator[tuple[int, int]]:
        """Where occurrences start, from left to right, and the number of the item."""
        moves, jump, length, block, number = self.moves, self.jump, self.length, self.block, numbers.get
        at, last = length, len(text)
        while at <= last:
            # a word that is in no item has the number -1, and no block with it is known
            ending = number(text[at - 1], -1)
            if block == 2 and ending >= 0:
                ending |= number(text[at - 2], -1) << 32
            move = moves.get(ending, jump)
            if move > 0:
                at += move
                continue
            window = array("q", [number(word, -1) for word in text[at - length : at]])
            for pattern in self.buckets[-move]:
                start = self.starts[pattern]
                if self.held[start : start + length] == window:
                    yield at - length, self.owners[pattern]
            at += 1


class Pack:
    """Items ``(id, text)`` as word numbers, and their patterns grouped by length."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW):
        self.names: list[str] = []
        self.numbers: dict[bytes, int] = {}
        held, owned = array("q"), {}
        by_length: dict[int, tuple[array, array]] = defaultdict(lambda: (array("q"), array("q")))
        for name, text in items:
            found = words(text)
            length = min(window, len(found))
            if not length:
                continue
            owner = owned.setdefault(name, len(owned))
            starts, owners = by_length[length]
            starts.extend(range(len(held), len(held) + len(found) - length + 1))
            owners.extend([owner] * (len(found) - length + 1))
            held.extend(self.numbers.setdefault(word, len(self.numbers)) for word in found)
        self.names = list(owned)
        self.groups = [Patterns(length, held, *places) for length, places in sorted(by_length.items())]


def compile_patterns(items: Iterable[tuple[str, bytes]], window: int = WINDOW) -> Pack:
    """The items ``(id, text)`` for searching. Items without words have no pattern."""
    return Pack(items, window)


def find(text: bytes, pack: Pack) -> tuple[int, list[list[int]], list[str]]:
    """Number of words, merged spans of words inside occurrences, and the items that occur."""
    found = words(text)
    starts = []
    items: set[int] = set()
    for group in pack.groups:
        for start, owner in group.search(found, pack.numbers):
            starts.append((start, start + group.length))
            items.add(owner)
    return len(found), merge(starts), sorted(pack.names[owner] for owner in items)


def merge(spans: Iterable[Iterable[int]]) -> list[list[int]]:
    """Overlapping or touching spans made one."""
    out: list[list[int]] = []
    for start, end in sorted(map(tuple, spans)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _packs(items: DataFrame, window: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items, long ones in overlapping parts, in lists of about ``PACK`` windows or fewer each."""
    found = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(_WORD), F.lit(0))
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), found.alias("words"))
    named = named.where(F.size("words") > 0)
    part = max(1, PACK // 4)
    # a part starts where a window can: the last one is never shorter than a window, if the item is not
    first = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(part))
    parts = named.select("name", "words", F.explode(first).alias("first")).select(
        "name", F.array_join(F.slice("words", F.col("first") + 1, F.lit(part + window - 1)), " ").alias("text")
    )
    held = cut(parts.distinct().withColumn("windows", F.greatest(F.size(F.split("text", " ", -1)) - window + 1, F.lit(1))))
    windows = held.agg(F.sum("windows")).first()[0] or 0
    # twice as many packs as windows ask for: hashing deals them unevenly
    packs = 1 if windows <= PACK else 2 * -(-windows // PACK)
    number = F.pmod(F.xxhash64("name", "text"), F.lit(packs))
    for pack in range(packs):
        rows = held.where(number == pack).select("name", F.col("text").cast("binary").alias("text")).collect()
        yield [(row["name"], bytes(row["text"])) for row in rows]


class _Sent:
    """A broadcast pack, compared by its number when a worker asks whether it has compiled it already."""

    def __init__(self, number: str, items: list[tuple[str, bytes]], window: int):
        self.number, self.items, self.window = number, items, window

    def __eq__(self, other) -> bool:
        return self.number == getattr(other, "number", None)

    def compiled(self) -> Pack:
        return compile_patterns(self.items, self.window)


def _searcher(spark: SparkSession, pack: list[tuple[str, bytes]], window: int):
    sent, number = spark.sparkContext.broadcast(pack), uuid.uuid4().hex

    @F.pandas_udf(FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        patterns = kept(_Sent.compiled, _Sent(number, sent.value, window))
        for texts in batches:
            yield pd.DataFrame([find(text, patterns) for text in texts], columns=FOUND.names)

    return search


@F.pandas_udf(ArrayType(ArrayType(LongType())))
def _merged(first: pd.Series, second: pd.Series) -> pd.Series:
    return pd.Series([merge([*a, *b]) for a, b in zip(first, second)])


def search(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, str]:
    """``docs`` with a struct of n_words, spans (start, end in words) and items, and that column's name.

    Null texts have no words. Item ids are compared as strings, a null id as the
    empty one; repeated items count once. Without items nothing is found. No row
    is moved or lost, repeated rows included.
    """
    spark, name, later = docs.sparkSession, fresh(docs, "found"), fresh(docs, "more")
    out = None
    for pack in _packs(items, window):
        seen = _searcher(spark, pack, window)(text_bytes(F.col("text")))
        if out is None:
            out = docs.withColumn(name, seen)
            continue
        # each pass is written, so that the patterns of one pack are held at a time
        both = cut(out).withColumn(later, seen)
        joined = F.struct(
            F.col(name)["n_words"].alias("n_words"),
            _merged(F.col(name)["spans"], F.col(later)["spans"]).alias("spans"),
            F.array_sort(F.array_union(F.col(name)["items"], F.col(later)["items"])).alias("items"),
        )
        out = both.withColumn(name, joined).drop(later)
    return out, name


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, span: total + span[1] - span[0])


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, as they are."""
    found, name = search(docs, items, window)
    return found.where(F.size(F.col(name)["spans"]) == 0).drop(name)


_SQL_WORDS = r"""regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_CHECK = f"""
WITH benchmark_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, coalesce({_SQL_WORDS}, []) AS w FROM benchmark
), patterns AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS l,
         array_to_string(w[t.i : t.i + least(len(w), {WINDOW}) - 1], ' ') AS p
  FROM benchmark_words, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS t(i) WHERE len(w) > 0
), document_words AS (
  SELECT doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents
), windows AS (
  SELECT doc_id, t.i, l, array_to_string(w[t.i : t.i + l - 1], ' ') AS p
  FROM document_words, (SELECT DISTINCT l FROM patterns) AS lengths, unnest(range(1, len(w) - l + 2)) AS t(i)
), occurrences AS (
  SELECT doc_id, i, windows.l, item FROM windows JOIN patterns ON windows.p = patterns.p AND windows.l = patterns.l
), hits AS (
  SELECT doc_id, count(DISTINCT t.pos) AS n FROM occurrences, unnest(range(i, i + l)) AS t(pos) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM occurrences) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.names, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM document_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op2_wu_manber_decontamination", _CHECK)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found, _ = search(docs, table(spark, sf_dir, "benchmark"))
    # item ids sort as strings by code point, in Spark as in Python
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        hit_words(F.col("found.spans")).alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.size("found.spans") > 0).alias("contaminated"),
    )
