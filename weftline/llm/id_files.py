"""Token ids in binary shards, each with a minimal perfect hash index of its documents.

A shard is two files. ``.ids`` holds nothing but the ids of its documents, little
endian, two bytes each where the vocabulary allows it, else four. ``.idx`` says where
each document starts and finds documents by key:

* a minimal perfect hash gives each key of the shard a slot of its own. Keys are
  thrown into a bit array; those that hit a place alone set its bit, the others go
  on to the next, smaller array. A key's slot is the number of bits set before its
  own, known from counts kept for each 64 bits;
* a slot holds 32 bits of another hash of its key, so that a key that is not there
  is recognised (but for one in four thousand million), the first document with that key, and how
  many there are. Documents that share a key lie side by side.

So a lookup takes as many steps whatever the shard holds. Documents are written in
ascending order of their keys, none last, and a manifest lists the shards with
their first and last keys, which leads from a key to its shards. A shard is closed
after ``SHARD_IDS`` ids or ``SHARD_DOCS`` documents. Files have names that no other
attempt uses, and only those of successful attempts get into the manifest.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from typing import Any, BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from weftline.llm.common import documents, kept
from weftline.llm.registry import query
from weftline.session import checkpoint_dir, cut

#: Fixed value of the contract: the id that ends a document.
END = 2
SHARD_IDS = 32 << 20
SHARD_DOCS = 1 << 16
#: Characters encoded at a time, and bytes of parts whose ids a worker remembers.
PIECE = 1 << 20
REMEMBERED = 96 << 20
#: Bytes of ids that one batch of a reader holds (or one document).
BATCH = 16 << 20

#: What the tokenizer does before its model, as its file says it.
_STEPS = [
    {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]

_MAGIC = b"WEFTIDX1"
_HEADER = "<8sIIQQQQ"
#: Places per key in a bit array.
_ROOM = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def opened(path: str) -> tuple[files.FileSystem, str]:
    """File system and path of a folder that a URI or an absolute path names."""
    return files.FileSystem.from_uri(re.sub("^file:/+", "/", path))


class Encoder:
    """Ids of whole texts as bytes.

    Where the tokenizer's file says that it composes signs, makes white space one
    space, lower-cases and splits as ``_STEPS`` do, nothing looks across white space.
    Text of ASCII and Latin-1 letters is then lower-cased and split here, the library's
    model sees the parts, and a part that comes again is not computed again. Words
    with other signs go through the library whole, and under other tokenizers every
    text does.
    """

    def __init__(self, json_text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json_text)
        self.model = self.tokenizer.model
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        said = json.loads(json_text)
        added = [token["content"] for token in said["added_tokens"] if token["normalized"] or token["content"][:2] != "<|"]
        self.spaced = [said["normalizer"], said["pre_tokenizer"]] == _STEPS and not added
        self.gap = re.compile(r"[ \t\n\r]").search
        self.words = re.compile("[^ \t\n\r]+").findall
        self.plain = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*").fullmatch
        self.parts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+").findall
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [byte for byte in range(256) if byte not in set(kept)]
        #: the sign that stands for each byte in the vocabulary
        self.signs = {byte: 256 + place for place, byte in enumerate(other)}
        #: ids of parts, and of whole words after a space
        self.known: dict[str, bytes] = {}
        self.held = 0

    def pieces(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            gap = self.gap(text, min(at + PIECE, len(text)))
            end = gap.start() if gap else len(text)
            yield text[at:end]
            at = end

    def keep(self, key: str, ids: list[int]) -> None:
        found = self.known[key] = array(self.type.char, ids).tobytes()
        self.held += 160 + len(key) + len(found)

    def learn(self, keys: list[str]) -> None:
        """Find the ids of what is not known yet."""
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        tokenize, whole = self.model.tokenize, []
        for key in set(keys).difference(self.known):
            if key[0] == " ":
                whole.append(key)
            else:
                signs = key if key.isascii() else key.encode().decode("latin-1").translate(self.signs)
                self.keep(key, [token.id for token in tokenize(signs)])
        if whole:
            for key, found in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)):
                self.keep(key, found.ids)

    def split(self, text: str) -> list[str]:
        """Parts, and words with a space before them that only the library can split."""
        # special tokens know their case
        if self.plain(text) and "<|" not in text:
            return self.parts(text.lower())
        keys: list[str] = []
        for word in self.words(text):
            if self.plain(word) and "<|" not in word:
                keys += self.parts(word.lower())
            else:
                keys.append(" " + word)
        return keys

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text in parts, without an end."""
        if not self.spaced:
            yield array(self.type.char, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            return
        for piece in self.pieces(text):
            keys = self.split(piece)
            try:
                yield b"".join(map(self.known.__getitem__, keys))
            except KeyError:
                self.learn(keys)
                yield b"".join(map(self.known.__getitem__, keys))


def key_bytes(key: Any) -> bytes:
    """A document's key as bytes; none is a key of its own."""
    return b"" if key is None else b"k" + str(key).encode()


def _hashes(keys: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(key, seed=seed) for key in keys), np.uint64, len(keys))


def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where the hashes fall in the bit array of a level."""
    mixed = (hashes ^ np.uint64(level)) * _ODD
    mixed ^= mixed >> np.uint64(31)
    mixed *= _ODD
    return (mixed ^ (mixed >> np.uint64(33))) % np.uint64(size)


class PerfectHash(NamedTuple):
    """A minimal perfect hash: ``sizes`` of the bit arrays, their words, and bits set before each word."""

    sizes: np.ndarray
    words: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray) -> PerfectHash:
        """For distinct hashes."""
        sizes, words, left = [], [], hashes
        while len(left):
            size = 64 * -(-_ROOM * len(left) // 64)
            place = _place(left, len(sizes), size)
            hit = np.bincount(place.astype(np.int64), minlength=size)
            words.append(np.packbits(hit == 1, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[hit[place.astype(np.int64)] > 1]
        joined = np.concatenate(words) if words else np.zeros(0, "<u8")
        before = np.cumsum(np.r_[0, np.bitwise_count(joined)])[:-1]
        return cls(np.array(sizes, "<u8"), joined, before.astype("<u4"))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slots of hashes, -1 for what certainly is not there."""
        slots = np.full(len(hashes), -1, np.int64)
        left, base = np.arange(len(hashes)), 0
        for level, size in enumerate(self.sizes):
            place = _place(hashes[left], level, int(size))
            word = base + (place >> np.uint64(6)).astype(np.int64)
            bit = np.uint64(1) << (place & np.uint64(63))
            hit = (self.words[word] & bit) > 0
            lower = np.bitwise_count(self.words[word] & (bit - np.uint64(1)))
            slots[left[hit]] = (self.before[word] + lower)[hit]
            left, base = left[~hit], base + int(size) // 64
        return slots


def index_bytes(keys: list[bytes], firsts: list[int], offsets: np.ndarray, width: int) -> bytes:
    """An ``.idx`` file: ``keys`` are distinct, ``firsts`` their first documents, ``offsets`` where documents start and end."""
    seed = 0
    while len(np.unique(hashes := _hashes(keys, seed))) < len(keys):
        seed += 1
    found = PerfectHash.of(hashes)
    slots = found.slots(hashes)
    # seeds for fingerprints are odd numbers far from those of the hashes
    prints = (_hashes(keys, ~seed & 0xFFFFFFFF) & np.uint64(0xFFFFFFFF)).astype("<u4")
    runs = np.diff(np.r_[firsts, len(offsets) - 1]).astype("<u4")
    table = np.zeros((3, len(keys)), "<u4")
    table[:, slots] = prints, np.array(firsts, "<u4"), runs
    header = struct.pack(_HEADER, _MAGIC, width, len(found.sizes), len(keys), len(offsets) - 1, len(found.words), seed)
    return b"".join([header, *(x.tobytes() for x in (found.sizes, found.words, found.before, table, offsets.astype("<u8")))])


class Shard:
    """A shard's index, and its ids as they are asked for."""

    def __init__(self, folder: str, name: str):
        self.files, path = opened(folder)
        with self.files.open_input_file(f"{path}/{name}.idx") as file:
            data = file.read()
        magic, self.width, levels, keys, docs, words, self.seed = struct.unpack_from(_HEADER, data)
        if magic != _MAGIC:
            raise ValueError(f"{name}.idx is no index file")
        at, parts = struct.calcsize(_HEADER), []
        for kind, count in (("<u8", levels), ("<u8", words), ("<u4", words), ("<u4", 3 * keys), ("<u8", docs + 1)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        self.hash = PerfectHash(*parts[:3])
        self.prints, self.firsts, self.runs = parts[3].reshape(3, keys)
        self.offsets = parts[4]
        self.ids: BinaryIO = self.files.open_input_file(f"{path}/{name}.ids")

    def find(self, keys: list[bytes]) -> Iterator[tuple[int, range]]:
        """``(place in keys, documents)`` for the keys that are there."""
        slots = self.hash.slots(_hashes(keys, self.seed))
        prints = _hashes(keys, ~self.seed & 0xFFFFFFFF) & np.uint64(0xFFFFFFFF)
        for at in np.flatnonzero(slots >= 0):
            slot = slots[at]
            if self.prints[slot] == prints[at]:
                first = int(self.firsts[slot])
                yield int(at), range(first, first + int(self.runs[slot]))

    def read(self, doc: int) -> bytes:
        """A document's ids, four bytes each."""
        start, end = int(self.offsets[doc]), int(self.offsets[doc + 1])
        data = self.ids.read_at((end - start) * self.width, start * self.width)
        return data if self.width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()

    def close(self) -> None:
        self.ids.close()


class _Writer:
    """Writes the documents of one task to shards; ``rows`` are those of the manifest."""

    def __init__(self, folder: str, width: int, shard_ids: int, shard_docs: int):
        self.folder, self.width, self.shard_ids, self.shard_docs = folder, width, shard_ids, shard_docs
        self.files, self.path = opened(folder)
        self.part = TaskContext.get().partitionId()
        self.rows: list[tuple] = []
        self.out = None

    def add(self, key: Any, parts: Iterator[bytes]) -> None:
        if self.out is None:
            self.name, self.keys, self.firsts, self.offsets = uuid.uuid4().hex, [], [], [0]
            self.first, self.last = key, None
            self.out = self.files.open_output_stream(f"{self.path}/{self.name}.ids")
        named = key_bytes(key)
        if not self.keys or self.keys[-1] != named:
            self.keys.append(named)
            self.firsts.append(len(self.offsets) - 1)
        self.last = self.last if key is None else key
        size = 0
        for part in parts:
            size += len(part)
            self.out.write(part)
        self.out.write(END.to_bytes(self.width, "little"))
        self.offsets.append(self.offsets[-1] + size // self.width + 1)
        if self.offsets[-1] >= self.shard_ids or len(self.offsets) > self.shard_docs:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        offsets = np.array(self.offsets, "<u8")
        with self.files.open_output_stream(f"{self.path}/{self.name}.idx") as file:
            file.write(index_bytes(self.keys, self.firsts, offsets, self.width))
        place = (self.part, len(self.rows))
        self.rows.append((*place, self.name, len(offsets) - 1, int(offsets[-1]), self.first, self.last, not self.keys[-1]))
        self.out = None


def _manifest_schema(key: StructField) -> StructType:
    plain = [("part", IntegerType()), ("place", IntegerType()), ("name", StringType()), ("n_docs", LongType()), ("n_ids", LongType())]
    fields = [StructField(*x) for x in plain]
    ends = [StructField("first", key.dataType), StructField("last", key.dataType)]
    return StructType([*fields, *ends, StructField("keyless", IntegerType())])


def write(
    docs: DataFrame, folder: str, path: str | None = None, shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS
) -> DataFrame:
    """Write the ids of ``docs (doc_id, text)`` to shards in ``folder``; gives their manifest, which is there too.

    A null text is empty and has the end only. Rows with equal ids follow each
    other by a hash of the text; rows without an id come last. Any number of rows
    may share an id: they are split over as many shards as they fill. Other columns are left
    out. An empty table gives an empty manifest. ``path`` names the tokenizer's
    file, which only the driver reads.
    """
    spark = docs.sparkSession
    with open(path or default_path(), encoding="utf-8") as file:
        sent = spark.sparkContext.broadcast(file.read())
    system, place = opened(folder)
    system.create_dir(place, recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, kind = kept(Encoder, sent.value), None, None
        for batch in batches:
            kind = batch.schema.field(0).type
            writer = writer or _Writer(folder, encoder.type.itemsize, shard_ids, shard_docs)
            for key, text in zip(batch.column(0), batch.column(1)):
                writer.add(key.as_py(), encoder.encode(text.as_py() or ""))
        if writer:
            writer.close()
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), kind, kind, pa.int32()]
            arrays = [pa.array(map(int, c) if i == 7 else c, t) for i, (c, t) in enumerate(zip(zip(*writer.rows), types))]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    schema = _manifest_schema(docs.schema["doc_id"])
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("at"))
    # the row's place splits rows that are alike in everything else
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc(), F.col("at").asc()]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    # the written rows name the files of the attempts that succeeded
    made = cut(ranged.mapInArrow(put, schema))
    listed = made.orderBy("part", "place").collect()
    starts = np.cumsum([0, *(row["n_ids"] for row in listed)])
    named = [(number, int(starts[number]), *row[2:]) for number, row in enumerate(listed)]
    fields = [StructField("number", IntegerType()), StructField("start", LongType()), *schema.fields[2:]]
    spark.createDataFrame(named, StructType(fields)).coalesce(1).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def lookup(folder: str, keys: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of the documents in ``folder`` that have one of ``keys (doc_id)``.

    A key finds all documents that have it, a null one those without. Repeated
    keys count once; keys that are not there find nothing. ``start`` counts the
    ids of all documents before; ``ids`` are little-endian four-byte numbers, the
    end included. The manifest, one row a shard, is sent to the tasks.
    """
    spark = keys.sparkSession
    listed = sorted(map(tuple, spark.read.parquet(f"{folder}/manifest").collect()))
    sent = spark.sparkContext.broadcast(listed)
    kind = keys.schema["doc_id"]

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = sent.value
        keyed = [row for row in shards if row[5] is not None]
        lasts = [row[6] for row in keyed]
        keyless = [row[0] for row in shards if row[7]]
        for batch in batches:
            rows, numbers = [], []
            for row, key in enumerate(batch.column(0).to_pylist()):
                if key is None:
                    found = keyless
                else:
                    at, found = bisect_left(lasts, key), []
                    while at < len(keyed) and keyed[at][5] <= key:
                        found.append(keyed[at][0])
                        at += 1
                rows += [row] * len(found)
                numbers += found
            column = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([column, pa.array(numbers, pa.int32())], ["doc_id", "shard"])

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, None
        names = ["doc_id", "start", "n_tokens", "ids"]
        for batch in batches:
            numbers = batch.column(1).to_numpy()
            ends = [*(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            start = 0
            for end in ends if len(numbers) else ():
                if numbers[start] != number:
                    if shard:
                        shard.close()
                    number = int(numbers[start])
                    shard = Shard(folder, sent.value[number][2])
                column = batch.column(0).slice(start, end - start)
                rows, starts, counts, ids, held = [], [], [], [], 0
                for row, docs in shard.find([key_bytes(key) for key in column.to_pylist()]):
                    for doc in docs:
                        data = shard.read(doc)
                        rows.append(row)
                        starts.append(sent.value[number][1] + int(shard.offsets[doc]))
                        counts.append(len(data) // 4)
                        ids.append(data)
                        held += len(data)
                        if held >= BATCH:
                            yield pa.RecordBatch.from_arrays([column.take(pa.array(rows)), *map(pa.array, (starts, counts, ids))], names)
                            rows, starts, counts, ids, held = [], [], [], [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([column.take(pa.array(rows)), *map(pa.array, (starts, counts, ids))], names)
                start = end
        if shard:
            shard.close()

    doc = StructField("doc_id", kind.dataType)
    led = keys.select("doc_id").distinct().mapInArrow(lead, StructType([doc, StructField("shard", IntegerType())]))
    fields = [doc, StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
    return led.repartition("shard").sortWithinPartitions("shard", "doc_id").mapInArrow(get, StructType(fields))


@query("op13_id_files")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of every document, then look up every document's key in the files."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    folder = f"{checkpoint_dir(spark)}/weftline/ids-{uuid.uuid4().hex}"
    write(docs, folder)
    return lookup(folder, docs).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
