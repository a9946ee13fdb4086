"""Sharding by jump consistent hashing, without a table of the ring.

The published loop draws from a linear congruential generator that is seeded
with the key: each draw jumps ahead to the next shard count at which the key
would move, until the count at hand is passed. The state of 64 bits is kept as
two halves, since SQL has no product modulo 2**64. A key moves only when the
count grows past a jump, and then into the newest shard.

Slots number the rows of a shard without gaps. Rows fall into pieces by other
digits of the key's hash, the
pieces of a shard are counted, and a row's slot is its rank in its piece after
the rows of earlier pieces; no shard is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weftline.llm.common import documents, hex_long
from weftline.llm.registry import query

SHARDS = 16
#: Rows that a piece of a shard holds on average.
PIECE_ROWS = 2_500

#: Fixed value: multiplier of the published generator; its halves and the low half's halves below.
MULTIPLIER = 2862933555777941757
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_LOW_1, _LOW_0 = _LOW >> 16, _LOW & 0xFFFF
_MASK = 0xFFFFFFFF


def _low32(value: Column) -> Column:
    return value.bitwiseAND(F.lit(_MASK))


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """Both halves of ``state * MULTIPLIER + 1``; no intermediate passes 2**63."""
    upper, lower = low * F.lit(_LOW_1), low * F.lit(_LOW_0) + F.lit(1)
    total = lower + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftright(total, 32) + F.shiftright(upper, 16)
    crossed = high * F.lit(_LOW_0) + F.shiftleft((high * F.lit(_LOW_1)).bitwiseAND(F.lit(0xFFFF)), 16)
    return _low32(carry + _low32(crossed) + _low32(low * F.lit(_HIGH))), _low32(total)


def jump_hash(high: Column, low: Column, shards: int) -> Column:
    """Shard of a 64-bit key given as two halves of 32 bits."""

    def turn(state: Column, _: Column) -> Column:
        next_high, next_low = _next(state["high"], state["low"])
        draw = (F.shiftright(next_high, 1) + F.lit(1)).cast("double")
        jump = ((state["jump"] + 1) * (F.lit(float(1 << 31)) / draw)).cast("bigint")
        moved = F.struct(next_high.alias("high"), next_low.alias("low"), state["jump"].alias("shard"), jump.alias("jump"))
        return F.when(state["jump"] < shards, moved).otherwise(state)

    zero = F.lit(0).cast("bigint")
    start = F.struct(high.alias("high"), low.alias("low"), (zero - 1).alias("shard"), zero.alias("jump"))
    # every turn raises the jump by one at least, so as many turns as shards always suffice
    turns = F.sequence(F.lit(1), F.lit(shards))
    return F.aggregate(turns, start, turn, lambda state: state["shard"].cast("int"))


def _digits(key: Column, at: int) -> Column:
    """32 bits of a stable hash of any key column; null hashes like the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return hex_long(F.substring(digest, 8 * at + 1, 8))


def shard_of(key: Column, shards: int = SHARDS) -> Column:
    return jump_hash(_digits(key, 0), _digits(key, 1), shards)


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs (doc_id, text)``.

    The id alone decides (law ``key``), so rows that share an id, or have none,
    share a shard. Slots follow a hash of the id, then id, size and checksum;
    rows alike in all of them are numbered in any order. A null text has size 1
    and the checksum of the empty text. An empty table has no rows.
    """
    pieces = 1 + docs.count() // (shards * PIECE_ROWS)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    piece = F.shiftright(_digits(F.col("doc_id"), 2) * F.lit(pieces), 32).alias("piece")
    placed = [shard_of(F.col("doc_id"), shards).alias("shard"), piece]
    counts = docs.select("doc_id").select(*placed).groupBy("shard", "piece").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        *placed,
        shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    inside = Window.partitionBy("shard", "piece").orderBy("doc_id", "size", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(inside).cast("bigint") - 1)
    return ranked.join(starts, ["shard", "piece"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("rank")).alias("slot"),
        "grown_shard",
    )


_BITS = "0::UBIGINT"
for _bit in range(8):
    _BITS = f"xor({_BITS}, CASE WHEN b & {1 << _bit} > 0 THEN v[{_bit + 2}] ELSE 0 END)"

_CHECK = f"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, 0 AS step, CAST(i AS UBIGINT) AS crc FROM range(256) AS t(i)
  UNION ALL
  SELECT byte, step + 1, CASE WHEN crc & 1 = 1 THEN xor(3988292384::UBIGINT, crc >> 1) ELSE crc >> 1 END
  FROM steps WHERE step < 8
), crcs AS (SELECT list(crc ORDER BY byte) AS crcs FROM steps WHERE step = 8
), texts AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS digits FROM documents
), shifted AS (
  -- the checksum is linear: what the start value and each bit of a byte add, k bytes before the end
  SELECT 0::BIGINT AS k, [4294967295::UBIGINT, crcs[2], crcs[3], crcs[5], crcs[9], crcs[17], crcs[33], crcs[65], crcs[129]] AS v
  FROM crcs
  UNION ALL
  SELECT k + 1, [xor(x >> 8, crcs[1 + CAST(x & 255 AS INTEGER)]) for x in v] FROM shifted, crcs
  WHERE k < (SELECT max(n) FROM texts)
), bytes AS (
  SELECT doc_id, n - 1 - t.i AS k, CAST('0x' || digits[2 * t.i + 1 : 2 * t.i + 2] AS INTEGER) AS b
  FROM texts, unnest(range(n)) AS t(i)
), sums AS (
  SELECT doc_id, bit_xor({_BITS}) AS crc FROM bytes JOIN shifted USING (k) GROUP BY doc_id
), sized AS (
  SELECT doc_id, CAST(n + 1 AS BIGINT) AS size,
         CAST(xor(xor(v[1], 4294967295::UBIGINT), coalesce(crc, 0::UBIGINT)) AS BIGINT) AS text_crc32,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash
  FROM texts JOIN shifted ON k = n LEFT JOIN sums USING (doc_id)
), jumps AS (
  SELECT doc_id, shards, CAST('0x' || hash[1:16] AS UBIGINT) AS key, -1::BIGINT AS shard, 0::BIGINT AS jump
  FROM sized, (VALUES ({SHARDS}), ({SHARDS + 1})) AS t(shards)
  UNION ALL
  SELECT doc_id, shards, next, jump, CAST(trunc((jump + 1) * (2147483648::DOUBLE / CAST((next >> 33) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT *, CAST((key::UHUGEINT * {MULTIPLIER}::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT
                       AS UBIGINT) AS next FROM jumps WHERE jump < shards)
), shards AS (
  SELECT doc_id, CAST(max(shard) FILTER (shards = {SHARDS}) AS INTEGER) AS shard,
         CAST(max(shard) FILTER (shards = {SHARDS + 1}) AS INTEGER) AS grown_shard
  FROM jumps GROUP BY doc_id
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard, row_number() OVER (
         PARTITION BY shard ORDER BY (CAST('0x' || hash[17:24] AS BIGINT)
           * (1 + (SELECT count(*) FROM documents) // ({SHARDS} * {PIECE_ROWS}))) >> 32, doc_id) - 1 AS slot
FROM sized JOIN shards USING (doc_id)
"""


@query("op7_jump_hash_sharding", _CHECK)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document."""
    return sharded(documents(spark, sf_dir).select("doc_id", "text"))
