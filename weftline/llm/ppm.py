"""Language-model scores by prediction by partial matching.

The model is a byte-context trie: how often each symbol follows each context of
up to ``ORDER`` bytes. A symbol is coded in the longest context in which it was
seen; every longer context costs an escape, whose probability is estimated from
the number of distinct symbols there (method D), and symbols of the longer
context are excluded from the shorter one. What no context has seen is uniform.
Coded are the bytes of the tokens: words with A-Z lower-cased, joined by single
spaces, and an end mark.

The trie is stored flat, as a count per window of ``ORDER`` + 1 bytes, and it is
as large as the corpus makes it: no task holds all of it. Documents are dealt
into blocks of ``BLOCK`` bytes. A first pass counts the distinct windows and
words of each block; counts are added up over all blocks. Probabilities are then
worked out for all windows that end in the same two bytes of context together:
all longer contexts are among them, and shorter ones are a table of 256 x 256.
Each block gets back the windows that it has, and adds up its documents.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm.common import cut_packed, documents, text_bytes
from weftline.llm.registry import query
from weftline.session import cut

ORDER = 5
#: Bytes of text in a block on average, and bytes and texts of it that are worked on at a time.
BLOCK = 16 << 20
CHUNK = 1 << 19
CHUNK_TEXTS = 1 << 15
#: Windows whose probabilities are worked out together, on average.
GROUP = 200_000
#: Marks before and after a text; neither byte occurs in UTF-8.
BEGIN, END = 0xFE, 0xFF


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def windows(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts as integers, context first, and the index of the text each is from."""
    texts = [b" ".join(tokens(text)) for text in texts]
    held = np.frombuffer(b"".join(bytes([BEGIN]) * order + text + bytes([END]) for text in texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + order + 1
    found = np.zeros(max(0, len(held) - order), np.int64)
    for at in range(order + 1):
        found <<= 8
        found |= held[at : at + len(found)]
    # windows that reach over the end of a text are none
    inside = np.ones(len(held), bool)
    ends = np.cumsum(lengths)
    for back in range(1, order + 1):
        inside[ends - back] = False
    return found[inside[: len(found)]], np.repeat(np.arange(len(texts)), lengths - order)


def _chunks(texts: list[bytes]):
    """Index ranges of texts of about ``CHUNK`` bytes together; their indices fit beside a window in 64 bits."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text) + ORDER + 1
        if size >= CHUNK or at + 1 - start == CHUNK_TEXTS:
            yield start, at + 1
            start, size = at + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _added(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sets of distinct windows with counts as one."""
    keys = np.concatenate([one[0], other[0]])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([one[1], other[1]])[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def _distinct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of the texts and their counts.

    Sets of like size are added up as they come, so memory follows the distinct
    windows and not the windows of all chunks.
    """
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in _chunks(texts):
        parts.append(np.unique(windows(texts[a:b])[0], return_counts=True))
        while len(parts) > 1 and 2 * len(parts[-1][0]) >= len(parts[-2][0]):
            last = parts.pop()
            parts.append(_added(parts.pop(), last))
    while len(parts) > 1:
        last = parts.pop()
        parts.append(_added(parts.pop(), last))
    return parts[0] if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


PARTS = pa.schema([("block", pa.int32()), ("window", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])
PARTS_DDL = "block int, window bigint, word binary, n bigint"


def count_block(block: pa.Table) -> pa.Table:
    """Distinct windows and words of a block with their counts in its training texts (0: only held out)."""
    # what a worker no longer needs goes back at once, instead of waiting in a pool for its next task
    pa.set_memory_pool(pa.system_memory_pool())
    number = block["block"][0].as_py()
    texts = block["text"].to_pylist()
    held = block["held_out"].to_pylist()
    training = [text for text, out in zip(texts, held) if not out]
    rest = [text for text, out in zip(texts, held) if out]
    keys, counts = _distinct(training)
    others = np.setdiff1d(_distinct(rest)[0], keys, assume_unique=True)
    words: Counter = Counter()
    for text in training:
        words.update(tokens(text))
    for text in rest:
        for word in tokens(text):
            if word not in words:
                words[word] = 0
    n_windows, n_words = len(keys) + len(others), len(words)
    return pa.table(
        [
            pa.array(np.full(n_windows + n_words, number, np.int32)),
            pa.concat_arrays([pa.array(keys), pa.array(others), pa.nulls(n_words, pa.int64())]),
            pa.concat_arrays([pa.nulls(n_windows, pa.binary()), pa.array(words.keys(), pa.binary())]),
            pa.concat_arrays(
                [pa.array(counts), pa.array(np.zeros(len(others), np.int64)), pa.array(words.values(), pa.int64())]
            ),
        ],
        schema=PARTS,
    )


def code_lengths(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 probability of the last byte of each window given the bytes before it.

    ``keys`` are distinct windows and hold all those of the training texts that
    end in the same two bytes of context; ``pairs[a, b]`` counts b after a over
    all training texts.
    """
    singles = pairs.sum(0)
    logp = np.zeros(len(keys))
    open_ = np.ones(len(keys), bool)
    symbol = keys & 255
    longer_nodes = longer_counts = None
    longer_context, longer_distinct = None, np.zeros(len(keys), np.int64)
    for k in range(order, -1, -1):
        node = keys & ((1 << 8 * (k + 1)) - 1)
        if k >= 2:
            nodes, at = np.unique(node, return_inverse=True)
            held = np.bincount(at, counts, len(nodes)).astype(np.int64)
            own = held[at]
            contexts, of_node = np.unique(nodes >> 8, return_inverse=True)
            total = np.bincount(of_node, held, len(contexts)).astype(np.int64)
            distinct = np.bincount(of_node, held > 0, len(contexts)).astype(np.int64)
            mine = of_node[at]
            total, distinct = total[mine], distinct[mine]
        elif k == 1:
            before = (keys >> 8) & 255
            own, total, distinct = pairs[before, symbol], pairs.sum(1)[before], (pairs > 0).sum(1)[before]
        else:
            own = singles[symbol]
            total = np.full(len(keys), singles.sum())
            distinct = np.full(len(keys), np.count_nonzero(singles))
        if longer_nodes is not None:
            # what the symbols of the longer context count here is excluded
            if k >= 2:
                below = held[np.searchsorted(nodes, longer_nodes & ((1 << 8 * (k + 1)) - 1))]
            elif k == 1:
                below = pairs[(longer_nodes >> 8) & 255, longer_nodes & 255]
            else:
                below = singles[longer_nodes & 255]
            contexts_above, above = np.unique(longer_nodes >> 8, return_inverse=True)
            excluded = np.bincount(above, np.where(longer_counts > 0, below, 0), len(contexts_above)).astype(np.int64)
            total = total - excluded[np.searchsorted(contexts_above, longer_context)]
        left = distinct - longer_distinct
        seen = open_ & (own > 0)
        escapes = open_ & ~seen & (total > 0)
        logp[seen] += np.log10((2 * own[seen] - 1) / (2 * total[seen]))
        logp[escapes] += np.log10(left[escapes] / (2 * total[escapes]))
        open_ &= ~seen
        longer_nodes, first = np.unique(node, return_index=True)
        longer_counts, longer_context, longer_distinct = own[first], node >> 8, distinct
    logp[open_] -= np.log10(256 - longer_distinct[open_])
    return logp


def _coder(spark: SparkSession, pairs: np.ndarray):
    sent = spark.sparkContext.broadcast(pairs)

    def code(group: pa.Table) -> pa.Table:
        keys, counts = group["window"].to_numpy(), group["n"].to_numpy()
        return pa.table({"window": keys, "logp": code_lengths(keys, counts, sent.value)})

    return code


SCORES_DDL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _scorer(total: int, distinct: int, ends: int):
    """``total`` training tokens, ``distinct`` of them, ``ends`` training texts."""
    scale = total + distinct + 1

    def score(block: pa.Table, known: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        texts = block["text"].to_pylist()
        held = block["held_out"].to_pylist()
        # column by column, so that no second copy of all rows is held
        is_window = known["window"].is_valid()
        keys = known["window"].filter(is_window).to_numpy()
        order = np.argsort(keys)
        keys = keys[order]
        logp = known["value"].filter(is_window).to_numpy()[order]
        del is_window, order
        # words that no other block has are counted here
        counts: Counter = Counter()
        for text, out in zip(texts, held):
            if not out:
                counts.update(tokens(text))
        shared = known.filter(known["word"].is_valid()).select(["word", "value"])
        for batch in shared.to_batches(max_chunksize=1 << 14):
            for word, n in zip(batch["word"].to_pylist(), batch["value"].to_pylist()):
                counts[word] = int(n)
        scores = np.zeros(len(texts))
        for a, b in _chunks(texts):
            found, of = windows(texts[a:b])
            bits = max(1, (b - a - 1).bit_length())
            packed = np.sort((found << bits) | of)
            found, of = packed >> bits, packed & ((1 << bits) - 1)
            fresh = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
            each = logp[np.searchsorted(keys, found[fresh])]
            each = np.repeat(each, np.diff(np.append(fresh, len(found))))
            scores[a:b] = np.bincount(of, each, b - a)
        n_tokens, n_known, base = [], [], []
        end = np.log10((ends + 1) / scale)
        for text in texts:
            seen = np.fromiter((counts[word] for word in tokens(text)), np.int64)
            n_tokens.append(len(seen) + 1)
            n_known.append(int(np.count_nonzero(seen)) + (ends > 0))
            base.append(float(np.log10((seen + 1) / scale).sum() + end))
        return pa.table(
            [block["doc_id"], block["held_out"], n_tokens, n_known, base, pa.array(scores)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    return score


def score(docs: DataFrame) -> DataFrame:
    """Scores of every row of ``docs (doc_id, text)`` under a model of the rows that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    Held out are ids whose crc32 as text leaves 2 modulo 7; a null id is like an
    empty one and trains. A null or empty text is one end mark. Repeated rows are
    counted and scored each. Without training rows all symbols are equally
    likely. An empty table has no rows.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK
    dealt = docs.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"),
        "doc_id",
        text_bytes(F.col("text")).alias("text"),
        (F.crc32(name) % 7 == 2).alias("held_out"),
    )
    parts = cut_packed(dealt.groupBy("block").applyInArrow(count_block, PARTS_DDL))
    of_windows = parts.where("window is not null")
    trie = cut(of_windows.groupBy("window").agg(F.sum("n").alias("n")))
    ends = docs.where(F.crc32(name) % 7 != 2).count()

    last_two = F.col("window").bitwiseAND(F.lit(0xFFFF))
    pairs = np.zeros((256, 256), np.int64)
    for row in trie.groupBy(last_two.alias("pair")).agg(F.sum("n").alias("n")).collect():
        pairs[row["pair"] >> 8, row["pair"] & 255] = row["n"]
    groups = 1 + trie.count() // GROUP
    context = F.shiftright("window", 8).bitwiseAND(F.lit(0xFFFF))
    coded = (
        trie.withColumn("group", F.pmod(F.xxhash64(context), F.lit(groups)))
        .groupBy("group")
        .applyInArrow(_coder(spark, pairs), "window bigint, logp double")
    )
    words = cut(
        parts.where("word is not null").groupBy("word").agg(F.sum("n").alias("total"), F.count("*").alias("blocks"))
    )
    told = words.where("total > 0").agg(F.sum("total").alias("n"), F.count("*").alias("v")).first()
    total, distinct = (told["n"] or 0) + ends, told["v"] + (ends > 0)

    window_rows = of_windows.select("block", "window").join(coded, "window").select(
        "block", "window", F.lit(None).cast("binary").alias("word"), F.col("logp").alias("value")
    )
    word_rows = (
        parts.where("word is not null")
        .select("block", "word")
        .join(words.where("blocks > 1").select("word", "total"), "word")
        .select("block", F.lit(None).cast("bigint").alias("window"), "word", F.col("total").cast("double").alias("value"))
    )
    known = window_rows.unionByName(word_rows)
    scored = (
        dealt.groupBy("block")
        .cogroup(known.groupBy("block"))
        .applyInArrow(_scorer(total, distinct, ends), SCORES_DDL)
    )
    return scored.withColumn("train_tokens", F.lit(total).cast("bigint"))


@query("op4_ppm_scores")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    return score(documents(spark, sf_dir).select("doc_id", "text"))
