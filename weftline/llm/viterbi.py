"""Token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton lists the vocabulary's pieces that end at each
character; dynamic programming keeps for each position the best score of a
segmentation up to it and how many pieces that has, nothing else. The rules are
those of the public unigram tokenizers:

* the text gets a leading space, and spaces become the mark U+2581;
* of equally good segmentations the one whose last piece starts first wins,
  at every position;
* a character that is no piece by itself may stand alone as unknown, at 10 below
  the least score, and counts as many pieces as it has bytes in UTF-8, if the
  vocabulary has pieces for bytes, else a run of unknown characters counts one.

Scores are added in double precision.

Where no piece has the mark after another character, and a mark is never part of
an unknown run, no segmentation crosses from one marked word to the next, so words are counted one by one, and a word
that comes again is not computed again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from weftline.llm.common import documents
from weftline.llm.registry import query

MARK = "▁"
#: Fixed value: how far an unknown character lies below the least score.
UNKNOWN = 10.0
#: Words whose counts a task remembers, and the longest of them.
REMEMBERED = 400_000
LONGEST = 64

COUNTED = StructType([StructField("n_pieces", LongType()), StructField("best_score", DoubleType())])


class Vocabulary(NamedTuple):
    pieces: list[tuple[str, float]]
    byte_pieces: bool


def read_vocabulary(path: str) -> Vocabulary:
    """Ordinary pieces and their scores from a public model file, whose scores are used as a unigram model's."""
    from sentencepiece import sentencepiece_model_pb2 as protocol

    model = protocol.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    ordinary = [(piece.piece, piece.score) for piece in model.pieces if piece.type == piece.NORMAL]
    return Vocabulary(ordinary, any(piece.type == piece.BYTE for piece in model.pieces))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Counter:
    """Counts pieces of texts under one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.byte_pieces = vocabulary.byte_pieces
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if vocabulary.pieces:
            self.automaton.make_automaton()
        self.any = bool(vocabulary.pieces)
        self.unknown = min((score for _, score in vocabulary.pieces), default=0.0) - UNKNOWN
        crossing = any(re.search(f"[^{MARK}]{MARK}", piece) for piece, _ in vocabulary.pieces)
        # a run of unknown characters may count once across words, if the mark can be one of them
        crossing |= not vocabulary.byte_pieces and MARK not in dict(vocabulary.pieces)
        self.split = re.compile("(?s).+" if crossing else f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.known: dict[str, tuple[int, float]] = {}

    def best(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation of a part of a text."""
        score, pieces = [0.0], [0]
        # whether the best way to a position ends in an unknown character
        strange = [False]
        found = self.automaton.iter(text) if self.any else iter(())
        last, match = next(found, (-1, None))
        for at in range(len(text)):
            most, count, alone = None, 0, False
            # pieces that end here come longest first, so the first start wins a tie
            while last == at:
                length, value = match
                start = at + 1 - length
                guess = score[start] + value
                if most is None or guess > most:
                    most, count = guess, pieces[start] + 1
                alone |= length == 1
                last, match = next(found, (-1, None))
            odd = False
            if not alone:
                guess = score[at] + self.unknown
                if most is None or guess > most:
                    most, odd = guess, True
                    if self.byte_pieces:
                        count = pieces[at] + len(text[at].encode())
                    else:
                        count = pieces[at] + (not strange[at])
            score.append(most)
            pieces.append(count)
            strange.append(odd)
        return pieces[-1], score[-1]

    def count(self, text: str | None) -> tuple[int, float]:
        """Pieces and score of a text; a null or empty one has none."""
        if not text:
            return 0, 0.0
        known, best = self.known, self.best
        total, score = 0, 0.0
        for word in self.split((" " + text).replace(" ", MARK)):
            found = known.get(word)
            if found is None:
                found = best(word)
                if len(word) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = found
            total += found[0]
            score += found[1]
        return total, score


def counted(spark: SparkSession, text: Column, vocabulary: Vocabulary) -> Column:
    """Struct of n_pieces and best_score of a text column. The vocabulary is sent to every task."""
    sent = spark.sparkContext.broadcast(tuple(vocabulary))

    @F.pandas_udf(COUNTED)
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter(Vocabulary(*sent.value))
        for texts in batches:
            yield pd.DataFrame(list(map(counter.count, texts)), columns=COUNTED.names)

    return count(text)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_pieces, best_score`` of every row of ``docs (doc_id, text)``.

    Null and empty texts have no pieces. Repeated rows come out as often; an
    empty table has no rows. ``path`` names the vocabulary file; only the driver
    reads it.
    """
    found = counted(docs.sparkSession, F.col("text"), read_vocabulary(path or default_path()))
    return docs.select("doc_id", found.alias("found")).select("doc_id", "found.n_pieces", "found.best_score")


@query("op8_viterbi_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return token_counts(documents(spark, sf_dir).select("doc_id", "text"))
