"""Spelling variants: which words of a vocabulary are one edit apart, and which is the usual form.

Two words are near if they differ by exactly one inserted, deleted or replaced
code point. The search is dynamic programming over sorted lists. For each word the
list is walked once: a row of the edit matrix, three cells wide as one edit is
allowed, belongs to each code point of the word walked over, and the next word of
the list goes on from the row of the longest prefix it shares with the one
before. Where no cell of a row is within one edit, all words with that prefix are
passed over at once.

A list has to fit a task, so words are filed first. Let the shorter of two near
words have ``l`` code points and let the first difference stand at position ``p``,
from 0 to ``l`` (an insertion at the end). Where ``lo <= p < hi`` the words share
their first ``lo`` and their last ``l - hi`` code points. So each word is filed
under ``l`` equal to its length and one less, and under both halves of the
positions, with what it must share. A file of more than ``GROUP`` words is filed
anew under both halves of its own span of positions, until spans are single
positions, whose files have no more words than the alphabet has letters (that is
the bound then). A pair counts only in the file whose span has its first
difference, so each is found once, whatever the files; and a file gives one row
per word, not one per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.llm.common import documents, is_empty, lower_ascii
from weftline.llm.registry import query
from weftline.session import cut

#: Fixed values of the contract: letters of a run, least length and count of a word, which runs are damaged.
RUN = r"[A-Za-zÀ-ÿ]"
SHORTEST, LEAST = 7, 2
DAMAGED = 31
#: A form is at least so many times as frequent.
TIMES = 10
#: Most words of a list that is not filed anew.
GROUP = 256

_FOUND = "word string, near long, form_n long, form string"


def words_of(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, damaged: int = DAMAGED) -> DataFrame:
    """``word, n``: lower-cased runs of letters of ``docs (doc_id, text)``, some of them damaged on purpose.

    A run whose checksum with the document's id is divisible by ``damaged`` loses
    one code point. Null texts have no runs; a null id counts as the empty text.
    """
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = F.regexp_extract_all("text", F.lit(f"{RUN}{{{shortest},}}"), F.lit(0))
    run = docs.select(ids.alias("id"), F.explode(runs).alias("run")).select("id", lower_ascii(F.col("run")).alias("run"))
    sum_ = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = F.pmod(sum_, F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(sum_ % damaged == 0, short).otherwise(F.col("run")).alias("word")
    counted = run.select(word).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def first_difference(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    end = min(len(a), len(b))
    if a[:end] == b[:end]:
        return end
    low, high = 0, end
    # the prefixes of length low agree, those of length high do not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def near_pairs(ordered: list[str]) -> Iterator[tuple[int, int]]:
    """Places ``i < j`` in a sorted list of distinct words that are one edit apart."""
    count = len(ordered)
    shared = [0] * (count + 1)
    for i in range(1, count):
        shared[i] = first_difference(ordered[i - 1], ordered[i])
    shared[count] = -1
    # the next place that shares less with the one before it
    less = [count] * (count + 1)
    for i in range(count - 1, -1, -1):
        j = i + 1
        while shared[j] >= shared[i]:
            j = less[j]
        less[i] = j
    for i, word in enumerate(ordered):
        size = len(word)
        # cells for one sign less, as many and one more of the word, by signs of the word walked over
        rows = [(1, 0, 1)] * (size + 1)
        deep, j = size, i + 1
        while j < count:
            depth = min(deep, shared[j])
            other = ordered[j]
            end = len(other)
            left, same, right = rows[depth]
            while depth < end:
                sign = other[depth]
                # cell (depth + 1, depth)
                a = left if 0 < depth <= size and word[depth - 1] == sign else left + 1
                if same < a:
                    a = same + 1
                # cell (depth + 1, depth + 1)
                b = same if depth < size and word[depth] == sign else same + 1
                if right < b:
                    b = right + 1
                if a < b:
                    b = a + 1
                # cell (depth + 1, depth + 2)
                c = right if depth + 1 < size and word[depth + 1] == sign else right + 1
                if b < c:
                    c = b + 1
                left, same, right = a, b, c
                depth += 1
                if left > 1 and same > 1 and right > 1:
                    break
                if depth < len(rows):
                    rows[depth] = (a, b, c)
                else:
                    rows.append((a, b, c))
            else:
                gap = size - end
                if -1 <= gap <= 1 and (left, same, right)[gap + 1] == 1:
                    yield i, j
                deep = depth
                j += 1
                continue
            # whatever shares this prefix is more than one edit away
            deep = depth - 1
            j += 1
            while shared[j] >= depth:
                j = less[j]


def near_in_file(words: list[str], counts: list[int], size: int, lo: int, hi: int) -> list[tuple[str, int, int, str]]:
    """Per word of a file: how many near words it has there, and the most frequent one with its count."""
    # what all words of the file share is read first
    turned = lo < size - hi
    keyed = sorted((word[::-1] if turned else word, n, word) for word, n in zip(words, counts))
    found: dict[int, tuple[int, int, str]] = {}
    for i, j in near_pairs([key for key, _, _ in keyed]):
        (_, n, one), (_, m, other) = keyed[i], keyed[j]
        if min(len(one), len(other)) == size and lo <= first_difference(one, other) < hi:
            for at, count, word in ((i, m, other), (j, n, one)):
                near, neg, form = found.get(at, (0, 1, ""))
                neg, form = min((neg, form), (-count, word)) if near else (-count, word)
                found[at] = near + 1, neg, form
    return [(keyed[at][2], near, -neg, form) for at, (near, neg, form) in found.items()]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = _FOUND.replace(",", "").split()[::2]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        out: list[tuple[str, int, int, str]] = []
        for place in range(batch.num_rows):
            size, lo, hi, words, counts = (batch.column(c)[place].as_py() for c in range(5))
            out += near_in_file(words, counts, size, lo, hi)
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _spans(lo: Column, hi: Column) -> Column:
    """Both halves of a span of positions."""
    middle = F.shiftright(lo + hi, 1)
    return F.array(F.struct(lo.alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), hi.alias("hi")))


def _filed(entries: DataFrame) -> DataFrame:
    """``entries (word, n, size, lo, hi)`` under both halves of their spans, with a hash of what they must share."""
    halves = entries.select("word", "n", "size", F.explode(_spans(F.col("lo"), F.col("hi"))).alias("span"))
    halves = halves.select("word", "n", "size", "span.lo", "span.hi")
    head = F.substring("word", F.lit(1), F.col("lo"))
    tail = F.greatest(F.col("size") - F.col("hi"), F.lit(0))
    return halves.withColumn("key", F.xxhash64(head, F.substring("word", F.length("word") - tail + 1, tail)))


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``word, n_near, best_n, best``: near words of each word of ``words (word, n)`` that has some.

    ``words`` has distinct words and is read several times. ``best`` is the near
    word of largest ``n``, of these the least in code-point order.
    """
    lengths = F.array(F.length("word"), F.length("word") - 1)
    rest = words.select("word", "n", F.explode(lengths).alias("size"))
    rest = rest.select("word", "n", "size", F.lit(0).alias("lo"), (F.col("size") + 1).alias("hi"))
    file, ready = ["size", "lo", "hi", "key"], None
    while True:
        filed = _filed(rest)
        crowded = cut(filed.groupBy(*file).count().where((F.col("count") > group) & (F.col("hi") - F.col("lo") > 1)))
        last = is_empty(crowded)
        fit = filed if last else filed.join(crowded, file, "left_anti")
        ready = fit if ready is None else ready.unionByName(fit)
        if last:
            break
        rest = cut(filed.join(crowded, file, "left_semi").drop("key"))
    lists = ready.groupBy(*file).agg(F.collect_list(F.struct("word", "n")).alias("members")).where("size(members) > 1")
    lists = lists.select("size", "lo", "hi", F.col("members.word").alias("words"), F.col("members.n").alias("counts"))
    found = lists.mapInArrow(_search, _FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("neg"), F.col("form").alias("form"))).alias("best")
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("best.neg")).alias("best_n"), F.col("best.form").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every row of ``forms (word, form)``, following forms to the last one.

    ``form`` leads to ever more frequent words, so there are no circles; each
    round doubles the length of the way gone.
    """
    gone = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = gone.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if is_empty(gone.join(step, "root", "left_semi")):
            return gone
        gone = cut(gone.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root")))


def variants(words: DataFrame, times: int = TIMES, group: int = GROUP) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``words (word, n)``, whose words are distinct.

    A word's form is its near word of largest ``n`` (ties: the least in code-point
    order), if that is at least ``times`` the word's own, else null; ``root`` is
    the last of the chain of forms. An empty vocabulary gives no rows. Other
    columns of ``words`` are left out.
    """
    words = cut(words.select("word", "n"))
    found = words.join(near_words(words, group), "word", "left")
    usual = F.col("best_n") >= times * F.col("n")
    formed = cut(
        found.select(
            "word",
            F.when(usual, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(usual, F.col("best_n")).alias("form_n"),
        )
    )
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


_CRC = "SELECT i, i AS c FROM range(256) AS r(i)"
for _ in range(8):
    _CRC = f"SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM ({_CRC})"

_CHECK = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM ({_CRC})
), runs AS (
  SELECT doc_id, run, count(*) AS times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h
  FROM (SELECT doc_id, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run
        FROM documents) WHERE length(run) >= {SHORTEST} GROUP BY ALL
), summed AS (
  SELECT run, times, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT))),
           lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]))) AS s
  FROM runs, crc_table
), results AS (
  SELECT CASE WHEN s % {DAMAGED} = 0 THEN run[1 : s % length(run)] || run[s % length(run) + 2 :] ELSE run END AS word, times
  FROM summed
), words AS MATERIALIZED (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM results WHERE length(word) >= {SHORTEST}
  GROUP BY word HAVING sum(times) >= {LEAST}
), shorter AS MATERIALIZED (
  SELECT word, n, i, word[1 : i - 1] AS head, word[i + 1 :] AS tail FROM words, unnest(range(1, length(word) + 1)) AS t(i)
), pairs AS (
  SELECT a.word AS a, b.word AS b, b.n AS m FROM shorter a JOIN shorter b USING (i, head, tail) WHERE a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON w.word = s.head || s.tail
  UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON w.word = s.head || s.tail
), best AS (
  SELECT a, count(*) AS n_near, max(m) AS most FROM pairs GROUP BY a
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {TIMES} * n THEN most END AS form_n,
         CASE WHEN most >= {TIMES} * n THEN (SELECT min(b) FROM pairs WHERE pairs.a = word AND m = most) END AS form
  FROM words LEFT JOIN best ON a = word
), walked AS (
  SELECT word, word AS reached, form AS next FROM forms
  UNION ALL SELECT walked.word, forms.word, forms.form FROM walked JOIN forms ON forms.word = walked.next
)
SELECT word, form, reached AS root, n, n_near, form_n FROM forms JOIN (SELECT word, reached FROM walked WHERE next IS NULL) USING (word)
"""


@query("op11_spelling_variants", _CHECK)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents."""
    return variants(words_of(documents(spark, sf_dir).select("doc_id", "text")))
