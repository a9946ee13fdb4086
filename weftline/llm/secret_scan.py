"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is a long run of letters, digits and the signs of usual encodings
with at least one digit. What a person would look at becomes features: its length
and its changes between kinds of characters, how much of it the corpus' own most
frequent words cover, where it was found, and the words around it. The forest is
trained on labelled findings; ``weak_labels`` gives those that need no judge.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.llm.common import SPACE_CLASS, documents, lower_ascii
from weftline.llm.registry import query
from weftline.session import cut

SHORTEST = 16
CANDIDATE = rf"[A-Za-z0-9+/_=.\-]{{{SHORTEST},}}"
#: What a run starts with if it gives a name to a value that is itself long and has a digit.
ASSIGNMENT = rf"^(?:[A-Za-z_][A-Za-z0-9_.\-]*=)+(?=[^=].{{{SHORTEST - 1}}})(?=.*[0-9])"
#: Names that secrets are assigned to.
NAMES = r"(?i)(token|secret|passw|pwd|api|key|auth|credential|bearer)"
#: Most frequent words taken as the dictionary, and their shortest length.
DICTIONARY = 1_000
DICTIONARY_WORD = 3
#: Sources are told apart in so many groups.
PATHS = 16
#: At most so many labelled findings are used for training, those with the least hashes.
LABELLED = 50_000
TREES, DEPTH, SEED = 20, 6, 7

FEATURES = ["length", "digits", "upper", "changes", "hexadecimal", "coverage", "path", "quoted", "assigned", "named", "alone"]


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, source, at, before, name, after, word, run, candidate, lead, trail`` for every candidate of ``docs (doc_id, source, text)``.

    ``at`` counts the words before it, ``word`` is the candidate with the signs
    around it, ``before``, ``name`` and ``after`` are the words next to it, one
    and two before it and one after it, empty at the ends. Null and empty texts
    have none. ``run`` counts the long runs of the word before this one, with or
    without a digit; ``lead`` is what stands in the word since the run before that
    one began, with the name where the run gives one to its value, and ``trail``
    what follows, up to the next run's first sign. The candidate is without the name.
    """

    def of_words(words: Column) -> Column:
        def around(word: Column, at: Column) -> Column:
            near = [F.coalesce(F.get(words, at + i), F.lit("")) for i in (-1, -2, 1)]
            fields = [near[0].alias("before"), near[1].alias("name"), near[2].alias("after")]
            shaped = (F.length(word) >= SHORTEST) & word.rlike("[0-9]") & word.rlike(CANDIDATE)
            return F.when(shaped, F.struct(at.alias("at"), word.alias("word"), *fields))

        return F.array_compact(F.transform(words, around))

    found = _let(F.split("text", f"[{SPACE_CLASS}]+"), of_words)
    rows = docs.select("doc_id", "source", F.inline(found))
    runs = F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))
    rows = rows.withColumn("runs", runs).withColumn("gaps", F.split("word", CANDIDATE, -1))
    each = rows.select("*", F.posexplode("runs").alias("run", "whole")).where(F.col("whole").rlike("[0-9]"))
    each = each.withColumn("candidate", F.regexp_replace("whole", ASSIGNMENT, ""))
    name = F.expr("left(whole, length(whole) - length(candidate))")
    earlier = F.when(F.col("run") > 0, F.get("runs", F.col("run") - 1)).otherwise("")
    following = F.get("gaps", F.col("run") + 1)
    last = F.col("run") == F.size("runs") - 1
    return each.select(
        *rows.drop("runs", "gaps").columns,
        "run",
        "candidate",
        F.concat(earlier, F.get("gaps", "run"), name).alias("lead"),
        F.when(last, following).otherwise(F.substring(following, 1, 1)).alias("trail"),
    )


def dictionary(docs: DataFrame, words: int = DICTIONARY) -> DataFrame:
    """One row with ``known``, the ``words`` most frequent words of the whole corpus (ties by code point)."""
    every = docs.select(F.explode(F.split(lower_ascii(F.col("text")), "[^a-z]+")).alias("known"))
    counts = every.where(F.length("known") >= DICTIONARY_WORD).groupBy("known").count()
    top = counts.orderBy(F.desc("count"), "known").limit(words)
    return top.agg(F.collect_list("known").alias("known"))


def _share(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]", "")) / F.length(text)


def features(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` with the columns of ``FEATURES``. ``known`` is one bounded row, what :func:`dictionary` returns."""
    text = F.col("candidate")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a")
    changes = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1
    words = known.first()["known"]
    first = F.col("run") == 0
    near = F.concat("lead", text, "trail")
    given = near.rlike("^[A-Za-z_]+[=:]") | F.col("lead").rlike("[=:][\"'`]?$")
    lowered = lower_ascii(text)
    # each dictionary word that occurs is blanked out; what is blank in the end is covered
    dictionary_words = F.lit(words) if words else F.array().cast("array<string>")
    left = F.aggregate(dictionary_words, lowered, lambda rest, word: F.replace(rest, word, F.lit(" ")))
    return found.select(
        "*",
        F.length(text).cast("double").alias("length"),
        _share(text, "0-9").alias("digits"),
        _share(text, "A-Z").alias("upper"),
        (changes / F.length(text)).alias("changes"),
        _share(text, "0-9a-fA-F").alias("hexadecimal"),
        (1 - F.length(F.replace(left, F.lit(" "), F.lit(""))) / F.length(text)).alias("coverage"),
        F.pmod(F.hash("source"), F.lit(PATHS)).cast("double").alias("path"),
        near.rlike("[\"'`]").cast("double").alias("quoted"),
        (first & (F.col("before").rlike("^[=:]+$") | F.col("before").rlike("[=:]$")) | given).cast("double").alias("assigned"),
        (first & (F.col("before").rlike(NAMES) | F.col("name").rlike(NAMES)) | near.rlike(NAMES)).cast("double").alias("named"),
        (F.col("candidate") == F.col("word")).cast("double").alias("alone"),
    )


def weak_labels(found: DataFrame) -> DataFrame:
    """``found`` with ``label`` 1, 0 or null.

    A quoted value assigned to a name of secrets is one; a candidate of digits
    only, or one with dots, that nothing assigns is none; the rest is not known.
    """
    positive = (F.col("quoted") == 1) & (F.col("assigned") == 1) & (F.col("named") == 1)
    plain = F.col("candidate").rlike(r"^[0-9.\-]+$") | F.col("candidate").contains(".")
    negative = (F.col("assigned") == 0) & plain
    return found.withColumn("label", F.when(positive, F.lit(1.0)).when(negative, F.lit(0.0)))


def train(findings: DataFrame, rows: int = LABELLED) -> RandomForestClassificationModel | None:
    """The forest for labelled findings (``FEATURES`` and ``label``); none if only one label occurs."""
    labelled = findings.where("label is not null").select(*FEATURES, "label")
    used = cut(labelled.orderBy(F.xxhash64(*FEATURES), *FEATURES, "label").limit(rows))
    if used.select("label").distinct().count() < 2:
        return None
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(used)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False)
    return forest.fit(assembled)


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """The candidates of ``docs (doc_id, source, text)`` with ``probability`` that they are secrets.

    ``findings`` are labelled ones for training, with the columns of ``FEATURES``
    and ``label``; by default those that :func:`weak_labels` knows in ``docs``.
    Without both kinds of labels nothing is learned and the probability is 1.
    Repeated rows are found as often; an empty table has no candidates.
    """
    found = cut(features(cut(candidates(docs)), dictionary(docs)))
    model = train(weak_labels(found) if findings is None else findings)
    if model is None:
        return found.withColumn("probability", F.lit(1.0))
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
    scored = model.transform(assembled).withColumn("probability", vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "prediction")


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets found in all documents; the values themselves only as checksums."""
    found = scan(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return found.where("probability >= 0.5").select(
        "doc_id",
        "at",
        "run",
        F.col("length").cast("int").alias("length"),
        F.sha2(F.col("candidate").cast("binary"), 256).alias("secret_sha256"),
        F.round("probability", 4).alias("probability"),
    )
