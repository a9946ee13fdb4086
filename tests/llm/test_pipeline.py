"""The pipeline's stages one by one on the smallest tables."""

import itertools
import random
import re

import corpus_pipeline
from weftline.llm import mixing, near_copies, simhash, wu_manber
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, SF).cache()
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "sharding":
            assert docs.columns == columns
        if name == "simhash_near_dedup":
            assert docs.count() == len(seen[name])
    items = [(r["item_id"], r["text"].encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    patterns = wu_manber.compile_patterns((str(i), t) for i, t in items)
    left = [r["text"] for r in docs.collect()]
    assert left and not any(wu_manber.find(t.encode(), patterns)[1] for t in left)
    assert docs.where("shard between 0 and 15").count() == len(left)
    kept = docs.agg(F.sum(mixing.size_of(F.col("text")))).first()[0]
    words = sum(len(re.findall(r"\S+", t)) for t in left)
    assert abs(kept - words) < 0.01 * words


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 13
    assert "pipeline" not in __spark_entry__.oracle_sql()


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(docs):
    """The least id of each class of five-word similarity 0.8 or more, all pairs compared, and the non-identical pairs."""
    sets = {i: shingles(t) for i, t in docs}
    least, pairs = {i: i for i in sets}, 0

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)):
            both = len(x & y)
            if x == y or both >= 0.8 * (len(x) + len(y) - both):
                pairs += x != y
                one, other = sorted((root(a), root(b)))
                least[other] = one
    return {root(i) for i in sets}, pairs


def test_near_copies_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept, pairs = brute_kept([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "/root/testdata/sf0.01")
    assert pairs and {r["doc_id"] for r in got.select("doc_id").collect()} == kept


def test_near_copies_of_one_crowded_group(spark):
    """Sixty copies of one text with a few words changed, and forty that share half of another: many blocks where these are small."""
    rng = random.Random(5)
    base, half = [[f"{c}{i}" for i in range(200)] for c in "ab"]
    texts = [[f"x{k}" if rng.random() < 0.01 else w for w in base] for k in range(60)]
    texts += [half[:120] + [f"y{k}z{i}" for i in range(80)] for k in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "two words"), (903, "Two  words")]
    kept, pairs = brute_kept(rows)
    for crowd in (2_000, near_copies.CROWD):
        got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), crowd)
        assert pairs > 60 and {r["doc_id"] for r in got.collect()} == kept


def test_no_link_of_a_loose_group_is_lost(spark):
    """Eight hundred texts of which each word was changed with probability 0.012: many are only like a few of the others."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join(w if rng.random() >= 0.012 else f"x{rng.randrange(10**6)}" for w in base), 1, 2) for i in range(800)]
    kept, pairs = brute_kept([row[:2] for row in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, shingles int")
    got = near_copies.one_of_each(docs, 40_000)
    assert got.columns == docs.columns and pairs > 10_000 and 40 < len(kept) < 100
    assert {r["doc_id"] for r in got.collect()} == kept


def test_stages_on_odd_documents(spark):
    """Null ids, texts and sources, repeated rows and an empty table pass through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "One two three", "en", "a", 13), (1, "One two three", "en", "a", 13), (None, "lost words", None, None, None), (2, None, "en", "b", 0), (3, "", "en", None, 0)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF).cache()
            assert name == "sharding" or docs.columns == columns
            docs.count()


def test_simhash_gives_the_first_links(spark, monkeypatch):
    """Long texts with one word changed, linked by their fingerprints alone; the search lists what all pairs within two bits connect."""
    rng = random.Random(11)
    texts = []
    for group in range(6):
        words = [f"{group}w{rng.randrange(10**6)}" for _ in range(2_000)]
        texts += [" ".join([*words[:k], f"x{k}", *words[k + 1 :]]) for k in range(0, 400, 40)]
    texts += [texts[0].upper(), "two words", "Two  words", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    sketches = near_copies.sketched(docs)
    sims = {r["fp"]: r["sim"] for r in sketches.where("n > 0").collect()}
    assert sims[near_copies.set_id(near_copies.shingle_set(b"two words"))] == simhash.simhash(b"two words", near_copies.SHINGLE)
    nodes = sketches.groupBy("fp").agg(*[F.first(c).alias(c) for c in ("sim", "n")])
    got = {tuple(sorted((r["a"], r["b"]))) for r in near_copies._by_simhash(nodes).collect()}
    close = {(a, b) for a, b in itertools.combinations(sorted(sims), 2) if ((sims[a] ^ sims[b]) & (1 << 64) - 1).bit_count() <= 2}
    assert got and got <= {(a, b) for a, b in itertools.combinations(sorted(sims), 2)}

    def classes(pairs):
        least = {i: i for i in sims}
        for _ in sims:
            for a, b in pairs:
                least[a] = least[b] = min(least[a], least[b])
        return least

    assert classes(got) == classes(close)
    plain = near_copies._entries
    monkeypatch.setattr(near_copies, "_entries", lambda *given: plain(*given).where("false"))
    assert near_copies.links(docs, sketches).count() >= len(sims) - len(set(classes(close).values())) > 0
