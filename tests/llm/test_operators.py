"""The operators against brute force, with nulls, empty texts, repeated rows and clashing columns."""

import collections
import hashlib
import math
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from weftline.llm import mixing, ppm, resampling, secret_scan, sharding, simhash, syncmers, viterbi, wu_manber
from weftline.llm import line_windows
from weftline.llm.all_queries import CHECKS, QUERIES
from weftline.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, hash string"

LONG = " ".join(f"w{i % 97}" for i in range(30_000))
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "a"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "a"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "a"),
    (3, None, "b"),
    (4, "", None),
    (None, "one two", None),
    (None, "one two", "b"),
    (5, LONG, "c"),
    (6, " \t\n ", "c"),
    (7, "x\ny\nz\nx\ny\nz\nx\ny\nz", "c"),
    (8, "é ß 漢字 x\ny\nz", "a"),
    (9, "q " * 40, None),
]


def frame(spark, rows):
    """Documents with columns that clash with those the operators add."""
    return spark.createDataFrame([(i, t, "xx", s, None, 7, 3, "h") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- 10: SimHash ---------------------------------------------------------------------------


def brute_simhash(text):
    words = re.findall(r"[^ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    ordered = sorted(prints)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    return {p: root(p) for p in prints}


def brute_near(docs):
    prints = [(i, brute_simhash(t)) for i, t in docs]
    roots = brute_classes({p for _, p in prints})
    least = {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    return sorted(((i, p, least.get(roots[p])) for i, p in prints), key=str)


def test_near_duplicates_odd_rows(odd, none):
    got = [(i, p & (1 << 64) - 1, c) for i, p, c in simhash.near_duplicates(odd.select("doc_id", "text")).collect()]
    assert sorted(got, key=str) == brute_near([(i, t) for i, t, _ in ODD])
    assert rows(simhash.near_duplicates(none.select("doc_id", "text"))) == []


def test_op10_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [(i, int(p, 16), c) for i, p, c in QUERIES["op10_simhash_near_dedup"](spark, SF).collect()]
    assert sorted(got, key=str) == brute_near(docs)


@pytest.mark.parametrize("bucket", [1, 4, 1000])
def test_classes_of_crowded_buckets(spark, bucket):
    """A cloud of fingerprints that share segments: small buckets take the exact way, large ones are paired."""
    rng = np.random.default_rng(3)
    center = int(rng.integers(1 << 62))
    cloud = {center ^ sum(1 << int(b) for b in rng.choice(14, rng.integers(0, 6), replace=False)) for _ in range(150)}
    cloud |= {int(x) for x in rng.integers(1 << 62, size=40)}
    cloud |= {c ^ (1 << 40) ^ (1 << 60) for c in list(cloud)[:20]}
    signed = [c - (1 << 64) if c >> 63 else c for c in cloud]
    found = simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"), bucket)
    root = dict(map(tuple, components(found).collect()))
    want = brute_classes(cloud)
    mask = (1 << 64) - 1
    mine, theirs = collections.defaultdict(set), collections.defaultdict(set)
    for c in signed:
        mine[root.get(c, c)].add(c & mask)
        theirs[want[c & mask]].add(c & mask)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = collections.Counter(r["root"] for r in found)
    assert sorted(groups.values()) == [2, 301]


def test_one_of_each(odd, none):
    kept = rows(simhash.one_of_each(odd).select("doc_id", "text", "size", "hash"))
    # one of 1 and 2; empty texts are one class and 3 has its least id; the rows without id are one
    assert [r[0] for r in sorted(kept, key=lambda r: (r[0] is None, r[0]))] == [1, 3, 5, 7, 8, 9, None]
    assert simhash.one_of_each(odd).columns == odd.columns
    assert rows(simhash.one_of_each(none)) == []


# --- 2: Wu-Manber --------------------------------------------------------------------------


def brute_hits(text, items, window=10):
    found = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    hit, names = set(), set()
    for name, item in items:
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (item or "").encode().lower())
        length = min(window, len(words))
        for at in range(len(words) - length + 1 if length else 0):
            for start in range(len(found) - length + 1):
                if found[start : start + length] == words[at : at + length]:
                    hit |= set(range(start, start + length))
                    names.add("" if name is None else str(name))
    return len(found), len(hit), sorted(names)


ITEMS = [(1, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "one TWO"), (3, None), (None, "x"), (2, "y z")]


def test_search_odd_rows(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found, name = wu_manber.search(odd, items)
    got = found.select(
        "text", F.col(name)["n_words"], wu_manber.hit_words(F.col(name)["spans"]), F.col(name)["items"]
    ).collect()
    assert len(got) == len(ODD)
    for text, n, hit, names in got:
        assert (n, hit, sorted(names)) == brute_hits(text, ITEMS)
    assert rows(wu_manber.clean(none, items)) == []
    assert wu_manber.clean(odd, items.limit(0)).count() == len(ODD)
    assert wu_manber.clean(odd, items).columns == odd.columns


def test_packs_find_the_same(spark, odd, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want, name = wu_manber.search(odd, items)
    want = rows(want.select("doc_id", name))
    monkeypatch.setattr(wu_manber, "PACK", 8)
    got, name = wu_manber.search(odd, items)
    assert rows(got.select("doc_id", name)) == want


def test_a_full_pack_of_different_words_is_small():
    words = [f"word{i * 7919 % 700_001}" for i in range(wu_manber.PACK)]
    items = [(f"item{i}", " ".join(words[i : i + 5_000]).encode()) for i in range(0, len(words), 5_000)]
    tracemalloc.start()
    pack = wu_manber.compile_patterns(items)
    size = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size < 300 << 20
    assert wu_manber.find(" ".join(words[5_003:5_020]).encode(), pack) == (17, [[0, 17]], ["item5000"])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=4))
def test_wu_manber_against_direct_search(text, items):
    named = [(str(i), " ".join(item)) for i, item in enumerate(items)]
    n, spans, names = wu_manber.find(" ".join(text).encode(), wu_manber.compile_patterns((i, t.encode()) for i, t in named))
    assert (n, sum(b - a for a, b in spans), names) == brute_hits(" ".join(text), named)


# --- 3: mixing -----------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if epochs * sizes[s] < left * weight[s] / total}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: float(epochs * sizes[s]) for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def test_taken_odd_rows(odd, none):
    got = mixing.taken(odd).collect()
    assert len(got) == len(ODD)
    size = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    sizes = collections.Counter()
    for _, t, s in ODD:
        sizes[s] += size(t)
    target = brute_targets(sizes)
    assert sorted({(r["source_size"], round(r["target"], 6)) for r in got}) == sorted(
        {(sizes[s], round(target[s], 6)) for s in sizes}
    )
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by_target = collections.Counter()
    for r in got:
        by_target[r["source_size"], r["target"]] += r["taken"]
    for (_, goal), words in by_target.items():
        assert goal - 2 <= words <= goal
    assert rows(mixing.taken(odd)) == sorted(map(tuple, got), key=str)
    assert rows(mixing.taken(none)) == []


def test_mix_has_the_words_that_are_taken(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = F.sum(mixing.size_of(F.col("text")))
    got = dict(map(tuple, mixing.mixed(docs).groupBy("doc_id").agg(words).collect()))
    want = {r["doc_id"]: r["taken"] for r in mixing.taken(docs).collect() if r["taken"]}
    assert {k: v for k, v in got.items() if v} == want
    mix = mixing.mixed(odd)
    assert mix.columns == odd.columns and mix.agg(words).first()[0] > 0
    assert rows(mixing.mixed(none)) == []


# --- 7: sharding ---------------------------------------------------------------------------


def brute_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_odd_rows(odd, none):
    got = sharding.sharded(odd).collect()
    assert len(got) == len(ODD)
    want = {i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:16], 16) for i, _, _ in ODD}
    slots = collections.defaultdict(list)
    for r in got:
        assert r["shard"] == brute_jump(want[r["doc_id"]], 16)
        assert r["grown_shard"] == brute_jump(want[r["doc_id"]], 17)
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    checks = sorted((zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for _, t, _ in ODD)
    assert sorted((r["text_crc32"], r["size"]) for r in got) == checks
    assert rows(sharding.sharded(none)) == []


def test_jump_hash_moves_only_into_new_shards(spark):
    ids = spark.range(3000).select(
        *[sharding.shard_of(F.col("id"), n).alias(f"s{n}") for n in (1, 5, 6, 40)], F.col("id")
    )
    for r in ids.collect():
        key = int(hashlib.md5(str(r["id"]).encode()).hexdigest()[:16], 16)
        assert [r["s1"], r["s5"], r["s6"], r["s40"]] == [brute_jump(key, n) for n in (1, 5, 6, 40)]


# --- 5: syncmers ---------------------------------------------------------------------------


def test_fingerprints_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 3)
    plain = frame(spark, [r for r in ODD if r[0] is not None and r[0] != 2])
    got = {r["doc_id"]: r for r in syncmers.fingerprints(plain).collect()}
    order = sorted(((i, t or "") for i, t, _ in ODD if i is not None and i != 2), reverse=True)
    parts = lambda f: set(f.split())
    for at, (i, text) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((r["edited_fingerprint"], "near_edited"), (got[order[(at + 1) % len(order)][0]]["fingerprint"], "near_next")):
            a, b = parts(r["fingerprint"]), parts(other)
            assert r[near] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert syncmers.fingerprints(odd).count() == len(ODD)
    assert rows(syncmers.fingerprints(none)) == []


def test_syncmers_do_not_depend_on_what_stands_around(spark):
    passage = " ".join(f"p{i * i % 61}" for i in range(60))
    texts = spark.createDataFrame([(passage,), (f"x y z {passage} u v w",)], "text string")
    alone, inside = (r[0] for r in texts.select(syncmers.anchors(F.col("text"))).collect())
    assert 10 < len(alone) < 50 and str(alone)[1:-1] in str(inside)


# --- 9: line windows -----------------------------------------------------------------------


def test_lines_odd_rows(odd, none):
    got = line_windows.deduplicated(odd)
    assert [c for c in got.columns if c not in odd.columns] == ["n_lines", "n_removed"]
    by_id = collections.defaultdict(list)
    for r in got.collect():
        by_id[r["doc_id"]].append((r["text"], r["n_lines"], r["n_removed"]))
    assert by_id[7] == [("x\ny\nz", 9, 6)]
    assert by_id[3] == [(None, 0, 0)] and by_id[4] == [("", 1, 0)]
    assert len(by_id[2]) == 2 and by_id[2][0] == by_id[2][1]
    assert rows(line_windows.deduplicated(none)) == []


# --- 4: PPM --------------------------------------------------------------------------------


def brute_scores(docs, order=ppm.ORDER):
    out = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs]
    counts, known = collections.defaultdict(collections.Counter), collections.Counter()
    coded = [(t or "").encode().lower().split() for _, t in docs]
    for held, words in zip(out, coded):
        if not held:
            text = b"\xfe" * order + b" ".join(words) + b"\xff"
            for at in range(order, len(text)):
                for k in range(order + 1):
                    counts[text[at - k : at]][text[at]] += 1
            known.update([*words, None])
    total, distinct = sum(known.values()), len(known)

    def symbol(context, byte):
        gone, logp = set(), 0.0
        for k in range(order, -1, -1):
            seen = {b: n for b, n in counts.get(context[order - k :], {}).items() if b not in gone}
            if byte in seen:
                return logp + math.log10((2 * seen[byte] - 1) / (2 * sum(seen.values())))
            if seen:
                logp += math.log10(len(seen) / (2 * sum(seen.values())))
            gone |= set(seen)
        return logp - math.log10(256 - len(gone))

    cache = {}
    for (i, _), held, words in zip(docs, out, coded):
        text = b"\xfe" * order + b" ".join(words) + b"\xff"
        score = 0.0
        for at in range(order, len(text)):
            key = text[at - order : at], text[at]
            if key not in cache:
                cache[key] = symbol(*key)
            score += cache[key]
        base = sum(math.log10((known[w] + 1) / (total + distinct + 1)) for w in [*words, None])
        yield i, held, len(words) + 1, sum(known[w] > 0 for w in [*words, None]), total, base, score


def test_scores_odd_rows(spark, odd, none):
    docs = [(i, t) for i, t, _ in ODD] + [(i, "one more word here") for i in range(20, 40)]
    made = frame(spark, [(i, t, "a") for i, t in docs]).select("doc_id", "text")
    names = "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    key = lambda r: (str(r[:5]), r[5])
    got = sorted((tuple(r[n] for n in names) for r in ppm.score(made).collect()), key=key)
    want = sorted(brute_scores(docs), key=key)
    assert any(r[1] for r in want) and not all(r[1] for r in want)
    for mine, theirs in zip(got, want, strict=True):
        assert mine[:5] == theirs[:5] and mine[5:] == pytest.approx(theirs[5:])
    assert rows(ppm.score(none.select("doc_id", "text"))) == []


def test_op4_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK", 100_000)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op4_ppm_scores"](spark, SF).collect()}
    for i, held, n, known, total, base, score in brute_scores(docs):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert (r["base_score"], r["score"]) == (pytest.approx(base), pytest.approx(score))


# --- 8: Viterbi ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return viterbi.read_vocabulary(viterbi.default_path())


@pytest.fixture(scope="module")
def tokenizer(vocabulary):
    from tokenizers import Tokenizer, models

    bytes_ = [(f"<0x{b:02X}>", min(s for _, s in vocabulary.pieces)) for b in range(256)]
    return Tokenizer(models.Unigram([("<unk>", 0.0), *bytes_, *vocabulary.pieces], 0, True))


def test_counts_match_the_public_tokenizer(spark, vocabulary, tokenizer):
    counter = viterbi.Counter(vocabulary)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    for text in [*texts, "a", "  two  spaces ", "\n\t\x01", "漢字 é", "aaaa" * 50, "▁▁x"]:
        want = tokenizer.encode(("▁" + text).replace(" ", "▁")).ids
        assert counter.count(text)[0] == len(want)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab c", max_size=12), st.dictionaries(st.text(alphabet="abc▁", min_size=1, max_size=4), st.integers(-4, 0), max_size=8))
def test_counts_of_small_vocabularies(text, pieces):
    """Every segmentation is tried; ties follow the first start, position by position."""
    vocabulary = viterbi.Vocabulary([(p, float(s)) for p, s in pieces.items()], False)
    from tokenizers import Tokenizer, models

    if not pieces or not text:
        return
    exact = Tokenizer(models.Unigram([("\x00", 0.0), *vocabulary.pieces], 0, False))
    assert viterbi.Counter(vocabulary).count(text)[0] == len(exact.encode(("▁" + text).replace(" ", "▁")).ids)


def test_counts_odd_rows(odd, none):
    got = viterbi.token_counts(odd.select("doc_id", "text"))
    assert got.count() == len(ODD)
    assert [tuple(r)[1:] for r in got.where("doc_id in (3, 4)").collect()] == [(0, 0.0)] * 2
    assert rows(viterbi.token_counts(none)) == []


# --- 6: resampling -------------------------------------------------------------------------


def labelled_corpus(spark, n=400):
    good = [(i, " ".join(f"fine{(i * 7 + j) % 50}" for j in range(40)), "a") for i in range(n)]
    bad = [(n + i, " ".join(["awful" if j % 9 == 0 else f"fine{(i + j) % 50}" for j in range(40)]), "b") for i in range(n // 4)]
    labels = [(i, int(i < n), 0) for i, _, _ in good + bad if i % 3 == 0]
    return frame(spark, good + bad + [(None, None, None), (None, "", None)]), labels


def test_resampling_keeps_clean_and_drops_bad(spark, odd, none):
    docs, labels = labelled_corpus(spark)
    judged = spark.createDataFrame(labels + [(0, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = [r["doc_id"] for r in resampling.resample(spark, docs, judged).collect()]
    assert sorted(kept, key=str) == sorted([*range(400), None, None], key=str)
    assert resampling.resample(spark, docs, judged).columns == docs.columns
    assert resampling.resample(spark, odd, judged.limit(0)).count() == len(ODD)
    assert rows(resampling.resample(spark, none, judged)) == []


def test_op6_held_out_accuracy(spark, tmp_path):
    """Models and cut are fitted on two thirds of the labels; the others are told apart.

    On 10,000 documents: 1,000 leave too few of each kind of junk to learn from (README).
    """
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r["doc_id"] for r in resampling.resample(spark, docs, labels.where("doc_id % 3 <> 0")).collect()}
    held = labels.where("doc_id % 3 = 0").collect()
    junk = [r["doc_id"] not in kept for r in held if r["quality"] == 0]
    clean = [r["doc_id"] in kept for r in held if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(clean) / len(clean) > 0.95 and sum(junk) / len(junk) > 0.7


def test_resampling_rejects_repetitive_junk(spark):
    """Of documents that mostly double words, what is labelled bad goes, and nearly all that nobody labelled."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r["doc_id"] for r in resampling.resample(spark, docs, labels).collect()}
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}

    def repetitive(text):
        tokens = resampling._TOKEN.findall((text or "").encode())
        return sum(a == b for a, b in zip(tokens, tokens[1:])) > 0.6 * len(tokens) > 0

    junk = {r["doc_id"] for r in docs.select("doc_id", "text").collect() if repetitive(r["text"])}
    assert junk & bad and not junk & bad & kept
    assert len(junk & kept) < 0.02 * len(junk)


def test_resampling_reads_the_order_and_the_number_of_words(spark):
    words = [f"w{i}" for i in range(50)]
    texts = [(i, " ".join((words * 2)[i % 50 : i % 50 + 40])) for i in range(300)]
    texts += [(300 + i, " ".join((words * 2)[i % 50 : i % 50 + 40][::-1])) for i in range(90)]
    docs = frame(spark, [(i, t, "a") for i, t in texts])
    judged = spark.createDataFrame([(i, int(i < 300), 0) for i, _ in texts if i % 3 == 0], "doc_id long, quality int, toxic int")
    assert {r["doc_id"] for r in resampling.resample(spark, docs, judged).collect()} == set(range(300))
    once, often = (resampling.features(t.encode())[1] for t in ("a b", "a b a b a b"))
    # a, b and "a b" three times, "b a" twice, and the class
    three, two = (round(1024 * (1 + math.log(n))) for n in (3, 2))
    assert once.tolist() == [1024] * 4 and sorted(often) == [1024, two, three, three, three]


# --- 1: secrets ----------------------------------------------------------------------------


def test_secrets(spark, odd, none):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(60)]
    texts = [(i, f'some words token = "{h}" more words', "a") for i, h in enumerate(hexes)]
    texts += [(100 + i, f"call 4{i:015d} or write mail.{i:012d}.example.org today", "b") for i in range(60)]
    texts += [(300, None, None), (301, "", None)]
    docs = frame(spark, texts)
    found = secret_scan.scan(docs)
    secrets = {r["candidate"] for r in found.where("probability >= 0.5").collect()}
    assert secrets == set(hexes)
    assert found.count() >= 120
    assert rows(secret_scan.scan(none)) == []
    assert secret_scan.scan(odd).count() == 0


def test_every_long_run_of_a_word_is_a_candidate(spark):
    one, two, three = "wJalrXUtnFEMI7K7MDENGbPxRfiCY", "s3cr3tPassw0rdOfTheDay", "q1w2e3r4t5y6u7i8o9"
    texts = [
        f'aws_secret_access_key="{one}"',
        f'DATABASE_PASSWORD="{two}"',
        f"see //example.com/some/path?token={one} there",
        f'{{"user":"{three}","token":"{one}"}}',
        f"secret_token={one}",
        "key1=abcdefabcdefabcdef",
    ]
    want = [(0, 1, one), (1, 1, two), (2, 1, one), (3, 0, three), (3, 1, one), (4, 0, one), (5, 0, "key1=abcdefabcdefabcdef")]
    found = secret_scan.features(secret_scan.candidates(frame(spark, [(i, t, "a") for i, t in enumerate(texts)])), spark.createDataFrame([([],)], "known array<string>"))
    got = {(r["doc_id"], r["run"], r["candidate"]): (r["quoted"], r["assigned"], r["named"]) for r in found.collect()}
    assert sorted(got) == want
    assert [got[w] for w in want] == [(1, 1, 1), (1, 1, 1), (0, 1, 1), (1, 1, 0), (1, 1, 1), (0, 1, 1), (0, 0, 1)]


def test_op1_finds_every_assigned_token(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    want = {
        (r["doc_id"], hashlib.sha256(m.encode()).hexdigest())
        for r in docs
        for m in re.findall(r'(?i)token = "([0-9a-f]{40})"', r["text"] or "")
    }
    got = {(r["doc_id"], r["secret_sha256"]) for r in QUERIES["op1_secret_scan"](spark, "/root/testdata/sf0.01").collect()}
    assert want and want == got


# --- check texts ---------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_check_text(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = connection.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    want = sorted(tuple(str(dict(zip(names, row))[n]) for n in order) for row in result.fetchall())
    assert sorted(tuple(str(r[n]) for n in order) for r in got.collect()) == want


def test_windows_are_counted_the_same_in_any_chunks(monkeypatch):
    texts = [b"one two  three", b"", b"two three two", b" ", b"one", b"x" * 500] * 7
    whole = collections.Counter(ppm.windows(texts)[0].tolist())
    for chunk in (1, 50, 1 << 19):
        monkeypatch.setattr(ppm, "CHUNK", chunk)
        keys, counts = ppm._distinct(texts)
        assert dict(zip(keys.tolist(), counts.tolist())) == whole
        assert (np.diff(keys) > 0).all()
    assert [len(part) for part in ppm._distinct([])] == [0, 0]
