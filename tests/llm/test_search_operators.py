"""Spelling variants, hard negatives and id files against plain versions."""

import collections
import math
import random
import uuid
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from weftline.llm import hard_negatives, id_files, line_windows, variants
from weftline.llm.all_queries import CHECKS, QUERIES
from weftline.session import checkpoint_dir

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_hard_negatives"])
def test_query(spark, name):
    oracle = duckdb.connect()
    for table in ("documents", "embeddings"):
        oracle.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = oracle.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    want = result.fetchall()
    assert want and rows(got.select(*names)) == sorted(want, key=str)


# --- 11: spelling variants -----------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, times=10):
    out, forms = [], {}
    for word, n in counts.items():
        near = [(-m, other) for other, m in counts.items() if one_edit(word, other)]
        best = min(near, default=(0, None))
        if near and -best[0] >= times * n:
            forms[word] = best[1]
        out.append((word, n, len(near), -best[0] if word in forms else None))
    done = []
    for word, n, near, most in out:
        root = word
        while root in forms:
            root = forms[root]
        done.append((word, forms.get(word), root, n, near, most))
    return sorted(done, key=str)


@given(st.lists(st.text("abc", max_size=7), max_size=40, unique=True))
@settings(max_examples=300, deadline=None)
def test_sorted_list_finds_all_pairs(words):
    words = sorted(words)
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])}
    got = list(variants.near_pairs(words))
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("group", [2, 16, 256])
def test_variants_of_a_crowded_vocabulary(spark, group):
    deal = random.Random(5)
    words = {"".join(deal.choice("abé") for _ in range(deal.randint(6, 8))) for _ in range(500)}
    # a chain of forms, and ties for the most frequent near word
    words |= {"zzzzzzz", "zzzzzzy", "zzzzzxy", "zzzzwxy", "qqqqqqa", "qqqqqqb", "qqqqqqc"}
    counts = {word: deal.choice([1, 2, 10, 25]) for word in sorted(words)}
    counts |= {"zzzzzzz": 10_000, "zzzzzzy": 1_000, "zzzzzxy": 100, "zzzzwxy": 10, "qqqqqqa": 50, "qqqqqqb": 50, "qqqqqqc": 5}
    table = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, root string")
    assert rows(variants.variants(table, group=group)) == brute_variants(counts)


def test_words_of_odd_documents(spark):
    long = "b" * 20_000
    docs = [
        (1, "Strasse STRASSE strasse, Größere größere GRÖßERE kurz ab"),
        (1, "Strasse STRASSE strasse, Größere größere GRÖßERE kurz ab"),
        (2, None),
        (3, ""),
        (None, "nowhere nowhere"),
        (4, f"{long} {long} {long}x"),
        (5, "单词 ab1abcdefg×hi"),
        *[(i, "telephone") for i in range(6, 200)],
    ]
    frame = spark.createDataFrame([(i, t, 7, "w") for i, t in docs], "doc_id long, text string, n int, word string")
    counts = collections.Counter()
    for i, text in docs:
        for run in brute_runs(text):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert len(want) > 4
    found = variants.words_of(frame)
    assert dict(map(tuple, found.collect())) == want
    assert rows(variants.variants(found)) == brute_variants(want)
    assert variants.variants(variants.words_of(frame.limit(0))).collect() == []


def brute_runs(text):
    run = ""
    for c in (text or "") + " ":
        if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
            run += c
        elif run:
            yield run
            run = ""


# --- 12: hard negatives --------------------------------------------------------------------


def brute_negatives(vectors, every, positives, negatives):
    """``vectors`` are rows (id, label, numbers); all take part."""
    quantized = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in vectors]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    anchors = {(i, label, tuple(v)) for i, label, v in quantized if i % every == 0}
    out = []
    for i, label, v in anchors:
        same = sorted((-score(v, w), j) for j, other, w in quantized if other == label and j != i)
        rest = sorted((-score(v, w), j) for j, other, w in quantized if other != label)
        for neg, positive in same[:positives]:
            fit = [(s, j) for s, j in rest if 50 * -neg <= 100 * -s <= 95 * -neg][:negatives]
            out += [(i, positive, rank + 1, j, -neg, -s) for rank, (s, j) in enumerate(fit)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 4096])
def test_negatives(spark, block):
    deal = np.random.default_rng(3)
    vectors = [(int(i), int(deal.integers(3)), [float(x) for x in deal.normal(size=13)]) for i in range(120)]
    # repeated rows, shorter and empty vectors, ties, large numbers
    vectors += [vectors[4], vectors[4], (300, 0, vectors[7][2]), (301, 0, vectors[7][2]), (302, 1, [0.5, -0.25]), (310, 2, [])]
    vectors += [(320, 0, [1000.5] * 13), (330, 1, [-2000.25] * 13), (10, 2, vectors[3][2]), (10, 2, vectors[3][2])]
    out = [(None, 1, [1.0]), (600, None, [1.0]), (610, 1, None), (620, 1, [1.0, None]), (630, 1, [float("nan")]), (640, 0, [float("inf")])]
    table = spark.createDataFrame([(*x, 5, 6) for x in vectors + out], "vec_id long, label int, embedding array<double>, score long, planes int")
    got = rows(hard_negatives.mine(table, F.col("vec_id") % 10 == 0, block=block))
    want = brute_negatives(vectors, 10, 5, 3)
    assert len(want) > 100 and got == want


def test_no_anchors_and_no_rows(spark):
    table = spark.createDataFrame([(1, 1, [1.0])], "vec_id long, label int, embedding array<double>")
    assert hard_negatives.mine(table, F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives.mine(table, F.lit(True)).collect() == []


@given(st.lists(st.lists(st.integers(-1000, 999), min_size=16, max_size=16), min_size=1, max_size=9))
@settings(max_examples=50, deadline=None)
def test_planes_and_tables_give_inner_products(values):
    values = np.array(values)
    split = values.reshape(-1, 2, 8)
    planes = hard_negatives.packed(split, 11)
    assert (hard_negatives.unpacked(planes) == split).all()
    sums = hard_negatives.subset_sums(split, np.dtype(np.int64))
    assert (hard_negatives.scores(planes, sums) == values @ values.T).all()


# --- 13: id files --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(id_files.default_path())


@pytest.fixture(scope="module")
def encoder():
    with open(id_files.default_path(), encoding="utf-8") as file:
        return id_files.Encoder(file.read())


SIGNS = "abKsStlLveRrdDm'’.,!<|>&-_0129 \t\n\r\x0b\x0c\x1c\x85 éÉßÿ×÷ªºµ¼²İıſﬁ漢字かなहिन्दी̱́̈ͅΣσςK😀‍­"
MARKS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "İ", "H̱", "Å"]


@given(st.lists(st.one_of(st.sampled_from(SIGNS), st.sampled_from(MARKS)), max_size=30).map("".join))
@settings(max_examples=1500, deadline=None)
def test_encoder_equals_the_library(encoder, tokenizer, text):
    ids = np.frombuffer(b"".join(encoder.encode(text)), encoder.type).tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_on_long_texts_and_other_tokenizers(encoder, tokenizer, monkeypatch):
    text = "It's " + "x" * 300 + "".join(f" word{i} ein.Wort\n" for i in range(3_000))
    monkeypatch.setattr(id_files, "PIECE", 100)
    monkeypatch.setattr(id_files, "REMEMBERED", 10_000)
    ids = np.frombuffer(b"".join(encoder.encode(text)), encoder.type).tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        other = id_files.Encoder(file.read())
    ids = np.frombuffer(b"".join(other.encode("two  words\n here")), other.type).tolist()
    assert not other.spaced and ids == Tokenizer.from_file(path).encode("two  words\n here", add_special_tokens=False).ids


@given(st.sets(st.binary(max_size=6), max_size=300))
@settings(max_examples=100, deadline=None)
def test_perfect_hash_is_minimal(keys):
    hashes = id_files._hashes(sorted(keys), 0)
    found = id_files.PerfectHash.of(hashes)
    assert sorted(found.slots(hashes).tolist()) == list(range(len(keys)))


def brute_ids(tokenizer, docs):
    """``(doc_id, start, n, crc)`` of documents that are in order already."""
    out, start = [], 0
    for key, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_reads_back_what_the_library_says(spark, tokenizer):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    assert rows(QUERIES["op13_id_files"](spark, SF)) == sorted(brute_ids(tokenizer, docs), key=str)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_odd_documents_in_small_shards(spark, tokenizer, kind):
    name = {"long": lambda i: i, "string": lambda i: None if i is None else f"d{i:03}é"}[kind]
    texts = [None, "", "one two", "3 é", "a " * 500, "日本", "one two"]
    docs = [(name(i), text) for i, text in enumerate(texts)]
    # more rows of one id, alike or not, and of none than a shard holds
    docs += [(name(50), "same")] * 9 + [(name(50), "other")] + [(None, "lost")] * 8
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], f"doc_id {kind}, text string, start int, tie string")
    folder = f"{checkpoint_dir(spark)}/test-{uuid.uuid4().hex}"
    manifest = id_files.write(frame, folder, shard_ids=40, shard_docs=3)
    assert manifest.count() > 6 and manifest.agg(F.sum("n_docs")).first()[0] == len(docs)
    found = id_files.lookup(folder, frame).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in docs)
    # in order of their starts the documents cover the ids without gaps, in ascending order of keys, none last
    at, keys, pool = 0, [], collections.Counter((str(i), t or "") for i, t in docs)
    by_ids = {tuple(tokenizer.encode(t or "", add_special_tokens=False).ids): t or "" for _, t in docs}
    for row in sorted(found, key=lambda r: r["start"]):
        ids = np.frombuffer(bytes(row["ids"]), "<u4").tolist()
        assert row["start"] == at and row["n_tokens"] == len(ids) and ids[-1] == 2
        pool[str(row["doc_id"]), by_ids[tuple(ids[:-1])]] -= 1
        keys.append((row["doc_id"] is None, row["doc_id"] or 0 if kind == "long" else row["doc_id"] or ""))
        at += len(ids)
    assert not any(pool.values()) and keys == sorted(keys)
    some = spark.createDataFrame([(name(2),), (name(2),), (name(999),), (name(-5),)], f"doc_id {kind}")
    assert [r["doc_id"] for r in id_files.lookup(folder, some).collect()] == [name(2)]
    assert id_files.lookup(folder, some.limit(0)).collect() == []


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    folder = f"{checkpoint_dir(spark)}/test-{uuid.uuid4().hex}"
    assert id_files.write(frame, folder).collect() == []
    assert id_files.lookup(folder, spark.createDataFrame([(1,)], "doc_id long")).collect() == []


# --- 9: columns that clash with those that line dedup joins by ------------------------------


def test_line_windows_keep_clashing_columns(spark):
    schema = "doc_id long, text string, _id long, _hash long, covered string, hash string, n_lines int"
    table = spark.createDataFrame([(1, "a\nb\nc\nd", 7, 8, "x", "h", 9), (2, "a\nb\nc\ne", 7, 8, "y", "h", 9)], schema)
    got = {row["doc_id"]: row for row in line_windows.deduplicated(table).collect()}
    assert got[1]["text"] == "a\nb\nc\nd" and got[2]["text"] == "e"
    assert (got[2]["_id"], got[2]["_hash"], got[2]["covered"], got[2]["hash"], got[2]["n_lines"]) == (7, 8, "y", "h", 9)
    assert got[2]["n_removed"] == 3
