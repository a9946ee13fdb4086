"""The trace against a plain restatement: every spelling tried on every line."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions.orm_rules import CONTEXT_RULES, LINE_RULES, MAPPERS
from weftline.operators import lines, orm, usage

CATALOG = [
    ("c1", "user_id", "user_accounts"), ("c2", "name", "accounts"), ("c3", "id", "accounts"), ("c4", "Qty", "OrderItems"),
    ("c5", "unit_price", "OrderItems"), ("c6", "name", "User_Accounts"), ("c7", "a_1_total", "s"), ("c8", "code", "statuses"),
]

PIECES = [
    "user_id", "userId", "USERID", "userid", "name", "Names", "id", "qty", "unitPrice", "UnitPrice", "unit_price", "accounts.name", "useraccounts.userid",
    "userAccounts.userId", "x.accounts.name.y", "orderitems.qty", "OrderItem", "account", "status", "statuses.code", "code", "a_1_total", "éname", "nameé", "select", "WHERE",
    "insert into", ".create", "obj.update", "JOIN", "prisma.user.findMany", "where: {", "# remark", "// note", "* star", "-- sql", "  ", "", "set(", "create", "UPDATE x SET",
    ".filter(", "`name`", "'code'", "..", ".", "_", "user_id_", "total", "label = Column(", "label", "uid = Column('user_id'", "uid", "findBy", "DELETE", "İname", " name",
]


def make_files(seed, n):
    rng = random.Random(seed)
    files = []
    for i in range(n):
        language = rng.choice(["typescript", "python", "sql", "javascript"])
        head = {"typescript": "import x from '@prisma/client'", "python": "from sqlalchemy import *", "javascript": "require('knex')"}.get(language, "")
        body = [" ".join(rng.choices(PIECES, k=rng.randint(0, 5))) for _ in range(rng.randint(1, 25))]
        if rng.random() < 0.5:
            body.insert(0, head)
        files.append((f"f{i}", "p", f"f{i}", language, "\n".join(body), False))
    files.append(("empty", "p", "e", "sql", "", False))
    files.append(("null", "p", "e", "sql", None, False))
    return files


def search(pattern, text, flags=0):
    return re.search(pattern.replace(r"\s", r"[\s ﻿]"), text, flags | re.ASCII)


def camel(name):
    return re.sub(r"_([a-z])", lambda m: m.group(1).upper(), name)


def expected(files):
    used = set()
    for fid, _, _, language, content, _ in files:
        if not content:
            continue
        orms = [
            m for m in MAPPERS
            if (m.language == language or {m.language, language} <= {"javascript", "typescript"}) and any(search(p, content) for p in m.indicators)
        ]
        mapped = {}
        for m in orms:
            for fg, cg, pattern in m.fields:
                for hit in re.finditer(pattern, content, re.ASCII):
                    mapped[hit.group(fg).lower()] = hit.group(cg).lower()
        texts = content.split("\n")
        for i, line in enumerate(texts):
            bare = line.strip("﻿  \t\r")
            if not bare or bare.startswith(("//", "#", "*", "/*", "--")):
                continue
            context = "\n".join(texts[max(0, i - 5) : i + 6])
            kind = next((u for m in orms for u, p in m.usages if search(p, line) or search(p, context)), None)
            kind = kind or next((u for u, p in LINE_RULES if search(p, line, re.I)), None)
            kind = kind or next((u for u, ps in CONTEXT_RULES if all(search(p, context.upper()) for p in ps)), "read")
            for cid, column, table in CATALOG:
                col, tab = column.lower(), table.lower()
                forms = {col, camel(col), col.replace("_", ""), f"{tab}.{col}", f"{camel(tab)}.{camel(col)}"}
                found = any(
                    len(v) > 3 and re.search(r"(?:['\"`\[.]|\b)" + re.escape(v) + r"(?:['\"`\s,)\]:]|\b)", line, re.I | re.ASCII) for v in forms
                )
                short = table[:-1] if table.endswith("s") else table
                near = any(w.lower() in context.lower() for w in (table, camel(table), short, camel(short)))
                if found and (near or len(column) > 4 or orms):
                    used.add((fid, i + 1, cid, "direct", kind))
                for field, target in mapped.items():
                    if target == col and re.search(r"\b" + re.escape(field) + r"\b", line, re.I | re.ASCII):
                        used.add((fid, i + 1, cid, "orm", kind))
    return used


@pytest.fixture(scope="module")
def case(spark):
    files = make_files(7, 120)
    frame = spark.createDataFrame(files, "id string, project_id string, file_path string, language string, content string, parsed boolean")
    catalog = spark.createDataFrame([("p", *c) for c in CATALOG], "project_id string, column_id string, column_name string, table_name string")
    return files, frame, catalog


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
@pytest.mark.parametrize("block_lines", [1000, 3])
def test_trace_equals_trying_every_spelling(case, monkeypatch, broadcast_bytes, block_lines):
    files, frame, catalog = case
    if block_lines != 1000:
        monkeypatch.setattr(usage, "line_blocks", lambda f, carry=None: lines.line_blocks(f, carry, block_lines))
    rows = usage.trace_usages(frame, catalog, broadcast_bytes=broadcast_bytes).collect()
    got = [(r.source_file_id, r.line_number, r.column_id, r.strategy, r.usage_type) for r in rows]
    want = expected(files)
    assert len(want) > 300
    assert len(got) == len(set(got)), "a (column, line, strategy) came out twice"
    assert set(got) == want
    assert {g[3] for g in got} == {"direct", "orm"}
    by_id = {f[0]: f[4].split("\n") for f in files if f[4]}
    for r in rows:
        texts = by_id[r.source_file_id]
        i = r.line_number - 1
        assert r.context == "\n".join(texts[max(0, i - 5) : i + 6])[:1000]
        assert r.code_snippet == "\n".join(texts[max(0, i - 2) : i + 3])[:500]


def test_no_shuffle_of_the_corpus(case):
    _, frame, catalog = case
    plan = usage.trace_usages(frame, catalog)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    # The only exchanges are of dictionary rows.
    for line in plan.split("\n"):
        if "Exchange hashpartitioning" in line:
            assert "probe" in line


def test_blocks_overlap_by_the_context(spark):
    text = "\n".join(str(i) for i in range(23))
    frame = spark.createDataFrame([("f", "p", text)], "id string, project_id string, content string")
    rows = lines.window_lines(lines.line_blocks(frame, block_lines=4)).orderBy("line_number").collect()
    assert [r.line for r in rows] == [str(i) for i in range(23)]
    for r in rows:
        i = r.line_number - 1
        assert r.around == [str(x) for x in range(max(0, i - 5), min(23, i + 6))]
        assert r.around[r.at - 1] == str(i)


def test_usage_rules(spark):
    cases = [
        ("x.updated_at", "update"),  # no right boundary needed
        ("x.created", "read"),  # .create needs one
        ("x.create y", "write"),
        ("a.b JOIN c WHERE d", "join"),
        ("nothing", "read"),
    ]
    rows = spark.createDataFrame(cases, "line string, want string")
    got = rows.withColumn("got", orm.usage_type(F.col("line"), F.col("line"), F.array().cast("array<string>")))
    assert [r.got for r in got.collect()] == [c[1] for c in cases]


def test_mapper_read_wins_in_context_even_on_a_where_line(spark):
    context = "prisma.user.findMany({\n  where: { a: 1 }"
    row = spark.createDataFrame([("  where: { a: 1 }", context, ["Prisma"])], "line string, context string, orms array<string>")
    assert row.select(orm.usage_type(F.col("line"), F.col("context"), F.col("orms")).alias("x")).first().x == "read"


def test_last_field_write_wins(spark):
    content = 'gorm.Model\nA string `gorm:"column:one" json:"two"`\nB string `json:"three"`\nB int `gorm:"column:four"`'
    frame = spark.createDataFrame([("f", "p", "go", content)], "id string, project_id string, language string, content string")
    # JSON names are written after column names, so they win.
    assert {(r.field, r.column_name) for r in orm.field_columns(frame).collect()} == {("a", "two"), ("b", "three")}


def test_letters_beyond_ascii_bound_a_word(spark):
    line = spark.createDataFrame([("orderİ = 1; Kelvin.\u212aey = ÀTotal_ID",)], "line string")
    found = line.select(usage.line_tokens(F.col("line"))).first()[0]
    assert set(found) == {"order", "1", "kelvin", "ey", "total_id"}


def many_tokens(spark, n):
    """A third of all tokens is one known spelling, a sixth another one; the others are in no dictionary."""
    token = F.when(F.col("id") % 3 == 0, "hotcolumn").when(F.col("id") % 6 == 1, "warmcolumn").otherwise(
        F.concat(F.lit("other"), F.col("id").cast("string"))
    )
    return spark.range(n).select(
        F.lit("p").alias("project_id"), token.alias("probe"), F.concat(F.lit("f"), (F.col("id") % 97).cast("string")).alias("file_id"),
        F.lit(0).alias("block_start"), F.col("id").alias("line_number"),
    )


def test_only_tokens_that_may_be_known_move(spark):
    words = spark.range(20_000).select(F.lit("p").alias("project_id"), F.concat(F.lit("known"), F.col("id").cast("string")).alias("probe"))
    named = spark.createDataFrame([("p", "hotcolumn"), ("p", "warmcolumn"), (None, "x")], "project_id string, probe string")
    words = words.unionByName(named)
    n = 120_000
    moved = usage.known_probes(many_tokens(spark, n), words)
    counts = {r.probe: r["count"] for r in moved.groupBy("probe").count().collect()}
    assert (counts.pop("hotcolumn"), counts.pop("warmcolumn")) == (n // 3, n // 6)
    assert sum(counts.values()) < 0.02 * n / 2
    assert "BroadcastHashJoin" in moved._jdf.queryExecution().executedPlan().toString()
    # every spelling passes, in its project only but for chance
    assert usage.known_probes(words.where("project_id is not null"), words).count() == 20_002
    assert usage.known_probes(words.withColumn("project_id", F.lit("q")), words).count() < 400
    assert usage.known_probes(many_tokens(spark, 100), words.limit(0)).count() == 0


def test_hot_tokens_are_split_by_their_number(spark):
    words = spark.createDataFrame([("p", "hotcolumn", 1), ("p", "warmcolumn", 2), ("p", "warmcolumn", 3), ("p", "rare", 4)], "project_id string, probe string, c int")
    rows = many_tokens(spark, 60_000)
    dealt, copies = usage.in_parts(rows, words, split_rows=1_000, split_share=0)
    assert {(r.probe, r.c): r["count"] for r in copies.groupBy("probe", "c").count().collect()} == {
        ("hotcolumn", 1): 20, ("warmcolumn", 2): 10, ("warmcolumn", 3): 10, ("rare", 4): 1,
    }
    largest = dealt.groupBy("probe", "_part").count().agg(F.max("count")).first()[0]
    assert 1_000 <= largest < 1_300
    key = ["project_id", "probe"]
    want = rows.join(words, key).select("line_number", "c")
    got = dealt.join(copies, [*key, "_part"]).select("line_number", "c")
    assert got.count() == want.count() == 40_000 and got.exceptAll(want).count() == 0
    # by default a token is split from a share of all rows on, so that the list of split ones stays short
    assert usage.in_parts(rows, words, split_rows=1, split_share=0.25)[1].where("probe = 'warmcolumn'").count() == 2


def test_fields_are_found_among_tokens(spark):
    fields = [(f"f{i}", f"c{i}", i) for i in range(5)]
    df = spark.createDataFrame(
        [(["f1", "x", "f3"], fields), (["x"], fields), ([], fields), (["f1"], [])],
        "tokens array<string>, field_map array<struct<field string, column_name string, seq int>>",
    )
    got = [r[0] for r in df.select(usage._mapped_probes(F.col("tokens"), F.col("field_map"))).collect()]
    assert got == [["mapped:c1", "mapped:c3"], [], [], []]


def test_marks_of_lines_say_what_the_rules_say_of_contexts(spark):
    """Every line, by its marks and by all rules over its context; some rules match over the end of a line."""
    texts = {
        "typescript": "import { PrismaClient } from '@prisma/client'\nprisma.t.findMany({\n  select\n  : {a: true}\n})\n" + "x\n" * 12 + "where:\n\n{\ny\nprisma.u\n.update(z)",
        "python": "from sqlalchemy import x\n" + "a = 1\n" * 8 + "q.filter(a)\ninsert into t\nupdate t\nq = 1\nset x = 2\nsession.query\n(M)\n" + "b\n" * 7 + "q.join (z)\n.execute(1\nselect)",
        "java": "import org.hibernate.x;\r\n@ManyToOne\r\nem.persist\r\n(x)\r\n" + "c;\n" * 11 + "JOIN\n  FETCH\n\nSELECT x\n",
        "sql": "straße ſelect\nselect a\n\nfrom t where x = 1\njoin u\n" + "-\n" * 6 + "DELETED\ndelete",
    }
    rows = [(f"f{i}", "p", language, text) for i, (language, text) in enumerate(texts.items())]
    files = spark.createDataFrame(rows, "id string, project_id string, language string, content string")
    tagged = files.withColumn("orms", orm.mappers_of(F.col("content"), F.col("language")))
    windows = lines.window_lines(lines.line_blocks(tagged, ["orms"], 7), ["orms"]).withColumn("context", lines.context_text())
    expected = windows.filter(lines.is_code_line(F.col("line"))).select(
        "file_id", "line_number", orm.mapper_usage(F.col("context"), F.col("orms")).alias("by_mapper"), orm.context_usage(F.col("context")).alias("by_context")
    )
    for size in (7, 1000):
        marked = orm.with_marks(lines.line_blocks(tagged.withColumn("crosses", F.lit(False)), ["orms", "crosses"], size))
        alone = lines.window_lines(marked, ["orms", "crosses"], orm.MARKS).select(
            "file_id", "line_number", orm.marked_mapper_usage(F.lit(""), F.col("orms")).alias("by_mapper")
        )
        got = usage.line_usages(files).select("file_id", "line_number", "by_mapper", "by_context")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
        # the marks alone miss what crosses a line's end
        assert alone.join(expected, ["file_id", "line_number"]).filter(~alone["by_mapper"].eqNullSafe(expected["by_mapper"])).take(1)
    assert {r.by_context for r in expected.collect()} >= {"write", "update", "delete", "filter", "projection", "read"}
