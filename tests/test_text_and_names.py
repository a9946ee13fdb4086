import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftline.functions import display, names
from weftline.functions.orm_rules import CONTEXT_RULES, LINE_RULES, MAPPERS
from weftline.functions.text import extract_groups, java_regex, matches, needed_literals, trimmed


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "name, snake",
    [("UserID", "user_id"), ("HTTPServer", "http_server"), ("userID2", "user_id2"), ("plain", "plain"), ("a_B", "a_b")],
)
def test_to_snake(spark, name, snake):
    assert one(spark, names.to_snake(F.col("n")), n=name) == snake


@pytest.mark.parametrize(
    "name, camel, pascal",
    [
        ("user_id", "userId", "UserId"),
        ("a_1", "a_1", "A_1"),
        ("__a", "_A", "_A"),
        ("_x", "X", "X"),
        ("a_B", "a_B", "A_B"),
        ("x_", "x_", "X_"),
        ("", "", ""),
    ],
)
def test_to_camel_and_pascal(spark, name, camel, pascal):
    assert one(spark, names.to_camel(F.col("n")), n=name) == camel
    assert one(spark, names.to_pascal(F.col("n")), n=name) == pascal


def test_singular_drops_only_a_lowercase_s(spark):
    assert [one(spark, names.singular(F.col("n")), n=x) for x in ("users", "STATUS", "s", "bus")] == ["user", "STATUS", "", "bu"]


def test_javascript_regex_meaning(spark):
    # A letter that is not ASCII is no word character, a no-break space is white space.
    assert one(spark, matches(F.col("t"), r"\bid\b"), t="éid x")
    assert one(spark, matches(F.col("t"), r"a\sb"), t="a" + chr(0xA0) + "b")
    assert not one(spark, matches(F.col("t"), r"a.b"), t="a" + chr(0x2028) + "b")
    assert one(spark, matches(F.col("t"), r"a.b"), t="a" + chr(0x85) + "b")
    assert one(spark, trimmed(F.col("t")), t=chr(0xFEFF) + chr(0xA0) + "  x\t\n") == "x"
    assert java_regex(r"[^]*?[\s\S]").startswith(r"[\s\S]*?[")


def test_needed_literals_hold_for_rule_patterns():
    """Every text a pattern matches must contain one of its literals."""
    samples = [
        "prisma.user.findMany({ where: { a: 1 }, select: { b: true } })", "session.query(User).filter(User.id == 1).all()",
        'db.Where("x = ?", 1).Find(&rows)', "await knex('users').select('a').where('b', 1)", "User.where(a: 1).first", "em.createQuery(\"SELECT u.id FROM U u WHERE 1\")",
        "diesel::insert_into(t).values(x)", "ctx.Users.Where(x => x.A).ToList()", "db.select().from(t).where(eq(t.a, 1))", "INSERT INTO t VALUES (1)",
        "UPDATE t SET a = 1 WHERE b = 2 AND c = 3", "delete from t", "a LEFT JOIN b", "SELECT a, b", "x.set (1)", "obj.create", "obj.findAll", "has_many :things",
        "@Entity()", "pgTable('users', {", "JOIN FETCH x", "or (", "x.del ('a')", "a OR b = 1", "Foo.create!(a)", "x.execute(a).select", "RETURNING id",
    ]
    patterns = [(p, 0) for m in MAPPERS for p in [*m.indicators, *(u for _, u in m.usages)]]
    patterns += [(p, re.I) for _, p in LINE_RULES] + [(p, 0) for _, ps in CONTEXT_RULES for p in ps]
    hits = 0
    for pattern, flags in patterns:
        literals = needed_literals(pattern)
        assert literals, pattern
        for text in samples:
            if re.search(pattern, text, flags | re.ASCII):
                hits += 1
                folded = text.lower() if flags else text
                assert any((x.lower() if flags else x) in folded for x in literals), (pattern, text)
    assert hits > 40


def test_needed_literals_of_optional_and_grouped_parts():
    assert needed_literals(r"ab?cd") == ["cd"]
    assert needed_literals(r"\b(foo|bar\s+long)\b") == ["foo", "long"]
    assert needed_literals(r"(a|b)x{2}") == []
    assert needed_literals(r"x[abc]yz|\w+") == []


def test_extract_groups(spark):
    found = one(spark, extract_groups(F.col("t"), r"(\w+)=(\d+)?;", {"k": 1, "v": 2}), t="a=1; b=; c=33;")
    assert [(m.k, m.v) for m in found] == [("a", "1"), ("b", ""), ("c", "33")]


def test_previews(spark):
    assert one(spark, display.clipped(F.col("t")), t="x" * 41) == "x" * 40 + "..."
    assert one(spark, display.clipped(F.col("t")), t="x" * 40) == "x" * 40
    assert one(spark, display.line_preview(F.col("n")), n=[1, 2, 3, 4]) == "1, 2, 3..."
    assert one(spark, display.line_preview(F.col("n")), n=[1, 2, 3]) == "1, 2, 3"


def test_uuid_number(spark):
    assert one(spark, display.uuid_number(F.col("u")), u="ffffffff-0000-4000-8000-000000000000") == 4294967295
    assert one(spark, display.uuid_number(F.col("u")), u="c12x") == 0xC12
    assert one(spark, display.uuid_number(F.col("u")), u="xyz") is None


def test_durations_and_percent(spark):
    at = F.lit(datetime(2024, 1, 1, 0, 0, 0)).cast("timestamp")

    def after(seconds):
        return at + F.expr(f"INTERVAL '{seconds}' SECOND")

    none = F.lit(None).cast("timestamp")
    assert one(spark, display.duration_text(at, after("59.4"), at)) == "59s"
    assert one(spark, display.duration_text(at, after("59.5"), at)) == "1m 0s"
    assert one(spark, display.duration_text(at, none, after("125"))) == "2m 5s"
    assert one(spark, display.duration_text(none, at, at)) == ""
    assert one(spark, display.progress_percent(F.lit(1), F.lit(8))) == 13
    assert one(spark, display.progress_percent(F.lit(1), F.lit(0))) == 0
