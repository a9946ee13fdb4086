"""The given star-schema tables seen as lineage tables.

Each binding is one SQL text that Spark and DuckDB both run, over the tables
named in braces. Files are written out per order: eight templates mention a
table and a column chosen by customer, and about a third of them name the same
hot column.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, sql: str, **frames: DataFrame) -> DataFrame:
    """Run a binding on Spark; table names in braces are read from ``sf_dir``, others are ``frames``."""
    known = [n for n in dict.fromkeys((*TABLES, *frames)) if f"{{{n}}}" in sql]
    text = sql.replace("{", "{{").replace("}", "}}")
    for name in known:
        text = text.replace(f"{{{{{name}}}}}", f"{{{name}}}")
    return spark.sql(text, **{n: frames[n] if n in frames else load(spark, sf_dir, n) for n in known})


def plain(sql: str) -> str:
    """The same text with bare table names."""
    for name in TABLES:
        sql = sql.replace(f"{{{name}}}", name)
    return sql


# (table, column, camel form, type, is key, referenced table, referenced column)
COLUMNS = [
    ("region", "r_regionkey", "rRegionkey", "INTEGER", True, None, None),
    ("region", "r_name", "rName", "TEXT", False, None, None),
    ("nation", "n_nationkey", "nNationkey", "INTEGER", True, None, None),
    ("nation", "n_name", "nName", "TEXT", False, None, None),
    ("nation", "n_regionkey", "nRegionkey", "INTEGER", False, "region", "r_regionkey"),
    ("customer", "c_custkey", "cCustkey", "BIGINT", True, None, None),
    ("customer", "c_name", "cName", "TEXT", False, None, None),
    ("customer", "c_nationkey", "cNationkey", "INTEGER", False, "nation", "n_nationkey"),
    ("customer", "c_acctbal", "cAcctbal", "DOUBLE", False, None, None),
    ("customer", "c_mktsegment", "cMktsegment", "TEXT", False, None, None),
    ("supplier", "s_suppkey", "sSuppkey", "BIGINT", True, None, None),
    ("supplier", "s_name", "sName", "TEXT", False, None, None),
    ("supplier", "s_nationkey", "sNationkey", "INTEGER", False, "nation", "n_nationkey"),
    ("supplier", "s_acctbal", "sAcctbal", "DOUBLE", False, None, None),
    ("part", "p_partkey", "pPartkey", "BIGINT", True, None, None),
    ("part", "p_name", "pName", "TEXT", False, None, None),
    ("part", "p_brand", "pBrand", "TEXT", False, None, None),
    ("part", "p_type", "pType", "TEXT", False, None, None),
    ("part", "p_size", "pSize", "INTEGER", False, None, None),
    ("part", "p_retailprice", "pRetailprice", "DOUBLE", False, None, None),
    ("orders", "o_orderkey", "oOrderkey", "BIGINT", True, None, None),
    ("orders", "o_custkey", "oCustkey", "BIGINT", False, "customer", "c_custkey"),
    ("orders", "o_orderstatus", "oOrderstatus", "TEXT", False, None, None),
    ("orders", "o_totalprice", "oTotalprice", "DOUBLE", False, None, None),
    ("orders", "o_orderdate", "oOrderdate", "TIMESTAMP", False, None, None),
    ("orders", "o_orderpriority", "oOrderpriority", "TEXT", False, None, None),
    ("lineitem", "l_orderkey", "lOrderkey", "BIGINT", False, "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "lPartkey", "BIGINT", False, "part", "p_partkey"),
    ("lineitem", "l_suppkey", "lSuppkey", "BIGINT", False, "supplier", "s_suppkey"),
    ("lineitem", "l_linenumber", "lLinenumber", "INTEGER", False, None, None),
    ("lineitem", "l_quantity", "lQuantity", "DOUBLE", False, None, None),
    ("lineitem", "l_extendedprice", "lExtendedprice", "DOUBLE", False, None, None),
    ("lineitem", "l_discount", "lDiscount", "DOUBLE", False, None, None),
    ("lineitem", "l_tax", "lTax", "DOUBLE", False, None, None),
    ("lineitem", "l_returnflag", "lReturnflag", "TEXT", False, None, None),
    ("lineitem", "l_linestatus", "lLinestatus", "TEXT", False, None, None),
    ("lineitem", "l_shipdate", "lShipdate", "TIMESTAMP", False, None, None),
    ("accounts", "id", "id", "UUID", True, None, None),
    ("accounts", "name", "name", "TEXT", False, None, None),
    ("accounts", "slug", "slug", "TEXT", False, None, None),
    ("user_accounts", "user_id", "userId", "UUID", False, "accounts", "id"),
    ("user_accounts", "created_at", "createdAt", "TIMESTAMP", False, None, None),
    ("OrderItems", "unitPrice", "unitPrice", "DOUBLE", False, None, None),
    ("OrderItems", "qty2", "qty2", "INTEGER", False, None, None),
    ("statuses", "code", "code", "TEXT", False, None, None),
]
N = len(COLUMNS)
HOT = 5  # c_custkey


def _text(value: str | None) -> str:
    return "CAST(NULL AS STRING)" if value is None else f"'{value}'"


PICKS = (
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"({i}, '{t}', '{c}', '{k}', '{d}', {str(pk).lower()}, {_text(ft)}, {_text(fc)})"
        for i, (t, c, k, d, pk, ft, fc) in enumerate(COLUMNS)
    )
    + ") AS v(i, tbl, col, camel, typ, is_pk, ftab, fcol)"
)


def _lines(*parts: str) -> str:
    """Lines of a template: ``<x>`` stands for a column of the pick."""
    rendered = []
    for part in parts:
        pieces = re.split(r"<(\w+)>", part)
        terms = [f"'{p.replace(chr(39), chr(39) * 2)}'" if j % 2 == 0 else f"CAST({p} AS STRING)" for j, p in enumerate(pieces)]
        rendered.append(" || ".join(t for t in terms if t != "''") or "''")
    return " || chr(10) || ".join(rendered)


def _when(condition: str, *parts: str) -> str:
    return f"CASE WHEN {condition} THEN {_lines(*parts)} || chr(10) ELSE '' END"


_PRISMA_CLIENT = (
    _lines(
        "import { PrismaClient } from '@prisma/client'",
        "// loads <col> from <tbl>",
        "const rows = await prisma.<tbl>.findMany({",
        "  where: { <camel>: { gt: <n> } },",
        "  select: { <camel2>: true },",
        "})",
        "const total = rows.reduce((a, r) => a + r.<camel>, 0)",
        "",
    )
    + " || "
    + _when(
        "ck % 3 = 0",
        "",
        "function touch() {",
        "  log('one')",
        "  log('two')",
        "  log('three')",
        "  log('four')",
        "  log('five')",
        "  return prisma.<tbl2>.update({ data: { <camel2>: <n> } })",
        "}",
    )
)

_SQLALCHEMY = (
    _lines(
        "from sqlalchemy import Column, Integer, String, ForeignKey",
        "",
        "class M<n>(Base):",
        "    __tablename__ = '<tbl>'",
        "    <col> = Column(Integer, primary_key=True)",
        "    label = Column('<col2>', String(50), primary_key=True)",
        "    owner = mapped_column(ForeignKey('<tbl2>.<col2>'))",
        "    # <col> is documented here",
        "",
        "class Plain<n>(object):",
        "    pass",
        "",
        "def load(session):",
        "    label = <n>",
        "    q = session.query(M<n>).filter(<tbl>.<col> == <n>)",
        "    return q.join(<tbl2>, <tbl2>.<col2> == <tbl>.<col>)",
        "",
    )
)

_SELECT = _lines(
    "SELECT t.<col>,",
    "       t.<col2>",
    "FROM <tbl> t",
    "-- <col> in a comment",
    "",
    "JOIN <tbl2> ON <tbl2>.<col2> = t.<col>",
    "   AND t.<col> = <n>",
    "WHERE t.<col> > <n>",
    "GROUP BY <col>",
    "",
)

_STATEMENTS = (
    "CASE WHEN ck % 3 = 0 THEN "
    + _lines("INSERT INTO <tbl> (<col>, <col2>)", "VALUES (<n>, 1);")
    + " WHEN ck % 3 = 1 THEN "
    + _lines("UPDATE <tbl>", "SET <col> = <n>", "WHERE <col2> IS NULL;")
    + " ELSE "
    + _lines("DELETE FROM <tbl>", "WHERE <col> = <n>;")
    + " END || chr(10) || "
    + _lines("begin;", "commit;", "begin;", "commit;", "begin;", "commit;", "")
    + " || "
    + _when(
        "n % 5 < 2",
        "CREATE TABLE IF NOT EXISTS <tbl> (",
        "  <col> BIGINT PRIMARY KEY,",
        "  <col2> DECIMAL(10,2) NOT NULL,",
        "  ref_id INT REFERENCES <tbl2>(<col2>),",
        "  key_note TEXT,",
        "  -- a note",
        "  seen_at TIMESTAMP DEFAULT now(),",
        "  CONSTRAINT fk FOREIGN KEY (<col>) REFERENCES <tbl2>(<col2>)",
        ");",
        "create table `notes<n>` (",
        '  "body" text',
        ");",
    )
)

_GORM = (
    _lines(
        "package m",
        'import "gorm.io/gorm"',
        "",
        "type Rec<n> struct {",
        '\tID uint `gorm:"primaryKey" json:"id"`',
        '\tField int `gorm:"column:<col>" json:"<camel>"`',
        '\tOwnerID int `json:"ownerId"`',
        '\tHTTPPort int `db:"port"`',
        '\tExtra pkg.Type `gorm:"column:extra_col"`',
        '\tSkip pkg.Type `json:"skip"`',
        "}",
        "",
    )
    + " || "
    + _when("ck % 2 = 0", 'func (r Rec<n>) TableName() string { return "<tbl>" }')
    + " || "
    + _lines(
        "func load(db *gorm.DB, ownerid int) {",
        '\tdb.Where("<col> = ?", <n>).Find(&rows)',
        "}",
        "",
    )
)

_JPA = (
    _lines("import javax.persistence.Entity;", "@Entity", "")
    + " || "
    + _when("ck % 2 = 0", '@Table(name = "<tbl>")')
    + " || "
    + _lines(
        "public class Item<n> {",
        "  @Id private Long pk;",
        "  private String <camel>;",
        '  @Column(name = "<col2>")',
        "  private String second;",
        "  /* a long remark between the fields, so that the marks above are out of reach of the next one;",
        "     a long remark between the fields, so that the marks above are out of reach of the next one;",
        "     a long remark between the fields, so that the marks above are out of reach of the next one */",
        "  @ManyToOne",
        "  private Owner owner;",
        "  public void store(EntityManager em) { em.persist(this.<camel>); }",
        "}",
        "",
    )
)

_PRISMA_MODEL = (
    _lines(
        "// one model per record",
        "model Rec<n> {",
        "  id Int @id",
        '  <camel> Int @map("<col>")',
        "  ownerId Int",
        "  owner Owner @relation(fields: [ownerId])",
        "  tags String[]",
        "  kind Kind",
        "  <camel2> lower",
        "",
    )
    + " || "
    + _when("ck % 2 = 0", '  @@map("<tbl>")')
    + " || "
    + _lines("}", "")
)

_RUBY = (
    _lines(
        "class Job<n>",
        "  def run",
        "    slug = fetch(:code)",
        "    puts name",
        "  end",
        "",
        "  one",
        "  two",
        "  three",
        "  four",
        "  five",
        "",
    )
    + " || "
    + _when("ck % 2 = 0", "  Account.new", "  names.<col> = 'name'", "  UserAccounts.userId", "  user_accounts.createdAt.x")
    + " || "
    + _lines("end", "")
)

_TEMPLATES = [_PRISMA_CLIENT, _SQLALCHEMY, _SELECT, _STATEMENTS, _GORM, _JPA, _PRISMA_MODEL, _RUBY]

# Every entry an archive could hold, code or not: (project_id, file_path, content, id).
CORPUS = f"""
WITH picks AS ({PICKS}),
chosen AS (
  SELECT o_orderkey AS n, o_custkey AS ck, o_orderkey % 8 AS k,
         CASE WHEN o_custkey % 10 < 3 THEN {HOT} ELSE o_custkey % {N} END AS i1,
         (o_orderkey + 3 * o_custkey) % {N} AS i2
  FROM {{orders}}
),
named AS (
  SELECT c.n, c.ck, c.k, a.tbl, a.col, a.camel, b.tbl AS tbl2, b.col AS col2, b.camel AS camel2
  FROM chosen c JOIN picks a ON a.i = c.i1 JOIN picks b ON b.i = c.i2
)
SELECT 'f' || CAST(n AS STRING) AS id,
       'p' || CAST(ck % 20 AS STRING) AS project_id,
       CASE ck % 25 WHEN 3 THEN 'vendor/' WHEN 4 THEN 'app/dist/' WHEN 5 THEN 'dist/' ELSE 'src/m' || CAST(ck % 50 AS STRING) || '/' END
         || CASE k WHEN 1 THEN 'models/' WHEN 3 THEN CASE WHEN n % 3 = 0 THEN 'migrations/' ELSE 'jobs/' END
              WHEN 4 THEN 'model/' WHEN 5 THEN 'entity/' WHEN 6 THEN 'models/' ELSE 'app/' END
         || 'f' || CAST(n AS STRING)
         || CASE k WHEN 0 THEN CASE ck % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.jsx' ELSE '.JS' END
              WHEN 1 THEN '.py' WHEN 2 THEN '.sql' WHEN 3 THEN '.sql' WHEN 4 THEN '.go' WHEN 5 THEN '.java'
              WHEN 6 THEN CASE WHEN ck % 4 = 1 THEN '.gql' ELSE '.prisma' END
              ELSE CASE WHEN ck % 5 = 0 THEN '.md' ELSE '.rb' END END AS file_path,
       CASE k {" ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(_TEMPLATES))} END AS content
FROM named
"""

# A catalog per project: the columns its orders point at.
_PROJECT_PICKS = f"""
WITH picks AS ({PICKS}),
named AS (
  SELECT DISTINCT o_custkey % 20 AS p, (o_orderkey + 3 * o_custkey) % {N} AS i FROM {{orders}}
  UNION
  SELECT DISTINCT o_custkey % 20 AS p, {HOT} AS i FROM {{orders}}
),
own AS (
  SELECT p, picks.i, tbl, col, typ, is_pk, ftab, fcol
  FROM named JOIN picks ON picks.i = named.i
)
"""

DB_SCHEMAS = (
    _PROJECT_PICKS
    + """
SELECT DISTINCT 'p' || CAST(p AS STRING) || '.' || tbl AS id, 'p' || CAST(p AS STRING) AS project_id, tbl AS table_name FROM own
"""
)

DB_COLUMNS = (
    _PROJECT_PICKS
    + """
SELECT 'p' || CAST(p AS STRING) || '.' || CAST(i AS STRING) AS id, 'p' || CAST(p AS STRING) || '.' || tbl AS schema_id,
       col AS column_name, typ AS data_type, is_pk AS is_primary_key, ftab IS NOT NULL AS is_foreign_key,
       ftab AS foreign_table, fcol AS foreign_column,
       CASE WHEN i % 3 = 0 THEN 'What ' || col || ' means in ' || tbl || CASE WHEN i % 2 = 0 THEN ', told at such length that a preview has to cut it somewhere' ELSE '' END END AS ai_description
FROM own
"""
)

# Usages straight from line items; projects p0..p19 by order, columns from the catalog above.
USAGE_FILES = """
SELECT 'f' || CAST(o_orderkey AS STRING) AS id, 'p' || CAST(o_orderkey % 20 AS STRING) AS project_id,
       'src/m' || CAST(o_custkey % 50 AS STRING) || '/f' || CAST(o_orderkey AS STRING) AS file_path,
       CASE o_orderkey % 7 WHEN 0 THEN 'go' WHEN 1 THEN 'sql' WHEN 2 THEN 'python' WHEN 3 THEN 'java' WHEN 4 THEN 'unknown' WHEN 5 THEN 'cobol' ELSE 'typescript' END AS language
FROM {orders}
"""

USAGES = f"""
SELECT 'u' || CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING) || '.' || CAST(l_partkey AS STRING) || '.' || CAST(l_suppkey AS STRING) AS id,
       'p' || CAST(l_orderkey % 20 AS STRING) AS project_id,
       'p' || CAST(l_orderkey % 20 AS STRING) || '.' || CAST(CASE WHEN l_partkey % 3 = 0 THEN {HOT} ELSE l_partkey % {N} END AS STRING) AS column_id,
       'f' || CAST(l_orderkey AS STRING) AS source_file_id, l_linenumber AS line_number,
       CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'read' WHEN 'AO' THEN 'write' WHEN 'NF' THEN 'update' WHEN 'NO' THEN 'join'
         WHEN 'RF' THEN 'filter' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'delete' ELSE 'projection' END END AS usage_type,
       'take ' || CAST(l_partkey AS STRING) || CASE WHEN l_suppkey % 2 = 0 THEN repeat(' and more', 20) ELSE '' END AS code_snippet,
       'around line ' || CAST(l_linenumber AS STRING) AS context
FROM {{lineitem}}
"""

APPLICATIONS = "SELECT 'a' || CAST(n_nationkey AS STRING) AS id, n_name AS name FROM {nation}"

PROJECTS = """
SELECT 'c' || CAST(c_custkey AS STRING) AS id, 'u' || CAST(c_custkey % 7 AS STRING) AS user_id,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'a' || CAST(c_nationkey AS STRING) END AS application_id, c_name AS name,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'completed' WHEN 'MACHINERY' THEN 'failed' WHEN 'AUTOMOBILE' THEN 'processing' ELSE 'pending' END AS status,
       first_order AS created_at
FROM {customer} LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM {orders} GROUP BY o_custkey) o ON o_custkey = c_custkey
"""

PROJECT_FILES = """
SELECT 'f' || CAST(o_orderkey AS STRING) AS id, 'c' || CAST(o_custkey AS STRING) AS project_id, 'f' || CAST(o_orderkey AS STRING) AS file_path,
       CASE o_orderkey % 7 WHEN 0 THEN 'go' WHEN 1 THEN 'sql' WHEN 2 THEN 'python' WHEN 3 THEN 'plsql' WHEN 4 THEN 'unknown' WHEN 5 THEN 'cobol' ELSE 'typescript' END AS language
FROM {orders}
"""

PROJECT_SCHEMAS = """
SELECT DISTINCT 'c' || CAST(o_custkey AS STRING) || '.' || CAST(l_suppkey AS STRING) AS id, 'c' || CAST(o_custkey AS STRING) AS project_id,
       'supply' || CAST(l_suppkey AS STRING) AS table_name
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

# Project columns and usages: one column per table of a project, one usage per line item.
PROJECT_COLUMNS = """
SELECT DISTINCT 'c' || CAST(o_custkey AS STRING) || '.' || CAST(l_suppkey AS STRING) || '.' || CAST(l_partkey AS STRING) AS id,
       'c' || CAST(o_custkey AS STRING) || '.' || CAST(l_suppkey AS STRING) AS schema_id, 'part' || CAST(l_partkey AS STRING) AS column_name
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

PROJECT_USAGES = """
SELECT 'u' || CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING) || '.' || CAST(l_partkey AS STRING) || '.' || CAST(l_suppkey AS STRING) AS id,
       'c' || CAST(o_custkey AS STRING) AS project_id,
       'c' || CAST(o_custkey AS STRING) || '.' || CAST(l_suppkey AS STRING) || '.' || CAST(l_partkey AS STRING) AS column_id,
       'f' || CAST(l_orderkey AS STRING) AS source_file_id
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

# Tables are nations, columns customers; odd nations stay without columns.
NATION_SCHEMAS = "SELECT 'n' || CAST(n_nationkey AS STRING) AS id, 'r' || CAST(n_regionkey AS STRING) AS project_id, n_name AS table_name FROM {nation}"

NATION_COLUMNS = """
SELECT 'c' || CAST(c_custkey AS STRING) AS id, 'n' || CAST(c_nationkey * 2 AS STRING) AS schema_id, 'key_' || CAST(c_custkey % 97 AS STRING) AS column_name,
       c_mktsegment AS data_type, c_custkey % 5 = 0 AS is_primary_key, c_custkey % 4 = 0 AS is_foreign_key,
       CASE WHEN c_custkey % 4 = 0 THEN 'region' END AS foreign_table, CASE WHEN c_custkey % 4 = 0 THEN 'r_regionkey' END AS foreign_column,
       CASE WHEN c_custkey % 3 = 0 THEN 'Says ' || c_name END AS ai_description
FROM {customer}
"""

COMPONENTS = """
SELECT 'r' || CAST(r_regionkey AS STRING) AS id, 'p0' AS project_id, r_name AS component_name, 'FUNCTION' AS component_type, CAST(NULL AS STRING) AS component_desc,
       CAST(NULL AS STRING) AS parent_component_id, false AS is_noise, CAST(r_regionkey AS INT) AS order_seq FROM {region}
UNION ALL
SELECT 'n' || CAST(n_nationkey AS STRING), 'p' || CAST(n_regionkey AS STRING), 'TABLE_' || CAST(n_nationkey % 20 AS STRING), 'TABLE', NULL,
       'r' || CAST(n_regionkey AS STRING), CASE n_nationkey % 9 WHEN 4 THEN true WHEN 5 THEN NULL ELSE false END, CAST(n_nationkey AS INT) FROM {nation}
UNION ALL
SELECT 'c' || CAST(c_custkey AS STRING), 'p' || CAST(c_custkey % 5 AS STRING), 'col_' || CAST(c_custkey % 97 AS STRING), 'COLUMN', c_mktsegment,
       'n' || CAST(c_nationkey AS STRING), false, CAST(NULL AS INT) FROM {customer}
UNION ALL
SELECT 'o' || CAST(o_orderkey AS STRING), 'p' || CAST(o_orderkey % 5 AS STRING), 'step_' || CAST(o_orderkey AS STRING) || CASE WHEN o_orderkey % 4 = 0 THEN '_with_a_name_that_is_too_long_to_be_shown_whole' ELSE '' END,
       CASE o_orderkey % 7 WHEN 0 THEN 'PROCEDURE' WHEN 1 THEN 'FUNCTION' WHEN 2 THEN 'QUERY' WHEN 3 THEN 'FUNCTION_CALL' WHEN 4 THEN 'CREATE_TABLE_STATEMENT'
         WHEN 5 THEN 'CREATE_COLUMN_DEFINITION' ELSE 'TRIGGER' END, NULL,
       'c' || CAST(o_custkey AS STRING), CASE o_orderkey % 10 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 50 AS INT) END FROM {orders}
"""

TRACE = """
SELECT 'r' || CAST(n_regionkey AS STRING) AS fk_parent_component_id, 'n' || CAST(n_nationkey AS STRING) AS fk_child_component_id, 'CONTAINS' AS relationship_type FROM {nation}
UNION ALL
SELECT 'n' || CAST(c_nationkey AS STRING), 'c' || CAST(c_custkey AS STRING), 'CONTAINS' FROM {customer}
UNION ALL
SELECT 'c' || CAST(o_custkey AS STRING), 'o' || CAST(o_orderkey AS STRING), 'REFERENCES' FROM {orders}
UNION ALL
SELECT 'n' || CAST(c_nationkey AS STRING), 'o' || CAST(o_orderkey AS STRING), 'USES' FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

# Requests for lineage: every nation's table in all projects of even customers' segments, every customer's column.
TABLE_ROOTS = """
SELECT 'TABLE_' || CAST(n_nationkey AS STRING) AS root_id, 'p' || CAST(r_regionkey AS STRING) AS project_id, 'TABLE_' || CAST(n_nationkey AS STRING) AS table_name
FROM {nation} JOIN {region} ON r_regionkey <= n_nationkey % 5
"""

COLUMN_ROOTS = """
SELECT DISTINCT 'TABLE_' || CAST(c_nationkey % 20 AS STRING) || '.col_' || CAST(c_custkey % 97 AS STRING) AS root_id, 'p' || CAST(c_custkey % 5 AS STRING) AS project_id,
       'TABLE_' || CAST(c_nationkey % 20 AS STRING) AS table_name, 'col_' || CAST(c_custkey % 97 AS STRING) AS column_name
FROM {customer}
"""

SOURCES = """
SELECT 'o' || CAST(l_orderkey AS STRING) AS component_id, 'c' || CAST(l_suppkey AS STRING) AS parent_component_id,
       'code ' || CAST(l_partkey AS STRING) || '.' || CAST(l_suppkey AS STRING) AS source_code,
       CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber * 10 END AS start_line, l_linenumber * 10 + CAST(l_quantity AS INT) AS end_line
FROM {lineitem}
"""

RESULTS = """
SELECT 'p' || CAST(o_custkey % 20 AS STRING) AS project_id, CASE WHEN o_orderstatus = 'P' THEN 'TABLE' ELSE 'COLUMN' END AS data_lineage_type,
       o_orderpriority AS table_name, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS column_name,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'tree ' || CAST(o_orderkey AS STRING) END AS lineage_data, o_orderdate AS updated_at
FROM {orders}
"""

# A request per pair of neighbouring projects, table and column.
RESULT_REQUESTS = """
SELECT DISTINCT 'q' || CAST(CAST(floor((o_custkey % 20) / 2) AS BIGINT) AS STRING) || o_orderpriority || o_orderstatus AS request_id, 'p' || CAST(o_custkey % 20 AS STRING) AS project_id,
       o_orderpriority AS table_name, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS column_name
FROM {orders}
"""

JOBS = """
SELECT 'j' || CAST(event_id AS STRING) AS id, 'c' || CAST(user_id AS STRING) AS project_id,
       CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' WHEN 'signup' THEN 'queued' ELSE 'pending' END AS status,
       CASE event_type WHEN 'click' THEN 'file_scan' WHEN 'view' THEN 'schema_parse' ELSE 'lineage_trace' END AS job_type,
       CAST(event_id % 17 AS INT) AS progress, CAST(event_id % 23 AS INT) AS total,
       CASE WHEN event_type = 'error' THEN 'broke' END AS error_message,
       CASE WHEN event_type = 'click' THEN NULL ELSE ts END AS started_at,
       CASE WHEN event_type IN ('purchase', 'error') THEN ts + value * INTERVAL '1' SECOND END AS completed_at, ts AS created_at
FROM {events}
"""

# Calls: every order calls another, customers call their finished orders.
HIERARCHY = """
SELECT 'o' || CAST(o_orderkey AS STRING) AS parent_id, 'o' || CAST((o_orderkey * 7 + 3) % n AS STRING) AS child_id, 'L1' AS hierarchy_level,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS INT) END AS call_order
FROM {orders} JOIN (SELECT count(*) AS n FROM {orders}) c ON o_orderkey < n
UNION ALL
SELECT 'c' || CAST(o_custkey AS STRING), 'o' || CAST(o_orderkey AS STRING), 'L2', CAST(o_orderkey % 9 AS INT) FROM {orders} WHERE o_orderstatus = 'F'
UNION ALL
SELECT 'c' || CAST(o_custkey AS STRING), 'o' || CAST(o_orderkey AS STRING), 'L2', CAST(o_orderkey % 9 + o_orderkey % 2 AS INT) FROM {orders} WHERE o_orderstatus = 'F' AND o_orderkey % 5 = 0
"""

FLOWS = """
SELECT 'p' || CAST(l_orderkey % 5 AS STRING) AS project_id, 'step_' || CAST(l_suppkey % 7 * 7 AS STRING) AS source_table,
       CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE 'mart_of_suppliers_and_their_many_parts_' || CAST(l_partkey % 40 AS STRING) END AS target_table,
       'step_' || CAST(l_orderkey AS STRING) AS procedure_name, l_linenumber AS flow_sequence,
       CASE l_returnflag WHEN 'A' THEN 'LOAD' WHEN 'N' THEN '' ELSE NULL END AS flow_type
FROM {lineitem}
"""

# A densely cyclic call graph over parts, every part a root of its own.
PART_COMPONENTS = """
SELECT CAST(p_partkey AS STRING) AS id, 'p0' AS project_id, p_name AS component_name, 'FUNCTION' AS component_type, CAST(NULL AS STRING) AS component_desc,
       CAST(NULL AS STRING) AS parent_component_id, p_size = 50 AS is_noise, p_size AS order_seq
FROM {part}
"""

PART_CALLS = """
SELECT CAST(p_partkey AS STRING) AS parent_id, CAST((3 * p_partkey + 1) % n AS STRING) AS child_id, 'L1' AS hierarchy_level, 0 AS call_order
FROM {part} JOIN (SELECT count(*) AS n FROM {part}) c ON p_partkey < n
UNION ALL
SELECT CAST(p_partkey AS STRING), CAST((5 * p_partkey + 2) % n AS STRING), 'L1', 1 FROM {part} JOIN (SELECT count(*) AS n FROM {part}) c ON p_partkey < n
"""

PART_TRACE = """
SELECT CAST(p_partkey AS STRING) AS fk_parent_component_id, CAST((p_partkey + p_size) % n AS STRING) AS fk_child_component_id, 'CALLS' AS relationship_type
FROM {part} JOIN (SELECT count(*) AS n FROM {part}) c ON p_partkey < n
"""
