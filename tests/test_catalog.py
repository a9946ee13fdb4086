from pyspark.sql import functions as F

from weftline.operators import catalog


def files(spark, language, content, path="models/x"):
    return spark.createDataFrame(
        [("f", "p", path, language, content)], "id string, project_id string, file_path string, language string, content string"
    )


def got(df):
    rows = df.orderBy("table_seq", "col_seq").collect()
    return [(r.table_name, r.column_name, r.data_type, r.is_primary_key, r.is_foreign_key, r.foreign_table, r.foreign_column) for r in rows]


def test_ddl(spark):
    sql = """
    create table if not exists `users` (
      "id" UUID PRIMARY KEY DEFAULT gen_random_uuid(),
      price DECIMAL(10,2) NOT NULL,
      team_id INT REFERENCES "teams" ( id ),
      key_note TEXT,
      unique_name TEXT, -- remark
      lost INT,
      FOREIGN KEY (team_id) REFERENCES teams(id)
    );
    CREATE TABLE public.skipped (a INT);
    CREATE TABLE [bracketed] (a INT);
    CREATE TABLE nothing (PRIMARY KEY (a));
    CREATE TABLE unended (a INT)
    """
    assert got(catalog.ddl_columns(files(spark, "sql", sql))) == [
        ("users", "id", "UUID PRIMARY KEY DEFAULT gen_random_uuid()", True, False, None, None),
        ("users", "price", "DECIMAL(10", False, False, None, None),
        ("users", "team_id", "INT REFERENCES", False, True, "teams", "id"),
    ]


def test_prisma(spark):
    text = """
model UserAccount {
  id Int @id
  teamId Int
  team Team @relation(fields: [teamId])
  posts Post[]
  createdAt DateTime @map("created")
  kind lower
  // skipped Int
  @@index([id])
}
model Other { x String
  @@map("others_table") }
"""
    assert got(catalog.prisma_columns(files(spark, "prisma", text))) == [
        ("user_accounts", "id", "Int", True, False, None, None),
        ("user_accounts", "team_id", "Int", False, True, None, None),
        ("user_accounts", "created", "DateTime", False, False, None, None),
        ("user_accounts", "kind", "lower", False, False, None, None),
        ("others_table", "x", "String", False, False, None, None),
    ]
    assert got(catalog.prisma_columns(files(spark, "unknown", "model  A { b Int }")))[0][:2] == ("as", "b")
    assert got(catalog.prisma_columns(files(spark, "go", "model\tA { b Int }"))) == []


def test_sqlalchemy(spark):
    text = """
class User(Base):
    __tablename__ = 'users'
    id = Column(Integer, primary_key=True)
    code = Column(String(50), primary_key=True)
    team = mapped_column(ForeignKey("teams.id"))
    odd = Column(Geometry)

class Mixin(object):
    a = Column(Integer)

class Last(Base):
    __tablename__ = "last"
    z = Column(Text)"""
    assert got(catalog.sqlalchemy_columns(files(spark, "python", text))) == [
        ("users", "id", "Integer", True, False, None, None),
        ("users", "code", "String", False, False, None, None),  # arguments end at the first ')'
        ("users", "team", "unknown", False, True, "teams", "id"),
        ("users", "odd", "unknown", False, False, None, None),
        ("last", "z", "Text", False, False, None, None),  # the class at the end of the text counts
    ]


def test_go(spark):
    text = """
type User struct {
  ID uint `gorm:"primaryKey" json:"id"`
  TeamID int `gorm:"column:team_ref" json:"team"`
  HTTPPort int `db:"p"`
  Base pkg.Model `json:"base"`
  When time.Time `gorm:"column:seen"`
  Hidden string `json:"-"`
}
func (u User) TableName() string { return "people" }
type Plain struct { A int }
type Cut struct {
  Any interface{} `json:"any"`
  Gone int `json:"gone"`
}
type Tag struct { A int `json:"a"` }
"""
    assert got(catalog.go_columns(files(spark, "go", text))) == [
        ("people", "id", "uint", True, False, None, None),
        ("people", "team_ref", "int", False, True, None, None),
        ("people", "http_port", "int", False, False, None, None),
        ("people", "seen", "time.Time", False, False, None, None),
        ("people", "hidden", "string", False, False, None, None),
        ("tags", "a", "int", False, False, None, None),
    ]


def test_jpa_key_marks_before_the_field(spark):
    text = """@Entity
public class UserItem {
  @Id private Long first;
  private String second;
  @Id
  @GeneratedValue
  private Long third;
""" + "  // " + "x" * 210 + """
  @ManyToOne
  private Team team;
  @Column(name = "c_name", length = 3)
  private String named;
}
"""
    assert got(catalog.jpa_columns(files(spark, "java", text))) == [
        ("user_items", "first", "Long", False, False, None, None),  # the field's own match takes in @Id
        ("user_items", "second", "String", True, False, None, None),  # and lies before the next field
        ("user_items", "third", "Long", True, False, None, None),
        ("user_items", "team", "Team", False, True, None, None),
        ("user_items", "c_name", "String", False, True, None, None),
    ]


def test_a_table_stated_twice_stays_twice(spark):
    both = files(spark, "prisma", "model users { id Int }\n/* create table users (id INT); */", path="schema.prisma")
    found = catalog.build_catalog(both)
    assert sorted((r.parser, r.table_name) for r in found.collect()) == [("ddl", "users"), ("prisma", "userss")]
    same = files(spark, "prisma", 'model A { id Int\n @@map("users") }\ncreate table users (id INT);', path="schema.prisma")
    assert catalog.db_schemas(catalog.build_catalog(same)).count() == 2
    kept = catalog.build_catalog(same, dedupe=True).collect()
    assert [(r.parser, r.table_name, r.column_name) for r in kept] == [("ddl", "users", "id")]


def test_only_flagged_files_make_the_catalog(spark):
    plain = files(spark, "go", "create table t (a INT);", path="main.go")
    assert catalog.build_catalog(plain).count() == 0
    assert catalog.db_columns(catalog.build_catalog(files(spark, "sql", "create table t (a INT);", path="x.sql"))).select(F.col("data_type")).first()[0] == "INT"
