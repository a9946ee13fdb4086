"""Rule tables for recognising object-relational mappers in source text.

Order is data: the first mapper, then the first rule, that matches wins.
Patterns are in ECMAScript syntax (see :mod:`weftline.functions.text`).
"""

from __future__ import annotations

from typing import NamedTuple


class Mapper(NamedTuple):
    name: str
    language: str
    indicators: list[str]
    usages: list[tuple[str, str]]  # (usage type, pattern)
    models: list[tuple[int, str]]  # (group holding the table, pattern)
    fields: list[tuple[int, int, str]]  # (group holding the field, group holding the column, pattern)


# Mapper names, languages, patterns, capture groups and their order.
MAPPERS = [
    Mapper(
        "Prisma",
        "typescript",
        indicators=[
            r"""from\s+['"]@prisma\/client['"]""",
            r"""PrismaClient""",
            r"""prisma\.\w+\.(findMany|findUnique|findFirst|create|update|delete|upsert|aggregate|groupBy|count)""",
        ],
        usages=[
            ("read", r"""prisma\.\w+\.findMany|prisma\.\w+\.findFirst|prisma\.\w+\.findUnique"""),
            ("write", r"""prisma\.\w+\.create|prisma\.\w+\.createMany"""),
            ("update", r"""prisma\.\w+\.update|prisma\.\w+\.updateMany|prisma\.\w+\.upsert"""),
            ("delete", r"""prisma\.\w+\.delete|prisma\.\w+\.deleteMany"""),
            ("projection", r"""select\s*:\s*\{"""),
            ("filter", r"""where\s*:\s*\{"""),
            ("join", r"""include\s*:\s*\{"""),
            ("read", r"""orderBy\s*:\s*\{"""),
        ],
        models=[
            (1, r"""model\s+(\w+)\s*\{"""),
            (1, r"""@@map\(["'](\w+)["']\)"""),
        ],
        fields=[
            (1, 2, r"""(\w+)\s+\w+.*@map\(["'](\w+)["']\)"""),
        ],
    ),
    Mapper(
        "Sequelize",
        "javascript",
        indicators=[
            r"""require\s*\(\s*['"]sequelize['"]\s*\)""",
            r"""from\s+['"]sequelize['"]""",
            r"""sequelize\.define""",
            r"""Model\.init\s*\(""",
        ],
        usages=[
            ("read", r"""\.findAll\s*\(|\.findOne\s*\(|\.findByPk\s*\(|\.findAndCountAll\s*\("""),
            ("write", r"""\.create\s*\(|\.bulkCreate\s*\("""),
            ("update", r"""\.update\s*\(|\.save\s*\("""),
            ("delete", r"""\.destroy\s*\("""),
            ("projection", r"""attributes\s*:\s*\["""),
            ("filter", r"""where\s*:\s*\{"""),
            ("join", r"""include\s*:\s*\["""),
        ],
        models=[
            (1, r"""sequelize\.define\s*\(\s*['"](\w+)['"]"""),
            (1, r"""tableName\s*:\s*['"](\w+)['"]"""),
        ],
        fields=[
            (1, 2, r"""(\w+)\s*:\s*\{\s*type\s*:.*field\s*:\s*['"](\w+)['"]"""),
        ],
    ),
    Mapper(
        "TypeORM",
        "typescript",
        indicators=[
            r"""from\s+['"]typeorm['"]""",
            r"""@Entity\s*\(""",
            r"""@Column\s*\(""",
            r"""getRepository\s*\(""",
            r"""createQueryBuilder\s*\(""",
        ],
        usages=[
            ("read", r"""\.find\s*\(|\.findOne\s*\(|\.findOneBy\s*\(|\.findBy\s*\("""),
            ("write", r"""\.save\s*\(|\.insert\s*\("""),
            ("update", r"""\.update\s*\(|\.merge\s*\("""),
            ("delete", r"""\.delete\s*\(|\.remove\s*\(|\.softDelete\s*\("""),
            ("projection", r"""\.select\s*\(|addSelect\s*\("""),
            ("filter", r"""\.where\s*\(|\.andWhere\s*\(|\.orWhere\s*\("""),
            ("join", r"""\.leftJoin|\.innerJoin|\.leftJoinAndSelect|\.innerJoinAndSelect"""),
            ("read", r"""createQueryBuilder"""),
        ],
        models=[
            (1, r"""@Entity\s*\(\s*['"](\w+)['"]"""),
            (1, r"""@Entity\s*\(\s*\{[^}]*name\s*:\s*['"](\w+)['"]"""),
        ],
        fields=[
            (2, 1, r"""@Column\s*\(\s*\{[^}]*name\s*:\s*['"](\w+)['"][^}]*\}\s*\)\s*(\w+)"""),
            (1, 1, r"""@Column\s*\([^)]*\)\s*(\w+)"""),
        ],
    ),
    Mapper(
        "GORM",
        "go",
        indicators=[
            r'''"gorm\.io\/gorm"''',
            r'''"gorm\.io\/driver\/''',
            r"""gorm\.Model""",
            r"""\.Preload\s*\(""",
        ],
        usages=[
            ("read", r"""\.Find\s*\(|\.First\s*\(|\.Last\s*\(|\.Take\s*\(|\.Scan\s*\("""),
            ("write", r"""\.Create\s*\(|\.Save\s*\("""),
            ("update", r"""\.Update\s*\(|\.Updates\s*\(|\.Save\s*\("""),
            ("delete", r"""\.Delete\s*\("""),
            ("projection", r"""\.Select\s*\("""),
            ("filter", r"""\.Where\s*\(|\.Or\s*\(|\.Not\s*\("""),
            ("join", r"""\.Joins\s*\(|\.Preload\s*\(|\.Association\s*\("""),
        ],
        models=[
            (
                2,
                r"""func\s*\(\s*\w+\s+(\w+)\s*\)\s*TableName\s*\(\s*\)\s*string\s*\{[^}]*return\s+["'](\w+)["']""",
            ),
        ],
        fields=[
            (1, 2, r"""(\w+)\s+\w+\s+`[^`]*gorm:"column:(\w+)"""),
            (1, 2, r"""(\w+)\s+\w+\s+`[^`]*json:"(\w+)"""),
        ],
    ),
    Mapper(
        "SQLAlchemy",
        "python",
        indicators=[
            r"""from\s+sqlalchemy""",
            r"""import\s+sqlalchemy""",
            r"""Base\.metadata""",
            r"""declarative_base\s*\(""",
            r"""mapped_column\s*\(""",
        ],
        usages=[
            (
                "read",
                r"""session\.query\s*\(|\.all\s*\(|\.first\s*\(|\.one\s*\(|\.scalars\s*\(|\.execute\s*\(.*select""",
            ),
            ("write", r"""session\.add\s*\(|session\.add_all\s*\(|\.insert\s*\("""),
            ("update", r"""session\.merge\s*\(|\.update\s*\("""),
            ("delete", r"""session\.delete\s*\(|\.delete\s*\("""),
            ("projection", r"""\.with_entities\s*\(|\.options\s*\(.*load_only"""),
            ("filter", r"""\.filter\s*\(|\.filter_by\s*\(|\.where\s*\("""),
            ("join", r"""\.join\s*\(|\.outerjoin\s*\(|relationship\s*\("""),
        ],
        models=[
            (1, r"""__tablename__\s*=\s*['"](\w+)['"]"""),
        ],
        fields=[
            (1, 1, r"""(\w+)\s*=\s*(?:Column|mapped_column)\s*\("""),
            (1, 2, r"""(\w+)\s*=\s*Column\s*\(\s*['"](\w+)['"]"""),
        ],
    ),
    Mapper(
        "Hibernate",
        "java",
        indicators=[
            r"""import\s+javax\.persistence\.""",
            r"""import\s+jakarta\.persistence\.""",
            r"""import\s+org\.hibernate\.""",
            r"""@Entity""",
            r"""@Table""",
        ],
        usages=[
            ("read", r"""\.find\s*\(|\.get\s*\(|\.load\s*\(|\.createQuery\s*\(.*SELECT|entityManager\.find"""),
            ("write", r"""\.persist\s*\(|\.save\s*\(|\.saveAndFlush\s*\("""),
            ("update", r"""\.merge\s*\(|\.update\s*\(|\.saveAndFlush\s*\("""),
            ("delete", r"""\.remove\s*\(|\.delete\s*\(|\.deleteById\s*\("""),
            ("projection", r"""\.createQuery\s*\(\s*["']SELECT\s+\w+\.\w+"""),
            ("filter", r"""\.createQuery\s*\(\s*["'].*WHERE|\.setParameter\s*\("""),
            ("join", r"""JOIN\s+FETCH|@ManyToOne|@OneToMany|@ManyToMany|@OneToOne"""),
            ("read", r"""CriteriaBuilder|CriteriaQuery|Specification"""),
        ],
        models=[
            (1, r"""@Table\s*\(\s*name\s*=\s*["'](\w+)["']"""),
        ],
        fields=[
            (2, 1, r"""@Column\s*\(\s*name\s*=\s*["'](\w+)["']\s*\)[\s\S]*?private\s+\w+\s+(\w+)"""),
            (1, 1, r"""private\s+\w+\s+(\w+)\s*;"""),
        ],
    ),
    Mapper(
        "ActiveRecord",
        "ruby",
        indicators=[
            r"""ActiveRecord::Base""",
            r"""ApplicationRecord""",
            r"""ActiveRecord::Migration""",
            r"""has_many\s+:""",
            r"""belongs_to\s+:""",
        ],
        usages=[
            (
                "read",
                r"""\.find\s*\(|\.find_by\s*\(|\.where\s*\(.*\)\.first|\.all\b|\.pluck\s*\(|\.select\s*\(""",
            ),
            ("write", r"""\.create\s*\(|\.create!\s*\(|\.new\s*\(.*\.save"""),
            ("update", r"""\.update\s*\(|\.update!\s*\(|\.update_attribute"""),
            ("delete", r"""\.destroy\s*\(|\.delete\s*\(|\.destroy_all"""),
            ("projection", r"""\.select\s*\(|\.pluck\s*\("""),
            ("filter", r"""\.where\s*\(|\.find_by\s*\(|\.having\s*\("""),
            ("join", r"""\.joins\s*\(|\.includes\s*\(|\.eager_load\s*\(|has_many|belongs_to|has_one"""),
        ],
        models=[
            (1, r"""self\.table_name\s*=\s*['"](\w+)['"]"""),
        ],
        fields=[],
    ),
    Mapper(
        "Diesel",
        "rust",
        indicators=[
            r"""use\s+diesel""",
            r"""diesel::table!""",
            r"""diesel::prelude""",
            r"""#\[derive\(.*Queryable""",
        ],
        usages=[
            ("read", r"""\.load\s*[:<]|\.first\s*[:<]|\.get_result\s*[:<]|\.select\s*\("""),
            ("write", r"""diesel::insert_into|\.values\s*\("""),
            ("update", r"""diesel::update|\.set\s*\("""),
            ("delete", r"""diesel::delete"""),
            ("projection", r"""\.select\s*\(|\.column\s*\("""),
            ("filter", r"""\.filter\s*\(|\.find\s*\("""),
            ("join", r"""\.inner_join\s*\(|\.left_join\s*\("""),
        ],
        models=[
            (1, r"""diesel::table!\s*\{\s*(\w+)"""),
            (1, r"""#\[diesel\(table_name\s*=\s*"?(\w+)"?\)]"""),
        ],
        fields=[
            (2, 1, r"""#\[diesel\(column_name\s*=\s*"?(\w+)"?\)]\s*(?:pub\s+)?(\w+)"""),
        ],
    ),
    Mapper(
        "EntityFramework",
        "csharp",
        indicators=[
            r"""using\s+Microsoft\.EntityFrameworkCore""",
            r"""using\s+System\.Data\.Entity""",
            r"""DbContext""",
            r"""DbSet\s*<""",
        ],
        usages=[
            (
                "read",
                r"""\.ToList\s*\(|\.FirstOrDefault\s*\(|\.SingleOrDefault\s*\(|\.Find\s*\(|\.AsNoTracking\s*\(""",
            ),
            ("write", r"""\.Add\s*\(|\.AddRange\s*\(|\.AddAsync\s*\("""),
            ("update", r"""\.Update\s*\(|\.Entry\s*\(.*\.State\s*=\s*EntityState\.Modified"""),
            ("delete", r"""\.Remove\s*\(|\.RemoveRange\s*\("""),
            ("projection", r"""\.Select\s*\("""),
            ("filter", r"""\.Where\s*\(|\.Any\s*\(|\.All\s*\("""),
            ("join", r"""\.Include\s*\(|\.ThenInclude\s*\(|\.Join\s*\("""),
        ],
        models=[
            (1, r"""\[Table\s*\(\s*["'](\w+)["']\s*\)]"""),
            (1, r"""modelBuilder\.Entity<\w+>\s*\(\s*\)\s*\.ToTable\s*\(\s*["'](\w+)["']"""),
        ],
        fields=[
            (2, 1, r"""\[Column\s*\(\s*["'](\w+)["']\s*\)]\s*public\s+\w+\s+(\w+)"""),
        ],
    ),
    Mapper(
        "Knex",
        "javascript",
        indicators=[
            r"""require\s*\(\s*['"]knex['"]\s*\)""",
            r"""from\s+['"]knex['"]""",
            r"""knex\s*\(\s*['"]""",
        ],
        usages=[
            ("read", r"""knex\s*\(\s*['"]|\.select\s*\("""),
            ("write", r"""\.insert\s*\("""),
            ("update", r"""\.update\s*\("""),
            ("delete", r"""\.del\s*\(|\.delete\s*\("""),
            ("projection", r"""\.select\s*\("""),
            ("filter", r"""\.where\s*\(|\.andWhere\s*\(|\.orWhere\s*\("""),
            ("join", r"""\.join\s*\(|\.leftJoin\s*\(|\.innerJoin\s*\("""),
        ],
        models=[],
        fields=[],
    ),
    Mapper(
        "Drizzle",
        "typescript",
        indicators=[
            r"""from\s+['"]drizzle-orm""",
            r"""from\s+['"]drizzle-orm\/pg-core['"]""",
            r"""pgTable\s*\(""",
            r"""mysqlTable\s*\(""",
            r"""sqliteTable\s*\(""",
        ],
        usages=[
            ("read", r"""db\.select\s*\(|db\.query\.\w+\.findMany|db\.query\.\w+\.findFirst"""),
            ("write", r"""db\.insert\s*\("""),
            ("update", r"""db\.update\s*\("""),
            ("delete", r"""db\.delete\s*\("""),
            ("projection", r"""\.columns\s*\(|\.fields\s*\("""),
            ("filter", r"""\.where\s*\(|eq\s*\(|and\s*\(|or\s*\("""),
            ("join", r"""\.innerJoin\s*\(|\.leftJoin\s*\(|\.rightJoin\s*\(|with\s*:\s*\{"""),
        ],
        models=[
            (1, r"""(?:pgTable|mysqlTable|sqliteTable)\s*\(\s*['"](\w+)['"]"""),
        ],
        fields=[
            (
                1,
                1,
                r"""(\w+)\s*:\s*(?:varchar|text|integer|serial|boolean|timestamp|uuid|numeric|real|bigint|smallint|json|jsonb)\s*\(""",
            ),
        ],
    ),
]

# Line rules, tried in this order, ignoring case.
LINE_RULES = [
    ("write", r"""\b(INSERT\s+INTO|\.create|\.Create|\.add|\.Add|\.persist|\.save)\b"""),
    ("update", r"""\b(UPDATE\s+\w+\s+SET|\.update|\.Update|\.merge|\.Merge|\.set\s*\()"""),
    ("delete", r"""\b(DELETE\s+FROM|\.delete|\.Delete|\.remove|\.Remove|\.destroy|\.Destroy)"""),
    (
        "join",
        r"""\b(JOIN|INNER\s+JOIN|LEFT\s+JOIN|RIGHT\s+JOIN|CROSS\s+JOIN|\.join|\.Join|\.include|\.Include|\.Preload)""",
    ),
    (
        "filter",
        r"""\b(WHERE|AND\s+\w+\s*=|OR\s+\w+\s*=|HAVING|\.filter|\.Filter|\.where|\.Where|\.findBy)""",
    ),
    (
        "projection",
        r"""\b(SELECT\s+\w|\.select\s*\(|\.Select\s*\(|\.pluck\s*\(|RETURNING|\.findMany|\.findFirst|\.findOne|\.findAll)""",
    ),
]

# Rules over the uppercased context, every word of a rule must occur.
CONTEXT_RULES = [
    ("write", [r"""\b(INSERT|CREATE)\b"""]),
    ("update", [r"""\bUPDATE\b""", r"""\bSET\b"""]),
    ("delete", [r"""\bDELETE\b"""]),
    ("join", [r"""\bJOIN\b"""]),
    ("filter", [r"""\bWHERE\b"""]),
    ("projection", [r"""\bSELECT\b"""]),
]
DEFAULT_USAGE = "read"

USAGE_TYPES = ["read", "write", "update", "delete", "join", "filter", "projection"]
