"""Queries that grow lineage trees, decorate, extend and export them."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import export, graph, reach, reports
from weftline.plans import bindings as b
from weftline.plans.bindings import bind, plain
from weftline.plans.registry import query
from weftline.plans.report_queries import DETAIL, _OF_COLUMNS, _OF_TABLES, _usage_roots, detail
from weftline.session import cut

DEPTH = graph.MAX_DEPTH


def _ctes(**ctes: str) -> str:
    return ", ".join(f"{name} AS ({plain(sql)})" for name, sql in ctes.items())


def _shown(tree):
    return tree.withColumn("path", F.array_join(F.col("path").cast("array<string>"), "."))


_EDGES = """
linked AS (
  SELECT parent_id, child_id, 'call' AS kind, call_order FROM hierarchy
  UNION ALL
  SELECT DISTINCT fk_parent_component_id, fk_child_component_id, 'trace', NULL FROM trace t
  WHERE NOT EXISTS (SELECT 1 FROM hierarchy h WHERE h.parent_id = t.fk_parent_component_id AND h.child_id = t.fk_child_component_id)
),
edges AS MATERIALIZED (
  SELECT parent_id, child_id, kind, row_number() OVER (PARTITION BY parent_id ORDER BY kind, call_order NULLS LAST, order_seq NULLS LAST, child_id) AS ordinal
  FROM linked JOIN components c ON c.id = child_id AND (c.is_noise = false OR c.is_noise IS NULL)
)
"""
_LEVEL_ONE = """
level_one AS (SELECT root_id, component_id, row_number() OVER (PARTITION BY root_id ORDER BY order_seq NULLS LAST, component_name, component_id) AS ordinal FROM hits)
"""


def _first_visits(max_depth: int) -> str:
    """Level by level, a table each for arrivals and for what is kept of them."""
    ctes = [
        """arrive_1 AS (SELECT root_id, [ordinal] AS path, 1 AS depth, component_id, CAST(NULL AS VARCHAR) AS parent_id, 'root' AS kind FROM level_one)"""
    ]
    for d in range(1, max_depth + 1):
        if d > 1:
            ctes.append(
                f"""arrive_{d} AS MATERIALIZED (SELECT k.root_id, list_append(k.path, e.ordinal) AS path, {d} AS depth, e.child_id AS component_id, e.parent_id, e.kind
                FROM kept_{d - 1} k JOIN edges e ON e.parent_id = k.component_id WHERE NOT k.is_cycle)"""
            )
        seen = " UNION ALL ".join(f"SELECT root_id, component_id FROM kept_{i} WHERE NOT is_cycle" for i in range(1, d))
        old = f"(a.root_id, a.component_id) IN (SELECT (root_id, component_id) FROM ({seen}))" if seen else "false"
        ctes.append(
            f"""kept_{d} AS MATERIALIZED (SELECT * FROM (SELECT a.*, ({old}) OR row_number() OVER (PARTITION BY root_id, component_id ORDER BY path) > 1 AS is_cycle FROM arrive_{d} a)
            WHERE kind <> 'trace' OR NOT is_cycle)"""
        )
    ctes.append("tree AS (" + " UNION ALL ".join(f"SELECT * FROM kept_{d}" for d in range(1, max_depth + 1)) + ")")
    return ", ".join(ctes)


def _all_paths(max_depth: int) -> str:
    return f"""
    walked AS (
      SELECT root_id, [ordinal] AS path, 1 AS depth, component_id, CAST(NULL AS VARCHAR) AS parent_id, 'root' AS kind, false AS is_cycle, [component_id] AS seen FROM level_one
      UNION ALL
      SELECT w.root_id, list_append(w.path, e.ordinal), w.depth + 1, e.child_id, e.parent_id, e.kind, list_contains(w.seen, e.child_id), list_append(w.seen, e.child_id)
      FROM walked w JOIN edges e ON e.parent_id = w.component_id
      WHERE NOT w.is_cycle AND w.depth < {max_depth} AND (e.kind = 'call' OR NOT list_contains(w.seen, e.child_id))
    ),
    tree AS (SELECT * EXCLUDE (seen) FROM walked)
    """


_SHOW = "SELECT root_id, array_to_string(path, '.') AS path, depth, component_id, parent_id, kind, is_cycle FROM tree"

_MAIN = _ctes(components=b.COMPONENTS, trace=b.TRACE, hierarchy=b.HIERARCHY)


def _main_edges(spark, sf):
    return graph.child_edges(bind(spark, sf, b.HIERARCHY), bind(spark, sf, b.TRACE), bind(spark, sf, b.COMPONENTS))


@query("g2_child_edges", f"WITH {_MAIN}, {_EDGES} SELECT * FROM edges")
def child_edges(spark, sf):
    return _main_edges(spark, sf)


# Regions down to orders: nations are the first level.
_REGION_HITS = """
SELECT 'r' || CAST(n_regionkey AS STRING) AS root_id, 'n' || CAST(n_nationkey AS STRING) AS component_id, n_name AS component_name, 'TABLE' AS component_type, n_nationkey AS order_seq FROM {nation}
"""
_TREE_TRACE = f"SELECT * FROM ({b.TRACE}) t WHERE relationship_type <> 'USES'"
_NO_CALLS = "SELECT parent_id, child_id, hierarchy_level, call_order FROM ({}) h WHERE parent_id = 'none'".format(b.HIERARCHY)
_TREE = _ctes(components=b.COMPONENTS, trace=_TREE_TRACE, hierarchy=_NO_CALLS, hits=_REGION_HITS)


def _region_tree(spark, sf, mode, max_depth=graph.MAX_DEPTH):
    edges = graph.child_edges(bind(spark, sf, _NO_CALLS), bind(spark, sf, _TREE_TRACE), bind(spark, sf, b.COMPONENTS))
    return graph.lineage_tree(graph.first_level(bind(spark, sf, _REGION_HITS)), edges, max_depth, mode)


@query("g1_region_tree", f"WITH RECURSIVE {_TREE}, {_EDGES}, {_LEVEL_ONE}, {_all_paths(10)} {_SHOW}")
def region_tree(spark, sf):
    return _shown(_region_tree(spark, sf, "first_visits"))


@query("g1_region_tree_paths", f"WITH RECURSIVE {_TREE}, {_EDGES}, {_LEVEL_ONE}, {_all_paths(10)} {_SHOW}")
def region_tree_paths(spark, sf):
    return _shown(_region_tree(spark, sf, "all_paths"))


@query("g3_depth_limit", f"WITH RECURSIVE {_TREE}, {_EDGES}, {_LEVEL_ONE}, {_all_paths(2)} {_SHOW}")
def depth_limit(spark, sf):
    return _shown(_region_tree(spark, sf, "first_visits", max_depth=2))


# Shared children: orders hang below nations and below customers, and call one another.
_SHARED = _ctes(components=b.COMPONENTS, trace=b.TRACE, hierarchy=b.HIERARCHY, hits=_REGION_HITS)


@query("g4_shared_children", f"WITH {_SHARED}, {_EDGES}, {_LEVEL_ONE}, {_first_visits(DEPTH)} {_SHOW}")
def shared_children(spark, sf):
    return _shown(graph.lineage_tree(graph.first_level(bind(spark, sf, _REGION_HITS)), _main_edges(spark, sf)))


_PART_HITS = "SELECT CAST(p_partkey AS STRING) AS root_id, CAST(p_partkey AS STRING) AS component_id, p_name AS component_name, 'FUNCTION' AS component_type, p_size AS order_seq FROM {part}"
_PARTS = _ctes(components=b.PART_COMPONENTS, trace=b.PART_TRACE, hierarchy=b.PART_CALLS, hits=_PART_HITS)


# All parts are roots and each reaches 3^depth others, so the rows at depth 10 grow with the square of the parts.
PART_DEPTH = 4


def _part_edges(spark, sf):
    return graph.child_edges(bind(spark, sf, b.PART_CALLS), bind(spark, sf, b.PART_TRACE), bind(spark, sf, b.PART_COMPONENTS))


def _part_tree(spark, sf, mode):
    return graph.lineage_tree(graph.first_level(bind(spark, sf, _PART_HITS)), _part_edges(spark, sf), PART_DEPTH, mode)


@query("g4_cycles_on_paths", f"WITH RECURSIVE {_PARTS}, {_EDGES}, {_LEVEL_ONE}, {_all_paths(4)} {_SHOW}")
def cycles_on_paths(spark, sf):
    return _shown(_part_tree(spark, sf, "all_paths"))


@query("g4_first_visits", f"WITH {_PARTS}, {_EDGES}, {_LEVEL_ONE}, {_first_visits(PART_DEPTH)} {_SHOW}")
def first_visits(spark, sf):
    return _shown(_part_tree(spark, sf, "first_visits"))


# One search for all parts as roots. Paths only for a hundredth of them: as the query set of a search, against all parts.
_ASKED_HITS = _PART_HITS + " WHERE p_partkey % 100 = 0"
_ASKED = _ctes(components=b.PART_COMPONENTS, trace=b.PART_TRACE, hierarchy=b.PART_CALLS, hits=_ASKED_HITS)


@query("g4_first_visits_deep", f"WITH {_ASKED}, {_EDGES}, {_LEVEL_ONE}, {_first_visits(DEPTH)} {_SHOW}")
def first_visits_deep(spark, sf):
    return _shown(graph.lineage_tree(graph.first_level(bind(spark, sf, _ASKED_HITS)), _part_edges(spark, sf), DEPTH))


def _reach(max_depth: int) -> str:
    """Pairs of root and component by their least depth, a table per level."""
    ctes = ["reach_1 AS MATERIALIZED (SELECT DISTINCT root_id, component_id FROM hits)"]
    for d in range(2, max_depth + 1):
        seen = " UNION ALL ".join(f"SELECT * FROM reach_{i}" for i in range(1, d))
        ctes.append(
            f"""reach_{d} AS MATERIALIZED (SELECT n.* FROM (SELECT DISTINCT k.root_id, e.child_id AS component_id FROM reach_{d - 1} k JOIN edges e ON e.parent_id = k.component_id) n
            ANTI JOIN ({seen}) s ON s.root_id = n.root_id AND s.component_id = n.component_id)"""
        )
    ctes.append("reached AS (" + " UNION ALL ".join(f"SELECT *, {d} AS depth FROM reach_{d}" for d in range(1, max_depth + 1)) + ")")
    return ", ".join(ctes)


def _reached(spark, sf, hits=_PART_HITS):
    return reach.reach(bind(spark, sf, hits), _part_edges(spark, sf), DEPTH)


@query(
    "g4_reached_counts",
    f"WITH {_PARTS}, {_EDGES}, {_reach(DEPTH)} SELECT root_id, depth, count(*) AS n_components FROM reached GROUP BY root_id, depth",
)
def reached_counts(spark, sf):
    return reach.counts(_reached(spark, sf))


@query(
    "g4_roots_above",
    f"WITH {_PARTS}, {_EDGES}, {_reach(DEPTH)} SELECT component_id, count(*) AS n_roots, min(depth) AS least_depth FROM reached GROUP BY component_id",
)
def roots_above(spark, sf):
    return reach.roots_above(_reached(spark, sf))


@query(
    "g4_reached_components",
    f"WITH {_PARTS}, {_EDGES}, {_reach(DEPTH)} SELECT * FROM reached WHERE CAST(root_id AS BIGINT) % 100 = 0",
)
def reached_components(spark, sf):
    """Roots do not meet one another, so those that are not shown need not search."""
    return reach.pairs(_reached(spark, sf, _ASKED_HITS), bind(spark, sf, _ASKED_HITS))


# Table lineage as a user asks for it: roots are tables, the first level what uses them.
_TABLE_HITS = """
hits AS (
  SELECT DISTINCT r.root_id, c.id AS component_id, c.component_name, c.component_type, c.order_seq
  FROM roots r JOIN components t ON t.component_name = r.table_name AND t.component_type = 'TABLE'
  JOIN trace e ON e.fk_parent_component_id = t.id JOIN components c ON c.id = e.fk_child_component_id AND c.project_id = r.project_id
  WHERE c.component_type NOT IN ('CREATE_COLUMN_DEFINITION', 'CREATE_TABLE_STATEMENT') AND (c.is_noise = false OR c.is_noise IS NULL)
)
"""


def _number(column: str) -> str:
    hexed = f"regexp_extract(left(replace({column}, '-', ''), 8), '^[0-9A-Fa-f]*')"
    return f"CASE WHEN {hexed} <> '' THEN CAST('0x' || {hexed} AS BIGINT) END"


_TYPES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in graph.NODE_TYPES.items())
_COLORS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in graph.NODE_COLORS.items())
_NODES = f"""
named AS (
  SELECT root_id, path, depth, component_id, t.parent_id, kind, is_cycle, CASE WHEN is_cycle THEN '[Cycle] ' ELSE '' END || component_name AS name, component_type, component_desc,
    parent_component_id, coalesce(is_noise, false) AS is_noise, nullif(order_seq, 0) AS order_seq
  FROM tree t JOIN components c ON c.id = t.component_id
  UNION ALL
  SELECT DISTINCT root_id, CAST([] AS BIGINT[]), 0, NULL, NULL, 'root', false, table_name, 'TABLE', NULL, NULL, false, NULL FROM roots
),
nodes AS (
  SELECT *, CASE component_type {_TYPES} ELSE 'FUNCTION' END AS type, CASE WHEN length(name) > 40 THEN left(name, 40) || '...' ELSE name END AS display_name,
    CASE CASE component_type {_TYPES} ELSE 'FUNCTION' END {_COLORS} END AS color,
    CASE WHEN component_id IS NULL OR is_cycle THEN 0 ELSE {_number('component_id')} END AS id, {_number('parent_component_id')} AS parent_comp_id
  FROM named
)
"""
_LINEAGE = (
    _ctes(components=b.COMPONENTS, trace=b.TRACE, hierarchy=b.HIERARCHY, roots=b.TABLE_ROOTS, flows=b.FLOWS)
    + f", {_EDGES}, {_TABLE_HITS}, {_LEVEL_ONE}, {_first_visits(DEPTH)}, {_NODES}"
)


def _lineage(spark, sf):
    components = bind(spark, sf, b.COMPONENTS)
    roots = bind(spark, sf, b.TABLE_ROOTS)
    hits = reports.components_of_tables(roots, components, bind(spark, sf, b.TRACE))
    tree = graph.lineage_tree(graph.first_level(hits), _main_edges(spark, sf), DEPTH)
    return graph.decorate(tree, roots, graph.known_components(components, hits))


@query("g5_table_lineage", f"WITH {_LINEAGE} SELECT * REPLACE (array_to_string(path, '.') AS path) FROM nodes")
def table_lineage(spark, sf):
    return _shown(_lineage(spark, sf))


# Roots with components, and roots of the catalog that only files use: these stand in at level one.
_KNOWN = """
known AS (
  SELECT id, component_name, component_type, component_desc, parent_component_id, is_noise, order_seq FROM components
  UNION ALL SELECT DISTINCT component_id, component_name, 'FILE', NULL, NULL, false, NULL FROM hits WHERE component_type = 'FILE'
)
"""


def _with_files(roots: str, found: str, keys: list[str]) -> str:
    """Nodes of trees whose roots are CTE ``roots``; ``found`` names the CTE of components at level one."""
    same = " AND ".join(f"r.{key} = d.{key}" for key in keys)
    hits = f"""
    hits AS (
      SELECT * FROM {found}
      UNION ALL SELECT DISTINCT root_id, file_id, file_path, 'FILE', NULL FROM detail d JOIN {roots} r ON {same}
      WHERE root_id NOT IN (SELECT root_id FROM {found})
    )
    """
    nodes = _NODES.replace("JOIN components c", "JOIN known c").replace("FROM roots", f"FROM {roots}")
    return f"{hits}, {_KNOWN}, {_EDGES}, {_LEVEL_ONE}, {_first_visits(DEPTH)}, {nodes} SELECT * REPLACE (array_to_string(path, '.') AS path) FROM nodes"


def _tree_with_files(spark, sf, roots, rows, by_column):
    components, trace = bind(spark, sf, b.COMPONENTS), bind(spark, sf, b.TRACE)
    found = (reports.components_of_columns if by_column else reports.components_of_tables)(roots, components, trace)
    files = reports.files_of_roots(roots, rows, by_column=by_column).drop("language")
    hits = cut(reports.with_fallback(found, files))
    tree = graph.lineage_tree(graph.first_level(hits), _main_edges(spark, sf), DEPTH)
    return _shown(graph.decorate(tree, roots, graph.known_components(components, hits)))


_FACTS = _ctes(components=b.COMPONENTS, trace=b.TRACE, hierarchy=b.HIERARCHY)


@query(
    "g1_column_lineage",
    f"""{DETAIL}, {_FACTS}, asked AS ({plain(b.COLUMN_ROOTS)}),
    column_roots AS (SELECT root_id, project_id, table_name, column_name FROM asked
      UNION SELECT table_name || '.' || column_name, project_id, table_name, column_name FROM detail),
    {_OF_COLUMNS}, {_with_files("column_roots", "of_columns", ["project_id", "table_name", "column_name"])}""",
)
def column_lineage(spark, sf):
    rows = detail(spark, sf)
    asked = bind(spark, sf, b.COLUMN_ROOTS).select("root_id", "project_id", "table_name", "column_name")
    return _tree_with_files(spark, sf, asked.unionByName(_usage_roots(rows)).distinct(), rows, by_column=True)


@query(
    "g1_file_fallback_lineage",
    f"""{DETAIL}, {_FACTS}, asked AS ({plain(b.TABLE_ROOTS)}),
    table_roots AS (SELECT root_id, project_id, table_name FROM asked UNION SELECT table_name, project_id, table_name FROM detail),
    {_OF_TABLES}, {_with_files("table_roots", "of_tables", ["project_id", "table_name"])}""",
)
def file_fallback_lineage(spark, sf):
    rows = detail(spark, sf)
    asked = bind(spark, sf, b.TABLE_ROOTS).select("root_id", "project_id", "table_name")
    used = rows.select(F.col("table_name").alias("root_id"), "project_id", "table_name")
    return _tree_with_files(spark, sf, asked.unionByName(used).distinct(), rows, by_column=False)


# Every other table root asks for one column and so gets no type information.
_MODES = "SELECT root_id, project_id, table_name, CASE WHEN length(root_id) % 2 = 0 THEN 'col_1' END AS column_name FROM roots"


@query(
    "g6_root_type_information",
    f"""WITH {_LINEAGE}, modes AS ({_MODES}), found AS (SELECT DISTINCT root_id, c.id AS component_id, c.component_name AS name FROM modes r
      JOIN components t ON t.project_id = r.project_id AND t.component_name = r.table_name AND t.component_type = 'TABLE'
      JOIN components c ON c.parent_component_id = t.id AND c.component_type = 'COLUMN' WHERE r.column_name IS NULL)
    SELECT root_id, component_id, name, row_number() OVER (PARTITION BY root_id ORDER BY name, component_id) AS position,
      CASE WHEN row_number() OVER (PARTITION BY root_id ORDER BY name, component_id) % 2 = 1 THEN '#b2f1ca' ELSE '#FFFFFF' END AS color FROM found""",
)
def root_type_information(spark, sf):
    roots = bind(spark, sf, _MODES.replace("FROM roots", "FROM {roots}"), roots=bind(spark, sf, b.TABLE_ROOTS))
    columns = reports.root_columns(
        roots, bind(spark, sf, b.COMPONENTS), bind(spark, sf, b.NATION_SCHEMAS), bind(spark, sf, b.NATION_COLUMNS)
    )
    return graph.table_type_information(roots, columns)


def _flows(match: str, condition: str) -> str:
    return f"""
    placed AS (
      SELECT root_id, {match} AS name, target_table, flow_type,
        row_number() OVER (PARTITION BY root_id, {match} ORDER BY flow_sequence NULLS LAST, target_table, coalesce(flow_type, '')) AS place
      FROM (SELECT DISTINCT root_id, project_id, table_name FROM roots) r JOIN flows f ON f.project_id = r.project_id
      WHERE target_table <> '' AND {condition}
    ),
    extended AS (
      SELECT root_id, path, depth, component_id, parent_id, kind, name, type, display_name, id, component_desc FROM nodes
      UNION ALL
      SELECT n.root_id, list_append(n.path, p.place + {graph.AFTER_COMPONENTS}), n.depth + 1, NULL, n.component_id, 'flow', p.target_table, 'TABLE',
        CASE WHEN length(p.target_table) > 40 THEN left(p.target_table, 40) || '...' ELSE p.target_table END, 0, 'ETL: ' || coalesce(nullif(p.flow_type, ''), 'TRANSFORM')
      FROM nodes n JOIN placed p ON p.root_id = n.root_id AND p.name = n.name WHERE n.type = 'PROCEDURE'
    )
    """


_EXTENDED = "root_id, path, depth, component_id, parent_id, kind, name, type, display_name, id, component_desc"


def _extended(spark, sf, strict):
    nodes = graph.with_flows(_lineage(spark, sf), bind(spark, sf, b.TABLE_ROOTS), bind(spark, sf, b.FLOWS), strict)
    return _shown(nodes).select(*[c.strip() for c in _EXTENDED.split(",")])


@query(
    "g7_etl_extension",
    f"WITH {_LINEAGE}, {_flows('procedure_name', 'procedure_name IS NOT NULL')} SELECT * REPLACE (array_to_string(path, '.') AS path) FROM extended",
)
def etl_extension(spark, sf):
    return _extended(spark, sf, strict=False)


# In strict mode the procedure must bear the root table's name, so step tables are the roots here.
_STEP_ROOTS = "SELECT DISTINCT 'step_' || CAST(o_orderkey % 7 * 7 AS STRING) AS root_id, 'p' || CAST(o_orderkey % 5 AS STRING) AS project_id, 'step_' || CAST(o_orderkey % 7 * 7 AS STRING) AS table_name FROM {orders}"
_STEP_HITS = """
hits AS (SELECT DISTINCT r.root_id, c.id AS component_id, c.component_name, c.component_type, c.order_seq FROM roots r JOIN components c ON c.project_id = r.project_id AND c.component_type = 'PROCEDURE' AND c.component_name = r.table_name)
"""
_STRICT = (
    _ctes(components=b.COMPONENTS, trace=b.TRACE, hierarchy=b.HIERARCHY, roots=_STEP_ROOTS, flows=b.FLOWS)
    + f", {_EDGES}, {_STEP_HITS}, {_LEVEL_ONE}, {_first_visits(DEPTH)}, {_NODES}"
)


@query(
    "g7_etl_extension_strict",
    f"WITH {_STRICT}, {_flows('source_table', 'source_table = table_name')} SELECT * REPLACE (array_to_string(path, '.') AS path) FROM extended",
)
def etl_extension_strict(spark, sf):
    components, roots = bind(spark, sf, b.COMPONENTS), bind(spark, sf, _STEP_ROOTS)
    procedures = components.filter(F.col("component_type") == "PROCEDURE").withColumnRenamed("id", "component_id")
    named = procedures.withColumn("table_name", F.col("component_name"))
    hits = roots.join(named, ["project_id", "table_name"]).select(*reports.ROOT_HIT).distinct()
    tree = graph.lineage_tree(graph.first_level(hits), _main_edges(spark, sf), DEPTH)
    nodes = graph.decorate(tree, roots, components)
    extended = graph.with_flows(nodes, roots, bind(spark, sf, b.FLOWS), strict=True)
    return _shown(extended).select(*[c.strip() for c in _EXTENDED.split(",")])


def _member(name: str, column: str, text: bool = True) -> str:
    value = f"CAST(to_json({column}) AS VARCHAR)" if text else f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NOT NULL THEN ',\"{name}\":' || {value} ELSE '' END"


_OWN = "'{' || substr(" + " || ".join(
    [
        _member("name", "name"), _member("displayName", "display_name"), _member("type", "type"), _member("color", "color"),
        _member("id", "id", False), _member("component_Id", "component_id"), _member("parentCompId", "parent_comp_id", False),
        _member("componentType", "component_type"), _member("isNoise", "is_noise", False), _member("orderSeq", "order_seq", False),
        _member("childNoiseCount", "0", False), _member("childNoNoiseCount", "0", False),
        _member("componentDesc", "component_desc"),
    ]
) + ", 2)"


_COLUMN = "'{' || substr(" + " || ".join(
    [_member("componentId", "component_id"), _member("name", "name"), _member("displayName", "name"), _member("color", "color")]
) + ", 2) || '}'"

_TYPED_ROOTS = """
found AS (
  SELECT DISTINCT root_id, c.id AS component_id, c.component_name AS name FROM roots r
  JOIN components t ON t.project_id = r.project_id AND t.component_name = r.table_name AND t.component_type = 'TABLE'
  JOIN components c ON c.parent_component_id = t.id AND c.component_type = 'COLUMN'
),
shown AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY name, component_id) AS position FROM found),
colored AS (SELECT *, CASE WHEN position % 2 = 1 THEN '#b2f1ca' ELSE '#FFFFFF' END AS color FROM shown)
"""

_PIECES = f"""
whole AS (
  SELECT root_id, path, depth, name, display_name, type, color, id, component_id, parent_comp_id, component_type, is_noise, order_seq, component_desc FROM nodes
  UNION ALL
  SELECT n.root_id, list_append(n.path, p.place + {graph.AFTER_COMPONENTS}), n.depth + 1, p.target_table,
    CASE WHEN length(p.target_table) > 40 THEN left(p.target_table, 40) || '...' ELSE p.target_table END, 'TABLE', '{graph.NODE_COLORS["TABLE"]}', 0, NULL, NULL,
    'TABLE', false, NULL, 'ETL: ' || coalesce(nullif(p.flow_type, ''), 'TRANSFORM')
  FROM nodes n JOIN placed p ON p.root_id = n.root_id AND p.name = n.name WHERE n.type = 'PROCEDURE'
),
pieces AS (
  SELECT root_id, path AS place, 0 AS part, 0 AS position,
    CASE WHEN depth > 0 AND row_number() OVER (PARTITION BY root_id, path[1:len(path) - 1], depth ORDER BY path) > 1 THEN ',' ELSE '' END
      || {_OWN} || ',"typeInformations":[' || CASE WHEN depth > 0 THEN '],"children":[' ELSE '' END AS text FROM whole
  UNION ALL SELECT root_id, list_append(path, {export.AFTER_ALL}), 3, 0, ']}}' FROM whole
  UNION ALL SELECT root_id, path, 2, 0, '],"children":[' FROM whole WHERE depth = 0
  UNION ALL SELECT root_id, CAST([] AS BIGINT[]), 1, position, CASE WHEN position > 1 THEN ',' ELSE '' END || {_COLUMN} FROM colored
)
"""


@query(
    "g8_s11_nested_json",
    f"""WITH {_LINEAGE}, {_flows('procedure_name', 'procedure_name IS NOT NULL')}, {_TYPED_ROOTS}, {_PIECES}
    SELECT * REPLACE (array_to_string(place, '.') AS place) FROM pieces""",
)
def nested_json(spark, sf):
    """The pieces of each root's document, ETL nodes and root columns included."""
    nodes = graph.with_flows(_lineage(spark, sf), bind(spark, sf, b.TABLE_ROOTS), bind(spark, sf, b.FLOWS))
    columns = reports.root_columns(
        bind(spark, sf, b.TABLE_ROOTS), bind(spark, sf, b.COMPONENTS), bind(spark, sf, b.NATION_SCHEMAS), bind(spark, sf, b.NATION_COLUMNS)
    )
    pieces = export.json_fragments(nodes, columns)
    return pieces.withColumn("place", F.array_join(F.col("place").cast("array<string>"), "."))


@query(
    "g8_s11_json_rows",
    f"WITH {_LINEAGE} SELECT root_id, array_to_string(path, '.') AS path, depth, {_OWN} || '}}' AS json FROM nodes",
)
def json_rows(spark, sf):
    return _shown(export.json_rows(_lineage(spark, sf)))


@query(
    "s12_text_report",
    f"""WITH {_LINEAGE}, found AS (SELECT DISTINCT root_id, c.id AS component_id, c.component_name AS name FROM roots r
      JOIN components t ON t.project_id = r.project_id AND t.component_name = r.table_name AND t.component_type = 'TABLE'
      JOIN components c ON c.parent_component_id = t.id AND c.component_type = 'COLUMN')
    SELECT root_id, array_to_string(path, '.') AS path, 0 AS part, 0 AS place, repeat('  ', depth) || type || ': ' || name AS line FROM nodes
    UNION ALL SELECT DISTINCT root_id, '', 1, 0, '  Columns:' FROM found
    UNION ALL SELECT root_id, '', 2, row_number() OVER (PARTITION BY root_id ORDER BY name, component_id), '    - ' || name FROM found""",
)
def text_report(spark, sf):
    columns = reports.root_columns(
        bind(spark, sf, b.TABLE_ROOTS), bind(spark, sf, b.COMPONENTS), bind(spark, sf, b.NATION_SCHEMAS), bind(spark, sf, b.NATION_COLUMNS)
    )
    return _shown(export.report_lines(_lineage(spark, sf), columns))
