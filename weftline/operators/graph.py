"""Lineage trees: expanding roots over component edges.

A tree is a relation of nodes ``root_id, path, depth, component_id, parent_id,
kind, is_cycle``. ``path`` holds the sibling ordinals from the root and sorts
nodes in pre-order; the root itself has the empty path. All roots grow together,
level by level, each level materialised before the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions.display import clipped, uuid_number
from weftline.operators.ranking import numbered
from weftline.operators.reports import not_noise
from weftline.session import cut, cut_level

# Depth limit, node types and colours, marks on special nodes.
MAX_DEPTH = 10
NODE_TYPES = {
    "TABLE": "TABLE",
    "COLUMN": "COLUMN",
    "PROCEDURE": "PROCEDURE",
    "FUNCTION": "FUNCTION",
    "FUNCTION_CALL": "FUNCTION",
    "FUNCTION_DEFINITION": "FUNCTION",
    "QUERY": "QUERY",
    "FILE": "FUNCTION",
}
DEFAULT_NODE_TYPE = "FUNCTION"
NODE_COLORS = {
    "TABLE": "#82c158",
    "QUERY": "#0a9ccd",
    "PROCEDURE": "#c34474",
    "FUNCTION": "#5283a2",
    "COLUMN": "#b2f1ca",
}
CYCLE_MARK = "[Cycle] "
ETL_MARK = "ETL: "
DEFAULT_FLOW = "TRANSFORM"

# Appended children sort after every component child.
AFTER_COMPONENTS = 1 << 40

NODE = ["root_id", "path", "depth", "component_id", "parent_id", "kind", "is_cycle"]


def child_edges(hierarchy: DataFrame, trace: DataFrame, components: DataFrame) -> DataFrame:
    """``parent_id, child_id, kind, ordinal``: each call, repeats too, then traces that are not also calls."""
    calls = hierarchy.select("parent_id", "child_id", "call_order")
    pairs = trace.select(
        F.col("fk_parent_component_id").alias("parent_id"), F.col("fk_child_component_id").alias("child_id")
    ).distinct()
    traced = pairs.join(calls, ["parent_id", "child_id"], "left_anti")
    edges = calls.withColumn("kind", F.lit("call")).unionByName(
        traced.select("*", F.lit(None).cast("int").alias("call_order"), F.lit("trace").alias("kind"))
    )
    ends = components.filter(not_noise()).select(F.col("id").alias("child_id"), "order_seq")
    order = [
        F.col("kind"),
        F.col("call_order").asc_nulls_last(),
        F.col("order_seq").asc_nulls_last(),
        F.col("child_id"),
    ]
    return numbered(edges.join(ends, "child_id"), ["parent_id"], order, "ordinal").select(
        "parent_id", "child_id", "kind", "ordinal"
    )


def first_level(hits: DataFrame) -> DataFrame:
    """Root hits (components or files) as level-one nodes, ordered among siblings."""
    order = [F.col("order_seq").asc_nulls_last(), F.col("component_name"), F.col("component_id")]
    return numbered(hits, ["root_id"], order, "ordinal").select(
        "root_id",
        F.array("ordinal").alias("path"),
        F.lit(1).alias("depth"),
        "component_id",
        F.lit(None).cast("string").alias("parent_id"),
        F.lit("root").alias("kind"),
        F.lit(False).alias("is_cycle"),
    )


def _links(edges: DataFrame) -> DataFrame:
    """Edges under names of their own, materialised for use at every level."""
    return cut_level(edges.select(*[F.col(c).alias(f"_{c}") for c in ("parent_id", "child_id", "kind", "ordinal")]))


def _step(frontier: DataFrame, links: DataFrame, *more: Column) -> DataFrame:
    return frontier.join(links, F.col("component_id") == F.col("_parent_id")).select(
        "root_id",
        F.concat("path", F.array("_ordinal")).alias("path"),
        (F.col("depth") + 1).alias("depth"),
        F.col("_child_id").alias("component_id"),
        F.col("_parent_id").alias("parent_id"),
        F.col("_kind").alias("kind"),
        *more,
    )


def _is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def all_paths(level_one: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Every simple path from the roots; a node that repeats on its own path is marked or, by trace, dropped.

    The number of paths grows with the fan-out to the power of the depth: use
    :func:`first_visits` on densely linked components.
    """
    links = _links(edges)
    frontier = cut_level(level_one.withColumn("seen", F.array("component_id")))
    tree = frontier
    for _ in range(1, max_depth):
        grown = _step(
            frontier.filter(~F.col("is_cycle")),
            links,
            F.array_contains("seen", F.col("_child_id")).alias("is_cycle"),
            F.concat("seen", F.array("_child_id")).alias("seen"),
        )
        frontier = cut_level(grown.filter((F.col("kind") == "call") | ~F.col("is_cycle")))
        if _is_empty(frontier):
            break
        tree = tree.unionByName(frontier)
    return tree.select(*NODE)


def first_visits(level_one: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Each component expands once per root, at its least depth and there at its first path.

    Other arrivals become cycle leaves (root and call edges) or are dropped
    (trace edges). The rows of a root are bounded by the edges it reaches.
    """
    links = _links(edges)
    key = ["root_id", "component_id"]
    known = F.col("root_id").isNotNull() & F.col("component_id").isNotNull()
    arrivals = level_one.drop("is_cycle")
    visited, tree = None, None
    for depth in range(1, max_depth + 1):
        new = known
        if visited is not None:
            arrivals, new = arrivals.join(visited.withColumn("_old", F.lit(True)), key, "left"), known & F.col("_old").isNull()
        # on the partitions of the join: arrivals are shuffled once and each level is written once
        first = F.min("path").over(Window.partitionBy(*key))
        placed = arrivals.withColumn("is_cycle", ~((F.col("path") == first) & new))
        level = cut_level(placed.filter((F.col("kind") != "trace") | ~F.col("is_cycle")).select(*NODE))
        if tree is not None and _is_empty(level):
            break
        tree = level if tree is None else tree.unionByName(level)
        expanded = level.filter(~F.col("is_cycle"))
        visited = expanded.select(*key) if visited is None else visited.unionByName(expanded.select(*key))
        if depth < max_depth:
            arrivals = _step(expanded, links)
    return tree


def lineage_tree(
    level_one: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH, mode: str = "first_visits"
) -> DataFrame:
    """Nodes below the roots; a node at ``max_depth`` is kept and not expanded."""
    if mode not in ("first_visits", "all_paths"):
        raise ValueError(f"unknown mode {mode}")
    if max_depth < 1:
        return level_one.limit(0)
    return (first_visits if mode == "first_visits" else all_paths)(level_one, edges, max_depth)


def known_components(components: DataFrame, hits: DataFrame) -> DataFrame:
    """Components plus the files that stand in for them at level one."""
    facts = ["id", "component_name", "component_type", "component_desc", "parent_component_id", "is_noise", "order_seq"]
    none = F.lit(None).cast("string")
    files = (
        hits.filter(F.col("component_type") == "FILE")
        .select(
            F.col("component_id").alias("id"),
            "component_name",
            "component_type",
            none.alias("component_desc"),
            none.alias("parent_component_id"),
            F.lit(False).alias("is_noise"),
            F.lit(None).cast("int").alias("order_seq"),
        )
        .distinct()
    )
    return components.select(*facts).unionByName(files)


def _lookup(value: Column, table: dict[str, str], default: Column) -> Column:
    found = default
    for key, result in table.items():
        found = F.when(value == key, result).otherwise(found)
    return found


def decorate(
    tree: DataFrame, roots: DataFrame, components: DataFrame, colors: dict[str, str] | None = None
) -> DataFrame:
    """Adds the root rows and what a node shows: name, type, colour, number.

    ``roots``: ``root_id, table_name``. ``colors`` override the default colours.
    """
    palette = {**NODE_COLORS, **(colors or {})}
    facts = components.select(
        F.col("id").alias("component_id"),
        "component_name",
        "component_type",
        "component_desc",
        "parent_component_id",
        F.coalesce("is_noise", F.lit(False)).alias("is_noise"),
        F.nullif("order_seq", F.lit(0)).alias("order_seq"),
    )
    nodes = tree.join(facts, "component_id").withColumn(
        "name", F.when(F.col("is_cycle"), F.concat(F.lit(CYCLE_MARK), "component_name")).otherwise(F.col("component_name"))
    )
    none = F.lit(None).cast("string")
    tops = roots.select("root_id", F.col("table_name").alias("name")).distinct().select(
        "root_id",
        F.array().cast("array<bigint>").alias("path"),
        F.lit(0).alias("depth"),
        none.alias("component_id"),
        none.alias("parent_id"),
        F.lit("root").alias("kind"),
        F.lit(False).alias("is_cycle"),
        "name",
        F.lit("TABLE").alias("component_type"),
        none.alias("component_desc"),
        none.alias("parent_component_id"),
        F.lit(False).alias("is_noise"),
        F.lit(None).cast("int").alias("order_seq"),
    )
    kind = F.col("type")
    return (
        tops.unionByName(nodes.drop("component_name"))
        .withColumn("type", _lookup(F.col("component_type"), NODE_TYPES, F.lit(DEFAULT_NODE_TYPE)))
        .withColumn("display_name", clipped(F.col("name")))
        .withColumn("color", _lookup(kind, palette, F.lit(None).cast("string")))
        .withColumn(
            "id",
            F.when(F.col("component_id").isNull() | F.col("is_cycle"), F.lit(0).cast("bigint")).otherwise(
                uuid_number(F.col("component_id"))
            ),
        )
        .withColumn("parent_comp_id", uuid_number(F.col("parent_component_id")))
    )


def table_type_information(roots: DataFrame, columns: DataFrame) -> DataFrame:
    """Of root columns, those of roots that ask for a whole table."""
    whole = roots.filter(F.col("column_name").isNull()).select("root_id").distinct()
    return columns.join(whole, "root_id", "left_semi")


def with_flows(nodes: DataFrame, roots: DataFrame, flows: DataFrame, strict: bool = False) -> DataFrame:
    """Decorated nodes plus, under each procedure, the tables its flows write.

    Flows are found by procedure name in the root's projects. ``strict`` asks in
    addition that a flow starts at the root table and that the procedure bears
    that table's name.
    """
    wanted = roots.select("root_id", "project_id", "table_name").distinct()
    nodes = cut(nodes)
    procedures = nodes.filter(F.col("type") == "PROCEDURE").select(
        "root_id", "path", "depth", F.col("component_id").alias("parent_id"), F.col("name").alias("_name")
    )
    steps = flows.filter(F.col("target_table") != "").select(
        "project_id",
        F.col("source_table" if strict else "procedure_name").alias("_name"),
        "flow_sequence",
        "target_table",
        "flow_type",
    )
    # From the procedures on: a flow meets only nodes of its name and project, never all roots of the project.
    asked = procedures.join(wanted, "root_id")
    if strict:
        asked = asked.filter(F.col("table_name") == F.col("_name"))
    order = [F.col("flow_sequence").asc_nulls_last(), F.col("target_table"), F.coalesce("flow_type", F.lit(""))]
    placed = numbered(asked.join(steps, ["project_id", "_name"]), ["root_id", "path"], order, "_place")
    none = F.lit(None).cast("string")
    target = F.col("target_table")
    added = placed.select(
        "root_id",
        F.concat("path", F.array(F.col("_place") + AFTER_COMPONENTS)).alias("path"),
        (F.col("depth") + 1).alias("depth"),
        none.alias("component_id"),
        "parent_id",
        F.lit("flow").alias("kind"),
        F.lit(False).alias("is_cycle"),
        target.alias("name"),
        F.lit("TABLE").alias("component_type"),
        F.concat(F.lit(ETL_MARK), F.coalesce(F.nullif("flow_type", F.lit("")), F.lit(DEFAULT_FLOW))).alias("component_desc"),
        none.alias("parent_component_id"),
        F.lit(False).alias("is_noise"),
        F.lit(None).cast("int").alias("order_seq"),
        F.lit("TABLE").alias("type"),
        clipped(target).alias("display_name"),
        F.lit(NODE_COLORS["TABLE"]).alias("color"),
        F.lit(0).cast("bigint").alias("id"),
        F.lit(None).cast("bigint").alias("parent_comp_id"),
    )
    return nodes.unionByName(added)
