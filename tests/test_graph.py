"""Traversal against recursive restatements on small graphs of all shapes."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import export, graph, reports

COMPONENT = "id string, project_id string, component_name string, component_type string, component_desc string, parent_component_id string, is_noise boolean, order_seq int"


def components(spark, ids, kinds=None, noise=()):
    rows = [(i, "p", f"name_{i}", (kinds or {}).get(i, "FUNCTION"), None, None, i in noise, None) for i in ids]
    return spark.createDataFrame(rows, COMPONENT)


def edges(spark, known, calls=(), traces=()):
    hierarchy = spark.createDataFrame([(a, b, n) for a, b, n in calls], "parent_id string, child_id string, call_order int")
    trace = spark.createDataFrame(list(traces), "fk_parent_component_id string, fk_child_component_id string")
    return graph.child_edges(hierarchy, trace, known)


def hits(spark, *pairs):
    rows = [(root, c, f"name_{c}", "FUNCTION", n) for n, (root, c) in enumerate(pairs)]
    return graph.first_level(spark.createDataFrame(rows, "root_id string, component_id string, component_name string, component_type string, order_seq int"))


def listing(tree):
    rows = sorted(tree.collect(), key=lambda r: (r.root_id, list(r.path)))
    return [("  " * (r.depth - 1)) + r.component_id + ("*" if r.is_cycle else "") for r in rows]


def depth_first(start, children, max_depth):
    """The recursive form: visited is shared by the whole root."""
    out, visited = [], set()

    def arrive(node, kind, depth):
        if node in visited:
            if kind != "trace":
                out.append("  " * (depth - 1) + node + "*")
            return
        visited.add(node)
        out.append("  " * (depth - 1) + node)
        if depth < max_depth:
            for child, child_kind in children.get(node, []):
                arrive(child, child_kind, depth + 1)

    for node in start:
        arrive(node, "root", 1)
    return out


@pytest.mark.parametrize("mode", ["first_visits", "all_paths"])
@pytest.mark.parametrize("max_depth", [1, 2, 10])
def test_trees_and_single_cycles_equal_the_recursion(spark, mode, max_depth):
    known = components(spark, "abcdefg")
    calls = [("a", "b", 1), ("a", "c", 0), ("c", "d", None), ("d", "a", 0)]
    traces = [("a", "c"), ("b", "e"), ("e", "f"), ("f", "b"), ("d", "g")]
    children = {
        "a": [("c", "call"), ("b", "call")], "c": [("d", "call")], "d": [("a", "call"), ("g", "trace")],
        "b": [("e", "trace")], "e": [("f", "trace")], "f": [("b", "trace")],
    }
    tree = graph.lineage_tree(hits(spark, ("r", "a")), edges(spark, known, calls, traces), max_depth, mode)
    assert listing(tree) == depth_first(["a"], children, max_depth)


def test_shared_child_of_a_diamond(spark):
    links = edges(spark, components(spark, "abcd"), calls=[("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("c", "d", 0)])
    start = hits(spark, ("r", "a"))
    assert listing(graph.lineage_tree(start, links, mode="all_paths")) == ["a", "  b", "    d", "  c", "    d"]
    assert listing(graph.lineage_tree(start, links)) == ["a", "  b", "    d", "  c", "    d*"]


def test_each_repeated_call_is_a_cycle_leaf(spark):
    links = edges(spark, components(spark, "abc"), calls=[("a", "b", 0), ("a", "c", 1), ("a", "b", 2), ("a", "b", 2)])
    assert listing(graph.lineage_tree(hits(spark, ("r", "a")), links)) == ["a", "  b", "  c", "  b*", "  b*"]


def test_shared_child_reached_by_trace_is_dropped(spark):
    links = edges(spark, components(spark, "abcd"), calls=[("a", "b", 0), ("a", "c", 1)], traces=[("b", "d"), ("c", "d")])
    assert listing(graph.lineage_tree(hits(spark, ("r", "a")), links)) == ["a", "  b", "    d", "  c"]


def test_roots_repeat_and_stay_apart(spark):
    links = edges(spark, components(spark, "ab"), calls=[("a", "b", 0)])
    start = hits(spark, ("r", "a"), ("r", "a"), ("s", "b"))
    assert listing(graph.lineage_tree(start, links)) == ["a", "  b", "a*", "b"]


def test_noise_is_left_out_and_calls_come_before_traces(spark):
    known = components(spark, "abcde", noise={"c"})
    links = edges(spark, known, calls=[("a", "e", None), ("a", "d", 5), ("a", "c", 0)], traces=[("a", "b"), ("a", "d"), ("a", "c")])
    got = [(r.child_id, r.kind, r.ordinal) for r in links.orderBy("ordinal").collect()]
    assert got == [("d", "call", 1), ("e", "call", 2), ("b", "trace", 3)]


def first_visit_rows(start, children, max_depth):
    """Level by level, each component once at its first path."""
    seen, out = set(), set()
    level = [((i + 1,), node, "root") for i, node in enumerate(start)]
    for depth in range(1, max_depth + 1):
        grown = []
        for path, node, kind in sorted(level):
            if node in seen:
                if kind != "trace":
                    out.add((path, node, True))
                continue
            seen.add(node)
            out.add((path, node, False))
            grown += [((*path, i + 1), child, k) for i, (child, k) in enumerate(children.get(node, []))]
        level = grown
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(25)]
    calls = {(rng.choice(ids), rng.choice(ids)) for _ in range(40)}
    traces = {(rng.choice(ids), rng.choice(ids)) for _ in range(25)} - calls
    links = edges(spark, components(spark, ids), calls=[(a, b, 0) for a, b in calls], traces=list(traces))
    children = {}
    for a, b in sorted(calls):
        children.setdefault(a, []).append((b, "call"))
    for a, b in sorted(traces):
        children.setdefault(a, []).append((b, "trace"))
    start = rng.sample(ids, 3)
    tree = graph.lineage_tree(hits(spark, *[("r", c) for c in start]), links, 6).collect()
    assert {(tuple(r.path), r.component_id, r.is_cycle) for r in tree} == first_visit_rows(start, children, 6)

    paths = graph.lineage_tree(hits(spark, *[("r", c) for c in start]), links, 4, "all_paths").collect()
    for r in paths:
        assert r.depth == len(r.path) <= 4
    want = set()

    def walk(node, path, on_path):
        want.add((path, node, False))
        if len(path) < 4:
            for i, (child, kind) in enumerate(children.get(node, [])):
                if child in on_path:
                    if kind == "call":
                        want.add(((*path, i + 1), child, True))
                else:
                    walk(child, (*path, i + 1), on_path | {child})

    for i, node in enumerate(start):
        walk(node, (i + 1,), {node})
    assert {(tuple(r.path), r.component_id, r.is_cycle) for r in paths} == want


@pytest.fixture(scope="module")
def decorated(spark):
    known = components(spark, ["aaaaaaaa-1", "b" * 45, "c"], kinds={"aaaaaaaa-1": "PROCEDURE", "c": "TRIGGER"})
    links = edges(spark, known, calls=[("aaaaaaaa-1", "b" * 45, 0), ("b" * 45, "aaaaaaaa-1", 0), ("b" * 45, "c", 1)])
    roots = spark.createDataFrame([("r", "p", "users", None)], "root_id string, project_id string, table_name string, column_name string")
    return roots, graph.decorate(graph.lineage_tree(hits(spark, ("r", "aaaaaaaa-1")), links), roots, known, {"QUERY": "#000000"})


def test_decoration(decorated):
    _, nodes = decorated
    rows = {tuple(r.path): r for r in nodes.collect()}
    assert (rows[()].name, rows[()].type, rows[()].id, rows[()].color) == ("users", "TABLE", 0, "#82c158")
    assert (rows[(1,)].type, rows[(1,)].id) == ("PROCEDURE", 0xAAAAAAAA)
    assert rows[(1, 1)].display_name == ("name_" + "b" * 45)[:40] + "..."
    cycle = rows[(1, 1, 1)]
    assert (cycle.name, cycle.id, cycle.is_cycle, cycle.type) == ("[Cycle] name_aaaaaaaa-1", 0, True, "PROCEDURE")
    assert rows[(1, 1, 2)].type == "FUNCTION"


def test_flows(spark, decorated):
    roots, nodes = decorated
    flows = spark.createDataFrame(
        [("p", "users", "mart", "name_aaaaaaaa-1", 2, ""), ("p", "users", "mart2", "name_aaaaaaaa-1", 1, "LOAD"), ("p", "name_aaaaaaaa-1", "x", "other", 1, None), ("q", "users", "no", "name_aaaaaaaa-1", 1, None)],
        "project_id string, source_table string, target_table string, procedure_name string, flow_sequence int, flow_type string",
    )
    added = graph.with_flows(nodes, roots, flows).filter("kind = 'flow'").orderBy("path").collect()
    assert [(r.name, r.component_desc, r.depth) for r in added] == [("mart2", "ETL: LOAD", 2), ("mart", "ETL: TRANSFORM", 2)]
    # The strict reading needs a procedure that bears the root table's name.
    assert graph.with_flows(nodes, roots, flows, strict=True).filter("kind = 'flow'").count() == 0


def test_exports(spark, decorated, tmp_path):
    import json

    roots, nodes = decorated
    columns = spark.createDataFrame(
        [("r", 1, "id", "k1", "#b2f1ca"), ("r", 2, "mail", "k2", "#FFFFFF")],
        "root_id string, position int, name string, component_id string, color string",
    )
    flows = spark.createDataFrame(
        [("p", "users", "mart", "name_aaaaaaaa-1", 2, "")],
        "project_id string, source_table string, target_table string, procedure_name string, flow_sequence int, flow_type string",
    )
    export.write_json(graph.with_flows(nodes, roots, flows), str(tmp_path / "json"), columns)
    stored = spark.read.parquet(str(tmp_path / "json")).orderBy("seq").collect()
    doc = json.loads("".join(r.text for r in stored))
    assert doc["name"] == "users" and [c["type"] for c in doc["children"]] == ["PROCEDURE"]
    assert [c["name"] for c in doc["typeInformations"]] == ["id", "mail"]
    call, flow = doc["children"][0]["children"]
    assert [x["name"] for x in call["children"]] == ["[Cycle] name_aaaaaaaa-1", "name_c"]
    assert (flow["name"], flow["componentDesc"], flow["children"], flow["typeInformations"]) == ("mart", "ETL: TRANSFORM", [], [])
    assert (call["childNoiseCount"], call["childNoNoiseCount"]) == (0, 0)
    bare = export.json_fragments(nodes).orderBy(*export.FRAGMENT_ORDER).collect()
    assert json.loads("".join(r.text for r in bare))["typeInformations"] == []
    assert export.json_rows(nodes).count() == 5
    lines = [r.line for r in export.report_lines(nodes, columns).collect()]
    assert lines[:5] == ["TABLE: users", "  Columns:", "    - id", "    - mail", "  PROCEDURE: name_aaaaaaaa-1"]
    export.write_report(export.report_lines(nodes, columns), str(tmp_path / "report"))
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == lines


def test_files_stand_in_for_components(spark):
    roots = spark.createDataFrame([("t", "p", "users")], "root_id string, project_id string, table_name string")
    detail = spark.createDataFrame(
        [("p", "users", "f1", "a.go", "go", "read", 1), ("p", "users", "f1", "a.go", "go", "write", 2), ("p", "users", "f2", "b.go", "go", "read", 1), ("p", "other", "f3", "c.go", "go", "read", 1)],
        "project_id string, table_name string, file_id string, file_path string, language string, usage_type string, line_number int",
    )
    once = reports.files_of_roots(roots, detail)
    assert once.count() == 2
    # Kept per usage, a file repeats and its repeats are cycle leaves.
    every = graph.first_level(reports.files_of_roots(roots, detail, per_usage=True))
    links = edges(spark, components(spark, ["x"]), calls=[("x", "x", 0)])
    assert listing(graph.lineage_tree(every, links)) == ["f1", "f1*", "f2"]
    known = graph.known_components(components(spark, ["x"]), once)
    tree = graph.decorate(graph.lineage_tree(graph.first_level(once), links), roots, known)
    assert {(r.name, r.type) for r in tree.collect()} == {("users", "TABLE"), ("a.go", "FUNCTION"), ("b.go", "FUNCTION")}


def test_each_level_is_written_once(spark, monkeypatch):
    """Links and one table per level; rows without root or component are leaves."""
    known = components(spark, "abcd")
    linked = edges(spark, known, calls=[("a", "b", 1), ("a", "c", 2), ("b", "d", 1), ("c", "d", 1), ("d", "a", 1)])
    top = hits(spark, ("r", "a"), ("r", "b"), ("r", "b"), (None, "a"), ("r", None))
    written, plain = [], graph.cut_level
    monkeypatch.setattr(graph, "cut_level", lambda df: written.append(df) or plain(df))
    tree = graph.first_visits(top, linked, 4)
    # the cycle back to a ends the search: its level is written, the next one is looked at and empty
    assert len(written) <= 5
    rows = [(r.root_id, r.component_id, r.depth, r.is_cycle) for r in tree.collect()]
    expected = [
        ("r", "a", 1, False), ("r", "b", 1, False), ("r", "b", 1, True), (None, "a", 1, True), ("r", None, 1, True),
        ("r", "b", 2, True), ("r", "c", 2, False), ("r", "d", 2, False), ("r", "d", 3, True), ("r", "a", 3, True),
    ]
    assert sorted(rows, key=str) == sorted(expected, key=str)
