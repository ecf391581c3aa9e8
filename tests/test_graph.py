"""Traversals, analysis and resolution on small graphs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import aggregates, graph, lookup, resolve, search
from codeloom.schema import Graph, GraphError


def make(spark, nodes, edges):
    """nodes: (id, kind, name, file, exported); edges: (source, target, kind)."""
    n = spark.createDataFrame([(*x, k) for k, x in enumerate(nodes)] or [("", "", "", "", False, 0)], "id string, kind string, name string, file_path string, is_exported boolean, ord long").where("id <> ''")
    e = spark.createDataFrame([(*x, k) for k, x in enumerate(edges)] or [("", "", "", 0)], "source string, target string, kind string, ord long").where("source <> ''")
    files = n.select(F.col("file_path").alias("path")).distinct().withColumn("language", F.lit("typescript"))
    return Graph(n, e, files)


def ids(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def roots(spark, *names):
    return spark.createDataFrame([(x,) for x in names], "id string")


def function(i, file="a.ts"):
    return (i, "function", i, file, False)


def test_calls_chain(spark):
    g = make(spark, [function(x) for x in "abc"], [("a", "b", "calls"), ("b", "c", "calls")])
    assert ids(graph.callees(g, roots(spark, "a"), 2), "id", "depth") == [("b", 1), ("c", 2)]
    assert ids(graph.callers(g, roots(spark, "c"), 2), "id", "depth") == [("a", 2), ("b", 1)]
    assert ids(graph.callees(g, roots(spark, "a")), "id") == [("b",)]


@pytest.mark.parametrize(("depth", "n"), [(1, 1), (2, 2), (10, 3)])
def test_depth(spark, depth, n):
    g = make(spark, [function(x) for x in "abcd"], [("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls")])
    assert graph.traverse(g, roots(spark, "a"), depth).count() == n


def test_traverse_options(spark):
    g = make(spark, [("a", "class", "a", "f", True), ("b", "method", "b", "f", False), ("c", "class", "c", "f", False)], [("a", "b", "calls"), ("a", "c", "contains"), ("b", "a", "calls"), ("b", "b", "calls")])
    assert ids(graph.traverse(g, roots(spark, "a"), edge_kinds=["calls"]), "id") == [("b",)]
    assert ids(graph.traverse(g, roots(spark, "a"), node_kinds=["class"]), "id") == [("c",)]
    assert ids(graph.traverse(g, roots(spark, "a"), include_start=True, limit=2), "id", "depth") == [("a", 0), ("b", 1)]
    assert ids(graph.traverse(g, roots(spark, "c"), direction="both"), "id", "depth") == [("a", 1), ("b", 2)]
    assert ids(graph.traverse(g, roots(spark, "c"), direction="legacy"), "id") == []


def test_reach_against_plain_search(spark):
    r = random.Random(4)
    for _ in range(2):
        names = [f"n{i}" for i in range(14)]
        edges = {(r.choice(names), r.choice(names)) for _ in range(24)}
        g = make(spark, [function(x) for x in names], [(a, b, "calls") for a, b in edges])
        for depth in (2, 5):
            want = []
            for root in names[:4]:
                dist, queue = {root: 0}, [root]
                for x in queue:
                    for a, b in edges:
                        if a == x and b not in dist and dist[x] < depth:
                            dist[b] = dist[x] + 1
                            queue.append(b)
                want += [(root, k, v) for k, v in dist.items() if k != root]
            assert ids(graph.callees(g, roots(spark, *names[:4]), depth), "root", "id", "depth") == sorted(want)


def test_hierarchy_and_containment(spark):
    g = make(spark, [("f", "file", "f", "f", False)] + [(x, "class", x, "f", False) for x in "abc"] + [("i", "interface", "i", "f", True)], [("b", "a", "extends"), ("c", "b", "extends"), ("b", "i", "implements"), ("f", "a", "contains"), ("a", "c", "contains")])
    assert ids(graph.type_hierarchy(g, roots(spark, "b")), "id", "role", "depth") == [("a", "extends", 1), ("c", "descendant", 1), ("i", "implements", 1)]
    assert ids(graph.containment_ancestors(g, roots(spark, "c")), "id", "depth") == [("a", 1), ("f", 2)]
    assert ids(graph.containment_depth(g, roots(spark, "c", "f")), "id", "depth") == [("c", 2), ("f", 0)]
    assert ids(lookup.children(g, roots(spark, "f")), "id") == [("a",)]


def test_impact_dead_code_and_metrics(spark):
    nodes = [("a", "function", "a", "x", False), ("b", "function", "b", "x", False), ("c", "function", "c", "x", True), ("d", "function", "_d", "x", False), ("e", "class", "e", "x", False), ("k", "method", "k", "x", False)]
    g = make(spark, nodes, [("a", "b", "calls"), ("c", "b", "calls"), ("e", "b", "references"), ("x1", "k", "contains"), ("x2", "k", "contains"), ("b", "b", "calls")])
    assert ids(graph.impact_radius(g, roots(spark, "b")), "id", "via") == [("a", "calls"), ("c", "calls"), ("e", "references")]
    assert ids(graph.dead_code(g), "id") == [("a",), ("e",)]
    row = aggregates.node_degrees(g).where("id = 'b'").head()
    assert (row.in_degree, row.out_degree, row.fan_in, row.fan_out) == (4, 1, 2, 0)


def test_cycles(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    assert ids(graph.cyclic_files(pairs), "file", "cycle") == [("a", "a"), ("b", "a"), ("c", "a")]
    assert ids(graph.short_cycles(pairs), "cycle") == [("a -> b",), ("a -> b -> c",)]
    none = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert graph.cyclic_files(none).count() == 0


def refs(spark, *rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], "from_id string, reference_name string, reference_kind string, file_path string, candidates array<string>, line int, col int")


def test_name_resolution(spark):
    nodes = [("m", "function", "main", "b.ts", False), ("h1", "function", "helper", "a.ts", False), ("h2", "function", "helper", "c.ts", True), ("own", "function", "helper", "b.ts", True), ("solo", "function", "solo", "b.ts", False), ("im", "import", "lib", "a.ts", True)]
    g = make(spark, nodes, [])
    asked = refs(spark, ("m", "x.helper", "calls", "b.ts", None), ("m", "solo", "calls", "b.ts", None), ("solo", "solo", "type_of", "b.ts", None), ("m", "console", "calls", "b.ts", None), ("m", "lib", "calls", "b.ts", None), ("m", "nothing", "extends", "b.ts", None))
    got = ids(resolve.resolve_by_name(asked, g.nodes), "source", "target", "kind", "provenance")
    assert got == [("m", "h2", "calls", "scope-resolution"), ("m", "solo", "calls", "heuristic")]
    left = resolve.unresolved(asked, resolve.resolve_by_name(asked, g.nodes))
    assert ids(left, "from_id", "reference_kind") == [("m", "extends"), ("solo", "type_of")]


def test_import_resolution(spark):
    nodes = [("u", "function", "use", "src/lib/index.ts", True), ("v", "function", "use", "src/lib.py", True), ("w", "function", "up", "top.js", True), ("x", "function", "hid", "top.js", False)]
    g = make(spark, nodes, [])
    asked = refs(spark, ("i", "use", "imports", "src/a.ts", ["./lib"]), ("i", "up", "imports", "src/a.ts", ["../../top"]), ("i", "hid", "imports", "src/a.ts", ["../top"]), ("i", "use", "imports", "src/a.ts", ["lib"]))
    assert ids(resolve.resolve_imports(asked, g.nodes, g.files), "source", "target") == [("i", "v"), ("i", "w")]


def test_store(spark):
    g = make(spark, [function("a", "x"), function("b", "y")], [("a", "b", "calls"), ("b", "a", "calls")])
    new = make(spark, [function("c", "x")], [])
    out = lookup.replace_files(g, new.files, new.nodes, new.edges)
    assert ids(out.nodes, "id") == [("b",), ("c",)]
    assert out.edges.count() == 0
    bad = make(spark, [function("c", "x")], [("c", "gone", "calls")])
    with pytest.raises(GraphError):
        lookup.replace_files(g, bad.files, bad.nodes, bad.edges)
    assert lookup.replace_files(g, bad.files, bad.nodes, bad.edges, drop_dangling=True).edges.count() == 0
    twice = make(spark, [], [("a", "b", "calls"), ("a", "b", "calls"), ("a", "b", "imports")])
    assert ids(lookup.first_edges(twice.edges), "kind", "ord") == [("calls", 0), ("imports", 2)]
    assert ids(lookup.dangling_edges(Graph(g.nodes.where("id = 'a'"), g.edges, g.files)), "source") == [("a",), ("b",)]


def test_search(spark):
    nodes = spark.createDataFrame([("1", "calculateTotal", None), ("2", "calculateTax", "total of taxes"), ("3", "sendEmail", None)], "id string, name string, docstring string")
    assert {r.id for r in search.search_nodes(nodes, "calculate").collect()} == {"1", "2"}
    assert search.search_nodes(nodes, "  ").count() == 0
    assert search.search_nodes(nodes, 'a"b (').count() == 0
    pages = spark.createDataFrame([("a.md", "A", "tax tax and tax law"), ("b.md", "B", "law"), ("c.md", "C", None)], "page string, title string, content string")
    assert ids(search.ask_top(pages, "tax law", "page"), "page", "score") == [("a.md", 54), ("b.md", 1)]
    got = search.ask_context(pages, "tax law", "page", "title", room=8).head()
    assert got.context == "\n\n--- PAGE: A (a.md) ---\ntax \n\n--- PAGE: B (b.md) ---\nlaw" and got.n_pages == 2
