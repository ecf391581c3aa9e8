"""Walk counts, cycle paths and interval labels against brute force on random graphs."""

import collections
import random

import pytest

from codeloom.operators import graph, intervals, paths
from codeloom.schema import Graph, GraphError


def pairs_of(spark, pairs):
    return spark.createDataFrame(sorted(pairs) or [("", "")], "src string, dst string").where("src <> ''")


def ids_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def random_pairs(seed, n, m):
    r = random.Random(seed)
    return {(f"n{r.randrange(n):02}", f"n{r.randrange(n):02}") for _ in range(m)}


def slow_walks(pairs, root, depth):
    level, out = {root: 1}, {}
    for d in range(1, depth + 1):
        new = collections.Counter()
        for a, b in pairs:
            if a in level:
                new[b] += level[a]
        level = new
        out |= {(root, i, d): n for i, n in level.items()}
    return out


def test_walk_counts(spark):
    pairs = random_pairs(1, 12, 40)
    roots = ["n00", "n03", "n11", "gone"]
    got = paths.walk_counts(pairs_of(spark, pairs), ids_of(spark, [*roots, "n00"]), 5)
    want = {}
    for r in roots:
        want |= slow_walks(pairs, r, 5)
    assert {(x.root, x.id, x.depth): int(x.walks) for x in got.collect()} == want
    near = {(x.root, x.id): x.depth for x in graph.reach(pairs_of(spark, pairs), ids_of(spark, roots), 5).collect()}
    shortest = {(x.root, x.id): (x.depth, int(x.paths)) for x in paths.shortest_path_counts(got).collect()}
    assert {k: v[0] for k, v in shortest.items()} == near
    assert all(n == want[r, i, d] for (r, i), (d, n) in shortest.items())
    few = ids_of(spark, ["n00", "n01", "n02", "n03"])
    inside = {(a, b) for a, b in pairs if b in ("n00", "n01", "n02", "n03")}
    want = {}
    for r in roots:
        want |= slow_walks(inside, r, 3)
    assert {(x.root, x.id, x.depth): int(x.walks) for x in paths.walk_counts(pairs_of(spark, pairs), ids_of(spark, roots), 3, few).collect()} == want


def test_walk_counts_stay_at_the_most(spark):
    """Three ways at each step: beyond 38 digits the count says so, and does not run over."""
    pairs = spark.createDataFrame([("a", "a")] * 1000, "src string, dst string")
    got = {x.depth: int(x.walks) for x in paths.walk_counts(pairs, ids_of(spark, ["a"]), 15).collect()}
    assert got == {d: min(1000**d, paths.MOST_WALKS) for d in range(1, 16)}


def slow_components(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {a: {b for x, b in pairs if x == a} for a in nodes}
    while True:
        new = {a: s | {c for b in s for c in reach[b]} for a, s in reach.items()}
        if new == reach:
            break
        reach = new
    return {a: min(b for b in reach[a] if a in reach[b]) for a in nodes if a in reach[a]}


def slow_cycle_paths(pairs):
    pairs = {(a, b) for a, b in pairs if a != b}
    comp = slow_components(pairs)
    out = set()
    for cycle in set(comp.values()):
        inside = {(a, b) for a, b in pairs if comp.get(a) == comp.get(b) == cycle}
        above, level = {cycle: None}, [cycle]
        while level:
            new = {}
            for a, b in sorted(inside):
                if a in level and b not in above:
                    new.setdefault(b, a)
            above |= new
            level = list(new)
        for a, b in inside:
            path = [a]
            while path[-1] != b and above[path[-1]] is not None:
                path.append(above[path[-1]])
            if path[-1] == b:
                out.add((cycle, tuple(reversed(path))))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cycle_paths(spark, seed):
    pairs = random_pairs(seed, 14, 16 + 4 * seed)
    got = [(x.cycle, tuple(x.path)) for x in paths.cycle_paths(pairs_of(spark, pairs)).collect()]
    assert set(got) == slow_cycle_paths(pairs) and len(got) == len(set(got))
    for cycle, path in got:
        assert all(p in pairs for p in zip(path, path[1:] + path[:1])) and len(set(path)) == len(path) > 1
    assert {c for c, _ in got} == set(slow_components({(a, b) for a, b in pairs if a != b}).values())  # each component has one


def test_cycle_paths_of_a_long_cycle(spark):
    names = [f"f{i:03}" for i in range(23)]
    ring = set(zip(names, names[1:] + names[:1]))
    got = paths.cycle_paths(pairs_of(spark, ring | {("f010", "f004"), ("f003", "f003"), ("f022", "x")})).collect()
    assert sorted(tuple(x.path) for x in got) == sorted([tuple(names), tuple(names[4:11])])
    assert paths.cycle_paths(pairs_of(spark, {("a", "b"), ("b", "c")})).count() == 0
    assert paths.cycle_paths(pairs_of(spark, set())).count() == 0


def forest(spark, parents, alone=()):
    nodes = sorted(set(parents) | set(parents.values()) | set(alone))
    n = spark.createDataFrame([(x, k) for k, x in enumerate(nodes)], "id string, ord long")
    e = spark.createDataFrame([(b, a, "contains", k) for k, (a, b) in enumerate(sorted(parents.items()))] or [("", "", "", 0)], "source string, target string, kind string, ord long").where("source <> ''")
    return Graph(n, e, n)


def test_intervals(spark):
    r = random.Random(4)
    parents = {f"n{i:02}": f"n{r.randrange(max(0, i - 6), i):02}" for i in range(1, 60) if i % 13}
    g = forest(spark, parents, ["alone"])
    labels = intervals.interval_labels(g)
    rows = {x.id: x for x in labels.collect()}
    assert sorted(x.pre for x in rows.values()) == list(range(len(rows))) and set(rows) == {x.id for x in g.nodes.collect()}
    roots = g.nodes.select("id")
    by_loop = {tuple(x) for x in graph.containment_ancestors(g, roots).select("root", "id", "depth").collect()}
    up = intervals.ancestors(labels, roots)
    assert [tuple(x) for x in up.collect()].__len__() == len(by_loop) and {tuple(x) for x in up.collect()} == by_loop
    some = ids_of(spark, ["n00", "n05", "n59", "alone", "nobody"])
    down = {tuple(x) for x in intervals.descendants(labels, some).collect()}
    assert down == {(b, a, d) for a, b, d in by_loop if b in ("n00", "n05", "n59")}
    assert {x: rows[x].depth for x in rows} == {x: sum(a == x for a, _, _ in by_loop) for x in rows}


def test_intervals_refuse_what_is_no_forest(spark):
    with pytest.raises(GraphError, match="inside|itself"):
        intervals.interval_labels(forest(spark, {"a": "b", "b": "c", "c": "a", "d": "a"}))
    g = forest(spark, {"a": "b"})
    more = spark.createDataFrame([("c", "a", "contains", 9)], g.edges.schema)
    with pytest.raises(GraphError, match="containers"):
        intervals.interval_labels(Graph(g.nodes, g.edges.unionByName(more), g.files))
    assert intervals.interval_labels(forest(spark, {}, ["x"])).collect()[0][1:] == (0, 0, 0)
