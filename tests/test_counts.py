"""Counts of what is reached, against the rows that they count, and the disk that they take."""

import collections
import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import counts, graph, intervals, paths
from codeloom.plans import context
from codeloom.queries import QUERIES
from codeloom.schema import Graph


def table(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def random_graph(spark, seed):
    r = random.Random(seed)
    names = [f"n{i:02}é\"" if i % 3 else f"x{i}" * 20 for i in range(30)]
    pairs = {(r.choice(names), r.choice(names)) for _ in range(60)}
    return names, table(spark, sorted(pairs), "src string, dst string")


@pytest.mark.parametrize(("depth", "at_once"), [(1, 1000), (2, 1), (2, 17), (3, 1000), (5, 9)])
def test_counts_of_random_graphs(spark, depth, at_once):
    names, pairs = random_graph(spark, depth)
    roots = table(spark, [(x,) for x in [*names[:12], "gone", names[0]]], "id string")
    got = counts.reach_counts(pairs, roots, depth, at_once=at_once).collect()
    want = collections.Counter((x.root, x.depth) for x in graph.reach(pairs, roots, depth).collect())
    assert sorted((x.root, x.depth, x.n) for x in got) == sorted((*k, n) for k, n in want.items())


@pytest.mark.parametrize("at_once", [1, 1000])
def test_second_steps_of_random_graphs(spark, at_once):
    names, pairs = random_graph(spark, 7)
    roots = table(spark, [(x,) for x in names], "id string")
    walks = paths.walk_counts(pairs, roots, 2).where("depth = 2").groupBy("root").agg(F.count("*").alias("n"), F.sum("walks").cast("long").alias("walks"))
    assert sorted(map(tuple, counts.second_steps(pairs, roots, at_once).collect())) == sorted(map(tuple, walks.collect()))


def test_late_pairs_and_long_lists(spark):
    """More ids than one list holds; late pairs count where steps do not reach."""
    pairs = table(spark, [("r", f"a{k}") for k in range(2500)] + [(f"a{k}", "r") for k in range(2500)] + [("a7", "b")], "src string, dst string")
    late = table(spark, [("r", "a3"), ("r", "b"), ("r", "c"), ("q", "a1")], "root string, id string")
    got = counts.reach_counts(pairs, table(spark, [("r",), ("q",)], "id string"), 2, late)
    assert sorted(map(tuple, got.collect())) == [("q", 3, 1), ("r", 1, 2500), ("r", 2, 1), ("r", 3, 1)]
    assert counts.reach_counts(pairs.limit(0), table(spark, [("r",)], "id string"), 3).count() == 0
    with pytest.raises(ValueError, match="max_depth"):
        counts.reach_counts(pairs, late.select("id"), 0)


def orders_key(k):
    return k * 7919 % 1000003


def supplier_key(k):
    return k * 104729 % 1000003


def hub(spark, folder, n):
    """n orders of one part, from n suppliers: n * n pairs of orders and suppliers, of scattered keys."""
    day = datetime.datetime(2020, 1, 1)
    order, supp = [orders_key(k) for k in range(n)], [supplier_key(k) for k in range(n)]
    rows = {
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "nation": ([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, "C", 0, 1.0, "S")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": ([(k, f"S{k}", 0, 1.0) for k in supp], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "part": ([(5, "P", "B", "T", 1, 1.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(k, 1, "O", 1.0, day, "1") for k in order], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(a, 5, b, 1, "R" if k < 3 else "N") for k, (a, b) in enumerate(zip(order, supp, strict=True))], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string"),
    }
    for name, (data, columns) in rows.items():
        table(spark, data, columns).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def hub_dir(spark, tmp_path_factory):
    folder, n = str(tmp_path_factory.mktemp("hub")), 1200
    hub(spark, folder, n)
    return folder, n


def disk(spark):
    found = 0
    for top, _, names in os.walk(spark.sparkContext.getConf().get("spark.local.dir")):
        for x in names:
            try:
                found += os.path.getsize(os.path.join(top, x))
            except OSError:
                pass
    return found


def small(spark, hub_dir, name):
    """A query's rows, and the MB of shuffle files that it left."""
    before = disk(spark)
    rows = sorted(map(tuple, QUERIES[name](spark, hub_dir[0]).collect()))
    return rows, (disk(spark) - before) / 1e6


def test_kinds_are_chosen_before_pairs_are_dealt(spark):
    """Most pairs lead to kinds that are not walked; they are dealt once, not again for each level."""
    other = spark.range(200_000).select(F.concat(F.lit("a"), F.xxhash64("id")).alias("source"), F.concat(F.lit("f"), F.xxhash64("id", F.lit(1))).alias("target"), F.lit("calls").alias("kind"), F.col("id").alias("ord"))
    few = table(spark, [("r", "c1", "contains", 0), ("c1", "c2", "calls", 1), ("c1", "c2", "references", 2), ("c2", "f", "calls", 3), ("f", "c3", "calls", 4), ("c2", "r", "calls", 5)], other.columns)
    nodes = table(spark, [("r", "file", 9), ("c1", "class", 3), ("c2", "class", 2), ("c3", "class", 1), ("f", "function", 0)], "id string, kind string, ord long")
    g, roots = Graph(nodes, few.unionByName(other), nodes), table(spark, [("r",)], "id string")
    before = disk(spark)
    got = graph.traverse(g, roots, 3, node_kinds=["class"], include_start=True).collect()
    assert sorted(map(tuple, got)) == [("r", "c1", 1), ("r", "c2", 2), ("r", "r", 0)] and (disk(spark) - before) / 1e6 < 14
    assert [tuple(x) for x in graph.traverse(g, roots, 3, node_kinds=["class"], limit=1).collect()] == [("r", "c1", 1)]


def test_chains_are_walked_for_the_symbols_that_pages_list(spark):
    """Pages go on to later symbols where the first ones call nobody, and the others' walks are not made."""
    r = random.Random(3)
    names = [f"f{k:04}" for k in range(3000)]
    calls = sorted({(a, names[r.randrange(3000)], "calls") for a in names[30:] for _ in range(5)} - {(a, a, "calls") for a in names})
    calls += [(names[2], "gone", "calls"), ("gone", names[7], "calls"), (names[4], names[4], "calls")]
    nodes = table(spark, [(a, "function", a.upper(), "x", k) for k, a in enumerate(names)], "id string, kind string, name string, file_path string, ord long")
    edges = table(spark, calls, "source string, target string, kind string")
    focal = table(spark, [(n, a, k) for n, some in (("p", names[:25]), ("q", names[25:]), ("z", names[4:5])) for k, a in enumerate(some)], "number string, id string, pos int")
    before = disk(spark)
    got = context.call_chains(focal, Graph(nodes, edges, nodes), limit=3).collect()
    mb = (disk(spark) - before) / 1e6
    called = {a: [b for x, b, _ in calls if x == a] for a in {*names, "gone"}}
    callers = collections.defaultdict(list)
    for a, b, _ in calls:
        callers[b].append(a)

    def near(step, a, depth):
        dist = {a: 0}
        for x in (queue := [a]):
            for y in step[x]:
                if y not in dist and dist[x] < depth:
                    dist[y] = dist[x] + 1
                    queue.append(y)
        return sorted((d, y) for y, d in dist.items() if d and y != "gone")

    want = []
    for n, some in (("p", names[:25]), ("q", names[25:]), ("z", names[4:5])):
        every = [(a, way, x) for a in some for way, step, depth in (("callees", called, 3), ("callers", callers, 2)) if (x := near(step, a, depth))]
        for k, (a, way, x) in enumerate(every[:3], 1):
            path = [a.upper()] + [y.upper() for _, y in x] if way == "callees" else [y.upper() for _, y in reversed(x)] + [a.upper()]
            want.append((n, a, k, way, path))
    assert sorted(((x.number, x.id, x.k, x.direction, x.path[:1001]) for x in got)) == sorted(want) and len(want) > 5 and mb < 3


def test_enclosing_intervals_write_each_node_once(spark):
    """A forest of three levels with scattered ids, and a path that crosses every range."""
    n, deep = 60_000, 40
    ids = [f"x{k * 7919 % 1000003}" for k in range(n)]
    depth = [min(k, deep) if k < deep + 1 else deep + (k % 10 != 0) for k in range(n)]
    rows, post = [], [n - 1] * n
    tops = [k for k in range(deep, n) if depth[k] == deep]
    for a, b in zip(tops, [*tops[1:], n], strict=True):
        post[a] = b - 1
    post = [p if depth[k] <= deep else k for k, p in enumerate(post)]
    rows = list(zip(ids, depth, range(n), post, strict=True))
    labels = table(spark, rows, "id string, depth long, pre long, post long").repartition(4)
    inner = [k for k in range(n) if k % 2 == 0]
    before = disk(spark)
    got = intervals.ancestors(labels, table(spark, [(ids[k],) for k in inner], "id string")).withColumn("h", F.xxhash64("root", "id", "depth"))
    got = got.agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.max("depth")).head()
    mb = (disk(spark) - before) / 1e6
    want, path = [], []
    for k in range(n):
        while path and post[path[-1]] < k:
            path.pop()
        if k % 2 == 0:
            want += [(ids[k], ids[a], depth[k] - depth[a]) for a in path]
        if post[k] > k:
            path.append(k)
    want = table(spark, want, "root string, id string, depth int").withColumn("h", F.xxhash64("root", "id", "depth")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.max("depth")).head()
    assert tuple(got) == tuple(want) and mb < 4


def test_callees_of_a_hub(spark, hub_dir):
    n = hub_dir[1]
    rows, mb = small(spark, hub_dir, "callees_d2")
    assert rows == sorted((f"o:{orders_key(k)}", n + 1, 2 * n + 1) for k in range(n)) and mb < 1


def test_impact_of_a_hub(spark, hub_dir):
    n = hub_dir[1]
    rows, mb = small(spark, hub_dir, "impact_radius")
    assert rows == sorted([(f"s:{supplier_key(k)}", "calls", n + 1) for k in range(n)] + [(f"s:{supplier_key(k)}", "references", 1) for k in range(3)]) and mb < 1


def test_walks_of_a_hub(spark, hub_dir):
    n = hub_dir[1]
    rows, mb = small(spark, hub_dir, "supplier_walks")
    assert rows == sorted((f"o:{orders_key(k)}", n, str(n)) for k in range(n)) and mb < 1


def test_callers_of_a_hub(spark, hub_dir):
    n = hub_dir[1]
    rows, mb = small(spark, hub_dir, "callers_d2")
    assert rows == sorted((f"s:{supplier_key(k)}", d, m) for k in range(n) for d, m in ((1, 1), (2, n))) and mb < 1
