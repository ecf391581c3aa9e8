"""Traversals from many roots at once: each level is a join of the frontier with the edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.checkpoints import cut, few
from codeloom.schema import Graph

#: Up to so many levels a traversal takes repeated visits together at its end; beyond, what is known is left out level by level.
FEW_LEVELS = 3


def steps(edges: DataFrame, direction: str = "outgoing", kinds: Sequence[str] | None = None, into: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst) pairs to walk along. ``both`` goes either way; ``legacy`` is outgoing under another name. into: ids (column id) that pairs may lead to.

    A graph has one edge for each (source, target, kind), so pairs of one kind in one direction are distinct as they are.
    """
    if kinds is not None:
        edges = edges.where(F.col("kind").isin(list(kinds)))
    out = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    back = edges.select(F.col("target").alias("src"), F.col("source").alias("dst"))
    walked = {"outgoing": out, "incoming": back, "both": out.unionByName(back), "legacy": out}[direction]
    if into is not None:  # before pairs are dealt for anything else
        walked = walked.join(into.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    return walked if direction != "both" and kinds is not None and len(set(kinds)) == 1 else walked.distinct()


def onward_pairs(pairs: DataFrame, by: Sequence[str], several: bool) -> DataFrame:
    """Pairs as (by, id, dst), to be joined with a frontier; for several levels they are written once, dealt by their keys."""
    onward = pairs.select(*by, F.col("src").alias("id"), "dst")
    if not several:
        return onward
    return cut(onward.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "id"))


def reach(pairs: DataFrame, roots: DataFrame, max_depth: int | None, allowed: DataFrame | None = None, by: Sequence[str] = (), stored: bool = False) -> DataFrame:
    """(root, id, depth): what can be reached in 1..max_depth steps (None: any number), with the least number of steps; roots themselves are left out.

    allowed: ids (column id) that may be visited; others are neither returned nor passed. by: columns of pairs and roots, and then of the
    result, that keep walks of several sorts apart, so that they are one loop. stored: pairs are read from a written table; they are not written
    again, and a frontier of few rows goes to them.
    """
    key = [*by, "root", "id"]
    frontier = roots.select(*by, F.col("id").alias("root"), F.col("id")).distinct()
    onward = onward_pairs(pairs, by, max_depth != 1 and not stored)
    if stored:
        frontier = cut(frontier)

    def level(frontier: DataFrame, last: bool = False) -> DataFrame:
        new = (few(frontier) if stored else frontier).join(onward, [*by, "id"]).select(*by, "root", F.col("dst").alias("id")).where("root <> id")
        if not last:  # what the last level finds twice falls together with the other levels
            new = new.distinct()
        return new if allowed is None else new.join(allowed.select("id"), "id", "left_semi").select(*key)

    if max_depth is not None and max_depth <= FEW_LEVELS:
        levels = []
        for depth in range(1, max_depth + 1):
            frontier = level(frontier, depth == max_depth)
            if depth < max_depth:
                frontier = cut(frontier)
            levels.append(frontier.withColumn("depth", F.lit(depth)))
        out = levels[0]
        for x in levels[1:]:
            out = out.unionByName(x)
        return out.groupBy(*key).agg(F.min("depth").alias("depth"))
    seen, depth = None, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = level(frontier)
        if seen is not None:
            new = new.join(seen.select(*key), key, "left_anti")
        frontier = cut(new.select(*key))
        if frontier.isEmpty():
            break
        marked = frontier.withColumn("depth", F.lit(depth))
        seen = marked if seen is None else seen.unionByName(marked)
    return seen if seen is not None else frontier.withColumn("depth", F.lit(0)).limit(0)


def traverse(g: Graph, roots: DataFrame, max_depth: int = 3, direction: str = "outgoing", edge_kinds: Sequence[str] | None = None, node_kinds: Sequence[str] | None = None, limit: int | None = 100, include_start: bool = False) -> DataFrame:
    """(root, id, depth) of a breadth-first walk; with a limit the nearest ids of each root, in order of depth and node order."""
    nodes = g.nodes if node_kinds is None else g.nodes.where(F.col("kind").isin(list(node_kinds)))
    if node_kinds is None:
        out = reach(steps(g.edges, direction, edge_kinds), roots, max_depth, nodes.select("id"))
    else:
        out = reach(steps(g.edges, direction, edge_kinds, nodes), roots, max_depth)
    if include_start:
        nodes = g.nodes
        out = out.unionByName(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct())
    if limit is not None:
        near = Window.partitionBy("root").orderBy("depth", "ord")
        out = out.join(nodes.select("id", "ord"), "id").withColumn("k", F.row_number().over(near)).where(F.col("k") <= limit).select("root", "id", "depth")
    return out


def callees(g: Graph, roots: DataFrame, depth: int = 1, stored: bool = False) -> DataFrame:
    return reach(steps(g.edges, "outgoing", ["calls"]), roots, depth, stored=stored)


def callers(g: Graph, roots: DataFrame, depth: int = 1, stored: bool = False) -> DataFrame:
    return reach(steps(g.edges, "incoming", ["calls"]), roots, depth, stored=stored)


def type_hierarchy(g: Graph, roots: DataFrame, max_depth: int = 10) -> DataFrame:
    """(root, id, role, depth): extends chains, then implements chains, as ancestors; extends from below as descendants. Chains do not mix kinds."""
    walks = {"extends": steps(g.edges, "outgoing", ["extends"]), "implements": steps(g.edges, "outgoing", ["implements"]), "descendant": steps(g.edges, "incoming", ["extends"])}
    tagged = [pairs.withColumn("role", F.lit(role)) for role, pairs in walks.items()]
    starts = roots.select("id", F.explode(F.array(*map(F.lit, walks))).alias("role"))
    return reach(tagged[0].unionByName(tagged[1]).unionByName(tagged[2]), starts, max_depth, by=["role"]).select("root", "id", "role", "depth")


def containment_ancestors(g: Graph, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, id, depth) of what contains the roots, nearest first; ends at the top and at cycles, or after ``max_depth`` steps."""
    return reach(steps(g.edges, "incoming", ["contains"]), roots, max_depth)


def containment_depth(g: Graph, roots: DataFrame, cap: int = 20) -> DataFrame:
    """(id, depth): how many containers stand above each root along first parents, ``cap`` at most (as on a cycle).

    Each round doubles the steps: who stands 1, 2, 4, ... above every node.
    """
    up = cut(g.edges.where("kind = 'contains'").groupBy(F.col("target").alias("at")).agg(F.min_by("source", "ord").alias("above")).withColumn("d", F.lit(1).cast("long")))
    steps_done = 1
    while steps_done < cap:
        far = up.select(F.col("at").alias("above"), F.col("above").alias("next"), F.col("d").alias("more"))
        up = cut(up.join(far, "above", "left").select("at", F.col("next").alias("above"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d")))
        steps_done *= 2
        if up.where("above is not null").isEmpty():
            break
    return roots.select("id").distinct().join(up, F.col("id") == up["at"], "left").select("id", F.least(F.coalesce("d", F.lit(0)), F.lit(cap)).cast("long").alias("depth"))


def referrers(g: Graph, roots: DataFrame) -> DataFrame:
    """(root, id) of direct references to the roots."""
    found = g.edges.where("kind = 'references'").join(roots.select("id").distinct(), F.col("target") == F.col("id"), "left_semi")
    return found.select(F.col("target").alias("root"), F.col("source").alias("id")).where("root <> id")


def impact_radius(g: Graph, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(root, id, via): callers within a distance, and direct referrers that are not among them ("calls" is the smaller word)."""
    called = callers(g, roots, depth).select("root", "id", F.lit("calls").alias("via"))
    return called.unionByName(referrers(g, roots).withColumn("via", F.lit("references"))).groupBy("root", "id").agg(F.min("via").alias("via"))


def dead_code(g: Graph) -> DataFrame:
    """Functions, methods and classes that are not exported, not private by name, and neither called nor referenced, with one container at most."""
    used = g.edges.where("kind in ('calls', 'references')").select(F.col("target").alias("id"))
    twice = g.edges.where("kind = 'contains'").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n")).where("n > 1")
    some = g.nodes.where("kind in ('function', 'method', 'class') and not is_exported and not startswith(name, '_')")
    return some.join(used, "id", "left_anti").join(twice, "id", "left_anti").select("id", "kind", "name", "file_path", "ord")


def file_dependencies(g: Graph) -> DataFrame:
    """Distinct (src, dst) file paths between which imports run."""
    where = g.nodes.select("id", "file_path")
    imports = g.edges.where("kind = 'imports'").select("source", "target")
    a = imports.join(where.select(F.col("id").alias("source"), F.col("file_path").alias("src")), "source")
    b = a.join(where.select(F.col("id").alias("target"), F.col("file_path").alias("dst")), "target")
    return b.where("src <> dst").select("src", "dst").distinct()


def trimmed(pairs: DataFrame) -> DataFrame:
    """Pairs without those that no cycle can use: of nodes that nothing leads to, or from, until none is left."""
    e = cut(pairs.where("src <> dst").distinct())
    n = e.count()
    while n:
        kept = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        e = cut(kept.select("src", "dst"))
        n, before = e.count(), n
        if n == before:
            break
    return e


def spread(values: DataFrame, e: DataFrame, better) -> DataFrame:
    """(id, value) after every value went along all pairs (src, dst) until none gets better; each node holds one value."""
    while True:
        sent = values.withColumnRenamed("id", "src").join(e, "src").groupBy(F.col("dst").alias("id")).agg(better("value").alias("new"))
        values = cut(values.join(sent, "id", "left").select("id", F.col("value").alias("old"), F.coalesce(better_of(better, "value", "new"), "value").alias("value")))
        if values.where("value <> old").isEmpty():
            return values.select("id", "value")
        values = values.select("id", "value")


def better_of(better, a: str, b: str):
    return (F.least if better is F.min else F.greatest)(a, b)


def cyclic_files(pairs: DataFrame) -> DataFrame:
    """(file, cycle): files on an import cycle of any length; the cycle is the smallest file of those that reach each other.

    Strongly connected components by colours: every node takes the smallest node that leads to it; what leads back to that node inside
    its colour is its component. The rest is trimmed and coloured again. Each round holds one row for each node and pair.
    """
    e, found = trimmed(pairs), None
    while not e.isEmpty():
        nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
        colour = spread(nodes.withColumn("value", F.col("id")), e, F.min)
        inside = e.join(colour.select(F.col("id").alias("src"), F.col("value").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("value").alias("b")), "dst").where("a = b")
        back = cut(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        reached = spread(colour.select("id", (F.col("id") == F.col("value")).cast("int").alias("value")), back, F.max)
        part = cut(colour.join(reached.where("value = 1").select("id"), "id", "left_semi").select(F.col("id").alias("file"), F.col("value").alias("cycle")))
        found = part if found is None else found.unionByName(part)
        gone = part.select("file")
        e = trimmed(e.join(gone, e["src"] == gone["file"], "left_anti").join(gone, e["dst"] == gone["file"], "left_anti"))
    if found is None:
        return pairs.select(F.col("src").alias("file"), F.col("dst").alias("cycle")).limit(0)
    several = found.groupBy("cycle").agg(F.count("*").alias("n")).where("n > 1").select("cycle")
    return found.join(several, "cycle", "left_semi").select("file", "cycle")


def cycle_nodes(g: Graph) -> DataFrame:
    """(cycle, k, id, file_path): the file nodes of each import cycle, in order of their paths."""
    found = cyclic_files(file_dependencies(g))
    nodes = g.nodes.where("kind = 'file'").select("id", "file_path")
    place = F.row_number().over(Window.partitionBy("cycle").orderBy("file_path", "id"))
    return found.withColumnRenamed("file", "file_path").join(nodes, "file_path").select("cycle", place.alias("k"), "id", "file_path")


def short_cycles(pairs: DataFrame, longest: int = 3) -> DataFrame:
    """(cycle): import cycles of 2..longest files, each once, from its smallest file."""
    e = cut(pairs.distinct())
    # All files after the first are larger than it, so each cycle is found from one start.
    path = e.where("dst > src").select(F.array("src", "dst").alias("path"))
    found = []
    for n in range(2, longest + 1):
        closing = path.join(e, (F.element_at("path", -1) == e["src"]) & (F.col("path")[0] == e["dst"]), "left_semi")
        found.append(closing.select(F.array_join("path", " -> ").alias("cycle")))
        if n < longest:
            path = path.join(e, F.element_at("path", -1) == e["src"]).where((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
