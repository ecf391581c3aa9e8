"""Paths in a graph: how many walks lead somewhere, breadth-first trees with their ancestors, and import cycles as closed paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.checkpoints import cut
from codeloom.operators.graph import cyclic_files, onward_pairs

#: The largest count of walks: where more are added up, this is told, and it means that there are as many or more.
MOST_WALKS = 10**38 - 1


def sum_of_walks(n: str | Column) -> Column:
    """The sum of decimal(38, 0) counts, MOST_WALKS where it has more digits; counts stay sums in this order only, so whatever is added later keeps it."""
    return F.coalesce(F.try_sum(n), F.lit(str(MOST_WALKS)).cast("decimal(38,0)")).cast("decimal(38,0)")


def walk_counts(pairs: DataFrame, roots: DataFrame, max_depth: int, allowed: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(root, id, depth, walks): in how many ways each id is reached in exactly 1..max_depth steps, roots themselves and repeated visits included.

    pairs: (src, dst); repeated pairs are ways of their own. Roots given twice count once. A level is one row for each root and id, with the sum of its
    predecessors' counts, so work follows the pairs and not the walks; sums beyond 38 digits stay at MOST_WALKS. allowed, by: as for ``reach``.
    """
    key = [*by, "root", "id"]
    onward = onward_pairs(pairs, by, max_depth > 1)
    level = roots.select(*by, F.col("id").alias("root"), "id").distinct().withColumn("walks", F.lit(1).cast("decimal(38,0)"))
    out = None
    for depth in range(1, max_depth + 1):
        met = level.join(onward, [*by, "id"]).select(*by, "root", F.col("dst").alias("id"), "walks")
        if allowed is not None:
            met = met.join(allowed.select("id"), "id", "left_semi")
        level = met.groupBy(*key).agg(sum_of_walks("walks").alias("walks"))
        if depth < max_depth:
            level = cut(level)
        found = level.select(*key, F.lit(depth).alias("depth"), "walks")
        out = found if out is None else out.unionByName(found)
        if depth < max_depth and level.isEmpty():
            break
    return out


def shortest_path_counts(walks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(root, id, depth, paths) of the least depth in walks, without roots: what ``reach`` finds, with the number of shortest paths."""
    first = walks.where("root <> id").groupBy(*by, "root", "id").agg(F.min(F.struct("depth", "walks")).alias("w"))
    return first.select(*by, "root", "id", "w.depth", F.col("w.walks").alias("paths"))


def breadth_tree(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(tree, id, above, depth): a breadth-first tree from each root (column id, which also names the tree), which its pairs (tree, src, dst) never leave.

    ``above`` is the smallest of the nodes one level up that lead here; roots have none. Trees share no nodes.
    """
    onward = onward_pairs(pairs, ["tree"], True)
    level = roots.select(F.col("id").alias("tree"), "id", F.lit(None).cast("string").alias("above"), F.lit(0).alias("depth"))
    seen, depth = level, 0
    while True:
        depth += 1
        new = level.join(onward, ["tree", "id"]).groupBy("tree", F.col("dst").alias("id")).agg(F.min("id").alias("above"))
        level = cut(new.join(seen, ["tree", "id"], "left_anti").withColumn("depth", F.lit(depth)).select("tree", "id", "above", "depth"))
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)


class Ancestors:
    """Who stands 1, 2, 4, ... levels above each node of trees (id, above, depth), so that any distance is a join for each binary digit."""

    def __init__(self, tree: DataFrame):
        self.tables = [cut(tree.select("id", "above").where("above is not null"))]
        deepest = tree.agg(F.max("depth").alias("d")).head()["d"] or 0
        while 1 << len(self.tables) <= deepest:
            last = self.tables[-1]
            self.tables.append(cut(last.join(last.select(F.col("id").alias("above"), F.col("above").alias("far")), "above").select("id", F.col("far").alias("above"))))

    def climb(self, rows: DataFrame, at: str, distance: str) -> DataFrame:
        """rows with ``at`` moved up by ``distance`` levels; null above the top."""
        for j, table in enumerate(self.tables):
            moves = F.col(distance).bitwiseAND(F.lit(1 << j)) != 0
            step = table.select(F.col("id").alias(at), F.col("above").alias("__above"))
            stay = rows.where(~moves)
            rows = rows.where(moves).join(step, at, "left").withColumn(at, F.col("__above")).drop("__above").select(*rows.columns).unionByName(stay)
        return rows


def cycle_paths(pairs: DataFrame) -> DataFrame:
    """(cycle, path): import cycles as paths, each file importing the next and the last one the first, for (src, dst) pairs of files.

    cycle is the smallest file of the strongly connected component. In each component a breadth-first tree hangs from that file; every pair that leads
    back to an ancestor in the tree closes one path, which is then the tree's way from the ancestor down. So every component has a path, every pair
    appears in one path at most as the closing one, and paths have any length. Pairs across the tree close none, so these are not all cycles.
    A file that imports itself is no cycle. Paths are put together level by level of binary distances, not by walking them.
    """
    e = cut(pairs.where("src <> dst").select("src", "dst").distinct())
    found = cut(cyclic_files(e))
    inside = e.join(found.select(F.col("file").alias("src"), F.col("cycle").alias("tree")), "src").join(found.select(F.col("file").alias("dst"), F.col("cycle").alias("b")), "dst").where("tree = b")
    inside = cut(inside.select("tree", "src", "dst"))
    tree = cut(breadth_tree(inside, found.select(F.col("cycle").alias("id")).distinct()))
    ancestors = Ancestors(tree)
    depth = tree.select("id", "depth")
    met = inside.join(depth.select(F.col("id").alias("src"), F.col("depth").alias("low")), "src").join(depth.select(F.col("id").alias("dst"), F.col("depth").alias("high")), "dst")
    met = met.where("low > high").select("tree", "src", "dst", (F.col("low") - F.col("high")).alias("n"), F.col("src").alias("at"))
    back = cut(ancestors.climb(met, "at", "n").where("at = dst").select("tree", "src", "dst", "n"))
    steps = back.select("tree", "src", "dst", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("up"), F.col("src").alias("at"))
    placed = ancestors.climb(steps, "at", "up")
    path = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("k"), "at"))), lambda x: x["at"])
    return placed.groupBy(F.col("tree").alias("cycle"), "src", "dst").agg(path.alias("path")).select("cycle", "path")
