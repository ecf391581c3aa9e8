"""The containment forest as intervals: what stands above and below a node is found in one pass over its numbers, without a loop for each level."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.checkpoints import cut
from codeloom.schema import Graph, GraphError


def interval_labels(g: Graph) -> DataFrame:
    """(id, depth, pre, post): each node's number in a walk of the forest of ``contains`` edges from above, and the last number below it.

    Children are in the order of their edges. A node with several containers, or one inside itself, is an error. Paths from the top are put together by
    doubling, in as many rounds as the depth has binary digits; numbers are places in the sorted paths, counted for each range of
    paths and added up, so no task sees more than a range.
    """
    contains = g.edges.where("kind = 'contains'").groupBy(F.col("target").alias("id")).agg(F.min(F.struct("ord", "source")).alias("e"), F.count_distinct("source").alias("n"))
    contains = cut(contains.select("id", F.col("e.source").alias("above"), F.col("e.ord").alias("ord"), "n"))
    twice = contains.where("n > 1").head()
    if twice is not None:
        raise GraphError(f"{twice['id']} has {twice['n']} containers")
    step = F.struct("ord", "id")
    tops = contains.select(F.col("above").alias("id")).distinct().join(contains.select("id"), "id", "left_anti").unionByName(g.nodes.select("id")).distinct().join(contains.select("id"), "id", "left_anti")
    no_ord = F.lit(None).cast(contains.schema["ord"].dataType)
    at_top = tops.select("id", F.lit(None).cast("string").alias("above"), F.array(F.struct(no_ord.alias("ord"), "id")).alias("path"))
    paths = cut(contains.select("id", "above", F.array(step).alias("path")).unionByName(at_top))
    inside_itself = F.array_contains(F.transform("path", lambda x: x["id"]), F.col("above"))
    while True:
        open_paths = paths.where("above is not null").agg(F.count("*").alias("n"), F.max(inside_itself).alias("loops")).head()
        if open_paths["loops"]:
            raise GraphError("a node contains itself")
        if not open_paths["n"]:
            break
        up = paths.select(F.col("id").alias("above"), F.col("above").alias("next"), F.col("path").alias("before"))
        paths = cut(paths.join(up, "above", "left").select("id", F.col("next").alias("above"), F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat("before", "path")).alias("path")))
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(paths.select("id", "path").repartitionByRange(n, "path").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("more"))  # one row for each range
    place = F.row_number().over(Window.partitionBy("part").orderBy("path"))
    numbered = dealt.withColumn("place", place).join(F.broadcast(sizes), "part").select("id", F.size("path").cast("long").alias("depth"), (F.col("place") + F.col("more") - 1).alias("pre"))
    below = dealt.select(F.explode(F.transform("path", lambda x: x["id"])).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return cut(numbered.join(below, "id").select("id", (F.col("depth") - 1).alias("depth"), "pre", (F.col("pre") + F.col("n") - 1).alias("post")))


def enclosing(labels: DataFrame, inner: DataFrame | None, outer: DataFrame | None) -> DataFrame:
    """(inner, outer, depth) of labelled nodes inside others, and how many levels lie between; inner, outer: ids, None for all that have labels.

    Numbers are dealt in ranges. A range gets its own nodes, and those before it that reach into it, in order; what is open at a node is what encloses
    it, so each node is written once and a task holds one path.
    """
    n = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = labels.agg(F.max("pre")).head()[0]
    width = F.lit(1 if last is None else last // n + 1).cast("long")
    rows = labels.select("id", "depth", "pre", "post")
    for name, some in (("is_inner", inner), ("is_outer", outer)):
        if some is None:
            rows = rows.withColumn(name, F.lit(True))
        else:
            rows = rows.join(some.select("id").distinct().withColumn(name, F.lit(True)), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    rows = rows.withColumn("is_outer", F.col("is_outer") & (F.col("post") > F.col("pre"))).where("is_inner or is_outer")
    part = lambda c: F.floor(F.col(c) / width).cast("long")
    own = rows.withColumn("part", part("pre"))
    open_before = rows.where(F.col("is_outer") & (part("post") > part("pre"))).withColumn("part", F.explode(F.sequence(part("pre") + 1, part("post")))).withColumn("is_inner", F.lit(False))
    fields = ["part", "pre", "post", "id", "depth", "is_inner", "is_outer"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, depths, posts = None, [], [], []
        found: tuple[list, list, list] = ([], [], [])

        def told():
            out = pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.int32())], names=["inner", "outer", "depth"])
            for x in found:
                x.clear()
            return out

        for b in batches:
            for at, pre, post, i, depth, is_inner, is_outer in zip(*(b.column(c).to_pylist() for c in fields), strict=True):
                if at != now:
                    now, ids, depths, posts = at, [], [], []
                while posts and posts[-1] < pre:
                    posts.pop(), ids.pop(), depths.pop()
                if is_inner and ids:
                    found[0].extend([i] * len(ids))
                    found[1].extend(ids)
                    found[2].extend([depth - x for x in depths])
                    if len(found[0]) > 10_000:
                        yield told()
                if is_outer:
                    ids.append(i), depths.append(depth), posts.append(post)
        if found[0]:
            yield told()

    dealt = own.select(*fields).unionByName(open_before.select(*fields)).repartition(n, "part").sortWithinPartitions("part", "pre")
    return dealt.mapInArrow(sweep, "inner string, outer string, depth int")


def ancestors(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, depth) of what contains the roots, as the walk finds it."""
    return enclosing(labels, roots, None).select(F.col("inner").alias("root"), F.col("outer").alias("id"), "depth")


def descendants(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, depth) of what the roots contain, at any distance."""
    return enclosing(labels, None, roots).select(F.col("outer").alias("root"), F.col("inner").alias("id"), "depth")
