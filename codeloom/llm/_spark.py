"""Spark helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.checkpoints import cut, shared_folder


def rows_of_files(df: DataFrame) -> bool:
    """Whether the plan is one scan of files, each read once, with filters and projections: then no row of a file is there twice."""
    todo, roots = [df._jdf.queryExecution().analyzed()], []
    while todo:
        plan = todo.pop()
        kind = plan.nodeName().split(" ")[0]
        if kind not in ("Project", "Filter", "SubqueryAlias", "LogicalRelation", "Relation"):
            return False
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
        if not children.size():
            paths = plan.relation().location().rootPaths()
            roots.append([paths.apply(i).toString() for i in range(paths.size())])
    return len(roots) == 1 and len(roots[0]) == len(set(roots[0]))


def with_row_key(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a long column that differs for every row, and its name; all who read it see the same keys.

    Rows of a plain scan of files are known by the number of their file and their place in it. All others (after explode, sampling with
    replacement, joins, unions and so on, where a row of a file may be there several times) are numbered, written and read again.
    """
    name = "row_key"
    while name.lower() in [c.lower() for c in df.columns]:
        name = "_" + name
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at")) if rows_of_files(df) else None
    except AnalysisException:
        placed = None
    if placed is not None:
        files = [r[0] for r in placed.select("__file").distinct().collect()]  # as many as there are files
        numbers = df.sparkSession.createDataFrame(list(enumerate(sorted(files))), "__number long, __file string")
        keyed = placed.join(F.broadcast(numbers), "__file")
        return keyed.select(*df.columns, (F.col("__number") * F.lit(1 << 40) + F.col("__at")).alias(name)), name
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.withColumn(name, F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path), name


def summed_counters(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of rows of packed integers (one binary column); the driver gets one vector of a fixed length."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, np.int64)
        for b in batches:
            for x in b[0]:
                out += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["vector"])

    row = parts.repartition(8).mapInArrow(total, "vector binary").repartition(1).mapInArrow(total, "vector binary").head()
    return np.frombuffer(row[0], np.int64) if row else np.zeros(size, np.int64)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def even_labels(df: DataFrame, n: int) -> list[int]:
    """n integers that repartition(n, label) sends to n different partitions."""
    ids = df.sparkSession.range(40 * n).select(F.col("id").cast("int").alias("label")).groupBy(F.pmod(F.hash("label"), F.lit(n)).alias("at")).agg(F.min("label").alias("label"))
    found = {r["at"]: r["label"] for r in ids.collect()}
    return [found.get(i, i) for i in range(n)]


def released(run: Callable) -> Callable:
    """A function of batches that, when it ends, gives the memory that Python and Arrow hold without using it back to the system.

    Spark keeps Python workers for later tasks; without this each keeps the most that any task before needed, beside the executor's own memory.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # not with every C library
                ctypes.CDLL(None).malloc_trim(0)

    return mapped


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of a partition sorted by key, a table for each value."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        keys = b[key].to_pylist()
        lo = 0
        for i in range(len(keys) + 1):
            if i < len(keys) and (i == lo and (not held or keys[i] == last) or i > lo and keys[i] == keys[i - 1]):
                last = keys[i]
                continue
            if i > lo:
                held.append(b.slice(lo, i - lo))
            if i < len(keys):
                yield pa.Table.from_batches(held)
                held, lo, last = [], i, keys[i]
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of an undirected graph; the component is its smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing changes: each step links a
    node's neighbours to the smallest one around it, and the edges end as stars around the smallest nodes. Smallest
    neighbours are aggregated before they are shuffled, and joined back, so that a node of many edges is split by Spark.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = cut(small)
        new = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).head()
        if new == state:
            break
        state = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
