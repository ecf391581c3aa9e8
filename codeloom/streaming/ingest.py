"""Incremental ingest: each micro-batch of new file versions is appended, and the last version of each file counts.

Tables are plain Parquet with a column ``batch``. A batch writes its own partition of each, with dynamic partition overwrite, so a batch that is written again
replaces itself; the files table comes last. Files whose content has not changed write nothing, and files that are gone
leave a row that says so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.checkpoints import cut
from codeloom.operators.lookup import first_edges, last_nodes, sound_edges
from codeloom.operators.resolve import resolve_references
from codeloom.schema import Graph


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    """The rows as the partition of a batch, in place of what it had."""
    out = df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("batch").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A table with all columns that any batch has; None if nothing was written."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path).withColumn("batch", F.col("batch").cast("long"))
    except AnalysisException:
        return None


class GraphTables:
    """The tables of a graph, appended batch by batch.

    A batch costs what its own files cost. Edges and references are kept as they were found, whether or not their other ends are known yet.
    """

    NAMES = ("nodes", "edges", "files", "refs")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str) -> DataFrame | None:
        return read_table(self.spark, f"{self.path}/{name}")

    def append(self, g: Graph, batch: int, deleted: DataFrame | None = None) -> None:
        """Add the files of a batch with all that belongs to them, and note which paths (column path) are gone.

        Files come last, as they make the batch count. A path that is in both is there.
        """
        where = g.nodes.select(F.col("id").alias("source"), "file_path").dropDuplicates(["source"])
        tables = {"nodes": g.nodes, "edges": g.edges.join(where, "source", "left"), "refs": g.refs}
        for name, df in tables.items():
            if df is not None:
                write_batch(df, f"{self.path}/{name}", batch)
        files = g.files.withColumn("deleted", F.lit(False))
        if deleted is not None:
            gone = deleted.select("path").distinct().join(g.files.select("path"), "path", "left_anti")
            files = files.unionByName(gone.withColumn("deleted", F.lit(True)), allowMissingColumns=True)
        write_batch(files, f"{self.path}/files", batch)

    def versions(self) -> DataFrame | None:
        """(path, batch, content_hash) of the files that are there now, by their last batch."""
        files = self._table("files")
        if files is None:
            return None
        content = F.col("content_hash") if "content_hash" in files.columns else F.lit(None).cast("string")
        last = files.groupBy("path").agg(F.max(F.struct("batch", (~F.col("deleted")).alias("there"), content.alias("content_hash"))).alias("v"))
        return last.where("v.there").select("path", "v.batch", "v.content_hash")

    def changed(self, files: DataFrame) -> DataFrame:
        """Those of files (path, content_hash, ...) that are new or have another content; without hashes, all."""
        now = self.versions()
        if now is None or "content_hash" not in files.columns:
            return files
        return files.join(now.select("path", "content_hash"), ["path", "content_hash"], "left_anti")

    def vanished(self, files: DataFrame) -> DataFrame | None:
        """(path) of files that are there and not in ``files``."""
        now = self.versions()
        return None if now is None else now.select("path").join(files.select("path"), "path", "left_anti")

    def sync(self, files: DataFrame, extract: Callable[[DataFrame], Graph], batch: int) -> None:
        """Make the tables follow a whole project: only files with a new content are extracted, and what is no more in it goes."""
        gone = self.vanished(files)
        self.put(files, gone, extract, batch)

    def put(self, files: DataFrame, gone: DataFrame | None, extract: Callable[[DataFrame], Graph], batch: int) -> None:
        """Append the changed ones of files, each once (the last modified), and marks for what is gone of those that are there.

        The paths are settled before anything is written; if none is left, nothing is.
        """
        if "modified_at" in files.columns:
            rest = [c for c in files.columns if c != "path"]
            files = files.groupBy("path").agg(F.max_by(F.struct(*rest), "modified_at").alias("f")).select("path", "f.*")
        now = self.versions()
        if gone is not None:
            gone = gone.select("path").distinct()
            gone = gone.limit(0) if now is None else cut(gone.join(now.select("path"), "path", "left_semi"))
        todo = cut(self.changed(files.dropDuplicates(["path"])).select("path"))
        if todo.isEmpty() and (gone is None or gone.isEmpty()):
            return
        self.append(extract(files.dropDuplicates(["path"]).join(todo, "path", "left_semi")), batch, gone)

    def read(self, resolve: bool = True) -> Graph | None:
        """The last version of every file; with ``resolve`` references become edges, and edges without both ends are left out."""
        files = self._table("files")
        if files is None:
            return None
        last = self.versions().select("path", "batch")
        own = last.withColumnRenamed("path", "file_path")
        now = lambda df: df.join(own, ["file_path", "batch"], "left_semi").drop("batch")
        nodes, edges, refs = last_nodes(now(self._table("nodes"))), now(self._table("edges")).drop("file_path"), self._table("refs")
        refs = None if refs is None else now(refs)
        files = files.where(~F.col("deleted")).join(last, ["path", "batch"], "left_semi").drop("batch", "deleted").dropDuplicates(["path"])
        if not resolve:
            return Graph(nodes, edges, files, refs)
        if refs is not None:
            edges = edges.unionByName(resolve_references(refs, nodes, files), allowMissingColumns=True)
        return Graph(nodes, sound_edges(Graph(nodes, first_edges(edges), files)), files, refs)

    def compact(self, path: str) -> GraphTables:
        """The last versions alone, as one batch of new tables."""
        out = GraphTables(self.spark, path)
        out.append(self.read(resolve=False), 0)
        return out


def ingest_stream(files: DataFrame, tables: GraphTables, extract: Callable[[DataFrame], Graph], checkpoint: str) -> StreamingQuery:
    """Start a query over a stream of files (path, language, content_hash, content): every batch is extracted and appended.

    Files whose content_hash is that of their last version are passed over. Rows with a true ``deleted``, where the stream has that column, remove their path; in a
    batch that has a path both deleted and with a content, the content stays.
    """

    def put(batch: DataFrame, number: int) -> None:
        gone = None
        if "deleted" in batch.columns:
            dead = F.coalesce("deleted", F.lit(False))
            alive = batch.where(~dead).drop("deleted")
            gone = batch.where(dead).select("path").join(alive.select("path"), "path", "left_anti")
            batch = alive
        tables.put(batch, gone, extract, number)

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
