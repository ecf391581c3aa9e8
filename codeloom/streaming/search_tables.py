"""A search index that follows the files of a graph: postings of new file versions are appended, and those of old versions no longer count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.checkpoints import cut
from codeloom.operators.search import SearchIndex, index_tables
from codeloom.streaming.ingest import read_table, write_batch


class SearchTables:
    """Postings (token, id, tf, dl, file_path), sizes of file versions, and sums, as Parquet with a column ``batch``.

    An update writes what its own files need: their postings, sorted by token, so that a search still reads the pages of its prefixes only; a row with
    the number of nodes and words of each; and one row by which the sums over all files change, from which the corpus numbers
    (n, avgdl) come. Postings of replaced versions stay where they are until ``compact`` and leave a search by an anti-join with the files that were ever
    replaced. A batch that is written again replaces itself.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str) -> DataFrame | None:
        return read_table(self.spark, f"{self.path}/{name}")

    def update(self, nodes: DataFrame, batch: int, gone: DataFrame | None = None) -> None:
        """nodes: of new files and of new versions of files, whole; gone: paths (column path) that are no more, or that have no nodes now.

        Each file is known by its nodes' ``file_path``, and an id belongs to one file.
        """
        index = index_tables(nodes)
        postings = index.postings.join(nodes.select("id", "file_path"), "id")
        write_batch(postings.sortWithinPartitions("token"), f"{self.path}/postings", batch)
        lengths = nodes.select("id", "file_path").join(index.postings.groupBy("id").agg(F.first("dl").alias("dl")), "id", "left")
        new = lengths.groupBy("file_path").agg(F.count("*").alias("n"), F.sum(F.coalesce("dl", F.lit(0))).cast("long").alias("words"))
        if gone is not None:
            lost = gone.select(F.col("path").alias("file_path")).distinct().join(new.select("file_path"), "file_path", "left_anti")
            zero = F.lit(0).cast("long")
            new = new.unionByName(lost.select("file_path", zero.alias("n"), zero.alias("words")))
        new = cut(new)
        known = self._table("sizes")
        known = None if known is None else known.where(F.col("batch") < batch)
        total = new.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
        if known is not None:
            old = known.join(new.select("file_path"), "file_path", "left_semi").groupBy("file_path").agg(F.max_by(F.struct("n", "words"), "batch").alias("s"))
            minus = old.agg(F.coalesce(F.sum("s.n"), F.lit(0)).alias("n0"), F.coalesce(F.sum("s.words"), F.lit(0)).alias("words0"))
            total = total.join(F.broadcast(minus), F.lit(True)).select((F.col("n") - F.col("n0")).alias("n"), (F.col("words") - F.col("words0")).alias("words"))  # one row each
            write_batch(old.select("file_path"), f"{self.path}/replaced", batch)
        write_batch(total, f"{self.path}/sums", batch)
        write_batch(new, f"{self.path}/sizes", batch)  # last: it makes the batch count

    def index(self) -> SearchIndex:
        """The index of all files as they are now."""
        postings, replaced, done = self._table("postings"), self._table("replaced"), self._table("sizes").select("batch").distinct()
        postings = postings.join(F.broadcast(done), "batch", "left_semi")  # as few rows as batches
        if replaced is not None:
            last = replaced.join(F.broadcast(done), "batch", "left_semi").groupBy("file_path").agg(F.max("batch").alias("since"))
            postings = postings.join(last, (postings["file_path"] == last["file_path"]) & (postings["batch"] < last["since"]), "left_anti")
        sums = self._table("sums").join(F.broadcast(done), "batch", "left_semi").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
        average = F.when(F.col("n") > 0, F.col("words") / F.col("n"))
        return SearchIndex(postings.select("token", "id", "tf", "dl"), sums.select("n", average.alias("avgdl")))

    def compact(self, path: str) -> SearchTables:
        """The postings that count, as one batch of new tables."""
        out = SearchTables(self.spark, path)
        live, replaced = self._table("postings"), self._table("replaced")
        if replaced is not None:
            last = replaced.groupBy("file_path").agg(F.max("batch").alias("since"))
            live = live.join(last, (live["file_path"] == last["file_path"]) & (live["batch"] < last["since"]), "left_anti")
        sizes = self._table("sizes").groupBy("file_path").agg(F.max_by(F.struct("n", "words"), "batch").alias("s")).select("file_path", "s.*").where("n > 0")
        write_batch(live.drop("batch").sortWithinPartitions("token"), f"{path}/postings", 0)
        write_batch(sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")), f"{path}/sums", 0)
        write_batch(sizes, f"{path}/sizes", 0)
        return out
