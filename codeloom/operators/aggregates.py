"""Counts, degrees and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import basename, dirname
from codeloom.schema import Graph


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def graph_stats(g: Graph) -> DataFrame:
    """(metric, n): how many nodes, edges, files and unresolved references there are."""
    parts = {"nodes": g.nodes, "edges": g.edges, "files": g.files} | ({"refs": g.refs} if g.refs is not None else {})
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n") for name, df in parts.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def counts_in_order(df: DataFrame, column: str, first: int | None = None) -> DataFrame:
    """(column, n), the most frequent value first and equal counts by value; with ``first`` so many rows."""
    out = count_by(df, column).orderBy(F.desc("n"), column)
    return out if first is None else out.limit(first)


def stats_row(g: Graph) -> DataFrame:
    """One row: totals, maps of counts by kind and by language, and the time."""
    def counted(df: DataFrame, column: str, total: str, name: str) -> DataFrame:
        by = count_by(df, column)
        return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(total), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(column, F.lit("")).alias("k"), "n")))).alias(name))

    out = counted(g.nodes, "kind", "node_count", "nodes_by_kind")
    parts = [counted(g.edges, "kind", "edge_count", "edges_by_kind"), counted(g.files, "language", "file_count", "files_by_language")]
    parts.append(g.refs.agg(F.count("*").alias("unresolved_count")) if g.refs is not None else g.nodes.sparkSession.range(1).select(F.lit(0).cast("long").alias("unresolved_count")))
    for p in parts:
        out = out.join(F.broadcast(p), F.lit(True))  # one row each
    return out.withColumn("updated_at", F.current_timestamp())


def most_frequent(counts: str):
    """The entries (neg, k, n) of a map of counts, the largest first and equal ones by key."""
    return F.array_sort(F.transform(F.map_entries(counts), lambda x: F.struct((-x["value"]).alias("neg"), x["key"].alias("k"), x["value"].alias("n"))))


def status_lines(g: Graph) -> DataFrame:
    """(part, k, line): totals, then kinds of nodes, kinds of edges and languages, the most frequent first."""
    totals = graph_stats(g).select(F.lit(0).alias("part"), F.array_position(F.lit(["files", "nodes", "edges", "refs"]), F.col("metric")).cast("long").alias("k"), F.concat("metric", F.lit(": "), F.col("n").cast("string")).alias("line"))
    for part, (df, column) in enumerate(((g.nodes, "kind"), (g.edges, "kind"), (g.files, "language")), 1):
        by = count_by(df, column)
        rank = F.row_number().over(Window.orderBy(F.desc("n"), column)).cast("long")  # as many rows as there are kinds
        totals = totals.unionByName(by.select(F.lit(part).alias("part"), rank.alias("k"), F.concat(F.lit("  "), column, F.lit(": "), F.col("n").cast("string")).alias("line")))
    return totals


def result_lines(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, score, line): how a search shows its hits: kind, name and place, then signature and the beginning of the comment."""
    have = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("string")
    first = F.concat(F.rpad("kind", F.greatest(F.length("kind"), F.lit(12)), F.lit(" ")), F.lit(" "), "qualified_name", F.lit("  ["), "file_path", F.lit(":"), F.coalesce(have("start_line").cast("string"), F.lit("")), F.lit("]"))
    dent = " " * 13
    parts = F.array_compact(F.array(first, F.concat(F.lit(dent), have("signature")), F.concat(F.lit(dent), F.substring(have("docstring"), 1, 100))))
    return hits.join(nodes, "id").select("id", "score", F.array_join(parts, "\n").alias("line"))


def structure_totals(sections: DataFrame) -> DataFrame:
    """One row: sections, subsections and pages of a plan."""
    return sections.agg(F.count_if(F.col("parent").isNull()).alias("sections"), F.count_if(F.col("parent").isNotNull()).alias("subsections"), F.count("*").alias("pages"))


def node_degrees(g: Graph) -> DataFrame:
    """(id, in_degree, out_degree, fan_in, fan_out) of every node; fans count different callers and callees, not itself.

    A graph has one edge for each (source, target, kind), so fans are sums. Nodes and both ends of each edge are rows of one aggregate, which
    is combined before the shuffle.
    """
    e = g.edges.select("source", "target", ((F.col("kind") == "calls") & (F.col("source") != F.col("target"))).cast("long").alias("call"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    ends = F.array(
        F.struct(F.col("target").alias("id"), one.alias("in_degree"), zero.alias("out_degree"), F.col("call").alias("fan_in"), zero.alias("fan_out")),
        F.struct(F.col("source").alias("id"), zero.alias("in_degree"), one.alias("out_degree"), zero.alias("fan_in"), F.col("call").alias("fan_out")),
    )
    rows = e.select(F.inline(ends)).withColumn("node", F.lit(False))
    nodes = g.nodes.select("id", *(zero.alias(c) for c in ("in_degree", "out_degree", "fan_in", "fan_out")), F.lit(True).alias("node"))
    names = ("in_degree", "out_degree", "fan_in", "fan_out")
    return nodes.unionByName(rows).groupBy("id").agg(F.bool_or("node").alias("node"), *(F.sum(c).alias(c) for c in names)).where("node").select("id", *names)


def directory_counts(paths: DataFrame, path: str = "path") -> DataFrame:
    """(dir, n_files): each file counts in all directories above it."""
    parts = F.split(path, "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return paths.where(F.col(path).contains("/")).select(F.explode(dirs).alias("dir")).groupBy("dir").agg(F.count("*").alias("n_files"))


def directory_tree(paths: DataFrame, path: str = "path", limit: int = 40) -> DataFrame:
    """The first directories in order of their paths, as indented lines."""
    top = directory_counts(paths, path).orderBy("dir").limit(limit)
    depth = F.size(F.split("dir", "/")) - 1
    return top.select("dir", "n_files", F.concat(F.repeat(F.lit("  "), depth), basename("dir"), F.lit("/ ("), F.col("n_files").cast("string"), F.lit(" files)")).alias("line"))


def top_directories(paths: DataFrame, path: str = "path", limit: int = 9) -> DataFrame:
    """(dir, n_files) of the largest groups by the first two parts of the path."""
    p = F.col(path)
    two = F.when(p.contains("/"), F.substring_index(p, "/", 2)).otherwise(F.lit("."))
    return paths.groupBy(two.alias("dir")).agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "dir").limit(limit)


def files_by_directory(paths: DataFrame, path: str = "path", per_dir: int = 10) -> DataFrame:
    """(dir, files): the first files of each directory by name."""
    d = dirname(path)
    rows = paths.select(F.when(d == "", "root").otherwise(d).alias("dir"), basename(path).alias("file"))
    best = rows.withColumn("k", F.row_number().over(Window.partitionBy("dir").orderBy("file"))).where(F.col("k") <= per_dir)
    return best.groupBy("dir").agg(F.array_sort(F.collect_list("file")).alias("files"))


def status_counts(jobs: DataFrame, status: str = "status", pages: str = "pages") -> DataFrame:
    """One row: how many jobs are ready, failed and in between, and their pages."""
    s = F.col(status)
    return jobs.agg(F.count_if(s == "ready").alias("ready"), F.count_if(s == "failed").alias("failed"), F.count_if(~s.isin("ready", "failed")).alias("active"), F.coalesce(F.sum(pages), F.lit(0)).cast("long").alias("pages"))
