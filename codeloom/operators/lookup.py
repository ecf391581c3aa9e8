"""Lookups, first and last wins, replacement of files, and checks of what edges point at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.schema import Graph, GraphError


def nodes_where(g: Graph, id: str | None = None, file: str | None = None, kind: str | None = None, qualified_name: str | None = None) -> DataFrame:
    """Nodes by any of their keys; each condition is pushed to the scan."""
    out = g.nodes
    for name, value in (("id", id), ("file_path", file), ("kind", kind), ("qualified_name", qualified_name)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def edges_from(g: Graph, ids: Sequence[str], kind: str | None = None) -> DataFrame:
    out = g.edges.where(F.col("source").isin(list(ids)))
    return out if kind is None else out.where(F.col("kind") == kind)


def edges_to(g: Graph, ids: Sequence[str], kind: str | None = None) -> DataFrame:
    out = g.edges.where(F.col("target").isin(list(ids)))
    return out if kind is None else out.where(F.col("kind") == kind)


def files_where(g: Graph, path: str | None = None) -> DataFrame:
    """All files, or the one of a path."""
    return g.files if path is None else g.files.where(F.col("path") == path)


def file_records(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """files, one row for each path, with the number of their nodes and the time where they lack these, and no empty lists of errors."""
    out = files.dropDuplicates(["path"])
    if "node_count" not in out.columns:
        n = nodes.groupBy(F.col("file_path").alias("path")).agg(F.count("*").cast("int").alias("node_count"))
        out = out.join(n, "path", "left").withColumn("node_count", F.coalesce("node_count", F.lit(0)))
    if "errors" in out.columns:
        out = out.withColumn("errors", F.when(F.size("errors") > 0, F.col("errors")))
    known = F.col("indexed_at") if "indexed_at" in out.columns else F.lit(None).cast("timestamp")
    return out.withColumn("indexed_at", F.coalesce(known, F.current_timestamp()))


def unresolved_refs(g: Graph, file: str | None = None) -> DataFrame:
    return g.refs if file is None else g.refs.where(F.col("file_path") == file)


def children(g: Graph, parents: DataFrame) -> DataFrame:
    """(parent, id) of what the given nodes (column id) contain; dangling targets are dropped."""
    contains = g.edges.where("kind = 'contains'").select(F.col("source").alias("parent"), F.col("target").alias("id"))
    return contains.join(parents.select(F.col("id").alias("parent")), "parent", "left_semi").join(g.nodes.select("id"), "id", "left_semi").select("parent", "id")


def one_of_each(df: DataFrame, keys: Sequence[str], order: Column, last: bool = False) -> DataFrame:
    """The first row of each key in an order, or the last. As an aggregate it is combined before the shuffle, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg((F.max_by if last else F.min_by)(F.struct(*rest), order).alias("row"))
    return best.select(*keys, "row.*").select(*df.columns)


def first_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, kind), the first that came."""
    return one_of_each(edges, ["source", "target", "kind"], F.col("ord"))


def last_nodes(nodes: DataFrame) -> DataFrame:
    """One node for each id, the last that came."""
    return one_of_each(nodes, ["id"], F.col("ord"), last=True)


def dangling_edges(g: Graph) -> DataFrame:
    """Edges of which an end is no node."""
    ids = g.nodes.select("id")
    lost = [g.edges.join(ids, g.edges[end] == ids["id"], "left_anti") for end in ("source", "target")]
    return lost[0].unionByName(lost[1]).distinct()


def sound_edges(g: Graph) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = g.nodes.select("id")
    return g.edges.join(ids, g.edges["source"] == ids["id"], "left_semi").join(ids, g.edges["target"] == ids["id"], "left_semi")


def replace_files(g: Graph, files: DataFrame, nodes: DataFrame, edges: DataFrame, refs: DataFrame | None = None, drop_dangling: bool = False) -> Graph:
    """Put new versions of files in place of the old ones.

    What the old versions had goes, with all edges from or to their nodes; then last nodes and first edges win. g itself has one node for each id and one
    edge for each (source, target, kind), as all graphs here, so only what is new is looked at for that: new nodes put out old ones
    of the same id, old edges keep out new ones, and no aggregate goes over the whole graph. With ``drop_dangling`` new edges
    without both ends are left out; otherwise they are an error. Old edges lose an end only if it is in a replaced file, and go with it.
    """
    paths = files.select(F.col("path").alias("file_path"))
    gone = g.nodes.join(paths, "file_path", "left_semi").select("id")
    key = ["source", "target", "kind"]
    new_nodes, new_edges = last_nodes(nodes), first_edges(edges)
    kept_nodes = g.nodes.join(paths, "file_path", "left_anti").join(new_nodes.select("id"), "id", "left_anti")
    kept_edges = g.edges.join(gone, g.edges["source"] == gone["id"], "left_anti").join(gone, g.edges["target"] == gone["id"], "left_anti")
    known = kept_edges.select(*key).join(new_edges.select(*key), key, "left_semi")  # as few as new edges
    new_edges = new_edges.join(known, key, "left_anti")
    kept_files = g.files.join(files.select("path"), "path", "left_anti")
    kept_refs = None if g.refs is None else g.refs.join(paths, "file_path", "left_anti")
    if kept_refs is not None and refs is not None:
        kept_refs = kept_refs.unionByName(refs, allowMissingColumns=True)
    all_nodes = kept_nodes.unionByName(new_nodes, allowMissingColumns=True)
    ends = Graph(all_nodes, new_edges, files)
    if drop_dangling:
        new_edges = sound_edges(ends)
    else:
        lost = dangling_edges(ends).head()
        if lost is not None:
            raise GraphError(f"an edge has no node at one end: {lost['source']} -{lost['kind']}-> {lost['target']}")
    all_files = kept_files.unionByName(file_records(files, nodes), allowMissingColumns=True)
    return Graph(all_nodes, kept_edges.unionByName(new_edges, allowMissingColumns=True), all_files, kept_refs)
