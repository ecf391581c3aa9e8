"""Tables of a symbol graph and what their columns may hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_s, _i, _l, _b = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(required: str, optional: str = "", **kinds) -> T.StructType:
    names = [(n, False) for n in required.split()] + [(n, True) for n in optional.split()]
    return T.StructType([T.StructField(n, kinds.get(n, _s), null) for n, null in names])


#: What nodes and edges are ordered by: files by path, then the place in the file; found edges come after those that files hold. Graphs from
#: other sources may have any column ``ord`` that can be ordered.
NODE_ORDER = T.StructType([T.StructField("file", _s), T.StructField("k", _i)])
EDGE_ORDER = T.StructType([T.StructField("late", _i), T.StructField("file", _s), T.StructField("k", _i), T.StructField("col", _i)])

NODES = _struct(
    "id kind name qualified_name file_path language start_line end_line start_column end_column is_exported is_async is_static is_abstract content_hash ord",
    "signature docstring visibility decorators updated_at",
    start_line=_i, end_line=_i, start_column=_i, end_column=_i, is_exported=_b, is_async=_b, is_static=_b, is_abstract=_b, decorators=T.ArrayType(_s), updated_at=T.TimestampType(), ord=NODE_ORDER,
)
EDGES = _struct("source target kind provenance ord", "line col", line=_i, col=_i, ord=EDGE_ORDER)
FILES = _struct("path language content_hash", "size modified_at indexed_at node_count errors", size=_l, modified_at=T.TimestampType(), indexed_at=T.TimestampType(), node_count=_i, errors=T.ArrayType(_s))
REFS = _struct("from_id reference_name reference_kind file_path language", "line col candidates", line=_i, col=_i, candidates=T.ArrayType(_s))

# Names that graphs of this kind use.
NODE_KINDS = "file module class struct interface trait protocol function method property field variable constant enum enum_member type_alias namespace import export route component".split()
EDGE_KINDS = "contains calls imports exports extends implements references type_of returns instantiates overrides decorates".split()
PROVENANCES = "tree-sitter import-resolution scope-resolution heuristic".split()
LANGUAGES = "typescript javascript tsx jsx python go rust java csharp kotlin swift ruby php cpp c unknown".split()


class GraphError(Exception):
    """The graph is not consistent."""


def node_order(path, k) -> Column:
    return F.struct(F.col(path).alias("file"), k.cast("int").alias("k"))


def edge_order(path, k, col=None, late: int = 0) -> Column:
    """late: 0 for edges that a file holds, 1 for found imports, 2 for what is found by name."""
    return F.struct(F.lit(late).alias("late"), F.col(path).alias("file"), k.cast("int").alias("k"), (F.lit(0) if col is None else col).cast("int").alias("col"))


@dataclass(frozen=True)
class Graph:
    """The four tables of a graph."""

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    refs: DataFrame | None = None


def unknown_kinds(g: Graph) -> DataFrame:
    """(what, kind, n) of kinds that are not among the known ones."""
    nodes = g.nodes.where(~g.nodes.kind.isin(NODE_KINDS)).groupBy("kind").count().selectExpr("'node' AS what", "kind", "count AS n")
    edges = g.edges.where(~g.edges.kind.isin(EDGE_KINDS)).groupBy("kind").count().selectExpr("'edge' AS what", "kind", "count AS n")
    return nodes.unionByName(edges)
