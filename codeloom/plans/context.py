"""What a page of documentation is written from: its symbols, their members, relations, files, sources, call chains and type hierarchies.

Every function works on all pages at once; a page is known by the ``number`` of its section.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.checkpoints import cut, few
from codeloom.functions.text import optional
from codeloom.operators.graph import callees, callers, type_hierarchy
from codeloom.operators.search import SearchIndex, search_many
from codeloom.schema import Graph
from codeloom.sources.lines import marked_block, with_line_marks

HOLDERS = ("class", "interface", "struct", "enum", "namespace")


def focal_symbols(sections: DataFrame, nodes: DataFrame, index: SearchIndex | None = None, found: int = 15) -> DataFrame:
    """(number, id, pos) of sections' symbols that exist; with an index, sections without any get what a search for their titles and descriptions finds."""
    asked = sections.select("number", F.posexplode("symbol_ids").alias("pos", "id"))
    focal = asked.join(nodes.select("id"), "id", "left_semi").select("number", "id", "pos")
    if index is None:
        return focal
    lost = sections.join(focal.select("number").distinct(), "number", "left_anti").select("number", F.concat_ws(" ", "title", "description").alias("text"))
    return focal.unionByName(search_many(index, lost, found))


def members(focal: DataFrame, g: Graph) -> DataFrame:
    """(number, parent, id, k) of what focal classes and the like contain, without symbols that are focal themselves, in order."""
    holders = focal.join(g.nodes.where(F.col("kind").isin(*HOLDERS)).select("id"), "id", "left_semi").select("number", F.col("id").alias("parent"), "pos")
    inside = g.edges.where("kind = 'contains'").select(F.col("source").alias("parent"), F.col("target").alias("id"), "ord")
    out = holders.join(inside, "parent").join(g.nodes.select("id"), "id", "left_semi").join(focal.select("number", "id"), ["number", "id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("number").orderBy("pos", "ord", "id"))
    return out.select("number", "parent", "id", place.alias("k"))


def relations(symbols: DataFrame, g: Graph) -> DataFrame:
    """Distinct (number, source, target, kind) of edges from and to a page's symbols."""
    e = g.edges.select("source", "target", "kind")
    out = symbols.join(e, symbols["id"] == e["source"]).select("number", "source", "target", "kind")
    into = symbols.join(e, symbols["id"] == e["target"]).select("number", "source", "target", "kind")
    return out.unionByName(into).distinct()


def related_files(symbols: DataFrame, g: Graph, related: DataFrame | None = None) -> DataFrame:
    """Distinct (number, file_path) of a page's symbols and of what they are related to; related: their relations, if these are known."""
    r = relations(symbols, g) if related is None else related
    ends = symbols.select("number", "id").unionByName(r.select("number", F.col("source").alias("id"))).unionByName(r.select("number", F.col("target").alias("id"))).distinct()
    return ends.join(g.nodes.select("id", "file_path"), "id").select("number", "file_path").distinct()


def page_blocks(focal: DataFrame, inside: DataFrame, nodes: DataFrame, contents: DataFrame, first: int = 10, lines: int = 3, limit: int = 30) -> DataFrame:
    """(number, pos, id, code): sources of the first focal symbols, then of those of the first members that are functions of more than ``lines`` lines."""
    place = F.row_number().over(Window.partitionBy("number").orderBy("pos")) - 1
    own = focal.withColumn("pos", place).where(F.col("pos") < first).select("number", "id", "pos")
    some = inside.where(F.col("k") <= first).join(nodes.where("kind in ('method', 'function')").where(F.col("end_line") - F.col("start_line") > lines).select("id"), "id", "left_semi")
    asked = own.unionByName(some.select("number", "id", (F.col("k") + first).alias("pos"))).where(F.col("pos") < limit)
    named = asked.join(nodes.select("id", "file_path", "start_line", "end_line"), "id")
    marked = with_line_marks(contents.select(F.col("path").alias("file_path"), "content").join(named.select("file_path").distinct(), "file_path", "left_semi"))
    return named.join(marked, "file_path").select("number", "pos", "id", marked_block("content", "marks", F.col("start_line"), F.col("end_line")).alias("code"))


def nearest(found: DataFrame, keys: list[str], order: list[str], what: str, most: int, parts: int = 32) -> DataFrame:
    """(keys ..., others): the first ``most`` values of ``what`` for each key, chosen while they are aggregated, so a key with millions of rows is no hot task."""
    row = F.struct(*order, what)
    some = found.groupBy(*keys, F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.slice(F.array_sort(F.collect_list(row)), 1, most).alias("x"))
    every = some.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("x"))), 1, most).alias("x"))
    return every.select(*keys, F.transform("x", lambda r: r[what]).alias("others"))


def call_chains(focal: DataFrame, g: Graph, limit: int = 15, most: int = 1000) -> DataFrame:
    """(number, id, k, direction, path, places): who a focal function calls within three steps, itself first, and who calls it within two, itself last.

    A chain lists symbols by distance, the nearest ``most`` of them; path has their names, places also their files and lines. Symbols are walked
    from in their order, as many for each page as it has chains at most; only pages that then have too few go on to their next symbols. g: its tables are written.
    """
    roots = focal.join(g.nodes.where("kind in ('method', 'function', 'class')").select("id"), "id", "left_semi")
    roots = cut(roots.withColumn("place", F.row_number().over(Window.partitionBy("number").orderBy("pos", "id"))).select("number", "id", "pos", "place"))
    found, upto = None, limit
    some = roots.where(F.col("place") <= upto)
    while True:
        part = cut(chains_of(cut(some), g, most))
        found = part if found is None else found.unionByName(part)
        full = found.groupBy("number").agg(F.count("*").alias("n")).where(F.col("n") >= limit).select("number")
        left = cut(roots.where(F.col("place") > upto).join(full, "number", "left_anti"))
        if left.isEmpty():
            break
        upto *= 8
        some = left.where(F.col("place") <= upto)
    w = Window.partitionBy("number").orderBy("pos", "direction")
    met = found.withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit)
    return met.select("number", "id", "k", "direction", F.transform("x", lambda r: r["name"]).alias("path"), F.transform("x", lambda r: r["place"]).alias("places"))


def chains_of(roots: DataFrame, g: Graph, most: int) -> DataFrame:
    """(number, id, pos, direction, x) of roots (number, id, pos) that call or are called; x: names and places in order."""
    ids = roots.select("id").distinct()
    out = callees(g, ids, 3, True).withColumn("direction", F.lit("callees")).unionByName(callers(g, ids, 2, True).withColumn("direction", F.lit("callers")))
    out = cut(out)
    label = F.concat("name", F.lit(" ("), "file_path", F.coalesce(F.concat(F.lit(":"), optional(g.nodes, "start_line")), F.lit("")), F.lit(")"))
    nodes = g.nodes.select("id", "ord", F.struct("name", label.alias("place")).alias("s"))
    chain = nearest(nodes.join(few(out), "id"), ["root", "direction"], ["depth", "ord"], "s", most)
    met = chain.join(few(roots).withColumnRenamed("id", "root"), "root").join(nodes.join(few(cut(ids)), "id", "left_semi").select(F.col("id").alias("root"), "s"), "root")
    whole = F.when(F.col("direction") == "callees", F.concat(F.array("s"), "others")).otherwise(F.concat(F.reverse("others"), F.array("s")))
    return met.select("number", F.col("root").alias("id"), "pos", "direction", whole.alias("x"))


def page_hierarchies(focal: DataFrame, g: Graph, limit: int = 10) -> DataFrame:
    """(number, id, k, ancestors, descendants) of a page's first focal types that have any, each as labels in order."""
    roots = focal.join(g.nodes.where("kind in ('class', 'interface', 'struct')").select("id"), "id", "left_semi")
    found = type_hierarchy(g, roots.select("id").distinct())
    label = F.concat("name", F.lit(" ("), "file_path", F.lit(")"))
    part = F.struct((F.col("role") == "implements").alias("late"), "depth", "ord", "label")
    rows = found.join(g.nodes.select("id", "ord", label.alias("label")), "id").groupBy("root").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") != "descendant", part))).alias("up"), F.array_sort(F.collect_list(F.when(F.col("role") == "descendant", part))).alias("down")
    )
    w = Window.partitionBy("number").orderBy("pos")
    met = roots.join(rows, roots["id"] == rows["root"]).withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit)
    return met.select("number", "id", "k", F.transform("up", lambda x: x["label"]).alias("ancestors"), F.transform("down", lambda x: x["label"]).alias("descendants"))


class PageParts:
    """The tables that pages are written from, for all sections at once."""

    def __init__(self, g: Graph, sections: DataFrame, contents: DataFrame | None = None, index: SearchIndex | None = None):
        self.g, self.sections = g, sections
        # What several parts read is worked out once.
        self.focal = cut(focal_symbols(sections, g.nodes, index))
        self.members = cut(members(self.focal, g))
        self.symbols = cut(self.focal.select("number", "id").unionByName(self.members.select("number", "id")).distinct())
        self.relations = cut(relations(few(self.symbols), g))
        self.files = related_files(self.symbols, g, self.relations)
        self.chains, self.hierarchies = call_chains(self.focal, g), page_hierarchies(self.focal, g)
        self.blocks = None if contents is None else page_blocks(self.focal, self.members, g.nodes, contents)


def page_contexts(g: Graph, sections: DataFrame, contents: DataFrame | None = None, index: SearchIndex | None = None) -> DataFrame:
    """One row for each section: focal symbols and files in order, and how many members, relations, files, chains and hierarchies it has."""
    p = PageParts(g, sections, contents, index)
    count = lambda df, name: df.groupBy("number").agg(F.count("*").alias(name))
    names = p.focal.join(g.nodes.select("id", "name"), "id").groupBy("number").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("focal"))
    files = p.files.groupBy("number").agg(F.array_sort(F.collect_list("file_path")).alias("related_files"))
    out = sections.select("number", "title", "description").join(names, "number", "left").join(files, "number", "left")
    for df, name in ((p.members, "n_members"), (p.relations, "n_relations"), (p.files, "n_files"), (p.chains, "n_chains"), (p.hierarchies, "n_hierarchies"), (p.blocks, "n_blocks")):
        if df is not None:
            out = out.join(count(df, name), "number", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    nothing = F.array().cast("array<string>")
    return out.withColumns({"focal": F.coalesce("focal", nothing), "related_files": F.coalesce("related_files", nothing)})
