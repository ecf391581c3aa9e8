"""Texts of pages: snippets, chains and hierarchies as lines, prompts, and what a language model (or none) makes of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import number_order, optional, source_block, truncate
from codeloom.operators.search import ask_context, ask_top
from codeloom.plans.context import PageParts
from codeloom.plans.render import cross_links, relationship_summary, symbol_summary
from codeloom.schema import Graph


def in_order(rows: DataFrame, order: str | list[str], text: Column, sep: str = "\n", name: str = "text") -> DataFrame:
    """(number, text): a page's texts in an order."""
    keys = [order] if isinstance(order, str) else order
    lines = rows.groupBy("number").agg(F.array_sort(F.collect_list(F.struct(*keys, text.alias("t")))).alias("x"))
    return lines.select("number", F.array_join(F.transform("x", lambda r: r["t"]), sep).alias(name))


def source_blocks(focal: DataFrame, nodes: DataFrame, contents: DataFrame, first: int = 10) -> DataFrame:
    """(number, pos, id, code) of each page's first symbols, from contents (path, content)."""
    named = focal.where(F.col("pos") < first).join(nodes.select("id", "file_path", "start_line", "end_line"), "id")
    return named.join(contents.select(F.col("path").alias("file_path"), "content"), "file_path").select("number", "pos", "id", source_block("content", F.col("start_line"), F.col("end_line")).alias("code"))


def symbol_lines(focal: DataFrame, g: Graph, first: int = 10) -> DataFrame:
    """(number, text): a page's focal symbols, a line each, and under types their first children."""
    own = focal.join(symbol_summary(g.nodes), "id").select("number", "pos", F.lit(0).alias("k"), "line")
    types = focal.join(g.nodes.where("kind in ('class', 'interface', 'struct')").select("id"), "id", "left_semi")
    inside = g.edges.where("kind = 'contains'").select(F.col("source").alias("id"), F.col("target").alias("child"), "ord")
    label = F.concat(F.lit("  └─ "), "kind", F.lit(" "), F.coalesce(F.substring(optional(g.nodes, "signature"), 1, 60), "name"), F.lit(" ["), F.coalesce(optional(g.nodes, "visibility"), F.lit("")), F.lit("]"))
    child = g.nodes.select(F.col("id").alias("child"), label.alias("line"))
    k = F.row_number().over(Window.partitionBy("number", "pos").orderBy("ord", "child"))
    below = types.join(inside, "id").join(child, "child").withColumn("k", k).where(F.col("k") <= first).select("number", "pos", "k", "line")
    return in_order(own.unionByName(below), ["pos", "k"], F.col("line"))


def key_snippets(blocks: DataFrame, nodes: DataFrame, longer_than: int = 50, first: int = 8, room: int = 1500) -> DataFrame:
    """(number, text): a page's first blocks that are longer than a line, each under its name and place."""
    some = blocks.where(F.length("code") > longer_than)
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("number").orderBy("pos"))).where(F.col("k") <= first)
    n = nodes.select("id", "kind", "name", "file_path", "language", "start_line", "end_line")
    place = F.concat(F.lit("["), "kind", F.lit(": "), "name", F.lit("] "), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    text = F.concat(place, F.lit("\n```"), "language", F.lit("\n"), truncate("code", room, "\n// ... truncated"), F.lit("\n```"))
    lines = some.join(n, "id").groupBy("number").agg(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))).alias("x"))
    return lines.select("number", F.array_join(F.transform("x", lambda r: r["t"]), "\n\n").alias("text"))


def chain_lines(chains: DataFrame, first: int = 10) -> DataFrame:
    """(number, text) from call chains: the first ones, names and places with arrows."""
    return in_order(chains.where(F.col("k") <= first), "k", F.concat(F.lit("- "), F.array_join("places", " → ")))


def hierarchy_section(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(number, text) from page hierarchies: each type with its place, what it extends, and its subtypes."""
    head = F.concat(F.lit("**"), "name", F.lit("** ("), "file_path", F.coalesce(F.concat(F.lit(":"), optional(nodes, "start_line")), F.lit("")), F.lit(")"))
    up = F.when(F.size("ancestors") > 0, F.concat(F.lit("  Extends: "), F.array_join("ancestors", " ← ")))
    down = F.when(F.size("descendants") > 0, F.concat(F.lit("  Subtypes: "), F.array_join("descendants", ", ")))
    named = found.join(nodes.select("id", head.alias("head")), "id")
    return in_order(named, "k", F.array_join(F.array_compact(F.array(F.col("head"), up, down)), "\n"), "\n\n")


def hierarchy_lines(hierarchy: DataFrame, nodes: DataFrame) -> DataFrame:
    """(root, line): what each root extends, and its subtypes, from (root, id, role, depth)."""
    name = nodes.select("id", F.concat("name", F.lit(" ("), "file_path", F.lit(")")).alias("label"), "ord")
    met = hierarchy.join(name, "id").withColumn("down", F.col("role") == "descendant")
    part = F.array_sort(F.collect_list(F.struct((F.col("role") == "implements").alias("late"), "depth", "ord", "label")))
    rows = met.groupBy("root", "down").agg(F.transform(part, lambda x: x["label"]).alias("labels"))
    line = F.when(F.col("down"), F.concat(F.lit("  Subtypes: "), F.array_join("labels", ", "))).otherwise(F.concat(F.lit("  Extends: "), F.array_join("labels", " ← ")))
    both = rows.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("down", line.alias("line")))).alias("x"))
    return both.select("root", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("line"))


def prompt(title: Column | str, description: Column | str, *parts: tuple[str, Column]) -> Column:
    """A page's prompt: its title and description, and parts that are not empty under their headings."""
    pieces = [F.concat(F.lit("# "), title, F.lit("\n\n"), description)]
    pieces += [F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.concat(F.lit(f"## {name}\n\n"), c)) for name, c in parts]
    return F.array_join(F.array_compact(F.array(*pieces)), "\n\n")


def page_prompts(parts: PageParts, first_files: int = 10) -> DataFrame:
    """(number, parent, title, prompt) of every section, from all that belongs to its page."""
    g = parts.g
    place = F.row_number().over(Window.partitionBy("number").orderBy("file_path"))
    files = parts.files.withColumn("k", place).where(F.col("k") <= first_files)
    relation_lines = relationship_summary(parts.relations, g.nodes)
    texts = {
        "files": in_order(files, "k", F.concat(F.lit("- `"), "file_path", F.lit("`"))),
        "symbols": symbol_lines(parts.focal, g),
        "relations": in_order(relation_lines, "kind", F.col("line")),
        "chains": chain_lines(parts.chains),
        "hierarchy": hierarchy_section(parts.hierarchies, g.nodes),
        "links": page_links(parts.sections),
    }
    if parts.blocks is not None:
        texts["snippets"] = key_snippets(parts.blocks, g.nodes)
    out = parts.sections.select("number", "parent", "title", "description")
    for name, df in texts.items():
        out = out.join(df.withColumnRenamed("text", name), "number", "left")
    column = lambda name: F.col(name) if name in texts else F.lit(None).cast("string")
    heading = F.concat("number", F.lit(". "), "title")
    named = (("Relevant Source Files", "files"), ("Symbols", "symbols"), ("Relationships", "relations"), ("Source Snippets", "snippets"), ("Call Chains", "chains"), ("Type Hierarchy", "hierarchy"), ("Other Pages", "links"))
    return out.select("number", "parent", "title", prompt(heading, F.col("description"), *((title, column(name)) for title, name in named)).alias("prompt"))


def page_links(sections: DataFrame) -> DataFrame:
    """(number, text): links to all pages but the page itself, in order of their numbers; a site's pages are as many as its plan has."""
    line = cross_links(sections).withColumn("place", number_order("number"))
    every = line.agg(F.array_sort(F.collect_list(F.struct("place", "number", "line"))).alias("every"))  # one row
    others = F.filter("every", lambda x: x["number"] != F.col("number"))
    return sections.select("number").join(F.broadcast(every), F.lit(True)).select("number", F.array_join(F.transform(others, lambda x: x["line"]), "\n").alias("text"))


def generate(pages: DataFrame, llm: Callable[[str], str] | None = None, prompt_col: str = "prompt") -> DataFrame:
    """(number, content): what a model answers to each page's prompt; without a model, the prompt itself."""
    if llm is None:
        return pages.select("number", F.col(prompt_col).alias("content"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"number": f["number"], "content": [llm(p) for p in f[prompt_col]]})

    return pages.select("number", prompt_col).repartition("number").mapInPandas(run, "number string, content string")


def ask(pages: DataFrame, question: str, llm: Callable[[str, str], str] | None = None) -> tuple[str, list[tuple[str, str]]]:
    """(answer, sources) for a question to a site's pages (filename, title, content); without a model the answer is the context."""
    sources = [(r["filename"], r["title"]) for r in ask_top(pages, question, "filename").select("filename", "title").collect()]
    if not sources:
        return "No page says anything about that.", []
    context = ask_context(pages, question, "filename", "title").head()["context"]
    return (llm(question, context) if llm else context), sources
