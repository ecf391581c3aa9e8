"""Diagrams, summaries, navigation and pages as strings that DataFrames aggregate."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import number_order, optional, page_path, sanitize_id, short_path
from codeloom.operators.aggregates import files_by_directory, most_frequent, stats_row
from codeloom.schema import Graph

CLASS_LIKE = ("class", "interface", "struct", "enum")


def joined(rows: DataFrame, order: list[str], line: str = "line", sep: str = "\n", name: str = "text") -> DataFrame:
    """One row: the lines in an order."""
    return rows.agg(F.array_sort(F.collect_list(F.struct(*order, line))).alias("x")).select(F.array_join(F.transform("x", lambda r: r[line]), sep).alias(name))


def architecture_diagram(files: DataFrame, path: str = "path") -> DataFrame:
    """One row: a graph of directories with their first files."""
    box = F.transform("files", lambda f: F.concat(F.lit("    "), sanitize_id(F.concat(F.col("dir"), F.lit("/"), f)), F.lit('["'), f, F.lit('"]')))
    line = F.concat(F.lit("  subgraph "), sanitize_id("dir"), F.lit('["'), F.col("dir"), F.lit('"]\n'), F.array_join(box, "\n"), F.lit("\n  end"))
    rows = files_by_directory(files, path).select("dir", line.alias("line"))
    return joined(rows, ["dir"]).select(F.concat(F.lit("graph TD\n"), "text", F.lit("\n")).alias("diagram"))


def class_diagram_lines(g: Graph, headers: int = 20) -> DataFrame:
    """(part, ord, line): headers of the first class-like nodes, and relations of all of them."""
    some = g.nodes.where(F.col("kind").isin(*CLASS_LIKE))
    mark = F.when(F.col("kind") == "interface", "<<interface>> ").when(F.col("kind") == "struct", "<<struct>> ").when(F.col("kind") == "enum", "<<enumeration>> ").when(F.col("is_abstract"), "<<abstract>> ")
    head = some.orderBy("ord").limit(headers).select(F.lit(0).alias("part"), "ord", F.concat(F.lit("  class "), sanitize_id("name"), F.lit(" {\n"), F.coalesce(F.concat(F.lit("    "), mark, F.lit("\n")), F.lit("")), F.lit("  }")).alias("line"))
    a, b = some.select(F.col("id").alias("source"), sanitize_id("name").alias("a")), some.select(F.col("id").alias("target"), sanitize_id("name").alias("b"))
    e = g.edges.where("kind in ('extends', 'implements', 'contains')").select("source", "target", "kind", "ord").join(a, "source").join(b, "target")
    line = F.when(F.col("kind") == "extends", F.concat(F.lit("  "), "b", F.lit(" <|-- "), "a")).when(F.col("kind") == "implements", F.concat(F.lit("  "), "b", F.lit(" <|.. "), "a")).otherwise(F.concat(F.lit("  "), "a", F.lit(" *-- "), "b"))
    return head.unionByName(e.select(F.lit(1).alias("part"), "ord", line.alias("line")))


def class_diagram(g: Graph) -> DataFrame:
    return joined(class_diagram_lines(g), ["part", "ord"]).select(F.concat(F.lit("classDiagram\n"), "text", F.lit("\n")).alias("diagram"))


def dependency_diagram(pairs: DataFrame, files: DataFrame, limit: int = 30) -> DataFrame:
    """One row: imports of the first files."""
    first = files.select(F.col("path").alias("src")).orderBy("src").limit(limit)
    rows = pairs.join(F.broadcast(first), "src", "left_semi").join(files.select(F.col("path").alias("dst")), "dst", "left_semi")
    box = lambda c: F.concat(sanitize_id(c), F.lit('["'), short_path(c), F.lit('"]'))
    rows = rows.select("src", "dst", F.concat(F.lit("  "), box("src"), F.lit(" --> "), box("dst")).alias("line"))
    return joined(rows, ["src", "dst"]).select(F.concat(F.lit("graph LR\n"), "text", F.lit("\n")).alias("diagram"))


def relationship_summary(relations: DataFrame, nodes: DataFrame, first: int = 30, per_kind: int = 8) -> DataFrame:
    """(number, kind, line) from (number, source, target, kind): a page's first relations, without containment and imports."""
    some = relations.where("kind not in ('contains', 'imports')")
    k = F.row_number().over(Window.partitionBy("number").orderBy("source", "target", "kind"))
    some = some.withColumn("k", k).where(F.col("k") <= first)
    kk = F.row_number().over(Window.partitionBy("number", "kind").orderBy("k"))
    some = some.withColumn("kk", kk).where(F.col("kk") <= per_kind)
    a, b = nodes.select(F.col("id").alias("source"), F.col("name").alias("a")), nodes.select(F.col("id").alias("target"), F.col("name").alias("b"))
    text = F.concat(F.coalesce("a", "source"), F.lit(" → "), F.coalesce("b", "target"))
    named = some.join(a, "source", "left").join(b, "target", "left").groupBy("number", "kind").agg(F.array_sort(F.collect_list(F.struct("kk", text.alias("t")))).alias("x"))
    return named.select("number", "kind", F.concat("kind", F.lit(": "), F.array_join(F.transform("x", lambda r: r["t"]), ", ")).alias("line"))


def symbol_summary(nodes: DataFrame) -> DataFrame:
    """(id, line): kind, name, signature, place, marks and comment of each node in one line."""
    have = lambda c, kind="string": optional(nodes, c, kind)
    place = F.concat(F.lit("("), "file_path", F.coalesce(F.concat(F.lit(":"), have("start_line")), F.lit("")), F.lit(")"))
    parts = F.array_compact(F.array(
        F.concat("kind", F.lit(" "), "name"), F.concat(F.lit("— "), F.substring(have("signature"), 1, 100)), place,
        F.when(have("is_abstract", "boolean"), "[abstract]"), F.when(have("is_static", "boolean"), "[static]"), F.concat(F.lit("// "), F.substring(have("docstring"), 1, 100)),
    ))
    return nodes.select("id", F.array_join(parts, " ").alias("line"))


def cross_links(sections: DataFrame) -> DataFrame:
    """(number, line): the link to each page that other pages show."""
    link = F.concat(F.when(F.col("parent").isNotNull(), "  - [").otherwise("- ["), "number", F.lit(". "), "title", F.lit("]("), page_path("number", "title"), F.lit(")"))
    return sections.select("number", link.alias("line"))


def page_navigation(pages: DataFrame, group: str, order: str) -> DataFrame:
    """pages (group, order, title, path) with a line of links to the pages before and after each in its group."""
    w = Window.partitionBy(group).orderBy(order)
    link = F.struct(F.col(order).cast("string").alias("n"), "title", "path")
    both = pages.withColumn("before", F.lag(link).over(w)).withColumn("after", F.lead(link).over(w))
    return both.withColumn("nav", F.concat(F.lit("**Navigation:**\n[← Table of Contents](index.md)"), beside("before", "[← {}]"), beside("after", "[{} →]"))).drop("before", "after")


def beside(c: str, form: str):
    """`` | [number. title](path)`` for a neighbour (n, title, path), nothing where there is none."""
    a, z = form.split("{}")
    return F.when(F.col(c).isNotNull(), F.concat(F.lit(" | " + a), F.col(f"{c}.n"), F.lit(". "), F.col(f"{c}.title"), F.lit(z + "("), F.col(f"{c}.path"), F.lit(")"))).otherwise("")


def site_navigation(pages: DataFrame) -> DataFrame:
    """(number, nav) of a site's pages (number, title, path): the pages before and after, and the other subsections of the section."""
    top = F.substring_index("number", ".", 1)
    one = pages.withColumn("site", F.lit(1)).withColumn("place", number_order("number"))
    w = Window.partitionBy("site").orderBy("place")  # as many rows as the plan has sections
    link = F.struct(F.col("number").alias("n"), "title", "path")
    near = one.withColumn("before", F.lag(link).over(w)).withColumn("after", F.lead(link).over(w)).withColumn("top", top)
    below = one.where(F.size("place") == 2).groupBy(top.alias("top")).agg(F.array_sort(F.collect_list(F.struct("place", "number", F.concat(F.lit("\n- ["), "number", F.lit(". "), "title", F.lit("]("), "path", F.lit(")")).alias("line")))).alias("all"))
    met = near.join(below, "top", "left").withColumn("others", F.filter("all", lambda x: x["number"] != F.col("number")))
    also = F.when(F.size("others") > 0, F.concat(F.lit("\n\n**In this section:**"), F.array_join(F.transform("others", lambda x: x["line"]), ""))).otherwise("")
    return met.select("number", F.concat(F.lit("**Navigation:**\n[← Table of Contents](index.md)"), beside("before", "[← {}]"), beside("after", "[{} →]"), also).alias("nav"))


def statistics(g: Graph, kinds: int = 8) -> DataFrame:
    """One row: a graph's counts, languages and most frequent kinds as tables in Markdown."""
    row = lambda name, c: F.concat(F.lit(f"| {name} | "), c.cast("string"), F.lit(" |\n"))
    langs = F.array_join(F.transform(most_frequent("files_by_language"), lambda x: F.concat(x["k"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ")
    first = F.slice(most_frequent("nodes_by_kind"), 1, kinds)
    some = F.concat(F.lit("### Symbol Breakdown\n\n| Kind | Count |\n|------|-------|\n"), F.array_join(F.transform(first, lambda x: F.concat(F.lit("| "), x["k"], F.lit(" | "), x["n"].cast("string"), F.lit(" |\n"))), ""), F.lit("\n"))
    head = F.concat(F.lit("## Project Statistics\n\n| Metric | Count |\n|--------|-------|\n"), row("Source Files", F.col("file_count")), row("Symbols", F.col("node_count")), row("Relationships", F.col("edge_count")), row("Languages", langs), F.lit("\n"))
    return stats_row(g).select(F.concat(head, F.when(F.size(first) > 0, some).otherwise("")).alias("stats"))


def browser_page(title: str) -> str:
    """A page that shows the site's Markdown in a browser; its scripts come from a public network."""
    name, cdn = title.replace("\\", "\\\\").replace("'", "\\'"), "https://cdn.jsdelivr.net/npm"
    scripts = ["docsify@4/lib/docsify.min.js", "docsify@4/lib/plugins/search.min.js", "mermaid@10/dist/mermaid.min.js", "docsify-mermaid@2/dist/docsify-mermaid.js"]
    load = "\n".join(f'<script src="{cdn}/{s}"></script>' for s in scripts)
    settings = f"{{name: '{name}', homepage: 'index.md', loadSidebar: true, subMaxLevel: 3, search: 'auto', auto2top: true}}"
    return (
        f'<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="UTF-8">\n<title>{html.escape(title)}</title>\n<meta name="viewport" content="width=device-width, initial-scale=1.0">\n'
        f'<link rel="stylesheet" href="{cdn}/docsify@4/lib/themes/vue.css">\n</head>\n<body>\n<div id="app"></div>\n<script>window.$docsify = {settings.replace("</", "<" + chr(92) + "/")};</script>\n{load}\n</body>\n</html>\n'
    )


def assemble(sections: DataFrame, pages: DataFrame, title: str, description: str, stats: DataFrame | None = None, generated: str | None = None) -> DataFrame:
    """(path, content) of index, sidebar, browser page and pages, from sections and pages (number, content). stats: one row of text; generated: a date."""
    place = number_order("number")
    s = sections.join(pages.select("number", F.lit(True).alias("there")), "number", "left").withColumn("place", place).withColumn("path", page_path("number", "title"))
    name = F.concat(F.col("number"), F.lit(". "), F.col("title"))
    dent = F.when(F.col("parent").isNotNull(), "  - ").otherwise("- ")
    entry = F.concat(dent, F.when(F.col("there"), F.concat(F.lit("["), name, F.lit("]("), "path", F.lit(")"))).otherwise(name), F.lit(" — "), F.col("description"))
    side = F.concat(dent, F.lit("["), name, F.lit("]"), F.when(F.col("there"), F.concat(F.lit("("), "path", F.lit(")"))).otherwise(""))
    lines = joined(s.select("place", entry.alias("line")), ["place"])
    if stats is not None:
        lines = lines.join(F.broadcast(stats), F.lit(True))  # one row each
    foot = "\n" if generated is None else f"\n\n---\n\n*Generated on {generated}*\n"
    index = lines.select(F.lit("index.md").alias("path"), F.concat(F.lit(f"# {title}\n\n{description}\n\n"), F.col("stats") if stats is not None else F.lit(""), F.lit("## Table of Contents\n\n"), "text", F.lit(foot)).alias("content"))
    bar = joined(s.select("place", side.alias("line")), ["place"]).select(F.lit("_sidebar.md").alias("path"), F.concat(F.lit("- [Home](index.md)\n"), "text", F.lit("\n")).alias("content"))
    shell = sections.sparkSession.range(1).select(F.lit("index.html").alias("path"), F.lit(browser_page(title)).alias("content"))
    there = s.where("there")
    own = there.join(pages, "number").join(site_navigation(there.select("number", "title", "path")), "number")
    own = own.select("path", F.concat(F.lit("# "), name, F.lit("\n\n"), F.col("content"), F.lit("\n\n---\n\n"), "nav").alias("content"))
    return index.unionByName(bar).unionByName(shell).unionByName(own)


def write_site(site: DataFrame, folder: str) -> None:
    """Write (path, content) rows as files, by tasks; the site appears when all are written, in place of an old one."""
    from codeloom.sources.repo import register

    spark = site.sparkSession
    register(spark)
    marker = spark.range(1).select(F.lit(".nojekyll").alias("path"), F.lit("").alias("content"))
    site.select("path", "content").unionByName(marker).write.format("site").mode("overwrite").save(folder)


def read_site(spark, folder: str) -> DataFrame:
    """(filename, title, content) of a folder's Markdown pages; the title is the first heading without its number."""
    raw = spark.read.text(f"{folder}/*.md", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("content"))
    head = F.regexp_replace(F.regexp_extract("content", r"(?m)^#\s+(.+)", 1), r"^\d+\.\s*", "")
    return raw.where("filename <> '_sidebar.md'").select("filename", F.when(head != "", head).otherwise(F.regexp_replace("filename", r"\.md$", "")).alias("title"), "content")
