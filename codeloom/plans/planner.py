"""The structure of a documentation site without a language model, and what belongs to its sections."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import optional
from codeloom.operators.aggregates import directory_tree, most_frequent, stats_row, top_directories
from codeloom.plans.render import joined
from codeloom.schema import Graph

# Titles and descriptions of the sections of every site without a model's plan.
OVERVIEW = ("1", "Architecture Overview", "High-level system architecture, project structure, and technology stack.")
OVERVIEW_PARTS = (("1.1", "Project Structure", "Directory organization and module boundaries."), ("1.2", "Architecture Patterns", "Design patterns and architectural decisions used in the codebase."))
LAST = ("Development & Configuration", "Build configuration, deployment settings, and development workflow.")
ROOT, CLASSES, INTERFACES, COMPONENTS = "Root Module", "Classes & Services", "Interfaces & Contracts", "Key Components"
OF_DIR, OF_CLASSES, OF_INTERFACES, OF_COMPONENTS = "Components and services in ", "Core classes in ", "Interfaces defined in ", "Main components: "
TITLE = "Project Documentation"
TOP_KINDS = ("class", "interface", "function", "namespace", "enum")


def top_symbols(g: Graph, limit: int = 200) -> DataFrame:
    """Exported symbols and namespaces, kind by kind, in node order."""
    place = F.array_position(F.lit(list(TOP_KINDS)), F.col("kind"))
    some = g.nodes.where(F.col("kind").isin(*TOP_KINDS) & (F.col("is_exported") | (F.col("kind") == "namespace")))
    return some.select("id", "kind", "name", "file_path", "ord", place.alias("kind_place")).orderBy("kind_place", "ord").limit(limit)


def relevant_symbols(symbols: DataFrame, sections: DataFrame, limit: int = 15) -> DataFrame:
    """(number, id, k): for each section (number, text) the first symbols whose name, or a long part of it, occurs in the text.

    Symbols are at most as many as ``top_symbols`` gives, and sections as a plan has.
    """
    words = lambda c, longer: F.filter(F.split(c, r"\W+"), lambda w: F.length(w) > longer)
    named = symbols.select("kind_place", "ord", "id", F.lower("name").alias("name"), words(F.lower(F.regexp_replace("name", "([A-Z])", " $1")), 3).alias("parts"))
    every = named.agg(F.array_sort(F.collect_list(F.struct("kind_place", "ord", "id", "name", "parts"))).alias("every"))  # one row
    texts = sections.select("number", F.lower("text").alias("low"), words(F.lower("text"), 2).alias("words")).join(F.broadcast(every), F.lit(True))
    occurs = lambda s: F.contains(F.col("low"), s["name"]) | F.exists(s["parts"], lambda p: F.exists("words", lambda w: F.contains(w, p)))
    found = texts.select("number", F.posexplode(F.slice(F.filter("every", occurs), 1, limit)).alias("k", "s"))
    return found.select("number", F.col("s.id").alias("id"), (F.col("k") + 1).cast("long").alias("k"))


def assign_symbol_ids(sections: DataFrame, symbols: DataFrame) -> DataFrame:
    """sections in which those without symbols have the ones that their titles and descriptions speak of."""
    text = F.concat("title", F.lit(" "), "description")
    found = relevant_symbols(symbols, sections.where(F.size("symbol_ids") == 0).select("number", text.alias("text")))
    ids = found.groupBy("number").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("found"))
    own = F.when(F.size("symbol_ids") > 0, F.col("symbol_ids")).otherwise(F.coalesce("found", F.array().cast("array<string>")))
    return sections.join(ids, "number", "left").withColumn("symbol_ids", own).drop("found")


def fallback_plan(g: Graph) -> DataFrame:
    """(number, parent, title, description, symbol_ids) of all sections and subsections.

    The largest directories make sections, with their classes and interfaces (or else any symbols) below.
    """
    spark = g.nodes.sparkSession
    symbols = top_symbols(g)
    first = symbols.where("kind in ('namespace', 'class')").orderBy("kind_place", "ord").limit(15).agg(F.array_sort(F.collect_list(F.struct("kind_place", "ord", "id"))).alias("s"))
    head = first.select(*(F.lit(x).alias(n) for n, x in zip(("number", "title", "description"), OVERVIEW, strict=True)), F.lit(None).cast("string").alias("parent"), F.transform("s", lambda x: x["id"]).alias("symbol_ids"))
    nothing = F.array().cast("array<string>")
    fixed = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(a).alias("number"), F.lit(b).alias("title"), F.lit(c).alias("description")) for a, b, c in OVERVIEW_PARTS))).alias("x")).select("x.*", F.lit("1").alias("parent"), nothing.alias("symbol_ids"))
    dirs = top_directories(g.files).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_files"), "dir")) + 1)  # nine rows
    own = F.broadcast(dirs).join(symbols, F.startswith("file_path", F.col("dir")), "left")
    rank = F.row_number().over(Window.partitionBy("place").orderBy("kind_place", "ord"))
    in_kind = F.row_number().over(Window.partitionBy("place", "kind").orderBy("kind_place", "ord"))
    own = own.withColumn("k", rank).withColumn("kk", in_kind)

    def ids(condition):
        return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("k", "id")))), lambda x: x["id"])

    def names(condition):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("k", "name")))), lambda x: x["name"]), ", ")

    is_class, is_interface, there = F.col("kind") == "class", F.col("kind") == "interface", F.col("id").isNotNull()
    per = own.groupBy("place", "dir", "n_files").agg(
        ids(there & (F.col("k") <= 15)).alias("all_ids"), ids(there & (F.col("k") <= 10)).alias("any_ids"), names(there & (F.col("k") <= 5)).alias("any_names"),
        ids(is_class & (F.col("kk") <= 10)).alias("class_ids"), names(is_class & (F.col("kk") <= 5)).alias("class_names"),
        ids(is_interface & (F.col("kk") <= 10)).alias("interface_ids"), names(is_interface & (F.col("kk") <= 5)).alias("interface_names"),
    )
    number = F.col("place").cast("string")
    title = F.when(F.col("dir") == ".", ROOT).otherwise(F.substring_index("dir", "/", -1))
    sections = per.select(number.alias("number"), F.lit(None).cast("string").alias("parent"), title.alias("title"), F.concat(F.lit(OF_DIR), F.col("dir"), F.lit(" ("), F.col("n_files").cast("string"), F.lit(" files)")).alias("description"), F.col("all_ids").alias("symbol_ids"))
    has_class, has_interface = F.size("class_ids") > 0, F.size("interface_ids") > 0
    below = F.array(
        F.when(has_class, F.struct(F.concat(number, F.lit(".1")).alias("number"), F.lit(CLASSES).alias("title"), F.concat(F.lit(OF_CLASSES), F.col("dir"), F.lit(": "), F.col("class_names")).alias("description"), F.col("class_ids").alias("symbol_ids"))),
        F.when(has_interface, F.struct(F.concat(number, F.when(has_class, ".2").otherwise(".1")).alias("number"), F.lit(INTERFACES).alias("title"), F.concat(F.lit(OF_INTERFACES), F.col("dir"), F.lit(": "), F.col("interface_names")).alias("description"), F.col("interface_ids").alias("symbol_ids"))),
        F.when(~has_class & ~has_interface & (F.size("any_ids") > 0), F.struct(F.concat(number, F.lit(".1")).alias("number"), F.lit(COMPONENTS).alias("title"), F.concat(F.lit(OF_COMPONENTS), F.col("any_names")).alias("description"), F.col("any_ids").alias("symbol_ids"))),
    )
    subsections = per.select(number.alias("parent"), F.explode(F.array_compact(below)).alias("x")).select("x.*", "parent")
    last = dirs.agg((F.coalesce(F.max("place"), F.lit(1)) + 1).cast("string").alias("number")).select("number", F.lit(None).cast("string").alias("parent"), F.lit(LAST[0]).alias("title"), F.lit(LAST[1]).alias("description"), nothing.alias("symbol_ids"))
    out = head
    for x in (fixed, sections, subsections, last):
        out = out.unionByName(x)
    return out.select("number", "parent", "title", "description", "symbol_ids")


def inheritance_summary(g: Graph, limit: int = 50) -> DataFrame:
    """(id, line) of the first classes and interfaces that extend or implement something."""
    some = top_symbols(g).where("kind in ('class', 'interface')").orderBy("kind_place", "ord").limit(limit)
    up = g.edges.where("kind in ('extends', 'implements')").select("source", "target", F.col("kind").alias("how"), F.col("ord").alias("edge_ord"))
    target = g.nodes.select(F.col("id").alias("target"), F.col("name").alias("target_name"))
    part = F.struct((F.col("how") == "implements").alias("late"), "edge_ord", F.concat("how", F.lit(" "), "target_name").alias("text"))
    lines = some.join(up, some["id"] == up["source"]).join(target, "target").groupBy("id", "name").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return lines.select("id", F.concat(F.lit("- "), "name", F.lit(" "), F.array_join(F.transform("parts", lambda p: p["text"]), ", ")).alias("line"))


def plan_prompt(g: Graph) -> DataFrame:
    """One row: what a model plans a site from: counts, directories, first symbols and files, and who extends whom."""
    first = F.substring
    doc = lambda c, n, mark: F.coalesce(F.concat(F.lit(mark), first(optional(g.nodes, c), 1, n)), F.lit(""))
    top = top_symbols(g).select("id", "kind_place", "ord")
    symbols = top.join(g.nodes.drop("ord"), "id").select("kind_place", "ord", F.concat(F.lit("- "), "kind", F.lit(": "), "qualified_name", doc("docstring", 80, " — "), doc("signature", 60, " | sig: ")).alias("line"))
    size = F.coalesce(optional(g.files, "node_count"), F.lit("0"))
    files = g.files.select("path", F.concat(F.lit("- "), "path", F.lit(" ("), "language", F.lit(", "), size, F.lit(" symbols)")).alias("line")).orderBy("path").limit(80)
    s = stats_row(g)
    listed = lambda m, form: F.array_join(F.transform(most_frequent(m), form), ", ")
    head = F.concat(
        F.lit("- "), F.col("file_count").cast("string"), F.lit(" files, "), F.col("node_count").cast("string"), F.lit(" symbols, "), F.col("edge_count").cast("string"), F.lit(" relationships\n- Languages: "),
        listed("files_by_language", lambda x: F.concat(x["k"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), F.lit("\n- Symbols: "), listed("nodes_by_kind", lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["k"], F.lit("s"))),
    )
    out = s.select(head.alias("head"))
    for name, rows, order in (("dirs", directory_tree(g.files), ["dir"]), ("symbols", symbols, ["kind_place", "ord"]), ("files", files, ["path"]), ("above", inheritance_summary(g).withColumn("place", F.col("line")), ["place"])):
        out = out.join(F.broadcast(joined(rows, order, name=name)), F.lit(True))  # one row each
    none = lambda c, text: F.when(F.length(c) > 0, F.col(c)).otherwise(F.lit(text))
    parts = [F.concat(F.lit("## Codebase\n"), "head"), F.concat(F.lit("## Directories\n"), "dirs"), F.concat(F.lit("## Key symbols\n"), "symbols"), F.concat(F.lit("## Files\n"), "files"), F.concat(F.lit("## Inheritance\n"), none("above", "(none)"))]
    return out.select(F.concat_ws("\n\n", *parts).alias("prompt"))


@dataclass(frozen=True)
class SitePlan:
    title: str
    description: str
    sections: DataFrame


def fallback_description(g: Graph) -> str:
    r = stats_row(g).select("file_count", "node_count", F.transform(most_frequent("files_by_language"), lambda x: F.concat(x["k"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))).alias("langs")).head()
    return f"Auto-generated documentation covering {r.file_count} files with {r.node_count} symbols across {', '.join(r.langs)}."


def read_plan(said: str) -> tuple[str, str, list[tuple]] | None:
    """(title, description, rows) of a model's JSON, with or without fences and text around it; None if it has fewer than three sections."""
    text = re.sub(r"```(?:json)?\n?", "", said)
    found = re.search(r"\{.*\}", text, re.S)
    try:
        top = json.loads(found[0]) if found else {}
        sections = [s for s in top.get("sections") or [] if isinstance(s, dict)]
    except (ValueError, AttributeError, TypeError):
        return None
    if len(sections) < 3:
        return None

    def row(s: dict, k: str, parent: str | None) -> tuple:
        return (str(s.get("number") or k), parent, str(s.get("title") or ""), str(s.get("description") or ""), [str(i) for i in s.get("relevantSymbolIds") or []])

    rows = []
    for k, s in enumerate(sections, 1):
        own = row(s, str(k), None)
        rows.append(own)
        rows += [row(x, f"{own[0]}.{j}", own[0]) for j, x in enumerate((x for x in s.get("subsections") or [] if isinstance(x, dict)), 1)]
    return str(top.get("title") or TITLE), str(top.get("description") or ""), rows


def site_plan(g: Graph, llm: Callable[[str, str], str] | None = None) -> SitePlan:
    """The model's structure if it gives one of three sections at least, and the fallback otherwise. llm: from instructions and prompt to text."""
    found = None
    if llm is not None:
        order = 'Plan a documentation site of 8 to 12 sections by topic, with 2 to 4 subsections each. Answer with JSON alone: {"title", "description", "sections": [{"number", "title", "description", "relevantSymbolIds", "subsections"}]}.'
        found = read_plan(llm(order, plan_prompt(g).head()["prompt"]))
    if found is None:
        return SitePlan(TITLE, fallback_description(g), fallback_plan(g))
    sections = g.nodes.sparkSession.createDataFrame(found[2], "number string, parent string, title string, description string, symbol_ids array<string>")
    return SitePlan(found[0], found[1], assign_symbol_ids(sections, top_symbols(g)))


def plan(g: Graph, llm: Callable[[str, str], str] | None = None) -> DataFrame:
    """The sections of ``site_plan``."""
    return fallback_plan(g) if llm is None else site_plan(g, llm).sections
