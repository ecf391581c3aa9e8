"""Functions, plans, rendering, sources and streaming."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators import aggregates
from codeloom.plans import context, planner, render
from codeloom.schema import Graph
from codeloom.sources.ignore import ignore_predicate


def value(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


@pytest.mark.parametrize(("n", "title", "want"), [("1", "Architecture Overview", "1-architecture-overview.md"), ("2.1", "Auth Service", "2.1-auth-service.md"), ("3", "  ¡Hola!  ", "3-hola.md")])
def test_slugs(spark, n, title, want):
    assert value(spark, tx.page_path(F.lit(n), F.lit(title))) == want


def test_text_functions(spark):
    assert value(spark, tx.detect_language(F.lit("a/b.C.TSX"))) == "tsx"
    assert value(spark, tx.detect_language(F.lit("Makefile"))) == "unknown"
    assert value(spark, tx.fold_path(F.lit("a/./b/../../../c"))) == "c"
    assert value(spark, tx.dotted_tail(F.lit("a.b.c"))) == "c"
    assert value(spark, tx.repo_slug(F.lit("https://dev.example.com/Org/_git/My Repo.git"))) == "org-my-repo"
    assert value(spark, tx.short_path(F.lit("a/b/c"))) == ".../b/c"
    assert value(spark, tx.source_block(F.lit("1\n2\n3"), F.lit(2), F.lit(9))) == "2\n3"
    assert value(spark, tx.source_block(F.lit("x" * 4000), F.lit(1), F.lit(1))) == "x" * 3000 + "\n// ... truncated"
    assert value(spark, tx.occurrences(F.lit("aaaa"), "aa")) == 2
    import hashlib

    assert value(spark, tx.make_id(F.lit("a.ts"), F.lit("a.ts.Foo"))) == hashlib.sha256(b"a.ts::a.ts.Foo").hexdigest()[:16]


def test_ignore(spark):
    paths = {"node_modules/a.js": True, "src/node_modules/b": True, "a.min.js": True, "src/app.ts": False, "x/test/y.ts": True, "docs/a/b.md": True, "Debug/x": True, "debug/x": True, "src/keep.log": False, "src/a.log": True, "lib/v1.2/x": True}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = df.select("path", ignore_predicate("path", ["**/test", "docs/*", "[Dd]ebug", "*.log", "!keep.log", "v1.?"]).alias("x")).collect()
    assert {r.path: r.x for r in got} == paths


def test_directories(spark):
    df = spark.createDataFrame([("src/a/x.ts",), ("src/a/y.ts",), ("src/b.ts",), ("c.ts",)], "path string")
    assert [r.line for r in aggregates.directory_tree(df).orderBy("dir").collect()] == ["src/ (3 files)", "  a/ (2 files)"]
    assert {r.dir: r.n_files for r in aggregates.top_directories(df).collect()} == {"src/a": 2, "src/b.ts": 1, ".": 1}
    assert "subgraph root" in render.architecture_diagram(df).head().diagram


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame(
        [("f", "file", "src/a.ts", "src/a.ts", False, 0), ("c", "class", "UserService", "src/a.ts", True, 1), ("b", "class", "Base", "src/a.ts", True, 2), ("m", "method", "load", "src/a.ts", False, 3), ("h", "function", "helper", "src/b.ts", True, 4)],
        "id string, kind string, name string, file_path string, is_exported boolean, ord long",
    ).selectExpr("*", "concat(file_path, '.', name) AS qualified_name", "false AS is_abstract", "false AS is_static", "1 AS start_line", "cast(null as string) AS signature", "name AS docstring")
    edges = spark.createDataFrame([("f", "c", "contains", 0), ("c", "m", "contains", 1), ("c", "b", "extends", 2), ("m", "h", "calls", 3)], "source string, target string, kind string, ord long")
    files = spark.createDataFrame([("src/a.ts", "typescript"), ("src/b.ts", "typescript")], "path string, language string")
    return Graph(nodes, edges, files)


def test_context(spark, g):
    sections = spark.createDataFrame([("1", "User Service", "x", ["c", "nope"]), ("2", "None", "y", ["nope"])], "number string, title string, description string, symbol_ids array<string>")
    rows = {r.number: r for r in context.page_contexts(g, sections).collect()}
    assert rows["1"].focal == ["UserService"] and rows["1"].n_members == 1 and rows["1"].n_files == 2
    assert rows["2"].focal == [] and rows["2"].n_relations == 0


def test_plan_and_site(spark, g, tmp_path):
    plan = planner.plan(g)
    numbers = [r.number for r in plan.collect()]
    assert numbers[:3] == ["1", "1.1", "1.2"] and len(numbers) == len(set(numbers))
    said = '```json\n{"sections": [{"number": 1, "title": "A"}, {"number": 2, "title": "B"}, {"number": 3, "title": "C", "subsections": [{"number": "3.1", "title": "D"}]}]}\n```'
    assert planner.plan(g, lambda a, b: said).count() == 4
    assert planner.plan(g, lambda a, b: "no json").count() == len(numbers)
    top = planner.top_symbols(g)
    assert [(r.number, r.id) for r in planner.relevant_symbols(top, spark.createDataFrame([("7", "the user services")], "number string, text string")).collect()] == [("7", "c")]
    assert [r.line for r in planner.inheritance_summary(g).collect()] == ["- UserService extends Base"]
    pages = spark.createDataFrame([("1", "text")], "number string, content string")
    render.write_site(render.assemble(plan, pages, "T", "D"), str(tmp_path / "site"))
    assert sorted(os.listdir(tmp_path / "site")) == [".nojekyll", "1-architecture-overview.md", "_sidebar.md", "index.html", "index.md"]
    assert {r.filename: r.title for r in render.read_site(spark, str(tmp_path / "site")).collect()} == {"index.md": "T", "1-architecture-overview.md": "Architecture Overview"}
    assert "Base <|-- UserService" in render.class_diagram(g).head().diagram
    assert render.symbol_summary(g.nodes).where("id = 'c'").head().line == "class UserService (src/a.ts:1) // UserService"


def test_plan_of_a_model(spark, g):
    said = 'Here:\n```json\n{"title": "T", "sections": [{"title": "User Service", "relevantSymbolIds": []}, {"number": 2, "title": "B", "relevantSymbolIds": ["h", 7]}, {"number": "3", "title": "C", "description": null, "subsections": [{"title": "Base"}, "x"]}]}\n```'
    seen = []
    plan = planner.site_plan(g, lambda order, prompt: seen.append(prompt) or said)
    rows = {r.number: r for r in plan.sections.collect()}
    assert plan.title == "T" and sorted(rows) == ["1", "2", "3", "3.1"] and rows["3.1"].parent == "3" and rows["3"].description == ""
    assert rows["1"].symbol_ids == ["c"] and rows["2"].symbol_ids == ["h", "7"] and rows["3.1"].symbol_ids == ["b"]
    assert "2 files, " in seen[0] and "- class: src/a.ts.UserService — UserService" in seen[0] and "- UserService extends Base" in seen[0] and "src/ (2 files)" in seen[0]
    for bad in ("", "{", '{"sections": []}', "[1]", '{"sections": [1, 2, 3]}', "null"):
        assert planner.read_plan(bad) is None
    assert aggregates.structure_totals(plan.sections).head().asDict() == {"sections": 3, "subsections": 1, "pages": 4}


def test_site(spark, g, tmp_path):
    from codeloom.plans.site import generate_site

    source = "class UserService {\n" + "  a b c\n" * 20 + "}"
    contents = spark.createDataFrame([("src/a.ts", source)], "path string, content string")
    wide = Graph(g.nodes.withColumn("end_line", F.lit(9)).withColumn("visibility", F.lit("public")).withColumn("language", F.lit("typescript")), g.edges, g.files)
    plan, site = generate_site(wide, str(tmp_path), contents, page_llm=lambda p: "ANSWER " + p)
    files = sorted(os.listdir(tmp_path))
    assert {"index.md", "index.html", "_sidebar.md", ".nojekyll", "1-architecture-overview.md"} <= set(files) and len(files) == plan.sections.count() + 4
    page = (tmp_path / "1-architecture-overview.md").read_text()
    assert page.startswith("# 1. Architecture Overview\n\nANSWER # 1. Architecture Overview\n\nHigh-level")
    for part in ("## Relevant Source Files\n\n- `src/a.ts`", "class UserService", "  └─ method load [public]", "extends: UserService → Base", "[class: UserService] src/a.ts:1-9\n```typescript", "**UserService** (src/a.ts:1)\n  Extends: Base (src/a.ts)", "**Base** (src/a.ts:1)\n  Subtypes: UserService", "  - [1.1. Project Structure](1.1-project-structure.md)", "**In this section:**\n- [1.1."):
        assert part in page, part
    assert "- [1. Architecture Overview](1-architecture-overview.md)" not in page
    index = (tmp_path / "index.md").read_text()
    assert "| Source Files | 2 |" in index and "| Languages | typescript (2) |" in index and "| class | 2 |" in index and "covering 2 files" in index and "*Generated on 20" in index
    assert "homepage: 'index.md'" in (tmp_path / "index.html").read_text() and "It\\'s" in render.browser_page("It's")


def test_chains_and_search(spark, g):
    sections = spark.createDataFrame([("1", "x", "y", ["m"]), ("2", "helper", "of users", [])], "number string, title string, description string, symbol_ids array<string>")
    from codeloom.operators import search

    p = context.PageParts(g, sections, index=search.write_index(g.nodes))
    assert [(r.direction, r.path, r.places) for r in p.chains.where("number = '1'").collect()] == [("callees", ["load", "helper"], ["load (src/a.ts:1)", "helper (src/b.ts:1)"])]
    assert [(r.direction, r.path) for r in p.chains.where("number = '2'").collect()] == [("callers", ["load", "helper"])]
    assert "h" in {r.id for r in p.focal.where("number = '2'").collect()}
    hits = search.search_nodes(g.nodes, "help user", limit=5)
    assert {r.id for r in hits.collect()} == {"h", "c"}
    assert search.search_nodes(g.nodes, "help user", kinds=["class"]).head().id == "c"
    lines = {r.id: r.line for r in aggregates.result_lines(hits, g.nodes).collect()}
    assert lines["h"].startswith("function     ") and "[src/b.ts:1]" in lines["h"]
    row = aggregates.stats_row(g).head()
    assert row.node_count == g.nodes.count() and row.files_by_language == {"typescript": 2} and row.updated_at is not None
    assert [r.line for r in aggregates.status_lines(g).where("part = 1").orderBy("k").limit(1).collect()] == ["  class: 2"]


def test_scan(spark, tmp_path):
    from codeloom.sources.scan import scan_project

    for name, text in {"src/index.ts": "x", "src/app.py": "y", "src/readme.md": "z", "dist/index.js": "d", "node_modules/l/index.js": "n", ".gitignore": "dist/\n# no\n*.log\n", "big.ts": "b" * 3000}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path: r for r in scan_project(spark, str(tmp_path), max_file_size=2000).collect()}
    assert sorted(got) == ["src/app.py", "src/index.ts"]
    assert len(got["src/app.py"].content_hash) == 12 and got["src/app.py"].language == "python" and got["src/app.py"].size == 1
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    subprocess.run(["git", "-C", str(tmp_path), "add", "src/index.ts"], check=True)
    assert [r.path for r in scan_project(spark, str(tmp_path)).collect()] == ["src/index.ts"]
    assert sorted(r.path for r in scan_project(spark, str(tmp_path), ["*.py"], use_git=False).collect()) == ["big.ts", "src/index.ts"]


PYTHON = '''"""Doc of the module."""
import os
from typing import List, Dict as D

MAX_SIZE: int = 3
_hidden = 1


class Base:
    """Base doc."""


class Emitter(Base, abc.Other):
    @staticmethod
    def make(x): return helper(x)

    async def run(self) -> List:
        self.emit("x")
        print(1)


def helper(a):
    return Emitter.make(a)
'''

TYPESCRIPT = '''import { A, B as C } from "./lib";

/** A shape. */
export interface Shape extends Base { area(): number; name: string; }
export enum Color { Red, Green = 2 }
export type Id = string | number;
export abstract class Box<T> extends Shelf<T> implements Shape, Other {
  private readonly size: Size = 1;
  constructor(x: number) { super(); }
  async open(key: Key): Promise<void> { this.turn(key); const d = new Door(); "class Fake {}"; }
  static of() { return make(); }
}
export const MAX = 10;
const plain = async (x) => { helper(x); };
function local() { return plain(1); } // function not() {}
'''

CSHARP = '''using System;
namespace App.Core {
  public interface IThing { void Do(); }
  public abstract class Base { }
  /// <summary>Runs.</summary>
  public class Runner : Base, IThing {
    private int count = 0;
    public string Name { get; set; }
    public Runner(int x) { count = x; }
    public void Do() { Log("x"); var t = new Timer(); }
  }
  public enum Mode { On, Off }
}
'''


def extracted(spark, path, source):
    from codeloom.sources.extract import extract_project

    files = spark.createDataFrame([(path, source)], "path string, content string").withColumn("language", tx.detect_language("path"))
    return extract_project(files)


def test_extract_python(spark):
    g = extracted(spark, "src/a.py", PYTHON)
    nodes = {(r.kind, r.name): r for r in g.nodes.collect()}
    assert {("file", "src/a.py"), ("class", "Base"), ("class", "Emitter"), ("method", "make"), ("method", "run"), ("function", "helper"), ("constant", "MAX_SIZE"), ("import", "os"), ("import", "typing")} <= set(nodes)
    assert ("variable", "_hidden") not in nodes
    assert nodes["method", "run"].is_async and nodes["method", "make"].is_static and nodes["class", "Base"].docstring == "Base doc."
    assert nodes["method", "run"].qualified_name == "src/a.py.Emitter.run" and nodes["class", "Emitter"].start_line == 13
    got = {(r.reference_kind, r.reference_name) for r in g.refs.collect()}
    assert {("extends", "Base"), ("extends", "abc.Other"), ("calls", "helper"), ("calls", "Emitter.make"), ("calls", "self.emit"), ("imports", "List"), ("imports", "Dict")} <= got
    assert ("calls", "print") not in got and ("returns", "List") not in got
    assert g.edges.where("kind = 'contains'").count() == g.nodes.count() - 1


def test_extract_typescript(spark):
    g = extracted(spark, "src/a.ts", TYPESCRIPT)
    nodes = {(r.kind, r.name): r for r in g.nodes.collect()}
    assert {("interface", "Shape"), ("enum", "Color"), ("enum_member", "Red"), ("enum_member", "Green"), ("type_alias", "Id"), ("class", "Box"), ("property", "size"), ("method", "open"), ("method", "of"), ("constant", "MAX"), ("function", "plain"), ("function", "local"), ("import", "./lib")} <= set(nodes)
    assert ("class", "Fake") not in nodes and ("function", "not") not in nodes
    assert nodes["class", "Box"].is_exported and nodes["class", "Box"].is_abstract and not nodes["function", "local"].is_exported
    assert nodes["method", "open"].is_async and nodes["method", "of"].is_static and nodes["property", "size"].visibility == "private"
    assert nodes["interface", "Shape"].docstring == "A shape."
    got = {(r.reference_kind, r.reference_name) for r in g.refs.collect()}
    assert {("extends", "Shelf"), ("implements", "Shape"), ("implements", "Other"), ("extends", "Base"), ("instantiates", "Door"), ("calls", "this.turn"), ("calls", "helper"), ("imports", "A"), ("imports", "B"), ("returns", "Promise"), ("type_of", "Size")} <= got


def test_extract_csharp(spark):
    g = extracted(spark, "Runner.cs", CSHARP)
    nodes = {(r.kind, r.name): r for r in g.nodes.collect()}
    assert {("namespace", "App.Core"), ("interface", "IThing"), ("class", "Base"), ("class", "Runner"), ("field", "count"), ("property", "Name"), ("method", "Do"), ("method", "Runner"), ("enum", "Mode"), ("enum_member", "On"), ("import", "System")} <= set(nodes)
    assert nodes["class", "Base"].is_abstract and nodes["field", "count"].visibility == "private" and nodes["class", "Runner"].docstring == "Runs."
    got = {(r.reference_kind, r.reference_name) for r in g.refs.collect()}
    assert {("extends", "Base"), ("implements", "IThing"), ("calls", "Log"), ("instantiates", "Timer")} <= got


def test_extract_names(spark):
    g = extracted(spark, "a.py", "def f() -> Any:\n    return max(1, len(range(2)))\nVALUE = '" + "x" * 500 + "'\n")
    assert {(r.reference_kind, r.reference_name) for r in g.refs.collect()} == {("calls", "max")}
    assert len(g.nodes.where("name = 'VALUE'").head().signature) > 500 and g.files.head().indexed_at is not None
    source = "@Component({a: f(1)})\nexport class A {\n  @Input() size: Size;\n  @Out()\n  run() { parseInt('1'); JSON.parse(x); go(); setTimeout(a, 1); Object.assign(b); other.assign(b); }\n}\n"
    g = extracted(spark, "a.ts", source)
    marks = {r.name: r.decorators for r in g.nodes.collect()}
    assert marks["A"] == ["Component({a: f(1)})"] and marks["size"] == ["Input()"] and marks["run"] == ["Out()"]
    assert {r.reference_name for r in g.refs.where("reference_kind = 'calls'").collect()} == {"go", "other.assign"}


def test_scanner_is_linear():
    import time

    from codeloom.sources.extract import extract_file

    source = "".join(f"export class C{i} extends B {{\n  run{i}(x: number): R {{ return bar(x, [1, {{a: 2}}]); }}\n}}\nconst v{i} = 3\n" for i in range(12_000))
    began = time.process_time()
    out = extract_file("a.ts", source, "typescript")
    assert len(source) > 1 << 20 and len(out["spans"]) == 36_001 and time.process_time() - began < 10


def test_file_records(spark):
    from codeloom.operators.lookup import file_records

    files = spark.createDataFrame([("a", []), ("a", []), ("b", ["bad"])], "path string, errors array<string>")
    nodes = spark.createDataFrame([("1", "a"), ("2", "a")], "id string, file_path string")
    assert sorted((r.path, r.node_count, r.errors, r.indexed_at is not None) for r in file_records(files, nodes).collect()) == [("a", 2, None, True), ("b", 0, ["bad"], True)]


def test_stream_keeps_early_edges(spark, tmp_path):
    from codeloom.sources.extract import extract_project
    from codeloom.streaming.ingest import GraphTables

    tables = GraphTables(spark, str(tmp_path / "graph"))
    assert tables.read() is None
    put = lambda k, *rows: tables.append(extract_project(spark.createDataFrame(rows, "path string, content string, language string")), k)
    put(0, ("a.py", "def f(): return g()\n", "python"))
    assert tables.read().edges.where("kind = 'calls'").count() == 0
    put(1, ("b.py", "def g(): pass\n", "python"))
    assert tables.read().edges.where("kind = 'calls'").count() == 1
    put(1, ("b.py", "def g(): pass\ndef h(): pass\n", "python"))  # the same batch again
    now = tables.compact(str(tmp_path / "small")).read()
    assert now.files.count() == 2 and now.edges.where("kind = 'calls'").count() == 1 and now.nodes.where("name = 'h'").count() == 1


def test_stream(spark, tmp_path):
    from codeloom.sources.extract import extract_project
    from codeloom.streaming.ingest import GraphTables, ingest_stream

    tables = GraphTables(spark, str(tmp_path / "graph"))
    schema = "path string, content string, language string"
    for k, source in enumerate(("def old(): pass\n", "def new(): pass\n")):
        spark.createDataFrame([("m.py", source, "python")], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest_stream(stream, tables, extract_project, str(tmp_path / "check")).awaitTermination()
        names = {r.name for r in tables.read().nodes.where("kind = 'function'").collect()}
        assert names == ({"old"}, {"new"})[k]
