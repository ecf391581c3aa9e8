"""The rules that make symbols and references of what parsers saw: identity, names, comments, flags, deny lists, base types."""

import hashlib

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.sources import symbols
from codeloom.sources.extract import extract_project, parsed, register_extractor

TS = '''// one
// two <b>x</b>
export default abstract class A<T extends B<C>> extends pkg.Base<D, E> implements I<F>, J {
  @Dec({a: 1}) protected static async run<T>(a: T): Promise<Map<string, X>> { super.go(); this?.b?.c(1); new Foo.Bar(); return console.log(1); }
  private x?: string; y: Number = 1; z: List<Q>;
}
const f = async (x: A) => x.y(), LIMIT = 3;
let g = 5;
import type { Q, type R as S } from "../q";
/** multi
 *  line * star
 */
export type U =
   A   | B;
'''
CS = '''using static X.Y;
namespace N;
public sealed class K<T> : Base<T>, IFoo<int>, IO, Ix, I where T : new() {
  protected internal static readonly int Max = 3;
  private async Task<int> Go(int a) { if (a) Run(); base.X(); return new List<int>(); }
  decimal M() { return 1; }
}
/// <summary>Doc of</summary>
/// <param name="a">second</param>
internal enum Mode { A, B = 2 }
'''
PY = '''"""  doc
  more  """
__all__ = 1
_x = 2
XX = 1
Ab: int = 2
class A(B[int], "C", object):
    """ d """
    @abstractmethod
    @staticmethod
    def m(self, a="x  y") -> Optional[int]: a.b(); print(c())
import a.b as c, d
from .. import q
'''


@pytest.fixture(scope="module")
def graph(spark):
    files = spark.createDataFrame([("s/a.ts", TS), ("K.cs", CS), ("p.py", PY), ("bad.py", "def (")], "path string, content string").withColumn("language", tx.detect_language("path"))
    g = extract_project(files)
    return {(r.file_path, r.name): r for r in g.nodes.collect()}, g


def test_identity(graph):
    nodes, g = graph
    for (path, name), r in nodes.items():
        assert r.id == hashlib.sha256(f"{path}::{r.qualified_name}".encode()).hexdigest()[:16]
    assert nodes["s/a.ts", "run"].qualified_name == "s/a.ts.A.run" and nodes["K.cs", "Go"].qualified_name == "K.cs.N.K.Go"
    assert nodes["s/a.ts", "../q"].qualified_name == "s/a.ts::import(../q)" and nodes["K.cs", "X.Y"].qualified_name == "K.cs::using(X.Y)"
    assert nodes["p.py", "p.py"].qualified_name == "p.py" and nodes["p.py", "p.py"].content_hash == hashlib.sha256(PY.encode()).hexdigest()[:12]
    assert nodes["p.py", "XX"].content_hash == hashlib.sha256(b"XX = 1").hexdigest()[:12]
    contains = {(r.source, r.target) for r in g.edges.where("kind = 'contains'").collect()}
    by = {r.qualified_name: r.id for r in nodes.values()}
    assert (by["s/a.ts.A"], by["s/a.ts.A.run"]) in contains and (by["K.cs.N"], by["K.cs.N.K"]) in contains and (by["p.py"], by["p.py::import(d)"]) in contains
    assert len(contains) == len(nodes) - 4  # all but the files


def test_kinds_flags_and_texts(graph):
    nodes, g = graph
    kinds = {k: r.kind for k, r in nodes.items()}
    assert [kinds["s/a.ts", x] for x in ("A", "run", "x", "f", "g", "U")] == ["class", "method", "property", "function", "variable", "type_alias"]
    assert [kinds["p.py", x] for x in ("__all__", "XX", "Ab", "m")] == ["variable", "constant", "variable", "method"] and ("p.py", "_x") not in kinds
    assert [kinds["K.cs", x] for x in ("N", "K", "Max", "Go", "A")] == ["namespace", "class", "field", "method", "enum_member"]
    a, run, m = nodes["s/a.ts", "A"], nodes["s/a.ts", "run"], nodes["p.py", "m"]
    assert a.is_exported and a.is_abstract and not a.is_async and a.docstring == "one two x"
    assert run.visibility == "protected" and run.is_static and run.is_async and run.decorators == ["Dec({a: 1})"] and not run.is_exported
    assert nodes["s/a.ts", "U"].docstring == "multi line * star" and nodes["s/a.ts", "U"].signature == "export type U = A | B"
    assert m.is_static and m.is_abstract and m.signature == "def m(self, a='x  y') -> Optional[int]" and nodes["p.py", "A"].is_abstract
    assert nodes["p.py", "p.py"].docstring == "doc\nmore  " and nodes["p.py", "A"].docstring == "d "
    assert nodes["K.cs", "Max"].visibility == "protected" and nodes["K.cs", "Mode"].docstring == "Doc of second" and nodes["K.cs", "K"].is_exported
    assert {r.path: r.errors is not None for r in g.files.collect()}["bad.py"] and nodes["bad.py", "bad.py"].kind == "file"
    assert {r.path: r.node_count for r in g.files.collect()}["p.py"] == sum(p == "p.py" for p, _ in nodes)


def test_references(graph):
    nodes, g = graph
    by = {r.id: r.name for r in nodes.values()}
    refs = {(by[r.from_id], r.reference_kind, r.reference_name) for r in g.refs.collect()}
    assert {("A", "extends", "pkg.Base"), ("A", "implements", "I"), ("A", "implements", "J"), ("run", "returns", "Promise"), ("run", "instantiates", "Foo.Bar"), ("run", "calls", "this.b.c"), ("z", "type_of", "List"), ("f", "calls", "x.y")} <= refs
    assert {("../q", "imports", "Q"), ("../q", "imports", "R"), ("K", "extends", "Base"), ("K", "implements", "IFoo"), ("K", "implements", "IO"), ("K", "extends", "Ix"), ("K", "extends", "I"), ("Go", "returns", "Task"), ("Go", "calls", "Run")} <= refs
    assert {("A", "extends", "B"), ("A", "extends", "C"), ("m", "calls", "a.b"), ("m", "calls", "c"), ("a.b", "imports", "a.b"), ("..", "imports", "q")} <= refs
    names = {r[2] for r in refs}
    assert not names & {"console.log", "super.go", "print", "Optional", "object", "Number", "string", "decimal", ""}  # denied
    assert ("Go", "calls", "base.X") in refs and ("M", "returns", "decimal") not in refs
    modules = {(r.reference_name, tuple(r.candidates)) for r in g.refs.where("reference_kind = 'imports'").collect()}
    assert {("Q", ("../q",)), ("q", ("..",)), ("a.b", ("a.b",))} <= modules


def test_another_language(spark):
    """A parser that returns spans and uses alone gets identity, containment and references by the same rules."""

    def lines(x):
        last = x.root
        for k, line in enumerate(x.source.split("\n"), 1):
            word, _, name = line.partition(" ")
            if word == "fn":
                last = x.add(x.root, "function", name, k, k, line, line, words=["export"])
            elif word == "go":
                x.use(last, name, "calls", k)

    register_extractor("kotlin", lines)
    rows = parsed(spark.createDataFrame([("a.kt", "fn one\ngo two\nfn two\ngo super.x", "kotlin")], "path string, content string, language string"))
    nodes = {r.name: r for r in symbols.symbol_rows(rows).collect()}
    assert nodes["two"].qualified_name == "a.kt.two" and nodes["one"].is_exported and nodes["one"].signature == "fn one"
    refs = symbols.reference_rows(rows).collect()
    assert [(r.reference_name, r.from_id) for r in refs] == [("two", nodes["one"].id)] and symbols.contains_rows(rows).where(F.col("source") == nodes["a.kt"].id).count() == 2


def test_statements_go_on_over_any_white_space(spark):
    source = "const total =" + " " * 900 + "\n" * 300 + "compute(a)\nexport class B extends" + " \n" * 250 + "C {}\n"
    g = extract_project(spark.createDataFrame([("a.ts", source, "typescript")], "path string, content string, language string"))
    assert {(r.kind, r.name) for r in g.nodes.collect()} == {("file", "a.ts"), ("constant", "total"), ("class", "B")}
    assert {(r.reference_kind, r.reference_name) for r in g.refs.collect()} == {("calls", "compute"), ("extends", "C")}
