"""Symbols, containment edges and references of source files.

Parsers run in tasks, one file at a time, and return what they see as it is written; everything that follows from it is worked out by ``symbols`` as columns.
``register_extractor`` adds a language: a function that fills an ``Extraction``. Python is read by its own parser,
TypeScript (and JavaScript) and C# by ``braces``, which sees declarations, not expressions.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.checkpoints import cut
from codeloom.schema import Graph
from codeloom.sources.symbols import SCHEMA, TS_LANGUAGES, contains_rows, hidden, reference_rows, symbol_rows

class Extraction:
    """What a parser has seen in one file so far: declarations and uses, as they are written (see ``symbols``)."""

    def __init__(self, source: str, path: str, language: str):
        self.source, self.path, self.language = source, path, language
        self.spans: list[dict] = []
        self.uses: list[dict] = []
        self.root = self.add(None, "file", path, 1, source.count("\n") + 1, source)

    def add(self, parent: int | None, kind: str, name: str, first: int, last: int, text: str, head: str | None = None, doc: str | None = None, words: list[str] | None = None, decorators: list[str] | None = None, mark: str | None = None) -> int:
        """A declaration inside another one; its place is returned."""
        above = self.spans[parent] if parent else None
        scope = [*above["scope"], above["name"]] if above else []
        self.spans.append({"kind": kind, "name": name, "scope": scope, "mark": mark, "first": first, "last": last, "text": text, "head": head, "doc": doc, "decorators": decorators, "words": words})
        return len(self.spans) - 1

    def use(self, owner: int, name: str, use: str, line: int, col: int = 0, module: str | None = None) -> None:
        self.uses.append({"owner": owner, "name": name, "use": use, "line": line, "col": col, "module": module})


EXTRACTORS: dict[str, Callable[[Extraction], None]] = {}


def register_extractor(language: str, extractor: Callable[[Extraction], None]) -> None:
    EXTRACTORS[language] = extractor


def extract_python(x: Extraction) -> None:
    tree = ast.parse(x.source)
    lines = x.source.split("\n")

    def text(n: ast.AST) -> str:
        return "\n".join(lines[n.lineno - 1 : n.end_lineno])

    def dotted(n: ast.AST | None) -> str | None:
        if isinstance(n, ast.Subscript):
            return dotted(n.value)
        if isinstance(n, ast.Constant) and isinstance(n.value, str) and n.value.isidentifier():
            return n.value
        return ast.unparse(n) if isinstance(n, ast.Name | ast.Attribute) else None

    def calls(owner: int, body: ast.AST) -> None:
        for c in ast.walk(body):
            if isinstance(c, ast.Call) and (name := dotted(c.func)):
                x.use(owner, name, "calls", c.lineno, c.col_offset)

    def function(n, parent: int, in_class: bool) -> None:
        marks = [ast.unparse(d) for d in n.decorator_list]
        sig = f"{'async ' if isinstance(n, ast.AsyncFunctionDef) else ''}def {n.name}({ast.unparse(n.args)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else "")
        node = x.add(parent, "method" if in_class else "function", n.name, n.lineno, n.end_lineno, text(n), sig, ast.get_docstring(n), ["async"] if isinstance(n, ast.AsyncFunctionDef) else None, marks or None)
        if name := dotted(n.returns):
            x.use(node, name, "returns", n.lineno)
        for s in n.body:
            calls(node, s)

    def klass(n: ast.ClassDef, parent: int) -> None:
        marks = [ast.unparse(d) for d in n.decorator_list]
        abstract = any(isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef) and any(ast.unparse(d).endswith("abstractmethod") for d in s.decorator_list) for s in n.body)
        node = x.add(parent, "class", n.name, n.lineno, n.end_lineno, text(n), None, ast.get_docstring(n), ["abstract"] if abstract else None, marks or None)
        for b in n.bases:
            if name := dotted(b):
                x.use(node, name, "extends", n.lineno)
        for s in n.body:
            if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef):
                function(s, node, True)
            elif isinstance(s, ast.ClassDef):
                klass(s, node)

    x.spans[x.root]["doc"] = ast.get_docstring(tree)
    for n in tree.body:
        if isinstance(n, ast.ClassDef):
            klass(n, x.root)
        elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            function(n, x.root, False)
        elif isinstance(n, ast.Import | ast.ImportFrom):
            modules = [(a.name, [a.name]) for a in n.names] if isinstance(n, ast.Import) else [("." * n.level + (n.module or ""), [a.name for a in n.names])]
            for module, names in modules:
                node = x.add(x.root, "import", module, n.lineno, n.end_lineno, text(n), text(n), mark=f"import({module})")
                for name in names:
                    x.use(node, name, "imports", n.lineno, n.col_offset, module)
        elif isinstance(n, ast.Assign | ast.AnnAssign):
            for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                if isinstance(t, ast.Name):
                    x.add(x.root, "assignment", t.id, n.lineno, n.end_lineno, text(n), text(n))
        elif isinstance(n, ast.Expr):
            calls(x.root, n)


register_extractor("python", extract_python)


def _braces() -> None:
    from codeloom.sources import braces

    for language in TS_LANGUAGES:
        register_extractor(language, braces.extract_typescript)
    register_extractor("csharp", braces.extract_csharp)


def known_extractors() -> dict[str, Callable[[Extraction], None]]:
    if not EXTRACTORS.get("csharp"):
        _braces()
    return dict(EXTRACTORS)


def extract_file(path: str, source: str, language: str, extractors: dict[str, Callable[[Extraction], None]] | None = None) -> dict:
    """What the language's parser sees; of a file that it can't read, the file alone and the error."""
    extractors = known_extractors() if extractors is None else extractors
    x = Extraction(source, path, language)
    error = None
    if language in extractors:
        try:
            extractors[language](x)
        except (SyntaxError, ValueError, RecursionError) as e:
            error = str(e)[:500]
    return {"path": path, "language": language, "spans": x.spans, "uses": x.uses, "error": error}


def parsed(files: DataFrame) -> DataFrame:
    """Declarations and uses of files (path, language, content), a row for each (SCHEMA)."""
    extractors = known_extractors()  # tasks get those of this process

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(kinds)
        for b in batches:
            for lo in range(0, len(b), 50):
                rows = [extract_file(p, s or "", lang, extractors) for p, s, lang in zip(*(b[k].slice(lo, 50).to_pylist() for k in range(3)), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = files.sparkSession.createDataFrame([], SCHEMA).schema
    return files.select("path", "content", "language").mapInArrow(run, SCHEMA)


def extract_project(files: DataFrame) -> Graph:
    """The graph of files (path, language, content); files that cannot be parsed keep their file node and an error."""
    found = cut(parsed(files))
    shown = F.size(F.filter("spans", lambda s: ~hidden(s)))
    info = found.select("path", shown.alias("node_count"), F.when(F.col("error").isNotNull(), F.array("error")).alias("errors"))
    keep = [c for c in files.columns if c not in ("content",)]
    return Graph(
        symbol_rows(found).withColumn("updated_at", F.current_timestamp()),
        contains_rows(found).withColumn("provenance", F.lit("tree-sitter")),
        files.select(*keep).join(info, "path").withColumn("indexed_at", F.current_timestamp()),
        reference_rows(found),
    )


def extraction_summary(g: Graph, scanned: DataFrame | None = None, started: float | None = None) -> DataFrame:
    """One row: files, nodes, edges, references, files with errors, files of ``scanned`` (path) that were not extracted, and milliseconds since ``started`` (time.time(), null without) when this is read."""
    f = g.files.agg(F.count("*").alias("files"), F.count_if(F.col("errors").isNotNull()).alias("errors"), F.coalesce(F.sum("node_count"), F.lit(0)).alias("nodes"))
    e, r = g.edges.agg(F.count("*").alias("edges")), g.refs.agg(F.count("*").alias("refs"))
    out = f.join(F.broadcast(e), F.lit(True)).join(F.broadcast(r), F.lit(True))  # single rows
    lost = F.lit(0).cast("long").alias("skipped")
    if scanned is not None:
        n = scanned.select("path").join(g.files.select("path"), "path", "left_anti").agg(F.count("*").alias("skipped"))
        out, lost = out.join(F.broadcast(n), F.lit(True)), F.col("skipped")
    took = F.lit(None).cast("long") if started is None else F.unix_millis(F.current_timestamp()) - F.lit(int(started * 1000))
    return out.select("files", "errors", "nodes", "edges", "refs", lost, took.alias("duration_ms"))
