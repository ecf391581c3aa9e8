"""What follows changes: tables of a graph, the search index, resolved references; and the repo and site formats."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import resolve, search
from codeloom.sources.extract import extract_project
from codeloom.sources.repo import register
from codeloom.sources.scan import scan_project
from codeloom.streaming.ingest import GraphTables, ingest_stream
from codeloom.streaming.search_tables import SearchTables

FILES = "path string, content string, language string, content_hash string"


def files_of(spark, sources):
    return spark.createDataFrame([(p, s, {"py": "python", "ts": "typescript"}[p.rpartition(".")[2]], str(hash(s))) for p, s in sources.items()] or [("", "", "", "")], FILES).where("path <> ''")


def test_names_go_to_the_first_file(spark):
    """Six files export Foo; the one first in the order of paths is taken, whatever the hashes of the paths are."""
    sources = {f"{x}.ts": "export class Foo {}\n" for x in "dbfaec"} | {"z.ts": "export class Bar extends Foo {}\n"}
    g = extract_project(files_of(spark, sources))
    edges = resolve.resolve_references(g.refs, g.nodes, g.files).where("kind = 'extends'")
    target = edges.join(g.nodes.select(F.col("id").alias("target"), "file_path"), "target").select("file_path").collect()
    assert [r[0] for r in target] == ["a.ts"]
    first = g.nodes.where("name = 'Foo'").orderBy("ord").select("file_path").collect()
    assert [r[0] for r in first] == [f"{x}.ts" for x in "abcdef"]


def test_edges_of_files_come_before_found_ones(spark, tmp_path):
    """References that give one edge: the first in the file's order stays, with its place."""
    tables = GraphTables(spark, str(tmp_path / "g"))
    tables.append(extract_project(files_of(spark, {"a.py": "def g():\n    pass\n\ndef f():\n    g()\n    g()\n    return g()\n"})), 0)
    rows = tables.read().edges.where("kind = 'calls'").collect()
    assert [(r["line"], r["provenance"]) for r in rows] == [(5, "heuristic")]


def test_tables_follow_a_project(spark, tmp_path):
    """Files that stay write nothing, changed ones are replaced, vanished ones go, and one that comes back is there again."""
    tables = GraphTables(spark, str(tmp_path / "g"))
    seen = []

    def extract(files):
        seen.append({r[0] for r in files.select("path").collect()})
        return extract_project(files)

    names = lambda: {r[0] for r in tables.read().nodes.where("kind = 'function'").select("name").collect()}
    a, b, c = "def a(): b()\n", "def b(): pass\n", "def c(): pass\n"
    tables.sync(files_of(spark, {"a.py": a, "b.py": b}), extract, 0)
    assert names() == {"a", "b"} and tables.read().edges.where("kind = 'calls'").count() == 1
    tables.sync(files_of(spark, {"a.py": a, "b.py": b}), extract, 1)
    assert len(seen) == 1 and not os.path.exists(tmp_path / "g/files/batch=1")  # nothing to write
    tables.sync(files_of(spark, {"a.py": a, "c.py": c}), extract, 2)
    assert seen[-1] == {"c.py"} and names() == {"a", "c"} and {r.path for r in tables.read().files.collect()} == {"a.py", "c.py"}
    assert tables.read().edges.where("kind = 'calls'").count() == 0 and tables.read().refs.where("file_path = 'b.py'").count() == 0
    tables.sync(files_of(spark, {"a.py": a, "b.py": b, "c.py": "def d(): pass\n"}), extract, 3)
    assert seen[-1] == {"b.py", "c.py"} and names() == {"a", "b", "d"} and tables.read().edges.where("kind = 'calls'").count() == 1
    small = tables.compact(str(tmp_path / "small"))
    assert {r.path for r in small.versions().collect()} == {"a.py", "b.py", "c.py"}
    tables.sync(files_of(spark, {}), extract, 4)
    assert names() == set() and tables.read().files.count() == 0


def test_stream_with_deletions(spark, tmp_path):
    tables = GraphTables(spark, str(tmp_path / "graph"))
    seen = []

    def extract(files):
        seen.append(sorted(r[0] for r in files.select("path").collect()))
        return extract_project(files)

    schema = FILES + ", deleted boolean"

    def put(*rows):
        spark.createDataFrame([(p, s, "python", None if s is None else str(hash(s)), s is None) for p, s in rows], schema).write.mode("append").parquet(str(tmp_path / "in"))
        ingest_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), tables, extract, str(tmp_path / "check")).awaitTermination()
        return {r[0] for r in tables.read().nodes.where("kind = 'function'").select("name").collect()}

    assert put(("m.py", "def m(): pass\n"), ("n.py", "def n(): pass\n")) == {"m", "n"}
    assert put(("m.py", "def m(): pass\n")) == {"m", "n"} and seen == [["m.py", "n.py"]]  # unchanged
    assert put(("m.py", None), ("other.py", None)) == {"n"}
    assert put(("m.py", "def m(): pass\n"), ("n.py", None)) == {"m"} and seen[-1] == ["m.py"]  # made anew


def test_search_after_updates_equals_rebuild(spark, tmp_path):
    r = random.Random(3)
    word = lambda: r.choice(["total", "sum", "count", "calc", "calculate", "order"]) + r.choice(["", "All", "ed", "_of"])
    tables = SearchTables(spark, str(tmp_path / "s"))
    now = {}
    schema = "id string, name string, qualified_name string, docstring string, signature string, file_path string"

    def nodes(files):
        rows = [(f"{p}#{i}", *(None if r_ is None else r_ for r_ in x), p) for p, f in files.items() for i, x in enumerate(f)]
        return spark.createDataFrame(rows or [("", "", "", "", "", "")], schema).where("id <> ''")

    for batch in range(10):
        new = {f"f{r.randrange(8)}": [(word(), word(), " ".join(word() for _ in range(r.randrange(9))) or None, None) for _ in range(r.randrange(4))] for _ in range(3)}
        gone = [p for p in list(now) if p not in new and r.random() < 0.3] + ["never"]
        lost = [p for p in new if not new[p]]  # files without any node now
        tables.update(nodes(new), batch, spark.createDataFrame([(p,) for p in gone + lost], "path string"))
        now = {p: f for p, f in (now | new).items() if p not in gone and f}
        if batch == 5:
            tables.update(nodes(new), batch, spark.createDataFrame([(p,) for p in gone + lost], "path string"))  # once more
        if batch in (0, 4, 9):
            everything = nodes(now)
            for index in (tables.index(), tables.compact(str(tmp_path / f"c{batch}")).index()):
                for query in ("sum calc", "total order_of", "nothing"):
                    want = {tuple(x) for x in search.search_nodes(everything, query, limit=1000).collect()}
                    assert {tuple(x) for x in search.search_nodes(everything, query, limit=1000, index=index).collect()} == want
                assert index.corpus.select("n").head()[0] == everything.count()


def modules(r, n):
    out = {}
    for i in range(n):
        text = "".join(f"import {{ F{r.randrange(9)} }} from './{r.choice(['m', 'k/m', '../m'])}{r.randrange(n)}';\n" for _ in range(2))
        text += f"export class F{r.randrange(9)} extends F{r.randrange(9)} {{}}\nfunction g{r.randrange(5)}() {{ g{r.randrange(5)}(); }}\n"
        out[r.choice(["", "k/"]) + f"m{i}.ts"] = text
    return out


def test_links_follow_changes(spark):
    """After random edits the links are those of a full resolution, and only what an edit can affect was looked at."""
    r = random.Random(11)
    now = modules(r, 14)
    g = extract_project(files_of(spark, now))
    links = resolve.link(g.refs, g.nodes, g.files)
    columns = ["source", "target", "kind", "line", "col", "provenance"]
    rows = lambda df: {tuple(x) for x in df.select(*columns).collect()}
    for step in range(3):
        links = resolve.Links(*(x.checkpoint() if spark.sparkContext.getCheckpointDir() else x for x in (links.refs, links.keys, links.edges)))
        path = r.choice(sorted(now))
        new = dict(now)
        del new[path]
        changed = {path}
        if step != 1:
            text = modules(r, 14).popitem()[1]
            new[path if step == 0 else "k/m99.ts"] = text
            changed |= set(new) - set(now)
        after = extract_project(files_of(spark, new))
        only = after.refs.where(F.col("file_path").isin(*changed))
        links, todo = resolve.relink(links, spark.createDataFrame([(p,) for p in changed], "path string"), g.nodes, after.nodes, after.files, only)
        full = resolve.resolve_references(after.refs, after.nodes, after.files)
        assert rows(links.edges) == rows(full)
        assert links.refs.count() == resolve.identified(after.refs).count()
        assert only.count() <= todo.count() < links.refs.count()
        g, now = after, new
    quiet = extract_project(files_of(spark, now | {"q.ts": "function lonelyName() {}\n"}))
    _, todo = resolve.relink(links, spark.createDataFrame([("q.ts",)], "path string"), g.nodes, quiet.nodes, quiet.files, quiet.refs.where("file_path = 'q.ts'"))
    assert todo.count() == 0


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "project"
    for path, text in {
        "a.py": "x = 1\n", "b.txt": "no", "src/c.ts": "let c = 1;\n", "src/deep/er/d.py": "d = 'é'\n", "src/[id]/e.ts": "e\n", "node_modules/x/y.js": "y\n", "src/node_modules/z.js": "z\n",
        "big.py": "b" * 5000, "lib/f.min.js": "f", "lib/gen.py": "g", "lib/keep.py": "k", "sub.map/h.py": "h\n",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text, encoding="utf-8")
    (root / ".gitignore").write_text("gen.py\n# comment\n")
    return root


def repo(spark, root, **options):
    register(spark)
    options = {"maxFileSize": 10_000, **options}
    return spark.read.format("repo").options(path=str(root), **options).load()


@pytest.mark.parametrize("folders", [1, 3, 100])
def test_repo_format_reads_what_a_scan_reads(spark, tree, folders):
    columns = ["path", "language", "content_hash", "size", "content"]
    want = set()
    for path in ("a.py", "src/c.ts", "src/deep/er/d.py", "src/[id]/e.ts", "lib/keep.py", "sub.map/h.py"):
        text = (tree / path).read_text(encoding="utf-8")
        want.add((path, {"py": "python", "ts": "typescript"}[path.rpartition(".")[2]], hashlib.sha256(text.encode()).hexdigest()[:12], len(text.encode()), text))
    df = repo(spark, tree, maxFileSize=1000, git="false", folders=folders)
    got = [tuple(x) for x in df.select(*columns).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {tuple(x) for x in scan_project(spark, str(tree), max_file_size=1000, use_git=False).select(*columns).collect()} == want
    assert df.where("modified_at > '2000-01-01'").count() == 6
    more = {r[0] for r in repo(spark, tree, git="false", folders=folders, ignore="src\n!keep.py").select("path").collect()}
    assert more == {"a.py", "big.py", "lib/keep.py", "sub.map/h.py"}


def test_repo_format_with_git(spark, tree):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tree), *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "a.py", "src")
    for folders in (1, 2, 100):
        assert {r[0] for r in repo(spark, tree, folders=folders).select("path").collect()} == {"a.py", "src/c.ts", "src/deep/er/d.py", "src/[id]/e.ts"}


def test_repo_format_is_given_filters(spark, tree):
    df = repo(spark, tree, git="false").where("startswith(path, 'src/') and size < 9 and language in ('python', 'typescript')")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "(Python)" in plan  # none is left to Spark
    assert {r.path for r in df.select("path").collect()} == {"src/[id]/e.ts"}
    assert {r.path for r in repo(spark, tree, git="false").where("path like '%e%' or size > 100").select("path").collect()} == {"big.py", "lib/keep.py", "src/deep/er/d.py", "src/[id]/e.ts"}
    assert repo(spark, tree, git="false").where("path = 'a.py' and content like '%1%'").count() == 1


def test_ignored_folders_are_not_listed(tree, monkeypatch):
    from codeloom.sources.repo import RepoReader

    listed = []
    real = RepoReader.entries
    monkeypatch.setattr(RepoReader, "entries", lambda self, folder: listed.append(folder) or real(self, folder))
    reader = RepoReader({"path": str(tree), "git": "false", "folders": "2"})
    found = [x for part in reader.partitions() for b in reader.read(part) for x in b["path"].to_pylist()]
    assert "src/deep/er/d.py" in found and "src/deep/er" in listed and not any("node_modules" in x for x in listed)
    with pytest.raises(ValueError):
        RepoReader({})


def test_site_format(spark, tmp_path):
    register(spark)
    out = tmp_path / "site"
    pages = lambda *rows: spark.createDataFrame(rows, "path string, content string").repartition(3)
    write = lambda df, mode="overwrite": df.write.format("site").mode(mode).save(str(out))
    files = lambda: {str(p.relative_to(out)): p.read_text() for p in out.rglob("*") if p.is_file()}
    write(pages(("index.md", "one"), ("sub/page.md", "zwö"), ("c.md", None)))
    assert files() == {"index.md": "one", "sub/page.md": "zwö", "c.md": ""}
    with pytest.raises(Exception, match="overwrite"):
        write(pages(("index.md", "x")), "append")
    for bad in (pages(("index.md", "new"), ("../out.md", "x")), pages(("index.md", "new"), ("b.md", "x"), ("index.md", "twice"))):
        with pytest.raises(Exception):
            write(bad)
        assert files() == {"index.md": "one", "sub/page.md": "zwö", "c.md": ""}  # the old site
    write(pages(("only.md", "two")))
    assert files() == {"only.md": "two"} and [p.name for p in tmp_path.iterdir()] == ["site"]


def test_ask_without_reading_all_pages(spark):
    """The top five are those of a scan, ties and repeated terms included; few pages are read."""
    from codeloom.operators.ask_index import ask_top_indexed, trigram_index

    r = random.Random(6)
    words = ["graph", "graphs", "Node", "édge", "an", "walk", "search", "page", "of", "index", "token"]
    pages = [(f"p{i:03}.md", " ".join(r.choice(words) for _ in range(r.choice([0, 1, 20, 200])))) for i in range(300)] + [("none.md", None), ("q.md", "walk the graph of pages"), ("aaa.md", "aaaaaaa")]
    df = spark.createDataFrame(pages, "path string, content string")
    index = trigram_index(df, "path").cache()
    for question in ("Walk the graph of pages", "graph graph édge", "zzz", "an of", "aaa", "token index"):
        for first in (1, 50):
            top, read = ask_top_indexed(index, df, question, "path", first=first)
            want = [tuple(x) for x in search.ask_top(df, question, "path").select("path", "score").collect()]
            assert [tuple(x) for x in top.select("path", "score").collect()] == want
            if first == 50 and question != "an of":
                assert read.count() <= 60
    with pytest.raises(ValueError):
        ask_top_indexed(index, df, "ab", "path")


def test_blocks_by_line_marks(spark):
    """Every block equals the one that splitting the text gives; marks around 100 lines, missing lines, no newline at the end."""
    from codeloom.functions.text import source_block
    from codeloom.sources.lines import marked_block, with_line_marks

    texts = [None, "", "one", "a\n", "\n\n"] + ["\n".join(f"zeile ü {i}" for i in range(n)) + end for n in (99, 100, 101, 250) for end in ("", "\n")] + ["x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, content string")
    spans = [(s, e) for s in (0, 1, 2, 99, 100, 101, 102, 200, 240, 251, 300, 400) for e in (0, 1, 99, 100, 101, 199, 200, 201, 250, 251, 500)]
    asked = spark.createDataFrame(spans, "a int, b int").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(texts) - 1))))
    want = asked.join(df, "k").select("k", "a", "b", source_block(F.coalesce("content", F.lit("")), F.col("a"), F.col("b")).alias("code"))
    marked = with_line_marks(df.withColumn("content", F.coalesce("content", F.lit(""))))
    got = asked.join(marked, "k").select("k", "a", "b", marked_block("content", "marks", F.col("a"), F.col("b")).alias("code"))
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in want.collect()}


def test_many_blocks_of_a_large_file(spark):
    """A thousand blocks of one file of a megabyte."""
    from codeloom.sources.lines import marked_block, with_line_marks

    text = "\n".join(f"line {i} " + "y" * 40 for i in range(20_000))
    assert len(text) > 1_000_000
    marked = with_line_marks(spark.createDataFrame([(text,)], "content string"))
    blocks = marked.withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(20_000), F.lit(20))))
    got = blocks.select("start", marked_block("content", "marks", F.col("start"), F.col("start") + 1).alias("code")).collect()
    lines = text.split("\n")
    assert len(got) == 1000 and all(r["code"] == "\n".join(lines[r["start"] - 1 : r["start"] + 1]) for r in got)
