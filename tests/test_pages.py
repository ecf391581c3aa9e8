"""Page texts, questions and the job table."""

from pyspark.sql import functions as F

from codeloom.operators import jobs
from codeloom.plans import pages


def test_jobs(spark, tmp_path):
    (tmp_path / "jobs.json").write_text('[{"id": "a", "status": "queued", "created_at": 1}, {"id": "b", "status": "ready", "created_at": 2}]')
    old = jobs.load_jobs(spark, str(tmp_path / "jobs.json"))
    new = spark.createDataFrame([("a", "failed", 3)], "id string, status string, created_at long")
    got = jobs.recent_jobs(jobs.upsert_jobs(old, new)).select("id", "status").collect()
    assert [tuple(r) for r in got] == [("a", "failed"), ("b", "ready")]
    jobs.save_jobs(old, str(tmp_path / "table"))
    jobs.update_jobs(spark, str(tmp_path / "table"), new)
    assert {r.id: r.status for r in jobs.load_jobs(spark, str(tmp_path / "table")).collect()} == {"a": "failed", "b": "ready"}
    urls = {"https://github.com/a/b": True, "http://x@gitlab.com/a": True, "ftp://github.com/a": False, "https://example.com/github.com": False}
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", jobs.valid_repo_url("url").alias("ok")).collect()
    assert {r.url: r.ok for r in rows} == urls


def test_page_texts(spark):
    nodes = spark.createDataFrame([("c", "class", "C", "a.ts", "typescript", 1, 3, 0), ("d", "class", "D", "a.ts", "typescript", 4, 4, 1)], "id string, kind string, name string, file_path string, language string, start_line int, end_line int, ord long")
    focal = spark.createDataFrame([("1", "c", 0), ("1", "d", 1)], "number string, id string, pos int")
    contents = spark.createDataFrame([("a.ts", "class C {\n" + " x" * 40 + "\n}\nclass D {}")], "path string, content string")
    blocks = pages.source_blocks(focal, nodes, contents)
    text = pages.key_snippets(blocks, nodes).head().text
    assert text.startswith("[class: C] a.ts:1-3\n```typescript\nclass C {") and "D" not in text
    h = spark.createDataFrame([("c", "d", "extends", 1)], "root string, id string, role string, depth int")
    assert pages.hierarchy_lines(h, nodes).head().line == "  Extends: D (a.ts)"
    p = spark.range(1).select(F.lit("1").alias("number"), pages.prompt(F.lit("T"), F.lit("D"), ("A", F.lit("x")), ("B", F.lit(None).cast("string"))).alias("prompt"))
    assert pages.generate(p).head().content == "# T\n\nD\n\n## A\n\nx"
    assert pages.generate(p, lambda s: s.upper()).head().content == "# T\n\nD\n\n## A\n\nX"


def test_ask(spark):
    site = spark.createDataFrame([("a.md", "A", "tax law"), ("b.md", "B", "other")], "filename string, title string, content string")
    answer, sources = pages.ask(site, "tax", lambda q, c: f"{q}: {len(c) > 0}")
    assert answer == "tax: True" and sources == [("a.md", "A")]
    assert pages.ask(site, "zzz")[1] == []
