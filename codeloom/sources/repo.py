"""A project's files as a Spark data source, ``spark.read.format("repo")``: folders are listed, filtered and read by tasks.

The driver only looks at the uppermost folders, level by level, until there are enough of them to deal out. Each task walks its own folder: ignored folders are not
entered, and files that filters on path, language or size rule out are not opened. In a git work tree a task asks git for the tracked files of its
folder. The folder must be one that driver and executors see under the same name.

Options: ``path``; ``ignore``, patterns one to a line, beside the defaults and the project's .gitignore; ``maxFileSize`` (bytes, 1 MiB);
``git`` (true: only tracked files, where there is a work tree); ``folders``, how many to deal out at least (64).
"""

from __future__ import annotations

import datetime
import hashlib
import os
import re
import subprocess
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from codeloom.functions.text import EXTENSIONS
from codeloom.sources.ignore import IgnoreRules, gitignore_lines

SCHEMA = "path string, language string, content_hash string, size long, modified_at timestamp, content string"
ARROW = pa.schema([("path", pa.string()), ("language", pa.string()), ("content_hash", pa.string()), ("size", pa.int64()), ("modified_at", pa.timestamp("us", tz="UTC")), ("content", pa.string())])
#: Characters of content in one batch of rows.
BATCH = 8 << 20


class Folder(ds.InputPartition):
    """A folder, relative to the root; deep: with everything below it."""

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class RepoSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RepoReader:
        return RepoReader(dict(self.options))


#: Filters on columns that are known before a file is opened.
KNOWN = ("path", "language", "size")
TESTS = {
    ds.EqualTo: lambda a, b: a == b,
    ds.In: lambda a, b: a in b,
    ds.GreaterThan: lambda a, b: a > b,
    ds.GreaterThanOrEqual: lambda a, b: a >= b,
    ds.LessThan: lambda a, b: a < b,
    ds.LessThanOrEqual: lambda a, b: a <= b,
    ds.StringStartsWith: lambda a, b: a.startswith(b),
    ds.StringEndsWith: lambda a, b: a.endswith(b),
    ds.StringContains: lambda a, b: b in a,
}


class RepoReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("the repo source needs a path")
        self.root = os.path.abspath(options["path"].removeprefix("file://"))
        lower = {k.lower(): v for k, v in options.items()}
        self.max_size = int(lower.get("maxfilesize", 1 << 20))
        self.least = int(lower.get("folders", 64))
        self.patterns = [p for p in lower.get("ignore", "").split("\n") if p]
        try:
            with open(os.path.join(self.root, ".gitignore"), encoding="utf-8") as f:
                self.patterns += gitignore_lines(f.read())
        except OSError:
            pass
        self.git = lower.get("git", "true").lower() == "true" and self.in_work_tree()
        self.tests: list[tuple[str, str, object]] = []

    def in_work_tree(self) -> bool:
        try:
            run = subprocess.run(["git", "-C", self.root, "rev-parse", "--is-inside-work-tree"], capture_output=True, check=True)
        except (OSError, subprocess.CalledProcessError):
            return False
        return run.stdout.strip() == b"true"

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in KNOWN:
                self.tests.append((f.attribute[0], type(f).__name__, f.value))
            elif not (isinstance(f, ds.IsNotNull) and f.attribute[0] in KNOWN):  # these are never null
                yield f

    def partitions(self) -> list[Folder]:
        """The folders to deal out: a level is looked at only while there are too few."""
        rules = IgnoreRules(self.patterns)
        done, level = [], [""]
        while level and len(done) + len(level) < self.least:
            done += [Folder(p, False) for p in level]
            level = [q for p in level for q in self.folders(p, rules)]
        return done + [Folder(p, True) for p in level]

    def folders(self, folder: str, rules: IgnoreRules) -> list[str]:
        return sorted(f"{folder}/{e.name}".lstrip("/") for e in self.entries(folder) if e.is_dir(follow_symlinks=False) and not rules.prunable(f"{folder}/{e.name}".lstrip("/")))

    def entries(self, folder: str) -> list[os.DirEntry]:
        try:
            with os.scandir(os.path.join(self.root, folder)) as found:
                return list(found)
        except OSError:  # what can't be read is passed over
            return []

    def paths(self, part: Folder, rules: IgnoreRules) -> Iterator[str]:
        """Relative paths of a partition's files."""
        if self.git:
            within = re.sub(r"([][*?\\])", r"\\\1", f"{part.path}/" if part.path else "")
            where = f":(glob){within}{'**' if part.deep else '*'}"
            run = subprocess.run(["git", "-C", self.root, "ls-files", "-z", "--", where], capture_output=True, check=True)
            yield from (p for p in run.stdout.decode("utf-8", "replace").split("\0") if p)
            return
        todo = [part.path]
        while todo:
            folder = todo.pop()
            for e in self.entries(folder):
                path = f"{folder}/{e.name}".lstrip("/")
                if e.is_dir(follow_symlinks=False):
                    if part.deep and not rules.prunable(path):
                        todo.append(path)
                elif e.is_file():
                    yield path

    def wanted(self, **known) -> bool:
        by_name = {k.__name__: f for k, f in TESTS.items()}
        return all(by_name[test](known[column], value) for column, test, value in self.tests if column in known)

    def read(self, part: Folder) -> Iterator[pa.RecordBatch]:
        rules = IgnoreRules(self.patterns)
        rows, held = [], 0
        for path in self.paths(part, rules):
            language = EXTENSIONS.get(path.rpartition(".")[2].lower(), "unknown")
            if language == "unknown" or rules.ignored(path) or not self.wanted(path=path, language=language):
                continue
            full = os.path.join(self.root, path)
            try:
                stat = os.stat(full)
                if not os.path.isfile(full) or stat.st_size > self.max_size or not self.wanted(size=stat.st_size):
                    continue
                with open(full, "rb") as f:
                    content = f.read().decode("utf-8", "replace")
            except OSError:
                continue
            when = datetime.datetime.fromtimestamp(stat.st_mtime, datetime.timezone.utc)
            rows.append((path, language, hashlib.sha256(content.encode()).hexdigest()[:12], stat.st_size, when, content))
            held += len(content)
            if held > BATCH:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW, strict=True)], schema=ARROW)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, with filters given to them."""
    from codeloom.sources.site import SiteSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepoSource)
    spark.dataSource.register(SiteSource)
