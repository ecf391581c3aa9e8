"""A folder of pages as a Spark sink, ``df.write.format("site")``: tasks write files, and the whole site appears at once or not at all.

Rows have a ``path`` below the site and a ``content``. Every task writes to a hidden folder beside the site, each file under a name of its own first; what
the driver commits is that folder's name, so a write that fails leaves the old site as it was. The folder must be one that driver and executors see under the
same name. Paths must stay inside the site and differ; a site that is there is replaced with mode ``overwrite`` only.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType


@dataclass
class Written(ds.WriterCommitMessage):
    files: int
    bytes: int


class SiteSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "site"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> SiteWriter:
        if not {"path", "content"} <= set(schema.names):
            raise ValueError("a site needs the columns path and content")
        return SiteWriter(dict(self.options), overwrite)


class SiteWriter(ds.DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        if not options.get("path"):
            raise ValueError("the site sink needs a path")
        self.folder = os.path.abspath(options["path"].removeprefix("file://"))
        if os.path.exists(self.folder) and not overwrite:
            raise ValueError(f"{self.folder} exists; mode overwrite replaces it")
        above, name = os.path.split(self.folder)
        self.staging, self.old = (os.path.join(above, f".{name}.{what}-{uuid.uuid4().hex}") for what in ("new", "old"))

    def write(self, iterator: Iterator[Row]) -> Written:
        n = size = 0
        for row in iterator:
            path = os.path.normpath(row["path"] or "")
            if os.path.isabs(path) or path.split("/")[0] in ("..", ".", ""):
                raise ValueError(f"{row['path']!r} is not a path inside the site")
            to = os.path.join(self.staging, path)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            own = f"{to}.{uuid.uuid4().hex}.part"
            with open(own, "w", encoding="utf-8", newline="") as f:
                f.write(row["content"] or "")
            size += os.path.getsize(own)
            os.replace(own, to)  # a task that runs twice writes the same file twice
            n += 1
        return Written(n, size)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.staging, exist_ok=True)
        there = 0
        for folder, _, names in os.walk(self.staging):
            for name in names:
                if name.endswith(".part"):  # of a task that was lost while writing
                    os.remove(os.path.join(folder, name))
                else:
                    there += 1
        if there != (n := sum(m.files for m in messages if m)):
            self.abort(messages)
            raise ValueError(f"{n} pages have {there} different paths")
        if os.path.exists(self.folder):
            os.rename(self.folder, self.old)
        try:
            os.rename(self.staging, self.folder)
        except OSError:
            if os.path.exists(self.old):
                os.rename(self.old, self.folder)
            raise
        shutil.rmtree(self.old, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)
