"""Source files of a project as a DataFrame of file records with their contents."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from codeloom.sources.repo import register


def scan_project(spark: SparkSession, root: str, ignore: Iterable[str] = (), max_file_size: int = 1 << 20, use_git: bool = True) -> DataFrame:
    """(path, language, content_hash, size, modified_at, content) of files in known languages that are not ignored.

    In a git work tree only tracked files count. Folders are listed and files read by tasks (the ``repo`` format), so no list of files passes the driver, and
    filters on path, language and size of what this returns reach the listing.
    """
    register(spark)
    options = {"path": os.path.abspath(root), "ignore": "\n".join(ignore), "maxFileSize": str(max_file_size), "git": str(use_git).lower()}
    return spark.read.format("repo").options(**options).load()
