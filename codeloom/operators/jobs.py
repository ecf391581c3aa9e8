"""The table of generation jobs: reading, keyed merge, order, and which repository addresses are taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.checkpoints import cut
from codeloom.functions.text import any_of, column

# States of a job, in order, and hosts whose repositories are taken.
STATES = ("queued", "cloning", "indexing", "generating", "deploying", "ready", "failed")
HOSTS = ("github.com", "gitlab.com", "bitbucket.org", "dev.azure.com", "visualstudio.com")


def load_jobs(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array, whatever its lines, or a folder of ``save_jobs``."""
    return spark.read.json(path, multiLine=path.endswith(".json"))


def save_jobs(jobs: DataFrame, path: str) -> None:
    """Write the table of jobs to a folder that ``load_jobs`` reads; it may be the one that the rows came from."""
    cut(jobs).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def update_jobs(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Read the jobs of a folder, put new rows in place of those of the same id, and write them back."""
    save_jobs(upsert_jobs(load_jobs(spark, path), new), path)


def upsert_jobs(jobs: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """jobs with the rows of new in place of those of the same key."""
    return jobs.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def recent_jobs(jobs: DataFrame, created: str = "created_at", key: str = "id") -> DataFrame:
    return jobs.orderBy(F.desc(created), key)


def valid_repo_url(url: Column | str, hosts: tuple[str, ...] = HOSTS) -> Column:
    host = F.lower(F.regexp_extract(column(url), r"^[hH][tT]{2}[pP][sS]?://(?:[^/@]*@)?([^/:?#]+)", 1))
    return any_of([F.contains(host, F.lit(h)) for h in hosts])
