"""Names, paths, hashes and words as Column expressions; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages by file extension.
EXTENSIONS = {
    "ts": "typescript", "tsx": "tsx", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "jsx", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python", "go": "go", "rs": "rust", "java": "java", "cs": "csharp", "kt": "kotlin", "swift": "swift", "rb": "ruby", "php": "php",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "c", "c": "c",
}


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column, or nulls where a table lacks it."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def detect_language(path: Column | str) -> Column:
    """The language of a path's extension, or ``unknown``."""
    table = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.substring_index(column(path), ".", -1))), F.lit("unknown"))


def dirname(path: Column | str) -> Column:
    return F.regexp_replace(column(path), r"/?[^/]*$", "")


def basename(path: Column | str) -> Column:
    return F.substring_index(column(path), "/", -1)


def short_path(path: Column | str) -> Column:
    """The last two parts of longer paths."""
    p = column(path)
    return F.when(F.size(F.split(p, "/")) > 2, F.concat(F.lit(".../"), F.substring_index(p, "/", -2))).otherwise(p)


def sanitize_id(name: Column | str) -> Column:
    return F.regexp_replace(column(name), "[^a-zA-Z0-9]", "_")


def slug(title: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(column(title)), "[^a-z0-9]+", "-"), "^-|-$", "")


def page_path(number: Column | str, title: Column | str) -> Column:
    return F.concat(column(number), F.lit("-"), slug(title), F.lit(".md"))


def repo_slug(url: Column | str) -> Column:
    """A URL's path as one name, without ``.git`` and ``_git``."""
    path = F.regexp_replace(F.regexp_extract(column(url), r"^[a-zA-Z]+://[^/]+([^?#]*)", 1), r"\.git$", "")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "_git"))
    return F.regexp_replace(F.regexp_replace(F.lower(F.array_join(parts, "-")), "[^a-z0-9-]+", "-"), "^-+|-+$", "")


def number_order(number: Column | str) -> Column:
    """What orders section numbers: 2, 2.1, 10."""
    return F.transform(F.split(column(number), r"\."), lambda x: x.try_cast("int"))


def dotted_tail(name: Column | str) -> Column:
    return F.substring_index(column(name), ".", -1)


def make_id(path: Column | str, qualified_name: Column | str) -> Column:
    """The first 16 hex digits of the SHA-256 of ``path::qualified_name``."""
    return F.substring(F.sha2(F.concat_ws("::", column(path), column(qualified_name)), 256), 1, 16)


def content_hash(text: Column | str) -> Column:
    return F.substring(F.sha2(column(text), 256), 1, 12)


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(column(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def camel_words(name: Column | str) -> Column:
    """The lower-case parts of a camelCase name."""
    return F.split(F.lower(F.regexp_replace(column(name), "([A-Z])", " $1")), r"[^a-zA-Z0-9_]+")


def truncate(text: Column | str, n: int, suffix: str = "") -> Column:
    t = column(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(suffix))).otherwise(t)


def occurrences(text: Column, term: str) -> Column:
    """How often a term occurs, matches not overlapping."""
    if not term:
        return F.lit(0)
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("long")


def source_block(text: Column | str, start: Column, end: Column, limit: int = 3000) -> Column:
    """Lines start to end (from 1), cut after ``limit`` characters with a note."""
    lines = F.split(column(text), "\n")
    first = F.greatest(start, F.lit(1))
    code = F.array_join(F.slice(lines, first, F.greatest(F.least(F.size(lines), end) - first + 1, F.lit(0))), "\n")
    return truncate(code, limit, "\n// ... truncated")


def fold_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` parts; ``..`` above the top is dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(parts, empty, lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(folded, "/")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
