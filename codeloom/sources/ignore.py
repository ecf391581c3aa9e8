"""Ignore patterns compiled to one Column expression."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.text import any_of, column

# What is ignored in every source tree.
DEFAULT_PATTERNS = (
    "node_modules", "dist", "build", "out", ".git", ".hg", ".svn", "__pycache__", ".pytest_cache", ".mypy_cache", "venv", ".venv", "env", ".env", ".tox",
    "coverage", ".coverage", ".nyc_output", ".next", ".nuxt", ".cache", ".parcel-cache", ".turbo", "vendor", "target", ".gradle", ".idea", ".vscode", ".DS_Store", "Thumbs.db",
    "*.min.js", "*.min.css", "*.map", "*.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "*.pb.go", "*.generated.*",
)


def pattern_regex(pattern: str) -> str | None:
    """The regular expression of a glob over a whole path; None for plain endings (``*.ext``).

    A pattern without a slash is about any part of the path, another one about the path from its start; what lies below a match
    belongs to it. ``**`` crosses slashes. In brackets stands a set of characters.
    """
    p = pattern.removesuffix("/")
    if p.startswith("*."):
        return None
    out, i = "", 0
    while i < len(p):
        c = p[i]
        if p.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in p[i:]:
            end = p.index("]", i)
            out, i = out + p[i : end + 1], end + 1
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    if "/" in p or "**" in p:
        return f"^{out}(/.*)?$"
    return f"(^|/){out}(/|$)"


def matches(path: Column, pattern: str) -> Column:
    p = pattern.removesuffix("/")
    regex = pattern_regex(p)
    if regex is None:
        return F.endswith(path, F.lit(p[1:]))
    if not set("*?[/") & set(p):
        return F.array_contains(F.split(path, "/"), p)
    return path.rlike(regex)


def gitignore_lines(text: str) -> list[str]:
    return [x for line in text.split("\n") if (x := line.strip()) and not x.startswith("#")]


def ignore_predicate(path: Column | str, patterns: Iterable[str] = (), defaults: bool = True) -> Column:
    """Whether a path is ignored: any pattern matches, and none of those with ``!``; their order does not matter."""
    every = [*(DEFAULT_PATTERNS if defaults else ()), *patterns]
    c = column(path)
    plus = any_of([matches(c, p) for p in every if not p.startswith("!")])
    minus = any_of([matches(c, p[1:]) for p in every if p.startswith("!")])
    return plus & ~minus


class IgnoreRules:
    """The same rules for single paths, as tasks ask them while they list folders."""

    def __init__(self, patterns: Iterable[str] = (), defaults: bool = True):
        every = [*(DEFAULT_PATTERNS if defaults else ()), *patterns]
        self.plus = [self.rule(p) for p in every if not p.startswith("!")]
        self.minus = [self.rule(p[1:]) for p in every if p.startswith("!")]

    @staticmethod
    def rule(pattern: str) -> tuple[str | None, re.Pattern | None]:
        """An ending, or an expression."""
        regex = pattern_regex(pattern)
        return (pattern.removesuffix("/")[1:], None) if regex is None else (None, re.compile(regex))

    @staticmethod
    def hit(rules: list, path: str, endings: bool = True) -> bool:
        return any(path.endswith(end) if regex is None else regex.search(path) for end, regex in rules if endings or regex is not None)

    def ignored(self, path: str) -> bool:
        return self.hit(self.plus, path) and not self.hit(self.minus, path)

    def prunable(self, folder: str) -> bool:
        """Whether everything below a folder is ignored: a rule other than an ending is about it, and no rule with ``!`` can bring anything back."""
        return not self.minus and self.hit(self.plus, folder, endings=False)
