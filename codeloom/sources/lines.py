"""Where lines begin: places of every so many lines of a file, so that a block of it is cut out without splitting the whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import truncate

#: Lines between two marks.
EVERY = 100


def with_line_marks(contents: DataFrame, content: str = "content") -> DataFrame:
    """contents with the text as bytes (``content``) and ``marks``: where lines 1, 101, 201 and so on begin, counted from 0. A null text has one empty line."""
    others = [c for c in contents.columns if c != content]
    schema = ", ".join(f"`{c}` {contents.schema[c].dataType.simpleString()}" for c in others)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = []
            for text in b[content]:
                begins = np.append(0, np.flatnonzero(np.frombuffer(text.as_py() or b"", np.uint8) == 10) + 1)
                marks.append(begins[::EVERY].astype(np.int32))
            column = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(m) for m in marks])), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *marks])))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in others), b[content], column], names=[*others, content, "marks"])

    raw = contents.select(*others, F.col(content).cast("binary").alias(content))
    return raw.mapInArrow(marked, f"{schema}{', ' if others else ''}`{content}` binary, marks array<int>")


def marked_block(content: Column | str, marks: Column | str, start: Column, end: Column, limit: int = 3000) -> Column:
    """What ``source_block`` gives, from bytes and marks: only the lines between two marks are looked at."""
    content, marks = (F.col(c) if isinstance(c, str) else c for c in (content, marks))
    first = F.greatest(start, F.lit(1))
    low = F.floor((first - 1) / EVERY).cast("int")
    high = F.ceil(end / EVERY).cast("int")
    size = F.octet_length(content)
    at = F.coalesce(F.get(marks, low), size)
    to = F.coalesce(F.get(marks, high), size + 1)  # a mark stands behind a newline, which is left out
    piece = F.decode(F.substr(content, at + 1, F.greatest(to - at - 1, F.lit(0))), "UTF-8")
    lines = F.split(piece, "\n")
    skip = first - low * EVERY
    code = F.when(F.get(marks, low).isNull() | (end < first), "").otherwise(F.array_join(F.slice(lines, skip, F.greatest(F.least(F.size(lines), end - low * EVERY) - skip + 1, F.lit(0))), "\n"))
    return truncate(code, limit, "\n// ... truncated")
