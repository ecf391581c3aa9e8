"""Scores of pages for questions from counts of byte trigrams: most pages are ruled out without being read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.search import ask_scores


def grams_of(text: bytes) -> np.ndarray:
    """The trigrams of a text as numbers, in order."""
    b = np.frombuffer(text, np.uint8).astype(np.int32)
    return (b[:-2] << 16) | (b[1:-1] << 8) | b[2:] if len(b) > 2 else np.zeros(0, np.int32)


def trigram_index(pages: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(gram, key, n): how often each page has each trigram of its lower-case text. Null and short texts have none."""
    kind = pages.schema[key].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                gram, n = np.unique(grams_of(b["text"][i].as_py() or b""), return_counts=True)
                if len(gram):
                    keys = b[key].take(pa.array(np.full(len(gram), i)))
                    yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int32()), keys, pa.array(n, pa.int32())], names=["gram", key, "n"])

    return pages.select(key, F.lower(content).cast("binary").alias("text")).mapInArrow(counted, f"gram int, {key} {kind}, n int")


def score_bounds(index: DataFrame, question: str, key: str) -> DataFrame:
    """(key, bound) of pages that can have a score: a term is in a page at most as often as its rarest trigram is.

    Pages that are left out have no term of the question.
    """
    lower = question.lower()
    terms = [t for t in lower.split() if len(t) > 2]
    wanted = {(k, int(g)) for k, t in enumerate(terms) for g in grams_of(t.encode())} | {(-1, int(g)) for g in grams_of(lower.encode())}
    asked = index.sparkSession.createDataFrame(sorted(wanted), "term int, gram int")  # as few as the question has
    sizes = asked.groupBy("term").agg(F.count("*").alias("size"))
    met = index.join(F.broadcast(asked), "gram").groupBy(key, "term").agg(F.min("n").alias("least"), F.count("*").alias("found"))
    whole = met.join(F.broadcast(sizes), "term").where("found = size")
    worth = F.when(F.col("term") == -1, F.lit(50)).otherwise(F.col("least").cast("long"))
    return whole.groupBy(key).agg(F.sum(worth).alias("bound"))


def ask_top_indexed(index: DataFrame, pages: DataFrame, question: str, key: str, content: str = "content", limit: int = 5, first: int = 50) -> tuple[DataFrame, DataFrame]:
    """The rows of ``ask_top``, and the keys of the pages that were read for them.

    Pages with the highest bounds are scored first; the score of the last one that is asked for is what the bounds of all others must reach to be scored, too.
    """
    if len(question.strip()) < 3:
        raise ValueError("a question of less than three characters has no trigram")
    bounds = score_bounds(index, question, key)
    best = bounds.orderBy(F.desc("bound"), key).limit(first)
    scored = ask_scores(pages.join(F.broadcast(best.select(key)), key, "left_semi"), question, content)  # ``first`` keys
    kth = scored.where("score > 0").orderBy(F.desc("score"), key).limit(limit).agg(F.count("*").alias("n"), F.min("score").alias("least")).head()
    least = kth["least"] if kth["n"] == limit else 1
    reading = bounds.where(F.col("bound") >= least).select(key)
    out = ask_scores(pages.join(reading, key, "left_semi"), question, content).where("score > 0")
    return out.orderBy(F.desc("score"), key).limit(limit), reading
