"""Language ID by nearest centroids of TF-IDF byte n-gram vectors.

Texts are lower-cased (A-Z and U+00C0-U+00DE), ASCII characters other than letters become single spaces, and the 2-, 3- and 4-grams are counted in a hashed space of ``DIMENSIONS``; counts
become 1 + log, times the n-gram's inverse document frequency, and each vector is scaled to length one. Within
each language spherical k-means makes several centroids, because one language has several kinds of text. A
text gets the language of the centroid with the largest cosine. It is rejected when it is farther from that centroid than all but a
``far`` share of the centroid's own training texts, by a factor ``slack``; ``rejected`` says so, and with ``reject`` such a text is ``und``. A text
without any letter is ``und`` always.

The centroids are fitted on about ``max_per_lang`` documents of each language, chosen by a hash of their ids (a
bounded sample; the bound is the parameter), and of the ``max_langs`` most frequent language values, so that a dirty column cannot
make an unbounded model. Prediction reads every row and every whole text, and only the text.

Null and empty texts, and texts without letters, are ``und`` with score 0. Rows with a null language are not learned
from. Without any labelled row everything is ``und``. Ties go to the first language in sorted order. Repeated rows get equal predictions. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import LOWER, pieces, text_bytes

DIMENSIONS = 1 << 14
SIZES = (2, 3, 4)


#: ASCII letters in lower case, spaces for the rest of ASCII.
_PLAIN = np.array([LOWER[c] if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def plain(data: np.ndarray) -> np.ndarray:
    """The text in lower case with one space for each run of what is no letter."""
    x = _PLAIN[data]
    if len(x) > 1:
        capital = np.flatnonzero((x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)) + 1
        x[capital] += 32
        x = x[np.append(True, (x[1:] != 32) | (x[:-1] != 32))]
    return x


def counts(data: np.ndarray) -> np.ndarray:
    """How often each hashed n-gram occurs in one text."""
    x = plain(data).astype(np.uint32)
    total = np.zeros(DIMENSIONS, np.int64)
    h = x
    for n in range(2, max(SIZES) + 1):
        if len(x) < n:
            break
        h = h[:-1] * np.uint32(257) + x[n - 1 :]
        if n in SIZES:
            total += np.bincount((h * np.uint32(2654435761)) >> np.uint32(32 - 14), minlength=DIMENSIONS)
    return total


def vector(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.zeros(len(n), np.float32)
    at = np.flatnonzero(n)
    v[at] = (1 + np.log(n[at])) * idf[at]
    size = float(np.sqrt(v @ v))
    return v / np.float32(size) if size else v


@cache
def _letters() -> regex.Pattern:
    return regex.compile(r"\p{L}")


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def has_letter(data: np.ndarray) -> bool:
    if _ASCII_LETTER[data].any():
        return True
    return bool((data >= 128).any()) and _letters().search(data.tobytes().decode("utf-8", "replace")) is not None


def clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean direction and each next one the vector farthest from all so far."""
    mean = vectors.mean(0)
    centres = [mean / max(float(np.linalg.norm(mean)), 1e-9)]
    near = vectors @ centres[0]
    while len(centres) < min(k, len(vectors)):
        centres.append(vectors[int(np.argmin(near))])
        near = np.maximum(near, vectors @ centres[-1])
    c = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(vectors @ c.T, 1)
        for j in range(len(c)):
            if (own == j).any():
                m = vectors[own == j].sum(0)
                c[j] = m / max(float(np.linalg.norm(m)), 1e-9)
    return c.astype(np.float32)


def fit(docs: DataFrame, where: Column | None = None, max_per_lang: int = 400, k: int = 4, max_langs: int = 500, far: float = 0.01, slack: float = 0.8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Centroids of each language; ``where`` is a condition on ``id``. One task for each language clusters its sample."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and lang is not null")
    if where is not None:
        rows = rows.where(where)
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs)
    # The hash of the id is even over its range, so a share of the range takes about that share of the rows.
    share = F.least(F.lit(1.0), F.lit(float(max_per_lang)) / F.col("count"))
    chosen = rows.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text").where("text is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIMENSIONS, np.int64)
        for b in batches:
            data, off = text_bytes(b[1])
            for i in range(len(b)):
                df += counts(data[off[i] : off[i + 1]]) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tobytes()])], names=["n", "df"])

    parts = chosen.repartition(8).mapInArrow(frequencies, "n long, df binary").collect()
    n = sum(r["n"] for r in parts)
    df = sum((np.frombuffer(r["df"], np.int64) for r in parts), np.zeros(DIMENSIONS, np.int64))
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.05)

    def centroids(table: pa.Table) -> pa.Table:
        data, off = text_bytes(table["text"])
        v = np.stack([vector(counts(data[off[i] : off[i + 1]]), idf) for i in range(len(table))])
        c = clusters(v[np.lexsort(v[:, :64].T)], k)  # in an order that does not depend on the shuffle
        cosine = v @ c.T
        own, near = np.argmax(cosine, 1), cosine.max(1)
        limits = np.array([slack * np.quantile(near[own == j], far) if (own == j).any() else 0 for j in range(len(c))], np.float32)
        return pa.table({"lang": [table["lang"][0].as_py()], "n": pa.array([len(c)], pa.int64()), "centres": [c.tobytes()], "limits": [limits.tobytes()]})

    found = sorted(chosen.groupBy("lang").applyInArrow(centroids, "lang string, n long, centres binary, limits binary").collect(), key=lambda r: r["lang"])
    c = [np.frombuffer(r["centres"], np.float32).reshape(r["n"], DIMENSIONS) for r in found]
    return {"langs": [r["lang"] for r, x in zip(found, c, strict=True) for _ in x], "centres": np.concatenate(c) if c else np.zeros((0, DIMENSIONS), np.float32), "limits": np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(r["limits"], np.float32) for r in found)]), "idf": idf}


def predict(docs: DataFrame, model: dict, reject: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row; the score is the largest cosine, cut to 0..1. reject: rejected texts are ``und``, with score 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, centres, limits, idf = model["langs"], model["centres"], model["limits"], model["idf"]
        for b in batches:
            data, off = text_bytes(b[1])
            for lo, hi in pieces(off):
                said, scores, rejected = [], [], []
                for i in range(lo, hi):
                    text = data[off[i] : off[i + 1]]
                    lang, best, out = "und", 0.0, True
                    if len(langs) and has_letter(text):
                        cosine = centres @ vector(counts(text), idf)
                        j = int(np.argmax(cosine))
                        out = bool(cosine[j] < limits[j])
                        if not (out and reject):
                            lang, best = langs[j], float(cosine[j])
                    said.append(lang)
                    scores.append(min(max(best, 0.0), 1.0))
                    rejected.append(out)
                yield pa.RecordBatch.from_arrays([b[0].slice(lo, hi - lo), pa.array(said, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["id", "lang_pred", "score", "rejected"])

    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return frame.mapInArrow(run, "id long, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
