"""Toxicity: a logistic classifier whose scores are held still when identity terms are swapped.

Features are whether a text has a word, or a word that begins with given 4, 5 or 6 bytes (so that endings
do not matter). The words that tell the labels apart best are chosen on the training rows; identity terms
are always among them, because the penalty is about them. For every training text that names a group, and for
carrier sentences about each group, the identity terms are replaced by those of another group; the loss adds
``weight`` times the squared change of the score, so a group's name itself cannot count as toxic.

It learns from at most about ``max_rows`` labelled rows, those with the smallest hashes of their ids (a bounded sample; the
bound is the parameter). Scoring reads every row and every whole text, and only the text.

A null or empty text gets the score of no features. Rows without a label, or with a null label, are not learned
from; if a document has several labels, one that says toxic counts. Without any labelled rows the score is 0.
Long texts are read whole, in blocks. Repeated rows are scored each for itself. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import LOWER, Spans, U, mix, pieces, text_bytes, word_bounds
from ._spark import released

#: Groups whose members can stand for each other in a sentence.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("mother", "father"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"), ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "arab"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"), ("disabled", "deaf", "blind", "autistic"), ("old", "young", "elderly", "teenage"),
    ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs"), ("frauen", "männer"), ("christen", "muslime", "juden"), ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"),
)
#: Neutral mentions; each is read with every identity term in its place.
CARRIERS = ("{}", "the {} are here", "{} live in this town", "we met many {} today", "a story about {}")
PREFIXES = (4, 5, 6)
#: Bytes that do not belong to words; all of ASCII but letters and digits.
_BREAK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_SPACED = np.where(_BREAK, 32, LOWER).astype(np.uint8)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and word beginnings of many rows, and the row of each."""
    data = _SPACED[data]
    start, end, first = word_bounds(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    spans = Spans(data)
    out, rows = [spans.hash(start, end)], [row]
    for k in PREFIXES:
        long = np.flatnonzero(end - start >= k)
        out.append(mix(spans.hash(start[long], start[long] + k) ^ U(k)))
        rows.append(row[long])
    return np.concatenate(out), np.concatenate(rows)


def distinct_features(texts: list[bytes]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for t in texts:
        data = np.frombuffer(t, np.uint8)
        parts = [np.zeros(0, U)]
        if len(data):
            parts.append(features(data, np.array([0, len(data)]))[0])
        out.append(np.unique(np.concatenate(parts)))
    return out


def swap_terms(text: bytes, other: dict[bytes, bytes]) -> bytes:
    """The text with each identity term replaced by another of its group; the same bytes if it has none."""
    words = _SPACED[np.frombuffer(text, np.uint8)].tobytes().split(b" ")
    if not any(w in other for w in words):
        return text
    return b" ".join(other.get(w, w) for w in words)


def counted(sets: list[np.ndarray], labels: np.ndarray, step: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All features, in how many sets each is, and the sum of these sets' labels; some sets at a time, as they repeat each other."""
    parts = []
    for lo in range(0, len(sets), step):
        some = sets[lo : lo + step]
        own, at = np.unique(np.concatenate(some), return_inverse=True)
        parts.append((own, np.bincount(at, minlength=len(own)), np.bincount(at, np.repeat(labels[lo : lo + step], list(map(len, some))), len(own))))
    every, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return every, np.bincount(at, np.concatenate([p[1] for p in parts]), len(every)), np.bincount(at, np.concatenate([p[2] for p in parts]), len(every))


def objective(w: np.ndarray, b: float, x: tuple, labels: np.ndarray, share: np.ndarray, pairs_a: tuple, pairs_b: tuple, m: int, weight: float, decay: float) -> tuple[float, np.ndarray, float]:
    """The loss and its gradient by weights and bias: cross entropy, decay, and ``weight`` times the mean squared change of the score over m swapped pairs.

    x, pairs_a, pairs_b: (row, feature) of the training texts and of both sides of the pairs; share: what each text counts.
    """
    times = lambda at, n: np.bincount(at[0], w[at[1]], n)
    z = np.clip(times(x, len(labels)) + b, -30, 30)
    e = (1 / (1 + np.exp(-z)) - labels) * share
    d = times(pairs_a, m) - times(pairs_b, m)
    loss = float((share * (np.logaddexp(0, z) - labels * z)).sum() + decay / 2 * (w @ w) + weight / m * (d @ d))
    gw = np.bincount(x[1], e[x[0]], len(w)) + decay * w
    gw += 2 * weight / m * (np.bincount(pairs_a[1], d[pairs_a[0]], len(w)) - np.bincount(pairs_b[1], d[pairs_b[0]], len(w)))
    return loss, gw, float(e.sum())


def train(texts: list[bytes], labels: np.ndarray, n_features: int = 3000, weight: float = 4.0, decay: float = 1e-3, steps: int = 300) -> dict:
    """Sorted feature hashes, their weights and the bias."""
    empty = {"hashes": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": -30.0}
    if not len(texts):
        return empty
    labels = np.asarray(labels, float)
    terms = [t.encode() for g in IDENTITY_TERMS for t in g]
    other = {a.encode(): b.encode() for g in IDENTITY_TERMS for a, b in zip(g, g[1:] + g[:1], strict=True)}
    sets = distinct_features(texts)
    every, n, n1 = counted(sets, labels)
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    # A score test of each feature alone; beginnings that few texts share tell nothing.
    z = (n1 - n * rate) / np.sqrt(n * rate * (1 - rate) * (1 - n / (len(labels) + 1)) + 1e-9)
    z[n < min(4, max(1, len(labels) // 50))] = 0
    top = np.argsort(-np.abs(z), kind="stable")[:n_features]
    top = top[np.abs(z[top]) > 3]
    hashes = np.unique(np.concatenate([every[top], *distinct_features(terms)]))
    del every, n, n1, z

    def matrix(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate([np.zeros(0, U), *sets])
        rows = np.repeat(np.arange(len(sets)), list(map(len, sets)))
        col = np.minimum(np.searchsorted(hashes, flat), len(hashes) - 1)
        hit = hashes[col] == flat
        return rows[hit], col[hit]

    x = matrix(sets)
    swapped = [(i, s) for i, t in enumerate(texts) if (s := swap_terms(t, other)) != t]
    plain = [t for c in CARRIERS for t in (c.format(g[i]).encode() for g in IDENTITY_TERMS for i in range(len(g)))]
    pairs_a = matrix([sets[i] for i, _ in swapped] + distinct_features(plain))
    pairs_b = matrix(distinct_features([s for _, s in swapped] + [swap_terms(t, other) for t in plain]))
    m = len(swapped) + len(plain)
    w, b = np.zeros(len(hashes)), float(np.log(rate / (1 - rate)))
    share = np.where(labels > 0, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))  # both labels weigh the same
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        _, gw, gb = objective(w, b, x, labels, share, pairs_a, pairs_b, m, weight, decay)
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        k, c = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.05 * (mw / k) / (np.sqrt(vw / c) + 1e-8)
        b -= 0.05 * (mb / k) / (np.sqrt(vb / c) + 1e-8)
    return {"hashes": hashes.view(np.int64), "weights": w, "bias": b}


def score_rows(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scores of many rows: each feature of the model counts once if the row has it."""
    n = len(offsets) - 1
    z = np.full(n, model["bias"])
    hashes = model["hashes"].view(U)
    if len(hashes) and len(data):
        if "slots" not in model:
            model["slots"] = slots = np.full(1 << 16, False)
            slots[(hashes >> U(48)).astype(np.int64)] = True
        h, row = features(data, offsets)
        maybe = model["slots"][(h >> U(48)).astype(np.int64)]
        h, row = h[maybe], row[maybe]
        col = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[col] == h
        seen = np.unique(row[hit] * len(hashes) + col[hit])
        z += np.bincount(seen // len(hashes), model["weights"][seen % len(hashes)], n)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, max_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Learn from labelled rows; ``where`` is a condition on ``id``. One task trains, and the driver gets the model alone."""
    ids = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    if where is not None:
        ids = ids.where(where)
    ids = ids.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).join(F.broadcast(ids), F.col("key") == F.col("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(((i, (t or "").encode(), y) for b in batches for i, t, y in zip(*(b[k].to_pylist() for k in range(3)), strict=True)), key=lambda r: (r[0], r[1]))
        m = train([r[1] for r in found], np.array([r[2] for r in found], float))
        yield pa.RecordBatch.from_arrays([pa.array([m["hashes"].tobytes()]), pa.array([m["weights"].tobytes()]), pa.array([m["bias"]])], names=["hashes", "weights", "bias"])

    row = rows.select("id", "text", "y").repartition(1).mapInArrow(released(run), "hashes binary, weights binary, bias double").head()
    if row is None:
        return train([], np.zeros(0))
    return {"hashes": np.frombuffer(row["hashes"], np.int64), "weights": np.frombuffer(row["weights"]), "bias": row["bias"]}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = dict(model)
        for b in batches:
            data, off = text_bytes(b[1])
            for lo, hi in pieces(off):
                p = score_rows(own, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays([b[0].slice(lo, hi - lo), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return frame.mapInArrow(released(run), "id long, score double, predicted int").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs without the rows whose score is 0.5 or more."""
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = dict(model)
        for b in batches:
            data, off = text_bytes(b[at])
            for lo, hi in pieces(off):
                p = score_rows(own, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                yield b.slice(lo, hi - lo).filter(pa.array(p < 0.5))

    return docs.mapInArrow(released(clean), docs.schema)
