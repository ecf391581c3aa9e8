"""Language-model scores from a causal self-attention model in numpy, beside a word-count baseline.

Texts are lower-cased (A-Z) and cut into words; the model reads the words, each after a space, as subword ids of a
public byte-level tokenizer, and an end. One attention layer with a learned bias for each distance sees at most ``WINDOW`` ids;
windows overlap by ``OVERLAP``, so each id is scored once and, after the first window, with at least that much before it.
Windows of many texts are run together under one causal mask. The next id is predicted in two steps, its class by a softmax over
classes and the id within the class by a softmax over the class's members; ids without a place of their own share one class, by
their counts. Ids are counted over all training texts, and classes are made of these counts.

The model is trained by Adam, with gradients worked out by hand: it starts on the ``max_docs`` training texts with the smallest hashes
of their ids and then reads every training text once, in ``rounds`` rounds. In a round each task goes on from the same
parameters over its own texts of that round, and the mean of the tasks' parameters, by targets read, is what the next round begins with.
Texts are encoded once, and their ids are written for all who read them. The baseline's counts are taken over all training texts: each task
adds up its words, sums meet by word hash, words with at least N / ``frequent`` occurrences (there are at most ``frequent``) are
sent to every task, and the others are looked up where their counts are.

A null or empty text has the end as its only token. Repeated rows (same id and text) get equal scores, up to rounding in single precision. Rows without an id are
scored; they are not learned from. Texts of any length are scored whole. With nothing to learn from, c, N and V are 0 and the model is
uniform. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from ._arrays import LOWER, Spans, U, mix, pieces, text_bytes, word_bounds
from ._spark import cut, even_labels, partitions

WINDOW, OVERLAP, WIDTH = 32, 8, 16
#: Ids with a place of their own; of these the first have a class of their own too.
KNOWN, SINGLE, CLASSES = 4096, 56, 96
END_WORD = mix(np.array([0x656E64], U))[0]
COUNT = np.dtype([("hash", "<u8"), ("c", "<i8")])
ASK = np.dtype([("hash", "<u8"), ("n", "<u4"), ("d", "<u2")])
SUM = np.dtype([("row", "<i8"), ("score", "<f8"), ("known", "<i8")])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and each row's first word."""
    start, end, first = word_bounds(data, offsets)
    return Spans(data, lower=True).hash(start, end), first


def row_keys(ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each row's id and text."""
    i = ids.fill_null(-(2**63)).to_numpy().astype(np.int64).view(U)
    return mix(mix(i) ^ Spans(data).hash(offsets[:-1], offsets[1:])).view(np.int64)


# --- the model ----------------------------------------------------------------------------------------------------


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words in lower case, each after one space, and the rows' offsets in that."""
    start, end, first = word_bounds(data, offsets)
    size = end - start + 1
    at = np.append(0, np.cumsum(size))
    out = LOWER[data[np.maximum(np.repeat(start - 1 - at[:-1], size) + np.arange(at[-1]), 0)]] if len(start) else np.zeros(0, np.uint8)
    out[at[:-1]] = 32
    return out, at[first]


def vocabulary(count: np.ndarray) -> dict[str, np.ndarray]:
    """For every id its symbol (input), class and place in the class, from its count; the last id is the end."""
    size = len(count)
    order = np.argsort(-count, kind="stable")
    seen = int((count > 0).sum())
    known = min(KNOWN, seen)
    symbol, cls, place = np.full(size, KNOWN, np.int32), np.full(size, CLASSES - 1, np.int32), np.zeros(size, np.int32)
    symbol[order[:known]] = np.arange(known)
    single = min(SINGLE, known)
    cls[order[:single]] = np.arange(single)
    if known > single:
        # The others share classes of about equal frequency.
        mass = np.cumsum(count[order[single:known]].astype(float))
        cls[order[single:known]] = single + np.minimum((mass / mass[-1] * (CLASSES - 1 - single)).astype(np.int64), CLASSES - 2 - single)
    by = np.lexsort((np.arange(size), cls))
    start = np.searchsorted(cls[by], np.arange(CLASSES))
    place[by] = np.arange(size) - start[cls[by]]
    members = np.bincount(cls, minlength=CLASSES)
    share = np.log(count + 0.5)
    share -= np.log(np.bincount(cls, count + 0.5, CLASSES) + 1e-300)[cls]
    mass = np.bincount(cls, count, CLASSES)
    return {"symbol": symbol, "class": cls, "place": place, "members": members, "share": share.astype(np.float32), "mass": mass, "order": by}


def new_model(vocab: dict, seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    d = WIDTH
    m = {"embed": r.normal(0, 0.3, (KNOWN + 2, d)), "qkv": r.normal(0, d**-0.5, (d, 3 * d)), "far": np.zeros(WINDOW), "out": r.normal(0, d**-0.5, (d, d)), "prev": np.eye(d) + r.normal(0, 0.1, (d, d)), "hid": np.zeros(d), "cls": r.normal(0, 0.1, (d, CLASSES)), "bias": np.zeros(CLASSES)}
    inner = int(vocab["members"][SINGLE : CLASSES - 1].sum())
    m["within"] = r.normal(0, 0.05, (inner, d))
    inside = vocab["class"][vocab["order"]]
    m["start"] = vocab["share"][vocab["order"]][(inside >= SINGLE) & (inside < CLASSES - 1)]
    m["bias"] = np.log((vocab["mass"] + 0.5) / (vocab["mass"].sum() + 0.5 * CLASSES))
    m["bias"][vocab["members"] == 0] = -1e4  # classes without members get no probability
    return {k: v.astype(np.float32) for k, v in m.items()}


MASK = np.tril(np.ones((WINDOW, WINDOW), bool))
DISTANCE = np.clip(np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :], 0, WINDOW - 1)


def sums(z: np.ndarray) -> np.ndarray:
    """Sums over the last axis."""
    return z @ np.ones(z.shape[-1], z.dtype)


def with_ones(h: np.ndarray) -> np.ndarray:
    """States with a last column of ones, which meets the biases."""
    out = np.ones((len(h), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h
    return out


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, their sums, means of v by them); queries belong to the last places of a window."""
    e = np.matmul(q, k.transpose(0, 2, 1))
    e += np.where(MASK, far[DISTANCE], np.float32(-1e9))[WINDOW - q.shape[1] :]
    # Products and biases are within these bounds, so exponentials can neither overflow nor all vanish.
    if not np.einsum("nij,nij->ni", q, q).max(initial=0) * np.einsum("nij,nij->ni", k, k).max(initial=0) < 900 or not np.abs(far).max() < 30:
        e -= e.max(-1, keepdims=True)
    np.exp(e, out=e)
    total = sums(e)[..., None]
    o = np.matmul(e, v)
    o /= total
    return e, total, o


def forward(m: dict, symbols: np.ndarray, begin: int = 0) -> tuple[np.ndarray, tuple]:
    """Hidden states (n, WINDOW - begin, WIDTH) that predict the next symbol at each place from begin on; the places before are only looked at."""
    n, d = len(symbols), WIDTH
    x = np.take(m["embed"], symbols, axis=0)
    late = np.ascontiguousarray(x[:, begin:]).reshape(-1, d)
    kv = (x.reshape(-1, d) @ m["qkv"][:, d:]).reshape(n, WINDOW, 2 * d)
    k, v = kv[..., :d], kv[..., d:]
    q = (late @ (m["qkv"][:, :d] * np.float32(d**-0.5))).reshape(n, -1, d)
    e, total, o = attention(q, k, v, m["far"])
    h = late @ m["prev"]
    h += o.reshape(-1, d) @ m["out"]
    h += m["hid"]
    return np.tanh(h, out=h).reshape(o.shape), (x, late, q, k, v, e, total, o)


def tables(m: dict) -> tuple[np.ndarray, np.ndarray]:
    """What ``forward`` works out of each symbol alone: what places that are looked at need, and places that look."""
    d, x = WIDTH, m["embed"]
    q, k, v = (m["qkv"][:, i * d : (i + 1) * d] for i in range(3))
    return np.concatenate([x @ k, x @ (v @ m["out"])], 1), np.concatenate([x @ (q * np.float32(d**-0.5)), x @ m["prev"] + m["hid"]], 1)


def looked_up(table: tuple, far: np.ndarray, symbols: np.ndarray, begin: int) -> np.ndarray:
    """The hidden states of ``forward``, from tables."""
    d = WIDTH
    kv, qx = np.take(table[0], symbols, axis=0), np.take(table[1], symbols[:, begin:], axis=0)
    h = attention(qx[..., :d], kv[..., :d], kv[..., d:], far)[2]
    h += qx[..., d:]
    return np.tanh(h, out=h)


def by_begin(live: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(windows, begin): windows that are scored from their first places, and those that only look at the first ``OVERLAP``, the whole ones last."""
    first, whole = live[:, :OVERLAP].any(1), live[:, OVERLAP:].all(1)
    for which, begin in ((first, 0), (~first & ~whole, OVERLAP), (~first & whole, OVERLAP)):
        if which.any():
            yield np.flatnonzero(which), begin


def chosen(values: np.ndarray, use: np.ndarray) -> np.ndarray:
    """values[use], without a copy where all are used."""
    return values.reshape(-1, *values.shape[2:]) if use.all() else values[use]


def class_ranges(vocab: dict) -> list[tuple[int, int, int]]:
    """(class, first, end) of the rows of ``within``, for classes of several members."""
    out, at = [], 0
    for c in range(SINGLE, CLASSES - 1):
        n = int(vocab["members"][c])
        if n > 1:
            out.append((c, at, at + n))
        at += n
    return out


#: Rows and windows that are worked on at once, so that what belongs to them stays near the processor.
ROWS, PART = 1024, 64


def bounded(m: dict) -> bool:
    """Whether sums cannot overflow: states are within -1 and 1, so weights bound them."""
    most = float((np.abs(m["cls"]).sum(0) + m["bias"]).max())
    return most < 60 and (not len(m["within"]) or float((np.abs(m["within"]).sum(1) + m["start"]).max()) < 60)


def exponentials(z: np.ndarray, safe: bool) -> np.ndarray | float:
    """z becomes its exponentials, less the largest of each row where these could overflow; returns what was taken off."""
    top = 0.0
    if not safe:
        top = z.max(1)
        z -= top[:, None]
    np.exp(z, out=z)
    return top


def by_class(c: np.ndarray, ranges: list) -> Iterator[tuple[np.ndarray, int, int]]:
    """(rows, first, end) for each class of several members that rows have, with its rows of ``within``."""
    many = np.flatnonzero((c >= SINGLE) & (c < CLASSES - 1))
    many = many[np.argsort(c[many].astype(np.uint8), kind="stable")]
    bound = np.searchsorted(c[many], np.arange(CLASSES))
    for k, lo, hi in ranges:
        if bound[k] < bound[k + 1]:
            yield many[bound[k] : bound[k + 1]], lo, hi


def log_probability(m: dict, vocab: dict, ranges: list, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each target id, given hidden states (n, WIDTH)."""
    safe, c, place, out = bounded(m), vocab["class"][target], vocab["place"][target], np.empty(len(h))
    h, cls, within = with_ones(h), np.vstack([m["cls"], m["bias"]]), np.column_stack([m["within"], m["start"]])

    def log_softmax(z: np.ndarray, own: np.ndarray) -> np.ndarray:
        right = np.take(z.reshape(-1), np.arange(len(z)) * z.shape[1] + own)
        right -= exponentials(z, safe)
        right -= np.log(sums(z))
        return right

    for lo in range(0, len(h), ROWS):
        out[lo : lo + ROWS] = log_softmax(h[lo : lo + ROWS] @ cls, c[lo : lo + ROWS])
    for rows, lo, hi in by_class(c, ranges):
        out[rows] += log_softmax(np.take(h, rows, axis=0) @ within[lo:hi].T, place[rows])
    rest = c == CLASSES - 1
    if rest.any():
        out[rest] += vocab["share"][target[rest]]
    return out


def gradients(m: dict, vocab: dict, ranges: list, symbols: np.ndarray, target: np.ndarray, live: np.ndarray) -> tuple[float, dict]:
    """Mean loss over live places and its gradients."""
    n, g = int(live.sum()), {key: np.zeros_like(w) for key, w in m.items()}
    parts = [(some[lo : lo + PART], begin) for some, begin in by_begin(live) for lo in range(0, len(some), PART)]
    if not n:
        return 0.0, g
    use = [live[some, begin:] for some, begin in parts]
    states = [forward(m, symbols[some], begin) for some, begin in parts]
    h = np.concatenate([chosen(own, y) for (own, _), y in zip(states, use, strict=True)])
    loss, dh = output_gradients(m, vocab, ranges, h, np.concatenate([chosen(target[some, begin:], y) for (some, begin), y in zip(parts, use, strict=True)]), n, g)
    at, dx = 0, []
    for (own, state), y in zip(states, use, strict=True):
        count = int(y.sum())
        if count < y.size:
            full = np.zeros(own.shape, dh.dtype)
            full[y] = dh[at : at + count]
        else:
            full = dh[at : at + count].reshape(own.shape)
        at += count
        dx.append(attention_gradients(m, own, state, full, g))
    s, dx = np.concatenate([symbols[some].reshape(-1) for some, _ in parts]), np.concatenate(dx)
    order = np.argsort(s.astype(np.uint16), kind="stable")
    s = s[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    g["embed"][s[first]] += np.add.reduceat(np.take(dx, order, axis=0), first)
    return loss / n, g


def output_gradients(m: dict, vocab: dict, ranges: list, h: np.ndarray, target: np.ndarray, n: int, g: dict) -> tuple[float, np.ndarray]:
    """The loss of states that predict targets, and its gradient by them, over n; adds those of the last layer to g."""
    safe, c, place, found, dh = bounded(m), vocab["class"][target], vocab["place"][target], [], []
    share = np.float32(1 / n)
    h, cls, within = with_ones(h), np.vstack([m["cls"], m["bias"]]), np.column_stack([m["within"], m["start"]])
    dcls, dwithin = np.zeros_like(cls), np.zeros_like(within)

    def softmax(z: np.ndarray, own: np.ndarray) -> np.ndarray:
        """(Probabilities less the one that is right) / n, in place of z."""
        exponentials(z, safe)
        z *= (share / sums(z))[:, None]
        flat, at = z.reshape(-1), np.arange(len(z)) * z.shape[1] + own
        right = np.take(flat, at)
        found.append(right)
        flat[at] = right - share
        return z

    for lo in range(0, len(h), ROWS):
        own = h[lo : lo + ROWS]
        p = softmax(own @ cls, c[lo : lo + ROWS])
        dcls += (p.T @ own).T
        dh.append(p @ m["cls"].T)
    dh = np.concatenate(dh)
    for rows, lo, hi in by_class(c, ranges):
        own = np.take(h, rows, axis=0)
        p = softmax(own @ within[lo:hi].T, place[rows])
        dwithin[lo:hi] += p.T @ own
        dh[rows] += p @ m["within"][lo:hi]
    g["cls"] += dcls[:-1]
    g["bias"] += dcls[-1]
    g["within"] += dwithin[:, :-1]
    g["start"] += dwithin[:, -1]
    return -float(np.log(np.concatenate(found) / share + 1e-30).sum(dtype=float)), dh


def attention_gradients(m: dict, h: np.ndarray, state: tuple, dh: np.ndarray, g: dict) -> np.ndarray:
    """The gradient by the embeddings of a part's places, given that by its states; adds those of the weights to g."""
    d, (x, late, q, k, v, e, total, o) = WIDTH, state
    begin = WINDOW - h.shape[1]
    du = (dh * (1 - h * h)).reshape(-1, d)
    g["prev"] += late.T @ du
    g["out"] += o.reshape(-1, d).T @ du
    g["hid"] += du.sum(0)
    do = (du @ m["out"].T).reshape(o.shape)
    do /= total
    # e / total are the weights of attention, and o the values' mean by them, so the mean of what comes back to the weights is do * o.
    ds = np.matmul(do, v.transpose(0, 2, 1))
    ds -= np.einsum("nij,nij->ni", do, o)[..., None]
    ds *= e
    far = (np.ones(len(ds), ds.dtype) @ ds.reshape(len(ds), -1)).reshape(ds.shape[1:])
    g["far"] += np.bincount(DISTANCE[begin:][MASK[begin:]], far[MASK[begin:]], WINDOW).astype(np.float32)
    dkv = np.empty((*x.shape[:2], 2 * d), ds.dtype)
    np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., :d])
    np.matmul(e.transpose(0, 2, 1), do, out=dkv[..., d:])
    dkv = dkv.reshape(-1, 2 * d)
    dq = np.matmul(ds, k).reshape(-1, d)
    dq *= np.float32(d**-0.5)
    g["qkv"][:, :d] += late.T @ dq
    g["qkv"][:, d:] += (dkv.T @ x.reshape(-1, d)).T
    dx = (dkv @ m["qkv"][:, d:].T).reshape(x.shape)
    dx[:, begin:] += (dq @ m["qkv"][:, :d].T + du @ m["prev"].T).reshape(o.shape)
    return dx.reshape(-1, d)


def windows(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input ids (-1: none, end: before the text), targets and which to score, for rows of ids; each target is scored once."""
    n = np.diff(bounds) + 1  # with the end
    step = WINDOW - OVERLAP
    count = 1 + np.maximum(0, -(-(n - WINDOW) // step))
    row = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    place = (number * step)[:, None] + np.arange(WINDOW)[None, :]
    size = n[row][:, None]
    inside = place < size
    base = bounds[:-1][row][:, None]
    padded = np.append(ids, np.array([end], ids.dtype))
    target = np.where(place == size - 1, end, padded[np.minimum(base + place, len(ids))])
    source = np.where(place == 0, end, padded[np.minimum(np.maximum(base + place - 1, 0), len(ids))])
    score = inside & ((number[:, None] == 0) | (np.arange(WINDOW)[None, :] >= OVERLAP))
    return np.where(inside, source, end), np.where(inside, target, end), score


class Adam:
    def __init__(self, m: dict):
        self.m, self.step = m, 0
        size = sum(w.size for w in m.values())
        self.one, self.two, self.flat, self.spare = (np.zeros(size, np.float32) for _ in range(4))

    def take(self, g: dict, rate: float) -> None:
        self.step += 1
        flat, spare = self.flat, self.spare
        np.concatenate([x.reshape(-1) for x in g.values()], out=flat)
        np.multiply(flat, flat, out=spare)
        spare -= self.two
        spare *= np.float32(0.01)
        self.two += spare
        flat -= self.one
        flat *= np.float32(0.1)
        self.one += flat
        np.sqrt(self.two, out=spare)
        spare *= np.float32((1 - 0.99**self.step) ** -0.5)
        spare += np.float32(1e-8)
        np.divide(self.one, spare, out=flat)
        flat *= np.float32(rate / (1 - 0.9**self.step))
        at = 0
        for w in self.m.values():
            w -= flat[at : at + w.size].reshape(w.shape)
            at += w.size


def train(texts: list[bytes], path: str, pattern: str, steps: int = 1500, batch: int = 192, seed: int = 11, counts: np.ndarray | None = None) -> tuple[dict, dict]:
    """The model and vocabulary; counts: of all ids, by default those of the texts."""
    t = bpe.tokenizer(path, pattern)
    data, off = plain_words(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(x) for x in texts])).astype(np.int64))
    ids, bounds = t.encode_rows(data, off)
    size = len(t.vocabulary.bytes_of) + 1
    return train_ids(ids, bounds, np.bincount(np.append(ids, np.full(len(texts), size - 1)).astype(np.int64), minlength=size) if counts is None else counts, steps, batch, seed)


def train_ids(ids: np.ndarray, bounds: np.ndarray, counts: np.ndarray, steps: int = 1500, batch: int = 192, seed: int = 11) -> tuple[dict, dict]:
    vocab = vocabulary(counts)
    m = new_model(vocab)
    if len(bounds) < 2:
        return m, vocab
    ranges = class_ranges(vocab)
    source, target, live = windows(ids, bounds, len(counts) - 1)
    r = np.random.default_rng(seed)
    adam = Adam(m)
    for step in range(1, steps + 1):
        pick = r.integers(0, len(source), min(batch, len(source)))
        _, g = gradients(m, vocab, ranges, vocab["symbol"][source[pick]], target[pick], live[pick])
        adam.take(g, 0.02 * min(1, step / 20) * (1 - 0.95 * step / steps))
    return m, vocab


def score_rows(m: dict, vocab: dict, ranges: list, ids: np.ndarray, bounds: np.ndarray, end: int, batch: int = 4096) -> np.ndarray:
    """log10 probability of each row."""
    out = np.zeros(len(bounds) - 1)
    source, target, live = windows(ids, bounds, end)
    n = np.diff(bounds) + 1
    row = np.repeat(np.arange(len(n)), 1 + np.maximum(0, -(-(n - WINDOW) // (WINDOW - OVERLAP))))
    table = tables(m)
    for some, begin in by_begin(live):
        for lo in range(0, len(some), batch):
            own = some[lo : lo + batch]
            use, symbols = live[own, begin:], vocab["symbol"][source[own]]
            h = np.concatenate([chosen(looked_up(table, m["far"], symbols[k : k + PART], begin), use[k : k + PART]) for k in range(0, len(symbols), PART)])
            p = log_probability(m, vocab, ranges, h, chosen(target[own, begin:], use))
            out += np.bincount(np.repeat(row[own], use.sum(1)), p, len(out))
    return out / np.log(10)


# --- Spark --------------------------------------------------------------------------------------------------------


def packed(kind: np.dtype, **columns) -> np.ndarray:
    out = np.empty(len(next(iter(columns.values()))), kind)
    for k, v in columns.items():
        out[k] = v
    return out


def dealt(records: np.ndarray, by: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels and their records, by a hash."""
    where = (mix(by) % U(len(labels))).astype(np.int64)
    order = np.argsort(where, kind="stable")
    bound = np.searchsorted(where[order], np.arange(len(labels) + 1))
    live = np.flatnonzero(np.diff(bound))
    return labels[live], [records[order[bound[i] : bound[i + 1]]] for i in live.tolist()]


def added(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    start = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[start], np.add.reduceat(counts, start) if len(start) else counts


def word_counts(rows: DataFrame, labels: np.ndarray, room: int = 1_500_000) -> DataFrame:
    """(label, table, n, v): packed counts of all words and ends of rows (doc, text), by hash. room: words that a task holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c = np.zeros(0, U), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            at, tables = dealt(packed(COUNT, hash=h, c=c), h, labels)
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([x.tobytes() for x in tables], pa.binary())], names=["label", "table"])

        for b in batches:
            data, off = text_bytes(b[1])
            for lo, hi in pieces(off):
                x = word_hashes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])[0]
                held.append(np.unique(np.append(x, np.full(hi - lo, END_WORD)), return_counts=True))
                if sum(len(y[0]) for y in held) > 2_000_000:
                    h, c = added(np.concatenate([h, *(y[0] for y in held)]), np.concatenate([c, *(y[1] for y in held)]))
                    held = []
                    if len(h) > room:
                        yield out()
                        h, c = np.zeros(0, U), np.zeros(0, np.int64)
        h, c = added(np.concatenate([h, *(y[0] for y in held)]), np.concatenate([c, *(y[1] for y in held)]))
        yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            for label, x in zip(b[0].to_pylist(), b[1], strict=True):
                found.setdefault(label, []).append(np.frombuffer(x.as_py(), COUNT))
        for label, tables in found.items():
            t = np.concatenate(tables)
            h, c = added(t["hash"], t["c"])
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([packed(COUNT, hash=h, c=c).tobytes()], pa.binary()), pa.array([int(c.sum())], pa.int64()), pa.array([len(h)], pa.int64())], names=["label", "table", "n", "v"])

    return rows.mapInArrow(count, "label int, table binary").repartition(len(labels), "label").mapInArrow(add, "label int, table binary, n long, v long")


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of rows of packed doubles (vector); the driver gets one vector of a fixed length."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for b in batches:
            for x in b[0]:
                out += np.frombuffer(x.as_py(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["vector"])

    row = parts.repartition(8).mapInArrow(total, "vector binary").repartition(1).mapInArrow(total, "vector binary").head()
    return np.frombuffer(row[0], np.float64) if row else np.zeros(size)


def id_type(size: int) -> np.dtype:
    """How ids below size are written."""
    return np.dtype("<u2" if size <= 1 << 16 else "<i4")


def encoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc, row, learned, n_tokens, ids) of (doc, text, learned) rows, written once: every round and the scores read the ids."""
    kind = id_type(len(bpe.tokenizer(path, pattern).vocabulary.bytes_of) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = bpe.tokenizer(path, pattern)
        for b in batches:
            data, off = text_bytes(b[1])
            for lo, hi in pieces(off, 1 << 19):
                own, at, doc = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], b[0].slice(lo, hi - lo)
                plain, first = plain_words(own, at)
                ids, bounds = t.encode_rows(plain, first)
                words = np.append(0, np.cumsum(plain == 32))[first]
                packed_ids = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(np.asarray(bounds, np.int64) * kind.itemsize), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(row_keys(doc, own, at)), b[2].slice(lo, hi - lo), pa.array(np.diff(words) + 1, pa.int64()), packed_ids.cast(pa.binary())],
                    names=["doc", "row", "learned", "n_tokens", "ids"],
                )

    return cut(rows.select("doc", "text", "learned").mapInArrow(run, "doc long, row long, learned boolean, n_tokens long, ids binary"))


def id_pieces(column: pa.Array, kind: np.dtype) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, their ids joined, offsets of the rows in them) for pieces of a column of packed ids."""
    data, off = text_bytes(column)
    ids, off = np.frombuffer(data.tobytes(), kind), off // kind.itemsize
    for lo, hi in pieces(off, 1 << 18):
        yield lo, hi, ids[off[lo] : off[hi]].astype(np.int32), off[lo : hi + 1] - off[lo]


def id_counts(ids: DataFrame, size: int) -> np.ndarray:
    """How often each subword id, and at last the end, occurs in all (ids) rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for b in batches:
            for *_, own, _ in id_pieces(b[0], id_type(size)):
                out += np.bincount(own, minlength=size)
            out[-1] += len(b)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["vector"])

    return summed(ids.mapInArrow(count, "vector binary"), size).astype(np.int64)


def read_all(m: dict, vocab: dict, rows: DataFrame, rounds: int, batch: int = 384) -> dict:
    """The model after every (doc, ids) row was learned from once."""
    size = sum(w.size for w in m.values())
    ranges, end = class_ranges(vocab), len(vocab["symbol"]) - 1
    for number in range(rounds):
        rate = 0.004 * (1 - 0.8 * number / rounds)
        now = m

        def learn(batches: Iterator[pa.RecordBatch], now=now, rate=rate, number=number) -> Iterator[pa.RecordBatch]:
            own, n = {k: w.copy() for k, w in now.items()}, 0
            adam, r = Adam(own), np.random.default_rng(number)
            for b in batches:
                for _, _, ids, bounds in id_pieces(b[0], id_type(end + 1)):
                    source, target, live = windows(ids, bounds, end)
                    order = r.permutation(len(source))
                    for part in np.array_split(order, max(1, round(len(order) / batch))):
                        if len(part):
                            _, g = gradients(own, vocab, ranges, vocab["symbol"][source[part]], target[part], live[part])
                            adam.take(g, rate * min(1, (adam.step + 1) / 20) * min(1, len(part) / batch))
                            n += int(live[part].sum())
            if n:
                flat = np.concatenate([w.reshape(-1) for w in own.values()]).astype(np.float64) * n
                yield pa.RecordBatch.from_arrays([pa.array([np.append(flat, n).tobytes()], pa.binary())], names=["vector"])

        total = summed(rows.where(F.pmod(F.xxhash64("doc"), F.lit(rounds)) == number).select("ids").mapInArrow(learn, "vector binary"), size + 1)
        if total[-1]:
            flat, at = (total[:-1] / total[-1]).astype(np.float32), np.cumsum([0, *(w.size for w in m.values())])
            m = {k: flat[lo : lo + w.size].reshape(w.shape) for (k, w), lo in zip(m.items(), at[:-1], strict=True)}
    return m


def fit(rows: DataFrame, path: str, pattern: str, max_docs: int = 1500, rounds: int = 4) -> tuple[dict, dict]:
    """The model and vocabulary from (doc, text) rows."""
    return fit_ids(encoded(rows.withColumn("learned", F.lit(True)), path, pattern), len(bpe.tokenizer(path, pattern).vocabulary.bytes_of) + 1, max_docs, rounds)


def fit_ids(rows: DataFrame, size: int, max_docs: int = 1500, rounds: int = 4) -> tuple[dict, dict]:
    """The model from (doc, ids) rows: one task begins on the bounded sample, all tasks go on over all rows; the driver gets sums and parameters alone."""
    counts = id_counts(rows.select("ids"), size)
    chosen_docs = rows.where("doc is not null").select("doc").distinct().orderBy(F.xxhash64("doc"), "doc").limit(max_docs).select(F.col("doc").alias("chosen"))
    sample = rows.join(F.broadcast(chosen_docs), F.col("doc") == F.col("chosen"), "left_semi").select("doc", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((i, x) for b in batches for i, x in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True))
        kind = id_type(size)
        bounds = np.append(0, np.cumsum([len(x) // kind.itemsize for _, x in found])).astype(np.int64)
        m, vocab = train_ids(np.frombuffer(b"".join(x for _, x in found), kind).astype(np.int32), bounds, counts)
        for k, v in [*m.items(), *(("vocab " + k, v) for k, v in vocab.items())]:
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([str(v.dtype)]), pa.array([list(v.shape)], pa.list_(pa.int64())), pa.array([v.tobytes()], pa.binary())], names=["name", "kind", "shape", "value"])

    got = {r["name"]: np.frombuffer(r["value"], r["kind"]).reshape(r["shape"]) for r in sample.repartition(1).mapInArrow(run, "name string, kind string, shape array<long>, value binary").collect()}
    if not got:  # no rows, no task
        return train_ids(np.zeros(0, np.int32), np.zeros(1, np.int64), counts)
    m, vocab = {k: v for k, v in got.items() if not k.startswith("vocab ")}, {k[6:]: v for k, v in got.items() if k.startswith("vocab ")}
    return read_all(m, vocab, rows, rounds), vocab


def score(docs: DataFrame, learn: Column, path: str, pattern: str, max_docs: int = 1500, frequent: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row; ``learn`` is a condition on ``doc`` for what is learned from."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    learned = rows.where(learn & F.col("doc").isNotNull())
    ids = encoded(rows.withColumn("learned", F.coalesce(learn & F.col("doc").isNotNull(), F.lit(False))), path, pattern)
    n_parts = partitions(docs)
    labels = np.array(even_labels(docs, n_parts), np.int64)
    m, vocab = fit_ids(ids.where("learned"), len(bpe.tokenizer(path, pattern).vocabulary.bytes_of) + 1, max_docs)
    ranges, end = class_ranges(vocab), len(vocab["symbol"]) - 1
    counts = cut(word_counts(learned, labels))
    total = counts.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).head()
    n_train, v_train = int(total["n"] or 0), int(total["v"] or 0)
    scale = n_train + 0.5 * (v_train + 1)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tables = (np.frombuffer(x.as_py(), COUNT) for x in b[0])
            yield pa.RecordBatch.from_arrays([pa.array([t[t["c"] * frequent >= n_train].tobytes() for t in tables], pa.binary())], names=["table"])

    top = np.concatenate([np.zeros(0, COUNT), *(np.frombuffer(r["table"], COUNT) for r in counts.select("table").mapInArrow(often, "table binary").collect())])
    top = top[np.argsort(top["hash"])]
    top_hash, top_count = top["hash"].copy(), top["c"].copy()

    def known(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(top_hash):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(top_hash, h), len(top_hash) - 1)
        hit = top_hash[at] == h
        return hit, np.where(hit, top_count[at], 0)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the frequent words, by row; and the words that are not frequent, by hash: each once for a row, with its number."""
        for b in batches:
            data, off = text_bytes(b[1])
            for lo, hi in ((x, min(x + 60_000, z)) for y, z in pieces(off, 4 << 20) for x in range(y, z, 60_000)):
                own, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                keys = row_keys(b[0].slice(lo, hi - lo), own, at)
                h, first = word_hashes(own, at)
                h = np.append(h, np.full(hi - lo, END_WORD))
                row = np.append(np.repeat(np.arange(hi - lo), np.diff(first)), np.arange(hi - lo))
                hit, c = known(h)
                base, n_known = np.bincount(row[hit], np.log10((c[hit] + 0.5) / scale), hi - lo), np.bincount(row[hit], minlength=hi - lo)
                have = np.flatnonzero(n_known)
                at_, sums_ = dealt(packed(SUM, row=keys[have], score=base[have], known=n_known[have]), keys[have].view(U), labels)
                none = pa.nulls(len(at_), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(at_, pa.int32()), none, none, none, pa.array([x.tobytes() for x in sums_], pa.binary())], names=["label", "table", "rows", "asked", "sums"])
                h, row = h[~hit], row[~hit]
                if not len(h):
                    continue
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                start = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
                r = packed(ASK, hash=h[start], n=np.diff(np.append(start, len(h))), d=row[start])
                at_, tables_ = dealt(r, r["hash"], labels)
                rows_ = []
                for t in tables_:
                    mine, place = np.unique(t["d"], return_inverse=True)
                    t["d"] = place
                    rows_.append(keys[mine].tobytes())
                none = pa.nulls(len(at_), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(at_, pa.int32()), none, pa.array(rows_, pa.binary()), pa.array([t.tobytes() for t in tables_], pa.binary()), none], names=["label", "table", "rows", "asked", "sums"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables_, keys, asked, had = [np.zeros(0, COUNT)], [np.zeros(0, np.int64)], [np.zeros(0, ASK)], [np.zeros(0, SUM)]
        for b in batches:
            for t, r, a, x in zip(*(b[i].to_pylist() for i in range(4)), strict=True):
                if t is not None:
                    tables_.append(np.frombuffer(t, COUNT))
                elif x is not None:
                    had.append(np.frombuffer(x, SUM))
                else:
                    a = np.frombuffer(a, ASK)
                    keys.append(np.frombuffer(r, np.int64)[a["d"]])
                    asked.append(a)
        table, key, a, had = np.concatenate(tables_), np.concatenate(keys), np.concatenate(asked), np.concatenate(had)
        had = had[np.unique(had["row"], return_index=True)[1]]  # repeated rows have one sum, and ask once
        table = table[np.argsort(table["hash"])]
        order = np.lexsort((a["hash"], key))
        key, a = key[order], a[order]
        if len(key):
            one = np.append(True, (key[1:] != key[:-1]) | (a["hash"][1:] != a["hash"][:-1]))
            key, a = key[one], a[one]
            c = np.zeros(len(a), np.int64)
            if len(table):
                at = np.minimum(np.searchsorted(table["hash"], a["hash"]), len(table) - 1)
                c = np.where(table["hash"][at] == a["hash"], table["c"][at], 0)
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            s = np.add.reduceat(a["n"] * np.log10((c + 0.5) / scale), start)
            k = np.add.reduceat(np.where(c > 0, a["n"], 0).astype(np.int64), start)
            had = np.concatenate([had, packed(SUM, row=key[start], score=s, known=k)])
        if len(had):
            at_, sums_ = dealt(had, had["row"].astype(np.int64).view(U), labels)
            yield pa.RecordBatch.from_arrays([pa.array(at_, pa.int32()), pa.array([x.tobytes() for x in sums_], pa.binary())], names=["label", "sums"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.concatenate([np.zeros(0, SUM), *(np.frombuffer(x.as_py(), SUM) for b in batches for x in b[0])])
        if not len(s):
            return
        s = s[np.argsort(s["row"], kind="stable")]
        start = np.flatnonzero(np.append(True, s["row"][1:] != s["row"][:-1]))
        yield pa.RecordBatch.from_arrays([pa.array(s["row"][start].astype(np.int64)), pa.array(np.add.reduceat(s["score"], start)), pa.array(np.add.reduceat(s["known"], start).astype(np.int64))], names=["sum_row", "base", "n_known"])

    asked = rows.mapInArrow(ask, "label int, table binary, rows binary, asked binary, sums binary")
    both = asked.unionByName(counts.select("label", "table"), allowMissingColumns=True)
    answered = both.repartition(n_parts, "label").select("table", "rows", "asked", "sums").mapInArrow(answer, "label int, sums binary")
    base = answered.repartition(n_parts, "label").select("sums").mapInArrow(gather, "sum_row long, base double, n_known long")

    def attend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, own, bounds in id_pieces(b[3], id_type(end + 1)):
                yield pa.RecordBatch.from_arrays([*(b[i].slice(lo, hi - lo) for i in range(3)), pa.array(score_rows(m, vocab, ranges, own, bounds, end), pa.float64())], names=["doc", "row", "n_tokens", "score"])

    scored = ids.select("doc", "row", "n_tokens", "ids").mapInArrow(attend, "doc long, row long, n_tokens long, score double")
    out = scored.join(base, F.col("row") == F.col("sum_row"), "left")
    return out.select(F.col("doc").alias(id_col), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
