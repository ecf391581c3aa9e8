"""Near-duplicate texts by SimHash fingerprints, found through deletion-variant signatures.

``fingerprints`` names every text by 64 bits, ``similar_links`` finds all that joins fingerprints of a small Hamming distance, and
``simhash_components`` gives each document the smallest id that its links lead to.

Of d differing bits, one of d // 2 + 1 segments has one at most. So a fingerprint is indexed by each segment as it is, and by each segment
with one bit left out: two fingerprints link only if they share a segment, or a variant of which one has the bit and the other has not. Each
pair therefore meets at known variants, its first such segment counts, and what meets is compared as a whole.

Equal fingerprints are one row from the start, so copies cost nothing. What meets at one variant is not turned into pairs: small groups
are compared in shifted copies of the sorted columns, larger ones are walked and give a tree of links, fewer than they have
rows. A segment that more than ``block`` fingerprints have is dealt out in pairs of blocks, so a task holds two blocks at most.

A null, empty or blank text has no words and the fingerprint zero, which links like any other. Texts of fewer than k words have one
shingle. Rows with equal ids are rows of their own with the same component, if their texts are alike; a null id is larger than every other, so it names a
component only of rows without ids. No rows give no rows. Other columns, whatever their names, are not read. Texts are taken as bytes; a text of
many megabytes is hashed in pieces of 65,536 shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import components, cut, partitions

#: By byte: its bits, each in a byte of its own.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()

#: Groups of up to so many fingerprints are compared pair by pair.
FEW = 32


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit; lanes of a byte are summed over 255 values at a time."""
    lanes = SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    return np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)


def fingerprint(text: bytes, k: int = 4, seed: int = 42, piece: int = 1 << 16) -> int:
    """A bit is 1 if more than half of the hashes of all k-word shingles have it; 0 for texts without words."""
    words = text.lower().split()  # of bytes: A-Z, and white space of ASCII
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(k, len(words))
    joined, starts, ends = b" ".join(words), starts[: len(words) - k + 1], ends[k - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), piece):
        spans = zip(starts[at : at + piece].tolist(), ends[at : at + piece].tolist(), strict=True)
        counts += bits_set(np.array([digest(joined[i:j], seed) for i, j in spans], np.uint64))
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): a row for each document; fp is the fingerprint as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py() or b"", k) for t in b["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(found.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(hashed, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of the segments, so few that one of them has one differing bit at most."""
    n = distance // 2 + 1
    at = [round(64 * i / n + 0.25) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Variants:
    """The signatures of a distance: each segment as it is, and each segment without one of its bits, numbered."""

    def __init__(self, distance: int):
        if not 2 <= distance <= 12:
            raise ValueError("distances from 2 to 12 differing bits are supported")
        self.distance, self.rows = distance, []
        for low, n in segments(distance):
            mask = ((1 << n) - 1) << low
            self.rows += [(low, mask, 0)] + [(low, mask, 1 << bit) for bit in range(low, low + n)]
        self.low = np.array([r[0] for r in self.rows], np.uint64)
        self.bit = np.array([r[2] for r in self.rows], np.uint64)
        self.masks = np.array(sorted({r[1] for r in self.rows}), np.uint64)
        self.segment = np.searchsorted(self.masks, np.array([r[1] for r in self.rows], np.uint64))

    def literal(self):
        """An array of (variant, low, mask, bit) to explode."""
        return F.array(*(F.struct(F.lit(i).alias("variant"), F.lit(low).alias("low"), F.lit(signed(mask)).alias("mask"), F.lit(signed(bit)).alias("bit")) for i, (low, mask, bit) in enumerate(self.rows)))

    def linked(self, x: np.ndarray, variant: np.ndarray) -> np.ndarray:
        """Whether fingerprints that differ by x link, and at this variant rather than at another one."""
        at = np.flatnonzero((np.bitwise_count(x) <= self.distance) & ((self.bit[variant] == 0) | (x & self.bit[variant] != 0)))
        for s, mask in enumerate(self.masks[:-1]):  # a segment before with one differing bit at most has the pair
            at = at[(self.segment[variant[at]] <= s) | (np.bitwise_count(x[at] & mask) > 1)]
        out = np.zeros(len(x), bool)
        out[at] = True
        return out


def tree(fps: np.ndarray, bit: np.uint64, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that hold a group's fingerprints together as all its links do: those of a walk.

    With a bit, links run between fingerprints with it and without it, and walks begin on the smaller of the two sides.
    """
    if bit:
        has = fps & bit != 0
        sides = [fps[has], fps[~has]] if 2 * has.sum() <= len(fps) else [fps[~has], fps[has]]
    else:
        sides = [fps]
    left = [np.arange(len(s)) for s in sides]  # of each side, what no walk has reached
    last = len(sides) - 1
    while len(left[0]) and (last == 0 or len(left[1])):
        front, side = [(0, left[0][0])], 0
        left[0] = left[0][1:]
        while front:
            side, i = front.pop()
            other = last - side
            near = np.bitwise_count(sides[other][left[other]] ^ sides[side][i]) <= distance
            found = left[other][near]
            if len(found):
                left[other] = left[other][~near]
                front += [(other, j) for j in found.tolist()]
                yield np.full(len(found), sides[side][i]), sides[other][found]


def similar_links(fps: DataFrame, distance: int = 4, block: int = 1 << 14, broadcast_rows: int = 100_000) -> DataFrame:
    """(a, b) of linked fingerprints, enough to lead from each to all that links lead to; fps: distinct fingerprints (column fp), which are read twice.

    A list of segments that more than ``block`` fingerprints have is broadcast up to ``broadcast_rows`` rows, and shuffled beyond.
    """
    kinds = Variants(distance)
    rows = fps.select("fp", F.explode(kinds.literal()).alias("v")).select("fp", "v.*")
    own = F.col("fp").bitwiseAND(F.col("mask"))
    rest = F.call_function("shiftrightunsigned", F.col("fp").bitwiseAND(F.col("mask").bitwiseXOR(F.col("bit"))), F.col("low"))
    key = F.shiftleft(F.col("variant").cast("long"), 33).bitwiseOR(rest)

    masks = F.array(*(F.struct(F.lit(signed(int(m))).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(int(m)))).alias("value")) for m in kinds.masks))
    whole = fps.select(F.explode(masks).alias("s")).select("s.*")
    hot = cut(whole.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > block).select("mask", "value", F.ceil(F.col("n") / block).cast("long").alias("r")))
    n_hot = hot.count()
    if n_hot:
        small = F.broadcast if n_hot <= broadcast_rows else (lambda df: df)
        rows = rows.withColumn("value", own).withColumn("over", own.bitwiseXOR(F.col("bit")))
        rows = rows.join(small(hot), ["mask", "value"], "left").withColumn("r", F.coalesce("r", F.lit(1)))
        rows = rows.join(small(hot.select("mask", F.col("value").alias("over"), F.col("r").alias("q"))), ["mask", "over"], "left").withColumn("q", F.coalesce("q", F.lit(1)))
        mine = F.pmod(F.xxhash64("fp"), F.col("r"))
        each = F.sequence(F.lit(0).cast("long"), F.col("q") - 1)
        lower = own.bitwiseAND(F.col("bit")) == 0
        cells = F.when(F.col("bit") == 0, F.transform(each, lambda j: F.least(mine, j) * F.col("r") + F.greatest(mine, j)))
        cells = cells.when(lower, F.transform(each, lambda j: mine * F.col("q") + j)).otherwise(F.transform(each, lambda j: j * F.col("r") + mine))
        rows = rows.select("fp", key.alias("key"), F.explode(cells).alias("cell"))
    else:
        rows = rows.select("fp", key.alias("key"), F.lit(0).cast("long").alias("cell"))

    def met(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
        sizes = np.diff(np.append(starts, len(keys)))
        variant = (keys[starts, 0] >> 33).astype(np.int64)
        several = (sizes > 1) & (sizes <= FEW)
        small = np.repeat(several, sizes)
        group, x, v = np.repeat(np.arange(len(sizes)), sizes)[small], fps[small], np.repeat(variant, sizes)[small]
        for d in range(1, int(sizes[several].max(initial=1))):
            i = np.flatnonzero(group[d:] == group[:-d])
            i = i[kinds.linked(x[i] ^ x[i + d], v[i])]
            yield x[i], x[i + d]
        for g in np.flatnonzero(sizes > FEW):
            yield from tree(fps[starts[g] : starts[g] + sizes[g]], kinds.bit[variant[g]], distance)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty((0, 2), np.int64), np.empty(0, np.uint64)

        def out(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            a, b, held = [], [], 0
            for x, y in pairs:
                a.append(x)
                b.append(y)
                held += len(x)
                if held > 1 << 16:
                    yield batch(a, b)
                    a, b, held = [], [], 0
            if held:
                yield batch(a, b)

        for t in batches:
            keys = np.concatenate([keys, np.stack([t["key"].to_numpy(), t["cell"].to_numpy()], axis=1)])
            fps = np.concatenate([fps, t["fp"].to_numpy().view(np.uint64)])
            open_at = len(keys) - int(np.argmin((keys[::-1] == keys[-1:]).all(1))) if len(keys) and (keys != keys[-1:]).any() else 0
            if open_at:  # the last group may go on
                yield from out(met(keys[:open_at], fps[:open_at]))
                keys, fps = keys[open_at:], fps[open_at:]
        if len(keys):
            yield from out(met(keys, fps))

    def batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    dealt = rows.repartition(partitions(fps), "key", "cell").sortWithinPartitions("key", "cell")
    return dealt.mapInArrow(links, "a long, b long")


def simhash_components(docs: DataFrame, k: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, fingerprint, component_id): the fingerprint as 16 hexadecimal digits, and the smallest id that links lead to."""
    named = cut(fingerprints(docs, k, id_col, text_col))
    nodes = cut(named.groupBy("fp").agg(F.min("id").alias("least")))
    joined = components(similar_links(nodes.select("fp"), distance, **how))
    nodes = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    of = nodes.join(least, "component").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return named.join(of, "fp").select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")
