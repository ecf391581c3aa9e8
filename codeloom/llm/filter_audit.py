"""Audit of how quality filters interact: what each removes, in every order in which they can be applied.

A document is judged once by every filter, which gives a mask of the filters that it fails. What happens to it at each step of each order
follows from the mask, so every mask has one big integer whose fields hold all those outcomes: for each order and step, whether the
document is kept, removed, redundant, a unique failure, removed though good and removed though toxic. Integers of a part's documents are summed, each
times the number of its documents, and the fields of the sum are the part's counts. A field has as many bits as the number of documents needs, so no
field runs over into the next; a part never has more documents than a long counts.

Documents are counted by (part, mask, labels) before anything meets by part, so a part's rows are few however many documents it has. Whether a text is a
copy is seen from SHA-256 digests of whole texts: copies meet as counts, combined before the shuffle.

A null text counts as empty, a null part as the empty string. Of several labels of one document each counts that any of them has; labels without an id, and
documents without labels, have none. A document without id is no copy of others without id, but one of any that has an id. Repeated rows (equal ids) are
documents of their own, and not copies of each other. No rows give no parts. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import partitions

#: The counts of a step, in the order of their fields.
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides: too short, repetitive, capitals, symbols."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": F.size(words) < 100, "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words), "C": 100 * capitals > 10 * F.length(text), "D": F.rlike(text, F.lit("[#$%&*|]"))}


def mask_counts(docs: DataFrame, labels: DataFrame, copies: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents of each part by the filters that they fail, the first filter as the lowest bit, and their labels.

    The last filter, ``copies``, fails a text that a document with a smaller id has, too.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    filters = text_filters(F.col("text"))
    mask = sum((fails.cast("int") * (1 << i) for i, fails in enumerate(filters.values())), F.lit(0))
    rows = rows.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    marks = marks.agg(*(F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    marked = rows.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    same = ["digest", "part", "mask", "good", "toxic"]
    by_id = marked.groupBy("id", *same).agg(F.count("*").alias("n"))  # repeated rows of one id are no copies of each other
    of_text = by_id.groupBy(*same).agg(F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"), F.sum("n").alias("n"))
    first = of_text.groupBy("digest").agg(F.min("least").alias("first"))
    met = of_text.join(first, "digest")
    own = F.when(F.col("first").isNull(), F.col("n")).when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(F.lit(0))
    bit = 1 << len(filters)
    each = F.array(F.struct(F.col("mask"), own.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - own).alias("n")))
    out = met.select("part", "good", "toxic", F.explode(each).alias("e")).where("e.n > 0")
    return out.groupBy("part", "e.mask", "good", "toxic").agg(F.sum("e.n").alias("n"))


class Outcomes:
    """Big integers of masks: field (order, step, outcome) of ``packed`` is 1 if the outcome holds for a document with that mask."""

    def __init__(self, filters: Sequence[str]):
        self.filters = tuple(filters)
        self.orders = ["".join(p) for p in permutations(filters)]
        self.steps = len(self.filters)
        self.bit = np.array([[1 << self.filters.index(f) for f in order] for order in self.orders])

    def flags(self, mask: int, good: int, toxic: int) -> np.ndarray:
        """(order, step, outcome) as 0 or 1."""
        fails = (mask & self.bit) > 0
        before = np.cumsum(fails, axis=1) - fails  # filters of earlier steps that it fails
        removed = fails & (before == 0)
        kept = ~fails & (before == 0)
        return np.stack([kept, removed, fails & (before > 0), fails & (mask == self.bit), removed & bool(good), removed & bool(toxic)], axis=-1)

    def packed(self, mask: int, good: int, toxic: int, width: int) -> int:
        """The flags as one integer with a field of ``width`` bytes for each, the first one lowest."""
        fields = np.zeros((self.bit.size * len(OUTCOMES), width), np.uint8)
        fields[:, 0] = self.flags(mask, good, toxic).ravel()
        return int.from_bytes(fields.tobytes(), "little")

    def unpacked(self, total: int, width: int) -> np.ndarray:
        """The fields of a sum: (order, step, outcome) as counts."""
        raw = np.frombuffer(total.to_bytes(self.bit.size * len(OUTCOMES) * width, "little"), np.uint8).reshape(-1, width)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :width] = raw
        return wide.view(np.int64).reshape(*self.bit.shape, len(OUTCOMES))

    def shapley(self, removed: np.ndarray) -> np.ndarray:
        """(order, step): what the step's filter removes in all orders together."""
        total = {b: int(removed[self.bit == b].sum()) for b in set(self.bit.ravel().tolist())}
        return np.vectorize(total.get, otypes=[np.int64])(self.bit)


def field_bytes(n: int) -> int:
    """Bytes of a field that counts up to n documents."""
    return (n.bit_length() + 7) // 8 or 1


def filter_interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, outcomes ..., shapley): a row for each part, order of the filters and step, zeros included."""
    counts = mask_counts(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col)
    outcomes = Outcomes("ABCDE")

    def audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str, list[tuple[int, int, int, int]]] = {}  # at most 128 for each part
        for b in batches:
            for r in b.to_pylist():
                classes.setdefault(r["part"], []).append((r["mask"], r["good"], r["toxic"], r["n"]))
        order = pa.array(np.repeat(outcomes.orders, outcomes.steps))
        step = pa.array(np.tile(np.arange(1, outcomes.steps + 1, dtype=np.int32), len(outcomes.orders)))
        packed: dict[tuple[int, int, int, int], int] = {}
        for part, rows in classes.items():
            width, total = field_bytes(sum(r[3] for r in rows)), 0
            for mask, good, toxic, n in rows:
                key = (mask, good, toxic, width)
                if key not in packed:
                    packed[key] = outcomes.packed(*key)
                total += n * packed[key]
            found = outcomes.unpacked(total, width)
            columns = [*np.moveaxis(found, -1, 0), outcomes.shapley(found[..., OUTCOMES.index("removed")])]
            arrays = [pa.array([part] * len(step), pa.string()), order, step, *(pa.array(np.ascontiguousarray(c).ravel(), pa.int64()) for c in columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "filter_order", "step", *OUTCOMES, "shapley"])

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*OUTCOMES, "shapley"))
    return counts.repartition(partitions(docs), "part").mapInArrow(audited, schema)
