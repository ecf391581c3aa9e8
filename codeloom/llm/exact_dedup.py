"""Exact dedup by grace hash: partition, spill, and compare complete content in open-addressing tables.

Two texts are equal when they are the same after every character of [\\x20\\x09-\\x0D] is deleted. Of equal
texts the row with the most code points stays, then the one with the smallest id.

1. Each map task merges the equal texts that it reads itself into entries, so a text that fills a third of all rows is
   sent once for each task and not once for each row. The table is emptied whenever it is full. Entries are written to the shared
   folder with a number and their ids.
2. Spark deals the entries out by a hash of the content, each with its count and its best row; ids stay where they are.
3. Each reduce task is a grace hash join of the entries with themselves: if the different contents do not fit
   the table, those beyond it go to spill files by another hash, and each file is treated in the same way. Only different
   contents take room; the entries of one content, at most a few for each map task, wait in a side file.
4. What the reduce tasks found out about each entry is joined with its ids by the entry's number, so the ids of a group, however
   many, never come together; they are dealt out evenly again before they become rows.

Null texts count as empty, and empty texts equal each other. Rows with the same id, length and content tie: one
of them, in no fixed order, is marked as kept. Rows without an id are taken as rows of id null and sort last. An empty table gives
no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
import uuid
from collections.abc import Iterator
from itertools import batched
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import released, shared_folder, with_row_key

SPACES = b" \t\n\x0b\x0c\r"
LARGEST = 2**63 - 1


class ContentTable:
    """Open addressing with linear probing; a slot holds the number of an entry, and entries are compared whole."""

    def __init__(self, room: int):
        self.room, self.used = room, 0
        self.slots = np.full(1 << 10, -1, np.int64)
        self.keys: list[int] = []
        self.contents: list[bytes] = []

    def find(self, key: int, content: bytes) -> int:
        """The entry's number; -1 when it is new and there is no room for it."""
        mask = len(self.slots) - 1
        at = key & mask
        while (entry := int(self.slots[at])) >= 0:
            if self.keys[entry] == key and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        if self.contents and self.used + len(content) + 300 > self.room:
            return -1
        self.slots[at] = len(self.contents)
        self.keys.append(key)
        self.contents.append(content)
        self.used += len(content) + 300
        if 2 * len(self.contents) > len(self.slots):
            self.grow()
        return len(self.contents) - 1

    def grow(self) -> None:
        self.slots = np.full(4 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for entry, key in enumerate(self.keys):
            at = key & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def content_key(content: bytes, level: int = 0) -> int:
    """63 bits of a hash that differs from level to level, so that partitions split again."""
    return int.from_bytes(hashlib.blake2b(content, digest_size=8, salt=level.to_bytes(2, "little")).digest(), "little") >> 1


def stored(name: str) -> Iterator:
    with open(name, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def grace(rows: Iterator[tuple], room: int, folder: str, level: int = 1, parts: int = 16) -> Iterator[tuple]:
    """For each (content, entry number, count, length and id of its best row): (number, id that stays, group size, content digest, whether the row that stays is here).

    The table holds different contents, with the best row and the count of each; numbers go to one side file and are read back when all
    are counted. Contents beyond the room go to spill files; those in the table never do.
    """
    table, best, total = ContentTable(room), [], []
    side = os.path.join(folder, f"{level}-{os.urandom(4).hex()}")
    spilled = {i: f"{side}-{i}" for i in range(parts)}
    files: dict[int, BinaryIO] = {}
    try:
        with open(side, "wb") as held:
            for row in rows:
                content, number, count, length, i = row
                slot = table.find(content_key(content), content)
                if slot < 0:
                    part = content_key(content, level) % parts
                    if part not in files:
                        files[part] = open(spilled[part], "wb")  # noqa: SIM115
                    pickle.dump(row, files[part])
                    continue
                top = (-length, LARGEST if i is None else i, number)
                if slot == len(best):
                    best.append(top)
                    total.append(0)
                best[slot] = min(best[slot], top)
                total[slot] += count
                pickle.dump((slot, number), held)
    finally:
        for f in files.values():
            f.close()
    digests = [hashlib.sha256(c).hexdigest() for c in table.contents]
    del table
    for slot, number in stored(side):
        _, stays, first = best[slot]
        yield number, None if stays == LARGEST else stays, total[slot], digests[slot], number == first
    os.remove(side)
    del best, total, digests
    for part in files:
        yield from grace(stored(spilled[part]), room, folder, level + 1, parts)
        os.remove(spilled[part])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", room: int = 48 << 20, row_col: str | None = None) -> DataFrame:
    """One row for each row of docs: (id, keep_id, group_size, kept, text_sha256), and row_col, a long, if named.

    room: bytes of content that a task holds in memory at once.
    """
    columns = ["ids", *(["rows"] if row_col else [])]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int64())] * len(columns))]
    names = ["key", "content", "count", "length", "best", "place", *columns]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries: key and content, how many rows, length, id and place of the best one, all ids."""

        def out(table: ContentTable, groups: list) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(groups), 500):
                part = groups[lo : lo + 500]
                values = [table.keys[lo : lo + 500], table.contents[lo : lo + 500], [len(g[1]) for g in part], [-g[0][0] for g in part], [None if g[0][1] == LARGEST else g[0][1] for g in part], [g[0][2] for g in part], [g[1] for g in part], [g[2] for g in part]]
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(values, kinds, strict=False)], names=names)

        table, groups, n = ContentTable(room // 2), [], 0
        for batch in batches:
            ids = batch[0].to_pylist()
            keys = batch[2].to_pylist() if row_col else ids
            for i, value, own in zip(ids, batch[1], keys, strict=True):
                text = value.as_py() or ""
                content = text.encode("utf-8", "surrogateescape").translate(None, SPACES)
                key = content_key(content)
                slot = table.find(key, content)
                if slot < 0 or n > 500_000:
                    yield from out(table, groups)
                    table, groups, n = ContentTable(room // 2), [], 0
                    slot = table.find(key, content)
                if slot == len(groups):
                    groups.append([(1, LARGEST, 0), [], []])
                g = groups[slot]
                g[0] = min(g[0], (-len(text), LARGEST if i is None else i, len(g[1])))
                g[1].append(i)
                if row_col:
                    g[2].append(own)
                n += 1
        yield from out(table, groups)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(x.as_py() for x in row) for b in batches for row in zip(*b.columns, strict=True))
        found = ("entry", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string()), ("here", pa.bool_())
        with tempfile.TemporaryDirectory(prefix="grace-") as folder:
            for part in batched(grace(rows, room, folder), 5000):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], kind) for k, (_, kind) in enumerate(found)], names=[n for n, _ in found])

    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.col(row_col).alias("row")] if row_col else []))
    merged = read.mapInArrow(released(merge), "key long, content binary, count long, length long, best long, place long, ids array<long>" + (", rows array<long>" if row_col else ""))
    path = f"{shared_folder(spark)}/entries-{uuid.uuid4().hex}"
    merged.withColumn("entry", F.monotonically_increasing_id()).write.parquet(path)
    entries = spark.read.parquet(path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.select("key", "content", "entry", "count", "length", "best").repartition(n, "key").select("content", "entry", "count", "length", "best")
    found = dealt.mapInArrow(released(reduce), "entry long, keep_id long, group_size long, text_sha256 string, here boolean")
    met = entries.select("entry", "place", *columns).join(found, "entry").repartition(n)
    rows = met.select(F.posexplode(F.arrays_zip(*columns)).alias("at", "x"), "keep_id", "group_size", "text_sha256", "here", "place")
    kept = F.col("here") & (F.col("at") == F.col("place"))
    return rows.select(F.col("x.ids").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256", *([F.col("x.rows").alias(row_col)] if row_col else []))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that do not stay; ids may be null or occur several times."""
    keyed, row = with_row_key(docs)
    kept = exact_groups(keyed, id_col, text_col, row_col=row).where("kept").select(F.col(row))
    return keyed.join(kept, row, "left_semi").select(*docs.columns)
