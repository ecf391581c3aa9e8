"""The trie of conversation prefixes, by collapsing whole sequences.

A prefix of a conversation is named by its length and by the exclusive or of two 64-bit hashes of (place, digest of the turn): a set of places and
turns is the sequence, so a running aggregate over the sorted turns names all prefixes without ever holding a conversation, and two different prefixes
have one name with a chance of 2^-128. Conversations with the same whole sequence become one weighted sequence with the list of their ids; only its
smallest conversation's turns go on. Sequences that are a proper prefix of another one are found by an anti-join, the rest are the leaves. Nodes
are the weighted prefixes, aggregated before they are shuffled, so the root or a first turn that all share is no hot task.

A node's smallest member owns it, and owners have one node of each depth at most. So what a subtree needs is summed along the owners' sequences from
their ends, and then over all sequences that have the prefix. Lists of ids are written as texts by ranges of (sequence, id), and hashed in one pass in order of the
ids; a task holds one piece of a list at a time.

Turns that tie are in the order of role, the first 32 characters of the text and the digest. A null turn is first, a null role or text is empty, and rows without a conversation belong to none and are
left out. A conversation without turns, as rebuilding may leave it, is a member of the root alone. No conversations give no nodes. Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, partitions

NAME = ["depth", "a", "b"]


def running(rows: DataFrame, key: str, at: str, back: bool = False, chunk: int = 1 << 14, **totals) -> DataFrame:
    """rows with running totals along ``at``, a place from 0, for each key: name=(column, aggregate, how to join two of its values).

    Places are dealt in chunks, and what the chunks before sum up to is added, so a key of any size is no task of its own. back: from the last place on.
    """
    rows = rows.withColumn("chunk", F.floor(F.col(at) / chunk))
    order = (lambda c: F.col(c).desc()) if back else F.col
    here = Window.partitionBy(key, "chunk").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy(order("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(key, "chunk").agg(*(f(c).alias(name) for name, (c, f, _) in totals.items()))
    sums = sums.select(key, "chunk", *(f(name).over(before).alias(f"{name}_before") for name, (_, f, _) in totals.items()))
    sums = sums.where(F.col(f"{next(iter(totals))}_before").isNotNull())  # none, unless a key has several chunks
    out = rows.withColumns({name: f(c).over(here) for name, (c, f, _) in totals.items()}).join(sums, [key, "chunk"], "left")
    return out.withColumns({name: F.coalesce(add(F.col(name), F.col(f"{name}_before")), name) for name, (_, _, add) in totals.items()}).drop("chunk", *(f"{name}_before" for name in totals))


def numbered(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, k, digest, n_bytes): the turns of each conversation, numbered from 1, with a digest of role and text and the text's bytes.

    Turns are dealt by ranges of (conversation, turn), so a conversation of any size is spread, and numbers go on from the range before.
    """
    rows = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    said = F.concat(F.octet_length("role").cast("string"), F.lit(" "), F.col("role"), F.col("text"))
    rows = rows.select("conv", "turn", "role", F.substring("text", 1, 32).alias("begin"), F.unhex(F.sha2(said, 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    order = [F.col("turn").asc_nulls_first(), "role", "begin", "digest"]
    dealt = cut(rows.repartitionByRange(partitions(rows), "conv", *order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("conv", "part").agg(F.count("*").alias("n")).select("conv", "part", F.sum("n").over(before).alias("more")).where("more is not null")
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order))
    return dealt.withColumn("place", place).join(sizes, ["conv", "part"], "left").select("conv", (F.col("place") + F.coalesce("more", F.lit(0))).cast("int").alias("k"), "digest", "n_bytes")


def rebuilt(rows: DataFrame, group: int = 5, longest: int = 9, **columns) -> DataFrame:
    """(conv, k, digest, n_bytes) of conversations that begin like the first one of their group, and a row with k = 0 for each.

    Conversation c takes the first h turns of conversation c - c % group, and its own turns after its first h, with h = crc32(c as text) % longest.
    """
    turns = cut(numbered(rows, **columns))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(longest)).cast("int")
    convs = turns.select("conv").distinct().select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    heads = turns.where((F.col("k") < longest) & (F.col("conv") % group == 0)).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("k", "digest", "n_bytes"))).alias("head"))
    begun = convs.join(heads, "base", "left").select("conv", "h", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h")).alias("head"))
    root = F.array(F.struct(F.lit(0).cast("int").alias("k"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_bytes")))
    first = begun.select("conv", F.explode(F.concat(root, "head")).alias("t")).select("conv", "t.*")
    tail = turns.join(begun.select("conv", "h", F.size("head").alias("n_head")), "conv").where("k > h").select("conv", (F.col("k") - F.col("h") + F.col("n_head")).cast("int").alias("k"), "digest", "n_bytes")
    return first.unionByName(tail)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, a, b, up_a, up_b, n_bytes): the name of every prefix, its parent's name, and the bytes of its last text."""
    one = F.when(F.col("k") > 0, F.xxhash64("k", "digest")).otherwise(F.lit(0))
    two = F.when(F.col("k") > 0, F.xxhash64(F.lit("second"), "digest", "k")).otherwise(F.lit(0))
    named = turns.select("conv", F.col("k").alias("depth"), one.alias("one"), two.alias("two"), "n_bytes")
    xor = lambda x, y: x.bitwiseXOR(y)
    named = running(named, "conv", "depth", a=("one", F.bit_xor, xor), b=("two", F.bit_xor, xor))
    return named.select("conv", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("one")).alias("up_a"), F.col("b").bitwiseXOR(F.col("two")).alias("up_b"), "n_bytes")


def list_digests(ids: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the decimal ids (column conv) of each name, ascending and joined by commas."""

    def written(batches: Iterator[pa.RecordBatch], piece: int = 4096) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        name = None

        def out() -> pa.RecordBatch:
            text = ",".join(str(c) for c in held).encode()
            return pa.RecordBatch.from_pylist([{**dict(zip(NAME, name)), "first": held[0], "text": text}], schema)

        schema = pa.schema([("depth", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("text", pa.binary())])
        for batch in batches:
            for *key, conv in zip(*(batch[c].to_pylist() for c in [*NAME, "conv"])):
                if held and (key != name or len(held) == piece):
                    yield out()
                    held = []
                name = key
                held.append(conv)
        if held:
            yield out()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("depth", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
        name, state = None, None
        for batch in batches:
            done = []
            for *key, text in zip(*(batch[c].to_pylist() for c in [*NAME, "text"])):
                if key != name:
                    if state is not None:
                        done.append({**dict(zip(NAME, name)), "ends_sha256": state.hexdigest()})
                    name, state = key, hashlib.sha256(text)
                else:
                    state.update(b"," + text)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{**dict(zip(NAME, name)), "ends_sha256": state.hexdigest()}], schema)

    n = partitions(ids)
    pieces = ids.repartitionByRange(n, *NAME, "conv").sortWithinPartitions(*NAME, "conv").mapInArrow(written, "depth int, a long, b long, first long, text binary")
    return pieces.repartition(n, *NAME).sortWithinPartitions(*NAME, "first").mapInArrow(hashed, "depth int, a long, b long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of all prefixes of conversations; turns as of ``rebuilt``.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), as whose smallest members and counts of members,
    children, childless nodes in the subtree, bytes that sharing saves there, and digest of the members that end here.
    """
    named = cut(prefixes(cut(turns)))
    ends = named.groupBy("conv").agg(F.max(F.struct(*NAME)).alias("e")).select("conv", "e.*")
    sequences = ends.groupBy(*NAME).agg(F.min("conv").alias("conv"), F.count("*").alias("n"))
    heads = sequences.select("conv", "n", F.col("depth").alias("n_turns"))
    kept = cut(named.join(heads, "conv"))
    inner = kept.where("depth < n_turns").select(*NAME).distinct()
    leaves = sequences.join(inner, NAME, "left_anti").select("conv", F.lit(1).cast("long").alias("leaf"))
    weighted = kept.join(leaves, "conv", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0)))
    nodes = weighted.groupBy(*NAME).agg(F.sum("n").alias("n_convs"), F.min("conv").alias("conv"), F.sum("leaf").alias("n_leaves"), F.first("up_a").alias("up_a"), F.first("up_b").alias("up_b"), F.first("n_bytes").alias("n_bytes"))
    nodes = cut(nodes)
    saves = nodes.select("conv", "depth", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saves"))
    along = kept.join(saves, ["conv", "depth"], "left").select("conv", *NAME, F.coalesce("saves", F.lit(0)).alias("saves"))
    along = running(along, "conv", "depth", back=True, below=("saves", F.sum, lambda x, y: x + y))
    saved = along.groupBy(*NAME).agg(F.sum("below").alias("saved_tokens"))
    up = [(F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv").alias("parent"))
    out = nodes.join(saved, NAME).join(children, NAME, "left").join(list_digests(ends), NAME, "left").join(parents, ["depth", "up_a", "up_b"], "left")
    return out.select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
