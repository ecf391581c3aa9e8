"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Texts become lower-case words (runs of letters and digits). A mask of ones and zeros is laid on every place of a word
list, and the words under its ones are hashed together; words under zeros may differ. Hashes of benchmark items and of
documents are joined. Each hit fixes an alignment of a document with an item; along it the words are compared, and
the pair counts when some ``window`` aligned places (the whole item if it is shorter) have at least ``share`` equal words.

The masks lose no pair that counts. Those for whole windows of 13 words leave at least one hit for each of the 286 ways to place
three differences; items of fewer words have masks of their own length, made of pairs of blocks: of d + 2 blocks at least
two are free of d differences. With another window or share all lengths use such blocks. Only lengths that the benchmark has are hashed.

The hashes of a benchmark (about 40 bytes each) and its words (8 bytes each) are broadcast after they have been counted; hits are reduced to one row for
each alignment in the map tasks. With more than ``broadcast_rows`` hashes all that is shuffled by hash are short rows (row, place, hash): documents get a
row key, alignments are reduced to distinct ones, and only then are the words of those documents and items that have any joined back. A frequent hash, as
of an item of one common word, is dealt out over ``salts`` tasks, and Spark's adaptive joins split what is still too large. Texts are then hashed
in pieces of PIECE words, which overlap by a mask.

Null and empty texts have no words, so they match nothing. A document that has an item several times, or several rows of one id, gives
one row for each pair with its best overlap; rows with a null document id count as one document, and so do items with a null id. Empty
tables give no rows. Other columns, whatever their names, are not read. Texts are read whole.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import with_row_key

#: Found by search: of all 286 ways to place three differences in 13 words, each leaves one of these intact somewhere.
MASKS = ("111011", "11001011", "1101000101")
WINDOW, SHARE = 13, 0.75
PIECE = 4096


def block_masks(length: int, differences: int) -> tuple[str, ...]:
    """Masks over a whole window, each with the ones of two of ``differences`` + 2 blocks; some are hit by no difference."""
    n = min(length, differences + 2)
    if not differences:
        return ("1" * length,)
    bounds = [k * length // n for k in range(n + 1)]
    return tuple("".join("1" if any(bounds[b] <= i < bounds[b + 1] for b in pair) else "0" for i in range(length)).strip("0") for pair in combinations(range(n), n - differences))


def masks_for(length: int, window: int = WINDOW, share: float = SHARE) -> tuple[str, ...]:
    """The masks of items of a length; all lengths from ``window`` on have the same."""
    length = min(length, window)
    if length == WINDOW and math.ceil(length * share) >= 10:
        return MASKS
    return block_masks(length, length - math.ceil(length * share))


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def seed_hashes(words: Column, masks: tuple[str, ...], kind: int, places: Column | None = None) -> Column:
    """Hashes of all masks at all places (the first ``places`` ones), mask by mask, a null where a mask would end behind the words; ``kind`` keeps sets of masks apart."""
    places = F.size(words) if places is None else places

    def at(mask: str, number: int) -> Column:
        ones = [i for i, c in enumerate(mask) if c == "1"]
        seed = lambda i: F.when(i + len(mask) <= F.size(words), F.xxhash64(F.lit(1000 * kind + number), *(F.get(words, i + p) for p in ones)))
        return F.transform(F.sequence(F.lit(0), places - 1), seed)

    return F.when(F.size(words) > 0, F.concat(*(at(m, k) for k, m in enumerate(masks))))


def all_hashes(words: Column, kinds: dict[int, tuple[str, ...]], places: Column | None = None) -> Column:
    return F.concat(*(seed_hashes(words, m, k, places) for k, m in kinds.items()))


def placed_seeds(read: DataFrame, kinds: dict[int, tuple[str, ...]], keep: list[str]) -> DataFrame:
    """(keep ..., place, seed) of all masks at all places of doc_words, cut into pieces of PIECE places first, so rows stay short."""
    longest = max(len(m) for masks in kinds.values() for m in masks)
    starts = F.sequence(F.lit(0), F.greatest(F.size("doc_words") - 1, F.lit(0)), F.lit(PIECE))
    pieces = F.transform(starts, lambda at: F.struct(at.alias("start"), F.slice("doc_words", at + 1, F.lit(PIECE + longest - 1)).alias("words")))
    cut_up = read.select(*keep, F.explode(pieces).alias("p")).select(*keep, "p.*")
    places = F.least(F.size("words"), F.lit(PIECE))
    hashed = cut_up.select(*keep, "start", places.alias("places"), all_hashes(F.col("words"), kinds, places).alias("seeds"))
    hashed = hashed.select(*keep, "start", "places", F.posexplode_outer("seeds").alias("n", "seed"))
    return hashed.select(*keep, (F.expr("n % places") + F.col("start")).alias("place"), "seed")


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    share: float = SHARE,
    broadcast_rows: int = 1_000_000,
    salts: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, item id, n_window: aligned places looked at, n_equal: the most equal words among them)."""

    def hashed(frame: DataFrame, key: str, text: str, name: str, *more: str) -> DataFrame:
        # Words are compared by their hashes, which are shorter.
        return frame.select(*more, F.col(key).alias(name), F.transform(word_list(F.col(text)), lambda w: F.xxhash64(w)).alias(f"{name}_words"))

    # An item row has a number of its own, as ids may be null or repeated.
    items = hashed(benchmark, item_col, item_text_col, "item").where(F.size("item_words") > 0).withColumn("row", F.xxhash64("item", "item_words"))
    length = F.least(F.size("item_words"), F.lit(window))
    sizes = items.groupBy(length.alias("length")).agg(F.sum(F.size("item_words")).alias("n")).collect()  # at most ``window`` rows
    kinds = {r["length"]: masks_for(r["length"], window, share) for r in sizes} or {window: masks_for(window, window, share)}
    own = F.coalesce(*(F.when(length == k, seed_hashes(F.col("item_words"), m, k)) for k, m in kinds.items()))
    # The outer form of posexplode: of the other one Spark makes a filter that lists the words anew for each hash.
    seeds = items.select("row", F.size("item_words").alias("size"), F.posexplode_outer(own).alias("n", "seed")).where("seed is not null").select("row", "seed", F.expr("n % size").alias("item_at"))
    words = items.select("row", "item", "item_words").dropDuplicates(["row"])
    if sum(r["n"] * len(kinds[r["length"]]) for r in sizes) <= broadcast_rows:
        read = hashed(docs, id_col, text_col, "doc")
        # The outer form of posexplode: of the other one Spark makes a filter that lists the words anew for each hash.
        placed = read.withColumn("seeds", all_hashes(F.col("doc_words"), kinds)).select("doc", "doc_words", F.posexplode_outer("seeds").alias("n", "seed"))
        hits = placed.join(F.broadcast(seeds), "seed").withColumn("shift", F.expr("n % size(doc_words) - item_at")).join(F.broadcast(words), "row")
    else:
        keyed, key = with_row_key(docs)
        read = hashed(keyed.select(F.col(key).alias("__key"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__id", "__text", "doc", "__key")
        narrow = placed_seeds(read, kinds, ["__key"]).where("seed is not null").withColumn("salt", F.pmod(F.xxhash64("__key"), F.lit(salts)).cast("int"))
        spread = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = narrow.join(spread, ["seed", "salt"]).select("__key", "row", (F.col("place") - F.col("item_at")).alias("shift")).distinct()
        hits = met.join(read, "__key").join(words, "row").drop("__key")
    # Ones and zeros along the alignment; places outside the document are zeros.
    same = F.array_join(F.transform("item_words", lambda w, i: F.when((i + F.col("shift") >= 0) & (F.get("doc_words", F.greatest(i + F.col("shift"), F.lit(0))) == w), F.lit("1")).otherwise(F.lit("0"))), "")
    width = F.least(F.length("same"), F.lit(window))
    ones = lambda s: F.length(F.replace(s, F.lit("0"), F.lit("")))
    # The comparison is the same for all hits of an alignment; as an aggregate it stays above the join, which then runs as compiled code.
    # Rows of one id may have different texts under one alignment, so the words' places are compared with those of each text.
    aligned = hits.groupBy("doc", "item", "row", "shift", F.xxhash64("doc_words").alias("text")).agg(F.max(same).alias("same")).where(ones(F.col("same")) >= F.ceil(width * share))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.length("same") - width + 1), lambda i: ones(F.substr(F.col("same"), i, width))))
    found = aligned.select("doc", "item", width.alias("n_window"), best.alias("n_equal")).where(F.col("n_equal") >= F.ceil(F.col("n_window") * share))
    out = found.groupBy("doc", "item").agg(F.max("n_window").cast("long").alias("n_window"), F.max("n_equal").cast("long").alias("n_equal"))
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_window", "n_equal")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the rows that have an overlap with an item; ids are not looked at."""
    keyed, row = with_row_key(docs)
    bad = overlaps(keyed, benchmark, **{**how, "id_col": row}).select(row).distinct()
    return keyed.join(bad, row, "left_anti").select(*docs.columns)
