"""N-gram Jaccard self-join by signature trees.

A document's set holds the hashes of its distinct k-word shingles (64 bits; words are lower-cased in A-Z). Documents link when
the Jaccard similarity of their sets is at least ``num / den``.

1. Equal sets are one: what follows works on sets, named by a 64-bit hash of all their shingles.
2. Sets meet at keys. Two similar sets share one of their first n - ceil(n num/den) + 1 shingles, in any order that is the
   same for all sets; here by how often a shingle's bucket occurs in the corpus (bounded counters, summed over all
   documents), so that common passages come last and make few keys. Keys travel as packed arrays; the order only sets the
   cost, and no key is dropped.
3. The sets of a key make a signature tree: leaves hold bitmaps of the sets' shingles, inner nodes OR-combined bitmaps and size
   ranges. Both ends of a pair descend together, and a pair of nodes is pruned when its sizes cannot match or when the
   common bits, and the bits that stand for several shingles, allow too small an overlap.
   Sets that may match their group's leader are one with it already; the others meet each other and those. A group of more than ``block`` sets is
   cut into blocks, and each pair of blocks that has something to settle is a tree of its own, so no task holds more than two blocks.
4. What survives is joined into families; only their sets are read in full. Each is compared exactly with its family's leader.
   Those that do not link to it meet the family in pairs of blocks again, where a second tree leaves the pairs that
   are compared exactly. Pairs that are in one component already are not compared. Links make the components.

Null and empty texts, and texts without words, have an empty set and link with nothing; a text of fewer than k words has one
shingle, the whole sequence. Repeated rows link by their equal sets; rows without an id are linked by equal sets alone. Texts of any length are read whole. Other columns are
not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import Spans, U, mix, pieces, shingle_hashes, text_bytes, word_bounds
from ._spark import by_key, components, cut, partitions, released, summed_counters, with_row_key

BUCKETS = 1 << 16
LEAF = 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    start, end, first = word_bounds(data, offsets)
    words = Spans(data, lower=True).hash(start, end)
    return [np.unique(shingle_hashes(words[a:b], k)) for a, b in zip(first[:-1], first[1:], strict=True)]


def set_name(s: np.ndarray) -> int:
    """A hash of a set; 0 for the empty one."""
    if not len(s):
        return 0
    x = mix(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U).reshape(1) + U(len(s)))[0]
    return int(x.view(np.int64)) or 1


def size_class(n: int) -> int:
    return max(4, int(n).bit_length() - 1)


def signature(s: np.ndarray) -> bytes:
    """A bitmap of four bits for each 2**class shingles: 2 to 4 bits for each shingle of the set."""
    width = 1 << (size_class(len(s)) + 2)
    bits = np.zeros(width, bool)
    bits[(s & U(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def windows(sizes: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """Size classes, and the members that a set of this class may match in it or above; each pair is in the smaller one's class."""
    classes = np.array([size_class(n) for n in sizes.tolist()])
    for c in np.unique(classes).tolist():
        top = ((1 << (c + 1)) * den + num - 1) // num
        member = np.flatnonzero((classes >= c) & ((sizes <= top) | (classes == c)))
        if len(member) > 1:
            yield c, member


def may_match(n: int, m: int, a: bytes, b: bytes, num: int, den: int) -> bool:
    """Whether two sets of n and m shingles can link, by their bitmaps."""
    if n * den < m * num or m * den < n * num:
        return False
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    slack = min(n - int(np.bitwise_count(x).sum()), m - int(np.bitwise_count(y).sum()))
    return min(slack + int(np.bitwise_count(x & y).sum()), n, m) * (num + den) >= num * (n + m)


def similar_sets(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


class SignatureTree:
    """Bitmaps of one width over sets in order of size, in leaves of LEAF sets; nodes halve the leaves."""

    def __init__(self, sizes: np.ndarray, bitmaps: list[bytes], c: int, num: int, den: int):
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.num, self.den = num, den
        width = 1 << (c + 2)
        rows = []
        for i in self.order.tolist():
            b = np.frombuffer(bitmaps[i], np.uint64)
            while len(b) * 64 > width:  # fold: bits of a set are its hashes modulo the width
                b = b[: len(b) // 2] | b[len(b) // 2 :]
            rows.append(b)
        self.bits = np.stack(rows)
        self.slack = self.sizes - np.bitwise_count(self.bits).sum(1, dtype=np.int64)

    def node(self, lo: int, hi: int) -> tuple:
        """(OR of bitmaps, least size, largest size, most shingles beyond the bits) of a range of sets."""
        return np.bitwise_or.reduce(self.bits[lo:hi], axis=0), int(self.sizes[lo]), int(self.sizes[hi - 1]), int(self.slack[lo:hi].max())

    def apart(self, x: tuple, y: tuple) -> bool:
        """Whether no set of one node can match one of the other."""
        if x[2] * self.den < y[1] * self.num or y[2] * self.den < x[1] * self.num:
            return True
        overlap = min(x[3], y[3]) + int(np.bitwise_count(x[0] & y[0]).sum())
        return overlap * (self.num + self.den) < self.num * (x[1] + y[1])

    def pairs(self, joined: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j) of pairs that may match; those with equal labels in ``joined``, which may change meanwhile, are skipped."""
        n = len(self.sizes)
        known: dict[tuple[int, int], tuple] = {}

        def of(r: tuple[int, int]) -> tuple:
            if r not in known:
                known[r] = self.node(*r)
            return known[r]

        def halves(r: tuple[int, int]) -> list[tuple[int, int]]:
            leaves = -(-(r[1] - r[0]) // LEAF)
            mid = r[0] + (leaves + 1) // 2 * LEAF
            return [(r[0], mid), (mid, r[1])]

        stack = [((0, n), (0, n))]
        while stack:
            x, y = stack.pop()
            if x != y and self.apart(of(x), of(y)):
                continue
            if joined is not None:
                label = joined[self.order[x[0]]]
                if (joined[self.order[x[0] : x[1]]] == label).all() and (joined[self.order[y[0] : y[1]]] == label).all():
                    continue
            big_x, big_y = x[1] - x[0] > LEAF, y[1] - y[0] > LEAF
            if x == y and big_x:
                a, b = halves(x)
                stack += [(a, b), (b, b), (a, a)]
            elif big_x and (not big_y or x[1] - x[0] >= y[1] - y[0]):
                stack += [(h, y) for h in halves(x)]
            elif big_y:
                stack += [(x, h) for h in halves(y)]
            else:
                i, j = np.arange(*x), np.arange(*y)
                common = np.bitwise_count(self.bits[x[0] : x[1], None, :] & self.bits[None, y[0] : y[1], :]).sum(2, dtype=np.int64)
                overlap = np.minimum(self.slack[i][:, None], self.slack[j][None, :]) + common
                overlap = np.minimum(overlap, np.minimum(self.sizes[i][:, None], self.sizes[j][None, :]))
                ok = overlap * (self.num + self.den) >= self.num * (self.sizes[i][:, None] + self.sizes[j][None, :])
                if x == y:
                    ok &= i[:, None] < j[None, :]
                p, q = np.nonzero(ok)
                if len(p):
                    yield self.order[i[p]], self.order[j[q]]


class Joined:
    """Labels of members; joining two labels renames the smaller group."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members = {i: [i] for i in range(n)}

    def join(self, i: int, j: int) -> None:
        a, b = int(self.label[i]), int(self.label[j])
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.label[moved] = a
        self.members[a] += moved


def joined_where(near: np.ndarray | None, n: int) -> Joined:
    """Labels in which the members marked near are one already."""
    found = Joined(n)
    if near is not None and near.any():
        at = np.flatnonzero(near)
        for i in at[1:].tolist():
            found.join(int(at[0]), i)
    return found


def likely(sizes: np.ndarray, bitmaps: list[bytes], num: int, den: int, near: np.ndarray | None = None) -> np.ndarray:
    """Labels that join the members whose bitmaps allow a link; those marked near are one from the start."""
    found = joined_where(near, len(sizes))
    for c, member in windows(sizes, num, den):
        sub = found.label[member].copy()
        if (sub == sub[0]).all():
            continue
        tree = SignatureTree(sizes[member], [bitmaps[i] for i in member.tolist()], c, num, den)
        for i, j in tree.pairs(sub):
            i, j = member[i], member[j]
            while len(rest := np.flatnonzero(found.label[i] != found.label[j])):
                found.join(int(i[rest[0]]), int(j[rest[0]]))
                i, j = i[rest[1:]], j[rest[1:]]
            sub[:] = found.label[member]
    return found.label


def linked(sets: list[np.ndarray], num: int, den: int, near: np.ndarray | None = None) -> np.ndarray:
    """Labels of the components of links, by exact comparison of what the bitmaps allow; sets marked near are one from the start."""
    sizes = np.array(list(map(len, sets)), np.int64)
    bitmaps = [signature(s) for s in sets]
    found = joined_where(near, len(sets))
    for c, member in windows(sizes, num, den):
        sub = found.label[member].copy()
        tree = SignatureTree(sizes[member], [bitmaps[i] for i in member.tolist()], c, num, den)
        for i, j in tree.pairs(sub):
            i, j = member[i], member[j]
            while len(rest := np.flatnonzero(found.label[i] != found.label[j])):
                x, y = int(i[rest[0]]), int(j[rest[0]])
                if similar_sets(sets[x], sets[y], num, den):
                    found.join(x, y)
                i, j = i[rest[1:]], j[rest[1:]]
            sub[:] = found.label[member]
    return found.label


def spanning(label: np.ndarray, names: list[int], near: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of names that connect the members of each label. Members marked near are connected elsewhere, so one stands for all."""
    head: dict[int, int] = {}
    seen_near = False
    for x, name, is_near in zip(label.tolist(), names, near.tolist(), strict=True):
        if is_near:
            if seen_near:
                continue
            seen_near = True
        if x in head:
            yield head[x], name
        else:
            head[x] = name


def in_cells(rows: DataFrame, group: str, block: int) -> DataFrame:
    """rows (group, name, near, ...) with a column ``cell``: every pair of members of a group, one of which is not near, has a cell in common.

    A group of up to ``block`` members is one cell. Larger ones are cut into blocks by name, those that are near apart from the others,
    and a cell holds two blocks, not both near.
    """
    sizes = rows.groupBy(group).agg(F.count_if(~F.col("near")).alias("n_far"), F.count_if("near").alias("n_near"))
    # A group's sizes are copied a few times, so that the rows of a large group go to several tasks.
    salts = 8
    copies = sizes.where("n_far > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = rows.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(salts)).cast("int")).join(copies, [group, "salt"]).drop("salt")
    far, near = (F.ceil(F.col(c) / block).cast("int") for c in ("n_far", "n_near"))
    own = lambda n: F.pmod(F.xxhash64("name"), n).cast("int")
    every = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<bigint>"))
    cell = lambda kind, a, b: F.xxhash64(group, F.lit(kind), a, b)
    of_far = F.concat(every(far, lambda j: cell(1, F.least(own(far), j), F.greatest(own(far), j))), every(near, lambda j: cell(2, own(far), j)))
    of_near = every(far, lambda i: cell(2, i, own(near)))
    cells = F.when(F.col("n_far") + F.col("n_near") <= block, F.array(cell(0, F.lit(0), F.lit(0)))).when(F.col("near"), of_near).otherwise(of_far)
    return met.withColumn("cell", F.explode(cells)).drop("n_far", "n_near")


def keys_of(s: np.ndarray, frequency: np.ndarray, num: int, den: int) -> np.ndarray:
    """The shingles at which a set meets its like."""
    n = len(s)
    take = n - -(-n * num // den) + 1
    if take >= n:
        return s
    order = np.lexsort((s, frequency[(s >> U(48)).astype(np.int64)]))
    return s[order[:take]]


def similarity_components(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, block: int = 2000, set_block: int = 400, broadcast_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    block: bitmaps, and set_block: sets, of a group that one task holds at once in half a cell; a larger group is dealt out in pairs of blocks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    n_parts = partitions(docs)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = np.zeros(BUCKETS, np.int64)
        for b in batches:
            data, off = text_bytes(b[1])
            for lo, hi in pieces(off):
                sets = shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
                for s in sets:
                    frequency += np.bincount((s >> U(48)).astype(np.int64), minlength=BUCKETS) if len(s) > 20_000 else 0
                some = [s for s in sets if len(s) <= 20_000]
                if some:
                    frequency += np.bincount((np.concatenate(some) >> U(48)).astype(np.int64), minlength=BUCKETS)
                yield pa.RecordBatch.from_arrays(
                    [b[0].slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_name(s) for s in sets], pa.int64()), pa.array([signature(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(hi - lo, pa.binary())],
                    names=["doc", "n", "name", "bitmap", "frequency"],
                )
        none = [pa.nulls(1, pa.int64())] * 3
        yield pa.RecordBatch.from_arrays([*none, pa.nulls(1, pa.binary()), pa.array([frequency.tobytes()], pa.binary())], names=["doc", "n", "name", "bitmap", "frequency"])

    described = cut(rows.mapInArrow(released(describe), "doc long, n long, name long, bitmap binary, frequency binary"))
    sets = described.where("n is not null").select("doc", "n", "name", "bitmap")
    frequency = summed_counters(described.where("frequency is not null").select("frequency"), BUCKETS)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_bytes(b[1])
            for lo, hi in pieces(off, 4 << 20):
                found: dict[int, np.ndarray] = {}
                size: dict[int, int] = {}
                for s in (s for a, z in pieces(off[lo : hi + 1], 1 << 20) for s in shingle_sets(data[off[lo + a] : off[lo + z]], off[lo + a : lo + z + 1] - off[lo + a], k)):
                    if len(s) and (name := set_name(s)) not in found:
                        found[name], size[name] = keys_of(s, frequency, num, den), len(s)
                if not found:
                    continue
                count = np.array(list(map(len, found.values())))
                keys = np.concatenate(list(found.values()))
                packed = np.empty(len(keys), [("key", "<u8"), ("name", "<i8"), ("n", "<i4")])
                packed["key"], packed["name"], packed["n"] = keys, np.repeat(np.array(list(found), np.int64), count), np.repeat(np.array(list(size.values())), count)
                part = (packed["key"] % U(4 * n_parts)).astype(np.int64)
                packed = packed[np.argsort(part, kind="stable")]
                bound = np.searchsorted(np.sort(part), np.arange(4 * n_parts + 1))
                live = np.flatnonzero(np.diff(bound))
                yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([packed[bound[p] : bound[p + 1]].tobytes() for p in live.tolist()], pa.binary())], names=["part", "packed"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of different sets at one key, once for each list of members."""
        packed = np.frombuffer(b"".join(x.as_py() for b in batches for x in b[0]), [("key", "<u8"), ("name", "<i8"), ("n", "<i4")])
        if not len(packed):
            return
        packed = packed[np.lexsort((packed["name"], packed["n"], packed["key"]))]
        new = np.append(True, (packed["key"][1:] != packed["key"][:-1]) | (packed["name"][1:] != packed["name"][:-1]))
        packed = packed[new]
        # A group also ends where the next size is too large for the one before.
        gap = packed["n"][1:].astype(np.int64) * num > packed["n"][:-1].astype(np.int64) * den
        start = np.flatnonzero(np.append(True, (packed["key"][1:] != packed["key"][:-1]) | gap))
        size = np.diff(np.append(start, len(packed)))
        start, size = start[size > 1], size[size > 1]
        if not len(start):
            return
        total = np.append(np.zeros(1, U), np.cumsum(mix(packed["name"].view(U) if packed["name"].flags.c_contiguous else packed["name"].astype(np.int64).view(U))))
        group = mix(total[start + size] - total[start] + size.astype(U)).view(np.int64)
        _, first = np.unique(group, return_index=True)
        for lo in range(0, len(first), 5000):
            f = first[lo : lo + 5000]
            at = np.repeat(start[f] - (np.cumsum(size[f]) - size[f]), size[f]) + np.arange(size[f].sum())
            members = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size[f])), pa.int32()), pa.array(packed["name"][at].astype(np.int64)))
            leader = packed["name"][start[f] + size[f] // 2].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(group[f]), pa.array(leader), members], names=["grp", "leader", "members"])

    keys = rows.mapInArrow(released(emit), "part int, packed binary").repartition(n_parts, "part").select("packed")
    groups = keys.mapInArrow(released(meet), "grp long, leader long, members array<long>").dropDuplicates(["grp"])
    names = sets.where("n > 0").groupBy("name").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))
    names = cut(names)
    members = groups.select("grp", "leader", F.explode("members").alias("name")).join(names.select("name", "n", "bitmap"), "name")
    # Most groups are near copies of one text: what may match the group's leader needs no tree, however many there are.
    led = members.join(names.select(F.col("name").alias("leader"), F.col("n").alias("leader_n"), F.col("bitmap").alias("leader_bitmap")), "leader")

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, n_leader = b[3].to_numpy(), b[5].to_numpy()
            near = [may_match(x, y, p, q, num, den) for x, y, p, q in zip(n.tolist(), n_leader.tolist(), b[4].to_pylist(), b[6].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[i] for i in range(5)), pa.array(near, pa.bool_())], names=["grp", "leader", "name", "n", "bitmap", "near"])

    flagged = cut(led.select("grp", "leader", "name", "n", "bitmap", "leader_n", "leader_bitmap").mapInArrow(released(beside), "grp long, leader long, name long, n long, bitmap binary, near boolean"))
    stars = flagged.where("near and leader <> name").select(F.col("leader").alias("a"), F.col("name").alias("b"))
    members = in_cells(flagged, "grp", block)

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for t in by_key(batches, "cell"):
            near = t["near"].to_numpy(zero_copy_only=False)
            label = likely(t["n"].to_numpy(), t["bitmap"].to_pylist(), num, den, near)
            out += spanning(label, t["name"].to_pylist(), near)
            if len(out) > 10_000:
                yield pairs_of(out)
                out = []
        yield pairs_of(out)

    def pairs_of(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    may = members.repartition(n_parts, "cell").sortWithinPartitions("cell").select("cell", "name", "n", "bitmap", "near").mapInArrow(released(traverse), "a long, b long")
    families = cut(components(may.unionByName(stars)).select(F.col("node").alias("name"), F.col("component").alias("family")))
    chosen = families.join(names.select("name", "doc"), "name")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_bytes(b[3])
            for lo, hi in pieces(off):
                s = shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
                part = pa.RecordBatch.from_arrays([*(b[i].slice(lo, hi - lo) for i in range(3)), pa.array([x.tobytes() for x in s], pa.binary())], names=["family", "name", "doc", "shingles"])
                # A document may have several rows; those with another text do not have this set.
                yield part.filter(pa.array([set_name(x) == y for x, y in zip(s, part[1].to_pylist(), strict=True)], pa.bool_()))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [similar_sets(np.frombuffer(x, U), np.frombuffer(y, U), num, den) for x, y in zip(b[3].to_pylist(), b[4].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[i] for i in range(3)), pa.array(near, pa.bool_())], names=["family", "name", "doc", "near"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "cell"):
            near = t["near"].to_numpy(zero_copy_only=False)
            label = linked([np.frombuffer(x.as_py(), U) for x in t["shingles"]], num, den, near)
            yield pairs_of(list(spanning(label, t["name"].to_pylist(), near)))

    texts = cut(chosen.join(rows, "doc").select("family", "name", "doc", "text").mapInArrow(released(read), "family long, name long, doc long, shingles binary"))
    # A family's smallest name is its leader. What links to it is one component with it; the rest is compared with all of the family.
    heads = texts.where("family = name").dropDuplicates(["family"]).select("family", F.col("shingles").alias("head"))
    followed = cut(texts.join(heads, "family").select("family", "name", "doc", "shingles", "head").mapInArrow(released(follow), "family long, name long, doc long, near boolean"))
    one = followed.groupBy("family", "name").agg(F.bool_or("near").alias("near"), F.min("doc").alias("doc"))
    whole = one.groupBy("family").agg(F.bool_and("near").alias("whole"), F.min("doc").alias("component"))
    settled = one.select("family", "name").join(whole.where("whole").select("family", "component"), "family").select("name", "component")
    open_ = cut(one.join(whole.where("not whole").select("family"), "family", "left_semi"))
    cells = cut(in_cells(open_, "family", set_block).select("family", "name", "near", "cell"))
    if cells.count() <= broadcast_rows:  # some 40 bytes each; then only the sets of open families are shuffled
        cells = F.broadcast(cells)
    dealt = texts.select("family", "name", "shingles").join(cells, ["family", "name"])
    found = dealt.repartition(n_parts, "cell").sortWithinPartitions("cell").select("cell", "name", "shingles", "near").mapInArrow(released(settle), "a long, b long")
    links = found.unionByName(open_.where("near and family <> name").select(F.col("family").alias("a"), F.col("name").alias("b")))
    groups_ = components(links).join(names.select(F.col("name").alias("node"), "doc"), "node")
    least = groups_.groupBy("component").agg(F.min("doc").alias("least"))
    settled = settled.unionByName(groups_.join(least, "component").select(F.col("node").alias("name"), F.col("least").alias("component")))
    all_names = names.select("name", "doc").join(settled, "name", "left").select("name", F.coalesce("component", "doc").alias("component"))
    out = sets.select("doc", "n", "name").join(all_names, "name", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """docs with one row of each component, the one with the smallest id (null is last); ids may be null or occur several times."""
    keyed, row = with_row_key(docs)
    found = similarity_components(keyed, id_col=row, **how).join(keyed.select(row, F.col(id_col).cast("long").alias("__id")), row)
    rest = found.groupBy("component_id").agg(F.min(F.struct(F.col("__id").isNull(), "__id", row)).alias("least")).select(F.col(f"least.{row}").alias(row))
    return keyed.join(rest, row, "left_semi").select(*docs.columns)
