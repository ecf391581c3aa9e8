"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For a proper merge table every byte prefix of a text has exactly one encoding, so it has exactly one last
token. ``PrefixEncoder`` stores that last token for each prefix; the tokens that end at a position are tried
from the longest down, and one is right when the pair of it and the last token of the prefix before it is
stable: joining their bytes and merging again gives the same pair. Appending bytes therefore extends the
table without touching what is there, and an edit re-encodes from its place until one longest token's entries agree with the old ones.

The text is first cut by the tokenizer's pattern and each match is encoded separately. Words repeat, so each
worker process keeps encodings of matches, by a 64-bit hash, in a table of bounded size; new matches fill their
prefix tables side by side as numpy arrays, and long ones go through ``PrefixEncoder`` itself.

Nulls count as empty texts; an empty text has no tokens; repeated rows are encoded each for itself; other columns,
whatever their names, are not read. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import Spans, U, mix, pieces, text_bytes
from ._spark import released


class BytePairVocabulary:
    """Ranks, and for each token the pair that it was merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.longest = max(map(len, ranks), default=1)
        self.split: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.stable: dict[tuple[int, int], bool] = {}
        for b, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) > 1 and (pair := self._origin(b, r)):
                self.split[r] = pair
                self.joined[pair] = r
        missing = [bytes([i]) for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack single bytes, such as {missing[0]!r}")

    def _origin(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """Merge the token's bytes, lowest rank first and leftmost among equals, until two parts are left."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)))
            if best[0] >= rank:
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def is_stable(self, left: int, right: int) -> bool:
        """Whether the bytes of both, encoded together, give just this pair.

        Undo merges from the latest to the earliest on either side of the seam. A merge across the seam that
        ranks before the last one undone would have happened first, and the pair could not have come about.
        """
        key = (left, right)
        if (known := self.stable.get(key)) is not None:
            return known
        bound, result = len(self.bytes_of), True
        a, b = left, right
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < bound:
                result = False
                break
            parts_a, parts_b = self.split.get(a), self.split.get(b)
            if parts_a is None and parts_b is None:
                break
            # Of equal ranks the left one merges first, so a tie undoes the right one first.
            if parts_b is None or (parts_a is not None and a > b):
                bound, a = a, parts_a[1]
            else:
                bound, b = b + 1, parts_b[0]
        if len(self.stable) < 4_000_000:
            self.stable[key] = result
        return result


class PrefixEncoder:
    """The last token of every byte prefix; exact under appends, truncation and edits."""

    def __init__(self, vocabulary: BytePairVocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend the table; earlier entries stay as they are."""
        at = len(self.data)
        self.data += more
        for end in range(at + 1, len(self.data) + 1):
            self.last.append(self.last_token(end))

    def last_token(self, end: int) -> int:
        """The last token of the prefix of that length, from the entries before it."""
        v, last = self.vocabulary, self.last
        ranks, stable, is_stable = v.ranks, v.stable, v.is_stable
        base = max(0, end - v.longest)
        text = bytes(self.data[base:end])
        for size in range(len(text), 0, -1):
            token = ranks.get(text[len(text) - size :])
            if token is None:
                continue
            if size == end:
                if size == 1 or token in v.split:
                    return token
                continue
            pair = (last[end - size - 1], token)
            known = stable.get(pair)
            if is_stable(*pair) if known is None else known:
                return token
        raise ValueError("the ranks are not those of a byte-pair merge table")  # a single byte always has a valid predecessor

    def truncate(self, size: int) -> None:
        del self.data[size:], self.last[size:]

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace data[start:end]; returns how many entries were worked out again.

        An entry depends on the bytes of one longest token before it and on the entries there. So when that many entries in a row
        behind the edit are what they were, all later ones are, too.
        """
        old = self.last[end:]
        self.data[start:end] = new
        del self.last[start:]
        at, same = start, 0
        while at < len(self.data) and same < self.vocabulary.longest:
            at += 1
            self.last.append(self.last_token(at))
            behind = at - start - len(new)
            same = same + 1 if behind > 0 and self.last[-1] == old[behind - 1] else 0
        if at < len(self.data):
            self.last += old[at - start - len(new) :]
        return at - start

    def tokens(self) -> list[int]:
        out, at, size = [], len(self.data), self.vocabulary.bytes_of
        while at:
            out.append(token := self.last[at - 1])
            at -= len(size[token])
        return out[::-1]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: The pattern whose matches are found by array operations; any other pattern is run by the regex library.
COMMON_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, NUMBER, WHITE, OTHER = 1, 2, 3, 0


@cache
def char_classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for cls, cat in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\p{White_Space}")):
        for m in regex.finditer(f"{cat}+", every):
            at = np.frombuffer(m.group().encode("utf-32-le"), np.uint32)
            out[at] = cls
    return out


def pattern_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which the matches of COMMON_PATTERN begin, rows being apart."""
    if not len(data):
        return np.zeros(0, np.int64)
    text = data.tobytes().decode("utf-8", "surrogateescape")
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    size[(cp >= 0xDC80) & (cp <= 0xDCFF)] = 1
    at = np.cumsum(size) - size
    cls = char_classes()[cp]
    n = len(cp)
    row = np.zeros(n + 1, bool)
    row[np.searchsorted(at, offsets)] = True
    row[n] = True
    start = row[:-1].copy()
    start[1:] |= cls[1:] != cls[:-1]
    # The last white space before something else stands apart, and a plain space goes with what follows.
    last = np.flatnonzero((cls[:-1] == WHITE) & (cls[1:] != WHITE) & ~row[1:-1])
    start[last] = True
    start[last[cp[last] == 32] + 1] = False
    # An apostrophe that begins a match takes one of the seven endings with it.
    q = np.flatnonzero((cp == 39) & start)
    q = q[(q + 1 < n)]
    q = q[(cls[q + 1] == LETTER) & ~row[q + 1]]
    if len(q):
        c1 = cp[q + 1]
        two = (q + 2 < n) & ~row[np.minimum(q + 2, n)]
        c2 = np.where(two, cp[np.minimum(q + 2, n - 1)], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        both = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        for k, which in ((1, one), (2, both)):
            p = q[which]
            start[p + 1] = False
            after = p + 1 + k
            start[after[after < n]] = True
    return at[start]


class ByteBPE:
    """Encodes and decodes texts; keeps at most about ``kept`` encodings of pattern matches, by their hash."""

    SHORT = 48

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = 600_000):
        self.vocabulary = v = BytePairVocabulary(ranks)
        self.pattern, self.find, self.kept = pattern, regex.compile(pattern).finditer, kept
        self.size_of = np.array([len(b) for b in v.bytes_of], np.int64)
        self.token_bytes = np.frombuffer(b"".join(v.bytes_of), np.uint8)
        self.token_at = np.cumsum(self.size_of) - self.size_of
        text = [f"{i},".encode() for i in range(len(v.bytes_of))]
        self.digit_size = np.array(list(map(len, text)), np.int64)
        self.digits, self.digit_at = np.frombuffer(b"".join(text), np.uint8), np.cumsum(self.digit_size) - self.digit_size
        starts = self.token_at
        found = Spans(self.token_bytes).hash(starts, starts + self.size_of)
        order = np.argsort(found, kind="stable")
        order = order[self.size_of[order] > 0]
        self.hashes, self.hash_ids = found[order], order.astype(np.int64)
        self.slots = np.full(1 << 20, -1, np.int64)
        self.slots[(found[order] >> U(44)).astype(np.int64)] = order
        self.token_hash = found
        taken = self.slots[(found[order] >> U(44)).astype(np.int64)] != order
        self.late = set(found[order][taken].tolist())
        self.late_hashes = np.array(sorted(self.late), U)
        self.pair_keys = np.full(1 << 20, -1, np.int64)
        self.pair_ok = np.zeros(1 << 20, bool)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, U)
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store, self.used = np.zeros(1 << 16, np.int32), 0

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Token ids by hash; -1 where there is none."""
        got = self.slots[(h >> U(44)).astype(np.int64)]
        out = np.where((got >= 0) & (self.token_hash[got] == h), got, -1)
        if len(self.late_hashes):
            at = np.searchsorted(self.late_hashes, h)
            hit = np.flatnonzero(self.late_hashes[np.minimum(at, len(self.late_hashes) - 1)] == h)
            if len(hit):
                out[hit] = self.hash_ids[np.searchsorted(self.hashes, h[hit])]
        return out

    def stable_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        slot = (mix(key.view(U)) >> U(44)).astype(np.int64)
        miss = np.flatnonzero(self.pair_keys[slot] != key)
        out = self.pair_ok[slot]
        if len(miss):
            new, inverse = np.unique(key[miss], return_inverse=True)
            ok = np.array([self.vocabulary.is_stable(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], bool)
            out[miss] = ok[inverse]
            where = (mix(new.view(U)) >> U(44)).astype(np.int64)
            self.pair_keys[where], self.pair_ok[where] = new, ok
            again = self.pair_keys[where] == new  # slots that two new keys share keep the later one
            self.pair_ok[where[again]] = ok[again]
        return out

    def encode_spans(self, data: np.ndarray, spans: Spans, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many byte spans, joined, and how many each has: the prefix table of all at once, a place at a time."""
        size = end - start
        counts = np.zeros(len(start), np.int64)
        whole = self.lookup(spans.hash(start, end))
        counts[whole >= 0] = 1
        rest = np.flatnonzero(whole < 0)
        rest = rest[np.argsort(-size[rest], kind="stable")]
        n_long = int((size[rest] > self.SHORT).sum())
        long, short = rest[:n_long], rest[n_long:]
        lists: dict[int, list[int]] = {int(i): PrefixEncoder(self.vocabulary, data[start[i] : end[i]].tobytes()).tokens() for i in long}
        width = int(size[short[0]]) if len(short) else 0
        last = np.full((len(short), width), -1, np.int64)
        s, length = start[short], size[short]
        for e in range(1, width + 1):
            left = np.arange(int(np.searchsorted(-length, -e, "right")))
            for k in range(1, min(e, self.vocabulary.longest) + 1):
                token = self.lookup(spans.hash(s[left] + (e - k), s[left] + e))
                good = token >= 0
                if k < e:
                    maybe = np.flatnonzero(good)
                    good[maybe] = self.stable_pairs(last[left[maybe], e - k - 1], token[maybe])
                last[left[good], e - 1] = token[good]
                left = left[~good]
                if not len(left):
                    break
            if len(left):
                raise ValueError("the ranks are not those of a byte-pair merge table")
        # Walk back from the ends.
        back, at, steps = np.full((len(short), width), -1, np.int64), length.copy(), 0
        while len(live := np.flatnonzero(at > 0)):
            token = last[live, at[live] - 1]
            back[live, steps] = token
            at[live] -= self.size_of[token]
            counts[short[live]] += 1
            steps += 1
        for i, ids in lists.items():
            counts[i] = len(ids)
        out = np.zeros(int(counts.sum()), np.int32)
        first = np.cumsum(counts) - counts
        one = np.flatnonzero(whole >= 0)
        out[first[one]] = whole[one]
        for step in range(steps):
            live = np.flatnonzero(back[:, step] >= 0)
            out[first[short[live]] + counts[short[live]] - 1 - step] = back[live, step]
        for i, ids in lists.items():
            out[first[i] : first[i] + len(ids)] = ids
        return out, counts

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.pattern == COMMON_PATTERN:
            return pattern_starts(data, offsets)
        out = []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            at = lo
            for m in self.find(data[lo:hi].tobytes().decode("utf-8", "replace")):
                out.append(at)
                at += len(m.group().encode())
            if at != hi:
                raise ValueError("the pattern must match every character")
        return np.array(out, np.int64)

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, joined, and the offsets of the rows in them."""
        start = self.starts(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        end = np.append(start[1:], len(data))
        spans = Spans(data)
        found, example, inverse = np.unique(spans.hash(start, end), return_index=True, return_inverse=True)
        if len(self.known) + len(found) > self.kept:
            self.forget()
        place = np.searchsorted(self.known, found)
        have = np.zeros(len(found), bool)
        if len(self.known):
            have = self.known[np.minimum(place, len(self.known) - 1)] == found
        if not have.all():
            new = np.flatnonzero(~have)
            ids, counts = self.encode_spans(data, spans, start[example[new]], end[example[new]])
            while self.used + len(ids) > len(self.store):
                self.store = np.concatenate([self.store, np.zeros_like(self.store)])
            self.store[self.used : self.used + len(ids)] = ids
            at = self.used + np.cumsum(counts) - counts
            self.used += len(ids)
            self.known = np.insert(self.known, place[new], found[new])
            self.at, self.count = np.insert(self.at, place[new], at), np.insert(self.count, place[new], counts)
            place = np.searchsorted(self.known, found)
        at, count = self.at[place][inverse], self.count[place][inverse]
        total = np.zeros(len(start) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        ids = self.store[np.repeat(at - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(start, offsets)]

    def encode(self, text: str | None) -> list[int]:
        data = np.frombuffer((text or "").encode("utf-8", "surrogateescape"), np.uint8)
        return self.encode_rows(data, np.array([0, len(data)]))[0].tolist()

    @staticmethod
    def spell(ids: np.ndarray, flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of a table for the given ids, joined, and the place at which each id's string begins."""
        n = size[ids]
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        return flat[np.repeat(at[ids] - total[:-1], n) + np.arange(total[-1])], total

    def decode_rows(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows, joined, and the offsets of the rows in them."""
        flat, total = self.spell(ids, self.token_bytes, self.token_at, self.size_of)
        return flat, total[offsets]

    def decode(self, ids) -> bytes:
        ids = np.asarray(list(ids), np.int64)
        return self.decode_rows(ids, np.array([0, len(ids)]))[0].tobytes()


@cache
def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One tokenizer for each worker process."""
    return ByteBPE(read_ranks(path), pattern)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for b in batches:
            data, off = text_bytes(b[1])
            for lo, hi in pieces(off):
                ids, at = t.encode_rows(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                rows = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b[0].slice(lo, hi - lo), rows], names=["id", "ids"])

    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return frame.mapInArrow(released(run), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(ids: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary) of each row's ids; null counts as no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                rows = pa.array((t.decode(x or ()) for x in part[1].to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([part[0], rows], names=["id", "bytes"])

    frame = ids.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return frame.mapInArrow(released(run), "id long, bytes binary").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, decode the ids and digest both, without sending the ids through the JVM.

    Returns (id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the decoded bytes).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for b in batches:
            data, off = text_bytes(b[1])
            for lo, hi in pieces(off):
                ids, at = t.encode_rows(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                back, back_at = t.decode_rows(ids, at)
                said, said_at = t.spell(ids, t.digits, t.digit_at, t.digit_size)
                n, said_at = np.diff(at), said_at[at]
                a = [sha256(said[x : max(x, y - 1)]).hexdigest() for x, y in zip(said_at[:-1].tolist(), said_at[1:].tolist(), strict=True)]
                d = [sha256(back[x:y]).hexdigest() for x, y in zip(back_at[:-1].tolist(), back_at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b[0].slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return frame.mapInArrow(released(run), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
