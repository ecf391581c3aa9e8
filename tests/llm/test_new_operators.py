"""SimHash near-duplicates, the audit of filters, and the trie of conversations, against brute force and SQL."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from codeloom.llm import filter_audit, prefix_trie, simhash
from codeloom.llm.queries import OP12_SQL, OP13_SQL

DOCS = "doc_id long, text string, lang string, fp string, id string"  # the last two: names that operators use inside
LABELS = "doc_id long, quality int, toxic int, good int"
TURNS = "conv_id long, turn long, role string, text string, k string, depth int"


def values(df):
    return collections.Counter(map(tuple, df.collect()))


def sql(query, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas().astype(object).where(lambda x: x.notna(), None).pipe(lambda x: x.astype({c: "Int64" for c, t in df.dtypes if t in ("bigint", "int")})))
    found = con.execute(query)
    names = [c[0] for c in found.description]
    return names, collections.Counter(found.fetchall())


# SimHash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    fps = {i: slow_fingerprint(t) for i, t in rows}
    least, todo = {}, set(fps)
    for start in sorted(fps):
        front = [start] if start in todo else []
        todo -= set(front)
        while front:
            i = front.pop()
            least[i] = start
            near = {j for j in todo if (fps[i] ^ fps[j]).bit_count() <= 4}
            todo -= near
            front += near
    return {(i, f"{fps[i]:016x}", least[i]) for i in fps}


def near_texts(n, seed=3):
    r, vocab = random.Random(seed), [f"W{i}é" for i in range(900)]
    out, base = [], [r.choice(vocab) for _ in range(400)]
    for k in range(n):
        if k % 3 == 0:
            base = [r.choice(vocab) for _ in range(r.choice([3, 5, 60, 400]))]
        words = list(base)
        if k % 3 and len(words) > 50:
            words[r.randrange(len(words))] = r.choice(vocab)
        out.append(r.choice([" ", "\t\n ", " \x0b"]).join(words))
    return out


def test_simhash_against_brute_force(spark):
    texts = [*near_texts(150), None, "", " \n", "one", "One", "a b c d", "a b c d", "x y", "  nbsp word", "a " * 3000]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], DOCS)
    got = values(simhash.simhash_components(df))
    assert set(got) == slow_components(rows) and set(got.values()) == {1}
    assert len({g[2] for g in got}) < len(rows) - 30  # there is something to link


@pytest.mark.parametrize("distance", [2, 3, 4, 7])
def test_simhash_links_lead_as_far_as_all_pairs(spark, distance):
    """Random fingerprints, a dense family, and chains; small blocks, so that segments are dealt out in pairs of blocks."""
    r = random.Random(distance)
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    base = r.getrandbits(64)
    found = {flip(base, r.randrange(0, 6)) for _ in range(300)} | {r.getrandbits(64) for _ in range(200)}
    x = r.getrandbits(64)
    for _ in range(40):
        found.add(x := flip(x, distance))
    fps = np.array(sorted(found), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= distance
    for how in ({}, {"block": 20}, {"block": 20, "broadcast_rows": 0}):
        links = [(a % 2**64, b % 2**64) for a, b in simhash.similar_links(df, distance, **how).collect()]
        assert all((a ^ b).bit_count() <= distance for a, b in links)

        def reached(pairs):
            up = {int(v): int(v) for v in fps}

            def top(v):
                while up[v] != v:
                    up[v] = v = up[up[v]]
                return v

            for a, b in pairs:
                a, b = top(a), top(b)
                up[max(a, b)] = min(a, b)
            return [top(int(v)) for v in fps]

        assert reached(links) == reached([(int(fps[i]), int(fps[j])) for i, j in zip(*np.nonzero(near))])


def test_simhash_small_groups_give_each_pair_once(spark):
    r = random.Random(5)
    base = r.getrandbits(64)
    fps = {base} | {base ^ (1 << b) for b in (0, 5, 25, 50, 63)}
    df = spark.createDataFrame([(x - (x >> 63 << 64),) for x in fps], "fp long")
    got = values(simhash.similar_links(df))
    assert len(got) == 15 and set(got.values()) == {1}  # all differ by one or two bits


def test_simhash_awkward_rows(spark):
    got = values(simhash.simhash_components(spark.createDataFrame([(None, "a b c d e", *"xyz"), (4, "a b c d e", *"xyz"), (4, "A b C d E", *"xyz"), (None, None, *"xyz"), (None, "", *"xyz")], DOCS)))
    fp = f"{slow_fingerprint('a b c d e'):016x}"
    assert got == {(None, fp, 4): 1, (4, fp, 4): 2, (None, "0" * 16, None): 2}
    none = simhash.simhash_components(spark.createDataFrame([], DOCS))
    assert none.count() == 0 and none.columns == ["doc_id", "fingerprint", "component_id"]


def test_simhash_long_text(spark):
    text = " ".join(f"w{i % 70000}" for i in range(3_000_000))
    assert len(text) > 19e6
    assert simhash.fingerprint(text.encode(), piece=1 << 12) == simhash.fingerprint(text.encode())
    short = " ".join(text.split()[:2000])
    assert simhash.fingerprint(short.encode(), piece=100) == slow_fingerprint(short)
    assert simhash.simhash_components(spark.createDataFrame([(1, text, *"abc"), (2, text + " end", *"abc"), (3, "other words", *"abc")], DOCS)).where("component_id = 1").count() == 2


# Filters


def slow_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = collections.defaultdict(list)
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        first = min((j for j, t, _ in docs if (t or "") == text and j is not None), default=None)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": first is not None and (i is None or i > first),
        }
        parts[lang or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        total = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, x in enumerate(order):
                there = [r for r in rows if not any(r[0][y] for y in order[:k])]
                removed = [r for r in there if r[0][x]]
                total[x] += len(removed)
                counts = [len(there) - len(removed), len(removed), sum(r[0][x] for r in rows) - len(removed), sum(r[0][x] and sum(r[0].values()) == 1 for r in rows)]
                out[part, order, k + 1] = [*counts, sum(r[1] for r in removed), sum(r[2] for r in removed)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return {(*k, *v) for k, v in out.items()}


def audit_rows():
    r = random.Random(8)
    long = [" ".join(r.choice(["alpha", "beta", f"w{i}"]) if r.random() < p else f"x{r.random()}" for i in range(130)) for p in (0.1, 0.5, 0.9)]
    texts = [*long, long[0] + " #", long[1].upper(), "SHORT", "short", "", None, " \n", "é" * 10, "ÉA", "a|b", long[2] + "$ ABC" * 40]
    docs = [(i, r.choice(texts), r.choice(["en", "de", None, "", "fr"])) for i in range(120)]
    docs += [(3, docs[3][1], "en"), (3, docs[3][1], "de"), (None, long[0], "en"), (None, "only here", None), (None, "only here", "xx"), (500, "QQ", "xx")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 130, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, labels


def test_audit_against_brute_force_and_sql(spark):
    docs, labels = audit_rows()
    d = spark.createDataFrame([(*x, "f", "i") for x in docs], DOCS)
    q = spark.createDataFrame([(*x, 7) for x in labels], LABELS)
    out = filter_audit.filter_interactions(d, q)
    got = values(out)
    assert set(got.values()) == {1} and set(got) == slow_audit(docs, labels) and len(got) == 600 * 5
    names, want = sql(OP12_SQL, documents=d, labels=q)
    assert names == out.columns and got == want


def test_audit_empty_tables_and_long_texts(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.filter_interactions(none, labels).count() == 0
    text = " ".join(f"w{i}" for i in range(2_500_000))
    assert len(text) > 19e6
    out = filter_audit.filter_interactions(spark.createDataFrame([(1, text, "en", "", ""), (2, text, "en", "", "")], DOCS), labels)
    rows = out.where("step = 1").select("filter_order", "removed").collect()
    assert {(r[0][0], r[1]) for r in rows} == {("A", 0), ("B", 0), ("C", 0), ("D", 0), ("E", 1)}


@pytest.mark.parametrize("n", [1, 255, 256, 65535, 65536, 2**40, 2**62])
def test_audit_fields_do_not_overflow(n):
    """All documents in one field: its neighbours stay what they are."""
    o = filter_audit.Outcomes("ABCDE")
    width = filter_audit.field_bytes(n)
    assert 256**width > n
    want = sum(k * o.flags(mask, 1, 0).astype(object) for mask, k in ((0, n // 2), (31, n - n // 2)))
    total = sum(k * o.packed(mask, 1, 0, width) for mask, k in ((0, n // 2), (31, n - n // 2)))
    assert (o.unpacked(total, width) == want).all()
    assert o.flags(0, 0, 0).size == 600 * len(filter_audit.OUTCOMES)


# Conversations


def slow_trie(rows):
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append(((turn is not None, turn or 0), role, text[:32], hashlib.sha256(f"{len(role.encode())} {role}{text}".encode()).digest(), text))
    turns = {c: [(x[1], x[4]) for x in sorted(t)] for c, t in by.items()}
    seqs = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return collections.Counter(out)


def conversations(n=60, seed=1):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), 10**12 + 3, 10**12]:
        for t in range(r.choice([1, 2, 5, 9, 12])):
            rows.append((c, None if r.random() < 0.1 else t, r.choice(["user", "assistant", None]), r.choice(["a", "é" * 50, "", None, f"text {c % 4}"])))
    return rows


def test_trie_against_brute_force_and_sql(spark):
    rows = conversations()
    rows += [(2, 1, "user", "tie"), (2, 1, "user", "tie"), (2, 1, "assistant", "tie"), (None, 0, "user", "nobody"), (13, None, None, None)]
    df = spark.createDataFrame([(*x, "k", 5) for x in rows], TURNS)
    out = prefix_trie.trie(prefix_trie.rebuilt(df))
    got = values(out)
    assert got == slow_trie(rows)
    names, want = sql(OP13_SQL, conversations=df)
    assert names == out.columns and got == want


def test_trie_of_long_and_equal_conversations(spark, monkeypatch):
    """Chunks of 7 places and lists in pieces: one conversation has a third of all rows, and many are the same."""
    monkeypatch.setattr(prefix_trie.running, "__defaults__", (False, 7))
    rows = [(100, t, "user", f"turn {t % 3}") for t in range(150)] + [(c, t, "user", "same") for c in range(1000, 1100) for t in range(2)]
    rows += [(c, t, "assistant", "end") for c in range(1000, 1100, 7) for t in range(2, 12)]
    df = spark.createDataFrame([(*x, "k", 5) for x in rows], TURNS)
    assert values(prefix_trie.trie(prefix_trie.rebuilt(df))) == slow_trie(rows)


def test_trie_turnless_and_empty(spark):
    none = prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame([], TURNS)))
    assert none.count() == 0 and none.columns[0] == "conv_id"
    alone = next(c for c in range(1, 50) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)  # its base is absent
    rows = [(alone, 0, "user", "x"), (alone, 1, "user", "y")]
    got = values(prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame([(*x, "", 0) for x in rows], TURNS))))
    assert got == {(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest()): 1}


def test_trie_long_texts(spark):
    rows = [(5, 0, "user", "ä" * 10_000_000), (6, 0, "user", "ä" * 10_000_000), (6, 1, "user", "z")]
    df = spark.createDataFrame([(*x, "", 0) for x in rows], TURNS)
    assert values(prefix_trie.trie(prefix_trie.rebuilt(df))) == slow_trie(rows)


def test_lists_of_ids_in_pieces(spark):
    ids = spark.range(0, 20000, 2).selectExpr("1 AS depth", "7L AS a", "8L AS b", "id AS conv").repartition(5)
    more = spark.range(1, 30).selectExpr("2 AS depth", "7L AS a", "8L AS b", "-id AS conv")
    got = {r[0]: r[3] for r in prefix_trie.list_digests(ids.unionByName(more)).collect()}
    digest = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    assert got == {1: digest(range(0, 20000, 2)), 2: digest(range(-29, 0))}


# 20 MB texts for native operators


def test_long_texts_of_native_operators(spark):
    """A conversation's turn of 20 MB, and a document of 20 MB that holds a benchmark item at its end."""
    from pyspark.sql import functions as F

    from codeloom.llm import chat_format, decontaminate

    text = "<|end|> [x] \\l " * 1_400_000
    rows = spark.createDataFrame([(1, 0, "user", text, "", 0), (1, 1, "assistant", text + "z", "", 0)], TURNS)
    read = chat_format.read_back(chat_format.render(chat_format.fold_events(chat_format.plain_events(rows), regenerates=False)))
    got = read.select(F.sha2(F.col("turns")[0]["text"], 256), F.sha2(F.array_join("learned", ""), 256)).head()
    assert tuple(got) == tuple(hashlib.sha256(t.encode()).hexdigest() for t in (text, text + "z"))
    item = " ".join(f"item{i}" for i in range(30))
    long = " ".join(f"w{i % 90000}" for i in range(3_300_000)) + " " + item
    assert len(long) > 20e6
    docs = spark.createDataFrame([(1, long, "", "", ""), (2, "short", "", "", "")], DOCS)
    bench = spark.createDataFrame([(7, item), (8, "nothing of it is here at all in any of the documents above")], "item_id long, text string")
    for rows in (1_000_000, 0):
        assert [tuple(x) for x in decontaminate.overlaps(docs, bench, broadcast_rows=rows).collect()] == [(1, 7, 13, 13)]
