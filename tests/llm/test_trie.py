"""Operator 11 against a brute-force trie."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ratewright.llm import prefix_trie

COLUMNS = "conv_id long, turn long, role string, text string, depth long, f long, rep long, salt int, place long, key string"


def nodes_of(conversations):
    """{(conv_id, depth): the other columns} of {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    name = {p: (min(m), len(p)) for p, m in members.items()}
    out = {}
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in m if len(conversations[c]) == len(p))))
        children = sum(len(q) == len(p) + 1 for q in below)
        out[name[p]] = (name[p[:-1]][0] if p else None, len(m), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def collected(df):
    rows = df.collect()
    assert len({r[:2] for r in rows}) == len(rows)
    return {r[:2]: r[2:] for r in rows}


def frame(spark, conversations):
    rows = [(c, k, r, t, 1, 2, 3, 4, 5, "x") for c, turns in conversations.items() for k, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def some():
    rng = random.Random(3)
    found = {}
    for c in range(60):
        length = rng.choice([1, 2, 3, 5, 9]) if c else 40
        found[c] = [(rng.choice(["user", "assistant"]), rng.choice(["a", "b", ""]) * (k < 4) + "é" * (k >= 4)) for k in range(length)]
    for c in range(60, 75):
        found[c] = found[0][: c - 40]
    return found


def test_trie_equals_brute_force(spark, some):
    assert collected(prefix_trie.prefix_trie(frame(spark, some))) == nodes_of(some)


def test_colliding_fingerprints_are_split(spark, some):
    # Sums modulo 3 and 2 agree for most prefixes; verification has to part them.
    assert collected(prefix_trie.prefix_trie(frame(spark, some), primes=(5, 5))) == nodes_of(some)


def test_a_conversation_over_many_partitions(spark):
    found = {7: [("user", str(k % 50)) for k in range(3000)], 8: [("user", str(k % 50)) for k in range(2990)] + [("user", "end")], 2: [("user", "0")]}
    got = collected(prefix_trie.prefix_trie(frame(spark, found)))
    assert len(got) == 3002 and got[2, 0][:4] == (None, 3, 1, 2) and got[7, 3000][:4] == (7, 1, 0, 1) and got[8, 2991][0] == 7
    assert got[7, 2990][1:4] == (2, 2, 2)
    assert got[2, 0][4] == 2 + sum(len(str(k % 50)) for k in range(1, 2990))


def test_scanner_is_the_same_however_rows_are_batched():
    rng = np.random.default_rng(1)
    conv = np.sort(rng.integers(0, 6, 200))
    columns = [pa.array(conv), pa.array(["r"] * 200), pa.array(["t"] * 200), pa.array(rng.integers(0, 1 << 62, 200)), pa.array(rng.integers(0, 1 << 62, 200))]
    whole = pa.RecordBatch.from_arrays(columns, names=["conv_id", "role", "text", "h0", "h1"])
    scan = prefix_trie._scanner(0, prefix_trie.PRIMES)
    one = pa.Table.from_batches(scan([whole]))
    many = pa.Table.from_batches(scan([whole.slice(a, b - a) for a, b in [(0, 1), (1, 1), (1, 70), (70, 199), (199, 200)]]))
    assert one.equals(many.combine_chunks())
    p, b = prefix_trie.PRIMES[0], prefix_trie._bases(0, prefix_trie.PRIMES)[0]
    total, place = {}, {}
    for c, h, s, k in zip(conv.tolist(), columns[3].to_pylist(), one.column("s0").to_pylist(), one.column("place").to_pylist(), strict=True):
        place[c] = place.get(c, 0) + 1
        total[c] = (total.get(c, 0) + h * pow(b, place[c], p)) % p
        assert (s, k) == (total[c], place[c])


def rebuilt_of(conversations):
    out = {}
    for c, own in conversations.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = conversations.get(c - c % 5, [])[:h] + own[h:]
    return out


def test_rebuilt_conversations(spark, some):
    found = {c: t for c, t in some.items() if c % 5 or c > 20}
    turns, members = prefix_trie.rebuild(frame(spark, found))
    want = rebuilt_of(found)
    assert any(not t for t in want.values())
    got = defaultdict(list)
    for r in sorted(turns.collect()):
        got[r.conv_id].append((r.role, r.text))
        assert r.turn == len(got[r.conv_id])
    assert {r.conv_id for r in members.collect()} == set(want) and dict(got) == {c: t for c, t in want.items() if t}
    assert collected(prefix_trie.prefix_trie(turns, members)) == nodes_of(want)


def test_trie_edges(spark):
    rows = [(1, None, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (2, 0, "user", ""), (2, 5, "", "x"), (None, 1, "user", "lost"), (3, 2, "a", "y" * 200_000), (-4, 1, "user", "")]
    got = collected(prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert got == nodes_of({1: [("user", ""), ("", "x"), ("", "x")], 2: [("user", ""), ("", "x")], 3: [("a", "y" * 200_000)], -4: [("user", "")]})
    nothing = spark.createDataFrame([], COLUMNS)
    assert prefix_trie.prefix_trie(nothing).count() == 0 == prefix_trie.prefix_trie(*prefix_trie.rebuild(nothing)).count()
    alone = prefix_trie.prefix_trie(nothing, spark.createDataFrame([(5,), (3,), (3,)], "conv_id long"))
    assert collected(alone) == nodes_of({5: [], 3: []})


def test_ties_are_ordered_alike_however_rows_lie(spark):
    rows = [(c, 1, "user", f"t{k * 7 % 11}") for c in (1, 2) for k in range(11)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    a, b = (collected(prefix_trie.prefix_trie(df.orderBy(o).repartition(n))) for o, n in (("text", 1), ("conv_id", 5)))
    assert a == b and len(a) == 12
