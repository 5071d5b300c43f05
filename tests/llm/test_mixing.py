"""Operator 12 against exact water-filling."""

from collections import defaultdict
from fractions import Fraction

import pytest
from conftest import edge_rows

from ratewright.llm import mixing


def filled(sizes, weights, total, epochs):
    """Exact targets: clamp, share the rest by weight, until none is above."""
    free, left, out = set(sizes), Fraction(total), {}
    while free:
        share = left / sum(weights[s] for s in free)
        above = [s for s in free if epochs * sizes[s] < weights[s] * share]
        if not above:
            return out | {s: weights[s] * share for s in free}
        for s in above:
            out[s] = Fraction(epochs * sizes[s])
            left -= out[s]
            free.remove(s)
    return out


def held(df, rows):
    """Checks the result of a mix of ``rows`` (doc_id, text, lang, source) by weights 1, 2, 3; the words taken by source."""
    got = df.collect()
    words = [(i, s, len((t or "").split())) for i, t, _, s in rows]
    sizes = defaultdict(int)
    for _, s, n in words:
        sizes[s] += n
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weights = {s: k % 3 + 1 for k, s in enumerate(order)}
    want = filled(sizes, weights, sum(sizes.values()), 3)
    source = {i: s for i, s, _ in words}
    assert sorted((r.doc_id, r.size, r.source_size) for r in got) == sorted((i, n, sizes[s]) for i, s, n in words)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.target == pytest.approx(float(want[s])) and 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        whole = int(want[s] / sizes[s]) if sizes[s] else 0
        assert r.size == 0 or r.taken // r.size in (whole, whole + 1)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(2 * abs(taken[s] - want[s]) <= largest[s] + 0.001 for s in sizes)
    return dict(taken)


def test_mix_of_documents(documents):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in documents.collect()]
    rows = [(i, " ".join((t or "").replace("\x0b", " ").split()), a, s) for i, t, a, s in rows]
    held(mixing.mix(documents, [1.0, 2.0, 3.0]), rows)


@pytest.mark.parametrize("leaf", [1, 3, 1024])
def test_cells_are_divided_alike(spark, monkeypatch, leaf):
    monkeypatch.setattr(mixing, "LEAF_ROWS", leaf)
    rows = [(k, "word " * (k * 37 % 19), "en", "big" if k % 3 else f"s{k % 7}") for k in range(900)] + [(k, "a b c", "en", None) for k in range(900, 940)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    one = mixing.mix(df.repartition(5), [1.0, 2.0, 3.0])
    held(one, rows)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, mixing.mix(df.coalesce(1), [1.0, 2.0, 3.0]).collect()))


def test_equal_rows_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 4)
    df = spark.createDataFrame([(1, "a b", "x")] * 200 + [(2, "c d e", "y")] * 100 + [(3, "f", "z")], "doc_id long, text string, source string")
    got = mixing.mix(df.repartition(3), [1.0, 2.0, 3.0]).groupBy("source_size", "target").sum("taken").collect()
    assert len(got) == 3 and all(abs(r[1] - r[2]) <= 1.5 for r in got)
    again = mixing.mix(df, [1.0, 2.0, 3.0])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixing.mix(df.repartition(7), [1.0, 2.0, 3.0]).collect()))


def test_water_filling_rounds(spark):
    sizes = {f"s{k}": 1 << k for k in range(20)}
    weights = {s: 1 + k % 2 for k, s in enumerate(sizes)}
    df = spark.createDataFrame([(s, float(weights[s]), n) for s, n in sizes.items()], "source string, weight double, source_size long")
    total = sum(sizes.values())
    got = {r.source: r.target for r in mixing.water_fill(df, float(total), 3.0).collect()}
    assert got == pytest.approx({s: float(t) for s, t in filled(sizes, weights, total, 3).items()})
    spread = {r.source: r.target for r in mixing.water_fill(df, 10.0 * total, 3.0).collect()}
    assert spread == {s: 3.0 * n for s, n in sizes.items()}  # more than all epochs: all are clamped


def test_weights_as_a_table(spark):
    df = spark.createDataFrame([(k, "w " * 10, "ab"[k % 2]) for k in range(40)] + [(99, "w w", "c")], "doc_id long, text string, source string")
    got = mixing.mix(df, spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double"))
    assert {(r.source_size, r.target) for r in got.select("source_size", "target").distinct().collect()} == {(200, 301.5), (200, 100.5), (2, 0.0)}


def test_mix_edges(spark, edges, nothing):
    got = mixing.mix(edges, [1.0, 2.0, 3.0])
    held(got, edge_rows())
    assert mixing.mix(nothing, [1.0, 2.0]).count() == 0
    blank = spark.createDataFrame([(1, None, None), (None, "  ", "a")], "doc_id long, text string, source string")
    assert sorted((r.size, r.source_size, r.target, r.taken) for r in mixing.mix(blank, [1.0]).collect()) == [(0, 0, 0.0, 0)] * 2
