"""The pipeline's near copies against all pairs."""

import random

import brute
import pytest
from conftest import PROSE, edge_rows
from pyspark.sql import functions as F

from ratewright.llm import neardup


def kept_ids(df):
    return sorted(r.doc_id for r in neardup.drop_near_copies(df).select("doc_id").collect())


def wanted(rows):
    groups = brute.near_copies(rows)
    return sorted(i for i, _ in rows if groups[i] == i)


def varied(seed, groups=12, copies=9):
    """Texts in groups: each copy has up to a tenth of its words changed, so that some are alike and some not."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(30, 400))]
        for k in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) * k // 80))):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows) + 1, " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = varied(seed)
    want = wanted(rows)
    assert kept_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == want
    assert 12 < len(want) < len(rows)


def test_chains_outside_the_centre_are_found(spark):
    """Texts under one key that are like each other but not like the text with most copies."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(100)]
    step = lambda k: words[: 100 - 5 * k] + [f"x{j}" for j in range(5 * k)]
    rows = [(k + 1, " ".join(step(k))) for k in range(8)] + [(50 + k, " ".join(words)) for k in range(5)]
    rng.shuffle(rows)
    assert kept_ids(spark.createDataFrame(rows, "doc_id long, text string")) == wanted(rows) == [1]


def test_edges(spark, edges, nothing):
    rows = [(i, t) for i, t, *_ in edge_rows()]
    out = neardup.drop_near_copies(edges)
    assert out.columns == edges.columns
    assert sorted(r.doc_id for r in out.collect()) == wanted(rows)
    assert neardup.drop_near_copies(nothing).count() == 0
    odd = spark.createDataFrame([(None, PROSE), (4, PROSE), (None, "something else entirely " * 9)], "doc_id long, text string")
    assert neardup.drop_near_copies(odd).count() == 3


def test_repeated_ids_stay_while_a_text_leads(spark):
    rows = [(1, PROSE), (2, PROSE + " too"), (2, "another text of its own " + " ".join(f"v{k}" for k in range(40))), (3, PROSE + " also")]
    out = neardup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("d")))
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 2]


def test_only_keys_are_dealt_by_key(spark, monkeypatch):
    """The bands of all texts are shuffled without their sketches; these join the few rows whose keys are shared."""
    plans, keep = [], neardup.Scratch.keep
    monkeypatch.setattr(neardup.Scratch, "keep", lambda self, df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(self, df, name))[1])
    rows = varied(3, 3, 4)
    assert kept_ids(spark.createDataFrame(rows, "doc_id long, text string")) == wanted(rows)
    dealt = [p for p in plans if "explode(keys" in p]
    assert dealt and not any("sig#" in p for p in dealt)
