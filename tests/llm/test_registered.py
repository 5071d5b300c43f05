"""The registered queries against their SQL, and the pipeline against the brute-force stages."""

from collections import Counter, defaultdict
from pathlib import Path

import brute
import corpus_pipeline
import duckdb
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ratewright.llm import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = queries.queries()[name](spark, DATA)
    names = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(names)} FROM ({oracle.ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want)


def test_all_are_registered():
    found = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in found) for k in range(1, 14)] == [1] * 13 and "pipeline" in found
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_pipeline_equals_brute_force(spark, tmp_path):
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    more = source.where("doc_id % 3 = 0").select((F.col("doc_id") + 5_000_000).alias("doc_id"), "text", "lang", "source", "n_chars")
    docs = source.union(more).select("*", F.lit("x").alias("row"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]

    # Lines of very long documents make the quadratic version slow; the stage before it is compared on all.
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    kept = [r[:2] for r, (_, _, ok) in zip(rows, brute.quality(rows), strict=True) if ok]
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality_rules"](spark, docs, str(tmp_path))
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == {i for i, _ in kept}

    cleaned = brute.line_dedup(kept)
    kept = [(i, t) for i, (t, n, gone) in cleaned.items() if not gone or gone < n]
    groups = brute.near_copies(kept)
    kept = [(i, t) for i, t in kept if groups[i] == i]
    leaked = {x[0] for x in brute.contained(kept, items)}
    want = {i: t for i, t in kept if i not in leaked}

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(want) and 0 < len(want) < len(rows)
    alone = stages["packing"](spark, spark.createDataFrame(list(want.items()), "doc_id long, text string"), str(tmp_path)).collect()
    assert Counter(r[:5] for r in out) == Counter(r[:5] for r in alone)
    held = defaultdict(int)
    for r in out:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 2048
