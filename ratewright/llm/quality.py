"""Operator 4, quality rules: thresholds from mergeable quantile sketches per language and source.

Built-in SQL functions only.  Each measure is scaled to an integer bucket; the sketch of a group is the
count of each bucket.  Such sketches merge by addition in any order, so partial sums are combined before
the shuffle, and a quantile read from one is exact to a bucket.  Groups with few documents use the merged
sketch of their language, languages with few that of all.  The thresholds are joined to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, small_side
from .textstats import measures

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A group's own sketch counts from this many documents on.
MIN_GROUP = 50
#: Quartile distances allowed beyond the quartiles.
REACH = 3
#: For each measure: numerator, factor, denominator, and the buckets allowed beyond the fence (a group whose
#: quartiles coincide still tolerates this much).
RULES = {
    "word_length": ("word_chars", 100, "n_words", 60),
    "symbols": ("n_symbols", 1000, "n_words", 100),
    "dup_lines": ("n_dup_lines", 1000, "n_lines", 350),
    "repeats": ("n_repeat_words", 1000, "n_words", 250),
}


def base_failed(m: Column) -> Column:
    """The fixed rules: too few words, or too many of them in repeated windows."""
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def buckets(m: Column) -> Column:
    """The integer bucket of each measure; zero where there is nothing to divide by."""

    def one(num: str, factor: int, den: str) -> Column:
        return F.when(m[den] == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", m[num] * factor, F.greatest(m[den], F.lit(1))))

    return F.struct(*[one(num, f, den).alias(name) for name, (num, f, den, _) in RULES.items()])


def sketches(measured: DataFrame) -> DataFrame:
    """Bucket counts: lang, source, name, bucket, n.  ``measured`` has lang, source and b (buckets)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), F.col("b")[k].alias("bucket")) for k in RULES])
    flat = measured.select("lang", "source", F.explode(pairs).alias("p")).select("lang", "source", "p.name", "p.bucket")
    return flat.groupBy("lang", "source", "name", "bucket").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, by: list[str]) -> DataFrame:
    """lo and hi for each measure, and the number of documents, of the sketches merged over ``by``."""
    merged = sketch.groupBy(*by, "name", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*by, "name")
    upto = whole.orderBy("bucket")
    placed = merged.select("*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("total"))
    quartiles = placed.groupBy(*by, "name").agg(
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bucket"))).alias("q3"),
        F.max("total").alias("total"),
    )
    slack = F.coalesce(*[F.when(F.col("name") == k, F.lit(r[3])) for k, r in RULES.items()])
    margin = REACH * (F.col("q3") - F.col("q1")) + slack
    fence = F.struct((F.col("q1") - margin).alias("lo"), (F.col("q3") + margin).alias("hi"))
    one = lambda k: F.max(F.when(F.col("name") == k, fence)).alias(k)
    return quartiles.withColumn("margin", margin).groupBy(*by).agg(F.max("total").alias("docs"), *[one(k) for k in RULES])


def fences(sketch: DataFrame) -> DataFrame:
    """One row for each language and source: the fences that hold for it."""
    own = thresholds(sketch, ["lang", "source"])
    lang = thresholds(sketch, ["lang"]).select("lang", F.struct("docs", *RULES).alias("by_lang"))
    every = thresholds(sketch.withColumn("all", F.lit(1)), ["all"]).select(F.struct(*RULES).alias("by_all"))
    joined = own.join(lang, "lang").join(F.broadcast(every))  # `every` is one row
    pick = lambda k: F.when(F.col("docs") >= MIN_GROUP, F.col(k)).when(F.col("by_lang")["docs"] >= MIN_GROUP, F.col("by_lang")[k]).otherwise(F.col("by_all")[k]).alias(k)
    return joined.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), F.struct(*[pick(k) for k in RULES]).alias("fence"))


def _group(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def _verdict() -> Column:
    inside = [(F.col("b")[k] >= F.col("fence")[k]["lo"]) & (F.col("b")[k] <= F.col("fence")[k]["hi"]) for k in RULES]
    ok = inside[0]
    for x in inside[1:]:
        ok = ok & x
    return ~F.col("failed") & F.coalesce(ok, F.lit(False))


def _joined(measured: DataFrame, table: DataFrame) -> DataFrame:
    return measured.join(small_side(table), (F.col("lang") == F.col("f_lang")) & (F.col("source") == F.col("f_source")), "left")


def quality_table(docs: DataFrame) -> DataFrame:
    """Measures and verdict of each document.

    ``docs`` has doc_id, text, lang and source.  Returns doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed and kept.  A null text has no words and fails; a null language
    or source counts as the empty one; repeated rows are judged alike and each counts in the sketches; an
    empty table gives an empty result; other columns are ignored.
    """
    m = docs.select("doc_id", _group("lang"), _group("source"), F.explode(F.array(measures(F.col("text")))).alias("m"))
    m = m.select("doc_id", "lang", "source", "m", base_failed(F.col("m")).alias("failed"))
    measured = materialize(m, "quality").withColumn("b", buckets(F.col("m")))
    table = materialize(fences(sketches(measured.where(~F.col("failed")))), "fences")
    return _joined(measured, table).select(
        "doc_id",
        *[F.col("m")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("failed").alias("base_failed"),
        _verdict().alias("kept"),
    )


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names.

    Texts are measured once for the sketches and once for the filter; only the measures are shuffled, and
    where the fences are too many to broadcast, the documents are joined by language and source.
    """
    # A generator of one row: through it, the measures are taken once, however often they are used.
    rows = docs.select(F.struct("*").alias("row"), _group("lang"), _group("source"), F.explode(F.array(measures(F.col("text")))).alias("m"))
    rows = rows.select("*", base_failed(F.col("m")).alias("failed"), buckets(F.col("m")).alias("b"))
    passed = rows.where(~F.col("failed"))
    table = materialize(fences(sketches(passed.select("lang", "source", "b"))), "fences")
    return _joined(passed, table).where(_verdict()).select("row.*")
