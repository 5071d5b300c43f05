"""Rating tables as DataFrames: support, centring, variance, contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def supports(df: DataFrame, groups: list[list[str]], mass: str) -> DataFrame:
    """All supports in one pass: GROUPING SETS over the groups of cell columns; cells of others are null."""
    columns = sorted({c for g in groups for c in g})
    return df.groupingSets([[F.col(c) for c in g] for g in groups], *[F.col(c) for c in columns]).agg(
        F.grouping_id(*[F.col(c) for c in columns]).alias("set_id"), F.sum(F.col(mass).cast("double")).alias("support"), F.count("*").alias("n")
    )


def purify_pair(cells: DataFrame, a: str, b: str, value: str, weight_a: Column, weight_b: Column) -> DataFrame:
    """A full two-way table parted into constant, two main effects and a pure interaction.

    ``cells`` has a row for each combination; weights are the reference shares of the cells of each axis (they
    need not sum to one).  The main effects have weighted mean zero, and so has each row and column of the rest.
    """
    wa, wb = weight_a, weight_b
    rows, columns, whole = Window.partitionBy(a), Window.partitionBy(b), Window.partitionBy()
    mean = lambda w, over: F.sum(w * F.col(value)).over(over) / F.sum(w).over(over)
    placed = cells.select(a, b, value, mean(wb, rows).alias("_r"), mean(wa, columns).alias("_c"), mean(wa * wb, whole).alias("f0"))
    return placed.select(a, b, "f0", (F.col("_r") - F.col("f0")).alias("main_a"), (F.col("_c") - F.col("f0")).alias("main_b"), (F.col(value) - F.col("_r") - F.col("_c") + F.col("f0")).alias("pure"))


def variance_shares(tables: DataFrame) -> DataFrame:
    """table_id, variance and share of the total; ``tables`` has table_id, value, weight (centred values)."""
    v = tables.groupBy("table_id").agg((F.sum(F.col("weight") * F.col("value") * F.col("value")) / F.sum("weight")).alias("variance"))
    total = v.agg(F.sum("variance").alias("total"))
    return v.join(F.broadcast(total)).select("table_id", "variance", F.try_divide("variance", "total").alias("share"))


def lookup(values: list[float], shape: list[int], cells: list[Column]) -> Column:
    """The value of a table's cell: row-major position in an array literal."""
    at: Column = F.lit(0)
    for size, cell in zip(shape, cells, strict=True):
        at = at * size + cell
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), at + 1)


def box_value(corners: list[float], sides: list[Column]) -> Column:
    """A rank-one effect: the corner that the low (0) or high (1) sides select."""
    at = sum((F.when(s, F.lit(1 << d)).otherwise(F.lit(0)) for d, s in enumerate(sides)), F.lit(0))
    return F.element_at(F.array(*[F.lit(float(v)) for v in corners]), at + 1)


def contributions(df: DataFrame, keys: list[str], tables: dict[str, Column]) -> DataFrame:
    """keys, effect, contribution: one row for each row and table."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("effect"), v.cast("double").alias("contribution")) for k, v in tables.items()]))
    return df.select(*keys, pairs.alias("p")).select(*keys, "p.effect", "p.contribution")


def equal_split(tables: dict[tuple[str, ...], Column]) -> dict[str, Column]:
    """Shapley values of a sum of tables: each table's value split equally over its features."""
    out: dict[str, Column] = {}
    for features, value in tables.items():
        for f in features:
            part = value / len(features)
            out[f] = out[f] + part if f in out else part
    return out


def reanchor_log(df: DataFrame, y: str, mu: str, weight: str) -> DataFrame:
    """shift: what to add to a log-link intercept so that expected equals actual."""
    w = F.col(weight).cast("double")
    return df.agg(F.ln(F.sum(w * F.col(y)) / F.sum(w * F.col(mu))).alias("shift"))


def ranked_contributions(df: DataFrame, keys: list[str], tables: dict[str, Column]) -> DataFrame:
    """keys, effect, contribution, rank: 1 for the largest by absolute size within the row, ties by name.  No shuffle."""
    pairs = F.array(*[F.struct((-F.abs(v.cast("double"))).alias("size"), F.lit(k).alias("effect"), v.cast("double").alias("contribution")) for k, v in tables.items()])
    return df.select(*keys, F.posexplode(F.sort_array(pairs)).alias("at", "p")).select(*keys, "p.effect", "p.contribution", (F.col("at") + 1).alias("rank"))


def joint_variance(df: DataFrame, tables: dict[str, Column], mass: Column) -> DataFrame:
    """table_id, variance: weighted variance over the rows of each table's value, and of their sum (table_id ``*``).

    Values are centred on their means first, in a second pass over the rows.
    """
    named = {**tables, "*": sum(tables.values(), F.lit(0.0))}
    rows = df.select(mass.cast("double").alias("m"), *[v.cast("double").alias(f"v{k}") for k, v in enumerate(named.values())]).where("m > 0")
    means = rows.agg(*[(F.sum(F.col("m") * F.col(f"v{k}")) / F.sum("m")).alias(f"a{k}") for k in range(len(named))])  # one row
    spread = [(F.sum(F.col("m") * F.pow(F.col(f"v{k}") - F.col(f"a{k}"), 2)) / F.sum("m")).alias(f"s{k}") for k in range(len(named))]
    found = rows.join(F.broadcast(means)).agg(*spread)
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("table_id"), F.col(f"s{k}").alias("variance")) for k, name in enumerate(named)]))
    return found.select(pairs.alias("p")).select("p.*")


def feature_importances(variances: DataFrame, sep: str = ":") -> DataFrame:
    """feature, importance: each table's share of the summed variance, split equally over the features in its name."""
    own = variances.where("table_id <> '*'")
    total = own.agg(F.sum("variance").alias("total"))  # one row
    parts = F.split("table_id", sep)
    shares = own.join(F.broadcast(total)).select(F.explode(parts).alias("feature"), (F.try_divide("variance", "total") / F.size(parts)).alias("share"))
    return shares.groupBy("feature").agg(F.sum("share").alias("importance"))
