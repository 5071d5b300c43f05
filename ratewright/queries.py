"""Registered queries over the driver's tables, each with SQL that another engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import expr as X
from .operators import binning, encode, review, tables, training
from .sources.book import BOOK_SELECT, KEYS, book, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

QUANTITY = [10.0, 20.0, 30.0, 40.0]
DISCOUNT = [0.02, 0.05, 0.08]
TAX = [0.02, 0.04, 0.06]
STRENGTH = 20.0
B = f"WITH book AS ({BOOK_SELECT})"


def query(sql: str | None = None, with_book: bool = True):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"{B} {sql}" if with_book else sql
        return f

    return keep


def _bin_sql(column: str, borders: list[float]) -> str:
    over = " + ".join(f"CASE WHEN CAST({column} AS FLOAT) > CAST({b} AS FLOAT) THEN 1 ELSE 0 END" for b in borders)
    return f"CASE WHEN {column} IS NULL THEN 0 ELSE 1 + {over} END"


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


QB, DB, TB = _bin_sql("l_quantity", QUANTITY), _bin_sql("l_discount", DISCOUNT), _bin_sql("l_tax", TAX)


# --- binning -----------------------------------------------------------------------------------------------


@query(f"SELECT {', '.join(KEYS)}, {QB} AS qty_bin, {DB} AS disc_bin FROM book")
def bin_numeric(spark, d):
    return book(spark, d).select(*KEYS, X.bin_index(F.col("l_quantity"), QUANTITY).alias("qty_bin"), X.bin_index(F.col("l_discount"), DISCOUNT).alias("disc_bin"))


@query(
    "SELECT round(CASE WHEN m >= nxt THEN v ELSE m END, 4) AS border FROM (SELECT v, nxt, CAST((CAST(v AS DOUBLE) + CAST(nxt AS DOUBLE)) / 2 AS FLOAT) AS m FROM"
    " (SELECT v, lead(v) OVER (ORDER BY v) AS nxt FROM (SELECT DISTINCT CAST(l_quantity AS FLOAT) AS v FROM lineitem))) WHERE nxt IS NOT NULL",
    False,
)
def grid_midpoint(spark, d):
    return binning.midpoint_borders(read_table(spark, d, "lineitem"), "l_quantity").select(F.round("border", 4).alias("border"))


@query(
    ", v AS (SELECT CAST(price AS FLOAT) AS v, sum(weight) AS w FROM book GROUP BY 1), c AS (SELECT v, sum(w) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum FROM v),"
    " t AS (SELECT CAST(i AS DOUBLE) / 16 * (SELECT sum(w) FROM v) AS target FROM range(1, 16) r(i)) SELECT DISTINCT border FROM (SELECT target, min(v) AS border FROM c, t WHERE cum >= target GROUP BY target)"
)
def grid_weighted_quantile(spark, d):
    return binning.quantile_borders(book(spark, d), "price", "weight", 16)


# --- categorical encodings -----------------------------------------------------------------------------------

LEVEL = "coalesce(brand, '__missing__')"
BASE = "(SELECT sum(weight * claims) / sum(weight * exposure) FROM book)"
SUMS = f", s AS (SELECT {LEVEL} AS level, sum(weight * claims) AS wy, sum(weight * exposure) AS we FROM book GROUP BY 1)"


@query("SELECT round(sum(weight * claims) / sum(weight * exposure), 9) AS base FROM book")
def cat_base_rate(spark, d):
    return _round(encode.base_rate(book(spark, d), "claims", "weight", "exposure"), 9, "base")


RARE_SQL = ", s AS (SELECT CAST(l_partkey AS VARCHAR) AS member, sum(weight * claims) AS wy, sum(weight * exposure) AS we FROM book GROUP BY 1), p AS (SELECT member, CASE WHEN we < 40 THEN '<rare>' ELSE member END AS level, wy, we FROM s)"


@query(RARE_SQL + " SELECT level, member, round(sum(wy) OVER (PARTITION BY level), 6) AS wy, round(sum(we) OVER (PARTITION BY level), 6) AS we FROM p")
def cat_rare_pool(spark, d):
    return _round(encode.pool_rare(encode.level_sums(book(spark, d), "l_partkey", "claims", "weight", "exposure"), 40.0), 6, "wy", "we")


@query(f"{SUMS} SELECT level, level AS member, round((wy + 20 * {BASE}) / (we + 20), 9) AS encoding FROM s")
def cat_encode_fixed(spark, d):
    return _round(encode.fixed_encoding(book(spark, d), "brand", "claims", "weight", "exposure", STRENGTH), 9, "encoding")


@query(
    f", s AS (SELECT {LEVEL} AS level, fold, sum(weight * claims) AS wy, sum(weight * exposure) AS we FROM book GROUP BY 1, 2), f AS (SELECT fold, sum(wy) AS fy, sum(we) AS fe FROM s GROUP BY 1),"
    " b AS (SELECT fold, ((SELECT sum(fy) FROM f) - fy) / ((SELECT sum(fe) FROM f) - fe) AS base FROM f), o AS (SELECT level, fold, sum(wy) OVER (PARTITION BY level) - wy AS oy, sum(we) OVER (PARTITION BY level) - we AS oe FROM s)"
    " SELECT level, o.fold, round((oy + 20 * base) / (oe + 20), 9) AS encoding FROM o JOIN b ON o.fold = b.fold"
)
def cat_kfold_oof(spark, d):
    return _round(encode.kfold_encoding(book(spark, d), "brand", "claims", "weight", "exposure", "fold", STRENGTH), 9, "encoding")


@query(
    f"{SUMS}, t AS (SELECT sum(wy) AS ty, sum(we) AS te FROM s) SELECT {', '.join(KEYS)}, round((wy - weight * claims + 20 * (ty - weight * claims) / (te - weight * exposure)) / (we - weight * exposure + 20), 8) AS encoding"
    f" FROM book JOIN s ON {LEVEL} = level, t"
)
def cat_loo(spark, d):
    return _round(encode.leave_one_out(book(spark, d), "brand", "claims", "weight", "exposure", STRENGTH).select(*KEYS, "encoding"), 8, "encoding")


@query(
    f"SELECT {', '.join(KEYS)}, round((coalesce(sum(weight * claims) OVER w, 0) + 20 * CAST(1.5 AS DOUBLE)) / (coalesce(sum(weight * exposure) OVER w, 0) + 20), 8) AS encoding FROM book"
    f" WINDOW w AS (PARTITION BY {LEVEL} ORDER BY (l_orderkey * 31 + l_partkey * 17) % 1009, {', '.join(KEYS)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
)
def cat_ordered_prefix(spark, d):
    order = [(F.col("l_orderkey") * 31 + F.col("l_partkey") * 17) % 1009, *map(F.col, KEYS)]
    rows = book(spark, d).select(*KEYS, "brand", "claims", "weight", "exposure")
    return _round(encode.ordered_encoding(rows, "brand", "claims", "weight", "exposure", STRENGTH, 1.5, order).select(*KEYS, "encoding"), 8, "encoding")


@query(f"SELECT {LEVEL} AS level, round(ln(1 + sum(weight) / (SELECT sum(weight) FROM book) * (SELECT count(*) FROM book)), 8) AS channel FROM book GROUP BY 1")
def cat_count_channel(spark, d):
    return _round(encode.count_channel(book(spark, d), "brand", "weight"), 8, "channel")


@query(f"SELECT {LEVEL} AS level, " + ", ".join(f"round(sum(CASE WHEN l_returnflag = '{c}' THEN weight ELSE 0 END) / sum(weight), 9) AS p_{c}" for c in "ANR") + " FROM book GROUP BY 1")
def cat_class_freq(spark, d):
    return _round(encode.class_frequencies(book(spark, d), "brand", "l_returnflag", "weight", list("ANR")), 9, "p_A", "p_N", "p_R")


@query(
    f"{SUMS}, e AS (SELECT level, round((wy + 20 * {BASE}) / (we + 20), 9) AS e FROM s), r AS (SELECT level, dense_rank() OVER (ORDER BY e) - 1 AS rank FROM e), n AS (SELECT max(rank) + 1 AS n FROM r)"
    " SELECT level, CAST(1 + (rank * least(n, 8)) // n AS INT) AS bin FROM r, n"
)
def cat_fisher_bins(spark, d):
    return encode.rank_bins(encode.fixed_encoding(book(spark, d), "brand", "claims", "weight", "exposure", STRENGTH), 8)


@query(
    f", x AS (SELECT 'brand' AS feature, {LEVEL} AS value, weight FROM book UNION ALL SELECT 'p_type', p_type, weight FROM book),"
    f" k AS (SELECT DISTINCT 'brand' AS feature, {LEVEL} AS value FROM book WHERE l_partkey % 40 < 2 AND p_size < 5 UNION SELECT DISTINCT 'p_type', p_type FROM book WHERE p_type < 'M')"
    " SELECT feature, value, count(*) AS n, sum(weight) AS mass FROM x WHERE (feature, value) NOT IN (SELECT feature, value FROM k) GROUP BY 1, 2"
)
def unseen_values(spark, d):
    b = book(spark, d)
    some = b.where("l_partkey % 40 < 2 AND p_size < 5").select(F.lit("brand").alias("feature"), encode.level_of(F.col("brand")).alias("value")).distinct()
    known = some.union(b.where("p_type < 'M'").select(F.lit("p_type").alias("feature"), F.col("p_type").alias("value")).distinct())
    return encode.unseen_values(b, ["brand", "p_type"], known, "weight")


# --- losses --------------------------------------------------------------------------------------------------

_TARGETS = {"squared_error": "price", "logistic": "returned", "poisson": "claims", "gamma": "price", "tweedie": "claims"}
_MU = "exp(score)"
_GRADS = {
    "squared_error": ("score - price", "CAST(1 AS DOUBLE)"),
    "logistic": ("1 / (1 + exp(-score)) - returned", "1 / (1 + exp(-score)) * (1 - 1 / (1 + exp(-score)))"),
    "poisson": (f"{_MU} - claims", _MU),
    "gamma": (f"1 - price / {_MU}", f"price / {_MU}"),
    "tweedie": ("exp(0.5 * score) - claims * exp(-0.5 * score)", "0.5 * exp(0.5 * score) + 0.5 * claims * exp(-0.5 * score)"),
}


def _grad_query(loss: str) -> None:
    g, h = _GRADS[loss]

    def run(spark, d):
        a, b = X.grad_hess(loss, F.col(_TARGETS[loss]), F.col("score"))
        return _round(book(spark, d).select(*KEYS, a.alias("g"), b.cast("double").alias("h")), 6, "g", "h")

    run.__name__ = f"grad_hess_{'squared' if loss == 'squared_error' else loss}"
    query(f"SELECT {', '.join(KEYS)}, round({g}, 6) AS g, round({h}, 6) AS h FROM book")(run)


def _initial_query(loss: str) -> None:
    y = _TARGETS[loss]
    m = f"sum(weight * {y}) / sum(weight)"
    sql = {"squared_error": m, "logistic": f"ln(({m}) / (1 - {m}))"}.get(loss, f"ln({m})")

    def run(spark, d):
        mean = F.sum(F.col("weight") * F.col(y)) / F.sum("weight")
        return book(spark, d).agg(F.round(X.initial_score(loss, mean), 7).alias("f0"))

    run.__name__ = f"init_score_{'squared' if loss == 'squared_error' else loss}"
    query(f"SELECT round({sql}, 7) AS f0 FROM book")(run)


_DEVIANCES = {
    "squared_error": ("claims", "(claims - mu) * (claims - mu)"),
    "poisson": ("claims", "2 * (CASE WHEN claims > 0 THEN claims * ln(claims / mu) ELSE 0 END - (claims - mu))"),
    "gamma": ("price", "2 * (-ln(price / mu) + (price - mu) / mu)"),
    "tweedie": ("claims", "2 * (pow(claims, 0.5) / (-0.5 * 0.5) + claims * pow(mu, -0.5) / 0.5 + pow(mu, 0.5) / 0.5)"),
    "binomial": ("returned", "-2 * (CASE WHEN returned = 1 THEN ln(mu / 2) ELSE ln(1 - mu / 2) END)"),
}


def _deviance_query(loss: str) -> None:
    y, sql = _DEVIANCES[loss]

    def run(spark, d):
        b = book(spark, d)
        b = b.withColumn("mu", F.col("mu") / 2) if loss == "binomial" else b
        return _round(review.mean_deviance(b, loss, y, "mu", "weight"), 7, "deviance")

    run.__name__ = f"deviance_{'squared' if loss == 'squared_error' else loss}"
    query(f"SELECT round(sum(weight * {sql}) / sum(weight), 7) AS deviance FROM book")(run)


for _loss in _TARGETS:
    _grad_query(_loss)
    _initial_query(_loss)
for _loss in _DEVIANCES:
    _deviance_query(_loss)

_RAWS = ["score", "0.5 * score", "-score"]
_TOP = "greatest(score, 0.5 * score, -score)"
_Z = " + ".join(f"exp({r} - {_TOP})" for r in _RAWS)


@query(f"SELECT {', '.join(KEYS)}, " + ", ".join(f"round(exp({r} - {_TOP}) / ({_Z}), 8) AS p{k}" for k, r in enumerate(_RAWS)) + " FROM book")
def softmax_rows(spark, d):
    ps = X.softmax([F.col("score"), 0.5 * F.col("score"), -F.col("score")])
    return book(spark, d).select(*KEYS, *[F.round(p, 8).alias(f"p{k}") for k, p in enumerate(ps)])


@query(f"SELECT round(sum(-2 * weight * ln(CASE l_returnflag WHEN 'A' THEN exp(score - {_TOP}) WHEN 'N' THEN exp(0.5 * score - {_TOP}) ELSE exp(-score - {_TOP}) END / ({_Z}))) / sum(weight), 7) AS deviance FROM book")
def deviance_multinomial(spark, d):
    ps = X.softmax([F.col("score"), 0.5 * F.col("score"), -F.col("score")])
    rows = book(spark, d).select("l_returnflag", "weight", *[p.alias(f"p{k}") for k, p in enumerate(ps)])
    return _round(review.multinomial_deviance(rows, "l_returnflag", {"A": "p0", "N": "p1", "R": "p2"}, "weight"), 7, "deviance")


# --- training --------------------------------------------------------------------------------------------------

SPLITS = [("l_quantity", QUANTITY, 2, False), ("l_tax", TAX, 1, True)]
LEAF = f"(CASE WHEN {QB} = 0 THEN 0 WHEN {QB} <= 2 THEN 1 ELSE 0 END + CASE WHEN {TB} = 0 THEN 2 WHEN {TB} <= 1 THEN 2 ELSE 0 END)"


def _leaf():
    return X.leaf_index([(X.bin_index(F.col(c), b), k, m) for c, b, k, m in SPLITS])


def _bins():
    return {0: X.bin_index(F.col("l_quantity"), QUANTITY), 1: X.bin_index(F.col("l_discount"), DISCOUNT), 2: X.bin_index(F.col("l_tax"), TAX)}


def _histogram(spark, d):
    g, h = X.grad_hess("poisson", F.col("claims"), F.col("score"))
    return training.gradient_histogram(book(spark, d), _leaf(), _bins(), g, h, F.col("weight"))


HIST = (
    f", r AS (SELECT {LEAF} AS leaf, {QB} AS b0, {DB} AS b1, {TB} AS b2, weight * (exp(score) - claims) AS g, weight * exp(score) AS h, weight AS w FROM book),"
    " u AS (SELECT leaf, 0 AS axis, b0 AS bin, g, h, w FROM r UNION ALL SELECT leaf, 1, b1, g, h, w FROM r UNION ALL SELECT leaf, 2, b2, g, h, w FROM r),"
    " hist AS (SELECT CAST(leaf AS INT) AS leaf, CAST(axis AS INT) AS axis, CAST(bin AS INT) AS bin, sum(g) AS g, sum(h) AS h, count(*) AS n, sum(w) AS w FROM u GROUP BY 1, 2, 3)"
)


@query(f"SELECT {', '.join(KEYS)}, CAST({LEAF} AS INT) AS leaf FROM book")
def leaf_index(spark, d):
    return book(spark, d).select(*KEYS, _leaf().cast("int").alias("leaf"))


@query(HIST + " SELECT leaf, axis, bin, round(g, 5) AS g, round(h, 5) AS h, n, w FROM hist")
def histogram_leaf_axis_bin(spark, d):
    return _round(_histogram(spark, d), 5, "g", "h")


GAINS = (
    HIST
    + ", c AS (SELECT leaf, axis, bin, sum(CASE WHEN bin > 0 THEN g ELSE 0 END) OVER (PARTITION BY leaf, axis ORDER BY bin ROWS UNBOUNDED PRECEDING) AS gl, sum(CASE WHEN bin > 0 THEN h ELSE 0 END) OVER (PARTITION BY leaf, axis ORDER BY bin ROWS UNBOUNDED PRECEDING) AS hl,"
    " sum(g) OVER (PARTITION BY leaf, axis) AS gt, sum(h) OVER (PARTITION BY leaf, axis) AS ht FROM hist),"
    " gains AS (SELECT axis, bin AS bin_le, sum(gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) AS gain FROM c WHERE bin > 0 GROUP BY 1, 2)"
)


@query(GAINS + " SELECT axis, bin_le, round(gain, 5) AS gain FROM gains")
def split_gains(spark, d):
    return _round(training.split_gains(_histogram(spark, d), 1.0), 5, "gain")


@query(GAINS + " SELECT axis, bin_le, round(gain, 5) AS gain FROM gains ORDER BY round(gain, 9) DESC, axis, bin_le LIMIT 1")
def best_split_level1(spark, d):
    return _round(training.best_split(training.split_gains(_histogram(spark, d), 1.0)), 5, "gain")


@query(f"SELECT CAST({LEAF} AS INT) AS leaf, round(-0.1 * sum(weight * (exp(score) - claims)) / (sum(weight * exp(score)) + 1), 8) AS value, count(*) AS n FROM book GROUP BY 1")
def leaf_values(spark, d):
    g, h = X.grad_hess("poisson", F.col("claims"), F.col("score"))
    return _round(training.leaf_values(book(spark, d), _leaf(), g, h, F.col("weight"), 1.0, 0.1), 8, "value")


_BAGS = "(SELECT *, i AS bag, (l_orderkey * 3 + l_partkey + i * 7) % 3 <> 0 AS in_bag, score + CAST((l_partkey + i * 13) % 7 AS DOUBLE) / 10 AS bag_score FROM book, range(0, 4) t(i))"


def _bags(spark, d):
    i = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")
    rows = book(spark, d).select("*", i)
    return rows.withColumns({"in_bag": (F.col("l_orderkey") * 3 + F.col("l_partkey") + F.col("i") * 7) % 3 != 0, "bag_score": F.col("score") + ((F.col("l_partkey") + F.col("i") * 13) % 7).cast("double") / 10})


@query(f"SELECT {', '.join(KEYS)}, round(avg(CASE WHEN NOT in_bag THEN bag_score END), 8) + CAST(0 AS DOUBLE) AS jury, count(CASE WHEN NOT in_bag THEN 1 END) AS bags FROM {_BAGS} GROUP BY {', '.join(KEYS)}")
def oob_jury_mean(spark, d):
    means = _round(training.jury_mean(_bags(spark, d), KEYS, "bag_score", "in_bag"), 8, "jury")
    return means.withColumn("jury", F.col("jury") + 0.0)  # no negative zero


@query(f"SELECT round(sum(v * h) / sum(h), 8) AS sigma2 FROM (SELECT var_samp(bag_score) AS v, max(mu) AS h FROM {_BAGS} GROUP BY {', '.join(KEYS)})")
def bag_score_variance(spark, d):
    return _round(training.bag_variance(_bags(spark, d), KEYS, "bag_score", "mu"), 8, "sigma2")


# --- tables ----------------------------------------------------------------------------------------------------

ONE_WAY = [0.0, -0.2, -0.1, 0.05, 0.1, 0.3]
TWO_WAY = [round(0.01 * ((7 * i) % 23) - 0.1, 2) for i in range(6 * 5)]
CORNERS = [0.0, 0.25, -0.5, 1.0]


def _array_sql(values: list[float], at: str) -> str:
    return f"([{', '.join(f'CAST({v} AS DOUBLE)' for v in values)}])[1 + {at}]"


T1, T2 = _array_sql(ONE_WAY, f"({QB})"), _array_sql(TWO_WAY, f"({QB}) * 5 + ({DB})")
T3 = _array_sql(CORNERS, "CASE WHEN l_tax <= 0.03 THEN 1 ELSE 0 END + CASE WHEN p_size <= 25 THEN 2 ELSE 0 END")


def _tables():
    q, disc = X.bin_index(F.col("l_quantity"), QUANTITY), X.bin_index(F.col("l_discount"), DISCOUNT)
    return {
        ("qty",): tables.lookup(ONE_WAY, [6], [q]),
        ("qty", "disc"): tables.lookup(TWO_WAY, [6, 5], [q, disc]),
        ("tax", "size"): tables.box_value(CORNERS, [F.col("l_tax") <= 0.03, F.col("p_size") <= 25]),
    }


@query(f"SELECT {', '.join(KEYS)}, round(exp(0.1 + {T1} + {T2} + {T3}), 8) AS rate FROM book")
def table_score_fixed(spark, d):
    raw = sum(_tables().values(), F.lit(0.1))
    return book(spark, d).select(*KEYS, F.round(X.inverse_link("log", raw), 8).alias("rate"))


@query(f"SELECT {', '.join(KEYS)}, {T3} AS box FROM book")
def box_score_fixed(spark, d):
    return book(spark, d).select(*KEYS, _tables()["tax", "size"].alias("box"))


@query(f"SELECT {', '.join(KEYS)}, 'qty' AS effect, {T1} AS contribution FROM book UNION ALL SELECT {', '.join(KEYS)}, 'qty:disc', {T2} FROM book UNION ALL SELECT {', '.join(KEYS)}, 'tax:size', {T3} FROM book")
def table_contributions_long(spark, d):
    return tables.contributions(book(spark, d), KEYS, {":".join(k): v for k, v in _tables().items()})


@query(f"SELECT {', '.join(KEYS)}, round({T1} + {T2} / 2, 8) AS qty, round({T2} / 2, 8) AS disc, round({T3} / 2, 8) AS tax, round({T3} / 2, 8) AS size FROM book")
def shapley_equal_split(spark, d):
    parts = tables.equal_split(_tables())
    return book(spark, d).select(*KEYS, *[F.round(parts[k], 8).alias(k) for k in ("qty", "disc", "tax", "size")])


CELLS = f", x AS (SELECT {QB} AS c0, {DB} AS c1, {TB} AS c2, weight * exposure AS mass, claims, weight, mu FROM book)"


def _cells(spark, d):
    b = book(spark, d)
    return b.select(*[x.cast("int").alias(f"c{a}") for a, x in _bins().items()], (F.col("weight") * F.col("exposure")).alias("mass"), "claims", "weight", "mu", "score", "fold")


@query(CELLS + " SELECT coalesce(x.c0, -1) AS c0, coalesce(x.c1, -1) AS c1, coalesce(x.c2, -1) AS c2, grouping(x.c0, x.c1, x.c2) AS set_id, round(sum(mass), 6) AS support, count(*) AS n FROM x GROUP BY GROUPING SETS ((x.c0), (x.c1), (x.c2), (x.c0, x.c1), (x.c1, x.c2))")
def support_grouping_sets(spark, d):
    found = tables.supports(_cells(spark, d), [["c0"], ["c1"], ["c2"], ["c0", "c1"], ["c1", "c2"]], "mass")
    return _round(found.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("c0", "c1", "c2")}), 6, "support")


PURE = (
    CELLS
    + ", wa AS (SELECT c0, sum(mass) AS wa FROM x GROUP BY 1), wb AS (SELECT c1, sum(mass) AS wb FROM x GROUP BY 1), v AS (SELECT c0, c1, sum(claims * weight) / sum(weight) AS value FROM x GROUP BY 1, 2),"
    " j AS (SELECT v.c0, v.c1, value, wa, wb FROM v JOIN wa ON v.c0 = wa.c0 JOIN wb ON v.c1 = wb.c1),"
    " p AS (SELECT c0, c1, value, wa, wb, sum(wb * value) OVER (PARTITION BY c0) / sum(wb) OVER (PARTITION BY c0) AS r, sum(wa * value) OVER (PARTITION BY c1) / sum(wa) OVER (PARTITION BY c1) AS c, sum(wa * wb * value) OVER () / sum(wa * wb) OVER () AS f0 FROM j)"
)


def _pair(spark, d):
    x = _cells(spark, d)
    wa = x.groupBy("c0").agg(F.sum("mass").alias("wa"))
    wb = x.groupBy("c1").agg(F.sum("mass").alias("wb"))
    v = x.groupBy("c0", "c1").agg((F.sum(F.col("claims") * F.col("weight")) / F.sum("weight")).alias("value"))
    return v.join(wa, "c0").join(wb, "c1")


@query(PURE + " SELECT c0 AS a, c1 AS b, round(f0, 8) AS f0, round(r - f0, 8) AS main_a, round(c - f0, 8) AS main_b, round(value - r - c + f0, 8) AS pure FROM p")
def purify_pair_table(spark, d):
    cells = _pair(spark, d).select(F.col("c0").alias("a"), F.col("c1").alias("b"), "value", "wa", "wb")
    placed = tables.purify_pair(cells, "a", "b", "value", F.col("wa"), F.col("wb"))
    return _round(placed, 8, "f0", "main_a", "main_b", "pure")


@query(
    PURE
    + ", t AS (SELECT 'a' AS table_id, wa * wb AS w, r - f0 AS v FROM p UNION ALL SELECT 'b', wa * wb, c - f0 FROM p UNION ALL SELECT 'a:b', wa * wb, value - r - c + f0 FROM p), s AS (SELECT table_id, sum(w * v * v) / sum(w) AS variance FROM t GROUP BY 1)"
    " SELECT table_id, round(variance, 9) AS variance, round(variance / (SELECT sum(variance) FROM s), 6) AS share FROM s"
)
def table_variance_sobol(spark, d):
    cells = _pair(spark, d).select(F.col("c0").alias("a"), F.col("c1").alias("b"), "value", "wa", "wb")
    parts = tables.purify_pair(cells, "a", "b", "value", F.col("wa"), F.col("wb")).join(cells.select("a", "b", (F.col("wa") * F.col("wb")).alias("weight")), ["a", "b"])
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("table_id"), F.col(c).alias("value")) for k, c in (("a", "main_a"), ("b", "main_b"), ("a:b", "pure"))]))
    return _round(_round(tables.variance_shares(parts.select("weight", named.alias("t")).select("weight", "t.*")), 9, "variance"), 6, "share")


@query("SELECT round(ln(sum(weight * claims) / sum(weight * mu)), 9) AS shift FROM book")
def reanchor_log(spark, d):
    return _round(tables.reanchor_log(book(spark, d), "claims", "mu", "weight"), 9, "shift")


# --- review ----------------------------------------------------------------------------------------------------

AE = "count(*) AS n, sum(weight) AS weight, round(sum(weight * claims), 4) AS actual, round(sum(weight * mu), 4) AS expected, round(sum(weight * claims) / sum(weight * mu), 6) AS ae"


def _ae(df: DataFrame) -> DataFrame:
    return _round(_round(df, 6, "ae"), 4, "actual", "expected")


@query(f"{CELLS} SELECT c0 AS cell, {AE} FROM x GROUP BY 1")
def ae_by_cell(spark, d):
    return _ae(review.actual_expected(_cells(spark, d).withColumnRenamed("c0", "cell"), ["cell"], "claims", "mu", "weight"))


@query(f"{CELLS} SELECT c0, c2, {AE} FROM x GROUP BY 1, 2")
def ae_by_pair_band(spark, d):
    return _ae(review.actual_expected(_cells(spark, d), ["c0", "c2"], "claims", "mu", "weight"))


LORENZ = (
    ", g AS (SELECT mu AS s, sum(weight) AS w, sum(weight * claims) AS wy FROM book GROUP BY 1), t AS (SELECT sum(w) AS tw, sum(wy) AS ty FROM g),"
    " lz AS (SELECT s, w / tw AS dw, wy / ty AS dy, sum(w) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) / tw AS cw, sum(wy) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) / ty AS cy FROM g, t)"
)


@query(LORENZ + " SELECT round(s, 6) AS s, round(cw, 8) AS cw, round(cy, 8) AS cy FROM lz")
def lorenz_points(spark, d):
    return _round(_round(review.lorenz_points(book(spark, d), F.col("mu"), "claims", "weight").select("s", "cw", "cy"), 6, "s"), 8, "cw", "cy")


@query(LORENZ + " SELECT round(1 - sum(dw * (2 * cy - dy)), 7) AS gini FROM lz")
def concentration_gini(spark, d):
    return _round(review.gini(book(spark, d), F.col("mu"), "claims", "weight"), 7, "gini")


PERFECT = LORENZ.replace("mu AS s", "claims AS s").replace(" g AS", " gp AS").replace(" t AS", " tp AS").replace(" lz AS", " lzp AS").replace("FROM g, t", "FROM gp, tp").replace("FROM g)", "FROM gp)")


@query(LORENZ + PERFECT + " SELECT round((1 - (SELECT sum(dw * (2 * cy - dy)) FROM lz)) / (1 - (SELECT sum(dw * (2 * cy - dy)) FROM lzp)), 6) AS gini")
def ordered_gini(spark, d):
    return _round(review.ordered_gini(book(spark, d), F.col("mu"), "claims", "weight"), 6, "gini")


LIFT = (
    f", o AS (SELECT *, row_number() OVER (ORDER BY mu DESC, {', '.join(KEYS)}) - 1 AS place, count(*) OVER () AS every FROM book), b AS (SELECT i, (i * every) // 10 AS low, ((i + 1) * every) // 10 AS high FROM range(0, 10) r(i), (SELECT count(*) AS every FROM book)),"
    " lift AS (SELECT CAST(i + 1 AS INT) AS bucket, count(*) AS rows, sum(weight * claims) / sum(weight) AS mean_y, sum(weight * mu) / sum(weight) AS mean_pred FROM o JOIN b ON place >= low AND place < high GROUP BY i),"
    " lifts AS (SELECT bucket, rows, round(mean_y, 7) AS mean_y, round(mean_pred, 7) AS mean_pred, round(mean_y / (SELECT sum(weight * claims) / sum(weight) FROM book), 7) AS lift FROM lift)"
)


@query(LIFT + " SELECT * FROM lifts")
def lift_curve(spark, d):
    return _round(review.lift_curve(book(spark, d), "mu", KEYS, 10, "claims", "mu", "weight"), 7, "mean_y", "mean_pred", "lift")


@query(LIFT + " SELECT lift FROM lifts WHERE bucket = 1")
def top_bucket_lift(spark, d):
    return _round(review.top_bucket_lift(book(spark, d), "mu", KEYS, 10, "claims", "mu", "weight"), 7, "lift")


@query(
    LORENZ.replace("sum(weight * claims) AS wy FROM", "sum(weight * claims) AS wy, count(*) AS n FROM").replace("SELECT s, w / tw", "SELECT s, n, w / tw")
    + " SELECT CAST(least(10, 1 + floor((cw - dw / 2) * 10 + 0.000000001)) AS INT) AS band, CAST(sum(n) AS BIGINT) AS rows, round(sum(dw) * max(tw), 4) AS weight, round(sum(dy) * max(ty) / (sum(dw) * max(tw)), 7) AS actual, round(sum(dw * s) / sum(dw), 7) AS predicted FROM lz, t GROUP BY 1"
)
def lift_equal_mass(spark, d):
    return _round(_round(review.lift_equal_mass(book(spark, d), F.col("mu"), 10, "claims", "weight"), 4, "weight"), 7, "actual", "predicted")


@query(
    f", v AS (SELECT {QB} AS cell, price AS v, sum(weight) AS w FROM book GROUP BY 1, 2), c AS (SELECT cell, v, w, sum(w) OVER (PARTITION BY cell ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY cell) AS total FROM v)"
    " SELECT cell, round(sum(w * v) / sum(w), 4) AS mean, min(CASE WHEN cum >= 0.1 * total THEN v END) AS q_1, min(CASE WHEN cum >= 0.5 * total THEN v END) AS q_2, min(CASE WHEN cum >= 0.9 * total THEN v END) AS q_3 FROM c GROUP BY 1"
)
def cell_weighted_quantiles(spark, d):
    b = book(spark, d).withColumn("cell", X.bin_index(F.col("l_quantity"), QUANTITY))
    return _round(review.cell_quantiles(b, "cell", "price", "weight", [0.1, 0.5, 0.9]), 4, "mean")


def _psi_sql(where: str) -> str:
    return f"(SELECT c0, sum(weight) / (SELECT sum(weight) FROM x WHERE {where}) AS m FROM x WHERE {where} GROUP BY 1)"


@query(
    CELLS.replace("mu FROM book", "mu, fold FROM book")
    + f", j AS (SELECT greatest(coalesce(p.m, 0), 0.0001) AS p, greatest(coalesce(q.m, 0), 0.0001) AS q FROM {_psi_sql('fold < 3')} p FULL JOIN {_psi_sql('fold >= 3')} q ON p.c0 = q.c0) SELECT round(sum((q - p) * ln(q / p)), 9) AS psi FROM j"
)
def psi(spark, d):
    x = _cells(spark, d)
    return _round(review.stability_index(x.where("fold < 3"), x.where("fold >= 3"), "c0", "weight"), 9, "psi")


@query("SELECT round(sum(weight * claims) / sum(weight * exposure), 8) AS rate, round(ln(sum(weight * claims) / sum(weight * exposure)), 8) AS score FROM book")
def null_model_log(spark, d):
    return _round(review.null_rate(book(spark, d), "claims", "weight", "exposure"), 8, "rate", "score")


@query("SELECT round(sum(weight * (claims - mu) * (claims - mu) / mu) / sum(weight), 7) AS dispersion FROM book")
def dispersion(spark, d):
    return _round(review.dispersion(book(spark, d), "poisson", "claims", "mu", "weight"), 7, "dispersion")


@query("SELECT l_returnflag AS actual, CASE WHEN score < -0.3 THEN 'A' WHEN score < 0.3 THEN 'N' ELSE 'R' END AS predicted, count(*) AS n, sum(weight) AS weight FROM book GROUP BY 1, 2")
def confusion_matrix(spark, d):
    said = F.when(F.col("score") < -0.3, "A").when(F.col("score") < 0.3, "N").otherwise("R")
    return review.confusion(book(spark, d).select(F.col("l_returnflag").alias("actual"), said.alias("predicted"), "weight"), "actual", "predicted", "weight")


@query(
    ", e AS (SELECT quantile_cont(mu, 0.005) AS lo, quantile_cont(mu, 0.995) AS hi FROM book), v AS (SELECT weight, CASE WHEN lo > 0 AND hi / lo > 3 THEN (ln(greatest(mu, lo)) - ln(lo)) / (ln(hi) - ln(lo)) ELSE (mu - lo) / (hi - lo) END AS spot FROM book, e)"
    " SELECT CAST(greatest(0, least(19, floor(spot * 20))) AS INT) AS bin, count(*) AS n, sum(weight) AS weight FROM v GROUP BY 1"
)
def pred_histogram(spark, d):
    b = book(spark, d)
    return review.histogram(b, "mu", review.histogram_edges(b, "mu"), 20, "weight")


@query(f"SELECT {', '.join(KEYS)}, {LEVEL} AS level, CAST(row_number() OVER (PARTITION BY {LEVEL} ORDER BY mu DESC, {', '.join(KEYS)}) AS INT) AS place FROM book QUALIFY row_number() OVER (PARTITION BY {LEVEL} ORDER BY mu DESC, {', '.join(KEYS)}) <= 3")
def top_rows_by_level(spark, d):
    over = Window.partitionBy("level").orderBy(F.desc("mu"), *KEYS)
    b = book(spark, d).withColumn("level", encode.level_of(F.col("brand")))
    return b.withColumn("place", F.row_number().over(over)).where("place <= 3").select(*KEYS, "level", "place")


from . import ensemble_queries, refit_queries, report_queries  # noqa: E402, F401  register the rest of the queries
