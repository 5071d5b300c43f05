"""Registered queries on bags of models, votes, multiclass training, recalibration and the review rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .functions import expr as X
from .operators import encode, ensemble, report, review, rules, select
from .queries import _BAGS, DB, KEYS, LEAF, LEVEL, QB, QUANTITY, T1, T2, T3, TB, _bags, _bin_sql, _bins, _leaf, _round, _tables, query
from .sources.book import book

ID = ", ".join(KEYS)
POISSON = "2 * weight * (CASE WHEN claims > 0 THEN claims * ln(claims / {0}) ELSE 0 END - (claims - {0}))"


# --- bags ----------------------------------------------------------------------------------------------------

PARTS = ["s0", "s1", "s2", "s3"]
_GROWN = "(1 + CAST(i AS DOUBLE) / 10)"
JURY = f", j AS (SELECT {ID}, claims, weight, count(*) AS jury, sum(CAST(-0.1 AS DOUBLE) + CAST(i AS DOUBLE) / 20) AS s0, sum({T1} * {_GROWN}) AS s1, sum({T2} * {_GROWN}) AS s2, sum({T3} * {_GROWN}) AS s3 FROM {_BAGS} WHERE NOT in_bag GROUP BY {ID}, claims, weight)"
PREFIXES = JURY + ", d AS (" + " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS prefix, sum({POISSON.format('m')}) / sum(weight) AS deviance FROM (SELECT *, exp(({' + '.join(PARTS[: k + 1])}) / jury) AS m FROM j)" for k in range(4)) + ")"


def _juries(spark, d):
    grown = 1 + F.col("i") / 10
    parts = {"s0": -0.1 + F.col("i") / 20, **{f"s{k}": t * grown for k, t in enumerate(_tables().values(), 1)}}
    return ensemble.jury_sums(_bags(spark, d).withColumns(parts), [*KEYS, "claims", "weight"], "in_bag", PARTS)


@query(JURY + f" SELECT {ID}, jury, round(s0, 8) AS s0, round(s1, 8) AS s1, round(s2, 8) AS s2, round(s3, 8) AS s3 FROM j")
def oob_group_sums(spark, d):
    return _round(_juries(spark, d).drop("claims", "weight"), 8, *PARTS)


@query(PREFIXES + " SELECT prefix, round(deviance, 7) AS deviance FROM d")
def ranked_path_deviance(spark, d):
    return _round(ensemble.prefix_deviances(_juries(spark, d), PARTS, "poisson", "claims", "weight"), 7, "deviance")


@query(
    PREFIXES + ", e AS (SELECT min(deviance) AS least, max(CASE WHEN prefix = 0 THEN deviance END) AS start FROM d)"
    " SELECT CAST(greatest(min(CASE WHEN start - deviance >= CAST(0.995 AS DOUBLE) * (start - least) THEN prefix END), min(CASE WHEN deviance <= CAST(1.001 AS DOUBLE) * least THEN prefix END)) AS INT) AS prefix FROM d, e"
)
def ranked_path_choice(spark, d):
    rows = ensemble.prefix_deviances(_juries(spark, d), PARTS, "poisson", "claims", "weight").orderBy("prefix").collect()
    return spark.createDataFrame([(select.chosen_prefix([r["deviance"] for r in rows], 0.995, 0.001),)], "prefix int")


NAMES = ["qty", "qty:disc", "tax:size"]
DROPS = f", r AS (SELECT fold, claims, weight, {T1} AS p0, {T2} AS p1, {T3} AS p2 FROM book), g AS (" + " UNION ALL ".join(
    f"SELECT fold, '{n}' AS table_id, sum({POISSON.format('b')}) / sum(weight) - sum({POISSON.format('a')}) / sum(weight) AS gain FROM (SELECT *, exp(0.1 + p0 + p1 + p2) AS a, exp(0.1 + p0 + p1 + p2 - p{k}) AS b FROM r) GROUP BY 1" for k, n in enumerate(NAMES)
) + ")"


def _drops(spark, d):
    return ensemble.drop_gains(book(spark, d), "fold", F.lit(0.1), dict(zip(NAMES, _tables().values(), strict=True)), "poisson", "claims", "weight")


@query(DROPS + " SELECT fold, table_id, round(gain, 7) AS gain FROM g")
def fold_drop_gains(spark, d):
    return _round(_drops(spark, d), 7, "gain")


@query(
    DROPS + ", v AS (SELECT table_id, count(*) AS n, avg(gain) AS m, stddev_samp(gain) / sqrt(count(*)) AS se, avg(CASE WHEN gain > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS pos FROM g GROUP BY 1)"
    " SELECT table_id, n, round(m, 7) AS mean_gain, round(se, 7) AS se, pos AS positive_rate, m > 0 AND pos >= 0.5 AS legacy_keep, m >= -2 * se AS evidence_keep FROM v"
)
def fold_vote_evidence(spark, d):
    votes = ensemble.fold_votes(_drops(spark, d).withColumn("kept", F.col("gain") > 0), 5)
    return _round(votes, 7, "mean_gain", "se")


BANK_BORDERS = [("qty", 0, "l_quantity", [5, 20]), ("qty", 1, "l_quantity", [10, 30]), ("qty", 2, "l_quantity", [20, 40]), ("size", 0, "p_size", [10, 25]), ("size", 1, "p_size", [25, 40])]


def _upper_sql(column: str, borders: list[int]) -> str:
    return "CASE " + " ".join(f"WHEN {column} <= {b} THEN CAST({b} AS DOUBLE)" for b in borders) + " END"


BANKS = ", k AS (" + " UNION ALL ".join(f"SELECT {bag} AS bag, '{t}' AS table_id, {_upper_sql(c, b)} AS upper, avg(claims - mu) AS value FROM {_BAGS} WHERE in_bag AND i = {bag} GROUP BY 3" for t, bag, c, b in BANK_BORDERS) + ")"


@query(
    BANKS + ", c AS (SELECT DISTINCT table_id, upper AS border FROM k), f AS (SELECT c.table_id, c.border, k.bag, arg_min(value, coalesce(upper, 1e9)) AS value FROM c JOIN k ON c.table_id = k.table_id AND coalesce(upper, 1e9) >= coalesce(border, 1e9) GROUP BY 1, 2, 3)"
    " SELECT table_id, border AS upper, round(sum(value) / 3, 8) AS value FROM f GROUP BY 1, 2"
)
def average_banks(spark, d):
    bags = _bags(spark, d).where("in_bag")

    def bank(table, bag, column, borders):
        upper = F.coalesce(*[F.when(F.col(column) <= b, F.lit(float(b))) for b in borders])
        return bags.where(F.col("i") == bag).groupBy(upper.alias("upper")).agg(F.avg(F.col("claims") - F.col("mu")).alias("value")).select(F.lit(bag).alias("bag"), F.lit(table).alias("table_id"), "upper", "value")

    return _round(ensemble.average_banks(reduce(lambda a, b: a.union(b), [bank(*x) for x in BANK_BORDERS])), 8, "value")


# --- training ------------------------------------------------------------------------------------------------


@query(
    ", v AS (SELECT abs(claims - mu) AS g, count(*) AS n FROM book WHERE abs(claims - mu) > 0 GROUP BY 1), c AS (SELECT g, sum(n) OVER o - n AS bn, sum(g * n) OVER o - g * n AS bs, (SELECT sum(g * n) FROM v) AS ts FROM v WINDOW o AS (ORDER BY g DESC ROWS UNBOUNDED PRECEDING)),"
    " t AS (SELECT g, bn, (ts - bs) / (wanted - bn) AS threshold FROM c, (SELECT CAST(0.6 AS DOUBLE) * count(*) AS wanted FROM book) WHERE wanted > bn)"
    " SELECT round(threshold, 6) AS threshold, CAST(bn AS BIGINT) AS sure FROM t WHERE threshold >= g ORDER BY g DESC LIMIT 1"
)
def mvs_threshold(spark, d):
    return _round(ensemble.sampling_threshold(book(spark, d), F.col("claims") - F.col("mu"), 0.6), 6, "threshold")


_TOP = "greatest(score, 0.5 * score, -score)"
_E = {"A": f"exp(score - {_TOP})", "N": f"exp(0.5 * score - {_TOP})", "R": f"exp(-score - {_TOP})"}
_SUM = " + ".join(_E.values())
CLASSES = (
    f", r AS (SELECT {LEAF} AS leaf, {QB} AS b0, {DB} AS b1, {TB} AS b2, weight AS w, l_returnflag AS label, score FROM book), k AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS class, leaf, b0, b1, b2, w, {e} / ({_SUM}) AS p, CASE WHEN label = '{k}' THEN 1 ELSE 0 END AS hit FROM r" for k, e in _E.items())
    + "), u AS ("
    + " UNION ALL ".join(f"SELECT class, CAST(leaf AS INT) AS leaf, CAST({a} AS INT) AS axis, CAST(b{a} AS INT) AS bin, w * (p - hit) AS g, w * p * (1 - p) AS h FROM k" for a in range(3))
    + ")"
)


def _class_histogram(spark, d, bins):
    ps = dict(zip(_E, X.softmax([F.col("score"), 0.5 * F.col("score"), -F.col("score")]), strict=True))
    return ensemble.class_histogram(book(spark, d), _leaf(), bins, "l_returnflag", ps, "weight")


@query(CLASSES + " SELECT class, leaf, axis, bin, round(sum(g), 4) + CAST(0 AS DOUBLE) AS g, round(sum(h), 4) AS h, count(*) AS n FROM u GROUP BY 1, 2, 3, 4")
def histogram_softmax(spark, d):
    return _round(_class_histogram(spark, d, _bins()), 4, "g", "h").withColumn("g", F.col("g") + 0.0)


@query(CLASSES + " SELECT class, leaf, round(-sum(g) / (sum(h) + 1), 7) + CAST(0 AS DOUBLE) AS value FROM u WHERE axis = 0 GROUP BY 1, 2")
def leaf_values_softmax(spark, d):
    sums = _class_histogram(spark, d, {0: _bins()[0]}).groupBy("class", "leaf").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    return _round(sums.select("class", "leaf", X.newton_step(F.col("g"), F.col("h"), 1.0).alias("value")), 7, "value").withColumn("value", F.col("value") + 0.0)


def _slope_sql(steps: int) -> str:
    sql = ", u AS MATERIALIZED (SELECT score AS r, sum(weight) AS w, sum(weight * claims) AS wy FROM book GROUP BY 1), c0 AS MATERIALIZED (SELECT CAST(0 AS DOUBLE) AS a, CAST(1 AS DOUBLE) AS b)"
    for k in range(steps):
        m = "w * exp(a + b * r)"
        sql += f", s{k} AS MATERIALIZED (SELECT a, b, sum({m} - wy) + a AS g0, sum(({m} - wy) * r) + b - 1 AS g1, sum({m}) + 1 AS h0, sum({m} * r) AS h1, sum({m} * r * r) + 1 AS h2 FROM u, c{k} GROUP BY 1, 2)"
        sql += f", c{k + 1} AS MATERIALIZED (SELECT a - (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, b - (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM s{k})"
    return sql + f" SELECT round(a, 6) AS intercept, round(b, 6) AS slope, round(2 * sum(wy * (a + b * r - r) + w * (exp(r) - exp(a + b * r))), 2) AS gain FROM u, c{steps} GROUP BY a, b"


@query(_slope_sql(6))
def reanchor_slope(spark, d):
    found = ensemble.slope_recalibration(book(spark, d), "claims", F.col("score"), "weight")
    return _round(_round(spark.createDataFrame([found], "intercept double, slope double, gain double"), 6, "intercept", "slope"), 2, "gain")


@query(f"SELECT 'qty' AS table_id, CAST({QB} AS INT) AS cell, round(-sum(weight * (exp(score) - claims)) / (sum(weight * exp(score)) + 10), 8) AS delta FROM book WHERE fold < 4 GROUP BY 2")
def rebalance_cells(spark, d):
    g, h = X.grad_hess("poisson", F.col("claims"), F.col("score"))
    rows = book(spark, d).where("fold < 4")  # the rest is the slice on which the step is judged
    return _round(ensemble.cell_corrections(rows, {"qty": X.bin_index(F.col("l_quantity"), QUANTITY)}, g, h, "weight", 10.0), 8, "delta")


# --- review rules --------------------------------------------------------------------------------------------


def _off(value: str, limit: float) -> str:
    return f"abs({value} - 1) > {limit}"


@query(f", s AS (SELECT CASE WHEN fold < 3 THEN 'train' ELSE 'test' END AS role, sum(weight * claims) / sum(weight * mu) AS ae FROM book GROUP BY 1) SELECT role, round(ae, 7) AS ae, CASE WHEN {_off('ae', 0.02)} AND role = 'train' OR {_off('ae', 0.05)} THEN 'warning' ELSE 'pass' END AS status FROM s")
def review_overall_ae(spark, d):
    rows = book(spark, d).withColumn("role", F.when(F.col("fold") < 3, "train").otherwise("test"))
    return _round(rules.overall_ae(review.actual_expected(rows, ["role"], "claims", "mu", "weight").select("role", "ae")), 7, "ae")


def _bands_sql(band: str) -> str:
    return f", s AS (SELECT CAST({band} AS INT) AS band, sum(weight * exposure) AS mass, sum(weight * claims) / sum(weight * mu) AS ae, (sum(weight * claims) - sum(weight * mu)) / sqrt(sum(weight * mu)) AS z FROM book GROUP BY 1)"


def _status_sql(limit: float) -> str:
    return f"CASE WHEN {_off('ae', limit)} AND abs(z) >= 3 THEN 'warning' WHEN {_off('ae', limit)} AND abs(z) >= 2 THEN 'info' ELSE 'pass' END"


def _banded(spark, d, band):
    rows = book(spark, d).withColumn("mass", F.col("weight") * F.col("exposure"))
    return report.factor_bands(rows, band.cast("int"), "claims", "mu", "weight", F.col("mass"), F.col("mu")).select("band", "mass", "ae", "z")


def _shown(bands):
    return _round(_round(_round(bands, 4, "mass"), 7, "ae"), 5, "z")


@query(_bands_sql(QB) + f" SELECT band, round(mass, 4) AS mass, round(ae, 7) AS ae, round(z, 5) AS z, CASE WHEN mass >= 0.01 * (SELECT sum(mass) FROM s) THEN {_status_sql(0.1)} ELSE 'none' END AS status FROM s")
def review_factor_ae(spark, d):
    total = book(spark, d).agg(F.sum(F.col("weight") * F.col("exposure")).alias("mass"))
    return _shown(rules.factor_ae(_banded(spark, d, X.bin_index(F.col("l_quantity"), QUANTITY)), total))


MU_BORDERS = [0.75, 1.0, 1.25, 1.5]


@query(_bands_sql(_bin_sql("mu", MU_BORDERS)) + f" SELECT band, round(mass, 4) AS mass, round(ae, 7) AS ae, round(z, 5) AS z, {_status_sql(0.05)} AS status FROM s")
def review_decile_ae(spark, d):
    return _shown(rules.decile_ae(_banded(spark, d, X.bin_index(F.col("mu"), MU_BORDERS))))


_SHARE = f"(SELECT {QB} AS bin, sum(weight) / (SELECT sum(weight) FROM book WHERE {{0}}) AS m FROM book WHERE {{0}} GROUP BY 1)"


@query(
    f", j AS (SELECT greatest(coalesce(a.m, 0), 0.0001) AS p, greatest(coalesce(b.m, 0), 0.0001) AS q FROM {_SHARE.format('l_discount <= 0.04')} a FULL JOIN {_SHARE.format('l_discount > 0.04 AND l_quantity > 10')} b ON a.bin = b.bin), s AS (SELECT sum((q - p) * ln(q / p)) AS psi FROM j)"
    " SELECT round(psi, 7) AS psi, CASE WHEN psi > 0.25 THEN 'critical' WHEN psi > 0.1 THEN 'warning' ELSE 'pass' END AS status FROM s"
)
def review_drift(spark, d):
    b = book(spark, d).withColumn("bin", X.bin_index(F.col("l_quantity"), QUANTITY))
    return _round(rules.drift(review.stability_index(b.where("l_discount <= 0.04"), b.where("l_discount > 0.04 AND l_quantity > 10"), "bin", "weight")), 7, "psi")


def _explained_sql(name: str, where: str) -> str:
    return f"{name} AS (SELECT 1 - sum({POISSON.format('mu')}) / sum({POISSON.format('(SELECT sum(weight * claims) / sum(weight) FROM book WHERE ' + where + ')')}) AS v FROM book WHERE {where})"


def _explained(rows):
    mean = rows.agg((F.sum(F.col("weight") * F.col("claims")) / F.sum("weight")).alias("mean"))
    cost = lambda m: F.sum(F.col("weight") * X.unit_deviance("poisson", F.col("claims"), F.col(m)))
    return rows.join(F.broadcast(mean)).agg((1 - cost("mu") / cost("mean")).alias("explained"))


@query(f", {_explained_sql('a', 'fold < 3')}, {_explained_sql('b', 'fold >= 3')} SELECT 'beats_null' AS rule, round(b.v, 7) AS value, CASE WHEN b.v <= 0 THEN 'critical' ELSE 'pass' END AS status FROM b UNION ALL SELECT 'train_gap', round(a.v - b.v, 7), CASE WHEN a.v - b.v > 0.05 THEN 'warning' ELSE 'pass' END FROM a, b")
def review_explained(spark, d):
    b = book(spark, d)
    return _round(rules.explained(_explained(b.where("fold < 3")), _explained(b.where("fold >= 3"))), 7, "value")


@query(
    f", x AS (SELECT {LEVEL} AS value, weight FROM book WHERE fold >= 3), v AS (SELECT value, sum(weight) AS m FROM x WHERE value NOT IN (SELECT {LEVEL} FROM book WHERE fold < 3 AND l_partkey % 100 = 0) GROUP BY 1), t AS (SELECT count(*) AS n, sum(m) / (SELECT sum(weight) FROM x) AS share FROM v)"
    " SELECT 'brand' AS feature, n AS n_values, round(share, 8) AS share, CASE WHEN share > 0.01 THEN 'warning' ELSE 'info' END AS status FROM t WHERE n > 0"
)
def review_unseen(spark, d):
    b = book(spark, d)
    later = b.where("fold >= 3")
    known = b.where("fold < 3 AND l_partkey % 100 = 0").select(F.lit("brand").alias("feature"), encode.level_of(F.col("brand")).alias("value")).distinct()
    return _round(rules.unseen(encode.unseen_values(later, ["brand"], known, "weight"), later.agg(F.sum("weight").alias("mass"))), 8, "share")
