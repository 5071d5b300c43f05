"""More registered queries: measured credibility, splits with missing values, smoothing, and measures of the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import expr as X
from .operators import binning, credibility, encode, report, review, tables, training
from .queries import BASE, CELLS, DB, KEYS, LEAF, LEVEL, LORENZ, QB, QUANTITY, RARE_SQL, STRENGTH, SUMS, T1, T2, T3, TB, _bin_sql, _bins, _leaf, _round, _tables, query
from .sources.book import book

ID = ", ".join(KEYS)


# --- credibility ---------------------------------------------------------------------------------------------


def _auto_sql(level: str) -> str:
    return (
        f", r AS (SELECT {level} AS level, weight * exposure AS w, claims / exposure AS rate FROM book), l AS (SELECT level, sum(w) AS w, sum(w * rate) / sum(w) AS mean FROM r GROUP BY 1),"
        " f AS (SELECT (SELECT sum(w * rate) / sum(w) FROM r) AS base, (SELECT sum(w) FROM l) AS total, (SELECT count(*) FROM l) AS n, (SELECT sum(r.w * (rate - mean) * (rate - mean)) FROM r JOIN l ON r.level = l.level) AS ss),"
        " k AS (SELECT ss / (total - n) AS s2, n, base, total, ss FROM f), z AS (SELECT w, w * (mean - base) * (mean - base) / s2 AS z2, w * (mean - base) * (mean - base) AS b FROM l, k),"
        " c AS (SELECT sum(CASE WHEN z2 > 9 THEN z2 - 1 END) AS zs, sum(CASE WHEN z2 > 9 THEN w END) AS ws, sum(b) AS bs FROM z),"
        " m AS (SELECT CASE WHEN n <= 2 THEN least(ss / bs, 1000000) WHEN ws IS NULL OR zs - 0.0266 * n <= 0 THEN 1000000 ELSE least(s2 / (s2 * (zs - 0.0266 * n) / ws), 1000000) END AS strength FROM k, c)"
    )


@query(_auto_sql("CAST(l_linenumber AS VARCHAR)") + " SELECT round(CAST(strength AS DOUBLE), 6) AS strength FROM m")
def cat_auto_strength(spark, d):
    return _round(credibility.auto_strength(book(spark, d), "l_linenumber", "claims", "weight", "exposure"), 6, "strength")


@query(_auto_sql("l_linestatus") + " SELECT round(CAST(strength AS DOUBLE), 4) AS strength FROM m")
def cat_auto_strength_binary(spark, d):
    return _round(credibility.auto_strength(book(spark, d), "l_linestatus", "claims", "weight", "exposure"), 4, "strength")


@query(_auto_sql(LEVEL) + f"{SUMS} SELECT level, level AS member, round((wy + strength * {BASE}) / (we + strength), 8) AS encoding FROM s, m")
def cat_encode_auto(spark, d):
    return _round(credibility.auto_encoding(book(spark, d), "brand", "claims", "weight", "exposure"), 8, "encoding")


@query(RARE_SQL + " SELECT count(DISTINCT level) AS n FROM p")
def cat_pooled_count(spark, d):
    return credibility.level_count(book(spark, d), "l_partkey", "claims", "weight", "exposure", 40.0)


@query(
    f", h AS (SELECT {LEVEL} AS level, sum(weight * claims) AS wy, sum(weight * exposure) AS we FROM book WHERE p_size < 10 AND l_partkey % 4 = 0 GROUP BY 1), b AS (SELECT sum(weight * claims) / sum(weight * exposure) AS base FROM book WHERE p_size < 10 AND l_partkey % 4 = 0)"
    f" SELECT {ID}, round(coalesce((wy + 20 * base) / (we + 20), 1.5), 8) AS encoding FROM book LEFT JOIN h ON {LEVEL} = level, b"
)
def serve_unseen_default(spark, d):
    b = book(spark, d)
    known = encode.fixed_encoding(b.where("p_size < 10 AND l_partkey % 4 = 0"), "brand", "claims", "weight", "exposure", STRENGTH)
    return _round(credibility.serve_encoding(b, "brand", known, 1.5).select(*KEYS, "encoding"), 8, "encoding")


@query(
    f", s AS (SELECT {LEVEL} AS level, fold, sum(weight * claims) AS wy, sum(weight * exposure) AS we FROM book GROUP BY 1, 2), t AS (SELECT level, sum(wy) AS ly, sum(we) AS le FROM s GROUP BY 1), f AS (SELECT fold, sum(wy) AS fy, sum(we) AS fe FROM s GROUP BY 1), a AS (SELECT sum(wy) AS ty, sum(we) AS te FROM s)"
    f" SELECT {ID}, round((ly - wy + 20 * (ty - fy) / (te - fe)) / (le - we + 20), 8) AS encoding FROM book JOIN s ON {LEVEL} = s.level AND book.fold = s.fold JOIN t ON s.level = t.level JOIN f ON s.fold = f.fold, a"
)
def cat_kfold_rows(spark, d):
    b = book(spark, d)
    known = encode.kfold_encoding(b, "brand", "claims", "weight", "exposure", "fold", STRENGTH)
    return _round(credibility.kfold_rows(b, "brand", "fold", known, 1.5).select(*KEYS, "encoding"), 8, "encoding")


def _shift_sql(start: str) -> str:
    step = "(SELECT (sum(wy) - sum(w / (1 + exp(-(c + s))))) / sum(w / (1 + exp(-(c + s))) * (1 - 1 / (1 + exp(-(c + s))))) FROM u)"
    body = f"SELECT {start} AS s, sum(weight) AS w, sum(weight * returned) AS wy FROM book GROUP BY 1"
    chain = f", u AS ({body}), c0 AS (SELECT ln(sum(wy) / (sum(w) - sum(wy))) - sum(w * s) / sum(w) AS c FROM u)"
    for k in range(12):
        chain += f", c{k + 1} AS (SELECT c + {step} AS c FROM c{k})"
    return chain + " SELECT round(c, 7) AS shift FROM c12"


@query(_shift_sql("ln(exposure)"))
def null_model_logit(spark, d):
    return _round(credibility.logit_shift(book(spark, d), "returned", F.ln("exposure"), "weight"), 7, "shift")


@query(_shift_sql("score"))
def reanchor_logit(spark, d):
    return _round(credibility.logit_shift(book(spark, d), "returned", F.col("score"), "weight"), 7, "shift")


# --- training ------------------------------------------------------------------------------------------------

GAPPY = "CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE l_discount END"
GB = _bin_sql(f"({GAPPY})", [0.02, 0.05, 0.08])


def _poisson():
    return X.grad_hess("poisson", F.col("claims"), F.col("score"))


def _gappy_histogram(spark, d):
    bins = {**_bins(), 1: X.bin_index(F.expr(GAPPY), [0.02, 0.05, 0.08])}
    return training.gradient_histogram(book(spark, d), _leaf(), bins, *_poisson(), F.col("weight"))


_SOFT = "sign({0}) * greatest(abs({0}) - 2, 0)"


def _term(g: str, h: str) -> str:
    soft = _SOFT.format(g)
    step = f"greatest(-0.3, least(0.3, -({soft}) / ({h} + 1)))"
    return f"greatest(0, -2 * ({soft}) * {step} - ({h} + 1) * {step} * {step})"


FULL = (
    f", r AS (SELECT {LEAF} AS leaf, {QB} AS b0, {GB} AS b1, {TB} AS b2, weight * (exp(score) - claims) AS g, weight * exp(score) AS h FROM book),"
    " u AS (SELECT leaf, 0 AS axis, b0 AS bin, g, h FROM r UNION ALL SELECT leaf, 1, b1, g, h FROM r UNION ALL SELECT leaf, 2, b2, g, h FROM r), a AS (SELECT axis, max(bin) AS top FROM u GROUP BY 1), l AS (SELECT DISTINCT leaf, axis FROM u),"
    " t AS (SELECT axis, bin_le, m FROM a, range(0, 256) x(bin_le), (VALUES (false), (true)) v(m) WHERE bin_le < greatest(top, 1) AND (bin_le > 0 OR m)),"
    " e AS (SELECT t.axis, t.bin_le, t.m, u.leaf, sum(u.g) AS gt, sum(u.h) AS ht, sum(CASE WHEN (u.bin = 0 AND t.m) OR (u.bin > 0 AND u.bin <= t.bin_le) THEN u.g ELSE 0 END) AS gl, sum(CASE WHEN (u.bin = 0 AND t.m) OR (u.bin > 0 AND u.bin <= t.bin_le) THEN u.h ELSE 0 END) AS hl"
    " FROM t JOIN (SELECT leaf, axis, bin, sum(g) AS g, sum(h) AS h FROM u GROUP BY 1, 2, 3) u ON t.axis = u.axis GROUP BY 1, 2, 3, 4),"
    f" gains AS (SELECT CAST(axis AS INT) AS axis, CAST(bin_le AS INT) AS bin_le, m AS missing_low, 0.5 * sum({_term('gl', 'hl')} + {_term('(gt - gl)', '(ht - hl)')} - {_term('gt', 'ht')}) AS gain FROM e GROUP BY 1, 2, 3)"
)


@query(FULL + " SELECT axis, bin_le, missing_low, round(gain, 4) + CAST(0 AS DOUBLE) AS gain FROM gains")
def split_scan_missing(spark, d):
    gains = _round(training.all_split_gains(_gappy_histogram(spark, d), 1.0, 2.0, 0.3), 4, "gain")
    return gains.withColumn("gain", F.col("gain") + 0.0)


@query(FULL + " SELECT axis, bin_le, missing_low, round(gain, 4) AS gain FROM gains ORDER BY round(gain, 9) DESC, axis, bin_le, missing_low LIMIT 1")
def best_split_missing(spark, d):
    return _round(training.best_of_all_splits(training.all_split_gains(_gappy_histogram(spark, d), 1.0, 2.0, 0.3)), 4, "gain")


_UNIT = "CAST(round(({}) * 1048576) AS BIGINT)"


@query(
    f", r AS (SELECT {LEAF} AS leaf, {QB} AS b0, {DB} AS b1, {TB} AS b2, {_UNIT.format('exp(score) - claims')} AS g, {_UNIT.format('exp(score)')} AS h FROM book),"
    " u AS (SELECT leaf, 0 AS axis, b0 AS bin, g, h FROM r UNION ALL SELECT leaf, 1, b1, g, h FROM r UNION ALL SELECT leaf, 2, b2, g, h FROM r)"
    " SELECT CAST(leaf AS INT) AS leaf, CAST(axis AS INT) AS axis, CAST(bin AS INT) AS bin, CAST(sum(g) AS BIGINT) AS g, CAST(sum(h) AS BIGINT) AS h, count(*) AS n FROM u GROUP BY 1, 2, 3"
)
def histogram_whole_numbers(spark, d):
    return training.whole_number_histogram(book(spark, d), _leaf(), _bins(), *_poisson())


@query(
    f", r AS (SELECT {LEAF} + CASE WHEN {DB} BETWEEN 1 AND 2 THEN 4 ELSE 0 END AS leaf, {QB} AS b0, {DB} AS b1, {TB} AS b2, weight * (exp(score) - claims) AS g, weight * exp(score) AS h, weight AS w FROM book),"
    " u AS (SELECT leaf, 0 AS axis, b0 AS bin, g, h, w FROM r UNION ALL SELECT leaf, 1, b1, g, h, w FROM r UNION ALL SELECT leaf, 2, b2, g, h, w FROM r)"
    " SELECT CAST(leaf AS INT) AS leaf, CAST(axis AS INT) AS axis, CAST(bin AS INT) AS bin, round(sum(g), 4) + CAST(0 AS DOUBLE) AS g, round(sum(h), 4) AS h, count(*) AS n, sum(w) AS w FROM u GROUP BY 1, 2, 3"
)
def histogram_sibling(spark, d):
    b, bins = book(spark, d), _bins()
    parent = training.gradient_histogram(b, _leaf(), bins, *_poisson(), F.col("weight"))
    low = b.where(X.low_bit(bins[1], 2, False))
    child = training.gradient_histogram(low, _leaf() + 4, bins, *_poisson(), F.col("weight"))
    return _round(training.sibling_histogram(parent, child, 2), 4, "g", "h").withColumn("g", F.col("g") + 0.0)


_NEWTON = f"greatest(-0.3, least(0.3, -({_SOFT.format('g')}) / (h + 1)))"
LEAVES = f", q AS (SELECT CAST({LEAF} AS INT) AS leaf, sum(weight * (exp(score) - claims)) AS g, sum(weight * exp(score)) AS h, count(*) AS n FROM book GROUP BY 1)"


def _leaves(spark, d):
    return training.newton_leaves(book(spark, d), _leaf(), *_poisson(), F.col("weight"), 1.0, 2.0, 0.1, 0.3)


@query(LEAVES + f" SELECT leaf, round(0.1 * {_NEWTON}, 8) AS value, n FROM q")
def leaf_values_bounded(spark, d):
    return _round(_leaves(spark, d).select("leaf", "value", "n"), 8, "value")


def _node(level: int) -> str:
    return f"n{level} AS (SELECT leaf % {1 << level} AS node, sum(g) AS g, sum(h) AS h, sum(n) AS n FROM q GROUP BY 1), s{level} AS (SELECT x.node, (0.1 * {_NEWTON} * n + {'0' if level == 0 else 'p.v'} * 50) / (n + 50) AS v FROM n{level} x" + (
        ")" if level == 0 else f" JOIN s{level - 1} p ON x.node % {1 << (level - 1)} = p.node)"
    )


@query(LEAVES + ", " + ", ".join(_node(k) for k in range(3)) + " SELECT CAST(node AS INT) AS leaf, round(v, 8) AS value FROM s2")
def leaf_path_smooth(spark, d):
    return _round(training.path_smoothed(_leaves(spark, d), 2, 50.0, 1.0, 2.0, 0.1, 0.3), 8, "value")


@query(
    ", v AS (SELECT CAST((l_linenumber + l_partkey) % 8 AS INT) AS leaf, avg(claims - mu) AS value FROM book GROUP BY 1)"
    " SELECT CAST(mask AS INT) AS mask, round(sum(CASE WHEN bit_count(CAST(mask AS INT) & leaf) % 2 = 1 THEN -value ELSE value END) / 8, 8) + CAST(0 AS DOUBLE) AS coefficient FROM v, range(0, 8) r(mask) GROUP BY 1"
)
def leaf_sign_coefficients(spark, d):
    leaves = book(spark, d).groupBy(((F.col("l_linenumber") + F.col("l_partkey")) % 8).cast("int").alias("leaf")).agg(F.avg(F.col("claims") - F.col("mu")).alias("value"))
    return _round(training.sign_coefficients(leaves), 8, "coefficient").withColumn("coefficient", F.col("coefficient") + 0.0)


# --- tables --------------------------------------------------------------------------------------------------

_RANKS = [("qty", "a", "1 + CAST(abs(b) > abs(a) AS INT) + CAST(abs(c) > abs(a) AS INT)"), ("qty:disc", "b", "1 + CAST(abs(a) >= abs(b) AS INT) + CAST(abs(c) > abs(b) AS INT)"), ("tax:size", "c", "1 + CAST(abs(a) >= abs(c) AS INT) + CAST(abs(b) >= abs(c) AS INT)")]


@query(f", r AS (SELECT {ID}, {T1} AS a, {T2} AS b, {T3} AS c FROM book) " + " UNION ALL ".join(f"SELECT {ID}, '{k}' AS effect, {c} AS contribution, {rank} AS rank FROM r" for k, c, rank in _RANKS))
def contribution_rank(spark, d):
    return tables.ranked_contributions(book(spark, d), KEYS, {":".join(k): v for k, v in _tables().items()})


JOINT = (
    f", r AS (SELECT weight * exposure AS m, {T1} AS a, {T2} AS b, {T3} AS c FROM book), u AS (SELECT 'qty' AS table_id, m, a AS v FROM r UNION ALL SELECT 'qty:disc', m, b FROM r UNION ALL SELECT 'tax:size', m, c FROM r UNION ALL SELECT '*', m, a + b + c FROM r),"
    " e AS (SELECT table_id, sum(m * v) / sum(m) AS mean FROM u GROUP BY 1), jv AS (SELECT table_id, sum(m * (v - mean) * (v - mean)) / sum(m) AS variance FROM u JOIN e USING (table_id) GROUP BY 1)"
)


def _joint(spark, d):
    return tables.joint_variance(book(spark, d), {":".join(k): v for k, v in _tables().items()}, F.col("weight") * F.col("exposure"))


@query(JOINT + " SELECT table_id, round(variance, 9) AS variance FROM jv")
def joint_variance(spark, d):
    return _round(_joint(spark, d), 9, "variance")


@query(
    JOINT + ", f AS (SELECT unnest(string_split(table_id, ':')) AS feature, variance / (SELECT sum(variance) FROM jv WHERE table_id <> '*') / len(string_split(table_id, ':')) AS part FROM jv WHERE table_id <> '*')"
    " SELECT feature, round(sum(part), 8) AS importance FROM f GROUP BY 1"
)
def feature_importances(spark, d):
    return _round(tables.feature_importances(_joint(spark, d)), 8, "importance")


@query(
    f", x AS (SELECT {QB} AS cell, round({T1} + {T2} / 2, 8) AS v, weight * exposure AS w FROM book), v AS (SELECT cell, v, sum(w) AS w FROM x GROUP BY 1, 2), c AS (SELECT cell, v, w, sum(w) OVER (PARTITION BY cell ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY cell) AS total FROM v)"
    " SELECT cell, round(sum(w * v) / sum(w), 7) AS mean, min(CASE WHEN cum >= 0.1 * total THEN v END) AS q_1, min(CASE WHEN cum >= 0.9 * total THEN v END) AS q_2 FROM c GROUP BY 1"
)
def shapley_spread(spark, d):
    own = tables.equal_split(_tables())["qty"]
    rows = book(spark, d).select(X.bin_index(F.col("l_quantity"), QUANTITY).alias("cell"), F.round(own, 8).alias("v"), (F.col("weight") * F.col("exposure")).alias("w"))
    return _round(review.cell_quantiles(rows, "cell", "v", "w", [0.1, 0.9]), 7, "mean")


# --- report --------------------------------------------------------------------------------------------------

PERCENTS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@query("SELECT unnest([" + ", ".join(f"CAST({q} AS DOUBLE)" for q in PERCENTS) + "]) AS share, round(unnest(quantile_cont(mu, [" + ", ".join(map(str, PERCENTS)) + "])), 8) AS value FROM book")
def score_percentiles(spark, d):
    return _round(report.percentiles(book(spark, d), "mu", PERCENTS), 8, "value")


@query(
    ", v AS (SELECT CAST(l_quantity AS FLOAT) AS v, sum(weight) AS w FROM book GROUP BY 1), c AS (SELECT v, sum(w) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, (SELECT sum(w) FROM v) AS total FROM v),"
    " e AS (SELECT share, min(CASE WHEN cum >= share * total THEN v END) AS low, min(CASE WHEN cum > share * total THEN v END) AS high FROM c, (SELECT CAST(unnest([0.125, 0.25, 0.5, 0.75, 1]) AS DOUBLE) AS share) GROUP BY 1)"
    " SELECT share, CAST((CAST(low AS DOUBLE) + CAST(coalesce(high, low) AS DOUBLE)) / 2 AS FLOAT) AS value FROM e"
)
def weighted_quantiles_averaged(spark, d):
    return binning.weighted_quantiles(book(spark, d), "l_quantity", "weight", [0.125, 0.25, 0.5, 0.75, 1.0])


@query(
    LORENZ + ", p AS (SELECT CAST(k AS DOUBLE) / 100 AS x FROM range(0, 101) r(k)), o AS (SELECT x, (SELECT min(cw) FROM lz WHERE dw > 0 AND cw >= x - 0.000000001) AS hit FROM p)"
    " SELECT x, round(cy - dy + dy * greatest(0, least(1, (x - (cw - dw)) / dw)), 6) AS y FROM o JOIN lz ON cw = hit AND dw > 0"
)
def lorenz_sampled(spark, d):
    return _round(report.sampled_lorenz(book(spark, d), F.col("mu"), "claims", "weight"), 6, "y")


N_CELLS = 51


def _priced(spark, d):
    b = book(spark, d)
    return b.withColumn("cell", F.col("l_quantity").cast("int")).withColumn("mass", F.col("weight") * F.col("exposure"))


def _grouped(spark, d, categorical: bool = False):
    rows = _priced(spark, d)
    return rows, report.cell_groups(report.masses(rows.where("fold < 3"), "cell", F.col("mass"), N_CELLS), 10, categorical)


# A band ends at a cell if the running mass reaches the next share; here no cell holds more than one share.
BANDS = (
    ", x AS (SELECT *, CAST(l_quantity AS INT) AS cell, weight * exposure AS mass FROM book), cm AS (SELECT cell, sum(mass) AS m FROM x WHERE fold < 3 GROUP BY 1), cc AS (SELECT cell, sum(m) OVER (ORDER BY cell ROWS UNBOUNDED PRECEDING) AS acc, m, (SELECT sum(m) FROM cm) AS total FROM cm),"
    " bands AS (SELECT cell, CAST(1 + least(8, floor((acc - m) * 9 / total)) AS INT) AS band FROM cc)"
)


@query(
    BANDS + " SELECT band, count(*) AS rows, round(sum(mass), 4) AS mass, round(sum(weight * claims), 4) AS actual, round(sum(weight * mu), 4) AS expected, round(sum(weight * claims) / sum(weight * mu), 7) AS ae, round(sqrt(sum(weight * mu)) / sum(weight * mu), 7) AS sd,"
    " round((sum(weight * claims) - sum(weight * mu)) / sqrt(sum(weight * mu)), 5) AS z FROM x JOIN bands USING (cell) GROUP BY 1"
)
def factor_bands(spark, d):
    rows, groups = _grouped(spark, d)
    bands = report.factor_bands(rows, report.band_of(F.col("cell"), groups), "claims", "mu", "weight", F.col("mass"), F.col("mu"))
    return _round(_round(_round(bands, 4, "mass", "actual", "expected"), 7, "ae", "sd"), 5, "z")


def _drift(side: str) -> str:
    return f"(SELECT band, sum(mass) / (SELECT sum(mass) FROM x WHERE {side}) AS m FROM x JOIN bands USING (cell) WHERE {side} GROUP BY 1)"


PSI = ", j AS (SELECT coalesce(a.band, b.band) AS band, coalesce(a.m, 0) AS p, coalesce(b.m, 0) AS q FROM {} a FULL JOIN {} b ON a.band = b.band) SELECT band, round(p, 8) AS p, round(q, 8) AS q, round((greatest(q, 0.0001) - greatest(p, 0.0001)) * ln(greatest(q, 0.0001) / greatest(p, 0.0001)), 9) AS term FROM j"


def _psi_rows(rows, groups):
    own = rows.select(report.band_of(F.col("cell"), groups).alias("band"), "mass", "fold")
    return _round(_round(report.stability_bands(own.where("fold < 3"), own.where("fold >= 3"), "band", "mass"), 8, "p", "q"), 9, "term")


@query(BANDS + PSI.format(_drift("fold < 3"), _drift("fold >= 3")))
def psi_bands(spark, d):
    return _psi_rows(*_grouped(spark, d))


LEVEL_BANDS = BANDS.replace("CAST(1 + least(8, floor((acc - m) * 9 / total)) AS INT) AS band FROM cc", "CAST(least(9, row_number() OVER (ORDER BY m DESC, cell)) AS INT) AS band FROM cc")


@query(LEVEL_BANDS + PSI.format(_drift("fold < 3"), _drift("fold >= 3")))
def psi_levels(spark, d):
    return _psi_rows(*_grouped(spark, d, categorical=True))


_TOP = "greatest(score, 0.5 * score, -score)"
_E = {"A": f"exp(score - {_TOP})", "N": f"exp(0.5 * score - {_TOP})", "R": f"exp(-score - {_TOP})"}
_SUM = " + ".join(_E.values())


def _classes(spark, d):
    ps = X.softmax([F.col("score"), 0.5 * F.col("score"), -F.col("score")])
    return book(spark, d).select("l_returnflag", "weight", *[p.alias(f"p{k}") for k, p in enumerate(ps)])


@query(" UNION ALL ".join(f"SELECT l_returnflag AS actual, '{k}' AS predicted, round(sum(weight * {e} / ({_SUM})), 4) AS expected FROM book GROUP BY 1" for k, e in _E.items()))
def class_expected_matrix(spark, d):
    return _round(report.expected_classes(_classes(spark, d), "l_returnflag", {"A": "p0", "N": "p1", "R": "p2"}, "weight"), 4, "expected")


@query("SELECT round(sum(CASE WHEN l_returnflag = CASE WHEN score >= 0 THEN 'A' ELSE 'R' END THEN weight ELSE 0 END) / sum(weight), 9) AS accuracy FROM book")
def class_accuracy(spark, d):
    return _round(report.accuracy(_classes(spark, d), "l_returnflag", {"A": "p0", "N": "p1", "R": "p2"}, "weight"), 9, "accuracy")


_MARK = "md5(concat_ws(':', '7', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in KEYS) + "))"


@query(f"SELECT {ID}, row_number() OVER (PARTITION BY claims > 0 ORDER BY {_MARK}, {ID}) <= floor(count(*) OVER (PARTITION BY claims > 0) * 0.1) AS held FROM book")
def holdout_stratified(spark, d):
    return report.holdout(book(spark, d), KEYS, 0.1, 7, F.col("claims") > 0)


@query("SELECT l_orderkey, row_number() OVER (ORDER BY md5(concat_ws(':', '7', CAST(l_orderkey AS VARCHAR))), l_orderkey) <= floor(count(*) OVER () * 0.1) AS held FROM (SELECT DISTINCT l_orderkey FROM book)")
def holdout_groups(spark, d):
    return report.group_holdout(book(spark, d), "l_orderkey", 0.1, 7)


@query(CELLS.replace("mu FROM book", "mu, exposure FROM book") + " SELECT c0 AS band, count(*) AS rows, round(sum(mass), 4) AS mass, round(sum(weight * claims), 4) AS actual, round(sum(weight * mu), 4) AS expected, round(sum(weight * claims) / sum(weight * mu), 7) AS ae, round(sqrt(sum(weight * mu * exposure)) / sum(weight * mu), 7) AS sd, round((sum(weight * claims) - sum(weight * mu)) / sqrt(sum(weight * mu * exposure)), 5) AS z FROM x GROUP BY 1")
def ae_by_cell_spread(spark, d):
    rows = book(spark, d).withColumn("mass", F.col("weight") * F.col("exposure"))
    bands = report.factor_bands(rows, X.bin_index(F.col("l_quantity"), QUANTITY).cast("int"), "claims", "mu", "weight", F.col("mass"), F.col("mu") * F.col("exposure"))
    return _round(_round(_round(bands, 4, "mass", "actual", "expected"), 7, "ae", "sd"), 5, "z")
