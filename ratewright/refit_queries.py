"""Registered queries on refits over co-occurring cells, the joint measure, master cuts and boxes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .functions import expr as X
from .operators import binning, cooccur, ensemble, joint, training
from .plans import banding, boxes, refit
from .plans.boost import Settings, Split, Tree, _cell_value, after_round, between, fit, without
from .queries import BOOK_SELECT, DB, DISCOUNT, KEYS, LEAF, QB, QUANTITY, TAX, TB, TWO_WAY, _array_sql, _bin_sql, _leaf, _round, query
from .sources.book import book

R = f"WITH RECURSIVE book AS ({BOOK_SELECT})"


# --- fully-corrective refit ----------------------------------------------------------------------------------

SIDE = f"(CASE WHEN {DB} = 0 THEN 1 WHEN {DB} <= 2 THEN 1 ELSE 0 END)"
FLAT = f"(CASE WHEN {QB} = 0 THEN 0 WHEN {QB} <= 2 THEN 1 ELSE 0 END)"


def _side():
    return X.leaf_index([(X.bin_index(F.col("l_discount"), DISCOUNT), 2, True)])


def _flat():
    return X.leaf_index([(X.bin_index(F.col("l_quantity"), QUANTITY), 2, False)])


@query(
    f", r AS (SELECT {LEAF} AS x, {SIDE} AS z, weight * exp(score) AS h FROM book), p AS (SELECT 0 AS t, x AS c, 0 AS u, x AS d, h FROM r UNION ALL SELECT 0, x, 1, z, h FROM r UNION ALL SELECT 1, z, 1, z, h FROM r)"
    " SELECT t, c, u, d, round(sum(h), 5) AS mass FROM p GROUP BY ALL"
)
def refit_normal_equations(spark, d):
    """Curvature of the pairs of leaves of two trees: the left side of a refit's normal equations."""
    return _round(cooccur.co_occurrence(book(spark, d), [_leaf(), _side()], {"mass": F.col("weight") * F.exp("score")}), 5, "mass")


RIDGE, LEVEL = 3000.0, 1.5


@query(
    f"{R}, r AS (SELECT {FLAT} AS i, {SIDE} AS j, weight AS w, claims - {LEVEL} AS y FROM book),"
    " m AS (SELECT " + ", ".join(f"coalesce(sum(w) FILTER (i = {i} AND j = {j}), 0) AS w{i}{j}" for i in (0, 1) for j in (0, 1)) + ", " + ", ".join(f"coalesce(sum(w * y) FILTER ({n} = {k}), 0) AS {n}{k}" for n in "ij" for k in (0, 1)) + " FROM r),"
    " g AS (SELECT 0 AS k, CAST(0 AS DOUBLE) AS a0, CAST(0 AS DOUBLE) AS a1, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1 UNION ALL"
    f" SELECT k + 1, a0, a1, (j0 - w00 * a0 - w10 * a1) / (w00 + w10 + {RIDGE}), (j1 - w01 * a0 - w11 * a1) / (w01 + w11 + {RIDGE}) FROM"
    f" (SELECT k, (i0 - w00 * b0 - w01 * b1) / (w00 + w01 + {RIDGE}) AS a0, (i1 - w10 * b0 - w11 * b1) / (w10 + w11 + {RIDGE}) AS a1, m.* FROM g, m WHERE k < 800))"
    f" SELECT i AS leaf_a, j AS leaf_b, count(*) AS n, round(max({LEVEL} + CASE WHEN i = 0 THEN a0 ELSE a1 END + CASE WHEN j = 0 THEN b0 ELSE b1 END), 6) AS score FROM r, g WHERE k = 800 GROUP BY 1, 2",
    False,
)
def refit_two_trees(spark, d):
    """Two trees refitted together by least squares with a ridge, and the scores that they then give."""
    leaves = F.array(_flat().cast("int"), (2 + _side()).cast("int"))
    rows = book(spark, d).select(leaves.alias("leaves"), F.lit(LEVEL).alias("base"), F.col("claims").alias("y"), F.col("weight").alias("w"))
    values, _ = refit.refit_values(rows, [2, 2], np.zeros(4), Settings(loss="squared_error"), RIDGE, passes=1)
    found = rows.groupBy((F.get("leaves", 0)).alias("leaf_a"), (F.get("leaves", 1) - 2).alias("leaf_b"), "leaves", "base").agg(F.count("*").alias("n"))
    return _round(found.select("leaf_a", "leaf_b", "n", (F.col("base") + refit._score(F.col("leaves"), values)).alias("score")), 6, "score")


# --- the joint measure ---------------------------------------------------------------------------------------

MASS = f"weight * (1 + {QB} * {DB})"
_AT = "[(i - 1) * 4 + j]"
_gap = lambda c, a, b: f"w{_AT} * (v{_AT} - {c} - {a} - {b})"
_over = lambda n, x, body: f"list_sum(list_transform(range(1, {n}), lambda {x}: {body}))"
JOINT = f"""{R}, x AS (SELECT {QB} AS i, {DB} AS j, sum({MASS}) AS m FROM book GROUP BY 1, 2),
t AS (SELECT i, j, coalesce(m, 0) AS m, {_array_sql(TWO_WAY, "i * 5 + j")} AS v FROM range(1, 6) p(i) CROSS JOIN range(1, 5) q(j) LEFT JOIN x USING (i, j)),
s AS (SELECT i, j, v, m, sum(m) OVER (PARTITION BY i) / sum(m) OVER () AS mi, sum(m) OVER (PARTITION BY j) / sum(m) OVER () AS mj, m / sum(m) OVER () AS share FROM t),
l AS (SELECT list((share + 1e-6 * mi * mj) / (1 + 1e-6) ORDER BY i, j) AS w, list(v ORDER BY i, j) AS v, list(mi ORDER BY i) FILTER (j = 1) AS mi, list(mj ORDER BY j) FILTER (i = 1) AS mj FROM s),
g AS (SELECT 0 AS k, CAST(0 AS DOUBLE) AS c, [CAST(0 AS DOUBLE) FOR z IN range(5)] AS a, [CAST(0 AS DOUBLE) FOR z IN range(4)] AS b UNION ALL
 SELECT k + 1, list_sum(list_transform(range(1, 6), lambda i: {_over(5, "j", f"w{_AT} * (v{_AT} - a[i] - b[j])")})), a, b FROM
 (SELECT k, v, w, a, list_transform(u, lambda z: z - list_sum(list_transform(range(1, 5), lambda j: mj[j] * u[j]))) AS b FROM
 (SELECT *, list_transform(range(1, 5), lambda j: {_over(6, "i", _gap("c", "a[i]", "0"))} / ({_over(6, "i", f"w{_AT}")} + 1e-3 * mj[j])) AS u FROM
 (SELECT k, v, w, mj, c + list_sum(list_transform(range(1, 6), lambda i: mi[i] * o[i])) AS c, list_transform(o, lambda z: z - list_sum(list_transform(range(1, 6), lambda i: mi[i] * o[i]))) AS a FROM
 (SELECT *, list_transform(range(1, 6), lambda i: {_over(5, "j", _gap("c", "0", "b[j]"))} / ({_over(5, "j", f"w{_AT}")} + 1e-3 * mi[i])) AS o FROM (SELECT g.*, w, v, mi, mj FROM g, l WHERE k < 60)))))),
e AS (SELECT i, j, m, c AS level, a[i] AS main_qty, b[j] AS main_disc, v - c - a[i] - b[j] AS pure FROM t, g WHERE k = 60)"""


def _rejointed(spark, d):
    """The rows' bins and masses, and constant and tables of the fixed pair table under their joint measure."""
    q, s = X.bin_index(F.col("l_quantity"), QUANTITY), X.bin_index(F.col("l_discount"), DISCOUNT)
    rows = book(spark, d).select(q.alias("i"), s.alias("j"), (F.col("weight") * (1 + q * s)).alias("mass"))
    masses = joint.pair_masses(rows, [F.col("i"), F.col("j")], [6, 5], F.col("mass"))
    tables = {(0,): np.zeros(6), (1,): np.zeros(5), (0, 1): np.array(TWO_WAY, float).reshape(6, 5)}
    constant, found = joint.rejoint(0.0, tables, masses)
    placed = rows.withColumns({"main_qty": _cell_value(found[(0,)], [F.col("i")]), "main_disc": _cell_value(found[(1,)], [F.col("j")]), "pure": _cell_value(found[0, 1], [F.col("i"), F.col("j")]), "level": F.lit(constant)})
    return placed


@query(JOINT + " SELECT i AS qty_bin, j AS disc_bin, round(m, 4) AS mass, round(level, 7) AS level, round(main_qty, 7) AS main_qty, round(main_disc, 7) AS main_disc, round(pure, 7) AS pure FROM e WHERE m > 0", False)
def joint_effects(spark, d):
    """A pair table parted into level, main effects and a rest under the joint measure of its features."""
    found = _rejointed(spark, d).groupBy(F.col("i").alias("qty_bin"), F.col("j").alias("disc_bin"), "level", "main_qty", "main_disc", "pure").agg(F.sum("mass").alias("mass"))
    return _round(_round(found, 7, "level", "main_qty", "main_disc", "pure"), 4, "mass")


@query(JOINT + " SELECT 'qty' AS axis, CAST(i AS INT) AS cell, round(sum(m * pure) / sum(m), 7) AS mean FROM e GROUP BY i HAVING sum(m) > 0 UNION ALL SELECT 'disc', CAST(j AS INT), round(sum(m * pure) / sum(m), 7) FROM e GROUP BY j HAVING sum(m) > 0", False)
def joint_conditional_purity(spark, d):
    """The mean of the rest in each cell of either feature, over the rows: zero but for what ridge and floor leave."""
    cells = F.explode(F.array(F.struct(F.lit("qty").alias("axis"), F.col("i").cast("int").alias("cell")), F.struct(F.lit("disc").alias("axis"), F.col("j").cast("int").alias("cell"))))
    rows = _rejointed(spark, d).select(cells.alias("x"), "mass", "pure")
    return _round(rows.groupBy("x.axis", "x.cell").agg((F.sum(F.col("mass") * F.col("pure")) / F.sum("mass")).alias("mean")), 7, "mean")


# --- banding -------------------------------------------------------------------------------------------------

CUTS = 5
BUMPY = "(CAST(({q} * {q} * 3 + {q} * {d} * 5) % 29 AS DOUBLE) / 10 + CAST({q} AS DOUBLE) / 25)"
_fold = lambda x: f"list_concat({x}[1:p - 1], [list_transform(range(1, 5), lambda t: {x}[p][t] + {x}[p + 1][t])], {x}[p + 2:])"
_term = "CASE WHEN w[i][t] > 0 AND w[i + 1][t] > 0 THEN s[i][t] * s[i][t] / w[i][t] + s[i + 1][t] * s[i + 1][t] / w[i + 1][t] - (s[i][t] + s[i + 1][t]) * (s[i][t] + s[i + 1][t]) / (w[i][t] + w[i + 1][t]) ELSE 0 END"


@query(
    f"{R}, h AS (SELECT CAST(l_quantity AS INT) AS q, {DB} AS d, sum(weight * exp(score)) AS h FROM book GROUP BY 1, 2),"
    f" t AS (SELECT q, d, coalesce(h, 0) AS h, {BUMPY.format(q='q', d='d')} AS v FROM range(1, 51) a(q) CROSS JOIN range(1, 5) b(d) LEFT JOIN h USING (q, d)),"
    " l AS (SELECT list(w ORDER BY q) AS w, list(s ORDER BY q) AS s, list(q ORDER BY q) AS e FROM (SELECT q, list(h ORDER BY d) AS w, list(h * v ORDER BY d) AS s FROM t GROUP BY q)),"
    f" g AS (SELECT w, s, e FROM l UNION ALL SELECT {_fold('w')}, {_fold('s')}, list_concat(e[1:p - 1], e[p + 1:]) FROM (SELECT *, list_position(costs, list_min(costs)) AS p FROM"
    f" (SELECT *, list_transform(range(1, len(w)), lambda i: list_sum(list_transform(range(1, 5), lambda t: {_term}))) AS costs FROM g WHERE len(w) > {CUTS + 1}))),"
    f" f AS (SELECT e[1:{CUTS}] AS cuts FROM g WHERE len(w) = {CUTS + 1})"
    " SELECT CAST(1 + len(list_filter(cuts, lambda c: c < CAST(l_quantity AS INT))) AS INT) AS band, CAST(min(l_quantity) AS INT) AS lowest, CAST(max(l_quantity) AS INT) AS highest, count(*) AS n FROM book, f GROUP BY 1",
    False,
)
def band_master_cuts(spark, d):
    """The five most important cuts of one feature of a pair table, by merging neighbours at the least loss of variance."""
    q, s = F.col("l_quantity").cast("int"), X.bin_index(F.col("l_discount"), DISCOUNT)
    rows = book(spark, d).select(q.alias("q"), s.alias("d"), (F.col("weight") * F.exp("score")).alias("h"))
    weights, values = np.zeros((51, 5)), np.zeros((51, 5))
    for r in rows.groupBy("q", "d").agg(F.sum("h").alias("h")).collect():  # a row for each cell of the table
        weights[r["q"], r["d"]] = r["h"]
    at, by = np.indices((51, 5))
    values = (at * at * 3 + at * by * 5) % 29 / 10 + at / 25
    bands = banding.band_of(51, banding.master_cuts(weights, weights * values)[:CUTS])
    found = rows.select("q", _cell_value(bands, [F.col("q")]).cast("int").alias("band"))
    return found.groupBy("band").agg(F.min("q").alias("lowest"), F.max("q").alias("highest"), F.count("*").alias("n"))


# --- boxes ---------------------------------------------------------------------------------------------------

SIZE = [10.0, 20.0, 30.0, 40.0]
AXES = {"l_quantity": QUANTITY, "l_discount": DISCOUNT, "l_tax": TAX, "p_size": SIZE}
#: value, and the side (lo, hi, missing) on each of the four features.
FOUR = [(0.8, [(1, 2, True), (2, 4, False), (1, 1, True), (3, 5, False)]), (-0.5, [(2, 5, False), (1, 3, True), (2, 3, False), (1, 2, True)]), (0.3, [(3, 3, False), (1, 1, False), (1, 4, False), (2, 4, True)])]
_BINS = {n: _bin_sql(n, b) for n, b in AXES.items()}
FOUR_SQL = (
    ", r AS (SELECT weight, " + ", ".join(f"{b} AS b{k}" for k, b in enumerate(_BINS.values())) + " FROM book),"
    " m AS (" + " UNION ALL ".join(f"SELECT {k} AS axis, b{k} AS bin, sum(weight) / (SELECT sum(weight) FROM r) AS share FROM r GROUP BY b{k}" for k in range(4)) + "),"
    " x(box, axis, lo, hi, miss, v) AS (VALUES " + ", ".join(f"({n}, {k}, {s[0]}, {s[1]}, {str(s[2]).lower()}, CAST({v} AS DOUBLE))" for n, (v, sides) in enumerate(FOUR) for k, s in enumerate(sides)) + "),"
    " held AS (SELECT box, x.axis, bin, share, CASE WHEN bin = 0 THEN miss ELSE bin BETWEEN lo AND hi END AS inside FROM x JOIN m ON x.axis = m.axis),"
    " p AS (SELECT box, axis, sum(CASE WHEN inside THEN share ELSE 0 END) AS p FROM held GROUP BY 1, 2)"
)


def _four(spark, d):
    """The book's bins of four features, and the effect of the fixed boxes under its margins."""
    rows = book(spark, d).select("weight", *[X.bin_index(F.col(n), b).cast("int").alias(f"b{k}") for k, (n, b) in enumerate(AXES.items())])
    measure = [np.zeros(len(b) + 2) for b in AXES.values()]
    for r in cooccur.cell_sums(rows, [F.col(f"b{k}") for k in range(4)], {"w": F.col("weight")}).collect():  # a row for each bin
        measure[r["t"]][r["c"]] = r["w"]
    return rows, boxes.Effect((0, 1, 2, 3), {tuple(sides): v for v, sides in FOUR}, measure), measure


@query(
    FOUR_SQL + ", s AS (SELECT b0, weight, " + " + ".join(f"{v} * " + " * ".join(f"(CASE WHEN (CASE WHEN b{k} = 0 THEN {str(s[2]).lower()} ELSE b{k} BETWEEN {s[0]} AND {s[1]} END) THEN 1 ELSE 0 END - (SELECT p FROM p WHERE box = {n} AND axis = {k}))" for k, s in enumerate(sides)) for n, (v, sides) in enumerate(FOUR)) + " AS effect FROM r)"
    " SELECT b0 AS qty_bin, round(sum(weight * effect), 5) AS total, round(sum(weight * effect * effect), 5) AS squares FROM s GROUP BY b0"
)
def boxes_four_way_effect(spark, d):
    """A centred effect of four features, held as boxes, on all rows."""
    rows, effect, _ = _four(spark, d)
    scored = rows.select("b0", "weight", boxes.effect_value(effect, [F.col(f"b{k}") for k in range(4)]).alias("x"))
    return _round(scored.groupBy(F.col("b0").alias("qty_bin")).agg(F.sum(F.col("weight") * F.col("x")).alias("total"), F.sum(F.col("weight") * F.col("x") * F.col("x")).alias("squares")), 5, "total", "squares")


@query(
    FOUR_SQL + ", c AS (SELECT a.box AS i, b.box AS j, a.axis, sum(CASE WHEN a.inside AND b.inside THEN a.share ELSE 0 END) AS both FROM held a JOIN held b ON a.axis = b.axis AND a.bin = b.bin GROUP BY ALL),"
    " f AS (SELECT i, j, product(c.both - p.p * q.p) AS f FROM c JOIN p ON p.box = i AND p.axis = c.axis JOIN p q ON q.box = j AND q.axis = c.axis GROUP BY 1, 2),"
    " v AS (SELECT DISTINCT box, v FROM x) SELECT (SELECT count(*) FROM book) AS n, round(sum(a.v * b.v * f), 8) AS variance FROM f JOIN v a ON a.box = i JOIN v b ON b.box = j"
)
def boxes_variance(spark, d):
    """The variance of that effect under the product of the margins, box by box, without a table of its cells."""
    rows, effect, measure = _four(spark, d)
    return rows.agg(F.count("*").alias("n")).withColumn("variance", F.round(F.lit(effect.variance(measure)), 8))


# --- bins, sampling, dropout and momentum --------------------------------------------------------------------

HEAVY = "CAST(CASE WHEN l_linenumber > 1 THEN 0 ELSE l_quantity + CAST(l_suppkey % 4 AS DOUBLE) / 4 END AS FLOAT)"
_mass = "(c[{0}] - CASE WHEN {1} > 1 THEN c[{1} - 1] ELSE 0 END)"


@query(
    f"{R}, v AS (SELECT {HEAVY} AS v, sum(weight) AS w FROM book GROUP BY 1), s AS (SELECT v, w, sum(w) OVER (ORDER BY v) AS c FROM v), t AS (SELECT sum(w) AS total, count(*) AS n FROM v),"
    " q AS (SELECT DISTINCT border FROM (SELECT k, min(v) AS border FROM s, t, range(1, 12) r(k) WHERE c >= CAST(k AS DOUBLE) / 12 * total GROUP BY k)),"
    " l AS (SELECT list(v ORDER BY v) AS v, list(c ORDER BY v) AS c FROM s),"
    " e AS (SELECT list(n ORDER BY n) AS e FROM (SELECT count(*) AS n FROM s, q WHERE v <= border GROUP BY border UNION SELECT n FROM t)),"
    " g AS (SELECT list_transform(range(1, len(e) + 1), lambda i: {'lo': CASE WHEN i > 1 THEN e[i - 1] ELSE 0 END + 1, 'hi': e[i]}) AS p, (SELECT list(CAST(border AS FLOAT) ORDER BY border) FROM q) AS b FROM e UNION ALL"
    " SELECT list_concat(p[1:k - 1], [{'lo': p[k].lo, 'hi': m}, {'lo': m + 1, 'hi': p[k].hi}], p[k + 1:]), list_append(b, CASE WHEN CAST((CAST(v[m] AS DOUBLE) + CAST(v[m + 1] AS DOUBLE)) / 2 AS FLOAT) >= v[m + 1] THEN v[m] ELSE CAST((CAST(v[m] AS DOUBLE) + CAST(v[m + 1] AS DOUBLE)) / 2 AS FLOAT) END) FROM"
    f" (SELECT *, list_min(list_concat(list_filter(range(p[k].lo, p[k].hi), lambda r: {_mass.format('r', 'p[k].lo')} >= {_mass.format('p[k].hi', 'p[k].lo')} / 2), [p[k].hi - 1])) AS m FROM"
    f" (SELECT *, list_position(mass, list_max(mass)) AS k FROM (SELECT p, b, v, c, list_transform(p, lambda x: CASE WHEN x.hi > x.lo THEN {_mass.format('x.hi', 'x.lo')} ELSE -1 END) AS mass FROM g, l WHERE len(b) < 11) WHERE list_max(mass) >= 0)))"
    " SELECT DISTINCT CAST(1 + len(list_filter(b, lambda x: x < v)) AS INT) AS bin, round(min(v) OVER p, 4) AS lowest, round(max(v) OVER p, 4) AS highest, count(*) OVER p AS n FROM"
    f" (SELECT {HEAVY} AS v, b FROM book, (SELECT b FROM g ORDER BY len(b) DESC LIMIT 1)) WINDOW p AS (PARTITION BY 1 + len(list_filter(b, lambda x: x < v)))",
    False,
)
def grid_refill(spark, d):
    """Bins of a column most of whose rows share one value: what its quantiles leave unused goes to the rest."""
    heavy = F.when(F.col("l_linenumber") > 1, F.lit(0.0)).otherwise(F.col("l_quantity") + (F.col("l_suppkey") % 4).cast("double") / 4).cast("float")
    rows = book(spark, d).select(heavy.alias("v"), "weight")
    borders = sorted(r[0] for r in binning.quantile_borders(rows, "v", "weight", 12).collect())  # at most eleven
    borders = binning.refill_borders(rows, "v", "weight", borders, 12)
    found = rows.groupBy(X.bin_index(F.col("v"), borders).cast("int").alias("bin")).agg(F.min("v").alias("lowest"), F.max("v").alias("highest"), F.count("*").alias("n"))
    return _round(found, 4, "lowest", "highest")


_DRAW = "CAST(CAST('0x' || substr(md5(concat_ws('|', '7|1', CAST(l_orderkey * 8 + l_linenumber AS VARCHAR))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496"


@query(
    ", v AS (SELECT abs(claims - mu) AS g, count(*) AS n FROM book WHERE abs(claims - mu) > 0 GROUP BY 1), c AS (SELECT g, sum(n) OVER o - n AS bn, sum(g * n) OVER o - g * n AS bs, (SELECT sum(g * n) FROM v) AS ts FROM v WINDOW o AS (ORDER BY g DESC ROWS UNBOUNDED PRECEDING)),"
    " t AS (SELECT g, (ts - bs) / (wanted - bn) AS threshold FROM c, (SELECT CAST(0.31 AS DOUBLE) * count(*) AS wanted FROM book) WHERE wanted > bn), h AS (SELECT threshold FROM t WHERE threshold >= g ORDER BY g DESC LIMIT 1),"
    f" r AS (SELECT {', '.join(KEYS)}, least(1, abs(claims - mu) / threshold) AS chance, {_DRAW} AS u FROM book, h)"
    f" SELECT {', '.join(KEYS)}, round(1 / chance, 4) AS inverse FROM r WHERE chance > 0 AND u < chance"
)
def mvs_drawn_rows(spark, d):
    """The rows that a round of boosting seeks its splits on, drawn by gradient, with their weights."""
    drawn = ensemble.drawn_rows(book(spark, d), F.col("claims") - F.col("mu"), 0.31, F.col("l_orderkey") * 8 + F.col("l_linenumber"), "7|1")
    return _round(drawn.select(*KEYS, "inverse"), 4, "inverse")


STUMPS = [("flat", [-0.3, 0.2]), ("side", [0.15, -0.1]), ("flat", [0.05, 0.4])]


def _stumps():
    bins = [X.bin_index(F.col("l_quantity"), QUANTITY), X.bin_index(F.col("l_discount"), DISCOUNT)]
    kind = {"flat": Split(0, 2, False), "side": Split(1, 2, True)}
    return bins, [Tree([kind[k]], values) for k, values in STUMPS]


@query(
    f", r AS (SELECT {LEAF} AS leaf, {FLAT} AS i, {SIDE} AS j, claims, weight, mu FROM book), s AS (SELECT leaf, claims, weight, ln(mu) + CASE WHEN i = 0 THEN -0.3 ELSE 0.2 END + CASE WHEN j = 0 THEN 0.15 ELSE -0.1 END + CASE WHEN i = 0 THEN 0.05 ELSE 0.4 END AS raw,"
    " CASE WHEN i = 0 THEN -0.3 ELSE 0.2 END + CASE WHEN i = 0 THEN 0.05 ELSE 0.4 END AS out FROM r)"
    " SELECT leaf, round(sum(weight * (exp(raw - out) - claims)), 5) AS g, round(sum(weight * exp(raw - out)), 5) AS h FROM s GROUP BY leaf"
)
def dropout_leaf_sums(spark, d):
    """What a round of boosting with dropout fits: gradients at scores that lack the trees left out."""
    bins, trees = _stumps()
    raw = sum((t.value(bins) for t in trees), F.ln("mu"))
    rows = book(spark, d).withColumn("_at", without(raw, [trees[0], trees[2]], bins))
    g, h = X.grad_hess("poisson", F.col("claims"), F.col("_at"))
    found = rows.groupBy(_leaf().alias("leaf")).agg(F.sum(F.col("weight") * g).alias("g"), F.sum(F.col("weight") * h).alias("h"))
    return _round(found, 5, "g", "h")


def _momentum_sql() -> str:
    step = lambda k, axis: f"0.5 * sum(w * (y - pt)) OVER (PARTITION BY {axis}) / (sum(w) OVER (PARTITION BY {axis}) + 1) AS v"
    first = f"m0 AS (SELECT *, {step(0, 'i')} FROM (SELECT *, f AS pt FROM (SELECT {FLAT} AS i, {SIDE} AS j, claims AS y, weight AS w, CAST(1.5 AS DOUBLE) AS f, CAST(1.5 AS DOUBLE) AS a FROM book)))"
    rest = [f"m{k} AS (SELECT *, {step(k, axis)} FROM (SELECT *, {1 - t!r} * f + {t!r} * a AS pt FROM (SELECT i, j, y, w, pt + v AS f, a + v / {u!r} AS a FROM m{k - 1})))" for k, axis, t, u in ((1, "j", 2 / 3, 1.0), (2, "i", 0.5, 2 / 3))]
    return ", " + ", ".join([first, *rest]) + " SELECT CAST(i AS INT) AS leaf_a, CAST(j AS INT) AS leaf_b, count(*) AS n, round(max(pt + v), 7) AS score FROM m2 GROUP BY 1, 2"


@query(_momentum_sql())
def momentum_rounds(spark, d):
    """Three rounds of accelerated boosting with given splits: each fits between the scores and those that run ahead."""
    bins, trees = _stumps()
    rows = book(spark, d).select("claims", "weight", *[b.alias(f"b{k}") for k, b in enumerate(bins)], F.lit(1.5).alias("raw"), F.lit(1.5).alias("ahead"))
    bins = [F.col("b0"), F.col("b1")]
    for step, tree in enumerate(trees):
        at = between(F.col("raw"), F.col("ahead"), step)
        leaf = X.leaf_index([(bins[s.axis], s.bin_le, s.missing_low) for s in tree.splits])
        g, h = X.grad_hess("squared_error", F.col("claims"), F.col("_at"))
        values = {r["leaf"]: r["value"] for r in training.leaf_values(rows.withColumn("_at", at), leaf, g, h, F.col("weight"), 1.0, 0.5).collect()}
        tree = Tree(tree.splits, [values.get(0, 0.0), values.get(1, 0.0)])
        rows = rows.withColumns(after_round(at, F.col("ahead"), tree.value(bins), step, "raw", "ahead"))
    one = lambda s: X.leaf_index([(bins[s.axis], s.bin_le, s.missing_low)]).cast("int")
    found = rows.groupBy(one(trees[0].splits[0]).alias("leaf_a"), one(trees[1].splits[0]).alias("leaf_b")).agg(F.count("*").alias("n"), F.max("raw").alias("score"))
    return _round(found, 7, "score")


# --- a fit ---------------------------------------------------------------------------------------------------

_GRID = {"l_quantity": QUANTITY, "l_discount": DISCOUNT, "l_tax": TAX}
_PLACES = ", ".join(f"({a}, {k})" for a, b in enumerate(_GRID.values()) for k in range(1, len(b) + 1))
_GAIN = "gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)"


def _level_sql(source: str, name: str) -> str:
    """The best split of a level: gains summed over leaves in which both sides have twenty rows."""
    return (
        f"{name}s AS (SELECT leaf, axis, k, sum(g) AS g, sum(h) AS h, count(*) AS n, sum(CASE WHEN [b0, b1, b2][axis + 1] <= k THEN g ELSE 0 END) AS gl, sum(CASE WHEN [b0, b1, b2][axis + 1] <= k THEN h ELSE 0 END) AS hl, count(*) FILTER ([b0, b1, b2][axis + 1] <= k) AS nl"
        f" FROM {source}, (VALUES {_PLACES}) p(axis, k) GROUP BY 1, 2, 3),"
        f" {name} AS (SELECT axis, k FROM (SELECT axis, k, sum(CASE WHEN nl >= 20 AND n - nl >= 20 THEN {_GAIN} ELSE 0 END) AS gain FROM {name}s GROUP BY 1, 2) ORDER BY gain DESC, axis, k LIMIT 1)"
    )


@query(
    f", m AS (SELECT sum(weight * claims) / sum(weight) AS mean FROM book), r AS (SELECT {QB} AS b0, {DB} AS b1, {TB} AS b2, weight * (mean - claims) AS g, weight * mean AS h, 0 AS leaf FROM book, m), {_level_sql('r', 'one')},"
    f" r2 AS (SELECT b0, b1, b2, g, h, CASE WHEN [b0, b1, b2][axis + 1] <= k THEN 1 ELSE 0 END AS leaf FROM r, one), {_level_sql('r2', 'two')},"
    " r4 AS (SELECT g, h, leaf + CASE WHEN [b0, b1, b2][axis + 1] <= k THEN 2 ELSE 0 END AS leaf FROM r2, two)"
    " SELECT CAST(leaf AS INT) AS leaf, count(*) AS n, (SELECT axis || ':' || k FROM one) || ' ' || (SELECT axis || ':' || k FROM two) AS splits, round((SELECT ln(mean) FROM m) - 0.1 * sum(g) / (sum(h) + 1), 7) AS score FROM r4 GROUP BY leaf"
)
def fit_first_tree(spark, d):
    """A fit of one tree of two levels on given grids: its splits, and what its leaves give to their rows."""
    rows = book(spark, d).select(*_GRID, "claims", "weight")
    model = fit(rows, list(_GRID), "claims", Settings(rounds=1, rate=0.1, depth=2), weight="weight", grids=(list(_GRID.values()), {}, {}))
    binned, names = model.binned(model.score(rows))
    tree = model.trees[0]
    leaf = X.leaf_index([(F.col(names[s.axis]), s.bin_le, s.missing_low) for s in tree.splits]).cast("int")
    found = binned.groupBy(leaf.alias("leaf")).agg(F.count("*").alias("n"), F.max("raw").alias("score"))
    return _round(found.withColumn("splits", F.lit(" ".join(f"{s.axis}:{s.bin_le}" for s in tree.splits))), 7, "score")
