"""Boosted oblivious trees from distributed histograms, and their exact rewriting as tables.

Rows stay in Spark: each level of a tree is one histogram job whose result has at most leaves * axes * 256 rows;
the driver only picks the split.  Scores are columns over the binned book, cut from their lineage in the shared
folder every few rounds.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from itertools import combinations, pairwise

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ExactnessError, InputValueError
from ..functions import expr as X
from ..operators import binning, encode, ensemble, training
from ..sources.book import categorical_features, select_features, validate
from ..sources.shared import delete, new_path, written


@dataclass
class Split:
    axis: int
    bin_le: int
    missing_low: bool


@dataclass
class Tree:
    splits: list[Split]
    leaves: list[float]

    def value(self, bins: list[Column]) -> Column:
        at = X.leaf_index([(bins[s.axis], s.bin_le, s.missing_low) for s in self.splits])
        return F.element_at(F.array(*map(F.lit, self.leaves)), at + 1)


@dataclass
class Settings:
    loss: str = "poisson"
    power: float = 1.5
    rounds: int = 100
    rate: float = 0.1
    depth: int = 2
    l2: float = 1.0
    max_bin: int = 64
    least_gain: float = 1e-9
    least_rows: int = 20
    holdout: float = 0.0
    patience: int = 10
    strength: float = 20.0
    #: Threshold of gradient sums, bound of a step before the rate (None: none), and rows that outweigh half of a leaf's parent (0: no smoothing).
    l1: float = 0.0
    most_step: float | None = None
    smoothing: float = 0.0
    #: Most features of a tree (0: as many as its depth), and sets of features outside of which none meet (none: all may).
    order: int = 0
    groups: list[list[str]] = field(default_factory=list)
    #: A split on a further feature has to gain this share of the tree's first split; adaptive: more for each feature beyond two, less in
    #: rounds whose first split gains less than that of the rounds before, of which each counts by ``memory`` less than the one after it.
    hurdle: float = 0.0
    adaptive: bool = False
    memory: float = 0.99
    #: Cells that a tree's features may have by the borders in use before its splits rank lower (0: any), the power and, beyond three features, the shrinkage.
    table_cells: int = 0
    table_power: float = 0.5
    table_shrink: float = 2.0
    #: Folds (of keys) whose rows do not take part in the encodings that fitting gives them; 0: all rows do.
    folds: int = 0
    #: The rate of round t is rate / (1 + decay * t).
    decay: float = 0.0
    #: Share of the features that a round may split on, drawn anew for each.
    columns: float = 1.0
    seed: int = 0
    #: Share of the rows that the splits of a round are sought on, drawn by gradient; the leaves take all rows.
    sample: float = 1.0
    sample_least: int = 1000
    #: Chance of each tree to be left out of the scores while the next one is fitted.
    dropout: float = 0.0
    #: Accelerated boosting: a second score runs ahead, and trees are fitted between the two.
    momentum: bool = False
    #: After each so many trees, all leaves so far are refitted together (0: never), with this penalty.
    refit_every: int = 0
    refit_l2: float = 1.0
    monotone: dict[str, int] = field(default_factory=dict)


@dataclass
class Model:
    settings: Settings
    features: list[str]
    borders: list[list[float]]
    #: For each text feature, the encoding of each level, or the folder of a table of them (member, encoding).
    levels: dict[str, dict[str, float] | str]
    unseen: dict[str, float]
    f0: float
    trees: list[Tree]
    history: list[float] = field(default_factory=list)

    def encoded(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        """``df``, with what it needs to number its levels, and the numeric value of each feature; unknown levels take the base.

        Few levels are constants of the plan; where there are more than MAP_LEVELS, ``levels`` names a table, which is joined.
        """
        out: list[Column] = []
        for k, name in enumerate(self.features):
            column = F.col(name)
            known = self.levels.get(name)
            if isinstance(known, str):
                table = df.sparkSession.read.parquet(known).select(F.col("member").alias(f"_member{k}"), F.col("encoding").alias(f"_encoding{k}"))
                df = df.join(table, encode.level_of(column) == F.col(f"_member{k}"), "left").drop(f"_member{k}")
                column = F.coalesce(F.col(f"_encoding{k}"), F.lit(self.unseen[name]))
            elif known is not None:
                table = F.create_map(*[x for level, v in known.items() for x in (F.lit(level), F.lit(v))]) if known else F.lit(None).cast("map<string,double>")
                column = F.coalesce(table[encode.level_of(column)], F.lit(self.unseen[name]))
            out.append(column)
        return df, out

    def binned(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """``df`` with the bin of each feature, and the names of these columns, which ``df`` does not have."""
        stem = "_b"
        while any(c.lower().startswith(stem) for c in df.columns):
            stem = "_" + stem
        names = [f"{stem}{k}" for k in range(len(self.features))]
        columns = df.columns
        df, values = self.encoded(df)
        bins = [X.bin_index(v, b) for v, b in zip(values, self.borders, strict=True)]
        return df.select(*columns, *[b.alias(n) for b, n in zip(bins, names, strict=True)]), names

    def score(self, df: DataFrame, offset: Column | None = None) -> DataFrame:
        """``df`` with raw and prediction (a rate: without offset unless given), in place of columns of these names."""
        select_features(df, self.features)
        binned, names = self.binned(df)
        raw = sum((t.value([F.col(n) for n in names]) for t in self.trees), F.lit(self.f0))
        raw = raw if offset is None else raw + offset
        scored = binned.withColumn("raw", raw).drop(*names)
        return scored.withColumn("prediction", X.inverse_link(X.LINKS[self.settings.loss], F.col("raw")))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        trees = [Tree([Split(**s) for s in t["splits"]], t["leaves"]) for t in d.pop("trees")]
        return Model(settings=Settings(**d.pop("settings")), trees=trees, **d)


#: More levels than this are kept as a table in place of a map.
MAP_LEVELS = 5_000


def _grids(df: DataFrame, features: list[str], y: str, weight: str, exposure: str, s: Settings):
    texts = categorical_features(df, features)
    borders, levels, unseen = [], {}, {}
    for name in features:
        if name in texts:
            found, levels[name] = _levels(df, name, y, weight, exposure, s)
            unseen[name] = encode.base_rate(df, y, weight, exposure).first()[0]
        else:
            sums = binning.value_sums(df, name, weight)
            few = [r["v"] for r in sums.select("v").limit(s.max_bin + 1).collect()]
            if len(few) <= s.max_bin:
                found = [binning.separating_border(a, b) for a, b in pairwise(sorted(few))]
            else:
                found = sorted(r[0] for r in binning.quantile_borders(df, name, weight, s.max_bin, sums).collect())  # fewer than max_bin
                found = binning.refill_borders(df, name, weight, found, s.max_bin, sums)
        borders.append(found)
    return borders, levels, unseen


def _levels(df: DataFrame, name: str, y: str, weight: str, exposure: str, s: Settings) -> tuple[list[float], dict[str, float] | str]:
    """The borders of a text feature's encodings, and these by level: a map of a few, or a written table of many."""
    encoded = encode.fixed_encoding(df, name, y, weight, exposure, s.strength)
    some = encoded.limit(MAP_LEVELS + 1).collect()
    if len(some) > MAP_LEVELS:
        path = new_path(df.sparkSession, "levels")
        table = written(encoded.select("member", "encoding"), path)
        even = table.select("encoding", F.lit(1.0).alias("one"))
        return sorted(r[0] for r in binning.quantile_borders(even, "encoding", "one", s.max_bin).collect()), path
    known = {r["member"]: r["encoding"] for r in sorted(some, key=lambda r: (-r["encoding"], r["member"]))}
    values = np.unique(np.array(list(known.values()), np.float32))
    # Ranks are dealt evenly to the bins, as in encode.rank_bins.
    dealt = np.arange(len(values)) * min(s.max_bin, len(values)) // max(len(values), 1)
    return ((values[1:].astype(float) + values[:-1]) / 2)[np.diff(dealt) > 0].tolist(), known


def _out_of_fold(rows: DataFrame, model: Model, s: Settings) -> tuple[DataFrame, list[Column]]:
    """Values of the features for fitting: a row's levels are encoded without the rows of its own fold (held-out rows: as in serving)."""
    held, values = model.encoded(rows)
    train = rows.where(~F.col("_out"))
    for k, name in enumerate(model.features):
        if name in model.levels:
            fold = encode.kfold_encoding(train, name, "_y", "_w", "_e", "_part", s.strength)
            fold = fold.select(F.col("level").alias(f"_level{k}"), F.col("_part").alias(f"_of{k}"), F.col("encoding").alias(f"_without{k}"))
            held = held.join(fold, (encode.level_of(F.col(name)) == F.col(f"_level{k}")) & (F.col("_part") == F.col(f"_of{k}")), "left")
            values[k] = F.when(F.col("_out"), values[k]).otherwise(F.coalesce(F.col(f"_without{k}"), F.lit(model.unseen[name])))
    return held, values


def _steps(sums: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Step and twice the gain of sums (g, h, ...), with threshold and bound: the rules of ``expr.newton_step`` and ``newton_gain``."""
    g, h = sums[..., 0], sums[..., 1] + s.l2
    soft = np.sign(g) * np.maximum(np.abs(g) - s.l1, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        step = np.where(h > 0, -soft / h, 0.0)
    if s.most_step is not None:
        step = np.clip(step, -s.most_step, s.most_step)
    return step, np.maximum(0.0, -2 * soft * step - h * step * step)


def _pick(hist: list, axes: list[int], s: Settings, signs: dict[int, int], least: float = 0.0, rank=None) -> tuple[float, Split, float] | None:
    """Gain, split and ranking gain of the best split over all leaves; ties go to the lowest axis, then bin, then missing high.

    Only gains of at least ``least`` count; ``rank(axis, bin)`` weighs them against each other, not against ``least``.
    """
    spots = {leaf: k for k, leaf in enumerate(sorted({r["leaf"] for r in hist}))}
    best, chosen = 0.0, None
    for axis in axes:
        rows = [r for r in hist if r["axis"] == axis]
        top = max((r["bin"] for r in rows), default=0)
        sums = np.zeros((len(spots), top + 1, 3))
        for r in rows:
            sums[spots[r["leaf"]], r["bin"]] += (r["g"], r["h"], r["n"])
        total = sums.sum(axis=1)[:, None, None]
        shown = sums.copy()
        shown[:, 0] = 0.0
        upto = shown.cumsum(axis=1)[:, : max(top, 1)]
        # Leaf, bin_le, missing low or not, sums; bin_le 0 with missing low is missing against present.
        low = np.stack([upto, upto + sums[:, :1]], axis=2)
        high = total - low
        sound = np.minimum(low[..., 2], high[..., 2]) >= s.least_rows
        (down, low_gain), (up, high_gain), (_, whole) = _steps(low, s), _steps(high, s), _steps(total, s)
        gains = np.where(sound, low_gain + high_gain - whole, 0.0).sum(axis=0)
        against = sound & (signs.get(axis, 0) * (down - up) > 0)
        usable = sound.any(axis=0) & (gains > s.least_gain) & (gains >= least)
        usable[1:] &= ~against[:, 1:].any(axis=0)
        usable[0, 0] = False
        for bin_le, miss in np.argwhere(usable):
            gain = float(gains[bin_le, miss])
            weighed = gain * (rank(axis, int(bin_le)) if rank else 1.0)
            if weighed > best * (1 + 1e-12):
                best, chosen = weighed, (gain, Split(axis, int(bin_le), bool(miss)), weighed)
    return chosen


class Growth:
    """What the trees so far say about the next: the gains of first splits and the borders in use."""

    def __init__(self, features: list[str], s: Settings):
        self.s, self.first, self.borders = s, None, {}
        self.groups = [{features.index(f) for f in g if f in features} for g in s.groups]

    def admits(self, used: set[int], axis: int) -> bool:
        """Whether a tree on the features ``used`` may take a further one."""
        most = self.s.order or self.s.depth
        return len(used) < most and (not self.groups or any(used | {axis} <= g for g in self.groups))

    def floor(self, n_used: int, gains: list[float]) -> float:
        """The least gain of a split on one more feature than the ``n_used`` of a tree whose splits gained ``gains``."""
        s = self.s
        if s.hurdle <= 0 or not gains:
            return 0.0
        if not s.adaptive:
            return s.hurdle * gains[0]
        known = self.first if self.first else gains[0]
        pressure = 0.25 + 0.75 * np.sqrt(min(1.0, gains[0] / known)) if known > 0 else 1.0
        floor = s.hurdle * 2.0 ** (n_used - 1) * pressure * gains[0]
        # From the third feature on, the split before is a measure too.
        return max(floor, s.hurdle * pressure * gains[-1]) if n_used >= 2 and gains[-1] > 0 else floor

    def rank(self, used: set[int]):
        """The weight of a split's gain by the cells that the tree's features would have."""
        s = self.s
        if not s.table_cells:
            return None

        def weight(axis: int, bin_le: int) -> float:
            features = used | {axis}
            room = max(1.0, s.table_cells / s.table_shrink ** max(0, len(features) - 3))
            cells = float(np.prod([2 + len(self.borders.get(a, set()) | ({bin_le} if a == axis else set())) for a in features]))
            return 1.0 if cells <= room else (room / cells) ** s.table_power

        return weight

    def grown(self, splits: list[Split], gains: list[float]) -> None:
        if gains:
            self.first = max(gains[0], (self.first or 0.0) * self.s.memory)
        for x in splits:
            self.borders.setdefault(x.axis, set()).add(x.bin_le)


def fit(df: DataFrame, features: list[str], y: str, settings: Settings | None = None, weight: str | None = None, exposure: str | None = None, key: str | None = None, held: Column | None = None, grids: tuple | None = None) -> Model:
    """Fit an ensemble to a book of rows.

    With ``settings.holdout``, rows with the least hashes of ``key`` are held out (or those where ``held`` is true),
    and fitting stops after ``patience`` rounds without a better deviance there; the model keeps the best round.
    ``grids`` are the borders and encodings of another model of the same features.
    """
    s = settings or Settings()
    validate(df, y, weight, exposure, positive=s.loss == "gamma")
    w, e = F.col(weight).cast("double") if weight else F.lit(1.0), F.col(exposure).cast("double") if exposure else F.lit(1.0)
    out = held
    if out is None:
        out = (F.pmod(F.xxhash64(F.col(key)), F.lit(10_000)) < int(s.holdout * 10_000)) if key and s.holdout else F.lit(False)
    watched = held is not None or bool(s.holdout and key)
    if s.sample < 1 and key is None:
        raise InputValueError("sampling needs a key")
    if s.momentum and (s.dropout or s.refit_every):
        raise InputValueError("momentum goes with neither dropout nor refits")
    if s.folds and key is None:
        raise InputValueError("folds need a key")
    keys = [F.col(key).alias("_key")] if s.sample < 1 else []
    keys += [F.pmod(F.xxhash64(F.lit(s.seed), F.lit("fold"), F.col(key)), F.lit(s.folds)).alias("_part")] if s.folds else []
    rows = df.select(*features, F.col(y).cast("double").alias("_y"), w.alias("_w"), e.alias("_e"), out.alias("_out"), *keys)
    rows = rows.persist()  # read once, for grids and bins
    train = rows.where(~F.col("_out"))
    borders, levels, unseen = grids or _grids(train, features, "_y", "_w", "_e", s)
    log = X.LINKS[s.loss] == "log"
    # With exposure e, the constant that zeroes the gradient: sum(w y e^(1-p)) / sum(w e^(2-p)).
    p = {"gamma": 2.0, "tweedie": s.power}.get(s.loss, 1.0)
    ratio = F.sum(F.col("_w") * F.col("_y") * (F.pow("_e", F.lit(1 - p)) if log else 1)) / F.sum(F.col("_w") * (F.pow("_e", F.lit(2 - p)) if log else 1))
    f0 = train.agg(X.initial_score(s.loss, ratio)).first()[0]
    model = Model(s, features, borders, levels, unseen, float(f0), [])
    offset = F.ln("_e") if log else F.lit(0.0)
    names = [f"_b{k}" for k in range(len(features))]
    held_rows, values = _out_of_fold(rows, model, s) if s.folds else model.encoded(rows)
    binned = held_rows.select(*[X.bin_index(v, b).cast("short").alias(n) for v, b, n in zip(values, borders, names, strict=True)], "_y", "_w", "_out", *(["_key"] if s.sample < 1 else []), (F.lit(f0) + offset).alias("_base")).withColumns({"_raw": F.col("_base"), "_ahead": F.col("_base")})
    binned = binned.persist()
    bins = [F.col(n) for n in names]
    signs = {features.index(k): v for k, v in s.monotone.items()}
    deviance = "binomial" if s.loss == "logistic" else s.loss
    best, since, base, cuts = np.inf, 0, binned, _Cuts(df.sparkSession)
    grown, shares = [], np.zeros(0)  # trees as fitted, and their shares in the scores with momentum
    ahead, kept, growth = np.zeros(0), [], Growth(features, s)
    for step in range(s.rounds):
        rate = s.rate / (1 + s.decay * step)
        dropped = dropped_trees(len(model.trees), s.dropout, s.seed, step)
        theta = 2 / (step + 2)
        at = without(F.col("_raw"), [model.trees[k] for k in dropped], bins)
        if s.momentum:
            at = between(F.col("_raw"), F.col("_ahead"), step)
        g, h = X.grad_hess(s.loss, F.col("_y"), F.col("_at"), s.power)
        fitted = binned.withColumn("_at", at).where(~F.col("_out"))
        drawn = np.random.default_rng([s.seed, step]).permutation(len(bins))[: max(1, round(s.columns * len(bins)))]
        some, w_some = fitted, F.col("_w")
        if s.sample < 1:
            some, w_some = ensemble.drawn_rows(fitted, F.col("_w") * g, s.sample, F.col("_key"), f"{s.seed}|{step}", s.sample_least), F.col("_w") * F.col("inverse")
        splits = _grow(some, bins, sorted(drawn.tolist()), s, signs, g, h, w_some, growth)
        if not splits:
            break
        leaf = X.leaf_index([(bins[x.axis], x.bin_le, x.missing_low) for x in splits])
        leaves = training.newton_leaves(fitted, leaf, g, h, F.col("_w"), s.l2, s.l1, rate, s.most_step)
        if s.smoothing:
            leaves = training.path_smoothed(leaves, len(splits), s.smoothing, s.l2, s.l1, rate, s.most_step)
        values = {r["leaf"]: r["value"] for r in leaves.collect()}
        tree = Tree(splits, [float(values.get(k, 0.0)) for k in range(1 << len(splits))])
        if s.momentum:
            binned = binned.withColumns(after_round(at, F.col("_ahead"), tree.value(bins), step, "_raw", "_ahead"))
            grown.append(tree)
            shares, ahead = np.append((1 - theta) * shares + theta * ahead, 1.0), np.append(ahead, 1 / theta)
            model.trees = [scaled(t, a) for t, a in zip(grown, shares, strict=True)]
        elif dropped:
            # The new tree and those left out share their weight, so that the sum does not overshoot.
            k = len(dropped)
            tree = scaled(tree, 1 / (k + 1))
            for i in dropped:
                model.trees[i] = scaled(model.trees[i], k / (k + 1))
            binned = binned.withColumn("_raw", sum((model.trees[i].value(bins) for i in dropped), at) + tree.value(bins))
            model.trees.append(tree)
        else:
            binned = binned.withColumn("_raw", F.col("_raw") + tree.value(bins))
            model.trees.append(tree)
        if s.refit_every and (step + 1) % s.refit_every == 0:
            binned = _refitted(binned, model, bins)
        if step % 10 == 9 or dropped or (s.momentum and step % 3 == 2):
            binned = cuts.cut(binned)
        kept.append([Tree(t.splits, t.leaves) for t in model.trees] if watched and (s.dropout or s.momentum or s.refit_every) else None)
        if watched:
            mu = X.inverse_link(X.LINKS[s.loss], F.col("_raw"))
            now = binned.where("_out").agg(F.sum(F.col("_w") * X.unit_deviance(deviance, F.col("_y"), mu, s.power)) / F.sum("_w")).first()[0]
            model.history.append(now)
            best, since = (now, 0) if now < best else (best, since + 1)
            if since >= s.patience:
                break
    if model.history:
        last = int(np.argmin(model.history))
        # Where later rounds change earlier trees, those of the best round were kept.
        model.trees = kept[last] if kept[last] is not None else model.trees[: last + 1]
    base.unpersist()
    rows.unpersist()
    cuts.clear()
    return model


def _grow(rows: DataFrame, bins: list[Column], axes: list[int], s: Settings, signs: dict[int, int], g: Column, h: Column, w: Column, growth: Growth) -> list[Split]:
    """The splits of one tree, a histogram for each level.

    A further feature has to rank above the best split on those of the tree, and to pass order, groups and hurdle.
    """
    splits: list[Split] = []
    gains: list[float] = []
    for _ in range(s.depth):
        leaf = X.leaf_index([(bins[x.axis], x.bin_le, x.missing_low) for x in splits])
        used = {x.axis for x in splits}
        fresh = [a for a in axes if a not in used and growth.admits(used, a)]
        seen = [a for a in axes if a in used or a in fresh]
        hist = training.gradient_histogram(rows, leaf, {a: bins[a] for a in seen}, g, h, w).collect() if seen else []
        rank = growth.rank(used)
        found = [_pick(hist, [a for a in seen if a in used], s, signs, 0.0, rank), _pick(hist, fresh, s, signs, growth.floor(len(used), gains), rank)]
        best = max((x for x in found if x), key=lambda x: x[2], default=None)  # of equal ones the first
        if best is None:
            break
        gains.append(best[0])
        splits.append(best[1])
    growth.grown(splits, gains)
    return splits


def dropped_trees(n: int, chance: float, seed: int, step: int) -> list[int]:
    """Which of ``n`` trees a round leaves out; drawn anew for each."""
    return np.flatnonzero(np.random.default_rng([seed, step, 1]).random(n) < chance).tolist() if chance else []


def without(raw: Column, trees: list[Tree], bins: list[Column]) -> Column:
    """Scores without some of the trees in them."""
    return raw - sum((t.value(bins) for t in trees), F.lit(0.0)) if trees else raw


def between(raw: Column, ahead: Column, step: int) -> Column:
    """The scores that round ``step`` (0, 1, ...) of accelerated boosting is fitted at."""
    theta = 2 / (step + 2)
    return (1 - theta) * raw + theta * ahead


def after_round(at: Column, ahead: Column, value: Column, step: int, raw_name: str, ahead_name: str) -> dict[str, Column]:
    """Both scores after a round whose tree has the value ``value``."""
    return {raw_name: at + value, ahead_name: ahead + value / (2 / (step + 2))}


def scaled(tree: Tree, share: float) -> Tree:
    return Tree(tree.splits, [v * share for v in tree.leaves])


def _refitted(binned: DataFrame, model: Model, bins: list[Column]) -> DataFrame:
    """``binned`` with the scores of the model after all its leaves were refitted on the rows that are not held out."""
    from . import refit

    leaves, sizes = refit.leaf_numbers(model.trees, bins)
    path = new_path(binned.sparkSession, "leaves")
    rows = written(binned.where(~F.col("_out")).select(leaves.alias("leaves"), F.col("_base").alias("base"), F.col("_y").alias("y"), F.col("_w").alias("w")), path)
    values, _ = refit.refit_values(rows, sizes, np.concatenate([np.array(t.leaves, float) for t in model.trees]), model.settings, model.settings.refit_l2, passes=2)
    delete(binned.sparkSession, path)
    model.trees = refit.with_values(model.trees, values)
    return binned.withColumn("_raw", F.col("_base") + sum((t.value(bins) for t in model.trees), F.lit(0.0)))


def in_bag(key: str, bag: int, share: float, seed: int = 0) -> Column:
    """Whether a bag holds the rows of a key: a ``share`` of the keys, other ones in each bag."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(bag), F.col(key)), F.lit(1_000_000)) < round(share * 1_000_000)


def fit_bags(df: DataFrame, features: list[str], y: str, settings: Settings | None = None, weight: str | None = None, exposure: str | None = None, key: str = "id", bags: int = 8, share: float = 0.8) -> tuple[Model, list[Model]]:
    """The mean of ``bags`` models and the models themselves, each fitted to a share of the keys and stopped on the others.

    All take the grids and encodings of the whole book, so that the mean of their trees is the mean of their scores.
    Rows with the same key are in the same bags.
    """
    s = settings or Settings()
    w, e = F.col(weight).cast("double") if weight else F.lit(1.0), F.col(exposure).cast("double") if exposure else F.lit(1.0)
    whole = df.select(*features, F.col(y).cast("double").alias("_y"), w.alias("_w"), e.alias("_e"))
    validate(df, y, weight, exposure, positive=s.loss == "gamma")
    grids = _grids(whole, features, "_y", "_w", "_e", s)
    models = [fit(df, features, y, s, weight, exposure, held=~in_bag(key, b, share, s.seed), grids=grids) for b in range(bags)]
    trees = [Tree(t.splits, [v / bags for v in t.leaves]) for m in models for t in m.trees]
    return Model(s, features, *grids, sum(m.f0 for m in models) / bags, trees), models


class _Cuts:
    """Tables in the folder of spark.checkpoint.dir that cut the lineage of scores; only the last one stays, until it is cleared."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, None

    def cut(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, "round")
        out = written(df, path)
        self.clear()
        self.path = path
        return out

    def clear(self) -> None:
        if self.path:
            delete(self.spark, self.path)
        self.path = None


Tables = dict[tuple[int, ...], np.ndarray]


def to_tables(model: Model) -> Tables:
    """Dense tables over bins, one for each set of features that a tree uses; their sum plus f0 is the model."""
    out: Tables = {}
    for t in model.trees:
        axes = tuple(sorted({s.axis for s in t.splits}))
        shape = [len(model.borders[a]) + 2 for a in axes]
        grid = np.indices(shape)
        at = np.zeros(shape, int)
        for level, s in enumerate(t.splits):
            b = grid[axes.index(s.axis)]
            at |= np.where(b == 0, s.missing_low, b <= s.bin_le).astype(int) << level
        out[axes] = out.get(axes, 0.0) + np.array(t.leaves)[at]
    return out


def purify(tables: Tables, weights: list[np.ndarray]) -> tuple[float, Tables]:
    """Constant and tables whose weighted mean over each axis is zero; the sum over all is unchanged."""
    work = {k: v.copy() for k, v in tables.items()}
    for k in list(work):
        for r in range(1, len(k)):
            for sub in combinations(k, r):
                work.setdefault(sub, np.zeros([len(weights[a]) for a in sub]))
    constant = 0.0
    for axes in sorted(work, key=lambda k: (-len(k), k)):
        table = work[axes]
        for axis in axes:
            p = weights[axis] / weights[axis].sum()
            at = axes.index(axis)
            mean = np.tensordot(table, p, ([at], [0]))
            table = table - np.expand_dims(mean, at)
            rest = tuple(a for a in axes if a != axis)
            if rest:
                work[rest] = work[rest] + mean
            else:
                constant += float(mean)
        work[axes] = table
    return constant, work


def axis_weights(df: DataFrame, model: Model, weight: str | None = None, laplace: float = 1.0) -> list[np.ndarray]:
    """Mass of each bin of each feature, in one pass, smoothed by ``laplace``."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    binned, names = model.binned(df)
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), F.col(n).cast("int").alias("bin")) for k, n in enumerate(names)]))
    rows = binned.select(w.alias("w"), cells.alias("c")).groupBy("c.axis", "c.bin").agg(F.sum("w").alias("w")).collect()
    out = [np.full(len(b) + 2, float(laplace)) for b in model.borders]
    for r in rows:
        out[r["axis"]][r["bin"]] += r["w"]
    return out


def table_frame(spark: SparkSession, model: Model, tables: Tables) -> DataFrame:
    """table_id, features, cells, value: the tables as rows."""
    rows = [(":".join(model.features[a] for a in k), [model.features[a] for a in k], [int(i) for i in at], float(v)) for k, t in tables.items() for at, v in np.ndenumerate(t)]
    return spark.createDataFrame(rows, "table_id string, features array<string>, cells array<int>, value double")


def _cell_value(table: np.ndarray, bins: list[Column]) -> Column:
    at: Column = F.lit(0)
    for b, size in zip(bins, table.shape, strict=True):
        at = at * size + b
    return F.element_at(F.array(*[F.lit(float(v)) for v in table.ravel()]), at + 1)


def score_tables(df: DataFrame, model: Model, constant: float, tables: Tables) -> DataFrame:
    """``df`` with raw and prediction from the tables alone."""
    binned, names = model.binned(df)
    raw = F.lit(model.f0 + constant)
    for axes, t in tables.items():
        raw = raw + _cell_value(t, [F.col(names[a]) for a in axes])
    scored = binned.withColumn("raw", raw).drop(*names)
    return scored.withColumn("prediction", X.inverse_link(X.LINKS[model.settings.loss], F.col("raw")))


def check_exact(df: DataFrame, model: Model, constant: float, tables: Tables, tolerance: float = 1e-9) -> float:
    """The largest gap between model and tables over the rows; an error if it exceeds the tolerance."""
    a = model.score(df).select(*model.features, F.col("raw").alias("model:raw"))
    gap = score_tables(a, model, constant, tables).agg(F.max(F.abs(F.col("raw") - F.col("`model:raw`")))).first()[0] or 0.0
    if gap > tolerance:
        raise ExactnessError(f"tables differ from the model by {gap}")
    return gap


def band_table(values: np.ndarray, weights: np.ndarray, budget: float) -> list[int]:
    """Bands of a one-way table: neighbours merge greedily while the weighted squared error stays in the budget.

    Cell 0 (missing) stays alone.  Returns the band of each cell.
    """
    groups = [[k] for k in range(1, len(values))]
    cost = lambda g: float(np.sum(weights[g] * (values[g] - np.average(values[g], weights=weights[g])) ** 2)) / weights.sum()
    spent = 0.0
    while len(groups) > 1:
        rise = [cost(a + b) - cost(a) - cost(b) for a, b in zip(groups[:-1], groups[1:], strict=True)]
        k = int(np.argmin(rise))
        if spent + rise[k] > budget:
            break
        spent += rise[k]
        groups[k : k + 2] = [groups[k] + groups[k + 1]]
    bands = [0] * len(values)
    for band, g in enumerate(groups, 1):
        for cell in g:
            bands[cell] = band
    return bands


def graduate(values: np.ndarray, weights: np.ndarray, strength: float, order: int = 2) -> np.ndarray:
    """Whittaker-Henderson smoothing of the cells 1, 2, ...; cell 0 (missing) is kept."""
    v, w = values[1:], weights[1:]
    if len(v) <= order:
        return values.copy()
    d = np.diff(np.eye(len(v)), order, axis=0)
    return np.concatenate([values[:1], np.linalg.solve(np.diag(w) + strength * d.T @ d, w * v)])


def monotone_repair(values: np.ndarray, weights: np.ndarray, sign: int) -> np.ndarray:
    """Weighted isotonic regression of the cells 1, 2, ... (pool adjacent violators); cell 0 is kept."""
    blocks: list[list[float]] = []
    for v, w in zip(sign * values[1:], weights[1:], strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([values[:1], sign * np.repeat([b[0] for b in blocks], [b[2] for b in blocks])])


def prune_tables(df: DataFrame, model: Model, constant: float, tables: Tables, y: str, weight: str, least_gain: float) -> Tables:
    """Tables without those whose removal raises the mean deviance by less than ``least_gain``, one pass for all."""
    deviance = "binomial" if model.settings.loss == "logistic" else model.settings.loss
    link, w = X.LINKS[model.settings.loss], F.col(weight).cast("double")
    scored, names = model.binned(score_tables(df, model, constant, tables))

    def cost(raw: Column) -> Column:
        return F.sum(w * X.unit_deviance(deviance, F.col(y), X.inverse_link(link, raw), model.settings.power)) / F.sum(w)

    costs = scored.agg(cost(F.col("raw")), *[cost(F.col("raw") - _cell_value(t, [F.col(names[a]) for a in k])) for k, t in tables.items()]).first()
    return {k: t for (k, t), c in zip(tables.items(), costs[1:], strict=True) if c - costs[0] >= least_gain}
