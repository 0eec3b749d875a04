"""Training, cross-validation and walk-forward jobs on the engineered panel.

Shape of every job: scan -> one Gram aggregation keyed by (fold | month | nothing) ->
driver solves d x d systems -> coefficients come back as literals or a small broadcast
table -> scoring and metrics are Spark expressions and aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import linear as LN
from ..operators import metrics as M
from ..operators.ranks import numbered
from ..operators.whatif import hashed_uniform
from ..spec import DEFAULT_SPEC, PanelSpec

FIT_SPLITS = ("train", "validation")


def _sub(g: np.ndarray, p: int, idx: list[int], q: int) -> np.ndarray:
    keep = [0] + [1 + i for i in idx] + [1 + p + t for t in range(q)]
    return g[np.ix_(keep, keep)]


@dataclass
class GramFit:
    features: list[str]
    targets: list[str]
    gram: np.ndarray
    shift: np.ndarray

    @property
    def p(self) -> int:
        return len(self.features)

    def select(self, names: list[str]) -> "GramFit":
        idx = [self.features.index(n) for n in names]
        q = len(self.targets)
        shift = np.concatenate([self.shift[idx], self.shift[self.p :]])
        return GramFit(list(names), self.targets, _sub(self.gram, self.p, idx, q), shift)


def fit_rows(feat: DataFrame, spec: PanelSpec = DEFAULT_SPEC, splits=FIT_SPLITS) -> DataFrame:
    return feat.where(F.col(spec.split).isin(*splits))


def gram_of(df: DataFrame, features: list[str], spec: PanelSpec = DEFAULT_SPEC) -> GramFit:
    targets = list(spec.targets)
    cols = features + targets
    shift = LN.column_means(df, cols)
    g = LN.collect_grams(LN.gram_table(df, cols, shift=shift), len(cols) + 1)[()]
    return GramFit(list(features), targets, g, shift)


def feature_scores(gf: GramFit) -> list[tuple[str, float]]:
    f = LN.f_regression(gf.gram, gf.p, 0)
    return [(n, float(s)) for n, s in zip(gf.features, f)]


def select_k_best(gf: GramFit, k: int = 15) -> list[str]:
    """Top k by F against the first target; NaN scores (constant columns) rank last,
    ties by name."""
    scored = feature_scores(gf)
    key = lambda t: (-(t[1] if np.isfinite(t[1]) else -np.inf), t[0])
    return [n for n, _ in sorted(scored, key=key)[:k]]


def fit_model(gf: GramFit, kind: str = "ridge", alpha: float = 5.0, l1_ratio: float = 0.5) -> LN.LinearModel:
    return LN.fit_from_gram(gf.gram, gf.features, gf.targets, kind, alpha, l1_ratio, gf.shift)


def train(feat: DataFrame, spec: PanelSpec = DEFAULT_SPEC, k: int = 15, kind: str = "ridge", alpha: float = 5.0, l1_ratio: float = 0.5):
    """Select k features on train+validation, scale, fit (the v2.2 recipe)."""
    rows = fit_rows(feat, spec)
    all_feats = FE.feature_columns(feat, spec)
    gf = gram_of(rows, all_feats, spec)
    selected = select_k_best(gf, k)
    model = fit_model(gf.select(selected), kind, alpha, l1_ratio)
    return model, gf, selected


def predictions_wide(feat: DataFrame, model: LN.LinearModel, name: str, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    cols = [F.col(spec.entity), F.col(spec.month), F.col(spec.split).alias("dataset"), F.lit(name).alias("model")]
    pcols = model.predict_columns()
    for t, pc in zip(spec.targets, pcols):
        cols += [F.col(t).cast("double").alias(f"actual_{t}"), pc]
    return feat.select(*cols)


# --------------------------------------------------------------------------- CV


def with_folds(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, n_folds: int = 5, seed: int = 42, by_entity: bool = True) -> DataFrame:
    """``df`` with the fold of each row in ``_fold``.

    By row: a hash of entity and month, so a row lands in the same fold whatever the
    partitioning. By entity (group k-fold): entities are ranked by their number of rows and
    dealt to the folds back and forth, which balances the folds for few and for many
    entities alike and leaves none empty while there are as many entities as folds.
    """
    if not by_entity:
        u = hashed_uniform(F.col(spec.entity), F.year(spec.month) * 12 + F.month(spec.month), F.lit(seed))
        return df.withColumn("_fold", F.floor(u * n_folds).cast("int"))
    sizes = df.groupBy(spec.entity).agg((-F.count(F.lit(1))).alias("_fewer"))
    ranked = numbered(sizes, [], ["_fewer", spec.entity], "_place")
    turn, place = F.floor(F.col("_place") / n_folds), F.col("_place") % n_folds
    fold = F.when(turn % 2 == 0, place).otherwise(n_folds - 1 - place).cast("int")
    return df.join(ranked.select(spec.entity, fold.alias("_fold")), spec.entity)


def fold_grams(df: DataFrame, features: list[str], spec: PanelSpec = DEFAULT_SPEC, n_folds: int = 5, seed: int = 42, by_entity: bool = True):
    targets = list(spec.targets)
    cols = features + targets
    shift = LN.column_means(df, cols)
    x = with_folds(df, spec, n_folds, seed, by_entity)
    gs = LN.collect_grams(LN.gram_table(x, cols, keys=["_fold"], shift=shift), len(cols) + 1, keys=["_fold"])
    return gs, shift


def cross_validate_grams(gs: dict, p: int, shift: np.ndarray, kind="ridge", alpha=5.0, l1_ratio=0.5):
    """Per fold: fit on total - fold, score on the fold, from matrices only."""
    total = sum(gs.values())
    out = []
    for (fold,), gf in sorted(gs.items()):
        gt = total - gf
        q = gt.shape[0] - 1 - p
        if kind == "ridge":
            coef, b, _, _ = LN.solve_ridge(gt, p, alpha, shift[:p], shift[p:])
        else:
            coef, b, _, _ = LN.solve_elastic_net(gt, p, alpha, l1_ratio if kind == "elastic_net" else 1.0, shift[:p], shift[p:])
        r2, rmse = LN.flat_r2_rmse(gf, p, coef, b, shift)
        out.append((int(fold), float(gf[0, 0]), r2, rmse))
    return out


def cv_table(spark: SparkSession, rows: list[tuple], model: str) -> DataFrame:
    return spark.createDataFrame(
        [(model, f, int(n), float(r2), float(rmse)) for f, n, r2, rmse in rows],
        "model string, fold int, n_val long, r2 double, rmse double",
    )


def cv_summary(cv: DataFrame) -> DataFrame:
    return cv.groupBy("model").agg(
        F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"),
        F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std"),
    )


# --------------------------------------------------------------------------- grid search


ALPHAS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0)
K_VALUES = (8, 10, 12, 15, 18, 20)
EN_ALPHAS = (0.1, 0.5, 1.0, 2.0, 5.0)
EN_L1 = (0.1, 0.3, 0.5, 0.7, 0.9)


def grid_search(gs: dict, all_features: list[str], shift: np.ndarray, scores: list[tuple[str, float]]):
    """k, then ridge alpha, then elastic-net (alpha, l1) by CV R2 — all from the per-fold
    Grams computed once; no extra scans."""
    p_all = len(all_features)
    q = next(iter(gs.values())).shape[0] - 1 - p_all
    order = [n for n, _ in sorted(scores, key=lambda t: (-(t[1] if np.isfinite(t[1]) else -np.inf), t[0]))]
    results = []

    def sub(names):
        idx = [all_features.index(n) for n in names]
        sh = np.concatenate([shift[idx], shift[p_all:]])
        return {k: _sub(g, p_all, idx, q) for k, g in gs.items()}, sh

    best_k, best = None, -np.inf
    for k in K_VALUES:
        g2, sh = sub(order[:k])
        r = cross_validate_grams(g2, k, sh, "ridge", 5.0)
        m = float(np.mean([x[2] for x in r]))
        results.append(("select_k", f"k={k}", m))
        if m > best:
            best_k, best = k, m
    g2, sh = sub(order[:best_k])
    best_alpha, best = None, -np.inf
    for a in ALPHAS:
        r = cross_validate_grams(g2, best_k, sh, "ridge", a)
        m = float(np.mean([x[2] for x in r]))
        results.append(("ridge", f"alpha={a}", m))
        if m > best:
            best_alpha, best = a, m
    for a in EN_ALPHAS:
        for l1 in EN_L1:
            r = cross_validate_grams(g2, best_k, sh, "elastic_net", a, l1)
            results.append(("elastic_net", f"alpha={a},l1_ratio={l1}", float(np.mean([x[2] for x in r]))))
    return results, best_k, best_alpha


# --------------------------------------------------------------------------- walk-forward


def month_list(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> list:
    """Sorted distinct months: a calendar dimension (hundreds of values at most)."""
    return [r[0] for r in df.select(spec.month).distinct().orderBy(spec.month).collect()]


def fold_bounds(n: int, train_months: int = 36, test_months: int = 3, step: int = 3) -> list[tuple[int, int, int, int, int]]:
    """(fold, train_start, train_end, test_start, test_end) month positions:
    for i in range(0, n - train - test, step)."""
    out = []
    for f, i in enumerate(range(0, n - train_months - test_months, step), start=1):
        out.append((f, i, i + train_months - 1, i + train_months, min(i + train_months + test_months - 1, n - 1)))
    return out


def walk_forward_folds(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, train_months: int = 36, test_months: int = 3, step: int = 3) -> DataFrame:
    months = month_list(df, spec)
    rows = [
        (f, months[a], months[b], months[c], months[d], a, b, c, d)
        for f, a, b, c, d in fold_bounds(len(months), train_months, test_months, step)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "fold int, train_start date, train_end date, test_start date, test_end date, "
        "train_start_idx int, train_end_idx int, test_start_idx int, test_end_idx int",
    )


def walk_forward(feat: DataFrame, spec: PanelSpec = DEFAULT_SPEC, train_months: int = 36, test_months: int = 3, step: int = 3, alpha: float = 5.0):
    """Refit scaler + ridge on every numeric feature per fold.  Month Grams are built in one
    pass (key = month); a fold's training Gram is the sum of its months' Grams, added on the
    driver (months x d^2 numbers, independent of the row count).  Test rows reach their
    fold through a month -> fold equi-join, are scored with the fold's coefficients (a
    broadcast array per fold and target) and evaluated with the metric aggregates."""
    spark = feat.sparkSession
    feats = FE.feature_columns(feat, spec)
    targets = list(spec.targets)
    cols = feats + targets
    p = len(feats)
    shift = LN.column_means(feat, cols)
    months = month_list(feat, spec)
    bounds = fold_bounds(len(months), train_months, test_months, step)
    mg = LN.collect_grams(LN.gram_table(feat, cols, keys=[spec.month], shift=shift), len(cols) + 1, keys=[spec.month])
    month_pos = {m: i for i, m in enumerate(months)}
    by_pos = {}
    for (m,), g in mg.items():
        by_pos[month_pos[pd.Timestamp(m).date()]] = g
    coef_rows, test_map = [], []
    for f, a, b, c, d in bounds:
        g = sum(by_pos[i] for i in range(a, b + 1) if i in by_pos)
        coef, icpt, _, _ = LN.solve_ridge(g, p, alpha, shift[:p], shift[p:])
        for t, name in enumerate(targets):
            coef_rows.append((f, name, [float(v) for v in coef[:, t]], float(icpt[t]), int(round(g[0, 0]))))
        test_map += [(months[i], f) for i in range(c, d + 1)]
    coefs = spark.createDataFrame(coef_rows, "fold int, target string, coef array<double>, intercept double, train_samples long")
    tmap = spark.createDataFrame(test_map, f"{spec.month} date, fold int")
    test = feat.join(F.broadcast(tmap), spec.month)  # months x folds: calendar-sized
    body = ", ".join(f"'{t}', CAST(`{t}` AS DOUBLE)" for t in targets)
    long = test.select("fold", spec.entity, spec.month, *feats, F.expr(f"stack({len(targets)}, {body}) AS (target, actual)"))
    scored = long.join(F.broadcast(coefs), ["fold", "target"]).select(
        "fold", spec.entity, spec.month, "target", "actual",
        (F.col("intercept") + LN.dot_expr(feats, "coef")).alias("predicted"),
    )
    folds = walk_forward_folds(feat, spec, train_months, test_months, step)
    return scored, folds, coefs


def walk_forward_metrics(scored: DataFrame) -> DataFrame:
    return M.regression_metrics(scored, by=("fold", "target"))


def walk_forward_overall(scored: DataFrame) -> DataFrame:
    """Per fold: R2 and RMSE over all targets flattened together."""
    e = F.col("actual") - F.col("predicted")
    return scored.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("overall_rmse"),
        (1 - F.sum(e * e) / (F.var_pop("actual") * F.count(F.lit(1)))).alias("overall_r2"),
    )


def walk_forward_summary(overall: DataFrame) -> DataFrame:
    """Mean / sample std over folds, first-half vs second-half drift and leakage class."""
    w = Window.orderBy("fold")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    x = overall.select("fold", "overall_r2", "overall_rmse", F.row_number().over(w).alias("rn"), n.alias("nf"))
    first = F.col("rn") <= F.floor(F.col("nf") / 2)
    s = x.agg(
        F.avg("overall_r2").alias("avg_r2"), F.stddev_samp("overall_r2").alias("r2_std"),
        F.avg("overall_rmse").alias("avg_rmse"), F.stddev_samp("overall_rmse").alias("rmse_std"),
        (F.avg(F.when(first, F.col("overall_r2"))) - F.avg(F.when(~first, F.col("overall_r2")))).alias("r2_degradation"),
        (F.avg(F.when(~first, F.col("overall_rmse"))) - F.avg(F.when(first, F.col("overall_rmse")))).alias("rmse_degradation"),
    )
    r2 = F.col("avg_r2")
    return s.withColumn(
        "leakage_status",
        F.when(r2 > 0.99, "SEVERE LEAKAGE LIKELY").when(r2 > 0.95, "POSSIBLE LEAKAGE").when(r2 > 0.80, "UNLIKELY").otherwise("NONE DETECTED"),
    ).withColumn("degraded", (F.col("r2_degradation") > 0.05) | (F.col("rmse_degradation") > 100))
