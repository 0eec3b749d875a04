import numpy as np
import pandas as pd

from panelengine.operators import explain as EX
from panelengine.operators import linear as LN
from panelengine.plans import training as TR


def _data(spark, n=300, p=6, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * rng.uniform(1, 1000, size=p) + rng.uniform(-50, 5000, size=p)
    x[:, 2] = 7.0  # constant column
    y = np.column_stack([x @ rng.normal(size=p) + rng.normal(size=n) * 10, x[:, 0] * 0.5 + 3])
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(p)])
    pdf["y0"], pdf["y1"] = y[:, 0], y[:, 1]
    pdf["entity_id"] = np.arange(n) % 17
    pdf["row_id"] = np.arange(n)
    pdf["month"] = pd.Timestamp("2020-01-01")
    return spark.createDataFrame(pdf), x, y


def _ridge_numpy(x, y, alpha):
    mu, sd = x.mean(0), x.std(0)
    sd[sd < 1e-12] = 1.0
    xs = (x - mu) / sd
    xc, yc = xs - xs.mean(0), y - y.mean(0)
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return xs @ w + (y.mean(0) - xs.mean(0) @ w)


def test_gram_ridge_equals_closed_form(spark):
    df, x, y = _data(spark)
    cols = [f"f{i}" for i in range(x.shape[1])] + ["y0", "y1"]
    shift = LN.column_means(df, cols)
    g = LN.collect_grams(LN.gram_table(df, cols, shift=shift), len(cols) + 1)[()]
    m = LN.fit_from_gram(g, cols[:-2], ["y0", "y1"], "ridge", 5.0, shift=shift)
    np.testing.assert_allclose(x @ m.coef + m.intercept, _ridge_numpy(x, y, 5.0), rtol=1e-9, atol=1e-6)
    # the Spark literal expression gives the same numbers
    sp = df.select(*m.predict_columns()).toPandas().to_numpy()
    np.testing.assert_allclose(sp, _ridge_numpy(x, y, 5.0), rtol=1e-9, atol=1e-6)


def test_cv_from_grams_equals_refit(spark):
    df, x, y = _data(spark)
    feats = [f"f{i}" for i in range(x.shape[1])]
    gs, shift = TR.fold_grams(df.withColumnRenamed("y0", "revenue_month_1"), feats, spec=_Spec(), n_folds=4)
    res = TR.cross_validate_grams(gs, len(feats), shift, "ridge", 2.0)
    folds = TR.with_folds(df, _Spec(), 4).select("row_id", "_fold").toPandas().sort_values("row_id")["_fold"].to_numpy()
    for fold, n, r2, rmse in res:
        tr, te = folds != fold, folds == fold
        mu, sd = x[tr].mean(0), x[tr].std(0)
        sd[sd < 1e-12] = 1
        xs = (x[tr] - mu) / sd
        xc, yc = xs - xs.mean(0), y[tr] - y[tr].mean(0)
        w = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(len(feats)), xc.T @ yc)
        pred = (x[te] - mu) / sd @ w + (y[tr].mean(0) - xs.mean(0) @ w)
        yt = y[te]
        sse = ((yt - pred) ** 2).sum()
        sst = ((yt.ravel() - yt.ravel().mean()) ** 2).sum()
        assert abs((1 - sse / sst) - r2) < 1e-8
        assert abs(np.sqrt(((yt - pred) ** 2).mean()) - rmse) < 1e-6 * max(1, rmse)


class _Spec:
    entity = "entity_id"
    month = "month"
    targets = ("revenue_month_1", "y1")


def test_shap_sums_to_prediction(spark):
    df, x, y = _data(spark)
    cols = [f"f{i}" for i in range(x.shape[1])] + ["y0", "y1"]
    g = LN.collect_grams(LN.gram_table(df, cols), len(cols) + 1)[()]
    m = LN.fit_from_gram(g, cols[:-2], ["y0", "y1"], "ridge", 1.0)
    bg = EX.background_mean(df, m.features, keys=("entity_id",))
    rows = df.drop("entity_id").withColumnRenamed("row_id", "entity_id")
    ex = EX.explanations(rows, m, bg, top=len(m.features)).toPandas()
    sums = ex.groupby(["entity_id", "month", "target"]).agg(phi=("phi", "sum"), base=("base_value", "first"), pred=("prediction", "first"))
    np.testing.assert_allclose(sums["phi"] + sums["base"], sums["pred"], rtol=1e-9, atol=1e-6)


def _gram(x, y):
    z = np.column_stack([np.ones(len(x)), x - x.mean(0), y - y.mean(0)])
    return z.T @ z


def test_lasso_of_nearly_collinear_features_is_the_minimum():
    """Counts that are multiples of each other but for rounding: sweeps alone need millions."""
    rng = np.random.default_rng(11)
    n = 400
    x = rng.normal(size=(n, 8)) * 1e3
    x[:, 1] = np.rint(x[:, 0] * 3)  # all but collinear
    x[:, 5] = x[:, 4]  # a copy
    x[:, 6] = x[:, 2] + x[:, 3]  # a sum
    x[:, 7] = 0.25 * x[:, 2] + rng.normal(size=n) * 0.1
    y = np.column_stack([1e4 * (x @ rng.normal(size=8)) + 1e5 * rng.normal(size=n), x[:, 7] - x[:, 2], rng.normal(size=n) * 1e-3])
    xs, yc = (x - x.mean(0)) / x.std(0), y - y.mean(0)
    for alpha, l1_ratio in ((1.0, 1.0), (1e-3, 1.0), (1.0, 0.5)):
        m = LN.fit_from_gram(_gram(x, y), [f"f{i}" for i in range(8)], ["a", "b", "c"], "elastic_net", alpha, l1_ratio)
        w = m.scaled_coef()
        l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
        slope = xs.T @ (yc - xs @ w) / n - l2 * w
        off = np.where(w != 0, np.abs(slope - l1 * np.sign(w)), np.maximum(np.abs(slope) - l1, 0))
        assert (off <= 1e-8 * np.abs(xs.T @ yc / n).max(0) + 1e-12).all(), (alpha, l1_ratio, off)
    assert (w[:, 2] == 0).all()
