"""Boosting from distributed histograms against a plain numpy fit of the same rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelengine.operators import boosting as B

FEATURES, TARGETS = ["a", "b", "c"], ["y", "z"]


def table(n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), rng.random(n)])
    y = np.column_stack([2 * x[:, 0] + (x[:, 1] > 2) + 0.1 * rng.normal(size=n), np.where(x[:, 2] > 0.5, x[:, 0] ** 2, -1)])
    return x, y, np.arange(n) % 4 == 0


def plain_fit(x, y, held, params):
    """No histograms: every cut of every node is summed over its rows."""
    n, p = x.shape
    train = ~held
    edges = np.stack([np.quantile(x[train, f], [k / params.bins for k in range(1, params.bins)]) for f in range(p)])
    bins = np.stack([(x[:, f][:, None] > edges[f]).sum(1) for f in range(p)], 1)
    out = []
    for t in range(y.shape[1]):
        margin = np.full(n, y[train, t].mean())
        trees, losses, best = [], [], (np.inf, 0)
        for number in range(params.rounds + 1):
            losses.append(((y[held, t] - margin[held]) ** 2).mean())
            if losses[-1] < best[0]:
                best = (losses[-1], number)
            elif number - best[1] >= params.patience:
                break
            if number == params.rounds:
                break
            use = train & (B.hashed(np.arange(n), np.full(n, params.seed), np.full(n, number)) < params.row_share)
            allowed = B.sampled_columns(p, params, number)
            node, value, todo, leaves, g = np.zeros(n, int), {}, [0], 1, margin - y[:, t]
            weight = lambda m: -g[m].sum() / (m.sum() + params.l2) * params.learning_rate
            score = lambda m: g[m].sum() ** 2 / (m.sum() + params.l2)
            value[0] = weight(use)
            for _ in range(params.max_depth):
                found = []
                for k in todo:
                    inside = use & (node == k)
                    value[k] = weight(inside)
                    options = []
                    for f in np.flatnonzero(allowed):
                        for cut in range(params.bins - 1):
                            left, right = inside & (bins[:, f] <= cut), inside & (bins[:, f] > cut)
                            if left.sum() >= 1 and right.sum() >= 1:
                                options.append((0.5 * (score(left) + score(right) - score(inside)), -f, -cut))
                    if options and max(options)[0] > 1e-12:
                        gain, f, cut = max(options)
                        found.append((-gain, k, -f, -cut))
                todo = []
                for _, k, f, cut in sorted(found):
                    if leaves >= params.max_leaves:
                        continue
                    a = max(value) + 1
                    goes = bins[:, f] <= cut
                    for child, side in ((a, goes), (a + 1, ~goes)):
                        value[child] = weight(use & (node == k) & side)
                    node = np.where((node == k) & goes, a, np.where((node == k) & ~goes, a + 1, node))
                    todo += [a, a + 1]
                    leaves += 1
            step = np.array([value[k] for k in node])
            margin = margin + step
            trees.append(step)
        out.append((y[train, t].mean() + sum(trees[: best[1]], np.zeros(n)), losses, best[1]))
    return out


@pytest.mark.parametrize("params", [B.Params(rounds=5, learning_rate=0.3, max_depth=2, max_leaves=3, bins=8, patience=3), B.Params(rounds=12, learning_rate=0.9, max_depth=2, bins=6, patience=2, column_share=1.0)])
def test_fit_equals_plain_numpy(spark, monkeypatch, params):
    monkeypatch.setattr(B, "WRITE_EVERY", 3)
    x, y, held = table()
    rows = [(i, bool(h), *map(float, a), *map(float, b)) for i, (h, a, b) in enumerate(zip(held, x, y))]
    df = spark.createDataFrame(rows, "i long, h boolean, a double, b double, c double, y double, z double").repartition(3)
    model = B.fit(df, FEATURES, TARGETS, F.col("h"), F.col("i"), params)
    want = plain_fit(x, y, held, params)
    got = B.predict(df, model).orderBy("i").toPandas()
    for t, (predicted, losses, best) in enumerate(want):
        assert len(model.trees[t]) == best and np.allclose(model.losses[t], losses)
        assert np.allclose(got[f"predicted_{TARGETS[t]}"], predicted)
    assert abs(sum(g for _, g in B.gain_importance(model, "y")) - 1) < 1e-9


def test_empty_and_null_rows(spark):
    schema = "i long, h boolean, a double, b double, c double, y double, z double"
    none = B.fit(spark.createDataFrame([], schema), FEATURES, TARGETS, F.col("h"), F.col("i"), B.Params(rounds=2, bins=4))
    assert none.trees == [[], []]
    df = spark.createDataFrame([(k, False, float(k % 7), None if k == 3 else 1.0, 2.0, float(k % 7 > 3), None if k == 5 else 0.5) for k in range(40)], schema)
    model = B.fit(df, FEATURES, TARGETS, F.col("h"), F.col("i"), B.Params(rounds=3, learning_rate=0.5, max_depth=1, bins=8, row_share=1.0, column_share=1.0))
    got = {r.i: r.predicted_y for r in B.predict(df, model).collect()}
    assert got[3] is None and got[6] > got[0] and len(model.trees[0]) == 3
