"""The search over all levers against dense grids, random points and the line search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelengine.operators import search as S
from panelengine.operators import whatif as WI
from panelengine.spec import LEVERS

NAMES = list(LEVERS)
LIMITS = "struct<max_retention_increase:double,max_ticket_increase:double,max_new_members_increase:double>"


def revenue_columns(lever):
    m, p, r = lever("total_members"), lever("avg_ticket_price"), lever("retention_rate")
    return 1000 + 60 * m + 20 * p + 9000 * r + 0.15 * m * p + 35 * lever("new_members") + 12 * lever("upsell_rate") * m + 8 * lever("total_classes_held") + 6 * lever("staff_utilization_rate") * m + 3000 * lever("class_attendance_rate")


def revenue_numpy(x):
    y = np.where([LEVERS[n][3] for n in NAMES], np.rint(x), x)
    return revenue_columns(lambda n: y[..., NAMES.index(n)])


def objective_numpy(x, x0, target, multi):
    r = revenue_numpy(x)
    if not multi:
        return (r - target) ** 2 + 1e-4 * ((x - x0) ** 2).sum(-1)
    cost = (np.abs(x - x0) / x0).mean(-1)
    gain = 0.3 * (x[..., 0] - x0[0]) + 0.2 * 0.001 * (np.rint(x[..., NAMES.index("total_members")]) - x0[NAMES.index("total_members")])
    return ((r - target) / target) ** 2 - gain + 0.1 * cost


def requests(spark, factors, open_levers=None):
    now = {lv: float(d) for lv, (_, _, d, _) in LEVERS.items()}
    x0 = np.array([now[n] for n in NAMES])
    base = float(revenue_numpy(x0))
    df = spark.createDataFrame([(i, base * f) for i, f in enumerate(factors)], "request_id long, target_revenue double")
    df = df.select("*", F.struct(*[F.lit(v).alias(lv) for lv, v in now.items()]).alias("clipped"), F.lit(None).cast(LIMITS).alias("constraints"), F.lit("a").alias("scenario"))
    df = WI.optimization_bounds(df)
    if open_levers is not None:
        fixed = [F.struct(*[(F.col(f"bounds.{lv}.{e}") if lv in open_levers else F.lit(now[lv])).alias(e) for e in ("lo", "hi")]).alias(lv) for lv in NAMES]
        df = df.withColumn("bounds", F.struct(*fixed))
    return df, x0


def found(rows):
    return {r.request_id: (np.array([r.optimized[n] for n in NAMES]), r) for r in rows}


@pytest.mark.parametrize("pair", [("retention_rate", "avg_ticket_price"), ("total_members", "upsell_rate")])
def test_single_objective_against_dense_grid(spark, pair):
    df, x0 = requests(spark, (0.7, 0.95, 1.1, 1.5, 9.0), pair)
    for i, (x, r) in found(S.best_levers(df, revenue_columns, "request_id").collect()).items():
        axes = [np.arange(LEVERS[n][0], LEVERS[n][1] + 1) if LEVERS[n][3] else np.linspace(LEVERS[n][0], LEVERS[n][1], 1201) for n in pair]
        grid = np.tile(x0, (len(axes[0]), len(axes[1]), 1))
        grid[..., NAMES.index(pair[0])], grid[..., NAMES.index(pair[1])] = axes[0][:, None], axes[1][None, :]
        best = objective_numpy(grid, x0, r.target_revenue, False).min()
        assert r.objective <= 1.01 * best + 1e-6, (i, r.method)
        assert np.isclose(r.objective, objective_numpy(x, x0, r.target_revenue, False), rtol=1e-9, atol=1e-6) and np.isclose(r.revenue, revenue_numpy(x))


def test_all_levers_beat_the_line_and_random_points(spark):
    df, x0 = requests(spark, (0.5, 0.8, 1.0, 1.1, 1.4, 2.5))
    got = found(S.best_levers(df, revenue_columns, "request_id").collect())
    line = lambda x, levers: x.withColumn("revenue", revenue_columns(lambda n: F.col(f"{levers}.{n}")))
    on_line = {r.request_id: r.objective for r in WI.line_search(df.drop("constraints"), line, ["request_id", "scenario"]).collect()}
    rng = np.random.default_rng(1)
    lo, hi = np.array([LEVERS[n][0] for n in NAMES]), np.array([LEVERS[n][1] for n in NAMES])
    points = lo + rng.random((200_000, len(NAMES))) * (hi - lo)
    for i, (x, r) in got.items():
        assert r.objective <= on_line[i] + 1e-9 and r.objective <= objective_numpy(points, x0, r.target_revenue, False).min()
        assert (x >= lo - 1e-9).all() and (x <= hi + 1e-9).all()


def test_several_objectives_drive_the_search(spark):
    df, x0 = requests(spark, (0.8, 1.1, 1.5))
    single = found(S.best_levers(df, revenue_columns, "request_id").collect())
    rng = np.random.default_rng(2)
    lo, hi = np.array([LEVERS[n][0] for n in NAMES]), np.array([LEVERS[n][1] for n in NAMES])
    points = np.concatenate([lo + rng.random((200_000, len(NAMES))) * (hi - lo), x0 + rng.normal(0, 0.02, (200_000, len(NAMES))) * (hi - lo)]).clip(lo, hi)
    for method in (S.METHODS, ("evolution",), ("compass",)):
        got = found(S.best_levers(df, revenue_columns, "request_id", multi=F.lit(True), methods=method, population=24, generations=25).collect())
        for i, (x, r) in got.items():
            value = objective_numpy(x, x0, r.target_revenue, True)
            assert np.isclose(r.objective, value, atol=1e-9)
            if method == S.METHODS:
                assert value <= objective_numpy(points, x0, r.target_revenue, True).min() + 2e-3
                assert value <= objective_numpy(single[i][0], x0, r.target_revenue, True) + 1e-9


def test_search_does_not_depend_on_partitions(spark):
    df, _ = requests(spark, [0.6 + 0.1 * k for k in range(12)])
    pick = lambda d: sorted((r.request_id, r.method, tuple(r.optimized)) for r in S.best_levers(d, revenue_columns, "request_id", multi=F.col("request_id") % 2 == 0).collect())
    assert pick(df.repartition(5)) == pick(df.coalesce(1))
    assert S.best_levers(df.limit(0), revenue_columns, "request_id").count() == 0
    plan = S.best_levers(df, revenue_columns, "request_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_clashing_names_and_null_targets(spark):
    df, _ = requests(spark, (1.1,))
    more = df.withColumn("target", F.lit("t")).withColumn("multi", F.lit("m")).withColumn("lo", F.lit(1)).withColumn("seed", F.lit("s"))
    r = S.best_levers(more, revenue_columns, "request_id").first()
    assert (r.target, r.multi, r.lo, r.seed) == ("t", "m", 1, "s") and abs(r.revenue - r.target_revenue) < 1
    r = S.best_levers(df.withColumn("target_revenue", F.lit(None).cast("double")), revenue_columns, "request_id").first()
    assert r.objective is None and r.optimized is not None
