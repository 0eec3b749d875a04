import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelengine.functions.nested import round_nested
from panelengine.operators import augment as AU


def _rows(spark, n=500):
    pdf = pd.DataFrame({"a": np.arange(n, dtype=float), "b": np.arange(n, dtype=float) * 2})
    return spark.createDataFrame(pdf).repartition(7)


def test_dense_index_is_a_permutation_of_range(spark):
    idx, n = AU.dense_index(_rows(spark), ["a"])
    ids = sorted(r[0] for r in idx.select("row_idx").collect())
    assert n == 500 and ids == list(range(500))


def test_bootstrap_exact_n_and_values_from_source(spark):
    idx, n = AU.dense_index(_rows(spark), ["a"])
    out = AU.bootstrap(idx, n, 321, ["a", "b"]).toPandas()
    assert len(out) == 321
    assert (out["b"] == out["a"] * 2).all()


def test_mixup_keeps_exactly_n_and_lambda_in_unit_interval(spark):
    idx, n = AU.dense_index(_rows(spark), ["a"])
    out = AU.mixup(idx, n, 77, ["a", "b"]).toPandas()
    assert len(out) == 77 and out["draw"].is_unique
    lam = spark.range(2000).select(AU.beta_jonk(F.col("id"), 0.4, 0.4, 42).alias("l")).toPandas()["l"]
    assert lam.between(0, 1).all() and abs(lam.mean() - 0.5) < 0.05


def test_round_nested_rounds_inside_structs_arrays_maps(spark):
    df = spark.createDataFrame([(1, [(1.23456, 2)], {"x": 3.14159})], "id int, arr array<struct<v:double,k:int>>, m map<string,double>")
    r = round_nested(df).first()
    assert r["arr"][0]["v"] == 1.23 and r["arr"][0]["k"] == 2 and r["m"]["x"] == 3.14 and r["id"] == 1


def test_draws_do_not_depend_on_partitions(spark):
    rows = _rows(spark)
    one, n = AU.dense_index(rows.coalesce(1), ["a"])
    many, _ = AU.dense_index(rows.repartition(13), ["a"])
    a, b = (sorted(map(tuple, AU.bootstrap(x, n, 50, ["a", "b"]).collect())) for x in (one, many))
    assert a == b


def test_quantiles_and_numbers_over_ranges(spark):
    from panelengine.operators import ranks as R

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 900, p=[0.8, 0.19, 0.01]), "v": rng.choice([1.0, 2.5, 7.0, np.nan], 900) + np.arange(900) % 5 * (rng.random(900) > 0.5)})
    df = spark.createDataFrame(pdf).selectExpr("k", "if(isnan(v), null, v) as v").repartition(9)
    got = {r.k: (r.q0, r.q1, r.q2) for r in R.quantiles(df, ["k"], "v", [0.25, 0.5, 0.9]).collect()}
    for k, g in pdf.dropna().groupby("k"):
        assert np.allclose(got[k], g.v.quantile([0.25, 0.5, 0.9]))
    ids = spark.range(500).selectExpr("id", "id % 3 as k").repartition(11)
    for r in R.numbered(ids, ["k"], ["id"], "n").collect():
        assert r.n == r.id // 3
    assert R.quantiles(df.where("false"), ["k"], "v", [0.5]).count() == 0
