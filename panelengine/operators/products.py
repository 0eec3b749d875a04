"""Product analytics: correlations with levers and revenue, statistics, promote / demote
lists and per-entity trends.  Every family is a single aggregate over the panel followed
by an unpivot; the 13 x 6 correlation grid is one job, not 78."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import display_name, round2
from ..spec import DEFAULT_SPEC, PRODUCT_CATEGORY, PRODUCT_LEVERS, PRODUCT_NAMES, PanelSpec, product_revenue_column
from .quality import safe_corr, stack
from .ranks import column_quantiles


def _pair_corr(a: str, b: str):
    ok = F.col(a).isNotNull() & F.col(b).isNotNull()
    return safe_corr(F.when(ok, F.col(a)).cast("double"), F.when(ok, F.col(b)).cast("double"))


def corr_product_lever(df: DataFrame, levers=PRODUCT_LEVERS) -> DataFrame:
    levers = [lv for lv in levers if lv in df.columns]
    pairs = [(p, lv) for p in PRODUCT_NAMES for lv in levers]
    one = df.agg(*[round2(_pair_corr(product_revenue_column(p), lv), 4).alias(f"c{i}") for i, (p, lv) in enumerate(pairs)])
    return stack(one, [(f"'{p}'", f"'{lv}'", f"c{i}") for i, (p, lv) in enumerate(pairs)], ["product", "lever", "corr"])


def corr_product_revenue(df: DataFrame, metrics=("revenue_month_1", "revenue_month_2", "revenue_month_3", "total_revenue")) -> DataFrame:
    """Product revenue x revenue metrics; ``total_revenue`` stands in for a missing metric."""
    pairs = [(p, m, m if m in df.columns else "total_revenue") for p in PRODUCT_NAMES for m in metrics]
    one = df.agg(*[round2(_pair_corr(product_revenue_column(p), src), 4).alias(f"c{i}") for i, (p, _, src) in enumerate(pairs)])
    return stack(one, [(f"'{p}'", f"'{m}'", f"c{i}") for i, (p, m, _) in enumerate(pairs)], ["product", "metric", "corr"])


def product_stats(df: DataFrame) -> DataFrame:
    aggs = []
    for i, p in enumerate(PRODUCT_NAMES):
        c = product_revenue_column(p)
        aggs += [
            round2(F.avg(c), 2).alias(f"mean{i}"), round2(F.stddev_samp(c), 2).alias(f"std{i}"),
            F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}"),
        ]
    medians = column_quantiles(df, [product_revenue_column(p) for p in PRODUCT_NAMES], [0.5])
    one = df.agg(*aggs).crossJoin(medians)  # one row each
    return stack(
        one, [(f"'{p}'", f"mean{i}", f"std{i}", f"rint(q0_{i} * 100) / 100", f"min{i}", f"max{i}") for i, p in enumerate(PRODUCT_NAMES)],
        ["product", "mean", "std", "median", "min", "max"],
    )


def corr_matrix(corr_long: DataFrame, levers=PRODUCT_LEVERS) -> DataFrame:
    return corr_long.groupBy("product").pivot("lever", list(levers)).agg(F.first("corr"))


def product_catalogue(spark) -> DataFrame:
    return spark.createDataFrame([(p, PRODUCT_CATEGORY[p]) for p in PRODUCT_NAMES], "product string, category string")


def topk_products(corr_rev: DataFrame, stats: DataFrame, metric: str = "total_revenue", threshold: float = 0.60,
                  top_n: int = 5, demote_below: float = 0.30, demote_n: int = 3) -> DataFrame:
    """promote: corr >= threshold ranked by corr x mean revenue; demote: corr < 0.30 ranked
    by corr ascending; NULL correlations excluded."""
    j = corr_rev.where((F.col("metric") == metric) & F.col("corr").isNotNull()).join(stats.select("product", "mean"), "product")
    j = j.withColumn("display_name", display_name(F.col("product")))
    prom = j.where(F.col("corr") >= threshold).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc(F.col("corr") * F.col("mean")), "product"))
    ).where(F.col("rank") <= top_n).withColumn("action", F.lit("promote"))
    dem = j.where(F.col("corr") < demote_below).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("corr"), "product"))
    ).where(F.col("rank") <= demote_n).withColumn("action", F.lit("demote"))
    cols = ["action", "rank", "product", "display_name", "corr", "mean"]
    return prom.select(*cols).unionByName(dem.select(*cols))


def product_trend(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, months: int = 12) -> DataFrame:
    """Per entity and product over its last ``months`` rows: OLS slope against the row
    index, direction (+-0.01), mean, population std and CV."""
    w = Window.partitionBy(spec.entity).orderBy(spec.month)
    wd = Window.partitionBy(spec.entity).orderBy(F.col(spec.month).desc())
    x = df.select(spec.entity, F.row_number().over(w).alias("idx"), F.row_number().over(wd).alias("back"),
                  *[product_revenue_column(p) for p in PRODUCT_NAMES]).where(F.col("back") <= months)
    body = ", ".join(f"'{p}', CAST(`{product_revenue_column(p)}` AS DOUBLE)" for p in PRODUCT_NAMES)
    long = x.select(spec.entity, "idx", F.expr(f"stack({len(PRODUCT_NAMES)}, {body}) AS (product, revenue)"))
    g = long.groupBy(spec.entity, "product").agg(
        F.regr_slope("revenue", F.col("idx").cast("double")).alias("slope"),
        F.avg("revenue").alias("mean"), F.stddev_pop("revenue").alias("std"),
    )
    return g.select(
        spec.entity, "product", round2("slope", 4).alias("slope"),
        F.when(F.col("slope") > 0.01, "increasing").when(F.col("slope") < -0.01, "decreasing").otherwise("stable").alias("trend"),
        round2("mean", 2).alias("mean"), round2("std", 2).alias("std"),
        round2(F.try_divide(F.col("std"), F.col("mean")), 4).alias("cv"),
    )
