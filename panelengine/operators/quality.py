"""Data-quality and validation checks on an entity-month panel.

Each check family is one aggregate over the panel (a single scan with many expressions,
partial aggregation on every task) followed by a ``stack`` unpivot into a long
``(column, ...)`` table; no per-column jobs.  Order-dependent checks (flows, gaps, jumps)
use the entity window, never a global ordering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dbl, round2, safe_div
from ..spec import DEFAULT_SPEC, EXPECTED_POSITIVE_CORR, VALIDATION_RANGES, PanelSpec
from .ranks import column_quantiles

NUMERIC = ("integer", "long", "double", "float", "short", "decimal", "byte")


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in NUMERIC and f.name not in exclude]


def _q(c: str) -> str:
    return f"`{c}`"


def stack(df_one_row: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    """Unpivot a one-row aggregate: ``rows`` holds tuples of SQL expressions over its columns."""
    body = ", ".join(", ".join(r) for r in rows)
    return df_one_row.selectExpr(f"stack({len(rows)}, {body}) AS ({', '.join(names)})")


# --- profile (#71) ------------------------------------------------------------


def profile_numeric(df: DataFrame, cols=("total_revenue", "total_members", "retention_rate")) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [
            F.min(c).cast("double").alias(f"min_{c}"),
            F.max(c).cast("double").alias(f"max_{c}"),
            round2(F.avg(c), 4).alias(f"mean_{c}"),
            round2(F.stddev_samp(c), 4).alias(f"std_{c}"),
        ]
    one = df.agg(*aggs).crossJoin(column_quantiles(df, list(cols), [0.5]))  # one row each
    rows = [(f"'{c}'", f"min_{c}", f"max_{c}", f"mean_{c}", f"rint(q0_{i} * 10000) / 10000", f"std_{c}") for i, c in enumerate(cols)]
    return stack(one, rows, ["column", "min_value", "max_value", "mean_value", "median_value", "std_value"])


# --- missing / inf / variance / sign (#72-#75) ------------------------------------


def null_counts(df: DataFrame, offenders_only: bool = True) -> DataFrame:
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"nul_{i}") for i, c in enumerate(cols)])
    rows = [(f"'{c}'", f"nul_{i}", f"_n") for i, c in enumerate(cols)]
    out = stack(one, rows, ["column", "null_count", "n"]).select(
        "column", "null_count", round2(F.col("null_count") * 100.0 / F.col("n"), 2).alias("null_pct")
    )
    return out.where(F.col("null_count") > 0) if offenders_only else out


def inf_counts(df: DataFrame) -> DataFrame:
    cols = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    inf = dbl(float("inf"))
    one = df.agg(*[F.count_if(F.abs(F.col(c)) == inf).alias(f"inf_{i}") for i, c in enumerate(cols)])
    return stack(one, [(f"'{c}'", f"inf_{i}") for i, c in enumerate(cols)], ["column", "inf_count"])


def zero_variance(df: DataFrame, cols=None) -> DataFrame:
    cols = cols or numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [
            F.stddev_samp(c).alias(f"sd_{i}"),
            F.min(c).cast("double").alias(f"mn_{i}"),
            F.max(c).cast("double").alias(f"mx_{i}"),
        ]
    one = df.agg(*aggs)
    out = stack(one, [(f"'{c}'", f"sd_{i}", f"mn_{i}", f"mx_{i}") for i, c in enumerate(cols)], ["column", "std", "min_value", "max_value"])
    return out.where((F.col("std") == 0) | (F.col("min_value") == F.col("max_value"))).select(
        "column", "min_value", "max_value"
    )


NON_NEGATIVE = (
    "total_members", "new_members", "churned_members", "total_revenue", "membership_revenue",
    "class_pack_revenue", "retail_revenue", "total_classes_held", "total_class_attendance", "staff_count",
)


def negative_values(df: DataFrame, cols=NON_NEGATIVE) -> DataFrame:
    cols = [c for c in cols if c in df.columns]
    one = df.agg(*[F.count_if(F.col(c) < 0).alias(f"neg_{i}") for i, c in enumerate(cols)])
    return stack(one, [(f"'{c}'", f"neg_{i}") for i, c in enumerate(cols)], ["column", "negative_count"])


# --- rule ranges (#76), revenue identity (#77) ------------------------------------------


def range_violations(df: DataFrame, rules=VALIDATION_RANGES) -> DataFrame:
    present = [(c, lo, hi) for c, (lo, hi) in rules.items() if c in df.columns]
    aggs = []
    for i, (c, lo, hi) in enumerate(present):
        x = F.col(c)
        aggs += [
            F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias(f"bad_{i}"),
            F.min(x).cast("double").alias(f"mn_{i}"),
            F.max(x).cast("double").alias(f"mx_{i}"),
        ]
    one = df.agg(*aggs)
    rows = [
        (f"'{c}'", f"CAST({float(lo)} AS DOUBLE)", f"CAST({float(hi)} AS DOUBLE)", f"bad_{i}", f"mn_{i}", f"mx_{i}")
        for i, (c, lo, hi) in enumerate(present)
    ]
    return stack(one, rows, ["metric", "rule_min", "rule_max", "violations", "actual_min", "actual_max"])


def revenue_consistency(df: DataFrame, tolerance: float = 1000.0) -> DataFrame:
    diff = F.abs(F.col("total_revenue") - (F.col("membership_revenue") + F.col("class_pack_revenue") + F.col("retail_revenue")))
    return df.agg(
        F.count_if(diff > tolerance).alias("inconsistent_rows"),
        round2(F.max(diff)).alias("max_diff"),
    )


# --- distribution outliers (#78) -----------------------------------------------------------


def iqr_outliers(df: DataFrame, cols=None, k: float = 3.0, warn_pct: float = 2.0) -> DataFrame:
    cols = cols or numeric_columns(df)
    qs = column_quantiles(df, cols, [0.25, 0.75])
    # second pass against the one-row quantile table (broadcast: exactly one row)
    joined = df.crossJoin(F.broadcast(qs))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        iqr = F.col(f"q1_{i}") - F.col(f"q0_{i}")
        lo = F.col(f"q0_{i}") - k * iqr
        hi = F.col(f"q1_{i}") + k * iqr
        aggs += [
            F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"out_{i}"),
            F.first(lo).alias(f"lo_{i}"),
            F.first(hi).alias(f"hi_{i}"),
        ]
    one = joined.agg(*aggs)
    rows = [(f"'{c}'", f"out_{i}", f"lo_{i}", f"hi_{i}", "_n") for i, c in enumerate(cols)]
    out = stack(one, rows, ["column", "outliers", "lower_bound", "upper_bound", "n"])
    pct = F.col("outliers") * 100.0 / F.col("n")
    return out.select(
        "column", "outliers", round2("lower_bound", 4).alias("lower_bound"), round2("upper_bound", 4).alias("upper_bound"),
        round2(pct, 2).alias("outlier_pct"), (pct > warn_pct).alias("warn"),
    )


# --- split / entity counts (#79, #80) -------------------------------------------------------


def split_counts(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    g = df.groupBy(spec.split).agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy())  # over the grouped rows (one per split)
    return g.select(spec.split, "rows", round2(F.col("rows") * 100.0 / total, 2).alias("pct"))


def split_counts_by_entity(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    return (
        df.groupBy(spec.entity)
        .pivot(spec.split, ["train", "validation", "test"])
        .count()
        .na.fill(0, ["train", "validation", "test"])
    )


def entity_distribution(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    return df.groupBy("studio_location", "studio_size_tier").agg(F.countDistinct(spec.entity).alias("n_entities"))


# --- correlations (#84) ---------------------------------------------------------------


def safe_corr(a, b):
    """Pearson correlation; NULL instead of a division error when a side is constant."""
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def corr_pairs(df: DataFrame, pairs=EXPECTED_POSITIVE_CORR, warn_below: float = 0.3) -> DataFrame:
    pairs = [(a, b) for a, b in pairs if a in df.columns and b in df.columns]
    both = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        # pandas corr uses pairwise-complete rows
        xa = both(a, b).cast("double")
        xb = F.when(F.col(a).isNotNull(), F.col(b)).cast("double")
        aggs.append(round2(safe_corr(xa, xb), 4).alias(f"c_{i}"))
    one = df.agg(*aggs)
    out = stack(one, [(f"'{a}'", f"'{b}'", f"c_{i}") for i, (a, b) in enumerate(pairs)], ["column_a", "column_b", "corr"])
    return out.withColumn("warn", F.col("corr") < warn_below)


# --- temporal / flow checks (#59-#62) -------------------------------------------------------


def _w(spec):
    return Window.partitionBy(spec.entity).orderBy(spec.month)


def member_flow_check(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, tol: float = 5.0) -> DataFrame:
    change = F.col(spec.members) - F.lag(spec.members).over(_w(spec))
    diff = F.abs(change - (F.col("new_members") - F.col("churned_members")))
    d = df.select(diff.alias("d"))
    return d.agg(F.count("d").alias("checked_rows"), F.count_if(F.col("d") > tol).alias("inconsistent_rows"))


def retention_flow_check(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, tol: float = 0.1) -> DataFrame:
    expected = F.lag(spec.members).over(_w(spec)) * (1 - F.col(spec.retention))
    d = df.select(expected.alias("e"), F.abs(F.col("churned_members") - expected).alias("d"))
    return d.agg(
        F.count("d").alias("checked_rows"),
        F.count_if(F.col("d") > F.col("e") * tol).alias("inconsistent_rows"),
    )


def monotonic_dates(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, sequence: str = "studio_age") -> DataFrame:
    """Rows whose month is earlier than the previous row of the entity in ``sequence`` order."""
    w = Window.partitionBy(spec.entity).orderBy(sequence)
    back = F.col(spec.month) < F.lag(spec.month).over(w)
    return df.select(back.alias("b")).agg(F.count_if(F.col("b")).alias("out_of_order_rows"))


def date_gaps(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, lo: int = 25, hi: int = 35) -> DataFrame:
    d = F.datediff(F.col(spec.month), F.lag(spec.month).over(_w(spec)))
    x = df.select(d.alias("d"))
    return x.agg(F.count("d").alias("checked_rows"), F.count_if((F.col("d") < lo) | (F.col("d") > hi)).alias("gap_rows"))


# --- validator verdict (#178) ----------------------------------------------------------------


# Columns that a panel must have, and those that must be numbers
REQUIRED = (
    "month_year", "month_index", "year_index", "total_members", "new_members", "churned_members", "retention_rate", "avg_ticket_price", "total_classes_held",
    "total_class_attendance", "class_attendance_rate", "staff_count", "staff_utilization_rate", "total_revenue", "membership_revenue", "class_pack_revenue",
    "retail_revenue", "upsell_rate",
)
MUST_BE_NUMBERS = ("total_members", "new_members", "churned_members", "retention_rate", "avg_ticket_price", "total_revenue")


def quality_verdict(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, sequence: str | None = None) -> DataFrame:
    """One row for each of the eight checks: passed, issues and warnings. Outliers and
    correlations only warn. ``sequence`` is the ingest order that months are held against
    (default: not checked). The month column goes for ``month_year``."""
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    absent = [c for c in REQUIRED if c not in types and not (c == "month_year" and spec.month in types)]
    bad_types = [c for c in MUST_BE_NUMBERS if c in types and types[c] not in NUMERIC] + [spec.month] * (types.get(spec.month) not in ("date", "timestamp"))
    zero = F.lit(0).cast("long")

    def row(source: DataFrame, name: str, issues=zero, warnings=zero) -> DataFrame:
        x = source.select(issues.cast("long").alias("i"), warnings.cast("long").alias("w"))
        return x.select(F.lit(name).alias("check"), (F.coalesce("i", zero) == 0).alias("passed"), F.coalesce("i", zero).alias("issues"), F.coalesce("w", zero).alias("warnings"))

    some = df.agg(F.count(F.lit(1)).alias("rows"))  # an empty panel has no schema issue to show
    logic = revenue_consistency(df).select(F.col("inconsistent_rows").alias("a")).crossJoin(member_flow_check(df, spec).select(F.col("inconsistent_rows").alias("b")))
    logic = logic.crossJoin(retention_flow_check(df, spec).select(F.col("inconsistent_rows").alias("c")))  # one row each
    times = date_gaps(df, spec)
    if sequence is not None:
        times = times.crossJoin(monotonic_dates(df, spec, sequence))
    late = F.col("out_of_order_rows") if sequence is not None else zero
    columns = [c for c in numeric_columns(df) if c not in (spec.entity, "month_index", "year_index")]
    out = row(some, "schema", F.when(F.col("rows") > 0, len(absent)))
    for part in (
        row(null_counts(df).agg(F.count(F.lit(1)).alias("v")), "missing_values", F.col("v")),
        row(some, "data_types", F.when(F.col("rows") > 0, len(bad_types))),
        row(range_violations(df).agg(F.sum("violations").alias("v")), "value_ranges", F.col("v")),
        row(logic, "business_logic", F.col("a") + F.col("b") + F.col("c")),
        row(times, "temporal_consistency", F.col("gap_rows") + late),
        row(iqr_outliers(df, columns).agg(F.count_if("warn").alias("v")), "statistical_outliers", warnings=F.col("v")),
        row(corr_pairs(df).agg(F.count_if(F.col("corr") < 0.3).alias("v")), "correlations", warnings=F.col("v")),
    ):
        out = out.unionByName(part)
    return out

