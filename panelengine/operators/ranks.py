"""Global positions and exact quantiles without a global task.

Rows are range-partitioned by their key and order, so each partition is a stretch of the
sorted whole; partition totals (one row per partition and key) give every stretch its offset.
No key is gathered in one place, however many rows it has. Quantiles of whole columns are
selected from brackets instead (``column_quantiles``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_PART, _POS = "_part_", "_pos_"


def _stretches(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` sorted over its partitions, with each row's partition and place in it; written
    once, since both are only stable in what has been written."""
    ensure_checkpoint_dir(df.sparkSession)
    at = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(_POS, at)
    placed = placed.withColumn(_PART, F.shiftright(_POS, 33).cast("int"))
    return placed.withColumn(_POS, F.col(_POS).bitwiseAND(F.lit((1 << 33) - 1))).checkpoint()


def _on(a: str, b: str, names: list[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return cond


def _with_offsets(placed: DataFrame, keys: list[str], total: Column, more: list[Column]) -> DataFrame:
    """``placed`` with ``_offset_`` (sum of ``total`` over the key's earlier stretches) and
    ``_all_`` (over all of them)."""
    parts = placed.groupBy(_PART, *keys).agg(total.alias("_t_"), *more)
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_offset_", F.coalesce(F.sum("_t_").over(before), F.lit(0))).withColumn("_all_", F.sum("_t_").over(by_key))
    extra = [c for c in parts.columns if c not in (_PART, *keys, "_t_")]
    joined = placed.alias("a").join(parts.alias("b"), _on("a", "b", [_PART, *keys]))
    return joined.select("a.*", *[F.col(f"b.{c}") for c in extra])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the row's place, from 0, among those of its key in ``order``. Ties
    are numbered in any order, so ``order`` should tell rows apart."""
    placed = _stretches(df, [*keys, *order])
    out = _with_offsets(placed, keys, F.count(F.lit(1)), [F.min(_POS).alias("_first_")])
    place = F.col("_offset_") + F.col(_POS) - F.col("_first_")
    return out.withColumn(name, place).drop(_PART, _POS, "_first_", "_offset_", "_all_")


def quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """Per key: ``q0``, ``q1`` ..., the linearly interpolated quantiles of the values that are
    not null. Equal values are counted first, so a value of many rows is one row."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v_")).agg(F.count(F.lit(1)).alias("_n_"))
    placed = _with_offsets(_stretches(counts, [*keys, "_v_"]), keys, F.sum("_n_"), [])
    upto = Window.partitionBy(_PART, *keys).orderBy("_v_")
    placed = placed.withColumn("_end_", F.col("_offset_") + F.sum("_n_").over(upto)).withColumn("_begin_", F.col("_end_") - F.col("_n_"))
    out = []
    for i, q in enumerate(qs):
        at = F.lit(float(q)) * (F.col("_all_") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            out.append(F.max(F.when((F.col("_begin_") <= rank) & (rank < F.col("_end_")), F.col("_v_"))).alias(f"_{side}{i}_"))
    found = placed.groupBy(*keys).agg(F.max("_all_").alias("_all_"), *out)
    columns = []
    for i, q in enumerate(qs):
        at = F.lit(float(q)) * (F.col("_all_") - 1)
        lo, hi = F.col(f"_lo{i}_"), F.col(f"_hi{i}_")
        mixed = (F.ceil(at) - at) * lo + (at - F.floor(at)) * hi
        columns.append(F.when(F.floor(at) == F.ceil(at), lo.cast("double")).otherwise(mixed).alias(f"q{i}"))
    return found.select(*keys, *columns)


#: samples of a sketch: ranks are off by 1 / ACCURACY of the rows at most
ACCURACY = 1000
#: cells of a bracket that one window may sort
BRACKET_CELLS = 1 << 16


def _narrowed(cells: DataFrame, at: list[tuple[int, float]], n: list[int]) -> tuple[list[tuple[float, float]], list[int]]:
    """For each wanted (column, quantile) a bracket [lo, hi] that holds its ranks, and how many
    cells lie below it. Sketches propose brackets and counts confirm them; a bracket with more
    than ``BRACKET_CELLS`` cells is narrowed by sketches of its own."""
    everything = (float("-inf"), float("nan"))  # NaN is greater than all numbers here
    ranks = [(math.floor(q * (n[i] - 1)), math.ceil(q * (n[i] - 1))) for i, q in at]
    brackets, below, inside = [everything] * len(at), [0] * len(at), [n[i] for i, _ in at]
    open_ = [j for j, (i, _) in enumerate(at) if n[i]]
    within = lambda j, b: F.col(f"v{at[j][0]}").between(F.lit(b[0]), F.lit(b[1]))
    while open_:
        sketches = []
        for j in open_:
            low, high = (ranks[j][0] - below[j]) / inside[j] - 2 / ACCURACY, (ranks[j][1] + 1 - below[j]) / inside[j] + 2 / ACCURACY
            v = F.when(within(j, brackets[j]), F.col(f"v{at[j][0]}"))
            sketches.append(F.percentile_approx(v, [max(0.0, low), min(1.0, high)], ACCURACY).alias(f"s{j}"))
        proposed = cells.agg(*sketches).first()
        tried = {j: tuple(proposed[f"s{j}"]) for j in open_}
        counts = cells.agg(*[c for j, b in tried.items() for c in (F.count_if(F.col(f"v{at[j][0]}") < F.lit(b[0])).alias(f"b{j}"), F.count_if(within(j, b)).alias(f"i{j}"))]).first()
        still = []
        for j, b in tried.items():
            if not (counts[f"b{j}"] <= ranks[j][0] and ranks[j][1] < counts[f"b{j}"] + counts[f"i{j}"]):
                continue  # not confirmed: the wider bracket stays
            less = counts[f"i{j}"] < inside[j]
            brackets[j], below[j], inside[j] = b, counts[f"b{j}"], counts[f"i{j}"]
            if less and inside[j] > BRACKET_CELLS and b[0] < b[1]:
                still.append(j)
        open_ = still
    return brackets, below


def column_quantiles(df: DataFrame, cols: list[str], qs: list[float]) -> DataFrame:
    """One row with ``q{k}_{i}``: quantile ``qs[k]`` of column ``cols[i]``, exact, linearly
    interpolated, over values that are not null.

    Selection instead of sorting: sketches bracket each quantile, and only the cells inside the
    brackets (about 4 / ACCURACY of them) are grouped by value and counted off. ``df`` is read
    some three times, so it should be a written table.
    """
    cells = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    counted = cells.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(cols))]).first()
    n = [counted[f"n{i}"] for i in range(len(cols))]
    at = [(i, q) for i in range(len(cols)) for q in qs]
    brackets, below = _narrowed(cells, at, n)
    ranks = [(math.floor(q * (n[i] - 1)), math.ceil(q * (n[i] - 1))) for i, q in at]
    found = {j: (b[0], b[0]) for j, b in enumerate(brackets) if b[0] == b[1]}
    rest = [j for j, (i, _) in enumerate(at) if n[i] and j not in found]
    if rest:
        each = F.array(*[F.when(F.col(f"v{at[j][0]}").between(F.lit(brackets[j][0]), F.lit(brackets[j][1])), F.struct(F.lit(j).alias("j"), F.col(f"v{at[j][0]}").alias("v"))) for j in rest])
        values = cells.select(F.explode(F.array_compact(each)).alias("x")).groupBy("x.j", "x.v").agg(F.count(F.lit(1)).alias("m"))
        by_number = lambda items: F.element_at(F.array(*[F.lit(int(x)) for x in items]), F.col("j") + 1)
        end = by_number(below) + F.sum("m").over(Window.partitionBy("j").orderBy("v"))
        placed = values.withColumn("end", end).withColumn("begin", F.col("end") - F.col("m"))
        hit = lambda side: F.max(F.when((F.col("begin") <= by_number(r[side] for r in ranks)) & (by_number(r[side] for r in ranks) < F.col("end")), F.col("v")))
        found |= {r.j: (r.lo, r.hi) for r in placed.groupBy("j").agg(hit(0).alias("lo"), hit(1).alias("hi")).collect()}  # one row a quantile
    out = []
    for j, (i, q) in enumerate(at):
        value = None
        if j in found:
            lo, hi = found[j]
            place = q * (n[i] - 1)
            value = lo if ranks[j][0] == ranks[j][1] else (ranks[j][1] - place) * lo + (place - ranks[j][0]) * hi
        out.append(F.lit(value).cast("double").alias(f"q{qs.index(q)}_{i}"))
    return df.sparkSession.range(1).select(*out)
