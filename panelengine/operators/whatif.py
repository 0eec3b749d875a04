"""Batch what-if over a table of requests (the per-request services of the reference).

A request row carries an entity, a struct of levers (NULL = not given) and a horizon.  All
steps are column expressions on the request row after one equi-join with the per-entity
history context (one row per entity); nothing is looped per request.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, dbl, horizon_degradation, confidence_level, pct_change
from ..spec import DEFAULT_SPEC, LEVER_PRIORITY, LEVER_STRENGTH_TARGETS, LEVER_TIMELINE_WEEKS, LEVERS, PanelSpec
from .history import history_context

# Per-lever change thresholds (easy, moderate, hard) of the feasibility score
FEASIBILITY_THRESHOLDS = {
    "retention_rate": (0.02, 0.05, 0.10),
    "avg_ticket_price": (5.0, 20.0, 50.0),
    "class_attendance_rate": (0.03, 0.07, 0.15),
    "new_members": (5.0, 15.0, 30.0),
    "staff_utilization_rate": (0.05, 0.10, 0.20),
    "upsell_rate": (0.03, 0.08, 0.15),
    "total_classes_held": (10.0, 30.0, 60.0),
    "total_members": (10.0, 30.0, 60.0),
}


#: what a request of each template asks for: months ahead by entity number (0 and 13 are
#: outside the allowed 1..12)
REQUEST_KINDS = ("reported", "inside", "on_bounds", "outside", "partial")
UNKNOWN_ENTITY = -1


def _template_levers(kind: str, entity: Column, reported: set[str]) -> Column:
    fields = []
    for j, (lv, (lo, hi, _, is_int)) in enumerate(LEVERS.items()):
        even = F.pmod(entity + j, F.lit(2)) == 0
        share = (F.pmod(entity * 3 + j * 5, F.lit(8)) + 1) / dbl(10.0)
        inside = dbl(lo) + share * dbl(hi - lo)
        inside = F.rint(inside) if is_int else inside
        if kind == "reported":
            x = F.col(lv).cast("double") if lv in reported else F.lit(None).cast("double")
        elif kind == "inside":
            x = inside
        elif kind == "on_bounds":
            x = F.when(even, dbl(lo)).otherwise(dbl(hi))
        elif kind == "outside":
            x = F.when(even, dbl(lo - 0.1 * (hi - lo))).otherwise(dbl(hi + 0.1 * (hi - lo)))
        else:
            x = inside if lv in ("retention_rate", "avg_ticket_price") else F.lit(None).cast("double")
        fields.append(x.cast("double").alias(lv))
    return F.struct(*fields)


def request_table(panel: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Five requests per entity (one for each of REQUEST_KINDS), and one of an entity that the
    panel does not know.

    ``reported`` asks with the levers of the latest month as they are; the others are laid
    inside the lever bounds, on them, outside of them, and with two levers given. Requests
    of kind ``inside`` and even entities carry constraints, one of them without a value.
    """
    present = set(panel.columns)
    latest = panel.groupBy(spec.entity).agg(F.max_by(F.struct(*[F.col(lv) for lv in LEVERS if lv in present]), spec.month).alias("x"))
    latest = latest.select(F.col(spec.entity).cast("long").alias(spec.entity), "x.*")
    e = F.col(spec.entity)
    horizons = (F.lit(6), F.pmod(e, F.lit(14)), F.pmod(e + 5, F.lit(14)), F.lit(3), F.lit(4))
    items = [
        F.struct(F.lit(i).alias("no"), F.lit(kind).alias("kind"), _template_levers(kind, e, present).alias("levers"), h.cast("int").alias("projection_months"))
        for i, (kind, h) in enumerate(zip(REQUEST_KINDS, horizons))
    ]
    known = latest.select(spec.entity, F.explode(F.array(*items)).alias("r")).select(spec.entity, "r.*")
    stranger = panel.sparkSession.range(1).select(F.lit(UNKNOWN_ENTITY).cast("long").alias(spec.entity))
    stranger = stranger.select(
        spec.entity, F.lit(1).alias("no"), F.lit("inside").alias("kind"), _template_levers("inside", e, set()).alias("levers"), F.lit(3).alias("projection_months")
    )
    limits = (F.col("kind") == "inside") & (F.pmod(e, F.lit(2)) == 0)
    return known.unionByName(stranger).select(
        (e * 10 + F.col("no")).alias("request_id"),
        spec.entity,
        "kind",
        "levers",
        "projection_months",
        F.when(limits, F.struct(dbl(0.1).alias("max_retention_increase"), dbl(30.0).alias("max_ticket_increase"), F.lit(None).cast("double").alias("max_new_members_increase"))).alias("constraints"),
    )


def month_numbers(n: Column) -> Column:
    """1..n as an array; empty below 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))


def validate_levers(req: DataFrame) -> DataFrame:
    """Violated rules per request (lever outside its bounds, horizon outside 1..12)."""
    checks = []
    for lv, (lo, hi, _, _) in LEVERS.items():
        x = F.col(f"levers.{lv}")
        checks.append(F.when(x.isNotNull() & ((x < lo) | (x > hi)), F.lit(lv)))
    checks.append(F.when((F.col("projection_months") < 1) | (F.col("projection_months") > 12), F.lit("projection_months")))
    v = F.filter(F.array(*checks), lambda e: e.isNotNull())
    return req.select("request_id", v.alias("violations"), (F.size(v) == 0).alias("valid"))


def with_history(req: DataFrame, panel: DataFrame, spec: PanelSpec = DEFAULT_SPEC, n: int = 12) -> DataFrame:
    """requests LEFT JOIN the entity's last-n-month context (unknown entity -> NULLs, then
    defaults downstream)."""
    return req.join(history_context(panel, spec, n), spec.entity, "left")


def fill_missing_levers(df: DataFrame) -> DataFrame:
    """given -> mean of the last 12 months -> fixed default."""
    filled = []
    for lv, (_, _, default, _) in LEVERS.items():
        hist = F.col(f"hist_{lv}") if f"hist_{lv}" in df.columns else F.lit(None).cast("double")
        filled.append(F.coalesce(F.col(f"levers.{lv}"), hist.cast("double"), dbl(default)).alias(lv))
    return df.withColumn("filled", F.struct(*filled))


def clip_levers(df: DataFrame, src: str = "filled", dst: str = "clipped") -> DataFrame:
    """Clamp to lever bounds; integer levers rounded half-even."""
    out = []
    for lv, (lo, hi, _, is_int) in LEVERS.items():
        x = clip(F.col(f"{src}.{lv}"), lo, hi)
        if is_int:
            x = F.rint(x)
        out.append(x.alias(lv))
    return df.withColumn(dst, F.struct(*out))


def request_feature_columns(L: Callable[[str], Column], month_without_history: int | None = None, only: set[str] | None = None) -> dict[str, Column]:  # noqa: N803
    """Features of a request by name, from its levers (``L`` gives a lever's column) and its
    history context; see ``request_features``. ``only`` names the wanted ones."""
    c, one = F.col, dbl(1.0)
    m, r, price = L("total_members"), L("retention_rate"), L("avg_ticket_price")
    att, classes, util, upsell = L("class_attendance_rate"), L("total_classes_held"), L("staff_utilization_rate"), L("upsell_rate")
    membership = lambda: m * price
    class_pack = lambda: classes * 20 * att * 0.2 * 15
    retail = lambda: m * 10 * 0.3
    total = lambda: membership() + class_pack() + retail()
    staff = lambda: F.greatest(F.lit(5), F.floor(m / 25).cast("long"))
    has_hist = lambda: c("n_hist").isNotNull() & (c("n_hist") > 0)
    enough = lambda: has_hist() & (c("n_hist") >= 3)
    prev_rev = lambda: F.when(has_hist(), c("last_revenue")).otherwise(total())
    prev_mem = lambda: F.when(has_hist(), c("last_members")).otherwise(m)
    recent = lambda name, other: F.when(enough(), c(name)).otherwise(other)
    grown = lambda now, before: F.when(has_hist(), (now - before) / F.greatest(before, one)).otherwise(dbl(0.0))
    month = lambda: F.coalesce(F.month(c("last_month")), F.month(F.current_date()) if month_without_history is None else F.lit(month_without_history))
    angle = lambda: dbl(2 * math.pi) * month() / 12.0
    specs: dict[str, Callable[[], Column]] = {
        **{n: (lambda n=n: L(n)) for n in ("total_members", "new_members", "retention_rate", "avg_ticket_price", "class_attendance_rate", "total_classes_held", "staff_utilization_rate", "upsell_rate")},
        "churned_members": lambda: F.floor(m * (1 - r)).cast("long"),
        "membership_revenue": membership, "class_pack_revenue": class_pack, "retail_revenue": retail, "total_revenue": total,
        "staff_count": staff, "total_class_attendance": lambda: F.floor(classes * 20 * att).cast("long"),
        "revenue_per_member": lambda: total() / F.greatest(m, one), "churn_rate": lambda: 1 - r, "class_utilization": lambda: att,
        "staff_per_member": lambda: staff() / F.greatest(m, one), "estimated_ltv": lambda: price * r * 12,
        "membership_revenue_pct": lambda: membership() / F.greatest(total(), one),
        "class_pack_revenue_pct": lambda: class_pack() / F.greatest(total(), one),
        "prev_month_revenue": prev_rev, "prev_month_members": prev_mem,
        "3m_avg_retention": lambda: recent("tail3_avg_retention", r),
        "3m_avg_revenue": lambda: recent("tail3_avg_revenue", prev_rev()),
        "3m_avg_attendance": lambda: recent("tail3_avg_attendance", att),
        "3m_std_revenue": lambda: recent("tail3_std_revenue", dbl(0.0)),
        "revenue_momentum": lambda: recent("ewm_revenue", prev_rev()),
        "mom_revenue_growth": lambda: grown(total(), prev_rev()),
        "mom_member_growth": lambda: grown(m, prev_mem()),
        "retention_x_ticket": lambda: r * price, "attendance_x_classes": lambda: att * classes, "upsell_x_members": lambda: upsell * m,
        "staff_util_x_members": lambda: util * m,
        "month_index": month, "month_sin": lambda: F.sin(angle()), "month_cos": lambda: F.cos(angle()),
        "is_january": lambda: (month() == 1).cast("int"), "is_summer": lambda: month().isin(6, 7, 8).cast("int"), "is_fall": lambda: (month() == 9).cast("int"),
    }
    return {name: make() for name, make in specs.items() if only is None or name in only}


def request_features(df: DataFrame, levers: str = "clipped", month_without_history: int | None = None) -> DataFrame:
    """Feature row of a request from its levers and its history context (the serving-time
    formulas, which differ from the training ones).  Without history the lag / rolling
    inputs fall back to the request's own values, and the month is the given one (default:
    the current one)."""
    feats = request_feature_columns(lambda n: F.col(f"{levers}.{n}"), month_without_history)
    return df.select("*", *[v.alias(k) for k, v in feats.items()])


def lever_strength(df: DataFrame, levers: str = "clipped") -> DataFrame:
    rows = []
    for lv, target in LEVER_STRENGTH_TARGETS.items():
        perf = F.col(f"{levers}.{lv}") / F.lit(float(target))
        rows.append(F.struct(
            F.lit(lv).alias("lever"), F.col(f"{levers}.{lv}").alias("current"), F.lit(float(target)).alias("target"),
            perf.alias("performance"),
            F.when(perf >= 1.05, "strong").when(perf >= 0.95, "moderate").otherwise("weak").alias("strength"),
        ))
    return df.select("request_id", F.explode(F.array(*rows)).alias("s")).select("request_id", "s.*")


def feasibility(df: DataFrame, current: str, proposed: str) -> DataFrame:
    """Per-lever score 1 / .7 / .4 / .2 by |change| thresholds; mean -> difficulty class."""
    items = []
    for lv, (e, mo, h) in FEASIBILITY_THRESHOLDS.items():
        ch = F.abs(F.col(f"{proposed}.{lv}") - F.col(f"{current}.{lv}"))
        score = F.when(ch <= e, 1.0).when(ch <= mo, 0.7).when(ch <= h, 0.4).otherwise(0.2)
        diff = F.when(ch <= e, "easy").when(ch <= mo, "moderate").when(ch <= h, "hard").otherwise("very_hard")
        items.append(F.struct(F.lit(lv).alias("lever"), ch.alias("change_abs"), score.alias("score"), diff.alias("difficulty")))
    arr = F.array(*items)
    overall = F.aggregate(arr, dbl(0.0), lambda a, s: a + s["score"]) / len(items)
    return df.select(
        "request_id", arr.alias("lever_details"), overall.alias("overall_score"),
        F.when(overall >= 0.8, "easy").when(overall >= 0.6, "moderate").when(overall >= 0.4, "hard").otherwise("very_hard").alias("overall_difficulty"),
    )


def scaled_levers(src: str, factor: float) -> Column:
    """+x % on every lever, clipped (the quick-win / sensitivity probe)."""
    out = []
    for lv, (lo, hi, _, is_int) in LEVERS.items():
        x = clip(F.col(f"{src}.{lv}") * factor, lo, hi)
        out.append((F.rint(x) if is_int else x).alias(lv))
    return F.struct(*out)


def lever_quality(levers: str) -> Column:
    """0.7 + 0.3 (0.3 min(1, n/15) + 0.7 share of values in [0, 1000]) over the given levers."""
    vals = F.filter(F.array(*[F.col(f"{levers}.{lv}") for lv in LEVERS]), lambda x: x.isNotNull())
    n = F.size(vals)
    ok = F.size(F.filter(vals, lambda x: (x >= 0) & (x <= 1000)))
    q = 0.3 * F.least(dbl(1.0), n / 15.0) + 0.7 * (ok / n)
    return F.when(n == 0, dbl(0.75)).otherwise(0.7 + 0.3 * q)


# --- forecasts from model predictions (#186-#188) ------------------------------------


def forecast_monthly(df: DataFrame, pred_prefix: str = "predicted_", levers: str = "clipped") -> DataFrame:
    """One row per (request, month 1..h).  Months 1-3 come from the model (members
    interpolated from the current value, integer-truncated; retention current until month
    3); later months extrapolate revenue with g = (r3 - r1) / (3 r1), members flat."""
    p = lambda t: F.col(f"{pred_prefix}{t}")
    cur_m = F.col(f"{levers}.total_members")
    cur_r = F.col(f"{levers}.retention_rate")
    x = df.where(F.col("projection_months") <= 12).select("*", F.explode(month_numbers(F.col("projection_months"))).alias("month_ahead"))
    m = F.col("month_ahead")
    r1, r3 = p("revenue_month_1"), p("revenue_month_3")
    members3 = p("member_count_month_3").cast("long")
    g = (r3 - r1) / (3 * r1)
    revenue = (
        F.when(m == 1, r1).when(m == 2, p("revenue_month_2")).when(m == 3, r3)
        .otherwise(r3 * F.pow(1 + g, (m - 3).cast("double")))
    )
    members = F.when(m == 3, members3).when(m < 3, (cur_m + (p("member_count_month_3") - cur_m) * m / 3).cast("long")).otherwise(members3)
    retention = F.when(m >= 3, p("retention_rate_month_3")).otherwise(cur_r)
    conf = F.when(m <= 3, 0.85 - 0.05 * (m - 1)).otherwise(F.greatest(dbl(0.5), 0.80 - 0.05 * (m - 1)))
    return x.select("request_id", "month_ahead", revenue.alias("revenue"), members.alias("member_count"),
                    retention.alias("retention_rate"), conf.cast("double").alias("confidence_score"))


def forecast_totals(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("request_id").agg(
        F.sum("revenue").alias("total_projected_revenue"), F.avg("confidence_score").alias("average_confidence"),
        F.count(F.lit(1)).alias("months"),
    )


# --- sensitivity (#132, #195-#197) --------------------------------------------------------

# Implementation effort per lever
LEVER_EFFORT = {
    "avg_ticket_price": "low", "upsell_rate": "low",
    "class_attendance_rate": "medium", "staff_utilization_rate": "medium", "total_classes_held": "medium",
    "total_members": "high", "retention_rate": "high", "new_members": "high",
}


def lever_variations(df: DataFrame, changes=(-20, -10, 10, 20), src: str = "clipped") -> DataFrame:
    """Each request x lever x change %: the varied lever struct (clamped, not rounded) with the
    lever's old and new value.  A fixed-size fan-out by ``explode`` of a literal grid (levers
    x changes rows per request), no join."""
    grid = F.array(*[F.struct(F.lit(lv).alias("lever"), F.lit(float(c)).alias("change_pct")) for lv in LEVERS for c in changes])
    x = df.withColumn("v", F.explode(grid))
    fields, old, new = [], F.lit(None).cast("double"), F.lit(None).cast("double")
    for lv, (lo, hi, _, _) in LEVERS.items():
        base = F.col(f"{src}.{lv}")
        moved = clip(base * (1 + F.col("v.change_pct") / 100.0), lo, hi)
        hit = F.col("v.lever") == lv
        fields.append(F.when(hit, moved).otherwise(base).alias(lv))
        old, new = F.when(hit, base).otherwise(old), F.when(hit, moved).otherwise(new)
    return x.select("*", F.struct(*fields).alias("varied"), F.col("v.lever").alias("lever"), F.col("v.change_pct").alias("change_pct"), old.alias("old_value"), new.alias("new_value")).drop("v")


def average_sensitivity(varied: DataFrame) -> DataFrame:
    """Mean |revenue change per 1 % of lever change that took effect| by request and lever, over
    variations that moved the lever (0 where none did), ranked."""
    moved = F.when(F.col("old_value") > 0, (F.col("new_value") - F.col("old_value")) / F.col("old_value") * 100).otherwise(0.0)
    per_pct = F.when(moved != 0, F.abs((F.col("varied_revenue") - F.col("base_revenue")) / moved))
    g = varied.groupBy("request_id", "lever").agg(F.coalesce(F.avg(per_pct), dbl(0.0)).alias("average_sensitivity"))
    w = Window.partitionBy("request_id").orderBy(F.desc(F.round("average_sensitivity", 6)), "lever")
    return g.withColumn("rank", F.row_number().over(w))


# --- inverse search (#199-#211) -------------------------------------------------------------

# What a request may ask to be limited, and the increase if it gives none
INCREASE_LIMITS = {
    "retention_rate": ("max_retention_increase", 0.05),
    "avg_ticket_price": ("max_ticket_increase", 20.0),
    "new_members": ("max_new_members_increase", 10.0),
}
#: rounds of the search, and steps to either side in each; every round is ten times finer
SEARCH_ROUNDS, SEARCH_STEPS = 5, 10


def optimization_bounds(df: DataFrame, current: str = "clipped", constraints: str = "constraints") -> DataFrame:
    """Per-lever search interval: the global bounds; with constraints, retention, ticket and new
    members run from their current value to it plus the allowed increase (only retention is
    held to the global maximum)."""
    given = F.col(constraints).isNotNull()
    fields = []
    for lv, (lo, hi, _, _) in LEVERS.items():
        low, high = dbl(lo), dbl(hi)
        if lv in INCREASE_LIMITS:
            name, default = INCREASE_LIMITS[lv]
            x = F.col(f"{current}.{lv}")
            top = x + F.coalesce(F.col(f"{constraints}.{name}"), dbl(default))
            low, high = F.when(given, x).otherwise(low), F.when(given, F.least(top, dbl(hi)) if lv == "retention_rate" else top).otherwise(high)
        fields.append(F.struct(low.alias("lo"), high.alias("hi")).alias(lv))
    return df.withColumn("bounds", F.struct(*fields))


def rounded_levers(src: str) -> Column:
    """The levers as they are reported and scored: whole numbers where they are counts."""
    return F.struct(*[(F.rint(F.col(f"{src}.{lv}")) if is_int else F.col(f"{src}.{lv}")).alias(lv) for lv, (_, _, _, is_int) in LEVERS.items()])


def objective_single(revenue: Column, target: Column, current: str, cand: str) -> Column:
    """(revenue - target)^2 + 1e-4 * sum((x - x0)^2)."""
    reg = sum(((F.col(f"{cand}.{lv}") - F.col(f"{current}.{lv}")) * (F.col(f"{cand}.{lv}") - F.col(f"{current}.{lv}")) for lv in LEVERS), dbl(0.0))
    return (revenue - target) * (revenue - target) + 1e-4 * reg


def objective_multi(revenue: Column, target: Column, current: str, cand: str, objectives=("revenue", "retention", "growth")) -> Column:
    """Relative squared revenue error - 0.3 x retention gain - 0.2 x 0.001 x member gain + 0.1 x
    mean relative lever change. A lever that stands at 0 adds nothing to the mean."""
    x, y = (lambda lv: F.col(f"{cand}.{lv}")), (lambda lv: F.col(f"{current}.{lv}"))
    err = (revenue - target) / target
    cost = sum((F.coalesce(F.abs(F.try_divide(x(lv) - y(lv), y(lv))), dbl(0.0)) for lv in LEVERS), dbl(0.0)) / float(len(LEVERS))
    keep = 0.3 if "retention" in objectives else 0.0
    grow = 0.2 if "growth" in objectives else 0.0
    members = F.rint(x("total_members"))
    return err * err - keep * (x("retention_rate") - y("retention_rate")) - grow * (members - y("total_members")) * 0.001 + 0.1 * cost


def line_search(df: DataFrame, revenue_of, keys: list[str], current: str = "clipped") -> DataFrame:
    """Levers that bring the predicted revenue to ``target_revenue``.

    All levers move together along the way from their current values (f = 0) to the upper
    (f = 1) or lower (f = -1) ends of ``bounds``; each of SEARCH_ROUNDS rounds tries 21 places
    about the best so far, ten times nearer to each other than before, and keeps the one with
    the least single objective (ties: the nearest to 0). ``revenue_of(frame, levers)`` returns
    the frame with the column ``revenue`` predicted for the struct ``levers``. Rounds are
    a fixed fan-out and a grouped minimum. Adds f, optimized (as searched), revenue, objective.
    """
    carried = [c for c in df.columns if c not in keys]
    state = df.withColumn("f", dbl(0.0))
    for r in range(SEARCH_ROUNDS):
        steps = F.explode(F.sequence(F.lit(-SEARCH_STEPS), F.lit(SEARCH_STEPS))).alias("_k")
        x = state.select("*", steps)
        x = x.withColumn("f", F.least(F.greatest(F.col("f") + F.col("_k").cast("double") / dbl(10.0 ** (r + 1)), dbl(-1.0)), dbl(1.0)))
        fields = []
        for lv in LEVERS:
            a, lo, hi = F.col(f"{current}.{lv}"), F.col(f"bounds.{lv}.lo"), F.col(f"bounds.{lv}.hi")
            fields.append(F.when(F.col("f") >= 0, a + F.col("f") * (hi - a)).otherwise(a - F.col("f") * (lo - a)).alias(lv))
        x = x.withColumn("optimized", F.struct(*fields)).withColumn("_scored", rounded_levers("optimized"))
        x = revenue_of(x, "_scored")
        x = x.withColumn("objective", objective_single(F.col("revenue"), F.col("target_revenue"), current, "optimized"))
        pick = F.struct(F.col("objective"), F.abs("f"), F.col("f"))
        best = x.groupBy(*keys).agg(F.min_by(F.struct(*carried, "f", "optimized", "revenue", "objective"), pick).alias("b"))
        state = best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in (*carried, "f")], F.col("b.optimized"), F.col("b.revenue"), F.col("b.objective"))
        if r < SEARCH_ROUNDS - 1:
            state = state.drop("optimized", "revenue", "objective")
    return state


def probe_levers(df: DataFrame, src: str = "optimized") -> DataFrame:
    """One row per lever: the levers with it raised by 1 % (by 0.01 from 0), clamped."""
    items = []
    for lv, (lo, hi, _, _) in LEVERS.items():
        x = F.col(f"{src}.{lv}")
        moved = clip(x + F.when(x * 0.01 == 0, dbl(0.01)).otherwise(x * 0.01), lo, hi)
        items.append(F.struct(F.lit(lv).alias("lever"), F.struct(*[(moved if o == lv else F.col(f"{src}.{o}")).alias(o) for o in LEVERS]).alias("probe")))
    return df.select("*", F.explode(F.array(*items)).alias("_p")).select("*", F.col("_p.lever").alias("lever"), F.col("_p.probe").alias("probe")).drop("_p")


PERTURBATIONS = 20
_MODULUS, _FACTOR = 2147483647, 48271


def hashed_uniform(*parts: Column) -> Column:
    """In (0, 1), from a multiplicative congruential hash that SQL can follow: the parts are
    combined by prime multipliers and mixed three times modulo 2^31 - 1."""
    h = F.lit(12345).cast("long")
    for p, m in zip(parts, (7919, 104729, 1299709, 15485863)):
        h = h + p.cast("long") * m
    h = F.pmod(h, F.lit(_MODULUS))
    for _ in range(3):
        h = F.pmod(h * _FACTOR + 11, F.lit(_MODULUS))
    return (h.cast("double") + 0.5) / dbl(float(_MODULUS))


def perturbed_levers(df: DataFrame, src: str = "optimized", n: int = PERTURBATIONS) -> DataFrame:
    """``n`` rows per request: the levers with N(0, 0.01) added (hashed draws), clamped."""
    x = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    fields = []
    for j, (lv, (lo, hi, _, _)) in enumerate(LEVERS.items()):
        u1 = hashed_uniform(F.col("request_id"), F.col("draw"), F.lit(2 * j))
        u2 = hashed_uniform(F.col("request_id"), F.col("draw"), F.lit(2 * j + 1))
        z = F.sqrt(-2.0 * F.log(u1)) * F.cos(dbl(2 * math.pi) * u2)
        fields.append(clip(F.col(f"{src}.{lv}") + 0.01 * z, lo, hi).alias(lv))
    return x.withColumn("perturbed", F.struct(*fields))


def uncertainty(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, population std, central 95 % and coefficient of variation of ``revenue`` over the
    perturbations (a fixed number per request, so the percentile buffers are bounded)."""
    return scored.groupBy(*keys).agg(
        F.avg("revenue").alias("mean_revenue"), F.stddev_pop("revenue").alias("std_revenue"),
        F.percentile("revenue", F.lit(0.025)).alias("revenue_low"), F.percentile("revenue", F.lit(0.975)).alias("revenue_high"),
        F.when(F.avg("revenue") > 0, F.stddev_pop("revenue") / F.avg("revenue")).otherwise(0.0).alias("cv"),
    )


def optimization_confidence(success: Column, achieved: Column, target: Column, feasibility_score: Column, cv: Column) -> Column:
    rate = F.when(target > 0, achieved / target).otherwise(0.0)
    c = F.when(success, 0.7).otherwise(0.4) + F.when(rate >= 0.95, 0.15).when(rate >= 0.85, 0.10).when(rate >= 0.75, 0.05).otherwise(-0.10)
    c = c * (0.7 + 0.3 * feasibility_score) + F.when(cv < 0.05, 0.05).when(cv > 0.15, -0.10).otherwise(0.0)
    return F.least(F.greatest(c, dbl(0.0)), dbl(1.0))


def change_priority(lever: Column, change_pct: Column) -> Column:
    """1 first; a change of more than 10 % moves up by one."""
    base = F.create_map(*[x for lv, p in LEVER_PRIORITY.items() for x in (F.lit(lv), F.lit(p))])[lever]
    return F.when(F.abs(change_pct) > 10, F.greatest(F.lit(1), base - 1)).otherwise(base)


def lever_changes(df: DataFrame, keys: list[str], current: str = "clipped", proposed: str = "recommended") -> DataFrame:
    """Levers that change by more than 0.001, with difficulty, score and priority."""
    items = []
    for lv, (e, mo, h) in FEASIBILITY_THRESHOLDS.items():
        a, b = F.col(f"{current}.{lv}"), F.col(f"{proposed}.{lv}")
        ch = F.abs(b - a)
        items.append(F.struct(
            F.lit(lv).alias("lever"), a.alias("current"), b.alias("proposed"), (b - a).alias("change"), pct_change(b, a).alias("change_pct"),
            F.when(ch <= e, "easy").when(ch <= mo, "moderate").when(ch <= h, "hard").otherwise("very_hard").alias("difficulty"),
            F.when(ch <= e, 1.0).when(ch <= mo, 0.7).when(ch <= h, 0.4).otherwise(0.2).alias("feasibility_score"),
        ))
    x = df.select(*keys, F.explode(F.array(*items)).alias("c")).select(*keys, "c.*").where(F.abs(F.col("change")) > 0.001)
    return x.withColumn("priority", change_priority(F.col("lever"), F.col("change_pct")))


def action_plan(changes: DataFrame, impact: str, key: str = "request_id", top: int = 6) -> DataFrame:
    """The ``top`` changes by priority (ties by lever order); ``impact`` is shared among them by
    |sensitivity|, equally if none has any; hard changes take 1.5 and very hard ones 2 times
    the lever's weeks, whole weeks only."""
    order = F.create_map(*[x for i, lv in enumerate(LEVERS) for x in (F.lit(lv), F.lit(i))])[F.col("lever")]
    x = changes.withColumn("step", F.row_number().over(Window.partitionBy(key).orderBy("priority", order))).where(F.col("step") <= top)
    w = Window.partitionBy(key)
    total = F.sum(F.abs("sensitivity")).over(w)
    share = F.when(total > 0, F.abs("sensitivity") / total).otherwise(1.0 / F.count(F.lit(1)).over(w))
    weeks = F.create_map(*[v for lv, n in LEVER_TIMELINE_WEEKS.items() for v in (F.lit(lv), F.lit(n))])[F.col("lever")]
    factor = F.when(F.col("difficulty") == "hard", 1.5).when(F.col("difficulty") == "very_hard", 2.0).otherwise(1.0)
    return x.select(key, "step", "lever", "change_pct", "difficulty", "sensitivity", (F.col(impact) * share).alias("expected_impact"), F.floor(weeks * factor).cast("int").alias("timeline_weeks"))


# --- partial prediction (#189, #191, #192, #194) ----------------------------------------------


def month_states(df: DataFrame, levers: str = "clipped", prefix: str = "predicted_") -> DataFrame:
    """One row per request and month: revenue, members and retention as the model implies them.
    Members close a third, two thirds and all of the gap to the month-3 prediction, each time
    from the month before; retention is the current one until month 3; revenue grows by
    (r3 - r1) / (3 r1) a month after that, members and retention stay."""
    p = lambda t: F.col(f"{prefix}{t}")
    x = df.where(F.col("projection_months") <= 12).select("*", F.explode(month_numbers(F.col("projection_months"))).alias("month_ahead"))
    m = F.col("month_ahead")
    r1, r3 = p("revenue_month_1"), p("revenue_month_3")
    revenue = F.when(m == 1, r1).when(m == 2, p("revenue_month_2")).when(m == 3, r3).otherwise(r3 * F.pow(1 + (r3 - r1) / (3 * r1), (m - 3).cast("double")))
    now, then = F.col(f"{levers}.total_members"), p("member_count_month_3")
    first = now + (then - now) * (dbl(1.0) / 3)
    members = F.when(m == 1, first).when(m == 2, first + (then - first) * (dbl(2.0) / 3)).otherwise(then)
    r0, later = F.col(f"{levers}.retention_rate"), p("retention_rate_month_3")
    retention = F.when(m <= 2, r0).when(m == 3, later).otherwise(clip(later, 0.5, 1.0))
    return x.select("*", revenue.alias("state_revenue"), members.alias("state_members"), retention.alias("state_retention"))


def predict_levers_sequentially(states: DataFrame, outputs: list[str], levers: str = "clipped") -> DataFrame:
    """Month by month, the levers that the main model does not predict, each by its linear
    lever model on the state of the month (column ``lever_models``: map lever -> struct
    (intercept, coefs in lever order), null where the entity has no model). Predictions enter
    the state, so later levers and months build on them. Rows (request, month, lever, value,
    confidence); a request has at most 12 months, which are folded in one row.
    """
    names = list(LEVERS)
    months = F.array_sort(F.collect_list(F.struct("month_ahead", "state_members", "state_retention")))
    g = states.groupBy("request_id").agg(months.alias("months"), F.first(levers).alias("now"), F.first("lever_models", ignorenulls=True).alias("lever_models"))
    start = F.struct(F.array(*[F.col(f"now.{lv}") for lv in names]).alias("state"), F.array().cast("array<struct<month:int,lever:string,value:double,confidence:double>>").alias("out"))

    def step(acc, s):
        value = {lv: acc["state"][i] for i, lv in enumerate(names)}
        value["total_members"], value["retention_rate"] = s["state_members"], s["state_retention"]
        rows = []
        for lv in outputs:
            model = F.col("lever_models")[lv]
            lo, hi, _, _ = LEVERS[lv]
            guess = model["intercept"]
            for i, other in enumerate(names):
                guess = guess + model["coefs"][i] * value[other]
            known = model.isNotNull()
            old = value[lv]
            value[lv] = F.when(known, clip(guess, lo, hi)).otherwise(old)
            late = (s["month_ahead"] - 1) * 0.05
            conf = F.greatest(dbl(0.5), F.when(known, 0.70 - late).otherwise(0.65 - late))
            rows.append(F.struct(s["month_ahead"].alias("month"), F.lit(lv).alias("lever"), value[lv].alias("value"), conf.cast("double").alias("confidence")))
        return F.struct(F.array(*[value[lv] for lv in names]).alias("state"), F.concat(acc["out"], F.array(*rows)).alias("out"))

    folded = g.select("request_id", F.aggregate("months", start, step, lambda acc: acc["out"]).alias("out"))
    return folded.select("request_id", F.explode("out").alias("o")).select("request_id", F.col("o.month").alias("month_ahead"), "o.lever", F.col("o.value").alias("predicted_value"), F.col("o.confidence").alias("confidence"))


def partial_summary(monthly: DataFrame) -> DataFrame:
    """Per request and lever: the sum over months for revenue, else the mean; mean confidence,
    least and largest value."""
    return monthly.groupBy("request_id", "lever").agg(
        F.when(F.first("lever") == "total_revenue", F.sum("predicted_value")).otherwise(F.avg("predicted_value")).alias("predicted_value"),
        F.avg("confidence").alias("confidence"), F.min("predicted_value").alias("low"), F.max("predicted_value").alias("high"), F.count(F.lit(1)).alias("months"),
    )


def lever_evolution(df: DataFrame, levers: str = "filled", confidence: float = 0.7) -> DataFrame:
    """How each lever moves by itself over the months: by the entity's six-month trend or a
    typical monthly change, clamped every month; staff use closes a tenth of its first gap to
    0.85, members gain the new ones and lose the churned of the first month."""
    x = df.where(F.col("projection_months") <= 12)
    items = []
    for lv in LEVERS:
        v = F.col(f"{levers}.{lv}")
        t = F.coalesce(F.col(f"trend_{lv}"), dbl(0.0)) if f"trend_{lv}" in df.columns else dbl(0.0)
        t = F.when(F.col("n_hist") > 3, t).otherwise(dbl(0.0))
        change = {
            "retention_rate": F.when(F.abs(t) > 0.001, t).otherwise(dbl(0.002)),
            "class_attendance_rate": F.when(F.abs(t) > 0.001, t).otherwise(dbl(0.0)),
            "new_members": F.when(F.abs(t) > 0.1, t).otherwise(dbl(0.5)),
            "staff_utilization_rate": (0.85 - v) * 0.1,
            "upsell_rate": dbl(0.005),
            "total_classes_held": F.when(F.abs(t) > 0.1, t).otherwise(dbl(1.0)),
            "total_members": F.col(f"{levers}.new_members") - v * (1 - F.col(f"{levers}.retention_rate")),
        }.get(lv, dbl(0.0))
        lo, hi, _, _ = LEVERS[lv]
        items.append(F.struct(F.lit(lv).alias("lever"), v.alias("v"), change.alias("change"), dbl(lo).alias("lo"), dbl(hi).alias("hi")))
    x = x.select("request_id", "projection_months", F.explode(F.array(*items)).alias("l"))
    clamp = lambda y: F.least(F.greatest(y, F.col("l.lo")), F.col("l.hi"))
    path = F.aggregate(
        month_numbers(F.col("projection_months")),
        F.array().cast("array<double>"),
        lambda acc, i: F.concat(acc, F.array(clamp(F.when(i == 1, F.col("l.v")).otherwise(F.element_at(acc, -1) + F.col("l.change"))))),
    )
    x = x.select("request_id", F.col("l.lever").alias("lever"), F.posexplode(path).alias("pos", "predicted_value"))
    return x.select("request_id", "lever", (F.col("pos") + 1).alias("month_ahead"), "predicted_value", F.greatest(dbl(0.5), confidence - F.col("pos") * 0.05).cast("double").alias("confidence"))


# --- per-entity lever models (#190) ---------------------------------------------------------


def fit_lever_ridge(panel: DataFrame, levers: list[str], spec: PanelSpec = DEFAULT_SPEC, n: int = 12, alpha: float = 1.0) -> DataFrame:
    """For every entity and lever: ridge (``alpha``, free intercept, raw inputs) of the lever on
    the others over the entity's last ``n`` months. Needs 5 months, 2 inputs, 3 rows with all
    inputs, and the lever itself in each of those.

    The sums behind the normal equations are aggregates, so only they are shuffled; the small
    systems of a batch of entities are solved at once as stacked arrays.
    """
    import numpy as np
    import pandas as pd

    from .history import last_n_per_entity

    k = len(levers)
    rows = last_n_per_entity(panel.select(spec.entity, spec.month, *[F.col(lv).cast("double").alias(lv) for lv in levers]), n, spec)
    # shifted by the entity's first values, so that the sums stay well conditioned
    shifts = rows.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("_rows"), *[F.avg(lv).alias(f"_s{i}") for i, lv in enumerate(levers)])
    x = rows.join(shifts, spec.entity)
    z = [F.col(lv) - F.col(f"_s{i}") for i, lv in enumerate(levers)]
    aggs = []
    for t in range(k):  # a target uses the rows that have all other levers
        full = F.lit(True)
        for i in range(k):
            if i != t:
                full = full & z[i].isNotNull()
        aggs += [F.count_if(full).alias(f"n{t}"), F.count_if(full & z[t].isNull()).alias(f"bad{t}")]
        aggs += [F.sum(F.when(full, z[i])).alias(f"m{t}_{i}") for i in range(k)]
        aggs += [F.sum(F.when(full, z[i] * z[j])).alias(f"c{t}_{i}_{j}") for i in range(k) for j in range(i, k)]
    sums = x.groupBy(spec.entity).agg(F.first("_rows").alias("_rows"), *[F.first(f"_s{i}").alias(f"_s{i}") for i in range(k)], *aggs)

    def solve(batches):
        for pdf in batches:
            out = []
            shift = pdf[[f"_s{i}" for i in range(k)]].to_numpy(float)
            for t in range(k):
                use = [i for i in range(k) if i != t]
                rows_ = pdf[f"n{t}"].to_numpy(float)
                ok = (pdf["_rows"].to_numpy() >= 5) & (rows_ >= 3) & (pdf[f"bad{t}"].to_numpy() == 0) & (len(use) >= 2)
                if not ok.any():
                    continue
                mean = pdf[[f"m{t}_{i}" for i in range(k)]].to_numpy(float)[ok] / rows_[ok, None]
                c = np.zeros((ok.sum(), k, k))
                for i in range(k):
                    for j in range(i, k):
                        c[:, i, j] = c[:, j, i] = pdf[f"c{t}_{i}_{j}"].to_numpy(float)[ok]
                c -= rows_[ok, None, None] * mean[:, :, None] * mean[:, None, :]
                w = np.linalg.solve(c[:, use][:, :, use] + alpha * np.eye(len(use)), c[:, use, t][..., None])[..., 0]
                at = mean + shift[ok]
                intercept = at[:, t] - (w * at[:, use]).sum(1)
                for e, n_rows, ws, b in zip(pdf[spec.entity].to_numpy()[ok], rows_[ok], w, intercept):
                    out += [(int(e), levers[t], levers[i], float(v), float(b), int(n_rows)) for i, v in zip(use, ws)]
            yield pd.DataFrame(out, columns=[spec.entity, "lever", "input", "coef", "intercept", "n_rows"])

    return sums.mapInPandas(solve, f"{spec.entity} long, lever string, input string, coef double, intercept double, n_rows long")


def lever_model_maps(fitted: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """``fit_lever_ridge`` as one row per entity with the map that
    ``predict_levers_sequentially`` reads (coefficient 0 for levers that are no input)."""
    pairs = F.map_from_entries(F.collect_list(F.struct("input", "coef")))
    one = fitted.groupBy(spec.entity, "lever").agg(F.first("intercept").alias("intercept"), pairs.alias("by_input"))
    coefs = F.array(*[F.coalesce(F.col("by_input")[lv], dbl(0.0)) for lv in LEVERS])
    one = one.select(spec.entity, F.struct(F.col("lever"), F.struct(F.col("intercept"), coefs.alias("coefs")).alias("model")).alias("entry"))
    return one.groupBy(spec.entity).agg(F.map_from_entries(F.collect_list("entry")).alias("lever_models"))
