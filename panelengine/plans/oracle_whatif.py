"""DuckDB SQL for the request queries. All constants (lever bounds, defaults, thresholds,
coefficients) are written out here again, so that a wrong one in the operators shows."""

from __future__ import annotations

from .oracle_panel import r2, with_panel

#: lever: lowest, highest, default, whole number
B = {
    "retention_rate": (0.5, 1.0, 0.75, False),
    "avg_ticket_price": (50.0, 500.0, 150.0, False),
    "class_attendance_rate": (0.4, 1.0, 0.70, False),
    "new_members": (0.0, 100.0, 20.0, True),
    "staff_utilization_rate": (0.6, 1.0, 0.80, False),
    "upsell_rate": (0.0, 0.5, 0.25, False),
    "total_classes_held": (50.0, 500.0, 100.0, True),
    "total_members": (50.0, 1000.0, 180.0, True),
}
LV = list(B)
#: levers that the panel reports
PRESENT = ("retention_rate", "avg_ticket_price", "class_attendance_rate", "new_members", "upsell_rate", "total_classes_held", "total_members")
#: month for requests of entities without history
FALLBACK_MONTH = 6


def d(x: float) -> str:
    """A DOUBLE literal (a plain one with a point would be a DECIMAL)."""
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


def pmod(x: str, n: int) -> str:
    return f"(((({x}) % {n}) + {n}) % {n})"


def clip(x: str, lv: str) -> str:
    return f"least(greatest({x}, {d(B[lv][0])}), {d(B[lv][1])})"


def _inside(j: int, lv: str) -> str:
    lo, hi, _, whole = B[lv]
    x = f"({d(lo)} + (({pmod(f'entity_id * 3 + {j * 5}', 8)} + 1) / {d(10)}) * {d(hi - lo)})"
    return f"round_even({x}, 0)" if whole else x


def _requests() -> str:
    def select(no, kind, months, value, source="latest"):
        return (
            f"SELECT entity_id * 10 + {no} AS request_id, entity_id, '{kind}' AS kind, CAST({months} AS INTEGER) AS projection_months, "
            + ", ".join(f"CAST({value(j, lv)} AS DOUBLE) AS in_{lv}" for j, lv in enumerate(LV)) + f" FROM {source}"
        )

    even = lambda j: f"{pmod(f'entity_id + {j}', 2)} = 0"
    wide = lambda lv: 0.1 * (B[lv][1] - B[lv][0])
    parts = [
        select(0, "reported", 6, lambda j, lv: lv if lv in PRESENT else "NULL"),
        select(1, "inside", pmod("entity_id", 14), _inside),
        select(2, "on_bounds", pmod("entity_id + 5", 14), lambda j, lv: f"CASE WHEN {even(j)} THEN {d(B[lv][0])} ELSE {d(B[lv][1])} END"),
        select(3, "outside", 3, lambda j, lv: f"CASE WHEN {even(j)} THEN {d(B[lv][0] - wide(lv))} ELSE {d(B[lv][1] + wide(lv))} END"),
        select(4, "partial", 4, lambda j, lv: _inside(j, lv) if lv in ("retention_rate", "avg_ticket_price") else "NULL"),
        select(1, "inside", 3, _inside, "(SELECT CAST(-1 AS BIGINT) AS entity_id)"),
    ]
    return "latest AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY month DESC) = 1),\nreq AS (" + "\nUNION ALL ".join(parts) + ")"


HISTORY = (
    "hc AS (SELECT entity_id, count(*) AS n_hist, max_by(total_revenue, month) AS last_revenue, max_by(total_members, month) AS last_members, "
    "max(month) AS last_month, avg(CASE WHEN rk <= 3 THEN retention_rate END) AS tail3_avg_retention, "
    "avg(CASE WHEN rk <= 3 THEN total_revenue END) AS tail3_avg_revenue, avg(CASE WHEN rk <= 3 THEN class_attendance_rate END) AS tail3_avg_attendance, "
    "stddev_samp(CASE WHEN rk <= 3 THEN total_revenue END) AS tail3_std_revenue, "
    "sum(power(0.5, rk - 1) * total_revenue) / sum(power(0.5, rk - 1)) AS ewm_revenue, avg(total_revenue) AS mean_revenue, "
    + ", ".join(f"avg({lv}) AS hist_{lv}" for lv in PRESENT) + ", "
    + ", ".join(f"CAST((max_by({{'v': {lv}}}, -rk) FILTER (rk <= 6)).v - (max_by({{'v': {lv}}}, rk) FILTER (rk <= 6)).v AS DOUBLE) / count(*) FILTER (rk <= 6) AS trend_{lv}" for lv in PRESENT)
    + " FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY month DESC) AS rk FROM panel) WHERE rk <= 12 GROUP BY entity_id)"
)


def _fill(lv: str) -> str:
    return f"coalesce(in_{lv}, {f'hist_{lv}' if lv in PRESENT else 'CAST(NULL AS DOUBLE)'}, {d(B[lv][2])})"


def _clipped(lv: str) -> str:
    x = clip(_fill(lv), lv)
    return f"round_even({x}, 0)" if B[lv][3] else x


FILLED = (
    "rf AS (SELECT req.*, hc.* EXCLUDE (entity_id), " + ", ".join(f"{_fill(lv)} AS f_{lv}" for lv in LV) + ", "
    + ", ".join(f"{_clipped(lv)} AS c_{lv}" for lv in LV) + " FROM req LEFT JOIN hc USING (entity_id))"
)


def wsql(body: str, extra: str = "") -> str:
    ctes = ",\n".join([_requests(), HISTORY, FILLED] + ([extra] if extra else []))
    return with_panel(body, extra_ctes=ctes)


def feature_sql(prefix: str = "c_", history: bool = True) -> dict[str, str]:
    """Feature -> SQL over columns ``<prefix><lever>`` and the history columns."""
    c = lambda n: prefix + n
    m, r, price, att = c("total_members"), c("retention_rate"), c("avg_ticket_price"), c("class_attendance_rate")
    classes, util, ups = c("total_classes_held"), c("staff_utilization_rate"), c("upsell_rate")
    memb, cp, ret = f"({m} * {price})", f"({classes} * 20 * {att} * {d(0.2)} * 15)", f"({m} * 10 * {d(0.3)})"
    tot = f"({memb} + {cp} + {ret})"
    staff = f"greatest(5, CAST(floor({m} / 25) AS BIGINT))"
    has, enough = ("(n_hist IS NOT NULL AND n_hist > 0)", "(n_hist IS NOT NULL AND n_hist >= 3)") if history else ("false", "false")
    prev_rev, prev_mem = f"(CASE WHEN {has} THEN last_revenue ELSE {tot} END)", f"(CASE WHEN {has} THEN last_members ELSE {m} END)"
    month = f"coalesce(month(last_month), {FALLBACK_MONTH})"
    return {
        **{lv: c(lv) for lv in LV},
        "churned_members": f"CAST(floor({m} * (1 - {r})) AS BIGINT)", "membership_revenue": memb, "class_pack_revenue": cp, "retail_revenue": ret,
        "total_revenue": tot, "staff_count": staff, "total_class_attendance": f"CAST(floor({classes} * 20 * {att}) AS BIGINT)",
        "revenue_per_member": f"{tot} / greatest({m}, {d(1)})", "churn_rate": f"1 - {r}", "class_utilization": att,
        "staff_per_member": f"{staff} / greatest({m}, {d(1)})", "estimated_ltv": f"{price} * {r} * 12",
        "membership_revenue_pct": f"{memb} / greatest({tot}, {d(1)})", "class_pack_revenue_pct": f"{cp} / greatest({tot}, {d(1)})",
        "prev_month_revenue": prev_rev, "prev_month_members": prev_mem,
        "3m_avg_retention": f"CASE WHEN {enough} THEN tail3_avg_retention ELSE {r} END",
        "3m_avg_revenue": f"CASE WHEN {enough} THEN tail3_avg_revenue ELSE {prev_rev} END",
        "3m_avg_attendance": f"CASE WHEN {enough} THEN tail3_avg_attendance ELSE {att} END",
        "3m_std_revenue": f"CASE WHEN {enough} THEN tail3_std_revenue ELSE {d(0)} END",
        "revenue_momentum": f"CASE WHEN {enough} THEN ewm_revenue ELSE {prev_rev} END",
        "mom_revenue_growth": f"CASE WHEN {has} THEN ({tot} - {prev_rev}) / greatest({prev_rev}, {d(1)}) ELSE {d(0)} END",
        "mom_member_growth": f"CASE WHEN {has} THEN ({m} - {prev_mem}) / greatest({prev_mem}, {d(1)}) ELSE {d(0)} END",
        "retention_x_ticket": f"{r} * {price}", "attendance_x_classes": f"{att} * {classes}", "upsell_x_members": f"{ups} * {m}",
        "staff_util_x_members": f"{util} * {m}",
        "month_index": month, "month_sin": f"sin({d(6.283185307179586)} * {month} / {d(12)})", "month_cos": f"cos({d(6.283185307179586)} * {month} / {d(12)})",
        "is_january": f"CAST({month} = 1 AS INTEGER)", "is_summer": f"CAST({month} IN (6, 7, 8) AS INTEGER)", "is_fall": f"CAST({month} = 9 AS INTEGER)",
    }


WHOLE = ("churned_members", "staff_count", "total_class_attendance", "prev_month_members", "month_index", "is_january", "is_summer", "is_fall")

MODEL_FEATURES = (
    "total_members", "avg_ticket_price", "retention_rate", "class_attendance_rate", "new_members", "total_classes_held",
    "upsell_x_members", "staff_util_x_members", "upsell_rate", "prev_month_revenue", "month_sin", "month_cos",
)
MODEL = {
    "r1": (2000.0, (55.0, 20.0, 9000.0, 3000.0, 35.0, 8.0, 12.0, 6.0, 0.0, 0.001, 300.0, -200.0)),
    "r2": (2100.0, (56.0, 21.0, 9200.0, 3100.0, 40.0, 8.5, 12.5, 6.25, 0.0, 0.001, 250.0, -150.0)),
    "r3": (2250.0, (57.5, 21.5, 9500.0, 3250.0, 45.0, 9.0, 13.0, 6.5, 0.0, 0.001, 200.0, -100.0)),
    "m3": (4.0, (0.92, -0.02, 30.0, 5.0, 1.5, 0.01, 0.0, 0.0, 0.0, 0.0, 0.5, 0.25)),
    "t3": (0.09, (0.0, -0.0001, 0.85, 0.05, 0.0, 0.0, 0.0, 0.0, 0.02, 0.0, 0.001, 0.001)),
}


def predicted(target: str, prefix: str = "c_") -> str:
    start, coefs = MODEL[target]
    f = feature_sql(prefix)
    return "(" + d(start) + "".join(f" + {d(b)} * CAST({f[c]} AS DOUBLE)" for c, b in zip(MODEL_FEATURES, coefs) if b) + ")"


def predictions(prefix: str = "c_") -> str:
    return ", ".join(f"{predicted(t, prefix)} AS {t}" for t in MODEL)


SCORED = f"sc AS (SELECT rf.*, {predictions()} FROM rf)"
MONTHS = "(SELECT sc.*, unnest(range(1, projection_months + 1)) AS m FROM sc WHERE projection_months <= 12)"

FORECAST = f"""{SCORED},
fc AS (
  SELECT request_id, CAST(m AS INTEGER) AS month_ahead,
         CASE WHEN m = 1 THEN r1 WHEN m = 2 THEN r2 WHEN m = 3 THEN r3 ELSE r3 * power(1 + (r3 - r1) / (3 * r1), m - 3) END AS revenue,
         CAST(trunc(CASE WHEN m >= 3 THEN m3 ELSE c_total_members + (m3 - c_total_members) * m / 3 END) AS BIGINT) AS member_count,
         CASE WHEN m >= 3 THEN t3 ELSE c_retention_rate END AS retention_rate,
         CASE WHEN m <= 3 THEN {d(0.85)} - {d(0.05)} * (m - 1) ELSE greatest({d(0.5)}, {d(0.80)} - {d(0.05)} * (m - 1)) END AS confidence_score
  FROM {MONTHS})"""


# --- sensitivity ---------------------------------------------------------------------------


def variations(changes: tuple[int, ...]) -> str:
    rows = "\nUNION ALL ".join(
        f"SELECT sc.*, '{lv}' AS lever, CAST({c} AS DOUBLE) AS change_pct, c_{lv} AS old_value, {clip(f'c_{lv} * (1 + {d(c)} / {d(100)})', lv)} AS new_value FROM sc"
        for lv in LV for c in changes
    )
    return (
        f"{SCORED},\nva AS ({rows}),\nvb AS (SELECT *, " + ", ".join(f"CASE WHEN lever = '{lv}' THEN new_value ELSE c_{lv} END AS v_{lv}" for lv in LV)
        + f" FROM va),\nvc AS (SELECT *, {predicted('r1', 'v_')} AS varied_revenue FROM vb)"
    )


# --- inverse search -------------------------------------------------------------------------

THRESHOLDS = {
    "retention_rate": (0.02, 0.05, 0.10), "avg_ticket_price": (5.0, 20.0, 50.0), "class_attendance_rate": (0.03, 0.07, 0.15),
    "new_members": (5.0, 15.0, 30.0), "staff_utilization_rate": (0.05, 0.10, 0.20), "upsell_rate": (0.03, 0.08, 0.15),
    "total_classes_held": (10.0, 30.0, 60.0), "total_members": (10.0, 30.0, 60.0),
}
PRIORITY = {"retention_rate": 1, "avg_ticket_price": 2, "new_members": 3, "upsell_rate": 4, "class_attendance_rate": 5, "staff_utilization_rate": 6, "total_classes_held": 7, "total_members": 8}
WEEKS = {"retention_rate": 8, "avg_ticket_price": 4, "new_members": 6, "upsell_rate": 3, "class_attendance_rate": 2, "staff_utilization_rate": 2, "total_classes_held": 2, "total_members": 12}
#: scenario: (retention, ticket, new members) increases allowed, or no limits
SCENARIOS = {"free": None, "gentle": (0.02, 5.0, 3.0), "bold": (0.1, 50.0, 30.0)}
#: the scenario with several objectives
MULTI = "scenario = 'bold'"


def case(x: str, table: dict, then=str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {then(v)}" for k, v in table.items()) + " END"


def bounds_sql(limited: str = "limited", l_ret: str = "l_ret", l_tic: str = "l_tic", l_new: str = "l_new") -> str:
    out = []
    for lv in LV:
        lo, hi = d(B[lv][0]), d(B[lv][1])
        limit, default = {"retention_rate": (l_ret, 0.05), "avg_ticket_price": (l_tic, 20.0), "new_members": (l_new, 10.0)}.get(lv, (None, None))
        if limit:
            top = f"c_{lv} + coalesce({limit}, {d(default)})"
            top = f"least({top}, {hi})" if lv == "retention_rate" else top
            out.append(f"CASE WHEN {limited} THEN c_{lv} ELSE {lo} END AS lo_{lv}, CASE WHEN {limited} THEN {top} ELSE {hi} END AS hi_{lv}")
        else:
            out.append(f"{lo} AS lo_{lv}, {hi} AS hi_{lv}")
    return ", ".join(out)


def _target(scenarios: bool) -> str:
    """Base rows of the search: target, limits and bounds."""
    limits = f"(kind = 'inside' AND {pmod('entity_id', 2)} = 0)"
    if not scenarios:
        source = f"(SELECT sc.*, 'request' AS scenario, {limits} AS limited, {d(0.1)} AS l_ret, {d(30)} AS l_tic, CAST(NULL AS DOUBLE) AS l_new FROM sc)"
    else:
        parts = []
        for name, x in SCENARIOS.items():
            a, b, c = x or (0.0, 0.0, 0.0)
            parts.append(f"SELECT sc.*, '{name}' AS scenario, {'true' if x else 'false'} AS limited, {d(a)} AS l_ret, {d(b)} AS l_tic, {d(c)} AS l_new FROM sc")
        source = "(" + " UNION ALL ".join(parts) + ")"
    return f"base AS (SELECT *, (r1 + r2 + r3) * {d(1.1)} AS target_revenue, {bounds_sql()} FROM {source})"


def line_search(scenarios: bool = False) -> str:
    """CTEs up to ``inv``: the best row on the line of every request (and scenario), columns x_ (as searched)
    and y_ (as reported), revenue, objective, f."""
    out = [SCORED, _target(scenarios)]
    for r in range(5):
        step = d(10.0 ** (r + 1))
        if r == 0:
            grid = f"(SELECT base.*, least(greatest({d(0)} + CAST(k AS DOUBLE) / {step}, {d(-1)}), {d(1)}) AS f FROM base, (SELECT unnest(range(-10, 11)) AS k))"
        else:
            grid = (
                f"(SELECT base.*, least(greatest(p.f + CAST(k AS DOUBLE) / {step}, {d(-1)}), {d(1)}) AS f FROM base JOIN best{r - 1} p USING (request_id, scenario), "
                "(SELECT unnest(range(-10, 11)) AS k))"
            )
        x = ", ".join(f"CASE WHEN f >= 0 THEN c_{lv} + f * (hi_{lv} - c_{lv}) ELSE c_{lv} - f * (lo_{lv} - c_{lv}) END AS x_{lv}" for lv in LV)
        y = ", ".join((f"round_even(x_{lv}, 0)" if B[lv][3] else f"x_{lv}") + f" AS y_{lv}" for lv in LV)
        rev = " + ".join(predicted(t, "y_") for t in ("r1", "r2", "r3"))
        reg = d(0) + "".join(f" + (x_{lv} - c_{lv}) * (x_{lv} - c_{lv})" for lv in LV)
        out += [
            f"xs{r} AS (SELECT *, {x} FROM {grid})",
            f"ys{r} AS (SELECT *, {y} FROM xs{r})",
            f"rs{r} AS (SELECT *, {rev} AS revenue FROM ys{r})",
            f"os{r} AS (SELECT *, (revenue - target_revenue) * (revenue - target_revenue) + {d(1e-4)} * ({reg}) AS objective FROM rs{r})",
            f"best{r} AS (SELECT * FROM os{r} QUALIFY row_number() OVER (PARTITION BY request_id, scenario ORDER BY objective, abs(f), f) = 1)",
        ]
    out.append("inv AS (SELECT * FROM best4)")
    return ",\n".join(out)


def multi_objective() -> str:
    cost = "(" + d(0) + "".join(f" + coalesce(abs((x_{lv} - c_{lv}) / NULLIF(c_{lv}, 0)), 0)" for lv in LV) + f") / {d(len(LV))}"
    err = "((revenue - target_revenue) / target_revenue)"
    return (
        f"{err} * {err} - {d(0.3)} * (x_retention_rate - c_retention_rate) - {d(0.2)} * (round_even(x_total_members, 0) - c_total_members) * {d(0.001)} + {d(0.1)} * ({cost})"
    )


def probes() -> str:
    """pr: sensitivity of every lever at the optimum."""
    rows = []
    for lv in LV:
        moved = clip(f"x_{lv} + CASE WHEN x_{lv} * {d(0.01)} = 0 THEN {d(0.01)} ELSE x_{lv} * {d(0.01)} END", lv)
        cols = ", ".join((f"round_even({moved if o == lv else f'x_{o}'}, 0)" if B[o][3] else (moved if o == lv else f"x_{o}")) + f" AS q_{o}" for o in LV)
        rows.append(f"SELECT inv.*, '{lv}' AS lever, {cols} FROM inv")
    rev = " + ".join(predicted(t, "q_") for t in ("r1", "r2", "r3"))
    return "pb AS (" + "\nUNION ALL ".join(rows) + f"),\npr AS (SELECT request_id, scenario, lever, ({rev} - revenue) / revenue * 100 AS sensitivity FROM pb)"


def feasibility_score() -> str:
    parts = []
    for lv, (e, mo, h) in THRESHOLDS.items():
        ch = f"abs(y_{lv} - c_{lv})"
        parts.append(f"CASE WHEN {ch} <= {d(e)} THEN {d(1)} WHEN {ch} <= {d(mo)} THEN {d(0.7)} WHEN {ch} <= {d(h)} THEN {d(0.4)} ELSE {d(0.2)} END")
    return "((" + d(0) + "".join(f" + {p}" for p in parts) + f") / {len(parts)})"


def changes() -> str:
    """ch: lever changes with difficulty, priority and sensitivity (needs inv and pr)."""
    rows = []
    for i, (lv, (e, mo, h)) in enumerate(THRESHOLDS.items()):
        ch = f"abs(y_{lv} - c_{lv})"
        pct = f"CASE WHEN c_{lv} <> 0 THEN (y_{lv} - c_{lv}) / c_{lv} * 100 ELSE 0 END"
        rows.append(
            f"SELECT request_id, scenario, '{lv}' AS lever, {i} AS lever_no, c_{lv} AS current, y_{lv} AS proposed, y_{lv} - c_{lv} AS change, {pct} AS change_pct, "
            f"CASE WHEN {ch} <= {d(e)} THEN 'easy' WHEN {ch} <= {d(mo)} THEN 'moderate' WHEN {ch} <= {d(h)} THEN 'hard' ELSE 'very_hard' END AS difficulty, "
            f"CASE WHEN {ch} <= {d(e)} THEN 1.0 WHEN {ch} <= {d(mo)} THEN 0.7 WHEN {ch} <= {d(h)} THEN 0.4 ELSE 0.2 END AS feasibility_score FROM inv"
        )
    prio = case("lever", PRIORITY)
    return (
        "c0 AS (" + "\nUNION ALL ".join(rows) + f"),\nch AS (SELECT c0.*, CASE WHEN abs(change_pct) > 10 THEN greatest(1, {prio} - 1) ELSE {prio} END AS priority, sensitivity "
        "FROM c0 JOIN pr USING (request_id, scenario, lever) WHERE abs(change) > 0.001)"
    )


def uniform(*parts: str) -> str:
    h = "(" + " + ".join(["12345", *[f"({p}) * {m}" for p, m in zip(parts, (7919, 104729, 1299709, 15485863))]]) + ")"
    h = pmod(h, 2147483647)
    for _ in range(3):
        h = f"(({h} * 48271 + 11) % 2147483647)"
    return f"((CAST({h} AS DOUBLE) + {d(0.5)}) / {d(2147483647)})"


def perturbations() -> str:
    """un: spread of the revenue over 20 hashed perturbations of the optimum."""
    cols = []
    for j, lv in enumerate(LV):
        u1, u2 = uniform("request_id", "draw", str(2 * j)), uniform("request_id", "draw", str(2 * j + 1))
        x = clip(f"x_{lv} + {d(0.01)} * (sqrt({d(-2)} * ln({u1})) * cos({d(6.283185307179586)} * {u2}))", lv)
        cols.append((f"round_even({x}, 0)" if B[lv][3] else x) + f" AS q_{lv}")
    rev = " + ".join(predicted(t, "q_") for t in ("r1", "r2", "r3"))
    return (
        f"pu AS (SELECT *, {', '.join(cols)} FROM (SELECT inv.*, unnest(range(1, 21)) AS draw FROM inv)),\npv AS (SELECT request_id, scenario, {rev} AS revenue FROM pu),\n"
        "un AS (SELECT request_id, scenario, avg(revenue) AS mean_revenue, stddev_pop(revenue) AS std_revenue, quantile_cont(revenue, 0.025) AS revenue_low, "
        "quantile_cont(revenue, 0.975) AS revenue_high, CASE WHEN avg(revenue) > 0 THEN stddev_pop(revenue) / avg(revenue) ELSE 0 END AS cv FROM pv GROUP BY ALL)"
    )


def confidence() -> str:
    """co: confidence of the optimisation (needs inv and un)."""
    rate = "(CASE WHEN target_revenue > 0 THEN revenue / target_revenue ELSE 0 END)"
    ok = f"(abs(revenue - target_revenue) <= {d(0.01)} * target_revenue)"
    c = f"(CASE WHEN {ok} THEN {d(0.7)} ELSE {d(0.4)} END + CASE WHEN {rate} >= 0.95 THEN {d(0.15)} WHEN {rate} >= 0.85 THEN {d(0.1)} WHEN {rate} >= 0.75 THEN {d(0.05)} ELSE {d(-0.1)} END)"
    c = f"{c} * ({d(0.7)} + {d(0.3)} * {feasibility_score()}) + CASE WHEN cv < 0.05 THEN {d(0.05)} WHEN cv > 0.15 THEN {d(-0.1)} ELSE {d(0)} END"
    return f"co AS (SELECT inv.*, un.cv, least({rate}, 1) AS achievement_rate, {ok} AS success, {feasibility_score()} AS feasibility_score, least(greatest({c}, 0), 1) AS confidence_score FROM inv JOIN un USING (request_id, scenario))"


# --- partial prediction --------------------------------------------------------------------

LEVER_MODELS = {
    "new_members": (2.0, {"retention_rate": 12.0, "avg_ticket_price": -0.02, "total_members": 0.03}),
    "upsell_rate": (0.05, {"class_attendance_rate": 0.1, "new_members": 0.002, "retention_rate": 0.05}),
    "class_attendance_rate": (0.35, {"retention_rate": 0.4, "total_classes_held": -0.0004, "upsell_rate": 0.2}),
}

STATES = f"""{SCORED},
ms AS (
  SELECT request_id, n_hist, CAST(m AS INTEGER) AS month_ahead,
         CASE WHEN m = 1 THEN r1 WHEN m = 2 THEN r2 WHEN m = 3 THEN r3 ELSE r3 * power(1 + (r3 - r1) / (3 * r1), m - 3) END AS state_revenue,
         CASE WHEN m = 1 THEN first WHEN m = 2 THEN first + (m3 - first) * ({d(2)} / 3) ELSE m3 END AS state_members,
         CASE WHEN m <= 2 THEN c_retention_rate WHEN m = 3 THEN t3 ELSE least(greatest(t3, {d(0.5)}), {d(1)}) END AS state_retention
  FROM (SELECT *, c_total_members + (m3 - c_total_members) * ({d(1)} / 3) AS first FROM {MONTHS}))"""


def sequential() -> str:
    """sq: (request, month, lever, value, confidence), month by month (needs STATES)."""
    out = ["q0 AS (SELECT request_id, " + ", ".join(f"c_{lv} AS s_{lv}" for lv in LV) + " FROM sc)"]
    known = "(n_hist IS NOT NULL)"
    for m in range(1, 13):
        state = ", ".join("state_members AS s_total_members" if lv == "total_members" else "state_retention AS s_retention_rate" if lv == "retention_rate" else f"p.s_{lv}" for lv in LV)
        out.append(f"q{m}_0 AS (SELECT request_id, ms.n_hist, {state} FROM q{m - 1} p JOIN ms USING (request_id) WHERE month_ahead = {m})")
        for i, (lv, (b0, coefs)) in enumerate(LEVER_MODELS.items()):
            guess = d(b0) + "".join(f" + {d(coefs.get(o, 0.0))} * s_{o}" for o in LV)
            out.append(f"q{m}_{i + 1} AS (SELECT * REPLACE (CASE WHEN {known} THEN {clip(guess, lv)} ELSE s_{lv} END AS s_{lv}) FROM q{m}_{i})")
        out.append(f"q{m} AS (SELECT * FROM q{m}_{len(LEVER_MODELS)})")
    rows = "\nUNION ALL ".join(
        f"SELECT request_id, {m} AS month_ahead, '{lv}' AS lever, s_{lv} AS predicted_value, greatest({d(0.5)}, CASE WHEN {known} THEN {d(0.7)} ELSE {d(0.65)} END - {m - 1} * {d(0.05)}) AS confidence FROM q{m}"
        for m in range(1, 13) for lv in LEVER_MODELS
    )
    return ",\n".join(out) + f",\nsq AS ({rows})"


def evolution() -> str:
    """ev: lever paths, month by month (a list per request and lever, then unnested)."""
    rows = []
    for lv in LV:
        t = f"(CASE WHEN n_hist > 3 THEN coalesce(trend_{lv}, 0) ELSE 0 END)" if lv in PRESENT else d(0)
        v = f"f_{lv}"
        change = {
            "retention_rate": f"CASE WHEN abs({t}) > 0.001 THEN {t} ELSE {d(0.002)} END",
            "class_attendance_rate": f"CASE WHEN abs({t}) > 0.001 THEN {t} ELSE {d(0)} END",
            "new_members": f"CASE WHEN abs({t}) > 0.1 THEN {t} ELSE {d(0.5)} END",
            "staff_utilization_rate": f"({d(0.85)} - {v}) * {d(0.1)}",
            "upsell_rate": d(0.005),
            "total_classes_held": f"CASE WHEN abs({t}) > 0.1 THEN {t} ELSE {d(1)} END",
            "total_members": f"f_new_members - {v} * (1 - f_retention_rate)",
        }.get(lv, d(0))
        rows.append(f"SELECT request_id, projection_months, '{lv}' AS lever, CAST({v} AS DOUBLE) AS v, CAST({change} AS DOUBLE) AS change, {d(B[lv][0])} AS lo, {d(B[lv][1])} AS hi FROM rf WHERE projection_months <= 12")
    out = ["e0 AS (" + "\nUNION ALL ".join(rows) + ")", "e1 AS (SELECT *, least(greatest(v, lo), hi) AS value FROM e0 WHERE projection_months >= 1)"]
    for m in range(2, 13):
        out.append(f"e{m} AS (SELECT * REPLACE (least(greatest(value + change, lo), hi) AS value) FROM e{m - 1} WHERE projection_months >= {m})")
    rows = "\nUNION ALL ".join(f"SELECT request_id, lever, {m} AS month_ahead, value AS predicted_value, greatest({d(0.5)}, {d(0.7)} - {m - 1} * {d(0.05)}) AS confidence FROM e{m}" for m in range(1, 13))
    return ",\n".join(out) + f",\nev AS ({rows})"


__all__ = ["r2", "wsql"]
