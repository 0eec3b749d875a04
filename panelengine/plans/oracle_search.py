"""DuckDB SQL of the search over all levers (``operators.search``). Points are lists in the order
of LV; every method ends in a table (request_id, scenario, x)."""

from __future__ import annotations

from .oracle_whatif import B, LV, SCORED, _target, d, predicted, uniform

N = len(LV)
_G = 1.5
for _ in range(60):
    _G = (1 + _G) ** (1 / (N + 1))
GOLDEN = [_G ** -(j + 1) for j in range(N)]
REAL = [j for j, lv in enumerate(LV) if not B[lv][3]]


#: ten significant digits of v
TEN_DIGITS = "CASE WHEN v = 0 THEN v ELSE round_even(v / power(10e0, floor(log10(abs(v))) - 9), 0) * power(10e0, floor(log10(abs(v))) - 9) END"


def _list(values) -> str:
    return "[" + ", ".join(values) + "]"


def _sum(values) -> str:
    return "(" + d(0) + "".join(f" + {v}" for v in values) + ")"


def _evaluated(rows: str, rounded: bool = True) -> str:
    """Rows (request_id, scenario, k, x) with ``revenue`` and the base row's columns."""
    q = ", ".join((f"round_even(x[{j + 1}], 0)" if rounded and B[lv][3] else f"x[{j + 1}]") + f" AS q_{lv}" for j, lv in enumerate(LV))
    rev = " + ".join(predicted(t, "q_") for t in ("r1", "r2", "r3"))
    return f"(SELECT *, {rev} AS revenue FROM (SELECT *, {q} FROM ({rows}) JOIN bx USING (request_id, scenario)))"


def _objective() -> str:
    single = f"(revenue - target_revenue) * (revenue - target_revenue) + {d(1e-4)} * " + _sum(f"(x[{j + 1}] - x0[{j + 1}]) * (x[{j + 1}] - x0[{j + 1}])" for j in range(N))
    cost = _sum(f"coalesce(abs((x[{j + 1}] - x0[{j + 1}]) / NULLIF(x0[{j + 1}], 0)), 0)" for j in range(N)) + f" / {d(N)}"
    err = "((revenue - target_revenue) / target_revenue)"
    ret, mem = LV.index("retention_rate") + 1, LV.index("total_members") + 1
    gain = f"({d(0.3)} * (x[{ret}] - x0[{ret}]) + {d(0.2)} * (round_even(x[{mem}], 0) - x0[{mem}]) * {d(0.001)})"
    return f"CASE WHEN multi THEN {err} * {err} - {gain} + {d(0.1)} * ({cost}) ELSE {single} END"


def _scored(rows: str) -> str:
    return f"(SELECT request_id, scenario, k, x, {TEN_DIGITS} AS o FROM (SELECT request_id, scenario, k, x, {_objective()} AS v FROM {_evaluated(rows)}))"


def _boxed(v: str, j: int) -> str:
    return f"least(greatest({v}, lo[{j + 1}]), hi[{j + 1}])"


def _point(k: str) -> str:
    x = _list(f"lo[{j + 1}] + ({d(0.5)} + {k} * {d(g)} - floor({d(0.5)} + {k} * {d(g)})) * (hi[{j + 1}] - lo[{j + 1}])" for j, g in enumerate(GOLDEN))
    return f"CASE WHEN {k} = 0 THEN x0 ELSE {x} END"


def _newton(step: int, source: str, free: list[int], rounded: bool, keys: str = "request_id, scenario") -> list[str]:
    """One step: slopes by differences, the path through the box, and where it is in balance."""
    n = f"gn{step}"
    h = [f"{d(1e-3)} * (hi[{j + 1}] - lo[{j + 1}])" for j in range(N)]
    signed = [f"CASE WHEN x[{j + 1}] + {h[j]} <= hi[{j + 1}] THEN {h[j]} ELSE -({h[j]}) END" for j in range(N)]
    moved = _list(f"CASE WHEN k = {j} THEN x[{j + 1}] + {signed[j]} ELSE x[{j + 1}] END" for j in range(N))
    probes = f"SELECT {keys}, k, {moved} AS x FROM (SELECT s.*, unnest(range(-1, {N})) AS k, lo, hi FROM {source} s JOIN bx USING (request_id, scenario))"
    slopes = _list(
        f"CASE WHEN hi[{j + 1}] <= lo[{j + 1}] THEN {d(0)} ELSE (max(revenue) FILTER (k = {j}) - max(revenue) FILTER (k = -1)) / ({signed[j]}) END" if j in free else d(0) for j in range(N)
    )
    path = lambda c: [_boxed(f"x0[{j + 1}] + {c} * s[{j + 1}]", j) if j in free else f"x[{j + 1}]" for j in range(N)]
    balance = "(base - target_revenue) + " + _sum(f"s[{j + 1}] * (({p}) - x[{j + 1}])" for j, p in enumerate(path("c"))) + f" + {d(1e-4)} * c"
    ends = "list_concat(" + ", ".join(f"CASE WHEN s[{j + 1}] = 0 THEN [] ELSE [(lo[{j + 1}] - x0[{j + 1}]) / s[{j + 1}], (hi[{j + 1}] - x0[{j + 1}]) / s[{j + 1}]] END" for j in range(N)) + ")"
    return [
        f"{n}e AS MATERIALIZED (SELECT {keys}, k, revenue FROM {_evaluated(probes, rounded)})",
        f"{n}s AS MATERIALIZED (SELECT {keys}, any_value(p.x) AS x, any_value(x0) AS x0, any_value(lo) AS lo, any_value(hi) AS hi, any_value(target_revenue) AS target_revenue, "
        f"max(revenue) FILTER (k = -1) AS base, {slopes.replace('x[', 'any_value(p.x)[').replace('hi[', 'any_value(hi)[').replace('lo[', 'any_value(lo)[')} AS s "
        f"FROM {n}e JOIN {source} p USING ({keys}) JOIN bx USING (request_id, scenario) GROUP BY {keys})",
        f"{n}b AS MATERIALIZED (SELECT {keys}, c, {balance} AS g FROM (SELECT *, unnest({ends}) AS c FROM {n}s))",
        f"{n}c AS MATERIALIZED (SELECT {keys}, max(c) FILTER (g <= 0) AS lc, max_by(g, c) FILTER (g <= 0) AS lg, min(c) FILTER (g >= 0) AS rc, min_by(g, c) FILTER (g >= 0) AS rg FROM {n}b GROUP BY ALL)",
        f"{n} AS MATERIALIZED (SELECT {keys}, {_list(path('c'))} AS x FROM (SELECT {n}s.*, coalesce(CASE WHEN lg = rg THEN lc ELSE lc - lg * (rc - lc) / (rg - lg) END, lc, rc, {d(0)}) AS c "
        f"FROM {n}s LEFT JOIN {n}c USING ({keys})))",
    ]


def _gauss_newton() -> list[str]:
    out, source = [], "start"
    for i in range(3):
        out += _newton(i, source, list(range(N)), False)
        source = f"gn{i}"
    whole = [j for j in range(N) if j not in REAL]
    rounded = _list(_boxed(f"floor(x[{j + 1}]) + (corner // {2 ** whole.index(j)}) % 2", j) if j in whole else f"x[{j + 1}]" for j in range(N))
    out.append(f"gnw AS MATERIALIZED (SELECT request_id, scenario, corner, {rounded} AS x FROM (SELECT *, unnest(range(0, {2 ** len(whole)})) AS corner FROM {source}) JOIN bx USING (request_id, scenario))")
    source = "gnw"
    for i in range(3, 5):
        out += _newton(i, source, REAL, True, "request_id, scenario, corner")
        source = f"gn{i}"
    out.append(f"gn AS MATERIALIZED (SELECT request_id, scenario, x FROM {_scored(f'SELECT request_id, scenario, corner AS k, x FROM {source}')} QUALIFY row_number() OVER (PARTITION BY request_id, scenario ORDER BY o, k) = 1)")
    return out


def _compass(rounds: int = 12) -> list[str]:
    out = [f"cp0 AS MATERIALIZED (SELECT request_id, scenario, x, {d(0.25)} AS size FROM start)"]
    for r in range(rounds):
        up = f"CASE WHEN k <= {N} THEN {d(1)} ELSE {d(-1)} END"
        moved = _list("CASE WHEN k IN ({}, {}) THEN {} ELSE x[{}] END".format(j + 1, j + 1 + N, _boxed(f"x[{j + 1}] + {up} * size * (hi[{j + 1}] - lo[{j + 1}])", j), j + 1) for j in range(N))
        rows = f"SELECT request_id, scenario, k, {moved} AS x FROM (SELECT s.*, unnest(range(0, {2 * N + 1})) AS k, lo, hi FROM cp{r} s JOIN bx USING (request_id, scenario))"
        out.append(
            f"cp{r + 1} AS MATERIALIZED (SELECT b.request_id, b.scenario, b.x, CASE WHEN k = 0 THEN size / 2 ELSE size END AS size "
            f"FROM (SELECT * FROM {_scored(rows)} QUALIFY row_number() OVER (PARTITION BY request_id, scenario ORDER BY o, k) = 1) b JOIN cp{r} USING (request_id, scenario))"
        )
    return out


def _evolution(population: int = 12, generations: int = 10) -> list[str]:
    first = f"SELECT request_id, scenario, k, {_point('k')} AS x FROM (SELECT *, unnest(range(0, {population})) AS k FROM bx)"
    out = [f"ev0 AS MATERIALIZED {_scored(first)}"]
    other = lambda i, u: f"(({i} + 1 + CAST(floor({u} * {population - 1}) AS INTEGER)) % {population})"
    for g in range(1, generations + 1):
        u = lambda what: uniform("request_id", f"({g} * 100 + k)", str(what))
        p = f"ev{g - 1}"
        taken = [f"({j} = CAST(floor({u(2)} * {N}) AS INTEGER) OR {u(3 + j)} < {d(0.7)})" for j in range(N)]
        child = _list("CASE WHEN {} THEN {} ELSE m[{}] END".format(taken[j], _boxed(f"best[{j + 1}] + {d(0.7)} * (xb[{j + 1}] - xc[{j + 1}])", j), j + 1) for j in range(N))
        rows = (
            f"SELECT request_id, scenario, k, {child} AS x FROM (SELECT i.*, b.x AS xb, c.x AS xc, best, lo, hi FROM "
            f"(SELECT *, {other('b', u(1))} AS c FROM (SELECT request_id, scenario, k, x AS m, {other('k', u(0))} AS b FROM {p})) i "
            f"JOIN {p} b ON b.request_id = i.request_id AND b.scenario = i.scenario AND b.k = i.b JOIN {p} c ON c.request_id = i.request_id AND c.scenario = i.scenario AND c.k = i.c "
            f"JOIN (SELECT request_id, scenario, arg_min(x, o) AS best FROM {p} GROUP BY ALL) t ON t.request_id = i.request_id AND t.scenario = i.scenario "
            f"JOIN bx ON bx.request_id = i.request_id AND bx.scenario = i.scenario)"
        )
        out += [
            f"ch{g} AS MATERIALIZED {_scored(rows)}",
            f"ev{g} AS MATERIALIZED (SELECT m.request_id, m.scenario, m.k, CASE WHEN y.o <= m.o THEN y.x ELSE m.x END AS x, least(y.o, m.o) AS o FROM {p} m JOIN ch{g} y USING (request_id, scenario, k))",
        ]
    out.append(f"evo AS MATERIALIZED (SELECT request_id, scenario, x FROM ev{generations} QUALIFY row_number() OVER (PARTITION BY request_id, scenario ORDER BY o, k) = 1)")
    return out


def search(scenarios: bool = False, multi: str = "false") -> str:
    """CTEs up to ``inv``: the best point of every request (and scenario) by its objective,
    columns x_ (as searched) and y_ (as reported), revenue, objective, method."""
    x0 = _list(f"least(greatest(c_{lv}, lo_{lv}), hi_{lv})" for lv in LV)
    start = f"SELECT request_id, scenario, k, {_point('k')} AS x FROM (SELECT *, unnest(range(0, 17)) AS k FROM bx)"
    ends = "\nUNION ALL ".join(f"SELECT request_id, scenario, {k} AS k, x FROM {t}" for k, t in enumerate(("gn", "cp12", "evo", "start")))
    return ",\n".join([
        SCORED, _target(scenarios),
        f"bx AS MATERIALIZED (SELECT *, {x0} AS x0, {_list(f'lo_{lv}' for lv in LV)} AS lo, {_list(f'hi_{lv}' for lv in LV)} AS hi, {multi} AS multi FROM base)",
        f"start AS MATERIALIZED (SELECT request_id, scenario, x FROM {_scored(start)} QUALIFY row_number() OVER (PARTITION BY request_id, scenario ORDER BY o, k) = 1)",
        *_gauss_newton(), *_compass(), *_evolution(),
        f"inv AS MATERIALIZED (SELECT * EXCLUDE (v, " + ", ".join(f"q_{lv}" for lv in LV) + f"), {TEN_DIGITS} AS objective, " + "['gauss_newton', 'compass', 'evolution', 'start'][k + 1] AS method, "
        + ", ".join(f"x[{j + 1}] AS x_{lv}, q_{lv} AS y_{lv}" for j, lv in enumerate(LV))
        + f" FROM (SELECT *, {_objective()} AS v FROM {_evaluated(ends)}) QUALIFY row_number() OVER (PARTITION BY request_id, scenario ORDER BY objective, k) = 1)",
    ])
