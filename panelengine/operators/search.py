"""Search for the levers that bring a request to its target, over all levers at once.

A request is one row: its levers are an array in the order of ``LEVERS``, the box that they may
move in two more, and every method is a fold over arrays of candidate points inside the row.
Nothing is shuffled or collected, so requests scale with the executors.

* ``gauss_newton``: the revenue is made linear by differences. For a linear residual the best
  point in the box lies on the path clip(x0 + c * J), and c solves an increasing, piecewise
  linear equation, so each step is exact. First all levers move freely, then whole-number
  levers are fixed and the others make up for the rounding.
* ``compass``: the best of all moves of one lever up or down; steps halve where none helps.
* ``evolution``: differential evolution (mutation about the best member, binomial crossover)
  with draws hashed from the request, so a result does not depend on partitions.

``best_levers`` starts from the best of a low-discrepancy set of points and keeps the best
result of all methods.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import dbl
from ..spec import LEVERS
from .whatif import hashed_uniform

NAMES = list(LEVERS)
N = len(NAMES)
WHOLE = [LEVERS[lv][3] for lv in NAMES]
RETENTION, MEMBERS = NAMES.index("retention_rate"), NAMES.index("total_members")

#: points of the starting set besides the current levers
POINTS = 16
FREE_STEPS, ROUNDED_STEPS = 3, 2
COMPASS_ROUNDS, COMPASS_STEP = 12, 0.25
POPULATION, GENERATIONS, SCALE, CROSSOVER = 12, 10, 0.7, 0.7
PENALTY = 1e-4
#: difference step, as a share of a lever's range
DIFFERENCE = 1e-3
METHODS = ("gauss_newton", "compass", "evolution", "start")

Revenue = Callable[[Callable[[str], Column]], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _doubles(values) -> Column:
    return F.array(*[dbl(float(v)) for v in values])


def _each(make: Callable[[Column], Column]) -> Column:
    """An array over the levers' places."""
    return F.transform(F.sequence(F.lit(0), F.lit(N - 1)), make)


def _total(values: Column) -> Column:
    return F.aggregate(values, dbl(0.0), lambda a, v: a + v)


def _inside(v: Column, i: Column) -> Column:
    return F.least(F.greatest(v, F.col("_lo")[i]), F.col("_hi")[i])


def _ten_digits(v: Column) -> Column:
    """Rounded to ten significant digits, so that the last bits of a sum decide nothing."""
    unit = F.pow(dbl(10.0), F.floor(F.log10(F.abs(v))) - 9)
    return F.when(v == 0, v).otherwise(let(unit, lambda u: F.rint(v / u) * u))


def golden_steps(n: int = N) -> list[float]:
    """Powers of the root of g^(n+1) = g + 1: multiples of these, modulo 1, fill the box evenly."""
    g = 1.5
    for _ in range(60):
        g = (1 + g) ** (1 / (n + 1))
    return [g ** -(j + 1) for j in range(n)]


class Search:
    """The objective of a row, and the methods on it. The frame has ``_x0``, ``_lo``, ``_hi``
    (arrays), ``_target``, ``_multi`` (which objective counts) and ``_seed``; ``revenue`` gives the
    revenue for a function from a lever's name to its column."""

    def __init__(self, revenue: Revenue, population: int = POPULATION, generations: int = GENERATIONS):
        self.model, self.population, self.generations = revenue, population, generations

    def revenue(self, x: Column, rounded: bool = True) -> Column:
        return self.model(lambda n: F.rint(x[NAMES.index(n)]) if rounded and WHOLE[NAMES.index(n)] else x[NAMES.index(n)])

    def objective(self, x: Column) -> Column:
        x0, target = F.col("_x0"), F.col("_target")

        def of(r: Column) -> Column:
            single = (r - target) * (r - target) + PENALTY * _total(F.zip_with(x, x0, lambda a, b: (a - b) * (a - b)))
            cost = _total(F.zip_with(x, x0, lambda a, b: F.coalesce(F.abs(F.try_divide(a - b, b)), dbl(0.0)))) / float(N)
            err = (r - target) / target
            gain = 0.3 * (x[RETENTION] - x0[RETENTION]) + 0.2 * (F.rint(x[MEMBERS]) - x0[MEMBERS]) * 0.001
            return F.when(F.col("_multi"), err * err - gain + 0.1 * cost).otherwise(single)

        return let(let(self.revenue(x), of), _ten_digits)

    def _scored(self, x: Column, order: Column) -> Column:
        return F.struct(self.objective(x).alias("o"), order.cast("int").alias("k"), x.alias("x"))

    def point(self, k: Column) -> Column:
        """The k-th point of the starting set; 0 is the current levers."""
        steps = _doubles(golden_steps())
        at = lambda j: let(dbl(0.5) + k.cast("double") * steps[j], lambda u: u - F.floor(u))
        return F.when(k == 0, F.col("_x0")).otherwise(_each(lambda j: F.col("_lo")[j] + at(j) * (F.col("_hi")[j] - F.col("_lo")[j])))

    def start(self) -> Column:
        return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(POINTS)), lambda k: let(self.point(k), lambda x: self._scored(x, k))))

    def _newton_step(self, x: Column, free: Column, rounded: bool) -> Column:
        x0, lo, hi = F.col("_x0"), F.col("_lo"), F.col("_hi")

        step = lambda j: let(DIFFERENCE * (hi[j] - lo[j]), lambda h: F.when(x[j] + h <= hi[j], h).otherwise(-h))

        def probe(k: Column) -> Column:
            """Revenue with lever k moved by its step; at the end, with none moved."""
            return let(F.transform(x, lambda v, i: F.when(i == k, v + step(i)).otherwise(v)), lambda y: self.revenue(y, rounded))

        def slopes(r: Column) -> Column:
            return _each(lambda j: F.when(~free[j] | (hi[j] <= lo[j]), dbl(0.0)).otherwise((r[j] - r[N]) / step(j)))

        def solved(base: Column, s: Column) -> Column:
            path = lambda c: _each(lambda j: F.when(free[j], _inside(x0[j] + c * s[j], j)).otherwise(x[j]))

            def balance(c: Column) -> Column:
                return (base - F.col("_target")) + _total(F.zip_with(s, F.zip_with(path(c), x, lambda a, b: a - b), lambda a, b: a * b)) + PENALTY * c

            ends = F.flatten(_each(lambda j: F.when(s[j] == 0, F.array().cast("array<double>")).otherwise(F.array((lo[j] - x0[j]) / s[j], (hi[j] - x0[j]) / s[j]))))
            tried = F.transform(ends, lambda c: F.struct(c.alias("c"), balance(c).alias("g")))

            def root(t: Column) -> Column:
                left, right = F.array_max(F.filter(t, lambda e: e["g"] <= 0)), F.array_min(F.filter(t, lambda e: e["g"] >= 0))
                between = F.when(left["g"] == right["g"], left["c"]).otherwise(left["c"] - left["g"] * (right["c"] - left["c"]) / (right["g"] - left["g"]))
                return F.coalesce(between, left["c"], right["c"], dbl(0.0))

            return let(let(tried, root), path)

        revenues = F.transform(F.sequence(F.lit(0), F.lit(N)), probe)
        return let(revenues, lambda r: let(slopes(r), lambda s: solved(r[N], s)))

    def gauss_newton(self, x: Column) -> Column:
        every, real = F.array(*[F.lit(True)] * N), F.array(*[F.lit(not w) for w in WHOLE])
        times = lambda n: F.sequence(F.lit(1), F.lit(n))
        loose = F.aggregate(times(FREE_STEPS), x, lambda a, _: self._newton_step(a, every, False))
        places = F.array(*[F.lit(2.0 ** sum(WHOLE[:i]) if w else 0.0) for i, w in enumerate(WHOLE)])

        def corner(k: Column) -> Column:
            """Whole-number levers rounded down or up, as the bits of k say."""
            up = lambda i: F.pmod(F.floor(k / places[i]), F.lit(2))
            whole = F.transform(loose, lambda v, i: F.when(places[i] > 0, _inside(F.floor(v) + up(i), i)).otherwise(v))
            return let(F.aggregate(times(ROUNDED_STEPS), whole, lambda a, _: self._newton_step(a, real, True)), lambda y: self._scored(y, k))

        return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(2 ** sum(WHOLE) - 1)), corner))["x"]

    def compass(self, x: Column) -> Column:
        state = F.struct(x.alias("x"), dbl(COMPASS_STEP).alias("s"))

        def step(a: Column, _: Column) -> Column:
            def move(k: Column) -> Column:
                j, up = F.pmod(k - 1, F.lit(N)), F.when(k <= N, 1.0).otherwise(-1.0)
                moved = F.transform(a["x"], lambda v, i: F.when((k > 0) & (i == j), _inside(v + up * a["s"] * (F.col("_hi")[i] - F.col("_lo")[i]), i)).otherwise(v))
                return let(moved, lambda y: self._scored(y, k))

            best = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(2 * N)), move))
            return let(best, lambda b: F.struct(b["x"].alias("x"), F.when(b["k"] == 0, a["s"] / 2).otherwise(a["s"]).alias("s")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(COMPASS_ROUNDS)), state, step, lambda a: a["x"])

    def evolution(self) -> Column:
        members = F.sequence(F.lit(0), F.lit(self.population - 1))
        first = F.transform(members, lambda i: let(self.point(i), lambda x: self._scored(x, i)))

        def draw(g: Column, i: Column, what: Column | int) -> Column:
            return hashed_uniform(F.col("_seed"), g * 100 + i, what if isinstance(what, Column) else F.lit(what))

        def other(i: Column, u: Column) -> Column:
            """A member that is not i."""
            return F.pmod(i + 1 + F.floor(u * (self.population - 1)).cast("int"), F.lit(self.population))

        def generation(pop: Column, g: Column) -> Column:
            def child(best: Column) -> Callable[[Column, Column], Column]:
                def of(m: Column, i: Column) -> Column:
                    b = other(i, draw(g, i, 0))
                    pair = let(b, lambda b: F.struct(pop[b]["x"].alias("b"), pop[other(b, draw(g, i, 1))]["x"].alias("c")))
                    forced = F.floor(draw(g, i, 2) * N).cast("int")
                    taken = lambda j: (j == forced) | (draw(g, i, 3 + j) < CROSSOVER)
                    mutant = lambda p: _each(lambda j: F.when(taken(j), _inside(best["x"][j] + SCALE * (p["b"][j] - p["c"][j]), j)).otherwise(m["x"][j]))
                    return let(let(let(pair, mutant), lambda y: self._scored(y, i)), lambda y: F.when(y["o"] <= m["o"], y).otherwise(m))

                return of

            return let(F.array_min(pop), lambda best: F.transform(pop, child(best)))

        return F.array_min(F.aggregate(F.sequence(F.lit(1), F.lit(self.generations)), first, generation))["x"]


def as_array(struct: str) -> Column:
    return F.array(*[F.col(f"{struct}.{lv}").cast("double") for lv in NAMES])


def as_struct(x: Column) -> Column:
    return F.struct(*[x[i].alias(lv) for i, lv in enumerate(NAMES)])


def best_levers(df: DataFrame, revenue: Revenue, seed: str, current: str = "clipped", bounds: str = "bounds", target: str = "target_revenue", multi: Column | None = None, methods: tuple[str, ...] = METHODS, **options) -> DataFrame:
    """``df`` with ``optimized`` (levers as searched), ``revenue`` (of the levers as reported),
    ``objective`` and ``method``: the best result of ``methods`` by the row's objective, ties to
    the one named first. ``multi`` says which rows weigh retention, growth and cost as well.

    A current lever outside the box starts from its nearest end. ``revenue`` sees the columns
    of ``df`` and the levers that are tried. A null target has no objective, and levers of any method.
    """
    search = Search(revenue, **options)
    ends = lambda e: F.array(*[F.col(f"{bounds}.{lv}.{e}").cast("double") for lv in NAMES])
    given = {"_lo": ends("lo"), "_hi": ends("hi"), "_x0": as_array(current), "_target": F.col(target), "_seed": F.col(seed), "_multi": F.lit(False) if multi is None else multi}
    box = df.withColumns(given).withColumn("_x0", F.transform("_x0", _inside)).withColumn("_start", search.start()["x"])
    found = {"gauss_newton": search.gauss_newton, "compass": search.compass, "evolution": lambda _: search.evolution(), "start": lambda x: x}
    results = F.array(*[found[m](F.col("_start")) for m in methods])
    scored = F.transform(results, lambda x, i: search._scored(x, i))
    best = box.withColumn("_best", F.array_min(scored))
    return best.select(
        *df.columns, as_struct(F.col("_best.x")).alias("optimized"), search.revenue(F.col("_best.x")).alias("revenue"), F.col("_best.o").alias("objective"),
        F.array(*map(F.lit, methods))[F.col("_best.k")].alias("method"),
    )
