"""Second-order gradient boosting from distributed histograms.

Features are cut at quantiles once; a row is then a short array of bin numbers. A pass over the
rows adds gradients and counts by (target, node, feature, bin) in its tasks and one small
grouped sum after them, for the trees of all targets at once; the driver sees as many numbers
as the histograms have, whatever the rows. A tree grows by levels, the splits of a level are
made in the order of their gain until the leaves are used up, with L2 on leaf weights, a least
gain and a least weight of children. Rows and columns are sampled by hash, so a fit does not
depend on partitions. The first pass of a round also gives the validation loss of the trees
before it; a target stops after ``patience`` rounds without a better one and keeps its best.

Predictions of finished trees are written every ``WRITE_EVERY`` rounds, so a pass applies a
bounded number of trees to each row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .ranks import column_quantiles

WRITE_EVERY = 10


@dataclass(frozen=True)
class Params:
    rounds: int = 300
    learning_rate: float = 0.05
    max_depth: int = 5
    max_leaves: int = 32
    bins: int = 32
    l2: float = 1.0
    min_gain: float = 0.0
    min_child: float = 1.0
    row_share: float = 0.8
    column_share: float = 0.8
    patience: int = 20
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number; a leaf has feature -1. Rows with a bin up to ``cut`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(bins), np.int64)
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        while len(at):
            f = feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                break
            n = at[inner]
            at[inner] = np.where(bins[inner, f[inner]] <= cut[n], left[n], right[n])
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]

    def split(self, node: int, feature: int, cut: int, gain: float) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            for column, empty in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
                column.append(empty)
        return self.left[node], self.right[node]


@dataclass
class BoostedModel:
    features: list[str]
    targets: list[str]
    edges: np.ndarray  # features x (bins - 1), rising
    base: np.ndarray
    trees: list[list[Tree]]  # by target
    losses: list[list[float]]  # validation loss by target before each round

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(bins), 1))
        for t, trees in enumerate(self.trees):
            for tree in trees:
                out[:, t] += tree.predict(bins)
        return out


def hashed(*parts) -> np.ndarray:
    """In (0, 1): the congruential hash of ``whatif.hashed_uniform`` over numpy arrays."""
    h = np.int64(12345)
    for p, m in zip(parts, (7919, 104729, 1299709), strict=False):
        h = h + np.asarray(p, np.int64) * m
    h = h % 2147483647
    for _ in range(3):
        h = (h * 48271 + 11) % 2147483647
    return (h + 0.5) / 2147483647


def sampled_columns(p: int, params: Params, number: int) -> np.ndarray:
    """Which features round ``number`` may split on: those with the smallest hashes."""
    keep = max(1, int(np.ceil(params.column_share * p)))
    order = np.argsort(hashed(np.full(p, params.seed), np.full(p, number), np.arange(p)), kind="stable")
    out = np.zeros(p, bool)
    out[order[:keep]] = True
    return out


def best_splits(hist: np.ndarray, params: Params, allowed: np.ndarray) -> list[tuple[float, int, int, float, float]]:
    """Per node: (gain, feature, cut, gradient, count); feature -1 where no split is worth it.
    ``hist``: nodes x features x bins x (gradient, count). Ties go to the lower feature and cut."""
    out = []
    score = lambda g, h: g * g / (h + params.l2)
    for node in hist:
        total = node[0].sum(0)
        left = np.cumsum(node, 1)[:, :-1]
        right = total - left
        gain = 0.5 * (score(left[..., 0], left[..., 1]) + score(right[..., 0], right[..., 1]) - score(total[0], total[1])) - params.min_gain
        ok = allowed[:, None] & (left[..., 1] >= max(params.min_child, 1)) & (right[..., 1] >= max(params.min_child, 1))
        gain = np.where(ok, gain, -np.inf)
        at = int(np.argmax(gain)) if gain.size else 0
        f, c = divmod(at, gain.shape[1]) if gain.size else (0, 0)
        best = float(gain[f, c]) if gain.size else -np.inf
        out.append((best, f, c, float(total[0]), float(total[1])) if best > 1e-12 else (0.0, -1, 0, float(total[0]), float(total[1])))
    return out


def leaf_value(gradient: float, count: float, params: Params) -> float:
    return -gradient / (count + params.l2) * params.learning_rate


def grow_level(trees: list[Tree], open_: list[list[int]], hist: list[np.ndarray], params: Params, allowed: np.ndarray) -> list[list[int]]:
    """Split the open leaves of each tree, the greatest gain first, while leaves remain; the
    new leaves, which the next level may split. All leaves seen get their weight."""
    new: list[list[int]] = []
    for tree, nodes, h in zip(trees, open_, hist, strict=True):
        found = best_splits(h, params, allowed)
        for node, (_, _, _, g, n) in zip(nodes, found, strict=True):
            tree.value[node] = leaf_value(g, n, params)
        leaves = sum(f < 0 for f in tree.feature)
        added: list[int] = []
        order = sorted(range(len(nodes)), key=lambda k: (-found[k][0], nodes[k]))
        for k in order:
            gain, f, cut, _, _ = found[k]
            if f < 0 or leaves >= params.max_leaves:
                continue
            node = nodes[k]
            at = np.cumsum(h[k, f], 0)[cut]
            rest = h[k, f].sum(0) - at
            a, b = tree.split(node, f, cut, gain)
            tree.value[a], tree.value[b] = leaf_value(at[0], at[1], params), leaf_value(rest[0], rest[1], params)
            added += [a, b]
            leaves += 1
        new.append(added)
    return new


def _arrays(b: pa.RecordBatch, p: int, q: int) -> tuple[np.ndarray, ...]:
    flat = lambda i, w: np.asarray(b.column(i).flatten()).reshape(-1, w)
    return flat(0, p), flat(1, q), flat(2, q), np.asarray(b.column(3)), np.asarray(b.column(4).to_numpy(zero_copy_only=False), bool)


def _pass(rows: DataFrame, p: int, q: int, params: Params, finished: list[list[Tree]], growing: list[Tree] | None, open_: list[list[int]], number: int, losses: bool):
    """Histograms of the open leaves by target, and with ``losses`` the (squared error, rows)
    of the validation rows and by target. ``finished`` are trees not yet in the margins."""
    bins = params.bins
    shared = rows.sparkSession.sparkContext.broadcast((finished, growing, open_))  # trees of a few rounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, trees, nodes = shared.value
        sizes = [len(n) * p * bins for n in nodes]
        start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        sums, counts = np.zeros(start[-1] + 2 * q), np.zeros(start[-1] + 2 * q, np.int64)
        for b in batches:
            x, y, margin, key, held = _arrays(b, p, q)
            margin = margin.copy()
            for t in range(q):
                for tree in done[t]:
                    margin[:, t] += tree.predict(x)
            if losses:
                for part, which in enumerate((~held, held)):
                    sums[start[-1] + part * q : start[-1] + (part + 1) * q] += ((y[which] - margin[which]) ** 2).sum(0)
                    counts[start[-1] + part * q : start[-1] + (part + 1) * q] += int(which.sum())
            use = ~held & (hashed(key, np.full(len(key), params.seed), np.full(len(key), number)) < params.row_share)
            x, g = x[use], (margin - y)[use]
            for t in range(q):
                if not len(nodes[t]) or not len(x):
                    continue
                place = np.full(len(trees[t].feature), -1)
                place[nodes[t]] = np.arange(len(nodes[t]))
                at = place[trees[t].nodes(x)]
                inside = at >= 0
                cell = (at[inside, None] * p + np.arange(p)) * bins + x[inside]
                sums[start[t] : start[t + 1]] += np.bincount(cell.ravel(), np.repeat(g[inside, t], p), sizes[t])
                counts[start[t] : start[t + 1]] += np.bincount(cell.ravel(), minlength=sizes[t])
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some]), pa.array(counts[some])], names=["cell", "s", "n"])

    got = rows.mapInArrow(run, "cell long, s double, n long").groupBy("cell").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toArrow()
    sizes = [len(n) * p * bins for n in open_]
    flat = np.zeros((sum(sizes) + 2 * q, 2))
    flat[got["cell"].to_numpy()] = np.stack([got["s"].to_numpy(), got["n"].to_numpy()], 1)
    shared.unpersist()
    hists, at = [], 0
    for t, size in enumerate(sizes):
        hists.append(flat[at : at + size].reshape(len(open_[t]), p, bins, 2))
        at += size
    return hists, flat[at:].reshape(2, q, 2)


def bin_edges(df: DataFrame, features: list[str], bins: int) -> np.ndarray:
    """Quantiles k / bins of each feature: features x (bins - 1) numbers."""
    qs = [k / bins for k in range(1, bins)]
    row = column_quantiles(df, features, qs).first()
    return np.array([[row[f"q{k}_{i}"] for k in range(len(qs))] for i in range(len(features))], dtype=float)


def binned(features: list[str], edges: np.ndarray) -> Column:
    """Array of each feature's bin: how many edges lie below the value."""

    def bin_of(name: str, e: np.ndarray) -> Column:
        v = F.col(f"`{name}`").cast("double")
        return F.size(F.filter(F.array(*[F.lit(float(x)) for x in e]), lambda x: x < v)).cast("int")

    return F.array(*[bin_of(c, e) for c, e in zip(features, edges, strict=True)])


def fit(df: DataFrame, features: list[str], targets: list[str], held: Column, key: Column, params: Params = Params()) -> BoostedModel:
    """Boosted trees for each target, fitted on the rows that are not ``held`` and stopped by
    those that are; without held rows all rounds run. ``key`` is a whole number that tells rows
    apart. Rows with a null feature or target are left out; without rows there are no trees."""
    ensure_checkpoint_dir(df.sparkSession)
    p, q = len(features), len(targets)
    src = df.withColumn("_held", held).withColumn("_key", key.cast("long"))
    src = src.select("_held", "_key", *[F.col(f"`{c}`").cast("double").alias(c) for c in [*features, *targets]]).na.drop().checkpoint()
    used = src.where(~F.col("_held"))
    means = used.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(targets)]).first()
    base = np.array([means[f"m{t}"] if means[f"m{t}"] is not None else 0.0 for t in range(q)])
    model = BoostedModel(list(features), list(targets), np.zeros((p, params.bins - 1)), base, [[] for _ in targets], [[] for _ in targets])
    if means["m0"] is None:
        return model
    model.edges = bin_edges(used, features, params.bins)
    y = F.array(*[F.col(c) for c in targets])
    rows = src.select(binned(features, model.edges).alias("x"), y.alias("y"), F.array(*[F.lit(float(b)) for b in base]).alias("margin"), F.col("_key").alias("key"), F.col("_held").alias("held")).checkpoint()
    written, best, running = 0, [(np.inf, 0)] * q, [True] * q
    for number in range(params.rounds + 1):
        trees = [Tree() for _ in targets]
        open_ = [[0] if on and number < params.rounds else [] for on in running]
        allowed = sampled_columns(p, params, number)
        for level in range(max(1, params.max_depth)):
            fresh = [t[written:] for t in model.trees]
            hists, loss = _pass(rows, p, q, params, fresh, trees, open_, number, level == 0)
            if level == 0 and loss[1, 0, 1] > 0:
                for t in range(q):
                    if not running[t]:
                        continue
                    now = float(loss[1, t, 0] / loss[1, t, 1])
                    model.losses[t].append(now)
                    if now < best[t][0]:
                        best[t] = (now, number)
                    elif number - best[t][1] >= params.patience:
                        running[t], open_[t] = False, []
                        hists[t] = np.zeros((0, p, params.bins, 2))
            elif level == 0:
                best = [(0.0, number)] * q
            if not any(open_):
                break
            open_ = grow_level(trees, open_, hists, params, allowed)
        if not any(running) or number == params.rounds:
            break
        for t in range(q):
            model.trees[t].append(trees[t] if running[t] else Tree())
        if (number + 1) % WRITE_EVERY == 0:
            rows, written = _with_margins(rows, model, written, p, q).checkpoint(), number + 1
    model.trees = [t[: best[i][1]] for i, t in enumerate(model.trees)]
    return model


def _with_margins(rows: DataFrame, model: BoostedModel, written: int, p: int, q: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast([t[written:] for t in model.trees])
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _, margin, _, _ = _arrays(b, p, q)
            margin = margin.copy()
            for t, trees in enumerate(shared.value):
                for tree in trees:
                    margin[:, t] += tree.predict(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * q + 1, q), pa.int32()), pa.array(margin.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, b.column(3), b.column(4)], names=["x", "y", "margin", "key", "held"])

    return rows.mapInArrow(run, T.StructType(schema.fields))


def predict(df: DataFrame, model: BoostedModel, prefix: str = "predicted_") -> DataFrame:
    """``df`` with the predictions of all targets; null where a feature is null."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # as large as its trees
    names = [f"{prefix}{t}" for t in model.targets]
    complete = F.lit(True)
    for c in model.features:
        complete = complete & F.col(f"`{c}`").isNotNull()

    @F.pandas_udf("array<double>")
    def margins(x):
        out = shared.value.margins(np.stack(x.to_list())) if len(x) else np.zeros((0, len(names)))
        import pandas as pd

        return pd.Series(list(out))

    scored = df.withColumn("_m", F.when(complete, margins(binned(model.features, model.edges))))
    return scored.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col("_m")[t].alias(n) for t, n in enumerate(names)])


def tree_rows(model: BoostedModel, number: int = 0) -> list[tuple]:
    """(target, node, feature, edge, gain, value) of one round's trees, by node number."""
    out = []
    for t, target in enumerate(model.targets):
        if number < len(model.trees[t]):
            tree = model.trees[t][number]
            for i, f in enumerate(tree.feature):
                name, edge = (model.features[f], float(model.edges[f, tree.cut[i]])) if f >= 0 else (None, None)
                out.append((target, i, name, edge, tree.gain[i] if f >= 0 else None, tree.value[i]))
    return out


def gain_importance(model: BoostedModel, target: str) -> list[tuple[str, float]]:
    """Share of the whole gain by feature, the greatest first."""
    total: dict[str, float] = dict.fromkeys(model.features, 0.0)
    for tree in model.trees[model.targets.index(target)]:
        for f, g in zip(tree.feature, tree.gain, strict=True):
            if f >= 0:
                total[model.features[f]] += g
    whole = sum(total.values()) or 1.0
    return sorted(((n, g / whole) for n, g in total.items()), key=lambda r: (-r[1], r[0]))
