"""Linear models from distributed sufficient statistics.

The data never leaves the cluster: one pass builds the augmented Gram matrix
``G = sum z z^T`` with ``z = [1, x - s_x, y - s_y]`` per group key (fold, month, entity ...).
Each task multiplies its Arrow batches with numpy (``z^T z``, BLAS) and emits the upper
triangle as long rows; a Spark ``groupBy`` adds the partial matrices (map-side combine, then
one small shuffle).  Only d x d numbers per key (d = 1 + features + targets) reach the
driver, which solves the k x k systems.

Everything the reference fits with scikit-learn on the full matrix is re-expressed on G:
standard scaling (population std), ridge with an unpenalised intercept, elastic net / lasso
by coordinate descent on the covariance, F-regression scores, k-fold CV (train Gram = total
- fold Gram, scores from the fold's own Gram), and walk-forward folds (sums of month Grams).
The shift ``s`` (column means) keeps the uncentred sums well conditioned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --------------------------------------------------------------------------- Gram


def column_means(df: DataFrame, cols: list[str]) -> np.ndarray:
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return np.array([row[f"m{i}"] if row[f"m{i}"] is not None else 0.0 for i in range(len(cols))], dtype=float)


def gram_table(
    df: DataFrame, cols: list[str], keys: list[str] | tuple = (), shift: np.ndarray | None = None
) -> DataFrame:
    """Long table ``(keys..., i, j, v)`` of the upper triangle of ``sum z z^T`` per key,
    with ``z = [1, cols - shift]``.  Rows holding a NULL in ``cols`` are skipped."""
    keys = list(keys)
    d = len(cols) + 1
    shift = np.zeros(len(cols)) if shift is None else np.asarray(shift, dtype=float)
    iu, ju = np.triu_indices(d)
    key_fields = [df.schema[k] for k in keys]
    out_schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in key_fields]
        + [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("v", T.DoubleType())]
    )
    src = df.select(*keys, *[F.col(c).cast("double").alias(f"c{n}") for n, c in enumerate(cols)]).na.drop(
        subset=[f"c{n}" for n in range(len(cols))]
    )
    names = [f"c{n}" for n in range(len(cols))]

    def partial(batches):
        acc: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            groups = pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]
            for k, g in groups:
                x = g[names].to_numpy(dtype=float) - shift
                z = np.empty((x.shape[0], d))
                z[:, 0] = 1.0
                z[:, 1:] = x
                m = z.T @ z
                kk = k if isinstance(k, tuple) else (k,)
                acc[kk] = acc[kk] + m if kk in acc else m
        for kk, m in acc.items():
            cols_out = {k: [kk[n]] * len(iu) for n, k in enumerate(keys)}
            cols_out.update({"i": iu.astype("int32"), "j": ju.astype("int32"), "v": m[iu, ju]})
            yield pd.DataFrame(cols_out)

    parts = src.mapInPandas(partial, out_schema)
    return parts.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def collect_grams(gt: DataFrame, d: int, keys: list[str] | tuple = ()) -> dict:
    """Driver side: {key tuple: d x d matrix}.  Size is keys x d^2, independent of rows."""
    keys = list(keys)
    pdf = gt.toPandas()
    out = {}
    if keys:
        grouped = pdf.groupby(keys, sort=True)
    else:
        grouped = [((), pdf)]
    for k, g in grouped:
        m = np.zeros((d, d))
        m[g["i"].to_numpy(), g["j"].to_numpy()] = g["v"].to_numpy()
        m = m + np.triu(m, 1).T
        out[k if isinstance(k, tuple) else (k,)] = m
    return out


# --------------------------------------------------------------------------- statistics


@dataclass
class Moments:
    n: float
    mean_x: np.ndarray
    mean_y: np.ndarray
    cxx: np.ndarray  # centred sums
    cxy: np.ndarray
    cyy: np.ndarray

    @property
    def std_x(self) -> np.ndarray:
        """Population std with zeros replaced by 1 (StandardScaler behaviour); what is left of a
        constant column by subtraction counts as zero."""
        var = np.clip(np.diag(self.cxx) / self.n, 0, None)
        s = np.sqrt(var)
        s[(s < 10 * np.finfo(float).eps) | (var <= 1e-12 * (var + self.mean_x**2))] = 1.0
        return s


def moments(g: np.ndarray, p: int) -> Moments:
    n = g[0, 0]
    sx, sy = g[0, 1 : 1 + p], g[0, 1 + p :]
    mx, my = sx / n, sy / n
    cxx = g[1 : 1 + p, 1 : 1 + p] - n * np.outer(mx, mx)
    cxy = g[1 : 1 + p, 1 + p :] - n * np.outer(mx, my)
    cyy = g[1 + p :, 1 + p :] - n * np.outer(my, my)
    return Moments(n, mx, my, cxx, cxy, cyy)


def f_regression(g: np.ndarray, p: int, target: int = 0) -> np.ndarray:
    """Univariate F = r^2 / (1 - r^2) * (n - 2) of every feature against one target."""
    mo = moments(g, p)
    vx = np.diag(mo.cxx)
    vy = mo.cyy[target, target]
    with np.errstate(divide="ignore", invalid="ignore"):
        r = mo.cxy[:, target] / np.sqrt(vx * vy)
        f = r * r / (1 - r * r) * (mo.n - 2)
    return f


# --------------------------------------------------------------------------- models


@dataclass
class LinearModel:
    """Raw-space linear predictor ``y = intercept + X @ coef`` for several targets, plus the
    scaling it was fitted under (for explanations)."""

    features: list[str]
    targets: list[str]
    coef: np.ndarray  # p x q, raw feature units
    intercept: np.ndarray  # q
    mean_x: np.ndarray
    std_x: np.ndarray
    kind: str = "ridge"
    params: dict = field(default_factory=dict)

    def scaled_coef(self) -> np.ndarray:
        return self.coef * self.std_x[:, None]

    def predict_columns(self, prefix: str = "predicted_", available=None) -> list[Column]:
        """One literal dot-product expression per target (codegen, no UDF, no join).
        Features missing from ``available`` count as 0.0 (serving-time rule)."""
        out = []
        for t, name in enumerate(self.targets):
            e = F.lit(float(self.intercept[t]))
            for j, c in enumerate(self.features):
                b = float(self.coef[j, t])
                if b != 0.0 and (available is None or c in available):
                    e = e + F.lit(b) * F.col(c).cast("double")
            out.append(e.alias(f"{prefix}{name}"))
        return out

    def total_from(self, features: dict[str, Column], targets: list[str]) -> Column:
        """Sum of the predictions of ``targets`` from feature columns by name (also inside a
        lambda, where a feature is no column of the frame), as one dot product; features that
        are not given count as 0.0."""
        at = [self.targets.index(t) for t in targets]
        e = F.lit(float(self.intercept[at].sum()))
        for c, b in zip(self.features, self.coef[:, at].sum(1)):
            if b != 0.0 and c in features:
                e = e + F.lit(float(b)) * features[c].cast("double")
        return e

    def coefficient_table(self, spark: SparkSession, version: str = "v1") -> DataFrame:
        rows = []
        for t, name in enumerate(self.targets):
            for j, c in enumerate(self.features):
                rows.append((version, self.kind, name, c, float(self.coef[j, t]), float(self.scaled_coef()[j, t]),
                             float(self.mean_x[j]), float(self.std_x[j]), float(self.intercept[t])))
        schema = "version string, model string, target string, feature string, coef double, scaled_coef double, mean double, std double, intercept double"
        return spark.createDataFrame(rows, schema)


def _unshift(mo: Moments, w_scaled: np.ndarray, std: np.ndarray, shift_x: np.ndarray, shift_y: np.ndarray):
    coef = w_scaled / std[:, None]
    intercept_shifted = mo.mean_y - mo.mean_x @ coef
    intercept = intercept_shifted + shift_y - shift_x @ coef
    return coef, intercept


def solve_ridge(g: np.ndarray, p: int, alpha: float, shift_x=None, shift_y=None, scale: bool = True):
    mo = moments(g, p)
    q = mo.cxy.shape[1]
    shift_x = np.zeros(p) if shift_x is None else shift_x
    shift_y = np.zeros(q) if shift_y is None else shift_y
    std = mo.std_x if scale else np.ones(p)
    a = mo.cxx / np.outer(std, std) + alpha * np.eye(p)
    w = np.linalg.solve(a, mo.cxy / std[:, None])
    coef, intercept = _unshift(mo, w, std, shift_x, shift_y)
    return coef, intercept, mo, std


def _face_minimum(qm: np.ndarray, qv: np.ndarray, l1: float, w: np.ndarray) -> None:
    """Moves ``w`` (in place) to the minimum of ``w'qm w/2 - qv'w + l1 |w|_1`` among the
    vectors with its zeros and signs. Where the straight way there changes a sign, it stops at
    that zero and goes on without the coordinate. Singular directions count as barely curved,
    so the way never leads up, and is long where only the norm falls."""
    on = np.flatnonzero(w)
    while len(on):
        sub = qm[np.ix_(on, on)]
        values, vectors = np.linalg.eigh(sub)
        least = values[-1] * len(on) * np.finfo(float).eps
        down = vectors.T @ (qv[on] - l1 * np.sign(w[on]) - sub @ w[on])
        down[(values <= least) & (np.abs(down) <= 1e-12 * (np.abs(qv).max() + l1))] = 0.0  # rounding
        step = vectors @ (down / np.maximum(values, least))
        back = step * w[on] < 0
        reach = np.full(len(on), np.inf)
        reach[back] = -w[on][back] / step[back]
        if reach.min() >= 1.0:
            w[on] += step
            return
        w[on] += reach.min() * step
        w[on[reach == reach.min()]] = 0.0
        on = np.flatnonzero(w)


def solve_elastic_net(
    g: np.ndarray, p: int, alpha: float, l1_ratio: float, shift_x=None, shift_y=None,
    max_iter: int = 10000, tol: float = 1e-10,
):
    """Coordinate descent on the scaled covariance for
    1/(2n)||y - Xw||^2 + alpha*l1*|w|_1 + alpha*(1-l1)/2*|w|^2 (per target).

    Sweeps alone need about as many rounds as the covariance is ill-conditioned; nearly
    collinear features (one count a multiple of another but for rounding) would take millions.
    So after every 50 the minimum for the signs reached is solved for directly; sweeps then
    confirm it or bring in other features."""
    mo = moments(g, p)
    q = mo.cxy.shape[1]
    shift_x = np.zeros(p) if shift_x is None else shift_x
    shift_y = np.zeros(q) if shift_y is None else shift_y
    std = mo.std_x
    qm = mo.cxx / np.outer(std, std) / mo.n
    qv = mo.cxy / std[:, None] / mo.n
    l1 = alpha * l1_ratio
    l2 = alpha * (1 - l1_ratio)
    w = np.zeros((p, q))
    for t in range(q):
        wt = w[:, t]
        for sweep in range(1, max_iter + 1):
            max_delta = 0.0
            for j in range(p):
                rho = qv[j, t] - qm[j] @ wt + qm[j, j] * wt[j]
                new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (qm[j, j] + l2) if qm[j, j] + l2 > 0 else 0.0
                max_delta = max(max_delta, abs(new - wt[j]))
                wt[j] = new
            if max_delta <= tol * max(1.0, np.abs(wt).max()):
                break
            if sweep % 50 == 0:
                _face_minimum(qm + l2 * np.eye(p), qv[:, t], l1, wt)
        else:
            raise RuntimeError(f"coordinate descent did not converge in {max_iter} sweeps (last change {max_delta:.3g})")
    coef, intercept = _unshift(mo, w, std, shift_x, shift_y)
    return coef, intercept, mo, std


def fit_from_gram(g, features, targets, kind="ridge", alpha=5.0, l1_ratio=0.5, shift=None) -> LinearModel:
    p = len(features)
    shift = np.zeros(p + len(targets)) if shift is None else shift
    sx, sy = shift[:p], shift[p:]
    if kind == "ridge":
        coef, b, mo, std = solve_ridge(g, p, alpha, sx, sy)
        params = {"alpha": alpha}
    elif kind in ("elastic_net", "lasso"):
        l1 = 1.0 if kind == "lasso" else l1_ratio
        coef, b, mo, std = solve_elastic_net(g, p, alpha, l1, sx, sy)
        params = {"alpha": alpha, "l1_ratio": l1}
    else:
        raise ValueError(kind)
    return LinearModel(list(features), list(targets), coef, b, mo.mean_x + sx, std, kind, params)


def sse_from_gram(g: np.ndarray, p: int, coef: np.ndarray, intercept: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Per-target SSE and centred SST of a raw-space model on the rows behind ``g``."""
    q = coef.shape[1]
    sx, sy = shift[:p], shift[p:]
    sse = np.zeros(q)
    for t in range(q):
        # residual = (y_t - sy_t) - [c' + coef^T (x - sx)],  c' = intercept + sx.coef - sy_t
        c_shift = intercept[t] + sx @ coef[:, t] - sy[t]
        a = np.zeros(g.shape[0])
        a[0] = -c_shift
        a[1 : 1 + p] = -coef[:, t]
        a[1 + p + t] = 1.0
        sse[t] = a @ g @ a
    mo = moments(g, p)
    sst = np.diag(mo.cyy).copy()
    return sse, sst, mo.n


def flat_r2_rmse(g: np.ndarray, p: int, coef, intercept, shift) -> tuple[float, float]:
    """R2 of all targets flattened together and sqrt(mean per-target MSE), as the
    reference's cross-validation reports them."""
    sse, _, n = sse_from_gram(g, p, coef, intercept, shift)
    q = coef.shape[1]
    sy = shift[p:]
    s1 = g[0, 1 + p :] + n * sy  # unshifted sums of y
    yy = np.diag(g[1 + p :, 1 + p :]) + 2 * sy * g[0, 1 + p :] + n * sy * sy  # unshifted sums of y^2
    total = s1.sum()
    sst_flat = yy.sum() - total * total / (n * q)
    r2 = 1 - sse.sum() / sst_flat
    rmse = float(np.sqrt(sse.sum() / (n * q)))
    return float(r2), rmse


def dot_expr(features: list[str], coef_col: str) -> Column:
    """sum_j x_j * coef[j] with the coefficients in an array column (fold-specific models)."""
    xs = F.array(*[F.col(c).cast("double") for c in features])
    return F.aggregate(F.zip_with(xs, F.col(coef_col), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
