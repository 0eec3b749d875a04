"""Training-row augmentation: noise, bootstrap, interpolation, mixup.

Randomness is a seeded hash of (draw id, stream, seed), so a run gives the same rows
whatever the partitioning or executor losses.  Draws address rows through a dense 0..N-1
index in the order of a key (range partitions and their offsets, no single task): a draws table of
exactly ``n`` ids (``spark.range``, distributed) is joined to the indexed rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import dbl
from ..spec import DEFAULT_SPEC
from .ranks import numbered

TWO53 = float(2**53)


def uniform(*cols: Column, stream: int = 0, seed: int = 42) -> Column:
    """U[0, 1) from a 64-bit hash of the given columns."""
    h = F.xxhash64(*cols, F.lit(stream), F.lit(seed))
    return F.pmod(h, F.lit(2**53)).cast("double") / TWO53


def normal(*cols: Column, stream: int = 0, seed: int = 42) -> Column:
    """N(0, 1) by Box-Muller on two hashed uniforms."""
    u1 = 1.0 - uniform(*cols, stream=2 * stream + 1, seed=seed)  # (0, 1]
    u2 = uniform(*cols, stream=2 * stream + 2, seed=seed)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(dbl(2 * math.pi) * u2)


def dense_index(df: DataFrame, order: list[str], name: str = "row_idx") -> tuple[DataFrame, int]:
    """0..N-1 row ids in ``order``, which must tell rows apart: the ids, and with them all draws,
    do not depend on how the rows are stored or partitioned."""
    out = numbered(df, [], order, name)
    return out, out.count()


def _draws(spark, n: int, size: int, stream: int, seed: int, name: str = "src") -> DataFrame:
    ids = spark.range(n).withColumnRenamed("id", "draw")
    return ids.withColumn(name, F.pmod(F.xxhash64(F.col("draw"), F.lit(stream), F.lit(seed)), F.lit(size)))


def bootstrap(indexed: DataFrame, size: int, n: int, cols: list[str], seed: int = 42, stream: int = 1) -> DataFrame:
    """Exactly ``n`` rows drawn with replacement."""
    d = _draws(indexed.sparkSession, n, size, stream, seed)
    return d.join(indexed.select("row_idx", *cols), d.src == F.col("row_idx")).select("draw", *cols)


def add_noise(df: DataFrame, cols: list[str], level: float = 0.02, seed: int = 42, key: str = "draw") -> DataFrame:
    """x + N(0, level * std(x)) (population std of the given rows), floored at 0."""
    stds = df.agg(*[F.stddev_pop(c).alias(f"_sd{i}") for i, c in enumerate(cols)])
    j = df.crossJoin(F.broadcast(stds))  # one row of statistics
    out = [
        F.greatest(F.col(c) + F.lit(level) * F.col(f"_sd{i}") * normal(F.col(key), stream=10 + i, seed=seed), dbl(0.0)).alias(c)
        for i, c in enumerate(cols)
    ]
    return j.select(key, *out)


def interpolate(indexed: DataFrame, size: int, n: int, cols: list[str], seed: int = 42) -> DataFrame:
    """alpha * a + (1 - alpha) * b, alpha ~ U(0.3, 0.7), a != b."""
    spark = indexed.sparkSession
    d = _draws(spark, n, size, 3, seed, "a").withColumn(
        "b", F.pmod(F.col("a") + 1 + F.pmod(F.xxhash64(F.col("draw"), F.lit(4), F.lit(seed)), F.lit(max(size - 1, 1))), F.lit(size))
    ).withColumn("alpha", 0.3 + 0.4 * uniform(F.col("draw"), stream=5, seed=seed))
    a = indexed.select(F.col("row_idx").alias("a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = indexed.select(F.col("row_idx").alias("b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    j = d.join(a, "a").join(b, "b")
    return j.select("draw", *[(F.col("alpha") * F.col(f"a_{c}") + (1 - F.col("alpha")) * F.col(f"b_{c}")).alias(c) for c in cols])


def beta_jonk(key: Column, a: float, b: float, seed: int, tries: int = 32) -> Column:
    """Beta(a, b) for a, b < 1 by Johnk's rejection method over ``tries`` hashed pairs;
    the first accepted pair is used (acceptance ~0.85 per pair for a = b = 0.4).  A row whose
    pairs are all rejected (odds of 0.15 ** tries) is an error, not a made-up draw."""
    cands = []
    for t in range(tries):
        x = F.pow(uniform(key, stream=100 + 2 * t, seed=seed), 1.0 / a)
        y = F.pow(uniform(key, stream=101 + 2 * t, seed=seed), 1.0 / b)
        cands.append(F.when((x + y <= 1.0) & (x + y > 0), x / (x + y)))
    ok = F.filter(F.array(*cands), lambda v: v.isNotNull())
    return F.when(F.size(ok) > 0, F.get(ok, F.lit(0))).otherwise(F.raise_error(F.lit("no accepted pair; raise tries")).cast("double"))


def mixup(indexed: DataFrame, size: int, n: int, cols: list[str], alpha: float = 0.4, seed: int = 42) -> DataFrame:
    """``n`` distinct rows i (an affine permutation of the index keeps exactly n), each
    mixed with a random row j by lambda ~ Beta(alpha, alpha)."""
    mult = _coprime(size, seed)
    shift = (seed * 7919) % max(size, 1)
    chosen = indexed.where(F.pmod(F.col("row_idx") * mult + shift, F.lit(size)) < n)
    i = chosen.select(F.col("row_idx").alias("draw"), *[F.col(c).alias(f"a_{c}") for c in cols]).withColumn(
        "j", F.pmod(F.xxhash64(F.col("draw"), F.lit(6), F.lit(seed)), F.lit(size))
    ).withColumn("lam", beta_jonk(F.col("draw"), alpha, alpha, seed))
    other = indexed.select(F.col("row_idx").alias("j"), *[F.col(c).alias(f"b_{c}") for c in cols])
    j = i.join(other, "j")
    return j.select("draw", *[(F.col("lam") * F.col(f"a_{c}") + (1 - F.col("lam")) * F.col(f"b_{c}")).alias(c) for c in cols])


def _coprime(n: int, seed: int) -> int:
    if n <= 1:
        return 1
    a = (seed * 2654435761 + 1) % n or 1
    while math.gcd(a, n) != 1:
        a = a % n + 1
    return a


def augment(train: DataFrame, cols: list[str], factor: float = 1.5, methods=("noise", "bootstrap", "interpolate"),
            noise_level: float = 0.02, seed: int = 42, order: tuple = (DEFAULT_SPEC.entity, DEFAULT_SPEC.month)) -> DataFrame:
    """Original rows + int(n * factor) - n synthetic rows split equally over the methods,
    labelled ``split = 'train'`` with the generating method."""
    indexed, size = dense_index(train.select(*dict.fromkeys([*order, *cols])), list(order))
    n_per = (int(size * factor) - size) // len(methods)
    parts = [indexed.select(F.lit("original").alias("method"), *cols)]
    for k, m in enumerate(methods):
        s = seed + k
        if m == "noise":
            part = add_noise(bootstrap(indexed, size, n_per, cols, s), cols, noise_level, s)
        elif m == "bootstrap":
            part = bootstrap(indexed, size, n_per, cols, s, stream=2)
        elif m == "interpolate":
            part = interpolate(indexed, size, n_per, cols, s)
        elif m == "mixup":
            part = mixup(indexed, size, n_per, cols, 0.4, s)
        else:
            raise ValueError(m)
        parts.append(part.select(F.lit(m).alias("method"), *cols))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("split", F.lit("train"))


def validate_augmentation(original: DataFrame, augmented: DataFrame, cols: list[str]) -> DataFrame:
    """Per column |mean diff| % and |std diff| % (population std); accepted when the mean
    over columns is below 10 % and 15 %."""
    def stats(df, tag):
        return df.agg(*[F.avg(c).alias(f"{tag}m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"{tag}s{i}") for i, c in enumerate(cols)])

    one = stats(original, "o").crossJoin(stats(augmented, "a"))
    body = ", ".join(f"'{c}', om{i}, am{i}, os{i}, as{i}" for i, c in enumerate(cols))
    long = one.selectExpr(f"stack({len(cols)}, {body}) AS (feature, original_mean, augmented_mean, original_std, augmented_std)")
    md = F.abs(F.col("original_mean") - F.col("augmented_mean")) / (F.col("original_mean") + 1e-10) * 100
    sd = F.abs(F.col("original_std") - F.col("augmented_std")) / (F.col("original_std") + 1e-10) * 100
    long = long.withColumn("mean_diff_pct", md).withColumn("std_diff_pct", sd)
    from pyspark.sql import Window

    w = Window.partitionBy()
    return long.withColumn(
        "accepted", (F.avg("mean_diff_pct").over(w) < 10) & (F.avg("std_diff_pct").over(w) < 15)
    )


__all__ = ["uniform", "normal", "dense_index", "bootstrap", "add_noise", "interpolate", "mixup", "augment", "validate_augmentation"]
