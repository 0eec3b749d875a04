"""Importance resampling towards a target distribution.

Words and word pairs are hashed into a fixed number of buckets; how often each bucket occurs in
the documents and in the target texts gives it a gain, an array of fixed size that scores whole
texts. Scores carry Gumbel noise derived from the id, so taking the highest scores draws without
replacement in proportion to the exponential of the weights.

The order is a distributed least-significant-digit radix sort (``radix_positions``): each pass
counts digits by chunk of ``CHUNK`` consecutive positions, turns the counts into global prefix
offsets, and moves every row to its destination; the last pass leaves the ranks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import as_table, per_text, prepare, utf8
from .decontaminate import words_of

BUCKETS = 10_000
SEED = 7
MIN_WORDS = 20
#: share of the eligible documents that is drawn
PERCENT = 25
#: bytes of a text whose words are held at a time
BLOCK_BYTES = 1 << 20

#: bits of a digit, and rows of a chunk: 256 counts for 8192 rows
DIGIT_BITS = 8
CHUNK = 1 << 13

MEASURES = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in blocks of about ``BLOCK_BYTES``."""
    if len(text) <= BLOCK_BYTES:
        yield words_of(text)
        return
    rest = b""
    for at in range(0, len(text), BLOCK_BYTES):
        piece = rest + text[at : at + BLOCK_BYTES]
        words = words_of(piece)
        rest = b""
        if words and at + BLOCK_BYTES < len(text) and words_of(piece[-1:]):
            rest = words.pop()  # may go on in the next piece
        yield words


def feature_buckets(text: bytes, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of their features) by block: every word, and every word after another
    one with it. The checksum of a pair goes on from that of its first word."""
    before: int | None = None
    for words in word_blocks(text):
        if not words:
            continue
        single = list(map(crc32, words))
        pairs = list(map(crc32, [b" " + w for w in words[1:]], single))
        if before is not None:
            pairs.append(crc32(b" " + words[0], before))
        before = single[-1]
        yield len(words), np.array(single + pairs, np.uint32) % np.uint32(buckets)


def bucket_counts(docs: DataFrame, text_col: str, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. ``buckets`` numbers reach the driver."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(buckets, np.int64)
        for b in batches:
            for text in utf8(b.column(0)):
                for _, found in feature_buckets(text, buckets):
                    have += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(have[at], pa.int64())], names=["bucket", "n"])

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    ratio = lambda have, want: (float(want + 1) * float(s + n)) / (float(have + 1) * float(t + n))
    return np.array([math.floor(1000 * math.log(ratio(a, b))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n_words, n_features and weight, the mean gain of the features rounded down."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # 8 bytes a bucket

    def make():
        table = shared.value

        def measure(text: bytes) -> tuple[int, int, int]:
            words = features = total = 0
            for n, found in feature_buckets(text, len(table)):
                words += n
                features += len(found)
                total += int(table[found].sum())
            return words, features, total // features if features else 0

        return lambda column: [measure(t) for t in utf8(column)]

    out = per_text(docs, text_col, MEASURES, make, "_m_", [id_col])
    return out.select(F.col(f"`{id_col}`").alias("id"), "_m_.*")


# --- radix sort ---------------------------------------------------------------------------


def _one_pass(rows: DataFrame, key: str, shift: int) -> DataFrame:
    """``rows`` with ``at``, the destination of each in the stable order of one digit."""
    rows = rows.withColumn("chunk", F.expr(f"at div {CHUNK}")).withColumn("digit", F.shiftrightunsigned(F.col(key), shift).bitwiseAND((1 << DIGIT_BITS) - 1).cast("int"))
    counts = as_table(rows.groupBy("digit", "chunk").agg(F.count(F.lit(1)).alias("n")), "radix-counts")
    totals = dict(counts.groupBy("digit").agg(F.sum("n")).collect())  # one row for each value of a digit
    first = [0, *accumulate(totals.get(d, 0) for d in range(1 << DIGIT_BITS))]
    base = F.element_at(F.array(*[F.lit(x).cast("long") for x in first]), F.col("digit") + 1)
    earlier = Window.partitionBy("digit").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("chunk", "digit", (base + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("start"))
    out = T.StructType([f for f in rows.schema.fields if f.name not in ("chunk", "digit")])
    arrow = to_arrow_schema(out)

    def place(chunk: pa.Table, offsets: pa.Table) -> pa.Table:
        """Counting sort of one chunk: rows of a digit take the places from its offset on."""
        digit = chunk["digit"].to_numpy()
        order = np.lexsort((chunk["at"].to_numpy(), digit))
        digit = digit[order]
        start = np.zeros(1 << DIGIT_BITS, np.int64)
        start[offsets["digit"].to_numpy()] = offsets["start"].to_numpy()
        at = start[digit] + np.arange(len(digit)) - np.searchsorted(digit, digit)
        moved = chunk.take(pa.array(order)).drop_columns(["chunk", "digit", "at"]).append_column("at", pa.array(at, pa.int64()))
        return moved.select(arrow.names).cast(arrow)

    return as_table(rows.groupBy("chunk").cogroup(starts.groupBy("chunk")).applyInArrow(place, out), "radix-pass")


def radix_positions(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """``rows`` with ``position``, 0 for the first in the rising order of the long columns
    ``keys``, which compare as unsigned numbers, the first before the others.

    Rows with equal keys get consecutive positions. Digits in which no two keys differ take no
    pass. A group is one chunk of at most ``CHUNK`` rows, however often a digit occurs.
    """
    rows = as_table(rows.withColumn("at", F.monotonically_increasing_id()), "radix-rows")
    bounds = rows.agg(*[f(k).alias(f"{n}{i}") for i, k in enumerate(keys) for n, f in (("o", F.bit_or), ("a", F.bit_and))]).first()
    digits = []
    for i in reversed(range(len(keys))):
        differ = ((bounds[f"o{i}"] or 0) ^ (bounds[f"a{i}"] or 0)) & (2**64 - 1)
        digits += [(keys[i], s) for s in range(0, 64, DIGIT_BITS) if (differ >> s) & ((1 << DIGIT_BITS) - 1)]
    for key, shift in digits or [(keys[-1], 0)]:
        rows = _one_pass(rows, key, shift)
    return rows.withColumnRenamed("at", position)


# --- the draw -----------------------------------------------------------------------------


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Per row of ``docs``: id, n_features, weight, score, and rank from 1 for the ``percent``
    of the rows with at least ``min_words`` words that have the highest scores (others null).

    Ids are whole numbers (others raise). A null text has no words and weight 0; a null id
    draws its noise from the empty string and comes after other ids of equal score; rows that
    repeat an id take consecutive ranks. Without documents or target texts all counts are 0.
    """
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{id_col} is {kind.simpleString()}, not a whole number")
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text_col, buckets))
    uniform = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long") + 0.5) / F.lit(4294967296.0)
    scored = weigh(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))))
    scored = as_table(scored, "resample-scores")
    eligible = scored.where(F.col("n_words") >= min_words)
    some = eligible.agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top")).first()
    keyed = eligible.select(
        *scored.columns,
        (F.lit(some.top) - F.col("score")).cast("long").alias("k_score"),
        F.col("id").isNull().cast("long").alias("k_null"),
        F.coalesce(F.col("id").cast("long"), F.lit(0)).bitwiseXOR(F.lit(-(2**63))).alias("k_id"),
    )
    drawn = percent * some.n // 100
    ranked = radix_positions(keyed, ["k_score", "k_null", "k_id"], "position")
    rank = F.when(F.col("position") < drawn, F.col("position") + 1).cast("long")
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    out = ranked.withColumn("rank", rank).select(*scored.columns, "rank").unionByName(rest)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
