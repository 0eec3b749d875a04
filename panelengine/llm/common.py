"""Helpers shared by the text operators: Arrow passes over whole texts, hashing of word
shingles, tables in the cluster's shared folder, connected components.

Conventions of all operators: a null text is an empty text; a null id is kept as null; rows
that repeat both id and text are the same document and get the same result; columns an
operator does not know pass through or are left out, never read; an empty table gives an
empty result with the same columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelengine.session import ensure_checkpoint_dir

#: rows of one Arrow batch: whole texts are long, so batches are kept short
BATCH_ROWS = 512
#: and its bytes, unless a single text has more
BATCH_BYTES = 64 << 20


def prepare(spark: SparkSession) -> None:
    """Short Arrow batches, so that a worker holds few long texts at once."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") != str(most):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def _scratch(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/llm/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables and archives that this application wrote between its stages. Frames
    built on them can't be read afterwards, so call it when the results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost
    executors, and later readers prune its columns."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """While it holds, the shuffle files of a query go when the query ends, not when the driver
    happens to collect its garbage. For frames that are run once (tables, checkpoints, what is
    collected): one that is run again would make its shuffles anew."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def dealt_anew(df: DataFrame) -> DataFrame:
    """``df`` without its partitioning. An aggregate joined again with its own input would
    otherwise be joined where it stands, and a hot key of the input would stay one task; so
    both sides are dealt for the join, and adaptive execution can split what is too large."""
    return df.hint("rebalance")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def plain(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def per_text(
    docs: DataFrame,
    text_col: str,
    fields: T.StructType,
    make: Callable[[], Callable[[pa.Array], list]],
    name: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with one struct column ``name`` of ``fields``.

    ``make`` runs once per task and returns a function from a text column to a list of
    tuples, one per row. Rows are neither moved nor counted: one scan, no shuffle.
    """
    prepare(docs.sparkSession)
    kept = docs.columns if keep is None else keep
    spare = fresh(docs, "_text")
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias(spare))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(name, fields)])
    out = to_arrow_schema(schema)
    names = fields.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        struct = out.field(len(kept)).type
        for b in batches:
            rows = each(b.column(len(kept)))
            parts = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            arrays = [pa.array(p, type=struct.field(i).type) for i, p in enumerate(parts)]
            packed = pa.StructArray.from_arrays(arrays, fields=[struct.field(i) for i in range(len(names))])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], packed], names=out.names)

    return source.mapInArrow(run, schema)


# --- key filters --------------------------------------------------------------------------

#: bits of a key filter: 2 MB, however many keys
FILTER_BITS = 24


def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of fixed size with a bit set for each long in the one column of ``keys``. A key
    that is not in it is certainly not among them; a join decides about the others. It spares
    the shuffle of most rows where few match, and is right however full it gets."""
    cell = F.pmod(F.col(keys.columns[0]), F.lit(1 << bits)) + 1
    rows = (
        keys.select(cell.alias("c"))
        .groupBy(F.bitmap_bucket_number("c").alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("bits"))
        .collect()
    )
    out = np.zeros(((1 << bits) >> 15, 1 << 12), np.uint8)
    for r in rows:
        out[r.b - 1] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cell = keys.astype(np.int64, copy=False) & np.int64(8 * len(bits) - 1)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def may_be_in(spark: SparkSession, bits: np.ndarray, key):
    """Column: whether the long ``key`` may be among the keys of the filter."""
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(passes(shared.value, keys.to_numpy()))

    return test(key)


def same_document(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, marks: DataFrame, how: str) -> DataFrame:
    """``docs`` joined (``how``: inner or left) with ``marks``, whose first two columns are a
    document's id and the hash of its text. Only documents that may have marks are shuffled."""
    id_, hash_ = marks.columns[:2]
    both = F.xxhash64(F.col(f"`{id_}`"), F.col(hash_))
    bits = key_filter(marks.select(both.alias("k")))
    own = fresh(docs, "_hash")
    docs = docs.withColumn(own, F.xxhash64(F.col(f"`{text_col}`")))
    flag = fresh(docs, "_may")
    docs = docs.withColumn(flag, may_be_in(spark, bits, F.xxhash64(F.col(f"`{id_col}`"), F.col(own))))
    other_id, other_hash = fresh(docs, "_mark_id"), fresh(docs, "_mark_hash")
    m = marks.select(F.col(f"`{id_}`").alias(other_id), F.col(hash_).alias(other_hash), *marks.columns[2:])
    on = F.col(f"`{id_col}`").eqNullSafe(F.col(other_id)) & (F.col(own) == F.col(other_hash))
    hit = docs.where(F.col(flag)).join(m, on, how).drop(other_id, other_hash)
    if how == "left":
        rest = docs.where(~F.col(flag))
        hit = hit.unionByName(rest.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in marks.schema.fields[2:]]))
    return hit.drop(own, flag)


def without_ids(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in the one column of ``ids``; only rows that may be
    among them are shuffled, rows without id stay."""
    bits = key_filter(ids.select(F.xxhash64(ids.columns[0]).alias("k")))
    flag, gone = fresh(docs, "_may"), fresh(docs, "_gone")
    marked = docs.withColumn(flag, may_be_in(docs.sparkSession, bits, F.xxhash64(F.col(f"`{id_col}`"))))
    ids = ids.select(F.col(ids.columns[0]).alias(gone))
    stay = marked.where(F.col(flag)).join(ids, F.col(f"`{id_col}`") == F.col(gone), "left_anti")
    return stay.unionByName(marked.where(~F.col(flag))).drop(flag)


def cut_spans(docs: DataFrame, id_col: str, text_col: str, spans: DataFrame, removed: str | None = None) -> DataFrame:
    """``docs`` without the spans (id, hash of text, start, end) of their texts, in code points;
    ``removed`` names a column for the sorted spans that were cut."""
    id_, hash_ = spans.columns[:2]
    column = removed or fresh(docs, "_cut")
    lists = spans.groupBy(id_, hash_).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(column))
    out = same_document(docs.sparkSession, docs, id_col, text_col, lists, "left")
    t, c = f"`{text_col}`", f"`{column}`"
    cut = F.expr(f"""case when {c} is null then {t} else array_join(transform(
        transform(sequence(0, size({c})), i -> named_struct(
            'from', if(i = 0, 0L, {c}[i - 1].end), 'to', if(i = size({c}), cast(char_length({t}) as bigint), {c}[i].start))),
        x -> substring({t}, cast(x.from + 1 as int), cast(x.to - x.from as int))), '') end""")
    out = out.withColumn(text_col, cut)
    return out if removed else out.drop(column)


# --- hashing of word shingles -------------------------------------------------------------

_ODD = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        for seed, which in ((_ODD, "_POW"), (pow(_ODD, -1, 2**64), "_INV")):
            a = np.full(size, seed, np.uint64)
            a[0] = 1
            globals()[which] = np.multiply.accumulate(a)
    return _POW, _INV


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: all output bits depend on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: words hashed at a time, so that a very long text needs little memory besides itself
BLOCK_WORDS = 60_000


def joined(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words (which hold no blank) joined by single blanks, with the start and end byte of
    each."""
    s = b" ".join(words)
    if not words:
        return s, np.empty(0, np.int64), np.empty(0, np.int64)
    blanks = np.flatnonzero(np.frombuffer(s, np.uint8) == 0x20)
    return s, np.concatenate([[0], blanks + 1]), np.append(blanks, len(s))


def range_hashes(s: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range of ``s`` (starts ascending): a rolling polynomial over
    the bytes, so the cost does not grow with the length of the ranges."""
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), BLOCK_WORDS):
        a, b = starts[i : i + BLOCK_WORDS], ends[i : i + BLOCK_WORDS]
        lo, hi = int(a[0]), int(b.max())
        power, inverse = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[np.frombuffer(s, np.uint8, hi - lo, lo)] * power[: hi - lo], out=sums[1:])
        out[i : i + BLOCK_WORDS] = (sums[b - lo] - sums[a - lo]) * inverse[a - lo]
    return mix(out)


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, in order; of the whole sequence if it has fewer."""
    if not words:
        return np.empty(0, np.uint64)
    s, starts, ends = joined(words)
    if len(words) < k:
        return range_hashes(s, starts[:1], ends[-1:])
    return range_hashes(s, starts[: len(words) - k + 1], ends[k - 1 :])


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of a text (A-Z lowered, words between
    ASCII white space)."""
    return sorted_distinct(shingle_hashes(text.lower().split(), k))


def sorted_distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


# --- connected components -----------------------------------------------------------------


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges ``(u, v)`` of longs; component is the
    smallest node reachable.

    Alternating large-star and small-star steps. Large-star sends a node's larger neighbours to
    the smallest one by a combined minimum and a join that adaptive execution can split, so a
    node with very many neighbours is no single task. Small-star groups by the larger end: a
    window, whose groups are no larger than the edges that a node brought to smaller ones
    (those of one text or one tile here). Every step is a checkpoint in the shared folder; a
    handful of steps suffice (logarithmic in the number of nodes).
    """
    ensure_checkpoint_dir(edges.sparkSession)

    def written(e: DataFrame) -> tuple[DataFrame, tuple]:
        """A checkpoint, and its count and checksum, taken as it is written."""
        seen = Observation()
        out = e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).checkpoint()
        return out, (seen.get["n"], seen.get["sum"])

    e, state = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(dealt_anew(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = (
            large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
            .select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        before = state
        e, state = written(small)
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
