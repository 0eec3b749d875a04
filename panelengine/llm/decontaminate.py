"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` words (a shorter item is one window).
A window's set is its shingles of up to three words; shingles are ordered by rarity, counted
over all documents. A document that contains a window contains all of its shingles, so the
overlap needed is the whole set and the necessary prefix is the rarest shingle alone: only
that one is joined. Its place in the window and in the document give the one position at
which the window could stand; candidates that would start before the document or end after
it fall to the positional and length bounds, the rest are compared word by word.

The benchmark side is broadcast in blocks of at most ``block_bytes`` of text; a larger
benchmark takes several blocks, each a pass over the documents, whose hits are combined.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_table, fresh, joined, per_text, prepare, range_hashes, signed, utf8

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 8 << 20

#: ASCII letters are lowered, digits and all bytes of other letters stay, the rest separates
_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Windows:
    """The distinct windows of one block of items: shingles, words and owners."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        owners: dict[bytes, set] = defaultdict(set)
        for item, text in items:
            w = words_of(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                owners[b" ".join(w[i : i + window])].add(item)
        self.text = sorted(owners)
        self.owners = [sorted(x for x in owners[t] if x is not None) for t in self.text]
        self.length = [t.count(b" ") + 1 for t in self.text]
        self.grams = [min(SHINGLE, n) for n in self.length]  # words of a shingle
        self.sizes = sorted(set(self.grams))
        self.shingles = []
        for t, g in zip(self.text, self.grams, strict=True):
            s, a, b = joined(t.split(b" "))
            self.shingles.append(range_hashes(s, a[: len(a) - g + 1], b[g - 1 :]))
        self.known = {
            g: np.unique(np.concatenate([h for h, k in zip(self.shingles, self.grams, strict=True) if k == g])) for g in self.sizes
        }

    def prefixes(self, counts: dict[tuple[int, int], int]) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """By shingle size: rarest shingle -> (window, its offset in it)."""
        out: dict = {g: defaultdict(list) for g in self.sizes}
        for k, (h, g) in enumerate(zip(self.shingles, self.grams, strict=True)):
            order = [(counts.get((g, int(x)), 0), int(x)) for x in h]
            j = order.index(min(order))
            out[g][int(h[j])].append((k, j))
        return {g: dict(x) for g, x in out.items()}


#: bits of the table that turns most document shingles away before the exact lookup
_GATE = 18


def _gates(known: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    gates = {}
    for g, h in known.items():
        gates[g] = np.zeros(1 << _GATE, bool)
        gates[g][h >> np.uint64(64 - _GATE)] = True
    return gates


def _matches(text_words, g, known, gate):
    """(positions, indexes in known) at which a shingle of ``g`` words is known."""
    s, a, b = text_words
    if len(a) < g:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = range_hashes(s, a[: len(a) - g + 1], b[g - 1 :])
    at = np.flatnonzero(gate[h >> np.uint64(64 - _GATE)])
    j = np.searchsorted(known, h[at])
    j[j == len(known)] = 0
    ok = known[j] == h[at]
    return at[ok], j[ok]


def _rarity(docs: DataFrame, text_col: str, known) -> dict[tuple[int, int], int]:
    """Occurrences of the block's shingles in all documents; as many numbers as the block has
    shingles reach the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        known = shared.value
        gates = _gates(known)
        totals = {g: np.zeros(len(h), np.int64) for g, h in known.items()}
        for b in batches:
            for t in utf8(b.column(0)):
                w = joined(words_of(t))
                for g, h in known.items():
                    totals[g] += np.bincount(_matches(w, g, h, gates[g])[1], minlength=len(h))
        for g, h in known.items():
            at = np.flatnonzero(totals[g])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), g, np.int32)), pa.array(signed(h[at])), pa.array(totals[g][at])], names=["g", "h", "n"]
            )

    rows = (
        docs.select(F.col(f"`{text_col}`").cast("string").alias("t"))
        .mapInArrow(count, "g int, h long, n long")
        .groupBy("g", "h")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    return {(r.g, r.h % 2**64): r.n for r in rows}


def _find(w, block: Windows, prefixes, keys, gates):
    """Marks of the document's words inside windows, and the items they belong to."""
    s, a, b = w
    n = len(a)
    marks = np.zeros(n + 1, np.int64)
    items: set[str] = set()
    for g, table in prefixes.items():
        at, j = _matches(w, g, keys[g], gates[g])
        for p, h in zip(at.tolist(), keys[g][j].tolist(), strict=True):
            for k, offset in table[h]:
                start, length = p - offset, block.length[k]
                if start < 0 or start + length > n:
                    continue
                if s[a[start] : b[start + length - 1]] == block.text[k]:
                    marks[start] += 1
                    marks[start + length] -= 1
                    items.update(block.owners[k])
    return marks, items


def _spans(marks: np.ndarray) -> list[int]:
    """Merged word ranges as [start, end, start, end ...]."""
    inside = np.concatenate([[0], (np.cumsum(marks) > 0).astype(np.int8), [0]])
    return np.flatnonzero(np.diff(inside)).tolist()


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Lists of (item, text) of at most ``block_bytes`` (or one item), read one after another."""
    block, size = [], 0
    for r in benchmark.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")).toLocalIterator():
        text = (r[1] or "").encode()
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r[0], text))
        size += len(text)
    if block:
        yield block


def window_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    name: str,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (all columns, or ``keep``) with a struct column ``name``: n_words, spans (merged
    ranges of hit words, flat) and items (sorted ids of items with occurring windows).

    Null texts have no words; an item without words has no window; an item without id marks
    words but is not named. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    prepare(spark)
    carried = docs.columns if keep is None else keep
    out = docs
    before = None
    blocks = with_last(_blocks(benchmark, item_col, item_text_col, block_bytes))
    for items, last in blocks:
        block = Windows(items, window)
        prefixes = block.prefixes(_rarity(docs, text_col, block.known)) if block.text else {}
        shared = spark.sparkContext.broadcast((block, prefixes))
        prior = before

        def make(shared=shared):
            block, prefixes = shared.value
            keys = {g: np.array(sorted(t), np.uint64) for g, t in prefixes.items()}
            gates = _gates(keys)

            def each(column):
                rows = []
                for t in utf8(column):
                    w = joined(words_of(t))
                    marks, items = _find(w, block, prefixes, keys, gates)
                    rows.append((len(w[1]), _spans(marks), sorted(items)))
                return rows

            return each

        now = fresh(out, name if last else f"{name}_next")
        text = [] if last else [text_col]
        columns = list(dict.fromkeys([*carried, *text, *([prior] if prior else [])]))
        out = per_text(out, text_col, HITS, make, now, columns)
        if prior:
            out = out.withColumn(now, _combined(now, prior)).drop(prior)
        if not last:
            out = as_table(out, "decontaminate")
        before = now
    return out if before == name else out.withColumnRenamed(before, name)


def with_last(blocks):
    """Each block with whether it is the last; one empty block if there is none."""
    held = next(blocks, [])
    for b in blocks:
        yield held, False
        held = b
    yield held, True


def _combined(a: str, b: str):
    """Both hits in one: spans merged again, items united."""
    pairs = F.expr(f"""
        aggregate(
          array_sort(filter(transform(
            sequence(0, cast((size({a}.spans) + size({b}.spans)) / 2 as int)),
            i -> struct(get(concat({a}.spans, {b}.spans), 2 * i) as s, get(concat({a}.spans, {b}.spans), 2 * i + 1) as e)),
            x -> x.s is not null)),
          cast(array() as array<bigint>),
          (acc, x) -> case when size(acc) > 0 and x.s <= element_at(acc, -1)
            then concat(slice(acc, 1, size(acc) - 1), array(greatest(element_at(acc, -1), x.e)))
            else concat(acc, array(x.s, x.e)) end)""")
    return F.struct(
        F.col(f"{a}.n_words").alias("n_words"),
        pairs.alias("spans"),
        F.array_sort(F.array_union(f"{a}.items", f"{b}.items")).alias("items"),
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row of ``docs``: words, hit words, items with occurring windows, and the spans."""
    hits = window_hits(docs, benchmark, "_hits_", keep=[id_col], **options)
    spans = F.col("_hits_.spans")
    n_hit = F.expr("aggregate(_hits_.spans, 0L, (acc, x) -> x - acc)")  # e2 - (s2 - (e1 - s1)): alternating sum
    return hits.select(
        F.col(f"`{id_col}`"),
        F.col("_hits_.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_hits_.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_hits_.items", ","), 256).alias("items_sha256"),
        (F.size(spans) > 0).alias("contaminated"),
        spans.alias("hit_spans"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any hit, their columns as they were."""
    name = fresh(docs, "_contamination")
    return window_hits(docs, benchmark, name, text_col=text_col, **options).where(F.size(F.col(f"{name}.spans")) == 0).drop(name)
