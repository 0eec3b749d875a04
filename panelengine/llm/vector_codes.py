"""Vector codes: each vector is cut into parts, and each part becomes the number of its nearest
codebook entry; codebooks are trained by rounds of assignment and integer means.

All arithmetic is on integers. Parts and entries are padded with zeros to a power of two and
Walsh-Hadamard transformed; the transform keeps squared distances up to the factor of its
length. Differences are accumulated in sequency order, slow coefficients first: the sum so far
is a lower bound, so an entry whose sum exceeds the whole distance of another one is out, and
only the remaining pairs go on to the next coefficients.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import as_table, dealt_anew, prepare

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: parts compared at a time
BLOCK = 512


def integers(vectors: list[np.ndarray]) -> np.ndarray:
    """Rows of floor(``SCALE`` * x): 64-bit, or Python's integers where squares need more."""
    if not vectors:
        return np.zeros((0, 0), np.int64)
    x = np.stack(vectors).astype(np.float64)
    width = max(1, x.shape[1])
    if not x.size or np.abs(x).max() < 2.0 ** (19 - math.ceil(math.log2(width))):
        return np.floor(x * SCALE).astype(np.int64)
    exact = [[(a * SCALE) // b for a, b in map(float.as_integer_ratio, row)] for row in x.tolist()]
    return np.array(exact, dtype=object)


def sequency_order(n: int) -> np.ndarray:
    """For each number of sign changes, the row of the Hadamard matrix that has it."""
    bits = n.bit_length() - 1
    gray = [k ^ (k >> 1) for k in range(n)]
    return np.array([int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray])


def walsh(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, zero-padded to a power of two, in sequency order."""
    width = 1 << max(0, rows.shape[1] - 1).bit_length()
    out = np.zeros((len(rows), width), rows.dtype)
    out[:, : rows.shape[1]] = rows
    step = 1
    while step < width:
        pairs = out.reshape(len(rows), width // (2 * step), 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(rows), width)
        step *= 2
    return out[:, sequency_order(width)]


class Codebook:
    """The entries of one part."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.waves = walsh(entries)
        self.compared = 0  # coefficients looked at

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part, ties to the lower entry."""
        code, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), parts.dtype)
        for a in range(0, len(parts), BLOCK):
            code[a : a + BLOCK], error[a : a + BLOCK] = self._block(parts[a : a + BLOCK])
        return code, error

    def _block(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        waves, n, width = walsh(parts), len(parts), self.waves.shape[1]
        row, entry = np.repeat(np.arange(n), len(self.entries)), np.tile(np.arange(len(self.entries)), n)
        total = np.zeros(len(row), np.result_type(waves, self.waves))
        best = None
        done, step = 0, max(1, min(4, width // 4))
        while done < width:
            upto = min(width, done + step)
            total += self._squares(waves, row, entry, done, upto)
            done, step = upto, 2 * step
            first = np.searchsorted(row, np.arange(n))
            least = np.minimum.reduceat(total, first)
            if done == width:
                best = least
                break
            # the whole distance of the entry in front bounds the nearest one's
            front = np.flatnonzero(total == least[row])
            front = front[np.searchsorted(row[front], np.arange(n))]
            whole = total[front] + self._squares(waves, row[front], entry[front], done, width)
            best = whole if best is None else np.minimum(best, whole)
            stay = total <= best[row]
            row, entry, total = row[stay], entry[stay], total[stay]
        hit = np.flatnonzero(total == best[row])
        hit = hit[np.searchsorted(row[hit], np.arange(n))]
        return entry[hit], total[hit] // width

    def _squares(self, waves: np.ndarray, row: np.ndarray, entry: np.ndarray, a: int, b: int) -> np.ndarray:
        self.compared += len(row) * (b - a)
        out = 0
        for k in range(a, b):
            d = waves[row, k] - self.waves[entry, k]
            out = out + d * d
        return out


def _assign(codebooks: list[Codebook], vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    width = vectors.shape[1] // len(codebooks)
    return [book.nearest(vectors[:, p * width : (p + 1) * width]) for p, book in enumerate(codebooks)]


def _rows(column: pa.Array, width: int) -> np.ndarray:
    found = [np.asarray(x, np.float64) for x in column.to_pylist()]
    for x in found:
        if len(x) != width:
            raise ValueError(f"a vector has {len(x)} components, another {width}")
    return integers(found)


def _books(entries: np.ndarray, parts: int) -> list[Codebook]:
    width = entries.shape[1] // parts
    return [Codebook(entries[:, p * width : (p + 1) * width]) for p in range(parts)]


def _sums(kept: DataFrame, entries: np.ndarray, parts: int) -> dict[int, int]:
    """Sums of the parts by (entry, component), and counts by (part, entry) after them: as many
    numbers as the codebooks have, whatever the vectors."""
    shared = kept.sparkSession.sparkContext.broadcast(entries)  # ENTRIES times the components
    n, width = entries.shape
    size = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _books(shared.value, parts)
        sums: dict[int, int] = {}
        for b in batches:
            vectors = _rows(b.column(0), width)
            for p, (code, _) in enumerate(_assign(books, vectors)):
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                added = np.add.reduceat(vectors[order, p * size : (p + 1) * size], first) if len(used) else []
                for e, x, c in zip(used.tolist(), added, np.diff([*first, len(code)]).tolist(), strict=True):
                    for k, v in enumerate(x.tolist()):
                        cell = e * width + p * size + k
                        sums[cell] = sums.get(cell, 0) + v
                    cell = n * width + p * n + e
                    sums[cell] = sums.get(cell, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int64()), pa.array(sums.values(), pa.int64())], names=["cell", "n"])

    rows = kept.select("vector").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(rows["cell"].to_pylist(), rows["n"].to_pylist(), strict=True))


def _updated(entries: np.ndarray, sums: dict[int, int], parts: int) -> np.ndarray:
    out = entries.copy()
    n, width = entries.shape
    size = width // parts
    for p in range(parts):
        for e in range(n):
            count = sums.get(n * width + p * n + e, 0)
            for k in range(p * size, (p + 1) * size) if count else ():
                out[e, k] = sums[e * width + k] // count
    return out


def codebooks_digest(entries: np.ndarray, parts: int) -> str:
    size = entries.shape[1] // parts
    flat = [str(x) for p in range(parts) for x in entries[:, p * size : (p + 1) * size].reshape(-1).tolist()]
    return hashlib.sha256(",".join(flat).encode()).hexdigest()


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Entries (rows) with the parts side by side, from (vec_id, vector): the vectors with the
    smallest ids, ties by the vector, moved to the means of their parts in each round."""
    first = kept.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).toArrow()
    if not first.num_rows:
        return np.zeros((0, 0), np.int64)
    vectors = first["vector"].combine_chunks()
    width = len(vectors[0])
    if width % parts:
        raise ValueError(f"{width} components cannot be cut into {parts} equal parts")
    book = _rows(vectors, width)
    for _ in range(rounds if width else 0):
        book = _updated(book, _sums(kept, book, parts), parts)
    return book


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per kept row: id, code (two hex digits a part), error, the error summed over the rows of
    equal label (nulls together), and the digest of the codebooks.

    Rows whose vector is null or holds null or non-finite components are left out. Vectors of
    unequal length, or of one that ``parts`` does not divide, raise; empty vectors have code 0
    throughout. Rows that repeat an id are coded each; a null id comes last in the choice of the
    first entries. Fewer than ``entries`` rows give as many entries.
    """
    prepare(vectors.sparkSession)
    if entries > 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    v = F.col(f"`{vector_col}`").cast("array<double>")
    kept = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), v.alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = as_table(kept.where(F.col("vector").isNotNull() & ~bad), "vectors")
    book = train(kept, parts, entries, rounds)
    digest = codebooks_digest(book, parts) if len(book) else ""
    width = book.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(book)
    out = T.StructType([kept.schema["vec_id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _books(shared.value, parts) if width else []
        for b in batches:
            rows = _rows(b.column(2), width)
            found = _assign(books, rows) if width else []
            codes = ["".join(f"{c:02x}" for c in x) for x in zip(*(c.tolist() for c, _ in found), strict=True)] if found else ["00" * parts] * len(rows)
            error = sum((e for _, e in found), np.zeros(len(rows), np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.string()), pa.array(error.tolist(), pa.int64())], names=arrow.names)

    coded = as_table(kept.select("vec_id", "label", "vector").mapInArrow(run, out), "vector-codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    both = coded.join(dealt_anew(by_label), F.col("label").eqNullSafe(F.col("of")))
    return both.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
