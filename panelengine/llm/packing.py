"""Packing in space-filling-curve order.

Each document's vector of hashed 4-byte shingles is projected to three dimensions by fixed
random signs, and the point's place on a Hilbert curve is its key. Documents are sorted by
range of key (ties and copies are spread by a hash of id and text), so that a partition is a
stretch of the curve; in it the tokens of neighbouring documents are laid end to end and cut
every ``length`` tokens. What remains at the end of a partition is cut into powers of two,
which need no padding. So nothing is padded at all, and no task needs to know another's
length.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_schema

from .common import fresh, per_text, plain, prepare, utf8

LENGTH = 1024
#: bits of each of the three coordinates
BITS = 16
#: the id that ends each document
END = 0

_BUCKETS = 12
_SIGNS = np.random.default_rng(41).choice([-1.0, 1.0], (1 << _BUCKETS, 3)).astype(np.float32)


def project(text: bytes) -> np.ndarray:
    """Three coordinates in (0, 1): the mean signs of the text's hashed 4-byte shingles,
    scaled to unit variance and squashed. An empty text is the middle point."""
    a = np.frombuffer(text, np.uint8)
    if len(a) < 4:
        return np.full(3, 0.5)
    total = np.zeros(3)
    for i in range(0, len(a) - 3, 1 << 20):
        b = a[i : i + (1 << 20) + 3].astype(np.uint32)
        h = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
        counts = np.bincount((h * np.uint32(2654435761)) >> np.uint32(32 - _BUCKETS), minlength=1 << _BUCKETS)
        total += counts @ _SIGNS
    return 0.5 + 0.5 * np.tanh(total / (len(a) - 3) * 8)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def _keys():
    def each(column):
        points = np.array([project(t) for t in utf8(column)]).reshape(-1, 3)
        return [(k,) for k in hilbert((points * ((1 << BITS) - 1)).astype(np.int64)).tolist()]

    return each


def added_tokens(json_path: str) -> dict[str, int]:
    """Content and id of the added tokens of a tokenizer's JSON file."""
    with open(json_path, encoding="utf-8") as f:
        rows = json.load(f)["added_tokens"]
    odd = [r["content"] for r in rows if r["single_word"] or r["lstrip"] or r["rstrip"] or r["normalized"]]
    if odd:
        raise ValueError(f"added tokens that are not plain strings: {odd}")
    return {r["content"]: r["id"] for r in rows}


class Tokens:
    """Ids of texts as little-endian 16-bit bytes.

    The vocabulary's pattern never joins a character that is not white space to white space
    after it, so a text may be cut before every run of blanks and the parts, most of them one
    word, be looked up in a bounded table of those seen before. Texts with other white space
    than blanks and line ends are encoded whole. ``added`` tokens are found first, as the JSON
    tokenizer does; what stands between them is encoded by itself.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int] | None = None, most: int = 400_000):
        import re

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cut = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
        self.odd = re.compile(r"[^\S \n]").search
        self.most = most
        self.seen: dict[str, bytes] = {}
        self.added = {t: np.array([i], "<u2").tobytes() for t, i in (added or {}).items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def __call__(self, text: str) -> bytes:
        if self.marks is None or not self.marks.search(text):
            return self.ordinary(text)
        return b"".join(self.added.get(part) or self.ordinary(part) for part in self.marks.split(text))

    def ordinary(self, text: str) -> bytes:
        if self.odd(text):
            return np.array(self.encode(text), "<u2").tobytes()
        seen, out = self.seen, []
        for part in self.cut(text):
            ids = seen.get(part)
            if ids is None:
                ids = np.array(self.encode(part), "<u2").tobytes()
                if len(part) <= 24:
                    if len(seen) >= self.most:
                        seen.clear()
                    seen[part] = ids
            out.append(ids)
        return b"".join(out)


def powers(n: int) -> list[int]:
    """``n`` as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


PIECES = [
    T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
] + [T.StructField("hilbert_key", T.LongType())]


def pack(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    with_ids: bool = False,
    added: dict[str, int] | None = None,
) -> DataFrame:
    """One row per piece: the document's id, where the piece starts in the document's ids, its
    length and crc32, the document's ids, its sequence and its place there (and with
    ``with_ids`` the ids themselves, 16-bit little-endian).

    A null or empty text is the end id alone. Copies and repeated rows are packed each. The
    vocabulary must have fewer than 65,536 ids. ``added`` tokens (content and id) get their id
    wherever a text has them; without it such strings are ordinary text. Memory: one batch of texts and one sequence.
    """
    spark = docs.sparkSession
    prepare(spark)
    key = fresh(docs, "_key")
    keyed = per_text(docs, text_col, T.StructType([T.StructField("k", T.LongType())]), _keys, key, [id_col, text_col] if id_col != text_col else [id_col])
    curve = keyed.select(
        F.col(f"`{id_col}`"),
        F.col(f"`{text_col}`").cast("string").alias("_text_"),
        F.col(f"`{key}`.k").alias("_k_"),
        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("_tie_"),
    )
    along = curve.repartitionByRange("_k_", "_tie_").sortWithinPartitions("_k_", "_tie_")
    fields = [curve.schema.fields[0], *PIECES] + ([T.StructField("ids", T.BinaryType())] if with_ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = Tokens(ranks_path, pattern, added)
        first = TaskContext.get().partitionId() << 40
        end = END.to_bytes(2, "little")
        sequence = first
        # of the open sequence: (id, ids so far in the document, ids, doc_tokens, key)
        open_, filled = [], 0

        def row(doc, start, ids, total, key, seq, offset):
            wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
            return (doc, start, len(ids) // 2, zlib.crc32(wide), total, seq, offset, key) + ((ids,) if with_ids else ())

        def flush(rows):
            nonlocal filled, sequence
            at = 0
            for doc, start, ids, total, key in open_:
                rows.append(row(doc, start, ids, total, key, sequence, at))
                at += len(ids) // 2
            open_.clear()
            filled, sequence = 0, sequence + 1

        def batch(rows):
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=out)

        for b in batches:
            rows: list = []
            for doc, text, key in zip(b.column(0).to_pylist(), plain(b.column(1)), b.column(2).to_pylist(), strict=True):
                ids = tokens(text) + end
                total, start = len(ids) // 2, 0
                while start < total:
                    n = min(length - filled, total - start)
                    open_.append((doc, start, ids[2 * start : 2 * (start + n)], total, key))
                    filled += n
                    start += n
                    if filled == length:
                        flush(rows)
            if rows:
                yield batch(rows)
        rows, rest = [], list(open_)
        open_.clear()
        for size in powers(filled):
            room = size
            while room:
                doc, start, ids, total, key = rest[0]
                n = min(room, len(ids) // 2)
                open_.append((doc, start, ids[: 2 * n], total, key))
                if 2 * n == len(ids):
                    rest.pop(0)
                else:
                    rest[0] = (doc, start + n, ids[2 * n :], total, key)
                room -= n
            flush(rows)
        if rows:
            yield batch(rows)

    names = [f.name for f in fields]
    schema = T.StructType(fields)
    out = to_arrow_schema(schema)
    return along.mapInArrow(run, schema)
