"""Quality rules by compression bands.

The zstandard ratio (compressed / raw UTF-8 bytes) of the whole document and of fixed chunks
of it is held against limits that depend on the length: repetitive text compresses too well,
random or encoded text not at all. Short texts compress worse (no history yet), so their
limits are higher.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, per_text, utf8

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Limits for texts of at least ``min_bytes``: ratios outside [low, high] are rejected."""

    min_bytes: int
    low: float
    high: float


#: whole documents; a frame of zstandard has a dozen bytes of its own, hence the wide first band
DOCUMENT_BANDS = (
    Band(0, 0.0, 9.0),
    Band(256, 0.28, 0.92),
    Band(512, 0.25, 0.85),
    Band(1024, 0.22, 0.76),
    Band(4096, 0.18, 0.73),
    Band(16384, 0.15, 0.71),
    Band(65536, 0.12, 0.70),
)
#: fixed chunks of CHUNK bytes, and the last one if it has at least half
CHUNK = 4096
CHUNK_LOW, CHUNK_HIGH = 0.12, 0.76
#: share of chunks outside their limits from which the document is rejected
MAX_BAD_CHUNKS = 0.5
LEVEL = 3

FIELDS = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    + [T.StructField(c, T.DoubleType()) for c in ("ratio", "min_chunk_ratio", "max_chunk_ratio", "bad_chunks")]
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 20:  # keep the triple within 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    triple = pair[:-1] * len(number) + ids[2:]
    order = np.argsort(triple, kind="stable")
    t = triple[order]
    same = t[1:] == t[:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    twice = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        hit[twice + k] = True
    return int(hit.sum())


def band_of(n: int, bands=DOCUMENT_BANDS) -> Band:
    return [b for b in bands if n >= b.min_bytes][-1]


def measure(text: bytes, codec: zstandard.ZstdCompressor) -> tuple:
    """All fields of one text; a null or empty one has no words, fails the base rule and has
    no ratios."""
    words = text.split()
    n = len(words)
    letters = sum(map(len, words))
    if not text.isascii():  # code points: all bytes but the continuations of UTF-8
        letters -= int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 == 0x80))
    symbols = sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeat = repeated_words(words)
    base_failed = n < 50 or 100 * repeat > 50 * n
    ratio, chunks = None, []
    if text:
        ratio = len(codec.compress(text)) / len(text)
        for i in range(0, len(text), CHUNK):
            part = text[i : i + CHUNK]
            if 2 * len(part) >= CHUNK:
                chunks.append(len(codec.compress(part)) / len(part))
    bad = sum(not CHUNK_LOW <= r <= CHUNK_HIGH for r in chunks) / len(chunks) if chunks else 0.0
    kept = not base_failed
    if kept:
        band = band_of(len(text))
        kept = band.low <= ratio <= band.high and bad < MAX_BAD_CHUNKS
    return n, letters, symbols, len(lines) - len(set(lines)), repeat, base_failed, kept, ratio, min(chunks, default=None), max(chunks, default=None), bad


def _make():
    codec = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    return lambda column: [measure(t, codec) for t in utf8(column)]


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the base measures, the compression ratios and the verdict ``kept``.
    Null and empty texts: no words, base rule failed. Repeated rows: the same result each."""
    return per_text(docs, text_col, FIELDS, _make, "_q_", [id_col]).select(F.col(f"`{id_col}`"), "_q_.*")


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they were."""
    name = fresh(docs, "_quality")
    return per_text(docs, text_col, FIELDS, _make, name).where(F.col(f"{name}.kept")).drop(name)
