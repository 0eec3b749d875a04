"""Substring deduplication by hashing of units.

A text's units are stretches of ``min_unit`` words or more inside a line, cut at positions that
the words around decide: the place between two words gets a key, lowest after the end of a
sentence, then after other punctuation, else by the hash of both words, and a place whose key
is the least within ``min_unit`` - 1 words to either side is a cut. So a passage is cut in the
same way wherever it stands, but for a few words next to a splice. Units are normalised (letters
lowered, everything but letters and digits dropped; each character of Chinese and Japanese is a
word) and their 128-bit digests are grouped over the corpus. The earliest occurrence (by id,
then place) is kept; runs of consecutive units that occur earlier and have ``min_words`` words
together are removed, with the offsets in the original text. So single lines that many texts
share, such as licence notes, stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table, cut_spans, dealt_anew, key_filter, mix, passes, plain, prepare

MIN_UNIT = 4
MIN_WORDS = 30

_CJK = "\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
#: kinds of places between words: a line ends, a sentence, a clause, none of these
_LINE, _SENTENCE, _CLAUSE, _OTHER = range(4)
#: classes of characters: letters and digits, those that are words, white space, line ends, and
#: marks that end a sentence or a clause, before white space or a word or anywhere
_LETTER, _IDEOGRAPH, _BLANK, _BREAK, _STOP, _COMMA, _WIDE_STOP, _WIDE_COMMA = range(1, 9)
_CLASSES = {
    _BLANK: r"\s+",
    _LETTER: r"[^\W_]+",
    _IDEOGRAPH: rf"(?:[{_CJK}](?<![\W_]))+",
    _BREAK: r"\n",
    _STOP: "[.!?]",
    _COMMA: "[,;:]",
    _WIDE_STOP: "[\u3002\uff0e\uff01\uff1f\uff61]",
    _WIDE_COMMA: "[\u3001\uff0c\uff1b\uff1a\uff64]",
}
#: the kind of place that a character of each class makes
_MAKES = np.array([_OTHER, _OTHER, _OTHER, _OTHER, _LINE, _SENTENCE, _CLAUSE, _SENTENCE, _CLAUSE], np.uint8)


@cache
def _classes() -> np.ndarray:
    """The class of every code point; 0: none of them."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(len(every), np.uint8)
    for kind, pattern in _CLASSES.items():
        for m in re.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def _edges(gap: str) -> tuple[int, int]:
    """Characters of the text between two words that go with the first and with the second."""
    if "\n" in gap:
        return len(gap[: gap.index("\n")].rstrip()), len(gap[gap.rindex("\n") + 1 :].lstrip())
    left = next((i for i, c in enumerate(gap) if c.isspace()), len(gap))
    return left, len(gap[left:].lstrip())


_short_edges = lru_cache(1 << 12)(_edges)


def _kinds(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The kind of place after each word, from the classes of the characters and where words
    start: the least that a character between makes."""
    marks = np.flatnonzero(at >= _BREAK)
    mark, then = at[marks], at[np.minimum(marks + 1, len(at) - 1)]
    makes = _MAKES[mark]
    makes[((mark == _STOP) | (mark == _COMMA)) & ((then > _BREAK) | (then == 0))] = _OTHER
    after = np.searchsorted(starts, marks) - 1
    kind = np.full(len(starts) + 1, _OTHER, np.uint64)  # the last is for marks before any word
    for value in (_CLAUSE, _SENTENCE, _LINE):
        kind[after[makes == value]] = value
    kind[len(starts) - 1] = _LINE
    return kind[:-1]


def _units(text: str, min_unit: int) -> tuple[list[int], list[int], list[int], list[bytes]]:
    """The starts, ends, words and digests of ``units``."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length; those stay as they are
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    code = "ascii" if low.isascii() else "utf-32-le"
    points = np.frombuffer(low.encode(code, "surrogatepass"), np.uint8 if code == "ascii" else np.uint32)
    at = _classes()[points]
    inside, wide = (at == _LETTER) | (at == _IDEOGRAPH), at == _IDEOGRAPH
    if not inside.any():
        return [], [], [], []
    apart = ~inside[1:] | ~inside[:-1] | wide[1:] | wide[:-1]  # no word goes over this place
    starts = np.flatnonzero(inside & np.append(True, apart))
    ends = np.flatnonzero(inside & np.append(apart, True)) + 1
    n = len(starts)
    # all words in one line, and where each ends there
    to = np.cumsum(ends - starts + 1) - 1
    is_word = np.ones(to[-1], bool)
    is_word[to[:-1]] = False
    line = np.full(to[-1], ord(" "), points.dtype)
    line[is_word] = points[inside]
    line = line.tobytes().decode(code)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, line.split(" "))), ">u8").astype(np.uint64)
    kind = _kinds(at, starts)
    key = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + np.append(hashes[1:], np.uint64(0)))
    key = np.where(kind == _LINE, 0, kind << np.uint64(62) | key >> np.uint64(2) | np.uint64(1)).astype(np.uint64)
    # ``key[i]`` is that of the place after word i; a line's end is a cut, and near it is none
    reach = max(0, min_unit - 1)
    padded = np.concatenate([np.zeros(reach, np.uint64), key, np.zeros(reach, np.uint64)])
    cut = np.ones(n, bool)
    for d in range(1, reach + 1):
        cut &= (key < padded[reach - d : reach - d + n]) & (key <= padded[reach + d : reach + d + n])
    cut |= kind == _LINE
    last = np.flatnonzero(cut)  # the last word of each unit
    first = np.append(0, last[:-1] + 1)
    gaps = [low[a:b] for a, b in zip(ends[last[:-1]].tolist(), starts[first[1:]].tolist(), strict=True)]
    sides = [_short_edges(g) if len(g) <= 16 else _edges(g) for g in gaps]
    head = low[: starts[0]]
    left = [*(s[0] for s in sides), len(low[ends[-1] :].split("\n", 1)[0].rstrip())]
    right = [len(head[head.rfind("\n") + 1 :].lstrip()), *(s[1] for s in sides)]
    to = to[last].tolist()
    digests = [xxhash.xxh3_128_digest(line[a:b]) for a, b in zip([0, *[x + 1 for x in to[:-1]]], to, strict=True)]
    return (starts[first] - right).tolist(), (ends[last] + left).tolist(), (last - first + 1).tolist(), digests


def units(text: str, min_unit: int = MIN_UNIT) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each unit; end is exclusive, and white space at either end
    is left out."""
    return list(zip(*_units(text, min_unit), strict=True))


def _first_halves(docs: DataFrame, text_col: str, min_unit: int) -> DataFrame:
    """A row per unit with the first half of its digest, d1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = b"".join(d for t in plain(b.column(0)) for d in _units(t, min_unit)[3])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(digests, np.int64)[::2].copy())], names=["d1"])

    return docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "d1 long")


def _rows(docs: DataFrame, id_col: str, text_col: str, min_unit: int, known: np.ndarray) -> DataFrame:
    """A row per unit whose digest may be in the key filter ``known``: id, hash, no, start, end,
    words, d1, d2."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"), F.col(f"`{text_col}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, no, columns = [], [], ([], [], [], [])
            for t in plain(b.column(2)):
                found = _units(t, min_unit)
                counts.append(len(found[0]))
                no += range(len(found[0]))
                for column, values in zip(columns, found, strict=True):
                    column += values
            digests = np.frombuffer(b"".join(columns[3]), np.int64).reshape(-1, 2)
            keep = np.flatnonzero(passes(shared.value, digests[:, 0]))
            at = pa.array(np.repeat(np.arange(len(counts)), counts)[keep])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at)]
                + [pa.array(np.array(c, np.int64)[keep]) for c in (no, *columns[:3])]
                + [pa.array(np.ascontiguousarray(digests[keep][:, i])) for i in range(2)],
                names=["id", "hash", "no", "start", "end", "words", "d1", "d2"],
            )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, hash long, no long, start long, end long, words long, d1 long, d2 long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_unit: int = MIN_UNIT, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per removed span: id, hash of the text, start and end (code points), its units
    and words, and the ids of the documents that keep those units.

    Null and empty texts have no units. A row without id ranks last. Rows that repeat id and
    text are one document. Words repeated inside one document count like those of another.
    """
    prepare(docs.sparkSession)
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "hash", "start")
    twice = _first_halves(docs, text_col, min_unit).groupBy("d1").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = as_table(_rows(docs, id_col, text_col, min_unit, key_filter(twice.select("d1"))), "substring-units")
    first = again.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = again.join(dealt_anew(first), ["d1", "d2"]).where(rank > F.col("first")).select("id", "hash", "no", "start", "end", "words", F.col("first.id").alias("kept"))
    by_text = Window.partitionBy("id", "hash").orderBy("no")
    later = later.dropDuplicates(["id", "hash", "no"]).withColumn("run", F.col("no") - F.row_number().over(by_text))
    runs = later.groupBy("id", "hash", "run").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.count(F.lit(1)).alias("n_units"),
        F.sum("words").alias("n_words"),
        F.array_sort(F.collect_set("kept")).alias("kept_ids"),
    )
    return runs.where(F.col("n_words") >= min_words).drop("run")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the removed spans cut from the texts, all other columns as they were."""
    spans = repeated_spans(docs, id_col, text_col, **options).checkpoint()
    return cut_spans(docs, id_col, text_col, spans.select("id", "hash", "start", "end"))
