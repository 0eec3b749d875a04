"""Line deduplication by content-defined line chunks.

Every line is hashed, and a rolling hash over the last lines' hashes says where a chunk ends,
so boundaries depend on nearby lines alone: a passage that stands elsewhere, after other
lines, is cut at the same places. Chunks of two lines or more that occur again anywhere in
the corpus are removed, after their bytes have been compared with those of the first.

A repeated passage whose ends are no boundaries loses only the chunks inside it. So the queries
take ``every_pair``: instead of chunks, each line with the next one that has a word is compared
in the same way, and pairs that overlap or touch make up the span removed. Whatever stands in
the corpus before, in two lines or more, goes up to its last line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table, cut_spans, dealt_anew, fresh, plain, prepare, same_document

#: lines in the rolling hash, and the mean number of lines after which a chunk ends
ROLL = 2
MEAN_LINES = 3
MIN_LINES = 2
_MASK = (1 << 64) - 1


def chunks(text: str, roll: int = ROLL, mean: int = MEAN_LINES) -> list[tuple[int, int, int, int]]:
    """(start, end, lines, digest) of each chunk; offsets in code points, the line end that
    follows a chunk is part of it. Lines without a word end no chunk, but are hashed."""
    lines = text.split("\n")
    out: list[tuple[int, int, int, int]] = []
    recent: list[int] = []
    at = start = first = 0
    for i, line in enumerate(lines):
        at = min(len(text), at + len(line) + 1)
        recent = [*recent[-roll + 1 :], xxhash.xxh3_64_intdigest(line)] if roll > 1 else [xxhash.xxh3_64_intdigest(line)]
        rolled = 0
        for h in recent:
            rolled = (rolled * 0x9E3779B97F4A7C15 + h) & _MASK
        last = i == len(lines) - 1
        if last or (len(recent) == roll and line.strip() and (rolled >> 32) % mean == 0):
            if at > start:
                body = text[start:at].rstrip("\n")
                n = sum(1 for x in lines[first : i + 1] if x.strip())
                out.append((start, at, n, xxhash.xxh3_64_intdigest(body) - (1 << 63)))
            start, first = at, i + 1
    return out


def pairs(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, lines, digest) of each line with a word and the next such line, as in
    ``chunks``; lines without a word between them are part of it."""
    out: list[tuple[int, int, int, int]] = []
    at, before = 0, -1
    for line in text.split("\n"):
        end = min(len(text), at + len(line) + 1)
        if line.strip():
            if before >= 0:
                out.append((before, end, 2, xxhash.xxh3_64_intdigest(text[before:end].rstrip("\n")) - (1 << 63)))
            before = at
        at = end
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str, roll: int, mean: int, min_lines: int, every_pair: bool) -> DataFrame:
    """A row per chunk of ``min_lines`` lines or more, or per pair of lines: id, hash, start,
    end, digest."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, rows = [], []
            for i, t in enumerate(plain(b.column(2))):
                for start, end, n, digest in pairs(t) if every_pair else chunks(t, roll, mean):
                    if n >= min_lines:
                        which.append(i)
                        rows.append((start, end, digest))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))]
            at = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *columns], names=["id", "hash", "start", "end", "digest"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, hash long, start long, end long, digest long")


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", roll: int = ROLL, mean: int = MEAN_LINES, min_lines: int = MIN_LINES, every_pair: bool = False) -> DataFrame:
    """(id, hash of text, start, end) of every chunk that equals, byte for byte, one that ranks
    before it: by id (null last), hash of the text, and place. With ``every_pair`` of every run
    of pairs of lines; a pair that overlaps the first such pair of its own text stays."""
    spark = docs.sparkSession
    prepare(spark)
    found = as_table(_rows(docs, id_col, text_col, roll, mean, min_lines, every_pair), "line-chunks")
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "hash", "start")
    twice = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    wanted = found.join(dealt_anew(twice), "digest").select("id", "hash", F.struct("start", "end", "digest").alias("chunk"))
    wanted = wanted.groupBy("id", "hash").agg(F.collect_set("chunk").alias("chunks")).checkpoint()
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    with_text = same_document(spark, texts, "id", "text", wanted, "inner")
    bodies = with_text.select("id", F.xxhash64("text").alias("hash"), "text", F.explode("chunks").alias("c")).select(
        "id", "hash", "c.start", "c.end", "c.digest", F.expr("rtrim('\n', substring(text, cast(c.start + 1 as int), cast(c.end - c.start as int)))").alias("body")
    )
    bodies = as_table(bodies, "line-chunk-bodies")
    first = bodies.groupBy("digest", "body").agg(F.min(F.struct(*[rank[c].alias(c) for c in ("no_id", "id", "hash", "start")], "end")).alias("first"))
    later = bodies.join(dealt_anew(first), ["digest", "body"])
    if not every_pair:
        return later.where(rank > F.struct("first.no_id", "first.id", "first.hash", "first.start")).select("id", "hash", "start", "end").distinct()
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("hash") == F.col("first.hash"))
    after = F.when(own, F.col("start") >= F.col("first.end")).otherwise(rank > F.struct("first.no_id", "first.id", "first.hash", "first.start"))
    spans = later.where(after).groupBy("id", "hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))
    # both ends rise, so a run begins where the span before ends earlier, and ends where the next begins later
    starts = F.expr("filter(s, (x, i) -> i = 0 or s[i - 1].end < x.start)")
    ends = F.expr("filter(s, (x, i) -> i = size(s) - 1 or s[i + 1].start > x.end)")
    runs = spans.select("id", "hash", F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("r"))
    return runs.select("id", "hash", F.col("r.a.start").alias("start"), F.col("r.b.end").alias("end"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed: str | None = None, **options) -> DataFrame:
    """``docs`` with the text left after the repeated chunks are cut out, all other columns as
    they were (``removed``: a column with the spans cut). The first occurrence stays. Rows that
    repeat id and text are one document; a text may become empty; a null text stays null."""
    spans = repeated_chunks(docs, id_col, text_col, **options).checkpoint()
    return cut_spans(docs, id_col, text_col, spans, removed)


def line_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: the id, the text that stays, its length, the spans removed and their length."""
    name = fresh(docs, "removed_spans")
    out = line_dedup(docs.select(id_col, text_col), id_col, text_col, name, **options)
    gone = F.expr(f"coalesce(aggregate({name}, 0L, (a, x) -> a + x.end - x.start), 0L)")
    return out.select(
        id_col,
        F.col(text_col),
        F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("n_chars"),
        gone.alias("n_removed"),
        F.coalesce(F.size(name), F.lit(0)).cast("long").alias("n_spans"),
        F.expr(f"array_join(transform({name}, x -> concat(x.start, ':', x.end)), ',')").alias("removed"),
    )
