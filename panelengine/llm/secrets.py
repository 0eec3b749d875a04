"""Secret scans with corpus-wide ownership frequency, in DataFrame functions throughout.

Candidates are found by pattern in every text; their values are hashed, and each hash is
counted over distinct owners and repositories. A value that one or two owners have looks
live; one that many have is a copied example. All candidates of the base kinds are reported;
provider keys (the kind this method adds) only if they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_table, dealt_anew

#: kind, pattern, group of the value, least length of the value. Runs of a class are matched
#: with their least length where a shorter run cannot hold a match that the run itself hides.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: tokens of well-known providers, by their published prefixes
ADDED = ("provider", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 0, 10)
#: a value of more owners or repositories than this is a copied example
MAX_OWNERS = 2
MAX_REPOSITORIES = 4

_BLOCK = 64


def _positions(found: str, gaps: str) -> str:
    """SQL: array of (start, end) of the matches, from the texts of the matches and of the gaps
    between them. Lengths are summed by blocks, so the cost does not grow with the square of
    the number of matches."""
    before = f"""aggregate(transform(sequence(0, (size({found}) - 1) div {_BLOCK}),
            b -> aggregate(slice(lens, b * {_BLOCK} + 1, {_BLOCK}), 0L, (a, x) -> a + x)),
        array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x)))"""
    return f"""case when size({found}) = 0 then cast(array() as array<struct<start: bigint, end: bigint>>) else
      transform(array(transform(sequence(0, size({found}) - 1), i -> cast(char_length({gaps}[i]) + char_length({found}[i]) as bigint))), lens ->
        transform(array({before}), sums ->
          transform(sequence(0, size({found}) - 1), i ->
            transform(array(sums[i div {_BLOCK}] + aggregate(slice(lens, (i div {_BLOCK}) * {_BLOCK} + 1, i % {_BLOCK}), 0L, (a, x) -> a + x) + char_length({gaps}[i])),
              s -> named_struct('start', s, 'end', s + char_length({found}[i])))[0]))[0])[0] end"""


def _candidates(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` without its text, with ``spans``: (start, no, end, kind, value hash), sorted."""
    rest = [c for c in docs.columns if c != text]
    every = [*KINDS, ADDED]
    out = docs
    for kind, pattern, group, _ in every:
        out = out.withColumn(f"m_{kind}", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        if group:
            out = out.withColumn(f"v_{kind}", F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    spans = []
    for no, (kind, pattern, group, least) in enumerate(every):
        some = F.size(f"m_{kind}") > 0
        out = out.withColumn(f"g_{kind}", F.when(some, F.split(text, pattern, -1)))
        value = f"v_{kind}" if group else f"m_{kind}"
        out = out.withColumn(f"p_{kind}", F.expr(_positions(f"m_{kind}", f"g_{kind}")))
        spans.append(
            F.expr(f"""transform(filter(arrays_zip(p_{kind}, {value}), x -> char_length(x.{value}) >= {least}),
                x -> named_struct('start', x.p_{kind}.start, 'no', {no}, 'end', x.p_{kind}.end, 'kind', '{kind}', 'hash', sha2(x.{value}, 256)))""")
        )
    return out.select(*rest, F.array_sort(F.concat(*spans)).alias("spans"))


def _listed(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """Per row of ``docs``: counts and digest of the base spans, all spans, and how many spans
    look live or are copied examples.

    A null text is empty; a null owner or repository counts as one owner or repository; rows
    that repeat each other are counted each, but add no owner. Spans are in code points and
    sorted by start, then kind.
    """
    owner = F.col("source") if owner is None else owner
    repository = owner if repository is None else repository
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        F.monotonically_increasing_id().alias("row"),
    )
    found = as_table(_candidates(rows, "text"), "secret-candidates")
    each = found.select("row", "owner", "repository", F.explode("spans").alias("s"))
    places = each.select(F.col("s.hash").alias("hash"), "owner", "repository").distinct()
    owners = places.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    stats = owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    judged = each.withColumn("hash", F.col("s.hash")).join(dealt_anew(stats.select("hash", live.alias("live"))), "hash")
    judged = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("s.start", "s.no", "s.end", "s.kind", "live"))).alias("judged")
    )
    base = F.expr(f"filter(spans, x -> x.no < {len(KINDS)})")
    out = found.withColumn("base", base).join(judged, "row", "left")
    out = out.withColumn("judged", F.expr(f"filter(judged, x -> x.no < {len(KINDS)} or x.live)"))
    count = lambda c: F.coalesce(F.size(F.expr(c)), F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias(id_col),
        *[count(f"filter(base, x -> x.no = {no})").alias(f"n_{kind}") for no, (kind, *_) in enumerate(KINDS)],
        F.sha2(_listed("base"), 256).alias("base_sha256"),
        F.coalesce(_listed("judged"), F.lit("")).alias("spans"),
        F.when(F.col("judged").isNull(), F.lit(0)).otherwise(count("filter(judged, x -> x.live)")).cast("long").alias("n_live"),
        F.when(F.col("judged").isNull(), F.lit(0)).otherwise(count("filter(judged, x -> not x.live)")).cast("long").alias("n_example"),
    )
