"""N-gram Jaccard join with signature trees.

Documents are sets of hashed ``k``-word shingles; two link when 100 * intersection >= 75 *
union. The result is each document's component, so links inside a component that is already
connected need no check, and no group is ever expanded into its pairs.

1. *Scan*: set size and digest per document (equal digests are one set), and a table of
   fixed size that counts shingles by hash cell. It gives every shingle a rank (rare first)
   on which all tasks agree; whatever the rank, the next step loses nothing.
2. *Candidates*: let n be a set's size, o = ceil(0.75 n) the least overlap of a link, and
   l(n) = max(1, n // 8). Two sets that link share their first l common shingles within the
   first n - o + l of each in rank order, so a set whose prefix holds fewer than l(o)
   shingles that stand in another prefix as well links with nothing and is dropped; with it
   go its shingles, and the test is repeated. In the end each set leaves out the l(o) - 1 that
   most prefixes have: of the l(o) it shares with a set it links with, the rarest stays in
   both. So phrases that many texts have in common do not chain them to one large cluster.
   Those that remain and share a shingle are gathered into clusters by connected components.
   Each task first joins its own documents, so a shingle has one row from each task and local
   cluster, however many documents have it.
3. *Trees*: the members of a cluster (bins of small clusters) are put in a signature tree.
   Leaves are sets with a bitmap of their shingles, nodes hold the OR of the bitmaps, the
   range of the sizes, and the largest number of shingles that share a bit. The tree is
   joined with itself by dual traversal: a node pair is dropped if the largest overlap that
   bitmaps and sizes allow is too small, or if all its sets are already connected. Leaf
   pairs that remain are compared exactly.
4. *Large clusters* are dealt by hash over bounded tiles, twice with different hashes, which
   connects most of what belongs together; then tiles are formed of what is still apart and
   every pair of tiles that are not known to be connected is joined in the same way, so no
   link between different sets is lost. The pairs go in waves, each of which moves about as
   much text as the large clusters hold.

A query's shuffle files go when it ends (``shuffles_removed``), and only texts that may be in
a cluster are shuffled, so disk follows the largest step, not the sum of all.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table, connected_components, dealt_anew, key_filter, may_be_in, passes, prepare, shingle_set, shuffles_removed, signed, utf8, without_ids

WORDS = 5
#: links: DEN * intersection >= NUM * union
NUM, DEN = 75, 100
#: cells of the shingle counts: a fixed size of 4 bytes each, however large the corpus
CELL_BITS = 20
_SLICES = 64
#: token rows a task gathers before it joins its own documents
BUFFER = 1_000_000
#: sets in a tile, where a set of more than UNIT shingles counts as several
TILE = 4000
UNIT = 1000
#: sets that small clusters are gathered to, in the same measure
BIN = 250


#: shingles that linked sets must share within their prefixes, as a part of their number
SHARE = 8
#: bits of the filter of shingles that stand in several prefixes: 16 MB, whatever the corpus
SHARED_BITS = 27
#: times that sets are tested against the shingles of those that passed
ROUNDS = 2


def least_overlap(n: int) -> int:
    return -(-NUM * n // DEN)


def shared_needed(n: int) -> int:
    """Shingles that a set of n and any set it links with share within their prefixes: the
    smaller of the two has at least ``least_overlap(n)`` shingles."""
    return max(1, least_overlap(n) // SHARE)


def prefix_length(n: int) -> int:
    return n - least_overlap(n) + max(1, n // SHARE) if n else 0


# --- 1. scan ------------------------------------------------------------------------------


def _scan(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Document rows (doc, n, key) and slices of the cell counts (part, slice, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cells = np.zeros(1 << CELL_BITS, np.int64)
        held: list[np.ndarray] = []
        some = False

        def count():
            cells[:] += np.bincount((np.concatenate(held) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
            held.clear()

        for b in batches:
            n, keys = [], []
            for t in utf8(b.column(1)):
                h = shingle_set(t, k)
                n.append(len(h))
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                held.append(h)
                some = True
            if sum(map(len, held)) >= BUFFER:
                count()
            m = len(n)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                names=names,
            )
        if held:
            count()
        if some:
            part = TaskContext.get().partitionId()
            for i, c in enumerate(np.split(np.minimum(cells, 2**32 - 1).astype(np.uint32), _SLICES)):
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([part], pa.int32()), pa.array([i], pa.int32()), pa.array([zlib.compress(c.tobytes(), 1)], pa.binary())],
                    names=names,
                )

    names = ["doc", "n", "key", "part", "slice", "counts"]
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, "doc long, n long, key binary, part int, slice int, counts binary")


def _add_slices(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((1 << CELL_BITS) // _SLICES, np.uint64)
    for c in pdf.counts:
        total += np.frombuffer(zlib.decompress(c), np.uint32)
    total = np.minimum(total, 2**32 - 1).astype(np.uint32)
    return pd.DataFrame({"part": [int(pdf.part.iloc[0]) // 256], "slice": [int(pdf.slice.iloc[0])], "counts": [zlib.compress(total.tobytes(), 1)]})


def _cells(scan: DataFrame) -> np.ndarray:
    """The sum of all tasks' cells: added in groups of 256 tasks, then of those sums."""
    parts = scan.where("slice is not null").select("part", "slice", "counts")
    for _ in range(2):
        parts = parts.groupBy(F.expr("part div 256"), "slice").applyInPandas(_add_slices, "part int, slice int, counts binary")
    cells = np.zeros((_SLICES, (1 << CELL_BITS) // _SLICES), np.uint64)
    for r in parts.collect():  # at most a few times the fixed size
        cells[r.slice] += np.frombuffer(zlib.decompress(r.counts), np.uint32)
    return np.minimum(cells.reshape(-1), (1 << CELL_BITS) - 1)


# --- 2. candidates ------------------------------------------------------------------------


def first_shingles(h: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The necessary prefix of a sorted set: its rarest shingles, ties by hash."""
    p = prefix_length(len(h))
    rank = cells[h >> np.uint64(64 - CELL_BITS)] << np.uint64(64 - CELL_BITS) | h >> np.uint64(CELL_BITS)
    return h[np.argsort(rank, kind="stable")[:p]]


class _Local:
    """Joins the documents of one buffer that share a token."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def gather(tokens: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The connections of (token, doc) rows in fewer rows: (token, root) with the smallest
    document of each local cluster, once per token, and (member, root) of the clusters."""
    order = np.lexsort((docs, tokens))
    t, d = tokens[order], docs[order]
    new = np.concatenate([[True], t[1:] != t[:-1]])
    low = d[new][np.cumsum(new) - 1]
    pairs = np.unique(np.stack([d, low], 1)[d != low], axis=0)
    local = _Local()
    for a, b in pairs.tolist():
        local.join(a, b)
    members = np.unique(pairs) if len(pairs) else np.empty(0, np.int64)
    roots = np.array([local.root(x) for x in members.tolist()], np.int64)
    firsts = d[new].copy()
    if len(members):
        at = np.searchsorted(members, firsts)
        at[at == len(members)] = 0
        known = members[at] == firsts
        firsts[known] = roots[at[known]]
    joined = members != roots
    return t[new], firsts, members[joined], roots[joined]


def _prefixes(docs: DataFrame, id_col: str, text_col: str, k: int, cells: np.ndarray, reps: np.ndarray, shared: np.ndarray | None) -> DataFrame:
    """Without ``shared``: (token, n), the prefix shingles of all documents and how often.
    With the filter of shingles that stand in several prefixes: (token, doc, need) of the
    documents that have at least as many of those as a link needs. ``reps`` is a filter of
    the ids that stand for their set."""
    spark = docs.sparkSession
    both = spark.sparkContext.broadcast((cells, reps, shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, reps, shared = both.value
        tokens: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        needs: list[np.ndarray] = []
        held = 0

        def out():
            t = np.concatenate(tokens)
            if shared is None:
                t, n = np.unique(np.sort(t), return_counts=True)
                columns = [signed(t), n]
            else:
                columns = [signed(t), np.concatenate(ids), np.concatenate(needs)]
            for x in (tokens, ids, needs):
                x.clear()
            for i in range(0, len(t), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], names=names)

        for b in batches:
            at = np.flatnonzero(passes(reps, b.column(0).to_numpy(zero_copy_only=False)))
            if not len(at):
                continue
            for doc, text in zip(b.column(0).take(pa.array(at)).to_pylist(), utf8(b.column(1).take(pa.array(at))), strict=True):
                h = shingle_set(text, k)
                if not len(h):
                    continue
                t = first_shingles(h, cells)
                if shared is not None:
                    t = t[passes(shared, signed(t))]
                    need = shared_needed(len(h))
                    if len(t) < need:
                        continue
                    ids.append(np.full(len(t), doc, np.int64))
                    needs.append(np.full(len(t), need, np.int64))
                tokens.append(t)
                held += len(t)
            if held >= BUFFER:
                yield from out()
                held = 0
        if held:
            yield from out()

    names = ["token", "n"] if shared is None else ["token", "doc", "need"]
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.where("doc is not null").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _supported(rows: DataFrame) -> DataFrame:
    """Of rows (token, doc, need) those (token, doc) of the documents with as many shared
    shingles as they need, without the need - 1 that most rows have. Counts order the shingles
    alike for all, and a link shares ``need`` or more, so the rarest it shares stays in both."""
    for left in reversed(range(ROUNDS)):
        shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = rows.join(dealt_anew(shared), "token")
        if left:
            enough = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("rows"), F.min("need").alias("least")).where("rows >= least").select("doc")
            rows = rows.join(dealt_anew(enough), "doc").select("token", "doc", "need")
        else:
            # fewer rows than needed have no such place, so they go as well
            place = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), F.desc("token")))
            rows = rows.withColumn("place", place).where("place >= need").select("token", "doc")
        rows = as_table(rows, "jaccard-supported")
    return rows


def _clusters(rows: DataFrame) -> DataFrame:
    """(node, component) of documents that share a token; after the tasks' own joins a token
    has few rows from each task, so the window over it is bounded by the number of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BUFFER:
                yield out(held)
                held = []
        if held:
            yield out(held)

    def out(held):
        t = np.concatenate([b.column(0).to_numpy() for b in held])
        d = np.concatenate([b.column(1).to_numpy() for b in held])
        t, first, member, root = gather(t.view(np.uint64), d)
        token = pa.concat_arrays([pa.array(signed(t)), pa.nulls(len(member), pa.int64())])
        to = pa.concat_arrays([pa.nulls(len(t), pa.int64()), pa.array(root)])
        return pa.RecordBatch.from_arrays([token, pa.array(np.concatenate([first, member])), to], names=["token", "doc", "root"])

    few = as_table(rows.select("token", "doc").mapInArrow(run, "token long, doc long, root long"), "jaccard-gathered")
    by_token = few.where("token is not null").withColumn("low", F.min("doc").over(Window.partitionBy("token"))).where("doc <> low")
    edges = by_token.select(F.col("doc").alias("u"), F.col("low").alias("v")).union(few.where("token is null").select("doc", "root"))
    return connected_components(edges.distinct())


def _candidates(docs: DataFrame, id_col: str, text_col: str, k: int, cells: np.ndarray, reps: DataFrame) -> DataFrame:
    """(doc, cluster) of the documents that may link with others of their cluster."""
    own = key_filter(reps.select("rep"))
    counts = _prefixes(docs, id_col, text_col, k, cells, own, None).groupBy("token").agg(F.sum("n").alias("n")).where("n > 1")
    shared = key_filter(counts.select("token"), SHARED_BITS)
    rows = as_table(_prefixes(docs, id_col, text_col, k, cells, own, shared), "jaccard-prefixes")
    return _clusters(_supported(rows)).select(F.col("node").alias("doc"), F.col("component").alias("cluster"))


# --- 3. signature trees -------------------------------------------------------------------

FAN_OUT = 8


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return DEN * both >= NUM * (len(a) + len(b) - both)


class SignatureTree:
    """Over sets sorted so that similar ones stand together. Level 0 are the sets, each node
    above covers ``FAN_OUT`` neighbours of the level below."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets], np.int64)
        bits = min(1 << 16, max(256, 1 << int(4 * size.max() - 1).bit_length()))
        marks = np.zeros((len(sets), bits // 8), np.uint8)
        for i, s in enumerate(sets):
            at = (s & np.uint64(bits - 1)).astype(np.int64)
            flags = np.zeros(bits, bool)
            flags[at] = True
            marks[i] = np.packbits(flags)
        maps = marks.view(np.uint64)
        extra = size - np.bitwise_count(maps).sum(1, dtype=np.int64)  # shingles that share a bit
        self.sets = sets
        #: by level: bitmaps, smallest size, largest size, largest extra
        self.levels = [(maps, size, size, extra)]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, ex = self.levels[-1]
            cut = np.arange(0, len(m), FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(m, cut, 0), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(ex, cut)))

    def possible(self, la: int, a: np.ndarray, lb: int, b: np.ndarray) -> np.ndarray:
        """Whether a set under node a[i] of level la could link with one under b[i] of lb."""
        ma, loa, hia, exa = (x[a] for x in self.levels[la])
        mb, lob, hib, exb = (x[b] for x in self.levels[lb])
        shared = np.bitwise_count(ma & mb).sum(1, dtype=np.int64)
        most = np.minimum(np.minimum(shared + exa, shared + exb), np.minimum(hia, hib))
        fits = (DEN * hia >= NUM * lob) & (DEN * hib >= NUM * loa)
        return fits & ((DEN + NUM) * most >= NUM * (loa + lob))

    def join(self, component: list[int]) -> list[tuple[int, int]]:
        """Links (of set numbers) that connect all that links connect; ``component`` has what
        is connected already, by set."""
        local = _Local()
        first: dict[int, int] = {}
        for i, c in enumerate(component):
            local.join(i, first.setdefault(c, i))
        links: list[tuple[int, int]] = []
        if len(self.sets) < 2:
            return links
        top = len(self.levels) - 1
        stack = [(top, 0, 0)]
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                if local.root(a) != local.root(b) and linked(self.sets[a], self.sets[b]):
                    local.join(a, b)
                    links.append((a, b))
                continue
            span = FAN_OUT**level
            n = len(self.sets)
            roots = {local.root(x) for x in range(a * span, min(n, a * span + span))}
            if len(roots) == 1 and (a == b or {local.root(x) for x in range(b * span, min(n, b * span + span))} == roots):
                continue
            below = len(self.levels[level - 1][0])
            kids = lambda x: np.arange(x * FAN_OUT, min(below, x * FAN_OUT + FAN_OUT))
            if a == b:
                i, j = np.triu_indices(len(kids(a)), 1 if level == 1 else 0)
                i, j = i + a * FAN_OUT, j + a * FAN_OUT
            else:
                ka, kb = kids(a), kids(b)
                i, j = np.repeat(ka, len(kb)), np.tile(kb, len(ka))
            keep = self.possible(level - 1, i, level - 1, j) | (i == j)
            # near pairs last on the stack, so first joined: they spare checks farther out
            for x, y in sorted(zip(i[keep].tolist(), j[keep].tolist(), strict=True), key=lambda p: p[0] - p[1]):
                stack.append((level - 1, x, y))
        return links


def tree_links(rows: list[tuple[int, int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links between documents: rows are (cluster, component, doc, set); clusters are joined
    one by one."""
    out: list[tuple[int, int]] = []
    rows.sort(key=lambda r: (r[0], len(r[3]), int(r[3][0]), r[2]))
    i = 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][0] == rows[i][0]:
            j += 1
        part = rows[i:j]
        if len(part) > 1:
            out += [(part[a][2], part[b][2]) for a, b in SignatureTree([r[3] for r in part]).join([r[1] for r in part])]
        i = j
    return out


def _joined_groups(rows: DataFrame, by: list[str], k: int, whole: bool = False) -> DataFrame:
    """Links (u, v) inside each group of rows (cluster, component, doc, text). If groups hold
    ``whole`` clusters, u is a document and v the smallest one that links reach from it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [(c, m, d, shingle_set(t.encode(), k)) for c, m, d, t in zip(pdf.cluster, pdf.component, pdf.doc, pdf.text, strict=True)]
        links = tree_links([r for r in sets if len(r[3])])  # an id may have a blank text besides
        if whole:
            local = _Local()
            for u, v in links:
                local.join(u, v)
            links = [(x, local.root(x)) for x in sorted({x for link in links for x in link})]
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return rows.groupBy(*by).applyInPandas(run, "u long, v long")


# --- the operator -------------------------------------------------------------------------


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(sets, groups). sets: doc, n, rep (smallest doc with that set), one row per row of
    ``docs``. groups: (rep, component) of the representatives that link with others; component
    is the smallest of those that links reach."""
    prepare(docs.sparkSession)
    with shuffles_removed(docs.sparkSession):
        return _groups(docs, id_col, text_col, k, tile)


def _groups(docs: DataFrame, id_col: str, text_col: str, k: int, tile: int) -> tuple[DataFrame, DataFrame]:
    scan = as_table(_scan(docs, id_col, text_col, k), "jaccard-scan")
    rows = scan.where("slice is null").select("doc", "n", "key")
    cells = _cells(scan)
    reps = rows.where("doc is not null and n > 0").groupBy("key").agg(F.min("doc").alias("rep"), F.first("n").alias("n"))
    clusters = _candidates(docs, id_col, text_col, k, cells, reps)
    # one row per different set of a cluster of two sets or more
    weight = F.greatest(F.lit(1.0), F.max("n") / UNIT).alias("weight")
    member = clusters.join(reps.groupBy(F.col("rep").alias("doc")).agg(weight), "doc")
    sizes = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), F.sum("weight").alias("size")).where("sets > 1").drop("sets")
    member = member.join(dealt_anew(sizes), "cluster").checkpoint()
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    held = key_filter(member.select(F.xxhash64("doc").alias("k")))
    texts = texts.where(may_be_in(docs.sparkSession, held, F.xxhash64("doc")))
    full = as_table(texts.join(member, "doc").dropDuplicates(["doc", "text"]), "jaccard-members")

    def tiles(n):
        return F.greatest(F.lit(1), F.ceil(F.col(n) / tile)).cast("long")

    n_small = member.where(F.col("size") <= tile).agg(F.sum("weight")).first()[0] or 0
    bins = max(1, math.ceil(n_small / min(tile, BIN)))
    small = full.where(F.col("size") <= tile).withColumn("component", F.col("doc"))
    links = _joined_groups(small.withColumn("bin", F.pmod(F.xxhash64("cluster"), F.lit(bins))), ["bin"], k, whole=True)
    big = full.where(F.col("size") > tile)
    found = None
    if not member.where(F.col("size") > tile).isEmpty():
        labels = big.select("doc").distinct().withColumn("component", F.col("doc"))
        for turn in (1, 2):
            dealt = big.join(labels, "doc").withColumn("tile", F.pmod(F.xxhash64("doc", F.lit(turn)), tiles("size")))
            more = as_table(_joined_groups(dealt, ["cluster", "tile"], k), "jaccard-tiles")
            found = more if found is None else found.union(more)
            comp = connected_components(found)
            labels = big.select("doc").distinct().join(comp.withColumnRenamed("node", "doc"), "doc", "left").select("doc", F.coalesce("component", "doc").alias("component")).checkpoint()
        found = found.union(_apart(big, labels, k, tiles, tile))
    groups = links.select(F.col("u").alias("rep"), F.col("v").alias("component"))
    if found is not None:
        groups = groups.union(connected_components(found))
    groups = as_table(groups, "jaccard-groups")
    sets = rows.join(dealt_anew(reps.drop("n")), "key", "left").select("doc", "n", F.when(F.col("n") > 0, F.col("rep")).alias("rep"))
    return sets, groups


def _apart(big: DataFrame, labels: DataFrame, k: int, tiles, tile: int) -> DataFrame:
    """Links between components of one cluster that are still apart: tiles of one large
    component or of several small ones, all pairs of tiles that are not of one component. As a
    tile goes to each of its pairs, they are dealt to waves that move as much text as ``big``
    has, on average, and a wave's text is gone from disk before the next one moves."""
    rows = big.join(labels, "doc")
    count = rows.groupBy("cluster", "component").agg(F.sum("weight").alias("members"))
    count = count.withColumn("large", F.col("members") > tile)
    rest = count.where("not large").groupBy("cluster").agg(F.sum("members").alias("others"))
    count = count.join(rest, "cluster", "left").fillna(0, ["others"])
    rows = rows.join(dealt_anew(count), ["cluster", "component"]).withColumn(
        "tile",
        F.when(F.col("large"), F.xxhash64("component", F.pmod(F.xxhash64("doc"), tiles("members")))).otherwise(
            F.xxhash64(F.lit(-1), F.pmod(F.xxhash64("component"), tiles("others")))
        ),
    )
    rows = rows.select("cluster", "component", "doc", "text", "tile", F.when(F.col("large"), F.col("component")).alias("whole")).checkpoint()
    have = rows.groupBy("cluster", "tile").agg(F.first("whole").alias("whole"), F.sum(F.octet_length("text")).alias("bytes")).checkpoint()
    a, b = have.alias("a"), have.alias("b")
    pairs = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.tile") <= F.col("b.tile"))).where(
        "a.whole is null or b.whole is null or a.whole <> b.whole"
    )
    moved = F.col("a.bytes") + F.when(F.col("a.tile") < F.col("b.tile"), F.col("b.bytes")).otherwise(0)
    pairs = pairs.select(F.col("a.cluster").alias("cluster"), F.col("a.tile").alias("x"), F.col("b.tile").alias("y"), moved.alias("moved")).checkpoint()
    waves = max(1, math.ceil((pairs.agg(F.sum("moved")).first()[0] or 0) / (have.agg(F.sum("bytes")).first()[0] or 1)))
    sides = pairs.select("cluster", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("tile"))
    found = None
    for wave in range(waves):
        some = sides.where(F.pmod(F.xxhash64("cluster", "x", "y"), F.lit(waves)) == wave)
        # a few rows a tile: broadcast, so that only the texts' way to their pairs is a shuffle
        more = as_table(_joined_groups(rows.join(F.broadcast(some), ["cluster", "tile"]), ["cluster", "x", "y"], k), "jaccard-pairs")
        found = more if found is None else found.union(more)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, tile: int = TILE) -> DataFrame:
    """Per row of ``docs``: the id, n_shingles and component_id, the smallest id that links
    reach. Null and empty texts have no shingles and are their own component; a row without
    id has no component and links nothing; rows that share an id are one node."""
    sets, groups = near_duplicate_groups(docs, id_col, text_col, k, tile)
    kind = docs.schema[id_col].dataType
    return sets.join(groups, "rep", "left").select(
        F.col("doc").cast(kind).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.coalesce("component", "rep", "doc")).cast(kind).alias("component_id"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, tile: int = TILE) -> DataFrame:
    """``docs`` without those whose component has a smaller id: one document of each group
    stays. Rows without id stay; of rows that repeat an id in a group, all stay."""
    found = near_duplicates(docs.select(id_col, text_col), id_col, text_col, k, tile)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return without_ids(docs, id_col, as_table(gone, "jaccard-gone"))
