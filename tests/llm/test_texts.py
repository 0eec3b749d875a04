"""Brute-force checks of the text operators on small tables, and the edge cases: nulls, empty
and long texts, ties, repeated rows, empty tables, clashing column names."""

import base64
import collections
import gzip
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
import zstandard

from panelengine.llm import common, decontaminate, jaccard, line_chunks, packing, pii, quality, secrets, substring, toxicity, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuvwxyz") * rng.randint(1, 3) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, null and empty text, blanks only, repeated rows, one id with two texts, a very long
    text, and columns that clash with names used inside."""
    rng = random.Random(5)
    body = "\n".join(" ".join(words(rng, 12)) + "." for _ in range(12))
    long = "\n".join(" ".join(words(rng, 40)) + "." for _ in range(3000))
    rows = [(1, None), (None, body), (None, None), (2, ""), (3, " \n\t\n"), (4, body), (4, body), (5, body), (5, "short text"), (6, long), (7, "é" * 10), (8, body + " more\nwords")]
    names = "hash, start, kept, _text, _may, _q_, _mark_id, _key, spans, component, ROW".split(", ")
    schema = SCHEMA + "".join(f", `{n}` string" for n in names)
    return spark.createDataFrame([(i, t, "en", None, None, *["x"] * len(names)) for i, t in rows], schema)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- shared helpers -----------------------------------------------------------------------


def test_shingle_hashes_agree_with_equality():
    rng = random.Random(1)
    w = [rng.choice([b"a", b"bb", b"c" * 300, "é".encode()]) for _ in range(400)]
    h = common.shingle_hashes(w, 5)
    by = collections.defaultdict(set)
    for i, x in enumerate(h.tolist()):
        by[x].add(tuple(w[i : i + 5]))
    assert len(h) == 396 and all(len(v) == 1 for v in by.values())
    assert len(by) == len({tuple(w[i : i + 5]) for i in range(396)})
    assert len(common.shingle_hashes([b"x", b"y"], 5)) == 1 and len(common.shingle_hashes([], 5)) == 0


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    w = words(random.Random(2), 500)
    w = [x.encode() for x in w]
    whole = common.shingle_hashes(w, 5)
    monkeypatch.setattr(common, "BLOCK_WORDS", 7)
    assert (common.shingle_hashes(w, 5) == whole).all()


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2001 + i) for i in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_key_filter(spark):
    keys = [0, 1, -1, 2**62, -(2**63), 12345]
    bits = common.key_filter(spark.createDataFrame([(k,) for k in keys], "k long"))
    assert common.passes(bits, np.array(keys)).all()
    assert not common.passes(bits, np.array([2, 3, 99999])).any()


# --- 7 quality ----------------------------------------------------------------------------


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality_base_measures(spark, docs, odd):
    for table in (docs, odd):
        rows = table.select("doc_id", "text").collect()
        want = collections.Counter((r.doc_id, *brute_quality(r.text or "")) for r in rows)
        got = quality.quality_report(table).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want


def test_quality_bands():
    rng = random.Random(4)
    codec = zstandard.ZstdCompressor(level=quality.LEVEL)
    kept = lambda t: quality.measure(t.encode(), codec)[6]
    prose = " ".join(words(rng, 3000))
    noise = " ".join(base64.b64encode(rng.randbytes(30)).decode() for _ in range(3000))
    lists = " ".join(f"{'ab' * 40}{i % 7}{i}" for i in range(3000))
    assert kept(prose) and not kept(noise) and not kept(lists) and not kept("") and not kept("a b c")


def test_quality_filter_keeps_columns(odd, empty):
    out = quality.quality_filter(odd)
    assert out.columns == odd.columns and sorted(r.doc_id or 0 for r in out.collect()) == [0, 4, 4, 5, 6, 8]
    assert quality.quality_filter(empty).count() == 0 and quality.quality_report(empty).count() == 0


# --- 5 line chunks ------------------------------------------------------------------------


def brute_line_dedup(rows):
    """rows: (id, hash, text), distinct; kept text of each by one pass in rank order."""
    seen, out = set(), {}
    for key in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        text, kept, at = key[2], [], 0
        for start, end, n, _ in line_chunks.chunks(text):
            body = text[start:end].rstrip("\n")
            if n >= line_chunks.MIN_LINES:
                if body in seen:
                    kept.append(text[at:start])
                    at = end
                seen.add(body)
        out[key] = "".join(kept) + text[at:]
    return out


def test_chunks_cover_and_resist_shifts():
    rng = random.Random(6)
    lines = [" ".join(words(rng, 5)) for _ in range(60)]
    text = "\n".join(lines)
    c = line_chunks.chunks(text)
    assert "".join(text[a:b] for a, b, _, _ in c) == text
    moved = line_chunks.chunks("another line\nand one more\n" + text)
    assert len({x[3] for x in c} - {x[3] for x in moved}) <= 1
    assert line_chunks.chunks("") == []


def test_line_dedup_against_brute_force(spark, docs, odd):
    from pyspark.sql import functions as F

    for table in (docs, odd):
        rows = table.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()
        want = brute_line_dedup({(r.doc_id, r.h, r.text) for r in rows if r.text is not None})
        expect = collections.Counter((r.doc_id, None if r.text is None else want[(r.doc_id, r.h, r.text)]) for r in rows)
        out = line_chunks.line_dedup(table)
        assert sorted(out.columns) == sorted(table.columns)
        assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == expect
    gone = [r for r in line_chunks.line_dedup_report(odd).collect() if r.n_removed]
    assert {r.doc_id for r in gone} >= {None, 5}


def test_line_dedup_of_nothing(empty):
    assert line_chunks.line_dedup(empty).count() == 0 and line_chunks.line_dedup_report(empty).count() == 0


# --- 8 Jaccard join -----------------------------------------------------------------------


def brute_components(rows):
    """rows: (id, text); shingle sets by row, smallest id reachable by id."""
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and None not in (i, j) and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return collections.Counter((i, len(x), None if i is None else root(i)) for i, x in sets)


def near_copies(rng, n, size, edits):
    base, out = words(rng, size), []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(size)] = rng.choice("xyz") * rng.randint(1, 9)
        out.append(" ".join(w))
        base = w if rng.random() < 0.3 else base
    return out


@pytest.mark.parametrize("tile", [1000, 4])
def test_near_duplicates_against_brute_force(spark, tile):
    rng = random.Random(7)
    texts = [t for n, size, e in ((14, 60, 4), (9, 200, 12), (6, 7, 1), (5, 3, 1), (8, 40, 3)) for t in near_copies(rng, n, size, e)]
    texts += [" ".join(words(rng, 30)) for _ in range(20)] + ["", None, "one", "one", "One"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_near_duplicates_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = jaccard.near_duplicates(odd).collect()
    want = brute_components([r for r in rows if r[0] is not None])
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == want
    assert sum(r.doc_id is None and r.component_id is None for r in got) == 2
    kept = jaccard.keep_one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 4, 6, 7]
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.keep_one_of_each(empty).count() == 0


def test_signature_tree_finds_all_links():
    rng = random.Random(8)
    sets = [common.shingle_set(t.encode(), 5) for n, s, e in ((30, 50, 5), (20, 300, 40)) for t in near_copies(rng, n, s, e)]
    sets.sort(key=len)
    parent = jaccard._Local()
    for a in range(len(sets)):
        for b in range(a):
            if jaccard.linked(sets[a], sets[b]):
                parent.join(a, b)
    found = jaccard._Local()
    for a, b in jaccard.SignatureTree(sets).join(list(range(len(sets)))):
        found.join(a, b)
    assert [parent.root(i) for i in range(len(sets))] == [found.root(i) for i in range(len(sets))]


# --- 4 decontamination --------------------------------------------------------------------


def brute_hits(text, items, window=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, names = set(), set()
    for item, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        for k in range(max(1, len(v) - window + 1) if v else 0):
            x = v[k : k + window]
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit |= set(range(p, p + len(x)))
                    if item is not None:
                        names.add(str(item))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_contamination_against_brute_force(spark, block):
    rng = random.Random(9)
    long = words(rng, 40)
    items = [(10, " ".join(long[:25])), (9, "Two Words"), (100, "é-ü x1"), (None, " ".join(long[25:38])), (7, ""), (8, None), (10, "a a a a a a a a a a a a")]
    docs = [(1, "pre " + ", ".join(long).upper() + " post"), (2, "two words, two; WORDS"), (2, "é ü X1"), (3, None), (4, ""), (None, " ".join(long[3:14])), (5, "a " * 30), (6, "two"), (5, "a " * 30)]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, `_hits_` int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination_report(d, b, block_bytes=block).collect()
    want = collections.Counter((i, *brute_hits(t, items)) for i, t in docs)
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    clean = decontaminate.drop_contaminated(d, b, block_bytes=block)
    assert clean.columns == d.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 6]


def test_contamination_of_the_table(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination_report(docs, bench).collect()}
    assert any(x[-1] for x in got.values())
    for i in list(got)[::4]:
        assert got[i] == brute_hits(texts[i], items)


def test_contamination_of_nothing(spark, empty, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination_report(empty, none).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination_report(odd, none).collect())


# --- 10 packing ---------------------------------------------------------------------------


def packed(spark, table, **options):
    import public_tokenizers

    return packing.pack(table, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, **options).collect()


def test_packing_round_trip(spark, docs, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    extra = spark.createDataFrame([(900001, "a\t\n b  c  d e \n\n f   <|endoftext|> x\x1cy 12 345's"), (900002, "  lead\n\n\ntrail  \n")], "doc_id long, text string")
    for table in (docs.select("doc_id", "text").union(extra), odd.where("doc_id is not null and doc_id not in (4, 5)")):
        rows = packed(spark, table)
        sequences = collections.defaultdict(list)
        pieces = collections.defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append((r.offset, r.length))
            pieces[r.doc_id].append(r)
            assert r.ids_crc32 == zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) and len(r.ids) == 2 * r.length > 0
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= packing.LENGTH and at & (at - 1) == 0  # full, or a power of two: no padding at all
        want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [0] for r in table.select("doc_id", "text").collect()}
        assert set(pieces) == set(want)
        for i, ps in pieces.items():
            ps.sort(key=lambda p: p.start)
            ids = np.frombuffer(b"".join(p.ids for p in ps), "<u2").tolist()
            assert ids == want[i] and all(p.doc_tokens == len(ids) for p in ps)


def test_packing_repeats_and_nothing(spark, odd, empty):
    got = collections.Counter()
    for r in packed(spark, odd):
        got[r.doc_id] += r.length
    assert got[4] > 2 * 100 and got[1] == 1
    assert packed(spark, empty) == []


def test_hilbert_neighbours():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    k = packing.hilbert(g, 3)
    assert sorted(k.tolist()) == list(range(512))
    assert (np.abs(np.diff(g[np.argsort(k)], axis=0)).sum(1) == 1).all()


# --- 9 substring --------------------------------------------------------------------------


def brute_spans(rows, min_words=substring.MIN_WORDS):
    seen, out = {}, []
    for i, h, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        run = []
        u = substring.units(t)
        for j, (a, b, n, digest) in enumerate([*u, (0, 0, 0, b"")]):
            first = seen.get(digest)
            if first is not None:
                run.append((a, b, n, first[0]))
            if first is None or j == len(u):
                if sum(x[2] for x in run) >= min_words:
                    out.append((i, run[0][0], run[-1][1], len(run), sum(x[2] for x in run), tuple(sorted({x[3] for x in run if x[3] is not None}))))
                run = []
                if digest:
                    seen[digest] = (i, a)
    return collections.Counter(out)


def test_substring_dedup_against_brute_force(docs, odd):
    from pyspark.sql import functions as F

    for table in (docs, odd):
        rows = {(r.doc_id, r.h, r.text) for r in table.select("doc_id", F.xxhash64("text").alias("h"), "text").collect() if r.text is not None}
        got = collections.Counter((r.id, r.start, r.end, r.n_units, r.n_words, tuple(r.kept_ids)) for r in substring.repeated_spans(table).collect())
        assert got == brute_spans(rows) and got


def test_spliced_passage_is_found(spark):
    rng = random.Random(11)
    sentence = lambda n: " ".join(words(rng, n)).capitalize() + "."
    passage = " ".join(sentence(11) for _ in range(6))
    rows = [(1, f"{sentence(9)} {passage} {sentence(8)}"), (2, f"{sentence(30)} the {passage}\n{sentence(9)}"), (3, " ".join(sentence(10) for _ in range(9)))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substring.repeated_spans(table).collect()
    assert [(r.id, r.kept_ids) for r in spans] == [(2, [1])] and spans[0].n_words >= 50
    left = {r.doc_id: r.text for r in substring.substring_dedup(table).collect()}
    assert left[1] == rows[0][1] and left[3] == rows[2][1] and len(left[2]) == len(rows[1][1]) - (spans[0].end - spans[0].start)


def test_substring_of_nothing(empty):
    assert substring.repeated_spans(empty).count() == 0 and substring.substring_dedup(empty).count() == 0
    assert substring.units("") == [] and substring.units(" \n . \n") == []


# --- 6 WARC -------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    html = [(3, "http://a", "<p>x</p>"), (1, "http://b\r\nEvil: 1", "<p>x</p>"), (2, None, "<p>é\r\n\r\n</p>"), (4, "u", None), (5, "u", ""), (None, "n", "<p>x</p>"), (7, "l", "z" * 300_000), (7, "l", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "c") for r in html], "page_id long, url string, html string, payload string")
    folder = common.shared_path(spark, "test-warc")
    index = warc.write_archives(pages, folder, archive_bytes=300)
    assert index.count() == len(html) and index.select("file").distinct().count() > 1
    got = warc.read_records(index, folder, with_payload=True).collect()
    assert collections.Counter(r.page_id for r in got) == collections.Counter(r[0] for r in html)
    by = {r.page_id: r for r in got if r.page_id != 7}
    assert (by[1].record_type, by[3].record_type, by[3].refers_to, by[None].refers_to) == ("response", "revisit", 1, 1)
    assert by[4].record_type == "response" and by[5].refers_to == 4 and by[5].payload_bytes == 0
    assert by[2].payload.decode() == html[2][2] and by[2].payload_digest == warc.sha1_base32(html[2][2].encode())
    seven = sorted((r for r in got if r.page_id == 7), key=lambda r: r.record_type)
    assert [(r.record_type, r.refers_to, r.payload_bytes) for r in seven] == [("response", None, 300_000), ("revisit", 7, 300_000)]
    some = warc.read_records(index.where("page_id in (1, 2)"), folder, gap=0).collect()
    assert sorted(r.page_id for r in some) == [1, 2]


def test_warc_files_are_archives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (2, "u", "<p>b</p>")], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/w")
    data = b"".join(gzip.open(p).read() for p in (tmp_path / "w").iterdir())
    assert data.count(b"WARC/1.1\r\n") == 2 and data.endswith(b"\r\n\r\n")


def test_warc_smallest_revisit(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.archive_round_trip(pages, min_revisit_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


# --- 2 secrets ----------------------------------------------------------------------------

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    t = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    return *[sum(s[1] == i for s in spans) for i in range(3)], hashlib.sha256(listed.encode()).hexdigest()


def test_secrets_against_brute_force(spark, docs, odd, empty):
    h = "0123456789abcdef"
    tricky = [
        "password:token : abcdefg", "PassWord = 'x' token=" + h, "é😀 api_key=\"" + h * 2 + '"', "AKIAAKIA" + "B" * 16, "AKIA" + "B" * 15, "AKIA" + "B" * 16 + h * 3,
        h * 5, "x" + h + "0" * 7 + "G" + h + "0" * 8, "secret=abc12 secret=abc123", "tokentoken==abcdef", "passwd : " + "-" * 6, " ".join(f"token={h}{i}" for i in range(300)), h + "\n" + h,
    ]
    table = docs.select("doc_id", "text", "source").union(odd.select("doc_id", "text", "source"))
    table = table.union(spark.createDataFrame([(10_000 + i, t, None) for i, t in enumerate(tricky)], "doc_id long, text string, source string"))
    want = collections.Counter((r.doc_id, *brute_secrets(r.text)) for r in table.collect())
    got = secrets.find_secrets(table).collect()
    assert collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    assert all(hashlib.sha256(",".join(x for x in r.spans.split(",") if not x.startswith("provider")).encode()).hexdigest() == r.base_sha256 for r in got)
    assert secrets.find_secrets(empty).count() == 0


def test_secret_ownership(spark):
    live, copied = "ghp_" + "a1B2" * 9, "ghp_" + "z9Y8" * 9
    rows = [(i, f"key {copied}", f"owner{i}") for i in range(6)] + [(7, f"{live} and {live}", "owner1"), (8, "token=abcdef1", "owner2"), (9, None, None)]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].spans == "" and (got[0].n_live, got[0].n_example) == (0, 0)
    assert got[7].spans == f"provider:0:{len(live)},provider:{len(live) + 5}:{2 * len(live) + 5}" and got[7].n_live == 2
    assert got[8].spans == "assign:0:13" and got[8].n_live == 1 and got[9].spans == ""


def test_secret_plan_is_native(docs):
    plan = secrets.find_secrets(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 3 personal data ----------------------------------------------------------------------

PERSONAL = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_personal(text):
    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    spans = [(k, m.start(), m.end()) for k, p in PERSONAL.items() for m in re.finditer(p, text or "") if ok(k, m[0])]
    return *[sum(s[0] == k for s in spans) for k in PERSONAL], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_personal_data_against_brute_force(spark, docs, odd, empty):
    tricky = [
        "a@b@c.de x@y.z@w.uk a..b@c-.d.e @x.y a@", "1.2.3.4.5.6.7.8 256.1.1.1 01.02.003.0004 1.2.3 .1.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 378282246310005",
        "+1 (319) 555-5132 +44 20 +49-30.1234567 (+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6)", "é😀 jo.e@mail.example.com", "9" * 40 + "." + "1.1.1", "+" * 5 + "1 234 567 89", "1" * 13 + " " + "0" * 16,
    ]
    table = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    table = table.union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string"))
    want = collections.Counter((r.doc_id, *brute_personal(r.text)) for r in table.collect())
    got = pii.find_personal_data(table).collect()
    assert collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert all(r.n_added == sum(x.split(":")[0] not in pii.BASE for x in r.spans.split(",") if x) for r in got)
    assert pii.find_personal_data(empty).count() == 0


def test_estimation_recovers_reliable_labelers():
    rng = random.Random(12)
    counts = collections.Counter()
    truth = {}
    for _ in range(6000):
        z = rng.random() < 0.6
        v = "".join("p" if (rng.random() < a) == z else "n" for a in (0.95, 0.9, 0.85, 0.6, 0.9))
        counts[f"ssn|{v}|1|1|1"] += 1
        truth.setdefault(v, []).append(z)
    posterior, rates = pii.estimate(counts)
    assert np.allclose(rates[:, 2, 1], [0.95, 0.9, 0.85, 0.6, 0.9], atol=0.06)
    w = pii.train(counts, posterior)
    right = sum((pii.features(f"ssn|{v}|1|1|1") @ w > 0) == z for v, zs in truth.items() for z in zs)
    assert right > 0.95 * 6000


def test_added_spans(spark):
    good = [(i, f"call her at {200 + i}-555-{1000 + i} or write, ssn {100 + i}-45-678{i % 10} today") for i in range(40)]
    bad = [(100 + i, f"part number x{i}-000-00-0000-{i} and order 000-00-0000/1") for i in range(40)]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(good + bad, "doc_id long, text string")).collect()}
    assert all(got[i].spans.startswith("local_phone:12:24,ssn:") for i in range(40)) and not any(got[100 + i].spans for i in range(40))


# --- 1 toxicity ---------------------------------------------------------------------------


def test_block_max_index_is_exact_and_skips():
    """Equal to all cosines, ties by number, while blocks whose bound is too low stay closed."""
    rng = np.random.default_rng(13)
    vectors = []
    for i in range(600):
        topic = 40 + 8 * (i % 6)  # six topics, and words that all have
        t = np.sort(np.concatenate([rng.choice(20, 5, replace=False), topic + rng.choice(8, 4, replace=False)])).astype(np.uint64)
        w = rng.random(len(t)) * np.where(t >= 40, 3, 0.3) + 0.01
        vectors.append((t, w / np.linalg.norm(w)))
    vectors += vectors[:30]  # ties
    dense = np.zeros((len(vectors), 100))
    for i, (t, w) in enumerate(vectors):
        dense[i, t.astype(int)] = w
    index = toxicity.BlockMaxIndex(vectors, block=16)
    assert index.rows.shape[2] > 15  # terms with block maxima
    for q in range(0, len(vectors), 7):
        scores = np.round(dense @ dense[q], 12)
        want = sorted(((float(s), i) for i, s in enumerate(scores) if s > 0 and i != q), key=lambda x: (-x[0], x[1]))[:10]
        got = index.nearest(*vectors[q], 10, leave_out=q)
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [s for s, _ in want])
    assert index.passed > index.opened > 0
    assert index.nearest(np.empty(0, np.uint64), np.empty(0), 10) == []
    assert toxicity.BlockMaxIndex([]).nearest(vectors[0][0], vectors[0][1], 3) == []


def test_ties_beyond_the_kth_place():
    t = np.array([1, 2], np.uint64)
    index = toxicity.BlockMaxIndex([(t, np.array([0.6, 0.8]))] * 100 + [(t[:1], np.array([1.0]))] * 40, block=8)
    assert [i for _, i in index.nearest(t, np.array([0.6, 0.8]), 12)] == list(range(12))
    assert [i for _, i in index.nearest(t[:1], np.array([1.0]), 5)] == list(range(100, 105))


def test_toxicity_against_brute_force(spark, docs, monkeypatch):
    """The whole query: vectors over words as strings, all cosines, votes and calibration."""
    monkeypatch.setattr(toxicity, "ALPHA", 1000.0)  # little evidence suffices on a small table
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    y = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    split = {i: collections.Counter(decontaminate.words_of(t)) for i, t in texts}
    terms = {i: {**{(w, 0): n for w, n in c.items()}, **collections.Counter({(w[:b], b): 0 for w in c for b in toxicity.BEGINNINGS if len(w) > b})} for i, c in split.items()}
    for i, c in split.items():
        for w, n in c.items():
            for b in toxicity.BEGINNINGS:
                if len(w) > b:
                    terms[i][w[:b], b] += n
    train = [i for i, _ in texts if i in y]
    rate = sum(y[i] for i in train) / len(train)
    seen, toxic = collections.Counter(t for i in train for t in terms[i]), collections.Counter(t for i in train if y[i] for t in terms[i])
    part = lambda a, b: a * np.log(a / b) if a > 0 else 0.0
    strength = {t: n * (part(toxic[t] / n, rate) + part(1 - toxic[t] / n, 1 - rate)) / np.log(len(seen) / toxicity.ALPHA) for t, n in seen.items() if toxic[t] / n > rate}
    factor = {t: 1 + e for t, e in strength.items() if e >= 1}
    assert factor

    def cell(t):
        a, _, b, _ = toxicity.text_terms(t[0] if not t[1] else t[0] + b"x")
        return int(toxicity.cells(a if not t[1] else b[[n for n in toxicity.BEGINNINGS if n < len(t[0]) + 1].index(t[1]) :][:1])[0])

    used = {i: {t: n for t, n in c.items() if not t[1] or t in factor} for i, c in terms.items()}
    cells = {t: cell(t) for c in used.values() for t in c}
    have = collections.Counter(c for d in used.values() for c in {cells[t] for t in d})
    vectors = {}
    for i, c in used.items():
        v = {t: (1 + np.log(n)) * (np.log((1 + len(texts)) / (1 + have[cells[t]])) + 1) * factor.get(t, 1.0) for t, n in c.items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {t: x / norm for t, x in v.items()}
    near = lambda i, out: sorted(((-round(sum(x * vectors[j].get(t, 0.0) for t, x in vectors[i].items()), 12), j) for j in train if j != out and vectors[j]))[: toxicity.NEIGHBOURS]
    prior = (sum(y[i] for i in train) + 0.5) / (len(train) + 1)

    def vote(found):
        w = [(1 / (0.05 + max(0.0, 1 + s)), y[j]) for s, j in found if s < 0]
        return (sum(a * b for a, b in w) + prior) / (sum(a for a, _ in w) + 1)

    some = [i for i in train if vectors[i]]
    steps = toxicity.isotonic(np.array([vote(near(i, i)) for i in some]), np.array([float(y[i]) for i in some]))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(texts)
    for i, _ in texts[::3]:
        found = [x for x in near(i, None) if x[0] < 0]
        if found:
            assert np.isclose(got[i].vote, vote(found), atol=1e-6) and np.isclose(got[i].score, toxicity.calibrated(steps, vote(found)), atol=1e-5)
            assert np.allclose([e.similarity for e in got[i].evidence], [-s for s, _ in found[:3]], atol=1e-9)


def test_isotonic_rises():
    x = np.array([0.1, 0.2, 0.2, 0.3, 0.9])
    steps = toxicity.isotonic(x, np.array([0.0, 1, 0, 0, 1]))
    assert [s[1] for s in steps] == sorted(s[1] for s in steps)
    assert 0 <= toxicity.calibrated(steps, 0.5) <= 1 and toxicity.calibrated([], 0.3) == 0.3


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = docs.where(~toxicity.is_training(docs.doc_id)).join(labels.select("doc_id", "toxic"), "doc_id")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(held.select("doc_id", "text"), model).join(labels, "doc_id").collect()
    assert all(r.held_out and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic) and sum(r.predicted for r in rows if r.toxic == 0) <= 0.02 * len(rows)
    assert all(any(e.label == 1 for e in r.evidence) for r in toxic if r.predicted)


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, "x"), (4, 0, "x"), (None, 1, "x"), (5, None, "x"), (6, 0, "x")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0
    none = toxicity.toxicity(odd, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1


def test_toxicity_of_a_copy_with_rare_words(spark):
    """A copy of a toxic example is nearest to it, though no word of it tells anything; so is a
    text of one word."""
    rng = random.Random(23)
    rows = [(i, " ".join(words(rng, 30)), 0) for i in range(0, 400)]
    rows += [(400 + i, " ".join([*(f"slur{j}" for j in rng.sample(range(6), 3)), *words(rng, 20)]), 1) for i in range(60)]
    rare = " ".join(f"w{j}x" for j in range(25))
    train = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows += [(train, rare, 1), (3000, rare, None), (3001, "w7x", None), (3002, "zz unseen", None), (3003, "", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(table.select("doc_id", "text"), table.select("doc_id", "toxic")).collect()}
    for i in (3000, 3001):
        assert got[i].evidence[0].example == str(train) and got[i].evidence[0].label == 1
    assert got[3000].evidence[0].similarity > 0.999 and got[3000].predicted == 1
    assert not got[3002].evidence and not got[3003].evidence


def test_packing_ids_are_those_of_the_json_tokenizer(spark):
    """With the tokenizer's default settings: its added token is found in texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    given = ["x <|endoftext|> y", "<|endoftext|>", "a  <|endoftext|><|endoftext|>\n\n b\t<|endoftext|>c  ", "<|endoftext| > no", "plain words"]
    table = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    pieces = collections.defaultdict(list)
    for r in packed(spark, table, added=packing.added_tokens(path)):
        pieces[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    for i, text in enumerate(given):
        ids = np.frombuffer(b"".join(p[1] for p in sorted(pieces[i])), "<u2").tolist()
        assert ids == [*t.encode(text, add_special_tokens=False).ids, packing.END] and {p[2] for p in pieces[i]} == {len(ids)}
    assert 50256 in t.encode(given[0], add_special_tokens=False).ids


def test_packing_query_finds_the_added_token(spark, tmp_path):
    import corpus_pipeline
    from panelengine.llm import queries

    spark.createDataFrame([(1, "x <|endoftext|> y")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = zlib.crc32(np.array([87, 220, 50256, 331, 0], "<u4").tobytes())
    rows = queries.op10_packing(spark, str(tmp_path)).collect() + corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "").collect()
    assert [r.doc_tokens for r in rows if r.start == 0] == [5, 5] and len(rows) in (2, 4)
    assert all(r.ids_crc32 == want for r in rows if r.length == 5)


def test_units_do_not_depend_on_the_splice(spark):
    """Passages without any mark, and Chinese ones without white space, in the middle of other
    lines."""
    rng = random.Random(41)
    chinese = lambda n: "".join(rng.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜") + "，" * (rng.random() < 0.1) for _ in range(n))
    plain_text = lambda n: " ".join(words(rng, n))
    for make, blank in ((plain_text, " "), (chinese, "")):
        rows = []
        for i in range(40):
            passage = make(60)
            rows += [(i, make(9) + blank + passage + blank + make(8)), (100 + i, make(14) + blank + passage + blank + make(5))]
        found = {r.id: r for r in substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert len(found) >= 38 and all(i >= 100 and r.kept_ids == [i - 100] and 30 <= r.n_words <= 66 for i, r in found.items())
    assert [u[2] for u in substring.units("one two\nthree")] == [2, 1]
    text = "  - Well, (this is) it: a long line of words; with marks!\n\n * next "
    u = substring.units(text)
    assert text[u[0][0] :].startswith("- Well") and text[: u[-1][1]].endswith("next") and sum(x[2] for x in u) == 12


def test_blank_row_of_an_id_in_a_cluster(spark):
    rng = random.Random(31)
    body = " ".join(words(rng, 60))
    rows = [(1, body), (1, ""), (1, " \n"), (2, body + " end"), (3, "others alone")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(table).collect()}
    assert got == {(1, 1), (2, 1), (3, 3)}
    assert sorted(r.doc_id for r in jaccard.keep_one_of_each(table).collect()) == [1, 1, 1, 3]


def full_cells(monkeypatch):
    """The shingle counts of a corpus so large that they tell rare from frequent no more."""
    cells = np.zeros(1 << jaccard.CELL_BITS, np.uint64)
    monkeypatch.setattr(jaccard, "_cells", lambda scan: cells)
    return cells


def test_common_phrases_do_not_chain_clusters(spark, monkeypatch):
    """Pairs of copies, each with a phrase of the pair before and one of the pair after."""
    cells = full_cells(monkeypatch)
    rng = random.Random(51)
    phrases = [" ".join(words(rng, 8)) for _ in range(31)]
    rows = []
    for i in range(30):
        body = [*words(rng, 40), phrases[i], *words(rng, 40), phrases[i + 1]]
        rows += [(2 * i, " ".join(body)), (2 * i + 1, " ".join([*body, "end"]))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard._candidates(table, "doc_id", "text", 5, cells, table.selectExpr("doc_id rep")).collect()
    assert {r.doc: r.cluster for r in found} == {i: i // 2 * 2 for i in range(60)}
    got = jaccard.near_duplicates(table).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_pairs_of_tiles_go_in_waves(spark, monkeypatch):
    """One cluster of texts that share much and hardly link, over many tiles: no wave moves much
    more than the texts once."""
    full_cells(monkeypatch)
    rng = random.Random(52)
    base = words(rng, 80)
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([1, 5, 6, 7])):
            w[rng.randrange(len(w))] = f"new{rng.random()}"
        rows.append((i, " ".join(w)))
    moved = []

    def joined(frame, by, k, whole=False, then=jaccard._joined_groups):
        if "x" in by:
            moved.append(frame.count())
        return then(frame, by, k, whole)

    monkeypatch.setattr(jaccard, "_joined_groups", joined)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=4).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert sum(moved) > 5 * len(rows) and max(moved) <= 3 * len(rows)


def test_near_duplicates_leave_no_shuffle_files(spark, docs):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)

    def files():
        it = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        out = set()
        while it.hasNext():
            out.add(it.next().getName())
        return {x for x in out if x.startswith("shuffle_") and x.endswith(".data")}

    before = files()
    sets, groups = jaccard.near_duplicate_groups(docs)
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.5)
    assert not files() - before and spark.conf.get(key, None) == was
    assert sets.count() == sets.count() == docs.count()


def brute_line_runs(rows):
    """rows: (id, text), ids rising; what is left without the lines of pairs seen before."""
    seen, out = {}, {}
    for i, text in rows:
        lines = text.split("\n")
        full = [j for j, x in enumerate(lines) if x.strip()]
        gone = set()
        for a, b in zip(full, full[1:], strict=False):
            first = seen.setdefault("\n".join(lines[a : b + 1]), (i, b))
            if first[0] != i or first[1] < a:
                gone.update(range(a, b + 1))
        left = "".join(x + "\n" for j, x in enumerate(lines) if j not in gone)
        out[i] = left[:-1] if len(lines) - 1 not in gone else left
    return out


def test_spliced_lines_go_whole(spark):
    rng = random.Random(51)
    line = lambda: " ".join(words(rng, 8))
    rows = []
    for i in range(60):
        passage = [line() for _ in range(2 + i % 6)]
        rows += [(i, "\n".join([line(), *passage, line(), line()])), (100 + i, "\n".join([line(), line(), *passage, line()]))]
    rows += [(300, "\n".join(["a b c"] * 5)), (301, "x\n\ny z\n \nw\n"), (302, "q\nx\n\ny z\n \nw\nend"), (303, "one line"), (304, "one line"), (305, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_line_runs(sorted(rows))
    got = {r.doc_id: r for r in line_chunks.line_dedup_report(table, every_pair=True).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(got[i].n_removed == 0 and got[100 + i].n_spans == 1 and got[100 + i].text.count("\n") == 2 for i in range(60))
    assert all(r.n_removed == len(dict(rows)[i]) - len(r.text) for i, r in got.items()) and got[300].text == "a b c\na b c\n"


def plain_units(text, min_unit):
    """Units one word at a time, with the patterns of the operator's description."""
    cjk = substring._CJK
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    found = list(re.finditer(rf"[{cjk}](?<![\W_])|[^\W_{cjk}]+", low))

    def hashed(i):
        return xxhash.xxh3_64_intdigest(found[i].group()) if i < len(found) else 0

    def place(i):
        gap = text[found[i].end() : found[i + 1].start()] if i + 1 < len(found) else "\n"
        if "\n" in gap:
            return 0
        sentence = re.search(r"[.!?](?=\s|$)|[。．！？｡]", gap)
        kind = 1 if sentence else 2 if re.search(r"[,;:](?=\s|$)|[、，；：､]", gap) else 3
        both = (hashed(i) * 0x9E3779B97F4A7C15 + hashed(i + 1)) % 2**64
        return kind << 62 | int(common.mix(np.array([both], np.uint64))[0]) >> 2 | 1

    key, out, first = [place(i) for i in range(len(found))], [], 0
    for i, k in enumerate(key):
        near = [key[j] if 0 <= j < len(key) else 0 for d in range(1, min_unit) for j in (i - d, i + d)]
        if k == 0 or all(k < x for x in near[::2]) and all(k <= x for x in near[1::2]):
            out.append((i + 1 - first, xxhash.xxh3_128_digest(" ".join(m.group() for m in found[first : i + 1]))))
            first = i + 1
    return out


def test_units_by_arrays_equal_those_word_by_word(spark):
    rng = random.Random(5)
    signs = [*"abXY09 __..,,;:!?'-\n\n\t\r\x0b\x1c\x85　", "İ", "ß", "Σ", "Ⓐ", "é", "²", "١", "ﬁ", "ｦ", "々", "〆", "中", "あ", "。", "，", "\U00020001", "\U0001f600"]
    texts = ["".join(rng.choices(signs if i % 2 else [*signs[:22], " the ", " word"], k=rng.choice((0, 1, 3, 20, 90)))) for i in range(3000)]
    for i, text in enumerate(texts):
        least = (4, 1, 2, 7)[i % 4]
        found = substring.units(text, least)
        assert [u[2:] for u in found] == plain_units(text, least), (text, least)
        assert all(a < b for a, b, *_ in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
    # the pass that counts digests hands on nothing but their first halves
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:200])] + [(-1, None)], "doc_id long, text string")
    halves = substring._first_halves(table, "text", 4)
    assert halves.columns == ["d1"]
    want = [int.from_bytes(u[3][:8], "little", signed=True) for t in texts[:200] for u in substring.units(t)]
    assert sorted(r.d1 for r in halves.collect()) == sorted(want)
