"""Importance resampling, chat formatting and vector codes against brute force, and their edge
cases: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelengine.llm import chat, importance, vector_codes

SF = "/root/testdata/sf0.001"

# --- 11 importance resampling -------------------------------------------------------------


def brute_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]


def brute_resample(rows, target):
    """rows: (id, text); a multiset of (id, n_features, weight, score, rank)."""
    count = lambda texts: collections.Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in brute_features(t)[1])
    s, t = count(x for _, x in rows), count(target)
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + 10000) / ((s[b] + 1) * (tt + 10000)))) for b in range(10000)]
    out = []
    for i, text in rows:
        n, f = brute_features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % 10000] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, n, len(f), weight, score))
    best = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = 25 * len(best) // 100
    rank = collections.defaultdict(list)
    for k, x in enumerate(best):
        rank[x].append(k + 1 if k < drawn else None)
    return collections.Counter((x[0], *x[2:], rank[x].pop(0) if x[1] >= 20 else None) for x in out)


def as_counter(df):
    return collections.Counter(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("ab cD éf 1x Żz".split()) for _ in range(n))
    same = text(30)
    rows = [(1, None), (None, text(25)), (None, None), (2, ""), (3, "\t -"), (4, same), (4, same), (-5, same), (2**62, text(40)), (-(2**63), text(19)), (7, text(200_000))]
    rows += [(10 + i, text(20 + i % 7)) for i in range(60)]
    names = ["weight", "score", "rank", "at", "chunk", "digit", "id", "_m_", "n_words"]
    return spark.createDataFrame([(i, t, *["x"] * len(names)) for i, t in rows], "doc_id long, text string" + "".join(f", {n} string" for n in names))


def test_resample_against_brute_force(spark, odd, monkeypatch):
    monkeypatch.setattr(importance, "CHUNK", 16)
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    target = [r.text for r in bench.collect()]
    for table in (docs, odd):
        want = brute_resample([(r.doc_id, r.text) for r in table.collect()], target)
        assert as_counter(importance.resample(table, bench)) == want
    assert sum(1 for x in want if x[-1]) > 10


def test_resample_of_nothing(spark, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert importance.resample(odd.limit(0), bench).count() == 0
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert as_counter(importance.resample(odd, bench.limit(0))) == brute_resample(rows, [])
    with pytest.raises(TypeError):
        importance.resample(odd.withColumn("doc_id", F.lit("x")), bench)


def test_word_blocks_are_whole(monkeypatch):
    text = ("ab, cd" * 50 + " " + "long" * 40 + " é ").encode() * 3
    want = importance.words_of(text)
    whole = [b.tolist() for _, b in importance.feature_buckets(text)]
    for size in (1, 7, 64, 4096):
        monkeypatch.setattr(importance, "BLOCK_BYTES", size)
        assert [w for block in importance.word_blocks(text) for w in block] == want
        found = list(importance.feature_buckets(text))
        assert sorted(x for _, b in found for x in b.tolist()) == sorted(whole[0]) and sum(n for n, _ in found) == len(want)


@pytest.mark.parametrize("hot", [False, True])
def test_radix_positions(spark, monkeypatch, hot):
    """Several keys, digits that differ high and low only, one value that most rows have."""
    monkeypatch.setattr(importance, "CHUNK", 32)
    rng = random.Random(4)
    pick = (lambda: 5 if rng.random() < 0.8 else rng.getrandbits(40)) if hot else (lambda: rng.choice([rng.getrandbits(63), rng.randrange(4) << 20, -rng.randrange(1, 9)]))
    rows = [(i, pick(), rng.randrange(3)) for i in range(500)]
    got = importance.radix_positions(spark.createDataFrame(rows, "i long, a long, b long").repartition(7), ["b", "a"], "at_last").collect()
    assert sorted(r.at_last for r in got) == list(range(500))
    order = [(r.b, r.a & (2**64 - 1)) for r in sorted(got, key=lambda r: r.at_last)]
    assert order == sorted((b, a & (2**64 - 1)) for _, a, b in rows)


# --- 12 chat formatting -------------------------------------------------------------------

SAID = ["</s>[INST] ok [/INST]", "<\\s> <\\\\s> <|im_end|><<SYS>><</SYS>> <|im<|im_sep|>", "", "x<\\", "<", "[", "\\", "<|im_end|>", "é\n\n<|im_start|>user<|im_sep|>", "<" * 9 + "s>", "[\\INST][\\\\/INST]"]


def test_escapes_come_back(spark):
    rng = random.Random(8)
    made = ["".join(rng.choice(["<", "\\", "s>", "/s>", "[", "INST]", "|im_end|>", "<SYS>>", "</SYS>>", "a", "|im_sep|>", "\n"]) for _ in range(rng.randrange(12))) for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in [*SAID, *made]], "t string").withColumn("e", chat.escaped(F.col("t"))).withColumn("u", chat.unescaped(F.col("e"))).collect()
    for r in rows:
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROLS)
        assert r.e == r.t or any(re.search(re.escape(c[0]) + r"\\*" + re.escape(c[1:]), r.t) for c in chat.CONTROLS)


def brute_chats(rows):
    """conv_id -> n_turns, turns digest, loss characters, loss digest; rows: (id, turn, role, text)."""
    by = collections.defaultdict(list)
    for i, turn, role, text in rows:
        by[i].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for i, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[i] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def report(rows):
    return {r.conv_id: tuple(r)[1:5] for r in chat.chat_report(chat.format_chats(chat.records_of(rows)), "conv_id").collect()}


def test_chats_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    roles = ["user", "assistant", "system", "tool", None, "hu<|im_sep|>man", "human", "gpt", ""]
    rng = random.Random(9)
    rows = [(-1, 0, "user", SAID[0]), (-1, 1, "assistant", SAID[0]), (None, None, None, None), (None, 3, "user", "a"), (-2, 0, "assistant", "word " * 400_000)]
    rows += [(-3, 1, "user", "same"), (-3, 1, "user", "same"), (-3, None, "assistant", "same"), (-4, 0, "system", "s"), (-4, 1, "user", "u"), (-4, 2, "assistant", None)]
    rows += [(-100 - c, k, rng.choice(roles), rng.choice([*SAID, None])) for c in range(40) for k in range(rng.randrange(1, 7))]
    extra = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    both = table.union(extra).select("*", *[F.lit("x").alias(n) for n in ("id", "prompt", "messages", "segments", "layout", "all", "shape")])
    assert report(both) == brute_chats([tuple(r)[:4] for r in both.collect()])
    assert report(both.limit(0)) == {}
    used = {r.layout for r in chat.fingerprint_counts(chat.canonical(chat.records_of(both))).collect()}
    assert used == {"prompt", "instruction", "shared", "rows"}


def test_every_layout(spark):
    """One schema with the columns of all layouts: the fingerprint chooses, not the schema."""
    schema = """id long, system string, prompt string, response string, completion string, instruction string, input string, output string,
        question string, answer string, messages array<struct<role:string,content:string,weight:int>>, conversations array<struct<from:string,value:string>>,
        turns array<struct<turn:long,role:string,text:string>>, layout string, note struct<prompt:string>"""
    empty = dict.fromkeys("system prompt response completion instruction input output question answer messages conversations turns layout note".split())
    cases = [
        (dict(prompt="p", response="r"), "prompt", [("user", "p"), ("assistant", "r")]),
        (dict(system="s", prompt="p", completion=""), "completion", [("system", "s"), ("user", "p"), ("assistant", "")]),
        (dict(instruction="i", output="o", layout="x"), "instruction", [("user", "i"), ("assistant", "o")]),
        (dict(instruction="i", input="n", output="o"), "instruction", [("user", "i\n\nn"), ("assistant", "o")]),
        (dict(question="q", answer="a"), "question", [("user", "q"), ("assistant", "a")]),
        (dict(messages=[("user", "m", 3), (None, None, None)]), "messages", [("user", "m"), ("", "")]),
        (dict(messages=[]), "messages", []),
        (dict(conversations=[("human", "h"), ("gpt", "g"), ("tool", "t")]), "shared", [("user", "h"), ("assistant", "g"), ("tool", "t")]),
        (dict(turns=[(2, "b", "y"), (1, "a", "x")]), "rows", [("a", "x"), ("b", "y")]),
        (dict(prompt="p"), None, None),
        (dict(prompt="p", response="r", messages=[("user", "m", 1)]), None, None),
        (dict(note=("p",)), None, None),
    ]
    rows = [(i, *{**empty, **case}.values()) for i, (case, _, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, schema)
    got = {r.id: r for r in chat.canonical(df).collect()}
    for i, (_, name, turns) in enumerate(cases):
        assert got[i].layout == name and (got[i].turns if turns is None else [tuple(t) for t in got[i].turns]) == turns, i
    assert [r for r in got.values() if r.layout == "messages"][0].fingerprint != [r for r in got.values() if r.layout == "rows"][0].fingerprint
    few = chat.canonical(df.select("id", "prompt", "response"))
    assert [r.layout for r in few.orderBy("id").collect()] == [n if n == "prompt" and i == 0 else ("prompt" if i == 10 else None) for i, (_, n, _) in enumerate(cases)]
    read = {r.id: r for r in chat.chat_report(chat.format_chats(df), "id").collect()}
    assert read[0].n_turns == 2 and read[0].loss_chars == 1 and read[6].n_turns == 0 and read[6].formatted_chars == 0
    assert read[9].n_turns is None and read[9].turns_sha256 is None


def test_chat_plan_is_native(spark):
    from panelengine.llm import queries

    plan = queries.op12_chat_format(spark, SF)._jdf.queryExecution().toString()
    plan += chat.format_chats(chat.records_of(spark.read.parquet(f"{SF}/conversations.parquet")))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD|MapPartitions", plan)


# --- 13 vector codes ----------------------------------------------------------------------


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (id, vector, label) -> multiset of (id, code, error, label error), digest."""
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**40 else int(x) * 1024 for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    size = len(kept[0][1]) // parts
    cut = lambda v: [v[p * size : (p + 1) * size] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, part: min((square(part, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, v, _ in kept:
            for p, part in enumerate(cut(v)):
                members[p, nearest(p, part)[1]].append(part)
        for (p, k), m in members.items():
            books[p][k] = [sum(c) // len(m) for c in zip(*m, strict=True)]
    found = []
    for i, v, y in kept:
        best = [nearest(p, part) for p, part in enumerate(cut(v))]
        found.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), y))
    label = collections.Counter()
    for *_, d, y in found:
        label[y] += d
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return collections.Counter((i, c, d, label[y]) for i, c, d, y in found), digest


def coded(df, **options):
    got = vector_codes.encode(df, **options).collect()
    return collections.Counter((r.vec_id, r.code, r.error, r.label_error) for r in got), {r.codebooks_sha256 for r in got}


def test_codes_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want, digest = brute_codes([(r.vec_id, r.embedding, r.label) for r in table.collect()], entries=24)
    assert coded(table, entries=24) == (want, {digest})


def test_codes_of_odd_rows(spark):
    rng = random.Random(5)
    vector = lambda: [rng.choice([-1.5, 0.0, 0.25, 3.0, rng.random()]) for _ in range(12)]
    same = vector()
    rows = [(1, None, 1), (2, [1.0, None] * 6, 1), (3, [float("nan")] * 12, 2), (4, [float("inf"), *[0.0] * 11], 2), (5, [-float("inf"), *[0.0] * 11], None), (None, vector(), None), (None, vector(), 1)]
    rows += [(7, same, 2), (7, same, 2), (7, vector(), None), (-(2**40), same, 1), (8, [-0.0004] * 12, 2), (9, [0.0] * 12, 2)]
    rows += [(100 + i, vector(), rng.choice([1, 1, 1, 2, None])) for i in range(150)]
    names = ["vector", "code", "error", "of", "cell"]
    df = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], "vec_id long, embedding array<double>, label int" + "".join(f", {n} string" for n in names)).repartition(5)
    for entries in (7, 256):
        want, digest = brute_codes(rows, entries=entries)
        assert coded(df, entries=entries) == (want, {digest})
    assert vector_codes.encode(df.limit(0)).count() == 0
    assert {r.code for r in vector_codes.encode(spark.createDataFrame([(1, [], 1)], "vec_id long, embedding array<double>, label int")).collect()} == {"00000000"}
    for bad in ([1.0] * 6, [1.0] * 16):
        with pytest.raises(Exception, match="components"):
            vector_codes.encode(spark.createDataFrame([(1, [0.0] * (6 if len(bad) == 6 else 12), 1), (2, bad, 1)], "vec_id long, embedding array<double>, label int")).count()


def test_large_components_stay_exact(spark):
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate([[2**20, 1, -(2**20), 0], [2**20 + 1, 1, 5, 0.5], [3, 2, 1, 0], [2**20 - 1, 0, -(2**20), 2]])]
    want, digest = brute_codes(rows, entries=2)
    assert coded(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), entries=2) == (want, {digest})


def test_elimination_is_exact_and_early():
    """Equal to all whole distances, ties to the lower entry, without comparing all coefficients."""
    rng = np.random.default_rng(2)
    for width in (1, 2, 3, 16, 20):
        entries = rng.integers(-4, 5, (60, width))
        parts = np.concatenate([rng.integers(-4, 5, (700, width)), entries[rng.integers(0, 60, 300)]])
        book = vector_codes.Codebook(entries)
        code, error = book.nearest(parts)
        all_ = ((parts[:, None] - entries[None]) ** 2).sum(2)
        assert (code == all_.argmin(1)).all() and (error == all_.min(1)).all()
    smooth = np.cumsum(rng.integers(-9, 10, (800, 16)), 1) + rng.integers(-200, 200, (800, 1))
    book = vector_codes.Codebook(smooth[:64])
    assert (book.nearest(smooth)[1] == ((smooth[:, None] - smooth[None, :64]) ** 2).sum(2).min(1)).all()
    assert book.compared < 0.5 * len(smooth) * 64 * 16


def test_walsh_rows_by_sign_changes():
    for n in (1, 2, 8, 32):
        rows = vector_codes.walsh(np.eye(n, dtype=np.int64)).T
        assert [int((r[1:] != r[:-1]).sum()) for r in rows] == list(range(n))
        x = np.arange(n * 3).reshape(3, n)
        assert ((vector_codes.walsh(x) ** 2).sum(1) == n * (x**2).sum(1)).all()
