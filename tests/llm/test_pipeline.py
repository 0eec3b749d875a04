"""The corpus pipeline, stage by stage, against brute force over whole texts."""

import collections

import numpy as np
import zstandard
from test_texts import SF, brute_components, brute_hits, brute_line_runs

import corpus_pipeline as P
from panelengine.llm import quality


def test_pipeline_against_brute_force(spark):
    """Every stage, and the packed pieces, against brute force over what the stage before left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    codec = zstandard.ZstdCompressor(level=quality.LEVEL)
    kept = {i: r.text for i, r in rows.items() if quality.measure((r.text or "").encode(), codec)[6]}
    deduped = brute_line_runs(sorted((i, t or "") for i, t in kept.items()))
    group = {i: c for i, _, c in brute_components(list(deduped.items()))}
    single = {i: t for i, t in deduped.items() if group[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i: t for i, t in single.items() if not brute_hits(t, items)[-1]}
    assert len(rows) > len(kept) > len(single) > len(clean) > 0 and any(deduped[i] != kept[i] for i in kept)

    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontaminate", "pack"]
    want = {"quality": kept, "line_dedup": deduped, "near_duplicates": single, "decontaminate": clean}
    now = docs
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, SF).checkpoint()
        assert now.columns == docs.columns
        got = now.collect()
        assert {r.doc_id: r.text or "" for r in got} == {i: t or "" for i, t in want[name].items()} and len(got) == len(want[name]), name
        assert all((r.lang, r.source) == (rows[r.doc_id].lang, rows[r.doc_id].source) for r in got)
        assert all(r.text is None or r.n_chars == (len(r.text) if name != "quality" else rows[r.doc_id].n_chars) for r in got)

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = P.STAGES[4][1](spark, now, SF).collect()
    total = collections.Counter()
    for p in pieces:
        total[p.doc_id] += p.length
    assert total == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in clean.items()}
    filled = collections.Counter()
    for p in pieces:
        filled[p.sequence_id] += p.length
    assert all(n & (n - 1) == 0 for n in filled.values()) and np.mean(list(filled.values())) > 100


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF).checkpoint()
        assert docs.count() == 0
