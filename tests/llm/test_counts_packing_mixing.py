"""Operators 1, 3, 4 and 9 against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from seekmill.llm import exact_dedup, mixing, packing, token_counts

from . import brute


def test_token_counts_stitch_documents_across_blocks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    enc = token_counts.encoder()
    want = {r.doc_id: len(enc.encode_ordinary(r.text)) for r in docs.collect()}
    for block in (64, 1000, 1 << 20):
        assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, block_tokens=block).collect()} == want


def test_token_counts_of_nasty_rows(spark):
    docs = brute.nasty(spark, "file ordinal ends")
    got = Counter((r.doc_id, r.n_tokens > 0) for r in token_counts.token_counts(docs, block_tokens=50).collect())
    assert got == Counter({(1, True): 2, (2, False): 1, (3, False): 1, (None, True): 1, (4, True): 1, (5, True): 1, (6, True): 1, (None, False): 1})
    assert token_counts.token_counts(docs.limit(0)).collect() == []


def test_ids_of_large_vocabularies_take_four_bytes(spark):
    """A separator above 65 535 must not be that number cut to two bytes, which is an ordinary token."""
    docs = brute.table(spark, [(i, "one two three four " * (i + 1), "s") for i in range(20)])
    enc = token_counts.encoder()
    some = enc.encode_ordinary("one two three")[0]
    assert token_counts.id_type() == "<u2" and token_counts.id_type(eod=(1 << 16) + some) == "<u4"
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, eod=(1 << 16) + some, block_tokens=37).collect()}
    assert got == {i: len(enc.encode_ordinary("one two three four " * (i + 1))) for i in range(20)}


def test_mixing_by_any_measure_of_tokens(spark):
    docs = brute.table(spark, [(i, "a b c", "big" if i < 8 else "small") for i in range(10)]).selectExpr("*", "CASE WHEN source = 'big' THEN 100 WHEN doc_id = 8 THEN 50 END AS n")
    rates = {r.source: (r.n_tokens, r.rate) for r in mixing.source_rates(docs, docs.n, alpha=0.5).collect()}
    assert rates == {"big": (800, 1.0), "small": (50, 4.0)}
    got = Counter(r.source for r in mixing.mix_sources(docs, alpha=0.5, tokens=docs.n).collect())
    assert got == {"big": 8, "small": 8}


def test_separator_text_is_ordinary(spark):
    docs = brute.table(spark, [(1, "a <|endoftext|> b", "s"), (2, "c", "s")])
    assert {r.doc_id for r in token_counts.token_counts(docs).collect()} == {1, 2}


@pytest.mark.parametrize("capacity", [7, 20, 64])
def test_packing_rule_is_sum_of_squares(capacity):
    rng = random.Random(capacity)
    sizes = [rng.randint(1, capacity) for _ in range(300)]
    assert packing.sum_of_squares(sizes, capacity)[0] == brute.sum_of_squares(sizes, capacity)


def test_packing_places_every_token_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for shard in (2_000, 1 << 30):
        rows = packing.pack(docs, capacity=512, shard_tokens=shard).toPandas()
        want = {r.doc_id: len(brute.WORD.findall(r.text)) for r in docs.collect()}
        assert rows.groupby("doc_id").n_tokens.sum().to_dict() == {k: v for k, v in want.items() if v}
        for _, b in rows.groupby("bin_id"):
            b = b.sort_values("bin_offset")
            assert (b.bin_offset.to_numpy() == np.concatenate([[0], np.cumsum(b.n_tokens)[:-1]])).all() and b.n_tokens.sum() <= 512
        for _, d in rows.groupby("doc_id"):
            assert sorted(d.start) == [512 * n for n in range(len(d))]


def test_packing_of_nasty_rows(spark):
    docs = brute.nasty(spark, "n shard piece bin_id")
    rows = packing.pack(docs, 1000).collect()
    tokens = Counter()
    for r in rows:
        tokens[r.doc_id] += r.n_tokens
    assert tokens == Counter({1: 26, None: 13, 4: 60_000, 6: 4})
    assert packing.pack(docs.limit(0)).collect() == []


def test_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = Counter(r.doc_id for r in mixing.mix_sources(docs).collect())
    want = brute.mix([(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert got == Counter(want)


def test_mixing_reaches_target_weights(spark):
    rows = [(n, "w " * 10, "big" if n % 10 else "small") for n in range(2000)]
    out = mixing.mix_sources(brute.table(spark, rows), weights={"big": 1, "small": 1}, budget=40_000)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 2000) < 100 and n["small"] == 2000


def test_mixing_of_nasty_rows(spark):
    docs = brute.nasty(spark, "copy _mix_rate _mix_n _mix_source")
    out = mixing.mix_sources(docs)
    assert out.columns == [*docs.columns, "_copy"]
    got = Counter((r.doc_id, r.source) for r in out.collect())
    assert got[4, "b"] == 1 and got[3, "b"] == 1 and got[1, "a"] >= 2 and got[None, None] >= 2
    assert out.filter("_mix_n <> 'x'").count() == 0
    assert mixing.mix_sources(docs.limit(0)).collect() == []
    assert mixing.mix_sources(docs, weights={"a": 1}).filter("source IS NULL OR source <> 'a'").collect() == []


def test_exact_dedup(spark):
    docs = brute.nasty(spark, "n_copies _win _digest")
    got = {(r.doc_id, r.n_copies) for r in exact_dedup.exact_dedup(docs, salts=2).collect()}
    assert got == {(1, 3), (2, 2), (3, 1), (4, 1), (5, 1), (6, 1)}
    kept = exact_dedup.exact_dedup(docs, extra=True)
    assert set(kept.columns) == set(docs.columns) and kept.count() == 6
    assert exact_dedup.exact_dedup(docs.limit(0)).collect() == []


def test_exact_dedup_survives_colliding_digests(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(7))
    docs = brute.table(spark, [(n, f"text {n % 5}", "s") for n in range(50)]).repartition(4)
    assert {(r.doc_id, r.n_copies) for r in exact_dedup.exact_dedup(docs).collect()} == {(n, 10) for n in range(5)}
