"""The whole pipeline against plain Python, stage by stage and from end to end."""

from collections import Counter

import corpus_pipeline as cp
from seekmill.llm import near_dedup, quality

from . import brute
from .test_near_quality_toxicity import _narrowly_alike, _without_a_band


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for name, stage in cp.STAGES[:-1]:
        assert [(c, t) for c, t in stage(spark, docs, sf_dir).dtypes] == docs.dtypes, name


def test_run_is_its_stages_in_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [(r.doc_id, r.text, r.source) for r in quality.score(docs, model).filter("keep").collect()]
    assert 0 < len(rows) < docs.count()
    texts = {i: t for i, t in brute.lines([(i, t) for i, t, _ in rows], 50).items() if t}
    gone = brute.near(sorted(texts.items()), near_dedup.THRESHOLD)
    left = [(i, texts[i], s) for i, _, s in rows if i in texts and i not in gone]
    copies = brute.mix(left)
    # one shard: documents in order of id and size, rests and whole documents by the rule
    pieces = []
    for i, t, _ in sorted(left):
        n = len(brute.WORD.findall(t))
        for _ in range(copies[i]):
            pieces += [(i, k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048))]
    bins = brute.sum_of_squares([size for _, _, size in pieces], 2048)
    want = Counter((i, k, size, b) for (i, k, size), b in zip(pieces, bins))
    got = Counter((r.doc_id, r.piece, r.n_tokens, r.bin_id) for r in cp.run(spark, sf_dir).collect())
    assert got == want


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.collect() == []


def test_documents_that_came_in_empty_stay(spark, sf_dir):
    run = " ".join(f"w{n}" for n in range(60))
    docs = brute.table(spark, [(1, run, "a"), (2, run, "a"), (3, "", "a"), (4, None, "a")])
    assert sorted(r.doc_id for r in cp.dedup_lines(spark, docs, sf_dir).collect()) == [1, 3, 4]


def test_run_over_nasty_rows(spark, sf_dir, tmp_path):
    """NULLs, repeats, empty and very long texts and columns of clashing names go through all stages; every word that stays is packed once a copy."""
    docs = brute.nasty(spark, "score keep th d band _mix_n")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (4, 1), (None, 1)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = cp.run(spark, str(tmp_path)).collect()
    packed = Counter()
    for r in out:
        packed[r.doc_id] += r.n_tokens
    # the row without an id comes first, so its copies under id 1 go; the long text is whole
    assert packed[4] % 60_000 == 0 and packed[4] > 0 and packed[None] > 0 and packed[1] == 0 and packed[2] == packed[3] == 0
    load = Counter()
    for r in out:
        load[r.bin_id] += r.n_tokens
    assert max(load.values()) <= 2048


def test_run_keeps_one_of_each_pair_of_a_wide_bucket(spark, tmp_path, monkeypatch):
    """Without labels and repeated lines near dedup alone drops documents; a pair whose only common band is a wide bucket is no exception."""
    monkeypatch.setattr(near_dedup, "SPLIT", 8)
    rows = _narrowly_alike()
    brute.table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    gone = brute.near([(i, t) for i, t, _ in rows], near_dedup.THRESHOLD)
    assert len(gone) == len(rows) // 2
    assert {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()} == {i for i, _, _ in rows} - set(gone)


def test_run_keeps_one_of_each_pair_without_a_common_band(spark, tmp_path):
    rows, _ = _without_a_band()
    brute.table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    gone = brute.near([(i, t) for i, t, _ in rows], near_dedup.THRESHOLD)
    assert len(gone) == len(rows) // 2
    assert {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()} == {i for i, _, _ in rows} - set(gone)
