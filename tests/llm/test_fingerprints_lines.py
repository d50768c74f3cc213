"""Operators 5 and 8 against plain Python."""

import random

from seekmill.llm import fingerprints as fp
from seekmill.llm import line_dedup

from . import brute


def _words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))


def test_chunks_are_those_of_a_rolling_hash():
    rng = random.Random(1)
    texts = [_words(rng, n).encode() for n in (0, 1, 5, 50, 3000)] + [b"a" * 5000]
    owner, _, lengths = fp.chunks_of(texts)
    for i, t in enumerate(texts):
        ends = brute.cuts(t, fp._GEAR.tolist(), fp.STRICT_BITS, fp.LOOSE_BITS, fp.MIN_BYTES, fp.NORMAL_BYTES, fp.MAX_BYTES)
        mine = lengths[owner == i].cumsum().tolist()
        assert mine == ends


def test_chunking_doesnt_depend_on_the_neighbours(spark):
    rng = random.Random(2)
    a, b = _words(rng, 2000), _words(rng, 100)
    alone = spark.createDataFrame([(1, a)], "doc_id bigint, text string")
    among = spark.createDataFrame([(0, b), (1, a), (2, b)], "doc_id bigint, text string").coalesce(1)
    f = lambda d: {r.digest for r in fp.chunk_digests(d).filter("doc_id = 1").collect()}
    assert f(alone) == f(among)


def test_an_insertion_changes_few_chunks(spark):
    rng = random.Random(3)
    a = _words(rng, 4000)
    docs = spark.createDataFrame([(1, a), (2, a[:9000] + "NEW WORDS " + a[9000:])], "doc_id bigint, text string")
    d = fp.chunk_digests(docs)
    got = fp.containment_pairs(d.filter("doc_id = 1"), d.filter("doc_id = 2"), 0.5).collect()
    assert len(got) == 1 and got[0].containment > 0.9


def test_registered_pairs_are_those_of_first_documents(spark, sf_dir):
    from seekmill.llm.queries import QUERIES

    chunks, first = {}, {}
    for r in fp.chunk_digests(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect():
        chunks.setdefault(r.doc_id, {})[r.digest] = r.weight
    want = {}
    for i in sorted(chunks):
        f = first.setdefault(frozenset(chunks[i]), i)
        if f != i:
            want[i, f] = 1.0
    for i in first.values():
        for j in first.values():
            share = sum(w for d, w in chunks[i].items() if d in chunks[j]) / sum(chunks[i].values())
            if i != j and share >= 0.5:
                want[i, j] = share
    got = {(r.doc_id, r.other_id): r.containment for r in QUERIES["op5_containment_pairs"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want) and 1.0 in want.values()


def test_containment_is_that_of_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chunks = {}
    for r in fp.chunk_digests(docs).collect():
        chunks.setdefault(r.doc_id, {})[r.digest] = r.weight
    got = {r.doc_id: r for r in fp.corpus_containment(docs).collect()}
    assert got.keys() == chunks.keys()
    for i, c in chunks.items():
        others = {d for j, o in chunks.items() if j != i for d in o}
        before = {d for j, o in chunks.items() if j < i for d in o}
        total = sum(c.values())
        assert got[i].n_bytes == total and got[i].n_chunks == len(c)
        assert abs(got[i].shared - sum(w for d, w in c.items() if d in others) / total) < 1e-6
        assert abs(got[i].earlier - sum(w for d, w in c.items() if d in before) / total) < 1e-6
    d = fp.chunk_digests(docs)
    pairs = {(r.left_id, r.right_id) for r in fp.containment_pairs(d, d, 0.5).collect()}
    want = {(i, j) for i, a in chunks.items() for j, b in chunks.items() if 2 * sum(w for x, w in a.items() if x in b) >= sum(a.values())}
    assert pairs == want


def test_fingerprints_of_nasty_rows(spark):
    docs = brute.nasty(spark, "digest weight holders first")
    got = {r.doc_id: (r.shared, r.earlier) for r in fp.corpus_containment(docs).collect()}
    assert got[1] == (1.0, 1.0) and got[None] == (1.0, 0.0) and got[4] == (0.0, 0.0) and set(got) == {1, None, 4, 5, 6}
    assert fp.corpus_containment(docs.limit(0)).collect() == []


def test_line_dedup_is_that_of_all_runs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()}
    assert got == brute.lines([(r.doc_id, r.text) for r in docs.collect()], 50)


def test_line_dedup_of_random_lines(spark):
    rng = random.Random(4)
    rows = [(n, "\n".join(rng.choice(["a", "b", "c d", "", "e f g"]) for _ in range(rng.randint(1, 14))), "s") for n in range(40)]
    for least in (1, 4, 9):
        got = {r.doc_id: r.text for r in line_dedup.line_dedup(brute.table(spark, rows), min_words=least).collect()}
        assert got == brute.lines([(i, t) for i, t, _ in rows], least)


def test_blank_lines_make_no_run_long(spark):
    rows = [(1, "\n" * 300, "s"), (2, "\n" * 200, "s"), (3, "a b\n" + "\n" * 90 + "c d", "s"), (4, "x\na b\n" + "\n" * 90 + "c d\ny", "s")]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(brute.table(spark, rows), min_words=4).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: "x\ny"} == brute.lines([(i, t) for i, t, _ in rows], 4)
    assert line_dedup.needed(line_dedup.np.zeros(60, int), 50).max() == -1


def test_runs_are_the_maximal_ones_whatever_their_length(spark):
    """Thousands of lines copied into others' midst: one run each, led by the first copy."""
    body = [f"line {n % 700} of {n % 3}" for n in range(2500)]
    rows = [(1, "\n".join(body), "s"), (2, "\n".join(["start", *body, "end"]), "s"), (3, "\n".join(["other", *body[100:1900]]), "s")]
    got = {(r.doc_id, r.first, r.length) for r in line_dedup.repeated_runs(brute.table(spark, rows)).collect()}
    assert {(2, 1, 2500), (3, 1, 1800)} <= got and all(d == 1 for d, *_ in got - {(2, 1, 2500), (3, 1, 1800)})
    left = {r.doc_id: r.text for r in line_dedup.line_dedup(brute.table(spark, rows)).collect()}
    assert left[2] == "start\nend" and left[3] == "other"


def test_line_dedup_of_nasty_rows(spark):
    docs = brute.nasty(spark, "th i h d need lead _ld_id _ld_known n_lines n_deleted")
    out = line_dedup.line_dedup(docs, min_words=5, counts=True)
    assert out.columns == [*docs.columns, "_n_lines", "_n_deleted"]
    rows = {(r.doc_id, r.text is None): r for r in out.collect()}
    assert out.count() == docs.count()
    # the row without an id comes first and stays; its copies lose their lines
    assert rows[None, False].text.startswith("One plain") and rows[1, False].text.strip() == "" and rows[2, True].text is None and rows[3, False].text == ""
    assert len(rows[4, False].text) > 300_000 and line_dedup.line_dedup(docs.limit(0)).collect() == []
