"""Operators on small tables: properties, brute force and states."""

import random
import re

import pytest
from pyspark.sql import functions as F

from seekmill.config import Config
from seekmill.operators import chunking, clustering, crawl, dedup, lexical, retrieval, routing, vector
from seekmill.plans.engine import Engine
from seekmill.sources import files, store as S, wiki
from seekmill.streaming import ingest


def test_sections():
    text = "intro\n# A\none\n### B\ntwo\n## C\nthree\n####### no\n#"
    assert chunking.sections_of(text) == [([], "intro"), (["A"], "one"), (["A", "B"], "two"), (["A", "C"], "three\n####### no\n#")]
    assert chunking.sections_of("  ") == [] and chunking.sections_of("# only") == [([], "# only")]


def test_sentences_are_lossless():
    text = "One. Two!  Three?\nFour\n\n\nFive 3.5 six"
    assert "".join(chunking.sentences_of(text)) == text
    assert chunking.sentences_of(text) == ["One. ", "Two!  ", "Three?", "\n", "Four\n\n\n", "Five 3.5 six"]


def test_chunks_cover_the_text_and_overlap():
    rng = random.Random(1)
    text = " ".join(f"Sentence {n} has {' '.join('w' * rng.randint(1, 9) for _ in range(rng.randint(3, 30)))}." for n in range(200))
    plain = chunking.split_section(text, chunking.ChunkConfig(100, 0.0, 0), chunking.heuristic_count)
    assert " ".join(c for c, _, _ in plain) == text and all(n <= 110 for _, n, _ in plain)
    lapped = chunking.split_section(text, chunking.ChunkConfig(100, 0.3, 0), chunking.heuristic_count)
    assert len(lapped) > len(plain)
    for a, b in zip(lapped, lapped[1:]):
        last = chunking.sentences_of(a[0])[-1]
        assert b[0].startswith(last) or last in b[0] or chunking.heuristic_count(last) > 30  # sentences over the allowance don't overlap


def test_chunk_rows(spark):
    docs = spark.createDataFrame([("d", "# A\n" + "Word one two. " * 200, "t"), ("e", None, "u"), ("f", "tiny", "v")], "id string, content string, title string")
    rows = chunking.chunk_documents(docs, keep=("title",)).orderBy("document_id", "ordinal").collect()
    d = [r for r in rows if r.document_id == "d"]
    assert [r.chunk_id for r in d] == [f"d_{n}" for n in range(len(d))] and len(d) > 1
    assert d[0].preceding_chunk_id is None and d[0].following_chunk_id == "d_1" and d[-1].following_chunk_id is None and all(r.title == "t" and r.section_hierarchy == ["A"] for r in d)
    assert [r.content for r in rows if r.document_id == "f"] == ["tiny"] and not [r for r in rows if r.document_id == "e"]


@pytest.mark.parametrize("threshold", [0, 3, 7, 9])
def test_near_pairs_are_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    sims = [rng.getrandbits(64) for _ in range(60)]
    for s in sims[:40]:
        for _ in range(3):
            x = s
            for _ in range(rng.randint(1, 10)):
                x ^= 1 << rng.randrange(64)
            sims.append(x)
    signed = sorted({s - (1 << 64) if s >> 63 else s for s in sims})
    got = {(r.a, r.b) for r in dedup.near_pairs(spark.createDataFrame([(s,) for s in signed], "simhash bigint"), threshold).collect()}
    assert got == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= threshold}


@pytest.mark.parametrize(("threshold", "batch"), [(7, 10000), (8, 5), (10, 64), (12, 3)])
def test_pairs_of_crowded_keys_are_all_pairs(spark, threshold, batch):
    """Keys on which hundreds of hashes agree, over several batches; by bands, pairs that share a band."""
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(3)]
    sims = {rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(250)} | {rng.getrandbits(64) & 0xFFFF for _ in range(60)}
    signed = sorted(s - (1 << 64) if s >> 63 else s for s in sims)
    differ = {(a, b): (a ^ b) & (2**64 - 1) for i, a in enumerate(signed) for b in signed[i + 1 :]}
    near = {(*p, x.bit_count()) for p, x in differ.items() if x.bit_count() <= threshold}
    banded = {(*p, x.bit_count()) for p, x in differ.items() if x.bit_count() <= threshold and any(not x >> 8 * n & 255 for n in range(8))}
    assert len(near) > 500 and (threshold < 8 or banded < near)
    nodes = spark.createDataFrame([(s,) for s in signed], "simhash bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for found, want in ((dedup.near_pairs(nodes, threshold), near), (dedup.banded_pairs(nodes, threshold), banded)):
            rows = [tuple(r) for r in found.collect()]
            assert len(rows) == len(set(rows)) and set(rows) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("threshold", [3, 5, 7, 10])
def test_near_pairs_broadcast_no_keys(spark, threshold):
    """The hashes' file is small, the rows of their keys are up to 66 times as many."""
    nodes = spark.range(1000).select(F.xxhash64("id").alias("simhash"))
    for pairs in (dedup.near_pairs(nodes, threshold), dedup.banded_pairs(nodes, threshold)):
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_process_is_the_sequential_rule(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = dedup.with_identity(docs).select("doc_id", "text", "content_hash", "simhash").orderBy("doc_id").collect()
    for threshold in (3, 10):
        entries, want = [], {}
        for r in rows:
            if len(r.text.encode()) < 100:
                want[r.doc_id] = "skipped"
                continue
            near = [(((r.simhash ^ e["sim"]) & (2**64 - 1)).bit_count(), e["id"], e) for e in entries]
            near = sorted((d, i) + (e,) for d, i, e in near if d <= threshold) if near else []
            if not near:
                entries.append({"sim": r.simhash, "id": r.doc_id, "hash": r.content_hash})
                want[r.doc_id] = "indexed"
            else:
                e = min(near, key=lambda x: x[:2])[2]
                want[r.doc_id] = "metadata_updated" if e["hash"] == r.content_hash else "content_updated"
                e["hash"] = r.content_hash
        got = {r.doc_id: r.status for r in dedup.process(docs, threshold).collect()}
        assert got == want


def test_registry(spark):
    schema = "content_id string, title string, source_type string, urls array<string>, chunk_ids array<string>, source_ids map<string,string>"
    old = spark.createDataFrame([("a", "t", "web", ["u1"], ["c1"], {"k": "1"}), ("b", "t", "web", [], [], {})], schema)
    new = spark.createDataFrame([("a", "n", "web", ["u2", "u1"], ["c2"], {"k": "2", "j": "3"})], schema)
    r = {x.content_id: x for x in dedup.register(old, new).collect()}
    assert r["a"].title == "n" and r["a"].urls == ["u1", "u2"] and r["a"].chunk_ids == ["c1", "c2"] and r["a"].source_ids == {"k": "2", "j": "3"}
    assert dedup.unregister(old, new.select("content_id")).count() == 1


def test_query_syntax():
    q = lexical.parse_query('+must -not "a phrase" OR title:free NOT other AND ((')
    assert q.must == ["must"] and q.must_not == ["not", "other"] and q.phrases == [["a", "phrase"]] and q.should == ["free"]
    assert lexical.parse_query("").scoring == [] and lexical.parse_query('"').scoring == []


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([("a", "common rare"), ("b", "common common"), ("c", ""), ("d", "common " * 30)], "chunk_id string, content string")
    index = lexical.build_index(docs)
    assert [r.chunk_id for r in lexical.bm25_search(index, "common rare").collect()][0] == "a"
    assert lexical.bm25_search(index, "missing").collect() == [] and lexical.bm25_search(index, "").collect() == []


def test_fusion(spark):
    rows = [("a", 1, 9.0, "x"), ("b", 2, 8.0, "x"), ("b", 1, 7.0, "y")]
    r = {x.chunk_id: x for x in retrieval.rrf(spark.createDataFrame(rows, "chunk_id string, rank int, original_score double, method string")).collect()}
    assert r["b"].score > r["a"].score and r["b"].methods == ["x", "y"] and r["b"].ranks == {"x": 2, "y": 1} and all(0 <= x.score <= 1 for x in r.values())
    same = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "chunk_id string, score double")
    assert {x.score for x in retrieval.minmax(same).collect()} == {1.0}


def test_embedding_errors(spark):
    import numpy as np

    v = spark.createDataFrame([("a", [1.0, 0.0])], "chunk_id string, embedding array<float>")
    with pytest.raises(Exception, match="dimensions"):
        vector.vector_search(v, [1.0, 0.0, 0.0]).collect()
    with pytest.raises(Exception, match="the embedder gave"):
        vector.embed(v.select("chunk_id"), lambda ts: np.ones((len(ts) + 1, 2)), "chunk_id").collect()
    sig = vector.lsh_signature(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [-1.0, -2.0]), (4, [1.0])], "id int, embedding array<float>"), 2)
    s = {r.id: r.signature for r in sig.collect()}
    assert s[1] == s[2] and s[4] == [0, 0] and all((a ^ b) == -1 for a, b in zip(s[1], s[3]))


def test_bloom_has_no_false_negatives():
    b = routing.Bloom.sized(1000)
    for n in range(1000):
        b.add(str(n).encode())
    again = routing.Bloom.from_bytes(b.to_bytes())
    assert all(str(n).encode() in again for n in range(1000))
    assert sum(f"x{n}".encode() in again for n in range(2000)) < 80 and again.n == 1000


def test_ring_moves_few_domains(spark):
    hosts = spark.createDataFrame([(f"h{n}.example",) for n in range(400)], "host string")
    peers = [(f"p{n}",) for n in range(5)]
    at = lambda ps: {r.host: r.peer for r in routing.assign_domains(hosts, routing.ring(spark.createDataFrame(ps, "peer string"))).collect()}
    all_, fewer = at(peers), at(peers[:4])
    assert set(all_.values()) == {p for (p,) in peers} and all(fewer[h] == p for h, p in all_.items() if p != "p4")
    assert set(routing.assign_domains(hosts, routing.ring(spark.createDataFrame([], "peer string"))).toPandas().peer) == {None}


def test_quality_of_empty_answers(spark):
    none = spark.createDataFrame([], "chunk_id string, node_id int, score double")
    c = spark.createDataFrame([(1, 0.9), (2, 0.5)], "node_id int, similarity double")
    r = routing.widen(routing.quality(none, c, c.limit(0).select("node_id"))).first()
    assert r.confidence == 0 and r.coverage == 0 and r.widen


def test_kmeans_finds_clusters(spark):
    rng = random.Random(3)
    rows = [(n, [float(n % 3 == k) + rng.random() / 20 for k in range(3)]) for n in range(90)]
    v = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    assigned, centers = clustering.kmeans(v, 3)
    groups = assigned.withColumn("true", F.col("vec_id") % 3).groupBy("cluster").agg(F.count_distinct("true").alias("n")).collect()
    assert len(groups) == 3 and all(g.n == 1 for g in groups) and centers.count() == 3
    assert clustering.kmeans(v.limit(1), 5)[0].collect()[0].cluster == 0 and clustering.kmeans(v.limit(0), 5)[0].collect() == []


def test_labels(spark):
    c = spark.createDataFrame([(0, "The Quantum Computer", "https://a.org/x"), (0, "quantum computer theory", "https://a.org/y"), (1, None, "https://b.org/z"), (2, None, None)], "cluster int, title string, url string")
    assert {r.cluster: r.label for r in clustering.labels(c).collect()} == {0: "Computer Quantum", 1: "b.org", 2: "Uncategorized"}


def test_crawl_stops(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "url string, target string")
    got = {r.url: r.depth for r in crawl.crawl(spark.createDataFrame([("a",)], "url string"), links, 2, S.Scratch(spark, "crawl")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_wiki_dump(spark, tmp_path):
    import bz2

    page = lambda i, ns, body, extra="": f"<page><title>Page {i}</title><ns>{ns}</ns><id>{i}</id>{extra}<revision><id>9{i}</id><timestamp>2024-01-02T03:04:05Z</timestamp><text xml:space=\"preserve\">{body}</text></revision></page>"
    long = "'''Words''' of [[Link|a link]] here. " * 8
    xml = "<mediawiki>" + page(1, 0, long) + page(2, 4, long) + page(3, 0, "short") + page(4, 0, long, '<redirect title="x"/>') + "</mediawiki>"
    (tmp_path / "dewiki-x.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    pages = wiki.read_pages(spark, str(tmp_path / "dewiki-x.xml.bz2"))
    docs = wiki.page_documents(pages).collect()
    assert [d.id for d in docs] == ["1"] and docs[0].url == "https://de.wikipedia.org/wiki/Page_1" and docs[0].content.startswith("Words of a link here.") and str(docs[0].modified) == "2024-01-02 03:04:05"
    assert wiki.page_documents(pages, None).count() == 2
    assert files.read_dump(spark, str(tmp_path / "dewiki-x.xml.bz2")).count() == 1
    with pytest.raises(NotImplementedError):
        files.read_dump(spark, "x.zim")


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# Title\nbody")
    (tmp_path / "sub/b.txt").write_text("A line of some length\nmore")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "d.bin").write_text("no")
    assert {r.title for r in files.read_files(spark, str(tmp_path)).collect()} == {"Title", "A line of some length"}
    assert files.read_files(spark, str(tmp_path), concat=True).first().content == "# Title\nbody\n\nA line of some length\nmore"


def test_fetch_keeps_failures(spark):
    def fetcher(url):
        if "bad" in url:
            raise OSError("down")
        return 200, url, "text/html; charset=utf-8" if "page" in url else "image/png", "<p>x</p>"

    got = {r.url: (r.status, r.body) for r in files.fetch(spark.createDataFrame([("page",), ("pic",), ("bad",)], "url string"), fetcher).collect()}
    assert got == {"page": (200, "<p>x</p>"), "pic": (200, None), "bad": (0, None)}


def test_store_commits(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = S.Store(spark, path, "create")
    chunk = lambda *rows: spark.createDataFrame([(i, "d", c) for i, c in rows], "chunk_id string, document_id string, content string")
    now = lambda: {r.chunk_id: r.content for r in S.Store(spark, path, "read").read("chunks").collect()}
    assert now() == {}
    ingest.write_chunks(store, chunk(("a", "one"), ("b", "two"), ("", "no id"), ("x", "  ")))
    ingest.write_chunks(store, chunk(("b", "new"), ("c", "three")))
    assert now() == {"a": "one", "b": "new", "c": "three"}
    ingest.write_chunks(store, chunk(("b", "new"), ("c", "three")))  # a repeated batch
    assert now() == {"a": "one", "b": "new", "c": "three"} and store.read("postings").count() == 3
    store.commit(dead=chunk(("a", "")))
    assert now() == {"b": "new", "c": "three"}
    store.compact()
    assert now() == {"b": "new", "c": "three"} and store.read("lengths").count() == 2
    with pytest.raises(PermissionError):
        S.Store(spark, path, "read").append("chunks", chunk(("z", "z")))
    with pytest.raises(ValueError):
        S.export(store.read("chunks"), path + "-x", "csv")


def test_engine(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/engine", Config.from_toml("[chunking]\nmin_size = 1\n"), "create")
    text = {"a": "Rust engines and search indexes store postings in segments.", "b": "Cooking pasta needs water, salt and patience, and a large pot.", "c": "Rust engines and search indexes store postings in segments."}
    docs = spark.createDataFrame([(i, t * 2, f"https://e.org/{i}", {"lang": "en" if i == "a" else "it"}) for i, t in text.items()], "id string, content string, url string, metadata map<string,string>")
    assert engine.index(docs) == 2  # c is a copy of a
    groups, cites = engine.answer("search postings")
    assert groups.first().document_id == "a" and "postings" in cites.first().snippet
    assert [r.document_id for r in engine.search("pasta engines", filters=retrieval.Filters(metadata_equals={"lang": "it"})).collect()] == ["b"]
    assert engine.search("  ").collect() == [] and engine.stats().first().documents == 2
    assert engine.delete(["a", "zz"]) == 1 and engine.stats().first().documents == 1
    again = Engine(spark, engine.store.path)
    assert again.search("pasta").count() == 1
    again.index(docs.filter("id = 'b'").withColumn("content", F.lit("Now about trains and other railway matters.")))
    assert again.search("trains").first().content.startswith("Now about") and again.stats().first().chunks == 1
    again.clear()
    assert again.stats().first().chunks == 0
    with pytest.raises(ValueError):
        again.search("x" * 20_000)


def _bits(a: int, b: int) -> int:
    return bin((a ^ b) & (1 << 64) - 1).count("1")


def test_registry_of_several_imports_is_that_of_one_by_one(spark, tmp_path):
    """Batches against a registry kept in a plain dictionary."""
    import random

    rng = random.Random(3)
    base = [[rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(90)) for _ in range(120)] for _ in range(6)]
    rows, n = [], 0
    for batch in range(3):
        rows.append([])
        for b in base[: 3 + batch]:
            for edit in (0, 0, 1):
                words = list(b)
                if edit:
                    words[rng.randrange(120)] = f"edit{n}"
                rows[-1].append((f"{n:05d}", " ".join(words), f"https://e.org/{n}"))
                n += 1
    engine = Engine(spark, f"file://{tmp_path}/registry", Config.from_toml("[chunking]\nmin_size = 1\n"), "create")
    known: dict[str, list] = {}  # entry: hash, simhash, urls
    for batch in rows:
        docs = spark.createDataFrame(batch, "id string, content string, url string")
        marks = {r.id: (r.content_hash, r.simhash) for r in dedup.with_identity(docs, "content").collect()}
        engine.index(docs)
        before, fresh = {e: tuple(v[:2]) for e, v in known.items()}, {}
        for i, _, url in batch:
            h, s = marks[i]
            same = sorted(e for e, (eh, _) in before.items() if eh == h)
            near = sorted((_bits(s, es), e) for e, (_, es) in before.items() if _bits(s, es) <= 3)
            own = sorted((_bits(s, es), e) for e, es in fresh.items() if _bits(s, es) <= 3)
            entry = same[0] if same else near[0][1] if near else own[0][1] if own else i
            if entry == i:
                known[i], fresh[i] = [h, s, {url}], s
            else:
                known[entry][2].add(url)
                if not same and not (entry in fresh and known[entry][0] == h):
                    known[entry][:2] = [h, s]
    got = {r.entry_id: [r.content_hash, r.simhash, set(r.urls)] for r in engine.store.read("registry").collect()}
    assert got == known and len(known) >= 5
    assert {r.document_id for r in engine.store.read("chunks").select("document_id").distinct().collect()} == set(known)


def test_a_hot_entry_keeps_its_turns(spark):
    """Many copies of two near texts in turn: what was indexed last decides, over the borders of partitions."""
    y = spark.createDataFrame([(i, "ab"[(i // 5) % 2], 0) for i in range(200)] + [(1000 + i, "c", 1000) for i in range(30)], "id bigint, content_hash string, entry_id bigint")
    got = {r.id: r.again for r in dedup._turns(y.repartition(7)).collect()}
    assert got == {**{i: i > 0 and (i // 5) % 2 == ((i - 1) // 5) % 2 for i in range(200)}, **{1000 + i: i > 0 for i in range(30)}}


def test_recent_duplicates_forget(spark):
    pages = spark.createDataFrame([(i, h) for i, h in enumerate("abcabdeefa")], "page_id bigint, content_hash string")
    got = [r.status for r in dedup.recent_duplicates(pages, "page_id", 3).orderBy("page_id").collect()]
    assert got == ["new", "new", "new", "seen", "seen", "new", "new", "seen", "new", "new"]


def test_searches_read_the_terms_they_need(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("CAST(doc_id AS STRING) AS chunk_id", "text AS content")
    index = lexical.stored_index(docs, f"file://{tmp_path}/postings")
    terms = [r.term for r in index.postings.select("term").collect()]
    files = [sorted(f.select("term").distinct().collect()) for f in (spark.read.parquet(x) for x in index.postings.inputFiles())]
    spans = sorted((f[0].term, f[-1].term) for f in files if f)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and len(terms) > 1000
    plan = lexical.bm25_scores(index, "thing")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,thing)]" in plan or "In(term" in plan or "EqualTo(term" in plan


def test_batch_scores_stay_where_they_are_made(spark, monkeypatch):
    """Between the sums for each query and chunk and the best of them there is no shuffle; many queries, joined by shuffles, have the same result."""
    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 20)))
    index = lexical.build_index(spark.createDataFrame([(f"c{n}", text()) for n in range(200)], "chunk_id string, content string"))
    queries = spark.createDataFrame([(n, text()) for n in range(30)], "query_id bigint, text string")
    found = lexical.bm25_batch(index, queries, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    by = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)
    assert not any("query_id" in x and "chunk_id" in x for x in by) and any(x.startswith("chunk_id") for x in by) and "WindowGroupLimit" in plan, plan
    few = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(lexical, "MOST_TERMS", 10)
    assert few == sorted(map(tuple, lexical.bm25_batch(index, queries, 5).collect())) and len(few) > 100


def test_stored_postings_are_in_order_and_whole(spark, tmp_path, monkeypatch):
    """Over many files, with a term that spans some of them, empty texts and a chunk of two rows; one shuffle of the texts and one of the postings."""
    from collections import Counter

    for name, value in (("FILE_ROWS", 50), ("SAMPLED", 20)):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(5)
    rows = [(f"c{n}", " ".join(["all", *(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 30)))])) for n in range(300)] + [("c7", "all more"), ("e", ""), ("n", None), ("x", "Ünder-Straße 北京 \U0001f600 a1")]
    spark.createDataFrame(rows, "chunk_id string, content string").write.parquet(f"file://{tmp_path}/chunks")
    chunks = spark.read.parquet(f"file://{tmp_path}/chunks")
    plan = lexical.ordered_index(chunks).postings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "rangepartitioning" not in plan
    stored = lexical.stored_index(chunks, f"file://{tmp_path}/postings").postings
    files = [[tuple(r) for r in spark.read.parquet(f).collect()] for f in stored.inputFiles()]
    files = sorted((f for f in files if f), key=lambda f: f[0])
    flat = [r for f in files for r in f]
    assert len(files) > 20 and flat == sorted(flat) and sum(f[0][0] == "all" for f in files) > 1
    want = Counter((t, c) for c, text in rows for t in re.findall(r"[^\W_]+", (text or "").lower()))
    assert {(t, c): n for t, c, n, _ in flat} == dict(want) and len(flat) == len(want)


def test_a_second_import_takes_all_documents(spark, tmp_path):
    """Also those whose text no entry has any more, as a near one came later: they change the entry again, or are new if what it holds now is further off."""
    import duckdb
    from seekmill.functions.identity import simhash_of
    from seekmill.plans import registry

    far = lambda a, b: ((simhash_of(a.lower().split()) ^ simhash_of(b.lower().split())) & (2**64 - 1)).bit_count()
    rng = random.Random(2)
    texts: list[str] = []
    while len(texts) < 9:  # three chains of three: the second and third are near the first, and in the third chain not near each other
        base = [f"w{rng.randint(0, 999)}" for _ in range(200)]
        near = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in range(200)]
        near = [t for t in near if 0 < far(t, " ".join(base)) <= 3]
        pairs = [(a, b) for i, a in enumerate(near) for b in near[i + 1 :] if (far(a, b) > 3) == (len(texts) == 6)]
        if pairs:
            texts += [" ".join(base), *pairs[0]]
    rows = [(n, t) for n, t in enumerate([*texts, texts[0], "", None], 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = tuple(registry.queries()["j4_import_twice"](spark, f"file://{tmp_path}").first())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    entries, urls, unchanged = duck.execute(registry.oracle_sql()["j4_import_twice"]).fetchone()
    assert got == (entries, urls, unchanged) and urls == 2 * len(rows) and unchanged < 4 <= entries


def test_python_functions_work_in_pieces(spark, monkeypatch):
    """A worker holds the results of a few rows, not of a whole batch of them; the pieces change no result."""
    import pandas as pd
    from seekmill.functions import html, pieces

    ids = spark.range(1000).coalesce(1)
    size = lambda *xs: pd.Series([len(xs[0])] * len(xs[0]))
    for columns in (["id"], ["id", "id"]):
        got = [r.n for r in ids.select(pieces.udf(size, "bigint", *map(F.col, columns)).alias("n")).collect()]
        assert len(got) == 1000 and max(got) == pieces.PIECE
    docs = spark.createDataFrame([(f"d{n}", f"# T{n}\n" + f"Word {n} two three. " * (n * 40), n) for n in range(7)], "id string, content string, k int").coalesce(1)
    pages = spark.createDataFrame([(f"https://e.org/{n}", f"<p>Page {n} <a href='/a{n}'>x</a></p>" if n % 3 else None) for n in range(7)], "url string, html string").coalesce(1)
    found = []
    for n in (1000, 2):
        monkeypatch.setattr(pieces, "PIECE", n)
        found.append((chunking.chunk_documents(docs, keep=("k",)).collect(), pages.select("url", html.extract(F.col("html"), F.col("url")).alias("x")).collect()))
    assert found[0] == found[1] and len(found[0][0]) > 8


@pytest.mark.parametrize("top", [3, 40])
def test_batch_vector_searches_over_blocks(spark, monkeypatch, top):
    """Over many blocks, with ties, a zero vector and fewer vectors in a block than asked for; LSH: exactly the pairs that share a band, with no row for each pair."""
    import numpy as np

    for name, value in (("QUERY_BLOCK", 16), ("QUERY_ROWS", 5)):
        monkeypatch.setattr(vector, name, value)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(60, 8)), 2)
    v[40:50] = v[:10] * 2  # ties
    v[59] = 0
    rows = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(99, None)], "vec_id bigint, embedding array<double>")
    queries = rows.filter("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    sims = np.round(np.clip(unit @ unit.T, 0, 1), 6)
    bits = v @ vector.plane_matrix(8).T > 0
    share = lambda i, j: any((bits[i, n : n + 5] == bits[j, n : n + 5]).all() for n in range(0, 125, 5))
    plan = vector.lsh_search_batch(rows, queries, top, "vec_id", dims=8)
    assert "distinct" not in plan._jdf.queryExecution().executedPlan().toString() and plan._jdf.queryExecution().executedPlan().toString().count("Join") == 1
    for found, ok in ((vector.vector_search_batch(rows, queries, top, "vec_id"), lambda i, j: True), (plan, share)):
        got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in found.withColumnRenamed("vec_id", "chunk_id").collect()}
        want = {}
        for i in range(0, 60, 3):
            near = sorted((-sims[i, j], j) for j in range(60) if ok(i, j))[:top]
            want |= {(i, n): (j, -s) for n, (s, j) in enumerate(near, 1)}
        assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()} and all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_deep_pages_are_read():
    from seekmill.functions import html

    deep = "<div>" * 20_000 + "<p>the text</p>" + "</div>" * 20_000
    assert "the text" in html.render(html.parse(f"<html><body>{deep}</body></html>"))


def test_pages_are_filtered(spark):
    from seekmill.sources import wiki

    text = "'''Bold''' words about [[Main page|a page]] in {{template}} a sentence that is long enough to be kept here, and more of it."
    pages = spark.createDataFrame([(1, 0, "A b", False, text), (2, 1, "B", False, text), (3, 0, "C", True, text), (4, 0, None, False, text), (5, 0, "E", False, "short"), (6, 0, "F", False, "{{" + "x" * 200 + "}}")], "id bigint, ns int, title string, redirect boolean, wikitext string")
    got = wiki.page_documents(pages.withColumn("file", F.lit("enwiki.xml")).withColumn("modified", F.lit(None).cast("timestamp"))).collect()
    assert [(r.id, r.url.rpartition("/")[2]) for r in got] == [("1", "A_b")]
    assert "Bold words about a page in" in got[0].content and "[[" not in got[0].content and "{{" not in got[0].content


def test_advertisements_are_published_and_replaced(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/ads", Config.from_toml("[chunking]\nmin_size = 1\n"), "create")
    engine.index(spark.createDataFrame([(str(n), f"Words number {n} about the subject {n % 3} and others of its kind.") for n in range(12)], "id string, content string"), whole=True)
    for _ in range(2):
        engine.advertise("here", 3)
    ads = engine.store.read("ads").collect()
    assert 1 <= len(ads) <= 3 and sum(a["size"] for a in ads) == engine.store.read("vectors").count()
    query = list(engine.store.read("vectors").first().embedding)
    assert [r.node_id for r in engine.candidates(query).collect()] == ["here"] and engine.candidates(query, max_age=-1).collect() == []


def test_command_line(spark, tmp_path, capsys):
    import io
    import json

    from seekmill.__main__ import main

    (tmp_path / "in").mkdir()
    for name, text in (("a", "Lighthouses guide ships along dark coasts at night."), ("b", "Bread needs flour, water, salt and a warm oven.")):
        (tmp_path / "in" / f"{name}.txt").write_text(text)
    (tmp_path / "c.toml").write_text("[chunking]\nmin_size = 1\n")

    def run(*words):
        out = io.StringIO()
        assert main(["--index", f"file://{tmp_path}/cli", "--config", str(tmp_path / "c.toml"), *words], out) == 0
        return [json.loads(x) for x in out.getvalue().splitlines()]

    assert run("index", str(tmp_path / "in")) == [{"chunks": 2}] and run("index", str(tmp_path / "in")) == [{"chunks": 0}]
    assert "Lighthouses" in run("search", "dark coasts", "--top", "1")[0]["snippet"]
    assert run("stats")[0]["documents"] == 2
    run("export", f"file://{tmp_path}/out", "--format", "json")
    whole = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert len(json.loads(whole)) == 2
    run("rebuild"), run("compact"), run("clear")
    assert run("stats")[0]["chunks"] == 0


def test_config_reports_all_errors():
    with pytest.raises(ValueError) as e:
        Config.from_toml("[index]\ndims = 0\n[chunking]\noverlap = 2.0\n")
    assert len(e.value.args[0]) == 2
    assert Config.from_toml("[dedup]\nthreshold = 10\n").dedup.threshold == 10


def test_plans_push_filters_down_and_avoid_cartesian_products(spark, sf_dir):
    from seekmill.plans import registry

    plan = lambda name: registry.queries()[name](spark, sf_dir)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    for name in ("e5_bm25_all", "d2_near_pairs", "d3_classify", "g4_matching_bands"):
        text = plan(name)
        assert "CartesianProduct" not in text and "lang" not in "".join(x for x in text.split("\n") if "ReadSchema" in x), name
    text = plan("d2_near_pairs")
    assert "ArrowEvalPython" not in text  # hashes aren't computed again for the join
    assert "TakeOrderedAndProject" in plan("e7_vector_search") and "WindowGroupLimit" in plan("i2_pop_next")
