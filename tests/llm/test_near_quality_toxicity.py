"""Operators 2, 6 and 7: brute force and held-out accuracy."""

import itertools
import math
import random
import re
import time

import numpy as np

from seekmill.llm import near_dedup as nd
from seekmill.llm import quality, toxicity
from seekmill.llm.common import Scratch

from . import brute


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_near_duplicates_against_all_pairs(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    want = brute.near([(r.doc_id, r.text) for r in docs.collect()], nd.THRESHOLD)
    got = {r.doc_id: r.keeper_id for r in nd.near_duplicates(docs).collect()}
    assert len(set(got) & set(want)) >= 0.9 * len(want) and not set(got) - set(want)
    assert all(want[i] == k for i, k in got.items())


def test_a_bucket_of_many_groups_is_searched_to_the_end(spark):
    """Hundreds of documents share most of their registers' bands with others of their own group only."""
    rng = random.Random(5)
    head = [f"h{n}" for n in range(60)]
    rows = []
    for g in range(30):
        own = [f"g{g}w{n}" for n in range(60)]
        rows += [(10 * g + c, " ".join(head + own + [f"x{rng.random()}"]), "s") for c in range(5)]
    got = {r.doc_id: r.keeper_id for r in nd.near_duplicates(brute.table(spark, rows)).collect()}
    assert got == brute.near([(i, t) for i, t, _ in rows], nd.THRESHOLD)


def test_copies_that_are_alike_their_original_only(spark):
    """Hundreds of copies, each edited on its own: two of them are rarely alike, but all are alike the original."""
    rng = random.Random(8)
    original = [f"w{n}" for n in range(300)]
    texts = [original] + [[f"x{rng.random()}" if rng.random() < 0.06 else w for w in original] for _ in range(200)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t), "s") for i, t in enumerate(texts)]
    want = brute.near([(i, t) for i, t, _ in rows], nd.THRESHOLD)
    got = {r.doc_id: r.keeper_id for r in nd.near_duplicates(brute.table(spark, rows)).collect()}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want), (len(got), len(want))


def test_wide_buckets_are_split_without_losing_pairs(spark, monkeypatch):
    """Documents that share a third of their words with all others, and much with one other; buckets are split from 8 groups on."""
    monkeypatch.setattr(nd, "SPLIT", 8)
    rng = random.Random(13)
    head, rows = [f"h{n}" for n in range(100)], []
    for g in range(120):
        own = [f"g{g}w{n}" for n in range(100)]
        edited = [f"x{rng.random()}" if rng.random() < 0.05 else w for w in own]
        rows += [(2 * g, " ".join(head + own), "s"), (2 * g + 1, " ".join(head + edited), "s")]
    want = brute.near([(i, t) for i, t, _ in rows], nd.THRESHOLD)
    got = {r.doc_id: r.keeper_id for r in nd.near_duplicates(brute.table(spark, rows)).collect()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) > 90, (len(got), len(want))


def _narrowly_alike():
    """Pairs of documents just above the threshold; all documents share more than half of their words with all others."""
    rng = random.Random(21)
    head, rows = [f"h{n}" for n in range(120)], []
    for g in range(150):
        own = [f"g{g}w{n}" for n in range(80)]
        new = rng.randrange(40, 46)
        rows += [(2 * g, " ".join(head + own), "s"), (2 * g + 1, " ".join(head + own[new:] + [f"g{g}x{n}" for n in range(new)]), "s")]
    return rows


def _bands(rows):
    """The places in which all four registers of the two documents of a pair are equal, and how many documents have those."""
    keys = nd.registers(*nd.shingles([nd.fold(t) for _, t, _ in rows])).reshape(len(rows), nd.BANDS, nd.ROWS)
    for a in range(0, len(rows), 2):
        yield a, [int((keys[:, b] == keys[a, b]).all(1).sum()) for b in np.flatnonzero((keys[a] == keys[a + 1]).all(1))]


def test_no_pair_of_a_wide_bucket_is_lost(spark, monkeypatch):
    """Pairs whose only common band is a wide bucket have no second band to meet in."""
    monkeypatch.setattr(nd, "SPLIT", 8)
    rows = _narrowly_alike()
    want = brute.near([(i, t) for i, t, _ in rows], nd.THRESHOLD)
    once = {a for a, sizes in _bands(rows) if len(sizes) == 1 and sizes[0] > 40 and a + 1 in want}
    met = {a + 1 for a, sizes in _bands(rows) if sizes and a + 1 in want}
    assert once and len(met) > 90
    got = {r.doc_id: r.keeper_id for r in nd.near_duplicates(brute.table(spark, rows)).collect()}
    assert met <= set(got) and got.items() <= want.items(), (sorted(met - set(got)), once)


def test_pairs_whose_estimate_falls_short_are_not_lost(spark, monkeypatch):
    """No estimate is high enough for the rounds, so all is left to the join, which finds the groups."""
    monkeypatch.setattr(nd, "SLACK", -12.0)
    rows = _narrowly_alike()
    want = brute.near([(i, t) for i, t, _ in rows], nd.THRESHOLD)
    met = {a + 1 for a, sizes in _bands(rows) if sizes and a + 1 in want}
    got = {r.doc_id: r.keeper_id for r in nd.near_duplicates(brute.table(spark, rows)).collect()}
    assert met <= set(got) and got.items() <= want.items()


def _without_a_band():
    """Pairs of documents above the threshold, of which the first share no band; nothing is common to pairs."""
    rows = []
    for g in range(700):
        own = [f"g{g}w{n}" for n in range(100)]
        rows += [(2 * g, " ".join(own), "s"), (2 * g + 1, " ".join(own[24:] + [f"g{g}x{n}" for n in range(24)]), "s")]
    apart = [a for a, sizes in _bands(rows) if not sizes]
    return [rows[i] for a in [*apart, *range(0, 20, 2)] for i in (a, a + 1)], len(apart)


def test_pairs_without_a_common_band_are_not_lost(spark):
    rows, apart = _without_a_band()
    want = brute.near([(i, t) for i, t, _ in rows], nd.THRESHOLD)
    assert apart > 3 and len(want) == len(rows) // 2
    assert {r.doc_id: r.keeper_id for r in nd.near_duplicates(brute.table(spark, rows)).collect()} == want


def test_no_text_is_ruled_out_by_its_shingles(spark, monkeypatch):
    """Texts in several blocks and parts, of roots of one or several: exactly those stay that share enough with other roots."""
    monkeypatch.setattr(nd, "BLOCK", 1_500)
    rng = random.Random(4)
    texts = []
    for v in range(120):
        old = rng.choice(texts)[3].split()[: rng.randrange(60)] if texts and rng.random() < 0.8 else []
        texts.append((v, v - v % 3 if v < 60 else v, v < 60, " ".join(old + [f"v{v}w{n}" for n in range(rng.randrange(3, 40))])))
    sets = {v: {*nd.shingles([nd.fold(t)])[0].tolist()} for v, _, _, t in texts}
    held = {}
    for v, root, _, _ in texts:
        for h in sets[v]:
            held.setdefault(h, set()).add(root)
    want = {v for v, s in sets.items() if sum(len(held[h]) > 1 for h in s) >= 0.6 * len(s) - 1e-9}
    table = spark.createDataFrame(texts, "v bigint, root bigint, grouped boolean, text string").repartition(3, "v")
    assert 10 < len(want) < 110
    for parts in (1, 5):
        assert sorted(r.v for r in nd._possible(table, 0.6, parts).collect()) == sorted(want)


def test_the_join_of_sets_is_exact(spark):
    """Sets of all sizes and similarities, some of them common to many, against all pairs; pairs of one root are left out."""
    rng = random.Random(3)
    words, sets = [rng.getrandbits(63) for _ in range(60)], []
    for v in range(300):
        like = set(rng.choice(sets)[3]) if sets and rng.random() < 0.6 else set(rng.sample(words, rng.randrange(1, 25)))
        like = {h for h in like if rng.random() < 0.9} | {rng.getrandbits(63) for _ in range(rng.randrange(4))} | {words[0]}
        sets.append((v, v // 2, len(like), sorted(like)))
    table = spark.createDataFrame(sets, "v bigint, root bigint, n bigint, h array<bigint>")
    for threshold in (0.4, 0.6, 1.0):
        want = set()
        for (a, ra, _, x), (b, rb, _, y) in itertools.combinations(sets, 2):
            if ra != rb and len({*x} & {*y}) / len({*x} | {*y}) >= threshold:
                want.add((a, b))
        got = [(min(r), max(r)) for r in nd._alike(table, threshold, Scratch(spark, "test")).collect()]
        assert want and want <= set(got) and len(set(got)) == len(got), threshold


def test_sketches_merge_and_estimate():
    rng = random.Random(6)
    for share in (0.2, 0.6, 0.9):
        both, a, b = ([rng.getrandbits(64) for _ in range(n)] for n in (int(4000 * share), int(2000 * (1 - share)), int(2000 * (1 - share))))
        sketch = lambda *parts: nd.registers(np.concatenate([np.array(p, np.uint64) for p in parts]), np.array([0]))
        x, y = sketch(both, a), sketch(both, b)
        assert (nd.merge(x, y) == sketch(both, a, b)).all()
        true = len(both) / (len(both) + len(a) + len(b))
        assert abs(nd.joint_estimate(x, y)[0] - true) < 0.15
        assert abs(nd.cardinality(x)[0] / (len(both) + len(a)) - 1) < 0.35


def test_near_dedup_of_nasty_rows(spark):
    docs = brute.nasty(spark, "v band key sketch _nd_id _nd_th")
    out = nd.near_dedup(docs)
    assert out.columns == docs.columns
    kept = sorted((r.doc_id or 0, r.text is None) for r in out.collect())
    assert kept == [(0, False), (0, True), (2, True), (3, False), (4, False), (5, False), (6, False)]
    assert nd.near_dedup(docs.limit(0)).collect() == []


def test_quality_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/labels.parquet")
    model = quality.train(docs, labels.filter("doc_id % 3 <> 0"))
    held = quality.score(docs, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").select("keep", "quality").toPandas()
    assert (held.keep == (held.quality > 0)).mean() > 0.95
    assert 0 < len(model.rules) < 120


def test_rules_as_columns_agree_with_the_model(spark, sf_dir):
    docs, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    rows = quality.score(docs.withColumn("stats", quality.statistics(docs.text)), model).select("stats", "score", "keep").collect()
    p = model.probability(np.array([list(r.stats) for r in rows]), quality.NAMES)
    assert np.allclose(p, [r.score for r in rows], atol=1e-5) and [r.keep for r in rows] == list(p >= quality.THRESHOLD)
    left = sorted(r.doc_id for r in quality.quality_filter(docs, labels).collect())
    assert left == sorted(r.doc_id for r in quality.score(docs, model).filter("keep").collect())


def test_statistics_of_texts(spark):
    texts = ["", None, "One two, two!\n\tThree |4 5|  ß Ünder.\nOne", "#" * 9, " \n ", "a\rb\x0bc d e f", "x " * 70_000]
    got = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string").select("n", quality.statistics(quality.F.col("text")).alias("s")).orderBy("n").collect()
    for text, r in zip((t or "" for t in texts), got):
        words, lines, size = re.split(r"[ \t\n\x0b\f\r]+", text), text.split("\n"), max(1, len(text))
        words = [w for w in words if w]
        share = lambda signs: sum(c in signs for c in text) / size  # noqa: E731, B023
        want = [math.log1p(len(text)), sum(map(len, words)) / max(1, len(words)), share(r"#*%&$@~^_=+<>\/{}[]"), share(".!?"), share(",;:"), share("!"), share("|"), share("0123456789")]
        want += [sum(c.isupper() for c in text) / size, len(set(words)) / max(1, len(words)), len(set(lines)) / len(lines), math.log1p(len(words) / len(lines))]
        assert np.allclose(list(r.s), want), (text[:20], list(r.s), want)


def test_a_filter_computes_statistics_once_whatever_the_rules(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    plans = set()
    for n in (1, 10, 40):
        rules = [quality.Rule((("chars", True, float(k)), ("digits", False, 0.1))) for k in range(n)]
        left = docs.filter(quality.log_odds(docs.text, quality.RuleModel(0.0, rules, [1.0] * n)) >= 0)
        plan = left._jdf.queryExecution().optimizedPlan().toString()
        plans.add((plan.count("regexp_extract_all("), plan.count("array_distinct("), plan.count("split(")))
    assert len(plans) == 1 and max(plans.pop()) <= 7


def _paths(x, grad, hess, names, edges, path, depth, least, rows):
    """Paths of a boosted tree by trying every split of every node anew."""
    out = [path] if path else []
    value = lambda r: sum(grad[i] for i in r) ** 2 / (sum(hess[i] for i in r) + 1)
    best = (1e-6, None)
    for f in range(len(names)) if depth else ():
        for bound in edges[f]:
            low, high = [i for i in rows if x[i][f] <= bound], [i for i in rows if x[i][f] > bound]
            if len(low) >= least and len(high) >= least and value(low) + value(high) - value(rows) > best[0] + 1e-12:
                best = (value(low) + value(high) - value(rows), f, bound, low, high)
    if best[1] is not None:
        _, f, bound, low, high = best
        out += _paths(x, grad, hess, names, edges, (*path, (names[f], False, bound)), depth - 1, least, low)
        out += _paths(x, grad, hess, names, edges, (*path, (names[f], True, bound)), depth - 1, least, high)
    return out


def test_rules_are_the_paths_of_all_splits_tried():
    rng = np.random.default_rng(9)
    names = ["a", "b", "c"]
    x = rng.random((120, 3)).round(2)
    y = ((x[:, 0] > 0.4) & (x[:, 1] <= 0.7)).astype(float)
    grad, hess = y - y.mean(), np.full(120, y.mean() * (1 - y.mean()))
    edges = [np.unique(x[:, f])[:-1] for f in range(3)]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    rules, step = [], np.zeros(120)
    quality._grow(x, bins, edges, names, grad, hess, np.arange(120), (), 3, 4, rules, step, 0.3)
    assert [r.conditions for r in rules] == _paths(x, grad, hess, names, [e.tolist() for e in edges], (), 3, 4, list(range(120)))
    for r in rules:  # a column holds where all conditions of the path do
        assert (r.holds(x, names) == [all((v[names.index(n)] > t) == above for n, above, t in r.conditions) for v in x]).all()


def test_weights_meet_the_conditions_of_the_lasso():
    rng = np.random.default_rng(10)
    z = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z[:, 0] - 1.5 * z[:, 1] - 0.2)))).astype(float)
    penalty = 0.02
    b, w = quality._lasso(z, y, penalty, 2000)
    residual = 1 / (1 + np.exp(-(z @ w + b))) - y
    slope = z.T @ residual / len(y)
    assert abs(residual.mean()) < 1e-5 and 0 < (w != 0).sum() < 12
    assert np.allclose(slope[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-5) and (np.abs(slope[w == 0]) <= penalty + 1e-5).all()


def test_quality_of_nasty_rows(spark, sf_dir):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (6, None), (None, 1)], "doc_id bigint, quality int")
    docs = brute.nasty(spark, "score keep _q _y")
    model = quality.train(docs, labels)
    out = quality.score(docs, model)
    assert out.columns == [*docs.columns, "_score", "_keep"] and out.count() == docs.count()
    assert quality.score(docs.limit(0), model).collect() == []
    assert quality.quality_filter(docs, labels.limit(0)).count() == docs.count()  # nothing learned, nothing rejected


def _disguise(rng, word):
    kind = rng.randrange(4)
    if kind == 0:
        return "".join({"o": "0", "i": "1", "e": "3", "a": "4", "s": "$"}.get(c, c) for c in word)
    if kind == 1:
        return " ".join(word)
    if kind == 2:
        return "".join(c * 4 if c in "aeiou" else c for c in word)
    return ".".join(word)


def test_toxicity_finds_plain_and_disguised_terms(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    terms = toxicity.learn_terms(docs, labels.filter("doc_id % 4 <> 0"))
    words = sorted(t for t in terms.weights if not t.endswith("*") and len(t) > 3)
    assert words
    scored = toxicity.toxicity(docs, labels.filter("doc_id % 4 <> 0")).select("doc_id", quality.F.col("toxic").alias("found"))
    held = scored.join(labels.filter("doc_id % 4 = 0"), "doc_id").select("found", "toxic").toPandas()
    hits, bad = held[held.toxic == 1].found.mean(), held[held.toxic == 0].found.mean()
    assert hits > 0.85 and bad < 0.02, (hits, bad)
    rng = random.Random(7)
    clean = [r.text for r in docs.filter("lang = 'en' AND n_chars BETWEEN 300 AND 600").orderBy("doc_id").limit(60).collect()]
    model = toxicity.CharModel(toxicity.trigram_counts(docs))
    automaton = terms.automaton()
    found = 0
    for text in clean:
        w = rng.choice(words)
        at = text.index(" ", 100)
        restored = model.restore([f"{text[:at]} {_disguise(rng, w)} {text[at:]}".lower()])[0]
        found += bool(terms.find(automaton, restored))
    assert found >= 0.85 * len(clean)


def test_disguises_of_every_sign_and_place_are_read(spark):
    docs = brute.table(spark, [(i, "an idiot talks garbage and stupid shit about the big table; hello letter will book", "s") for i in range(50)])
    model = toxicity.CharModel(toxicity.trigram_counts(docs))
    for word, disguised in (("idiot", "idio7"), ("idiot", "1d107"), ("garbage", "garbag3"), ("shit", "5h17"), ("big", "8i9"), ("table", "t48l€"), ("stupid", "stuupid"), ("idiot", "iddiiott"), ("idiot", "i/d/i/o/t"), ("idiot", "id\u200bio\u200dt")):
        assert word in model.restore([f"and {disguised} talks"])[0].split(), disguised
    for clean in ("hello!", "letter", "will", "book", "garbage!"):
        assert model.restore([f"and {clean} talks"]) == [f"and {clean} talks"]


def _cost(model, text_parts):
    state, total = 0, 0.0
    for string, price in text_parts:
        total += price
        for ch in string:
            x = toxicity._symbol(ch)
            if x or state & 63:
                total += model.cost[(state << 6) + x]
                state = (state & 63) << 6 | x
    return total + (model.cost[state << 6] if state & 63 else 0.0)


def test_decoding_is_the_best_of_all_readings(spark):
    docs = brute.table(spark, [(i, "an idiot talks garbage and stupid shit about the big table; hello letter will book", "s") for i in range(9)])
    model = toxicity.CharModel(toxicity.trigram_counts(docs))
    rng = random.Random(11)
    spans = ["1d107", "stuupid", "iiddd1ooo7", "i.d.i.o.t", "5 h 1 7", "a", "9", "b||g", "l3tt3r"] + ["".join(rng.choices("ailost1!0$5 .", k=rng.randint(2, 9))) for _ in range(60)]
    for span in spans:
        readings = {}
        for parts in itertools.product(*model.lattice(span)):
            text = "".join(p[0] for p in parts)
            readings[text] = min(readings.get(text, math.inf), _cost(model, parts))
        assert readings[model.decode(span)] <= min(readings.values()) + 1e-9, span


def test_spans_are_those_of_an_expression():
    x, letter = toxicity._X, toxicity._L
    sign = re.compile(rf"(?:{letter}|[{x}])+")
    alone = re.compile(rf"(?<![^\W_])(?<![{x}])(?:{letter}|[{x}])(?:[ .\-_*/]{{1,2}}(?:{letter}|[{x}])(?![^\W_])(?![{x}])){{3,}}")
    rng = random.Random(12)
    for _ in range(400):
        text = "".join(rng.choices("aab19$€ß2_ .-/é漢\n\u2014", k=rng.randint(0, 30)))
        want = {m.span() for m in sign.finditer(text) if re.search(letter, m[0]) and (re.search(f"[{x}]", m[0])) or re.search(rf"({letter})\1", m[0])}
        chains = [s for s in toxicity.find_spans(text) if s not in want]
        assert want <= set(toxicity.find_spans(text)) and {m.span() for m in alone.finditer(text)} == set(chains), text


def test_a_text_of_a_million_unbroken_characters(spark):
    model = toxicity.CharModel(toxicity.trigram_counts(brute.table(spark, [(1, "some words of a text", "s")])))
    for text in ("ab" * 500_000 + "9 9ab", "a9" * 100_000, "a b " * 50_000, "a" * 1_000_000):
        began = time.process_time()
        assert len(model.restore([text])) == 1
        assert time.process_time() - began < 60
    assert model.restore([]) == [] and model.restore(["", ""]) == ["", ""]


def test_toxicity_of_nasty_rows(spark):
    docs = brute.nasty(spark, "toxic score terms")
    labels = spark.createDataFrame([(1, 0), (4, 1), (None, 1), (6, None)], "doc_id bigint, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == docs.count() and all(r.score == 0.0 and r.terms == [] for r in out if r.doc_id in (2, 3))
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
    assert all(not r.toxic for r in toxicity.toxicity(docs, labels.limit(0)).collect())
