"""Centroid clustering, the factorisation machine and ranked search."""

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import clustering, factorisation, registry, search
from tests.conftest import SF, rows
from tests.llm import helpers


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op13_lexical_search"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df, *want.columns) == sorted(want.fetchall(), key=lambda r: tuple((x is None, str(x)) for x in r))


# Clustering


def brute_clusters(vectors, k, rounds, dims, seed=3, scale=1024):
    """Plain Lloyd's rounds in Python integers: (id, cluster, distance) in the order of the input."""
    kept = [(i, [scale * int(x) if abs(x) >= 2**53 else math.floor(scale * x) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    firsts = sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"{seed}:{x[0]}".encode()).hexdigest(), x[1]))
    centroids = [v for _, v in firsts[:k]]

    def assigned():
        every = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for _, v in kept]
        return [(d.index(min(d)), min(d)) for d in every]

    for _ in range(rounds):
        at = assigned()
        for j in range(len(centroids)):
            mine = [v for (_, v), (c, _) in zip(kept, at) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, c, d) for (i, _), (c, d) in zip(kept, assigned())], centroids


def checked(spark, vectors, schema="vec_id long, embedding array<double>, cluster string, distance string, ids string, x string, data string", **more):
    extra = len(schema.split(", ")) - 2
    df = spark.createDataFrame([(i, v, *["clash"] * extra) for i, v in vectors], schema)
    found = clustering.cluster(df, **more)
    want, centroids = brute_clusters(vectors, more["k"], more["rounds"], more["dims"])
    whole = sum(d for *_, d in want)
    per = collections.Counter()
    for _, c, d in want:
        per[c] += d
    long = lambda v: v if v < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    assert rows(found, "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256") == sorted(
        ((i, c, long(d), long(per[c]), long(whole), digest[c]) for i, c, d in want), key=lambda r: tuple((x is None, str(x)) for x in r)
    )


def test_clusters_of_awkward_vectors(spark):
    rnd = random.Random(1)
    vectors = [(i, [rnd.gauss(i % 3, 0.3) for _ in range(4)]) for i in range(60)]
    vectors += [(100, None), (101, [1.0]), (102, [0.0, None, 1.0, 1.0]), (103, [0.0, math.nan, 1.0, 1.0]), (104, [math.inf, 0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5, 0.5]), (7, [0.1, 0.1, 0.1, 0.1]), (7, [0.1, 0.1, 0.1, 0.1]), (105, [])]
    checked(spark, vectors, k=5, rounds=4, dims=4)
    checked(spark, vectors[:2], k=5, rounds=4, dims=4)
    assert clustering.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert clustering.cluster(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("large", [1e4, 1e9, 1e16, 1e30, 1.7e308])
def test_clusters_beyond_float_and_long(spark, large):
    rnd = random.Random(2)
    vectors = [(i, [rnd.uniform(-1, 1) * (large if i % 7 == 0 else 1.0) for _ in range(3)]) for i in range(40)]
    checked(spark, vectors, "vec_id long, embedding array<double>", k=3, rounds=3, dims=3)


def test_ties_go_to_the_smaller_cluster_and_empty_ones_stay(spark):
    checked(spark, [(i, [float(i % 2), 0.0]) for i in range(12)], "vec_id long, embedding array<double>", k=6, rounds=2, dims=2)


def test_gemm_equals_integers():
    rng = np.random.default_rng(0)
    for top in (100, 10**6, 6 * 10**6, 10**9):
        x, c = rng.integers(-top, top, (50, 64)), rng.integers(-top, top, (8, 64)).astype(object)
        number, distance = clustering.nearest(x, c)
        every = [[sum((int(a) - b) ** 2 for a, b in zip(row, one)) for one in c] for row in x]
        assert [min(r) for r in every] == list(distance) and [r.index(min(r)) for r in every] == list(number)


# Search


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, top):
    """docs: (id, text), items: (id, text) -> (item, rank, doc, score)"""
    held = [(i, collections.Counter(t)) for i, text in docs if (t := brute_terms(text))]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(brute_terms(text)) if c[t])
            if score:
                scored.append((-score, i is None, i, score))
        out += [(item, r, i, s) for r, (_, _, i, s) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


ITEMS = [(1, "alpha7 beta, gamma12 iota"), (2, None), (3, ""), (4, "nowhere-to-be-found"), (5, "éß 東京 X"), (6, "one TWO three"), (6, "one TWO three"), (None, "alpha1 alpha2 alpha3 a changed"), (7, "alpha alpha alpha kappa999 mu0")]


@pytest.mark.parametrize("top", [1, 3, 50])
@pytest.mark.parametrize("postings", [1, 1 << 20])
def test_search_of_awkward_documents(spark, monkeypatch, top, postings):
    monkeypatch.setattr(search, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(search, "BLOCK_TERMS", 6)
    docs = [(i, t) for i, t, *_ in helpers.records()]
    items = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in ITEMS], "item_id long, text string, no string, doc_id string, score string")
    found = search.rank(helpers.documents(spark).repartition(3), items, top)
    assert rows(found, "item_id", "rank", "doc_id", "score") == brute_search(docs, ITEMS, top)


def test_search_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.rank(helpers.empty(spark), items).count() == 0
    assert search.rank(helpers.documents(spark), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert search.rank(helpers.documents(spark), items.limit(0)).count() == 0


def test_words_across_pieces(monkeypatch):
    rnd = random.Random(3)
    text = "".join(rnd.choice("ab. Zé") for _ in range(5000)) + "x" * 3000
    want = brute_terms(text)
    monkeypatch.setattr(search, "PIECE", 7)
    assert [w.decode() for part in search.words(text.encode()) for w in part] == want


def test_wand_scores_fewer_documents_than_hold_a_term():
    """Copies and common words: the best stay exact while most documents are passed over."""
    rnd = random.Random(4)
    n = 5000
    texts = [[rnd.choice("the of and to in".split()) for _ in range(20)] + [f"w{int(rnd.paretovariate(0.7))}"] * rnd.randint(0, 3) for _ in range(n)]
    asked = "the of and w1 w2 w3 w17 w40".split()
    lengths = [len(t) for t in texts]
    term = {w: k for k, w in enumerate(asked)}
    post = [[(d, t.count(w)) for d, t in enumerate(texts) if w in t] for w in asked]
    weights = {term[w]: search.weight(n, len(post[term[w]])) for w in asked}
    row = {
        "doc_ids": list(range(n)), "lengths": lengths, "terms": list(range(len(asked))), "dfs": [len(p) for p in post],
        "places": np.array([d for p in post for d, _ in p], np.int32).tobytes(), "tfs": np.array([c for p in post for _, c in p], np.int32).tobytes(),
    }
    best = []
    scored = search.wand(search.Shard(row, n, sum(lengths), weights, 10), list(weights), best, 10)
    want = collections.Counter()
    for k, p in enumerate(post):
        for d, tf in p:
            want[d] += weights[k] * ((10**9 * tf) // (1000 * tf + 20 * (50 + 50 * lengths[d] * n // sum(lengths))))
    assert sorted(best, reverse=True) == heapq.nlargest(10, ((s, -d) for d, s in want.items()))
    assert scored < len(want) / 4


# Classifier


def test_factorisation_machine_equals_pairs():
    """The sum-of-squares identity against all pairs of features."""
    rng = np.random.default_rng(5)
    model = {"w0": 0.3, "w": rng.normal(size=factorisation.N_FEATURES), "v": rng.normal(size=(factorisation.N_FEATURES, factorisation.RANK))}
    texts = [b"one two two three!", None, b"a b c d"]
    offsets, index, value = factorisation.features(texts, [18, None, 7])
    got = factorisation.logit(model, offsets, index, value)[0]
    for k in range(3):
        i, x = index[offsets[k] : offsets[k + 1]], value[offsets[k] : offsets[k + 1]]
        want = model["w0"] + sum(model["w"][i] * x)
        want += sum(float(model["v"][i[a]] @ model["v"][i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert math.isclose(got[k], want, rel_tol=1e-9)


def test_structure_counts():
    text = "Menu | Home\nSame line here.\nsame line here.\n\nEnd end END 42!"
    offsets, index, value = factorisation.features([text.encode()], [len(text)])
    fixed = {factorisation.FIELDS[(i - factorisation.N_WORDS) // factorisation.BINS]: (i - factorisation.N_WORDS) % factorisation.BINS for i in index if i >= factorisation.N_WORDS}
    share = lambda a, b: int(np.clip(math.floor(math.log2(a / b)) + 14, 1, 15)) if a else 0
    words = text.split()
    assert fixed["words"] == math.ceil(math.log2(len(words) + 1)) and fixed["word_length"] == sum(map(len, words)) // len(words)
    assert fixed["symbols"] == share(1, len(words)) and fixed["exclamations"] == share(1, len(words)) and fixed["digits"] == share(2, sum(map(len, words)))
    assert fixed["neighbours"] == share(2, len(words)) and fixed["repeated_lines"] == share(1, 4) and fixed["plain_ends"] == share(1, 4) and fixed["lines"] == 3
    assert fixed["different"] == share(len({w.lower() for w in words}), len(words))
    assert math.isclose(sum(v * v for i, v in zip(index, value) if i < factorisation.N_WORDS), 1.0)


def test_features_do_not_depend_on_pieces(monkeypatch):
    texts = [re.sub(r"((?:\S+ ){6})", r"\1\n", helpers.prose(k, 300)).encode() for k in range(5)] + [b"", None, "é東京 x\ny".encode()]
    whole = factorisation.features(texts, [None] * len(texts))
    monkeypatch.setattr(factorisation, "PIECE", 1500)
    for a, b in zip(whole, factorisation.features(texts, [None] * len(texts))):
        assert np.allclose(a, b)


def test_classifier_on_held_out_labels(spark):
    df = registry.queries()["op12_quality_classifier"](spark, SF)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"]
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = df.collect()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    judged = [(r.predicted, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    assert len(judged) > 50 and sum(a == b for a, b in judged) / len(judged) >= 0.97


def test_classifier_of_awkward_rows(spark):
    docs = helpers.documents(spark)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(16)] + [(3, 0, "x"), (3, 1, "x"), (13, 1, "x"), (None, 1, "x"), (2, 5, "x"), (8, None, "x")], "doc_id long, quality int, text string")
    found = factorisation.classify(docs, labels)
    assert rows(found, "doc_id") == rows(docs, "doc_id") and found.filter("score is null or score < 0 or score > 1").count() == 0
    again = factorisation.classify(docs.repartition(5), labels.repartition(2))
    assert rows(found, "doc_id", F.round("score", 9)) == rows(again, "doc_id", F.round("score", 9))
    assert factorisation.classify(helpers.empty(spark), labels).count() == 0
    assert {r.score for r in factorisation.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert factorisation.classify(docs.drop("n_chars"), labels).count() == docs.count()


def test_labels_of_held_out_documents_are_not_read(spark):
    docs = helpers.documents(spark)
    labels = [(i, i % 2) for i in range(16)]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = (factorisation.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, turned))
    assert rows(a, "doc_id", "score") == rows(b, "doc_id", "score")
