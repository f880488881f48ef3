import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import bpe, chat, mixing, quality, registry
from tests.conftest import SF
from tests.llm import helpers


def corpus(spark):
    data = [(k, "w " * (1 + k % 7), "big" if k % 10 < 7 else "mid" if k % 10 < 9 else None) for k in range(400)]
    return spark.createDataFrame(data, "doc_id long, text string, source string")


@pytest.mark.parametrize("target", [mixing.Target(entropy=0.95, block_tokens=200), mixing.Target(entropy=1.0, repetition=1.3), mixing.Target(budget=None, entropy=0.9), mixing.Target(budget=5000, entropy=0.99, repetition=9.0)])
def test_mix(spark, target):
    docs = corpus(spark)
    found = mixing.mix(docs, target).collect()
    tokens = {r.source: r.t for r in docs.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("t")).collect()}
    placed = {s: sum(r.n_tokens for r in found if r.source == s) for s in tokens}
    budget = sum(placed.values())
    shares = {s: n / budget for s, n in placed.items()}
    entropy = -sum(p * math.log(p) for p in shares.values()) / math.log(3)
    repetition = max(placed[s] / tokens[s] for s in tokens)
    assert repetition <= target.repetition * 1.02
    assert abs(entropy - target.entropy) < 0.01 or abs(repetition - target.repetition) < 0.05 * target.repetition
    if target.budget is None:
        assert {r.doc_id for r in found} == set(range(400))
    else:
        want = sum(tokens.values()) if target.budget == "corpus" else target.budget
        assert abs(budget - want) <= 3 * 7
    for s in tokens:  # an epoch begins when the one before is over
        uses = {}
        for r in found:
            if r.source == s:
                uses.setdefault(r.epoch, set()).add(r.doc_id)
        full = max(map(len, uses.values()))
        assert all(len(uses[e]) == full for e in range(max(uses)))
    blocks = {}
    for r in found:
        blocks.setdefault(r.block, []).append(r)
    for b in blocks.values():
        assert sorted(r.position for r in b) == list(range(1, len(b) + 1))
        if len(blocks) > 1:
            for s, p in shares.items():
                assert abs(sum(r.n_tokens for r in b if r.source == s) - p * budget / len(blocks)) <= 14


def test_mix_of_odd_documents(spark):
    assert mixing.mix(helpers.empty(spark)).count() == 0
    found = mixing.mix(helpers.documents(spark), mixing.Target(budget=None))
    assert {r.doc_id for r in found.collect()} == {None, 1, 2, 3, 7, 8, 9, 10, 11, 12, 13, 14, 15}
    docs = helpers.documents(spark)
    assert mixing.mixed_documents(docs, mixing.Target(budget=None)).columns == docs.columns


@pytest.mark.parametrize("entropy, repetition, budget", [(0.9, 4.0, "corpus"), (0.99, 1.5, "corpus"), (0.5, 9.0, None), (0.999, 50.0, 10**6)])
def test_bisection_agrees_with_one_by_hand(spark, entropy, repetition, budget):
    tokens = [(k + 1) ** 3 for k in range(20)]
    sources = spark.createDataFrame([(str(k), t) for k, t in enumerate(tokens)], "key string, tokens long")
    total = sum(tokens)

    def weights(x):
        powers = [(t / total) ** x for t in tokens]
        return [p / sum(powers) for p in powers]

    def size(x):
        return 1 / min(w / t for w, t in zip(weights(x), tokens)) if budget is None else total if budget == "corpus" else budget

    def too_flat(x):
        w = weights(x)
        return -sum(p * math.log(p) for p in w) > entropy * math.log(20) or max(p / t for p, t in zip(w, tokens)) * size(x) > repetition

    low, high = 0.0, 1.0
    if too_flat(0.0):
        for _ in range(60 if not too_flat(1.0) else 0):
            middle = (low + high) / 2
            low, high = (middle, high) if too_flat(middle) else (low, middle)
    else:
        high = 0.0
    found = mixing.find_exponent(mixing.Shares(sources), mixing.Target(entropy=entropy, repetition=repetition, budget=budget))
    assert found[0] == pytest.approx(high, abs=2e-9)
    assert found[1] == pytest.approx(size(high), rel=1e-6)


def test_mixed_documents_come_block_by_block(spark):
    docs = spark.createDataFrame([(k, f"w{k} " * (10 + k % 7), "ab"[k % 3 == 0], k, k, k) for k in range(300)], "doc_id long, text string, source string, block long, place long, whole long")
    target = mixing.Target(block_tokens=500)
    places = {}
    for r in mixing.mix(docs, target).collect():
        places.setdefault(r.doc_id, []).append((r.block, r.position))
    found = [r.doc_id for r in mixing.mixed_documents(docs, target).collect()]
    assert sorted(found) == sorted(k for k, at in places.items() for _ in at) and len({b for at in places.values() for b, _ in at}) > 5
    in_order = [k for _, k in sorted((place, k) for k, at in places.items() for place in at)]
    assert found == in_order


def test_chat(spark):
    say = lambda c, *texts: [(c, k, "user" if k % 2 == 0 else "assistant", t, "x") for k, t in enumerate(texts)]
    data = say(1, "a") + say(2, "a", "b") + say(3, "a", "b", "c") + say(4, "a", "b", "c") + say(5, "a", "x") + say(6, "ab") + say(7, None, "b") + say(8, "") + say(2, "a") + [(None, 0, "user", "z", "x"), (9, None, None, None, "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, whole string")
    found = {r.conv_id: r for r in chat.collapse(df).collect()}
    assert {k: (r.n_turns, r.n_equal) for k, r in found.items()} == {3: (3, 2), 5: (2, 1), 6: (1, 1), 7: (2, 1), 9: (1, 1)}
    assert found[5].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    assert chat.collapse(df.limit(0)).count() == 0


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram Jaccard join", "mixing", "BPE"]
    cleaned = {r.doc_id: r for r in docs.collect() if quality.judge(r.text)[8]}
    texts = {i: quality.judge(r.text)[9] if quality.judge(r.text)[6] else r.text for i, r in cleaned.items()}
    by_text = {}
    for i, t in texts.items():
        by_text.setdefault(" ".join(exact_words(t)), []).append(i)
    single = {min(v): texts[min(v)] for v in by_text.values()}
    from tests.llm.test_exact_and_jaccard import shingles

    sets = {i: shingles(t) for i, t in single.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for a, b in {(min(p), max(p)) for hs in holders.values() if len(hs) > 1 for k, x in enumerate(hs) for p in ((x, y) for y in hs[:k])}:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    kept = {i for i in sets if find(i) == i}
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in found} == kept
    import numpy as np

    encoder = bpe.Bpe(registry.vocabulary("word_bpe_49k.json"))
    for r in found[:50]:
        assert list(r.ids) == np.frombuffer(encoder.encode([texts[r.doc_id]])[0], np.int32).tolist() and r.n_tokens == len(r.ids)


def exact_words(text):
    import re

    return re.split("[ \t-\r]+", text)


def test_stages_keep_the_columns_and_survive_odd_documents(spark):
    docs = helpers.documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, helpers.empty(spark), SF).count() == 0
    assert corpus_pipeline.tokenize(spark, docs, SF).count() == len(helpers.records())


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_sql_twins(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df, want = registry.queries()[name](spark, SF), con.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(want.columns)
        assert sorted(map(str, df.select(columns).toPandas().itertuples(index=False, name=None))) == sorted(map(str, want.select(*[f'"{c}"' for c in columns]).df().itertuples(index=False, name=None))), name


