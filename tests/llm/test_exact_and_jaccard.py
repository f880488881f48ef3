import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from eventloom.llm import exact, jaccard, signature_tree
from tests.conftest import rows
from tests.llm import helpers

SPACE = re.compile("[ \t-\r]+")
WORD = re.compile("[^ \t-\r]+")


def brute_exact(records):
    groups = {}
    for i, text, *_ in records:
        groups.setdefault(SPACE.sub(" ", text or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = first and i == keep
            first = False
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return out


def order(found):
    return sorted(found, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_exact_dedup(spark):
    assert rows(exact.exact_dedup(helpers.documents(spark))) == order(brute_exact(helpers.records()))
    assert exact.exact_dedup(helpers.empty(spark)).count() == 0


def test_exact_dedup_splits_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(exact, "HOT_LEAST", 5)
    data = [(k, "same  text" if k % 3 else f"own {k}") for k in range(300)] + [(1000, "same text"), (None, "same\ttext"), (1, "same text")]
    data += [(None, "nobody's") for _ in range(40)] + [(None, "somebody's") for _ in range(40)] + [(7, "somebody's")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = order(brute_exact(data))
    assert rows(exact.exact_dedup(df)) == want
    runs, _ = exact._runs(df, "doc_id", "text", [])
    assert runs.filter("salt >= 0").groupBy("fp", "salt").count().filter("count > 15").count() == 0
    assert order((r.doc_id,) for r in exact.keep_one(df).collect()) == order((r[0],) for r in want if r[3])


def test_exact_dedup_splits_texts_with_many_characters(spark, monkeypatch):
    monkeypatch.setattr(exact, "HOT_CHARS", 1000)
    data = [(k, "x" * 100) for k in range(100)] + [(k, f"own {k}") for k in range(100, 120)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(exact.exact_dedup(df)) == order(brute_exact(data))
    assert exact._runs(df, "doc_id", "text", [])[0].filter("salt >= 0").select("salt").distinct().count() == 10


def test_keep_one_with_names_of_its_own(spark):
    """Columns that are called like the operator's own keep their values."""
    own = ("doc_id", "norm", "fp", "salt", "prefix", "run", "head", "whole", "run_keep", "run_size", "hot_text", "hot_keep", "hot_size", "hot_stays", "text_sha256", "a.b")
    df = spark.createDataFrame([(k, f"text {k % 3}", *[f"{c}{k}" for c in own]) for k in range(6)], "id long, body string, " + ", ".join(f"`{c}` string" for c in own))
    found = exact.keep_one(df, "id", "body")
    assert found.columns == df.columns
    assert rows(found) == [(k, f"text {k}", *[f"{c}{k}" for c in own]) for k in range(3)]


def test_content_sort_moves_texts_once(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = exact.exact_dedup(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_keep_one_keeps_the_columns(spark):
    docs = helpers.documents(spark)
    found = exact.keep_one(docs)
    assert found.columns == docs.columns
    assert sorted(r.doc_id is None or r.doc_id for r in found.collect()) == sorted([1, 3, 4, 6, 7, 8, 10, 12, 14, 15])
    assert exact.keep_one(helpers.empty(spark)).count() == 0


def shingles(text, n=5):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute_jaccard(records, percent=75):
    known = [(k, r[0], shingles(r[1])) for k, r in enumerate(records)]
    parent = list(range(len(known)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    # Rows with equal identifiers are judged by their own texts; equal sets are one class.
    for a, i, s in known:
        for b, j, t in known[:a]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t):
                parent[find(a)] = find(b)
    least = {}
    for k, i, s in known:
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), None if i is None else least[find(k)] if s else i) for k, i, s in known]


def test_jaccard(spark):
    want = order(brute_jaccard(helpers.records()))
    assert rows(jaccard.similar(helpers.documents(spark))) == want
    assert {r[0]: r[2] for r in want if r[0]}[3] == 1 and {r[0]: r[2] for r in want if r[0]}[9] == 7
    assert jaccard.similar(helpers.empty(spark)).count() == 0


def near_copies(n, seed):
    """Chains of edits around the threshold, a passage that many share, and unrelated texts."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(80)]
    passage = " ".join(f"p{k}" for k in range(30))
    out = []
    for k in range(n):
        kind = rnd.random()
        if kind < 0.5:
            words = list(base)
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = f"e{rnd.randint(0, 10**6)}"
            if rnd.random() < 0.1:
                base = words
            out.append((k, " ".join(words)))
        elif kind < 0.8:
            out.append((k, passage + " " + " ".join(f"u{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(1, 40)))))
        else:
            out.append((k, " ".join(f"z{rnd.randint(0, 30)}" for _ in range(rnd.randint(1, 9)))))
    return out


@pytest.mark.parametrize("chunk, hot, seed", [(1024, 32, 3), (16, 8, 3), (5, 8, 4)])
def test_jaccard_around_the_threshold(spark, monkeypatch, chunk, hot, seed):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "HOT_LEAST", hot)
    data = near_copies(250, seed)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert rows(jaccard.similar(df)) == order(brute_jaccard(data))


def test_jaccard_tells_sets_with_one_number_apart(spark, monkeypatch):
    """A 64-bit number that different sets share doesn't make them one class."""
    import inspect
    import textwrap

    from eventloom.llm import jaccard as module

    # Workers import the module anew, so a short first hash is built from its source.
    source = inspect.getsource(module).replace("def class_of(", "def _whole(").replace("\ndef _class_among(", "\ndef class_of(tokens, second=False):\n    found = _whole(tokens, second)\n    return found if second else found % 7\n\n\ndef _class_among(")
    short = {"__name__": "short"}
    exec(compile(textwrap.dedent(source), "short", "exec"), short)  # noqa: S102
    data = near_copies(60, 5)
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(short["similar"](df)) == order(brute_jaccard(data))


def test_one_of_each_judges_rows_by_their_own_text(spark):
    a, b = helpers.prose(1), helpers.prose(2)
    data = [(1, a), (2, a + " more"), (2, b), (3, b + " more"), (4, a), (4, a), (5, None), (5, None), (None, a), (2, b)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert order(rows(jaccard.one_of_each(df))) == order([(1, a), (2, b), (5, None), (5, None), (None, a)])


def test_one_of_each(spark):
    docs = helpers.documents(spark)
    found = jaccard.one_of_each(docs)
    assert found.columns == docs.columns
    assert {r.doc_id for r in found.collect()} == {None, 1, 4, 5, 6, 7, 8, 10, 12, 14, 15}


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    first, rest = df.filter("a % 2 = 0"), df.filter("a % 2 = 1")
    found = dict(rows(jaccard.components(rest, jaccard.components(first))))
    assert all(found.get(v, v) == find(v) for v in parent)


def test_tree_loses_no_pair():
    import numpy as np

    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**63, 3000).astype(np.uint64)
    sets = []
    for k in range(300):
        size = int(rnd.choice([5, 60, 64, 500, 1500]))
        own = np.concatenate([base[:size], rnd.integers(0, 2**63, int(rnd.integers(0, size // 3 + 1))).astype(np.uint64)])
        sets.append(np.unique(own[rnd.random(len(own)) > rnd.choice([0, 0.1])]))
    n = np.array([len(s) for s in sets])
    packed = [signature_tree.bitmap(s).tobytes() for s in sets]
    group = np.repeat([0, 1], [220, 80])
    alike = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if group[i] == group[j] and alike(i, j)}

    def found(component, second, across):
        forest = signature_tree.Sets(group, n, component, packed)
        return [(i, j, o) for batch in signature_tree.candidates(forest, second, across, 75) for i, j, o in zip(*(x.tolist() for x in batch))]

    no, yes = np.zeros(300, bool), np.ones(300, bool)
    pairs = found(np.arange(300), no, no)
    got = {(min(i, j), max(i, j)) for i, j, _ in pairs}
    assert want <= got and len(got) == len(pairs)
    assert all(group[i] == group[j] and o >= len(np.intersect1d(sets[i], sets[j])) for i, j, o in pairs)
    second = np.arange(300) % 2 == 1
    got = [(min(i, j), max(i, j)) for i, j, _ in found(np.arange(300), second, yes)]
    assert {(i, j) for i, j in want if (i + j) % 2} <= set(got) and len(set(got)) == len(got)
    assert all((i + j) % 2 for i, j in got)
    assert found(np.zeros(300, int), no, no) == []
