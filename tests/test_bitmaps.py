"""Packed masks, pairs and compositions, against sets of chains in Python."""

import hashlib
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import bitmaps, compositions, lattice
from eventloom.plans import rules
from tests.conftest import rows

ATOMS = {f"a{k}": {"op": "compare", "left": {"field": "chain.n_exposure"}, "cmp": "gte", "right": {"literal": k}} for k in (1, 3)} | {
    "b2": {"op": "compare", "left": {"field": "chain.n_interface"}, "cmp": "lte", "right": {"literal": 2}},
    "c": {"op": "compare", "left": {"field": "chain.outcome_type"}, "cmp": "eq", "right": {"literal": "x"}},
    "all": {"op": "compare", "left": {"field": "chain.n_exposure"}, "cmp": "gte", "right": {"literal": 0}},
    "none": {"op": "compare", "left": {"field": "chain.n_exposure"}, "cmp": "gte", "right": {"literal": 99}},
    "d": {"op": "compare", "left": {"field": "chain.n_interface"}, "cmp": "eq", "right": {"literal": 4}},
}


def held(name, c):
    return {"a1": c[3] >= 1, "a3": c[3] >= 3, "b2": c[4] <= 2, "c": c[5] == "x", "all": True, "none": False, "d": c[4] == 4}[name]


@pytest.fixture(scope="module", params=[40, 70_000])
def chains(spark, request):
    """(company, sequence, chain id, exposures, interfaces, type), in order; a company of the large case spans buckets."""
    rnd = random.Random(request.param)
    n = request.param
    company = [0] * (n // 2) + [1 + k // 3 for k in range(n - n // 2)]
    made = sorted((c, k, f"k{k}", rnd.randint(0, 5), rnd.randint(0, 5), rnd.choice("xy")) for k, c in enumerate(company))
    df = spark.createDataFrame(made, "company_id int, chain_sequence int, chain_id string, n_exposure int, n_interface int, outcome_type string")
    contexts = df.repartition(5).select(F.struct(*df.columns).alias("chain"), F.struct(F.lit(1).alias("n_middle")).alias("derived"))
    return made, bitmaps.numbered(contexts)


def number(bits):
    return sum(1 << k for k in bits)


def test_numbers_and_digests(spark, chains):
    made, contexts = chains
    companies = sorted({c[0] for c in made})
    got = {r.id: (r.chain_no, r.company_no) for r in contexts.select(F.col("chain.chain_id").alias("id"), "chain_no", "company_no").collect()}
    assert got == {c[2]: (k + 1, companies.index(c[0]) + 1) for k, c in enumerate(made)} if len(made) < 1000 else len(got) == len(made)
    for of, size, bits in (
        (bitmaps.of_chains, len(made), lambda a: [k for k, c in enumerate(made) if held(a, c)]),
        (bitmaps.of_companies, len(companies), lambda a: sorted({c[0] for c in made if held(a, c)})),
    ):
        found = {r.atom: (r.sha256, r.n) for r in bitmaps.digests(of(contexts, ATOMS), size).collect()}
        want = {a: bits(a) for a in ATOMS}
        assert found == {a: (hashlib.sha256(number(b).to_bytes((size + 7) // 8, "little")).hexdigest(), len(b)) for a, b in want.items() if b}


def test_golden_digest(spark):
    """Bits 0, 2 and 9 of 10: the bytes 05 02."""
    rows_ = spark.createDataFrame([(1,), (3,), (10,)], "n int").groupBy(F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits")).select(F.lit("x").alias("atom"), "bucket", "bits")
    assert rows(bitmaps.digests(rows_, 10)) == [("x", hashlib.sha256(b"\x05\x02").hexdigest(), 3)]


def test_counts_of_formulas(spark, chains):
    made, contexts = chains
    formulas = [(("a1",), ()), (("a3", "b2"), ()), ((), ("a3", "c")), (("b2",), ("c", "d", "none")), (("none",), ()), (("all", "a1", "c"), ("b2", "d")), (("a1",), ()), (("all",), ())]
    found = {r.formula: (r.n_chains, r.n_companies, r["class"]) for r in bitmaps.counts(contexts, bitmaps.of_chains(contexts, ATOMS), formulas, "company").collect()}
    seen = {}
    for k, (every, some) in enumerate(formulas):
        mine = [c for c in made if all(held(a, c) for a in every) and (not some or any(held(a, c) for a in some))]
        companies = frozenset(c[0] for c in mine)
        assert found.get(k, (0, 0))[:2] == (len(mine), len(companies))
        if mine:
            assert seen.setdefault(companies, found[k][2]) == found[k][2]
    assert len(set(seen.values())) == len(seen)


def test_pairs_equal_the_incidence_join(spark, chains):
    _, contexts = chains
    structural = ["b2", "d", "none"]
    allowed = {"a1": bytes([0b111]), "c": bytes([0b010]), "all": bytes([0b001])}
    got = bitmaps.pairs(contexts, bitmaps.of_chains(contexts, ATOMS), structural, allowed)
    incident = lattice.incidence(contexts, ATOMS)
    left, right = incident.filter(F.col("atom").isin("a1", "c", "all")), incident.filter(F.col("atom").isin(structural))
    joined = left.select(F.col("atom").alias("anchor"), "chain_id", "company_id").join(right.select(F.col("atom").alias("structural"), "chain_id"), "chain_id")
    want = joined.groupBy("anchor", "structural").agg(F.count(F.lit(1)).alias("n_chains"), F.count_distinct("company_id").alias("n_companies"))
    ok = F.expr("anchor = 'a1' OR anchor = 'c' AND structural = 'd' OR anchor = 'all' AND structural = 'b2'")
    assert rows(got, "anchor", "structural", "n_chains", "n_companies") == rows(want.filter(ok), "anchor", "structural", "n_chains", "n_companies")


def test_members_come_back(spark, chains):
    made, contexts = chains
    if len(made) < 1000:
        got = rows(bitmaps.members(contexts, bitmaps.of_chains(contexts, {"c": ATOMS["c"]})))
        assert got == sorted([("c", c[2]) for c in made if c[5] == "x"], key=str)


def test_compositions_equal_every_formula(spark, chains):
    made, contexts = chains
    if len(made) > 1000:
        pytest.skip("every formula in Python takes too long")
    least, total = (4, 2), len(made)
    found = {r.formula: (r.n_atoms, r.n_chains, r.n_companies, r.representative) for r in compositions.compose(contexts, ATOMS, *least).collect()}
    members = lambda every, some: frozenset(k for k, c in enumerate(made) if all(held(a, c) for a in every) and (not some or any(held(a, c) for a in some)))
    companies = lambda m: {made[k][0] for k in m}
    fits = lambda m: len(m) >= least[0] and len(companies(m)) >= least[1]
    names = [a for a in sorted(ATOMS) if fits(members((a,), ()))]
    every_of = [c for n in range(5) for c in itertools.combinations(names, n)]
    some_of = [()] + [c for n in (2, 3) for c in itertools.combinations(names, n) if len(members((), c)) < total]
    want, classes = {}, {}
    for e, s in itertools.product(every_of, some_of):
        if (e or s) and not set(e) & set(s) and len(e) + bool(s) <= 4:
            m = members(e, s)
            if fits(m) and len(m) < total:
                name = compositions.text((e, s))
                want[name] = (len(e) + len(s), len(m), len(companies(m)))
                classes.setdefault(m, []).append((len(e) + len(s), name))
    first = {name: min(group)[1] for group in classes.values() for _, name in group}
    assert found == {k: (*v, first[k]) for k, v in want.items()}


def test_formulas_as_rules(spark, chains):
    _, contexts = chains
    formula = (("a1",), ("c", "d"))
    rule = rules.canonical(compositions.rule(formula, ATOMS))
    rules.check_rule(json.loads(rules.canonical_json(rule)))
    n = contexts.filter(rules.compile_rule(rule)).count()
    assert bitmaps.counts(contexts, bitmaps.of_chains(contexts, ATOMS), [formula]).first().n_chains == n


def test_no_chains(spark):
    contexts = spark.createDataFrame([], "chain struct<company_id:int,chain_sequence:int,chain_id:string,n_exposure:int,n_interface:int,outcome_type:string>, derived struct<n_middle:int>")
    contexts = bitmaps.numbered(contexts)
    masks = bitmaps.of_chains(contexts, ATOMS)
    assert masks.count() == 0 and bitmaps.counts(contexts, masks, [(("a1",), ())]).count() == 0
    assert compositions.compose(contexts, ATOMS).count() == 0
