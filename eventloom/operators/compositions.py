"""Formulas put together from atoms, level by level: ALL of up to four rules, at most one of them an ANY of up to three atoms.

A conjunction holds for no more chains and companies than each of its parts, so conjunctions grow
from supported ones only (Apriori), and each level is counted in one pass over the packed masks.
ANY grows with its parts: one that holds for every chain says nothing, nor does any that
contains it. ALL with an ANY is bounded by the sum of what it holds for with each atom alone.

An atom stands at most once in a formula, as a & (a | b) is a, and no ANY holds for every chain. Formulas that hold for the
same chains are one class, which the shortest stands for, then the first in order of text.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators import bitmaps
from eventloom.operators.bitmaps import Formula
from eventloom.operators.review import bounded
from eventloom.operators.storage import written

#: The bounds of the grammar, and the number of formulas beyond which there is no result.
MOST_ALL, MOST_ANY, MOST_FORMULAS = 4, 3, 250_000


def text(formula: Formula) -> str:
    """Atoms in order, joined by & and |; an ANY inside an ALL comes last, in brackets."""
    every, some = formula
    any_of = " | ".join(some)
    return " & ".join([*every, f"({any_of})" if every else any_of] if some else every)


def rule(formula: Formula, atoms: dict[str, dict]) -> dict:
    """The formula as a rule."""
    every, some = ([atoms[a] for a in part] for part in formula)
    any_of = [{"op": "any", "rules": some} if len(some) > 1 else some[0]] if some else []
    children = [*every, *any_of]
    return children[0] if len(children) == 1 else {"op": "all", "rules": children}


def _conjunctions(supported: set[tuple], size: int) -> list[tuple]:
    """Conjunctions of ``size`` atoms all of whose parts are supported, from those that share all but the last atom."""
    by_head: dict[tuple, list] = {}
    for part in sorted(supported):
        by_head.setdefault(part[:-1], []).append(part[-1])
    made = (head + pair for head, tails in by_head.items() for pair in combinations(tails, 2))
    return [c for c in made if all(c[:k] + c[k + 1 :] in supported for k in range(size - 2))]


class _Levels:
    """Counts of formulas, a job for each batch of new ones."""

    def __init__(self, contexts: DataFrame, masks: DataFrame, least: tuple[int, int]):
        self.contexts, self.masks, self.least, self.found = contexts, masks, least, {}

    def count(self, formulas: list[Formula]) -> None:
        new = [f for f in formulas if f not in self.found]
        bounded(len(self.found) + len(new), MOST_FORMULAS, "formulas")
        if new:
            self.found |= dict.fromkeys(new, (0, 0, None))
            for r in bitmaps.counts(self.contexts, self.masks, new, classes="chain").collect():  # MOST_FORMULAS rows at most
                self.found[new[r["formula"]]] = (r["n_chains"], r["n_companies"], r["class"])

    def supported(self, formula: Formula) -> bool:
        n, m, _ = self.found[formula]
        return n >= self.least[0] and m >= self.least[1]


def compose(contexts: DataFrame, atoms: dict[str, dict], min_chains: int = 5, min_companies: int = 5, most_all: int = MOST_ALL, most_any: int = MOST_ANY) -> DataFrame:
    """Every supported formula of the grammar that doesn't hold for every chain: formula, n_atoms, n_chains, n_companies, class, representative.

    contexts: as bitmaps.numbered() has them. atoms: rules by name; names without ``&``, ``|`` and brackets.
    """
    spark = contexts.sparkSession
    total = contexts.count()
    levels = _Levels(contexts, written(bitmaps.of_chains(contexts, atoms)), (min_chains, min_companies))
    levels.count([((a,), ()) for a in sorted(atoms)])
    singles = [a for a in sorted(atoms) if levels.supported(((a,), ()))]
    # ANY: of supported atoms, as every frozen atom is one.
    any_of, grown = [], [(a,) for a in singles if levels.found[((a,), ())][0] < total]
    for size in range(2, most_any + 1):
        made = _conjunctions(set(grown), size)
        levels.count([((), c) for c in made])
        grown = [c for c in made if levels.found[((), c)][0] < total]
        any_of += grown
    # ALL of atoms. Pairs that aren't supported are kept as counts: they bound ALL with an ANY.
    alls, supported = [(a,) for a in singles], {(a,) for a in singles}
    for size in range(2, most_all + 1):
        made = _conjunctions(supported, size)
        levels.count([(c, ()) for c in made])
        supported = {c for c in made if levels.supported((c, ()))}
        alls += sorted(supported)
    mixed = []
    for base in alls:
        if len(base) < most_all:
            most = levels.found[(base, ())][0]
            # Where base with a wasn't counted, a alone bounds it.
            reach = {a: levels.found.get((tuple(sorted({*base, a})), ()), levels.found[((a,), ())])[0] for a in singles if a not in base}
            mixed += [(base, c) for c in any_of if not set(base) & set(c) and min(most, sum(reach[a] for a in c)) >= min_chains]
    levels.count(mixed)
    rows = [(text(f), sum(map(len, f)), n, m, k) for f, (n, m, k) in levels.found.items() if n < total and levels.supported(f)]
    made = spark.createDataFrame(rows, "formula string, n_atoms int, n_chains long, n_companies long, class string")
    first = Window.partitionBy("class").orderBy("n_atoms", "formula")
    return made.withColumn("representative", F.first("formula").over(first))
