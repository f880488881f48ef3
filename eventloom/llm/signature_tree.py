"""Signature trees: candidates of a Jaccard self-join inside groups of documents.

A leaf is one set, known by its size and a bitmap of its hashed tokens. An inner node holds
the OR of its children's bitmaps, the range of their sizes, the largest excess (tokens
beyond the bits they set) and the component that all of them already belong to, if it is
one. Two nodes are traversed together; the pair goes when the sizes are too far apart, when
the common bits and the excess can't make up the overlap that the threshold asks for, or
when both hold documents of one and the same component.

The trees of many groups stand side by side in a forest, a level in one array, so that
small groups are traversed by the same steps as large ones, and all of them at once.

All bounds are upper bounds of the overlap, so no pair at or over the threshold is lost.
"""

from __future__ import annotations

import numpy as np

#: Fewest and most bits of a bitmap; between them it is SPREAD times the power of 2 next to the set's size.
LEAST_BITS, MOST_BITS, SPREAD = 1 << 9, 1 << 18, 4
FAN_OUT = 8
#: Node pairs that go down at once, each of which may become FAN_OUT squared ones, and words of 64 bits compared at once.
SLICE_PAIRS, SLICE_WORDS = 1 << 13, 1 << 19


def width(n: int) -> int:
    """Bits of the bitmap of a set of n tokens. Sets within the threshold differ by a factor of 2 at most."""
    return min(max(SPREAD << max(n - 1, 0).bit_length(), LEAST_BITS), MOST_BITS)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """The bitmap of a set of 64-bit token hashes."""
    size = width(len(tokens))
    bits = np.zeros(size, np.uint8)
    bits[(tokens >> np.uint64(7)) & np.uint64(size - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of half the width, for a comparison with sets that have such."""
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


def popcount(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


class Sets:
    """Rows to be joined: their group, size, component and bitmap, the bitmaps kept by width."""

    def __init__(self, group: np.ndarray, n: np.ndarray, component: np.ndarray, packed: list[bytes]):
        self.group, self.n, self.component = group, n, component
        self.words = np.fromiter(map(len, packed), np.int64, len(packed)) // 8
        self.at = np.zeros(len(packed), np.int64)
        self.bits: dict[int, np.ndarray] = {}
        for words in np.unique(self.words).tolist():
            rows = np.flatnonzero(self.words == words)
            self.at[rows] = np.arange(len(rows))
            self.bits[words] = np.frombuffer(b"".join([packed[k] for k in rows]), np.uint64).reshape(-1, words)

    def of(self, rows: np.ndarray, words: int) -> np.ndarray:
        """Bitmaps of rows of one width, which is ``words`` or twice that."""
        own = int(self.words[rows[0]])
        found = self.bits[own][self.at[rows]]
        return found if own == words else folded(found)


class Forest:
    """A tree for each group of some rows. Levels go from the leaves (0) to the roots, one for each group."""

    def __init__(self, sets: Sets, rows: np.ndarray, words: int):
        bits, group, size, component = sets.of(rows, words), sets.group[rows], sets.n[rows], sets.component[rows]
        # Neighbours in a tree: the same component, then about the same size.
        order = np.lexsort((size, component, group))
        self.rows = rows[order]
        group, size, component, bits = group[order], size[order], component[order], bits[order]
        one = np.ones(len(rows), bool)
        self.levels = [(group, size, size, bits, size - popcount(bits), component, one)]
        self.first: list[np.ndarray] = []
        self.count: list[np.ndarray] = []
        while True:
            group, low, high, bits, excess, component, one = self.levels[-1]
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            if len(starts) == len(group) and len(self.levels) > 1:
                break
            place = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
            at = np.flatnonzero(place % FAN_OUT == 0)
            self.first.append(at)
            self.count.append(np.diff(np.r_[at, len(group)]))
            pure = np.minimum.reduceat(component, at) == np.maximum.reduceat(component, at)
            self.levels.append((group[at], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.bitwise_or.reduceat(bits, at), np.maximum.reduceat(excess, at), component[at], pure & np.logical_and.reduceat(one, at)))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes of a level, and for each the position of its parent in ``nodes``."""
        count = self.count[level - 1][nodes]
        parent = np.repeat(np.arange(len(nodes)), count)
        step = np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count)
        return self.first[level - 1][nodes][parent] + step, parent


def _keep(a: Forest, b: Forest, la: int, lb: int, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which node pairs may hold a pair at the threshold, and the bound of their overlap."""
    _, low_a, high_a, bits_a, excess_a, component_a, one_a = a.levels[la]
    _, low_b, high_b, bits_b, excess_b, component_b, one_b = b.levels[lb]
    near = (100 * high_a[i] >= percent * low_b[j]) & (100 * high_b[j] >= percent * low_a[i])
    near &= ~(one_a[i] & one_b[j] & (component_a[i] == component_b[j]))
    bound = np.zeros(len(i), np.int64)
    every = np.flatnonzero(near)
    step = max(SLICE_WORDS // bits_a.shape[1], 1)
    for k in range(0, len(every), step):
        at = every[k : k + step]
        bound[at] = popcount(bits_a[i[at]] & bits_b[j[at]]) + np.minimum(excess_a[i[at]], excess_b[j[at]])
    near &= (100 + percent) * bound >= percent * (low_a[i] + low_b[j])
    return near, bound


def traverse(a: Forest, b: Forest | None, percent: int):
    """Yields leaf pairs (rows) with the bound of their overlap, of the trees of one group; b None: within a."""
    within = b is None
    b = a if within else b
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    _, i, j = np.intersect1d(a.levels[la][0], b.levels[lb][0], assume_unique=True, return_indices=True)
    stack = [(la, lb, i, j)]
    while stack:
        la, lb, i, j = stack.pop()
        if within:
            half = (i < j) if la == 0 else (i <= j)
            i, j = i[half], j[half]
        keep, bound = _keep(a, b, la, lb, i, j, percent)
        i, j, bound = i[keep], j[keep], bound[keep]
        if not len(i):
            continue
        if la == lb == 0:
            yield a.rows[i], b.rows[j], bound
            continue
        if len(i) > SLICE_PAIRS:
            stack += [(la, lb, i[at : at + SLICE_PAIRS], j[at : at + SLICE_PAIRS]) for at in range(0, len(i), SLICE_PAIRS)]
            continue
        # Go down in the higher forest, or in both.
        down_a, down_b = la >= lb and la > 0, lb >= la and lb > 0
        if down_a:
            i, parent = a.children(la, i)
            j = j[parent]
        if down_b:
            j, parent = b.children(lb, j)
            i = i[parent]
        stack.append((la - down_a, lb - down_b, i, j))


def candidates(sets: Sets, in_b: np.ndarray, across: np.ndarray, percent: int):
    """Yields candidate row pairs (i, j, bound) of each group, those within a component left out.

    across: rows of groups of which only pairs between the two sides count; in_b: rows of
    the second side there. A forest for each width; those of neighbouring widths are joined.
    """

    def by_width(rows):
        return {w: rows[sets.words[rows] == w] for w in np.unique(sets.words[rows]).tolist()}

    of = by_width(np.flatnonzero(~across))
    for words, rows in of.items():
        forest = Forest(sets, rows, words)
        yield from traverse(forest, None, percent)
        if 2 * words in of:
            yield from traverse(forest, Forest(sets, of[2 * words], words), percent)
    of_a, of_b = by_width(np.flatnonzero(across & ~in_b)), by_width(np.flatnonzero(across & in_b))
    for words, rows in of_a.items():
        for other in (words // 2, words, 2 * words):
            if other in of_b:
                common = min(words, other)
                yield from traverse(Forest(sets, rows, common), Forest(sets, of_b[other], common), percent)
