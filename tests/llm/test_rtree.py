"""The R-tree of each page decides which of its nodes are paired."""

import numpy as np
import pytest

from mixtally.llm import jaccard
from mixtally.llm.jaccard import Pages, RTree, crossing, folded, stars


def page(rng, n, groups=64):
    """n nodes in a few families of near equal count vectors."""
    base = rng.poisson(1.0, (max(1, n // 4), groups))
    counts = np.maximum(base[rng.integers(0, len(base), n)] + rng.integers(-1, 2, (n, groups)) * (rng.random((n, groups)) < 0.05), 0).astype(np.int32)
    p = Pages.__new__(Pages)
    p.node, p.size, p.groups, p.row = np.arange(n), counts.sum(axis=1).astype(np.int64), np.full(n, groups), np.arange(n)
    p.matrix, p.coarse = {groups: counts}, folded(counts, jaccard.GROUPS)
    return p


@pytest.mark.parametrize("n", [2, 3, 4, 5, 8, 9, 17, 40, 150])
def test_search_finds_what_the_bound_allows(n):
    rng = np.random.default_rng(n)
    p = page(rng, n)
    own = np.sort(rng.permutation(n)[: max(2, n - 1)])
    tree = RTree(p, own, 80)
    assert sorted(np.concatenate(tree.leaves)) == own.tolist() and max(map(len, tree.leaves)) <= jaccard.LEAF + 1
    for x in own.tolist():
        assert sorted(tree.near(x)) == own[p.bound(own, x, 80) >= 0].tolist()


@pytest.mark.parametrize("n", [2, 3, 10, 60])
def test_every_page_is_searched_by_its_tree(n, monkeypatch):
    """Pairs of stars and between components come from the tree's answers and from nothing else, in pages of any size."""
    rng = np.random.default_rng(1)
    p = page(rng, n)
    p.matrix[64][:] = p.matrix[64][0]
    p.coarse, p.size = folded(p.matrix[64], jaccard.GROUPS), p.matrix[64].sum(axis=1).astype(np.int64)
    own = np.arange(n)
    assert len(stars(p, own, 80)) == n - 1 and len(crossing(p, own, own, 80, False)) > 0
    monkeypatch.setattr(RTree, "near", lambda self, x: np.zeros(0, np.int64))
    assert len(stars(p, own, 80)) == 0 and len(crossing(p, own, own, 80, False)) == 0


def test_boxes_prune():
    """Of families that lie apart, a search visits the leaves of its own."""
    rng = np.random.default_rng(3)
    p = page(rng, 256)
    seen = []
    real = Pages.bound
    p.bound = lambda own, x, percent: seen.append(len(own)) or real(p, own, x, percent)
    tree = RTree(p, np.arange(256), 80)
    for x in range(256):
        tree.near(x)
    assert np.mean(seen) < 128
