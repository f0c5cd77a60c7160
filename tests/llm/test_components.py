import random

import pytest

from mixtally.llm.components import components


def union(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in root if find(x) != x)


def random_links(seed):
    rng = random.Random(seed)
    return [(rng.randrange(-40, 40), rng.randrange(-40, 40)) for _ in range(rng.randrange(10, 60))]


LINKS = {
    "bridge": [(1, 4), (4, 3), (3, 5), (5, 2)],
    "two stars and a bridge": [(1, x) for x in range(10, 20)] + [(2, x) for x in range(20, 30)] + [(15, 3), (3, 25)],
    "path": [(x, x + 1) for x in range(50)],
    "loops and twice": [(7, 7), (5, 6), (6, 5), (5, 6)],
} | {f"random {k}": random_links(k) for k in range(4)}


@pytest.mark.parametrize("name", LINKS)
def test_each_node_has_the_least_of_its_component(spark, name):
    found = components(spark.createDataFrame(LINKS[name], "a long, b long")).collect()
    assert sorted((r.a, r.b) for r in found) == union(LINKS[name])
