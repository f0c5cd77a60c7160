import math

import numpy as np
import pytest

from mixtally.llm import hard_negatives
from mixtally.llm.hard_negatives import Side, Targets, compare, mine


def plain(rows):
    """Hard negatives by comparing each anchor with every row; rows of (vec_id, vector, label)."""
    kept = {}
    for vec_id, vector, label in rows:
        if vec_id is not None and vector is not None and label is not None and all(x is not None and math.isfinite(x) for x in vector):
            row = (label, [math.floor(256 * x) for x in vector])
            kept[vec_id] = min(kept.get(vec_id, row), row)
    out = set()
    for a, (label, v) in kept.items():
        if a % 50 == 0:
            score = sorted((-sum(x * y for x, y in zip(v, w)), b, other == label) for b, (other, w) in kept.items() if b != a)
            for ps, p, _ in [s for s in score if s[2]][:5]:
                fits = [s for s in score if not s[2] and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
                out |= {(a, p, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(fits, 1)}
    return out


def table(seed, n=700, dims=12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dims))
    labels = np.where(rng.random(n) < 0.4, 0, rng.integers(0, 4, n))
    x = (centre[labels] + rng.normal(scale=0.8, size=(n, dims))).round(1)  # many ties
    rows = [(i, [float(c) for c in x[i]], int(labels[i])) for i in range(n)]
    odd = [(1000, None, 1), (1001, [1.0, None], 1), (1050, [float("nan")] * dims, 0), (1002, [float("inf")], 2), (1003, [0.5], None), (None, [0.5], 1), (1100, [], 1), (1101, [3.0, 1.0], 1), (1150, [3.0, 1.0, 0.0], 1)]
    return rows + odd + rows[100:120] + [(50, [9.0] * dims, 3), (150, [0.0] * dims, 0)]


@pytest.mark.parametrize("seed, block, packed, tile", [(1, 8192, 4096, 512), (2, 3, 50, 7)])
def test_equals_every_pair(spark, monkeypatch, seed, block, packed, tile):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "PACKED", packed)
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    rows = table(seed)
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, label int, score int").repartition(3)
    found = mine(df).collect()
    want = plain(rows)
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 50


def test_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert mine(spark.createDataFrame([], kind)).collect() == []
    assert mine(spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 2)], kind)).collect() == []
    strange = spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 1), (52, [0.75], 2)], "score int, `a.b` array<float>, other_id int")
    assert [tuple(r) for r in mine(strange, "score", "a.b", "other_id").collect()] == [(50, 51, 1, 52, 65536, 49152)]
    with pytest.raises(Exception, match="beyond"):
        mine(spark.createDataFrame([(50, [1e9], 1)], kind)).collect()


def test_bounds_discard_most_pairs():
    """Where leading components carry the products, few pairs are verified, and none that matters is lost."""
    rng = np.random.default_rng(5)
    scale = 300 * 0.8 ** np.arange(32)
    x = np.floor(rng.normal(size=(3000, 32)) * scale).astype(np.int64)
    turn = np.linalg.eigh(x.T.astype(float) @ x)[1][:, ::-1].copy()
    cuts, far = [8, 16, 24], np.full(60, 1 << 62)
    ids, labels = np.arange(3000), np.zeros(3000, np.int64)
    targets = Targets(60, np.arange(60), -far, far, 5)
    verified = compare(targets, Side(x[:60], turn, cuts), ids[:60], labels[:60], Side(x, turn, cuts), ids, labels, True, cuts)
    assert verified < 60 * 3000 / 4
    for a in range(60):
        score = x @ x[a]
        best = sorted((-score[b], b) for b in range(3000) if b != a)[:5]
        assert sorted(zip((-targets.score[targets.target == a]).tolist(), targets.row[targets.target == a].tolist())) == best
