import math
import random

import pytest

from mixtally.operators import em

ROWS = [(1, 0, -1.0), (1, 1, -3.0), (2, 0, -2.0), (2, 2, -2.0), (3, 1, -1.0), (4, 1, -5.0), (4, 2, -1.0), (5, 0, -1.0), (6, 0, -900.0), (6, 1, -901.0)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "read_id long, key int, loglik double")


def plain_step(rows, f):
    """One evaluation over all reads and keys, in plain numbers; likelihoods shifted by the read's best."""
    reads = {}
    for r, k, ll in rows:
        reads.setdefault(r, {})[k] = ll
    single, new, n_multi = {}, dict.fromkeys(f, 0.0), 0
    for own in reads.values():
        if len(own) == 1:
            (k,) = own
            single[k] = single.get(k, 0) + 1
            continue
        n_multi += 1
        best = max(own.values())
        part = {k: f[k] * math.exp((own[k] if k in own else -150.0) - best) for k in f}
        m = sum(part.values())
        for k in f:
            new[k] += part[k] / m
    prior = sum(n for k, n in single.items() if k in f)
    return {k: (new[k] + single.get(k, 0)) / (n_multi + prior) for k in f}


def test_steps_match_plain_python(spark, monkeypatch):
    rows = [r for r in ROWS if r[0] != 6]
    f = {0: 0.5, 1: 0.3, 2: 0.2}
    want = plain_step(rows, f)
    got, _ = em.Likelihoods(frame(spark, rows)).step(f)
    multi, singles = em.split_single(frame(spark, rows))
    lazy = {r["key"]: r["f"] for r in em.em_step(multi, spark.createDataFrame(list(f.items()), "key int, f double"), singles).collect()}
    monkeypatch.setattr(em, "BROADCAST_KEYS", 1)
    joined, _ = em.Likelihoods(frame(spark, rows)).step(f)
    assert joined == pytest.approx(want)
    assert got == pytest.approx(want) and lazy == pytest.approx(want) and sum(want.values()) == pytest.approx(1)


def test_tiny_likelihoods_do_not_underflow(spark):
    got, ll = em.Likelihoods(frame(spark)).step({0: 0.5, 1: 0.3, 2: 0.2})
    assert all(math.isfinite(x) for x in got.values()) and math.isfinite(ll)


def test_plain_steps_raise_the_loglik(spark):
    lk = em.Likelihoods(frame(spark, [r for r in ROWS if r[0] not in (3, 5)]))
    f = {0: 1 / 3, 1: 1 / 3, 2: 1 / 3}
    seen = []
    for _ in range(6):
        f, ll = lk.step(f)
        seen.append(ll)
    assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:])) and sum(f.values()) == pytest.approx(1)


def test_estimate_finds_the_fixed_point(spark):
    out = em.Likelihoods(frame(spark)).estimate(min_freq=0.0, controls=em.Controls(tolerance=1e-9, max_evaluations=200))
    again, _ = em.Likelihoods(frame(spark)).step(out.freqs)
    assert out.converged and again == pytest.approx(out.freqs, abs=1e-6)


def test_cutoff_drops_rare_keys_and_their_single_reads(spark):
    rows = [(i, 0, -1.0) for i in range(200)] + [(200, 1, -1.0)] + [(201, 0, -1.0), (201, 1, -9.0)]
    out = em.Likelihoods(frame(spark, rows)).estimate(min_freq=0.05)
    assert set(out.freqs) == {0} and out.freqs[0] == pytest.approx(1) and out.mapped == 201


def test_nothing_mapped(spark):
    out = em.Likelihoods(frame(spark, [])).estimate()
    assert out.freqs == {} and out.converged


def test_squarem_jumps_to_the_full_cutoff():
    def still(f):
        return dict(f), 0.0

    out = em.squarem(still, {1: 0.6, 2: 0.4}, 0.01)
    assert out.converged and out.freqs == pytest.approx({1: 0.6, 2: 0.4}) and out.evaluations < 10


def test_squarem_stops_at_its_budget():
    def swing(f):
        return {1: f[2], 2: f[1]}, 0.0

    out = em.squarem(swing, {1: 0.9, 2: 0.1}, 0.0, em.Controls(max_evaluations=30))
    assert not out.converged and out.evaluations >= 30


def test_collapse(spark):
    taxa = spark.createDataFrame([(0, "a"), (1, "a"), (3, "a"), (2, "b")], "ref_id int, label string")
    lk = spark.createDataFrame([(1, 0, -1.0), (1, 1, -2.0), (1, 9, -4.0)], "read_id long, ref_id int, loglik double")
    got = {r["key"]: r["loglik"] for r in em.collapse(lk, taxa).collect()}
    assert got["a"] == pytest.approx(math.log((math.exp(-1) + math.exp(-2) + math.exp(-150)) / 3)) and got["9"] == pytest.approx(-4.0)


def test_collapse_of_deep_likelihoods(spark):
    taxa = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b")], "ref_id int, label string")
    lk = spark.createDataFrame([(1, 0, -900.0), (1, 1, -900.0), (1, 2, -2000.0), (2, 9, -5000.0)], "read_id long, ref_id int, loglik double")
    got = {(r.read_id, r["key"]): r["loglik"] for r in em.collapse(lk, taxa).collect()}
    assert got == {(1, "a"): pytest.approx(-900.0), (1, "b"): pytest.approx(-150 - math.log(2)), (2, "9"): pytest.approx(-5000.0)}


def test_posterior_of_deep_likelihoods(spark):
    """Of likelihoods far below the floor nearly all weight is on keys that the read doesn't hit; where all are hit, they compare."""
    freqs = spark.createDataFrame([(0, 0.5), (1, 0.25), (2, 0.25)], "key int, f double")
    got = {(r.read_id, r["key"]): r.p for r in em.posterior(frame(spark, [(6, 0, -900.0), (6, 1, -901.0), (7, 0, -152.0), (7, 1, -152.0)]), freqs).collect()}
    assert got[6, 0] == pytest.approx(0) and got[6, 1] == pytest.approx(0)
    low = math.exp(-2)
    assert got[7, 0] == pytest.approx(0.5 * low / (0.75 * low + 0.25)) and got[7, 1] == pytest.approx(0.25 * low / (0.75 * low + 0.25))


def test_posterior(spark):
    freqs = spark.createDataFrame([(0, 0.5), (1, 0.5)], "key int, f double")
    got = {(r.read_id, r["key"]): (r.p, r.status) for r in em.posterior(frame(spark), freqs).collect()}
    assert got[1, 0][0] + got[1, 1][0] == pytest.approx(1) and got[1, 0][0] == pytest.approx(1 / (1 + math.exp(-2)))
    assert got[3, 1] == (1.0, "single") and got[2, 0][1] == "multi"
    only2 = spark.createDataFrame([(2, 1.0)], "key int, f double")
    gone = {r.read_id: r.status for r in em.posterior(frame(spark), only2).collect() if r["key"] is None}
    assert gone == {1: "even", 3: "dropped", 5: "dropped", 6: "even"}


def plain_em(rows, steps):
    """Frequencies after so many plain evaluations of the map over a full read x key table."""
    import numpy as np

    reads, keys = sorted({r for r, _, _ in rows}), sorted({k for _, k, _ in rows})
    like, hits = np.full((len(reads), len(keys)), math.exp(-150)), np.zeros(len(reads), int)
    for r, k, ll in rows:
        like[reads.index(r), keys.index(k)] = math.exp(ll)
        hits[reads.index(r)] += 1
    lone = like[hits == 1].argmax(axis=1)
    singles, like = np.bincount(lone, minlength=len(keys)), like[hits > 1]
    f = np.full(len(keys), 1 / len(keys))
    for _ in range(steps):
        part = like * f
        f = ((part / part.sum(axis=1, keepdims=True)).sum(axis=0) + singles) / len(reads)
    return dict(zip(keys, f.tolist()))


def likelihood_rows(seed, reads=300):
    rng = random.Random(seed)
    return [(r, k, -rng.random() * 12) for r in range(reads) for k in rng.sample(range(9), rng.choice([1, 2, 3, 5]))]


def test_accelerated_frequencies_are_the_plain_ones(spark):
    """Values of the accelerated EM against 30,000 plain evaluations."""
    rows = likelihood_rows(3)
    out = em.Likelihoods(spark.createDataFrame(rows, "read_id long, key int, loglik double")).estimate(min_freq=0.0, controls=em.Controls(tolerance=1e-14))
    want = plain_em(rows, 30_000)
    assert out.converged and out.evaluations < 500
    for k, v in want.items():
        assert out.freqs.get(k, 0.0) == pytest.approx(v, abs=1e-9)


def test_a_killed_run_goes_on(spark, tmp_path):
    """A search that dies in its fourth cycle ends, when it is run again, as one that didn't, with no evaluation made twice."""
    df = spark.createDataFrame(likelihood_rows(4), "read_id long, key int, loglik double")
    controls = em.Controls(tolerance=1e-10)
    want = em.Likelihoods(df).estimate(0.001, controls)
    folder = str(tmp_path / "em")

    class Killed(Exception):
        pass

    model, saved = em.Likelihoods(df), []
    real, log = model.step, em.CycleLog.add

    def dying(freqs):
        if len(saved) == 3:
            raise Killed
        return real(freqs)

    model.step = dying
    em.CycleLog.add = lambda self, state: (log(self, state), saved.append(state["count"]))
    try:
        with pytest.raises(Killed):
            model.estimate(0.001, controls, folder)
    finally:
        em.CycleLog.add = log
    assert len(list((tmp_path / "em").glob("cycle-*"))) == em.CycleLog.KEPT
    (tmp_path / "em" / "cycle-9-unfinished").mkdir()  # what a run leaves that dies while it writes
    again, made = em.Likelihoods(df), []
    step = again.step
    again.step = lambda freqs: (made.append(1), step(freqs))[1]
    got = again.estimate(0.001, controls, folder)
    assert got.freqs == pytest.approx(want.freqs, abs=1e-12) and (got.evaluations, got.converged, got.mapped) == (want.evaluations, want.converged, want.mapped)
    assert len(made) == want.evaluations - saved[-1] + 1  # and the last likelihood
    with pytest.raises(ValueError, match="other"):
        em.Likelihoods(df.where("read_id < 200")).estimate(0.001, controls, folder)


def test_likelihoods_are_numbered_vectors(spark):
    """What an evaluation reads is a row for each batch, numbered by the keys broadcast: it was a row of arrays for each read before, put
    together by a join with the keys' numbers. Reads with equal rows are still one."""
    rows = [(i, k, -1.0 - (i % 7) - ord(k) / 50) for i in range(300) for k in "abc"] + [(1000, "d", -1.0)]
    model = em.Likelihoods(spark.createDataFrame(rows, "read_id long, key string, loglik double").coalesce(1))
    got = model.classes.collect()
    assert model.n_multi == 300 and len(got) < 8 and sum(len(r["w"]) // 8 for r in got) == 7
    assert "Join" not in model.classes._jdf.queryExecution().optimizedPlan().toString()
    f = {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}
    want = plain_step(rows, f)
    assert model.step(f)[0] == pytest.approx(want)


def test_posterior_groups_reads_once(spark):
    """Reads without a surviving key are rows of the same plan, not of a second one beside it."""
    got = em.posterior(frame(spark), spark.createDataFrame([(0, 0.6), (1, 0.4)], "key int, f double"))
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.read_id, r.key, r.status) for r in got.collect()} >= {(3, 1, "single"), (4, 1, "multi")}


def test_the_query_searches_to_its_end(spark):
    """em_squarem's frequencies against 3,000 plain evaluations over all order lines: at a tolerance of 1e-6 it stopped after a few evaluations."""
    from mixtally import catalogue

    sf = "/root/testdata/sf0.001"
    got = {r["key"]: r for r in catalogue.em_squarem(spark, sf).collect()}
    rows = [(r.read_id, r["key"], r.loglik) for r in catalogue.likelihoods(spark, sf).collect()]
    want = plain_em(rows, 3_000)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k].f == pytest.approx(v, abs=1e-9) and got[k].expected == pytest.approx(v * len({r for r, _, _ in rows}), abs=1e-5)
