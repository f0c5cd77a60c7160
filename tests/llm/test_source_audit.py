import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mixtally.llm import source_audit
from mixtally.llm.source_audit import audit, shares


def plain(rows, least, top=50):
    """The audit by dictionaries; rows of (text, lang, source)."""
    count, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        count[lang, source].update(words)
        df[lang].update(set(words))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update({t: count[lang, s][t] for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(count[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources - {s})
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, x, -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, x) in enumerate(found, 1)}
    return out


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = ["the", "The", "été", "a1b", "x", "日本", "longer", "so-so"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choices(words, [40] + [3] * (len(words) - 1), k=rng.randint(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s2", "s3", None, "é"])) for _ in range(n)]
    return rows + [(None, "en", "empty"), ("", "alone", "one"), ("the " * 5000, "en", "s1")] + rows[:5]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_dictionaries(spark, seed, monkeypatch):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, term int, value int").repartition(5)
    want = plain(rows, 5)
    found = audit(df, least=5).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    monkeypatch.setattr(source_audit, "BLOCK", 2)  # sources of a language are in several blocks
    monkeypatch.setattr(source_audit, "PIECE_BYTES", 200)
    monkeypatch.setattr(source_audit, "SLICE_ROWS", 4)
    found = audit(df, least=5).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_odd_tables(spark):
    df = spark.createDataFrame([("a a", None, None), ("b", None, "x"), (None, None, "y")], "text string, lang string, source string")
    assert {tuple(r) for r in audit(df).collect()} == {("", s, "pair", o, 0, k) for s, others in (("", "xy"), ("x", ["", "y"]), ("y", ["", "x"])) for k, o in enumerate(others, 1)}
    assert audit(df.limit(0)).collect() == []
    renamed = df.selectExpr("text AS lang", "lang AS source", "source AS text")
    assert audit(renamed, "lang", "source", "text").count() == 6


def test_shares_are_exact():
    count, total = np.array([0, 7, 10**15, 3], np.int64), np.array([1, 10**15, 4 * 10**15, 3], np.int64)
    assert shares(count, total, 12345).tolist() == [1 + 10**9 * (int(c) + 5) // (int(n) + 5 * 12345) for c, n in zip(count, total)]
    with pytest.raises(ValueError):
        shares(count, total * 100, 1)


def test_runs_across_batches():
    import pyarrow as pa

    rows = [("en", t, s, 1, 2) for t in "aabbbbc" for s in ("x",)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 2])], names=["lang", "term", "source", "n_docs", "count"]) for i in range(0, len(rows), 2)]
    found = [tuple(r.values()) for b in source_audit.kept_runs(iter(batches), 2) for r in b.to_pylist()]
    assert found == [("en", "a", "x", 4, 4, 1), ("en", "b", "x", 8, 8, 1)]
