import itertools
import random

import pytest

from mixtally.llm import license_scan

T = license_scan.TEMPLATES


def edited(text, places):
    words = text.split()
    return " ".join(f"zq{i}" if i in places else w for i, w in enumerate(words))


@pytest.mark.parametrize("name", sorted(T))
def test_notices_are_found_down_to_the_least_coverage(spark, name):
    """Each set of changed words of short notices, and some of long ones, that leaves 80 % of the words."""
    n = len(license_scan._words(T[name]).hashes())
    words = len(T[name].split())
    most = (n - license_scan.Index(T).need[license_scan.Index(T).names.index(name)]) if n == words else max(0, n // 5 - 2 * (n - words))
    rng = random.Random(1)
    sets = [c for k in range(most + 1) for c in itertools.combinations(range(words), k)] if words <= 13 else [()] + [tuple(rng.sample(range(words), most)) for _ in range(20)] + [tuple(range(1, 3 * most, 3))[:most]]
    docs = spark.createDataFrame([(i, "some words before " + edited(T[name], c) + " and behind") for i, c in enumerate(sets)], "doc_id long, text string")
    got = {r.doc_id for r in license_scan.scan_licenses(docs, templates={name: T[name]}).collect()}
    assert got == set(range(len(sets)))


def test_inserted_words(spark):
    text = "Released publicly under the MIT new License"
    docs = spark.createDataFrame([(0, text), (1, "license " * 3000), (2, "released x y z under q r the s MIT")], "doc_id long, text string")
    found = license_scan.scan_licenses(docs).where("template = 'MIT line'").collect()
    assert [(r.doc_id, r.coverage, r.matched) for r in found] == [(0, 1.0, text)]


def test_long_insertions_and_whole_texts(spark):
    """Words inserted beyond the band, in one place or two, and complete license texts."""
    t = license_scan.TEMPLATES
    grant = t["MIT grant"].split()
    for at in (10, 30, 55):
        text = " ".join(grant[:at] + [f"extra{i}" for i in range(25)] + grant[at:])
        docs = spark.createDataFrame([(0, f"before it {text} behind it")], "doc_id int, text string")
        got = {r.template: r.coverage for r in license_scan.scan_licenses(docs).collect()}
        # Leaving the shorter side out may cost less than the gap does; it is reported either way.
        assert set(got) == {"MIT grant"} and got["MIT grant"] >= (1.0 if at == 30 else 0.8)
    docs = spark.createDataFrame([(i, f"x {t[n]} y") for i, n in enumerate(("MIT", "ISC", "BSD-2-Clause", "Zlib"))], "doc_id int, text string")
    got = {(r.doc_id, r.template): r.coverage for r in license_scan.scan_licenses(docs).collect()}
    assert all(got[i, n] == 1 for i, n in enumerate(("MIT", "ISC", "BSD-2-Clause", "Zlib")))


def plain_align(template, text):
    """(matched, first, last) of the best alignment that ends at each place, cell by cell."""
    row = [(0, 0, -1, 0)] * (len(text) + 1)
    for word in template:
        new = [(row[0][0] - 1, *row[0][1:])]
        for j, w in enumerate(text):
            score, matched, first, last = row[j]
            across = (score + 1, matched + 1, first if matched else j, j + 1) if w == word else (score - 1, matched, first, last)
            skip = (row[j + 1][0] - 1, *row[j + 1][1:])
            best = across if across[0] >= skip[0] else skip
            new.append(best if best[0] >= new[j][0] - 1 else (new[j][0] - 1, *new[j][1:]))
        row = new
    return [r[1:] for r in row]


def plain_scan(text, templates, least=0.8):
    """Occurrences by aligning each template with the whole text, wherever it may stand."""
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    words, out = cut(text), []
    for name, template in templates.items():
        own, kept = cut(template), []
        for matched, first, last in sorted(set(plain_align(own, words)), key=lambda x: (-x[0], x[1], x[2])):
            if own and matched / len(own) >= least and all(last <= x or first >= y for _, x, y in kept):
                kept.append((matched, first, last))
        out += [(name, m / len(own), " ".join(words[x:y])) for m, x, y in kept]
    return sorted(out)


def test_alignment_against_every_cell():
    import numpy as np

    rng = random.Random(2)
    for _ in range(200):
        template = [rng.randrange(6) for _ in range(rng.randrange(1, 14))]
        text = [rng.randrange(6) for _ in range(rng.randrange(25))]
        got = license_scan.align(np.array(template), np.array(text, np.int64))
        assert list(zip(*(x.tolist() for x in got))) == plain_align(template, text)


def test_scan_against_every_place(spark):
    """Names, coverage and spans of a corpus of planted notices with edits are those of aligning everything everywhere."""
    rng = random.Random(12)
    short = {n: t for n, t in T.items() if len(t.split()) < 80}
    templates = short | {"one": "proprietary", "two": "no reuse", "none": "--"}
    filler = [f"w{i}" for i in range(40)] + ["the", "License", "of", "software", "under", "Licensed", "rights"]
    texts, planted = [], 0
    for i in range(120):
        words = [rng.choice(filler) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            name = rng.choice(list(short))
            own = short[name].split()
            for _ in range(rng.randrange(1 + len(own) // 8)):
                k = rng.randrange(len(own))
                own[k : k + rng.randrange(2)] = [rng.choice(filler)] * rng.randrange(2)
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
            planted += 1
        texts.append(" ".join(words))
    texts += ["", None, "Proprietary! No reuse.", "All rights " * 40, "no no reuse reuse", T["MIT line"] + T["MIT line"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {}
    for r in license_scan.scan_licenses(docs, templates=templates).collect():
        assert texts[r.doc_id][r.begin : r.end] == r.matched
        got.setdefault(r.doc_id, []).append((r.template, r.coverage, r.matched))
    want = {i: plain_scan(t or "", templates) for i, t in enumerate(texts)}
    cut = lambda found: sorted((n, c, plain_cut(m)) for n, c, m in found)
    assert {i: cut(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}
    assert sum(map(len, got.values())) > 0.8 * planted


def plain_cut(text):
    import re

    return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))


@pytest.mark.parametrize("part", ["All rights reserved. ", "to deal in the Software without ", "the ", "Released under the MIT License. "])
def test_time_and_memory_are_linear(part):
    import time
    import tracemalloc

    import numpy as np

    index = license_scan.Index(T)

    def cost(n):
        raw = np.frombuffer((part * (n // len(part))).encode(), np.uint8)
        words = license_scan.Words(raw, np.array([0, len(raw)]), license_scan.ALNUM, lower=True)
        began = time.perf_counter()
        license_scan.occurrences(index, words, words.hashes())
        seconds = time.perf_counter() - began
        tracemalloc.start()
        license_scan.occurrences(index, words, words.hashes())
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return seconds, most

    (s1, m1), (s4, m4) = cost(250_000), cost(1_000_000)
    assert s4 < 4 and m4 < 300e6 and s4 < 0.2 + 8 * s1 and m4 < 5 * m1 + 1e6


def test_templates_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(T.values())], "doc_id int, text string")
    want = sorted(license_scan.scan_licenses(docs).collect())
    monkeypatch.setattr(license_scan, "BLOCK_WORDS", 60)
    assert sorted(license_scan.scan_licenses(docs).collect()) == want
