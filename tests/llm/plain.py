"""The corpus operators in plain Python, for small tables."""

import collections
import hashlib
import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed, n=60, words=("the", "of", "and", "é", "Ünd", "x1", "cat", "dog", "#", "für"), passages=6):
    """Texts with shared passages, copies, near copies, runs of one word, blanks, nulls and one long text."""
    rng = random.Random(seed)

    def make(k):
        return [rng.choice(words) + rng.choice(("", "", "a", "b", str(rng.randrange(50)))) for _ in range(k)]

    shared = [make(rng.randrange(14, 40)) for _ in range(passages)]
    out = []
    for _ in range(n):
        kind = rng.randrange(10)
        w = make(rng.randrange(0, 60))
        if kind < 3:
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(shared)
        elif kind == 3 and out:
            w = [x for x in (rng.choice(out) or "").split(" ") if x]
        elif kind == 4 and out:
            w = [x for x in (rng.choice(out) or "").split(" ") if x]
            if w:
                w[rng.randrange(len(w))] = "changed"
        elif kind == 5:
            w = [rng.choice(words)] * rng.randrange(10, 60) + make(3)
        text = ""
        for x in w:
            text += x + rng.choice((" ", " ", " ", "\n", "\t ", "  "))
        out.append(text)
    out += [None, "", " \n ", "one", "a" * 400, "ab" * 300, " ".join(make(3000))]
    rng.shuffle(out)
    return out


def remove_words(rows, window=13):
    """(n_words, n_removed, kept) by row."""
    first, texts = {}, []
    last = 1 << 63
    for key, text in rows:
        w = WORD.findall(text or "")
        texts.append((last if key is None else key, w))
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, last), texts[-1][0])
    out = []
    for key, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def remove_bytes(rows, window=100):
    """(n_bytes, n_removed, n_spans, kept) by row."""
    first, texts = {}, []
    for key, text in rows:
        b = (text or "").encode()
        texts.append((1 << 62 if key is None else key, b))
        for i in range(len(b) - window + 1):
            g = b[i : i + window]
            first[g] = min(first.get(g, (1 << 63, 0)), (texts[-1][0], i))
    out = []
    for key, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < (key, i):
                gone[i : i + window] = b"\x01" * window
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out.append((len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(rows, percent=80):
    """(n_shingles, component) by row."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None:
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(len(s), least.get(find(i)) if rows[i][0] is not None else None) for i, s in enumerate(sets)]


def contamination(rows, items, window=10):
    """(n_words, n_hit, items) by row."""
    patterns = collections.defaultdict(set)
    for key, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        if key is None or not w:
            continue
        n = min(window, len(w))
        for i in range(len(w) - n + 1):
            patterns[tuple(w[i : i + n])].add(str(key))
    sizes = {len(p) for p in patterns}
    out = []
    for _, text in rows:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, named = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in patterns:
                    hit |= set(range(i, i + n))
                    named |= patterns[p]
        out.append((len(w), len(hit), sorted(named)))
    return out


def base_counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    three = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
