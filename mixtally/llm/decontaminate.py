"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, and one scan of each text.

Texts and items are normalised alike: A-Z lower-cased, words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ joined by single spaces, one
before and behind. The automaton holds each item's windows of 10 words (a shorter item whole) with their spaces, so that
it matches on word boundaries only, and reports every occurrence, overlapping ones too, in one pass. Words that were hit
are mapped to offsets in the original text.

Items come to the driver in blocks of at most BLOCK_CHARS characters of patterns. A block is broadcast, and each task builds
its automaton once; when there are several, the documents are scanned block by block and carry what was found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import checkpointed
from .skew import unused
from .textops import ALNUM, LOWER, Words

#: Words in a window.
WINDOW = 10
#: Characters of patterns in a block of items: the bound of an automaton and of what is broadcast.
BLOCK_CHARS = 4_000_000
#: Lower-cases A-Z and turns all that isn't part of a word into spaces.
NORMAL = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 0x20 for b in range(256))
FOUND = "array<struct<begin: int, end: int, item: string>>"

_automata: dict = {}


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows(text: str | None, window: int = WINDOW) -> list[tuple[int, str]]:
    """Number of words and padded pattern of each window of an item."""
    words = normal_words((text or "").encode())
    n = min(window, len(words))
    return [(n, f" {b' '.join(words[i : i + n]).decode('latin-1')} ") for i in range(len(words) - n + 1)] if n else []


def blocks(items: DataFrame, key: str, text: str, window: int, most: int = BLOCK_CHARS) -> Iterator[dict[str, tuple[int, list[str]]]]:
    """The items' patterns, with their lengths in words and the items that have them, in blocks. An item is in one block."""
    patterns: dict[str, tuple[int, list[str]]] = {}
    size = 0
    for row in items.select(F.col(key).cast("string"), text).where(F.col(key).isNotNull()).distinct().toLocalIterator():
        own = set(windows(row[1], window))
        added = sum(len(p) + len(row[0]) for _, p in own)  # the pattern, and the item as its owner
        if size and size + added > most:
            yield patterns
            patterns, size = {}, 0
        size += added
        for n, p in own:
            patterns.setdefault(p, (n, []))[1].append(row[0])
    if patterns:
        yield patterns


def _automaton(shared):
    """The block's automaton, built once in each Python worker."""
    import ahocorasick

    if shared.id not in _automata:
        _automata.clear()
        machine = ahocorasick.Automaton()
        for pattern, value in shared.value.items():
            machine.add_word(pattern, value)
        machine.make_automaton()
        _automata[shared.id] = machine
    return _automata[shared.id]


class _Id:
    """A broadcast with a name that stays the same in each worker."""

    def __init__(self, shared):
        self.shared, self.id = shared, str(shared._jbroadcast.id()) + "/" + str(id(shared))

    @property
    def value(self):
        return self.shared.value


def scan(text: bytes, machine) -> tuple[int, list[tuple[int, int, str]]]:
    """Number of words, and (first word, word behind, item) of each occurrence of a window."""
    words = normal_words(text)
    if not words:
        return 0, []
    normal = f" {b' '.join(words).decode('latin-1')} "
    hits = list(machine.iter(normal))
    if not hits:
        return len(words), []
    spaces = np.flatnonzero(np.frombuffer(normal.encode("latin-1"), np.uint8) == 0x20)
    ends = np.searchsorted(spaces, [e for e, _ in hits])
    return len(words), [(int(e) - n, int(e), item) for e, (_, (n, items)) in zip(ends, hits) for item in items]


def original_spans(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the text of runs of words, given by first word and word behind."""
    raw = np.frombuffer(text.encode(), np.uint8)
    found = Words(raw, np.array([0, len(raw)]), ALNUM, lower=True)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(chars[found.start[a]]), int(chars[found.end[b - 1]])) for a, b in words]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words under any of the spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _marked(docs: DataFrame, items: DataFrame, text: str, item_key: str, item_text: str, window: int, finish, schema: str) -> DataFrame:
    """finish(batch, [(n_words, occurrences)]) of the documents' batches."""
    spark = docs.sparkSession
    state = unused("__found", docs)
    several = list_of = None
    for block in blocks(items, item_key, item_text, window):
        if list_of is not None:  # an earlier block waits: scan with it, and carry on
            several = checkpointed((several if several is not None else docs).mapInArrow(_carry(list_of, text, state), _carried(docs, state)))
        list_of = _Id(spark.sparkContext.broadcast(block))
    last = list_of or _Id(spark.sparkContext.broadcast({}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(last) if last.value else None
        for batch in batches:
            found = []
            before = batch.column(state).to_pylist() if state in batch.schema.names else [None] * batch.num_rows
            for t, earlier in zip(batch.column(text), before):
                raw = (t.as_py() or "").encode()
                n, hits = scan(raw, machine) if machine else (len(normal_words(raw)), [])
                found.append((n, [(x["begin"], x["end"], x["item"]) for x in earlier or ()] + hits))
            yield finish(batch.drop_columns([state]) if state in batch.schema.names else batch, found)

    return (several if several is not None else docs).mapInArrow(run, schema)


def _carried(docs: DataFrame, state: str) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", {state} {FOUND}"


def _carry(shared: _Id, text: str, state: str):
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("item", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(shared)
        for batch in batches:
            before = batch.column(state).to_pylist() if state in batch.schema.names else [None] * batch.num_rows
            rows = [[*(e or ()), *({"begin": a, "end": b, "item": i} for a, b, i in scan((t.as_py() or "").encode(), machine)[1])] for t, e in zip(batch.column(text), before)]
            plain = batch.drop_columns([state]) if state in batch.schema.names else batch
            yield pa.RecordBatch.from_arrays([*plain.columns, pa.array(rows, kind)], names=[*plain.schema.names, state])

    return run


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit, n_items (long), items (array<string>, sorted), spans (array<struct<begin, end>>) and contaminated.

    A word is hit if an item's window of `window` words (or a shorter item, whole) occurs there; items are those with such
    windows, and spans the character ranges of hit words in the original text. All other columns stay, whatever their names; those
    of the new names are replaced. A null or empty text has no words. Items without a key, text or words match nothing; repeated items count
    once; items of equal text are all named. Without items nothing is contaminated. A text of any length is scanned whole; an item of any
    length is in one block, so its windows, some 80 bytes for each of its words, must fit the driver and each task.
    """
    new = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")
    docs = docs.drop(*new)
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    def rows(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        n, hit, named, spans = [], [], [], []
        for t, (count, hits) in zip(batch.column(text), found):
            runs = merged([(a, b) for a, b, _ in hits])
            n.append(count)
            hit.append(sum(b - a for a, b in runs))
            named.append(sorted({i for _, _, i in hits}))
            spans.append([{"begin": a, "end": b} for a, b in original_spans(t.as_py(), runs)] if runs else [])
        columns = (pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in named], pa.int64()), pa.array(named, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array([h > 0 for h in hit], pa.bool_()))
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *new])

    return _marked(docs, items, text, item_key, item_text, window, rows, f"{fields}, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<begin: long, end: long>>, contaminated boolean")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that repeat ten-word windows of benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")

    def rows(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        hit, named = [], []
        for _, hits in found:
            hit.append(sum(b - a for a, b in merged([(a, b) for a, b, _ in hits])))
            named.append(sorted({i for _, _, i in hits}))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array([n for n, _ in found], pa.int64()), "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array([len(x) for x in named], pa.int64()), "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named], pa.string()), "contaminated": pa.array([h > 0 for h in hit], pa.bool_())})

    return _marked(docs, items, "text", "item_id", "text", WINDOW, rows, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


OP4_SQL = r"""
WITH doc AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
item_window AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
doc_window AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM item_window) WHERE len(w) >= n)),
found AS (SELECT doc_id, d.n, i, item FROM doc_window d JOIN item_window t ON d.n = t.n AND d.words = t.words),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit ON hit.doc_id = doc.doc_id LEFT JOIN named ON named.doc_id = doc.doc_id
"""
