"""Source divergence audit: how the sources of a language differ in the terms that they use, and by which terms.

Terms are runs of letters, A-Z lower-cased. A language keeps the terms of at least LEAST_DOCS of its documents. Each (language, source)
gives each kept term the share p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)); two sources differ by the sum of |p - q| over all kept
terms, and a source's terms are those to which it gives more than its language does. All of it is integer arithmetic.

The work is sorted runs. Within a task, the words of a few MB of text are sorted by (lang, term, source, document); one scan of run
lengths gives document frequencies and counts, so the commonest word of the corpus is one row for each source and piece of text. These
rows are dealt out by (lang, term) and sorted by (lang, term, source); a scan that holds no more than the sources of one term merges
them, decides what is kept and drops the rest. Kept counts are then dealt out by slices of each language's terms, whose runs give
partial sums for each pair of sources and partial lists of terms. Sources go by blocks of BLOCK, so a task holds a table of BLOCK x
BLOCK sums however many sources there are; what an absent term adds to a pair is known beforehand, so only present counts are sent.

Nulls in text, lang and source count as ''. Every row is a document, repeated rows and ids too. A language without kept terms has pairs
of value 0; one with a single source has none. An empty table gives no rows. Other columns are never read, whatever their names.
Texts may be of any length: a piece of text is at least one whole document, which takes some 60 bytes of memory for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import checkpointed, release, small_batches
from .textops import Words, flat, pieces, ranges, segments

#: Documents of its language that a kept term occurs in, at least; terms reported for each source, at most.
LEAST_DOCS, TOP_TERMS = 30, 50
#: What each count is raised by, and the whole of which shares are parts.
ADDED, WHOLE = 5, 1_000_000_000
#: Bytes of text whose words are sorted together, sources of a block, and kept counts of a slice.
PIECE_BYTES, BLOCK, SLICE_ROWS = 8 << 20, 512, 200_000
#: Sums of counts must stay below, so that shares are exact in 64 bits.
MOST = 1 << 53

#: Term bytes, of lower-cased text.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

CELLS = "lang string, term string, source string, n_docs long, count long"
KEPT = "lang string, term string, source string, count long, lang_count long, first int"


def _codes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of a column's values, and the values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    found = pc.dictionary_encode(column)
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _spelled(words: Words) -> pa.Array:
    """The words as strings."""
    size = words.end - words.start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(words.data[ranges(words.start, size)])))


def piece_counts(data: np.ndarray, offs: np.ndarray, lang: pa.Array, source: pa.Array) -> pa.RecordBatch:
    """CELLS of some documents: how often, and in how many of them, each term occurs for each (lang, source)."""
    words = Words(data, offs, LETTERS, lower=True)
    term, terms = _codes(_spelled(words))
    (of_lang, langs), (of_source, sources) = _codes(lang), _codes(source)
    rows = len(offs) - 1
    # One number for (lang, term, source, document): sorting it puts equal ones in runs.
    run = np.sort(((of_lang[words.row] * len(terms) + term) * len(sources) + of_source[words.row]) * rows + words.row)
    cell = run // max(1, rows)
    start = segments(cell)
    new = np.zeros(len(run), np.int64)
    new[segments(run)] = 1
    n_docs = np.add.reduceat(new, start) if len(start) else new
    count = np.diff(np.append(start, len(run)))
    key, s = np.divmod(cell[start], max(1, len(sources)))
    l, t = np.divmod(key, max(1, len(terms)))
    return pa.RecordBatch.from_arrays([langs.take(pa.array(l)), terms.take(pa.array(t)).cast(pa.string()), sources.take(pa.array(s)), pa.array(n_docs, pa.int64()), pa.array(count, pa.int64())], names=["lang", "term", "source", "n_docs", "count"])


def document_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """CELLS of each piece of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = flat(batch.column("text"))
            for a, b in pieces(offs, PIECE_BYTES):
                yield piece_counts(data[offs[a] : offs[b]], offs[a : b + 1], batch.column("lang").slice(a, b - a), batch.column("source").slice(a, b - a))
                release()

    plain = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
    return plain.mapInArrow(run, CELLS)


def kept_runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """KEPT from CELLS sorted by (lang, term, source): sums of each run of a source, of those terms that have `least` documents.

    Only the last term's sums wait for the next batch.
    """
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n_docs", pa.int64()), ("count", pa.int64())])

    def merged(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """One row for each (lang, term, source), and where terms begin."""
        codes = [_codes(table.column(c))[0] for c in ("lang", "term", "source")]
        start = segments(*codes)
        table = pa.table([table.column(c).take(pa.array(start)) for c in ("lang", "term", "source")] + [pa.array(np.add.reduceat(table.column(c).to_numpy(), start)) for c in ("n_docs", "count")], schema=schema)
        return table, segments(*(c[start] for c in codes[:2]))

    def out(table: pa.Table, start: np.ndarray) -> pa.RecordBatch:
        n_docs, count = table.column("n_docs").to_numpy(), table.column("count").to_numpy()
        size = np.diff(np.append(start, len(table)))
        keep = np.repeat(np.add.reduceat(n_docs, start) >= least, size)
        first = np.zeros(len(table), np.int32)
        first[start] = 1
        columns = [table.column(c).combine_chunks() for c in ("lang", "term", "source")] + [pa.array(count), pa.array(np.repeat(np.add.reduceat(count, start), size)), pa.array(first)]
        return pa.table(columns, names=["lang", "term", "source", "count", "lang_count", "first"]).filter(pa.array(keep)).combine_chunks()

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]).cast(schema)
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        if not len(rows):
            continue
        rows, start = merged(rows)
        last = int(start[-1])
        held = rows.slice(last)
        if last:
            yield from out(rows.slice(0, last), start[:-1]).to_batches()
    if held is not None and len(held):
        yield from out(held, np.zeros(1, np.int64)).to_batches()


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(WHOLE * (count + ADDED) / (total + ADDED * terms)), exactly: a long division, three digits at a time."""
    below = total + ADDED * terms
    if np.any(below >= MOST):
        raise ValueError("a group's terms are too many for exact shares")
    whole, rest = np.divmod(count + ADDED, np.maximum(below, 1))
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, np.maximum(below, 1))
        whole = whole * 1000 + digits
    return whole + 1


PARTIAL = "lang string, part string, source string, item string, value long"


def _partial(lang: list, part: str, source: list | pa.Array, item: list | pa.Array, value: np.ndarray) -> pa.Table:
    n = len(value)
    return pa.table([pa.array([lang] * n, pa.string()), pa.array([part] * n, pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "part", "source", "item", "value"])


def slice_sums(table: pa.Table) -> pa.Table:
    """PARTIAL of one slice of a language's terms for two blocks of its sources: sums for their pairs, and their first terms.

    Rows without a term are the blocks' sources, with their totals; the others are counts.
    """
    blank = pc.is_null(table.column("term"))
    groups = table.filter(blank).sort_by([("source", "ascending")]).combine_chunks()
    cells = table.filter(pc.invert(blank)).sort_by([("term", "ascending"), ("source", "ascending")]).combine_chunks()
    lang, left, right, place = (table.column(c)[0].as_py() for c in ("lang", "left", "right", "slice"))
    terms = int(groups.column("terms")[0].as_py())
    total, block = groups.column("total").to_numpy(), groups.column("block").to_numpy()
    names = groups.column("source").combine_chunks()
    none = shares(np.zeros(len(total), np.int64), total, terms)
    of = pc.index_in(cells.column("source"), value_set=names).to_numpy().astype(np.int64) if len(cells) else np.zeros(0, np.int64)
    count = cells.column("count").to_numpy()
    own = shares(count, total[of], terms)
    a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
    base = np.abs(none[a][:, None] - none[b][None, :])
    # The first slice adds what all terms would, were none present; present ones then add the difference.
    sums = base * terms if place == 0 else np.zeros_like(base)
    start = segments(_codes(cells.column("term"))[0]) if len(cells) else np.zeros(0, np.int64)
    ends = np.append(start, len(cells))
    most = max(1, (1 << 21) // max(1, base.size, len(total)))
    for t in range(0, len(start), most):
        lo, hi = int(ends[t]), int(ends[min(t + most, len(start))])
        grid = np.tile(none, (min(most, len(start) - t), 1))
        grid[np.repeat(np.arange(len(grid)), np.diff(ends[t : t + len(grid) + 1])), of[lo:hi]] = own[lo:hi]
        sums += np.abs(grid[:, a][:, :, None] - grid[:, b][:, None, :]).sum(axis=0) - base * len(grid)
    i, j = np.nonzero(np.triu(np.ones_like(sums), 1)) if left == right else np.nonzero(np.ones_like(sums))
    found = [_partial(lang, "pair", names.take(pa.array(a[i])), names.take(pa.array(b[j])), sums[i, j])]
    if left == right and len(cells):
        over = own - shares(cells.column("lang_count").to_numpy(), np.full(len(cells), groups.column("lang_total")[0].as_py(), np.int64), terms)
        more = _partial(lang, "term", cells.column("source").combine_chunks(), cells.column("term").combine_chunks(), over).filter(pa.array(over > 0))
        more = more.sort_by([("source", "ascending"), ("value", "descending"), ("item", "ascending")])
        run = segments(_codes(more.column("source"))[0]) if len(more) else np.zeros(0, np.int64)
        rank = np.arange(len(more)) - np.repeat(run, np.diff(np.append(run, len(more))))
        found.append(more.filter(pa.array(rank < TOP_TERMS)))
    return pa.concat_tables(found)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language, all others by difference, and its first TOP_TERMS terms."""
    spark = docs.sparkSession
    small_batches(spark)
    cells = document_counts(docs, text, lang, source)
    kept = checkpointed(cells.repartition(F.col("lang"), F.col("term")).sortWithinPartitions("lang", "term", "source").mapInArrow(lambda batches: kept_runs(batches, least), KEPT))
    groups = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source")).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.sum("count").alias("lang_total"), F.sum("first").alias("terms"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    groups = checkpointed(groups.join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", zero("total"), zero("lang_total"), zero("terms")))
    sources = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-sources // BLOCK))
    slices = max(spark.sparkContext.defaultParallelism, -(-kept.count() * blocks // SLICE_ROWS))
    of_block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    # A block meets each block, itself too, once: as the left or the right one.
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    pair = [F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")]
    counts = kept.select("*", of_block.alias("block"), F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int").alias("slice")).select("*", other)
    whole = groups.select("*", of_block.alias("block")).select("*", other).select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    columns = ["lang", "source", "slice", "block", *pair]
    nothing = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    rows = counts.select(*columns, "term", "count", "lang_count", *nothing("long", "total", "lang_total", "terms")).unionByName(whole.select(*columns, *nothing("string", "term"), *nothing("long", "count", "lang_count"), "total", "lang_total", "terms"))
    partial = rows.groupBy("lang", "left", "right", "slice").applyInArrow(slice_sums, PARTIAL).groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    both = partial.select("lang", "part", "value", F.explode(F.slice(ways, F.lit(1), F.when(F.col("part") == "pair", 2).otherwise(1))).alias("way")).select("lang", "way.source", "part", "way.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item")))
    return both.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, CAST(coalesce(sum(c), 0) AS BIGINT) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 5)) // (n + 5 * v) AS p FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000 * (CAST(sum(c) AS BIGINT) + 5)) // (any_value(total) + 5 * any_value(v)) AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, CAST(sum(n) AS BIGINT) AS total FROM n GROUP BY lang) USING (lang) GROUP BY lang, term),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s, 0) AS BIGINT) AS value
  FROM n a JOIN n b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS s FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z
  ON z.lang = a.lang AND z.source = a.source AND z.other = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f) WHERE part = 'pair' OR rank <= 50
"""
