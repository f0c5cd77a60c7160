"""Quality rules by distribution divergence.

Each text's histograms, of character classes and of common words, are compared with the references of its language by the
Jensen-Shannon distance (base 2, so 0 to 1). The references are the histograms of all documents of the language that pass the
base rules. Short texts have noisy histograms, so a text is judged only from MIN_WORDS words on, and a reference judges only
if it counts MIN_REFERENCE words at least.

Texts are read once: a vectorised pass makes counts of fixed width for each document, which are checkpointed; references and
distances are built-in functions on those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import checkpointed
from .textops import ALNUM, NON_SPACE, Words, flat, grams, pieces, segments

#: Words of a text, and of a language's documents together, from which on they are compared.
MIN_WORDS, MIN_REFERENCE = 50, 1000
#: Greatest distances of a kept text of n words, a + b / sqrt(n), as a histogram's noise goes: of character classes, of common words.
MAX_CLASSES, MAX_WORDS = (0.12, 1.3), (0.15, 2.5)
#: Common function words of the languages, fixed values.
COMMON_WORDS = {
    "en": "the of and to a in is that it on was for with as be by this are at an from or he",
    "fr": "de la le et les des en un du que une est pour qui dans par au sur pas avec",
    "es": "de la que el en y los se del las un por con no una para su es al lo",
    "de": "der die und in den von zu das mit sich für des im auf ist nicht dem eine ein als",
}
#: Classes of characters, by first byte: letters, digits and so on in ASCII, and blocks of others.
CLASSES = {
    "lower": range(0x61, 0x7B),
    "upper": range(0x41, 0x5B),
    "digit": range(0x30, 0x3A),
    "blank": (0x20, 0x09),
    "line": (0x0A, 0x0D),
    "stop": b".,;:!?",
    "quote": b"\"'`()[]{}",
    "symbol": b"#*$%&|<>@^~=+_/\\",
    "latin": range(0xC2, 0xC6),
    "two": range(0xC6, 0xE0),
    "three": range(0xE0, 0xF0),
    "four": range(0xF0, 0xF8),
}
_CLASS = np.full(256, len(CLASSES), np.int64)  # other characters
_CLASS[0x80:0xC0] = len(CLASSES) + 1  # bytes within characters, not counted
for _i, _bytes in enumerate(CLASSES.values()):
    _CLASS[list(_bytes)] = _i
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: All common words, once each; the bin behind them counts all other words.
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words.split()})

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _vocabulary() -> tuple[np.ndarray, np.ndarray]:
    raw = [w.encode() for w in VOCABULARY]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    h = Words(data, np.array([0, len(data)]), ALNUM).hashes()
    order = np.argsort(h)
    return h[order], order


def _row_sum(hit: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(hit)])[first])


def counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts of each text, and its histograms `classes` and `words` (a row each)."""
    rows = len(offs) - 1
    offs = offs - offs[0]
    words = Words(data, offs, NON_SPACE)
    h = words.hashes()
    starts = (data & 0xC0) != 0x80
    out = {"n_words": np.diff(words.first), "word_chars": _row_sum(starts & NON_SPACE[data], offs), "n_symbols": _row_sum(_SYMBOL[data], offs)}
    lines = Words(data, offs, _NOT_LINE)
    filled = np.concatenate([[0], np.cumsum(NON_SPACE[data])])
    own = np.flatnonzero(filled[lines.end] > filled[lines.start])
    line, row = lines.hashes()[own], lines.row[own]
    by = np.lexsort((line, row))
    first = segments(row[by], line[by])
    out["n_dup_lines"] = np.bincount(row, minlength=rows) - np.bincount(row[by][first], minlength=rows)
    three = grams(h, 3)
    at = np.flatnonzero(words.row[2:] == words.row[: len(three)]) if len(three) else np.zeros(0, np.int64)
    by = at[np.lexsort((three[at], words.row[at]))]
    first = segments(words.row[by], three[by])
    many = by[np.repeat(np.diff(np.append(first, len(by))) > 1, np.diff(np.append(first, len(by))))]
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, many, 1)
    np.add.at(step, many + 3, -1)
    out["n_repeat_words"] = _row_sum(np.cumsum(step[:-1]) > 0, words.first)
    k = len(CLASSES) + 2
    out["classes"] = np.bincount(np.repeat(np.arange(rows), np.diff(offs)) * k + _CLASS[data], minlength=rows * k).reshape(rows, k)[:, :-1]
    plain = Words(data, offs, ALNUM, lower=True)
    known, number = _vocabulary()
    ph = plain.hashes()
    spot = np.minimum(np.searchsorted(known, ph), len(known) - 1)
    bin_ = np.where(known[spot] == ph, number[spot], len(known))
    out["words"] = np.bincount(plain.row * (len(known) + 1) + bin_, minlength=rows * (len(known) + 1)).reshape(rows, -1)
    return out


_NOT_LINE = np.ones(256, bool)
_NOT_LINE[0x0A] = False


def histograms(docs: DataFrame, rest: str, text: str, lang: str) -> DataFrame:
    """(rest, lang, base counts (long), classes and words (array<int>), and their totals (double)) of docs (rest, text, lang)."""
    kinds = dict(docs.dtypes)
    schema = f"`{rest}` {kinds[rest]}, `{lang}` {kinds[lang]}, " + ", ".join([f"{c} long" for c in BASE] + ["classes array<int>", "words array<int>", "classes_total double", "words_total double"])

    def wide(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = flat(batch.column(text))
            for a, b in pieces(offs):
                found = counts(data[offs[a] : offs[b]], offs[a : b + 1])
                columns = [batch.column(c).slice(a, b - a) for c in (rest, lang)] + [pa.array(found[c], pa.int64()) for c in BASE] + [wide(found["classes"]), wide(found["words"])]
                columns += [pa.array(found[c].sum(axis=1), pa.float64()) for c in ("classes", "words")]
                yield pa.RecordBatch.from_arrays(columns, names=[rest, lang, *BASE, "classes", "words", "classes_total", "words_total"])

    return docs.mapInArrow(run, schema)


def _distance(own: str, reference: str):
    """Jensen-Shannon distance, base 2, of a count array and a reference of proportions; null if either is empty.

    The count array's total is a column, so that the expression visits each bin once.
    """
    def part(p, m):
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    total = F.col(f"{own}_total")
    shares = F.transform(F.col(own), lambda x: x / total)
    terms = F.zip_with(shares, F.col(reference), lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    return F.when((total > 0) & F.col(reference).isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2)))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without the text, with the base counts, class_distance, word_distance (double), base_failed and kept (boolean).

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows. kept: false if base_failed or a
    distance is over its bound. Texts under MIN_WORDS words, and languages with fewer than MIN_REFERENCE words, aren't
    compared: their distances are null, and the base rules alone decide. Documents without a language are one group. A null
    or empty text has no words. Repeated rows are judged alike; an empty table gives an empty result. All other columns stay,
    whatever their names; those of the new names are replaced. A text of any length is counted whole, at some 50 bytes of memory for
    each of its bytes.
    """
    new = (*BASE, "class_distance", "word_distance", "base_failed", "kept")
    stay = [c for c in docs.columns if c != text and c not in new]
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in stay) or (F.lit(True).alias("_"),)).alias("__row"), F.col(text).alias("__text"), F.col(lang).alias("__lang"))
    rows = histograms(docs, "__row", "__text", "__lang").withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    rows = checkpointed(rows)
    sound = rows.where(~F.col("base_failed"))
    sums = [F.sum(F.col("classes")[i]).cast("double").alias(f"c{i}") for i in range(len(CLASSES) + 1)] + [F.sum(F.col("words")[i]).cast("double").alias(f"w{i}") for i in range(len(VOCABULARY) + 1)]
    found = sound.groupBy("__lang").agg(F.sum("n_words").alias("n"), *sums).where(F.col("n") >= MIN_REFERENCE)
    def shares(letter: str, n: int):  # of a row for each language
        own = F.array(*(f"{letter}{i}" for i in range(n)))
        total = F.aggregate(own, F.lit(0.0), lambda s, v: s + v)
        return F.transform(F.arrays_zip(own.alias("x"), F.array_repeat(total, n).alias("t")), lambda z: z["x"] / z["t"])

    found = found.select(F.col("__lang").alias("__of"), shares("c", len(CLASSES) + 1).alias("__classes"), shares("w", len(VOCABULARY) + 1).alias("__words"))
    rows = rows.join(found, F.col("__lang").eqNullSafe(F.col("__of")), "left")
    long = F.col("n_words") >= MIN_WORDS
    rows = rows.withColumn("class_distance", F.when(long, _distance("classes", "__classes"))).withColumn("word_distance", F.when(long, _distance("words", "__words")))
    bound = lambda ab: F.lit(ab[0]) + F.lit(ab[1]) / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= bound(MAX_CLASSES)) & (F.coalesce("word_distance", F.lit(0.0)) <= bound(MAX_WORDS))
    return rows.withColumn("kept", ~F.col("base_failed") & near).select(*(F.col(f"__row.`{c}`").alias(c) for c in stay), *new)


def op5_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and divergence from the languages' references, for documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs).select("doc_id", *BASE, "base_failed", "kept", F.round("class_distance", 9).alias("class_distance"), F.round("word_distance", 9).alias("word_distance"))


def _op5_sql() -> str:
    """The same in DuckDB's SQL: histograms as rows (document, bin, count), distances as sums over all bins of a language."""
    def one(low: int, high: int) -> str:
        return f"\\x{{{low:x}}}-\\x{{{high:x}}}"

    inside = {name: "".join(f"\\x{{{b:x}}}" for b in of) for name, of in CLASSES.items() if max(of) < 0x80}
    inside |= {"latin": one(0x80, 0x17F), "two": one(0x180, 0x7FF), "three": one(0x800, 0xFFFF), "four": one(0x10000, 0x10FFFF)}
    classes = " UNION ALL ".join([f"SELECT doc_id, {i} AS bin, length(t) - length(regexp_replace(t, '[{of}]', '', 'g')) AS n FROM d" for i, of in enumerate(inside.values())] + [f"SELECT doc_id, {len(inside)}, length(regexp_replace(t, '[{''.join(inside.values())}]', '', 'g')) FROM d"])
    words = ", ".join(f"('{w}', {i})" for i, w in enumerate(VOCABULARY))
    a, b = MAX_CLASSES, MAX_WORDS

    def distance(name: str, table: str) -> str:
        return f"""{name}_total AS (SELECT doc_id, sum(n) AS total FROM {table} GROUP BY doc_id),
{name}_ref AS (SELECT lang, bin, sum(n) AS n FROM {table} JOIN judged USING (doc_id) WHERE NOT base_failed GROUP BY lang, bin),
{name}_share AS (SELECT r.lang, r.bin, r.n / sum(r.n) OVER (PARTITION BY r.lang) AS q FROM {name}_ref r JOIN size ON r.lang IS NOT DISTINCT FROM size.lang),
{name}_pq AS (SELECT j.doc_id, s.q, coalesce(h.n, 0) / t.total AS p FROM judged j JOIN {name}_total t ON j.doc_id = t.doc_id JOIN {name}_share s ON j.lang IS NOT DISTINCT FROM s.lang LEFT JOIN {table} h ON h.doc_id = j.doc_id AND h.bin = s.bin WHERE t.total > 0 AND j.n_words >= {MIN_WORDS}),
{name}_js AS (SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS distance FROM {name}_pq GROUP BY doc_id)"""

    return f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
line AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
three AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS m FROM three) WHERE m > 1) GROUP BY doc_id),
base AS (SELECT d.doc_id, d.lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(line.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words FROM d LEFT JOIN line ON line.doc_id = d.doc_id LEFT JOIN again ON again.doc_id = d.doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
size AS (SELECT lang, sum(n_words) AS n FROM judged WHERE NOT base_failed GROUP BY lang HAVING sum(n_words) >= {MIN_REFERENCE}),
cls AS ({classes}),
vocabulary AS (SELECT * FROM (VALUES {words}) v(word, bin)),
plain AS (SELECT doc_id, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM d),
common AS (SELECT doc_id, coalesce(bin, {len(VOCABULARY)}) AS bin, count(*) AS n FROM plain LEFT JOIN vocabulary ON plain.word = vocabulary.word GROUP BY 1, 2),
{distance('cls', 'cls')},
{distance('wrd', 'common')}
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(c.distance, 9) AS class_distance, round(v.distance, 9) AS word_distance,
NOT base_failed AND coalesce(c.distance, 0) <= {a[0]} + {a[1]} / sqrt(greatest(n_words, 1)) AND coalesce(v.distance, 0) <= {b[0]} + {b[1]} / sqrt(greatest(n_words, 1)) AS kept
FROM judged j LEFT JOIN cls_js c ON c.doc_id = j.doc_id LEFT JOIN wrd_js v ON v.doc_id = j.doc_id"""


OP5_SQL = _op5_sql()
