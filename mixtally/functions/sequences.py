"""Column functions on nucleotide strings. All of them are built-in expressions, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise(seq: ColumnOrName, name: ColumnOrName | None = None) -> Column:
    """Upper case, U as T, and any other letter than ACGT replaced by a base.

    The replacement depends on the sequence's name and the letter's place only, so that it is the same in every run and
    for every partitioning: letter number hash(name, place) mod 4 of ACGT. Without a name, the sequence's own hash counts.
    """
    up = F.translate(_c(seq), "acgtuU", "ACGTTT")
    key = F.xxhash64(_c(name) if name is not None else up)
    letters = F.transform(
        F.split(up, ""),
        lambda c, i: F.when(c.isin("A", "C", "G", "T", ""), c).otherwise(F.substring(F.lit("ACGT"), (F.pmod(F.xxhash64(key, i), F.lit(4)) + 1).cast("int"), F.lit(1))),
    )
    return F.when(up.rlike("[^ACGT]"), F.array_join(letters, "")).otherwise(up)


def clip_poly_a(seq: ColumnOrName, run: int = 10) -> Column:
    """Without its trailing A's, if there are at least `run` of them."""
    seq = _c(seq)
    return F.when(seq.rlike(f"A{{{run}}}$"), F.regexp_replace(seq, "A+$", "")).otherwise(seq)


def reverse_complement(seq: ColumnOrName) -> Column:
    """The opposite strand; other letters than ACGT become N."""
    return F.reverse(F.regexp_replace(F.translate(_c(seq), "ACGTacgt", "TGCATGCA"), "[^ACGT]", "N"))


def canonical(kmer: ColumnOrName) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    kmer = _c(kmer)
    return F.least(kmer, F.reverse(F.translate(kmer, "ACGT", "TGCA")))


def kmers(seq: ColumnOrName, k: int) -> Column:
    """All k-mers of a sequence, in order, those with other letters than ACGT too; none for a shorter sequence."""
    check_k(k, odd=False)
    seq = _c(seq)
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - F.lit(k - 1)), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def canonical_kmers(seq: ColumnOrName, k: int) -> Column:
    """The canonical form of each k-mer of an upper-case sequence, null where it has other letters than ACGT.

    The opposite strand is made once for the sequence, not for each window.
    """
    check_k(k, odd=False)
    seq = _c(seq)
    other = F.reverse(F.translate(seq, "ACGT", "TGCA"))
    last = F.length(seq) - F.lit(k - 1)
    # A lambda's own variables are values, while an outer expression would be evaluated again for each window.
    strands = F.array(F.struct(seq.alias("one"), other.alias("two"), last.alias("last")))
    windows = F.transform(strands, lambda s: F.transform(F.sequence(F.lit(1), s["last"]), lambda i: F.least(F.substring(s["one"], i, F.lit(k)), F.substring(s["two"], s["last"] - i + 1, F.lit(k)))))
    both = F.element_at(windows, 1)
    both = F.when(seq.rlike("[^ACGT]"), F.transform(both, lambda w: F.when(w.rlike("^[ACGT]+$"), w))).otherwise(both)
    return F.when(last >= 1, both).otherwise(F.array().cast("array<string>"))


def is_kmer(kmer: ColumnOrName) -> Column:
    """Whether a window holds bases only, of either case."""
    return _c(kmer).rlike("^[ACGTacgt]+$")


def check_k(k: int, odd: bool = True) -> int:
    """k, if an index can be built with it: odd, from 3 to 31."""
    if not 1 <= k <= 31 or odd and (k < 3 or k % 2 == 0):
        raise ValueError(f"k must be {'odd and ' if odd else ''}between {3 if odd else 1} and 31, not {k}")
    return k


def encode(kmer: ColumnOrName) -> Column:
    """A k-mer of at most 31 bases as a number: two bits a base, A 0, C 1, G 2, T 3, first base highest."""
    return F.conv(F.translate(F.upper(_c(kmer)), "ACGT", "0123"), 4, 10).cast("long")


def decode(code: ColumnOrName, k: int) -> Column:
    """The k-mer that a number stands for."""
    return F.translate(F.lpad(F.conv(_c(code).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def append_base(kmer: ColumnOrName, base: ColumnOrName) -> Column:
    """The k-mer one base further: without its first base, with `base` behind."""
    kmer = _c(kmer)
    return F.concat(F.substring(kmer, F.lit(2), F.length(kmer) - 1), _c(base))


def prepend_base(kmer: ColumnOrName, base: ColumnOrName) -> Column:
    """The k-mer one base earlier: `base` before it, without its last base."""
    kmer = _c(kmer)
    return F.concat(_c(base), F.substring(kmer, F.lit(1), F.length(kmer) - 1))


def neighbours(kmer: ColumnOrName) -> Column:
    """The eight k-mers that may come next (0 to 3, with A, C, G, T behind) and before (4 to 7)."""
    bases = [F.lit(b) for b in "ACGT"]
    return F.array(*(append_base(kmer, b) for b in bases), *(prepend_base(kmer, b) for b in bases))


def base_at(digit: ColumnOrName) -> Column:
    """The base of a digit from 0 to 3."""
    return F.element_at(F.array(*(F.lit(b) for b in "ACGT")), _c(digit).cast("int") + 1)


def hamming(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Places in which two strings of equal length differ; null if their lengths differ."""
    a, b = _c(a), _c(b)
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(F.length(a) == F.length(b), F.aggregate(differ, F.lit(0), lambda s, x: s + x))


def hexamer(seq: ColumnOrName, at: int = 1, reverse: bool = False) -> Column:
    """The number of the six bases at a place (from 1), or of their reverse complement; null if they aren't six bases."""
    six = F.substring(_c(seq), at, 6)
    return F.when(six.rlike("^[ACGT]{6}$"), encode(reverse_complement(six) if reverse else six))


def split_exact(text: ColumnOrName, delimiter: str) -> Column:
    """The parts between literal delimiters; an empty part at the end is dropped."""
    parts = F.split(_c(text), "\\Q" + delimiter + "\\E")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def thousands(number: ColumnOrName) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(_c(number), 0)


def error_probability(quality: ColumnOrName, offset: int = 33) -> Column:
    """Chance of a wrong base: 10 ** (-q / 10). With offset 64, q = 2 marks unusable bases, 0.75. Negative q is an error."""
    q = F.ascii(_c(quality)) - offset
    e = F.pow(F.lit(10.0), -q / 10.0)
    if offset == 64:
        e = F.when(q == 2, F.lit(0.75)).otherwise(e)
    return F.when(q < 0, F.raise_error(F.lit("a quality is below the offset")).cast("double")).otherwise(e)


def significant(count: ColumnOrName) -> Column:
    """A count as the tables print it: p + 2 significant digits from 1000 on (p = floor(log10)), 5 from 100 on, else 4."""
    x = _c(count)
    p = F.floor(F.log10(F.abs(x))).cast("int")
    digits = F.when(p >= 3, p + 2).when(p == 2, 5).otherwise(4)
    scale = F.pow(F.lit(10.0), (digits - 1 - p).cast("double"))
    shown = F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * scale) / scale)
    return F.call_function("format_number", shown, F.lit("0.############"))


def cigar_units(cigar: ColumnOrName) -> Column:
    """An alignment's bases in order: 0 for a match (=), 1 for a mismatch (X), an insertion (I) or a clipped base (S)."""
    runs = F.regexp_extract_all(_c(cigar), F.lit(r"(\d+[=XIS])"), 1)
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(F.when(r.endswith("="), 0).otherwise(1), F.regexp_extract(r, r"(\d+)", 1).cast("int"))))


def cigar_deletions(cigar: ColumnOrName) -> Column:
    """Deleted bases of an alignment."""
    runs = F.regexp_extract_all(_c(cigar), F.lit(r"(\d+)D"), 1)
    return F.aggregate(runs, F.lit(0), lambda s, r: s + r.cast("int"))


RANKS = ("kingdom", "phylum", "class", "order", "family", "genus", "species")


def lineage(label: ColumnOrName, delimiter: str = ";", prefixed: bool = False) -> Column:
    """The seven ranks of a label such as `A;B;C;` or, if prefixed, `k__A;p__B;`.

    Ranks end at the first empty one; missing ones are named `unknown_<lowest known>_<rank>`. A label of one part stays alone.
    """
    parts = F.transform(split_exact(label, delimiter), lambda p: F.trim(p))
    if prefixed:
        parts = F.transform(parts, lambda p: F.regexp_extract(p, "__(.+)$", 1))
    known = F.slice(parts, F.lit(1), F.coalesce(F.nullif(F.array_position(parts, ""), F.lit(0)) - 1, F.size(parts)).cast("int"))
    lowest = F.element_at(known, -1)
    missing = F.transform(F.slice(F.array(*(F.lit(r) for r in RANKS)), F.size(known) + 1, F.greatest(F.lit(0), F.lit(7) - F.size(known))), lambda r: F.concat(F.lit("unknown_"), lowest, F.lit("_"), r))
    return F.when(F.size(split_exact(label, delimiter)) <= 1, parts).when(F.size(known) == 0, F.array().cast("array<string>")).when(F.size(known) >= 7, known).otherwise(F.concat(known, missing))


def kmer_hash(kmer: ColumnOrName) -> Column:
    """A 64-bit hash of a k-mer's 2-bit code."""
    return F.xxhash64(encode(kmer))


def bits(code: ColumnOrName, k: int) -> Column:
    """A k-mer's code in binary, two digits a base, bases apart."""
    digits = F.lpad(F.bin(_c(code).cast("long")), 2 * k, "0")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.substring(digits, 2 * i + 1, F.lit(2))), " ")


def shown(vector: ColumnOrName) -> Column:
    """An array's members in one line, blanks between."""
    return F.array_join(F.transform(_c(vector), lambda x: x.cast("string")), " ")


def timestamp_text(at: ColumnOrName) -> Column:
    """A time as text, to the second."""
    return F.date_format(_c(at), "yyyy-MM-dd HH:mm:ss")
