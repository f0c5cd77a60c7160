"""Local alignment of reads with candidate references, and the log-likelihood of a read given its alignment.

Pairs of an Arrow batch are aligned together, by affine-gap dynamic programming in three passes that keep no full table:

1. scores and ends: pairs of like lengths are the vector axis, in 16-bit lanes where no score can exceed them, else in 32-bit ones;
   of each pair two rows of the table are kept. Gaps in the read carry from row to row, gaps in the reference are a running maximum
   along the row, so no cell is visited in Python;
2. starts: the same pass backward from the end, through cells that a best alignment can cross, finds all starts that give the score,
   which bound the part of the table that can matter;
3. the trace: only a band around the end's diagonal is filled again, a byte a cell. The score says how many gaps a best alignment
   can have, so the band holds every best one, and ties fall as they would in the full table.

Of equally good ends the one earliest in the reference wins, then earliest in the read. A step back prefers the diagonal, then the
longer read gap; the alignment begins where its score is used up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

#: Letters to codes: A 0, C 1, G 2, T and U 3, others 4.
CODES = np.full(256, 4, np.int8)
for _code, _letters in enumerate(("Aa", "Cc", "Gg", "TtUu")):
    CODES[[ord(c) for c in _letters]] = _code


@dataclass(frozen=True)
class Scoring:
    """Alignment scores. A gap's first base costs gap_open, each further one gap_extend. N against anything scores 0."""

    match: int = 2
    mismatch: int = 2
    gap_open: int = 3
    gap_extend: int = 1

    def matrix(self) -> np.ndarray:
        m = np.full((5, 5), -self.mismatch, np.int32)
        np.fill_diagonal(m, self.match)
        m[4, :] = m[:, 4] = 0
        return m


@dataclass(frozen=True)
class Alignment:
    """Best local alignment: ends inclusive, from 0; cigar with =, X, I, D and S; no aligned base: score 0, empty cigar, ends -1."""

    score: int
    ref_begin: int
    ref_end: int
    read_begin: int
    read_end: int
    mismatches: int
    cigar: str


NOTHING = Alignment(0, -1, -1, -1, -1, 0, "")


def _codes(seq: str) -> np.ndarray:
    return CODES[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


#: Codes behind the end of a reference and of a read in a batch; they equal nothing.
_REF_END, _READ_END = 5, 6
#: Cells of a row over all pairs of a batch, and bytes of a batch's trace; a single pair may have more.
ROW_CELLS, TRACE_BYTES = 1 << 15, 1 << 24


def _lanes(score: int, width: int, scoring: Scoring) -> tuple[type, int]:
    """The type that scores of up to `score` fit along `width` cells, and what stands for no score in it."""
    most = score + scoring.gap_extend * (width + 2) + 2 * (scoring.match + scoring.mismatch + scoring.gap_open)
    return (np.int16, -8000) if most < 16_000 else (np.int32, -(1 << 28))


def _columns(seqs: list[np.ndarray], length: int, end: int) -> np.ndarray:
    """Sequences as columns of an array, `end` behind their ends."""
    out = np.full((length, len(seqs)), end, np.int8)
    for b, s in enumerate(seqs):
        out[: len(s), b] = s
    return out


class _Gains:
    """Scores of a read's base in each column against the references' bases."""

    def __init__(self, q: np.ndarray, r: np.ndarray, scoring: Scoring, kind: type, low: int):
        self.q, self.r, self.kind, self.more = q, r, kind, kind(scoring.match + scoring.mismatch)
        self.base = np.where(r == _REF_END, kind(low // 2), kind(-scoring.mismatch))
        self.any_ref, self.any_read = r == 4 if (r == 4).any() else None, (q == 4).any(axis=1)

    def row(self, i: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        own = slice(begin, end)
        out = (self.r[own] == self.q[i]).astype(self.kind)
        out *= self.more
        out += self.base[own]
        # An N scores 0 against any base, but not against what stands behind the ends.
        if self.any_ref is not None:
            out[self.any_ref[own] & (self.q[i] != _READ_END)] = 0
        if self.any_read[i]:
            out[(self.q[i] == 4) & (self.r[own] != _REF_END)] = 0
        return out


def _scores(reads: list[np.ndarray], refs: list[np.ndarray], scoring: Scoring) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best score of each pair and where it ends, as lengths of the read and the reference up to there."""
    n, m = max(map(len, reads)), max(map(len, refs))
    kind, low = _lanes(scoring.match * min(n, m), m, scoring)
    gains = _Gains(_columns(reads, n, _READ_END), _columns(refs, m, _REF_END), scoring, kind, low)
    pairs = len(reads)
    along = (scoring.gap_extend * np.arange(1, m + 1)).astype(kind)[:, None]
    opening, extend, first = kind(scoring.gap_open - scoring.gap_extend), kind(scoring.gap_extend), kind(scoring.gap_open)
    best, down = np.zeros((m + 1, pairs), kind), np.full((m, pairs), low, kind)
    top, row = np.zeros((m, pairs), kind), np.zeros((m, pairs), np.int32)
    for i in range(n):
        np.maximum(down - extend, best[1:] - first, out=down)
        opened = best[:-1] + gains.row(i)
        np.maximum(opened, down, out=opened)
        np.maximum(opened, 0, out=opened)
        # Opening from a cell that is itself in a side gap never beats extending, so a running maximum over `opened` is all.
        reach = np.maximum.accumulate(opened + along, axis=0)
        best[1] = opened[0]
        np.maximum(opened[1:], reach[:-1] - along[1:] - opening, out=best[2:])
        np.copyto(row, i + 1, where=best[1:] > top)
        np.maximum(top, best[1:], out=top)
    j = top.argmax(axis=0)
    each = np.arange(pairs)
    return top[j, each].astype(np.int64), row[j, each].astype(np.int64), j + 1


def _starts(reads: list[np.ndarray], refs: list[np.ndarray], tops: np.ndarray, scoring: Scoring) -> tuple[np.ndarray, np.ndarray]:
    """How far back, along the read and the reference, the alignments reach that end at both ends with these scores.

    Backward from its end, the score of a best alignment is always above 0: a part that adds nothing would end it elsewhere. Cells
    at or below 0 are dropped.
    """
    n, m = max(map(len, reads)), max(map(len, refs))
    kind, low = _lanes(scoring.match * min(n, m), m, scoring)
    gains = _Gains(_columns([q[::-1] for q in reads], n, _READ_END), _columns([r[::-1] for r in refs], m, _REF_END), scoring, kind, low)
    pairs = len(reads)
    along = (scoring.gap_extend * np.arange(1, m + 1)).astype(kind)[:, None]
    opening, extend, first, none = kind(scoring.gap_open - scoring.gap_extend), kind(scoring.gap_extend), kind(scoring.gap_open), kind(low)
    best, down = np.full((m + 1, pairs), none, kind), np.full((m, pairs), none, kind)
    best[0] = 0
    goal = tops.astype(kind)
    back, along_ref = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    for i in range(n):
        np.maximum(down - extend, best[1:] - first, out=down)
        np.maximum(down, none, out=down)
        opened = best[:-1] + gains.row(i)
        np.maximum(opened, down, out=opened)
        reach = np.maximum.accumulate(np.maximum(opened, none) + along, axis=0)
        best[0] = none
        best[1] = opened[0]
        np.maximum(opened[1:], reach[:-1] - along[1:] - opening, out=best[2:])
        best[1:][best[1:] <= 0] = none
        hit = best[1:] == goal
        if hit.any():
            j, b = np.nonzero(hit)
            back[b] = i + 1
            np.maximum.at(along_ref, b, j + 1)
    return back, along_ref


def _traces(reads: list[np.ndarray], refs: list[np.ndarray], half: int, scoring: Scoring) -> list[np.ndarray]:
    """Steps of the best alignments that end at both ends, from the first on, by a band of `half` cells beside the end's diagonal.

    A step is the code of its letter: = X I D.
    """
    pairs, n, width = len(reads), max(map(len, reads)), 2 * half + 1
    size = np.array([[len(q), len(r)] for q, r in zip(reads, refs)])
    # Cell c of row i (from 1) is the reference's place i + shift + c (from 0 where i = 1), so a band is a slice of the column.
    shift = size[:, 1] - size[:, 0] - half
    r = np.full((n + width, pairs), _REF_END, np.int8)
    for b, s in enumerate(refs):
        t = int(shift[b])
        r[max(0, -t) : max(0, -t) + len(s) - max(0, t), b] = s[max(0, t) :]
    kind, low = _lanes(scoring.match * min(n, int(size[:, 1].max())), width, scoring)
    gains = _Gains(_columns(reads, n, _READ_END), r, scoring, kind, low)
    along = (scoring.gap_extend * np.arange(1, width + 1)).astype(kind)[:, None]
    opening, extend, first, none = kind(scoring.gap_open - scoring.gap_extend), kind(scoring.gap_extend), kind(scoring.gap_open), kind(low)
    best, down = np.zeros((width + 1, pairs), kind), np.full((width + 1, pairs), none, kind)
    trace = np.full((n + 1, width, pairs), 16, np.uint8)
    for i in range(n):
        above = down[1:] - extend
        diagonal = best[:-1] + gains.row(i, i, i + width)
        np.maximum(above, best[1:] - first, out=down[:-1])
        np.maximum(down, none, out=down)
        opened = np.maximum(np.maximum(diagonal, down[:-1]), 0)
        reach = np.maximum.accumulate(opened + along, axis=0)
        side = np.full((width, pairs), none, kind)
        side[1:] = reach[:-1] - along[1:] - opening
        np.maximum(opened, side, out=best[:-1])
        t = trace[i + 1]
        t[:] = best[:-1] == diagonal
        t |= ((best[:-1] == down[:-1]) & (down[:-1] >= side)).view(np.uint8) << 1
        t |= ((down[:-1] == above) & (above > none // 2)).view(np.uint8) << 2
        t[1:] |= (side[1:] == side[:-1] - extend).view(np.uint8) << 3
        t |= (best[:-1] == 0).view(np.uint8) << 4
    # All pairs step back together: state 0 looks at a cell, 1 is in a read gap, 2 in a reference gap.
    i, c, state, own = size[:, 0].copy(), np.full(pairs, half), np.zeros(pairs, np.int64), np.arange(pairs)
    steps: list[list[np.ndarray]] = []
    q = gains.q
    while len(own):
        t = trace[i, c, own]
        state = np.where((state == 0) & (t & 1 == 0), np.where(t & 2 > 0, 1, 2), state)
        same = q[i - 1, own] == r[i - 1 + c, own]
        steps.append([own, np.where(state == 0, np.where(same, ord("="), ord("X")), np.where(state == 1, ord("I"), ord("D"))).astype(np.uint8)])
        i_next = i - (state != 2)
        c_next = c + (state == 1) - (state == 2)
        over = (state == 0) & (trace[i_next, c_next, own] & 16 > 0)
        state = np.where(state == 1, np.where(t & 4 > 0, 1, 0), np.where(state == 2, np.where(t & 8 > 0, 2, 0), 0))
        go = ~over
        i, c, state, own = i_next[go], c_next[go], state[go], own[go]
    who, what = np.concatenate([s[0] for s in steps]), np.concatenate([s[1] for s in steps])
    order = np.argsort(who, kind="stable")
    return [x[::-1] for x in np.split(what[order], np.cumsum(np.bincount(who, minlength=pairs))[:-1])]


def _batches(rows: np.ndarray, columns: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Numbers of pairs, like ones together, as many as have `cells` in their columns."""
    order = np.lexsort((rows, columns))
    begin = 0
    while begin < len(order):
        end = begin + max(1, int(np.searchsorted(columns[order[begin:]] * np.arange(1, len(order) - begin + 1), cells, side="right")))
        yield order[begin:end]
        begin = end


def align_pairs(pairs: list[tuple[str, str]], scoring: Scoring = Scoring()) -> list[Alignment]:
    """Alignments of (read, reference) pairs, in their order."""
    out = [NOTHING] * len(pairs)
    coded = [(_codes(q), _codes(r)) for q, r in pairs]
    able = np.array([k for k, (q, r) in enumerate(coded) if len(q) and len(r)], np.int64)
    if not len(able):
        return out
    q, r = [coded[k][0] for k in able], [coded[k][1] for k in able]
    lengths = np.array([[len(x), len(y)] for x, y in zip(q, r)])
    top, read_end, ref_end = (np.zeros(len(able), np.int64) for _ in range(3))
    for own in _batches(lengths[:, 0], lengths[:, 1], ROW_CELLS):
        top[own], read_end[own], ref_end[own] = _scores([q[k] for k in own], [r[k] for k in own], scoring)
    found = np.flatnonzero(top > 0)
    if not len(found):
        return out
    # A best alignment's gaps cost what its bases, were they all equal, would gain beyond its score.
    gaps = lambda bases: np.maximum(0, (scoring.match * bases - top - scoring.gap_open) // max(1, scoring.gap_extend) + 1)
    reach = np.minimum(ref_end, read_end + gaps(read_end))
    back, along = (np.zeros(len(able), np.int64) for _ in range(2))
    for part in _batches(read_end[found], reach[found], ROW_CELLS):
        own = found[part]
        back[own], along[own] = _starts([q[k][: read_end[k]] for k in own], [r[k][ref_end[k] - reach[k] : ref_end[k]] for k in own], top[own], scoring)
    half = gaps(np.minimum(back, along))
    # Bands of like width go together: rounded up to the next power of 2.
    half = np.where(half > 0, 2 ** np.ceil(np.log2(np.maximum(half, 1))).astype(np.int64), 1)
    for h in np.unique(half[found]):
        group = found[half[found] == h]
        for part in _batches(along[group], back[group] * (2 * h + 1), TRACE_BYTES):
            own = group[part]
            for k, steps in zip(own, _traces([q[k][read_end[k] - back[k] : read_end[k]] for k in own], [r[k][ref_end[k] - along[k] : ref_end[k]] for k in own], int(h), scoring)):
                out[able[k]] = _told(int(top[k]), int(read_end[k]), int(ref_end[k]), len(q[k]), steps)
    return out


def _told(top: int, read_end: int, ref_end: int, length: int, steps: np.ndarray) -> Alignment:
    """The alignment of these steps that ends there."""
    edge = np.flatnonzero(np.diff(steps)) + 1
    begin = np.concatenate([[0], edge])
    size = np.diff(np.append(begin, len(steps)))
    read_begin = read_end - int((steps != ord("D")).sum())
    runs = [f"{n}{chr(c)}" for n, c in zip(size.tolist(), steps[begin].tolist())]
    cigar = (f"{read_begin}S" if read_begin else "") + "".join(runs) + (f"{length - read_end}S" if length > read_end else "")
    return Alignment(top, ref_end - int((steps != ord("I")).sum()), ref_end - 1, read_begin, read_end - 1, int((steps != ord("=")).sum()), cigar)


def align(read: str, ref: str, scoring: Scoring = Scoring()) -> Alignment:
    """Aligns a read with a reference."""
    return align_pairs([(read, ref)], scoring)[0]


@lru_cache(maxsize=8)
def _errors(offset: int) -> np.ndarray:
    q = np.arange(128) - offset
    e = np.power(10.0, -np.maximum(q, 0) / 10.0)
    if offset == 64:
        e[q == 2] = 0.75
    return np.minimum(e, 1 - 1e-12)  # quality 0 says that the base is wrong for certain


def units(cigar: str) -> tuple[np.ndarray, int]:
    """Whether each base of the read matches, and the number of deleted bases."""
    out, deleted, n = [], 0, 0
    for c in cigar:
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            if c == "D":
                deleted += n
            elif c in "=XIS":
                out.append(np.full(n, c == "="))
            n = 0
    return (np.concatenate(out) if out else np.zeros(0, bool)), deleted


def log_likelihood(cigar: str, quality: str, offset: int = 33) -> float:
    """Sum of ln(1 - e) over matching bases and ln(e / 3) over others, less 2 for each deleted base."""
    match, deleted = units(cigar)
    codes = np.frombuffer(quality.encode("latin-1"), np.uint8).astype(int)
    if len(match) != len(codes):
        raise ValueError(f"an alignment of {len(match)} bases has {len(codes)} qualities")
    if len(codes) and codes.min() < offset:
        raise ValueError("a quality is below the offset")
    e = _errors(offset)[codes]
    return float(np.where(match, np.log1p(-e), np.log(e / 3)).sum() - 2.0 * deleted)


ALIGNMENT = StructType([StructField("score", IntegerType()), StructField("ref_begin", IntegerType()), StructField("ref_end", IntegerType()), StructField("read_begin", IntegerType()), StructField("read_end", IntegerType()), StructField("mismatches", IntegerType()), StructField("cigar", StringType()), StructField("loglik", DoubleType())])


def alignment_udf(offset: int = 33, scoring: Scoring = Scoring()):
    """A pandas UDF (read, quality, reference) -> struct of the alignment and its loglik. Equal pairs of a batch are aligned once, all together."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for read, quality, ref in parts:
            keys = [(q or "", r or "") for q, r in zip(read, ref)]
            distinct = list(dict.fromkeys(keys))
            done = dict(zip(distinct, align_pairs(distinct, scoring)))
            rows = []
            for key, own in zip(keys, quality):
                a = done[key]
                rows.append((a.score, a.ref_begin, a.ref_end, a.read_begin, a.read_end, a.mismatches, a.cigar, log_likelihood(a.cigar, own or "", offset) if a.cigar else None))
            yield pd.DataFrame(rows, columns=[f.name for f in ALIGNMENT])

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, ALIGNMENT)


def score_single(cands: DataFrame, offset: int = 33, scoring: Scoring = Scoring()) -> DataFrame:
    """cands (read_id, ref_id, seq, qual, ref_seq) with the alignment's columns; reads are taken as they stand."""
    return cands.withColumn("a", alignment_udf(offset, scoring)("seq", "qual", "ref_seq")).select(*cands.columns, "a.*")


def score_paired(cands: DataFrame, offset: int = 33, scoring: Scoring = Scoring(), reverse_quality: bool = True) -> DataFrame:
    """cands (read_id, ref_id, seq1, qual1, seq2, qual2, ref_seq) with loglik, the sum over both mates.

    Mate 2 is aligned as its reverse complement, its qualities reversed with it (or, with reverse_quality false, as they stand).
    """
    from mixtally.functions.sequences import reverse_complement

    udf = alignment_udf(offset, scoring)
    quality: Column = F.reverse("qual2") if reverse_quality else F.col("qual2")
    rows = cands.withColumn("a1", udf("seq1", "qual1", "ref_seq")).withColumn("a2", udf(reverse_complement("seq2"), quality, F.col("ref_seq")))
    return rows.select(*cands.columns, (F.col("a1.loglik") + F.col("a2.loglik")).alias("loglik"), F.col("a1.cigar").alias("cigar1"), F.col("a2.cigar").alias("cigar2"))
