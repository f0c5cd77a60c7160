"""Local alignment over the full table of one pair: the plain way that `mixtally.operators.align` is held against."""

import numpy as np

from mixtally.operators.align import NOTHING, Alignment, Scoring, _codes


def align(read: str, ref: str, scoring: Scoring = Scoring()) -> Alignment:
    """Aligns a read with a reference."""
    q, r = _codes(read), _codes(ref)
    n, m = len(q), len(r)
    if not n or not m:
        return NOTHING
    gain = scoring.matrix()[:, r]  # of each letter along the reference
    extend, first = scoring.gap_extend, scoring.gap_open
    along = extend * np.arange(1, m + 1, dtype=np.int32)
    best = np.zeros((n + 1, m + 1), np.int32)
    down = np.full((n + 1, m + 1), -(1 << 28), np.int32)  # ends in a gap of the reference (read bases inserted)
    side = np.full((n + 1, m + 1), -(1 << 28), np.int32)  # ends in a gap of the read (reference bases deleted)
    for i in range(1, n + 1):
        np.maximum(down[i - 1, 1:] - extend, best[i - 1, 1:] - first, out=down[i, 1:])
        open_row = np.maximum(best[i - 1, :-1] + gain[q[i - 1]], down[i, 1:])
        np.maximum(open_row, 0, out=open_row)
        # Opening from a cell that is itself in a side gap never beats extending, so a running maximum over open_row is all.
        reach = np.maximum.accumulate(open_row + along)
        side[i, 2:] = reach[:-1] - along[1:] - (first - extend)
        np.maximum(open_row, side[i, 1:], out=best[i, 1:])
    top = int(best.max())
    if top <= 0:
        return NOTHING
    ends = np.argwhere(best == top)
    i, j = ends[np.lexsort((ends[:, 0], ends[:, 1]))[0]]
    return _traced(q, r, best, down, side, int(i), int(j), scoring)


def _traced(q, r, best, down, side, i: int, j: int, scoring: Scoring) -> Alignment:
    matrix = scoring.matrix()
    read_end, ref_end, top = i - 1, j - 1, int(best[i, j])
    steps: list[str] = []
    state = "M"
    while True:
        if state == "M":
            here = best[i, j]
            if here == best[i - 1, j - 1] + matrix[q[i - 1], r[j - 1]]:
                steps.append("=" if q[i - 1] == r[j - 1] else "X")
                i, j = i - 1, j - 1
                if best[i, j] == 0:
                    break
            else:
                state = "I" if here == down[i, j] and down[i, j] >= side[i, j] else "D" if here == side[i, j] else "I"
        elif state == "I":
            steps.append("I")
            state = "I" if down[i, j] == down[i - 1, j] - scoring.gap_extend and down[i - 1, j] > -(1 << 27) else "M"
            i -= 1
        else:
            steps.append("D")
            state = "D" if side[i, j] == side[i, j - 1] - scoring.gap_extend and side[i, j - 1] > -(1 << 27) else "M"
            j -= 1
    steps.reverse()
    runs = [("S", i)] if i else []
    for s in steps:
        if runs and runs[-1][0] == s:
            runs[-1] = (s, runs[-1][1] + 1)
        else:
            runs.append((s, 1))
    if read_end + 1 < len(q):
        runs.append(("S", len(q) - read_end - 1))
    wrong = sum(1 for s in steps if s != "=")
    return Alignment(top, j, ref_end, i, read_end, wrong, "".join(f"{n}{s}" for s, n in runs))
