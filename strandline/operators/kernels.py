"""Kernels in numpy, free of Spark: hashing, dynamic programming, CIGARs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NEG = -(1 << 28)


def mix(key: np.ndarray) -> np.ndarray:
    """The 64-bit mix that breaks ties, over unsigned integers that wrap."""
    u = np.uint64
    x = np.atleast_1d(np.asarray(key)).astype(np.uint64)
    x = x + ~(x << u(32))
    x = x ^ (x >> u(22))
    x = x + ~(x << u(13))
    x = x ^ (x >> u(8))
    x = x + (x << u(3))
    x = x ^ (x >> u(15))
    x = x + ~(x << u(27))
    return x ^ (x >> u(31))


def mixed_column(key: Column) -> Column:
    """mix() of a long column, in decimal, of built-in functions: sums go by halves of 32 bits, so that none overflows."""
    low = F.lit((1 << 32) - 1)

    def added(a: Column, b: Column) -> Column:
        s = a.bitwiseAND(low) + b.bitwiseAND(low)
        t = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(s, 32)
        return F.shiftleft(t, 32).bitwiseOR(s.bitwiseAND(low))

    # each step is a name of its own: it is used twice
    steps = [lambda x: added(x, F.bitwise_not(F.shiftleft(x, 32))), lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 22)), lambda x: added(x, F.bitwise_not(F.shiftleft(x, 13))), lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 8)), lambda x: added(x, F.shiftleft(x, 3)), lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 15)), lambda x: added(x, F.bitwise_not(F.shiftleft(x, 27))), lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 31))]
    states = F.array(key.cast("long"))
    for step in steps:
        states = F.transform(states, step)
    x = F.get(states, F.lit(0))
    return F.when(x >= 0, x.cast("string")).otherwise((x.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("string"))


def codes(seq: str | bytes) -> np.ndarray:
    """0 to 3 for A, C, G, T of either case, 4 for all else."""
    table = np.full(256, 4, np.uint8)
    for i, pair in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
        table[list(pair)] = i
    return table[np.frombuffer(seq.encode() if isinstance(seq, str) else seq, np.uint8)]


def complement(c: np.ndarray) -> np.ndarray:
    return np.where(c < 4, 3 - c, c)[::-1].astype(np.uint8)


def extend(query: np.ndarray, target: np.ndarray, mat: np.ndarray, o, band: int, bonus: int, h0: int) -> tuple[int, int, int, int, int, int]:
    """Extension from an anchor of score h0: (score, query length, target length, target length to the query's end, score to
    the query's end, largest diagonal offset at a best cell).

    Rows go over the target. Within a row, deletions and matches come from the row before and insertions run along the row:
    f[j] = max over i < j of (m[i] - open - (j - i) ext), which is a running maximum, so a row is a few vector operations.
    A cell of score 0 ends: no match follows it. Ties keep the later column of a row and the earlier row."""
    n, m = len(query), len(target)
    oe_del, oe_ins = o.open_del + o.ext_del, o.open_ins + o.ext_ins
    # the band holds no more than a gap that the best possible score pays for
    most = int(mat.max())
    for opened, ext in ((o.open_ins, o.ext_ins), (o.open_del, o.ext_del)):
        band = min(band, max(1, int((n * most + bonus - opened) / ext + 1.0)))
    profile = mat[:, query].astype(np.int64)  # (5, n)
    h = np.zeros(n + 1, np.int64)  # h[j]: score that ends at query j of the row before
    h[0] = h0
    if n:
        h[1:] = np.maximum(h0 - oe_ins - np.arange(n) * o.ext_ins, 0)
    e = np.zeros(n + 1, np.int64)
    best, best_i, best_j, end_best, end_i, off = h0, -1, -1, -1, -1, 0
    beg, end = 0, n
    ramp = np.arange(n + 1, dtype=np.int64) * o.ext_ins
    for i in range(m):
        beg, end = max(beg, i - band), min(end, i + band + 1, n)
        if beg >= end:
            first = max(0, h0 - o.open_del - o.ext_del * (i + 1)) if beg == 0 else 0
            if beg == 0:
                h[0] = first
            break
        span = slice(beg, end)
        diag = h[span]
        match = np.where(diag > 0, diag + profile[target[i]][span], 0)
        score = np.maximum(match, e[span])
        width = end - beg
        # insertions open from match cells of this row only
        opened = np.maximum(match - oe_ins, 0) + ramp[1 : width + 1]
        f = np.zeros(width, np.int64)
        if width > 1:
            f[1:] = np.maximum(np.maximum.accumulate(opened)[:-1] - ramp[1:width], 0)
        score = np.maximum(score, f)
        e[span] = np.maximum(np.maximum(match - oe_del, 0), e[span] - o.ext_del)
        first = max(0, h0 - (o.open_del + o.ext_del * (i + 1))) if beg == 0 else 0
        h[beg + 1 : end + 1] = score
        h[beg] = first
        e[end] = 0
        if end == n and score[-1] >= end_best:
            end_i, end_best = i, int(score[-1])
        row = int(score.max())
        if row == 0:
            break
        j = beg + width - 1 - int(np.argmax(score[::-1]))
        if row > best:
            best, best_i, best_j = row, i, j
            off = max(off, abs(j - i))
        elif o.zdrop > 0:
            di, dj = i - best_i, j - best_j
            gap = (di - dj) * o.ext_del if di > dj else (dj - di) * o.ext_ins
            if best - row - gap > o.zdrop:
                break
        live = np.flatnonzero((h[beg : end + 1] != 0) | (e[beg : end + 1] != 0))
        if not len(live):
            break
        beg, end = beg + int(live[0]), min(beg + int(live[-1]) + 2, n)
    return best, best_j + 1, best_i + 1, end_i + 1, end_best, off


def local(query: np.ndarray, target: np.ndarray, mat: np.ndarray, o, least: int = 0) -> tuple[int, int, int, int, int]:
    """Local alignment: (score, query begin, query end, target begin, target end), ends exclusive; the first target row of
    the best score, and in it the first column. With a score below `least` the begins are -1."""

    def ends(q: np.ndarray, t: np.ndarray, stop: int | None = None) -> tuple[int, int, int]:
        profile, n = mat[:, q].astype(np.int64), len(q)
        h, e = np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
        ramp = np.arange(n + 1, dtype=np.int64) * o.ext_ins
        best, bi, bj = 0, -1, -1
        for i, c in enumerate(t):
            score = np.maximum(np.maximum(h[:-1] + profile[c], 0), e)
            f = np.zeros(n, np.int64)
            if n > 1:
                f[1:] = np.maximum(np.maximum.accumulate(score - o.open_ins + ramp[:n])[:-1] - ramp[1:n], 0)
            score = np.maximum(score, f)
            e = np.maximum(np.maximum(e - o.ext_del, score - o.open_del - o.ext_del), 0)
            h[1:] = score
            row = int(score.max()) if n else 0
            if row > best:
                best, bi, bj = row, i, int(np.argmax(score))
                if stop is not None and best >= stop:
                    break
        return best, bj, bi

    score, qe, te = ends(query, target)
    if score == 0 or score < least:
        return score, -1, qe + 1, -1, te + 1
    back, qb, tb = ends(query[: qe + 1][::-1], target[: te + 1][::-1], score)
    return score, qe - qb, qe + 1, te - tb, te + 1


def second_best(query: np.ndarray, target: np.ndarray, mat: np.ndarray, o, score: int, te: int, least: int) -> int:
    """The best row maximum of at least `least` away from target end te by more than the best score could span; -1 if none."""
    profile, n = mat[:, query].astype(np.int64), len(query)
    h, e = np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
    ramp = np.arange(n + 1, dtype=np.int64) * o.ext_ins
    rows = np.zeros(len(target), np.int64)
    for i, c in enumerate(target):
        s = np.maximum(np.maximum(h[:-1] + profile[c], 0), e)
        f = np.zeros(n, np.int64)
        if n > 1:
            f[1:] = np.maximum(np.maximum.accumulate(s - o.open_ins + ramp[:n])[:-1] - ramp[1:n], 0)
        s = np.maximum(s, f)
        e = np.maximum(np.maximum(e - o.ext_del, s - o.open_del - o.ext_del), 0)
        h[1:] = s
        rows[i] = s.max() if n else 0
    reach = -(-score // int(mat.max()))
    far = np.abs(np.arange(len(target)) - (te - 1)) > reach
    return int(rows[far & (rows >= least)].max(initial=-1))


def global_(query: np.ndarray, target: np.ndarray, mat: np.ndarray, o, band: int) -> tuple[int, list[tuple[str, int]]]:
    """Banded global alignment: score and CIGAR. At ties a match comes before a deletion, and that before an insertion."""
    n, m = len(query), len(target)
    band = max(band, abs(n - m))
    oe_del, oe_ins = o.open_del + o.ext_del, o.open_ins + o.ext_ins
    profile = mat[:, query].astype(np.int64)
    h = np.full(n + 1, NEG, np.int64)
    h[0] = 0
    reach = min(n, band)
    h[1 : reach + 1] = -(o.open_ins + o.ext_ins * np.arange(1, reach + 1))
    e = np.full(n + 1, NEG, np.int64)
    from_ = np.zeros((m, n), np.uint8)  # bits 0-1: 0 match, 1 deletion, 2 insertion; 4: the deletion goes on; 8: the insertion does
    ramp = np.arange(n + 2, dtype=np.int64) * o.ext_ins
    for i in range(m):
        lo, hi = max(0, i - band), min(n, i + band + 1)
        match = h[lo:hi] + profile[target[i]][lo:hi]
        de = e[lo:hi]
        up = np.maximum(match, de)
        width = hi - lo
        # insertions open from cells that a match or a deletion ends, so a running maximum finds them
        left = -(o.open_del + o.ext_del * (i + 1)) if lo == 0 else NEG
        opened = match - oe_ins + ramp[1 : width + 1]
        f = np.full(width, NEG, np.int64)
        if width > 1:
            f[1:] = np.maximum.accumulate(opened)[:-1] - ramp[1:width]
        score = np.maximum(up, f)
        way = np.where(match >= de, 0, 1).astype(np.uint8)
        way[up < f] = 2
        next_e = np.maximum(match - oe_del, de - o.ext_del)
        way |= np.where(de - o.ext_del > match - oe_del, 4, 0).astype(np.uint8)
        way |= np.where(f - o.ext_ins > match - oe_ins, 8, 0).astype(np.uint8)
        from_[i, lo:hi] = way
        h[lo + 1 : hi + 1] = score
        h[lo] = left
        e[lo:hi] = next_e
        if hi < n:
            e[hi] = NEG
            h[hi + 1 :] = NEG
    total = int(h[n])
    ops: list[tuple[str, int]] = []

    def push(op: str, size: int) -> None:
        if size and ops and ops[-1][0] == op:
            ops[-1] = (op, ops[-1][1] + size)
        elif size:
            ops.append((op, size))

    i, j, state = m - 1, n - 1, 0
    while i >= 0 and j >= 0:
        way = int(from_[i, j])
        state = way & 3 if state == 0 else (1 if way & 4 else 0) if state == 1 else (2 if way & 8 else 0)
        if state == 0:
            push("M", 1)
            i, j = i - 1, j - 1
        elif state == 1:
            push("D", 1)
            i -= 1
        else:
            push("I", 1)
            j -= 1
    push("D", i + 1)
    push("I", j + 1)
    return total, ops[::-1]


def edits(query: np.ndarray, target: np.ndarray, cigar: list[tuple[str, int]]) -> tuple[int, str]:
    """(NM, MD) of an alignment; a deletion at either end counts for neither."""
    x = y = run = nm = 0
    md: list[str] = []
    letters = "ACGTN"
    for k, (op, size) in enumerate(cigar):
        if op == "M":
            for i in range(size):
                if query[x + i] == target[y + i]:
                    run += 1
                else:
                    md.append(f"{run}{letters[target[y + i]]}")
                    run, nm = 0, nm + 1
            x, y = x + size, y + size
        elif op == "I":
            x, nm = x + size, nm + size
        elif op == "D":
            if 0 < k < len(cigar) - 1:
                md.append(f"{run}^{''.join(letters[c] for c in target[y : y + size])}")
                run, nm = 0, nm + size
            y += size
    return nm, "".join(md) + str(run)
