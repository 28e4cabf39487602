"""Kernels against full-matrix dynamic programming written apart from them."""

import numpy as np
import pytest

from strandline.operators import kernels as k
from strandline.options import Options, preset

RNG = np.random.default_rng(5)


def pair(n, m, error=0.2):
    t = RNG.integers(0, 4, m).astype(np.uint8)
    q = t[:n].copy() if n <= m else np.concatenate([t, RNG.integers(0, 4, n - m).astype(np.uint8)])
    for i in range(len(q)):
        if RNG.random() < error:
            q[i] = RNG.integers(0, 5)
    if RNG.random() < 0.5 and len(q) > 6:
        q = np.delete(q, slice(2, 4))
    return q, t


def gotoh(q, t, mat, o, local=False):
    """Score of a global or local alignment, cell by cell."""
    n, m = len(q), len(t)
    low = -(10**6)
    h = np.full((m + 1, n + 1), 0 if local else low)
    e, f = np.full((m + 1, n + 1), low), np.full((m + 1, n + 1), low)
    h[0, 0] = 0
    if not local:
        for j in range(1, n + 1):
            h[0, j] = f[0, j] = -(o.open_ins + o.ext_ins * j)
        for i in range(1, m + 1):
            h[i, 0] = e[i, 0] = -(o.open_del + o.ext_del * i)
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            e[i, j] = max(e[i - 1, j] - o.ext_del, h[i - 1, j] - o.open_del - o.ext_del)
            f[i, j] = max(f[i, j - 1] - o.ext_ins, h[i, j - 1] - o.open_ins - o.ext_ins)
            h[i, j] = max(h[i - 1, j - 1] + mat[t[i - 1], q[j - 1]], e[i, j], f[i, j], 0 if local else low)
    return int(h.max()) if local else int(h[m, n])


def extension(q, t, mat, o, h0):
    """Best score and score to the query's end of an extension, cell by cell, without band or drop."""
    n, m = len(q), len(t)
    h = np.zeros((m + 1, n + 1), int)
    h[0, 0] = h0
    for j in range(1, n + 1):
        h[0, j] = max(0, h0 - o.open_ins - o.ext_ins * j)
    for i in range(1, m + 1):
        h[i, 0] = max(0, h0 - o.open_del - o.ext_del * i)
    e = np.zeros((m + 2, n + 1), int)
    best, end = h0, -1
    for i in range(1, m + 1):
        f = 0
        for j in range(1, n + 1):
            match = h[i - 1, j - 1] + mat[t[i - 1], q[j - 1]] if h[i - 1, j - 1] > 0 else 0
            h[i, j] = max(match, e[i, j], f, 0)
            e[i + 1, j] = max(e[i, j] - o.ext_del, match - o.open_del - o.ext_del, 0)
            f = max(f - o.ext_ins, match - o.open_ins - o.ext_ins, 0)
        best = max(best, int(h[i].max()))
        end = max(end, int(h[i, n]))
        if not h[i].any():
            break
    return best, end


@pytest.mark.parametrize("o", [Options(zdrop=0), Options(match=2, mismatch=3, open_del=4, ext_del=2, open_ins=5, ext_ins=1, zdrop=0)])
def test_extension_equals_the_full_matrix(o):
    mat = np.array(o.matrix)
    for _ in range(60):
        q, t = pair(int(RNG.integers(5, 40)), int(RNG.integers(5, 50)))
        h0 = int(RNG.integers(10, 40))
        score, ql, tl, tl_end, end, off = k.extend(q, t, mat, o, 1000, 5, h0)
        best, best_end = extension(q, t, mat, o, h0)
        assert score == best
        # rows are trimmed to live cells, so a small score to the end that insertions alone carry may be missed
        assert end <= max(best_end, 0)
        if best_end >= 20:
            assert end == best_end
        assert 0 <= ql <= len(q) and 0 <= tl <= len(t)


def test_global_alignment_scores_and_cigars_agree():
    o = Options()
    mat = np.array(o.matrix)
    for _ in range(60):
        q, t = pair(int(RNG.integers(5, 30)), int(RNG.integers(5, 30)))
        score, ops = k.global_(q, t, mat, o, 1000)
        assert score == gotoh(q, t, mat, o)
        x = y = again = 0
        for op, n in ops:
            if op == "M":
                again += sum(int(mat[t[y + i], q[x + i]]) for i in range(n))
                x, y = x + n, y + n
            elif op == "I":
                again, x = again - o.open_ins - o.ext_ins * n, x + n
            else:
                again, y = again - o.open_del - o.ext_del * n, y + n
        assert (x, y, again) == (len(q), len(t), score)


def test_local_alignment_equals_the_full_matrix():
    o = Options()
    mat = np.array(o.matrix)
    for _ in range(60):
        q, t = pair(int(RNG.integers(5, 30)), int(RNG.integers(10, 60)))
        score, qb, qe, tb, te = k.local(q, t, mat, o)
        assert score == gotoh(q, t, mat, o, local=True)
        if score:
            assert k.local(q[qb:qe], t[tb:te], mat, o)[0] == score


def test_edits_leave_out_deletions_at_the_ends():
    t, q = k.codes("ACGTACGT"), k.codes("ACTTAC")
    assert k.edits(q, t, [("M", 6), ("D", 2)]) == (1, "2G3")
    assert k.edits(k.codes("ACAC"), k.codes("ACGTAC"), [("M", 2), ("D", 2), ("M", 2)]) == (2, "2^GT2")


def test_mix_wraps_as_whole_numbers_do():
    def slow(x):
        w = (1 << 64) - 1
        x = (x + (~(x << 32) & w)) & w
        x ^= x >> 22
        x = (x + (~(x << 13) & w)) & w
        x ^= x >> 8
        x = (x + (x << 3)) & w
        x ^= x >> 15
        x = (x + (~(x << 27) & w)) & w
        return x ^ x >> 31

    keys = [0, 1, 7, 1 << 40, (1 << 64) - 1]
    assert k.mix(np.array(keys, np.uint64)).tolist() == [slow(x) for x in keys]


def test_options_scale_with_the_match_score():
    o = Options().scaled(match=2, mismatch=5)
    assert (o.mismatch, o.open_del, o.min_score, o.zdrop) == (5, 12, 60, 200)
    assert preset("ont2d").min_seed == 14 and Options().mapq_factor == 3
