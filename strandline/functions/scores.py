"""Closed-form scores of hits: band widths, gaps, mapping qualities, orientations.

Each formula is written once, over the operations of `m`: COLUMNS for Spark columns, PLAIN for numbers. Queries and the
aligner share it."""

from __future__ import annotations

import math
from types import SimpleNamespace

from pyspark.sql import functions as F

from ..options import Options


def _column(x):
    return x if hasattr(x, "cast") else F.lit(x)


PLAIN = SimpleNamespace(trunc=int, real=float, least=min, greatest=max, log=math.log, either=lambda c, a, b: a() if c else b(), distance=abs, flip=lambda a, b: int(a) ^ int(b))
COLUMNS = SimpleNamespace(
    trunc=lambda x: x.cast("int"), real=lambda x: _column(x).cast("double"), least=lambda *x: F.least(*map(_column, x)), greatest=lambda *x: F.greatest(*map(_column, x)), log=F.log,
    either=lambda c, a, b: F.when(c, a()).otherwise(b()), distance=F.abs, flip=lambda a, b: a.cast("int").bitwiseXOR(b.cast("int")),
)


def max_gap(q, o: Options, m=COLUMNS):
    """The longest gap that a query stretch of q bases can pay for, at least 1 and at most twice the band."""
    dele, ins = (m.trunc(m.real(q * o.match - a) / e + 1.0) for a, e in ((o.open_del, o.ext_del), (o.open_ins, o.ext_ins)))
    return m.least(m.greatest(dele, ins, 1), 2 * o.band)


def infer_band(l1, l2, score, match: int, open_: int, ext: int, m=COLUMNS):
    """The band in which a global alignment of l1 and l2 bases can reach the score."""
    even = (l1 == l2) & (l1 * match - score < 2 * (open_ + ext - match))
    return m.either(even, lambda: 0, lambda: m.greatest(m.trunc(m.real(m.least(l1, l2) * match - score - open_) / ext + 2.0), m.distance(l1 - l2)))


def raw_mapq(diff, match: int, m=COLUMNS):
    return m.trunc(6.02 * diff / match + 0.499)


def single_mapq(score, sub, csub, sub_n, qspan, rspan, frac_rep, o: Options, m=COLUMNS, covered=None):
    """Mapping quality of one hit from its score, its runner-up and its identity; 0 to 60. covered is asked for without
    mapq_len only."""
    other = m.greatest(m.either(sub == 0, lambda: o.min_seed * o.match, lambda: sub), csub)

    def quality():
        span = m.greatest(qspan, rspan)
        identity = 1.0 - m.real(span * o.match - score) / (o.match + o.mismatch) / span
        if o.mapq_len > 0:
            shrink = m.either(span < o.mapq_len, lambda: 1.0, lambda: m.real(o.mapq_factor) / m.log(m.real(span)))
            t = shrink * identity * identity
            q = m.trunc(6.02 * (score - other) / o.match * t * t + 0.499)
        else:
            whole = m.trunc(30.0 * (1.0 - m.real(other) / score) * m.log(m.real(covered)) + 0.499)
            q = m.either(identity < 0.95, lambda: m.trunc(whole * identity * identity + 0.499), lambda: whole)
        q = m.either(sub_n > 0, lambda: q - m.trunc(4.343 * m.log(m.real(sub_n) + 1) + 0.499), lambda: q)
        return m.trunc(m.greatest(m.least(q, 60), 0) * (1.0 - frac_rep) + 0.499)

    return m.either((other >= score) | (score == 0), lambda: 0, quality)


def orientation(half, b1, b2, m=COLUMNS):
    """(orientation 0 to 3 as FF, FR, RF, RR; distance) of two starts in the doubled space."""
    apart = (b1 >= half) != (b2 >= half)
    p2 = m.either(apart, lambda: 2 * half - 1 - b2, lambda: b2)
    return m.flip(m.either(apart, lambda: 1, lambda: 0), m.either(p2 > b1, lambda: 0, lambda: 3)), m.distance(p2 - b1)
