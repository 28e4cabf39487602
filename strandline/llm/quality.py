"""Line-level quality: a linear-chain conditional random field over the lines of a document.

Each line has two states, good and bad. Its features are shares of byte classes, lengths and repetition, of itself and of
the lines before and behind it. Forward-backward gives each line's marginal of good; the document's raw score is their
mean, weighted by line length; a logistic calibration turns it into the probability of label 1. The field is trained by
likelihood, with the labels of lines latent under the label of their document, on a sample of at most `most_documents`
labelled documents (drawn by a hash of the id), of which a fifth only fits the calibration.

Memory is in proportion to a task's longest text: features are summed one by one, and a chain of very many lines is cut
into blocks that advance together.

Defined results: an empty table gives no row; a null text counts as empty; an empty text is one empty line and is scored like any other; lines of any
number and length are read whole; without labels of both kinds every score is the share of label 1 (1 if there is none);
repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, string_array, tidy, views, with_text
from .shingles import word_hashes

CLASSES = 8  # space, lower, upper, digit, sentence mark, bracket or quote, other symbol, non-ASCII
KIND = np.full(256, 6, np.uint8)
KIND[:33] = 0
KIND[[*range(97, 123)]] = 1
KIND[[*range(65, 91)]] = 2
KIND[[*range(48, 58)]] = 3
KIND[[ord(c) for c in ".,;:?"]] = 4
KIND[[ord(c) for c in "()[]'\"-"]] = 5
KIND[128:] = 7
OWN = CLASSES + 8  # features of a line by itself
#: Log odds by which a document's label speaks for the label of each of its lines.
EVIDENCE = 1.0


@dataclass
class Lines:
    """The lines of texts, end to end: byte length, owner (which text), and the number of lines of each text."""

    length: np.ndarray
    owner: np.ndarray
    count: np.ndarray

    def shifted(self, x: np.ndarray, by: int) -> np.ndarray:
        """Row i: that of the line before (by 1) or behind (by -1) in the same text, zeros where there is none."""
        out = np.zeros_like(x)
        if len(x) > 1:
            same = (self.owner[1:] == self.owner[:-1]).reshape(-1, *[1] * (x.ndim - 1))
            if by > 0:
                out[1:] = x[:-1] * same
            else:
                out[:-1] = x[1:] * same
        return out


def line_columns(texts: pa.Array) -> tuple[Lines, Iterator[np.ndarray]]:
    """The lines, and OWN features of each by itself, a column at a time, so that texts of very many lines fit."""
    raw, off = views(texts)
    n = len(off) - 1
    ends_line = np.zeros(len(raw) + 1, bool)
    ends_line[1:] = raw == 10
    ends_line[off] = True
    # line starts: text starts, and positions behind a line feed; an empty text has one line of length 0
    cuts = np.flatnonzero(ends_line)
    starts_in = cuts[:-1] if len(cuts) > 1 else np.zeros(0, np.int64)
    owner = np.searchsorted(off, starts_in, side="right") - 1
    empty = np.flatnonzero(np.diff(off) == 0)
    start = np.concatenate([starts_in, off[empty]])
    end = np.concatenate([cuts[1:] if len(cuts) > 1 else starts_in, off[empty]])
    owner = np.concatenate([owner, empty])
    if len(empty):
        order = np.argsort(owner, kind="stable")
        start, end, owner = start[order], end[order], owner[order]
    lines = Lines(end - start, owner, np.bincount(owner, minlength=n))

    def columns():
        length = lines.length
        kinds, full = KIND[raw], np.flatnonzero(length > 0)
        for k in range(CLASSES):
            x = np.zeros(len(start), np.float32)
            if len(full):
                x[full] = np.add.reduceat((kinds == k).astype(np.int32), start[full]) / length[full]
            yield x
        del kinds
        bounds = np.concatenate([start[full], [len(raw)]]) if len(full) else np.zeros(1, np.int64)
        words, counts = word_hashes(raw, bounds)
        n_words = np.zeros(len(start), np.int64)
        n_words[full] = counts
        yield (np.log1p(length) / 6).astype(np.float32)
        yield (np.log1p(n_words) / 5).astype(np.float32)
        yield np.minimum(length / np.maximum(n_words, 1) / 10, 3).astype(np.float32)
        line_of = np.repeat(full, counts)
        yield (different(words, line_of, len(start)) / np.maximum(n_words, 1)).astype(np.float32)
        doc_of = owner[line_of]
        yield (different(words, doc_of, n) / np.maximum(np.bincount(doc_of, minlength=n), 1)).astype(np.float32)[owner]
        del line_of, doc_of
        # lines that stand more than once in their document
        again = np.zeros(len(start), np.float32)
        if len(words):
            ends = np.cumsum(n_words)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words, dtype=np.uint64)])
            worded = np.flatnonzero(n_words)
            sums = (total[ends] - total[ends - n_words])[worded]
            same = worded[np.lexsort((sums, owner[worded]))]
            by_line = np.zeros(len(start), np.uint64)
            by_line[worded] = sums
            eq = (by_line[same][1:] == by_line[same][:-1]) & (owner[same][1:] == owner[same][:-1])
            again[same[1:][eq]] = 1
            again[same[:-1][eq]] = 1
        yield again
        last = raw[np.maximum(np.where(ends_line[end] & (end > start) & (raw[np.maximum(end - 1, 0)] == 10), end - 2, end - 1), 0)] if len(raw) else np.zeros(len(start), np.uint8)
        yield (np.isin(last, [46, 33, 63]) & (length > 0)).astype(np.float32)
        yield np.minimum(np.log1p(lines.count) / 5, 2).astype(np.float32)[owner]

    return lines, columns()


def different(words: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """How many different words each of n owners has."""
    order = np.lexsort((words, of))
    w, o = words[order], of[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n)


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, 3 * OWN + 1) features of each line, the line before, the line behind and 1; byte length of each line, lines of
    each text."""
    lines, columns = line_columns(texts)
    x = np.stack(list(columns), 1).astype(float)
    return np.hstack([x, lines.shifted(x, 1), lines.shifted(x, -1), np.ones((len(x), 1))]), lines.length.astype(float), lines.count


def forward_backward(emit: np.ndarray, lines: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains laid end to end: marginals (lines, 2), the sum over pairs of neighbours (2, 2) of their joint marginals,
    and log Z of each chain. All chains of a batch advance together, the longest first."""
    order = np.argsort(-lines, kind="stable")
    n = lines[order]
    first = (np.cumsum(lines) - lines)[order]
    longest = int(n[0]) if len(n) else 0
    active = [int(np.searchsorted(-n, -t, side="left")) for t in range(longest)]  # chains with more than t lines
    alpha, log_z = np.zeros_like(emit), np.zeros(len(n))
    top = emit.max(axis=1, keepdims=True) if len(emit) else emit
    e, w = np.exp(emit - top), np.exp(trans)
    for t in range(longest):
        rows = first[: active[t]] + t
        a = e[rows] if t == 0 else (alpha[rows - 1] @ w) * e[rows]
        s = a.sum(axis=1, keepdims=True)
        alpha[rows] = a / s
        log_z[: active[t]] += np.log(s[:, 0]) + top[rows, 0]
    beta, pairs = np.ones_like(emit), np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        rows = first[: active[t + 1]] + t
        eb = e[rows + 1] * beta[rows + 1]
        b = eb @ w.T
        joint_norm = (alpha[rows] * b).sum(axis=1)
        pairs += w * ((alpha[rows] / joint_norm[:, None]).T @ eb)
        beta[rows] = b / b.sum(axis=1, keepdims=True)
    m = alpha * beta
    out = np.zeros(len(n))
    out[order] = log_z
    return m / m.sum(axis=1, keepdims=True), pairs, out


def long_chain(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The marginals of one chain of any length: blocks of about sqrt(n) lines advance together. The product of a block's
    2 x 2 steps takes a state from its start to its end, so states at the bounds are known before the lines between them."""
    n = len(emit)
    size = max(1, math.isqrt(n))
    blocks = -(-n // size)
    e = np.ones((blocks * size, 2))
    e[:n] = np.exp(emit - emit.max(axis=1, keepdims=True))
    e, w = e.reshape(blocks, size, 2), np.exp(trans)
    real = (np.arange(blocks * size) < n).reshape(blocks, size)
    one = np.eye(2)

    def step(t: int) -> np.ndarray:
        """(blocks, 2, 2): from the state before line t of each block to the state at it."""
        m = w[None] * e[:, t, None, :]
        m[~real[:, t]] = one
        if t == 0:
            m[0] = np.diag(e[0, 0])
        return m

    whole = np.broadcast_to(one, (blocks, 2, 2)).copy()
    for t in range(size):
        whole = whole @ step(t)
        whole /= whole.sum(axis=(1, 2), keepdims=True)
    enter, leave = np.ones((blocks, 2)), np.ones((blocks, 2))
    for b in range(1, blocks):
        enter[b] = enter[b - 1] @ whole[b - 1]
        enter[b] /= enter[b].sum()
    for b in range(blocks - 2, -1, -1):
        leave[b] = whole[b + 1] @ leave[b + 1]
        leave[b] /= leave[b].sum()
    out = np.empty((blocks, size, 2))
    a = enter
    for t in range(size):
        a = (a[:, None, :] @ step(t))[:, 0]
        a /= a.sum(axis=1, keepdims=True)
        out[:, t] = a
    a = leave
    for t in range(size - 1, -1, -1):
        out[:, t] *= a
        a = (step(t) @ a[:, :, None])[:, :, 0]
        a /= a.sum(axis=1, keepdims=True)
    out = out.reshape(-1, 2)[:n]
    return out / out.sum(axis=1, keepdims=True)


#: Lines from which a chain is cut into blocks; the result is the same.
LONG = 4096


def marginals_of(emit: np.ndarray, count: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The marginals of chains laid end to end."""
    if not (count > LONG).any():
        return forward_backward(emit, count, trans)[0]
    at, out = np.concatenate([[0], np.cumsum(count)]), np.empty_like(emit)
    short = np.repeat(count <= LONG, count)
    out[short] = forward_backward(emit[short], count[count <= LONG], trans)[0]
    for i in np.flatnonzero(count > LONG):
        out[at[i] : at[i + 1]] = long_chain(emit[at[i] : at[i + 1]], trans)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # (features, 2)
    trans: np.ndarray  # (2, 2)
    slope: float
    level: float
    constant: float | None = None

    def emissions(self, lines: Lines, columns: Iterator[np.ndarray]) -> np.ndarray:
        """(lines, 2), summed feature by feature: no matrix of all features is ever held."""
        w = self.weights / self.scale[:, None]
        own, before, behind = (np.zeros((len(lines.owner), 2)) for _ in range(3))
        for k, x in enumerate(columns):
            for part, at in ((own, k), (before, OWN + k), (behind, 2 * OWN + k)):
                part += x[:, None] * w[at]
        own += lines.shifted(before, 1)
        own += lines.shifted(behind, -1)
        return own + (w[-1] - self.mean @ w)

    def raw(self, texts: pa.Array) -> np.ndarray:
        """Logit of the length-weighted mean marginal of good."""
        lines, columns = line_columns(texts)
        good = marginals_of(self.emissions(lines, columns), lines.count, self.trans)[:, 1]
        at, weight = np.cumsum(lines.count) - lines.count, lines.length + 1.0
        p = np.clip(np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at), 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-(self.slope * self.raw(texts) + self.level)))


def train_field(x: np.ndarray, lines: np.ndarray, y: np.ndarray, steps: int = 120, rate: float = 0.15, l2: float = 1e-3, evidence: float = EVIDENCE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by Adam on the mean log likelihood of the document labels.

    Line labels are latent. A document's label speaks for each of its lines by `evidence` (log odds), no more, so a good line
    of a bad document may stay good; the gradient is the field's expectation with that evidence minus the one without."""
    told = np.eye(2)[np.repeat(y, lines)] * evidence
    weights, trans = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, trans)]
    for step in range(1, steps + 1):
        emit = x @ weights
        free, free_pairs, _ = forward_backward(emit, lines, trans)
        held, held_pairs, _ = forward_backward(emit + told, lines, trans)
        grads = (x.T @ (free - held) / len(x) + l2 * weights, (free_pairs - held_pairs) / len(x) + l2 * trans)
        for p, g, m in zip((weights, trans), grads, moments):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return weights, trans


def logistic(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and level of a logistic curve by damped Newton steps, with a weak pull to slope 1."""
    t = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        g = x.T @ (p - y) + 0.01 * (t - [1.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        t = t - np.clip(np.linalg.solve(h, g), -1, 1)
    return float(t[0]), float(t[1])


def fit(docs: DataFrame, labels: DataFrame, most_documents: int = 4000) -> Model:
    """docs (doc_id, text), labels (doc_id, quality 0 or 1); the sample has as many of each kind, as far as they go. A hash of
    the id and the label draws it, so it is the same however the rows are dealt over files and tasks."""
    labels = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    sizes = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(*[np.zeros(0)] * 4, 1.0, 0.0, constant=float(1 in sizes or not sizes))
    rate = {k: min(1.0, 0.45 * most_documents / n) for k, n in sizes.items()}
    draw = F.pmod(F.xxhash64("doc_id", "quality"), F.lit(1 << 30)) / float(1 << 30)
    drawn = labels.where(draw < F.when(F.col("quality") == 1, rate[1]).otherwise(rate[0]))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")  # about 0.9 most_documents rows
    sample = sample.select("doc_id", "text", "quality", F.xxhash64("doc_id", "text").alias("key"))

    @tidy
    def features(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                x, length, lines = line_features(string_array(part.column("text")))
                at = np.concatenate([[0], np.cumsum(lines)])
                rows = [(x[a:b].astype(np.float32).tobytes(), length[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("quality"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["key", "quality", "x", "length"])

    # features are made where the texts are; rows that repeat an id with its text count once
    made = sample.mapInArrow(features, "key long, quality int, x binary, length binary").dropDuplicates(["key", "quality"])
    got = sorted(made.orderBy("key", "quality").limit(most_documents).collect(), key=lambda r: (r["key"], r["quality"]))
    if len({r["quality"] for r in got}) < 2:
        return Model(*[np.zeros(0)] * 4, 1.0, 0.0, constant=sizes[1] / (sizes[0] + sizes[1]))
    got = [got[i] for i in np.random.default_rng(7).permutation(len(got))]
    xs = [np.frombuffer(r["x"], np.float32).reshape(-1, 3 * OWN + 1) for r in got]
    weights_of = [np.frombuffer(r["length"], float) + 1 for r in got]
    y = np.array([r["quality"] for r in got])
    fold = len(got) // 5
    used = slice(fold, None)
    x, lines = np.concatenate(xs[used]).astype(float), np.array([len(v) for v in xs[used]])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    mean[-1], scale[-1] = 0, 1
    weights, trans = train_field((x - mean) / scale, lines, y[used])
    model = Model(mean, scale, weights, trans, 1.0, 0.0)
    part = slice(0, fold) if fold >= 20 and len(set(y[:fold])) == 2 else slice(0, None)
    z = np.empty(len(y[part]))
    for i, (v, weight) in enumerate(zip(xs[part], weights_of[part])):
        good = marginals_of((v - mean) / scale @ weights, np.array([len(v)]), trans)[:, 1]
        p = np.clip((good * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        z[i] = np.log(p / (1 - p))
    model.slope, model.level = logistic(z, y[part])
    # the sample has its own share of label 1; the level moves to that of all rows
    share, drawn = sizes[1] / (sizes[0] + sizes[1]), np.clip(y[part].mean(), 0.01, 0.99)
    model.level += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return model


def score(docs: DataFrame, model: Model, keep: list[str], bound: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns `keep` of docs, the score and whether it is `bound` or more under `names`, from the text alone."""
    told = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    schema = docs.select(*keep).schema.add(names[0], "double").add(names[1], "integer")
    rows, text = with_text(docs, keep)

    @tidy
    def run(batches):
        model = told.value
        for batch in batches:
            for part in pieces(batch, text, 1 << 20):
                s = model.scores(string_array(part.column(text)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(s), pa.array((s >= bound).astype(np.int32))], [*keep, *names])

    return rows.mapInArrow(run, schema)
