"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, all else is a space, runs of spaces are one; n-grams of 1 to 3 characters are hashed into
`buckets` features, weighted (1 + ln count) x idf and scaled to length 1. Document frequencies are counted over all
training rows. Weights are learned with follow-the-regularised-leader (elastic net: l1 makes them sparse, l2 small) on a
sample of at most `per_language` different texts of each language (a documented bound), a fifth of which only fits the
temperature of the softmax. A hash of the row's id and text draws the sample, so it is the same however the rows are dealt
over files and tasks; rows without an id are drawn by their text alone.

Defined results: an empty table gives no row; text that is null, empty or without a letter gets `und` with score 0; ties go to the language that
sorts first; without any labelled training row all texts are `und`; repeated rows get equal results; other columns are
ignored; whole texts of any length are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pieces, string_array, tidy, with_text

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Code point -> itself, or a space if it is no letter; over all of Unicode."""
    if not _letters:
        _letters.append(np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32))
    return _letters[0]


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased letters and single spaces, each text between spaces; and bounds by text."""
    rows = [t.lower() for t in texts.to_pylist()]
    raw = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))])
    c = letter_table()[raw]
    # a space before and behind each text
    n = len(rows)
    out = np.full(len(c) + 2 * n, 32, np.uint32)
    out[np.arange(len(c)) + np.repeat(2 * np.arange(n) + 1, np.diff(off))] = c
    bounds = off + 2 * np.arange(n + 1)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[bounds[:-1]] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], place[bounds]


def grams(c: np.ndarray, bounds: np.ndarray, buckets: int) -> list[np.ndarray]:
    """For n = 1, 2, 3: the bucket of the n-gram that starts at each character, or `buckets` where it would leave its text."""
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    out, h = [], np.zeros(len(c), np.uint32)
    ends = bounds[1:]
    for n in range(1, 4):
        h = h * np.uint32(0x01000193)
        h[: len(c) - n + 1] += c[n - 1 :] if n > 1 else c
        g = (((h ^ np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)) >> shift).astype(np.int32)
        for k in range(n - 1):
            at = ends - 1 - k
            g[at[at >= bounds[:-1]]] = buckets
        out.append(g)
    return out


def counted(c: np.ndarray, bounds: np.ndarray, buckets: int):
    """(features, counts) of each text in turn."""
    all_grams = np.stack(grams(c, bounds, buckets))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = np.bincount(all_grams[:, a:b].ravel(), minlength=buckets + 1)[:buckets]
        at = np.flatnonzero(n)
        yield at, n[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # (buckets,)
    weights: np.ndarray  # (buckets, languages), mostly zero
    bias: np.ndarray
    temperature: float

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, whether there is a letter)."""
        c, bounds = codes(texts)
        has = np.diff(np.concatenate([[0], np.cumsum(c != 32)])[bounds]) > 0
        z = np.zeros((len(texts), len(self.languages)))
        for i, (at, n) in enumerate(counted(c, bounds, len(self.idf))):
            z[i] = tf_idf(at, n, self.idf) @ self.weights[at] + self.bias
        return softmax(z / self.temperature), has


def tf_idf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1.0 + np.log(n)) * idf[at]
    return v / max(np.sqrt((v * v).sum()), 1e-9)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True)) if z.size else z
    return z / z.sum(axis=1, keepdims=True) if z.size else z


def ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, buckets: int, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 6, batch: int = 32, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader with per-coordinate rates over mini-batches of sparse rows (buckets, values)."""
    z, n, w = (np.zeros((buckets + 1, classes)) for _ in range(3))  # the last row is the bias
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            m = np.zeros((len(rows), buckets + 1))
            for i, r in enumerate(rows):
                m[i, x[r][0]] = x[r][1]
            m[:, -1] = 0.1
            used = np.flatnonzero(m.any(axis=0))
            m = m[:, used]
            p = softmax(m @ w[used])
            p[np.arange(len(rows)), y[rows]] -= 1
            g = m.T @ p
            more = n[used] + g * g
            z[used] += g - (np.sqrt(more) - np.sqrt(n[used])) / alpha * w[used]
            n[used] = more
            zu = z[used]
            w[used] = np.where(np.abs(zu) <= l1, 0, -(zu - np.sign(zu) * l1) / ((beta + np.sqrt(more)) / alpha + l2))
    return w[:-1], w[-1] * 0.1


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits under which the labels are likeliest: golden-section search over its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(z / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean() + 1e-4 * t * t
    lo, hi, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def document_frequencies(train: DataFrame, buckets: int) -> np.ndarray:
    """In how many training texts each feature occurs, and at last their number."""

    @tidy
    def run(batches):
        df = np.zeros(buckets + 1, np.int64)
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                c, bounds = codes(string_array(part.column("text")))
                df[-1] += part.num_rows
                for at, _ in counted(c, bounds, buckets):
                    df[at] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets + 1)), pa.array(df)], ["feature", "n"])

    got = train.select("text").mapInArrow(run, "feature long, n long").where("n > 0").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets + 1, np.int64)
    out[got["feature"]] = got["n"]
    return out


def fit(train: DataFrame, buckets: int = 1 << 15, per_language: int = 500, **options) -> Model:
    """train: (text, lang) rows, and doc_id if there is one; null languages take no part."""
    number = F.col("doc_id").cast("string") if "doc_id" in train.columns else F.lit(None).cast("string")
    train = train.where("lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), number.alias("number"))
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(buckets), np.zeros((buckets, 0)), np.zeros(0), 1.0)
    share = F.element_at(F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, 0.8 * per_language / sizes[k]))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("number", "lang", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = train.withColumn("share", share).where(draw < F.col("share")).select("lang", "text", F.xxhash64("text").alias("key"))
    df = document_frequencies(train, buckets)

    @tidy
    def features(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                c, bounds = codes(string_array(part.column("text")))
                rows, at, tf = [], [], []
                for i, (used, n) in enumerate(counted(c, bounds, buckets)):
                    if len(used):
                        rows.append(i)
                        at.append(used.astype(np.int32).tobytes())
                        tf.append(n.astype(np.int64).tobytes())
                took = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("lang").take(took), part.column("key").take(took), pa.array(at, pa.binary()), pa.array(tf, pa.binary())], ["lang", "key", "at", "tf"])

    # features are made where the texts are; what is collected is bounded by per_language
    drawn = sample.mapInArrow(features, "lang string, key long, at binary, tf binary").dropDuplicates(["lang", "key"])
    ranked = drawn.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("key"))).where(F.col("rank") <= per_language)
    got = sorted(ranked.collect(), key=lambda r: (r["lang"], r["rank"]))
    idf = (np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1.0).astype(np.float32)
    x, y = [], []
    for r in got:
        at = np.frombuffer(r["at"], np.int32)
        x.append((at, tf_idf(at, np.frombuffer(r["tf"], np.int64), idf)))
        y.append(languages.index(r["lang"]))
    y = np.array(y, np.int64)
    order = np.random.default_rng(5).permutation(len(x))
    fold = len(x) // 5 if len(x) >= 20 else 0
    held, used = order[:fold], order[fold:]
    w, b = ftrl([x[i] for i in used], y[used], buckets, len(languages), **options)
    z = np.array([x[i][1] @ w[x[i][0]] + b for i in held]) if fold else np.zeros((0, len(languages)))
    return Model(languages, idf, w.astype(np.float32), b, temperature(z, y[held]))


def predict(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs, the language and its score under `names`, from the text alone."""
    told = docs.sparkSession.sparkContext.broadcast(model)  # its size is that of the model: buckets x languages
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")
    rows, text = with_text(docs, keep)

    @tidy
    def run(batches):
        model = told.value
        for batch in batches:
            for part in pieces(batch, text, 1 << 20):
                texts = string_array(part.column(text))
                if model.languages:
                    p, has = model.scores(texts)
                    best = p.argmax(axis=1)
                    lang = [model.languages[b] if h else "und" for b, h in zip(best, has)]
                    score = np.where(has, p[np.arange(len(best)), best], 0.0)
                else:
                    lang, score = ["und"] * len(texts), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(lang, pa.string()), pa.array(score)], [*keep, *names])

    return rows.mapInArrow(run, schema)
