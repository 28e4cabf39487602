"""Document fingerprints by MinHash, and what an edit does to them.

fingerprint: the low 16 bits of each minimum over the shingles of five words, as hex digits; texts of equal words have
equal fingerprints. likeness(): the share of equal minima, which estimates the Jaccard similarity of the shingle sets.
duplicates() joins bands of the signatures in Spark and verifies Jaccard on whole shingle sets.

edits(): documents stand in descending doc_id, ties by a descending hash of the text; the edited text of each is its own first
n - floor(n / 2) code points and then the first floor(n / 2) code points of the next one (all of it, if it is shorter);
the first document follows the last. One exchange of the texts by ranges of (doc_id, hash) deals them out; the first
document of each part is also sent to the part before it, so no part needs another. Equal rows are dealt out as one row
with their number.

Defined results: a null text counts as empty; null ids come last; an empty text has 0 characters and the fingerprint of
no shingle, whose likeness to another such is 1; repeated rows give repeated rows; other columns are ignored; a single
document follows itself; an empty table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import from_views, pieces, string_array, tidy, views, written
from .shingles import MinHash, distinct, shingle_hashes, word_hashes

#: Keys of repeated rows are broadcast up to this many; beyond it they are joined by a shuffle.
MOST_BROADCAST = 200_000
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def signatures(texts: pa.Array, hashes: MinHash, width: int = 5) -> np.ndarray:
    words, counts = word_hashes(*views(texts))
    return hashes.signatures(*shingle_hashes(words, counts, width)).astype(np.uint16)


def written_out(sig: np.ndarray) -> list[str]:
    width, text = sig.shape[1] * 4, sig.astype(">u2").tobytes().hex()
    return [text[i * width : (i + 1) * width] for i in range(len(sig))]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


def fingerprints(docs: DataFrame, size: int = 128, width: int = 5, seed: int = 11) -> DataFrame:
    """doc_id, fingerprint; one row per input row, in one pass without an exchange."""

    @tidy
    def run(batches):
        hashes = MinHash(size, seed)
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(written_out(signatures(string_array(part.column("text")), hashes, width)))], ["doc_id", "fingerprint"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, "doc_id long, fingerprint string")


def duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, width: int = 5, seed: int = 11) -> DataFrame:
    """doc_id, class_id, n_links: documents whose signature bands meet and whose shingle sets have Jaccard >= threshold. The
    bands are made of the first minima of the fingerprint: both draw the same permutations from the seed."""
    from .jaccard import similarity_join

    return similarity_join(docs, threshold, recall, width, seed)


def edited(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For all texts but the last: code points, and the text edited with the next one."""
    raw, off = views(texts)
    n = len(off) - 2
    chars = np.flatnonzero((raw & 0xC0) != 0x80)
    at = np.searchsorted(chars, off)
    size = np.diff(at)
    place = np.append(chars, len(raw))
    half = size[:-1] // 2
    own_end = place[at[:-2] + size[:-1] - half]
    taken = np.minimum(half, size[1:])
    next_end = place[at[1:-1] + taken]
    out = [raw[a:b] for pair in zip(zip(off[:n].tolist(), own_end.tolist()), zip(off[1 : n + 1].tolist(), next_end.tolist())) for a, b in pair]
    lengths = (own_end - off[:n]) + (next_end - off[1 : n + 1])
    return size[:-1], from_views(np.concatenate(out) if out else np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum(lengths)]))


def upto(key: Column, cuts: list[tuple], lo: int = 0, hi: int | None = None) -> Column:
    """How many of the sorted cuts are at or below the key, by a binary search written out."""
    hi = len(cuts) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    at = F.struct(*[F.lit(x).cast("long") for x in cuts[mid]])
    return F.when(key >= at, upto(key, cuts, mid + 1, hi)).otherwise(upto(key, cuts, lo, mid))


def edits(docs: DataFrame, size: int = 128, width: int = 5, seed: int = 11, sample: int = 20_000) -> DataFrame:
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.selectExpr("coalesce(cast(doc_id as bigint), -9223372036854775808) as at", "cast(doc_id as bigint) as doc_id", "coalesce(cast(text as string), '') as text").withColumn("tie", F.xxhash64("text"))
    keys = written(rows.groupBy("at", "doc_id", "tie").agg(F.count("*").alias("times")), "keys")  # 28 bytes a row
    # bounds come from a seeded sample of keys and only decide the balance; an id of very many texts is cut between its texts
    n = keys.count()
    drawn = sorted((r["at"], r["tie"]) for r in keys.select("at", "tie").sample(fraction=min(1.0, sample / max(n, 1) / 2), seed=seed).limit(sample).collect())
    cuts = sorted({drawn[len(drawn) * i // parts] for i in range(1, parts)}) if drawn else []
    key = F.struct("at", "tie")
    part = (F.lit(len(cuts)) - upto(key, cuts)).cast("int")  # parts descend, too
    heads = keys.groupBy(part.alias("part")).agg(F.max(key).alias("head")).orderBy("part").collect()  # a row for each part
    # rows that are equal are one row, with their number; a hot one is met by a partial sum
    again = keys.where("times > 1").select("at", "doc_id", "tie", "times")
    n_again = again.count()
    if n_again:
        same = (F.col("r.at") == F.col("k.at")) & F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.tie") == F.col("k.tie"))
        joined = rows.alias("r").join((F.broadcast(again) if n_again <= MOST_BROADCAST else again).alias("k"), same, "left").select("r.at", "r.doc_id", "r.tie", "r.text", F.coalesce("k.times", F.lit(1)).alias("times"))
        one = joined.where("times > 1").groupBy("at", "doc_id", "tie", "times").agg(F.min("text").alias("text")).select("at", "doc_id", "tie", "text", "times")
        rows = joined.where("times = 1").unionByName(one)
    else:
        rows = rows.withColumn("times", F.lit(1).cast("long"))
    before = [(h["head"]["at"], h["head"]["tie"], heads[i - 1]["part"]) for i, h in enumerate(heads)]
    rows = rows.withColumn("part", part)
    if before:
        firsts = F.broadcast(spark.range(1).select(F.explode(F.array(*[F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(("at", "tie", "sent"), b)]) for b in before])).alias("b")).select("b.*"))  # a row for each part
        rows = rows.join(firsts, ["at", "tie"], "left")
    else:
        rows = rows.withColumn("sent", F.lit(None).cast("long"))
    own, sent = F.struct(F.col("part"), F.lit(0).alias("extra")), F.struct(F.col("sent").cast("int").alias("part"), F.lit(1).alias("extra"))
    places = F.when(F.col("sent").isNull(), F.array(own)).otherwise(F.array(own, sent))
    dealt = (
        rows.select("at", "tie", "doc_id", "text", "times", F.explode(places).alias("to"))
        .select(F.col("to.part").alias("part"), F.col("to.extra").alias("extra"), "at", "tie", "doc_id", "text", "times")
        .repartitionById(len(cuts) + 1, F.col("part"))
        .sortWithinPartitions("part", "extra", F.desc("at"), F.desc("tie"))
        .select("extra", "doc_id", "text", "times")
    )

    def results(ids: pa.Array, texts: pa.Array, times: pa.Array, hashes: MinHash):
        """Of all but the last, which only follows. A row that stands for several follows itself but for the last time."""
        if not len(ids) - 1:
            return
        many = np.flatnonzero(np.asarray(times)[:-1] > 1)
        for i in many:
            yield compared(ids[i : i + 1], pa.concat_arrays([texts[i : i + 1]] * 2), times[i : i + 1], 1, hashes)
        yield compared(ids[:-1], texts, pa.array(np.ones(len(ids) - 1, np.int64)), 0, hashes)

    def compared(ids: pa.Array, texts: pa.Array, times: pa.Array, less: int, hashes: MinHash):
        n_chars, new = edited(texts)
        sig, sig_new = signatures(texts, hashes, width), signatures(new, hashes, width)
        raw, off = views(new)
        data = memoryview(np.ascontiguousarray(raw))
        sha = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        cols = [ids, pa.array(n_chars), pa.array(sha), pa.array(written_out(sig[:-1])), pa.array(written_out(sig_new)), pa.array(likeness(sig[:-1], sig_new)), pa.array(likeness(sig[:-1], sig[1:])), pa.array(np.asarray(times) - less)]
        return pa.RecordBatch.from_arrays(cols, [*(f.split()[0] for f in SCHEMA.split(", ")), "times"])

    @tidy
    def run(batches):
        hashes, held, done = MinHash(size, seed), None, False
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                if done:
                    continue
                extras = np.flatnonzero(np.asarray(piece.column("extra")))
                if len(extras):
                    piece, done = piece.slice(0, int(extras[0]) + 1), True
                cols = [piece.column("doc_id"), string_array(piece.column("text")), piece.column("times")]
                if held is not None:
                    cols = [pa.concat_arrays([h, c]) for h, c in zip(held, cols)]
                yield from results(*cols, hashes)
                held = [c[-1:] for c in cols]

    out = dealt.mapInArrow(run, SCHEMA + ", times long")
    if n_again:
        out = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("nth"))
    return out.select(*[f.split()[0] for f in SCHEMA.split(", ")])
