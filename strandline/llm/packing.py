"""Conflict-constrained best-fit packing of token sequences into bins of fixed capacity.

Documents are dealt out by a hash into shards of about `shard` documents; a shard is packed by one task, so memory and
time of a task are bounded whatever the table. Longer sequences come first. A bin keeps its residual, a bitmap of the
sources in it and a bitmap of the duplicate clusters in it; bins stand in order of residual. The search starts at the
least residual that holds the sequence and goes on to the next one until a bin has no bit in common with it; only then is
a bin opened. Sequences above the capacity are cut: whole pieces fill bins of their own, the rest is packed.

Two pieces of a bin never share a cluster; `per_source` pieces of one source may share a bin (the source bitmap has that
many bits for each source).

Defined results: a row per piece (doc_id, piece, start, length, bin_id, position, bin_fill); an empty or null text is one
piece of length 1, its end id; an empty table gives no row; of sequences of equal length the one of the smaller id (nulls last),
source and cluster is packed first; null sources conflict with none; null clusters conflict with none; repeated rows are packed
as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Counter, encoder, vocabulary
from .common import pieces, string_array, tidy, with_text

SCHEMA = "doc_id long, piece int, start long, length int, bin_id string, position int, bin_fill int"


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int, per_source: int = 1) -> tuple[list[int], list[int]]:
    """The bin of each sequence (all of length <= capacity), and the fill of each bin."""
    counts: dict = {}
    for c in clusters:
        if c is not None:
            counts[c] = counts.get(c, 0) + 1
    cluster_bit = {c: i for i, c in enumerate(c for c, n in counts.items() if n > 1)}  # a lone member conflicts with none
    source_bit = {s: i * per_source for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins: list[tuple[int, int]] = []  # (residual, bin), sorted
    of, residual, source_map, cluster_map = [0] * len(lengths), [], [], []
    for i in order:
        size, s, c = lengths[i], source_bit.get(sources[i]), cluster_bit.get(clusters[i])
        full = ((1 << per_source) - 1) << s if s is not None else 0
        bit = 1 << c if c is not None else 0
        at = bisect_left(bins, (size, -1))
        while at < len(bins):
            b = bins[at][1]
            if not cluster_map[b] & bit and (not full or source_map[b] & full != full):
                del bins[at]
                break
            at += 1
        else:
            b = len(residual)
            residual.append(capacity)
            source_map.append(0)
            cluster_map.append(0)
        residual[b] -= size
        cluster_map[b] |= bit
        if full:
            taken = source_map[b] & full
            source_map[b] |= taken | ((taken << 1 | 1 << s) & full)
        if residual[b]:
            insort(bins, (residual[b], b))
        of[i] = b
    return of, [capacity - r for r in residual]


def token_counts(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """The columns `keep`, and n_tokens: ids of the whole text and one end id."""
    path = path or vocabulary()

    rows, text = with_text(docs, keep)

    @tidy
    def run(batches):
        words = encoder(path, Counter)
        for batch in batches:
            for part in pieces(batch, text, 2 << 20):
                n = words.counts(string_array(part.column(text))) + 1
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(n)], [*keep, "n_tokens"])

    return rows.mapInArrow(run, docs.select(*keep).schema.add("n_tokens", "long"))


def pack(sized: DataFrame, capacity: int = 8192, shard: int = 4000, per_source: int = 2, rows: int | None = None) -> DataFrame:
    """sized: (doc_id, source, cluster, n_tokens). rows: their number, if known.

    Rows that are equal in all of that are numbered, and the hash that deals rows out takes the number, so the bins are the
    same however the rows lie, and no id or cluster gathers in a shard. The number of shards is a power of two: a table that
    grows splits its shards and deals nothing else anew."""
    rows = sized.count() if rows is None else rows
    shards = 1 << max(0, round(math.log2(max(rows, 1) / shard)))
    alike = sized.groupBy("doc_id", "source", "cluster", "n_tokens").agg(F.count("*").alias("times"))
    each = alike.select("doc_id", "source", "cluster", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth"))
    dealt = each.withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "cluster", "n_tokens", "nth"), F.lit(shards)).cast("int"))

    def run(key, t):
        shard_no = key[0].as_py()
        t = t.sort_by([(c, "ascending") for c in ("doc_id", "n_tokens", "source", "cluster", "nth")])
        ids, n = t["doc_id"].to_pylist(), t["n_tokens"].to_pylist()
        whole, rest = [], []
        for i, size in enumerate(n):
            whole += [(i, k, k * capacity) for k in range(size // capacity)]
            if size % capacity:
                rest.append(i)
        of, fill = best_fit([n[i] % capacity for i in rest], [t["source"][i].as_py() for i in rest], [t["cluster"][i].as_py() for i in rest], capacity, per_source)
        out = [(ids[i], k, s, capacity, f"{shard_no}-w{j}", 0, capacity) for j, (i, k, s) in enumerate(whole)]
        seen: dict[int, int] = {}
        for i, b in zip(rest, of):
            seen[b] = seen.get(b, -1) + 1
            out.append((ids[i], n[i] // capacity, n[i] // capacity * capacity, n[i] % capacity, f"{shard_no}-{b}", seen[b], fill[b]))
        cols = list(zip(*out)) or [()] * 7
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return dealt.groupBy("shard").applyInArrow(run, SCHEMA)


def pack_documents(docs: DataFrame, capacity: int = 8192, shard: int = 4000, per_source: int = 2, path: str | None = None) -> DataFrame:
    """Documents with their token counts; the cluster is that of equal texts."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("cluster"), "text")
    return pack(token_counts(keyed, ["doc_id", "source", "cluster"], path), capacity, shard, per_source, docs.select("doc_id").count())
