"""Approximate nearest neighbours by largest inner product: NN-descent builds a graph, queries search it greedily.

Equal vectors are one node, so copies never crowd a list; the `k` + 1 least ids of each are all that a result can need.
For the graph a vector gets one more component, sqrt(M^2 - |x|^2) with M the greatest length: then near by inner product
is near by distance, and nodes of small length keep neighbours of their own.

Start: in each of `trees` rounds nodes are sorted by the signs of random projections and then by one projection; blocks of
`block` consecutive nodes are compared whole. Blocks have equal sizes however the vectors lie.
Descent: every node is the pivot of its neighbours and of up to `degree` of the nodes whose neighbour it is (the method's
sampling of reverse neighbours; the rest is met through its own lists). Members of a pivot are joined with their vectors and
compared with each other; each node keeps the best `degree` of all it met.
Search: each query keeps a beam; in a round its `expand` best nodes that were not expanded yet are joined with their
adjacency, which holds the vectors, until no beam has such a node among its first `ahead`.
Every round is written to the shared folder; a lost executor costs its tasks only. Lists of nodes to expand are broadcast
up to MOST_BROADCAST rows, and joined by a shuffle beyond.

The graph uses 16-bit floats; the result's scores are inner products of the original vectors in double precision.

Defined results: vectors that are null, empty, all zero or hold a null or non-finite component take no part, neither do
those of another length than the most frequent one (the shorter of two as frequent); repeated ids keep all their vectors as
rows of their own; a query of which no other vector exists has no row; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import drop_written, tidy, written
from .jaccard import fixed_binary

MOST_BROADCAST = 1_000_000


def valid(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(vec_id, vec): the components as doubles in bytes."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return rows.select("vec_id", F.lit(None).cast("binary").alias("vec"))
    d = sizes["d"]

    @tidy
    def run(batches):
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d) + 0.0
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), fixed_binary(x)], ["vec_id", "vec"])

    return rows.where(F.size("v") == d).mapInArrow(run, "vec_id long, vec binary")


def matrix(col, kind) -> np.ndarray:
    rows = col.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def runs_of(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).astype(np.int64) if len(keys) else np.zeros(1, np.int64)


def by_key(batches, key: str, least: int = 4000):
    """Tables of whole groups of a stream sorted by key."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < least:
            continue
        keys = held[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def lists(nodes: np.ndarray, owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int) -> pa.RecordBatch:
    """The best `most` distinct ids of each owner (an index into nodes), as one row per node."""
    keep = nodes[owner] != ids
    owner, ids, scores = owner[keep], ids[keep], scores[keep]
    order = np.lexsort((ids, owner))
    owner, ids, scores = owner[order], ids[order], scores[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])
    owner, ids, scores = owner[new], ids[new], scores[new]
    order = np.lexsort((ids, -scores, owner))
    owner, ids, scores = owner[order], ids[order], scores[order]
    starts = runs_of(owner)
    place = np.arange(len(ids)) - np.repeat(starts[:-1], np.diff(starts))
    keep = place < most
    owner, ids, scores = owner[keep], ids[keep], scores[keep]
    starts = runs_of(owner)
    at = owner[starts[:-1]] if len(owner) else np.zeros(0, np.int64)
    cut = lambda x, size: pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((starts * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
    return pa.RecordBatch.from_arrays([pa.array(nodes[at]), cut(ids, 8), cut(scores.astype(np.float32), 4)], ["node", "ids", "scores"])


LISTS = "node long, ids binary, scores binary"


def merged(df: DataFrame, most: int) -> DataFrame:
    """Lists of the same node become one."""

    @tidy
    def run(batches):
        for t in by_key(batches, "node"):
            keys = t["node"].to_numpy()
            starts = runs_of(keys)
            size = np.array([len(x) for x in t["ids"].to_pylist()]) // 8
            row = np.repeat(np.arange(len(keys)), size)
            owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[row]
            yield lists(keys[starts[:-1]], owner, np.frombuffer(b"".join(t["ids"].to_pylist()), np.int64), np.frombuffer(b"".join(t["scores"].to_pylist()), np.float32), most)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(run, LISTS)


def started(nodes: DataFrame, degree: int, trees: int, block: int, seed: int) -> DataFrame:
    """nodes (node, v16) -> lists from blocks of nodes that random projections put together."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = None
    for tree in range(trees):

        def place(batches, tree=tree):
            for b in batches:
                x = matrix(b.column("v16"), np.float16).astype(np.float32)
                planes = np.random.default_rng(seed + tree).standard_normal((x.shape[1], 13)).astype(np.float32)
                p = x @ planes
                code = ((p[:, :12] > 0) << np.arange(12)).sum(axis=1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("v16"), pa.array(code + 0.5 + np.arctan(p[:, 12].astype(float)) / np.pi)], ["node", "v16", "place"])

        @tidy
        def compare(batches):
            held = None
            for b in [*batches, None]:
                if b is not None:
                    t = pa.Table.from_batches([b])
                    held = t if held is None else pa.concat_tables([held, t])
                # the last block takes what is left, so that none is small
                while held is not None and (held.num_rows >= 2 * block or b is None and held.num_rows):
                    n = block if held.num_rows >= 2 * block else held.num_rows
                    now, held = held.slice(0, n), held.slice(n)
                    ids, x = now["node"].to_numpy(), matrix(now["v16"], np.float16).astype(np.float32)
                    s = x @ x.T
                    np.fill_diagonal(s, -np.inf)
                    k = min(degree, n - 1)
                    if k > 0:
                        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                        yield lists(ids, np.repeat(np.arange(n), k), ids[best].ravel(), np.take_along_axis(s, best, 1).ravel(), degree)

        dealt = nodes.mapInArrow(place, "node long, v16 binary, place double").repartitionByRange(parts, "place", "node").sortWithinPartitions("place", "node")
        got = dealt.select("node", "v16").mapInArrow(compare, LISTS)
        out = got if out is None else out.union(got)
    return merged(out, degree)


def pairs_of(graph: DataFrame) -> DataFrame:
    """(node, id, score) of each edge."""

    @tidy
    def run(batches):
        for b in batches:
            size = np.array([len(x) for x in b.column("ids").to_pylist()], np.int64) // 8
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("node").to_numpy(), size)), pa.array(np.frombuffer(b"".join(b.column("ids").to_pylist()), np.int64)), pa.array(np.frombuffer(b"".join(b.column("scores").to_pylist()), np.float32))], ["node", "id", "score"])

    return graph.mapInArrow(run, "node long, id long, score float")


def reverse_sampled(pairs: DataFrame, most: int) -> DataFrame:
    """(node, id): up to `most` nodes whose list holds the node, the nearest first."""
    w = W.partitionBy("id").orderBy(F.desc("score"), "node")
    return pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select(F.col("id").alias("node"), F.col("node").alias("id"), "score")


def descended(nodes: DataFrame, graph: DataFrame, degree: int, best: int = 12) -> DataFrame:
    """One round: neighbours of neighbours are compared, and the lists improved."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs_of(graph)
    members = pairs.select(F.col("node").alias("pivot"), F.col("id").alias("node")).union(reverse_sampled(pairs, degree).select("node", "id")).union(nodes.select("node", "node")).distinct()
    bounds = pairs.groupBy("node").agg(F.min("score").alias("kth"), F.count("*").alias("n")).select("node", F.when(F.col("n") >= degree, F.col("kth")).otherwise(-1e30).cast("float").alias("kth"))
    with_vectors = members.join(nodes.join(bounds, "node", "left"), "node").select("pivot", "node", "kth", "v16")

    @tidy
    def run(batches):
        for t in by_key(batches, "pivot"):
            pivots, ids = t["pivot"].to_numpy(), t["node"].to_numpy()
            x, kth = matrix(t["v16"], np.float16).astype(np.float32), np.nan_to_num(t["kth"].to_numpy(), nan=-1e30)
            starts = runs_of(pivots)
            size = np.diff(starts)
            owners, others, scores = [], [], []
            for m in np.unique(size):
                if m < 2:
                    continue
                rows = starts[:-1][size == m][:, None] + np.arange(m)
                s = np.matmul(x[rows], x[rows].transpose(0, 2, 1))
                s[:, np.arange(m), np.arange(m)] = -np.inf
                k = min(best, m - 1)
                top = np.argpartition(-s, k - 1, axis=2)[:, :, :k]
                value = np.take_along_axis(s, top, 2)
                good = value > kth[rows][:, :, None]
                other = np.take_along_axis(np.broadcast_to(rows[:, None, :], s.shape), top, 2)
                owners.append(np.broadcast_to(rows[:, :, None], top.shape)[good])
                others.append(other[good])
                scores.append(value[good])
            if owners:
                own, other = ids[np.concatenate(owners)], ids[np.concatenate(others)]
                known, at = np.unique(own, return_inverse=True)
                yield lists(known, at, other, np.concatenate(scores), degree)

    found = with_vectors.repartition(parts, "pivot").sortWithinPartitions("pivot").select("pivot", "node", "kth", "v16").mapInArrow(run, LISTS)
    return merged(graph.union(found), degree)


def build(nodes: DataFrame, degree: int = 32, trees: int = 4, block: int = 256, rounds: int = 5, seed: int = 17) -> DataFrame:
    """The graph's lists, written."""
    graph = written(started(nodes, degree, trees, block, seed), "graph")
    for _ in range(rounds):
        better = written(descended(nodes, graph, degree), "graph")
        drop_written(nodes.sparkSession, graph)
        graph = better
        nodes.sparkSession._jvm.System.gc()  # lets Spark remove the files of the round's exchanges
    return graph


def adjacency(nodes: DataFrame, graph: DataFrame, degree: int) -> DataFrame:
    """(node, ids, vectors): neighbours and reverse neighbours of each node, with their 16-bit vectors."""
    pairs = pairs_of(graph)
    both = pairs.select("node", "id").union(reverse_sampled(pairs, degree).select("node", "id")).distinct()
    with_vectors = both.join(nodes.select(F.col("node").alias("id"), "v16"), "id")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @tidy
    def run(batches):
        for t in by_key(batches, "node"):
            keys = t["node"].to_numpy()
            starts = runs_of(keys)
            ids, x = np.ascontiguousarray(t["id"].to_numpy()), matrix(t["v16"], np.uint8)
            cut = lambda a, size: pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(a))])
            yield pa.RecordBatch.from_arrays([pa.array(keys[starts[:-1]]), cut(ids, 8), cut(x, x.shape[1])], ["node", "ids", "vectors"])

    return with_vectors.select("node", "id", "v16").repartition(parts, "node").sortWithinPartitions("node").mapInArrow(run, "node long, ids binary, vectors binary")


STATE = "query long, v16 binary, ids binary, scores binary, done binary, open array<long>"


def searched(links: DataFrame, queries: DataFrame, entries: list[tuple[int, bytes]], beam: int = 256, expand: int = 32, ahead: int = 224) -> DataFrame:
    """queries (query, v16, own): own is its node in the graph, or null. -> (query, ids): the beam, best first."""
    spark = queries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entry_ids = np.array([e[0] for e in entries], np.int64)
    entry_x = np.frombuffer(b"".join(e[1] for e in entries), np.float16).reshape(len(entries), -1).astype(np.float32)

    def advance(q: int, v: bytes, ids: np.ndarray, scores: np.ndarray, done: np.ndarray):
        """A query's state: its beam in order, and which nodes to expand next."""
        order = np.lexsort((done == 0, ids))
        ids, scores, done = ids[order], scores[order], done[order]
        new = np.ones(len(ids), bool)
        new[1:] = ids[1:] != ids[:-1]
        ids, scores, done = ids[new], scores[new], done[new]
        order = np.lexsort((ids, -scores))[:beam]
        ids, scores, done = ids[order], scores[order], done[order]
        nxt = np.flatnonzero(done[:ahead] == 0)[:expand]
        done[nxt] = 1
        return q, v, ids.tobytes(), scores.astype(np.float32).tobytes(), done.astype(np.uint8).tobytes(), ids[nxt].tolist()

    def as_batch(rows):
        cols = list(zip(*rows)) or [()] * 6
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [f.split()[0] for f in STATE.split(", ")])

    def begin(batches):
        for b in batches:
            x = matrix(b.column("v16"), np.float16).astype(np.float32) if b.num_rows else np.zeros((0, 1))
            rows = []
            for q, v, own, xv in zip(b.column("query").to_pylist(), b.column("v16").to_pylist(), b.column("own").to_pylist(), x):
                ids, scores = entry_ids, entry_x[:, : len(xv) - 1] @ xv[:-1]
                if own is not None:
                    ids, scores = np.append(ids, own), np.append(scores, xv[:-1] @ xv[:-1])
                rows.append(advance(q, v, ids, scores, np.zeros(len(ids), np.uint8)))
            yield as_batch(rows)

    @tidy
    def step(batches):
        for t in by_key(batches, "query", 2000):
            starts = runs_of(t["query"].to_numpy())
            cols = {c: t[c].to_pylist() for c in ("query", "v16", "ids", "scores", "done", "vectors")}
            rows = []
            for a, b in zip(starts[:-1], starts[1:]):
                head = next(i for i in range(a, b) if cols["v16"][i] is not None)
                v = np.frombuffer(cols["v16"][head], np.float16).astype(np.float32)[:-1]
                ids, scores, done = [np.frombuffer(cols["ids"][head], np.int64)], [np.frombuffer(cols["scores"][head], np.float32)], [np.frombuffer(cols["done"][head], np.uint8)]
                more = [i for i in range(a, b) if i != head]
                if more:
                    new = np.frombuffer(b"".join(cols["ids"][i] for i in more), np.int64)
                    x = np.frombuffer(b"".join(cols["vectors"][i] for i in more), np.float16).reshape(len(new), -1)[:, :-1].astype(np.float32)
                    ids.append(new)
                    scores.append(x @ v)
                    done.append(np.zeros(len(new), np.uint8))
                rows.append(advance(cols["query"][head], cols["v16"][head], np.concatenate(ids), np.concatenate(scores), np.concatenate(done)))
            yield as_batch(rows)

    state = written(queries.select("query", "v16", "own").mapInArrow(begin, STATE), "search")
    while True:  # each round expands nodes that were not expanded before, so it ends
        frontier = state.select("query", F.explode("open").alias("node"))
        open_nodes = state.agg(F.sum(F.size("open"))).first()[0] or 0
        if not open_nodes:
            break
        met = links.join(F.broadcast(frontier) if open_nodes <= MOST_BROADCAST else frontier, "node")
        none = F.lit(None).cast("binary")
        rows = state.select("query", "v16", "ids", "scores", "done", none.alias("vectors")).union(met.select("query", none, "ids", none, none, "vectors"))
        after = written(rows.repartition(parts, "query").sortWithinPartitions("query").mapInArrow(step, STATE), "search")
        drop_written(spark, state)
        state = after
    return state.select("query", "ids")


def nearest(vectors: DataFrame, query_ids, k: int = 20, id_column: str = "vec_id", column: str = "embedding", degree: int = 32, rounds: int = 5, **search) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found of each row for which query_ids(column) holds."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = written(valid(vectors, id_column, column), "vectors")
    w = W.partitionBy("vec").orderBy("vec_id")
    groups = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    # a node's number: its least id; where an id repeats with several vectors, they are told apart by a hash
    numbered = groups.withColumn("least", F.col("members")[0])
    again = numbered.groupBy("least").count().where("count > 1")
    if again.limit(1).count():
        numbered = numbered.withColumn("node", F.xxhash64("vec"))
    else:
        numbered = numbered.withColumn("node", F.col("least"))
    classes = written(numbered.select("node", "vec", "members"), "classes")

    def lengths(batches):
        n, most = 0, 0.0
        for b in batches:
            x = matrix(b.column("vec"), np.float64)
            n, most = n + len(x), max(most, float((x * x).sum(axis=1).max(initial=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([most])], ["n", "most"])

    total = classes.select("vec").mapInArrow(lengths, "n long, most double").agg(F.sum("n"), F.max("most")).first()
    n, most = total[0] or 0, total[1] or 0.0
    if not n:
        return spark.createDataFrame([], schema)
    degree = min(degree, n - 1)
    scale = 1 / np.sqrt(most)

    def augmented(batches):
        for b in batches:
            x = matrix(b.column("vec"), np.float64) * scale
            x = np.hstack([x, np.sqrt(np.maximum(1 - (x * x).sum(axis=1, keepdims=True), 0))])
            yield pa.RecordBatch.from_arrays([b.column("node"), fixed_binary(x.astype(np.float16))], ["node", "v16"])

    nodes = written(classes.select("node", "vec").mapInArrow(augmented, "node long, v16 binary"), "nodes")
    graph = build(nodes, max(degree, 1), rounds=rounds)
    links = written(adjacency(nodes, graph, max(degree, 1)), "links")
    asked = rows.where(query_ids(F.col("vec_id"))).join(classes.select("vec", "node"), "vec").select(F.col("vec_id").alias("query_id"), "node")
    asked = written(asked, "asked")
    entries = [(r["node"], bytes(r["v16"])) for r in nodes.orderBy(F.xxhash64("node")).limit(16).collect()]
    queries = asked.select("node").distinct().join(nodes, "node").select(F.col("node").alias("query"), "v16", F.col("node").alias("own"))
    found = searched(links, queries, entries, **search)

    def scored(batches):
        for b in batches:
            s = np.einsum("ij,ij->i", matrix(b.column("q"), np.float64), matrix(b.column("vec"), np.float64)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("members"), pa.array(s)], ["query", "members", "score"])

    def told(batches):
        for b in batches:
            size = np.array([len(x) for x in b.column("ids").to_pylist()], np.int64) // 8
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("query").to_numpy(), size)), pa.array(np.frombuffer(b"".join(b.column("ids").to_pylist()), np.int64))], ["query", "node"])

    pairs = found.mapInArrow(told, "query long, node long").join(classes, "node").join(classes.select(F.col("node").alias("query"), F.col("vec").alias("q")), "query")
    exact = pairs.select("query", "members", "q", "vec").mapInArrow(scored, "query long, members array<long>, score double")
    best = exact.select("query", F.explode("members").alias("vec_id"), "score").groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k + 1).alias("best"))
    out = asked.join(best, F.col("node") == F.col("query")).select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return out.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.minus")).alias("score"))
