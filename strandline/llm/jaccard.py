"""N-gram Jaccard join: MinHash bands, a shuffle on band hashes, and exact verification on whole shingle sets.

1. One pass over the texts makes, per document, a 128-bit digest of its set of five-word shingles and its band hashes.
   Documents of equal sets are one node from here on; copies never meet in pairs.
2. Nodes are linked to the least node of each of their buckets: a star, not all pairs. Components of these stars are the
   candidate groups; nodes that share any band are in one group.
3. Only texts of nodes in a group of two or more are read again; their whole shingle sets go to their group. In groups above
   `block` nodes each set is first compared with that of one centre: pairs whose differences from it add up to little are
   certain links and only counted. What is left is dealt out in blocks, and a task compares a block with another one.
4. A task takes the pairs that agree in any band, and counts common shingles by a matrix product over the shingles that
   two or more of its nodes hold. Pairs of Jaccard >= threshold are links. It returns a row per node: how many documents
   it is linked to, and the least node that it hangs together with. No pair leaves a task.
5. Groups of many blocks are put together by components over those rows.

Defined results, a row per input row: doc_id, class_id (least doc_id of all documents that links connect), n_links (other
documents with a Jaccard of `threshold` or more, copies included). A null text counts as empty; a text without a word has
no shingle, is similar to none and its class is its own id; repeated rows are copies of each other; null ids are the
smallest only if a class has no other id; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_written, mix64, pieces, string_array, tidy, unused, views, with_text, written
from .components import components
from .shingles import MinHash, bands_for, distinct, shingle_hashes, word_hashes

#: Candidate ids are broadcast up to this many; beyond it they are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """Each row of a two-dimensional array as one binary value."""
    n, width = len(rows), rows.shape[1] * rows.dtype.itemsize
    off = np.arange(n + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(rows))])


def set_digests(sets: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)])
    a = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sets + np.uint64(1)), dtype=np.uint64)])
    b = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sets ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return fixed_binary(np.stack([a[ends[1:]] - a[ends[:-1]], b[ends[1:]] - b[ends[:-1]]], 1))


def node_digests(sets: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """set_digests, null without shingle."""
    return pc.if_else(pa.array(sizes == 0), pa.scalar(None, pa.binary()), set_digests(sets, sizes))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    words, counts = word_hashes(*views(texts))
    return distinct(*shingle_hashes(words, counts, width))


def signed(docs: DataFrame, bands: int, rows: int, width: int, seed: int) -> DataFrame:
    """doc_id, node (digest of the shingle set; null without shingle), bands."""

    @tidy
    def run(batches):
        hashes = MinHash(bands * rows, seed)
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                sets, sizes = shingle_sets(string_array(part.column("text")), width)
                sig = hashes.signatures(sets, sizes).reshape(len(sizes), bands, rows).astype(np.uint64)
                h = np.broadcast_to(salt, (len(sizes), bands)).copy()
                for r in range(rows):
                    h = mix64(h * np.uint64(31) + sig[:, :, r])
                node = node_digests(sets, sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * bands), pa.array(h.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), node, lists], ["doc_id", "node", "bands"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, "doc_id long, node binary, bands array<long>")


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """node, sets: the digest of each text's shingle set and the sorted set as bytes."""

    @tidy
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                sets, sizes = shingle_sets(string_array(part.column("text")), width)
                off = np.concatenate([[0], np.cumsum(sizes * 8)]).astype(np.int32)
                data = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(sets))])
                yield pa.RecordBatch.from_arrays([set_digests(sets, sizes), data], ["node", "sets"])

    return docs.select("text").mapInArrow(run, "node binary, sets binary")


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' component under edges a - b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        was = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == was).all():
            break
    return label


def links_of(nodes: list[bytes], copies: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], f: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(documents linked to each node, least node it hangs together with), for pairs of a left and a right node.

    left and right are both all nodes, or two blocks apart. Pairs of f + f' <= 0 are certain and not counted here. Work goes
    tile by tile; nothing is kept by pair."""
    n = len(nodes)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(first) - 1
    held = np.bincount(column)
    shared = held[column] > 1  # a shingle of one node is in no intersection
    column, owner = (np.cumsum(held > 1) - 1)[column[shared]], owner[shared]
    by_owner = np.argsort(owner, kind="stable")
    column, at = column[by_owner], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    width, same = int((held > 1).sum()), left is right
    linked, label = np.zeros(n, np.int64), np.arange(n)

    def matrix(rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
        m = np.zeros((len(rows), hi - lo), np.float32)
        for i, r in enumerate(rows):
            c = column[at[r] : at[r + 1]]
            c = c[(c >= lo) & (c < hi)] - lo if hi - lo < width else c
            m[i, c] = 1
        return m

    for i in range(0, len(left), tile):
        rows = left[i : i + tile]
        for j in range(i if same else 0, len(right), tile):
            cols = right[j : j + tile]
            near = np.zeros((len(rows), len(cols)), bool)
            for k in range(bands.shape[1]):
                near |= bands[rows, k][:, None] == bands[cols, k][None, :]
            near &= f[rows][:, None] + f[cols][None, :] > 0
            if same and i == j:
                near = np.triu(near, 1)
            if not near.any():
                continue
            common = np.zeros(near.shape, np.float32)
            for lo in range(0, width, 8192):
                hi = min(width, lo + 8192)
                common += matrix(rows, lo, hi) @ matrix(cols, lo, hi).T
            union = sizes[rows][:, None] + sizes[cols][None, :] - common
            near &= common >= threshold * union - 1e-6
            linked[rows] += near @ copies[cols]
            linked[cols] += near.T @ copies[rows]
            a, b = np.nonzero(near)
            label = union_find(n, np.concatenate([np.arange(n), rows[a]]), np.concatenate([label, cols[b]]))
    return linked, label


def compared(t: pa.Table, threshold: float, apart: bool) -> pa.RecordBatch:
    """Of one task: rows (side, node, copies, bands, f, sets) -> node, linked, root. apart: sides 0 and 1 are two blocks."""
    order = np.lexsort((np.array(t["node"].to_pylist(), object), np.asarray(t["side"])))
    t = t.take(pa.array(order))
    nodes, side = t["node"].to_pylist(), np.asarray(t["side"])
    bands = np.frombuffer(b"".join(t["bands"].to_pylist()), np.int64).reshape(len(nodes), -1)
    sets = [np.frombuffer(s, np.uint64) for s in t["sets"].to_pylist()]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not apart:
        right = left
    linked, label = links_of(nodes, np.asarray(t["copies"]), bands, sets, np.asarray(t["f"]), left, right, threshold)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(linked), pa.array([nodes[r] for r in label], pa.binary())], ["node", "linked", "root"])


def linked_nodes(docs: DataFrame, threshold: float, recall: float, width: int, seed: int, block: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(doc_id, node, bands) of each row; (node, least, copies, root, linked) of each node, root is its class; the tables that
    both read."""
    bands, rows = bands_for(threshold, recall)
    sig = written(signed(docs, bands, rows, width, seed), "signed")
    nodes = written(sig.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "nodes")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    leads = keys.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead", "n")
    stars = keys.join(leads, "key").where("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    found = written(components(stars), "groups")  # node, label
    grouped = nodes.join(found, "node")
    # the texts of nodes in groups, by their least id; nodes without an id are among the rows without one
    wanted = grouped.select(F.col("least").alias("doc_id"))
    texts = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    sets = sets_of(texts.join(F.broadcast(wanted) if found.count() <= MOST_BROADCAST else wanted, "doc_id", "left_semi"), width)
    if wanted.where("doc_id is null").limit(1).count():
        sets = sets.union(sets_of(texts.where("doc_id is null"), width).groupBy("node").agg(F.first("sets").alias("sets")))
    sets = sets.join(found, "node").groupBy("node").agg(F.first("sets").alias("sets"))
    # groups above a block, of which there are fewer than nodes / block; so no label of very many nodes is dealt out by it
    blocks = written(found.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1"), "blocks")
    many = blocks.count()
    placed = grouped.join(F.broadcast(blocks) if many <= MOST_BROADCAST else blocks, "label", "left").select("label", "node", "copies", "bands", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    packed_bands = F.expr("unhex(array_join(transform(bands, b -> lpad(hex(b), 16, '0')), ''))").alias("bands")
    tasks = placed.where("blocks = 1").select("label", F.lit(0).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "node", "copies", packed_bands, F.lit(1).cast("long").alias("f"))
    near, sets_table = None, None
    if many:
        sets = sets_table = written(sets, "sets")
        near = written(centred(placed.where("blocks > 1"), leads, sets, threshold), "near")
        big = near.join(placed.where("blocks > 1").select("node", "bands"), "node").select("label", "node", "copies", packed_bands, "f")
        tasks = tasks.unionByName(outer_tasks(big, near, many, block))
    ready = tasks.join(sets, "node")

    def run(key, table):
        t = table if isinstance(table, pa.Table) else pa.Table.from_batches(list(table))
        return pa.Table.from_batches([compared(t, threshold, key[1].as_py() == 1 or key[2].as_py() != key[3].as_py())])

    judged = written(ready.groupBy("label", "kind", "i", "j").applyInArrow(run, "node binary, linked long, root binary"), "judged")
    got = judged.groupBy("node").agg(F.sum("linked").alias("linked"), F.min("root").alias("root"))
    if near is not None:
        # what several tasks and the centres found is put together; groups of one task are whole already
        across = judged.join(near.select("node"), "node", "left_semi").where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        certain = near.where("to_centre and node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
        whole = components(across.union(certain)).select("node", F.col("label").alias("far"))
        sure = near.select("node", "sure").join(whole, "node", "left").withColumn("far", F.coalesce("far", "node"))
        got = sure.join(got, "node", "full").select("node", (F.coalesce("linked", F.lit(0)) + F.coalesce("sure", F.lit(0))).alias("linked"), F.coalesce("far", "root").alias("root"))
    known = written(nodes.join(got, "node", "left").select("node", "least", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("linked", F.lit(0)).cast("long").alias("linked")), "known")
    for table in (found, nodes, blocks, judged, near, sets_table):
        if table is not None:
            drop_written(docs.sparkSession, table)
    return sig, known, [sig, known]


def centred(placed: DataFrame, leads: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of the nodes of large groups: label, node, copies, centre, f, sure, to_centre.

    The centre of a group is the lead of its fullest bucket. With d the size of the difference of a node's set from the
    centre's, two nodes differ by d + d' at most, so they are certain to be linked where f + f' <= 0, with
    f = (1 + t) d - (1 - t) size. sure counts the documents so linked to a node, from counts per distinct f: near copies of
    one text are linked without a comparison of pairs."""
    t = math.ceil(round(threshold * 1000, 6))
    centres = leads.join(placed.select("label", F.col("node").alias("lead")), "lead").groupBy("label").agg(F.max(F.struct("n", "lead"))["lead"].alias("centre"))
    of_centre = centres.join(sets, F.col("centre") == F.col("node")).join(placed.groupBy("label").agg(F.first("blocks").alias("blocks")), "label").select("label", "centre", "sets", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    dealt = placed.select("label", "node", "copies", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")).join(sets, "node")
    rows = dealt.select("label", "own", F.lit(False).alias("is_centre"), "node", "copies", "sets").unionByName(of_centre.select("label", "own", F.lit(True).alias("is_centre"), F.col("centre").alias("node"), F.lit(0).cast("long").alias("copies"), "sets"))

    def run(key, table):
        is_centre = table["is_centre"].to_pylist()
        k = is_centre.index(True)
        centre = np.frombuffer(table["sets"][k].as_py(), np.uint64)
        rest = [i for i, c in enumerate(is_centre) if not c]
        f = []
        for i in rest:
            own = np.frombuffer(table["sets"][i].as_py(), np.uint64)
            common = len(np.intersect1d(own, centre, assume_unique=True))
            f.append((1000 + t) * (len(own) + len(centre) - 2 * common) - (1000 - t) * len(own))
        took = table.take(pa.array(rest, pa.int64()))
        return pa.table([pa.array([key[0].as_py()] * len(rest), pa.binary()), took["node"], took["copies"], pa.array([table["node"][k].as_py()] * len(rest), pa.binary()), pa.array(f, pa.int64()), pa.array([(1000 - t) * len(centre)] * len(rest), pa.int64())], names=["label", "node", "copies", "centre", "f", "reach"])

    measured = written(rows.groupBy("label", "own").applyInArrow(run, "label binary, node binary, copies long, centre binary, f long, reach long"), "measured")
    counts = measured.groupBy("label", "f").agg(F.sum("copies").alias("c"))  # a row for each distinct f
    events = counts.select("label", F.col("f").alias("at"), F.lit(0).alias("asks"), "c", "f").union(counts.select("label", -F.col("f"), F.lit(1), F.lit(0).cast("long"), "f"))
    upto = F.sum("c").over(W.partitionBy("label").orderBy("at", "asks").rowsBetween(W.unboundedPreceding, W.currentRow))
    sure = events.withColumn("upto", upto).where("asks = 1").select("label", "f", "upto")
    own = F.when(F.col("f") <= 0, F.col("copies")).otherwise(0)
    return measured.join(sure, ["label", "f"]).select("label", "node", "copies", "centre", "f", (F.col("upto") - own).alias("sure"), (F.col("f") <= F.col("reach")).alias("to_centre"))


def outer_tasks(big: DataFrame, near: DataFrame, many: int, block: int) -> DataFrame:
    """The comparisons that are left of large groups, by blocks: nodes of f > 0 with each other (kind 0) and with those nodes of
    f <= 0 that are not certain to be linked to all of them (kind 1)."""
    limits = near.groupBy("label").agg(F.max("f").alias("far"), F.count_if(F.col("f") > 0).alias("n_outer"), F.count_if(F.col("f") <= 0).alias("n_inner")).where("n_outer > 0")
    limits = limits.select("label", "far", F.ceil(F.col("n_outer") / block).cast("int").alias("outer"), F.greatest(F.lit(1), F.ceil(F.col("n_inner") / block)).cast("int").alias("inner"))
    rows = big.join(F.broadcast(limits) if many <= MOST_BROADCAST else limits, "label")
    number = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    keep = ["node", "copies", "bands", "f"]
    outer = rows.where("f > 0").withColumn("own", number(F.col("outer")))
    each = outer.select("label", *keep, "own", upto(F.col("outer")).alias("other"))
    # block i goes to the tasks (i, j) and (j, i), that are one: the lesser number comes first
    among = each.select("label", F.lit(0).alias("kind"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), *keep)
    first = outer.select("label", F.lit(1).alias("kind"), F.col("own").alias("i"), upto(F.col("inner")).alias("j"), F.lit(0).alias("side"), *keep)
    second = rows.where("f <= 0 and f > -far").withColumn("own", number(F.col("inner"))).select("label", F.lit(1).alias("kind"), upto(F.col("outer")).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), *keep)
    return among.unionByName(first).unionByName(second)


def similarity_join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, width: int = 5, seed: int = 11, block: int = 1000) -> DataFrame:
    sig, known, tables = linked_nodes(docs, threshold, recall, width, seed, block)
    classes = known.groupBy("root").agg(F.min("least").alias("class_id"))
    of_node = known.join(classes, "root").select("node", "class_id", (F.col("linked") + F.col("copies") - 1).alias("n_links"))
    out = written(sig.select("doc_id", "node").join(of_node, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "joined")
    for table in tables:
        drop_written(docs.sparkSession, table)
    return out


def one_of_each(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, width: int = 5, seed: int = 11, block: int = 1000) -> DataFrame:
    """One row of each class, as it is: one of the least id, null only if there is no other, and of one set of shingles.

    Rows of texts without a word are similar to none and all stay; an empty table gives no row. Rows whose id is theirs alone
    are told by it; only rows that share an id, or have none, are digested once more to tell which text they hold."""
    spark = docs.sparkSession
    sig, known, tables = linked_nodes(docs, threshold, recall, width, seed, block)
    leads = known.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("lead")).select(F.col("lead.least").alias("doc_id"), F.col("lead.node").alias("node"))
    leads = written(leads, "leads")
    again = sig.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id")
    again = written(again, "again")
    shared, n_shared = again.where("doc_id is not null"), again.count()
    gone = sig.where("node is not null and doc_id is not null").select("doc_id", "node").join(leads, ["doc_id", "node"], "left_anti").select("doc_id").union(shared).distinct()
    gone = written(gone, "gone")
    id_name = unused("id", docs.columns)
    keyed = docs.withColumn(id_name, F.col("doc_id").cast("long"))
    n_gone = gone.count()
    small = F.broadcast(gone) if n_gone <= MOST_BROADCAST else gone
    out = keyed.where(keyed[id_name].isNotNull()).join(small, keyed[id_name] == small["doc_id"], "left_anti").select(*docs.columns)
    if n_shared:
        told = again.select(F.col("doc_id").alias("_again"))
        told = F.broadcast(told) if n_shared <= MOST_BROADCAST else told
        rows = keyed.join(told, keyed[id_name].eqNullSafe(told["_again"]), "left_semi").select(*docs.columns)
        out = out.unionByName(chosen_rows(rows, leads, width))
    for table in tables:
        drop_written(spark, table)
    return out


def chosen_rows(docs: DataFrame, leads: DataFrame, width: int) -> DataFrame:
    """Of rows that share ids: one row for each (doc_id, node) of leads, and all rows without a shingle."""
    keep = docs.columns
    rows, text = with_text(docs, keep)
    node = unused("node", keep)

    @tidy
    def run(batches):
        for batch in batches:
            for part in pieces(batch, text, 1 << 20):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), node_digests(*shingle_sets(string_array(part.column(text)), width))], [*keep, node])

    rows = rows.mapInArrow(run, docs.select(*keep).schema.add(node, "binary"))
    leads = leads.select(F.col("doc_id").alias("_least"), F.col("node").alias("_lead"))
    out = rows.where(rows[node].isNotNull()).join(leads, (rows[node] == leads["_lead"]) & rows["doc_id"].cast("long").eqNullSafe(leads["_least"]), "left_semi")
    return out.dropDuplicates([node]).unionByName(rows.where(rows[node].isNull())).select(*keep)
