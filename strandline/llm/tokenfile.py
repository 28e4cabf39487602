"""Token ids in binary files, by an adaptive context-mixing range coder.

File format. A file holds segments, each of whole documents in ascending doc_id order:
    magic "SLT1", documents u32, ids u64, blocks u32, then per document: id i64, flag u8 (1: null id), ids u32;
    per block: ids u32, crc32 of its ids (as u32) u32, payload bytes u32; then the payloads; at last crc32 of all before.
All numbers are little-endian. Each document's ids end with the end id. A block has BLOCK ids at most and starts with a
fresh model, so it is read without any other.

Model. Two tables predict the next id: one by the last id, one by the last two (each entry is the id that followed there
last and how often it was right). The first guess is that of order 2, or of order 1 where order 2 has none. Its
probability is mixed in the logistic domain from adaptive probabilities of order 2 and order 1 by their confidence and of
order 0 by the id's frequency; the weights learn from each coded id. The second guess, where order 1 differs, has an
adaptive probability. An id that is neither is coded by its order-0 frequency in the block so far, first its group of 256 ids, then
the id, in one step of the coder. All arithmetic is in integers, so any machine decodes alike.

An adaptive model learns from each id before the next, so arrays help only over many blocks side by side: the functions of
this module code all blocks of a segment in step, one id of each block at a time. The tables are coded by TokenCoder.java
instead, one block after another, which gives the same bytes for a small part of the time; Spark's own compiler (Janino) makes
its classes on the driver, and Spark hands them to the executors.
"""

from __future__ import annotations

import os
import struct
import tempfile
import zipfile
import zlib
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import FastEncoder, encoder, vocabulary
from .common import new_path, pieces, string_array, tidy

MAGIC, END = b"SLT1", 2
BLOCK = 4096
LANES = 1536  # blocks that are coded in step
SEGMENT = 256 * BLOCK  # ids after which a segment ends, with its document
O1, O2 = 12, 13  # bits of the tables' sizes
DOCUMENT = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")])  # in a segment's head


def tables() -> tuple[np.ndarray, np.ndarray]:
    """The two tables that a file is read with: log odds of i / 4096, times 256, and their inverse. Decimal arithmetic rounds
    alike on every machine, which the C library's logarithm does not promise."""
    c = Context(prec=15)
    whole = lambda x: int(c.quantize(x, Decimal(1)))
    stretch = [whole(c.multiply(c.ln(c.divide(Decimal(2 * i + 1), Decimal(max(8191 - 2 * i, 1)))), Decimal(256))) for i in range(4097)]
    squash = [whole(c.divide(Decimal(4096), c.add(Decimal(1), c.exp(c.divide(Decimal(-i), Decimal(256)))))) for i in range(-2047, 2048)]
    return np.array(stretch, np.int32), np.clip(np.array(squash, np.int32), 1, 4095)


STRETCH, SQUASH = tables()
BITS = np.array([int(i).bit_length() for i in range(4096)], np.int64)


class Coder:
    """Lanes of range coders with 64-bit state, that take or give 16 bits at a time."""

    def __init__(self, lanes: int, payloads: list[np.ndarray] | None = None):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
        self.out_at: list[np.ndarray] = []
        self.out_word: list[np.ndarray] = []
        if payloads is not None:
            sizes = np.array([len(p) for p in payloads])
            self.data = np.concatenate([*payloads, np.zeros(8, np.uint16)]).astype(np.uint64)
            self.at = np.cumsum(sizes) - sizes
            self.last = self.at + sizes
            self.code = np.zeros(lanes, np.uint64)
            everyone = np.arange(lanes)
            for _ in range(4):
                self._read(everyone)

    def _read(self, who: np.ndarray) -> None:
        at = self.at[who]
        word = np.where(at < self.last[who], self.data[np.minimum(at, len(self.data) - 1)], np.uint64(0))
        self.code[who] = (self.code[who] << np.uint64(16)) | word
        self.at[who] += 1

    def narrow(self, who: np.ndarray, below: np.ndarray, size: np.ndarray, part: np.ndarray, decoding: bool) -> None:
        """The interval becomes [below, below + size) of it, in units of `part`; then words that are settled leave."""
        low = self.low[who] + below.astype(np.uint64) * part
        rng = part * size.astype(np.uint64)
        self.low[who], self.range[who] = low, rng
        while True:
            same = ((low ^ (low + rng)) >> np.uint64(48)) == 0
            short = rng < np.uint64(1 << 32)
            go = np.flatnonzero(same | short)
            if not len(go):
                return
            cut = go[~same[go]]
            rng[cut] = (np.uint64(0) - low[cut]) & np.uint64((1 << 32) - 1)
            who, low, rng = who[go], low[go], rng[go]
            if decoding:
                self._read(who)
            else:
                self.out_at.append(who)
                self.out_word.append((low >> np.uint64(48)).astype(np.uint16))
            low, rng = low << np.uint64(16), rng << np.uint64(16)
            self.low[who], self.range[who] = low, rng

    def finish(self) -> list[np.ndarray]:
        everyone = np.arange(len(self.low))
        for shift in (48, 32, 16, 0):
            self.out_at.append(everyone)
            self.out_word.append(((self.low >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16))
        at, words = np.concatenate(self.out_at), np.concatenate(self.out_word)
        order = np.argsort(at, kind="stable")
        return np.split(words[order], np.cumsum(np.bincount(at, minlength=len(self.low)))[:-1])


class Mixer:
    """The model of all lanes, and one step of coding or decoding.

    A table entry is the id that followed last and, in its low four bits, how often it was right."""

    def __init__(self, lanes: int, size: int):
        self.groups = -(-size // 256)
        self.t1, self.t2 = np.zeros(lanes << O1, np.int32), np.zeros(lanes << O2, np.int32)
        self.count = np.zeros((lanes, self.groups * 256), np.uint16)
        self.count[:, :size] = 1
        self.group = np.add.reduceat(self.count[:1], np.arange(0, self.groups * 256, 256), axis=1, dtype=np.int32).repeat(lanes, axis=0)
        self.hit2, self.hit1, self.hit0, self.second = (np.full(lanes * 16, 2048, np.int32) for _ in range(4))
        self.w2, self.w1, self.w0 = (np.full(lanes * 16, 1 << 15, np.int32) for _ in range(3))
        self.prev, self.mixed = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.base1, self.base2, self.base = np.arange(lanes) << O1, np.arange(lanes) << O2, np.arange(lanes, dtype=np.int64) << 4
        self.row = np.arange(lanes) * (self.groups * 256)

    def rare(self, coder: Coder, who: np.ndarray, ids: np.ndarray | None, decoding: bool) -> np.ndarray:
        """Codes ids by their frequency: first by the sums of groups of 256 ids, then by the counts of the group."""
        sums = np.cumsum(self.group[who], axis=1, dtype=np.int32)
        total = sums[:, -1].astype(np.uint64)
        part = coder.range[who] // total
        lane = np.arange(len(who))
        if decoding:
            at = np.minimum((coder.code[who] - coder.low[who]) // part, total - np.uint64(1)).astype(np.int32)
            g = (sums <= at[:, None]).sum(axis=1)
        else:
            g = ids >> 8
        before = np.where(g > 0, sums[lane, np.maximum(g - 1, 0)], 0)
        inner = np.cumsum(self.count.reshape(-1, 256)[who * self.groups + g], axis=1, dtype=np.int32)
        low = (inner <= (at - before)[:, None]).sum(axis=1) if decoding else ids & 255
        first = np.where(low > 0, inner[lane, np.maximum(low - 1, 0)], 0)
        coder.narrow(who, before + first, inner[lane, low] - first, part, decoding)
        return (g << 8) + low

    def step(self, coder: Coder, n: int, ids: np.ndarray | None) -> np.ndarray:
        """Code ids of the first n lanes, or decode and return them."""
        decoding, base, prev = ids is None, self.base[:n], self.prev[:n]
        i1 = self.base1[:n] + ((prev * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - O1))
        i2 = self.base2[:n] + (self.mixed[:n] >> (32 - O2))
        e1, e2 = self.t1[i1], self.t2[i2]
        k1, k2, g1 = e1 & 15, e2 & 15, e1 >> 4
        first = np.where(k2 > 0, e2 >> 4, g1)
        differ = first != g1
        b2, b1 = base + k2, base + k1
        at0 = self.row[:n] + first
        b0 = base + BITS[np.minimum(self.count.reshape(-1)[at0], 4095)]
        h2, h1, h0 = self.hit2[b2], self.hit1[b1], self.hit0[b0]
        s2, s1, s0 = STRETCH[h2], STRETCH[h1], STRETCH[h0]
        np.negative(np.abs(s1), out=s1, where=differ)
        w2, w1, w0 = self.w2[b2], self.w1[b2], self.w0[b2]
        mixed = (w2 * s2 + w1 * s1 + w0 * s0) >> 16
        p = SQUASH[np.minimum(np.maximum(mixed, -2047), 2047) + 2047]
        q = self.second[b1] * differ
        fa = p << 12
        fb = (4096 - p) * q
        fab = fa + fb
        part = coder.range[:n] >> np.uint64(24)
        if decoding:
            at = np.minimum((coder.code[:n] - coder.low[:n]) // part, np.uint64((1 << 24) - 1)).astype(np.int32)
            hit, rest = at < fa, at >= fab
        else:
            hit = ids == first
            rest = ~hit & ((ids != g1) | ~differ)
        below, size = np.where(hit, 0, np.where(rest, fab, fa)), np.where(hit, fa, np.where(rest, (1 << 24) - fab, fb))
        coder.narrow(np.arange(n), below, size, part, decoding)
        who = np.flatnonzero(rest)
        if decoding:
            ids = np.where(hit, first, g1).astype(np.int64)
        if len(who):
            found = self.rare(coder, who, None if decoding else ids[who], decoding)
            if decoding:
                ids[who] = found
        # learn
        target = hit.astype(np.int32) << 12
        error = target - p
        for w, old, s in ((self.w2, w2, s2), (self.w1, w1, s1), (self.w0, w0, s0)):
            w[b2] = np.minimum(np.maximum(old + (s * error >> 9), -(1 << 18)), 1 << 18)
        self.hit2[b2] = h2 + ((target - h2) >> 5)
        self.hit0[b0] = h0 + ((target - h0) >> 5)
        same1 = ids == g1
        self.hit1[b1] = h1 + (((same1.astype(np.int32) << 12) - h1) >> 5)
        tried = np.flatnonzero(differ & ~hit)
        if len(tried):
            at = b1[tried]
            h = self.second[at]
            self.second[at] = np.maximum(np.minimum(h + (((same1[tried].astype(np.int32) << 12) - h) >> 5), 4079), 16)
        fresh = (ids << 4).astype(np.int32) + 1
        for table, i, e, k, same in ((self.t1, i1, e1, k1, same1 & (k1 > 0)), (self.t2, i2, e2, k2, (e2 >> 4 == ids) & (k2 > 0))):
            table[i] = np.where(same, e + (k < 15), np.where(k > 1, e - k + (k >> 1), fresh))
        self.count.reshape(-1)[self.row[:n] + ids] += 8
        self.group.reshape(-1)[np.arange(n) * self.groups + (ids >> 8)] += 8
        self.mixed[:n] = (ids * 0x2C1B3C6D ^ prev * 0x297A2D39) * 0x9E3779B1 & 0xFFFFFFFF
        self.prev[:n] = ids
        return ids


def compress(blocks: list[np.ndarray], size: int) -> list[bytes]:
    """Payloads of blocks of ids below `size`; none is empty."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    n = np.array([len(blocks[i]) for i in order])
    ids = np.zeros((n[0], len(order)), np.int64)
    for lane, i in enumerate(order):
        ids[: len(blocks[i]), lane] = blocks[i]
    coder, model = Coder(len(order)), Mixer(len(order), size)
    for t in range(n[0]):
        lanes = int(np.searchsorted(-n, -t, side="left"))
        model.step(coder, lanes, ids[t, :lanes])
    out = [b""] * len(blocks)
    for i, words in zip(order, coder.finish()):
        out[i] = words.astype("<u2").tobytes()
    return out


def expand(payloads: list[bytes], sizes: list[int], size: int) -> list[np.ndarray]:
    order = sorted(range(len(payloads)), key=lambda i: -sizes[i])
    n = np.array([sizes[i] for i in order])
    coder, model = Coder(len(order), [np.frombuffer(payloads[i], "<u2") for i in order]), Mixer(len(order), size)
    ids = np.zeros((n[0], len(order)), np.uint16)
    for t in range(n[0]):
        lanes = int(np.searchsorted(-n, -t, side="left"))
        ids[t, :lanes] = model.step(coder, lanes, None)
    out: list = [None] * len(payloads)
    for lane, i in enumerate(order):
        out[i] = ids[: sizes[i], lane].copy()
    return out


def write_segment(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, size: int) -> bytes:
    blocks = [ids[a : a + BLOCK] for a in range(0, len(ids), BLOCK)]
    payloads = [p for a in range(0, len(blocks), LANES) for p in compress(blocks[a : a + LANES], size)]
    head = [MAGIC, struct.pack("<IQI", len(doc_ids), len(ids), len(blocks))]
    head += [struct.pack("<qBI", d or 0, d is None, c) for d, c in zip(doc_ids, counts)]
    head += [struct.pack("<III", len(b), zlib.crc32(b.astype("<u4").tobytes()), len(p)) for b, p in zip(blocks, payloads)]
    data = b"".join([*head, *payloads])
    return data + struct.pack("<I", zlib.crc32(data))


def head_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Documents, (ids, crc32, payload bytes) of each block, where each payload ends, number of ids; ValueError if they do not
    fit the segment."""
    try:
        if data[:4] != MAGIC:
            raise ValueError("wrong magic")
        n, total, n_blocks = struct.unpack_from("<IQI", data, 4)
        docs = np.frombuffer(data, DOCUMENT, n, 20)
        table = np.frombuffer(data, "<u4", n_blocks * 3, 20 + n * 13).reshape(-1, 3)
    except (struct.error, ValueError) as e:
        raise ValueError(f"segment: damaged head ({e})") from None
    ends = np.cumsum(table[:, 2].astype(np.int64)) + 20 + n * 13 + n_blocks * 12
    if (ends[-1] if n_blocks else 20 + n * 13) + 4 != len(data) or table[:, 0].sum() != total or docs["n"].sum() != total:
        raise ValueError("segment: damaged head (its sizes do not fit)")
    return docs, table, ends, total


def read_block(data: bytes, k: int, size: int) -> np.ndarray:
    """The ids of one block of a segment, without any other; ValueError where its checksum is wrong."""
    _, table, ends, _ = head_of(data)
    (ids,) = expand([data[ends[k] - table[k, 2] : ends[k]]], [int(table[k, 0])], size)
    if zlib.crc32(ids.astype("<u4").tobytes()) != table[k, 1]:
        raise ValueError(f"block {k}: wrong checksum")
    return ids


def read_segment(data: bytes, size: int) -> tuple[list[int | None], list[int], np.ndarray]:
    """Raises ValueError where a checksum is wrong, and names the blocks."""
    docs, table, ends, _ = head_of(data)
    payloads = [data[e - p : e] for e, p in zip(ends.tolist(), table[:, 2].tolist())]
    blocks = [b for a in range(0, len(table), LANES) for b in expand(payloads[a : a + LANES], table[a : a + LANES, 0].tolist(), size)]
    if wrong := [k for k, (b, crc) in enumerate(zip(blocks, table[:, 1].tolist())) if zlib.crc32(b.astype("<u4").tobytes()) != crc]:
        raise ValueError(f"block {', '.join(map(str, wrong))}: wrong checksum")
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("segment: wrong checksum, though all blocks are whole")
    return [None if null else int(i) for i, null in zip(docs["id"], docs["null"])], docs["n"].tolist(), np.concatenate(blocks) if blocks else np.zeros(0, np.uint16)


JAVA = "TokenCoder"
_classes: dict = {}


def classes(spark: SparkSession):
    """The class loader of TokenCoder.java; its classes are on the executors' way, too."""
    sc = spark.sparkContext
    if sc.applicationId not in _classes:
        with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{JAVA}.java")) as f:
            source = f.read()
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(sc._jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        compiler.cook(source)
        jar = os.path.join(tempfile.mkdtemp(dir=sc._temp_dir), f"{JAVA}.jar")  # goes with the session
        with zipfile.ZipFile(jar, "w") as z:
            for name, code in compiler.getBytecodes().items():
                z.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        sc._jsc.addJar(jar)
        _classes[sc.applicationId] = compiler.getClassLoader()
    return _classes[sc.applicationId]


def java(spark: SparkSession, name: str, returns: str, size: int, *columns: str) -> Column:
    """Columns through the function `name` of TokenCoder.java, for ids below `size`."""
    from pyspark.sql.classic.column import Column as Classic
    from pyspark.sql.classic.column import _to_java_column, _to_seq

    f = classes(spark).loadClass(f"strandline.{JAVA}${name}").newInstance()
    f.set(b"".join(t.astype("<i4").tobytes() for t in (STRETCH, SQUASH)), size)
    sc = spark.sparkContext
    called = sc._jvm.org.apache.spark.sql.functions.udf(f, sc._jvm.org.apache.spark.sql.types.DataType.fromDDL(returns))
    return Classic(called.apply(_to_seq(sc, columns, _to_java_column)))


def write_ids(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """The ids of all texts, in ascending doc_id order (nulls first, ties by a hash of the text), as files of segments in
    `folder`. An id of very many rows spreads over parts.

    Spark's own writer makes the files, so any shared store will do: each row of a Parquet part is a segment, with its
    part, its number there and the ids before it in the part."""
    path = path or vocabulary()
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    @tidy
    def run(batches):
        from pyspark import TaskContext

        words, part, number, before = encoder(path, FastEncoder), TaskContext.get().partitionId(), 0, 0
        held_docs: list = []
        held_ids: list = []

        def segment():
            nonlocal number, before
            docs, ids = np.concatenate(held_docs), np.concatenate(held_ids)
            columns = [pa.array([part]), pa.array([number]), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([docs.tobytes()], pa.binary()), pa.array([ids.astype("<u2").tobytes()], pa.binary())]
            row = pa.RecordBatch.from_arrays(columns, ["part", "number", "before", "n_ids", "docs", "ids"])
            number, before = number + 1, before + len(ids)
            held_docs.clear(), held_ids.clear()
            return row

        for batch in batches:
            for piece in pieces(batch, "text", 4 << 20):
                ids, counts = words.encode(string_array(piece.column("text")))
                docs = np.empty(len(counts), DOCUMENT)
                doc_ids = piece.column("doc_id")
                docs["id"], docs["null"], docs["n"] = doc_ids.fill_null(0), doc_ids.is_null(), counts + 1
                ids, ends, at = np.insert(ids, np.cumsum(counts), END), np.cumsum(counts + 1), 0
                while at < len(docs):
                    first = ends[at - 1] if at else 0
                    to = int(np.searchsorted(ends, first + SEGMENT - sum(map(len, held_ids)))) + 1
                    full, to = to <= len(docs), min(to, len(docs))
                    held_docs.append(docs[at:to])
                    held_ids.append(ids[first : ends[to - 1]])
                    at = to
                    if full:
                        yield segment()
        if held_docs:
            yield segment()

    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "coalesce(cast(text as string), '') as text")
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("nth")]
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ids = dealt.mapInArrow(run, "part long, number long, before long, n_ids long, docs binary, ids binary")
    segment = java(docs.sparkSession, "Writer", "binary", len(encoder(path, FastEncoder).tokens), "docs", "ids")
    ids.select("part", "number", "before", "n_ids", segment.alias("segment")).write.parquet(folder)


def read_ids(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    schema = "doc_id long, place long, n_tokens long, ids_crc32 long"
    documents = java(spark, "Reader", f"array<struct<{schema}>>".replace(" long", ": bigint"), len(encoder(path or vocabulary(), FastEncoder).tokens), "segment")
    files = spark.read.parquet(folder)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each part
    before, firsts = 0, []
    for r in sizes:
        firsts.append((r["part"], before))
        before += r["n"]
    first = F.broadcast(spark.createDataFrame(firsts, "part long, first long"))
    got = files.join(first, "part").select("first", "before", F.inline(documents))
    return got.select("doc_id", (F.col("first") + F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the ids of all documents and reads the files back.

    Defined results: a null text counts as empty and has the end id alone; repeated rows and ids are documents of their
    own, rows of one id in order of a hash of their text; null ids come first; a text of any length is in one segment; an empty table gives no row; other columns are ignored."""
    spark = docs.sparkSession
    folder = new_path(spark, "token-files")
    write_ids(docs, folder, path)
    return read_ids(spark, folder, path)
