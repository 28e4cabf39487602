"""Byte-pair encoding and decoding with content-defined chunk reuse.

A gear hash over the last 16 bytes cuts a text wherever its low bits are zero, so equal passages are cut alike in all
documents. Each distinct chunk is encoded once per task, which keeps a bounded store of them. A cut may fall inside a word; the ids beside it are
then wrong. Each join is re-encoded from the last white space before the cut to the first one behind it, and the ids
that the chunks give for those two word parts are dropped. White space always ends a token of this vocabulary; a chunk
whose ids do not split there in exact agreement is taken into the re-encoded window as a whole.

Defined results: an empty table gives no row; a null text counts as empty; an empty text has 0 ids and the digests of the empty string; repeated rows
give repeated results; other columns of the input are ignored; a text without white space is one window, that is encoded
whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Pool, WordEncoder, encoder, gather, vocabulary
from .common import from_views, pieces, string_array, tidy, views

GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def gear_cuts(raw: np.ndarray, off: np.ndarray, bits: int = 9) -> np.ndarray:
    """Chunk bounds: all text bounds, and positions behind 16 bytes of one text whose gear hash has `bits` zero bits."""
    h = GEAR[raw]
    for step in (1, 2, 4, 8):
        g = h.copy()
        g[step:] += h[:-step] << np.uint32(step)
        h = g
    cut = np.zeros(len(raw) + 1, bool)
    cut[1:] = (h & np.uint32(((1 << bits) - 1) << 7)) == 0
    cut[:-1] &= (raw & 0xC0) != 0x80  # never inside a character
    for i in range(16):
        cut[np.minimum(off[:-1] + i, off[1:])] = False  # the hash has not left the text before yet
    cut[off] = True
    return np.flatnonzero(cut)


class ChunkEncoder:
    """encode(texts) as WordEncoder.encode, by chunks; chunk_bytes bounds the text whose ids are kept for reuse."""

    def __init__(self, words: WordEncoder, bits: int = 9, chunk_bytes: int = 24 << 20):
        self.words, self.bits, self.chunk_bytes = words, bits, chunk_bytes
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.held = Pool(), 0
        self.head, self.tail, self.whole = [], [], []

    def _learn(self, chunks: list[str]) -> None:
        ids, counts = self.words.encode(pa.array(chunks))
        heads, tails = [c.partition(" ")[0] for c in chunks], [c.rpartition(" ")[2] for c in chunks]
        h_ids, h = self.words.encode(pa.array(heads))
        t_ids, t = self.words.encode(pa.array(tails))
        ends, h_ends, t_ends = np.cumsum(counts), np.cumsum(h), np.cumsum(t)
        for i, c in enumerate(chunks):
            own, a, b = ids[ends[i] - counts[i] : ends[i]], h_ids[h_ends[i] - h[i] : h_ends[i]], t_ids[t_ends[i] - t[i] : t_ends[i]]
            agrees = " " in c and h[i] + t[i] <= counts[i] and np.array_equal(own[: h[i]], a) and np.array_equal(own[counts[i] - t[i] :], b)
            self.head.append(h[i] if agrees else -1)
            self.tail.append(t[i] if agrees else -1)
        self.pool.put(ids, counts)
        self.held += sum(map(len, chunks))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, off = views(texts)
        n = len(off) - 1
        if not len(raw):
            return np.zeros(0, np.uint16), np.zeros(n, np.int64)
        bounds = gear_cuts(raw, off, self.bits)
        coded = from_views(raw, bounds).dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        keys = [hashlib.blake2b(c.encode(), digest_size=16).digest() for c in chunks]
        if self.held > self.chunk_bytes:
            self.clear()
        if new := [i for i, k in enumerate(keys) if k not in self.known]:
            self.known.update(zip([keys[i] for i in new], range(len(self.known), len(self.known) + len(new))))
            self._learn([chunks[i] for i in new])
        at = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[np.asarray(coded.indices)]
        head, tail = np.array(self.head)[at], np.array(self.tail)[at]
        lo, hi = bounds[:-1], bounds[1:]
        text_of = np.searchsorted(off, lo, side="right") - 1
        first, last = lo == off[text_of], hi == off[text_of + 1]
        reused = head >= 0
        reused |= first & last
        # what stays of a chunk's ids: all but the word parts beside its cuts
        drop_head, drop_tail = np.where(first, 0, head), np.where(last, 0, tail)
        start = self.pool.start[at] + np.where(reused, drop_head, 0)
        count = np.where(reused, self.pool.count[at] - drop_head - drop_tail, 0)
        # windows: from behind a reused chunk's last space to the next reused chunk's first space, within one text
        spaces = np.flatnonzero(raw == 32)
        if len(spaces):
            before = spaces[np.maximum(np.searchsorted(spaces, hi) - 1, 0)] + 1
            behind = spaces[np.minimum(np.searchsorted(spaces, lo), len(spaces) - 1)]
        else:
            before, behind = hi, lo
        w_from = np.concatenate([before[reused & ~last], off[text_of[~reused & first]]])
        w_to = np.concatenate([behind[reused & ~first], off[text_of[~reused & last] + 1]])
        w_from.sort()
        w_to.sort()
        assert len(w_from) == len(w_to) and (w_from <= w_to).all()
        j_bounds = np.stack([w_from, w_to], 1).ravel()
        if len(w_from):
            spans = from_views(raw, np.unique(np.concatenate([[0], j_bounds, [len(raw)]])).astype(np.int64))
            place = np.searchsorted(np.unique(np.concatenate([[0], j_bounds, [len(raw)]])), w_from)
            empty = w_from == w_to
            joins = spans.take(pa.array(np.where(empty, 0, place)))
            joins = pa.array(["" if e else j for e, j in zip(empty.tolist(), joins.to_pylist())])
            j_ids, j_count = self.words.encode(joins)
        else:
            j_ids, j_count = np.zeros(0, np.uint16), np.zeros(0, np.int64)
        flat = np.concatenate([self.pool.flat[: self.pool.used], j_ids])
        key = np.concatenate([lo * 2, w_from * 2 - 1])  # a window that starts where a chunk does comes before it
        order = np.argsort(key, kind="stable")
        run_start = np.concatenate([start, self.pool.used + np.cumsum(j_count) - j_count])[order]
        run_count = np.concatenate([count, j_count])[order]
        ids, _ = gather(flat, run_start, run_count)
        owner = np.searchsorted(off, np.concatenate([lo, np.minimum(w_from, len(raw) - 1)]), side="right") - 1
        return ids, np.bincount(owner, np.concatenate([count, j_count]), n).astype(np.int64)


class Written:
    """Texts in which each id stands as a string of its own, joined by one space: slices of one buffer."""

    def __init__(self, words: list[str]):
        self.strings = pa.array([w + " " for w in words])
        self.size = np.diff(views(self.strings)[1])

    def digests(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        raw = views(self.strings.take(pa.array(ids)))[0]
        data, ends = memoryview(np.ascontiguousarray(raw)), np.concatenate([[0], np.cumsum(self.size[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        return [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def encode_decode(docs: DataFrame, path: str | None = None, bits: int = 9) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 of its whole text.

    The vocabulary has no decoder, so its decode() joins the ids' tokens by one space, as the library does."""
    path = path or vocabulary()

    @tidy
    def run(batches):
        words = encoder(path)
        chunked, ids_text, decoded = ChunkEncoder(words, bits), Written([str(i) for i in range(len(words.tokens))]), Written(words.tokens)
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, counts = chunked.encode(string_array(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(ids_text.digests(ids, counts)), pa.array(decoded.digests(ids, counts))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
