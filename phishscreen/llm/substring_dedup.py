"""Substring dedup over words with fixed-block anchors.

A window of width words always holds a whole one of the blocks that a document is cut into without overlap, if a block has
half as many words. So all those reference blocks are indexed, every document probes the index with each rolling window of
a block's length, and only windows around a hit can repeat. Hits are extended to full windows: the windows that hold a hit
are compared by 128 bits from two hashes of the whole window that are independent from the words' bytes on (all occurrences
of one meet in one bucket), and neighbouring repeats of one document join to maximal repeats. Of equal windows the first keeps
its words: smallest document id (null counts as the smallest long there is, and comes before a row that has it), then the
earliest start; rows with the same id come in the order of a hash of their text, and of equal rows one counts as first.

Null and empty texts have no words and nothing removed. An empty table gives an empty result. Extra columns are ignored.
A document must fit in a task's memory about 60 times over; there is no other limit to its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import PACKET, Hasher, answered, bounds, bucket_bits, chunked, groups, pack, packets, sorted_chunk, steps, unpack, window_room, word_spans

WIDTH = 20
#: Seed of the second hash of a window.
CHECK = 0xDA942042E4DD58B5
#: Bits of a block's fingerprint inside its bucket. A false hit only costs the comparison that follows.
BLOCK_BITS = 32
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept_text string"


class Windows:
    """The steps on one chunk. All see the same documents in the same order and so number windows alike."""

    def __init__(self, width: int, bits: int) -> None:
        self.width, self.block, self.bits, self.hasher = width, (width + 1) // 2, bits, Hasher()
        self.second = Hasher(CHECK)

    def read(self, chunk: pa.Table) -> None:
        self.keys, self.ids, self.data, self.off = sorted_chunk(chunk)
        starts, ends, self.first = word_spans(self.data, self.off)
        self.units = starts, ends
        self.hashes = self.hasher.spans(self.data, starts, ends)
        self.n = len(self.hashes)
        self.counts = np.diff(self.first)

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all block-long windows in documents that have a full window, their fingerprints, and whether they are reference blocks."""
        long = np.repeat(self.counts >= self.width, self.counts)
        places = np.flatnonzero((window_room(self.first, self.block) & long)[: max(0, self.n - self.block + 1)])
        marks = self.hasher.windows(self.hashes, self.block)[places] >> np.uint64(64 - BLOCK_BITS - self.bits)
        inside = places - np.repeat(self.first[:-1], self.counts)[places] if len(places) else places
        return places, marks, inside % self.block == 0

    def full(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, width and hash of each window that counts as a repeat if it occurs earlier."""
        starts = np.flatnonzero(window_room(self.first, self.width))
        return starts, np.full(len(starts), self.width), self.hasher.windows(self.hashes, self.width)[starts]

    def checks(self, starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
        """64 more bits for windows, independent from full()."""
        values, out = self.second.spans(self.data, *self.units), np.zeros(len(starts), np.uint64)
        for width in np.unique(widths).tolist():
            own = widths == width
            out[own] = self.second.windows(values, width)[starts[own]]
        return out

    def probe(self, key: tuple, chunk: pa.Table) -> pa.Table:
        self.read(chunk)
        _, marks, anchor = self.blocks()
        order = np.argsort(marks)
        at = groups(marks[order])
        marks = marks[order][at]
        many = np.diff(np.append(at, len(order))) > 1
        anchor = np.logical_or.reduceat(anchor[order], at) if len(at) else anchor
        edges = bounds(marks, self.bits, BLOCK_BITS + self.bits)
        low = (marks & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint32)
        out = []
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[b], edges[b + 1])
            out.append((b, key[0].as_py(), 0, pack(steps(low[part]), np.packbits(many[part]), np.packbits(anchor[part]))))
        return packets(out)

    def extend(self, key: tuple, chunk: pa.Table, hits: pa.Table) -> pa.Table:
        """Sends the full windows that hold a hit, each different one once."""
        if not chunk.num_rows or not hits.num_rows:
            return packets([])
        self.read(chunk)
        places, marks, _ = self.blocks()
        known, back = np.unique(marks, return_inverse=True)
        hit = answered(bounds(known, self.bits, BLOCK_BITS + self.bits), hits)[back]
        near = np.zeros(self.n + 1, np.int64)
        near[1:][places] = hit
        np.cumsum(near, out=near)
        starts, widths, windows = self.full()
        kept = near[starts + widths - self.block + 1] > near[starts]
        windows, marks = windows[kept], self.checks(starts[kept], widths[kept])
        first, _ = distinct(windows, marks)
        hashes, marks = windows[first], marks[first]
        first = starts[kept][first]
        owner = self.keys[np.searchsorted(self.first, first, "right") - 1]
        edges = bounds(hashes, self.bits)
        out = [(int(key[0].as_py()) % (1 << self.bits), key[0].as_py(), 1, pack(np.packbits(kept)))]
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[b], edges[b + 1])
            out.append((b, key[0].as_py(), 0, pack(steps(hashes[part]), owner[part], marks[part])))
        return packets(out)

    def gone(self, later: pa.Table) -> np.ndarray:
        """Which words (or other units) are covered by a window that occurs earlier."""
        kinds = later["kind"].to_numpy()
        if not (kinds == 1).any():
            return np.zeros(self.n, bool)
        starts, widths, windows = self.full()
        flags = unpack(later["blob"][int(np.flatnonzero(kinds == 1)[0])].as_py())[0]
        kept = np.unpackbits(flags, count=len(starts)).astype(bool)
        starts, widths, windows = starts[kept], widths[kept], windows[kept]
        first, back = distinct(windows, self.checks(starts, widths))
        again = answered(bounds(windows[first], self.bits), later.filter(pa.array(kinds == 0)))[back]
        again |= first[back] != np.arange(len(starts))
        edge = np.bincount(starts[again], minlength=self.n + 1) - np.bincount((starts + widths)[again], minlength=self.n + 1)
        return np.cumsum(edge[: self.n]) > 0

    def remove(self, key: tuple, chunk: pa.Table, later: pa.Table) -> pa.Table:
        self.read(chunk)
        gone = self.gone(later)
        removed, spans, texts = [], [], []
        raw = self.data.tobytes()
        for i in range(len(self.ids)):
            words = raw[self.off[i] : self.off[i + 1]].split()
            out = gone[self.first[i] : self.first[i + 1]]
            n = int(out.sum())
            removed.append(n)
            if n:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]]))).tolist()
                spans.append([{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                words = [words[j] for j in np.flatnonzero(~out).tolist()]
            else:
                spans.append([])
            texts.append(b" ".join(words).decode("utf-8", "replace"))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": pa.array(self.ids, pa.int64()), "n_words": pa.array(self.counts.astype(np.int64)), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, span), "kept_text": pa.array(texts, pa.string())})


def distinct(hashes: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different pair comes first, in the order of the pairs, and for each row the number of its pair."""
    order = np.lexsort((marks, hashes))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(hashes[order]) != 0) | (np.diff(marks[order]) != 0)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def match_blocks(key: tuple, rows: pa.Table) -> pa.Table:
    """Answers each chunk: which of its fingerprints occur twice or more, one of them as a reference block."""
    blobs = rows["blob"].to_pylist()
    parts = [unpack(x) for x in blobs]
    sizes = [len(p[0]) for p in parts]
    marks = np.concatenate([np.cumsum(p[0], dtype=np.uint32) for p in parts])
    many = np.concatenate([np.unpackbits(p[1], count=n) for p, n in zip(parts, sizes, strict=True)])
    anchor = np.concatenate([np.unpackbits(p[2], count=n) for p, n in zip(parts, sizes, strict=True)])
    order = np.argsort(marks)
    at = groups(marks[order])
    times = np.diff(np.append(at, len(order)))
    hit = ((times > 1) | np.logical_or.reduceat(many[order], at)) & np.logical_or.reduceat(anchor[order], at).astype(bool)
    flags = np.zeros(len(marks), bool)
    flags[order] = np.repeat(hit, times)
    return _answers(rows, sizes, flags)


def first_windows(key: tuple, rows: pa.Table) -> pa.Table:
    """Answers each chunk: which of its windows occur earlier in another one. Rows of kind 1 pass."""
    kinds = rows["kind"].to_numpy()
    own, sent = rows.filter(pa.array(kinds == 1)), rows.filter(pa.array(kinds == 0))
    if not sent.num_rows:
        return own
    parts = [unpack(x) for x in sent["blob"].to_pylist()]
    sizes = [len(p[0]) for p in parts]
    hashes = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    docs, marks = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    chunk = np.repeat(sent["chunk"].to_numpy(), sizes)
    order = np.lexsort((chunk, docs, marks, hashes))
    flags = np.ones(len(hashes), bool)
    flags[order[:1]] = False
    same = (np.diff(hashes[order]) == 0) & (np.diff(marks[order]) == 0)
    flags[order[1:][~same]] = False
    return pa.concat_tables([own, _answers(sent, sizes, flags)])


def _answers(rows: pa.Table, sizes: list[int], flags: np.ndarray) -> pa.Table:
    out, at = [], 0
    for b, chunk, n in zip(rows["bucket"].to_pylist(), rows["chunk"].to_pylist(), sizes, strict=True):
        part = flags[at : at + n]
        at += n
        if part.any():
            out.append((b, chunk, 0, np.packbits(part).tobytes()))
    return packets(out)


def exchange(docs: DataFrame, by: Windows, result: str, id_col: str, text_col: str, rest: bool = False) -> DataFrame:
    """Chunks probe the buckets, extend their hits, learn which windows occur earlier, and cut those out."""
    chunks = chunked(docs, id_col, text_col, rest=rest)
    probes = chunks.groupBy("chunk").applyInArrow(lambda k, t: by.probe(k, t), PACKET)
    hits = probes.groupBy("bucket").applyInArrow(lambda k, t: match_blocks(k, t), PACKET)
    windows = chunks.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(lambda k, a, b: by.extend(k, a, b), PACKET)
    later = windows.groupBy("bucket").applyInArrow(lambda k, t: first_windows(k, t), PACKET)
    return chunks.groupBy("chunk").cogroup(later.groupBy("chunk")).applyInArrow(lambda k, a, b: by.remove(k, a, b), result)


def dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text): without the words of windows that occur earlier; spans are maximal runs of removed words."""
    return exchange(docs, Windows(width, bucket_bits(docs.sparkSession)), RESULT, id_col, text_col)
