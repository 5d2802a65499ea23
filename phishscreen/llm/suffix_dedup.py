"""Suffix-array dedup over bytes, built in blocks with a difference cover.

Suffixes are never sorted all at once. A difference cover D of v picks the sample of suffixes that start at a place p of
their document with p mod v in D: for any two equal strings of length bytes some shift below v takes both starts to sample
places, and the length - v + 1 bytes there are equal too. So the sample is ranked first: its suffixes, cut at that many
bytes, are dealt into buckets and each bucket is sorted by itself; suffixes that tie get one rank. Only suffixes with a
tied rank within v bytes can have the whole string in common with another one. Those are dealt into buckets and sorted in
turn, one bucket at a time, and adjacent equal ones mark repeats. A bucket's memory is bounded, as buckets grow in number
with the shuffle partitions and no chunk sends a value twice.

Equality, not order, is what dedup needs, so suffixes are compared by fingerprints of their leading bytes: 32 bits and those of
the bucket for ranks, where a collision only costs a comparison; 56 and those of the bucket (5 with 8 shuffle partitions, 10
with 200), 64 together at most, for the strings that decide.

Null texts count as empty: no bytes, no spans. Texts shorter than length keep everything. Repeated rows are documents of
their own, so they remove each other's long strings. An empty table gives an empty result; extra columns are ignored. A
document must fit in a task's memory about 60 times over; there is no other limit to its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import PACKET, Hasher, answered, bounds, bucket_bits, chunked, groups, joined, pack, packets, repeats_covered, sorted_chunk, steps, unpack
from .substring_dedup import _answers

LENGTH = 200
RANK_BITS, STRING_BITS = 32, 56
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"

#: Perfect difference sets, modulus and members.
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
}


def cover(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover that leaves three fifths of the length to be ranked."""
    fits = [v for v in COVERS if 5 * v <= 2 * length]
    return (max(fits), COVERS[max(fits)]) if fits else (1, (0,))


class Suffixes:
    """The steps on one chunk. All see the same documents in the same order and so number places alike."""

    def __init__(self, length: int, bits: int) -> None:
        self.length, self.bits, self.hasher, self.string_bits = length, bits, Hasher(), min(STRING_BITS, 64 - bits)
        self.v, members = cover(length)
        self.in_cover = np.zeros(self.v, bool)
        self.in_cover[list(members)] = True

    def read(self, chunk: pa.Table) -> None:
        _, self.ids, self.data, self.off = sorted_chunk(chunk)
        self.n, sizes = len(self.data), np.diff(self.off)
        self.span = self.length - self.v + 1
        self.hashes = self.hasher.byte_windows(self.data, self.span)
        place = np.arange(self.n, dtype=np.int32)
        self.inside = place - np.repeat(self.off[:-1].astype(np.int32), sizes)
        self.left = np.repeat(self.off[1:].astype(np.int32), sizes) - place
        self.sizes = sizes

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the sample and their ranks' fingerprints."""
        ok = self.in_cover[self.inside % self.v] & (self.left >= self.span) & (self.inside + self.left >= self.length)
        places = np.flatnonzero(ok)
        return places, self.hashes[places] >> np.uint64(64 - RANK_BITS - self.bits)

    def _send(self, chunk: int, values: np.ndarray, size: int, kind: type) -> list[tuple]:
        values, times = np.unique(values, return_counts=True)
        edges, many = bounds(values, self.bits, self.bits + size), times > 1
        low = (values & np.uint64((1 << size) - 1)).astype(kind)
        out = []
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[b], edges[b + 1])
            out.append((b, chunk, 0, pack(steps(low[part]), np.packbits(many[part]))))
        return out

    def rank(self, key: tuple, chunk: pa.Table) -> pa.Table:
        self.read(chunk)
        return packets(self._send(key[0].as_py(), self.sample()[1], RANK_BITS, np.uint32))

    def strings(self, places: np.ndarray) -> np.ndarray:
        both = joined(self.hashes[places], self.hashes[places + self.length - self.span])  # they overlap and leave no byte out
        return both >> np.uint64(64 - self.string_bits - self.bits)

    def resolve(self, key: tuple, chunk: pa.Table, ties: pa.Table) -> pa.Table:
        """Sends the suffixes, cut at length, that have a tied rank within v bytes."""
        if not chunk.num_rows or not ties.num_rows:
            return packets([])
        self.read(chunk)
        places, ranks = self.sample()
        known, back = np.unique(ranks, return_inverse=True)
        tied = np.zeros(self.n + 1, np.int32)
        tied[1:][places] = answered(bounds(known, self.bits, RANK_BITS + self.bits), ties)[back]
        np.cumsum(tied, out=tied)
        n = max(0, self.n - self.length + 1)
        able = (self.left[:n] >= self.length) & (tied[self.v : self.v + n] > tied[:n])
        own = (int(key[0].as_py()) % (1 << self.bits), key[0].as_py(), 1, pack(np.packbits(able)))
        return packets([own, *self._send(key[0].as_py(), self.strings(np.flatnonzero(able)), self.string_bits, np.uint64)])

    def remove(self, key: tuple, chunk: pa.Table, repeats: pa.Table) -> pa.Table:
        self.read(chunk)
        gone = np.zeros(self.n, bool)
        kinds = repeats["kind"].to_numpy()
        if (kinds == 1).any():
            flags = unpack(repeats["blob"][int(np.flatnonzero(kinds == 1)[0])].as_py())[0]
            places = np.flatnonzero(np.unpackbits(flags, count=max(0, self.n - self.length + 1)))
            known, back = np.unique(self.strings(places), return_inverse=True)
            start = np.zeros(self.n, bool)
            start[places] = answered(bounds(known, self.bits, self.string_bits + self.bits), repeats.filter(pa.array(kinds == 0)))[back]
            gone = repeats_covered(start, self.length, self.n)
        removed, spans, kept = [], [], []
        raw = self.data.tobytes()
        for i in range(len(self.ids)):
            lo, hi = int(self.off[i]), int(self.off[i + 1])
            out = gone[lo:hi]
            n = int(out.sum())
            removed.append(n)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]]))).tolist() if n else []
            spans.append([{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            kept.append(self.data[lo:hi][~out].tobytes() if n else raw[lo:hi])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": pa.array(self.ids, pa.int64()), "n_bytes": pa.array(self.sizes.astype(np.int64)), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary())})


def sort_bucket(key: tuple, rows: pa.Table) -> pa.Table:
    """Sorts one bucket and answers each chunk: which of its values tie with a neighbour. Rows of kind 1 pass."""
    kinds = rows["kind"].to_numpy()
    own, sent = rows.filter(pa.array(kinds == 1)), rows.filter(pa.array(kinds == 0))
    if not sent.num_rows:
        return own
    parts = [unpack(x) for x in sent["blob"].to_pylist()]
    sizes = [len(p[0]) for p in parts]
    values = np.concatenate([np.cumsum(p[0], dtype=p[0].dtype) for p in parts])
    many = np.concatenate([np.unpackbits(p[1], count=n) for p, n in zip(parts, sizes, strict=True)]).astype(bool)
    order = np.argsort(values)
    at = groups(values[order])
    times = np.diff(np.append(at, len(order)))
    many[order] |= np.repeat(times > 1, times)
    return pa.concat_tables([own, _answers(sent, sizes, many)])


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): without the bytes of strings of length bytes that start anywhere else too."""
    chunks = chunked(docs, id_col, text_col)
    by = Suffixes(length, bucket_bits(docs.sparkSession))
    ranks = chunks.groupBy("chunk").applyInArrow(lambda k, t: by.rank(k, t), PACKET)
    ties = ranks.groupBy("bucket").applyInArrow(lambda k, t: sort_bucket(k, t), PACKET)
    suffixes = chunks.groupBy("chunk").cogroup(ties.groupBy("chunk")).applyInArrow(lambda k, a, b: by.resolve(k, a, b), PACKET)
    repeats = suffixes.groupBy("bucket").applyInArrow(lambda k, t: sort_bucket(k, t), PACKET)
    return chunks.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(lambda k, a, b: by.remove(k, a, b), RESULT)
