"""N-gram Jaccard join by universe partition, pigeonhole and one-deletion neighbourhoods.

A document is its set of distinct word n-grams. Equal sets are one record from the start. Records fall into bands of
sizes, each 1 / threshold wide, so partners are in one band or in neighbours. Two linked records of a band differ in at
most H n-grams; the hash space is cut into H + 1 segments, so some segment is equal in both. Every record indexes the
signature of each of its segments for its own band, and of the first few segments also all their one-deletion
neighbourhoods. It probes its own band and the next one. Probing a segment costs what it sends and what it matches, which
differs a lot: segments without an n-gram, with a common one, or of a passage that many share match many strangers. So a
first pass counts the index's signatures over all documents in a table of fixed size, and a probe allocates by these costs:
it skips its dearest segments, and for each one raises the cheapest that it can to distance one (equal, or one n-gram more or
less on either side), as long as that saves something. The sum of the pigeonhole argument stays H + 1.

Signatures meet in buckets as packed arrays. Records with a common signature are a group; groups are sets of candidates.
Each record joins the clusters of two leaders, the one it shares most groups with and the one that most share with, and all
pairs of a cluster are compared at once. Then all pairs that have a signature in common and are neither in one cluster nor in
one component are compared, in tiles of their group. Both go in two steps. First sizes, and the parities of the n-grams' places in a table,
a few bits for each n-gram, prove most pairs to differ too much. Then the texts of records that have a partner left, and no
others, are sent and compared whole: clusters as a product of matrices, of which only joining links come back.

Sets are equal if two hashes of them are, 128 bits together: records with one id but another second hash get ids of their own.

Null texts, and texts without a word, have an empty set and link with nothing. Texts with fewer words than n are one
n-gram, the whole sequence. Repeated rows are equal sets. Null ids are smaller than none: a component's id is its smallest
id that is not null. An empty table gives an empty result; extra columns are ignored by classes() and kept by dedup_docs(),
whatever their names. A document must fit in a task's memory about 60 times over; there is no other limit to its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Hasher, bounds, cut, groups, lowered, mixed, pack, partitions, release, steps, unpack, utf8, window_room, word_spans
from .components import components
from .quality import slices

N, PERCENT = 5, 80
SLICE_BYTES = 4 << 20
SIG_BITS = 32
#: One in so many segments has its one-deletion neighbourhoods indexed, for probes to raise, but some of a few.
RAISED, SOME = 16, 3
#: The table of costs has 2 ** COST_BITS counters; so many tables are added up in one task.
COST_BITS, FAN_IN = 20, 16
#: Signatures of segments with more n-grams are not counted: strangers hardly ever agree in them.
LIGHT = 3
#: Bytes of parities that are broadcast; more are joined by a shuffle of the pairs.
BROADCAST_BYTES = 32 << 20
#: Members of a group in one row.
ROW_MEMBERS = 4096
#: Members of a cluster that are compared at once with each other, or with as many; columns of the matrix at a time.
TILE, COLUMNS = 512, 8192
#: Members of a group whose short parities are compared at once with each other, or with as many.
WIDE_TILE = 8192
#: Ids of texts to compare are broadcast up to so many (of 16 bytes each); more are joined by a shuffle of the texts.
BROADCAST_ROWS = 250_000
#: Longs in the short table of parities that every record carries.
SHORT = 8
_NEAR = np.uint64(0x5851F42D4C957F2D)
_COUNT = np.uint64(0xD6E8FEB86659FD93)
_SECOND = np.uint64(0xA0761D6478BD642F)


def record_sets(data: np.ndarray, off: np.ndarray, hasher: Hasher, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text as sorted hashes, one text after another, and their offsets."""
    data = lowered(data)
    starts, ends, first = word_spans(data, off)
    counts = np.diff(first)
    values = hasher.spans(data, starts, ends)
    grams = hasher.windows(values, n)
    out, edge = [], np.zeros(len(off), np.int64)
    for i, (lo, words) in enumerate(zip(first[:-1].tolist(), counts.tolist(), strict=True)):
        if words >= n:
            out.append(np.unique(grams[lo : lo + words - n + 1]))
        elif words:
            out.append(~hasher.windows(values[lo : lo + words], words))
        edge[i + 1] = edge[i] + (len(out[-1]) if words else 0)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), edge


def record_ids(sets: np.ndarray, edge: np.ndarray, seed: np.uint64 = _NEAR) -> np.ndarray:
    """A 64-bit hash of each set."""
    total = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(mixed(sets ^ seed), out=total[1:])
    return mixed(total[edge[1:]] - total[edge[:-1]] + np.diff(edge).astype(np.uint64) * _COUNT).view(np.int64)


def second_ids(sets: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Another hash of each set."""
    return record_ids(sets, edge, _SECOND)


def told_apart(ids: np.ndarray, second: np.ndarray, clashes: np.ndarray) -> np.ndarray:
    """The ids, with the second hash worked into those that different sets share."""
    return np.where(np.isin(ids, clashes), ids ^ mixed(second.view(np.uint64)).view(np.int64), ids) if len(clashes) else ids


class Bands:
    """Bands of set sizes and the number of segments in each."""

    def __init__(self, percent: int, largest: int) -> None:
        low = [1]
        while low[-1] <= largest:
            low.append(low[-1] * 100 // percent + 1)
        low.append(low[-1] * 100 // percent + 1)
        self.low = np.array(low)
        most = self.low[1:] - 1
        # 100 * common >= percent * union, for sizes a and b, means a difference of at most (100 - percent) (a + b) / (100 + percent)
        self.segments = (100 - percent) * 2 * most // (100 + percent) + 1
        self.raised = np.where(self.segments > 1, np.maximum(self.segments // RAISED, np.minimum(self.segments, SOME)), 0)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, "right") - 1


INDEX, PROBE = 1, 2


def signatures(sets: np.ndarray, edge: np.ndarray, band: np.ndarray, bands: Bands, own: bool, costs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | np.ndarray:
    """(record, signature, roles) of each record for a band: its own, or the next one, which it only probes. costs: how many
    records index a light signature, by its highest bits; without, only the light ones that are indexed are returned."""
    sizes = np.diff(edge)
    m = bands.segments[band]
    base = np.concatenate([[0], np.cumsum(m)])
    total = int(base[-1])
    rec = np.repeat(np.arange(len(sizes)), sizes)
    seg = ((sets >> np.uint64(32)) * m.astype(np.uint64)[rec] >> np.uint64(32)).astype(np.int64) + base[rec]
    held = np.bincount(seg, minlength=total)
    end = np.cumsum(held)
    value = mixed(sets)
    run = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(value, out=run[1:])
    sums = run[end] - run[end - held]
    owner = np.repeat(np.arange(len(sizes)), m)
    nth = np.arange(total) - base[owner]
    place = mixed((band[owner].astype(np.uint64) << np.uint64(40)) + nth.astype(np.uint64) + np.uint64(1))
    sig = lambda at, s, c: mixed(s + c.astype(np.uint64) * _COUNT + place[at])
    able = nth < bands.raised[band][owner]
    every, t = np.arange(total), np.flatnonzero(able[seg])
    exact, at = sig(every, sums, held), seg[t]
    less = sig(at, sums[at] - value[t], held[at] - 1)
    # allocation: the nth dearest segment is skipped if the nth cheapest of those that can be raised costs less to raise
    if costs is None:
        return np.concatenate([exact[held <= LIGHT], (less ^ _NEAR)[held[at] <= LIGHT + 1]])
    met = lambda s, light: np.where(light, costs[(s >> np.uint64(64 - COST_BITS)).astype(np.int64)], 0.0)
    saved = 1 + met(exact, held <= LIGHT)
    price = 1 + held + met(exact ^ _NEAR, held <= LIGHT) + np.bincount(at, met(less, held[at] <= LIGHT + 1), total)
    skips, raises = np.flatnonzero(~able), np.flatnonzero(able)
    skips, raises = skips[np.lexsort((-saved[skips], owner[skips]))], raises[np.lexsort((price[raises], owner[raises]))]
    rank = lambda x: np.arange(len(x)) - np.searchsorted(owner[x], owner[x])
    best = np.full((2, len(sizes), int(bands.raised[band].max(initial=0)) + 1), [[[0.0]], [[np.inf]]])
    for row, x, worth in zip(best, (skips, raises), (saved, price), strict=True):
        fits = rank(x) < row.shape[1]
        row[owner[x][fits], rank(x)[fits]] = worth[x][fits]
    pays = (best[0] > best[1]).sum(axis=1)
    skipped, raised = np.zeros(total, bool), np.zeros(total, bool)
    skipped[skips[rank(skips) < pays[owner[skips]]]] = True
    raised[raises[rank(raises) < pays[owner[raises]]]] = True
    roles = np.where(skipped, 0, PROBE) | (INDEX if own else 0)
    out = [(owner[roles > 0], exact[roles > 0], roles[roles > 0]), (owner[raised], exact[raised] ^ _NEAR, np.full(int(raised.sum()), PROBE))]
    up = raised[at]
    out.append((owner[at[up]], less[up], np.full(int(up.sum()), PROBE)))
    if own:
        out.append((owner[at], less ^ _NEAR, np.full(len(at), INDEX)))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def match(key: tuple, rows: pa.Table) -> pa.Table:
    """Groups of records with one signature, at least one of which probes and another one indexes. Equal groups give one row."""
    fps, recs, roles = [], [], []
    for blob in rows["blob"].to_pylist():
        low, which, role, ids = unpack(blob)
        fps.append(np.cumsum(low, dtype=np.uint32)), recs.append(ids[which]), roles.append(role)
    fps, recs, roles = np.concatenate(fps), np.concatenate(recs), np.concatenate(roles)
    times = np.bincount(np.searchsorted(u := np.unique(fps), fps), minlength=len(u))
    shared = times[np.searchsorted(u, fps)] > 1
    fps, recs, roles = fps[shared], recs[shared], roles[shared]
    order = np.lexsort((recs, fps))
    fps, recs, roles = fps[order], recs[order], roles[order]
    if len(fps):
        at = np.flatnonzero(np.append(True, (fps[1:] != fps[:-1]) | (recs[1:] != recs[:-1])))
        fps, recs, roles = fps[at], recs[at], np.bitwise_or.reduceat(roles, at)
    at = groups(fps)
    size = np.diff(np.append(at, len(fps)))
    probing = np.add.reduceat((roles & PROBE > 0).astype(np.int64), at) if len(at) else size
    indexed = np.add.reduceat((roles & INDEX > 0).astype(np.int64), at) if len(at) else size
    seen: dict[bytes, list] = {}
    for i in np.flatnonzero((size > 1) & (probing > 0) & (indexed > 0)).tolist():
        part = slice(at[i], at[i] + size[i])
        name = recs[part].tobytes() + (roles[part] & PROBE).tobytes()
        got = seen.setdefault(name, [0, part])
        got[0] += 1
    out = []
    for times, part in seen.values():
        own, probe = recs[part], roles[part] & PROBE > 0
        grp, check = np.frombuffer(blake2b(own.tobytes() + probe.tobytes(), digest_size=16).digest(), np.int64).tolist()
        for lo in range(0, len(own), ROW_MEMBERS):
            out.append((grp, check, lo, times, own[lo : lo + ROW_MEMBERS], probe[lo : lo + ROW_MEMBERS]))
    cols = list(zip(*out, strict=True)) or [()] * 6
    kinds = (*[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.bool_()))
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["grp", "check", "part", "times", "recs", "probes"])


def _compare(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                texts = [pa.decompress(z, decompressed_size=int(s), codec="zstd", asbytes=True) for z, s in zip(batch.column("za").to_pylist() + batch.column("zb").to_pylist(), batch.column("sa").to_pylist() + batch.column("sb").to_pylist(), strict=True)]
                data, off = utf8(pa.array(texts, pa.binary()))
                sets, edge = record_sets(data, off, hasher, n)
                k, ok = batch.num_rows, []
                for i in range(k):
                    a, b = sets[edge[i] : edge[i + 1]], sets[edge[k + i] : edge[k + i + 1]]
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    ok.append(100 * common >= percent * (len(a) + len(b) - common))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def parities(sets: np.ndarray, edge: np.ndarray) -> list[bytes]:
    """For each set a bit for every place of a table of at least twice its size: whether an odd number of its n-grams falls there."""
    out = []
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        bits = max(8, (2 * (hi - lo)).bit_length())
        at = (mixed(sets[lo:hi]) >> np.uint64(64 - bits)).astype(np.int64)
        out.append(np.packbits(np.bincount(at, minlength=1 << bits) & 1 > 0).tobytes())
    return out


def _apart(x: bytes, y: bytes) -> int:
    """At most the number of n-grams that only one of two sets holds: n-grams of both cancel out in the parities."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        wide = np.unpackbits(a).reshape(8 * len(b), -1)
        a = np.packbits(wide.sum(axis=1) & 1)
    return int(np.bitwise_count(a ^ b).sum())


def short_parities(sets: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """As parities(), in a table of SHORT longs, one row for each set."""
    bits = 64 * SHORT
    owner = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    at = (mixed(sets) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(owner * bits + at, minlength=(len(edge) - 1) * bits) & 1 > 0
    return np.packbits(odd.reshape(-1, bits), axis=1).view(np.int64).reshape(-1, SHORT)


def _partnered(sizes: np.ndarray, odd: list[bytes], percent: int) -> np.ndarray:
    """Which sets may be linked with another one of them, judged by sizes and parities; none that is linked is missed."""
    out, width = np.zeros(len(sizes), bool), np.array([len(x) for x in odd])
    kinds = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
    tables = {w: np.frombuffer(b"".join(odd[i] for i in at), np.uint8).reshape(len(at), w) for w, at in kinds.items()}
    for w, own in kinds.items():
        for v, other in kinds.items():
            if v < w or 100 * sizes[own].max() < percent * sizes[other].min():
                continue
            table = tables[v]
            if v > w:  # the larger table is folded
                table = np.packbits(np.unpackbits(table, axis=1).reshape(len(other), 8 * w, -1).sum(axis=2) & 1, axis=1)
            longs, rows = np.ascontiguousarray(table).view(np.uint64), np.ascontiguousarray(tables[w]).view(np.uint64)
            for i, row in zip(own.tolist(), rows, strict=True):
                apart = np.bitwise_count(longs ^ row).sum(axis=1, dtype=np.int64)
                fits = ((100 + percent) * apart <= (100 - percent) * (sizes[other] + sizes[i])) & (other != i)
                if fits.any():
                    out[i] = True
                    out[other[fits]] = True
    return out


def _maybe(percent: int):
    """Keeps the pairs that may be linked, judged by sizes and parities; none that is linked goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            apart = np.array([_apart(x, y) for x, y in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), strict=True)], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * apart <= (100 - percent) * size))

    return run


_SHORT = [f"f{i}" for i in range(SHORT)]


def records(docs: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, draw, rec, second, n_shingles, odd, f0, f1, ...): draw is a hash of the row, rec and second are hashes of the
    set, rec null for empty ones, the others are parities() and short_parities()."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("draw"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for lo, hi in slices(off):
                sets, edge = record_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], hasher, n)
                sizes = np.diff(edge)
                short = short_parities(sets, edge)
                cols = [batch.column("doc_id").slice(lo, hi - lo), batch.column("draw").slice(lo, hi - lo), pa.array(record_ids(sets, edge), mask=sizes == 0), pa.array(second_ids(sets, edge)), pa.array(sizes), pa.array(parities(sets, edge), pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(short[:, i]) for i in range(SHORT))], names=["doc_id", "draw", "rec", "second", "n_shingles", "odd", *_SHORT])

    return rows.mapInArrow(run, "doc_id bigint, draw bigint, rec bigint, second bigint, n_shingles bigint, odd binary, " + ", ".join(f"{f} bigint" for f in _SHORT))


def _distinct_sets(batches: Iterator[pa.RecordBatch], n: int, clashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sets, offsets, ids) of the different non-empty sets of each slice of texts."""
    hasher = Hasher()
    for batch in batches:
        data, off = utf8(batch.column(0))
        for lo, hi in slices(off, SLICE_BYTES):
            sets, edge = record_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], hasher, n)
            ids, sizes = told_apart(record_ids(sets, edge), second_ids(sets, edge), clashes), np.diff(edge)
            _, first = np.unique(ids, return_index=True)
            picked = np.zeros(len(ids), bool)
            picked[first[sizes[first] > 0]] = True
            if picked.any():
                yield sets[np.repeat(picked, sizes)], np.concatenate([[0], np.cumsum(sizes[picked])]), ids[picked]


def index_costs(texts: DataFrame, bands: Bands, n: int, clashes: np.ndarray) -> np.ndarray:
    """How many records index the signatures of each counter of the table, less the mean, which is chance."""
    none = np.zeros(1 << COST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(1 << COST_BITS, np.int64)
        for sets, edge, _ in _distinct_sets(batches, n, clashes):
            light = signatures(sets, edge, bands.of(np.diff(edge)), bands, True, None)
            counts += np.bincount((light >> np.uint64(64 - COST_BITS)).astype(np.int64), minlength=len(counts))
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pack(counts)], pa.binary())], names=["part", "blob"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        counts = np.zeros(1 << COST_BITS, np.int64)
        for blob in rows["blob"]:
            counts += unpack(blob.as_py())[0]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([pack(counts)], pa.binary())})

    parts, left = texts.mapInArrow(run, "part bigint, blob binary"), max(2, texts.rdd.getNumPartitions())
    while left > 1:
        parts = parts.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part").applyInArrow(add, "part bigint, blob binary")
        left = -(-left // FAN_IN)
    got = parts.select("blob").head()
    if not got:
        return none
    counts = unpack(bytes(got.blob))[0]
    return np.maximum(0.0, counts - counts.mean())


def candidate_groups(docs: DataFrame, largest: int, n: int, percent: int, text_col: str, clashes: np.ndarray) -> DataFrame:
    """(grp, part, times, recs, probes): groups of records with a common signature, each different group once."""
    bands, parts = Bands(percent, largest), partitions(docs.sparkSession)
    bits = max(1, (parts - 1).bit_length())
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    costs = index_costs(texts, bands, n, clashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets, edge, ids in _distinct_sets(batches, n, clashes):
            band = bands.of(np.diff(edge))
            both = [signatures(sets, edge, band, bands, True, costs), signatures(sets, edge, band + 1, bands, False, costs)]
            rec, sig, role = (np.concatenate([x[i] for x in both]) for i in range(3))
            sig >>= np.uint64(64 - SIG_BITS - bits)
            order = np.argsort(sig)
            rec, sig, role = rec[order], sig[order], role[order].astype(np.uint8)
            cuts = bounds(sig, bits, SIG_BITS + bits)
            low = (sig & np.uint64((1 << SIG_BITS) - 1)).astype(np.uint32)
            buckets = np.flatnonzero(np.diff(cuts)).tolist()
            blobs = []
            for b in buckets:
                part = slice(cuts[b], cuts[b + 1])
                used, which = np.unique(rec[part], return_inverse=True)
                blobs.append(pack(steps(low[part]), which.astype(np.uint32), role[part], ids[used]))
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    sent = texts.mapInArrow(run, "bucket int, blob binary")
    found = sent.groupBy("bucket").applyInArrow(lambda k, t: match(k, t), "grp bigint, check bigint, part bigint, times bigint, recs array<bigint>, probes array<boolean>")
    # equal groups are told by 128 bits; different ones with one grp are compared as one group, which loses nothing
    return found.groupBy("grp", "check", "part").agg(F.sum("times").alias("times"), F.first("recs").alias("recs"), F.first("probes").alias("probes"))


def _links_of(texts: list[bytes], hasher: Hasher, n: int, percent: int) -> list[tuple[int, int]]:
    """Pairs of texts that are linked, as many as join what the links join: all intersections come from one product of
    the matrix of texts and of the n-grams that two or more of them hold."""
    data, off = utf8(pa.array(texts, pa.binary()))
    sets, edge = record_sets(data, off, hasher, n)
    sizes = np.diff(edge)
    grams, column, times = np.unique(sets, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(texts)), sizes)
    shared = times[column] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    common, width = np.zeros((len(texts), len(texts)), np.float32), int((times > 1).sum())
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, width, COLUMNS):
        at = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
        held = np.zeros((len(texts), min(COLUMNS, width - lo)), np.float32)
        held[owner[at], column[at] - lo] = 1
        common += held @ held.T
    union = sizes[:, None] + sizes[None, :] - common
    a, b = np.nonzero(np.triu((100 * common >= percent * union) & (union > 0), 1))
    root, out = list(range(len(texts))), []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = x, y
        while root[p] != p:
            root[p] = p = root[root[p]]
        while root[q] != q:
            root[q] = q = root[root[q]]
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _content(docs: DataFrame, owned: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rec, z, s): a compressed text of each wanted record and its size. Other texts aren't sent."""
    draws = cut(owned.join(wanted, "rec").groupBy("rec").agg(F.min(F.struct("draw", "doc_id")).alias("m")).select("rec", F.col("m.draw").alias("draw"), F.col("m.doc_id").alias("of")))
    if draws.count() <= BROADCAST_ROWS:
        draws = F.broadcast(draws)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("draw"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("rec"), pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64())], names=["rec", "z", "s"])

    return texts.join(draws, "draw").where(F.col("id").eqNullSafe(F.col("of"))).select("rec", "text").mapInArrow(zipped, "rec bigint, z binary, s bigint").dropDuplicates(["rec"])


def _dealt(placed: DataFrame, size: int) -> DataFrame:
    """placed, of (cluster, rec, ...), with tile and place: small clusters share places, pairs of tiles of large ones have their own."""
    tiles = placed.groupBy("cluster").agg(F.ceil(F.count("*") / size).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("rec", F.lit(5)), F.col("tiles")).cast("int")
    bin_ = F.pmod(F.xxhash64("cluster"), F.lit(max(1, placed.count() // size)))
    small = F.array(F.concat(F.lit("small/"), bin_.cast("string")))
    large = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.concat_ws("/", F.col("cluster").cast("string"), F.least(o, tile).cast("string"), F.greatest(o, tile).cast("string")))
    return placed.join(tiles, "cluster").select(*placed.columns, tile.alias("tile"), F.explode(F.when(F.col("tiles") == 1, small).otherwise(large)).alias("place"))


def _open_pairs(key: tuple, rows: pa.Table, percent: int) -> pa.Table:
    """The pairs of each cluster, one of which probes, in neither one component nor one home, that sizes and short parities
    leave open. A place of two tiles compares those of one with those of the other."""
    column = lambda name: rows[name].to_numpy()
    cluster, rec, size, tile, component = (column(c) for c in ("cluster", "rec", "n", "tile", "component"))
    probe, homes = rows["probe"].to_numpy(zero_copy_only=False), [set(x) for x in rows["homes"].to_pylist()]
    short = np.column_stack([column(f) for f in _SHORT]).view(np.uint64)
    place = key[0].as_py().split("/")
    apart_tiles = len(place) == 3 and place[1] != place[2]
    order, out = np.argsort(cluster, kind="stable"), []
    at = np.append(groups(cluster[order]), len(order))
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = order[lo:hi]
        for k, i in enumerate(own.tolist()):
            other = own[k + 1 :]
            other = other[(component[other] != component[i]) & (probe[other] | probe[i]) & (100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i]))]
            if apart_tiles:
                other = other[tile[other] != tile[i]]
            apart = np.bitwise_count(short[other] ^ short[i]).sum(axis=1, dtype=np.int64)
            other = other[(100 + percent) * apart <= (100 - percent) * (size[other] + size[i])]
            out += [(min(rec[i], rec[j]), max(rec[i], rec[j])) for j in other.tolist() if rec[i] != rec[j] and homes[i].isdisjoint(homes[j])]
    out = sorted(set(out))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _renamed(owned: DataFrame, clashes: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rec = batch.column("rec")
            ids = told_apart(rec.fill_null(0).to_numpy(), batch.column("second").to_numpy(), clashes)
            yield batch.set_column(batch.schema.get_field_index("rec"), "rec", pa.array(ids, mask=rec.is_null().to_numpy(zero_copy_only=False)))

    return owned.mapInArrow(run, owned.schema)


def joined_records(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """records() with component, the smallest record that links lead to; null for empty sets."""
    owned = cut(records(docs, n, id_col, text_col))
    largest = owned.agg(F.max("n_shingles")).first()[0] or 0
    twice = owned.where("rec is not null").groupBy("rec").agg(F.min("second").alias("low"), F.max("second").alias("high")).where("low <> high").select("rec")
    # among billions of sets a handful share an id by chance
    clashes = np.array([r.rec for r in twice.collect()], np.int64)
    if len(clashes):
        owned = cut(_renamed(owned, clashes))
    found = cut(candidate_groups(docs, largest, n, percent, text_col, clashes))
    members = found.select("grp", "times", F.size("recs").alias("size"), F.explode(F.arrays_zip("recs", "probes")).alias("m")).select("grp", "times", "size", F.col("m.recs").alias("rec"), F.col("m.probes").alias("probe"))
    # who is in the largest and the most groups leads them: of a family of copies, the one that was copied
    weight = members.groupBy("rec").agg(F.sum(F.col("times") * F.col("size")).alias("weight"))
    ranked = members.join(weight, "rec")
    leads = ranked.groupBy("grp").agg(F.max(F.struct("weight", "rec")).alias("lead"))
    members = cut(ranked.join(leads, "grp").select("grp", F.col("lead.rec").alias("lead"), F.col("lead.weight").alias("weight"), "times", "rec", "probe"))
    del found, ranked, weight, leads
    release(docs.sparkSession)  # the groups' shuffles
    traits = owned.join(members.select("rec").distinct(), "rec", "left_semi").select("rec", F.col("n_shingles").alias("n"), "odd", *_SHORT)
    traits = cut(traits.dropDuplicates(["rec"]))

    # every record with the leader it shares most groups with, and the leaders themselves: all pairs of such a cluster are
    # compared in one place, in pairs of tiles if it is large; first by parities, then the texts that are left
    met = members.where("rec <> lead").groupBy("rec", "lead").agg(F.sum("times").alias("times"), F.max("weight").alias("weight"))
    heavy = F.struct((F.col("times") * F.col("weight").cast("double")).alias("w"), "lead")
    best = met.groupBy("rec").agg(F.max_by("lead", F.struct("times", "lead")).alias("near"), F.max_by("lead", heavy).alias("heavy"))
    placed = best.select("rec", F.explode(F.array_distinct(F.array("near", "heavy"))).alias("cluster"))
    placed = cut(placed.unionByName(placed.select(F.col("cluster").alias("rec"), "cluster")).distinct())
    homes = placed.groupBy("rec").agg(F.collect_set("cluster").alias("homes"))

    def possible(key: tuple, rows: pa.Table) -> pa.Table:
        cluster, size, odd = rows["cluster"].to_numpy(), rows["n"].to_numpy(), rows["odd"].to_pylist()
        order = np.argsort(cluster, kind="stable")
        at, kept = np.append(groups(cluster[order]), len(order)), np.zeros(len(order), bool)
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = order[lo:hi]
            kept[own] = _partnered(size[own], [odd[i] for i in own.tolist()], percent)
        return rows.select(["cluster", "rec"]).filter(pa.array(kept))

    left = _dealt(placed, TILE).select("cluster", "rec", "place").join(traits.select("rec", "n", "odd"), "rec").groupBy("place").applyInArrow(possible, "cluster bigint, rec bigint")
    left = cut(left.distinct())

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        hasher, cluster, rec = Hasher(), rows["cluster"].to_numpy(), rows["rec"].to_numpy()
        order, out = np.argsort(cluster, kind="stable"), []
        at = np.append(groups(cluster[order]), len(order))
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = rows.take(pa.array(order[lo:hi]))
            raw = [pa.decompress(z, decompressed_size=s, codec="zstd", asbytes=True) for z, s in zip(own["z"].to_pylist(), own["s"].to_pylist(), strict=True)]
            out += [(int(rec[order[lo + x]]), int(rec[order[lo + y]])) for x, y in _links_of(raw, hasher, n, percent)]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    content = cut(_content(docs, owned, left.select("rec").distinct(), id_col, text_col))
    sure = cut(_dealt(left, TILE).join(content, "rec").groupBy("place").applyInArrow(compare, "a bigint, b bigint"))
    del content, left
    release(docs.sparkSession)  # the texts that were compared
    near = components(sure)
    # what is left: pairs with a common signature in neither one cluster nor one component
    label = members.join(near.withColumnRenamed("node", "rec"), "rec", "left").withColumn("component", F.coalesce("component", "rec"))
    open_ = label.groupBy("grp").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("grp")
    rest = label.join(open_, "grp").select(F.col("grp").alias("cluster"), "rec", "probe", "component").distinct().join(homes, "rec", "left")
    # a record that leads its groups and is chosen by none has no home, and is compared with all its groups
    rest = cut(rest.withColumn("homes", F.coalesce("homes", F.array().cast("array<bigint>"))))
    dealt = _dealt(rest, WIDE_TILE).join(traits.select("rec", "n", *_SHORT), "rec")
    cross = dealt.groupBy("place").applyInArrow(lambda k, t: _open_pairs(k, t, percent), "a bigint, b bigint").distinct()
    cross = cut(cross)
    del label, rest, dealt, members
    release(docs.sparkSession)  # open groups
    sets = cut(traits.join(cross.select(F.explode(F.array("a", "b")).alias("rec")).distinct(), "rec").select("rec", "n", "odd"))
    few = (sets.agg(F.sum(F.octet_length("odd") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    a, b = (sets.select(F.col("rec").alias(x), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"p{x}")) for x in "ab")
    both = cross.join(F.broadcast(a), "a").join(F.broadcast(b), "b") if few else cross.join(a, "a").join(b, "b")
    cross = cut(both.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(_maybe(percent), "a bigint, b bigint"))
    content = cut(_content(docs, owned, cross.select(F.explode(F.array("a", "b")).alias("rec")).distinct(), id_col, text_col))
    a = content.select(F.col("rec").alias("a"), F.col("z").alias("za"), F.col("s").alias("sa"))
    b = content.select(F.col("rec").alias("b"), F.col("z").alias("zb"), F.col("s").alias("sb"))
    both = cross.join(a, "a").join(b, "b")
    links = sure.unionByName(both.select("a", "b", "za", "sa", "zb", "sb").mapInArrow(_compare(n, percent), "a bigint, b bigint"))
    joined = components(links)
    owned = owned.select("doc_id", "draw", "rec", "n_shingles")
    return owned.join(joined.withColumnRenamed("node", "rec"), "rec", "left").withColumn("component", F.coalesce("component", "rec"))


def classes(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): documents whose sets have a Jaccard similarity of percent / 100 or more are linked."""
    owned = joined_records(docs, n, percent, id_col, text_col)
    least = owned.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    out = owned.join(least, "component", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def dedup_docs(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that with the smallest id, and all rows without a word; columns unchanged. Text is shuffled once."""
    owned = cut(joined_records(docs, n, percent, id_col, text_col))
    first = owned.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "draw")).alias("m"))
    kept = first.select("m.draw", F.col("m.doc_id").alias("of"), F.lit(True).alias("one")).distinct()
    empty = owned.where("component is null").select("draw", F.col("doc_id").alias("of"), F.lit(False).alias("one")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("draw"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("draw", "id").orderBy("draw")))
    return rows.join(kept.unionByName(empty), "draw").where(F.col("id").eqNullSafe(F.col("of")) & ((F.col("nth") == 1) | ~F.col("one"))).select("row.*")
