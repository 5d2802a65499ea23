"""What the operators share: the checkpoint folder, chunks of documents, and the exchange of packed arrays.

The exact-match operators (word windows, byte windows, token counts) work on *chunks*: about a megabyte of whole
documents, dealt out by a hash of the row. A chunk turns its text into numpy arrays of 64-bit hashes, drops repeats
inside the chunk and sends, for each *bucket* of the hash space, one compressed array. A bucket compares what all chunks
sent and answers each chunk with a bit per value it sent. Text crosses the network once (Spark reuses the exchange),
hashes once, answers are bits; no value, however frequent, comes more than once from a chunk.
"""

from __future__ import annotations

import gc
import struct
import tempfile
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a chunk holds on average.
CHUNK_BYTES = 1 << 20
#: Buckets for each shuffle partition.
BUCKETS_PER_PARTITION = 4
#: Rows of a few numbers that a partition may hold.
PARTITION_ROWS = 100_000


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder of spark.checkpoint.dir. Where that is unset a temporary folder
    does for a local master; a cluster has to name one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint()


def fitted(df: DataFrame, rows: int = PARTITION_ROWS) -> DataFrame:
    """A checkpoint of few narrow rows in as few partitions as they need. A shuffle leaves files for each partition it reads."""
    return df.coalesce(max(1, -(-df.count() // rows)))


def release(spark: SparkSession) -> None:
    """Lets go of shuffles and checkpoints that nothing leads to any more. Spark deletes their files when the driver's JVM finds
    them unreachable, which may otherwise be long after the next steps have written theirs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, rest: bool = False) -> DataFrame:
    """Rows (chunk, doc_id, text), exchanged by chunk; one chunk has about chunk_bytes of text, null text becomes empty. With
    rest a column of that name holds the whole row but for its text."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest")] if rest else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *row)
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    chunks = max(1, -(-int(total) // chunk_bytes))
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk")
    return rows.select(key, *rows.columns).repartition(partitions(docs.sparkSession), "chunk")


def sorted_chunk(table: pa.Table) -> tuple[np.ndarray, list, np.ndarray, np.ndarray]:
    """The rows of a chunk in a fixed order: doc ids (null as the smallest), ids as Python values, bytes, offsets."""
    table = table.take(chunk_order(table))
    ids = table["doc_id"].to_pylist()
    keys = np.array([np.iinfo(np.int64).min if x is None else x for x in ids], dtype=np.int64)
    data, off = utf8(table["text"])
    return keys, ids, data, off


def chunk_order(table: pa.Table) -> pa.Array:
    import pyarrow.compute as pc

    keys = table.select(["doc_id", "text"]).combine_chunks()
    return pc.sort_indices(keys, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: each array's byte planes one after another, compressed. Small values and small steps cost little."""
    planes, kinds = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        kinds.append(f"{a.dtype.str}:{len(a)}")
        planes.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    raw, kind = b"".join(planes), ",".join(kinds).encode()
    return struct.pack("<HQ", len(kind), len(raw)) + kind + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(blob: bytes) -> list[np.ndarray]:
    n, size = struct.unpack_from("<HQ", blob)
    kinds = [x.split(":") for x in blob[10 : 10 + n].decode().split(",")]
    raw = pa.decompress(blob[10 + n :], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    out, at = [], 0
    for kind, count in kinds:
        dtype, count = np.dtype(kind), int(count)
        end = at + count * dtype.itemsize
        out.append(np.frombuffer(raw[at:end], np.uint8).reshape(dtype.itemsize, count).T.copy().view(dtype).reshape(count))
        at = end
    return out


def steps(sorted_values: np.ndarray) -> np.ndarray:
    """Differences of sorted unsigned values, the first from 0."""
    out = sorted_values.copy()
    out[1:] -= sorted_values[:-1]
    return out


def bucket_bits(spark: SparkSession) -> int:
    """There are 2 ** this many buckets, a few for each shuffle partition."""
    return max(1, (BUCKETS_PER_PARTITION * partitions(spark) - 1).bit_length())


def bounds(sorted_values: np.ndarray, bits: int, size: int = 64) -> np.ndarray:
    """Where each bucket of sorted values of size bits begins, and the end: the bucket is in the highest bits."""
    at = np.arange(1 << bits, dtype=np.uint64) << np.uint64(size - bits)
    return np.append(np.searchsorted(sorted_values, at), len(sorted_values))


def answered(edges: np.ndarray, rows: pa.Table) -> np.ndarray:
    """The buckets' answers (bucket, blob) in the order of the sorted values that a chunk has sent."""
    out = np.zeros(int(edges[-1]), bool)
    for b, blob in zip(rows["bucket"].to_pylist(), rows["blob"].to_pylist(), strict=True):
        n = int(edges[b + 1] - edges[b])
        out[edges[b] : edges[b + 1]] = np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)
    return out


#: What goes to buckets and comes back.
PACKET = "bucket int, chunk bigint, kind int, blob binary"


def packets(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "chunk", "kind", "blob"])


def groups(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer for 64-bit hashes: each bit of the input changes half of the output's."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Spans of more bytes are hashed one by one, shorter ones all at once.
LONG_SPAN = 64
_MULTIPLY, _LENGTH = np.uint64(0x9FB21C651E98DF27), np.uint64(0xD1342543DE82EF95)
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; past the end they are 0."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


class Hasher:
    """64-bit hashes of spans of bytes and of windows over a sequence of hashes. Every step is mixed, so no regular sequence
    makes different windows agree, as it can in a polynomial modulo a power of two. Hashers with different seeds are
    independent of each other from the bytes on."""

    def __init__(self, seed: int = 0x9E3779B97F4A7C15) -> None:
        self.seed = np.uint64(seed)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each span [start, end) of bytes: 8 bytes a step, and BLAKE2 for long ones."""
        sizes = ends - starts
        out = mixed(sizes.astype(np.uint64) * _LENGTH + self.seed)
        loads, rest = eights(data), np.flatnonzero(sizes <= LONG_SPAN)
        at, left, state = starts[rest], sizes[rest], out[rest]
        while len(rest):
            state = mixed(state ^ (loads[at] & LOW_BYTES[np.minimum(left, 8)]))
            out[rest] = state
            more = left > 8
            rest, at, left, state = rest[more], at[more] + 8, left[more] - 8, state[more]
        long = np.flatnonzero(sizes > LONG_SPAN)
        if len(long):
            raw, key = memoryview(np.ascontiguousarray(data)), self.seed.tobytes()
            said = b"".join(blake2b(raw[a:b], digest_size=8, key=key).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True))
            out[long] = np.frombuffer(said, np.uint64)
        return out

    def windows(self, values: np.ndarray, width: int) -> np.ndarray:
        """The hash of every width neighbouring values, from hashes of windows of 1, 2, 4, ... of them."""
        n = len(values) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        level, size, out, done = values ^ self.seed, 1, None, 0
        while True:
            if width & size:
                out = level[:n] if out is None else joined(out, level[done : done + n])
                done += size
            if done == width:
                return mixed(out + np.uint64(width))
            level, size = joined(level[:-size], level[size:]), 2 * size

    def byte_windows(self, data: np.ndarray, width: int) -> np.ndarray:
        """The hash of every width neighbouring bytes, from windows of 8 that may overlap."""
        n = len(data) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        if width < 8:
            return mixed((eights(data)[:n] & LOW_BYTES[width]) ^ self.seed)
        level, size = mixed(eights(data)[: len(data) - 7] ^ self.seed), 8
        while 2 * size <= width:
            level, size = joined(level[:-size], level[size:]), 2 * size
        return mixed((level if size == width else joined(level[:n], level[width - size :][:n])) + np.uint64(width))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two neighbours, from theirs."""
    return mixed(left * _MULTIPLY + right)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return _LOWER[data]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words [^\\x20\\x09-\\x0D]+, and for each document the index of its first word (one more at the end)."""
    n = len(data)
    word = ~_SPACE[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def window_room(first: np.ndarray, width: int) -> np.ndarray:
    """For each word, whether a window of that width that starts there stays in its document."""
    counts = np.diff(first)
    left = np.repeat(first[1:], counts) - np.arange(first[-1])
    return left >= width


def repeats_covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places are covered by the windows that start at starts."""
    starts = starts[: max(0, n - width + 1)]
    edge = np.zeros(n + 1, np.int32)
    edge[: len(starts)] += starts.astype(np.int32)
    edge[width : width + len(starts)] -= starts.astype(np.int32)
    return np.cumsum(edge[:n]) > 0
