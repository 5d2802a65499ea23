"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of some 64 kB, each with the number of units, characters and bytes before
it. A unit is a run of ASCII letters or any other single character. The two cuts of a document fall at units drawn from a
hash of its id; to find one, the cumulative counts name the frame and that one frame alone is decompressed. The transformed
text is written as frames again, part after part, and digests read frames in order; so neither a text nor its transformed form is
ever whole in memory but where it comes in and as long as it takes to compress it.

Null texts count as empty: no unit, form plain. Null ids hash as the word null. Repeated rows give a row each, alike. Texts that
hold a marker, at any length, stay plain. An empty table gives an empty result. Extra columns are kept by frames() but for its own
output names, which win, and by texts(). A document must fit in a task's memory a few times over; there is no other limit to its length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import utf8
from .quality import slices

FRAME_BYTES = 1 << 16
#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
FRAMES = "array<struct<units: bigint, chars: bigint, start: bigint, within: boolean, blob: binary>>"
_FIELDS = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("start", pa.int64()), ("within", pa.bool_()), ("blob", pa.binary())])
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def marks(data: np.ndarray, within: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Where units and where characters begin in UTF-8 bytes; within says that a letter stands right before them."""
    letter, lead = _LETTER[data], (data & 0xC0) != 0x80
    follows = np.append(within, letter[:-1])[: len(letter)]
    return lead & ~(letter & follows), lead


class Writer:
    """Takes bytes, whole characters at a time or not, and gives frames with their cumulative counts."""

    def __init__(self, frame_bytes: int = FRAME_BYTES) -> None:
        self.size, self.press = frame_bytes, zstandard.ZstdCompressor(level=1)
        self.start()

    def start(self) -> None:
        self.frames, self.units, self.chars, self.bytes, self.within, self.rest = [], 0, 0, 0, False, b""

    def write(self, data: bytes) -> None:
        data = self.rest + data if self.rest else data
        at = 0
        while len(data) - at >= self.size + 4:  # 4 more, for a character at the edge to be whole
            end = at + self.size
            while data[end] & 0xC0 == 0x80:
                end -= 1
            self._frame(data[at:end])
            at = end
        self.rest = data[at:]

    def _frame(self, data: bytes) -> None:
        self.frames.append((self.units, self.chars, self.bytes, self.within, self.press.compress(data)))
        unit, lead = marks(np.frombuffer(data, np.uint8), self.within)
        self.units += int(np.count_nonzero(unit))
        self.chars += int(np.count_nonzero(lead))
        self.bytes += len(data)
        self.within = bool(_LETTER[data[-1]])

    def end(self) -> list[tuple]:
        if self.rest:
            self._frame(self.rest)
        return self.frames


class Reader:
    """Reads the frames of one text."""

    def __init__(self, frames: list[dict], units: int, chars: int, size: int, press: zstandard.ZstdDecompressor) -> None:
        self.frames, self.units, self.chars, self.size, self.press = frames, units, chars, size, press

    def frame(self, i: int) -> bytes:
        return self.press.decompress(self.frames[i]["blob"])

    def locate(self, unit: int) -> tuple[int, int]:
        """The byte and the character where a unit begins; the end for the number of units. Decompresses one frame."""
        if unit >= self.units:
            return self.size, self.chars
        i = bisect_right(self.frames, unit, key=lambda f: f["units"]) - 1
        begins, lead = marks(np.frombuffer(self.frame(i), np.uint8), self.frames[i]["within"])
        at = int(np.flatnonzero(begins)[unit - self.frames[i]["units"]])
        return self.frames[i]["start"] + at, self.frames[i]["chars"] + int(np.count_nonzero(lead[:at]))

    def stream(self, start: int = 0, end: int | None = None) -> Iterator[bytes]:
        """The bytes from start to end, a frame at a time."""
        end = self.size if end is None else end
        i = max(0, bisect_right(self.frames, start, key=lambda f: f["start"]) - 1)
        while start < end:
            first = self.frames[i]["start"]
            data = self.frame(i)[start - first : end - first]
            yield data
            start, i = start + len(data), i + 1

    def find(self, marker: bytes, start: int) -> int:
        """Where a marker first stands from a byte on; it may lie across frames."""
        at, tail = start, b""
        for data in self.stream(start):
            found = (tail + data).find(marker)
            if found >= 0:
                return at - len(tail) + found
            at, tail = at + len(data), (tail + data)[1 - len(marker) :]
        raise ValueError("no marker")


def _framed(all_frames: list[list[tuple]]) -> pa.Array:
    flat = [f for frames in all_frames for f in frames]
    cols = list(zip(*flat, strict=True)) or [()] * 5
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FIELDS, strict=True)], fields=list(_FIELDS))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, all_frames)]), pa.int32()), values)


def frames(docs: DataFrame, text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """docs with frames, units, chars, size (bytes) and marked (a marker stands in the text) instead of the text: a table
    that can be written and whose texts can be entered anywhere."""
    own = ("frames", "units", "chars", "size", "marked")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own and c != text_col], F.col(text_col).cast("string").alias(text_col))
    kept = [f for f in rows.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, *T.StructType.fromDDL(f"frames {FRAMES}, units bigint, chars bigint, size bigint, marked boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(frame_bytes)
        for batch in batches:
            data, off = utf8(batch.column(text_col))
            for lo, hi in slices(off):
                raw, out, counts, marked = data[off[lo] : off[hi]].tobytes(), [], [], []
                for a, b in zip((off[lo:hi] - off[lo]).tolist(), (off[lo + 1 : hi + 1] - off[lo]).tolist(), strict=True):
                    text = raw[a:b]
                    writer.start()
                    writer.write(text)
                    out.append(writer.end())
                    counts.append((writer.units, writer.chars, writer.bytes))
                    marked.append(any(m in text for m in (PREFIX, SUFFIX, MIDDLE)))
                columns = [batch.column(f.name).slice(lo, hi - lo) for f in kept]
                numbers = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, _framed(out), *numbers, pa.array(marked, pa.bool_())], names=schema.names)

    return rows.mapInArrow(run, schema)


def texts(framed: DataFrame, text_col: str = "text") -> DataFrame:
    """framed with the texts again instead of the frames."""
    kept = [f for f in framed.schema.fields if f.name not in ("frames", "units", "chars", "size", "marked", text_col)]
    schema = T.StructType([*kept, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out = [b"".join(press.decompress(f["blob"]) for f in x).decode() for x in batch.column("frames").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(out, pa.string())], names=schema.names)

    return framed.select(*[F.col(f"`{f.name}`") for f in kept], "frames").mapInArrow(run, schema)


def draws(doc_id, seed: int) -> list[int]:
    digest = sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def order(form: str, a: int, b: int, size: int) -> list[tuple[bytes, int, int]]:
    """The parts of a transformed text: a marker and a range of bytes of the original. a, b: where the middle begins and ends."""
    if form == "plain":
        return [(b"", 0, size)]
    parts = {"p": (PREFIX, 0, a), "s": (SUFFIX, b, size), "m": (MIDDLE, a, b)}
    return [parts[k] for k in form]


def transform(framed: DataFrame, seed: int = 1, id_col: str = "doc_id", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, frames, units, chars, size): the transformed texts as frames."""
    rows = framed.select(F.col(id_col).cast("long").alias("doc_id"), "frames", "units", "chars", "size", "marked")
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "frames", "units", "chars", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, press = Writer(frame_bytes), zstandard.ZstdDecompressor()
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                out = []
                for row in whole.slice(lo, 256).to_pylist():
                    reader, n = Reader(row["frames"], row["units"], row["chars"], row["size"], press), row["units"]
                    h1, h2, h3, h4 = draws(row["doc_id"], seed)
                    form, a, b, chars = "plain", 0, 0, (None, None)
                    if n and not row["marked"] and h3 % 100 < PLAIN_FROM:
                        form = "spm" if h4 % 100 < SPM_BELOW else "psm"
                        (a, first), (b, last) = (reader.locate(c) for c in sorted((h1 % (n + 1), h2 % (n + 1))))
                        chars = (first, last - first)
                    if form == "plain":  # its frames stand as they are
                        out.append((row["doc_id"], n, form, *chars, [tuple(f.values()) for f in row["frames"]], n, row["chars"], row["size"]))
                        continue
                    writer.start()
                    for marker, start, end in order(form, a, b, row["size"]):
                        writer.write(marker)
                        for data in reader.stream(start, end):
                            writer.write(data)
                    out.append((row["doc_id"], n, form, *chars, writer.end(), writer.units, writer.chars, writer.bytes))
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), None, pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([_framed(c) if k is None else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, f"doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, frames {FRAMES}, units bigint, chars bigint, size bigint")


def original(reader: Reader, form: str) -> Iterator[bytes]:
    """The original text of a transformed one, from its markers."""
    if form == "plain":
        return reader.stream()
    places, at = {}, 0
    for k in form:
        marker = {"p": PREFIX, "s": SUFFIX, "m": MIDDLE}[k]
        at = reader.find(marker, at)
        places[k] = at
        at += len(marker)
    edges = [*(places[k] for k in form[1:]), reader.size]
    ranges = {k: (places[k] + len(PREFIX), end) for k, end in zip(form, edges, strict=True)}
    return (data for k in "pms" for data in reader.stream(*ranges[k]))


def digests(transformed: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of transform()'s rows; the second is of
    the original text, rebuilt from the transformed one."""
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]

    def digest(parts: Iterator[bytes]) -> str:
        out = sha256()
        for data in parts:
            out.update(data)
        return out.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch, made, back = whole.slice(lo, 256), [], []
                for row in batch.select(["form", "frames", "units", "chars", "size"]).to_pylist():
                    reader = Reader(row["frames"], row["units"], row["chars"], row["size"], press)
                    made.append(digest(reader.stream()))
                    back.append(digest(original(reader, row["form"])))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made, pa.string()), pa.array(back, pa.string())], names=[*kept, "output_sha256", "restored_sha256"])

    return transformed.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string")
