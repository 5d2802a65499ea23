"""Mailbox archives as a data source of Spark's, in batches and as a stream.

A task reads a range of bytes of one archive and parses its messages there, so mail passes Python once. A message begins at a
line that begins with "From " and belongs to the range that holds the first byte of that line; it ends where the next one begins
or the archive ends, which may be beyond the range. The separator line is dropped, quoted separators in bodies are restored,
line breaks at the end count as one, and bytes before the first separator are no message. A task holds one message and a block of
bytes, so messages have to fit in its memory; a range within a long message reads its own bytes and gives nothing.

The stream is for archives that grow. Its offset holds for each archive the first line and a number of bytes. The last message of
an archive is taken once the archive has rested for `settle` seconds, all others once the next separator is there. Restarts and
repeated batches give the same rows. If text is added to a message after it was taken, the message comes again, whole and under
another key. An archive whose first line changes is read from its beginning; one that is removed leaves the offset. Archives may
only grow or be replaced. An offset has an entry for each archive, so a folder should hold thousands of them, not millions.

Empty archives, and a folder without any, give no rows. Options: path (a file, a folder read with those in it, or a URI of a file
system that pyarrow opens), pathGlobFilter (a pattern of file names), label, rangeBytes (64 MB), settle (60 seconds).
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .mail import message_row, unquoted
from .schemas import MESSAGES

FORMAT = "mailbox"
RANGE_BYTES = 64 << 20
BLOCK = 1 << 20
#: How a message begins, and the most bytes of an archive's first line that tell it from another.
SEPARATOR = b"\nFrom "
FIRST_LINE = 512

Read = Callable[[int, int], bytes]


def messages_between(read: Read, start: int, stop: int, end: int, block: int = BLOCK) -> Iterator[bytes]:
    """The messages, separator lines included, that begin in [start, stop) of an archive of `end` bytes. read(position, n) gives
    n bytes, or those that there are."""
    # the line break before a separator is looked for; the archive's first line has one before it, too
    held, base, upto = bytearray(b"\n" if start == 0 else b""), start - 1, max(start - 1, 0)
    begun, scan = None, 0
    while True:
        found = held.find(SEPARATOR, scan)
        if found >= 0:
            if begun is not None:
                yield bytes(held[begun : found + 1])
                begun = None
            if base + found + 1 >= stop:
                return
            begun, scan = found + 1, found + 1
            continue
        if begun is None and base + len(held) >= stop + len(SEPARATOR):
            return
        more = read(upto, min(block, end - upto)) if upto < end else b""
        if not more:
            break
        scan = max(len(held) - len(SEPARATOR) + 1, scan)
        gone = scan if begun is None else begun
        del held[:gone]
        held += more
        base, scan, upto = base + gone, scan - gone, upto + len(more)
        begun = None if begun is None else 0
    if begun is not None:
        yield bytes(held[begun:])


def last_separator(read: Read, end: int, block: int = BLOCK) -> int:
    """Where the last separator line among the first `end` bytes begins; 0 if there is none."""
    high, tail = end, b""
    while high > 0:
        low = max(high - block, 0)
        held = read(low, high - low) + tail
        found = held.rfind(SEPARATOR)
        if found >= 0:
            return low + found + 1
        high, tail = low, held[: len(SEPARATOR) - 1]
    return 0


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    end: int


class Archives:
    """The archives under a path, opened by pyarrow."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.pattern = options.get("pathGlobFilter") or "*"

    def _open(self):
        from pyarrow import fs

        if "://" not in self.path and not self.path.startswith("file:"):
            return fs.LocalFileSystem(), os.path.abspath(self.path), "file:"
        # Spark's names of file systems that pyarrow has under another, and its short form of local paths
        uri = re.sub(r"^file:/(?!/)", "file:///", re.sub("^s3[an]:", "s3:", self.path))
        system, path = fs.FileSystem.from_uri(uri)
        return system, path, "file:" if uri.startswith("file:") else self.path.split("://")[0] + "://"

    def listed(self) -> list[tuple[str, int, float]]:
        """(path within the file system, bytes, time of the last change), by path."""
        from pyarrow import fs

        system, path, _ = self._open()
        top = system.get_file_info(path)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [top] if top.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        hidden = lambda name: any(x[:1] in "._" for x in name[len(path) :].split("/") if x)
        files = [f for f in found if f.type == fs.FileType.File and f.size and (f is top or not hidden(f.path)) and fnmatch(f.base_name, self.pattern)]
        return sorted((f.path, f.size, f.mtime.timestamp() if f.mtime else 0.0) for f in files)

    def reading(self, path: str):
        """A context that gives read(position, n)."""
        from contextlib import contextmanager

        @contextmanager
        def opened():
            with self._open()[0].open_input_file(path) as f:

                def read(position: int, n: int) -> bytes:
                    f.seek(position)
                    return f.read(n)

                yield read

        return opened()

    def name(self, path: str) -> str:
        return self._open()[2] + path


class _Ranges:
    def __init__(self, options: dict[str, str]) -> None:
        self.archives = Archives(options)
        self.label = options.get("label")
        self.size = max(int(options.get("rangeBytes") or RANGE_BYTES), 1)
        self.settle = float(options.get("settle") or 60)

    def ranges(self, path: str, start: int, end: int) -> list[Range]:
        return [Range(path, at, min(at + self.size, end), end) for at in range(start, end, self.size)]

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is None:  # what Spark reads where there is no range
            return
        name = self.archives.name(partition.path)
        with self.archives.reading(partition.path) as read:
            for raw in messages_between(read, partition.start, partition.stop, partition.end):
                body = unquoted(raw)
                if body.strip():
                    yield message_row(name, body, self.label)


class MailboxReader(_Ranges, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for path, size, _ in self.archives.listed() for r in self.ranges(path, 0, size)]


class MailboxStreamReader(_Ranges, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out, now = {}, time.time()
        for path, size, changed in self.archives.listed():
            with self.archives.reading(path) as read:
                first, line, _ = read(0, min(size, FIRST_LINE)).partition(b"\n")
                if line or size >= FIRST_LINE:
                    out[path] = [first.decode("latin-1"), size if now - changed >= self.settle else last_separator(read, size)]
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, (first, stop) in sorted(end.items()):
            known, at = start.get(path) or (first, 0)
            at = at if known == first else 0
            if 0 < at < stop:
                # what was taken up to here may have been a part of a message only
                with self.archives.reading(path) as read:
                    if read(at - 1, min(len(SEPARATOR), stop - at + 1)) != SEPARATOR:
                        at = last_separator(read, at)
            out += self.ranges(path, at, stop)
        return out

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the offsets."""


class MailboxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MESSAGES

    def reader(self, schema) -> MailboxReader:
        return MailboxReader(self.options)

    def streamReader(self, schema) -> MailboxStreamReader:
        return MailboxStreamReader(self.options)


def _with(reader, spark: SparkSession, path: str, label: str | None, options: dict):
    spark.dataSource.register(MailboxSource)
    given = {**options, **({} if label is None else {"label": label})}
    return reader.format(FORMAT).options(**given).load(path)


def read_mbox(spark: SparkSession, path: str, label: str | None = None, **options) -> DataFrame:
    """All messages of mailbox archives."""
    return _with(spark.read, spark, path, label, options)


def stream_mbox(spark: SparkSession, path: str, label: str | None = None, **options) -> DataFrame:
    """S9 over archives: each message once, as archives grow and are added."""
    return _with(spark.readStream, spark, path, label, options)
