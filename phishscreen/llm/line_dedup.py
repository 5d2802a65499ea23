"""Line dedup by winnowing over line hashes.

The lines that hold a word are hashed, without the blanks around them. Of every min_lines neighbouring lines of a document
the smallest hash is selected (the last of equal ones), so that two equal runs of min_lines lines are sure to select the
same line. Fewer lines are a run too where they hold long_words or more and no shorter run in them does: one long line, or
two that are long together, for which the same holds. Selected lines are the fingerprints: chunks of documents send them to
buckets, which answer which ones occur at two positions. Around those the matches are extended to both sides, as every run
that holds a shared fingerprint is compared whole with all others (by 128 bits of two hashes), and neighbouring repeats join to maximal runs. A run that occurs earlier
(smaller id, null as the smallest long there is; in a document further up) is deleted; its first occurrence stays. Fingerprints that all
documents share cost no more than others, as a chunk sends each once.

A line without a word goes with the line above it. Null texts count as empty and have no lines; repeated rows are documents
of their own, and of equal rows one stays whole. An empty table gives an empty result. Extra columns are kept by
dedup_docs(). A document must fit in a task's memory about 60 times over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import bucket_bits, chunk_order, groups, sorted_chunk, window_room, word_spans
from .substring_dedup import BLOCK_BITS, Windows, exchange

MIN_LINES, LONG_WORDS = 3, 50
RESULT = "doc_id bigint, n_lines bigint, n_removed bigint, n_runs bigint, kept_text string"


class LineRuns(Windows):
    """Windows over lines instead of words; their anchors are the winnowed lines."""

    def __init__(self, min_lines: int, long_words: int, bits: int) -> None:
        super().__init__(min_lines, bits)
        self.block, self.long_words = 1, long_words

    def read(self, chunk: pa.Table) -> None:
        self.keys, self.ids, self.data, self.off = sorted_chunk(chunk)
        starts, ends, first = word_spans(self.data, self.off)
        doc = np.repeat(np.arange(len(self.ids)), np.diff(first))
        at = groups(np.searchsorted(np.flatnonzero(self.data == 10), starts) + doc)
        lines = starts[at]
        self.units = lines, ends[np.append(at[1:], len(starts)) - 1] if len(at) else lines
        self.hashes = self.hasher.spans(self.data, *self.units)
        words = np.concatenate([[0], np.cumsum(np.diff(np.append(at, len(starts))))])
        self.first = np.searchsorted(lines, self.off)
        self.n, self.counts = len(lines), np.diff(self.first)
        # runs of fewer lines that hold enough words, without a line to spare at either end
        self.short = {}
        for width in range(1, self.width):
            at = np.flatnonzero(window_room(self.first, width))
            held = lambda lo, hi: words[hi] - words[lo]
            least = (held(at, at + width) >= self.long_words) & (held(at, at + width - 1) < self.long_words) & (held(at + 1, at + width) < self.long_words)
            self.short[width] = at[least]

    def _runs(self) -> list[tuple[int, np.ndarray]]:
        """Number of lines and starts of all runs."""
        return [(self.width, np.flatnonzero(window_room(self.first, self.width))), *self.short.items()]

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        picked = np.zeros(self.n, bool)
        for width, starts in self._runs():
            best = starts + width - 1
            for nth in range(width - 2, -1, -1):
                best = np.where(self.hashes[starts + nth] < self.hashes[best], starts + nth, best)
            picked[best] = True
        places = np.flatnonzero(picked)
        return places, self.hashes[places] >> np.uint64(64 - BLOCK_BITS - self.bits), np.ones(len(places), bool)

    def full(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        runs = self._runs()
        hashes = [self.hasher.windows(self.hashes, width)[starts] for width, starts in runs]
        return np.concatenate([s for _, s in runs]), np.repeat([w for w, _ in runs], [len(s) for _, s in runs]), np.concatenate(hashes)

    def remove(self, key: tuple, chunk: pa.Table, later: pa.Table) -> pa.Table:
        self.read(chunk)
        gone = self.gone(later)
        removed, runs, texts = [], [], []
        raw = self.data.tobytes()
        for i in range(len(self.ids)):
            text = raw[self.off[i] : self.off[i + 1]]
            out = gone[self.first[i] : self.first[i + 1]]
            removed.append(int(out.sum()))
            runs.append(int(np.count_nonzero(np.diff(np.append(0, out.astype(np.int8))) == 1)))
            if removed[-1]:
                kept, nth, goes = [], 0, False
                for line in text.split(b"\n"):
                    if line.strip():
                        goes = bool(out[nth])
                        nth += 1
                    if not goes:
                        kept.append(line)
                text = b"\n".join(kept)
            texts.append(text.decode("utf-8", "replace"))
        longs = lambda x: pa.array(x, pa.int64())
        out = pa.table({"doc_id": longs(self.ids), "n_lines": longs(self.counts.tolist()), "n_removed": longs(removed), "n_runs": longs(runs), "kept_text": pa.array(texts, pa.string())})
        return out.append_column("rest", chunk["rest"].take(chunk_order(chunk))) if "rest" in chunk.column_names else out


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, kept_text): without the runs of lines that occur earlier; n_runs are maximal."""
    return exchange(docs, LineRuns(min_lines, long_words, bucket_bits(docs.sparkSession)), RESULT, id_col, text_col)


def dedup_docs(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with the text that is left, and chars_col, if docs has it, the number of its characters. Rows all of whose lines
    were deleted go; other columns are unchanged. Null texts come back empty."""
    if not [c for c in docs.columns if c != text_col]:
        raise ValueError("no id column")
    rest = T.StructType([f for f in docs.schema.fields if f.name != text_col])
    result = T.StructType([*T.StructType.fromDDL(RESULT).fields, T.StructField("rest", rest)])
    out = exchange(docs, LineRuns(min_lines, long_words, bucket_bits(docs.sparkSession)), result, id_col, text_col, rest=True)
    column = {text_col: F.col("kept_text"), chars_col: F.length("kept_text").cast("bigint")}
    return out.where("n_lines = 0 or n_removed < n_lines").select(*[column.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])
