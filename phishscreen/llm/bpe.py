"""Byte-level BPE encoding and decoding with a local rank file.

tiktoken's rank-based encoder does the merges. Texts longer than a limit are cut first, only at places where the
pre-tokenizer's pattern ends a match whatever stands around, so that the pieces' ids joined are the ids of the whole
text. Decoding works on raw bytes: a token may end inside a character.

The pattern's rule for white space, all of a run but its last character if something else follows, looks ahead and so keeps
a place to go back to for each character, which overflows on some million of them. Long runs are therefore found by a plain
scan and their match is merged without the pattern. All other matches are found without going back. A text without any
safe place is encoded in one go; it must fit in a task's memory some 30 times over, and there is no other limit to its length.

Null text counts as empty and gives no ids; repeated rows and rows with equal ids each give their own row; extra columns
are carried by encode() unless they clash with its own output names, which then win. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a piece before a cut is looked for.
PIECE_CHARS = 1 << 16

_LETTER = "A-Za-zĀ-ſぁ-ゖァ-ヺ一-龥"
#: A match always ends here: a single space between letters or digits goes with what follows it; a run of letters ends
#: before a line break or a full stop.
SAFE_CUT = rf"(?<=[{_LETTER}0-9])(?= [{_LETTER}0-9])|(?<=[{_LETTER}])(?=[\n.,;:!?、。])"
#: Characters of a run of white space from which on it is merged without the pattern.
LONG_BLANKS = 4096
#: The characters that the pattern takes for white space (\\s).
BLANKS = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


class Codec:
    """Encodes and decodes with the ranks of a rank file. Built from bytes, as tasks get those rather than a path."""

    def __init__(self, rank_file: bytes, pattern: str, piece_chars: int = PIECE_CHARS) -> None:
        self.rank_file, self.pattern, self.piece_chars = rank_file, pattern, piece_chars
        self._encoding = self._cut = None

    @classmethod
    def from_path(cls, path: str, pattern: str, piece_chars: int = PIECE_CHARS) -> Codec:
        return cls(Path(path).read_bytes(), pattern, piece_chars)

    def __getstate__(self) -> tuple:
        return self.rank_file, self.pattern, self.piece_chars

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    @property
    def encoding(self):
        if self._encoding is None:
            import re

            import tiktoken

            pairs = (line.split() for line in self.rank_file.splitlines() if line.strip())
            ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
            self._encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            self._cut, self._blanks = re.compile(SAFE_CUT), re.compile(f"{BLANKS}{{{LONG_BLANKS},}}")
        return self._encoding

    def pieces(self, text: str) -> Iterator[str]:
        """The text in pieces of at least piece_chars (but for the last), cut at safe places only."""
        at = 0
        while len(text) - at > self.piece_chars:
            found = self._cut.search(text, at + self.piece_chars)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def encode(self, text: str) -> list[int]:
        encode = self.encoding.encode_ordinary
        if len(text) < min(self.piece_chars, LONG_BLANKS):
            return encode(text)
        out, at = [], 0
        for run in self._blanks.finditer(text):
            # a match ends where a run begins, and the run's match leaves its last character to what follows
            end = run.end() if run.end() == len(text) else run.end() - 1
            for piece in self.pieces(text[at : run.start()]):
                out += encode(piece)
            out += self.encoding._encode_single_piece(text[run.start() : end])
            at = end
        for piece in self.pieces(text[at:]):
            out += encode(piece)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def encode(docs: DataFrame, codec: Codec, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of docs, and ids ARRAY<INT> and n_tokens BIGINT of the whole text."""
    docs = docs.drop(ids_col, "n_tokens")
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = [codec.encode(x) for x in _texts(batch, text_col)]
                new = [pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, ids_col, "n_tokens"])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, codec: Codec, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """All columns of tokens, and the raw bytes (BINARY) that the ids stand for; null ids give no bytes."""
    tokens = tokens.drop(bytes_col)
    schema = T.StructType([*tokens.schema.fields, T.StructField(bytes_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [codec.decode(x or []) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, bytes_col])

    return tokens.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids and digests both, in one pass without keeping the ids."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: list[str] = []
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            said = said or [str(i) for i in range(codec.encoding.n_vocab)]
            for text in _texts(batch, "text"):
                ids = codec.encode(text)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join([said[i] for i in ids]).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
