"""Reading mail (S1-S10). Archives are split by Spark's text reader on their separator line, so one large archive is many tasks."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import EVAL_RECORD, MESSAGES

# Names of charsets as mail has them, and Python's.
CHARSETS = {"shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "windows-31j": "cp932", "x-euc-jp": "euc-jp", "us-ascii": "utf-8", "ansi_x3.4-1968": "utf-8", "unknown-8bit": "utf-8", "gb2312": "gbk", "ks_c_5601-1987": "cp949", "euc-kr": "cp949", "iso-8859-1": "cp1252"}


def decode_bytes(raw: bytes, charset: str | None) -> str:
    name = (charset or "utf-8").lower().strip("\"' ")
    try:
        return raw.decode(CHARSETS.get(name, name), "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def _text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _words(value: str) -> str:
    def one(m: re.Match) -> str:
        charset, kind, payload = m.groups()
        try:
            if kind in "Bb":
                clean = re.sub("[^A-Za-z0-9+/]", "", payload)
                return decode_bytes(base64.b64decode(clean + "=" * (-len(clean) % 4)), charset)
            raw = re.sub(rb"=([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), payload.replace("_", " ").encode("latin-1", "replace"))
            return decode_bytes(raw, charset)
        except ValueError:
            return m.group(0)

    return re.sub(r"=\?([^?]+)\?([BbQq])\?([^?]*)\?=", one, re.sub(r"(\?=)\s+(=\?)", r"\1\2", value)) if "=?" in value else value


def parse_headers(raw: bytes) -> dict[str, list[str]]:
    """Header lines with folded ones joined, encoded words decoded, names in lower case, values in order."""
    out: dict[str, list[str]] = {}
    unfolded = re.sub(r"\r?\n[ \t]+", " ", _text(raw))
    for line in re.split(r"\r?\n", unfolded):
        name, colon, value = line.partition(":")
        if colon and re.fullmatch("[!-9;-~]+", name):
            out.setdefault(name.lower(), []).append(_words(value.strip(" \t\r")))
    return out


def _content_type(headers: dict[str, list[str]]) -> tuple[str, dict[str, str]]:
    raw = headers.get("content-type", ["text/plain"])[0] or "text/plain"
    found = re.findall(r';\s*([\w-]+)\s*=\s*(?:"([^"]*)"|([^;\s]+))', raw)
    return raw.split(";")[0].strip().lower(), {k.lower(): quoted or bare for k, quoted, bare in found}


def _split_head(raw: bytes) -> tuple[bytes, bytes]:
    end = re.search(rb"\r\n\r\n", raw) or re.search(rb"\n\n", raw)
    return (raw[: end.start()], raw[end.end() :]) if end else (raw, b"")


def bodies_of(headers: dict[str, list[str]], body: bytes, depth: int = 0) -> Iterator[tuple[str, str]]:
    """Text parts depth first; other parts, attached messages too, are not opened."""
    kind, params = _content_type(headers)
    if kind.startswith("multipart/") and params.get("boundary") and depth < 40:
        pieces = body.split(b"--" + params["boundary"].encode("latin-1", "replace"))[1:]
        for piece in pieces:
            if piece.startswith(b"--"):
                break
            _, _, part = piece.partition(b"\n")
            head, rest = _split_head(re.sub(rb"\r?\n\Z", b"", part))
            yield from bodies_of(parse_headers(head), rest, depth + 1)
    elif kind.startswith("text/"):
        how = (headers.get("content-transfer-encoding") or [""])[0].lower().strip()
        if how == "base64":
            clean = re.sub(rb"[^A-Za-z0-9+/]", b"", body)
            clean = clean[:-1] if len(clean) % 4 == 1 else clean
            body = base64.b64decode(clean + b"=" * (-len(clean) % 4))
        elif how == "quoted-printable":
            body = re.sub(rb"=([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), re.sub(rb"=\r?\n", b"", body))
        yield kind, decode_bytes(body, params.get("charset"))


def parse_message(raw: bytes) -> tuple[dict[str, list[str]], list[tuple[str, str]]]:
    head, body = _split_head(raw)
    headers = parse_headers(head)
    return headers, [(k, b) for k, b in bodies_of(headers, body) if b]


def _date(value: str):
    from datetime import UTC
    from email.utils import parsedate_to_datetime

    try:
        when = parsedate_to_datetime(value)
        return when.astimezone(UTC) if when.tzinfo else when.replace(tzinfo=UTC)
    except (TypeError, ValueError, IndexError, OverflowError):
        return None


def message_row(path: str, raw: bytes, label: str | None = None) -> tuple:
    """One raw message as a row of MESSAGES. A message that can't be parsed is a row that tells why, not a failed task."""
    from hashlib import sha256

    headers, bodies, error = {}, [], None
    try:
        headers, bodies = parse_message(raw)
    except Exception as e:  # noqa: BLE001
        error = f"{type(e).__name__}: {e}"
    first = lambda k: headers.get(k, [""])[0]
    return (f"{path}#{sha256(raw).hexdigest()[:16]}", first("message-id"), path, label, _date(first("date")), None, None, dict(headers), [{"content_type": k, "body": b} for k, b in bodies], error)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in re.split(r", (?=\w+ )", MESSAGES)])
    out["received_at"] = pd.to_datetime(out["received_at"], utc=True, errors="coerce")
    return out


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield _frame([message_row(path, raw or b"") for path, raw in zip(batch["source_path"], batch["raw"], strict=True)])


def parse(raw: DataFrame) -> DataFrame:
    """(source_path, raw binary) to messages."""
    return raw.select("source_path", "raw").mapInPandas(_parse, MESSAGES)


def unquoted(raw: bytes) -> bytes:
    """A message without its separator line and the quoting of such lines in its body. Line breaks at its end are one, as the
    empty lines before the next separator are not the message's."""
    body = re.sub(rb"(?m)^>(>*From )", rb"\1", raw.partition(b"\n")[2]).rstrip(b"\r\n")
    return body + b"\n" if body else b""


def read_mbox(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """All messages of mailbox archives, on any file system that Spark reads. A message begins at a line that begins with
    From and a space. mailbox.read_mbox gives the same rows by ranges of bytes, and a stream."""
    lines = spark.read.option("lineSep", "\nFrom ").text(path)
    raw = lines.select(F.col("_metadata.file_path").alias("source_path"), F.col("value").cast("binary").alias("raw"))

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # every record begins inside its separator line
            mails = ((path, unquoted(raw or b"")) for path, raw in zip(batch["source_path"], batch["raw"], strict=True))
            yield _frame([message_row(path, mail, label) for path, mail in mails if mail.strip()])

    return raw.mapInPandas(parsed, MESSAGES)


def newest(messages: DataFrame, n: int) -> DataFrame:
    """S3: the newest n messages of each mailbox, by date."""
    order = Window.partitionBy("source_path").orderBy(F.desc("received_at"), F.desc("msg_key"))
    return messages.withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= n).drop("__nth")


def read_eml(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """One message in each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path)
    return parse(files.select(F.col("path").alias("source_path"), F.col("content").alias("raw"))).withColumn("label", F.lit(label).cast("string"))


def read_messages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Messages that are already tables; header names in lower case."""
    out = spark.read.schema(MESSAGES).format(kind).load(path)
    lower = F.map_from_entries(F.transform(F.map_entries("headers"), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    return out.withColumn("headers", lower)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log without the folders that keep batches apart."""
    return spark.read.parquet(path).drop("stream", "batch")


def read_evaluation(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The records of an evaluation file."""
    raw = spark.read.option("multiLine", True).schema(f"generatedAt string, byKey map<string,struct<{', '.join(f'{n}:{t}' for n, t in (x.split(' ', 1) for x in re.split(r', (?=[a-z]\w* )', EVAL_RECORD)))}>>").json(path)
    r = F.col("r")
    return raw.select(F.explode(F.map_values("byKey")).alias("r")).select(F.lit(run_id).alias("run_id"), r.key.alias("key"), r.label.alias("label"), r.localScore.alias("local_score"), r.jevScore.alias("model_score"), r.finalScore.alias("final_score"), r.detail.alias("detail"), r.pretext.alias("pretext"), r.fromDomain.alias("from_domain"), r.subject.alias("subject"), r.usage.alias("usage"), r.error.alias("error"))


def stream_messages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Newly arrived messages."""
    return spark.readStream.schema(MESSAGES).format(kind).load(path)


def own_domains(identities: DataFrame, configured=()) -> DataFrame:
    """(domain), from the addresses of one's identities and settings."""
    extra = identities.sparkSession.createDataFrame([(d.lower(),) for d in configured], "domain string")
    found = identities.where(F.col("email").contains("@")).select(F.lower(F.substring_index("email", "@", -1)).alias("domain"))
    return found.unionByName(extra).where("domain <> ''").distinct()
