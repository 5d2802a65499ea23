"""URL filters by a sort-merge range join.

A rule names a host and a path prefix; it fits the host, its subdomains and every path that starts so. With the labels
of the host reversed and the path behind, a rule is the interval of all keys that start with its own key. A URL is a few
points: one for each suffix of its host that has no more labels than the longest rule's host and no more characters, each with
the whole path. Other suffixes fit no rule. Points and interval ends are dealt out by ranges of
keys; inside a range one sweep over the sorted keys keeps the stack of the rules that are open at that point. Rules nest,
as prefixes do, so the stack's entries are exactly the rules that fit, and the longest wins.

Only distinct (host, path) pairs are swept. A key that fills several ranges is spread over all of them, and rules that
span ranges are sent to each. Null urls and urls without "://" have an empty host and path, fit no rule and get the
default verdict. Repeated rows are judged one by one; an empty table of rules leaves every url to the default. A url takes as
many points as the longest rule has labels, so memory grows with its length and not with the square of it; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import partitions

#: Urls of the sample that fixes the range bounds, for each range; the sample decides balance, never results.
SAMPLE_PER_RANGE = 50
_HOST_END = "\x01"


def parts(url) -> tuple:
    """(host, path) columns: host after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path up to '?', '#' or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _key(host: str, path: str) -> bytes:
    return ("\x02".join(reversed(host.split("."))) + _HOST_END + path).encode("utf-8", "surrogatepass")


def _upper(key: bytes) -> bytes:
    """Above all keys that start with key: UTF-8 has no byte 0xFF."""
    return key + b"\xff"


def _suffixes(host: str, labels: int, chars: int) -> list[str]:
    """The host's last label, then one more at a time, while a rule with so many labels and characters can fit; none of an empty host."""
    out, at = [], len(host) or -1
    while at >= 0 and len(out) < labels:
        at = host.rfind(".", 0, at)
        if len(host) - at - 1 > chars:
            break
        out.append(host[at + 1 :])
    return out


def _points(labels: int, chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                rows, keys = [], []
                for i, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                    for suffix in _suffixes(host, labels, chars):
                        rows.append(i), keys.append(_key(suffix, path))
                picked = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([picked.column("host"), picked.column("path"), pa.array(keys, pa.binary())], names=["host", "path", "key"])

    return run


def _longer(rule: tuple, than: tuple | None) -> bool:
    """Longest of host and path together; of equally long ones the longer host, then the first in code points."""
    size = lambda r: (len(r[0]) + len(r[1]), len(r[0]))
    return than is None or size(rule) > size(than) or size(rule) == size(than) and rule < than


def _sweep(key: tuple, points: pa.Table, rules: pa.Table) -> pa.Table:
    opens = sorted(zip(rules["key"].to_pylist(), rules["rhost"].to_pylist(), rules["rpath"].to_pylist(), rules["action"].to_pylist(), strict=True))
    at = points["key"].to_pylist()
    order = sorted(range(len(at)), key=at.__getitem__)
    stack, i, take, best = [], 0, [], []
    for j in order:
        while i < len(opens) and opens[i][0] <= at[j]:
            while stack and not opens[i][0].startswith(stack[-1][0]):
                stack.pop()
            if not stack or stack[-1][0] != opens[i][0]:
                stack.append(opens[i])
            i += 1
        while stack and not at[j].startswith(stack[-1][0]):
            stack.pop()
        if stack:
            take.append(j)
            best.append(stack[-1])
    found = points.take(pa.array(take, pa.int64()))
    return pa.table({"host": found["host"].cast(pa.string()), "path": found["path"].cast(pa.string()), "rhost": pa.array([x[1] for x in best], pa.string()), "rpath": pa.array([x[2] for x in best], pa.string()), "action": pa.array([x[3] for x in best], pa.string())})


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict). rules: (host, path, action) with action 'allow' or 'block'; of equal host and
    path the first action in code points holds. Rules with a null host, path or action, or an empty host, fit nothing."""
    spark = pages.sparkSession
    host, path = parts(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rules = rules.select(lower.alias("rhost"), F.col("path").alias("rpath"), "action").dropna().where("rhost <> ''").groupBy("rhost", "rpath").agg(F.min("action").alias("action"))
    rules = rules.withColumn("key", F.encode(F.concat(F.array_join(F.reverse(F.split("rhost", "[.]")), "\x02"), F.lit(_HOST_END), F.col("rpath")), "utf-8"))
    widest = rules.agg(F.max(F.size(F.split("rhost", "[.]"))), F.max(F.length("rhost"))).first()
    labels, chars = widest[0] or 0, widest[1] or 0
    points = rows.where("host <> ''").select("host", "path").distinct().mapInArrow(_points(labels, chars), "host string, path string, key binary")
    n = partitions(spark)
    # The bounds come from the points of a sample of urls that is bounded by the number of ranges, as a range partitioner's do.
    sample = rows.where("host <> ''").orderBy(F.xxhash64("page_id", "host", "path")).limit(SAMPLE_PER_RANGE * n).select("host", "path").collect()
    seen = sorted({_key(suffix, r.path) for r in sample for suffix in _suffixes(r.host, labels, chars)})
    bounds = [seen[len(seen) * i // n] for i in range(1, n)] if seen else []

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, p, k in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "key")), strict=True):
                lo, hi = bisect_left(bounds, k), bisect_right(bounds, k)
                out.append(lo + (hash_of(h + p) % (hi - lo + 1)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), *batch.columns], names=["part", *batch.schema.names])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(part, i) for i, k in enumerate(batch.column("key").to_pylist()) for part in range(bisect_left(bounds, k), bisect_right(bounds, _upper(k)) + 1)]
            picked = batch.take(pa.array([i for _, i in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), *picked.columns], names=["part", *batch.schema.names])

    left = points.mapInArrow(ranges, "part int, host string, path string, key binary")
    right = rules.mapInArrow(spans, "part int, rhost string, rpath string, action string, key binary")
    fits = left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(_sweep, "host string, path string, rhost string, rpath string, action string")
    size = F.struct((F.length("rhost") + F.length("rpath")).alias("n"), F.length("rhost").alias("h"), "rhost", "rpath", "action")
    won = fits.groupBy("host", "path").agg(F.max(size).alias("won"))
    # urls without a host meet no rule, and don't gather at one key of the join
    none = rows.where("host = ''").withColumn("won", F.lit(None).cast(won.schema["won"].dataType))
    out = rows.where("host <> ''").join(won, ["host", "path"], "left").select("page_id", "host", "path", "won").unionByName(none)
    return out.select("page_id", "host", "path", F.concat("won.rhost", "won.rpath").alias("rule"), F.coalesce("won.action", F.lit(default)).alias("verdict"))


def hash_of(text: str) -> int:
    from zlib import crc32

    return crc32(text.encode("utf-8", "surrogatepass"))
