"""Alerts on domains that send spam again: over a log, and live in any order and batches, over restarts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from phishscreen.operators import loganalytics
from phishscreen.streaming import alerts

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "verdict string, from_domain string, subject string, logged_at timestamp"
START = datetime.datetime(2024, 1, 1, 12, 30)


def at(hours: float) -> datetime.datetime:
    return START + datetime.timedelta(hours=hours)


def brute(rows, least=2, hours=168):
    """By hand: each hour of a domain against all others."""
    counts = {}
    for verdict, domain, subject, when in rows:
        if verdict == "spam" and domain and when:
            nth = int((when - datetime.datetime(1970, 1, 1)).total_seconds() // 3600)
            n, best = counts.get((domain, nth), (0, (when, "")))
            counts[domain, nth] = (n + 1, max(best, (when, subject or "")) if n else (when, subject or ""))
    out = []
    for (domain, nth), (n, best) in counts.items():
        before = sum(m for (d, h), (m, _) in counts.items() if d == domain and nth - hours < h < nth)
        if before < least <= before + n:
            out.append((domain, datetime.datetime(1970, 1, 1) + datetime.timedelta(hours=nth), before + n, best[1]))
    return sorted(out)


ROWS = [
    ("spam", "a.example", "first", at(0)), ("spam", "a.example", "second", at(160)), ("spam", "a.example", None, at(161)),  # over a border of weeks
    ("spam", "b.example", "once", at(0)), ("spam", "b.example", "late", at(168)), ("spam", "b.example", "again", at(335)),
    ("spam", "c.example", "x", at(5)), ("spam", "c.example", "y", at(5.2)), ("ham", "c.example", "z", at(5.3)), ("spam", "", "none", at(5)),
    ("spam", None, "none", at(5)), ("spam", "d.example", "no time", None), ("spam", "c.example", "x", at(600)), ("spam", "c.example", "x", at(600)),
]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_over_a_log(spark):
    rng = random.Random(1)
    many = [*ROWS, *[("spam", f"e{rng.randrange(6)}.example", rng.choice(["p", "q", None]), at(rng.randrange(2000))) for _ in range(150)]]
    assert rows_of(loganalytics.repeat_alerts(spark.createDataFrame(many, SCHEMA))) == brute(many)
    assert rows_of(loganalytics.repeat_alerts(spark.createDataFrame(many, SCHEMA), 3, 24)) == brute(many, 3, 24)
    assert rows_of(loganalytics.repeat_alerts(spark.createDataFrame([], SCHEMA))) == []


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


def test_live_with_restarts(rocks, tmp_path):
    spark, source, out = rocks, str(tmp_path / "in"), str(tmp_path / "out")
    spam = [r for r in ROWS if r[3]]
    batches = [
        [r for r in spam if r[3] < at(100)][::-1],
        [r for r in spam if at(100) <= r[3] < at(168)][::-1],  # the second message of a.example comes after a restart
        [r for r in spam if at(168) <= r[3] < at(500)],
        [r for r in spam if at(500) <= r[3]],
        [("spam", "end.example", "end", at(900))],
        [("spam", "end.example", "end", at(1200))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = alerts.repeat_alerts(spark.readStream.schema(SCHEMA).parquet(source))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = rows_of(spark.read.parquet(out))
    assert got == brute(ROWS) and [r[0] for r in got] == ["a.example", "b.example", "c.example", "c.example"]
    kept = {r.key[0] if isinstance(r.key, tuple) else r.key for r in spark.read.format("statestore").option("path", str(tmp_path / "ckpt")).option("stateVarName", "seen").load().select(F.col("key.from_domain").alias("key")).collect()}
    assert kept == {"end.example"}  # state of domains that fell silent is gone
