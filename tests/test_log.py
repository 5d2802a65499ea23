"""The streamed log survives failures, and the log is cut by whole days."""

import datetime
import os
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from phishscreen.sources import mail, retention, sinks
from phishscreen.sources.schemas import MESSAGES
from phishscreen.streaming import screen as streaming


def arrive(spark, folder, keys):
    rows = [(k, f"<{k}@a.example>", "box", None, datetime.datetime(2024, 1, 1, 12), None, None, {"from": [f"A <a@{k}.example>"]}, [], None) for k in keys]
    spark.createDataFrame(rows, MESSAGES).write.mode("append").parquet(folder)


def run(spark, tmp_path, checkpoint="ckpt"):
    source = mail.stream_messages(spark, str(tmp_path / "in"))
    query = streaming.screen_stream(source, str(tmp_path / "log"), str(tmp_path / checkpoint), decode_words=False).trigger(availableNow=True).start()
    query.awaitTermination()


def test_a_batch_that_fails_after_its_write_is_logged_once(spark, tmp_path, monkeypatch):
    write, calls, plan = streaming.write_batch, [], {"fails": True}

    def fails(verdicts, path, stream, batch):
        write(verdicts, path, stream, batch)
        calls.append((stream, batch))
        if plan.pop("fails", False):
            raise RuntimeError("lost after the write")

    monkeypatch.setattr(streaming, "write_batch", fails)
    arrive(spark, str(tmp_path / "in"), ["k1", "k2", "k3"])
    with pytest.raises(StreamingQueryException):
        run(spark, tmp_path)
    first = {r.msg_key: r.logged_at for r in mail.read_log(spark, str(tmp_path / "log")).collect()}
    assert set(first) == {"k1", "k2", "k3"}  # it is there although the batch is not committed
    run(spark, tmp_path)
    assert {r.msg_key: r.logged_at for r in mail.read_log(spark, str(tmp_path / "log")).collect()} == first  # with the batch's own time
    arrive(spark, str(tmp_path / "in"), ["k4", "k2", "k5"])  # k2 comes a second time
    plan["fails"] = True
    with pytest.raises(StreamingQueryException):
        run(spark, tmp_path)
    run(spark, tmp_path)
    arrive(spark, str(tmp_path / "in"), ["k6"])
    run(spark, tmp_path)
    log = mail.read_log(spark, str(tmp_path / "log"))
    assert Counter(r.msg_key for r in log.collect()) == Counter(["k1", "k2", "k3", "k4", "k5", "k6"])
    assert len({s for s, _ in calls}) == 1 and [b for _, b in calls] == sorted(b for _, b in calls)


def test_streams_of_one_log_keep_apart(spark, tmp_path):
    arrive(spark, str(tmp_path / "in"), ["k1", "k2"])
    run(spark, tmp_path)
    run(spark, tmp_path, "other")  # another stream over the same mail has a batch 0 of its own
    assert Counter(r.msg_key for r in mail.read_log(spark, str(tmp_path / "log")).collect()) == Counter(["k1", "k2"] * 2)


def log_of(spark, path, per_day):
    for i, n in enumerate(per_day):
        day = datetime.datetime(2024, 1, 1 + i)
        rows = [(f"d{i}k{j}", day + datetime.timedelta(minutes=j), day.date()) for j in range(n)]
        for k, part in enumerate((rows[::2], rows[1::2])):
            frame = spark.createDataFrame(part, "msg_key string, logged_at timestamp, logged_date date")
            sinks.write_batch(frame, path, "s", 2 * i + k)
            sinks.append_log(frame.limit(0), path)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("n", [0, 1, 9, 10, 12, 17, 99])
def test_the_newest_rows_stay_and_whole_days_go(spark, tmp_path, n):
    path, per_day = str(tmp_path / "log"), (4, 7, 10)
    log_of(spark, path, per_day)
    before, rows = files(path), mail.read_log(spark, path).collect()
    said = retention.keep_newest(spark, path, n)
    want = sorted(rows, key=lambda r: (r.logged_at, r.msg_key))[len(rows) - min(n, len(rows)) :]
    after = files(path)
    if n:
        assert sorted(r.msg_key for r in mail.read_log(spark, path).collect()) == sorted(r.msg_key for r in want)
    touched = {str(d) for d in said["dropped"] + said["rewritten"]}
    assert len(said["rewritten"]) <= 1
    keep = lambda fs: {f for f in fs if not any(f"logged_date={d}" in f for d in touched)}
    assert keep(before) == keep(after)  # untouched days keep their files
    assert not [f for f in after for d in said["dropped"] if f"logged_date={d}" in f]


def test_compaction_keeps_rows_and_other_days(spark, tmp_path):
    path = str(tmp_path / "log")
    log_of(spark, path, (4, 7))
    before, rows = files(path), sorted(mail.read_log(spark, path).collect())
    retention.compact(spark, path, datetime.date(2024, 1, 2))
    after = files(path)
    assert sorted(mail.read_log(spark, path).collect()) == rows
    assert len([f for f in after if "logged_date=2024-01-02" in f]) == 1 < len([f for f in before if "logged_date=2024-01-02" in f])
    assert {f for f in before if "2024-01-01" in f} == {f for f in after if "2024-01-01" in f}


def test_a_rewrite_that_was_lost_is_finished_or_undone(spark, tmp_path):
    path = str(tmp_path / "log")
    log_of(spark, path, (4, 7))
    rows = sorted(mail.read_log(spark, path).collect())
    day = spark.read.parquet(path).where(F.col("logged_date") == "2024-01-02").drop("logged_date")
    day.write.partitionBy("stream", "batch").parquet(f"{path}/_rewritten/2024-01-02")
    retention.drop_days(spark, path, ["2024-01-02"])  # lost between the removal and the move
    os.makedirs(f"{path}/_rewritten/2024-01-01")  # and one that was not written to its end
    retention.finish(spark, path)
    assert sorted(mail.read_log(spark, path).collect()) == rows and not os.listdir(f"{path}/_rewritten")
