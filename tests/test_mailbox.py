import os
import random
import re
import time

import pytest

from phishscreen.sources import mail, mailbox
from phishscreen.streaming.screen import screen_stream


def _mail(i, body="text"):
    return f"Message-ID: <{i}@x>\nSubject: s{i}\nDate: Mon, 01 Jan 2024 10:00:00 +0000\n\n{body}\n".encode()


def _box(*mails):
    return b"".join(b"From a Mon Jan 1\n" + re.sub(rb"(?m)^(>*From )", rb">\1", m) + b"\n" for m in mails)


def _between(data, start, stop, block):
    return list(mailbox.messages_between(lambda at, n: data[at : at + n], start, stop, len(data), block))


def _plain(data):
    """The messages of an archive, by lines."""
    out = []
    for line in data.splitlines(keepends=True):
        if line.startswith(b"From "):
            out.append(b"")
        if out:
            out[-1] += line
    return out


@pytest.mark.parametrize("block", [1, 2, 5, 7, 1000])
def test_ranges_of_any_size_give_each_message_once(block):
    rng = random.Random(block)
    for _ in range(60):
        data = b"".join(rng.choice([b"From ", b"\n", b"\nFrom ", b"x", b"Fro", b">From ", b"\r\n", b"abc\n\n"]) for _ in range(rng.randrange(40)))
        for size in (1, 3, 6, 11, 500):
            got = [m for at in range(0, len(data), size) for m in _between(data, at, min(at + size, len(data)), block)]
            assert got == _plain(data), (data, size)
        begins = [i for i in range(len(data)) if data[i : i + 5] == b"From " and data[i - 1 : i] == b"\n"]
        assert mailbox.last_separator(lambda at, n: data[at : at + n], len(data), block) == max(begins, default=0)


def test_a_long_message_is_linear():
    data = _box(_mail(1, "x" * 60_000_000), _mail(2))
    began = time.time()
    assert [len(m) > 1000 for m in _between(data, 0, len(data), 1 << 16)] == [True, False]
    assert _between(data, 1_000_000, 2_000_000, 1 << 16) == []
    assert time.time() - began < 5


def test_archives_as_a_table(spark, tmp_path):
    mails = [_mail(i, f"body {i}\nFrom here\n>From there ü" + "y" * (i * 37 % 500)) for i in range(200)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(_box(*mails[:150]))
    (tmp_path / "in" / "sub").mkdir()
    (tmp_path / "in" / "sub" / "b").write_bytes(b"no message\n\n" + _box(*mails[150:]) + b"From x\n\n\n")
    (tmp_path / "in" / "empty").write_bytes(b"")
    (tmp_path / "in" / "_SUCCESS").write_bytes(_box(_mail("hidden")))
    got = mailbox.read_mbox(spark, str(tmp_path / "in"), "ham", rangeBytes=1000)
    assert got.rdd.getNumPartitions() > 50
    rows = {r.header_message_id: r for r in got.collect()}
    assert len(rows) == got.count() == 200 and {r.label for r in rows.values()} == {"ham"}
    assert rows["<7@x>"].bodies[0].body == "body 7\nFrom here\n>From there ü" + "y" * 259 + "\n" and rows["<7@x>"].headers["subject"] == ["s7"]
    # one Python pass, and the rows of Spark's own reader of lines
    a = f"file://{tmp_path}/in/a"
    assert got._jdf.queryExecution().toString().count("MapInPandas") == 0
    whole = lambda df: sorted((*r[:7], sorted(r.headers.items()), r.bodies, r.parse_error) for r in df.collect())
    assert whole(mailbox.read_mbox(spark, a)) == whole(mail.read_mbox(spark, a))
    assert mail.read_mbox(spark, a)._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert mailbox.read_mbox(spark, str(tmp_path / "in"), pathGlobFilter="b").count() == 50
    (tmp_path / "none").mkdir()
    assert mailbox.read_mbox(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="absent"):
        mailbox.read_mbox(spark, str(tmp_path / "absent")).count()


class _Stream:
    """Archives, a stream over them that is started anew for each trigger, and what it has given."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.tmp, self.options = spark, tmp_path, options
        (tmp_path / "in").mkdir()

    def add(self, name, data, age=0.0, mode="ab"):
        path = self.tmp / "in" / name
        with open(path, mode) as f:
            f.write(data)
        os.utime(path, (time.time() - age, time.time() - age))

    def run(self):
        rows = mailbox.stream_mbox(self.spark, str(self.tmp / "in"), **self.options).selectExpr("header_message_id as id", "bodies[0].body as body")
        rows.writeStream.format("parquet").option("checkpointLocation", str(self.tmp / "ckpt")).trigger(availableNow=True).start(str(self.tmp / "out")).awaitTermination()
        return sorted(r.id.strip("<>").removesuffix("@x") for r in self.spark.read.schema("id string, body string").parquet(str(self.tmp / "out")).collect())


def test_an_archive_that_grows_gives_each_message_once(spark, tmp_path):
    s = _Stream(spark, tmp_path, settle=3600, rangeBytes=100)
    s.add("a", _box(_mail(1), _mail(2)) + b"From a\nMessage-ID: <3@x>\n\nhalf")
    assert s.run() == ["1", "2"]
    assert s.run() == ["1", "2"]
    s.add("a", b" of it\n\n" + _box(_mail(4)))
    s.add("b", _box(_mail(5)), age=7200)
    assert s.run() == ["1", "2", "3", "5"]
    s.add("a", b"", age=7200)
    s.add("b", _box(_mail(6)))
    assert s.run() == ["1", "2", "3", "4", "5"]
    s.add("b", _box(_mail(7)))
    assert s.run() == ["1", "2", "3", "4", "5", "6"]
    got = {r.id: r.body for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["<3@x>"] == "half of it\n"


def test_archives_that_are_replaced_and_messages_that_go_on(spark, tmp_path):
    s = _Stream(spark, tmp_path, settle=60)
    s.add("a", _box(_mail(1), _mail(2))[:-3], age=100)
    assert s.run() == ["1", "2"]
    # the last message was taken too early: it comes again, whole
    s.add("a", b"xt, continued\n\n" + _box(_mail(3)), age=100)
    assert s.run() == ["1", "2", "2", "3"]
    s.add("a", b"From other\n" + _mail(9), age=100, mode="wb")
    assert s.run() == ["1", "2", "2", "3", "9"]
    os.remove(tmp_path / "in" / "a")
    assert s.run() == ["1", "2", "2", "3", "9"]


def test_screen_over_growing_archives(spark, tmp_path):
    s = _Stream(spark, tmp_path)
    s.add("a", _box(_mail(1), _mail(2)), age=100)

    def run():
        screen_stream(mailbox.stream_mbox(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
        return mail.read_log(spark, str(tmp_path / "log")).select("header_message_id").collect()

    assert len(run()) == 2
    s.add("a", _box(_mail(3)), age=100)
    assert len(run()) == 3
