"""Calibration, log, evaluation, sources and sinks on small tables; results against plain Python."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from phishscreen.operators import calibrate, evaluate, loganalytics
from phishscreen.operators.rules import IDS, WEIGHTS
from phishscreen.sources import mail, sinks

HITS = "array<struct<id:string,label:string,weight:int>>"


def scored(spark):
    rows = [(f"m{i}", ("spam", "ham", None)[i % 3], [(IDS[j], "", WEIGHTS[IDS[j]]) for j in range(i % 4)]) for i in range(60)]
    df = spark.createDataFrame(rows, f"msg_key string, label string, rule_hits {HITS}")
    return df.withColumn("score", F.least(F.lit(100), F.aggregate("rule_hits", F.lit(0), lambda a, h: a + h["weight"])))


def test_calibration(spark):
    df = scored(spark)
    plain = [(r.label, r.score) for r in df.collect() if r.label]
    cube = calibrate.cube(df)
    out = {r.label: r for r in calibrate.outcomes(cube).collect()}
    assert out["spam"].caught == sum(x == "spam" and s >= 55 for x, s in plain) and out["ham"].gray == sum(x == "ham" and 35 <= s < 70 for x, s in plain)
    hist = calibrate.histogram(cube).collect()
    assert len(hist) == 22 and sum(r.n for r in hist) == len(plain)
    sweep = {(r.label, r.threshold): r.reached for r in calibrate.threshold_sweep(cube).collect()}
    assert sweep["spam", 55] == out["spam"].caught and sweep["ham", 0] == out["ham"].total
    weights = {r.setting: r.caught for r in calibrate.weight_sweep(cube, calibrate.drop_one_grid()).collect()}
    assert len(weights) == 33 and weights["all"] == out["spam"].caught
    rates = {r.id: r.spam_hits for r in calibrate.rule_rates(cube).collect()}
    assert len(rates) == 32 and rates[IDS[0]] == sum(r.label == "spam" and len(r.rule_hits) > 0 for r in df.collect())


def test_log(spark):
    day = lambda d: datetime(2024, 1, d)
    rows = [("a", "spam", "rules", "X <x@a.net>", "a.net", "old", day(1)), ("b", "spam", "rules", "x@a.net", "a.net", "", day(3)), ("c", "spam", "failed", "y@a.net", "a.net", "new", day(2)), ("d", "spam", "rules", "z@gmail.com", "gmail.com", "s", day(2)), ("e", "spam", "rules", "z@gmail.com", "gmail.com", "s", day(2)), ("f", "ham", "rules+model", "q@b.net", "b.net", "s", day(2)), ("g", "spam", "rules", None, None, None, None)]
    log = spark.createDataFrame(rows, "msg_key string, verdict string, path string, author string, from_domain string, subject string, logged_at timestamp")
    assert [tuple(r) for r in loganalytics.block_candidates(log).collect()] == [("domain", "a.net", 3, "new"), ("address", "x@a.net", 2, "old")]
    assert tuple(loganalytics.summary(log).first()) == (7, 6, 0, 1, 2)
    assert {str(r.day): (r.total, r.spam) for r in loganalytics.daily(log).collect()}["2024-01-02"] == (4, 3)
    assert [r.msg_key for r in loganalytics.recent(log, 2).collect()] == ["b", "c"]
    kept = loganalytics.retained(log.withColumn("source_path", F.lit("box")), 3)
    assert sorted(r.msg_key for r in kept.collect()) == ["b", "c", "d"]


def test_comparison(spark):
    spec = "key string, label string, local_score int, model_score int, final_score int, detail map<string,double>, pretext string, from_domain string, subject string, error string"
    old = spark.createDataFrame([("phish:a:b:50", "phish", 50, 40, 40, {"q": 0.5}, "x", "d", "s", None), ("ham:c:40", "ham", 40, 60, 60, {"q": 0.5}, "", "d", "s", None), ("ham:e:40", "ham", 40, None, None, None, None, "d", "s", "timeout")], spec)
    new = spark.createDataFrame([("phish:a:b:50", "phish", 50, 90, 80, {"q": 0.9}, "x", "d", "s", None), ("ham:c:40", "ham", 40, 10, 20, {}, None, "d", "s", None), ("ham:e:40", "ham", 40, 10, 20, {}, None, "d", "s", None)], spec)
    pairs = evaluate.compare_runs(old, new)
    assert {r.message: r.transition for r in evaluate.transitions(pairs).collect()} == {"a:b": "gained", "c": "fixed"}
    end = evaluate.conclusion(pairs).first()
    assert (end.net_phish, end.net_ham, end.delta, end.noise, end.conclusion) == (1, -1, 100.0, 1, "better")
    assert {(r.run, r.question): r.separation for r in evaluate.question_separation(pairs).collect()} == {("old", "q"): 0.0, ("new", "q"): None}
    assert {r.pretext: r.n for r in evaluate.pretexts(old).where("label = 'ham'").collect()} == {"(none)": 1}


def test_mailboxes_and_files(spark, tmp_path):
    from email.message import EmailMessage

    def message(i, body, **more):
        m = EmailMessage()
        m["From"], m["Subject"], m["Message-ID"], m["Date"] = "Ä b <a@example.com>", f"Grüße {i}", f"<{i}@x>", f"Mon, 0{i} Jan 2024 10:00:00 +0100"
        m.set_content(body)
        for k, v in more.items():
            m.add_alternative(v, subtype=k)
        return m.as_bytes()

    mails = [message(1, "one\nFrom here on\n"), message(2, "zwei ü", html="<p>zwei</p>"), b"Broken\nSubject : x\n\nbody"]
    quoted = [m.replace(b"\nFrom ", b"\n>From ") for m in mails]
    (tmp_path / "box").write_bytes(b"".join(b"From x Mon Jan 1\n" + m.rstrip(b"\n") + b"\n\n" for m in quoted))
    got = {r.header_message_id: r for r in mail.read_mbox(spark, str(tmp_path / "box"), "ham").collect()}
    assert set(got) == {"<1@x>", "<2@x>", ""}
    assert got["<1@x>"].bodies[0].body.rstrip() == "one\nFrom here on" and got["<1@x>"].headers["subject"] == ["Grüße 1"] and got["<1@x>"].label == "ham"
    assert [b.content_type for b in got["<2@x>"].bodies] == ["text/plain", "text/html"] and got["<2@x>"].received_at == datetime(2024, 1, 2, 9)
    assert [r.header_message_id for r in mail.newest(mail.read_mbox(spark, str(tmp_path / "box")), 1).collect()] == ["<2@x>"]
    (tmp_path / "one.eml").write_bytes(mails[1])
    assert mail.read_eml(spark, str(tmp_path)).first().headers["message-id"] == ["<2@x>"]


def test_bodies_in_japanese_charsets():
    raw = b'Content-Type: text/plain; charset="iso-2022-jp"\nSubject: =?Shift_JIS?B?gqA=?=\n =?utf-8?Q?_b?=\n\n' + "至急".encode("iso-2022-jp")
    headers, bodies = mail.parse_message(raw)
    assert headers["subject"] == ["あ b"] and bodies == [("text/plain", "至急")]
    assert mail.parse_message(b"Content-Type: multipart/mixed; boundary=x\n\n--x\nContent-Type: message/rfc822\n\nSubject: y\n\nhidden\n--x--") [1] == []
    assert mail.parse_message(b"") == ({}, [])


def test_sinks(spark, tmp_path):
    row = [("k", 'a "q"\nb', ["X", "Y"], [("r1", "", 1), ("r2", "", 2)], [], "spam", 60, 60, None, "rules", "a@b", "b", None)]
    df = spark.createDataFrame(row, f"msg_key string, subject string, brands array<string>, rule_hits {HITS}, planned_actions array<string>, verdict string, score int, local_score int, model_score int, path string, author string, from_domain string, error string").withColumn("date", F.lit("2024-01-01"))
    log = sinks.logged(df, at=F.to_timestamp(F.lit("2024-01-02 00:00:00")))
    sinks.append_log(log, str(tmp_path / "log"))
    sinks.append_log(log, str(tmp_path / "log"))
    assert mail.read_log(spark, str(tmp_path / "log")).count() == 2
    sinks.write_csv(log, str(tmp_path / "csv"), spreadsheet=True)
    raw = next((tmp_path / "csv").glob("part*")).read_bytes().decode()
    assert raw.startswith("﻿loggedAt,date,") and raw.endswith("\r\n") and '"a ""q"" b","X/Y","r1/r2"' in raw


def test_evaluation_file(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps({"generatedAt": "x", "byKey": {"ham:m:40": {"key": "ham:m:40", "label": "ham", "localScore": 40, "jevScore": 10, "finalScore": 19, "detail": {"q": 0.5}}}}, indent=1))
    r = mail.read_evaluation(spark, str(tmp_path / "run.json"), "r").first()
    assert (r.key, r.model_score, r.detail) == ("ham:m:40", 10, {"q": 0.5})


def test_stream_is_the_batch(spark, tmp_path):
    from phishscreen.plans.screen import screen
    from phishscreen.sources.schemas import MESSAGES
    from phishscreen.streaming.screen import daily_counts, screen_stream

    rows = [(f"m{i}", f"<{i % 4}>", "box", None, datetime(2024, 1, 1, i), None, None, {"from": ["Amazon <a@fshmjx.top>"]}, [], None) for i in range(6)]
    df = spark.createDataFrame(rows, MESSAGES)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = screen_stream(mail.stream_messages(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = mail.read_log(spark, str(tmp_path / "log"))
    batch = {(r.header_message_id, r.verdict, r.score) for r in screen(df).collect()}
    assert {(r.header_message_id, r.verdict, r.score) for r in got.collect()} == batch and got.count() == 4
    assert daily_counts(got).first().total == 4
