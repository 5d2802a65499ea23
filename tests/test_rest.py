"""Sources, sinks, streams and hooks that no registered query covers."""

import json
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from phishscreen.functions.dictionaries import BRANDS, Dictionaries
from phishscreen.operators import calibrate, decide, evaluate, features, rules
from phishscreen.plans.screen import reclassify, screen, scored
from phishscreen.sources import mail, sinks
from phishscreen.sources.schemas import MESSAGES
from phishscreen.streaming import screen as streaming

from .test_screen import SAMPLES, answer, frame


def test_brand_table_is_whole():
    assert (len(BRANDS), sum(len(b.keywords) for b in BRANDS), sum(len(b.domains) for b in BRANDS)) == (44, 151, 134)


def test_brands_from_a_table(spark):
    table = spark.createDataFrame([(2, "Tea House", ["tea house"], ["tea.example"]), (1, "Coffee", ["coffee"], ["coffee.example"])], "position int, name string, keywords array<string>, domains array<string>")
    dicts = Dictionaries().with_brands(table)
    assert [b.name for b in dicts.brands] == ["Coffee", "Tea House"]
    with pytest.raises(ValueError):
        Dictionaries().with_brands(table, most=1)
    rows = [("m", {"from": ["Tea House <info@other.example>"], "subject": ["amazon coffee"]}, "x", "", [], 0)]
    got = scored(frame(spark, rows), dicts=dicts).where("msg_key = 'm'").first()
    assert got.brands == ["Coffee", "Tea House"] and got.brands_in_display == ["Tea House"]


def test_read_messages_lowers_header_names(spark, tmp_path):
    rows = [("k", None, "box", None, None, None, None, {"FROM": ["A <a@b.example>"], "Subject": ["x"]}, [("text/plain", "hi")], None), ("n", None, None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, MESSAGES).write.parquet(str(tmp_path / "m"))
    got = {r.msg_key: r.headers for r in mail.read_messages(spark, str(tmp_path / "m")).collect()}
    assert got == {"k": {"from": ["A <a@b.example>"], "subject": ["x"]}, "n": None}


def test_write_and_read_evaluation(spark, tmp_path):
    cases = evaluate.cases(scored(frame(spark, SAMPLES[:2])).where("label is not null"), scored(frame(spark, SAMPLES[2:4])).where("label is not null"))
    run = evaluate.evaluation_run(cases, spark.createDataFrame([answer("tax")], decide.ANSWERS), "r1")
    sinks.write_evaluation(run, str(tmp_path / "e"))
    back = spark.read.parquet(str(tmp_path / "e"))
    assert {r.key: (r.run_id, r.model_score) for r in back.collect()} == {r.key: ("r1", r.model_score) for r in run.collect()}
    assert back.where("model_score is not null").count() == 1


def test_scorer_of_ones_own(spark):
    def ask(batch: pd.DataFrame) -> pd.DataFrame:
        states = [json.loads(x) for x in batch["request"]]
        one = lambda s: {"sender_impersonation": {"noul": 1.0 if "セゾン" in s["from_display_name"] else 0.0, "choice": None, "probabilities": None}}
        return pd.DataFrame({"message_key": batch["msg_key"], "answers": [one(s) for s in states], "usage": [{"input_tokens": 1, "output_tokens": 1}] * len(batch), "model": "own", "error": None})

    from phishscreen.plans.settings import Settings

    requests = scored(frame(spark, SAMPLES)).select("msg_key", F.to_json(decide.build_request(Settings())).alias("request"))
    got = {r.message_key: r.answers["sender_impersonation"].noul for r in decide.ask_with(requests, ask).collect()}
    assert got["card"] == 1.0 and sum(got.values()) == 1.0 and len(got) == len(SAMPLES) + 2


def test_request_volume(spark):
    rows = scored(frame(spark, SAMPLES[:3])).where("msg_key in ('tax', 'card', 'airline')")
    from phishscreen.plans.settings import Settings

    chars = sum(len(r.s) for r in rows.select(F.to_json(decide.build_request(Settings())).alias("s")).collect())
    got = evaluate.request_volume(rows, 1000).first()
    assert (got.cases, got.chars) == (3, chars)
    assert (got.tokens_low, got.tokens_high) == (round((chars + 3000) / 3), round((chars + 3000) / 1.5))
    assert evaluate.request_volume(rows.limit(0), 1000).first().tokens_high == 0


def test_evidence_and_reason(spark):
    answers = spark.createDataFrame([answer("tickets", level=0.5), answer("mention", error="timeout")], decide.ANSWERS)
    out = screen(frame(spark, SAMPLES), answers=answers).withColumn("why", rules.reason_text())
    got = {r.msg_key: r for r in out.collect()}
    assert got["tax"].evidence.consumer_isp_hops == ["p1.ocn.ne.jp"] and got["tax"].evidence.random_from_host and got["tax"].evidence.urgency_hits == ["至急", "差押"]
    assert got["tickets"].why.endswith("second opinion: impersonation 0.50 / credentials 0.50 / pretext 1.00(prize) / ordinary 0.00")
    assert got["mention"].why.endswith("error: timeout") and got["paul"].why == "-"


def test_screen_reads_messages_once(spark, tmp_path):
    frame(spark, SAMPLES).write.parquet(str(tmp_path / "m"))
    answers = spark.createDataFrame([answer("tax")], decide.ANSWERS)
    plan = screen(mail.read_messages(spark, str(tmp_path / "m")), answers=answers)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_reclassify_only_chosen(spark):
    ids = spark.createDataFrame([("tax",), ("paul",), ("tax",), ("nobody",), (None,)], "msg_key string")
    assert {(r.msg_key, r.verdict, r.source) for r in reclassify(frame(spark, SAMPLES), ids).collect()} == {("tax", "spam", "manual"), ("paul", "ham", "manual")}


def test_large_exclusions(spark):
    rows = spark.createDataFrame([("a", "mail.shop.example"), ("b", "shop.example"), ("c", "ashop.example"), ("d", "")], "msg_key string, host string")
    assert {r.msg_key for r in calibrate.exclude_under(rows, "host", spark.createDataFrame([("shop.example",)], "domain string")).collect()} == {"c", "d"}


def test_gray_share_and_estimate(spark):
    cube = spark.createDataFrame([("spam", 40, 1, 3), ("spam", 90, 2, 5), ("ham", 10, 0, 4), ("ham", 36, 1, 1)], "label string, score int, bits bigint, n bigint")
    got = {(r.label, r.gray_low): (r.asked, r.share) for r in calibrate.gray_sweep(cube).collect()}
    assert got["spam", 35] == (3, 3 / 8) and got["spam", 41] == (0, 0.0) and got["ham", 10] == (5, 1.0) and got["ham", 35] == (1, 0.2)
    log = spark.createDataFrame([("spam", f"d{i % 40}") for i in range(200)] + [("ham", "x"), ("spam", "")], "verdict string, from_domain string")
    est = calibrate.sender_estimate(log, "from_domain").first()
    assert est.messages == 200 and abs(est.senders - 40) <= 3


def test_stream_counts_and_repeat_senders(spark, tmp_path):
    """Days that the watermark has passed are final; senders are counted so far."""
    schema = "verdict string, path string, from_domain string, logged_at timestamp"
    day = lambda d, h=1: datetime(2024, 1, d, h)
    first = [("spam", "rules", "a.example", day(1)), ("spam", "failed", "a.example", day(1, 2)), ("ham", "rules", "b.example", day(9)), ("suspect", "rules+model", "", day(9, 2))]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(tmp_path / "log"))

    def run(make, name, mode):
        stream = make(spark.readStream.schema(schema).parquet(str(tmp_path / "log")))
        writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name))
        writer.trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    senders = {(r.from_domain, r.n) for r in run(streaming.repeat_senders, "senders", "complete")}
    assert senders == {("a.example", 2)}
    done = run(streaming.daily_counts, "counts", "append")
    assert [(str(r.day), r.total, r.spam, r.suspect, r.model_calls) for r in done] == [("2024-01-01", 2, 2, 0, 1)]
    plain = {(str(r.day), r.total, r.spam) for r in streaming.daily_counts(spark.createDataFrame(first, schema)).collect()}
    assert plain == {("2024-01-01", 2, 2), ("2024-01-09", 2, 0)}


def test_tables_of_senders_need_no_message_key(spark):
    row = lambda key, address, spf: (key, (address, address.partition("@")[2] if address else address), (spf, "none"))
    mails = [row("k", "a@x.example", "pass"), row("k", "b@sub.Own.example", "fail"), row(None, "a@x.example", "fail"), row(None, "", "fail"), row("n", None, "fail")]
    rows = spark.createDataFrame(mails, "msg_key string, `from` struct<address: string, host: string>, auth struct<spf: string, dkim: string>")
    entries = spark.createDataFrame([("domain", "own.example", 0), ("address", "A@x.example", 1), ("domain", "x.example", 0), ("domain", None, 2)], "kind string, value string, position int")
    got = decide.match_list(rows, entries, "allow", "allowed")
    assert got.columns == [*rows.columns, "allowed"]
    found = {(r["from"].address, r.allowed) for r in got.collect()}
    assert found == {("a@x.example", "allowAddresses: a@x.example"), ("b@sub.Own.example", "allowDomains: own.example"), ("", None), (None, None)}
    assert got.count() == len(mails)
    spoofs = features.mark_self_domains(rows, spark.createDataFrame([("OWN.example",), ("own.example",)], "domain string"))
    assert sorted((str(r["from"].address), r.self_domain_spoof) for r in spoofs.collect()) == [("", False), ("None", False), ("a@x.example", False), ("a@x.example", False), ("b@sub.Own.example", True)]
