"""Sixteen messages of the kinds that a screen meets, with every rule that must fire, and the decisions behind them."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from phishscreen.operators import decide
from phishscreen.operators.rules import IDS, RULES, bitmask, explain, rescored
from phishscreen.plans.screen import screen, scored
from phishscreen.plans.settings import Settings
from phishscreen.sources.schemas import MESSAGES

RUN = "Qw3rty7uiopAsdfgh"


def sample(name, headers, plain="", html="", fired="", score=0):
    return name, {k.lower(): v if isinstance(v, list) else [v] for k, v in headers.items()}, plain, html, fired.split(), score


SAMPLES = [
    sample("tax", {"From": "国税庁 <info@ad4ch8896b.example.org>", "Subject": "至急 差押 のご連絡", "Message-ID": "<1@other.example.net>", "Return-Path": "<b@bounce.example.net>", "List-Unsubscribe": "<https://u.example.net/x>", "Received": ["from p1.ocn.ne.jp by mx.example.jp"]}, "確認", f'<a href="https://pay.example.org/x">x</a><span style="display:none">{RUN}</span>', "brandMismatch randomFromHost hiddenRandomText consumerIspHop messageIdMismatch unsubThirdParty returnPathMismatch brandLinkMismatch hiddenTextWithBrand urgency", 100),
    sample("card", {"From": "セゾンカード <xx9efvig@sgbjcw.example.org>", "Subject": "利用停止 再認証", "Authentication-Results": "mx; spf=softfail dmarc=fail"}, "https://z.example.org/login", "", "brandMismatch brandLinkMismatch urgency vowellessDomain authFail authSoftfail randomLocalPart unpronounceableDomain", 100),
    sample("airline", {"From": "Center <info@example.org>", "Subject": "日本‮航空 至急 失効"}, "x", "", "brandMentionMismatch urgency bidiObfuscation", 66),
    sample("freemail", {"From": '"abc12def@gmail.com" <abc12def@gmail.com>', "Subject": "お得な情報", "Message-ID": "<1@other.example.net>", "Return-Path": "<x@other.example.net>", "Reply-To": "y@other.example.net"}, "こちら http://z.example.org/", "", "messageIdMismatch returnPathMismatch replyToMismatch displayNameIsAddress randomLocalPart freemailJapaneseBulk", 60),
    sample("shop", {"From": "Amazon <qx7kd9zz@fshmjax.top>", "Subject": "至急 凍結"}, "http://login.fshmjax.top/", "", "brandMismatch brandLinkMismatch urgency randomLocalPart unpronounceableDomain abusedTld", 100),
    sample("typosquat", {"From": "JCB <info@shlvchen.com>", "Subject": "本人確認 不正利用", "Message-ID": "<1@m.example.net>", "Return-Path": "<a@m.example.net>"}, "http://shlvchen.com/", "", "brandMismatch messageIdMismatch returnPathMismatch brandLinkMismatch urgency unpronounceableDomain", 88),
    sample("genuine card", {"From": "PayPayカード <info@mail.paypay-card.co.jp>", "Subject": "ご利用のお知らせ"}, "https://www.paypay-card.co.jp/", "", "brandMatched", 0),
    sample("newsletter", {"From": "Film <info@film.example.com>", "Subject": "News", "Message-ID": "<1@esp.example.net>", "Return-Path": "<b@esp.example.net>", "List-Unsubscribe": "<https://esp.example.net/u>"}, "hi", f'<div style="display:none">{RUN}</div>', "hiddenRandomText messageIdMismatch unsubThirdParty returnPathMismatch", 30),
    sample("paul", {"From": "Paul <paul@example.com>", "Subject": "Audible launch"}, "hello", "", "", 0),
    sample("online", {"From": "shop.online <info@example.com>", "Subject": "hello"}, "hello", "", "", 0),
    sample("order", {"From": "Amazon.co.jp <auto@amazon.co.jp>", "Subject": "ご注文"}, "https://www.amazon.co.jp/", "", "brandMatched", 0),
    sample("business", {"From": "Tanaka <tanaka@example.com>", "Subject": "議事録", "Message-ID": "<1@example.com>"}, "添付します", "", "", 0),
    sample("disposable", {"From": "info@kjehuf.cn-dqsb.com", "Subject": "x", "Return-Path": "<kjehuf@kjehuf.cn-dqsb.com>", "X-Spam-Status": "Yes, score=7.5", "Received": ["from [172.30.157.21] (c-69-180-237-15.hsd1.ga.comcast.net [69.180.237.15]) by mx.example.jp"]}, "x", "", "consumerIspHop upstreamSpamFlag senderLabelEcho", 55),
    sample("mention", {"From": "Info <info@example.org>", "Subject": "e-tax 還付", "Message-ID": "<1@m.example.net>"}, "http://zhengli.other-site.net/", "", "brandMentionMismatch messageIdMismatch mentionThirdPartyLinks", 42),
    sample("generic label", {"From": "Mail <mail@mail.example.com>", "Subject": "x", "Return-Path": "<mail@mail.example.com>"}, "x", "", "", 0),
    sample("other address", {"From": '"help@bank.example" <info@example.org>', "Subject": "x"}, "x", "", "displayNameIsAddress displayNameIsOtherAddress", 36),
    sample("look-alike link", {"From": "Info <info@example.org>", "Subject": "x"}, "x", '<a href="http://аmazon.example/">x</a>', "punycodeLink", 10),
    sample("empty page", {"From": "Info <info@example.org>", "Subject": "x"}, "", "<p><br></p>", "noPlainText", 4),
    sample("tickets", {"From": "Pia <info@pia.co.jp>", "Subject": "vポイント", "Message-ID": "<1@esp.example.net>", "Return-Path": "<b@esp.example.net>", "List-Unsubscribe": "<https://esp.example.net/u>"}, "http://t.pia.jp/", "", "brandMentionMismatch messageIdMismatch unsubThirdParty returnPathMismatch", 46),
]


def frame(spark, samples):
    rows = [(n, None, "box", "spam", datetime(2024, 1, 1 + i % 9), None, None, h, [("text/plain", p), ("text/html", x)], None) for i, (n, h, p, x, *_) in enumerate(samples)]
    rows += [("null headers", None, None, None, None, None, None, None, None, None), ("empty", "", "box", None, None, "s", "a <b@c.example>", {}, [], None)]
    return spark.createDataFrame(rows, MESSAGES)


@pytest.fixture(scope="module")
def results(spark):
    return {r.msg_key: r for r in explain(scored(frame(spark, SAMPLES))).withColumns({"bits": bitmask(F.col("rule_hits")), "heavier": rescored(F.col("rule_hits"), {"upstreamSpamFlag": 26})}).collect()}


@pytest.mark.parametrize("case", SAMPLES, ids=lambda s: s[0])
def test_sample(results, case):
    name, _, _, _, fired, score = case
    assert [h.id for h in results[name].rule_hits] == fired
    assert results[name].score == score


def test_rows_without_headers_have_no_hits(results):
    assert results["null headers"].score == 0 and results["empty"].score == 0 and results["empty"]["from"].address == "b@c.example"


def test_hits_add_up(results):
    for r in results.values():
        assert r.score == max(0, min(100, sum(h.weight for h in r.rule_hits)))
        assert r.bits == sum(1 << IDS.index(h.id) for h in r.rule_hits)
        assert r.fired.count(";") == max(0, len(r.rule_hits) - 1)
    assert results["disposable"].heavier == 59 and len(RULES) == 32


def test_raw_address_rule_needs_the_fix(spark):
    one = [sample("ip", {"From": "a@example.com"}, "http://1.2.3.4/x")]
    assert [h.id for h in scored(frame(spark, one)).where("msg_key = 'ip'").first().rule_hits] == []
    assert [h.id for h in scored(frame(spark, one), Settings(fix_raw_ip=True)).where("msg_key = 'ip'").first().rule_hits] == ["rawIpLink"]


def answer(key, ordinary=0.0, error=None, level=1.0):
    q = lambda v, c=None, p=None: (v, c, p)
    answers = None if error else {"sender_impersonation": q(level), "credential_phishing": q(level), "link_domain_mismatch": q(level), "urgency_pressure": q(level), "ordinary_business_mail": q(ordinary), "phishing_pretext": q(None, "none" if level == 0 else "prize")}
    return (key, answers, (100, 10), "m", error)


def test_decisions(spark):
    settings = Settings(allow_addresses=("Info@film.example.com",), block_domains=("example.com", "dqsb.com"), block_addresses=("info@film.example.com",), action="mark_and_move")
    answers = spark.createDataFrame([answer("airline", ordinary=1.0, level=0.0), answer("disposable", level=0.0), answer("mention", level=1.0), answer("tickets", error="timeout"), answer("tax", level=0.0)], decide.ANSWERS)
    got = {r.msg_key: r for r in screen(frame(spark, SAMPLES), settings, answers=answers).collect()}
    view = lambda k: (got[k].verdict, got[k].score, got[k].path)
    assert view("newsletter") == ("ham", 0, "allowlist") and got["newsletter"].reason == "allowAddresses: info@film.example.com"
    assert view("paul") == ("spam", 100, "blocklist") and got["paul"].reason == "blockDomains: example.com" and got["paul"].rule_hits == []
    assert view("airline") == ("ham", 20, "rules+model")  # lowered, as the answer takes it for ordinary
    assert view("disposable") == ("spam", 55, "rules+model")  # kept
    assert view("mention") == ("spam", 83, "rules+model")
    assert view("tickets") == ("suspect", 46, "failed") and got["tickets"].error == "timeout"
    assert view("tax") == ("spam", 100, "rules") and got["tax"].model is None
    assert got["tax"].planned_actions == ["tag:spam", "junk", "move:junk"] and got["tickets"].planned_actions == ["tag:suspect"] and got["order"].planned_actions == []
    assert len(got) == len(SAMPLES) + 2


def test_lists_as_tables_agree_with_literals(spark):
    settings = Settings(allow_addresses=("paul@example.com",), allow_domains=("paypay-card.co.jp", "co.jp"), block_domains=("example.com",))
    table = lambda a, d: spark.createDataFrame([("address", x, i) for i, x in enumerate(a)] + [("domain", x, i) for i, x in enumerate(d)] + [("domain", None, 9)], "kind string, value string, position int")
    pick = lambda df: sorted((r.msg_key, r.verdict, r.reason or "") for r in df.collect())
    plain = screen(frame(spark, SAMPLES), settings)
    joined = screen(frame(spark, SAMPLES), Settings(), allow=table(settings.allow_addresses, settings.allow_domains), block=table((), settings.block_domains))
    assert pick(plain) == pick(joined)


@pytest.mark.parametrize(("choice", "probabilities", "expected"), [("x", {"none": 0.25, "a": 0.1}, 0.75), ("x", {"a": 0.3, "b": 0.4}, 0.7), ("none", None, 0.0), ("prize", None, 1.0), (None, None, 0.0)])
def test_pretext_probability(spark, choice, probabilities, expected):
    rows = spark.createDataFrame([((None, choice, probabilities),)], "a struct<noul:double,choice:string,probabilities:map<string,double>>")
    assert rows.select(decide.pretext_probability(F.col("a")).alias("p")).first().p == pytest.approx(expected)


def test_settings_are_checked():
    for bad in ({"gray_low": 80}, {"spam_threshold": 120}, {"weight_local": 0, "weight_model": 0}, {"action": "shout"}):
        with pytest.raises(ValueError):
            Settings(**bad)
