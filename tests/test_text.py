import pytest
from pyspark.sql import functions as F

from phishscreen.functions import text as t


def values(spark, function, inputs):
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, v string")
    return [r.out for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


CASES = [
    (t.registrable_domain, {"sub.a.co.jp": "a.co.jp", "A.Example.COM.": "example.com", "localhost": "localhost", "1.2.3.4": "3.4", "": "", None: "", "a..b.org": "b.org"}),
    (lambda c: t.under_domain(c, F.lit("X.jp")), {"mail.x.jp": True, "x.jp": True, "notx.jp": False, "": False, None: False}),
    (t.looks_unpronounceable, {"fshmjx": True, "hmxdag": True, "shlvchen": True, "abcd": False, "banana": False}),
    (t.looks_random_host, {"ad4ch8896b.example.com": True, "example.com": False, "abc12345": False, "": False}),
    (t.has_vowelless_label, {"jgdyyt.example.com": True, "rwvnra.com": False, "starbucks.com": False}),
    (t.has_random_label, {"info.shlvchen.com": True, "mail.example.com": False}),
    (lambda c: t.match_keyword(c, "au"), {"paul": False, "my au pay": True, "AU": True}),
    (lambda c: t.match_keyword(c, "line"), {"shop.online": False, "line news": True}),
    (lambda c: t.match_keyword(c, "e-tax"), {"e-tax還付": True, "e-taxes": False}),
    (t.strip_invisible, {"お​知‮ら": "お知ら", None: ""}),
    (t.strip_invisible, {"plain": "plain", "": "", "\u00ad\u061c\u200b\u200f\u2060\u2066\u2069\ufeff": "", "\u00ae\u2010\u2029\u2065\u206a\ufefe\U0001f600é": "\u00ae\u2010\u2029\u2065\u206a\ufefe\U0001f600é"}),
    (t.is_blank, {" \u3000\n\ufeff": True, "": True, "  a ": False, "\u200b": False, None: None}),
    (lambda c: t.under_fixed(c, ["X.jp", "", "a-b.org"]), {"mail.x.JP": True, "x.jp": True, "notx.jp": False, "xxjp": False, "x.jp\n": False, "m.a-b.org": True, "": False, None: False}),
    (lambda c: t.under_fixed(c, []), {"x.jp": False}),
    (t.has_bidi, {"a‮b": True, "a‎b": True, "ab": False, None: False}),
    (t.has_zero_width, {"a​b": True, "ab": False}),
    (t.html_to_text, {"<p>a&nbsp;&amp;lt;</p><script>x<b></script>b": "a &lt;\n b", "x&#65;&#12354;&#128512;&#99999999;y": "xAあ😀&#99999999;y", "a<br/>b\n\n\n\nc": "a\nb\n\nc", "　 t　": "t", None: "", "&#39;&quot;": "'\""}),
    (t.hidden_random_text, {'<div style="display : none">abcdefghij0123456789</div>': True, '<html style="opacity:0"><p style="color:red">short</p></html>': False, '<span style="font-size:0">a b<i>cdefgh</i>ijklmnopqrstuv</span>': True, '<div style="max-height:0">' + "x! " * 3000 + "abcdefghij0123456789": False, "<p>abcdefghij0123456789</p>": False}),
    (lambda c: t.auth_results(c).cast("string"), {"mx; SPF = softfail dkim=none dmarc=fail": "{softfail, none, fail}", "": "{, , }", None: "{, , }"}),
    (lambda c: t.parse_address(c).cast("string"), {'"A B" <x@Y.com>': "{A B, x@y.com, y.com}", "A x@y.com": "{A, x@y.com, y.com}", "x@y.com": "{, x@y.com, y.com}", "": "{, , }", None: "{, , }", "n <a@b@C.d >": "{n, a@b@c.d, c.d}", "<>": "{, <>, }"}),
    (t.url_host, {"http://U@a.Example.com:80/x": "a.example.com", "https://b.org?q": "b.org", "ftp://c": "", "http://a_b.c/": "a_b.c"}),
    (lambda c: t.odd_hosts(F.array(c))[0], {"bücher.example": "xn--bcher-kva.example", "a.example": "a.example", "0x7f.1": "127.0.0.1", "017.0.0.1": "15.0.0.1", "1.2.3.4": "1.2.3.4", "3232235521": "192.168.0.1", "1.2.3.256": "", "%61.example": "a.example"}),
    (lambda c: t.decode_encoded_words(c), {"=?iso-2022-jp?B?GyRCJDMkcyRLJEEkTxsoQg==?=": "こんにちは", "=?utf-8?Q?a_=C3=A9?= x": "a é x", "=?nope?B?YQ==?=": "=?nope?B?YQ==?=", "plain": "plain", None: None}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_scalar(spark, case):
    function, expected = CASES[case]
    assert values(spark, function, list(expected)) == list(expected.values())


def test_upstream_headers(spark):
    rows = spark.createDataFrame([("Yes, score=7.5", "", ""), ("No", "", ""), ("", "", "*****"), ("", " YES", "")], "s string, f string, l string")
    got = [tuple(r.u) for r in rows.select(t.upstream_spam(F.col("s"), F.col("f"), F.col("l")).alias("u")).collect()]
    assert got == [(True, 7.5, "Yes, score=7.5"), (False, None, "No"), (True, None, "*****"), (True, None, " YES")]


def test_received(spark):
    rows = spark.createDataFrame([(["from [172.30.157.21] (c-69-180-237-15.hsd1.ga.comcast.net [69.180.237.15]) by Mx.Example.org", "from mx.example.org by a.example.org"],)], "v array<string>")
    r = rows.select(t.received_hosts(F.col("v")).alias("h"), t.received_rdns(F.col("v")).alias("r")).first()
    assert r.h == ["mx.example.org", "a.example.org"] and r.r == ["c-69-180-237-15.hsd1.ga.comcast.net"]


def test_links(spark):
    rows = spark.createDataFrame([('<a HREF = "http://a.b/x">x</a><a href=\'mailto:z\'>', "see https://c.d/e) and http://a.b/x")], "h string, p string")
    r = rows.select(t.links(F.col("h"), F.col("p")).alias("u")).first()
    assert r.u == ["http://a.b/x", "https://c.d/e"]


def test_links_of_texts_with_and_without_urls(spark):
    rows = spark.createDataFrame([(0, None, "HTTP://A.b/c HTTPS:// x"), (1, "<p>", "http:/a"), (2, None, None)], "i int, h string, p string")
    assert [r.u for r in rows.select("i", t.links(F.col("h"), F.col("p")).alias("u")).orderBy("i").collect()] == [["HTTP://A.b/c"], [], []]


def test_bodies_are_not_trimmed_or_searched_where_that_can_change_nothing(spark):
    """Only what a body begins with tells whether it is blank; a text in ASCII has nothing invisible; one without :// has no url."""
    from phishscreen.operators.features import extract_features
    from phishscreen.sources.schemas import MESSAGES

    plan = extract_features(spark.createDataFrame([], MESSAGES)).select("body_text", "urgency_hits", "links", "has_html")._jdf.queryExecution().optimizedPlan().toString()
    assert "trim(body_" not in plan.replace("ltrim(", "") and "octet_length(body_text" in plan and "Contains(body_plain" in plan
