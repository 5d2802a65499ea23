"""The HTML scanner against the patterns that define it, and its time on hostile bodies."""

import random
import re
import time

import pytest

from phishscreen.functions import html as h

WS = f"[{h.BLANKS}]"


def plain_text(x):
    flags = re.I | re.A
    x = re.sub(r"<(script|style)(?![a-z0-9_])[^>]*>.*?</\1>", " ", x, flags=flags | re.S)
    for pattern, by in ((f"<br{WS}*/?>", "\n"), ("</(p|div|tr|li|h[1-6])>", "\n"), ("<[^>]+>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        x = re.sub(pattern, by, x, flags=flags)
    x = re.sub("&#([0-9]{1,7});", lambda m: chr(int(m[1])) if int(m[1]) < 0xD800 or 0xDFFF < int(m[1]) <= 0x10FFFF else m[0], x)
    x = re.sub("\n{3,}", "\n\n", re.sub("[ \t\u00a0]+", " ", re.sub("&amp;", "&", x, flags=flags)))
    return x.strip(h.BLANKS)


def plain_hidden(x):
    hiding = "|".join(f"{k}{WS}*:{WS}*{v}" for k, v in (("display", "none"), ("visibility", "hidden"), ("font-size", "0"), ("opacity", "0"), ("max-height", "0")))
    tag = rf"<([a-z]+)(?![a-z0-9_])[^>]*(?:{hiding})[^>]*>(?=(.*?)</\1|(.{{0,4000}}))"
    found = [m[2] if m[2] is not None else m[3] for m in re.finditer(tag, x, re.I | re.A | re.S)]
    return any(re.search("[A-Za-z0-9]{16}", re.sub(f"{WS}+", "", plain_text(t))) for t in found)


BITS = ["<div style='display:none'>", "<p style=opacity:0>", "<SPAN style='font-size : 0'>", "</div>", "</p>", "</span>", "<b>", "</b>", "<br>", "<br />", "</tr>", "<script>", "</script>", "<style a>", "</STYLE>", "<scripty>",
        "<a ", "<", ">", "<>", "<1 ", "&nbsp;", "&amp;lt;", "&#65;", "&#0;", "&#55296;", "&#99999999;", "&lt;", "word ", "abcdefgh", "01234567", "qrstuvwx ", "ſ", "　", "\n", "\n\n", " \t", "é", "日本", "<abc style='max-height:0'>", "</a", "</abcd>", "<div", "style='visibility:hidden'", "<x <y style=opacity:0>"]


@pytest.mark.parametrize("seed", range(8))
def test_scanner_is_the_patterns(seed):
    rng, hidden = random.Random(seed), 0
    for _ in range(1500):
        x = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 28)))
        assert h.visible_text(x) == plain_text(x)
        assert h.hides_random_text(x) == plain_hidden(x)
        hidden += plain_hidden(x)
    assert hidden > 40


def test_long_elements_end_after_their_reach():
    for n in (3980, 3984, 3985, 4100):
        x = "<p style='opacity:0'>" + "! " * (n // 2) + "abcdefgh01234567"
        assert h.hides_random_text(x) == plain_hidden(x)


HOSTILE = {
    "open tags": "<a ", "open hidden tags": "<a style=display:none ", "hidden tags": "<a style=display:none>! ", "open scripts": "<script>", "open both": "<script><style>", "script starts": "<script ", "hidden and shut": "<i style=opacity:0>!</b",
    "blanks": " \n", "line breaks": "<br ", "entities": "&#", "brackets": "<", "ends": ">", "closes": "</a", "words": "display ", "hiding": "<p display  :",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_a_hostile_megabyte_is_read_at_once(name):
    x = HOSTILE[name] * (1_000_000 // len(HOSTILE[name]))
    for body in (x, x + ">", x + "</a></script>", "<p style=opacity:0>" + x):
        began = time.time()
        h.visible_text(body)
        h.hides_random_text(body)
        assert time.time() - began < 4


def test_nested_hidden_elements_are_read_once():
    names = ["a" + "".join(chr(98 + int(c)) for c in str(i)) for i in range(10_000)]
    x = "".join(f"<{n} style=opacity:0>! " for n in names) + "".join(f"</{n}>" for n in reversed(names))
    began = time.time()
    assert not h.hides_random_text(x) and h.hides_random_text(x.replace("! </", "! abcdefgh 01234567</", 1))
    assert time.time() - began < 4


def test_html_columns_read_a_body_once(spark):
    rows = spark.createDataFrame([(1, "<p style='opacity:0'>abcdefgh01234567</p>a&amp;b"), (2, None), (3, ""), (4, "<a " * 300_000)], "k int, html string")
    from pyspark.sql import functions as F

    out = rows.select("k", h.html_to_text(F.col("html")).alias("text"), h.hidden_random_text(F.col("html")).alias("hidden"))
    assert {r.k: (r.text[:30], r.hidden) for r in out.collect()} == {1: ("abcdefgh01234567\na&b", True), 2: ("", False), 3: ("", False), 4: ("<a <a <a <a <a <a <a <a <a <a ", False)}
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
