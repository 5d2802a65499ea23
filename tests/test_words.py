"""Many words at once, and look-ups of senders that read headers alone."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phishscreen.functions import text as t
from phishscreen.functions import words
from phishscreen.functions.dictionaries import BRANDS, URGENCY, Brand, Dictionaries
from phishscreen.operators import features
from phishscreen.plans.screen import featured, screen
from phishscreen.plans.settings import Settings

from .test_screen import SAMPLES, frame

PATTERNS = [re.compile(t.keyword_pattern(b.keywords)) for b in BRANDS]
PIECES = [*(k.lower() for b in BRANDS for k in b.keywords), *URGENCY, " ", "-", "x", "9", "É", "\n", "au", "pay"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=8).map("".join))
def test_finder_equals_the_patterns(text):
    found = words.Finder(words.brand_words(BRANDS), edges=True)(text)
    assert found == [i for i, p in enumerate(PATTERNS) if p.search(text)]
    assert words.Finder([[p] for p in URGENCY], edges=False)(text) == [i for i, p in enumerate(URGENCY) if p in text]


def test_finder_on_odd_lists():
    assert words.Finder([], edges=True)("x") == [] and words.Finder([[""], []], edges=True)("x") == []
    twice = words.Finder([["tea", "tea"], ["a tea"], ["tea"]], edges=True)
    assert twice("a tea") == [0, 1, 2] and twice("teas") == [] and twice(None) == [] and twice("") == []


def test_cost_does_not_grow_with_the_brands():
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(12))
    many = [*BRANDS, *(Brand(str(i), (name(), name() + " " + name()), ("x.example",)) for i in range(10_000))]
    texts = [" ".join(name() for _ in range(200)) for _ in range(300)]
    few_words, many_words = (words.Finder(words.brand_words(b), edges=True) for b in (BRANDS, many))

    def seconds(find):
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            for x in texts:
                find(x)
            runs.append(time.perf_counter() - start)
        return min(runs)

    assert seconds(many_words) < 10 * seconds(few_words)  # an expression a brand: 228 times


def test_words_beyond_the_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(words, "MOST_BYTES", 10)
    with pytest.raises(ValueError):
        words.find_brands(F.lit("x"), Dictionaries())


def test_find_brands_on_columns(spark):
    rows = spark.createDataFrame([(0, "MY AU PAY and amazon"), (1, None), (2, ""), (3, "paul's online shop")], "i int, v string")
    got = {r.i: r.b for r in rows.select("i", words.find_brands(F.col("v"), Dictionaries()).alias("b")).collect()}
    assert got == {0: ["Amazon", "au/KDDI"], 1: [], 2: [], 3: []}


def test_no_brands_and_no_phrases(spark):
    got = featured(frame(spark, SAMPLES), dicts=Dictionaries(brands=(), urgency=())).select("brands", "brand_domains", "urgency_hits", "brand_mismatch").distinct().collect()
    assert [tuple(r) for r in got] == [([], [], [], False)]


def test_ten_thousand_brands_leave_the_plan_as_it_is(spark):
    many = Dictionaries(brands=tuple(Brand(f"b{i}", (f"brand{i}",), (f"d{i}.example",)) for i in range(10_000)))
    plan = lambda d: featured(frame(spark, SAMPLES), dicts=d)._jdf.queryExecution().optimizedPlan().toString()
    assert abs(len(plan(many)) - len(plan(Dictionaries()))) < 2000


def test_senders_equal_those_of_the_features(spark):
    rows = [*SAMPLES, ("coded", {"from": ["=?utf-8?b?5a6J?= <A@B.Example>"]}, "x", "", [], 0)]
    of = featured(frame(spark, rows)).select(F.col("from.address").alias("sender"), F.col("from.host").alias("sender_host")).distinct()
    got = features.senders(frame(spark, rows))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, of.collect()))


def python_stages(df) -> list[str]:
    """The names of the Python functions of each stage of a plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [" ".join(re.findall(r"\b(read|find|spell|decode)\(", line)) for line in plan.splitlines() if "ArrowEvalPython" in line]


def test_look_ups_run_the_features_once(spark):
    entries = spark.createDataFrame([("domain", "com", 0), ("address", "a@b.example", 1)], "kind string, value string, position int")
    stages = python_stages(screen(frame(spark, SAMPLES), Settings(), allow=entries, block=entries))
    assert sum("find" in x for x in stages) == 1 and sum("read" in x for x in stages) == 1, stages


def test_headers_alone_leave_html_alone(spark):
    whole = python_stages(featured(frame(spark, SAMPLES)))
    assert any("read" in x for x in whole) and any("find" in x for x in whole), whole
    few = python_stages(featured(frame(spark, SAMPLES)).select("msg_key", "auth.spf", "upstream_spam.flagged", "self_domain_spoof"))
    assert not any("read" in x or "find" in x for x in few), few
