"""Scores kept up to date (R34, D14): what the rules found in a message is stored by the message's content, so that mail is read
for features once, however often it comes up in screens, calibrations and evaluations.

The table is a folder of Parquet with folders of versions. A version stands for all that decides which rules fire: their
conditions, dictionaries, own domains, and EDITION for the features' code. Weights are no part of it: scores are made from the
stored hits on reading, under any weights. Old versions stay until their folder is deleted.

Messages alike in all that rules read share one row. Null headers, bodies and values are content like any other. Two updates at
the same time may store a content twice; reading takes one of them, both being equal. An update that fails leaves nothing.
"""

from __future__ import annotations

import re
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.dictionaries import Dictionaries
from ..operators.rules import RULES, raw_ip_rule, rescored, score_by_rules
from ..sources.runs import written
from .screen import featured, settled
from .settings import Settings

#: To be raised whenever a change to features lets other rules fire on the same mail.
EDITION = 1

HITS = "content binary, rule_hits array<struct<id:string,label:string,weight:int>>, version string"


def content() -> Column:
    """A fingerprint of what rules read. Headers are put in order, as a map has none."""
    headers = F.array_sort(F.map_entries("headers"))
    told = F.to_json(F.struct(headers.alias("h"), F.col("bodies").alias("b"), F.col("meta_subject").alias("s"), F.col("meta_author").alias("a")), {"ignoreNullFields": "false"})
    return F.unhex(F.sha2(told, 256))


def version(settings: Settings | None = None, dicts: Dictionaries | None = None, decode_words: bool = True, rules=None) -> str:
    s = settings or Settings()
    # names of a lambda's variables are numbered anew each time
    tests = [(r.id, re.sub(r"\b([a-z]+)_\d+\b", r"\1", str(r.test()))) for r in rules or _rules(s)]
    said = repr((EDITION, sorted(s.self_domains), decode_words, dicts or Dictionaries(), tests))
    return sha256(said.encode()).hexdigest()[:16]


def _rules(s: Settings) -> tuple:
    return tuple(raw_ip_rule() if s.fix_raw_ip and r.id == "rawIpLink" else r for r in RULES)


def _stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    try:
        rows = spark.read.schema(HITS).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], HITS)
    return rows.where(F.col("version") == name).select("content", "rule_hits")


def update(messages: DataFrame, path: str, settings: Settings | None = None, dicts: Dictionaries | None = None, decode_words: bool = True, rules=None) -> int:
    """Adds the hits of content that the table has not yet under this version; gives their number. New content is found by
    fingerprints alone, which are written once; if there is none, no feature is computed. Mail is then narrowed by a join that
    sends the new fingerprints to it where they are few, which is the usual case; into a table without this version no mail is
    joined at all. The messages are made twice, so costly ones should be written first (runs.written)."""
    spark, s = messages.sparkSession, settings or Settings()
    name = version(s, dicts, decode_words, rules)
    # features keep msg_key, so the fingerprint takes its place; it is never null, and a join that knows that makes it only once
    keyed = messages.withColumn("msg_key", F.coalesce(F.hex(content()), F.lit("")))
    known = _stored(spark, path, name).select(F.hex("content").alias("msg_key")).distinct()
    # read back, not made again: a fingerprint takes the whole of a message
    fresh = written(keyed.select("msg_key").distinct().join(known, "msg_key", "left_anti"))
    n = fresh.count()
    if not n:
        return 0
    new = keyed if known.isEmpty() else keyed.join(fresh, "msg_key", "left_semi")
    hits = settled(score_by_rules(featured(new, s, dicts, decode_words), rules or _rules(s)).select("msg_key", "rule_hits"))
    out = hits.groupBy("msg_key").agg(F.first("rule_hits").alias("rule_hits"))
    out.select(F.unhex("msg_key").alias("content"), "rule_hits", F.lit(name).alias("version")).write.mode("append").partitionBy("version").parquet(path)
    return n


def scores(messages: DataFrame, path: str, settings: Settings | None = None, dicts: Dictionaries | None = None, decode_words: bool = True, rules=None, weights: dict[str, int] | None = None) -> DataFrame:
    """The messages' columns but headers and bodies, with rule_hits and score from the table, under other weights if given; both
    null where the table lacks the content."""
    own = rules or _rules(settings or Settings())
    kept = _stored(messages.sparkSession, path, version(settings, dicts, decode_words, rules)).dropDuplicates(["content"])
    slim = messages.withColumn("content", content()).drop("headers", "bodies")
    # points of today's rules, not those of the day on which the hits were stored
    return slim.join(kept, "content", "left").withColumn("score", F.when(F.col("rule_hits").isNotNull(), rescored(F.col("rule_hits"), {**{r.id: r.weight for r in own}, **(weights or {})})))
