"""The whole screen of a table of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import Dictionaries
from ..operators import decide as d
from ..operators.features import extract_features, self_domain_spoof, senders
from ..operators.rules import RULES, raw_ip_rule, score_by_rules
from .settings import Settings


def settled(df: DataFrame) -> DataFrame:
    """The same rows, past a generator of one row each. The optimizer pushes a filter through projections by putting their
    expressions into it, again and again for features of features; it doesn't push it through a generator."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def featured(messages: DataFrame, settings: Settings | None = None, dicts: Dictionaries | None = None, decode_words: bool = True) -> DataFrame:
    """Features without a score. Only those that are read are computed; keep filters on them for scored()."""
    return extract_features(messages, dicts, decode_words).withColumn("self_domain_spoof", self_domain_spoof((settings or Settings()).self_domains))


def scored(messages: DataFrame, settings: Settings | None = None, dicts: Dictionaries | None = None, decode_words: bool = True) -> DataFrame:
    """Features, rule_hits and score. A pure map: nothing is shuffled."""
    s = settings or Settings()
    rules = tuple(raw_ip_rule() if s.fix_raw_ip and r.id == "rawIpLink" else r for r in RULES)
    return settled(score_by_rules(featured(messages, s, dicts, decode_words), rules))


def screen(messages: DataFrame, settings: Settings | None = None, dicts: Dictionaries | None = None, answers: DataFrame | None = None, allow: DataFrame | None = None, block: DataFrame | None = None, decode_words: bool = True) -> DataFrame:
    """Verdicts. Short lists come with the settings, long ones as tables."""
    s = settings or Settings()
    out = scored(messages, s, dicts, decode_words)
    for kind, table, column, addresses, domains in (("allow", allow, "allowed", s.allow_addresses, s.allow_domains), ("block", block, "blocked", s.block_addresses, s.block_domains)):
        out = d.match_list(out, table, kind, column, senders(messages, decode_words)) if table is not None else out.withColumn(column, d.list_reason(kind, addresses, domains))
    return d.decide(d.attach_answers(out, answers, s), s)


def reclassify(messages: DataFrame, ids: DataFrame, **options) -> DataFrame:
    """T5: screens the messages whose msg_key is in ids again, marked as asked for by hand."""
    return screen(messages.join(ids.select("msg_key").distinct(), "msg_key", "left_semi"), **options).withColumn("source", F.lit("manual"))
