"""Weighted rules (R1-R35). A rule is a boolean Column and points; its id is its only name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


@dataclass(frozen=True)
class Rule:
    id: str
    weight: int
    label: str
    test: Callable[[], Column]


def _flag(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


def _differs(host: str) -> Callable[[], Column]:
    return lambda: (F.col(host) != "") & (F.col("from_domain") != "") & ~t.under_domain(F.col(host), F.col("from_domain"))


def _filled(name: str) -> Column:
    return F.size(name) > 0


RULES = (
    Rule("brandMismatch", 35, "display name is of an organisation with other domains", lambda: F.col("brand_mismatch") & F.col("brand_in_display")),
    Rule("brandMentionMismatch", 26, "subject mentions an organisation with other domains", lambda: F.col("brand_mismatch") & ~F.col("brand_in_display")),
    Rule("randomFromHost", 15, "sending host looks generated", _flag("random_from_host")),
    Rule("hiddenRandomText", 10, "hidden element holds random text", _flag("hidden_random_text")),
    Rule("consumerIspHop", 15, "came over a consumer line", lambda: _filled("consumer_isp_hops")),
    Rule("messageIdMismatch", 6, "Message-ID is of another domain", lambda: (F.col("message_id_domain") != "") & (F.col("from_domain") != "") & (F.col("message_id_domain") != F.col("from_domain"))),
    Rule("unsubThirdParty", 8, "unsubscribe links are of other domains", lambda: _filled("list_unsub_domains") & F.forall("list_unsub_domains", lambda d: d != F.col("from_domain"))),
    Rule("returnPathMismatch", 6, "Return-Path is of another domain", _differs("return_path.host")),
    Rule("replyToMismatch", 6, "Reply-To is of another domain", _differs("reply_to.host")),
    Rule("brandLinkMismatch", 15, "links lead away from the claimed organisation", lambda: F.col("brand_mismatch") & F.col("brand_in_display") & _filled("brand_foreign_link_domains")),
    Rule("hiddenTextWithBrand", 15, "hidden random text under a claimed organisation", lambda: F.col("brand_mismatch") & F.col("hidden_random_text")),
    Rule("urgency", 10, "two or more phrases press for haste", lambda: F.size("urgency_hits") >= 2),
    Rule("punycodeLink", 10, "a link's domain is punycode", lambda: F.exists("link_domains", lambda d: d.contains("xn--"))),
    Rule("rawIpLink", 12, "a link's domain is a bare address", lambda: F.exists("link_domains", lambda d: d.rlike("^[0-9]{1,3}([.][0-9]{1,3}){3}$"))),
    Rule("noPlainText", 4, "HTML without any text", lambda: F.col("has_html") & t.is_blank(F.col("body_text"))),
    Rule("upstreamSpamFlag", 22, "an earlier filter called it spam", _flag("upstream_spam.flagged")),
    Rule("vowellessDomain", 18, "a label of the sending host has no vowel", _flag("vowelless_domain")),
    Rule("bidiObfuscation", 30, "direction controls in subject or name", _flag("bidi_obfuscation")),
    Rule("zeroWidthObfuscation", 22, "invisible characters in the subject", _flag("zero_width_obfuscation")),
    Rule("selfDomainSpoof", 30, "claims an own domain unproven", _flag("self_domain_spoof")),
    Rule("authFail", 18, "SPF or DMARC failed", lambda: (F.col("auth.spf") == "fail") | (F.col("auth.dmarc") == "fail")),
    Rule("authSoftfail", 12, "SPF failed softly", lambda: F.col("auth.spf") == "softfail"),
    Rule("displayNameIsAddress", 16, "display name is an address", _flag("display_name_is_address")),
    Rule("displayNameIsOtherAddress", 20, "display name is another address", _flag("display_name_is_other_address")),
    Rule("randomLocalPart", 12, "local part looks generated", _flag("random_local_part")),
    Rule("unpronounceableDomain", 16, "domain can't be pronounced", _flag("unpronounceable_domain")),
    Rule("abusedTld", 16, "top-level domain with much abuse", lambda: F.col("abused_tld") != ""),
    Rule("freemailBrand", 20, "organisation claimed from free mail", lambda: F.col("freemail_sender") & _filled("brands") & ~F.col("brand_matched")),
    Rule("freemailJapaneseBulk", 14, "Japanese mail with foreign links from free mail", lambda: F.col("freemail_sender") & F.col("has_japanese") & _filled("link_domains") & _filled("foreign_link_domains")),
    Rule("senderLabelEcho", 18, "host label is the bounce address too", _flag("sender_label_echo")),
    Rule("mentionThirdPartyLinks", 10, "mentions an organisation, links only to strangers", _flag("mention_third_party_links")),
    Rule("brandMatched", -30, "organisation and domain agree", lambda: F.col("brand_matched") & ~F.col("freemail_sender")),
)

IDS = tuple(r.id for r in RULES)
WEIGHTS = {r.id: r.weight for r in RULES}


def clamped(points: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), points)).cast("int")


def raw_ip_rule() -> Rule:
    """The rule on bare addresses as it was meant: on hosts, as registrable domains never are addresses."""
    return Rule("rawIpLink", WEIGHTS["rawIpLink"], "a link's host is a bare address", lambda: F.exists("link_hosts", lambda h: h.rlike("^[0-9]{1,3}([.][0-9]{1,3}){3}$")))


def score_by_rules(features: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule_hits, in rule order, and score. A rule that can't be judged doesn't fire."""
    fired = [F.when(F.coalesce(r.test(), F.lit(False)), F.struct(F.lit(r.id).alias("id"), F.lit(r.label).alias("label"), F.lit(r.weight).alias("weight"))) for r in rules]
    out = features.withColumn("rule_hits", F.filter(F.array(*fired), lambda h: h.isNotNull()))
    return out.withColumn("score", clamped(F.aggregate("rule_hits", F.lit(0), lambda a, h: a + h["weight"])))


def rescored(hits: Column, weights: dict[str, int]) -> Column:
    """The score of stored hits under other weights; rules not named keep their points. No shuffle."""
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]) if weights else F.create_map().cast("map<string,int>")
    return clamped(F.aggregate(hits, F.lit(0), lambda a, h: a + F.coalesce(table[h["id"]], h["weight"])))


def hit_ids(hits: Column, sep: str = "/", positive: bool = False) -> Column:
    own = F.filter(hits, lambda h: h["weight"] > 0) if positive else hits
    return F.array_join(F.transform(own, lambda h: h["id"]), sep)


def explain(scored: DataFrame) -> DataFrame:
    """Adds fired (text) and unfired (ids of rules with positive weight that did not fire)."""
    fired = F.array_join(F.transform("rule_hits", lambda h: F.concat(F.when(h["weight"] > 0, F.lit("+")).otherwise(F.lit("")), h["weight"].cast("string"), F.lit(" "), h["id"])), "; ")
    unfired = F.array_except(t.strings([r.id for r in RULES if r.weight > 0]), F.transform("rule_hits", lambda h: h["id"]))
    return scored.withColumns({"fired": fired, "unfired": F.array_join(unfired, "/")})


def reason_text() -> Column:
    """Why a verdict is what it is: the rules that fired with their points, the second opinion's main values, an error."""
    model, two = F.col("model"), lambda q: F.format_string("%.2f", F.col("model")["detail"][q])
    pretext = F.when(F.coalesce(F.length(model["pretext"]) > 0, F.lit(False)), F.concat(F.lit("("), model["pretext"], F.lit(")"))).otherwise("")
    said = F.concat(F.lit("second opinion: impersonation "), two("sender_impersonation"), F.lit(" / credentials "), two("credential_phishing"), F.lit(" / pretext "), two("phishing_pretext"), pretext, F.lit(" / ordinary "), two("ordinary_business_mail"))
    parts = F.concat(F.transform("rule_hits", lambda h: F.concat(h["label"], F.lit("("), h["weight"].cast("string"), F.lit(")"))), F.array(F.when(model.isNotNull(), said)), F.array(F.when(F.length("error") > 0, F.concat(F.lit("error: "), "error"))))
    parts = F.filter(parts, lambda p: p.isNotNull())
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("-")


def bitmask(hits: Column, ids=IDS) -> Column:
    """Fired rules as bits of a BIGINT, bit i for rule i."""
    table = F.create_map(*[x for i, k in enumerate(ids) for x in (F.lit(k), F.lit(1 << i))])
    return F.aggregate(hits, F.lit(0).cast("bigint"), lambda a, h: a.bitwiseOR(table[h["id"]].cast("bigint")))
