"""Features of a message (F19-F36): three selects, so that each costly expression is computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.dictionaries import Dictionaries
from ..functions.html import html_parts
from ..functions.words import word_hits


def under_any(host: Column, domains: Column) -> Column:
    return F.exists(domains, lambda d: t.under_domain(host, d))


def sender_label_echo(host: Column, domain: Column, return_path: Column, dicts: Dictionaries) -> Column:
    """the first label of the sending host is also the local part of the return path."""
    tail = F.concat(F.lit("."), domain)
    label = F.substring_index(F.substring(host, F.lit(1), F.length(host) - F.length(tail)), ".", 1)
    return (domain != "") & host.endswith(tail) & label.rlike("^[a-z]{4,12}$") & ~label.isin(*dicts.common_labels) & (F.substring_index(return_path, "@", 1) == label)


def author_header() -> Column:
    named = t.header(F.col("headers"), "from")
    return F.when(named != "", named).otherwise(t.text(F.col("meta_author")))


def senders(messages: DataFrame, decode_words: bool = True) -> DataFrame:
    """The different (sender, sender_host) of messages, from headers alone, for look-ups in tables. Equal to from.address and
    from.host of the features, without any other feature."""
    author = t.decode_encoded_words(author_header()) if decode_words else author_header()
    found = messages.select(author.alias("author")).select(t.parse_address(F.col("author")).alias("from"))
    return found.select(F.col("from.address").alias("sender"), F.col("from.host").alias("sender_host")).distinct()


def headers_and_bodies(messages: DataFrame, decode_words: bool = True) -> DataFrame:
    h = F.col("headers")
    word = t.decode_encoded_words if decode_words else (lambda c: c)
    subject = F.when(t.header(h, "subject") != "", t.header(h, "subject")).otherwise(t.text(F.col("meta_subject")))
    kept = [c for c in ("msg_key", "header_message_id", "source_path", "label", "received_at") if c in messages.columns]
    unsub = t.header(h, "list-unsubscribe")
    hosts = F.concat(F.regexp_extract_all(unsub, F.lit(f"(?i)https?://([^/>{t.WS[1:-1]}]+)"), F.lit(1)), F.regexp_extract_all(unsub, F.lit(f"(?i)mailto:[^@>{t.WS[1:-1]}]+@([^,>{t.WS[1:-1]}]+)"), F.lit(1)))
    first = messages.select(
        *kept,
        word(author_header()).alias("author"),
        word(subject).alias("subject"),
        t.parse_address(t.header(h, "reply-to")).alias("reply_to"),
        t.parse_address(t.header(h, "return-path")).alias("return_path"),
        t.header(h, "message-id").alias("message_id"),
        F.lower(F.regexp_extract(t.header(h, "message-id"), f"@([^>{t.WS[1:-1]}]+)>?", 1)).alias("message_id_host"),
        F.transform(hosts, F.lower).alias("list_unsub_hosts"),
        t.header(h, "feedback-id").alias("feedback_id"),
        t.header_all(h, "received").alias("received"),
        t.header(h, "authentication-results").alias("auth_results"),
        t.upstream_spam(t.header(h, "x-spam-status"), t.header(h, "x-spam-flag"), t.header(h, "x-spam-level")).alias("upstream_spam"),
        t.bodies_of(F.col("bodies"), "text/html").alias("body_html"),
        t.bodies_of(F.col("bodies"), "text/plain").alias("body_plain"),
    )
    return first.withColumn("from", t.parse_address(F.col("author")))


def extract_features(messages: DataFrame, dicts: Dictionaries | None = None, decode_words: bool = True) -> DataFrame:
    """F36. Null headers, bodies or values count as empty; no feature is ever null, but for the upstream score."""
    d = dicts or Dictionaries()
    reg = lambda c: t.registrable_domain(c, d.suffixes)
    col, host = F.col, F.col("from.host")
    display = F.col("from.display")
    atomic = headers_and_bodies(messages, decode_words).withColumn("html", html_parts(col("body_html")))
    atomic = atomic.select(
        *[c for c in atomic.columns if c not in ("received", "body_plain", "html")],
        reg(host).alias("from_domain"),
        reg(col("message_id_host")).alias("message_id_domain"),
        F.array_distinct(F.transform("list_unsub_hosts", reg)).alias("list_unsub_domains"),
        F.size("received").alias("received_count"),
        t.received_hosts(col("received")).alias("hops"),
        t.received_rdns(col("received")).alias("rdns"),
        F.when(~t.is_blank(col("body_plain")), col("body_plain")).otherwise(F.coalesce("html.text", F.lit(""))).alias("body_text"),
        F.coalesce("html.hidden", F.lit(False)).alias("hidden_random_text"),
        t.links(col("body_html"), col("body_plain")).alias("links"),
        t.strip_invisible(col("subject")).alias("clean_subject"),
        t.strip_invisible(display).alias("clean_display"),
        t.auth_results(col("auth_results")).alias("auth"),
    )
    atomic = atomic.withColumns({"link_hosts": t.link_hosts(col("links")), "clean_body": t.strip_invisible(col("body_text"))})
    named = atomic.withColumns({
        "words": word_hits(col("clean_display"), col("clean_subject"), col("clean_body"), d),
        "link_domains": F.array_distinct(F.transform("link_hosts", reg)),
    }).select("*", "words.*").drop("words")
    some = F.size("brands") > 0
    foreign = lambda x: (x != "") & ~under_any(x, col("brand_domains"))
    mail = "(?i)^[^@{ws}]+@[^@{ws}]+[.][a-z]{{2,}}$".format(ws=t.WS[1:-1])
    shown = t.trim(display)
    local = F.substring_index(col("from.address"), "@", 1)
    tld = F.substring_index(col("from_domain"), ".", -1)
    out = named.withColumns({
        "brand_matched": some & under_any(host, col("brand_domains")),
        "brand_in_display": F.size("brands_in_display") > 0,
        "foreign_link_domains": F.filter("link_domains", lambda x: foreign(x) & (x != col("from_domain"))),
        "brand_foreign_link_domains": F.when(some, F.filter("link_domains", foreign)).otherwise(t.strings(())),
        "consumer_isp_hops": F.concat(F.filter("hops", lambda x: t.under_fixed(x, d.consumer_lines)), F.filter("rdns", lambda x: x.rlike("|".join(d.residential)) if d.residential else F.lit(False))),
        "has_html": ~t.is_blank(col("body_html")),
        "random_from_host": t.looks_random_host(host),
        "bidi_obfuscation": t.has_bidi(col("subject")) | t.has_bidi(display),
        "zero_width_obfuscation": t.has_zero_width(col("subject")),
        "display_name_is_address": shown.rlike(mail),
        "display_name_is_other_address": shown.rlike(mail) & (F.lower(shown) != col("from.address")),
        "random_local_part": t.looks_unpronounceable(local) | t.looks_random_label(local, 7),
        "unpronounceable_domain": t.looks_unpronounceable(F.substring_index(col("from_domain"), ".", 1)) | t.has_random_label(host),
        "vowelless_domain": t.has_vowelless_label(host),
        "sender_label_echo": sender_label_echo(host, col("from_domain"), col("return_path.address"), d),
        "abused_tld": F.when(tld.isin(*d.abused_tlds), tld).otherwise(F.lit("")),
        "freemail_sender": col("from_domain").isin(*d.freemail),
        "has_japanese": F.concat(col("subject"), F.substring("body_text", 1, 500)).rlike("[ぁ-んァ-ヶ一-龠]"),
    })
    label = lambda c: F.substring_index(c, ".", 1)
    third = F.forall("link_domains", lambda x: F.array_contains("foreign_link_domains", x) & (label(x) != label(col("from_domain"))))
    out = out.withColumns({
        "brand_mismatch": some & ~col("brand_matched"),
        "mention_third_party_links": some & ~col("brand_matched") & ~col("brand_in_display") & (F.size("link_domains") > 0) & third,
    })
    return out.drop("clean_subject", "clean_display", "clean_body", "rdns")


def self_domain_spoof(self_domains) -> Column:
    """an own domain as sender without a passed check. self_domains: the domains, as few as one owns."""
    return t.under_fixed(F.col("from.host"), self_domains) & (F.col("auth.spf") != "pass") & (F.col("auth.dkim") != "pass")


def host_suffixes(host: Column) -> Column:
    """All suffixes of a host on label borders, the longest first: what an equi-join with a list of domains needs."""
    labels = F.split(F.lower(host), "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def mark_self_domains(features: DataFrame, domains: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """F35 with a table of domains of any size: the suffixes of each different host are joined by equality, and hosts that are own
    ones back to the messages. asked: senders() of the same messages, which spares a second run of the features."""
    hosts = features.select(F.col("from.host").alias("own_host")) if asked is None else asked.select(F.col("sender_host").alias("own_host"))
    keyed = hosts.distinct().select("own_host", F.explode(host_suffixes(F.col("own_host"))).alias("domain"))
    own = keyed.join(domains.select(F.lower("domain").alias("domain")).distinct(), "domain", "left_semi").select("own_host").distinct()
    spoof = F.col("own_host").isNotNull() & (F.col("auth.spf") != "pass") & (F.col("auth.dkim") != "pass")
    return features.join(own, F.col("from.host") == F.col("own_host"), "left").withColumn("self_domain_spoof", spoof).drop("own_host")
