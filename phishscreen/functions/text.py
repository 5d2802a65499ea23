"""Scalar expressions over addresses, hosts, headers and HTML (F1-F18). Plain Column expressions; the two helpers that
need Python (leftover encoded words, odd hosts) get null input on rows that don't need them; HTML is in html.py."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dictionaries import SUFFIXES
from .html import BLANKS, hidden_random_text, html_to_text  # noqa: F401  F6 and F8 belong here as well
from .rows import by_row

#: White space as browsers see it, wider than Java's.
WS = "[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
BIDI = "[\\u202a-\\u202e\\u2066-\\u2069\\u200e\\u200f\\u061c]"
ZERO_WIDTH = "[\\u200b-\\u200d\\u2060\\ufeff]"
#: The wide range first: most characters are below it, and are not compared with the others.
INVISIBLE = "[\\u00ad-\\ufeff&&[\\u202a-\\u202e\\u2066-\\u2069\\u200b-\\u200f\\u2060\\ufeff\\u061c\\u00ad]]"
STRINGS = T.ArrayType(T.StringType())


def text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast(STRINGS)


def trim(col: Column) -> Column:
    """Without white space at both ends, found from the ends: a pattern would scan every run of blanks inside."""
    return F.btrim(col, F.lit(BLANKS))


def is_blank(col: Column) -> Column:
    """Nothing but white space. A body is read up to its first other character only."""
    return F.ltrim(col, F.lit(BLANKS)) == ""


def registrable_domain(host: Column, suffixes=SUFFIXES) -> Column:
    """the last two labels, or three if the last two are a public suffix."""
    labels = F.filter(F.split(F.regexp_replace(F.lower(text(host)), "[.]$", ""), "[.]"), lambda x: x != "")
    last = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    return F.when(F.size(labels) <= 2, F.array_join(labels, ".")).when(last(2).isin(*suffixes), last(3)).otherwise(last(2))


def under_domain(host: Column, domain: Column) -> Column:
    """the host is the domain or below it, case aside; false if one is empty."""
    h, d = F.lower(text(host)), F.lower(text(domain))
    return (h != "") & (d != "") & ((h == d) | h.endswith(F.concat(F.lit("."), d)))


def under_fixed(host: Column, domains) -> Column:
    """F2 for any of some fixed domains: one pattern, in place of a walk over all of them for each host."""
    named = "|".join(re.escape(d.lower()) for d in domains if d)
    return F.lower(text(host)).rlike(f"(?:^|[.])(?:{named})\\z") if named else F.lit(False)


def parse_address(value: Column) -> Column:
    """STRUCT<display, address, host> of an address header."""
    raw = trim(text(value))
    angle = raw.rlike("<[^>]+>")
    before = F.regexp_extract(raw, "(?s)^(.*?)<[^>]+>", 1)
    quoted = trim(F.regexp_replace(trim(before), '(?s)^"(.*)"$', "$1"))
    loose = ~angle & raw.rlike(WS) & raw.contains("@")
    token = text(F.try_element_at(F.filter(F.split(raw, f"{WS}+"), lambda t: t.contains("@")), F.lit(1)))
    at = F.instr(raw, token)
    rest = F.concat(F.substring(raw, F.lit(1), at - 1), F.substring(raw, at + F.length(token), F.length(raw)))
    address = F.when(angle, trim(F.regexp_extract(raw, "<([^>]+)>", 1))).when(loose, F.regexp_replace(token, "^[<(]|[>)]$", "")).otherwise(raw)
    display = F.when(angle, quoted).when(loose, trim(rest)).otherwise(F.lit(""))
    host = F.when(address.contains("@"), F.regexp_replace(F.lower(F.substring_index(address, "@", -1)), f">|{WS}", "")).otherwise(F.lit(""))
    return F.struct(display.alias("display"), F.lower(address).alias("address"), host.alias("host"))


def header(headers: Column, name: str) -> Column:
    """the first value, or an empty string."""
    return text(F.try_element_at(headers[name], F.lit(1)))


def header_all(headers: Column, name: str) -> Column:
    return F.coalesce(headers[name], F.array().cast(STRINGS))


def bodies_of(bodies: Column, kind: str) -> Column:
    """all bodies of a content type, joined by line breaks."""
    own = F.filter(F.coalesce(bodies, F.array().cast("array<struct<content_type:string,body:string>>")), lambda b: F.lower(text(b["content_type"])).startswith(kind) & (text(b["body"]) != ""))
    return F.array_join(F.transform(own, lambda b: b["body"]), "\n")


def links(html: Column, plain: Column) -> Column:
    """distinct http(s) urls, those of href attributes first."""
    hrefs = F.regexp_extract_all(text(html), F.lit(f"(?i)href{WS}*={WS}*[\"']([^\"']+)[\"']"), F.lit(1))
    bare = F.regexp_extract_all(text(plain), F.lit("(?i)https?://[^\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff<>\"')]+"), F.lit(0))
    # a text without :// is not made a Java string and searched
    bare = F.when(text(plain).contains("://"), bare).otherwise(F.array().cast(STRINGS))
    return F.filter(F.array_distinct(F.concat(hrefs, bare)), lambda u: u.rlike("(?i)^https?:"))


def url_host(url: Column) -> Column:
    """The lower-case host of an http(s) url without user and port; empty if there is none."""
    rest = F.regexp_extract(url, "(?i)^https?:[/\\\\]*([^/\\\\?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(rest, "^.*@", ""), ":[0-9]*$", ""))


def spelled_host(host: str) -> str:
    """A host with escapes, other than ASCII letters, or numbers for an address, as browsers spell it; empty if it is none."""
    from urllib.parse import unquote

    try:
        host = unquote(host, errors="strict").encode("idna").decode("ascii").lower().rstrip(".") if not host.isascii() or "%" in host else host
    except UnicodeError:
        return ""
    parts = host.split(".")
    if not 1 <= len(parts) <= 4 or not all(re.fullmatch("0x[0-9a-f]*|[0-9]+", p) for p in parts):
        return host
    try:
        numbers = [int(p[2:] or "0", 16) if p.startswith("0x") else int(p, 8) if p.startswith("0") and p != "0" else int(p) for p in parts]
    except ValueError:
        return ""
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(parts)):
        return ""
    whole = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(whole >> k & 255) for k in (24, 16, 8, 0))


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def odd_hosts(hosts: Column) -> Column:
    """V2: an array of hosts, odd ones as browsers spell them. Only arrays that hold one go to Python."""

    @F.arrow_udf("array<string>")
    def spell(values: pa.Array) -> pa.Array:
        return by_row(lambda hosts: None if hosts is None else [spelled_host(h) for h in hosts], [values], pa.list_(pa.string()))

    odd = F.exists(hosts, lambda h: h.rlike("[^\\x00-\\x7f]|%|^(?:0x[0-9a-f]*|[0-9]+)(?:[.](?:0x[0-9a-f]*|[0-9]+)){0,3}$") & ~h.rlike(f"^{_OCTET}(?:[.]{_OCTET}){{3}}$"))
    return F.when(odd, spell(F.when(odd, hosts))).otherwise(hosts)


def link_hosts(urls: Column) -> Column:
    return F.array_distinct(F.filter(odd_hosts(F.transform(urls, url_host)), lambda h: h != ""))


def inner_labels(host: Column) -> Column:
    """All labels but the last."""
    labels = F.split(F.lower(text(host)), "[.]")
    return F.slice(labels, 1, F.size(labels) - 1)


def looks_random_label(label: Column, least: int = 8) -> Column:
    return label.rlike(f"^(?=.*[a-z])(?=.*[0-9])[a-z0-9]{{{least},}}$")


def looks_random_host(host: Column) -> Column:
    """F9."""
    return F.exists(inner_labels(host), lambda x: looks_random_label(x))


def looks_unpronounceable(label: Column) -> Column:
    """few vowels, or four consonants in a row."""
    vowels = F.length(F.regexp_replace(label, "[^aeiouy]", ""))
    return label.rlike("^[a-z]{5,20}$") & ((vowels / F.greatest(F.length(label), F.lit(1)) < 0.28) | label.rlike("[bcdfghjklmnpqrstvwxz]{4,}"))


def has_random_label(host: Column) -> Column:
    """F11."""
    return F.exists(inner_labels(host), looks_unpronounceable)


def has_vowelless_label(host: Column) -> Column:
    """F12."""
    return F.exists(inner_labels(host), lambda x: x.rlike("^[b-df-hj-np-tv-z]{4,20}$"))


def strip_invisible(col: Column) -> Column:
    """F13. Texts in ASCII hold none and are left as they are."""
    value = text(col)
    return F.when(F.octet_length(value) == F.char_length(value), value).otherwise(F.regexp_replace(value, INVISIBLE, ""))


def has_bidi(col: Column) -> Column:
    """F14."""
    return text(col).rlike(BIDI)


def has_zero_width(col: Column) -> Column:
    return text(col).rlike(ZERO_WIDTH)


def upstream_spam(status: Column, flag: Column, level: Column) -> Column:
    """STRUCT<flagged, score, raw> of the headers that an earlier filter left."""
    flagged = status.rlike(f"(?i)^{WS}*yes") | flag.rlike(f"(?i)^{WS}*yes") | level.rlike("^[*]{5,}")
    score = F.regexp_extract(status, "(?i)score=([-0-9.]+)", 1).try_cast("double")
    raw = F.when(status != "", status).when(flag != "", flag).otherwise(level)
    return F.struct(flagged.alias("flagged"), score.alias("score"), raw.alias("raw"))


CHARSETS = {"iso-8859-1": "cp1252", "us-ascii": "cp1252", "latin1": "cp1252", "shift_jis": "cp932", "gb2312": "gbk", "euc-kr": "cp949"}


def decode_words(value: str) -> str:
    """Encoded words in a header as text; what can't be decoded stays as it is."""
    import base64
    import binascii
    import quopri

    def one(m: re.Match) -> str:
        charset, kind, payload = m.group(1).lower(), m.group(2).lower(), m.group(3)
        try:
            if kind == "b":
                payload = re.sub("[^A-Za-z0-9+/]", "", payload)
                raw = base64.b64decode(payload + "=" * (-len(payload) % 4))
            else:
                raw = quopri.decodestring(payload.encode("latin-1", "replace"), header=True)
            return raw.decode(CHARSETS.get(charset, charset), "replace")
        except (LookupError, ValueError, binascii.Error):
            return m.group(0)

    return re.sub(r"=\?([^?]+)\?([BbQq])\?([^?]*)\?=", one, re.sub(r"\?=\s+=\?", "?==?", value))


def decode_encoded_words(col: Column) -> Column:
    """F16 with V1b: only values that hold an encoded word go to Python."""

    @F.arrow_udf("string")
    def decode(values: pa.Array) -> pa.Array:
        return by_row(lambda v: None if v is None else decode_words(v), [values], pa.string())

    has = col.contains("=?")
    return F.when(has, decode(F.when(has, col))).otherwise(col)


def auth_results(value: Column) -> Column:
    """STRUCT<spf, dkim, dmarc>."""
    low = F.lower(text(value))
    return F.struct(*[F.regexp_extract(low, f"{k}{WS}*={WS}*([a-z]+)", 1).alias(k) for k in ("spf", "dkim", "dmarc")])


def keyword_pattern(keywords) -> str:
    """one pattern for some keywords. ASCII ones need neighbours that are no letters or digits."""
    quote = lambda k: "".join(c if c.isalnum() or ord(c) > 127 else f"[{c}]" if c not in "^\\" else f"\\{c}" for c in k.lower())
    ascii_, other = [quote(k) for k in keywords if k.isascii() and k], [quote(k) for k in keywords if not k.isascii()]
    return "|".join([*([f"(?:^|[^a-z0-9])(?:{'|'.join(ascii_)})(?:$|[^a-z0-9])"] if ascii_ else []), *other])


def match_keyword(col: Column, keyword: str) -> Column:
    return F.lower(text(col)).rlike(keyword_pattern([keyword])) if keyword else F.lit(False)


def distinct_hosts(values: Column, pattern: str) -> Column:
    return F.array_distinct(F.flatten(F.transform(values, lambda v: F.transform(F.regexp_extract_all(text(v), F.lit(pattern), F.lit(1)), F.lower))))


def received_hosts(values: Column) -> Column:
    """F21."""
    return distinct_hosts(values, f"(?:from|by){WS}+([A-Za-z0-9._-]+[.][A-Za-z]{{2,}})")


def received_rdns(values: Column) -> Column:
    """names in parentheses."""
    return distinct_hosts(values, f"[(]{WS}*([A-Za-z0-9._-]+[.][A-Za-z]{{2,}}){WS}*(?:\\[[0-9A-Fa-f.:]+\\])?{WS}*[)]")
