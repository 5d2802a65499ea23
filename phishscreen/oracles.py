"""DuckDB SQL for the queries of the mail screen, built as one chain of common table expressions over MAIL_SQL.

It says the same as the Column expressions, in another dialect and with RE2 patterns (no lookahead, no backreference).
"""

from __future__ import annotations

from .functions import dictionaries as D
from .operators.rules import RULES
from .testmail import MAIL_SQL

WS = " \\t\\n\\v\\f\\r"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def among(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def items(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def reg(host: str) -> str:
    labels = f"list_filter(string_split(regexp_replace(lower({host}), '[.]$', ''), '.'), lambda p: p <> '')"
    last = lambda k: f"array_to_string(({labels})[-{k}:], '.')"
    return f"case when len({labels}) <= 2 then array_to_string({labels}, '.') when {last(2)} in {among(D.SUFFIXES)} then {last(3)} else {last(2)} end"


def under(host: str, domain: str) -> str:
    return f"({host} <> '' and {domain} <> '' and (lower({host}) = lower({domain}) or ends_with(lower({host}), '.' || lower({domain}))))"


def under_any(host: str, domains: str) -> str:
    return f"(len(list_filter({domains}, lambda dd: {under(host, 'dd')})) > 0)"


def inner(host: str) -> str:
    return f"string_split(lower({host}), '.')[:-2]"


def some(values: str, test) -> str:
    return f"(len(list_filter({values}, lambda y: {test('y')})) > 0)"


def random_label(x: str, least: int = 8) -> str:
    return f"(regexp_matches({x}, '^[a-z0-9]{{{least},}}$') and regexp_matches({x}, '[a-z]') and regexp_matches({x}, '[0-9]'))"


def unpronounceable(x: str) -> str:
    return f"(regexp_matches({x}, '^[a-z]{{5,20}}$') and (length(regexp_replace({x}, '[^aeiouy]', '', 'g')) / greatest(length({x}), 1) < 0.28 or regexp_matches({x}, '[bcdfghjklmnpqrstvwxz]{{4,}}')))"


def distinct(values: str) -> str:
    """Distinct values in the order of their first places."""
    return f"list_filter({values}, lambda v, i: list_position({values}, v) = i)"


def html_text(html: str) -> str:
    out = html
    for pattern, by in (("(?is)<script\\b[^>]*>.*?</script>", " "), ("(?is)<style\\b[^>]*>.*?</style>", " "), (f"(?i)<br[{WS}]*/?>", "\n"), ("(?i)</(p|div|tr|li|h[1-6])>", "\n"), ("<[^>]+>", " "), ("(?i)&nbsp;", " "), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("&#39;", "'"), ("(?i)&amp;", "&"), ("[ \\t\\x{00a0}]+", " "), ("\\n{3,}", "\n\n")):
        out = f"regexp_replace({out}, {q(pattern)}, {q(by)}, 'g')"
    return f"regexp_replace({out}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def clean(value: str) -> str:
    return f"regexp_replace({value}, '[\\x{{202a}}-\\x{{202e}}\\x{{2066}}-\\x{{2069}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}\\x{{feff}}\\x{{061c}}\\x{{00ad}}]', '', 'g')"


def address(value: str) -> str:
    return f"lower(case when regexp_matches({value}, '<[^>]+>') then trim(regexp_extract({value}, '<([^>]+)>', 1)) else trim({value}) end)"


def host_of(addr: str) -> str:
    return f"case when contains({addr}, '@') then regexp_extract({addr}, '@([^@]*)$', 1) else '' end"


def named(value: str, keyword: str) -> str:
    """Keywords of ASCII letters stand apart from letters and digits, others stand anywhere."""
    low = keyword.lower()
    if not low.isascii():
        return f"contains({value}, {q(low)})"
    spelled = "".join(c if c.isalnum() or c == " " else f"[{c}]" for c in low)
    return f"regexp_matches({value}, {q(f'(^|[^a-z0-9]){spelled}($|[^a-z0-9])')})"


def brands(value: str) -> str:
    cases = ", ".join(f"case when {' or '.join(named(value, k) for k in b.keywords)} then {q(b.name)} end" for b in D.BRANDS)
    return f"list_filter([{cases}], lambda n: n is not null)"


BRAND_DOMAINS = "flatten(list_transform({names}, lambda n: case " + " ".join(f"when n = {q(b.name)} then {items(b.domains)}" for b in D.BRANDS) + " end))"
STYLE = f"display[{WS}]*:[{WS}]*none|visibility[{WS}]*:[{WS}]*hidden|font-size[{WS}]*:[{WS}]*0|opacity[{WS}]*:[{WS}]*0|max-height[{WS}]*:[{WS}]*0"
HOP = "[(][{ws}]*([A-Za-z0-9._-]+[.][A-Za-z]{{2,}})[{ws}]*(?:\\[[0-9A-Fa-f.:]+\\])?[{ws}]*[)]".format(ws=WS)
MAIL_ADDRESS = f"(?i)^[^@{WS}]+@[^@{WS}]+[.][a-z]{{2,}}$"

ATOMS = f"""
select msg_key, label, received_at, source_path, from_h, subject_h as subject, message_id_h as message_id, plain, html,
  trim(regexp_extract(from_h, '(?s)^(.*?)<[^>]+>', 1)) as display, {address('from_h')} as address,
  {address('return_path_h')} as return_path, {address('reply_to_h')} as reply_to,
  lower(regexp_extract(message_id_h, '@([^>{WS}]+)>?', 1)) as message_id_host,
  list_transform(list_concat(regexp_extract_all(unsub_h, '(?i)https?://([^/>{WS}]+)', 1), regexp_extract_all(unsub_h, '(?i)mailto:[^@>{WS}]+@([^,>{WS}]+)', 1)), lambda h: lower(h)) as unsub_hosts,
  list_transform(regexp_extract_all(received_h, '(?:from|by)[{WS}]+([A-Za-z0-9._-]+[.][A-Za-z]{{2,}})', 1), lambda h: lower(h)) as hops0,
  list_transform(regexp_extract_all(received_h, {q(HOP)}, 1), lambda h: lower(h)) as rdns,
  regexp_extract(lower(auth_h), 'spf[{WS}]*=[{WS}]*([a-z]+)', 1) as spf, regexp_extract(lower(auth_h), 'dkim[{WS}]*=[{WS}]*([a-z]+)', 1) as dkim, regexp_extract(lower(auth_h), 'dmarc[{WS}]*=[{WS}]*([a-z]+)', 1) as dmarc,
  regexp_matches(status_h, '(?i)^[{WS}]*yes') or regexp_matches(level_h, '^[*]{{5,}}') as upstream, try_cast(regexp_extract(status_h, '(?i)score=([-0-9.]+)', 1) as double) as upstream_score,
  case when trim(plain) <> '' then plain else {html_text('html')} end as body_text,
  list_concat(regexp_extract_all(html, '(?i)href[{WS}]*=[{WS}]*["'']([^"'']+)["'']', 1), regexp_extract_all(plain, '(?i)https?://[^{WS}<>"'')]+')) as urls0,
  len(list_filter(regexp_extract_all(html, '(?is)<[a-z]+\\b[^>]*(?:{STYLE})[^>]*>([^<]*)', 1), lambda h: regexp_matches(regexp_replace(h, '[{WS}]+', '', 'g'), '[A-Za-z0-9]{{16,}}'))) > 0 as hidden
from mail"""

HOSTS = f"""
select *, {host_of('address')} as host, {host_of('return_path')} as return_host, {host_of('reply_to')} as reply_host, {distinct('hops0')} as hops,
  list_filter({distinct('urls0')}, lambda u: regexp_matches(u, '(?i)^https?:')) as urls, {clean('subject')} as clean_subject, {clean('display')} as clean_display, {clean('body_text')} as clean_body
from atoms"""

NAMED = f"""
select *, {reg('host')} as from_domain, {reg('message_id_host')} as message_id_domain, list_transform(unsub_hosts, lambda h: {reg('h')}) as unsub0,
  {brands("lower(concat_ws(' ', clean_display, clean_subject))")} as brands, {brands('lower(clean_display)')} as shown_brands,
  list_filter(list_transform(urls, lambda u: replace(lower(regexp_replace(regexp_replace(regexp_extract(u, '(?i)^https?:/*([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), 'аmazon.example', 'xn--mazon-3ve.example')), lambda h: h <> '') as link_hosts
from hosts"""

DOMAINS = f"""
select *, {distinct('unsub0')} as unsub_domains, list_transform(link_hosts, lambda h: {reg('h')}) as links0, {BRAND_DOMAINS.format(names='brands')} as brand_domains
from named"""

FLAGS = f"""
select *, {distinct('links0')} as link_domains, len(brands) > 0 and {under_any('host', 'brand_domains')} as brand_matched, len(shown_brands) > 0 as in_display,
  list_concat(list_filter(hops, lambda h: {under_any('h', items(D.CONSUMER_LINES))}), list_filter(rdns, lambda h: regexp_matches(h, {q(D.RESIDENTIAL[0])}))) as consumer_hops,
  list_filter({items(D.URGENCY)}, lambda p: contains(clean_subject, p) or contains(clean_body, p)) as urgency,
  split_part(address, '@', 1) as local, regexp_extract(from_domain, '[^.]*$') as tld
from domains"""

FOREIGN = f"""
select *, list_filter(link_domains, lambda z: z <> '' and z <> from_domain and not {under_any('z', 'brand_domains')}) as foreign_domains,
  case when len(brands) = 0 then [] else list_filter(link_domains, lambda z: z <> '' and not {under_any('z', 'brand_domains')}) end as brand_foreign,
  len(brands) > 0 and not brand_matched as mismatch, from_domain in {among(D.FREEMAIL)} as freemail,
  regexp_matches(subject, '[\\x{{202a}}-\\x{{202e}}\\x{{2066}}-\\x{{2069}}\\x{{200e}}\\x{{200f}}\\x{{061c}}]') or regexp_matches(display, '[\\x{{202a}}-\\x{{202e}}\\x{{2066}}-\\x{{2069}}\\x{{200e}}\\x{{200f}}\\x{{061c}}]') as bidi,
  regexp_matches(subject, '[\\x{{200b}}-\\x{{200d}}\\x{{2060}}\\x{{feff}}]') as zero_width, regexp_matches(display, {q(MAIL_ADDRESS)}) as shows_address,
  {some(inner('host'), random_label)} as random_host, {some(inner('host'), lambda y: f"regexp_matches({y}, '^[b-df-hj-np-tv-z]{{4,20}}$')")} as vowelless,
  {unpronounceable('local')} or {random_label('local', 7)} as random_local, {unpronounceable("split_part(from_domain, '.', 1)")} or {some(inner('host'), unpronounceable)} as unpronounceable,
  ends_with(host, '.' || from_domain) and from_domain <> '' and regexp_matches(split_part(host, '.', 1), '^[a-z]{{4,12}}$') and split_part(host, '.', 1) not in {among(D.COMMON_LABELS)} and split_part(return_path, '@', 1) = split_part(host, '.', 1) as echo,
  regexp_matches(concat(subject, substr(body_text, 1, 500)), '[ぁ-んァ-ヶ一-龠]') as japanese, {under_any('host', items(['pia.co.jp', 'example.com']))} and spf <> 'pass' and dkim <> 'pass' as self_spoof
from flags"""

# the predicates, in the order of the rules
TESTS = (
    "mismatch and in_display", "mismatch and not in_display", "random_host", "hidden", "len(consumer_hops) > 0",
    "message_id_domain <> '' and from_domain <> '' and message_id_domain <> from_domain",
    "len(unsub_domains) > 0 and not list_contains(unsub_domains, from_domain)",
    f"return_host <> '' and from_domain <> '' and not {under('return_host', 'from_domain')}",
    f"reply_host <> '' and from_domain <> '' and not {under('reply_host', 'from_domain')}",
    "mismatch and in_display and len(brand_foreign) > 0", "mismatch and hidden", "len(urgency) >= 2",
    some("link_domains", lambda y: f"contains({y}, 'xn--')"), some("link_domains", lambda y: f"regexp_matches({y}, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$')"),
    "trim(html) <> '' and trim(body_text) = ''", "upstream", "vowelless", "bidi", "zero_width", "self_spoof", "spf = 'fail' or dmarc = 'fail'", "spf = 'softfail'",
    "shows_address", "shows_address and lower(display) <> address", "random_local", "unpronounceable", f"tld in {among(D.ABUSED_TLDS)}",
    "freemail and len(brands) > 0 and not brand_matched", "freemail and japanese and len(link_domains) > 0 and len(foreign_domains) > 0", "echo", "third_party",
    "brand_matched and not freemail",
)
_HITS = ", ".join(f"case when {test} then {{'id': '{r.id}', 'weight': {r.weight}}} end" for r, test in zip(RULES, TESTS, strict=True))
THIRD = "select *, mismatch and not in_display and len(link_domains) > 0 and len(list_filter(link_domains, lambda z: not (list_contains(foreign_domains, z) and split_part(z, '.', 1) <> split_part(from_domain, '.', 1)))) = 0 as third_party from foreigners"
HITS = f"select *, list_filter([{_HITS}], lambda h: h is not null) as hits from thirds"
SCORED = "select *, greatest(0, least(100, coalesce(list_sum(list_transform(hits, lambda h: h.weight)), 0)))::int as score, array_to_string(list_transform(hits, lambda h: h.id), '/') as ids from judged"

CHAIN = f"with mail as ({MAIL_SQL}), atoms as ({ATOMS}), hosts as ({HOSTS}), named as ({NAMED}), domains as ({DOMAINS}), flags as ({FLAGS}), foreigners as ({FOREIGN}), thirds as ({THIRD}), judged as ({HITS}), scored as ({SCORED})"


def chain(select: str, *more: str) -> str:
    """A select over the CTEs of the screen, with further CTEs before it."""
    return ",\n".join([CHAIN, *more]) + "\n" + select
