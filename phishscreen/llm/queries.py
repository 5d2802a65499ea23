"""The queries of the ten operators over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, contamination, embed_dedup, infill, line_dedup, lm, mixing, ngram_join, phrases, quality, substring_dedup, suffix_dedup, url_filter

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def codec() -> bpe.Codec:
    return bpe.Codec.from_path(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), codec())


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.rates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.size("items").cast("long")
    return out.select("doc_id", "n_words", "n_hit", items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrases.top(phrases.collocations(table(spark, sf_dir, "documents")))
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return infill.digests(infill.transform(infill.frames(docs)))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_RULE_CASES = [
    (f"{h}{p}", h, p, a) for h, p, a in sorted(URL_RULES, key=lambda r: -len(r[0]) - len(r[1]))
]
_FITS = {name: f"((host = '{h}' or host like '%.{h}') and starts_with(path, '{p}'))" for name, h, p, _ in _RULE_CASES}
OP4_SQL = f"""
with rest as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages),
hosts as (select page_id, regexp_extract(r, '^[^/?#]*') as h, r from rest),
parts as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(substr(r, length(h) + 1), '^[^?#]*') as path from hosts)
select page_id, host, path, case {' '.join(f"when {_FITS[n]} then '{n}'" for n, *_ in _RULE_CASES)} end as rule,
  case {' '.join(f"when {_FITS[n]} then '{a}'" for n, _, _, a in _RULE_CASES)} else 'allow' end as verdict
from parts"""


_BLANKS = "chr(32) || chr(9) || chr(11) || chr(12) || chr(13)"
OP10_SQL = f"""
with split as (select doc_id, string_split(text, chr(10)) as ls from documents),
raw as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as lno from split),
marked as (select *, trim(line, {_BLANKS}) as body from raw),
lines as (select *, row_number() over (partition by doc_id order by lno) as nth, len(regexp_split_to_array(body, '[ \t\x0b\x0c\r]+')) as words
  from marked where body <> ''),
runs as (select *, lead(body, 1) over w as b2, lead(body, 2) over w as b3, lead(words, 1) over w as words2 from lines window w as (partition by doc_id order by nth)),
first3 as (select *, row_number() over (partition by body, b2, b3 order by doc_id, nth) as k from runs where b3 is not null),
first2 as (select *, row_number() over (partition by body, b2 order by doc_id, nth) as k from runs
  where words < 50 and words2 < 50 and words + words2 >= 50),
first1 as (select *, row_number() over (partition by body order by doc_id, nth) as k from lines where words >= 50),
gone as (select doc_id, nth + i as nth from first3, range(3) as t(i) where k > 1 union select doc_id, nth + i as nth from first2, range(2) as t(i) where k > 1
  union select doc_id, nth from first1 where k > 1),
judged as (select l.*, g.nth is not null as goes from lines l left join gone g on g.doc_id = l.doc_id and g.nth = l.nth),
starts as (select doc_id, count(*) as n_lines, count(*) filter (goes) as n_removed,
  count(*) filter (goes and not before) as n_runs from (select *, coalesce(lag(goes) over (partition by doc_id order by nth), false) as before from judged) group by doc_id),
followed as (select m.doc_id, m.lno, m.line, coalesce(last_value(j.goes ignore nulls) over (partition by m.doc_id order by m.lno rows between unbounded preceding and current row), false) as goes
  from marked m left join judged j on j.doc_id = m.doc_id and j.lno = m.lno),
kept as (select doc_id, string_agg(line, chr(10) order by lno) as t from followed where not goes group by doc_id)
select d.doc_id, coalesce(s.n_lines, 0)::bigint as n_lines, coalesce(s.n_removed, 0)::bigint as n_removed, coalesce(s.n_runs, 0)::bigint as n_runs, sha256(coalesce(k.t, '')) as kept_sha256
from documents d left join starts s on s.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
OP2_SQL = f"""
with w as (select doc_id, {_WORDS} as ws from documents),
windows as (select doc_id, s, array_to_string(ws[s : s + 19], ' ') as win from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as s from w where len(ws) >= 20)),
later as (select doc_id, s from (select doc_id, s, row_number() over (partition by win order by doc_id, s) as k from windows) where k > 1),
gone as (select distinct doc_id, s + i as nth from later, range(20) t(i)),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as nth from w),
kept as (select doc_id, string_agg(word, ' ' order by nth) as t, count(*) as n from words anti join gone using (doc_id, nth) group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)"""

OP3_SQL = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
blocks as (select doc_id, first, substr(x, 2 * first + 1, 4000) as x from (select doc_id, x, unnest(range(0, length(x) // 2, 1800)) as first from h where x <> '')),
places as (select doc_id, first, x, unnest(range(1, least(1800, length(x) // 2) + 1)) as s from blocks),
marked as (select doc_id, first + s as s, substr(x, 2 * s - 1, 2) as b, case when 2 * s + 398 <= length(x) then md5(substr(x, 2 * s - 1, 400)) end as win from places),
starts as (select doc_id, s, b, win is not null and count(*) over (partition by win) > 1 as again from marked),
judged as (select doc_id, s, b, bool_or(again) over (partition by doc_id order by s rows between 199 preceding and current row) as gone from starts),
edges as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by s), false) as opens from judged),
sums as (select doc_id, count(*) filter (gone) as n, count(*) filter (opens) as spans, string_agg(b, '' order by s) filter (not gone) as kept from edges group by doc_id)
select h.doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from h left join sums using (doc_id)"""

OP8_SQL = f"""
with recursive w as (select doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
grams as (select distinct doc_id, array_to_string(ws[s : s + 3], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as s from w where len(ws) > 0)),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
reach as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b),
least as (select a, min(b) as m from reach group by a)
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) as component_id from w left join sizes using (doc_id) left join least on a = w.doc_id"""


_PLAIN = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = f"""
with d as (select doc_id, regexp_extract_all({_PLAIN}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
b as (select item_id::varchar as item, regexp_extract_all({_PLAIN}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from benchmark),
wins as (select distinct item, array_to_string(ws[s : s + 9], ' ') as win, least(len(ws), 10) as k from (select item, ws, unnest(range(1, greatest(len(ws) - 8, 2))) as s from b where len(ws) > 0)),
sizes as (select distinct k from wins),
places as (select doc_id, k, s, array_to_string(ws[s : s + k - 1], ' ') as win from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as s from d, sizes where len(ws) >= k)),
found as (select doc_id, k, s, item from places join wins using (win, k)),
hit as (select doc_id, count(distinct s + i) as n from (select distinct doc_id, k, s from found) f, range(10) t(i) where i < k group by doc_id),
named as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from found where item is not null) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(m.n, 0)::bigint as n_items, sha256(coalesce(m.items, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from d left join hit h using (doc_id) left join named m using (doc_id)"""


OP12_SQL = f"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_PLAIN}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from p),
totals as (select lang, sum(len(ws)) as n from w group by lang),
places as (select lang, ws, unnest(range(1, len(ws) + 1)) as s from w),
grams as (select lang, array_to_string(ws[s : s + k - 1], ' ') as phrase, k as m from places, range(1, 6) t(k) where s + k - 1 <= len(ws)),
freq as (select lang, phrase, m, count(*) as f from grams group by all having count(*) >= 100),
cuts as (select lang, phrase, m, f as a, unnest(range(1, m)) as k, string_split(phrase, ' ') as ws from freq where m > 1),
scored as (select c.lang, c.phrase, c.m, c.a, c.k, x.f as l, y.f as r, n, (1000::hugeint * a * n) // (x.f::hugeint * y.f) as score from cuts c join totals t on t.lang = c.lang
  join freq x on x.lang = c.lang and x.phrase = array_to_string(ws[1 : k], ' ') join freq y on y.lang = c.lang and y.phrase = array_to_string(ws[k + 1 : c.m], ' ')),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (select distinct lang, array_to_string(ws[i : j], ' ') as phrase, f.f from (select lang, phrase, f, m, string_split(phrase, ' ') as ws from freq where m > 2) f, range(1, 6) x(i), range(1, 6) y(j) where j > i and j <= m and j - i + 1 < m),
left_ as (select b.* from best b where not exists (select 1 from inside i where i.lang = b.lang and i.phrase = b.phrase and 100 * i.f >= 100 * b.a)),
ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from left_)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= 2000"""

_DIGIT = "instr('0123456789abcdef', substr(h, {} + i, 1)) - 1"
OP13_SQL = f"""
with t as (select doc_id, coalesce(text, '') as x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as us, sha256('1:' || doc_id) as h from documents),
d as (select doc_id, x, us, len(us) as n, {", ".join(f"list_sum(list_transform(range(8), lambda i: ({_DIGIT.format(1 + 8 * k)}) * (16 ** (7 - i))::bigint))::bigint as h{k + 1}" for k in range(4))} from t),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from d),
p as (select *, array_to_string(us[1 : a], '') as p, array_to_string(us[a + 1 : b], '') as m, array_to_string(us[b + 1 : n], '') as s from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
  sha256(case form when 'plain' then x when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(x) as restored_sha256 from p"""


def oracle_sql() -> dict[str, str]:
    return {"op12_collocations": OP12_SQL, "op13_fill_in_middle": OP13_SQL, "op11_decontamination": OP11_SQL, "op2_substring_dedup": OP2_SQL, "op3_suffix_dedup": OP3_SQL, "op4_url_filter": OP4_SQL, "op8_ngram_join": OP8_SQL, "op10_line_dedup": OP10_SQL}
