"""The registered queries of the mail screen over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.dictionaries import FREEMAIL
from ..operators import calibrate, decide, evaluate, features, loganalytics, rules
from ..oracles import chain, html_text, reg
from ..sources import mail as sources
from ..sources import mailbox, runs, sinks
from ..testmail import MAIL_SQL, mail_view, messages
from . import kept
from . import screen as plan
from .settings import Settings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SELF = ("pia.co.jp", "example.com")
ALLOW_ADDRESSES, ALLOW_DOMAINS = ("info@mail.example.com",), ("rakuten.co.jp",)
BLOCK_ADDRESSES, BLOCK_DOMAINS = ("sales@pia.co.jp", "info@mail.example.com"), ("cn-dqsb.com", "com")
SETTINGS = Settings(self_domains=SELF, action="mark_and_move")
LISTED = Settings(self_domains=SELF, action="mark_and_move", allow_addresses=ALLOW_ADDRESSES, allow_domains=ALLOW_DOMAINS, block_addresses=BLOCK_ADDRESSES, block_domains=BLOCK_DOMAINS)


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def joined(col, sep: str = "/") -> Column:
    return F.array_join(col, sep)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.scored(messages(mail_view(spark, sf_dir)), SETTINGS)


def scored_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of labelled messages alone: no filter on labels gets behind the scores, so it has to stand before them."""
    return plan.scored(messages(mail_view(spark, sf_dir).where("label is not null")), SETTINGS)


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.featured(messages(mail_view(spark, sf_dir)), SETTINGS)


def slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_labelled(spark, sf_dir).select("msg_key", "label", "score", "rule_hits", "from_domain", "subject", "source_path", "received_at")


# --- sources and scalar functions -------------------------------------------------------------------------------------


@query(f"with mail as ({MAIL_SQL}) select msg_key, label, source_path, from_h, subject_h, unsub_h, length(plain) as plain_n, length(html) as html_n from mail")
def mail_messages(spark, sf_dir):
    return mail_view(spark, sf_dir).select("msg_key", "label", "source_path", "from_h", "subject_h", "unsub_h", F.length("plain").cast("bigint").alias("plain_n"), F.length("html").cast("bigint").alias("html_n"))


@query(f"with h as (select page_id, regexp_extract(url, '://([^/?#]*)', 1) as host from pages) select page_id, host, {reg('host')} as domain, host = 'example.org' or ends_with(host, '.example.org') as under_org from h")
def registrable_domain(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return pages.select("page_id", "host", t.registrable_domain(F.col("host")).alias("domain"), t.under_domain(F.col("host"), F.lit("example.org")).alias("under_org"))


@query(f"select page_id, md5({html_text('html')}) as text_md5 from pages")
def html_to_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(t.html_to_text(F.col("html"))).alias("text_md5"))


@query(chain("select msg_key, display, address, host, from_domain, return_host, reply_host from scored"))
def parse_address(spark, sf_dir):
    return featured(spark, sf_dir).select("msg_key", F.col("from.display").alias("display"), F.col("from.address").alias("address"), F.col("from.host").alias("host"), "from_domain", F.col("return_path.host").alias("return_host"), F.col("reply_to.host").alias("reply_host"))


@query(chain("select msg_key, array_to_string(urls, ' ') as urls, array_to_string(link_domains, '/') as link_domains, array_to_string(foreign_domains, '/') as foreign_domains, array_to_string(brand_foreign, '/') as brand_foreign from scored"))
def extract_links(spark, sf_dir):
    return featured(spark, sf_dir).select("msg_key", joined("links", " ").alias("urls"), joined("link_domains").alias("link_domains"), joined("foreign_link_domains").alias("foreign_domains"), joined("brand_foreign_link_domains").alias("brand_foreign"))


@query(chain("select msg_key, random_host, vowelless, unpronounceable, random_local, echo, tld from scored"))
def host_shapes(spark, sf_dir):
    return featured(spark, sf_dir).select("msg_key", F.col("random_from_host").alias("random_host"), F.col("vowelless_domain").alias("vowelless"), F.col("unpronounceable_domain").alias("unpronounceable"), F.col("random_local_part").alias("random_local"), F.col("sender_label_echo").alias("echo"), F.substring_index("from_domain", ".", -1).alias("tld"))


@query(chain("select msg_key, clean_subject, bidi, zero_width, hidden, md5(body_text) as body_md5 from scored"))
def hidden_characters(spark, sf_dir):
    return featured(spark, sf_dir).select("msg_key", t.strip_invisible(F.col("subject")).alias("clean_subject"), F.col("bidi_obfuscation").alias("bidi"), F.col("zero_width_obfuscation").alias("zero_width"), F.col("hidden_random_text").alias("hidden"), F.md5("body_text").alias("body_md5"))


@query(chain("select msg_key, spf, dkim, dmarc, upstream, upstream_score, self_spoof from scored"))
def auth_and_upstream(spark, sf_dir):
    return featured(spark, sf_dir).select("msg_key", "auth.spf", "auth.dkim", "auth.dmarc", F.col("upstream_spam.flagged").alias("upstream"), F.col("upstream_spam.score").alias("upstream_score"), F.col("self_domain_spoof").alias("self_spoof"))


@query(chain("select msg_key, array_to_string(hops, '/') as hops, array_to_string(consumer_hops, '/') as consumer_hops, message_id_host, message_id_domain, array_to_string(unsub_domains, '/') as unsub_domains from scored"))
def delivery_path(spark, sf_dir):
    return featured(spark, sf_dir).select("msg_key", joined("hops").alias("hops"), joined("consumer_isp_hops").alias("consumer_hops"), "message_id_host", "message_id_domain", joined("list_unsub_domains").alias("unsub_domains"))


@query(chain("select msg_key, array_to_string(brands, '/') as brands, array_to_string(shown_brands, '/') as shown_brands, brand_matched, mismatch, third_party, array_to_string(urgency, '/') as urgency, freemail, japanese, shows_address from scored"))
def brands_and_urgency(spark, sf_dir):
    return featured(spark, sf_dir).select("msg_key", joined("brands").alias("brands"), joined("brands_in_display").alias("shown_brands"), "brand_matched", F.col("brand_mismatch").alias("mismatch"), F.col("mention_third_party_links").alias("third_party"), joined("urgency_hits").alias("urgency"), F.col("freemail_sender").alias("freemail"), F.col("has_japanese").alias("japanese"), F.col("display_name_is_address").alias("shows_address"))


# --- rules and decisions ----------------------------------------------------------------------------------------------


@query(chain("select msg_key, score, ids from scored"))
def rule_hits(spark, sf_dir):
    return scored(spark, sf_dir).select("msg_key", "score", rules.hit_ids(F.col("rule_hits")).alias("ids"))


@query(chain("select msg_key, greatest(0, least(100, coalesce(list_sum(list_transform(hits, lambda h: case h.id when 'upstreamSpamFlag' then 26 when 'brandMatched' then 0 else h.weight end)), 0)))::int as score from scored"))
def rescore(spark, sf_dir):
    return scored(spark, sf_dir).select("msg_key", rules.rescored(F.col("rule_hits"), {"upstreamSpamFlag": 26, "brandMatched": 0}).alias("score"))


@query(chain("select msg_key, array_to_string(list_transform(hits, lambda h: concat(case when h.weight > 0 then '+' else '' end, h.weight, ' ', h.id)), '; ') as fired, len(list_filter(hits, lambda h: h.weight > 0)) as n_positive, 31 - len(list_filter(hits, lambda h: h.weight > 0)) as n_unfired from scored"))
def explain(spark, sf_dir):
    out = rules.explain(scored(spark, sf_dir))
    return out.select("msg_key", "fired", F.size(F.filter("rule_hits", lambda h: h["weight"] > 0)).cast("bigint").alias("n_positive"), F.size(F.split("unfired", "/")).cast("bigint").alias("n_unfired"))


def _list_sql(kind: str, addresses, domains) -> str:
    cases = [f"when address = '{a}' then '{kind}Addresses: {a}'" for a in addresses] + [f"when host = '{d}' or ends_with(host, '.{d}') then '{kind}Domains: {d}'" for d in domains]
    return f"case {' '.join(cases)} end"


LISTS_SQL = f"lists as (select *, {_list_sql('allow', ALLOW_ADDRESSES, ALLOW_DOMAINS)} as allowed, {_list_sql('block', BLOCK_ADDRESSES, BLOCK_DOMAINS)} as blocked from scored)"


def list_table(spark: SparkSession, addresses, domains) -> DataFrame:
    rows = [("address", a, i) for i, a in enumerate(addresses)] + [("domain", d, i) for i, d in enumerate(domains)]
    return spark.createDataFrame(rows, "kind string, value string, position int")


@query(chain("select msg_key, allowed, blocked from lists", LISTS_SQL))
def match_lists(spark, sf_dir):
    asked = features.senders(messages(mail_view(spark, sf_dir)))
    out = decide.match_list(featured(spark, sf_dir), list_table(spark, ALLOW_ADDRESSES, ALLOW_DOMAINS), "allow", "allowed", asked)
    return decide.match_list(out, list_table(spark, BLOCK_ADDRESSES, BLOCK_DOMAINS), "block", "blocked", asked).select("msg_key", "allowed", "blocked")


@query(chain("select msg_key, score from scored where score >= 35 and score < 70"))
def gray_zone(spark, sf_dir):
    return scored(spark, sf_dir).where(decide.in_gray(SETTINGS)).select("msg_key", "score")


@query(chain("select msg_key, display as from_display_name, return_host as return_path_domain, array_to_string(hops[:12], '/') as delivery_path_hosts, array_to_string(link_domains[:20], '/') as link_domains, md5(substr(regexp_replace(body_text, '[ \\t\\n\\v\\f\\r]+\\n', chr(10), 'g'), 1, 1500)) as body_md5 from scored"))
def second_opinion_request(spark, sf_dir):
    r = F.col("r")
    out = scored(spark, sf_dir).select("msg_key", decide.build_request(SETTINGS).alias("r"))
    return out.select("msg_key", r["from_display_name"].alias("from_display_name"), r["return_path_domain"].alias("return_path_domain"), joined(r["delivery_path_hosts"]).alias("delivery_path_hosts"), joined(r["link_domains"]).alias("link_domains"), F.md5(r["body_excerpt"]).alias("body_md5"))


def answers(spark: SparkSession, sf_dir: str, step: int = 7) -> DataFrame:
    """Second opinions made from document ids: by remainder with probabilities, without 'none', with a choice only, empty, or failed."""
    d = F.col("doc_id")
    share = lambda k: (d * k) % 101 / F.lit(100.0)
    empty = F.lit(None).cast("map<string,double>")
    probs = F.when(d % 3 == 0, F.create_map(F.lit("none"), share(13), F.lit("prize"), 1 - share(13))).when(d % 3 == 1, F.create_map(F.lit("prize"), share(17) / 2, F.lit("refund"), share(19) / 2)).otherwise(empty)
    one = lambda noul, choice=F.lit(None), p=empty: F.struct(noul.cast("double").alias("noul"), choice.cast("string").alias("choice"), p.alias("probabilities"))
    pretext = one(F.lit(None), F.when(d % 4 == 0, "none").otherwise(F.concat(F.lit("p"), (d % 4).cast("string"))), probs)
    asked = {"sender_impersonation": one(share(step)), "credential_phishing": one(share(11)), "link_domain_mismatch": one(share(23)), "urgency_pressure": one(F.when(d % 2 == 0, share(29))), "ordinary_business_mail": one(share(31)), "phishing_pretext": pretext}
    table = F.create_map(*[x for k, v in asked.items() for x in (F.lit(k), v)])
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    usage = F.struct((d % 1000 + 2000).alias("input_tokens"), (d % 50 + 10).alias("output_tokens"))
    return rows.select(F.concat(F.lit("m"), d.cast("string")).alias("message_key"), F.when((d % 11 != 0) & (d % 5 != 0), table).alias("answers"), usage.alias("usage"), F.lit("m1").alias("model"), F.when(d % 11 == 0, "timeout").alias("error"))


def answers_sql(step: int = 7, name: str = "said") -> str:
    s = lambda k: f"(d.doc_id * {k} % 101 / 100.0::double)"
    pre = f"case when d.doc_id % 3 = 0 then greatest(0, least(1, 1 - {s(13)})) when d.doc_id % 3 = 1 then greatest(0, least(1, 0.0::double + {s(17)} / 2 + {s(19)} / 2)) when d.doc_id % 4 = 0 then 0 else 1 end"
    values = f"select concat('m', d.doc_id) as key, d.doc_id, case when d.doc_id % 11 = 0 then 'timeout' when d.doc_id % 5 = 0 then 'no answer' end as error, case when d.doc_id % 4 = 0 then 'none' else concat('p', d.doc_id % 4) end as pretext_choice, {s(step)} as q1, {s(11)} as q2, {pre} as q3, {s(23)} as q4, case when d.doc_id % 2 = 0 then {s(29)} else 0 end as q5, {s(31)} as q6 from documents d"
    d = lambda x: f"{x}::double"
    score = f"round(greatest(0, least(1, {d('0.30')} * q1 + {d('0.26')} * q3 + {d('0.22')} * q2 + {d('0.14')} * q4 + {d('0.08')} * q5 - {d('0.40')} * q6)) * 100)::int"
    return f"{name} as (select *, case when error is null then {score} end as model_score from ({values}))"


@query("with " + answers_sql() + " select key as msg_key, q3 as pretext, model_score from said where error is null")
def model_scores(spark, sf_dir):
    out = answers(spark, sf_dir).where("error is null and answers is not null").withColumn("d", decide.model_detail(F.col("answers")))
    return out.select(F.col("message_key").alias("msg_key"), F.col("d")["phishing_pretext"].alias("pretext"), decide.model_score(F.col("d")).alias("model_score"))


FINAL_SQL = """final as (select l.*, s.model_score as m, s.q6, s.key, s.error as said_error, l.allowed is null and l.blocked is null and score >= 35 and score < 70 as asked,
  round((0.3::double * score + 0.7::double * s.model_score) / (0.3::double + 0.7::double))::int as blended from lists l left join said s on s.key = l.msg_key),
verdicts as (select *, case when allowed is not null then 0 when blocked is not null then 100 when asked and m is not null then case when blended < score and not coalesce(q6, 0) >= 0.5 then score else blended end else score end as final_score,
  case when allowed is not null then 'allowlist' when blocked is not null then 'blocklist' when asked and m is null then 'failed' when asked then 'rules+model' else 'rules' end as path from final),
logged as (select *, case when final_score >= 55 then 'spam' when final_score >= 35 then 'suspect' else 'ham' end as verdict from verdicts)"""
SCREEN_SQL = (LISTS_SQL, answers_sql(), FINAL_SQL)


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.screen(messages(mail_view(spark, sf_dir)), LISTED, answers=answers(spark, sf_dir))


@query(chain("select msg_key, verdict, final_score as score, path, coalesce(allowed, blocked) as reason, case when allowed is null and blocked is null then ids else '' end as ids, case verdict when 'spam' then 'tag:spam/junk/move:junk' when 'suspect' then 'tag:suspect' else '' end as actions from logged", *SCREEN_SQL))
def screen(spark, sf_dir):
    return screened(spark, sf_dir).select("msg_key", "verdict", "score", "path", "reason", rules.hit_ids(F.col("rule_hits")).alias("ids"), joined("planned_actions").alias("actions"))


@query(chain("select verdict, path, count(*) as n from logged group by all", *SCREEN_SQL))
def verdict_counts(spark, sf_dir):
    return screened(spark, sf_dir).groupBy("verdict", "path").agg(F.count("*").alias("n"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts as a log, logged when received."""
    return screened(spark, sf_dir).withColumn("logged_at", F.col("date")).withColumn("source_path", F.concat(F.lit("box"), (F.substring("msg_key", 2, 20).cast("bigint") % 4).cast("string")))


@query(chain("select msg_key, concat('\"', verdict, '\",\"', final_score, '\"') as head, replace(replace(subject, '\"', '\"\"'), chr(10), ' ') as subject from logged", *SCREEN_SQL))
def csv_export(spark, sf_dir):
    out = log(spark, sf_dir).withColumn("source", F.lit("auto"))
    return out.select("msg_key", F.concat(F.lit('"'), "verdict", F.lit('","'), F.col("score").cast("string"), F.lit('"')).alias("head"), F.regexp_replace(F.replace(F.col("subject"), F.lit('"'), F.lit('""')), "\r?\n", " ").alias("subject"))


# --- calibration ------------------------------------------------------------------------------------------------------

LABELLED = "scored where label is not null"


def cube(spark, sf_dir):
    return calibrate.cube(scored_labelled(spark, sf_dir))


@query(chain(f"select l.label, b.bucket::int as bucket, coalesce(n, 0) as n from (select unnest(['ham', 'spam']) as label) l cross join range(11) b(bucket) left join (select label, least(10, score // 10) as bucket, count(*) as n from {LABELLED} group by all) c on c.label = l.label and c.bucket = b.bucket"))
def score_histogram(spark, sf_dir):
    return calibrate.histogram(cube(spark, sf_dir))


@query(chain(f"select label, count(*) as total, count(*) filter (score >= 55) as caught, count(*) filter (score >= 35 and score < 70) as gray, count(*) filter (score < 35) as missed from {LABELLED} group by label"))
def outcomes(spark, sf_dir):
    return calibrate.outcomes(cube(spark, sf_dir)).select("label", "total", "caught", "gray", "missed")


@query(chain(f"select r.id, r.weight::int as weight, count(s.id) filter (label = 'spam') as spam_hits, count(s.id) filter (label = 'ham') as ham_hits from (values {', '.join(f"('{r.id}', {r.weight})" for r in rules.RULES)}) r(id, weight) left join (select label, unnest(hits).id as id from {LABELLED}) s on s.id = r.id group by all"))
def rule_rates(spark, sf_dir):
    return calibrate.rule_rates(cube(spark, sf_dir)).select("id", "weight", "spam_hits", "ham_hits")


@query(chain("select msg_key, score, from_domain, subject from scored where label = 'spam' and score < 35 order by msg_key limit 30"))
def missed_sample(spark, sf_dir):
    return calibrate.missed_sample(scored_labelled(spark, sf_dir))


@query(chain("select from_domain, count(*) as n from scored where label = 'spam' and score < 35 group by 1 order by n desc, from_domain limit 30"))
def missed_domains(spark, sf_dir):
    return calibrate.missed_domains(slim(spark, sf_dir))


@query(chain("select msg_key, score, from_domain, array_to_string(list_transform(list_filter(hits, lambda h: h.weight > 0), lambda h: h.id), ',') as against from scored where label = 'ham' and score >= 55"))
def false_positives(spark, sf_dir):
    return calibrate.false_positives(slim(spark, sf_dir))


@query(chain(f"select l.label, b.t::int as threshold, count(s.score) as reached from (select unnest(['ham', 'spam']) as label) l cross join range(101) b(t) left join (select label, score from {LABELLED}) s on s.label = l.label and s.score >= b.t group by all"))
def threshold_sweep(spark, sf_dir):
    return calibrate.threshold_sweep(cube(spark, sf_dir))


_DROP = ", ".join(f"('without {k}', '{k}')" for k in rules.IDS)


@query(chain(f"select setting, count(*) filter (label = 'spam' and s >= 55) as caught, count(*) filter (label = 'ham' and s >= 55) as false_positives from (select g.setting, label, coalesce(list_sum(list_transform(list_filter(hits, lambda h: h.id <> g.id), lambda h: h.weight)), 0) as s from (select * from {LABELLED}) x cross join (values ('all', ''), {_DROP}) g(setting, id)) group by setting"))
def weight_sweep(spark, sf_dir):
    return calibrate.weight_sweep(cube(spark, sf_dir), calibrate.drop_one_grid())


@query(chain("select coalesce(sum(n), 0)::bigint as messages, count(*) as senders, count(*) filter (n = 1) as once, coalesce(sum(n - 1), 0)::bigint as stopped from (select from_domain, count(*) as n from logged where verdict = 'spam' and from_domain <> '' and from_domain not in (" + ", ".join(f"'{x}'" for x in [*FREEMAIL, *SELF]) + ") group by 1)", *SCREEN_SQL))
def sender_repetition(spark, sf_dir):
    return calibrate.sender_repetition(log(spark, sf_dir), "from_domain", calibrate.freemail_and(SELF))


# --- the verdict log --------------------------------------------------------------------------------------------------


@query(chain("select 'domain' as kind, from_domain as value, count(*) as n, coalesce(arg_max(subject, (received_at, msg_key)) filter (subject <> ''), '') as subject from logged where verdict = 'spam' and from_domain <> '' and from_domain not in (" + ", ".join(f"'{x}'" for x in [*FREEMAIL, "pia.co.jp"]) + ") and address <> 'info@mail.example.com' group by 2 having count(*) >= 2 union all select 'address', address, count(*), coalesce(arg_max(subject, (received_at, msg_key)) filter (subject <> ''), '') from logged where verdict = 'spam' and from_domain <> '' and from_domain not in (" + ", ".join(f"'{x}'" for x in [*FREEMAIL, "pia.co.jp"]) + ") and address <> 'info@mail.example.com' and address <> '' group by 2 having count(*) >= 2", *SCREEN_SQL))
def block_candidates(spark, sf_dir):
    known = spark.createDataFrame([("PIA.co.jp",), ("info@mail.example.com",)], "value string")
    return loganalytics.block_candidates(log(spark, sf_dir), 2, known)


@query(chain("select count(*) as total, count(*) filter (verdict = 'spam') as spam, count(*) filter (verdict = 'suspect') as suspect, count(*) filter (verdict = 'ham') as ham, count(*) filter (path in ('rules+model', 'failed')) as model_calls from logged", *SCREEN_SQL))
def log_summary(spark, sf_dir):
    return loganalytics.summary(log(spark, sf_dir))


@query(chain("select cast(received_at::date as varchar) as day, count(*) as total, count(*) filter (verdict = 'spam') as spam from logged group by 1", *SCREEN_SQL))
def log_daily(spark, sf_dir):
    return loganalytics.daily(log(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query(chain("select msg_key, verdict from logged order by received_at desc nulls last, msg_key limit 20", *SCREEN_SQL))
def log_recent(spark, sf_dir):
    return loganalytics.recent(log(spark, sf_dir)).select("msg_key", "verdict")


ALERT_SQL = """hourly as (select from_domain, floor(epoch_ms(received_at) / 3600000)::bigint as nth, count(*) as n, arg_max(coalesce(subject, ''), (received_at, coalesce(subject, ''))) as subject
  from logged where verdict = 'spam' and from_domain <> '' and received_at is not null group by 1, 2),
weekly as (select *, coalesce(sum(n) over (partition by from_domain order by nth range between 167 preceding and 1 preceding), 0)::bigint as before from hourly)"""


@query(chain("select from_domain, strftime(make_timestamp(nth * 3600000000), '%Y-%m-%d %H') as hour, before + n as n, subject from weekly where before < 2 and before + n >= 2", *SCREEN_SQL, ALERT_SQL))
def repeat_alerts(spark, sf_dir):
    return loganalytics.repeat_alerts(log(spark, sf_dir)).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query(chain("select msg_key, source_path from logged qualify row_number() over (partition by source_path order by received_at desc nulls last, msg_key) <= 50", *SCREEN_SQL))
def log_retained(spark, sf_dir):
    return loganalytics.retained(log(spark, sf_dir), 50).select("msg_key", "source_path")


@query(f"with mail as ({MAIL_SQL}) select msg_key, source_path from mail qualify row_number() over (partition by source_path order by received_at desc nulls last, msg_key desc) <= 25")
def newest_per_mailbox(spark, sf_dir):
    return sources.newest(messages(mail_view(spark, sf_dir)), 25).select("msg_key", "source_path")


@query("select distinct regexp_extract(url, '://([^/?#]*)', 1) as domain from pages union select 'own.example'")
def own_domains(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("me@"), F.regexp_extract("url", "://([^/?#]*)", 1)).alias("email"))
    return sources.own_domains(ids, ["Own.example"])


# --- evaluation of the second opinion ---------------------------------------------------------------------------------

AUTH = "(spf = 'pass' or dkim = 'pass')"
CASES_SQL = f"""inbox as (select * from scored where label = 'ham'), junk as (select * from scored where label = 'spam'),
good as (select distinct address from inbox where {AUTH} and address <> ''), seen as (select from_domain as gd, count(*) as inbox_n from inbox where {AUTH} and from_domain <> '' group by 1),
phish as (select j.* from junk j left join seen on gd = j.from_domain where not (brand_matched and {AUTH}) and address not in (select address from good) and not ({AUTH} and coalesce(inbox_n, 0) >= 3)),
cases as (select 'phish' as case_label, * from phish union all select 'ham', * from inbox where {AUTH})"""


def _pools(spark, sf_dir):
    # several passes follow: the scores are written once, without bodies
    rows = runs.written(scored_labelled(spark, sf_dir).select("msg_key", "label", "score", "from", "from_domain", "auth", "brand_matched", "message_id", "subject"))
    inbox, junk = rows.where("label = 'ham'"), rows.where("label = 'spam'")
    addresses, domains = evaluate.known_good(inbox)
    return evaluate.looks_phishing(junk, addresses, domains), inbox.where(evaluate.authenticated())


def _cases(spark, sf_dir):
    return evaluate.cases(*_pools(spark, sf_dir))


@query(chain("select msg_key, case_label, concat_ws(':', case_label, message_id, score) as case_key from cases", CASES_SQL))
def evaluation_cases(spark, sf_dir):
    return _cases(spark, sf_dir).select("msg_key", "case_label", "case_key")


@query(chain("select (score // 10)::bigint as band, least(count(*), 3) as n from phish where score >= 35 and score < 70 group by 1", CASES_SQL))
def stratified_bands(spark, sf_dir):
    """Three of each band, or all there are: the sample asks for as many as the bands can give at three each."""
    phish = _pools(spark, sf_dir)[0].where(evaluate.in_band(SETTINGS))
    want = phish.groupBy(F.floor(F.col("score") / 10).alias("band")).agg(F.least(F.count("*"), F.lit(3)).alias("n"))
    total = want.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return evaluate.stratified(phish, int(total)).groupBy(F.floor(F.col("score") / 10).alias("band")).agg(F.least(F.count("*"), F.lit(3)).alias("n"))


RUN_SQL = """{name} as (select concat_ws(':', case_label, message_id, score) as key, message_id, case_label as label, score as local_score, case when s.error is null then s.model_score end as model_score,
  case when s.key is not null and s.error is null then round((0.3::double * score + 0.7::double * s.model_score) / (0.3::double + 0.7::double))::int end as final_score,
  s.q1, s.q2, s.q3, s.q4, s.q5, s.q6, s.pretext_choice as pretext, c.from_domain, case when s.key is null then 'no answer' else s.error end as error, s.doc_id from cases c left join {said} s on s.key = c.msg_key)"""
EVAL_SQL = (CASES_SQL, answers_sql(), RUN_SQL.format(name="run", said="said"))


def _run(spark, sf_dir, step=7, cases=None):
    cases = _cases(spark, sf_dir) if cases is None else cases
    return evaluate.evaluation_run(cases, answers(spark, sf_dir, step), f"r{step}", SETTINGS)


@query(chain("select key, label, local_score, coalesce(model_score, -1) as model_score, coalesce(final_score, -1) as final_score, error from run", *EVAL_SQL))
def evaluation_run(spark, sf_dir):
    return _run(spark, sf_dir).select("key", "label", "local_score", F.coalesce("model_score", F.lit(-1)).alias("model_score"), F.coalesce("final_score", F.lit(-1)).alias("final_score"), "error")


@query(chain("select label, count(*) as n, count(*) filter (local_score >= 55) as local_over, count(*) filter (final_score >= 55) as final_over, round(avg(local_score), 1) as mean_local, round(avg(model_score), 1) as mean_model, round(avg(final_score), 1) as mean_final from run where error is null group by label", *EVAL_SQL))
def evaluation_over(spark, sf_dir):
    return evaluate.over_threshold(_run(spark, sf_dir))




@query(chain("select question, round(avg(v) filter (label = 'phish'), 6) as phish, round(avg(v) filter (label = 'ham'), 6) as ham from (select label, unnest(['sender_impersonation', 'credential_phishing', 'phishing_pretext', 'link_domain_mismatch', 'urgency_pressure', 'ordinary_business_mail']) as question, unnest([q1, q2, q3, q4, q5, q6]) as v from run where error is null) group by question", *EVAL_SQL))
def question_means(spark, sf_dir):
    return evaluate.question_means(_run(spark, sf_dir)).select("question", F.round("phish", 6).alias("phish"), F.round("ham", 6).alias("ham"))


@query(chain("select label, coalesce(nullif(pretext, ''), '(none)') as pretext, count(*) as n from run where error is null group by all", *EVAL_SQL))
def pretext_tally(spark, sf_dir):
    return evaluate.pretexts(_run(spark, sf_dir))


@query(chain("select count(*) as n, coalesce(sum(doc_id % 1000 + 2000), 0)::bigint as input_tokens, coalesce(sum(doc_id % 50 + 10), 0)::bigint as output_tokens, round(coalesce(sum(doc_id % 1000 + 2000), 0) / greatest(count(*), 1))::bigint as mean_input from run where error is null", *EVAL_SQL))
def token_usage(spark, sf_dir):
    return evaluate.token_usage(_run(spark, sf_dir))


@query(chain("select ((local_score - 25) // 10 * 10 + 25)::int as low, label, count(*) as n, count(*) filter (final_score >= 55) as over from run where error is null and local_score >= 25 and local_score < 75 group by 1, 2", *EVAL_SQL).replace(" as over from", ' as "over" from'))
def band_crossings(spark, sf_dir):
    return evaluate.band_crossings(_run(spark, sf_dir))


@query(chain("select key, local_score, final_score from run where error is null and label = 'phish' and local_score < 55 and final_score >= 55 order by key limit 10", *EVAL_SQL))
def rescued_cases(spark, sf_dir):
    return evaluate.crossed(_run(spark, sf_dir), "phish").select("key", "local_score", "final_score")


@query(chain("select c.msg_key from cases c where not exists (select 1 from run r where r.key = concat_ws(':', c.case_label, c.message_id, c.score) and r.error is null)", *EVAL_SQL))
def unanswered_cases(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    return evaluate.unanswered(cases, _run(spark, sf_dir, cases=cases)).select("msg_key")


LAST = "select *, row_number() over (partition by message_id order by key desc, model_score desc, final_score desc) as nth from {run} where model_score is not null"
PAIRS_SQL = (*EVAL_SQL, answers_sql(37, "said2"), RUN_SQL.format(name="run2", said="said2"), f"pairs as (select n.message_id as message, n.label as new_label, o.model_score as old_m, n.model_score as new_m, o.final_score as old_f, n.final_score as new_f, o.q1 as old_q1, n.q1 as new_q1 from ({LAST.format(run='run2')}) n join ({LAST.format(run='run')}) o on o.message_id = n.message_id and o.nth = 1 where n.nth = 1)")


def _pairs(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    return evaluate.compare_runs(_run(spark, sf_dir, 7, cases), _run(spark, sf_dir, 37, cases))


@query(chain("select message, new_label, old_m, new_m, case when new_label = 'phish' and old_f < 55 and new_f >= 55 then 'gained' when new_label = 'phish' and old_f >= 55 and new_f < 55 then 'lost' when new_label <> 'phish' and old_f < 55 and new_f >= 55 then 'worse' when new_label <> 'phish' and old_f >= 55 and new_f < 55 then 'fixed' end as transition from pairs", *PAIRS_SQL))
def run_transitions(spark, sf_dir):
    return evaluate.transitions(_pairs(spark, sf_dir)).select("message", "new_label", F.col("old_model_score").alias("old_m"), F.col("new_model_score").alias("new_m"), "transition")


@query(chain("select new_label as label, count(*) as n, count(*) filter (old_f >= 55) as old_over, count(*) filter (new_f >= 55) as new_over from pairs group by 1", *PAIRS_SQL))
def run_over_change(spark, sf_dir):
    return evaluate.over_change(_pairs(spark, sf_dir))


@query(chain("select 'old' as run, round(avg(old_q1) filter (new_label = 'phish') - avg(old_q1) filter (new_label = 'ham'), 6) as separation from pairs union all select 'new', round(avg(new_q1) filter (new_label = 'phish') - avg(new_q1) filter (new_label = 'ham'), 6) from pairs", *PAIRS_SQL))
def question_separation(spark, sf_dir):
    out = evaluate.question_separation(_pairs(spark, sf_dir)).where("question = 'sender_impersonation'")
    return out.select("run", F.round("separation", 6).alias("separation"))


@query(chain("select *, case when delta > 5 and net_ham <= 0 then 'better' when delta < -5 then 'worse' when net_ham > 0 then 'reject' else 'no difference' end as conclusion from (select count(*) filter (new_label = 'phish' and old_f < 55 and new_f >= 55) - count(*) filter (new_label = 'phish' and old_f >= 55 and new_f < 55) as net_phish, count(*) filter (new_label <> 'phish' and old_f < 55 and new_f >= 55) - count(*) filter (new_label <> 'phish' and old_f >= 55 and new_f < 55) as net_ham, round((coalesce(avg(new_m) filter (new_label = 'phish'), 0) - coalesce(avg(new_m) filter (new_label = 'ham'), 0)) - (coalesce(avg(old_m) filter (new_label = 'phish'), 0) - coalesce(avg(old_m) filter (new_label = 'ham'), 0)), 6) as delta, greatest(1, round(count(*) filter (new_label = 'phish') * 0.05))::int as noise from pairs)", *PAIRS_SQL))
def run_conclusion(spark, sf_dir):
    return evaluate.conclusion(_pairs(spark, sf_dir)).select("net_phish", "net_ham", F.round("delta", 6).alias("delta"), "noise", "conclusion")


_CSV = ("received_at::varchar", "received_at::varchar", "verdict", "final_score::varchar", "case when path not in ('allowlist', 'blocklist') then score::varchar end", "case when asked then m::varchar end", "path", "from_h", "from_domain", "subject", "array_to_string(brands, '/')", "case when path not in ('allowlist', 'blocklist') then ids end", "case verdict when 'spam' then 'tag:spam/junk/move:junk' when 'suspect' then 'tag:suspect' end", "'auto'", "case when path = 'failed' then coalesce(said_error, 'no answer') end")
_QUOTED = " || ',' || ".join(f"""'"' || replace(replace(coalesce({c}, ''), chr(10), ' '), '"', '""') || '"'""" for c in _CSV)


@query(chain(f"select {_QUOTED} as value from logged", *SCREEN_SQL))
def csv_lines(spark, sf_dir):
    return sinks.csv_lines(log(spark, sf_dir).withColumn("source", F.lit("auto")))


@query(chain("select msg_key, random_host, hidden, array_to_string(consumer_hops, '/') as consumer_hops, message_id_domain, array_to_string(unsub_domains, '/') as unsub_domains, array_to_string(foreign_domains[:10], '/') as foreign_domains, array_to_string(brand_foreign[:10], '/') as brand_foreign, array_to_string(urgency[:10], '/') as urgency from logged where path not in ('allowlist', 'blocklist')", *SCREEN_SQL))
def evidence(spark, sf_dir):
    e = F.col("evidence")
    lists = {"consumer_hops": "consumer_isp_hops", "unsub_domains": "list_unsub_domains", "foreign_domains": "foreign_link_domains", "brand_foreign": "brand_foreign_link_domains", "urgency": "urgency_hits"}
    out = screened(spark, sf_dir).where("evidence is not null")
    return out.select("msg_key", e["random_from_host"].alias("random_host"), e["hidden_random_text"].alias("hidden"), e["message_id_domain"].alias("message_id_domain"), *[joined(e[c]).alias(n) for n, c in lists.items()])


@query(chain("select msg_key, self_spoof from scored"))
def own_domain_table(spark, sf_dir):
    own = spark.createDataFrame([(d,) for d in SELF], "domain string")
    asked = features.senders(messages(mail_view(spark, sf_dir)))
    return features.mark_self_domains(featured(spark, sf_dir), own, asked).select("msg_key", F.col("self_domain_spoof").alias("self_spoof"))


@query(chain("select msg_key, verdict, final_score as score, path, 'manual' as source from logged where msg_key in (select concat('m', doc_id) from labels where toxic = 1)", *SCREEN_SQL))
def reclassified(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("msg_key"))
    return plan.reclassify(messages(mail_view(spark, sf_dir)), ids, settings=LISTED, answers=answers(spark, sf_dir)).select("msg_key", "verdict", "score", "path", "source")


@query(chain(f"select l.label, b.t::int as gray_low, count(s.score) as asked from (select unnest(['ham', 'spam']) as label) l cross join range(70) b(t) left join (select label, score from {LABELLED}) s on s.label = l.label and s.score >= b.t and s.score < 70 group by all"))
def gray_sweep(spark, sf_dir):
    return calibrate.gray_sweep(cube(spark, sf_dir), SETTINGS).select("label", "gray_low", "asked")


@query(chain("select coalesce(sum(n), 0)::bigint as messages, count(*) as senders, count(*) filter (n = 1) as once, coalesce(sum(n - 1), 0)::bigint as stopped from (select address, count(*) as n from logged where verdict = 'spam' and address <> '' group by 1)", *SCREEN_SQL))
def sender_repetition_by_address(spark, sf_dir):
    return calibrate.sender_repetition(log(spark, sf_dir).withColumn("address", t.parse_address(F.col("author"))["address"]), "address")


# --- written and read back --------------------------------------------------------------------------------------------


@query("select doc_id, 'Weekly ' || (doc_id % 7) as subject, md5(rtrim(coalesce(text, ''), chr(13) || chr(10))) as body_md5, 'text/plain' as content_type from documents")
def mailbox_archive(spark, sf_dir):
    """The documents as messages of archives, written and read by ranges of bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "(?md)^(>*From )", ">$1")
    head = F.format_string("From x@example.com Mon Jan  1 00:00:00 2024\nMessage-ID: <%d@example.com>\nSubject: =?utf-8?Q?Weekly_%d?=\nContent-Transfer-Encoding: 8bit\n\n", "doc_id", F.col("doc_id") % 7)
    folder = runs.scratch(spark)
    docs.select(F.concat(head, body, F.lit("\n"))).write.text(folder)
    read = mailbox.read_mbox(spark, folder, rangeBytes=16 << 20)
    text = F.coalesce(F.get("bodies", F.lit(0))["body"], F.lit(""))
    doc_id = F.regexp_extract("header_message_id", "<([0-9]+)@", 1).cast("bigint")
    return read.select(doc_id.alias("doc_id"), F.get(F.col("headers")["subject"], F.lit(0)).alias("subject"), F.md5(F.rtrim(text, F.lit("\r\n"))).alias("body_md5"), F.lit("text/plain").alias("content_type"))


@query(chain("select new_label as label, count(*) as n, count(*) filter (old_f >= 55) as old_over, count(*) filter (new_f >= 55) as new_over, count(*) filter (new_label = 'phish' and old_f < 55 and new_f >= 55) as gained, count(*) filter (new_label = 'phish' and old_f >= 55 and new_f < 55) as lost from pairs group by 1", *PAIRS_SQL))
def stored_runs(spark, sf_dir):
    """Two runs stored in buckets, then compared without a shuffle of either."""
    tables, cases = [], _cases(spark, sf_dir)
    for step in (7, 37):
        folder = runs.scratch(spark)
        tables.append(f"run_{folder[-32:]}")
        runs.store_run(_run(spark, sf_dir, step, cases), tables[-1], buckets=int(spark.conf.get("spark.sql.shuffle.partitions")), path=folder)
    pairs = evaluate.transitions(runs.compare_stored(spark, *tables))
    over = lambda c: F.count(F.when(F.col(c) >= SETTINGS.spam_threshold, 1))
    moved = lambda k: F.count(F.when(F.col("transition") == k, 1))
    return pairs.groupBy(F.col("new_label").alias("label")).agg(F.count("*").alias("n"), over("old_final_score").alias("old_over"), over("new_final_score").alias("new_over"), moved("gained").alias("gained"), moved("lost").alias("lost"))


@query(chain("select msg_key, score, greatest(0, least(100, coalesce(list_sum(list_transform(hits, lambda h: case h.id when 'upstreamSpamFlag' then 26 when 'brandMatched' then 0 else h.weight end)), 0)))::int as other_score, ids from scored"))
def kept_scores(spark, sf_dir):
    """R33, R34 from stored hits: half of the mail is stored first, then all of it, of which only the rest is read for features.
    The mail is written first, as five passes over it follow, each of which would join the tables of the view again."""
    mail, folder = runs.written(messages(mail_view(spark, sf_dir))), runs.scratch(spark)
    kept.update(mail.where("source_path in ('box0', 'box1')"), folder, SETTINGS)
    kept.update(mail, folder, SETTINGS)
    out = kept.scores(mail, folder, SETTINGS)
    return out.select("msg_key", "score", rules.rescored(F.col("rule_hits"), {"upstreamSpamFlag": 26, "brandMatched": 0}).alias("other_score"), rules.hit_ids(F.col("rule_hits")).alias("ids"))
