"""From scores to verdicts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.settings import Settings
from .features import host_suffixes

QUESTIONS = ("sender_impersonation", "credential_phishing", "phishing_pretext", "link_domain_mismatch", "urgency_pressure", "ordinary_business_mail")
ANSWERS = "message_key string, answers map<string,struct<noul:double,choice:string,probabilities:map<string,double>>>, usage struct<input_tokens:bigint,output_tokens:bigint>, model string, error string"


def list_reason(kind: str, addresses, domains) -> Column:
    """D1, D2 with short lists: the reason text of the first entry that fits, else null. Addresses come before domains."""
    sender, host = F.col("from.address"), F.col("from.host")
    hit = F.try_element_at(F.filter(t.strings(domains), lambda d: t.under_domain(host, d)), F.lit(1))
    by_address = (sender != "") & F.array_contains(t.strings([a.lower() for a in addresses]), sender)
    return F.when(by_address, F.concat(F.lit(f"{kind}Addresses: "), sender)).when(hit.isNotNull(), F.concat(F.lit(f"{kind}Domains: "), hit))


def match_list(features: DataFrame, entries: DataFrame, kind: str, out: str, asked: DataFrame | None = None) -> DataFrame:
    """D1, D2 with a table (kind: address|domain, value, position) of any size. Each different sender is looked up once, by equality
    on address and on host suffixes; only senders that an entry fits are joined back, so messages without a key match too. asked:
    features.senders() of the same messages, which spares a second run of the features."""
    entries = entries.where(F.col("value").isNotNull()).select(F.col("kind").alias("entry_kind"), F.lower("value").alias("entry_key"), "value", "position")
    senders = features.select(F.col("from.address").alias("sender"), F.col("from.host").alias("sender_host")).distinct() if asked is None else asked
    keys = F.array(F.struct(F.lit("address").alias("entry_kind"), F.col("sender").alias("entry_key")))
    both = F.concat(keys, F.transform(host_suffixes(F.col("sender_host")), lambda s: F.struct(F.lit("domain").alias("entry_kind"), s.alias("entry_key"))))
    asked = senders.select("sender", "sender_host", F.explode(both).alias("k")).select("sender", "sender_host", "k.*").where("entry_key <> ''")
    first = F.struct((F.col("entry_kind") != "address").alias("late"), F.col("position"))
    named = F.when(F.col("entry_kind") == "address", F.concat(F.lit(f"{kind}Addresses: "), F.col("entry_key"))).otherwise(F.concat(F.lit(f"{kind}Domains: "), F.col("value")))
    found = asked.join(entries, ["entry_kind", "entry_key"]).groupBy("sender", "sender_host").agg(F.min_by(named, first).alias(out))
    same = F.col("from.address").eqNullSafe(F.col("sender")) & F.col("from.host").eqNullSafe(F.col("sender_host"))
    return features.join(found, same, "left").drop("sender", "sender_host")


def in_gray(settings: Settings, score: str = "score") -> Column:
    """D4."""
    return (F.col(score) >= settings.gray_low) & (F.col(score) < settings.gray_high)


def build_request(settings: Settings) -> Column:
    """What a second opinion is asked about a message."""
    body = F.substring(F.regexp_replace("body_text", f"{t.WS}+\n", "\n"), 1, settings.body_limit)
    return F.struct(
        F.col("from.display").alias("from_display_name"), F.col("from.address").alias("from_address"), F.col("from_domain"),
        F.col("reply_to.address").alias("reply_to_address"), F.col("return_path.host").alias("return_path_domain"), F.col("message_id_domain"),
        F.col("list_unsub_domains").alias("list_unsubscribe_domains"), F.col("feedback_id"), F.slice("hops", 1, 12).alias("delivery_path_hosts"),
        F.col("subject"), body.alias("body_excerpt"), F.slice("link_domains", 1, 20).alias("link_domains"),
    )


def pretext_probability(answer: Column) -> Column:
    """The probability of any pretext but none."""
    probs = answer["probabilities"]
    total = F.aggregate(F.map_values(F.map_filter(probs, lambda k, v: (k != "none") & v.isNotNull())), F.lit(0.0), lambda a, v: a + v)
    value = F.when(probs["none"].isNotNull(), 1 - probs["none"]).when(probs.isNotNull(), total).when(F.length(answer["choice"]) > 0, F.when(answer["choice"] == "none", 0.0).otherwise(1.0)).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def model_detail(answers: Column) -> Column:
    """The values of all questions."""
    value = lambda q: pretext_probability(answers[q]) if q == "phishing_pretext" else F.coalesce(answers[q]["noul"], F.lit(0.0))
    return F.create_map(*[x for q in QUESTIONS for x in (F.lit(q), value(q))])


def model_score(detail: Column) -> Column:
    """0-100 from the values."""
    plus = 0.30 * detail["sender_impersonation"] + 0.26 * detail["phishing_pretext"] + 0.22 * detail["credential_phishing"] + 0.14 * detail["link_domain_mismatch"] + 0.08 * detail["urgency_pressure"]
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), plus - 0.40 * detail["ordinary_business_mail"])) * 100).cast("int")


def blend_raw(local: Column, model: Column, settings: Settings) -> Column:
    """D8 as evaluation has it."""
    return F.round((settings.weight_local * local + settings.weight_model * model) / (settings.weight_local + settings.weight_model)).cast("int")


def blend_guarded(local: Column, model: Column, ordinary: Column, settings: Settings) -> Column:
    """The second opinion only lowers a score if it takes the mail for ordinary."""
    blended = blend_raw(local, model, settings)
    return F.when((blended < local) & ~(F.coalesce(ordinary, F.lit(0.0)) >= 0.5), local).otherwise(blended)


def one_answer(answers: DataFrame) -> DataFrame:
    """The answers, one for each key; of several the one that sorts first, so reruns agree."""
    nth = F.row_number().over(Window.partitionBy("message_key").orderBy(F.col("error").isNotNull(), F.to_json("answers"), "model"))
    return answers.where("message_key is not null").withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def attach_answers(scored: DataFrame, answers: DataFrame | None, settings: Settings) -> DataFrame:
    """Adds model and error, in one pass over the messages. Only gray ones have a key to join on; the others get one that no
    answer has, each another, so that none of them meet in one task where the answers are too many to broadcast."""
    empty = scored.withColumns({"model": F.lit(None).cast("struct<score:int,detail:map<string,double>,pretext:string,usage:struct<input_tokens:bigint,output_tokens:bigint>,model:string>"), "error": F.lit(None).cast("string"), "asked": F.lit(False)})
    if answers is None or not settings.second_opinion:
        return empty
    said = one_answer(answers).withColumn("detail", model_detail(F.col("answers")))
    good = F.col("error").isNull() & F.col("answers").isNotNull()
    model = F.struct(model_score(F.col("detail")).alias("score"), F.col("detail"), F.col("answers")["phishing_pretext"]["choice"].alias("pretext"), F.col("usage"), F.col("model"))
    said = said.select(F.col("message_key").alias("msg_key"), F.when(good, model).alias("model"), F.when(~good, F.coalesce("error", F.lit("no answer"))).alias("error"))
    gray = F.col("allowed").isNull() & F.col("blocked").isNull() & in_gray(settings)
    said = said.select(F.struct(F.lit(0).alias("apart"), F.col("msg_key").alias("key")).alias("ask_key"), "model", "error")
    apart = F.struct(F.lit(1).alias("apart"), F.coalesce("msg_key", F.lit("")).alias("key"))
    rows = scored.withColumn("asked", gray).withColumn("ask_key", F.when(F.col("asked"), F.struct(F.lit(0).alias("apart"), F.col("msg_key").alias("key"))).otherwise(apart))
    out = rows.join(said, "ask_key", "left").drop("ask_key")
    return out.withColumn("error", F.when(F.col("asked") & F.col("model").isNull(), F.coalesce("error", F.lit("no answer"))))


def decide(attached: DataFrame, settings: Settings) -> DataFrame:
    """Lists first, then rules, blended with a second opinion where there is one."""
    allowed, blocked = F.col("allowed").isNotNull(), F.col("blocked").isNotNull()
    listed = allowed | blocked
    model, local = F.col("model"), F.col("score")
    final = F.when(allowed, 0).when(blocked, 100).when(model.isNotNull(), blend_guarded(local, model["score"], model["detail"]["ordinary_business_mail"], settings)).otherwise(local)
    path = F.when(allowed, "allowlist").when(blocked, "blocklist").when(F.col("asked") & model.isNull(), "failed").when(model.isNotNull(), "rules+model").otherwise("rules")
    evidence = F.struct("random_from_host", "hidden_random_text", "consumer_isp_hops", "message_id_domain", "list_unsub_domains", F.slice("foreign_link_domains", 1, 10).alias("foreign_link_domains"), F.slice("brand_foreign_link_domains", 1, 10).alias("brand_foreign_link_domains"), F.slice("urgency_hits", 1, 10).alias("urgency_hits"))
    out = attached.withColumns({"final_score": final.cast("int"), "path": path, "reason": F.coalesce("allowed", "blocked")})
    verdict = F.when(F.col("final_score") >= settings.spam_threshold, "spam").when(F.col("final_score") >= settings.gray_low, "suspect").otherwise("ham")
    no_hits = F.array().cast("array<struct<id:string,label:string,weight:int>>")
    return out.select(
        "msg_key", "header_message_id", F.col("received_at").alias("date"), F.when(F.col("author") != "", F.col("author")).otherwise(F.col("from.address")).alias("author"), "subject", "from_domain", "brands",
        verdict.alias("verdict"), F.col("final_score").alias("score"), F.when(~listed, local).alias("local_score"), F.when(~listed, model["score"]).alias("model_score"), "path", "reason",
        F.when(listed, no_hits).otherwise(F.col("rule_hits")).alias("rule_hits"), F.when(~listed, model).alias("model"), F.when(~listed, F.col("error")).alias("error"), F.when(~listed, evidence).alias("evidence"),
        planned_actions(verdict, settings).alias("planned_actions"),
    )


def planned_actions(verdict: Column, settings: Settings) -> Column:
    """What would be done with the message, as a list of steps."""
    steps = {"spam": ["tag:spam"], "suspect": ["tag:suspect"]} if settings.action != "log_only" else {}
    if settings.action in ("mark_junk", "mark_and_move"):
        steps["spam"] = [*steps["spam"], "junk"]
    if settings.action == "mark_and_move":
        steps["spam"] = [*steps["spam"], "move:junk"]
    out = t.strings(())
    for kind, names in steps.items():
        out = F.when(verdict == kind, t.strings(names)).otherwise(out)
    return out


def ask_with(requests: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Answers from a function of one's own. requests has msg_key and request (JSON); the function gets and returns batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield scorer(batch)

    return requests.mapInPandas(run, ANSWERS)
