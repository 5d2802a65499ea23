"""Evaluation of a second opinion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.settings import Settings
from .decide import blend_raw, build_request, in_gray, model_detail, model_score, one_answer


def authenticated() -> Column:
    return (F.col("auth.spf") == "pass") | (F.col("auth.dkim") == "pass")


def known_good(inbox: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Addresses, and counts of domains, that authenticated inbox mail came from."""
    good = inbox.where(authenticated())
    addresses = good.where("from.address <> ''").select(F.col("from.address").alias("address")).distinct()
    domains = good.where("from_domain <> ''").groupBy("from_domain").agg(F.count("*").alias("inbox_n"))
    return addresses, domains


def proven_legitimate() -> Column:
    """E2."""
    return F.col("brand_matched") & authenticated()


def looks_phishing(junk: DataFrame, addresses: DataFrame, domains: DataFrame, least: int = 3) -> DataFrame:
    """Junk that is neither proven, nor from a known address, nor authenticated from a domain seen often. Counts of
    domains are joined after they are summed, so a domain that heads the list is one row on that side."""
    out = junk.where(~proven_legitimate()).withColumn("address", F.col("from.address")).join(addresses, "address", "left_anti")
    out = out.join(domains, "from_domain", "left")
    return out.where(~(authenticated() & (F.coalesce("inbox_n", F.lit(0)) >= least))).drop("address", "inbox_n")


def in_band(settings: Settings, low: int | None = None, high: int | None = None) -> Column:
    """Scores from low to high, both included, or else the gray zone."""
    return in_gray(settings) if low is None or high is None else F.col("score").between(low, high)


def stratified(scored: DataFrame, n: int, salts: int = 64) -> DataFrame:
    """E5: n rows, drawn equally from bands of ten points, by hash order. Each band is first cut to n rows in every salt,
    so no task sees a whole band."""
    band, draw = F.floor(F.col("score") / 10), F.xxhash64("msg_key", "score")
    rows = scored.withColumns({"__band": band, "__draw": draw, "__salt": F.pmod(F.xxhash64("msg_key"), F.lit(salts))})
    first = Window.partitionBy("__band", "__salt").orderBy("__draw", "msg_key")
    rows = rows.withColumn("__nth", F.row_number().over(first)).where(F.col("__nth") <= n)
    rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("__band").orderBy("__draw", "msg_key")))
    return rows.where(F.col("__nth") <= n).orderBy("__nth", "__band").limit(n).drop("__band", "__draw", "__salt", "__nth")


def cases(phish: DataFrame, ham: DataFrame) -> DataFrame:
    """E6, with the key of a case."""
    both = phish.withColumn("case_label", F.lit("phish")).unionByName(ham.withColumn("case_label", F.lit("ham")))
    return both.withColumn("case_key", F.concat_ws(":", "case_label", "message_id", F.col("score").cast("string")))


def request_volume(requests: DataFrame, question_chars: int, settings: Settings | None = None) -> DataFrame:
    """Characters and a range of tokens that asking about all rows would take."""
    request = F.to_json(build_request(settings or Settings()))
    out = requests.agg(F.count("*").alias("cases"), F.coalesce(F.sum(F.length(request)), F.lit(0)).alias("chars"))
    chars = F.col("chars") + F.lit(question_chars) * F.col("cases")
    return out.select("cases", "chars", F.round(chars / 3).cast("bigint").alias("tokens_low"), F.round(chars / 1.5).cast("bigint").alias("tokens_high"))


def unanswered(cases: DataFrame, stored: DataFrame) -> DataFrame:
    """E8."""
    return cases.join(stored.where("error is null").select(F.col("key").alias("case_key")).distinct(), "case_key", "left_anti")


def evaluation_run(cases: DataFrame, answers: DataFrame, run_id: str, settings: Settings | None = None) -> DataFrame:
    """The rows of an evaluation run: cases with their answers, scored and blended without the guard."""
    s = settings or Settings()
    said = one_answer(answers).withColumn("detail", model_detail(F.col("answers")))
    rows = cases.join(said.withColumnRenamed("message_key", "msg_key"), "msg_key", "left")
    good = F.col("answers").isNotNull() & F.col("error").isNull()
    local, model = F.col("score"), F.when(good, model_score(F.col("detail")))
    return rows.select(F.lit(run_id).alias("run_id"), F.col("case_key").alias("key"), F.col("case_label").alias("label"), "message_id", local.alias("local_score"), model.alias("model_score"), F.when(good, blend_raw(local, model, s)).alias("final_score"), F.when(good, F.col("detail")).alias("detail"), F.when(good, F.col("answers")["phishing_pretext"]["choice"]).alias("pretext"), "from_domain", F.substring("subject", 1, 50).alias("subject"), "usage", F.when(~good, F.coalesce("error", F.lit("no answer"))).alias("error"))


def _ok(run: DataFrame) -> DataFrame:
    return run.where("error is null")


def over_threshold(run: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Messages, those over the threshold before and after, and mean scores, by label."""
    s = settings or Settings()
    over = lambda c: F.count(F.when(F.col(c) >= s.spam_threshold, 1))
    return _ok(run).groupBy("label").agg(F.count("*").alias("n"), over("local_score").alias("local_over"), over("final_score").alias("final_over"), F.round(F.avg("local_score"), 1).alias("mean_local"), F.round(F.avg("model_score"), 1).alias("mean_model"), F.round(F.avg("final_score"), 1).alias("mean_final"))


def question_means(run: DataFrame) -> DataFrame:
    """E11."""
    rows = _ok(run).select("label", F.explode("detail").alias("question", "value"))
    mean = lambda label: F.avg(F.when(F.col("label") == label, F.col("value"))).alias(label)
    return rows.groupBy("question").agg(mean("phish"), mean("ham"))


def pretexts(run: DataFrame) -> DataFrame:
    """E12."""
    return _ok(run).groupBy("label", F.coalesce(F.when(F.col("pretext") != "", F.col("pretext")), F.lit("(none)")).alias("pretext")).agg(F.count("*").alias("n")).orderBy("label", F.desc("n"), "pretext")


def token_usage(fresh: DataFrame) -> DataFrame:
    """E13, over rows that were asked in this run."""
    out = _ok(fresh).agg(F.count("*").alias("n"), F.coalesce(F.sum("usage.input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("usage.output_tokens"), F.lit(0)).alias("output_tokens"))
    return out.withColumn("mean_input", F.round(F.col("input_tokens") / F.greatest(F.col("n"), F.lit(1))).cast("bigint"))


def band_crossings(run: DataFrame, settings: Settings | None = None) -> DataFrame:
    """In bands 25-34 to 65-74 of the local score, messages and those over the threshold after, by label."""
    s = settings or Settings()
    rows = _ok(run).where((F.col("local_score") >= 25) & (F.col("local_score") < 75))
    low = (F.floor((F.col("local_score") - 25) / 10) * 10 + 25).cast("int")
    return rows.groupBy(low.alias("low"), "label").agg(F.count("*").alias("n"), F.count(F.when(F.col("final_score") >= s.spam_threshold, 1)).alias("over"))


def crossed(run: DataFrame, label: str, n: int = 10, settings: Settings | None = None) -> DataFrame:
    """Ham that was pushed up, or phish that was rescued."""
    s = settings or Settings()
    rows = _ok(run).where((F.col("label") == label) & (F.col("local_score") < s.spam_threshold) & (F.col("final_score") >= s.spam_threshold))
    return rows.orderBy("key").limit(n).select("key", "local_score", "final_score", "from_domain", "subject")


def message_of(key: Column) -> Column:
    """The message id inside a key label:id:score; the id may hold colons."""
    return F.regexp_extract(key, "(?s)^[^:]*:(.*):[^:]*$", 1)


def last_by_message(run: DataFrame) -> DataFrame:
    latest = Window.partitionBy("message").orderBy(F.desc("key"), F.desc("model_score"), F.desc("final_score"))
    rows = run.where("model_score is not null").withColumn("message", message_of(F.col("key")))
    return rows.withColumn("__nth", F.row_number().over(latest)).where("__nth = 1").drop("__nth")


#: What a comparison reads of each run.
PAIR_FIELDS = ("label", "model_score", "final_score", "detail", "from_domain", "subject")


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each message of both runs. Both sides are ranked by message, so the join needs no more shuffle."""
    side = lambda df, p: last_by_message(df).select("message", *[F.col(c).alias(f"{p}_{c}") for c in PAIR_FIELDS])
    return side(new, "new").join(side(old, "old"), "message")


def over_change(pairs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """E17."""
    s = settings or Settings()
    over = lambda c: F.count(F.when(F.col(c) >= s.spam_threshold, 1))
    return pairs.groupBy(F.col("new_label").alias("label")).agg(F.count("*").alias("n"), over("old_final_score").alias("old_over"), over("new_final_score").alias("new_over"))


def _separation(run: str) -> Column:
    mean = lambda label: F.coalesce(F.avg(F.when(F.col("new_label") == label, F.col(f"{run}_model_score"))), F.lit(0.0))
    return mean("phish") - mean("ham")


def score_separation(pairs: DataFrame) -> DataFrame:
    """Mean of phish minus mean of ham, before and after."""
    return pairs.agg(_separation("old").alias("old_separation"), _separation("new").alias("new_separation")).withColumn("delta", F.col("new_separation") - F.col("old_separation"))


def question_separation(pairs: DataFrame) -> DataFrame:
    """By run and question; null where one label has no value."""
    one = lambda p: pairs.select(F.lit(p).alias("run"), "new_label", F.explode(f"{p}_detail").alias("question", "value"))
    mean = lambda label: F.avg(F.when(F.col("new_label") == label, F.col("value")))
    out = one("old").unionByName(one("new")).groupBy("run", "question").agg(mean("phish").alias("phish"), mean("ham").alias("ham"))
    return out.withColumn("separation", F.col("phish") - F.col("ham"))


def transitions(pairs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Adds transition (gained, lost, worse, fixed or null) to each pair."""
    s = settings or Settings()
    was, now, phish = F.col("old_final_score") >= s.spam_threshold, F.col("new_final_score") >= s.spam_threshold, F.col("new_label") == "phish"
    return pairs.withColumn("transition", F.when(phish & ~was & now, "gained").when(phish & was & ~now, "lost").when(~phish & ~was & now, "worse").when(~phish & was & ~now, "fixed"))


def conclusion(pairs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row with the net changes, the separations and what follows from them."""
    count = lambda k: F.count(F.when(F.col("transition") == k, 1))
    net = transitions(pairs, settings).agg((count("gained") - count("lost")).alias("net_phish"), (count("worse") - count("fixed")).alias("net_ham"), F.count(F.when(F.col("new_label") == "phish", 1)).alias("n_phish"), _separation("old").alias("old_separation"), _separation("new").alias("new_separation"))
    out = net.withColumn("delta", F.col("new_separation") - F.col("old_separation"))
    said = F.when((F.col("delta") > 5) & (F.col("net_ham") <= 0), "better").when(F.col("delta") < -5, "worse").when(F.col("net_ham") > 0, "reject").otherwise("no difference")
    return out.withColumns({"noise": F.greatest(F.lit(1), F.round(F.col("n_phish") * 0.05).cast("int")), "conclusion": said})


